import random
import re
import zlib
from collections import Counter

import helpers
import numpy as np
import pytest
from tokenloom.llm import variants as vr

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_words(rows):
    found = Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def apart(a, b):
    """Edit distance, by the table."""
    row = list(range(len(b) + 1))
    for x in a:
        last, row[0] = row[0], row[0] + 1
        for k, y in enumerate(b):
            last, row[k + 1] = row[k + 1], min(row[k + 1] + 1, row[k] + 1, last + (x != y))
    return row[-1]


def plain(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and apart(v, w) == 1] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, n, form[w] or "", root(w), len(near[w]), words.get(form[w], -1)) for w, n in words.items())


def result(df):
    return sorted((r.word, r.n, r.form or "", r.root, r.n_near, -1 if r.form_n is None else r.form_n) for r in vr.group(df).collect())


def corpus(rng, n):
    base = ["".join(rng.choice("abcdeéñÿ") for _ in range(rng.randint(6, 11))) for _ in range(25)]

    def edited(w):
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            p = rng.randrange(len(w))
            w = rng.choice([w[:p] + w[p + 1 :], w[:p] + rng.choice("abzÉ") + w[p:], w[:p] + rng.choice("abzñ") + w[p + 1 :]])
        return w.upper() if rng.random() < 0.1 else w

    return [" ".join(edited(rng.choice(base)) if rng.random() < 0.5 else base[min(24, int(rng.expovariate(0.4)))] for _ in range(rng.choice([0, 3, 60]))) for _ in range(n)]


@pytest.mark.parametrize(("leaf", "subtree", "hold", "visitors"), [(24, 20_000, 200_000, 20_000), (2, 30, 7, 11)])
def test_random_documents(spark, monkeypatch, leaf, subtree, hold, visitors):
    for name, value in (("LEAF", leaf), ("SUBTREE", subtree), ("HOLD", hold), ("VISITORS", visitors)):
        monkeypatch.setattr(vr, name, value)
    rng = random.Random(leaf)
    rows = list(enumerate([*corpus(rng, 250), *["longchain " * 40] * 10, *["longchein " * 5] * 5, *["lungchein"] * 2]))
    words = plain_words(rows)
    want = plain(words)
    assert sum(x[2] != "" for x in want) > 20 and any(x[2] not in ("", x[3]) for x in want)
    assert result(helpers.docs(spark, [t for _, t in rows])) == want


def test_search_finds_what_comparing_all_finds(monkeypatch):
    monkeypatch.setattr(vr, "LEAF", 3)
    rng = random.Random(8)
    groups = np.arange(256) % vr.GROUPS
    for wide in (40, 9):
        monkeypatch.setattr(vr, "WIDE", wide)
        for _ in range(20):
            words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(5, 12))) for _ in range(60)} | {"a" * k for k in (300, 301, 302, 39, 40, 41)})
            words += [w[:-1] + "ÿ" for w in words[:9]]
            held = vr.Words(words, groups)
            got = sorted((int(a), int(b)) for i, j in vr.search(held, held, 0) for a, b in zip(i, j, strict=True))
            assert got == [(a, b) for a in range(len(words)) for b in range(len(words)) if vr.one_apart(held.raw[a], held.raw[b])]
            assert all(vr.one_apart(held.raw[a], held.raw[b]) == (apart(words[a], words[b]) == 1) for a in range(12) for b in range(12))


def test_checksums():
    rng = random.Random(2)
    texts = ["", "x", *["".join(rng.choice("abcñ") for _ in range(rng.randint(1, 30))) for _ in range(200)]]
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(t) for t in raw])
    seeds = [zlib.crc32(f"{k}:".encode()) for k in range(len(raw))]
    got = vr.crc32s(np.frombuffer(b"".join(raw), np.uint8), ends - [len(t) for t in raw], ends, np.array(seeds, np.uint32))
    assert got.tolist() == [zlib.crc32(f"{k}:{t}".encode()) for k, t in enumerate(texts)]


def test_awkward_documents(spark):
    rows = [(i, t) for i, t, *_ in helpers.ROWS]
    assert result(helpers.awkward(spark)) == plain(plain_words(rows))
    odd = ["straße × ÷ Ÿ naïveté NAÏVETÉ naïvete", "ÀÉÎÕÜßÿ ÀÉÎÕÜßÿ àéîõüßÿ", "x" * 900, "x" * 899, "x" * 900, "x" * 899, "abcdefg_abcdefg.abcdefgĀabcdefg", "ƀabcdefg éabcdefg ©abcdefg🎉abcdefgh abcdefgh"]
    odd += ["tied one onetied a tiedone tiedona"] + ["tiedona tiedonb"] * 10 + ["tiedonc"] * 3
    assert result(helpers.docs(spark, odd)) == plain(plain_words(list(enumerate(odd))))
    assert vr.group(helpers.empty(spark)).count() == 0
    assert vr.group(helpers.empty(spark)).columns == ["word", "n", "form", "root", "n_near", "form_n"]
