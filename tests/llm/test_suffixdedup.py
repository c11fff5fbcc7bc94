import random

import helpers
import numpy as np
import pytest
from tokenloom.llm import suffixdedup as sd


def plain(rows):
    """doc id -> (kept, removed, spans) of (id, bytes) rows, by looking at every window."""
    first = {}
    for i, b in rows:
        if i is not None:
            for s in range(len(b) - sd.LENGTH + 1):
                w = b[s : s + sd.LENGTH]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - sd.LENGTH + 1):
            if i is not None and first[b[s : s + sd.LENGTH]] < i:
                gone[s : s + sd.LENGTH] = True
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(len(b) > 0 and gone[0])
        out.append((i, bytes(np.frombuffer(b, np.uint8)[~gone]), len(b), int(gone.sum()), spans))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in sd.remove_repeats(df).collect()), key=str)


def test_merge_orders_all_runs():
    rng = random.Random(2)
    for _ in range(300):
        runs = [sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 8))}) for _ in range(rng.randint(1, 7))]
        coded = [sd.front_code(r) for r in runs]
        got = list(sd.merge(coded))
        assert [g[0] for g in got] == sorted(s for r in runs for s in r)
        for a, b in zip(got, got[1:]):
            same = next((k for k in range(min(len(a[0]), len(b[0]))) if a[0][k] != b[0][k]), min(len(a[0]), len(b[0])))
            assert b[1] == same and b[2] == (a[0] == b[0])
        assert all(runs[r][k] == s for s, _, _, r, k in got)


def test_stretches_hold_every_window_once_under_one_name():
    rng = random.Random(3)
    parts = [bytes(rng.choice(b"abcd ") for _ in range(rng.randint(0, 200))) for _ in range(20)] + [b"x" * 400]
    parts[7] = parts[3] + parts[5]
    data, offsets = np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    start, size, name = sd.stretches(data, offsets)
    seen, named = [], {}
    for s, n, v in zip(start.tolist(), size.tolist(), name.tolist()):
        for k in range(s, s + n):
            seen.append(k)
            assert named.setdefault(data[k : k + sd.LENGTH].tobytes(), v) == v
    assert sorted(seen) == [k for i, j in zip(offsets[:-1], offsets[1:]) for k in range(i, j - sd.LENGTH + 1)]


@pytest.mark.parametrize("hot", [4096, 0, 3])
def test_random_documents(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "RUN_BYTES", 3000)
    monkeypatch.setattr(sd, "HOT", hot)
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(40, 140))) for _ in range(12)]
    texts = ["".join(rng.choice(passages)[rng.randint(0, 10) :] if rng.random() < 0.5 else "".join(rng.choice("klmnop ") for _ in range(rng.randint(0, 90))) for _ in range(rng.randint(0, 6))) for _ in range(120)]
    texts[60] = texts[10]
    texts[61] = "ab" * 300
    texts[62] = "xx" + "ab" * 100
    assert result(helpers.docs(spark, texts)) == plain([(k, t.encode()) for k, t in enumerate(texts)])


def test_awkward_documents(spark):
    df = helpers.awkward(spark)
    assert result(df) == plain([(i, (t or "").encode()) for i, t, *_ in helpers.ROWS])
    assert sd.remove_repeats(helpers.empty(spark)).count() == 0


def test_only_short_texts(spark):
    texts = ["short", "", "short", "also short"]
    assert result(helpers.docs(spark, texts)) == plain([(k, t.encode()) for k, t in enumerate(texts)])


def test_a_line_that_a_third_of_the_documents_share(spark, monkeypatch):
    """Its borders have other neighbours in each document: no part gathers them all under one name."""
    monkeypatch.setattr(sd, "RUN_BYTES", 20_000)
    monkeypatch.setattr(sd, "HOT", 20)
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    line = "This line of some seventy letters stands in every third document of all."
    texts = [f"{words(4)} {line if k % 3 == 0 else words(9)} {words(5)}" for k in range(900)]
    df = helpers.docs(spark, texts)
    assert result(df) == plain([(k, t.encode()) for k, t in enumerate(texts)])
    sizes = []

    def spied(batches):
        for _, rows in sd.groups(batches, 1):
            yield sd.rows_of([(str(len({x for x, *_ in sd.merge([(p[1], p[2], p[3].tobytes()) for p in (sd.unpack(blob, 6) for _, blob in rows)])})), b"")], {"run": sd.pa.string(), "told": sd.pa.binary()})

    monkeypatch.setattr(sd, "_repeats", spied)
    monkeypatch.setattr(sd, "_cut", lambda batches, folder: (sd.rows_of([(int(r), b"", 0, 0, 0) for r in b.column(0).to_pylist() if r.isdigit()], {"doc_id": sd.pa.int64(), "kept": sd.pa.binary(), "n_bytes": sd.pa.int64(), "n_removed": sd.pa.int64(), "n_spans": sd.pa.int64()}) for b in batches))
    sizes = [r.doc_id for r in sd.remove_repeats(df).collect()]
    assert max(sizes) < 100, sorted(sizes)[-5:]


def test_a_name_that_is_hot_in_one_run():
    n = 200_000
    names, _, kinds = sd._distinct(np.full(n, 7, np.uint64), np.arange(n), np.arange(n).astype(np.uint64))
    assert names.tolist() == [7] and kinds.tolist() == [n] and n > sd.HOT
    blob = sd._by_part(1, "r", names, np.array([True]), kinds)[0]
    told = next(iter(sd._repeated_names(sd.HOT)([sd.rows_of([blob], sd._NAMES)])))
    assert sd.unpack_sorted(told.column("hot")[0].as_py()).tolist() == [7] and not len(sd.unpack_sorted(told.column("names")[0].as_py()))
