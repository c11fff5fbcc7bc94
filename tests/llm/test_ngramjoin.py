import random
import re

import helpers
import numpy as np
import pytest
from tokenloom.llm import ngramjoin as nj
from tokenloom.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain(rows):
    """doc id -> (n, component), from all pairs."""
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    names = sorted(sets)
    for a in names:
        for b in names:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (sorted(len(s) for s in sets[i]), find(i)) for i in names}


def result(df):
    out = {}
    for r in nj.classes(df).collect():
        sizes, component = out.setdefault(r.doc_id, ([], r.component_id))
        sizes.append(r.n_shingles)
        assert component == r.component_id
    return {i: (sorted(n), c) for i, (n, c) in out.items()}


def test_tree_finds_what_comparing_all_finds():
    rng = random.Random(1)
    for _ in range(150):
        sets = []
        for _ in range(rng.randint(1, 14)):
            base = set(rng.choice(sets)[1]) if sets and rng.random() < 0.6 else set()
            base = {x for x in base if rng.random() < 0.95} | {rng.randrange(60) for _ in range(rng.randint(0, 4))} or {1}
            sets.append((len(sets), sorted(base), rng.randint(0, 2)))
        tree = nj.PrefixTree()
        for name, keys, more in sets:
            tree.add(name, len(keys) + more, np.array(keys, np.uint64))
        for _, keys, more in sets:
            n = len(keys) + more
            want = sorted(b for b, ks, m in sets if 100 * (o := len(set(keys) & set(ks))) >= 75 * (n + len(ks) + m - o))
            assert sorted(tree.partners(n, np.array(keys, np.uint64), lambda _: False)) == want


def edited(rng, words, share):
    return [rng.choice("pqrst") * 3 if rng.random() < share else w for w in words]


def corpus(rng, n=150):
    passage = [f"p{k}" for k in range(40)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.55:
            words = edited(rng, rng.choice(texts).split(), rng.choice([0, 0.01, 0.02, 0.05, 0.1]))
        else:
            words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([0, 2, 4, 5, 6, 30, 80]))]
        if rng.random() < 0.3:
            words += passage
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize(("group", "run"), [(1000, 1 << 20), (3, 2000)])
def test_random_documents(spark, monkeypatch, group, run):
    monkeypatch.setattr(nj, "GROUP", group)
    monkeypatch.setattr(nj, "SIDE", 2 if group == 3 else 250)
    monkeypatch.setattr(nj, "RUN_BYTES", run)
    texts = corpus(random.Random(group))
    assert result(helpers.docs(spark, texts)) == plain(list(enumerate(texts)))


def test_components(spark):
    rng = random.Random(4)
    edges = [(a, b) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(200)) if a != b] + [(1000 + k, 1001 + k) for k in range(60)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r.u: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in up}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_awkward_documents(spark):
    df = helpers.awkward(spark)
    rows = [(i, t) for i, t, *_ in helpers.ROWS]
    got = result(df)
    assert {i: x for i, x in got.items() if i is not None} == plain([x for x in rows if x[0] is not None])
    assert got[None][1] is None and nj.classes(df).count() == df.count()
    kept = nj.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "None", "7", "8", "9", "10"])
    assert nj.classes(helpers.empty(spark)).count() == 0


def test_words_that_are_hard_to_tell_apart(spark):
    texts = helpers.colliding()
    assert result(helpers.docs(spark, texts)) == plain(list(enumerate(texts)))


def test_shingles_that_share_a_sum_of_known_word_keys(spark):
    """Made to have equal sums of unseeded word keys; each also with others around them."""
    texts = ["alphabet umbrella x y z", "kzpabndc 7`u9rwz x y z"]
    seven = lambda seed: nj.shingle_keys(*helpers.joined(texts), seed)[0].tolist()
    assert len(set(seven(0))) == len(set(seven(1))) == 2 and set(seven(0)) != set(seven(1))
    assert result(helpers.docs(spark, texts)) == plain(list(enumerate(texts)))


def test_words_of_seven_and_eight_bytes_with_one_key():
    """Without a seed a word of eight bytes can be made for one of seven; with a seed it has another key."""
    from tokenloom.llm import hashing

    data, offsets = helpers.joined(["letters "])
    with np.errstate(over="ignore"):
        mixed = [hashing.mix(np.array([n], np.uint64) * np.uint64(hashing._STEP)) for n in (7, 8)]
        other = (int(mixed[0][0]) + int.from_bytes(b"letters", "little") - int(mixed[1][0])) % 2**64
    data = np.frombuffer(b"letters " + other.to_bytes(8, "little"), np.uint8)
    starts, ends = np.array([0, 8]), np.array([7, 16])
    keys = hashing.word_keys(data, starts, ends)
    assert keys[0] == keys[1]
    assert all(len(set(hashing.word_keys(data, starts, ends, seed).tolist())) == 2 for seed in (1, 2**62 + 5))


def test_doc_ids_with_several_texts(spark):
    rng = random.Random(11)
    texts = [t for t in corpus(rng, 90) if t]
    rows = [(rng.randrange(50), t) for t in texts] + [(7, texts[3]), (7, texts[4]), (7, "of its own and nobody else has it")]
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == plain(rows)
