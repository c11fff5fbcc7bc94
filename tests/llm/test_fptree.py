import math
import random
import re

import helpers
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenloom.llm import fptree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, items, count=fptree.COUNT):
    """(item, rank, document, score), by the formula for every document."""
    bags = [(i, terms(t)) for i, t in rows]
    docs, total = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    df = {t: sum(t in set(b) for _, b in bags) for t in set().union(*asked.values())} if asked else {}
    out = []
    for item, wanted in asked.items():
        found = []
        for i, bag in bags:
            if i is None:
                continue
            score = 0
            for t in wanted:
                if tf := bag.count(t):
                    m = 100 - 50 + (50 * len(bag) * docs) // total
                    score += math.floor(1000 * math.log((2 * docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                found.append((-score, i))
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(found)[:count])]
    return sorted(out)


def result(spark, rows, items, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(tuple(r) for r in fptree.rank(docs, spark.createDataFrame(items, "item_id long, text string"), **more).collect())


def corpus(rng, n):
    words = [f"{'aeiou'[k % 5]}{k}" for k in range(300)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.2:
            out.append(rng.choice(out))
        else:
            out.append(" ".join(words[min(299, int(rng.expovariate(0.02)))].upper() for _ in range(rng.choice([0, 1, 5, 40, 200]))))
    return out


@pytest.mark.parametrize(("leaf", "tree"), [(2, 600), (8, 10**6)])
def test_random_documents(spark, monkeypatch, leaf, tree):
    monkeypatch.setattr(fptree, "LEAF", leaf)
    monkeypatch.setattr(fptree, "TREE", tree)
    rng = random.Random(leaf)
    rows, items = list(enumerate(corpus(rng, 250))), list(enumerate(corpus(rng, 12)))
    assert result(spark, rows, items, count=7) == plain(rows, items, 7)
    monkeypatch.setattr(fptree, "INDEX_BYTES", 500)
    assert result(spark, rows, items) == plain(rows, items)


def _tree(rng, n, n_words, leaf):
    bags = [sorted(rng.sample(range(n_words), rng.randint(1, 9)), key=lambda w: w) for _ in range(n)]
    bags += [bags[0]] * 20
    tfs = [[rng.randint(1, 5) for _ in b] for b in bags]
    m = np.array([rng.randint(50, 200) for _ in bags])
    at = np.cumsum([0, *map(len, bags)])
    tree = fptree.Tree(np.arange(len(bags)), m, at, np.array(sum(bags, [])), np.array(sum(tfs, [])), np.arange(n_words))
    return tree, bags, tfs, m


def test_bounds_hold_and_branches_are_left(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(fptree, "LEAF", 4)
    scored, every = 0, 0
    for _ in range(40):
        tree, bags, tfs, m = _tree(rng, 300, 30, 4)
        words = np.array(sorted(rng.sample(range(30), 6)))
        w = np.array([rng.choice([1, 5, 4000]) for _ in words])
        plain_score = [sum(int(w[list(words).index(t)]) * (1000000000 * tf // (1000 * tf + 20 * int(m[k]))) for t, tf in zip(b, f, strict=True) if t in words) for k, (b, f) in enumerate(zip(bags, tfs, strict=True))]
        for k, (lo, hi) in enumerate(tree.ranges):
            bound = int((w * fptree.saturation(tree.node_max[k, words].astype(np.int64), tree.node_m[k])).sum())
            assert bound >= max(plain_score[i] for i in tree.ids[lo:hi].tolist())
            prefix = [tuple(bags[i]) for i in tree.ids[lo:hi].tolist()]
            assert prefix == sorted(prefix)
        assert sorted(x for own in tree.own for r in own for x in range(*tree.runs[r])) == list(range(len(bags)))
        want = sorted(((-s, k) for k, s in enumerate(plain_score) if s > 0))[:3]
        table = np.zeros(30, np.int64)
        calls = []
        monkeypatch.setattr(fptree, "saturation", lambda tf, m, keep=fptree.saturation: calls.append(len(np.atleast_1d(tf))) or keep(tf, m))
        assert tree.search(words, w, table, 3) == [(-s, k) for s, k in want] and not table.any()
        monkeypatch.undo()
        monkeypatch.setattr(fptree, "LEAF", 4)
        scored, every = scored + len(calls), every + 1 + 2 * len(tree.runs)
    assert scored < 0.6 * every


def test_words_that_share_a_key():
    words = [w.encode() for t in helpers.colliding() for w in t.split(" ")]
    known = sorted(set(words[::2]))
    vocabulary = fptree.Terms(known)
    vocabulary.keys[:] = vocabulary.keys[0]  # all keys alike: bytes must decide
    text = b" ".join(words)
    n, row, word, tf = fptree.Terms(known).count(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    want = {w: words.count(w) for w in known if b"\x00" not in w}
    assert {k: v for k, v in zip([fptree.Terms(known).words[k] for k in word], tf.tolist(), strict=True) if b"\x00" not in k} == want


def test_awkward_documents(spark):
    df = helpers.awkward(spark)
    rows = [(i, t) for i, t, *_ in helpers.ROWS]
    items = [(1, "Hund WALD wald"), (2, None), (3, ""), (4, "..."), (5, "w1 w2 w3 nowhere"), (5, "stock"), (None, "hund"), (6, "aaaa"), (7, "żółć 🎉 x"), (8, helpers.LONG), (9, "hund wald"), (10, "nowhere at all")]
    asked = spark.createDataFrame(items, "item_id long, text string").select("*", *[F.lit("clash").alias(c) for c in ("item", "rank", "score", "doc_id", "words")])
    assert sorted(tuple(r) for r in fptree.rank(df, asked).collect()) == plain(rows, items)
    assert fptree.rank(helpers.empty(spark), asked).count() == 0
    assert fptree.rank(df, asked.limit(0)).count() == 0
    assert fptree.rank(df, asked).columns == ["item_id", "rank", "doc_id", "score"]


def test_large_measures_do_not_overflow():
    n = np.array([0, 1, 10**7])
    assert fptree.measures(n, 10**12, 10**14).tolist() == [50 + 50 * int(x) * 10**12 // 10**14 for x in n.tolist()]
