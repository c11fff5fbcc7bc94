import math
import os
import random
import re

import helpers
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenloom.llm import toxicity
from tokenloom.llm.boosting import Isotonic, Trees

SF = "/root/testdata/sf0.01"


def auc(score, y):
    pos, neg = score[y == 1], score[y == 0]
    return ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()) if len(pos) and len(neg) else 1.0


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = Trees().fit(x[:2000], y[:2000])
    assert auc(model.log_odds(x[2000:]), y[2000:]) > 0.97
    one = Trees().fit(np.zeros((50, 2)), np.arange(50) % 2 * 1.0)
    assert np.allclose(one.log_odds(np.zeros((3, 2))), 0, atol=0.1)


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(1)
    s = rng.random(200)
    y = (rng.random(200) < s**2).astype(float)
    iso = Isotonic().fit(s, y)
    p = iso.predict(np.sort(s))
    assert (np.diff(p) >= 0).all() and p.min() > 0 and p.max() < 1
    assert ((iso.predict(s) - y) ** 2).mean() < ((y.mean() - y) ** 2).mean()
    assert Isotonic().fit(np.zeros(0), np.zeros(0)).predict(np.array([1.0]))[0] == 0.5


def test_features():
    name = dict(zip(toxicity.FEATURES, range(99)))
    f = toxicity.features("You are an IDIOT! st*pid m0ron l.o.s.e.r")
    assert f[name["hits"]] == 1 and f[name["masked_hits"]] >= 1 and f[name["you_share"]] > 0 and f[name["near_you"]] > 0
    assert toxicity.features("") == toxicity.features(" \n ") == [0.0] * len(toxicity.FEATURES)
    assert toxicity.features("foo bar", {"foo": 2.0})[name["learned_weight"]] == 2.0


def labelled(spark, n=900):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for k in range(n):
        toxic = rng.random() < 0.25
        text = rng.choices(words, k=rng.randint(5, 60))
        if toxic:
            text += rng.choices(["grobulak", "snarfik", "idiot", "scum"], k=3)
        rng.shuffle(text)
        rows.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_and_made_up_insults(spark):
    docs, labels = labelled(spark)
    got = toxicity.score(docs, labels).join(labels, "doc_id").toPandas()
    held = got[[toxicity.fold(str(d)) == 0 for d in got.doc_id]]
    assert auc(held.score.to_numpy(), held.toxic.to_numpy()) > 0.97
    assert ((got.score >= 0.5) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    kept = {r.doc_id for r in toxicity.reject(docs, labels).collect()}
    assert kept == set(got.doc_id[got.predicted == 0])
    # labels of the held-out fold change nothing
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.score(docs, flipped).toPandas().set_index("doc_id").score
    assert np.allclose(again.sort_index(), got.set_index("doc_id").score.sort_index())


def test_sample_is_bounded(spark):
    docs, labels = labelled(spark)
    assert 60 < toxicity.sample_of(docs, labels, 100).count() < 140


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_driver_tables(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.score(spark.read.parquet(f"{SF}/documents.parquet"), labels).join(labels, "doc_id").toPandas()
    held = got[[toxicity.fold(str(d)) == 0 for d in got.doc_id]]
    assert auc(held.score.to_numpy(), held.toxic.to_numpy()) > 0.85


def test_awkward_documents(spark):
    df = helpers.awkward(spark)
    labels = spark.createDataFrame([(1, 1, "x"), (1, 0, "x"), (2, None, "x"), (None, 1, "x"), (9, 0, "x")], "doc_id long, toxic int, text string")
    got = toxicity.score(df, labels)
    assert got.count() == df.count() and got.filter("score is null or score < 0 or score > 1").count() == 0
    out = toxicity.reject(df, labels.limit(0))
    assert out.columns == df.columns and out.count() == df.count()
    assert toxicity.score(helpers.empty(spark), labels).count() == 0


def plain_features(text, lexicon):
    """Each of FEATURES by its description, word by word."""
    words, lower = text.split(), text.lower().split()
    n = len(words)
    if not n:
        return [0.0] * len(toxicity.FEATURES)
    bare = [w.strip("\"'“”‘’«»()[]{}<>,;:.?!…|%&*#$") for w in lower]
    hit = [b in toxicity.LEXICON for b in bare]
    masked = [not h and not b.isalpha() and len(b) > 2 and b.translate(toxicity.SUBSTITUTES) in toxicity.LEXICON for b, h in zip(bare, hit, strict=True)]
    you = [k for k, b in enumerate(bare) if b in toxicity.SECOND_PERSON]
    bad = [k for k in range(n) if hit[k] or masked[k]]
    near = sum(any(abs(a - k) <= toxicity.NEAR for a in you) for k in bad)
    whole = [lexicon.get(b) for b in bare]
    stem = [lexicon.get(f"{b[: toxicity.STEM]}~") if len(b) > toxicity.STEM else None for b in bare]

    def learned(values):
        found = {w: v for w, v in zip(lower, values, strict=True) if v is not None}
        return [float(sum(v is not None for v in values)), sum(v is not None for v in values) / n, sum(found.values()), max(found.values(), default=0.0)]

    size = len(text)
    return [
        math.log(1 + n), float(sum(hit)), sum(hit) / n, len({w for w, h in zip(lower, hit, strict=True) if h}) / n, float(sum(masked)), sum(masked) / n, near / n, len(you) / n,
        sum("A" <= c <= "Z" for c in text) / size, sum(w.isupper() for w in words) / n, sum(not (c.isalnum() or c.isspace() or c == "_") for c in text) / size, text.count("!") / size,
        len(re.findall(r"[a-zA-Z][0-9@$*#][a-zA-Z0-9@$*#]*[a-zA-Z]|\b(?:[a-zA-Z][.\-_*]){2,}[a-zA-Z]\b", text)) / n, 1 - len(set(lower)) / n, size / n, *learned(whole), *learned(stem),
    ]


def plain_score(text, model):
    """The score of a text: its features, each tree walked by its cuts, and the line between the calibrated points."""
    trees, scale, lexicon = model
    x = plain_features(text, lexicon)
    total = trees.base
    for on, cut, value in trees.trees:
        node = 0
        while node < len(on):
            edges = trees.edges[on[node]]
            node = 2 * node + 1 + bool(cut[node] < len(edges) and edges[cut[node]] < x[on[node]])
        total += value[node - len(on)]
    at, p = scale.at.tolist(), scale.value.tolist()
    if total <= at[0]:
        return p[0]
    k = max(i for i, a in enumerate(at) if a <= total)
    return p[k] if k + 1 == len(at) else p[k] + (p[k + 1] - p[k]) * (total - at[k]) / (at[k + 1] - at[k])


def plain_isotonic(score, y):
    """Non-decreasing values by their definition: at each point the greatest over the left ends of the least mean over the right ends."""
    at = sorted(set(score))
    means = lambda a, b: sum(v for s, v in zip(score, y, strict=True) if at[a] <= s <= at[b]) / sum(at[a] <= s <= at[b] for s in score)
    return at, [max(min(means(a, b) for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))]


def test_whole_scores_by_loops(spark):
    rng = random.Random(9)
    bad, good = ["zorg", "blarghed", "idiot", "st0pid", "1diot", "you", "du", "SHUT-UP", "f.o.o.l", "blarghing"], ["tree", "Hill", "water", "stone", "walked", "über", "you", "(sun)"]
    rows = [(k, " ".join(rng.choice(bad if k % 3 == 0 and rng.random() < 0.4 else good) + rng.choice(["", "!", ",", ""]) for _ in range(rng.randint(1, 30)))) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model[2] and len(model[0].trees) == model[0].rounds
    texts = [t for _, t in rows[:120]] + ["", "you idiot, you 1diot! " * 40, helpers.LONG[:3000]]
    for text, p in zip(texts, toxicity.rate(texts, model).tolist(), strict=True):
        assert np.allclose(toxicity.features(text, model[2]), plain_features(text, model[2]), atol=1e-12), text
        assert abs(p - plain_score(text, model)) < 1e-9, text


def test_isotonic_by_its_definition():
    rng = random.Random(5)
    for _ in range(30):
        score = [rng.randint(0, 12) for _ in range(rng.randint(1, 30))]
        y = [float(rng.random() < s / 15) for s in score]
        at, values = plain_isotonic(score, y)
        got = Isotonic().fit(np.array(score, float), np.array(y))
        pools = [[v, [a]] for v, a in zip(values, at, strict=True)]
        merged = []
        for v, (a,) in pools:
            if merged and abs(merged[-1][0] - v) < 1e-12:
                merged[-1][1].append(a)
            else:
                merged.append([v, [a]])
        want, least = [], 0.0
        for v, members in merged:
            w = sum(s in members for s in score)
            least = max(least, (v * w + 0.5) / (w + 1))
            want.append((members[0], least))
        assert np.allclose(got.at, [a for a, _ in want]) and np.allclose(got.value, [v for _, v in want])
