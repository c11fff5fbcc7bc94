import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenloom.llm import rangejoin as rj


def plain(rows, threshold=rj.THRESHOLD):
    """(id, links, component) of each row, from all pairs in double precision."""
    good = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    up = {i: i for i, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    def cosine(a, b):
        a, b = (np.array(x, np.float64) / np.abs(x).max() for x in (a, b))
        return a @ b / np.sqrt((a @ a) * (b @ b))

    links = [0] * len(rows)
    for x, (i, v) in enumerate(rows):
        for y, (j, w) in enumerate(rows):
            if x < y and i is not None and j is not None and good(v) and good(w) and len(v) == len(w) and (list(v) == list(w) or cosine(v, w) >= threshold):
                links[x], links[y] = links[x] + 1, links[y] + 1
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return sorted((str(i), n, str(None if i is None else find(i))) for (i, _), n in zip(rows, links, strict=True))


def result(spark, rows, kind="float", **more):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    got = rj.join(df, **more).collect()
    assert all(r.kept == (r.vec_id == r.component_id or r.vec_id is None) for r in got)
    return sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got)


def vectors(rng, n, d):
    """Lone vectors, tight groups, and chains whose neighbours are about the threshold apart."""
    out = []
    for _ in range(n):
        base = out[rng.integers(len(out))] if out and rng.random() < 0.7 else rng.normal(size=d)
        spread = rng.choice([0, 0.01, 0.1, 0.2, 0.33, 0.36, 1])
        noise = rng.normal(size=d)
        out.append(rng.choice([1, 0.01, 30]) * (base / np.linalg.norm(base) + spread * noise / np.linalg.norm(noise)) if spread else base)
    return [np.float32(v).tolist() for v in out]


@pytest.mark.parametrize(("d", "cell", "block"), [(3, 10, 4), (16, 20, 50), (16, 1000, 7)])
def test_random_vectors(spark, monkeypatch, d, cell, block):
    monkeypatch.setattr(rj, "CELL", cell)
    monkeypatch.setattr(rj, "BLOCK", block)
    rng = np.random.default_rng(d + cell)
    rows = list(enumerate(vectors(rng, 160, d)))
    rng.shuffle(ids := [i * 3 for i, _ in rows])
    rows = [(i, v) for i, (_, v) in zip(ids, rows, strict=True)]
    assert result(spark, rows) == plain(rows)
    if d == 3:
        assert result(spark, rows, "double", threshold=0.8) == plain(rows, 0.8)


def test_group_of_near_copies_is_not_compared(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=8)
    rows = [(k, (base + 0.02 * rng.normal(size=8)).tolist()) for k in range(300)] + [(1000 + k, rng.normal(size=8).tolist()) for k in range(40)]
    monkeypatch.setattr(rj, "CELL", 20)
    calls = []
    monkeypatch.setattr(rj, "materialise", lambda df, name, keep=rj.materialise: calls.append((name, out := keep(df, name))) or out)
    assert result(spark, rows, "double") == plain(rows)
    pairs = dict(calls)["vector-cells"].groupBy("core").count().collect()
    assert {r["core"]: r["count"] for r in pairs}[True] >= 300


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, -0.0]
    rows = [
        (1, v), (2, [1.0, 2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]), (7, [nan, 1.0, 1.0]), (8, [inf, 1.0, 1.0]), (9, [1.0, 2.0]), (10, [2.0, 4.0]),
        (11, [1e-200, 2e-200, 0.0]), (12, [1e200, 2e200, 0.0]), (13, v), (13, v), (14, [-1.0, -2.0, 0.0]), (14, v), (15, [5.0, 1.0, 9.0]), (15, [-1.0, -2.0, 0.1]), (None, v), (None, None), (16, [5.0]), (17, [7.0]), (18, [-1.0]),
    ]
    assert result(spark, rows, "double") == plain(rows)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert rj.join(none).count() == 0 and rj.deduplicate(none).columns == none.columns
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in ("digest", "raw", "cell", "core", "rep", "n", "u", "component", "__salt", "__gone"):
        df = df.withColumn(c, F.lit("clash"))
    assert rj.join(df).count() == len(rows)
    kept = rj.deduplicate(df)
    assert kept.columns == df.columns
    assert {str(r.vec_id) for r in kept.collect()} == {a for a, _, c in plain(rows) if a == c}


def test_hot_vector(spark):
    """A third of the rows are one vector: its rows are one class and look their result up in many parts."""
    rng = np.random.default_rng(3)
    rows = [(k, [1.0, 1.0, 0.0, 0.0]) for k in range(2000)] + [(5000 + k, rng.normal(size=4).tolist()) for k in range(200)]
    want = {i: (n, c) for i, n, c in plain([rows[0], *rows[2000:]])}
    got = {i: (n, c) for i, n, c in result(spark, rows, "double")}
    near = [i for i, (n, c) in got.items() if c == "0" and int(i) >= 5000]
    assert all(got[str(k)] == (1999 + want["0"][0], "0") for k in range(2000))
    assert sorted(near) == sorted(i for i, (_, c) in want.items() if c == "0" and i != "0")


def test_components_by_stars():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        i, j = rng.integers(n, size=(2, int(rng.integers(0, 30))))
        least = list(range(n))
        for _ in range(n):
            for a, b in zip(i, j, strict=True):
                least[a] = least[b] = min(least[a], least[b])
        assert rj.stars(n, i, j).tolist() == least
