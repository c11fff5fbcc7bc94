import math
import os
import tracemalloc
import zlib

import helpers
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenloom.llm import langid

SF = "/root/testdata/sf0.01"


def test_windows_cover_all_bytes():
    data = np.arange(1000, dtype=np.int64).astype(np.uint8)
    offsets = np.array([0, 0, 300, 300, 1000])
    parts = list(langid.windows(data, offsets, 2))
    assert [len(p[0]) for p in parts] == [2, 2, 1]
    x, row, length = (np.concatenate(p) for p in zip(*parts))
    assert row.tolist() == [1, 1, 3, 3, 3] and length.sum() == 1000
    assert np.concatenate([w[:n] for w, n in zip(x, length)]).tolist() == data.tolist() and not x[1, 44:].any()


def test_a_very_long_text_takes_little_memory():
    data = np.zeros(40_000_000, np.uint8)
    tracemalloc.start()
    assert sum(len(x) for x, _, _ in langid.windows(data, np.array([0, len(data)]))) == -(-len(data) // langid.WINDOW)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000


def test_joined_tables_give_the_same_responses():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (20, langid.WINDOW), dtype=np.uint8)
    net = langid.train(x, np.arange(20) % 2, ["a", "b"], epochs=1)
    plain = langid.ByteConv(net.languages, net.filters, net.bias, net.weight, net.offset)
    assert np.allclose(net.pooled(x), plain.pooled(x), atol=1e-4)
    for w in langid.WIDTHS:
        direct = np.array([[sum(net.filters[w][k][x[0, t + k]] for k in range(w)) for t in range(langid.WINDOW - w + 1)]])
        assert np.allclose(plain._responses(x[:1], w), direct, atol=1e-4)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.predict(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[[zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    # languages of the held-out fold change nothing
    hidden = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0, F.col("lang")))
    again = langid.predict(docs, langid.fit(hidden)).toPandas().set_index("doc_id").lang_pred
    assert (again.sort_index() == got.set_index("doc_id").lang_pred.sort_index()).all()


def test_awkward_documents(spark):
    df = helpers.awkward(spark)
    got = langid.predict(df, langid.fit(df)).collect()
    assert len(got) == df.count()
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (2, 3, 7)} == {("und", 0.0)}
    assert {r.lang_pred for r in got if r.doc_id not in (2, 3, 7)} <= {"de", "en", "pl"}
    none = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.predict(none, langid.fit(none)).collect()} == {"und"}
    assert langid.predict(helpers.empty(spark), langid.fit(helpers.empty(spark))).count() == 0


def plain_prediction(net, text):
    """Language and score by loops: every window, filter and place on its own."""
    raw = text.encode()
    totals, size = [0.0] * len(net.languages), len(raw)
    for lo in range(0, size, langid.WINDOW):
        window = raw[lo : lo + langid.WINDOW]
        padded = window + bytes(langid.WINDOW - len(window))
        hidden = []
        for w in langid.WIDTHS:
            for f in range(langid.FILTERS):
                top = max(sum(float(net.filters[w][k][padded[p + k]][f]) for k in range(w)) for p in range(langid.WINDOW - w + 1))
                hidden.append(max(0.0, top + float(net.bias[len(hidden)])))
        z = [sum(h * float(net.weight[k][c]) for k, h in enumerate(hidden)) + float(net.offset[c]) for c in range(len(net.languages))]
        norm = max(z) + math.log(sum(math.exp(x - max(z)) for x in z))
        totals = [t + (x - norm) * len(window) for t, x in zip(totals, z, strict=True)]
    mean = [t / size for t in totals]
    best = mean.index(max(mean))
    return net.languages[best], math.exp(mean[best]) / sum(map(math.exp, mean))


def test_a_whole_text_by_loops(spark):
    said = {"de": "der Hund lief durch den Wald und fand einen Stock ", "en": "the dog ran through the wood and found a stick ", "es": "el perro corría por el bosque y halló un palo "}
    rng = np.random.default_rng(4)
    learn = [(k, lang, " ".join(rng.permutation(said[lang].split() * 6))) for k, lang in enumerate(sorted(said) * 30)]
    net = langid.fit(spark.createDataFrame(learn, "doc_id long, lang string, text string"))
    texts = [said["de"] * 14, said["en"], said["es"] * 9 + said["en"] * 3, "ñ", "x" * 257]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(helpers.docs(spark, texts), net).collect()}
    for k, text in enumerate(texts):
        lang, score = plain_prediction(net, text)
        assert got[k][0] == lang and abs(got[k][1] - score) < 1e-3, (k, got[k], lang, score)
    assert got[0][0] == "de" and got[1][0] == "en" and got[2][0] == "es"
