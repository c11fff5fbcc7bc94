"""Awkward documents, shared by the operators' tests."""

import numpy as np
from pyspark.sql import functions as F

LONG = " ".join(f"w{k % 977}" for k in range(60_000))
WORDS = "der Hund lief schnell durch den alten Wald und fand dort einen Stock aus Holz neben dem Bach am Rand"
ROWS = [
    (1, WORDS, "de", "a"), (2, None, None, None), (3, "", "en", "a"), (4, LONG, "en", "a"), (5, WORDS, "de", "b"), (5, WORDS, "de", "b"), (None, WORDS, None, "a"),
    (7, " \t\n ", "en", None), (8, "żółć ▁ 🎉 x@y.zz", "pl", "a"), (9, "one two", None, "a"), (10, "a" * 5000, "en", "a"),
]


def awkward(spark):
    """Nulls, empty, long and repeated texts, and columns whose names operators use inside."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    extra = ["digest", "keys", "n", "u", "key", "score", "features", "spans", "terms", "run", "part", "id", "ids", "start", "centre", "__text", "media"]
    return df.select("*", F.length("text").cast("long").alias("n_chars"), *[F.lit("clash").alias(c) for c in extra]).repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)


def thue_morse(n, zero="a", one="b"):
    """Two words of n letters that any polynomial modulo 2^64 takes for one another when n is 1,024 or more."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join((zero, one)[b] for b in bits), "".join((one, zero)[b] for b in bits)


def colliding():
    """Texts that differ in one long word only, or only in how often a pattern repeats."""
    out = []
    for n in (1024, 2048, 4096):
        out += [f"{w} w x y z" for w in thue_morse(n)]
    return out + [f"{'ab' * k} w x y z" for k in (32, 33, 500, 501)] + [f"{'a' * k} w x y z" for k in (63, 64, 65, 66, 1000)] + ["\x00 w x y z", "\x00\x00 w x y z"]


def joined(texts):
    """The texts' bytes end to end, and their offsets."""
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
