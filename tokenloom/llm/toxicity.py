"""Toxicity scores from boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of a fixed insult lexicon (plain and after undoing letter substitutions) and of a
lexicon learned from the labels, how near the hits are to second-person words, shares of capitals and punctuation,
obfuscation rates, repetition.

Everything is fitted on about SAMPLE labelled rows at most (those whose hash of doc_id is under a cut) outside the
held-out fold, crc32(doc_id) mod 5 = 0. The learned lexicon holds words and word beginnings that stand in far more toxic
than clean documents of the sample; the trees see each sampled document through the lexicon of the other half of the
sample, so they do not trust it beyond what holds on unseen rows. Fold 1 only calibrates. A doc_id with several labels
has their maximum. Null and empty texts have all features 0 and get the score of that point. Without labels of both
classes every score is the share of toxic labels, or 0 without labels. Repeated rows get equal scores; of rows that share a
doc_id the least text is learned from. Texts of any length are read whole, one after another; extra columns do not matter; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Isotonic, Trees
from .common import drop, materialise, releasing, small_batches, texts

#: Labelled rows that the model is fitted on, at most (the cut by hash holds it to within a few hundredths).
SAMPLE = 20_000
#: A learned key stands in this share of the toxic sample at least, and in no fewer than LEAST of its documents.
SHARE, LEAST = 0.004, 3
#: How far, in log-odds, a learned key leans to toxic documents, after one standard error is taken off.
LEAN = 1.5
STEM = 5

LEXICON = frozenset(
    "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass loser losers clown clowns pathetic trash scum "
    "scumbag worthless disgusting garbage filth filthy vermin imbecile imbeciles retard retarded bastard bastards bitch "
    "asshole jerk creep freak fool fools foolish ugly hate hateful despicable vile repulsive crap shit fuck fucking damn "
    "shutup kys "
    "idiota imbécil estúpido estúpida basura asqueroso escoria payaso patético perdedor tonto "
    "dumm dummkopf blöd blödmann arschloch abschaum wertlos erbärmlich widerlich versager trottel "
    "imbécile stupide crétin crétine ordure minable pathétique dégoûtant connard débile nul".split()
)
SECOND_PERSON = frozenset("you your yours yourself youre u ur du dich dir dein deine ihr tu te toi ton ta tes vous votre tú usted ustedes".split())
#: Signs used in place of letters.
SUBSTITUTES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, "#": None, "_": None, ".": None, "-": None})
NEAR = 5
FEATURES = ("words", "hits", "hit_share", "distinct_share", "masked_hits", "masked_share", "near_you", "you_share", "capitals", "upper_words", "punctuation", "exclamations", "mixed_words", "repeated", "mean_length", "learned_hits", "learned_share", "learned_weight", "learned_top", "stem_hits", "stem_share", "stem_weight", "stem_top")

_EDGES = "\"'“”‘’«»()[]{}<>,;:.?!…|%&*#$"
_ODD = re.compile(r"[a-zA-Z][0-9@$*#][a-zA-Z0-9@$*#]*[a-zA-Z]|\b(?:[a-zA-Z][.\-_*]){2,}[a-zA-Z]\b")
_PUNCT = re.compile(r"[^\w\s]")
_UPPER = re.compile(r"[A-Z]")


def keys(text: str) -> dict[str, list[str]]:
    """The distinct lower-case words of a text, without signs at their edges, each with its lexicon keys."""
    out = {}
    for w in set(text.lower().split()):
        bare = w.strip(_EDGES)
        if 2 < len(bare) < 40:
            out[w] = [bare, f"{bare[:STEM]}~"] if len(bare) > STEM else [bare]
    return out


def _learned(kinds: set[str], lower: list[str], lexicon: dict[str, float]) -> list[float]:
    hits: dict[str, float] = {}
    stems: dict[str, float] = {}
    for w in kinds:
        bare = w.strip(_EDGES)
        if (x := lexicon.get(bare)) is not None:
            hits[w] = x
        if len(bare) > STEM and (x := lexicon.get(f"{bare[:STEM]}~")) is not None:
            stems[w] = x
    out = []
    for found in (hits, stems):
        n = sum(w in found for w in lower) if found else 0
        out += [float(n), n / len(lower), sum(found.values()), max(found.values(), default=0.0)]
    return out


def features(text: str, lexicon: dict[str, float] | None = None) -> list[float]:
    """One value for each of FEATURES."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    lower = text.lower().split()
    kinds = set(lower)
    plain: dict[str, bool] = {}
    masked: set[str] = set()
    you: set[str] = set()
    for w in kinds:
        bare = w.strip(_EDGES)
        if bare in LEXICON:
            plain[w] = True
        elif not bare.isalpha() and len(bare) > 2 and bare.translate(SUBSTITUTES) in LEXICON:
            masked.add(w)
        if bare in SECOND_PERSON:
            you.add(w)
    hits = hidden = near = seconds = 0
    if plain or masked:
        at = [k for k, w in enumerate(lower) if w in plain or w in masked]
        hidden = sum(lower[k] in masked for k in at) if masked else 0
        hits = len(at) - hidden
        if you:
            second = np.array([k for k, w in enumerate(lower) if w in you])
            seconds = len(second)
            where = np.array(at)
            right = np.searchsorted(second, where)
            gap = np.minimum(np.abs(second[np.minimum(right, seconds - 1)] - where), np.abs(second[np.maximum(right - 1, 0)] - where))
            near = int((gap <= NEAR).sum())
    elif you:
        seconds = sum(w in you for w in lower)
    size = len(text)
    return [
        float(np.log1p(n)), float(hits), hits / n, len(plain) / n, float(hidden), hidden / n, near / n, seconds / n,
        len(_UPPER.findall(text)) / size, sum(map(str.isupper, words)) / n, len(_PUNCT.findall(text)) / size, text.count("!") / size,
        len(_ODD.findall(text)) / n, 1 - len(kinds) / n, size / n, *_learned(kinds, lower, lexicon or {}),
    ]


def half(doc_id: str) -> int:
    return zlib.crc32(f"half {doc_id}".encode()) & 1


def fold(doc_id: str) -> int:
    return zlib.crc32(doc_id.encode()) % 5


def sample_of(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text_col: str = "text") -> DataFrame:
    """(doc_id, text, toxic) of at most about `sample` labelled documents outside the held-out fold, as a written table."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    n = known.count()
    if n > sample:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * sample / n))
    # no more than about `sample` rows of two numbers, so each executor may hold them all
    joined = docs.select("doc_id", F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id")
    # rows that share a doc_id count once, so the sample is no larger than the labels it was drawn from
    return materialise(joined.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("toxic").alias("toxic")), "toxicity-sample")


def lexicons(sample: DataFrame) -> tuple[dict[str, float], dict[str, float], dict[str, float]]:
    """The learned lexicons of half 0, of half 1 and of the whole sample."""
    small_batches(sample.sparkSession)

    def count(batches):
        for b in batches:
            counts: dict[str, list[int]] = {}
            for i, t, toxic in zip(b.column(0).to_pylist(), texts(b, "text"), b.column(2).to_pylist(), strict=True):
                at = 2 * half(str(i)) + (toxic > 0)
                for k in {k for ks in keys(t).values() for k in ks} | {""}:
                    counts.setdefault(k, [0, 0, 0, 0])[at] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string())] + [pa.array([c[k] for c in counts.values()], pa.int64()) for k in range(4)], names=["key", "c0", "t0", "c1", "t1"])

    counted = sample.select("doc_id", "text", "toxic").mapInArrow(releasing(count), "key string, c0 long, t0 long, c1 long, t1 long")
    summed = counted.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")])
    # only keys that may reach the thresholds in some lexicon come back, and the totals under the empty key; the sample
    # bounds their number
    totals = summed.filter("key = ''").first()
    if totals is None:
        return {}, {}, {}
    toxic, clean = F.col("t0") + F.col("t1"), F.col("c0") + F.col("c1")
    log_odds = lambda t, c: F.log((t + 0.5) / (totals["t0"] + totals["t1"] + 1)) - F.log((c + 0.5) / (totals["c0"] + totals["c1"] + 1))
    # a half's lean can exceed the whole's, so the cut here is below LEAN
    near = (toxic >= LEAST) & (2 * toxic >= toxic + clean) & (log_odds(toxic, clean) > 0)
    rows = summed.filter(near | (F.col("key") == "")).orderBy((F.col("key") == "").desc(), "key").toPandas()
    c = rows[["c0", "t0", "c1", "t1"]].to_numpy(float)
    out = []
    for clean, toxic in ((c[:, 0], c[:, 1]), (c[:, 2], c[:, 3]), (c[:, 0] + c[:, 2], c[:, 1] + c[:, 3])):
        found = {}
        if len(rows) and toxic[0]:
            odds = np.log((toxic + 0.5) / (toxic[0] + 1)) - np.log((clean + 0.5) / (clean[0] + 1))
            sure = odds - np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
            good = (sure > LEAN) & (toxic >= max(LEAST - (len(out) < 2), SHARE * toxic[0]))
            good[0] = False
            found = {k: round(float(x), 3) for k, x, ok in zip(rows["key"], odds, good, strict=True) if ok}
        out.append(found)
    return out[0], out[1], out[2]


Model = tuple[Trees, Isotonic, dict[str, float]]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text_col: str = "text") -> Model:
    """Trees, calibration and lexicon from the labelled sample."""
    known = sample_of(docs, labels, sample, text_col)
    by_half = lexicons(known)

    def featurise(batches):
        for b in batches:
            ids = [str(i) for i in b.column(0).to_pylist()]
            rows = [features(t, by_half[1 - half(i)]) for i, t in zip(ids, texts(b, "text"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(2).cast(pa.int32()), pa.array(rows, pa.list_(pa.float32()))], names=["doc_id", "toxic", "features"])

    rows = known.select("doc_id", "text", "toxic").mapInArrow(releasing(featurise), "doc_id string, toxic int, features array<float>").toPandas()
    drop(known)
    rows = rows.sort_values("doc_id", kind="stable")
    y = (rows["toxic"].to_numpy(float) > 0).astype(float)
    x = np.array(rows["features"].tolist(), np.float64).reshape(-1, len(FEATURES))
    tuned = np.array([fold(d) == 1 for d in rows["doc_id"]], bool)
    model, scale = Trees(), Isotonic()
    if len(set(y[~tuned])) < 2 or len(set(y[tuned])) < 2:
        scale.at, scale.value = np.zeros(1), np.full(1, y.mean() if len(y) else 0.0)
        model.edges = [np.zeros(1)] * len(FEATURES)
        return model, scale, by_half[2]
    model.fit(x[~tuned], y[~tuned])
    return model, scale.fit(model.log_odds(x[tuned]), y[tuned]), by_half[2]


def rate(rows: list[str], model: Model) -> np.ndarray:
    """Calibrated probabilities of the texts."""
    trees, scale, lexicon = model
    return scale.predict(trees.log_odds(np.array([features(t, lexicon) for t in rows], np.float64).reshape(-1, len(FEATURES))))


def score(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The kept columns, `score` between 0 and 1 and `predicted`."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text_col=text_col))

    def run(batches):
        for b in batches:
            p = rate(texts(b, "__text"), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(len(keep))] + [pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["score double", "predicted int"])
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(releasing(run), schema)


def reject(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    small_batches(docs.sparkSession)
    names = tuple(docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text_col=text_col))
    at = names.index(text_col)

    def run(batches):
        for b in batches:
            p = rate([t or "" for t in b.column(at).to_pylist()], shared.value)
            yield b.filter(pa.array(p < 0.5))

    renamed = docs.toDF(*[f"__{k}" for k in range(len(names))])
    return renamed.mapInArrow(releasing(run), renamed.schema).toDF(*names)
