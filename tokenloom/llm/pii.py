"""Information-theoretic removal of personal data.

Base detectors find addresses, IPs, card and phone numbers. A corpus pass then measures which ordinary terms give a
protected entity away although the entity itself is masked: for an entity e and a term t of the same document, however
far apart, the disclosure of e by t is PMI(t; e) / IC(e), with document frequencies over the whole corpus. It is 1 where
t occurs only where e does, and 0 where the two are independent. Terms at REMOVE or more are removed, terms at GENERALISE
or more are replaced by their word class, wherever they stand in the documents that hold the entity.

Every pair is rated; none is cut off for being rare. A pair that stands in k different texts has the share 1 - 2^-k of
its disclosure, since each further text halves the odds that it is chance. What many entities share is protected like an
entity (`protected`): the domain of an address, the first numbers of an IP, the issuer of a card, the block of a phone
number. So a term can also be told by entities that stand in one text each.

A term is removed or generalised only in texts that hold an entity which it gives away. In a text without that entity
there is nothing masked that it could tell; taking it out there too would take ordinary words out of most of the corpus.

Null texts count as empty and have no spans. Repeated rows are counted as rows for frequencies, but as one text. Texts of
any length are judged whole. Rows are judged by their text alone, so ties and extra columns do not matter; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import look_up, materialise, releasing, small_batches, texts

KINDS = ("email", "ip", "card", "phone")
GENERALISE = 0.6
#: Pairs of entities and terms that one task makes of a text, about; a text of more is split by its entities.
PAIRS = 1_000_000
REMOVE = 0.9
#: Bits of the fixed-size filter that holds the candidate terms while all documents are counted.
FILTER_BITS = 1 << 25

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"\w+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern's leftmost non-overlapping matches, but in linear time on long runs without an @."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind in the order of KINDS, then by start."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if text.isascii() and not any(c in text for c in "0123456789"):
        return out
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and _luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def entity(kind: str, value: str) -> str:
    """The protected value, alike however it is written."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else _NOT_DIGIT.sub('', value)}"


def protected(kind: str, value: str) -> list[str]:
    """The entity and its parts that other entities may share."""
    name = entity(kind, value)
    core = name.partition(":")[2]
    if kind == "email":
        parts = [("domain", core.rpartition("@")[2])]
    elif kind == "ip":
        numbers = core.split(".")
        parts = [("net", ".".join(numbers[:3])), ("net", ".".join(numbers[:2]))]
    elif kind == "card":
        parts = [("issuer", core[:6])]
    else:
        parts = [("block", core[:-4]), ("block", core[:-7])]
    return [name, *[f"{k}:{p}" for k, p in parts if p]]


def _terms(text: str) -> set[str]:
    """The distinct terms of a whole text. Words are found first and lower-cased then, since lower case can change letters into others."""
    return {w.lower() for w in set(_WORD.findall(text))}


def _words(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the words outside all base spans."""
    covered = sorted((s, e) for _, s, e in spans)
    k = end = 0
    for m in _WORD.finditer(text):
        # spans may lie in each other: what counts is how far those that began reach
        while k < len(covered) and covered[k][0] < m.end():
            end, k = max(end, covered[k][1]), k + 1
        if m.start() >= end:
            yield m.group().lower(), m.start(), m.end()


_DETECTED = "text string, spans array<struct<kind:string,s:int,e:int>>, entities array<string>, words array<string>, digest binary"


def detect(docs: DataFrame, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """The kept columns with base spans; text, entities and the distinct terms only where there is a span."""
    small_batches(docs.sparkSession)
    fields = [docs.schema[c] for c in keep]
    span_t = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32())]))

    def run(batches):
        for b in batches:
            rows = texts(b, "__text")
            spans = [base_spans(t) for t in rows]
            hit = [bool(s) for s in spans]
            columns = [b.column(k) for k in range(len(keep))] + [
                pa.array([t if h else None for t, h in zip(rows, hit, strict=True)], pa.string()),
                pa.array([[{"kind": k, "s": s, "e": e} for k, s, e in x] for x in spans], span_t),
                pa.array([sorted({n for k, s, e in x for n in protected(k, t[s:e])}) for t, x in zip(rows, spans, strict=True)], pa.list_(pa.string())),
                pa.array([sorted({w for w, _, _ in _words(t, x)}) if x else [] for t, x in zip(rows, spans, strict=True)], pa.list_(pa.string())),
                pa.array([hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() if h else None for t, h in zip(rows, hit, strict=True)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "text", "spans", "entities", "words", "digest"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [_DETECTED])
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(releasing(run), schema)


def _bits(terms: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) & (FILTER_BITS - 1) for t in terms), np.int64, len(terms))


def _term_filter(candidates: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS for the candidate terms, put together on the executors; its size never changes."""

    def run(batches):
        for b in batches:
            at = _bits(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

    words = candidates.select("term").mapInArrow(releasing(run), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out


def _term_counts(docs: DataFrame, candidates: DataFrame, text_col: str) -> DataFrame:
    """(term, n): documents that hold the term, for every candidate term, over all documents."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_term_filter(candidates))

    def run(batches):
        bits = shared.value
        seen: dict[str, bool] = {}
        for b in batches:
            counts: dict[str, int] = {}
            for t in texts(b, text_col):
                for w in _terms(t):
                    hit = seen.get(w)
                    if hit is None:
                        if len(seen) > 500_000:
                            seen.clear()
                        at = xxhash.xxh3_64_intdigest(w) & (FILTER_BITS - 1)
                        hit = seen[w] = bool((int(bits[at >> 6]) >> (at & 63)) & 1)
                    if hit:
                        counts[w] = counts.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    counted = docs.select(text_col).mapInArrow(releasing(run), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return counted.join(candidates, "term", "left_semi")


def disclosing_terms(docs: DataFrame, detected: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest, rows, term, disclosure): for each text with an entity, its terms at GENERALISE or more, and the text's rows."""
    total = docs.count()
    distinct = materialise(detected.filter(F.size("entities") > 0).groupBy("digest").agg(F.count("*").alias("rows"), F.first("entities").alias("entities"), F.first("words").alias("words")), "pii-texts")
    entities = distinct.select(F.explode("entities").alias("entity"), "digest", "rows", F.size("words").alias("words"))
    entity_n = materialise(entities.groupBy("entity").agg(F.sum("rows").alias("n_entity"), F.count("*").alias("t_entity")), "pii-entities")
    terms = distinct.select(F.explode("words").alias("term"), "digest", "rows")
    # PMI is at most log(total / n) and a pair's texts at most those of the entity and the n of the term, so its evidence is
    # at most 1 - 2^-that: what is beyond reach so is left out before it is counted. That takes all entities of one text
    def reach(n_entity, texts, n):
        return F.log(F.lit(float(max(total, 1))) / n) * (1 - F.pow(F.lit(0.5), F.least(n, texts))) >= (GENERALISE - 1e-9) * F.log(F.lit(float(max(total, 2))) / n_entity)

    known = entity_n.filter(F.log(F.lit(float(max(total, 1)))) * (1 - F.pow(F.lit(0.5), "t_entity")) >= (GENERALISE - 1e-9) * F.log(F.lit(float(max(total, 2))) / F.col("n_entity")))
    most, texts = known.agg(F.max("n_entity"), F.max("t_entity")).first()
    counted = entities.drop("rows").join(known.hint("merge"), "entity")
    # texts with an entity left, and into how many tasks their pairs are split
    split = materialise(counted.groupBy("digest").agg(F.ceil(F.count("*") * F.first("words") / F.lit(PAIRS)).cast("int").alias("tasks")), "pii-split")
    terms = terms.join(split.hint("merge"), "digest")
    term_n = materialise(_term_counts(docs, terms.select("term").distinct(), text_col).filter(reach(F.lit(float(most or 1)), F.lit(float(texts or 1)), F.col("n"))), "pii-terms")
    # the entities, far fewer than the terms, take their counts along, so pairs are not shuffled for them
    left = terms.join(term_n.hint("merge"), "term").withColumn("task", F.explode(F.sequence(F.lit(1), F.greatest("tasks", F.lit(1)))))
    right = counted.drop("words").join(split.hint("merge"), "digest").withColumn("task", (F.pmod(F.xxhash64("entity"), F.greatest("tasks", F.lit(1)).cast("long")) + 1).cast("int"))
    pairs = left.drop("tasks").join(right.drop("tasks").hint("merge"), ["digest", "task"]).filter(reach(F.col("n_entity"), F.col("t_entity"), F.col("n")))
    pairs = materialise(pairs.select("entity", "term", "digest", "rows", "n", "n_entity"), "pii-pairs")
    joint = pairs.groupBy("entity", "term").agg(F.sum("rows").alias("n_joint"), F.count("*").alias("texts"), F.first("n").alias("n"), F.first("n_entity").alias("n_entity"))
    pmi = F.log(F.col("n_joint") * F.lit(float(max(total, 1))) / (F.col("n_entity") * F.greatest("n", "n_joint")))
    ic = F.log(F.lit(float(max(total, 2))) / F.col("n_entity"))
    rated = joint.select("entity", "term", F.when(ic > 0, pmi / ic * (1 - F.pow(F.lit(0.5), "texts"))).otherwise(F.lit(0.0)).alias("disclosure"))
    risky = rated.filter(F.col("disclosure") >= GENERALISE)
    return pairs.select("entity", "term", "digest", "rows").join(risky.hint("merge"), ["entity", "term"]).groupBy("digest", "term").agg(F.max("disclosure").alias("disclosure"), F.first("rows").alias("rows"))


def _located(names: list[str]):
    """Every place of a text's disclosing terms: `risky` becomes `terms`."""

    def run(batches):
        span_t = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32())]))
        for b in batches:
            at = len(names)
            out = []
            for text, spans, risky in zip(*[b.column(k).to_pylist() for k in range(at, at + 3)], strict=True):
                kinds = {x["term"]: x["kind"] for x in risky or []}
                base = [(x["kind"], x["s"], x["e"]) for x in spans]
                out.append([{"kind": kinds[w], "s": s, "e": e} for w, s, e in _words(text, base) if w in kinds] if kinds else [])
            yield pa.RecordBatch.from_arrays([*b.columns[: at + 2], pa.array(out, span_t)], names=[*names, "text", "spans", "terms"])

    return releasing(run)


def analyse(docs: DataFrame, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """The kept columns with `text` (where there is a base span), `spans` and `terms`: the spans that the method adds."""
    detected = materialise(detect(docs, keep, text_col), "pii-detected")
    kind = F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("generalise")
    found = disclosing_terms(docs, detected, text_col).groupBy("digest").agg(F.collect_list(F.struct("term", kind.alias("kind"))).alias("risky"), F.first("rows").alias("rows"))
    # rows without a span have nothing to look up; copies of a text that many rows have are spread
    empty = F.array().cast("array<struct<kind:string,s:int,e:int>>")
    rows = detected.filter(F.col("digest").isNotNull()).withColumn("spread", F.monotonically_increasing_id())
    looked_up = look_up(rows, found, "digest", "spread", "left", count="rows", total=detected.count()).select(*keep, "text", "spans", "risky")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in detected.select(*keep).schema.fields] + ["text string, spans array<struct<kind:string,s:int,e:int>>, terms array<struct<kind:string,s:int,e:int>>"])
    located = looked_up.mapInArrow(_located(list(keep)), schema)
    return located.unionByName(detected.filter(F.col("digest").isNull()).select(*keep, "text", "spans", empty.alias("terms")))


def word_class(word: str) -> str:
    """What a term is generalised to."""
    if word.isdigit():
        return f"[NUMBER-{len(word)}]"
    return "[NAME]" if word[:1].isupper() else "[WORD]"


def mask(text: str, spans: list[tuple[str, int, int]], terms: list[tuple[str, int, int]]) -> str:
    """The text with base spans replaced by their kind, disclosing terms removed or generalised; overlapping base spans become one."""
    merged: list[list] = []
    for s, e, kind in sorted((s, e, k) for k, s, e in spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, f"[{kind.upper()}]"])
    merged += [[s, e, "[REMOVED]" if kind == "remove" else word_class(text[s:e])] for kind, s, e in terms]
    out, at = [], 0
    for s, e, new in sorted(merged):
        out += [text[at:s], new]
        at = e
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same columns; personal data and disclosing terms masked in the text. Texts without personal data stay as they are."""
    small_batches(docs.sparkSession)
    keep = tuple(docs.columns)
    safe = [f"__{k}" for k in range(len(keep))]
    renamed = docs.toDF(*safe)
    at = safe[keep.index(text_col)]
    found = analyse(renamed, tuple(safe), at).withColumnRenamed("text", "__found")

    def run(batches):
        for b in batches:
            old, hit = b.column(safe.index(at)).to_pylist(), b.column(len(safe)).to_pylist()
            spans, terms = b.column(len(safe) + 1).to_pylist(), b.column(len(safe) + 2).to_pylist()
            tuples = lambda xs: [(x["kind"], x["s"], x["e"]) for x in xs]
            new = [mask(h, tuples(s), tuples(t)) if h is not None else o for o, h, s, t in zip(old, hit, spans, terms, strict=True)]
            columns = [b.column(k) for k in range(len(safe))]
            columns[safe.index(at)] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=safe)

    return found.select(*safe, "__found", "spans", "terms").mapInArrow(releasing(run), renamed.schema).toDF(*keep)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: base counts, a digest of the base spans, and all spans as text."""
    kinds = F.array(*map(F.lit, KINDS))
    found = analyse(docs.select(id_col, F.col(text_col).alias("__t")), (id_col,), "__t")
    shown = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x.kind, x.s, x.e)), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long")
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(F.array_position(kinds, x.kind).alias("o"), x.s.alias("s"), x.e.alias("e"), x.kind.alias("kind"))))
    base, added = shown(F.col("base")), shown(F.col("terms"))
    return found.withColumn("base", ordered).select(
        id_col,
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(base, 256).alias("base_sha256"),
        F.concat_ws(",", F.when(F.size("base") > 0, base), F.when(F.size("terms") > 0, added)).alias("spans"),
        F.size("terms").cast("long").alias("n_terms"),
    )
