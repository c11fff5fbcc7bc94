"""Exact Jaccard self-join of word-shingle sets by prefix trees, and its connected components.

1. Each text becomes a set of 62-bit keys of its 5-word shingles, hashed by a seed that is drawn for the job. Runs of documents are written to the shared folder and
   tell each part of the key space their distinct keys; parts tell the runs which keys other sets have too, in classes
   of how many. Copies within a run count once.
2. All sets are ordered alike: keys of one set alone first, then by class, then by value. Two sets that reach the
   threshold t share a key among the first (1 - t) n + 1 of each. A set with that many keys of its own links with
   nothing, which leaves near copies and little else. Sets that are equal are one class from here on.
3. The prefixes are dealt by key; the smallest document under a key is its centre, and each document belongs to the
   centres of its prefix keys. Documents that share a prefix key with each other thus meet under one centre.
4. First each document goes to one centre, the one it shares most prefix keys with. There the sets go into a prefix
   tree; every set walks the tree, what sets share at their beginning is compared once, and subtrees are left as soon
   as the keys that remain cannot reach the needed overlap. Sets that are already linked are not compared again. A
   centre of more than GROUP members is split into blocks, each with the centre itself.
5. Links go through connected components. Centres whose members are now one component are done; in the others, members
   outside the centre's component are compared with all its members, in blocks of sets whose sizes lie near enough to
   each other. So all pairs that share a prefix key are compared, already connected, or too different in size.

Only counts and row numbers come to the driver.

Null and empty texts and texts without a word have the empty set and link with nothing. A text of fewer words than a
shingle is one shingle. Rows without a doc_id have a set but link with nothing and have no component. Rows of one doc_id
that have a shingle share a component, whatever their texts; rows with the empty set are their own. Texts of any length are taken whole; extra columns do not
matter, and an empty table gives an empty result. Equality of
shingles is that of their keys: two different ones share one with odds of 1 to 2^62, and since nobody knows the seed
beforehand, no text can be made to do so. Results do not depend on the seed.

A prefix key that very many sets share meets a sort-merge join, whose skewed parts Spark splits; rows that many others
equal are spread by hand.
"""

from __future__ import annotations

import hashlib
import math
import secrets
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, drop, look_up, materialise, releasing, scratch_path, small_batches, whole_number
from .components import components
from .hashing import mix, word_keys, word_spans
from .runs import NOBODY, columns, cut_runs, groups, pack_sorted, part_of, read_file, rows_of, slices, unpack_sorted

SHINGLE = 5
PERCENT = 75
#: Members of a centre that one task compares at most.
GROUP = 1000
#: Members of each side of a block where a centre's members are compared across.
SIDE = 250
#: Sets of n and m keys, n <= m, may link if n / m reaches the threshold: then their bands are equal or neighbours.
BAND = math.log(100 / PERCENT)
#: Rows of one set within a run from which on its rows are spread over SALTS parts to look up their class.
MANY, SALTS = 8, 32
#: Numbers from here on stand for sets whose doc_id another set goes by.
BEYOND = 1 << 62
#: Bits of a key that travel in step 1. Keys that only seem equal make an order a little worse, no more.
NAME_BITS = 48
RUN_BYTES = 16 << 20
PART_BYTES = 16 << 20
#: A key is in class 1, 2 or 3 if at least so many sets have it, about.
CLASS_FROM = np.array([2, 8, 64])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingle_keys(data: np.ndarray, offsets: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys (below 2^62) of every row end to end, and the rows' offsets in them; the seed tells no two jobs alike."""
    data = _LOWER[data]
    starts, ends, first = word_spans(data, offsets, _SPACE)
    words = word_keys(data, starts, ends, seed)
    counts = np.diff(first)
    sizes = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    row = np.repeat(np.arange(len(counts)), sizes)
    before = np.cumsum(sizes) - sizes
    at = first[:-1][row] + np.arange(len(row)) - before[row]
    padded = np.concatenate((words, np.zeros(SHINGLE, np.uint64)))
    length = np.minimum(counts[row], SHINGLE)
    with np.errstate(over="ignore"):
        keys = mix(length.astype(np.uint64) + np.uint64(seed))
        for k in range(SHINGLE):  # each word scrambles what stands before it, so places and words can't make up for one another
            keys = np.where(k < length, mix(keys + padded[at + k]), keys)
    keys >>= np.uint64(2)
    order = np.lexsort((keys, row))
    keys, row = keys[order], row[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
    keys, row = keys[fresh], row[fresh]
    return keys, np.searchsorted(row, np.arange(len(counts) + 1))


def _blocks(data: np.ndarray, offsets: np.ndarray, seed: int):
    """(first row, end row, keys, offsets) of about a MB of text each."""
    for lo, hi in blocks(offsets):
        yield lo, hi, *shingle_keys(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], seed)


def _digest(keys: np.ndarray) -> bytes:
    return hashlib.blake2b(keys.tobytes(), digest_size=16).digest()


def _short(keys: np.ndarray) -> np.ndarray:
    return keys >> np.uint64(62 - NAME_BITS)


def _tell_keys(parts: int, seed: int):
    def tell(run: str, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        """A row for each document, with the rows of its run that have an equal set, and one for each part with the run's keys there and how many of its sets have them."""
        docs, copies, found = [], Counter(), []
        for lo, _, keys, at in _blocks(data, offsets, seed):
            fresh = np.zeros(len(keys), bool)
            for k, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                d = _digest(keys[i:j])
                docs.append((None if ids[lo + k] == NOBODY else int(ids[lo + k]), j - i, d))
                fresh[i:j] = d not in copies
                copies[d] += 1
            found.append(_short(keys[fresh]))
        rows = [(*doc, copies[doc[2]], None, run, None, None) for doc in docs]
        names = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        head = np.ones(len(names), bool)
        head[1:] = names[1:] != names[:-1]
        heads = np.flatnonzero(head)
        count = np.minimum(np.diff(np.append(heads, len(names))), 255).astype(np.uint8)
        names = names[heads]
        for p, lo, hi in slices(part_of(names, NAME_BITS, parts)):
            rows.append((None, None, None, None, p, run, pack_sorted(names[lo:hi]), zstandard.ZstdCompressor(level=1).compress(count[lo:hi].tobytes())))
        return rows_of(rows, {"doc_id": pa.int64(), "n": pa.int64(), "digest": pa.binary(), "copies": pa.int32(), "part": pa.int32(), "run": pa.string(), "names": pa.binary(), "counts": pa.binary()})

    return tell


def _classify(batches):
    """Per part: the keys that more than one set has, with their classes, back to the runs that hold them."""
    for _, rows in groups(batches, 1):
        names = [unpack_sorted(blob) for _, blob, _ in rows]
        counts = [np.frombuffer(zstandard.ZstdDecompressor().decompress(c), np.uint8) for _, _, c in rows]
        every = np.concatenate(names)
        order = np.argsort(every, kind="stable")
        every, count = every[order], np.concatenate(counts)[order].astype(np.int64)
        heads = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        total = np.add.reduceat(count, heads) if len(heads) else count
        shared, total = every[heads][total > 1], total[total > 1]
        del every, count, order
        out = []
        for (run, _, _), own in zip(rows, names, strict=True):
            at = np.minimum(np.searchsorted(shared, own), max(0, len(shared) - 1))
            hit = shared[at] == own if len(shared) else np.zeros(len(own), bool)
            if hit.any():
                kind = np.searchsorted(CLASS_FROM, total[at[hit]], "right").astype(np.uint8)
                out.append((run, pack_sorted(own[hit]), zstandard.ZstdCompressor(level=1).compress(kind.tobytes())))
        yield rows_of(out, {"run": pa.string(), "names": pa.binary(), "kinds": pa.binary()})


def _candidates(batches, folder: str, seed: int):
    """(digest, rep, n, keys): each run's sets that may link, once each, with their shared keys in the common order."""
    for (run,), rows in groups(batches, 1):
        parts = sorted(((unpack_sorted(n), np.frombuffer(zstandard.ZstdDecompressor().decompress(k), np.uint8)) for n, k in rows), key=lambda x: int(x[0][0]))
        shared, kinds = np.concatenate([n for n, _ in parts]), np.concatenate([k for _, k in parts]).astype(np.uint64)
        ids, data, offsets = columns(read_file(folder, f"{run}.parquet"))
        found: dict[bytes, tuple[int, int, bytes]] = {}
        for lo, _, keys, at in _blocks(data, offsets, seed):
            short = _short(keys)
            place = np.minimum(np.searchsorted(shared, short), len(shared) - 1)
            hit = shared[place] == short
            before = np.concatenate(([0], np.cumsum(hit)))[at]
            n, m = np.diff(at), np.diff(before)
            marked = keys[hit] | (kinds[place[hit]] << np.uint64(62))
            for k in np.flatnonzero((n > 0) & (n - m < prefix_length(n)) & (ids[lo : lo + len(n)] != NOBODY)).tolist():
                d, rep = _digest(keys[at[k] : at[k + 1]]), int(ids[lo + k])
                if d in found:
                    found[d] = (min(found[d][0], rep), *found[d][1:])
                else:
                    found[d] = (rep, int(n[k]), np.sort(marked[before[k] : before[k + 1]]).tobytes())
        items = [(d, *x) for d, x in found.items()]
        for k in range(0, len(items), 500):
            yield rows_of(items[k : k + 500], {"digest": pa.binary(), "rep": pa.int64(), "n": pa.int64(), "keys": pa.binary()})


def prefix_length(n: np.ndarray | int):
    """Keys of a set of n that any set within the threshold must share one of."""
    return n - (PERCENT * n + 99) // 100 + 1


def needed(a: int, b: int) -> int:
    """Least overlap of sets of a and b keys that reaches the threshold: 100 o >= PERCENT (a + b - o)."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def _prefixes(batches):
    """(u, key) of the shared keys in each set's prefix."""
    for b in batches:
        us, keys = [], []
        for u, n, raw in zip(*[c.to_pylist() for c in b.columns], strict=True):
            mine = np.frombuffer(raw, np.uint64)
            mine = mine[: max(0, prefix_length(n) - (n - len(mine)))]
            us.append(np.full(len(mine), u))
            keys.append(mine.astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (us, keys)], names=["u", "key"])


class PrefixTree:
    """Ordered key sets as a path-compressed tree; a walk compares what sets share once and leaves hopeless subtrees.

    A set is its size n and those of its keys that other sets have; the rest of its n keys meet nothing.
    """

    def __init__(self) -> None:
        # a node: keys of its piece of the path, children by first key, members that end here as (name, n), and of the
        # sets below it the least n, the greatest n and the most keys
        self.root: list = [np.zeros(0, np.uint64), {}, [], 1 << 60, 0, 0]

    def add(self, name: int, n: int, keys: np.ndarray) -> None:
        node, at, size = self.root, 0, len(keys)
        while True:
            node[3], node[4], node[5] = min(node[3], n), max(node[4], n), max(node[5], size)
            if at == size:
                node[2].append((name, n))
                return
            child = node[1].get(int(keys[at]))
            if child is None:
                node[1][int(keys[at])] = [keys[at:], {}, [(name, n)], n, n, size]
                return
            piece = child[0]
            m = min(len(piece), size - at)
            differ = np.flatnonzero(piece[:m] != keys[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(piece):
                below = [piece[same:], *child[1:]]
                child[0], child[1], child[2] = piece[:same], {int(piece[same]): below}, []
            node, at = child, at + same

    def partners(self, n: int, keys: np.ndarray, skip) -> list[int]:
        """Members whose sets reach the threshold with the walker's; those for which skip(name) holds are passed over."""
        size, out = len(keys), []
        if not size:
            return out
        stack = [(child, 0, 0, 0) for child in self.root[1].values()]
        while stack:
            node, mine, depth, overlap = stack.pop()
            piece, children, members, least_n, most_n, most_keys = node
            if not children and all(skip(x) for x, _ in members):
                continue
            # sizes further apart than the threshold allows, or too few keys left on either side of this place
            if PERCENT * least_n > 100 * n or 100 * most_n < PERCENT * n:
                continue
            least = needed(n, max(least_n, -(-PERCENT * n // 100)))
            if overlap + min(size - mine, most_keys - depth) < least:
                continue
            place = np.searchsorted(keys, piece)
            overlap += int((keys[np.minimum(place, size - 1)] == piece).sum())
            mine, depth = int(np.searchsorted(keys, piece[-1], "right")), depth + len(piece)
            out += [x for x, other in members if overlap >= needed(n, other) and not skip(x)]
            if overlap + min(size - mine, most_keys - depth) >= least:
                stack += [(child, mine, depth, overlap) for child in children.values()]
        return out


class _Union:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        top = x
        while (y := self.up.setdefault(top, top)) != top:
            top = y
        while self.up[x] != top:
            self.up[x], x = top, self.up[x]
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


Member = tuple[int, int, np.ndarray]


def link(members: list[Member], others: list[Member] | None = None, same: dict | None = None) -> list[tuple[int, int]]:
    """Links that connect the members (or members with others) as all pairs within the threshold would; same: names already connected.

    What is connected comes as a star around its smallest name, which is what components are made of in the end.
    """
    union, tree, out = _Union(), PrefixTree(), []
    for group in (same or {}).values():
        for x in group[1:]:
            union.join(group[0], x)

    def meet(name: int, n: int, keys: np.ndarray) -> None:
        for x in tree.partners(n, keys, lambda y: union.find(y) == union.find(name)):
            if union.join(name, x):
                out.append((name, x))

    for member in members:
        if others is None:
            meet(*member)
        tree.add(*member)
    for member in others or []:
        meet(*member)
    return sorted({(x, centre) for pair in out for x in pair if x != (centre := union.find(x))})


def _pairs_out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return rows_of(pairs, {"u": pa.int64(), "v": pa.int64()})


def _link_blocks(batches):
    """(centre, block), u, n, keys -> links."""
    found = []
    for _, rows in groups(batches, 2):
        found += link(sorted({u: (u, n, np.frombuffer(k, np.uint64)) for u, n, k in rows}.values(), key=lambda x: (x[1], x[0])))
        if len(found) > 50_000:
            yield _pairs_out(found)
            found = []
    yield _pairs_out(found)


def _link_across(batches):
    """Keys of a block, then side, component, u, n, keys -> links between the sides."""
    found = []
    for _, rows in groups(batches, 5):
        sides: tuple[dict, dict] = ({}, {})
        same: dict[int, list[int]] = {}
        for side, component, u, n, k in rows:
            sides[side][u] = (u, n, np.frombuffer(k, np.uint64))
            same.setdefault(component, []).append(u)
        found += link(list(sides[0].values()), list(sides[1].values()), same)
    yield _pairs_out(found)


def _linked(dealt: DataFrame, sets: DataFrame, keys: list[str], how) -> DataFrame:
    """Links of the sets that stand together under the keys."""
    return dealt.join(sets.select("u", "n", "keys"), "u").select(*keys, *[c for c in dealt.columns if c not in (*keys, "u")], "u", "n", "keys").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(releasing(how), "u long, v long")


def _shared_ids(filled: DataFrame) -> DataFrame | None:
    """(doc_id, digest, node) of the doc_ids that have several different sets; None if there are none.

    A set goes by the smallest doc_id that has it. Where two sets would go by the same one, one of them keeps it and the
    others get numbers beyond all doc_ids. All sets of a doc_id are one component.
    """
    several = filled.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b").select("doc_id")
    rows = materialise(filled.join(several, "doc_id").select("doc_id", "digest").distinct(), "shingle-shared-ids")
    if rows.isEmpty():
        drop(rows)
        return None
    if filled.agg(F.max("doc_id")).first()[0] >= BEYOND:
        raise ValueError(f"doc_ids must be below {BEYOND} where several texts share one")
    least = filled.join(rows.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    keeps = least.groupBy("rep").agg(F.min("digest").alias("kept"))
    other = F.pmod(F.xxhash64("digest"), F.lit(BEYOND)) + F.lit(BEYOND)
    nodes = least.join(keeps, "rep").select("digest", F.when(F.col("digest") == F.col("kept"), F.col("rep")).otherwise(other).alias("node"))
    return materialise(rows.join(nodes, "digest").select("doc_id", "digest", "node"), "shingle-shared-ids")


def _across(met: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame | None:
    """Links of members outside their centre's component with all members of the centre; None where all are inside."""
    own = met.select("centre", "u").unionByName(met.select("centre", F.col("centre").alias("u")).distinct())
    members = own.join(sets.select("u", "n"), "u").join(found, "u", "left").select("centre", "u", F.floor(F.log("n") / BAND).cast("int").alias("band"), F.coalesce("component", "u").alias("component"))
    inside = materialise(members, "shingle-members")
    home = inside.filter("u = centre").select("centre", F.col("component").alias("home"))
    outside = materialise(look_up(inside, home, "centre", "u").filter("component <> home").select("centre", "u", "band", "component"), "shingle-outside")
    if outside.isEmpty():
        drop(inside, outside)
        return None
    # a cell holds the outsiders of one band and the members of the same or a neighbouring one, in blocks of SIDE each
    parts = lambda rows, name: rows.groupBy("centre", "band").agg(F.ceil(F.count("*") / F.lit(SIDE)).cast("int").alias(name))
    lefts = parts(outside, "lefts")
    near = lefts.select("centre", "lefts", F.col("band").alias("left_band"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    cells = materialise(near.join(parts(inside, "rights"), ["centre", "band"]).withColumnRenamed("band", "right_band"), "shingle-cells")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pick = lambda n, seed: F.pmod(F.xxhash64("u", F.lit(seed)), F.col(n).cast("long")).cast("int")
    keys = ["centre", "left_band", "right_band", "left", "right"]

    def dealt(rows: DataFrame, band: str, left: Column, right: Column, side: int) -> DataFrame:
        rows = rows.select("u", "component", F.struct("centre", F.col("band").alias(band)).alias("cell"))
        known = cells.select(F.struct("centre", band).alias("cell"), F.col("right_band" if band == "left_band" else "left_band"), "lefts", "rights")
        return look_up(rows, known, "cell", "u").select("u", "component", "cell.*", "left_band" if band == "right_band" else "right_band", left.alias("left"), "lefts", "rights").select("*", right.alias("right")).select(*keys, F.lit(side).alias("side"), "component", "u")

    left = dealt(outside, "left_band", pick("lefts", 1), spread("rights"), 0)
    right = dealt(inside, "right_band", spread("lefts"), pick("rights", 2), 1)
    more = materialise(_linked(left.unionByName(right), sets, keys, _link_across), "shingle-links")
    drop(inside, outside, cells)
    return more


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    folder = scratch_path(spark, "shingle-runs")
    rows = docs.select(whole_number(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(2 * spark.sparkContext.defaultParallelism, size // PART_BYTES + 1)
    tasks, seed = int(max(2 * spark.sparkContext.defaultParallelism, size // RUN_BYTES + 1)), secrets.randbits(63)
    told = materialise(rows.mapInArrow(releasing(lambda b: cut_runs(b, folder, RUN_BYTES, _tell_keys(parts, seed))), "doc_id long, n long, digest binary, copies int, part int, run string, names binary, counts binary"), "shingle-keys")
    shared = told.filter("part is not null").select("part", "run", "names", "counts").repartition("part").sortWithinPartitions("part", "run").mapInArrow(releasing(_classify), "run string, names binary, kinds binary")
    single = shared.repartition(tasks, "run").sortWithinPartitions("run").mapInArrow(releasing(lambda b: _candidates(b, folder, seed)), "digest binary, rep long, n long, keys binary")
    summary = told.filter("digest is not null").select("doc_id", "n", "digest", "copies")
    filled = summary.filter("n > 0 and doc_id is not null")
    sets = materialise(single.groupBy("digest").agg(F.min("rep").alias("u"), F.first("n").alias("n"), F.first("keys").alias("keys")), "shingle-sets")

    drop(folder)
    own = _shared_ids(filled)
    if own is not None:
        sets = materialise(sets.join(own.select("digest", "node").distinct(), "digest", "left").withColumn("u", F.coalesce("node", "u")).drop("node"), "shingle-sets")

    keyed = sets.select("u", "n", "keys").mapInArrow(releasing(_prefixes), "u long, key long")
    under = keyed.groupBy("key").agg(F.min("u").alias("centre"), F.count("*").alias("sets")).filter("sets > 1").drop("sets")
    met = materialise(keyed.join(under.hint("merge"), "key").filter("u <> centre").groupBy("centre", "u").agg(F.count("*").alias("common")), "shingle-centres")

    best = met.groupBy("u").agg(F.max_by("centre", F.struct("common", -F.col("centre"))).alias("centre"))
    sized = best.groupBy("centre").agg(F.ceil(F.count("*") / F.lit(GROUP)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("u"), F.col("blocks").cast("long")).cast("int")
    dealt = look_up(best, sized, "centre", "u").select("centre", block.alias("block"), "u").unionByName(sized.select("centre", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("centre").alias("u")))
    links = materialise(_linked(dealt, sets, ["centre", "block"], _link_blocks), "shingle-links")
    if own is not None:
        least = own.groupBy("doc_id").agg(F.min("node").alias("u"))
        links = links.unionByName(own.join(least, "doc_id").filter("u <> node").select("u", F.col("node").alias("v")))
    found = components(links)

    more = _across(met, sets, found)
    drop(met)
    if more is not None:
        found = components(found.select("u", F.col("component").alias("v")).unionByName(more))

    # a row's class is that of the rows with an equal set, by digest; most rows have a set of their own and link with nothing.
    # A digest of many rows has many in some run: only such rows are spread, and only such digests repeated
    nodes = sets.select("digest", "u")
    if own is not None:
        nodes = nodes.unionByName(own.select("digest", F.col("node").alias("u"))).distinct()
    linked = nodes.join(found, "u").select("digest", "component")
    equal = filled.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")).join(linked, "digest", "left").filter("rows > 1 or component is not null")
    equal = equal.select("digest", F.coalesce("component", "rep").alias("component_id"), F.explode(F.sequence(F.lit(0), F.when(F.col("rows") >= MANY, SALTS - 1).otherwise(0))).alias("salt"))
    salt = F.when(F.col("copies") >= MANY, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(0)
    named = filled.withColumn("salt", salt).join(equal.hint("merge"), ["digest", "salt"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    rest = summary.filter("n = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(rest.select("doc_id", F.col("n").alias("n_shingles"), "component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those whose component has a document of smaller id; all columns as they were.

    Rows that link with nothing stay, also those without a doc_id. Of rows that share the smallest doc_id all stay.
    """
    found = classes(docs, id_col, text_col).filter(F.col("doc_id").isNotNull() & (F.col("component_id") < F.col("doc_id"))).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(found, docs[id_col] == F.col("__gone"), "left_anti")
