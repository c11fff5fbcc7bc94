"""Exact cosine range join of vectors: pivots, boundaries by the triangle inequality, cells that are joined by themselves.

1. Equal vectors are one class with a weight, so copies are compared once.
2. Pivots are taken from a sample of at most SAMPLE classes, further apart from each other than the threshold. Each class
   belongs to the cell of its nearest pivot. With r the threshold's angle, a cell has two parts: its core within r / 2 of
   the pivot, and the rest. All of a core are within r of each other by the triangle inequality: they are linked without
   a comparison, so a group of near copies costs what its members cost, not its pairs.
3. A vector x of cell p can only meet the part of cell q whose vectors reach as far as R from their pivot if
   angle(x, q) <= R + r and if x is at most the threshold's chord beyond the plane half way between p and q. These are
   x's boundaries. Two parts are joined if each has a vector in the other's boundary, and then only those are compared.
4. Parts are stored in blocks of about BLOCK vectors, as files of the shared folder. A pair of blocks is a row of two names; the
   task that gets it reads both. So boundary vectors are read again, and never copied into a shuffle, and no cell has to
   fit one task, however large it is.
5. A pair of blocks is compared by one product of single precision; what comes within its rounding of the threshold is
   decided in double precision. Out come sums of weights per vector, and links as stars around the smallest id.

Nothing is sampled but the pivots, which decide only the cost. How much the boundaries leave out is up to the data: in many
dimensions without clusters most cells lie within each other's boundaries, and every pair of blocks is compared.

Null vectors, zero vectors and those with a null or non-finite component link with nothing; neither do rows without an id, whose component is
null, nor vectors of different length. A repeated row counts as a vector of its own; rows of one id share a component,
whatever their vectors. Ties need no rule: all vectors at the threshold or above are linked. Other columns do not matter; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, look_up, materialise, releasing, scratch_path, small_batches, whole_number
from .components import components
from .runs import read_file, rows_of, write_file

THRESHOLD = 0.95
#: Vectors that the pivots are taken from, at most, and bytes of these.
SAMPLE, SAMPLE_BYTES = 8192, 16 << 20
#: Vectors for each pivot, about, and pivots at most.
CELL, MOST_PIVOTS = 2048, 1024
BLOCK = 4096
#: Comparisons for each task, about.
WORK = 100_000_000
#: Entries of a product that are looked through at once.
STRETCH = 1 << 21
#: What cosines of pivots may be off by, and by how much an angle must stay under half the threshold's to be in a core.
_SLACK, _CORE_SLACK = 1e-6, 1e-4
#: The cell of vectors that have no pivot of their length.
_LONE = -1


@dataclass(frozen=True)
class Space:
    """The pivots of each length, as unit vectors, the number of the first one's cell, and the threshold."""

    pivots: dict[int, tuple[int, np.ndarray]]
    threshold: float

    @property
    def angle(self) -> float:
        return math.acos(self.threshold)

    def cosines(self, units: np.ndarray) -> tuple[int, np.ndarray] | None:
        """The first cell of this length, and each vector's cosines with its pivots."""
        known = self.pivots.get(units.shape[1])
        return known and (known[0], units.astype(np.float64) @ known[1].T)

    def boundary(self, cosines: np.ndarray, home: np.ndarray, first: int, cell: int, least: float, apart: np.ndarray) -> np.ndarray:
        """Which vectors can be within the threshold of one that lies in `cell`, not below the cosine `least` to its pivot.

        `home`: the vectors' own pivots, counted from the first; `apart`: the distances of all pivots to this one.
        """
        k = cell - first
        reach = math.acos(max(-1.0, min(1.0, least))) + self.angle
        near = cosines[:, k] >= (math.cos(reach) if reach < math.pi else -1.0) - _SLACK
        beyond = cosines[np.arange(len(home)), home] - cosines[:, k]
        return near & (beyond <= (math.sqrt(2 - 2 * self.threshold) + _SLACK) * apart[home] + _SLACK)


def units(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision, whatever their magnitude."""
    raw = raw.astype(np.float64)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def _matrices(raw: list[bytes], kind: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each length: the places of its vectors in the list, and the vectors."""
    size = np.array([len(x) for x in raw]) // np.dtype(kind).itemsize
    return {int(d): (at, np.frombuffer(b"".join(raw[k] for k in at), kind).reshape(-1, d)) for d in np.unique(size) for at in [np.flatnonzero(size == d)]}


def _read(batches):
    """(vec_id, digest, raw) of each row; a vector that links with nothing has no digest."""
    for b in batches:
        lists = b.column(1)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        flat = flat + flat.dtype.type(0)  # -0.0 is 0.0
        ends = np.cumsum(sizes)
        tally = lambda mask: np.concatenate(([0], np.cumsum(mask)))
        bad, set_ = tally(~np.isfinite(flat)), tally(flat != 0)
        starts = ends - sizes
        good = (bad[ends] == bad[starts]) & (set_[ends] > set_[starts]) & np.asarray(pc.is_valid(b.column(0)))
        raw = [flat[i:j].tobytes() if g else None for i, j, g in zip(starts.tolist(), ends.tolist(), good.tolist(), strict=True)]
        digest = [x and hashlib.blake2b(x, digest_size=16).digest() for x in raw]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digest, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "digest", "raw"])


def fit(classes: DataFrame, kind: str, threshold: float, n: int) -> Space:
    """Pivots from the classes of smallest digest, which are as good as drawn at random, each apart from those before it."""
    longest = classes.agg(F.max(F.octet_length("raw"))).first()[0] or 1
    sample = classes.orderBy("digest").limit(max(1, min(SAMPLE, SAMPLE_BYTES // longest))).select("raw").toArrow().column(0).to_pylist()
    pivots, first = {}, 0
    for d, (at, raw) in _matrices(sample, kind).items():
        left = units(raw)
        most = max(1, min(MOST_PIVOTS, n // CELL) * len(at) // len(sample))
        chosen = []
        while len(left) and len(chosen) < most:
            chosen.append(left[0])
            left = left[left @ left[0] < threshold]
        pivots[d] = (first, np.array(chosen))
        first += len(chosen)
    return Space(pivots, threshold)


def _assign(shared, kind: str):
    """Each class's cell, whether it is in the core, and its cosine with the pivot."""

    def run(batches):
        space: Space = shared.value
        core_from = math.cos(max(0.0, space.angle / 2 - _CORE_SLACK))
        for b in batches:
            cell, cosine = np.full(b.num_rows, _LONE, np.int32), np.zeros(b.num_rows)
            for at, raw in _matrices(b.column(b.schema.get_field_index("raw")).to_pylist(), kind).values():
                if known := space.cosines(units(raw)):
                    best = known[1].argmax(axis=1)
                    cell[at], cosine[at] = known[0] + best, known[1][np.arange(len(at)), best]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array((cosine >= core_from) & (cell != _LONE)), pa.array(cosine)], names=[*b.schema.names, "cell", "core", "cosine"])

    return releasing(run)


def _name(cell: int, core: bool, block: int) -> str:
    return f"{cell}-{'core' if core else 'rest'}-{block}.parquet"


def _store(folder: str):
    """Blocks as files; a row for each."""

    def run(batches):
        waiting: list[pa.RecordBatch] = []

        def finish() -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting).combine_chunks()
            key = tuple(table.column(c)[0].as_py() for c in ("cell", "core", "block"))
            write_file(folder, _name(*key), table.select(["digest", "rep", "weight", "raw"]))
            return rows_of([(*key, table.num_rows)], {"cell": pa.int32(), "core": pa.bool_(), "block": pa.int32(), "n": pa.int64()})

        for b in batches:
            keys = np.stack([np.asarray(b.column(c), np.int64) for c in ("cell", "core", "block")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                piece = b.slice(i, j - i)
                if waiting and any(waiting[-1].column(c)[0] != piece.column(c)[0] for c in ("cell", "core", "block")):
                    yield finish()
                    waiting = []
                waiting.append(piece)
        if waiting:
            yield finish()

    return releasing(run)


def _visits(shared, parts: list[tuple[int, bool, float]], kind: str):
    """(cell, core, to_cell, to_core): parts whose boundary has a vector of this one, once a batch."""

    def run(batches):
        space: Space = shared.value
        for b in batches:
            raws, core, cells = b.column(0).to_pylist(), np.asarray(b.column(1)), np.asarray(b.column(2))
            found = set()
            for d, (at, raw) in _matrices(raws, kind).items():
                if not (known := space.cosines(units(raw))):
                    found.add((_LONE, False, _LONE, False))
                    continue
                first, cosines = known
                pivots = space.pivots[d][1]
                home, mine = cells[at] - first, core[at]
                for cell, to_core, least in parts:
                    if not first <= cell < first + len(pivots):
                        continue
                    near = space.boundary(cosines, home, first, cell, least, _apart(pivots, cell - first))
                    for inner in (False, True):
                        found |= {(int(first + h), inner, cell, to_core) for h in np.unique(home[near & (mine == inner)]) if not (inner and to_core and first + h == cell)}
            yield rows_of(sorted(found), {"cell": pa.int32(), "core": pa.bool_(), "to_cell": pa.int32(), "to_core": pa.bool_()})

    return releasing(run)


def _apart(pivots: np.ndarray, k: int) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * pivots @ pivots[k]))


class Block:
    """A stored block, by vector length."""

    def __init__(self, folder: str, name: str, kind: str) -> None:
        table = read_file(folder, name)
        self.digest = table.column("digest").to_pylist()
        self.rep, self.weight = np.asarray(table.column("rep")), np.asarray(table.column("weight"))
        self.links = np.zeros(len(self.rep), np.int64)
        self.rows = {d: (at, raw, units(raw)) for d, (at, raw) in _matrices(table.column("raw").to_pylist(), kind).items()}


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n numbers the smallest that links lead to."""
    least = np.arange(n)
    while True:
        a, b = least[i], least[j]
        if (a == b).all():
            return least
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (further := least[least]).tobytes() != least.tobytes():
            least = further


def _pairs(a: tuple, b: tuple, threshold: float):
    """(i, j) of the rows of two matrices that reach the threshold, in stretches; a and b: raw rows, unit rows."""
    (raw_a, unit_a), (raw_b, unit_b) = a, b
    slack = 1e-5 + 3e-7 * unit_a.shape[1]
    left, right = unit_a.astype(np.float32), unit_b.astype(np.float32).T
    step = max(1, STRETCH // max(1, len(unit_b)))
    for lo in range(0, len(left), step):
        product = left[lo : lo + step] @ right
        i, j = np.nonzero(product >= np.float32(threshold - slack))
        close = product[i, j] < np.float32(threshold + slack)
        i = i + lo
        keep = np.ones(len(i), bool)
        if close.any():
            x, y = raw_a[i[close]].astype(np.float64), raw_b[j[close]].astype(np.float64)
            x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
            dot = lambda p, q: np.einsum("ij,ij->i", p, q)
            keep[close] = dot(x, y) >= threshold * np.sqrt(dot(x, x) * dot(y, y))
        yield i[keep], j[keep]


def _compare(shared, reach: dict[tuple[int, bool], float], folder: str, kind: str):
    """Pairs of blocks, sorted by the first -> (digest, n) sums of weights, and (u, v) links."""

    def boundary(space: Space, rows: tuple, cell: int, to: int, least: float) -> np.ndarray:
        known = space.cosines(rows[2])
        if known is None or cell == to:
            return np.arange(len(rows[0]))
        first, cosines = known
        pivots = space.pivots[rows[2].shape[1]][1]
        return np.flatnonzero(space.boundary(cosines, np.full(len(cosines), cell - first), first, to, least, _apart(pivots, to - first)))

    def run(batches):
        space: Space = shared.value
        held, name = None, None

        def counted(block: Block):
            at = np.flatnonzero(block.links)
            rows = [(block.digest[k], int(block.links[k]), None, None) for k in at.tolist()]
            block.links[:] = 0
            return rows

        def out(rows):
            return rows_of(rows, {"digest": pa.binary(), "n": pa.int64(), "u": pa.int64(), "v": pa.int64()})

        for b in batches:
            for cell, core, block, to_cell, to_core, to_block in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if name != (cell, core, block):
                    if held is not None:
                        yield out(counted(held))
                    held, name = Block(folder, _name(cell, core, block), kind), (cell, core, block)
                same = name == (to_cell, to_core, to_block)
                other = held if same else Block(folder, _name(to_cell, to_core, to_block), kind)
                # numbers of both blocks' vectors by the order of their ids, so that the smallest number is the smallest id
                reps = held.rep if same else np.concatenate((held.rep, other.rep))
                order = np.argsort(reps, kind="stable")
                number = np.empty(len(reps), np.int64)
                number[order] = np.arange(len(reps))
                shift = 0 if same else len(held.rep)
                seen = np.arange(len(reps))
                for d in held.rows.keys() & other.rows.keys():
                    mine, theirs = held.rows[d], other.rows[d]
                    p, q = boundary(space, mine, cell, to_cell, reach[to_cell, to_core]), boundary(space, theirs, to_cell, cell, reach[cell, core])
                    for i, j in _pairs((mine[1][p], mine[2][p]), (theirs[1][q], theirs[2][q]), space.threshold):
                        i, j = mine[0][p[i]], theirs[0][q[j]]
                        if same:
                            i, j = i[i != j], j[i != j]
                        held.links += np.bincount(i, other.weight[j], len(held.rep)).astype(np.int64)
                        if not same:
                            other.links += np.bincount(j, held.weight[i], len(other.rep)).astype(np.int64)
                        far = seen[number[i]] != seen[number[j + shift]]
                        if far.any():
                            seen = stars(len(reps), np.concatenate((np.arange(len(reps)), number[i[far]])), np.concatenate((seen, number[j[far] + shift])))
                away = np.flatnonzero(seen != np.arange(len(reps)))
                links = [(None, None, u, v) for u, v in zip(reps[order[away]].tolist(), reps[order[seen[away]]].tolist(), strict=True) if u != v]
                if links or not same:
                    yield out(links + ([] if same else counted(other)))
        if held is not None:
            yield out(counted(held))

    return releasing(run)


def join(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors."""
    spark = vectors.sparkSession
    small_batches(spark)
    held = vectors.schema[vector_col].dataType
    kind, element = ("f4", "float") if isinstance(held, T.ArrayType) and isinstance(held.elementType, T.FloatType) else ("f8", "double")
    rows = vectors.select(whole_number(vectors, id_col).alias("vec_id"), F.col(vector_col).cast(f"array<{element}>").alias("v")).mapInArrow(releasing(_read), "vec_id long, digest binary, raw binary")
    classes = materialise(rows.filter("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("raw").alias("raw")), "vector-classes")
    n, total = classes.agg(F.count("*"), F.sum("weight")).first()
    space = fit(classes, kind, threshold, n)
    shared = spark.sparkContext.broadcast(space)

    assigned = materialise(classes.mapInArrow(_assign(shared, kind), "digest binary, rep long, weight long, raw binary, cell int, core boolean, cosine double"), "vector-cells")
    # one row for each part, at most two for each pivot
    parts = materialise(assigned.groupBy("cell", "core").agg(F.count("*").alias("rows"), F.min("cosine").alias("least"), F.min("rep").alias("first"), F.sum("weight").alias("all")), "vector-parts")
    known = parts.select("cell", "core", "least").collect()
    reach = {(r.cell, r.core): -1.0 if r.cell == _LONE else r.least for r in known}

    folder = scratch_path(spark, "vector-blocks")
    blocks = parts.select("cell", "core", F.ceil(F.col("rows") / F.lit(BLOCK)).cast("int").alias("blocks"))
    placed = assigned.join(F.broadcast(blocks), ["cell", "core"]).withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks").cast("long")).cast("int"))
    stored = materialise(placed.select("cell", "core", "block", "digest", "rep", "weight", "raw").repartition("cell", "core", "block").sortWithinPartitions("cell", "core", "block").mapInArrow(_store(folder), "cell int, core boolean, block int, n long"), "vector-stored")

    towards = assigned.select("raw", "core", "cell").mapInArrow(_visits(shared, [(c, k, least) for (c, k), least in reach.items()], kind), "cell int, core boolean, to_cell int, to_core boolean").distinct()
    back = towards.select(*[F.col(a).alias(b) for a, b in (("cell", "to_cell"), ("core", "to_core"), ("to_cell", "cell"), ("to_core", "core"))])
    visits = towards.join(back, ["cell", "core", "to_cell", "to_core"], "left_semi").filter("struct(cell, core) <= struct(to_cell, to_core)")
    other = stored.select(*[F.col(c).alias(f"to_{c}") for c in stored.columns])
    pairs = visits.join(stored, ["cell", "core"]).join(other, ["to_cell", "to_core"]).filter("struct(cell, core, block) <= struct(to_cell, to_core, to_block)")
    pairs = materialise(pairs.select("cell", "core", "block", "to_cell", "to_core", "to_block", "n", "to_n"), "vector-pairs")
    work = pairs.agg(F.sum(F.col("n").cast("double") * F.col("to_n"))).first()[0] or 0
    tasks = int(max(2 * spark.sparkContext.defaultParallelism, min(work // WORK, 1_000_000)))
    names = ["cell", "core", "block", "to_cell", "to_core", "to_block"]
    compared = pairs.select(*names).repartition(tasks, *names).sortWithinPartitions(*names).mapInArrow(_compare(shared, reach, folder, kind), "digest binary, n long, u long, v long")
    compared = materialise(compared, "vector-links")
    drop(pairs, stored, folder)

    # the cores: everything in one is linked with everything else there
    inner = assigned.filter("core").join(F.broadcast(parts.filter("core").select("cell", "first", "all")), "cell")
    counts = compared.filter("digest is not null").select("digest", "n").unionByName(inner.select("digest", (F.col("all") - F.col("weight")).alias("n"))).groupBy("digest").agg(F.sum("n").alias("others"))
    edges = compared.filter("u is not null").select("u", "v").unionByName(inner.filter("rep <> first").select(F.col("rep").alias("u"), F.col("first").alias("v")))
    ids = rows.filter("digest is not null").select("vec_id", "digest")
    several = ids.groupBy("vec_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b").select("vec_id")
    own = ids.join(several, "vec_id").join(classes.select("digest", "rep"), "digest").filter("vec_id <> rep").select(F.col("vec_id").alias("u"), F.col("rep").alias("v"))
    found = components(edges.unionByName(own))

    told = classes.select("digest", "rep", "weight").join(counts, "digest", "left").join(found.withColumnRenamed("u", "rep"), "rep", "left")
    told = told.select("digest", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), "weight")
    linked = look_up(ids, told, "digest", "vec_id", count="weight", total=total or 0).select("vec_id", "n_links", "component_id")
    alone = rows.filter("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def deduplicate(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of vectors without those whose component has a smaller id; rows without an id stay, and all columns as they were."""
    gone = join(vectors, id_col, vector_col, threshold).filter("not kept").select(F.col("vec_id").alias("__gone")).distinct()
    return vectors.join(gone, vectors[id_col] == gone["__gone"], "left_anti")
