"""Runs of documents in the shared folder, and the blobs that runs and parts exchange.

A run is what one task has read, up to a size: its rows are written once and read again by later steps, so texts never
pass a shuffle. What a run tells the parts of a key space travels as rows (part, run, blob), and back as (run, blob).
"""

from __future__ import annotations

import io
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import zstandard
from pyspark import TaskContext

from .common import utf8

#: Stands for a missing document id.
NOBODY = np.iinfo(np.int64).max


def write_file(folder: str, name: str, table: pa.Table) -> None:
    """A file that appears whole: another attempt of the same task puts an equal one in its place."""
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    part = f"{base}/.{name}-{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(part) as sink:
        pq.write_table(table, sink, compression="zstd", use_dictionary=False)
    fs.move(part, f"{base}/{name}")


def read_file(folder: str, name: str) -> pa.Table:
    fs, base = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{base}/{name}") as source:
        return pq.read_table(source)


def columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, bytes, offsets) of a run; a missing id is NOBODY."""
    table = table.combine_chunks()
    if not table.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ids = table.column(0).chunk(0).fill_null(NOBODY).to_numpy()
    return (ids, *utf8(table.column(1).chunk(0)))


def rows_of(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types.values())], names=list(types))


def cut_runs(batches, folder: str, size: int, tell: Callable[[str, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Write the rows (doc_id, text) as runs of about `size` bytes of text; what `tell` says of each run.

    A run's name has the attempt in it, and the rows carry the name: rows of one attempt never meet the files of another,
    whose runs may be cut elsewhere if its input came in another order.
    """
    part, number = f"{TaskContext.get().partitionId():07d}-{TaskContext.get().taskAttemptId()}", 0
    waiting: list[pa.RecordBatch] = []
    held = 0

    def finish() -> pa.RecordBatch:
        nonlocal number, waiting, held
        run = f"{part}-{number:04d}"
        table = pa.Table.from_batches(waiting)
        number, waiting, held = number + 1, [], 0
        write_file(folder, f"{run}.parquet", table)
        return tell(run, *columns(table))

    for b in batches:
        _, offsets = utf8(b.column(1))
        lo = 0
        while lo < b.num_rows:
            hi = min(b.num_rows, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size - held, "right")) - 1))
            waiting.append(b.slice(lo, hi - lo))
            held += int(offsets[hi] - offsets[lo])
            lo = hi
            if held >= size or lo < b.num_rows:
                yield finish()
    if waiting:
        yield finish()


def groups(batches, keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of a stream sorted by its leading columns; rows are tuples of the others."""
    rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
    for key, group in itertools.groupby(rows, key=lambda r: r[:keys]):
        yield key, [r[keys:] for r in group]


def pack(*arrays: np.ndarray) -> bytes:
    sink = io.BytesIO()
    for a in arrays:
        np.save(sink, a, allow_pickle=False)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue())


def unpack(blob: bytes, n: int) -> list[np.ndarray]:
    source = io.BytesIO(zstandard.ZstdDecompressor().decompress(blob))
    return [np.load(source, allow_pickle=False) for _ in range(n)]


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending integers below 2^56 as gaps, byte plane by byte plane."""
    gaps = np.diff(values, prepend=values.dtype.type(0)).astype("<u8")
    planes = gaps.view(np.uint8).reshape(-1, 8).T
    return np.int64(len(gaps)).tobytes() + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[:7]).tobytes())


#: Bytes of `pack_sorted` of nothing.
OF_NONE = len(pack_sorted(np.zeros(0, np.uint64)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob[:8], np.int64)[0])
    planes = np.zeros((8, n), np.uint8)
    planes[:7] = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:]), np.uint8).reshape(7, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.uint64), dtype=np.uint64)


def part_of(short: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Parts by ranges of keys of so many bits, so that sorted keys stay sorted by part."""
    return ((short >> np.uint64(bits - 24)).astype(np.int64) * parts) >> 24


def slices(sorted_parts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of ascending part numbers."""
    heads = np.flatnonzero(np.diff(sorted_parts, prepend=-1))
    if not len(heads):
        return
    for lo, hi in zip(heads.tolist(), np.append(heads[1:], len(sorted_parts)).tolist(), strict=True):
        yield int(sorted_parts[lo]), lo, hi
