"""Token ids of documents in sorted-string-table shards.

A shard file holds documents in ascending order of identifier: data blocks, then a block index, a Bloom filter and a
footer of fixed size.

* A block holds entries up to about BLOCK_BYTES. An entry is (length shared with the key before, length of the rest,
  length of the value), the key's rest and the value. The first entry of a block shares nothing. Blocks are compressed
  one by one and carry a CRC-32.
* The index has, for each block, its last key, its place, its entries and its ids, so a lookup is a binary search and one
  block read.
* The Bloom filter has about 10 bits a key and 7 probes.

Keys are the 8 bytes of the signed identifier, shifted so that byte order is number order; a null identifier is the
empty key, which sorts first. Repeated identifiers are kept side by side, in the order of their texts. Values are ids of
2 bytes each while the vocabulary allows, else 4. Null and empty texts have only the end id. Texts of any length
are encoded whole; an empty table has no shard, and extra columns do not matter.
"""

from __future__ import annotations

import bisect
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, scratch_path, small_batches, utf8, whole_number
from .hashing import distinct_words, same_bytes

MAGIC = b"TLSST001"
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 64 << 20
BITS_PER_KEY, PROBES = 10, 7
END_ID = 1
_ENTRY = struct.Struct("<BBI")
_INDEX = struct.Struct("<B8sQIIIQ")
_FOOTER = struct.Struct("<QIQIQQBI8s")
#: Distinct parts of words whose ids a Python worker keeps, and their bytes, at most.
CACHE_WORDS, CACHE_BYTES = 1_000_000, 16 << 20


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_64_intdigest(key)
    a, b = h & 0xFFFFFFFF, (h >> 32) | 1
    return [(a + k * b) % bits for k in range(PROBES)]


class ShardWriter:
    """Entries in ascending key order into one shard, block by block."""

    def __init__(self, sink, width: int = 2) -> None:
        self.sink, self.width = sink, width
        self.at = sink.write(MAGIC) or len(MAGIC)
        self.block: list[bytes] = []
        self.block_bytes = self.block_ids = 0
        self.last = b""
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.ids = 0
        self.packer = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = len(os.path.commonprefix((self.last, key))) if self.block else 0
        value = ids.astype(f"<u{self.width}").tobytes()
        entry = _ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value
        self.block.append(entry)
        self.block_bytes += len(entry)
        self.block_ids += len(ids)
        self.last = key
        self.keys.append(key)
        if self.block_bytes >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.block:
            raw = b"".join(self.block)
            data = struct.pack("<I", zlib.crc32(raw)) + self.packer.compress(raw)
            self.sink.write(data)
            self.index.append(_INDEX.pack(len(self.last), self.last.ljust(8, b"\0"), self.at, len(data), len(raw), len(self.block), self.block_ids))
            self.at += len(data)
            self.ids += self.block_ids
            self.block, self.block_bytes, self.block_ids = [], 0, 0

    def close(self) -> None:
        self._end_block()
        index = b"".join(self.index)
        bits = max(64, BITS_PER_KEY * len(self.keys))
        bloom = bytearray(-(-bits // 8))
        for key in set(self.keys):
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.sink.write(index + bytes(bloom))
        self.sink.write(_FOOTER.pack(self.at, len(index), self.at + len(index), bits, len(self.keys), self.ids, self.width, zlib.crc32(index + bytes(bloom)), MAGIC))


class ShardReader:
    """Lookups and scans of one shard; reads the footer, index and filter, then only the blocks it needs."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        tail = source.read_at(_FOOTER.size, size - _FOOTER.size)
        index_at, index_n, bloom_at, self.bits, self.docs, self.ids, self.width, crc, magic = _FOOTER.unpack(tail)
        if magic != MAGIC:
            raise ValueError("not a shard")
        meta = source.read_at(index_n + -(-self.bits // 8), index_at)
        if zlib.crc32(meta) != crc:
            raise ValueError("damaged index or filter")
        self.index = [(last[:n], at, length, raw, entries, ids) for n, last, at, length, raw, entries, ids in _INDEX.iter_unpack(meta[:index_n])]
        self.bloom = meta[index_n:]

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] & (1 << (p & 7)) for p in _probes(key, self.bits))

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, length, raw, _, _ = self.index[k]
        data = self.source.read_at(length, at)
        plain = zstandard.ZstdDecompressor().decompress(data[4:], max_output_size=raw)
        if zlib.crc32(plain) != struct.unpack("<I", data[:4])[0]:
            raise ValueError("damaged block")
        at, key = 0, b""
        while at < len(plain):
            shared, rest, n = _ENTRY.unpack_from(plain, at)
            at += _ENTRY.size
            key = key[:shared] + plain[at : at + rest]
            yield key, np.frombuffer(plain, f"<u{self.width}", n // self.width, at + rest)
            at += rest + n

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids stored under an identifier: one array for each row that has it."""
        key, out = key_of(doc_id), []
        if self.may_hold(key):
            k = bisect.bisect_left([x[0] for x in self.index], key)
            while k < len(self.index):
                found = [(x, ids) for x, ids in self.block(k)]
                out += [ids for x, ids in found if x == key]
                if found[-1][0] != key:
                    break
                k += 1
        return out

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            for key, ids in self.block(k):
                yield id_of(key), ids


def open_shard(uri: str) -> ShardReader:
    fs, path = pafs.FileSystem.from_uri(uri)
    return ShardReader(fs.open_input_file(path))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in '.,;:!?()"%$&#*']] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: Normaliser and first split of a vocabulary for which texts may be encoded part by part (fixed values).
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_FIRST_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def splittable(config: dict) -> bool:
    """Whether a text's ids are its parts' ids: known steps before the model, and special tokens that begin with <|."""
    steps = config.get("normalizer") == _NORMALIZER and config.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": [_FIRST_SPLIT, _BYTE_LEVEL]}
    return steps and not config.get("truncation") and config["model"]["type"] == "BPE" and not config["model"].get("dropout") and all(t["content"].startswith("<|") for t in config.get("added_tokens", []))


class WordEncoder:
    """Encodes texts part by part with the tokenizers library, each distinct part once.

    Parts end at ASCII white space and between an ASCII letter and one of a few signs: there the vocabulary's own first
    split always cuts, so the parts' ids are the text's ids. It lower-cases too, so parts are told apart in lower case,
    unless the text holds the beginning of a special token, which is matched before that. Parts are told apart by their
    bytes. A vocabulary with other steps (`splittable`) encodes whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.by_parts = splittable(json.loads(self.model.to_str()))
        self.width = 2 if self.model.get_vocab_size() <= 1 << 16 else 4
        self._clear()

    def _clear(self) -> None:
        # known parts by key: their bytes in `text`, their ids in `pool`
        self.keys = np.zeros(0, np.uint64)
        self.text_at, self.text_size, self.ids_at, self.ids_size = (np.zeros(0, np.int64) for _ in range(4))
        self.text = np.zeros(0, np.uint8)
        self.pool = np.zeros(0, f"<u{self.width}")

    def _ids(self, parts: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(parts)
        tokenize, rest = self.model.model.tokenize, []
        for k, part in enumerate(parts):
            # the steps before the model leave lower-case ASCII letters as they are
            if self.by_parts and part.isalpha() and part.islower():
                out[k] = [t.id for t in tokenize(part.decode())]
            else:
                rest.append(k)
        for lo in range(0, len(rest), 4096):
            some = rest[lo : lo + 4096]
            for k, e in zip(some, self.model.encode_batch_fast([parts[k].decode("utf-8", "replace") for k in some], add_special_tokens=False), strict=True):
                out[k] = e.ids
        return out

    def _flat(self, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return sizes, np.fromiter((x for row in ids for x in row), self.pool.dtype, int(sizes.sum()))

    def _places(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool each distinct part's ids stand, and how many; unknown parts are encoded."""
        if len(self.keys) > CACHE_WORDS or len(self.text) > CACHE_BYTES:
            self._clear()
        size = ends - starts
        at, n = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = (self.keys[place] == keys) & (self.text_size[place] == size) if len(self.keys) else np.zeros(len(keys), bool)
        known[known] = same_bytes(np.concatenate((data, self.text)), starts[known], len(data) + self.text_at[place[known]], size[known])
        at[known], n[known] = self.ids_at[place[known]], self.ids_size[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            n[new], ids = self._flat(self._ids([raw[i:j] for i, j in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]))
            at[new] = len(self.pool) + np.cumsum(n[new]) - n[new]
            self.pool = np.concatenate((self.pool, ids))
            # a part whose key another one has already is encoded anew each time
            new = new[np.unique(keys[new], return_index=True)[1]]
            new = new[self.keys[np.minimum(np.searchsorted(self.keys, keys[new]), len(self.keys) - 1)] != keys[new]] if len(self.keys) else new
            to = np.searchsorted(self.keys, keys[new])
            text_at = len(self.text) + np.cumsum(size[new]) - size[new]
            self.text = np.concatenate([self.text, *(data[i:j] for i, j in zip(starts[new].tolist(), ends[new].tolist(), strict=True))])
            self.keys = np.insert(self.keys, to, keys[new])
            self.text_at, self.text_size = np.insert(self.text_at, to, text_at), np.insert(self.text_size, to, size[new])
            self.ids_at, self.ids_size = np.insert(self.ids_at, to, at[new]), np.insert(self.ids_size, to, n[new])
        return at, n

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and the rows' offsets in them."""
        if not len(data):
            return self.pool[:0], np.zeros(len(offsets), np.int64)
        raw = data.tobytes()
        if not self.by_parts:
            sizes, ids = self._flat(self._ids([raw[i:j] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]))
            return ids, np.concatenate(([0], np.cumsum(sizes)))
        if b"<|" not in raw:
            data = _LOWER[data]
            raw = data.tobytes()
        letter, sign, inside = _LETTER[data], _SIGN[data], ~_SPACE[data]
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = ~inside[:-1] | ~inside[1:] | (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        filled = inside[starts]
        starts, ends = starts[filled], ends[filled]
        first = np.searchsorted(starts, offsets)
        if not len(starts):
            return self.pool[:0], first
        keys, example, inverse = distinct_words(data, starts, ends)
        ids_at, n = self._places(data, keys, starts[example], ends[example])
        size = n[inverse]
        before = np.concatenate(([0], np.cumsum(size)))
        ids = self.pool[np.repeat(ids_at[inverse] - before[:-1], size) + np.arange(before[-1])]
        return ids, before[first]


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One for each Python worker, so that what one task has learned serves the next."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


_MANIFEST = "path string, part int, roll int, docs long, ids long"


def write(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encode every text and write shards in ascending identifier order; one row per shard, with `start`, the ids before it.

    Rows are dealt by ranges of the identifier, ties by text, and sorted within each range, so shard after shard is in
    order. A task writes each shard under a name of its own and renames it when it is whole: a task that runs again puts
    an equal file in its place. Only the manifest, a row per shard, comes to the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = scratch_path(spark, "sst")

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        encoder, writer, roll, done = _encoder(tokenizer), None, 0, []

        def finish():
            writer.close()
            writer.sink.close()
            fs.move(f"{base}/.{part}-{roll}-{attempt}", f"{base}/{part:06d}-{roll:04d}.sst")
            done.append((f"{folder}/{part:06d}-{roll:04d}.sst", part, roll, len(writer.keys), writer.ids))

        for b in batches:
            data, offsets = utf8(b.column(1))
            keys = [key_of(i) for i in b.column(0).to_pylist()]
            lo = 0
            while lo < len(keys):  # some MB of text at a time
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + (2 << 20), "right")) - 1)
                ids, at = encoder.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for k in range(lo, hi):
                    if writer is None:
                        writer = ShardWriter(fs.open_output_stream(f"{base}/.{part}-{roll}-{attempt}"), encoder.width)
                    writer.add(keys[k], np.append(ids[at[k - lo] : at[k - lo + 1]], end_id))
                    if writer.at >= SHARD_BYTES:
                        finish()
                        writer, roll = None, roll + 1
                lo = hi
        if writer is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["path", "part", "roll", "docs", "ids"])

    ordered = docs.select(whole_number(docs, id_col).alias("id"), F.col(text_col).alias("text")).repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    rows = sorted(ordered.mapInArrow(releasing(run), _MANIFEST).collect(), key=lambda r: (r.part, r.roll))
    out, start = [], 0
    for r in rows:
        out.append((*r, start))
        start += r.ids
    return spark.createDataFrame(out, f"{_MANIFEST}, start long").repartition(max(1, len(out)), "path")


def read(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every stored document: id, the ids before it in the whole corpus, and its ids."""

    def run(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader = open_shard(path)
                for k in range(len(reader.index)):
                    entries = list(reader.block(k))
                    sizes = np.array([len(v) for _, v in entries])
                    starts = start + np.concatenate(([0], np.cumsum(sizes)[:-1]))
                    start += int(sizes.sum())
                    ids = pa.array(np.concatenate([v for _, v in entries]).astype(np.int32))
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), ids)
                    yield pa.RecordBatch.from_arrays([pa.array([id_of(x) for x, _ in entries], pa.int64()), pa.array(starts), lists], names=[id_col, "start", "ids"])

    return manifest.select("path", "start").mapInArrow(run, f"`{id_col}` long, start long, ids array<int>")


def digest(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per stored document: the ids before it, its ids' number and their CRC-32 as little-endian 32-bit integers."""

    def run(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader = open_shard(path)
                for k in range(len(reader.index)):
                    out = []
                    for key, ids in reader.block(k):
                        out.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return manifest.select("path", "start").mapInArrow(releasing(run), f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, ids) of the wanted identifiers: each shard's filter, index and one block answer for it.

    The shards' key ranges, a row a shard, are searched for each identifier on the executors; what a shard may hold is
    then looked up together. Identifiers that no range holds, and null, are left out.
    """
    ranges = sorted(manifest.select("path").mapInArrow(_ranges, "path string, lo long, hi long").collect(), key=lambda r: r.path)
    paths = [r.path for r in ranges]
    low, high = (np.array([r[k] for r in ranges], np.int64) for k in ("lo", "hi"))

    def deal(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            # shards are in key order, so those that may hold an identifier stand side by side
            first, last = np.searchsorted(high, ids), np.searchsorted(low, ids, "right")
            out = [(int(i), paths[k]) for i, f, e in zip(ids, first.tolist(), last.tolist(), strict=True) for k in range(f, e)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([p for _, p in out], pa.string())], names=["id", "path"])

    def run(batches):
        open_path, reader = None, None
        for b in batches:
            out = []
            for i, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if path != open_path:
                    open_path, reader = path, open_shard(path)
                out += [(i, ids.astype(np.int32).tolist()) for ids in reader.get(i)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([v for _, v in out], pa.list_(pa.int32()))], names=[id_col, "ids"])

    keys = wanted.select(whole_number(wanted, id_col).alias("id")).filter("id is not null").distinct()
    return keys.mapInArrow(deal, "id long, path string").repartition("path").sortWithinPartitions("path", "id").mapInArrow(run, f"`{id_col}` long, ids array<int>")


def _ranges(batches):
    for b in batches:
        out = []
        for path in b.column(0).to_pylist():
            reader = open_shard(path)
            first = next((i for k in range(len(reader.index)) for i in (id_of(x) for x, _ in reader.block(k)) if i is not None), None)
            last = id_of(reader.index[-1][0])
            if first is not None and last is not None:
                out.append((path, first, last))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "lo", "hi"])
