"""Sampled subword segmentations by forward filtering and backward sampling over the piece lattice.

A text, with the model's leading space, is cut into words: a run of spaces with the letters after it, or a line break.
No piece of the model may cross such a cut (a model with one is refused), so a word's lattice stands alone and is built
once per distinct word, words being told apart by their bytes: every piece that matches at a place is an edge, and bytes
of characters that have no piece of their own are byte-fallback edges. Forward filtering sums the weights of all segmentations up to each place; backward sampling walks from a word's end,
drawing each edge with its share of that sum. Draws are a hash of (seed, row key, word number, step), so a row's
segmentation depends on nothing else, wherever and however often it is computed. Decoding joins the pieces' bytes.

A model with log-probabilities (unigram) uses them; a merge-rank model gets log p = -log(rank + SHIFT) up to a constant.
Null and empty texts have no pieces. Texts need not be valid in any way: bytes without a piece fall back. A null row key
counts as 0. Equal rows get equal segmentations. Every text is decoded again; one that did not come back would end the
job. Texts of any length are segmented whole; extra columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, small_batches, utf8
from .hashing import distinct_words, mix

SHIFT = 10.0
BYTE_LOSS = 12.0
#: Distinct words whose lattices a task keeps, and their bytes, at most; and how many are built at once.
CACHE_WORDS, CACHE_BYTES, BUILD_WORDS = 100_000, 2 << 20, 10_000
BATCH_BYTES = 1 << 20


def _segments(sizes: np.ndarray) -> tuple[np.ndarray, int]:
    before = np.concatenate(([0], np.cumsum(sizes)))
    return before[:-1], int(before[-1])


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[k] .. starts[k] + sizes[k] for every k, end to end."""
    before, total = _segments(sizes)
    return np.repeat(starts - before, sizes) + np.arange(total)


def _cuts(text: np.ndarray) -> np.ndarray:
    """Whether a word begins at each byte but the first: at a space behind another byte, and around a line break."""
    space, line = text == 32, text == 10
    cut = np.zeros(len(text), bool)
    cut[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    return cut


class PieceModel:
    """Pieces, their log-weights and a byte trie, from a SentencePiece model file."""

    def __init__(self, path: str, temperature: float = 1.0) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces, scores = [b""] * n, np.zeros(n)
        self.byte_id = np.zeros(256, np.int64)
        plain = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_id[value] = i
                pieces[i] = bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces[i] = piece.replace("▁", " ").encode()
                plain.append(i)
            scores[i] = sp.get_score(i)
        ranked = min((scores[i] for i in plain), default=0) < -1000
        weights = np.where(scores < -1e8, -np.log(100 + SHIFT), -np.log(SHIFT - np.maximum(scores, -1e8))) if ranked else scores
        self.weights = weights / temperature
        self.byte_weight = (float(self.weights[plain].min()) if plain else 0.0) - BYTE_LOSS / temperature
        self.pool = np.frombuffer(b"".join(pieces), np.uint8)
        self.size = np.array([len(p) for p in pieces])
        self.start, _ = _segments(self.size)
        self.longest = int(self.size.max(initial=1))
        crossing = [i for i in plain if _cuts(np.frombuffer(pieces[i], np.uint8)).any()]
        if crossing:
            raise ValueError(f"{len(crossing)} pieces of the model stand across word cuts, such as {pieces[crossing[0]]!r}")
        self._build_trie([(pieces[i], i) for i in plain])

    def _build_trie(self, pieces: list[tuple[bytes, int]]) -> None:
        used = sorted({b for p, _ in pieces for b in p})
        self.kind = np.zeros(256, np.int32)
        self.kind[used] = np.arange(1, len(used) + 1)
        children: list[dict[int, int]] = [{}, {}]  # 0 is nowhere, 1 the root
        ends = {}
        for p, i in pieces:
            node = 1
            for b in p:
                step = children[node].get(b)
                if step is None:
                    step = children[node][b] = len(children)
                    children.append({})
                node = step
            ends[node] = i
        self.step = np.zeros((len(children), len(used) + 1), np.int32)
        for node, table in enumerate(children):
            for b, to in table.items():
                self.step[node, self.kind[b]] = to
        self.piece_at = np.full(len(children), -1, np.int32)
        self.piece_at[list(ends)] = list(ends.values())

    def edges(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every match within the words data[offsets[k]:offsets[k+1]], fallback bytes included."""
        end_of = np.repeat(offsets[1:], np.diff(offsets))
        at = np.arange(len(data))
        node = np.ones(len(data), np.int32)
        starts, ends, found = [], [], []
        for k in range(self.longest):
            inside = at + k < end_of[at]
            at, node = at[inside], node[inside]
            node = self.step[node, self.kind[data[at + k]]]
            alive = node > 0
            at, node = at[alive], node[alive]
            if not len(at):
                break
            piece = self.piece_at[node]
            hit = piece >= 0
            starts.append(at[hit])
            ends.append(at[hit] + k + 1)
            found.append(piece[hit])
        start, end, piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends, found))
        size = np.where(data < 0x80, 1, np.where(data >= 0xF0, 4, np.where(data >= 0xE0, 3, np.where(data >= 0xC0, 2, 0))))
        whole = end - start == size[start]
        covered = np.bincount(start[whole], minlength=len(data) + 1) - np.bincount(end[whole], minlength=len(data) + 1)
        bare = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
        return np.concatenate((start, bare)), np.concatenate((end, bare + 1)), np.concatenate((piece, self.byte_id[data[bare]]))


class Sampler:
    """Segments batches of texts; keeps the lattices of the words it has seen."""

    def __init__(self, model: PieceModel, seed: int = 0) -> None:
        self.model, self.seed = model, seed
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.held = 0
        self.word_end: list[np.ndarray] = []  # each word's last node
        self.word_first: list[np.ndarray] = []
        self.first_edge: list[np.ndarray] = []  # by node
        self.share: list[np.ndarray] = []  # by edge: cumulative share among the edges into its end
        self.piece: list[np.ndarray] = []
        self.length: list[np.ndarray] = []
        self.nodes = self.edge_count = 0
        self._joined: tuple | None = None

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: list[bytes]) -> None:
        for lo in range(0, len(starts), BUILD_WORDS):
            sizes = ends[lo : lo + BUILD_WORDS] - starts[lo : lo + BUILD_WORDS]
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            self._filter_forward(data[ragged(starts[lo : lo + BUILD_WORDS], sizes)], offsets)
        for w in words:
            self.place[w] = len(self.place)
            self.held += len(w)
        self._joined = None

    def _filter_forward(self, data: np.ndarray, offsets: np.ndarray) -> None:
        model, n_words = self.model, len(offsets) - 1
        word = np.repeat(np.arange(n_words), np.diff(offsets))
        start, end, piece = model.edges(data, offsets)
        w = word[start]
        depth = end - offsets[w]
        order = np.argsort(depth * (len(data) + n_words + 1) + end + w, kind="stable")
        start, end, piece, w, depth = start[order], end[order], piece[order], w[order], depth[order]
        a, b = start + w, end + w
        weight = np.where(np.isin(piece, model.byte_id), model.byte_weight, model.weights[piece])
        nodes = len(data) + n_words
        total = np.full(nodes, -np.inf)
        total[offsets[:-1] + np.arange(n_words)] = 0.0
        share = np.empty(len(b))
        level = np.searchsorted(depth, np.arange(1, int(depth.max(initial=0)) + 2))
        for lo, hi in zip(level[:-1].tolist(), level[1:].tolist(), strict=True):
            if lo == hi:
                continue
            into = b[lo:hi]
            heads = np.flatnonzero(np.concatenate(([True], into[1:] != into[:-1])))
            counts = np.diff(np.append(heads, hi - lo))
            value = total[a[lo:hi]] + weight[lo:hi]
            top = np.maximum.reduceat(value, heads)
            top = np.where(np.isfinite(top), top, 0.0)
            part = np.exp(value - np.repeat(top, counts))
            whole = np.add.reduceat(part, heads)
            with np.errstate(divide="ignore"):
                total[into[heads]] = top + np.log(whole)
            running = np.cumsum(part)
            base = np.repeat(running[heads] - part[heads], counts)
            share[lo:hi] = (running - base) / np.repeat(np.maximum(whole, 1e-300), counts)
        # edges by end node, for the walk back
        order = np.argsort(b, kind="stable")
        count = np.bincount(b, minlength=nodes)
        self.first_edge.append((np.cumsum(count) - count + self.edge_count).astype(np.int64))
        last = np.cumsum(count)[count > 0] - 1
        share = share[order].astype(np.float32)
        share[last] = 2.0  # whatever is left falls to a node's last edge
        self.share.append(share)
        self.piece.append(piece[order].astype(np.int32))
        self.length.append((end - start)[order].astype(np.int32))
        self.word_first.append(offsets[:-1] + np.arange(n_words) + self.nodes)
        self.word_end.append(offsets[1:] + np.arange(n_words) + self.nodes)
        self.nodes += nodes
        self.edge_count += len(b)

    def _tables(self) -> tuple:
        if self._joined is None:
            parts = (self.word_first, self.word_end, self.first_edge, self.share, self.piece, self.length)
            self._joined = tuple(np.concatenate(p) for p in parts)
            for p, whole in zip(parts, self._joined, strict=True):
                p[:] = [whole]
        return self._joined

    def encode(self, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all rows end to end, and the rows' offsets in them. keys: an integer of each row."""
        size = np.diff(offsets)
        shift = np.concatenate(([0], np.cumsum(size > 0)))
        text = np.full(len(data) + int(shift[-1]), 32, np.uint8)
        text[np.arange(len(data)) + np.repeat(shift[1:], size)] = data
        at = offsets + shift
        if not len(text):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        cut = _cuts(text)
        cut[at[:-1][size > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(text))
        first = np.searchsorted(starts, at)
        if len(self.place) > CACHE_WORDS or self.held > CACHE_BYTES:
            self._clear()
        _, example, inverse = distinct_words(text, starts, ends)
        raw = text.tobytes()
        known = [raw[i:j] for i, j in zip(starts[example].tolist(), ends[example].tolist(), strict=True)]
        new = [k for k, w in enumerate(known) if w not in self.place]
        if new:
            self._learn(text, starts[example[new]], ends[example[new]], [known[k] for k in new])
        word = np.fromiter((self.place[w] for w in known), np.int64, len(known))[inverse]
        return self._sample_back(word, first, keys)

    def _sample_back(self, word: np.ndarray, first: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word_first, word_end, first_edge, share, piece, length = self._tables()
        counts = np.diff(first)
        row = np.repeat(np.arange(len(counts)), counts)
        nth = (np.arange(len(word)) - first[row]).astype(np.uint64)
        with np.errstate(over="ignore"):
            seeds = mix(keys.astype(np.uint64) + np.uint64((self.seed * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF))
            state = mix(seeds[row] ^ (nth * np.uint64(0xD1342543DE82EF95)))
        active, node = np.arange(len(word)), word_end[word]
        stop = word_first[word]
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        taken = np.zeros(len(word), np.int64)
        while len(active):
            with np.errstate(over="ignore"):
                state[active] += np.uint64(0x9E3779B97F4A7C15)
            u = (mix(state[active]) >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)
            edge = first_edge[node]
            wait = np.flatnonzero(u >= share[edge])
            while len(wait):
                edge[wait] += 1
                wait = wait[u[wait] >= share[edge[wait]]]
            steps.append((active, piece[edge]))
            taken[active] += 1
            node = node - length[edge]
            more = node > stop[active]
            active, node = active[more], node[more]
        before, total = _segments(taken)
        out = np.empty(total, np.int32)
        last = before + taken - 1
        for k, (which, ids) in enumerate(steps):
            out[last[which] - k] = ids
        return out, np.append(before, total)[first]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts' bytes end to end, without the leading space, and the rows' offsets in them."""
        size = self.model.size[ids]
        before = np.concatenate(([0], np.cumsum(size)))
        data = self.model.pool[ragged(self.model.start[ids], size)]
        at = before[offsets]
        filled = np.diff(at) > 0
        keep = np.ones(len(data), bool)
        keep[at[:-1][filled]] = False
        return data[keep], at - np.concatenate(([0], np.cumsum(filled)))


_MODELS: dict[tuple, PieceModel] = {}


def _model(path: str, temperature: float) -> PieceModel:
    if (path, temperature) not in _MODELS:
        _MODELS[path, temperature] = PieceModel(path, temperature)
    return _MODELS[path, temperature]


def _encoded(batches, path: str, seed: int, temperature: float):
    """(ids of the rows, their keys' column, data, offsets, piece ids, piece offsets, sampler) of parts of some MB."""
    sampler = Sampler(_model(path, temperature), seed)
    for b in batches:
        data, offsets = utf8(b.column(1))
        keys = b.column(2).to_numpy(zero_copy_only=False)
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BATCH_BYTES, "right")) - 1)
            part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            ids, piece_at = sampler.encode(part, at, keys[lo:hi])
            yield b.column(0).slice(lo, hi - lo), part, at, ids, piece_at, sampler
            lo = hi


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key = F.coalesce(F.xxhash64(F.col(id_col)), F.lit(0).cast("long"))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), key.alias("key"))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, temperature: float = 1.0) -> DataFrame:
    """(id, ids): a sampled segmentation of every text."""
    small_batches(docs.sparkSession)

    def run(batches):
        for names, _, _, ids, at, _ in _encoded(batches, model, seed, temperature):
            yield pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _keyed(docs, id_col, text_col).mapInArrow(releasing(run), f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) from piece ids."""
    small_batches(encoded.sparkSession)

    def run(batches):
        sampler = Sampler(_model(model, 1.0))
        for b in batches:
            lists = b.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.to_numpy()[offsets[0] : offsets[-1]]
            data, at = sampler.decode(ids, offsets - offsets[0])
            raw = data.tobytes()
            out = [raw[i:j].decode() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(releasing(run), f"`{id_col}` {kind}, text string")


def _rows_of_batches(batches, model: str, seed: int, temperature: float, id_col: str):
    """`training_rows` of batches (id, text, key)."""
    for names, data, at, ids, piece_at, sampler in _encoded(batches, model, seed, temperature):
        back, back_at = sampler.decode(ids, piece_at)
        raw, source = back.tobytes(), data.tobytes()
        packed = ids.astype("<u4").tobytes()
        rows = []
        for k in range(len(at) - 1):
            text = raw[back_at[k] : back_at[k + 1]]
            if text != source[at[k] : at[k + 1]]:
                raise ValueError(f"row {names[k].as_py()} does not come back from its pieces")
            rows.append((int(piece_at[k + 1] - piece_at[k]), zlib.crc32(packed[4 * piece_at[k] : 4 * piece_at[k + 1]]), hashlib.sha256(text).hexdigest(), True))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        lists = pa.ListArray.from_arrays(pa.array(piece_at.astype(np.int32)), pa.array(ids))
        yield pa.RecordBatch.from_arrays([names, lists] + [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)], names=[id_col, "ids", "n_tokens", "ids_crc32", "decoded_sha256", "lossless"])


def training_rows(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, temperature: float = 1.0) -> DataFrame:
    """Per text: piece ids, their number, a checksum of them as little-endian 32-bit integers, and what decoding them gives back.

    A text that decoding doesn't give back ends the job with an error.
    """
    small_batches(docs.sparkSession)
    run = releasing(lambda batches: _rows_of_batches(batches, model, seed, temperature, id_col))
    kind = docs.schema[id_col].dataType.simpleString()
    return _keyed(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean")


def digest(docs: DataFrame, model: str, **options) -> DataFrame:
    """`training_rows` without the ids themselves."""
    return training_rows(docs, model, **options).drop("ids")
