"""Language identification by a byte convolutional network, in numpy.

A text's UTF-8 bytes are cut into windows of WINDOW bytes (whole texts, the last window padded with zeros). Filters of
several widths slide over each window; each filter's largest response in the window, rectified, feeds a softmax. A text's
prediction is the language with the largest sum of log-probabilities over its windows, weighted by their bytes.

The network is trained on at most PER_LANGUAGE windows of each language, from labelled documents outside the held-out
fold (those of smallest hash). Null texts and texts without a letter are `und` with score 0, so are all texts if there
is no labelled text. Repeated rows get equal predictions and count once in training; ties go to the first language in
alphabetical order. Texts of any length are read whole, some windows at a time; extra columns do not matter; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, utf8

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
PER_LANGUAGE = 1500
EPOCHS = 6
#: Windows that one training document gives, at most.
PER_DOCUMENT = 4
_LETTER = regex.compile(r"\p{L}")


@dataclass
class ByteConv:
    """filters[w][k]: the response to byte b at place k of a filter of width w, for each of FILTERS filters."""

    languages: list[str]
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    weight: np.ndarray
    offset: np.ndarray
    pairs: dict[int, list[np.ndarray]] | None = None

    def _responses(self, x: np.ndarray, width: int) -> np.ndarray:
        """Windows x places x FILTERS."""
        n = x.shape[1] - width + 1
        tables = self.pairs[width] if self.pairs else list(self.filters[width])
        at, out = 0, None
        for table in tables:
            if len(table) > 256:
                index = (x[:, at : at + n].astype(np.int32) << 8) | x[:, at + 1 : at + 1 + n]
                at += 2
            else:
                index = x[:, at : at + n]
                at += 1
            part = table.take(index, axis=0)
            out = part if out is None else np.add(out, part, out=out)
        return out

    def pooled(self, x: np.ndarray) -> np.ndarray:
        top = [self._responses(x, w).max(axis=1) for w in WIDTHS]
        return np.maximum(np.concatenate(top, axis=1) + self.bias, 0)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x) @ self.weight + self.offset
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def for_inference(self) -> ByteConv:
        """The same network with the tables of neighbouring places joined, so that a response takes fewer look-ups."""
        pairs = {}
        for w in WIDTHS:
            parts = [self.filters[w][k] for k in range(w)]
            joined = [(parts[k][:, None, :] + parts[k + 1][None, :, :]).reshape(-1, FILTERS) for k in range(0, w - 1, 2)]
            pairs[w] = joined + ([parts[-1]] if w % 2 else [])
        return ByteConv(self.languages, self.filters, self.bias, self.weight, self.offset, pairs)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 1) -> ByteConv:
    """Windows x (n, WINDOW) with language numbers y; Adam on the cross-entropy."""
    rng = np.random.default_rng(seed)
    net = ByteConv(
        languages,
        {w: (rng.standard_normal((w, 256, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS},
        np.zeros(len(WIDTHS) * FILTERS, np.float32),
        (rng.standard_normal((len(WIDTHS) * FILTERS, len(languages))) * 0.1).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    params = [net.filters[w] for w in WIDTHS] + [net.bias, net.weight, net.offset]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 64):
            rows = order[lo : lo + 64]
            xb, yb = x[rows], y[rows]
            top, at = [], []
            for w in WIDTHS:
                response = net._responses(xb, w)
                where = response.argmax(axis=1)
                at.append(where)
                top.append(np.take_along_axis(response, where[:, None, :], axis=1)[:, 0])
            before = np.concatenate(top, axis=1) + net.bias
            hidden = np.maximum(before, 0)
            z = hidden @ net.weight + net.offset
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), yb] -= 1
            p /= len(rows)
            back = (p @ net.weight.T) * (before > 0)
            grads = []
            for i, w in enumerate(WIDTHS):
                g = np.zeros_like(net.filters[w])
                part = back[:, i * FILTERS : (i + 1) * FILTERS]
                for k in range(w):
                    byte = np.take_along_axis(xb, at[i] + k, axis=1)
                    np.add.at(g[k], (byte, np.arange(FILTERS)[None, :]), part)
                grads.append(g)
            grads += [back.sum(0), hidden.T @ p, p.sum(0)]
            step += 1
            for q, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net.for_inference()


def windows(data: np.ndarray, offsets: np.ndarray, some: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Padded windows (n, WINDOW) of all rows, the row each belongs to and its bytes, `some` windows at a time."""
    size = np.diff(offsets)
    before = np.concatenate(([0], np.cumsum(-(-size // WINDOW))))
    for lo in range(0, int(before[-1]), some):
        which = np.arange(lo, min(lo + some, int(before[-1])))
        row = np.searchsorted(before, which, "right") - 1
        start = offsets[row] + (which - before[row]) * WINDOW
        length = np.minimum(WINDOW, offsets[row + 1] - start)
        x = data[np.minimum(start[:, None] + np.arange(WINDOW), len(data) - 1)]
        x[np.arange(WINDOW) >= length[:, None]] = 0
        yield x, row, length


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """At most per_language windows of each language, of labelled documents outside the held-out fold."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    few = per_language // PER_DOCUMENT + 1
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen = chosen | ((F.col("lang") == lang) & (draw < int(1_000_003 * min(1.0, few / n)) + 1))
    # PER_DOCUMENT windows of a document, spread over its whole text
    span = F.greatest(F.floor(F.octet_length("text") / PER_DOCUMENT), F.lit(WINDOW)).cast("int")
    parts = F.array(*[F.substring(F.col("text").cast("binary"), F.lit(1) + k * span, F.lit(WINDOW)) for k in range(PER_DOCUMENT)])
    languages = sorted(sizes)
    # rows that share a doc_id count once, so that no more rows come here than documents were drawn
    rows = known.filter(chosen).groupBy("lang", "doc_id").agg(F.min(parts).alias("parts")).collect()
    rows.sort(key=lambda r: (r[0], str(r[1]), [bytes(p) for p in r[2]]))
    got: list[tuple[bytes, int]] = []
    taken = dict.fromkeys(languages, 0)
    for lang, _, cut in rows:
        for part in map(bytes, cut):
            if taken[lang] < per_language and len(part) >= 16:
                taken[lang] += 1
                got.append((part.ljust(WINDOW, b"\0"), languages.index(lang)))
    x = np.frombuffer(b"".join(p for p, _ in got), np.uint8).reshape(-1, WINDOW)
    return x, np.array([n for _, n in got], np.int64), languages


def fit(docs: DataFrame) -> ByteConv | None:
    x, y, languages = training_sample(docs)
    return train(x, y, languages) if len(x) else None


def predict(docs: DataFrame, net: ByteConv | None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The kept columns, `lang_pred` and `score` between 0 and 1."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = shared.value
        for b in batches:
            column = b.column(len(keep))
            data, offsets = utf8(column)
            letters = np.array([bool(t) and _LETTER.search(t) is not None for t in column.to_pylist()], bool)
            n = len(letters)
            langs, scores = np.full(n, "und", object), np.zeros(n)
            if net is not None and n:
                total = np.zeros((n, len(net.languages)))
                weight = np.zeros(n)
                for x, row, length in windows(data, offsets):
                    np.add.at(total, row, net.log_probabilities(x) * length[:, None])
                    np.add.at(weight, row, length)
                mean = total / np.maximum(weight, 1)[:, None]
                best = mean.argmax(axis=1)
                share = np.exp(mean[np.arange(n), best]) / np.exp(mean).sum(axis=1)
                langs[letters] = np.array(net.languages, object)[best[letters]]
                scores[letters] = share[letters]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(len(keep))] + [pa.array(langs, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["lang_pred string", "score double"])
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)
