"""Benchmark decontamination: BM25 retrieval of test items for every passage, then overlap checks.

The test items are the indexed documents, every training passage is a query. Words are lower-case runs of letters and
digits. A score is the share of an item's own BM25 score that the passage's words reach, so one threshold serves items of
any length. Items are in classes by length, up to 64, 256, 1,024 words and so on; for a class of up to n words a passage
is a window of 2 n words, half overlapping, so that an item of any length stands whole in one passage.

Retrieval finds every item that reaches the threshold in a passage:

* An item's rare terms are its rarest, up to RARE of its score. What the others cannot reach must come from them. Shares
  of rare terms are summed for all passages of a batch at once; a passage where no item gets what it must is done.
* The others go through block-max WAND: a cursor on each term's list of items, in item order; the pivot is the first
  item at which the lists' largest shares add up to the threshold; the pivot is scored only if the largest shares in its
  block of BLOCK items do so too, and whole blocks are skipped where they do not.

A retrieved item is a leak if the passage holds at least QUESTION of the question's word trigrams and ANSWER of the
answer's words. Both are compared word by word, over the whole item. An item's answer is its last sentence, the question
what stands before; an item of one sentence is cut after two thirds of its words.

Numbers of items, their mean length and the terms' frequencies are those of all items. Indexes are made from about
INDEX_BYTES of item text each, which bounds what is broadcast; more items take more passes, with the same results.

Null and empty texts, on either side, match nothing. Equal items all match. A document's row is judged alone, so repeated
rows give repeated results, and rows without an id are judged like others. Texts and items of any length are taken
whole. Extra columns do not matter. Without items, or without documents, nothing matches.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import blocks, releasing, small_batches, texts
from .hashing import word_keys, word_spans

THRESHOLD = 0.5
QUESTION, ANSWER = 0.6, 0.6
K1, B = 1.2, 0.75
BLOCK = 16
#: The share of an item's score that its rare terms have, at least.
RARE = 0.75
#: Longest item of the first class of lengths; each further class takes items four times as long.
SHORT = 64
INDEX_BYTES = 32 << 20
#: Postings that a task keeps as lists, and items that it keeps as words, at most.
CACHE_POSTINGS, CACHE_ITEMS = 1_000_000, 2_000
_SURE = 1e-9

_SEPARATOR = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def encoded(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def words_of(text: str) -> list[bytes]:
    """The lower-case words, in order."""
    data = encoded(text)
    starts, ends, _ = word_spans(np.frombuffer(data, np.uint8), np.array([0, len(data)]), _SEPARATOR)
    return [data[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]


def trigrams(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """Runs of three words; a shorter sequence is one run."""
    return {tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))} if words else set()


def split_item(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of the question and of the answer."""
    sentences = [w for s in _SENTENCE.split(text) if (w := words_of(s))]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    only = sentences[0] if sentences else []
    cut = -(-2 * len(only) // 3)
    return only[:cut], only[cut:] or only[-1:]


@dataclass
class Statistics:
    """Of all items with a word: how many, their mean words, and in how many each word stands."""

    items: int
    average: float
    words: np.ndarray  # sorted keys
    counts: np.ndarray


@dataclass
class Index:
    """Items of one class of lengths."""

    stride: int
    items: list
    texts: list[str]
    whole: np.ndarray  # each item's own score
    vocabulary: np.ndarray  # sorted word keys
    post_start: np.ndarray  # by term, into the postings, which are in item order
    post_item: np.ndarray
    post_share: np.ndarray  # of the item's own score
    top: np.ndarray  # by term: the largest share
    rare_start: np.ndarray  # by term, into the postings in which it is a rare term
    rare_item: np.ndarray
    rare_part: np.ndarray  # its share, as a part of what the item's rare terms must reach
    lists: dict[int, tuple] = field(default_factory=dict)
    split: dict[int, tuple] = field(default_factory=dict)
    held: int = 0

    def __getstate__(self):
        return self.__dict__ | {"lists": {}, "split": {}, "held": 0}

    def postings(self, term: int) -> tuple[list[int], list[float], dict[int, float], float]:
        """A term's items, their shares, the largest share in each block of items, and of all."""
        if term not in self.lists:
            lo, hi = int(self.post_start[term]), int(self.post_start[term + 1])
            if self.held > CACHE_POSTINGS:
                self.lists, self.held = {}, 0
            self.held += hi - lo
            items, shares = self.post_item[lo:hi].tolist(), self.post_share[lo:hi].tolist()
            most: dict[int, float] = {}
            for i, x in zip(items, shares, strict=True):
                most[i // BLOCK] = max(x, most.get(i // BLOCK, 0.0))
            self.lists[term] = items, shares, most, float(self.top[term])
        return self.lists[term]

    def parts(self, item: int) -> tuple[set, set]:
        """The question's trigrams and the answer's words."""
        if item not in self.split:
            if len(self.split) >= CACHE_ITEMS:
                self.split = {}
            question, answer = split_item(self.texts[item])
            self.split[item] = trigrams(question), set(answer)
        return self.split[item]


def _bags(rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, word key, times) of the rows' distinct words, by row and key, and the rows' words."""
    raw = [encoded(t) for t in rows]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in raw]))).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, first = word_spans(data, offsets, _SEPARATOR)
    keys, length = word_keys(data, starts, ends), np.diff(first)
    row = np.repeat(np.arange(len(rows)), length)
    order = np.lexsort((keys, row))
    keys, row = keys[order], row[order]
    head = np.ones(len(keys), bool)
    head[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
    heads = np.flatnonzero(head)
    return row[heads], keys[heads], np.diff(np.append(heads, len(keys))), length


def statistics(rows: list[str]) -> Statistics:
    row, keys, _, length = _bags(rows)
    words, counts = np.unique(keys, return_counts=True)
    n = int((length > 0).sum())
    return Statistics(n, float(length.sum()) / max(1, n), words, counts)


def class_of(words: int) -> int:
    """Longest items of the class that takes items of so many words."""
    longest = SHORT
    while longest < words:
        longest *= 4
    return longest


def build(rows: list[tuple], of_all: Statistics | None = None) -> list[Index]:
    """Indexes of (item_id, text) rows, one for each class of lengths; of_all: the statistics, if there are more items."""
    rows = [(i, t) for i, t in rows if t]
    known = of_all or statistics([t for _, t in rows])
    sizes = _bags([t for _, t in rows])[3].tolist()
    out = []
    for longest in sorted({class_of(n) for n in sizes if n}):
        mine = [k for k, n in enumerate(sizes) if n and class_of(n) == longest]
        out.append(_index(longest, [rows[k] for k in mine], known))
    return out


def _index(stride: int, rows: list[tuple], known: Statistics) -> Index:
    item, keys, times, length = _bags([t for _, t in rows])
    df = known.counts[np.searchsorted(known.words, keys)]
    idf = np.log(1 + (known.items - df + 0.5) / (df + 0.5))
    norm = K1 * (1 - B + B * length / known.average)
    score = idf * times * (K1 + 1) / (times + norm[item])
    whole = np.bincount(item, score, len(rows))
    share = score / whole[item]
    # rare terms: from the rarest on, until they have RARE of the item's score
    order = np.lexsort((keys, df, item))
    running = np.cumsum(share[order])
    first = np.searchsorted(item[order], np.arange(len(rows)))
    before = running - share[order] - (running - share[order])[first][item[order]]
    is_rare = np.zeros(len(keys), bool)
    is_rare[order] = before < RARE
    must = THRESHOLD - (1 - np.bincount(item[is_rare], share[is_rare], len(rows)))
    vocabulary, term = np.unique(keys, return_inverse=True)
    by_term = np.lexsort((item, term))
    rare = by_term[is_rare[by_term]]
    places = np.arange(len(vocabulary) + 1)
    starts = np.searchsorted(term[by_term], places)
    return Index(
        stride, [i for i, _ in rows], [t for _, t in rows], whole, vocabulary, starts, item[by_term], share[by_term], np.maximum.reduceat(share[by_term], starts[:-1]),
        np.searchsorted(term[rare], places), item[rare], share[rare] / must[item[rare]],
    )


def candidates(index: Index, term: np.ndarray, chunk: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Chunks that, with the next one if they are not alone, hold enough rare terms of some item; sums may be too high, never too low.

    term, chunk: the known words, by chunk of `stride` words.
    """
    pairs = np.unique(chunk * len(index.vocabulary) + term)
    chunk, term = np.divmod(pairs, len(index.vocabulary))
    size = index.rare_start[term + 1] - index.rare_start[term]
    owner = np.repeat(np.arange(len(term)), size)
    at = index.rare_start[term][owner] + np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
    keys, inverse = np.unique(chunk[owner] * len(index.items) + index.rare_item[at], return_inverse=True)
    if not len(keys):
        return keys
    part = np.bincount(inverse, index.rare_part[at])
    # what the next chunk has of the same item
    after = np.minimum(np.searchsorted(keys, keys + len(index.items)), len(keys) - 1)
    mine = keys // len(index.items)
    both = part + np.where((keys[after] == keys + len(index.items)) & ~alone[mine], part[after], 0.0)
    enough = mine[both >= 1 - _SURE]
    # an item may stand in the second chunk alone: then the passage before holds it too
    second = mine[(part >= 1 - _SURE) & (mine > 0)] - 1
    return np.unique(np.concatenate((enough, second[~alone[second]])))


def search(index: Index, terms: list[int]) -> list[tuple[int, float]]:
    """(item, share) of every item at THRESHOLD or more for a query of distinct terms: block-max WAND."""
    least = THRESHOLD - _SURE
    # a cursor: current item, place in the list, and the list's items, shares, block maxima and largest share
    cursors = [[x[0][0], 0, *x] for x in map(index.postings, terms)]
    found = []
    while True:
        cursors.sort(key=lambda c: c[0])
        total = 0.0
        for pivot, c in enumerate(cursors):
            total += c[5]
            if total >= least:
                break
        else:
            return found
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        reached = cursors[: pivot + 1]
        block = item // BLOCK
        if sum(c[4].get(block, 0.0) for c in reached) < least:
            # nothing up to the block's end, unless a further list joins before it
            to = (block + 1) * BLOCK
            if pivot + 1 < len(cursors):
                to = min(to, cursors[pivot + 1][0])
        elif cursors[0][0] == item:
            share = round(sum(c[3][c[1]] for c in reached), 9)  # equal words in another order give equal shares
            if share >= least:
                found.append((item, share))
            to = item + 1
        else:
            to = item
        ended = False
        for c in reached:
            if c[0] < to:
                c[1] = bisect_left(c[2], to, c[1])
                if c[1] < len(c[2]):
                    c[0] = c[2][c[1]]
                else:
                    c[0], ended = -1, True
        if ended:
            cursors = [c for c in cursors if c[0] >= 0]


def retrieve(index: Index, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
    """(row, item number, first word, end word, share) of every passage and item at THRESHOLD or more.

    words: the rows' word keys end to end; first: the rows' offsets in them.
    """
    place = np.minimum(np.searchsorted(index.vocabulary, words), len(index.vocabulary) - 1)
    known = np.flatnonzero(index.vocabulary[place] == words)
    if not len(known):
        return
    counts = np.diff(first)
    chunks = -(-counts // index.stride)
    base = np.cumsum(chunks) - chunks
    row = np.repeat(np.arange(len(counts)), counts)[known]
    chunk = base[row] + (known - first[row]) // index.stride
    alone = np.zeros(int(chunks.sum()), bool)
    alone[(base + chunks - 1)[chunks > 0]] = True
    for k in candidates(index, place[known], chunk, alone).tolist():
        r = int(np.searchsorted(base, k, "right")) - 1
        nth = k - int(base[r])
        if nth and alone[k]:  # the last chunk begins no passage, it ends the one before
            continue
        lo = int(first[r]) + nth * index.stride
        hi = min(int(first[r + 1]), lo + 2 * index.stride)
        a, b = np.searchsorted(known, (lo, hi)).tolist()
        for item, share in search(index, np.unique(place[known[a:b]]).tolist()):
            yield r, item, lo, hi, share


def overlaps(index: Index, item: int, words: list[bytes]) -> tuple[float, float]:
    """Shares of the question's trigrams and of the answer's words that a passage holds."""
    question, answer = index.parts(item)
    have = {tuple(words[k : k + n]) for n in {len(g) for g in question} for k in range(len(words) - n + 1)}
    return len(question & have) / len(question), len(answer.intersection(words)) / len(answer)


def leaks(indexes: list[Index], rows: list[str]) -> list[tuple[int, object, float, float, float, float, int]]:
    """(row, item_id, share, score, question, answer, first word) of verified leaks, the best passage of each row and item."""
    raw = [encoded(t) for t in rows]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in raw])))
    best: dict[tuple[int, object], tuple] = {}
    for lo, hi in blocks(offsets):
        joined = b"".join(raw[lo:hi])
        data = np.frombuffer(joined, np.uint8)
        starts, ends, first = word_spans(data, offsets[lo : hi + 1] - offsets[lo], _SEPARATOR)
        words = word_keys(data, starts, ends)
        for index in indexes:
            for r, item, a, b, share in retrieve(index, words, first):
                question, answer = overlaps(index, item, [joined[i:j] for i, j in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)])
                if question >= QUESTION and answer >= ANSWER:
                    key, new = (lo + r, index.items[item]), (share, int(first[r]) - a, share * float(index.whole[item]), question, answer)
                    if key not in best or new > best[key]:
                        best[key] = new
    return [(r, item, share, score, q, a, -at) for (r, item), (share, at, score, q, a) in best.items()]


def _statistics_of(rows: DataFrame, part: DataFrame) -> Statistics:
    """Statistics of all items, with the counts of the words that `part` has; only these come to the driver."""

    def count(batches):
        for b in batches:
            _, keys, _, length = _bags(texts(b, "text"))
            words, counts = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(words.view(np.int64), 0)), pa.array(np.append(counts, 0)), pa.array(np.append(np.zeros(len(words), np.int64), (length > 0).sum())), pa.array(np.append(np.zeros(len(words), np.int64), length.sum()))],
                names=["word", "n", "items", "words"],
            )

    schema = "word long, n long, items long, words long"
    every = rows.select("text").mapInArrow(releasing(count), schema)
    n, words = every.agg(F.sum("items"), F.sum("words")).first()
    mine = part.select("text").mapInArrow(releasing(count), schema).filter("n > 0").select("word").distinct()
    counts = every.filter("n > 0").groupBy("word").agg(F.sum("n").alias("n")).join(mine, "word", "left_semi").toPandas()
    keys = counts["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Statistics(int(n or 0), float(words or 0) / max(1, n or 0), keys[order], counts["n"].to_numpy(np.int64)[order])


def _indexes(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[Index]]:
    """Indexes of at most about INDEX_BYTES of item text together, made one after another."""
    rows = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // INDEX_BYTES) or 1
    for k in range(parts):
        part = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
        known = _statistics_of(rows, part) if parts > 1 else None
        if indexes := build(sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (str(r[0]), r[1])), known):
            yield indexes


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document row and leaked item."""
    spark = docs.sparkSession
    small_batches(spark)
    id_kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {id_kind}, `{item_col}` {item_kind}, score double, bm25 double, question_overlap double, answer_overlap double, passage_word long"
    result = spark.createDataFrame([], schema)

    def scan(indexes):
        def run(batches):
            for b in batches:
                found = sorted(leaks(indexes.value, texts(b, "__text")), key=lambda x: (x[0], str(x[1])))
                ids = b.column(0).take(pa.array([x[0] for x in found], pa.int64()))
                columns = [pa.array([x[k] for x in found], pa.float64()) for k in (2, 3, 4, 5)]
                yield pa.RecordBatch.from_arrays([ids, pa.array([x[1] for x in found]).cast(item_type), *columns, pa.array([x[6] for x in found], pa.int64())], names=[id_col, item_col, "score", "bm25", "question_overlap", "answer_overlap", "passage_word"])

        return run

    item_type = to_arrow_type(items.schema[item_col].dataType)
    for indexes in _indexes(items, item_col, item_text):
        shared = spark.sparkContext.broadcast(indexes)
        result = result.unionByName(docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(releasing(scan(shared)), schema))
    return result


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs without a verified leak, all columns as they were."""
    spark = docs.sparkSession
    small_batches(spark)
    names = tuple(docs.columns)
    at = names.index(text_col)
    kept = docs.toDF(*[f"__{k}" for k in range(len(names))])

    def scan(indexes):
        def run(batches):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[x[0] for x in leaks(indexes.value, [t or "" for t in b.column(at).to_pylist()])]] = False
                yield b.filter(pa.array(keep))

        return run

    for indexes in _indexes(items, item_col, item_text):
        kept = kept.mapInArrow(releasing(scan(spark.sparkContext.broadcast(indexes))), kept.schema)
    return kept.toDF(*names)
