"""Ranked lexical search: a tree of the documents' term vectors, searched by branch and bound for each item.

1. Texts are read once. A document keeps its length and those of its terms that some item has, with their occurrences:
   its restricted vector. Counts of documents, terms and of each term's documents are sums over all vectors.
2. Each task puts its vectors, up to TREE entries at a time, into a tree: a vector is a path of its terms by falling document
   frequency, so vectors share the paths of their frequent terms. The tree is kept as arrays: documents sorted by their
   paths, so that a subtree is a range of documents, and of every subtree of more than LEAF documents (a branch) the
   greatest tf of each term and the least m.
3. For each item the branches are bounded at once: a term adds w * f(greatest tf, least m), which no document of the subtree
   exceeds, since f grows with tf and falls with m. The search goes depth first, the child of the highest bound first; what
   cannot reach the COUNTth score so far is left. Documents below a branch that are not in a branch of their own are scored.
4. Each tree gives its COUNT best documents for each item; a window that keeps COUNT of each task before the shuffle ranks them.

Scores are whole numbers by the formula of `weights` and `saturation`. Items come in indexes of about INDEX_BYTES of text,
which bounds what is broadcast; more items take more passes with the same results.

Null and empty texts have no term: such documents count nowhere, such items have no rows. Documents without an id count in the
corpus and are not ranked; rows of one id are ranked each for themselves. Rows of one item_id are one item with the terms
of all; items without an id are left out. Equal scores go by ascending id, then all equal rows are alike. Texts of any length are
taken whole; other columns do not matter. Without documents, or without items, nothing is ranked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, materialise, releasing, small_batches, utf8, whole_number
from .hashing import same_bytes, word_keys, word_spans

COUNT = 50
#: Entries (document, term) that a tree holds, about, and documents that a subtree without bounds has at most.
TREE, LEAF = 4_000_000, 128
#: Numbers that the bounds of a tree's branches hold, at most; larger subtrees take the place of smaller ones beyond that.
BOUNDS = 16_000_000
INDEX_BYTES = 8 << 20
_BILLION = 1_000_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: What separates terms, all of ASCII but digits and letters.
_SEPARATOR = np.array([b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F for b in range(256)])


def weights(n: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def measures(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """100 - 50 + (50 n N) div L of documents of n terms."""
    if int(n.max(initial=0)) * 50 * docs < 1 << 63:
        return 50 + (50 * n * docs) // max(1, terms)
    return np.array([50 + (50 * x * docs) // max(1, terms) for x in n.tolist()], np.int64)


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(1000000000 tf) div (1000 tf + 20 m)."""
    return (_BILLION * tf) // (1000 * tf + 20 * m)


class Terms:
    """A text column's terms by a vocabulary, which is sorted by key; bytes tell terms apart, not keys."""

    def __init__(self, words: list[bytes]) -> None:
        size = np.array([len(w) for w in words], np.int64)
        joined = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(size)
        keys = word_keys(joined, ends - size, ends)
        order = np.argsort(keys, kind="stable").tolist()
        self.words, self.keys, self.size = [words[k] for k in order], keys[order], size[order]
        self.bytes = np.frombuffer(b"".join(self.words), np.uint8)
        self.starts = np.cumsum(self.size) - self.size
        self.places = {w: k for k, w in enumerate(self.words)}

    def count(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(terms of each row with repeats, row, word, occurrences) of the words of the vocabulary that rows hold, by row and word."""
        data = _LOWER[data]
        starts, ends, first = word_spans(data, offsets, _SEPARATOR)
        lengths = np.diff(first)
        if not len(self.words) or not len(starts):
            none = np.zeros(0, np.int64)
            return lengths, none, none, none
        keys = word_keys(data, starts, ends)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[place] == keys)
        word, starts, ends = place[hit], starts[hit], ends[hit]
        wrong = ends - starts != self.size[word]
        wrong[~wrong] = ~same_bytes(np.concatenate((data, self.bytes)), starts[~wrong], len(data) + self.starts[word[~wrong]], self.size[word[~wrong]])
        for k in np.flatnonzero(wrong).tolist():  # words that only share their key, with this one or with each other
            word[k] = self.places.get(data[starts[k] : ends[k]].tobytes(), -1)
        code = (np.searchsorted(first, hit, "right") - 1) * len(self.words) + word
        code, tf = np.unique(code[word >= 0], return_counts=True)
        return lengths, code // len(self.words), code % len(self.words), tf


def term_set(text: str | None) -> set[bytes]:
    """The distinct terms of one text."""
    data = _LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), _SEPARATOR)
    raw = data.tobytes()
    return {raw[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)}


def _vectors(shared):
    """(doc_id, n, words, tfs): the restricted vector of each row."""

    def run(batches):
        terms: Terms = shared.value
        for b in batches:
            data, offsets = utf8(b.column(1))
            for lo, hi in blocks(offsets):
                n, row, word, tf = terms.count(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                at = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int32)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), lists(word), lists(tf)], names=["doc_id", "n", "words", "tfs"])

    return releasing(run)


class Tree:
    """Restricted vectors as a tree of arrays; documents are numbered by their paths, so a subtree is a range of them."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, at: np.ndarray, words: np.ndarray, tfs: np.ndarray, rank: np.ndarray) -> None:
        """Document k has the entries at[k]:at[k + 1]; rank: the words' places by falling document frequency."""
        doc = np.repeat(np.arange(len(ids)), np.diff(at))
        order = np.lexsort((rank[words], doc))
        words, tfs = words[order], tfs[order]
        places = rank[words].astype(">i4")
        paths = [places[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        by_path = np.array(sorted(range(len(ids)), key=paths.__getitem__), np.int64)
        sizes = np.diff(at)[by_path]
        self.ids, self.m = ids[by_path], m[by_path]
        self.at = np.concatenate(([0], np.cumsum(sizes)))
        take = np.repeat(at[:-1][by_path] - self.at[:-1], sizes) + np.arange(self.at[-1])
        self.words, self.tfs = words[take], tfs[take]
        self._branch(len(rank))

    def _branch(self, n_words: int) -> None:
        """Nodes of more than LEAF documents, parents before children: ranges, children, greatest tf of each term, least m."""
        size = np.diff(self.at)
        leaf = LEAF
        while True:
            ranges, children, stack = [], [], [(0, len(size), 0, -1)]
            while stack:
                lo, hi, depth, parent = stack.pop()
                # a path without branches is one node: what the first and the last document share, all share
                longest = int(min(size[lo], size[hi - 1])) - depth
                a, b = int(self.at[lo]) + depth, int(self.at[hi - 1]) + depth
                differ = np.flatnonzero(self.words[a : a + longest] != self.words[b : b + longest])
                depth += int(differ[0]) if len(differ) else longest
                me = len(ranges)
                ranges.append((lo, hi))
                children.append([])
                if parent >= 0:
                    children[parent].append(me)
                start = lo + int((size[lo:hi] <= depth).sum())  # documents that end here come first
                if start < hi:
                    following = self.words[self.at[start:hi] + depth]
                    cuts = np.concatenate(([0], np.flatnonzero(following[1:] != following[:-1]) + 1, [hi - start])) + start
                    for k in np.flatnonzero(np.diff(cuts) > leaf).tolist():
                        stack.append((int(cuts[k]), int(cuts[k + 1]), depth + 1, me))
            # documents in no branch of their own are bounded by runs of LEAF of them, which a path's order keeps alike
            if len(ranges) * n_words <= BOUNDS or len(ranges) == 1:
                break
            leaf *= 2
        self.ranges, self.children, self.own = ranges, children, []
        runs = []
        for (lo, hi), below in zip(ranges, children, strict=True):
            mine = []
            at = lo
            for i, j in [*sorted(ranges[c] for c in below), (hi, hi)]:
                while at < i:
                    end = min(i, at + leaf)
                    mine.append(len(runs))
                    runs.append((at, end))
                    at = end
                at = max(at, j)
            self.own.append(mine)
        self.runs = runs
        starts = np.array([a for a, _ in runs], np.int64)
        order = np.argsort(starts)
        self.run_m = np.empty(len(runs), np.int64)
        self.run_m[order] = np.minimum.reduceat(self.m, starts[order]) if len(runs) else []
        # subtree maxima, kept per branch as (term, tf) in the order of terms: of its runs, then of its branches
        run_of = np.repeat(order, np.diff(np.append(starts[order], len(size))))
        entry_run = np.repeat(run_of, size)
        code = entry_run * n_words + self.words
        by = np.lexsort((self.tfs, code))
        last = np.append(np.flatnonzero(np.diff(code[by])), len(by) - 1) if len(by) else by
        code, tf = code[by][last], self.tfs[by][last]
        self.run_at = np.searchsorted(code, np.arange(len(runs) + 1) * n_words)
        self.run_words, self.run_tfs = code % n_words, tf
        self.node_max = np.zeros((len(ranges), n_words), np.int32)
        self.node_m = np.full(len(ranges), np.iinfo(np.int64).max)
        for k in reversed(range(len(ranges))):
            for r in self.own[k]:
                i, j = self.run_at[r], self.run_at[r + 1]
                mine = self.run_words[i:j]
                self.node_max[k, mine] = np.maximum(self.node_max[k, mine], self.run_tfs[i:j])
                self.node_m[k] = min(self.node_m[k], self.run_m[r])
            for c in self.children[k]:
                np.maximum(self.node_max[k], self.node_max[c], out=self.node_max[k])
                self.node_m[k] = min(self.node_m[k], self.node_m[c])

    def search(self, words: np.ndarray, w: np.ndarray, table: np.ndarray, count: int = COUNT) -> list[tuple[int, int]]:
        """(score, doc_id) of the best documents of an item; table: zeros for all words, which it gets back."""
        tf = self.node_max[:, words].astype(np.int64)
        bounds = (w * saturation(tf, self.node_m[:, None])).sum(axis=1)
        table[words] = w
        best: list[tuple[int, int]] = []
        least = 1
        stack = [0]
        while stack:
            k = stack.pop()
            if bounds[k] < least:
                continue
            for r in self.own[k]:
                i, j = self.run_at[r], self.run_at[r + 1]
                if int((table[self.run_words[i:j]] * saturation(self.run_tfs[i:j].astype(np.int64), self.run_m[r])).sum()) < least:
                    continue
                lo, hi = self.runs[r]
                a, b = self.at[lo], self.at[hi]
                found = np.flatnonzero(table[self.words[a:b]])
                if not len(found):
                    continue
                doc = np.searchsorted(self.at, a + found, "right") - 1
                part = table[self.words[a + found]] * saturation(self.tfs[a + found].astype(np.int64), self.m[doc])
                heads = np.flatnonzero(np.diff(doc, prepend=-1))
                scores, docs = np.add.reduceat(part, heads), doc[heads]
                good = scores >= least
                best += zip(scores[good].tolist(), self.ids[docs[good]].tolist(), strict=True)
                if len(best) > count:
                    best = sorted(best, key=lambda x: (-x[0], x[1]))[:count]
                if len(best) == count:
                    least = max(least, min(x[0] for x in best))
            # the child of the highest bound is on top
            stack += sorted((c for c in self.children[k] if bounds[c] >= least), key=lambda c: bounds[c])
        table[words] = 0
        return sorted(best, key=lambda x: (-x[0], x[1]))


def _search(shared):
    """Vectors, gathered up to TREE entries -> (item, doc_id, score) of the best of each tree."""

    def run(batches):
        index = shared.value
        table = np.zeros(len(index["rank"]), np.int64)

        def finish(held):
            ids = np.concatenate([h[0] for h in held])
            at = np.concatenate(([0], np.cumsum(np.concatenate([h[2] for h in held]))))
            tree = Tree(ids, measures(np.concatenate([h[1] for h in held]), index["docs"], index["terms"]), at, np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held]), index["rank"])
            rows = [(item, doc, score) for item, words in index["items"] for score, doc in tree.search(words, index["weights"][words], table)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["item", "doc_id", "score"])

        held, size = [], 0
        for b in batches:
            lists = b.column(2)
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), np.asarray(lists.value_lengths(), np.int64), lists.flatten().to_numpy(), b.column(3).flatten().to_numpy()))
            size += len(held[-1][3])
            if size >= TREE:
                yield finish(held)
                held, size = [], 0
        if held:
            yield finish(held)

    return releasing(run)


def _indexes(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """(item_id, terms) of items of about INDEX_BYTES of text together, one list after another."""
    rows = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).filter("item is not null and text is not null")
    parts = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // INDEX_BYTES)
    for k in range(parts):
        found: dict = {}
        for item, text in rows.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == k).collect():
            found.setdefault(item, set()).update(term_set(text))
        if some := [x for x in found.items() if x[1]]:
            yield some


def rank(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", count: int = COUNT) -> DataFrame:
    """(item_id, rank, doc_id, score): the `count` documents of highest score above 0 for each item."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(whole_number(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(whole_number(items, item_col).alias("item"), F.col(item_text).alias("text"))
    result = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for some in _indexes(items, "item", "text"):
        terms = Terms(sorted(set().union(*[x[1] for x in some])))
        vectors = materialise(rows.mapInArrow(_vectors(spark.sparkContext.broadcast(terms)), "doc_id long, n long, words array<int>, tfs array<int>"), "search-vectors")
        n, total = vectors.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
        df = np.zeros(len(terms.words), np.int64)
        for word, c in vectors.select(F.explode("words").alias("word")).groupBy("word").count().collect():  # a row for each term of the index
            df[word] = c
        place = np.empty(len(df), np.int64)
        place[np.argsort(-df, kind="stable")] = np.arange(len(df))
        index = {"rank": place, "weights": weights(n, df), "docs": n, "terms": total or 0, "items": [(k, np.array(sorted(terms.places[w] for w in x), np.int64)) for k, x in some]}
        found = vectors.filter("doc_id is not null and size(words) > 0").mapInArrow(_search(spark.sparkContext.broadcast(index)), "item long, doc_id long, score long")
        nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
        result = result.unionByName(found.withColumn("rank", nth).filter(F.col("rank") <= count).select(F.col("item").alias("item_id"), "rank", "doc_id", "score"))
    return result
