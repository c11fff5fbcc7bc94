"""Spelling variants: words one edit apart, found in a trie of letter-group counts, and the form that each is taken for.

1. Words are the runs of letters of whole texts (`runs_of`), lower-cased where ASCII; a run whose checksum with its document's id is
   divisible by SLIP loses one letter. Words of LEAST letters and more that occur twice or more are kept with their
   number n. A document's equal runs have one checksum, so they are counted before it is taken.
2. Letters are dealt to GROUPS groups, the most frequent ones first, each to the group that has had least so far. A word is
   the vector of its groups' counts. Words that differ by one letter differ by one in at most two groups: one has one
   letter more in some group (its surplus), one less in another (its deficit).
3. The vectors are a trie, level by level the count of one group. The first `levels` counts cut it into subtrees of about SUBTREE
   words. Every word goes to its own subtree and to those which it can reach with a surplus and a deficit of one
   each; of two subtrees only the later one compares their words. Copies of a word depend on the levels alone.
4. In a subtree a depth-first search takes all its visitors along: at each node they are compared with a child's count, pay a
   difference of one from their surplus or deficit, and leave where they can't. At a leaf of LEAF words or fewer, or of one
   vector, the remaining visitors are compared with the words by their common beginnings and ends.
5. Each word's form is the near word of greatest n, if that is TIMES its own. Roots follow by doubling the steps: n
   grows TIMES a step, so chains are short.

Null and empty texts have no words. Rows without an id are counted under an empty one, and repeated rows each count. Texts and
words of any length are taken whole. Ties of n go to the word that is smallest in code points. Other columns do not matter; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, drop, materialise, releasing, small_batches, utf8, whole_number
from .hashing import distinct_words

LEAST, SLIP, TIMES = 7, 31, 10
GROUPS = 16
#: Words that a subtree holds before another level cuts it, and levels that may cut.
SUBTREE, MOST_LEVELS = 20_000, 8
#: Words that one task holds of a subtree at most; more are dealt to several.
HOLD = 200_000
#: Words that are compared with all visitors that reach them, visitors that are searched for together, and pairs compared at once.
LEAF, VISITORS, PAIRS = 24, 20_000, 200_000
#: Letters up to which words are compared side by side; longer ones one by one.
WIDE = 40
STEPS = 40

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: First byte of the letters from U+00C0 to U+00FF, which have two.
_LEAD = 0xC3


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> np.uint32(1)) ^ np.where(out & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return out


_CRC = _crc_table()


def crc32s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The crc32 of each data[start:end], as continued from the seeds (the crc32 of what stands before)."""
    crc = seeds.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(starts - ends, kind="stable")  # the longest first, so that those left are a head
    crc, at, size = crc[order], starts[order], (ends - starts)[order]
    alive = len(order)
    for k in range(int(size.max(initial=0))):
        alive = int(np.searchsorted(-size[:alive], -k, "left"))
        head = crc[:alive]
        crc[:alive] = _CRC[(head ^ data[at[:alive] + k]) & np.uint32(255)] ^ (head >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def runs_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of letters within rows."""
    inside = _LETTER[data] | (data == _LEAD)
    inside[1:] |= data[:-1] == _LEAD
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside))
    after = np.concatenate((inside, [False]))
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _letters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points of each span."""
    lead = np.concatenate(([0], np.cumsum(data == _LEAD)))
    return ends - starts - (lead[ends] - lead[starts])


def count_words(ids: list[bytes], data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[bytes, int]]:
    """(word, n) of the words of LEAST letters and more; ids: what stands before the colon for each row."""
    data = _LOWER[data]
    starts, ends, row = runs_of(data, offsets)
    size = _letters(data, starts, ends)
    keep = size >= LEAST
    starts, ends, row, size = starts[keep], ends[keep], row[keep], size[keep]
    if not len(starts):
        return
    raw = data.tobytes()
    _, example, word = distinct_words(data, starts, ends)
    code, at, n = np.unique(row * len(example) + word, return_index=True, return_counts=True)
    seeds = np.array([zlib.crc32(x + b":") for x in ids], np.uint32)
    crc = crc32s(data, starts[at], ends[at], seeds[row[at]])
    slips = crc % SLIP == 0
    whole = np.bincount(word[at][~slips], n[~slips], len(example)).astype(np.int64)
    some = np.flatnonzero(whole)
    yield from zip([raw[i:j] for i, j in zip(starts[example[some]].tolist(), ends[example[some]].tolist(), strict=True)], whole[some].tolist(), strict=True)
    for k in np.flatnonzero(slips & (size[at] > LEAST)).tolist():
        text = raw[starts[at[k]] : ends[at[k]]].decode()
        p = int(crc[k]) % len(text)
        yield (text[:p] + text[p + 1 :]).encode(), int(n[k])


def _count(batches):
    for b in batches:
        data, offsets = utf8(b.column(1))
        ids = [b"" if i is None else str(i).encode() for i in b.column(0).to_pylist()]
        for lo, hi in blocks(offsets, 4 << 20):
            found = list(count_words(ids[lo:hi], data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()).cast(pa.string()), pa.array([n for _, n in found], pa.int64())], names=["word", "n"])


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of LEAST letters and more that occur twice or more."""
    rows = docs.select(whole_number(docs, id_col), F.col(text_col))
    return rows.mapInArrow(releasing(_count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n >= 2")


class Words:
    """Words as bytes of their code points, with the counts of their letters' groups."""

    def __init__(self, words: list[str], groups: np.ndarray) -> None:
        self.raw = [w.encode("latin-1") for w in words]
        self.size = np.array([len(w) for w in self.raw], np.int64)
        letters = np.frombuffer(b"".join(self.raw), np.uint8)
        row = np.repeat(np.arange(len(words)), self.size)
        counts = np.bincount(row * GROUPS + groups[letters], minlength=len(words) * GROUPS)
        self.counts = np.minimum(counts, 255).reshape(-1, GROUPS).astype(np.uint8)
        # what stands in fixed places from the beginning, and from the end
        column = np.arange(len(letters)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        near = column < WIDE
        self.front = np.zeros((len(words), WIDE), np.uint8)
        self.front[row[near], column[near]] = letters[near]
        column = np.repeat(self.size, self.size) - 1 - column
        near = column < WIDE
        self.back = np.zeros((len(words), WIDE), np.uint8)
        self.back[row[near], column[near]] = letters[near]

    def keys(self, levels: int) -> np.ndarray:
        """The first counts as one number, in their order."""
        out = np.zeros(len(self.raw), np.int64)
        for k in range(levels):
            out = (out << 8) | self.counts[:, k]
        return out


def one_apart(a: bytes, b: bytes) -> bool:
    """Whether one letter put in, left out or replaced makes a of b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    head = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    rest_a, rest_b = a[head:], b[head:]
    return rest_a[1:] == rest_b[1:] if len(a) == len(b) else rest_a[1:] == rest_b if len(a) > len(b) else rest_a == rest_b[1:]


def _verified(left: Words, right: Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of words are one edit apart: the common beginning and end leave one letter."""
    a, b = left.size[i], right.size[j]
    longest = np.maximum(a, b)
    good = np.abs(a - b) <= 1
    for k in np.flatnonzero(good & (longest > WIDE)).tolist():
        good[k] = one_apart(left.raw[i[k]], right.raw[j[k]])
    alive = np.flatnonzero(good & (longest <= WIDE))
    wide = int(longest[alive].max(initial=1))
    differ = left.front[i[alive], :wide] != right.front[j[alive], :wide]
    head = differ.argmax(axis=1)
    fits = differ[np.arange(len(alive)), head]  # else the words are equal
    good[alive[~fits]] = False
    alive, head = alive[fits], head[fits]
    tail = (left.back[i[alive], :wide] != right.back[j[alive], :wide]).argmax(axis=1)
    good[alive] = head + tail >= longest[alive] - 1
    return good


def search(visitors: Words, stored: Words, levels: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(visitor, stored) pairs one edit apart, by a depth-first search of the stored words' trie; all share their first counts."""
    order = np.lexsort(stored.counts[:, ::-1].T)
    trie = stored.counts[order]
    start = visitors.counts[:, :levels].astype(np.int16) - trie[0, :levels]
    surplus, deficit = np.maximum(start, 0).sum(axis=1), np.maximum(-start, 0).sum(axis=1)
    here = np.flatnonzero((surplus <= 1) & (deficit <= 1))
    stack = [(0, len(trie), levels, here, surplus[here] == 0, deficit[here] == 0)]
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def settle():
        i, j = (np.concatenate(x) for x in zip(*waiting, strict=True))
        for k in range(0, len(i), PAIRS):
            good = _verified(visitors, stored, i[k : k + PAIRS], j[k : k + PAIRS])
            yield i[k : k + PAIRS][good], j[k : k + PAIRS][good]

    while stack:
        lo, hi, level, who, more, less = stack.pop()
        if hi - lo <= LEAF or level == GROUPS:
            step = max(1, PAIRS // (hi - lo))
            for k in range(0, len(who), step):
                some = who[k : k + step]
                waiting.append((np.repeat(some, hi - lo), np.tile(order[lo:hi], len(some))))
                held += len(some) * (hi - lo)
                if held >= PAIRS:
                    yield from settle()
                    waiting, held = [], 0
            continue
        column = trie[lo:hi, level]
        cuts = [0, *(np.flatnonzero(column[1:] != column[:-1]) + 1).tolist(), hi - lo]
        theirs = visitors.counts[who, level].astype(np.int16)
        for a, b in zip(cuts, cuts[1:], strict=False):
            apart = theirs - np.int16(column[a])
            go = np.flatnonzero((apart == 0) | ((apart == 1) & more) | ((apart == -1) & less))
            if len(go):
                stack.append((lo + a, lo + b, level + 1, who[go], more[go] & (apart[go] != 1), less[go] & (apart[go] != -1)))
    if waiting:
        yield from settle()


def _letter_groups(words: DataFrame) -> np.ndarray:
    """The group of each letter, and the groups in the order of their letters' frequency."""

    def run(batches):
        for b in batches:
            n = np.bincount(np.frombuffer("".join(b.column(0).to_pylist()).encode("latin-1"), np.uint8), minlength=256)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], names=["letter", "n"])

    counted = words.select("word").mapInArrow(releasing(run), "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()  # a row for each letter
    full, group = [0] * GROUPS, np.zeros(256, np.int64)
    for r in sorted(counted, key=lambda r: (-r.n, r.letter)):
        k = full.index(min(full))
        full[k] += r.n
        group[r.letter] = k
    place = np.empty(GROUPS, np.int64)
    place[np.argsort([-n for n in full], kind="stable")] = np.arange(GROUPS)
    return place[group]


def _subtrees(words: DataFrame, groups: np.ndarray) -> tuple[int, dict[int, int]]:
    """How many levels cut the trie into subtrees of SUBTREE words, and of subtrees over HOLD words the number of tasks."""

    def run(batches):
        for b in batches:
            some = Words(b.column(0).to_pylist(), groups)
            found = [(k, *np.unique(some.keys(k), return_counts=True)) for k in range(1, MOST_LEVELS + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(x), k) for k, x, _ in found])), pa.array(np.concatenate([x for _, x, _ in found])), pa.array(np.concatenate([n for *_, n in found]))], names=["levels", "key", "n"])

    counted = materialise(words.select("word").mapInArrow(releasing(run), "levels long, key long, n long").groupBy("levels", "key").agg(F.sum("n").alias("n")), "variant-subtrees")
    most = {r.levels: r.n for r in counted.groupBy("levels").agg(F.max("n").alias("n")).collect()}
    levels = next((k for k in sorted(most) if most[k] <= SUBTREE), MOST_LEVELS)
    large = {r.key: -(-r.n // HOLD) for r in counted.filter((F.col("levels") == levels) & (F.col("n") > HOLD)).select("key", "n").collect()}
    drop(counted)
    return levels, large


def reached(counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, key) of the subtrees that words reach with a surplus and a deficit of one each, and that come after their own or are it."""
    levels = counts.shape[1]
    weight = [1 << 8 * (levels - 1 - k) for k in range(levels)]
    own = (counts.astype(np.int64) * np.array(weight)).sum(axis=1)
    every = np.arange(len(counts))
    yield every, own
    for up in range(-1, levels):
        for down in range(-1, levels):
            change = (weight[up] if up >= 0 else 0) - (weight[down] if down >= 0 else 0)
            if up == down or change < 0:
                continue
            fits = np.ones(len(counts), bool)
            if up >= 0:
                fits &= counts[:, up] < 255
            if down >= 0:
                fits &= counts[:, down] > 0
            yield every[fits], own[fits] + change


def _deal(groups: np.ndarray, levels: int, large: dict[int, int]):
    """(key, block, side, word, n): each word once to be stored in its own subtree (side 0), and to visit each that it reaches (1)."""

    def run(batches):
        for b in batches:
            some = Words(b.column(0).to_pylist(), groups)
            own = some.keys(levels)
            rows = [(np.arange(len(own)), own, np.array([zlib.crc32(w) % large.get(k, 1) for w, k in zip(some.raw, own.tolist(), strict=True)], np.int32), 0)]
            for at, keys in reached(some.counts[:, :levels]):
                tasks = np.array([large.get(k, 1) for k in keys.tolist()]) if large else np.ones(len(keys), np.int64)
                block = np.arange(tasks.sum()) - np.repeat(np.cumsum(tasks) - tasks, tasks)
                rows.append((np.repeat(at, tasks), np.repeat(keys, tasks), block.astype(np.int32), 1))
            for at, keys, block, side in rows:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(block), pa.array(np.full(len(at), side, np.int8)), *[b.column(k).take(pa.array(at)) for k in (0, 1)]], names=["key", "block", "side", "word", "n"])

    return releasing(run)


def _near(groups: np.ndarray, levels: int):
    """A subtree's words, then its visitors, in the order of keys -> (word, near, near_n) both ways for each pair."""

    def met(stored, some: list[tuple[str, int]], key: int):
        words, held, n = stored
        visitors = Words([w for w, _ in some], groups)
        counts = np.array([c for _, c in some], np.int64)
        own = visitors.keys(levels) == key
        for i, j in search(visitors, held, levels):
            # words of one subtree meet twice: the smaller one counts as the visitor
            first = np.array([visitors.raw[x] < held.raw[y] for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
            keep = ~own[i] | first
            i, j = i[keep], j[keep]
            a, b = pa.array([some[k][0] for k in i.tolist()], pa.string()), pa.array([words[k] for k in j.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([a, b, pa.array(n[j])], names=["word", "near", "near_n"])
            yield pa.RecordBatch.from_arrays([b, a, pa.array(counts[i])], names=["word", "near", "near_n"])

    def run(batches):
        at, stored, gathered, visiting = None, None, [], []

        def ready():
            nonlocal stored, gathered
            if gathered:
                words = [w for w, _ in gathered]
                stored, gathered = (words, Words(words, groups), np.array([c for _, c in gathered], np.int64)), []
            return stored

        for b in batches:
            for key, block, side, word, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if at != (key, block):
                    if visiting and ready():
                        yield from met(stored, visiting, at[0])
                    at, stored, gathered, visiting = (key, block), None, [], []
                if side == 0:
                    gathered.append((word, n))
                elif gathered or stored:  # nobody is at home in some subtrees
                    visiting.append((word, n))
                    if len(visiting) >= VISITORS:
                        yield from met(ready(), visiting, key)
                        visiting = []
        if visiting and ready():
            yield from met(stored, visiting, at[0])

    return releasing(run)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "variant-roots")
    for _ in range(STEPS):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = materialise(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variant-roots")
        drop(now)
        now = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return now
    raise RuntimeError("forms do not end")


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, form, root, n_near, form_n) of every word."""
    spark = docs.sparkSession
    small_batches(spark, 10_000)
    words = materialise(words_of(docs, id_col, text_col), "variant-words")
    groups = _letter_groups(words)
    levels, large = _subtrees(words, groups)
    tasks = max(4 * spark.sparkContext.defaultParallelism, words.count() // SUBTREE)
    dealt = words.select("word", "n").mapInArrow(_deal(groups, levels, large), "key long, block int, side byte, word string, n long")
    pairs = dealt.repartition(tasks, "key", "block").sortWithinPartitions("key", "block", "side").mapInArrow(_near(groups, levels), "word string, near string, near_n long")
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    holds = -F.col("best.less") >= TIMES * F.col("n")
    known = words.join(best, "word", "left").select("word", "n", F.when(holds, F.col("best.near")).alias("form"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(holds, -F.col("best.less")).alias("form_n"))
    known = materialise(known, "variant-forms")
    drop(words)
    return known.join(_roots(known.filter("form is not null")), "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")
