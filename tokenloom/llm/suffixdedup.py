"""Exact removal of repeated byte strings by a distributed merge sort of suffix runs.

A byte goes if it lies in a string of LENGTH bytes that also starts in a document of smaller id. Suffixes are kept in
runs, and each run is what one task has read:

1. Windows. Every window of LENGTH bytes is named by the least hash among the K-byte strings in it, so equal windows have
   equal names. Neighbouring windows of one name form a stretch; a stretch's suffix, cut after its last window, stands for
   all of them: about every tenth suffix is enough to hold every window of the text.
2. Names. Each run sends its distinct names once, sorted and as gaps, to the part that the name belongs to; a name that
   only one document has anywhere repeats nothing, so its suffixes need not travel. A name under which more than HOT
   different suffixes stand, as at the borders of a line that many documents share, is hot: its windows are dealt one by
   one, by their own hashes. They are asked for first in the same way as names, so that only repeated ones travel.
3. Exchange. Each run sorts its remaining suffixes, keeps equal ones once with their least and greatest document, and
   sends them to the name's part, front-coded: the length shared with the suffix before, and the rest.
4. Merge. A part merges its runs with a loser tree that holds, for each run, the length shared with the last suffix put
   out. A longer shared length wins unread; bytes are compared only where lengths tie, and only behind them. Shared
   lengths come from the front coding and are never computed again. Equal suffixes meet here, over all runs.
5. Windows again. The merged suffixes' windows are grouped; each gets the least document that has it, and each run hears
   of those windows whose least document is smaller than one of its own.
6. Each run marks the bytes and cuts them.

Runs are written to the shared folder by the first step and read again by the later ones, so no text is shuffled. A run
holds about RUN_BYTES of text, or one longer document. No part gathers more than one copy of a suffix or window from each
run, nor more than HOT different suffixes of a name. Null and empty texts lose nothing. Rows without a doc_id, and rows that share a doc_id, take nothing from each other;
rows without one neither lose bytes nor make others lose any. Matches never cross documents. Results are judged on the
input. Names and grouped windows are 64-bit keys; the bytes of grouped windows are compared before a group counts. An
empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, drop, materialise, releasing, scratch_path, small_batches, whole_number
from .hashing import mix, prefix_hash, span_hash
from .runs import NOBODY, OF_NONE, columns, cut_runs, groups, pack, pack_sorted, part_of, read_file, rows_of, slices, unpack, unpack_sorted, write_file

LENGTH = 50
K = 32
RUN_BYTES = 16 << 20
#: Most windows of one stretch; longer ones, as in periodic text, are cut.
STRETCH = 64
#: Bits of a name that travel in step 2. Names that only seem equal cost a suffix's journey, no more.
NAME_BITS = 48
#: Bytes of a run's names that a part receives, about.
PART_BYTES = 1 << 20
#: Different suffixes of one name, added up over the runs, beyond which its windows go their own ways. So many take some
#: 35 MB of a task; to ask for single windows takes a further pass over the runs that have such a name.
HOT = 1 << 16
#: Tasks that read the runs again, at most: a task then has several runs, one after another.
MOST_TASKS = 20_000
#: No count of suffixes is over this.
EVERY = 1 << 62


def stretches(data: np.ndarray, offsets: np.ndarray, prefix: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, name) of the stretches of all rows, by place in data; prefix: the data's `prefix_hash`, if at hand."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    prefix = prefix_hash(data) if prefix is None else prefix
    places = np.arange(len(data) - K + 1)
    name = span_hash(prefix, places, places + K)
    # least of the LENGTH - K + 1 hashes from each place on, by doubling
    width, least = 1, name
    want = LENGTH - K + 1
    while 2 * width <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[: n], least[want - width : want - width + n])
    least = least[:n]
    whole = np.zeros(n, bool)
    for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        whole[i : max(i, j - LENGTH + 1)] = True
    first = np.ones(n, bool)
    first[1:] = (least[1:] != least[:-1]) | ~whole[:-1]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] = True
    first &= whole
    start = np.flatnonzero(first)
    # a stretch ends where the next begins or windows stop being whole
    stop = np.flatnonzero(whole & np.append(~whole[1:] | first[1:], True)) + 1
    size = stop - start
    if len(size) and size.max() > STRETCH:
        parts = -(-size // STRETCH)
        owner = np.repeat(np.arange(len(size)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        start, size = start[owner] + nth * STRETCH, np.minimum(STRETCH, size[owner] - nth * STRETCH)
    # least values crowd at the low end: spread them, so that ranges of names are even parts
    return start, size, mix(least[start])


def _short(names: np.ndarray) -> np.ndarray:
    return names >> np.uint64(64 - NAME_BITS)


# ---- 1, 2: runs and their names

_NAMES = {"part": pa.int32(), "run": pa.string(), "names": pa.binary(), "many": pa.binary(), "kinds": pa.binary()}
_NAMES_SCHEMA = "part int, run string, names binary, many binary, kinds binary"


def _distinct(names: np.ndarray, owner: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct names, sorted; whether two documents have each; and how many different `inner` stand under it."""
    order = np.argsort(names, kind="stable")
    names, owner, inner = names[order], owner[order], inner[order]
    head = np.ones(len(names), bool)
    head[1:] = names[1:] != names[:-1]
    heads = np.flatnonzero(head)
    if not len(heads):
        return names, np.zeros(0, bool), np.zeros(0, np.uint32)
    # most names stand once in a run: only the others are sorted by what stands under them
    kinds = np.ones(len(heads), np.int64)
    size = np.diff(np.append(heads, len(names)))
    group = np.repeat(np.arange(len(heads)), size)
    several = np.flatnonzero(size[group] > 1)
    if len(several):
        group, under = group[several], inner[several]
        order = np.lexsort((under, group))
        group, under = group[order], under[order]
        fresh = np.ones(len(group), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (under[1:] != under[:-1])
        kinds = np.maximum(kinds, np.bincount(group[fresh], minlength=len(heads)))
    return names[heads], np.minimum.reduceat(owner, heads) != np.maximum.reduceat(owner, heads), np.minimum(kinds, (1 << 32) - 1).astype(np.uint32)


def _run_names(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The run's distinct short names, whether two of its documents have each, and each name's different suffixes."""
    found, owners, suffixes = [], [], []
    for lo, hi in blocks(offsets):
        here = data[offsets[lo] : offsets[hi]]
        prefix = prefix_hash(here)
        start, size, name = stretches(here, offsets[lo : hi + 1] - offsets[lo], prefix)
        doc = lo + np.searchsorted(offsets[lo : hi + 1] - offsets[lo], start, "right") - 1
        keep = ids[doc] != NOBODY
        found.append(_short(name[keep]))
        owners.append(ids[doc[keep]])
        suffixes.append(span_hash(prefix, start[keep], start[keep] + size[keep] + LENGTH - 1))
    if not found:
        return _distinct(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return _distinct(np.concatenate(found), np.concatenate(owners), np.concatenate(suffixes))


def _by_part(parts: int, run: str, names: np.ndarray, many: np.ndarray, kinds: np.ndarray) -> list[tuple]:
    """A row for each part with the run's sorted names there."""
    return [
        (p, run, pack_sorted(names[lo:hi]), np.packbits(many[lo:hi]).tobytes(), zstandard.ZstdCompressor(level=1).compress(kinds[lo:hi].tobytes()))
        for p, lo, hi in slices(part_of(names, NAME_BITS, parts))
    ]


def _names_by_part(parts: int):
    def names(run: str, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        """One row for the run itself, and one for each part with the run's names there."""
        return rows_of([(-1, run, b"", b"", b""), *_by_part(parts, run, *_run_names(ids, data, offsets))], _NAMES)

    return names


def _repeated_names(hot: int):
    def repeated(batches):
        """Per part: the names that two documents have, back to the runs that hold them, and which of them are hot."""
        for _, rows in groups(batches, 1):
            names = [unpack_sorted(blob) for _, blob, _, _ in rows]
            many = [np.unpackbits(np.frombuffer(bits, np.uint8))[: len(x)].astype(bool) for x, (_, _, bits, _) in zip(names, rows, strict=True)]
            kinds = [np.frombuffer(zstandard.ZstdDecompressor().decompress(k), np.uint32).astype(np.int64) for _, _, _, k in rows]
            every = np.concatenate(names)
            order = np.argsort(every, kind="stable")
            every, count = every[order], np.concatenate(kinds)[order]
            heads = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
            runs, total = np.diff(np.append(heads, len(every))), np.add.reduceat(count, heads)
            every = every[heads]
            del count, order
            out = []
            for (run, _, _, _), own, alone in zip(rows, names, many, strict=True):
                at = np.searchsorted(every, own)
                shared = alone | (runs[at] > 1)
                is_hot = shared & (total[at] > hot)
                if shared.any():
                    out.append((run, pack_sorted(own[shared & ~is_hot]), pack_sorted(own[is_hot])))
            yield rows_of(out, {"run": pa.string(), "names": pa.binary(), "hot": pa.binary()})

    return repeated


def _union(blobs) -> np.ndarray:
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(unpack_sorted(b) for b in blobs)]))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is one of the sorted known ones."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def _single(prefix: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of stretches one by one: their places and short hashes. prefix: the data's `prefix_hash`."""
    owner = np.repeat(np.arange(len(start)), size)
    at = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    return at, _short(span_hash(prefix, at, at + LENGTH))


def _hot_windows(batches, folder: str, parts: int):
    """Per run: its windows under hot names, by part, as names are sent."""
    for (run,), rows in groups(batches, 1):
        hot = _union(blob for (blob,) in rows)
        ids, data, offsets = columns(read_file(folder, f"{run}.parquet"))
        found, owners = [], []
        for lo, hi in blocks(offsets):
            at, here = offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
            prefix = prefix_hash(here)
            start, size, name = stretches(here, at, prefix)
            doc = lo + np.searchsorted(at, start, "right") - 1
            keep = _among(_short(name), hot) & (ids[doc] != NOBODY)
            found.append(_single(prefix, start[keep], size[keep])[1])
            owners.append(np.repeat(ids[doc[keep]], size[keep]))
        windows = np.concatenate(found)
        yield rows_of(_by_part(parts, run, *_distinct(windows, np.concatenate(owners), windows)), _NAMES)


# ---- 3: sorted, front-coded suffixes


def front_code(suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Lengths shared with the suffix before, lengths of the rests, and the rests, of sorted suffixes."""
    shared, rest, out, last = [], [], [], b""
    for s in suffixes:
        m = min(len(s), len(last))
        if s[:m] == last[:m]:
            k = m
        else:
            x, y = int.from_bytes(s[:m], "big"), int.from_bytes(last[:m], "big")
            k = m - ((x ^ y).bit_length() + 7) // 8
        shared.append(k)
        rest.append(len(s) - k)
        out.append(s[k:])
        last = s
    return np.array(shared, np.uint8), np.array(rest, np.uint8), b"".join(out)


def _suffix_runs(batches, folder: str, parts: int):
    """(part, run, blob): each run's suffixes and single windows that may repeat; where they stand is written beside the run.

    Rows are (run, names, hot, windows). A part below `parts` has suffixes by name, one above has windows by their hash.
    """
    for (run,), rows in groups(batches, 1):
        wanted, hot, single = (_union(r[k] for r in rows if r[k]) for k in range(3))
        ids, data, offsets = columns(read_file(folder, f"{run}.parquet"))
        starts, sizes, shorts, docs, high = [], [], [], [], []
        for lo, hi in blocks(offsets):
            at, here = offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
            prefix = prefix_hash(here)
            start, size, name = stretches(here, at, prefix)
            short = _short(name)
            doc = lo + np.searchsorted(at, start, "right") - 1
            keep = _among(short, wanted) & (ids[doc] != NOBODY)
            parted = [(start[keep], size[keep], short[keep], doc[keep])]
            keep = _among(short, hot) & (ids[doc] != NOBODY)
            place, window = _single(prefix, start[keep], size[keep])
            again = _among(window, single)
            parted.append((place[again], np.ones(int(again.sum()), np.int64), window[again], np.repeat(doc[keep], size[keep])[again]))
            for k, (a, b, c, d) in enumerate(parted):
                starts.append(a + offsets[lo])
                sizes.append(b)
                shorts.append(c)
                docs.append(d)
                high.append(np.full(len(a), k))
        start, size, short, doc = (np.concatenate(x) for x in (starts, sizes, shorts, docs))
        part = part_of(short, NAME_BITS, parts) + parts * np.concatenate(high)
        order = np.argsort(part, kind="stable")
        start, size, doc, part = start[order], size[order], doc[order], part[order]
        del short, order, starts, sizes, shorts, docs, high
        raw = data.tobytes()
        del data
        numbers, places, holders, done = [], [], [], 0
        for p, lo, hi in slices(part):
            suffix = [raw[i : i + n + LENGTH - 1] for i, n in zip(start[lo:hi].tolist(), size[lo:hi].tolist(), strict=True)]
            inner = sorted(range(hi - lo), key=suffix.__getitem__)
            fresh = np.array([k == 0 or suffix[i] != suffix[inner[k - 1]] for k, i in enumerate(inner)], bool)
            heads = np.flatnonzero(fresh)
            distinct = [suffix[inner[k]] for k in heads.tolist()]
            inner = np.array(inner, np.int64) + lo
            owner = ids[doc[inner]]
            shared, rest, tail = front_code(distinct)
            blob = pack(np.array([done]), shared, rest, np.frombuffer(tail, np.uint8), np.minimum.reduceat(owner, heads), np.maximum.reduceat(owner, heads))
            numbers.append((done + np.cumsum(fresh) - 1).astype(np.int32))
            places.append(start[inner])
            holders.append(doc[inner].astype(np.int32))
            done += len(heads)
            yield rows_of([(p, run, blob)], {"part": pa.int32(), "run": pa.string(), "suffixes": pa.binary()})
        write_file(folder, f"{run}.places", pa.table({n: np.concatenate(x) if x else np.zeros(0, np.int64) for n, x in (("number", numbers), ("start", places), ("doc", holders))}))


# ---- 4: the merge


def merge(runs: list[tuple[np.ndarray, np.ndarray, bytes]]) -> Iterator[tuple[bytes, int, bool, int, int]]:
    """(suffix, length shared with the one before, whether it is equal to it, run, number in its run) in order.

    runs: front-coded, strictly ascending. A loser tree keeps, at each inner node, the run that lost there, and for each
    run the length that its head shares with the last suffix put out. Of two heads the one that shares more is smaller;
    if both share as much, only bytes behind that are compared, and the loser's shared length becomes its length shared
    with the winner.
    """
    n = len(runs)
    heads: list[bytes | None] = [None] * n
    shares = [0] * n
    numbers = [-1] * n
    places = [0] * n
    shared_of = [r[0].tolist() for r in runs]
    rest_of = [r[1].tolist() for r in runs]
    tails = [r[2] for r in runs]

    def advance(r: int) -> None:
        k = numbers[r] = numbers[r] + 1
        if k == len(shared_of[r]):
            heads[r] = None
            return
        # the last suffix put out is this run's own previous head, so the code's shared length is the one needed
        m, at = shared_of[r][k], places[r]
        heads[r] = (heads[r][:m] if m else b"") + tails[r][at : at + rest_of[r][k]]
        places[r], shares[r] = at + rest_of[r][k], m

    def beats(a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; the loser's shared length is brought up to the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return y is None
        if shares[a] != shares[b]:
            return shares[a] > shares[b]
        k = shares[a]
        m = min(len(x), len(y))
        while k < m and x[k] == y[k]:
            # whole stretches at once while they are equal
            step = 16
            while k + step <= m and x[k : k + step] == y[k : k + step]:
                k += step
            while k < m and x[k] == y[k]:
                k += 1
        first = x[k] < y[k] if k < m else (len(x), a) < (len(y), b)
        shares[b if first else a] = k
        return first

    for r in range(n):
        advance(r)
    size = 1
    while size < max(1, n):
        size *= 2
    loser = [-1] * size
    # play the first round from the leaves up
    level = list(range(n)) + [-1] * (size - n)
    base = size
    while len(level) > 1:
        base //= 2
        winners = []
        for i in range(0, len(level), 2):
            a, b = level[i], level[i + 1]
            if b < 0 or (a >= 0 and beats(a, b)):
                winners.append(a)
                loser[base + i // 2] = b
            else:
                winners.append(b)
                loser[base + i // 2] = a
        level = winners
    winner = level[0] if n else -1
    last = None
    while winner >= 0 and heads[winner] is not None:
        head = heads[winner]
        share = shares[winner]
        yield head, share, last is not None and share == len(head) == len(last), winner, numbers[winner]
        last = head
        advance(winner)
        node = (winner + size) // 2
        while node:
            other = loser[node]
            if other >= 0 and not beats(winner, other):
                loser[node], winner = winner, other
            node //= 2


# ---- 5: windows of the merged suffixes


def _window_minima(data: np.ndarray, start: np.ndarray, windows: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For every window of the suffixes, end to end, the least document of any equal window."""
    if not len(start):
        return np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(start)), windows)
    at = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    edges = np.append(start, len(data))
    keys = np.empty(len(at), np.uint64)
    done = 0
    for lo, hi in blocks(edges):
        n = int(windows[lo:hi].sum())
        here = at[done : done + n] - edges[lo]
        keys[done : done + n] = span_hash(prefix_hash(data[edges[lo] : edges[hi]]), here, here + LENGTH)
        done += n
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    head = np.ones(len(order), bool)
    head[1:] = sorted_keys[1:] != sorted_keys[:-1]
    heads = np.flatnonzero(head)
    counts = np.diff(np.append(heads, len(order)))
    least = np.minimum.reduceat(low[owner][order], heads)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(least, counts)
    # equal keys must be equal bytes: each against the first of its group, and by bytes where that fails
    first = np.repeat(at[order[heads]], counts)
    wrong: list[int] = []
    for lo in range(0, len(order), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        same = (data[at[order[part]][:, None] + np.arange(LENGTH)] == data[first[part][:, None] + np.arange(LENGTH)]).all(axis=1)
        wrong += (lo + np.flatnonzero(~same)).tolist()
    for key in {int(sorted_keys[k]) for k in wrong}:
        group = order[np.searchsorted(sorted_keys, np.uint64(key)) : np.searchsorted(sorted_keys, np.uint64(key), "right")]
        exact: dict[bytes, int] = {}
        for g in group.tolist():
            text = data[at[g] : at[g] + LENGTH].tobytes()
            exact[text] = min(exact.get(text, NOBODY), int(low[owner[g]]))
        for g in group.tolist():
            out[g] = exact[data[at[g] : at[g] + LENGTH].tobytes()]
    return out


def _repeats(batches):
    """(run, blob): for each run its suffix numbers with a range of windows and the least document that has them."""
    for _, rows in groups(batches, 1):
        names = [run for run, _ in rows]
        parts = [unpack(blob, 6) for _, blob in rows]
        distinct: list[bytes] = []
        low: list[int] = []
        holders: list[tuple[int, int, int]] = []  # distinct suffix, run, number in this part's list of the run
        for suffix, _, equal, r, k in merge([(p[1], p[2], p[3].tobytes()) for p in parts]):
            if not equal:
                distinct.append(suffix)
                low.append(NOBODY)
            low[-1] = min(low[-1], int(parts[r][4][k]))
            holders.append((len(distinct) - 1, r, k))
        data = np.frombuffer(b"".join(distinct), np.uint8)
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
        start = np.cumsum(sizes) - sizes
        windows = sizes - LENGTH + 1
        least = _window_minima(data, start, windows, np.array(low, np.int64))
        first = np.cumsum(windows) - windows
        which, run, number = np.array(holders, np.int64).reshape(-1, 3).T
        out = []
        for r in range(len(names)):
            mine = np.flatnonzero(run == r)
            base, high = int(parts[r][0][0]), parts[r][5]
            suffix = which[mine]
            owner = np.repeat(np.arange(len(mine)), windows[suffix])
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows[suffix]) - windows[suffix], windows[suffix])
            value = least[first[suffix][owner] + nth]
            told = value < high[number[mine]][owner]
            owner, nth, value = owner[told], nth[told], value[told]
            if not len(owner):
                continue
            # windows side by side with the same least document are told as one range
            head = np.ones(len(owner), bool)
            head[1:] = (owner[1:] != owner[:-1]) | (nth[1:] != nth[:-1] + 1) | (value[1:] != value[:-1])
            heads = np.flatnonzero(head)
            last = np.append(heads[1:], len(owner)) - 1
            out.append((names[r], pack((base + number[mine])[owner[heads]].astype(np.int32), nth[heads].astype(np.uint8), nth[last].astype(np.uint8), value[heads])))
        yield rows_of(out, {"run": pa.string(), "told": pa.binary()})


# ---- 6: cutting


def _cut(batches, folder: str):
    """Per run: (doc_id, kept bytes, bytes, removed bytes, removed runs) of its documents."""
    for (run,), rows in groups(batches, 1):
        ids, data, offsets = columns(read_file(folder, f"{run}.parquet"))
        marks = np.zeros(len(data) + 1, np.int32)
        told = [unpack(blob, 4) for (blob,) in rows if blob]
        if told:
            places = read_file(folder, f"{run}.places")
            number, start, doc = (places.column(c).to_numpy() for c in ("number", "start", "doc"))
            suffix, lo, hi, least = (np.concatenate([t[k] for t in told]) for k in range(4))
            begin, end = np.searchsorted(number, suffix), np.searchsorted(number, suffix, "right")
            owner = np.repeat(np.arange(len(suffix)), end - begin)
            at = begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin)
            later = ids[doc[at]] > least[owner]
            owner, at = owner[later], at[later]
            np.add.at(marks, start[at] + lo[owner], 1)
            np.add.at(marks, start[at] + hi[owner] + LENGTH, -1)
        np.cumsum(marks, out=marks)
        gone = marks[:-1] > 0
        del marks
        for a in range(0, len(ids), 250):
            b = min(a + 250, len(ids))
            rows = []
            for k in range(a, b):
                i, j = int(offsets[k]), int(offsets[k + 1])
                mine = gone[i:j]
                spans = int(np.count_nonzero(mine[1:] & ~mine[:-1])) + int(j > i and mine[0])
                rows.append((None if ids[k] == NOBODY else int(ids[k]), data[i:j][~mine].tobytes(), j - i, int(np.count_nonzero(mine)), spans))
            yield rows_of(rows, {"doc_id": pa.int64(), "kept": pa.binary(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64()})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans) for every row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = scratch_path(spark, "suffix-runs")
    rows = docs.select(whole_number(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a part gets the names of about a tenth of the bytes, at some 4 bytes each
    parts = max(2 * spark.sparkContext.defaultParallelism, size // (PART_BYTES * 2) + 1)
    named = materialise(rows.mapInArrow(releasing(lambda b: cut_runs(b, folder, RUN_BYTES, _names_by_part(parts))), _NAMES_SCHEMA), "suffix-names")
    every = materialise(named.filter("part < 0").select("run", F.lit(None).cast("binary").alias("told")), "suffix-runs-list")
    # a run is read again as a whole, so runs are dealt to tasks by their number and not by the size of what is said of them
    tasks = max(1, min(every.count(), MOST_TASKS))
    again = lambda df: df.repartition(tasks, "run").sortWithinPartitions("run")

    def ask(names: DataFrame, hot: int, name: str) -> DataFrame:
        """Which of the runs' names two documents have; a written table (run, names, hot)."""
        by_part = names.repartition("part").sortWithinPartitions("part", "run")
        return materialise(by_part.mapInArrow(releasing(_repeated_names(hot)), "run string, names binary, hot binary"), name)

    none = F.lit(None).cast("binary")
    repeated = ask(named.filter("part >= 0"), HOT, "suffix-repeated")
    drop(named)
    hot_runs = again(repeated.select("run", "hot").filter(F.octet_length("hot") > OF_NONE))
    windows = ask(hot_runs.mapInArrow(releasing(lambda b: _hot_windows(b, folder, parts)), _NAMES_SCHEMA), EVERY, "suffix-windows")
    wanted = repeated.select("run", "names", "hot", none.alias("windows")).unionByName(windows.select("run", none.alias("names"), none.alias("hot"), F.col("names").alias("windows")))
    suffixes = again(wanted).mapInArrow(releasing(lambda b: _suffix_runs(b, folder, parts)), "part int, run string, suffixes binary")
    told = suffixes.repartition("part").sortWithinPartitions("part", "run").mapInArrow(releasing(_repeats), "run string, told binary")
    return again(told.unionByName(every)).mapInArrow(releasing(lambda b: _cut(b, folder)), "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`remove_repeats` with the kept bytes as their SHA-256."""
    found = remove_repeats(docs, id_col, text_col)
    return found.select(F.col("doc_id").alias(id_col), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
