"""Vectorised 64-bit keys of words, shingles and byte windows."""

from __future__ import annotations

import hashlib

import numpy as np

_STEP = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def counter(n: int, seed: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_STEP) + np.uint64(seed))


#: A random-looking word for each byte, and the odd base of the polynomial with its inverse modulo 2^64.
BYTE_KEYS = counter(256, 11)
BASE = 0xD1342543DE82EF95
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(1 << 20, 1 << int(n - 1).bit_length()) + 1
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            with np.errstate(over="ignore"):
                out = np.full(size, np.uint64(base))
                out[0] = 1
                _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] the polynomial of data[i:j], still scaled by BASE**i."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_KEYS[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit key of each data[start:end]; equal bytes have equal keys wherever they stand.

    Different bytes may have equal keys, some texts of 1,024 bytes and more (Thue-Morse words) surely: where a key decides
    a result, the bytes are compared too. Words take `word_keys`.
    """
    _, down = _powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(_STEP))


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-separator bytes within rows, and each row's first word (with one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = ~inside[:-1]
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] = True
    last[edges - 1] = True
    starts = np.flatnonzero(inside & first)
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Words of more bytes get their key from a cryptographic hash, one by one; the others in steps of 8 bytes.
LONG = 64
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number; behind the end stand zeros."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit key of each word. Words of equal length up to 8 bytes never share a key; longer ones are chained by 8 bytes.

    Words of different length can share a key. Without a seed such words can be made on purpose: where a key decides a
    result, either the bytes are compared too or the seed is drawn for the job.
    """
    size = ends - starts
    eights = _eights(data)
    with np.errstate(over="ignore"):
        keys = mix(size.astype(np.uint64) * np.uint64(_STEP) + np.uint64(seed))
        alive = np.flatnonzero(size <= LONG)
        for p in range(0, LONG, 8):
            alive = alive[size[alive] > p]
            if not len(alive):
                break
            keys[alive] = mix(keys[alive] + (eights[starts[alive] + p] & _LOW_BYTES[np.minimum(size[alive] - p, 8)]))
    for k in np.flatnonzero(size > LONG).tolist():
        keys[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
    return keys


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a:a+size] equals data[b:b+size], for each k."""
    eights = _eights(data)
    same = np.ones(len(a), bool)
    alive = np.flatnonzero((size > 0) & (a != b))
    p = 0
    while len(alive) and p < LONG:
        same[alive] = ((eights[a[alive] + p] ^ eights[b[alive] + p]) & _LOW_BYTES[np.minimum(size[alive] - p, 8)]) == 0
        p += 8
        alive = alive[same[alive] & (size[alive] > p)]
    for k in alive.tolist():
        same[k] = np.array_equal(data[a[k] + p : a[k] + size[k]], data[b[k] + p : b[k] + size[k]])
    return same


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct word its key and an occurrence, and the distinct word of each occurrence; bytes tell words apart, not keys."""
    keys, example, inverse = np.unique(word_keys(data, starts, ends), return_index=True, return_inverse=True)
    size = ends - starts
    wrong = size != size[example[inverse]]
    wrong[~wrong] = ~same_bytes(data, starts[~wrong], starts[example[inverse[~wrong]]], size[~wrong])
    extra: dict[bytes, int] = {}
    more, more_keys = [], []
    for k in np.flatnonzero(wrong).tolist():
        word = data[starts[k] : ends[k]].tobytes()
        if word not in extra:
            extra[word] = len(keys) + len(more)
            more.append(k)
            more_keys.append(keys[inverse[k]])
        inverse[k] = extra[word]
    return np.append(keys, np.array(more_keys, np.uint64)), np.append(example, np.array(more, np.int64)), inverse
