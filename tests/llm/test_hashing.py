import random

import helpers
import numpy as np
from tokenloom.llm import hashing


def spans(words):
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return data, ends - [len(w) for w in words], ends


def check(words):
    keys, example, inverse = hashing.distinct_words(*spans(words))
    assert len(keys) == len(example) == len(set(words)) and all(words[example[inverse[k]]] == w for k, w in enumerate(words))


def test_words_are_told_apart_by_their_bytes(monkeypatch):
    rng = random.Random(1)
    words = [bytes(rng.choice(b"ab\0") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 63, 64, 65, 200]))) for _ in range(2000)]
    words += [w.encode() for n in (1024, 4096) for w in helpers.thue_morse(n)] * 2 + [b"a" * k for k in range(1, 300)]
    check(words)
    keys = hashing.word_keys(*spans(words))
    assert len(set(keys.tolist())) == len(set(words))
    # even if keys collide
    monkeypatch.setattr(hashing, "word_keys", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    check(words)


def test_keys_depend_on_the_bytes_alone():
    words = [b"abc", b"x" * 70, b"abc", b"abcd" * 5]
    a, b = hashing.word_keys(*spans(words)), hashing.word_keys(*spans(list(reversed(words))))
    assert a.tolist() == b[::-1].tolist() and a[0] == a[2]
