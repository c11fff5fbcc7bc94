import itertools
import zlib

import helpers
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenloom.llm import piecesampling as ps

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return ps.PieceModel(PATH)


def encode(sampler, texts, keys):
    parts = [t.encode() for t in texts]
    ids, at = sampler.encode(np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts]))), np.array(keys))
    return [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))]


def segmentations(model, word):
    """All segmentations of the bytes, with their weights, by trying every cut."""
    pieces = {bytes(model.pool[model.start[i] : model.start[i] + model.size[i]]): i for i in range(len(model.size)) if model.size[i] and i not in set(model.byte_id.tolist())}
    text = word.decode()
    units = [c.encode() for c in text]
    out = {}
    for cuts in itertools.product([0, 1], repeat=len(units) - 1):
        parts, now = [], [units[0]]
        for c, u in zip(cuts, units[1:]):
            if c:
                parts.append(now)
                now = []
            now.append(u)
        parts.append(now)
        ids, weight = [], 0.0
        for p in parts:
            raw = b"".join(p)
            if raw in pieces:
                ids.append(pieces[raw])
                weight += model.weights[pieces[raw]]
            elif len(p) == 1:
                ids += [int(model.byte_id[b]) for b in raw]
                weight += len(raw) * model.byte_weight
            else:
                break
        else:
            out[tuple(ids)] = weight
    return out


@pytest.mark.parametrize("word", ["the", "hello", "aé☃b"])
def test_draws_follow_the_lattice(model, word):
    every = segmentations(model, (" " + word).encode())
    top = max(every.values())
    share = {k: np.exp(w - top) for k, w in every.items()}
    total = sum(share.values())
    n = 20_000
    got = encode(ps.Sampler(model), [word] * n, range(n))
    counts = {}
    for g in got:
        counts[tuple(g)] = counts.get(tuple(g), 0) + 1
    assert set(counts) <= set(share)
    for k, w in share.items():
        p = w / total
        assert abs(counts.get(k, 0) / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-3


TEXTS = ["", " ", "  two  spaces ", "line\nbreak\n\n", "▁ real ▁", "日本語 żółć 🎉", "a" * 3000, "tab\tand\x00nul", helpers.LONG[:5000], helpers.WORDS]


def test_lossless_and_reproducible(model):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    sampler = ps.Sampler(model)
    one = encode(sampler, TEXTS, range(len(TEXTS)))
    for text, ids in zip(TEXTS, one, strict=True):
        data, _ = sampler.decode(np.array(ids, np.int64), np.array([0, len(ids)]))
        assert data.tobytes().decode() == text
        assert library.decode(ids) == text
    # alone, in another order, after other texts: the same
    fresh = ps.Sampler(model)
    for k in reversed(range(len(TEXTS))):
        assert encode(fresh, [TEXTS[k]], [k]) == [one[k]]
    assert encode(sampler, [helpers.WORDS] * 2, [1, 2])[0] != encode(sampler, [helpers.WORDS] * 2, [1, 2])[1]
    assert encode(ps.Sampler(model, seed=5), [helpers.WORDS], [9]) != encode(ps.Sampler(model, seed=6), [helpers.WORDS], [9])


def test_cold_sampling_takes_the_best_path(model):
    cold = ps.PieceModel(PATH, temperature=0.01)
    best = max((every := segmentations(model, b" hello")), key=every.get)
    assert encode(ps.Sampler(cold), ["hello"], [3]) == [list(best)]


def test_documents(spark):
    df = helpers.awkward(spark)
    rows = ps.training_rows(df, PATH).collect()
    assert len(rows) == df.count() and all(r.lossless for r in rows)
    for r in rows:
        assert r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert len({tuple(r.ids) for r in rows if r.doc_id == 5}) == 1 and {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {0}
    back = {r.doc_id: r.text for r in ps.decode(ps.encode(df, PATH), PATH).collect()}
    assert all(back[i] == (t or "") for i, t, *_ in helpers.ROWS)
    assert ps.digest(helpers.empty(spark), PATH).count() == 0


def test_words_that_are_hard_to_tell_apart(model):
    texts, sampler = helpers.colliding(), ps.Sampler(model)
    for t, ids in zip(texts, encode(sampler, texts, range(len(texts))), strict=True):
        assert sampler.decode(np.array(ids, np.int64), np.array([0, len(ids)]))[0].tobytes().decode() == t


def test_a_text_that_does_not_come_back_ends_the_job(monkeypatch):
    monkeypatch.setattr(ps, "distinct_words", lambda data, starts, ends: (np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(len(starts), np.int64)))
    with pytest.raises(Exception, match="does not come back"):
        list(ps._rows_of_batches([pa.RecordBatch.from_pydict({"id": [1], "text": ["one two"], "key": [5]})], PATH, 0, 1.0, "id"))
