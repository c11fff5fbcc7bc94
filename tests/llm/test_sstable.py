import io
import random
import zlib

import helpers
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from tokenloom.llm import sstable

PATH = public_tokenizers.path("word_bpe_49k.json")


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


def shard(entries, width=2):
    sink = io.BytesIO()
    w = sstable.ShardWriter(sink, width)
    for i, ids in entries:
        w.add(sstable.key_of(i), np.array(ids))
    w.close()
    return sstable.ShardReader(Source(sink.getvalue()))


def test_shard_round_trip_and_lookup(monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 200)
    rng = random.Random(1)
    ids = sorted(rng.sample(range(-500, 5000), 300)) + [6000, 6000, 6000]
    entries = [(None, [7])] + [(i, [rng.randrange(60000) for _ in range(rng.randint(0, 20))]) for i in ids]
    r = shard(entries)
    assert len(r.index) > 10 and r.docs == len(entries) and r.ids == sum(len(v) for _, v in entries)
    assert [(i, v.tolist()) for i, v in r.scan()] == entries
    for i, v in entries:
        assert v in [x.tolist() for x in r.get(i)]
    assert len(r.get(6000)) == 3 and r.get(9999) == [] and r.get(-501) == []
    assert sum(r.may_hold(sstable.key_of(i)) for i in range(10_000, 12_000)) < 100


def test_damage_is_noticed():
    sink = io.BytesIO()
    w = sstable.ShardWriter(sink)
    w.add(sstable.key_of(1), np.arange(50))
    w.close()
    bad = bytearray(sink.getvalue())
    bad[len(sstable.MAGIC) + 1] ^= 1
    with pytest.raises(Exception, match="damaged|ecompress"):
        list(sstable.ShardReader(Source(bytes(bad))).scan())
    with pytest.raises(ValueError, match="ascend"):
        w = sstable.ShardWriter(io.BytesIO())
        w.add(sstable.key_of(2), np.arange(2))
        w.add(sstable.key_of(1), np.arange(2))


def test_encoder_equals_the_library():
    rng = random.Random(3)
    pieces = ["Word", "it's", "don't", ",", ".", "(x)", "é", "é", "Å", "́", "ΑΣ", "ß", "3.14", "a.b", "<|endoftext|>", "<|", "||", " ", "\t", " ", "\n", "x", "日本", "🎉", '"quoted"', "I'LL", "$5", "#tag", "...'s", "x.̸", "≠"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["", helpers.LONG]
    encoder, reference = sstable.WordEncoder(PATH), Tokenizer.from_file(PATH)
    for lo in range(0, len(texts), 50):
        part = [t.encode() for t in texts[lo : lo + 50]]
        ids, at = encoder.encode(np.frombuffer(b"".join(part), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in part]))))
        for k, t in enumerate(texts[lo : lo + 50]):
            assert ids[at[k] : at[k + 1]].tolist() == reference.encode(t, add_special_tokens=False).ids, repr(t)


def test_documents(spark):
    reference = Tokenizer.from_file(PATH)
    manifest = sstable.write(helpers.awkward(spark), PATH)
    rows = sorted(sstable.digest(manifest).collect(), key=lambda r: r.start)
    expected = sorted(((i, reference.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, *_ in helpers.ROWS), key=lambda x: (x[0] is not None, x[0] or 0))
    start = 0
    for r, (i, ids) in zip(rows, expected, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: r.ids for r in sstable.read(manifest).collect()}[9] == dict(expected)[9]
    found = sstable.lookup(manifest, spark.createDataFrame([(9,), (5,), (77,)], "doc_id long")).collect()
    assert sorted(r.doc_id for r in found) == [5, 5, 9] and next(r.ids for r in found if r.doc_id == 9) == dict(expected)[9]
    assert sstable.digest(sstable.write(helpers.empty(spark), PATH)).count() == 0


def test_words_that_are_hard_to_tell_apart(spark):
    texts, reference = helpers.colliding(), Tokenizer.from_file(PATH)
    got = {r.doc_id: r.ids_crc32 for r in sstable.digest(sstable.write(helpers.docs(spark, texts), PATH)).collect()}
    assert got == {k: zlib.crc32(np.array([*reference.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for k, t in enumerate(texts)}


def test_other_vocabularies_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, reference = sstable.WordEncoder(path), Tokenizer.from_file(path)
    assert not encoder.by_parts and sstable.WordEncoder(PATH).by_parts
    texts = ["One two,  three\n\n x", "", " lead and trail "]
    parts = [t.encode() for t in texts]
    ids, at = encoder.encode(np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts]))))
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(3)] == [reference.encode(t, add_special_tokens=False).ids for t in texts]
