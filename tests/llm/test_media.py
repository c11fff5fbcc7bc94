import hashlib
import io
import wave
import zlib

import helpers
import numpy as np
from tokenloom.llm import media


def test_files_are_wave_files_and_come_back():
    for text in (b"", b"x", b"y" * 64, bytes(range(256)) * 3):
        raw = media.payload(text)
        assert len(raw) % 64 == 0 and len(raw) > 0 and raw.startswith(text)
        file = media.wav(raw)
        with wave.open(io.BytesIO(file)) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 1, media.RATE) and w.readframes(w.getnframes()) == raw
        assert media.samples(file) == (raw, media.RATE)


def test_resampling_equals_filtering_then_dropping():
    rng = np.random.default_rng(0)
    for n in (64, 65, 1000):
        x = rng.standard_normal(n).astype(np.float32)
        taps = media._lowpass()
        padded = np.concatenate((np.zeros(16), x, np.zeros(48)))
        whole = np.array([(padded[i : i + 32] * taps).sum() for i in range(0, n, 2)])
        assert np.allclose(media.resample(x), whole, atol=1e-5)


def test_segments():
    def plain(energy):
        z = (energy - energy.mean()) / energy.std()
        out, start = [], None
        for k, v in enumerate(z):
            if start is None and v > media.HIGH:
                start = k
            elif start is not None and v < media.LOW:
                out.append((start, k))
                start = None
        return out + ([(start, len(z))] if start is not None else [])

    rng = np.random.default_rng(1)
    for _ in range(200):
        e = rng.standard_normal(rng.integers(2, 60)).cumsum()
        assert media.segments(e) == plain(e)
    assert media.segments(np.ones(5)) == []


def test_frames_cover_all_and_tensors_have_one_shape():
    for n in (64, 300, 5000):
        mel, _, hop = media.analyse(media.wav(bytes(64) * (n // 64 + 1)))
        windows = list(media.tensors(mel, hop))
        assert all(w.shape == (media.FRAMES, media.MELS) for _, _, w in windows) and windows[-1][1] == len(mel) * hop


def test_documents(spark):
    stored = media.store(helpers.awkward(spark))
    rows = media.digest(stored).collect()
    assert len(rows) == len(helpers.ROWS)
    texts = {i: t for i, t, *_ in helpers.ROWS}
    for r in rows:
        raw = media.payload((texts[r.doc_id] or "").encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((texts[r.doc_id] or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(raw) + 44, hashlib.sha256(media.wav(raw)).hexdigest())
    assert len({r.feature for r in rows if r.doc_id in (1, 5, None)}) == 1 and len({r.feature for r in rows if r.doc_id in (2, 3)}) == 1
    cut = media.windows(stored).filter("doc_id = 4").orderBy("window").collect()
    assert all(len(r.log_mel) == media.FRAMES * media.MELS for r in cut) and cut[0].end_s == cut[1].start_s
    import pyarrow as pa

    assert media.tensor_array(pa.array([r.log_mel for r in cut], pa.list_(pa.float32()))).to_numpy_ndarray().shape == (len(cut), media.FRAMES, media.MELS)
    assert media.digest(media.store(helpers.empty(spark))).count() == 0


def test_the_digest_reads_stored_tensors(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    stored = media.store(helpers.awkward(spark))
    folder = f"file://{tmp_path}/tensors"
    rows = media.digest(stored, folder=folder).collect()
    tables = [pq.read_table(f) for f in sorted((tmp_path / "tensors").glob("*.parquet"))]
    assert tables and all(t.schema.field("log_mel").type == pa.fixed_shape_tensor(pa.float32(), (media.FRAMES, media.MELS)) for t in tables)
    cut = sorted((str(r.doc_id), r.window, r.start_s, r.end_s, tuple(r.log_mel)) for r in media.windows(stored).collect())
    kept = sorted((str(i), w, s, e, tuple(x.ravel().tolist())) for t in tables for i, w, s, e, x in zip(*[t.column(c).to_pylist() for c in ("doc_id", "window", "start_s", "end_s")], t.column("log_mel").combine_chunks().to_numpy_ndarray(), strict=True))
    assert kept == cut and len(kept) == sum(int(r.feature.split("windows=")[1].split(";")[0]) for r in rows)
    for r in stored.collect():
        mel, active, hop_s = media.analyse(bytes(r.media))
        mean = ",".join(f"{x:.3f}" for x in mel.mean(axis=0, dtype=float))
        start = f"frames={len(mel)};windows={-(-len(mel) // media.FRAMES)};segments={len(active)};active_s={sum(e - s for s, e in active) * hop_s:.3f};"
        assert all(x.feature.startswith(start) and f";mean={mean};" in x.feature for x in rows if x.doc_id == r.doc_id)


def test_log_mel_equals_a_plain_transform():
    """Sums over samples, one frequency after another, and triangles from their definition."""
    rng = np.random.default_rng(2)
    signal = rng.standard_normal(700).astype(np.float32)
    got = media.log_mel(signal)
    rate = media.RATE / 2
    to_mel, from_mel = lambda f: 2595 * np.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = [from_mel(to_mel(rate / 2) * k / (media.MELS + 1)) for k in range(media.MELS + 2)]
    n = np.arange(media.FRAME)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * n / (media.FRAME - 1))
    assert len(got) == -(-(700 - media.FRAME) // media.HOP) + 1
    for f in range(len(got)):
        part = np.zeros(media.FRAME)
        piece = signal[f * media.HOP : f * media.HOP + media.FRAME]
        part[: len(piece)] = piece
        power = [abs((part * window * np.exp(-2j * np.pi * k * n / media.FRAME)).sum()) ** 2 for k in range(media.FRAME // 2 + 1)]
        for m in range(media.MELS):
            low, top, high = edges[m : m + 3]
            total = 0.0
            for k, p in enumerate(power):
                hz = k * rate / media.FRAME
                total += p * max(0.0, min((hz - low) / (top - low), (high - hz) / (high - top)))
            assert abs(got[f, m] - np.log(total + 1e-10)) < 1e-3
