"""Audio features of stored 8-bit media.

`store` turns payload bytes into WAV files (8-bit PCM, one channel), `save_windows` reads the stored files back and
computes log-mel energies, which it writes as windows to tensor files in the shared folder; `digest` reads these and
computes the features and the active segments. Per file:

* polyphase resampling by 1/2: only every second output of a low-pass filter is computed, from its two phases;
* overlapped frames (256 samples, hop 128), power spectra, triangular mel filters, logarithm;
* segments by hysteresis: a segment opens when a frame's energy exceeds the file's mean by HIGH deviations and
  closes when it falls under LOW deviations;
* fixed-shape tensors: the frames are cut into windows of FRAMES x MELS, the last one padded with silence, each
  with its time span in seconds.

Null texts count as empty; an empty text is one block of 64 zero bytes. Equal texts have equal results. Texts of any length
are one file each and are read whole, one after another; extra columns do not matter. An empty table has an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import blocks, materialise, releasing, scratch_path, small_batches, utf8
from .runs import groups, read_file, rows_of, write_file

BLOCK = 64
RATE = 8000
FRAME, HOP = 256, 128
MELS, FRAMES = 16, 32
TAPS = 32
HIGH, LOW = 0.5, -0.25
SILENCE = -100.0
HEADER = 44
#: Bytes of files that are handed on together, about.
PACK_BYTES = 16 << 20
#: Windows in a tensor file, about, or those of one longer document.
FILE_WINDOWS = 2048


def payload(text: bytes) -> bytes:
    """The bytes, with zeros up to a positive multiple of BLOCK."""
    return text + b"\0" * (-len(text) % BLOCK if text else BLOCK)


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A WAV file of unsigned 8-bit samples in one channel."""
    n = len(samples)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + samples


def samples(file: bytes) -> tuple[bytes, int]:
    """The samples and the rate of a WAV file as `wav` writes it; the header is checked."""
    riff, _, kind, fmt, size, codec, channels, rate, _, _, bits, data, n = struct.unpack("<4sI4s4sIHHIIHH4sI", file[:HEADER])
    if (riff, kind, fmt, size, codec, channels, bits, data) != (b"RIFF", b"WAVE", b"fmt ", 16, 1, 1, 8, b"data"):
        raise ValueError("not an 8-bit PCM file of one channel")
    return file[HEADER : HEADER + n], rate


def _lowpass() -> np.ndarray:
    at = np.arange(TAPS) - (TAPS - 1) / 2
    taps = np.sinc(at / 2) * np.hamming(TAPS)
    return (taps / taps.sum()).astype(np.float32)


def _mel_filters(rate: float) -> np.ndarray:
    """FRAME // 2 + 1 by MELS triangles, evenly spaced in mel."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    bins = np.linspace(0, rate / 2, FRAME // 2 + 1)[:, None]
    up = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


_PHASES = _lowpass().reshape(-1, 2)
_MEL = _mel_filters(RATE / 2)
_WINDOW = np.hanning(FRAME).astype(np.float32)


def resample(signal: np.ndarray) -> np.ndarray:
    """Half the rate: the even and the odd samples each pass one phase of the filter."""
    half = TAPS // 2
    padded = np.zeros(len(signal) + len(signal) % 2 + 2 * half, np.float32)
    padded[half : half + len(signal)] = signal
    n = (len(signal) + 1) // 2
    out = np.zeros(n, np.float32)
    for phase in (0, 1):
        line = padded[phase::2]
        for k, tap in enumerate(_PHASES[:, phase]):
            out += tap * line[k : k + n]
    return out


def log_mel(signal: np.ndarray) -> np.ndarray:
    """Frames by MELS; the signal's end is padded so that every sample is in a frame."""
    frames = max(1, -(-max(0, len(signal) - FRAME) // HOP) + 1)
    padded = np.zeros((frames - 1) * HOP + FRAME, np.float32)
    padded[: len(signal)] = signal
    out = np.empty((frames, MELS), np.float32)
    view = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    for lo in range(0, frames, 2048):
        power = np.abs(np.fft.rfft(view[lo : lo + 2048] * _WINDOW, axis=1)).astype(np.float32) ** 2
        out[lo : lo + 2048] = np.log(power @ _MEL + 1e-10)
    return out


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges that open over the high threshold and last until under the low one."""
    spread = float(energy.std())
    if spread == 0:
        return []
    z = (energy - float(energy.mean())) / spread
    state = np.where(z > HIGH, 1, np.where(z < LOW, -1, 0))
    set_at = np.maximum.accumulate(np.where(state != 0, np.arange(len(z)), -1))
    active = (set_at >= 0) & (state[np.maximum(set_at, 0)] == 1)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], active, [False])).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def analyse(file: bytes) -> tuple[np.ndarray, list[tuple[int, int]], float]:
    """Log-mel frames, active frame ranges and seconds per hop of a stored file."""
    raw, rate = samples(file)
    signal = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(signal))
    return mel, segments(mel.mean(axis=1)), HOP / (rate / 2)


def tensors(mel: np.ndarray, hop_s: float) -> Iterator[tuple[float, float, np.ndarray]]:
    """Windows of FRAMES x MELS with start and end in seconds; the last is padded with SILENCE."""
    for lo in range(0, len(mel), FRAMES):
        part = mel[lo : lo + FRAMES]
        window = np.full((FRAMES, MELS), SILENCE, np.float32)
        window[: len(part)] = part
        yield lo * hop_s, (lo + len(part)) * hop_s, window


TENSOR = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))


def tensor_array(values: pa.Array) -> pa.ExtensionArray:
    """A column of flattened windows as Arrow fixed-shape tensors."""
    flat = values.flatten().cast(pa.float32())
    return pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(flat, FRAMES * MELS))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every text as a WAV file into a table of the shared folder; the table, as it is read back."""
    small_batches(docs.sparkSession)

    def pack(batches):
        for b in batches:
            data, offsets = utf8(b.column(1))
            for lo, hi in blocks(offsets, PACK_BYTES):
                ends = zip(offsets[lo:hi].tolist(), offsets[lo + 1 : hi + 1].tolist(), strict=True)
                files = [wav(payload(data[i:j].tobytes())) for i, j in ends]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets[lo : hi + 1])), pa.array(files, pa.binary())], names=[id_col, "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    packed = docs.select(id_col, text_col).mapInArrow(pack, f"`{id_col}` {kind}, n_bytes long, media binary")
    return materialise(packed, "media")


def windows(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per window of each stored file: id, window number, time span and the flattened FRAMES x MELS tensor."""

    def cut(batches):
        for b in batches:
            ids, files = b.column(0).to_pylist(), b.column(1)
            for i, file in zip(ids, files, strict=True):
                mel, _, hop_s = analyse(file.as_py())
                rows = list(tensors(mel, hop_s))
                for lo in range(0, len(rows), 512):
                    part = rows[lo : lo + 512]
                    flat = pa.array(np.concatenate([w.ravel() for _, _, w in part]))
                    lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, FRAMES * MELS, dtype=np.int32), flat)
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(part), b.column(0).type), pa.array(range(lo, lo + len(part)), pa.int32()), pa.array([s for s, _, _ in part]), pa.array([e for _, e, _ in part]), lists], names=[id_col, "window", "start_s", "end_s", "log_mel"])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, "media").mapInArrow(cut, f"`{id_col}` {kind}, window int, start_s double, end_s double, log_mel array<float>")


def _described(kind: pa.DataType, id_col: str) -> dict[str, pa.DataType]:
    """What is known of a stored file before its windows are read back."""
    return {id_col: kind, "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string()}


_DESCRIBED = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def save_windows(media: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Write the windows of every stored file to tensor files in `folder`; per stored file its place there and checksums.

    A tensor file is Parquet with id, window, start_s, end_s and log_mel, an Arrow fixed-shape tensor of FRAMES x MELS.
    The windows of one stored file stand together in one tensor file, `windows` rows from row `first` on.
    """

    def save(batches):
        part, number, held = TaskContext.get().partitionId(), 0, 0
        waiting: list[pa.RecordBatch] = []
        index: list[tuple] = []

        def finish() -> pa.RecordBatch:
            nonlocal number, held, waiting, index
            write_file(folder, f"{part:07d}-{number:04d}.parquet", pa.Table.from_batches(waiting))
            rows = rows_of(index, {"tensors": pa.string(), "first": pa.int64(), "windows": pa.int64()} | _described(kind, id_col))
            number, held, waiting, index = number + 1, 0, [], []
            return rows

        for b in batches:
            kind = b.column(0).type
            for i, n, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                file = file.as_py()
                raw, _ = samples(file)
                mel, _, hop_s = analyse(file)
                starts, ends, parts = zip(*tensors(mel, hop_s), strict=True)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([w.ravel() for w in parts])), FRAMES * MELS)
                columns = [pa.array([i] * len(parts), kind), pa.array(range(len(parts)), pa.int32()), pa.array(starts), pa.array(ends), pa.ExtensionArray.from_storage(TENSOR, flat)]
                waiting.append(pa.RecordBatch.from_arrays(columns, names=[id_col, "window", "start_s", "end_s", "log_mel"]))
                index.append((f"{part:07d}-{number:04d}.parquet", held, len(parts), i, n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-BLOCK:]), len(file), hashlib.sha256(file).hexdigest()))
                held += len(parts)
                if held >= FILE_WINDOWS:
                    yield finish()
        if waiting:
            yield finish()

    kind = media.schema[id_col].dataType.simpleString()
    saved = media.select(id_col, "n_bytes", "media").mapInArrow(releasing(save), f"tensors string, first long, windows long, `{id_col}` {kind}, {_DESCRIBED}")
    return materialise(saved, "media-windows")


def feature(start_s: np.ndarray, end_s: np.ndarray, windows: np.ndarray) -> str:
    """The features in short of the windows of one file, from their tensors and time spans."""
    hop_s = HOP / (RATE / 2)
    frames = np.rint((end_s - start_s) / hop_s).astype(np.int64)
    mel = np.concatenate([w[:n] for w, n in zip(windows, frames.tolist(), strict=True)])
    active = segments(mel.mean(axis=1))
    mean, spread = mel.mean(axis=0, dtype=np.float64), mel.std(axis=0, dtype=np.float64)
    spans = hashlib.sha256(",".join(f"{s}:{e}" for s, e in active).encode()).hexdigest()[:16]
    return f"frames={len(mel)};windows={len(windows)};segments={len(active)};active_s={sum(e - s for s, e in active) * hop_s:.3f};spans={spans};mean=" + ",".join(f"{x:.3f}" for x in mean) + ";std=" + ",".join(f"{x:.3f}" for x in spread)


def digest(media: DataFrame, id_col: str = "doc_id", folder: str | None = None) -> DataFrame:
    """One row per stored file: sizes and checksums of what is read back, and the features of its stored windows in short."""
    folder = folder or scratch_path(media.sparkSession, "media-tensors")
    saved = save_windows(media, folder, id_col)

    def read(batches):
        for (name,), rows in groups(batches, 1):
            table = read_file(folder, name).combine_chunks()
            ids, number = table.column(0).to_pylist(), table.column(1).to_numpy()
            start_s, end_s = table.column(2).to_numpy(), table.column(3).to_numpy()
            values = table.column(4).chunk(0).to_numpy_ndarray()
            out = []
            for first, n, *known in rows:
                here = slice(first, first + n)
                if len(number[here]) != n or (number[here] != np.arange(n)).any() or any(i != known[0] for i in ids[here]):
                    raise ValueError(f"{name} does not hold the windows of {known[0]}")
                out.append((*known, feature(start_s[here], end_s[here], values[here])))
            yield rows_of(out, _described(table.schema.field(0).type, id_col) | {"feature": pa.string()})

    kind = media.schema[id_col].dataType.simpleString()
    dealt = saved.repartition("tensors").sortWithinPartitions("tensors", "first")
    return dealt.mapInArrow(releasing(read), f"`{id_col}` {kind}, {_DESCRIBED}, feature string")
