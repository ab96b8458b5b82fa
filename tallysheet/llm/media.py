"""Media columns: WAV files in a binary column, their spectrograms, and spectral-peak pair fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallysheet.llm.common import columns

UNIT, RATE = 64, 8000
WINDOW, HOP = 256, 128
#: A peak is the largest value within so many frames and bins on each side.
NEAR_FRAMES, NEAR_BINS = 5, 8
#: Each peak is paired with so many of later frames, up to so many frames away.
FANOUT, FAR_FRAMES = 3, 63
#: Frames of which the spectrogram is held at once.
BLOCK = 4096
HANN = np.hanning(WINDOW).astype(np.float32)


def payload(text: str | None) -> tuple[bytes, int]:
    """The text as UTF-8 (null: empty) with bytes 0 up to a positive multiple of 64, and its length without them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def to_wav(samples: bytes) -> bytes:
    """8-bit mono WAV: each byte is one unsigned sample, so the payload is stored without loss."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if w.getnchannels() != 1 or w.getsampwidth() != 1:
            raise ValueError("8-bit mono is expected")
        return w.readframes(w.getnframes())


def _running_max(a: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """The largest value within reach on each side along an axis."""
    pad = [(0, 0), (0, 0)]
    pad[axis] = (reach, reach)
    a, width, have = np.pad(a, pad, constant_values=-1), 2 * reach + 1, 1
    cut = (lambda x, i, j: x[i:j]) if axis == 0 else (lambda x, i, j: x[:, i:j])
    while have < width:
        step = min(have, width - have)
        n = a.shape[axis]
        a = np.maximum(cut(a, 0, n - step), cut(a, step, n))
        have += step
    return a


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Frame and bin of each spectral peak, by frame and bin, and the number of frames.

    Frames are computed in blocks with the neighbouring frames that a peak needs, so long media need no more memory.
    """
    x = samples.astype(np.float32) - 128
    # Silence up to a whole hop, so that each sample is in a frame.
    x = np.pad(x, (0, WINDOW - len(x) if len(x) < WINDOW else -(len(x) - WINDOW) % HOP))
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    n, ts, fs = len(frames), [], []
    for at in range(0, n, BLOCK):
        lo, hi = max(0, at - NEAR_FRAMES), min(n, at + BLOCK + NEAR_FRAMES)
        z = np.fft.rfft(frames[lo:hi] * HANN, axis=1)
        power = np.round(np.log1p(z.real**2 + z.imag**2), 3).astype(np.float32)
        top = _running_max(_running_max(power, NEAR_FRAMES, 0), NEAR_BINS, 1)
        own = slice(at - lo, min(n, at + BLOCK) - lo)
        t, f = np.nonzero((power[own] == top[own]) & (power[own] > 6))
        ts.append(t + at)
        fs.append(f)
    return np.concatenate(ts), np.concatenate(fs), n


def landmarks(t: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Peak pairs as time-coded integers: frame of the first peak, then both bins (8 bits each) and the distance (6 bits)."""
    codes, later = [], np.searchsorted(t, t, side="right")
    for k in range(FANOUT):
        i = np.flatnonzero(later + k < len(t))
        j = later[i] + k
        dt = t[j] - t[i]
        ok = dt <= FAR_FRAMES
        i, j, dt = i[ok], j[ok], dt[ok]
        codes.append((t[i].astype(np.int64) << 22) | (f[i].astype(np.int64) << 14) | (f[j].astype(np.int64) << 6) | dt.astype(np.int64))
    return np.sort(np.concatenate(codes))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_frames", pa.int64()), ("n_peaks", pa.int64()), ("n_landmarks", pa.int64()), ("media", pa.binary()), ("landmarks", pa.list_(pa.int64()))])


def one(text: str | None, outputs: bool) -> tuple:
    stored, n = payload(text)
    media = to_wav(stored)
    back = from_wav(media)
    t, f, frames = peaks(np.frombuffer(back, np.uint8))
    codes = landmarks(t, f)
    feature = f"{frames}:{len(t)}:{len(codes)}:{hashlib.sha256(codes.astype('<i8').tobytes()).hexdigest()}"
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, frames, len(t), len(codes), media if outputs else None, codes if outputs else None


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", outputs: bool = True) -> DataFrame:
    """One row for each document: its WAV file, digests of what is read back from it, and its fingerprint.

    landmarks is the sorted array of time-coded peak pairs. Equal texts give equal values. A null text counts as empty
    (64 zero bytes). Repeated rows give repeated rows, an empty table none; a null id stays null. Other columns of docs
    are left out. outputs=False leaves media and landmarks null, where only the digests are wanted. One map over the
    rows: no shuffle, and one document in memory at a time.
    """
    schema = SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows, held = b.column(0).to_pylist(), [], 0
            for i, text in enumerate(b.column(1)):
                rows.append((ids[i], *one(text.as_py(), outputs)))
                held += rows[-1][5] if outputs else 0
                if held > 16_000_000:
                    yield _batch(rows, schema)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, schema)

    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_peaks long, n_landmarks long, media binary, landmarks array<bigint>"
    return columns(docs, id_col, text_col).selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, ddl)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
