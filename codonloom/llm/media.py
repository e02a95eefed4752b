"""Media columns: payloads stored as 8-bit WAV, read back, and fingerprinted.

The short-time Fourier transform of the samples gives spectral peaks; pairs of
peaks (two frequencies and the frames between them) at their anchor's frame are
the fingerprint, stored as two arrays: times and codes.

Defined results: null and empty texts have a payload of 192 spaces, whose
spectrum has no peak; texts are stored whole; repeated rows and equal texts give
equal values; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, tidy

UNIT, RATE, FRAME, HOP, PEAKS, FAN, AHEAD = 192, 8000, 256, 192, 3, 3, 8

SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "media binary, times array<int>, codes array<int>"
)
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())]
    + [("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("media", pa.binary()), ("times", pa.list_(pa.int32())), ("codes", pa.list_(pa.int32()))]
)


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def spectrum(samples: np.ndarray, window: np.ndarray, block: int = 4096) -> Iterator[tuple[int, np.ndarray]]:
    """(first frame, magnitudes) for at most `block` frames at a time; the last frame is padded with its mean level."""
    frames = max(1, -(-max(0, len(samples) - FRAME) // HOP) + 1)
    padded = np.full((frames - 1) * HOP + FRAME, 128, np.uint8)
    padded[: len(samples)] = samples[: len(padded)]
    view = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    for at in range(0, frames, block):
        x = view[at : at + block].astype(np.float32)
        x -= x.mean(axis=1, keepdims=True)
        yield at, np.abs(np.fft.rfft(x * window, axis=1))[:, 1:]


def fingerprint(payload: bytes, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times (anchor frames) and codes (frequency << 17 | frequency << 10 | frames between), in order of time.

    A frame's peaks are its PEAKS highest local maxima. In the order of frames and,
    within one, of height, an anchor pairs with those of the FAN * PEAKS peaks after
    it that lie 1 to AHEAD frames later.
    """
    at_all, bin_all = [], []
    for first, mag in spectrum(np.frombuffer(payload, np.uint8), window):
        inner = mag[:, 1:-1]
        top = np.where((inner > mag[:, :-2]) & (inner >= mag[:, 2:]) & (inner > 1e-3), inner, 0)
        best = np.argsort(-top, axis=1, kind="stable")[:, :PEAKS]
        frame, rank = np.nonzero(np.take_along_axis(top, best, 1) > 0)
        at_all.append(frame + first)
        bin_all.append(best[frame, rank] + 2)
    at, bins = np.concatenate(at_all), np.concatenate(bin_all)
    times, codes = [], []
    for step in range(1, FAN * PEAKS + 1):
        gap = at[step:] - at[:-step]
        ok = (gap > 0) & (gap <= AHEAD)
        times.append(at[:-step][ok])
        codes.append((bins[:-step][ok] << 17) | (bins[step:][ok] << 10) | gap[ok])
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def store(docs: DataFrame) -> DataFrame:
    """One row per document with its WAV bytes and fingerprint, made where its text is read: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = np.hanning(FRAME).astype(np.float32)
        for batch in slices(batches, "text", 2 << 20):
            cols: dict[str, list] = {name: [] for name in _ARROW.names}
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                n, raw = payload_of(text)
                media = to_wav(raw)
                back = from_wav(media)
                times, codes = fingerprint(back, window)
                values = (i, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), media, times, codes)
                for name, value in zip(cols, values):
                    cols[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in _ARROW], schema=_ARROW)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), SCHEMA)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store(table(spark, sf_dir, "documents"))
    marks = F.concat_ws(",", F.transform(F.arrays_zip("times", "codes"), lambda p: F.concat_ws(":", p["times"].cast("string"), p["codes"].cast("string"))))
    feature = F.concat(F.size("codes").cast("string"), F.lit(":"), F.md5(marks))
    return stored.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "times", "codes")
