"""Media columns: payloads stored as WAV, short-time Fourier transforms, and fingerprints of spectral-peak pairs.

A text's UTF-8 bytes, padded with bytes 255 to a positive multiple of 576, become a mono WAV of 8-bit samples, written and
read by the wave module. Half a frame of silence is set before and after the samples, for the transform only, so every sample
stands in two frames and the shortest text has three. Frames of 576 samples, 288 apart, are windowed (Hann) and transformed; in
each frame the strongest bin of each of four bands is a peak. Every peak is paired with the peaks of the same and the next higher band (the fourth
with the first) in the three frames that follow; a pair is a code of its two bins and its distance, stored with the frame it
starts in, as arrays ``times`` and ``codes``. The WAV itself is the column ``media``. The feature string
counts the pairs, sums the samples (two even tones have the same peaks) and digests both arrays.

Null counts as empty text (one block of bytes 255). Equal texts give equal values; different texts may share a fingerprint where
they differ in so few bytes that every peak stays in its bin. A frame's strongest bin is the lower one
of equals, and a bin that holds no more than rounding errors of the frame (1e-22 of its power) is silent. An empty table gives no rows; further columns are ignored. Texts are read whole, in
strips of ``STRIP`` frames, and rows are returned in batches of about ``OUTPUT`` bytes.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, HOP, RATE, STRIP, AHEAD, OUTPUT, FLOOR = 576, 288, 8000, 1024, 3, 8 << 20, 1e-22
#: Bytes of a WAV before its samples.
HEADER = 44
#: First bins of the bands, and the end of the last.
BANDS = (1, 12, 36, 100, 289)
WINDOW = np.hanning(BLOCK + 1)[:-1]

OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, media_bytes long, media_sha256 string, feature string, times array<int>, codes array<int>"


def store(payload: bytes) -> bytes:
    """The payload as a mono WAV of 8-bit samples."""
    held = io.BytesIO()
    with wave.open(held, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return held.getvalue()


def read(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def padded(data: bytes) -> bytes:
    return data + b"\xff" * ((-len(data)) % BLOCK if data else BLOCK)


def peaks(samples: np.ndarray) -> np.ndarray:
    """The strongest bin of each band in each frame, the first and the last half of silence: frames x bands."""
    halves = np.pad(((samples.astype(np.float64) - 128.0) / 128.0).reshape(-1, HOP), ((1, 1), (0, 0)))
    out = np.empty((len(halves) - 1, len(BANDS) - 1), np.int32)
    for i in range(0, len(out), STRIP):
        part = halves[i : i + STRIP + 1]
        spectrum = np.fft.rfft(np.concatenate([part[:-1], part[1:]], axis=1) * WINDOW, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        power[power < FLOOR * power.sum(axis=1, keepdims=True)] = 0
        for b, (low, high) in enumerate(zip(BANDS, BANDS[1:], strict=False)):
            out[i : i + STRIP, b] = low + power[:, low:high].argmax(axis=1)
    return out


def pairs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of all peak pairs, ordered by distance, band and time."""
    times, codes = [], []
    for ahead in range(1, min(AHEAD, len(found) - 1) + 1):
        at = np.arange(len(found) - ahead, dtype=np.int32)
        for b in range(found.shape[1]):
            for other in (b, (b + 1) % found.shape[1]):
                times.append(at)
                codes.append((found[:-ahead, b] << 12) | (found[ahead:, other] << 2) | ahead)
    return (np.concatenate(times), np.concatenate(codes)) if times else (np.empty(0, np.int32), np.empty(0, np.int32))


def media_columns(docs: DataFrame) -> DataFrame:
    """``OUT`` for every row of ``docs`` (doc_id, text)."""
    ints = pa.list_(pa.int32())
    types = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("times", ints), ("codes", ints)]

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(ids: list, rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(r, t) for r, (_, t) in zip(rows, types, strict=True)]], ["doc_id", *[n for n, _ in types]])

        for batch in batches:
            ids: list = []
            rows: list[list] = [[] for _ in types]
            size = 0
            for doc_id, item in zip(batch.column("doc_id").to_pylist(), batch.column("data"), strict=True):
                if size >= OUTPUT:  # media and arrays are many times the text
                    yield made(ids, rows)
                    ids, rows, size = [], [[] for _ in types], 0
                data = item.as_py()
                ids.append(doc_id)
                media = store(padded(data))
                payload = read(media)
                samples = np.frombuffer(payload, np.uint8)
                times, codes = pairs(peaks(samples))
                level = int(samples.sum(dtype=np.int64))
                values = (
                    len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), media, len(media), hashlib.sha256(media).hexdigest(),
                    f"{len(codes)}:{level}:{hashlib.sha256(times.tobytes() + codes.tobytes()).hexdigest()[:32]}", times, codes,
                )
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
                size += len(media) + 8 * len(codes)
            yield made(ids, rows)

    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("data")).mapInArrow(fingerprint, OUT)
