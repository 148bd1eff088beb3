"""Media columns: WAV samples, short-time Fourier transforms and spectral-peak pairs.

A text's UTF-8 bytes, filled up by bytes 255 to a positive multiple of 576, are the samples
of a mono 8-bit WAV. Features come from the samples read back by the wave module: in each
frame the strongest bin of each of three bands, if above the frame's mean, is a peak; each
peak is paired with the next frames' peaks. A pair is one integer (bin, bin, frames between)
with the time of its first peak. Of equally strong bins the lowest is the peak. A null text is an
empty one: 576 samples of 255. Rows are taken one by one, so repeated rows and ids give repeated
results.
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
from pyspark.sql import types as T

from ._common import text_chunks

UNIT = 576
RATE = 8000
FRAME = 2 * UNIT
#: Bins of the three bands; frames after a peak's that are paired with it.
BANDS = (1, 48, 160, FRAME // 2 + 1)
AHEAD = 2
BLOCK = 512
_WINDOW = np.hanning(FRAME).astype(np.float32)


def pack(payload: bytes) -> bytes:
    """The samples as a WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def unpack(media: bytes) -> bytes:
    """The samples of a WAV file, by the wave module."""
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """Strongest bin of each band in each frame, 0 where it isn't above the frame's mean."""
    signal = np.frombuffer(samples, np.uint8)
    if len(signal) < FRAME:
        signal = np.concatenate([signal, np.full(FRAME - len(signal), 128, np.uint8)])
    frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::UNIT]
    out = np.zeros((len(frames), len(BANDS) - 1), np.uint16)
    for start in range(0, len(frames), BLOCK):
        power = np.abs(np.fft.rfft((frames[start : start + BLOCK].astype(np.float32) - 128) * _WINDOW, axis=1)).astype(np.float32)
        mean = power[:, 1:].mean(axis=1)
        for b, (low, high) in enumerate(zip(BANDS, BANDS[1:])):
            best = power[:, low:high].argmax(axis=1)
            loud = power[np.arange(len(power)), low + best] > mean
            out[start : start + BLOCK, b] = np.where(loud, low + best, 0)
    return out


def pairs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(times, hashes) of all peak pairs, ordered by time, then hash."""
    times, hashes = [], []
    for gap in range(1, AHEAD + 1):
        if len(found) <= gap:
            break
        a, b = found[:-gap].astype(np.int64), found[gap:].astype(np.int64)
        code = (a[:, :, None] << 14) | (b[:, None, :] << 4) | gap
        kept = (a[:, :, None] > 0) & (b[:, None, :] > 0)
        when = np.broadcast_to(np.arange(len(a))[:, None, None], code.shape)
        times.append(when[kept])
        hashes.append(code[kept])
    if not times:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    t, h = np.concatenate(times), np.concatenate(hashes)
    order = np.lexsort((h, t))
    return t[order].astype(np.int32), h[order].astype(np.int32)


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text as a WAV file; n_bytes without the fill."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            sizes: list[int] = []

            def stored() -> Iterator[bytes]:
                for x in batch[1]:
                    raw = (x.as_py() or "").encode()
                    sizes.append(len(raw))
                    yield pack(raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)))

            media = pa.array(stored(), pa.binary(), size=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(sizes, pa.int64()), media], names=["id", "n_bytes", "media"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_bytes long, media binary").withColumnRenamed("id", id_col)


def features(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The columns of `df` and payload_bytes, payload_sha256, tail_crc32, times, hashes: all from the stored bytes.

    Columns of `df` with these names are replaced. times and hashes are the fingerprint: the k-th pair starts in frame times[k].
    """
    ints = T.ArrayType(T.IntegerType())
    added = (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("times", ints), ("hashes", ints))
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in {name for name, _ in added}])
    schema = T.StructType([*df.schema.fields, *(T.StructField(name, kind) for name, kind in added)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, media_col):
            rows = []
            for x in batch.column(batch.schema.get_field_index(media_col)):
                payload = unpack(x.as_py())
                t, h = pairs(peaks(payload))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), t, h))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)

    return df.mapInArrow(run, schema)
