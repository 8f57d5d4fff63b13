"""Media columns: bytes kept as 8-bit WAV, and spectral-peak pair fingerprints of what is read back."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import given_id, held_id, materialize, read_table

UNIT = 192
RATE = 8000
FRAME, HOP = 192, 96
PER_FRAME, FAN_OUT, ZONE = 3, 3, 1 << 16
MOST_FRAMES = 4096
_WINDOW = np.hanning(FRAME).astype(np.float32)


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


def spectral_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the peaks, in order: bins stronger than both neighbours and no weaker than the same bin in the
    frames beside theirs, with half the frame's greatest level at least; of each frame the PER_FRAME strongest. The lowest two bins and the last have none."""
    n = max(0, (len(samples) - FRAME) // HOP + 1)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] if n else np.empty((0, FRAME), np.uint8)
    time, bins = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a in range(0, n, MOST_FRAMES):  # long inputs in blocks with a frame more on both sides, so that memory is bounded
        b = min(a + MOST_FRAMES, n)
        lo, hi = max(a - 1, 0), min(b + 1, n)
        part = (frames[lo:hi].astype(np.float32) - 128) * _WINDOW
        spectrum = np.fft.rfft(part, axis=1)
        s = np.round(np.log1p(spectrum.real**2 + spectrum.imag**2), 3)
        s = np.pad(s, ((lo == a, hi == b), (0, 0)), constant_values=-1)
        own = s[1:-1, 2:-1]
        peak = (own > s[1:-1, 1:-2]) & (own > s[1:-1, 3:]) & (own >= s[:-2, 2:-1]) & (own >= s[2:, 2:-1])
        peak &= 2 * own >= own.max(axis=1, keepdims=True)
        level = np.where(peak, own, -1)
        best = np.argsort(-level, axis=1, kind="stable")[:, :PER_FRAME]
        best.sort(axis=1)
        at, k = np.nonzero(np.take_along_axis(level, best, 1) >= 0)
        time.append(a + at)
        bins.append(best[at, k] + 2)
    return np.concatenate(time), np.concatenate(bins)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Time-coded pairs of a peak and each of the next FAN_OUT within ZONE frames, ascending: time << 32 | bin << 24 |
    next bin << 16 | distance. A single peak gives its time and bin, none an empty array."""
    time, bins = spectral_peaks(samples)
    codes = [np.empty(0, np.int64)]
    for k in range(1, FAN_OUT + 1):
        gap = time[k:] - time[:-k]
        code = time[:-k] << 32 | bins[:-k] << 24 | bins[k:] << 16 | gap
        codes.append(code[gap < ZONE])
    return np.sort(np.concatenate(codes)) if len(time) > 1 else time << 32 | bins << 24


def _stored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        data = [(t or "").encode("utf-8", "surrogatepass") for t in pdf["text"]]
        media = [to_wav(d + b" " * (-len(d) % UNIT if d else UNIT)) for d in data]
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": [len(d) for d in data], "media": media})


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        payload = [from_wav(m) for m in pdf["media"]]
        yield pd.DataFrame(
            {
                "doc_id": pdf["doc_id"],
                "n_bytes": pdf["n_bytes"],
                "payload_bytes": [len(p) for p in payload],
                "payload_sha256": [hashlib.sha256(p).hexdigest() for p in payload],
                "tail_crc32": [zlib.crc32(p[-16:]) for p in payload],
                "media_bytes": [len(m) for m in pdf["media"]],
                "media_sha256": [hashlib.sha256(m).hexdigest() for m in pdf["media"]],
                "fingerprint": [fingerprint(np.frombuffer(p, np.uint8)) for p in payload],
            }
        )


def store_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media), written to the shared folder: each text's bytes, padded with spaces, as a WAV file.

    Null and empty texts become one unit of spaces. Repeated rows give repeated rows; a null id stays null. An empty
    table gives no rows. Other columns are ignored.
    """
    rows = docs.select(held_id(id_col), F.col(text_col).alias("text"))
    return materialize(rows.mapInPandas(_stored, "doc_id long, n_bytes long, media binary").withColumn("doc_id", given_id()), "media")


def audio_features(media: DataFrame) -> DataFrame:
    """What is read back from each stored WAV: payload digests and the time-coded fingerprint array.

    Rows are those of store_audio: a null id stays null, repeated rows give repeated rows, an empty table gives none.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fingerprint array<long>"
    held = media.withColumn("doc_id", held_id("doc_id"))
    return held.mapInPandas(_featured, schema).withColumn("doc_id", given_id())


def op9_wav_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audio_features(store_audio(read_table(spark, sf_dir, "documents")))
    feature = F.concat_ws("-", F.size("fingerprint"), F.md5(F.array_join(F.col("fingerprint").cast("array<string>"), ",")))
    return found.withColumn("feature", feature)
