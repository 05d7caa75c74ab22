"""Media columns: 8-bit WAV payloads, short-time Fourier transforms, spectral-peak pairs.

A text becomes a sound: its UTF-8 bytes are the samples of a mono 8-bit WAV, written and read
by the ``wave`` module. From the samples that were read back, Hann-windowed frames are
transformed, the strongest local maxima of each frame are kept as peaks, and each peak is
paired with peaks of the next frames. A pair is coded as frequency, frequency, distance and
stored with its frame number as one time-coded integer, ``frame << 26 | code``.

Defined cases: a null or empty text is one padding unit of 576 bytes of 255; repeated rows give
repeated results; ids may be null; an empty table gives an empty result;
other columns of the input are not read. Work is per row, so a
long text costs memory in proportion to its own length only: frames are transformed in blocks.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encode, small_batches

UNIT = 576
FRAME, HOP = 288, 144
PEAKS, SPAN = 3, 2
RATE = 8000
BLOCK = 512
_WINDOW = np.hanning(FRAME).astype(np.float64)

SCHEMA = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
    "media_bytes bigint, media_sha256 string, feature string, n_frames int, fingerprints array<bigint>"
)


def pad(raw: bytes) -> bytes:
    """Append 255s up to a positive multiple of 576."""
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def stft(samples: bytes) -> Iterator[np.ndarray]:
    """Magnitudes of the half spectra, in blocks of at most ``BLOCK`` frames."""
    x = np.frombuffer(samples, np.uint8)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    for at in range(0, len(frames), BLOCK):
        part = (frames[at : at + BLOCK].astype(np.float64) - 128.0) * _WINDOW
        yield np.abs(np.fft.rfft(part, axis=1))


def peaks(magnitude: np.ndarray) -> np.ndarray:
    """The bins of the strongest local maxima of each frame, strongest first, -1 where there are fewer.

    Magnitudes are rounded to 1/1024 first; ties go to the lower bin.
    """
    m = np.rint(magnitude * 1024.0)
    inner = m[:, 1:-1]
    top = np.where((inner > m[:, :-2]) & (inner >= m[:, 2:]), inner, -1.0)
    best = np.argsort(-top, axis=1, kind="stable")[:, :PEAKS]
    return np.where(np.take_along_axis(top, best, 1) > 0, best + 1, -1)


def fingerprints(samples: bytes) -> tuple[int, np.ndarray]:
    """Number of frames, and the sorted time-coded pairs."""
    p = np.concatenate([peaks(m) for m in stft(samples)]).astype(np.int64)
    found = []
    for d in range(1, SPAN + 1):
        if len(p) > d:
            a, b = p[:-d, :, None], p[d:, None, :]
            code = (np.arange(len(p) - d)[:, None, None] << 26) | (a << 16) | (b << 6) | d
            found.append(code[np.broadcast_to((a >= 0) & (b >= 0), code.shape)])
    return len(p), np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def describe(doc_id, raw: bytes) -> tuple:
    payload = pad(raw)
    stored = to_wav(payload)
    back = from_wav(stored)
    n, marks = fingerprints(back)
    feature = hashlib.sha256(marks.astype("<i8").tobytes()).hexdigest()
    return (doc_id, len(raw), len(payload), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, n, marks)


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``; no shuffle."""
    small_batches(docs.sparkSession)
    names = [part.split()[0] for part in SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [describe(None if pd.isna(i) else int(i), raw) for i, raw in zip(batch["doc_id"], encode(batch["text"]), strict=True)]
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInPandas(run, SCHEMA)


def match_offsets(left: np.ndarray, right: np.ndarray) -> dict[int, int]:
    """How many pair codes two fingerprint arrays share at each difference of their frames."""
    at: dict[int, list[int]] = {}
    low = (1 << 26) - 1
    for v in left:
        at.setdefault(int(v) & low, []).append(int(v) >> 26)
    votes: dict[int, int] = {}
    for v in right:
        for t in at.get(int(v) & low, ()):
            d = (int(v) >> 26) - t
            votes[d] = votes.get(d, 0) + 1
    return votes
