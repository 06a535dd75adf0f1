"""Sound as rows: samples to WAV files."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column

from lectern.operators.batches import by_row


def wav(samples: np.ndarray, rate: int) -> bytes | None:
    """Mono 16-bit PCM with a 44-byte header; None for empty, non-finite or silent samples."""
    x = np.asarray(samples, np.float64)
    if not x.size or not np.isfinite(x).all() or not (np.abs(x) > 0.0001).any():
        return None
    clipped = np.clip(x, -1, 1)
    pcm = np.trunc(np.where(x < 0, clipped * 32768, clipped * 32767)).astype("<i2").tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(pcm), b"WAVE", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16, b"data", len(pcm)) + pcm


def encode(samples: Column, rate: int = 22050) -> Column:
    """A column of arrays of samples as WAV files."""

    def one(x: list | None) -> bytes | None:
        return None if x is None else wav(np.array(x, float), rate)

    return by_row(one, "binary", pa.binary())(samples)
