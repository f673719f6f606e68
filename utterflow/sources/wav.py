"""RIFF audio files: headers, and files of a table."""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..schemas import SAMPLE_RATE
from .storage import placed


def wav_header(file: BinaryIO, length: int) -> tuple[int, int, int]:
    """(frames, sample rate, channels) of a file of ``length`` bytes, from its chunk headers alone.

    Chunks besides the format and the data are passed over, wherever they stand. A data chunk
    whose size was never filled in, as recorders that stream leave it, goes on to the file's end.
    """
    riff = file.read(12)
    if riff[:4] != b"RIFF" or riff[8:12] != b"WAVE":
        raise ValueError("no RIFF audio")
    at, block, rate, channels = 12, 0, 0, 0
    while at + 8 <= length:
        file.seek(at)
        head = file.read(8)
        name, size = head[:4], int.from_bytes(head[4:], "little")
        if name == b"fmt ":
            body = file.read(16)
            channels, rate, block = int.from_bytes(body[2:4], "little"), int.from_bytes(body[4:8], "little"), int.from_bytes(body[12:14], "little")
        elif name == b"data":
            if not block:
                raise ValueError("data before the format")
            size = min(size, length - at - 8) if 0 < size < 0xFFFFFFFF else length - at - 8
            return size // block, rate, channels
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def chunk(name: bytes, body: bytes) -> bytes:
    return name + len(body).to_bytes(4, "little") + body + bytes(len(body) % 2)


def wav_file(samples: np.ndarray, rate: int = SAMPLE_RATE, before: bytes = b"", behind: bytes = b"") -> bytes:
    """PCM16 mono with other chunks before and behind the data."""
    body = np.clip(np.rint(np.asarray(samples, np.float64) * 32767), -32768, 32767).astype("<i2").tobytes()
    form = b"".join(x.to_bytes(n, "little") for x, n in ((1, 2), (1, 2), (rate, 4), (2 * rate, 4), (2, 2), (16, 2)))
    inner = b"WAVE" + chunk(b"fmt ", form) + before + chunk(b"data", body) + behind
    return b"RIFF" + len(inner).to_bytes(4, "little") + inner


def write_wavs(df: DataFrame, path: str) -> None:
    """A file below ``path`` for each (file, samples, chunks): with no other chunks, one before the data, or one before and one behind."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info, note = chunk(b"LIST", b"INFOISFTtool"), chunk(b"note", b"odd")
        for batch in batches:
            names, samples, chunks = (c.to_pylist() for c in batch.columns)
            for name, x, n in zip(names, samples, chunks):
                placed(f"{path.rstrip('/')}/{name}", wav_file(x, before=info if n else b"", behind=note if n > 1 else b""))
            yield pa.RecordBatch.from_arrays([pa.array([len(names)], pa.int64())], ["n"])

    df.mapInArrow(run, "n long").agg({"n": "sum"}).collect()
