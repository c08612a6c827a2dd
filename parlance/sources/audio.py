"""WAV headers."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def wav_duration(head: bytes) -> Decimal | None:
    """Frames by rate from the first bytes of a RIFF file; None if they are none."""
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    at, rate, frame = 12, 0, 0
    while at + 8 <= len(head):
        name, size = head[at : at + 4], struct.unpack("<I", head[at + 4 : at + 8])[0]
        if name == b"fmt ":
            _, channels, rate, _, frame, _ = struct.unpack("<HHIIHH", head[at + 8 : at + 24])
        if name == b"data":
            return (Decimal(size // frame) / Decimal(rate)).quantize(Decimal("1e-18")) if frame and rate else None
        at += 8 + size + size % 2
    return None


#: so many first bytes of a file can hold its format and the size of its data
HEAD = 65_536


def wav_durations(files: DataFrame) -> DataFrame:
    """(path, duration decimal) of ``files`` (path, content); null for what is no WAV. Only the head goes to Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "duration": [wav_duration(c) if c is not None else None for c in b["head"]]})

    return files.select("path", F.substring("content", 1, HEAD).alias("head")).mapInPandas(run, "path string, duration decimal(38,18)")


def read_wav_durations(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """(path, duration decimal) of the WAV files below ``paths``. Spark reads one file at a time into memory."""
    return wav_durations(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{wav,WAV}").load(paths if isinstance(paths, str) else list(paths)))
