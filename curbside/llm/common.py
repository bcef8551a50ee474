"""Helpers shared by the operators: row keys, task counts, packed integers."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbside.sources import materialise, scratch_path

__all__ = ["documents", "materialise", "pack", "parts", "row_key", "scratch_path", "unpack"]


def row_key(key: str = "doc_id", text: str = "text") -> Column:
    """The same for rows that repeat id and text, and only for them."""
    return F.xxhash64(F.col(key), F.col(text))


def documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns the operators read, under fixed names and types: whatever else
    the table has stays outside, so its names can't clash."""
    return docs.select(
        F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")
    )


def parts(df: DataFrame, unit: int = 8 << 20) -> int:
    """Number of groups to deal work into: one for `unit` bytes of the tables that `df`
    reads (as far as the optimizer knows their sizes; no job is run), the session's
    shuffle partitions at least."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 60)  # in-memory rows have no known size
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(size // unit, 1 << 20))


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes: high bytes that hardly vary cost nothing."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    planes = planes.reshape(dtype.itemsize, -1).T
    return np.ascontiguousarray(planes).view(dtype).reshape(-1)
