"""Helpers shared by the text operators.

Words are maximal runs of characters outside space and U+0009 to U+000D. `bytes.split()`
cuts at exactly these characters, so UTF-8 bytes are split without decoding them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: texts are some kilobytes, a few are very long.
BATCH_ROWS = 1000

MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, with Arrow batches bounded by rows for the text kernels."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def rows_of(batches: Iterator[pa.RecordBatch], kernel: Callable, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Apply `kernel(batch) -> list of columns` to each batch."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c for c, f in zip(kernel(batch), schema)],
            schema=schema,
        )


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """64-bit hashes of words, each computed once; emptied when it holds `bound` words."""

    def __init__(self, bound: int = 1_000_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every `n` consecutive word hashes; empty if there are fewer words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    value = np.zeros(count, np.uint64)
    for k in range(n):
        value = value * GOLDEN + hashes[k : k + count]
    return mix(value)
