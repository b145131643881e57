"""Files: listings, stored arrays, validity."""

from __future__ import annotations

import io
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlake.functions import naming as N
from pairlake.operators.batches import map_rows

# Extensions of ordinary images, first bytes of some of them.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "gif", "tiff", "ppm", "j2k", "webp")
SIGNATURES = {"png": ("89504E47",), "jpg": ("FFD8FF",), "jpeg": ("FFD8FF",), "tiff": ("49492A00", "4D4D002A")}
# Outcomes of a conversion.
OUTCOMES = ("OK", "BAD_EXPOSURE", "UNREADABLE_ERROR", "UNKNOWN_ERROR")


def scan_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """Recursive listing (root, folder, name, size, mtime); file contents are not read.

    Spark lists no empty files; an empty file is not a capture.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    path = F.regexp_replace("path", "^file:", "")
    base = root.rstrip("/")
    inside = F.substring(path, F.lit(len(base) + 2), F.length(path))
    return reader.load(root).select(
        F.lit(base).alias("root"),
        N.path_parent(inside).alias("folder"),
        N.path_leaf(inside).alias("name"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
    )


def decode_npy(files: DataFrame) -> DataFrame:
    """Stored crop arrays (path, content) as (path, c, h, w, data); 2-d arrays get one channel."""

    def run(r: SimpleNamespace) -> Iterator[tuple]:
        array = np.load(io.BytesIO(r.content), allow_pickle=False)
        c, h, w = array.shape if array.ndim == 3 else (1, *array.shape)
        yield r.path, c, h, w, array.astype(np.float64).ravel()

    return map_rows(files.select("path", "content"), run, "path string, c int, h int, w int, data array<double>")


def encode_npy(tiles: DataFrame, dtype: str = "float16") -> DataFrame:
    """Tiles (path, c, h, w, data) as array files (path, content)."""

    def run(r: SimpleNamespace) -> Iterator[tuple]:
        buffer = io.BytesIO()
        np.save(buffer, np.asarray(r.data, dtype=dtype).reshape(r.c, r.h, r.w))
        yield r.path, buffer.getvalue()

    return map_rows(tiles.select("path", "c", "h", "w", "data"), run, "path string, content binary")


def read_npy_tiles(spark: SparkSession, path: str) -> DataFrame:
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.npy")
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return decode_npy(files)


def validate_files(files: DataFrame, open_images: bool = False) -> DataFrame:
    """(path, valid) of scanned files (path, content).

    Ordinary images are judged by extension, and by their first bytes with `open_images`.
    Arrays must load. Raw captures must not be empty; X-Trans captures pass unread.
    """
    path, content = F.col("path"), F.col("content")
    ext = N.extension(path)
    known = ext.isin(*IMAGE_EXTENSIONS)
    if open_images:
        for name, starts in SIGNATURES.items():
            head = F.hex(F.substring(content, 1, 4))
            fits = F.lit(False)
            for start in starts:
                fits = fits | head.startswith(start)
            known = F.when(ext == name, fits).otherwise(known)
    raw = N.is_raw(path) | (ext == "exr")
    judged = files.filter(ext != "npy").select(
        "path",
        F.when(ext == "raf", True).when(raw, F.octet_length(content) > 0).otherwise(known).alias("valid"),
    )

    def loads(r: SimpleNamespace) -> Iterator[tuple]:
        try:
            np.load(io.BytesIO(r.content), allow_pickle=False)
            yield r.path, True
        except (ValueError, EOFError, OSError):
            yield r.path, False

    arrays = map_rows(files.filter(ext == "npy").select("path", "content"), loads, "path string, valid boolean")
    return judged.unionByName(arrays)


def conversion_report(results: DataFrame) -> DataFrame:
    """Files per conversion outcome; an unknown outcome fails."""
    outcome = F.col("outcome")
    checked = F.when(outcome.isin(*OUTCOMES), outcome).otherwise(
        F.raise_error(F.concat(F.lit("unknown outcome "), F.coalesce(outcome, F.lit("null"))))
    )
    return results.groupBy(checked.alias("outcome")).agg(F.count(F.lit(1)).alias("files"))


def failed_conversions(results: DataFrame) -> DataFrame:
    return results.filter(F.col("outcome") != "OK")
