"""Writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    df.write.format(fmt).mode(mode).save(path)


def union_columns(frames: list[DataFrame]) -> DataFrame:
    """Rows of frames with different columns under all columns, sorted by name."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return merged.select(*sorted(merged.columns))


def write_csv_union(frames: list[DataFrame], path: str) -> None:
    union_columns(frames).write.option("header", "true").csv(path)


def flatten_keys(df: DataFrame, key: str, value: str) -> DataFrame:
    """Nested key struct to flat columns: `outer_inner` for nested fields, the value as `res`."""
    columns = []
    for field in df.schema[key].dataType.fields:
        column = F.col(f"{key}.{field.name}")
        if hasattr(field.dataType, "fields"):
            columns += [column[inner.name].alias(f"{field.name}_{inner.name}") for inner in field.dataType.fields]
        else:
            columns.append(column.alias(field.name))
    flat = df.select(*columns, F.col(value).alias("res"))
    return flat.select(*sorted(flat.columns))


def write_report(df: DataFrame, header: list[str], path: str) -> None:
    """Report rows under the given header."""
    df.toDF(*header).write.option("header", "true").csv(path)


def write_layout(files: DataFrame, path: str, folders: tuple[str, ...] = ("sensor", "scene", "role")) -> None:
    """Captures under sensor / scene / role folders; an existing layout is never overwritten.

    The rebalance gathers a folder's rows into few files and splits a hot folder over tasks.
    With very many scenes, leave `scene` out of `folders`: it stays a column, sorted within
    each file, and its filters prune row groups instead of folders.
    """
    spread = files.hint("rebalance", *[F.col(k) for k in folders])
    inner = [c for c in ("sensor", "scene", "role") if c not in folders]
    if inner:
        spread = spread.sortWithinPartitions(*folders, *inner)
    spread.write.partitionBy(*folders).mode("errorifexists").parquet(path)
