"""Shared shape of registered queries and their oracles.

A shape such as "model:s step:i value:d" names the output columns and their kinds:
`i` BIGINT, `d` DOUBLE rounded to 6 digits, `s` VARCHAR, `b` BOOLEAN.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPARK = {"i": "bigint", "d": "double", "s": "string", "b": "boolean"}
_DUCK = {"i": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "b": "BOOLEAN"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _fields(shape: str) -> list[tuple[str, str]]:
    return [tuple(field.rsplit(":", 1)) for field in shape.split()]


def shaped(df: DataFrame, shape: str) -> DataFrame:
    columns = []
    for name, kind in _fields(shape):
        column = F.col(name).cast(_SPARK[kind])
        if kind == "d":
            column = F.round(column, 6) + F.lit(0.0)
        columns.append(column.alias(name))
    return df.select(*columns)


def shaped_sql(sql: str, shape: str) -> str:
    columns = []
    for name, kind in _fields(shape):
        column = f'CAST("{name}" AS {_DUCK[kind]})'
        if kind == "d":
            column = f"round({column}, 6) + 0.0"
        columns.append(f'{column} AS "{name}"')
    return f"SELECT {', '.join(columns)} FROM (\n{sql.strip()}\n) AS q"


def query(name: str, shape: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame under `name`, with its oracle."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return shaped(build(spark, sf_dir), shape)

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = shaped_sql(sql, shape)
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
