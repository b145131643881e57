"""Joins whose one side repeats a few keys very often."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALT = "_salt"
ROWS_PER_SALT = 2_000_000
BROADCAST_ROWS = 100_000


def within_rows(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True if `df` has at most `limit` rows; reads no more than `limit` + 1 of them."""
    return df.limit(limit + 1).count() <= limit


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the row count allows it; otherwise leave the join to the optimiser."""
    return F.broadcast(df) if within_rows(df, limit) else df


def salted_join(
    many: DataFrame,
    few: DataFrame,
    on: list[str],
    spread: list[str],
    how: str = "inner",
    rows_per_salt: int = ROWS_PER_SALT,
    count_from: DataFrame | None = None,
) -> DataFrame:
    """Equi-join where a key of `many` may hold a large share of its rows.

    Keys with more than `rows_per_salt` rows are found by a partial aggregate over the key
    columns (of `count_from` if given, a cheaper table with the same hot keys). Their rows
    are spread over ceil(count / rows_per_salt) salts by the hash of `spread`, and only
    their partners in `few` are repeated once per salt. The list of hot keys is broadcast:
    it holds at most rows / rows_per_salt rows, so its size is bounded by construction.
    The result is the plain equi-join. `how` is `inner` or `left`.
    """
    counted = many if count_from is None else count_from
    keys = [k for k in on if k in counted.columns]
    hot = F.broadcast(
        counted.groupBy(*keys)
        .agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_per_salt)).cast("int").alias("_salts"))
        .filter(F.col("_salts") > 1)
        .select(*[F.col(k).alias(f"_hot_{k}") for k in keys], "_salts")
    )

    def with_salts(side: DataFrame) -> DataFrame:
        condition = F.lit(True)
        for key in keys:
            condition = condition & (F.col(key) == F.col(f"_hot_{key}"))
        return side.join(hot, condition, "left").drop(*[f"_hot_{k}" for k in keys])

    salted_many = with_salts(many).withColumn(
        SALT, F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_salts")), F.lit(0)).cast("int")
    )
    salted_few = with_salts(few).withColumn(
        SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    )
    return salted_many.drop("_salts").join(salted_few.drop("_salts"), [*on, SALT], how).drop(SALT)
