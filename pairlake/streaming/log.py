"""Arrival-order operators as Structured Streaming jobs, each equal to its batch twin.

All of them append, so the file sink gives exactly-once tables on any shared folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pairlake.session import checkpoint_folder

#: Salts of a (model, metric): its entries arrive reduced, so one state holds any model.
SALTS = 1
#: Entries of a task that are reduced together.
REDUCED_ROWS = 200_000
#: A null step stays an integer column's null.
_KEPT = {pa.int64(): pd.Int64Dtype()}


def run_available(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Process all available input, append the output to a table and return the table.

    A given `folder` is continued where it stopped; otherwise a fresh one is taken in the
    checkpoint folder.
    """
    spark = stream.sparkSession
    folder = folder or f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/table")
        .option("checkpointLocation", f"{folder}/progress")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


# -- best steps --------------------------------------------------------------------


def _order(value: float, step: int) -> tuple:
    """A NaN comes after all numbers, as in the batch twin."""
    return (True, 0.0, step) if value != value else (False, value, step)


def _least(rows: pd.DataFrame) -> pd.DataFrame:
    """The row of least (value, step) per (model, metric, salt)."""
    return rows.sort_values(["value", "step"], kind="stable").drop_duplicates(["model", "metric", "salt"])


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least entry per (model, metric, salt) among the entries of a task that are held together."""
    held: list[pd.DataFrame] = []
    rows, schema = 0, None
    for batch in batches:
        schema = batch.schema
        least = _least(batch.to_pandas(types_mapper=_KEPT.get))
        held.append(least)
        rows += len(least)
        if rows > REDUCED_ROWS:
            held = [_least(pd.concat(held))]
            rows = len(held[0])
            if rows > REDUCED_ROWS // 2:
                yield pa.RecordBatch.from_pandas(held[0], schema, preserve_index=False)
                held, rows = [], 0
    if held:
        yield pa.RecordBatch.from_pandas(_least(pd.concat(held)), schema, preserve_index=False)


def stream_improvements(results: DataFrame, salts: int = SALTS) -> DataFrame:
    """Entries that improve the best value of their (model, metric, salt) so far.

    Tasks send on the least entry that they hold of a group, so a model with many entries brings a
    few rows per task to its state, and a state is called for each group, not for each entry. More
    `salts` spread a model by step over more states, each of them a group of its own. The best
    entry of a group is among the improvements of one of its salts, so `settled_best` is exact.
    """

    def update(
        key: tuple, batches: Iterable[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        # Batch by batch: a group of a micro-batch may be long.
        entries = (e for rows in batches for e in zip(rows["value"].tolist(), rows["step"].tolist()))
        value, step = min(entries, key=lambda e: _order(*e))
        if not state.exists or _order(value, step) < _order(*state.get):
            state.update((value, step))
            yield pd.DataFrame({"model": [key[0]], "metric": [key[1]], "step": [step], "value": [value]})

    salted = results.filter(F.col("value").isNotNull()).select(
        "model", "metric", F.col("step").cast("bigint").alias("step"), F.col("value").cast("double").alias("value"),
        F.pmod(F.xxhash64("step"), F.lit(salts)).alias("salt"),
    )
    least = salted.mapInArrow(_reduced, "model string, metric string, step bigint, value double, salt bigint")
    return least.groupBy("model", "metric", "salt").applyInPandasWithState(
        update,
        "model string, metric string, step bigint, value double",
        "value double, step bigint",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def settled_best(improvements: DataFrame) -> DataFrame:
    """Best step and value per (model, metric) from the improvements table."""
    return (
        improvements.groupBy("model", "metric")
        .agg(F.min(F.struct("value", "step")).alias("b"))
        .select("model", "metric", F.col("b.step").alias("best_step"), F.col("b.value").alias("best_value"))
    )


# -- captures ----------------------------------------------------------------------


def stream_captures(files: DataFrame) -> DataFrame:
    """Each content once as files arrive, whatever their `mtime`s.

    The state keeps every content seen, spread over tasks by `sha1`: late files and copies of
    any age are judged as in the batch twin. A watermark would forget contents and drop late
    files. A folder that an earlier version began has another state and cannot be continued.
    """
    return files.withColumn("mtime", F.col("mtime").cast("timestamp")).dropDuplicates(["sha1"])


# -- plateaus ----------------------------------------------------------------------


def stream_plateau(results: DataFrame, patience: int, multiplier: float, square: bool = True) -> DataFrame:
    """Rate cuts as results arrive; input must arrive in step order per model.

    State per model: best per metric, deadline, number of cuts. A micro-batch bounds the
    rows a model brings at once.
    """
    factor = multiplier * multiplier if square else multiplier

    def update(
        key: tuple, batches: Iterable[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        bests, deadline, cuts = state.get if state.exists else ("{}", patience, 0)
        bests = json.loads(bests)
        out = []
        rows = pd.concat(list(batches)).sort_values("step", kind="stable")
        for step, entries in rows.groupby("step", sort=True):
            improved = False
            for metric, value in zip(entries["metric"], entries["value"]):
                if value <= bests.get(metric, float("inf")):
                    bests[metric] = value
                    improved = True
            if improved:
                deadline = int(step) + patience
            elif step > deadline:
                cuts += 1
                deadline = int(step) + patience
                out.append((key[0], int(step), cuts, factor**cuts))
        state.update((json.dumps(bests), deadline, cuts))
        yield pd.DataFrame(out, columns=["model", "step", "cuts", "factor"])

    return (
        results.filter(F.col("value").isNotNull())
        .select("model", "step", "metric", "value")
        .groupBy("model")
        .applyInPandasWithState(
            update,
            "model string, step bigint, cuts bigint, factor double",
            "bests string, deadline bigint, cuts bigint",
            "append",
            GroupStateTimeout.NoTimeout,
        )
    )
