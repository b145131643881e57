"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Tile rows carry megabytes of samples, so Arrow batches are bounded by rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.parquet.compression.codec": "zstd",
    # Column call sites cost a JVM round trip per expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session that a cluster brought; call it before any query."""
    for key, value in SETTINGS.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pairlake")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _one_machine(master: str) -> bool:
    """`local` and `local[n]`; `local-cluster` runs executors of its own."""
    return master == "local" or master.startswith("local[")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in `spark.checkpoint.dir`.

    Only where none is named (a local test run) is a temporary folder taken.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    folder = named or context.getCheckpointDir()
    if folder is None:
        if not _one_machine(context.master):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="pairlake-checkpoint-")
        context.setCheckpointDir(folder)
    return folder


#: For tables of samples. A reader holds 4,096 rows or a row group, whichever is less, and a writer measures a row group
#: after compression; so its rows are counted.
SAMPLES = {"compression": "zstd", "parquet.block.row.count.limit": 64}


def checkpointed(df: DataFrame, **options) -> DataFrame:
    """Write `df` once to the checkpoint folder, with the writer's `options`, and go on from the written table.

    This cuts the lineage, survives lost executors and computes `df` a single time
    (`DataFrame.checkpoint` computes it twice).
    """
    path = f"{checkpoint_folder(df.sparkSession)}/pairlake-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    """Shuffle partitions of the session; a local run needs no more than its cores."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    context = spark.sparkContext
    return min(width, context.defaultParallelism) if _one_machine(context.master) else width
