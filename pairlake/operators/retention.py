"""Which evaluations are due, which files may go. Nothing here deletes: rows are reported."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlake.operators.results import best_step

# Known tests and input kinds. The last progressive test is named after the
# dataset it runs on (see `known_tests`).
TESTS = (
    "test_manproc",
    "test_manproc_hq",
    "test_manproc_q99",
    "test_manproc_q995",
    "test_manproc_gt",
    "test_manproc_bostitch",
    "test_ext_raw_denoise",
    "test_playraw",
    "test_manproc_playraw",
    "validate_and_test",
    "test_progressive_manproc",
    "test_progressive_manproc_bostitch",
)
INPUTS = ("bayer", "prgb", "proc")


def known_tests(dataset: str) -> tuple[str, ...]:
    """All tests, with the progressive one over the named paired dataset."""
    return (*TESTS, f"test_progressive_{dataset}")


# Parts of test names without a denoising variant.
NOT_FOR_DENOISE = ("manproc_playraw", "manproc_hq", "manproc_q99", "manproc_q995", "manproc_gt")
# Seconds a run is given at each stage.
AGE_CREATED = 60
AGE_LOG = 5 * 60
AGE_RESULTS = 15 * 60
AGE_EMPTY = 60 * 60
KEPT_NAMES = ("backups", "old")


def _any_contained(name: Column, texts: Sequence[str]) -> Column:
    hit = F.lit(False)
    for text in texts:
        hit = hit | name.contains(text)
    return hit


def evaluation_matrix(
    models: DataFrame,
    tests: Sequence[str],
    inputs: Sequence[str] = INPUTS,
    banned: Sequence[str] = (),
    allowed: Sequence[str] = (),
    cpu: bool = False,
) -> DataFrame:
    """The (model, test) evaluations that apply, with their test id and device.

    `models` has model, model_type (`dc` or `denoise`), in_channels, processed_input.
    The tests (`known_tests(dataset)` for all) are generated per model from the short list.
    """
    model, test = F.col("model"), F.col("test")
    rows = models.filter(~_any_contained(model, banned))
    if allowed:
        rows = rows.filter(_any_contained(model, allowed))
    rows = rows.withColumn("test", F.explode(F.array(*[F.lit(t) for t in tests])))
    processed = F.coalesce("processed_input", F.lit(False))
    kind = (
        F.when((F.col("in_channels") == 3) & processed & F.lit("proc" in inputs), "proc")
        .when((F.col("in_channels") == 3) & ~processed & F.lit("prgb" in inputs), "prgb")
        .when((F.col("in_channels") == 4) & F.lit("bayer" in inputs), "bayer")
    )
    is_dc = F.col("model_type") == "dc"
    skipped = (
        (test.contains("progressive_manproc") & is_dc)
        | (model.contains("bm3d") & ~test.isin("test_manproc", "test_progressive_manproc"))
        | (_any_contained(test, NOT_FOR_DENOISE) & (F.col("model_type") == "denoise"))
        | (~test.contains("manproc") & processed)
    )
    on_cpu = F.lit(cpu) | ((test == "test_manproc") & ((F.col("input") != "bayer") | model.contains("preup")))
    output = F.when(F.col("input") == "bayer", "prgb").otherwise(F.col("input"))
    return (
        rows.withColumn("input", kind)
        .filter(F.col("input").isNotNull() & ~skipped)
        .select(
            "model",
            "test",
            F.concat_ws("_", "test", "model_type", F.concat("input", F.lit("2"), output)).alias("test_id"),
            F.when(on_cpu, "cpu").otherwise("gpu").alias("device"),
        )
    )


def pending_evaluations(matrix: DataFrame, results: DataFrame, loss: str = "msssim_loss") -> DataFrame:
    """Evaluations not recorded under any spelling of `<test>_<loss>`, `.None` or `.gamma22`."""
    spelling = rf"^(.*)_{loss}(\.None|\.gamma22)?$"
    known = (
        results.filter(F.col("metric").rlike(spelling) & F.col("value").isNotNull())
        .select("model", F.regexp_extract("metric", spelling, 1).alias("_name"))
        .distinct()
    )
    named = matrix.withColumn("_name", F.regexp_replace("test", "^test_", ""))
    return named.join(known, ["model", "_name"], "left_anti").drop("_name")


def prune_steps(files: DataFrame, results: DataFrame, prefix: str) -> DataFrame:
    """Checkpoint files of steps that are not a best step of a metric starting with `prefix`.

    A model is left alone if it has no best step, or if no best step still has both of
    its files.
    """
    pattern = r"^iter_(\d+)\.pt(\.opt)?$"
    stored = files.filter(F.col("name").rlike(pattern)).withColumns(
        {
            "step": F.regexp_extract("name", pattern, 1).cast("bigint"),
            "is_opt": F.col("name").endswith(".opt"),
        }
    )
    kept_steps = (
        best_step(results.filter(F.col("metric").startswith(prefix)))
        .select("model", F.col("best_step").cast("bigint").alias("step"))
        .distinct()
    )
    guarded = (
        stored.join(kept_steps, ["model", "step"], "left_semi")
        .groupBy("model", "step")
        .agg(F.count_distinct("is_opt").alias("kinds"))
        .filter(F.col("kinds") == 2)
        .select("model")
        .distinct()
    )
    return (
        stored.join(guarded, "model", "left_semi")
        .join(kept_steps, ["model", "step"], "left_anti")
        .select("model", "step", "name", "size")
    )


def unreferenced(files: DataFrame, keep: DataFrame, exclude: str | None = None) -> DataFrame:
    """Models off the keep list with the bytes of their .tif and .exr outputs."""
    images = files.filter(F.col("name").endswith(".tif") | F.col("name").endswith(".exr"))
    if exclude:
        images = images.filter(~F.lower("model").contains(exclude.lower()))
    sizes = images.groupBy("model").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("files"))
    return sizes.join(keep.select("model").distinct(), "model", "left_anti")


def reclaimable(files: DataFrame) -> DataFrame:
    """Bytes and GiB per model and in total (null model)."""
    return files.rollup("model").agg(F.sum("size").alias("bytes")).withColumn(
        "gib", F.col("bytes") / float(1024**3)
    )


def stalled_runs(runs: DataFrame, now: Column) -> DataFrame:
    """Runs that may be removed as empty.

    `runs` has name, created, log_time, results_time (seconds, null if the file is
    missing), checkpoints (null if the folder is missing), has_val_best.
    """

    def younger(column: str, seconds: int) -> Column:
        return F.coalesce(now - F.col(column) < seconds, F.lit(False))

    has_results = F.col("results_time").isNotNull()
    young = younger("created", AGE_EMPTY)
    in_use = (
        (F.col("checkpoints") > 0) & has_results & (F.coalesce("has_val_best", F.lit(False)) | young)
    ) | ((F.col("checkpoints") == 0) & has_results & young)
    spared = (
        F.coalesce(in_use, F.lit(False))
        | younger("created", AGE_CREATED)
        | younger("log_time", AGE_LOG)
        | younger("results_time", AGE_RESULTS)
        | F.col("name").isin(*KEPT_NAMES)
    )
    return runs.filter(~spared)
