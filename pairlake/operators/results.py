"""Result analytics: best steps, best models, curves and fronts over evaluation logs.

`results` is long: (model, step, metric, value). Best steps are always derived, never stored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlake.operators.scan import CHUNK, in_chunks, ranked, running
from pairlake.operators.skew import checked_broadcast, salted_join
from pairlake.session import checkpointed

# Defaults of missing model attributes. Two of them are strings
# although their columns look boolean or nullable.
MODEL_DEFAULTS = {
    "processed_input": False,
    "preupsample": False,
    "data_pairing": "x_y",
    "transfer_fun": "None",
    "morechans": False,
    "extrapairs_B": False,
    "incl_cc": True,
    "passthrough": False,
    "denoise_then_compress": False,
    "bm3d": False,
    "noownpics": False,
    "JPEGXL": "False",
}
# The loss a model must be trained on to be compared by a metric.
METRICS_LOSS = {"mse": "mse", "msssim": "msssim_loss", "psnr": "mse"}
# Test ladders of the progressive evaluations.
PROGRESSIVE_LE = (0.85, 0.9, 0.97, 0.99)
PROGRESSIVE_GE = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 1.0)


# -- means -------------------------------------------------------------------------


def mean_results(image_results: DataFrame) -> DataFrame:
    """Mean of every metric over the images of one (model, test, step)."""
    return image_results.groupBy("model", "test", "step", "metric").agg(
        F.avg("value").alias("value")
    )


def combined_loss(images: DataFrame, weight: Column, loss: str = "msssim_loss") -> DataFrame:
    """Rate plus weighted loss per image, averaged per (model, test, step)."""
    return images.groupBy("model", "test", "step").agg(
        F.avg("bpp").alias("bpp"),
        F.avg(loss).alias(loss),
        F.avg(F.col("bpp") + weight * F.col(loss)).alias("combined"),
    )


# -- best steps --------------------------------------------------------------------


def _eligible(results: DataFrame, warmup: int, rm_none: bool) -> DataFrame:
    rows = results.filter(F.col("value").isNotNull() & (F.col("step") >= F.lit(warmup)))
    return rows.filter(F.col("value") != 0) if rm_none else rows


def best_step(
    results: DataFrame, minimize: bool = True, warmup: int = 0, rm_none: bool = False
) -> DataFrame:
    """First step with the best value per (model, metric)."""
    sign = 1.0 if minimize else -1.0
    first_best = F.min(F.struct((F.col("value") * F.lit(sign)).alias("v"), F.col("step").alias("s")))
    return (
        _eligible(results, warmup, rm_none)
        .groupBy("model", "metric")
        .agg(first_best.alias("b"))
        .select(
            "model",
            "metric",
            F.col("b.s").alias("best_step"),
            (F.col("b.v") * F.lit(sign)).alias("best_value"),
        )
    )


def best_step_values(results: DataFrame, key: str, minimize: bool = True) -> DataFrame:
    """All metrics recorded at the best step of `key`, per model."""
    steps = best_step(results.filter(F.col("metric") == key), minimize).select(
        "model", F.col("best_step").alias("step")
    )
    return results.filter(F.col("value").isNotNull()).join(steps, ["model", "step"])


def best_step_set(results: DataFrame) -> DataFrame:
    """Distinct best steps per model, over all metrics (what retention keeps)."""
    return best_step(results).select("model", F.col("best_step").alias("step")).distinct()


def running_best(results: DataFrame) -> DataFrame:
    """Best value so far per (model, metric) along step, and whether the step improved it."""
    rows = results.filter(F.col("value").isNotNull())
    scanned = running(
        rows,
        ["model", "metric"],
        [F.col("step")],
        {
            "previous": ("min", F.col("value"), False),
            "best_so_far": ("min", F.col("value"), True),
        },
    )
    improved = F.col("previous").isNull() | (F.col("value") < F.col("previous"))
    return scanned.withColumn("improved", improved).drop("previous")


def banded_results(
    image_results: DataFrame, scores: DataFrame, bands: dict[str, tuple[float | None, float | None]], metrics: list[str]
) -> DataFrame:
    """Long results (model, step, metric, value): the mean of each metric over the images of each band.

    `image_results` has model, step, image_key and the metrics, measured once per image; `scores`
    has one score per image_key. A band is (least, most) score, either None; its metrics are
    named `<band>_<metric>`, which `best_step` and the stream read like any other. An image is
    in as many bands as its score lies in; images without a score are in none.
    """
    inside = []
    for name, (least, most) in bands.items():
        within = F.col("score").isNotNull()
        within = within if least is None else within & (F.col("score") >= least)
        within = within if most is None else within & (F.col("score") <= most)
        inside.append(F.when(within, F.lit(name)))
    scored = salted_join(image_results, scores.select("image_key", "score"), ["image_key"], spread=["model", "step"])
    rows = scored.select("model", "step", *metrics, F.explode(F.array_compact(F.array(*inside))).alias("band"))
    means = rows.groupBy("model", "step", "band").agg(*[F.avg(m).alias(m) for m in metrics])
    named = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("value")) for m in metrics])).alias("v")
    return means.select("model", "step", "band", named).select("model", "step", F.concat_ws("_", "band", "v.m").alias("metric"), "v.value")


# -- learning-rate plateaus --------------------------------------------------------


class DeadlineMap:
    """What a range of steps does to the deadline it starts with: deadline in -> deadline out, and cuts.

    The map is constant on pieces: which step first moves the deadline is all that the start
    decides. Piece i holds for starts below `limits[i]` (and not below the one before). A start
    is at most the range's first step + patience, so pieces end there, or at a step that improves.
    """

    def __init__(self, patience: int):
        self.patience = patience
        self.limits, self.ends, self.cuts = ([] for _ in range(3))
        # Starts from the last limit on still wait for a step.
        self.waiting, self.least, self.until = True, None, None

    def step(self, at: int, improved: bool) -> None:
        moved = at + self.patience
        if self.until is None:
            self.until = max(moved, self.patience)
        if improved:
            self.ends = [moved] * len(self.ends)
            if self.waiting:
                self._piece(None, moved, 0)
            self.least = moved
            self._joined()
            return
        if self.least is not None and at > self.least:
            for i, end in enumerate(self.ends):
                if at > end:
                    self.ends[i], self.cuts[i] = moved, self.cuts[i] + 1
            self._joined()
            self.least = min(self.ends)
        if self.waiting and (not self.limits or self.limits[-1] < at):
            self._piece(None if at > self.until else at, moved, 1)

    def _piece(self, limit: int | None, end: int, cuts: int) -> None:
        """A limit of None holds for all starts that are left."""
        self.limits.append(limit)
        self.ends.append(end)
        self.cuts.append(cuts)
        self.waiting = limit is not None
        self.least = end if self.least is None else min(self.least, end)

    def _joined(self) -> None:
        """Neighbours that came to the same end become one piece."""
        kept = [i for i in range(len(self.ends)) if i + 1 == len(self.ends) or (self.ends[i], self.cuts[i]) != (self.ends[i + 1], self.cuts[i + 1])]
        self.limits, self.ends, self.cuts = ([x[i] for i in kept] for x in (self.limits, self.ends, self.cuts))

    @staticmethod
    def apply(limits, ends, cuts, start: int) -> tuple[int, int]:
        for limit, end, cut in zip(limits, ends, cuts):
            if pd.isna(limit) or start < limit:
                return int(end), int(cut)
        return start, 0


def plateau_schedule(
    results: DataFrame, patience: int, multiplier: float, square: bool = True, chunks: int | None = None
) -> DataFrame:
    """Steps at which the rate is lowered, with the number of cuts and the cumulative factor.

    A step that brings any metric to or below its best so far moves the deadline to
    step + patience. Any other step past the deadline cuts the rate and moves it too.
    The deadline is the only state carried along a model's log. Ranges of (model, step) become
    maps from the deadline they start with to the one they end with; a model's maps, one small
    row per range, are applied one after the other, which gives every range its true start. So
    steps are read twice, however many ranges there are, and no log is held in one task.
    """
    scanned = running(
        results.filter(F.col("value").isNotNull()),
        ["model", "metric"],
        [F.col("step")],
        {"best_so_far": ("min", F.col("value"), True)},
        chunks,
    )
    steps = scanned.groupBy("model", "step").agg(
        F.max(F.col("value") <= F.col("best_so_far")).alias("improved")
    )
    ranges = in_chunks(steps, ["model"], [F.col("step")], chunks)

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row per range; rows of a range come together and in order."""
        key, known = None, None

        def row() -> pd.DataFrame:
            return pd.DataFrame({"model": [key[0]], CHUNK: [key[1]], "limits": [known.limits], "ends": [known.ends], "n": [known.cuts]})

        for batch in batches:
            for at in zip(batch["model"], batch[CHUNK].tolist(), batch["step"].tolist(), batch["improved"].tolist()):
                if at[:2] != key:
                    if key is not None:
                        yield row()
                    key, known = at[:2], DeadlineMap(patience)
                known.step(*at[2:])
        if key is not None:
            yield row()

    def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Start and cuts before of every range of a model, from its maps in order."""
        model, start, cuts = None, 0, 0
        for batch in batches:
            out = []
            for name, chunk, *pieces in zip(batch["model"], batch[CHUNK], batch["limits"], batch["ends"], batch["n"]):
                if name != model:
                    model, start, cuts = name, patience, 0
                out.append((model, chunk, start, cuts))
                start, more = DeadlineMap.apply(*pieces, start)
                cuts += more
            yield pd.DataFrame(out, columns=["model", CHUNK, "start", "before"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, deadline, nth = None, 0, 0
        for batch in batches:
            out = []
            columns = (batch["model"], batch[CHUNK], batch["step"].tolist(), batch["improved"].tolist(), batch["start"], batch["before"])
            for model, chunk, step, improved, start, before in zip(*columns):
                if (model, chunk) != key:
                    key, deadline, nth = (model, chunk), start, before
                if not improved and step > deadline:
                    nth += 1
                    out.append((model, step, nth))
                    deadline = step + patience
                elif improved:
                    deadline = step + patience
            yield pd.DataFrame(out, columns=["model", "step", "cuts"])

    # Sorted partitions stream through; a range is never held as a whole.
    ordered = ranges.repartition("model", CHUNK).sortWithinPartitions("model", CHUNK, "step")
    maps = ordered.mapInPandas(mapped, f"model string, {CHUNK} int, limits array<bigint>, ends array<bigint>, n array<bigint>")
    chain = maps.repartition("model").sortWithinPartitions("model", CHUNK)
    starts = chain.mapInPandas(chained, f"model string, {CHUNK} int, start bigint, before bigint")
    begun = ranges.join(checkpointed(starts), ["model", CHUNK]).select("model", CHUNK, "step", "improved", "start", "before")
    begun = begun.repartition("model", CHUNK).sortWithinPartitions("model", CHUNK, "step")
    factor = float(multiplier * multiplier if square else multiplier)
    found = begun.mapInPandas(cut, "model string, step bigint, cuts bigint")
    return found.withColumn("factor", F.pow(F.lit(factor), F.col("cuts")))


# -- model tables ------------------------------------------------------------------


def fill_model_defaults(models: DataFrame) -> DataFrame:
    """Give every missing attribute its default."""
    columns = []
    for name in models.columns:
        if name in MODEL_DEFAULTS:
            columns.append(F.coalesce(F.col(name), F.lit(MODEL_DEFAULTS[name])).alias(name))
        else:
            columns.append(F.col(name))
    missing = [
        F.lit(value).alias(name) for name, value in MODEL_DEFAULTS.items() if name not in models.columns
    ]
    return models.select(*columns, *missing)


def _suffix_cut(key: Column) -> Column:
    """Drop the text from the last dot if any dot is followed by a letter."""
    return F.when(key.rlike(r"\.[a-zA-Z]"), F.regexp_replace(key, r"\.[^.]*$", "")).otherwise(key)


def wanted_metric_key() -> Column:
    """The metric whose best step represents a model."""
    base = F.when(
        F.col("lambda").isNull(), F.concat(F.lit("val_"), F.coalesce(F.col("loss"), F.lit("msssim_loss")))
    ).otherwise(F.lit("val_combined"))
    suffix = F.when(F.col("processed_input"), F.lit("arbitraryproc")).otherwise(F.col("transfer_fun"))
    return F.coalesce(F.col("val_key"), F.concat(base, F.lit("."), suffix))


def load_metric_key(models: DataFrame, results: DataFrame) -> DataFrame:
    """Resolve each model's key: the wanted one, else the same key with or without suffix."""
    wanted = wanted_metric_key()
    fallback = F.when(wanted.rlike(r"\.[a-zA-Z]"), _suffix_cut(wanted)).otherwise(
        F.concat(wanted, F.lit(".None"))
    )
    candidates = models.select(
        "model", F.posexplode(F.array(wanted, fallback)).alias("choice", "metric")
    )
    # best_step is one row per (model, metric), so both sides are unique on the join key.
    found = candidates.join(best_step(results), ["model", "metric"])
    return (
        found.groupBy("model")
        .agg(F.min(F.struct("choice", "metric", "best_step")).alias("hit"))
        .select("model", F.col("hit.metric").alias("load_key"), F.col("hit.best_step").alias("best_step"))
    )


def losses_to_metrics(results: DataFrame) -> DataFrame:
    """Add `msssim` = 1 - `msssim_loss` and cut transfer-function suffixes off metric names.

    Names that are cut to one name give one row: the value of the last of them in order.
    """
    is_loss = F.col("metric").contains("msssim_loss")
    entries = F.when(
        is_loss,
        F.array(
            F.struct(F.col("metric"), F.col("value")),
            F.struct(
                F.regexp_replace("metric", "msssim_loss", "msssim").alias("metric"),
                (F.lit(1.0) - F.col("value")).alias("value"),
            ),
        ),
    ).otherwise(F.array(F.struct(F.col("metric"), F.col("value"))))
    kept = [F.col(c) for c in results.columns if c not in ("metric", "value")]
    named = results.select(*kept, F.explode(entries).alias("e")).select(
        *kept, _suffix_cut(F.col("e.metric")).alias("metric"), "e"
    )
    last = F.max(F.struct("e.metric", "e.value")).alias("last")
    rows = named.groupBy(*[c for c in results.columns if c not in ("metric", "value")], "metric").agg(last)
    return rows.select(*kept, "metric", F.col("last.value").alias("value"))


def derive_variants(models: DataFrame, tag: str, prefix: str, flag: str) -> DataFrame:
    """Add a flagged, prefixed copy of each 3-channel x_x model; a copy replaces a same-named row."""
    copies = models.filter(
        (F.col("data_pairing") == "x_x") & (F.col("in_channels") == 3) & ~F.col("model").contains(tag)
    ).withColumns({"model": F.concat(F.lit(prefix), F.col("model")), flag: F.lit(True)})
    return models.join(copies.select("model"), "model", "left_anti").unionByName(copies)


def match_definitions(models: DataFrame, definitions: DataFrame, metric: str) -> DataFrame:
    """Models whose attributes all equal a definition's and whose loss fits the metric."""
    attributes = [c for c in definitions.columns if c != "definition"]
    named = definitions.select("definition", *[F.col(a).alias(f"_d_{a}") for a in attributes])
    same = F.lit(True)
    for attribute in attributes:
        same = same & F.col(attribute).eqNullSafe(F.col(f"_d_{attribute}"))
    fits = models.filter(F.col("passthrough") | F.col("loss").contains(METRICS_LOSS[metric]))
    return fits.join(checked_broadcast(named), same).drop(*[f"_d_{a}" for a in attributes])


def flag_listed(models: DataFrame, listed: DataFrame) -> DataFrame:
    """`strictly_worse`: the model's name is on the list."""
    marks = listed.select("model").distinct().withColumn("_listed", F.lit(True))
    return models.join(marks, "model", "left").select(
        *models.columns, F.col("_listed").isNotNull().alias("strictly_worse")
    )


# -- best per group ----------------------------------------------------------------


def best_model_per_image(results: DataFrame) -> DataFrame:
    """Lowest loss per picture; the first model wins ties."""
    return (
        results.filter(F.col("msssim_loss").isNotNull())
        .groupBy("image_key")
        .agg(F.min(F.struct("msssim_loss", "model")).alias("b"))
        .select(
            "image_key",
            F.col("b.model").alias("model"),
            (F.lit(1.0) - F.col("b.msssim_loss")).alias("msssim"),
        )
    )


def best_per_definition(matched: DataFrame, metric: str, mode: str = "best") -> DataFrame:
    """Best validated model per definition; the first in `position` order wins ties.

    `best` minimises mse and maximises similarity. `reference` always maximises and also
    keeps the rows that did not beat the best seen before them.
    """
    if mode == "best":
        sign = 1.0 if metric == "mse" else -1.0
        return (
            matched.groupBy("definition")
            .agg(F.min(F.struct((F.col("value") * F.lit(sign)).alias("v"), "position", "model")).alias("b"))
            .select(
                "definition",
                F.col("b.model").alias("model"),
                (F.col("b.v") * F.lit(sign)).alias("value"),
            )
        )
    scanned = running(
        matched,
        ["definition"],
        [F.col("position")],
        {"seen": ("max", F.col("value"), False)},
    )
    winners = matched.groupBy("definition").agg(
        F.min(F.struct((-F.col("value")).alias("v"), "position")).alias("b")
    ).select("definition", F.col("b.position").alias("position"), F.lit(True).alias("_wins"))
    return (
        scanned.join(winners, ["definition", "position"], "left")
        .filter(F.col("_wins") | (F.col("value") <= F.col("seen")))
        .select("definition", "model", "value")
    )


# -- curves ------------------------------------------------------------------------


def apply_exclusions(points: DataFrame, rules: Sequence[tuple[str, str, str | None, str]]) -> DataFrame:
    """Drop points by (group, test, metric, mode); mode `exact` compares the group and test
    names, `substring` looks for them. An empty test or a None metric matches all."""
    dropped = F.lit(False)
    for group, test, metric, mode in rules:
        if mode == "exact":
            hit = (F.col("group") == group) & (F.lit(test == "") | (F.col("test") == test))
        else:
            hit = F.col("group").contains(group) & F.col("test").contains(test)
        if metric is not None:
            hit = hit & (F.col("metric") == metric)
        dropped = dropped | hit
    return points.filter(~dropped)


def rd_curve(points: DataFrame) -> DataFrame:
    """Rate-distortion rows. Flagged rows are reported without a place on the curve."""
    rows = points.filter(F.col("bpp").isNotNull() & F.col("value").isNotNull())
    on_curve = ranked(
        rows.filter(~F.col("strictly_worse")),
        ["group"],
        [F.col("bpp"), F.col("value"), F.col("model")],
        "place",
    )
    flagged = rows.filter("strictly_worse").withColumn("place", F.lit(None).cast("bigint"))
    return on_curve.unionByName(flagged)


def drop_strictly_worse(points: DataFrame, metric: str, by_x: bool = False) -> DataFrame:
    """Keep the best rows of each group, ties included.

    `by_x=False` (bars): flagged rows go first, then lowest mse or highest similarity.
    `by_x=True` (progressive curve): among rows with equal x the highest y stays, as does
    every perfect y; other metrics than msssim pass unchanged.
    """
    if by_x:
        if metric != "msssim":
            return points
        keys, rows, best = ["group", "x"], points, F.max("value")
    else:
        keys, rows = ["group"], points.filter(~F.col("strictly_worse"))
        best = F.min("value") if metric == "mse" else F.max("value")
    tops = rows.groupBy(*keys).agg(best.alias("_best"))
    kept = salted_join(rows, tops, keys, spread=["model"])
    stays = F.col("value") == F.col("_best")
    if by_x:
        stays = stays | (F.col("value") >= 1.0)
    return kept.filter(stays).select(*points.columns)


def pareto_front(points: DataFrame, keys: list[str]) -> DataFrame:
    """Add `dominated`: another point of the group has no higher rate and no lower value,
    and is better in one of them."""
    tops = points.groupBy(*keys, "bpp").agg(F.max("value").alias("_top"))
    scanned = running(tops, keys, [F.col("bpp")], {"_before": ("max", F.col("_top"), False)})
    joined = salted_join(points, scanned, [*keys, "bpp"], spread=["model"])
    dominated = (F.col("value") < F.col("_top")) | (
        F.coalesce(F.col("_before") >= F.col("value"), F.lit(False))
    )
    return joined.withColumn("dominated", dominated).drop("_top", "_before")


def progressive_points(results: DataFrame, baseline: str, tests: Sequence[str]) -> DataFrame:
    """x = the baseline model's value on a test, y = the model's value on the same test."""
    rows = results.filter(F.col("metric").isin(list(tests)))
    xs = rows.filter(F.col("model") == baseline).select("metric", F.col("value").alias("x"))
    ys = rows.filter(F.col("model") != baseline).withColumnRenamed("value", "y")
    # One x per listed test name.
    return ys.join(checked_broadcast(xs, max(len(tests), 1)), "metric")


def latest_iteration(chain: DataFrame) -> DataFrame:
    """Last usable member of each experiment chain `name_`, `name_-1`, `name_-2`, ...

    `chain` has (model, has_metric, has_file). The walk goes on while the next member
    exists and has its metric, and answers the last member on the way whose best file exists.
    Models with names of another form are no members.
    """
    index = F.when(F.col("model").endswith("_"), F.lit(0)).otherwise(
        F.regexp_extract("model", r"_-(\d{1,2})$", 1).try_cast("int")
    )
    members = chain.select(
        F.regexp_replace("model", r"_-\d{1,2}$", "_").alias("base"),
        index.alias("idx"),
        "has_metric",
        "has_file",
        "model",
    ).filter(F.col("idx").isNotNull())
    walked = members.filter("has_metric")
    following = walked.select("base", (F.col("idx") - 1).alias("idx")).distinct()
    # The walk stops at the smallest index whose successor is missing. Keys are unique.
    stops = (
        walked.join(following, ["base", "idx"], "left_anti").groupBy("base").agg(F.min("idx").alias("_stop"))
    )
    starts = walked.filter(F.col("idx") == 0).select("base")
    reached = (
        walked.join(starts, "base", "left_semi")
        .join(stops, "base")
        .filter((F.col("idx") <= F.col("_stop")) & F.col("has_file"))
    )
    return (
        reached.groupBy("base")
        .agg(F.max(F.struct("idx", "model")).alias("b"))
        .select("base", F.col("b.idx").alias("idx"), F.col("b.model").alias("latest"))
    )
