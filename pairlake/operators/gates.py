"""Gates, splits and score statistics over pair descriptors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlake.functions import naming as N

# Quality gate and debug subset.
ALIGNMENT_MAX_LOSS = 0.035
MASK_MEAN_MIN = 0.8
TOY_IMAGES = 25
# Similarity bands (lowest, highest) of the derived test sets.
SCORE_BANDS = {"hq": (0.95, None), "q99": (0.99, None), "q995": (0.995, None), "gt": (1.0, None)}


def reserve_split(
    pairs: DataFrame, reserve: DataFrame | Sequence[str], test: bool, match: str = "exact"
) -> DataFrame:
    """Rows of reserved scenes (`test`) or of all others.

    `exact` compares scene names and takes a list or a table. `substring` looks for any of
    the listed texts inside the scene name. The two disagree on purpose.
    """
    scene = F.col("image_set")
    if match == "substring":
        hit = F.lit(False)
        for text in reserve:
            hit = hit | scene.contains(text)
        return pairs.filter(hit if test else ~hit)
    if match != "exact":
        raise ValueError(f"unknown match {match!r}")
    if isinstance(reserve, DataFrame):
        names = reserve.select("image_set").distinct()
        return pairs.join(names, "image_set", "left_semi" if test else "left_anti")
    hit = scene.isin(list(reserve))
    return pairs.filter(hit if test else ~hit)


def quality_gate(
    pairs: DataFrame, max_loss: float = ALIGNMENT_MAX_LOSS, min_mask: float = MASK_MEAN_MIN
) -> DataFrame:
    return pairs.filter(
        (F.col("best_alignment_loss") <= max_loss) & (F.col("mask_mean") >= min_mask)
    )


def bayer_only(pairs: DataFrame) -> DataFrame:
    return pairs.filter("is_bayer")


def score_band(
    pairs: DataFrame, lo: float | None = None, hi: float | None = None, mode: str = "loader"
) -> DataFrame:
    """Rows whose score lies in [lo, hi]; a missing score fails the job when it matters.

    `loader`: a lower bound of 0 or None and an upper bound of 0, 1 or None are off.
    `strict`: only None turns a bound off, and a missing score always fails.
    """
    score = F.col("rgb_msssim_score")
    if mode == "loader":
        lo = lo or None
        hi = hi if hi and hi != 1.0 else None
        checks = lo is not None or hi is not None
    elif mode == "strict":
        checks = True
    else:
        raise ValueError(f"unknown mode {mode!r}")
    if not checks:
        return pairs
    inside = F.lit(True)
    if lo is not None:
        inside = inside & (score >= lo)
    if hi is not None:
        inside = inside & (score <= hi)
    return pairs.filter(
        F.when(score.isNull(), F.raise_error(F.lit("a pair has no similarity score"))).otherwise(inside)
    )


def with_usable_crops(pairs: DataFrame) -> DataFrame:
    """Images with at least one crop, crops ordered by coordinates."""
    return pairs.filter(F.size("crops") > 0).withColumn("crops", F.sort_array("crops"))


def centre_crop_of_list(pairs: DataFrame) -> DataFrame:
    """The middle crop of each image's ordered list."""
    return with_usable_crops(pairs).withColumn(
        "crop", F.element_at("crops", (F.size("crops") / F.lit(2)).cast("int") + 1)
    )


def toy(pairs: DataFrame, order: list[str], n: int = TOY_IMAGES) -> DataFrame:
    """The first `n` accepted images over all content files."""
    return pairs.orderBy(*order).limit(n)


def derive_paths(pairs: DataFrame) -> DataFrame:
    """Developed, sidecar and aligned-output paths of a pair."""
    f_developed, gt_developed = N.developed_path(F.col("f_fpath")), N.developed_path(F.col("gt_fpath"))
    names = pairs.withColumns({"f_linrec2020_fpath": f_developed, "gt_linrec2020_fpath": gt_developed})

    def folder(path: str) -> Column:
        return F.replace(N.path_parent(F.col(path)), F.lit("proc/lin_rec2020"), F.lit("proc/dt"))

    f_name, gt_name = N.path_leaf(F.col("f_linrec2020_fpath")), N.path_leaf(F.col("gt_linrec2020_fpath"))
    scene = F.col("image_set")
    # A noisy image never goes to the gt folder, where the clean image's sidecar lives.
    noisy_folder = F.replace(folder("f_linrec2020_fpath"), F.lit("/gt"), F.lit(""))
    return names.withColumns(
        {
            "dt_xmp": F.concat("gt_linrec2020_fpath", F.lit(".xmp")),
            "gt_manproc_fpath": F.concat_ws(
                "/", folder("gt_linrec2020_fpath"), N.aligned_name(scene, gt_name, f_name)
            ),
            "f_manproc_fpath": F.concat_ws("/", noisy_folder, N.aligned_name(scene, f_name, gt_name)),
        }
    )


def manproc_descriptor(
    pairs: DataFrame, reserve: DataFrame | Sequence[str], means: DataFrame | None = None
) -> DataFrame:
    """Developed test pairs: reserved scenes, Bayer, quality gate, derived paths, clean mean."""
    gated = quality_gate(bayer_only(reserve_split(pairs, reserve, test=True)))
    described = derive_paths(gated.drop("crops"))
    if means is None:
        return described
    return described.join(means, ["gt_fpath", "f_fpath"], "left")


def manproc_unpaired(unpaired: DataFrame) -> DataFrame:
    """Unpaired test images: the clean image stands on both sides, score 1."""
    bayer = F.col("bayer_fpath")
    developed = N.developed_path(bayer)
    folder = F.replace(N.path_parent(developed), F.lit("proc/lin_rec2020"), F.lit("proc/dt"))
    output = F.concat_ws("/", folder, N.path_leaf(developed))
    return unpaired.drop("crops").withColumns(
        {
            "image_set": N.path_leaf(bayer),
            "gt_fpath": bayer,
            "f_fpath": bayer,
            "rgb_msssim_score": F.lit(1.0),
            "gt_linrec2020_fpath": developed,
            "dt_xmp": F.concat(developed, F.lit(".xmp")),
            "gt_manproc_fpath": output,
            "f_manproc_fpath": output,
        }
    )


# -- score statistics --------------------------------------------------------------


def threshold_join(rows: DataFrame, thresholds: Sequence[float], op: str = "le") -> DataFrame:
    """One row per (row, threshold it satisfies).

    The thresholds are a short parameter list, so they are generated in place of a join.
    """
    score = F.col("rgb_msssim_score")
    ladder = F.array(*[F.lit(float(t)) for t in thresholds])
    passed = F.filter(ladder, lambda t: (score <= t) if op == "le" else (score >= t))
    return rows.withColumn("threshold", F.explode(passed))


def mean_by_threshold(
    pairs: DataFrame, reserve: DataFrame | Sequence[str], thresholds: Sequence[float], op: str = "le"
) -> DataFrame:
    """Crop-weighted mean score and crop count per threshold over reserved Bayer pairs.

    Each threshold is a conditional sum, so rows are neither joined nor multiplied.
    """
    scored = reserve_split(bayer_only(pairs), reserve, test=True).filter(
        F.col("rgb_msssim_score").isNotNull()
    )
    score, n = F.col("rgb_msssim_score"), F.size("crops")
    sums = []
    for i, t in enumerate(thresholds):
        passes = score <= t if op == "le" else score >= t
        sums.append(F.sum(F.when(passes, score * n)).alias(f"s{i}"))
        sums.append(F.sum(F.when(passes, n)).alias(f"n{i}"))
    wide = scored.agg(*sums)
    rows = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("threshold"),
                (F.col(f"s{i}") / F.col(f"n{i}")).alias("mean_score"),
                F.col(f"n{i}").alias("crops"),
            )
            for i, t in enumerate(thresholds)
        ]
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*").filter(F.col("crops") > 0)


def score_histogram(pairs: DataFrame, start: float = 0.4, end: float = 1.0, width: float = 0.05) -> DataFrame:
    """Noisy-pair counts per bin; the last bin is closed, empty bins stay."""
    bins = round((end - start) / width)
    score = F.col("rgb_msssim_score")
    scored = pairs.filter((F.col("f_fpath") != F.col("gt_fpath")) & score.isNotNull()).filter(
        (score >= start) & (score <= end)
    )
    place = F.least(F.floor((score - start) / width + 1e-9), F.lit(bins - 1)).cast("int")
    counts = scored.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("pairs"))
    grid = pairs.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin",
        (F.lit(start) + F.col("bin") * width + width / 2).alias("centre"),
        F.coalesce("pairs", F.lit(0)).alias("pairs"),
    )


def density_histogram(pairs: DataFrame, reserve: DataFrame | Sequence[str], bins: int = 50) -> DataFrame:
    """Equal bins over [min, max] of reserved scenes' scores, as densities.

    If all scores are equal, the range is widened by 0.5 on both sides.
    """
    scores = reserve_split(pairs, reserve, test=True).select(
        F.coalesce("rgb_msssim_score", F.lit(0.0)).alias("score")
    )
    # One row of three numbers.
    span = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count("score").alias("n")).first()
    if span.n == 0:
        raise ValueError("no reserved scene has a pair")
    lo, hi = (span.lo, span.hi) if span.lo < span.hi else (span.lo - 0.5, span.hi + 0.5)
    width = (hi - lo) / bins
    place = F.least(F.floor((F.col("score") - lo) / (hi - lo) * bins), F.lit(bins - 1))
    counts = scores.groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = pairs.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin",
        (F.lit(lo) + F.col("bin") * width).alias("edge"),
        (F.coalesce("n", F.lit(0)) / F.lit(span.n * width)).alias("density"),
    )
