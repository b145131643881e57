"""Images as tile rows, and statistics over them.

A tile row is (image_id, c, frame_h, frame_w, ty, tx, y0, x0, h, w, data): channel-planar
samples of one rectangle. Frames of any size are many rows of bounded size, so no image
is ever held in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlake.operators.skew import checked_broadcast
from pairlake.session import shuffle_width

TILE = 256

TILE_COLUMNS = ["image_id", "c", "frame_h", "frame_w", "ty", "tx", "y0", "x0", "h", "w", "data"]


def window_of(data: str, c: str, h: str, w: str, y: str, x: str, wh: str, ww: str) -> str:
    """SQL text: samples of a window of a planar (c, h, w) array."""
    return (
        f"flatten(transform(sequence(0, {c} - 1), _ch -> flatten(transform(sequence(0, {wh} - 1), "
        f"_row -> slice({data}, _ch * {h} * {w} + ({y} + _row) * {w} + {x} + 1, {ww})))))"
    )


def tile_frames(frames: DataFrame, size: int = TILE) -> DataFrame:
    """Cut whole frames (image_id, c, frame_h, frame_w, data) into tiles."""
    keep = [c for c in frames.columns if c not in ("c", "frame_h", "frame_w", "data")]
    cut = frames.selectExpr("*", f"explode(sequence(0, CAST(ceil(frame_h / {size}) AS int) - 1)) AS ty").selectExpr(
        "*", f"explode(sequence(0, CAST(ceil(frame_w / {size}) AS int) - 1)) AS tx"
    )
    placed = cut.selectExpr(
        "*",
        f"ty * {size} AS y0",
        f"tx * {size} AS x0",
        f"least({size}, frame_h - ty * {size}) AS h",
        f"least({size}, frame_w - tx * {size}) AS w",
    )
    whole = "c = 1 AND h = frame_h AND w = frame_w"
    # The window line by line over all channels: half the copies that `window_of` makes of a sample.
    line = "(_line div greatest(h, 1) * frame_h + y0 + _line % greatest(h, 1)) * frame_w + x0 + 1"
    window = f"flatten(transform(sequence(0, c * h - 1), _line -> slice(data, CAST({line} AS int), w)))"
    return placed.withColumn("data", F.expr(f"CASE WHEN {whole} THEN data ELSE {window} END")).select(
        *keep, *[c for c in TILE_COLUMNS if c not in keep]
    )


def attach_meta(tiles: DataFrame, meta: DataFrame, *columns: str) -> DataFrame:
    """Columns of each image's own row of `meta` (one row per image_id) beside its tiles or pixels.

    Images without a row keep nulls. A small `meta` is broadcast, after a check of its rows.
    """
    about = meta.select("image_id", *columns)
    clash = [c for c in columns if c in tiles.columns]
    return tiles.drop(*clash).join(checked_broadcast(about), "image_id", "left")


def to_pixels(tiles: DataFrame, *carry: str) -> DataFrame:
    """Long form: one row per sample (image_id, ch, y, x, v)."""
    return tiles.select(
        "image_id", *carry, "h", "w", "y0", "x0", F.posexplode("data").alias("pos", "v")
    ).selectExpr(
        "image_id",
        *carry,
        "pos div (h * w) AS ch",
        "CAST(y0 + pos div w % h AS int) AS y",
        "CAST(x0 + pos % w AS int) AS x",
        "v",
    )


# -- statistics --------------------------------------------------------------------


def _sum(data: Column) -> Column:
    return F.aggregate(data, F.lit(0.0), lambda s, v: s + v)


def image_sums(tiles: DataFrame) -> DataFrame:
    """Sum and count of samples per image; tiles are reduced before the shuffle."""
    return tiles.groupBy("image_id").agg(
        F.sum(_sum(F.col("data"))).alias("total"), F.sum(F.size("data")).alias("n")
    )


def image_stats(tiles: DataFrame) -> DataFrame:
    """Mean, sample standard deviation and sum per image."""
    return (
        tiles.select("image_id", F.explode("data").alias("v"))
        .groupBy("image_id")
        .agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.sum("v").alias("total"))
    )


def channel_max(data: Column, c: Column | int, plane: Column) -> Column:
    """Per-position maximum over the channels of a planar array."""
    channels = F.lit(c) if isinstance(c, int) else c
    rest = F.when(channels > 1, F.sequence(F.lit(1), channels - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(
        rest,
        F.slice(data, 1, plane),
        lambda best, ch: F.zip_with(best, F.slice(data, ch * plane + 1, plane), lambda a, b: F.greatest(a, b)),
    )


def exposed_mask(tiles: DataFrame, bound: Column) -> DataFrame:
    """`mask` per tile: true where all channels stay below the overexposure bound."""
    top = channel_max(F.col("data"), F.col("c"), F.col("h") * F.col("w"))
    return tiles.withColumn("mask", F.transform(top, lambda v: v < bound))


def exposed_mask_from_planes(tiles: DataFrame, bound: Column) -> DataFrame:
    """Full-resolution mask from half-resolution mosaic planes (each cell covers 2x2)."""
    masked = exposed_mask(tiles, bound)
    doubled = (
        "flatten(transform(sequence(0, 2 * h - 1), r -> transform(sequence(0, 2 * w - 1), "
        "k -> element_at(mask, CAST((r div 2) * w + k div 2 + 1 AS int)))))"
    )
    return masked.withColumn("mask", F.expr(doubled))


def exposure_ok(
    planes: DataFrame,
    bound: Column,
    overexposed: float = 0.99,
    underexposed: float = 0.001,
    share: float = 0.75,
) -> DataFrame:
    """Whether at most `share` of the mosaic cells of an image are burnt or black.

    Use `underexposed` 0.0001 for external sets; 0 skips that side.
    """
    top = channel_max(F.col("data"), F.col("c"), F.col("h") * F.col("w"))

    def bad(v: Column) -> Column:
        burnt = v >= F.lit(overexposed) * bound
        return burnt | (v <= underexposed) if underexposed > 0 else burnt

    counted = planes.select(
        "image_id",
        F.size(F.filter(top, bad)).alias("bad"),
        (F.col("h") * F.col("w")).alias("cells"),
    )
    return counted.groupBy("image_id").agg(
        (F.sum("bad") / F.sum("cells")).alias("bad_share"),
        (F.sum("bad") / F.sum("cells") <= share).alias("ok"),
    )


def _plane(channel: int) -> Column:
    plane = F.col("h") * F.col("w")
    return F.slice("data", F.lit(channel) * plane + 1, plane)


def channel_sums(tiles: DataFrame, of=lambda v: v, channels: int = 3) -> DataFrame:
    """Sum per channel and pixel count per image, after a sample function."""
    return tiles.groupBy("image_id").agg(
        *[F.sum(_sum(F.transform(_plane(i), of))).alias(f"s{i}") for i in range(channels)],
        F.sum(F.col("h") * F.col("w")).alias("n"),
    )


def mean_rgb(tiles: DataFrame) -> DataFrame:
    """Mean over all channels and pixels per image."""
    return image_sums(tiles).select("image_id", (F.col("total") / F.col("n")).alias("gt_rgb_mean"))


# -- whole-image colour operations -------------------------------------------------


def gray_world(tiles: DataFrame) -> DataFrame:
    """Scale each channel to the mean of the three channel means (of clipped samples).

    A channel whose clipped samples are all 0 has no gain and stays as it is.
    """

    def clipped(v: Column) -> Column:
        return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))

    sums = channel_sums(tiles, clipped)
    means = [F.col(f"s{i}") / F.col("n") for i in range(3)]
    target = reduce(lambda a, b: a + b, means) / F.lit(3.0)
    gains = sums.select("image_id", *[F.coalesce(F.try_divide(target, means[i]), F.lit(1.0)).alias(f"g{i}") for i in range(3)])

    def times(gain: Column):
        return lambda v: v * gain

    scaled = F.concat(*[F.transform(_plane(i), times(F.col(f"g{i}"))) for i in range(3)])
    return tiles.join(gains, "image_id").withColumn("data", scaled).select(*tiles.columns)


def log_tonemap(tiles: DataFrame, epsilon: float = 0.001) -> DataFrame:
    """Logarithmic curve on luma, normalised to the image's own range; chroma stays.

    The luma of an image with one luma everywhere becomes 0.
    """
    from pairlake.functions import colour as K

    shown = tiles.withColumns({"_r": _plane(0), "_g": _plane(1), "_b": _plane(2)}).withColumn(
        "yuv",
        F.transform(
            F.arrays_zip("_r", "_g", "_b"),
            lambda p: F.struct(*[k.alias(n) for k, n in zip(K.rgb_to_yuv(p["_r"], p["_g"], p["_b"]), "yuv")]),
        ),
    )
    # The curve is increasing, so the range of the mapped luma follows from the luma range.
    lumas = F.transform("yuv", lambda p: p["y"])
    span = shown.groupBy("image_id").agg(
        F.min(F.array_min(lumas)).alias("lo"), F.max(F.array_max(lumas)).alias("hi")
    )
    eps = F.lit(epsilon)
    base = F.log(F.greatest(F.lit(1.0) + F.col("hi") + eps, eps))

    def curve(y: Column) -> Column:
        return F.try_divide(F.log(F.greatest(F.lit(1.0) + y, eps)), base)

    def mapped(y: Column) -> Column:
        reach = curve(F.col("hi")) - curve(F.col("lo"))
        return F.coalesce(F.try_divide(curve(y) - curve(F.col("lo")), reach), F.lit(0.0))

    joined = shown.join(span, "image_id")
    rgb = F.transform(
        "yuv",
        lambda p: F.struct(*[k.alias(n) for k, n in zip(K.yuv_to_rgb(mapped(p["y"]), p["u"], p["v"]), "rgb")]),
    )
    planes = F.expr("concat(transform(_rgb, p -> p.r), transform(_rgb, p -> p.g), transform(_rgb, p -> p.b))")
    return joined.withColumn("_rgb", rgb).withColumn("data", planes).select(*tiles.columns)


def variant_difference(variants: DataFrame) -> DataFrame:
    """Mean absolute difference between two processings of the same tile.

    `variants` has algorithm, image_id, ty, tx, left, right (arrays). Null algorithm is
    the overall row.
    """
    difference = _sum(F.zip_with("left", "right", lambda a, b: F.abs(a - b)))
    sums = variants.groupBy("algorithm", "image_id").agg(
        F.sum(difference).alias("s"), F.sum(F.size("left")).alias("n")
    )
    losses = sums.select("algorithm", (F.col("s") / F.col("n")).alias("loss"))
    return losses.rollup("algorithm").agg(F.avg("loss").alias("loss"))


# -- neighbourhoods ----------------------------------------------------------------


def with_halo(tiles: DataFrame, halo: int, size: int = TILE) -> DataFrame:
    """Collect, for each tile, the samples up to `halo` lines around it.

    Each tile sends only the overlapping window to its neighbours, so a group holds one
    tile and its border (a fixed number of parts), never an image. `parts` lists windows
    as (y, x, h, w, data) in frame coordinates. `size` is the tile size of the table.
    """
    if halo == 0:
        own = "array(struct(y0 AS y, x0 AS x, h AS h, w AS w, data AS data)) AS parts"
        return tiles.selectExpr(*[c for c in TILE_COLUMNS if c != "data"], own)
    reach = tiles.selectExpr(
        "*",
        f"explode(sequence(CAST(greatest(y0 - {halo}, 0) div {size} AS int), "
        f"CAST(least(y0 + h - 1 + {halo}, frame_h - 1) div {size} AS int))) AS _ty",
    ).selectExpr(
        "*",
        f"explode(sequence(CAST(greatest(x0 - {halo}, 0) div {size} AS int), "
        f"CAST(least(x0 + w - 1 + {halo}, frame_w - 1) div {size} AS int))) AS _tx",
    )
    # Window of this tile that the receiving tile (_ty, _tx) needs, in own coordinates.
    window = reach.selectExpr(
        "*",
        f"greatest(_ty * {size} - {halo} - y0, 0) AS wy",
        f"greatest(_tx * {size} - {halo} - x0, 0) AS wx",
        f"least((_ty + 1) * {size} + {halo} - y0, h) AS wy1",
        f"least((_tx + 1) * {size} + {halo} - x0, w) AS wx1",
    ).selectExpr("*", "wy1 - wy AS wh", "wx1 - wx AS ww")
    cut = window_of("data", "c", "h", "w", "wy", "wx", "wh", "ww")
    part = f"struct(y0 + wy AS y, x0 + wx AS x, wh AS h, ww AS w, CASE WHEN wh = h AND ww = w THEN data ELSE {cut} END AS data)"
    return (
        window.selectExpr("image_id", "c", "frame_h", "frame_w", "_ty AS ty", "_tx AS tx", f"{part} AS part")
        # A fixed width: kernels do far more work per byte than the optimiser's size targets assume.
        .repartition(shuffle_width(tiles.sparkSession), "image_id", "ty", "tx")
        .groupBy("image_id", "ty", "tx")
        .agg(
            *[F.first(c).alias(c) for c in ("c", "frame_h", "frame_w")], F.collect_list("part").alias("parts")
        )
        .selectExpr(
            "image_id",
            "c",
            "frame_h",
            "frame_w",
            "ty",
            "tx",
            f"ty * {size} AS y0",
            f"tx * {size} AS x0",
            f"least({size}, frame_h - ty * {size}) AS h",
            f"least({size}, frame_w - tx * {size}) AS w",
            "parts",
        )
    )
