"""Tile plans, crops and patches."""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlake.functions import geometry as G
from pairlake.operators import kernels as K
from pairlake.operators.batches import map_rows
from pairlake.operators.frames import TILE

# Stored tile, training crop and alignment reach on the half-size planes.
TILE_SIZE = 1024
TRAIN_SIZE = 256
REACH = 128
# Least valid share of a random crop, retries.
MIN_VALID = 0.5
MAX_RETRIES = 10


def plan_tiles(
    images: DataFrame, size: int = TILE_SIZE, train: int = TRAIN_SIZE, reach: int = REACH
) -> DataFrame:
    """Overlapping tiles of each image such that every training crop lies in one.

    `images` has base, h, w of the half-size planes. The rectangle of the developed image
    is twice the planned one.
    """
    if size % 16 or train % 16:
        raise ValueError("tile and training sizes must be multiples of 16")
    step, need = size - train, train + reach

    def origins(limit: str) -> str:
        return (
            f"explode(CASE WHEN {limit} > {need} THEN sequence(0, CAST({limit} - {need} - 1 AS int), {step}) "
            "ELSE array() END)"
        )

    limits = images.selectExpr("*", "h - h % 16 AS _lh", "w - w % 16 AS _lw")
    placed = limits.selectExpr("*", f"{origins('_lw')} AS x").selectExpr("*", f"{origins('_lh')} AS y")
    return placed.selectExpr(
        *images.columns,
        "x",
        "y",
        f"CAST(least(x + {size}, _lw) AS int) AS x1",
        f"CAST(least(y + {size}, _lh) AS int) AS y1",
        "concat(base, '.', x, '_', y) AS name",
    )


def cut_tiles(tiles: DataFrame, plan: DataFrame, size: int = TILE) -> DataFrame:
    """Samples of planned rectangles (image_id, name, y, x, y1, x1) from a tiled image.

    A rectangle is sent the tiles it touches, a number fixed by the two sizes.
    """
    touched = plan.selectExpr(
        "image_id", "name", "y", "x", "y1 - y AS rh", "x1 - x AS rw",
        f"explode(sequence(CAST(y div {size} AS int), CAST((y1 - 1) div {size} AS int))) AS ty",
    ).selectExpr(
        "*", f"explode(sequence(CAST(x div {size} AS int), CAST((x + rw - 1) div {size} AS int))) AS tx"
    )
    grouped = (
        touched.join(tiles.select("image_id", "c", "ty", "tx", "y0", "x0", "h", "w", "data"), ["image_id", "ty", "tx"])
        .groupBy("image_id", "name", "c", "y", "x", "rh", "rw")
        .agg(F.collect_list(F.expr("struct(y0 AS y, x0 AS x, h AS h, w AS w, data AS data)")).alias("parts"))
    )
    kind = dict(tiles.dtypes)["image_id"]

    def run(r: SimpleNamespace) -> Iterator[tuple]:
        window = K.assemble(r.parts, r.c, r.y, r.x, r.rh, r.rw)
        yield r.image_id, r.name, r.c, r.y, r.x, r.rh, r.rw, window.ravel()

    return map_rows(
        grouped, run, f"image_id {kind}, name string, c int, y int, x int, h int, w int, data array<double>"
    )


def grid_crops(tiles: DataFrame, size: int, bayer: bool = False) -> DataFrame:
    """Non-overlapping full crops of h x w tiles; size 0 takes the tile cut to a multiple of 256.

    `by`, `bx`, `bsize` address the same crop on mosaic planes.
    """
    if size == 0:
        whole = tiles.selectExpr("*", "0 AS y", "0 AS x", "h - h % 256 AS ch", "w - w % 256 AS cw")
        crops = whole.filter("ch > 0 AND cw > 0")
    else:

        def starts(length: str) -> str:
            return f"explode(CASE WHEN {length} >= {size} THEN sequence(0, {length} - {size}, {size}) ELSE array() END)"

        crops = tiles.selectExpr("*", f"{starts('h')} AS y").selectExpr(
            "*", f"{starts('w')} AS x", f"{size} AS ch", f"{size} AS cw"
        )
    if bayer:
        crops = crops.selectExpr("*", "y div 2 AS by", "x div 2 AS bx", "ch div 2 AS bh", "cw div 2 AS bw")
    return crops


def centre_crop(tiles: DataFrame, size: int) -> DataFrame:
    """Centred crop at even coordinates; tiles smaller than the crop drop out."""
    return tiles.filter((F.col("h") >= size) & (F.col("w") >= size)).withColumns(
        {"y": G.centre_start(F.col("h"), size), "x": G.centre_start(F.col("w"), size)}
    )


def uniform(key: Column, *salts: object) -> Column:
    """A number in [0, 1) fixed by a key and salts; equal in every engine with MD5."""
    text = F.concat_ws(":", key.cast("string"), *[s if isinstance(s, Column) else F.lit(str(s)) for s in salts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def crop_candidates(tiles: DataFrame, n: int, size: int, seed: int, retries: int = MAX_RETRIES) -> DataFrame:
    """Random even-aligned positions: `n` crops, each with 1 + `retries` attempts in order."""
    tried = tiles.withColumn("crop", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(
        "attempt", F.explode(F.sequence(F.lit(0), F.lit(retries)))
    )

    def start(axis: str, length: str) -> Column:
        at = F.floor(
            uniform(F.col("tile_id"), seed, F.col("crop").cast("string"), F.col("attempt").cast("string"), axis)
            * (F.col(length) - size)
        )
        return (at - at % 2).cast("int")

    return tried.withColumns({"y": start("y", "h"), "x": start("x", "w")})


def random_crops(
    tiles: DataFrame,
    n: int,
    size: int,
    seed: int,
    min_valid: float = MIN_VALID,
    retries: int = MAX_RETRIES,
    compat_channels: int = 1,
) -> DataFrame:
    """First attempt of each crop with enough valid pixels; (tile_id, crop, attempt, y, x).

    `tiles` has tile_id, h, w and `mask` (boolean, h x w). A tile one of whose crops finds
    no valid position is left out, as its image moves on to another tile. The share counts
    pixels; `compat_channels` 3 counts each pixel once per channel.
    """
    kind = dict(tiles.dtypes)["tile_id"]
    positions = crop_candidates(tiles.select("tile_id", "h", "w"), n, size, seed, retries)
    listed = positions.groupBy("tile_id").agg(
        F.sort_array(F.collect_list(F.struct("crop", "attempt", "y", "x"))).alias("tries")
    )

    def run(r: SimpleNamespace) -> Iterator[tuple]:
        area = np.zeros((r.h + 1, r.w + 1))
        mask = np.asarray(r.mask, dtype=np.float64).reshape(r.h, r.w)
        area[1:, 1:] = mask.cumsum(0).cumsum(1)
        chosen = {}
        for t in r.tries:
            y, x = t["y"], t["x"]
            valid = area[y + size, x + size] - area[y, x + size] - area[y + size, x] + area[y, x]
            if t["crop"] not in chosen and valid * compat_channels / size**2 >= min_valid:
                chosen[t["crop"]] = (t["attempt"], y, x)
        if len(chosen) == n:
            for crop, (attempt, y, x) in chosen.items():
                yield r.tile_id, crop, attempt, y, x

    usable = tiles.filter((F.col("h") > size) & (F.col("w") > size))
    return map_rows(
        usable.select("tile_id", "h", "w", "mask").join(listed, "tile_id"),
        run,
        f"tile_id {kind}, crop int, attempt int, y int, x int",
    )


def crop_to_multiple(pixels: DataFrame, multiple: int) -> DataFrame:
    """Drop the lines beyond the last multiple; pixels carry frame_h and frame_w."""
    h, w = F.col("frame_h"), F.col("frame_w")
    return pixels.filter((F.col("y") < G.floor_to(h, multiple)) & (F.col("x") < G.floor_to(w, multiple)))


# -- patches -----------------------------------------------------------------------


def patchify(pixels: DataFrame, size: int) -> DataFrame:
    """(patch, py, px) of each pixel, patches row by row; the remainder drops out."""
    kept = pixels.filter(
        (F.col("y") < G.floor_to(F.col("frame_h"), size)) & (F.col("x") < G.floor_to(F.col("frame_w"), size))
    )
    return kept.selectExpr(
        "*",
        f"CAST(y div {size} * (frame_w div {size}) + x div {size} AS int) AS patch",
        f"y % {size} AS py",
        f"x % {size} AS px",
    )


def unpatchify(patches: DataFrame, size: int) -> DataFrame:
    """Pixel positions back from (patch, py, px) and frame_w."""
    across = f"(frame_w div {size})"
    return patches.selectExpr(
        *[c for c in patches.columns if c not in ("y", "x", "patch", "py", "px")],
        f"CAST(patch div {across} * {size} + py AS int) AS y",
        f"CAST(patch % {across} * {size} + px AS int) AS x",
    )


def pixel_unshuffle(pixels: DataFrame, factor: int) -> DataFrame:
    """Space to depth: each factor x factor cell becomes channels."""
    return pixels.selectExpr(
        *[c for c in pixels.columns if c not in ("ch", "y", "x")],
        f"CAST(ch * {factor * factor} + y % {factor} * {factor} + x % {factor} AS int) AS ch",
        f"CAST(y div {factor} AS int) AS y",
        f"CAST(x div {factor} AS int) AS x",
    )


def pad_pair(pixels: DataFrame, size: int) -> DataFrame:
    """Centre both images of a pair on a zero canvas of at least size x size.

    `pixels` has pair_id, ch, y, x, a, b, frame_h, frame_w with equal frames.
    """
    before = {k: G.pad_before(F.col(k), size) for k in ("frame_h", "frame_w")}
    canvas = (
        pixels.select("pair_id", "ch", "frame_h", "frame_w")
        .distinct()
        .withColumns({"_y": before["frame_h"], "_x": before["frame_w"]})
        .selectExpr("*", f"explode(sequence(0, greatest(frame_h, {size}) - 1)) AS y")
        .selectExpr("*", f"explode(sequence(0, greatest(frame_w, {size}) - 1)) AS x")
        .selectExpr("pair_id", "ch", "y", "x", "y - _y AS _sy", "x - _x AS _sx")
    )
    placed = pixels.selectExpr("pair_id", "ch", "y AS _sy", "x AS _sx", "a", "b")
    return canvas.join(placed, ["pair_id", "ch", "_sy", "_sx"], "left").select(
        "pair_id", "ch", "y", "x", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b")
    )


def crop_pair(pixels: DataFrame, size: int, seed: int | None = None) -> DataFrame:
    """The same size x size window of both images; centred, or random under a seed."""

    def start(length: str, axis: str) -> Column:
        room = F.col(length) - size
        if seed is None:
            return G.half(room)
        return F.floor(uniform(F.col("pair_id"), seed, axis) * (room + 1)).cast("int")

    moved = pixels.withColumns(
        {"y": F.col("y") - start("frame_h", "y"), "x": F.col("x") - start("frame_w", "x")}
    )
    inside = (F.col("y") >= 0) & (F.col("y") < size) & (F.col("x") >= 0) & (F.col("x") < size)
    return moved.filter(inside)


# -- alignment on pixels -----------------------------------------------------------


def shift_pair(clean: DataFrame, noisy: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pixel correspondence of RGB pairs under their shift: (gt_id, f_id, ch, y, x, a, b).

    y, x count from the overlap's corner. `clean` and `noisy` are pixel tables with frame_h
    and frame_w on the clean side; `pairs` has gt_id, f_id, dy, dx.
    """
    rect = G.shift_rectangles(
        F.col("dy"), F.col("dx"), F.col("frame_h"), F.col("frame_w"), F.lit(False)
    )
    left = clean.selectExpr("image_id AS gt_id", "ch", "y", "x", "v AS a", "frame_h", "frame_w")
    anchored = (
        pairs.join(left, "gt_id")
        .withColumn("r", rect)
        .filter("y >= r.y0 AND y < r.y1 AND x >= r.x0 AND x < r.x1")
        .selectExpr("gt_id", "f_id", "ch", "y - r.y0 AS y", "x - r.x0 AS x", "y - dy AS fy", "x - dx AS fx", "a")
    )
    right = noisy.selectExpr("image_id AS f_id", "ch", "y AS fy", "x AS fx", "v AS b")
    return anchored.join(right, ["f_id", "ch", "fy", "fx"]).select("gt_id", "f_id", "ch", "y", "x", "a", "b")


def shift_mask(mask: DataFrame, pairs: DataFrame) -> DataFrame:
    """The clean side of `shift_pair` for a mask (image_id, y, x, valid, frame_h, frame_w)."""
    rect = G.shift_rectangles(
        F.col("dy"), F.col("dx"), F.col("frame_h"), F.col("frame_w"), F.lit(False)
    )
    return (
        pairs.join(mask.withColumnRenamed("image_id", "gt_id"), "gt_id")
        .withColumn("r", rect)
        .filter("y >= r.y0 AND y < r.y1 AND x >= r.x0 AND x < r.x1")
        .selectExpr("gt_id", "f_id", "y - r.y0 AS y", "x - r.x0 AS x", "valid")
    )
