"""Which stored crop of an image a training sample comes from, and where in it.

The valid share of a rectangle is four lookups in a summed-area table. Each mask tile keeps
its own sums and three carried edges: the sums of the tiles to its left (one number a line),
of those above (one a column) and of those above to the left (one). Only edges travel between
tiles; rectangles ask the tiles that hold their corners.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlake.operators.batches import map_rows
from pairlake.operators.crops import MAX_RETRIES, MIN_VALID, uniform
from pairlake.operators.frames import TILE
from pairlake.session import checkpointed


def mask_areas(masks: DataFrame, keys: list[str]) -> DataFrame:
    """Summed areas of mask tiles (keys, ty, tx, y, x, h, w, mask of packed bits): `own`, `left`, `above`, `corner`."""
    kinds = dict(masks.dtypes)
    names = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def run(r: SimpleNamespace) -> Iterator[tuple]:
        bits = np.unpackbits(np.frombuffer(r.mask, np.uint8), count=r.h * r.w).reshape(r.h, r.w)
        own = bits.cumsum(0, dtype=np.int64).cumsum(1)
        yield (
            *[getattr(r, k) for k in keys], r.ty, r.tx, r.y, r.x, r.h, r.w, own.ravel(), own[:, -1], own[-1], int(own[-1, -1])
        )

    ddl = "ty int, tx int, y int, x int, h int, w int, own array<bigint>, lines array<bigint>, columns array<bigint>, total bigint"
    sums = checkpointed(map_rows(masks.select(*keys, "ty", "tx", "y", "x", "h", "w", "mask"), run, f"{names}, {ddl}"))
    place = [*keys, "ty", "tx"]

    def carried(edge: str, name: str, across: str, along: str) -> DataFrame:
        """Running sums of an edge over the tiles before, put back into one array per tile."""
        before = Window.partitionBy(*keys, across, "at").orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
        rows = sums.select(*place, F.posexplode(edge).alias("at", "v"))
        rows = rows.withColumn("v", F.coalesce(F.sum("v").over(before), F.lit(0)))
        listed = F.sort_array(F.collect_list(F.struct("at", "v")))
        return rows.groupBy(*place).agg(F.transform(listed, lambda e: e["v"]).alias(name))

    to_left = Window.partitionBy(*keys, "ty").orderBy("tx").rowsBetween(Window.unboundedPreceding, -1)
    upwards = Window.partitionBy(*keys, "tx").orderBy("ty").rowsBetween(Window.unboundedPreceding, -1)
    corner = sums.select(*place, F.coalesce(F.sum("total").over(to_left), F.lit(0)).alias("v"))
    corner = corner.select(*place, F.coalesce(F.sum("v").over(upwards), F.lit(0)).alias("corner"))
    whole = sums.select(*place, "y", "x", "h", "w", "own")
    for edge in (carried("lines", "left", "ty", "tx"), carried("columns", "above", "tx", "ty"), corner):
        whole = whole.join(edge, place)
    return whole


def valid_samples(rectangles: DataFrame, areas: DataFrame, keys: list[str], size: int = TILE) -> DataFrame:
    """`rectangles` (keys, y0, x0, y1, x1 in frame lines, and what names them) with `valid`, the samples valid inside.

    `valid` is null where a rectangle reaches beyond the mask.
    """
    origin = areas.groupBy(*keys).agg(F.min("y").alias("_top"), F.min("x").alias("_left"))
    names = rectangles.columns
    corners = F.expr(
        "array("
        + ", ".join(
            f"struct({sign} AS sign, {y} - 1 AS _y, {x} - 1 AS _x)"
            for sign, y, x in ((1, "y1", "x1"), (-1, "y0", "x1"), (-1, "y1", "x0"), (1, "y0", "x0"))
        )
        + ")"
    )
    inside = "y0 >= _top AND x0 >= _left"
    # A corner before the mask's first line or column counts nothing.
    asked = rectangles.join(origin, keys).filter(inside).withColumn("_c", F.explode(corners))
    asked = asked.select(*names, "_top", "_left", "_c.*").withColumn("_none", F.expr("_y < _top OR _x < _left"))
    asked = asked.withColumns({"ty": F.expr(f"CAST(_y div {size} AS int)"), "tx": F.expr(f"CAST(_x div {size} AS int)")})
    tiles = areas.withColumnsRenamed({"y": "_ty0", "x": "_tx0"})
    met = asked.join(tiles, [*keys, "ty", "tx"], "left")
    held = "_y < _ty0 + h AND _x < _tx0 + w"
    value = (
        f"CASE WHEN _none THEN 0 WHEN {held} THEN sign * (own[CAST((_y - _ty0) * w + _x - _tx0 AS int)] "
        "+ left[CAST(_y - _ty0 AS int)] + above[CAST(_x - _tx0 AS int)] + corner) END"
    )
    met = met.withColumn("_v", F.expr(value))
    return met.groupBy(*names).agg(F.expr("CASE WHEN count(_v) = 4 THEN sum(_v) END").alias("valid"))


def crop_draws(
    crops: DataFrame, keys: list[str], n: int, size: int, seed: int, retries: int = MAX_RETRIES
) -> DataFrame:
    """Where each stored crop (keys, crop_id, y, x, h, w) would be tried: `n` samples, each with 1 + `retries` attempts.

    `turn` numbers the crops of an image in the order of its own draw; positions are even.
    A crop without room for a sample has a turn and no attempt.
    """
    key = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])

    def drawn(*salts: Column | object) -> Column:
        return uniform(key, seed, F.col("crop_id").cast("string"), *salts)

    order = Window.partitionBy(*keys).orderBy(drawn("turn"), "crop_id")
    turns = crops.withColumn("turn", F.row_number().over(order) - 1)
    room = turns.filter((F.col("h") > size) & (F.col("w") > size))
    tried = room.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    tried = tried.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(retries))))

    def start(axis: str, length: str) -> Column:
        at = F.floor(drawn(F.col("sample").cast("string"), F.col("attempt").cast("string"), axis) * (F.col(length) - size))
        return (F.col(axis) + at - at % 2).cast("int")

    return tried.select(*keys, "crop_id", "turn", "sample", "attempt", start("y", "h").alias("y0"), start("x", "w").alias("x0"))


def choose_crops(
    crops: DataFrame,
    masks: DataFrame,
    keys: list[str],
    n: int,
    size: int,
    seed: int,
    min_valid: float = MIN_VALID,
    retries: int = MAX_RETRIES,
    tile: int = TILE,
) -> DataFrame:
    """(keys, crop_id, turn, sample, attempt, y0, x0): the samples of each image's first usable crop.

    An image tries its stored crops in the order of its draw. A crop is usable if each of its
    `n` samples has an attempt whose rectangle is valid in at least `min_valid` of its pixels;
    the first such attempt is taken. Images without a usable crop drop out. Positions are
    frame lines, as those of the mask.
    """
    draws = crop_draws(crops, keys, n, size, seed, retries)
    rectangles = draws.selectExpr("*", f"y0 + {size} AS y1", f"x0 + {size} AS x1")
    judged = valid_samples(rectangles, checkpointed(mask_areas(masks, keys)), keys, tile)
    good = judged.filter(F.col("valid") >= min_valid * size * size)
    firsts = good.groupBy(*keys, "turn", "crop_id", "sample").agg(F.min(F.struct("attempt", "y0", "x0")).alias("p"))
    # A crop's samples and an image's crops are few: the draw's size and the stored crops of one image.
    usable = firsts.groupBy(*keys, "turn", "crop_id").agg(F.collect_list(F.struct("sample", "p")).alias("samples"))
    first = usable.filter(F.size("samples") == n).groupBy(*keys).agg(F.min(F.struct("turn", "crop_id", "samples")).alias("c"))
    return first.select(*keys, "c.crop_id", "c.turn", F.explode("c.samples").alias("s")).select(
        *keys, "crop_id", "turn", "s.sample", "s.p.*"
    )


def middle_crop(crops: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The crop that validation looks at: the middle one of an image's ordered crops, if it has room for
    `size`, else that of the crops left without it, and so on; with the centred even position (y0, x0).
    """
    listed = crops.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("x", "y", "crop_id", "h", "w"))).alias("crops"))
    ends = F.aggregate(
        F.sequence(F.lit(1), F.size("crops")),
        F.col("crops"),
        lambda left, _: F.when(_fits(left, size), left).otherwise(
            F.concat(F.slice(left, F.lit(1), _middle(left)), F.slice(left, _middle(left) + 2, F.size(left)))
        ),
    )
    found = listed.select(*keys, ends.alias("left")).filter(F.size("left") > 0)
    found = found.select(*keys, F.get("left", _middle(F.col("left"))).alias("c"))
    even = "c.{0} + ({1} div 2 - {2} div 2) - pmod({1} div 2 - {2} div 2, 2)"
    return found.selectExpr(
        *keys,
        "c.crop_id",
        f"CAST({even.format('y', 'c.h', size)} AS int) AS y0",
        f"CAST({even.format('x', 'c.w', size)} AS int) AS x0",
    )


def _middle(crops: Column) -> Column:
    """Place, from 0, of the middle crop."""
    return F.floor(F.size(crops) / 2).cast("int")


def _fits(crops: Column, size: int) -> Column:
    middle = F.get(crops, _middle(crops))
    return (F.size(crops) == 0) | ((middle["h"] >= size) & (middle["w"] >= size))
