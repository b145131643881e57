"""Loss tiles of aligned pairs, their exact quantile and the pair's mask.

One kernel looks at both images of a pair: it writes, for each tile of the overlap, the loss
with a border of two lines, which clean samples are exposed, and a histogram of the loss by
its leading bits. Threshold and mask only read these tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlake.operators import kernels as K
from pairlake.operators.batches import map_rows
from pairlake.operators.frames import TILE
from pairlake.operators.skew import checked_broadcast
from pairlake.operators.windows import PAIR, pair_windows
from pairlake.session import checkpointed

# Mask threshold, kept quantile, display gamma.
LOSS_THRESHOLD = 0.4
KEEPERS_QUANTILE = 0.9999
GAMMA = 2.2
#: Lines that the opening looks at beyond a tile.
BORDER = 2
#: Leading bits of the first histogram, and bits that each further one adds.
BITS = 16
#: Values of a pair that are counted one by one.
COUNTED = 100_000


def prefix(values: np.ndarray, bits: int) -> np.ndarray:
    """Leading bits of doubles from 0 up, which order like the doubles."""
    # Adding 0.0 turns a negative zero, whose sign bit is set, into zero.
    return (values + 0.0).view(np.int64) >> (64 - bits)


def loss_tiles(aligned: DataFrame, tiles: DataFrame, bound: float | None, size: int = TILE) -> DataFrame:
    """Per (pair, tile) of the overlap: the rectangle (y, x, h, w), `loss`, `exposed` and the histogram.

    `aligned` has dy, dx and aligned_gain. `loss` has `BORDER` more lines on every side, NaN
    outside the overlap. `exposed` packs one bit per sample: below the overexposure `bound` in
    all channels, or, where `bound` is None, the bits in the clean tile's own `exposed`.
    """
    kind = dict(aligned.dtypes)["gt_id"]
    rows = aligned.select(*PAIR, "dy", "dx", "aligned_gain").filter("aligned_gain IS NOT NULL")
    seen = pair_windows(rows, tiles, BORDER, BORDER, size, () if bound is not None else ("exposed",))

    def run(r: SimpleNamespace) -> Iterator[tuple]:
        (top, bottom), (left, right) = K.overlap(r.dy, r.frame_h), K.overlap(r.dx, r.frame_w)
        y, x = max(r.y0, top), max(r.x0, left)
        h, w = min(r.y0 + r.h, bottom) - y, min(r.x0 + r.w, right) - x
        if h <= 0 or w <= 0:
            return
        around = y - BORDER, x - BORDER, h + 2 * BORDER, w + 2 * BORDER
        a = K.assemble(r.gt_parts, r.c, *around)
        b = K.assemble(r.f_parts, r.c, around[0] - r.dy, around[1] - r.dx, *around[2:])
        loss = np.abs(K.positive_gamma(a, GAMMA) - K.positive_gamma(b * r.aligned_gain, GAMMA)).sum(axis=0)
        ys, xs = np.arange(around[2]) + around[0], np.arange(around[3]) + around[1]
        loss[(ys < top) | (ys >= bottom), :] = np.nan
        loss[:, (xs < left) | (xs >= right)] = np.nan
        inner = np.s_[BORDER:-BORDER, BORDER:-BORDER]
        if bound is None:
            bits = np.unpackbits(np.frombuffer(r.exposed, np.uint8), count=r.h * r.w).reshape(r.h, r.w)
            exposed = bits[y - r.y0 : y - r.y0 + h, x - r.x0 : x - r.x0 + w]
        else:
            exposed = (a < bound).all(axis=0)[inner]
        buckets, counts = np.unique(prefix(loss[inner].ravel(), BITS), return_counts=True)
        yield (
            r.gt_id, r.f_id, r.ty, r.tx, y, x, h, w, loss.ravel(), np.packbits(exposed).tobytes(), buckets, counts
        )

    return map_rows(
        seen,
        run,
        f"gt_id {kind}, f_id {kind}, ty int, tx int, y int, x int, h int, w int, loss array<double>, exposed binary, "
        "buckets array<bigint>, counts array<bigint>",
    )


def loss_pixels(losses: DataFrame) -> DataFrame:
    """(gt_id, f_id, y, x, loss) of every sample of the overlap."""
    flat = losses.select(*PAIR, "y", "x", "h", "w", F.posexplode("loss").alias("at", "loss"))
    flat = flat.selectExpr(
        *PAIR, f"at div (w + {2 * BORDER}) - {BORDER} AS i", f"at % (w + {2 * BORDER}) - {BORDER} AS j", "y", "x", "h", "w", "loss"
    )
    inside = flat.filter("i >= 0 AND i < h AND j >= 0 AND j < w")
    return inside.selectExpr(*PAIR, "CAST(y + i AS int) AS y", "CAST(x + j AS int) AS x", "loss")


def _places(counts: DataFrame, quantile: float) -> DataFrame:
    """Per pair the buckets that hold the values right above and below the quantile's place.

    `counts` has (pair, bucket, n, value) and, after the first histogram, `total` values of the
    pair and how many lie `above` all its buckets.
    """
    down = Window.partitionBy(*PAIR).orderBy(F.desc("bucket"))
    reached = F.col("above") + F.sum("n").over(down)
    rows = counts.withColumn("reached", reached)
    # Places are counted from the top, from 0.
    place = (F.col("total") - 1) * (1 - quantile)
    rows = rows.withColumn("place", place)

    def bucket_at(rank):
        return F.max(F.when(F.col("reached") > rank, F.struct("bucket", "value", (F.col("reached") - F.col("n")).alias("above"))))

    found = rows.groupBy(*PAIR).agg(
        F.first("total").alias("total"),
        F.first("place").alias("place"),
        bucket_at(F.floor("place")).alias("upper"),
        bucket_at(F.ceil("place")).alias("lower"),
    )
    return found.select(*PAIR, "total", "place", "upper", "lower", F.col("upper.above").alias("above"))


def reject_threshold(losses: DataFrame, quantile: float = KEEPERS_QUANTILE, limit: float = LOSS_THRESHOLD) -> DataFrame:
    """(gt_id, f_id, threshold): min(limit, exact interpolated quantile of the pair's loss); 0 becomes 1.

    The quantile lies between two neighbouring values. Histograms over leading bits narrow
    both down; when few enough values share their buckets, these are counted one by one. A
    pair above the limit is settled by its first histogram. Rows hold one bucket each, so
    none grows with the image.
    """
    flat = losses.select(*PAIR, F.explode(F.arrays_zip("buckets", "counts")).alias("b"))
    counts = flat.groupBy(*PAIR, F.col("b.buckets").alias("bucket")).agg(F.sum("b.counts").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(*PAIR))
    counts = counts.withColumns({"total": whole, "above": F.lit(0), "value": F.lit(None).cast("double")})
    bits = BITS
    least = F.lit(int(prefix(np.array([limit]), BITS)[0]))
    places = checkpointed(_places(counts, quantile))
    beyond = F.col("lower.bucket") > least
    settled = places.filter(beyond).select(*PAIR, F.lit(limit).alias("threshold"))
    places = places.filter(~beyond)
    while bits < 64:
        narrowed = places.select(*PAIR, "total", "above", F.col("lower.bucket").alias("low"), F.col("upper.bucket").alias("high"))
        near = counts.join(narrowed.select(*PAIR, "low", "high"), PAIR).filter("bucket BETWEEN low AND high")
        most = near.groupBy(*PAIR).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
        if most is None:
            break
        bits, before = (64 if most <= COUNTED else bits + BITS), bits
        counts = checkpointed(_count_between(losses, narrowed, before, bits))
        places = checkpointed(_places(counts, quantile))
    low = F.col("lower.value")
    exact = low + (F.col("upper.value") - low) * (F.ceil("place") - F.col("place"))
    bounded = F.least(F.lit(limit), exact)
    found = places.select(*PAIR, F.when(bounded == 0, 1.0).otherwise(bounded).alias("threshold"))
    return settled.unionByName(found)


def _count_between(losses: DataFrame, narrowed: DataFrame, before: int, bits: int) -> DataFrame:
    """Histogram over `bits` leading bits of the values whose first `before` bits lie between low and high."""
    kind = dict(losses.dtypes)["gt_id"]
    rows = losses.select(*PAIR, "h", "w", "loss").join(checked_broadcast(narrowed), PAIR)

    def run(r: SimpleNamespace) -> Iterator[tuple]:
        loss = r.loss.reshape(r.h + 2 * BORDER, r.w + 2 * BORDER)[BORDER:-BORDER, BORDER:-BORDER].ravel()
        coarse = prefix(loss, before)
        values, n = np.unique(loss[(coarse >= r.low) & (coarse <= r.high)], return_counts=True)
        buckets, first = np.unique(prefix(values, bits), return_index=True)
        if len(buckets):
            for bucket, value, many in zip(buckets.tolist(), values[first].tolist(), np.add.reduceat(n, first).tolist()):
                yield r.gt_id, r.f_id, r.total, r.above, bucket, value, many

    ddl = f"gt_id {kind}, f_id {kind}, total bigint, above bigint, bucket bigint, value double, n bigint"
    found = map_rows(rows, run, ddl).groupBy(*PAIR, "total", "above", "bucket")
    return found.agg(F.min("value").alias("value"), F.sum("n").alias("n"))


def mask_tiles(losses: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(gt_id, f_id, ty, tx, y, x, h, w, mask, n_valid): a packed bit per sample of the overlap.

    Valid: loss below the threshold after a binary opening, and exposed.
    """
    kind = dict(losses.dtypes)["gt_id"]
    rows = losses.drop("buckets", "counts").join(checked_broadcast(thresholds), PAIR)

    def run(r: SimpleNamespace) -> Iterator[tuple]:
        loss = r.loss.reshape(r.h + 2 * BORDER, r.w + 2 * BORDER)
        good = K.cross_opening(np.where(np.isnan(loss), np.inf, loss) < r.threshold)[BORDER:-BORDER, BORDER:-BORDER]
        exposed = np.unpackbits(np.frombuffer(r.exposed, np.uint8), count=r.h * r.w).reshape(r.h, r.w)
        valid = good & (exposed > 0)
        yield r.gt_id, r.f_id, r.ty, r.tx, r.y, r.x, r.h, r.w, np.packbits(valid).tobytes(), int(valid.sum())

    ddl = f"gt_id {kind}, f_id {kind}, ty int, tx int, y int, x int, h int, w int, mask binary, n_valid bigint"
    return map_rows(rows, run, ddl)


def exposure_tiles(tiles: DataFrame, bound: float) -> DataFrame:
    """(image_id, ty, tx, y, x, h, w, mask): a packed bit per sample, set below `bound` in all channels."""
    kind = dict(tiles.dtypes)["image_id"]

    def run(r: SimpleNamespace) -> Iterator[tuple]:
        lit = (r.data.reshape(r.c, -1) < bound).all(axis=0)
        yield r.image_id, r.ty, r.tx, r.y0, r.x0, r.h, r.w, np.packbits(lit).tobytes()

    ddl = f"image_id {kind}, ty int, tx int, y int, x int, h int, w int, mask binary"
    return map_rows(tiles.select("image_id", "c", "ty", "tx", "y0", "x0", "h", "w", "data"), run, ddl)


def mask_pixels(masks: DataFrame) -> DataFrame:
    """(gt_id, f_id, y, x, valid) of every sample of the overlap."""
    byte = F.expr("conv(hex(substring(mask, at div 8 + 1, 1)), 16, 10)").cast("int")
    flat = masks.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)))
    valid = byte.bitwiseAND(F.expr("shiftright(128, at % 8)")) > 0
    return flat.select(
        *PAIR,
        F.expr("CAST(y + at div w AS int)").alias("y"),
        F.expr("CAST(x + at % w AS int)").alias("x"),
        valid.alias("valid"),
    )


def mask_means(masks: DataFrame) -> DataFrame:
    """Share of valid samples of each pair."""
    area = F.col("h") * F.col("w")
    return masks.groupBy(*PAIR).agg((F.sum("n_valid") / F.sum(area)).alias("mask_mean"))


def pair_masks(aligned: DataFrame, tiles: DataFrame, bound: float | None, size: int = TILE) -> DataFrame:
    """Mask tiles of aligned pairs, as a written table."""
    losses = checkpointed(loss_tiles(aligned, tiles, bound, size))
    return checkpointed(mask_tiles(losses, reject_threshold(losses)))
