"""Training samples, model application and per-image evaluation.

A sample row is (sample_id, c, h, w, x, yc, yh, yw, y, mask, gain, ...): the clean crop x
(channel-planar), the model input y and one mask flag per clean sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlake.functions import colour as C
from pairlake.functions import geometry as G
from pairlake.operators import kernels as K
from pairlake.operators.batches import map_rows
from pairlake.operators.frames import TILE, window_of

# Fixed value: bits per pixel of an uncompressed developed image.
PASSTHROUGH_BPP = 24.0


# -- metrics on arrays -------------------------------------------------------------


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)


def l1(a: Column, b: Column) -> Column:
    return _mean(F.zip_with(a, b, lambda p, q: F.abs(p - q)))


def mse(a: Column, b: Column) -> Column:
    return _mean(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)))


def psnr(error: Column, cap: float | None = None) -> Column:
    """Null for equal images, unless a cap stands in for their infinite ratio."""
    value = F.when(error > 0, F.lit(-10.0) * F.log10(error))
    return value if cap is None else F.least(F.coalesce(value, F.lit(cap)), F.lit(cap))


def masked(values: Column, mask: Column) -> Column:
    """Zero where the mask is false. Means still divide by all samples."""
    return F.zip_with(values, mask, lambda v, m: F.when(m, v).otherwise(0.0))


def bpp(encoded_bytes: Column, h: Column, w: Column) -> Column:
    return encoded_bytes * F.lit(8.0) / (h * w)



# -- samples -----------------------------------------------------------------------


def mask_rect(crops: DataFrame, compat: bool = False) -> DataFrame:
    """Rectangle of the full-resolution mask that a crop's clean side covers.

    Crop coordinates lie on the half-size planes, so they count twice; `compat` takes them
    as they are.
    """
    scale = 1 if compat else 2
    return crops.selectExpr("*", f"{scale} * y AS my", f"{scale} * x AS mx")


def crop_masks(crops: DataFrame, masks: DataFrame, keys: list[str], compat: bool = False, tile: int = TILE) -> DataFrame:
    """`crops` (keys, crop_id, y, x, h, w) with `mask`, an array of h x w flags, as `assemble_samples` reads it.

    `masks` are mask tiles (keys, ty, tx, y, x, h, w, mask of packed bits) in frame lines. A crop's
    window (`mask_rect`) counts from the first line and column of its mask; beyond the mask nothing
    is valid. A crop is sent the tiles that it touches, a number fixed by the two sizes.
    """
    kinds = dict(crops.dtypes)
    origin = masks.groupBy(*keys).agg(F.min("y").alias("_top"), F.min("x").alias("_left"))
    rects = mask_rect(crops, compat).join(origin, keys).selectExpr("*", "my + _top AS _y", "mx + _left AS _x")
    touched = rects.selectExpr(
        *keys, "crop_id", "_y", "_x", "h AS _h", "w AS _w",
        f"explode(sequence(CAST(_y div {tile} AS int), CAST((_y + h - 1) div {tile} AS int))) AS ty",
    ).selectExpr(
        "*", f"explode(sequence(CAST(_x div {tile} AS int), CAST((_x + _w - 1) div {tile} AS int))) AS tx"
    )
    met = touched.join(masks.select(*keys, "ty", "tx", "y", "x", "h", "w", "mask"), [*keys, "ty", "tx"], "left")
    part = F.expr("CASE WHEN mask IS NOT NULL THEN struct(y, x, h, w, mask AS bits) END")
    grouped = met.groupBy(*keys, "crop_id", "_y", "_x", "_h", "_w").agg(F.collect_list(part).alias("parts"))

    def run(r: SimpleNamespace) -> Iterator[tuple]:
        whole = np.zeros((r._h, r._w), bool)
        for p in r.parts:
            bits = np.unpackbits(np.frombuffer(p["bits"], np.uint8), count=p["h"] * p["w"]).reshape(p["h"], p["w"])
            top, left = p["y"] - r._y, p["x"] - r._x
            y0, x0, y1, x1 = max(top, 0), max(left, 0), min(top + p["h"], r._h), min(left + p["w"], r._w)
            if y0 < y1 and x0 < x1:
                whole[y0:y1, x0:x1] = bits[y0 - top : y1 - top, x0 - left : x1 - left]
        yield *[getattr(r, k) for k in keys], r.crop_id, whole.ravel()

    names = ", ".join(f"{k} {kinds[k]}" for k in [*keys, "crop_id"])
    return crops.join(map_rows(grouped, run, f"{names}, mask array<boolean>"), [*keys, "crop_id"])


def assemble_samples(crops: DataFrame, pairing: str = "x_y", match_gain: bool = True) -> DataFrame:
    """Sample rows from stored crops.

    `crops` has sample_id, h, w, gt_rgb, f_rgb (3 channels), in_c with gt_in, f_in (model
    input: 3 channels, or 4 half-size planes), mask (h x w), dy, dx, raw_gain and
    rgb_xyz_matrix. `x_y`: aligned clean and noisy with the mask window; `x_x` / `y_y`: clean
    or noisy on both sides, all valid. The gain is applied to y or reported.
    """
    bayer = F.col("in_c") == 4
    if pairing == "x_y":
        rect = G.shift_rectangles(F.col("dy"), F.col("dx"), F.col("h"), F.col("w"), bayer)
        cut = (
            crops.withColumn("r", rect)
            .withColumn("d", F.when(bayer, 2).otherwise(1))
            .selectExpr(
                "*", "r.y1 - r.y0 AS oh", "r.x1 - r.x0 AS ow", "r.ty1 - r.ty0 AS iy", "r.tx1 - r.tx0 AS ix",
                "CAST(h div d AS int) AS ih", "CAST(w div d AS int) AS iw",
            )
            .selectExpr(
                "sample_id", "3 AS c", "oh AS h", "ow AS w",
                f"{window_of('gt_rgb', '3', 'h', 'w', 'r.y0', 'r.x0', 'oh', 'ow')} AS x",
                "in_c AS yc", "iy AS yh", "ix AS yw",
                f"{window_of('f_in', 'in_c', 'ih', 'iw', 'r.ty0', 'r.tx0', 'iy', 'ix')} AS y",
                # One mask for all channels.
                f"flatten(array_repeat({window_of('mask', '1', 'h', 'w', '0', '0', 'oh', 'ow')}, 3)) AS mask",
                "raw_gain", "rgb_xyz_matrix",
            )
        )
    elif pairing in ("x_x", "y_y"):
        side = "gt" if pairing == "x_x" else "f"
        cut = crops.selectExpr(
            "sample_id", "3 AS c", "h", "w", f"{side}_rgb AS x", "in_c AS yc",
            "CAST(CASE WHEN in_c = 4 THEN h div 2 ELSE h END AS int) AS yh",
            "CAST(CASE WHEN in_c = 4 THEN w div 2 ELSE w END AS int) AS yw",
            f"{side}_in AS y", "array_repeat(true, 3 * h * w) AS mask", "raw_gain", "rgb_xyz_matrix",
        )
    else:
        raise ValueError(f"unknown pairing {pairing!r}")
    if match_gain:
        scaled = F.transform("y", lambda v: v * F.col("raw_gain"))
        return cut.withColumns({"y": scaled, "gain": F.lit(1.0)}).drop("raw_gain")
    return cut.withColumnRenamed("raw_gain", "gain")


# -- models ------------------------------------------------------------------------


def apply_model(samples: DataFrame, load: Callable[[], Callable] | None = None) -> DataFrame:
    """Run a caller's predictor over sample rows: (sample_id, out, bpp).

    `load()` is called once per task and returns predict(y, row) -> (array, bpp or None),
    y shaped (c, h, w). Without one, y passes through unchanged.
    """
    if load is None:
        return samples.select("sample_id", F.col("y").alias("out"), F.lit(None).cast("double").alias("bpp"))
    kind = dict(samples.dtypes)["sample_id"]

    def setup() -> Callable:
        predict = load()

        def run(r: SimpleNamespace) -> Iterator[tuple]:
            y = np.asarray(r.y, dtype=np.float64).reshape(r.yc, r.yh, r.yw)
            out, rate = predict(y, r)
            yield r.sample_id, np.asarray(out, dtype=np.float64).ravel(), rate

        return run

    wanted = samples.select("sample_id", "yc", "yh", "yw", "y")
    return map_rows(wanted, setup, f"sample_id {kind}, out array<double>, bpp double", per_task=True)


def match_output(samples: DataFrame, column: str, gain: bool, profile: str = "lin_rec2020") -> DataFrame:
    """Camera RGB arrays to the clean side's profile: optional gain, matrix, gain again."""
    kind = dict(samples.dtypes)["sample_id"]

    def run(r: SimpleNamespace) -> Iterator[tuple]:
        shape = (r.c, r.h, r.w)
        clean = np.asarray(r.x, dtype=np.float64).reshape(shape) if gain else None
        out = K.match_output(np.asarray(r.out).reshape(shape), r.rgb_xyz_matrix, C.PROFILES[profile], clean)
        yield r.sample_id, out.ravel()

    wanted = samples.select("sample_id", "c", "h", "w", "x", F.col(column).alias("out"), "rgb_xyz_matrix")
    return map_rows(wanted, run, f"sample_id {kind}, out array<double>")


def evaluate(
    samples: DataFrame,
    load: Callable[[], Callable] | None = None,
    *,
    match: bool = False,
    colour: bool = False,
    transfer: str | None = None,
    post: Callable[[np.ndarray], np.ndarray] | None = None,
    metrics: tuple[str, ...] = ("mse", "l1"),
    loss: str = "mse",
    weight: float | None = None,
) -> DataFrame:
    """Run a predictor over samples and measure it: (sample_id, metric, value).

    Model and metrics share one pass over the sample arrays, so outputs are neither stored
    nor shuffled. `match` scales outputs to the clean side, `colour` applies the camera
    matrix. A curve goes over both sides; `post` (a per-image development, as the clean side
    has already had) replaces it on the output. Masked samples count as zero
    on both sides. With a rate, bpp is added, and with `weight` also
    `combined` = bpp + weight * loss.
    """
    kind = dict(samples.dtypes)["sample_id"]
    names = [*dict.fromkeys([*metrics, loss])]
    curve = K.TRANSFERS[transfer]
    measures = {n: K.METRICS[n] for n in names}

    def setup() -> Callable:
        predict = load() if load else (lambda y, row: (y, None))

        def run(r: SimpleNamespace) -> Iterator[tuple]:
            y = np.asarray(r.y, dtype=np.float64).reshape(r.yc, r.yh, r.yw)
            clean = np.asarray(r.x, dtype=np.float64).reshape(r.c, r.h, r.w)
            out, rate = predict(y, r)
            if colour:
                out = K.match_output(out, r.rgb_xyz_matrix, C.XYZ_TO_REC2020, clean if match else None)
            elif match:
                out = K.match_gain(clean, out)
            mask = np.asarray(r.mask, dtype=bool).reshape(clean.shape)
            if post is not None:
                out = post(out)
            else:
                out, clean = curve(out), curve(clean)
            a, b = np.where(mask, out, 0.0), np.where(mask, clean, 0.0)
            found = {n: fn(a, b) for n, fn in measures.items()}
            if rate is not None:
                found["bpp"] = rate
                if weight is not None and found[loss] is not None:
                    found["combined"] = rate + weight * found[loss]
            for name, value in found.items():
                if value is not None:
                    yield r.sample_id, name, float(value)

        return run

    return map_rows(samples, setup, f"sample_id {kind}, metric string, value double", per_task=True)


def pending_samples(samples: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Samples whose image has no recorded result; the recorded ones are reused as they are."""
    return samples.join(known.select(*keys).distinct(), keys, "left_anti")
