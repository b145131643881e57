"""Raw captures to full pair descriptors: gains, shift, loss and mask, and why a pair was rejected.

Images are tiles of a mosaic (one channel, RGGB) or of RGB, as `meta` says. Exposure is judged
on the mosaic, each clean image against its own bound; shift, loss and mask on camera RGB.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlake.operators import kernels as K
from pairlake.operators.batches import map_rows
from pairlake.operators.frames import TILE, TILE_COLUMNS, attach_meta, image_sums, with_halo
from pairlake.operators.masks import mask_means, pair_masks
from pairlake.operators.preparation import MAX_SHIFT, align
from pairlake.operators.skew import salted_join
from pairlake.operators.windows import PAIR
from pairlake.session import checkpointed


class Described(NamedTuple):
    """`pairs` has one row per pair, `reason` null where it was described; `masks` its packed mask tiles."""

    pairs: DataFrame
    masks: DataFrame

    @property
    def accepted(self) -> DataFrame:
        return self.pairs.filter("reason IS NULL").drop("reason")

    @property
    def rejected(self) -> DataFrame:
        return self.pairs.filter("reason IS NOT NULL").select(*PAIR, "reason")


def checked_pairs(pairs: DataFrame, tiles: DataFrame) -> DataFrame:
    """Pairs with `gain` and `reason`: why a pair cannot be compared, or null.

    Reasons, first to last: `missing clean`, `missing other`, `unequal frames` (size or number of
    channels), `not finite` (a sample of either), `black other` (no gain can match it).
    """
    facts = tiles.groupBy("image_id").agg(F.struct(*[F.first(n).alias(n) for n in ("c", "frame_h", "frame_w")]).alias("frame"))
    facts = facts.join(image_sums(tiles), "image_id").select("image_id", "frame", (F.col("total") / F.col("n")).alias("mean"))
    facts = checkpointed(facts)
    clean = facts.withColumnsRenamed({"image_id": "gt_id", "frame": "_gt_frame", "mean": "_gt_mean"})
    other = facts.withColumnsRenamed({"image_id": "f_id", "frame": "_f_frame", "mean": "_f_mean"})
    both = salted_join(pairs, clean, ["gt_id"], spread=["f_id"], how="left")
    both = salted_join(both, other, ["f_id"], spread=["gt_id"], how="left")
    odd = F.lit(False)
    for mean in ("_gt_mean", "_f_mean"):
        odd = odd | F.isnan(mean) | (F.abs(mean) == float("inf"))
    reason = (
        F.when(F.col("_gt_frame").isNull(), "missing clean")
        .when(F.col("_f_frame").isNull(), "missing other")
        .when(F.col("_gt_frame") != F.col("_f_frame"), "unequal frames")
        .when(odd, "not finite")
        .when(F.col("_f_mean") == 0, "black other")
    )
    found = both.withColumns({"gain": F.try_divide("_gt_mean", "_f_mean"), "reason": reason})
    return found.select(*pairs.columns, "gain", "reason")


def developed(tiles: DataFrame, meta: DataFrame, size: int = TILE) -> DataFrame:
    """Camera RGB tiles with `exposed`, a packed bit per sample: below the image's bound in all stored channels.

    `meta` has image_id, is_bayer and overexposure_lb. Mosaics are demosaiced; exposure is
    that of the mosaic. Images without meta count as RGB without a bound.
    """
    kind = dict(tiles.dtypes)["image_id"]
    ddl = f"image_id {kind}, c int, frame_h int, frame_w int, ty int, tx int, y0 int, x0 int, h int, w int, data array<double>, exposed binary"

    def run(r: SimpleNamespace) -> Iterator[tuple]:
        if r.is_bayer:
            around = K.assemble(r.parts, 1, r.y0 - 1, r.x0 - 1, r.h + 2, r.w + 2)
            stored, rgb = around[:, 1:-1, 1:-1], K.demosaic_rggb(around[0], r.y0 - 1, r.x0 - 1)
        else:
            stored = rgb = K.assemble(r.parts, r.c, r.y0, r.x0, r.h, r.w)
        bound = np.inf if r.overexposure_lb is None else r.overexposure_lb
        exposed = np.packbits((stored < bound).all(axis=0)).tobytes()
        yield (
            r.image_id, len(rgb), r.frame_h, r.frame_w, r.ty, r.tx, r.y0, r.x0, r.h, r.w, rgb.ravel(), exposed
        )

    known = attach_meta(tiles.select(*TILE_COLUMNS), meta, "is_bayer", "overexposure_lb")
    mosaic = F.coalesce(F.col("is_bayer"), F.lit(False)) & (F.col("c") == 1)
    names = ["image_id", "c", "frame_h", "frame_w", "ty", "tx", "y0", "x0", "h", "w", "parts"]
    # Only a mosaic needs lines of its neighbours.
    haloed = with_halo(known.filter(mosaic).select(*TILE_COLUMNS), 1, size)
    haloed = attach_meta(haloed, meta, "overexposure_lb").select(*names, "overexposure_lb", F.lit(True).alias("is_bayer"))
    plain = with_halo(known.filter(~mosaic).select(*TILE_COLUMNS), 0, size)
    plain = attach_meta(plain, meta, "overexposure_lb").select(*names, "overexposure_lb", F.lit(False).alias("is_bayer"))
    return map_rows(haloed, run, ddl).unionByName(map_rows(plain, run, ddl))


def describe_pairs(
    pairs: DataFrame, tiles: DataFrame, meta: DataFrame, size: int = TILE, max_shift: int = MAX_SHIFT
) -> Described:
    """Full descriptor of every pair (gt_id, f_id) of `pairs`, rejected pairs with their reason.

    `raw_gain` is taken on the stored samples (mosaics only), `rgb_gain` on unaligned camera
    RGB. The shift is searched until it converges. `mask_mean`, and the mask tiles, combine
    loss and exposure over the overlap. `meta` (image_id, is_bayer, overexposure_lb,
    rgb_xyz_matrix) describes the clean image's row.

    Writes tables to the checkpoint folder while it builds: one job for each step of the search.
    """
    checked = checkpointed(checked_pairs(pairs.select(*PAIR), tiles))
    rgb = checkpointed(developed(tiles, meta, size))
    found = align(checked.filter("reason IS NULL").select(*PAIR), rgb, size, max_shift)
    masks = pair_masks(found, rgb, None, size)
    about = meta.select(F.col("image_id").alias("gt_id"), "is_bayer", "overexposure_lb", "rgb_xyz_matrix")
    whole = checked.join(found, PAIR, "left").join(mask_means(masks), PAIR, "left").join(about, "gt_id", "left")
    is_bayer = F.coalesce(F.col("is_bayer"), F.lit(False))
    # A pair can lose its last light to the crop of the overlap, or to the demosaicing.
    late = F.when(F.col("mask_mean").isNull(), "black overlap")
    reason = F.coalesce("reason", late)
    good = reason.isNull()
    kept = ("dy", "dx", "best_alignment_loss", "mask_mean", "rgb_gain")
    described = whole.select(
        *PAIR,
        reason.alias("reason"),
        *[F.when(good, F.col(n)).alias(n) for n in kept],
        F.when(good & is_bayer, F.col("gain")).alias("raw_gain"),
        is_bayer.alias("is_bayer"),
        "overexposure_lb",
        F.when(is_bayer, F.col("rgb_xyz_matrix")).alias("rgb_xyz_matrix"),
    )
    return Described(checkpointed(described), masks)
