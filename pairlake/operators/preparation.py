"""Pair preparation: gain, alignment and similarity over tiled images.

`pairs` has gt_id and f_id. Work is keyed by (pair, tile); kernels emit sums per tile,
which Spark adds up per pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlake.operators import kernels as K
from pairlake.operators.batches import map_batches, map_rows
from pairlake.operators.frames import TILE, image_sums, with_halo
from pairlake.operators.masks import mask_means, pair_masks
from pairlake.operators.skew import salted_join
from pairlake.operators.windows import PAIR, pair_windows, shared_images, with_frames
from pairlake.session import checkpointed

# Search window and limit.
SEARCH_WINDOW = 3
MAX_SHIFT = 128
#: Samples times shifts of a tile that are compared in one go.
SMALL = 200_000


def gain(pairs: DataFrame, tiles: DataFrame, name: str = "gain") -> DataFrame:
    """mean(clean) / mean(other) per pair, over all channels and pixels."""
    means = image_sums(tiles).select("image_id", (F.col("total") / F.col("n")).alias("mean"))
    clean = means.withColumnsRenamed({"image_id": "gt_id", "mean": "_gt_mean"})
    other = means.withColumnsRenamed({"image_id": "f_id", "mean": "_f_mean"})
    both = salted_join(pairs, clean, ["gt_id"], spread=["f_id"]).join(other, "f_id")
    return both.withColumn(name, F.try_divide("_gt_mean", "_f_mean")).select(*pairs.columns, name)


# -- alignment ---------------------------------------------------------------------

_SHIFT_SUMS = "gt_id {t}, f_id {t}, dy int, dx int, l1 double, n bigint, gt_sum double, f_sum double"


def _shift_sums(rows: Iterable[SimpleNamespace], shifts: Callable[[SimpleNamespace], np.ndarray]) -> Iterator[tuple]:
    """Sums of |clean - gain * other| of tiles for each of their shifts, as columns."""
    alike: dict[tuple, list] = {}
    for r in rows:
        wanted = shifts(r)
        if not len(wanted):
            continue
        low, high = wanted.min(axis=0), wanted.max(axis=0)
        if r.c * r.h * r.w * len(wanted) > SMALL:
            yield from _large_sums(r, wanted, low, high)
            continue
        # Small tiles of one size, with windows of one size, are compared together.
        key = r.c, r.h, r.w, *(high - low + 1).tolist()
        held = alike.setdefault(key, [])
        held.append((r, wanted, high))
        if len(held) * math.prod(key) > SMALL:
            yield _small_sums(key, alike.pop(key))
    for key, held in alike.items():
        yield _small_sums(key, held)


def _large_sums(r: SimpleNamespace, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple]:
    top_most, left_most = high.tolist()
    more_h, more_w = (high - low).tolist()
    clean = K.assemble(r.gt_parts, r.c, r.y0, r.x0, r.h, r.w)
    around = K.assemble(r.f_parts, r.c, r.y0 - top_most, r.x0 - left_most, r.h + more_h, r.w + more_w)
    matched = r.gain * around
    for dy, dx in wanted.tolist():
        top, bottom = K.overlap(dy, r.frame_h)
        left, right = K.overlap(dx, r.frame_w)
        ya, yb = max(top - r.y0, 0), min(bottom - r.y0, r.h)
        xa, xb = max(left - r.x0, 0), min(right - r.x0, r.w)
        if ya < yb and xa < xb:
            mine = clean[:, ya:yb, xa:xb]
            cut = np.s_[:, ya - dy + top_most : yb - dy + top_most, xa - dx + left_most : xb - dx + left_most]
            l1 = float(np.abs(mine - matched[cut]).sum())
            sums = l1, mine.size, float(mine.sum()), float(around[cut].sum())
            yield tuple([value] for value in (r.gt_id, r.f_id, dy, dx, *sums))


def _seen(shift: np.ndarray, start: np.ndarray, count: int, frame: np.ndarray) -> np.ndarray:
    """Which of the lines from `start` lie in the overlap (`K.overlap`) under each shift: (row, shift, line)."""
    odd = np.abs(shift) % 2
    first = np.where(shift > 0, shift, odd)
    end = frame[:, None] + np.where(shift > 0, -odd, shift)
    at = (start[:, None] + np.arange(count))[:, None]
    return (at >= first[:, :, None]) & (at < end[:, :, None])


def _small_sums(key: tuple, held: list[tuple]) -> tuple:
    """The same for small tiles, all shifts of the boxes around theirs at once."""
    c, h, w, box_h, box_w = key
    n = len(held)
    clean, around = np.empty((n, c, h, w)), np.empty((n, c, h + box_h - 1, w + box_w - 1))
    for i, (r, _, high) in enumerate(held):
        clean[i] = K.assemble(r.gt_parts, c, r.y0, r.x0, h, w)
        around[i] = K.assemble(r.f_parts, c, r.y0 - int(high[0]), r.x0 - int(high[1]), *around.shape[2:])
    place = np.array([(r.y0, r.x0, r.frame_h, r.frame_w, *high) for r, _, high in held], np.int64)
    y0, x0, frame_h, frame_w, top, left = place.T
    matched = np.array([r.gain for r, _, _ in held])[:, None, None, None] * around
    # Window i, k shows the other image moved by (top - i, left - k).
    views = [np.lib.stride_tricks.sliding_window_view(a, (h, w), axis=(2, 3)) for a in (around, matched)]
    dy, dx = top[:, None] - np.arange(box_h), left[:, None] - np.arange(box_w)
    seen = _seen(dy, y0, h, frame_h)[:, :, None, :, None] & _seen(dx, x0, w, frame_w)[:, None, :, None, :]
    l1 = np.where(seen, np.abs(clean[:, :, None, None] - views[1]).sum(axis=1), 0).sum(axis=(3, 4))
    other = np.where(seen, views[0].sum(axis=1), 0).sum(axis=(3, 4))
    mine = np.where(seen, clean.sum(axis=1)[:, None, None], 0).sum(axis=(3, 4))
    count = c * seen.sum(axis=(3, 4))
    asked = np.zeros(count.shape, bool)
    for i, (_, wanted, high) in enumerate(held):
        asked[(i, *(high - wanted).T)] = True
    row, i, k = at = np.nonzero(asked & (count > 0))
    gt, f = (pa.array([getattr(r, name) for r, _, _ in held]).take(pa.array(row)) for name in PAIR)
    return gt, f, dy[row, i], dx[row, k], l1[at], count[at], mine[at], other[at]


def shift_losses(tiled: DataFrame, shifts: Callable[[SimpleNamespace], np.ndarray]) -> DataFrame:
    """Mean L1 per (pair, shift). `tiled` is a `pair_windows` table with `gain`; `shifts(row)`
    has the shifts (dy, dx) of a row, all within its windows."""
    kind = dict(tiled.dtypes)["gt_id"]
    per_tile = map_batches(tiled, lambda rows: _shift_sums(rows, shifts), _SHIFT_SUMS.format(t=kind))
    return per_tile.groupBy(*PAIR, "dy", "dx").agg(
        F.expr("sum(l1) / sum(n)").alias("loss"), F.expr("try_divide(sum(gt_sum), sum(f_sum))").alias("aligned_gain")
    )


def _window(reach: int) -> np.ndarray:
    offsets = range(-reach, reach + 1)
    return np.array([(y, x) for y in offsets for x in offsets])


_AROUND = _window(SEARCH_WINDOW)


def _fresh(r: SimpleNamespace) -> np.ndarray:
    """The neighbourhood of the current shift, without that of the previous one, which holds nothing better."""
    around = _AROUND + (r.dy, r.dx)
    if r.py is None:
        return around
    return around[np.abs(around - (r.py, r.px)).max(axis=1) > SEARCH_WINDOW]


def _best_shift(losses: DataFrame, near_first: bool) -> DataFrame:
    """Least loss per pair as `b`, ties to the earlier shift (the smaller one before, if asked).
    The aligned overlap's own gain comes along."""
    far = "abs(dy) + abs(dx)" if near_first else "0"
    order = f"struct(round(loss, 9) AS r, {far} AS far, dy, dx, loss, aligned_gain)"
    return losses.groupBy(*PAIR).agg(F.expr(f"min({order})").alias("b"))


def align_exhaustive(pairs: DataFrame, tiles: DataFrame, reach: int, size: int = TILE) -> DataFrame:
    """Best shift among all with |dy|, |dx| <= reach, after matching the gain.

    `on_edge` marks pairs whose best shift lies on the border of the window: a better one
    may lie outside, which a wider window or `align` finds.
    """
    # One row per pair; used three times below. Pairs without a gain have nothing to align.
    gained = checkpointed(gain(pairs.select(*PAIR), tiles).filter("gain IS NOT NULL"))
    still = gained.withColumns({"dy": F.lit(0), "dx": F.lit(0)})
    window = _window(reach)
    tiled = pair_windows(still, tiles, 0, reach, size)
    best = _best_shift(shift_losses(tiled, lambda r: window), near_first=True)
    found = best.selectExpr(
        *PAIR, "b.dy", "b.dx", "b.loss AS best_alignment_loss", "b.aligned_gain",
        f"greatest(abs(b.dy), abs(b.dx)) = {reach} AS on_edge",
    )
    return gained.withColumnRenamed("gain", "rgb_gain").join(found, PAIR)


def align(
    pairs: DataFrame,
    tiles: DataFrame,
    size: int = TILE,
    max_shift: int = MAX_SHIFT,
) -> DataFrame:
    """Local search: from (0, 0) move to the best shift of the 7x7 neighbourhood until none
    is better, the loss is 0 or |dy| + |dx| reaches `max_shift`.

    All pairs advance together. A round moves only the windows of pairs still moving, at
    their shifts. Pairs without a gain have nothing to align and are left out. The current shift is the best of all seen,
    so an older shift can never win later and the state is one row per pair, checkpointed
    after each round. A moving pair's loss falls strictly, so the rounds end by themselves.
    """
    gained = with_frames(gain(pairs.select(*PAIR), tiles).filter("gain IS NOT NULL"), tiles)
    gained = checkpointed(gained)
    shared = shared_images(gained, size)
    still = gained.withColumns({"dy": F.lit(0), "dx": F.lit(0)})
    still_at = _window(0)
    tiled = pair_windows(still, tiles, 0, 0, size, salted=False, shared=shared)
    start = shift_losses(tiled, lambda r: still_at)
    none = "CAST(NULL AS int)"
    state = checkpointed(
        gained.join(start, PAIR).selectExpr("*", f"{none} AS py", f"{none} AS px", "loss > 0 AS moving")
    )
    while not state.filter("moving").isEmpty():
        tiled = pair_windows(state.filter("moving"), tiles, 0, SEARCH_WINDOW, size, salted=False, shared=shared)
        found = _best_shift(shift_losses(tiled, _fresh), near_first=False)
        better = "moving AND b.r < round(loss, 9)"
        stepped = state.join(found, PAIR, "left").withColumn("_moved", F.expr(f"coalesce({better}, false)"))
        state = checkpointed(
            stepped.selectExpr(
                *PAIR, "frame_h", "frame_w", "gain",
                *[f"IF(_moved, b.{n}, {n}) AS {n}" for n in ("dy", "dx", "loss", "aligned_gain")],
                "IF(_moved, dy, py) AS py", "IF(_moved, dx, px) AS px",
                f"_moved AND b.loss > 0 AND abs(b.dy) + abs(b.dx) < {max_shift} AS moving",
            )
        )
    return state.select(
        *PAIR, F.col("gain").alias("rgb_gain"), "dy", "dx", F.col("loss").alias("best_alignment_loss"),
        "aligned_gain", "moving",
    )


# -- preparation -------------------------------------------------------------------


def pair_mask(aligned: DataFrame, tiles: DataFrame, bound: float, size: int = TILE) -> DataFrame:
    """`mask_mean` of every aligned pair (dy, dx, aligned_gain from the alignment)."""
    aligned = checkpointed(aligned)
    return aligned.join(mask_means(pair_masks(aligned, tiles, bound, size)), PAIR)


def prepare_pairs(
    pairs: DataFrame, tiles: DataFrame, reach: int | None, bound: float, size: int = TILE
) -> DataFrame:
    """Gain, shift, alignment loss and mask mean of every pair.

    Without a `reach` the shift is searched until it converges (`align`). A `reach` clips the
    search to its window; then `on_edge` marks the pairs whose true shift may lie outside.
    """
    if reach is not None:
        return pair_mask(align_exhaustive(pairs, tiles, reach, size), tiles, bound, size)
    return pair_mask(align(pairs, tiles, size), tiles, bound, size)


def aligned_means(aligned: DataFrame, tiles: DataFrame, multiple: int = 32) -> DataFrame:
    """`gt_rgb_mean` per pair: mean of the clean image's overlap, cut to a multiple."""
    kind = dict(tiles.dtypes)["image_id"]
    rows = salted_join(
        aligned.select(*PAIR, "dy", "dx"), tiles.withColumnRenamed("image_id", "gt_id"), ["gt_id"], spread=["f_id"]
    )

    def run(r: SimpleNamespace) -> Iterator[tuple]:
        span = []
        for shift, frame, start, length in ((r.dy, r.frame_h, r.y0, r.h), (r.dx, r.frame_w, r.x0, r.w)):
            first, end = K.overlap(shift, frame)
            end -= (end - first) % multiple
            span.append((max(first - start, 0), min(end - start, length)))
        (top, bottom), (left, right) = span
        if top < bottom and left < right:
            part = np.asarray(r.data).reshape(r.c, r.h, r.w)[:, top:bottom, left:right]
            yield r.gt_id, r.f_id, float(part.sum()), part.size

    sums = map_rows(rows, run, f"gt_id {kind}, f_id {kind}, total double, n bigint")
    return sums.groupBy(*PAIR).agg((F.sum("total") / F.sum("n")).alias("gt_rgb_mean"))


# -- neighbourhood filters ---------------------------------------------------------


def _filtered(tiles: DataFrame, border: int, size: int, kernel: Callable) -> DataFrame:
    """Apply kernel(window, row) -> (c, h, w) to each tile with its border."""
    kind = dict(tiles.dtypes)["image_id"]

    def run(r: SimpleNamespace) -> Iterator[tuple]:
        y, x, h, w = r.y0 - border, r.x0 - border, r.h + 2 * border, r.w + 2 * border
        result = kernel(K.assemble(r.parts, r.c, y, x, h, w), r)
        yield (
            r.image_id, result.shape[0], r.frame_h, r.frame_w, r.ty, r.tx, r.y0, r.x0, r.h, r.w, result.ravel()
        )

    return map_rows(
        with_halo(tiles, border, size),
        run,
        f"image_id {kind}, c int, frame_h int, frame_w int, ty int, tx int, y0 int, x0 int, "
        "h int, w int, data array<double>",
    )


def demosaic_bilinear(tiles: DataFrame, size: int = TILE) -> DataFrame:
    """Camera RGB tiles from mono RGGB tiles (even tile size)."""
    return _filtered(
        tiles, 1, size, lambda window, r: K.demosaic_rggb(window[0], r.y0 - 1, r.x0 - 1)
    )


def sharpen(tiles: DataFrame, taps: int = 5, sigma: float = 1.0, size: int = TILE) -> DataFrame:
    """1.5 * samples - 0.5 * Gaussian blur; the border mirrors about the edge line."""
    border = taps // 2
    weights = K.gaussian(taps, sigma)

    def kernel(window: np.ndarray, r) -> np.ndarray:
        full = K.reflect_border(window, r.y0 - border, r.x0 - border, r.frame_h, r.frame_w)
        inside = full[:, border : border + r.h, border : border + r.w]
        return 1.5 * inside - 0.5 * K.blur_valid(full, weights)

    return _filtered(tiles, border, size, kernel)


def enhance_edges(tiles: DataFrame, alpha: float, size: int = TILE) -> DataFrame:
    """Add alpha * Laplacian of the blue channel to the luma of the clipped RGB image."""

    def kernel(window: np.ndarray, r) -> np.ndarray:
        full = K.reflect_border(window, r.y0 - 1, r.x0 - 1, r.frame_h, r.frame_w)
        b = full[2]
        laplacian = b[:-2, 1:-1] + b[2:, 1:-1] + b[1:-1, :-2] + b[1:-1, 2:] - 4 * b[1:-1, 1:-1]
        # Chroma is unchanged, so all channels move by as much as the luma.
        return np.clip(full[:, 1:-1, 1:-1], 0, 1) + alpha * laplacian

    return _filtered(tiles, 1, size, kernel)
