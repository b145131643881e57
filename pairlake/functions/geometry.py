"""Rectangles and index arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _i(value: int) -> Column:
    return F.lit(value).cast("int")


def floor_to(value: Column, multiple: int) -> Column:
    return (value - value % multiple).cast("int")


def half(value: Column) -> Column:
    """Integer half of a non-negative length."""
    return F.floor(value / F.lit(2)).cast("int")


# -- alignment ---------------------------------------------------------------------


def _axis(shift: Column, length: Column) -> tuple[Column, Column]:
    """First and end line of the anchor that overlap the target under `shift`.

    An odd shift loses one more line on the side the overlap ends (positive) or begins
    (negative), so that both sides keep a mosaic-compatible size.
    """
    odd = (F.abs(shift) % 2).cast("int")
    start = F.when(shift > 0, shift).otherwise(F.when(shift < 0, odd).otherwise(0))
    end = length - F.when(shift > 0, odd).otherwise(-shift)
    return start.cast("int"), end.cast("int")


def shift_rectangles(dy: Column, dx: Column, height: Column, width: Column, bayer: Column) -> Column:
    """Overlapping rectangles of an anchor RGB image and its target under a shift.

    `height` and `width` are the anchor's. A Bayer target is addressed on its planes of
    half the size.
    """
    divisor = F.when(bayer, 2).otherwise(1)

    def target(shift: Column, start: Column, end: Column) -> tuple[Column, Column]:
        skipped = F.when(shift < 0, F.floor(-shift / divisor) + F.abs(shift) % 2).otherwise(0)
        size = F.floor((end - start) / divisor)
        # A trimmed line is one line of planes, two of the mosaic.
        return skipped.cast("int"), (skipped + size).cast("int")

    def anchor(shift: Column, length: Column) -> tuple[Column, Column]:
        return _axis(shift, length)

    y0, y1 = anchor(dy, height)
    x0, x1 = anchor(dx, width)
    ty0, ty1 = target(dy, y0, y1)
    tx0, tx1 = target(dx, x0, x1)
    return F.struct(
        y0.alias("y0"), y1.alias("y1"), x0.alias("x0"), x1.alias("x1"),
        ty0.alias("ty0"), ty1.alias("ty1"), tx0.alias("tx0"), tx1.alias("tx1"),
    )


# -- sensor area -------------------------------------------------------------------


def usable_rect(sizes: Column, pattern: Column) -> Column:
    """Area of a raw frame left after margins, declared sizes, RGGB phase and multiples of 4.

    `sizes` has raw_height, raw_width, height, width, iheight, iwidth, top_margin,
    left_margin. `pattern` names the four colours at the raw frame's origin. The result
    has y, x, h, w on the raw frame.
    """
    top, left = sizes["top_margin"], sizes["left_margin"]

    def colour(dy: int, dx: int) -> Column:
        position = (top + dy) % 2 * 2 + (left + dx) % 2 + 1
        return F.substring(pattern, position, _i(1))

    phase = F.concat(colour(0, 0), colour(0, 1), colour(1, 0), colour(1, 1))
    known = phase.isin("RGGB", "GBRG", "BGGR", "GRBG")
    row_cut = F.when(phase.isin("GBRG", "BGGR"), 1).otherwise(0)
    column_cut = F.when(phase.isin("GRBG", "BGGR"), 1).otherwise(0)
    h = F.least(sizes["raw_height"] - top, sizes["height"], sizes["iheight"]) - 2 * row_cut
    w = F.least(sizes["raw_width"] - left, sizes["width"], sizes["iwidth"]) - 2 * column_cut
    rect = F.struct(
        (top + row_cut).cast("int").alias("y"),
        (left + column_cut).cast("int").alias("x"),
        floor_to(h, 4).alias("h"),
        floor_to(w, 4).alias("w"),
    )
    return F.when(known, rect).otherwise(
        F.raise_error(F.concat(F.lit("unsupported mosaic "), phase))
    )


def plane_of(y: Column, x: Column) -> tuple[Column, Column, Column]:
    """RGGB mosaic position to (plane, row, column)."""
    return ((y % 2) * 2 + x % 2).cast("int"), half(y), half(x)


def mosaic_of(plane: Column, y: Column, x: Column) -> tuple[Column, Column]:
    return (2 * y + half(plane)).cast("int"), (2 * x + plane % 2).cast("int")


# -- crops -------------------------------------------------------------------------


def centre_start(length: Column, size: int) -> Column:
    """Even start of a centred window."""
    start = half(length) - size // 2
    return (start - F.pmod(start, F.lit(2))).cast("int")


def pad_before(length: Column, size: int) -> Column:
    return F.greatest(_i(0), F.floor((F.lit(size) - length) / F.lit(2)).cast("int"))
