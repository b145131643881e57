"""Sample mathematics as Column expressions: scaling, white balance, matrices, transfer curves.

Every function takes and returns Columns, so it works on a pixel column as well as inside
`transform` over the samples of a tile.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display gamma.
GAMMA = 2.2
# ST 2084 constants, BT.709 and BT.1886 parameters of the PQ curve.
PQ_M1 = 2610 / 4096 / 4
PQ_M2 = 2523 / 4096 * 128
PQ_C1 = 3424 / 4096
PQ_C2 = 2413 / 4096 * 32
PQ_C3 = 2392 / 4096 * 32
PQ_SCALE = 59.5208
PQ_PEAK = 10000.0
BT709_LINEAR_END = 0.018
BT1886_GAMMA = 2.4
# XYZ to RGB matrices of the output profiles.
XYZ_TO_REC2020 = (
    (1.71666343, -0.35567332, -0.25336809),
    (-0.66667384, 1.61645574, 0.0157683),
    (0.01764248, -0.04277698, 0.94224328),
)
XYZ_TO_SRGB = (
    (3.24100326, -1.53739899, -0.49861587),
    (-0.96922426, 1.87592999, 0.04155422),
    (0.05563942, -0.2040112, 1.05714897),
)
PROFILES = {"lin_rec2020": XYZ_TO_REC2020, "lin_sRGB": XYZ_TO_SRGB, "gamma_sRGB": XYZ_TO_SRGB}
# Linear Rec.2020 to Rec.709 primaries (BT.2087).
REC2020_TO_REC709 = (
    (1.6605, -0.5876, -0.0728),
    (-0.1246, 1.1329, -0.0083),
    (-0.0182, -0.1006, 1.1187),
)
# Analogue YUV weights.
YUV_R, YUV_G, YUV_B = 0.299, 0.587, 0.114
YUV_U, YUV_V = 0.492, 0.877


def _d(value: float) -> Column:
    return F.lit(float(value))


# -- stored samples ----------------------------------------------------------------


def normalise_sample(value: Column, bits: Column) -> Column:
    """8-bit and 16-bit integers to [0, 1]; 32-bit floats unchanged; others fail."""
    return (
        F.when(bits == 8, value / _d(255))
        .when(bits == 16, value / _d(65535))
        .when(bits == 32, value)
        .otherwise(F.raise_error(F.concat(F.lit("unknown sample depth "), bits.cast("string"))))
    )


# -- transfer curves ---------------------------------------------------------------


def gamma(value: Column, power: float | Column = GAMMA) -> Column:
    """Gamma on positive values; others stay."""
    exponent = _d(1) / power if isinstance(power, Column) else _d(1 / power)
    return F.when(value > 0, F.pow(value, exponent)).otherwise(value)


def pq_oetf(value: Column) -> Column:
    """Scene-linear to PQ. Negative light ends at the curve's floor."""
    light = value * _d(PQ_SCALE)
    video = F.when(light < BT709_LINEAR_END, light * _d(4.5)).otherwise(
        _d(1.099) * F.pow(light, _d(0.45)) - _d(0.099)
    )
    display = _d(100) * F.pow(F.greatest(video, _d(0)), _d(BT1886_GAMMA))
    y = F.pow(display / _d(PQ_PEAK), _d(PQ_M1))
    return F.pow((_d(PQ_C1) + _d(PQ_C2) * y) / (_d(PQ_C3) * y + _d(1)), _d(PQ_M2))


def pq_oetf_inverse(value: Column) -> Column:
    """PQ to scene-linear, by the published inverse curves."""
    p = F.pow(value, _d(1 / PQ_M2))
    y = F.pow(F.greatest(p - _d(PQ_C1), _d(0)) / (_d(PQ_C2) - _d(PQ_C3) * p), _d(1 / PQ_M1))
    video = F.pow(y * _d(PQ_PEAK / 100), _d(1 / BT1886_GAMMA))
    knee = 1.099 * BT709_LINEAR_END**0.45 - 0.099
    light = F.when(video < knee, video / _d(4.5)).otherwise(
        F.pow((video + _d(0.099)) / _d(1.099), _d(1 / 0.45))
    )
    return light / _d(PQ_SCALE)


def srgb_oetf(value: Column, clip: bool = False) -> Column:
    shown = F.least(F.greatest(value, _d(0)), _d(1)) if clip else value
    return F.when(shown > 0.0031308, _d(1.055) * F.pow(shown, _d(1 / 2.4)) - _d(0.055)).otherwise(
        shown * _d(12.92)
    )


def transfer(name: str | None) -> Callable[[Column], Column]:
    """Transfer function by name."""
    if name is None or name == "None":
        return lambda value: value
    if name == "pq":
        return pq_oetf
    if name == "gamma22":
        return gamma
    raise ValueError(f"unknown transfer function {name!r}")


def sigmoid_contrast(value: Column, gain: Column | float, cutoff: Column | float) -> Column:
    gain = gain if isinstance(gain, Column) else _d(gain)
    cutoff = cutoff if isinstance(cutoff, Column) else _d(cutoff)
    slope = F.least(F.greatest(gain * (cutoff - value), _d(-50)), _d(50))
    return _d(1) / (_d(1) + F.exp(slope))


# -- sensor scaling ----------------------------------------------------------------


def black_white_scale(value: Column, black: Column, white: Column) -> Column:
    return (value - black) / (white - black)


def overexposure_bound(black: Column, white: Column, camera_white: Column) -> Column:
    """min(1, least channel saturation); arrays per channel, `camera_white` may be null."""
    shares = F.zip_with(camera_white, black, lambda c, b: (c - b) / (white - b))
    return F.least(_d(1), F.coalesce(F.array_min(shares), _d(1)))


def normalise_wb(balance: Column) -> Column:
    """Four coefficients relative to the second; a zero fourth takes the second's place."""
    second = F.element_at(balance, 2)
    last = F.when(F.element_at(balance, 4) == 0, second).otherwise(F.element_at(balance, 4))
    full = F.array(F.element_at(balance, 1), second, F.element_at(balance, 3), last)
    return F.transform(full, lambda c: c / second)


def mosaic_wb(balance: Column, y: Column, x: Column) -> Column:
    """Coefficient of an RGGB mosaic position: R, G / second G, B."""
    index = (
        F.when((y % 2 == 0) & (x % 2 == 0), 1)
        .when(y % 2 == 0, 2)
        .when(x % 2 == 0, 4)
        .otherwise(3)
    )
    return F.element_at(balance, index)


def plane_wb(balance: Column, channel: Column, planes: int) -> Column:
    """Coefficient of a colour plane (3: R G B; 4: R G G B)."""
    if planes == 3:
        return F.element_at(balance, channel + 1)
    return F.element_at(balance, F.element_at(F.array(*[F.lit(i) for i in (1, 2, 4, 3)]), channel + 1))


def apply_wb(value: Column, coefficient: Column, reverse: bool = False) -> Column:
    return value / coefficient if reverse else value * coefficient


def cfa_name(pattern: Column) -> Column:
    """2x2 colour indices to letters."""
    letters = F.array(*[F.lit(c) for c in "RGBG"])
    return F.array_join(F.transform(F.flatten(pattern), lambda i: F.element_at(letters, i + 1)), "")


# -- colour matrices ---------------------------------------------------------------


def _cell(matrix: Column, row: int, column: int) -> Column:
    return F.element_at(F.element_at(matrix, row + 1), column + 1)


def inverse3(matrix: Column) -> list[list[Column]]:
    """Closed-form inverse of the first three rows of a matrix column."""
    m = [[_cell(matrix, i, j) for j in range(3)] for i in range(3)]

    def cofactor(i: int, j: int) -> Column:
        a, b = [k for k in range(3) if k != i]
        c, d = [k for k in range(3) if k != j]
        minor = m[a][c] * m[b][d] - m[a][d] * m[b][c]
        return minor if (i + j) % 2 == 0 else -minor

    determinant = reduce(lambda p, q: p + q, [m[0][j] * cofactor(0, j) for j in range(3)])
    return [[cofactor(j, i) / determinant for j in range(3)] for i in range(3)]


def colour_matrix(rgb_xyz: Column, profile: str) -> Column:
    """Camera RGB to profile RGB as array<array<double>>; `xyz` stops at XYZ."""
    to_xyz = inverse3(rgb_xyz)
    if profile.lower() == "xyz":
        rows = to_xyz
    else:
        out = PROFILES[profile]
        rows = [
            [reduce(lambda p, q: p + q, [_d(out[i][k]) * to_xyz[k][j] for k in range(3)]) for j in range(3)]
            for i in range(3)
        ]
    return F.array(*[F.array(*row) for row in rows])


def apply_matrix(rgb: list[Column], matrix: Column) -> list[Column]:
    return [
        reduce(lambda p, q: p + q, [_cell(matrix, i, j) * rgb[j] for j in range(3)]) for i in range(3)
    ]


def constant_matrix(values: tuple[tuple[float, ...], ...]) -> Column:
    return F.array(*[F.array(*[_d(v) for v in row]) for row in values])


def rgb_to_yuv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    y = _d(YUV_R) * r + _d(YUV_G) * g + _d(YUV_B) * b
    return y, _d(YUV_U) * (b - y), _d(YUV_V) * (r - y)


def yuv_to_rgb(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    r = y + v / _d(YUV_V)
    b = y + u / _d(YUV_U)
    return r, (y - _d(YUV_R) * r - _d(YUV_B) * b) / _d(YUV_G), b
