"""Small NumPy helpers on one tile and its border. Spark moves and reduces the rows."""

from __future__ import annotations

import numpy as np

# Structural similarity (11-tap Gaussian, sigma 1.5, five scales).
SSIM_TAPS = 11
SSIM_SIGMA = 1.5
SSIM_WEIGHTS = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)
SSIM_C1 = 0.01**2
SSIM_C2 = 0.03**2
#: Lines that one product of `_banded` makes; a wider band has more zeros.
BAND = 32


def assemble(parts, c: int, y: int, x: int, h: int, w: int) -> np.ndarray:
    """Samples of a frame window (c, h, w) from overlapping parts; NaN where none has any."""
    out = np.full((c, h, w), np.nan)
    for part in parts:
        py, px, ph, pw = part["y"], part["x"], part["h"], part["w"]
        a, b = max(py, y), min(py + ph, y + h)
        l, r = max(px, x), min(px + pw, x + w)
        if a < b and l < r:
            data = np.asarray(part["data"], dtype=np.float64).reshape(c, ph, pw)
            out[:, a - y : b - y, l - x : r - x] = data[:, a - py : b - py, l - px : r - px]
    return out


def overlap(shift: int, length: int) -> tuple[int, int]:
    """Anchor lines that overlap the target under a shift; an odd shift loses one more."""
    odd = abs(shift) % 2
    if shift > 0:
        return shift, length - odd
    return odd, length + shift


def positive_gamma(a: np.ndarray, power: float) -> np.ndarray:
    return np.where(a > 0, np.power(np.maximum(a, 0), 1 / power), a)


def reflect_border(a: np.ndarray, y: int, x: int, frame_h: int, frame_w: int) -> np.ndarray:
    """Fill the lines of a window outside the frame by mirroring about the frame's edge lines."""

    def mirrored(start: int, count: int, length: int) -> np.ndarray:
        period = max(2 * (length - 1), 1)
        at = np.mod(np.arange(start, start + count), period)
        inside = np.where(at < length, at, period - at) - start
        return np.clip(inside, 0, count - 1)

    rows = mirrored(y, a.shape[-2], frame_h)
    columns = mirrored(x, a.shape[-1], frame_w)
    return a[..., rows[:, None], columns[None, :]]


def gaussian(taps: int, sigma: float) -> np.ndarray:
    at = np.arange(taps) - (taps - 1) / 2
    weights = np.exp(-(at**2) / (2 * sigma**2))
    return weights / weights.sum()


def _slide(a: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    """Weighted sum of shifted copies along an axis; the weights are symmetric."""
    n = len(weights)
    length = a.shape[axis] - n + 1

    def lines(i: int) -> np.ndarray:
        cut = [slice(None)] * a.ndim
        cut[axis] = slice(i, i + length)
        return a[tuple(cut)]

    out = weights[n // 2] * lines(n // 2)
    for i in range(n // 2):
        pair = lines(i) + lines(n - 1 - i)
        pair *= weights[i]
        out += pair
    return out


def blur_valid(a: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Separable convolution with a symmetric odd kernel, without borders."""
    return _slide(_slide(a, weights, a.ndim - 2), weights, a.ndim - 1)


def _banded(a: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What `blur_valid` gives, as matrix products over bands of lines: several times faster on large images.

    A sample that is not finite makes all windows of its band not finite.
    """
    beyond = len(weights) - 1
    h, w = a.shape[-2] - beyond, a.shape[-1] - beyond
    band = np.zeros((BAND + beyond, BAND))
    for i, weight in enumerate(weights):
        band[np.arange(BAND) + i, np.arange(BAND)] = weight
    wide, out = np.empty((*a.shape[:-1], w)), np.empty((*a.shape[:-2], h, w))
    for x in range(0, w, BAND):
        n = min(BAND, w - x)
        wide[..., x : x + n] = a[..., x : x + n + beyond] @ band[: n + beyond, :n]
    for y in range(0, h, BAND):
        n = min(BAND, h - y)
        out[..., y : y + n, :] = band[: n + beyond, :n].T @ wide[..., y : y + n + beyond, :]
    return out


def similarity_maps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contrast-structure map and full similarity map of two (c, h, w) images."""
    weights = gaussian(SSIM_TAPS, SSIM_SIGMA)
    mean_a, mean_b, squares, product = _banded(np.stack([a, b, a * a + b * b, a * b]), weights)
    both, power = mean_a * mean_b, mean_a**2 + mean_b**2
    contrast = (2 * (product - both) + SSIM_C2) / (squares - power + SSIM_C2)
    return contrast, contrast * (2 * both + SSIM_C1) / (power + SSIM_C1)


def cross_opening(mask: np.ndarray) -> np.ndarray:
    """Binary opening by the 3x3 cross; outside the array counts as false."""

    def neighbours(m: np.ndarray) -> list[np.ndarray]:
        p = np.pad(m, 1)
        return [p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]

    eroded = np.logical_and.reduce(neighbours(mask))
    return np.logical_or.reduce(neighbours(eroded))


def demosaic_rggb(window: np.ndarray, y: int, x: int) -> np.ndarray:
    """Bilinear colours for the inside of a mono window with a 1-line border (NaN off frame).

    A position keeps its own sample; another colour is the mean of that colour's samples in
    the 3x3 neighbourhood. `y`, `x` are the frame position of the window's corner.
    """
    ys, xs = np.arange(window.shape[0]) + y, np.arange(window.shape[1]) + x
    even_y, even_x = (ys % 2 == 0)[:, None], (xs % 2 == 0)[None, :]
    sites = [even_y & even_x, even_y != even_x, ~even_y & ~even_x]
    colours = []
    for site in sites:
        valid = site & ~np.isnan(window)
        value = np.where(valid, window, 0.0)
        h, w = window.shape[0] - 2, window.shape[1] - 2
        total = sum(value[i : i + h, j : j + w] for i in range(3) for j in range(3))
        count = sum(valid[i : i + h, j : j + w].astype(float) for i in range(3) for j in range(3))
        mean = np.divide(total, count, out=np.full((h, w), np.nan), where=count > 0)
        colours.append(np.where(site[1:-1, 1:-1], window[1:-1, 1:-1], mean))
    return np.stack(colours)


def ms_ssim(a: np.ndarray, b: np.ndarray) -> float | None:
    """Multi-scale similarity of two (c, h, w) images in [0, 1]; None below 161 lines a side."""
    if min(a.shape[1:]) <= (SSIM_TAPS - 1) * 2 ** (len(SSIM_WEIGHTS) - 1):
        return None
    score = np.ones(a.shape[0])
    for scale, power in enumerate(SSIM_WEIGHTS):
        contrast, full = similarity_maps(a, b)
        term = full if scale == len(SSIM_WEIGHTS) - 1 else contrast
        score *= np.maximum(term.mean(axis=(1, 2)), 0) ** power
        a, b = (
            sum(p[:, i::2, j::2][:, : p.shape[1] // 2, : p.shape[2] // 2] for i in (0, 1) for j in (0, 1)) / 4
            for p in (np.pad(v, [(0, 0)] + [(v.shape[k] % 2,) * 2 for k in (1, 2)]) for v in (a, b))
        )
    return float(score.mean())


# -- evaluation --------------------------------------------------------------------


def match_gain(anchor: np.ndarray, other: np.ndarray) -> np.ndarray:
    mean = other.mean()
    return other * (anchor.mean() / mean) if mean else other


def match_output(out: np.ndarray, camera, profile, clean: np.ndarray | None) -> np.ndarray:
    """Camera RGB to a profile; with a clean image, its mean is matched before and after."""
    if clean is not None:
        out = match_gain(clean, out)
    matrix = np.asarray(profile) @ np.linalg.inv(np.array([list(row) for row in camera[:3]], dtype=np.float64))
    out = np.tensordot(matrix, out, 1)
    return out if clean is None else match_gain(clean, out)


def pq(a: np.ndarray) -> np.ndarray:
    from pairlake.functions import colour as c

    light = a * c.PQ_SCALE
    video = np.where(
        light < c.BT709_LINEAR_END, light * 4.5, 1.099 * np.power(np.maximum(light, 0), 0.45) - 0.099
    )
    y = np.power(100 * np.power(np.maximum(video, 0), c.BT1886_GAMMA) / c.PQ_PEAK, c.PQ_M1)
    return np.power((c.PQ_C1 + c.PQ_C2 * y) / (c.PQ_C3 * y + 1), c.PQ_M2)


TRANSFERS = {
    None: lambda a: a,
    "None": lambda a: a,
    "pq": pq,
    "gamma22": lambda a: positive_gamma(a, 2.2),
}


def _loss(score: float | None) -> float | None:
    return None if score is None else 1 - score


# Loss and metric registry.
METRICS = {
    "l1": lambda a, b: float(np.abs(a - b).mean()),
    "mse": lambda a, b: float(((a - b) ** 2).mean()),
    "msssim": ms_ssim,
    "msssim_loss": lambda a, b: _loss(ms_ssim(a, b)),
}


# -- augmentation ------------------------------------------------------------------

# Analogue YUV luma and grey weights.
LUMA = np.array([0.299, 0.587, 0.114])
GREY = np.array([0.2989, 0.587, 0.114])
SMOOTH = np.array([[1, 1, 1], [1, 5, 1], [1, 1, 1]]) / 13


def augment(image: np.ndarray, p) -> np.ndarray:
    """Development look of one RGB crop under the parameters of `augment_parameters`."""
    h, w = image.shape[1:]
    if p.wb:
        means = image.clip(0, 1).mean(axis=(1, 2))
        image = image * (means.mean() / means)[:, None, None]
    if p.tonemap:
        luma = np.tensordot(LUMA, image, 1)
        curve = np.log(np.maximum(1 + luma, 0.001)) / np.log(max(1 + luma.max() + 0.001, 0.001))
        curve = (curve - curve.min()) / (curve.max() - curve.min())
        image = image + (curve - luma)
    if p.edges:
        blue = np.pad(image[2], 1, mode="reflect")
        laplacian = blue[:-2, 1:-1] + blue[2:, 1:-1] + blue[1:-1, :-2] + blue[1:-1, 2:] - 4 * image[2]
        image = image.clip(0, 1) + p.alpha * laplacian
    if p.curve:
        image = positive_gamma(image, p.gamma)
    if p.sigmoid:
        image = 1 / (1 + np.exp(np.clip(p.gain * (p.cutoff - image), -50, 50)))
    if p.sharpen:
        border = p.taps // 2
        full = np.pad(image, [(0, 0), (border, border), (border, border)], mode="reflect")
        image = 1.5 * image - 0.5 * blur_valid(full, gaussian(p.taps, p.sigma))[:, :h, :w]
    return image.clip(0, 1)


def equalised(channel: np.ndarray) -> np.ndarray:
    """Histogram equalisation of an 8-bit channel."""
    counts = np.bincount(channel.ravel(), minlength=256)
    present = counts[counts > 0]
    step = (present.sum() - present[-1]) // 255
    if step == 0:
        return channel
    before = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return ((before + step // 2) // step).clip(0, 255).astype(np.uint8)[channel]


def augment_simple(image: np.ndarray, p) -> np.ndarray:
    """Equalised blend, contrast, saturation, gamma and sharpness of one RGB crop."""
    eight = (image.clip(0, 1) * 255).astype(np.uint8)
    flat = np.stack([equalised(c) for c in eight]) / 255
    image = flat * p.equalize_weight + image * (1 - p.equalize_weight)
    grey = np.tensordot(GREY, image, 1)
    image = (p.contrast * image + (1 - p.contrast) * grey.mean()).clip(0, 1)
    grey = np.tensordot(GREY, image, 1)
    image = (p.saturation * image + (1 - p.saturation) * grey).clip(0, 1)
    image = positive_gamma(image, p.gamma)
    h, w = image.shape[1:]
    soft = image.copy()
    soft[:, 1:-1, 1:-1] = sum(
        SMOOTH[i, j] * image[:, i : h - 2 + i, j : w - 2 + j] for i in range(3) for j in range(3)
    )
    return (p.sharpness * image + (1 - p.sharpness) * soft).clip(0, 1)
