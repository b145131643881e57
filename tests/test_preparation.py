"""Kernels and pair preparation against brute force on small generated frames."""

import numpy as np
import pytest

from pairlake.operators import descriptors as D
from pairlake.operators import frames as M
from pairlake.operators import kernels as K
from pairlake.operators import masks as L
from pairlake.operators import preparation as P
from pairlake.operators import similarity as N

SCHEMA = "image_id bigint, c int, frame_h int, frame_w int, data array<double>"


def _frames(spark, images):
    rows = [(i, a.shape[0], a.shape[1], a.shape[2], a.ravel().tolist()) for i, a in images.items()]
    return spark.createDataFrame(rows, SCHEMA)


def _pairs(spark, pairs):
    return spark.createDataFrame(pairs, "gt_id bigint, f_id bigint")


def _scene(seed=0, size=52, c=3):
    rng = np.random.default_rng(seed)
    base = rng.random((c, size, size))
    # Smooth enough for a local search to slide along.
    for _ in range(6):
        base = (base + np.roll(base, 1, 1) + np.roll(base, 1, 2) + np.roll(base, -1, 1) + np.roll(base, -1, 2)) / 5
    return base


def _shifted(dy, dx, k=1.0, size=36, seed=0):
    """Clean frame and a target whose pixel (y - dy, x - dx) shows clean pixel (y, x)."""
    base = _scene(seed)
    clean = base[:, 8 : 8 + size, 8 : 8 + size]
    target = base[:, 8 + dy : 8 + dy + size, 8 + dx : 8 + dx + size]
    return clean, target / k


def _overlap(a, b, dy, dx):
    top, bottom = K.overlap(dy, a.shape[1])
    left, right = K.overlap(dx, a.shape[2])
    return a[:, top:bottom, left:right], b[:, top - dy : bottom - dy, left - dx : right - dx]


@pytest.mark.parametrize("size", [12, 16, 64])
def test_align_recovers_shifts(spark, size):
    shifts = [(0, 0), (1, 0), (0, -1), (2, 5), (-5, 2), (-3, -3)]
    images, pairs = {}, []
    for n, (dy, dx) in enumerate(shifts):
        images[2 * n], images[2 * n + 1] = _shifted(dy, dx, seed=n)
        pairs.append((2 * n, 2 * n + 1))
    tiles = M.tile_frames(_frames(spark, images), size)
    found = {r.gt_id: r for r in P.align(_pairs(spark, pairs), tiles, size, max_shift=9).collect()}
    wide = {r.gt_id: r for r in P.align_exhaustive(_pairs(spark, pairs), tiles, 5, size).collect()}
    for n, (dy, dx) in enumerate(shifts):
        a, b = images[2 * n], images[2 * n + 1]
        gain = a.mean() / b.mean()
        x, y = _overlap(a, b, dy, dx)
        assert (wide[2 * n].dy, wide[2 * n].dx) == (dy, dx)
        assert (found[2 * n].dy, found[2 * n].dx) == (dy, dx)
        assert not found[2 * n].moving
        for got in (found[2 * n], wide[2 * n]):
            assert got.best_alignment_loss == pytest.approx(np.abs(x - gain * y).mean(), abs=1e-12)
            assert got.rgb_gain == pytest.approx(gain)
            assert got.aligned_gain == pytest.approx(x.mean() / y.mean())


def test_gain_recovers_scale(spark):
    clean, target = _shifted(0, 0, k=4.0)
    tiles = M.tile_frames(_frames(spark, {0: clean, 1: target}), 16)
    rows = {(r.gt_id, r.f_id): r.gain for r in P.gain(_pairs(spark, [(0, 1), (0, 0)]), tiles).collect()}
    assert rows[0, 1] == pytest.approx(4.0) and rows[0, 0] == pytest.approx(1.0)


def _opening(mask):
    h, w = mask.shape
    cross = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]

    def at(m, y, x):
        return 0 <= y < h and 0 <= x < w and m[y, x]

    eroded = np.array([[all(at(mask, y + a, x + b) for a, b in cross) for x in range(w)] for y in range(h)])
    return np.array([[any(at(eroded, y + a, x + b) for a, b in cross) for x in range(w)] for y in range(h)])


def test_opening_matches_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(5):
        mask = rng.random((17, 23)) > 0.2
        assert (K.cross_opening(mask) == _opening(mask)).all()


def test_all_valid_mask_loses_its_corners():
    assert K.cross_opening(np.ones((16, 16), bool)).sum() == 256 - 4


@pytest.mark.parametrize("size", [10, 64])
@pytest.mark.parametrize("outliers", [0, 1, 5, 40])
def test_pair_mask(spark, size, outliers):
    rng = np.random.default_rng(outliers)
    clean = _scene(3)[:, :32, :32] * 0.5
    noisy = clean + rng.normal(0, 1e-3, clean.shape)
    spots = rng.choice(32 * 32, outliers, replace=False)
    noisy[:, spots // 32, spots % 32] += 0.6
    clean[:, 4:7, 5:9] = 0.97
    aligned = spark.createDataFrame([(0, 1, 1, -2)], "gt_id bigint, f_id bigint, dy int, dx int")
    a, b = _overlap(clean, noisy, 1, -2)
    g = a.mean() / b.mean()
    loss = np.abs(K.positive_gamma(a, 2.2) - K.positive_gamma(b * g, 2.2)).sum(0)
    threshold = min(0.4, np.quantile(loss, 0.9999)) or 1.0
    expected = _opening(loss < threshold) & (a < 0.95).all(0)
    tiles = M.tile_frames(_frames(spark, {0: clean, 1: noisy}), size)
    from pyspark.sql import functions as F

    aligned = aligned.withColumn("aligned_gain", F.lit(float(g)))
    losses = L.loss_tiles(aligned, tiles, 0.95, size)
    found = L.reject_threshold(losses).first().threshold
    assert found == pytest.approx(threshold, abs=1e-12)
    pixels = {(r.y, r.x): r.valid for r in L.mask_pixels(L.pair_masks(aligned, tiles, 0.95, size)).collect()}
    (top, _), (left, _) = K.overlap(1, 32), K.overlap(-2, 32)
    assert pixels == {(y + top, x + left): v for (y, x), v in np.ndenumerate(expected)}
    mean = P.pair_mask(aligned, tiles, 0.95, size).first().mask_mean
    assert mean == pytest.approx(expected.mean(), abs=1e-12)


def test_prepare_pairs_searches_until_it_converges(spark):
    images, pairs, shifts = {}, [], [(0, 0), (2, 5), (-5, 2)]
    for n, (dy, dx) in enumerate(shifts):
        images[2 * n], images[2 * n + 1] = _shifted(dy, dx, k=2.0, seed=n)
        pairs.append((2 * n, 2 * n + 1))
    tiles = M.tile_frames(_frames(spark, images), 12)
    free = {r.gt_id: r for r in P.prepare_pairs(_pairs(spark, pairs), tiles, None, 0.95, 12).collect()}
    wide = {r.gt_id: r for r in P.prepare_pairs(_pairs(spark, pairs), tiles, 6, 0.95, 12).collect()}
    for n, shift in enumerate(shifts):
        got, expected = free[2 * n], wide[2 * n]
        assert (got.dy, got.dx) == shift == (expected.dy, expected.dx)
        assert got.best_alignment_loss == pytest.approx(expected.best_alignment_loss, abs=1e-12)
        assert got.mask_mean == pytest.approx(expected.mask_mean, abs=1e-12)


def test_equal_images_have_threshold_one(spark):
    clean = _scene(4)[:, :20, :20]
    from pyspark.sql import functions as F

    aligned = _pairs(spark, [(0, 0)]).withColumns({"dy": F.lit(0), "dx": F.lit(0), "aligned_gain": F.lit(1.0)})
    tiles = M.tile_frames(_frames(spark, {0: clean}), 8)
    assert L.reject_threshold(L.loss_tiles(aligned, tiles, 1.0, 8)).first().threshold == 1.0


@pytest.mark.parametrize("counted", [1, 7, 10**6])
def test_quantile_narrows_down_to_the_same_value(spark, monkeypatch, counted):
    from pyspark.sql import functions as F

    monkeypatch.setattr(L, "COUNTED", counted)
    rng = np.random.default_rng(8)
    clean = _scene(8)[:, :40, :40]
    images = {0: clean, 1: clean + rng.normal(0, 1e-3, clean.shape), 2: np.round(clean, 1), 3: clean + 0.7 * (rng.random((40, 40)) > 0.5)}
    aligned = _pairs(spark, [(0, 1), (0, 2), (0, 3), (0, 0)]).withColumns(
        {"dy": F.lit(0), "dx": F.lit(0), "aligned_gain": F.lit(1.0)}
    )
    tiles = M.tile_frames(_frames(spark, images), 16)
    for quantile in (0.9999, 0.97, 0.5):
        rows = L.reject_threshold(L.loss_tiles(aligned, tiles, 2.0, 16), quantile).collect()
        assert len(rows) == 4
        for r in rows:
            loss = np.abs(K.positive_gamma(clean, 2.2) - K.positive_gamma(images[r.f_id], 2.2)).sum(0)
            assert r.threshold == pytest.approx(min(0.4, np.quantile(loss, quantile)) or 1.0, abs=1e-9)


def test_a_shared_clean_image_is_spread(spark, monkeypatch):
    from pairlake.operators import windows

    images = {n: _shifted(0, n % 3, seed=1)[n > 0] for n in range(13)}
    tiles = M.tile_frames(_frames(spark, images), 12)
    pairs = _pairs(spark, [(0, n) for n in range(1, 13)])
    assert windows.shared_images(pairs, 12) is None
    plain = sorted(map(tuple, P.align(pairs, tiles, 12, max_shift=9).collect()))
    # Two tiles' bytes for one salt: twelve pairs with the clean image make six salts, and no other image has any.
    monkeypatch.setattr(windows.shared_images, "__defaults__", (12, 2 * 12 * 12 * 24))
    shared = windows.shared_images(pairs, 12)
    assert [tuple(r) for r in shared.collect()] == [(0, 6)]
    assert sorted(map(tuple, P.align(pairs, tiles, 12, max_shift=9).collect())) == plain
    still = pairs.selectExpr("*", "0 AS dy", "0 AS dx", "36 AS frame_h", "36 AS frame_w")
    asked = windows.requests(still, 12, 0, 3).join(shared, "image_id").selectExpr("ty", "tx", "pmod(xxhash64(gt_id, f_id), salts) AS s")
    sizes = [r["count"] for r in asked.groupBy("ty", "tx", "s").count().collect()]
    assert max(sizes) < 12 and len(sizes) > 2 * 9


def test_windows_move_no_more_for_a_wide_shift(spark):
    from pyspark.sql import functions as F
    from pairlake.operators.windows import pair_windows

    frame = np.arange(60 * 60, dtype=float).reshape(1, 60, 60)
    tiles = M.tile_frames(_frames(spark, {0: frame, 1: frame}), 10)
    for dy, dx in ((0, 0), (30, -20), (-59, 59), (60, 0)):
        pairs = _pairs(spark, [(0, 1)]).withColumns({"dy": F.lit(dy), "dx": F.lit(dx)})
        rows = pair_windows(pairs, tiles, 0, 1, 10).collect()
        samples = sum(p.h * p.w for r in rows for p in r.f_parts)
        assert samples <= len(rows) * 12 * 12 and (rows or dy == 60)
        for r in rows:
            window = K.assemble([p.asDict() for p in r.f_parts], 1, r.y0 - dy, r.x0 - dx, r.h, r.w)[0]
            for (y, x), v in np.ndenumerate(window):
                fy, fx = r.y0 - dy + y, r.x0 - dx + x
                assert v == frame[0, fy, fx] if 0 <= fy < 60 and 0 <= fx < 60 else np.isnan(v)


def _mosaic(rgb):
    y, x = np.indices(rgb.shape[1:])
    return np.take_along_axis(rgb, ((y % 2) + (x % 2))[None], 0)


def _developed(mono):
    return K.demosaic_rggb(np.pad(mono[0], 1, constant_values=np.nan), -1, -1)


@pytest.mark.parametrize("size", [12, 64])
def test_descriptors_from_the_mosaic(spark, size):
    clean, other = _shifted(2, -4, k=2.0, seed=3)
    clean = clean * 0.9
    clean[:, 10:13, 20:24] = 0.99
    mono, noisy = _mosaic(clean), _mosaic(other)
    images = {0: mono, 1: noisy, 2: 0 * noisy, 3: noisy[:, :-2], 4: clean, 5: other, 6: np.where(noisy > 0.2, np.nan, noisy), 7: clean}
    meta = [(i, True, 0.8, [[0.7, 0.0, 0.1]] * 4) for i in (0, 1, 2, 3, 6)] + [(4, False, 0.95, None), (5, False, 1.0, None)]
    meta = spark.createDataFrame(meta, "image_id bigint, is_bayer boolean, overexposure_lb double, rgb_xyz_matrix array<array<double>>")
    asked = [(0, 1), (0, 2), (0, 3), (0, 6), (0, 9), (8, 1), (4, 5), (0, 5), (7, 5)]
    found = D.describe_pairs(_pairs(spark, asked), M.tile_frames(_frames(spark, images), size), meta, size, max_shift=9)
    rows = {(r.gt_id, r.f_id): r for r in found.pairs.collect()}
    assert {k: r.reason for k, r in rows.items() if r.reason} == {
        (0, 2): "black other", (0, 3): "unequal frames", (0, 6): "not finite", (0, 9): "missing other",
        (8, 1): "missing clean", (0, 5): "unequal frames",
    }
    assert {(r.gt_id, r.f_id) for r in found.rejected.collect()} == {k for k, r in rows.items() if r.reason}
    assert {(r.gt_id, r.f_id) for r in found.accepted.collect()} == {(0, 1), (4, 5), (7, 5)}
    cases = [((0, 1), _developed(mono), _developed(noisy), mono, 0.8), ((4, 5), clean, other, clean, 0.95), ((7, 5), clean, other, clean, np.inf)]
    for key, a, b, stored, bound in cases:
        r = rows[key]
        assert (r.dy, r.dx) == (2, -4)
        assert r.rgb_gain == pytest.approx(a.mean() / b.mean())
        x, y = _overlap(a, b, 2, -4)
        assert r.best_alignment_loss == pytest.approx(np.abs(x - a.mean() / b.mean() * y).mean(), abs=1e-12)
        gain = x.mean() / y.mean()
        loss = np.abs(K.positive_gamma(x, 2.2) - K.positive_gamma(y * gain, 2.2)).sum(0)
        lit = _overlap((stored < bound).all(0)[None], a, 2, -4)[0][0]
        expected = _opening(loss < (min(0.4, np.quantile(loss, 0.9999)) or 1.0)) & lit
        assert r.mask_mean == pytest.approx(expected.mean(), abs=1e-12)
    assert rows[0, 1].raw_gain == pytest.approx(mono.mean() / noisy.mean()) and rows[0, 1].is_bayer
    assert rows[0, 1].rgb_xyz_matrix[0][0] == 0.7 and rows[0, 1].overexposure_lb == 0.8
    assert rows[4, 5].raw_gain is None and rows[4, 5].rgb_xyz_matrix is None and not rows[7, 5].is_bayer
    masks = found.masks.filter("gt_id = 0").agg({"n_valid": "sum"}).first()[0]
    assert masks == round(rows[0, 1].mask_mean * np.prod(_overlap(clean, other, 2, -4)[0].shape[1:]))


def test_pairs_without_a_gain_are_left_out(spark):
    clean = _scene(9)[:, :16, :16]
    tiles = M.tile_frames(_frames(spark, {0: clean, 1: 0 * clean, 2: clean}), 8)
    pairs = _pairs(spark, [(0, 1), (0, 2)])
    for found in (P.align(pairs, tiles, 8), P.align_exhaustive(pairs, tiles, 1, 8), P.prepare_pairs(pairs, tiles, None, 0.9, 8)):
        assert [r.f_id for r in found.collect()] == [2]


def test_demosaic_brute_force(spark):
    rng = np.random.default_rng(5)
    mono = rng.random((1, 18, 22))
    got = np.full((3, 18, 22), np.nan)
    tiles = P.demosaic_bilinear(M.tile_frames(_frames(spark, {0: mono}), 8), 8)
    for r in tiles.collect():
        got[:, r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w] = np.reshape(r.data, (3, r.h, r.w))
    colour = lambda y, x: (y % 2) + (x % 2)
    for y in range(18):
        for x in range(22):
            for ch in range(3):
                if colour(y, x) == ch:
                    expected = mono[0, y, x]
                else:
                    near = [
                        mono[0, v, u]
                        for v in range(max(y - 1, 0), min(y + 2, 18))
                        for u in range(max(x - 1, 0), min(x + 2, 22))
                        if colour(v, u) == ch
                    ]
                    expected = np.mean(near)
                assert got[ch, y, x] == pytest.approx(expected)


@pytest.mark.parametrize("shift", [(0, 0), (3, -2), (-1, 4)])
@pytest.mark.parametrize("size", [50, 80, 256])
def test_ms_ssim_is_the_whole_image_score(spark, shift, size):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    clean = np.kron(rng.random((1, 27, 25)), np.ones((1, 7, 8)))[:, :187, :198]
    images = {
        0: clean,
        1: np.clip(clean + rng.normal(0, 0.05, clean.shape), 0, 1),
        2: np.clip(clean + rng.normal(0, 0.2, clean.shape), 0, 1),
        3: clean[:, :150, :150],
    }
    dy, dx = shift
    pairs = _pairs(spark, [(0, 0), (0, 1), (0, 2)]).withColumns(
        {"dy": F.lit(dy), "dx": F.lit(dx), "aligned_gain": F.lit(1.0)}
    )
    tiles = M.tile_frames(_frames(spark, images), size)
    got = {r.f_id: r.rgb_msssim_score for r in N.ms_ssim(pairs, tiles, size).collect()}
    for f in (0, 1, 2):
        assert got[f] == pytest.approx(K.ms_ssim(*_overlap(clean, images[f], dy, dx)), abs=1e-9)
    if shift == (0, 0):
        assert got[0] == pytest.approx(1.0) and got[0] > got[1] > got[2]
        small = _pairs(spark, [(3, 3)]).withColumns({"dy": F.lit(0), "dx": F.lit(0), "aligned_gain": F.lit(1.0)})
        assert N.ms_ssim(small, tiles, size).first().rgb_msssim_score is None


def test_halo_parts_are_bounded(spark):
    frame = np.arange(40 * 40, dtype=float).reshape(1, 40, 40)
    haloed = M.with_halo(M.tile_frames(_frames(spark, {0: frame}), 8), 3, 8)
    for r in haloed.collect():
        assert len(r.parts) <= 9
        window = K.assemble([p.asDict() for p in r.parts], 1, r.y0 - 3, r.x0 - 3, r.h + 6, r.w + 6)[0]
        for y in range(window.shape[0]):
            for x in range(window.shape[1]):
                fy, fx = r.y0 - 3 + y, r.x0 - 3 + x
                if 0 <= fy < 40 and 0 <= fx < 40:
                    assert window[y, x] == frame[0, fy, fx]
                else:
                    assert np.isnan(window[y, x])
