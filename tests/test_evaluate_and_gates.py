"""Contracts that an oracle cannot show."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlake.functions import colour as C
from pairlake.operators import crops as X
from pairlake.operators import evaluate as V
from pairlake.operators import gates as G
from pairlake.operators import kernels as K
from pairlake.operators import samples as S

# Camera matrices of real cameras.
CAMERAS = [
    [[0.9943, -0.3269, -0.0839], [-0.5323, 1.3269, 0.2259], [-0.1198, 0.2083, 0.7557]],
    [[0.6988, -0.1384, -0.0714], [-0.5631, 1.3410, 0.2447], [-0.1485, 0.2204, 0.7318]],
]


def _scored(spark, scores):
    return spark.createDataFrame([(s,) for s in scores], "rgb_msssim_score double")


def test_missing_score_matters_only_when_a_bound_is_on(spark):
    rows = _scored(spark, [0.5, None, 1.0])
    assert G.score_band(rows, 0.0, 1.0).count() == 3
    with pytest.raises(Exception, match="similarity score"):
        G.score_band(rows, 0.9).collect()
    with pytest.raises(Exception, match="similarity score"):
        G.score_band(rows, None, None, mode="strict").collect()
    assert G.score_band(_scored(spark, [0.5, 1.0]), 1.0).count() == 1
    assert G.score_band(_scored(spark, [0.5, 1.0]), None, 0.0, mode="strict").count() == 0


def test_colour_matrix_inverts_real_cameras(spark):
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(CAMERAS)], "i int, m array<array<double>>")
    made = rows.select("i", C.colour_matrix(F.col("m"), "lin_rec2020").alias("p"), C.colour_matrix(F.col("m"), "xyz").alias("x"))
    for r in made.collect():
        assert np.allclose(r.x, np.linalg.inv(CAMERAS[r.i]))
        assert np.allclose(r.p, np.array(C.XYZ_TO_REC2020) @ np.linalg.inv(CAMERAS[r.i]))
        rgb = np.random.default_rng(0).random((3, 4, 5))
        out = K.match_output(rgb, CAMERAS[r.i], C.XYZ_TO_REC2020, None)
        assert np.allclose(out.reshape(3, -1), np.array(r.p) @ rgb.reshape(3, -1))


def test_pq_round_trip_and_floor(spark):
    ramp = spark.range(-10, 101).select((F.col("id") / 100.0).alias("v"))
    rows = ramp.select("v", C.pq_oetf(F.col("v")).alias("p"), C.pq_oetf_inverse(C.pq_oetf(F.col("v"))).alias("b")).collect()
    for r in rows:
        assert r.p == pytest.approx(K.pq(np.array([r.v]))[0], abs=1e-12)
        assert r.b == pytest.approx(max(r.v, 0.0), abs=1e-7)


def test_tile_plan_bounds(spark):
    sides = [383, 384, 399, 400, 1152, 1168, 5000]
    images = spark.createDataFrame([(f"i{s}", s, 600) for s in sides], "base string, h int, w int")
    got = {}
    for r in X.plan_tiles(images).collect():
        got.setdefault(r.base, []).append((r.y, r.y1, r.x, r.x1))
    for s in sides:
        limit = s - s % 16
        expected = [(o, min(o + 1024, limit), 0, 592) for o in range(0, 10**4, 768) if o + 384 < limit]
        assert sorted(got.get(f"i{s}", [])) == expected


def test_random_crops_leave_out_hopeless_tiles(spark):
    tiles = spark.createDataFrame(
        [(0, 16, 16, [True] * 256), (1, 16, 16, [False] * 256)], "tile_id bigint, h int, w int, mask array<boolean>"
    )
    rows = X.random_crops(tiles, n=3, size=8, seed=1).collect()
    assert {r.tile_id for r in rows} == {0} and len(rows) == 3
    assert all(r.attempt == 0 and r.y % 2 == 0 and r.x % 2 == 0 and r.y < 8 and r.x < 8 for r in rows)


def test_evaluate_reports_similarity_and_rate(spark):
    rng = np.random.default_rng(0)
    x = rng.random((1, 170, 170))
    rows = [(0, x.ravel().tolist(), x.ravel().tolist()), (1, x.ravel().tolist(), np.clip(x + 0.1, 0, 1).ravel().tolist())]
    samples = spark.createDataFrame(rows, "sample_id bigint, x array<double>, y array<double>").selectExpr(
        "*", "1 AS c", "170 AS h", "170 AS w", "1 AS yc", "170 AS yh", "170 AS yw",
        "transform(x, v -> true) AS mask", "CAST(null AS array<array<double>>) AS rgb_xyz_matrix",
    )
    got = {(r.sample_id, r.metric): r.value for r in V.evaluate(samples, metrics=("msssim", "mse"), loss="msssim_loss").collect()}
    assert got[0, "msssim"] == pytest.approx(1.0) and got[0, "mse"] == 0.0
    assert got[1, "msssim_loss"] == pytest.approx(1 - K.ms_ssim(np.clip(x + 0.1, 0, 1), x))
    assert (0, "bpp") not in got


def test_augment_is_the_same_for_both_sides(spark):
    rng = np.random.default_rng(0)
    image = rng.random((3, 12, 12)).ravel().tolist()
    crops = spark.createDataFrame(
        [(i, "clean/crop", image) for i in (0, 1)], "sample_id bigint, key string, data array<double>"
    ).selectExpr("*", "3 AS c", "12 AS h", "12 AS w")
    for made in (S.augment(crops, "key", 3), S.augment_simple(crops, "key", 3)):
        a, b = (r.data for r in made.orderBy("sample_id").collect())
        assert a == b and 0 <= min(a) and max(a) <= 1 and a != image


def test_equalisation_spreads_a_narrow_histogram():
    channel = np.repeat(np.arange(100, 132, dtype=np.uint8), 64).reshape(32, 64)
    out = K.equalised(channel)
    assert out.min() == 0 and out.max() == 255 and (np.diff(np.unique(out)) > 0).all()


def test_batches_stop_with_the_shorter_stream(spark):
    clean = spark.range(10).selectExpr("concat('c', id) AS key", "2 AS n_crops")
    noisy = spark.range(100).selectExpr("concat('n', id) AS key", "1 AS n_crops")
    rows = S.training_batches(clean, noisy, 4, 3, seed=1).collect()
    assert {r.batch for r in rows} == {0, 1, 2}
    assert sum(r.side == "clean" for r in rows) == 20 and sum(r.side == "noisy" for r in rows) == 9
