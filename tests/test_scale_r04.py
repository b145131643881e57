"""Scale: what scores of pairs write, and what a task holds of them, on rows of its own."""

import math
from glob import glob

import numpy as np
import pyarrow.parquet as pq
import pytest

from pairlake import session as S
from pairlake.operators import frames as M
from pairlake.operators import kernels as K
from pairlake.operators import similarity as N

SIDE = 164
SHIFTS = {(0, 0): (0, 0), (0, 1): (1, -2), (0, 2): (2, 0), (5, 1): (0, 0), (5, 6): (-1, 1)}


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(11)
    clean = np.kron(rng.random((2, 21, 21)), np.ones((1, 8, 8)))[:, :SIDE, :SIDE]
    return {i: np.clip(clean + rng.normal(0, 0.02 * i, clean.shape), 0, 1) for i in (0, 1, 2, 5, 6)}


def _tables(spark, images):
    frames = spark.createDataFrame([(i, 2, SIDE, SIDE, a.ravel().tolist()) for i, a in images.items()], "image_id int, c int, frame_h int, frame_w int, data array<double>")
    pairs = [(*k, *v, 1.1) for k, v in SHIFTS.items()]
    # A pair that comes twice, one without a gain, one without its other and one without its clean image.
    pairs += [pairs[1], (0, 6, 0, 0, None), (0, 77, 0, 0, 1.0), (77, 0, 0, 0, 1.0)]
    return spark.createDataFrame(pairs, "gt_id int, f_id int, dy int, dx int, aligned_gain double"), M.tile_frames(frames, 96)


def _whole_image_score(images, gt, f):
    (top, bottom), (left, right) = (K.overlap(d, SIDE) for d in SHIFTS[gt, f])
    dy, dx = SHIFTS[gt, f]
    return K.ms_ssim(images[gt][:, top:bottom, left:right], images[f][:, top - dy : bottom - dy, left - dx : right - dx] * 1.1)


@pytest.mark.parametrize("set_to", [{}, {"GROUP_BYTES": 1 << 19, "PARTITION_BYTES": 1 << 20}, {"ASKED_ROWS": 0, "SALT_BYTES": 1}, {"WHOLE": 0}])
def test_scores_are_those_of_whole_images_however_pairs_are_dealt(spark, images, monkeypatch, set_to):
    for name, value in set_to.items():
        monkeypatch.setattr(N, name, value)
    pairs, tiles = _tables(spark, images)
    found = sorted(((r.gt_id, r.f_id, r.rgb_msssim_score) for r in N.ms_ssim(pairs, tiles, 96, N.WHOLE).collect()), key=str)
    assert [x[:2] for x in found] == sorted(((r.gt_id, r.f_id) for r in pairs.collect()), key=str)
    for gt, f, score in found:
        if (gt, f) in SHIFTS:
            assert score == pytest.approx(_whole_image_score(images, gt, f), abs=1e-9)
        elif (gt, f) == (0, 77):
            assert math.isnan(score)
        else:
            assert score is None


def test_scores_of_small_frames_write_no_samples(spark, images, monkeypatch):
    written = []
    monkeypatch.setattr(N, "checkpointed", lambda df, **options: written.append(df.dtypes) or S.checkpointed(df, **options))
    N.ms_ssim(*_tables(spark, images), 96)
    assert written
    assert not [field for fields in written for field in fields if field[1].startswith(("array", "binary"))]


def test_row_groups_of_samples_are_bounded(spark, monkeypatch, tmp_path):
    # Flat samples: few bytes of file are many in memory.
    monkeypatch.setattr(S, "checkpoint_folder", lambda spark: str(tmp_path))
    rows = spark.range(0, 1200, 1, 1).selectExpr("id", "array_repeat(CAST(id AS double), 10000) AS a")
    assert S.checkpointed(rows, **S.SAMPLES).selectExpr("sum(a[9999])").first()[0] == 1199 * 600
    for path in glob(f"{tmp_path}/*/*.parquet"):
        meta = pq.ParquetFile(path).metadata
        assert max(meta.row_group(i).num_rows for i in range(meta.num_row_groups)) * 80_000 < 24 << 20


@pytest.mark.parametrize("shape", [(1, 11, 11), (2, 3, 42, 43), (1, 75, 106)])
def test_products_over_bands_are_the_blur(shape):
    a = np.random.default_rng(3).random(shape)
    weights = K.gaussian(K.SSIM_TAPS, K.SSIM_SIGMA)
    assert K._banded(a, weights) == pytest.approx(K.blur_valid(a, weights), abs=1e-13)


def test_scored_bands_keeps_no_tiles(spark, monkeypatch, tmp_path):
    from pairlake.plans.common import QUERIES

    monkeypatch.setattr(S, "checkpoint_folder", lambda spark: str(tmp_path / "kept"))
    rows = np.random.default_rng(7).normal(0, 0.1, (6, 64))
    rows[3] = rows[1]
    table = [(i, row.tolist(), i % 2) for i, row in enumerate(rows)]
    spark.createDataFrame(table, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r.band: (r.images, r.mean_score) for r in QUERIES["scored_bands"](spark, str(tmp_path)).collect()}
    assert found[0.0][0] == 6 and found[0.6][0] >= 2
    kept = [pq.ParquetFile(path) for path in glob(f"{tmp_path}/kept/*/*.parquet")]
    assert kept and not [name for file in kept for name in file.schema.names if name in ("element", "list")]
