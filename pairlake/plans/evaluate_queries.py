"""Samples, evaluation, sources and streams over the given tables."""

import numpy as np
from pyspark.sql import functions as F

from pairlake.functions import colour as C
from pairlake.operators import evaluate as V
from pairlake.operators import frames as M
from pairlake.operators import masks as B
from pairlake.operators import samples as S
from pairlake.operators import similarity as N
from pairlake.operators.batches import map_rows
from pairlake.plans import tables as T
from pairlake.plans.common import query, table
from pairlake.plans.result_queries import MULTIPLIER
from pairlake.plans.sample_queries import _CORNER_SQL, _OVERLAP_SQL, _SHIFTED_SQL, _UNIFORM
from pairlake.plans.sample_queries import _matrix_sql, _plane_frames
from pairlake.session import checkpoint_folder, shuffle_width
from pairlake.sources import documents as D
from pairlake.sources import files as L
from pairlake.sources import sinks as W
from pairlake.streaming import log as J

# -- samples -----------------------------------------------------------------------


def _crops(spark, sf):
    """Each pair's whole frames as one stored crop."""
    rgb, planes = T.rgb_frames(spark, sf), _plane_frames(spark, sf)
    pairs = T.frame_pairs(rgb).selectExpr(
        "*", "CAST(f_id % 7 - 3 AS int) AS dy", "CAST(f_id % 5 - 2 AS int) AS dx", "1.0D + f_id % 4 / 8.0D AS raw_gain"
    )
    for side in ("gt", "f"):
        pairs = pairs.join(rgb.selectExpr(f"image_id AS {side}_id", f"data AS {side}_rgb"), f"{side}_id")
        pairs = pairs.join(planes.selectExpr(f"image_id AS {side}_id", f"data AS {side}_in"), f"{side}_id")
    matrix = F.expr(
        "array(array(0.7D + f_id % 50 / 200.0D, -0.08D, -0.1D), array(-0.44D, 1.25D, 0.2D), array(-0.085D, 0.2D, 0.58D))"
    )
    return pairs.withColumns(
        {
            "sample_id": F.col("f_id"),
            "h": F.lit(8),
            "w": F.lit(8),
            "in_c": F.lit(4),
            "mask": F.expr("transform(slice(gt_rgb, 1, 64), v -> v < 0.7D)"),
            "rgb_xyz_matrix": matrix,
        }
    )


_X_Y_SQL = f"""{T.RGB_SQL}, {T.PAIRED_SQL}, {_SHIFTED_SQL},
clean_side AS MATERIALIZED (SELECT f_id AS sample_id, a.ch, {_CORNER_SQL}, a.v, dy, dx, gt_id FROM shifted
  JOIN rgb a ON a.image_id = gt_id WHERE {_OVERLAP_SQL}),
x_side AS (SELECT s.sample_id, s.ch, s.y, s.x, s.v, m.v < 0.7::DOUBLE AS valid FROM clean_side s
  JOIN rgb m ON m.image_id = s.gt_id AND m.ch = 0 AND m.y = s.y AND m.x = s.x)"""


@query(
    "assemble_samples",
    "sample_id:i ch:i y:i x:i v:d valid:b",
    f"WITH {_X_Y_SQL} SELECT sample_id, ch, y, x, v, valid FROM x_side",
)
def assemble_samples(spark, sf):
    made = V.assemble_samples(_crops(spark, sf), "x_y")
    return made.select(
        "sample_id", "h", "w", F.posexplode(F.arrays_zip("x", "mask")).alias("pos", "s")
    ).selectExpr(
        "sample_id", "pos div (h * w) AS ch", "pos div w % h AS y", "pos % w AS x", "s.x AS v", "s.mask AS valid"
    )


@query(
    "assemble_samples_input",
    "sample_id:i plane:i y:i x:i v:d",
    f"""WITH {T.MONO_SQL}, {T.PAIRED_SQL}, {_SHIFTED_SQL}, planes AS (SELECT image_id, y % 2 * 2 + x % 2 AS plane,
      y // 2 AS y, x // 2 AS x, v FROM mono),
    starts AS (SELECT f_id, CASE WHEN dy < 0 THEN -dy // 2 + abs(dy) % 2 ELSE 0 END AS ty0,
      CASE WHEN dy < 0 THEN 4 ELSE 4 - dy // 2 - dy % 2 END AS ty1,
      CASE WHEN dx < 0 THEN -dx // 2 + abs(dx) % 2 ELSE 0 END AS tx0,
      CASE WHEN dx < 0 THEN 4 ELSE 4 - dx // 2 - dx % 2 END AS tx1 FROM shifted)
    SELECT f_id AS sample_id, plane, y - ty0 AS y, x - tx0 AS x, v * (1 + f_id % 4 / 8.0::DOUBLE) AS v
    FROM starts JOIN planes ON image_id = f_id WHERE y >= ty0 AND y < ty1 AND x >= tx0 AND x < tx1""",
)
def assemble_samples_input(spark, sf):
    made = V.assemble_samples(_crops(spark, sf), "x_y")
    return made.select("sample_id", "yh", "yw", F.posexplode("y").alias("pos", "v")).selectExpr(
        "sample_id", "pos div (yh * yw) AS plane", "pos div yw % yh AS y", "pos % yw AS x", "v"
    )


@query(
    "assemble_samples_same",
    "sample_id:i pairing:s gain:d x_sum:d y_sum:d valid:i",
    f"""WITH {T.RGB_SQL}, {T.MONO_SQL}, {T.PAIRED_SQL}, sums AS (SELECT image_id, sum(v) AS s FROM rgb GROUP BY image_id),
    monos AS (SELECT image_id, sum(v) AS s FROM mono GROUP BY image_id)
    SELECT f_id AS sample_id, pairing, 1 + f_id % 4 / 8.0::DOUBLE AS gain, r.s AS x_sum, m.s AS y_sum, 192 AS valid
    FROM paired, (SELECT unnest(['x_x', 'y_y']) AS pairing)
      JOIN sums r ON r.image_id = CASE pairing WHEN 'x_x' THEN gt_id ELSE f_id END
      JOIN monos m ON m.image_id = r.image_id""",
)
def assemble_samples_same(spark, sf):
    crops = _crops(spark, sf)
    sides = [
        V.assemble_samples(crops, p, match_gain=False).withColumn("pairing", F.lit(p)) for p in ("x_x", "y_y")
    ]
    return sides[0].unionByName(sides[1]).selectExpr(
        "sample_id",
        "pairing",
        "gain",
        "aggregate(x, 0.0D, (s, v) -> s + v) AS x_sum",
        "aggregate(y, 0.0D, (s, v) -> s + v) AS y_sum",
        "size(filter(mask, m -> m)) AS valid",
    )


@query(
    "crop_masks",
    "image_id:i crop_id:i y:i x:i valid:b",
    f"""WITH {T.MONO_SQL}, stored AS (SELECT * FROM (VALUES (0, 0, 0), (1, 1, 2), (2, 2, 1), (3, 3, 3)) AS t(crop_id, cy, cx)),
    spots AS (SELECT *, 2 * cy + oy AS at_y, 2 * cx + ox AS at_x FROM (SELECT vec_id AS image_id FROM embeddings), stored,
      (SELECT unnest(range(4)) AS oy), (SELECT unnest(range(4)) AS ox))
    SELECT s.image_id, crop_id, oy AS y, ox AS x, coalesce(v < 0.6::DOUBLE, false) AS valid
    FROM spots s LEFT JOIN mono m ON m.image_id = s.image_id AND m.y = at_y AND m.x = at_x""",
)
def crop_masks(spark, sf):
    frames = T.mono_frames(spark, sf)
    masks = B.exposure_tiles(M.tile_frames(frames, 4), 0.6)
    listed = "inline(array(struct(0, 0, 0), struct(1, 1, 2), struct(2, 2, 1), struct(3, 3, 3))) AS (crop_id, y, x)"
    crops = frames.selectExpr("image_id", listed).selectExpr("*", "4 AS h", "4 AS w")
    made = V.crop_masks(crops, masks, ["image_id"], tile=4).select("image_id", "crop_id", F.posexplode("mask").alias("at", "valid"))
    return made.selectExpr("image_id", "crop_id", "at div 4 AS y", "at % 4 AS x", "valid")


# -- evaluation --------------------------------------------------------------------


def _rgb_samples(spark, sf):
    """RGB samples: clean frame, noisy frame as model input, mask from the clean red plane."""
    rgb = T.rgb_frames(spark, sf)
    return (
        T.frame_pairs(rgb)
        .join(rgb.selectExpr("image_id AS gt_id", "data AS x"), "gt_id")
        .join(rgb.selectExpr("image_id AS f_id", "data AS y"), "f_id")
        .selectExpr(
            "f_id AS sample_id", "3 AS c", "8 AS h", "8 AS w", "x", "3 AS yc", "8 AS yh", "8 AS yw", "y",
            "flatten(array_repeat(transform(slice(x, 1, 64), v -> v < 0.7D), 3)) AS mask",
            "array(array(0.7D + f_id % 50 / 200.0D, -0.08D, -0.1D), array(-0.44D, 1.25D, 0.2D), "
            "array(-0.085D, 0.2D, 0.58D)) AS rgb_xyz_matrix",
        )
    )


_SAMPLES_SQL = f"""{T.RGB_SQL}, {T.PAIRED_SQL},
px AS (SELECT f_id AS sample_id, a.ch, a.y, a.x, a.v AS x_v, b.v AS y_v, m.v < 0.7::DOUBLE AS valid FROM paired
  JOIN rgb a ON a.image_id = gt_id JOIN rgb b ON b.image_id = f_id AND b.ch = a.ch AND b.y = a.y AND b.x = a.x
  JOIN rgb m ON m.image_id = gt_id AND m.ch = 0 AND m.y = a.y AND m.x = a.x)"""


@query(
    "pixel_metrics",
    "sample_id:i l1:d mse:d masked_mse:d psnr:d psnr_capped:d",
    f"""WITH {_SAMPLES_SQL}, sums AS (SELECT sample_id, avg(abs(x_v - y_v)) AS l1, avg(pow(x_v - y_v, 2)) AS mse,
      sum(CASE WHEN valid THEN pow(x_v - y_v, 2) ELSE 0 END) / count(*) AS masked_mse FROM px GROUP BY sample_id)
    SELECT *, CASE WHEN mse = 0 THEN 'inf'::DOUBLE ELSE 10 * log10(1 / mse) END AS raw,
      CASE WHEN mse = 0 THEN NULL ELSE 10 * log10(1 / mse) END AS psnr,
      CASE WHEN mse = 0 THEN 100 ELSE least(10 * log10(1 / mse), 100) END AS psnr_capped FROM sums""",
)
def pixel_metrics(spark, sf):
    x, y, m = F.col("x"), F.col("y"), F.col("mask")
    measured = _rgb_samples(spark, sf).select(
        "sample_id",
        V.l1(x, y).alias("l1"),
        V.mse(x, y).alias("mse"),
        V.mse(V.masked(x, m), V.masked(y, m)).alias("masked_mse"),
    )
    return measured.withColumns({"psnr": V.psnr(F.col("mse")), "psnr_capped": V.psnr(F.col("mse"), 100.0)})


@query(
    "bpp",
    "image_key:s bpp:d",
    f"""WITH {T.IMAGE_RESULTS_SQL} SELECT image_key, sum(no * 8.0::DOUBLE / (64 * 32)) AS bpp FROM image_results GROUP BY image_key
      UNION ALL SELECT DISTINCT 'passthrough/' || image_key, 24.0::DOUBLE FROM image_results""",
)
def bpp(spark, sf):
    rate = V.bpp(F.col("no"), F.lit(64), F.lit(32))
    coded = T.image_results(spark, sf).groupBy("image_key").agg(F.sum(rate).alias("bpp"))
    name = F.concat(F.lit("passthrough/"), "image_key").alias("image_key")
    return coded.unionByName(coded.select(name, F.lit(V.PASSTHROUGH_BPP).alias("bpp")))


def _halving_model():
    """A stand-in model: halves the samples; the rate is the mean sample."""

    def predict(y, row):
        return y * 0.5, float(y.mean())

    return predict


@query(
    "apply_model",
    "sample_id:i ch:i y:i x:i v:d bpp:d",
    f"""WITH {_SAMPLES_SQL}, rates AS (SELECT sample_id, avg(y_v) AS bpp FROM px GROUP BY sample_id)
    SELECT sample_id, ch, y, x, y_v * 0.5::DOUBLE AS v, bpp FROM px JOIN rates USING (sample_id)""",
)
def apply_model(spark, sf):
    out = V.apply_model(_rgb_samples(spark, sf), _halving_model)
    return out.select("sample_id", "bpp", F.posexplode("out").alias("pos", "v")).selectExpr(
        "sample_id", "pos div 64 AS ch", "pos div 8 % 8 AS y", "pos % 8 AS x", "v", "bpp"
    )


@query(
    "evaluate",
    "sample_id:i metric:s value:d",
    f"""WITH {_SAMPLES_SQL}, gains AS (SELECT sample_id, avg(x_v) / avg(y_v) AS g, avg(y_v) AS bpp FROM px GROUP BY sample_id),
    curved AS (SELECT sample_id, bpp, valid, CASE WHEN x_v > 0 THEN pow(x_v, 1 / 2.2::DOUBLE) ELSE x_v END AS a,
      CASE WHEN y_v * g > 0 THEN pow(y_v * g, 1 / 2.2::DOUBLE) ELSE y_v * g END AS b FROM px JOIN gains USING (sample_id)),
    sums AS (SELECT sample_id, any_value(bpp) AS bpp, sum(CASE WHEN valid THEN pow(a - b, 2) ELSE 0 END) / count(*) AS mse,
      sum(CASE WHEN valid THEN abs(a - b) ELSE 0 END) / count(*) AS l1 FROM curved GROUP BY sample_id)
    SELECT sample_id, 'mse' AS metric, mse AS value FROM sums UNION ALL SELECT sample_id, 'l1', l1 FROM sums
    UNION ALL SELECT sample_id, 'bpp', bpp FROM sums UNION ALL SELECT sample_id, 'combined', bpp + 32 * mse FROM sums""",
)
def evaluate(spark, sf):
    samples = _rgb_samples(spark, sf)
    return V.evaluate(samples, _halving_model, match=True, transfer="gamma22", loss="mse", weight=32.0)


@query(
    "evaluate_known",
    "sample_id:i metric:s value:d",
    f"""WITH {_SAMPLES_SQL}, sums AS (SELECT sample_id, avg(abs(CASE WHEN valid THEN x_v - least(y_v, 0.6::DOUBLE) ELSE 0 END))
      AS l1 FROM px GROUP BY sample_id)
    SELECT sample_id, 'l1' AS metric, CASE WHEN sample_id % 3 = 0 THEN 0.25 ELSE l1 END AS value FROM sums""",
)
def evaluate_known(spark, sf):
    """Recorded images keep their result; the rest is evaluated with a post-processor hook."""
    samples = _rgb_samples(spark, sf)
    known = samples.filter("sample_id % 3 = 0").selectExpr("sample_id", "'l1' AS metric", "0.25D AS value")
    due = V.pending_samples(samples, known, ["sample_id"])
    fresh = V.evaluate(due, metrics=("l1",), loss="l1", post=lambda a: np.minimum(a, 0.6))
    return fresh.unionByName(known)


@query(
    "match_output",
    "sample_id:i ch:i y:i x:i v:d",
    f"""WITH {_SAMPLES_SQL}, k AS (SELECT vec_id, 0.7::DOUBLE + vec_id % 50 / 200.0::DOUBLE AS m00, 1.25::DOUBLE AS m11 FROM embeddings),
    mats AS (SELECT vec_id, {_matrix_sql(C.XYZ_TO_REC2020)} FROM k),
    flat AS (SELECT sample_id, y, x, max(y_v) FILTER (ch = 0) AS r, max(y_v) FILTER (ch = 1) AS g,
      max(y_v) FILTER (ch = 2) AS b, sum(x_v) AS x_sum FROM px GROUP BY sample_id, y, x),
    mapped AS (SELECT sample_id, y, x, x_sum, c00 * r + c01 * g + c02 * b AS o0, c10 * r + c11 * g + c12 * b AS o1,
      c20 * r + c21 * g + c22 * b AS o2 FROM flat JOIN mats ON vec_id = sample_id),
    gained AS (SELECT *, sum(x_sum) OVER w / sum(o0 + o1 + o2) OVER w AS f FROM mapped WINDOW w AS (PARTITION BY sample_id))
    SELECT sample_id, 0 AS ch, y, x, o0 * f AS v FROM gained UNION ALL SELECT sample_id, 1, y, x, o1 * f FROM gained
    UNION ALL SELECT sample_id, 2, y, x, o2 * f FROM gained""",
)
def match_output(spark, sf):
    done = V.match_output(_rgb_samples(spark, sf), "y", gain=True)
    return done.select("sample_id", F.posexplode("out").alias("pos", "v")).selectExpr(
        "sample_id", "pos div 64 AS ch", "pos div 8 % 8 AS y", "pos % 8 AS x", "v"
    )


def _large_frames(spark, sf):
    """176 x 176 frames: each sample becomes a 22 x 22 block, textured by the frame's own samples.

    They have hundreds of times the bytes of the rows they come from, so these are dealt to all tasks first.
    """

    def spread(r):
        small = np.asarray(r.data).reshape(8, 8)
        texture = np.tile(small, (22, 22))
        yield r.image_id, 1, 176, 176, (np.kron(small, np.ones((22, 22))) * (0.75 + 0.25 * texture)).ravel()

    return map_rows(
        T.mono_frames(spark, sf).select("image_id", "data").repartition(shuffle_width(spark)),
        spread,
        "image_id bigint, c int, frame_h int, frame_w int, data array<double>",
    )


@query("ms_ssim", "gt_id:i f_id:i rgb_msssim_score:d")
def ms_ssim(spark, sf):
    frames = _large_frames(spark, sf)
    pairs = T.frame_pairs(T.rgb_frames(spark, sf)).selectExpr(
        "*", "CAST(f_id % 3 AS int) AS dy", "CAST(-(f_id % 2) AS int) AS dx", "1.0D AS aligned_gain"
    )
    # Two passes make the tiles anew: kept, they would take more disk than all that the scores move.
    return N.ms_ssim(pairs, M.tile_frames(frames, 96), size=96)


@query("scored_bands", "band:d images:i mean_score:d")
def scored_bands(spark, sf):
    """Scores into the descriptor, then the mean score of the pairs at or above each band's bound."""
    pairs = T.frame_pairs(T.rgb_frames(spark, sf)).selectExpr(
        "*", "CAST(f_id % 3 AS int) AS dy", "CAST(-(f_id % 2) AS int) AS dx", "1.0D AS aligned_gain"
    )
    scored = N.with_scores(pairs, M.tile_frames(_large_frames(spark, sf), 96), 96)
    bounds = F.explode(F.array(*[F.lit(b) for b in (0.0, 0.2, 0.4, 0.6)])).alias("band")
    banded = scored.select("rgb_msssim_score", bounds).filter("rgb_msssim_score >= band")
    return banded.groupBy("band").agg(F.count(F.lit(1)).alias("images"), F.avg("rgb_msssim_score").alias("mean_score"))


# -- batches and augmentation ------------------------------------------------------


@query(
    "training_batches",
    "batch:i side:s slot:i key:s crop:i",
    f"""WITH clean AS (SELECT 'c' || doc_id AS key, CAST(doc_id % 3 + 1 AS INT) AS n FROM documents),
      noisy AS (SELECT 'n' || vec_id AS key, CAST(vec_id % 2 + 1 AS INT) AS n FROM embeddings),
      orders_ AS (SELECT 'clean' AS side, 3 AS slots, key, n, {_UNIFORM.format(t="key || ':5:clean'")} AS u FROM clean
        UNION ALL SELECT 'noisy', 2, key, n, {_UNIFORM.format(t="key || ':5:noisy'")} FROM noisy),
      dealt AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY u, key) - 1 AS r FROM orders_),
      ends AS (SELECT min(last) + 1 AS n_batches FROM (SELECT max(r // slots) AS last FROM dealt GROUP BY side))
    SELECT r // slots AS batch, side, r % slots AS slot, key, unnest(range(n)) AS crop FROM dealt, ends
    WHERE r // slots < n_batches""",
)
def training_batches(spark, sf):
    clean = table(spark, sf, "documents").selectExpr("'c' || doc_id AS key", "CAST(doc_id % 3 + 1 AS int) AS n_crops")
    noisy = table(spark, sf, "embeddings").selectExpr("'n' || vec_id AS key", "CAST(vec_id % 2 + 1 AS int) AS n_crops")
    return S.training_batches(clean, noisy, 3, 2, seed=5)


@query(
    "training_batches_one_side",
    "batch:i side:s slot:i key:s crop:i",
    f"""WITH noisy AS (SELECT 'n' || vec_id AS key, CAST(vec_id % 2 + 1 AS INT) AS n FROM embeddings),
      orders_ AS (SELECT 'clean' AS side, 1 AS slots, key, n, {_UNIFORM.format(t="key || ':5:clean'")} AS u FROM noisy
        UNION ALL SELECT 'noisy', 3, key, n, {_UNIFORM.format(t="key || ':5:noisy'")} FROM noisy),
      dealt AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY u, key) - 1 AS r FROM orders_),
      ends AS (SELECT min(last) + 1 AS n_batches FROM (SELECT max(r // slots) AS last FROM dealt GROUP BY side))
    SELECT r // slots AS batch, side, r % slots AS slot, key, unnest(range(n)) AS crop FROM dealt, ends
    WHERE r // slots < least(n_batches, 90)""",
)
def training_batches_one_side(spark, sf):
    noisy = table(spark, sf, "embeddings").selectExpr("'n' || vec_id AS key", "CAST(vec_id % 2 + 1 AS int) AS n_crops")
    return S.training_batches(noisy.limit(0), noisy, 0, 4, seed=5, steps=90)


def _u(name: str) -> str:
    return _UNIFORM.format(t=f"vec_id || ':9:{name}'")


@query(
    "augment_parameters",
    "vec_id:i wb:b tonemap:b edges:b curve:b sigmoid:b sharpen:b alpha:d gamma:d gain:i cutoff:d taps:i sigma:d",
    f"""SELECT vec_id, {", ".join(f"floor({_u(n)} * 8) > 0 AS {n}" for n in
        ("wb", "tonemap", "edges", "curve", "sigmoid", "sharpen"))},
      0.01::DOUBLE + {_u("alpha")} * 0.49::DOUBLE AS alpha, 1.8::DOUBLE + {_u("gamma")} * 0.4::DOUBLE AS gamma,
      floor(5 + {_u("gain")} * 15) AS gain, 0.3::DOUBLE + {_u("cutoff")} * 0.4::DOUBLE AS cutoff,
      CASE WHEN {_u("taps")} < 0.5 THEN 3 ELSE 5 END AS taps, 0.5::DOUBLE + {_u("sigma")} AS sigma FROM embeddings""",
)
def augment_parameters(spark, sf):
    return S.augment_parameters(table(spark, sf, "embeddings").select("vec_id"), "vec_id", seed=9)


def _rgb_crops(spark, sf):
    return T.rgb_frames(spark, sf).selectExpr("image_id AS sample_id", "c", "frame_h AS h", "frame_w AS w", "data")


def _long(crops):
    return crops.select("sample_id", "h", "w", F.posexplode("data").alias("pos", "v")).selectExpr(
        "sample_id", "pos div (h * w) AS ch", "pos div w % h AS y", "pos % w AS x", "v"
    )


@query("augment", "sample_id:i ch:i y:i x:i v:d")
def augment(spark, sf):
    return _long(S.augment(_rgb_crops(spark, sf), "sample_id", seed=9))


@query("augment_simple", "sample_id:i ch:i y:i x:i v:d")
def augment_simple(spark, sf):
    return _long(S.augment_simple(_rgb_crops(spark, sf), "sample_id", seed=9))


# -- sources and sinks -------------------------------------------------------------


@query("scan_files", "name:s size:i")
def scan_files(spark, sf):
    return L.scan_files(spark, sf, "*.parquet")


@query(
    "npy_tiles",
    "path:s pos:i v:d",
    f"""WITH {T.MONO_SQL} SELECT 'e' || image_id || '.npy' AS path, y * 8 + x AS pos,
      v FROM mono""",
)
def npy_tiles(spark, sf):
    tiles = T.mono_frames(spark, sf).selectExpr(
        "'e' || image_id || '.npy' AS path", "c", "frame_h AS h", "frame_w AS w", "data"
    )
    decoded = L.decode_npy(L.encode_npy(tiles, "float64"))
    return decoded.select("path", F.posexplode("data").alias("pos", "v"))


@query(
    "validate_files",
    "path:s valid:b",
    """WITH f AS (SELECT doc_id, doc_id % 8 AS k FROM documents)
    SELECT 'f' || doc_id || '.' || ['png', 'jpg', 'npy', 'raf', 'cr2', 'doc', 'tiff', 'exr'][k + 1] AS path,
      CASE k WHEN 0 THEN doc_id % 3 = 0 WHEN 1 THEN doc_id % 3 = 1 WHEN 2 THEN false WHEN 3 THEN true
        WHEN 4 THEN doc_id % 3 > 0 WHEN 5 THEN false WHEN 6 THEN doc_id % 3 = 2 ELSE doc_id % 3 > 0 END AS valid FROM f""",
)
def validate_files(spark, sf):
    files = table(spark, sf, "documents").selectExpr(
        "'f' || doc_id || '.' || element_at(array('png', 'jpg', 'npy', 'raf', 'cr2', 'doc', 'tiff', 'exr'), "
        "CAST(doc_id % 8 + 1 AS int)) AS path",
        "CASE WHEN doc_id % 8 IN (4, 7) AND doc_id % 3 = 0 THEN X'' ELSE "
        "concat(CASE doc_id % 3 WHEN 0 THEN X'89504E47' WHEN 1 THEN X'FFD8FFE0' ELSE X'49492A00' END, "
        "CAST(text AS binary)) END AS content",
    )
    return L.validate_files(files, open_images=True)


_OUTCOME_SQL = "['OK', 'BAD_EXPOSURE', 'UNREADABLE_ERROR', 'UNKNOWN_ERROR'][doc_id % 4 + 1]"


def _converted(spark, sf):
    return table(spark, sf, "documents").selectExpr(
        "doc_id",
        "element_at(array('OK', 'BAD_EXPOSURE', 'UNREADABLE_ERROR', 'UNKNOWN_ERROR'), CAST(doc_id % 4 + 1 AS int)) AS outcome",
    )


@query(
    "conversion_report",
    "outcome:s files:i",
    f"SELECT {_OUTCOME_SQL} AS outcome, count(*) AS files FROM documents GROUP BY ALL",
)
def conversion_report(spark, sf):
    return L.conversion_report(_converted(spark, sf))


@query(
    "failed_conversions",
    "doc_id:i outcome:s",
    f"SELECT doc_id, {_OUTCOME_SQL} AS outcome FROM documents WHERE doc_id % 4 > 0",
)
def failed_conversions(spark, sf):
    return L.failed_conversions(_converted(spark, sf))


@query(
    "read_descriptors",
    "f_fpath:s image_set:s is_bayer:b score:d dy:i dx:i n_crops:i",
    """SELECT 'n' || p_partkey AS f_fpath, 'scene-' || p_size AS image_set, p_partkey % 3 > 0 AS is_bayer,
      CASE WHEN p_partkey % 7 > 0 THEN p_size / 64.0::DOUBLE END AS score, p_size % 9 - 4 AS dy,
      CAST(p_partkey % 5 AS INT) AS dx, p_size % 2 + 1 AS n_crops FROM part""",
)
def read_descriptors(spark, sf):
    items = table(spark, sf, "part").selectExpr(
        "'f_fpath: n' || p_partkey || '\\n  image_set: scene-' || p_size || '\\n  is_bayer: ' || (p_partkey % 3 > 0) "
        "|| '\\n  rgb_msssim_score: ' || CASE WHEN p_partkey % 7 > 0 THEN CAST(p_size / 64.0D AS string) ELSE 'null' END "
        "|| '\\n  best_alignment:\\n  - ' || (p_size % 9 - 4) || '\\n  - ' || (p_partkey % 5) "
        "|| '\\n  crops:\\n  - coordinates: [0, 0]' || CASE WHEN p_size % 2 = 1 THEN '\\n  - coordinates: [768, 0]' ELSE '' END "
        "AS item"
    )
    ddl = (
        "f_fpath string, image_set string, is_bayer boolean, rgb_msssim_score double, best_alignment array<int>, "
        "crops array<struct<coordinates: array<int>>>"
    )
    return D.parse_descriptors(items, ddl).selectExpr(
        "f_fpath", "image_set", "is_bayer", "rgb_msssim_score AS score", "best_alignment[0] AS dy",
        "best_alignment[1] AS dx", "size(crops) AS n_crops",
    )


@query(
    "read_results",
    "model:s step:i metric:s value:d",
    f"WITH {T.RESULTS_SQL} SELECT model, step, metric, value FROM results",
)
def read_results(spark, sf):
    entries = T.results_long(spark, sf)
    docs = entries.select(
        "model",
        F.to_json(
            F.create_map(F.col("step").cast("string"), F.create_map("metric", "value"), F.lit("best_step"),
                         F.create_map("metric", F.lit(1.0)))
        ).alias("doc"),
    )
    return D.parse_results(docs)


@query(
    "union_columns",
    "camera:s files:i model:s size:i",
    f"""WITH {T.MANIFEST_SQL} SELECT camera, count(*) AS files, NULL AS model, NULL AS size FROM manifest GROUP BY camera
      UNION ALL SELECT NULL, NULL, 'm' || s_suppkey, s_nationkey FROM supplier""",
)
def union_columns(spark, sf):
    cameras = T.manifest(spark, sf).groupBy("camera").agg(F.count(F.lit(1)).alias("files"))
    sizes = table(spark, sf, "supplier").selectExpr("'m' || s_suppkey AS model", "s_nationkey AS size")
    return W.union_columns([sizes, cameras])


@query(
    "flatten_keys",
    "model_name:s model_step:i test:s res:d",
    f"""WITH {T.IMAGE_RESULTS_SQL} SELECT model AS model_name, step AS model_step, test, avg(bpp) AS res FROM image_results
      GROUP BY ALL""",
)
def flatten_keys(spark, sf):
    keyed = T.image_results(spark, sf).groupBy(
        F.struct(F.struct(F.col("model").alias("name"), "step").alias("model"), "test").alias("k")
    )
    return W.flatten_keys(keyed.agg(F.avg("bpp").alias("v")), "k", "v")


def _folder(spark, name):
    import uuid

    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "write_report",
    "Group:s Model:s bpp:d msssim:d",
    f"""WITH {T.POINTS_SQL} SELECT "group" AS "Group", model AS "Model", bpp, value AS msssim FROM points""",
)
def write_report(spark, sf):
    folder = _folder(spark, "report")
    rows = T.points(spark, sf).select("group", "model", "bpp", "value")
    W.write_report(rows, ["Group", "Model", "bpp", "msssim"], folder)
    return spark.read.option("header", "true").schema("Group string, Model string, bpp double, msssim double").csv(folder)


@query(
    "write_layout",
    "filename:s sensor:s scene:s role:s",
    f"""WITH {T.MANIFEST_SQL} SELECT filename, sensor, image_set AS scene, role FROM manifest WHERE seq % 23 <> 7""",
)
def write_layout(spark, sf):
    from pairlake.operators.catalog import parse_capture_name

    folder = _folder(spark, "layout")
    parsed = parse_capture_name(T.manifest(spark, sf).select("filename")).filter("sensor IS NOT NULL")
    W.write_layout(parsed, folder, folders=("sensor", "role"))
    return spark.read.schema("filename string, sensor string, scene string, role string").parquet(folder)


@query(
    "write_table",
    "model:s step:i metric:s value:d",
    f"WITH {T.RESULTS_SQL} SELECT model, step, metric, value FROM results",
)
def write_table(spark, sf):
    folder = _folder(spark, "table")
    W.write_table(T.results_long(spark, sf), folder, "json")
    return spark.read.schema("model string, step bigint, metric string, value double").json(folder)


@query(
    "map_rows",
    "path:s words:i",
    f"""WITH {T.MANIFEST_SQL} SELECT path, len(regexp_extract_all(content, '[^ \\n]+')) AS words FROM manifest""",
)
def map_rows_query(spark, sf):
    rows = T.manifest(spark, sf).select("path", "content")

    def count(r):
        yield r.path, len([w for w in r.content.replace("\n", " ").split(" ") if w])

    return map_rows(rows, count, "path string, words int")


# -- streams -----------------------------------------------------------------------

_EVENTS_SQL = """log AS (SELECT 'm' || user_id AS model, event_id AS step, event_type AS metric,
  floor(value / 5.0::DOUBLE) AS value FROM events)"""


def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet").selectExpr(
        "'m' || user_id AS model", "event_id AS step", "event_type AS metric", "CAST(floor(value / 5.0D) AS double) AS value"
    )


@query(
    "stream_best_step",
    "model:s metric:s best_step:i best_value:d",
    f"""WITH {_EVENTS_SQL} SELECT model, metric, arg_min(step, (value, step)) AS best_step, min(value) AS best_value
      FROM log GROUP BY ALL""",
)
def stream_best_step(spark, sf):
    return J.settled_best(J.run_available(J.stream_improvements(_event_stream(spark, sf))))


@query(
    "stream_captures",
    "sha1:s",
    "SELECT DISTINCT sha1(text) AS sha1 FROM documents",
)
def stream_captures(spark, sf):
    schema = table(spark, sf, "documents").schema
    arriving = spark.readStream.schema(schema).parquet(f"{sf}/documents*.parquet")
    files = arriving.selectExpr("sha1(text) AS sha1", "timestamp_seconds(1700000000 + doc_id) AS mtime")
    return J.run_available(J.stream_captures(files))


@query(
    "stream_plateau",
    "model:s step:i cuts:i factor:d",
    f"""WITH RECURSIVE {_EVENTS_SQL},
    steps AS (SELECT model, step, value <= min(value) OVER (PARTITION BY model, metric ORDER BY step) AS improved,
      row_number() OVER (PARTITION BY model ORDER BY step) AS rn FROM log),
    walk AS (SELECT model, 0::BIGINT AS rn, -1::BIGINT AS step, 2000::BIGINT AS deadline, false AS cut, 0 AS cuts
      FROM steps WHERE rn = 1
      UNION ALL SELECT s.model, s.rn, s.step,
        CASE WHEN s.improved OR s.step > w.deadline THEN s.step + 2000 ELSE w.deadline END,
        NOT s.improved AND s.step > w.deadline,
        w.cuts + CASE WHEN NOT s.improved AND s.step > w.deadline THEN 1 ELSE 0 END
      FROM walk w JOIN steps s ON s.model = w.model AND s.rn = w.rn + 1)
    SELECT model, step, cuts, pow({MULTIPLIER * MULTIPLIER}::DOUBLE, cuts) AS factor FROM walk WHERE cut""",
)
def stream_plateau(spark, sf):
    return J.run_available(J.stream_plateau(_event_stream(spark, sf), 2000, MULTIPLIER))
