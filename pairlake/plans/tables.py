"""The given tables recast as this package's tables, in Spark and as SQL text.

Each recipe reads a whole table. Names, scores and attributes are arithmetic on its columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlake.operators.skew import salted_join
from pairlake.plans.common import table

# -- results (events) --------------------------------------------------------------

RESULTS_SQL = """
results AS (
  SELECT *, CASE WHEN hash_no % 97 = 0 THEN NULL ELSE raw END AS value FROM (
    SELECT 'm' || user_id AS model, event_id // 400 AS step,
      CASE event_type WHEN 'view' THEN 'val_msssim_loss.None' WHEN 'signup' THEN 'val_mse.None'
        WHEN 'click' THEN 'test_msssim_loss' WHEN 'error' THEN 'test_bpp'
        ELSE 'val_combined.gamma22' END AS metric,
      floor(min(value) / 5.0::DOUBLE) / 100.0::DOUBLE AS raw,
      min(event_id) AS hash_no
    FROM events GROUP BY ALL))
"""


def results_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .selectExpr(
            "'m' || user_id AS model",
            "event_id div 400 AS step",
            "CASE event_type WHEN 'view' THEN 'val_msssim_loss.None' WHEN 'signup' THEN 'val_mse.None' "
            "WHEN 'click' THEN 'test_msssim_loss' WHEN 'error' THEN 'test_bpp' "
            "ELSE 'val_combined.gamma22' END AS metric",
            "value",
            "event_id",
        )
        .groupBy("model", "step", "metric")
        .agg(F.expr("min(value) AS raw"), F.expr("min(event_id) AS no"))
        .selectExpr(
            "model",
            "step",
            "metric",
            "CASE WHEN no % 97 <> 0 THEN CAST(floor(raw / 5.0D) AS double) / 100.0D END AS value",
        )
    )


# -- per-image results (lineitem) --------------------------------------------------

IMAGE_RESULTS_SQL = """
image_results AS (
  SELECT 'm' || l_suppkey AS model,
    CASE l_returnflag WHEN 'R' THEN 'manproc' WHEN 'A' THEN 'test' ELSE 'val' END AS test,
    l_linenumber * 15000 AS step, 'img' || l_partkey AS image_key,
    l_tax AS msssim_loss, l_quantity / 50.0::DOUBLE AS bpp, l_discount AS mse,
    l_orderkey AS no
  FROM lineitem)
"""


def image_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "'m' || l_suppkey AS model",
        "CASE l_returnflag WHEN 'R' THEN 'manproc' WHEN 'A' THEN 'test' ELSE 'val' END AS test",
        "l_linenumber * 15000 AS step",
        "'img' || l_partkey AS image_key",
        "l_tax AS msssim_loss",
        "l_quantity / 50.0D AS bpp",
        "l_discount AS mse",
        "l_orderkey AS no",
    )


# -- models and definitions (supplier, nation) -------------------------------------

MODELS_SQL = """
models AS (
  SELECT 'm' || s_suppkey AS model, s_suppkey AS position,
    CASE WHEN s_suppkey % 2 = 0 THEN 3 ELSE 4 END AS in_channels,
    CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey % 10 = 0 END AS processed_input,
    CASE WHEN s_suppkey % 3 = 0 THEN 'x_x' END AS data_pairing,
    CASE s_suppkey % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'gamma22' WHEN 2 THEN 'pq' END AS transfer_fun,
    CASE WHEN s_suppkey % 7 = 0 THEN true END AS passthrough,
    CASE WHEN s_suppkey % 11 = 0 THEN false END AS incl_cc,
    CASE s_suppkey % 3 WHEN 0 THEN 'mse' WHEN 1 THEN 'msssim_loss' END AS loss,
    CASE WHEN s_suppkey % 6 = 1 THEN s_acctbal / 100.0::DOUBLE END AS "lambda",
    CASE WHEN s_suppkey % 13 = 0 THEN 'test_msssim_loss' END AS val_key
  FROM supplier)
"""

FILLED_SQL = """
filled AS (
  SELECT model, position, in_channels, coalesce(processed_input, false) AS processed_input,
    false AS preupsample, coalesce(data_pairing, 'x_y') AS data_pairing,
    coalesce(transfer_fun, 'None') AS transfer_fun, false AS morechans, false AS extrapairs_B,
    coalesce(incl_cc, true) AS incl_cc, coalesce(passthrough, false) AS passthrough,
    false AS denoise_then_compress, false AS bm3d, false AS noownpics, 'False' AS JPEGXL,
    loss, "lambda", val_key FROM models)
"""

DEFINITIONS_SQL = """
definitions AS (
  SELECT n_name AS definition,
    CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 4 END AS in_channels,
    n_nationkey % 5 = 0 AS processed_input,
    CASE WHEN n_nationkey % 3 = 0 THEN 'x_x' ELSE 'x_y' END AS data_pairing,
    n_nationkey % 7 = 0 AS passthrough
  FROM nation)
"""


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "'m' || s_suppkey AS model",
        "s_suppkey AS position",
        "CASE WHEN s_suppkey % 2 = 0 THEN 3 ELSE 4 END AS in_channels",
        "CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey % 10 = 0 END AS processed_input",
        "CASE WHEN s_suppkey % 3 = 0 THEN 'x_x' END AS data_pairing",
        "CASE s_suppkey % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'gamma22' WHEN 2 THEN 'pq' END AS transfer_fun",
        "CASE WHEN s_suppkey % 7 = 0 THEN true END AS passthrough",
        "CASE WHEN s_suppkey % 11 = 0 THEN false END AS incl_cc",
        "CASE s_suppkey % 3 WHEN 0 THEN 'mse' WHEN 1 THEN 'msssim_loss' END AS loss",
        "CASE WHEN s_suppkey % 6 = 1 THEN s_acctbal / 100.0D END AS lambda",
        "CASE WHEN s_suppkey % 13 = 0 THEN 'test_msssim_loss' END AS val_key",
    )


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "n_name AS definition",
        "CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 4 END AS in_channels",
        "n_nationkey % 5 = 0 AS processed_input",
        "CASE WHEN n_nationkey % 3 = 0 THEN 'x_x' ELSE 'x_y' END AS data_pairing",
        "n_nationkey % 7 = 0 AS passthrough",
    )


# -- rate-distortion points (part) -------------------------------------------------

POINTS_SQL = """
points AS (
  SELECT p_brand AS "group", p_type AS test, 'p' || p_partkey AS model, 'msssim' AS metric,
    (p_partkey % 40) / 32.0::DOUBLE AS bpp,
    CASE WHEN p_size = 50 THEN 1.0::DOUBLE ELSE (p_size + p_partkey % 40) / 96.0::DOUBLE END AS value,
    p_partkey % 9 = 0 AS strictly_worse
  FROM part)
"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_brand AS group",
        "p_type AS test",
        "'p' || p_partkey AS model",
        "'msssim' AS metric",
        "(p_partkey % 40) / 32.0D AS bpp",
        "CASE WHEN p_size = 50 THEN 1.0D ELSE (p_size + p_partkey % 40) / 96.0D END AS value",
        "p_partkey % 9 = 0 AS strictly_worse",
    )


# -- manifest (documents) ----------------------------------------------------------

MANIFEST_SQL = """
manifest AS (
  SELECT *, folder || CASE WHEN role = 'gt' THEN '/gt/' ELSE '/' END || filename AS path FROM (
    SELECT *,
      'ds/' || CASE WHEN from_bayer THEN 'src/Bayer/' ELSE 'proc/lin_rec2020/' END || image_set AS folder,
      CASE WHEN seq % 23 = 7 THEN 'IMG' || seq % 3 || '.' || ext
        ELSE sensor || '_' || image_set || CASE WHEN role = 'gt' THEN '_GT' ELSE '' END
          || '_ISO' || iso_text || '_no=' || seq || '.' || ext END AS filename
    FROM (
      SELECT doc_id AS seq, text AS content, sha1(text) AS sha1, n_chars,
        CASE WHEN doc_id % 7 = 3 THEN 'X-Trans' ELSE 'Bayer' END AS sensor,
        'set_' || lang || '-' || (doc_id // 20) AS image_set,
        CASE WHEN doc_id % 4 = 0 THEN 'gt' ELSE 'noisy' END AS role,
        doc_id // 20 % 3 > 0 OR doc_id % 2 = 0 AS from_bayer,
        ['cr2', 'ARW', 'nef', 'raf', 'dng', 'CR2', 'xmp', 'txt', 'exr'][doc_id % 9 + 1] AS ext,
        100 * (doc_id % 8 + 1) AS iso_text,
        CASE WHEN doc_id % 11 <> 5 THEN 100 * (doc_id % 8 + 1) END AS iso,
        CASE WHEN doc_id % 6 > 0 THEN ' Camera ' || doc_id % 6 END AS camera,
        1700000000 + n_chars AS mtime, n_chars * 5000 AS size
      FROM documents)))
"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "documents")
        .selectExpr(
            "doc_id AS seq",
            "text AS content",
            "sha1(text) AS sha1",
            "n_chars",
            "CASE WHEN doc_id % 7 = 3 THEN 'X-Trans' ELSE 'Bayer' END AS sensor",
            "'set_' || lang || '-' || (doc_id div 20) AS image_set",
            "CASE WHEN doc_id % 4 = 0 THEN 'gt' ELSE 'noisy' END AS role",
            "doc_id div 20 % 3 > 0 OR doc_id % 2 = 0 AS from_bayer",
            "element_at(array('cr2', 'ARW', 'nef', 'raf', 'dng', 'CR2', 'xmp', 'txt', 'exr'), "
            "CAST(doc_id % 9 + 1 AS int)) AS ext",
            "100 * (doc_id % 8 + 1) AS iso_text",
            "CASE WHEN doc_id % 11 <> 5 THEN 100 * (doc_id % 8 + 1) END AS iso",
            "CASE WHEN doc_id % 6 > 0 THEN ' Camera ' || doc_id % 6 END AS camera",
            "1700000000 + n_chars AS mtime",
            "n_chars * 5000 AS size",
        )
        .selectExpr(
            "*",
            "'ds/' || CASE WHEN from_bayer THEN 'src/Bayer/' ELSE 'proc/lin_rec2020/' END || image_set AS folder",
            "CASE WHEN seq % 23 = 7 THEN 'IMG' || seq % 3 || '.' || ext "
            "ELSE sensor || '_' || image_set || CASE WHEN role = 'gt' THEN '_GT' ELSE '' END "
            "|| '_ISO' || iso_text || '_no=' || seq || '.' || ext END AS filename",
        )
        .selectExpr("*", "folder || CASE WHEN role = 'gt' THEN '/gt/' ELSE '/' END || filename AS path")
    )


CROPS_SQL = """
crops AS (
  SELECT image_set, seq, x, y, 'ds/crops/proc/lin_rec2020/' || image_set || '/' ||
    CASE WHEN role = 'gt' THEN 'gt/' ELSE '' END || filename || '.' || x || '_' || y || '.tif' AS path
  FROM (SELECT *, 768 * (seq % 2) AS y, unnest(range(0, 768 * (seq % 3 + 1), 768)) AS x FROM manifest))
"""


def crops(files: DataFrame) -> DataFrame:
    return files.selectExpr(
        "image_set",
        "seq",
        "role",
        "filename",
        "768 * (seq % 2) AS y",
        "explode(sequence(0L, 768 * (seq % 3), 768L)) AS x",
    ).selectExpr(
        "image_set",
        "seq",
        "'ds/crops/proc/lin_rec2020/' || image_set || '/' || CASE WHEN role = 'gt' THEN 'gt/' ELSE '' END "
        "|| filename || '.' || x || '_' || y || '.tif' AS path",
    )


# -- pair descriptors (lineitem) ---------------------------------------------------

PAIRS_SQL = """
pairs AS (
  SELECT 'scene-' || l_suppkey AS image_set, l_linestatus = 'O' OR l_partkey % 3 > 0 AS is_bayer,
    'ds/src/Bayer/scene-' || l_suppkey || '/gt/g' || l_partkey % 5 || '.cr2' AS gt_fpath,
    'ds/src/Bayer/scene-' || l_suppkey || CASE WHEN l_linenumber = 1 THEN '/gt/g' || l_partkey % 5
      ELSE '/n' || l_orderkey || '_' || l_linenumber END || '.cr2' AS f_fpath,
    CASE WHEN l_orderkey % 50 <> 7 THEN 1 - l_quantity / 100.0::DOUBLE END AS rgb_msssim_score,
    l_tax AS best_alignment_loss, 1 - 3 * l_discount AS mask_mean, l_quantity / 25.0::DOUBLE AS raw_gain,
    l_linenumber % 4 AS n_crops, l_partkey AS partkey, l_orderkey AS orderkey, l_linenumber AS linenumber,
    l_orderkey % 11 - 5 AS dy, l_partkey % 9 - 4 AS dx
  FROM lineitem)
"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Crops come in descending order of x, so that sorting them matters.
    return table(spark, sf_dir, "lineitem").selectExpr(
        "'scene-' || l_suppkey AS image_set",
        "l_linestatus = 'O' OR l_partkey % 3 > 0 AS is_bayer",
        "'ds/src/Bayer/scene-' || l_suppkey || '/gt/g' || l_partkey % 5 || '.cr2' AS gt_fpath",
        "'ds/src/Bayer/scene-' || l_suppkey || CASE WHEN l_linenumber = 1 THEN '/gt/g' || l_partkey % 5 "
        "ELSE '/n' || l_orderkey || '_' || l_linenumber END || '.cr2' AS f_fpath",
        "CASE WHEN l_orderkey % 50 <> 7 THEN 1 - l_quantity / 100.0D END AS rgb_msssim_score",
        "l_tax AS best_alignment_loss",
        "1 - 3 * l_discount AS mask_mean",
        "l_quantity / 25.0D AS raw_gain",
        "transform(slice(array(2, 1, 0), 1, l_linenumber % 4), "
        "i -> struct(768 * i AS x, CAST(768 * (l_partkey % 2) AS int) AS y)) AS crops",
        "l_partkey AS partkey",
        "l_orderkey AS orderkey",
        "l_linenumber AS linenumber",
        "CAST(l_orderkey % 11 - 5 AS int) AS dy",
        "CAST(l_partkey % 9 - 4 AS int) AS dx",
    )


RESERVE_SQL = """
reserve AS (SELECT 'scene-' || s_suppkey AS image_set FROM supplier WHERE s_suppkey % 10 = 3)
"""


def reserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").filter(k % 10 == 3).select(
        F.concat(F.lit("scene-"), k.cast("string")).alias("image_set")
    )


# -- frames (embeddings) -----------------------------------------------------------
# An embedding is an 8x8 frame. `mono` has its 64 samples plus an offset; `rgb` has the
# row, the reversed row and the row read from position 21 on as channels. The first frame
# of a label is the label's clean frame.

OFFSET = 0.6

MONO_SQL = f"""
mono AS (SELECT vec_id AS image_id, label AS image_set, CAST(pos // 8 AS INT) AS y, CAST(pos % 8 AS INT) AS x,
    CAST(embedding[pos + 1] AS DOUBLE) + {OFFSET}::DOUBLE AS v
  FROM (SELECT vec_id, label, embedding, unnest(range(64)) AS pos FROM embeddings))
"""
RGB_SQL = f"""
rgb AS (SELECT vec_id AS image_id, label AS image_set, ch, CAST(pos // 8 AS INT) AS y, CAST(pos % 8 AS INT) AS x,
    CAST(embedding[CASE ch WHEN 0 THEN pos WHEN 1 THEN 63 - pos ELSE (pos + 21) % 64 END + 1] AS DOUBLE)
      + {OFFSET}::DOUBLE AS v
  FROM (SELECT vec_id, label, embedding, unnest(range(64)) AS pos FROM embeddings),
    (SELECT unnest(range(3)) AS ch))
"""
PAIRED_SQL = """
paired AS (SELECT g.gt_id, e.vec_id AS f_id FROM embeddings e
  JOIN (SELECT label, min(vec_id) AS gt_id FROM embeddings GROUP BY label) g ON g.label = e.label)
"""

_SAMPLES = f"transform(embedding, v -> CAST(v AS double) + {OFFSET}D)"


def mono_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS image_id", "label AS image_set", "1 AS c", "8 AS frame_h", "8 AS frame_w", f"{_SAMPLES} AS data"
    )


def rgb_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "embeddings")
        .selectExpr("vec_id AS image_id", "label AS image_set", f"{_SAMPLES} AS m")
        .selectExpr(
            "image_id",
            "image_set",
            "3 AS c",
            "8 AS frame_h",
            "8 AS frame_w",
            "concat(m, reverse(m), slice(m, 22, 43), slice(m, 1, 21)) AS data",
        )
    )


def frame_pairs(frames: DataFrame) -> DataFrame:
    """Every frame with the clean frame of its label."""
    clean = frames.groupBy("image_set").agg(F.min("image_id").alias("gt_id"))
    others = frames.select("image_set", F.col("image_id").alias("f_id"))
    return salted_join(others, clean, ["image_set"], spread=["f_id"]).select("gt_id", "f_id")


# -- captures (embeddings) ---------------------------------------------------------
# Frames of two thirds of the labels are mosaics, the others RGB. Some are black, some have a
# line less than the others, some are missing; each has its own overexposure bound.

STORED_SQL = f"""
stored AS (SELECT image_id, image_set, 0 AS ch, y, x, CASE WHEN image_id % 29 = 28 THEN 0 ELSE v END AS v FROM mono
    WHERE image_set % 3 > 0 AND image_id % 37 <> 36 AND (image_id < 100 OR image_id % 31 <> 30 OR y < 7)
  UNION ALL
  SELECT image_id, image_set, ch, y, x, CASE WHEN image_id % 29 = 28 THEN 0 ELSE v END FROM rgb_stored
    WHERE image_set % 3 = 0 AND image_id % 37 <> 36),
capture_meta AS (SELECT vec_id AS image_id, label % 3 > 0 AS is_bayer,
    0.7::DOUBLE + vec_id % 5 * 0.05::DOUBLE AS overexposure_lb, 0.7::DOUBLE + vec_id % 7 / 100.0::DOUBLE AS m00 FROM embeddings)
"""


def capture_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    mosaic = mono_frames(spark, sf_dir).filter("image_set % 3 > 0")
    short = "image_id >= 100 AND image_id % 31 = 30"
    mosaic = mosaic.withColumns(
        {"frame_h": F.expr(f"IF({short}, 7, 8)"), "data": F.expr(f"IF({short}, slice(data, 1, 56), data)")}
    )
    both = mosaic.unionByName(rgb_frames(spark, sf_dir).filter("image_set % 3 = 0")).filter("image_id % 37 <> 36")
    return both.withColumn("data", F.expr("IF(image_id % 29 = 28, transform(data, v -> 0.0D), data)"))


def capture_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS image_id",
        "label % 3 > 0 AS is_bayer",
        "0.7D + vec_id % 5 * 0.05D AS overexposure_lb",
        "array(array(0.7D + vec_id % 7 / 100.0D, -0.08D, -0.1D), array(-0.44D, 1.25D, 0.2D), array(-0.085D, 0.2D, 0.58D), "
        "array(0.0D, 0.0D, 0.0D)) AS rgb_xyz_matrix",
    )
