"""Gates, score statistics and retention over the given tables."""

from pyspark.sql import functions as F

from pairlake.operators import gates as G
from pairlake.operators import results as R
from pairlake.operators import retention as K
from pairlake.plans import tables as T
from pairlake.plans.common import query, table

_GATE = "best_alignment_loss <= 0.035::DOUBLE AND mask_mean >= 0.8::DOUBLE"
_KEY = "orderkey:i linenumber:i partkey:i"


@query(
    "reserve_split_exact",
    "image_set:s f_fpath:s",
    f"""WITH {T.PAIRS_SQL}, {T.RESERVE_SQL} SELECT image_set, f_fpath FROM pairs
      WHERE image_set NOT IN (SELECT image_set FROM reserve)""",
)
def reserve_split_exact(spark, sf):
    return G.reserve_split(T.pairs(spark, sf), T.reserve(spark, sf), test=False)


@query(
    "reserve_split_substring",
    "image_set:s f_fpath:s",
    f"""WITH {T.PAIRS_SQL} SELECT image_set, f_fpath FROM pairs
      WHERE contains(image_set, 'scene-1') OR contains(image_set, '-33')""",
)
def reserve_split_substring(spark, sf):
    return G.reserve_split(T.pairs(spark, sf), ["scene-1", "-33"], test=True, match="substring")


@query(
    "quality_gate",
    _KEY + " best_alignment_loss:d mask_mean:d",
    f"""WITH {T.PAIRS_SQL} SELECT orderkey, linenumber, partkey, best_alignment_loss, mask_mean
      FROM pairs WHERE {_GATE}""",
)
def quality_gate(spark, sf):
    return G.quality_gate(T.pairs(spark, sf))


@query(
    "bayer_only",
    _KEY,
    f"WITH {T.PAIRS_SQL} SELECT orderkey, linenumber, partkey FROM pairs WHERE is_bayer",
)
def bayer_only(spark, sf):
    return G.bayer_only(T.pairs(spark, sf))


@query(
    "score_band",
    "band:s pairs:i mean_score:d",
    f"""WITH {T.PAIRS_SQL}, scored AS (SELECT * FROM pairs WHERE rgb_msssim_score IS NOT NULL)
    SELECT 'hq' AS band, count(*) AS pairs, avg(rgb_msssim_score) AS mean_score FROM scored
      WHERE rgb_msssim_score >= 0.95::DOUBLE
    UNION ALL SELECT 'middle', count(*), avg(rgb_msssim_score) FROM scored
      WHERE rgb_msssim_score >= 0.6::DOUBLE AND rgb_msssim_score <= 0.85::DOUBLE
    UNION ALL SELECT 'loader_off', count(*), avg(rgb_msssim_score) FROM pairs
    UNION ALL SELECT 'strict_off', count(*), avg(rgb_msssim_score) FROM scored""",
)
def score_band(spark, sf):
    pairs = T.pairs(spark, sf)
    scored = pairs.filter(F.col("rgb_msssim_score").isNotNull())
    bands = {
        "hq": G.score_band(scored, *G.SCORE_BANDS["hq"]),
        "middle": G.score_band(scored, 0.6, 0.85),
        "loader_off": G.score_band(pairs, 0.0, 1.0),
        "strict_off": G.score_band(scored, 0.0, 1.0, mode="strict"),
    }
    figures = [
        band.agg(F.count(F.lit(1)).alias("pairs"), F.avg("rgb_msssim_score").alias("mean_score")).withColumn(
            "band", F.lit(name)
        )
        for name, band in bands.items()
    ]
    out = figures[0]
    for more in figures[1:]:
        out = out.unionByName(more)
    return out


@query(
    "with_usable_crops",
    _KEY + " first_x:i last_x:i n:i",
    f"""WITH {T.PAIRS_SQL} SELECT orderkey, linenumber, partkey,
      CASE n_crops WHEN 1 THEN 1536 WHEN 2 THEN 768 ELSE 0 END AS first_x, 1536 AS last_x, n_crops AS n
    FROM pairs WHERE n_crops > 0""",
)
def with_usable_crops(spark, sf):
    kept = G.with_usable_crops(T.pairs(spark, sf))
    return kept.select(
        "orderkey",
        "linenumber",
        "partkey",
        F.element_at("crops", 1)["x"].alias("first_x"),
        F.element_at("crops", -1)["x"].alias("last_x"),
        F.size("crops").alias("n"),
    )


@query(
    "centre_crop_of_list",
    _KEY + " x:i y:i",
    f"""WITH {T.PAIRS_SQL} SELECT orderkey, linenumber, partkey,
      CASE n_crops WHEN 3 THEN 768 ELSE 1536 END AS x, 768 * (partkey % 2) AS y FROM pairs WHERE n_crops > 0""",
)
def centre_crop_of_list(spark, sf):
    return G.centre_crop_of_list(T.pairs(spark, sf)).select("orderkey", "linenumber", "partkey", "crop.x", "crop.y")


@query(
    "toy",
    _KEY,
    f"""WITH {T.PAIRS_SQL} SELECT orderkey, linenumber, partkey FROM pairs
      WHERE is_bayer AND {_GATE} AND n_crops > 0 ORDER BY ALL LIMIT 25""",
)
def toy(spark, sf):
    accepted = G.with_usable_crops(G.quality_gate(G.bayer_only(T.pairs(spark, sf))))
    return G.toy(accepted, ["orderkey", "linenumber", "partkey"])


_DERIVED = """SELECT image_set, f_lin AS f_linrec2020_fpath, gt_lin AS gt_linrec2020_fpath, gt_lin || '.xmp' AS dt_xmp,
  replace(parent(gt_lin), 'proc/lin_rec2020', 'proc/dt') || '/' || image_set || '_' || leaf(gt_lin)
    || '_aligned_to_' || leaf(f_lin) AS gt_manproc_fpath,
  replace(replace(parent(f_lin), 'proc/lin_rec2020', 'proc/dt'), '/gt', '') || '/' || image_set || '_'
    || leaf(f_lin) || '_aligned_to_' || leaf(gt_lin) AS f_manproc_fpath
FROM (SELECT *, replace(f_fpath, 'src/Bayer', 'proc/lin_rec2020') || '.tif' AS f_lin,
  replace(gt_fpath, 'src/Bayer', 'proc/lin_rec2020') || '.tif' AS gt_lin FROM {source})"""


def _derived(source: str) -> str:
    sql = _DERIVED.replace("{source}", source)
    for side in ("f_lin", "gt_lin"):
        sql = sql.replace(f"parent({side})", f"regexp_replace({side}, '/[^/]*$', '')")
        sql = sql.replace(f"leaf({side})", f"regexp_extract({side}, '[^/]*$')")
    return sql


_PATHS = "image_set:s f_linrec2020_fpath:s gt_linrec2020_fpath:s dt_xmp:s gt_manproc_fpath:s f_manproc_fpath:s"


@query("derive_paths", _PATHS, f"WITH {T.PAIRS_SQL} {_derived('pairs')}")
def derive_paths(spark, sf):
    return G.derive_paths(T.pairs(spark, sf))


@query(
    "manproc_descriptor",
    _PATHS,
    f"""WITH {T.PAIRS_SQL}, {T.RESERVE_SQL}, gated AS (SELECT * FROM pairs WHERE is_bayer AND {_GATE}
      AND image_set IN (SELECT image_set FROM reserve)) {_derived('gated')}""",
)
def manproc_descriptor(spark, sf):
    return G.manproc_descriptor(T.pairs(spark, sf), T.reserve(spark, sf))


@query(
    "manproc_unpaired",
    "image_set:s gt_fpath:s f_fpath:s rgb_msssim_score:d gt_linrec2020_fpath:s dt_xmp:s f_manproc_fpath:s",
    f"""WITH {T.MANIFEST_SQL} SELECT filename AS image_set, path AS gt_fpath, path AS f_fpath,
      1.0::DOUBLE AS rgb_msssim_score, replace(path, 'src/Bayer', 'proc/lin_rec2020') || '.tif' AS gt_linrec2020_fpath,
      replace(path, 'src/Bayer', 'proc/lin_rec2020') || '.tif.xmp' AS dt_xmp,
      replace(replace(path, 'src/Bayer', 'proc/lin_rec2020'), 'proc/lin_rec2020', 'proc/dt') || '.tif' AS f_manproc_fpath
    FROM manifest WHERE from_bayer""",
)
def manproc_unpaired(spark, sf):
    files = T.manifest(spark, sf).filter("from_bayer")
    return G.manproc_unpaired(files.select(F.col("path").alias("bayer_fpath"), F.array().alias("crops")))


@query(
    "threshold_join",
    "threshold:d pairs:i",
    f"""WITH {T.PAIRS_SQL} SELECT t AS threshold, count(*) AS pairs FROM pairs
      JOIN (SELECT unnest([0.85, 0.9, 0.97, 0.99])::DOUBLE AS t) ON rgb_msssim_score <= t GROUP BY t""",
)
def threshold_join(spark, sf):
    joined = G.threshold_join(T.pairs(spark, sf), R.PROGRESSIVE_LE)
    return joined.groupBy("threshold").agg(F.count(F.lit(1)).alias("pairs"))


_RESERVED_PAIRS = f"""{T.PAIRS_SQL}, {T.RESERVE_SQL}, reserved AS (SELECT * FROM pairs
  WHERE image_set IN (SELECT image_set FROM reserve))"""


@query(
    "mean_by_threshold",
    "threshold:d mean_score:d crops:i",
    f"""WITH {_RESERVED_PAIRS} SELECT t AS threshold,
      sum(rgb_msssim_score * n_crops) / sum(n_crops) AS mean_score, sum(n_crops) AS crops
    FROM reserved JOIN (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 1.0])::DOUBLE AS t)
      ON rgb_msssim_score >= t WHERE is_bayer GROUP BY t HAVING sum(n_crops) > 0""",
)
def mean_by_threshold(spark, sf):
    return G.mean_by_threshold(T.pairs(spark, sf), T.reserve(spark, sf), R.PROGRESSIVE_GE, op="ge")


@query(
    "score_histogram",
    "bin:i centre:d pairs:i",
    f"""WITH {T.PAIRS_SQL}, placed AS (SELECT CAST(least(floor((rgb_msssim_score - 0.4::DOUBLE) / 0.05::DOUBLE
        + 1e-9::DOUBLE), 11) AS INT) AS bin FROM pairs WHERE f_fpath <> gt_fpath
        AND rgb_msssim_score >= 0.4::DOUBLE AND rgb_msssim_score <= 1.0::DOUBLE)
    SELECT g.bin, 0.4::DOUBLE + g.bin * 0.05::DOUBLE + 0.025::DOUBLE AS centre, count(p.bin) AS pairs
    FROM (SELECT unnest(range(12)) AS bin) g LEFT JOIN placed p ON p.bin = g.bin GROUP BY g.bin""",
)
def score_histogram(spark, sf):
    return G.score_histogram(T.pairs(spark, sf))


@query(
    "density_histogram",
    "bin:i edge:d density:d",
    f"""WITH {_RESERVED_PAIRS}, scores AS (SELECT coalesce(rgb_msssim_score, 0) AS s FROM reserved),
    span AS (SELECT min(s) AS lo, max(s) AS hi, count(*) AS n FROM scores),
    placed AS (SELECT CAST(least(floor((s - lo) / (hi - lo) * 50), 49) AS INT) AS bin FROM scores, span)
    SELECT g.bin, lo + g.bin * ((hi - lo) / 50) AS edge, count(p.bin) / (n * ((hi - lo) / 50)) AS density
    FROM span, (SELECT unnest(range(50)) AS bin) g LEFT JOIN placed p ON p.bin = g.bin
    GROUP BY g.bin, lo, hi, n""",
)
def density_histogram(spark, sf):
    return G.density_histogram(T.pairs(spark, sf), T.reserve(spark, sf))


_TESTS = K.known_tests("paired")
_MATRIX_MODELS = """typed AS (SELECT model || CASE position % 9 WHEN 4 THEN '_bm3d' WHEN 5 THEN '_preup' ELSE '' END
    AS model, CASE WHEN position % 3 = 1 THEN 'dc' ELSE 'denoise' END AS model_type, in_channels, processed_input
  FROM models)"""
_MATRIX_SQL = f"""{T.MODELS_SQL}, {_MATRIX_MODELS},
inputs AS (SELECT *, CASE WHEN in_channels = 4 THEN 'bayer' WHEN coalesce(processed_input, false) THEN 'proc'
  ELSE 'prgb' END AS input FROM typed WHERE NOT contains(model, 'm13')),
matrix AS (SELECT model, test, test || '_' || model_type || '_' || input || '2'
    || CASE WHEN input = 'bayer' THEN 'prgb' ELSE input END AS test_id,
    CASE WHEN test = 'test_manproc' AND (input <> 'bayer' OR contains(model, 'preup')) THEN 'cpu' ELSE 'gpu' END AS device
  FROM inputs, (SELECT unnest([{", ".join(f"'{t}'" for t in _TESTS)}]) AS test)
  WHERE NOT (contains(test, 'progressive_manproc') AND model_type = 'dc')
    AND NOT (contains(model, 'bm3d') AND test NOT IN ('test_manproc', 'test_progressive_manproc'))
    AND NOT (model_type = 'denoise' AND regexp_matches(test, 'manproc_(playraw|hq|q99|gt)'))
    AND NOT (NOT contains(test, 'manproc') AND coalesce(processed_input, false)))"""


def _matrix(spark, sf):
    typed = T.models(spark, sf).selectExpr(
        "model || CASE position % 9 WHEN 4 THEN '_bm3d' WHEN 5 THEN '_preup' ELSE '' END AS model",
        "CASE WHEN position % 3 = 1 THEN 'dc' ELSE 'denoise' END AS model_type",
        "in_channels",
        "processed_input",
    )
    return K.evaluation_matrix(typed, tests=_TESTS, banned=["m13"])


@query("evaluation_matrix", "model:s test:s test_id:s device:s", f"WITH {_MATRIX_SQL} SELECT * FROM matrix")
def evaluation_matrix(spark, sf):
    return _matrix(spark, sf)


_KNOWN_SQL = """known AS (SELECT DISTINCT 'm' || l_suppkey AS model, CASE l_linenumber WHEN 1 THEN 'manproc_msssim_loss'
    WHEN 2 THEN 'manproc_q99_msssim_loss.None' WHEN 3 THEN 'playraw_msssim_loss.gamma22'
    WHEN 4 THEN 'manproc_bostitch_msssim_loss.pq' ELSE 'manproc_hq_mse' END AS metric
  FROM lineitem WHERE l_suppkey % 2 = 0)"""


@query(
    "pending_evaluations",
    "model:s test:s test_id:s device:s",
    f"""WITH {_MATRIX_SQL}, {_KNOWN_SQL} SELECT * FROM matrix m WHERE NOT EXISTS (SELECT 1 FROM known k
      WHERE k.model = m.model AND k.metric IN (regexp_replace(m.test, '^test_', '') || '_msssim_loss',
        regexp_replace(m.test, '^test_', '') || '_msssim_loss.None',
        regexp_replace(m.test, '^test_', '') || '_msssim_loss.gamma22'))""",
)
def pending_evaluations(spark, sf):
    known = table(spark, sf, "lineitem").selectExpr(
        "'m' || l_suppkey AS model",
        "CASE l_linenumber WHEN 1 THEN 'manproc_msssim_loss' WHEN 2 THEN 'manproc_q99_msssim_loss.None' "
        "WHEN 3 THEN 'playraw_msssim_loss.gamma22' WHEN 4 THEN 'manproc_bostitch_msssim_loss.pq' "
        "ELSE 'manproc_hq_mse' END AS metric",
        # Half of the models have runs without a value: nothing is known of them.
        "CASE WHEN l_suppkey % 2 = 0 THEN 1.0D END AS value",
    )
    return K.pending_evaluations(_matrix(spark, sf), known)


_FILES_SQL = """files AS (SELECT 'm' || o_custkey % 150 AS model, 'iter_' || o_orderkey % 25 ||
    CASE o_orderkey % 4 WHEN 0 THEN '.pt.opt' WHEN 3 THEN '.tif' ELSE '.pt' END AS name,
    CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders)"""


def _files(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "'m' || o_custkey % 150 AS model",
        "'iter_' || o_orderkey % 25 || CASE o_orderkey % 4 WHEN 0 THEN '.pt.opt' WHEN 3 THEN '.tif' "
        "ELSE '.pt' END AS name",
        "CAST(floor(o_totalprice) AS bigint) AS size",
    )


@query(
    "prune_steps",
    "model:s step:i name:s size:i",
    f"""WITH {T.RESULTS_SQL}, {_FILES_SQL}, kept AS (SELECT DISTINCT model, step FROM (
      SELECT model, metric, arg_min(step, (value, step)) AS step FROM results
      WHERE value IS NOT NULL AND starts_with(metric, 'val_') GROUP BY ALL)),
    stored AS (SELECT *, CAST(regexp_extract(name, '\\d+') AS BIGINT) AS step FROM files WHERE name NOT LIKE '%.tif'),
    guarded AS (SELECT DISTINCT k.model FROM kept k
      WHERE EXISTS (SELECT 1 FROM files f WHERE f.model = k.model AND f.name = 'iter_' || k.step || '.pt')
        AND EXISTS (SELECT 1 FROM files f WHERE f.model = k.model AND f.name = 'iter_' || k.step || '.pt.opt'))
    SELECT model, step, name, size FROM stored s WHERE model IN (SELECT model FROM guarded)
      AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.model = s.model AND k.step = s.step)""",
)
def prune_steps(spark, sf):
    return K.prune_steps(_files(spark, sf), T.results_long(spark, sf), "val_")


@query(
    "unreferenced",
    "model:s bytes:i files:i",
    f"""WITH {_FILES_SQL} SELECT model, sum(size) AS bytes, count(*) AS files FROM files
    WHERE name LIKE '%.tif' AND NOT contains(model, 'm4') AND model NOT IN (SELECT 'm' || s_suppkey FROM supplier
      WHERE s_suppkey % 3 = 0) GROUP BY model""",
)
def unreferenced(spark, sf):
    keep = table(spark, sf, "supplier").filter("s_suppkey % 3 = 0").selectExpr("'m' || s_suppkey AS model")
    return K.unreferenced(_files(spark, sf), keep, exclude="M4")


@query(
    "reclaimable",
    "model:s bytes:i gib:d",
    f"""WITH {_FILES_SQL} SELECT model, sum(size) AS bytes, sum(size) / 1073741824.0::DOUBLE AS gib
      FROM files GROUP BY ROLLUP (model)""",
)
def reclaimable(spark, sf):
    return K.reclaimable(_files(spark, sf))


_RUNS_SQL = """runs AS (SELECT CASE o_orderkey % 500 WHEN 3 THEN 'backups' WHEN 4 THEN 'old' ELSE 'r' || o_orderkey END AS name,
    epoch(o_orderdate) + o_orderkey % 86400 AS created,
    CASE WHEN o_orderkey % 3 > 0 THEN epoch(o_orderdate) + o_custkey % 9000 END AS log_time,
    CASE WHEN o_orderkey % 4 > 0 THEN epoch(o_orderdate) + o_custkey % 7000 END AS results_time,
    CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 3 END AS checkpoints, o_custkey % 2 = 0 AS has_val_best,
    epoch(o_orderdate) + 7200 AS clock FROM orders)"""


@query(
    "stalled_runs",
    "name:s created:i",
    f"""WITH {_RUNS_SQL} SELECT name, created FROM runs WHERE name NOT IN ('backups', 'old')
      AND NOT coalesce(checkpoints > 0 AND results_time IS NOT NULL AND (has_val_best OR clock - created < 3600), false)
      AND NOT clock - created < 60 AND NOT coalesce(clock - log_time < 300, false)
      AND NOT coalesce(clock - results_time < 900, false)
      AND NOT coalesce(checkpoints = 0 AND results_time IS NOT NULL AND clock - created < 3600, false)""",
)
def stalled_runs(spark, sf):
    runs = table(spark, sf, "orders").selectExpr(
        "CASE o_orderkey % 500 WHEN 3 THEN 'backups' WHEN 4 THEN 'old' ELSE 'r' || o_orderkey END AS name",
        "unix_seconds(CAST(o_orderdate AS timestamp)) AS day",
        "o_orderkey",
        "o_custkey",
    ).selectExpr(
        "name",
        "day + o_orderkey % 86400 AS created",
        "CASE WHEN o_orderkey % 3 > 0 THEN day + o_custkey % 9000 END AS log_time",
        "CASE WHEN o_orderkey % 4 > 0 THEN day + o_custkey % 7000 END AS results_time",
        "CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 3 END AS checkpoints",
        "o_custkey % 2 = 0 AS has_val_best",
        "day + 7200 AS clock",
    )
    return K.stalled_runs(runs, F.col("clock"))
