"""Result analytics over the given tables."""

from pyspark.sql import functions as F

from pairlake.operators import results as R
from pairlake.plans import tables as T
from pairlake.plans.common import query, table

PATIENCE = 3
MULTIPLIER = 0.5


@query(
    "mean_results",
    "model:s test:s step:i metric:s value:d",
    f"""WITH {T.IMAGE_RESULTS_SQL}
    SELECT model, test, step, metric, avg(value) AS value FROM (
      SELECT model, test, step, 'msssim_loss' AS metric, msssim_loss AS value FROM image_results
      UNION ALL SELECT model, test, step, 'bpp', bpp FROM image_results
      UNION ALL SELECT model, test, step, 'mse', mse FROM image_results) GROUP BY ALL""",
)
def mean_results(spark, sf):
    long = T.image_results(spark, sf).unpivot(
        ["model", "test", "step"], ["msssim_loss", "bpp", "mse"], "metric", "value"
    )
    return R.mean_results(long)


@query(
    "combined_loss",
    "model:s test:s step:i bpp:d msssim_loss:d combined:d",
    f"""WITH {T.IMAGE_RESULTS_SQL}
    SELECT model, test, step, avg(bpp) AS bpp, avg(msssim_loss) AS msssim_loss,
      avg(bpp + 32 * msssim_loss) AS combined FROM image_results GROUP BY ALL""",
)
def combined_loss(spark, sf):
    return R.combined_loss(T.image_results(spark, sf), F.lit(32.0))


_BEST = """best AS (
  SELECT model, metric, arg_min(step, (value, step)) AS best_step, min(value) AS best_value
  FROM results WHERE value IS NOT NULL GROUP BY ALL)"""


@query(
    "best_step",
    "model:s metric:s best_step:i best_value:d",
    f"WITH {T.RESULTS_SQL}, {_BEST} SELECT * FROM best",
)
def best_step(spark, sf):
    return R.best_step(T.results_long(spark, sf))


# Bands of a score per image: at least, at most, and a part between.
BANDS = {"ge0.8": (0.8, None), "le0.4": (None, 0.4), "mid": (0.4, 0.8)}


@query(
    "banded_best_step",
    "model:s metric:s best_step:i best_value:d",
    f"""WITH {T.IMAGE_RESULTS_SQL},
    scores AS (SELECT 'img' || p_partkey AS image_key, CASE WHEN p_partkey % 13 > 0 THEN p_size / 50.0::DOUBLE END AS score FROM part),
    banded AS (SELECT r.*, band FROM image_results r JOIN scores s USING (image_key)
      JOIN (VALUES ('ge0.8', 0.8::DOUBLE, 9), ('le0.4', -9, 0.4::DOUBLE), ('mid', 0.4::DOUBLE, 0.8::DOUBLE)) AS b(band, lo, hi)
      ON s.score >= lo AND s.score <= hi),
    long AS (SELECT model, step, band || '_bpp' AS metric, avg(bpp) AS value FROM banded GROUP BY ALL
      UNION ALL SELECT model, step, band || '_msssim_loss', avg(msssim_loss) FROM banded GROUP BY ALL),
    results AS (SELECT model, step, metric, round(value, 9) AS value FROM long), {_BEST}
    SELECT * FROM best""",
)
def banded_best_step(spark, sf):
    scores = table(spark, sf, "part").selectExpr(
        "'img' || p_partkey AS image_key", "CASE WHEN p_partkey % 13 > 0 THEN p_size / 50.0D END AS score"
    )
    banded = R.banded_results(T.image_results(spark, sf), scores, BANDS, ["bpp", "msssim_loss"])
    # Means of equal values may differ in their last bits; ties go by step.
    return R.best_step(banded.withColumn("value", F.round("value", 9)))


@query(
    "best_step_warmup_nonzero",
    "model:s metric:s best_step:i best_value:d",
    f"""WITH {T.RESULTS_SQL}
    SELECT model, metric, arg_min(step, (-value, step)) AS best_step, max(value) AS best_value
    FROM results WHERE value IS NOT NULL AND value <> 0 AND step >= 4 GROUP BY ALL""",
)
def best_step_warmup_nonzero(spark, sf):
    return R.best_step(T.results_long(spark, sf), minimize=False, warmup=4, rm_none=True)


@query(
    "best_step_values",
    "model:s step:i metric:s value:d",
    f"""WITH {T.RESULTS_SQL}, {_BEST}
    SELECT r.model, r.step, r.metric, r.value FROM results r JOIN best b
      ON r.model = b.model AND r.step = b.best_step
    WHERE b.metric = 'val_msssim_loss.None' AND r.value IS NOT NULL""",
)
def best_step_values(spark, sf):
    return R.best_step_values(T.results_long(spark, sf), "val_msssim_loss.None")


@query(
    "best_step_set",
    "model:s step:i",
    f"WITH {T.RESULTS_SQL}, {_BEST} SELECT DISTINCT model, best_step AS step FROM best",
)
def best_step_set(spark, sf):
    return R.best_step_set(T.results_long(spark, sf))


@query(
    "running_best",
    "model:s metric:s step:i value:d best_so_far:d improved:b",
    f"""WITH {T.RESULTS_SQL}
    SELECT model, metric, step, value,
      min(value) OVER (PARTITION BY model, metric ORDER BY step) AS best_so_far,
      value < coalesce(min(value) OVER (PARTITION BY model, metric ORDER BY step
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e300) AS improved
    FROM results WHERE value IS NOT NULL""",
)
def running_best(spark, sf):
    return R.running_best(T.results_long(spark, sf))


@query(
    "plateau_schedule",
    "model:s step:i cuts:i factor:d",
    f"""WITH RECURSIVE {T.RESULTS_SQL},
    flagged AS (SELECT model, step, value <= min(value) OVER (
        PARTITION BY model, metric ORDER BY step) AS improved
      FROM results WHERE value IS NOT NULL),
    steps AS (SELECT model, step, bool_or(improved) AS improved,
        row_number() OVER (PARTITION BY model ORDER BY step) AS rn
      FROM flagged GROUP BY model, step),
    walk AS (
      SELECT model, 0::BIGINT AS rn, -1::BIGINT AS step, {PATIENCE}::BIGINT AS deadline, false AS cut, 0 AS cuts
      FROM steps WHERE rn = 1
      UNION ALL
      SELECT s.model, s.rn, s.step,
        CASE WHEN s.improved OR s.step > w.deadline THEN s.step + {PATIENCE} ELSE w.deadline END,
        NOT s.improved AND s.step > w.deadline,
        w.cuts + CASE WHEN NOT s.improved AND s.step > w.deadline THEN 1 ELSE 0 END
      FROM walk w JOIN steps s ON s.model = w.model AND s.rn = w.rn + 1)
    SELECT model, step, cuts, pow({MULTIPLIER * MULTIPLIER}::DOUBLE, cuts) AS factor FROM walk WHERE cut""",
)
def plateau_schedule(spark, sf):
    return R.plateau_schedule(T.results_long(spark, sf), PATIENCE, MULTIPLIER)


_FILLED_COLUMNS = (
    "model:s in_channels:i processed_input:b preupsample:b data_pairing:s transfer_fun:s morechans:b "
    "extrapairs_B:b incl_cc:b passthrough:b denoise_then_compress:b bm3d:b noownpics:b JPEGXL:s "
    "loss:s lambda:d val_key:s"
)


@query(
    "fill_model_defaults",
    _FILLED_COLUMNS,
    f"WITH {T.MODELS_SQL}, {T.FILLED_SQL} SELECT * FROM filled",
)
def fill_model_defaults(spark, sf):
    return R.fill_model_defaults(T.models(spark, sf))


@query(
    "load_metric_key",
    "model:s load_key:s best_step:i",
    f"""WITH {T.MODELS_SQL}, {T.FILLED_SQL}, {T.RESULTS_SQL}, {_BEST},
    wanted AS (SELECT model, coalesce(val_key,
        CASE WHEN "lambda" IS NULL THEN 'val_' || coalesce(loss, 'msssim_loss') ELSE 'val_combined' END
        || '.' || CASE WHEN processed_input THEN 'arbitraryproc' ELSE transfer_fun END) AS k FROM filled),
    both_keys AS (SELECT model, k, CASE WHEN regexp_matches(k, '\\.[a-zA-Z]')
        THEN regexp_replace(k, '\\.[^.]*$', '') ELSE k || '.None' END AS k2 FROM wanted)
    SELECT w.model, coalesce(a.metric, b.metric) AS load_key, coalesce(a.best_step, b.best_step) AS best_step
    FROM both_keys w LEFT JOIN best a ON a.model = w.model AND a.metric = w.k
      LEFT JOIN best b ON b.model = w.model AND b.metric = w.k2
    WHERE a.metric IS NOT NULL OR b.metric IS NOT NULL""",
)
def load_metric_key(spark, sf):
    return R.load_metric_key(R.fill_model_defaults(T.models(spark, sf)), T.results_long(spark, sf))


@query(
    "losses_to_metrics",
    "model:s step:i metric:s value:d",
    f"""WITH {T.RESULTS_SQL},
    both_kinds AS (SELECT model, step, metric, value FROM results
      UNION ALL SELECT model, step, replace(metric, 'msssim_loss', 'msssim'), 1 - value
      FROM results WHERE contains(metric, 'msssim_loss'))
    SELECT model, step, CASE WHEN regexp_matches(metric, '\\.[a-zA-Z]')
      THEN regexp_replace(metric, '\\.[^.]*$', '') ELSE metric END AS metric, value FROM both_kinds""",
)
def losses_to_metrics(spark, sf):
    return R.losses_to_metrics(T.results_long(spark, sf))


@query(
    "derive_variants",
    "model:s in_channels:i data_pairing:s denoise_then_compress:b",
    f"""WITH {T.MODELS_SQL}, {T.FILLED_SQL},
    copies AS (SELECT 'm1' || model AS model, in_channels, data_pairing, true AS denoise_then_compress
      FROM filled WHERE data_pairing = 'x_x' AND in_channels = 3 AND NOT contains(model, 'm1'))
    SELECT model, in_channels, data_pairing, denoise_then_compress FROM filled
      WHERE model NOT IN (SELECT model FROM copies)
    UNION ALL SELECT * FROM copies""",
)
def derive_variants(spark, sf):
    filled = R.fill_model_defaults(T.models(spark, sf))
    return R.derive_variants(filled, tag="m1", prefix="m1", flag="denoise_then_compress")


_MATCHED = """matched AS (
  SELECT d.definition, f.model, f.position FROM filled f JOIN definitions d
    ON f.in_channels = d.in_channels AND f.processed_input = d.processed_input
   AND f.data_pairing = d.data_pairing AND f.passthrough = d.passthrough
  WHERE f.passthrough OR contains(f.loss, 'msssim_loss'))"""


@query(
    "match_definitions",
    "definition:s model:s",
    f"WITH {T.MODELS_SQL}, {T.FILLED_SQL}, {T.DEFINITIONS_SQL}, {_MATCHED} SELECT definition, model FROM matched",
)
def match_definitions(spark, sf):
    filled = R.fill_model_defaults(T.models(spark, sf))
    return R.match_definitions(filled, T.definitions(spark, sf), "msssim")


_VALIDATED = """validated AS (
  SELECT m.definition, m.model, m.position, min(r.value) AS value
  FROM matched m JOIN results r ON r.model = m.model
  WHERE r.metric = 'val_msssim_loss.None' AND r.value IS NOT NULL GROUP BY ALL)"""


def _validated(spark, sf):
    matched = R.match_definitions(
        R.fill_model_defaults(T.models(spark, sf)), T.definitions(spark, sf), "msssim"
    )
    best = R.best_step(T.results_long(spark, sf)).filter(F.col("metric") == "val_msssim_loss.None")
    return matched.join(best, "model").select(
        "definition", "model", "position", F.col("best_value").alias("value")
    )


@query(
    "best_per_definition",
    "definition:s model:s value:d",
    f"""WITH {T.MODELS_SQL}, {T.FILLED_SQL}, {T.DEFINITIONS_SQL}, {_MATCHED}, {T.RESULTS_SQL}, {_VALIDATED}
    SELECT definition, arg_min(model, (-value, position)) AS model, max(value) AS value
    FROM validated GROUP BY definition""",
)
def best_per_definition(spark, sf):
    return R.best_per_definition(_validated(spark, sf), "msssim")


@query(
    "best_per_definition_reference",
    "definition:s model:s value:d",
    f"""WITH {T.MODELS_SQL}, {T.FILLED_SQL}, {T.DEFINITIONS_SQL}, {_MATCHED}, {T.RESULTS_SQL}, {_VALIDATED},
    scanned AS (SELECT *, max(value) OVER (PARTITION BY definition ORDER BY position
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen,
      row_number() OVER (PARTITION BY definition ORDER BY value DESC, position) AS place FROM validated)
    SELECT definition, model, value FROM scanned WHERE place = 1 OR value <= seen""",
)
def best_per_definition_reference(spark, sf):
    return R.best_per_definition(_validated(spark, sf), "msssim", mode="reference")


@query(
    "best_model_per_image",
    "image_key:s model:s msssim:d",
    f"""WITH {T.IMAGE_RESULTS_SQL}
    SELECT image_key, arg_min(model, (msssim_loss, model)) AS model, 1 - min(msssim_loss) AS msssim
    FROM image_results GROUP BY image_key""",
)
def best_model_per_image(spark, sf):
    return R.best_model_per_image(T.image_results(spark, sf))


@query(
    "flag_listed",
    "model:s strictly_worse:b",
    f"""WITH {T.MODELS_SQL} SELECT model, model IN (SELECT 'm' || (n_nationkey * 3) FROM nation)
      AS strictly_worse FROM models""",
)
def flag_listed(spark, sf):
    listed = table(spark, sf, "nation").select(
        F.concat(F.lit("m"), (F.col("n_nationkey") * 3).cast("string")).alias("model")
    )
    return R.flag_listed(T.models(spark, sf).select("model"), listed)


RULES = (
    ("Brand#1", "PROMO", None, "exact"),
    ("Brand#2", "ECON", "msssim", "substring"),
    ("#13", "", None, "substring"),
    ("Brand#5", "", "mse", "exact"),
    ("Brand#7", "", "msssim", "exact"),
)


@query(
    "apply_exclusions",
    "grp:s test:s model:s bpp:d value:d",
    f"""WITH {T.POINTS_SQL} SELECT "group" AS grp, test, model, bpp, value FROM points WHERE NOT (
      ("group" = 'Brand#1' AND test = 'PROMO')
      OR (contains("group", 'Brand#2') AND contains(test, 'ECON') AND metric = 'msssim')
      OR contains("group", '#13')
      OR ("group" = 'Brand#5' AND metric = 'mse')
      OR ("group" = 'Brand#7' AND metric = 'msssim'))""",
)
def apply_exclusions(spark, sf):
    return R.apply_exclusions(T.points(spark, sf), RULES).withColumnRenamed("group", "grp")


@query(
    "rd_curve",
    "grp:s model:s bpp:d value:d strictly_worse:b place:i",
    f"""WITH {T.POINTS_SQL} SELECT "group" AS grp, model, bpp, value, strictly_worse,
      CASE WHEN NOT strictly_worse THEN row_number() OVER (
        PARTITION BY "group", strictly_worse ORDER BY bpp, value, model) END AS place FROM points""",
)
def rd_curve(spark, sf):
    return R.rd_curve(T.points(spark, sf)).withColumnRenamed("group", "grp")


@query(
    "drop_strictly_worse",
    "grp:s model:s value:d",
    f"""WITH {T.POINTS_SQL} SELECT "group" AS grp, model, value FROM points p WHERE NOT strictly_worse AND value =
      (SELECT max(value) FROM points q WHERE q."group" = p."group" AND NOT q.strictly_worse)""",
)
def drop_strictly_worse(spark, sf):
    return R.drop_strictly_worse(T.points(spark, sf), "msssim").withColumnRenamed("group", "grp")


@query(
    "drop_strictly_worse_by_x",
    "grp:s model:s x:d value:d",
    f"""WITH {T.POINTS_SQL} SELECT "group" AS grp, model, bpp AS x, value FROM points p WHERE value >= 1 OR value =
      (SELECT max(value) FROM points q WHERE q."group" = p."group" AND q.bpp = p.bpp)""",
)
def drop_strictly_worse_by_x(spark, sf):
    curve = T.points(spark, sf).withColumnRenamed("bpp", "x")
    return R.drop_strictly_worse(curve, "msssim", by_x=True).withColumnRenamed("group", "grp")


@query(
    "pareto_front",
    "grp:s model:s bpp:d value:d dominated:b",
    f"""WITH {T.POINTS_SQL} SELECT "group" AS grp, model, bpp, value, EXISTS (
      SELECT 1 FROM points q WHERE q."group" = p."group" AND q.bpp <= p.bpp AND q.value >= p.value
        AND (q.bpp < p.bpp OR q.value > p.value)) AS dominated FROM points p""",
)
def pareto_front(spark, sf):
    return R.pareto_front(T.points(spark, sf), ["group"]).withColumnRenamed("group", "grp")


PROGRESSIVE_TESTS = [
    "progressive_test_msssim_le_0.97",
    "progressive_test_msssim_le_0.99",
    "progressive_test_msssim_ge_0.5",
    "progressive_test_msssim_ge_0.9",
]
_LADDER = [f"progressive_test_msssim_le_{v:g}" for v in R.PROGRESSIVE_LE] + [
    f"progressive_test_msssim_ge_{v}" for v in (0.5, 0.8, 0.9)
]
_LADDER_SQL = "[" + ", ".join(f"'{name}'" for name in _LADDER) + "]"


@query(
    "progressive_points",
    "model:s metric:s x:d y:d",
    f"""WITH ladder AS (SELECT 'm' || l_suppkey AS model, ({_LADDER_SQL})[l_linenumber] AS metric,
      avg(1 - l_tax) AS value FROM lineitem GROUP BY ALL)
    SELECT y.model, y.metric, x.value AS x, y.value AS y FROM ladder y JOIN ladder x
      ON x.metric = y.metric AND x.model = 'm1' AND y.model <> 'm1'
    WHERE y.metric IN ({", ".join(f"'{t}'" for t in PROGRESSIVE_TESTS)})""",
)
def progressive_points(spark, sf):
    names = F.array(*[F.lit(n) for n in _LADDER])
    ladder = (
        table(spark, sf, "lineitem")
        .groupBy(
            F.concat(F.lit("m"), F.col("l_suppkey").cast("string")).alias("model"),
            F.element_at(names, F.col("l_linenumber")).alias("metric"),
        )
        .agg(F.avg(1 - F.col("l_tax")).alias("value"))
    )
    return R.progressive_points(ladder, "m1", PROGRESSIVE_TESTS)


@query(
    "latest_iteration",
    "base:s idx:i latest:s",
    """WITH RECURSIVE chain AS (
      SELECT DISTINCT 'exp' || (o_orderkey % 701) || '_' || CASE WHEN o_orderkey % 5 > 0
        THEN '-' || (o_orderkey % 5) ELSE '' END AS model, 'exp' || (o_orderkey % 701) || '_' AS base,
        o_orderkey % 5 AS idx, o_orderkey % 701 % 6 <> o_orderkey % 5 AS has_metric,
        (o_orderkey % 701 + o_orderkey % 5) % 3 <> 0 AS has_file FROM orders),
    walk AS (SELECT model, base, idx, has_file FROM chain WHERE idx = 0 AND has_metric
      UNION ALL SELECT c.model, c.base, c.idx, c.has_file FROM walk w JOIN chain c
        ON c.base = w.base AND c.idx = w.idx + 1 WHERE c.has_metric)
    SELECT base, max(idx) AS idx, arg_max(model, idx) AS latest FROM walk WHERE has_file GROUP BY base""",
)
def latest_iteration(spark, sf):
    k = F.col("o_orderkey")
    base = F.concat(F.lit("exp"), (k % 701).cast("string"), F.lit("_"))
    chain = (
        table(spark, sf, "orders")
        .select(
            F.when(k % 5 > 0, F.concat(base, F.lit("-"), (k % 5).cast("string"))).otherwise(base).alias("model"),
            (k % 701 % 6 != k % 5).alias("has_metric"),
            ((k % 701 + k % 5) % 3 != 0).alias("has_file"),
        )
        .distinct()
    )
    return R.latest_iteration(chain)
