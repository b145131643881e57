"""Sample mathematics, tile plans and crops over the given tables."""

from pyspark.sql import functions as F

from pairlake.functions import colour as C
from pairlake.functions import geometry as G
from pairlake.operators import choice as H
from pairlake.operators import crops as X
from pairlake.operators import frames as M
from pairlake.operators import masks as L
from pairlake.operators import preparation as P
from pairlake.plans import tables as T
from pairlake.plans.common import query, table
from pairlake.plans.frame_queries import SIZE

_PX = "image_id:i y:i x:i"


def _mono_pixels(spark, sf):
    return M.to_pixels(M.tile_frames(T.mono_frames(spark, sf), SIZE), "image_set", "frame_h", "frame_w")


def _rgb_pixels(spark, sf):
    return M.to_pixels(M.tile_frames(T.rgb_frames(spark, sf), SIZE), "image_set", "frame_h", "frame_w")


# -- transfer curves ---------------------------------------------------------------

# Curves run over negative light too.
_V = "v - 0.7::DOUBLE"


@query(
    "gamma",
    _PX + " g:d g18:d",
    f"""WITH {T.MONO_SQL}, s AS (SELECT image_id, y, x, {_V} AS v FROM mono) SELECT image_id, y, x,
      CASE WHEN v > 0 THEN pow(v, 1 / 2.2::DOUBLE) ELSE v END AS g,
      CASE WHEN v > 0 THEN pow(v, 1 / 1.8::DOUBLE) ELSE v END AS g18 FROM s""",
)
def gamma(spark, sf):
    v = F.col("v") - 0.7
    return _mono_pixels(spark, sf).select("image_id", "y", "x", C.gamma(v).alias("g"), C.gamma(v, 1.8).alias("g18"))


_PQ_SQL = """pq AS (SELECT *, pow((0.8359375::DOUBLE + 18.8515625::DOUBLE * p) / (18.6875::DOUBLE * p + 1), 78.84375::DOUBLE) AS code
  FROM (SELECT *, pow(100 * pow(greatest(e, 0), 2.4::DOUBLE) / 10000, 0.1593017578125::DOUBLE) AS p FROM (
    SELECT *, CASE WHEN light < 0.018::DOUBLE THEN light * 4.5::DOUBLE
      ELSE 1.099::DOUBLE * pow(greatest(light, 0), 0.45::DOUBLE) - 0.099::DOUBLE END AS e
    FROM (SELECT *, 59.5208::DOUBLE * (v - 0.5::DOUBLE) AS light FROM mono))))"""


@query(
    "pq_oetf",
    _PX + " pq:d",
    f"WITH {T.MONO_SQL}, {_PQ_SQL} SELECT image_id, y, x, code AS pq FROM pq",
)
def pq_oetf(spark, sf):
    return _mono_pixels(spark, sf).select("image_id", "y", "x", C.pq_oetf(F.col("v") - 0.5).alias("pq"))


@query(
    "pq_oetf_inverse",
    _PX + " light:d",
    f"WITH {T.MONO_SQL} SELECT image_id, y, x, greatest(v - 0.5::DOUBLE, 0) AS light FROM mono",
)
def pq_oetf_inverse(spark, sf):
    back = C.pq_oetf_inverse(C.pq_oetf(F.col("v") - 0.5))
    return _mono_pixels(spark, sf).select("image_id", "y", "x", back.alias("light"))


@query(
    "srgb_oetf",
    _PX + " plain:d clipped:d",
    f"""WITH {T.MONO_SQL}, s AS (SELECT image_id, y, x, v * 2 - 0.6::DOUBLE AS v FROM mono) SELECT image_id, y, x,
      CASE WHEN v > 0.0031308::DOUBLE THEN 1.055::DOUBLE * pow(v, 1 / 2.4::DOUBLE) - 0.055::DOUBLE
        ELSE v * 12.92::DOUBLE END AS plain,
      CASE WHEN v > 1 THEN 1 WHEN v > 0.0031308::DOUBLE THEN 1.055::DOUBLE * pow(v, 1 / 2.4::DOUBLE) - 0.055::DOUBLE
        WHEN v > 0 THEN v * 12.92::DOUBLE ELSE 0 END AS clipped FROM s""",
)
def srgb_oetf(spark, sf):
    v = F.col("v") * 2 - 0.6
    return _mono_pixels(spark, sf).select(
        "image_id", "y", "x", C.srgb_oetf(v).alias("plain"), C.srgb_oetf(v, clip=True).alias("clipped")
    )


@query(
    "sigmoid_contrast",
    _PX + " s:d",
    f"""WITH {T.MONO_SQL} SELECT image_id, y, x,
      1 / (1 + exp(least(greatest(200 * (0.5::DOUBLE - v), -50), 50))) AS s FROM mono""",
)
def sigmoid_contrast(spark, sf):
    return _mono_pixels(spark, sf).select("image_id", "y", "x", C.sigmoid_contrast(F.col("v"), 200, 0.5).alias("s"))


@query(
    "transfer",
    _PX + " none:d gamma22:d pq:d",
    f"""WITH {T.MONO_SQL}, {_PQ_SQL} SELECT image_id, y, x, v - 0.5::DOUBLE AS none,
      CASE WHEN v > 0.5::DOUBLE THEN pow(v - 0.5::DOUBLE, 1 / 2.2::DOUBLE) ELSE v - 0.5::DOUBLE END AS gamma22,
      code AS pq FROM pq""",
)
def transfer(spark, sf):
    v = F.col("v") - 0.5
    return _mono_pixels(spark, sf).select(
        "image_id", "y", "x", *[C.transfer(n)(v).alias(n.lower()) for n in ("None", "gamma22", "pq")]
    )


@query(
    "normalise_samples",
    "partkey:i bits:i value:d",
    """SELECT p_partkey AS partkey, CASE p_partkey % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END AS bits,
      CASE p_partkey % 3 WHEN 0 THEN p_size / 255.0::DOUBLE WHEN 1 THEN p_partkey / 65535.0::DOUBLE
        ELSE p_retailprice END AS value FROM part""",
)
def normalise_samples(spark, sf):
    stored = table(spark, sf, "part").selectExpr(
        "p_partkey AS partkey",
        "CASE p_partkey % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END AS bits",
        "CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN p_partkey ELSE p_retailprice END AS raw",
    )
    return stored.withColumn("value", C.normalise_sample(F.col("raw"), F.col("bits")))


# -- sensor metadata (part) --------------------------------------------------------

_META_SQL = """meta AS (SELECT p_partkey AS k, [64.0::DOUBLE + p_size, 64, 60.0::DOUBLE + p_size % 5, 64] AS black,
  16383.0::DOUBLE AS white, CASE WHEN p_partkey % 4 > 0 THEN [15000.0::DOUBLE + p_size, 15200, 15400, 15100 + p_size] END
    AS camera_white,
  [2.1::DOUBLE + p_size / 100, 1.25::DOUBLE, 1.6::DOUBLE, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1.2::DOUBLE END] AS wb,
  0.7::DOUBLE + p_size / 200.0::DOUBLE AS m00, 1.25::DOUBLE + p_partkey % 7 / 50.0::DOUBLE AS m11,
  p_size, p_partkey FROM part)"""


def _meta(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS k",
        "array(64.0D + p_size, 64.0D, 60.0D + p_size % 5, 64.0D) AS black",
        "16383.0D AS white",
        "CASE WHEN p_partkey % 4 > 0 THEN array(15000.0D + p_size, 15200.0D, 15400.0D, 15100.0D + p_size) END "
        "AS camera_white",
        "array(2.1D + p_size / 100, 1.25D, 1.6D, CASE WHEN p_partkey % 3 = 0 THEN 0.0D ELSE 1.2D END) AS wb",
        "array(array(0.7D + p_size / 200.0D, -0.08D, -0.1D), array(-0.44D, 1.25D + p_partkey % 7 / 50.0D, 0.2D), "
        "array(-0.085D, 0.2D, 0.58D), array(0.0D, 0.0D, 0.0D)) AS rgb_xyz_matrix",
        "p_size",
        "p_partkey",
    )


@query(
    "black_white_scale",
    "k:i scaled:d bound:d",
    f"""WITH {_META_SQL} SELECT k, (1000 + p_partkey - black[1]) / (white - black[1]) AS scaled,
      least(1, coalesce(least((camera_white[1] - black[1]) / (white - black[1]),
        (camera_white[2] - black[2]) / (white - black[2]), (camera_white[3] - black[3]) / (white - black[3]),
        (camera_white[4] - black[4]) / (white - black[4])), 1)) AS bound FROM meta""",
)
def black_white_scale(spark, sf):
    black = F.col("black")
    return _meta(spark, sf).select(
        "k",
        C.black_white_scale(F.lit(1000) + F.col("p_partkey"), F.element_at(black, 1), F.col("white")).alias("scaled"),
        C.overexposure_bound(black, F.col("white"), F.col("camera_white")).alias("bound"),
    )


@query(
    "normalise_wb",
    "k:i r:d g:d b:d g2:d",
    f"""WITH {_META_SQL} SELECT k, wb[1] / wb[2] AS r, 1 AS g, wb[3] / wb[2] AS b,
      CASE WHEN wb[4] = 0 THEN 1 ELSE wb[4] / wb[2] END AS g2 FROM meta""",
)
def normalise_wb(spark, sf):
    normal = _meta(spark, sf).withColumn("n", C.normalise_wb(F.col("wb")))
    return normal.selectExpr("k", "n[0] AS r", "n[1] AS g", "n[2] AS b", "n[3] AS g2")


@query(
    "apply_wb",
    _PX + " mono:d undone:d plane:d",
    f"""WITH {T.MONO_SQL} SELECT image_id, y, x, v * f AS mono, v / f AS undone, v * f AS plane FROM (SELECT *,
      CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN 2.0::DOUBLE WHEN y % 2 = 0 THEN 1.0::DOUBLE
        WHEN x % 2 = 0 THEN 1.1::DOUBLE ELSE 1.5::DOUBLE END AS f FROM mono)""",
)
def apply_wb(spark, sf):
    balance = F.array(*[F.lit(c) for c in (2.0, 1.0, 1.5, 1.1)])
    y, x, v = F.col("y"), F.col("x"), F.col("v")
    factor = C.mosaic_wb(balance, y, x)
    plane, _, _ = G.plane_of(y, x)
    return _mono_pixels(spark, sf).select(
        "image_id",
        "y",
        "x",
        C.apply_wb(v, factor).alias("mono"),
        C.apply_wb(v, factor, reverse=True).alias("undone"),
        C.apply_wb(v, C.plane_wb(balance, plane, 4)).alias("plane"),
    )


@query(
    "cfa_name",
    "k:i cfa:s",
    """SELECT p_partkey AS k, ['RGGB', 'GBRG', 'BGGR', 'GRBG'][p_partkey % 4 + 1] AS cfa FROM part""",
)
def cfa_name(spark, sf):
    pattern = (
        "element_at(array(array(array(0, 1), array(3, 2)), array(array(3, 2), array(0, 1)), "
        "array(array(2, 3), array(1, 0)), array(array(1, 0), array(2, 3))), CAST(p_partkey % 4 + 1 AS int)) AS pattern"
    )
    patterns = table(spark, sf, "part").selectExpr("p_partkey AS k", pattern)
    return patterns.withColumn("cfa", C.cfa_name(F.col("pattern")))


@query(
    "usable_rect",
    "k:i y:i x:i h:i w:i",
    """WITH raw AS (SELECT p_partkey AS k, 1000 + p_size AS raw_h, 1500 + p_size * 3 AS raw_w, p_partkey % 6 AS top,
        p_partkey % 5 AS lft, 990 + p_size % 9 AS h, 1480 + p_size % 7 AS w, 992 AS ih, 1486 AS iw,
        ['RGGB', 'GBRG', 'BGGR', 'GRBG'][p_partkey % 4 + 1] AS cfa FROM part),
      phased AS (SELECT *, substring(cfa, CAST(top % 2 * 2 + lft % 2 + 1 AS INT), 1) || substring(cfa, CAST(top % 2 * 2 + (lft + 1) % 2 + 1 AS INT), 1)
          || substring(cfa, CAST((top + 1) % 2 * 2 + lft % 2 + 1 AS INT), 1) AS phase FROM raw),
      cut AS (SELECT *, CASE WHEN phase IN ('GBR', 'BGG') THEN 1 ELSE 0 END AS cy,
          CASE WHEN phase IN ('GRB', 'BGG') THEN 1 ELSE 0 END AS cx FROM phased),
      sized AS (SELECT k, top + cy AS y, lft + cx AS x, least(raw_h - top, h, ih) - 2 * cy AS h,
          least(raw_w - lft, w, iw) - 2 * cx AS w FROM cut)
    SELECT k, y, x, h - h % 4 AS h, w - w % 4 AS w FROM sized""",
)
def usable_rect(spark, sf):
    raw = table(spark, sf, "part").selectExpr(
        "p_partkey AS k",
        "struct(1000 + p_size AS raw_height, 1500 + p_size * 3 AS raw_width, 990 + p_size % 9 AS height, "
        "1480 + p_size % 7 AS width, 992 AS iheight, 1486 AS iwidth, CAST(p_partkey % 6 AS int) AS top_margin, "
        "CAST(p_partkey % 5 AS int) AS left_margin) AS sizes",
        "element_at(array('RGGB', 'GBRG', 'BGGR', 'GRBG'), CAST(p_partkey % 4 + 1 AS int)) AS cfa",
    )
    return raw.select("k", G.usable_rect(F.col("sizes"), F.col("cfa")).alias("r")).select("k", "r.*")


@query(
    "to_planes",
    "image_id:i plane:i y:i x:i v:d",
    f"""WITH {T.MONO_SQL} SELECT image_id, y % 2 * 2 + x % 2 AS plane, y // 2 AS y, x // 2 AS x, v FROM mono""",
)
def to_planes(spark, sf):
    plane, y, x = G.plane_of(F.col("y"), F.col("x"))
    return _mono_pixels(spark, sf).select("image_id", plane.alias("plane"), y.alias("y"), x.alias("x"), "v")


@query("to_mosaic", _PX + " v:d", f"WITH {T.MONO_SQL} SELECT image_id, y, x, v FROM mono")
def to_mosaic(spark, sf):
    planes = to_planes(spark, sf)
    y, x = G.mosaic_of(F.col("plane"), F.col("y"), F.col("x"))
    return planes.select("image_id", y.alias("y"), x.alias("x"), "v")


def _matrix_sql(profile) -> str:
    """Rows of profile @ inverse for the metadata matrix, as SQL."""
    m = [["m00", "-0.08::DOUBLE", "-0.1::DOUBLE"], ["-0.44::DOUBLE", "m11", "0.2::DOUBLE"],
         ["-0.085::DOUBLE", "0.2::DOUBLE", "0.58::DOUBLE"]]
    m = [[f"({c})" for c in row] for row in m]

    def minor(i, j):
        (a, b), (c, d) = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
        return f"{'-' if (i + j) % 2 else ''}({m[a][c]} * {m[b][d]} - {m[a][d]} * {m[b][c]})"

    det = " + ".join(f"{m[0][j]} * ({minor(0, j)})" for j in range(3))
    inverse = [[f"({minor(j, i)}) / ({det})" for j in range(3)] for i in range(3)]
    if profile is None:
        return ", ".join(f"{inverse[i][j]} AS c{i}{j}" for i in range(3) for j in range(3))
    return ", ".join(
        " + ".join(f"{profile[i][k]}::DOUBLE * {inverse[k][j]}" for k in range(3)) + f" AS c{i}{j}"
        for i in range(3)
        for j in range(3)
    )


_CELLS = [f"c{i}{j}" for i in range(3) for j in range(3)]


def _matrices(spark, sf, profile):
    made = _meta(spark, sf).select("k", C.colour_matrix(F.col("rgb_xyz_matrix"), profile).alias("m"))
    return made.select("k", *[F.col("m")[i][j].alias(f"c{i}{j}") for i in range(3) for j in range(3)])


_MATRIX_SHAPE = "k:i " + " ".join(f"{c}:d" for c in _CELLS)


@query(
    "colour_matrix",
    _MATRIX_SHAPE,
    f"WITH {_META_SQL} SELECT k, {_matrix_sql(C.XYZ_TO_REC2020)} FROM meta",
)
def colour_matrix(spark, sf):
    return _matrices(spark, sf, "lin_rec2020")


@query("colour_matrix_xyz", _MATRIX_SHAPE, f"WITH {_META_SQL} SELECT k, {_matrix_sql(None)} FROM meta")
def colour_matrix_xyz(spark, sf):
    return _matrices(spark, sf, "xyz")


_RGB_WIDE = """wide AS (SELECT image_id, y, x, max(v) FILTER (ch = 0) AS r, max(v) FILTER (ch = 1) AS g,
  max(v) FILTER (ch = 2) AS b FROM rgb GROUP BY ALL)"""


def _wide(spark, sf):
    """One row per position with r, g, b; the channels of a tile row sit side by side."""
    tiles = M.tile_frames(T.rgb_frames(spark, sf), SIZE)
    return tiles.selectExpr(
        "image_id", "h", "w", "y0", "x0", "data", "posexplode(slice(data, 1, h * w)) AS (pos, r)"
    ).selectExpr(
        "image_id",
        "CAST(y0 + pos div w AS int) AS y",
        "CAST(x0 + pos % w AS int) AS x",
        "r",
        "data[pos + h * w] AS g",
        "data[pos + 2 * h * w] AS b",
    )


@query(
    "apply_matrix",
    _PX + " red:d green:d blue:d",
    f"""WITH {T.RGB_SQL}, {_RGB_WIDE}, {_META_SQL}, mats AS (SELECT k, {_matrix_sql(C.XYZ_TO_REC2020)} FROM meta)
    SELECT image_id, y, x, c00 * r + c01 * g + c02 * b AS red, c10 * r + c11 * g + c12 * b AS green,
      c20 * r + c21 * g + c22 * b AS blue FROM wide JOIN mats ON mats.k = image_id""",
)
def apply_matrix(spark, sf):
    made = _meta(spark, sf).select(
        F.col("k").alias("image_id"), C.colour_matrix(F.col("rgb_xyz_matrix"), "lin_rec2020").alias("m")
    )
    rgb = C.apply_matrix([F.col(c) for c in "rgb"], F.col("m"))
    out = zip(rgb, ("red", "green", "blue"))
    known = M.attach_meta(_wide(spark, sf), made, "m").filter("m IS NOT NULL")
    return known.select("image_id", "y", "x", *[c.alias(n) for c, n in out])


@query(
    "rec2020_to_srgb",
    _PX + " red:d green:d blue:d",
    f"""WITH {T.RGB_SQL}, {_RGB_WIDE}, lin AS (SELECT image_id, y, x,
      1.6605::DOUBLE * r + -0.5876::DOUBLE * g + -0.0728::DOUBLE * b AS l0,
      -0.1246::DOUBLE * r + 1.1329::DOUBLE * g + -0.0083::DOUBLE * b AS l1,
      -0.0182::DOUBLE * r + -0.1006::DOUBLE * g + 1.1187::DOUBLE * b AS l2 FROM wide)
    SELECT image_id, y, x, {", ".join(f'''CASE WHEN l{i} > 1 THEN 1 WHEN l{i} > 0.0031308::DOUBLE
      THEN 1.055::DOUBLE * pow(l{i}, 1 / 2.4::DOUBLE) - 0.055::DOUBLE WHEN l{i} > 0 THEN l{i} * 12.92::DOUBLE ELSE 0 END
      AS {n}''' for i, n in enumerate(("red", "green", "blue")))} FROM lin""",
)
def rec2020_to_srgb(spark, sf):
    rgb = C.apply_matrix([F.col(c) for c in "rgb"], C.constant_matrix(C.REC2020_TO_REC709))
    out = zip(rgb, ("red", "green", "blue"))
    return _wide(spark, sf).select("image_id", "y", "x", *[C.srgb_oetf(c, clip=True).alias(n) for c, n in out])


# -- statistics and masks ----------------------------------------------------------


@query(
    "image_stats",
    "image_id:i mean:d std:d total:d",
    f"""WITH {T.RGB_SQL} SELECT image_id, avg(v) AS mean, stddev_samp(v) AS std, sum(v) AS total FROM rgb
      GROUP BY image_id""",
)
def image_stats(spark, sf):
    return M.image_stats(M.tile_frames(T.rgb_frames(spark, sf), SIZE))


@query(
    "mean_rgb",
    "image_id:i gt_rgb_mean:d",
    f"WITH {T.RGB_SQL} SELECT image_id, avg(v) AS gt_rgb_mean FROM rgb WHERE y < 6 AND x < 6 GROUP BY image_id",
)
def mean_rgb(spark, sf):
    pixels = X.crop_to_multiple(_rgb_pixels(spark, sf), 6)
    cropped = pixels.groupBy("image_id").agg(F.avg("v").alias("gt_rgb_mean"))
    return cropped


@query(
    "exposed_mask",
    _PX + " valid:b",
    f"WITH {T.RGB_SQL} SELECT image_id, y, x, max(v) < 0.75::DOUBLE AS valid FROM rgb GROUP BY ALL",
)
def exposed_mask(spark, sf):
    masked = M.exposed_mask(M.tile_frames(T.rgb_frames(spark, sf), SIZE), F.lit(0.75))
    return masked.select("image_id", "y0", "x0", "w", F.posexplode("mask").alias("pos", "valid")).selectExpr(
        "image_id", "y0 + pos div w AS y", "x0 + pos % w AS x", "valid"
    )


def _plane_frames(spark, sf):
    """The mono frames as four half-size planes per row."""
    picks = ", ".join(
        f"transform(sequence(0, 15), i -> data[(i div 4 * 2 + {p // 2}) * 8 + i % 4 * 2 + {p % 2}])" for p in range(4)
    )
    return T.mono_frames(spark, sf).selectExpr(
        "image_id", "image_set", "4 AS c", "4 AS frame_h", "4 AS frame_w", f"concat({picks}) AS data"
    )


@query(
    "exposed_mask_from_planes",
    _PX + " valid:b",
    f"""WITH {T.MONO_SQL}, cells AS (SELECT image_id, y // 2 AS cy, x // 2 AS cx, max(v) AS top FROM mono GROUP BY ALL)
    SELECT m.image_id, m.y, m.x, top < 0.75::DOUBLE AS valid FROM mono m JOIN cells c
      ON c.image_id = m.image_id AND c.cy = m.y // 2 AND c.cx = m.x // 2""",
)
def exposed_mask_from_planes(spark, sf):
    tiles = M.tile_frames(_plane_frames(spark, sf), 2)
    masked = M.exposed_mask_from_planes(tiles, F.lit(0.75))
    return masked.select("image_id", "y0", "x0", "w", F.posexplode("mask").alias("pos", "valid")).selectExpr(
        "image_id", "2 * y0 + pos div (2 * w) AS y", "2 * x0 + pos % (2 * w) AS x", "valid"
    )


@query(
    "exposure_ok",
    "image_id:i bad_share:d ok:b",
    f"""WITH {T.MONO_SQL}, cells AS (SELECT image_id, max(v) AS top FROM mono GROUP BY image_id, y // 2, x // 2),
    shares AS (SELECT image_id, avg((top >= 0.99::DOUBLE * 0.72::DOUBLE OR top <= 0.62::DOUBLE)::INT) AS bad_share
      FROM cells GROUP BY image_id) SELECT image_id, bad_share, bad_share <= 0.4::DOUBLE AS ok FROM shares""",
)
def exposure_ok(spark, sf):
    tiles = M.tile_frames(_plane_frames(spark, sf), 2)
    return M.exposure_ok(tiles, F.lit(0.72), underexposed=0.62, share=0.4)


@query(
    "gray_world",
    "image_id:i ch:i y:i x:i v:d",
    f"""WITH {T.RGB_SQL}, means AS (SELECT image_id, ch, avg(least(greatest(v, 0), 1)) AS m FROM rgb GROUP BY ALL),
    goals AS (SELECT image_id, avg(m) AS k FROM means GROUP BY image_id)
    SELECT r.image_id, r.ch, r.y, r.x, r.v * k / m AS v FROM rgb r JOIN means USING (image_id, ch)
      JOIN goals USING (image_id)""",
)
def gray_world(spark, sf):
    return M.to_pixels(M.gray_world(M.tile_frames(T.rgb_frames(spark, sf), SIZE)))


@query(
    "log_tonemap",
    _PX + " red:d green:d blue:d",
    f"""WITH {T.RGB_SQL}, {_RGB_WIDE},
    yuv AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS l FROM wide),
    curve AS (SELECT *, ln(greatest(1 + l, 0.001::DOUBLE)) / ln(1 + max(l) OVER (PARTITION BY image_id) + 0.001::DOUBLE)
      AS t FROM yuv),
    mapped AS (SELECT *, (t - min(t) OVER (PARTITION BY image_id)) / (max(t) OVER (PARTITION BY image_id)
      - min(t) OVER (PARTITION BY image_id)) AS n FROM curve)
    SELECT image_id, y, x, n + r - l AS red, n + g - l AS green, n + b - l AS blue FROM mapped""",
)
def log_tonemap(spark, sf):
    tiles = M.log_tonemap(M.tile_frames(T.rgb_frames(spark, sf), SIZE))
    return tiles.selectExpr(
        "image_id", "h", "w", "y0", "x0", "data", "posexplode(slice(data, 1, h * w)) AS (pos, red)"
    ).selectExpr(
        "image_id", "y0 + pos div w AS y", "x0 + pos % w AS x", "red",
        "data[pos + h * w] AS green", "data[pos + 2 * h * w] AS blue",
    )


@query(
    "variant_difference",
    "algorithm:s loss:d",
    f"""WITH {T.RGB_SQL}, losses AS (SELECT CASE WHEN image_id % 2 = 0 THEN 'even' ELSE 'odd' END AS algorithm, image_id,
      avg(abs(v - v * v)) AS loss FROM rgb GROUP BY image_id)
    SELECT algorithm, avg(loss) AS loss FROM losses GROUP BY ROLLUP (algorithm)""",
)
def variant_difference(spark, sf):
    variants = M.tile_frames(T.rgb_frames(spark, sf), SIZE).selectExpr(
        "CASE WHEN image_id % 2 = 0 THEN 'even' ELSE 'odd' END AS algorithm",
        "image_id",
        "data AS left",
        "transform(data, v -> v * v) AS right",
    )
    return M.variant_difference(variants)


# -- neighbourhood filters ---------------------------------------------------------


@query(
    "demosaic_bilinear",
    "image_id:i ch:i y:i x:i v:d",
    f"""WITH {T.MONO_SQL}, sites AS (SELECT *, CASE y % 2 + x % 2 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS ch FROM mono),
    spread AS (SELECT s.image_id, s.ch, s.y + oy AS y, s.x + ox AS x, s.v, oy = 0 AND ox = 0 AS own FROM sites s,
      (SELECT unnest([-1, 0, 1]) AS oy), (SELECT unnest([-1, 0, 1]) AS ox))
    SELECT image_id, ch, y, x, coalesce(max(v) FILTER (own), avg(v)) AS v FROM spread
    WHERE y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7 GROUP BY image_id, ch, y, x""",
)
def demosaic_bilinear(spark, sf):
    tiles = M.tile_frames(T.mono_frames(spark, sf), SIZE)
    return M.to_pixels(P.demosaic_bilinear(tiles, SIZE))


_MIRROR = "CASE WHEN {c} < 0 THEN -({c}) WHEN {c} > 7 THEN 14 - ({c}) ELSE {c} END"


@query(
    "sharpen",
    "image_id:i ch:i y:i x:i v:d",
    f"""WITH {T.RGB_SQL}, taps AS (SELECT o, exp(-o * o / 2.0::DOUBLE) / sum(exp(-o * o / 2.0::DOUBLE)) OVER () AS wt
      FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS o)),
    blurred AS (SELECT a.image_id, a.ch, a.y, a.x, any_value(a.v) AS v, sum(ty.wt * tx.wt * b.v) AS s
      FROM rgb a, taps ty, taps tx, rgb b WHERE b.image_id = a.image_id AND b.ch = a.ch
        AND b.y = {_MIRROR.format(c='a.y + ty.o')} AND b.x = {_MIRROR.format(c='a.x + tx.o')}
      GROUP BY a.image_id, a.ch, a.y, a.x)
    SELECT image_id, ch, y, x, 1.5::DOUBLE * v - 0.5::DOUBLE * s AS v FROM blurred""",
)
def sharpen(spark, sf):
    return M.to_pixels(P.sharpen(M.tile_frames(T.rgb_frames(spark, sf), SIZE), 5, 1.0, SIZE))


@query(
    "enhance_edges",
    "image_id:i ch:i y:i x:i v:d",
    f"""WITH {T.RGB_SQL}, arms AS (SELECT * FROM (VALUES (0, 0, -4), (1, 0, 1), (-1, 0, 1), (0, 1, 1), (0, -1, 1))
      AS t(oy, ox, wt)),
    asked AS MATERIALIZED (SELECT image_id, y, x, wt, {_MIRROR.format(c='y + oy')} AS near_y, {_MIRROR.format(c='x + ox')} AS near_x
      FROM rgb, arms WHERE ch = 2),
    edges AS (SELECT a.image_id, a.y, a.x, sum(wt * b.v) AS lap FROM asked a
      JOIN rgb b ON b.image_id = a.image_id AND b.ch = 2 AND b.y = a.near_y AND b.x = a.near_x GROUP BY ALL)
    SELECT r.image_id, r.ch, r.y, r.x, least(greatest(r.v, 0), 1) + 0.3::DOUBLE * lap AS v
    FROM rgb r JOIN edges e ON e.image_id = r.image_id AND e.y = r.y AND e.x = r.x""",
)
def enhance_edges(spark, sf):
    return M.to_pixels(P.enhance_edges(M.tile_frames(T.rgb_frames(spark, sf), SIZE), 0.3, SIZE))


# -- tile plans and crops ----------------------------------------------------------

_IMAGES_SQL = """images AS (SELECT 'p' || p_partkey AS base, 900 + 53 * p_size AS h, 1000 + 97 * p_size AS w FROM part)"""


def _images(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "'p' || p_partkey AS base", "900 + 53 * p_size AS h", "1000 + 97 * p_size AS w"
    )


@query(
    "plan_tiles",
    "name:s x:i y:i x1:i y1:i",
    f"""WITH {_IMAGES_SQL}, xs AS (SELECT base, h, w, unnest(range(0, greatest(w - w % 16 - 384, 0), 768)) AS x FROM images),
    spots AS (SELECT *, unnest(range(0, greatest(h - h % 16 - 384, 0), 768)) AS y FROM xs)
    SELECT base || '.' || x || '_' || y AS name, x, y, least(x + 1024, w - w % 16) AS x1, least(y + 1024, h - h % 16) AS y1
    FROM spots""",
)
def plan_tiles(spark, sf):
    return X.plan_tiles(_images(spark, sf))


@query(
    "cut_tiles",
    "name:s y:i x:i v:d",
    f"""WITH {T.MONO_SQL}, plan AS (SELECT vec_id, oy, ox FROM embeddings, (SELECT unnest([0, 3]) AS oy),
      (SELECT unnest([0, 3]) AS ox))
    SELECT vec_id || '.' || ox || '_' || oy AS name, y, x, v FROM plan JOIN mono ON image_id = vec_id
      AND y >= oy AND y < oy + 5 AND x >= ox AND x < ox + 5""",
)
def cut_tiles(spark, sf):
    frames = T.mono_frames(spark, sf)
    images = frames.selectExpr("image_id", "explode(array(0, 3)) AS y").selectExpr("*", "explode(array(0, 3)) AS x")
    plan = images.selectExpr("*", "y + 5 AS y1", "x + 5 AS x1", "concat(image_id, '.', x, '_', y) AS name")
    cut = X.cut_tiles(M.tile_frames(frames, SIZE), plan, SIZE)
    return cut.select("name", "y", "x", "w", F.posexplode("data").alias("pos", "v")).selectExpr(
        "name", "y + pos div w AS y", "x + pos % w AS x", "v"
    )


@query(
    "grid_crops",
    "base:s y:i x:i by:i bx:i",
    f"""WITH {_IMAGES_SQL}, ys AS (SELECT *, unnest(range(0, h - 511, 512)) AS y FROM images),
    spots AS (SELECT *, unnest(range(0, w - 511, 512)) AS x FROM ys) SELECT base, y, x, y // 2 AS by, x // 2 AS bx FROM spots""",
)
def grid_crops(spark, sf):
    return X.grid_crops(_images(spark, sf), 512, bayer=True)


@query(
    "grid_crops_whole",
    "base:s ch:i cw:i bh:i",
    f"WITH {_IMAGES_SQL} SELECT base, h - h % 256 AS ch, w - w % 256 AS cw, (h - h % 256) // 2 AS bh FROM images",
)
def grid_crops_whole(spark, sf):
    return X.grid_crops(_images(spark, sf), 0, bayer=True)


@query(
    "centre_crop",
    "base:s y:i x:i",
    f"""WITH {_IMAGES_SQL} SELECT base, h // 2 - 750 - (h // 2 - 750) % 2 AS y, w // 2 - 750 - (w // 2 - 750) % 2 AS x
      FROM images WHERE h >= 1500 AND w >= 1500""",
)
def centre_crop(spark, sf):
    return X.centre_crop(_images(spark, sf), 1500)


_UNIFORM = "('0x' || substring(md5({t}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(
    "random_crops",
    "tile_id:i crop:i attempt:i y:i x:i",
    f"""WITH {T.MONO_SQL}, tries AS (SELECT vec_id AS tile_id, crop, attempt,
        CAST(floor({_UNIFORM.format(t="vec_id || ':7:' || crop || ':' || attempt || ':y'")} * 4) AS INT) AS ry,
        CAST(floor({_UNIFORM.format(t="vec_id || ':7:' || crop || ':' || attempt || ':x'")} * 4) AS INT) AS rx
      FROM embeddings, (SELECT unnest(range(2)) AS crop), (SELECT unnest(range(11)) AS attempt)),
    spots AS (SELECT tile_id, crop, attempt, ry - ry % 2 AS y, rx - rx % 2 AS x FROM tries),
    judged AS (SELECT t.tile_id, t.crop, t.attempt, t.y, t.x, avg((m.v < 0.58::DOUBLE)::INT) AS share FROM spots t
      JOIN mono m ON m.image_id = t.tile_id AND m.y >= t.y AND m.y < t.y + 4 AND m.x >= t.x AND m.x < t.x + 4 GROUP BY ALL),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY tile_id, crop ORDER BY attempt) AS nth FROM judged WHERE share >= 0.5)
    SELECT tile_id, crop, attempt, y, x FROM firsts WHERE nth = 1
      AND tile_id IN (SELECT tile_id FROM firsts WHERE nth = 1 GROUP BY tile_id HAVING count(*) = 2)""",
)
def random_crops(spark, sf):
    tiles = T.mono_frames(spark, sf).selectExpr(
        "image_id AS tile_id", "frame_h AS h", "frame_w AS w", "transform(data, v -> v < 0.58D) AS mask"
    )
    return X.random_crops(tiles, n=2, size=4, seed=7)


_CROPS_SQL = """crops AS (SELECT image_id, c.* FROM (SELECT DISTINCT image_id FROM mono),
  (VALUES (0, 0, 0, 8, 6), (1, 0, 2, 8, 6), (2, 2, 0, 6, 8), (3, 0, 0, 4, 4), (4, 1, 1, 7, 7)) AS c(crop_id, y, x, h, w)
  WHERE (image_id + crop_id) % 3 > 0 OR crop_id = 3)"""


def _crops(spark, sf):
    listed = "inline(array(struct(0, 0, 0, 8, 6), struct(1, 0, 2, 8, 6), struct(2, 2, 0, 6, 8), struct(3, 0, 0, 4, 4), struct(4, 1, 1, 7, 7)))"
    crops = T.mono_frames(spark, sf).selectExpr("image_id", f"{listed} AS (crop_id, y, x, h, w)")
    return crops.filter("(image_id + crop_id) % 3 > 0 OR crop_id = 3")


def _crop_draw(*salts: str) -> str:
    return _UNIFORM.format(t=" || ':' || ".join(["image_id", "'11'", "crop_id", *salts]))


@query(
    "choose_crops",
    "image_id:i crop_id:i turn:i sample:i attempt:i y0:i x0:i",
    f"""WITH {T.MONO_SQL}, {_CROPS_SQL},
    turns AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {_crop_draw("'turn'")}, crop_id) - 1 AS turn FROM crops),
    tries AS (SELECT *, CAST(floor({_crop_draw("sample", "attempt", "'y'")} * (h - 4)) AS INT) AS ry,
        CAST(floor({_crop_draw("sample", "attempt", "'x'")} * (w - 4)) AS INT) AS rx
      FROM turns, (SELECT unnest(range(2)) AS sample), (SELECT unnest(range(3)) AS attempt) WHERE h > 4 AND w > 4),
    spots AS (SELECT image_id, crop_id, turn, sample, attempt, y + ry - ry % 2 AS y0, x + rx - rx % 2 AS x0 FROM tries),
    judged AS (SELECT s.*, avg((m.v < 0.56::DOUBLE)::INT) AS share FROM spots s JOIN mono m ON m.image_id = s.image_id
      AND m.y >= s.y0 AND m.y < s.y0 + 4 AND m.x >= s.x0 AND m.x < s.x0 + 4 GROUP BY ALL),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY image_id, crop_id, sample ORDER BY attempt) AS nth FROM judged WHERE share >= 0.5),
    usable AS (SELECT image_id, min(turn) AS turn FROM
      (SELECT image_id, turn FROM firsts WHERE nth = 1 GROUP BY image_id, turn HAVING count(*) = 2) GROUP BY image_id)
    SELECT image_id, crop_id, turn, sample, attempt, y0, x0 FROM firsts JOIN usable USING (image_id, turn) WHERE nth = 1""",
)
def choose_crops(spark, sf):
    masks = L.exposure_tiles(M.tile_frames(T.mono_frames(spark, sf), SIZE), 0.56)
    return H.choose_crops(_crops(spark, sf), masks, ["image_id"], n=2, size=4, seed=11, retries=2, tile=SIZE)


@query(
    "middle_crop",
    "image_id:i crop_id:i y0:i x0:i",
    f"""WITH RECURSIVE {T.MONO_SQL}, {_CROPS_SQL},
    walk AS (SELECT image_id, list((x, y, crop_id, h, w) ORDER BY x, y, crop_id) AS l, 0 AS step FROM crops GROUP BY image_id
      UNION ALL SELECT image_id, l[:len(l) // 2] || l[len(l) // 2 + 2:], step + 1 FROM walk
        WHERE len(l) > 0 AND (l[len(l) // 2 + 1][4] < 6 OR l[len(l) // 2 + 1][5] < 6)),
    ends AS (SELECT image_id, arg_max(l, step) AS l FROM walk GROUP BY image_id),
    found AS (SELECT image_id, l[len(l) // 2 + 1] AS c FROM ends WHERE len(l) > 0)
    SELECT image_id, c[3] AS crop_id, c[2] + (c[4] // 2 - 3) - (c[4] // 2 - 3) % 2 AS y0,
      c[1] + (c[5] // 2 - 3) - (c[5] // 2 - 3) % 2 AS x0 FROM found""",
)
def middle_crop(spark, sf):
    return H.middle_crop(_crops(spark, sf), ["image_id"], 6)


@query(
    "crop_to_multiple",
    _PX + " v:d",
    f"WITH {T.MONO_SQL} SELECT image_id, y, x, v FROM mono WHERE y < 6 AND x < 6",
)
def crop_to_multiple(spark, sf):
    return X.crop_to_multiple(_mono_pixels(spark, sf), 3)


@query(
    "patchify",
    "image_id:i patch:i py:i px:i v:d",
    f"""WITH {T.MONO_SQL} SELECT image_id, y // 3 * 2 + x // 3 AS patch, y % 3 AS py, x % 3 AS px, v FROM mono
      WHERE y < 6 AND x < 6""",
)
def patchify(spark, sf):
    return X.patchify(_mono_pixels(spark, sf), 3)


@query("unpatchify", _PX + " v:d", f"WITH {T.MONO_SQL} SELECT image_id, y, x, v FROM mono WHERE y < 6 AND x < 6")
def unpatchify(spark, sf):
    return X.unpatchify(X.patchify(_mono_pixels(spark, sf), 3), 3)


@query(
    "pixel_unshuffle",
    "image_id:i ch:i y:i x:i v:d",
    f"WITH {T.RGB_SQL} SELECT image_id, ch * 4 + y % 2 * 2 + x % 2 AS ch, y // 2 AS y, x // 2 AS x, v FROM rgb",
)
def pixel_unshuffle(spark, sf):
    return X.pixel_unshuffle(_rgb_pixels(spark, sf), 2)


def _pair_pixels(spark, sf):
    return _mono_pixels(spark, sf).selectExpr(
        "image_id AS pair_id", "ch", "y", "x", "v AS a", "v * 0.5D AS b", "frame_h", "frame_w"
    )


@query(
    "pad_pair",
    "pair_id:i y:i x:i a:d b:d",
    f"""WITH {T.MONO_SQL}, canvas AS (SELECT vec_id, y, x FROM embeddings, (SELECT unnest(range(11)) AS y),
      (SELECT unnest(range(11)) AS x))
    SELECT c.vec_id AS pair_id, c.y, c.x, coalesce(v, 0) AS a, coalesce(v * 0.5::DOUBLE, 0) AS b FROM canvas c
      LEFT JOIN mono m ON m.image_id = c.vec_id AND m.y = c.y - 1 AND m.x = c.x - 1""",
)
def pad_pair(spark, sf):
    return X.pad_pair(_pair_pixels(spark, sf), 11)


@query(
    "crop_pair",
    "pair_id:i y:i x:i a:d b:d",
    f"""WITH {T.MONO_SQL} SELECT image_id AS pair_id, y - 1 AS y, x - 1 AS x, v AS a, v * 0.5::DOUBLE AS b FROM mono
      WHERE y BETWEEN 1 AND 5 AND x BETWEEN 1 AND 5""",
)
def crop_pair(spark, sf):
    return X.crop_pair(_pair_pixels(spark, sf), 5)


@query(
    "crop_pair_random",
    "pair_id:i y:i x:i a:d b:d",
    f"""WITH {T.MONO_SQL}, starts AS (SELECT vec_id,
        CAST(floor({_UNIFORM.format(t="vec_id || ':3:y'")} * 4) AS INT) AS sy,
        CAST(floor({_UNIFORM.format(t="vec_id || ':3:x'")} * 4) AS INT) AS sx FROM embeddings)
    SELECT image_id AS pair_id, y - sy AS y, x - sx AS x, v AS a, v * 0.5::DOUBLE AS b FROM mono JOIN starts
      ON vec_id = image_id WHERE y >= sy AND y < sy + 5 AND x >= sx AND x < sx + 5""",
)
def crop_pair_random(spark, sf):
    return X.crop_pair(_pair_pixels(spark, sf), 5, seed=3)


_SHIFTED_SQL = "shifted AS (SELECT *, CAST(f_id % 7 - 3 AS INT) AS dy, CAST(f_id % 5 - 2 AS INT) AS dx FROM paired)"


def _shifted(spark, sf):
    return T.frame_pairs(T.rgb_frames(spark, sf)).selectExpr(
        "*", "CAST(f_id % 7 - 3 AS int) AS dy", "CAST(f_id % 5 - 2 AS int) AS dx"
    )


_OVERLAP_SQL = """a.y >= CASE WHEN dy > 0 THEN dy ELSE abs(dy) % 2 END AND a.y < CASE WHEN dy > 0 THEN 8 - dy % 2 ELSE 8 + dy END
  AND a.x >= CASE WHEN dx > 0 THEN dx ELSE abs(dx) % 2 END AND a.x < CASE WHEN dx > 0 THEN 8 - dx % 2 ELSE 8 + dx END"""
_CORNER_SQL = """a.y - CASE WHEN dy > 0 THEN dy ELSE abs(dy) % 2 END AS y, a.x - CASE WHEN dx > 0 THEN dx ELSE abs(dx) % 2 END AS x"""


@query(
    "shift_pair",
    "gt_id:i f_id:i ch:i y:i x:i a:d b:d",
    f"""WITH {T.RGB_SQL}, {T.PAIRED_SQL}, {_SHIFTED_SQL},
    clean AS MATERIALIZED (SELECT gt_id, f_id, a.ch, {_CORNER_SQL}, a.v, a.y - dy AS other_y, a.x - dx AS other_x
      FROM shifted JOIN rgb a ON a.image_id = gt_id WHERE {_OVERLAP_SQL})
    SELECT gt_id, f_id, c.ch, c.y, c.x, c.v AS a, b.v AS b FROM clean c
    JOIN rgb b ON b.image_id = f_id AND b.ch = c.ch AND b.y = other_y AND b.x = other_x""",
)
def shift_pair(spark, sf):
    pixels = _rgb_pixels(spark, sf)
    return X.shift_pair(pixels, pixels, _shifted(spark, sf))


@query(
    "shift_mask",
    "gt_id:i f_id:i y:i x:i valid:b",
    f"""WITH {T.MONO_SQL}, {T.PAIRED_SQL}, {_SHIFTED_SQL} SELECT gt_id, f_id, {_CORNER_SQL}, a.v < 0.6::DOUBLE AS valid
    FROM shifted JOIN mono a ON a.image_id = gt_id WHERE {_OVERLAP_SQL}""",
)
def shift_mask(spark, sf):
    mask = _mono_pixels(spark, sf).selectExpr("image_id", "y", "x", "v < 0.6D AS valid", "frame_h", "frame_w")
    return X.shift_mask(mask, _shifted(spark, sf))


@query(
    "shift_rectangles",
    "k:i y0:i y1:i x0:i x1:i ty0:i ty1:i tx0:i tx1:i",
    """WITH s AS (SELECT p_partkey AS k, p_size % 13 - 6 AS dy, CAST(p_partkey % 9 - 4 AS INT) AS dx, 200 AS h, 300 AS w,
        CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS d FROM part),
    a AS (SELECT *, CASE WHEN dy > 0 THEN dy ELSE abs(dy) % 2 END AS y0, CASE WHEN dy > 0 THEN h - dy % 2 ELSE h + dy END AS y1,
        CASE WHEN dx > 0 THEN dx ELSE abs(dx) % 2 END AS x0, CASE WHEN dx > 0 THEN w - dx % 2 ELSE w + dx END AS x1,
        CASE WHEN dy < 0 THEN -dy // d + abs(dy) % 2 ELSE 0 END AS ty0,
        CASE WHEN dy < 0 THEN h // d ELSE h // d - dy // d - dy % 2 END AS ty1,
        CASE WHEN dx < 0 THEN -dx // d + abs(dx) % 2 ELSE 0 END AS tx0,
        CASE WHEN dx < 0 THEN w // d ELSE w // d - dx // d - dx % 2 END AS tx1 FROM s)
    SELECT k, y0, y1, x0, x1, ty0, ty1, tx0, tx1 FROM a""",
)
def shift_rectangles(spark, sf):
    shifts = table(spark, sf, "part").selectExpr(
        "p_partkey AS k", "p_size % 13 - 6 AS dy", "CAST(p_partkey % 9 - 4 AS int) AS dx", "p_partkey % 2 = 0 AS bayer"
    )
    rect = G.shift_rectangles(F.col("dy"), F.col("dx"), F.lit(200), F.lit(300), F.col("bayer"))
    return shifts.select("k", rect.alias("r")).select("k", "r.*")


@query(
    "aligned_means",
    "gt_id:i f_id:i gt_rgb_mean:d",
    f"""WITH {T.RGB_SQL}, {T.PAIRED_SQL}, {_SHIFTED_SQL}, spans AS (SELECT *, CASE WHEN dy > 0 THEN dy ELSE abs(dy) % 2 END AS y0,
      CASE WHEN dy > 0 THEN 8 - dy % 2 ELSE 8 + dy END AS y1, CASE WHEN dx > 0 THEN dx ELSE abs(dx) % 2 END AS x0,
      CASE WHEN dx > 0 THEN 8 - dx % 2 ELSE 8 + dx END AS x1 FROM shifted)
    SELECT gt_id, f_id, avg(v) AS gt_rgb_mean FROM spans JOIN rgb ON image_id = gt_id AND y >= y0 AND x >= x0
      AND y < y1 - (y1 - y0) % 3 AND x < x1 - (x1 - x0) % 3 GROUP BY gt_id, f_id""",
)
def aligned_means(spark, sf):
    return P.aligned_means(_shifted(spark, sf), M.tile_frames(T.rgb_frames(spark, sf), SIZE), multiple=3)


@query(
    "sql_functions",
    _PX + " g:d s:d q:d",
    f"""WITH {T.MONO_SQL}, {_PQ_SQL} SELECT image_id, y, x,
      CASE WHEN v > 0.5::DOUBLE THEN pow(v - 0.5::DOUBLE, 1 / 2.2::DOUBLE) ELSE v - 0.5::DOUBLE END AS g,
      CASE WHEN v > 0.5031308::DOUBLE THEN 1.055::DOUBLE * pow(v - 0.5::DOUBLE, 1 / 2.4::DOUBLE) - 0.055::DOUBLE
        ELSE (v - 0.5::DOUBLE) * 12.92::DOUBLE END AS s, code AS q FROM pq""",
)
def sql_functions(spark, sf):
    from pairlake.functions.sql import register_functions

    register_functions(spark)
    _mono_pixels(spark, sf).createOrReplaceTempView("mono_pixels")
    return spark.sql(
        "SELECT image_id, y, x, gamma22(v - 0.5D) AS g, srgb_oetf(v - 0.5D) AS s, pq_oetf(v - 0.5D) AS q FROM mono_pixels"
    )
