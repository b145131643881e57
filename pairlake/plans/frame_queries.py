"""Pair preparation over frames made of the embeddings."""

from pyspark.sql import functions as F

from pairlake.operators import descriptors as D
from pairlake.operators import frames as M
from pairlake.operators import masks as L
from pairlake.operators import preparation as P
from pairlake.operators.gates import quality_gate
from pairlake.plans import tables as T
from pairlake.plans.common import query
from pairlake.session import checkpointed

# Small tiles, so that the 8x8 frames run through tile borders as large images do.
SIZE = 4
REACH = 2
BOUND = 0.95


def _tiles(frames):
    return M.tile_frames(frames, SIZE)


def _stored(frames):
    """Tiles as a written table, which operators read more than once."""
    return checkpointed(_tiles(frames))


def _mono(spark, sf):
    return _tiles(T.mono_frames(spark, sf))


def _rgb(spark, sf):
    return _tiles(T.rgb_frames(spark, sf))


_GAIN_SQL = """means AS (SELECT image_id, avg(v) AS mean FROM {px} GROUP BY image_id),
gained AS MATERIALIZED (SELECT p.gt_id, p.f_id, g.mean / f.mean AS gain FROM paired p
  JOIN means g ON g.image_id = p.gt_id JOIN means f ON f.image_id = p.f_id)"""


@query(
    "gain",
    "gt_id:i f_id:i gain:d",
    f"WITH {T.RGB_SQL}, {T.PAIRED_SQL}, {_GAIN_SQL.format(px='rgb')} SELECT * FROM gained",
)
def gain(spark, sf):
    return P.gain(T.frame_pairs(T.rgb_frames(spark, sf)), _rgb(spark, sf))


def _losses(reach: int) -> str:
    # Two joins with a table between them: one image's samples meet the other's of the same channel.
    return f"""clean AS MATERIALIZED (SELECT q.gt_id, q.f_id, q.gain, a.ch, a.y, a.x, a.v
      FROM gained q JOIN rgb a ON a.image_id = q.gt_id),
    met AS (SELECT a.*, a.y - b.y AS dy, a.x - b.x AS dx, b.v AS other
      FROM clean a JOIN rgb b ON b.image_id = a.f_id AND b.ch = a.ch),
    losses AS MATERIALIZED (SELECT gt_id, f_id, CAST(dy AS INT) AS dy, CAST(dx AS INT) AS dx,
        avg(abs(v - gain * other)) AS loss, sum(v) / sum(other) AS aligned_gain
      FROM met WHERE abs(dy) <= {reach} AND abs(dx) <= {reach}
        AND y >= CASE WHEN dy > 0 THEN dy ELSE abs(dy) % 2 END
        AND y < CASE WHEN dy > 0 THEN 8 - dy % 2 ELSE 8 + dy END
        AND x >= CASE WHEN dx > 0 THEN dx ELSE abs(dx) % 2 END
        AND x < CASE WHEN dx > 0 THEN 8 - dx % 2 ELSE 8 + dx END
      GROUP BY ALL)"""


_ALIGN_SQL = f"""{T.RGB_SQL}, {T.PAIRED_SQL}, {_GAIN_SQL.format(px='rgb')}, {_losses(REACH)},
aligned AS (SELECT l.*, g.gain AS rgb_gain FROM gained g JOIN (
    SELECT *, row_number() OVER (PARTITION BY gt_id, f_id ORDER BY round(loss, 9), abs(dy) + abs(dx), dy, dx) AS place
    FROM losses) l ON l.gt_id = g.gt_id AND l.f_id = g.f_id WHERE place = 1)"""


@query(
    "align_exhaustive",
    "gt_id:i f_id:i dy:i dx:i best_alignment_loss:d rgb_gain:d",
    f"WITH {_ALIGN_SQL} SELECT gt_id, f_id, dy, dx, loss AS best_alignment_loss, rgb_gain FROM aligned",
)
def align_exhaustive(spark, sf):
    return P.align_exhaustive(T.frame_pairs(T.rgb_frames(spark, sf)), _rgb(spark, sf), REACH, SIZE)


# The search's steps: every shift of an 8x8 frame is at hand, and each knows the best of its neighbourhood.
_WALK_SQL = f"""{_losses(7)},
next AS MATERIALIZED (SELECT c.gt_id, c.f_id, c.dy, c.dx, arg_min((n.dy, n.dx, n.loss, n.aligned_gain), (round(n.loss, 9), n.dy, n.dx)) AS b
  FROM losses c JOIN losses n ON n.gt_id = c.gt_id AND n.f_id = c.f_id
    AND abs(n.dy - c.dy) <= 3 AND abs(n.dx - c.dx) <= 3 AND round(n.loss, 9) < round(c.loss, 9)
  GROUP BY ALL),
walk AS (SELECT gt_id, f_id, dy, dx, loss, aligned_gain, 0 AS step FROM losses WHERE dy = 0 AND dx = 0
  UNION ALL SELECT w.gt_id, w.f_id, n.b[1], n.b[2], n.b[3], n.b[4], step + 1 FROM walk w
    JOIN next n ON n.gt_id = w.gt_id AND n.f_id = w.f_id AND n.dy = w.dy AND n.dx = w.dx WHERE w.loss > 0),
ends AS MATERIALIZED (SELECT gt_id, f_id, arg_max(dy, step) AS dy, arg_max(dx, step) AS dx, arg_max(loss, step) AS loss,
    arg_max(aligned_gain, step) AS aligned_gain FROM walk GROUP BY gt_id, f_id),
aligned AS (SELECT e.*, g.gain AS rgb_gain FROM ends e JOIN gained g ON g.gt_id = e.gt_id AND g.f_id = e.f_id)"""


@query(
    "align",
    "gt_id:i f_id:i dy:i dx:i best_alignment_loss:d moving:b",
    f"""WITH RECURSIVE {T.RGB_SQL}, {T.PAIRED_SQL}, {_GAIN_SQL.format(px='rgb')}, {_WALK_SQL}
    SELECT gt_id, f_id, dy, dx, loss AS best_alignment_loss, false AS moving FROM aligned""",
)
def align(spark, sf):
    frames = T.rgb_frames(spark, sf)
    return P.align(T.frame_pairs(frames), _stored(frames), SIZE, max_shift=16)


_LOSSES_SQL = """
overlap AS MATERIALIZED (SELECT q.gt_id, q.f_id, q.aligned_gain, a.ch, a.y, a.x, a.v, a.y - q.dy AS other_y, a.x - q.dx AS other_x
  FROM aligned q JOIN rgb a ON a.image_id = q.gt_id
  WHERE a.y >= CASE WHEN q.dy > 0 THEN q.dy ELSE abs(q.dy) % 2 END
    AND a.y < CASE WHEN q.dy > 0 THEN 8 - q.dy % 2 ELSE 8 + q.dy END
    AND a.x >= CASE WHEN q.dx > 0 THEN q.dx ELSE abs(q.dx) % 2 END
    AND a.x < CASE WHEN q.dx > 0 THEN 8 - q.dx % 2 ELSE 8 + q.dx END),
lossmap AS MATERIALIZED (SELECT a.gt_id, a.f_id, a.y, a.x,
    sum(abs(CASE WHEN a.v > 0 THEN pow(a.v, 1 / 2.2::DOUBLE) ELSE a.v END
      - CASE WHEN b.v > 0 THEN pow(b.v * aligned_gain, 1 / 2.2::DOUBLE) ELSE b.v * aligned_gain END)) AS loss
  FROM overlap a JOIN rgb b ON b.image_id = a.f_id AND b.ch = a.ch AND b.y = a.other_y AND b.x = a.other_x
  GROUP BY ALL),
thresholds AS (SELECT gt_id, f_id, CASE WHEN t = 0 THEN 1 ELSE t END AS threshold FROM (
  SELECT gt_id, f_id, least(0.4::DOUBLE, quantile_cont(loss, 0.9999)) AS t FROM lossmap GROUP BY gt_id, f_id))"""
_LOSSMAP_SQL = f"{_ALIGN_SQL}, {_LOSSES_SQL}"


def _aligned(spark, sf):
    tiles = _stored(T.rgb_frames(spark, sf))
    found = P.align_exhaustive(T.frame_pairs(T.rgb_frames(spark, sf)), tiles, REACH, SIZE)
    return checkpointed(found), tiles


@query(
    "loss_map",
    "gt_id:i f_id:i y:i x:i loss:d",
    f"WITH {_LOSSMAP_SQL} SELECT gt_id, f_id, y, x, loss FROM lossmap",
)
def loss_map(spark, sf):
    found, tiles = _aligned(spark, sf)
    return L.loss_pixels(L.loss_tiles(found, tiles, BOUND, SIZE))


@query("reject_threshold", "gt_id:i f_id:i threshold:d", f"WITH {_LOSSMAP_SQL} SELECT * FROM thresholds")
def reject_threshold(spark, sf):
    found, tiles = _aligned(spark, sf)
    return L.reject_threshold(checkpointed(L.loss_tiles(found, tiles, BOUND, SIZE)))


_OPENED_SQL = """
kept AS MATERIALIZED (SELECT m.gt_id, m.f_id, m.y, m.x, loss < threshold AS good, exposed
  FROM lossmap m JOIN thresholds t ON t.gt_id = m.gt_id AND t.f_id = m.f_id
  JOIN lit e ON e.image_id = m.gt_id AND e.y = m.y AND e.x = m.x),
cross_cells AS (SELECT * FROM (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS t(oy, ox)),
eroded AS MATERIALIZED (SELECT k.gt_id, k.f_id, k.y, k.x, count(*) FILTER (n.good) = 5 AS good
  FROM kept k, cross_cells c JOIN kept n ON n.gt_id = k.gt_id AND n.f_id = k.f_id AND n.y = k.y + oy AND n.x = k.x + ox
  GROUP BY ALL),
opened AS MATERIALIZED (SELECT k.gt_id, k.f_id, k.y, k.x, bool_or(n.good) AND any_value(k.exposed) AS valid
  FROM kept k, cross_cells c JOIN eroded n ON n.gt_id = k.gt_id AND n.f_id = k.f_id AND n.y = k.y + oy AND n.x = k.x + ox
  GROUP BY k.gt_id, k.f_id, k.y, k.x),
masked AS (SELECT gt_id, f_id, avg(valid::INT) AS mask_mean FROM opened GROUP BY ALL)"""
_LIT_SQL = f"lit AS (SELECT image_id, y, x, max(v) < {BOUND} AS exposed FROM rgb GROUP BY ALL)"


@query("pair_mask", "gt_id:i f_id:i y:i x:i valid:b", f"WITH {_LOSSMAP_SQL}, {_LIT_SQL}, {_OPENED_SQL} SELECT * FROM opened")
def pair_mask(spark, sf):
    found, tiles = _aligned(spark, sf)
    return L.mask_pixels(L.pair_masks(found, tiles, BOUND, SIZE))


@query(
    "prepare_pairs",
    "gt_id:i f_id:i dy:i dx:i best_alignment_loss:d rgb_gain:d mask_mean:d",
    f"""WITH RECURSIVE {T.RGB_SQL}, {T.PAIRED_SQL}, {_GAIN_SQL.format(px='rgb')}, {_WALK_SQL}, {_LOSSES_SQL}, {_LIT_SQL}, {_OPENED_SQL}
      SELECT a.gt_id, a.f_id, a.dy, a.dx, a.loss AS best_alignment_loss, a.rgb_gain, m.mask_mean
      FROM aligned a JOIN masked m ON m.gt_id = a.gt_id AND m.f_id = a.f_id
      WHERE a.loss <= 0.2::DOUBLE AND m.mask_mean >= 0.1::DOUBLE""",
)
def prepare_pairs(spark, sf):
    frames = T.rgb_frames(spark, sf)
    described = P.prepare_pairs(T.frame_pairs(frames), _stored(frames), None, BOUND, SIZE)
    return quality_gate(described, max_loss=0.2, min_mask=0.1)


# Captures: pairs whose frames differ, whose other image is black or that lack an image are rejected.
_CHECKED_SQL = f"""{T.MONO_SQL}, {T.RGB_SQL.replace("rgb AS", "rgb_stored AS")}, {T.STORED_SQL}, {T.PAIRED_SQL},
facts AS (SELECT image_id, max(ch) AS c, max(y) AS h, max(x) AS w, avg(v) AS mean FROM stored GROUP BY image_id),
checked AS MATERIALIZED (SELECT p.gt_id, p.f_id, CASE WHEN g.c IS NULL THEN 'missing clean' WHEN f.c IS NULL THEN 'missing other'
    WHEN (g.c, g.h, g.w) <> (f.c, f.h, f.w) THEN 'unequal frames' WHEN f.mean = 0 THEN 'black other' END AS reason,
    CASE WHEN f.mean <> 0 THEN g.mean / f.mean END AS stored_gain
  FROM paired p LEFT JOIN facts g ON g.image_id = p.gt_id LEFT JOIN facts f ON f.image_id = p.f_id)"""
_DEVELOPED_SQL = f"""{_CHECKED_SQL},
sites AS (SELECT *, CASE y % 2 + x % 2 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS site FROM stored WHERE image_set % 3 > 0),
spread AS (SELECT s.image_id, s.site AS ch, s.y + oy AS y, s.x + ox AS x, s.v, oy = 0 AND ox = 0 AS own FROM sites s,
  (SELECT unnest([-1, 0, 1]) AS oy), (SELECT unnest([-1, 0, 1]) AS ox)),
rgb AS MATERIALIZED (SELECT image_id, ch, y, x, coalesce(max(v) FILTER (own), avg(v)) AS v FROM spread
    WHERE y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7 GROUP BY image_id, ch, y, x
  UNION ALL SELECT image_id, ch, y, x, v FROM stored WHERE image_set % 3 = 0),
means AS (SELECT image_id, avg(v) AS mean FROM rgb GROUP BY image_id),
gained AS MATERIALIZED (SELECT p.gt_id, p.f_id, g.mean / f.mean AS gain FROM checked p JOIN means g ON g.image_id = p.gt_id
  JOIN means f ON f.image_id = p.f_id WHERE reason IS NULL),
lit AS (SELECT image_id, y, x, bool_and(v < overexposure_lb) AS exposed FROM stored JOIN capture_meta USING (image_id) GROUP BY ALL)"""


def _described(spark, sf):
    frames = T.capture_frames(spark, sf)
    pairs = T.frame_pairs(T.rgb_frames(spark, sf))
    return D.describe_pairs(pairs, _stored(frames), T.capture_meta(spark, sf), SIZE)


@query(
    "prepare_pairs_bayer",
    "gt_id:i f_id:i is_bayer:b raw_gain:d rgb_gain:d dy:i dx:i best_alignment_loss:d mask_mean:d overexposure_lb:d m00:d",
    f"""WITH RECURSIVE {_DEVELOPED_SQL}, {_WALK_SQL}, {_LOSSES_SQL}, {_OPENED_SQL}
    SELECT a.gt_id, a.f_id, is_bayer, CASE WHEN is_bayer THEN stored_gain END AS raw_gain, a.rgb_gain, a.dy, a.dx,
      a.loss AS best_alignment_loss, m.mask_mean, overexposure_lb, CASE WHEN is_bayer THEN m00 END AS m00
    FROM aligned a JOIN masked m ON m.gt_id = a.gt_id AND m.f_id = a.f_id
    JOIN checked c ON c.gt_id = a.gt_id AND c.f_id = a.f_id JOIN capture_meta t ON t.image_id = a.gt_id""",
)
def prepare_pairs_bayer(spark, sf):
    return _described(spark, sf).accepted.withColumn("m00", F.expr("rgb_xyz_matrix[0][0]"))


@query(
    "rejected_pairs",
    "gt_id:i f_id:i reason:s",
    f"WITH {_CHECKED_SQL} SELECT gt_id, f_id, reason FROM checked WHERE reason IS NOT NULL",
)
def rejected_pairs(spark, sf):
    return _described(spark, sf).rejected
