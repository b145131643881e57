"""Both images of a pair around each tile, at any shift.

A pair asks for the samples it needs: for every tile of the clean image, the window around it
in the clean image, and the window it meets in the other image under the pair's shift. Each
request names the stored tile that has the samples, so pairs and tiles meet by (image, tile),
one stored tile at a time, and only requested windows travel on to (pair, tile). A wide shift
moves no more samples than a narrow one. An image that many pairs share would send all of a
tile's windows from one task; its requests are spread over salts by their expected bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlake.operators.frames import TILE, window_of
from pairlake.operators.skew import SALT, checked_broadcast
from pairlake.session import checkpointed, shuffle_width

PAIR = ["gt_id", "f_id"]
#: Bytes of windows that one stored tile sends from one task.
SALT_BYTES = 128 << 20
_SAMPLE_BYTES = 8 * 3


def image_frames(tiles: DataFrame) -> DataFrame:
    """(image_id, c, frame_h, frame_w), one row per image; samples are not read."""
    return tiles.groupBy("image_id").agg(*[F.first(n).alias(n) for n in ("c", "frame_h", "frame_w")])


def shared_images(pairs: DataFrame, size: int = TILE, salt_bytes: int = SALT_BYTES) -> DataFrame | None:
    """(image_id, salts) of the images whose tiles many pairs ask for, as a written table; None if there are none."""
    asked = pairs.select(F.explode(F.array(*PAIR)).alias("image_id")).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    salts = F.ceil(F.col("n") * size * size * _SAMPLE_BYTES / salt_bytes).cast("int")
    found = checkpointed(asked.select("image_id", salts.alias("salts")).filter("salts > 1"))
    return None if found.isEmpty() else checked_broadcast(found)


def with_frames(pairs: DataFrame, tiles: DataFrame) -> DataFrame:
    """`pairs` with frame_h and frame_w of the clean image, unless they have them."""
    if {"frame_h", "frame_w"} <= set(pairs.columns):
        return pairs
    return pairs.join(image_frames(tiles).select(F.col("image_id").alias("gt_id"), "frame_h", "frame_w"), "gt_id")


def _window_sql(number: int, image: str, dy: str, dx: str, around: int, size: int) -> str:
    """The lines of `image` within `around` lines of the tile, which is moved back by (dy, dx)."""
    fields = [f"{number} AS side", f"{image} AS image_id"]
    for axis, shift, length in (("y", dy, "frame_h"), ("x", dx, "frame_w")):
        fields.append(f"greatest(t{axis} * {size} - {shift} - {around}, 0) AS {axis}")
        fields.append(f"least(least((t{axis} + 1) * {size}, {length}) - {shift} + {around}, {length}) AS {axis}1")
    return f"struct({', '.join(fields)})"


def requests(pairs: DataFrame, size: int, border: int, reach: int) -> DataFrame:
    """One row per (pair, tile, stored tile): which window (y, x, y1, x1, in frame lines) of which image is needed.

    `side` is 0 for the clean image, with `border` lines around the tile, and 1 for the other,
    with `reach` lines around the tile moved by (dy, dx). Tiles without overlap ask for nothing.
    `pair` has the pair's other columns, `place` the frame's size and the tile.
    """
    carried = ", ".join(f"`{c}`" for c in pairs.columns if c not in (*PAIR, "frame_h", "frame_w"))
    clean = _window_sql(0, "gt_id", "0", "0", border, size)
    other = _window_sql(1, "f_id", "dy", "dx", reach, size)
    # One statement: a plan built call by call costs more than a round of the search.
    return pairs.sparkSession.sql(
        f"""
        SELECT *, explode(sequence(CAST(x div {size} AS int), CAST((x1 - 1) div {size} AS int))) AS tx FROM (
          SELECT *, explode(sequence(CAST(y div {size} AS int), CAST((y1 - 1) div {size} AS int))) AS ty FROM (
            SELECT gt_id, f_id, pair, place, w.* FROM (
              SELECT gt_id, f_id, pair, place, explode(array(clean, other)) AS w FROM (
                SELECT gt_id, f_id, struct({carried}) AS pair, struct(frame_h, frame_w, ty, tx) AS place,
                  {clean} AS clean, {other} AS other
                FROM (SELECT *, explode(sequence(0, CAST(ceil(frame_w / {size}) AS int) - 1)) AS tx
                  FROM (SELECT *, explode(sequence(0, CAST(ceil(frame_h / {size}) AS int) - 1)) AS ty FROM {{pairs}})))
              WHERE other.y < other.y1 AND other.x < other.x1)))""",
        pairs=pairs,
    )


def pair_windows(
    pairs: DataFrame,
    tiles: DataFrame,
    border: int,
    reach: int,
    size: int = TILE,
    own: tuple[str, ...] = (),
    salted: bool = True,
    shared: DataFrame | None = None,
) -> DataFrame:
    """One row per (pair, tile) that overlaps: the tile's place, `gt_parts` and `f_parts`.

    `pairs` has gt_id, f_id, dy, dx (clean line y shows what the other shows at y - dy); its
    other columns come along. `own` names columns of `tiles` that the clean tile brings.
    Callers that know `shared_images` of their pairs pass it, with `salted` off to count no more.
    """
    # A pair is a few bytes and asks for many windows: files hold them in too few splits for all tasks.
    pairs = with_frames(pairs, tiles).repartition(shuffle_width(tiles.sparkSession), *PAIR)
    asked = requests(pairs, size, border, reach)
    stored = tiles.select("image_id", "c", "ty", "tx", "y0", "x0", "h", "w", "data", *own)
    keys = "image_id, ty, tx"
    if shared is None and salted:
        shared = shared_images(pairs, size)
    if shared is not None:
        salts = F.coalesce(F.col("salts"), F.lit(1))
        asked = asked.join(shared, "image_id", "left").withColumn(SALT, F.pmod(F.xxhash64(*PAIR), salts).cast("int"))
        stored = stored.join(shared, "image_id", "left").withColumn(SALT, F.explode(F.sequence(F.lit(0), salts - 1)))
        keys += f", {SALT}"
    cut = window_of("data", "c", "h", "w", "wy", "wx", "wh", "ww")
    mine = "side = 0 AND ty = place.ty AND tx = place.tx"
    sent = pairs.sparkSession.sql(
        f"""
        SELECT gt_id, f_id, pair, place, side, c, {"".join(f"CASE WHEN {mine} THEN `{n}` END AS `{n}`, " for n in own)}
          struct(y0 + wy AS y, x0 + wx AS x, wh AS h, ww AS w, CASE WHEN wh = h AND ww = w THEN data ELSE {cut} END AS data) AS part
        FROM (SELECT *, greatest(y - y0, 0) AS wy, greatest(x - x0, 0) AS wx,
            least(y1 - y0, h) - greatest(y - y0, 0) AS wh, least(x1 - x0, w) - greatest(x - x0, 0) AS ww
          FROM {{asked}} JOIN {{stored}} USING ({keys}))""",
        asked=asked,
        stored=stored,
    )
    # A fixed width: kernels do far more work per byte than the optimiser's size targets assume.
    sent = sent.repartition(shuffle_width(pairs.sparkSession), *PAIR, "place")
    return pairs.sparkSession.sql(
        f"""
        SELECT gt_id, f_id, pair.*, place.*, c, gt_parts, f_parts, {"".join(f"`{n}`, " for n in own)}
          place.ty * {size} AS y0, place.tx * {size} AS x0,
          least({size}, place.frame_h - place.ty * {size}) AS h, least({size}, place.frame_w - place.tx * {size}) AS w
        FROM (SELECT gt_id, f_id, place, first(pair) AS pair, first(c) AS c,
            {"".join(f"first(`{n}`, true) AS `{n}`, " for n in own)}
            collect_list(CASE WHEN side = 0 THEN part END) AS gt_parts, collect_list(CASE WHEN side = 1 THEN part END) AS f_parts
          FROM {{sent}} GROUP BY gt_id, f_id, place)""",
        sent=sent,
    )
