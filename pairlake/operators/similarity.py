"""Multi-scale similarity of aligned pairs: small frames in one piece, large ones on a pyramid of tiles.

Pairs of one clean image are dealt to groups of a few megabytes. A group gets the clean frame once and each other frame,
as packed tiles, and scores its pairs one by one; nothing but scores is written.

Where frames are larger than that, each scale is one pass over tiles with the lines that a window needs beyond them. A tile adds
up the similarity maps of the windows that begin in it, and sends on its share of the next,
half as large scale, which is cut into tiles anew. So the samples of a pair move once, and a
third more for all coarser scales; every tile has the same small border at any scale.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlake.operators import kernels as K
from pairlake.operators.batches import map_groups, map_rows
from pairlake.operators.frames import TILE
from pairlake.operators.skew import salted_join, within_rows
from pairlake.operators.windows import PAIR, SALT_BYTES, image_frames, pair_windows
from pairlake.session import SAMPLES, checkpointed, shuffle_width

SCALES = len(K.SSIM_WEIGHTS)
#: Lines that a window reaches beyond its first.
BEYOND = K.SSIM_TAPS - 1
#: A side of this many lines has no window at the coarsest scale.
TOO_SMALL = BEYOND * 2 ** (SCALES - 1)
#: Samples of a frame that a task scores in one piece.
WHOLE = 1 << 19
#: Bytes of other frames that meet their clean frame in one group, and of groups in a partition, which sorts them in memory.
GROUP_BYTES, PARTITION_BYTES = 16 << 20, 128 << 20
#: Rows (image, group), of some 100 bytes, that every executor gets, so that tiles move to their groups at once.
ASKED_ROWS = 250_000

_OUT = (
    "gt_id {t}, f_id {t}, ch int, scale int, cs double, ssim double, n bigint, "
    "c int, y int, x int, h int, w int, whole_h int, whole_w int, a array<double>, b array<double>"
)


def halved(a: np.ndarray, first: int, own: int, whole: int, axis: int) -> tuple[np.ndarray, int]:
    """Means of neighbouring lines along an axis, and the number of the first mean.

    `a` starts at line `first` of `whole` lines; means belong to the tile that owns their first
    line, `own` of which are this tile's. An odd whole gets a line of zeros in front.
    """
    odd = whole % 2
    low = 0 if first == 0 else (first + odd + 1) // 2
    high = (first + own - 1 + odd) // 2
    start, count = 2 * low - odd - first, 2 * (high - low + 1)
    before = max(0, -start)
    cut = [slice(None)] * a.ndim
    cut[axis] = slice(max(0, start), start + count)
    lines = a[tuple(cut)]
    if before:
        pad = [(0, 0)] * a.ndim
        pad[axis] = (before, 0)
        lines = np.pad(lines, pad)
    even, odd_lines = [slice(None)] * a.ndim, [slice(None)] * a.ndim
    even[axis], odd_lines[axis] = slice(0, None, 2), slice(1, None, 2)
    return (lines[tuple(even)] + lines[tuple(odd_lines)]) / 2, low


def _looked_at(r, scale: int, a: np.ndarray, b: np.ndarray, y: int, x: int, h: int, w: int, whole: tuple[int, int]) -> Iterator[tuple]:
    """Sums of the windows that begin in a tile (y, x, h, w), and the tile's share of the next scale.

    `a` and `b` begin at (y, x) and have the lines beyond the tile, as far as the whole goes.
    """
    key = r.gt_id, r.f_id
    if min(a.shape[1:]) >= K.SSIM_TAPS:
        contrast, similar = (m[:, :h, :w] for m in K.similarity_maps(a, b))
        for ch in range(len(a)):
            sums = float(contrast[ch].sum()), float(similar[ch].sum()), contrast[ch].size
            yield (*key, ch, scale, *sums, *[None] * 9)
    if scale + 1 < SCALES:
        both = np.stack([a, b])
        both, top = halved(both, y, h, whole[0], 2)
        both, left = halved(both, x, w, whole[1], 3)
        if both.size:
            size = [(n + 2 * (n % 2)) // 2 for n in whole]
            sent = both.shape[1], top, left, *both.shape[2:], *size, both[0].ravel(), both[1].ravel()
            yield (*key, None, scale + 1, None, None, None, *sent)


def _first_scale(framed: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """The finest scale, on windows of the stored tiles; the overlap is an image of its own."""
    rows = framed.select(*PAIR, "dy", "dx", "aligned_gain", "frame_h", "frame_w")
    kind = dict(rows.dtypes)["gt_id"]

    def run(r: SimpleNamespace) -> Iterator[tuple]:
        (top, bottom), (left, right) = K.overlap(r.dy, r.frame_h), K.overlap(r.dx, r.frame_w)
        y, x = max(r.y0, top), max(r.x0, left)
        h, w = min(r.y0 + r.h, bottom) - y, min(r.x0 + r.w, right) - x
        if h <= 0 or w <= 0 or min(bottom - top, right - left) <= TOO_SMALL:
            return
        reach_h, reach_w = min(h + BEYOND, bottom - y), min(w + BEYOND, right - x)
        a = K.assemble(r.gt_parts, r.c, y, x, reach_h, reach_w)
        b = K.assemble(r.f_parts, r.c, y - r.dy, x - r.dx, reach_h, reach_w) * r.aligned_gain
        yield from _looked_at(r, 0, a, b, y - top, x - left, h, w, (bottom - top, right - left))

    return map_rows(pair_windows(rows, tiles, BEYOND, BEYOND, size), run, _OUT.format(t=kind))


def _next_scale(found: DataFrame, scale: int, size: int) -> DataFrame:
    """A coarser scale from the shares that the finer one sent."""
    spark, kind = found.sparkSession, dict(found.dtypes)["gt_id"]
    sent = spark.sql(
        f"""
        SELECT *, explode(sequence(CAST(greatest(x - {BEYOND}, 0) div {size} AS int), CAST((x + w - 1) div {size} AS int))) AS tx
        FROM (SELECT *, explode(sequence(CAST(greatest(y - {BEYOND}, 0) div {size} AS int), CAST((y + h - 1) div {size} AS int))) AS ty
          FROM {{found}} WHERE a IS NOT NULL)""",
        found=found,
    ).repartition(shuffle_width(spark), *PAIR, "ty", "tx")
    grouped = spark.sql(
        """
        SELECT gt_id, f_id, ty, tx, first(c) AS c, first(whole_h) AS whole_h, first(whole_w) AS whole_w,
          collect_list(struct(y, x, h, w, a AS data)) AS a_parts, collect_list(struct(y, x, h, w, b AS data)) AS b_parts
        FROM {sent} GROUP BY gt_id, f_id, ty, tx""",
        sent=sent,
    )

    def run(r: SimpleNamespace) -> Iterator[tuple]:
        y, x = r.ty * size, r.tx * size
        h, w = min(size, r.whole_h - y), min(size, r.whole_w - x)
        reach = min(h + BEYOND, r.whole_h - y), min(w + BEYOND, r.whole_w - x)
        a, b = (K.assemble(parts, r.c, y, x, *reach) for parts in (r.a_parts, r.b_parts))
        yield from _looked_at(r, scale, a, b, y, x, h, w, (r.whole_h, r.whole_w))

    return map_rows(grouped, run, _OUT.format(t=kind))


def _framed(aligned: DataFrame, tiles: DataFrame) -> DataFrame:
    """Pairs that have a gain and a clean frame, with its size and their group, as a written table."""
    rows = aligned.select(*PAIR, "dy", "dx", "aligned_gain").filter("aligned_gain IS NOT NULL")
    shared = rows.groupBy("gt_id").agg(F.count(F.lit(1)).alias("pairs"))
    frames = image_frames(tiles).withColumnRenamed("image_id", "gt_id").withColumn("samples", F.expr("CAST(c AS bigint) * frame_h * frame_w"))
    framed = salted_join(rows, frames.join(shared, "gt_id"), ["gt_id"], spread=["f_id"])
    groups = F.ceil(F.col("pairs") * F.col("samples") * 8 / GROUP_BYTES)
    return checkpointed(framed.withColumn("group", F.pmod(F.xxhash64("f_id"), groups)).drop("pairs"))


def _packed(tiles: DataFrame) -> DataFrame:
    """Tiles with their samples as compressed bytes: frames that have flat or repeated parts move as a part of their size."""

    def task():
        codec = pa.Codec("zstd", compression_level=1)

        def run(r: SimpleNamespace) -> Iterator[tuple]:
            data = np.ascontiguousarray(r.data, dtype=np.float64)
            yield r.image_id, r.y0, r.x0, r.h, r.w, data.nbytes, codec.compress(data, asbytes=True)

        return run

    kind = dict(tiles.dtypes)["image_id"]
    ddl = f"image_id {kind}, y0 int, x0 int, h int, w int, bytes int, packed binary"
    return map_rows(tiles.select("image_id", "y0", "x0", "h", "w", "data"), task, ddl, per_task=True)


def _part(r: SimpleNamespace, codec: pa.Codec) -> dict:
    data = np.frombuffer(codec.decompress(r.packed, r.bytes), dtype=np.float64)
    return {"y": r.y0, "x": r.x0, "h": r.h, "w": r.w, "data": data}


def _in_one_piece(framed: DataFrame, samples: int, tiles: DataFrame, whole: int) -> DataFrame:
    """Scores of pairs whose frames a task can hold; `samples` is the sum over the pairs."""
    spark, kind = framed.sparkSession, dict(framed.dtypes)["gt_id"]
    asked = framed.selectExpr("f_id AS image_id", "gt_id", "group").union(framed.select("gt_id", "gt_id", "group"))
    asked = checkpointed(asked.distinct())
    stored = _packed(tiles)
    if within_rows(asked, ASKED_ROWS):
        sent = stored.join(F.broadcast(asked), "image_id")
    else:
        # One task sends an image to so many groups only.
        sent = salted_join(asked, stored, ["image_id"], ["gt_id", "group"], rows_per_salt=max(1, SALT_BYTES // (8 * whole)))
    # Pairs come along as rows without an image, also those whose other frame is missing.
    about = framed.select("gt_id", "group", "f_id", "dy", "dx", "aligned_gain", "c", "frame_h", "frame_w")
    both = sent.unionByName(about, allowMissingColumns=True)
    parts = max(shuffle_width(spark), samples * 8 // PARTITION_BYTES + 1)

    def run(rows: Iterator[SimpleNamespace]) -> Iterator[tuple]:
        codec, pairs, stored = pa.Codec("zstd"), {}, defaultdict(list)
        for r in rows:
            if r.image_id is None:
                pairs.setdefault((r.gt_id, r.f_id), r)
            else:
                stored[r.image_id].append(r)
        cleans = {gt_id: [_part(r, codec) for r in stored[gt_id]] for gt_id in {gt for gt, _ in pairs}}
        for (gt_id, f_id), p in pairs.items():
            (top, bottom), (left, right) = K.overlap(p.dy, p.frame_h), K.overlap(p.dx, p.frame_w)
            h, w = bottom - top, right - left
            if min(h, w) > TOO_SMALL:
                other = [_part(r, codec) for r in stored[f_id]]
                a = K.assemble(cleans[gt_id], p.c, top, left, h, w)
                b = K.assemble(other, p.c, top - p.dy, left - p.dx, h, w) * p.aligned_gain
                yield gt_id, f_id, K.ms_ssim(a, b)

    dealt = both.repartition(parts, "gt_id", "group")
    return checkpointed(map_groups(dealt, ["gt_id", "group"], run, f"gt_id {kind}, f_id {kind}, rgb_msssim_score double"))


def _on_a_pyramid(framed: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """Scores of pairs of frames of any size.

    The maps' sums are additive; the product over scales is taken after the sum. Each scale is written to the checkpoint
    folder. Tiles need at least `BEYOND` lines a side to have few parts.
    """
    found = checkpointed(_first_scale(framed, tiles, size), **SAMPLES)
    sums = [found.filter("a IS NULL")]
    for scale in range(1, SCALES):
        found = checkpointed(_next_scale(found, scale, size), **SAMPLES)
        sums.append(found.filter("a IS NULL"))
    names = (*PAIR, "ch", "scale", "cs", "ssim", "n")
    whole = sums[0].select(*names)
    for more in sums[1:]:
        whole = whole.unionByName(more.select(*names))
    last = SCALES - 1
    terms = [
        f"pow(greatest(sum(IF(scale = {s}, {'ssim' if s == last else 'cs'}, 0)) / sum(IF(scale = {s}, n, 0)), 0), {weight})"
        for s, weight in enumerate(K.SSIM_WEIGHTS)
    ]
    per_channel = whole.groupBy(*PAIR, "ch").agg(F.expr(" * ".join(terms)).alias("score"))
    return per_channel.groupBy(*PAIR).agg(F.avg("score").alias("rgb_msssim_score"))


def ms_ssim(aligned: DataFrame, tiles: DataFrame, size: int = TILE, whole: int = WHOLE) -> DataFrame:
    """`rgb_msssim_score` of each aligned, gain-matched pair; null if a side is too small or the pair has no gain.

    Frames of up to `whole` samples are scored in one piece, larger ones scale by scale. `tiles` are read once for
    the frames' sizes, without samples, and once for each of the two kinds of frames that there is.
    """
    framed = _framed(aligned, tiles)
    scores = None
    small, large = framed.filter(F.col("samples") <= whole), framed.filter(F.col("samples") > whole)
    if samples := small.agg(F.sum("samples")).first()[0]:
        scores = _in_one_piece(small, samples, tiles, whole)
    if scores is None or not large.isEmpty():
        scaled = _on_a_pyramid(large, tiles, size)
        scores = scaled if scores is None else scores.unionByName(scaled)
    return aligned.select(*PAIR).join(scores, PAIR, "left")


def with_scores(aligned: DataFrame, tiles: DataFrame, size: int = TILE) -> DataFrame:
    """Descriptor rows (gt_id, f_id, dy, dx, aligned_gain and more) with their `rgb_msssim_score`, as gates and bands read it."""
    rows = checkpointed(aligned.drop("rgb_msssim_score"))
    return rows.join(ms_ssim(rows, tiles, size), PAIR)
