"""Hard negatives from embeddings by rotated one-bit codes.

Every vector is turned into whole numbers, rotated (two rounds of fixed random signs and a
Hadamard transform) and kept as the signs of its coordinates, with the alignment of vector and
code (their inner product) and the norm of what the code leaves over. An anchor is rotated
alike and cut into bit planes, so that popcounts of plane and code estimate its product with
the code. By Cauchy and Schwarz the true score lies within

    alignment * estimate +- (alignment * plane error + residual * residual of the anchor),

always, not only probably. A row whose interval cannot reach what an anchor has already found
is dropped; the rest is scored in whole numbers. So the result is exact.

Two passes over the table of codes: the first finds each anchor's positives, the second its
negatives below each positive. Anchors go out in blocks of at most about `ANCHORS` rows (a
broadcast of bounded size); a task streams its rows past the block and sends on its best few
of each anchor, which a grouped limit settles. Rows are never shuffled against anchors. The
work is anchors times rows in popcounts, which no exact filter of this kind avoids.

Defined results: rows with a null label, a null vector, or a null or non-finite component take
no part; identical rows (id, label and vector) count once, different rows of one id each for
themselves; rows without an id can be found (after all others in ties) but are no anchors;
vectors are padded with zeros to the longest; scores beyond the long range are clamped to it;
an empty table gives no rows; only the three named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlake.llm.common import GOLDEN, bounded_batches, mix
from pairlake.session import checkpointed

#: Anchors of a block: 64 numbers each make 32 MB.
ANCHORS = 65_536
#: Anchors and rows that are compared at a time.
PART, TILE = 1024, 4096
PLANES = 6
#: Relative room for rounding in the bounds.
ROOM = 1e-9
POSITIVES, NEGATIVES = 5, 3
#: Percent of the positive's score that a negative's lies within.
LOW, HIGH = 50, 95
_NO_ID = np.iinfo(np.int64).max
_LEAST = -np.inf
#: Stands for a score where there is none.
_NONE = np.iinfo(np.int64).min


def rotate(x: np.ndarray) -> np.ndarray:
    """Rows of `x`, of a power of two in width, turned by an orthogonal map that only depends on the width."""
    n, width = x.shape
    for turn in (1, 2):
        signs = mix(np.arange(width, dtype=np.uint64) * GOLDEN + np.uint64(turn)) >> np.uint64(63)
        x = x * np.where(signs == 1, 1.0, -1.0)
        half = 1
        while half < width:
            pairs = x.reshape(n, -1, 2, half)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, width)
            half *= 2
        x = x / np.sqrt(width)
    return x


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code words, alignment and residual norm of each row of `x`."""
    with np.errstate(over="ignore", invalid="ignore"):
        turned = rotate(x)
        code = np.packbits(turned >= 0, axis=1, bitorder="little").view("<u8")
        align = np.abs(turned).sum(1) / np.sqrt(x.shape[1])
        return code, align, np.sqrt(np.maximum((turned**2).sum(1) - align**2, 0.0))


class Anchors:
    """A block of anchors with their bit planes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            turned = rotate(x)
            self.low = turned.min(1)
            self.step = (turned.max(1) - self.low) / (2**PLANES - 1)
            self.step[~(self.step > 0)] = 1.0
            level = np.rint((turned - self.low[:, None]) / self.step[:, None])
            near = self.low[:, None] + self.step[:, None] * level
            self.error = np.sqrt(((turned - near) ** 2).sum(1))
            self.square = (turned**2).sum(1)
            self.sum = near.sum(1)
            level = np.nan_to_num(level).astype(np.uint8)
        planes = [np.packbits(level >> j & 1, axis=1, bitorder="little").view("<u8") for j in range(PLANES)]
        self.planes = np.stack(planes)
        self.largest = np.abs(x).max(initial=0.0)

    def bounds(self, code: np.ndarray, align: np.ndarray, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of the score of each anchor and row."""
        width = 64 * code.shape[1]
        ones = np.bitwise_count(code).sum(1, dtype=np.int64)
        levels = np.zeros((len(self.ids), len(code)))
        for j in range(PLANES):
            for w in range(code.shape[1]):
                levels += np.bitwise_count(self.planes[j, :, w, None] & code[None, :, w]) * float(1 << j)
        with np.errstate(over="ignore", invalid="ignore"):
            inside = self.step[:, None] * levels + self.low[:, None] * ones
            estimate = (2 * inside - self.sum[:, None]) / np.sqrt(width)
            sure = np.maximum(np.abs(estimate) - self.error[:, None], 0.0)
            rest = np.sqrt(np.maximum(self.square[:, None] - sure**2, 0.0))
            around = align * self.error[:, None] + residual * rest
            around += ROOM * np.sqrt(self.square)[:, None] * (align + residual) + ROOM
            return align * estimate - around, align * estimate + around

    def scores(self, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whole-number scores of the pairs of anchor i and row j."""
        size = float(self.largest) * float(np.abs(x).max(initial=0.0)) * x.shape[1]
        if size >= 2.0**53:
            exact = [sum(int(a) * int(b) for a, b in zip(self.x[p], x[q])) for p, q in zip(i, j)]
            return np.array([min(max(s, 1 - 2**63), 2**63 - 1) for s in exact], np.int64)
        if 16 * len(i) > len(self.ids) * len(x):
            return (self.x @ x.T)[i, j].astype(np.int64)
        return np.einsum("ij,ij->i", self.x[i], x[j]).astype(np.int64)


def best(k: int, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the first `k` of each group, by descending score, then id."""
    order = np.lexsort((ids, ~score, group))
    group = group[order]
    first = np.r_[True, group[1:] != group[:-1]] if len(group) else np.empty(0, bool)
    starts = np.flatnonzero(first)
    rank = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
    return order[rank < k]


class Tops:
    """The best `k` rows found so far for each group."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.group, self.score, self.ids = (np.empty(0, np.int64) for _ in range(3))
        self.least = np.full(groups, _LEAST)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        group, score, ids = np.r_[self.group, group], np.r_[self.score, score], np.r_[self.ids, ids]
        kept = best(self.k, group, score, ids)
        self.group, self.score, self.ids = group[kept], score[kept], ids[kept]
        full = np.flatnonzero(np.bincount(self.group, minlength=len(self.least)) >= self.k)
        least = np.full(len(self.least), _NO_ID)
        np.minimum.at(least, self.group, self.score)
        # A double may round a large score up; one step below it loses no tie.
        self.least[full] = np.nextafter(least[full].astype(float), -np.inf)


def add_positives(tops: Tops, anchors: Anchors, rows: tuple) -> None:
    """Rows of the anchor's label, but for the anchor itself."""
    ids, labels, x, code, align, residual = rows
    able = anchors.labels[:, None] == labels
    if (tops.least > _LEAST).any():
        _, upper = anchors.bounds(code, align, residual)
        able &= ~(upper < tops.least[:, None])
    i, j = np.nonzero(able)
    same = np.flatnonzero(anchors.ids[i] == ids[j])
    itself = same[(anchors.x[i[same]] == x[j[same]]).all(1)]
    i, j = np.delete(i, itself), np.delete(j, itself)
    score = anchors.scores(x, i, j)
    good = score >= tops.least[i]
    tops.add(i[good], score[good], ids[j[good]])


def add_negatives(tops: Tops, anchors: Anchors, rows: tuple, positive: np.ndarray) -> None:
    """Rows of other labels within the band below a positive; `positive` has the scores, `_NONE` where there is none."""
    ids, labels, x, code, align, residual = rows
    count = positive.shape[1]
    lower, upper = anchors.bounds(code, align, residual)
    near = np.where(positive == _NONE, np.nan, positive.astype(float))
    need = np.where(np.isnan(near), np.nan, np.maximum(tops.least.reshape(-1, count), near * LOW / 100))
    need, most = np.fmin.reduce(need, axis=1), np.fmax.reduce(near * HIGH / 100, axis=1)
    room = ROOM * (np.abs(need) + np.abs(most)) + ROOM
    able = (anchors.labels[:, None] != labels) & ~np.isnan(need)[:, None]
    able &= ~(upper < (need - room)[:, None]) & ~(lower > (most + room)[:, None])
    i, j = np.nonzero(able)
    score = anchors.scores(x, i, j)
    for p in range(count):
        group = i * count + p
        at = np.flatnonzero((positive[i, p] != _NONE) & (score >= tops.least[group]))
        level, held = _whole(positive[i[at], p]), _whole(score[at])
        at = at[((LOW * level <= 100 * held) & (100 * held <= HIGH * level)).astype(bool)]
        tops.add(group[at], score[at], ids[j[at]])


def _whole(x: np.ndarray) -> np.ndarray:
    """Whole numbers that can be multiplied by 100."""
    return x.astype(object) if np.abs(x.astype(float)).max(initial=0.0) > 2.0**55 else x


def _wider(width: int) -> int:
    return max(64, 1 << (max(1, width) - 1).bit_length())


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of lists, padded with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.zeros((len(column), width))
    starts = np.cumsum(sizes) - sizes
    x[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(starts, sizes)] = flat
    return x


def coded(vectors: DataFrame, label: Column, width: int) -> DataFrame:
    """(vec_id, label, x, code, align, residual) of every row that takes part; `width` is the padded length."""
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint"), label.cast("bigint").alias("label"), "embedding")
    rows = rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(sound).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(256 * _matrix(batch.column(2), width))
            code, align, residual = encode(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([r.tobytes() for r in x], pa.binary()),
                    pa.array([r.tobytes() for r in code], pa.binary()),
                    pa.array(align),
                    pa.array(residual),
                ],
                names=["vec_id", "label", "x", "code", "align", "residual"],
            )

    return rows.mapInArrow(run, "vec_id bigint, label bigint, x binary, code binary, align double, residual double")


def _arrays(batch: pa.RecordBatch) -> tuple:
    """ids, labels, vectors, codes, alignments and residuals of a batch of coded rows."""
    n = batch.num_rows
    ids = batch.column(0).fill_null(int(_NO_ID)).to_numpy(zero_copy_only=False)
    x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float64).reshape(n, -1)
    code = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u8").reshape(n, -1)
    return ids, batch.column(1).to_numpy(), x, code, batch.column(4).to_numpy(), batch.column(5).to_numpy()


def _scan(rows: DataFrame, block, k: int, count: int) -> DataFrame:
    """(anchor, nth, id, score, rank): the best `k` rows for each anchor of the block and each of its `count` searches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, x, positive = block.value
        cuts = [slice(low, low + PART) for low in range(0, len(ids), PART)]
        parts = [Anchors(ids[c], labels[c], x[c]) for c in cuts]
        tops = [Tops(len(part.ids) * count, k) for part in parts]
        size = 64
        for batch in batches:
            if not batch.num_rows:
                continue
            arrays, low = _arrays(batch), 0
            while low < batch.num_rows:
                # Short tiles first, until there is something to compare with.
                tile = tuple(a[low : low + size] for a in arrays)
                low, size = low + size, min(4 * size, TILE)
                for cut, part, top in zip(cuts, parts, tops):
                    if positive is None:
                        add_positives(top, part, tile)
                    else:
                        add_negatives(top, part, tile, positive[cut])
        for cut, top in zip(cuts, tops):
            yield pa.RecordBatch.from_arrays(
                [pa.array(cut.start + top.group // count), pa.array(top.group % count), pa.array(top.ids), pa.array(top.score)],
                names=["anchor", "nth", "id", "score"],
            )

    found = rows.mapInArrow(run, "anchor bigint, nth bigint, id bigint, score bigint")
    order = Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by 50, below each of their best positives.

    `label` gives the label of a row of `vectors` (vec_id, label, embedding).
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    width = _wider(vectors.agg(F.max(F.size("embedding"))).first()[0] or 0)
    rows = checkpointed(coded(vectors, label, width))
    asks = rows.filter("vec_id % 50 = 0")
    blocks = max(1, -(-asks.count() // ANCHORS))
    number = F.pmod(F.xxhash64("vec_id", "label", "x"), F.lit(blocks))
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    results = []
    for nth in range(blocks):
        block = asks.filter(number == nth).select("vec_id", "label", "x").toArrow().combine_chunks()
        if not block.num_rows:
            continue
        ids, labels = block.column(0).to_numpy(), block.column(1).to_numpy()
        x = np.frombuffer(b"".join(block.column(2).to_pylist()), np.float64).reshape(len(ids), width)
        sent = spark.sparkContext.broadcast((ids, labels, x, None))
        near = _scan(rows, sent, positives, 1).toArrow()
        anchor, rank, of, score = (near.column(c).to_numpy() for c in ("anchor", "rank", "id", "score"))
        level = np.full((len(ids), positives), _NONE)
        level[anchor, rank - 1] = score
        sent = spark.sparkContext.broadcast((ids, labels, x, level))
        found = _scan(rows, sent, negatives, positives)
        names = pa.table(
            {
                "anchor": anchor,
                "nth": pa.array(rank.astype(np.int64) - 1),
                "anchor_id": ids[anchor],
                "positive_id": of,
                "positive_score": score,
            }
        )
        named = found.join(F.broadcast(spark.createDataFrame(names)), ["anchor", "nth"])
        results.append(
            checkpointed(
                named.select(
                    "anchor_id",
                    F.nullif("positive_id", F.lit(int(_NO_ID))).alias("positive_id"),
                    F.col("rank").cast("int"),
                    F.nullif("id", F.lit(int(_NO_ID))).alias("negative_id"),
                    "positive_score",
                    F.col("score").alias("negative_score"),
                )
            )
        )
    return reduce(DataFrame.unionByName, results) if results else spark.createDataFrame([], schema)


def digest(vectors: DataFrame) -> DataFrame:
    """Hard negatives, where every seventh label is moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors, moved)


ORACLE = f"""
WITH sound AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda v: floor(256 * v::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
         CAST(list_dot_product(a.x, r.x) AS BIGINT) AS score
  FROM sound a, sound r WHERE a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= {NEGATIVES}
"""
