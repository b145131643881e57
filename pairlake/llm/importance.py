"""Importance resampling towards a target distribution, by hashed n-grams in Arrow kernels.

Texts go through Arrow kernels batch by batch: `ascii_lower`, `split_pattern_regex`,
`list_flatten` and `dictionary_encode` give one index for every word. Shifted indices beside
each other, with the text they come from, form the n-grams: every distinct pair of a shorter
n-gram and a word is checksummed once, going on from the shorter one's CRC. Buckets are taken
back to all places, and segments of a text are reduced to sums.

Three passes: bucket counts of the corpus and of the target (partial sums in each task, one
row for every bucket and task shuffled), then weights of all documents from the gains, which
are one number for every bucket. Gumbel noise from a hash of the id makes the draw; drawn rows
are numbered by a range sort, from the counts of the ranges before, never in one task.

Defined results: null and empty texts have no features and weight 0; a null doc_id hashes as
the empty string and comes after all others in ties; rows count each on their own, repeated or
not, and the order among rows equal in score and id is by the hash of their text, then any;
an empty target or corpus counts as 0 everywhere; texts are taken whole; only doc_id and text
are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlake.llm.common import bounded_batches, text_of
from pairlake.session import checkpointed, shuffle_width

LONGEST, BUCKETS, SEED = 1, 10_000, 2024
LEAST_WORDS, PERCENT = 20, 10
#: Characters between words, after lower-casing: all of ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that go through the kernels at a time (one longer text goes alone).
CHUNK = 8 << 20


def chunks(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of about `CHUNK` bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(texts):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + CHUNK, "right")))
        yield texts.slice(low, high - low)
        low = high


def features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, then the text and the bucket of every feature, by text."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.not_equal(flat, "")
    coded = pc.filter(flat, real).dictionary_encode()
    parent = pc.filter(parent, real).to_numpy(zero_copy_only=False).astype(np.int64)
    words = [w.encode() for w in coded.dictionary.to_pylist()]
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_words = np.bincount(parent, minlength=len(texts))
    crc = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    # `gram` numbers the distinct n-grams that begin at each place.
    gram, owner = word, parent
    texts_of, buckets_of = [parent], [crc[word] % buckets]
    for n in range(2, longest + 1):
        if len(word) < n:
            break
        whole = owner[: len(word) - n + 1] == parent[n - 1 :]
        pair = gram[: len(word) - n + 1] * len(words) + word[n - 1 :]
        # Places whose n-gram would leave its text get one number that no feature uses.
        pair = pa.array(np.where(whole, pair, -1)).dictionary_encode()
        distinct = pair.dictionary.to_numpy()
        shorter, last = np.divmod(distinct, max(1, len(words)))
        crc = np.fromiter(
            (0 if d < 0 else zlib.crc32(b" " + words[w], int(crc[g])) for d, g, w in zip(distinct, shorter, last)),
            np.int64,
            len(distinct),
        )
        gram, owner = pair.indices.to_numpy().astype(np.int64), owner[: len(word) - n + 1]
        texts_of.append(owner[whole])
        buckets_of.append(crc[gram[whole]] % buckets)
    return n_words, np.concatenate(texts_of), np.concatenate(buckets_of)


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in chunks(batch.column(0)):
                total += np.bincount(features(part, longest, buckets)[2], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    found = texts.select(text_of().alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    found = found.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares, rounded down, by bucket."""
    room = len(corpus)
    s, t = float(corpus.sum() + room), float(target.sum() + room)
    ratio = ((target + 1).astype(float) * s) / ((corpus + 1).astype(float) * t)
    return np.fromiter((math.floor(1000 * math.log(r)) for r in ratio.tolist()), np.int64, room)


def weights(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, tie): mean gain of each document, and the score with its noise."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            for part in chunks(batch.column(0)):
                n_words, text, bucket = features(part, longest, buckets)
                n = np.bincount(text, minlength=len(part))
                # Gains are whole and small, so sums of doubles hold them exactly.
                total = np.bincount(text, gain[bucket], len(part)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(low, len(part)),
                        pa.array(n_words, pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array(total // np.maximum(n, 1)),
                        batch.column(2).slice(low, len(part)),
                    ],
                    names=["doc_id", "n_words", "n_features", "weight", "tie"],
                )
                low += len(part)

    rows = docs.select(text_of().alias("text"), F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("tie"))
    rows = rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, tie bigint")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296)))
    return rows.withColumn("score", F.col("weight") + noise)


def numbered(rows: DataFrame, *order) -> DataFrame:
    """`rows` with `place`, from 1 in the given order: a range sort, and the counts of the ranges before."""
    width = shuffle_width(rows.sparkSession)
    # The last key spreads rows that are equal in all others.
    ranged = rows.withColumn("_any", F.rand(1)).repartitionByRange(width, *order, "_any").sortWithinPartitions(*order, "_any")
    ranged = checkpointed(ranged.drop("_any").withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_range", F.shiftright("_at", 33))
    counts = sorted((r[0], r[1]) for r in ranged.groupBy("_range").count().collect())
    total, before = 0, []
    for part, n in counts:
        before.append((part, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(before, "_range bigint, _before bigint")
    joined = ranged.join(F.broadcast(offsets), "_range")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return joined.withColumn("place", place).drop("_range", "_at", "_before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null where it is not drawn.

    `percent` percent of the documents of at least `least_words` words are drawn, as near the
    texts of `target` in distribution as the weights can tell.
    """
    bounded_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    rows = checkpointed(weights(docs, gain, longest, seed))
    able = F.col("n_words") >= least_words
    drawn = rows.filter(able).count() * percent // 100
    names = ["doc_id", "n_features", "weight", "score"]
    placed = numbered(rows.filter(able), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie"))
    placed = placed.select(*names, F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
    return placed.unionByName(rows.filter(~able).select(*names, F.lit(None).cast("bigint").alias("rank")))


ORACLE = f"""
WITH RECURSIVE byte_table AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)
              ORDER BY b) AS t
  FROM range(256) AS bytes(b)
), words AS (
  SELECT 0 AS target, rid, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word
  FROM (SELECT row_number() OVER () AS rid, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)
  UNION ALL
  SELECT 1, 0, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))
  FROM benchmark
), distinct_words AS (
  SELECT word, list_transform(range(CAST(octet_length(encode(word)) AS BIGINT)),
    lambda i: CAST(concat('0x', substr(hex(encode(word)), 2 * i + 1, 2)) AS BIGINT)) AS bytes
  FROM (SELECT DISTINCT word FROM words)
), hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) % {BUCKETS} AS bucket
  FROM distinct_words, byte_table
), counted AS (
  SELECT bucket, count(*) FILTER (target = 0) AS s, count(*) FILTER (target = 1) AS t FROM words JOIN hashed USING (word) GROUP BY bucket
), totals AS (
  SELECT CAST(sum(s) AS DOUBLE) AS all_s, CAST(sum(t) AS DOUBLE) AS all_t FROM counted
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln(((t + 1) * (all_s + {BUCKETS})) / ((s + 1) * (all_t + {BUCKETS})))) AS BIGINT) AS gain FROM counted, totals
), weighed AS (
  SELECT rid, count(*) AS n, sum(gain) AS total FROM words JOIN hashed USING (word) JOIN gain USING (bucket) WHERE target = 0 GROUP BY rid
), scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(floor(total / n), 0) AS BIGINT) AS weight,
         CAST(concat('0x', substr(sha256(concat('{SEED}:', doc_id)), 1, 8)) AS BIGINT) AS h
  FROM (SELECT row_number() OVER () AS rid, doc_id FROM documents) LEFT JOIN weighed USING (rid)
), noisy AS (
  SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scored
), placed AS (
  SELECT *, CASE WHEN n_features >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) END AS place,
         count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () AS able
  FROM noisy
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * able // 100 THEN place END AS rank FROM placed
"""
