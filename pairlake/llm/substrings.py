"""Removal of repeated word sequences by super-k-mer partitioning.

A window is 13 consecutive words of one document. Each window has a minimiser: the smallest
hash among its two-word grams. Consecutive windows with one minimiser travel together as
one packed string (a super-k-mer) to the bucket of that minimiser, so every occurrence of a
window meets there. A bucket numbers its words exactly, sorts its windows and gives each the
smallest doc_id in which it starts; a window is removed in every document above that.

Hot windows and grams do not fill one bucket:

* Grams that are frequent in a bounded sample of documents are taken as minimisers only by windows
  that hold no other gram. This moves work, never results.
* Equal super-k-mers of one batch of documents travel once, for the smallest doc_id of the
  batch; in the batch's other documents they are already known to be removed.

Buckets are numbered so that one holds about `BUCKET_WORDS` words and is sorted in memory.

Defined results: null text has no words; documents of fewer than 13 words have no window; windows
repeated inside one document only are kept; rows with one doc_id and different texts are
separate documents of equal rank, so neither removes the other's words; a null doc_id
ranks after all others; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlake.llm.common import GOLDEN, WordHash, as_bytes, bounded_batches, grams, mix, text_of
from pairlake.session import shuffle_width

WINDOW = 13
GRAM = 2
#: Documents whose grams are counted to find frequent ones, and the share that makes one frequent.
SAMPLE_DOCS = 2000
FREQUENT = 0.002
#: Words (with overlaps) of a bucket.
BUCKET_WORDS = 1_500_000
#: Documents of a batch whose super-k-mers are packed together.
PACK_DOCS = 4000

_LATE = np.uint64(1 << 63)
_ABSENT = np.iinfo(np.int64).max
#: Level of the packed batches: they are the largest part of what is shuffled.
LEVEL = 6
_CODEC = "zstd"


def minimisers(hashes: np.ndarray, frequent: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The minimiser of every window; frequent grams come after all others."""
    values = grams(hashes, gram) >> np.uint64(1)
    if len(frequent):
        at = np.searchsorted(frequent, values)
        at[at == len(frequent)] = 0
        values = np.where(frequent[at] == values, values | _LATE, values)
    wide = window - gram + 1
    return np.lib.stride_tricks.sliding_window_view(values, wide).min(axis=1)


def super_kmers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of every run of one minimiser."""
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return first, np.diff(np.r_[first, len(values)])


def _packed(obj: bytes) -> bytes:
    return len(obj).to_bytes(8, "little") + pa.Codec(_CODEC, compression_level=LEVEL).compress(obj, asbytes=True)


def _unpacked(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec=_CODEC, asbytes=True)


def frequent_grams(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    """Grams in at least `FREQUENT` of about `sample_docs` documents; at most words of the sample / threshold."""
    total = docs.count()
    share = min(1.0, sample_docs / max(1, total))
    modulus = max(1, int(1 / share))
    rows = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(modulus)) == 0).select(text_of())
    least = max(4, int(FREQUENT * min(sample_docs, total)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, found = WordHash(), Counter()
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                found.update(np.unique(grams(hashes.of(text.split()), GRAM) >> np.uint64(1)).tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["gram", "n"]
        )

    counted = rows.mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    kept = counted.filter(F.col("n") >= least).select("gram").collect()
    return np.sort(np.array([r["gram"] for r in kept], np.int64).astype(np.uint64))


class Batch:
    """Super-k-mers of some documents by bucket, equal ones once."""

    def __init__(self, buckets: int, frequent: np.ndarray):
        self.buckets, self.frequent = buckets, frequent
        self.hashes = WordHash()
        self.clear()

    def clear(self) -> None:
        self.docs: list[tuple[int, int]] = []
        self.found: list[dict[bytes, list]] = [{} for _ in range(self.buckets)]
        self.settled: list[tuple[int, int, int]] = []

    def add(self, doc: int, mark: int, text: bytes) -> None:
        words = text.split()
        if len(words) < WINDOW:
            return
        own = len(self.docs)
        self.docs.append((doc, mark))
        values = minimisers(self.hashes.of(words), self.frequent)
        first, runs = super_kmers(values)
        buckets = (mix(values[first] ^ GOLDEN) % np.uint64(self.buckets)).tolist()
        docs, settled = self.docs, self.settled
        for start, run, bucket in zip(first.tolist(), runs.tolist(), buckets):
            packed = b" ".join(words[start : start + run + WINDOW - 1])
            entries = self.found[bucket]
            held = entries.get(packed)
            if held is None:
                entries[packed] = [own, start]
                continue
            holder = docs[held[0]][0]
            if holder == doc:
                # Further places of the smallest doc_id: the owner alternates with the start.
                held += (own, start)
            elif holder < doc:
                settled.append((own, start, start + run + WINDOW - 1))
            else:
                end = run + WINDOW - 1
                settled.extend((held[i], held[i + 1], held[i + 1] + end) for i in range(0, len(held), 2))
                entries[packed] = [own, start]

    def rows(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, blob) for each bucket; what is settled travels with one of them, in turn."""
        ids = np.array([d for d, _ in self.docs], np.int64)
        marks = np.array([m for _, m in self.docs], np.int64)
        turn = int(mix(ids[:1].view(np.uint64))[0] % np.uint64(self.buckets)) if len(ids) else 0
        for bucket, entries in enumerate(self.found):
            settled = np.array(self.settled if bucket == turn else [], np.int64).reshape(-1, 3)
            if not entries and not len(settled):
                continue
            places = np.fromiter((x for held in entries.values() for x in held), np.int64).reshape(-1, 2)
            counts = np.fromiter((len(held) // 2 for held in entries.values()), np.int64, len(entries))
            used, local = np.unique(np.r_[places[:, 0], settled[:, 0]], return_inverse=True)
            parts = [
                b"\n".join(entries),
                ids[used].tobytes(),
                marks[used].tobytes(),
                counts.astype(np.int32).tobytes(),
                local[: len(places)].astype(np.int32).tobytes(),
                places[:, 1].astype(np.int32).tobytes(),
                local[len(places) :].astype(np.int32).tobytes(),
                settled[:, 1:].astype(np.int32).tobytes(),
            ]
            sizes = np.array([len(p) for p in parts], np.int64).tobytes()
            yield bucket, _packed(sizes + b"".join(parts))


def _split(blob: bytes) -> list[bytes]:
    raw = _unpacked(blob)
    sizes = np.frombuffer(raw[:64], np.int64)
    edges = 64 + np.r_[0, np.cumsum(sizes)]
    return [raw[edges[i] : edges[i + 1]] for i in range(8)]


def numbered(strings: list[bytes]) -> np.ndarray:
    """A number for each word of all strings, equal for equal words; words stand one space apart."""
    joined = b" ".join([*strings, b""])
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == ord(" ")) + 1
    # The words as one Arrow column over the joined bytes, each with the space behind it.
    edges = np.r_[0, ends].astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(edges), pa.py_buffer(joined)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def repeated(strings: list[bytes], doc: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(string, first word, last word + 1) of runs of windows that also start under a smaller `doc`.

    Words are numbered exactly, windows are sorted by a hash of their numbers, and windows
    of one hash are compared word by word before they count as equal.
    """
    ids = numbered(strings)
    lengths = np.fromiter((s.count(b" ") + 1 for s in strings), np.int64, len(strings))
    windows = lengths - WINDOW + 1
    owner = np.repeat(np.arange(len(strings)), windows)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = np.repeat(np.cumsum(lengths) - lengths, windows) + within
    hashed = grams(mix(ids.astype(np.uint64) + np.uint64(1)), WINDOW)[at]
    order = np.argsort(hashed, kind="stable")
    same = hashed[order[1:]] == hashed[order[:-1]]
    if not same.any():
        return
    multiple = np.r_[same, False] | np.r_[False, same]
    order = order[multiple]
    table = np.stack([ids[at[order] + k] for k in range(WINDOW)])
    # Exact order inside equal hashes; equal windows end up side by side, smallest document first.
    exact = np.lexsort([doc[owner[order]], *table[::-1], hashed[order]])
    order, table = order[exact], table[:, exact]
    new = np.r_[True, (table[:, 1:] != table[:, :-1]).any(axis=0)]
    least = doc[owner[order]][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    gone = np.sort(order[doc[owner[order]] > least])
    if not len(gone):
        return
    breaks = np.r_[True, (np.diff(gone) != 1) | (owner[gone[1:]] != owner[gone[:-1]])]
    first = np.flatnonzero(breaks)
    last = np.r_[first[1:], len(gone)] - 1
    yield from zip(
        owner[gone[first]].tolist(), within[gone[first]].tolist(), (within[gone[last]] + WINDOW).tolist()
    )


_SPANS = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("spans", pa.list_(pa.int32()))])


def _spans(found: dict[tuple[int, int], list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([d for d, _ in found], pa.int64()),
            pa.array([m for _, m in found], pa.int64()),
            pa.array(list(found.values()), pa.list_(pa.int32())),
        ],
        schema=_SPANS,
    )


def _bucket(blobs: list[bytes]) -> dict[tuple[int, int], list[int]]:
    """Removed spans per document, as flat (start, end) lists."""
    strings: list[bytes] = []
    docs, marks, owners, starts = [], [], [], []
    found: dict[tuple[int, int], list[int]] = {}
    for blob in blobs:
        text, ids, mark, counts, local, start, settled, spans = _split(blob)
        ids, mark = np.frombuffer(ids, np.int64), np.frombuffer(mark, np.int64)
        for n, (low, high) in zip(
            np.frombuffer(settled, np.int32).tolist(), np.frombuffer(spans, np.int32).reshape(-1, 2).tolist()
        ):
            found.setdefault((int(ids[n]), int(mark[n])), []).extend((low, high))
        if not text:
            continue
        base = len(strings)
        strings.extend(text.split(b"\n"))
        local = np.frombuffer(local, np.int32)
        owners.append(base + np.repeat(np.arange(len(strings) - base), np.frombuffer(counts, np.int32)))
        docs.append(ids[local])
        marks.append(mark[local])
        starts.append(np.frombuffer(start, np.int32))
    if not strings:
        return found
    owner, doc, mark, start = map(np.concatenate, (owners, docs, marks, starts))
    # All places of a string have one doc_id.
    edges = np.searchsorted(owner, np.arange(len(strings) + 1))
    for n, low, high in repeated(strings, doc[edges[:-1]]):
        for p in range(edges[n], edges[n + 1]):
            found.setdefault((int(doc[p]), int(mark[p])), []).extend((int(start[p]) + low, int(start[p]) + high))
    return found


def removed_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, spans): words to remove, per document and bucket; a null doc_id is the largest number."""
    spark = docs.sparkSession
    bounded_batches(spark)
    frequent = spark.sparkContext.broadcast(frequent_grams(docs))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_ABSENT)).alias("doc_id"), text_of().alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    # A super-k-mer carries each word about three times.
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = shuffle_width(spark)
    buckets = max(width, int(chars * 3 / 6 / BUCKET_WORDS) + 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Batch(buckets, frequent.value)

        def out() -> pa.RecordBatch:
            found = list(held.rows())
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())],
                names=["bucket", "blob"],
            )

        taken = 0
        for batch in batches:
            ids, marks = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for doc, mark, text in zip(ids, marks, as_bytes(batch.column(1))):
                held.add(doc, mark, text)
                taken += len(text)
                # Long texts fill a batch as many short ones do.
                if len(held.docs) >= PACK_DOCS or taken > PACK_DOCS * 4000:
                    yield out()
                    taken = 0
        yield out()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs = None, []
        for batch in batches:
            for own, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own != bucket and blobs:
                    yield _spans(_bucket(blobs))
                    blobs = []
                bucket = own
                blobs.append(blob)
        if blobs:
            yield _spans(_bucket(blobs))

    blobs = rows.mapInArrow(pack, "bucket int, blob binary")
    dealt = blobs.repartition(width, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(settle, "doc_id bigint, mark bigint, spans array<int>")


def kept_words(words: list[bytes], spans: list[int]) -> list[bytes]:
    edge = np.zeros(len(words) + 1, np.int64)
    flat = np.array(spans, np.int64).reshape(-1, 2)
    np.add.at(edge, flat[:, 0], 1)
    np.add.at(edge, flat[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words that stay, joined by one space."""
    spans = removed_spans(docs).groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), "spans")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    key = F.coalesce("doc_id", F.lit(_ABSENT))
    joined = rows.join(spans, (key == F.col("_doc")) & (F.xxhash64("text") == F.col("_mark")), "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, texts = [], [], []
            for text, spans in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                words = text.split()
                stay = kept_words(words, spans) if spans else words
                total.append(len(words))
                gone.append(len(words) - len(stay))
                texts.append(b" ".join(stay))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return joined.select("doc_id", "text", "spans").mapInArrow(
        remove, "doc_id bigint, n_words bigint, n_removed bigint, kept string"
    )


def digest(docs: DataFrame) -> DataFrame:
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
