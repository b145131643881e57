"""Benchmark decontamination: an inverted index of test items searched by block-max WAND.

The index of the test items travels to every task. A benchmark over INDEX_WORDS is searched in
blocks of its items, one index and one pass over the documents each: number of items, document
frequencies, mean length and passage length are those of the whole benchmark, so a block
weighs its items as one index would, and a document's items are united over the blocks by a
key of its text. Passes grow with the benchmark, memory does not. Training documents are cut into overlapping
passages, twice as long as the longest item and stepping by its length, so that every copy of
an item lies whole in some passage. Every passage queries the index; BM25 contributions are
divided by the item's score against itself, so a passage that holds an item scores 1.

Retrieval returns every item above the threshold: list maxima bound a passage first (the
pivot test over all its terms at once), block maxima next, and only blocks that can pass are
scored. BM25 alone would drop a question without its answer and items with their rare words
changed, so postings of the items' shingles retrieve too: every item of which a passage holds
as many shingles as a proof needs at least. Each hit is verified on five-word shingles of the
item's question (all but its last sentence), of its answer (the last sentence) and of the
whole item: nothing that verification would accept is missed by retrieval.

A leak holds most of the question, or half of question and answer each, or half of the whole
item. A question of under five words proves a leak by itself only if BM25 found the item.

Defined results: null and wordless texts match nothing; items without words are left out;
repeated items are each reported; items of under five words are verified as one shingle;
an empty benchmark marks nothing; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlake.llm.common import bounded_batches, grams, mix, text_of
from pairlake.session import checkpointed

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach to be verified.
THRESHOLD = 0.5
#: Share of shingles of the question, and of question and answer or the whole item, that prove a leak.
QUESTION_ALONE, BOTH = 0.8, 0.5
SHINGLE = 5
#: Items of a block at least, and blocks at most.
BLOCK_ITEMS, BLOCKS = 4, 64
#: Shares are added in single precision; bounds err to the side of searching.
EPSILON = 1e-4
#: The index travels to every task; beyond this many words the benchmark is searched in parts.
INDEX_WORDS = 2_000_000

#: ASCII characters other than letters and digits become spaces, and so do the marks of
#: the Latin-1 and General Punctuation blocks.
_SPACED = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
_MARKS = re.compile(rb"\xe2[\x80\x81][\x80-\xbf]|\xc2[\x80-\xbf]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str) -> list[bytes]:
    """Lower-case words; punctuation and symbols separate them."""
    raw = text.lower().encode().translate(_SPACED)
    if b"\xe2\x80" in raw or b"\xe2\x81" in raw or b"\xc2" in raw:
        raw = _MARKS.sub(b" ", raw)
    return raw.split()


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    n = min(SHINGLE, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def split_item(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of the question and of the answer; an item of one sentence is all question."""
    sentences = [w for w in (words_of(s) for s in _SENTENCE.split(text)) if w]
    if len(sentences) < 2:
        return words_of(text), []
    # Sentences of under a shingle's words say too little by themselves.
    cut = len(sentences) - 1
    while cut > 1 and sum(map(len, sentences[cut:])) < SHINGLE:
        cut -= 1
    return [w for s in sentences[:cut] for w in s], [w for s in sentences[cut:] for w in s]


@dataclass(frozen=True)
class Statistics:
    """Of the whole benchmark: items, their mean and greatest length, items that hold each word."""

    items: int
    mean: float
    longest: int
    held: dict[bytes, int]


class Index:
    """Postings (item, share of the item's own score), blocks of them and their maxima.

    `whole` has the statistics of the benchmark that `items` are a block of.
    """

    def __init__(self, items: list[tuple[int, str]], whole: Statistics | None = None):
        kept = [(i, t, words_of(t)) for i, t in sorted(items) if t and words_of(t)]
        self.ids = np.array([i for i, _, _ in kept], np.int64)
        self.parts = [tuple(shingles(p) for p in split_item(t)) for _, t, _ in kept]
        self.words = [w for _, _, w in kept]
        lengths = [len(w) for w in self.words]
        self.step = whole.longest if whole else max(lengths, default=1)
        mean = whole.mean if whole else float(np.mean(lengths)) if lengths else 1.0
        total = whole.items if whole else len(kept)
        self.terms: dict[bytes, int] = {}
        postings: list[list[tuple[int, int]]] = []
        for n, (_, _, words) in enumerate(kept):
            counts: dict[bytes, int] = {}
            for w in words:
                counts[w] = counts.get(w, 0) + 1
            for w, c in counts.items():
                if w not in self.terms:
                    self.terms[w] = len(postings)
                    postings.append([])
                postings[self.terms[w]].append((n, c))
        own = np.zeros(len(kept))
        weights = []
        for word, entries in zip(self.terms, postings):
            held = whole.held[word] if whole else len(entries)
            idf = np.log(1 + (total - held + 0.5) / (held + 0.5))
            tf = np.array([c for _, c in entries], float)
            size = np.array([lengths[n] for n, _ in entries], float)
            w = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
            weights.append(w)
            own[[n for n, _ in entries]] += w
        self.items = [np.array([n for n, _ in e], np.int64) for e in postings]
        self.share = [w / own[i] for w, i in zip(weights, self.items)]
        # Terms are numbered by descending list maxima.
        self.top = np.array([s.max() for s in self.share], float)
        order = np.argsort(-self.top, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        self.terms = {w: int(number[t]) for w, t in self.terms.items()}
        self.top = self.top[order]
        self.items = [self.items[t] for t in order]
        self.share = [self.share[t] for t in order]
        # Best share of a term within each block of items.
        self.per_block = max(BLOCK_ITEMS, -(-len(kept) // BLOCKS))
        self.block_top = np.zeros((len(postings), -(-len(kept) // self.per_block)), np.float32)
        for n, (item, share) in enumerate(zip(self.items, self.share)):
            np.maximum.at(self.block_top[n], item // self.per_block, share)
        self._post_shingles([t for _, t, _ in kept])

    def _post_shingles(self, texts: list[str]) -> None:
        """Postings of shingle hashes, and the shingles of an item that a proof needs at least."""
        self.codes = mix(np.arange(1, len(self.terms) + 1, dtype=np.uint64))
        self.sizes: set[int] = set()
        self.asks = np.zeros(len(texts), bool)
        self.least = np.zeros(len(texts), np.int64)
        keys, owners = [], []
        for item, text in enumerate(texts):
            question, answer = split_item(text)
            own = []
            for part in (self.words[item], question, answer):
                n = min(SHINGLE, len(part))
                if n:
                    self.sizes.add(n)
                    own.append(grams(self.codes[[self.terms[w] for w in part]], n))
            own_keys = np.unique(np.concatenate(own))
            keys.append(own_keys)
            owners.append(np.full(len(own_keys), item))
            self.asks[item] = len(question) >= SHINGLE
            asked = len(self.parts[item][0])
            whole = len(np.unique(own[0]))
            self.least[item] = max(1, int(np.ceil(BOTH * min(asked, whole) - 1e-9)))
        keys = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        owners = np.concatenate(owners) if owners else np.empty(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, first = np.unique(keys[order], return_index=True)
        self.owners, self.first = owners[order], np.r_[first, len(keys)]

    def shared(self, ids: np.ndarray) -> dict[int, set[int]]:
        """Per passage the items of which it holds enough shingles; `ids` are a text's terms."""
        codes = self.codes[ids]
        places, found = [], []
        for n in self.sizes:
            count = len(ids) - n + 1
            if count <= 0:
                continue
            # Starts of `n` terms in a row, none of them missing.
            missing = np.r_[0, np.cumsum(ids < 0)]
            at = np.flatnonzero(missing[n:] == missing[:-n])
            key = grams(codes, n)[at]
            where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            held = self.keys[where] == key
            at, where = at[held], where[held]
            stretch = at // self.step
            before = (stretch > 0) & (at + n <= (stretch + 1) * self.step)
            places += [stretch, stretch[before] - 1]
            found += [where, where[before]]
        if not sum(map(len, places)):
            return {}
        pairs = np.unique(np.concatenate(places) * len(self.keys) + np.concatenate(found))
        passage, where = pairs // len(self.keys), pairs % len(self.keys)
        cuts = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]]).tolist()
        result = {}
        for low, high in zip(cuts, [*cuts[1:], len(pairs)]):
            items, counts = np.unique(
                np.concatenate([self.owners[self.first[w] : self.first[w + 1]] for w in where[low:high]]), return_counts=True
            )
            enough = items[counts >= self.least[items]]
            if len(enough):
                result[int(passage[low])] = set(enough.tolist())
        return result

    def search(self, terms: np.ndarray, threshold: float = THRESHOLD) -> dict[int, float]:
        """All items whose share of their own score reaches the threshold, by block-max WAND.

        Terms come in descending order of their list maxima. Those after the point where the
        remaining maxima stay under the threshold cannot make an item pass alone, so only
        items in the lists before it, in blocks whose maxima can pass, are candidates.
        """
        terms = np.unique(terms)
        possible = self.block_top[terms].sum(axis=0) >= threshold - EPSILON
        if not possible.any():
            return {}
        rest = np.cumsum(self.top[terms][::-1])[::-1]
        essential = int((rest >= threshold - EPSILON).sum())
        candidates = np.zeros(len(self.ids), bool)
        candidates[np.concatenate([self.items[t] for t in terms[:essential]])] = True
        candidates &= np.repeat(possible, self.per_block)[: len(candidates)]
        if not candidates.any():
            return {}
        score = np.bincount(
            np.concatenate([self.items[t] for t in terms]), np.concatenate([self.share[t] for t in terms]), len(self.ids)
        )
        passed = np.flatnonzero(candidates & (score >= threshold - 1e-9))
        return dict(zip(passed.tolist(), score[passed].tolist()))

    def verify(self, item: int, found: set[tuple[bytes, ...]]) -> tuple[float, float]:
        """Shares of the question's and of the answer's shingles in a passage."""
        question, answer = self.parts[item]
        return (
            len(question & found) / len(question) if question else 0.0,
            len(answer & found) / len(answer) if answer else 1.0,
        )

    def leaks(self, text: str) -> dict[int, tuple[float, float]]:
        """Positions of the items that a text holds, with their shares."""
        words = words_of(text)
        ids = np.fromiter(map(self.terms.get, words, [-1] * len(words)), np.int64, len(words))
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return {}
        # Block maxima bound every stretch of `step` words; a passage is two of them.
        stretches = len(words) // self.step + 1
        pairs = np.unique(at // self.step * len(self.terms) + ids[at])
        stretch = pairs // len(self.terms)
        first = np.flatnonzero(np.r_[True, stretch[1:] != stretch[:-1]])
        bound = np.zeros((stretches + 1, self.block_top.shape[1]), np.float32)
        bound[stretch[first]] = np.add.reduceat(self.block_top[pairs % len(self.terms)], first, axis=0)
        can_pass = ((bound[:-1] + bound[1:]) >= THRESHOLD - EPSILON).any(axis=1)
        result: dict[int, tuple[float, float]] = {}
        by_shingles = self.shared(ids)
        for s in sorted({*np.flatnonzero(can_pass).tolist(), *by_shingles}):
            low, high = s * self.step, (s + 2) * self.step
            inside = ids[low:high]
            hits = self.search(inside[inside >= 0]) if can_pass[s] else {}
            either = {*hits, *by_shingles.get(s, ())}
            if not either:
                continue
            found = self.shingles_in(words[low:high], either)
            for item in either:
                question, answer = self.verify(item, found)
                alone = question >= QUESTION_ALONE and (self.asks[item] or item in hits)
                both = question >= BOTH and answer >= BOTH
                if alone or both or self.whole(item, found) >= BOTH:
                    result[item] = max(result.get(item, (0.0, 0.0)), (question, answer))
        return result

    def whole(self, item: int, found: set[tuple[bytes, ...]]) -> float:
        """Share of the whole item's shingles in a passage."""
        own = shingles(self.words[item])
        return len(own & found) / len(own)

    def shingles_in(self, words: list[bytes], items: set[int]) -> set[tuple[bytes, ...]]:
        """Shingles of a passage, of every length that the items' shingles have."""
        sizes = {min(SHINGLE, len(self.words[i])) for i in items}
        sizes |= {len(next(iter(p))) for i in items for p in self.parts[i] if p}
        return {tuple(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1)}


def _items(benchmark: DataFrame) -> tuple[DataFrame, bool]:
    """The items, and whether one index may hold them all."""
    rows = benchmark.select("item_id", "text").filter("text IS NOT NULL AND item_id IS NOT NULL")
    size = rows.agg(F.sum(F.length("text") / 2)).first()[0] or 0
    return rows, size <= INDEX_WORDS


def _count(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([len(words_of(t)) for t in batch.column(0).to_pylist()], pa.int64())], names=["n"])


def _distinct(batches):
    for batch in batches:
        for text in batch.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(sorted(set(words_of(text))), pa.binary())], names=["word"])


def _cut(rows: Iterable) -> Iterator[list[tuple[int, str]]]:
    """Consecutive items of at most INDEX_WORDS; a longer item is a block of its own."""
    block, size = [], 0.0
    for r in rows:
        own = len(r["text"]) / 2
        if block and size + own > INDEX_WORDS:
            yield block
            block, size = [], 0.0
        block.append((r["item_id"], r["text"]))
        size += own
    if block:
        yield block


def _blocks(rows: DataFrame) -> Iterator[tuple[list[tuple[int, str]], Statistics]]:
    """The items block by block, with the statistics of all; the driver holds one block."""
    spark = rows.sparkSession
    rows = checkpointed(rows)
    lengths = rows.select("text").mapInArrow(_count, "n bigint").filter("n > 0")
    items, mean, longest = lengths.agg(F.count(F.lit(1)), F.avg("n"), F.max("n")).first()
    held = rows.select("text").mapInArrow(_distinct, "word binary").groupBy("word").agg(F.count(F.lit(1)).alias("held"))
    held = checkpointed(held)
    for block in _cut(rows.orderBy("item_id", "text").toLocalIterator()):
        own = {w for _, t in block for w in words_of(t)}
        known = held.join(spark.createDataFrame(pd.DataFrame({"word": sorted(own)}), "word binary"), "word") if own else None
        counts = {bytes(r["word"]): r["held"] for r in known.collect()} if own else {}
        yield block, Statistics(items or 0, mean or 1.0, longest or 1, counts)


_FOUND = pa.schema([("_key", pa.string()), ("items", pa.list_(pa.int64())), ("overlap", pa.list_(pa.float64()))])


def _key() -> Column:
    return F.sha2(text_of(), 256).alias("_key")


def _found_in_blocks(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(key of the text, items, overlap) of every text that holds items of any block."""
    texts = docs.select(_key(), text_of())
    parts = []
    for block, whole in _blocks(rows):
        shared = docs.sparkSession.sparkContext.broadcast((block, whole))

        def run(batches, shared=shared):
            index = Index(*shared.value)
            for batch in batches:
                keys, items, overlap = [], [], []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found = sorted((int(index.ids[n]), q) for n, (q, _) in index.leaks(text).items())
                    if found:
                        keys.append(key)
                        items.append([i for i, _ in found])
                        overlap.append([q for _, q in found])
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((keys, items, overlap), _FOUND)], schema=_FOUND)

        hits = texts.mapInArrow(run, "_key string, items array<bigint>, overlap array<double>")
        # Equal texts hold the same items.
        hits = hits.groupBy("_key").agg(F.first(F.arrays_zip("items", "overlap")).alias("hits"))
        parts.append(checkpointed(hits))
        shared.destroy()
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = found.groupBy("_key").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    return found.select("_key", F.col("hits.items").alias("items"), F.col("hits.overlap").alias("overlap"))


_OUT = pa.schema([("doc_id", pa.int64()), ("items", pa.list_(pa.int64())), ("overlap", pa.list_(pa.float64()))])


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, items, overlap of each item's question) per document; items ascending."""
    bounded_batches(docs.sparkSession)
    rows, one = _items(benchmark)
    if not one:
        found = _found_in_blocks(docs, rows)
        keyed = docs.select(F.col("doc_id").cast("bigint"), _key()).join(found, "_key", "left")
        none = [F.array().cast("array<bigint>"), F.array().cast("array<double>")]
        return keyed.select("doc_id", *[F.coalesce(c, n).alias(c) for c, n in zip(("items", "overlap"), none)])
    shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in rows.collect()])

    def run(batches):
        index = Index(shared.value)
        for batch in batches:
            items, overlap = [], []
            for text in batch.column(1).to_pylist():
                found = sorted((int(index.ids[n]), q) for n, (q, _) in index.leaks(text).items())
                items.append([i for i, _ in found])
                overlap.append([q for _, q in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(items, pa.list_(pa.int64())), pa.array(overlap, pa.list_(pa.float64()))],
                schema=_OUT,
            )

    rows = docs.select(F.col("doc_id").cast("bigint"), text_of())
    return rows.mapInArrow(run, "doc_id bigint, items array<bigint>, overlap array<double>")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return matches(docs, benchmark).select(
        "doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("bigint").alias("n_items"), "items"
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no test item, with their own columns."""
    bounded_batches(docs.sparkSession)
    rows, one = _items(benchmark)
    if not one:
        found = _found_in_blocks(docs, rows).select(F.col("_key").alias("_d_key"))
        return docs.join(found, F.sha2(text_of(), 256) == F.col("_d_key"), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in rows.collect()])
    held: dict = {}

    @F.pandas_udf("boolean")
    def clean(texts):
        if "index" not in held:
            held["index"] = Index(shared.value)
        return pd.Series([not held["index"].leaks(t) for t in texts], dtype=bool)

    return docs.filter(clean(text_of()))
