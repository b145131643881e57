"""Language of texts by unigrams over a fixed public vocabulary, summed over all segmentations.

A unit is a run of at most `UNIT` letters, in lower case, after one space. Every way to cut a
unit into pieces of the vocabulary (byte sequences, all single bytes among them) counts: a
forward pass over its bytes adds up the products of piece probabilities, for all languages at
once. A text's score is the sum over its units. Since pieces never leave a unit, this is the
sum over all segmentations of the text.

Piece probabilities are learned by expectation and maximisation: units and their numbers are
counted by language, a forward and a backward pass give each piece's expected uses, which are
added up by (language, piece). Languages share what they lack through the pooled probability.

Units of a batch walk down the trie of the vocabulary together, as arrays; a worker remembers
the scores of up to `REMEMBERED` units, so that a unit is scored once for many texts.

Bounds: the model is fitted on about `SAMPLE` texts of each language, chosen by hash, and knows
the `LANGUAGES` most frequent ones; it is a broadcast of languages times pieces. Everything
else covers all rows and whole texts.

Defined results: `und` and 0 for a null text or one without a letter (or if nothing was
learned); equal scores go to the first language in order; rows count each on their own,
repeated or not; an empty table gives no rows; doc_id, text and lang alone are read, and the
last only in rows of the learning fold.
"""

from __future__ import annotations

import base64
import sys
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlake.llm.common import bounded_batches
from pairlake.session import checkpointed

UNIT = 40
SAMPLE, LANGUAGES = 2500, 1000
ROUNDS = 3
#: Uses that a language borrows from all languages together.
BORROWED = 2000.0
REMEMBERED = 500_000
#: Units that walk down the trie at a time.
WALK = 16_384
FOLDS = 5
UNKNOWN = "und"
_UNITS = regex.compile(r"\p{L}{1,%d}" % UNIT)
_SMALL, _UP = 1e-150, 1e150


def units(text: str) -> list[str]:
    return _UNITS.findall(text.lower())


class Trie:
    """Pieces of a rank file that can stand in a unit; `piece[node]` is the number of the piece that ends there, or -1."""

    def __init__(self, path: str):
        pieces = {base64.b64decode(line.split()[0]) for line in open(path, "rb") if line.strip()}
        pieces |= {bytes([b]) for b in range(256)}
        # Upper case and marks never stand in a unit, and a space only in front.
        bare = regex.compile(rb"\x20?[a-z\x80-\xFF]*")
        self.pieces = sorted(p for p in pieces if len(p) == 1 or bare.fullmatch(p))
        used = sorted(set(b"".join(p for p in self.pieces if len(p) > 1)))
        self.column = np.zeros(256, np.int32)
        self.column[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        steps, ends = [dict()], [-1]
        single = np.zeros(256, np.int64)
        for number, piece in enumerate(self.pieces):
            if len(piece) == 1:
                single[piece[0]] = number
            node = 0
            if any(self.column[b] == 0 for b in piece):
                continue
            for b in piece:
                column = int(self.column[b])
                if column not in steps[node]:
                    steps[node][column] = len(steps)
                    steps.append({})
                    ends.append(-1)
                node = steps[node][column]
            ends[node] = number
        self.next = np.zeros((len(steps), self.width), np.int32)
        for node, found in enumerate(steps):
            for column, to in found.items():
                self.next[node, column] = to
        self.next = self.next.ravel()
        self.piece = np.array(ends, np.int64)
        self.single = single

    def lattice(self, words: list[bytes]) -> tuple[np.ndarray, int, list[list[tuple[np.ndarray, np.ndarray]]]]:
        """Lengths, the longest, and for each start the (words, pieces) of every length from 1 that fit there."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        most = int(length.max(initial=0))
        flat = np.frombuffer(b"".join(words), np.uint8)
        grid = np.zeros((most, len(words)), np.uint8)
        word = np.repeat(np.arange(len(words)), length)
        grid[np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length), word] = flat
        edges = []
        for start in range(most):
            alive = np.flatnonzero(length > start)
            at_start = [(alive, self.single[grid[start, alive]])]
            node = self.next[self.column[grid[start, alive]]]
            keep = node > 0
            alive, node, reach = alive[keep], node[keep], start + 1
            while True:
                keep = length[alive] > reach
                alive, node = alive[keep], node[keep]
                if not len(alive):
                    break
                node = self.next[node * self.width + self.column[grid[reach, alive]]]
                keep = node > 0
                alive, node, reach = alive[keep], node[keep], reach + 1
                piece = self.piece[node]
                ends = piece >= 0
                at_start.append((alive[ends], piece[ends]))
            edges.append(at_start)
        return length, most, edges

    def forward(self, words: list[bytes], chance: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language; `chance` is (pieces, languages)."""
        length, most, edges = self.lattice(words)
        alpha = np.zeros((most + 1, len(words), chance.shape[1]))
        alpha[0] = 1.0
        scale = np.zeros(len(words))
        for start, found in enumerate(edges):
            self._lift(alpha[start:], scale, length > start)
            for step, (word, piece) in enumerate(found):
                if len(word):
                    alpha[start + 1 + step, word] += alpha[start, word] * chance[piece]
        # Languages that fall this far below the best one stay there.
        return np.log(np.maximum(alpha[length, np.arange(len(words))], 1e-300)) + scale[:, None]

    @staticmethod
    def _lift(alpha: np.ndarray, scale: np.ndarray, open_: np.ndarray) -> None:
        """Multiply words up whose values at the front, and so all behind, become very small."""
        low = np.flatnonzero(open_ & (alpha[0].max(axis=1) < _SMALL))
        if len(low):
            alpha[:, low] *= _UP
            scale[low] -= np.log(_UP)

    def expected(self, words: list[bytes], number: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of words of one language, seen `number` times."""
        length, most, edges = self.lattice(words)
        many = len(words)
        # Values are kept in proportion: each position is divided by its byte's typical chance.
        logs = np.log(chance)
        alpha = np.full((most + 1, many), -np.inf)
        alpha[0] = 0.0
        for start, found in enumerate(edges):
            for step, (word, piece) in enumerate(found):
                if len(word):
                    to = alpha[start + 1 + step]
                    to[word] = np.logaddexp(to[word], alpha[start, word] + logs[piece])
        whole = alpha[length, np.arange(many)]
        beta = np.full((most + 1, many), -np.inf)
        beta[length, np.arange(many)] = 0.0
        uses = np.zeros(len(chance))
        for start in range(most - 1, -1, -1):
            for step, (word, piece) in enumerate(edges[start]):
                if len(word):
                    behind = logs[piece] + beta[start + 1 + step, word]
                    beta[start, word] = np.logaddexp(beta[start, word], behind)
                    share = np.exp(alpha[start, word] + behind - whole[word]) * number[word]
                    uses += np.bincount(piece, share, len(chance))
        return uses


def trie(path: str) -> Trie:
    """The trie of a vocabulary, once for each worker.

    It hangs on `sys`, since this module may travel by value and anew with every task; what
    hung on the module would travel along.
    """
    return vars(sys).setdefault("_pairlake_tries", _Tries())[path]


class _Tries(dict):
    def __missing__(self, path: str) -> Trie:
        found = self[path] = Trie(path)
        return found


def unit_counts(rows: DataFrame) -> DataFrame:
    """(lang, unit, n) over all texts of `rows` (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.setdefault(lang, Counter()).update(units(text))
            for lang, found in counts.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(found), pa.string()),
                        pa.array([f" {u}".encode() for u in found], pa.binary()),
                        pa.array(list(found.values()), pa.int64()),
                    ],
                    names=["lang", "unit", "n"],
                )

    counts = rows.select("text", "lang").mapInArrow(run, "lang string, unit binary, n bigint")
    return counts.groupBy("lang", "unit").agg(F.sum("n").alias("n"))


def _smoothed(uses: np.ndarray) -> np.ndarray:
    """Piece probabilities (pieces, languages) from uses."""
    pooled = uses.sum(1) + 0.01
    pooled /= pooled.sum()
    return (uses + BORROWED * pooled[:, None]) / (uses.sum(0) + BORROWED)


def fit(rows: DataFrame, vocabulary: str, sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities (pieces, languages), from `rows` (text, lang).

    `vocabulary` is a file of base64 pieces and ranks that every executor has.
    """
    spark = rows.sparkSession
    rows = rows.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return [], np.empty((0, 0))
    share = spark.createDataFrame([(r[0], min(1.0, sample / r[1])) for r in sizes], "lang string, share double")
    luck = F.pmod(F.xxhash64("text", F.lit(13)), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(F.broadcast(share), "lang").filter(luck < F.col("share"))
    counts = checkpointed(unit_counts(chosen).repartition("lang", "unit").sortWithinPartitions("lang"))
    langs = sorted(r[0] for r in sizes)
    place = {lang: i for i, lang in enumerate(langs)}
    pieces = len(trie(vocabulary).pieces)
    chance = np.full((pieces, len(langs)), 1.0 / pieces)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(chance)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, uses = trie(vocabulary), np.zeros((pieces, len(langs)))
            for batch in batches:
                of = np.array([place[lang] for lang in batch.column(0).to_pylist()], np.int64)
                words, number = batch.column(1).to_pylist(), batch.column(2).to_numpy().astype(float)
                for lang in np.unique(of):
                    at = np.flatnonzero(of == lang)
                    uses[:, lang] += known.expected([words[i] for i in at], number[at], sent.value[:, lang])
            piece, lang = np.nonzero(uses)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece), pa.array(lang), pa.array(uses[piece, lang])], names=["piece", "lang", "uses"]
            )

        found = counts.mapInArrow(run, "piece bigint, lang bigint, uses double")
        found = found.groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toArrow()
        uses = np.zeros((pieces, len(langs)))
        uses[found.column("piece").to_numpy(), found.column("lang").to_numpy()] = found.column("uses").to_numpy()
        chance = _smoothed(uses)
    return langs, chance


class Scores(dict):
    """Places of units in a table of log probabilities; emptied when it holds `bound` units."""

    def __init__(self, known: Trie, chance: np.ndarray, bound: int = REMEMBERED):
        super().__init__()
        self.known, self.chance, self.bound = known, chance, bound
        self.new: list[str] = []
        self.table = np.empty((0, chance.shape[1]))

    def __missing__(self, unit: str) -> int:
        self.new.append(unit)
        place = self[unit] = len(self)
        return place

    def learn(self) -> None:
        # Units of like length walk together.
        words = [f" {u}".encode() for u in self.new]
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        found = np.empty((len(words), self.chance.shape[1]))
        for low in range(0, len(order), WALK):
            part = order[low : low + WALK]
            found[part] = self.known.forward([words[i] for i in part], self.chance)
        used = len(self) - len(self.new)
        if len(self) > len(self.table):
            self.table = np.concatenate([self.table, np.empty((2 * len(self) - len(self.table), found.shape[1]))])
        self.table[used : len(self)] = found
        self.new = []

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Units and log probabilities of each text."""
        if len(self) > self.bound:
            self.clear()
        cut = [units(t) for t in texts]
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        place = np.fromiter(map(self.__getitem__, chain.from_iterable(cut)), np.int64, int(n.sum()))
        if self.new:
            self.learn()
        total = np.zeros((len(texts), self.chance.shape[1]))
        held = np.flatnonzero(n)
        if len(held):
            total[held] = np.add.reduceat(self.table[place], (np.cumsum(n) - n)[held], axis=0)
        return n, total


def predict(docs: DataFrame, langs: list[str], chance: np.ndarray, vocabulary: str, *extra: Column) -> DataFrame:
    """(doc_id, extra columns, lang_pred, score): the likeliest language of each text and its share of all."""
    spark = docs.sparkSession
    rows = docs.select(F.col("text"), F.col("doc_id").cast("bigint"), *extra)
    schema = rows.drop("text").limit(0)
    if not langs:
        return rows.drop("text").withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
    sent = spark.sparkContext.broadcast((langs, chance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = sent.value
        scores = Scores(trie(vocabulary), table)
        for batch in batches:
            n, total = scores.of([t or "" for t in batch.column(0).to_pylist()])
            first = total.argmax(1)
            score = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            known = (n > 0).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[1:],
                    pa.array([names[f] if k else UNKNOWN for f, k in zip(first.tolist(), known)], pa.string()),
                    pa.array(np.where(n > 0, score, 0.0)),
                ],
                names=[*batch.schema.names[1:], "lang_pred", "score"],
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema.fields)
    return rows.mapInArrow(run, f"{kept}, lang_pred string, score double")


def digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned on the rows whose id's CRC-32 leaves a rest by 5."""
    bounded_batches(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    langs, chance = fit(docs.filter(~held).filter("doc_id IS NOT NULL"), vocabulary)
    return predict(docs, langs, chance, vocabulary, held.alias("held_out"))
