"""Toxicity scores from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, letters that look like Latin ones, and digits and signs that
stand for letters inside words. The lexicon holds beginnings of words with a weight each; it
is learnt from labelled documents, and given entries may be added. Exception phrases hide the
entries inside them. A document's weights, as a sum and per word, give the score by a
logistic curve that is fitted on the same documents.

An entry must stand in many different contexts (the words before and after it) of toxic
documents, and in few of others. A toxic text that is copied a thousand times has few contexts,
so its ordinary words do not become entries.

Labels only of rows that `learn_from` accepts are read, and of these a bounded sample.

Defined results: null and empty texts have no matches and get the curve's value at 0; rows
are scored each on their own, repeated or not; without labels the score is 0 for all; contrary
labels of one document count as toxic; an empty table gives no rows; only doc_id and text
(and the labels' doc_id and toxic) are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlake.llm.common import bounded_batches, text_of
from pairlake.session import checkpointed

#: Labelled rows that the lexicon and the curve are fitted on, in expectation.
SAMPLE_ROWS = 20_000
#: Score from which a document is predicted to be toxic.
PREDICTED = 0.7
#: Letters of an entry.
SHORTEST, LONGEST = 3, 12
#: Different contexts in toxic documents, and share of toxic ones among documents with the entry.
CONTEXTS = 6
TOXIC_SHARE = 0.85
#: Phrases in which an entry is harmless; each begins with a word's beginning.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "class clown", "clown fish", "clownfish", "sore loser")

# Letters of other scripts by the Latin letter they look like.
_LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ӏ": "l", "ո": "n", "ս": "u", "ѵ": "v", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d",
}
# Digits and signs by the letter they stand for.
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

_LETTERS = str.maketrans(
    _LOOKALIKES | {chr(0xFF41 + i): chr(0x61 + i) for i in range(26)} | dict.fromkeys("​‌‍⁠﻿­", None)
)
_SUBSTITUTES = str.maketrans(_SIGNS)
#: Digits and signs in front of a letter stand for letters.
_MIXED = re.compile(r"[013457@$]+(?=[^\W\d_])")
_FOLDABLE = re.compile("[" + "".join(map(chr, _LETTERS)) + "]")
_WORD = re.compile(r"[^\W_]+")


def folded(text: str) -> list[str]:
    """The words of the folded text."""
    text = text.lower()
    if not text.isascii() and _FOLDABLE.search(text):
        text = text.translate(_LETTERS)
    text = _MIXED.sub(lambda m: m[0].translate(_SUBSTITUTES), text)
    return _WORD.findall(text)


def beginnings(word: str) -> list[str]:
    """What may be an entry: the word's beginnings; a space marks where the word starts."""
    return [" " + word[:n] for n in range(SHORTEST, min(LONGEST, len(word)) + 1)]


class Lexicon:
    """Weighted entries and exception phrases in one automaton."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.automaton = ahocorasick.Automaton()
        for phrase in exceptions:
            self.automaton.add_word(" " + phrase, (len(phrase) + 1, None))
        for entry, weight in weights.items():
            if entry not in self.automaton:
                self.automaton.add_word(entry, (len(entry), weight))
        if len(self.automaton):
            self.automaton.make_automaton()

    def matches(self, words: list[str]) -> list[tuple[int, int, float]]:
        """(first, end, weight) of entries outside exception phrases in " " + words joined by spaces."""
        if not len(self.automaton) or not words:
            return []
        hits, hidden = [], []
        for end, (size, weight) in self.automaton.iter(" " + " ".join(words)):
            (hidden if weight is None else hits).append((end + 1 - size, end + 1, weight))
        if hidden:
            hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b, _ in hidden)]
        return hits

    def figures(self, text: str) -> tuple[float, float]:
        """Sum of weights, and sum per thousand words, each as log(1 + x)."""
        words = folded(text)
        total = sum(w for _, _, w in self.matches(words))
        return float(np.log1p(total)), float(np.log1p(1000.0 * total / max(50, len(words))))


def _curve(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Coefficients of a logistic regression with a weak ridge, by Newton steps."""
    design = np.c_[np.ones(len(x)), x]
    ridge = np.diag([1e-3, 1e-2, 1e-2])
    beta = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(design.T @ (design * w[:, None]) + ridge, design.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def sample_of(docs: DataFrame, labels: DataFrame, learn_from: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of about `rows` labelled documents, chosen by a hash of their id."""
    marks = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(learn_from)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = marks.count()
    if total > rows:
        # One in `total / rows` of the hashes, so the sample is of expected size `rows`.
        edge = int(2**32 * rows / total)
        marks = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2**32)) < edge)
    marks = marks.select(F.col("doc_id").alias("_label_id"), "toxic")
    # The sample's ids are bounded by `rows`.
    joined = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(marks), F.col("doc_id") == F.col("_label_id"))
    return checkpointed(joined.select("text", "toxic"))


def learn(sample: DataFrame) -> dict[str, float]:
    """Weights of entries from (text, toxic) rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[1 if toxic else 0].update({b for w in set(folded(text)) for b in beginnings(w)})
        # Only what toxic documents have can become an entry, but others may be in other tasks.
        for label, terms in found.items():
            for at in range(0, len(terms), 50_000):
                part = list(terms.items())[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t for t, _ in part]), pa.array([n for _, n in part], pa.int64()), pa.array([label] * len(part), pa.int32())],
                    names=["term", "n", "toxic"],
                )

    counted = sample.select("text", "toxic").mapInArrow(count, "term string, n bigint, toxic int")
    totals = counted.groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum("n").alias("n")
    )
    # Bounded by the sample: a term needs several of its toxic documents.
    rows = totals.filter((F.col("bad") >= CONTEXTS) & (F.col("bad") >= TOXIC_SHARE * F.col("n"))).collect()
    shares = {r["term"]: (r["bad"], r["n"]) for r in rows}
    # A beginning whose own shorter beginning qualifies adds nothing.
    terms = {t for t in shares if not any(t[:n] in shares for n in range(SHORTEST + 1, len(t)))}
    if not terms:
        return {}
    lexicon = Lexicon(dict.fromkeys(terms, 1.0), ())

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[str, str]] = set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = folded(text)
                joined = " " + " ".join(words) + " "
                for first, end, _ in lexicon.matches(words):
                    before = joined[:first].rsplit(" ", 1)[-1]
                    after = joined[end:].split(" ", 2)[1:2]
                    found.add((joined[first:end], f"{before} {after[0] if after else ''}"))
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in found], pa.string()), pa.array([c for _, c in found], pa.string())], names=["term", "context"]
        )

    seen = sample.filter("toxic = 1").select("text").mapInArrow(contexts, "term string, context string")
    seen = seen.distinct().groupBy("term").agg(F.count(F.lit(1)).alias("contexts")).filter(F.col("contexts") >= CONTEXTS)
    kept = {r["term"] for r in seen.collect()}
    # Log odds of an entry with half a document added to each side.
    return {t: float(np.log((shares[t][0] + 0.5) / (shares[t][1] - shares[t][0] + 0.5))) for t in sorted(kept)}


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, rows: int = SAMPLE_ROWS) -> tuple[dict[str, float], np.ndarray]:
    """Entries with weights, and the curve."""
    sample = sample_of(docs, labels, learn_from, rows)
    weights = learn(sample)
    lexicon = Lexicon(weights)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            figures = [lexicon.figures(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in figures], pa.float64()), pa.array([b for _, b in figures], pa.float64()), batch.column(1)],
                names=["total", "density", "toxic"],
            )

    # Two numbers and a label for each row of the bounded sample.
    points = sample.select("text", "toxic").mapInArrow(measure, "total double, density double, toxic int").toPandas()
    if points["toxic"].nunique() < 2:
        return weights, np.array([-30.0, 0.0, 0.0])
    return weights, _curve(points[["total", "density"]].to_numpy(), points["toxic"].to_numpy(float))


def score(docs: DataFrame, weights: dict[str, float], curve: np.ndarray) -> DataFrame:
    """(doc_id, score) of whole texts."""
    bounded_batches(docs.sparkSession)
    lexicon = Lexicon(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            figures = np.array([lexicon.figures(t) for t in batch.column(1).to_pylist()]).reshape(-1, 2)
            value = curve[0] + figures @ curve[1:]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(value, -30, 30))), pa.float64())], names=["doc_id", "score"]
            )

    rows = docs.select(F.col("doc_id").cast("bigint"), text_of())
    return rows.mapInArrow(run, "doc_id bigint, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores learnt from rows whose crc32(doc_id) mod 3 is not 1; the others are held out."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    bounded_batches(docs.sparkSession)
    weights, curve = fit(docs, labels, fold != 1)
    return score(docs, weights, curve).select(
        "doc_id",
        F.coalesce(fold == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= PREDICTED).cast("int").alias("predicted"),
    )
