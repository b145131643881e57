"""Token counts by rank-synchronous merging of ragged symbol arrays.

A piece model with BPE scores is read from its file. Texts are cut into pre-tokens at places
that no piece spans (before a run of spaces, around characters that are in no longer piece),
so merges never cross a cut. All new pre-tokens of a batch lie in one flat array of symbols.
Every round each pre-token finds its lowest rank among neighbouring pairs and merges it, all
pre-tokens at once; those without a pair drop out. The count is what survives: one token per
known symbol, one per UTF-8 byte of an unknown character.

A round merges all places of the lowest rank, unless a longer piece built on the new one
ranks at least as low: there the order of merges matters, and only the first place is merged.
So every round gives what one-by-one merging gives.

Defined results: null and empty texts have 0 tokens; strings that look like control pieces are
ordinary text, as in the library; rows are counted each on their own, repeated or not;
an empty table gives no rows; texts are counted whole; only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlake.llm.common import bounded_batches, text_of

LIMIT = 4096
SPACE = "▁"
#: Distinct pre-tokens whose counts a task remembers.
REMEMBERED = 2_000_000
_NORMAL, _UNKNOWN, _USER, _UNUSED = 1, 2, 4, 5
_NO = np.int64(1 << 40)


class Pieces:
    """Symbols, ranks of pairs and cut places of a piece model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model.serialized_model_proto())
        normal = spec.normalizer_spec
        kinds = {p.type for p in spec.pieces}
        plain = normal.escape_whitespaces and not normal.remove_extra_whitespaces and not normal.precompiled_charsmap
        if spec.trainer_spec.model_type != 2 or not spec.trainer_spec.byte_fallback or not plain or kinds & {_USER, _UNUSED}:
            raise ValueError("a BPE model with byte fallback and identity normalisation is needed")
        self.prefix = SPACE if normal.add_dummy_prefix else ""
        pieces = {p.piece: p.score for p in spec.pieces if p.type == _NORMAL}
        if any(a != SPACE and b == SPACE for p in pieces for a, b in zip(p, p[1:])):
            raise ValueError("a piece spans a word's end")
        ranks = {s: i for i, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        rank = {p: ranks[s] for p, s in pieces.items()}
        # Every piece and every character of one is a symbol.
        symbols = sorted(set(pieces) | set(chain.from_iterable(pieces)))
        number = {s: i for i, s in enumerate(symbols)}
        self.unknown = len(symbols)
        self.single = np.full(0x110000, self.unknown, np.int32)
        self.bytes = np.ones(len(symbols) + 1, np.int64)
        for s, i in number.items():
            if len(s) == 1:
                self.single[ord(s)] = i
                if s not in pieces:
                    self.bytes[i] = len(s.encode())
        self.width = np.int64(len(symbols) + 1)
        keys, values, targets = [], [], []
        early = set()
        for p, r in rank.items():
            for cut in range(1, len(p)):
                a, b = p[:cut], p[cut:]
                if a in number and b in number:
                    keys.append(number[a] * int(self.width) + number[b])
                    values.append(r)
                    targets.append(number[p])
                early.update(x for x in (a, b) if x in rank and rank[x] >= r)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.ranks = np.array(values, np.int64)[order]
        self.targets = np.array(targets, np.int32)[order]
        self.alone = np.zeros(len(symbols) + 1, bool)
        self.alone[[number[x] for x in early]] = True
        # Buckets of keys by their left symbol narrow the search.
        inside = {c for p in pieces if len(p) > 1 for c in p}
        apart = "".join(c for c in "\n\t\r" if c not in inside)
        self.cut = re.compile(f"[{apart}]|{SPACE}*[^{SPACE}{apart}]+|{SPACE}+" if apart else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.longest_space = max(len(p) for p in pieces if set(p) == {SPACE})
        self.extra_space = re.compile(SPACE + "{%d,}" % (3 * self.longest_space))

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and symbol of each merged pair; rank `_NO` where there is none."""
        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == key
        return np.where(known, self.ranks[at], _NO), self.targets[at]

    def counts(self, tokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        result = np.zeros(len(tokens), np.int64)
        short = []
        for i, token in enumerate(tokens):
            # Spaces merge last, in full runs from the left: whole runs can be counted off.
            m = self.extra_space.search(token) if len(token) >= 3 * self.longest_space else None
            if m:
                off = (m.end() - m.start()) // self.longest_space - 2
                result[i] = off
                token = token[off * self.longest_space :]
            short.append(token)
        lengths = np.fromiter(map(len, short), np.int64, len(short))
        points = np.frombuffer("".join(short).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbol = self.single[points]
        weight = self.bytes[symbol]
        unknown = symbol == self.unknown
        if unknown.any():
            p = points[unknown]
            weight[unknown] = 1 + (p > 0x7F).astype(np.int64) + (p > 0x7FF) + (p > 0xFFFF)
        owner = np.repeat(np.arange(len(short)), lengths)
        result += np.bincount(owner, weight, len(short)).astype(np.int64)

        last = np.r_[owner[1:] != owner[:-1], True] if len(owner) else np.empty(0, bool)
        rank, target = self.pair(symbol, np.r_[symbol[1:], symbol[:1]])
        rank[last] = _NO
        while True:
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, np.int64)
            if not len(start):
                return result
            sizes = np.diff(np.r_[start, len(owner)])
            best = np.minimum.reduceat(rank, start)
            live = np.repeat(best < _NO, sizes)
            if not live.all():
                owner, symbol, rank, target, last = owner[live], symbol[live], rank[live], target[live], last[live]
                sizes, best = sizes[best < _NO], best[best < _NO]
                if not len(owner):
                    return result
                start = np.cumsum(sizes) - sizes
            hit = rank == np.repeat(best, sizes)
            at = np.flatnonzero(hit)
            # First place of each pre-token, and whether only that one may merge.
            own = owner[at]
            leading = np.r_[True, own[1:] != own[:-1]]
            only = self.alone[target[at]]
            only = np.repeat(np.logical_or.reduceat(only, np.flatnonzero(leading)), np.diff(np.r_[np.flatnonzero(leading), len(at)]))
            # In a chain of overlapping places every second one merges.
            chained = np.r_[False, (np.diff(at) == 1) & ~leading[1:]]
            head = np.flatnonzero(~chained)
            nth = np.arange(len(at)) - np.repeat(head, np.diff(np.r_[head, len(at)]))
            at = at[np.where(only, leading, nth % 2 == 0)]
            result -= np.bincount(owner[at], minlength=len(result))
            symbol[at] = target[at]
            last[at] = last[at + 1]
            stay = np.ones(len(owner), bool)
            stay[at + 1] = False
            moved = np.cumsum(stay) - 1
            at = moved[at]
            owner, symbol, rank, target, last = owner[stay], symbol[stay], rank[stay], target[stay], last[stay]
            touched = np.zeros(len(symbol), bool)
            touched[at] = True
            touched[at[at > 0] - 1] = True
            changed = np.flatnonzero(touched)
            following = np.minimum(changed + 1, len(symbol) - 1)
            rank[changed], target[changed] = self.pair(symbol[changed], symbol[following])
            rank[changed[last[changed]]] = _NO


class Counter(dict):
    """Counts of pre-tokens that were seen."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces

    def totals(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        cut, prefix = self.pieces.cut, self.pieces.prefix
        cuts = [cut.findall((prefix + t).replace(" ", SPACE)) if t else [] for t in texts]
        if len(self) > REMEMBERED:
            self.clear()
        new = list(set(chain.from_iterable(cuts)).difference(self))
        if new:
            self.update(zip(new, self.pieces.counts(new).tolist()))
        return [sum(map(self.__getitem__, c)) for c in cuts]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) per document; `model` is a file that every executor has."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(Pieces(model))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counter.totals(texts), pa.int64())], schema=_OUT
            )

    rows = docs.select(
        F.col("doc_id").cast("bigint"), text_of().alias("text"), F.octet_length(text_of()).cast("bigint").alias("n_bytes")
    )
    return rows.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint")


def digest(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    return token_counts(docs, model).withColumn("over_limit", F.col("n_tokens") > limit)
