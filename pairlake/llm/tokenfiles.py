"""Token ids in Parquet files for selective reads.

One row per document in ascending doc_id order: `doc_id`, `start` within the file, `n_tokens`
and `ids`, a list column with dictionary encoding. Row groups have a bounded size and
the writer adds page indexes, so a reader of metadata columns skips the ids, and a reader of
a doc_id or start range opens the row groups and pages that hold it. Files are numbered in
doc_id order; the ids before a file are the sum over the files before it.

Encoding works on chunks: a text is cut before white space that follows other characters.
The tokenizer's own cuts include these places, so a chunk's ids do not depend on its
surroundings, and the tokenizer library encodes each distinct chunk once as long as a worker
remembers it, over tasks too: chunks are joined for it, and the bytes that each id stands for tell them apart again. A text with
control characters on which the two definitions of white space differ, or with special strings, is
encoded whole.

Defined results: null and empty texts get the end id alone; rows with equal doc_id follow each
other by a hash of the text; null doc_ids come first; an empty table gives files
without rows; texts are encoded whole; only doc_id and text are read.
"""

from __future__ import annotations

import json
import os
import re
import sys
import uuid
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlake.llm.common import bounded_batches, text_of
from pairlake.session import checkpoint_folder, shuffle_width

END = 0
ROW_GROUP = 32 << 20
PAGE = 256 << 10
#: First character of a key that is a chunk as it is; texts that hold it are one chunk.
MARK = "\x1c"
#: Distinct chunks whose ids a worker remembers.
REMEMBERED = 1_000_000

_CHUNK = re.compile(r"\s*\S+|\s+")
_LONG_RUN = re.compile(r"\s\s(?:\s|\Z)")
#: Chunks that are encoded as one string.
JOINED = 1000
#: Characters that count as white space in one of the two pattern engines only.
_DIFFERENT = re.compile("[\x1c-\x1f\x85]")


def chunk_keys(text: str, special: Sequence[str] = ()) -> list[str]:
    """The chunks of a text, each by its key: `_text_of_key` gives the chunk back.

    A cut before white space is a cut of the tokenizer unless white space stands on both sides
    of the character it precedes; only runs of three, or of two at the end, have such places.
    A special string ends the text for the tokenizer, so texts that hold one are not cut.
    """
    if _DIFFERENT.search(text) or any(s in text for s in special):
        return [MARK + text]
    if not _LONG_RUN.search(text):
        keys = text.replace("\n", " \n").split(" ")
        keys[0] = keys[0] if keys[0][:1] == "\n" else MARK + keys[0]
        return keys
    chunks = _CHUNK.findall(text)
    return [c[1:] if c[0] == " " and c[1:2] != "\n" else c if c[0] == "\n" else MARK + c for c in chunks]


def _text_of_key(key: str) -> str:
    """Keys leave out a chunk's leading space; marked ones stand for the rest of the key as it is."""
    return key[1:] if key[:1] == MARK else key if key[:1] == "\n" else " " + key


class Chunks(dict):
    """Numbers of chunks by their keys, with the chunks' ids in flat arrays."""

    def __init__(self, path: str):
        super().__init__()
        # A task has one core; threads of the library would only add to its time.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        split = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("a byte-level BPE tokenizer without normalisation and prefix space is needed")
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes of each id; a symbol of the vocabulary stands for one byte.
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.width[list(vocabulary.values())] = list(map(len, vocabulary))
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.flat = np.empty(1 << 16, np.int32)
        self.low = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int64)
        self.used = 0

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        number = self[key] = len(self)
        return number

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self) -> None:
        """Encode the new chunks."""
        chunks = list(map(_text_of_key, self.new))
        # The tokenizer cuts at both ends of these, wherever they stand.
        joins = np.fromiter((k != "" and k[0] != MARK and not k[-1].isspace() for k in self.new), bool, len(chunks))
        joined = list(compress(chunks, joins))
        lumps = self._encoded(["".join(joined[i : i + JOINED]) for i in range(0, len(joined), JOINED)])
        flat = np.fromiter(chain.from_iterable(lumps), np.int32)
        chunk_ends = np.cumsum(np.fromiter((len(c.encode()) for c in joined), np.int64, len(joined)))
        id_ends = np.cumsum(self.width[flat])
        at = np.searchsorted(id_ends, chunk_ends)
        if not np.array_equal(id_ends[at], chunk_ends):
            raise AssertionError("a token spans two chunks")
        found = self._encoded(list(compress(chunks, ~joins)))
        flat = np.r_[flat, np.fromiter(chain.from_iterable(found), np.int32)]
        sizes = np.r_[np.diff(np.r_[0, at + 1]), np.fromiter(map(len, found), np.int64, len(found))]
        while self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        while len(self) > len(self.low):
            self.low, self.size = (np.resize(x, 2 * len(x)) for x in (self.low, self.size))
        self.flat[self.used : self.used + len(flat)] = flat
        number = len(self) - len(chunks) + np.r_[np.flatnonzero(joins), np.flatnonzero(~joins)]
        self.low[number] = self.used + np.cumsum(sizes) - sizes
        self.size[number] = sizes
        self.used += len(flat)
        self.new = []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and the offsets of the texts."""
        if len(self) > REMEMBERED:
            self.forget()
        cuts = [chunk_keys(t, self.special) for t in texts]
        pieces = np.fromiter(map(len, cuts), np.int64, len(cuts))
        number = np.fromiter(map(self.__getitem__, chain.from_iterable(cuts)), np.int64, int(pieces.sum()))
        if self.new:
            self.learn()
        low, size = self.low[number], self.size[number]
        text = np.repeat(np.arange(len(texts)), pieces)
        lengths = np.bincount(text, size, len(texts)).astype(np.int64) + 1
        offsets = np.r_[0, np.cumsum(lengths)]
        ids = np.full(offsets[-1], END, np.int32)
        # Every chunk's ids move from `low` to their place; the end id of each text before it shifts them.
        before = np.cumsum(size) - size
        place = np.arange(int(size.sum()))
        ids[np.repeat(text, size) + place] = self.flat[np.repeat(low - before, size) + place]
        return ids, offsets


def remembered(path: str) -> Chunks:
    """The chunks of a tokenizer file that this worker has met, in this task or an earlier one.

    They hang on `sys`, since this module may travel by value and anew with every task. A task that
    failed half way may leave new chunks without ids, so all are forgotten then. Another file under
    the same name is another tokenizer.
    """
    stat = os.stat(path)
    key = path, stat.st_mtime_ns, stat.st_size
    known = vars(sys).setdefault("_pairlake_chunks", {})
    if key not in known:
        known.clear()
        known[key] = Chunks(path)
    found = known[key]
    if found.new:
        found.forget()
    return found


def write(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Write the token files of `docs`; `tokenizer` is a file that every executor has."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text"))
    # Rows of one id, and those without one, spread by their texts.
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()
    ordered = rows.repartitionByRange(shuffle_width(docs.sparkSession), *order).sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, start = remembered(tokenizer), 0
        for batch in batches:
            ids, offsets = chunks.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(start + offsets[:-1], pa.int64()),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())),
                ],
                names=["doc_id", "start", "n_tokens", "ids"],
            )
            start += int(offsets[-1])

    encoded = ordered.mapInArrow(encode, "doc_id bigint, start bigint, n_tokens bigint, ids array<int>")
    # One file a task, whatever the session says: `start` counts through it.
    writer = encoded.write.option("maxRecordsPerFile", 0).option("parquet.block.size", ROW_GROUP).option("parquet.page.size", PAGE)
    writer.option("parquet.enable.dictionary", "true").option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """The rows of the token files; `start` counts the ids of all documents before.

    Without `ids` the token pages are not read.
    """
    names = ["doc_id", "start", "n_tokens", *(["ids"] if ids else [])]
    rows = spark.read.parquet(path).select(*names, F.col("_metadata.file_name").alias("_file"))
    # One row per file; the part number in a name is the file's place.
    sums = spark.read.parquet(path).select("n_tokens", F.col("_metadata.file_name").alias("_file"))
    sums = sums.groupBy("_file").agg(F.sum("n_tokens").alias("_sum"))
    # Names sort as text, which puts part-100000 before part-99999.
    number = F.regexp_extract("_file", r"^part-(\d+)", 1).cast("bigint")
    before = Window.orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_file", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    joined = rows.join(F.broadcast(bases), "_file")
    return joined.select(*[(F.col("start") + F.col("_base")).alias("start") if n == "start" else F.col(n) for n in names])


def checksums(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): CRC-32 of the ids as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            offsets = lists.offsets.to_numpy().tolist()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write token files to the checkpoint folder and describe what is read back from them."""
    spark = docs.sparkSession
    path = f"{checkpoint_folder(spark)}/pairlake-tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer)
    return checksums(read(spark, path))
