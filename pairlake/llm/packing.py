"""Variable-capacity best-fit packing of documents into training sequences.

The packing depends on lengths alone, so it is planned on their histogram, which has at
most one row per length up to the largest capacity, however many documents there are. Best-fit
decreasing places all pieces of one length together: a group of equal bins is a pattern with
a count. A new bin takes the permitted size of the least cost per word it can hold of the
current length; at the end every bin shrinks to the smallest size that holds its contents.
Pieces then look up their bin by (length, rank within the length).

Texts longer than the largest capacity are cut into pieces of that capacity and a rest.

Defined results: null and wordless texts get one row of length 0 without a bin; rows with equal
doc_id are ranked by a hash of the text and each packed; a null doc_id is packed like
others; an empty table gives no rows; further columns are not carried.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlake.llm.common import bounded_batches, text_of
from pairlake.session import checkpointed, shuffle_width

SIZES = (512, 1024, 2048, 4096)
#: Cost of a sequence besides its words: padding to kernels, masks, scheduling.
OVERHEAD = 32.0
#: Pieces of one length that are ranked together: an eighth of a task's share within these bounds.
LEAST_ROWS = 64
MOST_ROWS = 65_536


def cost(size: int) -> float:
    return size + OVERHEAD


class Pattern:
    """`count` bins with equal contents: runs of (length, how many of it)."""

    __slots__ = ("count", "runs", "used")

    def __init__(self, count: int, runs: list, used: int):
        self.count, self.runs, self.used = count, runs, used


def plan(histogram: dict[int, int], sizes: tuple[int, ...] = SIZES) -> dict[str, np.ndarray]:
    """Best-fit decreasing over (length -> pieces).

    Returns ranges sorted by (length, first rank): pieces `rank` of `length` in a range sit
    in bin `bin + (rank - first) // each` at `offset + (rank - first) % each * length`.
    """
    sizes = tuple(sorted(set(sizes)))
    open_bins: dict[int, list[Pattern]] = defaultdict(list)
    room: list[int] = []
    done: list[tuple[int, Pattern]] = []

    def put(size: int, pattern: Pattern) -> None:
        left = size - pattern.used
        if left == 0:
            done.append((size, pattern))
            return
        if not open_bins[left]:
            bisect.insort(room, left)
        open_bins[left].append((size, pattern))

    for length in sorted((n for n in histogram if n > 0), reverse=True):
        if length > sizes[-1]:
            raise ValueError(f"a piece of {length} does not fit a bin of {sizes[-1]}")
        pieces = histogram[length]
        while pieces:
            at = bisect.bisect_left(room, length)
            if at < len(room):
                left = room[at]
                size, pattern = open_bins[left].pop()
                if not open_bins[left]:
                    room.pop(at)
                each = min(left // length, pieces)
            else:
                size = min((s for s in sizes if s >= length), key=lambda s: (cost(s) / (s // length * length), s))
                each = min(size // length, pieces)
                pattern = Pattern(pieces // each, [], 0)
            take = min(pattern.count, pieces // each)
            if take < pattern.count:
                put(size, Pattern(pattern.count - take, list(pattern.runs), pattern.used))
            put(size, Pattern(take, [*pattern.runs, (length, each)], pattern.used + each * length))
            pieces -= take * each
    done.extend(b for bins in open_bins.values() for b in bins)
    done.sort(key=lambda b: (b[0], b[1].runs))

    next_rank: dict[int, int] = defaultdict(int)
    rows, bins = [], 0
    for _, pattern in done:
        final = next(s for s in sizes if s >= pattern.used)
        offset = 0
        for length, each in pattern.runs:
            rows.append((length, next_rank[length], bins, each, offset, final, pattern.used))
            next_rank[length] += each * pattern.count
            offset += each * length
        bins += pattern.count
    names = ("length", "first", "bin", "each", "offset", "size", "used")
    table = np.array(sorted(rows), np.int64).reshape(-1, len(names))
    return {name: np.ascontiguousarray(table[:, i]) for i, name in enumerate(names)}


def locate(ranges: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> dict[str, np.ndarray]:
    """Bin, offset, size and fill of pieces given by length and rank."""
    edges = np.searchsorted(ranges["length"], np.unique(length))
    start = dict(zip(np.unique(length).tolist(), edges.tolist()))
    at = np.empty(len(length), np.int64)
    for value, low in start.items():
        mine = length == value
        high = np.searchsorted(ranges["length"], value, side="right")
        at[mine] = low + np.searchsorted(ranges["first"][low:high], rank[mine], side="right") - 1
    within = rank - ranges["first"][at]
    return {
        "bin_id": ranges["bin"][at] + within // ranges["each"][at],
        "offset": ranges["offset"][at] + within % ranges["each"][at] * length,
        "bin_size": ranges["size"][at],
        "bin_used": ranges["used"][at],
    }


_OUT = pa.schema([(n, pa.int64()) for n in ("doc_id", "piece", "start", "length", "bin_id", "offset", "bin_size", "bin_used")])


def pack(docs: DataFrame, length: Column | None = None, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, bin_id, offset, bin_size, bin_used).

    `length` is the length of a document (words by default). Ranks within a length come from
    counts of (length, salt) groups, so a length that a third of the pieces share is spread
    over as many groups as it needs.
    """
    bounded_batches(docs.sparkSession)
    if length is None:
        length = F.size(F.expr(r"regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 0)"))
    top = max(sizes)
    measured = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(text_of()).alias("_mark"), length.cast("bigint").alias("_n"))
    pieces = measured.select(
        "doc_id", "_mark", "_n", F.posexplode(F.sequence(F.lit(0), F.greatest((F.col("_n") - 1), F.lit(0)), F.lit(top))).alias("piece", "start")
    )
    pieces = pieces.withColumn("length", F.least(F.col("_n") - F.col("start"), F.lit(top))).drop("_n")
    pieces = checkpointed(pieces)
    counted = checkpointed(pieces.groupBy("length").agg(F.count(F.lit(1)).alias("_c")))
    # At most one row per length up to the largest capacity.
    histogram = {r["length"]: r["_c"] for r in counted.collect()}
    ranges = plan(histogram, sizes)
    total = sum(histogram.values())
    width = shuffle_width(docs.sparkSession)
    rows = min(MOST_ROWS, max(LEAST_ROWS, total // (8 * width)))
    # One row per length: bounded by the largest capacity.
    salts = F.broadcast(counted.select("length", F.ceil(F.col("_c") / F.lit(rows)).cast("bigint").alias("_salts")))
    salted = pieces.join(salts, "length").withColumn(
        "_salt", F.pmod(F.xxhash64("doc_id", "_mark", "piece"), F.col("_salts"))
    )
    return _placed(salted, ranges)


def _placed(salted: DataFrame, ranges: dict[str, np.ndarray]) -> DataFrame:
    by = Window.partitionBy("length", "_salt").orderBy("doc_id", "_mark", "piece")
    ranked = salted.withColumn("_r", F.row_number().over(by).cast("bigint") - 1)
    groups = checkpointed(salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_c")))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    carry = groups.select("length", "_salt", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    rows = ranked.join(carry, ["length", "_salt"]).select(
        "doc_id", "piece", "start", "length", (F.col("_r") + F.col("_before")).alias("rank")
    )

    def place(batches):
        for batch in batches:
            size, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4))
            real = size > 0
            found = locate(ranges, size[real], rank[real])
            columns = [batch.column(0), *[batch.column(i).cast(pa.int64()) for i in (1, 2, 3)]]
            for name in ("bin_id", "offset", "bin_size", "bin_used"):
                full = np.zeros(len(size), np.int64)
                full[real] = found[name]
                columns.append(pa.array(full, mask=~real))
            yield pa.RecordBatch.from_arrays(columns, schema=_OUT)

    return rows.mapInArrow(place, ", ".join(f"{f.name} bigint" for f in _OUT))
