"""Near-duplicate documents by DartMinHash signatures.

A document is a weighted set: its five-word shingles, each weighted by how often it occurs
(a text of one to four words is one shingle). An element of weight w owns the strip [0, w) x [0, inf)
of the weight-rank plane. The strip is cut into unit regions; a hash of (element, region)
fixes how many darts fall into the region (Poisson, mean 1), each dart's rank and its
coordinate. The earliest dart of a coordinate is the signature there, and two documents
agree at a coordinate with the probability of their weighted Jaccard similarity. Regions are
thrown rank by rank until each coordinate has a dart, so a signature costs about
k (ln k + 3) darts whatever the number of shingles.

Signatures are cut into bands. Documents that share a band are candidates; candidates are
verified on 32-bit hashes of all their shingles, and pairs so near to 0.8 that equal hashes of different
shingles could decide (`_doubt`) once more on 64 bits. Classes are connected components of the
verified links. With 24 bands of 4 a pair at similarity 0.8 is missed with probability 3e-6.

Nodes are texts, not doc_ids: each distinct word sequence gets a number of its own when the table
of sequences is written. No group is expanded into all its pairs. Equal texts collapse to one node. In a
band group every member is compared with one centre; what members differ in from their centre
then decides exactly which pairs outside the centre's component can still be links
(`_unsettled`), and only those are compared.

Defined results: null and wordless texts have no shingles and stand alone; repeated rows
are copies (also under one doc_id); different texts under one doc_id are documents of their own, of one
class or several, and of a class the text with the smallest (doc_id, hash) stays; classes whose smallest
doc_id is the same have the same class_id; a null doc_id is carried as null and stands alone;
texts are compared whole, however long; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlake.llm.common import GOLDEN, WordHash, as_bytes, bounded_batches, grams, mix, text_of
from pairlake.llm.components import components
from pairlake.session import checkpointed

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 4

#: Cumulative Poisson probabilities (mean 1): a region holds as many darts as entries below its draw.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 20)]))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def elements(words: list[bytes], hashes: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of (shingle, number of its occurrence): the unit weights of the document."""
    if not words:
        return np.empty(0, np.uint64)
    values = grams(hashes, min(shingle, len(words)))
    values.sort()
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    copy = np.arange(len(values)) - np.repeat(first, np.diff(np.r_[first, len(values)]))
    return mix(values + copy.astype(np.uint64) * GOLDEN)


def signature(units: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """The earliest dart of each of `k` coordinates."""
    wanted = k * (np.log(k) + 3.0)
    found = np.zeros(k, np.uint64)
    filled = np.zeros(k, bool)
    start, ranks = 0, int(np.ceil(wanted / len(units)))
    while not filled.all():
        level = np.arange(start, start + ranks, dtype=np.uint64)
        regions = mix(units[None, :] ^ mix(level + np.uint64(1))[:, None])
        darts = np.searchsorted(_POISSON, _unit(mix(regions ^ GOLDEN)).ravel(), side="right")
        owner = np.repeat(np.arange(regions.size), darts)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix(regions.ravel()[owner] + (number.astype(np.uint64) + np.uint64(1)) * GOLDEN)
        rank = start + owner // len(units) + _unit(dart)
        at = (mix(dart ^ GOLDEN) % np.uint64(k)).astype(np.int64)
        order = np.argsort(rank, kind="stable")
        where, first = np.unique(at[order], return_index=True)
        new = ~filled[where]
        found[where[new]] = dart[order[first[new]]]
        filled[where] = True
        start, ranks = start + ranks, max(1, ranks // 2)
    return found


def band_keys(values: np.ndarray, bands: int = BANDS) -> np.ndarray:
    parts = values.reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for column in range(parts.shape[1]):
        key = mix(key * GOLDEN + parts[:, column])
    return key.view(np.int64)


_SIGNED = pa.schema(
    [("doc_id", pa.int64()), ("mark", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64()))]
)


def key_of(words: list[bytes]) -> bytes:
    """The name of a word sequence."""
    return xxhash.xxh3_128_digest(b" ".join(words))


def _sign(batches):
    hashes = WordHash()
    for batch in batches:
        keys, bands = [], []
        for text in as_bytes(batch.column(2)):
            words = text.split()
            keys.append(key_of(words) if words else None)
            bands.append(band_keys(signature(elements(words, hashes.of(words)))) if words else None)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=_SIGNED
        )


def _short(units: np.ndarray) -> np.ndarray:
    """The distinct upper halves of the units."""
    return np.unique((units >> np.uint64(32)).astype(np.uint32)).view(np.int32)


def _long(units: np.ndarray) -> np.ndarray:
    return units.view(np.int64)


def _expand(form, kind: pa.DataType):
    """A kernel from texts to (key, size, units); `size` counts the units on 64 bits."""

    def run(batches):
        hashes = WordHash()
        for batch in batches:
            keys, sizes, units = [], [], []
            for text in as_bytes(batch.column(0)):
                words = text.split()
                found = elements(words, hashes.of(words))
                keys.append(key_of(words))
                sizes.append(len(found))
                units.append(form(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(units, pa.list_(kind))],
                names=["key", "size", "units"],
            )

    return run


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, hash of the text, key of the word sequence, band keys); key and bands are null without words."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("mark"), text_of())
    return rows.mapInArrow(_sign, "doc_id bigint, mark bigint, key binary, bands array<bigint>")


def _units(docs: DataFrame, wanted: DataFrame, long: bool = False) -> DataFrame:
    """(node, size, units) of the `wanted` (node, doc_id, key), from the texts under these doc_ids."""
    texts = docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text"))
    # Written by itself, the list is seen to be small where it is, and the texts need no shuffle.
    ids = checkpointed(wanted.select("doc_id").distinct())
    texts = texts.join(ids, "doc_id", "left_semi").select("text")
    kernel, kind = (_expand(_long, pa.int64()), "bigint") if long else (_expand(_short, pa.int32()), "int")
    units = texts.mapInArrow(kernel, f"key binary, size int, units array<{kind}>").dropDuplicates(["key"])
    return units.join(wanted.select("node", "key"), "key").select("node", "size", "units")


def _compared(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """(node, centre) pairs with both sets of units as arrays `a` and `b` and their sizes `n` and `m`."""
    left = units.select("node", F.col("size").alias("n"), F.col("units").alias("a"))
    right = units.select(F.col("node").alias("centre"), F.col("size").alias("m"), F.col("units").alias("b"))
    return pairs.join(left, "node").join(right, "centre")


def _near(shared: Column, n: Column, m: Column) -> Column:
    return shared >= F.lit(SIMILARITY) * (n + m - shared)


def _doubt(n: Column, m: Column, none: float = 1e-9) -> Column:
    """Units that 32-bit hashes of sets of these sizes may share too many, or merge within a set.

    Their number is near a Poisson variable. It is taken as 0 below the expectation `none`; the bound above is
    passed with a probability under 1e-6.
    """
    mean = n.cast("double") * m.cast("double") / 2.0**32
    bound = F.when(mean < none, 0).when(mean < 1e-3, 1).otherwise(3 + F.ceil(mean + 6 * F.sqrt(mean)))
    return bound.cast("int")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (u, v) among pairs (node, centre, n, m, shared), `shared` counted on 32 bits."""
    n, m, shared = (F.col(c) for c in ("n", "m", "shared"))
    # A set merges its own units as often as half of two sets of its size share them wrongly.
    doubt = F.greatest(_doubt(n, n), _doubt(n, m), _doubt(m, m))
    ends = [F.col("node").alias("u"), F.col("centre").alias("v")]
    sure = pairs.filter(_near(shared - doubt, n, m)).select(*ends)
    edge = checkpointed(pairs.filter(_near(shared + doubt, n, m) & ~_near(shared - doubt, n, m)).select("node", "centre"))
    if edge.isEmpty():
        return checkpointed(sure)
    ends_of = edge.select(F.explode(F.array("node", "centre")).alias("node")).distinct()
    wanted = checkpointed(nodes.select("node", "doc_id", "key").join(ends_of, "node", "left_semi"))
    both = _compared(edge, checkpointed(_units(docs, wanted, long=True)))
    exact = both.filter(_near(F.size(F.array_intersect("a", "b")), F.col("n"), F.col("m"))).select(*ends)
    return checkpointed(sure.unionByName(exact))


def _stars(bands: DataFrame) -> DataFrame:
    """(node, centre): every member of a band group with the group's centre.

    The centre is the member with the largest groups over all its bands: of many edited
    copies that is the least edited one. A node's groups travel as one row (one entry per
    band at most), so its weight needs no join.
    """
    groups = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"))
    groups = checkpointed(groups.filter("n > 1"))
    own = bands.join(groups, ["band", "key"]).groupBy("node")
    own = checkpointed(own.agg(F.sum("n").alias("weight"), F.collect_list(F.struct("band", "key")).alias("groups")))
    grouped = own.select("node", "weight", F.inline("groups"))
    centres = grouped.groupBy("band", "key").agg(F.min(F.struct(-F.col("weight"), F.col("node"))).alias("best"))
    centres = centres.select("band", "key", F.col("best.node").alias("centre"))
    return checkpointed(grouped.join(centres, ["band", "key"]).select("node", "centre").distinct())


def _unsettled(stars: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs (u, v) of one star, in different components, that may still be links.

    A member differs from its centre by added and by removed units, so two members y and z
    differ by at least |added_y - added_z| + |removed_y - removed_z|; if they share no added
    unit, by at least added_y + added_z + |removed_y - removed_z|. A link keeps these sums
    within `(1 - s) / (1 + s)` of both sizes. The distinct (added, removed, size) figures of
    a star tell which members can meet without a shared added unit (`near`) and which need
    some (`both`); the latter are joined on their added units.
    Only members outside their centre's component can have links that the star lacks.
    """
    of_centre = label.select(F.col("node").alias("centre"), F.col("component").alias("_home"))
    rows = stars.join(label, "node", "left").join(of_centre, "centre", "left")
    rows = rows.withColumn("component", F.coalesce("component", "node"))
    rows = rows.withColumn("lone", F.col("component") != F.coalesce("_home", "centre")).drop("_home")
    open_stars = rows.filter("lone").select("centre").distinct()
    rows = checkpointed(rows.join(checkpointed(open_stars), "centre"))
    # What 32-bit hashes may bend is allowed for, but in small sets, where it takes a pair at the very edge and a
    # collision of probability 2e-5 to lose a link.
    bent = [_doubt(F.col(a), F.col(b), 2e-5) for a, b in ("nn", "nm", "mm")]
    rows = rows.withColumn("bent", F.greatest(*bent))
    figures = ["centre", "lone", "n_added", "n_removed", "n", "bent"]
    y, z = ({c: F.col(f"{side}.{c}") for c in [*figures, "k", "node", "component", "unit"]} for side in "yz")
    slack = F.lit((1 - SIMILARITY) / (1 + SIMILARITY)) * (y["n"] + z["n"]) + 1e-9 + 2 * (y["bent"] + z["bent"])
    removed = F.abs(y["n_removed"] - z["n_removed"])
    apart = F.abs(y["n_added"] - z["n_added"]) + removed <= slack
    other = (y["component"] != z["component"]) & (~z["lone"] | (y["node"] < z["node"]))

    distinct = checkpointed(rows.groupBy(*figures).agg(F.count(F.lit(1)).alias("k")))
    # A member is no partner of its own.
    alone = (y["k"] == 1) & z["lone"] & (y["n_added"] == z["n_added"]) & (y["n_removed"] == z["n_removed"]) & (y["n"] == z["n"])
    free = y["n_added"] + z["n_added"] + removed <= slack
    near = distinct.filter("lone").alias("y").join(distinct.alias("z"), (y["centre"] == z["centre"]) & free & ~alone)
    near = near.select("y.centre", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "yz" for c in figures[1:]])
    # A link shares at least `least` added units, so y may leave out its `least - 1` commonest ones.
    shares = F.ceil((y["n_added"] + z["n_added"] + removed - slack) / 2).alias("shares")
    both = distinct.filter("lone").alias("y").join(distinct.alias("z"), (y["centre"] == z["centre"]) & apart & ~alone & ~free)
    both = checkpointed(both.select("y.centre", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "yz" for c in figures[1:]], shares))

    def named(side: str) -> list[Column]:
        return [F.col("centre"), *[F.col(f"{side}_{c}").alias(c) for c in figures[1:]]]

    def tokens(met: DataFrame, *more: str) -> DataFrame:
        return met.select(*figures, *more, "node", "component", F.explode("added").alias("unit"))

    right = checkpointed(tokens(rows.join(both.select(*named("z")).distinct(), figures, "left_semi")))
    least = both.groupBy(*named("y")).agg(F.min("shares").alias("least"))
    common = right.groupBy("centre", "unit").agg(F.count(F.lit(1)).alias("held"))
    left = tokens(rows.join(least, figures), "least").join(common, ["centre", "unit"])
    rank = F.row_number().over(Window.partitionBy("centre", "node").orderBy(F.desc("held"), "unit"))
    left = checkpointed(left.withColumn("_rank", rank).filter("_rank >= least").drop("_rank", "held"))
    same = (y["centre"] == z["centre"]) & (y["unit"] == z["unit"])
    first = left.alias("y").join(right.alias("z"), same & apart & other)
    first = first.select(F.col("y.node").alias("u"), F.col("z.node").alias("v"))

    members = rows.select(*figures, "node", "component")

    def side(name: str) -> DataFrame:
        return members.select("centre", *[F.col(c).alias(f"{name}_{c}") for c in [*figures[1:], "node", "component"]])

    second = checkpointed(near)
    for name in "yz":
        second = second.join(side(name), ["centre", *[f"{name}_{c}" for c in figures[1:]]])
    second = second.filter("y_component <> z_component AND (NOT z_lone OR y_node < z_node)")
    second = second.select(F.col("y_node").alias("u"), F.col("z_node").alias("v"))
    pairs = first.unionByName(second)
    return checkpointed(pairs.select(F.least("u", "v").alias("node"), F.greatest("u", "v").alias("centre")).distinct())


def links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Verified links (u, v) that span the same components as all links of the band groups.

    `nodes` has (node, doc_id, key, bands) for each distinct text, `doc_id` a document that holds it.
    """
    stars = _stars(nodes.select("node", F.posexplode("bands").alias("band", "key")))
    starred = nodes.select("node", "doc_id", "key").join(stars.select("node").distinct(), "node", "left_semi")
    units = checkpointed(_units(docs, checkpointed(starred)))
    both = _compared(stars.filter("node <> centre"), units)
    both = both.select("node", "centre", "n", "m", F.size("a").alias("_a"), F.size("b").alias("_b"), F.array_except("a", "b").alias("added"))
    both = both.withColumn("n_added", F.size("added")).withColumn("shared", F.col("_a") - F.col("n_added"))
    stars = checkpointed(both.withColumn("n_removed", F.col("_b") - F.col("shared")).drop("_a", "_b"))
    found = _verified(stars.select("node", "centre", "n", "m", "shared"), nodes, docs)
    several = checkpointed(stars.groupBy("centre").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select("centre"))
    more = _unsettled(stars.join(several, "centre", "left_semi").drop("shared"), checkpointed(components(found)))
    both = _compared(more, units)
    late = both.select("node", "centre", "n", "m", F.size(F.array_intersect("a", "b")).alias("shared"))
    return found.unionByName(_verified(checkpointed(late), nodes, docs))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, key, class_id, kept) per row of `docs`.

    The class is its smallest doc_id; `kept` marks the rows with the text that stays.
    """
    rows = checkpointed(signed(docs))
    texts = rows.filter("key IS NOT NULL AND doc_id IS NOT NULL")
    nodes = texts.groupBy("key").agg(F.min(F.struct("doc_id", "mark", "bands")).alias("_first"))
    # Numbers hold once they are written.
    nodes = checkpointed(nodes.select("key", "_first.*", F.monotonically_increasing_id().alias("node")))
    label = checkpointed(components(links(nodes, docs)))
    least = nodes.select("node", "doc_id", "mark").join(label, "node").groupBy("component")
    least = checkpointed(least.agg(F.min(F.struct("doc_id", "mark")).alias("_least")))
    linked = label.join(least, "component").select("node", "_least")
    named = nodes.join(linked, "node", "left")
    named = checkpointed(named.select("key", F.coalesce("_least", F.struct("doc_id", "mark")).alias("_least")))
    joined = rows.drop("bands").join(named, "key", "left")
    known = F.col("doc_id").isNotNull()
    kept = F.col("_least").isNull() | (F.struct("doc_id", "mark") == F.col("_least"))
    class_id = F.when(known, F.coalesce("_least.doc_id", "doc_id"))
    return joined.select("doc_id", "mark", "key", class_id.alias("class_id"), (~known | kept).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each class (its smallest doc_id, of several texts under that the smallest hash) with its own columns."""
    if clash := {"_d_mark", "_d_row"} & set(docs.columns):
        raise ValueError(f"reserved column names: {sorted(clash)}")
    kind = docs.schema["doc_id"].dataType
    keep = classes(docs).filter("kept").select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("mark").alias("_d_mark"))
    # The join deals the texts by id and text, which the window needs too.
    kept = docs.filter("doc_id IS NOT NULL").withColumn("_d_mark", F.xxhash64("text"))
    kept = kept.join(keep, ["doc_id", "_d_mark"], "left_semi")
    again = F.row_number().over(Window.partitionBy("doc_id", "_d_mark").orderBy(F.lit(0)))
    kept = kept.withColumn("_d_row", again).filter("_d_row = 1").drop("_d_row")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return kept.select(*columns).unionByName(docs.filter("doc_id IS NULL").select(*columns))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: its class, and whether its text is the one that stays."""
    return classes(docs.select("doc_id", "text")).select("doc_id", "class_id", F.col("kept").alias("is_kept"))
