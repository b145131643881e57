"""Orders, batches and augmentation of training samples."""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlake.operators import kernels as K
from pairlake.operators.batches import map_rows
from pairlake.operators.crops import uniform
from pairlake.operators.scan import ranked


ROUNDS = 4


def permuted(rank: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A bijection of 0 .. n-1 fixed by the seed: a Feistel network over the next power of four, walked until inside."""
    bits = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << bits) - 1

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> bits, x & mask
        for i in range(ROUNDS):
            key = (seed * 1000003 + i * 7919) % (1 << 31)
            left, right = right, left ^ ((right * 2654435761 + key) >> 7 & mask)
        return left << bits | right

    x = once(rank.astype(np.int64))
    while (outside := x >= n).any():
        x[outside] = once(x[outside])
    return x


def seeded_shuffle(df: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Rows with their `position`, from 0, in an order fixed by the seed and the order of `keys`.

    Ranks of the keys come from a range scan and go through a bijection, so no row moves to its
    position. `keys` must tell rows apart for the order to be the same in every run. Up to 2^40 rows.
    """
    ranks = ranked(df, [], [F.col(k) for k in keys], "position")
    n = df.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(batch.num_columns - 1).to_numpy() - 1
            yield batch.set_column(batch.num_columns - 1, "position", pa.array(permuted(rank, n, seed)))

    return ranks.mapInArrow(run, ranks.schema)


def training_batches(
    clean: DataFrame,
    noisy: DataFrame,
    clean_slots: int,
    noisy_slots: int,
    seed: int,
    steps: int | None = None,
) -> DataFrame:
    """Batches of shuffled clean and noisy samples: (batch, side, slot, key, crop).

    Both streams are shuffled by a seeded hash and dealt out batch by batch, up to the
    shorter stream and to `steps`. A side without slots borrows one from the other and
    deals the other's samples. `clean` and `noisy` have key and n_crops; each crop takes a
    row of the batch.
    """
    if clean_slots + noisy_slots == 0:
        raise ValueError("both sides have no slots")
    if clean_slots == 0:
        clean, clean_slots, noisy_slots = noisy, 1, noisy_slots - 1
    elif noisy_slots == 0:
        noisy, noisy_slots, clean_slots = clean, 1, clean_slots - 1

    def dealt(rows: DataFrame, side: str, slots: int) -> DataFrame:
        shuffled = rows.select("key", "n_crops", uniform(F.col("key"), seed, side).alias("_order"))
        return ranked(shuffled, [], [F.col("_order"), F.col("key")], "_rank").selectExpr(
            f"CAST((_rank - 1) div {slots} AS bigint) AS batch",
            f"'{side}' AS side",
            f"CAST((_rank - 1) % {slots} AS int) AS slot",
            "key",
            "n_crops",
        )

    # Two counts decide where the shorter stream ends.
    ends = [-(-clean.count() // clean_slots), -(-noisy.count() // noisy_slots)] + ([] if steps is None else [steps])
    both = dealt(clean, "clean", clean_slots).unionByName(dealt(noisy, "noisy", noisy_slots))
    return both.filter(F.col("batch") < min(ends)).selectExpr(
        "batch", "side", "slot", "key", "explode(sequence(0, n_crops - 1)) AS crop"
    )


# -- augmentation ------------------------------------------------------------------

# Parameter ranges of the augmentation steps.
EDGES_ALPHA = (0.01, 0.5)
GAMMA_RANGE = (1.8, 2.2)
SIGMOID_GAIN = (5.0, 20.0)
SIGMOID_CUTOFF = (0.3, 0.7)
SHARPEN_TAPS = (3, 5)
SHARPEN_SIGMA = (0.5, 1.5)
# Centres of the simple augmentation, varied by a quarter either way.
SIMPLE_CENTRES = {"equalize_weight": 0.33, "contrast": 1.25, "saturation": 1.5, "gamma": 2.0, "sharpness": 2.0}


def augment_parameters(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Steps and parameters drawn from the key of the clean crop, the same for both sides
    of a pair. Each step is skipped one time in eight."""

    def draw(name: str) -> Column:
        return uniform(F.col(key), seed, name)

    def between(name: str, bounds: tuple[float, float]) -> Column:
        return F.lit(bounds[0]) + draw(name) * (bounds[1] - bounds[0])

    steps = {n: F.floor(draw(n) * 8) > 0 for n in ("wb", "tonemap", "edges", "curve", "sigmoid", "sharpen")}
    return rows.withColumns(
        {
            **steps,
            "alpha": between("alpha", EDGES_ALPHA),
            "gamma": between("gamma", GAMMA_RANGE),
            "gain": F.floor(between("gain", SIGMOID_GAIN)).cast("int"),
            "cutoff": between("cutoff", SIGMOID_CUTOFF),
            "taps": F.when(draw("taps") < 0.5, SHARPEN_TAPS[0]).otherwise(SHARPEN_TAPS[1]),
            "sigma": between("sigma", SHARPEN_SIGMA),
        }
    )


def augment(crops: DataFrame, key: str, seed: int) -> DataFrame:
    """Augmented RGB crops (sample_id, c, h, w, data); one crop row is one image."""
    return _per_crop(augment_parameters(crops, key, seed), K.augment)


def simple_parameters(rows: DataFrame, key: str, seed: int) -> DataFrame:
    return rows.withColumns(
        {
            name: F.lit(centre) * (F.lit(0.75) + uniform(F.col(key), seed, name) * 0.5)
            for name, centre in SIMPLE_CENTRES.items()
        }
    )


def augment_simple(crops: DataFrame, key: str, seed: int) -> DataFrame:
    return _per_crop(simple_parameters(crops, key, seed), K.augment_simple)


def _per_crop(rows: DataFrame, kernel) -> DataFrame:
    kind = dict(rows.dtypes)["sample_id"]

    def run(r: SimpleNamespace) -> Iterator[tuple]:
        image = np.asarray(r.data, dtype=np.float64).reshape(r.c, r.h, r.w)
        yield r.sample_id, r.c, r.h, r.w, kernel(image, r).ravel()

    return map_rows(rows, run, f"sample_id {kind}, c int, h int, w int, data array<double>")
