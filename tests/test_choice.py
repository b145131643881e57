"""Crop choice: summed areas against whole masks, fallback to the next crop."""

import numpy as np
import pytest

from pairlake.operators import choice as H

TILE = 7


def _masks(spark, masks, corner=(3, 5)):
    """Mask tiles of overlaps that begin at frame line `corner`, cut on the frame's grid."""
    rows = []
    for key, mask in masks.items():
        (top, left), (h, w) = corner, mask.shape
        for ty in range(top // TILE, (top + h - 1) // TILE + 1):
            for tx in range(left // TILE, (left + w - 1) // TILE + 1):
                y, x = max(ty * TILE, top), max(tx * TILE, left)
                y1, x1 = min((ty + 1) * TILE, top + h), min((tx + 1) * TILE, left + w)
                part = mask[y - top : y1 - top, x - left : x1 - left]
                rows.append((key, ty, tx, y, x, *part.shape, bytearray(np.packbits(part).tobytes())))
    return spark.createDataFrame(rows, "image_id string, ty int, tx int, y int, x int, h int, w int, mask binary")


def test_valid_samples_are_those_of_the_whole_mask(spark):
    rng = np.random.default_rng(1)
    masks = {"a": rng.random((25, 31)) > 0.4, "b": rng.random((9, 4)) > 0.5, "c": np.zeros((15, 15), bool)}
    rectangles = []
    for key, mask in masks.items():
        h, w = mask.shape
        for n in range(40):
            y0, x0 = rng.integers(0, h), rng.integers(0, w)
            rectangles.append((key, n, int(3 + y0), int(5 + x0), int(3 + rng.integers(y0, h) + 1), int(5 + rng.integers(x0, w) + 1)))
        rectangles += [(key, 40, 3, 5, 3 + h, 5 + w), (key, 41, 2, 5, 5, 7), (key, 42, 3, 5, 3 + h + 1, 6), (key, 43, 3, 4, 4, 6)]
    df = spark.createDataFrame(rectangles, "image_id string, n int, y0 int, x0 int, y1 int, x1 int")
    found = {(r.image_id, r.n): r.valid for r in H.valid_samples(df, H.mask_areas(_masks(spark, masks), ["image_id"]), ["image_id"], TILE).collect()}
    for key, n, y0, x0, y1, x1 in rectangles:
        if n < 41:
            assert found[key, n] == masks[key][y0 - 3 : y1 - 3, x0 - 5 : x1 - 5].sum()
        else:
            # Beyond the mask: no number, whichever side it leaves on.
            assert found.get((key, n)) is None


@pytest.mark.parametrize("n", [1, 3])
def test_images_fall_back_to_their_next_crop_and_drop_out(spark, n):
    good, bad = np.ones((20, 40), bool), np.zeros((20, 40), bool)
    half = good.copy()
    half[:, :20] = False
    masks = {**{f"half{i}": half for i in range(12)}, "good": good, "bad": bad, "small": good}
    crops = [(k, c, 3, 5 + 20 * c, 20, 20) for k in masks if k != "small" for c in (0, 1)]
    crops += [("small", 0, 3, 5, 8, 20), ("nomask", 0, 3, 5, 20, 20)]
    df = spark.createDataFrame(crops, "image_id string, crop_id int, y int, x int, h int, w int")
    rows = H.choose_crops(df, _masks(spark, masks), ["image_id"], n, 8, seed=5, tile=TILE).collect()
    by = {}
    for r in rows:
        by.setdefault(r.image_id, []).append(r)
        assert (r.y0 - 3) % 2 == 0 and (r.x0 - 5) % 2 == 0
        assert 3 <= r.y0 <= 15 and 5 + 20 * r.crop_id <= r.x0 <= 17 + 20 * r.crop_id
    assert set(by) == {"good", *(f"half{i}" for i in range(12))} and all(sorted(r.sample for r in v) == list(range(n)) for v in by.values())
    # The left crops are empty: whoever drew one first moves on, the others stay with their first.
    assert all(r.crop_id == 1 for k, v in by.items() if k != "good" for r in v)
    assert {v[0].turn for k, v in by.items() if k != "good"} == {0, 1} and by["good"][0].turn == 0


def test_middle_crop_leaves_small_ones_out(spark):
    crops = [("a", i, 0, 10 * i, 9 if i == 2 else 30, 31) for i in range(5)]
    crops += [("b", 0, 0, 0, 5, 5), ("c", 0, 4, 0, 12, 13), ("c", 1, 0, 0, 12, 5)]
    df = spark.createDataFrame(crops, "image_id string, crop_id int, y int, x int, h int, w int")
    found = {r.image_id: (r.crop_id, r.y0, r.x0) for r in H.middle_crop(df, ["image_id"], 12).collect()}
    # Without crop 2, the third of the four left is the middle one.
    assert found == {"a": (3, 8, 38), "c": (0, 4, 0)}


def test_crop_masks_are_windows_of_the_whole_mask(spark):
    from pairlake.operators import evaluate as V

    rng = np.random.default_rng(2)
    masks = {"a": rng.random((25, 31)) > 0.4, "b": rng.random((9, 4)) > 0.5}
    crops = [(k, c, y, x, 6, 8, "kept") for k in masks for c, (y, x) in enumerate([(0, 0), (2, 1), (5, 11), (20, 20)])]
    df = spark.createDataFrame(crops, "image_id string, crop_id int, y int, x int, h int, w int, more string")
    for compat in (False, True):
        rows = V.crop_masks(df, _masks(spark, masks), ["image_id"], compat, TILE).collect()
        assert len(rows) == len(crops)
        for r in rows:
            k = 1 if compat else 2
            wide = np.pad(masks[r.image_id], [(0, 60), (0, 60)])
            assert r.more == "kept" and list(r.mask) == wide[k * r.y : k * r.y + 6, k * r.x : k * r.x + 8].ravel().tolist()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000, 4097])
def test_permuted_is_a_bijection(n):
    from pairlake.operators.samples import permuted

    a, b = permuted(np.arange(n), n, 1), permuted(np.arange(n), n, 2)
    assert sorted(a) == sorted(b) == list(range(n)) and (n < 16 or (a != b).any())
    if n >= 1000:
        assert abs(np.corrcoef(a, np.arange(n))[0, 1]) < 0.1
