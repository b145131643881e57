"""Readers, writers and streams on small files."""

import json

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F

from pairlake.operators import results as R
from pairlake.sources import documents as D
from pairlake.sources import files as L
from pairlake.sources import sinks as W
from pairlake.streaming import log as J

DDL = "gt_fpath string, is_bayer boolean, raw_gain double, best_alignment array<int>, crops array<struct<coordinates: array<int>>>"


def test_read_descriptors_splits_a_list_document(spark, tmp_path):
    entries = [
        {
            "gt_fpath": f"a - b/{i}.cr2",
            "is_bayer": i % 2 == 0,
            "raw_gain": None if i % 5 == 0 else i / 4,
            "best_alignment": [i, -i],
            "crops": [{"coordinates": [768 * j, 0]} for j in range(i % 3)],
        }
        for i in range(40)
    ]
    (tmp_path / "d.yaml").write_text(yaml.safe_dump(entries))
    rows = D.read_descriptors(spark, str(tmp_path / "d.yaml"), DDL).collect()
    got = sorted(
        (r.gt_fpath, r.is_bayer, r.raw_gain, r.best_alignment, [c.coordinates for c in r.crops]) for r in rows
    )
    expected = sorted(
        (e["gt_fpath"], e["is_bayer"], e["raw_gain"], e["best_alignment"], [c["coordinates"] for c in e["crops"]])
        for e in entries
    )
    assert got == expected


def test_read_results(spark, tmp_path):
    for model in ("m1", "m2"):
        (tmp_path / model).mkdir()
        log = {"10": {"val": 0.5, "gone": None}, "20": {"val": 0.25}, "best_step": {"val": 20}, "best_val": {"val": 0.25}}
        (tmp_path / model / "trainres.json").write_text(json.dumps(log))
    rows = D.read_results(spark, str(tmp_path)).filter("value IS NOT NULL")
    assert sorted(map(tuple, rows.collect())) == [
        ("m1", 10, "val", 0.5), ("m1", 20, "val", 0.25), ("m2", 10, "val", 0.5), ("m2", 20, "val", 0.25),
    ]
    best = R.best_step(rows).collect()
    assert {(b.model, b.best_step) for b in best} == {("m1", 20), ("m2", 20)}


def test_read_results_in_yaml(spark, tmp_path):
    (tmp_path / "m3").mkdir()
    (tmp_path / "m3" / "trainres.yaml").write_text("10:\n  val: 0.5\n  gone: null\n  sizes: [1, 2]\nbest_step:\n  val: 10\n")
    rows = D.read_results(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in rows} == {("m3", 10, "val", 0.5), ("m3", 10, "gone", None)}


def test_read_npy_tiles(spark, tmp_path):
    arrays = {"a.0_0.npy": np.arange(24.0).reshape(2, 3, 4), "b.0_0.npy": np.ones((5, 6), np.float16)}
    for name, array in arrays.items():
        np.save(tmp_path / name, array)
    got = {r.path.split("/")[-1]: r for r in L.read_npy_tiles(spark, str(tmp_path)).collect()}
    assert (got["a.0_0.npy"].c, got["a.0_0.npy"].h, got["a.0_0.npy"].w) == (2, 3, 4)
    assert got["a.0_0.npy"].data == list(range(24))
    assert (got["b.0_0.npy"].c, got["b.0_0.npy"].h) == (1, 5)


def test_scan_files_keeps_the_root(spark, tmp_path):
    (tmp_path / "x" / "gt").mkdir(parents=True)
    (tmp_path / "x" / "gt" / "f.cr2").write_bytes(b"123")
    (tmp_path / "top.txt").write_bytes(b"1")
    rows = {(r.folder, r.name, r["size"]) for r in L.scan_files(spark, str(tmp_path)).collect()}
    assert rows == {("x/gt", "f.cr2", 3), ("", "top.txt", 1)}


def test_validity(spark, tmp_path):
    np.save(tmp_path / "good.npy", np.zeros(3))
    good = (tmp_path / "good.npy").read_bytes()
    files = spark.createDataFrame(
        [("a.npy", bytearray(good)), ("b.npy", bytearray(good[:20])), ("c.PNG", bytearray(b"no")), ("d.raf", bytearray())],
        "path string, content binary",
    )
    assert {r.path: r.valid for r in L.validate_files(files).collect()} == {
        "a.npy": True, "b.npy": False, "c.PNG": True, "d.raf": True,
    }
    opened = {r.path: r.valid for r in L.validate_files(files, open_images=True).collect()}
    assert not opened["c.PNG"]


def test_unknown_outcome_fails(spark):
    rows = spark.createDataFrame([("x", "MAYBE")], "path string, outcome string")
    with pytest.raises(Exception, match="unknown outcome"):
        L.conversion_report(rows).collect()


def test_csv_union(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "b int, a string")
    b = spark.createDataFrame([(2.5,)], "c double")
    W.write_csv_union([a, b], str(tmp_path / "u"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "u"))
    assert back.columns == ["a", "b", "c"] and back.count() == 2


def test_layout_is_not_overwritten(spark, tmp_path):
    rows = spark.createDataFrame([("f", "Bayer", "s", "gt")], "filename string, sensor string, scene string, role string")
    W.write_layout(rows, str(tmp_path / "l"))
    with pytest.raises(Exception, match="(?i)exist"):
        W.write_layout(rows, str(tmp_path / "l"))


def _log(spark, tmp_path, batches):
    schema = "model string, step bigint, metric string, value double"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    return schema, str(tmp_path / "log")


def test_streams_equal_their_batch_twins(spark, tmp_path):
    """Three arrivals, the stream continued after each from its own progress."""
    rng = np.random.default_rng(2)
    rows = [
        (m, s, k, None if rng.random() < 0.05 else float(rng.integers(0, 30)))
        for s in range(90)
        for m in ("a", "b")
        for k in ("x", "y")
    ]
    schema = "model string, step bigint, metric string, value double"
    folder = str(tmp_path / "log")
    tables = {}
    for part in range(3):
        batch = [r for r in rows if r[1] // 30 == part]
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        tables["best"] = J.run_available(J.stream_improvements(stream, salts=4), str(tmp_path / "best"))
        tables["cuts"] = J.run_available(J.stream_plateau(stream, 6, 0.5), str(tmp_path / "cuts"))
    whole = spark.read.schema(schema).parquet(folder)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(J.settled_best(tables["best"])) == key(R.best_step(whole))
    assert key(tables["cuts"]) == key(R.plateau_schedule(whole, 6, 0.5))
    assert tables["cuts"].count() > 0


def test_captures_arrive_once(spark, tmp_path):
    schema = "path string, sha1 string, mtime timestamp"
    folder = str(tmp_path / "files")
    for part in range(2):
        spark.range(20).selectExpr(
            f"concat('p{part}-', id) AS path", "concat('h', id % 12) AS sha1", f"timestamp_seconds({part} * 60 + id) AS mtime"
        ).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        seen = J.run_available(J.stream_captures(stream), str(tmp_path / "seen"))
    assert sorted(r.sha1 for r in seen.collect()) == sorted(f"h{i}" for i in range(12))


def test_late_captures_and_far_copies(spark, tmp_path):
    """New contents, copies of them a year later, then a new content that is two years late."""
    schema = "path string, sha1 string, mtime timestamp"
    folder = str(tmp_path / "files")
    for part, (first, day) in enumerate([(0, 400), (0, 765), (3, 800), (9, 10), (0, 900)]):
        spark.range(first, first + 5).selectExpr(
            f"concat('p{part}-', id) AS path", "concat('h', id) AS sha1", f"timestamp_seconds({day} * 86400 + id) AS mtime"
        ).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        seen = J.run_available(J.stream_captures(stream), str(tmp_path / "seen"))
    whole = spark.read.schema(schema).parquet(folder)
    assert sorted(r.sha1 for r in seen.collect()) == sorted(r.sha1 for r in whole.select("sha1").distinct().collect())
