"""Odd inputs: one odd image, name or value must not end the job or take others with it."""

from pyspark.sql import functions as F

from pairlake.operators import frames, gates, preparation, results
from pairlake.session import configure
from pairlake.sources import documents


def _image(spark, planes):
    rows = [("i", 3, 2, 2, [float(v) for p in planes for v in p])]
    images = spark.createDataFrame(rows, "image_id string, c int, frame_h int, frame_w int, data array<double>")
    return frames.tile_frames(images)


def test_a_zero_channel_stays(spark):
    out = frames.gray_world(_image(spark, [[0.2] * 4, [0.4] * 4, [0.0] * 4])).first()
    assert list(out.data)[8:] == [0.0] * 4 and abs(out.data[0] - 0.2) < 1e-9


def test_a_flat_image_has_a_curve(spark):
    out = frames.log_tonemap(_image(spark, [[0.3] * 4] * 3)).first()
    assert len(out.data) == 12 and all(v is not None for v in out.data)


def test_equal_scores(spark):
    pairs = spark.createDataFrame([("s", "a", 0.5), ("s", "b", 0.5)], "image_set string, f_fpath string, rgb_msssim_score double")
    rows = gates.density_histogram(pairs, ["s"], 4).orderBy("bin").collect()
    assert [r.edge for r in rows] == [0.0, 0.25, 0.5, 0.75] and [r.density for r in rows] == [0.0, 0.0, 4.0, 0.0]


def test_stray_model_name(spark):
    chain = spark.createDataFrame(
        [("a_", True, True), ("a_-1", True, True), ("stray", True, True)], "model string, has_metric boolean, has_file boolean"
    )
    assert results.latest_iteration(chain).count() == 1


def test_one_row_per_cut_name(spark):
    rows = spark.createDataFrame(
        [("m", 1, "val_mse.None", 0.1), ("m", 1, "val_mse.gamma22", 0.2)], "model string, step bigint, metric string, value double"
    )
    assert [(r.metric, r.value) for r in results.losses_to_metrics(rows).collect()] == [("val_mse", 0.2)]


def test_odd_values_leave_the_log_whole(spark):
    doc = '{"1": {"a": 0.5, "l": [1, 2], "t": "text", "n": null}, "2": {"a": 1e-3}, "best_step": {"a": 1}, "best": 3}'
    docs = spark.createDataFrame([("m", doc)], "model string, doc string")
    found = {(r.step, r.metric): r.value for r in documents.parse_results(docs).collect()}
    assert found == {(1, "a"): 0.5, (1, "n"): None, (2, "a"): 0.001}
    assert {(r.step, r.metric) for r in documents.rejected_results(docs).collect()} == {(1, "l"), (1, "t")}


def test_edge_of_the_search_window(spark):
    data = [float((i * 7) % 11) / 11 + 0.01 for i in range(64)]
    moved = data[16:] + data[:16]
    images = spark.createDataFrame(
        [("g", 1, 8, 8, data), ("f", 1, 8, 8, moved)], "image_id string, c int, frame_h int, frame_w int, data array<double>"
    )
    pairs = spark.createDataFrame([("g", "f")], "gt_id string, f_id string")
    row = preparation.align_exhaustive(pairs, frames.tile_frames(images, 4), 1, 4).first()
    assert row.on_edge == (max(abs(row.dy), abs(row.dx)) == 1)


def test_configure(spark):
    assert configure(spark).conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.range(1).select(F.current_timezone()).first()[0] == "UTC"
