"""Scale: what a task holds, sorts or does again, on rows of its own."""

import sys
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import yaml

from pairlake.llm import substrings
from pairlake.llm import tokenfiles
from pairlake.operators import batches
from pairlake.operators import catalog as C
from pairlake.operators import kernels as K
from pairlake.operators import preparation as P
from pairlake.sources import documents as D
from pairlake.streaming import log as J


class _Held:
    """Stands for a DataFrame; gives the task function back."""

    def mapInArrow(self, run, ddl):
        return run


def test_outgoing_batches_are_bounded_by_bytes():
    def grow(r):
        yield r.k, np.full(200_000, float(r.k))

    run = batches.map_rows(_Held(), grow, "k bigint, data array<double>")
    found = list(run(iter([pa.RecordBatch.from_pydict({"k": list(range(40))})])))
    assert max(b.nbytes for b in found) < 20 << 20
    assert [k for b in found for k in b.column(0).to_pylist()] == list(range(40))
    assert all(set(row.values.to_numpy()) == {float(k)} for b in found for k, row in zip(b.column(0).to_pylist(), b.column(1)))


def test_items_of_one_split_are_parsed_by_all_tasks(spark):
    items = spark.range(400).selectExpr("'a: n' || id || '\n  b: [1, 2]' AS item").coalesce(1)
    rows = D.parse_descriptors(items, "a string, b array<int>")
    assert rows.rdd.getNumPartitions() > 1
    assert sorted(tuple(r) for r in rows.collect()) == sorted((f"n{i}", [1, 2]) for i in range(400))


@pytest.mark.parametrize("text", ["- a: 1\n  b: [x, 'y', null, ~, 2.5, 1e3, yes, 0o7, 010]", "- a: \"\\u00e9 \\U0001F600\"\n- é: ☃\n", "", "- {a: 1, b: {c: [1]}}"])
def test_yaml_is_read_as_by_the_plain_parser(text):
    assert D._yaml(text) == yaml.safe_load(text)


def test_scenes_are_distinct_before_they_meet(spark):
    reserve = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "image_set string")
    files = spark.createDataFrame([("a",)] * 50 + [("c",)] * 50, "image_set string")
    missing, present = C.missing_scenes(reserve, files), C.reserved_present(reserve, files)
    assert sorted((r[0] for r in missing.collect()), key=str) == [None, "b"]
    assert [r[0] for r in present.collect()] == ["a"]
    for found in (missing, present):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.index("Join") :]
        assert below.count("Aggregate") >= 2


def test_a_model_brings_few_rows_to_its_state(spark, tmp_path):
    schema = "model string, step bigint, metric string, value double"
    spark.range(500).selectExpr("'m' AS model", "id AS step", "'k' AS metric", "double(1000 - id) AS value").coalesce(1).write.parquet(
        str(tmp_path / "log")
    )
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "log"))
    found = J.run_available(J.stream_improvements(stream), str(tmp_path / "best"))
    assert [tuple(r) for r in found.select("model", "metric", "step", "value").collect()] == [("m", "k", 499, 501.0)]


def test_entries_of_a_task_are_reduced(monkeypatch):
    monkeypatch.setattr(J, "REDUCED_ROWS", 10)
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"model": [f"m{i}" for i in rng.integers(0, 30, 600)], "metric": "k"})
    rows["step"], rows["value"], rows["salt"] = np.arange(600), rng.integers(0, 9, 600).astype(float), 0
    rows.loc[::7, "value"] = np.nan
    sent = [pa.RecordBatch.from_pandas(rows[i : i + 50], preserve_index=False) for i in range(0, 600, 50)]
    got = pd.concat([b.to_pandas() for b in J._reduced(iter(sent))])
    least = lambda f: f.sort_values(["value", "step"]).drop_duplicates("model").sort_values("model")[["model", "step", "value"]]
    pd.testing.assert_frame_equal(least(got).reset_index(drop=True), least(rows).reset_index(drop=True), check_dtype=False)
    assert len(got) < len(rows)


def test_nan_never_stays_the_best():
    assert J._order(1.0, 5) < J._order(float("nan"), 1)
    assert J._order(float("nan"), 1) < J._order(float("nan"), 2)


def test_small_tiles_are_compared_together_as_one_by_one():
    rng = np.random.default_rng(3)
    rows = []
    for n in range(60):
        frame_h, frame_w = (8, 8) if n % 3 else (7, 5)
        image = {side: rng.random((3, frame_h, frame_w)) for side in ("gt", "f")}
        parts = {k: [{"y": 0, "x": 0, "h": frame_h, "w": frame_w, "data": v.ravel()}] for k, v in image.items()}
        y0, x0 = (0, 4 * (n % 2))
        rows.append(
            SimpleNamespace(
                gt_id=n, f_id=-n, c=3, y0=y0, x0=x0, h=4, w=min(4, frame_w - x0), frame_h=frame_h, frame_w=frame_w,
                gain=1 + n / 50, dy=n % 3 - 1, dx=n % 4 - 2, py=None if n % 2 else 0, px=0, gt_parts=parts["gt"], f_parts=parts["f"],
            )
        )
    calls = []
    plain, P_small = P._small_sums, P.SMALL
    P._small_sums = lambda key, held: calls.append(len(held)) or plain(key, held)
    try:
        together = [tuple(v.as_py() if hasattr(v, "as_py") else v for v in t) for cols in P._shift_sums(iter(rows), P._fresh) for t in zip(*cols)]
        P.SMALL = 0
        alone = [t for cols in P._shift_sums(iter(rows), P._fresh) for t in zip(*cols)]
    finally:
        P._small_sums, P.SMALL = plain, P_small
    assert max(calls) > 1
    got, expected = sorted(together), sorted(alone)
    assert [t[:4] for t in got] == [t[:4] for t in expected] and len(got) > 500
    np.testing.assert_allclose(np.array([t[4:] for t in got], float), np.array([t[4:] for t in expected], float), rtol=1e-12)
    assert K.overlap(3, 8) == (3, 7)


def test_words_are_numbered_exactly():
    strings = [b"a b a c", "\u00e9 x".encode(), b"c", b"b \xc2\xa0 a"]
    words = b" ".join(strings).split(b" ")
    seen: dict = {}
    assert substrings.numbered(strings).tolist() == [seen.setdefault(w, len(seen)) for w in words]


def test_a_worker_remembers_chunks():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    vars(sys).pop("_pairlake_chunks", None)
    first = tokenfiles.remembered(path)
    texts = ["one two  three\n\nfour", "", "two \x1c three", "five"]
    ids, ends = first.encode(texts)
    again = tokenfiles.remembered(path)
    assert again is first and not again.new
    # A failed task leaves a chunk without ids.
    again["left behind"]
    mended = tokenfiles.remembered(path)
    got, edges = mended.encode(["left behind", *texts])
    fresh, places = tokenfiles.Chunks(path).encode(["left behind", *texts])
    assert got.tolist() == fresh.tolist() and edges.tolist() == places.tolist()
    assert ids.tolist() == got[edges[1] :].tolist()
    vars(sys).pop("_pairlake_chunks", None)
