"""Hot groups: scans and joins must equal their plain forms when one key holds most rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairlake.operators import catalog as C
from pairlake.operators import results as R
from pairlake.operators.scan import CHUNK, in_chunks, ranked, running
from pairlake.operators.skew import checked_broadcast, salted_join, within_rows


def _hot(spark, n=4000):
    """Two thirds of the rows belong to key 0."""
    return spark.range(n).selectExpr(
        "CASE WHEN id % 3 < 2 THEN 0 ELSE id % 50 END AS k",
        "CAST(pmod(hash(id), 997) AS double) AS v",
        "CAST(pmod(hash(id, 1), 100000) AS bigint) AS o",
        "id",
    )


def test_hot_group_spans_ranges(spark):
    chunks = in_chunks(_hot(spark), ["k"], [F.col("o"), F.col("id")], 8)
    assert chunks.filter("k = 0").select(CHUNK).distinct().count() >= 4
    largest = chunks.groupBy(CHUNK).count().agg(F.max("count")).first()[0]
    assert largest < 4000 / 3


def test_running_equals_window(spark):
    df = _hot(spark)
    order = [F.col("o"), F.col("id")]
    scanned = running(
        df,
        ["k"],
        order,
        {
            "lo": ("min", F.col("v"), True),
            "before": ("max", F.col("v"), False),
            "total": ("sum", F.col("v"), True),
        },
    )
    w = Window.partitionBy("k").orderBy(*order)
    plain = df.select(
        "*",
        F.min("v").over(w).alias("lo"),
        F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total"),
    )
    assert sorted(map(tuple, scanned.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_ranked_without_keys(spark):
    places = ranked(_hot(spark), [], [F.col("o"), F.col("id")], "place")
    got = [r.place for r in places.orderBy("o", "id").collect()]
    assert got == list(range(1, 4001))


def test_ranked_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "k string, o int")
    assert sorted((r.k or "", r.o, r["rank"]) for r in ranked(df, ["k"], [F.col("o")]).collect()) == [
        ("", 1, 1),
        ("", 2, 2),
        ("a", 1, 1),
    ]


def test_salted_join_equals_join(spark):
    many = _hot(spark)
    few = spark.range(60).selectExpr("id AS k", "id * 10 AS w")
    for how in ("inner", "left"):
        salted = salted_join(many, few.filter("k <> 7"), ["k"], spread=["id"], how=how, rows_per_salt=100)
        plain = many.join(few.filter("k <> 7"), "k", how)
        assert sorted(map(tuple, salted.select("id", "k", "w").collect()), key=str) == sorted(
            map(tuple, plain.select("id", "k", "w").collect()), key=str
        )


def test_make_pairs_with_a_hot_scene(spark):
    files = spark.range(900).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 20) END AS image_set",
        "concat('f', id) AS path",
        "CASE WHEN id % 90 < 2 THEN 'gt' ELSE 'noisy' END AS role",
    )
    pairs = C.make_pairs(files, rows_per_salt=20)
    rows = files.collect()
    expected = {
        (g.path, f.path) for g in rows if g.role == "gt" for f in rows if f.image_set == g.image_set
    }
    assert {(r.gt_path, r.f_path) for r in pairs.collect()} == expected
    assert pairs.count() == len(expected)


def test_bounded_broadcast(spark):
    assert within_rows(spark.range(10), 10)
    assert not within_rows(spark.range(11), 10)
    big = spark.range(11)
    assert checked_broadcast(big, 10) is big


def _plateau(rows, patience):
    deadline, bests, cuts = patience, {}, []
    for step in sorted({s for s, _, _ in rows}):
        improved = False
        for s, metric, value in rows:
            if s == step and value <= bests.get(metric, float("inf")):
                bests[metric], improved = value, True
        if improved:
            deadline = step + patience
        elif step > deadline:
            cuts.append(step)
            deadline = step + patience
    return cuts


def test_plateau_crosses_ranges(spark):
    """A long log without improvement, cut into many ranges, must give the sequential answer."""
    rows = [("a", s, "m", 1.0 if s == 0 else 2.0 + s % 5) for s in range(0, 300)]
    rows += [("b", s, "m", float((s * 37) % 101)) for s in range(0, 200, 3)]
    df = spark.createDataFrame(rows, "model string, step bigint, metric string, value double")
    got = R.plateau_schedule(df, 7, 0.5, chunks=12).collect()
    for model in "ab":
        expected = _plateau([(s, m, v) for n, s, m, v in rows if n == model], 7)
        found = sorted((r.step, r.cuts, r.factor) for r in got if r.model == model)
        assert found == [(s, i + 1, 0.25 ** (i + 1)) for i, s in enumerate(expected)]
    assert any(r.model == "a" for r in got)


def test_deadline_maps_are_the_sequential_fold():
    chooser = random.Random(4)
    for _ in range(400):
        patience = chooser.randint(0, 12)
        steps = sorted(chooser.sample(range(60), chooser.randint(1, 20)))
        better = [chooser.random() < 0.15 for _ in steps]
        known = R.DeadlineMap(patience)
        for at, improved in zip(steps, better):
            known.step(at, improved)
        for start in {patience, *range(steps[0], steps[0] + patience + 1)} if steps[0] else {patience}:
            deadline, cuts = start, 0
            for at, improved in zip(steps, better):
                if improved or at > deadline:
                    cuts, deadline = cuts + (not improved), at + patience
            assert R.DeadlineMap.apply(known.limits, known.ends, known.cuts, start) == (deadline, cuts)
        assert len(known.limits) <= patience + 2


def test_content_duplicates_hot_content(spark):
    files = spark.range(500).selectExpr(
        "id AS seq", "concat('p', id) AS path", "CASE WHEN id % 2 = 0 THEN 'same' ELSE concat('c', id) END AS sha1"
    )
    found = C.content_duplicates(files).collect()
    assert {r.path for r in found} == {f"p{i}" for i in range(2, 500, 2)}
    assert {r.kept for r in found} == {"p0"}
