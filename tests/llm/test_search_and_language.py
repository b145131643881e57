"""Hard negatives, resampling and language identification on odd rows and against brute force."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairlake.llm import importance, langid, negatives
from pairlake.llm.queries import _tokenizer

VOCABULARY = _tokenizer("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id bigint, text string, lang string, source string, n_words string, score string, rank int"


# Hard negatives


def mined(rows):
    """(anchor, positive, rank, negative, both scores) by comparing all rows, in whole numbers."""
    able = []
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = int(math.fmod(label + 1, 10)) if i is not None and i % 7 == 0 else label
        row = (i, label, tuple(math.floor(256 * x) for x in v))
        if row not in able:
            able.append(row)
    found = []
    for a in able:
        if a[0] is None or a[0] % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(a[2], r[2])), r[0] is None, r[0] or 0, r) for r in able if r is not a]
        scored.sort(key=lambda s: s[:3])
        for s, _, _, p in [s for s in scored if s[3][1] == a[1]][:5]:
            band = [n for n in scored if n[3][1] != a[1] and 50 * -s <= 100 * -n[0] <= 95 * -s][:3]
            found += [(a[0], p[0], k + 1, n[3][0], -s, -n[0]) for k, n in enumerate(band)]
    return Counter(found)


def vectors(seed, n, width, labels=3, shift=0.0):
    chooser = random.Random(seed)
    return [(i, chooser.randrange(labels), [chooser.gauss(shift, 0.3) for _ in range(width)]) for i in range(n)]


SAME = [0.5, 0.25, -0.75, 0.1]
CASES = {
    "few": vectors(1, 260, 8, shift=0.1),
    "wide": vectors(2, 160, 100),
    "ties": [(i, i % 3, [round(x, 0) for x in v]) for i, _, v in vectors(3, 220, 4, shift=0.4)],
    "odd": vectors(4, 120, 4, shift=0.2)
    + [(50, 1, SAME), (50, 1, SAME), (50, 2, SAME), (None, 1, SAME), (None, 2, [0.4, 0.2, -0.5, 0.1]), (7, None, SAME)]
    + [(8, 1, None), (9, 1, [None, 1.0, 1.0, 1.0]), (10, 1, [math.nan, 1.0, 1.0, 1.0]), (11, 2, [math.inf] * 4), (12, 1, [])]
    + [(100, 1, [0.5]), (-50, 0, [0.9, 0.1, 0.1, 0.1, 0.7]), (13, 1, [0.0] * 4), (700, 9, SAME), (14, -4, SAME)],
    "large": [(i, l, [2.0**21 * x for x in v]) for i, l, v in vectors(5, 60, 4, shift=0.2)],
}


@pytest.mark.parametrize("name", CASES)
def test_hard_negatives_as_brute_force(spark, name):
    rows = CASES[name]
    schema = "vec_id bigint, label int, embedding array<double>, score string, rank int, x int"
    df = spark.createDataFrame([(i, l, v, "c", 0, 0) for i, l, v in rows], schema).repartition(3)
    found = negatives.digest(df)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = Counter(tuple(r) for r in found.collect())
    want = mined(rows)
    assert want and got == want


def test_hard_negatives_in_blocks_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    rows = vectors(6, 520, 8, shift=0.1)
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    assert Counter(tuple(r) for r in negatives.digest(df).collect()) == mined(rows)


def test_hard_negatives_of_no_rows(spark):
    df = spark.createDataFrame([], "vec_id bigint, label int, embedding array<float>")
    assert negatives.digest(df).collect() == []
    df = spark.createDataFrame([(50, None, [1.0]), (1, 2, None)], "vec_id bigint, label int, embedding array<float>")
    assert negatives.digest(df).collect() == []


@pytest.mark.parametrize("width", [64, 128])
def test_bounds_hold_every_score_and_estimates_are_near(width):
    chooser = np.random.default_rng(1)
    x = np.floor(256 * chooser.normal(0, 0.2, (400, width)))
    x[7] = 0
    asks = negatives.Anchors(np.arange(40), np.zeros(40, np.int64), x[:40])
    lower, upper = asks.bounds(*negatives.encode(x))
    exact = x[:40] @ x.T
    assert (lower <= exact).all() and (exact <= upper).all()
    middle, spread = (lower + upper) / 2, np.abs(exact).std()
    assert np.corrcoef(middle.ravel(), exact.ravel())[0, 1] > 0.7
    # The bound says something: a vector's own score stands clear of the others' lower bounds.
    assert (upper - lower).mean() < 20 * spread


def test_rotation_keeps_products():
    x = np.random.default_rng(2).normal(size=(10, 128))
    assert np.allclose(negatives.rotate(x) @ negatives.rotate(x).T, x @ x.T)


# Importance resampling


def resampled(docs, target, longest=1):
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def buckets(text):
        w = cut.findall((text or "").translate(lower))
        parts = [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
        return len(w), [zlib.crc32(p.encode()) % 10_000 for p in parts]

    found = [(i, *buckets(t)) for i, t in docs]
    s, t = Counter(b for *_, f in found for b in f), Counter(b for x in target for b in buckets(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for i, n, f in found:
        gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in f]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    order = Counter()
    drawn = able[: 10 * len(able) // 100]
    for k, r in enumerate(drawn):
        order[r[0], r[2], r[3], r[4], k + 1] += 1
    for r in [r for r in rows if r[1] < 20] + able[len(drawn) :]:
        order[r[0], r[2], r[3], r[4], None] += 1
    return order


def prose(seed, n):
    chooser = random.Random(seed)
    return " ".join("".join(chooser.choices("abcdeÄéß9", k=chooser.randint(1, 4))) for _ in range(n))


TEXTS = [(i, prose(i, 5 + 3 * (i % 40))) for i in range(300)] + [
    (400, None),
    (401, ""),
    (402, "!!! \n --"),
    (403, prose(403, 60_000)),
    (404, "A-b_C\x00d\x7fé É " * 12),
    (None, prose(500, 50)),
    (None, None),
    (405, "日本語 テキスト " * 15),
]


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_as_brute_force(spark, longest):
    docs = spark.createDataFrame([(i, t, "en", "s", "c", "c", 0) for i, t in TEXTS], DOCS).repartition(4)
    items = [prose(7, 40), None, "", "é É ab AB"]
    target = spark.createDataFrame([(t,) for t in items], "text string")
    got = Counter(tuple(r) for r in importance.resample(docs, target, longest=longest).collect())
    assert got == resampled(TEXTS, items, longest)


def test_resampling_of_repeated_rows_and_empty_tables(spark):
    rows = [(5, prose(1, 30), "en", "s", "c", "c", 0)] * 40
    docs = spark.createDataFrame(rows, DOCS)
    none = spark.createDataFrame([], "text string")
    found = importance.resample(docs, none).collect()
    assert len(found) == 40 and sorted(r["rank"] for r in found if r["rank"]) == [1, 2, 3, 4]
    assert importance.resample(spark.createDataFrame([], DOCS), docs).collect() == []


def test_long_texts_go_through_in_parts(monkeypatch):
    texts = pa.array([prose(i, 30) for i in range(20)])
    whole = [importance.features(texts, 2, 1000)[0].tolist()]
    monkeypatch.setattr(importance, "CHUNK", 100)
    parts = list(importance.chunks(texts))
    assert len(parts) > 5 and [n for p in parts for n in importance.features(p, 2, 1000)[0].tolist()] == whole[0]


# Language identification


def small_trie(tmp_path, pieces):
    import base64

    path = tmp_path / "pieces"
    path.write_text("".join(f"{base64.b64encode(p.encode()).decode()} {i}\n" for i, p in enumerate(pieces)))
    return langid.Trie(str(path))


def segmentations(word, known):
    if not word:
        return [[]]
    number = {p: i for i, p in enumerate(known.pieces)}
    return [[number[word[:k]], *rest] for k in range(1, len(word) + 1) if word[:k] in number for rest in segmentations(word[k:], known)]


def test_forward_and_expected_uses_sum_all_segmentations(tmp_path):
    known = small_trie(tmp_path, [" a", "ab", "ba", "abab", " ab", "bab", "éa", "Ab", "a b"])
    assert b"Ab" not in known.pieces and b"a b" not in known.pieces
    chooser = np.random.default_rng(3)
    chance = chooser.uniform(0.01, 1, (len(known.pieces), 3))
    words = [w.encode() for w in (" a", " abab", " bababa", " éab", " zz", " ab", " abababab")]
    got = known.forward(words, chance)
    number = np.arange(1.0, len(words) + 1)
    uses = np.zeros(len(known.pieces))
    for w, word in enumerate(words):
        ways = segmentations(word, known)
        values = np.array([np.prod(chance[way], axis=0) for way in ways])
        assert np.allclose(got[w], np.log(values.sum(0)))
        for way, value in zip(ways, values[:, 1] / values[:, 1].sum()):
            for piece in way:
                uses[piece] += number[w] * value
    assert np.allclose(known.expected(words, number, chance[:, 1]), uses)


def test_long_and_rare_units_keep_their_proportion(tmp_path):
    known = small_trie(tmp_path, ["ab"])
    chance = np.full((len(known.pieces), 2), 1e-9)
    chance[:, 1] = 2e-9
    got = known.forward([b" " + "語".encode() * 40], chance)
    assert np.allclose(got, [[121 * math.log(1e-9), 121 * math.log(2e-9)]])


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r["doc_id"]: r for r in langid.digest(docs, VOCABULARY).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert len(found) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(found[r["doc_id"]]["held_out"] for r in held) and sum(r["held_out"] for r in found.values()) == len(held)
    assert sum(found[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.99 * len(held)


SPEECH = {"aa": "the house is near the river and the road", "bb": "das haus ist nah am fluss und an der straße"}


def languages(spark, held_lang="aa"):
    rows = []
    for i in range(60):
        lang = ("aa", "bb")[i % 2]
        rows.append((i, SPEECH[lang], held_lang if zlib.crc32(str(i).encode()) % 5 == 0 else lang, "s", "c", "c", 0))
    rows += [(100, None, "aa", "s", "c", "c", 0), (101, "", None, None, "c", "c", 0), (102, "12 345 !?", "bb", "s", "c", "c", 0)]
    rows += [(103, "the river", None, None, "c", "c", 0), (None, "am fluss", "aa", None, "c", "c", 0)]
    rows += [(104, "the house " * 30_000, None, "s", "c", "c", 0), (104, "der fluss", None, "s", "c", "c", 0)]
    rows += [(105, "x" * 50_000, None, "s", "c", "c", 0), (106, "語" * 5000 + " ²³", None, "s", "c", "c", 0)]
    return spark.createDataFrame(rows, DOCS)


def test_languages_of_odd_rows(spark):
    rows = langid.digest(languages(spark), VOCABULARY).collect()
    assert len(rows) == 69 and all(0 <= r["score"] <= 1 for r in rows)
    of = {}
    for r in rows:
        of.setdefault(r["doc_id"], set()).add(r["lang_pred"])
    assert [of[i] for i in (100, 101, 102)] == [{"und"}] * 3
    assert of[103] == {"aa"} and of[None] == {"bb"} and of[104] == {"aa", "bb"}
    assert all(of[i] == {("aa", "bb")[i % 2]} for i in range(60))
    assert of[105] <= {"aa", "bb"} and of[106] <= {"aa", "bb"}
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {False}


def test_labels_of_held_out_rows_change_nothing(spark):
    first, second = (
        {(r[0], r[2]): r[3] for r in langid.digest(languages(spark, lang), VOCABULARY).collect()} for lang in ("aa", "zz")
    )
    assert first.keys() == second.keys() and all(math.isclose(first[k], second[k], rel_tol=1e-9) for k in first)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a text", None, "s", "c", "c", 0)], DOCS)
    assert [tuple(r) for r in langid.digest(docs, VOCABULARY).collect()] == [(1, False, "und", 0.0)]
    assert langid.digest(spark.createDataFrame([], DOCS), VOCABULARY).collect() == []
