"""Operators on small tables with odd rows, and the queries against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from pairlake.llm import (
    components,
    dartminhash,
    decontaminate,
    extract,
    packing,
    piececount,
    quality,
    queries,
    secrets,
    substrings,
    tokenfiles,
    toxicity,
)
from pairlake.llm.queries import _tokenizer

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, blob string, bands int"


def words(seed, n):
    chooser = random.Random(seed)
    return " ".join("".join(chooser.choices("abcdefgh", k=chooser.randint(3, 9))) for _ in range(n))


LONG = words(9, 30_000)
NEAR = words(1, 200)
ROWS = [
    (1, NEAR, "s"),
    (2, NEAR, "s"),
    (2, NEAR, "s"),
    (3, " ".join(w + "x" if i == 100 else w for i, w in enumerate(NEAR.split())), "t"),
    (4, None, "s"),
    (5, "", None),
    (6, " \n\t ", None),
    (7, LONG, "t"),
    (8, "two words", "u"),
    (8, "other text under a used number", "u"),
    (None, words(2, 50), None),
    (9, words(3, 60) + ' password = "abcdefgh12" ' + words(4, 60) + " AKIA" + "A" * 16 + " " + "0af" * 20, "s"),
    (10, words(5, 90) + " " + " ".join(NEAR.split()[20:80]), "s"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", 0) for i, t, s in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def given():
    path = f"{SF}/documents.parquet"
    return duckdb.execute(f"SELECT doc_id, coalesce(text, '') FROM '{path}' ORDER BY doc_id").fetchall()


def classes_by_brute_force(rows):
    sets, parent = {}, {}
    for i, text in rows:
        parent[i] = i
        parts = text.encode().split()
        n = min(5, len(parts))
        sets[i] = Counter(tuple(parts[k : k + n]) for k in range(len(parts) - n + 1)) if parts else Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i].total(), sets[j].total()
            if a and b and min(a, b) >= 0.8 * max(a, b):
                shared = (sets[i] & sets[j]).total()
                if shared >= 0.8 * (a + b - shared):
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def kept_by_brute_force(rows):
    first = {}
    for i, text in rows:
        parts = text.encode().split()
        for k in range(len(parts) - 12):
            key = tuple(parts[k : k + 13])
            first[key] = min(i, first.get(key, i))
    found = {}
    for i, text in rows:
        parts = text.encode().split()
        gone = set()
        for k in range(len(parts) - 12):
            if first[tuple(parts[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        stay = b" ".join(w for k, w in enumerate(parts) if k not in gone)
        found[i] = (len(parts), len(gone), hashlib.sha256(stay).hexdigest())
    return found


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9), (7, 7)], "u bigint, v bigint")
    found = {r.node: r.component for r in components.components(edges).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}
    assert components.components(edges.limit(0)).count() == 0


def test_near_duplicates_query(spark):
    expected = classes_by_brute_force(given())
    assert {r.doc_id: r.class_id for r in queries.op9_near_duplicates(spark, SF).collect()} == expected


def test_links_that_no_centre_shows(spark):
    """Copies of an edited copy are linked to each other but not to the text they come from."""
    chooser = random.Random(4)
    base = words(11, 150).split()
    rows = []
    for family in range(6):
        edited = [w + "q" * (family + 1) if chooser.random() < 0.05 else w for w in base]
        for copy in range(4):
            text = [w + f"z{family}{copy}" if chooser.random() < 0.006 else w for w in edited]
            rows.append((family * 10 + copy, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.class_id for r in dartminhash.digest(docs).collect()}
    assert found == classes_by_brute_force(rows)


def test_texts_under_one_id_are_documents_of_their_own(spark):
    a, b, c = (words(seed, 80) for seed in (21, 22, 23))
    rows = [(1, a), (2, b), (2, c), (2, c), (3, c + " more"), (4, a), (4, b), (5, None), (5, ""), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted((r.doc_id, r.text or "") for r in dartminhash.one_of_each(docs).collect())
    assert kept == sorted([(1, a), (2, b), (2, c), (5, ""), (5, "")])
    found = Counter((r.doc_id, r.class_id, r.is_kept) for r in dartminhash.digest(docs).collect())
    assert found == {(1, 1, True): 1, (2, 2, True): 3, (3, 2, False): 1, (4, 1, False): 1, (4, 2, False): 1, (5, 5, True): 3}
    with pytest.raises(ValueError, match="_d_row"):
        dartminhash.one_of_each(docs.withColumn("_d_row", F.lit(1)))


def test_pairs_at_the_edge_of_the_threshold(spark):
    """Nine shingles of which eight are shared are 0.8 alike, eight of which seven are shared are less."""
    rows = []
    for n in range(40):
        text = words(100 + n, 13 - n % 2)
        rows += [(10 * n, text), (10 * n + 1, text + "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.class_id for r in dartminhash.digest(docs).collect()}
    assert found == {i: i - i % 10 if i // 10 % 2 == 0 else i for i, _ in rows}
    assert found == classes_by_brute_force(rows)


def test_substrings_query(spark):
    expected = kept_by_brute_force(given())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op7_substrings(spark, SF).collect()}
    assert got == expected and any(x[1] for x in got.values())


def test_token_queries(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(_tokenizer("byte_bpe_50k.json"))
    start, expected = 0, {}
    for i, text in given():
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        expected[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    rows = queries.op10_token_files(spark, SF).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows} == expected
    model = sentencepiece.SentencePieceProcessor(model_file=_tokenizer("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in queries.op2_token_counts(spark, SF).collect()}
    assert got == {i: (len(t.encode()), len(model.encode(t))) for i, t in given()}


def test_decontamination_query(spark):
    items = duckdb.execute(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    plain = {i: b" " + b" ".join(decontaminate.words_of(t)) + b" " for i, t in items}
    expected = {d: sorted(i for i, t in plain.items() if t in b" " + b" ".join(decontaminate.words_of(x)) + b" ") for d, x in given()}
    got = {r.doc_id: r["items"] for r in queries.op3_decontaminate(spark, SF).collect()}
    assert got == expected


def test_large_benchmarks_are_searched_in_blocks(spark, odd, monkeypatch):
    items = [(i, words(100 + i, 30) + ". " + words(200 + i, 8)) for i in range(24)] + [(3, words(103, 30)), (None, "x"), (90, None), (91, "?")]
    rows = [(i, words(300 + i, 150) + " " + items[i][1] + " " + items[(i + 7) % 24][1]) for i in range(24)]
    rows += [(5, rows[5][1]), (None, rows[6][1]), (77, None), (78, words(400, 200))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    one = sorted(map(str, decontaminate.matches(docs, benchmark).collect()))
    kept = sorted(map(str, decontaminate.drop_leaks(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "INDEX_WORDS", 700)
    many = decontaminate.matches(docs, benchmark)
    assert sorted(map(str, many.collect())) == one and len(one) == len(rows)
    assert {i for r in many.collect() for i in r["items"]} == set(range(24))
    assert sorted(map(str, decontaminate.drop_leaks(docs, benchmark).collect())) == kept and len(kept) == 2


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op4_toxicity(spark, folder).filter("held_out").collect()}
    marks = duckdb.execute(f"SELECT doc_id, toxic FROM '{folder}/labels.parquet'").fetchall()
    held = [(toxic, got[i]) for i, toxic in marks if i in got]
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in got)
    toxic = [r for t, r in held if t]
    clean = [r for t, r in held if not t]
    assert sum(r.predicted for r in toxic) > 0.85 * len(toxic)
    assert sum(r.predicted for r in clean) < 0.01 * len(clean)


def test_packing_query(spark):
    rows = queries.op5_pack(spark, SF).collect()
    length, bins = Counter(), {}
    for r in rows:
        length[r.doc_id] += r.length
        if r.length:
            bins.setdefault(r.bin_id, []).append(r)
    assert length == Counter({i: len(t.encode().split()) for i, t in given()})
    for parts in bins.values():
        parts.sort(key=lambda r: r.offset)
        assert parts[0].offset == 0
        assert all(a.offset + a.length == b.offset for a, b in zip(parts, parts[1:]))
        assert parts[-1].offset + parts[-1].length == parts[0].bin_used <= parts[0].bin_size


def test_ledger_scans_only_what_is_new(spark, odd):
    versions = odd.select(F.col("doc_id").alias("path"), "text")
    _, first = secrets.scan(versions, None, secrets.BASE)
    ledger = spark.createDataFrame(first.collect(), first.schema)
    blobs = versions.select(F.sha2(F.coalesce("text", F.lit("")), 256)).distinct().count()
    assert ledger.count() == blobs
    _, again = secrets.scan(versions, ledger, secrets.BASE)
    assert again.count() == 0
    paths, more = secrets.scan(versions, ledger, secrets.RULES)
    assert {tuple(r.tags) for r in more.collect()} == {tuple(r.tag for r in secrets.MORE)}
    whole = secrets.findings(paths, ledger.unionByName(more))
    assert sorted(map(str, whole.collect())) == sorted(map(str, secrets.findings(*secrets.scan(versions)).collect()))


def test_secrets_are_masked(odd):
    rows = {r.doc_id: r for r in secrets.mask(odd).filter("doc_id = 9").collect()}
    text = dict((i, t) for i, t, _ in ROWS)[9]
    assert "abcdefgh12" not in rows[9].text and "AKIA" not in rows[9].text and "0af0af" not in rows[9].text
    assert rows[9].text.startswith(text[:100]) and rows[9].n_chars == len(rows[9].text)
    assert rows[9].text.count("[secret]") == 3
    assert secrets.mask(odd).count() == len(ROWS)


def test_whole_keys_and_long_logins_are_masked(spark):
    body = "\n".join("MIIEow+/" * 8 for _ in range(400))
    key = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A\n\n{body}\n-----END RSA PRIVATE KEY-----"
    plain = key.replace("RSA ", "")
    texts = {
        1: f"before {key} between {plain} after",
        2: "before -----BEGIN PRIVATE KEY----- after - " + "- x " * 20_000,
        3: f"go to https://{'u' * 300}:{'p' * 3000}@host/x now",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = {r.doc_id: r.text for r in secrets.mask(docs).collect()}
    assert found[1] == "before [secret] between [secret] after"
    assert found[2] == texts[2].replace("-----BEGIN PRIVATE KEY-----", "[secret]")
    assert found[3] == "go to [secret]host/x now"
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", list(texts.items()))
    expected = {r[0]: r[-1] for r in connection.execute(secrets.ORACLE).fetchall()}
    assert {r.doc_id: r.spans for r in secrets.digest(docs).collect()} == expected


def test_odd_rows(spark, odd):
    assert extract.extract(odd.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.col("text").alias("html"))).count() == len(ROWS)
    items = spark.createDataFrame([(1, LONG[:300]), (2, None)], "item_id bigint, text string")
    found = {(r.doc_id, tuple(r["items"])) for r in decontaminate.digest(odd, items).collect()}
    assert (7, (1,)) in found and (1, ()) in found and len(found) == 11
    counted = piececount.digest(odd, _tokenizer("piece_bpe_32k.model")).collect()
    assert len(counted) == len(ROWS) and {r.n_tokens for r in counted if r.doc_id in (4, 5)} == {0}
    files = tokenfiles.digest(odd, _tokenizer("byte_bpe_50k.json")).orderBy("start").collect()
    assert [r.doc_id for r in files] == [None, 1, 2, 2, 3, 4, 5, 6, 7, 8, 8, 9, 10]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(files, files[1:]))
    judged = quality.digest(odd).collect()
    assert len(judged) == len(ROWS) and not any(r.kept for r in judged if r.doc_id in (4, 5, 6, 8))
    classes = dartminhash.digest(odd).collect()
    assert Counter((r.doc_id, r.class_id) for r in classes)[(2, 1)] == 2
    assert {r.class_id for r in classes if r.doc_id == 3} == {1}
    assert {r.class_id for r in classes if r.doc_id in (4, 5, 6)} == {4, 5, 6}
    stay = [r.doc_id for r in dartminhash.one_of_each(odd).collect()]
    assert sorted(stay, key=str) == sorted([1, 4, 5, 6, 7, 8, 8, None, 9, 10], key=str)
    removed = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.digest(odd).collect()}
    assert removed[2] == (200, 200) and removed[10] == (150, 60) and removed[1] == (200, 0) and removed[7] == (30_000, 0)
    pieces = packing.pack(odd).collect()
    assert sum(r.length for r in pieces) == sum(len((t or "").split()) for _, t, _ in ROWS)
    assert {r.bin_id for r in pieces if r.doc_id in (4, 5, 6)} == {None}
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (8, None)], "doc_id bigint, toxic int")
    scored = toxicity.digest(odd, labels).collect()
    assert len(scored) == len(ROWS) and all(0 <= r.score <= 1 for r in scored)


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([], "item_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    pages = empty.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.col("text").alias("html"))
    for df in (
        extract.extract(pages),
        piececount.digest(empty, _tokenizer("piece_bpe_32k.model")),
        decontaminate.digest(empty, items),
        toxicity.digest(empty, labels),
        packing.pack(empty),
        secrets.digest(empty),
        substrings.digest(empty),
        quality.digest(empty),
        dartminhash.digest(empty),
        tokenfiles.digest(empty, _tokenizer("byte_bpe_50k.json")),
    ):
        assert df.count() == 0


def test_pipeline_stages(spark, odd):
    """Every stage on its own input against brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "decontamination", "secret_scan", "best_fit_packing"]
    oracle = duckdb.connect()
    oracle.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    good = {i for i, in oracle.execute(f"SELECT doc_id FROM ({quality.ORACLE}) WHERE kept").fetchall()}
    expected = {i: t for i, t in given() if i in good}
    texts = []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        if "text" not in out.columns:
            break
        assert out.columns == docs.columns
        texts.append({r.doc_id: r.text for r in rows})
        docs = spark.createDataFrame(rows, docs.schema)
    assert texts[0] == expected
    one = classes_by_brute_force(list(texts[0].items()))
    assert set(texts[1]) == {i for i, c in one.items() if i == c}
    items = duckdb.execute(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()
    plain = [b" " + b" ".join(decontaminate.words_of(t)) + b" " for t, in items]
    assert set(texts[2]) == {
        i for i, t in texts[1].items() if not any(p in b" " + b" ".join(decontaminate.words_of(t)) + b" " for p in plain)
    }
    assert set(texts[3]) == set(texts[2])
    length = Counter()
    for r in rows:
        length[r.doc_id] += r.length
    assert length == Counter({i: len(t.split()) for i, t in texts[3].items()})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == odd.columns


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    assert name in E.queries() and E.oracle_sql()[name] == queries.ORACLES[name]


@pytest.mark.parametrize(
    "text, spans",
    [
        ("-----BEGIN " + "A " * 500_000, 0),
        ("-----BEGIN " + "A " * 500_000 + "PRIVATE KEY-----", 1),
        ("-----BEGIN RSA PRIVATE KEY----- x\n" * 20_000, 20_000),
        ("-----BEGIN RSA PRIVATE KEY----- " + "ab/+\n" * 200_000 + "-----END RSA PRIVATE KEY-----", 1),
        ("-----END " + "B " * 300_000 + "-----BEGIN EC PRIVATE KEY-----", 1),
        ("-----BEGIN A PRIVATE KEY-----\n-----END A PRIVATE KEY-----\n" + "-----BEGIN RSA PRIVATE KEY----- x\n" * 20_000, 20_001),
    ],
)
def test_long_key_like_texts_end(spark, text, spans):
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    found = [s for s in secrets.digest(docs).first()["spans"].split(",") if s.startswith("private_key")]
    assert len(found) == spans


def test_keys_as_one_pattern_finds_them(spark):
    rule = next(r for r in secrets.MORE if r.kind == "private_key")
    parts = ["-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----", "BEGIN A PRIVATE KEY-----", "END A PRIVATE KEY-----", "-----", "x", "\n"]
    chooser = random.Random(8)
    texts = {i: "".join(chooser.choices(parts, k=chooser.randint(1, 9))) for i in range(3000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = {r.doc_id: r.spans for r in secrets.digest(docs).collect()}
    expected = {i: ",".join(f"private_key:{m.start()}:{m.end()}" for m in re.finditer(rule.pattern, t)) for i, t in texts.items()}
    assert found == expected and sum("," in x for x in expected.values()) > 100


def test_token_files_hold_their_order_under_any_split(spark, tmp_path):
    path = _tokenizer("byte_bpe_50k.json")
    rows = [(i // 2 if i % 3 else None, f"text number {i % 7} of many") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    before = spark.conf.get("spark.sql.files.maxRecordsPerFile")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "2")
    try:
        tokenfiles.write(docs, str(tmp_path / "t"), path)
        found = tokenfiles.read(spark, str(tmp_path / "t")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxRecordsPerFile", before)
    found = sorted(found, key=lambda r: r["start"])
    assert len(found) == 60 and found[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(found, found[1:]))
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
