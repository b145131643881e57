"""Host-level quality rules.

Every document is measured in one pass over its text. Rule failures are added up per host,
each host's failure rate is shrunk towards a beta prior estimated from all hosts, and the
verdict on the host is joined back to its documents.

Defined results: null text is empty text; a null host is a host of its own; repeated rows
are judged each on their own and all count for their host; an empty table gives no rows;
further columns pass through `judge` unchanged (its own columns begin with `_q_`).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlake.llm.common import bounded_batches, text_of
from pairlake.operators.skew import within_rows
from pairlake.session import checkpointed

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: Share of a host's documents that may fail a rule before the host counts as bad.
HOST_LIMIT = 0.5
#: Prior strength of hosts whose rates do not differ, in documents.
STRONGEST = 10_000.0
#: Points of a rule; a document of a good host may have one, of a bad host none.
POINTS = {"symbols": 2, "shouting": 2, "repeated_lines": 1, "word_length": 1}

_FIELDS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long",
    "n_repeat_words": "long", "n_lines": "long", "n_upper": "long",
}
_CONTINUATION = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows whose word sequence stands twice or more in the text.

    Windows are named exactly: a pair of names gets a new name, so names of 2, 4 and 8
    words follow from sorting.
    """
    starts = len(words) - window + 1
    if starts < 2:
        return 0
    ids: dict[bytes, int] = {}
    names = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    size = 1
    while size < window:
        step = min(size, window - size)
        pairs = names[: len(names) - step] * len(words) + names[step:]
        names = np.unique(pairs, return_inverse=True)[1]
        size += step
    twice = np.bincount(names)[names] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The numbers in `_FIELDS` for one text in UTF-8."""
    words = text.split()
    chars = sum(map(len, words)) - len(text) + len(text.translate(None, _CONTINUATION))
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return (
        len(words),
        chars,
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(map(bytes.isupper, words)),
    )


def measured(texts: Column) -> Column:
    """The numbers in `_FIELDS` as a struct.

    Marked as not deterministic, so that a filter on the numbers does not measure the texts again below a join.
    """

    @F.pandas_udf(", ".join(f"{name} {kind}" for name, kind in _FIELDS.items()))
    def run(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t.encode()) for t in batch], columns=list(_FIELDS))

    return run.asNondeterministic()(texts)


def rules() -> dict[str, Column]:
    """Failed rules over the measured columns."""
    q = {name: F.col(f"_q_{name}") for name in _FIELDS}
    return {
        "symbols": 10 * q["n_symbols"] > q["n_words"],
        "shouting": 10 * q["n_upper"] > 3 * q["n_words"],
        "repeated_lines": 10 * q["n_dup_lines"] > 3 * q["n_lines"],
        "word_length": (q["word_chars"] < 2 * q["n_words"]) | (q["word_chars"] > 20 * q["n_words"]),
    }


def base_failed() -> Column:
    return (F.col("_q_n_words") < 20) | (100 * F.col("_q_n_repeat_words") > 30 * F.col("_q_n_words"))


def host_rates(rows: DataFrame, host: str) -> DataFrame:
    """One row per host: documents, failures, the rate shrunk by the empirical beta prior, the verdict."""
    hosts = rows.groupBy(F.col(host).alias("_q_host")).agg(
        F.count(F.lit(1)).alias("_q_docs"), F.sum(F.col("_q_failed").cast("long")).alias("_q_failures")
    )
    hosts = checkpointed(hosts)
    rate = F.col("_q_failures") / F.col("_q_docs")
    prior = hosts.agg(
        (F.sum("_q_failures") / F.sum("_q_docs")).alias("mean"),
        F.var_pop(rate).alias("spread"),
        F.avg(F.lit(1.0) / F.col("_q_docs")).alias("noise"),
    ).first()
    mean = prior["mean"] or 0.0
    around = mean * (1.0 - mean)
    between = (prior["spread"] or 0.0) - around * (prior["noise"] or 0.0)
    strength = min(STRONGEST, max(1.0, around / between - 1.0)) if between > 0 else STRONGEST
    shrunk = (F.col("_q_failures") + F.lit(mean * strength)) / (F.col("_q_docs") + F.lit(strength))
    return hosts.select("_q_host", "_q_docs", shrunk.alias("_q_host_rate"), (shrunk > HOST_LIMIT).alias("_q_bad_host"))


def judge(docs: DataFrame, host: str = "source", text: str = "text", carry: bool = True) -> DataFrame:
    """`docs` with the measured columns, `_q_base_failed`, `_q_host_rate`, `_q_bad_host` and `_q_kept`.

    With `carry` false the text is left behind once it is measured, and the measured rows are
    written once for the host statistics and the final join. With `carry` true both measure
    the texts: that costs less than a second copy of them in the checkpoint folder. The host table
    is broadcast if its rows are counted to be few; beyond that the join shuffles both
    written tables, where adaptive execution splits a hot host.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.withColumn("_q", measured(text_of(text)))
    rows = rows.select(
        *[F.col(f"`{c}`") for c in docs.columns if carry or c != text],
        *[F.col(f"_q.{name}").alias(f"_q_{name}") for name in _FIELDS],
    )
    failed = rules()
    points = sum((F.when(failed[name], F.lit(n)).otherwise(F.lit(0)) for name, n in POINTS.items()), F.lit(0))
    rows = rows.withColumn("_q_base_failed", base_failed()).withColumn("_q_points", points)
    rows = rows.withColumn("_q_failed", F.col("_q_base_failed") | (F.col("_q_points") > 0))
    rows = rows if carry else checkpointed(rows)
    hosts = checkpointed(host_rates(rows, host))
    hosts = F.broadcast(hosts) if within_rows(hosts) else hosts
    joined = rows.join(hosts, F.col(host).eqNullSafe(F.col("_q_host")), "left").drop("_q_host")
    limit = F.when(F.col("_q_bad_host"), F.lit(1)).otherwise(F.lit(2))
    return joined.withColumn("_q_kept", ~F.col("_q_base_failed") & (F.col("_q_points") < limit))


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    return judge(docs, host).filter("_q_kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame, host: str = "source") -> DataFrame:
    """The figures of every document."""
    judged = judge(docs.select("doc_id", host, "text"), host, carry=False)
    return judged.select(
        "doc_id",
        *[F.col(f"_q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("_q_base_failed").alias("base_failed"),
        F.col("_q_kept").alias("kept"),
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), starts AS (
  SELECT r, i, array_to_string(w[i:i + 7], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM starts) WHERE c > 1
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r
), upper AS (
  SELECT r, count(*) AS n_upper FROM (SELECT r, unnest(w) AS x FROM d)
  WHERE regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]') GROUP BY r
), m AS (
  SELECT d.r, doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines,
         coalesce(n_upper, 0) AS n_upper
  FROM d LEFT JOIN lines USING (r) LEFT JOIN covered USING (r) LEFT JOIN upper USING (r)
), j AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         CASE WHEN 10 * n_symbols > n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_upper > 3 * n_words THEN 2 ELSE 0 END
         + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 1 ELSE 0 END
         + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 1 ELSE 0 END AS points
  FROM m
), h AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR points > 0) AS f FROM j GROUP BY source
), p AS (
  SELECT sum(f) / sum(n) AS mean, var_pop(f / n) - mean * (1 - mean) * avg(1.0 / n) AS between_hosts FROM h
), s AS (
  SELECT mean, CASE WHEN between_hosts > 0
                    THEN least(10000.0, greatest(1.0, mean * (1 - mean) / between_hosts - 1)) ELSE 10000.0 END AS strength
  FROM p
), v AS (SELECT source, (f + mean * strength) / (n + strength) > 0.5 AS bad FROM h, s)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND points < CASE WHEN bad THEN 1 ELSE 2 END AS kept
FROM j JOIN v ON j.source IS NOT DISTINCT FROM v.source
"""
