"""Secret scans with an incremental ledger of scanned blobs. DataFrame functions only.

Every version of a file is addressed by the SHA-256 of its content. The ledger holds one row
per scanned blob: the rule versions it was scanned with and the spans found. A scan takes one
row per blob, leaves out the rules whose present version the ledger already has for it, runs
the others, appends to the ledger, and joins the findings back to every path of the blob.

Positions come from JVM string functions: the matches of a rule and the gaps between them
(`split` keeps them all) have lengths that add up to offsets in code points.

Defined results: null text is empty text and has no spans; empty texts are one blob; repeated
rows and equal texts are scanned once and reported for each row; an empty table gives no
rows; only the named columns are read, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlake.llm.common import text_of
from pairlake.session import checkpointed


@dataclass(frozen=True)
class Rule:
    """A pattern (Java and RE2 syntax); a match counts if `least` characters are in `group`.

    Behind a text's last match of `needs` (all of it where there is none) only `lone` can match and is searched
    instead: it spares a pattern with a far end from looking for it from every beginning.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1
    lone: str = ""
    needs: str = ""

    @property
    def tag(self) -> str:
        return f"{self.kind}@{self.version}"


# Runs of one class are matched whole, so a least length may stand in the pattern; it may
# not in `assign`, whose failing matches hide later ones.
BASE = (
    Rule(
        "assign",
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"""
        r"""[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=8,
    ),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
# One class for the words of a header: a repeated group would recurse in the JVM once a word.
_KEY, _KEY_END = r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----END [A-Z ]*PRIVATE KEY-----"
#: Formats of public services, as their documentation gives them. A private key runs to the
#: next END line, whatever quotes or prefixes its lines have; without one its header stands alone.
MORE = (
    Rule(
        "private_key",
        _KEY + r"(?:[\s\S]*?" + _KEY_END + ")?",
        version=3,
        lone=_KEY,
        needs=_KEY_END,
    ),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/@]+@", version=2),
)
RULES = BASE + MORE

_SPAN = "struct<start:bigint,nth:int,kind:string,stop:bigint>"
LEDGER = f"blob string, tags array<string>, spans array<{_SPAN}>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, the value computed once."""
    return F.transform(F.array(value), use)[0]


def spans_of(text: Column, rule: Rule, nth: int) -> Column:
    """All spans of a rule in a text, in order."""
    if rule.needs:
        whole, lone = replace(rule, needs=""), replace(rule, pattern=rule.lone, needs="")
        # Up to the last end every match is closed by one and is passed once; behind it none needs a search for an end.
        head = F.regexp_extract(text, rf"([\s\S]*{rule.needs})", 1)

        def both(h: Column) -> Column:
            return _bound(spans_of(h, whole, nth), lambda found: F.concat(found, behind(F.length(h).cast("bigint"), found)))

        def behind(stop: Column, found: Column) -> Column:
            # A header may begin with the last five dashes of an end that closes nothing.
            used = F.coalesce(F.try_element_at(found, F.lit(-1))["stop"], F.lit(-1)) == stop
            return _bound(F.when(used, stop).otherwise(stop - 5), rest)

        def rest(at: Column) -> Column:
            tail = F.substring(text, (at + 1).cast("int"), F.length(text))
            return F.transform(
                spans_of(tail, lone, nth),
                lambda x: F.struct((x["start"] + at).alias("start"), x["nth"].alias("nth"), x["kind"].alias("kind"), (x["stop"] + at).alias("stop")),
            )

        return F.when(text.rlike(rule.needs), _bound(head, both)).otherwise(spans_of(text, lone, nth))
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    body = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, rule.pattern, -1)
    steps = F.zip_with(
        F.zip_with(found, body, lambda m, b: F.struct(m.alias("m"), b.alias("b"))),
        F.slice(gaps, F.lit(1), F.size(found)),
        lambda f, gap: F.struct(
            F.length(gap).cast("bigint").alias("gap"), F.length(f["m"]).cast("bigint").alias("n"), F.length(f["b"]).alias("b")
        ),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def add(state: Column, step: Column) -> Column:
        begin = state["at"] + step["gap"]
        stop = begin + step["n"]
        span = F.struct(
            begin.alias("start"), F.lit(nth).alias("nth"), F.lit(rule.kind).alias("kind"), stop.alias("stop")
        )
        kept = F.when(step["b"] >= rule.least, F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct(stop.alias("at"), kept.alias("out"))

    every = F.aggregate(steps, start, add)["out"]
    # Most texts have no match: one search settles them.
    return F.when(text.rlike(rule.pattern), every).otherwise(F.array().cast(f"array<{_SPAN}>"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Scan (path, text) versions; returns (blob of each path, rows to append to the ledger).

    The ledger may hold several rows of a blob, one for each scan that added rules.
    """
    tags = F.array(*[F.lit(r.tag) for r in rules])
    marked = versions.select("path", text_of().alias("text")).withColumn("blob", F.sha2("text", 256))
    paths = checkpointed(marked.select("path", "blob"))
    first = paths.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is None:
        todo = first.withColumn("todo", tags)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("tags"))).alias("seen"))
        todo = first.join(seen, "blob", "left")
        todo = todo.withColumn("todo", F.array_except(tags, F.coalesce("seen", F.array().cast("array<string>"))))
    todo = checkpointed(todo.filter(F.size("todo") > 0).select("blob", F.col("path").alias("_path"), "todo"))
    texts = marked.join(todo.withColumnRenamed("blob", "_blob"), F.col("path").eqNullSafe(F.col("_path")))
    texts = texts.filter("blob = _blob").select("blob", "text", "todo")
    none = F.array().cast(f"array<{_SPAN}>")
    spans = F.array_sort(
        F.concat(
            *[
                F.when(F.array_contains("todo", r.tag), spans_of(F.col("text"), r, i)).otherwise(none)
                for i, r in enumerate(rules)
            ]
        )
    )
    return paths, texts.select("blob", F.col("todo").alias("tags"), spans.alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def by_blob(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans by start and rule) for every blob with findings of the present rule versions."""
    ledger = ledger.filter(F.size("spans") > 0)
    kept = F.lit(False)
    for r in rules:
        kept = kept | ((F.col("s.kind") == r.kind) & F.array_contains("tags", r.tag))
    order = F.element_at(F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))]), F.col("s.kind"))
    found = ledger.select("blob", "tags", F.explode("spans").alias("s")).filter(kept)
    span = F.struct("s.start", order.alias("nth"), "s.kind", "s.stop")
    # A blob's spans are bounded by its text; several ledger rows of it may carry the same span.
    return checkpointed(found.groupBy("blob").agg(F.array_sort(F.collect_set(span)).alias("spans")))


def findings(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, spans by start and rule) for every path."""
    rows = paths.join(by_blob(ledger, rules), "blob", "left")
    return rows.select("path", "blob", F.coalesce("spans", F.array().cast(f"array<{_SPAN}>")).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document from a scan that starts with an empty ledger."""
    paths, new = scan(docs.select(F.col("doc_id").alias("path"), "text"))
    rows = findings(paths, checkpointed(new))
    base = F.filter("spans", lambda s: s["nth"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return rows.select(
        F.col("path").alias("doc_id"),
        *[count(r.kind) for r in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with every run of overlapping spans replaced by `[secret]`."""
    zero = F.lit(0).cast("bigint")
    start = F.struct(F.lit("").alias("out"), zero.alias("at"))

    def add(state: Column, span: Column) -> Column:
        gap = F.substring(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        out = F.when(span["start"] >= state["at"], F.concat(state["out"], gap, F.lit("[secret]"))).otherwise(state["out"])
        return F.struct(out.alias("out"), F.greatest(state["at"], span["stop"]).alias("at"))

    end = F.aggregate(spans, start, add)
    rest = F.substring(text, (end["at"] + 1).cast("int"), F.length(text))
    return F.when(F.size(spans) > 0, F.concat(end["out"], rest)).otherwise(text)


def mask(docs: DataFrame) -> DataFrame:
    """`docs` with secrets masked in `text` and `n_chars` brought up to date."""
    _, new = scan(docs.select(F.col("doc_id").alias("path"), "text"))
    found = by_blob(checkpointed(new)).select(F.col("blob").alias("_s_blob"), F.col("spans").alias("_s_spans"))
    rows = docs.withColumn("_s_own", F.sha2(text_of(), 256)).join(found, F.col("_s_own") == F.col("_s_blob"), "left")
    rows = rows.withColumn("_s_text", F.when(F.col("_s_spans").isNull(), F.col("text")).otherwise(masked(F.col("text"), F.col("_s_spans"))))
    changed = F.col("_s_spans").isNotNull()
    own = {"text": F.col("_s_text").alias("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(changed, F.length("_s_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return rows.select(*[own.get(c, F.col(f"`{c}`")) for c in docs.columns])


def _oracle_spans(rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    least = f"WHERE length(regexp_extract(m, '{pattern}', {rule.group})) >= {rule.least}" if rule.least else ""
    return f"""
SELECT r, {RULES.index(rule)} AS nth, '{rule.kind}' AS kind, start, start + length(m) AS stop FROM (
  SELECT r, m, sum(length(gap)) OVER w + sum(length(m)) OVER w - length(m) AS start FROM (
    SELECT r, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, unnest(range(1, len(ms) + 1)) AS pos FROM (
      SELECT r, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gaps FROM d)
    WHERE len(ms) > 0)
  WINDOW w AS (PARTITION BY r ORDER BY pos)) {least}"""


ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS MATERIALIZED ({" UNION ALL ".join(_oracle_spans(r) for r in RULES)}),
g AS (
  SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, nth) FILTER (WHERE nth < {len(BASE)}) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, nth) AS spans
  FROM (SELECT r, nth, kind, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM s) GROUP BY r
)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
       CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""
