"""Descriptors and result logs kept as YAML or JSON text."""

from __future__ import annotations

import json
from collections.abc import Iterator
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlake.operators.batches import map_rows
from pairlake.session import shuffle_width

TEXTS = "map<string, string>"


def _yaml(text: str):
    """`yaml.safe_load` by libyaml; a text that libyaml does not take is left to the slower parser."""
    import yaml

    if not yaml.__with_libyaml__:
        return yaml.safe_load(text)
    try:
        return yaml.load(text, yaml.CSafeLoader)
    except yaml.YAMLError:
        return yaml.safe_load(text)


def parse_descriptors(items: DataFrame, ddl: str) -> DataFrame:
    """YAML list items (column `item`, with or without the leading dash) to typed rows.

    Parsing does far more work per byte than reading, so items are dealt to all tasks: a small
    file is one split.
    """

    def run(r: SimpleNamespace) -> Iterator[tuple]:
        text = r.item.strip("\n")
        if not text.startswith("- "):
            text = "- " + text
        for entry in _yaml(text) or []:
            yield (json.dumps(entry),)

    dealt = items.select("item").repartition(shuffle_width(items.sparkSession))
    parsed = map_rows(dealt, run, "doc string")
    return parsed.select(F.from_json("doc", ddl).alias("d")).select("d.*")


def read_descriptors(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """List-of-dicts YAML files. A list item is a record, so a long file is split."""
    items = spark.read.option("lineSep", "\n- ").text(path).withColumnRenamed("value", "item")
    return parse_descriptors(items.filter(F.trim("item") != ""), ddl)


def _result_entries(docs: DataFrame) -> DataFrame:
    """(model, step, metric, raw) of JSON result logs; `raw` is the stored value's text."""
    steps = docs.select("model", F.explode(F.from_json("doc", TEXTS)).alias("step", "metrics"))
    steps = steps.select("model", F.col("step").try_cast("bigint").alias("step"), F.from_json("metrics", TEXTS).alias("m"))
    return steps.filter("step >= 0").select("model", "step", F.explode("m").alias("metric", "raw"))


def parse_results(docs: DataFrame) -> DataFrame:
    """JSON result logs (model, doc) to (model, step, metric, value).

    Top-level keys that are not steps (the stored best_* summaries) are left out; best
    steps are derived again where needed. Each value is read on its own: lists and texts
    are left to `rejected_results`, and the rest of their log stays.
    """
    value = F.col("raw").try_cast("double")
    entries = _result_entries(docs).withColumn("value", value)
    return entries.filter("raw IS NULL OR value IS NOT NULL").select("model", "step", "metric", "value")


def rejected_results(docs: DataFrame) -> DataFrame:
    """(model, step, metric, raw) of logged values that are not numbers."""
    return _result_entries(docs).filter(F.col("raw").isNotNull() & F.col("raw").try_cast("double").isNull())


def yaml_as_json(docs: DataFrame) -> DataFrame:
    """(model, doc) logs in YAML as the same logs in JSON; an empty log stays empty."""

    def run(r: SimpleNamespace) -> Iterator[tuple]:
        yield r.model, json.dumps(_yaml(r.doc or "") or {}, default=str)

    return map_rows(docs.select("model", "doc"), run, "model string, doc string")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """One log per model folder, `<model>/trainres.json` or `.yaml`; a pattern without files is empty."""

    def logs(pattern: str) -> DataFrame:
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", pattern)
            .option("ignoreMissingFiles", "true")
            .load(path)
        )
        model = F.element_at(F.split("path", "/"), -2)
        return files.select(model.alias("model"), F.col("content").cast("string").alias("doc"))

    return parse_results(logs("*.json").unionByName(yaml_as_json(logs("*.{yaml,yml}"))))
