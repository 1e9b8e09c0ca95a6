"""Captured pages and event logs as JSON lines with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAPTURE = """url string, title string, text string, html string, meta map<string,string>, jsonld array<string>, next_data string, json_scripts array<string>,
snapshots array<struct<label: string, text: string>>,
candidates struct<headings: array<string>, workTypeTags: array<string>, labelPairs: array<struct<label: string, value: string>>, headerBlocks: array<string>, keywordLines: array<string>>"""


def read_captures(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Captured pages that hold anything to read."""
    reader = spark.readStream if streaming else spark.read
    return with_content(reader.schema(CAPTURE).json(path))


def with_content(rows: DataFrame) -> DataFrame:
    n = lambda c: F.coalesce(F.length(F.trim(F.col(c))), F.lit(0))
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    any_candidate = F.lit(False)
    for c in ("headings", "workTypeTags", "labelPairs", "headerBlocks", "keywordLines"):
        any_candidate = any_candidate | some(f"candidates.{c}")
    return rows.where((n("text") >= 20) | (n("html") >= 200) | some("meta") | some("jsonld") | some("json_scripts") | any_candidate)


def last_records(logs: DataFrame, at: str, n: int = 100) -> DataFrame:
    """The last ``n`` records of a log: a top-k."""
    return logs.orderBy(F.desc(at)).limit(n)
