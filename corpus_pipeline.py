"""A corpus pipeline of five stages: quality, exact dedup, near dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import bounded, cut, table, without
from postloom.llm.exact_dedup import exact_duplicates
from postloom.llm.mixing import cycling_targets, mix, word_count
from postloom.llm.packing import pack
from postloom.llm.quality import score_quality
from postloom.llm.queries import tokenizer_file
from postloom.llm.shingles import shingle_duplicates


def keyed(docs: DataFrame) -> DataFrame:
    """Texts with the identity of their rows: doc_id and a hash of the text."""
    return docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"), "text", "lang")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, with all their columns, of any names.

    Null and empty texts go.  A null language is a language.  Repeated rows are judged
    alike, null doc_ids like any other.  Without trusted labels all other documents
    stay; an empty table gives an empty table.  Texts are read whole.
    """
    scored = score_quality(keyed(docs).withColumn("doc_id", F.col("key.doc_id")), table(spark, sf_dir, "labels"), keep="key")
    return without(docs, cut(scored.where("not accepted").select("key.doc_id", "key.h")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the largest doc_id, with all its columns, of any names.

    Null and empty texts are equal.  Null doc_ids are below all others; null and empty
    text under one doc_id are told apart only by which row stays.  Of rows that share
    doc_id and text one stays, any of them where other columns differ.  An empty
    table gives an empty table.
    """
    marked = cut(exact_duplicates(keyed(docs), "key").select("doc_id", "keep_id", "kept"))
    once = without(docs, marked.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id.doc_id", "doc_id.h"))
    again = cut(marked.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("kept")).select("doc_id.doc_id", "doc_id.h").distinct())
    if again.isEmpty():
        return once
    rows = once.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("row.text") == F.col("h"))
    repeated = rows.join(bounded(again, 1 << 20), same).groupBy("doc_id", "h").agg(F.first("row").alias("row"))  # combined where the rows are
    return without(once, again).unionByName(repeated.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of five-word shingles of 0.8 or more: the smallest doc_id.

    All columns, of any names, stay.  Texts of fewer than five words are one shingle;
    null and empty texts have none and are alike.  A null doc_id is below all others.
    Rows that share doc_id and text stay or go together.  An empty table gives an
    empty table.
    """
    marked = shingle_duplicates(keyed(docs), "key")
    return without(docs, cut(marked.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id.doc_id", "doc_id.h")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (never, once or twice), with all their columns, of any names.

    A null source is a source.  Documents without words are not taken; of repeated
    rows as many as are wanted.  An empty table gives an empty table.
    """
    prefix = "mix_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    taken = mix(docs, F.array("source"), word_count("text"), cycling_targets(), keep=docs.columns, prefix=prefix)
    times = F.explode(F.sequence(F.lit(1), F.col(f"{prefix}copies")))
    return taken.where(F.col(f"{prefix}copies") > 0).withColumn(f"{prefix}copy", times).select(*(F.col(f"`{c}`") for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents in training sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone; repeated rows are packed each.  Other
    columns are not read.  An empty table gives an empty table.
    """
    return pack(docs, tokenizer_file())


STAGES = [("quality_classifier", quality_classifier), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("best_fit_packing", best_fit_packing)]

#: Language models, chunk recipes and packing plans are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents; each result is written to the shared folder and read again.

    Rows with nulls, repeated rows, long texts and other columns are treated as the
    stages state; an empty table gives an empty table.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
