"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import sql
from postloom.llm.chat import format_chats
from postloom.llm.common import table
from postloom.llm.decontamination import find_benchmarks
from postloom.llm.exact_dedup import exact_duplicates
from postloom.llm.html_extraction import extract
from postloom.llm.importance import resample
from postloom.llm.lm_scoring import lm_scores
from postloom.llm.manifest import folded, manifest, siblings
from postloom.llm.mixing import cycling_targets, mix, word_count
from postloom.llm.nearest import search
from postloom.llm.packing import pack
from postloom.llm.quality import score_quality
from postloom.llm.simhash import hex16, near_duplicates
from postloom.llm.token_counts import count_tokens


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document; edges as in ``token_counts.count_tokens``."""
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file())


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and judgement of every document; edges as in ``quality.score_quality``."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; edges as in ``simhash.near_duplicates``."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex16("fp").alias("fingerprint"), "component_id")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes every document, one source each; edges as in ``mixing.mix``."""
    docs = table(spark, sf_dir, "documents")
    out = mix(docs, F.array("source"), word_count("text"), cycling_targets())
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; edges as in ``html_extraction.extract``."""
    return extract(table(spark, sf_dir, "pages"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document's tokens in sequences; edges as in ``packing.pack``."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document; edges as in ``exact_dedup.exact_duplicates``."""
    return exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without quotes, placed in its thread; edges as in ``chat.format_chats``."""
    return format_chats(table(spark, sf_dir, "conversations"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every 50th vector among all; edges as in ``nearest.search``."""
    return search(table(spark, sf_dir, "embeddings"), every=50)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document; edges as in ``lm_scoring.lm_scores``."""
    return lm_scores(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5 % of all documents drawn by importance towards the texts of ``benchmark``; edges as in ``importance.resample``."""
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, proofs folded from untampered and tampered rows; edges as in ``manifest.manifest``.

    A row is tampered with where 2 divides the CRC-32 of its doc_id (a null one: never).
    """
    docs = table(spark, sf_dir, "documents")
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    out = manifest(docs, other={"tampered": {"text": changed}}).withColumn("folded_root", folded(F.col("tampered"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all documents share with ``benchmark`` in windows of ten words; edges as in ``decontamination.find_benchmarks``."""
    out = find_benchmarks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_quality_classifier, op3_simhash_near_dedup, op4_mix_sources, op5_html_extraction, op6_best_fit_packing, op7_exact_dedup, op8_chat_formatting, op9_nearest_neighbours, op10_lm_scoring, op11_importance_resampling, op12_merkle_manifest, op13_benchmark_decontamination)}

ORACLE_SQL = {"op7_exact_dedup": sql.OP7, "op11_importance_resampling": sql.OP11, "op12_merkle_manifest": sql.OP12, "op13_benchmark_decontamination": sql.OP13}
