"""Stupid-backoff scores, computed relationally over n-gram tables of the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import cut
from postloom.llm.ngrams import context, explode, score, suffix

#: Bytes of an n-gram, the factor for each order given up, and how often the corpus must hold an n-gram of two or
#: more bytes for it to count as seen.  With 2 a document does not vouch for n-grams that only it has.
ORDER, BACKOFF, LEAST = 5, 0.4, 1


def stupid_backoff(grams: DataFrame, order: int = ORDER, backoff: float = BACKOFF, least: int = LEAST) -> DataFrame:
    """(gram, weight): log of the stupid-backoff score of each distinct n-gram's last byte.

    ``grams`` has every n-gram of the corpus with its count (gram, c).  A suffix of
    the n-gram seen at least ``least`` times scores its count over its context's;
    each order given up costs a factor ``backoff``; single bytes always count.
    """
    counts = None
    for k in range(1, order + 1):
        level = grams.groupBy(suffix(F.col("gram"), k).alias("g")).agg(F.sum("c").alias("c")).withColumn("k", F.lit(k))
        counts = level if counts is None else counts.unionByName(level)
    counts = cut(counts)
    out = grams.select("gram")
    score = None
    for k in range(order, 0, -1):
        level = counts.where(F.col("k") == k).where(F.col("c") >= (least if k > 1 else 1))
        heads = counts.where(F.col("k") == k).groupBy(context(F.col("g")).alias("h")).agg(F.sum("c").alias("total"))
        share = level.withColumn("h", context(F.col("g"))).join(heads, "h").select(F.col("g").alias(f"g{k}"), (F.col("c") / F.col("total") * backoff ** (order - k)).alias(f"s{k}"))
        out = out.withColumn(f"g{k}", suffix(F.col("gram"), k)).join(share, f"g{k}", "left")
        score = F.col(f"s{k}") if score is None else F.coalesce(score, F.col(f"s{k}"))
    return out.select("gram", F.log(score).alias("weight"))


def lm_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, least: int = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stupid-backoff score of every document: doc_id, n_grams, log_score, mean_log_score.

    Count tables of byte n-grams come from all documents; they are hashed by n-gram,
    joined to the exploded (packed) n-grams and summed per document; the most
    frequent n-grams are looked up in a bounded table where the documents are.

    Null and empty texts have no n-grams: log_score 0 and a null mean.  Repeated rows
    count and are scored each.  Other columns are not read.  An empty table gives none.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    grams = cut(explode(rows, order).where("gram >= 0").groupBy("gram").agg(F.sum("n").alias("c")))
    weights = cut(stupid_backoff(grams, order, backoff, least).join(grams.withColumnRenamed("c", "n"), "gram"))
    scored = score(rows, order, weights)
    return scored.select("doc_id", F.col("n").alias("n_grams"), F.col("total").alias("log_score"), F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("mean_log_score"))
