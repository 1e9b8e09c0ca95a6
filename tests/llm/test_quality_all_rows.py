"""The model and the thresholds rest on all trusted rows, however many a language has; percentiles are exact."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.llm import quality


def test_all_trusted_rows(spark):
    docs = spark.range(90_000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert quality.trusted_sample(labels, docs).count() == 90_000


def test_thresholds_of_many_rows(spark):
    x = spark.range(50_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("lang"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0 + 1).alias("perplexity"))
    rows = x.toPandas()
    of = {k: g.to_numpy() for k, g in rows.groupby("lang")["perplexity"]}
    wide = np.quantile(np.concatenate([v / np.median(v) for v in of.values()]), 0.995)
    got = {r["lang"]: (r["t"], r["t_all"]) for r in quality.thresholds(x.repartition(5), 0.995).collect()}
    for lang, v in of.items():
        want = (len(v) * np.quantile(v, 0.995) + 40 * np.median(v) * wide) / (len(v) + 40)
        assert got[lang] == (pytest.approx(want, rel=1e-12), pytest.approx(np.quantile(rows["perplexity"], 0.995), rel=1e-12))
