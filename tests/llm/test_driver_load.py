"""Steps of many rounds run few jobs: each job, stage and broadcast takes some MB of the driver, however few the rows."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.llm import common, graph, shingles


def labels_of(edges):
    label = {n: n for e in edges for n in e}
    for _ in label:
        for x, y in edges:
            label[x] = label[y] = min(label[x], label[y])
    return label


def random_edges(seed, nodes=120, edges=90):
    rng = random.Random(seed)
    out = [(rng.randrange(-nodes, nodes), rng.randrange(-nodes, nodes)) for _ in range(edges)]
    return [(x, y) for x, y in out if x != y] + [(k, k + 1) for k in range(1000, 1040)]  # and a path


def test_forest():
    edges = random_edges(1)
    lo, hi = graph.forest(*np.array(edges, np.int64).T)
    want = labels_of(edges)
    assert dict(zip(hi.tolist(), lo.tolist(), strict=True)) == {n: x for n, x in want.items() if n != x}


@pytest.mark.parametrize(("parts", "held"), [(1, 1 << 19), (1, 7), (9, 7)])
def test_components(spark, monkeypatch, parts, held):
    monkeypatch.setattr(graph, "HELD", held)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        edges = random_edges(2)
        rows = spark.createDataFrame([*edges, (None, 5), (7000, 7000)], "a long, b long")
        assert {r["node"]: r["label"] for r in graph.components(rows).collect()} == labels_of(edges)
        assert graph.components(rows.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("most", [1 << 15, 3])
def test_attach_cut(spark, most):
    rows = spark.range(40).select((F.col("id") % 7 * (F.col("id") % 2)).alias("key"), "id")
    groups = common.cut(rows.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top")))
    got = common.attach_cut(rows, groups, "key", "n", most)
    want = rows.join(groups, "key")
    assert sorted(map(tuple, got.select("key", "id", "n", "top").collect())) == sorted(map(tuple, want.select("key", "id", "n", "top").collect()))


def test_near_dedup_runs_few_jobs(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(12)]
    texts = [" ".join([*b[: 60 - k], *(f"x{i}{k}{j}" for j in range(k))]) for i, b in enumerate(base) for k in range(6)]
    docs = common.cut(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int"))
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    shingles.shingle_duplicates(docs).collect()
    assert jobs() - before <= 110
    assert corpus_pipeline.near_dedup(spark, docs, "").count() < len(texts)
