"""The pipeline's stages against brute force on one small table."""

from collections import defaultdict

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = (before.collect(), docs.collect())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    before, after = seen["quality_classifier"]
    assert 0.75 * len(before) < len(after) < len(before)
    before, after = seen["exact_dedup"]
    largest = defaultdict(int)
    for r in before:
        largest[r["text"]] = max(largest[r["text"]], r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(largest.values())
    before, after = seen["near_dedup"]
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    before, after = seen["mix_sources"]
    ids = [r["doc_id"] for r in after]
    assert set(ids) <= {r["doc_id"] for r in before} and max(ids.count(i) for i in set(ids)) <= 2
    before, after = seen["best_fit_packing"]
    assert sum(r["piece"] == 0 for r in after) == len(before)
