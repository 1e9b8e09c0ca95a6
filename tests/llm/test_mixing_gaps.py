"""Mixing closes the gap that a very long document leaves."""

import random

import pytest
from pyspark.sql import functions as F

from postloom.llm import mixing


@pytest.mark.parametrize(("seed", "long", "want"), [(1, 60_000, 80_000), (2, 60_000, 80_000), (3, 60_000, 50_000), (4, 1, 80_000)])
def test_long_document_is_passed_over(spark, seed, long, want):
    sizes = [long] + [random.Random(i).randint(150, 250) for i in range(500)]
    docs = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, size long").repartition(3)
    out = mixing.mix(docs, F.array(F.lit("a")), F.col("size"), lambda names, all_sizes: [float(want)], seed=seed).collect()
    assert sum(r["copies"] for r in out) and max(r["copies"] for r in out) == 1
    left = [r["size"] for r in out if r["copies"] == 0]
    assert abs(sum(r["taken"] for r in out) - want) <= min(left) / 2  # half the smallest document that is left


def test_greedy_by_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, f"s{i % 5}", rng.choice([1, 3, 10, 100, 2000, 30_000])) for i in range(300)] + [(7, "s2", 50), (7, "s2", 50)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(docs, F.array("source"), F.col("size"), mixing.cycling_targets()).withColumn("u", F.xxhash64(F.lit(11), "doc_id", "size")).collect()
    for source in {r["pattern"][0] for r in got}:
        own = [r for r in got if r["pattern"] == [source]]
        total = sum(r["size"] for r in own)
        base, gap = divmod(round(own[0]["target"]), total)
        groups = {}
        for r in own:
            groups.setdefault(r["u"] % (1 << 64), []).append(r)
        taken = set()
        for u in sorted(groups):
            s = sum(r["size"] for r in groups[u])
            if s <= gap:
                taken.add(u)
                gap -= s
        near = min(((abs(s - gap), u) for u, g in groups.items() if u not in taken and (s := sum(r["size"] for r in g)) < 2 * gap), default=None)
        if near:
            taken.add(near[1])
        assert {u for u, g in groups.items() if g[0]["copies"] > base} == taken
