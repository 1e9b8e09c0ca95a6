"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import attach_cut, cut

#: Edges that a task contracts at a time.
HELD = 1 << 19


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the components of the edges (x, y): the smallest node of each, and every other node."""
    ids, at = np.unique(np.concatenate((x, y)), return_inverse=True)
    label, (x, y) = np.arange(len(ids)), at.reshape(2, -1)
    while (apart := label[x] != label[y]).any():
        a, b = label[x[apart]], label[y[apart]]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != (up := label[label])).any():
            label = up
    below = np.flatnonzero(label != np.arange(len(ids)))
    return ids[label[below]], ids[below]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (lo, hi) with the same components: each task makes stars of up to ``HELD`` of its edges at a time."""

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
            if rows >= HELD:
                yield made(held)
                held, rows = [], 0
        if rows:
            yield made(held)

    def made(held):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in forest(*(np.concatenate(c) for c in zip(*held, strict=True)))], ["lo", "hi"])

    return edges.mapInArrow(run, "lo long, hi long")


def _are_stars(stars: DataFrame) -> bool:
    """Whether every node is a centre, or lies below exactly one; then the centres are the labels."""
    ends = stars.select(F.col("hi").alias("x"), F.lit(1).alias("below")).union(stars.select("lo", F.lit(0)))
    return ends.groupBy("x").agg(F.sum("below").alias("n"), F.min("below").alias("only")).where("n > 1 or (n = 1 and only = 0)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Label every node of the edges, 64-bit numbers, with the smallest node that it reaches: (node, label).

    Tasks contract the edges they hold, which is all of it where few partitions hold
    them.  Each round is then two joins on a node's smallest neighbour, until all edges form stars;
    rounds grow with the logarithm of the longest path.  Every round is written to the shared folder, so
    a lost executor costs one round at most.  Nodes with very many edges are joined where
    the edges lie.  Null ends and loops are ignored; an empty table gives none.
    """
    pair = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct()
    stars = cut(_contracted(pair))
    while not _are_stars(stars):
        if not rounds:
            raise RuntimeError("no fixed point after all rounds")
        rounds -= 1
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(stars.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")))
        large = attach_cut(both, least, "u", "n").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        large = cut(large)
        least = cut(large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n")))
        small = attach_cut(large, least, "hi", "n").select(F.col("m").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi")).where("lo < hi").distinct()
        stars = cut(small)
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("label")).union(stars.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())
