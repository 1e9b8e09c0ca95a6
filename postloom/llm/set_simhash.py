"""SimHash of sets of shingles over several words of 64 bits: candidates for a similarity of sets.

Sets of a Jaccard similarity s are at a cosine of about 2s / (1 + s), so their
fingerprints differ in a known share of the bits.  As in ``simhash`` the bits of a word
are grouped into partitions of correlated bits, a dynamic program over estimated
costs gives each partition a threshold, and a partition is probed under every mask
that hides so many of its bits.  There the thresholds must find every pair within a
radius; 64 bits would need a radius of 20 for a similarity of 0.8, in which random
fingerprints lie, too.  Here they must find a pair of the similarity but for a stated
probability, and what shares a bucket is verified on two whole words.
"""

from __future__ import annotations

from functools import lru_cache
from math import acos, ceil, comb, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import bounded, cut
from postloom.llm.simhash import BITS, BLOCK, group_bits, probe_masks

#: Words of a fingerprint that the members of a bucket are compared on.
CHECKED = 2
#: What a probe costs, as a multiple of a comparison of two members of a bucket.
PROBE_COST = 600.0


def differing(least: float) -> float:
    """The share of bits in which fingerprints of large sets with that Jaccard similarity differ."""
    return acos(2 * least / (1 + least)) / pi


def radius_of(p: float, bits: int = CHECKED * BITS, deviations: float = 4.2) -> int:
    """How many of the checked bits differ at most where each differs with probability ``p``."""
    return int(bits * p + deviations * sqrt(bits * p * (1 - p)))


def within(width: int, t: int, p: float) -> float:
    """The probability that at most ``t`` of ``width`` bits differ."""
    return sum(comb(width, i) * p**i * (1 - p) ** (width - i) for i in range(t + 1))


def width_for(n: int, p: float, miss: float) -> tuple[int, int]:
    """Words of a fingerprint and partitions of each, cheapest for ``n`` sets where all thresholds are 0."""
    found = None
    for parts in range(2, 17):
        width = BITS // parts
        tables = ceil(log(miss) / log(1 - within(width, 0, p)))
        cost = tables * (PROBE_COST * n + n * n / 2 / 2**width)
        if found is None or cost < found[0]:
            found = (cost, max(CHECKED, ceil(tables / parts)), parts)
    return found[1], found[2]


@lru_cache(maxsize=8)
def _turns(words: int, seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [rng.integers(0, 1 << 64, (words, 1), np.uint64) | np.uint64(k) for k in (0, 1, 1)]


def fingerprint(grams: np.ndarray, words: int, seed: int = 42) -> np.ndarray:
    """Majority of the bits of ``words`` hashes of each member of a set of 64-bit numbers; 0 for none."""
    turn, times, again = _turns(words, seed)
    shift, ones = np.arange(8, dtype=np.uint64)[None, :, None], np.uint64(0x0101010101010101)
    counts = np.zeros((words, 8, 8), np.int64)
    for at in range(0, len(grams), 255):  # a byte counts to 255
        x = (grams[None, at : at + 255] ^ turn) * times
        x = (x ^ (x >> np.uint64(32))) * again
        x ^= x >> np.uint64(32)
        counts += ((x[:, None, :] >> shift) & ones).sum(axis=2, dtype=np.uint64).view(np.uint8).reshape(words, 8, 8)
    return np.packbits((2 * counts > len(grams)).transpose(0, 2, 1), axis=2, bitorder="little").reshape(words, 8).view("<u8")[:, 0]


def _words(column: pa.Array) -> np.ndarray:
    """The fingerprints of a batch, a row each."""
    return column.flatten().to_numpy().view(np.uint64).reshape(len(column), -1)


def bit_statistics(nodes: DataFrame, words: int) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each word and pair of its bits, how often both are set."""

    def run(batches):
        total, both = 0, np.zeros((words, BITS, BITS))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.unpackbits(_words(batch.column(0)).view(np.uint8).reshape(-1, words, 8), axis=2, bitorder="little").astype(np.float32)
            both += np.matmul(x.transpose(1, 2, 0), x.transpose(1, 0, 2))
            total += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(both.size, dtype=np.int32)), pa.array(both.ravel()), pa.array(np.full(both.size, float(total)))], ["cell", "both", "n"])

    rows = nodes.select("fp").mapInArrow(run, "cell int, both double, n double").groupBy("cell").agg(F.sum("both").alias("both"), F.sum("n").alias("n")).toArrow()  # 4,096 rows a word at any size
    both = np.zeros(words * BITS * BITS)
    both[rows.column("cell").to_numpy()] = rows.column("both").to_numpy()
    return int(rows.column("n")[0].as_py()) if len(rows) else 0, both.reshape(words, BITS, BITS)


def choose_probes(n: int, both: np.ndarray, parts: int, p: float, miss: float, most: int = 2, steps: int = 4000) -> list[tuple[int, list[int]]]:
    """(word, masks) of the partitions that are probed: the least estimated cost that misses a pair with probability ``miss``.

    A partition of width w and threshold t is as good as -log of the probability that
    more than t of its w bits differ; partitions count as independent.  A partition's
    bits count as independent given their marginals.
    """
    need = -log(miss)
    rows, groups = [], []
    for w, of in enumerate(both):
        set_ = np.diag(of) / max(n, 1)
        for g in group_bits(n, of, parts):
            dist = np.array([1.0])
            for b in g:
                d = 2 * set_[b] * (1 - set_[b])
                dist = np.convolve(dist, [1 - d, d])
            row = [(0.0, 0)]
            for t in range(min(most, len(g) - 1) + 1):
                gain = -log(1 - within(len(g), t, p)) * steps / need
                row.append((PROBE_COST * n * comb(len(g), t) + n * n / 2 * comb(len(g), t) * dist[: t + 1].sum() / (t + 1), int(gain)))
            rows.append(row)
            groups.append((w, g))
    best = np.full(steps + 1, np.inf)
    best[0], chosen = 0.0, []
    for row in rows:
        tries = np.full((len(row), steps + 1), np.inf)
        source = np.zeros((len(row), steps + 1), np.int64)
        for k, (cost, gain) in enumerate(row):
            full = max(steps - gain, 0)  # from here on the aim is reached
            tries[k, steps - full : steps], source[k, steps - full : steps] = best[:full] + cost, np.arange(full)
            source[k, steps] = full + best[full:].argmin()
            tries[k, steps] = best[source[k, steps]] + cost
        take = tries.argmin(axis=0)
        chosen.append((take, source[take, np.arange(steps + 1)]))
        best = tries.min(axis=0)
    if not np.isfinite(best[steps]):
        raise ValueError("fingerprints are too short for the probability asked for")
    at, out = steps, []
    for (w, g), (take, source) in zip(reversed(groups), reversed(chosen), strict=True):
        k = int(take[at])
        at = int(source[at])
        if k:
            out.append((w, probe_masks([g], [k - 1]).tolist()))
    return out[::-1]


def _probe(probes: list[tuple[int, list[int]]]):
    """A row for each fingerprint and probe: the bucket, a number that mixes the probe and the bits it sees."""
    word = np.array([w for w, masks in probes for _ in masks])
    mask = np.array([m for _, masks in probes for m in masks], np.uint64)
    turn = np.random.default_rng(7).integers(0, 1 << 64, len(mask), np.uint64)

    def run(batches):
        for batch in batches:
            node, fp = batch.column(0).to_numpy(), _words(batch.column(1)) if batch.num_rows else np.zeros((0, 1), np.uint64)
            for at in range(0, len(fp), 1024):
                part = fp[at : at + 1024]
                x = ((part[:, word] & mask) ^ turn) * np.uint64(0x9E3779B97F4A7C15)
                x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                x ^= x >> np.uint64(32)
                again = [np.repeat(c, len(mask)) for c in (node[at : at + 1024], part[:, 0].view(np.int64), part[:, 1].view(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (x.ravel().view(np.int64), *again)], ["bucket", "node", "f", "g"])

    return run


def apart(f, g, x, y):
    """Of how many checked bits two fingerprints differ, arrays against arrays."""
    return np.bitwise_count(f ^ x) + np.bitwise_count(g ^ y)


def stars(node, f, g, side, radius: int, step: int = 256) -> list[tuple[int, int]]:
    """Components of the pairs within ``radius`` among those of side 0, or between sides 0 and 1 if there is a side 1: a link of each node to the smallest."""
    cross = bool(side.any())
    a, b = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if cross else (np.arange(len(node)),) * 2
    label, found = list(range(len(node))), set()

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    def join(x, y):
        found.update((x, y))
        if (p := root(x)) != (q := root(y)):
            label[p if node[p] > node[q] else q] = q if node[p] > node[q] else p

    for at in range(0, len(a), step):
        own = a[at : at + step]
        other = b if cross else b[: at + len(own)]  # what comes before or in this step
        if not len(other):
            break
        near = apart(f[own, None], g[own, None], f[None, other], g[None, other]) <= radius
        if not cross:
            near &= other[None, :] < own[:, None]
        hit = np.flatnonzero(near.any(axis=1))
        if not len(hit):
            continue
        own, near = own[hit], near[hit]
        for x, y in zip(own.tolist(), other[near.argmax(axis=1)].tolist(), strict=True):
            join(x, y)
        roots = np.array([root(k) for k in range(len(node))])
        for x, y in np.argwhere(near & (roots[own, None] != roots[None, other])).tolist():
            join(int(own[x]), int(other[y]))
    return [(int(node[root(k)]), int(node[k])) for k in sorted(found) if root(k) != k]


def _verify(radius: int):
    """Rows sorted by run: within each run compare, and link the nodes of a component to its smallest."""
    names = ("run", "side", "node", "f", "g")

    def run(batches):
        held = None
        for batch in batches:
            cols = {k: batch.column(i).to_numpy() for i, k in enumerate(names)}
            if held is not None:
                cols = {k: np.concatenate((held[k], v)) for k, v in cols.items()}
            if not len(cols["run"]):
                continue
            new = np.flatnonzero(np.diff(cols["run"])) + 1
            yield emit(cols, np.concatenate(([0], new)))
            held = {k: v[int(new[-1]) if len(new) else 0 :] for k, v in cols.items()}
        if held is not None:
            yield emit(held, np.array([0, len(held["run"])]))

    def emit(cols, edges):
        f, g, out = cols["f"].view(np.uint64), cols["g"].view(np.uint64), []
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if e - s > 1:
                out += stars(cols["node"][s:e], f[s:e], g[s:e], cols["side"][s:e], radius)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def candidate_links(nodes: DataFrame, words: int, parts: int, p: float, miss: float, block: int = BLOCK) -> DataFrame:
    """(a, b): links between nodes (node, fp: ``words`` 64-bit numbers) that share a bucket and lie within the radius, enough to connect all that do.

    A bucket of up to ``block`` members is compared in one task and larger ones in
    pairs of blocks; each comparison gives at most a row a member.  Only the buckets that are
    split, at most a row for ``block`` probes, are joined to the probes.
    """
    n, both = bit_statistics(nodes, words)
    probed = nodes.select("node", "fp").mapInArrow(_probe(choose_probes(n, both, parts, p, miss)), "bucket long, node long, f long, g long")
    large = cut(probed.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > block))
    blocks = F.coalesce(F.ceil(F.col("size") / block), F.lit(1)).cast("int")
    rows = probed.join(bounded(large, 1 << 20), "bucket", "left").withColumn("blocks", blocks)
    rows = rows.withColumn("home", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    run = F.when(F.col("blocks") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("home", "o"), F.greatest("home", "o")))
    rows = rows.select(run.alias("run"), (F.col("home") > F.col("o")).cast("byte").alias("side"), "node", "f", "g")
    return rows.repartition("run").sortWithinPartitions("run").mapInArrow(_verify(radius_of(p)), "a long, b long").distinct()
