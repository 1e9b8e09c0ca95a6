"""SimHash near-duplicates by a generalised pigeonhole over correlated bits.

Fingerprints that differ in few bits are found exactly: the 64 bits are grouped
into partitions of correlated bits, each partition gets its own distance threshold
(chosen by dynamic programming over estimated candidate counts), and a partition
with threshold t is probed under every mask that hides t of its bits.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.llm.common import attach_groups, cut, field, map_texts
from postloom.llm.graph import components

BITS = 64
#: Members of a bucket compared with each other in one task.
BLOCK = 2048
#: Buckets above this many members are linked through shared neighbours instead of blocks.
DENSE = 65_536


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """Majority of the bits of all shingles' XXH64; 0 without words."""
    from xxhash import xxh64_intdigest

    parts = (text or b"").lower().split()  # bytes: only A-Z is lowered, only ASCII white space splits
    if not parts:
        return 0
    flat = b" ".join(parts)
    if len(parts) <= words:
        return xxh64_intdigest(flat, seed)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(parts) - words + 1
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        a, b = starts[at : min(at + (1 << 16), n)].tolist(), ends[at + words - 1 : at + words - 1 + (1 << 16)].tolist()
        h = np.fromiter((xxh64_intdigest(flat[i:j], seed) for i, j in zip(a, b, strict=True)), np.uint64, len(a))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): one row per document, fp as a signed 64-bit number."""
    schema = T.StructType([field(docs, doc_id, "doc_id"), T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t, words, seed) for t in batch.column(1).cast(pa.large_binary()).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], schema.names)

    return map_texts(docs.select(doc_id, text), run, schema)


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each pair of bits, how often both are set: 64 x 64 sums over all rows."""

    def run(batches):
        total, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            x = np.unpackbits(batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += x.T @ x
            total += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS, dtype=np.int32)), pa.array(both.ravel()), pa.array(np.full(BITS * BITS, float(total)))], ["cell", "both", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell int, both double, n double").groupBy("cell").agg(F.sum("both").alias("both"), F.sum("n").alias("n")).collect()  # 4,096 rows at any size
    both = np.zeros(BITS * BITS)
    for r in rows:
        both[r["cell"]] = r["both"]
    return int(rows[0]["n"]) if rows else 0, both.reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of equal width; each takes the bits most correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    near = np.abs(cov / np.outer(sd, sd))
    left, groups = list(range(BITS)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        own = [max(left, key=lambda b: (near[b][left].sum(), -b))]
        left.remove(own[0])
        while len(own) < width:
            own.append(max(left, key=lambda b: (near[b][own].sum(), -b)))
            left.remove(own[-1])
        groups.append(sorted(own))
    return groups


def allocate(cost: list[list[float]], total: int) -> list[int]:
    """Thresholds (-1: not probed) of the partitions with the least summed cost whose sum is ``total``.

    ``cost[i][t + 1]`` is what threshold t costs in partition i.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in best.items():
            for t, x in enumerate(row, -1):
                if s + t not in step or c + x < step[s + t][0]:
                    step[s + t] = (c + x, [*chosen, t])
        best = step
    return best[total][1]


def choose_partitions(n: int, both: np.ndarray, radius: int, parts: tuple[int, ...] = (2, 3, 4, 5), probe_cost: float = 6.0) -> tuple[list[list[int]], list[int]]:
    """Groups of bits and their thresholds with the least estimated probes and candidates.

    A partition's bits count as independent given their marginals, widened by the
    share that correlation explains; the estimate only steers cost, never results.
    """
    p = np.diag(both) / max(n, 1)
    found = None
    for m in parts:
        if radius - m + 1 < -m:
            continue
        groups, cost = group_bits(n, both, m), []
        for g in groups:
            dist = np.array([1.0])
            for b in g:
                d = 2 * p[b] * (1 - p[b])
                dist = np.convolve(dist, [1 - d, d])
            row = [0.0]
            for t in range(min(radius, len(g)) + 1):
                row.append(probe_cost * n * comb(len(g), t) + n * n / 2 * comb(len(g), t) * dist[: t + 1].sum() / max(1, t + 1))
            cost.append(row)
        chosen = allocate(cost, radius - m + 1)
        total = sum(c[t + 1] for c, t in zip(cost, chosen, strict=True))
        if found is None or total < found[0]:
            found = (total, groups, chosen)
    return found[1], found[2]


def probe_masks(groups: list[list[int]], thresholds: list[int]) -> np.ndarray:
    """The visible bits of every probe: a partition's bits without each choice of t of them."""
    return np.array([sum(1 << b for b in g if b not in hidden) for g, t in zip(groups, thresholds, strict=True) if t >= 0 for hidden in combinations(g, t)], np.uint64)


def _probe(masks: np.ndarray):
    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fp), 4096):
                part = fp[at : at + 4096]
                key = (part[:, None] & masks[None, :]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(len(masks), dtype=np.int32), len(part))), pa.array(key), pa.array(np.repeat(part, len(masks)).view(np.int64))], ["probe", "key", "fp"])

    return run


def _forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool, step: int = 256) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs within ``radius`` between a and b (or inside a)."""
    nodes = a if same else np.concatenate((a, b))
    label = np.arange(len(nodes))
    out = []

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    shift = 0 if same else len(a)
    for at in range(0, len(a), step):
        near = np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        for x, y in zip((i + at).tolist(), (j + shift).tolist(), strict=True):
            if x != y and (p := root(x)) != (q := root(y)):
                label[max(p, q)] = min(p, q)
                out.append((int(nodes[x]), int(nodes[y])))
    return out


def _verify(radius: int):
    """Rows sorted by (bucket, i, j): within each run compare, and keep a spanning forest's links."""

    def links(run):
        fp, home = run["fp"].view(np.uint64), run["home"]
        i, j = int(run["i"][0]), int(run["j"][0])
        if len(fp) == 2:
            return [(int(fp[0]), int(fp[1]))] if int(fp[0] ^ fp[1]).bit_count() <= radius else []
        return _forest(fp, fp, radius, True) if i == j else _forest(fp[home == i], fp[home == j], radius, False)

    def run(batches):
        held = None
        for batch in batches:
            cols = {k: batch.column(x).to_numpy() for x, k in enumerate(("bucket", "i", "j", "home", "fp"))}
            if held is not None:
                cols = {k: np.concatenate((held[k], v)) for k, v in cols.items()}
            if not len(cols["bucket"]):
                continue
            new = np.flatnonzero(np.any([np.diff(cols[k]) != 0 for k in ("bucket", "i", "j")], axis=0)) + 1
            last = int(new[-1]) if len(new) else 0
            held = {k: v[last:] for k, v in cols.items()}
            yield from _emit(cols, np.concatenate(([0], new)), links)
        if held is not None:
            yield from _emit(held, np.array([0, len(held["bucket"])]), links)

    def _emit(cols, edges, links):
        size, out = np.diff(edges), []
        two = edges[:-1][size == 2]
        fp = cols["fp"].view(np.uint64)
        hit = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
        a, b = [fp[hit]], [fp[hit + 1]]
        for s, n in zip(edges[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            out += links({k: v[s : s + n] for k, v in cols.items()})
        if out:
            x = np.array(out, np.uint64)
            a.append(x[:, 0])
            b.append(x[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], ["a", "b"])

    return run


def _neighbours(radius: int):
    """All numbers within half the radius of each fingerprint, in bounded batches."""
    reach = radius // 2
    flips = np.array([sum(1 << b for b in c) for t in range(reach + 1) for c in combinations(range(BITS), t)], np.uint64)

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fp), 32):
                part = fp[at : at + 32]
                yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ flips[None, :]).ravel().view(np.int64)), pa.array(np.repeat(part, len(flips)).view(np.int64))], ["z", "fp"])

    return run


def fingerprint_links(fps: DataFrame, radius: int = 4, block: int = BLOCK, dense: int = DENSE) -> DataFrame:
    """(a, b): links between distinct fingerprints at most ``radius`` bits apart, enough to connect all that are.

    A bucket of up to ``block`` members is compared in one task and larger ones in
    pairs of blocks; each comparison keeps a spanning forest, so rows grow with the
    members, not with their pairs.  Members of buckets above ``dense`` (only for even
    radii) are linked through the numbers half way between them, which is exact and
    linear: two numbers are within 2r when they share one within r.
    """
    n, both = bit_statistics(fps)
    groups, thresholds = choose_partitions(n, both, radius)
    probes = fps.select("fp").mapInArrow(_probe(probe_masks(groups, thresholds)), "probe int, key long, fp long")
    probes = probes.select(F.xxhash64("probe", "key").alias("bucket"), "fp")  # buckets that fall together only add comparisons
    sizes = cut(probes.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    rows = cut(attach_groups(probes, sizes, "bucket", "n"))
    far = rows.where(F.col("n") > dense).select("fp").distinct() if radius % 2 == 0 else None
    few = rows.where(F.col("n") <= dense) if far is not None else rows
    blocks = F.ceil(F.col("n") / block).cast("int")
    few = few.withColumn("home", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
    few = few.withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    few = few.select("bucket", F.least("home", "o").alias("i"), F.greatest("home", "o").alias("j"), "home", "fp")
    few = few.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "fp")
    found = few.mapInArrow(_verify(radius), "a long, b long")
    if far is not None:
        z = far.mapInArrow(_neighbours(radius), "z long, fp long")
        first = z.groupBy("z").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
        found = found.union(z.join(first, "z").where("a <> fp").select("a", F.col("fp").alias("b")))
    return found.distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4, seed: int = 42, block: int = BLOCK, dense: int = DENSE) -> DataFrame:
    """Near-duplicate groups: doc_id, fp, component_id (the smallest doc_id reachable, itself included).

    Null and empty texts have fingerprint 0 and link like any other.  Rows with a
    null doc_id take part; the smallest id of a group ignores nulls.  Repeated rows
    each give a row.  Other columns are not read.  An empty table gives none.
    """
    marked = cut(fingerprints(docs, doc_id, text, words, seed))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")))
    labels = cut(components(fingerprint_links(distinct, radius, block, dense)))
    labelled = distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", "size", F.coalesce("label", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    groups = attach_groups(labelled, least, "label", "members").select("fp", "size", "component_id")
    return attach_groups(marked, groups, "fp", "size").select("doc_id", "fp", "component_id")


def hex16(fp: str):
    """A signed fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
