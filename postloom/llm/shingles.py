"""Near-duplicates by the Jaccard similarity of word shingles: SimHash fingerprints propose links, exact sets verify them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.llm.common import attach_cut, cut, field, map_texts
from postloom.llm.graph import components
from postloom.llm.set_simhash import apart, candidate_links, differing, fingerprint, radius_of, width_for

#: Pairs of one document that are verified, and members of a bucket that are paired, in one task.
BLOCK = 2048
#: Documents of every bucket that all its members are compared with, round by round, before all pairs that are left.
ROUNDS = (2,)


def shingles(text: bytes | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """XXH64 of all distinct shingles in ascending order; words as in ``simhash.fingerprint``, a short text is one shingle."""
    from xxhash import xxh64_intdigest

    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    flat = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    bounds = zip(starts[:n].tolist(), ends[min(words, len(parts)) - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((xxh64_intdigest(flat[i:j], seed) for i, j in bounds), np.uint64, n))


def digest(grams: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(grams.tobytes())


def signatures(docs: DataFrame, doc_id: str, text: str, words: int, width: int, seed: int) -> DataFrame:
    """(doc_id, h, node, n, fp): the text's XXH64, the digest and size of its set of shingles, the set's SimHash of ``width`` 64-bit numbers."""
    schema = T.StructType([field(docs, doc_id, "doc_id"), *T._parse_datatype_string("h long, node long, n int, fp array<long>").fields])

    def run(batches):
        for batch in batches:
            sets = [shingles(t, words, seed) for t in batch.column(2).cast(pa.large_binary()).to_pylist()]
            node = np.fromiter(map(digest, sets), np.uint64, len(sets)).view(np.int64)
            fps = np.array([fingerprint(x, width, seed) for x in sets], np.uint64).ravel().view(np.int64)
            fps = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * width), pa.array(fps))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node), pa.array([len(x) for x in sets], pa.int32()), fps], schema.names)

    return map_texts(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text")), run, schema)


def shingle_sets(docs: DataFrame, asked: DataFrame, text: str, words: int, seed: int, most: int = 1 << 20) -> DataFrame:
    """(node, grams): the sets of the texts whose XXH64 is in ``asked`` (h), as little-endian 64-bit numbers."""

    def run(batches):
        for batch in batches:
            sets = [shingles(t, words, seed) for t in batch.column(0).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(map(digest, sets), np.uint64, len(sets)).view(np.int64)), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "grams"])

    asked = F.broadcast(asked) if asked.limit(most + 1).count() <= most else asked
    texts = docs.select(F.col(text).alias("text")).join(asked, F.xxhash64("text") == F.col("h"), "left_semi")
    return map_texts(texts, run, T._parse_datatype_string("node long, grams binary")).dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(a, b, both, linked): how many shingles each pair (a, b, size) shares, and whether its Jaccard similarity is at least that.

    ``size`` is how many pairs a has, at most; its set meets ``block`` or so others in a task.
    """

    def run(batches):
        head = None
        for batch in batches:
            a, b, grams = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
            found = []
            for i in range(len(a)):
                x = np.frombuffer(grams[i].as_buffer(), np.uint64)
                if b[i] is None:
                    head = x.copy()
                    continue
                at = np.minimum(np.searchsorted(head, x), len(head) - 1)
                both = int((head[at] == x).sum())
                found.append((a[i], b[i], both, both / (len(head) + len(x) - both) >= least))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], t) for k, t in enumerate(kinds)], ["a", "b", "both", "linked"])

    parts = F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / block)).cast("int")
    salted = pairs.select("a", "b", parts.alias("part"))
    heads = salted.select("a", "part").distinct().join(sets, F.col("a") == F.col("node")).select("a", "part", F.lit(None).cast("long").alias("b"), "grams")
    others = salted.join(sets, F.col("b") == F.col("node")).select("a", "part", "b", "grams")
    rows = heads.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return map_texts(rows, run, T._parse_datatype_string("a long, b long, both int, linked boolean"))


def own_shingles(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, u): how many shingles of each of the ``nodes`` are in no other of them."""

    def run(batches):
        for batch in batches:
            grams = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            each = pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False) // 8
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), each)), pa.array(grams)], ["node", "gram"])

    each = map_texts(sets.join(nodes, "node", "left_semi").select("node", "grams"), run, T._parse_datatype_string("node long, gram long"))
    once = each.groupBy("gram").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
    return once.groupBy("node").agg(F.count("*").cast("int").alias("u"))


def _possible(n, m, u, v, least: float, lesser, i=None, j=None):
    """Whether sets of n and m shingles, u and v of them in no other set, can be as similar: at most the lesser rest is shared.

    Where i and j of them are in a third set, at most the lesser of these and the lesser of what is outside it is.
    """
    shared = lesser(n - u, m - v)
    if i is not None:
        shared = np.fmin(shared, lesser(i, j) + lesser(np.maximum(n - i - u, 0), np.maximum(m - j - v, 0)))  # unknown where i or j is
    return shared >= least * (n + m - shared)


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame | None:
    """Members (key, node, n, u, f, g, label) of the buckets that still hold more than one component, with the bucket's size; None if no bucket does."""
    labels = labels.withColumnRenamed("node", "of")
    labelled = cut(members.join(labels, F.col("node") == F.col("of"), "left").select("key", "node", "n", "u", "f", "g", F.coalesce("label", "node").alias("label")))
    groups = cut(labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("key", "size"))
    return None if groups.isEmpty() else attach_cut(labelled, groups, "key", "size").select("key", "node", "n", "u", "f", "g", "label", "size")


def shingle_components(members: DataFrame, sets: DataFrame, least: float, block: int = BLOCK, rounds=ROUNDS) -> DataFrame:
    """(node, label): components of the verified links between members (key, node, n, f, g, size) of equal keys, of buckets of that size, with that similarity.

    f and g are two words of a member's SimHash; pairs that differ there in more bits
    than pairs of the similarity do are never compared.

    A large group of near copies has far more pairs than members.  So all members
    meet a few of their bucket first, the one with the least share of shingles of its
    own before random ones; pairs that links connect already need no comparison, and at
    last every other pair of a bucket is verified.  Pairs whose own shingles (in no
    other member of buckets that large), or what they share with their bucket's first
    head, leave too few to share are never compared.
    """
    most = max(rounds, default=0) + 1
    own = own_shingles(sets, members.where(F.col("size") > most).select("node")).withColumnRenamed("node", "of")
    u = F.when(F.col("size") > most, F.coalesce("u", F.lit(0))).otherwise(0)
    members = cut(members.join(own, F.col("node") == F.col("of"), "left").select("key", "node", "n", u.alias("u"), "f", "g", "size"))
    radius = radius_of(differing(least))
    links, labels, pivots, close = None, None, None, _possible(F.col("n"), F.col("m"), F.col("u"), F.col("v"), least, F.least)
    left = members.withColumn("label", F.col("node"))
    for r, heads in enumerate(rounds):
        order = lambda k: F.col("u") / F.greatest("n", F.lit(1)) if r + k == 0 else F.lit(0.0)
        picks = [F.min(F.struct(order(k).alias("own"), F.xxhash64(F.lit(r * 100 + k), "node").alias("o"), F.col("node").alias("a"), F.col("n").alias("m"), F.col("u").alias("v"), "f", "g", F.col("label").alias("other"))) for k in range(heads)]
        chosen = cut(left.groupBy("key").agg(F.array_distinct(F.array(*picks)).alias("heads"), F.count("*").alias("count")))
        met = attach_cut(left.select("key", "node", "n", "u", "f", "g", "label"), chosen, "key", "count").withColumn("x", F.explode("heads"))
        near = F.bit_count(F.col("f").bitwiseXOR(F.col("x.f"))) + F.bit_count(F.col("g").bitwiseXOR(F.col("x.g"))) <= radius
        met = met.where(near).select("x.a", F.col("node").alias("b"), "n", "u", "x.m", "x.v", "label", "x.other", F.col("count").alias("size")).where("label <> other").where(close).select("a", "b", "size")  # a node has one key, so pairs are distinct
        checked = cut(verified(cut(met), sets, least, block))
        if pivots is None:
            pivots, shared = chosen.select("key", F.col("heads")[0]["a"].alias("pivot"), "count"), checked.select(F.col("a").alias("pivot"), F.col("b").alias("of"), "both")
        new = checked.where("linked").select("a", "b")
        links = new if links is None else cut(links.union(new))
        labels = cut(components(links))
        left = _apart(members.drop("size"), labels)
        if left is None:
            return labels

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            cols = [held.column(c).to_numpy() for c in ("key", "i", "j")]
            edges = np.flatnonzero(np.any([np.diff(c) != 0 for c in cols], axis=0)) + 1
            last = int(edges[-1]) if len(edges) else 0
            yield from emit(held.slice(0, last), edges)
            held = held.slice(last)
        if held is not None:
            yield from emit(held, np.array([held.num_rows]))

    def emit(rows, edges):
        node, n, u, label, home, i, j = (rows.column(c).to_numpy() for c in ("node", "n", "u", "label", "home", "i", "j"))
        inside = rows.column("inside").to_numpy(zero_copy_only=False).astype(float)
        f, g = (rows.column(c).to_numpy().view(np.uint64) for c in ("f", "g"))
        for s, e in zip(np.concatenate(([0], edges[:-1])).tolist(), edges.tolist(), strict=True) if len(edges) else ():
            first, second = s + np.flatnonzero(home[s:e] == i[s]), s + np.flatnonzero(home[s:e] == j[s])
            for x in first.tolist():
                y = second[(label[second] != label[x]) & _possible(n[second], n[x], u[second], u[x], least, np.minimum, inside[second], inside[x])]
                y = y[node[y] > node[x]] if i[s] == j[s] else y
                y = y[apart(f[y], g[y], f[x], g[x]) <= radius]
                if len(y):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[y], node[x])), pa.array(np.maximum(node[y], node[x]))], ["a", "b"])

    if pivots is None:
        left = left.withColumn("inside", F.lit(None).cast("int"))
    else:  # what each member shares with its bucket's first head
        placed = attach_cut(left, pivots, "key", "count").drop("count").withColumnRenamed("pivot", "p")
        left = placed.join(shared, (F.col("p") == F.col("pivot")) & (F.col("node") == F.col("of")), "left").withColumn("inside", F.when(F.col("p") == F.col("node"), F.col("n")).otherwise(F.col("both")))
    blocks = F.ceil(F.col("size") / block).cast("int")
    rows = left.withColumn("home", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", F.least("home", "o").alias("i"), F.greatest("home", "o").alias("j"), "home", "node", "n", "u", "f", "g", "inside", "label")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    pairs = cut(rows.mapInArrow(run, "a long, b long").distinct())
    if labels is not None and pairs.isEmpty():
        return labels
    sizes = cut(pairs.groupBy("a").agg(F.count("*").alias("size")))
    more = cut(verified(cut(attach_cut(pairs, sizes, "a", "size")), sets, least, block).where("linked").select("a", "b"))
    if labels is not None and more.isEmpty():
        return labels
    return cut(components(more if labels is None else labels.select(F.col("label").alias("a"), F.col("node").alias("b")).union(more)))


def shingle_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, least: float = 0.8, miss: float = 4e-4, seed: int = 42, block: int = BLOCK, rounds=ROUNDS) -> DataFrame:
    """Near-duplicate groups: doc_id, component_id (the smallest doc_id reachable, itself included).

    Two texts are linked if the Jaccard similarity of their sets of shingles is at
    least ``least``, verified on the sets.  Only texts of one component of the links that
    their SimHash proposes are verified; a pair of that similarity shares no bucket with
    a probability of about ``miss``.  Null and empty texts are alike.  Repeated rows each
    give a row.  Other columns are not read.
    """
    p = differing(least)
    width, parts = width_for(docs.count(), p, miss)
    marked = cut(signatures(docs, doc_id, text, words, width, seed))
    nodes = cut(marked.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("size"), F.min("h").alias("h"), F.first("n").alias("n"), F.first("fp").alias("fp")))
    proposed = cut(components(cut(candidate_links(nodes, width, parts, p, miss, block))).select(F.col("node").alias("of"), F.col("label").alias("key")))
    sizes = cut(proposed.groupBy("key").agg(F.count("*").alias("size")))
    placed = attach_cut(proposed, sizes, "key", "size")
    members = cut(nodes.drop("size").join(placed, F.col("node") == F.col("of")).select("key", "node", "n", "h", F.col("fp")[0].alias("f"), F.col("fp")[1].alias("g"), "size"))
    sets = cut(shingle_sets(docs, members.select("h"), text, words, seed))
    labels = shingle_components(members.drop("h"), sets, least, block, rounds).withColumnRenamed("node", "of")
    labelled = cut(nodes.join(labels, F.col("node") == F.col("of"), "left").select("node", "least", "size", F.coalesce("label", "node").alias("label")))
    smallest = cut(labelled.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    groups = cut(attach_cut(labelled, smallest, "label", "members").select("node", "size", "component_id"))
    return attach_cut(marked.select("doc_id", "node"), groups, "node", "size").select("doc_id", "component_id")
