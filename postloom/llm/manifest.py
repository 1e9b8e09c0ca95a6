"""A Merkle manifest of a dataset: a tree over the rows of each group, one over the groups, and a proof for every row."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.llm.common import cut, field, map_texts

#: Children of a node.
FAN = 3
#: Levels that one task finishes: a subtree of 3^9 = 19,683 nodes at most.
LEVELS = 9
#: Rows of a range-sorted partition, about, and of a stretch of it that is built at once.
PART_ROWS, CHUNK_ROWS = 1 << 18, 1 << 14

PATH = "array<struct<before: string, after: string>>"


def joined(*columns: Column) -> Column:
    """The SHA-256, in hex, of values one after the other: ``-`` for null, else UTF-8 byte count, ``:`` and value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def node(digests: Sequence[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def depth(size: int) -> int:
    """Levels above the leaves of a tree of ``size`` leaves."""
    d = 0
    while size > 1:
        size, d = -(-size // FAN), d + 1
    return d


def width(size: int, level: int) -> int:
    """Nodes on a level of a tree of ``size`` leaves."""
    return -(-size // FAN**level)


def grow(digests: list[str], first: int, level: int, size: int, top: int) -> list[tuple[int, list[str]]]:
    """The complete aligned subtrees over consecutive nodes: for each level from ``level`` up (first index, digests).

    ``digests`` are nodes ``first`` and on of a level of a tree of ``size`` leaves; a node
    is complete if all its children are there.  Nothing above ``top`` is built.
    """
    out = [(first, digests)]
    while level < top:
        end = first + len(digests)
        lo, hi = -(-first // FAN), -(-end // FAN) if end == width(size, level) else end // FAN
        if hi <= lo:
            break
        digests = [node(digests[FAN * p - first : FAN * p - first + FAN]) for p in range(lo, hi)]
        first, level = lo, level + 1
        out.append((first, digests))
    return out


def ragged(levels: list[tuple[int, list[str]]]) -> Iterator[tuple[int, int, str]]:
    """(level, index, digest) of the nodes without a complete parent."""
    for k, (first, digests) in enumerate(levels):
        above, have = (levels[k + 1][0], len(levels[k + 1][1])) if k + 1 < len(levels) else (0, 0)
        for i, d in enumerate(digests, first):
            if not above <= i // FAN < above + have:
                yield k, i, d


def beside(levels: list[tuple[int, list[str]]]) -> list[list[tuple[str, str]]]:
    """For each level below the last, for each node with a complete parent: the siblings before and after it."""
    out = []
    for first, digests in levels[:-1]:
        own = []
        for j in range(len(digests)):
            at = max(j - (first + j) % FAN, 0)  # where its run of siblings starts
            own.append(("".join(digests[at:j]), "".join(digests[j + 1 : at + FAN])))
        out.append(own)
    return out


def paths(before: list[str], after: list[str], ends: list[int]) -> pa.ListArray:
    both = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"])
    return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), both)


def _pairs(value) -> list[tuple[str, str]]:
    return [(x["before"], x["after"]) for x in value]


def finish(nodes: DataFrame, level: int, tallest: int) -> DataFrame:
    """(part, g, size, offset, n, level, i, path, subroot) of ragged nodes, their paths up to the roots of their trees.

    Nodes meet by coordinate: those under one node of level ``level``, at most
    3^LEVELS, in one task, which builds the levels up to there; then these nodes meet in
    turn under nodes ``LEVELS`` higher.
    """
    own = [f for f in nodes.schema.fields]
    schema = T.StructType([*own, *T._parse_datatype_string(f"path {PATH}, up int, j long, top string").fields])
    names = [f.name for f in own]

    def build(rows):
        size = rows[0]["size"]
        top = min(level, depth(size))
        known, at = {(r["level"], r["i"]): r["digest"] for r in rows}, min(r["level"] for r in rows)
        for lev in range(at, top):
            for p in sorted({i // FAN for k, i in known if k == lev}):
                known[lev + 1, p] = node([known[lev, i] for i in range(FAN * p, min(FAN * p + FAN, width(size, lev)))])
        for r in rows:
            path, i = [], r["i"]
            for lev in range(r["level"], top):
                run = range(i - i % FAN, min(i - i % FAN + FAN, width(size, lev)))
                path.append({"before": "".join(known[lev, k] for k in run if k < i), "after": "".join(known[lev, k] for k in run if k > i)})
                i //= FAN
            yield r | {"path": path, "up": top, "j": i, "top": known[top, i]}

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if held and (held[0]["g"], held[0]["span"]) != (r["g"], r["span"]):
                    done += build(held)
                    held = []
                held.append(r)
            yield pa.RecordBatch.from_pylist([{k: x[k] for k in schema.names} for x in done], schema=as_arrow)
        if held:
            yield pa.RecordBatch.from_pylist([{k: x[k] for k in schema.names} for x in build(held)], schema=as_arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    as_arrow = to_arrow_schema(schema)
    span = F.floor(F.col("i") / F.pow(F.lit(float(FAN)), F.lit(level) - F.col("level"))).cast("long")
    met = nodes.select(*names, F.when(F.col("level") <= level, span).otherwise(F.col("i")).alias("span"))
    here = cut(map_texts(met.repartition("g", "span").sortWithinPartitions("g", "span"), run, schema))
    if level >= tallest:
        return here.select(*names, "path", F.col("top").alias("subroot"))
    tops = here.groupBy("g", "up", "j").agg(F.first("top").alias("digest"), F.first("size").alias("size"))
    tops = tops.select("g", "size", F.col("up").alias("level"), F.col("j").alias("i"), "digest")
    above = finish(tops, level + LEVELS, tallest).select("g", F.col("level").alias("up"), F.col("i").alias("j"), F.col("path").alias("rest"), "subroot")
    return here.join(above, ["g", "up", "j"]).select(*names, F.concat("path", "rest").alias("path"), "subroot")


def trees(leaves: DataFrame, order: Sequence[str], keep: Sequence[str], above=None, part_rows: int = PART_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(keep..., g, leaf, path, subroot, root) of rows (g, leaf, and the columns of order and keep): a tree for each g.

    Rows are range-sorted by (g, order).  Offsets of each stretch of a range partition
    come from counts by group and stretch, so every leaf knows its place in its tree;
    stretches build the complete aligned subtrees that they hold, and the ragged rest
    is finished by coordinate.  ``above`` makes (g, up_path, root) of (g, subroot); without it
    subroots are roots.
    """
    spark = leaves.sparkSession
    leaves = cut(leaves.select("g", "leaf", *dict.fromkeys((*order, *keep)), F.monotonically_increasing_id().alias("nth")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // part_rows))
    ranged = leaves.repartitionByRange(parts, "g", *order, "leaf", "nth").sortWithinPartitions("g", *order, "leaf", "nth")
    at = F.monotonically_increasing_id()  # counts from 0 in each partition, which stands above 33 bits
    chunk = F.shiftright(at, 33) * (1 << 24) + F.floor(at.bitwiseAND(F.lit((1 << 33) - 1)) / chunk_rows)
    ranged = cut(ranged.select(*dict.fromkeys(("g", "leaf", *keep)), at.alias("at"), chunk.alias("chunk")))
    runs = ranged.groupBy("g", "chunk").agg(F.count("*").alias("n"))
    each = Window.partitionBy("g")
    offset = F.coalesce(F.sum("n").over(each.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = cut(runs.select("chunk", "g", "n", offset.alias("offset"), F.sum("n").over(each).alias("size")))
    tallest = depth(runs.agg(F.max("size")).first()[0] or 0)

    def runs_of(table: pa.Table, runs: list[dict]):
        """(run, rows from, levels) of the runs of groups in a stretch, in order."""
        leaf, start = table.column("leaf").to_pylist(), 0
        for r in runs:
            yield r, start, grow(leaf[start : start + r["n"]], r["offset"], 0, r["size"], min(LEVELS, depth(r["size"])))
            start += r["n"]

    local = T._parse_datatype_string("chunk long, g string, size long, offset long, n long, level int, i long, digest string")

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [{**r, "level": k, "i": i, "digest": d} for r, _, levels in runs_of(left.sort_by("at"), right.sort_by("g").to_pylist()) for k, i, d in ragged(levels)]
        return pa.Table.from_pylist([{k: x[k] for k in local.names} for x in out], schema=as_arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    as_arrow = to_arrow_schema(local)
    nodes = cut(ranged.select("chunk", "at", "leaf").groupBy("chunk").cogroup(runs.groupBy("chunk")).applyInArrow(build, local))
    proven = finish(nodes, LEVELS, tallest).drop("digest")
    if above is None:
        proven = cut(proven.withColumn("root", F.col("subroot")))
    else:
        proven = cut(proven)
        up = cut(above(proven.groupBy("g").agg(F.first("subroot").alias("subroot"))))
        proven = cut(proven.join(up, "g").withColumn("path", F.concat("path", "up_path")).drop("up_path"))

    columns = list(dict.fromkeys(("g", "leaf", *keep)))
    schema = T.StructType([*(field(ranged, c) for c in columns), *T._parse_datatype_string(f"path {PATH}, subroot string, root string").fields])

    def prove(left: pa.Table, right: pa.Table) -> pa.Table:
        left, upper, runs = left.sort_by("at").combine_chunks(), {}, {}
        for x in right.to_pylist():
            upper[x["g"], x["level"], x["i"]] = _pairs(x["path"])
            runs[x["g"]] = x
        before, after, ends, subroot, root = [], [], [], [], []
        for r, _, levels in runs_of(left, sorted(runs.values(), key=lambda x: x["g"].encode())):
            sides = beside(levels)
            for i in range(r["offset"], r["offset"] + r["n"]):
                level = 0
                while (rest := upper.get((r["g"], level, i))) is None:  # until the leaf's path reaches a ragged node
                    b, a = sides[level][i - levels[level][0]]
                    before.append(b)
                    after.append(a)
                    i, level = i // FAN, level + 1
                before += [b for b, _ in rest]
                after += [a for _, a in rest]
                ends.append(len(before))
            subroot += [r["subroot"]] * r["n"]
            root += [r["root"]] * r["n"]
        return pa.table([*(left.column(c) for c in columns), paths(before, after, ends), pa.array(subroot, pa.string()), pa.array(root, pa.string())], names=schema.names)

    return ranged.groupBy("chunk").cogroup(proven.groupBy("chunk")).applyInArrow(prove, schema)


def manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), doc_id: str = "doc_id", group: str = "source", other: dict[str, Column] | None = None, part_rows: int = PART_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """A row's leaf, its proof and the roots: doc_id, source, leaf, path, subroot, root, and the digests of ``other``.

    A leaf is the digest of ``columns``.  Leaves of a group, by ascending doc_id, are
    hashed in threes (the last run may be shorter) until one node is left, the subroot;
    subroots, by group in UTF-8 order, in the same way to the root.  ``path`` holds for each
    level from the leaf to the root what stands before and after the node in its run, so
    ``folded`` gives the root again.  ``other`` adds digests of changed rows: a name, and what
    replaces each column (``{"tampered": {"text": ...}}``).

    Null values are leaves of their own kind, a null group is a group before all others
    and a null doc_id before all others; of rows that share a doc_id the smaller leaf comes
    first.  Repeated rows are leaves each.  Other columns are not read.  An empty table
    gives an empty table.
    """
    made = {name: [changed.get(c, F.col(c)) for c in columns] for name, changed in (other or {}).items()}
    g = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("+"), F.col(group).cast("string")))
    leaves = docs.select(F.col(doc_id).alias("doc_id"), g.alias("g"), joined(*(F.col(c) for c in columns)).alias("leaf"), *(joined(*own).alias(name) for name, own in made.items()))

    def over_groups(subroots: DataFrame) -> DataFrame:
        rows = subroots.select(F.lit("").alias("g"), F.col("g").alias("of"), F.col("subroot").alias("leaf"))
        return trees(rows, ("of",), ("of",), None, part_rows, chunk_rows).select(F.col("of").alias("g"), F.col("path").alias("up_path"), "root")

    out = trees(leaves, ("doc_id",), ("doc_id", *made), over_groups, part_rows, chunk_rows)
    return out.select("doc_id", F.when(F.col("g") != "", F.substring("g", 2, 1 << 30)).alias("source"), "leaf", "path", "subroot", "root", *made)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda done, x: F.sha2(F.concat(x["before"], done, x["after"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), "")
