"""Mixing overlapping sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.llm.common import cut

#: Most membership patterns that the driver plans for; more is an error, never a cut.
MAX_PATTERNS = 1 << 18
#: A window of documents that one task scans holds about so many times its largest document.
WINDOW = 16
ADDED = ("pattern", "size", "source_size", "target", "copies", "taken")


def word_count(text: str) -> Column:
    """Words separated by ASCII white space; null has none."""
    return F.coalesce(F.expr(f"regexp_count({text}, '[^\\\\x20\\\\x09-\\\\x0D]+')"), F.lit(0)).cast("long")


def resharing(sizes: Sequence[int], weights: Sequence[float], factor: float = 1.5, most: float = 2.0) -> list[float]:
    """Targets that share ``factor`` times all sizes by weight; none above ``most`` times its size, the excess reshared."""
    left, open_, out = factor * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        weight = sum(weights[i] for i in sorted(open_))
        over = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(most * sizes[i])
        open_ -= set(over)
        left = factor * sum(sizes) - sum(out[i] for i in range(len(sizes)) if i not in open_)
    return out


def route(supply: Sequence[int], members: Sequence[Sequence[int]], quota: Sequence[int], copies: int = 2) -> list[dict[int, int]]:
    """Tokens that each pattern sends to each source, at least cost.

    The k-th copy of a pattern's tokens costs k - 1 a token, a convex cost, and
    routing is free; so the cheapest flow fills quotas with first copies as far as
    any routing allows, then augments with second copies, and so on.  Each level is
    a maximum flow by shortest augmenting paths over the small pattern graph.
    """
    flow: list[dict[int, int]] = [dict.fromkeys(m, 0) for m in members]
    into: list[list[int]] = [[] for _ in quota]
    for p, m in enumerate(members):
        for s in m:
            into[s].append(p)
    filled = [0] * len(quota)
    for level in range(1, copies + 1):
        for first in range(len(supply)):
            while (free := level * supply[first] - sum(flow[first].values())) > 0:
                came: dict[tuple[str, int], tuple[str, int] | None] = {("p", first): None}
                todo, end = deque(came), None
                while todo and end is None:
                    kind, x = node = todo.popleft()
                    if kind == "p":
                        step = [("s", s) for s in members[x]]
                    elif filled[x] < quota[x]:
                        end = node
                        break
                    else:
                        step = [("p", p) for p in into[x] if flow[p][x] > 0]
                    for y in step:
                        if y not in came:
                            came[y] = node
                            todo.append(y)
                if end is None:
                    break
                path = [end]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                path.reverse()
                back = [flow[q][s] for (k, s), (_, q) in zip(path[1::2], path[2::2], strict=False) if k == "s"]
                push = min([free, quota[end[1]] - filled[end[1]], *back])
                for (_, p), (_, s) in zip(path[0::2], path[1::2], strict=False):
                    flow[p][s] += push
                for (_, s), (_, q) in zip(path[1::2], path[2::2], strict=False):
                    flow[q][s] -= push
                filled[end[1]] += push
    return flow


STATE = "pattern array<string>, gap long, lo long, ranges array<struct<lo: long, hi: long, most: long>>, some array<struct<key: long, q: long>>, open boolean"


def scan(entries: pd.DataFrame) -> pd.DataFrame:
    """First fit over one pattern's window of keys: what is left of the gap, where the next window starts, and what was taken.

    ``entries`` has key, each (a row's size) and s (all its rows' size) beside gap, lo
    and behind (the key before which the window ends, null at the end of the pattern).
    A key that overshoots gives as many of its rows as fit and is passed over; from
    there on only rows that fit in what is left count.
    """
    entries = entries.sort_values("key")
    first = entries.iloc[0]
    gap, lo = int(first["gap"]), None if pd.isna(first["lo"]) else int(first["lo"])
    behind = None if pd.isna(first["behind"]) else int(first["behind"])
    most, left, ranges, some = gap, gap - int(first["before"]), [], []
    for key, each, s in zip(entries["key"].tolist(), entries["each"].tolist(), entries["s"].tolist(), strict=True):
        if s <= left and each <= most:
            left -= s
        elif each <= most:
            ranges.append({"lo": lo, "hi": key, "most": most})
            if q := left // each:
                some.append({"key": key, "q": q})
            left -= q * each
            lo, most = key, left
    if most:
        ranges.append({"lo": lo, "hi": behind, "most": most})
    row = {"pattern": first["pattern"], "gap": left, "lo": None if behind is None else behind - 1, "ranges": ranges, "some": some, "open": left > 0 and behind is not None}
    return pd.DataFrame([row]).astype({"lo": "Int64"})


def select_documents(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Which documents get one copy more: per pattern those that fit in the seeded order, and one that closes the gap.

    ``sized`` has pattern, u (the seeded order), size and row (unique).  Documents are
    taken in that order if they fit in what is left of the gap; one that overshoots is
    passed over, and those behind it that are not larger than the gap follow, until
    none is left.  Of equal rows (they share u) as many are taken as fit.
    The gap then is smaller than every document left, and the one that comes closest
    is taken if it overshoots by less than the gap.

    Each round finds where the gap is exceeded by a histogram of 2^17 buckets per
    pattern, and one task per pattern scans only the buckets from there on that hold
    ``WINDOW`` times the pattern's largest fitting document, a bounded number of words
    with equal rows counted together; a pattern of any size is never sorted.  Rounds
    go on behind the window, with the smaller gap, to the end of the pattern.
    Returns pattern, base, whole, ranges (lo, hi, most: keys between lo and hi, both
    exclusive and null for none, of at most that size), some (key, upto: rows of that
    key with a number up to that).
    """
    key = F.col("u").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    kinds = "array() :: array<struct<lo: long, hi: long, most: long>> as ranges", "array() :: array<struct<key: long, q: long>> as some"
    state = cut(plan.where("want > 0").selectExpr("pattern", "want as gap", "cast(null as long) as lo", *kinds, "true as open"))  # at most MAX_PATTERNS rows
    part = sized.where("size > 0").select("pattern", "u", key.alias("key"), "size", "row", F.shiftrightunsigned("u", 47).cast("int").alias("b"))
    all_of = Window.partitionBy("pattern")
    upto_b = all_of.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    while not state.where("open").isEmpty():  # every round ends a pattern or lessens what lies behind
        now = F.broadcast(state.where("open").select("pattern", "gap", "lo"))
        fit = part.join(now, "pattern").where("size <= gap and (lo is null or key > lo)")
        sums = fit.groupBy("pattern", "gap", "b").agg(F.sum("size").alias("s"), F.max("size").alias("m"))
        sums = sums.withColumn("cum", F.sum("s").over(upto_b)).withColumn("m", F.max("m").over(all_of))
        exceeded = F.struct("b", (F.col("cum") - F.col("s")).alias("before"))
        start = F.min(F.when(F.col("cum") > F.col("gap"), exceeded)).alias("start")
        stop = F.min(F.when(F.col("cum") > F.col("gap") + WINDOW * F.col("m"), F.col("b"))).alias("stop")
        bounds = sums.groupBy("pattern").agg(start, stop, F.sum("s").alias("total"))
        behind = F.when(F.col("stop") < (1 << 17) - 1, F.shiftleft((F.col("stop") + 1).cast("long"), 47).bitwiseXOR(F.lit(-(1 << 63))))
        bounds = cut(bounds.select("pattern", "start", F.coalesce("stop", F.lit(1 << 17)).alias("stop"), behind.alias("behind"), "total"))
        window = fit.join(F.broadcast(bounds), "pattern").where("b between start.b and stop")
        given = [F.first(c).alias(c) for c in ("gap", "lo", "behind")]
        keys = window.groupBy("pattern", "key").agg(F.sum("size").alias("s"), F.max("size").alias("each"), F.first("start.before").alias("before"), *given)
        seen = keys.groupBy("pattern").applyInPandas(scan, STATE).select("pattern", F.struct("gap", "lo", "ranges", "some", "open").alias("x"))
        step = state.join(bounds.select("pattern", "total"), "pattern", "left").join(seen, "pattern", "left")
        rest = F.when(F.col("open") & F.col("total").isNotNull(), F.array(F.struct("lo", F.lit(None).cast("long").alias("hi"), F.col("gap").alias("most"))))  # all of it fits
        ranges = F.concat("ranges", F.coalesce("x.ranges", rest, F.slice("ranges", 1, 0)))
        some = F.concat("some", F.coalesce("x.some", F.slice("some", 1, 0)))
        left = F.coalesce("x.gap", F.when(F.col("open"), F.col("gap") - F.coalesce("total", F.lit(0))), "gap")
        state = cut(step.select("pattern", left.alias("gap"), F.coalesce("x.lo", "lo").alias("lo"), ranges.alias("ranges"), some.alias("some"), F.coalesce("x.open", F.lit(False)).alias("open")))
    rest = part.join(F.broadcast(state), "pattern").where("size < 2 * gap").where(~_in_ranges(F.col("key"), F.col("size")))
    near = rest.groupBy("pattern").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")), "key")).alias("x")).select("pattern", F.col("x.key").alias("fill"))
    of_fill = lambda e: e["key"] == F.col("fill")
    one_more = F.transform("some", lambda e: F.struct(e["key"].alias("key"), (e["q"] + F.when(of_fill(e), 1).otherwise(0)).alias("q")))
    asked = F.when(F.col("fill").isNull(), F.col("some")).when(F.exists("some", of_fill), one_more).otherwise(F.array_append("some", F.struct(F.col("fill").alias("key"), F.lit(1).cast("long").alias("q"))))
    state = cut(state.join(near, "pattern", "left").select("pattern", "ranges", asked.alias("some")))
    upto = _row_limits(part, state.select("pattern", F.explode("some").alias("e")).select("pattern", "e.key", "e.q"))
    some = upto.groupBy("pattern").agg(F.collect_list(F.struct("key", "upto")).alias("some"))  # one a cut
    return F.broadcast(plan.join(cut(state.select("pattern", "ranges").join(some, "pattern", "left")), "pattern", "left").select("pattern", "base", "whole", "ranges", "some"))


def _row_limits(part: DataFrame, asked: DataFrame) -> DataFrame:
    """(pattern, key, upto): the q-th smallest row number of each asked (pattern, key, q), however many rows share it.

    Rows are counted by blocks of their numbers, and only the block of the limit is ordered.
    """
    rows = part.select("pattern", "key", "row", F.shiftright("row", 16).alias("block")).join(F.broadcast(asked), ["pattern", "key"])
    w = Window.partitionBy("pattern", "key").orderBy("block")
    sums = rows.groupBy("pattern", "key", "q", "block").agg(F.count("*").alias("n")).withColumn("cum", F.sum("n").over(w))
    at = sums.where("cum >= q").groupBy("pattern", "key").agg(F.min(F.struct("block", (F.col("q") - F.col("cum") + F.col("n")).alias("nth"))).alias("x")).select("pattern", "key", "x.block", "x.nth")
    inside = rows.drop("q").join(F.broadcast(at), ["pattern", "key", "block"])
    nth = F.row_number().over(Window.partitionBy("pattern", "key").orderBy("row"))
    return inside.withColumn("k", nth).where("k = nth").select("pattern", "key", F.col("row").alias("upto"))


def _in_ranges(key: Column, size: Column) -> Column:
    inside = F.exists("ranges", lambda r: F.coalesce(key > r["lo"], F.lit(True)) & F.coalesce(key < r["hi"], F.lit(True)) & (size <= r["most"]))
    return F.coalesce(inside, F.lit(False))


def mix(docs: DataFrame, members: Column, size: Column, targets, keep: Sequence[str] = ("doc_id",), seed: int = 11, copies: int = 2, prefix: str = "") -> DataFrame:
    """Take documents so that each source's tokens meet its target: keep..., pattern, size, source_size, target, copies, taken.

    The added columns' names start with ``prefix``, and must not be names of ``keep``.

    ``members`` is an array<string> column of the sources that hold a document, ``size``
    its tokens; ``targets(names, sizes)`` gives the sources' targets.  Patterns of
    sources are aggregated, their tokens routed by min-cost flow with convex costs for
    repetition, and documents selected whole in an order seeded by their keys.  For
    documents of several sources, source_size and target are sums over them.

    Null members are sources of their own, named by null; documents without sources
    are not taken.  Documents of size 0 take 0.  Of repeated rows as many get a copy more as
    are wanted.  An empty table gives an empty table.  Reruns agree.  Names of ``keep`` may
    be any but the added ones.
    """
    if clash := {prefix + c for c in ADDED} & set(keep):
        raise ValueError(f"columns of keep clash with added ones: {sorted(clash)}")
    named = F.array_sort(F.array_distinct(F.transform(members, lambda x: F.coalesce(F.concat(F.lit("="), x), F.lit("~")))))
    order = F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in keep), size)
    full = cut(docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept"), named.alias("pattern"), size.alias("size"), order.alias("u"), F.monotonically_increasing_id().alias("row")))
    sized = full.select("pattern", "size", "u", "row")
    rows = sized.groupBy("pattern").agg(F.sum("size").alias("s")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    rows.sort(key=lambda r: r["pattern"])
    names = sorted({s for r in rows for s in r["pattern"]})  # "~" comes after "=": null last
    at = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for r in rows:
        for s in r["pattern"]:
            sizes[at[s]] += r["s"]
    target = targets([None if s == "~" else s[1:] for s in names], sizes)
    flow = route([r["s"] for r in rows], [[at[s] for s in r["pattern"]] for r in rows], [round(t) for t in target], copies)
    spark = docs.sparkSession
    plan = [(list(r["pattern"]), r["s"], (f := sum(x.values())) // r["s"] if r["s"] else 0, f % r["s"] if r["s"] else 0, float(sum(sizes[at[s]] for s in r["pattern"])), float(sum(target[at[s]] for s in r["pattern"]))) for r, x in zip(rows, flow, strict=True)]
    table = spark.createDataFrame(plan, T._parse_datatype_string("pattern array<string>, whole long, base int, want long, source_size double, target double"))
    chosen = select_documents(sized, table.select("pattern", "whole", "base", "want"))
    key = F.col("u").bitwiseXOR(F.lit(-(1 << 63)))
    extra = _in_ranges(key, F.col("size")) | F.coalesce(F.exists("some", lambda e: (e["key"] == key) & (F.col("row") <= e["upto"])), F.lit(False))
    out = full.join(chosen, "pattern").join(F.broadcast(table.select("pattern", "source_size", "target")), "pattern")
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("base") + extra.cast("int")).otherwise(0))
    added = (F.col("pattern"), F.col("size"), F.col("source_size").cast("long"), F.col("target"), F.col("copies"), F.col("size") * F.col("copies"))
    return out.select(*(F.col(f"kept.`{c}`").alias(c) for c in keep), *(x.alias(prefix + c) for x, c in zip(added, ADDED, strict=True)))


def cycling_targets(weights: Sequence[float] = (3.0, 1.0, 2.0), factor: float = 1.5, most: float = 2.0):
    """Weights repeat over the sources in code point order, null last."""
    return lambda names, sizes: resharing(sizes, [weights[i % len(weights)] for i in range(len(names))], factor, most)
