"""Best-fit packing by exact-complement hashing."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.llm.common import balanced, cut, field, map_texts
from postloom.llm.word_encoder import encoder, ids_bytes


def cut_documents(docs: DataFrame, tokenizer: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", capacity: int = 2048, end_id: int = 0, batch_bytes: int = 4 << 20, piece_bytes: int = 1 << 20) -> DataFrame:
    """Token ids of each document and one ``end_id``, cut after every ``capacity`` ids.

    Returns keep..., piece, start, length, ids_crc32, and (part, nth): the task and
    the running number of the piece among those of its length in that task.  Long
    texts are encoded in parts cut at white space.
    """
    schema = T.StructType([*(field(docs, c) for c in keep), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType())])
    width, end = 4 * capacity, ids_bytes([end_id])

    def run(batches):
        words_of, seen, part = encoder(tokenizer, ids_bytes), np.zeros(capacity + 1, np.int64).tolist(), TaskContext.get().partitionId()
        for batch in batches:
            texts = batch.column(len(keep)).cast(pa.large_binary()).to_pylist()
            out, open_row, buffer, done = [], 0, bytearray(), 0

            def close(row, last, out=out):
                nonlocal buffer, done
                if last:
                    buffer += end
                at = 0
                while len(buffer) - at >= width or (last and at < len(buffer)):
                    ids = bytes(buffer[at : at + width])
                    n = len(ids) // 4
                    out.append((row, done // capacity, done, n, zlib.crc32(ids), part, seen[n]))
                    seen[n] += 1
                    done += n
                    at += len(ids)
                buffer = buffer[at:] if not last else bytearray()
                done = 0 if last else done

            for rows, pieces in balanced(texts, batch_bytes, words_of.piece_bytes(piece_bytes)):
                words = [words_of.units(p) for p in pieces]
                ids_of = words_of.table(set().union(*words)).__getitem__
                for row, w in zip(rows, words, strict=True):
                    while open_row < row:
                        close(open_row, True)
                        open_row += 1
                    buffer += b"".join(map(ids_of, w))
                    close(row, False)
            while open_row < len(texts):
                close(open_row, True)
                open_row += 1
            row, piece, start, length, crc, parts, nth = zip(*out, strict=True) if out else ((),) * 7
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(len(keep))), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(parts, pa.int32()), pa.array(nth, pa.int64())], schema.names)
        words_of.forget()

    return map_texts(docs.select(*keep, text), run, schema)


def _exact(av: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One, two or three available lengths that sum to ``gap``, the longest first; None if there are none."""
    if av[gap] > 0:
        return (gap,)
    here = av > 0

    def pair(g: int, most: int) -> tuple[int, int] | None:
        a = np.arange(min(g - 1, most), (g - 1) // 2, -1)
        hit = a[here[a] & here[g - a] & ((2 * a != g) | (av[a] > 1))] if len(a) else a
        return (int(hit[0]), g - int(hit[0])) if len(hit) else None

    if two := pair(gap, gap):
        return two
    for a in np.flatnonzero(here[: gap - 1])[::-1].tolist():
        if 3 * a < gap:
            break
        av[a] -= 1
        here[a] = av[a] > 0
        two = pair(gap - a, a)
        av[a] += 1
        here[a] = True
        if two:
            return (a, *two)
    return None


def plan_patterns(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths, how many such bins) over a histogram of lengths.

    From the longest length down, one, two or three lengths that exactly fill the gap
    are used as often as they are available.  What is left is packed best-fit,
    longest first, and each of its gaps is closed exactly where that can be done.
    Where long pieces prevail, short ones are spent too early by that; so best-fit
    alone is planned, too, and the plan of fewer bins returned.  Every step uses up a
    length, so patterns are bounded by the capacity.
    """
    plans = (_plan(counts, capacity, True), _plan(counts, capacity, False))
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def _plan(counts: dict[int, int], capacity: int, exact: bool) -> list[tuple[tuple[int, ...], int]]:
    av = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        av[n] = c
    out: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: tuple[int, ...]) -> None:
        own = {n: lengths.count(n) for n in lengths}
        times = int(min(av[n] // k for n, k in own.items()))
        for n, k in own.items():
            av[n] -= times * k
        out.append((lengths, times))

    if av[capacity]:
        use((capacity,))
    for residual in (False, True) if exact else (True,):
        for n in range(capacity - 1, 0, -1):
            while av[n] > 0:
                taken, gap = [n], capacity - n
                av[n] -= 1
                while gap > 0:
                    if combo := _exact(av, gap) if exact else None:
                        taken += combo
                        for x in combo:
                            av[x] -= 1
                        gap = 0
                        break
                    fits = np.flatnonzero(av[: gap + 1] > 0)
                    if not residual or not len(fits):
                        break
                    taken.append(int(fits[-1]))
                    av[taken[-1]] -= 1
                    gap -= taken[-1]
                for x in taken:
                    av[x] += 1
                if gap and not residual:
                    break
                use(tuple(taken))
    return out


def place(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank of each slot, the slot's first bin and its offset in the bin."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            slots.setdefault(n, []).append((used.get(n, 0), first, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        first += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*s, strict=True)) for n, s in slots.items()}


def pack(docs: DataFrame, tokenizer: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` ids: keep..., piece, start, length, ids_crc32, sequence_id, offset.

    The driver sees one row per length (``capacity`` at most) and returns as many
    patterns.  A piece's place follows from its rank among the pieces of its length:
    the rank in its task plus the pieces of that length in earlier tasks, so a length
    that most pieces share needs neither a sort nor a shuffle of its own.

    Null and empty texts are the end id alone.  Repeated rows are packed each.  Columns
    not in ``keep`` are not read.  An empty table gives an empty table.
    """
    pieces = cut(cut_documents(docs, tokenizer, keep, text, capacity, end_id))
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = place(plan_patterns(histogram, capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def where(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(), rank.to_numpy()
        out = np.zeros((2, len(rank)), np.int64)
        order = np.argsort(length, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
            ranks, bins, offsets = slots[int(length[own[0]])]
            k = np.searchsorted(ranks, rank[own], "right") - 1
            out[0, own], out[1, own] = bins[k] + rank[own] - ranks[k], offsets[k]
        return pd.DataFrame({"sequence_id": out[0], "offset": out[1]})

    ranked = pieces.join(before.drop("n"), ["length", "part"]).withColumn("at", where("length", F.col("nth") + F.col("before")))
    return ranked.select(*keep, "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
