"""Byte n-grams of documents as relational rows, packed so that one row holds an n-gram of a batch.

An n-gram of up to 6 bytes is a long.  ``explode`` emits each distinct n-gram of a
batch of documents once, with the documents that hold it and how often: the
exploded (document, n-gram, times) relation in packed form, to be joined to tables
by n-gram and summed per document.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.llm.common import field, map_texts, row_ids

#: Never in UTF-8; stands before the first byte of a text.
PAD = 0xFF
#: A key holds the n-gram and 16 bits for the document.
MOST_ORDER, MOST_DOCS, MOST_TIMES = 6, 1 << 16, (1 << 16) - 1
PIECE = 2 << 20


def windows(data: bytes, order: int, start: bool = True) -> np.ndarray:
    """The n-gram that ends at each byte, after ``order - 1`` bytes of padding or, if not ``start``, of earlier text."""
    x = np.frombuffer((bytes([PAD]) * (order - 1) if start else b"") + data, np.uint8).astype(np.int64)
    n = max(len(x) - order + 1, 0)
    out = np.zeros(n, np.int64)
    for k in range(order):
        out = (out << 8) | x[k : k + n]
    return out


def _count(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their counts; a count above 65,535 is spread over repeats of the key."""
    key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    times = np.diff(np.concatenate((first, [len(key)])))
    key = key[first]
    if (times > MOST_TIMES).any():
        again = -(-times // MOST_TIMES)
        key, last = np.repeat(key, again), np.cumsum(again) - 1
        rest = times - (again - 1) * MOST_TIMES
        times = np.full(len(key), MOST_TIMES)
        times[last] = rest
    return key, times


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], values.itemsize * ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def explode(docs: DataFrame, order: int, keep: Sequence[str] = ("doc_id",), text: str = "text", trusted: str | None = None, hot=None, batch_bytes: int = 2 << 20) -> DataFrame:
    """(gram, base, n, trusted, docs, times, kept, sums, counts): the distinct n-grams of each batch of documents.

    ``docs`` are 16-bit offsets from the row number ``base``, ``times`` 16-bit counts,
    ``n`` and ``trusted`` the sums of times over all and over trusted documents.  The
    n-grams of ``hot`` (a broadcast of sorted n-grams and their weights, a bounded number) are summed
    where they are and not emitted.  A row with a negative gram ends each batch: the
    ``keep`` columns of its documents and their sums and counts of hot n-grams, so
    that documents without any n-gram are there, too.  Texts longer than a batch go
    in pieces that overlap by ``order - 1`` bytes: no n-gram is lost or doubled.
    """
    if not 1 <= order <= MOST_ORDER:
        raise ValueError(f"order is 1 to {MOST_ORDER}")
    each = T.StructType([field(docs, c) for c in keep])
    schema = T.StructType([*T._parse_datatype_string("gram long, base long, n long, trusted long, docs binary, times binary").fields, T.StructField("kept", T.ArrayType(each)), *T._parse_datatype_string("sums array<double>, counts array<long>").fields])
    names = schema.names

    def pack(base, keys, trust, acc, kind):
        if not sum(map(len, keys)):
            return
        joined = np.concatenate(keys)
        keys.clear()  # a batch is held once
        key, times = _count(joined)
        del joined
        gram, who = (key >> np.uint64(16)).astype(np.int64), (key & np.uint64(MOST_DOCS - 1)).astype(np.uint16)
        start = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        ends = np.concatenate((start[1:], [len(gram)]))
        if hot is not None and len(hot.value[0]):
            known, weight = hot.value
            k = np.minimum(np.searchsorted(known, gram[start]), len(known) - 1)
            own = known[k] == gram[start]
            each = np.repeat(own, ends - start)
            w = np.repeat(weight[k[own]], (ends - start)[own])
            for i, x in enumerate((w * times[each], times[each])):
                acc[i] += np.bincount(who[each], x, MOST_DOCS)
            gram, who, times = gram[~each], who[~each], times[~each]
            if not len(gram):
                return
            start = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
            ends = np.concatenate((start[1:], [len(gram)]))
        good = np.array(trust, np.int64)
        for at in range(0, len(start), 50_000):
            a, b = start[at : at + 50_000], ends[at : at + 50_000]
            lo, hi = a[0], b[-1]
            n, ok = np.add.reduceat(times[lo:hi], a - lo), np.add.reduceat(times[lo:hi] * good[who[lo:hi]], a - lo)
            yield pa.RecordBatch.from_arrays([pa.array(gram[a]), pa.array(np.full(len(a), base)), pa.array(n), pa.array(ok), _binary(who[lo:hi], b - lo), _binary(times[lo:hi].astype(np.uint16), b - lo), pa.nulls(len(a), pa.list_(kind)), pa.nulls(len(a), pa.list_(pa.float64())), pa.nulls(len(a), pa.list_(pa.int64()))], names)

    def head(base, at, own, acc):
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), x)
        sums, counts = pa.array(acc[0][at : at + len(own)]), pa.array(acc[1][at : at + len(own)].astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array([-1 - base - at]), pa.array([base]), pa.array([0]), pa.array([0]), pa.array([b""]), pa.array([b""]), one(own), one(sums), one(counts)], names)

    def run(batches):
        ids = row_ids()
        base, keys, trust, held = next(ids), [], [], 0
        acc, waiting = [np.zeros(MOST_DOCS), np.zeros(MOST_DOCS)], []

        def close(kind):
            yield from pack(base, keys, trust, acc, kind)
            yield from (head(base, at, own, acc) for at, own in waiting if len(own))

        kind = None
        for batch in batches:
            flags = batch.column(len(keep) + 1).to_pylist() if trusted else [False] * batch.num_rows
            heads = pa.StructArray.from_arrays([batch.column(i) for i in range(len(keep))], names=list(keep))
            kind, first = heads.type, 0
            for i, (t, ok) in enumerate(zip(batch.column(len(keep)).cast(pa.large_binary()).to_pylist(), flags, strict=True)):
                if held >= batch_bytes or len(trust) == MOST_DOCS:
                    waiting.append((len(trust) - (i - first), heads[first:i]))
                    yield from close(kind)
                    base, keys, trust, held, first = base + MOST_DOCS, [], [], 0, i
                    acc, waiting = [np.zeros(MOST_DOCS), np.zeros(MOST_DOCS)], []
                t, row = t or b"", len(trust)
                trust.append(bool(ok))
                for at in range(0, len(t), PIECE):
                    key = windows(t[max(0, at - order + 1) : at + PIECE], order, at == 0).view(np.uint64)
                    key <<= np.uint64(16)
                    key |= np.uint64(row)
                    keys.append(key)
                    held += len(key)
                    if at + PIECE < len(t):
                        yield from pack(base, keys, trust, acc, kind)
            waiting.append((len(trust) - (batch.num_rows - first), heads[first:]))
        if kind is not None:
            yield from close(kind)

    return map_texts(docs.select(*keep, text, *([trusted] if trusted else [])), run, schema)


#: N-grams whose weights go to every task: a bounded table of 16 bytes a row.
HOT = 1 << 19


def hot_weights(weights: DataFrame, most: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` most frequent n-grams of (gram, weight, n) and their weights, sorted by n-gram."""
    top = weights.orderBy(F.desc("n"), "gram").limit(most).select("gram", "weight").toArrow()
    gram, weight = top.column("gram").to_numpy(), top.column("weight").to_numpy()
    order = np.argsort(gram)
    return gram[order], weight[order]


def score(docs: DataFrame, order: int, weights: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", most: int = HOT) -> DataFrame:
    """(keep..., total, n): per document the sum of its n-grams' weights, from a table (gram, weight, n).

    Frequent n-grams are summed where the documents are, against a bounded table; all
    others are exploded and joined to the table by n-gram.
    """
    hot = docs.sparkSession.sparkContext.broadcast(hot_weights(weights, most))
    packed = explode(docs, order, keep, text, hot=hot)
    return sum_weights(packed.join(weights.select("gram", "weight"), "gram", "left"), keep)


def sum_weights(packed: DataFrame, keep: Sequence[str] = ("doc_id",), weight: str = "weight") -> DataFrame:
    """(keep..., total, n): the weights of each document's n-grams, summed.

    The weighted rows of a batch of documents meet in one task, a batch after the
    other; a task holds the sums of one batch.
    """
    kept = packed.schema["kept"].dataType.elementType
    schema = T.StructType([*kept.fields, T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType())])

    def run(batches):
        state = None  # base, sums and counts by document, heads by first document

        def done():
            _, sums, counts, heads = state
            for at, own in heads:
                fields = own.flatten() if len(keep) else []
                yield pa.RecordBatch.from_arrays([*fields, pa.array(sums[at : at + len(own)]), pa.array(counts[at : at + len(own)].astype(np.int64))], schema.names)

        for batch in batches:
            gram, bases, weights = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            docs, counted = (batch.column(i).cast(pa.binary()) for i in (3, 4))
            lists, sums_of, counts_of = (batch.column(i) for i in (5, 6, 7))
            size = pa.compute.binary_length(docs).to_numpy(zero_copy_only=False) // 2
            who, times = (np.frombuffer(b"".join(x.to_pylist()), np.uint16) for x in (docs, counted))
            w = np.repeat(np.nan_to_num(weights), size) * times
            reach = np.concatenate(([0], np.cumsum(size)))
            edges = np.concatenate(([0], np.flatnonzero(np.diff(bases)) + 1, [len(bases)]))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if lo == hi:
                    continue
                if state is None or state[0] != bases[lo]:
                    if state is not None:
                        yield from done()
                    state = (bases[lo], np.zeros(MOST_DOCS), np.zeros(MOST_DOCS), [])
                own = slice(int(reach[lo]), int(reach[hi]))
                state[1][:] += np.bincount(who[own], w[own], MOST_DOCS)
                state[2][:] += np.bincount(who[own], times[own], MOST_DOCS)
                for i in (lo + np.flatnonzero(gram[lo:hi] < 0)).tolist():
                    at, rows = int(-1 - gram[i] - bases[i]), lists[i].values
                    state[3].append((at, rows))
                    state[1][at : at + len(rows)] += sums_of[i].values.to_numpy()
                    state[2][at : at + len(rows)] += counts_of[i].values.to_numpy()
        if state is not None:
            yield from done()

    rows = packed.select("gram", "base", weight, "docs", "times", "kept", "sums", "counts")
    return rows.repartition("base").sortWithinPartitions("base").mapInArrow(run, schema)


def suffix(gram: Column, n: int) -> Column:
    """The last ``n`` bytes."""
    return gram.bitwiseAND(F.lit((1 << (8 * n)) - 1))


def context(gram: Column) -> Column:
    """All but the last byte."""
    return F.shiftrightunsigned(gram, 8)
