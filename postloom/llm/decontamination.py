"""Benchmark decontamination: multi-pattern search by shift tables over blocks of words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.llm.common import cut, field, map_texts
from postloom.llm.words import words_of

#: Words of a window, and of a block of the shift tables.
WINDOW, BLOCK = 10, 2
#: Words of benchmark items in the patterns of one pass: some 60 MB of tables in a task at most.
PASS_WORDS = 1 << 18
#: Documents are searched side by side in stretches of so many words.
STRETCH = 256


class Patterns:
    """Distinct patterns of one length in words (as ids) with the tables of a Wu-Manber search whose alphabet is words.

    ``shift[h]`` is how far a search may move on when a block of that hash ends a
    window: to the nearest place in any pattern where such a block may end.  Patterns
    that end in a block are listed under its hash, ``start[h]`` to ``start[h + 1]``.
    ``owners`` are the items of pattern p, from ``own[p]`` to ``own[p + 1]``.
    """

    def __init__(self, patterns: np.ndarray, items: np.ndarray):
        """One row for each pattern of each item, and the item."""
        self.length = patterns.shape[1]
        self.block = min(BLOCK, self.length)
        pairs = np.unique(np.column_stack((patterns, items)), axis=0)
        first = np.flatnonzero(np.concatenate(([True], (pairs[1:, :-1] != pairs[:-1, :-1]).any(axis=1))))
        patterns = pairs[first, :-1]
        self.bits = max(10, len(patterns).bit_length() + 3)
        last = self.hashes(patterns, self.length - 1)
        order = np.argsort(last, kind="stable")
        many = np.diff(np.concatenate((first, [len(pairs)])))[order]
        self.own = np.concatenate(([0], np.cumsum(many)))
        self.owners = pairs[np.repeat(first[order], many) + np.arange(len(pairs)) - np.repeat(self.own[:-1], many), -1]
        self.patterns = patterns[order]
        self.start = np.searchsorted(last[order], np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.shift = np.full(1 << self.bits, self.length - self.block + 1, np.int16)
        for end in range(self.block - 1, self.length):
            np.minimum.at(self.shift, self.hashes(patterns, end), self.length - 1 - end)

    def hashes(self, words: np.ndarray, end: int | np.ndarray) -> np.ndarray:
        """The hash of the block that ends at word ``end`` of each row; of a flat array, at those words."""
        h = np.zeros(1, np.uint64)
        for k in range(self.block - 1, -1, -1):
            w = words[:, end - k] if words.ndim == 2 else words[end - k]
            h = (h + w.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end, pattern) of all occurrences within documents, word ids from ``offsets[d]`` to ``offsets[d + 1]``.

        Stretches of all documents are searched at once, each at a place of its own.
        """
        m = self.length
        firsts, lasts = offsets[:-1] + m - 1, offsets[1:] - 1  # where a window may end
        n = np.maximum(-(-(lasts - firsts + 1) // STRETCH), 0)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(firsts, n) + nth * STRETCH
        stop = np.minimum(at + STRETCH - 1, np.repeat(lasts, n))
        ends, which = [], []
        while len(at):
            block = self.hashes(words, at)
            move = self.shift[block]
            if (hit := np.flatnonzero(move == 0)).size:
                pos, h = at[hit], block[hit]
                many = self.start[h + 1] - self.start[h]
                p = np.repeat(self.start[h], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                pos = np.repeat(pos, many)
                for k in range(m):  # the first word rules out most, as a prefix does
                    same = words[pos - (m - 1) + k] == self.patterns[p, k]
                    pos, p = pos[same], p[same]
                ends.append(pos)
                which.append(p)
            at = at + np.maximum(move, 1)
            left = at <= stop
            at, stop = at[left], stop[left]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *ends]), np.concatenate([none, *which])


def tables_of(items: list[tuple[str, list[bytes]]], window: int) -> tuple[dict[bytes, int], list[Patterns]]:
    """Word ids (from 1) and the search tables of all windows of the items, for each length; items have words."""
    vocab: dict[bytes, int] = {}
    by_length = defaultdict(list)
    for k, (_, words) in enumerate(items):
        ids = np.array([vocab.setdefault(w, len(vocab) + 1) for w in words], np.int32)
        each = np.lib.stride_tricks.sliding_window_view(ids, min(window, len(ids)))
        by_length[each.shape[1]].append((each, np.full(len(each), k, np.int32)))
    return vocab, [Patterns(np.concatenate([x for x, _ in own]), np.concatenate([k for _, k in own])) for own in by_length.values()]


def merged(spans: np.ndarray) -> np.ndarray:
    """Disjoint spans (start, end) in order that cover the same words; spans that only touch stay two."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(spans)), bool), spans[1:, 0] >= reach[:-1])))
    return np.column_stack((spans[first, 0], reach[np.concatenate((first[1:], [len(spans)]))[: len(first)] - 1]))


def occurrences(tables: list[Patterns], words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of documents' words: the disjoint spans that occurrences cover, and distinct pairs (document, item)."""
    spans, pairs = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
    for t in tables:
        ends, which = t.search(words, offsets)
        spans.append(merged(np.column_stack((ends - t.length + 1, ends + 1))))
        rows = np.searchsorted(offsets, ends, "right") - 1
        rows, which = np.unique(np.column_stack((rows, which)), axis=0).T
        many = t.own[which + 1] - t.own[which]
        owner = t.owners[np.repeat(t.own[which] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        pairs.append(np.unique(np.column_stack((np.repeat(rows, many), owner)), axis=0))
    return merged(np.concatenate(spans)), np.unique(np.concatenate(pairs), axis=0)


def lists(rows: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """Values of ascending rows as one list for each of n rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), values)


RESULT = "n_words long, spans array<struct<start: long, end: long>>, items array<string>"


def search(docs: DataFrame, items: list[tuple[str, list[bytes]]], keep: tuple[str, ...], text: str, window: int, batch_words: int = 1 << 20) -> DataFrame:
    """(keep..., n_words, spans, items) for items whose tables fit in a task."""
    names = sorted({i for i, _ in items})
    number = {i: k for k, i in enumerate(names)}
    vocab, tables = tables_of(items, window)
    for t in tables:
        t.owners = np.array([number[i] for i, _ in items], np.int64)[t.owners]
    shared = docs.sparkSession.sparkContext.broadcast((names, vocab, tables))  # bounded by PASS_WORDS
    schema = T.StructType([*(field(docs, c) for c in keep), *T._parse_datatype_string(RESULT).fields])

    def found(batch, sizes, ids):
        names, _, tables = shared.value
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        spans, pairs = occurrences(tables, np.concatenate([np.zeros(0, np.int32), *ids]), offsets)
        rows = np.searchsorted(offsets, spans[:, 0], "right") - 1
        spans = spans - offsets[rows][:, None]
        both = pa.StructArray.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1])], ["start", "end"])
        own = pa.array(names, pa.string()).take(pa.array(pairs[:, 1]))
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(np.array(sizes, np.int64)), lists(rows, len(sizes), both), lists(pairs[:, 0], len(sizes), own)], schema.names)

    def run(batches):
        known = shared.value[1].get
        for batch in batches:
            sizes, ids, held, first = [], [], 0, 0
            for row, t in enumerate(batch.column(len(keep)).cast(pa.large_binary()).to_pylist()):
                own = [np.fromiter(map(known, words, repeat(0)), np.int32, len(words)) for words in words_of(t)]
                sizes.append(sum(map(len, own)))
                ids += own
                held += sizes[-1]
                if held >= batch_words or row == batch.num_rows - 1:
                    yield found(batch.slice(first, len(sizes)), sizes, ids)
                    sizes, ids, held, first = [], [], 0, row + 1

    return map_texts(docs.select(*keep, text), run, schema)


def passes(benchmark: DataFrame, item_id: str, text: str, words: int = PASS_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items of the benchmark, as (id, words), in lists of about ``words`` words, at least one: a search each.

    Items come to the driver one partition after the other, so that it holds one list at a time.
    """
    held, size, given = [], 0, False
    for row in benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text")).toLocalIterator():
        own = [w for part in words_of(row["text"].encode() if row["text"] else None) for w in part]
        if own:
            held.append((row["id"], own))
            size += len(own)
        if size >= words:
            yield held
            held, size, given = [], 0, True
    if held or not given:
        yield held


def find_benchmarks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", pass_words: int = PASS_WORDS) -> DataFrame:
    """Benchmark passages in documents, a row per document: doc_id, n_words, spans, items.

    A pattern is ``window`` consecutive words of an item, or all of a shorter item.
    ``spans`` are the disjoint stretches of words (start, end past the last) that
    occurrences cover; ``items`` the ids, as sorted strings without repeats, of the items
    with a pattern that occurs.

    The items are searched for in passes of about ``pass_words`` words, whose tables
    every task holds; with more than one, documents are matched between passes by id
    and text.  Documents are read once a pass.

    Null and empty texts have no words.  Items without words never occur; a null item_id
    is an empty id; items that share an id count once.  Repeated rows each give a row.
    Null doc_ids are an id.  Other columns are not read.  An empty table gives an empty
    table; against an empty benchmark nothing is found.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    done = [search(rows, items, ("doc_id", "h"), "text", window) for items in passes(benchmark, item_id, item_text, pass_words)]
    if len(done) == 1:
        return done[0].drop("h")
    union = None
    for k, one in enumerate(done):
        one = one.withColumn("pass", F.lit(k))
        union = one if union is None else union.unionByName(one)
    first = F.col("pass") == 0
    grouped = cut(union).groupBy("doc_id", "h").agg(F.sum(first.cast("long")).alias("copies"), F.max("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    last = lambda done: F.element_at(done, -1)
    longer = lambda done, x: F.named_struct(F.lit("start"), last(done)["start"], F.lit("end"), F.greatest(last(done)["end"], x["end"]))
    joined = F.aggregate(
        F.array_sort("spans"),
        F.expr("cast(array() as array<struct<start: long, end: long>>)"),
        lambda done, x: F.when((F.size(done) > 0) & (x["start"] < last(done)["end"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer(done, x)))).otherwise(F.concat(done, F.array(x))),
    )
    return grouped.select("doc_id", "n_words", joined.alias("spans"), "items", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")
