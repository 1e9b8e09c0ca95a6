"""Importance resampling towards a target distribution, over hashed runs of words, in two passes."""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.llm.chat import numbered
from postloom.llm.common import cut, field, map_texts
from postloom.llm.words import PIECE, words_of

BUCKETS, LONGEST = 10_000, 3
#: Hashed features are added up in runs of at most about this many.
HELD = 1 << 18


def features(text: bytes | None, longest: int = LONGEST, piece: int = PIECE):
    """(n, CRC-32 of all runs of n consecutive words joined by a space) for n of 1 to ``longest``, piece by piece.

    The checksum of a run is that of the run without its last word, carried on.
    """
    held: list[bytes] = []  # the last words of the piece before
    for words in words_of(text, piece):
        known, words = len(held), held + words
        spaced, sums = [b" " + w for w in words], list(map(crc32, words))
        for n in range(longest):  # sums[i] is of the run of n + 1 words from word i
            if n:
                sums = list(map(crc32, spaced[n:], sums))
            if new := sums[max(known - n, 0) :]:
                yield n + 1, np.fromiter(new, np.uint32, len(new))
        held = words[-(longest - 1) :] if longest > 1 else []


def texts_of(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    return batch.column(column).cast(pa.large_binary()).to_pylist()


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall into each bucket: a vector for every partition, merged as a tree.

    The driver gets a few vectors of ``buckets`` numbers, the root of the number of partitions.
    """

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            held, size = [], 0
            for t in texts_of(batch, 0):
                for _, x in features(t, longest):
                    held.append(x)
                    size += len(x)
                    if size >= HELD:
                        total += np.bincount(np.concatenate(held) % buckets, minlength=buckets)
                        held, size = [], 0
            if held:
                total += np.bincount(np.concatenate(held) % buckets, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["total"])

    vectors = map_texts(texts.select(text), run, "total binary").rdd.map(lambda row: np.frombuffer(row["total"], np.int64))
    return vectors.treeReduce(np.add) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def log_gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """Whole ``scale``-ths of the log ratio of the add-one probabilities of each bucket, rounded down."""
    s, t, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(scale * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, keep: tuple[str, ...] = ("doc_id",), text: str = "text", longest: int = LONGEST) -> DataFrame:
    """(keep..., n_words, n_features, weight): the gains of each document's features, summed."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # one number a bucket
    schema = T.StructType([*(field(docs, c) for c in keep), *T._parse_datatype_string("n_words long, n_features long, weight long").fields])

    def run(batches):
        table = shared.value.astype(np.float64)  # whole numbers: their sums are exact below 2^53

        def flush(held, owners, weight):
            if held:
                own = np.repeat(np.array(owners, np.int64), [len(x) for x in held])
                weight += np.bincount(own, table[np.concatenate(held) % len(table)], len(weight)).astype(np.int64)

        for batch in batches:
            weight, words, runs = np.zeros((3, batch.num_rows), np.int64)
            held, owners, size = [], [], 0
            for row, t in enumerate(texts_of(batch, len(keep))):
                for n, x in features(t, longest):
                    held.append(x)
                    owners.append(row)
                    runs[row] += len(x)
                    words[row] += len(x) * (n == 1)
                    size += len(x)
                    if size >= HELD:
                        flush(held, owners, weight)
                        held, owners, size = [], [], 0
            flush(held, owners, weight)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(words), pa.array(runs), pa.array(weight)], schema.names)

    return map_texts(docs.select(*keep, text), run, schema)


def gumbel(doc_id: str, seed: int = 42, scale: int = 1000) -> Column:
    """Gumbel noise in whole ``scale``-ths, rounded down, from the SHA-256 of seed and id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """Draw ``percent`` of the documents without replacement, by importance towards the texts of ``target``:
    doc_id, n_words, n_features, weight, score, rank.

    A first pass counts hashed runs of 1 to 3 words of all documents and of all target
    texts; a second one sums each document's log gains.  Scores are weights with Gumbel
    noise, so the highest ones are a sample by weight.  Of N documents with at least
    ``least_words`` words floor(percent * N / 100) are drawn: rank is 1, 2, 3 and so on
    by score, ties to smaller doc_ids; it is null for all others.

    Null and empty texts have no features and weigh 0.  Of rows that tie in score and
    doc_id, as repeated rows do, any comes first, each with a rank of its own; null
    doc_ids come before others.  An empty target has equal counts in all buckets.  Other
    columns are not read.  An empty table gives an empty table.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    gains = log_gains(bucket_counts(rows), bucket_counts(target.select(F.col(target_text).alias("text"))))
    scored = weigh(rows, gains).withColumn("score", F.col("weight") + gumbel("doc_id", seed)).withColumn("row", F.monotonically_increasing_id())
    scored = cut(scored.withColumn("worst", -F.col("score")).withColumn("all", F.lit(0)))
    able = scored.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    ranked = numbered(able, "all", "worst", "doc_id", "row", name="place")
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    columns = ("doc_id", "n_words", "n_features", "weight", "score")
    return ranked.select(*columns, rank.alias("rank")).unionByName(scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))
