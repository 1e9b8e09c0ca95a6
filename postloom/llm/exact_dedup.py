"""Exact dedup by content-defined chunk recipes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.llm.common import attach_groups, cut, field, map_texts, row_ids

#: Chunk sizes in bytes: least, mean (a power of two) and largest.
LEAST, MEAN, LARGEST = 2048, 4096, 16384
RECIPE = T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("len", T.IntegerType()), T.StructField("sha", T.BinaryType())]))
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([i])).digest()[:4], "little") for i in range(256)], np.uint32)


def chunk_ends(data: bytes, least: int = LEAST, mean: int = MEAN, largest: int = LARGEST) -> list[int]:
    """Ends of the chunks: where a hash of the last 32 bytes has low bits zero, between least and largest."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for s in (1, 2, 4, 8, 16):
        h[s:] = h[s:] + (h[:-s] << np.uint32(s))
    marks = np.flatnonzero((h & np.uint32((mean - 1) << 16)) == 0) + 1
    ends, at = [], 0
    while n - at > least:
        k = np.searchsorted(marks, at + least)
        end = min(int(marks[k]) if k < len(marks) else n, at + largest, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def chunk_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """One row per document: doc_id, row (unique), text_sha256 and its recipe of (h, len, sha) in order.

    ``bits`` shortens the chunk hash; below 64 it only serves to test collisions.
    """
    import xxhash

    schema = T.StructType([field(docs, doc_id, "doc_id"), T.StructField("row", T.LongType()), T.StructField("text_sha256", T.StringType()), T.StructField("recipe", RECIPE)])

    def run(batches):
        ids, wrap = row_ids(), 1 << (bits - 1)
        for batch in batches:
            offsets, h, size, sha, whole = [0], [], [], [], []
            for t in batch.column(1).cast(pa.large_binary()).to_pylist():
                t, at = t or b"", 0
                all_of = hashlib.sha256(t)
                whole.append(all_of.hexdigest())
                ends = chunk_ends(t)
                for end in ends:
                    part = t if len(ends) == 1 else t[at:end]
                    h.append((xxhash.xxh3_64_intdigest(part) >> (64 - bits)) - wrap)
                    size.append(end - at)
                    sha.append(all_of.digest() if len(ends) == 1 else hashlib.sha256(part).digest())
                    at = end
                offsets.append(len(h))
            chunks = pa.StructArray.from_arrays([pa.array(h, pa.int64()), pa.array(size, pa.int32()), pa.array(sha, pa.binary())], ["h", "len", "sha"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([next(ids) for _ in whole], pa.int64()), pa.array(whole), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), chunks)], schema.names)

    return map_texts(docs.select(doc_id, text), run, schema)


def identify_chunks(recipes: DataFrame) -> DataFrame:
    """The distinct chunks: h, len, n (uses) and whether the identifier is verified.

    (h, len) identifies a chunk once all its uses carry one SHA-256.  Least and
    greatest digest are combined before the shuffle, so a chunk that many documents
    share costs one row per task.
    """
    return recipes.select(F.explode("recipe").alias("c")).groupBy("c.h", "c.len").agg(F.count("*").alias("n"), (F.min("c.sha") == F.max("c.sha")).alias("verified"))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """Group equal texts: doc_id, row, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are read once and cut into content-defined chunks; only chunk hashes and
    digests move from then on.  Chunks become verified identifiers, and two
    documents are equal when their ordered identifier lists are.  Of equal texts the
    row with the largest doc_id stays; of rows that also share it, one.

    Null texts count as empty, and empty texts are equal (their list is empty).  Null
    ids sort below all others.  Other columns are not read.  An empty table gives none.
    """
    recipes = cut(chunk_documents(docs, doc_id, text, bits))
    clash = identify_chunks(recipes).where(~F.col("verified")).select("h", "len")
    if clash.isEmpty():
        listed = recipes.withColumn("ids", F.transform("recipe", lambda c: F.struct(c["h"], c["len"])))
    else:  # identifiers that two different chunks share are told apart by digest
        each = recipes.select("row", F.posexplode("recipe").alias("pos", "c")).select("row", "pos", "c.h", "c.len", "c.sha")
        each = each.join(clash.withColumn("sha2", F.lit(True)), ["h", "len"], "left")
        each = each.select("row", F.struct("pos", "h", "len", F.when(F.col("sha2"), F.col("sha")).alias("sha")).alias("c"))
        ids = each.groupBy("row").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: F.struct(c["h"], c["len"], c["sha"])).alias("ids"))
        listed = recipes.join(ids, "row", "left").withColumn("ids", F.coalesce("ids", F.expr("filter(array(struct(0L as h, 0 as len, cast(null as binary) as sha)), x -> false)")))
    rows = listed.select("doc_id", "row", "ids", "text_sha256", F.size("recipe").alias("n_chunks"))
    groups = rows.groupBy("ids").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
    groups = groups.withColumn("of", F.sha2(F.to_json(F.struct("ids")), 256)).drop("ids")  # 32 bytes for a list of any length
    rows = rows.withColumn("of", F.sha2(F.to_json(F.struct("ids")), 256)).drop("ids")
    joined = attach_groups(rows, groups, "of", "group_size")
    return joined.select("doc_id", "row", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256", "n_chunks")
