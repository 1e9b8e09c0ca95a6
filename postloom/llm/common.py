"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The ASCII white space of the text contracts: \x20 and \x09 to \x0D.
SPACE = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session on one machine names none, as in tests, a temporary folder is set;
    on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster must name a shared folder in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="postloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/postloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch of whole texts: 10,000 long texts would not fit in a worker.
TEXT_BATCH = 8 << 20


def map_texts(rows: DataFrame, run, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` over rows with whole texts: batches of about ``TEXT_BATCH`` bytes, at least a row each.

    The bound is a session setting, read when a job runs, so it stays set; a session
    that names a smaller one keeps it.
    """
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    named = str(conf.get(key))
    if not (named.isdigit() and 0 < int(named) <= TEXT_BATCH):
        conf.set(key, str(TEXT_BATCH))
    return rows.mapInArrow(run, schema)


def row_ids() -> Iterator[int]:
    """Numbers that no other row of this task's output table has.

    They are only used in tables that are written at once, so a task that runs
    again replaces its rows together with their numbers.
    """
    context = TaskContext.get()
    base = (context.partitionId() if context else 0) << 40
    while True:
        yield base
        base += 1


def field(df: DataFrame, name: str, to: str | None = None) -> T.StructField:
    return T.StructField(to or name, df.schema[name].dataType, True)


def safe_pieces(data: bytes, size: int) -> Iterator[bytes]:
    """Cut a long text after about ``size`` bytes, always at ASCII white space; without any it stays whole."""
    at = 0
    while len(data) - at > size:
        found = [p for c in SPACE if (p := data.find(c, at + size, at + 2 * size)) >= 0] or [p for c in SPACE if (p := data.find(c, at + 2 * size)) >= 0]
        if not found:
            break
        yield data[at : (end := min(found))]
        at = end
    yield data[at:] if at else data


def balanced(texts: Iterable[bytes | None], batch_bytes: int, piece_bytes: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Batches of about ``batch_bytes``: the row of each piece, and the pieces; null texts give none."""
    rows: list[int] = []
    pieces: list[bytes] = []
    held = 0
    for row, text in enumerate(texts):
        for piece in safe_pieces(text, piece_bytes) if text else ():
            rows.append(row)
            pieces.append(piece)
            held += len(piece)
            if held >= batch_bytes:
                yield rows, pieces
                rows, pieces, held = [], [], 0
    if pieces:
        yield rows, pieces


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, hot: int = 1024) -> DataFrame:
    """Inner join of many ``rows`` to one row per group, safe for groups that hold a large part of all rows.

    The ``hot`` largest groups (at most that many rows, so a bounded broadcast) are
    joined where the rows lie; every other group is at most 1/hot of the rows and
    goes through an ordinary shuffle join.  Keys are numbers or digests, so ``hot`` of
    them are small; ``groups`` is computed more than once unless it is cut.
    """
    top = groups.where(F.col(size) > 1).orderBy(F.desc(size), key).limit(hot)
    return rows.join(F.broadcast(top), key).unionByName(rows.join(F.broadcast(top.select(key)), key, "left_anti").join(groups, key))


def attach_cut(rows: DataFrame, groups: DataFrame, key: str, size: str, most: int = 1 << 15) -> DataFrame:
    """``attach_groups`` where ``groups`` is a cut table: one join alone, without broadcasts of its own, if no group has more than ``most`` rows.

    So many rows of a few numbers are little for one task, and adaptive execution
    splits them where they stand out.  Each broadcast and stage takes some MB of the
    driver, whatever the rows; steps of many rounds attach groups many times.
    """
    return rows.join(groups, key) if groups.where(F.col(size) > most).isEmpty() else attach_groups(rows, groups, key, size)


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """``rows``, a table that is cheap to read again, marked for broadcast if they are counted to be at most ``most``."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def without(docs: DataFrame, dropped: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = 1 << 20) -> DataFrame:
    """``docs`` but for the rows whose (doc_id, XXH64 of the text) are in ``dropped`` (doc_id, h), a table that is cheap to read again.

    Up to ``most`` dropped rows (of 16 bytes and an id) are counted and sent to the
    documents, which then do not move; more are joined by a shuffle.  Columns of any
    names are kept as they are; null ids and texts are equal to null.
    """
    gone = bounded(dropped.select(F.col(doc_id).alias("gone_id"), F.col("h").alias("gone_h")), most)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("kept"))
    left = rows.join(gone, F.col(f"kept.`{doc_id}`").eqNullSafe(F.col("gone_id")) & (F.xxhash64(f"kept.`{text}`") == F.col("gone_h")), "left_anti")
    return left.select(*(F.col(f"kept.`{c}`").alias(c) for c in docs.columns))
