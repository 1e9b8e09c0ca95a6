"""Snapshots of batches applied to lists of postings: each item once, with a choice on duplicates; retries of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions.urls import url_key

SETTLED = ("completed", "failed")


def first_settled(items: DataFrame) -> DataFrame:
    """Of each item of each batch the first version of a snapshot in which it is completed or failed: later ones change nothing."""
    row = F.struct("version", *(c for c in items.columns if c != "version"))
    known = items.where(F.col("status").isin(*SETTLED))
    return known.groupBy("owner", "batch_id", "item").agg(F.min(row).alias("row")).select(*(F.col(f"row.`{c}`").alias(c) for c in items.columns))


def apply_snapshots(rows: DataFrame, items: DataFrame, applied: DataFrame, duplicates: str = "skip") -> tuple[DataFrame, DataFrame]:
    """The lists after all snapshots, and the items now applied (owner, batch_id, item).

    ``rows`` (owner, place, job_link, job, selected, batch_id) are the lists of their owners,
    ``items`` (owner, batch_id, version, item, url, status, job_link, job) the items of
    snapshots, ``applied`` those applied before.  Links are compared with the list as it was
    before the batch: where it has an item's link (the first row of it), the item replaces
    that row if ``duplicates`` is update, keeping its place and selection, and is left out if
    skip; else it is added behind the list, in order of version and item.  So replaying
    a snapshot changes nothing.

    Links without a key (empty, null) are never duplicates.  Of items that replace one
    row the last counts.  Items are reduced before they meet rows, places of new rows follow from their
    version and item, so no owner's list is ordered in one task.  Null owners are one
    owner.  Empty tables give the other side's rows.
    """
    c = F.col
    key = ("owner", "batch_id", "item")
    new = first_settled(items).withColumn("key", url_key(F.coalesce(c("url"), F.lit("")))).alias("n")
    new = new.join(applied.select(*key).distinct().alias("d"), (c("n.owner").eqNullSafe(c("d.owner"))) & (c("n.batch_id") == c("d.batch_id")) & (c("n.item") == c("d.item")), "left_anti")
    keyed = rows.withColumn("key", url_key(F.coalesce(c("job_link"), F.lit("")))).where("key <> ''")
    met = new.alias("n").join(keyed.groupBy("owner", "key", "batch_id").agg(F.min("place").alias("place")).alias("b"), c("n.owner").eqNullSafe(c("b.owner")) & (c("n.key") == c("b.key")) & ~c("b.batch_id").eqNullSafe(c("n.batch_id")), "left")
    met = met.groupBy("n.owner", "n.batch_id", "n.item").agg(F.first(F.struct("n.*")).alias("of_item"), F.min("b.place").alias("place")).select("of_item.*", "place")
    job = F.struct(F.coalesce("job_link", "url").alias("job_link"), "job", "batch_id")
    updates = met.where(c("place").isNotNull()).groupBy("owner", "place").agg(F.max(F.struct("version", "item", job.alias("row"))).alias("last"))
    if duplicates != "update":
        updates = updates.limit(0)
    left = rows.alias("r").join(updates.alias("u"), c("r.owner").eqNullSafe(c("u.owner")) & (c("r.place") == c("u.place")), "left")
    kept = left.select("r.owner", "r.place", *(F.when(c("u.last").isNotNull(), c(f"u.last.row.{n}")).otherwise(c(f"r.{n}")).alias(n) for n in ("job_link", "job")), "r.selected", F.when(c("u.last").isNotNull(), c("u.last.row.batch_id")).otherwise(c("r.batch_id")).alias("batch_id"))
    ends = rows.groupBy("owner").agg(F.max("place").alias("end"))
    added = met.where(c("place").isNull()).alias("a").join(ends.alias("e"), c("a.owner").eqNullSafe(c("e.owner")), "left")
    width = F.lit(1 << 20)  # items of a batch
    place = F.coalesce(c("e.end"), F.lit(0)) + 1 + c("a.version") * width + c("a.item")
    added = added.select("a.owner", place.alias("place"), F.coalesce("a.job_link", "a.url").alias("job_link"), "a.job", F.lit(False).alias("selected"), "a.batch_id")
    return kept.unionByName(added), applied.select(*key).unionByName(met.select(*key))


def retried(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Rows (owner, place, ..., job, selected) with the result of a retry (owner, place, job) in place of their job.

    A retry without a result (null job, a lost connection) leaves its row as it was; the
    selection stays.  Of several retries of a row the last by ``version`` counts.
    """
    c = F.col
    last = results.where("job IS NOT NULL").groupBy("owner", "place").agg(F.max_by("job", "version").alias("now"))
    out = rows.alias("r").join(last.alias("l"), c("r.owner").eqNullSafe(c("l.owner")) & (c("r.place") == c("l.place")), "left")
    return out.select(*(F.coalesce("l.now", "r.job").alias("job") if n == "job" else c(f"r.`{n}`") for n in rows.columns))
