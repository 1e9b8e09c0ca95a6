"""Batches of links: admission, duplicates, and the states of their items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions.urls import URL, clean_url, url_key, url_problem


def links_of(texts: DataFrame, text: str = "text") -> DataFrame:
    """Every link in pasted texts, cleaned, with its key and problem: a row per link and place."""
    found = texts.select("*", F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(URL), F.lit(0))).alias("place", "raw"))
    return found.withColumn("link", clean_url(F.col("raw"))).withColumn("key", url_key(F.col("raw"))).withColumn("problem", url_problem(F.col("raw"))).drop("raw")


def parsed_links(texts: DataFrame, owner: str, text: str = "text") -> DataFrame:
    """(owner, links, duplicates, invalid) of each pasted text: distinct valid links, repeats of their keys, and links with a problem."""
    found = links_of(texts.select(owner, text), text)
    by_key = found.groupBy(owner, "key").agg(F.count_if(F.col("problem").isNull()).alias("good"), F.count_if(F.col("problem").isNotNull()).alias("bad"))
    counts = by_key.groupBy(owner).agg(F.count_if(F.col("good") > 0).alias("links"), F.sum(F.greatest(F.col("good") - 1, F.lit(0))).alias("duplicates"), F.sum("bad").alias("invalid"))
    return texts.select(owner).distinct().join(counts, owner, "left").fillna(0, ["links", "duplicates", "invalid"])


def merged_links(existing: DataFrame, pasted: DataFrame, owner: str, text: str = "text") -> DataFrame:
    """(owner, added, duplicate, invalid): what each pasted text adds to the links of the existing one."""
    new = links_of(pasted.select(owner, text), text)
    old = links_of(existing.select(owner, text), text).select(owner, "key").distinct().withColumn("there", F.lit(True))
    keys = new.groupBy(owner, "key").agg(F.count_if(F.col("problem").isNull()).alias("good"), F.count_if(F.col("problem").isNotNull()).alias("bad")).join(old, [owner, "key"], "left")
    added = F.when((F.col("good") > 0) & F.col("there").isNull(), 1).otherwise(0)
    return keys.groupBy(owner).agg(F.sum(added).alias("added"), F.sum(F.col("good") - added).alias("duplicate"), F.sum("bad").alias("invalid"))


def admit(links: DataFrame, batch: str = "batch_id", link: str = "link", order: str = "place") -> DataFrame:
    """A row per batch and link key: the first link, its place, how often it came, and its problem."""
    rows = links.withColumn("key", url_key(F.col(link)))
    return rows.groupBy(batch, "key").agg(F.min_by(link, order).alias("link"), F.min(order).alias("place"), F.count("*").alias("times")).withColumn("problem", url_problem(F.col("link")))


def item_states(changes: DataFrame, batch: str = "batch_id", item: str = "item", at: str = "ts", cancelled: DataFrame | None = None) -> DataFrame:
    """(batch, item, state) after all changes (state at a time); items that a cancelled batch has not begun are cancelled.

    ``cancelled`` is (batch, cancelled_at).  Of changes at one time the later state counts.
    """
    rank = F.create_map(*(F.lit(x) for k, s in enumerate(("queued", "running", "cancelled", "completed", "failed")) for x in (s, k)))
    asked = cancelled if cancelled is not None else changes.select(batch, F.col(at).alias("cancelled_at")).limit(0)
    known = changes.join(asked, batch, "left")
    # once cancelling was asked, an item that is still queued does not begin
    begun = known.groupBy(batch, item).agg(F.min(F.when(F.col("state") != "queued", F.col(at))).alias("begun"), F.first("cancelled_at").alias("cancelled_at"), F.max_by("state", F.struct(F.col(at), rank[F.col("state")])).alias("state"))
    stopped = F.col("cancelled_at").isNotNull() & (F.col("begun").isNull() | (F.col("begun") > F.col("cancelled_at")))
    return begun.select(batch, item, F.when(stopped, "cancelled").otherwise(F.col("state")).alias("state"), F.col("cancelled_at").isNotNull().alias("cancel_requested"))


def snapshot(items: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Counts and status of each batch: completed or cancelled once no item is queued or running, else running or queued.

    ``items`` has state and may have cancel_requested; cancelled items are not processed.
    """
    n = lambda *s: F.count_if(F.col("state").isin(*s))
    asked = F.max("cancel_requested") if "cancel_requested" in items.columns else F.lit(False)
    out = items.groupBy(batch).agg(F.count("*").alias("total"), n("completed", "failed").alias("processed"), n("completed").alias("completed"), n("failed").alias("failed"), n("queued", "running").alias("open"), n("running", "completed", "failed").alias("begun"), asked.alias("asked"))
    status = F.when(F.col("open") > 0, F.when(F.col("begun") > 0, "running").otherwise("queued")).when(F.col("asked"), "cancelled").otherwise("completed")
    return out.withColumn("status", status).drop("open", "begun", "asked")


def retained(batches: DataFrame, now: str, ttl_seconds: int = 1800) -> DataFrame:
    """Batches but for those that finished ``ttl_seconds`` ago or more; finished_at is null for open ones."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("finished_at")
    return batches.where(F.col("finished_at").isNull() | (age < ttl_seconds))


def queue_stats(batches: DataFrame) -> DataFrame:
    """One row: active and retained batches."""
    return batches.agg(F.count_if(F.col("finished_at").isNull()).alias("active"), F.count("*").alias("retained"))
