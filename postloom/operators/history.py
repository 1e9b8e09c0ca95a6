"""History of postings: identity, upsert with ids, search, paging, deletion, sanitising and backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.urls import application_portal, clean_url, first_of, found_on, source_label, url_key

# The columns that a search looks into.
SEARCHED = ("company", "job_title", "location", "work_type", "salary", "found_on", "application_portal", "source", "job_link", "date_applied")
# Longest texts by kind of column.
LINKS, LONG = ("job_link", "preferred_job_link"), ("error", "review_notes", "preferred_job_link_note", "source_reliability_note")


def identity(link: Column, date: Column | None = None, company: Column | None = None, title: Column | None = None, location: Column | None = None) -> Column:
    """url: and the link's key; rows without a link manual: and a hash of date, company, title and location."""
    part = lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))) if c is not None else F.lit("")
    fields = F.concat_ws("\n", part(date), part(company), part(title), part(location))
    return F.when(F.coalesce(link, F.lit("")) != "", F.concat(F.lit("url:"), url_key(link))).otherwise(F.concat(F.lit("manual:"), F.sha2(fields, 256)))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the greatest in order (of equal ones the greatest row).  Combined before the shuffle, so repeated keys do no harm."""
    rest = [c for c in rows.columns if c != key]
    tie = F.xxhash64(*(F.col(f"`{c}`") for c in rest))
    return rows.groupBy(key).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in rest)), F.struct(F.col(order), tie)).alias("r")).select(key, *(F.col(f"r.`{c}`").alias(c) for c in rest))


def upsert(history: DataFrame, batch: DataFrame, key: str = "identity_key", order: str = "seq") -> DataFrame:
    """History after the batch: new keys are added, known ones take the latest values and keep id and created_at.

    ``batch`` has the columns of history but id and created_at, and ``order``; updated_at
    is the batch's, null or not.  New rows get the ids behind the greatest one, in order of their first
    place in the batch.  One full outer join on the key, and counts by blocks of places.
    """
    rest = [c for c in batch.columns if c not in (key, order)]
    body, tie = F.struct(*(F.col(f"`{c}`") for c in rest)), F.xxhash64(*(F.col(f"`{c}`") for c in rest))
    new = batch.groupBy(key).agg(F.max_by(body, F.struct(F.col(order), tie)).alias("r"), F.min(order).alias("first_seq")).select(key, *(F.col(f"r.`{c}`").alias(c) for c in rest), "first_seq", F.lit(True).alias("in_batch"))
    values = [c for c in history.columns if c not in (key, "id", "created_at")]
    joined = history.alias("h").join(new.alias("n"), key, "full_outer")
    in_batch = F.col("n.in_batch").isNotNull()
    merged = joined.select(key, F.col("h.id").alias("id"), F.coalesce("h.created_at", "n.updated_at").alias("created_at"), *(F.when(in_batch, F.col(f"n.{c}")).otherwise(F.col(f"h.{c}")).alias(c) for c in values), F.when(F.col("h.id").isNull(), F.col("first_seq")).alias("new_seq"))
    return with_ids(merged, "id", "new_seq", history.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))).drop("new_seq")


def with_ids(rows: DataFrame, id_: str, order: str, top: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Null ids filled behind the one row of ``top``, in order of a whole number that is set where they are null.

    Rows are numbered within blocks of that number and blocks by their counts, so no task orders all of them.
    """
    new = rows.where(F.col(order).isNotNull()).withColumn("block", F.floor(F.col(order) / block))
    counts = new.groupBy("block").agg(F.count("*").alias("n"))
    before = counts.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a block
    nth = F.row_number().over(Window.partitionBy("block").orderBy(order))
    filled = new.withColumn("nth", nth).join(before, "block").join(F.broadcast(top), F.lit(True)).withColumn(id_, (F.col("top") + F.col("before") + F.col("nth")).cast(rows.schema[id_].dataType))
    return rows.where(F.col(order).isNull()).unionByName(filled.select(*rows.columns))


def search(history: DataFrame, query: str = "", status: str = "all") -> DataFrame:
    """Rows of a status that hold the query in any searched column, ignoring case; % and _ are ordinary."""
    out = history if status == "all" else history.where(F.col("history_status") == status)
    if query := query[:200].lower():
        hit = F.lit(False)
        for c in SEARCHED:
            if c in history.columns:
                hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(query)), F.lit(False))
        out = out.where(hit)
    return out


def counts(history: DataFrame, query: str = "", status: str = "all") -> DataFrame:
    """One row: total under the filter, and all_count."""
    found = search(history.withColumn("history_status", F.col("history_status")), query, status).agg(F.count("*").alias("total"))
    return found.join(F.broadcast(history.agg(F.count("*").alias("all_count"))), F.lit(True))


def bounded(value: object, default: int, least: int, most: int) -> int:
    """A whole number within bounds; the default for anything that is none."""
    try:
        return max(least, min(most, int(str(value).strip())))
    except (TypeError, ValueError):
        return default


def page(rows: DataFrame, limit: object = 500, offset: object = 0) -> DataFrame:
    """A page, the last updated first: a top-k, not a full sort."""
    return rows.orderBy(F.desc("updated_at"), F.desc("id")).offset(bounded(offset, 0, 0, 1_000_000)).limit(bounded(limit, 500, 1, 1000))


def delete(history: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """History without the given ids."""
    return history.join(ids.select(key), key, "left_anti")


def deleted_count(history: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """How many rows ``delete`` takes away."""
    return history.join(ids.select(key), key, "left_semi").agg(F.count("*").alias("deleted"))


def status_counts(history: DataFrame, status: str = "history_status", manual: str = "manual") -> DataFrame:
    """total, ready, review, error and manual rows; manual is a flag beside the status."""
    n = lambda s: F.count_if(F.col(status) == s).alias(s)
    return history.agg(F.count("*").alias("total"), n("ready"), n("review"), n("error"), F.count_if(F.coalesce(F.col(manual), F.lit(False))).alias("manual"))


def sanitize(jobs: DataFrame) -> DataFrame:
    """Jobs as history may keep them, and ``problem``: why a row cannot be kept, or null.

    Texts are trimmed and bounded by the kind of their column, scores held within 0 to 100, issues to
    the first 20; preferred links that are no links go.  Other columns stay as they are.
    """
    out = jobs
    for c, kind in jobs.dtypes:
        if kind == "string":
            out = out.withColumn(c, F.substring(F.trim(F.coalesce(F.col(c), F.lit(""))), 1, 4096 if c in LINKS else 2000 if c in LONG else 500))
    if "confidence_score" in out.columns:
        out = out.withColumn("confidence_score", F.greatest(F.lit(0), F.least(F.lit(100), F.col("confidence_score").try_cast("int"))))
    if "review_issues" in out.columns:
        out = out.withColumn("review_issues", F.filter(F.transform(F.slice("review_issues", 1, 20), lambda x: F.substring(F.trim(x), 1, 100)), lambda x: x != ""))
    web = lambda c: F.col(c).rlike(r"^https?://[^/?#\s]+")
    if "preferred_job_link" in out.columns:
        out = out.withColumn("preferred_job_link", F.when(web("preferred_job_link"), F.col("preferred_job_link")).otherwise(""))
    problem = first_of([((F.col("job_link") != "") & ~web("job_link"), "History can only save complete http:// or https:// job links."), ((F.col("job_link") == "") & ((F.col("company") == "") | (F.col("job_title") == "")), "A history row needs a job link or a company and job title.")], F.lit(None).cast("string"))
    return out.withColumn("problem", problem)


def track_sources(jobs: DataFrame, selected: Column | None = None) -> DataFrame:
    """found_on, application_portal and source of each job from its link, a choice made and its older labels."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in jobs.columns else F.lit("")
    link, legacy = clean_url(text("job_link")), text("source")
    chosen = F.coalesce(F.nullif(selected, F.lit("")), text("found_on")) if selected is not None else text("found_on")
    older = F.when(text("application_portal") != "", text("application_portal")).otherwise(legacy)
    portal = application_portal(link, older)
    return jobs.withColumns({"found_on": found_on(link, chosen, legacy), "application_portal": portal, "source": portal})


def backfill(history: DataFrame) -> DataFrame:
    """History whose rows without found_on or application_portal get them from their links and older labels."""
    blank = (F.coalesce("found_on", F.lit("")) == "") | (F.coalesce("application_portal", F.lit("")) == "")
    link, old = F.coalesce("job_link", F.lit("")), F.col("source")
    portal = F.when(F.coalesce("application_portal", F.lit("")) != "", source_label(F.col("application_portal"))).otherwise(application_portal(link, old))
    filled = {"found_on": found_on(link, F.col("found_on"), old), "application_portal": portal}
    return history.withColumns({c: F.when(blank, v).otherwise(F.col(c)) for c, v in filled.items()})


def migrate(history: DataFrame) -> DataFrame:
    """Older history tables get the columns found_on and application_portal, filled by ``backfill``."""
    out = history
    for c in ("found_on", "application_portal", "source", "job_link"):
        out = out if c in out.columns else out.withColumn(c, F.lit("").cast("string"))
    return backfill(out)


def entries(history: DataFrame, stored: str = "job_json") -> DataFrame:
    """Rows with the fields of their stored JSON, columns where it lacks them."""
    names = [c for c in SEARCHED if c in history.columns]
    kept = F.from_json(stored, ", ".join(f"{c} string" for c in names))
    return history.withColumn("stored", kept).withColumns({c: F.coalesce(F.nullif(F.col(f"stored.{c}"), F.lit("")), F.col(c)) for c in names}).drop("stored")


def applied_date(c: Column) -> Column:
    """struct<date, problem> of MM/DD/YYYY or YYYY-MM-DD texts; the date as MM/dd/yyyy, '' for none."""
    v = F.trim(F.coalesce(c, F.lit("")))
    day = F.coalesce(F.try_to_timestamp(v, F.lit("M/d/yyyy")), F.try_to_timestamp(v, F.lit("yyyy-M-d")))
    return F.struct(F.coalesce(F.date_format(day, "MM/dd/yyyy"), F.lit("")).alias("date"), F.when((v != "") & day.isNull(), "Choose a valid application date.").alias("problem"))
