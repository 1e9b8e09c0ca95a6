"""Application tracker tables: header discovery, schema migration, append with skip or update, the input sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.quality import needs_manual_review
from postloom.functions.urls import application_portal, first_of, found_on, link_key, lookup
from postloom.operators.history import with_ids

# The tracker's columns and the header spellings that mean them.
HEADERS = {
    "Date Applied": ["dateapplied", "applieddate", "applicationdate", "date"],
    "Company": ["company", "companyname", "employer", "organization"],
    "Job Title": ["jobtitle", "title", "position", "role"],
    "Job link": ["joblink", "joburl", "url", "link", "postinglink", "applicationlink"],
    "Status": ["status", "applicationstatus"],
    "Location": ["location", "joblocation"],
    "Work Type": ["worktype", "workstyle", "remotehybridonsite", "remote"],
    "Salary Range": ["salaryrange", "salary", "pay", "compensation"],
    "Follow-up": ["followup", "followupdate"],
    "Found On": ["foundon", "discoveredon", "discoverysource", "jobboard", "wherefound"],
    "Application Portal": ["applicationportal", "appliedthrough", "applicationsite", "portal", "source", "platform", "website"],
}
# The job's field of each column.
FIELDS = {"Date Applied": "date_applied", "Company": "company", "Job Title": "job_title", "Job link": "job_link", "Status": "status", "Location": "location", "Work Type": "work_type", "Salary Range": "salary", "Follow-up": "follow_up", "Found On": "found_on", "Application Portal": "application_portal"}
# Columns of the input sheet.
INPUT = ["Job Link", "Found On", "Notes", "Process Status", "Processed At", "Error Message"]


def resolve_headers(cells: DataFrame, rows: int = 10) -> DataFrame:
    """(sheet, row, header, col) of each sheet's header row, from cells (sheet, row, col, value).

    The header row is the one of the first ten that holds the most known headers, the
    first of equals; of a header's columns the first counts.
    """
    names = lookup({a: name for name, aliases in HEADERS.items() for a in aliases})
    known = cells.where(F.col("row") <= rows).withColumn("header", F.try_element_at(names, F.regexp_replace(F.lower(F.coalesce("value", F.lit(""))), "[^a-z0-9]+", ""))).where("header is not null")
    first = known.groupBy("sheet", "row", "header").agg(F.min("col").alias("col"))
    best = first.groupBy("sheet", "row").agg(F.count("*").alias("n")).groupBy("sheet").agg(F.min_by("row", F.struct(-F.col("n"), F.col("row"))).alias("row"))
    return first.join(best, ["sheet", "row"])


def choose_sheet(cells: DataFrame, order: str = "sheet_no") -> DataFrame:
    """(sheet, row) of the tracker: the sheet named applications, else the one with the most headers, the first of equals."""
    scored = resolve_headers(cells).groupBy("sheet", "row").agg(F.count("*").alias("n"))
    places = cells.groupBy("sheet").agg(F.min(order).alias("place"))
    named = (F.lower(F.trim("sheet")) == "applications").cast("int")
    best = places.join(scored, "sheet", "left").agg(F.min_by(F.struct("sheet", F.coalesce("row", F.lit(1)).alias("row")), F.struct(-named, -F.coalesce("n", F.lit(0)), F.col("place"))).alias("b"))
    return best.select("b.sheet", "b.row")


def with_headers(cells: DataFrame, headers: list[str]) -> DataFrame:
    """A sheet's header row by strip and case folding only, the last of repeats; missing headers behind the last column."""
    named = cells.where("row = 1 and trim(coalesce(value, '')) <> ''").groupBy(F.lower(F.trim("value")).alias("header")).agg(F.max("col").alias("col"))
    wanted = cells.sparkSession.createDataFrame([(h.lower(), k) for k, h in enumerate(headers)], "header string, k int")
    last = cells.where("row = 1").agg(F.coalesce(F.max("col"), F.lit(0)).alias("last"))
    lacking = wanted.join(named, "header", "left_anti").join(F.broadcast(last), F.lit(True))
    added = lacking.select("header", (F.col("last") + F.row_number().over(Window.orderBy("k"))).cast("int").alias("col"))  # a row a header
    return named.select("header", F.col("col").cast("int").alias("col")).unionByName(added)


def link_of(cell: Column, target: Column) -> Column:
    """A link cell's link: its target before its text."""
    return F.trim(F.coalesce(F.nullif(target, F.lit("")), cell, F.lit("")))


def existing_links(tracker: DataFrame, link: str = "Job link", target: str = "target", row: str = "row") -> DataFrame:
    """(key, row): the last row of each link; the text "open job" is none unless it has a target."""
    to = F.col(target) if target in tracker.columns else F.lit(None).cast("string")
    value = link_of(F.col(f"`{link}`"), to)
    rows = tracker.where((value != "") & (F.lower(value) != "open job"))
    return rows.groupBy(link_key(value).alias("key")).agg(F.max(row).alias("row"))


def migrate(tracker: DataFrame) -> DataFrame:
    """Old tables get Found On and Application Portal from the link and their Source; other columns stay.

    A filled Found On stays, a filled Application Portal only where there is no Source
    column beside it.  Rows without company, title and link are left as they are.
    """
    text = lambda h: F.trim(F.coalesce(F.col(f"`{h}`"), F.lit(""))) if h in tracker.columns else F.lit("")
    legacy = "Source" in tracker.columns and "Application Portal" not in tracker.columns
    old = text("Source") if legacy else text("Application Portal")
    filled = (text("Company") != "") | (text("Job Title") != "") | (text("Job link") != "")
    portal = application_portal(text("Job link"), old)
    found = found_on(text("Job link"), text("Found On"), old)
    out = tracker.withColumn("Found On", F.when(filled & (text("Found On") == ""), found).otherwise(text("Found On")))
    keep = F.lit(False) if legacy else text("Application Portal") != ""
    out = out.withColumn("Application Portal", F.when(filled & ~keep, portal).otherwise(text("Application Portal")))
    out = out.drop("Source") if legacy else out
    return out.select(*out.columns, *(F.lit(None).cast("string").alias(h) for h in HEADERS if h not in out.columns))


def job_row(jobs: DataFrame, run_date: str) -> DataFrame:
    """Jobs in the tracker's columns: defaults for what is missing, dates read from two formats, else ``run_date``."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in jobs.columns else F.lit("")
    link = text("job_link")
    day = F.coalesce(F.try_to_timestamp(text("date_applied"), F.lit("M/d/yyyy")), F.try_to_timestamp(text("date_applied"), F.lit("yyyy-M-d"))).cast("date")
    default = lambda h: {"Status": "", "Follow-up": "", "Job link": ""}.get(h, "n/a")
    values = {h: F.when(text(f) == "", default(h)).otherwise(text(f)) for h, f in FIELDS.items()}
    values |= {"Date Applied": F.coalesce(day, F.lit(run_date).cast("date")), "Found On": found_on(link, text("found_on"), text("source")), "Application Portal": application_portal(link, text("source"))}
    return jobs.select("seq", *(v.alias(h) for h, v in values.items()))


def append(tracker: DataFrame, jobs: DataFrame, mode: str = "skip", link: str = "Job link") -> DataFrame:
    """The tracker with the jobs added, and ``change``: kept, updated or added.

    ``tracker`` has row (its order) and any columns, ``jobs`` seq (theirs) and columns of the
    tracker.  A job whose link the tracker or an earlier job has is skipped or, with
    ``update``, its columns replace those of the link's last row, in place; other columns
    and other rows of the link stay.  Added rows follow the last one in order of seq.
    Jobs and rows without a link are never matched.
    """
    common = [c for c in jobs.columns if c in tracker.columns and c not in ("row", "seq")]
    new = jobs.withColumn("key", link_key(F.col(f"`{link}`")))
    new = new.withColumn("key", F.when(F.col("key") == "", F.concat(F.lit("row:"), F.col("seq").cast("string"))).otherwise(F.concat(F.lit("link:"), F.col("key"))))
    body = F.struct(*(F.col(f"`{c}`") for c in common))
    new = new.groupBy("key").agg((F.max_by if mode == "update" else F.min_by)(body, F.col("seq")).alias("n"), F.min("seq").alias("seq"))
    old = tracker.withColumn("key", F.concat(F.lit("link:"), link_key(F.col(f"`{link}`"))))
    last = old.where("key <> 'link:'").groupBy("key").agg(F.max("row").alias("last_row"))
    # rows meet what replaces them by their own number, so a link that many rows share, or none, is no large group
    joined = old.join(last.join(new, "key").select("last_row", "n"), F.col("row") == F.col("last_row"), "left") if mode == "update" else old.withColumn("n", F.lit(None).cast(new.schema["n"].dataType)).withColumn("last_row", F.lit(None).cast("long"))
    hit = F.col("n").isNotNull() & (F.col("row") == F.col("last_row"))
    kept = joined.select(*(F.when(hit, F.col(f"n.`{c}`")).otherwise(F.col(f"`{c}`")).alias(c) if c in common else F.col(f"`{c}`") for c in tracker.columns), F.when(hit, "updated").otherwise("kept").alias("change"))
    added = new.join(last, "key", "left_anti")
    top = tracker.agg(F.coalesce(F.max("row"), F.lit(0)).alias("top"))
    numbered = with_ids(added.select(F.lit(None).cast("long").alias("id"), "n", "seq"), "id", "seq", top)
    place = F.col("id").cast(tracker.schema["row"].dataType)
    rows = numbered.select(*(place.alias(c) if c == "row" else F.col(f"n.`{c}`").alias(c) if c in common else F.lit(None).cast(tracker.schema[c].dataType).alias(c) for c in tracker.columns), F.lit("added").alias("change"))
    return kept.unionByName(rows)


def append_counts(tracker: DataFrame, jobs: DataFrame, mode: str = "skip", link: str = "Job link") -> DataFrame:
    """One row: added, skipped and updated jobs; of jobs that share a link all but the first meet that one."""
    keys = jobs.select(link_key(F.col(f"`{link}`")).alias("key"), "seq")
    last = tracker.select(link_key(F.col(f"`{link}`")).alias("key")).where("key <> ''").distinct().withColumn("there", F.lit(True))
    by_key = keys.groupBy("key").agg(F.count("*").alias("n")).join(last, "key", "left")
    added = F.when(F.col("key") == "", F.col("n")).when(F.col("there"), 0).otherwise(1)
    out = by_key.agg(F.coalesce(F.sum(added), F.lit(0)).alias("added"), F.coalesce(F.sum(F.col("n") - added), F.lit(0)).alias("met"))
    return out.select("added", (F.col("met") if mode == "skip" else F.lit(0)).cast("long").alias("skipped"), (F.col("met") if mode == "update" else F.lit(0)).cast("long").alias("updated"))


def column_widths(rows: DataFrame) -> DataFrame:
    """(header, width): the longest text of each column, within 10 and 60."""
    size = lambda c: F.least(F.greatest(F.coalesce(F.max(F.length(F.col(f"`{c}`").cast("string"))), F.lit(0)), F.lit(len(c)), F.lit(10)), F.lit(60))
    one = rows.agg(*(size(c).alias(c) for c in rows.columns))
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, rows.columns)), F.array(*(F.col(f"`{c}`") for c in rows.columns)))).alias("header", "width"))


def exportable(jobs: DataFrame, run_date: str) -> DataFrame:
    """Jobs without an error, with a date."""
    return jobs.where("coalesce(error, '') = ''").withColumn("date_applied", F.coalesce(F.nullif("date_applied", F.lit("")), F.lit(run_date)))


def pending(sheet: DataFrame, applications: DataFrame, states: tuple[str, ...] = ("", "pending"), link: str = "Job Link") -> DataFrame:
    """Rows of the input sheet that wait, and ``duplicate``: the link is in the applications or in an earlier waiting row.

    Links are compared as they are, without blanks around them.
    """
    value = F.trim(F.coalesce(F.col(f"`{link}`"), F.lit("")))
    rows = sheet.withColumn("link", value).where((value != "") & F.lower(F.trim(F.coalesce("`Process Status`", F.lit("")))).isin(*states))
    there = applications.select(F.trim("link").alias("link")).where("link <> ''").distinct().withColumn("there", F.lit(True))
    first = rows.groupBy("link").agg(F.min("row").alias("first_row"))
    known = first.join(there, "link", "left")
    return rows.join(known, "link").withColumn("duplicate", F.coalesce("there", F.lit(False)) | (F.col("row") > F.col("first_row"))).drop("there", "first_row")


def result_status(company: Column, title: Column, location: Column, error: Column) -> Column:
    """Error, Needs Manual Review or Done."""
    return first_of([(F.coalesce(error, F.lit("")) != "", "Error"), (needs_manual_review(company, title, location), "Needs Manual Review")], "Done")


def present_links(applications: DataFrame, links: DataFrame) -> DataFrame:
    """Links whose application is complete, whatever their case; rows without company or title count as absent."""
    bad = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))).isin("", "n/a", "error")
    whole = applications.where(~(bad("company") | bad("job_title"))).select(F.lower(F.trim("job_link")).alias("k"))
    return links.join(whole, F.lower(F.trim("link")) == F.col("k"), "left_semi")
