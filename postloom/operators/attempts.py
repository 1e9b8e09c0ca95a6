"""One result for each link from its attempts, a fallback and what links of lists are told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions import quality, urls
from postloom.functions.urls import first_of

FIELDS = ("company", "job_title", "location", "work_type", "salary", "source")
REQUIRED = ("company", "job_title", "location")
# Errors after which a link is not tried again.
TERMINAL = ["http 404", "http 410", "unavailable", "no longer available", "expired", "redirected to a general careers page", "blocked automated access", "access denied", "captcha"]
# What a link to a list of postings is told.
LISTS = {
    "monster_search_page": ("A Monster search page contains many jobs. Open the employer's own posting and use that link instead.", "One row cannot hold a page full of Monster results. Use the employer's own job page instead."),
    "job_search_page": ("This link opens a list of jobs. Open one specific posting and paste that link instead.", "Each link must be one individual job posting."),
}
LISTED = "This link opened a job search page instead of the original posting."


def terminal(error: Column) -> Column:
    """Errors that another attempt would not change."""
    return F.lower(F.coalesce(error, F.lit(""))).rlike("|".join(rf"\Q{m}\E" for m in TERMINAL))


def decided(attempts: DataFrame, link: str = "url", order: str = "attempt", most: int = 2) -> DataFrame:
    """The attempt that counts for each link: the first without an error or with a terminal one, else the last.

    Attempts are numbered from 1; those above ``most`` are not made.  Of repeated numbers
    one counts, the least by its values.  What comes after the attempt that counts is as if
    it were not there.  Attempts are reduced where they lie, so many of one link are no large group.
    """
    row = F.struct(order, *(c for c in attempts.columns if c != order))
    ends = (F.coalesce(F.col("error"), F.lit("")) == "") | terminal(F.col("error"))
    made = attempts.where(F.col(order).between(1, most))
    by_number = made.groupBy(link, order).agg(F.min(row).alias("row"), F.min(F.when(ends, row)).alias("end"))
    return by_number.groupBy(link).agg(F.coalesce(F.min("end"), F.max("row")).alias("row")).select(*(F.col(f"row.`{c}`").alias(c) for c in attempts.columns))


def guided(links: DataFrame, link: str = "url") -> DataFrame:
    """Links to lists of postings, which are not tried: their row says what to do instead."""
    monster = urls.bare_host(F.col(link)).contains("monster.com")
    code = F.when(monster, "monster_search_page").otherwise("job_search_page")
    text = lambda k: first_of([(code == c, told[k]) for c, told in LISTS.items()], "")
    names = urls.lookup({k: name for _, k, name in urls.PLATFORMS})
    source = F.coalesce(F.try_element_at(names, urls.platform(F.col(link))), F.lit("Company Website"))
    rows = links.where(urls.is_search_page(F.col(link)))
    return rows.select(F.col(link), *(F.lit("n/a").alias(f) for f in FIELDS[:-1]), source.alias("source"), text(0).alias("error"), F.array(code).alias("review_issues"), text(1).alias("review_notes"))


def settled(attempts: DataFrame, fallbacks: DataFrame, link: str = "url", order: str = "attempt", most: int = 2) -> DataFrame:
    """A row per link: url, the fields as shown, error, review_issues, review_notes, found_on, application_portal.

    ``attempts`` (url, attempt, the fields, error) are what reading the page gave, in
    order; ``fallbacks`` (url and the fields) what a plain reading gives.  A link to a list is
    never tried.  The attempt that counts is shown as it is after a terminal error, or if it
    is whole; else each missing field comes from the fallback, and the error goes once a
    company or title is known.  Titles of lists empty the row.  Errors end in plain words.

    Null links are one link without a page.  A link's repeated fallbacks count once, the
    least.  Columns other than these are not read.  An empty table gives an empty table.
    """
    c = F.col
    known = attempts.select(F.coalesce(c(link), F.lit("")).alias("url"), c(order).alias("attempt"), *FIELDS, "error")
    asked = guided(known.select("url").distinct())
    one = decided(known.where(~F.coalesce(urls.is_search_page(c("url")), F.lit(False))), "url", "attempt", most)
    other = fallbacks.select(F.coalesce(c(link), F.lit("")).alias("of"), F.struct(*FIELDS).alias("fields")).groupBy("of").agg(F.min("fields").alias("other"))
    lacks = lambda *cols: F.coalesce(quality.missing(cols[0]), F.lit(True)) if len(cols) == 1 else lacks(cols[0]) | lacks(*cols[1:])
    error = F.coalesce(c("error"), F.lit(""))
    wants = ~terminal(error) & ((error != "") | lacks(*(c(f) for f in REQUIRED)))
    both = one.withColumn("wants", wants).join(other, (c("url") == c("of")) & c("wants"), "left")
    pick = {f: F.when(c("wants") & lacks(c(f)) & ~lacks(c(f"other.{f}")), c(f"other.{f}")).otherwise(c(f)) for f in FIELDS}
    merged = both.select("url", "wants", error.alias("error"), *(v.alias(f) for f, v in pick.items()))
    merged = merged.withColumn("error", F.when(c("wants") & ~(lacks(c("company")) & lacks(c("job_title"))), "").otherwise(c("error")))
    shown = merged.withColumns(quality.public_values(c("company"), c("job_title"), c("location"), c("work_type"), c("salary"), c("source"), c("error")))
    codes = lambda: quality.issues(c("company"), c("job_title"), c("location"), c("work_type"), c("url"), c("source"), c("error"))
    listed = F.array_contains(c("review_issues"), "job_search_page")
    shown = shown.withColumn("review_issues", codes()).withColumn("listed", listed)
    shown = shown.withColumns({**{f: F.when(c("listed"), "n/a").otherwise(c(f)) for f in FIELDS[:-1]}, "error": F.when(c("listed"), LISTED).otherwise(c("error"))})
    shown = shown.withColumn("review_issues", F.when(c("listed"), F.array_sort(F.array_union(codes(), F.array(F.lit("job_search_page"))))).otherwise(c("review_issues")))
    shown = shown.withColumn("review_notes", quality.review_notes(c("review_issues"))).withColumn("error", quality.friendly_error(c("error"), c("url")))
    rows = shown.select("url", *FIELDS, "error", "review_issues", "review_notes").unionByName(asked)
    return rows.withColumn("found_on", urls.found_on(c("url"), None, c("source"))).withColumn("application_portal", urls.application_portal(c("url"), c("source")))
