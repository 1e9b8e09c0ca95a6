"""Rows that are approved or entered by hand, and the rows to try again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions import quality, urls

# What the fields are called that a row must have.
REQUIRED = {"company": "company", "job_title": "job title", "location": "location"}
NO_LINK = "Use a full link that starts with http:// or https://."


def lacking(suffix: str = "") -> Column:
    """"Add company, location first", or null if nothing is missing."""
    names = F.filter(F.array(*(F.when(F.coalesce(quality.missing(F.col(f)), F.lit(True)), label) for f, label in REQUIRED.items())), lambda x: x.isNotNull())
    return F.when(F.size(names) > 0, F.concat(F.lit("Add "), F.array_join(names, ", "), F.lit(f" first{suffix}")))


def _tracked(rows: DataFrame) -> DataFrame:
    c = F.col
    return rows.withColumns({"found_on": urls.found_on(c("job_link"), c("found_on"), c("source")), "application_portal": urls.application_portal(c("job_link"), F.coalesce(F.when(c("application_portal") != "", c("application_portal")), c("source")))})


def approved(rows: DataFrame, edited: str = "edited") -> DataFrame:
    """Rows after their owner approved the edited ones, and ``problem``.

    An approved row is by hand: without error, issues and notes, certain, with n/a for a
    missing work type or salary, and its sources told again.  Where a required field is
    missing it stays as it is and the problem says which; other rows stay as they are.
    """
    c = F.col
    problem = F.when(F.coalesce(c(edited), F.lit(False)), lacking())
    good = F.coalesce(c(edited), F.lit(False)) & problem.isNull()
    na = lambda f: F.when(F.coalesce(quality.missing(c(f)), F.lit(True)), "n/a").otherwise(c(f))
    told = _tracked(rows.withColumn("problem", problem).withColumn("good", good).withColumns({f"{f}_": c(f) for f in ("found_on", "application_portal")}))
    fields = {
        "work_type": na("work_type"), "salary": na("salary"), "error": F.lit(""), "review_issues": F.array().cast("array<string>"), "review_notes": F.lit(""), "manual": F.lit(True), "confidence": F.lit("Manual"), "confidence_score": F.lit(100),
    }
    now = {f: F.when(c("good"), v.cast(rows.schema[f].dataType)).otherwise(c(f)) for f, v in fields.items() if f in rows.columns}
    now |= {f: F.when(c("good"), c(f)).otherwise(c(f"{f}_")) for f in ("found_on", "application_portal")}
    return told.withColumns(now).select(*rows.columns, "problem")


def entered(forms: DataFrame) -> DataFrame:
    """Rows of forms (date_applied, company, job_title, job_link, location, work_type, salary, found_on, application_portal), and ``problem``.

    A link may be missing but must be http or https.  Texts are trimmed; a missing work type
    or salary is n/a.  Rows with a problem are not to be added; the others go through the
    choice on duplicates (``snapshots.apply_snapshots``) as items of their own.
    """
    c = F.col
    text = lambda f: F.trim(F.coalesce(c(f), F.lit("")))
    rows = forms.withColumns({**{f: text(f) for f in ("company", "job_title", "job_link", "location", "application_portal", "found_on")}, **{f: F.when(text(f) == "", "n/a").otherwise(text(f)) for f in ("work_type", "salary")}})
    rows = rows.withColumns({"status": F.lit("Applied"), "follow_up": F.lit(""), "source": F.lit(""), "confidence": F.lit("Manual"), "confidence_score": F.lit(100), "manual": F.lit(True)})
    bad = F.when((c("job_link") != "") & ~c("job_link").rlike("(?i)^https?://"), NO_LINK)
    return _tracked(rows.withColumn("problem", F.coalesce(lacking("."), bad))).drop("source")


def to_retry(rows: DataFrame) -> DataFrame:
    """Rows with a link that are not ready: those that trying all again tries."""
    c = F.col
    status = quality.client_status(c("error"), c("manual"), c("review_issues"), c("review_notes"), c("company"), c("job_title"), c("location"), c("work_type"))
    return rows.withColumn("list_status", status).where((c("list_status") != "ready") & (F.coalesce(c("job_link"), F.lit("")) != ""))
