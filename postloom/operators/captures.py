"""Postings from pages captured in a browser: candidates by source, merged field by field with their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions import hints, pay, places, quality, urls, work
from postloom.functions import text as t
from postloom.functions.text import bind, first_filled
from postloom.operators.extraction import annotate, meta

FIELDS = ("company", "job_title", "location", "work_type", "salary")


def captured_place(c: Column) -> Column:
    """A city and state, a state's name beside a word of places, or the United States."""
    names = "|".join(n.title() for n in places.STATES)
    city = rf"\b({places.CITY}),\s*({places.ABBR})\b"
    return F.when(c.rlike(city), F.concat(t.found(c, city, 1), F.lit(", "), t.found(c, city, 2))).when(c.rlike(rf"(?i)\b(?:{names})\b") & c.rlike(r"(?i)\b(?:location|remote|state|usa|united states|based in)\b"), t.found(c, rf"(?i)\b({names})\b")).when(c.rlike(r"(?i)\bUnited States\b"), "United States").otherwise("")


def clean_field(field: str, c: Column) -> Column:
    """A candidate as it may stand in the field, '' if it may not."""
    v = t.clean_value(c)
    if field == "company":
        return bind(v, lambda x: bind(t.clean_company(x), lambda n: F.when((captured_place(x) == "") & quality.acceptable("company", n) & t.employer_line(n), n).otherwise("")))
    if field == "job_title":
        return bind(t.clean_title(c), lambda x: F.when(quality.acceptable("job_title", x), x).otherwise(""))
    if field == "location":
        return bind(v, lambda x: bind(first_filled(places.clean_location(x), captured_place(x)), lambda p: F.when(F.lower(p).isin("remote", "hybrid", "onsite", "on-site"), "").otherwise(p)))
    if field == "work_type":
        return work.captured_work_type(v)
    return bind(first_filled(pay.contextual_salary(v), pay.extract_salary(v)), lambda s: pay.with_equity(v, s))


def _cleaned(field: str, candidates: Column) -> Column:
    """Candidates (v, source) that may stand in the field, cleaned."""
    return F.filter(F.transform(candidates, lambda x: F.struct(clean_field(field, x["v"]).alias("v"), x["source"].alias("source"))), lambda x: x["v"] != "")


def first_title(lines: Column) -> Column:
    """The first line that may be a title: no heading of a section, place or salary."""
    section = r"(?i)\b(?:job details|description|about|requirements|qualifications|benefits|company|search)\b"
    good = F.filter(F.slice(lines, 1, 30), lambda x: F.length(x).between(4, 120) & ~x.rlike(section) & (captured_place(x) == "") & (pay.extract_salary(x) == ""))
    return F.coalesce(F.try_element_at(good, F.lit(1)), F.lit(""))


def extract_captures(captures: DataFrame, keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """keep..., company, job_title, location, work_type, salary, evidence (map<field, source>), field_options, and the annotations.

    ``captures`` is ``sources.captures.read_captures`` with the evidence columns of
    ``sources.pages.evidence`` over its html.  A field is the first acceptable candidate of:
    the page's tags, its embedded record, the link, labelled values and headings, the
    page's title, metas, and lines of text; evidence names the source that gave it.
    """
    c, no = F.col, F.lit("")
    rows = captures.withColumn("lines", t.lines_of(c("page_text"))).withColumn("hint", hints.link_hints(c("url"))).withColumn("named", t.split_capture_title(first_filled(t.clean_value(c("page_title")), meta(c("metas"), "og:title", "twitter:title", "title"), c("title"))))
    empty = F.array().cast("array<string>")
    tags, heads, keys = (F.coalesce(c(f"candidates.{x}"), empty) for x in ("workTypeTags", "headings", "keywordLines"))
    pairs = F.transform(F.coalesce(c("candidates.labelPairs"), F.array().cast("array<struct<label: string, value: string>>")), lambda p: F.struct(t.field_of_label(p["label"]).alias("field"), t.value_after_label(p["value"], p["label"]).alias("value")))
    rows = rows.withColumns({"tags": tags, "split": F.transform(heads, t.split_capture_title), "pairs": pairs, "keywords": keys, "blocks": F.transform(F.coalesce(c("candidates.headerBlocks"), empty), t.lines_of)})
    rows = rows.withColumn("rich", F.concat_ws(" ", F.array_join(F.map_values("metas"), " "), F.array_join("keywords", " "), F.array_join("lines", " "), "text"))
    record = lambda k: F.coalesce(c(f"record.{k}"), no)
    of_pairs = lambda f: F.transform(F.filter("pairs", lambda p: p["field"] == f), lambda p: p["value"])
    heading = lambda k: F.transform("split", lambda s: s[k])
    block_text = F.transform("blocks", lambda b: F.array_join(b, " "))
    structured = {"company": record("company"), "job_title": record("job_title"), "location": record("location"), "work_type": work.location_type(record("location_type")), "salary": pay.structured_salary(record("salary_low"), record("salary_high"), record("salary_value"), record("salary_unit"), record("salary_currency"))}
    labels = {
        "company": F.concat(heading("company"), F.array(c("named.company")), of_pairs("company"), F.transform("blocks", lambda b: t.employer_of_lines(b, first_title(b)))),
        "job_title": F.concat(heading("title"), F.array(c("named.title")), of_pairs("job_title"), F.transform("blocks", first_title)),
        "location": F.concat(of_pairs("location"), F.transform(block_text, captured_place), F.transform("keywords", captured_place)),
        "work_type": F.concat(c("tags"), of_pairs("work_type"), block_text, F.array(F.array_join("keywords", " "))),
        "salary": F.concat(of_pairs("salary"), block_text, F.array(F.array_join("keywords", " "))),
    }
    from_text = {"company": t.employer_of_lines(c("lines"), c("named.title")), "job_title": first_title(c("lines")), "location": F.coalesce(F.try_element_at(F.filter(F.transform(F.concat("lines", F.array("rich")), captured_place), lambda v: v != ""), F.lit(1)), no), "work_type": work.captured_work_type(work.extract_work_type(c("rich")), c("url")), "salary": c("rich")}
    metas = {"company": meta(c("metas"), "og:site_name"), "job_title": meta(c("metas"), "og:title", "twitter:title", "title")}
    source = lambda name, values: F.transform(values, lambda v: F.struct(v.alias("v"), F.lit(name).alias("source")))
    out = rows
    for f in FIELDS:
        many = [source("page_tag", c("tags"))] if f == "work_type" else []
        many += [source("structured", F.array(structured[f]))]
        many += [source("url", F.array(c(f"hint.{f}")))] if f in ("company", "job_title", "location") else []
        many += [source("page_label", labels[f])]
        many += [source("page_title", F.array(c("named.title" if f == "job_title" else "named.company")))] if f in ("company", "job_title") else []
        many += [source("meta", F.array(metas[f]))] if f in metas else []
        many += [source("text", F.array(from_text[f]))]
        out = out.withColumn(f"all_{f}", _cleaned(f, F.concat(*many)))
    out = out.select(
        *keep,
        *(F.coalesce(F.try_element_at(c(f"all_{f}"), F.lit(1))["v"], no).alias(f) for f in FIELDS),
        F.map_filter(F.map_from_arrays(F.array(*map(F.lit, FIELDS)), F.array(*(F.try_element_at(c(f"all_{f}"), F.lit(1))["source"] for f in FIELDS))), lambda k, v: v.isNotNull()).alias("evidence"),
        F.map_from_arrays(F.array(*map(F.lit, FIELDS)), F.array(*(F.slice(F.array_distinct(F.transform(F.filter(c(f"all_{f}"), lambda x: x["source"] == "page_label"), lambda x: x["v"])), 1, 6) for f in FIELDS))).alias("field_options"),
    )
    label_of = urls.lookup({k: name for _, k, name in urls.PLATFORMS})
    out = out.withColumn("source", F.coalesce(F.try_element_at(label_of, urls.platform(c("url"))), F.lit("Company Website"))).withColumn("error", no)
    return annotate(out, "url", quality.capture_issues(c("company"), c("job_title"), c("location"), c("evidence")))
