"""Postings from applicant systems' payloads: JSON with explicit schemas, read by columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions import hints, pay, places, work
from postloom.functions import text as t
from postloom.functions.text import bind, first_filled

GREENHOUSE = "company_name string, title string, location struct<name: string>, content string"
WORKDAY = "jobPostingInfo struct<title: string, location: string, remoteType: string, jobDescription: string, jobRequisitionLocation: struct<descriptor: string, country: struct<descriptor: string>>>, hiringOrganization struct<name: string>"
ORACLE = "items array<struct<Title: string, PrimaryLocation: string, WorkplaceType: string, WorkplaceTypeCode: string, ExternalDescriptionStr: string, OrganizationDescriptionStr: string, CorporateDescriptionStr: string, requisitionFlexFields: array<struct<Prompt: string, Value: string>>>>"
SMARTRECRUITERS = "name string, company struct<name: string>, location struct<fullLocation: string, city: string, region: string, country: string, remote: boolean, hybrid: boolean>, jobAd struct<sections: map<string, struct<text: string>>>"
OUT = ("company", "job_title", "location", "work_type", "salary", "source")


def plain(c: Column) -> Column:
    """The text of markup that may be written in references."""
    return t.norm(t.unescape(F.regexp_replace(t.unescape(F.coalesce(c, F.lit(""))), r"(?s)<[^>]*>", " ")))


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def greenhouse(rows: DataFrame, url: str = "url", payload: str = "payload") -> DataFrame:
    """Rows with the posting's fields; those without a location are left out."""
    p, c = F.col("p"), F.col
    board = _or_empty(F.try_element_at(hints.segments(c(url)), F.lit(1)))
    out = rows.withColumn("p", F.from_json(payload, GREENHOUSE)).withColumn("words", plain(p["content"]))
    out = out.withColumn("company", t.dropped(bind(t.clean_company(p["company_name"]), lambda v: F.when(v != "", v).otherwise(hints.slug_name(board))), r"(?i)\s+Internships?$"))
    out = out.withColumn("location", places.clean_location(p["location"]["name"]))
    out = out.withColumns({"job_title": t.clean_title(p["title"], c("company")), "work_type": work.extract_work_type(F.concat_ws(" ", "location", p["title"], "words")), "salary": pay.extract_salary(c("words")), "source": F.lit("Greenhouse")})
    return out.where("location <> ''").drop("p", "words", payload)


def workday(rows: DataFrame, url: str = "url", payload: str = "payload") -> DataFrame:
    """Rows with the posting's fields; those without title or location are left out."""
    i, c = F.col("p.jobPostingInfo"), F.col
    out = rows.withColumn("p", F.from_json(payload, WORKDAY)).withColumn("words", plain(i["jobDescription"]))
    wanted = F.concat_ws(", ", F.nullif(t.clean_value(i["jobRequisitionLocation"]["descriptor"]), F.lit("")), F.nullif(t.clean_value(i["jobRequisitionLocation"]["country"]["descriptor"]), F.lit("")))
    out = out.withColumns({
        "company": t.clean_company(c("p.hiringOrganization.name")), "job_title": t.clean_title(i["title"]), "location": bind(places.clean_location(i["location"]), lambda v: F.when(v != "", v).otherwise(places.clean_location(wanted))),
        "work_type": first_filled(work.normalize_work_type(i["remoteType"]), work.statement(c("words")), work.labelled(c("words"))), "salary": pay.contextual_salary(c("words")), "source": F.lit("Workday"),
    })
    return out.where("job_title <> '' and location <> ''").drop("p", "words", payload)


def oracle(rows: DataFrame, url: str = "url", payload: str = "payload") -> DataFrame:
    """Rows with the first item's fields; pay is read from flexible fields that speak of it, then from the descriptions."""
    i, c = F.col("i"), F.col
    out = rows.withColumn("i", F.try_element_at(F.from_json(payload, ORACLE)["items"], F.lit(1)))
    paid = F.filter(F.coalesce(i["requisitionFlexFields"], F.array()), lambda f: F.lower(t.clean_value(f["Prompt"])).rlike("salary|pay|compensation|wage|rate"))
    flex = F.filter(F.transform(paid, lambda f: first_filled(pay.contextual_salary(f["Value"]), pay.extract_salary(f["Value"]))), lambda s: s != "")
    about = plain(F.concat_ws(" ", i["ExternalDescriptionStr"], i["OrganizationDescriptionStr"], i["CorporateDescriptionStr"]))
    out = out.withColumns({
        "company": first_filled(hints.own_company(c(url)), hints.company_from_link(c(url))), "job_title": t.clean_title(i["Title"]), "location": places.clean_location(i["PrimaryLocation"]),
        "work_type": work.normalize_work_type(first_filled(_or_empty(i["WorkplaceType"]), _or_empty(i["WorkplaceTypeCode"]))), "salary": first_filled(_or_empty(F.try_element_at(flex, F.lit(1))), pay.contextual_salary(about)), "source": F.lit("Company Website"),
    })
    return out.where("job_title <> '' and location <> ''").drop("i", payload)


def smartrecruiters(rows: DataFrame, url: str = "url", payload: str = "payload") -> DataFrame:
    p, c = F.col("p"), F.col
    out = rows.withColumn("p", F.from_json(payload, SMARTRECRUITERS)).withColumn("words", plain(F.array_join(F.transform(F.map_values(F.col("p.jobAd.sections")), lambda s: F.coalesce(s["text"], F.lit(""))), " ")))
    where = p["location"]
    out = out.withColumn("company", t.clean_company(F.coalesce(p["company"]["name"], F.try_element_at(hints.segments(c(url)), F.lit(1)))))
    out = out.withColumns({
        "job_title": t.clean_title(p["name"], c("company")), "location": places.clean_location(F.coalesce(where["fullLocation"], F.concat_ws(", ", where["city"], where["region"], where["country"]))),
        "work_type": F.when(where["hybrid"], "Hybrid").when(where["remote"], "Remote").otherwise(work.extract_work_type(c("words"))), "salary": first_filled(pay.contextual_salary(c("words")), pay.extract_salary(c("words"))), "source": F.lit("SmartRecruiters"),
    })
    return out.drop("p", "words", payload)


def icims(rows: DataFrame, text: str = "text") -> DataFrame:
    """Fields of a frame's visible text, by its labels."""
    c, stops = F.col(text), ["Job Locations?", "Position Type", "Category", "Overview", "Responsibilities", "Qualifications", "Pay Range", "Remote", "ID", "Title"]
    place = F.regexp_replace(t.after_label(c, "Job Locations?", stops), r"^US-([A-Z]{2})-(.+)$", "$2, $1")
    return rows.withColumns({"company": t.clean_company(t.found(c, r"(?i)\bAbout\s+(?:the\s+)?([A-Z][A-Za-z&.' ]{2,60}?)(?=\s+(?:is|was|are|has)\b)")), "location": places.clean_location(place), "work_type": first_filled(work.strong_label(c), work.labelled(c), work.extract_work_type(c)), "salary": first_filled(pay.contextual_salary(c), pay.extract_salary(c))})
