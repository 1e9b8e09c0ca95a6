"""Issue codes, reliability, confidence and status of postings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions.pay import SALARY, salary_display
from postloom.functions.places import clean_location, location_display
from postloom.functions.text import bind, clean_company, clean_value
from postloom.functions.urls import PLATFORMS, first_of, lookup, platform

# Words that are not an employer.
GENERIC_COMPANIES = ["early career", "careers", "jobs", "job", "app", "embed", "talent", "recruiting", "monster", "wellfound", "jooble", "naukri", "talents", "useparallel", "upwork", "linkedin", "indeed", "glassdoor", "ziprecruiter", "simplyhired", "dice"]
# Titles of blocked and list pages.
GENERIC_TITLES = ["access denied", "humans only", "www.ziprecruiter.com", "jooble.org", "digitalhire", "tal healthcare", "let's confirm you are human", "just a moment...", "job", "job details", "search jobs", "jobs", "sign up", "job search", "job not found", "position not found", "opportunity not found", "current openings", "all jobs", "are you still with us?", "work summary", "where intelligence works", "n/a", "na", "none"]
# What an issue takes from the score; any other takes 8.
PENALTIES = {"missing_company": 18, "missing_job_title": 22, "missing_location": 16, "generic_company": 16, "generic_job_title": 18, "job_search_page": 42, "company_looks_like_page_text": 18, "location_looks_like_page_text": 14, "location_looks_like_work_type": 14, "invalid_work_type": 10, "linkedin_work_type_hidden": 8, "captured_page_review": 8, "capture_low_confidence": 15, "unavailable_posting": 28, "scrape_error": 28, "monster_search_page": 35}
# Platforms whose data need a closer look.
OKAY = ["linkedin", "indeed", "glassdoor", "ziprecruiter", "simplyhired", "dice"]
LIMITED = ["monster", "wellfound", "upwork"]
NAMED_SOURCES = ["linkedin", "indeed", "glassdoor", "ziprecruiter", "monster", "wellfound", "upwork", "simplyhired", "dice", "greenhouse", "lever", "workday", "ashby", "icims", "breezy", "smartrecruiters", "dayforce"]
# How list pages, page texts and unavailable postings are worded.
LIST_TITLE = r"(?i)^\d[\d,]*\+?\s+.{2,120}\s+jobs?\s+in\s+.{2,120}$"
LIST_NAME = r"(?i)^(?:job search|search jobs|current openings(?: at .+)?|all jobs)$"
COMPANY_TEXT = r"(?i)\b(?:this position|company reserves|benefit programs|base salary|apply now|select how often)\b"
LOCATION_TEXT = r"(?i)\b(?:posted|time type|apply|salary|experience|job segment|view all jobs)\b"
UNAVAILABLE = "http 404|http 410|unavailable|no longer available|expired|general careers page"


def text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def missing(c: Column) -> Column:
    return F.lower(text(c)).isin("", "n/a", "none", "null")


def generic_title(c: Column) -> Column:
    return bind(F.lower(F.regexp_replace(text(c), "[–—]", "-")), lambda low: low.isin("", *GENERIC_TITLES) | low.rlike(LIST_TITLE) | low.rlike(r"^(?:www\.)?[\w-]+\.(?:com|org|net|ai|jobs)$"))


def issues(company: Column, title: Column, location: Column, work_type: Column, link: Column, source: Column, error: Column, confidence: Column | None = None) -> Column:
    """The sorted codes of what is wrong with a posting; ``confidence`` is the one it came with."""
    company, title, location, work_type = text(company), text(title), text(location), text(work_type)
    bare = lambda c: F.regexp_replace(F.lower(c), r"(?U)\W+", "")
    error = F.lower(F.coalesce(error, F.lit("")))
    rules = {
        "missing_company": missing(company),
        "missing_job_title": missing(title),
        "missing_location": missing(location),
        "location_looks_like_work_type": F.lower(location).isin("remote", "hybrid", "onsite", "on-site"),
        "generic_company": F.lower(company).isin(GENERIC_COMPANIES),
        "generic_job_title": ~missing(title) & (generic_title(title) | (~missing(company) & (bare(company) == bare(title)))),
        "job_search_page": F.regexp_replace(title, r"\s+", " ").rlike(LIST_TITLE) | title.rlike(LIST_NAME),
        "company_looks_like_page_text": (F.length(company) > 55) | company.rlike(COMPANY_TEXT),
        "location_looks_like_page_text": (F.length(location) > 70) | location.rlike(LOCATION_TEXT),
        "invalid_work_type": F.lower(work_type) == "mix",
        "linkedin_work_type_hidden": missing(work_type) & ((F.lower(text(source)) == "linkedin") | F.lower(text(link)).contains("linkedin.com/")),
        "low_confidence": F.lower(text(confidence)) == "low" if confidence is not None else F.lit(False),
        "unavailable_posting": (error != "") & error.rlike(UNAVAILABLE),
        "scrape_error": (error != "") & ~error.rlike(UNAVAILABLE),
    }
    return F.array_sort(F.filter(F.array(*(F.when(rule, code) for code, rule in rules.items())), lambda x: x.isNotNull()))


def reliability(link: Column, source: Column) -> Column:
    """Good, Okay or Limited by platform, or by source where the link is an employer's."""
    own = platform(F.coalesce(link, F.lit("")))
    key = F.regexp_replace(F.lower(F.coalesce(source, F.lit(""))), "[^a-z0-9]+", "")
    own = F.when((own == "company_website") & key.isin(NAMED_SOURCES), key).otherwise(own)
    return first_of([(own.isin(LIMITED), "Limited"), (own.isin(OKAY), "Okay")], "Good")


def confidence_score(codes: Column, level: Column, captured: Column | None = None) -> Column:
    start = F.lit(95) - F.when(level == "Limited", 18).when(level == "Okay", 8).otherwise(0)
    if captured is not None:
        start = start - F.when(captured, 8).otherwise(0)
    price = lookup(PENALTIES)
    total = F.aggregate(codes, start, lambda acc, code: acc - F.coalesce(F.try_element_at(price, code), F.lit(8)))
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def confidence(score: Column, error: Column) -> Column:
    return first_of([(F.coalesce(error, F.lit("")) != "", "Low"), (score >= 82, "High"), (score >= 58, "Medium")], "Low")


def history_status(supplied: Column, error: Column, codes: Column, manual: Column, notes: Column | None = None, confidence: Column | None = None) -> Column:
    """error, review, manual or ready; a supplied status counts last."""
    s = F.lower(text(supplied))
    by_hand = F.coalesce(manual, F.lit(False)) | (F.lower(text(confidence)) == "manual" if confidence is not None else F.lit(False))
    noted = F.coalesce(notes, F.lit("")) != "" if notes is not None else F.lit(False)
    return first_of([(F.coalesce(error, F.lit("")) != "", "error"), ((s == "review") | (F.coalesce(F.size(codes), F.lit(0)) > 0) | noted, "review"), (by_hand, "manual"), (s.isin("ready", "review", "error", "manual"), s)], "ready")


def default_work_type(work_type: Column, company: Column, title: Column, location: Column, error: Column) -> Column:
    """A complete posting without work type is Onsite; an incomplete or failed one n/a."""
    none = lambda c: F.lower(text(c)).isin("", "n/a", "na", "none", "null")
    return first_of([(~none(work_type), text(work_type)), (F.coalesce(error, F.lit("")) != "", "n/a"), (none(company) | none(title) | none(location), "n/a")], "Onsite")


# Note, label, field and action of each issue.
GUIDANCE = {
    "missing_company": ("Company is missing.", "Company missing", "Company", "Open the posting and fill in the employer name."),
    "missing_job_title": ("Job title is missing.", "Job title missing", "Job title", "Open the posting and fill in the role title."),
    "missing_location": ("Location is missing.", "Location missing", "Location", "Fill in the location if the posting shows one."),
    "location_looks_like_work_type": ("Location may be a work type instead of a place.", "Location looks wrong", "Location", "Move Remote/Hybrid/Onsite to Work Type and enter the actual place if listed."),
    "generic_company": ("Company name looks too generic.", "Company too generic", "Company", "Replace the job-board name with the real employer."),
    "generic_job_title": ("Job title looks like a blocked or generic page.", "Title too generic", "Job title", "Replace blocked-page text with the real role title."),
    "job_search_page": ("This link opened a list of jobs instead of one posting.", "Job list link", "Link", "Open one specific job posting and paste that link instead."),
    "company_looks_like_page_text": ("Company may be copied from page text.", "Company has extra text", "Company", "Keep only the employer name."),
    "location_looks_like_page_text": ("Location may include extra page text.", "Location has extra text", "Location", "Keep only the city/state/country."),
    "invalid_work_type": ("Work type should be Remote, Hybrid, Onsite, or n/a.", "Work type invalid", "Work Type", "Use Remote, Hybrid, Onsite, or n/a."),
    "linkedin_work_type_hidden": ("LinkedIn hid the work type from its public page.", "Work type hidden", "Work Type", "Open the signed-in LinkedIn posting and use browser capture to read the visible tag."),
    "unavailable_posting": ("The posting is unavailable or has expired.", "Posting unavailable", "Link", "Remove this row or replace the link with an active posting."),
    "scrape_error": ("The page could not be read.", "Page could not be read", "Link", "Retry, use browser capture, or fix the fields yourself and choose the checkmark."),
    "captured_page_review": ("The browser capture may include extra site text.", "Check this browser capture", "Captured row", "Remove any menu, button, or footer text that slipped into the fields."),
    "capture_low_confidence": ("The capture did not have clear labels for these fields.", "Capture needs a closer look", "Captured row", "Choose one of the suggestions or type the correct value."),
    "monster_search_page": ("Monster search pages show many jobs at once. Use the employer/company link from Monster instead.", "Monster unsupported", "Link", "Use the employer/company job page that Monster opens."),
    "low_confidence": ("This row is not certain.", "Needs a closer look", "Row", "Check this row before saving it."),
}
# Texts of pages that are blocked, and of postings that are gone.
BLOCKED_PAGE = ["access denied", "humans only", "verify you are human", "captcha", "confirm you are human", "verify you are a human", "blocked automated access", "enable javascript", "internet explorer 11 is no longer supported", "please log in", "sign in to view", "just a moment...", "checking your browser", "please enable cookies"]
GONE_PAGE = ["job not found", "position not found", "opportunity not found", "this job is no longer available", "the job you are looking for is no longer available", "this position is no longer available", "this posting is no longer available", "this position has been filled", "job posting has expired", "this vacancy has now expired", "vacancy has expired", "job you are trying to apply for is currently unavailable", "job you are trying to view is currently unavailable", "this job is currently unavailable"]
# Words that are no title, and no company.
NO_TITLE = ["sign in", "sign up", "apply now", "search jobs", "job details", "careers", "privacy", "current openings"]
NO_EMPLOYER = ["careers", "jobs", "job search", "apply", "privacy", "cookies", "all departments"]
EMPLOYER_TEXT = ["select how often", "benefit programs", "company reserves", "this position", "base salary"]
GENERIC_EMPLOYERS = ["", "n/a", "none", "job", "jobs", "app", "embed", "careers", "monster", "wellfound", "jooble", "naukri", "talents", "useparallel", "ziprecruiter", "all departments"]


def _any(c: Column, words: list[str]) -> Column:
    return c.rlike("|".join(r"\Q" + w + r"\E" for w in words))


def page_error(c: Column) -> Column:
    """What a page's text says instead of a posting: that it is gone, or blocked; '' if neither."""
    return bind(F.lower(F.coalesce(c, F.lit(""))), lambda low: first_of([(_any(low, GONE_PAGE), "This job posting is no longer available."), (_any(low, BLOCKED_PAGE), "Website blocked automated access to this posting.")], ""))


def generic_employer(c: Column) -> Column:
    """Empty names, and boards in place of an employer."""
    return F.lower(clean_company(c)).isin(GENERIC_EMPLOYERS)


def acceptable(field: str, c: Column) -> Column:
    """Whether a text can stand in a field: company, job_title, location or salary."""

    def check(v):
        low = F.lower(v)
        if field == "salary":
            return (v != "") & (v.rlike(SALARY) | v.contains("$"))
        short = (v != "") & (F.length(v) <= 140)
        if field == "job_title":
            return short & ~generic_title(v) & ~_any(low, NO_TITLE) & (low != "jobs") & ~low.endswith(" jobs")
        if field == "company":
            return short & ~low.isin(NO_EMPLOYER) & ~_any(low, EMPLOYER_TEXT) & ~F.lower(clean_company(v)).isin("careers", "jobs", "job search", "apply")
        return short & (clean_location(v) != "")

    return bind(clean_value(c), check)


def review_notes(codes: Column) -> Column:
    """One sentence an issue."""
    notes = lookup({k: v[0] for k, v in GUIDANCE.items()})
    return F.array_join(F.transform(codes, lambda c: F.coalesce(F.try_element_at(notes, c), F.replace(c, F.lit("_"), F.lit(" ")))), " ")


def review_details(codes: Column) -> Column:
    """array<struct<code, label, field, action>>, one an issue."""
    part = lambda k: lookup({code: v[k] for code, v in GUIDANCE.items()})
    get = lambda k, c, other: F.coalesce(F.try_element_at(part(k), c), other)
    return F.transform(codes, lambda c: F.struct(c.alias("code"), get(1, c, F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))).alias("label"), get(2, c, F.lit("Row")).alias("field"), get(3, c, F.lit("Review this row.")).alias("action")))


def capture_issues(company: Column, title: Column, location: Column, evidence: Column) -> Column:
    """Of a captured page: required fields read from running text, and required fields without any evidence (map<field, source>)."""
    source = lambda f: F.try_element_at(evidence, F.lit(f))
    noisy, bare = F.lit(False), F.lit(False)
    for name, value in (("company", company), ("job_title", title), ("location", location)):
        noisy = noisy | (~missing(value) & F.coalesce(source(name).isin("text", "meta", "page_title", "html"), F.lit(False)))
        bare = bare | source(name).isNull()
    return F.filter(F.array(F.when(bare, "capture_low_confidence"), F.when(noisy, "captured_page_review")), lambda x: x.isNotNull())


# What makes a listed row look copied from a page.
KINDS_AS_PLACE = ["remote", "hybrid", "onsite", "on-site"]
NO_COMPANY_NAMES = ["early career", "careers", "jobs", "talent", "recruiting"]
COMPANY_MARKS = ["this position", "company reserves", "benefit programs", "base salary", "apply now", "select how often"]
PLACE_MARKS = ["posted", "time type", "apply", "salary", "experience", "job segment", "view all jobs"]


def suspicious(company: Column, location: Column, work_type: Column) -> Column:
    """Work types as places, no real company, long texts and words of pages."""
    who, where = F.lower(text(company)), F.lower(text(location))
    return where.isin(KINDS_AS_PLACE) | who.isin(NO_COMPANY_NAMES) | (F.length(who) > 55) | _any(who, COMPANY_MARKS) | (F.length(F.coalesce(location, F.lit(""))) > 70) | _any(where, PLACE_MARKS) | (F.lower(text(work_type)) == "mix")


def client_status(error: Column, manual: Column, codes: Column, notes: Column, company: Column, title: Column, location: Column, work_type: Column) -> Column:
    """The status that a list shows: error, ready if whole and by hand, review where anything is noted, missing or looks wrong."""
    lacks = missing(company) | missing(title) | missing(location)
    noted = (F.coalesce(F.size(codes), F.lit(0)) > 0) | (F.coalesce(notes, F.lit("")) != "")
    return first_of([(F.coalesce(error, F.lit("")) != "", "error"), (F.coalesce(manual, F.lit(False)) & ~lacks, "ready"), (noted | lacks | suspicious(company, location, work_type), "review")], "ready")


def needs_manual_review(company: Column, title: Column, location: Column) -> Column:
    bare = lambda c: F.lower(text(c)).isin("", "n/a")
    return bare(company) | bare(title) | bare(location)


def public_values(company: Column, title: Column, location: Column, work_type: Column, salary: Column, source: Column, error: Column) -> dict[str, Column]:
    """What a posting shows: places and salaries as displayed, and defaults for what is missing."""
    or_default = lambda c, d: F.when(F.coalesce(c, F.lit("")) == "", d).otherwise(c)
    return {
        "company": or_default(company, "n/a"),
        "job_title": or_default(title, "n/a"),
        "location": or_default(location_display(location), "n/a"),
        "work_type": default_work_type(work_type, company, title, location, error),
        "salary": or_default(salary_display(salary), "n/a"),
        "source": or_default(source, "Company Website"),
    }


# What failures mean to a reader, by the first mark that the error holds.
FRIENDLY = [
    (["job search page", "list of jobs", "job list link"], "This link opens a list of jobs. Open one specific posting and paste that link instead."),
    (["browser runtime unavailable"], "The browser could not be started."),
    (["http 404", "http 410", "unavailable", "no longer available", "expired", "general careers page"], "This posting is unavailable or has expired."),
    (["blocked automated access", "access denied", "captcha"], "The website blocked automated access. Open the job page yourself, then use browser capture."),
    (["timeout", "timed out"], "The website took too long to respond. Try this job again."),
    (["http 403", "http 429"], "The website blocked automated access. Open the job page yourself, then use browser capture."),
    (["cannot navigate to invalid url"], "The job link is not a valid web address."),
]


def friendly_error(c: Column, link: Column | None = None) -> Column:
    """A failure in plain words; '' without one."""
    low = F.lower(text(c))
    monster = F.lower(F.coalesce(link, F.lit(""))).rlike(r"^https?://[^/?#]*monster\.com") if link is not None else F.lit(False)
    return first_of([(low == "", ""), (monster, "Monster blocks reliable access. Open the employer's own job page from Monster and use that link instead."), *((_any(low, marks), message) for marks, message in FRIENDLY)], "This posting could not be read. Try again or check the link yourself.")


# What is worth knowing about data from a platform.
PLATFORM_NOTES = {
    "greenhouse": "usually provides clean job data.", "lever": "usually provides clean job data.", "ashby": "usually provides clean job data.", "workday": "usually provides useful job data, although some pages load slowly.",
    "icims": "usually works once the job frame is read.", "breezy": "usually makes the job details easy to read.", "smartrecruiters": "usually provides clean job data.", "dayforce": "usually provides clean structured job data.",
    "linkedin": "may hide work type and salary from its public page. A signed-in browser capture can read visible tags.", "indeed": "often works, but locations can pick up extra words.", "glassdoor": "often works, but some pages block reading.",
    "ziprecruiter": "can work, but reposts may include extra page text.", "simplyhired": "can redirect or hide some details.", "dice": "can work, but some pages block reading.", "monster": "Use the employer career page that Monster opens instead.",
    "wellfound": "often blocks reading, and captures still need a close look.", "upwork": "often blocks reading and does not use standard job-posting fields.",
}


def reliability_note(link: Column, source: Column) -> Column:
    """A sentence on the platform's data."""
    own = platform(F.coalesce(link, F.lit("")))
    key = F.regexp_replace(F.lower(F.coalesce(source, F.lit(""))), "[^a-z0-9]+", "")
    labels = {k: name for _, k, name in PLATFORMS}
    notes = {k: n if k == "monster" else f"{labels[k]} {n}" for k, n in PLATFORM_NOTES.items()}
    names = lookup(notes)
    return F.coalesce(F.try_element_at(names, F.when((own == "company_website") & key.isin(NAMED_SOURCES), key).otherwise(own)), F.lit("The company career page is usually the best source."))
