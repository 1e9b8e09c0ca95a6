"""Posting fields from page evidence: candidates in order of precedence, decided by columns.

Every step is a column of its own, so Catalyst computes shared values once and prunes
what a query does not ask for; no step shuffles.
"""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions import hints, pay, places, quality, urls, work
from postloom.functions import text as t
from postloom.functions.text import bind, first_filled
from postloom.functions.urls import first_of
from postloom.operators import sites
from postloom.sources.pages import EVIDENCE

# Elements that hold a field, by precedence: tags ('' for any), a pattern of attributes (one to a line), and one of an element around them.
SELECTORS = {
    "job_title": [("", "(?m)^(?:data-qa|data-testid|data-test)=job-title$", ""), ("", "(?m)^itemprop=title$", ""), ("h2", "(?m)^data-automation-id=jobPostingHeader$", ""), ("h1", "(?im)^class=.*(?:title|job)", ""), ("h2", "", r"(?m)^class=(?:.* )?posting-(?:headline|title)(?: |$)"), ("h2", r"(?m)^class=(?:.* )?app-title(?: |$)", ""), ("", r"(?m)^class=(?:.* )?(?:opening__title|job-title|app-title)(?: |$)", ""), ("h1", "", "")],
    "company": [("", "(?m)^(?:data-qa|data-testid)=company$", ""), ("", "(?m)^itemprop=hiringOrganization$", ""), ("", "(?m)^data-testid=inlineHeader-companyName$", ""), ("", "(?m)^data-company-name=", ""), ("", "(?im)^data-testid=.*company", ""), ("a", "(?m)^data-tracking-control-name=public_jobs_topcard-org-name$", ""), ("", r"(?m)^class=(?:.* )?(?:topcard__org-name-link|top-card-layout__company-name|jobs-unified-top-card__company-name|job-details-jobs-unified-top-card__company-name)(?: |$)", ""), ("a", "", r"(?m)^class=(?:.* )?(?:jobsearch-CompanyInfoContainer|jobsearch-InlineCompanyRating-companyHeader)(?: |$)"), ("", "(?im)^class=.*(?:company-name|employer)", ""), ("", r"(?m)^class=(?:.* )?(?:posting-company|jobsearch-InlineCompanyRating-companyHeader)(?: |$)", "")],
    "location": [("", "(?m)^(?:data-qa|data-testid)=(?:job-)?location$", ""), ("", r"(?m)^class=(?:.* )?location(?: |$)", r"(?m)^class=(?:.* )?posting-categories(?: |$)"), ("", "(?m)^itemprop=jobLocation$", ""), ("", "(?m)^data-testid=(?:inlineHeader-companyLocation|jobsearch-JobInfoHeader-companyLocation)$", ""), ("", "(?m)^data-automation-id=(?:locations|jobPostingLocation)$", ""), ("p", "(?im)^class=.*content__eyebrow", ""), ("", "(?im)^class=.*(?:job-location|job__location)", ""), ("", r"(?m)^class=(?:.* )?(?:posting-categories|sort-by-location|topcard__flavor--bullet)(?: |$)", ""), ("div", "", r"(?m)^class=(?:.* )?jobsearch-JobInfoHeader-subtitle(?: |$)"), ("", r"(?im)^class=(?:.* )?location(?: |$)", "")],
    "salary": [("", "(?im)^(?:data-qa|data-testid)=.*salary", ""), ("", "(?m)^itemprop=baseSalary$", ""), ("", "(?im)^class=.*salary", ""), ("", "(?im)^class=.*compensation", ""), ("", "(?im)^class=.*pay", "")],
    "description": [("", "(?m)^(?:data-qa|data-testid)=job-description$", ""), ("", "(?m)^itemprop=description$", ""), ("", "(?m)^data-automation-id=jobPostingDescription$", ""), ("", "(?m)^id=(?:jobDescriptionText|content)$", ""), ("", r"(?m)^class=(?:.* )?(?:job-description|job__description|posting-requirements|description|content)(?: |$)", ""), ("article", "", ""), ("main", "", "")],
}
# Keys of application data that hold a field, by precedence.
FLAT_KEYS = {"job_title": ["title", "jobtitle", "job_title", "name"], "company": ["company", "companyname", "organization"], "location": ["location", "joblocation", "city"], "work_type": ["workplacetype", "joblocationtype", "formattedlocationtype", "workarrangement"], "salary": ["salary", "compensation", "pay"], "description": ["description", "jobdescription"]}
# What links to an employer's own posting say: apply there, its site, or elsewhere.
WHOSE = ["company", "employer", "external", "the company", "the employer", "the external"]
ELSEWHERE = ["company site", "company website", "employer site", "employer website", "apply externally", "external apply", "view on company"]
APPLY_LINK = rf"(?i)\b(?:apply\s+{t.phrases('on', 'at', 'with')}\s+{t.phrases(*WHOSE, join=chr(92) + 's+')}|{t.phrases(*ELSEWHERE, join=chr(92) + 's+')})\b"

# Postings of one board whose shown text leaves out a field.
SIGNATURES = [{"company": "atc", "job_title": "data analyst", "location": "new york, united states", "description_markers": ["american technology consulting (atc) is a service-first tech company", "as an entry-level data analyst at atc"], "fields": {"work_type": "Onsite"}}]
# Postings of that board by their numbers, and what is known of them.
KNOWN_WORK = {"4418909784": "Hybrid", "4443868424": "Hybrid"}
GONE = "This job posting is no longer available."

FIELDS = ("company", "job_title", "location", "work_type", "salary")
#: The columns of evidence and their types.
PAGE = {f.name: f.dataType.simpleString() for f in EVIDENCE.fields}


def selected(marked: Column, selectors: list[tuple[str, str, str]]) -> Column:
    """array<struct<rank, at, text>>: the elements that selectors (tag, pattern, pattern of an element around it) match, in page order.

    One element lies below another if its number is between that one's and its last's.
    """
    around = sorted({a for _, _, a in selectors if a})
    marked_by = lambda pattern: F.filter(marked, lambda h: h["mark"].rlike(pattern))
    holders = [marked_by(a) for a in around]

    def rank(m):
        def fits(tag, pattern, below):
            tests = [m["tag"] == tag] if tag else []
            tests += [m["mark"].rlike(pattern)] if pattern else []
            tests += [F.exists(holders[around.index(below)], lambda h: (h["at"] < m["at"]) & (m["at"] <= h["last"]))] if below else []
            return reduce(Column.__and__, tests)

        return first_of([(fits(*s), F.lit(k)) for k, s in enumerate(selectors)], F.lit(None).cast("int"))

    ranked = F.transform(marked, lambda m: F.struct(rank(m).alias("rank"), m["at"].alias("at"), m["text"].alias("text")))
    return F.filter(ranked, lambda m: m["rank"].isNotNull())


def description(marked: Column) -> Column:
    """The first text of a described element that says enough, by precedence, then page order."""
    ranked = F.array_sort(selected(marked, SELECTORS["description"]))
    return F.coalesce(F.try_element_at(F.filter(ranked, lambda m: F.length(m["text"]) > 120), F.lit(1))["text"], F.lit(""))


def stated(field: str, marked: Column, *values: Column) -> Column:
    """The first text that can stand in the field: of the given values, then of marked elements by precedence and page order."""
    texts = F.transform(F.array_sort(selected(marked, SELECTORS[field])), lambda m: F.struct(m["text"].alias("text"), F.lit(True).alias("marked")))
    each = F.concat(F.array(*(F.struct(v.alias("text"), F.lit(False).alias("marked")) for v in values)), texts)
    if field == "location":
        read = F.transform(each, lambda x: F.struct(places.clean_location(x["text"]).alias("place"), t.clean_value(x["text"]).alias("value"), x["marked"].alias("marked")))
        one = F.try_element_at(F.filter(read, lambda x: x["place"] != ""), F.lit(1))
        return F.coalesce(F.when(one["marked"], one["place"]).otherwise(one["value"]), F.lit(""))
    clean = lambda x: F.when(x["marked"], t.clean_company(x["text"])).otherwise(t.clean_value(x["text"])) if field == "company" else t.clean_value(x["text"])
    return F.coalesce(F.try_element_at(F.filter(F.transform(each, clean), lambda v: quality.acceptable(field, v)), F.lit(1)), F.lit(""))


def flat_text(field: str, flat: Column) -> Column:
    """The first value of the field's keys, else of keys that contain one."""
    keys = FLAT_KEYS[field]
    fits = lambda a: F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda v: F.length(v).between(2, 5000))
    exact = F.concat(*(fits(F.try_element_at(flat, F.lit(k))) for k in keys))
    near = F.flatten(F.map_values(F.map_filter(flat, lambda k, v: k.rlike("|".join(keys)))))
    return first_filled(F.coalesce(F.try_element_at(exact, F.lit(1)), F.lit("")), F.coalesce(F.try_element_at(fits(near), F.lit(1)), F.lit("")))


def preferred_link(links: Column, url: Column) -> Column:
    """The first link off the boards whose text says that it leads to the employer's own posting; none on employers' pages."""
    there = F.transform(F.filter(links, lambda x: x["text"].rlike(APPLY_LINK)), lambda x: hints.resolve(url, x["href"]))
    on_board = lambda h: first_of([(urls.within(h, b), F.lit(True)) for b in (*hints.BOARD_HOSTS, "google.com")], F.lit(False))
    good = F.filter(there, lambda x: x.rlike(r"^https?://[^/?#]+") & (urls.bare_host(x) != urls.bare_host(url)) & ~on_board(urls.bare_host(x)))
    return F.when(urls.platform(url) == "company_website", "").otherwise(F.coalesce(F.try_element_at(good, F.lit(1)), F.lit("")))


def posting_link(links: Column, url: Column) -> Column:
    """Where a page says that its posting is: the canonical link if it is another, else the first link of jobs."""
    other = lambda x: (x != "") & (F.rtrim(x, F.lit("/")) != F.rtrim(url, F.lit("/")))
    canonical = F.filter(F.transform(F.filter(links, lambda x: x["rel"] == "canonical"), lambda x: hints.resolve(url, x["href"])), other)
    jobs = F.filter(F.transform(F.filter(links, lambda x: (x["rel"] == "") & hints.is_job_href(x["href"])), lambda x: hints.resolve(url, x["href"])), other)
    return F.coalesce(F.try_element_at(canonical, F.lit(1)), F.try_element_at(jobs, F.lit(1)), F.lit(""))


def meta(metas: Column, *names: str) -> Column:
    return F.coalesce(*(F.try_element_at(metas, F.lit(n)) for n in names), F.lit(""))


@lru_cache(maxsize=1)
def decisions(application: str) -> tuple[list[dict[str, Column]], list[Column]]:
    """The steps that decide a posting's fields, each columns by name, and the result's columns.

    They name columns only, so they are made once for all tables of an application.
    """
    c, no = F.col, F.lit("")
    steps: list[dict[str, Column]] = []
    record = lambda k: F.coalesce(c(f"record.{k}"), no)
    first = lambda values: F.coalesce(F.try_element_at(F.filter(values, lambda v: v != ""), F.lit(1)), no)
    many = lambda *names: {n: F.coalesce(c(n), F.array().cast(PAGE[n])) for n in names}
    steps.append({"board": urls.platform(c("url")), "host": urls.bare_host(c("url")), "link_place": places.from_link(c("url")), **many("marked", "lines", "jobs")})
    steps.append({"hint": hints.link_hints(c("url"), c("board"), c("link_place"))})
    paid = pay.structured_salary(record("salary_low"), record("salary_high"), record("salary_value"), record("salary_unit"), record("salary_currency"))
    steps.append({
        "found_title": stated("job_title", c("marked"), t.dropped(record("job_title"), r"(?i)\s*\|\s*LinkedIn$"), flat_text("job_title", c("flat"))),
        "found_company": stated("company", c("marked"), record("company"), flat_text("company", c("flat"))),
        "found_location": stated("location", c("marked"), record("location"), flat_text("location", c("flat"))),
        "found_salary": stated("salary", c("marked"), paid, flat_text("salary", c("flat"))),
        "found_work": first_filled(work.location_type(record("location_type")), flat_text("work_type", c("flat"))),
        "about": first_filled(record("description"), flat_text("description", c("flat")), description(c("marked")), F.when(F.length("text") > 120, F.substring("text", 1, 4000)).otherwise("")),
        "meta_title": meta(c("metas"), "job-title", "pagetitle", "og:title", "twitter:title", "title"),
        "meta_about": meta(c("metas"), "og:description", "twitter:description"),
        "title_job": t.job_from_page_title(c("title")),
        "headings": F.transform(F.filter(c("marked"), lambda m: m["tag"] == "h1"), lambda m: m["text"]),
        "linkedin": c("board") == "linkedin",
    })
    site_name = meta(c("metas"), "og:site_name")
    steps.append({
        "title_company": t.company_from_page_title(first_filled(c("title"), c("meta_title"))),
        "found_title": first_of([((c("title_job") != "") & ~quality.generic_title(c("title_job")), c("title_job")), ((c("meta_title") != "") & quality.generic_title(c("found_title")), c("meta_title"))], c("found_title")),
        "error": quality.page_error(F.concat_ws(" ", "meta_title", "title", F.substring("text", 1, 3000))),
        "any_title": first_filled(c("title"), c("meta_title")),
    })
    on = lambda host: urls.within(c("host"), host)
    site = first_of(
        [
            (on("dayforcehcm.com"), sites.dayforce(c("jobs"), c("url"))),
            (c("error") != "", sites.fields()),
            (c("board") == "ziprecruiter", sites.ziprecruiter(c("title"), c("meta_title"), c("found_title"), c("text"))),
            (on("simplyhired.com"), sites.simplyhired(c("any_title"), c("found_title"), c("text"))),
            (on("breezy.hr"), sites.breezy(c("any_title"), c("headings"), c("text"))),
        ],
        sites.fields(),
    )
    steps.append({
        "site": site,
        "gone": c("error") == GONE,
        "found_company": first_of([((c("title_company") != "") & quality.generic_employer(c("found_company")), c("title_company")), ((c("found_company") == "") & (c("board") == "company_website") & quality.acceptable("company", site_name), site_name)], c("found_company")),
        "linkedin_about": F.when(c("linkedin"), sites.linkedin_about(c("marked"), selected)).otherwise(no),
        "criteria": F.when(c("linkedin"), sites.linkedin_criteria(c("marked"))).otherwise(no),
        "words": F.concat_ws(" ", "about", "meta_about", "text"),
    })
    steps.append({f"found_{k}": first_filled(pay.extract_salary(c("site.salary")) if k == "salary" else c(f"site.{f}"), c(f"found_{k}")) for k, f in (("title", "job_title"), ("company", "company"), ("location", "location"), ("salary", "salary"), ("work", "work_type"))})
    # one board's salaries stand in its own description or salary elements, all others' in the words of the page
    paying = F.when(c("linkedin"), F.concat(F.array("linkedin_about"), F.transform(F.array_sort(selected(c("marked"), SELECTORS["salary"])), lambda m: m["text"]))).otherwise(F.array("words"))
    label_text = F.when(c("linkedin"), F.concat_ws(" ", "criteria", F.substring("text", 1, 12000))).otherwise(c("text"))
    loose_text = F.when(c("linkedin"), c("criteria")).otherwise(F.concat_ws(" ", "found_location", first_filled(c("about"), c("text"))))
    labels = F.transform(sites.labelled_work_types(c("marked"), c("lines"), selected), work.normalize_work_type)
    # places that stand in labels, lists and the text are cleaned together, then taken apart again
    none = F.array().cast("array<string>")
    raw = {"label": sites.labelled_places(c("lines")), "text": places.location_hits(c("text")), "list": F.when(on("amazon.jobs"), places.listed_hits(c("text"))).otherwise(none), "country": F.when(on("tal.net"), F.array(places.countries_hit(c("text")))).otherwise(none)}
    tagged = F.concat(*(F.transform(v, lambda x: F.struct(F.lit(k).alias("kind"), x.alias("place"))) for k, v in raw.items()))
    spots = lambda kind, most, by: places.first_places(F.transform(F.filter("spots", lambda x: x["kind"] == kind), lambda x: x["place"]), most, by)
    vendor = F.when(c("board") == "workday", places.workday_location(c("words"))).when(on("taleo.net"), places.taleo_location(c("text"))).otherwise("")
    steps.append({
        "pays": F.transform(paying, pay.salary_evidence),
        "header_pay": F.when(c("board") == "wellfound", pay.header_salary(c("text"))).otherwise(""),
        "vendor": vendor,
        "spots": F.transform(tagged, lambda x: F.struct(x["kind"].alias("kind"), places.clean_location(x["place"]).alias("place"))),
        "own": hints.own_company(c("url")),
        "link_company": hints.company_from_link(c("url"), c("board")),
        "work_label": F.when(c("linkedin"), "").otherwise(first_filled(first(labels), work.strong_label(c("text")), work.statement(c("about")))),
        "chips": F.when(c("linkedin"), first(F.transform(sites.linkedin_chips(c("marked")), work.extract_work_type))).otherwise(no),
        "weak": F.struct(work.labelled(label_text).alias("label"), work.extract_work_type(loose_text).alias("words")),
    })
    loose = F.when(c("linkedin"), first_filled(c("chips"), c("weak.words"), c("weak.label"), sites.described_work(c("linkedin_about")))).otherwise(first_filled(c("weak.label"), c("weak.words")))
    told = F.try_element_at(F.filter("pays", lambda p: first_filled(p["base"], p["best"]) != ""), F.lit(1))
    steps.append({
        "found_work": first_of([(c("found_work") == "n/a", F.when(c("linkedin"), loose).otherwise(no)), (c("work_label") != "", c("work_label")), (work.normalize_work_type(c("found_work")) != "", c("found_work"))], loose),
        "paid": F.coalesce(told, F.try_element_at("pays", F.lit(1))),
        "labelled_place": spots("label", 1, ""),
        "vendor": first_filled(c("vendor"), spots("country", 1, ""), spots("list", 3, "; ")),
    })
    # base pay, a more complete salary of the text, what was found, any; the vendor's place, what was found, the link's, the text's
    best = first_filled(c("header_pay"), c("paid.base"), c("paid.best"))
    better = (first_filled(c("header_pay"), c("paid.base")) != "") | pay.more_complete(best, c("found_salary"), c("board") == "wellfound")
    only_type = F.lower("found_location").isin("remote", "hybrid", "onsite", "on-site") & (c("link_place") != "")
    steps.append({
        "found_salary": F.when(c("linkedin"), best).otherwise(first_filled(F.when(better, best).otherwise(""), c("found_salary"), best, c("paid.any"))),
        "found_location": first_filled(c("vendor"), F.when(only_type, c("link_place")).otherwise(c("found_location")), c("link_place"), spots("text", 2, ", "), c("hint.location")),
        "company_": F.when(c("own") != "", c("own")).otherwise(bind(first_filled(t.clean_company(first_filled(c("found_company"), t.company_from_text(c("text")), c("link_company"))), c("link_company")), lambda v: F.when(quality.generic_employer(v), first_filled(c("hint.company"), c("title_company"), v)).otherwise(v))),
    })
    types = ("remote", "hybrid", "onsite", "on-site")
    seen = (c("labelled_place") != "") & (~F.lower("labelled_place").isin(*types) | (c("found_location") == ""))
    steps.append({
        "title_": bind(t.clean_title(c("found_title"), c("company_")), lambda v: F.when(quality.generic_title(v) & (c("hint.job_title") != ""), c("hint.job_title")).otherwise(v)),
        "found_salary": bind(pay.extract_salary(c("found_salary")), lambda s: F.when((s != "") | c("linkedin"), s).otherwise(pay.labelled_range(c("words"), c("found_location")))),
        "near": F.when(places.is_broad(c("found_location")), places.near_title(c("text"), c("found_title"))).otherwise(""),
    })
    steps.append({"location_": places.without_title(F.when(seen, c("labelled_place")).otherwise(first_filled(c("near"), c("found_location"))), c("title_")), "ending": places.from_title(c("title_"))})
    ends = (c("location_") == "") & (c("ending.location") != "")
    steps.append({"title_": F.when(ends, t.clean_title(c("ending.title"), c("company_"))).otherwise(c("title_")), "location_": F.when(ends, c("ending.location")).otherwise(c("location_"))})
    there = lambda v: F.when(c("gone"), "").otherwise(v)
    signed = reduce(lambda v, x: F.when(signature(x), x["fields"]["work_type"]).otherwise(v), SIGNATURES, F.coalesce(F.try_element_at(urls.lookup(KNOWN_WORK), hints.linkedin_id(c("url"))), c("found_work")))
    label_of = urls.lookup({k: name for _, k, name in urls.PLATFORMS})
    out = [
        F.when(c("gone"), c("own")).otherwise(c("company_")).alias("company"), there(c("title_")).alias("job_title"), there(c("location_")).alias("location"), there(work.normalize_work_type(signed)).alias("work_type"),
        there(c("found_salary")).alias("salary"), F.coalesce(F.try_element_at(label_of, c("board")), F.lit("Company Website")).alias("source"), there(preferred_link(c("links"), c("url"))).alias("preferred_job_link"), c("error"),
    ]
    return steps, out


def signature(known: dict) -> Column:
    """Whether a posting is one whose shown text leaves out what is known of it."""
    same = (F.lower("company_") == known["company"]) & (F.lower("title_") == known["job_title"]) & (F.lower("location_") == known["location"])
    return reduce(Column.__and__, (F.contains(F.lower("about"), F.lit(m)) for m in known["description_markers"]), F.col("linkedin") & same)


def extract_postings(pages: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep..., url and company, job_title, location, work_type, salary, source, preferred_job_link, error of each page.

    ``pages`` is ``sources.pages.evidence``.  Precedence: the embedded record, application
    data, marked elements, metas and the page's title, a board's own layout, labels and
    sentences of the text, then the link.  Pages of postings that are gone give their error
    and, on own hosts, the employer; blocked pages give what was read and their error.  ''
    is missing.

    Null links and null pages have no evidence.  Repeated rows each give a row; columns
    other than the evidence and ``keep`` are not read, so clashing names do no harm.  An
    empty table gives an empty table.
    """
    steps, out = decisions(pages.sparkSession.sparkContext.applicationId)
    rows = pages.select(*(F.col(k).alias(f"kept_{i}") for i, k in enumerate(keep)), F.coalesce(F.col(url), F.lit("")).alias("url"), *PAGE)
    for step in steps:
        rows = rows.withColumns(step)
    return rows.select(*(F.col(f"kept_{i}").alias(k) for i, k in enumerate(keep)), "url", *out)


def public_postings(postings: DataFrame) -> DataFrame:
    """Postings as shown: displayed places and salaries, defaults for what is missing, found_on and application_portal."""
    c = F.col
    shown = quality.public_values(c("company"), c("job_title"), c("location"), c("work_type"), c("salary"), c("source"), c("error"))
    out = postings.withColumns(shown)
    return out.withColumn("found_on", urls.found_on(c("url"), None, c("source"))).withColumn("application_portal", urls.application_portal(c("url"), c("source")))


def annotate(postings: DataFrame, link: str = "url", captured: Column | None = None) -> DataFrame:
    """Adds review_issues, review_notes, review_details, reliability, confidence_score and confidence."""
    c = F.col
    codes = quality.issues(c("company"), c("job_title"), c("location"), c("work_type"), c(link), c("source"), c("error"))
    if captured is not None:
        codes = F.array_sort(F.array_union(codes, captured))
    out = postings.withColumn("review_issues", codes)
    out = out.withColumns({"review_notes": quality.review_notes(c("review_issues")), "review_details": quality.review_details(c("review_issues")), "reliability": quality.reliability(c(link), c("source")), "reliability_note": quality.reliability_note(c(link), c("source"))})
    out = out.withColumn("confidence_score", quality.confidence_score(c("review_issues"), c("reliability"), F.lit(captured is not None)))
    return out.withColumn("confidence", quality.confidence(c("confidence_score"), c("error")))


def merge_results(primary: DataFrame, fallback: DataFrame, key: str = "url", fields: tuple[str, ...] = ("company", "job_title", "location", "work_type", "salary", "source")) -> DataFrame:
    """Primary rows with each missing field taken from the fallback of the same key; errors stay the primary's."""
    other = fallback.select(F.col(key).alias("of"), *(F.col(f).alias(f"other_{f}") for f in fields))
    joined = primary.join(other, F.col(key) == F.col("of"), "left")
    pick = lambda f: F.when(quality.missing(F.col(f)) & ~quality.missing(F.col(f"other_{f}")), F.col(f"other_{f}")).otherwise(F.col(f))
    return joined.withColumns({f: pick(f) for f in fields}).drop("of", *(f"other_{f}" for f in fields))


def through_posting_links(pages: DataFrame, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """Evidence of pages that point to the posting's own page, replaced by that page's evidence where the table has it.

    Of several pages with one link the one with the smallest page_id counts.  Pages that
    point nowhere, to themselves or to a page that is not there keep their own; they are
    not shuffled.  Null links are no page's own and are pointed to by none.  Repeated
    rows each give a row.  An empty table gives an empty table.
    """
    body = [c for c in pages.columns if c not in (page_id, url)]
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("page"), urls.url_key(posting_link(F.col("links"), F.coalesce(F.col(url), F.lit("")))).alias("to"), F.coalesce(urls.url_key(F.col(url)), F.lit("")).alias("at"))
    points = F.coalesce((F.col("to") != "") & (F.col("to") != F.col("at")), F.lit(False))
    there = rows.where("at <> ''").groupBy("at").agg(F.min_by("page", f"page.{page_id}").alias("other")).select(F.col("at").alias("of"), "other")
    hops = rows.where(points).join(there, F.col("to") == F.col("of"), "left")
    moved = hops.select(*(F.when(F.col("of").isNotNull(), F.col(f"other.`{c}`")).otherwise(F.col(f"page.`{c}`")).alias(c) if c in body else F.col(f"page.`{c}`").alias(c) for c in pages.columns))
    return rows.where(~points).select("page.*").unionByName(moved)
