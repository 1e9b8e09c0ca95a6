"""Cleaning of posting texts, titles and companies as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions.urls import lookup

# Character references that posting texts hold, and what they stand for.
REFERENCES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#34;": '"', "&apos;": "'", "&#39;": "'", "&#x27;": "'", "&ndash;": "–", "&mdash;": "—", "&rsquo;": "’", "&lsquo;": "‘", "&bull;": "•", "&middot;": "·", "&amp;": "&"}
# Words that are no company at all.
NO_COMPANY = ["none", "null", "n/a", "na", "job", "jobs", "app", "embed"]
# Companies by the names that postings use for them.
COMPANY_NAMES = {
    "jpmc": "JPMorgan Chase & Co.", "burberry": "Burberry", "burberrycareers": "Burberry", "fdmgroup": "FDM Group", "fdm group": "FDM Group", "loreal": "L'Oréal", "jetblue": "JetBlue",
    "jetblue airways corporation": "JetBlue", "le001 berkeley research group, llc": "BRG", "berkeley research group, llc": "BRG", "thinkbrg": "BRG", "twosigma": "Two Sigma", "two sigma": "Two Sigma",
    "ms": "Morgan Stanley", "morgan stanley": "Morgan Stanley", "pnc": "PNC", "bbva red exterior de oficinas": "BBVA", "ca cib americas": "Crédit Agricole CIB", "blackrock": "BlackRock",
    "alphasights": "AlphaSights", "nyulangone": "NYU Langone Health", "nyu langone": "NYU Langone Health", "nyu langone health": "NYU Langone Health", "le2201 newrez llc - corporate": "Newrez",
    "newrez llc - corporate": "Newrez", "newrez llc": "Newrez", "gaic great american insurance company": "Great American Insurance Group", "great american insurance company": "Great American Insurance Group",
}
# Words of links that are no part of a title.
NO_TITLE_WORDS = ["job", "jobs", "opening", "openings", "apply", "freelance", "clone"]
# Words of titles that are written in capitals.
ACRONYMS = ["AI", "ML", "HR", "IT", "QA", "QC", "SQL", "API", "CRM", "UX", "UI"]
# Words for where the work is done.
KINDS = ["remote", "hybrid", "on site", "in office", "in person"]


def phrases(*texts: str, join: str = r"[\s-]*") -> str:
    """A pattern of any of the phrases, the longest first; blanks in them stand for ``join``."""
    return "(?:" + "|".join(join.join(map(re.escape, x.split())) for x in sorted(texts, key=len, reverse=True)) + ")"


ARRANGEMENT = phrases(*KINDS, join=r"[-\s]?")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def steps(value: Column, *uses: Callable[[Column], Column]) -> Column:
    """Each step applied to the result of the one before, computed once."""
    for use in uses:
        value = bind(value, use)
    return value


def norm(c: Column) -> Column:
    """White space runs as one blank, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def dropped(c: Column, *patterns: str) -> Column:
    """What is left after each pattern's matches are taken out in turn."""
    for p in patterns:
        c = F.regexp_replace(c, p, "")
    return c


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, '' without one."""
    return F.regexp_extract(c, pattern, group)


def unescape(c: Column) -> Column:
    quoted = lambda x: "'" + x.replace("'", "\\'") + "'"
    pairs = F.expr("array(" + ", ".join(f"array({quoted(a)}, {quoted(b)})" for a, b in REFERENCES.items()) + ")")
    return F.reduce(pairs, c, lambda v, p: F.replace(v, p[0], p[1]))


def clean_value(c: Column) -> Column:
    """A field's value: references decoded, plain dashes, without its label and surrounding separators."""
    v = norm(unescape(F.coalesce(c, F.lit(""))))
    return F.btrim(dropped(F.translate(v, "–—", "--"), r"(?i)^(?:job title|title|company|location|salary|compensation)\s*[:\-]\s*"), F.lit(" |,-"))


def acronyms(c: Column) -> Column:
    """Acronyms of titles and employers in capitals again."""
    return reduce(lambda v, a: F.regexp_replace(v, rf"\b{a.title()}\b", a), ACRONYMS, c)


def title_case(c: Column) -> Column:
    """The first letter of every run of letters in upper case, all others in lower case."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def clean_company(c: Column) -> Column:
    """An employer's name without ratings, copyright marks, codes and the word Careers; '' if it is none."""
    named = lookup(COMPANY_NAMES)
    rating, year, rights, site = r"\s+\d.*$", r"^©\s*[0-9]{4}", r"(?i)\W*\ball rights reserved\b.*$", r"(?i)\scareers(?: site)?$"
    cut = lambda v: F.trim(dropped(v, rating, year, rights, site))

    def coded(v):
        """Without a first word of three to eight capitals and digits, both of them there."""
        first, rest = F.substring_index(v, " ", 1), F.trim(F.substr(v, F.length(F.substring_index(v, " ", 1)) + 1))
        code = (rest != "") & F.length(first).between(3, 8) & first.rlike("^[A-Z0-9]+$") & first.rlike("[A-Z]") & first.rlike("[0-9]")
        return F.when(code, rest).otherwise(v)

    known = lambda v: F.when(v.rlike(r"(?i)\b(?:MS\s+Smith\s+Barney|Morgan\s+Stanley)\b"), "Morgan Stanley").otherwise(F.coalesce(F.try_element_at(named, F.lower(v)), v))
    none = lambda v: F.lower(v).isin(NO_COMPANY) | ~v.rlike("[A-Za-z0-9]")
    return bind(clean_value(c), lambda v: F.when(none(v), "").otherwise(steps(v, cut, coded, known)))


def clean_title(c: Column, company: Column | None = None) -> Column:
    """A posting's title without board names, the employer and where the work is done."""
    v = dropped(clean_value(c), r"(?i)\s*\|\s*LinkedIn$", r"(?i)\s*[-|]\s*(?:Careers|Jobs|LinkedIn|Indeed).*$", r"(?i)\s+\bclone\b$")
    if company is not None:
        quoted = F.concat(F.lit(r"\Q"), F.replace(company, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))
        ends = (F.concat(F.lit("(?i)^"), quoted, F.lit(r"\s*[-|:]\s*")), F.concat(F.lit(r"(?i)\s*[-|]\s*"), quoted, F.lit(".*$")))
        v = bind(v, lambda t: F.when(F.coalesce(company, F.lit("")) == "", t).otherwise(F.regexp_replace(F.regexp_replace(t, ends[0], F.lit("")), ends[1], F.lit(""))))
    full = r"(?:(?:100%|Fully)\s+)?"
    v = dropped(v, r"(?i)\s+in\s+Remote\s*$", rf"(?i)\s*\(\s*{full}{ARRANGEMENT}\b[^)]*\)\s*$", rf"(?i)\s*[-|]\s*{full}{ARRANGEMENT}(?:\s*[-,:/]\s*[^|()]*)?\s*$")
    return F.trim(acronyms(v))


def first_filled(*values: Column) -> Column:
    """The first value that is not empty, else ''."""
    some = lambda v: F.try_element_at(F.filter(F.array(v), lambda x: x != ""), F.lit(1))  # noqa: E731  each value stands in the plan once
    return F.coalesce(*map(some, values), F.lit(""))


def company_from_page_title(c: Column) -> Column:
    """The employer in a page's title: "Job Application for ... at X", "... at X | ..."."""

    def read(t):
        parts = F.split(t, r"\s*\|\s*")
        head = F.element_at(parts, 1)
        named = bind(F.split(head, r"(?i)\s+at\s+"), lambda x: F.when(F.size(x) > 1, F.element_at(x, -1)).otherwise(""))
        return F.when(F.lower(t).startswith("job application for ") | (F.size(parts) > 1), clean_company(named)).otherwise("")

    return bind(clean_value(c), read)


def job_from_page_title(c: Column) -> Column:
    """The posting's title in a page's title: "X | ... Careers", "X Job Details | ..."."""
    return bind(clean_value(c), lambda t: clean_title(first_filled(found(t, r"(?i)^(.+?)\s*\|\s*.+?\s+Careers?$"), found(t, r"(?i)^(.+?)\s+Job Details\s*\|\s*.+$"))))


def company_from_text(c: Column) -> Column:
    """The employer that a page's text names after a label."""
    first = r"Direct message the job poster from\s+(.+?)(?=\s+[A-Z][a-z]+\s+[A-Z][a-z]+|\s+View|\s+Follow|\s+About|\s+Apply|$)"
    label = r"(?:Company|Employer)\s*[:\-]\s*(.+?)(?=\s+(?:Location|Job|Salary|Apply)|$)"
    return first_filled(*(clean_company(found(c, "(?i)" + p)) for p in (first, label, r"Apply for this job at\s+(.+?)(?=\s|$)")))


def after_label(c: Column, label: str, stops: list[str]) -> Column:
    """The text between a label and the first of the labels that may follow."""
    return norm(found(c, rf"(?i)\b{label}\s*:?\s*(.+?)(?=\s+(?:{'|'.join(stops)})\b|$)"))


def after_last_title(c: Column, title: Column) -> Column:
    """The text behind the last place where the title stands; '' if it stands nowhere."""
    at = F.length(c) - F.position(F.reverse(F.lower(title)), F.reverse(F.lower(c))) + 2  # where the text behind begins
    return F.when((title == "") | ~F.contains(F.lower(c), F.lower(title)), "").otherwise(F.trim(F.substr(c, at)))


def slug_name(c: Column) -> Column:
    """A name from a part of a link: words in title case, without careers, jobs, inc and llc at the end."""
    return clean_company(title_case(F.trim(F.regexp_replace(dropped(c, r"(?i)(?:careers|jobs|inc|llc)$"), r"[_\-]+", " "))))


def slug_title(c: Column) -> Column:
    """A title from a part of a link: without numbers, long hexadecimal ids and words such as job or apply."""
    whole = F.replace(F.replace(F.coalesce(F.try_url_decode(c), c, F.lit("")), F.lit("_"), F.lit("-")), F.lit("+"), F.lit("-"))
    ids = F.regexp_replace(F.lower(F.element_at(F.split(whole, "[-_]*~", 2), 1)), "--[-0-9a-f]{12,}$", "")  # what stands behind a tilde or a double dash names no title
    number = lambda w: w.rlike("^[0-9]+$") | (w.rlike("^[0-9a-f]+$") & (F.length(w) >= 8))
    words = F.filter(F.split(ids, r"[-/\s]+"), lambda w: (w != "") & ~w.isin(NO_TITLE_WORDS) & ~number(w))
    return clean_title(title_case(F.array_join(words, " ")))


def split_capture_title(c: Column) -> Column:
    """struct<title, company> of "X at Y" and "X - Y"; a place or work type behind the dash is no company."""
    at, dash = r"(?i)^(.+?)\s+at\s+(.+?)$", r"^(.+?)\s+-\s+(.+?)(?:\s+\|\s+.+)?$"

    def read(t):
        second = clean_value(found(t, dash, 2))
        company = t.rlike(dash) & ~second.rlike(r"(?i)\b[A-Z]{2}\b|Remote|Hybrid|On-site|Onsite")
        pair = lambda a, b: F.struct(a.alias("title"), b.alias("company"))
        return F.when(t.rlike(at), pair(clean_value(found(t, at, 1)), clean_value(found(t, at, 2)))).when(company, pair(clean_value(found(t, dash, 1)), second)).otherwise(pair(F.when(F.length(t) <= 120, t).otherwise(""), F.lit("")))

    return bind(dropped(clean_value(c), r"(?i)\s*\|\s*(?:Wellfound|Glassdoor|LinkedIn|Indeed|Dice\.com|ZipRecruiter).*$"), read)


def lines_of(c: Column) -> Column:
    """Lines of a captured text: cleaned, without noise, each once (ignoring case), in order."""
    raw = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|\r|\n"), clean_value), lambda x: (x != "") & (F.length(x) <= 180) & ~noise(x))
    return F.filter(raw, lambda x, i: F.array_position(F.transform(raw, F.lower), F.lower(x)) == i + 1)


# Lines of menus and dialogs.
NOISE_LINES = ["apply", "apply now", "save", "sign in", "log in", "login", "search", "jobs", "job search", "share this job", "back to jobs", "skip to main content", "privacy policy", "terms of use", "cookie policy"]
# Words of labels, by the field that they stand for; the first field with a word decides.
LABEL_WORDS = [
    ("work_type", ["pay type", "employment type", "job type", "project type"]),
    ("salary", ["salary", "compensation", "base pay", "pay range", "budget", "hourly", "fixed-price", "fixed price", "rate"]),
    ("work_type", ["work type", "workplace", "job location type", "remote", "hybrid"]),
    ("location", ["location", "office"]),
    ("company", ["company", "client", "employer", "organization"]),
    ("job_title", ["job title", "position title", "role title"]),
]
# Lines of a posting that are no employer.
NO_EMPLOYER_LINES = ["", "remote", "hybrid", "onsite", "on-site", "full-time", "part-time", "upwork", "linkedin", "indeed", "glassdoor", "ziprecruiter", "simplyhired", "dice", "monster", "wellfound", "actively hiring", "recently posted", "early stage", "growing fast", "founder", "recruiter", "hiring manager", "talent"]


def noise(c: Column) -> Column:
    """Lines that are menus, buttons or notices, or too long for a field."""
    return (F.length(c) > 180) | F.lower(c).isin(NOISE_LINES) | c.rlike(r"(?i)\b(?:cookie|privacy|terms|newsletter|download our app|recommended jobs)\b")


def field_of_label(c: Column) -> Column:
    """The posting's field that a label stands for, '' for none."""

    def rules(low):
        out = F.lit("")
        for name, words in reversed(LABEL_WORDS):
            out = F.when(low.rlike("|".join(words)), name).otherwise(out)
        return out

    return bind(F.lower(clean_value(c)), rules)


def value_after_label(value: Column, label: Column) -> Column:
    """What a labelled block says: the line behind the label, or the rest of the label's line, or its first part."""

    def read(x):
        lines, tag = x["lines"], F.lower(x["label"])
        hits = F.filter(F.transform(lines, lambda t, i: F.when(F.lower(t) == tag, F.try_element_at(lines, i + 2)).when(F.startswith(F.lower(t), tag), F.btrim(F.substr(t, F.length(tag) + 1), F.lit(" :-|")))), lambda t: F.coalesce(t, F.lit("")) != "")
        first = F.try_element_at(F.filter(F.transform(F.split(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")), r"[|;•·]"), lambda x: F.trim(x)), lambda t: t != ""), F.lit(1))
        return F.coalesce(F.when(tag != "", F.try_element_at(hits, F.lit(1))), first, F.lit(""))

    lines = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), r"[\r\n]+"), clean_value), lambda t: (t != "") & ~noise(t))
    return bind(F.struct(lines.alias("lines"), clean_value(label).alias("label")), read)


def employer_line(c: Column) -> Column:
    """Whether a line of a captured page may be an employer's name."""
    return (F.length(c) <= 80) & bind(F.lower(clean_value(c)), lambda low: ~low.isin(NO_EMPLOYER_LINES) & ~low.rlike(r"\$|\b(?:posted|apply|location|salary|full-time|part-time|contract|equity|employees|founded|jobs)\b"))


def employer_of_lines(lines: Column, title: Column) -> Column:
    """The employer in the lines of a captured page: behind its label, next to the title, or behind "About"."""
    named = r"(?i)^(?:company|employer|organization|hiring company)$"
    inline = r"(?i)\b(?:company|employer|organization|hiring company)\s*[:\-]\s*(.+)$"
    top = F.slice(lines, 1, 120)
    get = lambda i: F.coalesce(F.try_element_at(lines, i), F.lit(""))
    pick = lambda a: F.coalesce(F.try_element_at(F.filter(a, lambda t: (F.coalesce(t, F.lit("")) != "") & employer_line(t)), F.lit(1)), F.lit(""))
    behind = pick(F.transform(top, lambda t, i: F.when(t.rlike(named), get(i + 2)).otherwise(clean_value(found(t, inline)))))
    beside = pick(F.flatten(F.transform(F.slice(lines, 1, 40), lambda t, i: F.when((title != "") & (t == title), F.array(get(i + 2), F.when(i > 0, get(i)))).otherwise(F.array(F.lit(""))))))
    about = pick(F.array(clean_value(found(F.array_join(top, " "), r"(?i)\bAbout\s+([^|]{2,80})"))))
    return first_filled(behind, beside, about)


def unique_short(values: Column, most: int = 40, longest: int = 220) -> Column:
    """The first texts of a list that are not empty or too long, each once whatever its case, as it is first written."""
    texts = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), norm), lambda v: (v != "") & (F.length(v) <= longest))
    keyed = F.transform(texts, lambda v, i: F.struct(F.lower(v).alias("key"), v.alias("text"), i.alias("i")))
    keys = lambda all_of: F.transform(all_of, lambda x: x["key"])
    firsts = bind(keyed, lambda all_of: F.filter(all_of, lambda x: F.array_position(keys(all_of), x["key"]) == x["i"] + 1))
    return F.slice(F.transform(firsts, lambda x: x["text"]), 1, most)


def json_text(c: Column, key: str) -> Column:
    """The string behind the first place of a key in a JSON text, however deep, decoded; '' if there is none."""
    raw = found(F.coalesce(c, F.lit("")), rf'"{re.escape(key)}"\s*:\s*("(?:[^"\\]|\\.)*")')
    return F.coalesce(F.try_variant_get(F.try_parse_json(raw), "$", "string"), F.lit(""))
