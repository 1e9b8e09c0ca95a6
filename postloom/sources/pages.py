"""Evidence of postings in web pages: an Arrow function reads marks, links and embedded records; fields are decided by columns.

The function only takes apart what a page states: its title, metas, marked elements,
links, text and embedded JSON.  What a posting's fields are is decided set-at-a-time
in ``postloom.operators.extraction``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style noscript svg template".split())
#: Attributes whose values say what an element holds; a mark has one to a line.
MARKS = ("data-qa", "data-testid", "data-test", "data-test-id", "data-automation-id", "data-company-name", "data-tracking-control-name", "data-view-name", "itemprop", "aria-label", "title", "class", "id")
MARKED = re.compile(r"(?i)title|job|company|employer|organization|location|salary|compensation|pay|posting|opening|workplace|eyebrow|topcard|top-card|flavor|headline|description|categor|criteria|preferences|show-more|remote|hybrid|on-?site|in-?office|content|sort-by")
#: Elements whose plain children are fields: everything below them is evidence.
HOLDERS = re.compile(r"(?i)posting-headline|posting-title|job__title|CompanyInfoContainer|companyHeader|JobInfoHeader-subtitle|posting-categories")
#: Elements that a label's value does not lie outside of.
REGIONS = frozenset("section aside article nav footer form dialog table".split())
#: Fields of an embedded record, and the keys that hold them.
RECORD = ("job_title", "company", "location", "salary_low", "salary_high", "salary_value", "salary_unit", "salary_currency", "description", "location_type", "skills")

EVIDENCE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("metas", T.MapType(T.StringType(), T.StringType())),
        T.StructField("marked", T.ArrayType(T.StructType([*(T.StructField(n, T.StringType()) for n in ("tag", "mark", "text")), T.StructField("at", T.IntegerType()), T.StructField("last", T.IntegerType())]))),
        T.StructField("lines", T.ArrayType(T.StructType([*(T.StructField(n, T.StringType()) for n in ("tag", "text")), T.StructField("at", T.IntegerType()), T.StructField("region", T.IntegerType())]))),
        T.StructField("links", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("href", "text", "rel")]))),
        T.StructField("record", T.StructType([T.StructField(n, T.StringType()) for n in RECORD])),
        T.StructField("flat", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("jobs", T.ArrayType(T.StringType())),
        T.StructField("text", T.StringType()),
    ]
)


def norm(text: object) -> str:
    return " ".join(str(text or "").split())


class Element(NamedTuple):
    """An open element: where its text begins, its attributes, its number, whether it holds fields and whether it is evidence."""

    tag: str
    first: int
    mark: str
    href: str
    at: int
    holds: bool
    marked: bool


class Reader(HTMLParser):
    """A page's title, metas, marked elements with their text, lines, links, scripts and visible text.

    Elements are numbered in the order in which they begin; an element's ``last`` is the
    number of the last one inside it, so that one lies below another if its number lies
    between that one's ``at`` and ``last``.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.open: list[Element] = []
        self.metas: dict[str, str] = {}
        self.marked: list[dict] = []
        self.lines: list[dict] = []
        self.links: list[dict[str, str]] = []
        self.scripts: list[tuple[str, str]] = []
        self.hidden = self.count = self.holders = 0
        self.regions = [0]
        self.script: list[str] | None = None
        self.kind = self.title = ""

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and (name := a.get("property") or a.get("name")) and a.get("content"):
            self.metas.setdefault(name.lower(), norm(a["content"]))
        if tag == "link" and "canonical" in a.get("rel", "").lower() and a.get("href"):
            self.links.append({"href": a["href"], "text": "", "rel": "canonical"})
        self.count += 1
        if tag == "img" and (alt := norm(a.get("alt"))) and self.open:
            self.parts.append(alt)
            self.lines.append({"tag": "img", "text": alt, "at": self.count, "region": self.regions[-1]})
        if tag in VOID:
            return
        told = [(k, norm(v)) for k in MARKS if (v := a.get(k))]
        mark, words = "\n".join(f"{k}={v}" for k, v in told), "\n".join(v for _, v in told)
        if tag in HIDDEN:
            self.hidden += 1
            self.kind, self.script = a.get("type", "").lower() + "#" + a.get("id", ""), [] if tag == "script" else self.script
        if tag in REGIONS:
            self.regions.append(self.count)
        holds = bool(HOLDERS.search(words))
        self.holders += holds
        marked = tag in ("h1", "h2", "main", "article") or self.holders > 0 or bool(MARKED.search(words)) or "data-company-name" in a
        self.open.append(Element(tag, len(self.parts), mark, a.get("href", ""), self.count, holds, marked))

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, max(-1, len(self.open) - 200), -1) if self.open[i][0] == tag), None)
        if at is not None:
            self.end(at)

    def end(self, at):
        """The open elements from the ``at``-th on are over."""
        for e in reversed(self.open[at:]):
            self.holders -= e.holds
            if e.tag in REGIONS:
                self.regions.pop()
            if e.tag in HIDDEN:
                self.hidden -= 1
                if e.tag == "script" and self.script is not None:
                    self.scripts.append((self.kind, "".join(self.script)))
                    self.script = None
            elif e.marked or e.tag in ("title", "a"):
                text = norm(" ".join(self.parts[e.first :]))
                if e.tag == "title":
                    self.title = self.title or text
                    del self.parts[e.first :]
                elif e.tag == "a" and e.href:
                    self.links.append({"href": e.href, "text": text, "rel": ""})
                if e.marked:
                    self.marked.append({"tag": e.tag, "mark": e.mark, "text": text, "at": e.at, "last": self.count})
        del self.open[at:]

    def close(self):
        super().close()
        self.end(0)
        self.marked.sort(key=lambda m: m["at"])

    def handle_data(self, data):
        if self.script is not None:
            self.script.append(data)
        elif not self.hidden and data.strip():
            self.parts.append(data)
            tag = self.open[-1].tag if self.open else ""
            if tag != "title":
                self.lines.append({"tag": tag, "text": norm(data), "at": self.open[-1].at if self.open else 0, "region": self.regions[-1]})


def loads(raw: str) -> object:
    try:
        return json.loads(raw.strip().rstrip(";"))
    except ValueError:
        return None


def posting_record(value: object) -> dict | None:
    """The first schema.org job posting inside a JSON value, in reading order."""
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, dict):
            kind = x.get("@type", "")
            kind = " ".join(map(str, kind)) if isinstance(kind, list) else str(kind)
            if kind.lower().replace(" ", "") in ("jobposting", "job"):
                return x
            inner = [x[k] for k in ("jobPosting", "job_posting") if isinstance(x.get(k), dict)]
            if inner:
                return inner[0]
            todo += [x[k] for k in ("hasPart", "mainEntity", "@graph") if k in x]
    return None


def plain(value: object) -> str:
    if isinstance(value, dict):
        return norm(value.get("name") or value.get("value") or value.get("@value"))
    if isinstance(value, list):
        return ", ".join(filter(None, map(plain, value)))
    return norm(value)


def place(value: object) -> str:
    if isinstance(value, list):
        return ", ".join(filter(None, map(place, value)))
    if not isinstance(value, dict):
        return plain(value)
    address = value.get("address")
    if isinstance(address, dict):
        country = plain(address.get("addressCountry"))
        us = re.sub("[^a-z]+", "-", country.lower()).strip("-") in ("en-us", "us", "usa", "united-states", "united-states-of-america")
        return ", ".join(filter(None, [plain(address.get("addressLocality")), plain(address.get("addressRegion")), "United States" if us else country]))
    return plain(address or value.get("name"))


def strip_markup(html: object) -> str:
    reader = Reader()
    reader.feed(str(html or ""))
    reader.close()
    return norm(" ".join(reader.parts))


def record_fields(item: dict | None) -> dict[str, str]:
    if not item:
        return dict.fromkeys(RECORD, "")
    pay = item.get("baseSalary") or item.get("salary") or {}
    pay = pay if isinstance(pay, dict) else {"value": str(pay)}
    value = pay.get("value") if isinstance(pay.get("value"), dict) else pay
    about = item.get("description") or item.get("responsibilities") or item.get("qualifications") or ""
    about = " ".join(map(plain, about)) if isinstance(about, list) else about
    skills = item.get("skills") or item.get("qualifications") or []
    return {
        "job_title": plain(item.get("title") or item.get("name")), "company": plain(item.get("hiringOrganization") or item.get("employer")), "location": place(item.get("jobLocation")),
        "salary_low": plain(value.get("minValue")), "salary_high": plain(value.get("maxValue")), "salary_value": plain(value.get("value")) if not isinstance(value.get("value"), dict) else "",
        "salary_unit": plain(value.get("unitText")), "salary_currency": plain(pay.get("currency")), "description": strip_markup(about), "location_type": plain(item.get("jobLocationType")),
        "skills": plain([s for s in skills if isinstance(s, str)] if isinstance(skills, list) else skills),
    }


def flatten(value: object) -> dict[str, list[str]]:
    """Leaf values by lower-cased key, in reading order."""
    out: dict[str, list[str]] = {}
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            for k, v in x.items():
                if isinstance(v, (str, int, float)) and v:
                    out.setdefault(str(k).lower(), []).append(norm(v))
            todo += [v for v in reversed(list(x.values())) if isinstance(v, (dict, list))]
        elif isinstance(x, list):
            todo += [v for v in reversed(x) if isinstance(v, (dict, list))]
    return out


def job_objects(value: object) -> list[dict]:
    """All objects, however deep, with a title and a content of a posting, in reading order."""
    out, todo = [], [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if x.get("jobTitle") and isinstance(x.get("jobPostingContent"), dict):
                out.append(x)
            todo += reversed(list(x.values()))
        elif isinstance(x, list):
            todo += reversed(x)
    return out


def read_page(html: str | None) -> dict:
    reader = Reader()
    reader.feed(html or "")
    reader.close()
    embedded = [x for kind, raw in reader.scripts if kind.startswith("application/ld+json") and (x := loads(raw)) is not None]
    record = next(filter(None, map(posting_record, embedded)), None) or next((x for x in embedded if isinstance(x, dict)), None)
    data = next((loads(raw) for kind, raw in reader.scripts if kind.endswith("#__NEXT_DATA__")), None)
    return {"title": reader.title, "metas": list(reader.metas.items()), "marked": reader.marked, "lines": reader.lines, "links": reader.links, "record": record_fields(record), "flat": list(flatten(data).items()), "jobs": [json.dumps(x) for x in job_objects(data)], "text": norm(" ".join(reader.parts))}


#: Bytes of the pages that come to a worker and that are taken apart at once: what is read of a page takes many times its text.
BATCH, PORTION = 8 << 20, 1 << 20


def portions(batch: pa.RecordBatch, html: int, most: int = PORTION, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """A batch cut into runs of at most ``rows`` rows whose texts in the column ``html`` have about ``most`` bytes, at least a row each."""
    first = held = 0
    for i, size in enumerate(pc.binary_length(batch.column(html)).to_pylist()):
        if i > first and (held + (size or 0) > most or i - first == rows):
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size or 0
    yield batch.slice(first)


def evidence(pages: DataFrame, keep: Sequence[str] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """keep..., and the evidence of each page: title, metas, marked, lines, links, record, flat, jobs, text.

    ``marked`` are headings, elements whose attributes speak of postings, and all below
    some of these, in page order, with the numbers of their first and last element;
    ``lines`` the runs of text with the element and the region that they stand in;
    ``record`` is the page's embedded job posting ('' for what it lacks), ``flat`` the leaves
    of its application data and ``jobs`` the objects in that which describe a posting, as
    JSON.  Null pages have empty evidence.  Batches of pages are bounded by bytes: a session
    setting, read when a job runs; a smaller one stays.
    """
    schema = T.StructType([*(pages.schema[c] for c in keep), *EVIDENCE.fields])

    def run(batches):
        arrow = None
        for batch in (part for whole in batches for part in portions(whole, len(keep))):
            found = [read_page(h) for h in batch.column(len(keep)).to_pylist()]
            if arrow is None:
                s, strings = pa.string(), lambda names: pa.struct([(n, pa.string()) for n in names])
                numbered = lambda texts, numbers: pa.list_(pa.struct([*((n, s) for n in texts), *((n, pa.int32()) for n in numbers)]))
                arrow = {"title": s, "metas": pa.map_(s, s), "marked": numbered(("tag", "mark", "text"), ("at", "last")), "lines": numbered(("tag", "text"), ("at", "region")), "links": pa.list_(strings(("href", "text", "rel"))), "record": strings(RECORD), "flat": pa.map_(s, pa.list_(s)), "jobs": pa.list_(s), "text": s}
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array([f[k] for f in found], t) for k, t in arrow.items())], schema.names)

    conf, key = pages.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    named = str(conf.get(key))
    if not (named.isdigit() and 0 < int(named) <= BATCH):
        conf.set(key, str(BATCH))
    return pages.select(*keep, html).mapInArrow(run, schema)
