"""URL identity and source tracking as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that do not identify a posting.
TRACKING = ["from", "gh_src", "ref", "refid", "source", "src", "trackingid", "trk"]
# Hosts that are never public.
BLOCKED_HOSTS = ["localhost", "metadata", "metadata.google.internal", "instance-data"]
# Job boards and applicant systems, in order of precedence, and their labels.
PLATFORMS = [
    ("linkedin.com", "linkedin", "LinkedIn"), ("indeed.com", "indeed", "Indeed"), ("glassdoor.com", "glassdoor", "Glassdoor"), ("ziprecruiter.com", "ziprecruiter", "ZipRecruiter"),
    ("monster.com", "monster", "Monster"), ("wellfound.com", "wellfound", "Wellfound"), ("upwork.com", "upwork", "Upwork"), ("simplyhired.com", "simplyhired", "SimplyHired"),
    ("dice.com", "dice", "Dice"), ("greenhouse.io", "greenhouse", "Greenhouse"), ("greenhouse.com", "greenhouse", "Greenhouse"), ("lever.co", "lever", "Lever"),
    ("myworkdayjobs.com", "workday", "Workday"), ("ashbyhq.com", "ashby", "Ashby"), ("smartrecruiters.com", "smartrecruiters", "SmartRecruiters"), ("workable.com", "workable", "Workable"),
    ("bamboohr.com", "bamboohr", "BambooHR"), ("dayforcehcm.com", "dayforce", "Dayforce"), ("icims.com", "icims", "iCIMS"), ("breezy.hr", "breezy", "Breezy"), ("jobvite.com", "jobvite", "Jobvite"),
]
# Hosts that run an employer's own careers site on a platform's domain.
OWN_HOSTS = ["careers.achievetestprep.com", "jpmc.fa.oraclecloud.com", "jobs.citi.com", "burberrycareers.com", "careers.twosigma.com", "hdr.taleo.net", "blackrock.tal.net", "groupecreditagricole.jobs", "careers.paramount.com", "paramount.com", "cityjobs.nyc.gov", "careers.americanexpress.com"]
# Further portals by domain.
PORTALS = [("joinhandshake.com", "Handshake"), ("oraclecloud.com", "Oracle Recruiting"), ("taleo.net", "Taleo"), ("tal.net", "TAL"), ("eploy.net", "Eploy"), ("eightfold.ai", "Eightfold"), ("successfactors.com", "SAP SuccessFactors")]
# Places where postings are discovered, and their marks in query values.
DISCOVERY = ["LinkedIn", "Indeed", "Glassdoor", "ZipRecruiter", "Monster", "Wellfound", "Upwork", "SimplyHired", "Dice", "Handshake", "Google Jobs", "Jooble"]
DISCOVERY_MARKS = [("linkedin", "LinkedIn"), ("indeed", "Indeed"), ("glassdoor", "Glassdoor"), ("ziprecruiter", "ZipRecruiter"), ("monster", "Monster"), ("wellfound", "Wellfound"), ("angellist", "Wellfound"), ("upwork", "Upwork"), ("simplyhired", "SimplyHired"), ("dice", "Dice"), ("handshake", "Handshake"), ("google_jobs", "Google Jobs"), ("google jobs", "Google Jobs"), ("jooble", "Jooble")]
DISCOVERY_KEYS = ["utm_source", "source", "src", "ref", "referrer", "lever-source", "__jvsd", "__jvst"]
OTHER_LABELS = ["N/A", "Company Website", "Referral", "Other", "Oracle Recruiting", "Taleo", "TAL", "Eploy", "Eightfold", "SAP SuccessFactors"]

# Where a link begins and what it cannot hold.
URL = r"""(?i)https?://(?:(?!https?://)[^\s<>"'\[\]])+"""
SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*://"


def lookup(names: dict[str, object]) -> Column:
    """A constant map, built in one step."""
    quoted = lambda x: str(x) if isinstance(x, int) else "'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr("map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in names.items()) + ")")


def first_of(cases: list[tuple[Column, Column | str]], otherwise: Column | str) -> Column:
    """The value of the first true condition."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return reduce(lambda rest, case: F.when(case[0], as_col(case[1])).otherwise(rest), reversed(cases), as_col(otherwise))


def clean_url(c: Column) -> Column:
    """The first link of pasted text without invisible characters and closing punctuation."""
    raw = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "(?i)&amp;", "&"), "[​‌‍﻿]", "")
    link = F.regexp_extract(raw, URL, 0)
    return F.regexp_replace(F.trim(F.when(link != "", link).otherwise(raw)), r"[.,;:!?)\]}\\]+$", "")


def authority(u: Column) -> Column:
    return F.regexp_extract(u, SCHEME + "([^/?#]*)", 1)


def host(u: Column) -> Column:
    """Lower case, without credentials, port and trailing dots."""
    return F.rtrim(F.lower(F.regexp_extract(authority(u), "^(?:.*@)?([^:@]*)", 1)), F.lit("."))


def bare_host(u: Column) -> Column:
    return F.regexp_replace(host(u), "^www[.]", "")


def path(u: Column) -> Column:
    return F.regexp_extract(u, SCHEME + "[^/?#]*([^?#]*)", 1)


def query_pairs(u: Column) -> Column:
    """array<struct<k, v>> in order, decoded."""
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    parts = F.filter(F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(decode(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))


def within(h: Column, domain: str) -> Column:
    return (h == domain) | h.endswith("." + domain)


def url_key(c: Column) -> Column:
    """A link's identity: host without www, path, the query keys that matter in order; LinkedIn and Indeed by posting id."""
    parts = lambda u: F.struct(u.alias("u"), bare_host(u).alias("h"), F.rtrim(F.regexp_replace(path(u), ";[^/]*$", ""), F.lit("/")).alias("p"), _kept(u).alias("kept"))
    return F.element_at(F.transform(F.transform(F.array(clean_url(c)), parts), _key), 1)


def _kept(u: Column) -> Column:
    """The query's pairs that identify a posting, in order of their keys and values."""
    kept = F.filter(query_pairs(u), lambda x: ~F.lower(x["k"]).isin(TRACKING) & ~F.lower(x["k"]).startswith("utm_"))
    return F.array_sort(F.transform(kept, lambda x: F.struct(F.lower(x["k"]).alias("low"), x["v"].alias("v"), x["k"].alias("k"))))


def _key(x: Column) -> Column:
    u, h, kept = x["u"], x["h"], x["kept"]
    p = F.when(x["p"] == "", "/").otherwise(x["p"])
    scheme, port = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.regexp_extract(authority(u), r":(\d+)$", 1)
    quote = lambda t: F.replace(F.replace(F.url_encode(t), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    q = F.array_join(F.transform(kept, lambda y: F.concat(quote(y["k"]), F.lit("="), quote(y["v"]))), "&")
    linked = F.regexp_extract(p, r"(?i)/jobs/view/(?:[^/]*-)?([0-9]{7,})(?:/|$)", 1)
    jk = F.try_element_at(F.filter(kept, lambda y: (y["low"] == "jk") & (y["v"] != "")), F.lit(1))["v"]
    own_port = F.when((port != "") & (port != F.when(scheme == "https", "443").otherwise("80")), F.concat(F.lit(":"), port)).otherwise("")
    plain = F.concat(h, own_port, p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return first_of(
        [
            (host(u) == "", F.lower(F.rtrim(u, F.lit("/")))),
            (within(h, "linkedin.com") & (linked != ""), F.concat(F.lit("linkedin.com/jobs/view/"), linked)),
            (within(h, "indeed.com") & (F.lower(p) == "/viewjob") & jk.isNotNull(), F.concat(F.lit("indeed.com/viewjob?jk="), F.lower(jk))),
        ],
        plain,
    )


def url_problem(c: Column) -> Column:
    """Why a link is not accepted; null if it is.  Names are not resolved."""
    return F.element_at(F.transform(F.array(clean_url(c)), _problem), 1)


def _problem(u: Column) -> Column:
    six = F.lower(F.regexp_extract(authority(u), r"^(?:.*@)?\[([0-9A-Fa-f:.]+)\]", 1))
    h = F.when(six != "", six).otherwise(host(u))
    port = F.regexp_extract(authority(u), r"^(?:.*@)?+(?:\[[^\]]*\]|[^:\[]*):(.*)$", 1)
    bad_port = (port != "") & ~(port.rlike(r"^\d{1,5}$") & (port.try_cast("int") <= 65535))
    # loopback, unspecified, mapped and private IPv4, link-local, unique local, multicast, documentation, discard
    hidden = (six != "") & (six.rlike(r"^(?:0{0,4}:)*:?(?:0{0,4}:)*0{0,3}[01]?$|^(?:0{0,4}:)*:?ffff:|^fe[89a-f]|^f[cdf]|^2001:0?db8:|^2001:0{0,4}:|^100:{1,2}"))
    octet = lambda k: F.regexp_extract(h, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", k).try_cast("int")
    a, b, c3 = octet(1), octet(2), octet(3)
    private = a.isNotNull() & (a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)) | ((a == 192) & (b == 0) & c3.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c3 == 100)) | ((a == 203) & (b == 0) & (c3 == 113)))
    # a host that ends in a number is an address; what is no address of four octets stands for one or is none
    octets = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    unclear = (six == "") & h.rlike(r"(?:^|[.])(?:\d+|0x[0-9a-f]*)$") & ~h.rlike(rf"^(?:{octets}[.]){{3}}{octets}$")
    return first_of(
        [
            (F.length(u) > 4096, "The job link is too long."),
            (bad_port | (authority(u).contains("[") & (six == "")), "Add a complete job link."),
            (~F.lower(F.regexp_extract(u, "^([A-Za-z]+)://", 1)).isin("http", "https") | (h == ""), "The link must start with http:// or https://."),
            (authority(u).contains("@"), "Links containing usernames or passwords are not supported."),
            (h.isin(BLOCKED_HOSTS) | h.endswith(".localhost") | h.endswith(".local") | h.endswith(".internal") | F.coalesce(private | hidden, F.lit(False)) | unclear, "Local and private network links are not allowed."),
        ],
        F.lit(None).cast("string"),
    )


def is_search_page(c: Column) -> Column:
    """Links to lists of postings, by host and path."""
    h, p = bare_host(c), F.lower(F.rtrim(path(c), F.lit("/")))
    return first_of(
        [
            (h.contains("monster.com") & p.isin("/jobs/search", "/jobs"), F.lit(True)),
            (within(h, "linkedin.com"), p.isin("/jobs", "/jobs/collections") | p.startswith("/jobs/search")),
            (within(h, "indeed.com"), (p == "/jobs") | (p.startswith("/q-") & p.endswith("-jobs.html"))),
            (within(h, "glassdoor.com"), p.startswith("/job/") & (p.contains("-jobs-") | p.contains("srch_"))),
            (within(h, "ziprecruiter.com"), p.isin("/jobs-search", "/jobs/search")),
            (within(h, "simplyhired.com"), p.isin("/search", "/job-search")),
        ],
        F.lit(False),
    )


def _by_platform(u: Column, place: int) -> Column:
    none = "company_website" if place == 1 else "Company Website"
    pick = lambda h: first_of([(reduce(lambda a, b: a | b, (within(h, x) for x in OWN_HOSTS)), none), *((h.contains(p[0]), p[place]) for p in PLATFORMS)], none)
    return F.element_at(F.transform(F.array(bare_host(u)), pick), 1)


def platform(u: Column) -> Column:
    return _by_platform(u, 1)


def source_label(c: Column) -> Column:
    """A label as written canonically; '' for automatic, N/A for missing words."""
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    known = {x.lower(): x for x in [*DISCOVERY, *OTHER_LABELS, *(p[2] for p in PLATFORMS)]}
    low = F.lower(t)
    names = lookup(known)
    return first_of([(low.isin("", "auto", "auto from link"), ""), (low.isin("n/a", "na", "none", "null"), "N/A")], F.coalesce(F.try_element_at(names, low), F.substring(t, 1, 80)))


def application_portal(u: Column, legacy: Column | None = None) -> Column:
    old = source_label(legacy) if legacy is not None else F.lit("")

    def portal(x):
        h, board, before = x["h"], x["board"], x["old"]
        return first_of([(h == "", F.when(before.isin("", "N/A"), "Company Website").otherwise(before)), (board != "Company Website", board), *((within(h, d), name) for d, name in PORTALS)], "Company Website")

    return F.element_at(F.transform(F.array(F.struct(bare_host(u).alias("h"), _by_platform(u, 2).alias("board"), old.alias("old"))), portal), 1)


def found_on(u: Column, selected: Column | None = None, legacy: Column | None = None) -> Column:
    """Where a posting was discovered: the choice made, marks in the query, the older label, the portal."""
    values = F.transform(F.filter(query_pairs(u), lambda x: F.lower(x["k"]).isin(DISCOVERY_KEYS) & (x["v"] != "")), lambda x: F.lower(x["v"]))
    named = F.transform(values, lambda v: first_of([*((v.contains(m), label) for m, label in DISCOVERY_MARKS), (v.isin("careersite", "career site", "company website"), "Company Website")], F.lit(None).cast("string")))
    chosen = source_label(selected) if selected is not None else F.lit("")
    old = source_label(legacy) if legacy is not None else F.lit("")
    hit = F.try_element_at(F.filter(named, lambda x: x.isNotNull()), F.lit(1))
    known = F.struct(chosen.alias("chosen"), hit.alias("hit"), old.alias("old"), application_portal(u, legacy).alias("portal"))
    pick = lambda x: first_of([(x["chosen"] != "", x["chosen"]), (x["hit"].isNotNull(), x["hit"]), (x["old"].isin(DISCOVERY), x["old"]), (x["portal"].isin(DISCOVERY), x["portal"])], "N/A")
    return F.element_at(F.transform(F.array(known), pick), 1)


def link_key(c: Column) -> Column:
    """A tracker's identity of a link: trimmed, without closing slashes, case folded."""
    return F.lower(F.rtrim(F.trim(F.coalesce(c, F.lit(""))), F.lit("/")))
