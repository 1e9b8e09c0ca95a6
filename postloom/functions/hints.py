"""What a link says about its posting, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions.places import from_link, from_tokens
from postloom.functions.text import acronyms, bind, dropped, first_filled, found, slug_name, slug_title
from postloom.functions.urls import PLATFORMS, bare_host, first_of, lookup, path, platform, query_pairs, within

# Cities of one board's links.
INDIAN_CITIES = {"gurugram": "Gurugram, India", "gurgaon": "Gurugram, India", "pune": "Pune, India", "mumbai": "Mumbai, India", "bengaluru": "Bengaluru, India", "bangalore": "Bengaluru, India", "delhi": "Delhi, India", "hyderabad": "Hyderabad, India", "chennai": "Chennai, India"}
# Employers of own career hosts.
OWN_COMPANIES = {
    "careers.achievetestprep.com": "Achieve Test Prep", "jpmc.fa.oraclecloud.com": "JPMorgan Chase & Co.", "jobs.citi.com": "Citi", "burberrycareers.com": "Burberry", "careers.twosigma.com": "Two Sigma", "hdr.taleo.net": "HDR",
    "blackrock.tal.net": "BlackRock", "groupecreditagricole.jobs": "Crédit Agricole CIB", "careers.paramount.com": "Paramount", "paramount.com": "Paramount", "cityjobs.nyc.gov": "New York City", "careers.americanexpress.com": "American Express",
}
# Words of paths that lead to postings or to lists of them.
SEARCH_MARKS = ["/search", "jobsearch", "srch_", "keywords="]
POSTING_MARKS = ["/job", "jobdetail", "/career", "/position", "/opening", "/vacanc", "/role", "/opportunit", "/employment"]
LIST_PATHS = ["/career", "/careers", "/job", "/jobs", "/openings", "/opportunities"]
BOARD_HOSTS = ["linkedin.com", "indeed.com", "glassdoor.com", "ziprecruiter.com", "monster.com", "wellfound.com", "upwork.com", "simplyhired.com", "dice.com", "jooble.org"]


def segments(url: Column) -> Column:
    return F.transform(F.filter(F.split(path(url), "/"), lambda p: p != ""), lambda p: F.coalesce(F.try_url_decode(p), p))


def after(url: Column, word: str) -> Column:
    """The path segment behind the first one that is ``word``, else ''."""
    parts = segments(url)
    at = F.array_position(parts, word)
    return F.coalesce(F.when(at > 0, F.try_element_at(parts, (at + 1).cast("int"))), F.lit(""))


def linkedin_id(url: Column) -> Column:
    """The number of a LinkedIn posting, of six digits at least."""
    return F.when(within(bare_host(url), "linkedin.com"), found(path(url), r"/jobs/view/(?:[^/]*-)?(\d{6,})(?:/|$)")).otherwise("")


def own_company(url: Column) -> Column:
    """The employer of a career host of its own, else ''."""
    h = bare_host(url)
    return first_of([(within(h, d), name) for d, name in OWN_COMPANIES.items()], "")


def split_slug(slug: Column) -> Column:
    """struct<title, place> of "title-jobs-in-city-st" and "title-city-st": the title's slug, and the place."""
    bare = dropped(F.btrim(F.coalesce(slug, F.lit("")), F.lit("/")), r"(?i)--[0-9a-f-]{12,}$")

    def read(s):
        listed = s.rlike(r"(?i)-jobs-in-")

        def apart(place):
            words = F.when(place == "", F.lit("$^")).otherwise(F.concat(F.lit(r"(?i)[-_]?\Q"), F.regexp_replace(F.lower(place), r"[,\s]+", "-"), F.lit(r"\E$")))
            return F.struct(F.when(listed, found(s, r"(?i)^(.*?)-jobs-in-")).otherwise(F.regexp_replace(s, words, F.lit(""))).alias("title"), place.alias("place"))

        return bind(from_tokens(F.when(listed, found(s, r"(?i)-jobs-in-(.*)$")).otherwise(F.regexp_replace(s, r"[_\s]+", "-"))), apart)

    return bind(bare, read)


def link_hints(url: Column, board: Column | None = None, link_place: Column | None = None) -> Column:
    """struct<company, job_title, location> from the path of boards whose links name the posting; '' where they do not.

    First the parts of the path that hold each are chosen, then all are cleaned alike.
    ``board`` and ``link_place`` are the link's platform and place, if they are known.
    """
    cities = lookup(INDIAN_CITIES)
    no = F.lit("")
    raw = lambda company=no, title=no, place=no: F.struct(company.alias("company"), title.alias("title"), place.alias("place"))

    def linkedin(s):
        at = s.rlike("-at-")
        return raw(F.when(at, found(s, "-at-((?:(?!-at-).)*)$")).otherwise(""), F.when(at, found(s, "^(.*)-at-")).otherwise(s))

    def indian(tokens):
        at = F.array_position(F.transform(tokens, lambda t: F.try_element_at(cities, t).isNotNull()), True).cast("int")
        good = at >= 3
        pick = lambda k: F.coalesce(F.try_element_at(tokens, F.when(good, k).otherwise(1)), no)
        return raw(F.when(good, pick(at - 1)).otherwise(""), F.when(good, F.array_join(F.slice(tokens, 1, F.greatest(at - 2, F.lit(0))), "-")).otherwise(""), F.when(good, F.coalesce(F.try_element_at(cities, pick(at)), no)).otherwise(""))

    def glassdoor(s):
        last = found(s, r"(?i)-([a-z0-9]+)$")
        return raw(last, F.when(last != "", dropped(s, r"(?i)-[a-z0-9]+$")).otherwise(s))

    def choose(x):
        h, board, parts = x["h"], x["board"], x["parts"]

        def behind(word):
            at = F.array_position(parts, word)
            return F.coalesce(F.when(at > 0, F.try_element_at(parts, (at + 1).cast("int"))), no)

        listed = F.when(h == "jobs.talhealthcare.com", behind("jb")).when(h.contains("monster.com"), behind("job-openings")).otherwise("")
        naukri = dropped(F.coalesce(F.try_element_at(parts, F.lit(1)), no), r"(?i)^job-listings-", r"(?i)-\d+-to-\d+-years.*$")
        return first_of(
            [
                ((board == "linkedin") & (behind("view") != ""), linkedin(dropped(behind("view"), r"-\d{6,}$"))),
                (listed != "", bind(split_slug(listed), lambda y: raw(F.when(h == "jobs.talhealthcare.com", "Tal Healthcare").otherwise(""), y["title"], y["place"]))),
                (h.contains("upwork.com"), raw(title=behind("apply"))),
                (h.contains("wellfound.com"), raw(title=dropped(behind("jobs"), r"^\d+-", r"(?i)-clone$"))),
                (h.contains("naukri.com"), bind(F.filter(F.split(naukri, "-"), lambda t: t != ""), indian)),
                (h.contains("glassdoor.com") & (behind("job-listing") != ""), glassdoor(dropped(behind("job-listing"), r"(?i)-JV_.*$"))),
                (h.contains("dayforcehcm.com"), raw(_client(parts))),
                (h.contains("talents.vaia.com") & (behind("companies") != ""), raw(behind("companies"), dropped(F.coalesce(F.try_element_at(parts, F.lit(3)), no), r"-\d+$"), from_link(url) if link_place is None else link_place)),
            ],
            raw(),
        )

    known = F.struct(bare_host(url).alias("h"), (platform(url) if board is None else board).alias("board"), segments(url).alias("parts"))
    chosen = bind(known, lambda x: F.struct(choose(x).alias("raw"), (x["board"] == "linkedin").alias("linkedin")))
    company = lambda y: bind(slug_name(y["raw"]["company"]), lambda v: F.when(y["linkedin"], acronyms(v)).otherwise(v))
    return bind(chosen, lambda y: F.struct(company(y).alias("company"), slug_title(y["raw"]["title"]).alias("job_title"), y["raw"]["place"].alias("location")))


def _client(parts: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(parts, lambda p: ~p.rlike(r"(?i)^(?:[a-z]{2}-[a-z]{2}|candidateportal|jobs|posting|view|\d+)$")), F.lit(1)), F.lit(""))


def dayforce_company(url: Column) -> Column:
    """The client's name in a Dayforce link: the segment behind the language."""
    return slug_name(_client(segments(url)))


def company_from_link(url: Column, board: Column | None = None) -> Column:
    """The employer by the board's path, a tenant's host or the host's own name; '' on boards that do not say."""
    h, board, first = bare_host(url), platform(url) if board is None else board, F.coalesce(F.try_element_at(segments(url), F.lit(1)), F.lit(""))
    of_query = F.coalesce(F.try_element_at(F.filter(query_pairs(url), lambda x: (x["k"] == "for") & (x["v"] != "")), F.lit(1))["v"], F.lit(""))
    parts = F.split(h, r"\.")
    blocked = ["jobs", "careers", "boards", "apply", "job-boards", "job"]
    label = lambda k: F.coalesce(F.try_element_at(parts, F.lit(k)), F.lit(""))
    own = F.when(label(1).isin(blocked) & (F.size(parts) > 2), F.when(label(-2).isin("co", "com") & (F.size(parts) > 3), label(-3)).otherwise(label(-2))).otherwise(label(1))
    on_board = reduce(lambda a, b: a | b, (h.contains(p[0]) for p in PLATFORMS))
    slug = first_of(
        [
            (h.contains("talents.vaia.com") & (first == "companies"), after(url, "companies")),
            ((board == "greenhouse") & (of_query != ""), of_query),
            ((board == "greenhouse") & h.contains("boards.greenhouse.io") & (first != ""), first),
            (board.isin("lever", "ashby") & (first != ""), first),
            (board == "workday", F.regexp_replace(label(1), r"wd[135]-", "")),
            (on_board | own.isin(blocked), ""),
        ],
        own,
    )
    return slug_name(slug)


def is_posting_link(url: Column) -> Column:
    """Links whose page can be read without a browser: postings by their path, not lists of them."""
    board, p = platform(url), F.lower(path(url))
    rest = F.lower(found(url, r"^[^?#]*\?([^#]*)"))
    any_of = lambda c, words: reduce(lambda a, b: a | b, (c.contains(w) for w in words))
    return first_of(
        [
            (board == "monster", F.lit(False)),
            (board == "linkedin", p.contains("/jobs/view/")),
            (board == "indeed", p.contains("viewjob")),
            (board == "glassdoor", p.contains("job-listing") & ~p.contains("srch_")),
            (board == "wellfound", p.rlike(r"/jobs/\d+")),
            (board == "upwork", p.contains("/freelance-jobs/apply/")),
            (any_of(p, SEARCH_MARKS) | any_of(rest, SEARCH_MARKS), F.lit(False)),
            (board != "company_website", F.size(segments(url)) >= 2),
            (F.rtrim(p, F.lit("/")).isin(LIST_PATHS), F.lit(False)),
        ],
        any_of(p, POSTING_MARKS),
    )


def alternate_link(url: Column) -> Column:
    """Another address of the same posting, '' if there is none."""
    return F.when((bare_host(url) == "app.digitalhire.com") & (after(url, "job-detail") != ""), F.concat(F.lit("https://jobs.digitalhire.com/job-listing/opening/"), after(url, "job-detail"))).otherwise("")


def workday_endpoint(url: Column) -> Column:
    """Where a Workday posting's data are, by tenant, site and posting; '' for other links."""
    h, parts = F.lower(found(url, r"^https?://([^/?#]+)")), segments(url)
    at = F.array_position(parts, "job")
    site, posting = F.try_element_at(parts, F.greatest(at - 1, F.lit(1)).cast("int")), F.try_element_at(parts, F.lit(-1))
    safe = r"^[A-Za-z0-9_.~-]+$"
    good = (platform(url) == "workday") & (F.size(F.split(h, r"\.")) >= 4) & (at > 1) & (at < F.size(parts)) & site.rlike(safe) & posting.rlike(safe)
    address = F.concat(found(url, r"^(https?)://"), F.lit("://"), h, F.lit("/wday/cxs/"), found(h, r"^([^.]+)\."), F.lit("/"), site, F.lit("/job/"), posting)
    return F.coalesce(F.when(good, address), F.lit(""))


def gone_by_redirect(url: Column, final: Column) -> Column:
    """Whether a redirect shows that the posting is gone: to a board's root, off its /jobs/, to careers or an error."""
    a, b = F.lower(path(url)), F.lower(path(final))
    ha, hb = bare_host(url), bare_host(final)
    return first_of(
        [
            (found(F.lower(final), r"[?&](error=true)(?:&|#|$)") != "", F.lit(True)),
            (ha.contains("lever.co") & hb.contains("lever.co"), (F.size(segments(url)) >= 2) & (F.size(segments(final)) <= 1)),
            (ha.contains("greenhouse.io") & a.contains("/jobs/"), ~b.contains("/jobs/")),
        ],
        a.contains("/job/") & F.rtrim(b, F.lit("/")).endswith("/careers"),
    )


def is_job_href(href: Column) -> Column:
    """Links that may lead to a posting: no fragments and mail, and a word of jobs."""
    return ~F.coalesce(href, F.lit("")).rlike(r"(?i)^(?:#|mailto:|$)") & href.rlike(r"(?i)\b(?:job|jobs|careers|gh_jid|opening|position|vacancy)\b")


def resolve(base: Column, href: Column) -> Column:
    """An absolute link from a page's address and a reference."""
    root, folder = found(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"), found(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/)?)")
    return first_of(
        [
            (href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href),
            (href.startswith("//"), F.concat(found(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)"), href)),
            (href.startswith("/"), F.concat(root, href)),
        ],
        F.concat(F.rtrim(folder, F.lit("/")), F.lit("/"), href),
    )


def private_record(url: Column, full: bool = False) -> Column:
    """What a log may hold of a link: its host and SHA-256 ('' of none), and the link itself only if allowed."""
    link = F.trim(F.coalesce(url, F.lit("")))
    host = F.lower(found(link, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"))
    return F.struct(host.alias("domain"), F.when(link != "", F.sha2(link, 256)).otherwise("").alias("url_hash"), (link if full else F.lit(None).cast("string")).alias("url"))
