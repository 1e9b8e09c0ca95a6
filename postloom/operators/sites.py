"""What single boards show in their own layouts: titles of pages, headings, lines of text, nested application data.

Places are as they are written, and salaries the texts that may hold them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions import hints, places, work
from postloom.functions import text as t
from postloom.functions.text import bind, found
from postloom.functions.urls import first_of

FIELDS = ("job_title", "company", "location", "salary", "work_type")
# Cities of several words, and single ones that follow an employer's name.
CITIES = [
    "new york", "san francisco", "los angeles", "jersey city", "long island city", "white plains", "salt lake city", "garden city", "great neck", "palo alto", "santa clara", "las vegas", "st louis", "st paul",
    "washington", "manhattan", "brooklyn", "queens", "bronx", "trenton", "woodmere", "baltimore", "seattle", "franklin", "chicago",
]
# What may stand behind a posting's place.
BEHIND_PLACE = ["•", "$", "hybrid", "remote", "onsite", "on-site", "posted"]


def _parts(c: Column, by: str) -> Column:
    """The text before and behind the first separator, '' where there is none."""
    return bind(F.split(c, by, 2), lambda x: F.struct(F.when(F.size(x) > 1, x[0]).otherwise("").alias("before"), F.coalesce(F.get(x, F.lit(1)), F.lit("")).alias("behind")))


def split_company_place(c: Column) -> Column:
    """struct<company, location> of a text such as "Acme Labs Jersey City, NJ": the longest known city before the comma, else its last word."""
    states = t.phrases(*places.STATES, join=r"\s+")
    state_behind = rf",\s*(?-i:{places.ABBR}|(?i:{states}))\b"
    known = rf"(?i)(?:^|\s)({t.phrases(*CITIES, join=r'[.]?' + chr(92) + 's+')})$"
    whole = rf"(?i)^(.+?)\s+(Remote|United States)\s*(?:$|{t.phrases(*BEHIND_PLACE)})"

    def read(text):
        head, state = F.element_at(F.split(text, state_behind, 2), 1), found(text, rf"({state_behind})")
        city = t.first_filled(found(head, known), F.substring_index(head, " ", -1))
        named = F.struct(F.trim(F.substr(head, F.lit(1), F.length(head) - F.length(city))).alias("company"), F.concat(t.title_case(city), state).alias("location"))
        return F.when(state != "", named).otherwise(F.struct(found(text, whole).alias("company"), found(text, whole, 2).alias("location")))

    return bind(bind(t.norm(c), read), lambda x: F.struct(t.clean_company(x["company"]).alias("company"), x["location"].alias("location")))


def fields(title=None, company=None, location=None, salary=None, work_type=None) -> Column:
    given = {"job_title": title, "company": company, "location": location, "salary": salary, "work_type": work_type}
    return F.struct(*(F.coalesce(given[f], F.lit("")).alias(f) if given[f] is not None else F.lit("").alias(f) for f in FIELDS))


def ziprecruiter(title: Column, meta_title: Column, heading: Column, text: Column) -> Column:
    """"X job in Y" of the title; employer and place behind the posting's title, or from "About" and the page's title."""
    source = F.when(title.rlike(r"(?i)\bjob\s+in\b"), title).otherwise(t.first_filled(meta_title, title))
    prefix = F.element_at(F.split(text, " Job description ", 2), 1)
    about = t.after_label(text, "About", ["Industry", "Company size", "Headquarters location", "Year founded", "Website", "Social media"])

    def read(x):
        name = x["name"]
        behind = F.when((name == "") | ~F.contains(F.lower(x["prefix"]), F.lower(name)), x["prefix"]).otherwise(t.after_last_title(x["prefix"], name))
        return F.struct(name.alias("name"), behind.alias("behind"), F.substring(x["prefix"], 1, 1000).alias("head"), split_company_place(behind).alias("split"), x["town"].alias("town"))

    def shown(x):
        top = F.substring(x["behind"], 1, 500)
        kind = bind(work.extract_work_type(top), lambda v: F.when(v == "", "n/a").otherwise(v))
        paid = F.concat_ws(" | ", top, x["head"])
        company = t.first_filled(x["split"]["company"], F.when(F.contains(text, F.lit(" About ")), about).otherwise(""))
        return fields(x["name"], company, t.first_filled(x["split"]["location"], x["town"]), paid, kind)

    def stated(s):
        town = _parts(s["behind"], r"(?i)\s+at\s+ZipRecruiter\b")["before"]
        return F.struct(t.first_filled(t.clean_title(s["before"]), heading).alias("name"), town.alias("town"), prefix.alias("prefix"))

    return bind(bind(bind(_parts(source, r"(?i)\s+job\s+in\s+"), stated), read), shown)


def simplyhired(title: Column, heading: Column, text: Column) -> Column:
    """"X - Employer | Place" of the page's title; a work type only behind a label or in that title."""
    label = work.told(text, rf"{t.phrases('location', 'work type', 'workplace')}\s*:\s*")
    kind = F.coalesce(F.try_element_at(F.filter(F.array(label, work.extract_work_type(title), F.lit("n/a")), lambda v: v != ""), F.lit(1)), F.lit(""))
    named = F.array_join(F.slice(F.array_distinct(places.location_hits(text)), 1, 2), ", ")
    names = lambda x: bind(_parts(x["before"], r"\s+-\s+"), lambda y: fields(t.first_filled(heading, y["before"]), y["behind"], t.first_filled(F.when(y["behind"] != "", x["behind"]).otherwise(""), named), None, kind))
    return bind(_parts(title, r"\s+\|\s+"), names)


def breezy(title: Column, headings: Column, text: Column) -> Column:
    """"X at Employer" of the page's title; the second heading where it says more than that."""
    first, second = (F.coalesce(F.try_element_at(headings, F.lit(k)), F.lit("")) for k in (1, 2))

    def read(x):
        name = x["before"]
        longer = (second != "") & ((name == "") | (F.lower(second).startswith(F.lower(name)) & (F.length(second) > F.length(name))))
        return fields(F.when(longer, second).otherwise(name), t.first_filled(x["behind"], F.when(second != "", first).otherwise("")), None, None, work.extract_work_type(text))

    return bind(_parts(title, r"(?i)\s+at\s+"), read)


def dayforce(jobs: Column, url: Column) -> Column:
    """The object of the application data whose id the link names, else the first: title, place, work type; salary from its description."""
    parsed = F.transform(jobs, F.try_parse_json)
    get = lambda x, p: F.coalesce(F.try_variant_get(x, f"$.{p}", "string"), F.lit(""))
    number = found(url, r"(?i)/jobs/(\d+)")
    mine = F.filter(parsed, lambda x: (number != "") & (get(x, "jobPostingId") == number))

    def read(x):
        spots = F.coalesce(F.try_variant_get(x, "$.postingLocations", "array<variant>"), F.array().cast("array<variant>"))
        about = t.norm(t.unescape(F.regexp_replace(get(x, "jobPostingContent.jobDescription"), "<[^>]*>", " ")))

        def shown(s):
            city, state = get(s, "cityName"), places.state_abbrev(get(s, "stateCode"))
            return F.when((city != "") & (state != ""), F.concat(t.clean_value(city), F.lit(", "), state)).otherwise(t.clean_value(get(s, "formattedAddress")))

        where = F.coalesce(F.try_element_at(F.filter(F.transform(spots, shown), lambda v: v != ""), F.lit(1)), F.lit(""))
        remote = F.when(F.coalesce(F.try_variant_get(x, "$.hasVirtualLocation", "boolean"), F.lit(False)) & (F.size(spots) == 0), "Remote").otherwise("")
        return bind(about, lambda a: fields(get(x, "jobTitle"), hints.dayforce_company(url), where, a, t.first_filled(work.extract_work_type(a), remote)))

    one = F.coalesce(F.try_element_at(mine, F.lit(1)), F.try_element_at(parsed, F.lit(1)))
    return F.when(F.size(jobs) > 0, bind(one, read)).otherwise(fields())


def behind_labels(lines: Column, labels: list[str], tags: tuple[str, ...], icon: str | None = None) -> Column:
    """The text next to each label that is a line of its own, in page order: the next line of the label's region.

    A line in another region, such as a list of similar postings, is not the label's.
    """
    bare = lambda x: F.lower(F.rtrim(x["text"], F.lit(" :")))
    is_label = lambda x: (x["tag"].isin(*tags) & bare(x).isin(*labels)) | ((x["tag"] == "img") & F.contains(F.lower(x["text"]), F.lit(icon)) if icon else F.lit(False))
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x["region"].alias("region"), x["text"].alias("text"), is_label(x).alias("label")))
    behind = lambda y, all_of: F.try_element_at(F.filter(F.slice(all_of, y["i"] + 2, F.greatest(F.size(all_of), F.lit(1))), lambda z: z["region"] == y["region"]), F.lit(1))["text"]
    return bind(numbered, lambda all_of: F.filter(F.transform(F.filter(all_of, lambda y: y["label"]), lambda y: behind(y, all_of)), lambda v: v.isNotNull()))


# Labels of places and work types, and of what else a line may state.
PLACE_LABELS = ["location", "job location"]
WORK_LABELS = ["workplace type", "workplace", "work type", "worktype", "job location type", "location type"]
OTHER_LABELS = ["type", "experience", "salary", "compensation", "employment"]


def labelled_places(lines: Column) -> Column:
    """What stands behind location labels and icons, then in lines such as "Location: X" that state nothing else."""
    more = rf"(?i)[|]|\b{t.phrases(*OTHER_LABELS)}\s*:"
    read = F.transform(F.filter(lines, lambda x: x["tag"].isin("dd", "div", "li", "p") & (F.length(x["text"]) <= 160)), lambda x: _parts(x["text"], r"\s*:\s*"))
    single = F.filter(read, lambda x: F.lower(x["before"]).isin(*PLACE_LABELS) & ~x["behind"].rlike(more))
    own = behind_labels(lines, PLACE_LABELS, ("dt", "h2", "h3", "h4", "h5", "strong"), "location")
    return F.concat(own, F.transform(single, lambda x: x["behind"]))


def labelled_work_types(marked: Column, lines: Column, selected) -> Column:
    """What elements for workplaces hold, then what stands behind labels such as "Workplace type"."""
    chips = selected(marked, [("", "(?im)^class=.*workplace", r"(?m)^class=(?:.* )?posting-categories(?: |$)"), ("", "(?im)^(?:data-testid|data-qa)=.*workplace-type", "")])
    return F.concat(F.transform(chips, lambda m: m["text"]), behind_labels(lines, WORK_LABELS, ("dt", "h2", "h3", "h4", "h5", "strong", "span", "div")))


def linkedin_chips(marked: Column) -> Column:
    """The texts of the elements with a posting's preferences, with their spoken labels."""
    chips = F.filter(marked, lambda m: m["mark"].rlike("(?im)^(?:class=.*job-details-(?:fit-level-)?preferences|data-view-name=.*job-details-preferences)"))
    return F.transform(chips, lambda m: F.concat_ws(" ", m["text"], found(m["mark"], "(?m)^aria-label=(.*)$"), found(m["mark"], "(?m)^title=(.*)$")))


def linkedin_criteria(marked: Column) -> Column:
    """The text of a posting's criteria, and of attributes that speak of workplaces."""
    listed = r"(?m)^class=(?:.* )?(?:top-card-layout__second-subline|topcard__flavor-row|topcard__flavor--bullet)(?: |$)|(?im)^(?:class=.*(?:job-criteria|workplace|location-type)|data-testid=.*(?:workplace|location-type))"
    spoken = rf"(?i)\b{t.phrases('workplace', 'work type', *t.KINDS[:4])}\b"
    tracked = rf"(?i)\b{t.phrases('workplace', 'work type', 'job location type', 'location type')}\b"

    def told(m):
        value = lambda k: found(m["mark"], f"(?m)^{k}=(.*)$")
        words = F.replace(F.concat_ws(" ", *(value(k) for k in ("aria-label", "title", "data-test-id", "data-testid"))), F.lit("_"), F.lit("-"))
        name = F.replace(value("data-tracking-control-name"), F.lit("_"), F.lit("-"))
        return F.concat_ws(" ", F.when(words.rlike(spoken), words), F.when(name.rlike(tracked), name))

    texts = F.transform(F.filter(marked, lambda m: m["mark"].rlike(listed)), lambda m: m["text"])
    return t.norm(F.array_join(F.concat(texts, F.transform(marked, told)), " "))


def linkedin_about(marked: Column, selected) -> Column:
    """The description's text: the first element of each kind counts, if it says enough."""
    kinds = [("", r"(?m)^class=(?:.* )?show-more-less-html__markup(?: |$)", ""), ("", r"(?m)^class=(?:.* )?description__text(?: |$)", ""), ("", "(?im)^class=.*job-description", ""), ("", "(?m)^data-testid=job-description$", "")]
    ranked = F.array_sort(selected(marked, kinds))
    firsts = F.filter(ranked, lambda m, i: (i == 0) | (F.get(ranked, i - 1)["rank"] != m["rank"]))
    return F.coalesce(F.try_element_at(F.filter(firsts, lambda m: F.length(m["text"]) > 80), F.lit(1))["text"], F.lit(""))


def described_work(about: Column) -> Column:
    """What a description says of where the work is done."""
    remote = t.phrases("fully remote", "work remotely", "work from home", "telecommute", *(f"remote {w}" for w in (*work.WORK, "opportunity")), join=r"\s+")
    onsite = t.phrases("in office", "office based", "based out of", "based in", *(f"on site {w}" for w in work.WORK))
    says = lambda words: F.lower(about).rlike(rf"\b{words}\b")
    return first_of([(says("hybrid"), "Hybrid"), (says(remote), "Remote"), (says(onsite), "Onsite")], "")
