"""Locations as column expressions: display, cleaning, and finding them in texts, titles and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions.text import ARRANGEMENT, after_label, bind, clean_title, clean_value, dropped, first_filled, found, norm, title_case
from postloom.functions.urls import first_of, lookup, path

# States of the United States and their abbreviations.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "district of columbia": "DC", "florida": "FL",
    "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD",
    "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ",
    "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI",
    "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}
# Further abbreviations that stay in capitals: territories, provinces, regions.
CAPITALS = [*STATES.values(), "AS", "GU", "MP", "PR", "VI", "AB", "BC", "MB", "NB", "NL", "NS", "NT", "NU", "ON", "PE", "QC", "SK", "YT", "ACT", "APAC", "EMEA", "EU", "LATAM", "NSW", "NYC", "QLD", "SA", "TAS", "UAE", "UK", "US", "USA", "VIC"]
# Countries that a location may end in.
COUNTRIES = ["South Korea", "United Kingdom", "United States", "Canada", "Mexico", "Australia", "India", "Japan", "Singapore", "Germany", "France", "Ireland", "Poland", "Spain", "Italy", "Brazil", "Netherlands", "Gibraltar"]
# Words that are no place.
NO_PLACE = ["clear text", "permanent", "full", "full time", "full-time", "contract", "temporary", "apply", "posted", "save job"]
# Places by a word of a link, and cities of several words.
LINK_PLACES = [("queens", "Queens, NY"), ("brooklyn", "Brooklyn, NY"), ("manhattan", "New York, NY"), ("bronx", "Bronx, NY"), ("staten-island", "Staten Island, NY"), ("baltimore", "Baltimore, MD")]
LINK_CITIES = ["long-island-city", "salt-lake-city", "new-york", "san-francisco", "san-jose", "los-angeles", "jersey-city", "new-brunswick", "white-plains", "garden-city"]
TITLE_CITIES = {"Brooklyn": "Brooklyn, NY", "Queens": "Queens, NY", "Manhattan": "New York, NY", "Bronx": "Bronx, NY", "Woodmere": "Woodmere, NY", "New York": "New York, NY"}

ABBR = "(?:" + "|".join(sorted(set(STATES.values()))) + ")"
US = r"(?:United States(?: of America)?|USA|US)"
WORD = r"[A-Z][A-Za-z.'-]+"
CITY = rf"{WORD}(?:\s+{WORD}){{0,3}}"
_map = lambda pairs: lookup(dict(pairs))


def state_abbrev(c: Column) -> Column:
    """The abbreviation of a state's name or abbreviation, '' for others."""
    known = {**STATES, **{a.lower(): a for a in STATES.values()}}
    return F.coalesce(F.try_element_at(_map(known.items()), F.trim(dropped(F.lower(norm(c)), r"\s+state$"))), F.lit(""))


def state_name(c: Column) -> Column:
    """A state's name in title case; other words as they are."""
    names = {a: n.title() for n, a in STATES.items()}
    return F.coalesce(F.try_element_at(_map(names.items()), state_abbrev(c)), norm(c))


def location_display(c: Column) -> Column:
    """Places in capitals as names; abbreviations of states and regions stay in capitals."""

    def word(w, i, first):
        up = F.upper(w)
        return first_of(
            [
                (up.isin(CAPITALS), up),
                ((i > first) & up.isin("AND", "OF", "THE"), F.lower(w)),
                (up.startswith("MC") & (F.length(w) > 3) & ~w.contains("'"), F.concat(F.lit("Mc"), F.upper(F.substring(w, 3, 1)), F.lower(F.substr(w, F.lit(4))))),
            ],
            title_case(w),
        )

    def piece(p):
        tokens = F.regexp_extract_all(p, F.lit(r"(\p{L}+(?:['’]\p{L}+)*|[^\p{L}]+)"), F.lit(1))
        first = F.when(p.rlike(r"^\p{L}"), 0).otherwise(1)
        return F.when(p.rlike(r"\p{L}") & (F.upper(p) == p), F.array_join(F.transform(tokens, lambda w, i: word(w, i, first)), "")).otherwise(p)

    return F.array_join(F.transform(F.regexp_extract_all(norm(c), F.lit("([,;|/]|[^,;|/]+)"), F.lit(1)), piece), "")


def remote_region(c: Column) -> Column:
    """The country or state of "Remote - X", else ''."""
    region = found(c, r"\bRemote\s*(?:[-,/]|\s+in\s+)?\s*(USA|US|United States|[A-Z]{2}|[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,2})\b")
    return bind(clean_value(region), lambda r: F.when(F.lower(r).isin("usa", "us", "united states"), "United States").otherwise(F.coalesce(F.try_element_at(_map({a: n.title() for n, a in STATES.items()}.items()), state_abbrev(r)), F.lit(""))))


def _last_words(c: Column, n: int = 3) -> Column:
    return F.array_join(F.reverse(F.slice(F.reverse(F.split(c, r"\s+")), 1, n)), " ")


def _city_state(v: Column) -> Column:
    pattern = rf"\b({CITY}),\s*({ABBR})\b"
    return F.when(v.rlike(pattern), F.concat(_last_words(found(v, pattern, 1)), F.lit(", "), found(v, pattern, 2))).otherwise("")


def _city_full_state(v: Column) -> Column:
    """City, full state name, country."""
    pattern = rf"\b({CITY}),\s*([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){{0,2}})\s*(?:\((?:US-)?([A-Z]{{2}})\))?\s*,\s*{US}\b"
    state = first_filled(found(v, pattern, 3), state_abbrev(found(v, pattern, 2)))
    return bind(state, lambda s: F.when(s != "", F.concat(found(v, pattern, 1), F.lit(", "), s)).otherwise(""))


def _international(v: Column) -> Column:
    pattern = rf"(?i)([^|;\n]+?),\s*({'|'.join(COUNTRIES)})\b"
    parts = F.filter(F.transform(F.split(found(v, pattern, 1), ","), lambda x: F.trim(x)), lambda p: p != "")
    country = F.try_element_at(_map((c.lower(), c) for c in COUNTRIES), F.lower(found(v, pattern, 2)))
    region = F.when((F.size(parts) > 1) & (F.lower(F.element_at(parts, -1)) != F.lower(F.element_at(parts, 1))), F.element_at(parts, -1))
    return F.when(v.rlike(pattern) & (F.size(parts) > 0), F.concat_ws(", ", F.try_element_at(parts, F.lit(1)), region, country)).otherwise("")


def _pieces(v: Column) -> Column:
    """At most two places of a list, for what no other rule reads."""
    parts = F.transform(F.split(v, r"\s*(?:\||;|/|\n|•|·)\s*"), clean_value)
    broad = lambda p: F.lower(p).isin("remote", "hybrid", "united states", "usa", "us", "all locations")
    whole = lambda p: broad(p) | p.rlike(r"\b[A-Z][a-z]+,\s*(?:United States|USA|Canada|UK)\b")
    read = lambda p: F.when(F.lower(p).isin("", *NO_PLACE), "").when(broad(p), p).otherwise(first_filled(_city_state(p), _city_full_state(p), F.when(whole(p), p).otherwise("")))
    return F.array_join(F.slice(F.array_distinct(F.filter(F.transform(parts, read), lambda p: p != "")), 1, 2), ", ")


def clean_location(c: Column) -> Column:
    """A place as "City, ST", "City, Region, Country", a country, Remote or Hybrid; '' if none is read."""
    v = dropped(clean_value(c), r"(?i)^locations?\s*\([^)]*\)?\s*[:\-]?\s*", r"(?i)^locations?\s*[:\-]\s*", r"(?i)^(?:for|in|based\s+in|located\s+in)\s+")
    v = norm(F.regexp_replace(F.regexp_replace(v, r"(?i)\bKorea,\s*Republic of\b", "South Korea"), r"\bNYC\b", "New York, NY"))
    office = rf"(?i)^([A-Z]{{2}})\s*-\s*([A-Za-z][A-Za-z.' -]{{1,80}}?)\s*-\s*.+?(?:,\s*{US})?$"
    suffix = rf"(?i)^(.+?)\s+(?:[-|/]\s*)?{ARRANGEMENT}\s*$"
    country = _map((x.lower(), x) for x in COUNTRIES)

    def in_office(t):
        city, state = norm(found(t, office, 2)), state_abbrev(found(t, office, 1))
        plain = F.when((F.upper(city) == city) | (F.lower(city) == city), title_case(city)).otherwise(city)
        return F.when(t.rlike(office) & (state != ""), F.concat(plain, F.lit(", "), state)).otherwise("")

    def placed(t):
        parts = F.filter(F.transform(F.split(t, ","), lambda x: F.trim(x)), lambda p: p != "")
        named = F.transform(parts, lambda p: F.try_element_at(country, F.lower(p)))
        bare = rf"\b({WORD}(?:\s+{WORD}){{0,2}})\s+({ABBR})(?:\s+\d+)?\b"
        by_rule = first_filled(
            F.when(t.rlike(r"(?i)^(?:anywhere\s+in\s+)?(?:the\s+)?United States$"), "United States").otherwise(""),
            remote_region(t),
            _city_full_state(t),
            F.when(t.rlike(r"(?i)(?:^|,\s*)New York City$"), "New York City, NY").when(F.lower(t).startswith("remote"), "Remote").when(F.lower(t).startswith("hybrid"), "Hybrid").otherwise(""),
            F.when(F.forall(named, lambda x: x.isNotNull()), F.array_join(named, ", ")).otherwise(""),
            _international(t),
            _city_state(t),
            F.when(t.rlike(bare), F.concat(_last_words(found(t, bare, 1)), F.lit(", "), found(t, bare, 2))).otherwise(""),
            _pieces(t),
        )
        return F.when(t == "", "").otherwise(by_rule)

    shown = lambda t: bind(location_display(t), lambda d: F.when(d.rlike(suffix), clean_value(found(d, suffix))).otherwise(d))
    return bind(v, lambda t: bind(in_office(t), lambda o: F.when(o != "", o).otherwise(bind(shown(t), placed))))


def is_broad(c: Column) -> Column:
    """Work types and the whole United States, which say no place."""
    us = r"(?:united states(?: of america)?|usa|us)"
    return bind(F.lower(clean_value(c)), lambda t: t.isin("", "remote", "hybrid", "onsite", "on-site", "united states", "united states of america", "usa", "us") | t.rlike(rf"^{us}\s*,\s*(?:{us}|[a-z]{{2}})$"))


def looks_internal(c: Column) -> Column:
    """Codes of offices rather than places."""
    t = clean_value(c)
    return t.rlike(r"\b[A-Z]{2,}\d*\s*[-_][A-Za-z]") | F.lower(t).startswith("locations ")


def location_hits(c: Column) -> Column:
    """All places that a text names, as they are written."""
    pattern = rf"\b((?:Remote|Hybrid|United States|US|USA|{CITY},\s*(?:{ABBR}|United States|USA|Canada|UK|[A-Z][a-z]+)))\b"
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(1))


def listed_hits(c: Column) -> Column:
    """Places of lists such as "USA, WA, Seattle USA, NY, New York Job details", city first."""
    pattern = r"\bUSA,\s*([A-Z]{2},\s*[A-Za-z][A-Za-z.' -]+?)(?=\s+USA,|\s+Job details|\s+Recommended jobs|\s*$)"
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(1)), lambda x: F.regexp_replace(x, r"^([A-Z]{2}),\s*(.+)$", "$2, $1"))


def first_places(cleaned: Column, most: int, by: str) -> Column:
    """The first cleaned places that are any, each once."""
    return F.array_join(F.slice(F.array_distinct(F.filter(cleaned, lambda x: x != "")), 1, most), by)


def locations_in(c: Column, most: int = 2) -> Column:
    """The first places that a text names, each once."""
    return first_places(F.transform(location_hits(c), lambda x: clean_location(x)), most, ", ")


def listed_locations(c: Column, most: int = 3) -> Column:
    """Places of a list, each once."""
    return first_places(F.transform(listed_hits(c), lambda x: clean_location(x)), most, "; ")


def without_title(location: Column, title: Column) -> Column:
    """The place of a location that the posting's (cleaned) title may stand before."""
    quoted = F.concat(F.lit(r"(?i)^\Q"), F.replace(title, F.lit(r"\E"), F.lit("")), F.lit(r"\E\s*(?:[-|:]\s*)?"))
    v = clean_value(location)
    bare = F.when(F.coalesce(title, F.lit("")) == "", "").otherwise(bind(v, lambda x: F.trim(F.regexp_replace(x, quoted, F.lit("")))))
    return F.coalesce(F.try_element_at(F.filter(F.transform(F.array(bare, v), clean_location), lambda x: x != ""), F.lit(1)), F.lit(""))


def near_title(c: Column, title: Column) -> Column:
    """The place that follows a title in a text, as it is written."""
    words = F.array_join(F.regexp_extract_all(clean_value(title), F.lit("([A-Za-z0-9]+)"), F.lit(1)), r"\W+")
    pattern = F.concat(F.lit("(?i:"), words, F.lit(rf")\s*([A-Z][A-Za-z.' -]{{1,80}},\s*(?:{ABBR}|[A-Z][A-Za-z ]{{2,30}}),\s*{US})\b"))
    return F.when(words == "", "").otherwise(F.call_function("regexp_extract", F.coalesce(c, F.lit("")), pattern, F.lit(1)))


def from_title(c: Column) -> Column:
    """struct<location, title> of titles that end in "in City" or "in City, ST"."""
    pattern = rf"\b(?:in|based in)\s+({CITY})(?:,\s*([A-Z]{{2}}))?$"

    def read(t):
        city, state = found(t, pattern, 1), found(t, pattern, 2)
        place = F.when(state != "", F.concat(city, F.lit(", "), state)).otherwise(F.coalesce(F.try_element_at(_map(TITLE_CITIES.items()), city), F.lit("")))
        rest = F.btrim(dropped(t, pattern), F.lit(" ,-"))
        return F.struct(place.alias("location"), F.when((place != "") & (rest != ""), rest).otherwise(t).alias("title"))

    return bind(clean_value(c), read)


def taleo_location(c: Column) -> Column:
    """City and state of "Location: Country-State-City", up to the next label, or of such a place in the United States."""
    labels = ["Industry", "Schedule", "Employee Status", "BusinessClass", "Job Posting"]
    bare = found(c, rf"(?i)\b({US}-[A-Za-z ]+-[A-Za-z ]+)")

    def read(raw):
        parts = F.split(raw, r"\s*-\s*")
        part = lambda k: F.coalesce(F.try_element_at(parts, F.lit(k)), F.lit(""))
        city = title_case(F.trim(found(part(3), "^([A-Za-z ]+)")))
        return bind(state_abbrev(part(2)), lambda state: F.when((state != "") & (city != ""), F.concat(city, F.lit(", "), state)).otherwise(""))

    return bind(F.array(after_label(c, "location", labels), bare), lambda x: first_filled(read(x[0]), read(x[1])))


def countries_hit(c: Column) -> Column:
    """The place between "Countries" and "Cities" of a programme's page, as it is written."""
    return bind(after_label(c, "countries", ["Cities"]), lambda v: F.when(F.length(v).between(2, 160), v).otherwise(""))


def workday_location(c: Column) -> Column:
    """The place after "Primary Location:" and before the next label."""
    stops = "Primary Location Full Time Salary Range|Full Time Salary Range|Salary Range|Job Family Group|Job Family|Time Type"
    raw = dropped(norm(found(c, rf"(?i)\bPrimary Location\s*:\s*(.+?)(?=\s+(?:{stops})\s*:)")), r"[-\s]+$")
    full = rf"(?i)^([A-Za-z][A-Za-z.' -]{{1,80}}?)\s+({'|'.join(sorted(STATES, key=len, reverse=True))})\s+{US}$"

    def read(t):
        city = found(t, full, 1)
        plain = F.when((F.upper(city) == city) | (F.lower(city) == city), title_case(city)).otherwise(city)
        return F.when(t.rlike(full), F.concat(plain, F.lit(", "), state_abbrev(found(t, full, 2)))).otherwise(t)

    return bind(raw, read)


def from_tokens(slug: Column) -> Column:
    """The place at the end of a link's words: "city-st", "city-state-name", a state."""
    city = rf"({'|'.join(LINK_CITIES)}|[a-z]+)"
    abbr = rf"(?:^|-){city}-({ABBR.lower()})$"
    name = "|".join(sorted((s.replace(" ", "-") for s in STATES), key=len, reverse=True))
    full = rf"(?:^|-)(?:{city}-)?({name})$"
    words = lambda x: title_case(F.replace(x, F.lit("-"), F.lit(" ")))

    def read(s):
        state = state_abbrev(F.replace(found(s, full, 2), F.lit("-"), F.lit(" ")))
        before = dropped(found(s, full, 1), r"^(?:jobs?|careers?|remote|apply)$")
        return first_of(
            [
                (s.rlike(abbr), F.concat(words(found(s, abbr, 1)), F.lit(", "), F.upper(found(s, abbr, 2)))),
                (s.rlike(full) & (before != ""), F.concat(words(before), F.lit(", "), state)),
                (s.rlike(full), state_name(state)),
            ],
            "",
        )

    return bind(F.lower(F.coalesce(slug, F.lit(""))), read)


def from_link(url: Column) -> Column:
    """The place that a link's path names: boroughs, "city-st", "state-united-states", "remote-state"."""
    p = path(url)
    slug = F.btrim(F.regexp_replace(F.lower(F.coalesce(F.try_url_decode(p), p)), r"[-/_]+", "-"), F.lit("-"))
    name = "|".join(sorted((s.replace(" ", "-") for s in STATES), key=len, reverse=True))

    def read(s):
        has = lambda w: F.concat(F.lit("-"), s, F.lit("-")).contains(f"-{w}-")
        abbr = rf"^(.*?-?(?:{'|'.join(LINK_CITIES)}|[a-z0-9.]+)-{ABBR.lower()})(?:-|$)"
        head = dropped(found(s, abbr), r"(?:^|-)(?:jobs?|careers?)(?=-[a-z]{2}$)")
        region = found(s, rf"(?:^|-)remote-({name}|usa|us)(?:-|$)")
        return first_of(
            [
                *((has(w), place) for w, place in LINK_PLACES),
                (s.rlike(abbr) & (from_tokens(head) != ""), from_tokens(head)),
                (s.rlike(rf"(?:^|-)(?:{name})-united-states(?:-|$)"), from_tokens(found(s, rf"^(.*?(?:{name}))-united-states(?:-|$)"))),
                (region.isin("usa", "us"), "United States"),
                (region != "", state_name(F.replace(region, F.lit("-"), F.lit(" ")))),
            ],
            "",
        )

    return bind(slug, read)
