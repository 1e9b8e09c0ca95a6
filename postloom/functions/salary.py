"""Salary parsing and conversion as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions.urls import first_of

# How periods, currencies and other pay are written.
PERIODS = {
    "hour": r"(?i)(?:/\s*(?:hours?|hrs?)\b|\b(?:per|an?)\s+(?:hours?|hrs?)\b|\bhourly\b)",
    "week": r"(?i)(?:/\s*(?:weeks?|wks?)\b|\b(?:per|a)\s+(?:weeks?|wks?)\b|\bweekly\b)",
    "month": r"(?i)(?:/\s*(?:months?|mos?)\b|\b(?:per|a)\s+(?:months?|mos?)\b|\bmonthly\b)",
    "year": r"(?i)(?:/\s*(?:years?|yrs?)\b|\b(?:per|a)\s+(?:years?|yrs?)\b|\b(?:annual|annually|yearly|annum)\b)",
}
SYMBOLS = {"USD": "$", "CAD": "$", "AUD": "$", "GBP": "£", "EUR": "€", "JPY": "¥", "INR": "₹"}
#: A number with thousands apart or together, and decimals.
NUMBER = r"\d+(?:,\d{3})*(?:\.\d+)?"
OTHER_PAY = r"(?i)\b(?:bonus|commission|equity|stock|options?|fixed[-\s]?price|project\s+budget|one[-\s]?time)\b"


def parse_salary(c: Column) -> Column:
    """struct<reason, amounts, code, symbol, period>; reason says why a text is not a salary, or is null."""
    text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.element_at(F.transform(F.transform(F.array(text), _parts), _parsed), 1)


def _parts(t: Column) -> Column:
    periods = F.filter(F.array(*(F.when(t.rlike(p), F.lit(k)) for k, p in PERIODS.items())), lambda x: x.isNotNull())
    codes = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"(?i)\b(USD|CAD|AUD|GBP|EUR|JPY|INR)\b"), F.lit(1)), F.upper))
    symbols = F.array_distinct(F.regexp_extract_all(t, F.lit("([$£€¥₹])"), F.lit(1)))
    amount = rf"((?:{NUMBER})\s*[kK]?)"
    return F.struct(t.alias("t"), periods.alias("periods"), codes.alias("codes"), symbols.alias("symbols"), F.regexp_extract_all(t, F.lit(amount), F.lit(1)).alias("found"))


def _parsed(x: Column) -> Column:
    t, periods, codes, symbols, found = (x[k] for k in ("t", "periods", "codes", "symbols", "found"))
    code, symbol = (F.coalesce(F.try_element_at(y, F.lit(1)), F.lit("")) for y in (codes, symbols))
    of_code = F.try_element_at(F.create_map(*(F.lit(x) for pair in SYMBOLS.items() for x in pair)), code)
    amounts = F.transform(found, lambda x: F.regexp_replace(x, r"[,\skK]", "").cast("double") * F.when(x.rlike("[kK]"), 1000.0).otherwise(1.0))
    reason = first_of(
        [
            (F.lower(t).isin("", "n/a", "none", "null"), "missing"),
            (t.rlike(OTHER_PAY), "non_salary_compensation"),
            (F.size(periods) == 0, "missing_period"),
            (F.size(periods) > 1, "mixed_periods"),
            ((F.size(codes) > 1) | (F.size(symbols) > 1) | ((code != "") & (symbol != "") & (of_code != symbol)), "mixed_currencies"),
            ((F.size(amounts) == 0) | (F.size(amounts) > 2), "unreadable_amount"),
        ],
        F.lit(None).cast("string"),
    )
    return F.struct(reason.alias("reason"), amounts.alias("amounts"), code.alias("code"), symbol.alias("symbol"), F.try_element_at(periods, F.lit(1)).alias("period"))


def convert_salary(c: Column, target: str, hours: float = 40.0) -> Column:
    """A salary by the hour or year, '~' where estimated; texts that are not salaries, and any with target "original", stay as they are."""
    if target == "original":
        return F.coalesce(c, F.lit(""))
    if target not in ("hour", "year"):
        raise ValueError("target is hour, year or original")
    hours = min(80.0, max(1.0, round(hours * 4) / 4))
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    once = F.struct(t.alias("t"), parse_salary(c).alias("p"))
    return F.element_at(F.transform(F.array(once), lambda x: _converted(x["t"], x["p"], target, hours)), 1)


def _converted(t: Column, p: Column, target: str, hours: float) -> Column:
    year = lambda x: x * F.when(p["period"] == "hour", hours * 52).when(p["period"] == "week", 52.0).when(p["period"] == "month", 12.0).otherwise(1.0)
    # format_number rounds half to even; amounts are brought to decimals half up first
    show = (lambda x: F.call_function("format_number", F.round((year(x) / (hours * 52)).cast("decimal(20,6)"), 2), F.lit("#,##0.##"))) if target == "hour" else (lambda x: F.call_function("format_number", F.round(year(x).cast("decimal(20,6)"), 0), F.lit("#,##0")))
    shown = F.transform(p["amounts"], show)
    prefix = F.when((p["code"] != "") & (p["symbol"] != ""), F.concat(p["code"], F.lit(" "), p["symbol"])).when(p["code"] != "", F.concat(p["code"], F.lit(" "))).otherwise(p["symbol"])
    value = F.element_at(F.transform(F.array(shown), lambda a: _written(p, prefix, F.try_element_at(a, F.lit(1)), F.try_element_at(a, F.lit(2)), target)), 1)
    return F.when(p["reason"].isNotNull(), F.when(t == "", "n/a").otherwise(t)).otherwise(value)


def _written(p: Column, prefix: Column, one: Column, two: Column, target: str) -> Column:
    return F.concat(F.when(p["period"] != target, "~").otherwise(""), prefix, one, F.when(two.isNotNull() & (two != one), F.concat(F.lit(" - "), p["symbol"], two)).otherwise(""), F.lit("/" + target))
