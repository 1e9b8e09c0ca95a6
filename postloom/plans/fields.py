"""What texts and links of the tables' names, keys, amounts and dates say: salaries, places, work types, titles, links; and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions import hints, pay, places, text, urls, work
from postloom.sources import tables


def _of(spark: SparkSession, sf_dir: str, table: str, columns: str) -> DataFrame:
    return spark.sql(f"SELECT {columns} FROM {{t}}", t=tables.spread(tables.table(spark, sf_dir, table)))


def _case(by: str, *forms: str) -> str:
    return f"CASE {by} " + " ".join(f"WHEN {k} THEN {f}" for k, f in enumerate(forms)) + " END"


#: Amounts of an order: hourly ones, yearly ones in thousands, and the price.
AMOUNTS = "o_orderkey, o_orderkey % 12 AS form, CAST(20 + o_orderkey % 30 AS VARCHAR(9)) AS lo, CAST(55 + o_orderkey % 40 AS VARCHAR(9)) AS hi, CAST(o_custkey % 900 + 100 AS VARCHAR(9)) AS n"
SALARY_TEXTS = _case(
    "form", "concat('We pay $', lo, ',', n, ' - $', hi, ',000 per year plus a bonus for order ', o_orderkey)", "concat('Our hourly rate: $', lo, ' - $', hi, ' for all shifts')", "concat('You earn $', lo, '.50 per hour and more')", "concat('The pay is ', lo, 'k - ', hi, 'k')",
    "concat('A salary of $', hi, ',', n, ' annually')", "concat('We look after $', n, ',000,000 in assets')", "concat('Order ', o_orderkey, ' of customer ', n)", "concat('Pay: $', lo, '–$', lo, ' per hour')", "concat('Compensation is USD $', lo, ' to $', hi, '/hr')", "concat('A budget of $', n, ',000. Base salary: $', hi, ',', n, '. Bonus $', lo)",
    "concat('Wage ', lo, ',000 - ', hi, ',000 USD')", "NULL",
)


def salary_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first salary, and the one that words of pay stand by, in twelve kinds of sentences with the amounts of every order."""
    rows = _of(spark, sf_dir, "orders", AMOUNTS.replace("VARCHAR(9)", "STRING")).withColumn("t", F.expr(SALARY_TEXTS))
    found = rows.withColumns({"first": pay.extract_salary(F.col("t")), "paid": pay.contextual_salary(F.col("t"))})
    return found.select("o_orderkey", "first", "paid", pay.has_range(F.col("first")).alias("is_range"), pay.has_period(F.col("first")).alias("has_period"))


SPOTS = "c_custkey, c_custkey % 10 AS form, CASE c_custkey % 4 WHEN 0 THEN 'Austin' WHEN 1 THEN 'Salt Lake City' WHEN 2 THEN 'Albany' ELSE 'San Jose' END AS city, CASE c_custkey % 4 WHEN 0 THEN 'TX' WHEN 1 THEN 'UT' WHEN 2 THEN 'NY' ELSE 'CA' END AS st, CASE c_custkey % 4 WHEN 0 THEN 'Texas' WHEN 1 THEN 'Utah' WHEN 2 THEN 'New York' ELSE 'California' END AS state, c_name"
PLACE_TEXTS = _case(
    "form", "concat('Location: ', city, ', ', st)", "concat(upper(city), ', ', st, ' (Hybrid)')", "concat(city, ', ', state, ', United States')", "concat('based in ', city, ', ', st)", "concat(st, ' - ', city, ' - Office ', c_custkey, ', United States')",
    "concat('Remote - ', state)", "concat(city, ', ', st, ' - Remote')", "concat('Remote with ', c_name)", "'Full Time | Posted'", "NULL",
)


def place_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place that each of ten kinds of location texts names, whether it is broad, and what a sentence about two places names."""
    rows = _of(spark, sf_dir, "customer", SPOTS).withColumns({"t": F.expr(PLACE_TEXTS), "s": F.expr("concat('Offices of ', c_name, ' in ', city, ', ', st, ' and Boston, MA and Reno, NV.')")})
    return rows.select("c_custkey", places.clean_location(F.col("t")).alias("place"), places.is_broad(F.col("t")).alias("is_broad"), places.locations_in(F.col("s")).alias("named"))


KINDS = "o_orderkey, o_orderkey % 9 AS form, CASE o_custkey % 3 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Hybrid' ELSE 'On-site' END AS kind, CASE o_custkey % 3 WHEN 2 THEN 'Onsite' WHEN 1 THEN 'Hybrid' ELSE 'Remote' END AS shown, CASE o_custkey % 3 WHEN 0 THEN 'on-site' ELSE 'remote' END AS other, o_orderpriority"
KIND_TEXTS = _case(
    "form", "concat('Workplace type: ', kind, '. Others are ', other)", "concat('This role is ', lower(kind), '.')", "concat('Location: ', kind)", "concat('A ', lower(kind), ' position of priority ', o_orderpriority)", "concat('Order ', o_orderkey)",
    "concat('You may be eligible for remote work, order ', o_orderkey)", "concat('May be eligible for telework. This role is remote in order ', o_orderkey)", "'remote or on-site'", "NULL",
)


def work_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The work type behind a label, in a statement, behind any label, and by all words, in nine kinds of sentences."""
    rows = _of(spark, sf_dir, "orders", KINDS).withColumn("t", F.expr(KIND_TEXTS))
    t = F.col("t")
    return rows.select("o_orderkey", work.strong_label(t).alias("label"), work.statement(t).alias("statement"), work.labelled(t).alias("labelled"), work.extract_work_type(t).alias("words"), work.conflict(t).alias("conflict"))


NAMES = "c_custkey, c_custkey % 9 AS form, concat('North ', upper(substr(c_mktsegment, 1, 1)), lower(substr(c_mktsegment, 2))) AS employer, concat(CASE c_custkey % 3 WHEN 0 THEN 'AI' WHEN 1 THEN 'HR' ELSE 'Data' END, ' Clerk ', c_custkey) AS title, CASE c_custkey % 2 WHEN 0 THEN 'Remote' ELSE 'On-site' END AS kind"
TITLE_TEXTS = _case(
    "form", "concat(title, ' | LinkedIn')", "concat(employer, ' - ', title)", "concat(title, ' - ', employer, ' Inc')", "concat('Job Title: ', title, ' (', kind, ')')", "concat(title, ' - Fully ', kind, ', US')", "concat(title, ' in Remote')", "concat(title, ' &amp; Co')", "concat(replace(title, 'AI', 'Ai'), ' - Careers at ', employer)", "NULL",
)
COMPANY_TEXTS = _case(
    "form", "concat('Company: ', employer)", "concat(employer, ' 4.2 out of 5 stars')", "concat('©2024 ', employer, ', all rights reserved')", "concat(employer, ' Careers')", "concat('LE0', c_custkey % 10, ' ', employer)", "'twosigma'", "'n/a'", "concat(employer, ' &amp; Sons')", "NULL",
)
PAGE_TITLES = _case("form % 4", "concat('Job Application for ', title, ' at ', employer)", "concat(title, ' at ', employer, ' | Board')", "concat(title, ' | ', employer, ' Careers')", "concat(title, ' Job Details | ', employer)")


def title_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and employers as boards write them, and both out of page titles, with every customer's segment and key."""
    rows = _of(spark, sf_dir, "customer", NAMES).withColumns({"t": F.expr(TITLE_TEXTS), "c": F.expr(COMPANY_TEXTS), "p": F.expr(PAGE_TITLES)})
    return rows.select("c_custkey", text.clean_title(F.col("t"), F.col("employer")).alias("title"), text.clean_company(F.col("c")).alias("company"), text.company_from_page_title(F.col("p")).alias("page_company"), text.job_from_page_title(F.col("p")).alias("page_title"))


ADDRESSES = "c_custkey, c_custkey % 10 AS form, lower(c_mktsegment) AS slug, concat(upper(substr(c_mktsegment, 1, 1)), lower(substr(c_mktsegment, 2))) AS name"
LINKS = _case(
    "form", "concat('https://boards.greenhouse.io/', slug, '/jobs/', c_custkey)", "concat('https://jobs.lever.co/', slug, '-labs/', c_custkey)", "concat('https://www.linkedin.com/jobs/view/data-clerk-at-', slug, '-ai-', 1000000 + c_custkey)", "concat('https://', slug, '.wd5.myworkdayjobs.com/en/job/Boston/Clerk_', c_custkey)", "concat('https://careers.', slug, '.com/jobs/clerk-austin-tx-', c_custkey)",
    "concat('https://job-boards.greenhouse.io/embed?for=', slug, '-co&token=', c_custkey)", "concat('https://www.indeed.com/viewjob?jk=', c_custkey)", "concat('https://www.monster.com/job-openings/senior-clerk-jobs-in-jersey-city-nj--', lpad(c_custkey, 12, '0'))", "concat('https://', slug, '.com/jobs/clerk-remote-ohio')", "NULL",
)


def link_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What links say of employer, title and place, with every customer's segment and key in them."""
    rows = _of(spark, sf_dir, "customer", ADDRESSES).withColumn("url", F.expr(LINKS)).withColumn("hint", hints.link_hints(F.col("url")))
    or_none = lambda c: F.coalesce(c, F.lit(""))
    return rows.select("c_custkey", or_none(hints.company_from_link(F.col("url"))).alias("company"), or_none(F.col("hint.company")).alias("hint_company"), or_none(F.col("hint.job_title")).alias("hint_title"), or_none(places.from_link(F.col("url"))).alias("place"), or_none(urls.platform(F.col("url"))).alias("board"))


QUERIES = {f.__name__: f for f in (salary_texts, place_texts, work_texts, title_texts, link_texts)}

ORACLE_SQL = {
    "salary_texts": f"""WITH a AS (SELECT {AMOUNTS} FROM orders), f AS (SELECT o_orderkey, form, {_case('form', "'$' || lo || ',' || n || ' - $' || hi || ',000 per year'", "'$' || lo || ' - $' || hi || ' per hour'", "'$' || lo || '.50 per hour'", "lo || 'k - ' || hi || 'k'", "'$' || hi || ',' || n || ' annually'", "'$' || n || ',000,000'", "''", "'$' || lo || ' per hour'", "'USD $' || lo || ' - $' || hi || '/hr'", "'$' || n || ',000'", "lo || ',000 - ' || hi || ',000 USD'", "''")} AS first,
        {_case('form', "'$' || lo || ',' || n || ' - $' || hi || ',000 per year'", "'$' || lo || ' - $' || hi || ' per hour'", "'$' || lo || '.50 per hour'", "lo || 'k - ' || hi || 'k'", "'$' || hi || ',' || n || ' annually'", "''", "''", "'$' || lo || ' per hour'", "'USD $' || lo || ' - $' || hi || '/hr'", "'$' || hi || ',' || n", "lo || ',000 - ' || hi || ',000 USD'", "''")} AS paid FROM a)
      SELECT o_orderkey, first, paid, form IN (0, 1, 3, 8, 10) AS is_range, form IN (0, 1, 2, 4, 7, 8) AS has_period FROM f""",
    "place_texts": f"""WITH s AS (SELECT {SPOTS} FROM customer) SELECT c_custkey, {_case('form', *["city || ', ' || st"] * 5, "state", "city || ', ' || st", "'Remote'", "''", "''")} AS place, form = 9 AS is_broad, city || ', ' || st || ', Boston, MA' AS named FROM s""",
    "work_texts": f"""WITH k AS (SELECT {KINDS} FROM orders) SELECT o_orderkey, CASE WHEN form = 0 THEN shown ELSE '' END AS label, CASE form WHEN 1 THEN shown WHEN 6 THEN 'Remote' ELSE '' END AS statement, CASE WHEN form IN (0, 2, 3) THEN shown ELSE '' END AS labelled,
        CASE WHEN form = 0 THEN CASE WHEN shown = 'Hybrid' THEN 'Hybrid' ELSE '' END WHEN form IN (1, 2, 3) THEN shown WHEN form = 6 THEN 'Remote' ELSE '' END AS words, CASE form WHEN 0 THEN shown <> 'Hybrid' WHEN 7 THEN true ELSE false END AS conflict FROM k""",
    "title_texts": f"""WITH n AS (SELECT {NAMES} FROM customer) SELECT c_custkey, {_case('form', *["title"] * 6, "title || ' & Co'", "title", "''")} AS title, {_case('form', *["employer"] * 5, "'Two Sigma'", "''", "employer || ' & Sons'", "''")} AS company, CASE WHEN form % 4 < 2 THEN employer ELSE '' END AS page_company, CASE WHEN form % 4 >= 2 THEN title ELSE '' END AS page_title FROM n""",
    "link_texts": f"""WITH a AS (SELECT {ADDRESSES} FROM customer) SELECT c_custkey, {_case('form', "name", "name || ' Labs'", "''", "name", "name", "name || ' Co'", "''", "''", "name", "''")} AS company, CASE WHEN form = 2 THEN name || ' AI' ELSE '' END AS hint_company, CASE form WHEN 2 THEN 'Data Clerk' WHEN 7 THEN 'Senior Clerk' ELSE '' END AS hint_title,
        CASE form WHEN 4 THEN 'Austin, TX' WHEN 7 THEN 'Clerk, IN' WHEN 8 THEN 'Ohio' ELSE '' END AS place, {_case('form', "'greenhouse'", "'lever'", "'linkedin'", "'workday'", "'company_website'", "'greenhouse'", "'indeed'", "'monster'", "'company_website'", "'company_website'")} AS board FROM a""",
}
