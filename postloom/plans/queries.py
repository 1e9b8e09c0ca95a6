"""Registered queries of the posting engine and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions import quality as q
from postloom.functions import urls as u
from postloom.functions.salary import convert_salary, parse_salary
from postloom.operators import batches, history, tracker
from postloom.plans import boards, fields, flows, more

#: Posting records derived from the star schema; the same text runs on both engines.
POSTINGS = """
SELECT c_custkey AS id,
  CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN 'LinkedIn' WHEN c_custkey % 17 = 0 THEN concat(c_name, ' apply now') ELSE c_name END AS company,
  CASE WHEN c_custkey % 5 = 0 THEN 'Search jobs' WHEN c_custkey % 13 = 0 THEN '1,200+ Data Analyst jobs in Boston' WHEN c_custkey % 19 = 0 THEN c_name ELSE concat('Analyst ', c_mktsegment) END AS job_title,
  CASE WHEN c_custkey % 9 = 0 THEN 'Remote' WHEN c_custkey % 10 = 0 THEN 'n/a' ELSE n_name END AS location,
  CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 4 = 0 THEN 'Mix' ELSE 'Hybrid' END AS work_type,
  concat(CASE c_custkey % 6 WHEN 0 THEN 'https://www.linkedin.com/jobs/view/analyst-' WHEN 1 THEN 'https://boards.greenhouse.io/acme/jobs/' WHEN 2 THEN 'https://www.monster.com/job/' WHEN 3 THEN 'https://acme.wd1.myworkdayjobs.com/en/job/' WHEN 4 THEN 'https://careers.example.com/jobs/' ELSE 'https://hdr.taleo.net/job/' END, cast(1000000 + c_custkey % 400 AS varchar(20)), CASE WHEN c_custkey % 2 = 0 THEN '?utm_source=indeed&gh_src=x' ELSE '' END) AS job_link,
  CASE WHEN c_custkey % 8 = 0 THEN 'LinkedIn' ELSE '' END AS source,
  CASE WHEN c_custkey % 23 = 0 THEN 'HTTP 404 returned' WHEN c_custkey % 29 = 0 THEN 'timeout' ELSE '' END AS error,
  concat('$', cast(20 + c_custkey % 60 AS varchar(9)), CASE WHEN c_custkey % 4 = 1 THEN concat(' - $', cast(30 + c_custkey % 60 AS varchar(9))) ELSE '' END, CASE c_custkey % 5 WHEN 0 THEN ' per hour' WHEN 1 THEN ',000 a year' WHEN 2 THEN 'k/month' WHEN 3 THEN '' ELSE '/week plus bonus' END) AS salary
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(POSTINGS, customer=_table(spark, sf_dir, "customer"), nation=_table(spark, sf_dir, "nation"))


def _annotated(rows: DataFrame) -> DataFrame:
    c = F.col
    out = rows.withColumn("codes", q.issues(c("company"), c("job_title"), c("location"), c("work_type"), c("job_link"), c("source"), c("error"))).withColumn("reliability", q.reliability(c("job_link"), c("source")))
    out = out.withColumn("confidence_score", q.confidence_score(c("codes"), c("reliability")))
    return out.withColumn("confidence", q.confidence(c("confidence_score"), c("error")))


def url_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", u.url_key(F.col("url")).alias("url_key"), u.bare_host(F.col("url")).alias("host"))


def url_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _table(spark, sf_dir, "pages").select(F.lit(1).alias("batch_id"), F.col("url").alias("link"), F.col("page_id").alias("place"))
    return batches.admit(links).select("key", "link", "place", "times")


#: Links to lists and to postings of boards, and each posting's own.
LISTED = "CASE id % 9 WHEN 0 THEN concat('https://www.indeed.com/q-', id, '-jobs.html') WHEN 1 THEN concat('https://uk.linkedin.com/jobs/search/?keywords=', id) WHEN 2 THEN concat('https://www.linkedin.com/jobs/view/', id) WHEN 3 THEN concat('https://www.glassdoor.com/Job/ohio-', id, '-jobs-SRCH_1.htm') WHEN 4 THEN 'https://www.ziprecruiter.com/jobs/search/' WHEN 5 THEN concat('https://www.simplyhired.com/job/', id) WHEN 6 THEN 'https://www.monster.com/jobs/search?q=x' ELSE job_link END"


def source_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    link, old = F.col("job_link"), F.col("source")
    return postings(spark, sf_dir).select("id", u.platform(link).alias("platform"), u.application_portal(link, old).alias("application_portal"), u.found_on(link, None, old).alias("found_on"), u.is_search_page(F.expr(LISTED)).alias("is_search"))


def posting_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _annotated(postings(spark, sf_dir)).select("id", F.array_join("codes", ",").alias("issues"), "reliability", "confidence_score", "confidence")


def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _annotated(postings(spark, sf_dir)).select(F.explode("codes").alias("issue"), "confidence_score").groupBy("issue").agg(F.count("*").alias("n"), F.min("confidence_score").alias("least_score"))


def salary_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("salary")
    return postings(spark, sf_dir).select("id", parse_salary(s)["reason"].alias("reason"), convert_salary(s, "year").alias("yearly"), convert_salary(s, "hour", 20).alias("hourly"))


def work_type_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return postings(spark, sf_dir).select("id", q.default_work_type(c("work_type"), c("company"), c("job_title"), c("location"), c("error")).alias("work_type"))


def history_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers' postings as the history, and postings of all orders as the batch, some under tracking variants of the same links."""
    c, link = F.col, "concat('https://www.acme.com/jobs/', {0}, CASE WHEN {1} % 2 = 0 THEN '?utm_source=x' ELSE '/' END)"
    old = _table(spark, sf_dir, "customer").select(F.expr(link.format("c_custkey", "c_custkey")).alias("link"), c("c_custkey").alias("id"), F.lit(1).alias("created_at"), F.lit(1).alias("updated_at"), c("c_name").alias("company"))
    new = _table(spark, sf_dir, "orders").select(F.expr(link.format("o_custkey * 2", "o_orderkey")).alias("link"), F.when(c("o_orderkey") % 3 != 0, 2).alias("updated_at"), c("o_orderpriority").alias("company"), c("o_orderkey").alias("seq"))
    keyed = lambda df: df.withColumn("identity_key", history.identity(c("link"))).drop("link")
    return history.upsert(keyed(old), keyed(new)).select("identity_key", "id", "created_at", "updated_at", "company")


def history_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _annotated(postings(spark, sf_dir)).withColumn("history_status", q.history_status(F.lit("ready"), F.col("error"), F.col("codes"), F.lit(False)))
    found = history.search(rows.withColumn("updated_at", F.col("id") % 50), "AN", "ready")
    return history.page(found, 20, 5).select("id", "company", "location", "history_status")


def tracker_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers' links as the tracker, all orders' as jobs: known ones are skipped, of equal ones the first is added."""
    old = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row"), F.expr("concat('https://Acme.com/', c_custkey, '/') AS `Job link`"), F.col("c_name").alias("Company"))
    new = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.expr("concat('https://acme.com/', o_custkey * 2, '?a=', o_orderkey % 2) AS `Job link`").alias("Job link"), F.col("o_orderpriority").alias("Company"))
    new = new.withColumn("Job link", F.regexp_replace("Job link", "[?]a=0$", ""))
    return tracker.append(old, new).select("row", F.col("Job link").alias("link"), F.col("Company").alias("company"), "change")


def rejected_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links built from suppliers' keys: public, private, local and incomplete ones."""
    s = F.col("s_suppkey")
    link = F.concat(F.element_at(F.array(*map(F.lit, ["https://jobs.example.com/", "http://localhost/", "http://10.0.0.", "https://a.internal/", "ftp://x.example.com/", "https://me:pw@x.example.com/"])), (s % 6 + 1).cast("int")), s.cast("string"))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", u.url_problem(link).alias("problem"))


QUERIES = {f.__name__: f for f in (url_identity, url_admission, source_tracking, posting_quality, issue_counts, salary_conversion, work_type_default, history_upsert, history_search, tracker_append, rejected_links)} | more.QUERIES | boards.QUERIES | flows.QUERIES | fields.QUERIES

_P = "WITH p AS (" + POSTINGS.format(customer="customer", nation="nation") + ")"
_KEY = """{h} || CASE WHEN {p} = '' THEN '/' ELSE {p} END || CASE WHEN len({k}) > 0 THEN '?' || array_to_string({k}, '&') ELSE '' END"""
_URLS = """u AS (SELECT *, regexp_replace(lower(regexp_extract(link, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www[.]', '') AS h,
    rtrim(regexp_extract(link, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/') AS pa,
    list_sort([x for x in string_split(regexp_extract(link, '^[^?#]*[?]([^#]*)', 1), '&') if x <> '' and not regexp_matches(lower(x), '^(from|gh_src|ref|refid|source|src|trackingid|trk|utm_[^=]*)=')]) AS k FROM l),
  w AS (SELECT *, CASE WHEN h = 'linkedin.com' AND regexp_matches(pa, '/jobs/view/(.*-)?[0-9]{7,}$') THEN 'linkedin.com/jobs/view/' || regexp_extract(pa, '([0-9]{7,})$', 1) ELSE """ + _KEY.format(h="h", p="pa", k="k") + """ END AS url_key FROM u)"""
_PAGES = "WITH l AS (SELECT page_id, url AS link FROM pages), " + _URLS
_LINKS = _P + ", l AS (SELECT *, job_link AS link FROM p), " + _URLS
_HOST = "regexp_replace(regexp_extract(job_link, '^https://([^/]*)', 1), '^www[.]', '')"
_ISSUES = _P + """, i AS (SELECT *, CASE WHEN job_link LIKE '%monster.com%' THEN 'Limited' WHEN job_link LIKE '%linkedin.com%' THEN 'Okay'
    WHEN source = 'LinkedIn' AND (job_link LIKE '%example.com%' OR job_link LIKE '%taleo%') THEN 'Okay' ELSE 'Good' END AS reliability,
  list_sort([x for x in [
    CASE WHEN company = '' THEN 'missing_company' END,
    CASE WHEN location = 'n/a' THEN 'missing_location' END,
    CASE WHEN location = 'Remote' THEN 'location_looks_like_work_type' END,
    CASE WHEN company = 'LinkedIn' THEN 'generic_company' END,
    CASE WHEN job_title = 'Search jobs' OR job_title LIKE '1,200+%' OR job_title = company THEN 'generic_job_title' END,
    CASE WHEN job_title = 'Search jobs' OR job_title LIKE '1,200+%' THEN 'job_search_page' END,
    CASE WHEN company LIKE '%apply now' THEN 'company_looks_like_page_text' END,
    CASE WHEN work_type = 'Mix' THEN 'invalid_work_type' END,
    CASE WHEN work_type = '' AND (source = 'LinkedIn' OR job_link LIKE '%linkedin.com/%') THEN 'linkedin_work_type_hidden' END,
    CASE WHEN error LIKE 'HTTP 404%' THEN 'unavailable_posting' WHEN error <> '' THEN 'scrape_error' END] if x IS NOT NULL]) AS codes FROM p),
  f AS (SELECT code, penalty FROM (VALUES ('missing_company', 18), ('missing_job_title', 22), ('missing_location', 16), ('generic_company', 16), ('generic_job_title', 18), ('job_search_page', 42), ('company_looks_like_page_text', 18), ('location_looks_like_page_text', 14), ('location_looks_like_work_type', 14), ('invalid_work_type', 10), ('linkedin_work_type_hidden', 8), ('captured_page_review', 8), ('capture_low_confidence', 15), ('unavailable_posting', 28), ('scrape_error', 28), ('monster_search_page', 35)) AS t(code, penalty)),
  d AS (SELECT i.id, sum(penalty) AS lost FROM (SELECT id, unnest(codes) AS code FROM i) i JOIN f USING (code) GROUP BY i.id),
  s AS (SELECT i.*, CAST(greatest(0, 95 - CASE reliability WHEN 'Limited' THEN 18 WHEN 'Okay' THEN 8 ELSE 0 END - coalesce(lost, 0)) AS INTEGER) AS confidence_score FROM i LEFT JOIN d USING (id))"""

ORACLE_SQL = {
    **more.ORACLE_SQL,
    **boards.ORACLE_SQL,
    **flows.ORACLE_SQL,
    **fields.ORACLE_SQL,
    "url_identity": _PAGES + " SELECT page_id, url_key, h AS host FROM w",
    "url_admission": _PAGES + " SELECT url_key AS key, arg_min(link, page_id) AS link, min(page_id) AS place, count(*) AS times FROM w GROUP BY url_key",
    "source_tracking": _P + f""" SELECT id, CASE WHEN {_HOST} = 'linkedin.com' THEN 'linkedin' WHEN {_HOST} LIKE '%greenhouse.io' THEN 'greenhouse' WHEN {_HOST} = 'monster.com' THEN 'monster' WHEN {_HOST} LIKE '%myworkdayjobs.com' THEN 'workday' ELSE 'company_website' END AS platform,
        CASE WHEN {_HOST} = 'linkedin.com' THEN 'LinkedIn' WHEN {_HOST} LIKE '%greenhouse.io' THEN 'Greenhouse' WHEN {_HOST} = 'monster.com' THEN 'Monster' WHEN {_HOST} LIKE '%myworkdayjobs.com' THEN 'Workday' WHEN {_HOST} LIKE '%taleo.net' THEN 'Taleo' ELSE 'Company Website' END AS application_portal,
        CASE WHEN job_link LIKE '%utm_source=indeed%' THEN 'Indeed' WHEN source = 'LinkedIn' THEN 'LinkedIn' WHEN {_HOST} = 'linkedin.com' THEN 'LinkedIn' WHEN {_HOST} = 'monster.com' THEN 'Monster' ELSE 'N/A' END AS found_on,
        id % 9 IN (0, 1, 3, 4, 6) AS is_search FROM p""",
    "posting_quality": _ISSUES + """ SELECT id, array_to_string(codes, ',') AS issues, reliability, confidence_score,
        CASE WHEN error <> '' THEN 'Low' WHEN confidence_score >= 82 THEN 'High' WHEN confidence_score >= 58 THEN 'Medium' ELSE 'Low' END AS confidence FROM s""",
    "issue_counts": _ISSUES + " SELECT issue, count(*) AS n, min(confidence_score) AS least_score FROM (SELECT unnest(codes) AS issue, confidence_score FROM s) GROUP BY issue",
    "salary_conversion": _P + """, a AS (SELECT id, salary, id % 5 AS r, CAST(20 + id % 60 AS DOUBLE) AS x, CAST(30 + id % 60 AS DOUBLE) AS y, id % 4 = 1 AS two FROM p),
      b AS (SELECT *, CASE r WHEN 0 THEN x * 2080 WHEN 1 THEN (CASE WHEN two THEN x ELSE x * 1000 END) ELSE x * 12 * (CASE WHEN two THEN 1 ELSE 1000 END) END AS x40,
        CASE r WHEN 0 THEN y * 2080 WHEN 1 THEN y * 1000 ELSE y * 12000 END AS y40,
        CASE r WHEN 0 THEN x WHEN 1 THEN (CASE WHEN two THEN x ELSE x * 1000 END) / 1040 ELSE x * 12 * (CASE WHEN two THEN 1 ELSE 1000 END) / 1040 END AS x20,
        CASE r WHEN 0 THEN y WHEN 1 THEN y * 1000 / 1040 ELSE y * 12000 / 1040 END AS y20 FROM a),
      n AS (SELECT *, regexp_replace(regexp_replace(format('{:,.2f}', round(x20 + 1e-9, 2)), '0$', ''), '[.]0?$', '') AS s20, regexp_replace(regexp_replace(format('{:,.2f}', round(y20 + 1e-9, 2)), '0$', ''), '[.]0?$', '') AS t20 FROM b)
      SELECT id, CASE r WHEN 3 THEN 'missing_period' WHEN 4 THEN 'non_salary_compensation' END AS reason,
        CASE WHEN r >= 3 THEN salary ELSE CASE WHEN r = 1 THEN '' ELSE '~' END || '$' || format('{:,}', CAST(x40 AS BIGINT)) || CASE WHEN two THEN ' - $' || format('{:,}', CAST(y40 AS BIGINT)) ELSE '' END || '/year' END AS yearly,
        CASE WHEN r >= 3 THEN salary ELSE CASE WHEN r = 0 THEN '' ELSE '~' END || '$' || s20 || CASE WHEN two THEN ' - $' || t20 ELSE '' END || '/hour' END AS hourly FROM n""",
    "work_type_default": _P + " SELECT id, CASE WHEN work_type <> '' THEN work_type WHEN error <> '' OR company = '' OR location = 'n/a' THEN 'n/a' ELSE 'Onsite' END AS work_type FROM p",
    "history_upsert": """WITH o AS (SELECT c_custkey AS k, c_custkey AS id, c_name AS company FROM customer),
        n AS (SELECT o_custkey * 2 AS k, max(o_orderkey) AS last, min(o_orderkey) AS first FROM orders GROUP BY 1),
        v AS (SELECT n.k, n.first, CAST(CASE WHEN o_orderkey % 3 <> 0 THEN 2 END AS INTEGER) AS updated_at, o_orderpriority AS company FROM n JOIN orders ON o_orderkey = n.last),
        a AS (SELECT k, (SELECT max(id) FROM o) + row_number() OVER (ORDER BY first) AS id FROM n WHERE k NOT IN (SELECT k FROM o))
      SELECT 'url:acme.com/jobs/' || coalesce(o.k, v.k) AS identity_key, coalesce(o.id, a.id) AS id, CASE WHEN o.k IS NULL THEN v.updated_at ELSE 1 END AS created_at, CASE WHEN v.k IS NULL THEN 1 ELSE v.updated_at END AS updated_at, CASE WHEN v.k IS NULL THEN o.company ELSE v.company END AS company
      FROM o FULL JOIN v ON o.k = v.k LEFT JOIN a ON a.k = v.k""",
    "history_search": _ISSUES + """ SELECT id, company, location, 'ready' AS history_status FROM s WHERE error = '' AND len(codes) = 0
      AND (company ILIKE '%an%' OR job_title ILIKE '%an%' OR location ILIKE '%an%' OR work_type ILIKE '%an%' OR salary ILIKE '%an%' OR source ILIKE '%an%' OR job_link ILIKE '%an%') ORDER BY id % 50 DESC, id DESC LIMIT 20 OFFSET 5""",
    "tracker_append": """WITH j AS (SELECT o_orderkey AS seq, 'https://acme.com/' || (o_custkey * 2) || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '?a=1' END AS link, o_orderpriority AS company FROM orders),
        f AS (SELECT link, min(seq) AS seq, arg_min(company, seq) AS company FROM j GROUP BY link), k AS (SELECT * FROM f WHERE link NOT IN (SELECT 'https://acme.com/' || c_custkey FROM customer))
      SELECT c_custkey AS row, 'https://Acme.com/' || c_custkey || '/' AS link, c_name AS company, 'kept' AS change FROM customer
      UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY seq), link, company, 'added' FROM k""",
    "rejected_links": """SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN NULL WHEN 4 THEN 'The link must start with http:// or https://.' WHEN 5 THEN 'Links containing usernames or passwords are not supported.' ELSE 'Local and private network links are not allowed.' END AS problem FROM supplier""",
}
