"""Queries on queues, batches and results over time, built from orders and their lines, and their DuckDB SQL."""

from __future__ import annotations

from io import BytesIO
from zipfile import ZipFile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.operators import attempts, edits, snapshots
from postloom.sources import uploads
from postloom.sources.tables import spread, table
from postloom.streaming import issues, queues


def queue_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as requests to 25 queues that take three batches at a time, open for 3 to 22 days each: which are taken."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey % 25 AS queue", "o_orderkey AS batch", "cast(o_orderdate AS timestamp) AS ts", "cast(date_add(cast(o_orderdate AS date), cast(3 + o_orderkey % 20 AS int)) AS timestamp) AS until")
    return queues.admission(queues.events_of(rows, "queue", "batch", "ts", "until"), 3).selectExpr("queue", "batch_id", "accepted", "open")


def batch_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as batches of lines that begin when shipped and end when received; every fifth is cancelled 40 days after it was ordered."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS batch_id", "cast(o_orderdate AS timestamp) AS ordered")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey AS batch_id", "l_linenumber AS item", "l_shipdate", "date_add(cast(l_shipdate AS date), cast(3 + l_linenumber AS int)) AS received", "l_returnflag", "l_linestatus")
    moves = "stack(3, 'queued', ordered, IF(begins, 'running', NULL), cast(l_shipdate AS timestamp), IF(l_linestatus = 'F', IF(l_returnflag = 'R', 'failed', 'completed'), NULL), cast(received AS timestamp)) AS (state, ts)"
    known = lines.join(orders, "batch_id").selectExpr("*", "(l_linestatus = 'F' OR item % 2 = 1) AS begins")
    changes = known.selectExpr("batch_id", "item", moves).where("state IS NOT NULL")
    cancels = orders.where("batch_id % 5 = 0").selectExpr("batch_id", "ordered + INTERVAL 40 DAYS AS ts")
    return queues.batch_life(changes, cancels, 86_400 * 7)


#: Attempts at each customer's link: the first, the second and a plain reading, by the last digit of the key.
LINKS = "CASE c_custkey % 10 WHEN 0 THEN concat('https://www.linkedin.com/jobs/search/?keywords=', c_custkey) WHEN 9 THEN concat('https://www.monster.com/jobs/search?q=', c_custkey) ELSE concat('https://acme.example.com/jobs/', c_custkey) END"
TRIES = {
    1: ("c_name", "'Clerk'", "'Boston, MA'", "CASE c_custkey % 10 WHEN 2 THEN 'Timeout of 60 s' WHEN 3 THEN 'HTTP 404' WHEN 4 THEN 'timed out' WHEN 6 THEN 'timed out' WHEN 8 THEN 'net error' ELSE '' END"),
    2: ("concat(c_name, ' two')", "CASE WHEN c_custkey % 10 = 8 THEN '' ELSE 'Buyer' END", "CASE WHEN c_custkey % 10 IN (4, 6) THEN '' ELSE 'Denver, CO' END", "CASE c_custkey % 10 WHEN 4 THEN 'timed out' WHEN 6 THEN 'Page timeout' WHEN 8 THEN 'net error' ELSE '' END"),
}


def link_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result for each customer's link: whole at once, after a second attempt, after a terminal error, from a plain reading, or of a list."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("*", f"{LINKS} AS url", "c_custkey % 10 AS k")
    rest = ("'' AS work_type", "'' AS salary", "'Company Website' AS source")
    tried = None
    for n, (company, title, place, error) in TRIES.items():
        # the texts that make a difference: a failed reading holds no fields, one has no place, one the title of a list
        none = f"({error}) <> '' AND k <> 8"
        one = rows.selectExpr("url", f"{n} AS attempt", f"IF({none}, '', {company}) AS company", f"IF({none}, '', IF(k = 7, '1,200+ Data Analyst jobs in Boston', {title})) AS job_title", f"IF({none} OR k = 5, '', {place}) AS location", *rest, f"{error} AS error")
        tried = one if tried is None else tried.unionByName(one)
    plain = rows.where("k IN (2, 3, 4, 5, 6, 8)").selectExpr("url", "IF(k IN (4, 5), concat(c_name, ' plain'), '') AS company", "IF(k IN (4, 8), 'Plain clerk', '') AS job_title", "IF(k IN (4, 5), 'Austin, TX', '') AS location", "'Hybrid' AS work_type", "'' AS salary", "'' AS source")
    out = attempts.settled(tried, plain)
    return out.select("url", "company", "job_title", "location", "work_type", "salary", "source", "error", F.array_join("review_issues", ",").alias("issues"), "found_on", "application_portal")


def list_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items of snapshots in two versions, applied to lists of customers and then applied again; duplicates are updated."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_nationkey AS owner", "cast(c_custkey AS bigint) AS place", "concat('https://a.com/jobs/', c_custkey % 400) AS job_link", "c_name AS job", "c_custkey % 2 = 0 AS selected", "cast(NULL AS bigint) AS batch_id")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("cast(o_custkey % 25 AS int) AS owner", "cast(o_orderkey % 40 AS bigint) AS batch_id", "cast(o_orderkey AS bigint) AS item", "concat('https://www.a.com/jobs/', o_orderkey % 900, '?utm_source=x') AS url", "o_orderstatus")
    state = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN IF(version = 1, 'running', 'failed') ELSE 'queued' END"
    items = orders.selectExpr("*", "explode(array(1L, 2L)) AS version").selectExpr("owner", "batch_id", "version", "item", "url", f"{state} AS status", "cast(NULL AS string) AS job_link", "concat('v', version, ' ', item) AS job")
    none = spark.createDataFrame([], "owner int, batch_id bigint, item bigint")
    once, applied = snapshots.apply_snapshots(rows, items, none, "update")
    again, _ = snapshots.apply_snapshots(once, items, applied, "update")
    return again.select("owner", "place", "job_link", "job", "selected")


def _workbook(k: int) -> bytes | None:
    """An upload in one of eight states."""
    if k % 8 in (1, 2):
        return None if k % 8 == 1 else b"PK not an archive"
    raw = BytesIO()
    with ZipFile(raw, "w") as archive:
        for name in ("[Content_Types].xml", *(() if k % 8 == 3 else ("xl/workbook.xml",)), *(f"xl/{i}" for i in range(30 if k % 8 == 4 else k % 8))):
            archive.writestr(name, "x" * (5000 if k % 8 == 5 else 10))
    out = raw.getvalue()
    if k % 8 == 6:  # the flag of an encrypted member in its entry of the directory
        at = out.index(b"PK\x01\x02") + 8
        out = out[:at] + b"\x01" + out[at + 1 :]
    return out


def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upload of each supplier: missing, broken, no workbook, too many members, too large, encrypted, of another kind, or good."""

    def build(batches):
        for b in batches:
            yield b.assign(content=[_workbook(int(k)) for k in b["s_suppkey"]])

    names = "CASE WHEN s_suppkey % 8 = 7 AND s_suppkey % 3 = 0 THEN concat('dir.xlsx/', s_suppkey, '.csv') WHEN s_suppkey % 2 = 0 THEN concat(s_suppkey, '.XLSX') ELSE concat('a/', s_suppkey, '.xlsm') END AS path"
    files = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey", names).mapInPandas(build, "s_suppkey long, path string, content binary")
    return uploads.checked(files, most_bytes=20_000, most_members=20)


def issue_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the log holds of each customer's posting: hashed links, issues, bounded values and errors."""
    rows = spread(table(spark, sf_dir, "customer")).selectExpr(
        "IF(c_custkey % 9 = 0, NULL, concat(' https://User@WWW.Example', c_custkey % 5, '.com:81/p/', c_custkey)) AS url", "cast('2024-01-01' AS timestamp) AS ts", "repeat(c_name, 1 + c_custkey % 60) AS company", "IF(c_custkey % 4 = 0, '', 'Clerk') AS job_title",
        "IF(c_custkey % 5 = 0, NULL, 'Boston, MA') AS location", "'Mix' AS work_type", "'' AS salary", "'N/A' AS found_on", "'' AS application_portal", "'' AS source", "IF(c_custkey % 7 = 0, repeat('fail ', 500), '') AS error",
    )
    out = issues.records(rows)
    return out.select("domain", "url_hash", F.array_join("issues", ",").alias("issues"), F.col("result.company").alias("company"), F.col("result.location").alias("location"), F.length("technical_error").alias("error_length"))


#: Rows of a list, one of a customer: with errors, issues and missing fields, half of them edited.
LISTED = """c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS company, CASE WHEN c_custkey % 5 = 0 THEN 'n/a' ELSE 'Clerk' END AS job_title, CASE WHEN c_custkey % 3 = 0 THEN 'Remote' WHEN c_custkey % 11 = 0 THEN NULL ELSE 'Boston, MA' END AS location,
  CASE WHEN c_custkey % 4 = 0 THEN 'none' ELSE 'Hybrid' END AS work_type, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '$20' END AS salary, CASE WHEN c_custkey % 13 = 0 THEN 'timeout' ELSE '' END AS error, CASE WHEN c_custkey % 17 = 0 THEN 'check it' ELSE '' END AS review_notes, c_custkey % 6 = 1 AS manual, 'Low' AS confidence, 10 AS confidence_score,
  '' AS found_on, '' AS application_portal, '' AS source, CASE WHEN c_custkey % 19 = 0 THEN '' ELSE concat('https://www.linkedin.com/jobs/view/', c_custkey) END AS job_link, c_custkey % 2 = 0 AS edited"""


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"SELECT {LISTED} FROM {{customer}}", customer=spread(table(spark, sf_dir, "customer")))
    return rows.withColumn("review_issues", F.expr("IF(review_notes = '', array(), array('low_confidence'))").cast("array<string>"))


def edited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's row after the edited ones are approved."""
    out = edits.approved(_listed(spark, sf_dir))
    return out.select("id", "problem", "work_type", "salary", "error", F.size("review_issues").alias("n_issues"), "manual", "confidence", "confidence_score", "found_on", "application_portal")


def rows_to_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that trying all again tries, with their status."""
    return edits.to_retry(_listed(spark, sf_dir)).select("id", "list_status")


QUERIES = {f.__name__: f for f in (queue_admission, batch_life, link_results, list_snapshots, upload_checks, issue_log, edited_rows, rows_to_retry)}

ORACLE_SQL = {
    "queue_admission": """
      WITH RECURSIVE r AS (SELECT o_custkey % 25 AS queue, o_orderkey AS batch_id, CAST(o_orderdate AS DATE) AS t, CAST(o_orderdate AS DATE) + CAST(3 + o_orderkey % 20 AS INTEGER) AS until, row_number() OVER (PARTITION BY o_custkey % 25 ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
      s AS (SELECT DISTINCT queue, CAST(0 AS BIGINT) AS n, CAST([] AS DATE[]) AS held, CAST(NULL AS BIGINT) AS batch_id, false AS accepted, CAST(0 AS BIGINT) AS open FROM r
        UNION ALL SELECT r.queue, r.n, CASE WHEN len(list_filter(s.held, lambda x: x > r.t)) < 3 THEN list_append(list_filter(s.held, lambda x: x > r.t), r.until) ELSE list_filter(s.held, lambda x: x > r.t) END,
          r.batch_id, len(list_filter(s.held, lambda x: x > r.t)) < 3, len(list_filter(s.held, lambda x: x > r.t)) FROM s JOIN r ON r.queue = s.queue AND r.n = s.n + 1)
      SELECT queue, batch_id, accepted, open FROM s WHERE n > 0""",
    "batch_life": """
      WITH i AS (SELECT l_orderkey AS batch_id, l_linenumber AS item, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 40 DAY END AS asked,
          CASE WHEN l_linestatus = 'F' OR l_linenumber % 2 = 1 THEN CAST(l_shipdate AS TIMESTAMP) END AS begun0, CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS TIMESTAMP) + to_days(CAST(3 + l_linenumber AS INTEGER)) END AS ended, l_returnflag = 'R' AS bad FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
      d AS (SELECT batch_id, item, any_value(asked) AS asked, min(least(begun0, ended)) AS begun, min(ended) AS ended, struct_extract(min({'e': ended, 's': CASE WHEN bad THEN 'failed' ELSE 'completed' END}) FILTER (WHERE ended IS NOT NULL), 's') AS state FROM i GROUP BY batch_id, item),
      c AS (SELECT *, asked IS NOT NULL AND (begun IS NULL OR begun >= asked) AS stopped FROM d),
      b AS (SELECT batch_id, count(*) AS total, count(*) FILTER (WHERE NOT stopped AND ended IS NOT NULL AND state = 'completed') AS completed, count(*) FILTER (WHERE NOT stopped AND ended IS NOT NULL AND state = 'failed') AS failed,
          count(*) FILTER (WHERE stopped) AS cancelled, count(*) FILTER (WHERE begun IS NOT NULL AND NOT stopped) AS begun, max(CASE WHEN stopped THEN asked ELSE ended END) AS last, any_value(asked) AS asked FROM c GROUP BY batch_id),
      f AS (SELECT *, completed + failed + cancelled = total AS done FROM b), g AS (SELECT *, asked IS NOT NULL AND (NOT done OR asked <= last) AS cancel_requested FROM f)
      SELECT batch_id, CASE WHEN done AND cancel_requested THEN 'cancelled' WHEN done THEN 'completed' WHEN begun > 0 THEN 'running' ELSE 'queued' END AS status, total, completed, failed, cancelled, cancel_requested,
        CASE WHEN done THEN last END AS finished_at, CASE WHEN done THEN last + INTERVAL 7 DAY END AS expires_at FROM g""",
    "link_results": f"""WITH r AS (SELECT *, {LINKS} AS url, c_custkey % 10 AS k FROM customer)
      SELECT url, CASE WHEN k IN (0, 9, 3, 6, 7) THEN 'n/a' WHEN k = 2 THEN c_name || ' two' WHEN k = 4 THEN c_name || ' plain' WHEN k = 8 THEN c_name || ' two' ELSE c_name END AS company,
        CASE WHEN k IN (0, 9, 3, 6, 7) THEN 'n/a' WHEN k = 2 THEN 'Buyer' WHEN k IN (4, 8) THEN 'Plain clerk' ELSE 'Clerk' END AS job_title,
        CASE WHEN k IN (0, 9, 3, 6, 7) THEN 'n/a' WHEN k IN (2, 8) THEN 'Denver, CO' WHEN k IN (4, 5) THEN 'Austin, TX' ELSE 'Boston, MA' END AS location,
        CASE WHEN k IN (0, 9, 3, 7) THEN 'n/a' WHEN k IN (4, 5, 6, 8) THEN 'Hybrid' ELSE 'Onsite' END AS work_type, 'n/a' AS salary, CASE k WHEN 0 THEN 'LinkedIn' WHEN 9 THEN 'Monster' ELSE 'Company Website' END AS source,
        CASE k WHEN 9 THEN 'A Monster search page contains many jobs. Open the employer''s own posting and use that link instead.' WHEN 3 THEN 'This posting is unavailable or has expired.' WHEN 6 THEN 'The website took too long to respond. Try this job again.'
          WHEN 0 THEN 'This link opens a list of jobs. Open one specific posting and paste that link instead.' WHEN 7 THEN 'This link opens a list of jobs. Open one specific posting and paste that link instead.' ELSE '' END AS error,
        CASE k WHEN 0 THEN 'job_search_page' WHEN 9 THEN 'monster_search_page' WHEN 3 THEN 'missing_company,missing_job_title,missing_location,unavailable_posting' WHEN 6 THEN 'missing_company,missing_job_title,missing_location,scrape_error'
          WHEN 7 THEN 'job_search_page,missing_company,missing_job_title,missing_location,scrape_error' ELSE '' END AS issues,
        CASE k WHEN 0 THEN 'LinkedIn' WHEN 9 THEN 'Monster' ELSE 'N/A' END AS found_on, CASE k WHEN 0 THEN 'LinkedIn' WHEN 9 THEN 'Monster' ELSE 'Company Website' END AS application_portal FROM r""",
    "list_snapshots": """WITH r AS (SELECT c_nationkey AS owner, CAST(c_custkey AS BIGINT) AS place, 'https://a.com/jobs/' || (c_custkey % 400) AS job_link, c_custkey % 400 AS k, c_name AS job, c_custkey % 2 = 0 AS selected FROM customer),
      i AS (SELECT o_custkey % 25 AS owner, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END AS version, CAST(o_orderkey AS BIGINT) AS item, o_orderkey % 900 AS k, 'https://www.a.com/jobs/' || (o_orderkey % 900) || '?utm_source=x' AS url FROM orders WHERE o_orderstatus IN ('F', 'O')),
      f AS (SELECT owner, k, min(place) AS place FROM r GROUP BY ALL), m AS (SELECT i.*, f.place FROM i LEFT JOIN f ON f.owner = i.owner AND f.k = i.k),
      u AS (SELECT owner, place, max({'v': version, 'i': item, 'u': url}) AS x FROM m WHERE place IS NOT NULL GROUP BY ALL), e AS (SELECT owner, max(place) AS last FROM r GROUP BY 1)
      SELECT r.owner, r.place, coalesce(u.x.u, r.job_link) AS job_link, CASE WHEN u.x IS NULL THEN r.job ELSE 'v' || u.x.v || ' ' || u.x.i END AS job, r.selected FROM r LEFT JOIN u ON u.owner = r.owner AND u.place = r.place
      UNION ALL SELECT m.owner, coalesce(e.last, 0) + 1 + m.version * 1048576 + m.item, m.url, 'v' || m.version || ' ' || m.item, false FROM m LEFT JOIN e ON e.owner = m.owner WHERE m.place IS NULL""",
    "upload_checks": """SELECT CASE WHEN s_suppkey % 8 = 7 AND s_suppkey % 3 = 0 THEN 'dir.xlsx/' || s_suppkey || '.csv' WHEN s_suppkey % 2 = 0 THEN s_suppkey || '.XLSX' ELSE 'a/' || s_suppkey || '.xlsm' END AS path,
      CASE WHEN s_suppkey % 8 = 7 AND s_suppkey % 3 = 0 THEN 'Upload an .xlsx or .xlsm Excel workbook.' WHEN s_suppkey % 8 IN (1, 2, 3) THEN 'This file is not a readable Excel workbook.' WHEN s_suppkey % 8 = 4 THEN 'This workbook contains too many internal files.'
        WHEN s_suppkey % 8 = 5 THEN 'This workbook expands beyond the allowed size.' WHEN s_suppkey % 8 = 6 THEN 'Password-protected workbooks are not supported.' END AS problem FROM supplier""",
    "issue_log": """SELECT CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'www.example' || (c_custkey % 5) || '.com' END AS domain, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE sha256('https://User@WWW.Example' || (c_custkey % 5) || '.com:81/p/' || c_custkey) END AS url_hash,
      concat_ws(',', CASE WHEN length(c_name) * (1 + c_custkey % 60) > 55 THEN 'company_looks_like_page_text' END, 'invalid_work_type', CASE WHEN c_custkey % 4 = 0 THEN 'missing_job_title' END, CASE WHEN c_custkey % 5 = 0 THEN 'missing_location' END, CASE WHEN c_custkey % 7 = 0 THEN 'scrape_error' END) AS issues,
      substr(repeat(c_name, 1 + c_custkey % 60), 1, 500) AS company, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'Boston, MA' END AS location, CAST(CASE WHEN c_custkey % 7 = 0 THEN 2000 ELSE 0 END AS INTEGER) AS error_length FROM customer""",
    "edited_rows": f"""WITH r AS (SELECT {LISTED} FROM customer), m AS (SELECT *, concat_ws(', ', CASE WHEN company = '' THEN 'company' END, CASE WHEN job_title = 'n/a' THEN 'job title' END, CASE WHEN location IS NULL THEN 'location' END) AS lacks FROM r), g AS (SELECT *, edited AND lacks = '' AS good FROM m)
      SELECT id, CASE WHEN edited AND lacks <> '' THEN 'Add ' || lacks || ' first' END AS problem, CASE WHEN good AND work_type = 'none' THEN 'n/a' ELSE work_type END AS work_type, CASE WHEN good AND salary = '' THEN 'n/a' ELSE salary END AS salary, CASE WHEN good THEN '' ELSE error END AS error,
        CAST(CASE WHEN good OR review_notes = '' THEN 0 ELSE 1 END AS INTEGER) AS n_issues, good OR manual AS manual, CASE WHEN good THEN 'Manual' ELSE 'Low' END AS confidence, CASE WHEN good THEN 100 ELSE 10 END AS confidence_score,
        CASE WHEN NOT good THEN '' WHEN job_link = '' THEN 'N/A' ELSE 'LinkedIn' END AS found_on, CASE WHEN NOT good THEN '' WHEN job_link = '' THEN 'Company Website' ELSE 'LinkedIn' END AS application_portal FROM g""",
    "rows_to_retry": f"""WITH r AS (SELECT {LISTED} FROM customer), s AS (SELECT id, job_link, CASE WHEN error <> '' THEN 'error' WHEN manual AND company <> '' AND job_title <> 'n/a' AND location IS NOT NULL THEN 'ready' WHEN review_notes <> '' OR company = '' OR job_title = 'n/a' OR location IS NULL OR location = 'Remote' THEN 'review' ELSE 'ready' END AS list_status FROM r)
      SELECT id, list_status FROM s WHERE list_status <> 'ready' AND job_link <> ''""",
}
