"""Queries on pages, payloads, captures, history, trackers and batches over the driver's tables, and their DuckDB SQL.

Inputs are built from the tables at query time, one row or more for each of theirs, so
that they grow with the tables; the SQL states the results independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions import quality, text
from postloom.operators import batches, captures, extraction, history, payloads, tracker
from postloom.sources.pages import evidence
from postloom.sources.tables import dealt, spread
from postloom.streaming.limits import judged


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quoted(x: object) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


#: A posting's page for each customer, in six forms.
PAGES = """
SELECT c_custkey AS page_id, concat('https://jobs.example', cast(c_custkey % 3 AS string), '.com/careers/', cast(c_custkey AS string)) AS url,
  CASE c_custkey % 6
    WHEN 0 THEN concat('<html><head><script type="application/ld+json">{"@graph":[{"@type":"Organization","name":"No"},{"@type":"JobPosting","title":"Analyst ', c_custkey, '","hiringOrganization":{"name":"', c_name, '"},"jobLocation":{"address":{"addressLocality":"Boston","addressRegion":"MA","addressCountry":"US"}},"baseSalary":{"currency":"USD","value":{"minValue":50000,"maxValue":60000,"unitText":"YEAR"}},"jobLocationType":"TELECOMMUTE","description":"<p>All the work.</p>"}]}</script></head><body><h1>Wrong</h1></body></html>')
    WHEN 1 THEN concat('<html><body><h1 class="job-title">Engineer ', c_custkey, '</h1><div class="company-name">', c_name, '</div><span data-testid="job-location">AUSTIN, TX</span><p>Workplace type: Hybrid. The pay range is $', 20 + c_custkey % 50, ' - $', 80 + c_custkey % 10, ' per hour.</p></body></html>')
    WHEN 2 THEN concat('<html><head><title>Clerk ', c_custkey, ' | ', c_name, ' Careers</title><meta property="og:site_name" content="', c_name, '"></head><body><main><p>Location: Denver, CO. This role is on-site.</p></main></body></html>')
    WHEN 3 THEN concat('<html><head><script id="__NEXT_DATA__" type="application/json">{"props":{"job":{"jobTitle":"Nurse ', c_custkey, '","companyName":"', c_name, '","jobLocation":"Chicago, IL","workplaceType":"remote"}}}</script></head><body><p>Join us.</p></body></html>')
    WHEN 4 THEN '<html><body><h1>Old</h1><p>This position has been filled.</p></body></html>'
    ELSE NULL END AS html
FROM CUSTOMERS
""".replace("{", "{{").replace("}", "}}").replace("CUSTOMERS", "{customer}")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PAGES, customer=spread(_table(spark, sf_dir, "customer")))


def page_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of built pages: embedded records, marked elements, titles and metas, application data, gone and null pages."""
    return extraction.extract_postings(evidence(_pages(spark, sf_dir))).select("page_id", "company", "job_title", "location", "work_type", "salary", "source", "error")


def public_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader sees of them, with issues, notes and confidence."""
    out = extraction.annotate(extraction.public_postings(extraction.extract_postings(evidence(_pages(spark, sf_dir)))))
    return out.select("page_id", "company", "location", "work_type", "salary", "found_on", "application_portal", F.array_join("review_issues", ",").alias("issues"), F.coalesce(F.try_element_at("review_details", F.lit(1))["field"], F.lit("")).alias("first_field"), "confidence_score", "confidence")


def driver_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that the driver's pages have: a title, and the employer by the host."""
    return extraction.extract_postings(evidence(spread(_table(spark, sf_dir, "pages")))).select("page_id", "company", "job_title", "error")


def posting_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that only point to a canonical page take that page's title; pages with null links, and pages that share a link, are there too."""
    rows = spread(_table(spark, sf_dir, "supplier")).selectExpr(
        "s_suppkey AS page_id",
        "CASE WHEN s_suppkey % 7 = 3 THEN NULL ELSE concat('https://a.example.com/p/', s_suppkey - IF(s_suppkey % 10 = 5, 4, 0)) END AS url",
        "CASE WHEN s_suppkey % 2 = 0 THEN concat('<link rel=\"canonical\" href=\"https://a.example.com/p/', s_suppkey - 1, '?utm_source=x\"><h1>Moved ', s_suppkey, '</h1>') ELSE concat('<h1>Job ', s_suppkey, '</h1>') END AS html",
    )
    pages = evidence(rows)
    return extraction.through_posting_links(pages).select("page_id", F.coalesce(F.try_element_at("marked", F.lit(1))["text"], F.lit("")).alias("heading"))


def merged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing fields filled from a second reading of the same link."""
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("url"), "c_custkey", "c_name")
    one = c.select("url", F.when(F.col("c_custkey") % 2 == 0, "n/a").otherwise(F.col("c_name")).alias("company"), *(F.lit(v).alias(k) for k, v in (("job_title", "Clerk"), ("location", ""), ("work_type", "Hybrid"), ("salary", "none"), ("source", "Dice"))))
    two = c.where("c_custkey % 5 <> 0").select("url", *(F.lit(v).alias(k) for k, v in (("company", "Other"), ("job_title", "No"), ("location", "Ohio"), ("work_type", "Remote"), ("salary", "null"), ("source", "Lever"))))
    return extraction.merge_results(one, two)


def _payload(spark: SparkSession, sf_dir: str, url: str, payload: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "supplier")).select("s_suppkey", F.expr(url).alias("url"), F.expr(payload).alias("payload"))


def greenhouse_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = """to_json(named_struct('company_name', case when s_suppkey % 3 = 0 then null else concat(s_name, ' Internship') end, 'title', concat('Analyst ', s_suppkey, ' (Remote)'), 'location', named_struct('name', case when s_suppkey % 4 = 0 then null else 'BOSTON, MA' end), 'content', '&lt;p&gt;Fully remote role.&lt;/p&gt;&lt;p&gt;Pay: $50,000 - $60,000 per year&lt;/p&gt;'))"""
    return payloads.greenhouse(_payload(spark, sf_dir, "concat('https://boards.greenhouse.io/acme-labs/jobs/', s_suppkey)", body)).drop("url")


def workday_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = """to_json(named_struct('jobPostingInfo', named_struct('title', concat('Analyst ', s_suppkey), 'location', case when s_suppkey % 2 = 0 then 'TX - Austin - Office 4' else '' end, 'remoteType', case when s_suppkey % 3 = 0 then 'Hybrid' else '' end, 'jobDescription', '<p>This role is remote.</p><p>Annual base salary: $90,000</p>', 'jobRequisitionLocation', named_struct('descriptor', 'Toronto', 'country', named_struct('descriptor', 'Canada'))), 'hiringOrganization', named_struct('name', s_name)))"""
    return payloads.workday(_payload(spark, sf_dir, "'https://acme.wd1.myworkdayjobs.com/x/job/1'", body)).drop("url")


def oracle_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = """to_json(named_struct('items', array(named_struct('Title', concat('Analyst ', s_suppkey), 'PrimaryLocation', 'Boston, MA, United States', 'WorkplaceTypeCode', 'ORA_HYBRID', 'ExternalDescriptionStr', 'The salary is $70,000 per year.', 'requisitionFlexFields', case when s_suppkey % 2 = 0 then array(named_struct('Prompt', 'Team', 'Value', '$1'), named_struct('Prompt', 'Pay range', 'Value', 'pay $20 - $30 per hour')) end))))"""
    return payloads.oracle(_payload(spark, sf_dir, "'https://jpmc.fa.oraclecloud.com/job/1'", body)).drop("url")


def smartrecruiters_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = """to_json(named_struct('name', concat('Analyst ', s_suppkey), 'company', named_struct('name', s_name), 'location', named_struct('city', 'Berlin', 'country', 'Germany', 'remote', s_suppkey % 2 = 0, 'hybrid', s_suppkey % 3 = 0), 'jobAd', named_struct('sections', map('a', named_struct('text', '<b>Office-based</b> work'), 'b', named_struct('text', 'Compensation: $10 per hour')))))"""
    return payloads.smartrecruiters(_payload(spark, sf_dir, "'https://jobs.smartrecruiters.com/acme/1'", body)).drop("url")


def captured_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured pages whose fields stand in tags, labels or lines of text, with evidence, options and issues."""
    s = """SELECT s_suppkey, concat('https://www.dice.com/job-detail/', s_suppkey) AS url, CASE WHEN s_suppkey % 2 = 0 THEN concat('Analyst ', s_suppkey, ' at ', 'Acme Labs | Dice.com') ELSE '' END AS page_title,
      CASE WHEN s_suppkey % 2 = 1 THEN concat('Sign in\nBuyer ', s_suppkey, '\nCompany\nGlobex\nBoston, MA\nPay: $30 - $40 per hour\nsign in') ELSE 'Cookie policy' END AS page_text, '' AS html,
      named_struct('headings', cast(array() AS array<string>), 'workTypeTags', CASE WHEN s_suppkey % 2 = 0 THEN array('Hybrid') ELSE array() END, 'labelPairs', CASE WHEN s_suppkey % 2 = 0 THEN array(named_struct('label', 'Location', 'value', 'Location\nAustin, TX'), named_struct('label', 'Base pay', 'value', '$50,000 - $60,000 per year')) ELSE cast(array() AS array<struct<label: string, value: string>>) END, 'headerBlocks', cast(array() AS array<string>), 'keywordLines', cast(array() AS array<string>)) AS candidates FROM {supplier}"""
    rows = evidence(spark.sql(s, supplier=spread(_table(spark, sf_dir, "supplier"))), keep=("s_suppkey", "url", "page_title", "page_text", "candidates"))
    out = captures.extract_captures(rows, ("s_suppkey", "url"))
    from_ = lambda f: F.coalesce(F.try_element_at("evidence", F.lit(f)), F.lit(""))
    return out.select("s_suppkey", "company", "job_title", "location", "work_type", "salary", from_("company").alias("company_from"), from_("location").alias("location_from"), F.array_join("review_issues", ",").alias("issues"), "confidence_score", F.array_join(F.try_element_at("field_options", F.lit("location")), ";").alias("places"))


def capture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of texts, cleaned and each once."""
    rows = spread(_table(spark, sf_dir, "supplier")).select("s_suppkey", F.expr("concat(' ', s_name, '\nApply now\n', lower(s_name), '\n\nLocation: Boston\nCookie settings\nRow ', s_suppkey % 5)").alias("t"))
    return rows.select("s_suppkey", F.array_join(text.lines_of(F.col("t")), "|").alias("lines"))


def review_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes and details for each pair of issues."""
    codes = F.array_sort(F.array(F.element_at(F.array(*map(F.lit, sorted(quality.GUIDANCE))), (F.col("s_suppkey") % len(quality.GUIDANCE) + 1).cast("int")), F.lit("odd_code")))
    d = quality.review_details(codes)
    return _table(spark, sf_dir, "supplier").select("s_suppkey", quality.review_notes(codes).alias("notes"), F.array_join(F.transform(d, lambda x: F.concat_ws("/", x["label"], x["field"], x["action"])), "; ").alias("details"))


_JOB = "concat('https://acme.com/jobs/', cast(c_custkey % 700 AS {0}), CASE WHEN c_custkey % 2 = 0 THEN '?utm_source=x' ELSE '' END)"


def history_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded texts and reasons for refusal."""
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.expr("CASE c_custkey % 4 WHEN 0 THEN concat('https://a.com/', c_custkey) WHEN 1 THEN 'javascript:x' ELSE '' END AS job_link"), F.expr("concat('  ', c_name, repeat('y', 600)) AS company"), F.expr("CASE WHEN c_custkey % 4 = 3 THEN '' ELSE 'Clerk' END AS job_title"), F.expr("c_custkey - 20 AS confidence_score"), F.expr("transform(sequence(1, 30), x -> concat(' i', x)) AS review_issues"))
    return history.sanitize(rows).select("c_custkey", "job_link", F.length("company").alias("n_company"), "confidence_score", F.size("review_issues").alias("n_issues"), "problem")


def history_manual_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of rows with and without a link."""
    c = F.col
    return _table(spark, sf_dir, "customer").select("c_custkey", history.identity(F.when(c("c_custkey") % 2 == 0, F.concat(F.lit("https://www.acme.com/jobs/"), c("c_custkey").cast("string"), F.lit("/"))), F.lit("01/02/2024"), c("c_name"), F.lit(" Clerk "), None).alias("key"))


def history_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select(F.col("c_name").alias("company"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'review' ELSE 'ready' END AS history_status"), F.expr("concat('50% of ', c_mktsegment) AS salary"))
    return history.counts(rows, "0% OF b", "ready")


def history_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a list of ids with repeats deletes."""
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    ids = _table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("id"))
    left = history.delete(rows, ids).agg(F.count("*").alias("kept"))
    return history.deleted_count(rows, ids).join(F.broadcast(left), F.lit(True))


def history_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older rows get found_on and application_portal."""
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", F.expr("CASE s_suppkey % 3 WHEN 0 THEN 'https://acme.wd1.myworkdayjobs.com/x/job/1' WHEN 1 THEN 'https://www.dice.com/job/1' ELSE 'https://acme.com/1?ref=handshake' END AS job_link"), F.expr("CASE WHEN s_suppkey % 2 = 0 THEN 'LinkedIn' ELSE '' END AS source"))
    return history.migrate(rows).select("s_suppkey", "found_on", "application_portal")


def applied_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of orders in two formats, and texts that are none."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "soon").when(F.col("o_orderkey") % 4 == 1, "").when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "M/d/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"))
    x = history.applied_date(F.col("d"))
    return o.select("o_orderkey", x["date"].alias("date"), x["problem"].alias("problem"))


def _tracker(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A tracker of all customers' links, and all orders' jobs for links of which it holds a part."""
    old = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row"), F.expr("CASE WHEN c_custkey % 10 = 0 THEN '' ELSE concat('https://Acme.com/Jobs/', cast(c_custkey % 500 AS string), CASE WHEN c_custkey % 2 = 0 THEN '/' ELSE '' END) END AS `Job link`"), F.col("c_name").alias("Company"), F.lit("mine").alias("Notes"))
    new = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.expr("CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE concat(' https://acme.com/jobs/', cast(o_custkey % 900 AS string)) END AS `Job link`"), F.concat(F.lit("C"), F.col("o_orderkey").cast("string")).alias("Company"))
    return old, new


def tracker_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each known link is rewritten in place; new links are added behind."""
    return tracker.append(*_tracker(spark, sf_dir), mode="update").select("row", F.trim("Job link").alias("link"), "Company", "Notes", "change")


def tracker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _tracker(spark, sf_dir)
    return tracker.append_counts(old, new)


def tracker_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old trackers with a Source column; own columns stay."""
    s = "SELECT s_suppkey AS row, s_name AS Company, concat('https://acme.wd1.myworkdayjobs.com/x/job/', s_suppkey) AS `Job link`, CASE WHEN s_suppkey % 2 = 0 THEN 'LinkedIn' ELSE '' END AS Source, CASE WHEN s_suppkey % 5 = 0 THEN 'Referral' END AS `Found On`, 'x' AS Mine FROM {supplier}"
    return tracker.migrate(spark.sql(s, supplier=_table(spark, sf_dir, "supplier"))).select("row", "Company", "Found On", "Application Portal", "Mine")


def tracker_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header rows of a sheet for each supplier."""
    s = "SELECT concat('s', s_suppkey) AS sheet, s_suppkey AS sheet_no, r AS row, c AS col, CASE WHEN r = 1 + s_suppkey % 3 THEN element_at(array('Employer', 'URL', 'Position', 'Company', 'x'), c) WHEN c = 1 THEN 'Company' ELSE 'text' END AS value FROM {supplier} LATERAL VIEW explode(sequence(1, 4)) t AS r LATERAL VIEW explode(sequence(1, 5)) u AS c"
    return tracker.resolve_headers(spark.sql(s, supplier=_table(spark, sf_dir, "supplier"))).select("sheet", "row", "header", "col")


def tracker_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs as rows of the tracker, with defaults."""
    jobs = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise("").alias("date_applied"), F.when(F.col("o_orderkey") % 2 == 0, "Acme").alias("company"), F.lit("https://jobs.lever.co/acme/1").alias("job_link"))
    return tracker.job_row(jobs, "2024-05-06").select("seq", F.col("Date Applied").alias("day"), F.col("Company").alias("company"), F.col("Salary Range").alias("salary"), F.col("Status").alias("status"), F.col("Found On").alias("found_on"), F.col("Application Portal").alias("portal"))


def column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.column_widths(_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"))


def input_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting rows of an input sheet, against the applications and each other."""
    sheet = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), F.expr("concat(' https://a.com/', o_custkey % 800) AS `Job Link`"), F.expr("element_at(array('', ' Pending', 'done', null), cast(o_orderkey % 4 + 1 AS int)) AS `Process Status`"))
    there = _table(spark, sf_dir, "customer").select(F.expr("concat('https://a.com/', c_custkey * 2) AS link"))
    return tracker.pending(sheet, there).select("row", "link", "duplicate")


def pasted_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, repeats and invalid links of pasted texts."""
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", F.expr("concat('Look: https://a.com/', s_suppkey, '. and https://www.a.com/', s_suppkey, '?utm_source=b, http://localhost/x', CASE WHEN s_suppkey % 2 = 0 THEN ' https://b.com/1' ELSE '' END) AS text"))
    return batches.parsed_links(rows, "s_suppkey")


def merged_pastes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", F.expr("concat('https://a.com/', s_suppkey, ' https://a.com/new http://10.0.0.1/ https://a.com/new?src=1') AS text"))
    old = _table(spark, sf_dir, "supplier").select("s_suppkey", F.expr("concat('https://a.com/', s_suppkey) AS text"))
    return batches.merged_links(old, rows, "s_suppkey")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("item"), F.col("l_returnflag").alias("flag"))
    l = dealt(l, "batch_id")
    last = F.when(F.col("flag") == "N", F.lit(None).cast("string")).when(F.col("flag") == "R", "failed").otherwise("completed")
    states = F.array(F.struct(F.lit(1).alias("ts"), F.lit("queued").alias("state")), F.struct((F.col("item") * 10).alias("ts"), F.lit("running").alias("state")), F.struct((F.col("item") * 10 + 5).alias("ts"), last.alias("state")))
    return l.select("batch_id", "item", F.explode(states).alias("x")).select("batch_id", "item", "x.*").where("state is not null")


def batch_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of all order lines as items of batches, of which each tenth was cancelled after its second item began."""
    asked = _table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("batch_id"), F.lit(25).alias("cancelled_at"))
    return batches.snapshot(batches.item_states(_changes(spark, sf_dir), cancelled=asked))


def retained_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active and retained batches after expiry."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate").cast("timestamp")).alias("finished_at"))
    return batches.queue_stats(batches.retained(o, "1996-06-01 00:00:00", 86_400 * 365))


def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as requests, three an hour for each user and kind."""
    e = _table(spark, sf_dir, "events").select(F.col("event_type").alias("scope"), F.col("user_id").alias("client"), "ts")
    return judged(e, 3, 3600).groupBy("client", "allowed").agg(F.count("*").alias("n"))


_FUNCTIONS = (page_extraction, public_postings, driver_pages, posting_hops, merged_results, greenhouse_payloads, workday_payloads, oracle_payloads, smartrecruiters_payloads, captured_pages, capture_lines, review_guidance, history_sanitize, history_manual_keys, history_counts, history_delete, history_backfill, applied_dates, tracker_update, tracker_counts, tracker_migration, tracker_headers, tracker_rows, column_widths, input_sheet, pasted_links, merged_pastes, batch_snapshots, retained_batches, rate_limits)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_LINK = "'https://acme.com/jobs/'"
_FIELD = "CASE c_custkey % 6 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} WHEN 3 THEN {3} WHEN 4 THEN {4} ELSE {5} END"
_HOSTED = "'Example' || (c_custkey % 3)"
_PAGE = {
    "company": _FIELD.format("c_name", "c_name", "c_name", "c_name", "''", _HOSTED),
    "job_title": _FIELD.format("'Analyst ' || c_custkey", "'Engineer ' || c_custkey", "'Clerk ' || c_custkey", "'Nurse ' || c_custkey", "''", "''"),
    "location": _FIELD.format("'Boston, MA'", "'Austin, TX'", "'Denver, CO'", "'Chicago, IL'", "''", "''"),
    "work_type": _FIELD.format("'Remote'", "'Hybrid'", "'Onsite'", "'Remote'", "''", "''"),
    "salary": _FIELD.format("''", "'$' || (20 + c_custkey % 50) || ' - $' || (80 + c_custkey % 10) || ' per hour'", "''", "''", "''", "''"),
}
_TRACK = """o AS (SELECT c_custkey AS row, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE 'https://Acme.com/Jobs/' || (c_custkey % 500) || CASE WHEN c_custkey % 2 = 0 THEN '/' ELSE '' END END AS link, c_name AS company FROM customer),
  j AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE 'https://acme.com/jobs/' || (o_custkey % 900) END AS link, 'C' || o_orderkey AS company FROM orders),
  lr AS (SELECT lower(rtrim(link, '/')) AS k, max(row) AS row FROM o WHERE link <> '' GROUP BY 1),
  lj AS (SELECT lower(rtrim(link, '/')) AS k, arg_max(link, seq) AS link, arg_max(company, seq) AS company, min(seq) AS first_seq, count(*) AS n FROM j WHERE link <> '' GROUP BY 1)"""

ORACLE_SQL = {
    "page_extraction": "SELECT c_custkey AS page_id, " + ", ".join(f"{v} AS {k}" for k, v in _PAGE.items()) + ", 'Company Website' AS source, CASE WHEN c_custkey % 6 = 4 THEN 'This job posting is no longer available.' ELSE '' END AS error FROM customer",
    "posting_hops": """WITH p AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 3 THEN NULL ELSE s_suppkey - CASE WHEN s_suppkey % 10 = 5 THEN 4 ELSE 0 END END AS own, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey - 1 END AS target,
        CASE WHEN s_suppkey % 2 = 0 THEN 'Moved ' ELSE 'Job ' END || s_suppkey AS heading FROM supplier), o AS (SELECT own, arg_min(heading, id) AS heading FROM p WHERE own IS NOT NULL GROUP BY own)
      SELECT p.id AS page_id, coalesce(o.heading, p.heading) AS heading FROM p LEFT JOIN o ON p.target = o.own AND p.target IS DISTINCT FROM p.own""",
    "merged_results": "SELECT CAST(c_custkey AS VARCHAR) AS url, CASE WHEN c_custkey % 2 = 1 THEN c_name WHEN c_custkey % 5 = 0 THEN 'n/a' ELSE 'Other' END AS company, 'Clerk' AS job_title, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'Ohio' END AS location, 'Hybrid' AS work_type, 'none' AS salary, 'Dice' AS source FROM customer",
    "greenhouse_payloads": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Acme Labs' ELSE s_name END AS company, 'Boston, MA' AS location, 'Analyst ' || s_suppkey AS job_title, 'Remote' AS work_type, '$50,000 - $60,000 per year' AS salary, 'Greenhouse' AS source FROM supplier WHERE s_suppkey % 4 <> 0",
    "workday_payloads": "SELECT s_suppkey, s_name AS company, 'Analyst ' || s_suppkey AS job_title, CASE WHEN s_suppkey % 2 = 0 THEN 'Austin, TX' ELSE 'Toronto, Canada' END AS location, CASE WHEN s_suppkey % 3 = 0 THEN 'Hybrid' ELSE 'Remote' END AS work_type, '$90,000' AS salary, 'Workday' AS source FROM supplier",
    "oracle_payloads": "SELECT s_suppkey, 'JPMorgan Chase & Co.' AS company, 'Analyst ' || s_suppkey AS job_title, 'Boston, MA' AS location, 'Hybrid' AS work_type, CASE WHEN s_suppkey % 2 = 0 THEN '$20 - $30 per hour' ELSE '$70,000 per year' END AS salary, 'Company Website' AS source FROM supplier",
    "smartrecruiters_payloads": "SELECT s_suppkey, s_name AS company, 'Analyst ' || s_suppkey AS job_title, 'Berlin, Germany' AS location, CASE WHEN s_suppkey % 3 = 0 THEN 'Hybrid' WHEN s_suppkey % 2 = 0 THEN 'Remote' ELSE 'Onsite' END AS work_type, '$10 per hour' AS salary, 'SmartRecruiters' AS source FROM supplier",
    "capture_lines": "SELECT s_suppkey, s_name || '|Boston|Row ' || (s_suppkey % 5) AS lines FROM supplier",
    "review_guidance": """WITH g AS (SELECT * FROM (VALUES
        (0, 'capture_low_confidence', 'The capture did not have clear labels for these fields.', 'Capture needs a closer look/Captured row/Choose one of the suggestions or type the correct value.'),
        (1, 'captured_page_review', 'The browser capture may include extra site text.', 'Check this browser capture/Captured row/Remove any menu, button, or footer text that slipped into the fields.'),
        (2, 'company_looks_like_page_text', 'Company may be copied from page text.', 'Company has extra text/Company/Keep only the employer name.'),
        (3, 'generic_company', 'Company name looks too generic.', 'Company too generic/Company/Replace the job-board name with the real employer.'),
        (4, 'generic_job_title', 'Job title looks like a blocked or generic page.', 'Title too generic/Job title/Replace blocked-page text with the real role title.'),
        (5, 'invalid_work_type', 'Work type should be Remote, Hybrid, Onsite, or n/a.', 'Work type invalid/Work Type/Use Remote, Hybrid, Onsite, or n/a.'),
        (6, 'job_search_page', 'This link opened a list of jobs instead of one posting.', 'Job list link/Link/Open one specific job posting and paste that link instead.'),
        (7, 'linkedin_work_type_hidden', 'LinkedIn hid the work type from its public page.', 'Work type hidden/Work Type/Open the signed-in LinkedIn posting and use browser capture to read the visible tag.'),
        (8, 'location_looks_like_page_text', 'Location may include extra page text.', 'Location has extra text/Location/Keep only the city/state/country.'),
        (9, 'location_looks_like_work_type', 'Location may be a work type instead of a place.', 'Location looks wrong/Location/Move Remote/Hybrid/Onsite to Work Type and enter the actual place if listed.'),
        (10, 'low_confidence', 'This row is not certain.', 'Needs a closer look/Row/Check this row before saving it.'),
        (11, 'missing_company', 'Company is missing.', 'Company missing/Company/Open the posting and fill in the employer name.'),
        (12, 'missing_job_title', 'Job title is missing.', 'Job title missing/Job title/Open the posting and fill in the role title.'),
        (13, 'missing_location', 'Location is missing.', 'Location missing/Location/Fill in the location if the posting shows one.'),
        (14, 'monster_search_page', 'Monster search pages show many jobs at once. Use the employer/company link from Monster instead.', 'Monster unsupported/Link/Use the employer/company job page that Monster opens.'),
        (15, 'scrape_error', 'The page could not be read.', 'Page could not be read/Link/Retry, use browser capture, or fix the fields yourself and choose the checkmark.'),
        (16, 'unavailable_posting', 'The posting is unavailable or has expired.', 'Posting unavailable/Link/Remove this row or replace the link with an active posting.')) AS t(k, code, note, detail))
      SELECT s_suppkey, CASE WHEN code < 'odd_code' THEN note || ' odd code' ELSE 'odd code ' || note END AS notes, CASE WHEN code < 'odd_code' THEN detail || '; Odd Code/Row/Review this row.' ELSE 'Odd Code/Row/Review this row.; ' || detail END AS details FROM supplier JOIN g ON s_suppkey % 17 = k""",
    "history_sanitize": """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'https://a.com/' || c_custkey WHEN 1 THEN 'javascript:x' ELSE '' END AS job_link, 500 AS n_company, CAST(greatest(0, least(100, c_custkey - 20)) AS INTEGER) AS confidence_score, 20 AS n_issues,
      CASE c_custkey % 4 WHEN 1 THEN 'History can only save complete http:// or https:// job links.' WHEN 3 THEN 'A history row needs a job link or a company and job title.' END AS problem FROM customer""",
    "history_manual_keys": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'url:acme.com/jobs/' || c_custkey ELSE 'manual:' || sha256('01/02/2024' || chr(10) || lower(c_name) || chr(10) || 'clerk' || chr(10)) END AS key FROM customer",
    "history_counts": "SELECT count(*) FILTER (WHERE c_custkey % 3 <> 0 AND c_mktsegment ILIKE 'b%') AS total, count(*) AS all_count FROM customer",
    "history_delete": "SELECT count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey * 2 FROM orders)) AS deleted, count(*) FILTER (WHERE c_custkey NOT IN (SELECT o_custkey * 2 FROM orders)) AS kept FROM customer",
    "history_backfill": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN 'Handshake' WHEN s_suppkey % 2 = 0 THEN 'LinkedIn' WHEN s_suppkey % 3 = 1 THEN 'Dice' ELSE 'N/A' END AS found_on, CASE s_suppkey % 3 WHEN 0 THEN 'Workday' WHEN 1 THEN 'Dice' ELSE 'Company Website' END AS application_portal FROM supplier",
    "applied_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN '' ELSE strftime(o_orderdate, '%m/%d/%Y') END AS date, CASE WHEN o_orderkey % 4 = 0 THEN 'Choose a valid application date.' END AS problem FROM orders",
    "tracker_update": "WITH " + _TRACK + """, a AS (SELECT first_seq AS seq, link, company FROM lj WHERE k NOT IN (SELECT k FROM lr) UNION ALL SELECT seq, link, company FROM j WHERE link = '')
      SELECT o.row, CASE WHEN lj.k IS NULL THEN o.link ELSE lj.link END AS link, CASE WHEN lj.k IS NULL THEN o.company ELSE lj.company END AS "Company", 'mine' AS "Notes", CASE WHEN lj.k IS NULL THEN 'kept' ELSE 'updated' END AS change FROM o LEFT JOIN lr ON o.row = lr.row LEFT JOIN lj ON lj.k = lr.k
      UNION ALL SELECT (SELECT max(row) FROM o) + row_number() OVER (ORDER BY seq), link, company, NULL, 'added' FROM a""",
    "tracker_counts": "WITH " + _TRACK + ", b AS (SELECT (SELECT count(*) FROM j WHERE link = '') + (SELECT count(*) FROM lj WHERE k NOT IN (SELECT k FROM lr)) AS added) SELECT added, (SELECT count(*) FROM j) - added AS skipped, CAST(0 AS BIGINT) AS updated FROM b",
    "tracker_migration": """SELECT s_suppkey AS row, s_name AS "Company", CASE WHEN s_suppkey % 5 = 0 THEN 'Referral' WHEN s_suppkey % 2 = 0 THEN 'LinkedIn' ELSE 'N/A' END AS "Found On", 'Workday' AS "Application Portal", 'x' AS "Mine" FROM supplier""",
    "tracker_headers": "SELECT 's' || s_suppkey AS sheet, CAST(1 + s_suppkey % 3 AS INTEGER) AS row, header, col FROM supplier, (VALUES ('Company', 1), ('Job link', 2), ('Job Title', 3)) AS t(header, col)",
    "tracker_rows": "SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) ELSE DATE '2024-05-06' END AS day, CASE WHEN o_orderkey % 2 = 0 THEN 'Acme' ELSE 'n/a' END AS company, 'n/a' AS salary, '' AS status, 'N/A' AS found_on, 'Lever' AS portal FROM orders",
    "column_widths": "SELECT 'c_custkey' AS header, CAST(10 AS INTEGER) AS width UNION ALL SELECT 'c_name', CAST(least(greatest(max(length(c_name)), 10), 60) AS INTEGER) FROM customer UNION ALL SELECT 'c_mktsegment', CAST(least(greatest(max(length(c_mktsegment)), 12), 60) AS INTEGER) FROM customer",
    "input_sheet": "WITH s AS (SELECT o_orderkey AS row, 'https://a.com/' || (o_custkey % 800) AS link FROM orders WHERE o_orderkey % 4 IN (0, 1, 3)) SELECT row, link, link IN (SELECT 'https://a.com/' || (c_custkey * 2) FROM customer) OR row > min(row) OVER (PARTITION BY link) AS duplicate FROM s",
    "pasted_links": "SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS links, CAST(1 AS BIGINT) AS duplicates, CAST(1 AS BIGINT) AS invalid FROM supplier",
    "merged_pastes": "SELECT s_suppkey, CAST(1 AS BIGINT) AS added, CAST(2 AS BIGINT) AS duplicate, CAST(1 AS BIGINT) AS invalid FROM supplier",
    "batch_snapshots": """WITH i AS (SELECT l_orderkey AS b, l_linenumber AS n, CASE l_returnflag WHEN 'N' THEN 'running' WHEN 'R' THEN 'failed' ELSE 'completed' END AS s FROM lineitem),
      c AS (SELECT b, n, b % 10 = 0 AS asked, CASE WHEN b % 10 = 0 AND n * 10 > 25 THEN 'cancelled' WHEN count(*) > 0 AND bool_or(s = 'failed') THEN 'failed' WHEN bool_or(s = 'completed') THEN 'completed' ELSE 'running' END AS s FROM i GROUP BY b, n)
      SELECT b AS batch_id, count(*) AS total, count(*) FILTER (WHERE s IN ('completed', 'failed')) AS processed, count(*) FILTER (WHERE s = 'completed') AS completed, count(*) FILTER (WHERE s = 'failed') AS failed,
        CASE WHEN bool_or(s = 'running') THEN 'running' WHEN bool_or(asked) THEN 'cancelled' ELSE 'completed' END AS status FROM c GROUP BY b""",
    "retained_batches": "SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS active, count(*) FILTER (WHERE o_orderstatus = 'O' OR date_diff('second', o_orderdate, TIMESTAMP '1996-06-01') < 86400 * 365) AS retained FROM orders",
    "public_postings": "WITH p AS (SELECT c_custkey, c_custkey % 6 AS k, " + ", ".join(f"{v} AS {n}" for n, v in _PAGE.items()) + """ FROM customer)
      SELECT c_custkey AS page_id, CASE WHEN company = '' THEN 'n/a' ELSE company END AS company, CASE WHEN location = '' THEN 'n/a' ELSE location END AS location, CASE WHEN work_type = '' THEN 'n/a' ELSE work_type END AS work_type, CASE WHEN salary = '' THEN 'n/a' ELSE salary END AS salary,
        'N/A' AS found_on, 'Company Website' AS application_portal, CASE k WHEN 4 THEN 'missing_company,missing_job_title,missing_location,unavailable_posting' WHEN 5 THEN 'missing_job_title,missing_location' ELSE '' END AS issues, CASE k WHEN 4 THEN 'Company' WHEN 5 THEN 'Job title' ELSE '' END AS first_field,
        CAST(CASE k WHEN 4 THEN 11 WHEN 5 THEN 57 ELSE 95 END AS INTEGER) AS confidence_score, CASE WHEN k >= 4 THEN 'Low' ELSE 'High' END AS confidence FROM p""",
    "captured_pages": """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'Acme Labs' ELSE 'Globex' END AS company, CASE WHEN s_suppkey % 2 = 0 THEN 'Analyst ' ELSE 'Buyer ' END || s_suppkey AS job_title, CASE WHEN s_suppkey % 2 = 0 THEN 'Austin, TX' ELSE 'Boston, MA' END AS location,
      CASE WHEN s_suppkey % 2 = 0 THEN 'Hybrid' ELSE '' END AS work_type, CASE WHEN s_suppkey % 2 = 0 THEN '$50,000 - $60,000 per year' ELSE '$30 - $40 per hour' END AS salary, CASE WHEN s_suppkey % 2 = 0 THEN 'page_label' ELSE 'text' END AS company_from, CASE WHEN s_suppkey % 2 = 0 THEN 'page_label' ELSE 'text' END AS location_from,
      CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'captured_page_review' END AS issues, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 79 ELSE 71 END AS INTEGER) AS confidence_score, CASE WHEN s_suppkey % 2 = 0 THEN 'Austin, TX' ELSE '' END AS places FROM supplier""",
    "rate_limits": """WITH RECURSIVE e AS (SELECT event_type AS scope, user_id AS client, CAST(ts AS TIMESTAMP) AS t, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts) AS n FROM events),
      s AS (SELECT DISTINCT scope, client, CAST(0 AS BIGINT) AS n, CAST([] AS TIMESTAMP[]) AS held, false AS allowed FROM e
        UNION ALL SELECT e.scope, e.client, e.n, CASE WHEN len(list_filter(s.held, lambda x: x >= e.t - INTERVAL 1 HOUR)) < 3 THEN list_append(list_filter(s.held, lambda x: x >= e.t - INTERVAL 1 HOUR), e.t) ELSE list_filter(s.held, lambda x: x >= e.t - INTERVAL 1 HOUR) END,
          len(list_filter(s.held, lambda x: x >= e.t - INTERVAL 1 HOUR)) < 3 FROM s JOIN e ON e.scope = s.scope AND e.client = s.client AND e.n = s.n + 1)
      SELECT client, allowed, count(*) AS n FROM s WHERE n > 0 GROUP BY ALL""",
}
