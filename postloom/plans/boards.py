"""Pages in the layouts of single boards, built from customers' names, segments and keys, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postloom.operators import extraction
from postloom.sources.pages import evidence
from postloom.sources.tables import spread, table

#: What a page of each customer states; the same expressions run on both engines.
STATED = """c_custkey AS page_id, c_custkey % 9 AS form, concat('Analyst ', c_custkey) AS title, concat('North ', upper(substr(c_mktsegment, 1, 1)), lower(substr(c_mktsegment, 2))) AS employer,
  CASE c_custkey % 4 WHEN 0 THEN 'Austin, TX' WHEN 1 THEN 'Jersey City, NJ' WHEN 2 THEN 'Salt Lake City, UT' ELSE 'Denver, CO' END AS place,
  CASE c_custkey % 3 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Hybrid' ELSE 'Onsite' END AS kind, concat('$', 20 + c_custkey % 30, ' - $', 60 + c_custkey % 20, ' per hour') AS pay"""

#: Each form puts fields where only its layout finds them, with others' texts beside them.
FORMS = {
    "https://jobs.lever.co/north/": "concat('<h2>All openings</h2><div class=\"posting-headline\"><h2>', title, '</h2></div><div class=\"posting-company\">', employer, '</div><div class=\"posting-categories\"><span class=\"location\">', place, '</span><span class=\"workplaceTypes\">', kind, '</span></div><div class=\"salary\">', pay, '</div>')",
    "https://www.linkedin.com/jobs/view/900000": "concat('<title>', title, ' | LinkedIn</title><h1>', title, '</h1><a data-tracking-control-name=\"public_jobs_topcard-org-name\">', employer, '</a><span class=\"topcard__flavor--bullet\">', place, '</span><div class=\"job-details-preferences\"><button aria-label=\"Job type\">', kind, '</button></div><div class=\"compensation__salary\"><h3>Base pay range</h3><span>', pay, '</span></div><aside><p>Similar: Remote and on-site jobs</p></aside>')",
    "https://www.indeed.com/viewjob?jk=": "concat('<h1>', title, '</h1><p>Other Company</p><div class=\"jobsearch-CompanyInfoContainer\"><span>4.1</span><a href=\"/cmp\">', employer, '</a></div><div class=\"jobsearch-JobInfoHeader-subtitle\"><div>', place, '</div></div><p>Workplace type: ', kind, '. Pay: ', pay, '</p>')",
    "https://careers.north.com/jobs/": "concat('<meta property=\"og:site_name\" content=\"', employer, '\"><h1>', title, '</h1><section><dl><dt>Location</dt><dd>', place, '</dd><dt>Workplace type</dt><dd>', kind, '</dd></dl></section><section><h3>Workplace</h3></section><aside><h2>Similar postings</h2><p>Telecommute</p></aside><div class=\"pay\">', pay, '</div>')",
    "https://jobs.dayforcehcm.com/en-US/north/North/jobs/": "concat('<title>Job Details | Dayforce</title><script id=\"__NEXT_DATA__\" type=\"application/json\">{\"p\":{\"q\":[{\"jobPostingId\":0,\"jobTitle\":\"Other\",\"jobPostingContent\":{\"jobDescription\":\"\"}},[{\"d\":{\"jobPostingId\":', page_id, ',\"jobTitle\":\"', title, '\",\"jobPostingContent\":{\"jobDescription\":\"&lt;p&gt;This is a ', kind, ' job. Salary: ', pay, '&lt;/p&gt;\"},\"postingLocations\":[{\"formattedAddress\":\"1 Road, ', place, ' 10001, USA\"}]}}]]}}</script>')",
    "https://www.ziprecruiter.com/jobs/north/": "concat('<title>', title, ' job in Town at ZipRecruiter</title><h1>', title, '</h1><p>', employer, ' ', place, '</p><p>', kind, '</p><p>', pay, '</p><p>Job description All of the work.</p>')",
    "https://www.simplyhired.com/job/": "concat('<title>', title, ' - ', employer, ' | ', place, '</title><h1>', title, '</h1><p>Work type: ', kind, '</p><p>Pay: ', pay, '</p><p>We offer remote and hybrid work elsewhere.</p>')",
    "https://north.breezy.hr/p/": "concat('<title>', title, ' at ', employer, '</title><h1>', employer, '</h1><h1>', title, ' - Contract</h1><ul><li class=\"location\">', place, '</li><li class=\"salary-range\">', pay, '</li></ul><p>This is a ', kind, ' role.</p>')",
    "https://work.north.org/openings/": "concat('<meta property=\"og:site_name\" content=\"', employer, '\"><h1 class=\"job-title\">', title, '</h1><div><strong>Location:</strong> ', place, '</div><p>This role is ', kind, '.</p><p>Compensation: ', pay, '</p>')",
}


def board_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of pages whose marks lie below others, behind labels, in headings, titles or nested data, a page a customer."""
    rows = spark.sql(f"SELECT {STATED} FROM {{customer}}", customer=spread(table(spark, sf_dir, "customer")))
    url = "CASE form " + " ".join(f"WHEN {k} THEN concat('{u}', page_id)" for k, u in enumerate(FORMS)) + " END AS url"
    html = "CASE form " + " ".join(f"WHEN {k} THEN {h}" for k, h in enumerate(FORMS.values())) + " END AS html"
    out = extraction.extract_postings(evidence(rows.selectExpr("page_id", url, html)))
    return out.select("page_id", "company", "job_title", "location", "work_type", "salary", "source")


QUERIES = {"board_pages": board_pages}

ORACLE_SQL = {
    "board_pages": f"""WITH s AS (SELECT {STATED} FROM customer)
      SELECT page_id, employer AS company, CASE WHEN form = 7 THEN title || ' - Contract' ELSE title END AS job_title, place AS location, kind AS work_type, pay AS salary,
        CASE form WHEN 0 THEN 'Lever' WHEN 1 THEN 'LinkedIn' WHEN 2 THEN 'Indeed' WHEN 4 THEN 'Dayforce' WHEN 5 THEN 'ZipRecruiter' WHEN 6 THEN 'SimplyHired' WHEN 7 THEN 'Breezy' ELSE 'Company Website' END AS source
      FROM (SELECT * REPLACE (CASE WHEN form = 4 THEN 'North' ELSE employer END AS employer) FROM s)""",
}
