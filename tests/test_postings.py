"""What the engine reads in texts, links and pages, and how it keeps them."""

import pytest
from pyspark.sql import functions as F

from postloom.operators import batches, history, tracker
from postloom.plans.examples import EXAMPLES
from postloom.sources.captures import last_records, with_content
from postloom.sources.pages import flatten, posting_record, read_page
from postloom.streaming import limits


@pytest.fixture(scope="module")
def results(spark):
    """All examples' results: one job a function would compile each of them alone."""
    out = {}
    for name, (function, rows) in EXAMPLES.items():
        df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, given string")
        out[name] = {r["i"]: r["result"] for r in df.withColumn("result", function(F.col("given"))).collect()}
    return out


@pytest.mark.parametrize("name", sorted(EXAMPLES))
def test_examples(results, name):
    assert results[name] == {i: b for i, (_, b) in enumerate(EXAMPLES[name][1])}


def test_pages_are_read():
    html = """<title>T</title><meta property="og:title" content=" A  b"><script type="application/ld+json">{"@graph": [{"@type": ["JobPosting"], "title": "X",
      "jobLocation": [{"address": {"addressLocality": "Bonn", "addressCountry": "DE"}}, {"address": {"addressLocality": "Ulm", "addressCountry": "US"}}], "baseSalary": {"currency": "EUR", "value": 5}}]};</script>
      <script id="__NEXT_DATA__">{"a": [{"B": 1, "c": {"b": "x"}}]}</script><h1 class="job-title">H <b>one</b></h1><a href="/x">go</a><style>no</style><p>text"""
    got = read_page(html)
    assert got["title"] == "T" and dict(got["metas"])["og:title"] == "A b" and got["text"] == "H one go text"
    assert got["record"]["location"] == "Bonn, DE, Ulm, United States" and got["record"]["salary_value"] == "5" and got["record"]["salary_currency"] == "EUR"
    assert dict(got["flat"]) == {"b": ["1", "x"]} and got["links"] == [{"href": "/x", "text": "go", "rel": ""}]
    assert got["marked"][0] == {"tag": "h1", "mark": "class=job-title", "text": "H one", "at": 5, "last": 6}
    assert read_page(None)["text"] == "" and posting_record([{"hasPart": {"jobPosting": {"t": 1}}}]) == {"t": 1} and flatten(None) == {}


def test_upsert_keeps_ids_and_takes_null_stamps(spark):
    old = spark.createDataFrame([("a", 7, 1, 1, "x"), ("b", 3, 1, 1, "y")], "identity_key string, id long, created_at int, updated_at int, company string")
    new = spark.createDataFrame([("c", 2, "n1", 5), ("a", None, "n2", 9), ("c", 2, "n3", 6), ("d", 2, "n4", 1)], "identity_key string, updated_at int, company string, seq long")
    got = {r["identity_key"]: tuple(r)[1:] for r in history.upsert(old, new).collect()}
    assert got == {"a": (7, 1, None, "n2"), "b": (3, 1, 1, "y"), "d": (8, 2, 2, "n4"), "c": (9, 2, 2, "n3")}
    assert history.upsert(old, new.limit(0)).count() == 2 and {r["id"] for r in history.upsert(old.limit(0), new).collect()} == {1, 2, 3}


def test_pages_and_bounds(spark):
    rows = spark.range(30).select("id", F.lit(1).alias("updated_at"))
    assert [r["id"] for r in history.page(rows, "3", "2").collect()] == [27, 26, 25]
    assert [history.bounded(x, 500, 1, 1000) for x in ("x", None, -4, "7", 9999)] == [500, 500, 1, 7, 1000]


def test_history_entries_and_sources(spark):
    rows = spark.createDataFrame([(1, "old", "", '{"company": "new", "found_on": "Dice"}'), (2, "old", "x", "broken")], "id int, company string, found_on string, job_json string")
    assert [(r["company"], r["found_on"]) for r in history.entries(rows).orderBy("id").collect()] == [("new", "Dice"), ("old", "x")]
    job = spark.createDataFrame([("https://acme.wd1.myworkdayjobs.com/x/job/1", "LinkedIn")], "job_link string, source string")
    assert tuple(history.track_sources(job).first()) == ("https://acme.wd1.myworkdayjobs.com/x/job/1", "Workday", "LinkedIn", "Workday")
    states = history.status_counts(spark.createDataFrame([("ready", True), ("error", False), ("ready", None)], "history_status string, manual boolean")).first()
    assert states.asDict() == {"total": 3, "ready": 2, "review": 0, "error": 1, "manual": 1}


def test_tracker_update_rewrites_the_last_row_only(spark):
    old = spark.createDataFrame([(1, "https://a.com/1", "A", "n1"), (2, "https://A.com/1/", "B", "n2"), (3, "", "C", "n3")], "row long, `Job link` string, Company string, Notes string")
    new = spark.createDataFrame([(1, "https://a.com/1", "N"), (2, "", "E"), (3, "https://b.com", "F"), (4, "https://b.com/", "G")], "seq long, `Job link` string, Company string")
    got = sorted(map(tuple, tracker.append(old, new, "update").collect()))
    assert got == [(1, "https://a.com/1", "A", "n1", "kept"), (2, "https://a.com/1", "N", "n2", "updated"), (3, "", "C", "n3", "kept"), (4, "", "E", None, "added"), (5, "https://b.com/", "G", None, "added")]
    assert tuple(tracker.append_counts(old, new, "update").first()) == (2, 0, 2) and tuple(tracker.append_counts(old, new).first()) == (2, 2, 0)


def test_tracker_sheets_links_and_status(spark):
    cells = spark.createDataFrame([("x", 0, 1, 1, "Company"), ("x", 0, 1, 2, "URL"), ("y", 1, 2, 1, "Employer"), ("Applications ", 2, 1, 1, "zz")], "sheet string, sheet_no int, row int, col int, value string")
    assert tuple(tracker.choose_sheet(cells).first()) == ("Applications ", 1) and tuple(tracker.choose_sheet(cells.where("sheet_no < 2")).first()) == ("x", 1)
    heads = tracker.with_headers(spark.createDataFrame([(1, 1, "Job Link"), (1, 2, " notes")], "row int, col int, value string"), tracker.INPUT)
    assert dict(map(tuple, heads.collect())) == {"job link": 1, "notes": 2, "found on": 3, "process status": 4, "processed at": 5, "error message": 6}
    rows = spark.createDataFrame([(1, "Open job", "https://a.com/"), (2, "open job", None), (3, "https://A.com", None)], "row int, `Job link` string, target string")
    assert list(map(tuple, tracker.existing_links(rows).collect())) == [("https://a.com", 3)]
    status = spark.createDataFrame([("", "A", "B", "C"), ("", "A", "n/a", "C"), ("x", "A", "B", "C")], "e string, c string, t string, l string")
    assert [r[0] for r in status.select(tracker.result_status(F.col("c"), F.col("t"), F.col("l"), F.col("e"))).collect()] == ["Done", "Needs Manual Review", "Error"]
    there = spark.createDataFrame([("HTTPS://a.com", "A", "B"), ("https://b.com", "n/a", "B")], "job_link string, company string, job_title string")
    asked = spark.createDataFrame([("https://A.com",), ("https://b.com",)], "link string")
    assert [r["link"] for r in tracker.present_links(there, asked).collect()] == ["https://A.com"]
    assert [r["date_applied"] for r in tracker.exportable(spark.createDataFrame([("", ""), ("x", "1")], "error string, date_applied string"), "2024-01-02").collect()] == ["2024-01-02"]


def test_batch_states(spark):
    changes = spark.createDataFrame([(1, 1, 0, "queued"), (1, 2, 0, "queued"), (1, 1, 5, "running"), (1, 1, 9, "completed"), (1, 2, 8, "running"), (2, 1, 0, "queued")], "batch_id int, item int, ts int, state string")
    asked = spark.createDataFrame([(1, 6)], "batch_id int, cancelled_at int")
    got = {r["batch_id"]: tuple(r)[1:] for r in batches.snapshot(batches.item_states(changes, cancelled=asked)).collect()}
    assert got == {1: (2, 1, 1, 0, "cancelled"), 2: (1, 0, 0, 0, "queued")}


def test_rate_limits_stream_and_table(spark, tmp_path):
    rows = [("s", "a", t) for t in (0, 10, 20, 30, 65, 70, 71)] + [("t", "a", 5), ("s", "b", 6)]
    table = spark.createDataFrame(rows, "scope string, client string, t long").withColumn("ts", F.timestamp_seconds(F.col("t") + 1000)).drop("t")
    want = {("s", "a", t): ok for t, ok in zip((0, 10, 20, 30, 65, 70, 71), (True, True, False, False, True, False, True), strict=True)} | {("t", "a", 5): True, ("s", "b", 6): True}
    read = lambda df: {(r["scope"], r["client"], int(r["ts"].timestamp()) - 1000): r["allowed"] for r in df.collect()}
    assert {(s, c, t): ok for (s, c, t), ok in read(limits.judged(table, 2, 60)).items()} == want
    table.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = limits.rate_limit(stream, 2, 60).writeStream.format("memory").queryName("judged").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert read(spark.table("judged")) == want


def test_streamed_windows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "completed", 0), (1, "failed", 60), (2, "queued", 4000), (3, "queued", 90_000)], "batch_id int, state string, t long").select("batch_id", "state", F.col("batch_id").alias("client"), F.timestamp_seconds("t").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df in (("settled", limits.finished_batches(stream())), ("windows", limits.requests_per_window(stream()))):
        df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    assert {r["batch_id"]: r["settled"] for r in spark.table("settled").collect()} == {1: 2, 2: 0}
    assert spark.table("windows").where("client = 1").agg(F.sum("n")).first()[0] == 4  # two windows hold each


def test_captures_with_content(spark):
    kinds = "text string, html string, meta map<string,string>, jsonld array<string>, json_scripts array<string>, candidates struct<headings: array<string>, workTypeTags: array<string>, labelPairs: array<string>, headerBlocks: array<string>, keywordLines: array<string>>"
    rows = spark.createDataFrame([("x" * 20, None, None, None, None, None), ("x", "", None, None, None, None), ("", "", None, ["{}"], None, None), ("", "", None, None, None, (["h"], None, None, None, None))], kinds)
    assert with_content(rows).count() == 3
    assert [r["id"] for r in last_records(spark.range(5), "id", 2).collect()] == [4, 3]
