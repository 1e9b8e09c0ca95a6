"""Attempts to one result, snapshots applied to lists, upload checks and the issue log: edges, replay, retries."""

from io import BytesIO
from zipfile import ZipFile

import pytest
from pyspark.sql import functions as F

from postloom.functions import text
from postloom.operators import attempts, edits, snapshots
from postloom.sources import uploads
from postloom.streaming import issues

TRIED = "url string, attempt int, company string, job_title string, location string, work_type string, salary string, source string, error string, extra string"
PLAIN = "url string, company string, job_title string, location string, work_type string, salary string, source string"


def settled(spark, tried, plain=()):
    rows = [(u, n, *f, "", "", "Company Website", e, "x") for u, n, f, e in tried]
    other = [(u, *f, "", "", "") for u, f in plain]
    got = attempts.settled(spark.createDataFrame(rows, TRIED), spark.createDataFrame(other, PLAIN)).collect()
    return {r["url"]: (r["company"], r["job_title"], r["location"], r["error"]) for r in got}


def test_the_attempt_that_counts(spark):
    whole, none = ("A", "Clerk", "Boston, MA"), ("", "", "")
    got = settled(
        spark,
        [
            ("https://a.com/1", 2, ("B", "Buyer", "Boston, MA"), ""), ("https://a.com/1", 1, whole, ""), ("https://a.com/1", 1, whole, ""),  # the second was not needed; a repeated row
            ("https://a.com/2", 1, none, "HTTP 410"), ("https://a.com/2", 2, whole, ""),  # terminal
            ("https://a.com/3", 1, none, "net"), ("https://a.com/3", 2, none, "timed out"), ("https://a.com/3", 3, whole, ""),  # no third
            ("https://a.com/4", 1, none, "net"),
            (None, 1, none, "net"),
        ],
        [("https://a.com/4", ("F", "", "")), ("https://a.com/4", ("G", "", "")), ("https://a.com/2", whole), ("https://a.com/9", whole)],
    )
    assert got == {
        "https://a.com/1": (*whole, ""),
        "https://a.com/2": ("n/a", "n/a", "n/a", "This posting is unavailable or has expired."),
        "https://a.com/3": ("n/a", "n/a", "n/a", "The website took too long to respond. Try this job again."),
        "https://a.com/4": ("F", "n/a", "n/a", ""),  # of two plain readings the least; a company is known, so no error
        "": ("n/a", "n/a", "n/a", "This posting could not be read. Try again or check the link yourself."),
    }
    assert settled(spark, []) == {}


ROWS = "owner string, place long, job_link string, job string, selected boolean, batch_id string"
ITEMS = "owner string, batch_id string, version long, item long, url string, status string, job_link string, job string"


def lists(df):
    return sorted((r["owner"] or "", r["place"], r["job_link"], r["job"], r["selected"]) for r in df.collect())


@pytest.mark.parametrize("mode", ["skip", "update"])
def test_snapshots_apply_once(spark, mode):
    rows = spark.createDataFrame([("o", 1, "https://a.com/1", "one", True, None), ("o", 2, "https://a.com/1/", "again", False, None), ("o", 3, "", "by hand", False, None), (None, 1, "https://a.com/1", "other", False, None)], ROWS)
    items = [
        ("o", "b", 1, 0, "https://www.a.com/1?utm_source=x", "completed", None, "new one"), ("o", "b", 1, 1, "https://a.com/2", "running", None, "early"), ("o", "b", 2, 1, "https://a.com/2", "failed", None, "late"),
        ("o", "b", 3, 1, "https://a.com/2", "completed", None, "later"), ("o", "b", 2, 0, "https://a.com/1", "completed", None, "newer one"), ("o", "b", 2, 2, "https://a.com/2", "completed", "https://a.com/two", "twin"),
        ("o", "b", 2, 3, "https://a.com/3", "queued", None, None), (None, "c", 1, 0, "https://a.com/1", "completed", None, "null owner"),
    ]
    none = spark.createDataFrame([], "owner string, batch_id string, item long")
    once, applied = snapshots.apply_snapshots(rows, spark.createDataFrame(items, ITEMS), none, mode)
    update = mode == "update"
    want = sorted([
        ("", 1, "https://a.com/1", "null owner" if update else "other", False), ("o", 1, "https://www.a.com/1?utm_source=x" if update else "https://a.com/1", "new one" if update else "one", True),
        ("o", 2, "https://a.com/1/", "again", False), ("o", 3, "", "by hand", False), ("o", 4 + 2 * (1 << 20) + 1, "https://a.com/2", "late", False), ("o", 4 + 2 * (1 << 20) + 2, "https://a.com/two", "twin", False),
    ])
    assert lists(once) == want
    again, twice = snapshots.apply_snapshots(once, spark.createDataFrame(items, ITEMS), applied, mode)
    assert lists(again) == want and twice.distinct().count() == applied.distinct().count() == 4
    # a later version of the batch brings its last item; its own rows are no duplicates
    more = spark.createDataFrame([*items, ("o", "b", 4, 3, "https://a.com/3", "completed", None, "third")], ITEMS)
    last, _ = snapshots.apply_snapshots(once, more, applied, mode)
    assert set(lists(last)) - set(want) == {("o", want[-1][1] + 1 + 4 * (1 << 20) + 3, "https://a.com/3", "third", False)}
    assert snapshots.apply_snapshots(rows.limit(0), spark.createDataFrame([], ITEMS), none, mode)[0].count() == 0


def test_retries_keep_rows_without_a_result(spark):
    rows = spark.createDataFrame([("o", 1, "l", "old", True, None), ("o", 2, "m", "old", False, None)], ROWS)
    results = spark.createDataFrame([("o", 1, 1, "new"), ("o", 1, 2, "newest"), ("o", 2, 1, None), ("p", 1, 1, "no")], "owner string, place long, version long, job string")
    assert lists(snapshots.retried(rows, results)) == [("o", 1, "l", "newest", True), ("o", 2, "m", "old", False)]


def workbook(*names, text="x"):
    raw = BytesIO()
    with ZipFile(raw, "w") as archive:
        for n in names:
            archive.writestr(n, text)
    return raw.getvalue()


def test_uploads_are_read_from_files(spark, tmp_path):
    good = workbook("[Content_Types].xml", "xl/workbook.xml", "xl/sheet1.xml")
    files = {"good.xlsx": good, "sub/GOOD.XLSM": good, "plain.csv": good, "empty.xlsx": b"", "text.xlsx": b"no archive", "half.xlsx": good[:-30], "other.xlsx": workbook("a"), "noending": good}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {r["path"].split(f"{tmp_path.name}/")[1]: r["problem"] for r in uploads.checked(uploads.read_uploads(spark, str(tmp_path))).collect()}
    bad, kind = uploads.REFUSALS["unreadable"], uploads.REFUSALS["kind"]
    assert got == {"good.xlsx": None, "sub/GOOD.XLSM": None, "plain.csv": kind, "text.xlsx": bad, "half.xlsx": bad, "other.xlsx": bad, "noending": kind}
    table = spark.createDataFrame([("a.xlsx", good), ("a.xlsx", good), ("b.xlsx", None), ("c.xlsx", b""), (None, good)], "path string, content binary")
    limits = lambda **k: [r["problem"] for r in uploads.checked(table, **k).orderBy(F.col("path").asc_nulls_last()).collect()]
    assert limits() == [None, None, bad, bad, kind]
    assert limits(most_members=2)[:1] == [uploads.REFUSALS["members"]] and limits(most_bytes=2)[:1] == [uploads.REFUSALS["size"]] and limits(most_bytes=3, most_members=3)[:1] == [None]
    assert uploads.checked(table.limit(0)).count() == 0


POSTING = "url string, ts timestamp, company string, job_title string, location string, work_type string, salary string, found_on string, application_portal string, source string, error string"


def postings(spark, n):
    rows = [(f"https://a.com/{i}", i, "A" * 600, "", None, "", "", "", "", "", "x" * 3000) for i in range(n)] + [("https://a.com/good", 5, "A", "Clerk", "Boston, MA", "Hybrid", "", "", "", "Dice", "")]
    return spark.createDataFrame(rows, POSTING.replace("ts timestamp", "t long")).withColumn("ts", F.timestamp_seconds("t")).select(*(c.split()[0] for c in POSTING.split(", ")))


def test_a_retried_batch_adds_no_row(spark, tmp_path):
    folder = str(tmp_path / "log")
    postings(spark, 7).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(POSTING).parquet(str(tmp_path / "in"))
    issues.log_stream(stream, folder, str(tmp_path / "c")).awaitTermination(120)
    first = issues.last(spark, folder).collect()
    issues.append(issues.records(postings(spark, 7)), 0, folder)  # the same micro-batch once more
    assert issues.last(spark, folder).collect() == first and len(first) == 7
    issues.append(issues.records(postings(spark, 3)), 1, folder)
    newest = issues.last(spark, folder, 4).collect()
    assert [int(r["timestamp"].timestamp()) for r in newest] == [6, 5, 4, 3] and issues.last(spark, folder).count() == 10
    row = newest[0]
    assert (row["domain"], row["url"], len(row["url_hash"]), len(row["result"]["company"]), len(row["technical_error"]), row["result"]["location"]) == ("a.com", None, 64, 500, 2000, "")


def test_records_of_nulls(spark):
    rows = spark.createDataFrame([(None,) * 11], POSTING)
    row = issues.records(rows, full_links=True).first()
    assert (row["domain"], row["url_hash"], row["url"], row["technical_error"], row["timestamp"]) == ("", "", "", "", None) and "missing_company" in row["issues"]


def test_rows_by_hand(spark):
    form = "date_applied string, company string, job_title string, job_link string, location string, work_type string, salary string, found_on string, application_portal string"
    rows = spark.createDataFrame([("d", " A ", "Clerk", "https://boards.greenhouse.io/a/1", "Bonn", None, "", "", ""), ("d", "A", "", "", None, "Hybrid", "$1", "LinkedIn", "Mine"), ("d", "A", "B", "ftp://x", "C", "", "", "", ""), ("d", "A", "B", None, "C", "", "", "LinkedIn", "")], form)
    got = {r["job_link"] or r["problem"]: r for r in edits.entered(rows).collect()}
    first = got["https://boards.greenhouse.io/a/1"]
    assert (first["company"], first["work_type"], first["salary"], first["status"], first["confidence_score"], first["application_portal"], first["problem"]) == ("A", "n/a", "n/a", "Applied", 100, "Greenhouse", None)
    assert got["ftp://x"]["problem"] == edits.NO_LINK and "Add job title, location first." in got
    assert sorted(r["found_on"] for r in edits.entered(rows).where("problem is null").collect()) == ["LinkedIn", "N/A"]
    assert edits.entered(rows.limit(0)).count() == 0


def test_short_lists_and_json_texts(spark):
    rows = spark.createDataFrame([(["A b", " a  B ", "", None, "x" * 300, "C", "c", "D"], '{"k": 1, "deep": {"k": "a\\"b", "j": "x"}}'), (None, None), ([], "no json")], "v array<string>, j string")
    got = rows.select(text.unique_short(F.col("v"), 2), text.unique_short(F.col("v")), text.json_text(F.col("j"), "k"), text.json_text(F.col("j"), "z")).collect()
    assert list(map(tuple, got)) == [(["A b", "C"], ["A b", "C", "D"], 'a"b', ""), ([], [], "", ""), ([], [], "", "")]
