"""Links whose host ends in a number, at keys of any length, against SQL and by example."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from postloom.functions.urls import url_problem

PRIVATE = "Local and private network links are not allowed."


def test_large_keys(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet")
    shifted = rows.withColumn("s_suppkey", F.explode(F.array(*(F.col("s_suppkey") + k for k in (0, 1000, 999_000)))))
    shifted.coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{tmp_path}/supplier.parquet/*.parquet')")
    want = sorted(con.sql(entry.oracle_sql()["rejected_links"]).fetchall())
    assert sorted(tuple(r) for r in entry.queries()["rejected_links"](spark, str(tmp_path)).collect()) == want


def test_hosts(spark):
    hosts = {"10.0.0.1004": PRIVATE, "8.8.8.256": PRIVATE, "2130706433": PRIVATE, "127.1": PRIVATE, "0x7f.1": PRIVATE, "8.8.8.8": None, "a1.example.com": None, "jobs.360": PRIVATE, "1.example": None, "[2606:4700::1111]": None}
    table = spark.createDataFrame([(f"https://{h}/1", w) for h, w in hosts.items()], "link string, want string")
    got = table.select("link", "want", url_problem(F.col("link")).alias("got")).collect()
    assert [r["link"] for r in got if r["got"] != r["want"]] == []
