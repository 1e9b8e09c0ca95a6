"""Tables of one row group are worked on by many tasks, and what a task holds does not follow the size of the table."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from postloom.plans import boards, fields, flows, more
from postloom.sources import pages, tables

CUSTOMERS = pa.table({"c_custkey": pa.array(range(400), pa.int64()), "c_name": [f"Customer {i}" for i in range(400)], "c_nationkey": pa.array([0] * 400, pa.int32()), "c_mktsegment": ["BUILDING"] * 400})
SUPPLIERS = pa.table({"s_suppkey": pa.array(range(400), pa.int64()), "s_name": [f"Supplier {i}" for i in range(400)]})
ORDERS = pa.table({"o_orderkey": pa.array(range(400), pa.int64()), "o_custkey": pa.array(range(400), pa.int64()), "o_orderpriority": ["1-URGENT"] * 400})
LINES = pa.table({"l_orderkey": pa.array([i // 4 for i in range(400)], pa.int64()), "l_linenumber": pa.array([i % 4 for i in range(400)], pa.int32()), "l_returnflag": ["N"] * 400})


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    for name, rows in {"customer": CUSTOMERS, "supplier": SUPPLIERS, "orders": ORDERS, "lineitem": LINES}.items():
        pq.write_table(rows, path / f"{name}.parquet")
    pq.write_table(pa.table({"page_id": pa.array(range(400), pa.int64()), "url": [f"https://a.com/{i}" for i in range(400)], "html": ["<h1>Job</h1>"] * 400}), path / "pages.parquet")
    return str(path)


def shares(rows):
    return [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]


QUERIES = {f.__name__: f for f in (more.page_extraction, more.public_postings, more.driver_pages, more.captured_pages, boards.board_pages, fields.place_texts, fields.salary_texts, fields.link_texts, flows.issue_log)}


@pytest.mark.parametrize("name", QUERIES)
def test_a_row_group_is_many_tasks(spark, folder, name):
    counts = shares(QUERIES[name](spark, folder))
    assert len(counts) >= 8 and max(counts) <= 100 and sum(counts) <= 400


def test_tasks_follow_the_splits(spark, folder):
    rows = tables.dealt(tables.table(spark, folder, "lineitem"), "l_orderkey", parts=20)
    assert rows.rdd.getNumPartitions() == 20 * tables.table(spark, folder, "lineitem").rdd.getNumPartitions()
    assert rows.select("l_orderkey", F.spark_partition_id().alias("p")).distinct().groupBy("l_orderkey").count().where("count > 1").isEmpty()
    assert "hashpartitioning(batch_id#" in more.batch_snapshots(spark, folder)._jdf.queryExecution().toString()
    assert more._changes(spark, folder).rdd.getNumPartitions() >= 8


def test_pages_are_taken_apart_in_portions(spark):
    batch = pa.record_batch({"k": list(range(7)), "html": ["a" * 10, None, "b" * 50, "c" * 30, "d" * 30, "", "e" * 200]})
    parts = list(pages.portions(batch, 1, most=64, rows=3))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1, 2], [3, 4, 5], [6]]
    assert [p.num_rows for p in pages.portions(batch.slice(0, 0), 1)] == [0]
    sizes = lambda n: spark.range(n).selectExpr("id", f"repeat('x', {1 << 18}) AS html")
    told = pages.evidence(sizes(40).coalesce(1), ("id",)).select("id", F.length("text").alias("n"))
    assert sorted(map(tuple, told.collect())) == [(i, 1 << 18) for i in range(40)]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= pages.BATCH
