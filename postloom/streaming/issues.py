"""A log of what is wrong with postings: bounded values, hashed links, written once a micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postloom.functions import quality
from postloom.functions.hints import private_record

FIELDS = ("company", "job_title", "location", "work_type", "salary", "found_on", "application_portal", "source")
SCHEMA = "timestamp timestamp, domain string, url_hash string, url string, issues array<string>, result struct<" + ", ".join(f"{f}: string" for f in FIELDS) + ">, technical_error string"


def bounded(c: Column, most: int = 500) -> Column:
    """The first ``most`` characters of a value; null is empty."""
    return F.substring(F.coalesce(c.cast("string"), F.lit("")), 1, most)


def records(postings: DataFrame, link: str = "url", at: str = "ts", full_links: bool = False) -> DataFrame:
    """A record of each posting with issues: when, the link's host and hash, the issues, bounded values and error.

    The link itself is only held if ``full_links``.  ``postings`` may bring review_issues;
    else they are found.  Null values are empty.  Repeated rows each give a record.
    """
    c = F.col
    codes = c("review_issues") if "review_issues" in postings.columns else quality.issues(c("company"), c("job_title"), c("location"), c("work_type"), c(link), c("source"), c("error"))
    rows = postings.withColumn("issues_", codes).where(F.size("issues_") > 0)
    private = private_record(c(link), full_links)
    return rows.select(c(at).cast("timestamp").alias("timestamp"), private["domain"].alias("domain"), private["url_hash"].alias("url_hash"), private["url"].alias("url"), c("issues_").alias("issues"), F.struct(*(bounded(c(f)).alias(f) for f in FIELDS)).alias("result"), bounded(c("error"), 2000).alias("technical_error"))


def append(log: DataFrame, batch_id: int, folder: str) -> None:
    """Write one micro-batch's records under its number: written again, they replace themselves."""
    log.write.mode("overwrite").json(f"{folder}/batch={batch_id}")


def log_stream(postings: DataFrame, folder: str, checkpoint: str, link: str = "url", at: str = "ts") -> StreamingQuery:
    """Log the issues of a stream of postings; a micro-batch that is run again adds nothing."""
    return records(postings, link, at).writeStream.foreachBatch(lambda rows, n: append(rows, n, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last(spark: SparkSession, folder: str, n: int = 100) -> DataFrame:
    """The ``n`` latest records, latest first: of equal times by link and values.  Each task keeps ``n`` at most."""
    rows = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").json(folder)
    return rows.orderBy(F.desc("timestamp"), "url_hash", F.to_json("result")).limit(n)
