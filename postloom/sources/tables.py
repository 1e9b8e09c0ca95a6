"""Tables of the data folder, dealt over the cores where what is made of their rows costs more than reading them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly over at least two tasks a core.

    A row group of a file is one task, and a million short rows are one row group; what
    follows without a shuffle would run there on one core.  Only the columns that are read
    later move.
    """
    spark = rows.sparkSession
    return rows.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def dealt(rows: DataFrame, *keys: str, parts: int = 8) -> DataFrame:
    """``rows`` read from files, dealt by key so that a task's part does not grow with the files.

    There are ``parts`` tasks for each split of the files (128 MB at most unless the
    session says otherwise), and never fewer than the session shuffles into.
    """
    n = max(parts * rows.rdd.getNumPartitions(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, *keys)
