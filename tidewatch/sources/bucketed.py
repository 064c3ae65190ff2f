"""Tables stored in hash buckets of their entity.

Two tables with the same number of buckets join by entity, and windows over an
entity run, without moving a row; a filter on one entity opens one bucket.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import fresh_path

KEY, ORDER = "project_id", "month_idx"
#: Wide rows of a bucket; a task sorts them in some hundred MB.
BUCKET_ROWS = 200_000


def default_buckets(spark: SparkSession) -> int:
    """As many as shuffles have partitions; give a number that fits the stored data on a cluster."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized_buckets(spark: SparkSession, rows: int) -> int:
    """So many buckets that one holds ``BUCKET_ROWS`` rows on average, and no fewer than shuffles have partitions."""
    return max(default_buckets(spark), -(-rows // BUCKET_ROWS))


def co_located(spark: SparkSession) -> SparkSession:
    """A session over the same tables in which rows that meet by entity and month need only lie together by entity."""
    side = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        side.conf.set(key, spark.conf.get(key))
    side.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    # a bucket a task: small files are else packed together, and a task sorts what several buckets hold
    side.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    return side


def write_bucketed(df: DataFrame, label: str, buckets: int | None = None, key: str = KEY, order: str = ORDER) -> str:
    """Store rows in a fresh table, one file a bucket, sorted by entity and month; returns its name.

    The files lie in the shared folder; the name lives as long as the session's
    catalog. The unique grain bounds what one entity adds to its bucket.
    """
    n = buckets or default_buckets(df.sparkSession)
    name = f"{label}_{uuid.uuid4().hex}"
    writer = df.repartition(n, key).write.bucketBy(n, key).sortBy(key, *([order] if order in df.columns else []))
    writer.format("parquet").option("path", fresh_path(df.sparkSession, label)).saveAsTable(name)
    return name


def read_bucketed(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_by_bucket(spark: SparkSession, name: str) -> DataFrame:
    """The rows with a task for each bucket, for what is stored in the same buckets again."""
    return co_located(spark).table(name)


def read_bucketed_entity(spark: SparkSession, name: str, value: str, key: str = KEY) -> DataFrame:
    """One entity's rows: its bucket alone is opened, and in it row groups that may hold it."""
    return spark.table(name).where(F.col(key) == value)


def join_bucketed(spark: SparkSession, left: str, right: str, on: list[str], drop: list[str] | None = None) -> DataFrame:
    """Inner join of two tables of equal buckets by keys that hold the bucket key; no exchange."""
    side = co_located(spark)
    return side.table(left).join(side.table(right).drop(*(drop or [])), on)
