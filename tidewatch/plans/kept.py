"""Results that many queries read, stored once a session and data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.plans.panel import table
from tidewatch.session import stored
from tidewatch.sources.bucketed import sized_buckets, write_bucketed

_TABLES: dict[tuple[str, str, str], DataFrame | str | int] = {}


def _once(spark: SparkSession, sf: str, name: str, make: Callable[[], DataFrame | str | int]) -> DataFrame | str | int:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _TABLES:
        _TABLES[key] = make()
    return _TABLES[key]


def kept(spark: SparkSession, sf: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The stored table of this name, made when it is first asked for. The folder's files must not change meanwhile."""
    return _once(spark, sf, name, lambda: stored(make(), name))


def kept_bucketed(spark: SparkSession, sf: str, name: str, make: Callable[[], DataFrame]) -> str:
    """Name of the table of this name, in buckets of the entity."""
    return _once(spark, sf, name, lambda: write_bucketed(make(), name, buckets_of(spark, sf)))


def is_kept(spark: SparkSession, sf: str, name: str) -> bool:
    return (spark.sparkContext.applicationId, sf, name) in _TABLES


def buckets_of(spark: SparkSession, sf: str) -> int:
    """Buckets of the folder's tables: their number grows with the rows, so that a bucket is sorted in memory."""
    return _once(spark, sf, "buckets", lambda: sized_buckets(spark, table(spark, sf, "lineitem").count()))
