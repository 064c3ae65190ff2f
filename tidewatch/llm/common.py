"""Small helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of ASCII white space; words are what stands between them.
SPACES = r"[\x20\x09-\x0D]+"


def whole_text(text_col: str) -> Column:
    """The text as a string, null counting as empty."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Split incoming batches so that ``column`` holds about ``max_bytes`` at most.

    A row is never split, so one very long text may stand alone above the
    bound. Rows are never dropped.
    """
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            size = size or 0
            if i > start and held + size > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if len(sizes) > start:
            yield batch.slice(start)
