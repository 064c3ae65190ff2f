"""Temporal metadata of a panel.

All per-entity windows here and in the other operators use the one spec
``history()``, so a chain of them costs a single exchange on ``project_id``.
The grain (entity, month) is unique, which bounds every window partition by
the number of calendar months however many raw rows an entity had.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewatch.functions.dates import month_index
from tidewatch.functions.numbers import to_number

NUMERIC = [
    "physical_progress", "financial_progress", "expenditure",
    "approved_cost", "revised_cost", "schedule_deviation",
]


def entity() -> WindowSpec:
    return Window.partitionBy("project_id")


def history() -> WindowSpec:
    return entity().orderBy("month_idx")


def checked_months(panel: DataFrame) -> DataFrame:
    """Month index that fails the job on a repeated or unparsable month.

    Every later window orders by this column, so no plan can prune the check
    away. It shares the one exchange on the entity.
    """
    df = with_month_index(panel)
    step = F.col("month_idx") - F.lag("month_idx").over(history())
    failed = (step <= 0) | F.col("month_idx").isNull()
    complaint = F.raise_error(
        F.concat_ws(" ", F.lit("month repeats or cannot be read:"), "project_id", "reporting_month")).cast("int")
    return df.withColumn("_failed", failed).withColumn(
        "month_idx", F.when(F.col("_failed"), complaint).otherwise(F.col("month_idx"))).drop("_failed")


def with_month_index(panel: DataFrame) -> DataFrame:
    if "month_idx" in panel.columns:
        return panel
    return panel.withColumn("month_idx", month_index(F.col("reporting_month")))


def duplicate_keys(df: DataFrame) -> DataFrame:
    """Keys that break the (entity, month) grain; empty when the panel is sound."""
    return (
        df.groupBy("project_id", "reporting_month")
        .agg(F.count("*").alias("row_count"))
        .where("row_count > 1")
    )


def require_unique_grain(df: DataFrame) -> DataFrame:
    """Raise when a key repeats. Runs one job."""
    bad = duplicate_keys(df).take(1)
    if bad:
        raise ValueError(f"duplicate (project_id, reporting_month): {bad[0].asDict()}")
    return df


def chronology_violations(panel: DataFrame) -> DataFrame:
    """Rows whose month is unparsable or does not advance."""
    step = F.col("month_idx") - F.lag("month_idx").over(history())
    return (
        with_month_index(panel)
        .select("project_id", "reporting_month", "month_idx")
        .withColumn("step", step)
        .where("month_idx is null or step <= 0")
    )


def timeline(panel: DataFrame) -> DataFrame:
    """Attach observation number, gap and age; never fills or densifies.

    A repeated or unparsable month fails the running job (``checked_months``).
    """
    df = checked_months(panel).withColumns(
        {c: to_number(F.col(c)) for c in NUMERIC
         if c in panel.columns and dict(panel.dtypes)[c] == "string"}
    )
    step = F.col("month_idx") - F.lag("month_idx").over(history())
    return df.withColumns({
        "observation_number": F.row_number().over(history()),
        "months_since_previous_observation": step.cast("double"),
        "reporting_gap_flag": F.when(step > 1, 1).otherwise(0),
        "project_age_months": F.col("month_idx") - F.min("month_idx").over(entity()),
    })


def planned_age(start_month: Column) -> Column:
    """Age against a planned start; unknown starts stay NULL, never 0."""
    return (F.col("month_idx") - month_index(start_month)).cast("double")
