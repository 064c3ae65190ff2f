"""Validation of registrations and observations; arrival-order acceptance.

Rejected rows are kept with a reason (a dead-letter output), never dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.dates import month_index

KEY = ["project_id", "reporting_month"]


def _blank(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) == ""


def registration_reason() -> Column:
    """Why a registration is refused on its own, NULL when it is fine."""
    bad_month = lambda c: F.col(c).isNotNull() & month_index(F.trim(c)).isNull()
    return (
        F.when(_blank("project_id"), F.lit("EMPTY_PROJECT_ID"))
        .when(_blank("project_name"), F.lit("EMPTY_PROJECT_NAME"))
        .when(F.coalesce(F.col("approved_cost") <= 0, F.lit(True)), F.lit("NON_POSITIVE_APPROVED_COST"))
        .when(F.coalesce(month_index(F.trim("initial_reporting_month")).isNull(), F.lit(True)), F.lit("INVALID_INITIAL_MONTH"))
        .when(bad_month("planned_start_date"), F.lit("INVALID_PLANNED_START"))
        .when(bad_month("planned_completion_date"), F.lit("INVALID_PLANNED_COMPLETION"))
    )


def check_registrations(submitted: DataFrame) -> DataFrame:
    """Add ``reject_reason``; the first valid arrival of an id registers it."""
    df = submitted.withColumn("_own", registration_reason())
    first = df.where("_own is null").groupBy("project_id").agg(F.min("arrival_seq").alias("_first"))
    late = (F.col("arrival_seq") > F.col("_first")) & F.col("_own").isNull()
    return df.join(first, "project_id", "left").withColumn(
        "reject_reason", F.when(late, F.lit("ALREADY_REGISTERED")).otherwise(F.col("_own"))).drop("_own", "_first")


def observation_reason() -> Column:
    """Why an observation is refused on its own, NULL when it is fine."""
    return (
        F.when(month_index(F.trim("reporting_month")).isNull() | F.col("reporting_month").isNull(), F.lit("INVALID_MONTH"))
        .when(F.col("financial_progress") < 0, F.lit("NEGATIVE_FINANCIAL_PROGRESS"))
        .when((F.col("physical_progress") < 0) | (F.col("physical_progress") > 100), F.lit("PHYSICAL_PROGRESS_OUT_OF_RANGE"))
        .when(F.col("expenditure") < 0, F.lit("NEGATIVE_EXPENDITURE"))
        .when(F.col("revised_cost") <= 0, F.lit("NON_POSITIVE_REVISED_COST"))
    )


def check_observations(submitted: DataFrame, registry: DataFrame) -> DataFrame:
    """Add ``reject_reason``: unknown entities first, then the field rules."""
    known = registry.select("project_id").distinct().withColumn("_known", F.lit(True))
    return submitted.join(known, "project_id", "left").withColumn(
        "reject_reason",
        F.when(F.col("_known").isNull(), F.lit("UNKNOWN_PROJECT")).otherwise(observation_reason())).drop("_known")


def accept_in_order(checked: DataFrame) -> DataFrame:
    """Decide duplicates and chronology by arrival.

    An observation is accepted when its month lies beyond every month accepted
    before it. Only the first arrival of a month can be accepted, and it is
    unless some later month arrived earlier. So the rows are reduced to one
    first arrival per (entity, month), a suffix minimum over the months of an
    entity decides, and the verdict is joined back: no window ever spans an
    entity's raw arrivals, however many there are.
    """
    df = checked.withColumn("_ok", F.col("reject_reason").isNull())
    first = df.where("_ok").groupBy(*KEY).agg(F.min("arrival_seq").alias("_first"))
    later = Window.partitionBy("project_id").orderBy("reporting_month").rowsBetween(1, Window.unboundedFollowing)
    verdict = first.withColumn("_wins", F.coalesce(F.col("_first") < F.min("_first").over(later), F.lit(True)))
    order_reason = (
        F.when(~F.col("_wins"), F.lit("CHRONOLOGY_VIOLATION"))
        .when(F.col("arrival_seq") > F.col("_first"), F.lit("DUPLICATE_MONTH")))
    return df.join(verdict, KEY, "left").withColumn(
        "reject_reason", F.when(F.col("_ok"), order_reason).otherwise(F.col("reject_reason"))).drop("_ok", "_first", "_wins")


def with_project_defaults(observations: DataFrame, registry: DataFrame) -> DataFrame:
    """Fill costs and dates from the registered plan; nothing else is filled."""
    dim = registry.select(
        "project_id", F.col("approved_cost").alias("_app"), F.col("revised_cost").alias("_rev"),
        F.col("planned_completion_date").alias("_plan"), F.col("planned_start_date"), F.col("sector"))
    return observations.drop("sector").join(dim, "project_id").withColumns({
        "approved_cost": F.col("_app"),
        "revised_cost": F.coalesce("revised_cost", "_rev"),
        "original_completion_date": F.col("_plan"),
        "revised_completion_date": F.col("completion_date"),
    }).drop("_app", "_rev", "_plan", "completion_date")


def history_confidence(n: Column) -> Column:
    return (
        F.when(n <= 1, F.lit("LOW_HISTORY")).when(n == 2, F.lit("LIMITED_HISTORY"))
        .when(n <= 5, F.lit("DEVELOPING_HISTORY")).otherwise(F.lit("ESTABLISHED_HISTORY")))


def trajectory_status(n: Column) -> Column:
    return (
        F.when(n <= 1, F.lit("INSUFFICIENT_HISTORY")).when(n == 2, F.lit("INITIAL_TRAJECTORY"))
        .otherwise(F.lit("ESTABLISHED_TRAJECTORY")))


# What a features snapshot holds.
SNAPSHOT_FIELDS = [
    "C_base", "expenditure_to_baseline", "cost_revision_ratio", "schedule_deviation_months",
    "schedule_deviation_change", "V_fin_1m", "V_fin_3m", "A_fin", "EWMA_V_fin", "trajectory_risk_score",
    "project_age_months", "observation_number", "months_since_previous_observation", "reporting_gap_flag",
]


def features_snapshot() -> Column:
    return F.struct(*SNAPSHOT_FIELDS)
