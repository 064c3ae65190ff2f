"""Integrity rules, coverage profiles and leakage audits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.numbers import to_number
from tidewatch.operators.timeline import entity, history, with_month_index

MONTH_TEXT = r"^\d{4}-\d{2}$"
# Substrings no model input may contain.
FORBIDDEN_IN_FEATURES = ["target", "future", "overrun", "distress", "escalation_pct", "schedule_drift"]


def _count(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))


def integrity_counts(panel: DataFrame) -> DataFrame:
    """Every integrity rule in one aggregation pass."""
    month, pid, name = _text("reporting_month"), _text("project_id"), _text("project_name")
    phys, fin = _text("physical_progress"), _text("financial_progress")
    phys_v = to_number(phys)
    negative = sum(
        (F.coalesce((to_number(_text(c)) < 0).cast("int"), F.lit(0))
         for c in ("expenditure", "approved_cost", "revised_cost")), F.lit(0))
    bad_dates = sum(
        (((_text(c) != "") & ~_text(c).rlike(MONTH_TEXT)).cast("int")
         for c in ("original_completion_date", "revised_completion_date")), F.lit(0))
    return panel.agg(
        F.count("*").alias("row_count"),
        _count((month == "UNKNOWN") | ~month.rlike(MONTH_TEXT)).alias("bad_month"),
        _count((pid == "") | (pid == "UNKNOWN")).alias("missing_id"),
        _count(name == "").alias("missing_name"),
        _count((phys != "") & (phys_v.isNull() | (phys_v < 0) | (phys_v > 100))).alias("bad_progress"),
        F.sum(negative).cast("long").alias("negative_cost"),
        F.sum(bad_dates).cast("long").alias("bad_completion_date"),
        _count(phys_v.isNotNull()).alias("physical_present"),
        _count(to_number(fin).isNotNull()).alias("financial_present"),
        F.min(F.when(month.rlike(MONTH_TEXT), month)).alias("first_month"),
        F.max(F.when(month.rlike(MONTH_TEXT), month)).alias("last_month"),
    )


def coverage_profile(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-null share of each column by year, by sector and overall, long form."""
    base = panel.withColumn("year", F.substring("reporting_month", 1, 4))
    wide = base.groupingSets([[F.col("year")], [F.col("sector")], []], "year", "sector").agg(
        F.grouping_id().alias("level"), F.count("*").alias("row_count"),
        *[F.count(c).alias(c) for c in columns])
    return wide.unpivot(["level", "year", "sector", "row_count"], list(columns), "field", "present").withColumn(
        "present_share", F.col("present") / F.col("row_count"))


def era_coverage(panel: DataFrame, eras: Sequence[tuple[str, str, str]], columns: Sequence[str]) -> DataFrame:
    """Non-null share of each column by era; an era is a name with its first and last year."""
    year = F.substring("reporting_month", 1, 4)
    era = F.coalesce(*[F.when(year.between(a, b), F.lit(n)) for n, a, b in eras])
    wide = panel.groupBy(era.alias("era")).agg(F.count("*").alias("row_count"), *[F.count(c).alias(c) for c in columns])
    return wide.unpivot(["era", "row_count"], list(columns), "field", "present").withColumn(
        "present_share", F.col("present") / F.col("row_count"))


def negative_values(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Negative amounts by column and kind of row they stand in."""
    kind = F.when(F.col("project_id").startswith("PRJ_"), F.lit("DERIVED_ID")).otherwise(F.lit("OFFICIAL_ID"))
    tall = panel.select(kind.alias("id_kind"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        ["id_kind"], list(columns), "field", "value")
    return tall.where("value < 0").groupBy("field", "id_kind").agg(
        F.count("*").alias("negatives"), F.min("value").alias("lowest"))


def cohort_sizes(panel: DataFrame, minimums: Sequence[int] = (3, 4, 6, 8, 12, 24, 36)) -> DataFrame:
    """Entities and rows with at least N observations, and their shares."""
    per = panel.groupBy("project_id").agg(F.count("*").alias("obs"))
    sums = [
        x for n in minimums for x in (
            _count(F.col("obs") >= n).alias(f"e{n}"),
            F.sum(F.when(F.col("obs") >= n, F.col("obs")).otherwise(0)).alias(f"r{n}"))
    ]
    one = per.agg(F.count("*").alias("ents"), F.sum("obs").alias("all_rows"), *sums)
    rows = F.explode(F.array(*[
        F.struct(F.lit(n).alias("min_observations"), F.col(f"e{n}").alias("projects"), F.col(f"r{n}").alias("panel_rows"))
        for n in minimums]))
    return one.select("ents", "all_rows", rows.alias("r")).select(
        "r.min_observations", "r.projects", "r.panel_rows",
        (F.col("r.projects") / F.col("ents")).alias("project_share"),
        (F.col("r.panel_rows") / F.col("all_rows")).alias("row_share"))


def cadence(panel: DataFrame, min_observations: int = 12) -> DataFrame:
    """Reporting rhythm of entities with a long history."""
    gaps = (
        with_month_index(panel).select("project_id", "month_idx")
        .withColumn("gap", F.col("month_idx") - F.lag("month_idx").over(history()))
        .withColumn("obs", F.count("*").over(entity()))
        .where(F.col("obs") >= min_observations)
    )
    # a first row has no gap; a span is the sum of the gaps plus one
    entities = F.sum(F.col("gap").isNull().cast("long"))
    # gaps are whole months, so the exact median holds few distinct values
    return gaps.agg(
        entities.alias("projects"),
        (F.count("*") / entities).alias("mean_observations"),
        ((F.sum("gap") + entities) / entities).alias("mean_span"),
        F.percentile("gap", 0.5).alias("median_gap"),
        F.avg((F.col("gap") <= 2).cast("double")).alias("gap_within_2_share"),
        F.avg((F.col("gap") == 1).cast("double")).alias("strict_monthly_share"),
    )


def diverging_names(panel: DataFrame) -> DataFrame:
    """Entities whose first and last names share no word."""
    words = lambda c: F.split(F.upper(c), " ")
    per = panel.groupBy("project_id").agg(
        F.min_by("project_name", "month_idx").alias("first_name"),
        F.max_by("project_name", "month_idx").alias("last_name"))
    return per.where(F.size(F.array_intersect(words(F.col("first_name")), words(F.col("last_name")))) == 0)


def quality_rollup(log: DataFrame) -> DataFrame:
    done = F.col("extraction_status").isin("SUCCESS", "SYNOPSIS_NO_PROJECT_TABLES")
    return log.agg(
        F.count("*").alias("processed"), _count(done).alias("successful"), _count(~done).alias("failed"))


def leaking_features(columns: Sequence[str], forbidden: Sequence[str] = FORBIDDEN_IN_FEATURES) -> list[str]:
    return [c for c in columns if any(f in c.lower() for f in forbidden)]


def audit_leakage(columns: Sequence[str], df: DataFrame | None = None) -> None:
    """Raise when a model input looks like a label or reaches past its month.

    With ``df`` the temporal order is checked too (one job).
    """
    bad = leaking_features(columns)
    if bad:
        raise ValueError(f"label-like feature columns: {bad}")
    if df is not None and order_violations(df).take(1):
        raise ValueError("feature cutoff does not precede the label horizon")


def order_violations(df: DataFrame) -> DataFrame:
    return df.where(F.col("feature_cutoff_month") >= F.col("target_horizon_month_12m"))


def truncation_differences(
    panel: DataFrame, cutoff: str, op: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Rows up to ``cutoff`` that change when later months are removed.

    Empty for every point-in-time operator.
    """
    full = op(panel).where(F.col("reporting_month") <= cutoff)
    cut = op(panel.where(F.col("reporting_month") <= cutoff))
    return (
        full.exceptAll(cut).withColumn("side", F.lit("full"))
        .unionByName(cut.exceptAll(full).withColumn("side", F.lit("cut")))
    )
