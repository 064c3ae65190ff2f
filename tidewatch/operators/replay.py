"""Historical replay: deterioration events against running high-water marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.numbers import decimal_round, is_true
from tidewatch.operators.timeline import entity, history


def fixed(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", decimal_round(c, digits))


def grouped(c: Column, digits: int) -> Column:
    """Fixed digits with thousands separators."""
    return F.format_number(decimal_round(c, digits), digits)


def with_events(df: DataFrame, cost: float = 0.05, delay: float = 6.0) -> DataFrame:
    """Flag rows that exceed everything reported before, with reasons.

    A cost that dips and comes back is no event: the comparison is with the
    highest earlier value, not the previous one.
    """
    before = history().rowsBetween(Window.unboundedPreceding, -1)
    c = F.coalesce("C_base", F.lit(0.0))
    d = F.col("schedule_deviation_months")
    df = df.withColumns({
        "prior_cost": F.coalesce(F.max(c).over(before), F.lit(0.0)),
        "prior_deviation": F.max(d).over(before),
    })
    prior_c, prior_d = F.col("prior_cost"), F.col("prior_deviation")
    growth = F.when((prior_c > 0) & (c > 0), (c - prior_c) / prior_c)
    slip = d - prior_d
    cost_hit, time_hit = is_true(growth >= cost), is_true(slip >= delay)
    cost_text = F.when(cost_hit, F.concat(
        F.lit("Cost escalated +"), fixed(growth * 100.0, 1), F.lit("% (₹"), grouped(prior_c, 1),
        F.lit(" Cr -> ₹"), grouped(c, 1), F.lit(" Cr)")))
    time_text = F.when(time_hit, F.concat(
        F.lit("Schedule deviation jumped +"), fixed(slip, 1), F.lit(" months ("), fixed(prior_d, 1),
        F.lit("m -> "), fixed(d, 1), F.lit("m)")))
    return df.withColumns({
        "actual_event": cost_hit | time_hit,
        "event_reasons": F.array_compact(F.array(cost_text, time_text)),
    })


def with_alert_leads(df: DataFrame) -> DataFrame:
    """Add the entity's first event and the lead of every alert before it.

    Windows over the whole history reuse the partitioning of the event windows.
    """
    w = entity()
    df = df.withColumn("first_event_idx", F.min(F.when(F.col("actual_event"), F.col("month_idx"))).over(w))
    early = is_true(F.col("alert") & (F.col("month_idx") < F.col("first_event_idx")))
    df = df.withColumn(
        "lead_time_if_event", F.when(early, F.col("first_event_idx") - F.col("month_idx")))
    return df.withColumn(
        "first_alert_idx", F.min(F.when(F.col("lead_time_if_event").isNotNull(), F.col("month_idx"))).over(w))


def replay_rows(scored: DataFrame, cost: float = 0.05, delay: float = 6.0) -> DataFrame:
    """Row-level replay of every entity in one pass over one partitioning."""
    return with_alert_leads(with_events(scored, cost, delay))


TIMELINE_FIELDS = [
    "reporting_month", "observation_number", "C_base", "expenditure", "financial_progress",
    "schedule_deviation_months", "V_fin_1m", "V_fin_3m", "A_fin", "EWMA_V_fin",
    "Z_peer_V_fin", "trajectory_risk_score", "p", "risk_tier", "alert", "actual_event",
    "lead_time_if_event",
]


def replay_documents(rows: DataFrame) -> DataFrame:
    """One nested document per entity: header, timeline, alerts, events."""
    ordered = lambda cond, *fields: F.transform(
        F.array_sort(F.collect_list(F.when(cond, F.struct("month_idx", F.struct(*fields).alias("r"))))),
        lambda x: x["r"])
    first = lambda c: F.min_by(c, "month_idx")
    return rows.groupBy("project_id").agg(
        first("project_name").alias("project_name"),
        F.coalesce(first("sector"), first("sector_clean"), F.lit("OTHER")).alias("sector"),
        F.coalesce(first("approved_cost"), F.lit(0.0)).alias("approved_cost"),
        F.count("*").alias("total_observations"),
        F.min("reporting_month").alias("start_month"), F.max("reporting_month").alias("end_month"),
        ordered(F.lit(True), *TIMELINE_FIELDS).alias("timeline"),
        ordered(F.col("alert"), "reporting_month", "observation_number", "risk_tier", "p").alias("alert_points"),
        ordered(F.col("actual_event"), "reporting_month", F.col("event_reasons").alias("reasons"), "prior_cost",
                "C_base", "prior_deviation", "schedule_deviation_months").alias("events"),
        F.min("first_event_idx").alias("first_event_idx"),
        F.min("first_alert_idx").alias("first_alert_idx"),
    ).withColumn("lead_time", F.col("first_event_idx") - F.col("first_alert_idx"))


def replay(scored: DataFrame, cost: float = 0.05, delay: float = 6.0) -> DataFrame:
    return replay_documents(replay_rows(scored, cost, delay))


def replay_one(scored: DataFrame, project_id: str, **thresholds: float) -> DataFrame:
    """Replay of one entity; unknown ids raise. The key filter reaches the scan
    when ``scored`` is a stored table. Runs one small job."""
    mine = scored.where(F.col("project_id") == project_id)
    if not mine.take(1):
        raise ValueError(f"unknown project_id: {project_id}")
    return replay(mine, **thresholds)


def chart_points(scored: DataFrame) -> DataFrame:
    """Display series, thinned to every ceil(n/5)-th point plus the last."""
    w = entity()
    df = scored.withColumns({
        "_at": F.row_number().over(history()) - 1, "_n": F.count("*").over(w)})
    at, n = F.col("_at"), F.col("_n")
    keep = (n <= 6) | (F.pmod(at, F.ceil(n / 5).cast("int")) == 0) | (at == n - 1)
    fin = F.coalesce("financial_progress", F.lit(0.0))
    return df.where(keep).select(
        "project_id", F.concat(F.lit("M"), F.col("observation_number")).alias("label"),
        F.least(F.lit(100.0), F.col("observation_number") / n * 100.0).alias("ideal_progress"),
        fin.alias("reported_progress"),
        (fin * (1.0 - F.coalesce("p", F.lit(0.0)))).alias("discounted_progress"))
