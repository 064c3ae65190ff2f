"""Early-warning lead times.

Whether a later month counts as an event depends on the row it is seen from, so
the forward window is gathered (at most H rows) and searched with a filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.numbers import half_even, is_true
from tidewatch.operators.timeline import history


def with_first_event(
    df: DataFrame,
    cost: float = 0.05,
    delay: float = 6.0,
    horizon: int = 12,
    strict: bool = False,
) -> DataFrame:
    """Add ``event_idx``: first later month in the horizon with a deterioration.

    A missing later value counts as 0. In the default variant a missing current
    deviation never triggers; in the ``strict`` variant it counts as 0 and a
    slip of the completion date triggers too.
    """
    ahead = history().rangeBetween(1, horizon)
    window = F.collect_list(F.struct("month_idx", "C_base", "schedule_deviation_months", "completion_idx")).over(ahead)
    df = df.withColumn("_ahead", window)
    base, dev, comp = F.col("C_base"), F.col("schedule_deviation_months"), F.col("completion_idx")
    zero = F.lit(0.0)
    from_dev = F.coalesce(dev, zero) if strict else dev

    def hit(x: Column) -> Column:
        dearer = is_true((base > 0) & (F.coalesce(x["C_base"], zero) >= base * (1.0 + cost)))
        later = is_true(F.coalesce(x["schedule_deviation_months"], zero) - from_dev >= delay)
        out = dearer | later
        if strict:
            out = out | is_true(x["completion_idx"] - comp >= delay)
        return out

    first = F.array_min(F.transform(F.filter("_ahead", hit), lambda x: x["month_idx"]))
    return df.withColumns({"event_idx": first, "rows_ahead": F.size("_ahead")}).drop("_ahead")


def alerts(df: DataFrame, tau: float, y: str, p: str = "p", fallback: int | None = 12) -> DataFrame:
    """True-positive alerts with their lead in months."""
    event = F.col("event_idx") if fallback is None else F.coalesce("event_idx", F.col("month_idx") + fallback)
    return (
        df.where((F.col(p) >= tau) & (F.col(y) == 1.0) & (F.col("rows_ahead") > 0))
        .withColumn("event_idx", event)
        .where("event_idx is not null")
        .select("project_id", "reporting_month", "month_idx", "event_idx", F.col(p).alias("p"),
                (F.col("event_idx") - F.col("month_idx")).alias("lead_months"))
    )


def events(alert_rows: DataFrame) -> DataFrame:
    """Distinct events, each dated from its first alert."""
    return alert_rows.groupBy("project_id", "event_idx").agg(
        F.min("month_idx").alias("first_alert_idx"), F.count("*").alias("alert_count"),
        F.max("p").alias("max_prob"),
    ).withColumn("lead_months", F.col("event_idx") - F.col("first_alert_idx"))


def lead_summary(rows: DataFrame) -> DataFrame:
    """Median, mean and quartiles. Leads are 1..H, so exact percentiles stay small."""
    # one row per entity first, so a dominant entity cannot load the distinct count
    per = rows.groupBy("project_id", "lead_months").agg(F.count("*").alias("n"))
    q = F.percentile("lead_months", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("evaluated"),
        F.countDistinct("project_id").alias("unique_projects"),
        half_even(F.sum(F.col("lead_months") * F.col("n")) / F.sum("n"), 2).alias("mean_lead"),
        q.alias("_q"),
    ).select(
        "evaluated", "unique_projects",
        F.coalesce("mean_lead", F.lit(0.0)).alias("mean_lead"),
        *[F.coalesce(F.get("_q", F.lit(i)), F.lit(0.0)).alias(n)
          for i, n in enumerate(("p25_lead", "median_lead", "p75_lead"))])


def lead_times(
    scored: DataFrame, tau: float = 0.5, cost: float = 0.05, delay: float = 6.0,
    level: str = "event", fallback: int | None = None, y: str = "overrun_composite_12m",
    strict: bool = True,
) -> DataFrame:
    """Lead-time summary of a scored panel at alert or event level."""
    found = alerts(with_first_event(scored, cost, delay, strict=strict), tau, y, fallback=fallback)
    return lead_summary(found if level == "alert" else events(found))


def lead_histogram(rows: DataFrame) -> DataFrame:
    m = F.col("lead_months")
    bucket = (
        F.when(m <= 2, F.lit("1-2")).when(m <= 5, F.lit("3-5")).when(m <= 8, F.lit("6-8")).otherwise(F.lit("9-12"))
    )
    return rows.groupBy(bucket.alias("lead_bucket")).agg(F.count("*").alias("row_count"))
