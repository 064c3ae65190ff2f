"""Forward-window labels with strict right-censoring."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import COST_SENSITIVITY, HORIZONS
from tidewatch.functions.numbers import is_true
from tidewatch.operators.kinetics import baseline_cost, target_completion
from tidewatch.operators.timeline import checked_months, entity, history

MIN_HISTORY = 4

LABELS = ["cost_overrun", "schedule_overrun", "overrun_composite"]


def label_columns(h: int) -> list[str]:
    return [
        f"target_observable_{h}m", f"cost_escalation_pct_{h}m", f"cost_overrun_{h}m",
        f"schedule_drift_months_{h}m", f"schedule_overrun_{h}m",
        f"overrun_composite_{h}m", f"distress_type_{h}m",
    ]


def _flag(c: Column) -> Column:
    """1.0 / 0.0, NULL where the comparison is unknown."""
    return c.cast("double")


def with_labels(
    df: DataFrame, horizons: Mapping[int, tuple[float, float]] = HORIZONS
) -> DataFrame:
    """Append eligibility and, per horizon H, the labels over months t+1..t+H.

    A row is observable when the entity's history reaches t+H and holds at
    least one row in the window; every label of an unobservable row is NULL.
    """
    w = history()
    have = set(df.columns)
    if "C_base" not in have:
        df = df.withColumn("C_base", baseline_cost(df))
    if "completion_idx" not in have:
        df = df.withColumn("completion_idx", target_completion(df))
    if "schedule_deviation_months" not in have:
        df = df.withColumn("schedule_deviation_months", F.col("schedule_deviation"))

    cost, comp, dev = F.col("C_base"), F.col("completion_idx"), F.col("schedule_deviation_months")
    given = df.columns
    looks: dict[str, Column] = {
        "_rank": F.row_number().over(w),
        "_last": F.max("month_idx").over(entity()),
    }
    for h in horizons:
        ahead = w.rangeBetween(1, h)
        looks |= {
            f"_rows{h}": F.count("*").over(ahead),
            f"_cost{h}": F.max("C_base").over(ahead),
            f"_comp{h}": F.max("completion_idx").over(ahead),
            f"_dev{h}": F.max("schedule_deviation_months").over(ahead),
        }
    df = df.withColumns(looks)

    # step by step: repeated inside each other, the conditions make a method too long for the JVM to compile
    df = df.withColumns({f"_seen{h}": (F.col("_last") - F.col("month_idx") >= h) & (F.col(f"_rows{h}") > 0) for h in horizons})
    df = df.withColumns({
        "eligible_features": F.when((F.col("_rank") >= MIN_HISTORY) & cost.isNotNull(), 1).otherwise(0),
        **{f"target_observable_{h}m": F.col(f"_seen{h}").cast("int") for h in horizons},
        **{f"_pct{h}": F.when(F.col(f"_seen{h}"), (F.col(f"_cost{h}") - cost) / cost) for h in horizons},
        **{f"_drift{h}": F.when(F.col(f"_seen{h}"), F.greatest(
            (F.col(f"_comp{h}") - comp).cast("double"), F.col(f"_dev{h}") - dev)) for h in horizons},
    })
    flags: dict[str, Column] = {}
    for h, (growth, slip) in horizons.items():
        flags |= {f"_over_cost{h}": _flag(F.col(f"_pct{h}") >= growth), f"_over_time{h}": _flag(F.col(f"_drift{h}") >= slip)}
    df = df.withColumns(flags)
    out: dict[str, Column] = {}
    for h in horizons:
        seen, over_cost, over_time = F.col(f"_seen{h}"), F.col(f"_over_cost{h}"), F.col(f"_over_time{h}")
        hit_cost, hit_time = is_true(over_cost == 1.0), is_true(over_time == 1.0)
        known = over_cost.isNotNull() | over_time.isNotNull()
        out |= {
            f"cost_escalation_pct_{h}m": F.col(f"_pct{h}"),
            f"cost_overrun_{h}m": over_cost,
            f"schedule_drift_months_{h}m": F.col(f"_drift{h}"),
            f"schedule_overrun_{h}m": over_time,
            f"overrun_composite_{h}m":
                F.when(hit_cost | hit_time, 1.0).when(known, 0.0),
            f"distress_type_{h}m":
                F.when(~seen | ~known, F.lit("UNOBSERVABLE"))
                .when(hit_cost & hit_time, F.lit("BOTH"))
                .when(hit_cost, F.lit("COST")).when(hit_time, F.lit("SCHEDULE"))
                .otherwise(F.lit("NONE")),
        }
    made = ["eligible_features", *[c for h in horizons for c in label_columns(h)]]
    return df.withColumns(out).select(*[c for c in given if c not in made], *made)


def targets(
    panel: DataFrame, horizons: Mapping[int, tuple[float, float]] = HORIZONS
) -> DataFrame:
    """Labels alone, at the panel's grain; a repeated month fails the job."""
    keep = ["project_id", "reporting_month", "eligible_features"]
    for h in horizons:
        keep += label_columns(h)
    return with_labels(checked_months(panel), horizons).select(*keep)


def cost_sensitivity(
    labelled: DataFrame, h: int = 12, thresholds: tuple[float, ...] = COST_SENSITIVITY
) -> DataFrame:
    """Positives at other growth thresholds, from the stored growth ratio."""
    pct = F.col(f"cost_escalation_pct_{h}m")
    sums = [F.sum((pct >= t).cast("long")).alias(f"p{i}") for i, t in enumerate(thresholds)]
    one = labelled.agg(F.count(pct).alias("observed"), *sums)
    rows = F.explode(F.array(*[
        F.struct(F.lit(t).alias("cost_threshold"), F.col(f"p{i}").alias("positives"))
        for i, t in enumerate(thresholds)
    ]))
    return one.select("observed", rows.alias("r")).select(
        "r.cost_threshold", "observed", "r.positives",
        (F.col("r.positives") / F.col("observed")).alias("positive_rate"),
    )


def label_distribution(labelled: DataFrame, horizons=tuple(HORIZONS)) -> DataFrame:
    """Positives, negatives and base rate of every label."""
    names = [f"{n}_{h}m" for h in horizons for n in LABELS]
    sums = [
        x for n in names for x in (
            F.count(n).alias(f"{n}__n"), F.coalesce(F.sum(n), F.lit(0.0)).cast("long").alias(f"{n}__p"))
    ]
    rows = F.explode(F.array(*[
        F.struct(F.lit(n).alias("label"), F.col(f"{n}__n").alias("observed"), F.col(f"{n}__p").alias("positives"))
        for n in names
    ]))
    return labelled.agg(*sums).select(rows.alias("r")).select(
        "r.label", "r.observed", "r.positives",
        (F.col("r.observed") - F.col("r.positives")).alias("negatives"),
        (F.col("r.positives") / F.col("r.observed")).alias("base_rate"),
    )


def distress_breakdown(labelled: DataFrame, h: int = 12) -> DataFrame:
    return labelled.groupBy(F.col(f"distress_type_{h}m").alias("distress_type")).agg(
        F.count("*").alias("row_count"))


def prevalence(labelled: DataFrame, h: int = 12) -> DataFrame:
    """Share of cost, schedule and composite overruns by year, sector and overall."""
    base = labelled.where(f"target_observable_{h}m = 1").select(
        F.substring("reporting_month", 1, 4).alias("year"), "sector_clean",
        F.col(f"cost_overrun_{h}m").alias("c"), F.col(f"schedule_overrun_{h}m").alias("s"),
        F.col(f"overrun_composite_{h}m").alias("o"),
    )
    sets = [[F.col("year")], [F.col("sector_clean")], []]
    return base.groupingSets(sets, "year", "sector_clean").agg(
        F.count("*").alias("row_count"),
        *[x for k, n in (("c", "cost"), ("s", "schedule"), ("o", "composite")) for x in (
            F.sum(k).cast("long").alias(f"{n}_positives"), F.avg(k).alias(f"{n}_rate"))],
    )
