"""Threshold policies and risk tiers, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import ESCALATE, REVIEW, WATCH
from tidewatch.functions.numbers import half_even, is_true

TIERS = ["NORMAL", "WATCH", "REVIEW", "ESCALATE"]


def policy_a(exp_ratio: float = 0.90, deviation: float = 12.0) -> Column:
    """Static alert on the current state."""
    spent = F.coalesce("expenditure_to_baseline", F.lit(0.0)) >= exp_ratio
    late = F.coalesce("schedule_deviation_months", F.lit(0.0)) >= deviation
    return (spent | late).cast("int")


def policy_b(
    velocity: float = 0.5, ewma: float = 0.5, z_peer: float = -1.0, score: float = 40.0
) -> Column:
    """Kinetic alert: stalled, behind the peers, or a high risk score."""
    return (
        is_true(F.col("V_fin_1m") <= velocity)
        | is_true(F.col("EWMA_V_fin") <= ewma)
        | is_true(F.col("Z_peer_V_fin") <= z_peer)
        | is_true(F.col("trajectory_risk_score") >= score)
    ).cast("int")


def pseudo_probability(alert: Column) -> Column:
    return F.when(alert == 1, 0.8).otherwise(0.2)


def heuristic_probability() -> Column:
    """The risk score as a stand-in probability, at four digits."""
    return half_even(F.col("trajectory_risk_score") / 100.0, 4)


def risk_tier(p: Column) -> Column:
    """Tier of a probability; NULL counts as NORMAL."""
    return (
        F.when(p >= ESCALATE, F.lit("ESCALATE")).when(p >= REVIEW, F.lit("REVIEW"))
        .when(p >= WATCH, F.lit("WATCH")).otherwise(F.lit("NORMAL"))
    )


def tier_rank(tier: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TIERS]), tier) - 1


def is_alert(p: Column) -> Column:
    """Unknown probabilities raise no alert."""
    return is_true(p >= WATCH)


def with_heuristic_score(df: DataFrame) -> DataFrame:
    """Add ``p``, tier and alert flag to every row.

    A row without a score keeps its place: ``p`` is NULL, the tier NORMAL, and
    there is no alert.
    """
    p = F.col("p")
    return df.withColumn("p", heuristic_probability()).withColumns(
        {"risk_tier": risk_tier(p), "alert": is_alert(p)})
