"""Trajectory kinetics and the heuristic risk score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import KineticsConfig
from tidewatch.functions.dates import month_index
from tidewatch.functions.numbers import clip, half_even, is_true
from tidewatch.operators.timeline import history
from tidewatch.session import with_known_size

PEER_COMPONENT = "score_peer_underperformance"
PEER_KEYS = ["reporting_month", "sector_clean", "scale_bucket"]


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def baseline_cost(df: DataFrame) -> Column:
    """Revised cost where valid, else approved cost where valid."""
    return F.coalesce(positive(F.col("revised_cost")), positive(F.col("approved_cost")))


def target_completion(df: DataFrame) -> Column:
    """Planned completion as a month index: revised, else original."""
    if "rev_completion_idx" in df.columns:
        return F.coalesce("rev_completion_idx", "orig_completion_idx")
    known = [c for c in ("revised_completion_date", "original_completion_date") if c in df.columns]
    if not known:
        return F.lit(None).cast("int")
    return F.coalesce(*[month_index(F.col(c)) for c in known])


def sector_group() -> Column:
    s = F.trim("sector")
    return F.when(s.isNull() | s.isin("", "nan", "UNKNOWN"), F.lit("OTHER")).otherwise(s)


def scale_bucket(cfg: KineticsConfig) -> Column:
    small, mega = cfg.scale_edges
    c = F.col("C_base")
    return (
        F.when(c < small, F.lit("SMALL")).when(c < mega, F.lit("MAJOR"))
        .when(c >= mega, F.lit("MEGA")).otherwise(F.lit("UNKNOWN"))
    )


def stage_bucket(cfg: KineticsConfig = KineticsConfig()) -> Column:
    early, late = cfg.stage_edges
    p = F.col("financial_progress")
    return (
        F.when((p >= 0) & (p < early), F.lit("early")).when((p >= early) & (p < late), F.lit("mid"))
        .when(p >= late, F.lit("late"))
    )


def point_state(df: DataFrame, cfg: KineticsConfig) -> DataFrame:
    """Columns that need only the current row."""
    rev, app = positive(F.col("revised_cost")), positive(F.col("approved_cost"))
    phys = F.col("physical_progress")
    df = df.withColumns({
        "C_base": baseline_cost(df),
        "cost_revision_ratio": (rev - app) / app,
        "expenditure_clean": F.when(F.col("expenditure") >= 0, F.col("expenditure")),
        "physical_progress_clean": F.when((phys >= 0) & (phys <= 100), phys),
        "completion_idx": target_completion(df),
        "schedule_deviation_months": F.col("schedule_deviation"),
        "sector_clean": sector_group(),
    })
    return df.withColumns({
        "expenditure_to_baseline": F.col("expenditure_clean") / F.col("C_base"),
        "financial_physical_gap": F.col("financial_progress") - F.col("physical_progress_clean"),
        "scale_bucket": scale_bucket(cfg),
    })


def motion(df: DataFrame) -> DataFrame:
    """Velocity and acceleration over observations; NULL rows are not skipped."""
    w = history()
    tracks = {"fin": "financial_progress", "exp": "expenditure_clean", "phys": "physical_progress_clean"}

    def change(name: str, back: int) -> Column:
        return F.col(name) - F.lag(name, back).over(w)

    first = {f"V_{k}_{b}m": change(c, b) for k, c in tracks.items() for b in (1, 3)}
    first["schedule_deviation_change"] = change("schedule_deviation_months", 1)
    first["completion_date_drift"] = change("completion_idx", 1).cast("double")
    second = {f"A_{k}": change(f"V_{k}_1m", 1) for k in tracks}
    return df.withColumns(first).withColumns(second)


def decayed_mean(values: Column, alpha: float) -> Column:
    """Running exponential mean of an array, oldest first."""
    return decayed_fold(values, alpha, F.lit(None).cast("double"), F.lit(1.0))["out"]


def decayed_fold(values: Column, alpha: float, mean: Column, weight: Column) -> Column:
    """Fold an array into its running exponential mean, from a given start.

    A NULL value repeats the mean and lets the weight of the past decay; the
    mean is NULL until the first value. Gives the means (``out``) and the last
    ``mean`` and ``weight``, from which a later fold goes on.
    """
    start = F.struct(
        F.array().cast("array<double>").alias("out"), mean.cast("double").alias("mean"), weight.cast("double").alias("weight"))

    def step(acc: Column, x: Column) -> Column:
        aged = acc["weight"] * F.lit(1.0 - alpha)
        blended = F.when(
            acc["mean"] != x,
            (aged * acc["mean"] + F.lit(alpha) * x) / (aged + F.lit(alpha)),
        ).otherwise(x)
        mean = (
            F.when(x.isNull(), acc["mean"]).when(acc["mean"].isNull(), x).otherwise(blended)
        )
        weight = F.when(x.isNotNull() | acc["mean"].isNull(), F.lit(1.0)).otherwise(aged)
        return F.struct(
            F.concat(acc["out"], F.array(mean)).alias("out"),
            mean.alias("mean"),
            weight.alias("weight"),
        )

    return F.aggregate(values, start, step)


def with_ewma(df: DataFrame, value: str, out: str, alpha: float) -> DataFrame:
    """Exponential mean per entity.

    Only the values are gathered, and folded once, at the entity's first row;
    the rows themselves stay as they lie. The windows are those of
    ``history()``, and an array never holds more than the entity's months.
    """
    w = history()
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    packed = df.withColumns({"_at": F.row_number().over(w), "_values": F.collect_list(F.struct(F.col(value).alias("v"))).over(whole)})
    folded = packed.withColumn("_means", F.when(F.col("_at") == 1, decayed_mean(F.col("_values.v"), alpha))).drop("_values")
    spread = folded.withColumn("_means", F.first("_means").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return spread.withColumn(out, F.element_at("_means", F.col("_at"))).drop("_at", "_means")


def peer_statistics(df: DataFrame) -> DataFrame:
    """Velocity of each (month, sector, scale) group: mean, spread, size.

    Needs ``V_fin_1m`` and the peer keys; partial aggregation runs before the
    shuffle, so a dominant sector costs no more than a small one.
    """
    return df.groupBy(*PEER_KEYS).agg(
        F.avg("V_fin_1m").alias("peer_v_mean"),
        F.stddev_samp("V_fin_1m").alias("peer_v_std"),
        F.count("V_fin_1m").alias("peer_count"),
    )


def peer_score(df: DataFrame, peers: DataFrame, cfg: KineticsConfig) -> DataFrame:
    enough = (F.col("peer_count") >= cfg.min_peers) & (
        F.coalesce("peer_v_std", F.lit(0.0)) > cfg.min_peer_std
    )
    z = F.when(
        is_true(enough), (F.col("V_fin_1m") - F.col("peer_v_mean")) / F.col("peer_v_std")
    ).otherwise(F.lit(0.0))
    return (
        df.join(peers, PEER_KEYS, "left")
        .withColumn("Z_peer_V_fin", z)
        .drop("peer_v_mean", "peer_v_std", "peer_count")
    )


def component_scores() -> dict[str, Column]:
    """Each component in 0..1, NULL where its inputs are missing."""
    v, a, etb = F.col("V_fin_1m"), F.col("A_fin"), F.col("expenditure_to_baseline")
    fin = F.col("financial_progress")
    burn = F.when((fin > 0) & (etb > 0), etb / (fin / 100.0))
    drift, slip = F.col("completion_date_drift"), F.col("schedule_deviation_change")
    worst = F.greatest(F.coalesce(drift, F.lit(0.0)), F.coalesce(slip, F.lit(0.0)))
    return {
        "score_stalled_velocity": clip(1.0 - v / 3.0, 0.0, 1.0),
        "score_deceleration": clip(-a / 2.0, 0.0, 1.0),
        "score_burn_anomaly": clip((burn - 1.0) / 0.5, 0.0, 1.0),
        "score_cost_revision": F.coalesce(clip(F.col("cost_revision_ratio") / 0.25, 0.0, 1.0), F.lit(0.0)),
        "score_schedule_deterioration":
            F.when(drift.isNotNull() | slip.isNotNull(), clip(worst / 6.0, 0.0, 1.0)),
        "score_peer_underperformance":
            F.when(v.isNotNull(), clip(-F.col("Z_peer_V_fin") / 2.0, 0.0, 1.0)),
        "score_physical_decoupling": clip(F.col("financial_physical_gap") / 20.0, 0.0, 1.0),
    }


def _total(cfg: KineticsConfig, pick) -> Column:
    zero = F.lit(0.0)
    return reduce(lambda x, y: x + y, [
        F.when(F.col(n).isNotNull(), pick(n, w)).otherwise(zero) for n, w in cfg.weights.items()
    ], zero)


def _score_parts(cfg: KineticsConfig) -> tuple[Column, Column, Column]:
    """Weighted sum of the components present, their weight, and their number."""
    present = reduce(lambda x, y: x + y, [F.col(n).isNotNull().cast("int") for n in cfg.weights])
    return _total(cfg, lambda n, w: F.col(n) * w), _total(cfg, lambda n, w: F.lit(w)), present


def _weighted_mean(total: Column, weight: Column, present: Column, cfg: KineticsConfig) -> Column:
    return F.when((present >= cfg.min_components) & (weight > 0), half_even(total / weight * 100.0, 2))


def risk_score(cfg: KineticsConfig) -> Column:
    """Weighted mean of the components present, times 100."""
    return _weighted_mean(*_score_parts(cfg), cfg)


def with_risk_score(df: DataFrame, cfg: KineticsConfig) -> DataFrame:
    """The risk score from columns of its parts: in one expression they make a method too long for the JVM to compile."""
    parts = dict(zip(("_total", "_weight", "_present"), _score_parts(cfg)))
    score = _weighted_mean(*[F.col(c) for c in parts], cfg)
    return df.withColumns(parts).withColumn("trajectory_risk_score", score).drop(*parts)


def kinetics(
    timelines: DataFrame,
    cfg: KineticsConfig = KineticsConfig(),
    peers: DataFrame | None = None,
) -> DataFrame:
    """Point-in-time features, component scores and the risk score.

    ``peers`` fixes the peer statistics from outside (operational scoring);
    otherwise they come from this panel, month by month, so no later month can
    leak in. Computing them runs one job (see ``with_known_size``).
    """
    moved = motion(point_state(timelines, cfg))
    if peers is None:
        # only the columns the statistics read; the rest of the scan is pruned
        peers = with_known_size(peer_statistics(moved))
    # what needs no peers is scored before the windows of the mean, which keeps the methods generated after them short
    scores = component_scores()
    peerless = {c: s for c, s in scores.items() if c != PEER_COMPONENT}
    smoothed = with_ewma(moved.withColumns(peerless), "V_fin_1m", "EWMA_V_fin", cfg.ewma_alpha)
    full = peer_score(smoothed, peers, cfg).withColumn(PEER_COMPONENT, scores[PEER_COMPONENT])
    last = ["EWMA_V_fin", "Z_peer_V_fin", *scores]
    ordered = full.select(*[c for c in full.columns if c not in last and c != "expenditure_clean"], *last)
    return with_risk_score(ordered, cfg)


def empty_peers(spark) -> DataFrame:
    """Peer table for entities scored alone: every z-score becomes 0."""
    return spark.sql(
        "select cast(null as string) as reporting_month, cast(null as string) as sector_clean, "
        "cast(null as string) as scale_bucket, cast(null as double) as peer_v_mean, "
        "cast(null as double) as peer_v_std, cast(null as bigint) as peer_count where false")
