"""Classifier metrics from score histograms.

Stored probabilities carry four digits, so a histogram has at most 10,001 rows
per group whatever the number of predictions. Every metric is computed from it:
one pass over the facts with partial aggregation, then small windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.numbers import exact_mean, half_even
from tidewatch.operators.policies import risk_tier
from tidewatch.operators.ranking import running_totals

DIGITS = 4


def score_histogram(
    df: DataFrame, by: Sequence[str] = (), p: str = "p", y: str = "y", digits: int = DIGITS
) -> DataFrame:
    """Counts and positives per distinct score; rows without score or label drop out."""
    return (
        df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
        .groupBy(*by, half_even(F.col(p), digits).alias("score"))
        .agg(F.count("*").alias("n"), F.sum(y).cast("long").alias("pos"))
    )


def with_overall(hist: DataFrame, keep: Sequence[str], collapse: str) -> DataFrame:
    """Add the histogram over all values of ``collapse`` (shown as NULL)."""
    full = [F.col(c) for c in (*keep, collapse, "score")]
    total = [F.col(c) for c in (*keep, "score")]
    return hist.groupingSets([full, total], *keep, collapse, "score").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def decision_rates(tp: Column, fp: Column, fn: Column, tn: Column, digits: int = 4) -> dict[str, Column]:
    """Rates of one confusion table; undefined ratios are 0."""
    total = tp + fp + fn + tn
    return {
        "precision": half_even(_ratio(tp, tp + fp), digits),
        "recall": half_even(_ratio(tp, tp + fn), digits),
        "f1": half_even(_ratio(tp * 2, tp * 2 + fp + fn), digits),
        "false_alert_rate": half_even(_ratio(fp, fp + tn), digits),
        "alert_rate": half_even(_ratio(tp + fp, total), digits),
    }


def _confusion(tau: float) -> list[Column]:
    hit = F.col("score") >= tau
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return [
        total(F.when(hit, pos)).alias("tp"), total(F.when(hit, neg)).alias("fp"),
        total(F.when(~hit, pos)).alias("fn"), total(F.when(~hit, neg)).alias("tn"),
    ]


def curve(hist: DataFrame, by: Sequence[str]) -> DataFrame:
    """Running totals of a histogram, highest score first."""
    w = Window.partitionBy(*by).orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumns({"cum_n": F.sum("n").over(w), "cum_pos": F.sum("pos").over(w)})


def exact_curve(df: DataFrame, by: Sequence[str] = (), p: str = "p", y: str = "y") -> DataFrame:
    """The same totals for scores of unlimited precision, without a one-task window."""
    run = running_totals(
        df.where(F.col(y).isNotNull()), by, p, {"pos": F.col(y).cast("long")}, descending=True)
    return run.select(
        *by, F.col(p).alias("score"), "n", "pos",
        F.col("n_through").alias("cum_n"), F.col("pos_through").alias("cum_pos"))


def metrics(points: DataFrame, by: Sequence[str] = (), tau: float = 0.5) -> DataFrame:
    """All metrics per group from a ``curve``.

    PR-AUC is average precision (a step sum, not a trapezoid) and ROC-AUC counts
    ties as half. A group with one class only gets the fixed values.
    """
    pos, neg, s = F.col("pos"), F.col("n") - F.col("pos"), F.col("score")
    sums = points.groupBy(*by).agg(
        F.sum("n").alias("support"), F.sum("pos").alias("positives"),
        F.sum(pos * F.col("cum_pos") / F.col("cum_n")).alias("_ap"),
        F.sum(neg * (F.col("cum_pos") - pos / 2.0)).alias("_pairs"),
        F.sum(neg * s * s + pos * (1.0 - s) * (1.0 - s)).alias("_sq"),
        *_confusion(tau),
    )
    negatives = F.col("support") - F.col("positives")
    two = (F.col("positives") > 0) & (negatives > 0)
    rates = decision_rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    keep = lambda c, fixed: F.when(two, c).otherwise(F.lit(fixed))
    return sums.select(
        *by,
        keep(half_even(F.col("_ap") / F.col("positives"), 4), 0.0).alias("pr_auc"),
        keep(half_even(F.col("_pairs") / (F.col("positives") * negatives), 4), 0.5).alias("roc_auc"),
        keep(half_even(F.col("_sq") / F.col("support"), 4), 0.0).alias("brier_score"),
        *[keep(c, 0.0).alias(k) for k, c in rates.items()],
        *[F.when(two, F.col(c)).alias(c) for c in ("tp", "fp", "tn", "fn")],
        "support", "positives",
        keep(half_even(F.col("positives") / F.col("support"), 4), None).alias("prevalence"),
    )


def threshold_grid(hist: DataFrame, taus: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Decision rates at each threshold, from one aggregation."""
    sums = []
    for i, t in enumerate(taus):
        hit = F.col("score") >= t
        sums += [F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias(f"tp{i}"),
                 F.sum(F.when(hit, F.col("n") - F.col("pos")).otherwise(0)).alias(f"fp{i}")]
    one = hist.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), *sums)
    rows = F.explode(F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"))
        for i, t in enumerate(taus)]))
    flat = one.select(*by, "n", "pos", rows.alias("r")).select(
        *by, "r.threshold", "r.tp", "r.fp", (F.col("pos") - F.col("r.tp")).alias("fn"),
        (F.col("n") - F.col("pos") - F.col("r.fp")).alias("tn"))
    rates = decision_rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    return flat.select(*by, "threshold", "tp", "fp", *[c.alias(k) for k, c in rates.items()])


def _edges_passed(value: Column, edges: Sequence[float]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= value))


def reliability(hist: DataFrame, n_bins: int = 10) -> DataFrame:
    """Equal-width reliability table; the last bin is closed, empty bins stay."""
    step = 1.0 / n_bins
    edges = [i * step for i in range(n_bins + 1)]
    slot = F.least(F.greatest(_edges_passed(F.col("score"), edges), F.lit(1)), F.lit(n_bins))
    filled = hist.groupBy(slot.alias("bin")).agg(
        F.sum("n").alias("count"),
        exact_mean(F.col("score"), DIGITS, F.col("n")).alias("avg_p"),
        (F.sum("pos") / F.sum("n")).alias("avg_y"))
    bins = hist.sparkSession.range(1, n_bins + 1).select(F.col("id").cast("int").alias("bin"))
    b = F.col("bin")
    low, high = (b - 1) * F.lit(step), b * F.lit(step)
    text = lambda c: F.format_string("%.1f", half_even(c, 1))
    return bins.join(filled, "bin", "left").select(
        "bin",
        F.concat(F.lit("["), text(low), F.lit(", "), text(high), F.lit(")")).alias("range"),
        F.coalesce("count", F.lit(0)).alias("count"),
        half_even(F.coalesce("avg_p", (low + high) / 2.0), 4).alias("mean_pred_prob"),
        half_even(F.coalesce("avg_y", F.lit(0.0)), 4).alias("observed_event_rate"),
        half_even(F.coalesce(F.abs(F.col("avg_p") - F.col("avg_y")), F.lit(0.0)), 4).alias("gap"),
    )


def calibration_error(hist: DataFrame, n_bins: int = 10) -> DataFrame:
    """Expected calibration error: bin gaps weighted by bin size."""
    step = 1.0 / n_bins
    slot = F.least(F.greatest(_edges_passed(F.col("score"), [i * step for i in range(n_bins + 1)]), F.lit(1)),
                   F.lit(n_bins))
    bins = hist.groupBy(slot.alias("bin")).agg(
        F.sum("n").alias("n"), F.sum(F.rint(F.col("score") * 10.0**DIGITS).cast("bigint") * F.col("n")).alias("sp"), F.sum("pos").alias("sy"))
    return bins.agg(half_even(F.sum(F.abs(F.col("sp") - F.col("sy") * 10**DIGITS)).cast("double") / F.sum("n") / 10.0**DIGITS, 4).alias("ece"))


def operating_points(
    hist: DataFrame,
    wanted: Sequence[tuple[str, float]],
    by: Sequence[str] = (),
    low: float = 0.05,
    high: float = 0.95,
    steps: int = 200,
) -> DataFrame:
    """For each (rate name, target): the first threshold of an even grid that comes closest.

    Histogram rows fall into the grid cell they reach; suffix sums over at most
    ``steps + 1`` cells give the confusion table at every threshold.
    """
    width = (high - low) / (steps - 1)
    grid = [low + i * width for i in range(steps)]
    cells = hist.groupBy(*by, _edges_passed(F.col("score"), grid).alias("cell")).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    # every threshold must be tried, also those no score falls next to
    frame = cells.groupBy(*by).agg(F.sum("n").alias("total"), F.sum("pos").alias("positives")).withColumn(
        "cell", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    w = Window.partitionBy(*by).orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, 0)
    full = frame.join(cells, [*by, "cell"], "left").withColumns({
        "tp": F.sum(F.coalesce("pos", F.lit(0))).over(w),
        "called": F.sum(F.coalesce("n", F.lit(0))).over(w),
    }).withColumn("threshold", F.lit(low) + (F.col("cell") - 1) * F.lit(width))
    fp = F.col("called") - F.col("tp")
    rates = {
        "recall": _ratio(F.col("tp"), F.col("positives")),
        "far": _ratio(fp, F.col("total") - F.col("positives")),
        "alert_rate": F.col("called") / F.col("total"),
    }
    aims = F.explode(F.array(*[
        F.struct(F.lit(m).alias("matched_on"), F.lit(float(v)).alias("target"), rates[m].alias("value"))
        for m, v in wanted]))
    tried = full.select(*by, "threshold", "tp", "called", "total", "positives", aims.alias("a"))
    off = F.abs(F.col("a.value") - F.col("a.target"))
    best = tried.groupBy(*by, F.col("a.matched_on").alias("matched_on"), F.col("a.target").alias("target")).agg(
        F.min_by(F.struct("threshold", "tp", "called", "total", "positives"),
                 F.struct(off.alias("o"), F.col("threshold").alias("t"))).alias("b"))
    tp, called = F.col("b.tp"), F.col("b.called")
    pct = lambda c: half_even(c * 100.0, 2)
    return best.select(
        *by, "matched_on", "target", half_even(F.col("b.threshold"), 3).alias("threshold"),
        pct(_ratio(tp, called)).alias("precision"), pct(_ratio(tp, F.col("b.positives"))).alias("recall"),
        pct(_ratio(called - tp, F.col("b.total") - F.col("b.positives"))).alias("false_alert_rate"),
        pct(called / F.col("b.total")).alias("alert_rate"), called.alias("alerts_count"))


def tier_distribution(hist: DataFrame, by: str) -> DataFrame:
    """Share of each tier, mean and median probability, prevalence; NULL is overall."""
    h = with_overall(hist, [], by)
    tier, n = risk_tier(F.col("score")), F.col("n")
    share = lambda t: half_even(100.0 * F.sum(F.when(tier == t, n).otherwise(0)) / F.sum("n"), 4)
    return h.groupBy(by).agg(
        F.sum("n").alias("observations"),
        half_even(F.sum("pos") / F.sum("n"), 6).alias("prevalence"),
        half_even(exact_mean(F.col("score"), DIGITS, n), 6).alias("mean_prob"),
        # at most 10,001 distinct scores, so the exact median stays small
        half_even(F.percentile("score", 0.5, n), 6).alias("median_prob"),
        *[share(t).alias(f"{t.lower()}_pct") for t in ("NORMAL", "WATCH", "REVIEW", "ESCALATE")],
    )
