"""Two-sided cumulative sums of an entity's deviation from its own normal pace.

The deviation of a month is its financial velocity less the mean velocity of
the months before it, so nothing later is looked at. The upper sum grows by the
deviation less a slack and never falls below zero; the lower one mirrors it. A
sum beyond the limit is an alarm, after which both start anew; so they do after
a long reporting gap. All sums are whole ten-thousandths of a point, so no
order of additions can change them.

A sum that is held at zero is its prefix sum less the running minimum of that,
and the restart after an alarm is a matter of segments: each round runs two
plain windows over what lies behind the alarms found so far.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.timeline import history
from tidewatch.session import stored

UNIT = 10_000
#: Alarms of one entity that a round takes in one plan.
PASSES = 4


@dataclass(frozen=True)
class CusumConfig:
    """slack and limit in points of progress a month; warmup: earlier velocities that a mean needs;
    max_gap: months between reports beyond which the sums start anew."""

    slack: float = 0.5
    limit: float = 5.0
    warmup: int = 3
    max_gap: int = 6


def deviations(df: DataFrame, cfg: CusumConfig = CusumConfig(), value: str = "V_fin_1m") -> DataFrame:
    """Add ``cusum_step`` (ten-thousandths, NULL without a velocity or enough earlier ones) and ``_part``, a count of long gaps."""
    past = history().rowsBetween(Window.unboundedPreceding, -1)
    v = F.round(F.col(value) * 100).cast("long")
    n, total = F.count(v).over(past), F.sum(v).over(past)
    off = (v * n - total).cast("double") * (UNIT // 100) / n
    gap = F.coalesce(F.col("months_since_previous_observation") > cfg.max_gap, F.lit(False)).cast("int")
    return df.withColumns({
        "cusum_step": F.when(n >= cfg.warmup, F.floor(off)).cast("long"), "_part": F.sum(gap).over(history())})


def cusum(df: DataFrame, cfg: CusumConfig = CusumConfig(), value: str = "V_fin_1m") -> DataFrame:
    """(project_id, reporting_month, month_idx, cusum_step, cusum_up, cusum_down, cusum_alarm, cusum_segment), a row per row.

    ``df`` has the timeline columns and ``value``. Alarms are UP or DOWN; a
    month without a deviation leaves the sums as they are. The segment counts
    restarts. Every round finds the first ``PASSES`` alarms of each part and
    writes its rows; the next one takes up the rows behind them.
    """
    slack, limit = round(cfg.slack * UNIT), round(cfg.limit * UNIT)
    rows = deviations(df, cfg, value).select("project_id", "reporting_month", "month_idx", "cusum_step", "_part")
    left = stored(rows.withColumn("_restart", F.lit(0).cast("long")), "cusum")
    spec = Window.partitionBy("project_id", "_part", "_restart").orderBy("month_idx")
    upto, earlier = spec.rowsBetween(Window.unboundedPreceding, 0), spec.rowsBetween(Window.unboundedPreceding, -1)
    step = F.col("cusum_step")
    alarm = F.when(F.col("cusum_up") > limit, "UP").when(F.col("cusum_down") > limit, "DOWN")
    done = None
    while True:
        for _ in range(PASSES):
            left = left.select(*rows.columns, "_restart").withColumns({
                "_up": F.sum(F.when(step.isNotNull(), step - slack).otherwise(0)).over(upto),
                "_down": F.sum(F.when(step.isNotNull(), -step - slack).otherwise(0)).over(upto),
            }).withColumns({
                f"cusum_{k}": F.col(f"_{k}") - F.least(F.min(f"_{k}").over(upto), F.lit(0)) for k in ("up", "down")
            }).withColumn("cusum_alarm", alarm).withColumn("_behind", F.count("cusum_alarm").over(earlier) > 0).withColumn(
                "_restart", F.col("_restart") + F.col("_behind").cast("int"))
        judged = stored(left, "cusum")
        # of a part whose last segment still has rows behind an alarm only those go on
        final = judged.where("not _behind").drop("_behind", "_up", "_down", "_restart")
        done = final if done is None else done.unionByName(final)
        left = judged.where("_behind").select(*rows.columns, "_restart")
        if left.isEmpty():
            break
    anew = (F.lag("cusum_alarm").over(history()).isNotNull() | (F.col("_part") > F.lag("_part").over(history()))).cast("int")
    return done.withColumn("cusum_segment", F.sum(F.coalesce(anew, F.lit(0))).over(history()).cast("int")).drop("_part")
