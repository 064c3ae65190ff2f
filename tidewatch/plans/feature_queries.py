"""Timeline, kinetics, labels and dataset queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.numbers import half_even
from tidewatch.operators import kinetics as K
from tidewatch.operators import labels as G
from tidewatch.operators.cusum import cusum
from tidewatch.operators.timeline import chronology_violations, timeline
from tidewatch.plans import checks as C
from tidewatch.plans.panel import panel
from tidewatch.plans.registry import query

KEYS = ["project_id", "reporting_month"]


def features(spark: SparkSession, sf: str) -> DataFrame:
    return K.kinetics(timeline(panel(spark, sf)))


def labelled_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features and labels in one pass over one partitioning.

    Labels come first: were the peer join ever to shuffle, nothing after it
    would need the entity partitioning again.
    """
    return labelled(panel(spark, sf))


def labelled(rows: DataFrame) -> DataFrame:
    return K.kinetics(G.with_labels(timeline(rows)))


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Fix the digits of columns whose value depends on summation order."""
    return df.withColumns({n: half_even(F.col(n), digits) for n in names})


TIMELINE = ["observation_number", "months_since_previous_observation", "reporting_gap_flag", "project_age_months"]


@query("timeline", C.check(f"select {','.join(KEYS + TIMELINE)} from tl", "tl"))
def _(spark, sf):
    return timeline(panel(spark, sf)).select(*KEYS, *TIMELINE)


@query("chronology_violations", C.check(
    "select project_id, reporting_month, month_idx, step from (select *, month_idx - lag(month_idx) over "
    "(partition by project_id order by month_idx) as step from panel) where month_idx is null or step <= 0", "panel"))
def _(spark, sf):
    return chronology_violations(panel(spark, sf))


MOTION = ["V_fin_1m", "V_fin_3m", "A_fin", "V_exp_1m", "V_exp_3m", "A_exp", "V_phys_1m", "V_phys_3m", "A_phys",
          "schedule_deviation_change", "completion_date_drift"]
STATE = ["C_base", "cost_revision_ratio", "expenditure_to_baseline", "financial_physical_gap", "sector_clean",
         "scale_bucket", "completion_idx"]


@query("trajectory_motion", C.check(f"select {','.join(KEYS + MOTION)} from mo", "mo"))
def _(spark, sf):
    return K.motion(K.point_state(timeline(panel(spark, sf)), K.KineticsConfig())).select(*KEYS, *MOTION)


@query("trajectory_state", C.check(
    f"select {','.join(KEYS + STATE)}, case when financial_progress>=0 and financial_progress<25 then 'early' "
    "when financial_progress<75 and financial_progress>=25 then 'mid' when financial_progress>=75 then 'late' end "
    "as stage_bucket from st", "st"))
def _(spark, sf):
    return K.point_state(timeline(panel(spark, sf)), K.KineticsConfig()).select(
        *KEYS, *STATE, K.stage_bucket().alias("stage_bucket"))


@query("trajectory_ewma", C.check(
    "select project_id, reporting_month, mean as EWMA_V_fin from mo join ew using (project_id, observation_number)",
    "mo", "ew(project_id, observation_number, mean, weight)"))
def _(spark, sf):
    cfg = K.KineticsConfig()
    moved = K.motion(K.point_state(timeline(panel(spark, sf)), cfg)).select(*KEYS, "month_idx", "V_fin_1m")
    return K.with_ewma(moved, "V_fin_1m", "EWMA_V_fin", cfg.ewma_alpha).select(*KEYS, "EWMA_V_fin")


@query("peer_statistics", C.check(
    f"select reporting_month, sector_clean, scale_bucket, {C.half_even("peer_v_mean", 9)} as peer_v_mean, "
    f"{C.half_even("peer_v_std", 9)} as peer_v_std, peer_count from peers", "peers"))
def _(spark, sf):
    moved = K.motion(K.point_state(timeline(panel(spark, sf)), K.KineticsConfig()))
    return rounded(K.peer_statistics(moved), 9, "peer_v_mean", "peer_v_std")


SCORES = list(K.KineticsConfig().weights)


@query("trajectory_risk_score", C.check(
    f"select {','.join(KEYS)}, {C.half_even('Z_peer_V_fin', 6)} as Z_peer_V_fin, "
    + ", ".join(f"{C.half_even(s, 6)} as {s}" for s in SCORES) + ", trajectory_risk_score from kin", "kin"))
def _(spark, sf):
    df = features(spark, sf).select(*KEYS, "Z_peer_V_fin", *SCORES, "trajectory_risk_score")
    return rounded(df, 6, "Z_peer_V_fin", *SCORES)


LABELS6, LABELS12 = G.label_columns(6), G.label_columns(12)


@query("targets_6m", C.check(f"select {','.join(KEYS + ['eligible_features'] + LABELS6)} from tgt", "tgt"))
def _(spark, sf):
    return G.targets(panel(spark, sf), {6: (0.05, 3.0)})


@query("targets_12m", C.check(f"select {','.join(KEYS + ['eligible_features'] + LABELS12)} from tgt", "tgt"))
def _(spark, sf):
    return G.targets(panel(spark, sf), {12: (0.05, 6.0)})


def state_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels next to the current-row state, without the kinetics."""
    return G.with_labels(K.point_state(timeline(panel(spark, sf)), K.KineticsConfig()))


@query("cost_threshold_sensitivity", C.check(
    "select cast(t as double) as cost_threshold, count(cost_escalation_pct_12m) as observed, "
    "count(*) filter (cost_escalation_pct_12m >= cast(t as double)) as positives, "
    "count(*) filter (cost_escalation_pct_12m >= cast(t as double))/count(cost_escalation_pct_12m) as positive_rate "
    "from tgt, unnest([0.03,0.05,0.1]) as g(t) group by 1", "tgt"))
def _(spark, sf):
    return G.cost_sensitivity(state_labels(spark, sf))


_DIST = " union all ".join(
    f"select '{n}_{h}m' as label, count({n}_{h}m) as observed, cast(sum({n}_{h}m) as bigint) as positives, "
    f"count({n}_{h}m)-cast(sum({n}_{h}m) as bigint) as negatives, sum({n}_{h}m)/count({n}_{h}m) as base_rate from tgt"
    for h in (6, 12) for n in G.LABELS)


@query("label_distribution", C.check(_DIST, "tgt"))
def _(spark, sf):
    return G.label_distribution(state_labels(spark, sf))


@query("distress_breakdown", C.check(
    "select distress_type_12m as distress_type, count(*) as row_count from tgt group by 1", "tgt"))
def _(spark, sf):
    return G.distress_breakdown(state_labels(spark, sf))


@query("prevalence_by_period_and_sector", C.check("""
select year, sector_clean, count(*) as row_count,
  cast(sum(cost_overrun_12m) as bigint) as cost_positives, avg(cost_overrun_12m) as cost_rate,
  cast(sum(schedule_overrun_12m) as bigint) as schedule_positives, avg(schedule_overrun_12m) as schedule_rate,
  cast(sum(overrun_composite_12m) as bigint) as composite_positives, avg(overrun_composite_12m) as composite_rate
from (select tgt.*, sector_clean, substr(reporting_month,1,4) as year from tgt join st using (project_id, reporting_month))
where target_observable_12m = 1 group by grouping sets ((year),(sector_clean),())""", "tgt", "st"))
def _(spark, sf):
    return G.prevalence(state_labels(spark, sf))


CUSUM = ["cusum_step", "cusum_up", "cusum_down", "cusum_alarm", "cusum_segment"]
# the sums one month after the other, as they are defined; 0.5 points of slack, 5 of limit, 3 earlier velocities, gaps over 6 months
C.fragment("cus0", ("mo",), """
select project_id, reporting_month, observation_number, coalesce(months_since_previous_observation > 6, false) as gap,
 case when n >= 3 then cast(floor(cast(v*n-t as double)*100/n) as bigint) end as step
from (select *, count(v) over w as n, sum(v) over w as t from (select *, cast(round(V_fin_1m*100) as bigint) as v from mo)
      window w as (partition by project_id order by observation_number rows between unbounded preceding and 1 preceding))""")
C.fragment("cus(project_id, reporting_month, n, step, up, down, alarm, segment)", ("cus0",), """
select project_id, null::varchar, 0, null::bigint, cast(0 as hugeint), cast(0 as hugeint), null::varchar, 0 from cus0 where observation_number=1
union all
select project_id, reporting_month, n, step, up, down, case when up>50000 then 'UP' when down>50000 then 'DOWN' end, segment
from (select d.project_id, d.reporting_month, d.observation_number as n, d.step,
  case when d.step is null then if(fresh,0,c.up) else greatest(if(fresh,0,c.up)+d.step-5000, 0) end as up,
  case when d.step is null then if(fresh,0,c.down) else greatest(if(fresh,0,c.down)-d.step-5000, 0) end as down,
  c.segment + if(fresh,1,0) as segment
 from cus c join (select * from cus0) d on d.project_id=c.project_id and d.observation_number=c.n+1,
 lateral (select (c.alarm is not null or d.gap) as fresh))""")
_CUSUM = ("select project_id, reporting_month, step as cusum_step, cast(up as bigint) as cusum_up, cast(down as bigint) as cusum_down, "
          "alarm as cusum_alarm, segment as cusum_segment from cus where n>0")
_CUS = "cus(project_id, reporting_month, n, step, up, down, alarm, segment)"


def cusum_path(spark, sf) -> DataFrame:
    return cusum(K.motion(K.point_state(timeline(panel(spark, sf)), K.KineticsConfig()))).select(*KEYS, *CUSUM)


@query("cusum_path", C.check(_CUSUM, _CUS))
def _(spark, sf):
    return cusum_path(spark, sf)


@query("cusum_alarms", C.check(_CUSUM + " and alarm is not null", _CUS))
def _(spark, sf):
    return cusum_path(spark, sf).where("cusum_alarm is not null")
