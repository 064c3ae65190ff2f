"""Dataset, split and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.config import Fold
from tidewatch.operators import dataset as D
from tidewatch.operators import labels as G
from tidewatch.operators import quality as Q
from tidewatch.operators.kinetics import KineticsConfig, empty_peers, kinetics, motion, point_state
from tidewatch.operators.policies import with_heuristic_score
from tidewatch.operators.timeline import duplicate_keys, timeline
from tidewatch.plans import checks as C
from tidewatch.plans.feature_queries import KEYS, labelled, labelled_features, rounded, state_labels
from tidewatch.plans.kept import buckets_of, is_kept, kept_bucketed
from tidewatch.plans.panel import dealt_panel, panel
from tidewatch.plans.registry import query
from tidewatch.schemas import FEATURES, NUMERIC_FEATURES
from tidewatch.sources.bucketed import join_bucketed, read_by_bucket

FOLDS = [
    Fold(1, "1997-12", "1998-01", "1998-12", "1999-01", "1999-12"),
    Fold(2, "1998-12", "1999-01", "1999-12", "2000-01", "2000-11"),
]
LABEL = "overrun_composite_12m"

C.fragment("roles", ("cohort",), """
select * from (select c.*, f.fold_id, case
    when reporting_month <= f.te then 'train' when reporting_month between f.vs and f.ve then 'val'
    when reporting_month between f.ts and f.tx then 'test' end as role
  from cohort c, (values (1,'1997-12','1998-01','1998-12','1999-01','1999-12'),
                         (2,'1998-12','1999-01','1999-12','2000-01','2000-11')) f(fold_id,te,vs,ve,ts,tx))
where role is not null
""")


def scored(spark, sf):
    """Labelled features with the heuristic probability, stored once in buckets of the entity.

    The panel is stored in the same buckets before: the peer statistics and the
    windows read it there, and neither computes nor moves its rows again.
    """
    return spark.table(scored_table(spark, sf))


def scored_table(spark, sf) -> str:
    return kept_bucketed(spark, sf, "scored", lambda: with_heuristic_score(labelled(stored_panel(spark, sf))))


def risks(spark, sf):
    """What the governance rules read of the scored panel, in the same buckets.

    Where no query of the session has stored the scored panel, only these
    columns of it are made: labels and means that nobody reads are pruned.
    """
    columns = [*KEYS, "month_idx", "p", "V_fin_1m", "schedule_deviation_months", "trajectory_risk_score"]
    if is_kept(spark, sf, "scored"):
        return scored(spark, sf).select(*columns)
    return spark.table(kept_bucketed(
        spark, sf, "risks", lambda: with_heuristic_score(labelled(stored_panel(spark, sf))).select(*columns)))


def stored_panel(spark, sf):
    return spark.table(kept_bucketed(spark, sf, "panel", lambda: dealt_panel(spark, sf, buckets_of(spark, sf))))


def roles(spark, sf):
    return D.with_roles(D.cohort(scored(spark, sf)), FOLDS)


def feature_columns(spark, sf) -> list[str]:
    """Names only: with the peers given, no job counts them anew."""
    return kinetics(timeline(panel(spark, sf)), peers=empty_peers(spark)).columns


def feature_table(spark, sf) -> str:
    return kept_bucketed(spark, sf, "features", lambda: read_by_bucket(spark, scored_table(spark, sf)).select(*feature_columns(spark, sf)))


def stored_dataset(spark, sf):
    """Features and labels, each stored apart in buckets of the entity, joined without an exchange.

    One pass over the panel computes and checks both.
    """
    left = feature_table(spark, sf)
    right = kept_bucketed(spark, sf, "targets", lambda: read_by_bucket(spark, scored_table(spark, sf)).select(*G.targets(panel(spark, sf)).columns))
    return D.with_lineage(join_bucketed(spark, left, right, D.GRAIN, drop=["month_idx"]))


_LIN = [f"{C.half_even(c, 6)} as {c}" for c in ("EWMA_V_fin", "Z_peer_V_fin")]


@query("model_dataset", C.check(f"""
select project_id, reporting_month, C_base, trajectory_risk_score, {', '.join(_LIN)}, eligible_features,
  overrun_composite_12m, distress_type_12m, reporting_month as feature_cutoff_month,
  {C.label('month_idx+6')} as target_horizon_month_6m, {C.label('month_idx+12')} as target_horizon_month_12m from ds""", "ds"))
def _(spark, sf):
    df = stored_dataset(spark, sf)
    cols = [*KEYS, "C_base", "trajectory_risk_score", "EWMA_V_fin", "Z_peer_V_fin", "eligible_features", LABEL,
            "distress_type_12m", "feature_cutoff_month", "target_horizon_month_6m", "target_horizon_month_12m"]
    return rounded(df.select(*cols), 6, "EWMA_V_fin", "Z_peer_V_fin")


@query("modelling_cohort", C.check(
    "select project_id, reporting_month, overrun_composite_12m from tgt where eligible_features=1 and target_observable_12m=1", "tgt"))
def _(spark, sf):
    return D.cohort(state_labels(spark, sf)).select(*KEYS, LABEL)


@query("cohort_flags", C.check(
    "select eligible_features, target_observable_6m, target_observable_12m, count(*) as row_count, "
    "count(*)/(select count(*) from tgt) as row_share from tgt group by 1,2,3", "tgt"))
def _(spark, sf):
    return D.cohort_flags(state_labels(spark, sf))


_SUM = " union all ".join(
    f"select '{c}' as feature, count(*) as row_count, count({c}) as present, {C.half_even(f'avg({c})', 6)} as mean, "
    f"{C.half_even(f'stddev_samp({c})', 6)} as std, {C.half_even(f'quantile_cont(cast({c} as double),0.25)', 6)} as q25, "
    f"{C.half_even(f'quantile_cont(cast({c} as double),0.5)', 6)} as median, "
    f"{C.half_even(f'quantile_cont(cast({c} as double),0.75)', 6)} as q75 from kin" for c in NUMERIC_FEATURES)


@query("feature_summary", C.check(_SUM, "kin"))
def _(spark, sf):
    rows = spark.table(feature_table(spark, sf))
    return rounded(D.feature_summary(rows, NUMERIC_FEATURES), 6, "mean", "std", "q25", "median", "q75")


@query("walk_forward_roles", C.check(
    "select fold_id, role, count(*) as row_count, count(distinct project_id) as projects, "
    "cast(sum(overrun_composite_12m) as bigint) as positives from roles group by 1,2", "roles"))
def _(spark, sf):
    return roles(spark, sf).groupBy("fold_id", "role").agg(
        F.count("*").alias("row_count"), F.countDistinct("project_id").alias("projects"),
        F.sum(LABEL).cast("long").alias("positives"))


@query("fold_isolation_audit", C.check("""
select *, test_first - train_last - 1 as buffer_months, train_last < test_first as isolated from (
select fold_id, max(month_idx) filter (role='train') as train_last, min(month_idx) filter (role='test') as test_first,
 count(*) filter (role='train') as train_rows, count(*) filter (role='val') as val_rows, count(*) filter (role='test') as test_rows
from roles group by 1)""", "roles"))
def _(spark, sf):
    return D.fold_isolation(roles(spark, sf))


@query("entity_holdout", C.check("""
select role, count(*) as row_count, count(distinct project_id) as projects from (
 select project_id, case when h<>0 and reporting_month<='1999-12' then 'train' when h=0 and reporting_month>'1999-12' then 'test' end as role
 from (select *, cast(regexp_extract(project_id,'[0-9]+',0) as bigint)%5 as h from cohort)) where role is not null group by 1""", "cohort"))
def _(spark, sf):
    held = F.regexp_extract("project_id", "[0-9]+", 0).cast("long") % 5 == 0
    df = D.entity_holdout(D.cohort(scored(spark, sf)).where(F.col(LABEL).isNotNull()), "1999-12", held)
    return df.groupBy("role").agg(F.count("*").alias("row_count"), F.countDistinct("project_id").alias("projects"))


@query("entity_holdout_hashed")
def _(spark, sf):
    df = D.entity_holdout(D.cohort(state_labels(spark, sf)), "1999-12")
    return df.groupBy("role").agg(F.count("*").alias("row_count"), F.countDistinct("project_id").alias("projects"))


@query("shared_vs_unseen_entities", C.check("""
select fold_id, seen, count(*) as row_count, count(distinct project_id) as projects, avg(overrun_composite_12m) as prevalence
from (select r.*, exists(select 1 from roles t where t.role='train' and t.fold_id=r.fold_id and t.project_id=r.project_id) as seen
      from roles r where role='test') group by 1,2""", "roles"))
def _(spark, sf):
    known, new = D.split_by_train(roles(spark, sf))
    both = known.withColumn("seen", F.lit(True)).unionByName(new.withColumn("seen", F.lit(False)))
    return both.groupBy("fold_id", "seen").agg(
        F.count("*").alias("row_count"), F.countDistinct("project_id").alias("projects"), F.avg(LABEL).alias("prevalence"))


@query("unique_grain", C.check(
    "select project_id, reporting_month, count(*) as row_count from panel group by 1,2 having count(*)>1", "panel"))
def _(spark, sf):
    return duplicate_keys(panel(spark, sf))


FIELDS = ["sector", "revised_cost", "financial_progress", "physical_progress", "schedule_deviation", "rev_completion_idx"]
_COV = " union all ".join(
    f"select cast(grouping(year, sector) as bigint) as level, year, sector, count(*) as row_count, '{f}' as field, count({f}) as present, "
    f"count({f})/count(*) as present_share from (select *, substr(reporting_month,1,4) as year from panel) "
    "group by grouping sets ((year),(sector),())" for f in FIELDS if f != "sector")


@query("coverage_profile", C.check(_COV, "panel"))
def _(spark, sf):
    return Q.coverage_profile(panel(spark, sf), [f for f in FIELDS if f != "sector"])


@query("cohort_sizes", C.check("""
with o as (select project_id, count(*) as obs from panel group by 1)
select n as min_observations, count(*) filter (obs>=n) as projects, cast(coalesce(sum(obs) filter (obs>=n),0) as bigint) as panel_rows,
 count(*) filter (obs>=n)/count(*) as project_share, coalesce(sum(obs) filter (obs>=n),0)/sum(obs) as row_share
from o, unnest([3,4,6,8,12,24,36]) as g(n) group by 1""", "panel"))
def _(spark, sf):
    return Q.cohort_sizes(panel(spark, sf))


@query("reporting_cadence", C.check("""
with g as (select project_id, month_idx, month_idx-lag(month_idx) over (partition by project_id order by month_idx) as gap,
  count(*) over (partition by project_id) as obs from panel),
e as (select project_id, count(*) as n, max(month_idx)-min(month_idx)+1 as span from g where obs>=12 group by 1)
select (select count(*) from e) as projects, (select avg(n) from e) as mean_observations, (select avg(span) from e) as mean_span,
 (select median(gap) from g where obs>=12 and gap is not null) as median_gap,
 (select avg(case when gap<=2 then 1.0::double else 0.0::double end) from g where obs>=12 and gap is not null) as gap_within_2_share,
 (select avg(case when gap=1 then 1.0::double else 0.0::double end) from g where obs>=12 and gap is not null) as strict_monthly_share""", "panel"))
def _(spark, sf):
    return Q.cadence(panel(spark, sf))


_AUDITED = FEATURES + G.label_columns(12)
_LEAKS = " or ".join(f"contains(lower(feature),'{w}')" for w in Q.FORBIDDEN_IN_FEATURES)
_NON_NULL = " union all ".join(f"select '{c}' as feature, count({c}) as present from ds" for c in _AUDITED)


@query("feature_leakage_audit", C.check(f"select feature, present, ({_LEAKS}) as leaks from ({_NON_NULL})", "ds"))
def _(spark, sf):
    """Columns of the dataset, how often they are filled, and whether a model may read them."""
    df = labelled_features(spark, sf)
    bad = Q.leaking_features(_AUDITED)
    one = df.agg(*[F.count(c).alias(c) for c in _AUDITED])
    return one.unpivot([], _AUDITED, "feature", "present").withColumn("leaks", F.col("feature").isin(bad))


@query("temporal_order_audit", C.check(
    f"select project_id, reporting_month from (select *, {C.label('month_idx+12')} as h from tgt join st using (project_id, reporting_month)) "
    "where reporting_month >= h", "tgt", "st"))
def _(spark, sf):
    return Q.order_violations(D.with_lineage(state_labels(spark, sf))).select(*KEYS)


@query("point_in_time_invariance", "select null::varchar as project_id, null::varchar as reporting_month, null::varchar as side where false")
def _(spark, sf):
    """Truncating the panel must not move any feature of an earlier month."""
    cols = [*KEYS, "observation_number", "project_age_months", "V_fin_1m", "V_fin_3m", "A_fin", "C_base",
            "schedule_deviation_change", "completion_date_drift"]
    op = lambda p: motion(point_state(timeline(p), KineticsConfig())).select(*cols)
    return Q.truncation_differences(panel(spark, sf), "1998-12", op).select(*KEYS, "side")


@query("month_arithmetic", C.check(f"""
select reporting_month, month_idx, {C.label('month_idx+6')} as plus_6, {C.label('month_idx+12')} as plus_12,
  {C.label('month_idx-7')} as minus_7, count(*) as row_count, cast(max(month_idx-orig_completion_idx+1) as int) as longest
from panel group by all""", "panel"))
def _(spark, sf):
    from tidewatch.functions.dates import add_months, month_index, month_label, months_inclusive
    m = F.col("reporting_month")
    return panel(spark, sf).groupBy("reporting_month", month_index(m).alias("month_idx")).agg(
        F.count("*").alias("row_count"),
        F.max(months_inclusive(month_label(F.col("orig_completion_idx")), m)).alias("longest"),
    ).select("reporting_month", "month_idx", add_months(m, 6).alias("plus_6"), add_months(m, 12).alias("plus_12"),
             add_months(m, -7).alias("minus_7"), "row_count", "longest")


