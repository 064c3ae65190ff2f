"""Operational lists, snapshots, registrations, and audits that read several tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import evaluate as E
from tidewatch.operators import kinetics as K
from tidewatch.operators import quality as Q
from tidewatch.operators import replay as R
from tidewatch.operators.dataset import cohort, entity_holdout, split_by_train
from tidewatch.operators.policies import with_heuristic_score
from tidewatch.operators.timeline import chronology_violations, duplicate_keys, timeline
from tidewatch.plans import checks as C
from tidewatch.plans.dataset_queries import LABEL, roles, scored
from tidewatch.plans.evaluation_queries import metrics_sql
from tidewatch.plans.feature_queries import KEYS, features, rounded
from tidewatch.plans.monitor_queries import kept_outcomes, panel_registry, registry
from tidewatch.plans.panel import panel
from tidewatch.plans.registry import query
from tidewatch.streaming import governance as G
from tidewatch.session import fresh_path
from tidewatch.streaming import intake as N
from tidewatch.streaming.committed import Committed

ONE = "N00000012"


@query("entity_observation_list", C.check(f"""
select reporting_month, financial_progress, schedule_deviation_months, trajectory_risk_score, p from sc
where project_id='{ONE}' order by reporting_month desc""", "sc"))
def _(spark, sf):
    """Observations of one entity, newest first."""
    df = with_heuristic_score(features(spark, sf)).where(F.col("project_id") == ONE)
    return df.select("reporting_month", "financial_progress", "schedule_deviation_months", "trajectory_risk_score", "p").orderBy(
        F.desc("reporting_month"))


_FIRST = "cast(w.reporting_month||'-01' as date)"


@query("entity_warning_list", C.check(f"""
select warning_id, reporting_month, risk_probability, issued_seq, status, strftime({_FIRST} + interval 15 day, '%Y-%m-%d') as response_deadline
from wrn w where project_id=(select min(project_id) from wrn) order by issued_seq desc""", "wrn"))
def _(spark, sf):
    """Warnings of the first entity that has any, newest first, each with its response deadline."""
    every = G.warnings(kept_outcomes(spark, sf))
    rows = every.where(F.col("project_id") == every.agg(F.min("project_id")).scalar())
    dated = G.with_deadline(rows, F.to_date(F.concat("reporting_month", F.lit("-01"))))
    return dated.select(
        "warning_id", "reporting_month", "risk_probability", "issued_seq", "status",
        F.date_format("response_deadline", "yyyy-MM-dd").alias("response_deadline")).orderBy(F.desc("issued_seq"))


@query("warning_deadlines", C.check(
    f"select project_id, warning_id, strftime({_FIRST} + interval 15 day, '%Y-%m-%d') as response_deadline from wrn w", "wrn"))
def _(spark, sf):
    dated = G.with_deadline(G.warnings(kept_outcomes(spark, sf)), F.to_date(F.concat("reporting_month", F.lit("-01"))))
    return dated.select("project_id", "warning_id", F.date_format("response_deadline", "yyyy-MM-dd").alias("response_deadline"))


@query("registration_audit", C.check("""
select project_id, arrival_seq, initial_reporting_month as reporting_month, 'PROJECT_REGISTERED' as event_type,
 'AUD-'||upper(sha256(project_id||'|register')) as event_id from rgs""", "rgs"))
def _(spark, sf):
    """The ledger rows that accepted registrations add."""
    return G.registration_ledger(registry(spark, sf)).select(
        "project_id", "arrival_seq", "reporting_month", "event_type", "event_id")


_PLAIN = [c for c in N.SNAPSHOT_FIELDS if c != "EWMA_V_fin"]


@query("features_snapshot", C.check(
    f"select project_id, reporting_month, {', '.join(_PLAIN)}, {C.half_even('EWMA_V_fin', 6)} as EWMA_V_fin from kin", "kin"))
def _(spark, sf):
    """What is stored beside each accepted observation."""
    df = features(spark, sf).select(*KEYS, N.features_snapshot().alias("s")).select(*KEYS, "s.*")
    return rounded(df, 6, "EWMA_V_fin")


@query("scenario_reset", C.check(f"""
with t as (select 'registrations' as name, project_id from prg union all select 'observations', project_id from sc
 union all select 'warnings', project_id from wrn union all select 'responses', project_id from out where outcome='RESPONSE_ACCEPTED'
 union all select 'escalations', project_id from esc union all select 'audit_events', project_id from aud)
select name, count(*) as row_count, count(*) filter (project_id<>'{ONE}') as rows_left from t group by 1""", "prg", "sc", "wrn", "out", "esc", "aud"))
def _(spark, sf):
    """Rows of the six operational tables before and after one entity is reset."""
    out = kept_outcomes(spark, sf)
    tables = {
        "registrations": panel_registry(spark, sf), "observations": out.where("kind = 'OBSERVE'"), "warnings": G.warnings(out),
        "responses": G.responses(out), "escalations": G.escalations(out), "audit_events": G.audit_ledger(out)}
    kept = Committed(spark, fresh_path(spark, "operations"))
    batch = kept.batch(0)
    for name, t in tables.items():
        batch.put(t, name)
    batch.commit()
    full = {name: kept.read(name) for name in tables}
    kept.reset([ONE])
    parts = [df.select(F.lit(name).alias("name"), F.lit(b).alias("b"), F.lit(1 - b).alias("a"))
             for name in tables for b, df in ((1, full[name]), (0, kept.read(name)))]
    return reduce(DataFrame.unionByName, parts).groupBy("name").agg(F.sum("b").alias("row_count"), F.sum("a").alias("rows_left"))


ERAS = [("early", "0000", "1995"), ("middle", "1996", "1999"), ("late", "2000", "9999")]
_ERA = "case " + " ".join(f"when substr(reporting_month,1,4)<='{b}' then '{n}'" for n, _, b in ERAS) + " end"
_FIELDS = ["physical_progress", "financial_progress", "expenditure", "approved_cost"]


@query("coverage_by_era", C.check(" union all ".join(
    f"select {_ERA} as era, '{f}' as field, count(*) as row_count, count({f}) as present, count({f})/count(*) as present_share from panel group by 1"
    for f in _FIELDS), "panel"))
def _(spark, sf):
    return Q.era_coverage(panel(spark, sf), ERAS, _FIELDS)


def _curve_of(fragment: str, source: str, keys: str) -> None:
    C.fragment(f"{fragment}_h", (source,), f"select {keys}, {C.half_even('p', 4)} as score, count(*) as n, "
               f"cast(sum(y) as bigint) as pos from {source} where p is not null group by all")
    C.fragment(f"{fragment}_c", (f"{fragment}_h",), f"select *, sum(n) over w as cn, sum(pos) over w as cp from {fragment}_h "
               f"window w as (partition by {keys} order by score desc rows between unbounded preceding and current row)")


C.fragment("seen_p", ("roles",), """
select fold_id, exists(select 1 from roles t where t.role='train' and t.fold_id=r.fold_id and t.project_id=r.project_id) as seen,
 p, overrun_composite_12m as y from roles r where role='test'""")
_curve_of("seen", "seen_p", "fold_id, seen")


@query("shared_vs_unseen_metrics", C.check(metrics_sql("seen_c", ["fold_id", "seen"]), "seen_c"))
def _(spark, sf):
    """All metrics of the score on entities the training part knows, and on the others."""
    known, new = split_by_train(roles(spark, sf))
    both = known.withColumn("seen", F.lit(True)).unionByName(new.withColumn("seen", F.lit(False)))
    hist = E.score_histogram(both.withColumn("y", F.col(LABEL)), ["fold_id", "seen"])
    return E.metrics(E.curve(hist, ["fold_id", "seen"]), ["fold_id", "seen"])


C.fragment("held_p", ("cohort",), """
select role, p, overrun_composite_12m as y from (
 select *, case when h<>0 and reporting_month<='1999-12' then 'train' when h=0 and reporting_month>'1999-12' then 'test' end as role
 from (select *, cast(regexp_extract(project_id,'[0-9]+',0) as bigint)%5 as h from cohort)) where role is not null""")
_curve_of("held", "held_p", "role")


@query("entity_holdout_metrics", C.check(metrics_sql("held_c", ["role"]), "held_c"))
def _(spark, sf):
    """All metrics of the score on held-out entities, beside the training side."""
    held = F.regexp_extract("project_id", "[0-9]+", 0).cast("long") % 5 == 0
    df = entity_holdout(cohort(scored(spark, sf)).where(F.col(LABEL).isNotNull()), "1999-12", held)
    hist = E.score_histogram(df.withColumn("y", F.col(LABEL)), ["role"])
    return E.metrics(E.curve(hist, ["role"]), ["role"])


# the fragment "alone" scores every entity without peers


@query("single_entity_features", C.check(
    "select project_id, reporting_month, V_fin_1m, A_fin, Z_peer_V_fin, trajectory_risk_score from alone where project_id='N00000012'", "alone"))
def _(spark, sf):
    """Features of one entity computed from its own rows only."""
    mine = panel(spark, sf).where(F.col("project_id") == ONE)
    return K.kinetics(timeline(mine), peers=K.empty_peers(spark)).select(
        *KEYS, "V_fin_1m", "A_fin", "Z_peer_V_fin", "trajectory_risk_score")


@query("alert_explanations", C.check(f"""
select project_id, reporting_month, p, case when V_fin_1m is null then 'V_fin_1m is unobserved / missing' else
 '1-month financial progress velocity is '||printf('%.2f', V_fin_1m)||'%/month' end as velocity_text from rp2 where alert""", "rp2"))
def _(spark, sf):
    """Each alert point of the replay with its sentence."""
    from tidewatch.functions.explain import explanation

    rows = R.replay_rows(with_heuristic_score(features(spark, sf))).where("alert")
    return rows.select(*KEYS, "p", explanation("V_fin_1m", F.col("V_fin_1m")).alias("velocity_text"))


# ---- audits over a panel with faults of known places ----------------------

C.fragment("faulty", ("panel",), """
select * from panel union all select * from panel where month_idx%17=0 and (length(project_name)+month_idx)%5=0
union all select * replace (cast(null as int) as month_idx) from panel where month_idx%29=0 and length(project_name)%7=0""")


def faulty_panel(spark, sf):
    """The panel with some rows repeated and some months lost."""
    p = panel(spark, sf)
    again = p.where((F.col("month_idx") % 17 == 0) & ((F.length("project_name") + F.col("month_idx")) % 5 == 0))
    lost = p.where((F.col("month_idx") % 29 == 0) & (F.length("project_name") % 7 == 0)).withColumn(
        "month_idx", F.lit(None).cast("int"))
    return p.unionByName(again).unionByName(lost)


@query("grain_faults", C.check(
    "select project_id, reporting_month, count(*) as row_count from faulty group by 1,2 having count(*)>1", "faulty"))
def _(spark, sf):
    return duplicate_keys(faulty_panel(spark, sf))


@query("chronology_faults", C.check("""
select project_id, reporting_month, month_idx, step from (select *, month_idx - lag(month_idx) over
 (partition by project_id order by month_idx nulls first) as step from faulty) where month_idx is null or step <= 0""", "faulty"))
def _(spark, sf):
    return chronology_violations(faulty_panel(spark, sf))


@query("point_in_time_leaks", C.check("""
with f as (select project_id, reporting_month, month_idx, max(C_base) over (partition by project_id) as v from st),
c as (select project_id, reporting_month, month_idx, max(C_base) over (partition by project_id) as v from st where reporting_month<='1998-06')
select f.project_id, f.reporting_month, side, case side when 'full' then f.v else c.v end as v
from f join c using (project_id, month_idx), (values ('full'),('cut')) s(side)
where f.v is distinct from c.v""", "st"))
def _(spark, sf):
    """The point-in-time check must report an operator that looks ahead."""
    from pyspark.sql import Window

    def looks_ahead(p):
        df = K.point_state(timeline(p), K.KineticsConfig())
        return df.select(*KEYS, F.max("C_base").over(Window.partitionBy("project_id")).alias("v"))

    return Q.truncation_differences(panel(spark, sf), "1998-06", looks_ahead)


_WIDE = ["V_fin_1m", "A_fin", "schedule_deviation_change", "Z_peer_V_fin", "EWMA_V_fin", "trajectory_risk_score"]


@query("point_in_time_features", C.check(
    "select project_id, reporting_month, 'full' as side from panel where false", "panel"))
def _(spark, sf):
    """No feature up to a month changes when the later months are removed: velocity, mean, peers, score."""
    op = lambda p: rounded(K.kinetics(timeline(p)).select(*KEYS, *_WIDE), 6, "Z_peer_V_fin", "EWMA_V_fin")
    return Q.truncation_differences(panel(spark, sf), "1998-06", op).select(*KEYS, "side")
