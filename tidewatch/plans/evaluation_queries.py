"""Policy, metric, lead-time and replay queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import evaluate as E
from tidewatch.operators import leadtime as L
from tidewatch.operators import policies as B
from tidewatch.operators import replay as R
from tidewatch.plans import checks as C
from tidewatch.plans.dataset_queries import LABEL, roles, scored
from tidewatch.plans.feature_queries import KEYS, features
from tidewatch.plans.panel import table
from tidewatch.plans.registry import query

_A = "(coalesce(expenditure_to_baseline,0)>=0.9::double or coalesce(schedule_deviation_months,0)>=12)"
_B = ("(coalesce(V_fin_1m<=0.5::double,false) or coalesce(EWMA_V_fin<=0.5::double,false) "
      "or coalesce(Z_peer_V_fin<=-1,false) or coalesce(trajectory_risk_score>=40,false))")


@query("policy_alerts", C.check(f"select project_id, reporting_month, cast({_A} as int) as alert_a, cast({_B} as int) as alert_b, "
       f"case when {_A} then 0.8::double else 0.2::double end as pseudo_a from kin", "kin"))
def _(spark, sf):
    return features(spark, sf).select(
        *KEYS, B.policy_a().alias("alert_a"), B.policy_b().alias("alert_b"),
        B.pseudo_probability(B.policy_a()).alias("pseudo_a"))


@query("risk_tiers", C.check(
    f"select project_id, reporting_month, p, {C.TIER.format(p='p')} as risk_tier, coalesce(p>=0.4::double,false) as alert from sc", "sc"))
def _(spark, sf):
    return B.with_heuristic_score(features(spark, sf)).select(*KEYS, "p", "risk_tier", "alert")


def predictions(spark, sf):
    """Out-of-fold rows of three policies in long form: fold, policy, score, label."""
    test = roles(spark, sf).where("role = 'test'")
    scores = F.array(
        F.struct(F.lit("score").alias("policy"), F.col("p").alias("s")),
        F.struct(F.lit("policy_a").alias("policy"), B.policy_a().cast("double").alias("s")),
        F.struct(F.lit("policy_b").alias("policy"), B.policy_b().cast("double").alias("s")),
    )
    return test.withColumn("_x", F.explode(scores)).select(
        "project_id", "reporting_month", "month_idx", "fold_id", "_x.policy", F.col("_x.s").alias("p"), F.col(LABEL).alias("y"))


C.fragment("preds", ("roles",), f"""
select project_id, reporting_month, month_idx, fold_id, policy, s as p, overrun_composite_12m as y from (
 select *, 'score' as policy, p as s from roles where role='test' union all
 select *, 'policy_a', cast({_A} as double) from roles where role='test' union all
 select *, 'policy_b', cast({_B} as double) from roles where role='test')
""")
C.fragment("hist", ("preds",), f"select fold_id, policy, {C.half_even('p', 4)} as score, count(*) as n, cast(sum(y) as bigint) as pos from preds where p is not null group by all")
C.fragment("hist_all", ("hist",), """
select fold_id, policy, score, cast(sum(n) as bigint) as n, cast(sum(pos) as bigint) as pos from hist
group by grouping sets ((policy, fold_id, score),(policy, score))""")
C.fragment("crv", ("hist_all",), """
select *, sum(n) over w as cn, sum(pos) over w as cp from hist_all
window w as (partition by policy, fold_id order by score desc rows between unbounded preceding and current row)""")


def rates(tp="tp", fp="fp", fn="fn", tn="tn"):
    def ratio(n, d):
        return f"case when {d}>0 then {n}/({d}) else 0.0::double end"
    parts = {"precision": ratio(tp, f"({tp}+{fp})"), "recall": ratio(tp, f"({tp}+{fn})"),
             "f1": ratio(f"2*{tp}", f"(2*{tp}+{fp}+{fn})"), "false_alert_rate": ratio(fp, f"({fp}+{tn})"),
             "alert_rate": ratio(f"({tp}+{fp})", f"({tp}+{fp}+{fn}+{tn})")}
    return {k: C.half_even(v, 4) for k, v in parts.items()}


def metrics_sql(source, keys):
    k = ", ".join(keys) + ", " if keys else ""
    by = f"group by {', '.join(keys)}" if keys else ""
    two = "positives>0 and support>positives"
    cells = ", ".join(f"case when {two} then {v} else 0.0::double end as {n}" for n, v in rates().items())
    return f"""
select {k} case when {two} then {C.half_even('ap/positives', 4)} else 0.0::double end as pr_auc,
 case when {two} then {C.half_even('pairs/(positives*(support-positives))', 4)} else 0.5::double end as roc_auc,
 case when {two} then {C.half_even('sq/support', 4)} else 0.0::double end as brier_score, {cells},
 case when {two} then tp end as tp, case when {two} then fp end as fp, case when {two} then tn end as tn,
 case when {two} then fn end as fn, support, positives,
 case when {two} then {C.half_even('positives/support', 4)} end as prevalence
from (select {k} cast(sum(n) as bigint) as support, cast(sum(pos) as bigint) as positives, sum(pos*cp/cn) as ap,
  sum((n-pos)*(cp-pos/2)) as pairs, sum((n-pos)*score*score + pos*(1-score)*(1-score)) as sq,
  cast(coalesce(sum(pos) filter (score>=0.5::double),0) as bigint) as tp, cast(coalesce(sum(n-pos) filter (score>=0.5::double),0) as bigint) as fp,
  cast(coalesce(sum(pos) filter (score<0.5::double),0) as bigint) as fn, cast(coalesce(sum(n-pos) filter (score<0.5::double),0) as bigint) as tn
 from {source} {by})"""


@query("policy_metrics", C.check(metrics_sql("crv", ["policy", "fold_id"]), "crv"))
def _(spark, sf):
    """Every metric per policy and fold, and over all folds."""
    hist = E.with_overall(E.score_histogram(predictions(spark, sf), ["policy", "fold_id"]), ["policy"], "fold_id")
    return E.metrics(E.curve(hist, ["policy", "fold_id"]), ["policy", "fold_id"])


C.fragment("lab", (), "select doc_id, quality, toxic, least(n_chars,20000)/20000.0::double as p from labels join documents using (doc_id)")


@query("label_metrics", C.check(
    metrics_sql("(select *, sum(n) over w as cn, sum(pos) over w as cp from (select p as score, count(*) as n, cast(sum(quality) as bigint) as pos "
                "from lab group by 1) window w as (order by score desc rows between unbounded preceding and current row))", []), "lab"))
def _(spark, sf):
    """Metrics of an unrounded score against stored labels, through the exact curve."""
    df = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select(
        (F.least("n_chars", F.lit(20000)) / F.lit(20000.0)).alias("p"), F.col("quality").cast("double").alias("y"))
    return E.metrics(E.exact_curve(df))


_R = rates("tp", "fp", "(pos-tp)", "(n-pos-fp)")


def grid_sql(taus, where=""):
    return (f"select threshold, tp, fp, {', '.join(f'{v} as {k}' for k, v in _R.items())} from ("
            "select cast(t as double) as threshold, cast(sum(n) as bigint) as n, cast(sum(pos) as bigint) as pos, "
            "cast(coalesce(sum(pos) filter (score>=cast(t as double)),0) as bigint) as tp, "
            "cast(coalesce(sum(n-pos) filter (score>=cast(t as double)),0) as bigint) as fp "
            f"from hist, unnest({taus}) as g(t) where policy='score' {where} group by 1)")


def score_hist(spark, sf, only_fold=None):
    preds = predictions(spark, sf).where("policy = 'score'")
    if only_fold:
        preds = preds.where(F.col("fold_id") == only_fold)
    return E.score_histogram(preds)


@query("threshold_grid", C.check(grid_sql("[0.1,0.2,0.3,0.35,0.4,0.5,0.6,0.7]"), "hist"))
def _(spark, sf):
    return E.threshold_grid(score_hist(spark, sf), [0.1, 0.2, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7])


@query("recent_fold_thresholds", C.check(grid_sql("[0.1,0.2,0.3,0.4,0.5]", "and fold_id=2"), "hist"))
def _(spark, sf):
    return E.threshold_grid(score_hist(spark, sf, only_fold=2), [0.1, 0.2, 0.3, 0.4, 0.5])


C.fragment("bins", ("hist",), """
select b, cast(coalesce(sum(n),0) as bigint) as cnt, cast(sum(cast(round_even(score*10000.0::double,0) as bigint)*n) as double)/cast(sum(n) as double)/10000.0::double as ap, sum(pos)/sum(n) as ay, sum(cast(round_even(score*10000.0::double,0) as bigint)*n) as sp, sum(pos)*10000 as sy
from range(1,11) r(b) left join (select *, greatest(1, least(10, len(list_filter(
  list_transform(range(0,11), lambda i: i*0.1::double), lambda e: e<=score)))) as bb from hist where policy='score') on bb=b group by 1
""")


@query("reliability_table", C.check(f"""
select cast(b as int) as bin, '['||printf('%.1f',(b-1)*0.1::double)||', '||printf('%.1f',b*0.1::double)||')' as range, cnt as count,
 {C.half_even('coalesce(ap,((b-1)*0.1::double+b*0.1::double)/2)', 4)} as mean_pred_prob, {C.half_even('coalesce(ay,0)', 4)} as observed_event_rate,
 {C.half_even('coalesce(abs(ap-ay),0)', 4)} as gap from bins""", "bins"))
def _(spark, sf):
    return E.reliability(score_hist(spark, sf))


@query("calibration_error", C.check(
    f"select {C.half_even('cast(sum(abs(sp-sy)) as double)/cast(sum(cnt) as double)/10000.0::double', 4)} as ece from bins", "bins"))
def _(spark, sf):
    return E.calibration_error(score_hist(spark, sf))


AIMS = ([("recall", t) for t in (0.20, 0.35, 0.50)] + [("far", t) for t in (0.025, 0.05, 0.10, 0.20)]
        + [("alert_rate", t) for t in (0.08, 0.15, 0.25, 0.35)])
_AIM_ROWS = ",".join(f"('{m}',{t}::double)" for m, t in AIMS)


@query("matched_operating_points", C.check(f"""
with g as (select i, 0.05::double + i*((0.95::double-0.05::double)/199) as tau from range(0,200) r(i)),
c as (select policy, tau, cast(sum(n) as bigint) as total, cast(sum(pos) as bigint) as positives,
   cast(coalesce(sum(pos) filter (score>=tau),0) as bigint) as tp, cast(coalesce(sum(n) filter (score>=tau),0) as bigint) as called
   from hist, g group by 1,2),
v as (select c.*, m, t, case m when 'recall' then tp/positives when 'far' then (called-tp)/(total-positives) else called/total end as val
   from c, (values {_AIM_ROWS}) a(m,t)),
b as (select *, row_number() over (partition by policy,m,t order by abs(val-t), tau) as rn from v)
select policy, m as matched_on, t as target, {C.half_even('tau', 3)} as threshold,
  {C.half_even('(case when called>0 then tp/called else 0 end)*100', 2)} as precision, {C.half_even('(tp/positives)*100', 2)} as recall,
  {C.half_even('((called-tp)/(total-positives))*100', 2)} as false_alert_rate, {C.half_even('(called/total)*100', 2)} as alert_rate,
  called as alerts_count from b where rn=1""", "hist"))
def _(spark, sf):
    return E.operating_points(E.score_histogram(predictions(spark, sf), ["policy"]), AIMS, ["policy"])


_TIERS = ", ".join(
    f"{C.half_even(f'100.0::double*coalesce(sum(n) filter ({C.TIER.format(p='score')} = {chr(39)}{t}{chr(39)}),0)/sum(n)', 4)} as {t.lower()}_pct"
    for t in ("NORMAL", "WATCH", "REVIEW", "ESCALATE"))


@query("tier_distribution_by_fold", C.check(f"""
select h.fold_id, cast(sum(n) as bigint) as observations, {C.half_even('sum(pos)/sum(n)', 6)} as prevalence,
  {C.half_even(C.mean_risk('score', 'n'), 6)} as mean_prob, {C.half_even('any_value(md)', 6)} as median_prob, {_TIERS}
from hist_all h join (select fold_id, median({C.half_even('p', 4)}) as md from preds where policy='score'
   group by grouping sets ((fold_id),())) m on m.fold_id is not distinct from h.fold_id
where policy='score' group by 1""", "hist_all", "preds"))
def _(spark, sf):
    return E.tier_distribution(E.score_histogram(predictions(spark, sf).where("policy = 'score'"), ["fold_id"]), "fold_id")


# ---- lead times ----------------------------------------------------------

def _event_sql(strict):
    d = "coalesce(a.schedule_deviation_months,0)" if strict else "a.schedule_deviation_months"
    extra = " or b.completion_idx - a.completion_idx >= 6" if strict else ""
    return f"""
select a.project_id, a.reporting_month, a.month_idx, a.p, a.overrun_composite_12m, count(b.month_idx) as rows_ahead,
  min(b.month_idx) filter ((a.C_base>0 and coalesce(b.C_base,0) >= a.C_base*(1.0::double+0.05::double))
    or coalesce(b.schedule_deviation_months,0) - {d} >= 6{extra}) as event_idx
from sc a left join sc b on a.project_id=b.project_id and b.month_idx>a.month_idx and b.month_idx<=a.month_idx+12
group by all"""


C.fragment("ev_loose", ("sc",), _event_sql(False))
C.fragment("ev_strict", ("sc",), _event_sql(True))
TAU = 0.3
C.fragment("al_loose", ("ev_loose",), f"""
select *, coalesce(event_idx, month_idx+12) as ev, coalesce(event_idx, month_idx+12)-month_idx as lead_months from ev_loose
where p>={TAU}::double and overrun_composite_12m=1 and rows_ahead>0""")
C.fragment("al_strict", ("ev_strict",), f"""
select *, event_idx as ev, event_idx-month_idx as lead_months from ev_strict
where p>={TAU}::double and overrun_composite_12m=1 and rows_ahead>0 and event_idx is not null""")
for _k in ("loose", "strict"):
    C.fragment(f"evt_{_k}", (f"al_{_k}",), f"""
select project_id, ev as event_idx, min(month_idx) as first_alert_idx, count(*) as alert_count, max(p) as max_prob, ev-min(month_idx) as lead_months
from al_{_k} group by project_id, ev""")

_SUMMARY = (f"select count(*) as evaluated, count(distinct project_id) as unique_projects, coalesce({C.half_even('avg(lead_months)', 2)},0.0::double) as mean_lead, "
            "coalesce(quantile_cont(cast(lead_months as double),0.25),0) as p25_lead, coalesce(quantile_cont(cast(lead_months as double),0.5),0) as median_lead, "
            "coalesce(quantile_cont(cast(lead_months as double),0.75),0) as p75_lead from ")


@query("first_events_ahead", C.check("select project_id, reporting_month, event_idx, cast(rows_ahead as int) as rows_ahead from ev_loose", "ev_loose"))
def _(spark, sf):
    return L.with_first_event(scored(spark, sf)).select(*KEYS, "event_idx", "rows_ahead")


@query("alert_lead_times", C.check(_SUMMARY + "al_loose", "al_loose"))
def _(spark, sf):
    return L.lead_times(scored(spark, sf), TAU, level="alert", fallback=12, strict=False)


@query("event_lead_times_with_fallback", C.check("select * from evt_loose", "evt_loose"))
def _(spark, sf):
    return L.events(L.alerts(L.with_first_event(scored(spark, sf)), TAU, LABEL, fallback=12))


@query("event_lead_times", C.check(_SUMMARY + "evt_strict", "evt_strict"))
def _(spark, sf):
    return L.lead_times(scored(spark, sf), TAU, level="event", fallback=None, strict=True)


@query("lead_time_histogram", C.check(
    "select case when lead_months<=2 then '1-2' when lead_months<=5 then '3-5' when lead_months<=8 then '6-8' else '9-12' end as lead_bucket, "
    "count(*) as row_count from evt_strict group by 1", "evt_strict"))
def _(spark, sf):
    found = L.alerts(L.with_first_event(scored(spark, sf), strict=True), TAU, LABEL, fallback=None)
    return L.lead_histogram(L.events(found))


# ---- replay --------------------------------------------------------------

def replay_source(spark, sf):
    return scored(spark, sf)


C.fragment("rp0", ("sc",), """
select *, coalesce(max(coalesce(C_base,0)) over w,0) as prior_cost, max(schedule_deviation_months) over w as prior_deviation, coalesce(p>=0.4::double,false) as alert
from sc window w as (partition by project_id order by month_idx rows between unbounded preceding and 1 preceding)""")
C.fragment("rp", ("rp0",), """
select *, ch or th as actual_event from (select *, coalesce(prior_cost>0 and C_base>0 and (C_base-prior_cost)/prior_cost >= 0.05::double,false) as ch,
 coalesce(schedule_deviation_months-prior_deviation>=6,false) as th from rp0)""")
C.fragment("rp2", ("rp",), """
select *, case when alert and month_idx<fe then fe-month_idx end as lead_time_if_event,
 min(case when alert and month_idx<fe then month_idx end) over (partition by project_id) as fa
from (select *, min(case when actual_event then month_idx end) over (partition by project_id) as fe from rp)""")
_f1 = lambda e: f"printf('%.1f',{e})"
_g1 = lambda e: f"format('{{:,.1f}}',{e})"
_REASON = (f"concat_ws('; ', case when ch then 'Cost escalated +'||{_f1('((C_base-prior_cost)/prior_cost)*100.0::double')}||'% (₹'||{_g1('prior_cost')}||' Cr -> ₹'||{_g1('C_base')}||' Cr)' end, "
           f"case when th then 'Schedule deviation jumped +'||{_f1('schedule_deviation_months-prior_deviation')}||' months ('||{_f1('prior_deviation')}||'m -> '||{_f1('schedule_deviation_months')}||'m)' end)")


@query("deterioration_events", C.check(
    f"select project_id, reporting_month, prior_cost, prior_deviation, {_REASON} as reasons from rp where actual_event", "rp"))
def _(spark, sf):
    return R.with_events(replay_source(spark, sf)).where("actual_event").select(
        *KEYS, "prior_cost", "prior_deviation", F.array_join("event_reasons", "; ").alias("reasons"))


@query("first_deterioration_events", C.check(
    f"select project_id, min(month_idx) as first_event_idx, arg_min({_REASON}, month_idx) as reasons from rp where actual_event group by 1", "rp"))
def _(spark, sf):
    return R.with_events(replay_source(spark, sf)).where("actual_event").groupBy("project_id").agg(
        F.min("month_idx").alias("first_event_idx"), F.min_by(F.array_join("event_reasons", "; "), "month_idx").alias("reasons"))


@query("replay_alert_leads", C.check(
    "select project_id, reporting_month, alert, actual_event, lead_time_if_event, fe as first_event_idx, fa as first_alert_idx from rp2", "rp2"))
def _(spark, sf):
    return R.replay_rows(replay_source(spark, sf)).select(
        *KEYS, "alert", "actual_event", "lead_time_if_event", "first_event_idx", "first_alert_idx")


@query("replay_documents", C.check("""
select project_id, count(*) as total_observations, min(reporting_month) as start_month, max(reporting_month) as end_month,
 count(*) filter (alert) as alerts, count(*) filter (actual_event) as events, any_value(fe)-any_value(fa) as lead_time,
 string_agg(cast(round(p*10000) as bigint), ',' order by month_idx) as timeline_scores from rp2 group by 1""", "rp2"))
def _(spark, sf):
    docs = R.replay(replay_source(spark, sf))
    scores = F.array_join(F.transform("timeline", lambda t: F.rint(t["p"] * 10000).cast("long").cast("string")), ",")
    return docs.select(
        "project_id", "total_observations", "start_month", "end_month", F.size("alert_points").cast("long").alias("alerts"),
        F.size("events").cast("long").alias("events"), "lead_time", scores.alias("timeline_scores"))


@query("replay_single_project", C.check(
    "select project_id, reporting_month, p, alert, actual_event, lead_time_if_event from rp2 where project_id='N00000012'", "rp2"))
def _(spark, sf):
    """One entity by key: the filter is applied below the windows."""
    df = R.replay_rows(replay_source(spark, sf)).where("project_id = 'N00000012'")
    return df.select(*KEYS, "p", "alert", "actual_event", "lead_time_if_event")


@query("replay_chart_points", C.check(f"""
select project_id, 'M'||observation_number as label, least(100.0::double, (observation_number/n)*100.0::double) as ideal_progress,
 coalesce(financial_progress,0) as reported_progress, coalesce(financial_progress,0)*(1.0::double-coalesce(p,0)) as discounted_progress
from (select *, row_number() over (partition by project_id order by month_idx)-1 as k, count(*) over (partition by project_id) as n from sc)
where n<=6 or k%cast(ceil(n/5) as bigint)=0 or k=n-1""", "sc"))
def _(spark, sf):
    return R.chart_points(replay_source(spark, sf))


