"""Portfolio queries on the latest state of each entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import identity as I
from tidewatch.functions.numbers import format_crore
from tidewatch.operators import portfolio as P
from tidewatch.plans import checks as C
from tidewatch.plans.dataset_queries import scored
from tidewatch.plans.kept import kept
from tidewatch.plans.panel import panel, run_sql, table
from tidewatch.plans.registry import query
from tidewatch.session import stored

CUTOFF = "2001-06"


def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return P.latest_rows(scored(spark, sf))


def all_scored(spark, sf):
    """The scored snapshot, stored once a session: one small row per entity, read by everything below."""
    return kept(spark, sf, "snapshot", lambda: P.score_snapshot(snapshot(spark, sf)))


def genuine(spark, sf):
    return P.genuine_only(all_scored(spark, sf))


def active(spark, sf):
    return P.active(genuine(spark, sf), CUTOFF)


C.fragment("last", ("sc",), "select * from sc qualify row_number() over (partition by project_id order by month_idx desc)=1")
C.fragment("snap", ("last",), f"""
select *, {C.half_even('latest_risk*baseline_cost', 2)} as risk_weighted_exposure from (
 select *, p as latest_risk, {C.TIER.format(p='p')} as risk_tier, {C.half_even('coalesce(C_base,0)', 2)} as baseline_cost,
   coalesce(sector_clean, sector, 'Unknown') as sector_display from last)""")
C.fragment("gen", ("snap",), "select * from snap where regexp_matches(project_id,'^[A-Z][0-9]{7,8}$') or regexp_matches(project_id,'^[0-9]{8,9}$')")
C.fragment("act", ("gen",), f"select * from gen where reporting_month >= '{CUTOFF}'")

SNAP = ["project_id", "reporting_month", "latest_risk", "risk_tier", "baseline_cost", "risk_weighted_exposure", "sector_display"]


@query("latest_snapshot", C.check("""
select project_id, reporting_month, financial_progress, schedule_deviation_months, V_fin_1m, start_month from last
join (select project_id, min(reporting_month) as start_month from sc group by 1) using (project_id)""", "last"))
def _(spark, sf):
    return snapshot(spark, sf).select(
        "project_id", "reporting_month", "financial_progress", "schedule_deviation_months", "V_fin_1m", "start_month")


@query("scored_snapshot", C.check(f"select {','.join(SNAP)} from snap", "snap"))
def _(spark, sf):
    return all_scored(spark, sf).select(*SNAP)


@query("active_and_historical", C.check(
    f"select reporting_month >= '{CUTOFF}' as is_active, count(*) as projects, {C.half_even(C.paise_sum('baseline_cost'), 2)} as exposure from gen group by 1", "gen"))
def _(spark, sf):
    df = genuine(spark, sf)
    both = P.active(df, CUTOFF).withColumn("is_active", F.lit(True)).unionByName(
        P.historical(df, CUTOFF).withColumn("is_active", F.lit(False)))
    return both.groupBy("is_active").agg(
        F.count("*").alias("projects"), P.half_even(P.exact_sum(F.col("baseline_cost"), 2), 2).alias("exposure"))


_N = lambda t: f"count(*) filter (risk_tier='{t}')"
_SUMMARY = f"""select count(*) as active_project_count, {C.half_even('coalesce(' + C.paise_sum('baseline_cost') + ',0)', 2)} as active_baseline_exposure,
 {C.half_even("coalesce(" + C.paise_sum("baseline_cost", "filter (risk_tier='ESCALATE')") + ",0)", 2)} as exposure_in_escalate,
 {C.half_even('coalesce(' + C.paise_sum('risk_weighted_exposure') + ',0)', 2)} as risk_weighted_exposure,
 {_N('NORMAL')} as normal_count, {_N('WATCH')} as watch_count, {_N('REVIEW')} as review_count, {_N('ESCALATE')} as escalate_count from act"""


@query("portfolio_summary", C.check(_SUMMARY, "act"))
def _(spark, sf):
    return P.summary(active(spark, sf))


@query("archive_span", C.check(
    "select count(distinct project_id) as total_archive_entities, min(reporting_month) as archive_start, max(reporting_month) as archive_end from panel", "panel"))
def _(spark, sf):
    return P.archive_span(panel(spark, sf))


@query("sector_breakdown", C.check(f"""
select sector_display as sector, count(*) as total_projects, {_N('ESCALATE')} as escalate_count, {_N('REVIEW')} as review_count,
 {_N('WATCH')} as watch_count, {C.half_even(C.paise_sum('baseline_cost'), 2)} as total_exposure from act group by 1""", "act"))
def _(spark, sf):
    return P.sector_breakdown(active(spark, sf))


@query("intervention_queue", C.check("""
select project_id, project_name, sector_display, reporting_month, latest_risk, risk_tier, baseline_cost, risk_weighted_exposure,
 (select count(*) from act) as total_eligible from act order by risk_weighted_exposure desc, project_id limit 30""", "act"))
def intervention_queue(spark, sf):
    return P.interventions(active(spark, sf), 30)


@query("intervention_queue_filtered", C.check("""
with f as (select * from act where lower(sector_display)='railways' and risk_tier in ('WATCH','REVIEW','ESCALATE'))
select project_id, project_name, sector_display, reporting_month, latest_risk, risk_tier, baseline_cost, risk_weighted_exposure,
 (select count(*) from f) as total_eligible from f order by risk_weighted_exposure desc, project_id limit 10""", "act"))
def _(spark, sf):
    return P.interventions(active(spark, sf), 10, sector=" railways ", min_tier="watch")


_PAGE = "project_id, project_name, sector_display, reporting_month, latest_risk, risk_tier, baseline_cost"


@query("project_search", C.check(f"""
with f as (select * from act where contains(lower(project_name),'bolt') and risk_tier='NORMAL')
select {_PAGE}, (select count(*) from f) as total from f order by project_id limit 50 offset 20""", "act"))
def _(spark, sf):
    return P.search(active(spark, sf), genuine(spark, sf), term="Bolt", tier="normal", limit=50, offset=20)


@query("project_search_archive_fallback", C.check(f"""
with hit as (select min(project_id) as pid from gen where reporting_month < '{CUTOFF}'),
f as (select project_id, project_name, sector_clean as sector_display, reporting_month, 0.0::double as latest_risk, 'NORMAL' as risk_tier, coalesce(C_base,0) as baseline_cost
 from gen where contains(project_id, (select pid from hit)))
select *, (select count(*) from f) as total from f order by project_id limit 50""", "gen"))
def _(spark, sf):
    g = genuine(spark, sf)
    first = P.historical(g, CUTOFF).agg(F.min("project_id").alias("i")).first()["i"] or "none"
    return P.search(P.active(g, CUTOFF), g, term=first)


@query("project_detail", C.check(f"""
select project_id, project_name, reporting_month, C_base, expenditure_to_baseline, V_fin_1m, A_fin, trajectory_risk_score, latest_risk, risk_tier,
 case when V_fin_1m is null then 'V_fin_1m is unobserved / missing' else
   '1-month financial progress velocity is '||printf('%.2f', V_fin_1m)||'%/month' end as velocity_text from snap""", "snap"))
def _(spark, sf):
    from tidewatch.functions.explain import explanation
    return all_scored(spark, sf).select(
        "project_id", "project_name", "reporting_month", "C_base", "expenditure_to_baseline", "V_fin_1m", "A_fin",
        "trajectory_risk_score", "latest_risk", "risk_tier",
        explanation("V_fin_1m", F.col("V_fin_1m")).alias("velocity_text"))


@query("dashboard_ratios", C.check(f"""
select active_project_count as total_monitored, watch_count+review_count+escalate_count as high_risk_count,
 {C.half_even('100.0::double*(watch_count+review_count+escalate_count)/active_project_count', 1)} as risk_pct,
 floor(risk_weighted_exposure+0.5::double) as value_at_risk,
 {C.half_even('100.0::double*risk_weighted_exposure/active_baseline_exposure', 1)} as risk_portfolio_pct,
 normal_count as normal_segment, watch_count as elevated_segment, review_count+escalate_count as divergent_segment from ({_SUMMARY})""", "act"))
def _(spark, sf):
    return P.dashboard_ratios(active(spark, sf))


@query("severity_labels", C.check("""
select project_id, case risk_tier when 'ESCALATE' then 'CRITICAL DIVERGENCE' when 'REVIEW' then 'HIGH STAGNATION' when 'WATCH' then 'MODERATE WATCH' else 'NORMAL' end as severity,
 case when risk_tier='NORMAL' then 0.0::double else floor(latest_risk*100.0::double+0.5::double) end as display_score from snap""", "snap"))
def _(spark, sf):
    t = F.col("risk_tier")
    return all_scored(spark, sf).select(
        "project_id", P.severity(t).alias("severity"), P.display_score(t, F.col("latest_risk")).alias("display_score"))


@query("exposure_concentration", C.check(f"""
with r as (select baseline_cost, row_number() over (order by baseline_cost desc) as rn from act),
k as (select cast(s as double) as s, greatest(1, cast(floor(cast(s as double)*(select count(*) from act)+0.5::double) as bigint)) as k from unnest([0.01,0.05,0.1]) as g(s))
select s as top_share, k as projects, {C.half_even('sum(baseline_cost) filter (rn<=k)', 2)} as exposure,
 {C.half_even('sum(baseline_cost) filter (rn<=k)/sum(baseline_cost)', 6)} as exposure_share from r, k group by s, k""", "act"))
def _(spark, sf):
    return P.exposure_concentration(active(spark, sf))


@query("mega_projects", C.check("select project_id, project_name, sector_display, baseline_cost, risk_tier, latest_risk from snap where baseline_cost >= 2000", "snap"))
def _(spark, sf):
    return P.mega_projects(all_scored(spark, sf), 2000.0)


@query("tier_profile", C.check(f"""
select t as risk_tier, count(project_id) as projects, coalesce({C.half_even(C.mean_risk(), 6)},0) as mean_prob,
 coalesce({C.half_even('median(latest_risk)', 6)},0) as median_prob, {C.half_even('count(project_id)/(select count(*) from snap)*100.0::double', 4)} as pct
from unnest(['NORMAL','WATCH','REVIEW','ESCALATE']) as g(t) left join snap on risk_tier=t group by 1""", "snap"))
def _(spark, sf):
    return P.tier_profile(all_scored(spark, sf))


_AGE = ("case when project_age_months>-1 and project_age_months<=12 then '< 1 yr' when project_age_months>12 and project_age_months<=36 then '1-3 yrs' "
        "when project_age_months>36 and project_age_months<=60 then '3-5 yrs' when project_age_months>60 and project_age_months<=120 then '5-10 yrs' "
        "when project_age_months>120 and project_age_months<=1000 then '> 10 yrs' end")
_SHARE = " union all ".join(
    f"select '{k}' as dimension, {e} as value, count(*) as total, {_N('ESCALATE')} as escalate, {C.half_even(C.mean_risk(), 6)} as mean_prob, "
    f"{C.half_even(f'100.0::double*{_N(chr(69)+"SCALATE")}/count(*)', 4)} as escalate_pct from snap group by 2"
    for k, e in (("sector", "sector_display"), ("month", "reporting_month"), ("age", _AGE), ("scale", "scale_bucket")))


@query("escalate_shares", C.check(_SHARE, "snap"))
def _(spark, sf):
    return P.escalate_shares(all_scored(spark, sf))


_DRV = " union all ".join(
    f"select '{c}' as driver, {C.half_even('cast(sum(cast(round_even(v*1000000.0::double,0) as bigint)) as double)/cast(count(*) as double)/1000000.0::double', 6)} as mean, {C.half_even(f'cast(count(*) filter (v{t}) as double)/cast(count(*) as double)*100.0::double', 4)} as pct_beyond, "
    f"{C.half_even('median(v)', 6)} as median from (select coalesce(cast({c} as double),{d}::double) as v from snap)"
    for c, d, t in (("schedule_deviation_months", 0.0, ">=12"), ("cost_revision_ratio", 1.0, ">1"), ("financial_progress", 0.0, ">0"),
                    ("V_fin_1m", 0.0, "<=0"), ("trajectory_risk_score", 0.0, ">=40")))


@query("driver_statistics", C.check(_DRV, "snap"))
def _(spark, sf):
    return P.driver_statistics(all_scored(spark, sf))


@query("active_window_sensitivity", C.check(f"""
select c as cutoff, count(*) as projects, {C.half_even(C.paise_sum('baseline_cost'), 2)} as exposure, {C.half_even(C.paise_sum('risk_weighted_exposure'), 2)} as risk_weighted_exposure,
 {C.half_even(C.mean_risk(), 6)} as mean_risk, {C.half_even('median(latest_risk)', 6)} as median_risk,
 {_N('NORMAL')} as normal_count, {_N('WATCH')} as watch_count, {_N('REVIEW')} as review_count, {_N('ESCALATE')} as escalate_count
from gen, unnest(['2001-06','2001-09','2001-11']) as g(c) where reporting_month>=c group by 1""", "gen"))
def _(spark, sf):
    return P.window_sensitivity(genuine(spark, sf), ["2001-06", "2001-09", "2001-11"])


@query("shared_project_names", C.check("""
select project_id, project_name, ids_with_name from last join (select project_name, count(*) as ids_with_name from last group by 1 having count(*)>1) using (project_name)""", "last"))
def _(spark, sf):
    return P.shared_names(snapshot(spark, sf)).select("project_id", "project_name", "ids_with_name")


# ---- identity rules over varied names derived from the part table --------

ENTITY_SQL = """
select case when p_partkey%3=0 then concat('PRJ_',lpad(cast(p_partkey as string),12,'0'))
            when p_partkey%3=1 then concat('N',lpad(cast(p_partkey as string),8,'0'))
            else lpad(cast(100000000+p_partkey as string),9,'0') end as project_id,
 case (p_partkey+p_size)%24
  when 0 then 'KERALA' when 1 then concat('State : ',case p_size%3 when 0 then 'Bihar' when 1 then 'Goa' else 'Elsewhere' end)
  when 2 then 'SECTOR :  COAL **' when 3 then 'RAILWAYS' when 4 then 'Grand Total' when 5 then concat('Table ',cast(p_size as string))
  when 6 then concat('ALL INDIA ',upper(p_name)) when 7 then 'TOTAL' when 8 then 'Executive Overview' when 9 then concat('FL ',upper(p_name))
  when 10 then 'Railways and Road Transport' when 11 then 'List of Projects delayed' when 12 then 'Sl. No Project' when 13 then 'ABC'
  when 14 then 'Ministry of Coal' when 15 then concat('Widening of ',p_name,' part ii') when 16 then 'Annexure - xvii' when 17 then 'n.a.'
  when 18 then concat('Flash Report ',p_brand) when 19 then ' Multi  State '
  when 20 then concat('DWARKA SECTOR ',cast(p_size as string)) else concat(upper(p_name),' PHASE ',cast(p_size as string)) end as project_name
from {part}
"""


def entities(spark, sf):
    return run_sql(spark, sf, ENTITY_SQL, "part")


C.fragment("ent", (), ENTITY_SQL.format(part="part"))


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_KW = "case " + " ".join(f"when regexp_matches(n,{_lit('(?i)' + p)}) then {_lit('MACRO_KEYWORD_' + p)}" for p in I.MACRO_PATTERNS) + " end"
_IN = lambda xs: "(" + ",".join(_lit(x) for x in xs) + ")"
C.fragment("mac", ("ent",), f"""
select project_id, project_name, case when d and kw is not null then kw when kw is not null and n in {_IN(I.MACRO_TITLES)} then 'OFFICIAL_MACRO_TITLE_'||n
  when s in {_IN(I.STATES)} then 'STATE_SUMMARY_ROW: '||s when c in {_IN(I.SECTORS)} then 'SECTOR_SUMMARY_ROW: '||c
  when d and ({' or '.join(f"contains(n,{_lit(w)})" for w in I.FRONT_MATTER)}) then 'SYNTHETIC_EXECUTIVE_SUMMARY' else 'GENUINE' end as reason
from (select *, starts_with(project_id,'PRJ_') as d, {_KW} as kw, trim(regexp_replace(n,'^STATE\\s*:\\s*','')) as s,
  trim(regexp_replace(trim(regexp_replace(n,'^SECTOR\\s*:\\s*','')),'[\\*\\s]+$','')) as c
  from (select *, upper(trim(project_name)) as n from ent))""")
_GEN = "reason='GENUINE' and (regexp_matches(project_id,'^[0-9]{8,9}$') or regexp_matches(project_id,'^[A-Z][0-9]{7,8}$'))"
_EXC = " or ".join(f"regexp_matches(trim(project_name),{_lit(p)})" for p in I.EXCLUSION_PATTERNS)


@query("macro_summary_rules", C.check(f"select project_id, project_name, reason, {_GEN} as genuine from mac", "mac"))
def _(spark, sf):
    pid, name = F.col("project_id"), F.col("project_name")
    return entities(spark, sf).select(
        pid, name, I.macro_reason(pid, name).alias("reason"), I.is_genuine(pid, name).alias("genuine"))


@query("non_project_filter", C.check(f"select project_id, project_name from ent where not (starts_with(project_id,'PRJ_') and ({_EXC}))", "ent"))
def _(spark, sf):
    return entities(spark, sf).where(~I.is_non_project(F.col("project_id"), F.col("project_name")))


@query("keyword_leaks", C.check(f"""
select project_id, project_name, keyword, reason as classification from (
 select *, regexp_extract(upper(project_name), {_lit(chr(92) + 'b(' + '|'.join(P.LEAK_WORDS) + ')' + chr(92) + 'b')}, 1) as keyword from mac) where keyword<>''""", "mac"))
def _(spark, sf):
    return P.keyword_leaks(entities(spark, sf))


@query("sanitising_reconciliation", C.check(f"""
with c as (select m.*, p_retailprice as baseline_cost, case when p_size%5=0 then 'ESCALATE' else 'NORMAL' end as risk_tier,
   case when p_size%2=0 then '2001-07' else '2000-01' end as reporting_month from mac m join part on
   p_partkey = case when starts_with(project_id,'1') then cast(project_id as bigint)-100000000 else cast(regexp_extract(project_id,'[0-9]+',0) as bigint) end),
s as (select '1_all' as step, * from c union all select '2_no_macro', * from c where reason='GENUINE' union all select '3_genuine', * from c where {_GEN}
  union all select '4_active', * from c where {_GEN} and reporting_month>='{CUTOFF}')
select step, count(*) as projects, {C.half_even(C.paise_sum('baseline_cost'), 2)} as exposure, {_N('ESCALATE')} as escalate_count from s group by 1""", "mac"))
def _(spark, sf):
    key = F.regexp_extract("project_id", "[0-9]+", 0).cast("long")
    ents = entities(spark, sf).withColumn("p_partkey", F.when(F.col("project_id").startswith("1"), key - 100000000).otherwise(key))
    df = ents.join(table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size"), "p_partkey").withColumns({
        "baseline_cost": F.col("p_retailprice"),
        "risk_tier": F.when(F.col("p_size") % 5 == 0, "ESCALATE").otherwise("NORMAL"),
        "reporting_month": F.when(F.col("p_size") % 2 == 0, "2001-07").otherwise("2000-01")})
    return P.reconciliation(df, CUTOFF)


@query("money_format", f"""
with v as (select c_custkey, c_acctbal*x as v from customer, (values (0.1::double),(1.0::double),(13.0::double),(1300.0::double)) t(x))
select c_custkey, v as amount, case when v<0 then '-' else '' end||'₹'||case when abs(v)<1000 then printf('%.1f',abs(v))||' Cr'
  when abs(v)<100000 then format('{{:,}}',cast({C.half_even('abs(v)', 0)} as bigint))||' Cr' else printf('%.2f',abs(v)/100000.0::double)||' Lakh Cr' end as shown from v""")
def _(spark, sf):
    x = F.explode(F.array(*[F.lit(k) for k in (0.1, 1.0, 13.0, 1300.0)]))
    df = table(spark, sf, "customer").select("c_custkey", "c_acctbal", x.alias("x")).select(
        "c_custkey", (F.col("c_acctbal") * F.col("x")).alias("amount"))
    return df.withColumn("shown", format_crore(F.col("amount")))
