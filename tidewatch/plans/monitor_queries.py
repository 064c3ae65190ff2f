"""Monitoring queries: intake, governance fold, derived tables, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.dates import month_index
from tidewatch.operators.timeline import planned_age
from tidewatch.plans import checks as C
from tidewatch.plans.dataset_queries import risks, stored_panel
from tidewatch.plans.feature_queries import rounded
from tidewatch.plans.kept import kept
from tidewatch.plans.panel import panel, run_sql
from tidewatch.plans.registry import query
from tidewatch.session import fresh_path, stored
from tidewatch.streaming import governance as G
from tidewatch.streaming import intake as N
from tidewatch.streaming import live as S
from tidewatch.streaming.committed import Committed

REG_SQL = """
select c_custkey as arrival_seq, case when c_custkey%53=0 then ' ' else concat('N',lpad(cast(c_custkey%700 as string),8,'0')) end as project_id,
 case when c_custkey%47=0 then '' else c_name end as project_name, c_mktsegment as sector, c_acctbal as approved_cost,
 case when c_custkey%4=0 then c_acctbal*2 end as revised_cost,
 case when c_custkey%31=0 then '2020-13' else concat('2020-',lpad(cast(c_custkey%12+1 as string),2,'0')) end as initial_reporting_month,
 case when c_custkey%29=0 then 'soon' when c_custkey%2=0 then '2019-06' end as planned_start_date,
 case when c_custkey%37=0 then '2021' when c_custkey%3=0 then '2023-12' end as planned_completion_date
from {customer}
"""
OBS_SQL = """
select event_id as arrival_seq, concat('N',lpad(cast(user_id as string),8,'0')) as project_id,
 case when k=13 then '2020-00' when k=14 then 'n/a' else concat(cast(cast(2020+floor(k/12) as int) as string),'-',lpad(cast(k%12+1 as string),2,'0')) end as reporting_month,
 case when event_type='error' and event_id%5=0 then -value else value end as financial_progress,
 case when event_id%3=0 then value/2 end as physical_progress, case when event_id%211=0 then -1.0e0 else value*10 end as expenditure,
 case when event_id%17=0 then value-20 end as revised_cost, case when event_id%4=0 then '2024-05' end as completion_date
from (select e.*, cast(regexp_extract(props,'([0-9]+)',1) as bigint) as k from {events} e)
"""


def registrations(spark, sf):
    return N.check_registrations(run_sql(spark, sf, REG_SQL, "customer"))


def registry(spark, sf):
    return registrations(spark, sf).where("reject_reason is null").drop("reject_reason")


def observations(spark, sf):
    return N.accept_in_order(N.check_observations(run_sql(spark, sf, OBS_SQL, "events"), registry(spark, sf)))


_YM = lambda c: f"regexp_matches({c},'^\\d{{4}}-(0[1-9]|1[0-2])$')"
C.fragment("reg0", (), REG_SQL.format(customer="customer"))
C.fragment("reg1", ("reg0",), f"""
select *, case when trim(project_id)='' then 'EMPTY_PROJECT_ID' when trim(project_name)='' then 'EMPTY_PROJECT_NAME'
 when not approved_cost>0 then 'NON_POSITIVE_APPROVED_COST' when not {_YM('initial_reporting_month')} then 'INVALID_INITIAL_MONTH'
 when not {_YM('planned_start_date')} then 'INVALID_PLANNED_START' when not {_YM('planned_completion_date')} then 'INVALID_PLANNED_COMPLETION' end as own from reg0""")
C.fragment("reg", ("reg1",), """
select r.*, case when own is not null then own when exists(select 1 from reg1 x where x.own is null and x.project_id=r.project_id and x.arrival_seq<r.arrival_seq)
 then 'ALREADY_REGISTERED' end as reject_reason from reg1 r""")
C.fragment("rgs", ("reg",), "select * from reg where reject_reason is null")
C.fragment("obs0", (), OBS_SQL.format(events="events"))
C.fragment("obs1", ("obs0", "rgs"), f"""
select o.*, case when o.project_id not in (select project_id from rgs) then 'UNKNOWN_PROJECT' when not {_YM('reporting_month')} then 'INVALID_MONTH'
 when financial_progress<0 then 'NEGATIVE_FINANCIAL_PROGRESS' when physical_progress<0 or physical_progress>100 then 'PHYSICAL_PROGRESS_OUT_OF_RANGE'
 when expenditure<0 then 'NEGATIVE_EXPENDITURE' when revised_cost<=0 then 'NON_POSITIVE_REVISED_COST' end as own from obs0 o""")
# literal statement: compare with every earlier valid arrival of the entity
C.fragment("obs", ("obs1",), """
select o.*, case when own is not null then own when reporting_month > coalesce(mx,'') then null
  when exists(select 1 from obs1 x where x.own is null and x.project_id=o.project_id and x.reporting_month=o.reporting_month and x.arrival_seq<o.arrival_seq
     and not exists(select 1 from obs1 y where y.own is null and y.project_id=x.project_id and y.arrival_seq<x.arrival_seq and y.reporting_month>=x.reporting_month)) then 'DUPLICATE_MONTH'
  else 'CHRONOLOGY_VIOLATION' end as reject_reason
from (select *, max(case when own is null then reporting_month end) over (partition by project_id order by arrival_seq rows between unbounded preceding and 1 preceding) as mx from obs1) o""")


@query("registration_intake", C.check("select arrival_seq, project_id, reject_reason from reg", "reg"))
def _(spark, sf):
    return registrations(spark, sf).select("arrival_seq", "project_id", "reject_reason")


@query("observation_intake", C.check("select arrival_seq, project_id, reporting_month, reject_reason from obs", "obs"))
def _(spark, sf):
    return observations(spark, sf).select("arrival_seq", "project_id", "reporting_month", "reject_reason")


@query("observation_defaults", C.check("""
select o.arrival_seq, o.project_id, o.reporting_month, r.approved_cost, coalesce(o.revised_cost, r.revised_cost) as revised_cost,
 r.planned_completion_date as original_completion_date, o.completion_date as revised_completion_date,
 row_number() over (partition by o.project_id order by o.reporting_month) as observation_number,
 case when row_number() over (partition by o.project_id order by o.reporting_month) <= 1 then 'LOW_HISTORY' when row_number() over (partition by o.project_id order by o.reporting_month)=2 then 'LIMITED_HISTORY'
   when row_number() over (partition by o.project_id order by o.reporting_month)<=5 then 'DEVELOPING_HISTORY' else 'ESTABLISHED_HISTORY' end as history_confidence,
 case when row_number() over (partition by o.project_id order by o.reporting_month) <= 1 then 'INSUFFICIENT_HISTORY' when row_number() over (partition by o.project_id order by o.reporting_month)=2 then 'INITIAL_TRAJECTORY'
   else 'ESTABLISHED_TRAJECTORY' end as trajectory_status,
 cast(cast(substr(reporting_month,1,4) as int)*12+cast(substr(reporting_month,6,2) as int)-(cast(substr(planned_start_date,1,4) as int)*12+cast(substr(planned_start_date,6,2) as int)) as double) as project_age_months
from obs o join rgs r using (project_id) where o.reject_reason is null""", "obs", "rgs"))
def _(spark, sf):
    from tidewatch.operators.timeline import history
    df = N.with_project_defaults(observations(spark, sf).where("reject_reason is null").withColumn("sector", F.lit("")), registry(spark, sf))
    df = df.withColumn("month_idx", month_index(F.col("reporting_month"))).withColumn("observation_number", F.row_number().over(history()))
    n = F.col("observation_number")
    return df.select(
        "arrival_seq", "project_id", "reporting_month", "approved_cost", "revised_cost", "original_completion_date", "revised_completion_date",
        n, N.history_confidence(n).alias("history_confidence"), N.trajectory_status(n).alias("trajectory_status"),
        planned_age(F.col("planned_start_date")).alias("project_age_months"))


# ---- governance over the scored panel ------------------------------------

def governance_events(spark, sf) -> DataFrame:
    """Observations and responses from one pass over the scored panel."""
    rows = risks(spark, sf)
    month = F.col("month_idx")
    none = lambda t: F.lit(None).cast(t)
    observe = F.struct(
        F.lit("OBSERVE").alias("kind"), (month * 10).cast("long").alias("arrival_seq"), F.col("p").alias("risk"),
        F.col("V_fin_1m").alias("velocity"), F.col("schedule_deviation_months").alias("deviation"),
        F.col("trajectory_risk_score").alias("score"), none("int").alias("persistence_cycles"), none("string").alias("warning_id"),
        none("boolean").alias("acknowledged"), none("string").alias("response_text"), none("string").alias("corrective_action"))
    respond = F.struct(
        F.lit("RESPOND").alias("kind"), (month * 10 + 5).cast("long").alias("arrival_seq"), none("double").alias("risk"),
        none("double").alias("velocity"), none("double").alias("deviation"), none("double").alias("score"),
        none("int").alias("persistence_cycles"), none("string").alias("warning_id"), (month % 3 != 0).alias("acknowledged"),
        F.when(month % 5 == 0, " ").otherwise("understood").alias("response_text"), F.lit("more crews").alias("corrective_action"))
    both = F.when(month % 4 == 0, F.array(observe, respond)).otherwise(F.array(observe))
    return rows.select("project_id", "reporting_month", F.explode(both).alias("e")).select("project_id", "reporting_month", "e.*")


def outcomes(spark, sf):
    return G.run_governance(governance_events(spark, sf))


def kept_outcomes(spark, sf):
    """The outcomes as a table stored once a session, for what is derived from them."""
    return kept(spark, sf, "outcomes", lambda: outcomes(spark, sf))


C.fragment("gev", ("sc",), """
select *, row_number() over (partition by project_id order by arrival_seq) as n from (
 select project_id, 'OBSERVE' as kind, cast(month_idx*10 as bigint) as arrival_seq, reporting_month as month, p, V_fin_1m as v, schedule_deviation_months as d, trajectory_risk_score as s, false as fit from sc
 union all select project_id, 'RESPOND', cast(month_idx*10+5 as bigint), reporting_month, null, null, null, null, (month_idx%3<>0 and month_idx%5<>0) from sc where month_idx%4=0)""")
_GOV = "gov(project_id, n, oc, kind, arrival_seq, month, p, active, wmonth, wstatus, wp, wv, wd, ws, cycles, responded, pstatus, was)"
C.fragment(_GOV, ("gev",), """
select project_id, cast(0 as bigint), null::varchar, null::varchar, null::bigint, null::varchar, null::double, false, null::varchar, null::varchar, null::double, null::double, null::double, null::double, 0, false, 'ACTIVE', false
from (select distinct project_id from gev)
union all
select project_id, n1, oc, k, a, m, ep, case when oc='ISSUED' then true when oc in ('RECOVERED','ESCALATED') then false else active end,
 case when oc='ISSUED' then m else wmonth end,
 case when oc in ('ISSUED','RECOVERED','ESCALATED','PERSISTENT_DETERIORATION') then oc when oc='RESPONSE_ACCEPTED' then 'RESPONSE_SUBMITTED' else wstatus end,
 case when oc='ISSUED' then ep else wp end, case when oc='ISSUED' then ev else wv end, case when oc='ISSUED' then ed else wd end, case when oc='ISSUED' then es else ws end,
 case when oc='ISSUED' then 1 when active and k='OBSERVE' and ep>=0.5::double then cycles+1 else cycles end,
 case when oc='ISSUED' then false else responded or oc='RESPONSE_ACCEPTED' end,
 case when oc='ISSUED' then 'WARNING_ISSUED' when oc in ('RECOVERED','ESCALATED') then oc when oc='RESPONSE_ACCEPTED' then 'UNDER_RECOVERY' else pstatus end, active
from (select g.* exclude (oc), e.n as n1, e.kind as k, e.arrival_seq as a, e.month as m, e.p as ep, e.v as ev, e.d as ed, e.s as es,
  case when e.kind='RESPOND' then case when g.active and not g.responded and g.wstatus<>'RESPONSE_SUBMITTED' and e.fit then 'RESPONSE_ACCEPTED' else 'RESPONSE_REJECTED' end
   when not g.active then case when e.p>=0.5::double then 'ISSUED' else 'NONE' end
   when e.p<0.5::double and e.v is null and e.d is null and e.s is null then 'INSUFFICIENT_EVIDENCE'
   when e.p<0.5::double and (coalesce(e.v>0 and (g.wv is null or e.v>g.wv),false) or coalesce(e.d<=g.wd,false) or coalesce(e.s<g.ws,false)) then 'RECOVERED'
   when g.cycles + (case when e.p>=0.5::double then 1 else 0 end) >= 2 then 'ESCALATED' else 'PERSISTENT_DETERIORATION' end as oc
  from gov g join gev e on e.project_id=g.project_id and e.n=g.n+1)""")
_WID = lambda pid, m: f"'WARN-'||upper(sha256({pid}||'|'||{m}))"
C.fragment("out", (_GOV,), f"""
select project_id, kind, arrival_seq, month as reporting_month, p as risk, oc as outcome,
 case oc when 'ISSUED' then 'CONTRACTOR_WARNING_ISSUED' when 'RECOVERED' then 'PROJECT_RECOVERED' when 'ESCALATED' then 'AUTHORITY_ESCALATION_ISSUED' else 'NONE' end as action,
 case when oc in ('PERSISTENT_DETERIORATION','ESCALATED') then 'PERSISTENT_DETERIORATION' when oc in ('RECOVERED','INSUFFICIENT_EVIDENCE') then oc end as recovery_status,
 case when was or active then {_WID('project_id', 'wmonth')} end as warning_id, case when was or active then wstatus end as warning_status, pstatus as project_status,
 case when was or active then cycles end as cycles, 2 as required_cycles,
 case when oc='ESCALATED' then case when responded then 'RESPONSE_SUBMITTED' else 'UNRESPONSIVE' end end as response_status,
 case when was or active then wp end as w_risk from gov where n>0""")
OUT = [x.split()[0] for x in S.OUT_SCHEMA.split(", ")]


@query("governance_outcomes", C.check(f"select {','.join(OUT)} from out", "out"))
def _(spark, sf):
    return outcomes(spark, sf).select(*OUT)


C.fragment("aud", ("out",), f"""
select project_id, arrival_seq, reporting_month, risk, warning_id, cast(i-1 as int) as seq, types[i] as event_type from (
 select *, unnest(range(1, len(types)+1)) as i from (
  select *, list_concat(case when kind='OBSERVE' then list_filter(['MONTHLY_REPORT_SUBMITTED','PREDICTION_GENERATED',
     case when {C.TIER.format(p='risk')} in ('WATCH','REVIEW') then {C.TIER.format(p='risk')}||'_ENTERED' end], lambda x: x is not null) else [] end,
   case outcome when 'ISSUED' then ['CONTRACTOR_WARNING_ISSUED'] when 'RECOVERED' then ['RECOVERY_DETECTED'] when 'PERSISTENT_DETERIORATION' then ['PERSISTENT_DETERIORATION_DETECTED']
     when 'ESCALATED' then ['PERSISTENT_DETERIORATION_DETECTED','AUTHORITY_ESCALATION_ISSUED'] when 'RESPONSE_ACCEPTED' then ['CONTRACTOR_RESPONSE_RECEIVED','RECOVERY_MONITORING_STARTED'] else [] end) as types from out))""")


@query("audit_ledger", C.check(
    "select *, 'AUD-'||upper(sha256(project_id||'|'||arrival_seq||'|'||seq)) as event_id from aud", "aud"))
def _(spark, sf):
    return G.audit_ledger(kept_outcomes(spark, sf))


@query("project_audit_trail", C.check("select arrival_seq, seq, event_type from aud where project_id='N00000012' order by 1,2", "aud"))
def _(spark, sf):
    return G.audit_ledger(kept_outcomes(spark, sf)).where("project_id = 'N00000012'").select("arrival_seq", "seq", "event_type").orderBy("arrival_seq", "seq")


C.fragment("wrn", ("out",), """
select project_id, warning_id, max(reporting_month) filter (outcome='ISSUED') as reporting_month, max(risk) filter (outcome='ISSUED') as risk_probability,
 min(arrival_seq) as issued_seq, arg_max(warning_status, arrival_seq) as status from out where warning_id is not null group by 1,2""")


@query("contractor_warnings", C.check("select * from wrn", "wrn"))
def _(spark, sf):
    return G.warnings(kept_outcomes(spark, sf))


_ESC = "select 'ESC-'||upper(sha256(warning_id)) as escalation_id, project_id, warning_id, arrival_seq, reporting_month, w_risk as risk_at_warning, risk as current_risk, cycles as persistence_duration, response_status from out where outcome='ESCALATED'"
C.fragment("esc", ("out",), _ESC)


@query("authority_escalations", C.check("select * from esc", "esc"))
def _(spark, sf):
    return G.escalations(kept_outcomes(spark, sf))


@query("escalation_dossiers", C.check("""
select e.escalation_id, e.project_id, w.reporting_month as warning_month, (select 'RESP-'||upper(sha256(r.warning_id)) from out r where r.outcome='RESPONSE_ACCEPTED' and r.warning_id=e.warning_id) as response_id,
 (select count(*) from aud a where a.project_id=e.project_id and (a.arrival_seq<e.arrival_seq or (a.arrival_seq=e.arrival_seq and a.event_type<>'AUTHORITY_ESCALATION_ISSUED'))) as trail_length
from esc e join wrn w using (warning_id)""", "esc", "wrn", "aud"))
def _(spark, sf):
    return G.escalation_dossiers(kept_outcomes(spark, sf)).select(
        "escalation_id", "project_id", "warning_month", "response_id", F.size("trail").cast("long").alias("trail_length"))


def panel_registry(spark, sf) -> DataFrame:
    return stored_panel(spark, sf).groupBy("project_id").agg(
        F.min("project_name").alias("project_name"), F.coalesce(F.min("sector"), F.lit("OTHER")).alias("sector"),
        F.min("approved_cost").alias("approved_cost"), F.min("month_idx").cast("long").alias("arrival_seq"))


C.fragment("prg", ("panel",), "select project_id, min(project_name) as project_name, coalesce(min(sector),'OTHER') as sector, min(approved_cost) as approved_cost, cast(min(month_idx) as bigint) as arrival_seq from panel group by 1")
C.fragment("pst", ("prg", "out"), """
select r.*, l.* exclude (project_id), coalesce(gs,'ACTIVE') as governance_state from prg r left join (
 select project_id, arg_max(reporting_month, arrival_seq) filter (kind='OBSERVE') as latest_month, arg_max(risk, arrival_seq) filter (kind='OBSERVE') as latest_risk,
  arg_max(warning_id, arrival_seq) filter (outcome='ISSUED') as latest_warning_id, arg_max(warning_status, arrival_seq) filter (warning_id is not null) as latest_warning_status,
  max(arrival_seq) filter (outcome='RESPONSE_ACCEPTED') as latest_response_seq, arg_max(reporting_month, arrival_seq) filter (outcome='ESCALATED') as latest_escalation_month,
  arg_max(project_status, arrival_seq) as gs from out group by 1) l using (project_id)""")


def status(spark, sf):
    return G.project_status(kept_outcomes(spark, sf), panel_registry(spark, sf))


@query("project_status", C.check("select * exclude (gs) from pst", "pst"))
def _(spark, sf):
    return status(spark, sf)


@query("escalations_by_sector", C.check(
    "select e.*, project_name, sector, approved_cost from esc e join prg using (project_id) where lower(sector)='railways'", "esc", "prg"))
def _(spark, sf):
    return G.escalation_list(kept_outcomes(spark, sf), panel_registry(spark, sf), "Railways").select(
        "escalation_id", "project_id", "warning_id", "arrival_seq", "reporting_month", "risk_at_warning", "current_risk",
        "persistence_duration", "response_status", "project_name", "sector", "approved_cost")


@query("monitored_project_page", C.check("""
with f as (select * from pst where governance_state='RECOVERED') select project_id, sector, governance_state, (select count(*) from f) as total from f order by arrival_seq desc, project_id limit 25 offset 5""", "pst"))
def _(spark, sf):
    return G.list_projects(status(spark, sf), state="recovered", limit=25, offset=5).select("project_id", "sector", "governance_state", "total")


@query("brief_facts", C.check("""
select p.project_id, governance_state, coalesce(wc,0) as warning_count, array_to_string(ev[greatest(len(ev)-2,1):len(ev)], ',') as recent_audit_events,
 governance_state='ESCALATED' as is_escalated, governance_state in ('UNDER_RECOVERY','RECOVERED') as is_recovering
from pst p left join (select project_id, count(*) as wc from wrn group by 1) using (project_id)
left join (select project_id, list(event_type order by arrival_seq, seq) as ev from aud group by 1) using (project_id)""", "pst", "wrn", "aud"))
def _(spark, sf):
    out = kept_outcomes(spark, sf)
    df = G.brief_facts(out, G.project_status(out, panel_registry(spark, sf)))
    return df.select("project_id", "governance_state", "warning_count", F.array_join("recent_audit_events", ",").alias("recent_audit_events"),
                     "is_escalated", "is_recovering")


@query("cascade_delete", C.check("select (select count(*) from wrn where project_id<>'N00000012') as warnings, (select count(*) from prg where project_id<>'N00000012') as projects", "wrn", "prg"))
def _(spark, sf):
    left = G.without_project({"w": G.warnings(kept_outcomes(spark, sf)), "p": panel_registry(spark, sf)}, "N00000012")
    tagged = left["w"].select(F.lit("w").alias("t")).unionByName(left["p"].select(F.lit("p").alias("t")))
    return tagged.agg(F.count(F.when(F.col("t") == "w", 1)).alias("warnings"), F.count(F.when(F.col("t") == "p", 1)).alias("projects"))


# ---- streams -------------------------------------------------------------

def _staged(df: DataFrame, label: str) -> DataFrame:
    """Store rows and open the folder as a stream."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def _drained(stream: DataFrame, handle) -> None:
    S.drain(stream, handle, fresh_path(stream.sparkSession, "stream-checkpoint"))


@query("stream_governance", C.check(f"select {','.join(OUT)} from out", "out"))
def _(spark, sf):
    """Live outcomes of the whole event history; must equal the batch fold."""
    out = fresh_path(spark, "governance")
    _drained(_staged(governance_events(spark, sf), "events"), lambda df, i: S.govern(df, i, out))
    return Committed(spark, out).read("outcomes").select(*OUT)


@query("stream_audit_ledger", C.check(
    "select *, 'AUD-'||upper(sha256(project_id||'|'||arrival_seq||'|'||seq)) as event_id from aud", "aud"))
def _(spark, sf):
    """The ledger that the stream appends; must equal the batch ledger."""
    out = fresh_path(spark, "governance")
    _drained(_staged(governance_events(spark, sf), "events"), lambda df, i: S.govern(df, i, out))
    return Committed(spark, out).read("ledger")


FEATS = ["V_fin_1m", "V_fin_3m", "A_fin", "V_exp_1m", "A_exp", "V_phys_1m", "A_phys", "schedule_deviation_change", "completion_date_drift",
         "observation_number", "months_since_previous_observation", "reporting_gap_flag", "C_base", "expenditure_to_baseline"]
# an observation seen alone knows no peers: its z-score is 0
C.fragment("alone", ("mo", "ew(project_id, observation_number, mean, weight)"), C.FRAGMENTS["kin"][1].replace(
    "left join peers p using (reporting_month, sector_clean, scale_bucket)", "").replace(
    "case when p.peer_count>=5 and coalesce(p.peer_v_std,0)>0.01\n           then (V_fin_1m-p.peer_v_mean)/p.peer_v_std else 0.0::double end",
    "0.0::double"))


@query("stream_features", C.check(
    f"select project_id, reporting_month, {','.join(FEATS)}, trajectory_risk_score, {C.half_even('EWMA_V_fin', 6)} as EWMA_V_fin from alone", "alone"))
def _(spark, sf):
    """Features and scores of arriving observations; must equal the batch windows."""
    obs = panel(spark, sf).withColumn("arrival_seq", F.col("month_idx").cast("long"))
    out = fresh_path(spark, "features")
    _drained(_staged(obs, "observations"), lambda df, i: S.featurise(df, i, out))
    got = Committed(spark, out).read("features").select("project_id", "reporting_month", *FEATS, "EWMA_V_fin", "trajectory_risk_score")
    return rounded(got, 6, "EWMA_V_fin")


@query("stream_rejects", C.check(
    "select arrival_seq, project_id, reporting_month, reject_reason from obs where reject_reason is not null", "obs"))
def _(spark, sf):
    """Observations that the stream refused, each with its reason; must equal the batch intake."""
    raw = run_sql(spark, sf, OBS_SQL, "events").withColumns({
        "sector": F.lit("none"), "approved_cost": F.lit(1.0), "schedule_deviation": F.lit(None).cast("double"),
        "orig_completion_idx": F.lit(None).cast("int"), "rev_completion_idx": F.lit(None).cast("int")})
    out, known = fresh_path(spark, "rejects"), registry(spark, sf)
    _drained(_staged(raw, "arrivals"), lambda df, i: S.featurise(df, i, out, known))
    return Committed(spark, out).read("rejects").select("arrival_seq", "project_id", "reporting_month", "reject_reason")


IDLE = 6
# rows whose month is a multiple of 11 are sent again a year later
_ARRIVALS = """
select p.*, cast(floor((month_idx-1)/12) as int) as arrival_year, false as again from panel p
union all select p.*, cast(floor((month_idx-1)/12) as int)+1, true from panel p where month_idx%11=0"""
C.fragment("arr", ("panel",), _ARRIVALS)
C.fragment("hor", ("arr",), f"""
select y, (select max(month_idx) from arr where arrival_year<y and not again) - {IDLE} as hz from (select distinct arrival_year as y from arr)""")
C.fragment("lastb", ("arr", "hor"), """
select y, hz, project_id, max(month_idx) as last from hor join arr on arrival_year<y and not again group by all""")


@query("stream_expiry", C.check(f"""
select 'EXPIRED' as event, project_id, {C.label('last')} as reporting_month, {C.label('hz')} as horizon_month from lastb a
where last<hz and not exists (select 1 from lastb b where b.project_id=a.project_id and b.last=a.last and b.y<a.y and b.last<b.hz)
union all
select case when month_idx<hz then 'TOO_LATE' else 'DUPLICATE_MONTH' end, project_id, reporting_month, null from arr join hor on y=arrival_year where again""", "arr", "hor", "lastb"))
def _(spark, sf):
    """A year of observations a trigger, each trigger a restart: entities silent for long lose their state, old rows are refused."""
    arrivals = stored(spark.sql(_ARRIVALS.replace("from panel p", "from {p} p"), p=panel(spark, sf)).withColumn(
        "arrival_seq", (F.col("month_idx") + F.when(F.col("again"), 12).otherwise(0)).cast("long")), "arrivals")
    years = sorted(r[0] for r in arrivals.select("arrival_year").distinct().collect())
    source, out, mark = fresh_path(spark, "arriving"), fresh_path(spark, "expiry"), fresh_path(spark, "stream-checkpoint")
    for year in years:
        arrivals.where(F.col("arrival_year") == year).write.mode("append").parquet(source)
        stream = spark.readStream.schema(arrivals.schema).parquet(source)
        S.drain(stream, lambda df, i: S.featurise(df, i, out, expiry=S.Expiry(IDLE)), mark)
    tables = Committed(spark, out)
    gone = tables.read("expired").select(F.lit("EXPIRED").alias("event"), "project_id", F.col("last_month").alias("reporting_month"), "horizon_month")
    return gone.unionByName(tables.read("rejects").select(
        F.col("reject_reason").alias("event"), "project_id", "reporting_month", F.lit(None).cast("string").alias("horizon_month")))
