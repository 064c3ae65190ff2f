"""Building blocks of the checking SQL, written for the comparison engine.

Each fragment is an independent statement of an operator's meaning; ``check``
puts together the fragments a query depends on.
"""

from __future__ import annotations

from tidewatch.plans.panel import PANEL_SQL

FRAGMENTS: dict[str, tuple[tuple[str, ...], str]] = {}


def fragment(name: str, deps: tuple[str, ...], text: str) -> None:
    FRAGMENTS[name] = (deps, text)


def half_even(expr: str, digits: int) -> str:
    if digits == 0:
        return f"round_even(cast({expr} as double), 0)"
    scale = 10**digits
    return f"round_even(cast({expr} as double)*{scale}.0::double, 0)/{scale}.0::double"


def clip(expr: str, low: float = 0.0, high: float = 1.0) -> str:
    return (f"case when ({expr}) is not null then "
            f"least(greatest(({expr}), {low}::double), {high}::double) end")


def label(idx: str) -> str:
    return f"printf('%04d-%02d', cast(floor((({idx})-1)/12) as int), cast((({idx})-1)%12+1 as int))"


def check(final: str, *needs: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in FRAGMENTS[n][0]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return final
    ctes = ",\n".join(
        f"{n} as materialized ({FRAGMENTS[n][1]})" if "(" not in n else f"{n} as ({FRAGMENTS[n][1]})"
        for n in order
    )
    body = final.strip()
    if body.lower().startswith("with "):
        return f"with recursive {ctes},\n{body[5:]}"
    return f"with recursive {ctes}\n{body}"


fragment("panel", (), PANEL_SQL.format(lineitem="lineitem", part="part"))

fragment("tl", ("panel",), """
select p.*,
  cast(row_number() over w as int) as observation_number,
  cast(month_idx - lag(month_idx) over w as double) as months_since_previous_observation,
  case when month_idx - lag(month_idx) over w > 1 then 1 else 0 end as reporting_gap_flag,
  cast(month_idx - min(month_idx) over (partition by project_id) as int) as project_age_months
from panel p window w as (partition by project_id order by month_idx)
""")

fragment("st", ("tl",), """
select *, expenditure_clean / C_base as expenditure_to_baseline,
  financial_progress - physical_progress_clean as financial_physical_gap,
  case when C_base < 150 then 'SMALL' when C_base < 1000 then 'MAJOR'
       when C_base >= 1000 then 'MEGA' else 'UNKNOWN' end as scale_bucket
from (select tl.*,
  coalesce(case when revised_cost>0 then revised_cost end, case when approved_cost>0 then approved_cost end) as C_base,
  case when revised_cost>0 and approved_cost>0 then (revised_cost-approved_cost)/approved_cost end as cost_revision_ratio,
  case when expenditure>=0 then expenditure end as expenditure_clean,
  case when physical_progress between 0 and 100 then physical_progress end as physical_progress_clean,
  coalesce(rev_completion_idx, orig_completion_idx) as completion_idx,
  schedule_deviation as schedule_deviation_months,
  case when sector is null or trim(sector) in ('','nan','UNKNOWN') then 'OTHER' else trim(sector) end as sector_clean
  from tl)
""")

fragment("mo", ("st",), """
select *, V_fin_1m - lag(V_fin_1m) over w as A_fin, V_exp_1m - lag(V_exp_1m) over w as A_exp,
  V_phys_1m - lag(V_phys_1m) over w as A_phys
from (select *,
  financial_progress - lag(financial_progress,1) over w as V_fin_1m,
  financial_progress - lag(financial_progress,3) over w as V_fin_3m,
  expenditure_clean - lag(expenditure_clean,1) over w as V_exp_1m,
  expenditure_clean - lag(expenditure_clean,3) over w as V_exp_3m,
  physical_progress_clean - lag(physical_progress_clean,1) over w as V_phys_1m,
  physical_progress_clean - lag(physical_progress_clean,3) over w as V_phys_3m,
  schedule_deviation_months - lag(schedule_deviation_months) over w as schedule_deviation_change,
  cast(completion_idx - lag(completion_idx) over w as double) as completion_date_drift
  from st window w as (partition by project_id order by month_idx))
window w as (partition by project_id order by month_idx)
""")

fragment("ew(project_id, observation_number, mean, weight)", ("mo",), """
select project_id, observation_number, V_fin_1m, 1.0::double from mo where observation_number = 1
union all
select m.project_id, m.observation_number,
  case when m.V_fin_1m is null then e.mean
       when e.mean is null or e.mean = m.V_fin_1m then m.V_fin_1m
       else (e.weight*0.7::double*e.mean + 0.3::double*m.V_fin_1m)/(e.weight*0.7::double+0.3::double) end,
  case when m.V_fin_1m is not null or e.mean is null then 1.0::double else e.weight*0.7::double end
from ew e join mo m on m.project_id = e.project_id and m.observation_number = e.observation_number + 1
""")

fragment("peers", ("mo",), """
select reporting_month, sector_clean, scale_bucket, avg(V_fin_1m) as peer_v_mean,
  stddev_samp(V_fin_1m) as peer_v_std, count(V_fin_1m) as peer_count
from mo group by all
""")

_SCORES = [
    ("score_stalled_velocity", "0.25"), ("score_deceleration", "0.15"), ("score_burn_anomaly", "0.15"),
    ("score_cost_revision", "0.15"), ("score_schedule_deterioration", "0.15"),
    ("score_peer_underperformance", "0.15"), ("score_physical_decoupling", "0.1"),
]
_NUM = "+".join(f"(case when {n} is not null then {n}*{w}::double else 0.0::double end)" for n, w in _SCORES)
_DEN = "+".join(f"(case when {n} is not null then {w}::double else 0.0::double end)" for n, w in _SCORES)
_CNT = "+".join(f"(case when {n} is not null then 1 else 0 end)" for n, _ in _SCORES)

fragment("kin", ("mo", "peers", "ew(project_id, observation_number, mean, weight)"), f"""
select *, case when {_CNT} >= 2 and {_DEN} > 0
    then {half_even(f"(({_NUM})/({_DEN}))*100.0::double", 2)} end as trajectory_risk_score
from (select *,
  {clip("1.0::double - V_fin_1m/3.0::double")} as score_stalled_velocity,
  {clip("-A_fin/2.0::double")} as score_deceleration,
  case when financial_progress>0 and expenditure_to_baseline>0 then
    {clip("((expenditure_to_baseline/(financial_progress/100.0::double))-1.0::double)/0.5::double")} end as score_burn_anomaly,
  coalesce({clip("cost_revision_ratio/0.25::double")}, 0.0::double) as score_cost_revision,
  case when completion_date_drift is not null or schedule_deviation_change is not null then
    {clip("greatest(coalesce(completion_date_drift,0.0::double),coalesce(schedule_deviation_change,0.0::double))/6.0::double")} end as score_schedule_deterioration,
  case when V_fin_1m is not null then {clip("-Z_peer_V_fin/2.0::double")} end as score_peer_underperformance,
  {clip("financial_physical_gap/20.0::double")} as score_physical_decoupling
  from (select mo.*, ew.mean as EWMA_V_fin,
      case when p.peer_count>=5 and coalesce(p.peer_v_std,0)>0.01
           then (V_fin_1m-p.peer_v_mean)/p.peer_v_std else 0.0::double end as Z_peer_V_fin
    from mo join ew using (project_id, observation_number)
    left join peers p using (reporting_month, sector_clean, scale_bucket)))
""")


def _labels(h: int, cost: float, slip: float) -> str:
    w = f"(partition by project_id order by month_idx range between 1 following and {h} following)"
    return f"""
select *, case when co=1 or so=1 then 1.0::double when co is not null or so is not null then 0.0::double end as overrun_composite_{h}m,
  case when not seen or (co is null and so is null) then 'UNOBSERVABLE' when co=1 and so=1 then 'BOTH'
       when co=1 then 'COST' when so=1 then 'SCHEDULE' else 'NONE' end as distress_type_{h}m
from (select *, cast(pct >= {cost}::double as double) as co, cast(drift >= {slip}::double as double) as so
  from (select *, case when seen then (fc - C_base)/C_base end as pct,
      case when seen then greatest(cast(fk - completion_idx as double), fd - schedule_deviation_months) end as drift
    from (select *, (last_m - month_idx >= {h} and n > 0) as seen from (
      select *, max(C_base) over {w} as fc, max(completion_idx) over {w} as fk,
        max(schedule_deviation_months) over {w} as fd, count(*) over {w} as n,
        max(month_idx) over (partition by project_id) as last_m from st))))
"""


fragment("t6", ("st",), _labels(6, 0.05, 3.0))
fragment("t12", ("st",), _labels(12, 0.05, 6.0))

_EACH = ", ".join(
    f"cast(t{h}.seen as int) as target_observable_{h}m, t{h}.pct as cost_escalation_pct_{h}m, "
    f"t{h}.co as cost_overrun_{h}m, t{h}.drift as schedule_drift_months_{h}m, t{h}.so as schedule_overrun_{h}m, "
    f"t{h}.overrun_composite_{h}m, t{h}.distress_type_{h}m"
    for h in (6, 12)
)
fragment("tgt", ("t6", "t12"), f"""
select t12.project_id, t12.reporting_month,
  case when t12.observation_number>=4 and t12.C_base is not null then 1 else 0 end as eligible_features, {_EACH}
from t12 join t6 using (project_id, month_idx)
""")

# features and labels side by side
fragment("ds", ("kin", "tgt"), "select * from kin join tgt using (project_id, reporting_month)")

# scored panel: the heuristic score stands in for a probability
fragment("sc", ("ds",), f"""
select *, {half_even("trajectory_risk_score/100.0::double", 4)} as p from ds
""")
fragment("cohort", ("sc",), "select * from sc where eligible_features=1 and target_observable_12m=1 and overrun_composite_12m is not null")

# money in whole hundredths and risks in whole ten-thousandths: sums do not depend on order
def paise_sum(expr: str, where: str = "") -> str:
    return f"cast(sum(cast(round_even({expr}*100.0::double, 0) as bigint)) {where} as double)/100.0::double"


def mean_risk(expr: str = "latest_risk", n: str = "1") -> str:
    return (f"cast(sum(cast(round_even({expr}*10000.0::double, 0) as bigint)*{n}) as double)"
            f"/cast(sum({n}) filter ({expr} is not null) as double)/10000.0::double")


TIER = ("case when {p}>=0.5::double then 'ESCALATE' when {p}>=0.45::double then 'REVIEW' "
        "when {p}>=0.4::double then 'WATCH' else 'NORMAL' end")
