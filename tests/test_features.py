"""Hand-computed panels: timeline, kinetics, labels, policies, replay, lead times."""

import re

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import evaluate as E
from tidewatch.operators import kinetics as K
from tidewatch.operators import labels as G
from tidewatch.operators import leadtime as L
from tidewatch.operators import policies as B
from tidewatch.operators import portfolio as P
from tidewatch.operators import ranking
from tidewatch.operators import replay as R
from tidewatch.operators.quality import audit_leakage
from tidewatch.operators.timeline import require_unique_grain, timeline

BASE = {
    "project_id": "string", "reporting_month": "string", "sector": "string", "financial_progress": "double",
    "physical_progress": "double", "expenditure": "double", "approved_cost": "double", "revised_cost": "double",
    "original_completion_date": "string", "revised_completion_date": "string", "schedule_deviation": "double",
}


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in BASE) for r in rows], ", ".join(f"{c} {t}" for c, t in BASE.items()))


def months(first_year, n, **cols):
    out = []
    for i in range(n):
        r = {"project_id": "P1", "reporting_month": f"{first_year + i // 12}-{i % 12 + 1:02d}"}
        r |= {k: v[i] if isinstance(v, list) else v for k, v in cols.items()}
        out.append(r)
    return out


def column(df, name):
    return [r[name] for r in df.orderBy("project_id", "reporting_month").collect()]


def test_timeline_counts_gaps_and_ages(spark):
    rows = [{"project_id": "P1", "reporting_month": m} for m in ("2020-01", "2020-02", "2020-04")]
    rows += [{"project_id": "P2", "reporting_month": m} for m in ("2021-05", "2021-03")]
    t = timeline(frame(spark, rows))
    assert column(t, "observation_number") == [1, 2, 3, 1, 2]
    assert column(t, "project_age_months") == [0, 1, 3, 0, 2]
    assert column(t, "reporting_gap_flag") == [0, 0, 1, 0, 1]


def test_repeated_month_is_refused(spark):
    bad = frame(spark, [{"project_id": "P1", "reporting_month": "2020-01"}] * 2)
    with pytest.raises(ValueError):
        require_unique_grain(bad)
    with pytest.raises(Exception, match="month repeats"):
        timeline(bad).collect()


def test_kinetics_by_hand(spark):
    rows = months(
        2020, 4, financial_progress=[10.0, 12.0, 15.0, 17.0], expenditure=[100.0, 120.0, 150.0, 170.0], approved_cost=1000.0,
        revised_cost=[None, None, None, 1200.0], original_completion_date="2022-01",
        revised_completion_date=[None, None, None, "2022-04"], schedule_deviation=[0.0, 0.0, 0.0, 3.0])
    k = K.kinetics(timeline(frame(spark, rows)))
    assert column(k, "V_fin_1m") == [None, 2.0, 3.0, 2.0]
    assert column(k, "V_fin_3m")[3] == 7.0
    assert column(k, "A_fin") == [None, None, 1.0, -1.0]
    assert column(k, "V_exp_1m")[1] == 20.0 and column(k, "V_exp_3m")[3] == 70.0
    assert column(k, "C_base") == [1000.0, 1000.0, 1000.0, 1200.0]
    assert column(k, "cost_revision_ratio")[3] == pytest.approx(0.2)
    assert column(k, "completion_date_drift")[3] == 3.0 and column(k, "schedule_deviation_change")[3] == 3.0
    assert set(column(k, "Z_peer_V_fin")) == {0.0}


def test_ewma_constant_and_gap(spark):
    same = K.kinetics(timeline(frame(spark, months(2020, 4, financial_progress=[0.0, 2.0, 4.0, 6.0]))))
    assert column(same, "EWMA_V_fin") == [None, 2.0, 2.0, 2.0]
    vals = spark.createDataFrame([([None, 1.0, None, 3.0],)], "v array<double>")
    got = vals.select(K.decayed_mean(F.col("v"), 0.3).alias("m")).first()["m"]
    # the gap decays the old weight to 0.49 before the new value joins
    assert got[:3] == [None, 1.0, 1.0] and got[3] == pytest.approx((0.49 * 1.0 + 0.3 * 3.0) / 0.79)


def test_stalled_project_scores_one(spark):
    k = K.kinetics(timeline(frame(spark, months(2020, 3, financial_progress=10.0, expenditure=5.0, approved_cost=100.0))))
    assert column(k, "score_stalled_velocity")[1:] == [1.0, 1.0]
    assert all(0 <= s <= 100 for s in column(k, "trajectory_risk_score") if s is not None)


def test_future_does_not_move_the_past(spark):
    make = lambda last: frame(spark, months(2020, 4, financial_progress=[1.0, 2.0, 4.0, 5.0], approved_cost=100.0, revised_cost=[None, None, None, last]))
    a, b = (K.kinetics(timeline(make(x))).where("observation_number <= 3") for x in (100.0, 500.0))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_cost_labels_and_censoring(spark):
    t = G.targets(frame(spark, months(2020, 15, approved_cost=1000.0, revised_cost=[1000.0] * 10 + [1200.0] * 5)))
    assert column(t, "cost_overrun_6m")[0] == 0.0 and column(t, "cost_overrun_12m")[0] == 1.0
    assert column(t, "cost_escalation_pct_12m")[0] == pytest.approx(0.2)
    assert column(t, "distress_type_12m")[0] == "COST"
    assert column(t, "overrun_composite_6m")[10:] == [None] * 5
    assert column(t, "overrun_composite_12m")[4:] == [None] * 11


def test_eligibility_needs_history(spark):
    t = G.targets(frame(spark, months(2020, 5, approved_cost=10.0)))
    assert column(t, "eligible_features") == [0, 0, 0, 1, 1]


def test_policies_ignore_missing(spark):
    df = spark.createDataFrame([(0.5, 3.0), (0.95, None), (None, 12.0), (None, None)], "expenditure_to_baseline double, schedule_deviation_months double")
    assert [r[0] for r in df.select(B.policy_a()).collect()] == [0, 1, 1, 0]
    df = spark.createDataFrame([(2.0, 2.0, 0.0, 10.0), (0.2, 2.0, 0.0, 10.0), (None, None, -1.5, None)],
                               "V_fin_1m double, EWMA_V_fin double, Z_peer_V_fin double, trajectory_risk_score double")
    assert [r[0] for r in df.select(B.policy_b()).collect()] == [0, 1, 1]


def test_leakage_audit_names():
    audit_leakage(["V_fin_1m", "C_base"])
    with pytest.raises(ValueError):
        audit_leakage(["cost_overrun_12m"])


def test_dip_and_restore_is_no_event(spark):
    df = K.kinetics(timeline(frame(spark, months(2020, 4, approved_cost=[5000.0, 5000.0, 3000.0, 5000.0], financial_progress=1.0))))
    assert R.with_events(df).where("actual_event").count() == 0
    up = K.kinetics(timeline(frame(spark, months(2020, 10, approved_cost=[5000.0] * 6 + [6000.0] * 4, financial_progress=1.0))))
    assert [r["reporting_month"] for r in R.with_events(up).where("actual_event").collect()] == ["2020-07"]


def test_lead_time_of_one_alert(spark):
    df = K.point_state(timeline(frame(spark, months(2020, 12, approved_cost=[1000.0] * 6 + [1200.0] * 6))), K.KineticsConfig())
    df = df.withColumns({"p": F.when(F.col("reporting_month") == "2020-01", 0.85).otherwise(0.1), "y": F.lit(1.0)})
    s = L.lead_times(df, 0.5, level="alert", fallback=12, y="y", strict=False).first()
    assert (s["evaluated"], s["median_lead"]) == (1, 6.0)


def test_average_precision_is_a_step_sum(spark):
    ys, ps = [1, 0, 1, 1, 0, 0], [0.9, 0.8, 0.8, 0.4, 0.3, 0.1]
    df = spark.createDataFrame(list(zip(map(float, ys), ps)), "y double, p double")
    want = (1 * 1 / 1 + 1 * 2 / 3 + 1 * 3 / 4) / 3
    a = E.metrics(E.curve(E.score_histogram(df), [])).first()
    b = E.metrics(E.exact_curve(df)).first()
    assert a["pr_auc"] == b["pr_auc"] == pytest.approx(want, abs=1e-4)
    assert a["roc_auc"] == b["roc_auc"] == pytest.approx(7.5 / 9, abs=1e-4)


def test_one_class_gets_fixed_values(spark):
    m = E.metrics(E.curve(E.score_histogram(spark.createDataFrame([(0.0, 0.2)], "y double, p double")), [])).first()
    assert (m["pr_auc"], m["roc_auc"], m["recall"]) == (0.0, 0.5, 0.0)


def test_exact_percentiles_with_a_dominant_value(spark):
    import numpy as np
    vals = [5.0] * 400 + [float(i % 97) + i / 1000 for i in range(600)]
    df = spark.createDataFrame([("a", v) for v in vals] + [("b", 1.0), ("b", 2.0)], "g string, v double")
    got = {r["g"]: r for r in ranking.exact_percentiles(df, ["g"], "v", [0.25, 0.5, 0.9], buckets=8).collect()}
    assert [got["a"][f"p{i}"] for i in range(3)] == pytest.approx(list(np.percentile(vals, [25, 50, 90])))
    assert got["b"]["p1"] == 1.5


def test_mean_follows_gaps_whatever_order_rows_come_in(spark):
    rows = months(2020, 5, financial_progress=[1.0, 2.0, None, 5.0, 9.0]) + [
        r | {"project_id": "P2"} for r in months(2021, 3, financial_progress=[4.0, 4.0, 8.0])]
    moved = K.motion(K.point_state(timeline(frame(spark, rows[::-1])), K.KineticsConfig()))
    k = K.with_ewma(moved, "V_fin_1m", "m", 0.3)
    assert k.columns == [*moved.columns, "m"]
    mean = (0.7 * 0.7 * 0.7 * 1.0 + 0.3 * 4.0) / (0.7 * 0.7 * 0.7 + 0.3)
    assert column(k, "m") == [None, 1.0, 1.0, 1.0, pytest.approx(mean), None, 0.0, pytest.approx(0.3 * 4.0)]
    # a plan that gathers whole rows sorts each of them three times
    assert "collect_list(struct(month_idx" not in k._jdf.queryExecution().toString()


def test_generated_methods_are_short_enough_to_compile(spark):
    """The JVM leaves methods above 8,000 bytes to its interpreter, which is some fifty times slower."""
    scored = B.with_heuristic_score(K.kinetics(G.with_labels(timeline(frame(spark, months(2020, 4, financial_progress=1.0))))))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = scored.select("*")._jdf.queryExecution().executedPlan()
        code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(s) for s in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000


def test_latest_rows_of_repeated_and_unknown_months(spark):
    rows = spark.createDataFrame(
        [("A", 1, "2020-01", 5.0), ("A", 2, "2020-02", None), ("B", None, "2020-07", 1.0), (None, 3, "2020-03", 2.0)],
        "project_id string, month_idx int, reporting_month string, v double")
    last = P.latest_rows(rows)
    assert {tuple(r) for r in last.collect()} == {
        ("A", 2, "2020-02", None, "2020-01"), ("B", None, None, None, "2020-07"), (None, 3, "2020-03", 2.0, "2020-03")}
    # only what is asked for is read: the wide rest does not pass through an aggregate
    assert "max_by" not in last.select("project_id", "v")._jdf.queryExecution().toString()
