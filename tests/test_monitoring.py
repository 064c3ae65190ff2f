"""Intake, governance sequences, stream against batch."""

from pyspark.sql import functions as F

from tidewatch.operators import kinetics as K
from tidewatch.operators.timeline import timeline
from tidewatch.schemas import MONITOR_EVENT
from tidewatch.session import fresh_path
from tidewatch.streaming import governance as G
from tidewatch.streaming import intake as N
from tidewatch.streaming import live as S
from tidewatch.streaming.committed import Committed


def events(spark, rows):
    names = MONITOR_EVENT.names
    return spark.createDataFrame([tuple({"kind": "OBSERVE", "project_id": "A", **r}.get(n) for n in names) for r in rows], MONITOR_EVENT)


def observe(i, p, v=1.0, dev=0.0, score=10.0, cycles=None, pid="A"):
    return {"project_id": pid, "arrival_seq": i * 10, "reporting_month": f"2024-{i:02d}", "risk": p, "velocity": v,
            "deviation": dev, "score": score, "persistence_cycles": cycles}


def respond(i, **kw):
    return {"kind": "RESPOND", "arrival_seq": i * 10 + 5, "acknowledged": True, "response_text": "ok", "corrective_action": "crew", **kw}


RECOVERY = [observe(1, .42), observe(2, .42), observe(3, .6, .2, 36.0, 60.0), respond(3), respond(3, arrival_seq=36),
            observe(4, .55, 2.3, 36.0, 55.0, 3), observe(5, .42, 11.5, 0.0, 20.0, 3)]
ESCALATION = [observe(i, p, 0.0, d, 50.0, c) for i, p, d, c in (
    (1, .42, 0, None), (2, .42, 0, None), (3, .42, 2, None), (4, .60, 36, 4), (5, .61, 38, 4), (6, .62, 42, 4), (7, .63, 48, 4))]
ESCALATION = [{**e, "project_id": "B", "deviation": float(e["deviation"])} for e in ESCALATION]


def outcomes(df):
    return {k: [r["outcome"] for r in df.where(F.col("project_id") == k).orderBy("arrival_seq").collect()] for k in ("A", "B")}


WANT = {
    "A": ["NONE", "NONE", "ISSUED", "RESPONSE_ACCEPTED", "RESPONSE_REJECTED", "PERSISTENT_DETERIORATION", "RECOVERED"],
    "B": ["NONE", "NONE", "NONE", "ISSUED", "PERSISTENT_DETERIORATION", "PERSISTENT_DETERIORATION", "ESCALATED"],
}


def test_scenarios_in_batch(spark):
    out = G.run_governance(events(spark, RECOVERY + ESCALATION))
    assert outcomes(out) == WANT
    assert G.escalations(out).first()["response_status"] == "UNRESPONSIVE"
    types = [r["event_type"] for r in G.audit_ledger(out).where("project_id = 'B' and arrival_seq = 70").orderBy("seq").collect()]
    assert types[-2:] == ["PERSISTENT_DETERIORATION_DETECTED", "AUTHORITY_ESCALATION_ISSUED"]


def test_no_evidence_changes_nothing(spark):
    rows = [observe(1, .6), {**observe(2, .3), "velocity": None, "deviation": None, "score": None}]
    out = G.run_governance(events(spark, rows)).orderBy("arrival_seq").collect()
    assert out[1]["recovery_status"] == "INSUFFICIENT_EVIDENCE" and out[1]["warning_status"] == "ISSUED"


def test_stream_over_several_triggers_equals_batch(spark):
    rows = RECOVERY + ESCALATION
    src = fresh_path(spark, "events")
    for part in sorted({r["arrival_seq"] for r in rows}):
        events(spark, [r for r in rows if r["arrival_seq"] == part]).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(MONITOR_EVENT).option("maxFilesPerTrigger", 3).parquet(src)
    out = fresh_path(spark, "out")
    S.drain(stream, lambda df, i: S.govern(df, i, out), fresh_path(spark, "cp"))
    got = Committed(spark, out).read("outcomes").select(*G.run_governance(events(spark, rows)).columns)
    want = G.run_governance(events(spark, rows))
    assert outcomes(got) == WANT
    assert got.exceptAll(want).count() == 0


def random_events(rnd, n=60, entities="ABCD"):
    rows = []
    for e in entities:
        seq = 0
        for month in range(1, 13):
            seq += 1
            rows.append({"project_id": e, "arrival_seq": seq, "reporting_month": f"2024-{month:02d}", "risk": rnd.choice([.3, .45, .55, .7]),
                         "velocity": rnd.choice([None, -1.0, 0.5, 2.0]), "deviation": rnd.choice([None, 0.0, 5.0]), "score": rnd.choice([None, 10.0, 60.0]),
                         "persistence_cycles": rnd.choice([None, 3])})
            for _ in range(rnd.choice([0, 0, 1, 3])):
                seq += 1
                rows.append({"kind": "RESPOND", "project_id": e, "arrival_seq": seq, "acknowledged": rnd.choice([True, True, False, None]),
                             "response_text": rnd.choice(["ok", "ok", " ", None]), "corrective_action": "crew", "named": rnd.choice([None, month, 1, 99])})
    return rows


def test_only_responses_that_may_count_reach_the_fold(spark):
    import random

    rnd = random.Random(5)
    rows = random_events(rnd)
    plain = events(spark, [{k: v for k, v in r.items() if k != "named"} for r in rows])
    names = spark.createDataFrame([(r["project_id"], r["arrival_seq"], f"2024-{r['named']:02d}") for r in rows if r.get("named")], "project_id string, arrival_seq long, m string")
    named = plain.drop("warning_id").join(names, ["project_id", "arrival_seq"], "left").withColumn(
        "warning_id", F.when(F.col("m").isNotNull(), G.stable_id("WARN", F.col("project_id"), F.col("m")))).select(*plain.columns)
    want = G.folded(named).select("project_id", F.inline("out"))  # the fold over everything
    got = G.run_governance(named)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert got.where("outcome = 'RESPONSE_ACCEPTED'").count() > 0 and got.where("outcome = 'RESPONSE_REJECTED'").count() > 5
    # the same over triggers, where responses may come without observations of their own
    src, out = fresh_path(spark, "events"), fresh_path(spark, "out")
    for low in range(0, 60, 7):
        named.where((F.col("arrival_seq") > low) & (F.col("arrival_seq") <= low + 7)).coalesce(1).write.mode("append").parquet(src)
    S.drain(spark.readStream.schema(named.schema).option("maxFilesPerTrigger", 1).parquet(src), lambda df, i: S.govern(df, i, out), fresh_path(spark, "cp"))
    live = Committed(spark, out).read("outcomes").select(*want.columns)
    assert live.exceptAll(want).count() == 0 and want.exceptAll(live).count() == 0


def test_very_many_responses_of_one_entity(spark):
    n = 100_000
    few = events(spark, [observe(1, .6), observe(2, .6, cycles=9), observe(3, .6, cycles=9)])
    many = spark.range(n).select(
        F.lit("RESPOND").alias("kind"), F.lit("A").alias("project_id"), (F.col("id") + 11).alias("arrival_seq"), F.lit(None).cast("string").alias("reporting_month"),
        *[F.lit(None).cast("double").alias(c) for c in ("risk", "velocity", "deviation", "score")], F.lit(None).cast("int").alias("persistence_cycles"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("WARN-"), F.col("id"))).alias("warning_id"), F.lit(True).alias("acknowledged"),
        F.lit("ok").alias("response_text"), F.lit("crew").alias("corrective_action"))
    both = few.unionByName(many.select(*few.columns))
    kept, refused = G.split_responses(both)
    assert kept.count() <= 3 + 3 and refused.count() >= n - 3
    got = {r["outcome"]: r["count"] for r in G.run_governance(both).groupBy("outcome").count().collect()}
    assert got["RESPONSE_ACCEPTED"] == 1 and got["RESPONSE_REJECTED"] == n - 1


def test_arrival_order_acceptance_matches_brute_force(spark):
    import random
    rnd = random.Random(7)
    rows = [(i, "A" if rnd.random() < .7 else "B", f"2020-{rnd.randint(1, 12):02d}", rnd.choice([1.0, 1.0, 1.0, -1.0])) for i in range(200)]
    df = spark.createDataFrame(rows, "arrival_seq long, project_id string, reporting_month string, financial_progress double").withColumns(
        {c: F.lit(None).cast("double") for c in ("physical_progress", "expenditure", "revised_cost")})
    reg = spark.createDataFrame([("A",), ("B",)], "project_id string")
    got = {r["arrival_seq"]: r["reject_reason"] for r in N.accept_in_order(N.check_observations(df, reg)).collect()}
    seen = {}
    for seq, pid, month, fin in rows:
        taken = seen.setdefault(pid, [])
        if fin < 0:
            want = "NEGATIVE_FINANCIAL_PROGRESS"
        elif month in taken:
            want = "DUPLICATE_MONTH"
        elif taken and month <= max(taken):
            want = "CHRONOLOGY_VIOLATION"
        else:
            want = None
            taken.append(month)
        assert got[seq] == want, (seq, pid, month)


def test_online_features_equal_batch(spark):
    n = 9
    rows = [("A", f"2020-{i + 1:02d}", i, None if i == 4 else 3.0 * i + (i % 3), 10.0 * i, 2.0 * i, 100.0, 90.0 + 20 * i, float(i // 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "project_id string, reporting_month string, arrival_seq int, financial_progress double, expenditure double, "
                               "physical_progress double, approved_cost double, revised_cost double, schedule_deviation double").withColumns(
        {"sector": F.lit("Power"), "original_completion_date": F.lit("2022-01"), "revised_completion_date": F.lit(None).cast("string")})
    src, out = fresh_path(spark, "obs"), fresh_path(spark, "feat")
    for a in range(0, n, 2):  # several triggers: state carries lags and the mean over
        df.where((F.col("arrival_seq") >= a) & (F.col("arrival_seq") < a + 2)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    S.drain(stream, S.monitoring(out), fresh_path(spark, "cp"))
    cols = ["reporting_month", "V_fin_1m", "V_fin_3m", "A_fin", "A_exp", "V_phys_3m", "EWMA_V_fin", "observation_number", "trajectory_risk_score"]
    got = Committed(spark, out).read("features").select(*cols).orderBy("reporting_month").collect()
    want = K.kinetics(timeline(df), peers=K.empty_peers(spark)).select(*cols).orderBy("reporting_month").collect()
    assert got == want
    # the chain goes on to governance: one outcome per accepted observation, and its ledger
    assert Committed(spark, out).read("outcomes").count() == n
    assert Committed(spark, out).read("ledger").where("event_type = 'MONTHLY_REPORT_SUBMITTED'").count() == n
    assert Committed(spark, out).read("rejects").count() == 0


def test_stream_rejects_late_and_repeated_months_over_triggers(spark):
    rows = [(1, "A", "2020-03"), (2, "A", "2020-05"), (3, "A", "2020-04"), (4, "A", "2020-03"), (5, "B", "bad"), (6, "A", "2020-05"), (7, "A", "2020-06")]
    df = spark.createDataFrame(rows, "arrival_seq int, project_id string, reporting_month string").withColumns(
        {**{c: F.lit(1.0) for c in ("financial_progress", "expenditure", "physical_progress", "approved_cost", "revised_cost", "schedule_deviation")},
         "sector": F.lit("Power")})
    src, out = fresh_path(spark, "obs"), fresh_path(spark, "rej")
    for seq, *_ in rows:
        df.where(F.col("arrival_seq") == seq).coalesce(1).write.mode("append").parquet(src)
    S.drain(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src), S.monitoring(out), fresh_path(spark, "cp"))
    got = {r["arrival_seq"]: r["reject_reason"] for r in Committed(spark, out).read("rejects").collect()}
    assert got == {3: "CHRONOLOGY_VIOLATION", 4: "DUPLICATE_MONTH", 5: "INVALID_MONTH", 6: "DUPLICATE_MONTH"}
    kept = Committed(spark, out).read("features").orderBy("reporting_month").collect()
    assert [(r["reporting_month"], r["observation_number"]) for r in kept] == [("2020-03", 1), ("2020-05", 2), ("2020-06", 3)]
