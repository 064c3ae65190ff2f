"""Plans keep their shape; queries agree with their checking SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check_oracle import TABLES, compare
from tidewatch.functions.numbers import decimal_round
from tidewatch.functions.text import multi_field
from tidewatch.operators import kinetics as K
from tidewatch.operators.labels import with_labels
from tidewatch.operators.timeline import timeline
from tidewatch.plans.panel import panel

SF = "/root/testdata/sf0.001"
QUICK = ["timeline", "trajectory_risk_score", "targets_12m", "policy_metrics", "event_lead_times", "intervention_queue",
         "canonical_panel", "observation_intake", "macro_summary_rules", "document_month_and_family"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


NAMES = sorted(entry.queries()) if os.environ.get("CHECK_ALL") else QUICK


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    res = compare(spark, con, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert not res.startswith("FAIL"), res


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_and_labels_share_one_exchange(spark):
    p = panel(spark, SF)
    df = K.kinetics(with_labels(timeline(p)), peers=K.empty_peers(spark))
    text = plan_of(df)
    assert text.count("Exchange hashpartitioning(project_id") == 1
    assert "Python" not in text and "CartesianProduct" not in text


def test_unbroadcast_peers_cost_no_second_entity_exchange(spark):
    p = panel(spark, SF)
    peers = K.peer_statistics(K.motion(K.point_state(timeline(p), K.KineticsConfig())))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan_of(K.kinetics(with_labels(timeline(p)), peers=peers))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # one for the facts, one inside the peer statistics
    assert text.count("Exchange hashpartitioning(project_id") == 2 and "BroadcastHashJoin" not in text


def test_entity_filter_reaches_the_scan(spark, tmp_path):
    from tidewatch.sources.tables import read_entity, write_panel
    path = str(tmp_path / "panel")
    write_panel(panel(spark, SF), path)
    assert "EqualTo(project_id,N00000012)" in plan_of(read_entity(spark, path, "N00000012"))


def test_decimal_round_agrees_with_python(spark):
    vals = [749.15, 2.675, 0.125, 1.005, -2.5, 0.35, 1234567.25, 0.045, 99.995]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v double").select(decimal_round(F.col("v"), 2)).collect()]
    assert got == [round(v, 2) for v in vals]


def test_multi_field_slots(spark):
    # lines keep their brackets; the month and money normalisers strip them
    cases = [
        ("a\n(b)\n{c}", ("a", "(b)", "{c}")), ("a\nb\nc\nd", ("a", "b", "c")),
        ("[x]\n[y]\n(p)\n(q)", (None, "(q)", "[y]")), ("", (None, None, None)),
    ]
    df = spark.createDataFrame([(c,) for c, _ in cases], "c string").select(multi_field(F.col("c")).alias("m"))
    assert [tuple(r["m"]) for r in df.collect()] == [w for _, w in cases]


def test_no_shadowed_registration():
    assert set(entry.oracle_sql()) <= set(entry.queries())
