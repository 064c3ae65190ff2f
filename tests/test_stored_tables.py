"""Bucketed tables, plans without exchanges, percentiles of many columns, CUSUM."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import selection as S
from tidewatch.operators.cusum import CusumConfig, cusum
from tidewatch.operators.timeline import history
from tidewatch.sources import bucketed as B


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_join_without_an_exchange(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(4000).select(F.concat(F.lit("N"), (F.col("id") % 50).cast("string")).alias("project_id"),
                                        (F.col("id") / 50).cast("int").alias("month_idx"), F.col("id").alias("v"))
        rows = rows.withColumn("reporting_month", F.col("month_idx").cast("string"))
        left, right = B.write_bucketed(rows, "left", 8), B.write_bucketed(rows.withColumnRenamed("v", "w"), "right", 8)
        joined = B.join_bucketed(spark, left, right, ["project_id", "reporting_month"], drop=["month_idx"])
        joined.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert "SortMergeJoin" in plan(joined) and "Exchange" not in plan(joined)
        assert joined.count() == 4000 and joined.where("v <> w").count() == 0
        lagged = B.read_bucketed(spark, left).withColumn("x", F.lag("v").over(history()))
        assert "Window" in plan(lagged) and "Exchange" not in plan(lagged)
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan does not tell
        one = B.read_bucketed_entity(spark, left, "N7")
        assert "SelectedBucketsCount: 1 out of 8" in plan(one) and one.count() == 80
        files = {f.rsplit("_", 1)[1] for f in B.read_bucketed(spark, left).inputFiles()}
        assert len(B.read_bucketed(spark, left).inputFiles()) <= 8 and files
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_model_dataset_query_has_no_exchange(spark):
    from tidewatch.plans.dataset_queries import stored_dataset

    df = stored_dataset(spark, "/root/testdata/sf0.001")
    df.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert "Exchange" not in plan(df) and "SortMergeJoin" in plan(df)


def panel_tables(spark, folder):
    rng = random.Random(11)
    lines = [(i, rng.choice([None, 3, 3, 5, 9, 19, 27]), 1, i % 7, float(rng.randint(1, 50)), 100.0 * rng.randint(1, 900), 0.05, 0.0,
              rng.choice("RAN"), "O", datetime(rng.randint(1995, 2000), rng.randint(1, 12), 3)) for i in range(600)]
    spark.createDataFrame(lines, (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
        "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")).write.parquet(f"{folder}/lineitem.parquet")
    parts = [(k, f"part {k}", "Brand#1", ["PROMO", "SMALL", "MEDIUM"][k % 3], k % 9 + 1, 900.0 + k) for k in range(30)]
    spark.createDataFrame(parts, (
        "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_buckets_grow_with_the_rows(spark, tmp_path, monkeypatch):
    from tidewatch.operators.policies import with_heuristic_score
    from tidewatch.plans import dataset_queries as Q
    from tidewatch.plans.feature_queries import features, labelled_features
    from tidewatch.plans.panel import panel

    monkeypatch.setattr(B, "BUCKET_ROWS", 60)
    sf = panel_tables(spark, tmp_path)
    tables = [Q.scored_table(spark, sf), Q.feature_table(spark, sf)]
    for name in tables:  # 600 rows of input; shuffles have four partitions
        told = {r["col_name"]: r["data_type"] for r in spark.sql(f"describe extended {name}").collect()}
        assert told["Num Buckets"] == "10"
        assert B.read_by_bucket(spark, name).rdd.getNumPartitions() == 10
    same = lambda x, y: x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0
    assert same(Q.stored_panel(spark, sf), panel(spark, sf)) and Q.stored_panel(spark, sf).count() > 100
    exact = [c for c, t in spark.table(tables[0]).dtypes if t != "double"]
    assert same(spark.table(tables[0]).select(*exact), with_heuristic_score(labelled_features(spark, sf)).select(*exact))
    assert spark.table(tables[1]).columns == features(spark, sf).columns


def test_names_of_features_run_no_job(spark, tmp_path):
    from tidewatch.plans.dataset_queries import feature_columns

    sf = panel_tables(spark, tmp_path)
    spark.sparkContext.setJobGroup("names", "names")
    try:
        assert "EWMA_V_fin" in feature_columns(spark, sf)
        # reading a table's schema may be a job, peer statistics take a shuffle and so several stages
        tracker = spark.sparkContext.statusTracker()
        assert all(len(tracker.getJobInfo(j).stageIds) == 1 for j in tracker.getJobIdsForGroup("names"))
        assert len(tracker.getJobIdsForGroup("names")) <= 2
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("few", [0, 3, 1024])
def test_percentiles_of_columns(spark, monkeypatch, few):
    monkeypatch.setattr(S, "FEW", few)
    rng = random.Random(3)
    makers = {
        "normal": lambda i: rng.gauss(0, 1), "ties": lambda i: float(rng.choice([-1, 0, 0, 0, 7])), "close": lambda i: 1 + rng.random() * 1e-12,
        "odd": lambda i: rng.choice([0.0, -0.0, 1e-320, -1e308, INF, -INF, 5.0]), "some": lambda i: None if i % 3 else float(i), "none": lambda i: None,
        "one": lambda i: 4.5 if i == 9 else None, "whole": lambda i: float(rng.randint(-10**15, 10**15)),
    }
    rows = [tuple(f(i) for f in makers.values()) for i in range(700)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in makers)).repartition(5)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["feature"]: tuple(r)[1:] for r in S.column_percentiles(df, list(makers), probs).collect()}
    for at, c in enumerate(makers):
        v = np.sort(np.array([r[at] for r in rows if r[at] is not None], float))
        if not len(v):
            assert got[c] == (None,) * 5
            continue
        for p, x in zip(probs, got[c], strict=True):
            k = (len(v) - 1) * p
            low, high = v[int(np.floor(k))], v[int(np.ceil(k))]
            want = low if low == high else low + (high - low) * (k - np.floor(k))
            if np.isfinite(want):
                assert x == want, (c, p)
    moments = {r["feature"]: r for r in S.column_moments(df, list(makers)).collect()}
    assert moments["some"]["present"] == 234 and moments["some"]["row_count"] == 700 and moments["none"]["mean"] is None


def test_ordered_bits_keep_order_and_come_back():
    v = np.array([-INF, -1e308, -1.5, -1e-320, 0.0, 1e-320, 1.0, 1.0000000000000002, INF, NAN])
    k = S.ordered_bits(v)
    assert (np.diff(k.astype(object)) > 0).all()
    assert [S.from_bits(int(x)) for x in k[:-1]] == v[:-1].tolist() and np.isnan(S.from_bits(int(k[-1])))
    assert S.ordered_bits(np.array([-0.0]))[0] == S.ordered_bits(np.array([0.0]))[0]


def test_percentiles_write_nothing_and_do_not_unpivot(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    df.write.parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    import os

    before = sum(len(fs) for _, _, fs in os.walk(folder))
    assert S.column_percentiles(stored, ["a", "b"], [0.5]).collect()[0]["p0"] == 499.5
    assert sum(len(fs) for _, _, fs in os.walk(folder)) == before
    assert "Expand" not in plan(S.column_moments(stored, ["a", "b"])) and "Generate" in plan(S.column_moments(stored, ["a", "b"]))


def brute_cusum(months, cfg):
    """months: (month, gap since the last, velocity), in order."""
    up = down = segment = 0
    past, out, alarm = [], [], None
    for k, (m, gap, v) in enumerate(months):
        step = None
        if v is not None and len(past) >= cfg.warmup:
            step = int(np.floor((round(v * 100) * len(past) - sum(past)) * 100 / len(past)))
        if k and (alarm or (gap or 0) > cfg.max_gap):
            up = down = 0
            segment += 1
        if step is not None:
            up, down = max(0, up + step - round(cfg.slack * 10000)), max(0, down - step - round(cfg.slack * 10000))
        alarm = "UP" if up > cfg.limit * 10000 else "DOWN" if down > cfg.limit * 10000 else None
        out.append((m, step, up, down, alarm, segment))
        if v is not None:
            past.append(round(v * 100))
    return out


def test_cusum_against_its_definition(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for e in range(40):
        m, seq = 24000, []
        level = rng.choice([0, 1, 3])
        for k in range(rng.choice([1, 2, 6, 40])):
            gap = rng.choice([1, 1, 1, 2, 9]) if k else None
            m += gap or 0
            v = None if rng.random() < 0.15 else round(rng.gauss(level if k < 20 else -level, 1.5), 2)
            seq.append((m, gap, v))
            rows.append((f"E{e}", str(m), m, None if gap is None else float(gap), v))
        want[f"E{e}"] = seq
    df = spark.createDataFrame(rows, "project_id string, reporting_month string, month_idx int, months_since_previous_observation double, V_fin_1m double").repartition(4)
    for cfg in (CusumConfig(), CusumConfig(0.1, 0.4, 1, 3), CusumConfig(0.5, 1000.0)):
        got = {}
        for r in cusum(df, cfg).orderBy("project_id", "month_idx").collect():
            got.setdefault(r["project_id"], []).append((r["month_idx"], r["cusum_step"], r["cusum_up"], r["cusum_down"], r["cusum_alarm"], r["cusum_segment"]))
        assert got == {e: brute_cusum(seq, cfg) for e, seq in want.items()}
    assert any(x[4] for v in got.values() for x in v) is False
    assert cusum(df.limit(0)).collect() == []
