"""Whole batches, bucketed state, tombstones, compaction; expiry and late rows in the stream."""

import os

import pytest
from pyspark.sql import functions as F

from tidewatch.session import fresh_path
from tidewatch.streaming import governance as G
from tidewatch.streaming import live as S
from tidewatch.streaming.committed import Committed, bucket

from test_monitoring import RECOVERY, events

STATE = "project_id string, n long"


def entities(spark, ids, n):
    return spark.range(1).select(F.explode(F.array(*[F.lit(i) for i in ids])).alias("project_id"), F.lit(n).cast("long").alias("n"))


def files(root):
    """Parquet files under a folder with their sizes."""
    base = root.removeprefix("file:")
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(base) for f in fs if f.endswith(".parquet")}


def run(tables, number, state_rows, log_rows, fail=False):
    b = tables.batch(number)
    if b is None:
        return False
    touched = b.touched(state_rows)
    before = b.state("state", touched, STATE)
    b.put(log_rows, "log")
    if fail:
        raise RuntimeError("lost between two tables")
    b.put_state(S._carry_on(before, state_rows), "state", touched)
    b.commit()
    return True


def test_readers_see_whole_batches_and_a_retry_counts_once(spark):
    root = fresh_path(spark, "tables")
    tables = Committed(spark, root, 4)
    with pytest.raises(ValueError):
        tables.read("log")
    assert run(tables, 0, entities(spark, "abc", 1), entities(spark, "abc", 1))
    with pytest.raises(RuntimeError):
        run(tables, 1, entities(spark, "bd", 2), entities(spark, "bd", 2), fail=True)
    again = Committed(spark, root)  # another process after the loss
    assert again.buckets == 4
    assert sorted(r["project_id"] for r in again.read("log").collect()) == list("abc")
    assert {tuple(r) for r in again.state("state", STATE).collect()} == {("a", 1), ("b", 1), ("c", 1)}
    assert run(again, 1, entities(spark, "bd", 2), entities(spark, "bd", 2))
    assert not run(again, 1, entities(spark, "bd", 2), entities(spark, "bd", 2))  # comes again after its record
    assert sorted(tuple(r) for r in again.read("log").collect()) == [("a", 1), ("b", 1), ("b", 2), ("c", 1), ("d", 2)]
    assert {tuple(r) for r in again.state("state", STATE).collect()} == {("a", 1), ("b", 2), ("c", 1), ("d", 2)}
    gone = again.vacuum()  # the failed attempt's folder
    assert any(g.startswith("log/") for g in gone) and again.read("log").count() == 5


def test_governance_batch_lost_between_outcomes_and_ledger(spark, monkeypatch):
    out = fresh_path(spark, "gov")
    df = events(spark, RECOVERY)
    whole = G.audit_ledger

    def lost(outcomes):
        raise RuntimeError("lost")

    monkeypatch.setattr(G, "audit_ledger", lost)
    with pytest.raises(RuntimeError):
        S.govern(df, 0, out)
    for table in ("outcomes", "ledger"):
        with pytest.raises(ValueError):
            Committed(spark, out).read(table)
    monkeypatch.setattr(G, "audit_ledger", whole)
    S.govern(df, 0, out)
    S.govern(df, 0, out)
    tables = Committed(spark, out)
    assert tables.read("outcomes").count() == len(RECOVERY)
    assert tables.read("ledger").count() == whole(G.run_governance(df)).count()


def test_a_batch_writes_only_the_buckets_it_touches(spark):
    root = fresh_path(spark, "tables")
    tables = Committed(spark, root, 64)
    many = spark.range(100_000).select(F.col("id").cast("string").alias("project_id"), F.lit(1).cast("long").alias("n"))
    run(tables, 0, many, many.limit(1))
    before = files(root)
    few = many.where("cast(project_id as int) < 10").withColumn("n", F.lit(2).cast("long"))
    touched = {r[0] for r in few.select(bucket(64)).distinct().collect()}
    run(tables, 1, few, few)
    new = {k: v for k, v in files(root).items() if k not in before and "/state/" in k}
    assert all(before[k] == files(root)[k] for k in before)
    assert {int(k.split("_bucket=")[1].split("/")[0]) for k in new} == touched and len(touched) <= 10
    old = sum(v for k, v in before.items() if "/state/" in k)
    assert sum(new.values()) < old * (len(touched) + 1) / 64
    assert tables.state("state", STATE).where("n = 2").count() == 10 and tables.state("state", STATE).count() == 100_000
    # reading one bucket opens that bucket's files only
    b = tables.batch(2)
    names = b.state("state", [sorted(touched)[0]], STATE).inputFiles()
    assert names and all(f"_bucket={sorted(touched)[0]}/" in n for n in names)


def test_reset_hides_an_entity_from_all_tables_until_it_reports_again(spark):
    root = fresh_path(spark, "tables")
    tables = Committed(spark, root, 4)
    run(tables, 0, entities(spark, "abc", 1), entities(spark, "abc", 1))
    before = files(root)
    tables.reset(["b"])
    assert files(root) == before  # no table file changes
    assert sorted(r["project_id"] for r in tables.read("log").collect()) == ["a", "c"]
    assert sorted(r["project_id"] for r in tables.state("state", STATE).collect()) == ["a", "c"]
    run(tables, 1, entities(spark, "b", 7), entities(spark, "b", 7))
    tables.reset(["a", "nobody"])
    want = [("b", 7), ("c", 1)]
    assert sorted(tuple(r) for r in tables.read("log").collect()) == want
    tables.compact()
    assert not tables.view().tombstones and len(tables.view().rows["log"]) == 1
    assert sorted(tuple(r) for r in tables.read("log").collect()) == want
    assert sorted(tuple(r) for r in tables.state("state", STATE).collect()) == want
    tables.vacuum()
    assert sorted(tuple(r) for r in tables.read("log").collect()) == want
    assert sorted(tuple(r) for r in tables.state("state", STATE).collect()) == want
    assert not run(tables, 1, entities(spark, "z", 1), entities(spark, "z", 1))  # batches are still known
    assert spark.read.parquet(f"{root}/{tables.view().rows['log'][0][1]}").where("project_id = 'a'").count() == 0


def reports(spark, rows):
    return spark.createDataFrame(rows, "arrival_seq int, project_id string, reporting_month string").withColumns(
        {**{c: F.lit(1.0) for c in ("financial_progress", "expenditure", "physical_progress", "approved_cost", "revised_cost", "schedule_deviation")},
         "sector": F.lit("Power")})


BATCHES = [
    [(1, "A", "2020-01"), (2, "B", "2020-01")],
    [(3, "A", "2020-08")],
    [(4, "B", "2020-07"), (5, "C", "2020-01")],  # newest 2020-08: before 2020-02 is too late; B has expired
    [(6, "A", "2020-08"), (7, "D", "2021-06")],
    [(8, "B", "2020-11"), (9, "A", "2020-12"), (10, "C", "2021-01")],  # before 2020-12 is too late
]


def test_idle_entities_expire_and_late_rows_are_refused(spark):
    def results(out):
        tables = Committed(spark, out)
        pick = lambda t, *c: sorted(tuple(r) for r in tables.read(t).select(*c).collect())
        return (pick("expired", "project_id", "last_month", "horizon_month"), pick("rejects", "arrival_seq", "reject_reason"),
                pick("features", "project_id", "reporting_month", "observation_number"), pick("outcomes", "project_id", "reporting_month"))

    want = (
        [("A", "2020-08", "2020-12"), ("B", "2020-01", "2020-02"), ("B", "2020-07", "2020-12")],
        [(5, "TOO_LATE"), (6, "DUPLICATE_MONTH"), (8, "TOO_LATE")],
        # who comes back after expiry starts anew
        [("A", "2020-01", 1), ("A", "2020-08", 2), ("A", "2020-12", 1), ("B", "2020-01", 1), ("B", "2020-07", 1), ("C", "2021-01", 1), ("D", "2021-06", 1)],
        [("A", "2020-01"), ("A", "2020-08"), ("A", "2020-12"), ("B", "2020-01"), ("B", "2020-07"), ("C", "2021-01"), ("D", "2021-06")])
    for restart in (False, True):
        src, out, mark = fresh_path(spark, "obs"), fresh_path(spark, "out"), fresh_path(spark, "cp")
        handle = S.monitoring(out, expiry=S.Expiry(6), buckets=3)
        for rows in BATCHES:
            reports(spark, rows).coalesce(1).write.mode("append").parquet(src)
            if restart:
                S.drain(spark.readStream.schema(reports(spark, rows).schema).parquet(src), handle, mark)
        S.drain(spark.readStream.schema(reports(spark, BATCHES[0]).schema).option("maxFilesPerTrigger", 1).parquet(src), handle, mark)
        assert results(out) == want
        alive = {r["project_id"] for r in Committed(spark, out).state("feature_state", "project_id string, months array<string>, n int").collect()}
        assert alive == {"A", "C", "D"}


def test_reset_in_the_stream(spark):
    src, out, mark = fresh_path(spark, "obs"), fresh_path(spark, "out"), fresh_path(spark, "cp")
    schema = reports(spark, BATCHES[0]).schema

    def go(rows):
        reports(spark, rows).coalesce(1).write.mode("append").parquet(src)
        S.drain(spark.readStream.schema(schema).parquet(src), S.monitoring(out), mark)

    go([(1, "A", "2020-03"), (2, "B", "2020-03"), (3, "A", "bad")])
    Committed(spark, out).reset(["A"])
    tables = Committed(spark, out)
    for table in ("features", "rejects", "outcomes", "ledger"):
        assert {r["project_id"] for r in tables.read(table).select("project_id").collect()} <= {"B"}
    go([(4, "A", "2020-01"), (5, "B", "2020-03")])  # A starts from nothing, B's month is known
    got = sorted(tuple(r) for r in Committed(spark, out).read("features").select("project_id", "reporting_month", "observation_number").collect())
    assert got == [("A", "2020-01", 1), ("B", "2020-03", 1)]
    assert [r["reject_reason"] for r in Committed(spark, out).read("rejects").collect()] == ["DUPLICATE_MONTH"]
