"""Rows that must not vanish, checks that cannot be pruned, single rules, and the learned model."""

import json

import pytest
from pyspark.sql import functions as F
from test_features import frame, months

from tidewatch.config import GbdtConfig
from tidewatch.functions.documents import detect_reporting_month
from tidewatch.operators import dataset as D
from tidewatch.operators import kinetics as K
from tidewatch.operators import labels as G
from tidewatch.operators import leadtime as L
from tidewatch.operators import model as M
from tidewatch.operators import portfolio as P
from tidewatch.operators import replay as R
from tidewatch.operators.policies import with_heuristic_score
from tidewatch.operators.timeline import timeline
from tidewatch.session import fresh_path
from tidewatch.sources.reports import with_raw_ids
from tidewatch.sources.tables import json_safe, manifest, verify_manifest, write_metrics


@pytest.fixture(scope="module")
def sparse(spark):
    """P1 reports fully but for an empty last month; P2 has one report with nothing in it."""
    full = months(2020, 8, financial_progress=[5.0 * i for i in range(7)] + [None], approved_cost=100.0, expenditure=10.0, sector="Power")
    full[-1] |= {"approved_cost": None, "expenditure": None}
    one = {"project_id": "P2", "reporting_month": "2020-03", "sector": "Coal"}
    return with_heuristic_score(K.kinetics(timeline(frame(spark, [*full, one]).withColumn("project_name", F.col("project_id")))))


def test_unscored_rows_stay_in_every_view(sparse):
    assert sparse.count() == 9
    blank = sparse.where("trajectory_risk_score is null").collect()
    assert ("P2", "2020-03") in {(r["project_id"], r["reporting_month"]) for r in blank}
    assert all(r["p"] is None and r["risk_tier"] == "NORMAL" and r["alert"] is False for r in blank)
    last = {r["project_id"]: r["reporting_month"] for r in P.latest_rows(sparse).collect()}
    assert last == {"P1": "2020-08", "P2": "2020-03"}
    docs = {r["project_id"]: r["total_observations"] for r in R.replay(sparse).collect()}
    assert docs == {"P1": 8, "P2": 1}
    assert L.with_first_event(sparse).count() == 9
    assert {r["project_id"] for r in P.score_snapshot(P.latest_rows(sparse)).collect()} == {"P1", "P2"}


@pytest.mark.parametrize("last", ["2020-05", "no month"])
def test_bad_months_fail_whatever_is_selected(spark, last):
    rows = months(2020, 5, financial_progress=1.0, approved_cost=10.0)
    rows.append({"project_id": "P1", "reporting_month": last, "approved_cost": 10.0})
    df = frame(spark, rows)
    for out in (timeline(df).select("observation_number"), timeline(df).select("project_age_months"), G.targets(df),
                G.targets(df).select("eligible_features"), D.model_dataset(timeline(df), G.targets(df), verify=False)):
        with pytest.raises(Exception, match="month repeats or cannot be read"):
            out.collect()


@pytest.mark.parametrize("name, text, want", [
    ("report.pdf", "Central Sector (as on April 2010) Projects status March 2012", "2012-03"),
    ("report.pdf", "Central Sector\n(as on April 2010) Projects status March 2012", "2010-04"),
    ("report.pdf", "Flash Report dated June 2011 for May 2011", "2011-06"),
    ("FR_JULY_2010.pdf", "March 2012", "2010-07"),
])
def test_reporting_month_of_text(spark, name, text, want):
    df = spark.createDataFrame([(name, text)], "f string, t string")
    assert df.select(detect_reporting_month(F.col("f"), F.col("t")).alias("m")).first()["m"] == want


def test_json_is_finite_at_every_depth(spark):
    df = spark.sql("""select named_struct('a', double('NaN'), 'b', 'x', 'c', named_struct('d', float('Infinity'))) s,
        array(1.0D, double('-Infinity'), null) r, map('k', double('NaN'), 'l', 2.0D) m, double('NaN') d,
        cast(null as struct<a:double>) n""")
    row = json.loads(json_safe(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first()["j"])
    assert row == {"s": {"a": None, "b": "x", "c": {"d": None}}, "r": [1.0, None, None], "m": {"k": None, "l": 2.0}, "d": None, "n": None}


CFG = GbdtConfig(trees=6, max_depth=3, min_leaf=5)


@pytest.fixture(scope="module")
def learned(spark):
    rows = spark.range(600).select(
        F.concat(F.lit("P"), F.col("id") % 60).alias("project_id"), F.lit("2020-01").alias("reporting_month"),
        F.col("id").cast("int").alias("month_idx"),
        *[((F.col("id") * (7 + 2 * i)) % 101 / 10.0).cast("double").alias(c) for i, c in enumerate(M.NUMERIC_FEATURES[:-1])],
        F.when(F.col("id") % 9 == 0, None).otherwise(F.col("id") % 13 * 10.0).alias("C_base"),
        F.element_at(F.array(F.lit("Power"), F.lit("Coal"), F.lit("Road")), (F.col("id") % 3 + 1).cast("int")).alias("sector_clean"),
        F.lit("MAJOR").alias("scale_bucket"))
    label = ((F.col("V_fin_1m") > 5) | ((F.col("sector_clean") == "Coal") & (F.col("id") % 5 > 1))).cast("double")
    rows = spark.range(600).select("id").join(rows.withColumn("id", F.col("month_idx").cast("long")), "id").withColumn(M.LABEL, label)
    train, val = rows.where("id < 400"), rows.where("id >= 400")
    return M.fit_gbdt(train, val, cfg=CFG), val


def test_contributions_add_up_to_the_margin(learned):
    model, val = learned
    got = M.with_contributions(M.score(val, model), model)
    # the margin is half the log odds of the probability
    worst = got.select(F.max(F.abs(1.0 / (1.0 + F.exp(-2.0 * F.col("margin"))) - F.col("raw_prob"))).alias("e")).first()["e"]
    assert worst < 1e-9


def test_one_row_scores_as_in_the_batch_and_unseen_categories_score(learned):
    model, val = learned
    batch = {r["id"]: r["raw_prob"] for r in M.score(val, model).select("id", "raw_prob").collect()}
    for i in (401, 450, 599):
        assert M.score(val.where(F.col("id") == i), model).first()["raw_prob"] == batch[i]
    strange = M.score(val.withColumn("sector_clean", F.lit("Lighthouses")), model)
    assert strange.where("raw_prob is null or raw_prob < 0 or raw_prob > 1").count() == 0


@pytest.mark.parametrize("kind", ["platt", "isotonic"])
def test_calibration_keeps_mean_order_and_digits(learned, kind):
    model, val = learned
    scored = M.score(val, model)
    out = M.calibrate(scored, kind).apply(scored)
    err = lambda c: out.select(F.avg((F.col(c) - F.col(M.LABEL)) ** 2).alias("e")).first()["e"]
    mean = out.select(F.avg("p"), F.avg(M.LABEL)).first()
    assert abs(mean[0] - mean[1]) < 0.02
    if kind == "isotonic":
        assert err("p") <= err("raw_prob") + 1e-6
    assert out.where("p < 0 or p > 1").count() == 0
    if kind == "platt":
        assert out.where("abs(p * 10000 - rint(p * 10000)) > 1e-6").count() > 0
    # order is kept
    assert out.select(F.corr("p", "raw_prob")).first()[0] > 0.8


def test_replay_of_one_entity_equals_its_document(sparse):
    one = R.replay_one(sparse, "P1").first()
    assert one == R.replay(sparse).where("project_id = 'P1'").first()
    with pytest.raises(ValueError, match="unknown project_id"):
        R.replay_one(sparse, "nobody")


def test_metrics_carry_the_manifest_of_their_data(spark):
    data = spark.range(20).withColumn("x", F.col("id") * 2)
    path = fresh_path(spark, "metrics")
    write_metrics(spark.createDataFrame([(0.5,)], "pr_auc double"), data, path, cutoff="2020-01")
    meta = spark.read.json(path).first()["_metadata"].asDict()
    assert meta["row_count"] == 20 and meta["cutoff"] == "2020-01"
    verify_manifest(data.repartition(3), manifest(data).first().asDict())
    with pytest.raises(ValueError, match="does not match"):
        verify_manifest(data.where("id > 0"), manifest(data).first().asDict())
    with pytest.raises(ValueError, match="lacks"):
        verify_manifest(data, {"row_count": 20})


def test_raw_ids_follow_document_order(spark):
    rows = [(f"d{i % 3}", i % 5, i) for i in range(60)]
    df = spark.createDataFrame(rows, "source_pdf string, source_page int, row_no int").repartition(4)
    got = with_raw_ids(df).orderBy("raw_record_id").collect()
    keys = [(r["source_pdf"], r["source_page"], r["row_no"]) for r in got]
    assert keys == sorted(keys) and len({r["raw_record_id"] for r in got}) == 60
