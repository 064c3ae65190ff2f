"""Structured Streaming: incremental features, rejects and live governance.

Each trigger is handled by the batch expressions themselves: the new rows are
joined with the stored state of their entities and windowed or folded in the
JVM. State lies in hash buckets, of which a trigger reads and rewrites only
those its rows fall into; outcomes, rejects, ledger and state of a trigger
count together, with one commit record, and a trigger that comes again after
its record is skipped (``committed``). The state of an entity is bounded by the
calendar: its accepted months, the last four rows, and running values. Limit
the input per trigger (``maxFilesPerTrigger``) to bound a trigger's work.

Nothing is re-ordered and no row disappears: whatever is not accepted is
written to the rejects with its reason. With an ``Expiry`` the state of an
entity goes once it has been silent for so many months behind the newest month
of earlier triggers; rows older than that are refused, as nothing is left that
could tell whether they repeat. Without one, state stays until the entity is
reset (``Committed.reset``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.config import KineticsConfig
from tidewatch.functions.dates import month_index, month_label
from tidewatch.operators.kinetics import component_scores, decayed_fold, motion, point_state, risk_score
from tidewatch.operators.policies import with_heuristic_score
from tidewatch.operators.timeline import history, with_month_index
from tidewatch.streaming import governance as G
from tidewatch.streaming.committed import Batch, Committed, bucket
from tidewatch.streaming.intake import accept_in_order, check_observations, observation_reason

OUT_SCHEMA = "project_id string, " + G.OUT_DDL[len("struct<"):-1].replace(":", " ").replace(",", ", ")
#: Rows that lags of the batch windows reach back over.
TAIL = 4
CARRIED = [
    "project_id", "reporting_month", "month_idx", "arrival_seq", "financial_progress", "expenditure_clean",
    "physical_progress_clean", "schedule_deviation_months", "completion_idx", "C_base", "cost_revision_ratio",
    "expenditure_to_baseline", "financial_physical_gap", "sector_clean", "scale_bucket",
]


@dataclass(frozen=True)
class Expiry:
    """idle_months: how far an entity's last month may lie behind the newest month of earlier triggers."""

    idle_months: int = 24

    def horizon(self, batch: Batch) -> int | None:
        """Months before this one have expired; None before anything was accepted."""
        newest = batch.notes.get("newest")
        return None if newest is None else int(newest) - self.idle_months


def _carry_on(before: DataFrame, changed: DataFrame) -> DataFrame:
    return changed.unionByName(before.join(changed.select("project_id"), "project_id", "left_anti"))


def _idle(batch: Batch, horizon: int | None) -> list[int]:
    """Buckets that hold an entity whose last month has expired; at most as many as there are buckets."""
    oldest = batch.notes.get("oldest", {})
    return [] if horizon is None else [int(b) for b, m in oldest.items() if m < horizon]


# ---- governance ----------------------------------------------------------

GOV_SCHEMA = f"project_id string, state {G.STATE_DDL}"


def _govern(events: DataFrame, batch: Batch, horizon: int | None = None) -> DataFrame:
    touched = sorted({*batch.touched(events), *_idle(batch, horizon)})
    before = batch.state("governance_state", touched, GOV_SCHEMA)
    if horizon is not None:
        before = before.where(F.coalesce(month_index(F.col("state.last_month")) >= horizon, F.lit(True)))
    kept, refused = G.split_responses(events, before)
    step = batch.keep(G.folded(kept, before), "governance")
    outcomes = batch.put(G.all_outcomes(step, refused, before), "outcomes")
    batch.put(G.audit_ledger(outcomes), "ledger")
    batch.put_state(_carry_on(before, step.select("project_id", "state")), "governance_state", touched)
    return outcomes


def govern(events: DataFrame, batch_id: int, out: str) -> None:
    """Fold one batch of events into the stored states.

    Commits ``outcomes``, ``ledger`` and ``governance_state`` under ``out``.
    """
    batch = Committed(events.sparkSession, out).batch(batch_id)
    if batch:
        _govern(events, batch)
        batch.commit()


# ---- features ------------------------------------------------------------

def _feature_state(carried: T.StructType) -> str:
    return (f"project_id string, months array<string>, n int, mean double, weight double, "
            f"tail array<{carried.simpleString()}>")


def _checked(batch: DataFrame, before: DataFrame, registry: DataFrame | None, horizon: int | None) -> DataFrame:
    """Reasons by field, by registry, by age, by the months accepted so far, then by arrival within the batch."""
    df = batch.withColumn("reject_reason", observation_reason()) if registry is None else check_observations(batch, registry)
    month, months = F.col("reporting_month"), F.col("_months")
    if horizon is not None:
        df = df.withColumn("reject_reason", F.coalesce("reject_reason", F.when(month_index(month) < horizon, F.lit("TOO_LATE"))))
    df = df.join(before.select("project_id", F.col("months").alias("_months")), "project_id", "left").withColumn(
        "reject_reason", F.coalesce("reject_reason", F.when(F.array_contains(months, month), F.lit("DUPLICATE_MONTH")).when(
            month <= F.array_max(months), F.lit("CHRONOLOGY_VIOLATION")))).drop("_months")
    return accept_in_order(df)


def _note_months(batch: Batch, state: DataFrame, touched: list[int]) -> None:
    """The newest month of all, and the oldest last month of each touched bucket: a row per bucket."""
    last = month_index(F.array_max("months"))
    found = state.groupBy(bucket(batch.tables.buckets).alias("b")).agg(F.min(last).alias("low"), F.max(last).alias("high")).collect()
    oldest = {b: m for b, m in batch.notes.get("oldest", {}).items() if int(b) not in touched}
    batch.notes["oldest"] = oldest | {str(r["b"]): r["low"] for r in found if r["low"] is not None}
    highs = [r["high"] for r in found if r["high"] is not None] + [batch.notes.get("newest")]
    batch.notes["newest"] = max((h for h in highs if h is not None), default=None)


def _featurise(
    arrived: DataFrame, batch: Batch, registry: DataFrame | None, cfg: KineticsConfig, horizon: int | None,
) -> DataFrame:
    months = with_month_index(arrived.limit(0))
    carried = point_state(months, cfg).select(*CARRIED[1:]).schema
    touched = sorted({*batch.touched(arrived), *_idle(batch, horizon)})
    before = batch.state("feature_state", touched, _feature_state(carried))
    if horizon is not None:
        last = month_index(F.array_max("months"))
        batch.put(before.where(last < horizon).select(
            "project_id", F.array_max("months").alias("last_month"), month_label(F.lit(horizon)).alias("horizon_month")), "expired")
        before = before.where(last >= horizon)
    checked = batch.keep(_checked(arrived, before, registry, horizon), "checked")
    batch.put(checked.where("reject_reason is not null"), "rejects")
    fresh = point_state(with_month_index(checked.where("reject_reason is null")), cfg).select(*CARRIED, F.lit(True).alias("fresh"))
    old = before.join(fresh.select("project_id").distinct(), "project_id").select(
        "project_id", F.inline("tail"), F.lit(False).alias("fresh"))
    moved = motion(old.unionByName(fresh)).withColumn(
        "months_since_previous_observation", (F.col("month_idx") - F.lag("month_idx").over(history())).cast("double"))
    packed = moved.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct(
        "month_idx", *[c for c in moved.columns if c not in ("project_id", "month_idx")]))).alias("rows"))
    known = packed.join(before.withColumnsRenamed({"tail": "_tail"}), "project_id", "left").withColumns({
        "n": F.coalesce("n", F.lit(0)), "weight": F.coalesce("weight", F.lit(1.0)),
        "rows": F.filter("rows", lambda r: r["fresh"]),
        "last": F.slice(F.reverse("rows"), 1, TAIL)})
    fold = known.withColumn("fold", decayed_fold(F.col("rows.V_fin_1m"), cfg.ewma_alpha, F.col("mean"), F.col("weight")))
    tail = F.transform(F.reverse("last"), lambda r: F.struct(*[r[c].alias(c) for c in CARRIED[1:]]))
    step = batch.keep(fold.select(
        "project_id", "rows", F.col("fold.out").alias("means"), F.col("n").alias("seen"),
        F.concat(F.coalesce("months", F.array().cast("array<string>")), F.col("rows.reporting_month")).alias("months"),
        (F.col("n") + F.size("rows")).alias("n"), F.col("fold.mean").alias("mean"), F.col("fold.weight").alias("weight"),
        tail.alias("tail")), "features")
    each = step.select("project_id", "means", "seen", F.posexplode("rows").alias("at", "row"))
    features = each.select("project_id", "row.*", F.get("means", F.col("at")).alias("EWMA_V_fin"),
                           (F.col("seen") + F.col("at") + 1).alias("observation_number")).drop("fresh").withColumns({
        "Z_peer_V_fin": F.lit(0.0),
        "reporting_gap_flag": F.when(F.col("months_since_previous_observation") > 1, 1).otherwise(0)})
    scored = features.withColumns(component_scores()).withColumn("trajectory_risk_score", risk_score(cfg))
    got = batch.put(scored, "features")
    batch.put_state(_carry_on(before, step.select("project_id", "months", "n", "mean", "weight", "tail")), "feature_state", touched)
    _note_months(batch, _carry_on(before, step.select(*before.columns)), touched)
    return got


def featurise(
    arrived: DataFrame, batch_id: int, out: str, registry: DataFrame | None = None, cfg: KineticsConfig = KineticsConfig(),
    expiry: Expiry | None = None,
) -> None:
    """Accept, reject and featurise one batch.

    Row-level expressions, lags, the exponential mean and the scores are the
    batch ones, run over the stored tail and the new rows. There are no peers
    here, so the z-score is 0. Commits ``features``, ``rejects``, ``expired``
    (with an expiry) and ``feature_state`` under ``out``.
    """
    batch = Committed(arrived.sparkSession, out).batch(batch_id)
    if batch:
        _featurise(arrived, batch, registry, cfg, expiry.horizon(batch) if expiry else None)
        batch.commit()


# ---- running -------------------------------------------------------------

def observed_events(features: DataFrame) -> DataFrame:
    """Governance events of newly scored rows."""
    scored = with_heuristic_score(features)
    none: Callable[[str], Column] = lambda t: F.lit(None).cast(t)
    return scored.select(
        F.lit("OBSERVE").alias("kind"), "project_id", F.col("arrival_seq").cast("long").alias("arrival_seq"), "reporting_month",
        F.col("p").alias("risk"), F.col("V_fin_1m").alias("velocity"), F.col("schedule_deviation_months").alias("deviation"),
        F.col("trajectory_risk_score").alias("score"), none("int").alias("persistence_cycles"), none("string").alias("warning_id"),
        none("boolean").alias("acknowledged"), none("string").alias("response_text"), none("string").alias("corrective_action"))


def monitoring(out: str, registry: DataFrame | None = None, cfg: KineticsConfig = KineticsConfig(), expiry: Expiry | None = None,
               buckets: int = 32):
    """The whole path of an observation: intake, features, score, governance, ledger; one commit record a batch."""

    def handle(arrived: DataFrame, batch_id: int) -> None:
        batch = Committed(arrived.sparkSession, out, buckets).batch(batch_id)
        if batch:
            horizon = expiry.horizon(batch) if expiry else None
            idle = dict(batch.notes)
            features = _featurise(arrived, batch, registry, cfg, horizon)
            after, batch.notes = batch.notes, idle  # the same buckets have idle entities
            _govern(observed_events(features), batch, horizon)
            batch.notes = after
            batch.commit()

    return handle


def drain(stream: DataFrame, handle: Callable[[DataFrame, int], object], checkpoint: str) -> None:
    """Process everything available, batch by batch, and stop."""
    q = (
        stream.writeStream.foreachBatch(lambda df, i: (handle(df, i), None)[1]).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())
    q.awaitTermination()
