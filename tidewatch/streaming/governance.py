"""Warning, response, recovery and escalation, entity by entity.

The state machine cannot be expressed as a window (its state depends on its own
decisions), so each entity's events are folded in arrival order. Accepted
observations are unique per month and responses are reduced to those that may
be accepted before the fold, which bounds the array an entity needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import ESCALATE, PERSISTENCE_CYCLES, RESPONSE_DAYS
from tidewatch.functions.binding import let
from tidewatch.functions.numbers import is_true
from tidewatch.operators.policies import risk_tier

STATE_DDL = (
    "struct<active:boolean,warning_id:string,warning_month:string,warning_status:string,w_risk:double,"
    "w_velocity:double,w_deviation:double,w_score:double,cycles:int,responded:boolean,project_status:string,last_month:string>")
OUT_DDL = (
    "struct<kind:string,arrival_seq:bigint,reporting_month:string,risk:double,outcome:string,action:string,"
    "recovery_status:string,warning_id:string,warning_status:string,project_status:string,cycles:int,"
    "required_cycles:int,response_status:string,w_risk:double>")

ISSUED, RECOVERED, PERSISTENT, ESCALATED = "ISSUED", "RECOVERED", "PERSISTENT_DETERIORATION", "ESCALATED"


#: Observations that intake should have refused; they change no state.
REFUSED = ("DUPLICATE_MONTH", "CHRONOLOGY_VIOLATION")


def stable_id(prefix: str, *parts: Column) -> Column:
    """Same input, same id: replays never mint a second record."""
    return F.concat(F.lit(prefix + "-"), F.upper(F.sha2(F.concat_ws("|", *parts), 256)))


def observation_outcome(s: Column, x: Column) -> Column:
    improved = (
        is_true((x["velocity"] > 0) & (s["w_velocity"].isNull() | (x["velocity"] > s["w_velocity"])))
        | is_true(x["deviation"] <= s["w_deviation"])
        | is_true(x["score"] < s["w_score"]))
    blind = x["velocity"].isNull() & x["deviation"].isNull() & x["score"].isNull()
    calm = ~is_true(x["risk"] >= ESCALATE)
    cycles = s["cycles"] + F.when(calm, 0).otherwise(1)
    return (
        F.when(x["reporting_month"] == s["last_month"], F.lit("DUPLICATE_MONTH"))
        .when(x["reporting_month"] < s["last_month"], F.lit("CHRONOLOGY_VIOLATION"))
        .when(~s["active"] & calm, F.lit("NONE"))
        .when(~s["active"], F.lit(ISSUED))
        .when(calm & blind, F.lit("INSUFFICIENT_EVIDENCE"))
        .when(calm & improved, F.lit(RECOVERED))
        .when(cycles >= x["persistence_cycles"], F.lit(ESCALATED))
        .otherwise(F.lit(PERSISTENT)))


def response_outcome(s: Column, x: Column) -> Column:
    """A response counts once, for an active warning, with its texts given."""
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    fits = (
        s["active"] & ~s["responded"] & (s["warning_status"] != "RESPONSE_SUBMITTED")
        & F.coalesce(x["warning_id"] == s["warning_id"], F.lit(True))
        & F.coalesce(x["acknowledged"], F.lit(False)) & filled(x["response_text"]) & filled(x["corrective_action"]))
    return F.when(fits, F.lit("RESPONSE_ACCEPTED")).otherwise(F.lit("RESPONSE_REJECTED"))


def next_state(s: Column, x: Column, o: Column) -> Column:
    fresh = o == ISSUED
    taken = (x["kind"] == "OBSERVE") & ~o.isin(*REFUSED)
    counted = taken & is_true(x["risk"] >= ESCALATE)
    keep = lambda name, new: F.when(fresh, new).otherwise(s[name]).alias(name)
    status = (
        F.when(o.isin(ISSUED, RECOVERED, PERSISTENT, ESCALATED), o)
        .when(o == "RESPONSE_ACCEPTED", F.lit("RESPONSE_SUBMITTED")).otherwise(s["warning_status"]))
    project = (
        F.when(fresh, F.lit("WARNING_ISSUED")).when(o.isin(RECOVERED, ESCALATED), o)
        .when(o == "RESPONSE_ACCEPTED", F.lit("UNDER_RECOVERY")).otherwise(s["project_status"]))
    return F.struct(
        F.when(fresh, F.lit(True)).when(o.isin(RECOVERED, ESCALATED), F.lit(False)).otherwise(s["active"]).alias("active"),
        keep("warning_id", x["own_warning_id"]), keep("warning_month", x["reporting_month"]),
        status.alias("warning_status"), keep("w_risk", x["risk"]), keep("w_velocity", x["velocity"]),
        keep("w_deviation", x["deviation"]), keep("w_score", x["score"]),
        F.when(fresh, F.lit(1)).otherwise(s["cycles"] + F.when(s["active"] & counted, 1).otherwise(0)).alias("cycles"),
        F.when(fresh, F.lit(False)).otherwise(s["responded"] | (o == "RESPONSE_ACCEPTED")).alias("responded"),
        project.alias("project_status"),
        F.when(taken, x["reporting_month"]).otherwise(s["last_month"]).alias("last_month"),
    ).cast(STATE_DDL)


def emitted(s: Column, n: Column, x: Column, o: Column) -> Column:
    """One output row: what happened and the state it led to."""
    action = (
        F.when(o == ISSUED, F.lit("CONTRACTOR_WARNING_ISSUED")).when(o == RECOVERED, F.lit("PROJECT_RECOVERED"))
        .when(o == ESCALATED, F.lit("AUTHORITY_ESCALATION_ISSUED")).otherwise(F.lit("NONE")))
    recovery = (
        F.when(o.isin(PERSISTENT, ESCALATED), F.lit(PERSISTENT))
        .when(o.isin(RECOVERED, "INSUFFICIENT_EVIDENCE"), o))
    involved = s["active"] | n["active"]
    return F.struct(
        x["kind"].alias("kind"), x["arrival_seq"].alias("arrival_seq"), x["reporting_month"].alias("reporting_month"),
        x["risk"].alias("risk"), o.alias("outcome"), action.alias("action"), recovery.alias("recovery_status"),
        F.when(involved, n["warning_id"]).alias("warning_id"), F.when(involved, n["warning_status"]).alias("warning_status"),
        n["project_status"].alias("project_status"), F.when(involved, n["cycles"]).alias("cycles"),
        x["persistence_cycles"].alias("required_cycles"),
        F.when(o == ESCALATED, F.when(s["responded"], F.lit("RESPONSE_SUBMITTED")).otherwise(F.lit("UNRESPONSIVE"))).alias("response_status"),
        F.when(involved, n["w_risk"]).alias("w_risk"),
    ).cast(OUT_DDL)


def initial_state() -> Column:
    none = lambda t: F.lit(None).cast(t)
    return F.struct(
        F.lit(False), none("string"), none("string"), none("string"), none("double"), none("double"),
        none("double"), none("double"), F.lit(0), F.lit(False), F.lit("ACTIVE"), none("string"),
    ).cast(STATE_DDL)


def _step(acc: Column, x: Column) -> Column:
    s = acc["state"]
    decide = F.when(x["kind"] == "OBSERVE", observation_outcome(s, x)).otherwise(response_outcome(s, x))
    return let(decide, lambda o: let(
        next_state(s, x, o),
        lambda n: F.struct(n.alias("state"), F.concat(acc["out"], F.array(emitted(s, n, x, o))).alias("out"))))


FIELDS = [
    "arrival_seq", "kind", "reporting_month", "risk", "velocity", "deviation", "score", "persistence_cycles",
    "warning_id", "acknowledged", "response_text", "corrective_action",
]


def prepare(events: DataFrame) -> DataFrame:
    """Default the persistence setting and precompute each row's warning id."""
    return events.withColumns({
        "persistence_cycles": F.coalesce("persistence_cycles", F.lit(PERSISTENCE_CYCLES)),
        "own_warning_id": stable_id("WARN", F.col("project_id"), F.coalesce("reporting_month", F.lit(""))),
    })


def run_governance(events: DataFrame) -> DataFrame:
    """Outcome of every event.

    ``events`` holds accepted observations (one per entity and month) and any
    number of responses; the fold sees only those that may be accepted.
    """
    kept, refused = split_responses(events)
    return all_outcomes(folded(kept), refused)


def folded(events: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(project_id, state, out): each entity's last state and the outcome of its events.

    ``before`` (project_id, state) holds the states to go on from; batch and
    stream share this one set of rules.
    """
    packed = prepare(events).groupBy("project_id").agg(
        F.array_sort(F.collect_list(F.struct(*FIELDS, "own_warning_id"))).alias("events"))
    first = initial_state()
    if before is not None:
        packed = packed.join(before.select("project_id", F.col("state").alias("_state")), "project_id", "left")
        first = F.coalesce("_state", first)
    start = F.struct(first.alias("state"), F.array().cast(f"array<{OUT_DDL}>").alias("out"))
    return packed.withColumn("fold", F.aggregate("events", start, _step)).select("project_id", "fold.state", "fold.out")


def split_responses(events: DataFrame, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Events that the fold has to see, and responses that can only be refused.

    Between two observations an entity has one active warning, and one response
    to it can be accepted: the first that is complete and names that warning or
    none. So of the complete ones only the first after each observation and for
    each warning that the entity may have had is kept, which bounds the fold by
    the entity's months. Windows inside the entity decide it: rows cross one
    exchange, or none where they lie together by entity, and none is gathered.
    """
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    good = F.coalesce("acknowledged", F.lit(False)) & filled("response_text") & filled("corrective_action")
    observed, named = F.col("kind") == "OBSERVE", F.col("warning_id")
    own = stable_id("WARN", F.col("project_id"), F.coalesce("reporting_month", F.lit("")))
    earlier = Window.partitionBy("project_id").orderBy("arrival_seq").rangeBetween(Window.unboundedPreceding, -1)
    known = F.count(F.when(observed, 1)).over(Window.partitionBy("project_id", "_id")) > 0
    df = events.where("kind is not null")
    if before is not None:
        df = df.join(before.select("project_id", F.col("state.warning_id").alias("_old")), "project_id", "left")
        known = known | F.coalesce(named == F.col("_old"), F.lit(False))
    df = df.withColumn("_id", F.when(observed, own).otherwise(named)).withColumns({
        "_slot": F.count(F.when(observed, F.col("arrival_seq"))).over(earlier),
        "_fits": F.coalesce(~observed & F.col("project_id").isNotNull() & good & (named.isNull() | known), F.lit(False))})
    first = F.min(F.when(F.col("_fits"), F.col("arrival_seq"))).over(Window.partitionBy("project_id", "_slot", "warning_id"))
    judged = df.withColumn("_kept", observed | F.coalesce(F.col("_fits") & (F.col("arrival_seq") == first), F.lit(False)))
    return judged.where("_kept").select(*events.columns), judged.where("not _kept").select(*events.columns)


def all_outcomes(step: DataFrame, refused: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Outcomes of the fold, and of the responses it did not see in the state their entity had when they came.

    ``step`` is the result of :func:`folded`, which is read once: its outcomes
    lie beside the refused responses, and each of these looks back over them.
    """
    seen = step.select("project_id", F.posexplode("out").alias("_at", "o")).select(
        "project_id", F.col("o.arrival_seq").alias("arrival_seq"), "_at", "o")
    late = prepare(refused).select("project_id", "arrival_seq", F.struct("kind", "reporting_month", "risk", "persistence_cycles").alias("_r"))
    both = seen.unionByName(late, allowMissingColumns=True)
    o, r, placed = F.col("o"), F.col("_r"), F.col("project_id").isNotNull() & F.col("arrival_seq").isNotNull()
    state = ("project_status", "warning_id", "warning_status", "cycles", "w_risk")
    earlier = Window.partitionBy("project_id").orderBy("arrival_seq").rangeBetween(Window.unboundedPreceding, -1)
    latest = F.max(F.when(placed & o.isNotNull(), F.struct("arrival_seq", "_at", *[o[c].alias(c) for c in state]))).over(earlier)
    both = both.withColumn("_last", F.when(placed & r.isNotNull(), latest)).withColumn(
        "_last", F.when(F.col("_last").isNotNull(), F.struct(*[F.col("_last")[c].alias(c) for c in state])))
    if before is not None:
        both = both.join(before.select("project_id", F.col("state").alias("_state")), "project_id", "left")
        old = F.col("_state")
        standing = lambda c: F.when(old["active"], old[c]).alias(c)
        both = both.withColumn("_last", F.coalesce("_last", F.when(old.isNotNull(), F.struct(
            old["project_status"].alias("project_status"), *[standing(c) for c in state[1:]]))))
    at = F.col("_last")
    active = at["warning_id"].isNotNull() & ~F.coalesce(at["warning_status"].isin(RECOVERED, ESCALATED), F.lit(False))
    now = lambda c: F.when(active, at[c])
    text = F.lit(None).cast("string")
    refusal = F.struct(
        r["kind"].alias("kind"), F.col("arrival_seq"), r["reporting_month"].alias("reporting_month"), r["risk"].alias("risk"),
        F.lit("RESPONSE_REJECTED").alias("outcome"), F.lit("NONE").alias("action"), text.alias("recovery_status"),
        now("warning_id").alias("warning_id"), now("warning_status").alias("warning_status"),
        F.coalesce(at["project_status"], F.lit("ACTIVE")).alias("project_status"), now("cycles").alias("cycles"),
        r["persistence_cycles"].alias("required_cycles"), text.alias("response_status"), now("w_risk").alias("w_risk")).cast(OUT_DDL)
    return both.select("project_id", F.when(r.isNotNull(), refusal).otherwise(o).alias("o")).select("project_id", "o.*")


# ---- tables derived from the outcomes ------------------------------------

LEDGER_OF = {
    ISSUED: ["CONTRACTOR_WARNING_ISSUED"],
    RECOVERED: ["RECOVERY_DETECTED"],
    PERSISTENT: ["PERSISTENT_DETERIORATION_DETECTED"],
    ESCALATED: ["PERSISTENT_DETERIORATION_DETECTED", "AUTHORITY_ESCALATION_ISSUED"],
    "RESPONSE_ACCEPTED": ["CONTRACTOR_RESPONSE_RECEIVED", "RECOVERY_MONITORING_STARTED"],
}


def audit_ledger(outcomes: DataFrame) -> DataFrame:
    """Append-only audit rows of each event, in order, with stable ids."""
    tier = risk_tier(F.col("risk"))
    seen = F.array_compact(F.array(
        F.lit("MONTHLY_REPORT_SUBMITTED"), F.lit("PREDICTION_GENERATED"),
        F.when(tier.isin("WATCH", "REVIEW"), F.concat(tier, F.lit("_ENTERED")))))
    after = F.array().cast("array<string>")
    for outcome, types in LEDGER_OF.items():
        after = F.when(F.col("outcome") == outcome, F.array(*[F.lit(t) for t in types])).otherwise(after)
    types = F.concat(F.when(F.col("kind") == "OBSERVE", seen).otherwise(F.array().cast("array<string>")), after)
    return outcomes.select(
        "project_id", "arrival_seq", "reporting_month", "risk", "warning_id", F.posexplode(types).alias("seq", "event_type"),
    ).withColumn("event_id", stable_id("AUD", F.col("project_id"), F.col("arrival_seq").cast("string"), F.col("seq").cast("string")))


def registration_ledger(accepted: DataFrame) -> DataFrame:
    return accepted.select(
        "project_id", "arrival_seq", F.col("initial_reporting_month").alias("reporting_month"),
        F.lit(None).cast("double").alias("risk"), F.lit(None).cast("string").alias("warning_id"), F.lit(0).alias("seq"),
        F.lit("PROJECT_REGISTERED").alias("event_type"),
        stable_id("AUD", F.col("project_id"), F.lit("register")).alias("event_id"))


def warnings(outcomes: DataFrame) -> DataFrame:
    """Each warning with its issue facts and its latest status."""
    issued = F.col("outcome") == ISSUED
    return outcomes.where("warning_id is not null").groupBy("project_id", "warning_id").agg(
        F.max(F.when(issued, F.col("reporting_month"))).alias("reporting_month"),
        F.max(F.when(issued, F.col("risk"))).alias("risk_probability"),
        F.min("arrival_seq").alias("issued_seq"),
        F.max_by("warning_status", "arrival_seq").alias("status"))


def with_deadline(rows: DataFrame, issued_on: Column) -> DataFrame:
    """Response deadline, counted from the issue date given by the caller."""
    return rows.withColumn("response_deadline", F.date_add(issued_on, RESPONSE_DAYS))


def responses(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("outcome = 'RESPONSE_ACCEPTED'").select(
        stable_id("RESP", F.col("warning_id")).alias("response_id"), "project_id", "warning_id", "arrival_seq")


def escalations(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("outcome") == ESCALATED).select(
        stable_id("ESC", F.col("warning_id")).alias("escalation_id"), "project_id", "warning_id", "arrival_seq",
        "reporting_month", F.col("w_risk").alias("risk_at_warning"), F.col("risk").alias("current_risk"),
        F.col("cycles").alias("persistence_duration"), "response_status")


def escalation_dossiers(outcomes: DataFrame) -> DataFrame:
    """Escalation, its warning, its response and the audit trail up to it.

    The trail of an entity is bounded by its accepted months and responses.
    """
    esc = escalations(outcomes)
    warn = warnings(outcomes).select("warning_id", F.col("reporting_month").alias("warning_month"), "risk_probability")
    resp = responses(outcomes).select("warning_id", "response_id")
    trail = audit_ledger(outcomes).groupBy("project_id").agg(
        F.array_sort(F.collect_list(F.struct("arrival_seq", "seq", "event_id", "event_type"))).alias("trail"))
    own = F.filter("trail", lambda e: (e["arrival_seq"] < F.col("arrival_seq"))
                   | ((e["arrival_seq"] == F.col("arrival_seq")) & (e["event_type"] != "AUTHORITY_ESCALATION_ISSUED")))
    return (
        esc.join(warn, "warning_id").join(resp, "warning_id", "left").join(trail, "project_id")
        .withColumn("trail", own))


def project_status(outcomes: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry row with the latest observation, warning, response and escalation."""
    seq = F.col("arrival_seq")
    obs = F.col("kind") == "OBSERVE"
    last = lambda c, when: F.max_by(F.when(when, F.col(c)), F.when(when, seq))
    per = outcomes.groupBy("project_id").agg(
        last("reporting_month", obs).alias("latest_month"), last("risk", obs).alias("latest_risk"),
        last("warning_id", F.col("outcome") == ISSUED).alias("latest_warning_id"),
        last("warning_status", F.col("warning_id").isNotNull()).alias("latest_warning_status"),
        last("arrival_seq", F.col("outcome") == "RESPONSE_ACCEPTED").alias("latest_response_seq"),
        last("reporting_month", F.col("outcome") == ESCALATED).alias("latest_escalation_month"),
        F.max_by("project_status", seq).alias("governance_state"))
    return registry.join(per, "project_id", "left").withColumn(
        "governance_state", F.coalesce("governance_state", F.lit("ACTIVE")))


def escalation_list(outcomes: DataFrame, registry: DataFrame, sector: str | None = None) -> DataFrame:
    df = escalations(outcomes).join(registry.select("project_id", "project_name", "sector", "approved_cost"), "project_id")
    if sector:
        df = df.where(F.lower("sector") == sector.strip().lower())
    return df.orderBy(F.desc("arrival_seq"), "escalation_id")


def list_projects(
    status: DataFrame, sector: str | None = None, state: str | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    """Page of registered entities, newest registration first, with the total."""
    df = status
    if sector:
        df = df.where(F.lower("sector") == sector.strip().lower())
    if state:
        df = df.where(F.upper("governance_state") == state.strip().upper())
    total = df.agg(F.count("*").alias("n")).scalar()
    return df.orderBy(F.desc("arrival_seq"), "project_id").offset(offset).limit(limit).withColumn("total", total)


def brief_facts(outcomes: DataFrame, status: DataFrame) -> DataFrame:
    """Facts for a written brief: status, warning count, last three audit types."""
    trail = audit_ledger(outcomes).groupBy("project_id").agg(
        F.array_sort(F.collect_list(F.struct("arrival_seq", "seq", "event_type"))).alias("t"))
    recent = trail.select("project_id", F.transform(
        F.slice("t", F.greatest(F.size("t") - 2, F.lit(1)), 3), lambda e: e["event_type"]).alias("recent_audit_events"))
    counts = warnings(outcomes).groupBy("project_id").agg(F.count("*").alias("warning_count"))
    return (
        status.join(counts, "project_id", "left").join(recent, "project_id", "left").na.fill({"warning_count": 0})
        .withColumns({
            "is_escalated": F.col("governance_state") == ESCALATED,
            "is_recovering": F.col("governance_state").isin("UNDER_RECOVERY", RECOVERED)}))


def without_project(tables: dict[str, DataFrame], project_id: str) -> dict[str, DataFrame]:
    """Every operational table without one entity's rows (scenario reset)."""
    return {k: t.where(~F.col("project_id").eqNullSafe(F.lit(project_id))) for k, t in tables.items()}
