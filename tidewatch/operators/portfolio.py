"""Portfolio snapshot, exposure and prioritisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.identity import is_genuine, is_macro_summary, macro_reason
from tidewatch.functions.numbers import exact_mean, exact_sum, half_even
from tidewatch.operators.policies import TIERS, risk_tier, tier_rank
from tidewatch.operators.ranking import running_totals
from tidewatch.operators.selection import column_percentiles
from tidewatch.operators.timeline import entity

AGE_EDGES = [(-1, 12, "< 1 yr"), (12, 36, "1-3 yrs"), (36, 60, "3-5 yrs"), (60, 120, "5-10 yrs"), (120, 1000, "> 10 yrs")]


def latest_rows(df: DataFrame) -> DataFrame:
    """The last row of each entity as it stands, NULLs included, plus its first month.

    A ranked window: a table in buckets of the entity is not moved, and only
    the columns that are asked for are read and sorted.
    """
    rest = [c for c in df.columns if c != "project_id"]
    ranked = df.withColumns({
        "_at": F.row_number().over(entity().orderBy(F.desc_nulls_last("month_idx"))),
        "start_month": F.min("reporting_month").over(entity()),
    }).where("_at = 1")
    known = F.col("month_idx").isNotNull()
    return ranked.select("project_id", *[F.when(known, F.col(c)).alias(c) for c in rest], "start_month")


def genuine_only(snapshot: DataFrame) -> DataFrame:
    return snapshot.where(is_genuine(F.col("project_id"), F.col("project_name")))


def active(snapshot: DataFrame, cutoff: str) -> DataFrame:
    return snapshot.where(F.col("reporting_month") >= cutoff)


def historical(snapshot: DataFrame, cutoff: str) -> DataFrame:
    return snapshot.where(F.col("reporting_month") < cutoff)


def score_snapshot(snapshot: DataFrame, p: str = "p") -> DataFrame:
    """Tier, baseline cost and risk-weighted exposure of each entity.

    The tier uses the probability as it is, the exposure its four-digit form.
    """
    have = set(snapshot.columns)
    sector = [F.col(c) for c in ("sector_clean", "sector") if c in have]
    risk = half_even(F.col(p), 4)
    cost = half_even(F.coalesce("C_base", F.lit(0.0)), 2)
    df = snapshot.withColumns({
        "latest_risk": risk,
        "risk_tier": risk_tier(F.col(p)),
        "baseline_cost": cost,
        "sector_display": F.coalesce(*sector, F.lit("Unknown")),
    })
    return df.withColumn(
        "risk_weighted_exposure", half_even(F.col("latest_risk") * F.col("baseline_cost"), 2))


def _tier_count(tier: str) -> Column:
    return F.coalesce(F.sum((F.col("risk_tier") == tier).cast("long")), F.lit(0))


def summary(scored: DataFrame) -> DataFrame:
    cost = F.col("baseline_cost")
    return scored.agg(
        F.count("*").alias("active_project_count"),
        half_even(F.coalesce(exact_sum(cost, 2), F.lit(0.0)), 2).alias("active_baseline_exposure"),
        half_even(F.coalesce(exact_sum(F.when(F.col("risk_tier") == "ESCALATE", cost), 2), F.lit(0.0)), 2).alias("exposure_in_escalate"),
        half_even(F.coalesce(exact_sum(F.col("risk_weighted_exposure"), 2), F.lit(0.0)), 2).alias("risk_weighted_exposure"),
        *[_tier_count(t).alias(f"{t.lower()}_count") for t in TIERS])


def archive_span(panel: DataFrame) -> DataFrame:
    """Months and entities of the whole archive."""
    return panel.groupBy("project_id").agg(
        F.min("reporting_month").alias("a"), F.max("reporting_month").alias("b")
    ).agg(F.count("*").alias("total_archive_entities"), F.min("a").alias("archive_start"),
          F.max("b").alias("archive_end"))


def sector_breakdown(scored: DataFrame) -> DataFrame:
    return scored.groupBy(F.col("sector_display").alias("sector")).agg(
        F.count("*").alias("total_projects"),
        *[_tier_count(t).alias(f"{t.lower()}_count") for t in ("ESCALATE", "REVIEW", "WATCH")],
        half_even(exact_sum(F.col("baseline_cost"), 2), 2).alias("total_exposure"),
    ).orderBy(F.desc("total_exposure"), "sector")


def eligible(scored: DataFrame, sector: str | None = None, min_tier: str | None = None) -> DataFrame:
    df = scored
    if sector:
        df = df.where(F.lower("sector_display") == sector.strip().lower())
    if min_tier and min_tier.strip().upper() in TIERS:
        df = df.where(tier_rank(F.col("risk_tier")) >= TIERS.index(min_tier.strip().upper()))
    return df


def interventions(
    scored: DataFrame, limit: int = 30, sector: str | None = None, min_tier: str | None = None
) -> DataFrame:
    """Top entities by risk-weighted exposure, with the size of the pool.

    The total is a scalar subquery next to a top-k plan; nothing is ranked in
    one task. Both read ``scored``, which should be a stored snapshot.
    """
    pool = eligible(scored, sector, min_tier)
    total = pool.agg(F.count("*").alias("n")).scalar()
    cols = [c for c in ("project_id", "project_name", "sector_display", "reporting_month", "latest_risk",
                        "risk_tier", "baseline_cost", "risk_weighted_exposure") if c in pool.columns]
    return (
        pool.select(*cols)
        .orderBy(F.desc("risk_weighted_exposure"), "project_id").limit(limit)
        .withColumn("total_eligible", total)
    )


def search(
    scored: DataFrame, archive: DataFrame, term: str | None = None, sector: str | None = None,
    tier: str | None = None, limit: int = 50, offset: int = 0,
) -> DataFrame:
    """Filtered page of the active list, with the total before paging.

    A term nothing active matches falls back to the genuine archive, shown as
    unscored. Pages are ordered by id.
    """
    cols = ["project_id", "project_name", "sector_display", "reporting_month", "latest_risk", "risk_tier", "baseline_cost"]
    hits = scored.select(*cols)
    if term:
        t = term.strip().lower()
        match = F.contains(F.lower("project_id"), F.lit(t)) | F.contains(F.lower("project_name"), F.lit(t))
        hits = hits.where(match)
        found = hits.agg(F.count("*").alias("n")).scalar()
        old = archive.where(match).select(
            "project_id", "project_name", F.coalesce("sector_clean", F.lit("OTHER")).alias("sector_display"),
            "reporting_month", F.lit(0.0).alias("latest_risk"), F.lit("NORMAL").alias("risk_tier"),
            F.coalesce("C_base", F.lit(0.0)).alias("baseline_cost"))
        hits = hits.unionByName(old.where(found == 0))
    if sector:
        hits = hits.where(F.lower("sector_display") == sector.strip().lower())
    if tier:
        hits = hits.where(F.col("risk_tier") == tier.strip().upper())
    total = hits.agg(F.count("*").alias("n")).scalar()
    return hits.orderBy("project_id").offset(offset).limit(limit).withColumn("total", total)


SEVERITY = {"ESCALATE": "CRITICAL DIVERGENCE", "REVIEW": "HIGH STAGNATION", "WATCH": "MODERATE WATCH"}


def severity(tier: Column) -> Column:
    out = F.lit("NORMAL")
    for t, label in SEVERITY.items():
        out = F.when(tier == t, F.lit(label)).otherwise(out)
    return out


def display_score(tier: Column, risk: Column) -> Column:
    return F.when(tier == "NORMAL", F.lit(0.0)).otherwise(F.floor(F.coalesce(risk, F.lit(0.0)) * 100.0 + 0.5).cast("double"))


def dashboard_ratios(scored: DataFrame) -> DataFrame:
    s = summary(scored)
    high = F.col("watch_count") + F.col("review_count") + F.col("escalate_count")
    return s.select(
        F.col("active_project_count").alias("total_monitored"), high.alias("high_risk_count"),
        half_even(100.0 * high / F.col("active_project_count"), 1).alias("risk_pct"),
        F.floor(F.col("risk_weighted_exposure") + 0.5).cast("double").alias("value_at_risk"),
        F.when(F.col("active_baseline_exposure") > 0,
               half_even(100.0 * F.col("risk_weighted_exposure") / F.col("active_baseline_exposure"), 1)).alias("risk_portfolio_pct"),
        F.col("normal_count").alias("normal_segment"), F.col("watch_count").alias("elevated_segment"),
        (F.col("review_count") + F.col("escalate_count")).alias("divergent_segment"))


def exposure_concentration(scored: DataFrame, shares: Sequence[float] = (0.01, 0.05, 0.10)) -> DataFrame:
    """Exposure held by the largest entities, exact and without a global window.

    ``k = max(1, round(share * N))`` entities are counted; ties at the border
    contribute only the part that still fits.
    """
    run = running_totals(scored, [], "baseline_cost", {"money": F.col("baseline_cost")}, descending=True)
    size = scored.agg(F.count("*").alias("n"), F.sum("baseline_cost").alias("s")).first()
    n, total = size["n"], size["s"] or 0.0
    aggs = []
    for i, s in enumerate(shares):
        k = max(1, int(s * n + 0.5))
        fits = F.least(F.greatest(F.lit(k) - F.col("n_before"), F.lit(0)), F.col("n"))
        aggs.append(F.sum(fits * F.col("baseline_cost")).alias(f"x{i}"))
    rows = F.explode(F.array(*[
        F.struct(F.lit(float(s)).alias("top_share"), F.lit(max(1, int(s * n + 0.5))).cast("long").alias("projects"),
                 F.col(f"x{i}").alias("exposure")) for i, s in enumerate(shares)]))
    return run.agg(*aggs).select(rows.alias("r")).select(
        "r.top_share", "r.projects", half_even(F.col("r.exposure"), 2).alias("exposure"),
        half_even(F.col("r.exposure") / F.lit(total if total else None).cast("double"), 6).alias("exposure_share"))


def mega_projects(scored: DataFrame, floor_cost: float = 25000.0) -> DataFrame:
    return scored.where(F.col("baseline_cost") >= floor_cost).select(
        "project_id", "project_name", "sector_display", "baseline_cost", "risk_tier", "latest_risk",
    ).orderBy(F.desc("baseline_cost"), "project_id")


def tier_profile(scored: DataFrame) -> DataFrame:
    """Count, share, mean and median risk of every tier, empty tiers included."""
    all_tiers = scored.sparkSession.createDataFrame([(t,) for t in TIERS], "risk_tier string")
    # four-digit risks: the weighted percentile sees at most 10,001 values
    hist = scored.groupBy("risk_tier", "latest_risk").agg(F.count("*").alias("n"))
    per = hist.groupBy("risk_tier").agg(
        F.sum("n").alias("projects"),
        half_even(exact_mean(F.col("latest_risk"), 4, F.col("n")), 6).alias("mean_prob"),
        half_even(F.percentile("latest_risk", 0.5, F.col("n")), 6).alias("median_prob"))
    share = F.col("projects") / F.sum("projects").over(Window.partitionBy(F.lit(1)))
    zero = {"projects": 0, "mean_prob": 0.0, "median_prob": 0.0}
    return all_tiers.join(per, "risk_tier", "left").na.fill(zero).withColumn("pct", half_even(share * 100.0, 4))


def age_bucket(age: Column) -> Column:
    out = F.lit(None).cast("string")
    for low, high, name in AGE_EDGES:
        out = F.when((age > low) & (age <= high), F.lit(name)).otherwise(out)
    return out


def escalate_shares(scored: DataFrame) -> DataFrame:
    """ESCALATE share by sector, month, age and scale, in one grouping-sets pass."""
    dims = {"sector": "sector_display", "month": "reporting_month", "age": "_age", "scale": "scale_bucket"}
    base = scored.withColumn("_age", age_bucket(F.col("project_age_months")))
    keyed = base.select("risk_tier", "latest_risk", *[F.col(c).alias(k) for k, c in dims.items()])
    g = keyed.groupingSets([[F.col(k)] for k in dims], *dims).agg(
        F.grouping_id().alias("_g"), F.count("*").alias("total"), _tier_count("ESCALATE").alias("escalate"),
        half_even(exact_mean(F.col("latest_risk"), 4), 6).alias("mean_prob"))
    ids = {k: (1 << len(dims)) - 1 - (1 << (len(dims) - 1 - i)) for i, k in enumerate(dims)}
    name = F.coalesce(*[F.when(F.col("_g") == v, F.lit(k)) for k, v in ids.items()])
    value = F.coalesce(*[F.when(F.col("_g") == ids[k], F.col(k)) for k in dims])
    return g.select(name.alias("dimension"), value.alias("value"), "total", "escalate", "mean_prob",
                    half_even(100.0 * F.col("escalate") / F.col("total"), 4).alias("escalate_pct"))


DRIVERS = {  # column -> (value for NULL, test)
    "schedule_deviation_months": (0.0, lambda c: c >= 12.0),
    "cost_revision_ratio": (1.0, lambda c: c > 1.0),
    "financial_progress": (0.0, lambda c: c > 0.0),
    "V_fin_1m": (0.0, lambda c: c <= 0.0),
    "trajectory_risk_score": (0.0, lambda c: c >= 40.0),
}


def driver_statistics(scored: DataFrame) -> DataFrame:
    """Median, mean and share beyond the threshold of the main drivers."""
    wide = scored.select(*[F.coalesce(F.col(c).cast("double"), F.lit(d)).alias(c) for c, (d, _) in DRIVERS.items()])
    sums = wide.agg(*[F.struct(
        half_even(exact_mean(F.col(c), 6), 6).alias("mean"),
        half_even(F.sum(test(F.col(c)).cast("bigint")) / F.count("*") * 100.0, 4).alias("pct_beyond")).alias(c) for c, (_, test) in DRIVERS.items()])
    base = sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("driver"), f"{c}.mean", f"{c}.pct_beyond") for c in DRIVERS])).alias("e")).select("e.*")
    med = column_percentiles(wide, list(DRIVERS), [0.5], "driver")
    return base.join(med, "driver").withColumnRenamed("p0", "median").withColumn("median", half_even(F.col("median"), 6))


def window_sensitivity(scored: DataFrame, cutoffs: Sequence[str]) -> DataFrame:
    """Portfolio size, exposure and tiers under several activity cutoffs.

    Each entity is copied once per cutoff it meets, then pre-aggregated.
    """
    met = F.filter(F.array(*[F.lit(c) for c in cutoffs]), lambda c: c <= F.col("reporting_month"))
    hist = scored.withColumn("cutoff", F.explode(met)).groupBy("cutoff", "latest_risk", "risk_tier").agg(
        F.count("*").alias("n"), exact_sum(F.col("baseline_cost"), 2).alias("cost"), exact_sum(F.col("risk_weighted_exposure"), 2).alias("rwe"))
    n = F.col("n")
    return hist.groupBy("cutoff").agg(
        F.sum("n").alias("projects"), half_even(exact_sum(F.col("cost"), 2), 2).alias("exposure"),
        half_even(exact_sum(F.col("rwe"), 2), 2).alias("risk_weighted_exposure"),
        half_even(exact_mean(F.col("latest_risk"), 4, n), 6).alias("mean_risk"),
        half_even(F.percentile("latest_risk", 0.5, n), 6).alias("median_risk"),
        *[F.sum(F.when(F.col("risk_tier") == t, n).otherwise(0)).alias(f"{t.lower()}_count") for t in TIERS])


def shared_names(snapshot: DataFrame) -> DataFrame:
    """Entities that share their name with another id.

    Counts per name are joined back, so a very common name is never collected.
    """
    n = snapshot.groupBy("project_name").agg(F.count("*").alias("ids_with_name")).where("ids_with_name > 1")
    return snapshot.select("project_id", "project_name").join(n, "project_name")


# Words a sanitised name is scanned for.
LEAK_WORDS = ["FLA", "LAS", "TOTAL", "SUMMARY", "TABLE", "STATEMENT", "ALL INDIA", "MULTI STATE",
              "GRAND TOTAL", "SECTOR", "STATE"]


def keyword_leaks(snapshot: DataFrame, words: Sequence[str] = LEAK_WORDS) -> DataFrame:
    """Names that still carry a summary word, and how the detector classes them."""
    name = F.upper("project_name")
    hit = F.regexp_extract(name, r"\b(" + "|".join(words) + r")\b", 1)
    return snapshot.select(
        "project_id", "project_name", hit.alias("keyword"),
        macro_reason(F.col("project_id"), F.col("project_name")).alias("classification"),
    ).where("keyword <> ''")


def reconciliation(scored_all: DataFrame, cutoff: str) -> DataFrame:
    """Counts and exposure before and after each sanitising step, in one pass."""
    pid, name = F.col("project_id"), F.col("project_name")
    steps = F.array_compact(F.array(
        F.lit("1_all"), F.when(~is_macro_summary(pid, name), F.lit("2_no_macro")),
        F.when(is_genuine(pid, name), F.lit("3_genuine")),
        F.when(is_genuine(pid, name) & (F.col("reporting_month") >= cutoff), F.lit("4_active"))))
    return scored_all.withColumn("step", F.explode(steps)).groupBy("step").agg(
        F.count("*").alias("projects"), half_even(exact_sum(F.col("baseline_cost"), 2), 2).alias("exposure"),
        _tier_count("ESCALATE").alias("escalate_count"))
