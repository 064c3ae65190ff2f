"""From raw report rows to the canonical panel and its companions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.dates import month_index, normalize_month
from tidewatch.functions.identity import audit_action, audit_reason, is_non_project
from tidewatch.functions.numbers import decimal_round, half_even, normalize_money, normalize_progress
from tidewatch.functions.text import (
    PROJECT_CODE, clean_project_title, clean_sector_name, clean_text, multi_field, normalize_project_id,
)

GRAIN = ["project_id", "reporting_month"]
NUMBERS = ["physical_progress", "financial_progress", "expenditure", "approved_cost", "revised_cost"]


def normalize_cells(cells: DataFrame) -> DataFrame:
    """Type the text cells of extracted rows into raw records. Row by row, no shuffle."""
    empty = F.lit("")
    df = cells.withColumns({
        "project_name": clean_project_title(F.col("name_cell")),
        "sector": F.coalesce(clean_sector_name(F.col("sector_cell")), empty),
        "ministry": clean_text(F.col("ministry_cell")),
        "state": clean_text(F.col("state_cell")),
        "_dates": multi_field(F.col("doc_cell")),
        "_costs": multi_field(F.col("cost_cell")),
        "expenditure": normalize_money(F.col("exp_cell")),
        "physical_progress": normalize_progress(F.col("prog_cell")),
    })
    df = df.withColumns({
        "project_id": normalize_project_id(
            F.col("code_cell"), F.col("project_name"), F.col("sector"), F.col("ministry"), F.col("state")),
        "reporting_month": F.coalesce(normalize_month(F.col("month_cell")), F.lit("UNKNOWN")),
        "approved_cost": normalize_money(F.col("_costs.original")),
        "revised_cost": F.coalesce(
            normalize_money(F.col("_costs.revised")), normalize_money(F.col("_costs.anticipated"))),
        "original_completion_date": normalize_month(F.col("_dates.original")),
        "revised_completion_date": F.coalesce(
            normalize_month(F.col("_dates.revised")), normalize_month(F.col("_dates.anticipated"))),
    })
    return df.select(
        "raw_record_id", "project_id", "project_name", "sector", "ministry", "state",
        empty.alias("district"), empty.alias("project_size"), "reporting_month", "physical_progress",
        spent_share(F.col("expenditure"), F.col("approved_cost")).alias("financial_progress"),
        "expenditure", "approved_cost", "revised_cost", "original_completion_date", "revised_completion_date",
        clean_text(F.col("milestone_cell")).alias("milestone_information"),
        F.col("dev_cell").alias("schedule_deviation"), "source_pdf", "source_page")


def spent_share(expenditure: Column, cost: Column) -> Column:
    """Money spent as a percentage of the cost; needs both, non-zero."""
    return F.when((expenditure != 0) & (cost > 0), decimal_round(expenditure / cost * 100.0, 2))


def valid_keys(raw: DataFrame) -> DataFrame:
    pid = F.trim(F.coalesce("project_id", F.lit("")))
    month = F.trim(F.coalesce("reporting_month", F.lit("")))
    return raw.withColumns({"project_id": pid, "reporting_month": month}).where(
        ~pid.isin("", "UNKNOWN") & ~month.isin("", "UNKNOWN"))


def _first_filled(name: str) -> Column:
    """First non-empty value in raw order."""
    filled = F.col(name).isNotNull() & (F.col(name) != "")
    return F.min_by(F.when(filled, F.col(name)), F.when(filled, F.col("raw_record_id")))


def _longest(c: Column, usable: Column, order: Column) -> Column:
    """Longest usable text; the earliest one on a tie."""
    return F.max_by(F.when(usable, c), F.when(usable, F.struct(F.length(c).alias("l"), (-order).alias("o"))))


def merge_to_grain(raw: DataFrame) -> DataFrame:
    """One row per (entity, month): every column is a combinable aggregate.

    A key that holds a large share of all rows is reduced on the map side; what
    crosses the shuffle per task is one partial row, plus the distinct source
    names and pages the output lists anyway.
    """
    name = F.trim("project_name")
    rid = F.col("raw_record_id")
    page_ok = F.col("source_page").isNotNull()
    merged = valid_keys(raw).groupBy(*GRAIN).agg(
        F.coalesce(_longest(name, F.length(name) >= 3, rid), F.min_by("project_name", rid), F.lit("")).alias("project_name"),
        *[F.coalesce(_first_filled(c), F.lit("")).alias(c) for c in ("sector", "ministry", "state", "district", "project_size")],
        *[F.max(c).alias(c) for c in NUMBERS],
        *[_first_filled(c).alias(c) for c in ("original_completion_date", "revised_completion_date")],
        F.coalesce(_longest(F.col("milestone_information"), F.col("milestone_information") != "", rid), F.lit("")).alias("milestone_information"),
        F.coalesce(_first_filled("schedule_deviation"), F.lit("")).alias("schedule_deviation"),
        F.count("*").cast("int").alias("duplicate_raw_record_count"),
        *[x for c in ("physical_progress", "financial_progress") for x in (
            F.min(c).alias(f"_min_{c}"), F.count(c).alias(f"_n_{c}"))],
        F.array_sort(F.collect_set(F.when(F.col("source_pdf") != "", F.col("source_pdf")))).alias("_pdfs"),
        F.array_sort(F.collect_set(F.when(page_ok, F.col("source_page")))).alias("_pages"),
    )
    return merged.withColumns({
        "source_pdf_count": F.size("_pdfs"),
        "source_pages": F.array_join(F.transform("_pages", lambda p: F.concat(F.lit("p."), p.cast("string"))), "; "),
        "extraction_warning": merge_warning(),
        "source_pdf": F.array_join("_pdfs", "; "),
        "source_page": F.coalesce(F.get("_pages", F.lit(0)), F.lit(0)),
    }).drop(*[c for c in merged.columns if c.startswith("_")])


def merge_warning() -> Column:
    def spread(c: str, tag: str) -> Column:
        low, high = F.col(f"_min_{c}"), F.col(c)
        text = lambda x: F.format_string("%.1f", decimal_round(x, 1))
        return F.when((F.col(f"_n_{c}") > 1) & (high - low > 5.0), F.concat(
            F.lit(f"{tag}("), text(low), F.lit("%-"), text(high), F.lit("%)")))

    n = F.col("duplicate_raw_record_count")
    return F.concat_ws(
        "; ",
        F.when(n > 1, F.concat(F.lit("MERGED_"), n.cast("string"), F.lit("_RAW_ROWS"))),
        spread("physical_progress", "PHYS_PROG_VARIANCE"),
        spread("financial_progress", "FIN_PROG_VARIANCE"))


def drop_non_projects(panel: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
    """Remove report furniture and the ids a review marked EXCLUDE."""
    kept = panel.where(~is_non_project(F.col("project_id"), F.col("project_name")))
    if reviewed is None:
        return kept
    out = reviewed.where("recommended_action = 'EXCLUDE'").select("project_id").distinct()
    return kept.join(out, "project_id", "left_anti")


def canonical_panel(raw: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
    return drop_non_projects(merge_to_grain(raw), reviewed)


def project_master(panel: DataFrame) -> DataFrame:
    """One row per entity: first month's attributes, gaps filled by later months."""
    m = F.col("reporting_month")

    def first_filled(c: str) -> Column:
        filled = F.col(c).isNotNull() & (F.col(c) != "")
        return F.min_by(F.when(filled, F.col(c)), F.when(filled, m))

    text = ("project_name", "sector", "ministry", "state")
    return panel.groupBy("project_id").agg(
        *[F.coalesce(first_filled(c), F.lit("")).alias(c) for c in text],
        *[F.min_by(c, m).alias(c) for c in ("district", "project_size")],
        *[first_filled(c).alias(c) for c in ("original_completion_date", "revised_completion_date")],
        F.min(m).alias("first_seen_month"), F.max(m).alias("last_seen_month"))


def coverage(panel: DataFrame) -> DataFrame:
    """Observation counts, duplication ratio and missing months per entity.

    The panel's grain is unique, so rows count months.
    """
    m = F.col("reporting_month")
    name = F.col("project_name")

    def first_filled(c: str) -> Column:
        filled = F.col(c).isNotNull() & (F.col(c) != "")
        return F.coalesce(F.min_by(F.when(filled, F.col(c)), F.when(filled, m)), F.lit(""))

    mi = month_index(m)
    return panel.groupBy("project_id").agg(
        F.coalesce(_longest(name, name != "", mi), F.lit("")).alias("project_name"),
        *[first_filled(c).alias(c) for c in ("sector", "ministry", "state")],
        F.min(m).alias("first_observation"), F.max(m).alias("last_observation"),
        F.count("*").alias("observation_count"),
        F.sum("duplicate_raw_record_count").alias("total_raw_records"),
        (F.max(mi) - F.min(mi) + 1 - F.count("*")).alias("missing_months"),
    ).withColumn(
        "raw_to_canonical_ratio", decimal_round(F.col("total_raw_records") / F.col("observation_count"), 2))


def ordered_coverage(cov: DataFrame) -> DataFrame:
    return cov.orderBy(F.desc("observation_count"), F.desc("raw_to_canonical_ratio"), "project_id")


def density_buckets(cov: DataFrame) -> DataFrame:
    n = F.col("observation_count")
    tests = [("1", n == 1), ("2", n == 2), ("3-5", n.between(3, 5)), ("6-12", n.between(6, 12)), (">12", n > 12)]
    one = cov.agg(F.count("*").alias("all"), *[
        F.coalesce(F.sum(t.cast("long")), F.lit(0)).alias(f"b{i}") for i, (_, t) in enumerate(tests)])
    rows = F.explode(F.array(*[
        F.struct(F.lit(k).alias("bucket"), F.col(f"b{i}").alias("projects")) for i, (k, _) in enumerate(tests)]))
    return one.select("all", rows.alias("r")).select(
        "r.bucket", "r.projects", half_even(100.0 * F.col("r.projects") / F.col("all"), 4).alias("pct"))


def most_duplicated(cov: DataFrame, k: int = 20) -> DataFrame:
    return cov.orderBy(F.desc("raw_to_canonical_ratio"), "project_id").limit(k)


def longest_histories(cov: DataFrame, k: int = 20) -> DataFrame:
    return ordered_coverage(cov).limit(k)


def identity_audit(panel: DataFrame) -> DataFrame:
    """Entities whose names meet a furniture rule, with a recommended action.

    Names are made distinct before the rules run, so each is tested once.
    """
    name = F.trim(F.coalesce("project_name", F.lit("")))
    names = (
        panel.groupBy("project_id", name.alias("name"))
        .agg(F.min("reporting_month").alias("seen"), F.count("*").alias("n"))
        .withColumn("reason", audit_reason(F.col("name")))
    )
    usable = F.col("name") != ""
    per = names.groupBy("project_id").agg(
        F.coalesce(F.max_by(F.when(usable, F.col("name")), F.when(usable, F.struct(
            F.length("name").alias("l"), (-month_index(F.col("seen"))).alias("o"), F.col("name").alias("t")))), F.lit("")).alias("project_name"),
        F.sum("n").alias("observation_count"),
        F.min_by("reason", F.when(F.col("reason").isNotNull(), F.struct("seen", "name"))).alias("reason_flagged"))
    flagged = per.where("reason_flagged is not null")
    return flagged.withColumn("recommended_action", audit_action(
        F.col("project_id"), F.col("project_name"), F.col("reason_flagged")))


def extraction_confidence(raw: DataFrame) -> DataFrame:
    """Status and confidence of each source document."""
    ok_id = (F.col("project_id") != "") & ~F.col("project_id").startswith("UNKNOWN")
    ok_month = F.col("reporting_month") != "UNKNOWN"
    share = lambda c: F.sum(c.cast("long")) / F.count("*")
    return raw.groupBy("source_pdf").agg(
        F.count("*").alias("projects_detected"),
        decimal_round(share(ok_id) * 0.5 + share(ok_month) * 0.5, 2).alias("confidence"),
    ).withColumn("extraction_status", F.lit("SUCCESS"))


def inspect_documents(pages: DataFrame) -> DataFrame:
    """Pages, text-or-scan verdict and official codes of each document.

    Input: ``filename, page, text``; all pages count.
    """
    head = F.coalesce(F.length(F.trim("text")), F.lit(0))
    sizes = pages.groupBy("filename").agg(
        F.countDistinct("page").alias("pages"), (F.sum(head) > 100).alias("is_text"))
    codes = pages.select("filename", F.explode(F.expr(f"regexp_extract_all(text, r'{PROJECT_CODE}', 0)")).alias("code")).distinct()
    found = codes.groupBy("filename").agg(F.count("*").alias("codes_found"), F.min("code").alias("first_code"))
    return sizes.join(found, "filename", "left").na.fill({"codes_found": 0})
