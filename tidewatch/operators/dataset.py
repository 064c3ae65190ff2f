"""Model dataset assembly, cohorts and chronological splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import Fold
from tidewatch.functions.dates import add_months
from tidewatch.operators.selection import column_moments, column_percentiles
from tidewatch.operators.timeline import require_unique_grain

GRAIN = ["project_id", "reporting_month"]


def with_lineage(df: DataFrame) -> DataFrame:
    """Months each row's features end at and its labels reach to."""
    m = F.col("reporting_month")
    return df.withColumns({
        "feature_cutoff_month": m,
        "target_horizon_month_6m": add_months(m, 6),
        "target_horizon_month_12m": add_months(m, 12),
    })


def model_dataset(features: DataFrame, targets: DataFrame, verify: bool = True) -> DataFrame:
    """Join features and labels that were stored apart.

    With ``verify`` the grain of both sides is checked first (two jobs). When
    both come from one panel, ``labels.with_labels`` on the features gives the
    same rows without a join.
    """
    if verify:
        require_unique_grain(features)
        require_unique_grain(targets)
    return with_lineage(features.join(targets, GRAIN, "inner"))


def cohort(df: DataFrame, h: int = 12) -> DataFrame:
    """Rows fit for modelling: enough history and an observable horizon."""
    return df.where((F.col("eligible_features") == 1) & (F.col(f"target_observable_{h}m") == 1))


def cohort_flags(df: DataFrame) -> DataFrame:
    flags = ["eligible_features", "target_observable_6m", "target_observable_12m"]
    groups = df.groupBy(*flags).agg(F.count("*").alias("row_count"))
    # at most eight groups: the share's total is taken over those, not the rows
    share = F.col("row_count") / F.sum("row_count").over(Window.partitionBy(F.lit(1)))
    return groups.withColumn("row_share", share)


def feature_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Coverage, mean, spread and quartiles of numeric columns, a row per column.

    ``df`` is read several times as columns; pass a stored table.
    """
    parts = column_percentiles(df, columns, [0.25, 0.5, 0.75])
    return column_moments(df, columns).join(parts, "feature", "left").withColumnsRenamed(
        {"p0": "q25", "p1": "median", "p2": "q75"})


def with_roles(df: DataFrame, folds: Sequence[Fold], label: str = "overrun_composite_12m") -> DataFrame:
    """Walk-forward roles: one output row per fold a month belongs to."""
    m = F.col("reporting_month")

    def role(f: Fold) -> Column:
        return (
            F.when(m <= f.train_end, F.lit("train"))
            .when(m.between(f.val_start, f.val_end), F.lit("val"))
            .when(m.between(f.test_start, f.test_end), F.lit("test"))
        )

    slots = F.array(*[F.struct(F.lit(f.fold_id).alias("fold_id"), role(f).alias("role")) for f in folds])
    return (
        df.where(F.col(label).isNotNull())
        .withColumn("_slot", F.explode(slots))
        .where("_slot.role is not null")
        .select("*", "_slot.fold_id", "_slot.role")
        .drop("_slot")
    )


def fold_isolation(roles: DataFrame) -> DataFrame:
    """Latest training month, earliest test month and the gap between them."""
    edge = roles.groupBy("fold_id").agg(
        F.max(F.when(F.col("role") == "train", F.col("month_idx"))).alias("train_last"),
        F.min(F.when(F.col("role") == "test", F.col("month_idx"))).alias("test_first"),
        *[F.sum((F.col("role") == r).cast("long")).alias(f"{r}_rows") for r in ("train", "val", "test")],
    )
    return edge.withColumns({
        "buffer_months": F.col("test_first") - F.col("train_last") - 1,
        "isolated": F.col("train_last") < F.col("test_first"),
    })


def hashed_holdout(share: int = 20, seed: int = 42) -> Column:
    """Stable pseudo-random choice of whole entities."""
    return F.pmod(F.xxhash64("project_id", F.lit(seed)), F.lit(100)) < share


def entity_holdout(df: DataFrame, cutoff: str, held: Column | None = None) -> DataFrame:
    """Train on other entities up to the cutoff, test on held-out ones after it."""
    out = hashed_holdout() if held is None else held
    m = F.col("reporting_month")
    role = F.when(~out & (m <= cutoff), F.lit("train")).when(out & (m > cutoff), F.lit("test"))
    return df.withColumn("role", role).where("role is not null")


def split_by_train(roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Test rows of entities the training part knows, and of the others."""
    keys = ["fold_id", "project_id"]
    train = roles.where("role = 'train'").select(*keys).distinct()
    test = roles.where("role = 'test'")
    return test.join(train, keys, "left_semi"), test.join(train, keys, "left_anti")
