"""Exact dedup: a tree merge of sorted digest runs, in built-in functions only.

Every scan partition is a run of (digest, smallest id, count), sorted and
combined by digest. ``fan_in`` runs meet per round: round r lets the runs whose
numbers differ in digit r exchange rows, each row going to the run that has the
digit r of the row's own slot. After log(runs) rounds a digest has reached the
one run that its slot names, and no run has held more than its share of the
distinct digests. Each level merges equal digests at once, so however many
copies a text has, at most ``fan_in`` rows of it meet in any task.

Rows are the same text when SHA-256, byte length and a second, independent
64-bit hash all agree; the three form the merge key at every level, so a
smallest identifier is never taken from a text that merely shares a digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import SPACES, shuffle_parts, whole_text
from tidewatch.session import stored

KEY = ["digest", "n_bytes", "proof"]


def tree_shape(parts: int, fan_in: int) -> tuple[int, int]:
    """Rounds and runs: the smallest power of ``fan_in`` that covers ``parts``."""
    rounds = 1
    while fan_in**rounds < parts:
        rounds += 1
    return rounds, fan_in**rounds


def _normal(text_col: str) -> Column:
    return F.regexp_replace(whole_text(text_col), SPACES, " ")


def _key(norm: Column) -> list[Column]:
    values = [F.unhex(F.sha2(norm, 256)), F.octet_length(norm), F.xxhash64(norm)]
    return [v.alias(k) for k, v in zip(KEY, values, strict=True)]


def digest_rows(docs: DataFrame, runs: int, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: id, row number, run and merge key. No shuffle."""
    plain = docs.select(F.col(id_col).alias("doc_id"), _normal(text_col).alias("norm"))
    return plain.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row_no"),
        F.pmod(F.spark_partition_id(), F.lit(runs)).cast("int").alias("run"),
        *_key(F.col("norm")),
    )


def _merge(rows: DataFrame, runs: int) -> DataFrame:
    """Place each row in the partition its run names, then merge equal digests."""
    return (
        rows.repartitionById(runs, F.col("run"))
        .groupBy("run", *KEY)
        .agg(F.min("head").alias("head"), F.sum("n").alias("n"))
    )


def _next_run(round_no: int, fan_in: int, runs: int) -> Column:
    unit = fan_in**round_no
    slot = F.pmod(F.col("proof"), F.lit(runs))
    digit = lambda c: F.pmod(F.floor(c / unit), F.lit(fan_in))
    return (F.col("run") + (digit(slot) - digit(F.col("run"))) * unit).cast("int")


def _grouped(docs: DataFrame, id_col: str, text_col: str, fan_in: int) -> DataFrame:
    """Every row with its run, key, group size ``n`` and the ``head`` that stays."""
    rounds, runs = tree_shape(shuffle_parts(docs), fan_in)
    rows = stored(digest_rows(docs, runs, id_col, text_col), "digests")
    head = F.struct(F.isnull("doc_id").alias("last"), "doc_id", "row_no")
    own = _merge(rows.select("run", *KEY, head.alias("head"), F.lit(1).cast("long").alias("n")), runs)
    level = own
    for r in range(rounds):
        level = _merge(level.withColumn("run", _next_run(r, fan_in, runs)), runs)
    # the verdict goes back down by way of the runs: a text with very many
    # copies has one row per run here, so no key is hot in the last join
    verdict = own.select("run", *KEY).join(level.drop("run"), KEY)
    return rows.join(verdict, ["run", *KEY])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each white-space run became one
    space. A null text is the empty text. Of equal texts the smallest id stays
    (null ids count as largest); if the row itself is repeated, exactly one of
    the repeats is kept. An empty table gives no rows; extra columns are
    ignored. Ids may be of any ordered type.
    """
    return _grouped(docs, id_col, text_col, fan_in).select(
        "doc_id",
        F.col("head.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row_no") == F.col("head.row_no")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """The rows of ``docs`` that stay, one a text, with all their columns.

    Rows are found again by id and text, so null ids and ids that several texts
    share lose nothing; rows that repeat both collapse to one.
    """
    stays = _grouped(docs, id_col, text_col, fan_in).filter(F.col("row_no") == F.col("head.row_no")).select(
        F.col("doc_id").alias("kept_id"), *[F.col(k).alias(f"kept_{k}") for k in KEY])
    # whole rows travel as one column, so that no name can clash
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), _normal(text_col).alias("norm")).select(
        "row", "id", *[c.alias(k) for k, c in zip(KEY, _key(F.col("norm")), strict=True)])
    same = F.col("id").eqNullSafe(F.col("kept_id"))
    for k in KEY:
        same &= F.col(k) == F.col(f"kept_{k}")
    return keyed.join(stays, same, "left_semi").dropDuplicates(["id", *KEY]).select("row.*")
