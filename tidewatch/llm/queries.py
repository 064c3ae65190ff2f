"""Registered queries of the text operators, with checking SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import exact_dedup, golay_simhash, language_id, line_dedup, merge_rounds, mixing, quality_model, quality_rules, repeated_bytes, spelling, token_counts, training_order, turn_repair
from tidewatch.plans.panel import table
from tidewatch.session import fresh_path

#: The tokenizer of the token queries, and the most tokens a document should have.
PIECE_MODEL, TOKEN_LIMIT = "piece_bpe_32k.model", 4096

BUILDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def tokenizer_path(name: str = PIECE_MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, check: str | None = None):
    def add(fn):
        BUILDERS[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn
    return add


EXACT_SQL = r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from d
"""


@query("op1_exact_dedup", EXACT_SQL)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes.without_repeats(table(spark, sf_dir, "documents"))


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    model = language_id.train(docs.filter(~held))
    named = language_id.predict(docs, model)
    return named.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), TOKEN_LIMIT)


@query("op5_training_order")
def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialise(table(spark, sf_dir, "documents"), fresh_path(spark, "shards"), tokenizer_path())


@query("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality_rules.trusted_ids(table(spark, sf_dir, "labels"), quality_rules.QualityConfig())
    return quality_rules.quality(table(spark, sf_dir, "documents"), trusted)


@query("op7_line_dedup")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeated_lines(table(spark, sf_dir, "documents"))


@query("op8_mixing")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


@query("op9_sentencepiece")
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_rounds.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay_simhash.near_groups(table(spark, sf_dir, "documents"))


@query("op11_turn_repair")
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    report = turn_repair.repair_report(turn_repair.damaged(rows))
    same = F.col("conv_id").eqNullSafe(F.col("known"))
    counts = [F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in turn_repair.COUNTS]
    return rows.select(F.col("conv_id").alias("known")).distinct().join(report, same, "left").select(
        F.col("known").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(turn_repair.EMPTY_SHA)).alias("repaired_sha256"))


@query("op12_spelling_variants")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), typo_every=97))


@query("op13_quality_classifier")
def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))
    scored = quality_model.score(docs, quality_model.train(docs, labels.filter(~held)))
    return scored.select("doc_id", held.alias("held_out"), "score", quality_model.predicted(F.col("score")).alias("predicted"))
