"""Quality rules: an n-gram log-likelihood ratio, in built-in functions only.

Every distinct word and word pair has a counter of its own, so the model grows
with the corpus. Two multinomials are counted: one over every row, one over the
trusted rows among them. A document's score is the mean over its n-grams of
log p_trusted - log p_raw, so length does not matter, and one fixed threshold
decides every document. A document's own n-grams are left out of both counts
before it is scored and the trusted multinomial is smoothed towards the raw one,
so an n-gram that no other document has says nothing. Base rules (too few
words, repeated windows) come first.

No table of counters reaches any one place: a document's sorted n-grams travel
once, packed by the slot that their hash names, and meet there with their like.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.binding import let
from tidewatch.llm.common import shuffle_parts, whole_text, words_of
from tidewatch.session import stored


@dataclass(frozen=True)
class QualityConfig:
    """Production parameters.

    buckets: None for one counter a distinct n-gram. A number hashes into so
        many shared counters instead, add-one smoothed and broadcast, for
        vocabularies known to be small.
    prior: trusted occurrences that the smoothing adds to each n-gram, at the
        raw share.
    trusted_rows: most labelled rows that the trusted multinomial is fitted
        on, the first by hash of their id. The raw multinomial has all rows.
    threshold: least mean log-likelihood ratio (nats per n-gram) to keep.
    min_words, max_repeat_pct, window: the base rules.
    """

    buckets: int | None = None
    prior: float = 10.0
    trusted_rows: int = 20_000
    threshold: float = -0.05
    min_words: int = 20
    max_repeat_pct: int = 30
    window: int = 8


SYMBOLS = "#*$%&|<>"


def trusted_ids(labels: DataFrame, cfg: QualityConfig, id_col: str = "doc_id", flag: str = "quality = 1") -> DataFrame:
    """At most ``cfg.trusted_rows`` ids of rows labelled good, the same in every run."""
    ids = labels.filter(flag).filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id")).distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(cfg.trusted_rows)


def _grams(hashes: Column, bucket: Callable[[Column], Column]) -> Column:
    """Buckets of all words, then of all adjacent pairs."""
    pairs = F.filter(
        F.transform(hashes, lambda h, i: F.when(i + 1 < F.size(hashes), bucket(F.xxhash64(h, F.get(hashes, i + 1))))),
        lambda b: b.isNotNull())
    return F.concat(F.transform(hashes, bucket), pairs)


def _shared(cfg: QualityConfig) -> Callable[[Column], Column]:
    return lambda h: F.pmod(h, F.lit(cfg.buckets)).cast("int")


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def gram_counts(docs: DataFrame, trusted: DataFrame, cfg: QualityConfig, id_col: str, text_col: str) -> DataFrame:
    """bucket, raw, trusted counts; combined before the shuffle, at most ``buckets`` rows."""
    marked = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).join(
        F.broadcast(trusted.select("doc_id", F.lit(1).alias("hit"))), "doc_id", "left")
    grams = marked.select(
        F.coalesce("hit", F.lit(0)).alias("hit"),
        F.explode(let(_hashed(words_of(F.col("text"))), lambda h: _grams(h, _shared(cfg)))).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("hit").alias("good"))


def gram_weights(counts: DataFrame, cfg: QualityConfig) -> DataFrame:
    """One row holding the ``buckets`` log ratios, add-one smoothed.

    All zero when there is no trusted n-gram, so that only base rules decide.
    """
    slots = counts.sparkSession.range(cfg.buckets).select(F.col("id").cast("int").alias("bucket"))
    full = slots.join(counts, "bucket", "left").select(
        "bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good"))
    packed = full.agg(
        F.sort_array(F.collect_list(F.struct("bucket", "raw", "good"))).alias("s"),
        F.sum("raw").alias("n_raw"), F.sum("good").alias("n_good"))
    b = float(cfg.buckets)
    return packed.select(F.transform("s", lambda x: F.when(F.col("n_good") == 0, F.lit(0.0)).otherwise(
        F.log((x["good"] + 1.0) / (F.col("n_good") + b)) - F.log((x["raw"] + 1.0) / (F.col("n_raw") + b)))).alias("w"))


def _constant(weights: list[float]) -> Column:
    """The fitted weights as one folded array constant (``cfg.buckets`` numbers)."""
    return F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")


def _repeat_words(hashes: Column, window: int) -> Column:
    """Words lying in windows that occur twice or more in the text."""
    starts = lambda n: F.sequence(F.lit(1), n)

    def covered(wins: Column) -> Column:
        ordered = F.sort_array(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        repeated = let(ordered, lambda s: F.sort_array(F.filter(F.transform(
            s, lambda x, i: F.when(
                (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["at"])),
            lambda at: at.isNotNull())))
        return let(repeated, lambda p: F.aggregate(
            F.transform(p, lambda at, i: F.least(F.coalesce(F.get(p, i + 1) - at, F.lit(window)), F.lit(window))),
            F.lit(0).cast("long"), lambda a, x: a + x))

    def count(h: Column) -> Column:
        wins = F.transform(starts(F.size(h) - window + 1), lambda i: F.xxhash64(F.slice(h, i, window)))
        return let(wins, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long"))
                   .otherwise(covered(w)))

    return F.when(F.size(hashes) <= window, F.lit(0).cast("long")).otherwise(count(hashes))


def _mark(id_col: str, text: Column) -> list[Column]:
    """What a score hangs on: rows that agree in id and text are one document here."""
    return [F.xxhash64(F.col(id_col), text).alias("mark"), F.hash(text, F.col(id_col)).alias("proof")]


def gram_scores(docs: DataFrame, trusted: DataFrame, cfg: QualityConfig, id_col: str, text_col: str) -> DataFrame:
    """mark, proof, llr of every document with words, from one counter a distinct n-gram."""
    hits = F.broadcast(trusted.select(F.col("doc_id").alias("trusted_id"), F.lit(1).alias("hit")))
    # other columns stay behind, whatever their names
    marked = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")).join(
        hits, F.col("id") == F.col("trusted_id"), "left").select(
        *_mark("id", F.col("text")), F.coalesce("hit", F.lit(0)).alias("hit"), words_of(F.col("text")).alias("words"))
    n = F.greatest(2 * F.size("words") - 1, F.lit(0))
    total = marked.agg(F.sum(n).alias("raw"), F.sum(n * F.col("hit")).alias("good")).first()
    share = (total["good"] or 0) / (total["raw"] or 1)
    slots = 2 * shuffle_parts(docs)
    # slot in the high bits, 32 bits of the hash below: two n-grams of a slot share a counter
    # once in 4 billion
    code = lambda h: F.call_function("shiftleft", F.pmod(h, F.lit(slots)), F.lit(32)).bitwiseOR(
        F.shiftrightunsigned(h, 32))
    slot_of = lambda c: F.shiftright(c, 32).cast("int")

    def packed(g: Column) -> Column:
        heads = F.filter(
            F.transform(g, lambda c, i: F.when((i == 0) | (slot_of(c) != slot_of(F.get(g, i - 1))), i)),
            lambda i: i.isNotNull())
        return let(heads, lambda at: F.transform(at, lambda p, j: F.struct(
            slot_of(F.get(g, p)).alias("slot"),
            F.transform(F.slice(g, p + 1, F.coalesce(F.get(at, j + 1), F.size(g)) - p),
                        lambda c: (c.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).cast("int")).alias("grams"))))

    parts = let(_hashed(F.col("words")), lambda h: let(F.sort_array(_grams(h, code)), packed))
    met = marked.select("mark", "proof", "hit", F.explode(parts).alias("part")).select(
        "mark", "proof", "hit", "part.slot", "part.grams").repartitionById(slots, F.col("slot"))
    own = met.select("slot", "mark", "proof", "hit", F.explode("grams").alias("gram")).groupBy(
        "slot", "gram", "mark", "proof", "hit").agg(F.count("*").alias("own"))
    like = Window.partitionBy("slot", "gram")
    counted = own.withColumns({
        "raw": F.sum("own").over(like) - F.col("own"),
        "good": F.sum(F.col("own") * F.col("hit")).over(like) - F.col("own") * F.col("hit")})
    ratio = F.log((F.col("good") + cfg.prior) / (F.col("raw") * share + cfg.prior))
    return counted.groupBy("mark", "proof").agg(
        (F.sum(F.col("own") * ratio) / F.sum("own")).alias("llr"))


def _judged(docs: DataFrame, trusted: DataFrame, cfg: QualityConfig, id_col: str, text_col: str,
            measures: Callable[[], list[Column]]) -> DataFrame:
    """Base counts, score and verdict ``v`` of each row, beside its ``measures``; those read ``row`` and ``text``."""
    text = F.col("text")
    rows = docs.select(F.struct("*").alias("row"), whole_text(text_col).alias("text"))
    w = None if cfg.buckets is None else _constant(
        gram_weights(gram_counts(docs, trusted, cfg, id_col, text_col), cfg).first()["w"])

    def measured(h: Column) -> Column:
        llr = F.lit(None).cast("double") if w is None else let(
            _grams(h, _shared(cfg)), lambda g: F.when(F.size(g) > 0, F.aggregate(
                g, F.lit(0.0), lambda a, b: a + F.get(w, b)) / F.size(g)))
        return F.struct(F.size(h).cast("long").alias("n_words"), _repeat_words(h, cfg.window).alias("n_repeat_words"),
                        llr.alias("llr"))

    def decided(m: Column) -> Column:
        failed = (m["n_words"] < cfg.min_words) | (100 * m["n_repeat_words"] > cfg.max_repeat_pct * m["n_words"])
        good = ~failed & (F.coalesce(m["llr"], F.lit(0.0)) >= cfg.threshold)
        return F.struct(m["n_words"].alias("n_words"), m["n_repeat_words"].alias("n_repeat_words"), m["llr"].alias("llr"),
                        failed.alias("base_failed"), good.alias("kept"))

    # one expression that names every intermediate value: a filter on it may be
    # pushed down and inlined without repeating any work
    verdict = let(let(_hashed(words_of(text)), measured), decided)
    if w is not None:
        return rows.select(*measures(), verdict.alias("v"))
    scores = stored(gram_scores(docs, trusted, cfg, id_col, text_col), "scores")
    at = [m.alias(f"__{k}") for k, m in zip(("mark", "proof"), _mark(f"row.{id_col}", text), strict=True)]
    judged = rows.select(*measures(), *at, verdict.alias("v")).join(
        scores.select(F.col("mark").alias("__mark"), F.col("proof").alias("__proof"), "llr"), ["__mark", "__proof"], "left")
    good = ~F.col("v.base_failed") & (F.coalesce("llr", F.lit(0.0)) >= cfg.threshold)
    return judged.withColumn("v", F.col("v").withField("llr", F.col("llr")).withField("kept", good)).drop(
        "__mark", "__proof", "llr")


def quality(docs: DataFrame, trusted: DataFrame, cfg: QualityConfig = QualityConfig(), id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """One row per input row with base counts, score and verdict.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, kept (boolean), llr (double, null without words).

    A null or empty text has no words, so it fails the base rule. Repeated rows
    and null ids are judged row by row (a null id is never trusted). An empty
    table gives no rows; extra columns are ignored.
    """
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    return _judged(docs, trusted, cfg, id_col, text_col, lambda: [
        F.col("row").getField(id_col).alias("doc_id"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    ]).select("doc_id", "v.n_words", "word_chars", "n_symbols", "n_dup_lines", "v.n_repeat_words", "v.base_failed",
              "v.kept", "v.llr")


def keep_good(docs: DataFrame, trusted: DataFrame, cfg: QualityConfig = QualityConfig(), id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, each judged on its own, with all their columns."""
    return _judged(docs, trusted, cfg, id_col, text_col, lambda: [F.col("row")]).filter("v.kept").select("row.*")
