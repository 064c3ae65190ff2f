"""Mixing sources to target weights with a low-discrepancy schedule.

Targets are reshared until no source is above its cap. Each source's documents
are shuffled by a keyed hash and cut into blocks of equal tokens. Slot t of the
schedule looks at the van der Corput point of t (t's bits reversed) and takes
the source under whose part of the cumulative weights it falls; the r-th slot
of a source takes its r-th block, starting over after the last one. Any stretch
of the schedule is mixed close to the weights.

No window ever spans a source: ranks and running sums are taken inside small
cells of (source, chunk), and offsets of whole cells are added from a table of
cell totals.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import whole_text, words_of
from tidewatch.session import stored


@dataclass(frozen=True)
class MixConfig:
    """Production parameters.

    weights: repeated over the sources in code point order, null last.
    total: size of the mix as a multiple of all sizes.
    cap: most that a source (and a document) gives, as a multiple of its size.
    block: words in a block.
    seed: keys the shuffle inside a source.
    cell_bits: a source is shuffled into 2**cell_bits cells, and the schedule
        is ranked in chunks of as many slots.
    """

    weights: tuple[float, ...] = (3, 1, 2)
    total: float = 1.5
    cap: float = 2.0
    block: int = 128
    seed: int = 42
    cell_bits: int = 12


def reshared(sizes: Sequence[int], weights: Sequence[float], total: float, cap: float) -> list[float]:
    """Split ``total`` by weight; what is above ``cap`` times a size goes to the rest."""
    target, left, free = [0.0] * len(sizes), total, set(range(len(sizes)))
    while free:
        whole = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / whole > cap * sizes[i]}
        if not over:
            for i in free:
                target[i] = left * weights[i] / whole
            break
        for i in over:
            target[i] = cap * sizes[i]
            left -= target[i]
        free -= over
    return target


def source_targets(sizes: DataFrame, cfg: MixConfig) -> DataFrame:
    """source, source_size, target, n_blocks, quota and the source's place in the schedule.

    One row per source; the resharing reads these few rows on the driver.
    """
    spark = sizes.sparkSession
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    given = [r["source_size"] for r in rows]
    weights = [cfg.weights[i % len(cfg.weights)] for i in range(len(rows))]
    targets = reshared(given, weights, cfg.total * sum(given), cfg.cap)
    out, low = [], 0
    for no, (r, target) in enumerate(zip(rows, targets, strict=True)):
        size, blocks = r["source_size"], -(-r["source_size"] // cfg.block)
        quota = _quota(target, size, blocks, cfg.block)
        out.append((no, r["source"], size, float(target), blocks, quota, low, low + quota))
        low += quota
    return spark.createDataFrame(out, "source_no int, source string, source_size long, target double, "
                                      "n_blocks long, quota long, low long, high long")


def _quota(target: float, size: int, blocks: int, block: int) -> int:
    """Slots whose blocks, taken in turn, come nearest to the target."""
    if not size:
        return 0
    passes, rest = divmod(target, size)
    whole = int(passes) * blocks
    full, part = divmod(rest, block)
    last = min(block, size - int(full) * block)
    return whole + int(full) + (1 if last and part > last / 2 else 0)


def _reversed_bits(t: Column) -> Column:
    """The 64 bits of ``t`` in opposite order."""
    for shift, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F),
                        (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        m = F.lit(mask)
        t = F.shiftrightunsigned(t, shift).bitwiseAND(m).bitwiseOR(F.shiftleft(t.bitwiseAND(m), shift))
    return F.shiftrightunsigned(t, 32).bitwiseOR(F.shiftleft(t, 32))


def van_der_corput(t: Column) -> Column:
    """The base-2 radical inverse of ``t``, in [0, 1), to 53 bits."""
    return F.shiftrightunsigned(_reversed_bits(t), 11) / F.lit(float(2**53))


def schedule(sources: DataFrame, cfg: MixConfig) -> DataFrame:
    """(slot, source_no, rank): rank counts a source's slots from 0 to its quota.

    A source that the points favour by a few slots loses its last ones, and one
    that they miss by a few gets them at the end, so quotas are met exactly.
    """
    n = int(sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0])
    spark = sources.sparkSession
    cells = 1 << cfg.cell_bits
    width = max(1, -(-n // cells))
    at = F.floor(van_der_corput(F.col("slot")) * n).cast("long")
    points = spark.range(n).withColumnRenamed("id", "slot").withColumn("at", at).withColumn(
        "cell", F.floor(F.col("at") / width).cast("long"))
    # a source's stretch is listed under each cell that it touches, so that the
    # look-up is an equality join with few rows a cell
    stretch = sources.filter("quota > 0").select("source_no", "quota", "low", "high", F.explode(F.sequence(
        F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))).alias("cell"))
    hit = points.join(stretch, "cell").filter("at >= low and at < high").select(
        "slot", "source_no", "quota", F.floor(F.col("slot") / cells).alias("chunk"))
    inside = Window.partitionBy("source_no", "chunk").orderBy("slot")
    before = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    seen = hit.groupBy("source_no", "chunk").agg(F.count("*").alias("n")).select(
        "source_no", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = hit.withColumn("in_chunk", F.row_number().over(inside) - 1).join(seen, ["source_no", "chunk"]).select(
        "slot", "source_no", "quota", (F.col("in_chunk") + F.col("earlier")).alias("rank"))
    got = hit.groupBy("source_no").agg(F.count("*").alias("got"))
    short = sources.join(got, "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < quota")
    late = short.select((F.lit(n) + F.col("low") + F.col("got")).alias("first"), "source_no", "got", F.explode(
        F.sequence(F.col("got"), F.col("quota") - 1)).alias("rank")).select(
        (F.col("first") + F.col("rank") - F.col("got")).alias("slot"), "source_no", "rank")
    return ranked.filter("rank < quota").select("slot", "source_no", "rank").unionByName(late)


def _placed(sized: DataFrame, cfg: MixConfig) -> DataFrame:
    """Each document's stretch [start, stop) in the shuffled words of its source."""
    keyed = sized.withColumn("cell", F.shiftrightunsigned("key", 64 - cfg.cell_bits))
    inside = Window.partitionBy("source_no", "cell").orderBy("key", "doc_id", "row_no").rowsBetween(
        Window.unboundedPreceding, 0)
    before = Window.partitionBy("source_no").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = keyed.groupBy("source_no", "cell").agg(F.sum("size").alias("n")).select(
        "source_no", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    return keyed.withColumn("upto", F.sum("size").over(inside)).join(cells, ["source_no", "cell"]).withColumn(
        "stop", F.col("upto") + F.col("earlier")).withColumn("start", F.col("stop") - F.col("size"))


def _key(cfg: MixConfig, id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit(cfg.seed), F.col(id_col), whole_text(text_col))


def mixed(docs: DataFrame, cfg: MixConfig = MixConfig(), id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies.

    size counts words (null text: 0); taken is how many of the document's words
    the mix takes, repeats counted, never above cap times its size; copies is
    taken over size, rounded half up, for mixes of whole documents. A null
    source is a source. A document without words is never taken. Repeated rows
    are separate documents; an empty table gives no rows; extra columns are
    ignored. Reruns agree: the shuffle is keyed by id and text, and row numbers
    only order rows that repeat both.
    """
    return _planned(docs, cfg, id_col, text_col, source_col).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")


def _planned(docs: DataFrame, cfg: MixConfig, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The columns of ``mixed`` with source and key of the row."""
    text = whole_text(text_col)
    sized = stored(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.size(words_of(text)).cast("long").alias("size"), _key(cfg, id_col, text_col).alias("key"),
        F.monotonically_increasing_id().alias("row_no")), "sizes")
    sources = source_targets(sized, cfg)
    known = sized.join(
        sources.select("source_no", F.col("source").alias("name"), "source_size", "target"),
        F.col("source").eqNullSafe(F.col("name")))
    placed = _placed(known, cfg)
    blocks = F.sequence(F.floor(F.col("start") / cfg.block), F.floor((F.col("stop") - 1) / cfg.block))
    parts = placed.filter("size > 0").select("row_no", "source_no", "start", "stop", F.explode(blocks).alias("block"))
    parts = parts.withColumn("words", F.least(F.col("stop"), (F.col("block") + 1) * cfg.block)
                             - F.greatest(F.col("start"), F.col("block") * cfg.block))
    times = schedule(sources, cfg).join(sources.select("source_no", "n_blocks"), "source_no").groupBy(
        "source_no", F.pmod("rank", "n_blocks").alias("block")).agg(F.count("*").alias("times"))
    taken = parts.join(times, ["source_no", "block"]).groupBy("row_no").agg(
        F.sum(F.col("words") * F.col("times")).alias("taken"))
    out = known.join(taken, "row_no", "left").select(
        "doc_id", known["source"], "key", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return out.withColumn("copies", F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))))
                          .otherwise(0).cast("int"))


def mix_documents(docs: DataFrame, cfg: MixConfig = MixConfig(), id_col: str = "doc_id", text_col: str = "text",
                  source_col: str = "source") -> DataFrame:
    """The documents of the mix with their columns, each as often as its copies say.

    Rows are found again by id, source and text, null ones too. Rows that repeat
    all three have a list of copies, which they go through one by one.
    """
    plan = stored(_planned(docs, cfg, id_col, text_col, source_col).groupBy("doc_id", "source", "key").agg(
        F.sort_array(F.collect_list("copies"), asc=False).alias("list")).filter(F.get("list", F.lit(0)) > 0), "copies")
    # whole rows travel as one column, so that no name can clash
    keyed = docs.select(
        F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("own_id"), F.col(source_col).cast("string").alias("own_source"),
        _key(cfg, id_col, text_col).alias("own_key"))
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & F.col("own_source").eqNullSafe(F.col("source")) & (
        F.col("own_key") == F.col("key"))
    alone = keyed.join(plan.filter(F.size("list") == 1), same).withColumn("copies", F.get("list", F.lit(0)))
    turn = F.row_number().over(Window.partitionBy("own_id", "own_source", "own_key").orderBy(F.xxhash64("row")))
    several = keyed.join(plan.filter(F.size("list") > 1), same).withColumn("copies", F.get("list", turn - 1))
    return alone.union(several).filter("copies > 0").select(
        "row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
