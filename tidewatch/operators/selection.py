"""Exact percentiles of many columns at once, by refining histograms.

A double is read as 64 bits in the order of its value. Each round scans the
columns that are still open, as columns, and counts the next twelve bits of the
values that share the bits found so far; the bin that holds a wanted rank gives
twelve more. Once few values are left in a bin they are fetched. Nothing is
unpivoted, sorted, shuffled by value or written; what reaches the driver is
bounded by the columns, the ranks and the bins.

Every round reads the table anew (two or three, six at most), so pass a stored
one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits a round adds, and how many values of a bin are fetched rather than counted again.
BITS, FEW = 12, 1024
TOP = np.uint64(1 << 63)


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order; both zeros are one, NaN comes last."""
    bits = (values + 0.0).view(np.uint64)
    bits = np.where(np.isnan(values), np.uint64(0x7FF8000000000000), bits)
    return np.where(bits & TOP, ~bits, bits | TOP)


def from_bits(key: int) -> float:
    raw = key ^ (1 << 63) if key >> 63 else ~key & ((1 << 64) - 1)
    return float(np.array([raw], np.uint64).view(np.float64)[0])


def _counts(batches: Iterator[pa.RecordBatch], open_bins: dict[int, list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """(col, prefix, known, key, n): counts of the next bits behind each prefix of ``known`` bits; whole keys where known is 64."""
    held: dict[tuple[int, int, int], list] = {}
    for batch in batches:
        for at, c in enumerate(sorted(open_bins)):
            col = batch.column(at)
            keys = ordered_bits(col.drop_null().to_numpy(zero_copy_only=False).astype(np.float64))
            for prefix, known in open_bins[c]:
                fetch = known < 0
                bits = -known if fetch else known
                mine = keys if not bits else keys[keys >> np.uint64(64 - bits) == np.uint64(prefix)]
                if not fetch:
                    step = min(BITS, 64 - bits)
                    mine = (mine >> np.uint64(64 - bits - step)) & np.uint64((1 << step) - 1)
                held.setdefault((c, prefix, known), []).append(np.unique(mine, return_counts=True))
    rows = {k: [] for k in ("col", "prefix", "known", "key", "n")}
    for (c, prefix, known), parts in held.items():
        u, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(u)).astype(np.int64)
        for name, v in (("col", c), ("prefix", np.uint64(prefix).astype(np.int64)), ("known", known)):
            rows[name].append(np.full(len(u), v, np.int64))
        rows["key"].append(u.astype(np.int64))
        rows["n"].append(n)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in rows.values()], names=list(rows))


def _round(df: DataFrame, columns: Sequence[str], open_bins: dict[int, list[tuple[int, int]]]) -> dict[tuple[int, int, int], list[tuple[int, int]]]:
    wide = df.select(*[F.col(columns[c]).cast("double").alias(f"c{c}") for c in sorted(open_bins)])
    found = wide.mapInArrow(lambda it: _counts(it, open_bins), "col long, prefix long, known long, key long, n long").groupBy(
        "col", "prefix", "known", "key").agg(F.sum("n").alias("n")).collect()
    out: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    word = (1 << 64) - 1
    for r in found:
        out.setdefault((r["col"], r["prefix"] & word, r["known"]), []).append((r["key"] & word, r["n"]))
    return {k: sorted(v) for k, v in out.items()}


def order_statistics(df: DataFrame, columns: Sequence[str], ranks) -> tuple[list[int], dict[tuple[int, int], float]]:
    """Rows with a value per column, and the values at ``ranks(n)`` (from 0) of each column by (column, rank)."""
    first = _round(df, columns, {c: [(0, 0)] for c in range(len(columns))})
    sizes = [sum(n for _, n in first.get((c, 0, 0), [])) for c in range(len(columns))]
    # (column, rank) -> prefix, known bits, rank behind the prefix
    state = {(c, r): (0, 0, r) for c, n in enumerate(sizes) for r in ranks(n)}
    counts, done = first, {}
    while state:
        following, fetch = {}, set()
        for (c, r), (prefix, known, left) in state.items():
            for key, n in counts[(c, prefix, known)]:
                if left < n:
                    break
                left -= n
            if known < 0:
                done[c, r] = from_bits(key)
                continue
            bits = known + min(BITS, 64 - known)
            prefix = prefix << (bits - known) | key
            if bits == 64:
                done[c, r] = from_bits(prefix)
                continue
            following[c, r] = (prefix, -bits if n <= FEW else bits, left)
        state, open_bins = following, {}
        for (c, _), (prefix, known, _) in state.items():
            open_bins.setdefault(c, set()).add((prefix, known))
        if state:
            counts = _round(df, columns, {c: sorted(v) for c, v in open_bins.items()})
    return sizes, done


def column_percentiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], name: str = "feature") -> DataFrame:
    """One row per column: its name and the linear-interpolated percentiles p0, p1, ..., NULL without a value.

    Exact at any size. Runs the rounds' jobs.
    """
    def wanted(n: int) -> set[int]:
        return {r for p in probs for r in (int(np.floor((n - 1) * p)), int(np.ceil((n - 1) * p)))} if n else set()

    sizes, found = order_statistics(df, columns, wanted)
    rows = []
    for c, n in enumerate(sizes):
        parts: list[float | None] = []
        for p in probs:
            at = (n - 1) * p
            low, high = int(np.floor(at)), int(np.ceil(at))
            parts.append(found[c, low] + (found[c, high] - found[c, low]) * (at - low) if n else None)
        rows.append((columns[c], *parts))
    schema = f"`{name}` string, " + ", ".join(f"p{i} double" for i in range(len(probs)))
    return df.sparkSession.createDataFrame(rows, schema)


def column_moments(df: DataFrame, columns: Sequence[str], name: str = "feature") -> DataFrame:
    """One row per column: name, row_count, present, mean, std; from one aggregation over the columns as they are."""
    wide = df.agg(F.count("*").alias("rows"), *[F.struct(
        F.count(c).alias("present"), F.avg(F.col(c).cast("double")).alias("mean"), F.stddev_samp(F.col(c).cast("double")).alias("std")).alias(f"m{i}")
        for i, c in enumerate(columns)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col("rows").alias("row_count"), F.col(f"m{i}.present").alias("present"),
                                        F.col(f"m{i}.mean").alias("mean"), F.col(f"m{i}.std").alias("std")) for i, c in enumerate(columns)]))
    return wide.select(each.alias("e")).select("e.*")
