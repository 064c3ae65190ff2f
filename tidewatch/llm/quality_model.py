"""Quality classifier: naive Bayes support vectors on n-gram indicators.

A text has the n-grams of its characters and of the shapes of its words (which
kinds of characters a word has, and whether it repeats the word before). Each
n-gram that occurs is an indicator, scaled by the log ratio of its smoothed
frequencies in good and bad texts. On these vectors a linear hinge-loss model
is fitted by dual coordinate descent, and its margins become probabilities by
a sigmoid fitted to margins of texts that a fold did not train on.

The fit sees a bounded sample of labelled rows, in one task; the model has a
fixed number of positions. Scoring needs no shuffle and reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import slices

SLICE_BYTES = 1 << 20
#: Characters of a text handled at once; n-grams across the seam are counted with the later part.
PART = 1 << 18


@dataclass(frozen=True)
class QualityModelConfig:
    """Production parameters.

    fit_rows: most labelled rows that the fit sees, the first by a hash of
        their ids; all statistics of the model come from these.
    bits: an n-gram's position is its hash modulo 2**bits.
    chars, shapes: lengths of the n-grams of characters and of word shapes.
    min_rows: rows of the sample that an n-gram must occur in.
    smooth: added to every n-gram's counts.
    cost: bound of a dual variable; bad rows count ``bad_weight`` times that.
    epochs: most passes over the sample. folds: for the sigmoid.
    """

    fit_rows: int = 20_000
    bits: int = 18
    chars: tuple[int, ...] = (1, 2, 3)
    shapes: tuple[int, ...] = (1, 2, 3, 4)
    min_rows: int = 3
    smooth: float = 1.0
    cost: float = 10.0
    bad_weight: float = 2.0
    epochs: int = 30
    folds: int = 3


@dataclass(frozen=True)
class QualityModel:
    weight: np.ndarray  # weight times scale, by position
    square: np.ndarray  # scale squared, by position
    bias: float
    slope: float
    shift: float


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Bits of a code point: white space, lower case, upper case, other letter, digit, mark."""
    out = np.full(0x110000, 32, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = 2 if c.islower() else 4 if c.isupper() else 8
        elif c.isdigit():
            out[i] = 16
    out[[9, 10, 11, 12, 13, 32]] = 1
    return out


def _mixed(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _grams(x: np.ndarray, orders: tuple[int, ...], seed: int) -> Iterator[np.ndarray]:
    x = x.astype(np.uint64)
    h = np.full(len(x), seed, np.uint64)
    for n in range(1, max(orders, default=0) + 1):
        if len(x) < n:
            return
        h = _mixed(h[:len(x) - n + 1], x[n - 1:])
        if n in orders:
            yield h ^ np.uint64(n)


class Indicator:
    """Distinct positions of a text's n-grams; holds one array of 2**bits stamps."""

    def __init__(self, cfg: QualityModelConfig) -> None:
        self.cfg = cfg
        self.stamp = np.zeros(1 << cfg.bits, np.int32)

    def positions(self, text: str) -> np.ndarray:
        cfg, mask = self.cfg, np.uint64((1 << self.cfg.bits) - 1)
        chars = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _kinds()[chars]
        space = kind == 1
        keep = np.ones(len(chars), bool)
        keep[1:] = ~(space[1:] & space[:-1])
        chars, kind, space = np.where(space, 32, chars)[keep], kind[keep], space[keep]
        found = []
        longest = max(cfg.chars, default=1)
        for a in range(0, len(chars), PART):
            part = chars[max(0, a - longest + 1):a + PART]
            found.append(self._distinct(np.concatenate([np.empty(0, np.uint64), *_grams(part, cfg.chars, 1)]) & mask))
        first = np.flatnonzero(~space[1:] & space[:-1]) + 1
        if len(first):
            bits = np.bitwise_or.reduceat(np.where(space, 0, kind), first).astype(np.int64)
            ends = np.r_[first[1:], len(chars)]
            within = np.arange(first[0], len(chars)) - np.repeat(first, ends - first)
            h = np.zeros(len(chars), np.uint64)
            h[first[0]:] = np.where(space[first[0]:], np.uint64(0), _mixed(within.astype(np.uint64) + np.uint64(7), chars[first[0]:].astype(np.uint64)))
            name = np.add.reduceat(h, first)
            same = np.r_[False, name[1:] == name[:-1]]
            shape = bits << 2 | (kind[first] == 4) << 1 | same
            found.append(self._distinct(np.concatenate([np.empty(0, np.uint64), *_grams(shape, cfg.shapes, 2)]) & mask))
        return self._distinct(np.concatenate(found)) if len(found) > 1 else found[0]

    def _distinct(self, at: np.ndarray) -> np.ndarray:
        at = at.astype(np.int32)
        number = np.arange(len(at), dtype=np.int32)
        self.stamp[at] = number
        return at[self.stamp[at] == number]


def descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, bound: np.ndarray, size: int, epochs: int, seed: int = 1) -> np.ndarray:
    """Dual coordinate descent for the linear hinge loss: rows of (positions, values), y of +1 or -1, bounds of the duals."""
    w, alpha = np.zeros(size), np.zeros(len(rows))
    square = np.array([float(v @ v) for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)).tolist():
            at, v = rows[i]
            slope = y[i] * float(w[at] @ v) - 1
            old = alpha[i]
            # at a bound only a slope that leads away from it counts
            if (old == 0 and slope > 0) or (old == bound[i] and slope < 0) or square[i] == 0:
                continue
            worst = max(worst, abs(slope))
            new = min(max(old - slope / square[i], 0.0), bound[i])
            if new != old:
                alpha[i] = new
                w[at] += (new - old) * y[i] * v
        if worst < 1e-2:
            break
    return w


def sigmoid(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability of a good row given its margin, by damped Newton steps."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))

    def loss(a: float, b: float) -> float:
        z = a * margins + b
        return float((np.logaddexp(0, z) - target * z).sum())

    now = loss(a, b)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        d, s = p - target, p * (1 - p)
        g = np.array([(d * margins).sum(), d.sum()])
        hess = np.array([[(s * margins * margins).sum() + 1e-9, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(hess, g)
        rate = 1.0
        while rate > 1e-8 and (less := loss(a - rate * step[0], b - rate * step[1])) > now:
            rate /= 2
        if rate <= 1e-8 or now - less < 1e-9:
            break
        a, b, now = a - rate * step[0], b - rate * step[1], less
    return float(a), float(b)


def _scales(found: list[np.ndarray], good: np.ndarray, cfg: QualityModelConfig) -> np.ndarray:
    """Log ratio of smoothed n-gram frequencies in good and bad rows; zero for n-grams of too few rows."""
    size = 1 << cfg.bits
    counts = np.zeros((2, size))
    for at, g in zip(found, good.tolist(), strict=True):
        counts[int(g)][at] += 1
    known = counts.sum(axis=0) >= cfg.min_rows
    part = (counts + cfg.smooth) * known
    return np.where(known, np.log(np.where(known, part[1] / part[1].sum() / np.where(known, part[0] / part[0].sum(), 1), 1)), 0.0)


def _vectors(found: list[np.ndarray], scale: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Scaled indicators with a constant at the last position, each row of length one."""
    out = []
    for at in found:
        at = at[scale[at] != 0]
        v = np.append(scale[at], 1.0)
        out.append((np.append(at, len(scale)), v / np.sqrt(v @ v)))
    return out


def fit(found: list[np.ndarray], good: np.ndarray, cfg: QualityModelConfig) -> QualityModel:
    """Model of rows given by the positions of their n-grams. Rows of one class only give that class."""
    size = 1 << cfg.bits
    if not len(good) or good.all() or not good.any():
        return QualityModel(np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, 1.0,
                            0.0 if not len(good) else (1 if good.all() else -1) * float(np.log(len(good) + 1)))
    y, bound = np.where(good, 1.0, -1.0), np.where(good, cfg.cost, cfg.cost * cfg.bad_weight)

    def solved(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scale = _scales([found[i] for i in rows], good[rows], cfg)
        return scale, descend(_vectors([found[i] for i in rows], scale), y[rows], bound[rows], size + 1, cfg.epochs)

    fold, margins, held = np.arange(len(good)) % cfg.folds, np.zeros(len(good)), np.zeros(len(good), bool)
    for k in range(cfg.folds):
        rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if good[rest].any() and not good[rest].all():
            scale, w = solved(rest)
            margins[own] = [float(w[at] @ v) for at, v in _vectors([found[i] for i in own], scale)]
            held[own] = True
    scale, w = solved(np.arange(len(good)))
    slope, shift = sigmoid(margins[held], good[held]) if held.any() else (1.0, 0.0)
    return QualityModel((w[:-1] * scale).astype(np.float32), (scale * scale).astype(np.float32), float(w[-1]), slope, shift)


def _label_sample(labels: DataFrame, id_col: str, quality_col: str, cfg: QualityModelConfig) -> DataFrame:
    """At most ``fit_rows`` ids with their labels, the first by hash; of several labels of an id the worst counts."""
    return labels.filter(F.col(id_col).isNotNull() & F.col(quality_col).isNotNull()).groupBy(
        F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(quality_col).cast("int")).alias("good")).orderBy(
        F.xxhash64("id"), "id").limit(cfg.fit_rows)


def train(docs: DataFrame, labels: DataFrame, cfg: QualityModelConfig = QualityModelConfig(), id_col: str = "doc_id",
          text_col: str = "text", quality_col: str = "quality") -> QualityModel:
    """Learn which texts are marked 1 in ``labels``; ``docs`` and ``labels`` meet by id.

    The fit sees at most ``fit_rows`` ids and as many rows, so it fits one
    task, and the model of 2**bits positions the driver. Ids or labels that are
    null are ignored. Without labelled rows every score is one half.
    """
    wanted = F.broadcast(_label_sample(labels, id_col, quality_col, cfg))  # at most fit_rows ids
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indicator = Indicator(cfg)
        for part in slices(batches, "text", SLICE_BYTES):
            at = [np.sort(indicator.positions(t)).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("good"), pa.array(at, pa.binary())], names=["id", "good", "at"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, good = [], []
        for batch in batches:
            at += [np.frombuffer(x, np.int32) for x in batch.column("at").to_pylist()]
            good += batch.column("good").to_pylist()
        m = fit(at, np.array(good, np.int64) == 1, cfg)
        yield pa.RecordBatch.from_arrays(
            [pa.array([m.weight.tobytes()], pa.binary()), pa.array([m.square.tobytes()], pa.binary()), pa.array([[m.bias, m.slope, m.shift]], pa.list_(pa.float64()))],
            names=["weight", "square", "rest"])

    sample = rows.join(wanted, "id").mapInArrow(found, "id long, good int, at binary")
    first = sample.orderBy(F.xxhash64("id", "at"), "id", "good").limit(cfg.fit_rows)
    got = first.coalesce(1).mapInArrow(fitted, "weight binary, square binary, rest array<double>").first()
    return QualityModel(np.frombuffer(got["weight"], np.float32), np.frombuffer(got["square"], np.float32), *got["rest"])


def score(docs: DataFrame, model: QualityModel, cfg: QualityModelConfig = QualityModelConfig(), id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1, higher for texts that look good). No shuffle.

    A null text counts as empty; an empty one has the score of the constant
    alone. Equal texts score alike; extra columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits positions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, indicator = shipped.value, Indicator(cfg)
        for part in slices(batches, "text", SLICE_BYTES):
            margins = []
            for text in part.column("text").to_pylist():
                at = indicator.positions(text)
                margins.append((float(m.weight[at].sum(dtype=np.float64)) + m.bias) / np.sqrt(float(m.square[at].sum(dtype=np.float64)) + 1))
            p = 1 / (1 + np.exp(-np.clip(m.slope * np.array(margins) + m.shift, -500, 500)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def predicted(score_col: Column, threshold: float = 0.7) -> Column:
    return (score_col >= threshold).cast("int")
