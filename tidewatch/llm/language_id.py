"""Language identification with bit-sliced n-gram Bloom filters.

Every position of the filter holds one bit per language; the three positions of
an n-gram, and-ed, name at once all languages that may contain it. Per
language the hits of a document are counted, corrected for the false positives
that the language's fill makes likely, and the largest corrected share decides.

Training counts every n-gram of every training row in Spark; a language's
filter gets the n-grams that are about as frequent in it as in any other. The
members are counted before the filter is made, and its size follows from them
and the rate of false hits that is allowed.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import slices
from tidewatch.session import stored

log = logging.getLogger(__name__)

SLICE_BYTES = 2 << 20
SPACE = 32


@dataclass(frozen=True)
class LangConfig:
    """Production parameters.

    orders: lengths of the n-grams, a word's edges counting as one space.
    hashes: positions of an n-gram.
    false_hits: most false hits of a foreign n-gram, by which the filter gets
        its size from the counted members of its fullest language.
    bits: None for that, or a number for 2**bits positions whatever the members.
    min_count: least occurrences in a language's training text.
    least_part: least relative frequency in a language's training text. So a
        language has at most 1 / least_part members however large the corpus,
        and with the other settings here the filter at most 2**23 positions (8
        bytes each for every 64 languages).
    share: an n-gram belongs to a language if its relative frequency there is
        at least this part of its largest over the languages.
    """

    orders: tuple[int, ...] = (2, 3, 4)
    hashes: int = 3
    false_hits: float = 0.001
    bits: int | None = None
    min_count: int = 3
    least_part: float = 2.0**-18
    share: float = 0.5


@dataclass(frozen=True)
class LangModel:
    langs: list[str]  # by code point
    masks: np.ndarray  # (words of 64 languages, positions)
    fill: np.ndarray  # part of the positions that are set, by language
    wrong: np.ndarray  # probability that a foreign n-gram hits, by language
    default: str  # the language of most training rows

    @property
    def bits(self) -> int:
        return self.masks.shape[1].bit_length() - 1


def bits_for(members: int, cfg: LangConfig) -> int:
    """Least size (as a power of two) at which so many members keep false hits within ``cfg.false_hits``."""
    fill = cfg.false_hits ** (1 / cfg.hashes)
    return max(10, math.ceil(math.log2(max(members, 1) * cfg.hashes / -math.log1p(-fill))))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _grams(texts: list[str], orders: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(64-bit hash, document) of every n-gram within a word and its edges, order by order."""
    low = [f" {t.lower()} " for t in texts]
    chars = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) for t in low])
    chars = np.where(_letters()[chars], chars, SPACE)
    edge = chars == SPACE
    keep = np.ones(len(chars), bool)
    keep[1:] = ~(edge[1:] & edge[:-1] & (doc[1:] == doc[:-1]))
    chars, doc, edge = chars[keep], doc[keep], edge[keep]
    for n in orders:
        m = len(chars) - n + 1
        if m <= 0:
            continue
        fit = doc[:m] == doc[n - 1:]
        for k in range(1, n - 1):
            fit &= ~edge[k:k + m]
        if n == 2:
            fit &= ~(edge[:m] & edge[1:])
        at = np.flatnonzero(fit)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h ^ chars[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        yield h, doc[at]


def _counted(batches: Iterator[pa.RecordBatch], orders: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Occurrences by language and n-gram, combined over a task as far as memory allows."""
    held: dict[str, list] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            h, n = _combined(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
        held.clear()

    for part in slices(batches, "text", SLICE_BYTES):
        texts, langs = part.column("text").to_pylist(), np.array(part.column("lang").to_pylist(), object)
        for lang in set(langs.tolist()):
            own = [texts[i] or "" for i in np.flatnonzero(langs == lang)]
            for h, _ in _grams(own, orders):
                u, n = np.unique(h, return_counts=True)
                held.setdefault(lang, []).append((u, n))
                size += len(u)
        if size > 2_000_000:
            for lang in list(held):
                held[lang] = [_combined(held[lang])]
            size = sum(len(p[0][0]) for p in held.values())
            if size > 1_000_000:
                yield from flush()
                size = 0
    yield from flush()


def _combined(parts: list) -> tuple[np.ndarray, np.ndarray]:
    h, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    u, at = np.unique(h, return_inverse=True)
    return u, np.bincount(at, weights=n, minlength=len(u)).astype(np.int64)


def _positions(h: np.ndarray, cfg: LangConfig) -> list[np.ndarray]:
    mask, step = np.uint64((1 << cfg.bits) - 1), h >> np.uint64(40) | np.uint64(1)
    return [((h + np.uint64(k) * step) & mask).astype(np.int64) for k in range(cfg.hashes)]


def train(docs: DataFrame, cfg: LangConfig = LangConfig(), text_col: str = "text", lang_col: str = "lang") -> LangModel:
    """Learn from every row that has a language.

    What reaches the driver is bounded: two rows a language and the filter's
    positions, whose number ``least_part`` and ``false_hits`` bound. The fill of
    each language is logged. Without a language nothing is learned.
    """
    rows = docs.filter(F.col(lang_col).isNotNull()).select(
        F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    per_lang = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect())
    langs = [x for x, _ in per_lang]
    words = max(1, -(-len(langs) // 64))
    masks = np.zeros((words, 1 << 10), np.uint64)
    if langs:
        # few grams and languages remain after the map-side sums
        counts = rows.mapInArrow(lambda it: _counted(it, cfg.orders), "lang string, gram long, n long").groupBy(
            "gram", "lang").agg(F.sum("n").alias("n"))
        totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
        by_gram = counts.join(totals, "lang").groupBy("gram").agg(
            F.max(F.col("n") / F.col("total")).alias("top"),
            F.collect_list(F.struct("lang", "n", (F.col("n") / F.col("total")).alias("part"))).alias("found"))
        member = stored(by_gram.select("gram", "top", F.explode("found").alias("f")).filter(
            (F.col("f.n") >= cfg.min_count) & (F.col("f.part") >= cfg.least_part)
            & (F.col("f.part") >= cfg.share * F.col("top"))).select("gram", "f.lang"), "members")
        most = member.groupBy("lang").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        cfg = replace(cfg, bits=bits_for(most, cfg) if cfg.bits is None else cfg.bits)
        masks = np.zeros((words, 1 << cfg.bits), np.uint64)
        at = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")).cast("int") - 1
        size, hashes = 1 << cfg.bits, cfg.hashes
        step = F.shiftrightunsigned("gram", 40).bitwiseOR(F.lit(1))
        places = F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)),
                             lambda k: (F.col("gram").bitwiseAND(F.lit(size - 1)) + k * step).bitwiseAND(F.lit(size - 1)))
        slots = member.select(
            F.floor(at / 64).cast("int").alias("word"),
            F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64))).alias("bit"),
            F.explode(places).alias("place")).groupBy("word", "place").agg(F.bit_or("bit").alias("mask"))
        got = slots.toPandas()
        masks[got["word"].to_numpy(), got["place"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    fill = np.array([((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))])
    for lang, part in zip(langs, fill, strict=True):
        log.info("language %s: %.2f %% of 2**%d positions are set", lang, 100 * part, masks.shape[1].bit_length() - 1)
    default = max(per_lang, key=lambda x: x[1])[0] if langs else "und"
    return LangModel(langs, masks, fill, fill**cfg.hashes, default)


def _judge(texts: list[str], model: LangModel, cfg: LangConfig) -> tuple[list[str], np.ndarray]:
    n_langs = len(model.langs)
    total = np.zeros(len(texts))
    hits = np.zeros((n_langs, len(texts)))
    for h, doc in _grams(texts, cfg.orders):
        total += np.bincount(doc, minlength=len(texts))
        places = _positions(h, cfg)
        for w in range(len(model.masks)):
            found = model.masks[w][places[0]]
            for p in places[1:]:
                found &= model.masks[w][p]
            for i in range(64 * w, min(n_langs, 64 * w + 64)):
                bit = (found >> np.uint64(i - 64 * w)) & np.uint64(1)
                hits[i] += np.bincount(doc, weights=bit, minlength=len(texts))
    if not n_langs:
        return ["und"] * len(texts), np.zeros(len(texts))
    wrong = model.wrong[:, None]
    share = np.clip((hits / np.maximum(total, 1) - wrong) / np.maximum(1 - wrong, 1e-9), 0, 1)
    best, whole = share.argmax(axis=0), share.sum(axis=0)
    score = np.where(whole > 0, share.max(axis=0) / np.where(whole > 0, whole, 1), 0.0)
    pred = [("und" if not total[d] else model.langs[best[d]] if whole[d] > 0 else model.default) for d in range(len(texts))]
    return pred, np.where(total > 0, score, 0.0)


def predict(docs: DataFrame, model: LangModel, cfg: LangConfig = LangConfig(), id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (0 to 1). No shuffle.

    ``und`` with score 0 for a null text or one without letters, or if nothing
    was learned. A text of which no filter knows anything gets the language of
    most training rows with score 0; ties go to the first language by code
    point. Repeated rows are judged alike; extra columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size, see LangConfig
    cfg = replace(cfg, bits=model.bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            pred, score = _judge([t or "" for t in part.column("text").to_pylist()], shipped.value, cfg)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
