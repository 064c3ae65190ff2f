"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

A replaced letter moves one count down and another up, an inserted letter moves
one up: L1 distance two among words of one length, one between neighbouring
lengths. For each length a k-d tree over letter counts, fitted to a bounded
sample, cuts the vocabulary into cells. A word stands in the cell of its own
counts and visits every cell whose box one edit may reach: cells of its length
with a larger number, and cells of the next shorter length. Any sample gives
the same pairs; it only decides how even the cells are.

Within a cell a second tree, over the cell's distinct count vectors, is searched
with the same pruning of boxes, and words of vectors that are near enough are
compared letter by letter. Pairs never leave a cell: what goes on is one row
per word with its number of near words and the best of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import slices
from tidewatch.session import stored

SLICE_BYTES = 8 << 20
#: Distinct words a task holds before it sends them on.
HELD = 400_000
LETTERS = "a-zÀ-ÿ"


@dataclass(frozen=True)
class SpellingConfig:
    """Production parameters.

    min_length, min_count: code points and occurrences a word must have.
    ratio: a form occurs at least so many times as often as its variant.
    sample: most words that the trees of cells are fitted to.
    cell_words: words a cell should hold; more only where over 4,096 times as
        many words exist, as a cell has 16 sampled words at least, or where
        words are anagrams of each other.
    """

    min_length: int = 5
    min_count: int = 3
    ratio: int = 2
    sample: int = 65_536
    cell_words: int = 16_384


class KdTree:
    """Cuts integer points at medians of the widest coordinate; searches by boxes."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        self.nodes: list[tuple] = []  # (coordinate, last value on the left, left, right) or (None, leaf number)
        self.leaves: list[np.ndarray] = []
        todo = [(np.arange(len(points)), None, 0)]
        while todo:
            rows, parent, side = todo.pop()
            at = len(self.nodes)
            if parent is not None:
                self.nodes[parent][2 + side] = at
            cut = self._cut(points[rows]) if len(rows) > leaf else None
            if cut is None:
                self.nodes.append([None, len(self.leaves)])
                self.leaves.append(rows)
                continue
            j, t = cut
            self.nodes.append([j, t, None, None])
            low = points[rows, j] <= t
            todo += [(rows[~low], at, 1), (rows[low], at, 0)]

    @staticmethod
    def _cut(points: np.ndarray) -> tuple[int, int] | None:
        spread = points.var(axis=0)
        j = int(spread.argmax())
        if spread[j] == 0:
            return None
        v = np.sort(points[:, j])
        t = int(v[(len(v) - 1) // 2])
        below = int(v[np.searchsorted(v, t) - 1]) if v[0] < t else t
        # of the two cuts next to the median the more even one that leaves both sides some points
        share = [abs(2 * np.searchsorted(v, x, side="right") - len(v)) if x < v[-1] else len(v) + 1 for x in (t, below)]
        return j, (t if share[0] <= share[1] else below)

    def search(self, q: np.ndarray, over: int, under: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of q) where q exceeds the leaf's box by at most ``over`` in all and falls short by at most ``under``."""
        rows = np.arange(len(q))
        zero = np.zeros(len(q), np.int32)
        todo = [(0, rows, zero, zero, {}, {})]
        while todo:
            at, rows, o, u, lows, highs = todo.pop()
            if not len(rows):
                continue
            node = self.nodes[at]
            if node[0] is None:
                yield node[1], rows
                continue
            j, t, left, right = node
            v = q[rows, j]
            more = o + np.maximum(v - t, 0)
            if j in highs:
                more = more - np.maximum(v - highs[j], 0)
            less = u + np.maximum(t + 1 - v, 0)
            if j in lows:
                less = less - np.maximum(lows[j] - v, 0)
            a, b = more <= over, less <= under
            todo.append((left, rows[a], more[a], u[a], lows, highs | {j: t}))
            todo.append((right, rows[b], o[b], less[b], lows | {j: t + 1}, highs))


def _matrix(words: list[str]) -> np.ndarray:
    """Letters of words of one length as bytes; all code points are below 256."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def _counts(letters: np.ndarray) -> np.ndarray:
    m = len(letters)
    at = np.arange(m)[:, None] * 256 + letters
    return np.bincount(at.ravel(), minlength=m * 256).reshape(m, 256).astype(np.int32)


# --- counting -------------------------------------------------------------------------------------------------------


def word_counts(docs: DataFrame, cfg: SpellingConfig = SpellingConfig(), typo_every: int | None = None,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; no count is dropped.

    ``typo_every`` damages runs on purpose: where it divides the crc32 of
    ``id:run``, the run loses the letter at that number modulo its length. A
    null id counts as an empty one there. A null or empty text has no words.
    Words shorter than ``min_length`` are left out.
    """
    least = cfg.min_length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = re.compile(f"[{LETTERS}]{{{least},}}")
        held: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for part in slices(batches, "text", SLICE_BYTES):
            for i, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                found = Counter(letters.findall(text.encode().lower().decode()))
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                for word, n in found.items():
                    if typo_every:
                        h = zlib.crc32(word.encode(), start)
                        if h % typo_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < least:
                                continue
                    held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield flush()
        yield flush()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# --- cells ----------------------------------------------------------------------------------------------------------


def _trees(words: DataFrame, cfg: SpellingConfig) -> dict[int, KdTree]:
    """A tree of cells for each length in a sample of at most about ``cfg.sample`` words, chosen by hash."""
    total = words.count()
    kept = words if total <= cfg.sample else words.filter(F.pmod(F.xxhash64("word"), F.lit(total)) < cfg.sample)
    by_length: dict[int, list[str]] = {}
    for r in kept.select("word").collect():
        by_length.setdefault(len(r["word"]), []).append(r["word"])
    leaf = max(16, int(cfg.cell_words * min(1.0, cfg.sample / max(total, 1))))
    trees = {n: KdTree(_counts(_matrix(sorted(found))), leaf) for n, found in by_length.items()}
    for t in trees.values():
        t.leaves = []  # cells are numbered; the sample itself is not shipped
    return trees


OWN, SAME, LONGER = range(3)


def _dealt(batches: Iterator[pa.RecordBatch], trees: dict[int, KdTree]) -> Iterator[pa.RecordBatch]:
    """(cell, part, word, n): each word to its own cell and to those that it may have near words in."""

    def reached(tree: KdTree | None, q: np.ndarray, over: int, under: int) -> Iterator[tuple[int, np.ndarray]]:
        return tree.search(q, over, under) if tree else iter([(0, np.arange(len(q)))])

    for batch in batches:
        words, n = np.array(batch.column("word").to_pylist(), object), batch.column("n").to_numpy()
        size = np.array([len(w) for w in words])
        for length in np.unique(size).tolist():
            at = np.flatnonzero(size == length)
            q = _counts(_matrix(words[at].tolist()))
            own = np.zeros(len(at), np.int64)
            out = []
            for cell, rows in reached(trees.get(length), q, 0, 0):
                own[rows] = cell
                out.append((length, cell, OWN, rows))
            for cell, rows in reached(trees.get(length), q, 1, 1):
                out.append((length, cell, SAME, rows[own[rows] < cell]))
            out += [(length - 1, cell, LONGER, rows) for cell, rows in reached(trees.get(length - 1), q, 1, 0)]
            for lived, cell, part, rows in out:
                if len(rows):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), lived << 32 | cell)), pa.array(np.full(len(rows), part, np.int32)),
                         pa.array(words[at[rows]].tolist(), pa.string()), pa.array(n[at[rows]])], names=["cell", "part", "word", "n"])


# --- within a cell --------------------------------------------------------------------------------------------------

ALL, SEVENS, TOPS = (np.uint64(x) for x in (0xFFFFFFFFFFFFFFFF, 0x7F7F7F7F7F7F7F7F, 0x8080808080808080))
ONE, SEVEN, EIGHT, REST = (np.uint64(x) for x in (1, 7, 8, 56))
#: Pairs compared at once; class pairs with more pairs than LARGE meet by hash instead.
BLOCK, LARGE = 1 << 19, 1 << 14


class Anagrams:
    """Words of one length, sorted so that those with equal letter counts stand together."""

    def __init__(self, words: np.ndarray) -> None:
        letters = _matrix(words.tolist())
        length = letters.shape[1]
        key = np.ascontiguousarray(np.sort(letters, axis=1)).view(f"S{length}").ravel()
        self.order = np.argsort(key, kind="stable")
        key = key[self.order]
        self.letters = letters[self.order]
        self.start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        self.size = np.diff(np.r_[self.start, len(key)])
        self.counts = _counts(self.letters[self.start])
        wide = np.zeros((len(letters), -(-(length + 1) // 8) * 8), np.uint8)
        wide[:, :length] = self.letters
        self.packed = wide.view("<u8")


def _changed(t: np.ndarray) -> np.ndarray:
    """The top bit of every byte that is not zero."""
    return (((t & SEVENS) + SEVENS) | t) & TOPS


def _one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = np.zeros(len(a), np.uint8)
    for k in range(min(a.shape[1], b.shape[1])):
        n += np.bitwise_count(_changed(a[:, k] ^ b[:, k]))
    return n == 1


def _one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """b is a with one letter put in: equal up to the first difference, equal behind it when b is moved on by one."""
    ok, same = np.ones(len(a), bool), np.ones(len(a), bool)
    width = max(a.shape[1], b.shape[1])
    none = np.zeros(len(a), np.uint64)
    col = lambda m, k: m[:, k] if k < m.shape[1] else none
    for k in range(width):
        x, y = col(a, k), col(b, k)
        moved = (y >> EIGHT) | (col(b, k + 1) << REST)
        z = _changed(x ^ y)
        below = np.where(z == 0, ALL, ((z & (~z + ONE)) >> SEVEN) - ONE)
        below = np.where(same, below, np.uint64(0))
        ok &= x == ((y & below) | (moved & ~below))
        same &= z == 0
    return ok


def _near_classes(tree: KdTree, q: np.ndarray, p: np.ndarray, over: int, under: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of q and p at L1 distance over + under."""
    qs, ps = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for leaf, rows in tree.search(q, over, under):
        points = tree.leaves[leaf]
        for a in range(0, len(rows), 4096):
            part = rows[a:a + 4096]
            i, j = np.nonzero(np.abs(q[part][:, None, :] - p[points][None]).sum(axis=2, dtype=np.int32) == over + under)
            qs.append(part[i])
            ps.append(points[j])
    return np.concatenate(qs), np.concatenate(ps)


def _hashes(length: int) -> np.ndarray:
    return np.random.default_rng(length).integers(1, 1 << 63, length + 1, dtype=np.uint64) * np.uint64(2) + ONE


def _without(letters: np.ndarray, letter: int, mask: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word with one occurrence of the letter masked, or else taken out."""
    weight = _hashes(letters.shape[1])
    part = letters.astype(np.uint64) * weight[:-1]
    row, at = np.nonzero(letters == letter)
    if mask:
        return row, (part.sum(axis=1, dtype=np.uint64)[row] - part[row, at]) * ONE ^ weight[at]
    front = np.cumsum(part, axis=1, dtype=np.uint64) - part
    moved = np.zeros_like(part)
    moved[:, 1:] = letters[:, 1:].astype(np.uint64) * weight[:-2]
    back = np.cumsum(moved[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1] - moved
    return row, front[row, at] + back[row, at]


def _hash_pairs(a: np.ndarray, b: np.ndarray, x: int, y: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two large classes that meet by hash: a's letter x for b's letter y, or (y None) x put into a."""
    if y is None:
        bi, bk = _without(b, x, mask=False)
        ai, ak = np.arange(len(a)), (a.astype(np.uint64) * _hashes(b.shape[1])[:a.shape[1]]).sum(axis=1, dtype=np.uint64)
    else:
        (ai, ak), (bi, bk) = _without(a, x, mask=True), _without(b, y, mask=True)
    order = np.argsort(ak, kind="stable")
    low, high = (np.searchsorted(ak[order], bk, side=s) for s in ("left", "right"))
    n = high - low
    at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pairs = np.unique(np.stack([ai[order][at], np.repeat(bi, n)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _word_pairs(a: Anagrams, b: Anagrams, ca: np.ndarray, cb: np.ndarray, inserted: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words (rows of a and b) of near classes that are one edit apart; b is the longer one where letters are inserted."""
    test = _one_inserted if inserted else _one_replaced
    n = a.size[ca] * b.size[cb]
    for k in np.flatnonzero(n > LARGE).tolist():
        i, j = ca[k], cb[k]
        sa, sb = slice(a.start[i], a.start[i] + a.size[i]), slice(b.start[j], b.start[j] + b.size[j])
        d = b.counts[j] - a.counts[i]
        x = int(np.flatnonzero(d > 0)[0]) if inserted else int(np.flatnonzero(d < 0)[0])
        ia, ib = _hash_pairs(a.letters[sa], b.letters[sb], x, None if inserted else int(np.flatnonzero(d > 0)[0]))
        ok = test(a.packed[sa][ia], b.packed[sb][ib])
        yield ia[ok] + sa.start, ib[ok] + sb.start
    few = n <= LARGE
    ca, cb, n = ca[few], cb[few], n[few]
    upto = np.cumsum(n)
    k = 0
    while k < len(n):
        stop = max(k + 1, int(np.searchsorted(upto, (upto[k] - n[k]) + BLOCK, side="right")))
        m, wide = n[k:stop], b.size[cb[k:stop]]
        off = np.arange(m.sum(), dtype=np.int32) - np.repeat((upto[k:stop] - m - (upto[k] - n[k])).astype(np.int32), m)
        row, col = np.divmod(off, np.repeat(wide.astype(np.int32), m))
        ia, ib = np.repeat(a.start[ca[k:stop]], m) + row, np.repeat(b.start[cb[k:stop]], m) + col
        ok = test(a.packed[ia], b.packed[ib])
        yield ia[ok], ib[ok]
        k = stop


def _cell(rows: pa.Table) -> pa.Table:
    """Near words within a cell: (word, n_near, best_n, best) for each word that has some."""
    part, n = rows.column("part").to_numpy(), rows.column("n").to_numpy()
    words = np.array(rows.column("word").to_pylist(), object)
    rank = np.empty(len(words), np.int64)  # by occurrences, most first, then by code point
    rank[np.lexsort((np.argsort(np.argsort(words, kind="stable"), kind="stable"), -n))] = np.arange(len(words))
    near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words))
    at = {k: np.flatnonzero(part == k) for k in (OWN, SAME, LONGER)}
    if len(at[OWN]):
        own = Anagrams(words[at[OWN]])
        used = own.counts.any(axis=0)
        tree = KdTree(own.counts[:, used], 8)
        for kind in (OWN, SAME, LONGER):
            if not len(at[kind]):
                continue
            other = own if kind == OWN else Anagrams(words[at[kind]])
            # letters that no word of the cell has: at most one can be one too many
            spare = other.counts[:, ~used].sum(axis=1)
            fit = np.flatnonzero(spare <= 1)
            for extra in (0, 1):
                rows_ = fit[spare[fit] == extra]
                under = 0 if kind == LONGER else 1
                q, p = _near_classes(tree, other.counts[rows_][:, used], own.counts[:, used], 1 - extra, under)
                q = rows_[q]
                if kind == OWN:
                    q, p = q[q < p], p[q < p]
                for ip, iq in _word_pairs(own, other, p, q, kind == LONGER):
                    a, b = at[OWN][own.order[ip]], at[kind][other.order[iq]]
                    near += np.bincount(a, minlength=len(words)) + np.bincount(b, minlength=len(words))
                    np.minimum.at(best, a, rank[b])
                    np.minimum.at(best, b, rank[a])
    some = np.flatnonzero(near)
    by_rank = np.argsort(rank)
    top = by_rank[best[some]]
    return pa.table({"word": pa.array(words[some].tolist(), pa.string()), "n_near": near[some], "best_n": n[top],
                     "best": pa.array(words[top].tolist(), pa.string())})


def near_words(words: DataFrame, cfg: SpellingConfig = SpellingConfig()) -> DataFrame:
    """(word, n_near, best_n, best): words one edit apart from others, the commonest of these, the least of equals.

    ``words`` has distinct words of letters below U+0100 with their
    occurrences n. A word without near words has no row.
    """
    trees = _trees(words, cfg)
    dealt = words.select("word", "n").mapInArrow(lambda it: _dealt(it, trees), "cell long, part int, word string, n long")
    found = dealt.groupBy("cell").applyInArrow(_cell, "word string, n_near long, best_n long, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("top")).select(
        "word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by pointer doubling; a form is commoner than its word, so there are no circles."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stored(now.select("word", "root").join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not now.filter("moved").limit(1).count():
            return now.select("word", "root")


def variants(words: DataFrame, cfg: SpellingConfig = SpellingConfig()) -> DataFrame:
    """One row per word: word, form, root (string), n, n_near, form_n (long).

    form is the commonest word one edit away (of equals the least by code
    point) if it occurs ``ratio`` times as often or more, else null; root is
    the last word when forms are followed, the word itself where there is
    none. ``words`` as for ``near_words``; rarer and shorter words than the
    parameters ask for are left out. An empty table gives no rows.
    """
    fit = stored(words.filter((F.length("word") >= cfg.min_length) & (F.col("n") >= cfg.min_count)).select("word", "n"), "words")
    near = near_words(fit, cfg)
    good = F.col("best_n") >= cfg.ratio * F.col("n")
    formed = stored(fit.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best")).alias("form"),
        F.when(good, F.col("best_n")).alias("form_n")), "forms")
    roots = _roots(formed.filter(F.col("form").isNotNull()))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
