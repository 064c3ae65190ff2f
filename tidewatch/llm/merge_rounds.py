"""SentencePiece BPE in vectorised merge rounds, and its decoding.

The symbols of many words lie in flat arrays. Each round finds the least pair
rank of every word with one segmented minimum, merges its leftmost occurrence
in all words at once, compacts the arrays and looks up only the pairs that
changed, until no word has a pair left. Where it cannot change the result, all
occurrences of a word's best pair merge in the same round. Words are cut as in
``pieces``; each batch encodes its distinct words once.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import slices
from tidewatch.llm.pieces import MARK, model_bytes, pretokens, processor

SLICE_BYTES = 2 << 20
#: Words of more symbols use a heap in place of rounds; the result is the same.
LONG_WORD = 2048
NONE = np.int32(2**31 - 1)


class Merges:
    """Lookup tables of one model: symbols, ranked pairs, bytes of each id."""

    def __init__(self, proto: bytes):
        sp = processor(proto)
        size = sp.vocab_size()
        self.eos, self.unk = sp.eos_id(), sp.unk_id()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(size)]
        plain = {sp.id_to_piece(i).replace(MARK, " "): i for i in range(size) if not special[i]}
        if {c for p in plain for c in p} - set(plain):
            raise ValueError("a character inside a piece is no piece itself")
        self.n_pieces, self.n_symbols = size, size + 1
        self.other = size  # any character of no piece; it never merges
        self.of_char = np.full(0x110000, self.other, np.int32)
        for c, i in plain.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        scores = sorted({sp.get_score(i) for i in plain.values()}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        self.rank = np.full(size, NONE, np.int32)
        keys, made = [], []
        for p, i in plain.items():
            self.rank[i] = rank[sp.get_score(i)]
            for cut in range(1, len(p)):
                left, right = plain.get(p[:cut]), plain.get(p[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.n_symbols + right)
                    made.append(i)
        order = np.argsort(keys)
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int32)[order]
        # a piece is free if nothing that merges it further ranks as good or better
        self.free = np.ones(size, bool)
        for p, i in plain.items():
            for cut in range(1, len(p)):
                for part in (p[:cut], p[cut:]):
                    if (k := plain.get(part)) is not None and self.rank[i] <= self.rank[k]:
                        self.free[k] = False
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        shown = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i)
                 else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i)
                 else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(size)]
        self.control = np.array([sp.is_control(i) for i in range(size)])
        self.is_byte = np.array([sp.is_byte(i) for i in range(size)])
        self.shown = Ragged.of(shown)
        self.digits = Ragged.of([b"%d " % i for i in range(size)])

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, -1 for none."""
        key = left.astype(np.int64) * self.n_symbols + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1).astype(np.int32)


class Ragged:
    """Rows of differing length in one flat array."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes = flat, sizes.astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    @classmethod
    def of(cls, rows: list[bytes]) -> Ragged:
        return cls(np.frombuffer(b"".join(rows), np.uint8), np.array([len(r) for r in rows]))

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows ``at`` one after the other, and where each one ends."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        step = np.repeat(self.starts[at] - (ends - sizes), sizes)
        return self.flat[step + np.arange(total)], ends


@lru_cache(maxsize=2)
def merges(proto: bytes) -> Merges:
    return Merges(proto)


def _rounds(sym: np.ndarray, word: np.ndarray, m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Merge to the end; returns symbols and word numbers, in order of word."""
    done_sym, done_word = [], []
    made = np.full(len(sym), -1, np.int32)
    same = word[:-1] == word[1:]
    made[:-1][same] = m.pairs(sym[:-1][same], sym[1:][same])
    while len(sym):
        rank = np.where(made >= 0, m.rank[made], NONE)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        sizes = np.diff(np.append(first, len(sym)))
        best = np.repeat(np.minimum.reduceat(rank, first), sizes)
        over = best == NONE
        if over.any():
            done_sym.append(sym[over])
            done_word.append(word[over])
            live = ~over
            sym, word, made, rank, best = sym[live], word[live], made[live], rank[live], best[live]
            if not len(sym):
                break
        hit = np.flatnonzero(rank == best)
        lead = np.concatenate([[True], word[hit][1:] != word[hit][:-1]])
        # within a run of overlapping hits every second one merges
        run = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (word[hit][1:] != word[hit][:-1])])
        place = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
        at = hit[lead | (m.free[made[hit]] & (place % 2 == 0))]
        sym[at] = made[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        new = np.zeros(len(sym), bool)
        new[at] = True
        sym, word, made, new = sym[keep], word[keep], made[keep], new[keep]
        here = np.flatnonzero(new)
        changed = np.unique(np.concatenate([here, here[here > 0] - 1]))
        made[changed] = -1
        inner = changed[changed + 1 < len(sym)]
        inner = inner[word[inner] == word[inner + 1]]
        made[inner] = m.pairs(sym[inner], sym[inner + 1])
    if not done_sym:
        return sym, word
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    return sym[order], word[order]


def _heap(sym: np.ndarray, m: Merges) -> np.ndarray:
    """The same merges of one very long word, in n log n."""
    sym = sym.tolist()
    n = len(sym)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    first = m.pairs(np.array(sym[:-1]), np.array(sym[1:])).tolist()
    rank = m.rank
    heap = [(int(rank[p]), i, p, sym[i], sym[i + 1]) for i, p in enumerate(first) if p >= 0]
    heapq.heapify(heap)

    def offer(i: int, j: int) -> None:
        p = int(m.pairs(np.array([sym[i]]), np.array([sym[j]]))[0])
        if p >= 0:
            heapq.heappush(heap, (int(rank[p]), i, p, sym[i], sym[j]))

    while heap:
        _, i, p, left, right = heapq.heappop(heap)
        j = after[i]
        if sym[i] != left or j >= n or sym[j] != right:
            continue
        sym[i], sym[j] = p, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
            offer(i, after[i])
        if before[i] >= 0:
            offer(before[i], i)
    return np.array([s for s in sym if s >= 0], np.int32)


def encode_words(words: list[str], m: Merges) -> Ragged:
    """Ids of each word; characters of no piece become their UTF-8 bytes."""
    sizes = np.array([len(w) for w in words], np.int64)
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.repeat(np.arange(len(words), dtype=np.int64), sizes)
    start = m.of_char[chars]
    long = np.repeat(sizes > LONG_WORD, sizes)
    # unknown characters keep their place as one symbol that never merges
    tail = np.where(start >= m.n_pieces, -1 - chars.astype(np.int64), 0)
    sym, at = _merged(start[~long], word[~long], tail[~long], m)
    for w in np.flatnonzero(sizes > LONG_WORD):
        own = word == w
        got = _heap(start[own], m)
        lost = tail[own]
        got = got.astype(np.int64)
        got[got >= m.n_pieces] = lost[lost < 0]
        sym, at = np.concatenate([sym, got]), np.concatenate([at, np.full(len(got), w)])
    order = np.argsort(at, kind="stable")
    sym, at = sym[order], at[order]
    lost = np.flatnonzero(sym < 0)
    if len(lost):
        raw = [chr(-1 - c).encode() for c in sym[lost].tolist()]
        times = np.ones(len(sym), np.int64)
        times[lost] = [len(b) for b in raw]
        at, grown = np.repeat(at, times), np.repeat(sym, times)
        grown[grown < 0] = m.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        sym = grown
    return Ragged(sym.astype(np.int32), np.bincount(at, minlength=len(words)))


def _merged(start: np.ndarray, word: np.ndarray, tail: np.ndarray, m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Rounds, then the characters of no piece put back in their places as negatives."""
    sym, at = _rounds(start.astype(np.int32).copy(), word, m)
    sym = sym.astype(np.int64)
    sym[sym >= m.n_pieces] = tail[tail < 0]
    return sym, at


def encode(texts: list[str], m: Merges) -> Ragged:
    """Ids of each whole text, without begin or end id."""
    names: dict[str, int] = {}
    at, per = [], []
    for t in texts:
        words = pretokens(t)
        at.extend([names.setdefault(w, len(names)) for w in words])
        per.append(len(words))
    ids = encode_words(list(names), m)
    flat, ends = ids.take(np.array(at, np.int64))
    ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per)])] if len(per) else np.zeros(1, np.int64)
    return Ragged(flat, np.diff(ends))


def decode(ids: np.ndarray, m: Merges) -> str:
    """The text of one id sequence: control ids show nothing, the first mark goes."""
    flat, _ = m.shown.take(ids)
    return _text(flat.tobytes(), ids, m)


def _text(raw: bytes, ids: np.ndarray, m: Merges) -> str:
    if m.control[ids[:-1]].any():  # a control id also ends a run of byte ids
        return _repaired(ids, m)
    raw = raw[1:] if raw[:1] == b" " and len(ids) and _leads(ids, m) else raw
    try:
        return raw.decode()
    except UnicodeDecodeError:  # only ids that no text encodes to
        return _repaired(ids, m)


def _leads(ids: np.ndarray, m: Merges) -> bool:
    """Whether the first shown id is a piece, whose leading mark the decoder drops."""
    first = ids[np.flatnonzero(m.shown.sizes[ids])[0]]
    return first != m.unk and not m.is_byte[first]


def _repaired(ids: np.ndarray, m: Merges) -> str:
    """Runs of byte ids decoded on their own, a bad byte giving one replacement mark."""
    out, run = [], bytearray()

    def close() -> None:
        left = bytes(run)
        while left:
            for n in range(min(4, len(left)), 0, -1):
                try:
                    out.append(left[:n].decode())
                    left = left[n:]
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                left = left[1:]
        run.clear()

    lead = True
    for i in ids.tolist():
        shown = m.shown.flat[m.shown.starts[i]:m.shown.starts[i + 1]].tobytes()
        if m.is_byte[i]:
            run += shown
        else:
            close()
            out.append(shown[1:].decode() if lead and i != m.unk and shown[:1] == b" " else shown.decode())
        lead = lead and not shown
    close()
    return "".join(out)


OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch], proto: bytes) -> Iterator[pa.RecordBatch]:
    m = merges(proto)
    for part in slices(batches, "text", SLICE_BYTES):
        ids = _with_end(encode([t or "" for t in part.column("text").to_pylist()], m), m)
        digits, digit_ends = m.digits.take(ids.flat)
        shown, shown_ends = m.shown.take(ids.flat)
        digits, shown = memoryview(digits.tobytes()), memoryview(shown.tobytes())
        cut = lambda ends: np.concatenate([[0], ends])[ids.starts].tolist()
        a, b = cut(digit_ends), cut(shown_ends)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        n = len(ids.sizes)
        yield pa.RecordBatch.from_arrays([
            part.column("doc_id"), pa.array(ids.sizes),
            pa.array([sha(digits[a[i]:a[i + 1] - 1]) for i in range(n)]),
            pa.array([sha(_text(bytes(shown[b[i]:b[i + 1]]), ids.flat[ids.starts[i]:ids.starts[i + 1]], m).encode())
                      for i in range(n)])], schema=OUT)


def _with_end(ids: Ragged, m: Merges) -> Ragged:
    return Ragged(np.insert(ids.flat, ids.starts[1:], m.eos), ids.sizes + 1)


def _listed(batches: Iterator[pa.RecordBatch], proto: bytes) -> Iterator[pa.RecordBatch]:
    m = merges(proto)
    for part in slices(batches, "text", SLICE_BYTES):
        ids = _with_end(encode([t or "" for t in part.column("text").to_pylist()], m), m)
        lists = pa.ListArray.from_arrays(pa.array(ids.starts.astype(np.int32)), pa.array(ids.flat))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "ids"])


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids of the whole text, end id last; null counts as empty."""
    proto = model_bytes(model_path)
    return _rows(docs, id_col, text_col).mapInArrow(lambda it: _listed(it, proto), "doc_id long, ids array<int>")


def decoded(rows: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows of (doc_id, ids)."""
    proto = model_bytes(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(proto)
        for b in batches:
            texts = [decode(np.array(i or [], np.int64), m) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Ids are those of the whole text plus the end id; they are digested as
    decimals joined by one space, and decoded again. A null or empty text has
    the end id alone. Repeated rows and null ids are handled row by row; an
    empty table gives no rows; extra columns are ignored. No shuffle.
    """
    proto = model_bytes(model_path)
    return _rows(docs, id_col, text_col).mapInArrow(
        lambda it: _digests(it, proto), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
