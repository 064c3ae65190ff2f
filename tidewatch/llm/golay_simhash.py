"""SimHash near-dedup with keys from the perfect binary Golay code.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Two that
differ in at most two bits agree on at least one whole segment, and no other
segment of theirs differs in more than two. A 23-bit word is decoded to the
codewords within distance four: one, or six when the nearest is at distance
three. Words at most two bits apart always share one of these. So a key is one
exact segment with one codeword index of another segment, 30 to 35 bits; about
sixteen keys a fingerprint find every link, and joined pairs are verified.

Keys that many fingerprints share are not paired up. Their fingerprints emit
the 65 values within one bit of themselves: all that meet at such a value are
linked with each other, and two linked ones always meet at one, so stars to the
least member give the same components in linear size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import slices, whole_text
from tidewatch.llm.components import components
from tidewatch.session import stored

SLICE_BYTES = 2 << 20
#: Most fingerprints of one key that are compared pair by pair.
PAIRED = 64
#: Generator polynomial of the [23, 12, 7] code.
GENERATOR = 0b110001110101


def _syndrome(v: int) -> int:
    for bit in range(22, 10, -1):
        if v >> bit & 1:
            v ^= GENERATOR << (bit - 11)
    return v


class Golay:
    """Codeword indices near a 23-bit word, by syndrome."""

    def __init__(self) -> None:
        self.part = [np.array([_syndrome(b << s) if b << s < 1 << 23 else 0 for b in range(256)], np.int64)
                     for s in (0, 8, 16)]
        near: list[list[int]] = [[] for _ in range(2048)]
        units = [_syndrome(1 << i) for i in range(23)]
        for weight in range(5):
            for bits in combinations(range(23), weight):
                s = 0
                for i in bits:
                    s ^= units[i]
                # distance four only counts where the nearest codeword is at three
                if weight < 4 or near[s][0].bit_count() == 3:
                    near[s].append(sum(1 << i for i in bits))
        self.count = np.array([len(x) for x in near])
        self.errors = np.array([x + [x[0]] * (6 - len(x)) for x in near], np.int64)

    def keys(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, index) of every codeword near each word; the index is its 12 message bits."""
        s = self.part[0][v & 255] ^ self.part[1][v >> 8 & 255] ^ self.part[2][v >> 16]
        row = np.repeat(np.arange(len(v)), self.count[s])
        at = np.arange(len(row)) - np.repeat(np.cumsum(self.count[s]) - self.count[s], self.count[s])
        return row, (v[row] ^ self.errors[s[row], at]) >> 11


def fingerprint(texts: list[str]) -> np.ndarray:
    """64-bit SimHash of the 3-word shingles of each text, repeats included."""
    from xxhash import xxh64_intdigest

    hashes: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for d, text in enumerate(texts):
        words = text.encode().lower().split()
        n = len(words)
        line = b" ".join(words)
        if n > 3:
            ends = np.cumsum([len(w) + 1 for w in words])
            stops = (ends[2:] - 1).tolist()
            starts = [0, *ends[:-3].tolist()]
            hashes += [xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, stops, strict=True)]
            sizes[d] = n - 2
        elif n:
            hashes.append(xxh64_intdigest(line, 42))
            sizes[d] = 1
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        h = np.array(hashes, "<u8")
        firsts = np.cumsum(sizes[full]) - sizes[full]
        # one long text at a time, or as many as give about 100,000 shingles
        at = 0
        while at < len(full):
            stop = max(at + 1, int(np.searchsorted(firsts, firsts[at] + 100_000)))
            low, high = firsts[at], firsts[stop] if stop < len(full) else len(h)
            ones = np.zeros((stop - at, 64), np.int64)
            for a in range(low, high, 1_000_000):
                bits = np.unpackbits(h[a:min(high, a + 1_000_000)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                edges = np.unique(np.concatenate([[0], np.clip(firsts[at:stop] - a, 0, len(bits) - 1)]))
                owner = np.searchsorted(firsts[at:stop], edges + a, side="right") - 1
                np.add.at(ones, owner, np.add.reduceat(bits, edges, axis=0, dtype=np.int64))
            major = 2 * ones > sizes[full[at:stop], None]
            out[full[at:stop]] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
            at = stop
    return out


def _mark(text_col: str) -> Column:
    return F.xxhash64(whole_text(text_col))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", SLICE_BYTES):
        f = fingerprint([t or "" for t in part.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("mark"), pa.array(f.view(np.int64))], names=["doc_id", "mark", "f"])


def golay_keys(f: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the kind of key in the top bits, then exact segment and codeword index."""
    a, b, c = f & 0x7FFFFF, f >> 23 & 0x7FFFFF, f >> 46 & 0x3FFFF
    rows, keys = [], []
    for kind, exact, near in ((0, c, a), (1, a, b), (2, b, a)):
        row, index = code.keys(near)
        rows.append(row)
        keys.append(kind << 40 | exact[row] << 12 | index)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = Golay()
    for batch in batches:
        f = batch.column("f").to_numpy(zero_copy_only=False)
        row, key = golay_keys(f, code)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(f[row])], names=["key", "f"])


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs at two bits or fewer."""
    keyed = stored(distinct.select("f").mapInArrow(_keyed, "key long, f long"), "keys")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = stored(keyed.join(shared, "key"), "met")
    few = met.filter(F.col("n") <= PAIRED).select("key", "f")
    pairs = few.select("key", F.col("f").alias("a")).join(few.select("key", F.col("f").alias("b")), "key").filter(
        (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    around = F.concat(F.array(F.col("f")), F.transform(
        F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("f").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    many = met.filter(F.col("n") > PAIRED).select("f").distinct().select("f", F.explode(around).alias("v"))
    stars = many.join(many.groupBy("v").agg(F.min("f").alias("b")), "v").filter("f != b").select(F.col("f").alias("a"), "b")
    return pairs.union(stars).distinct()


def _owned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark (hash of the text), f, root of the component and its least id, of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _mark(text_col).alias("mark"),
                       F.col(text_col).cast("string").alias("text"))
    marked = stored(rows.mapInArrow(_fingerprints, "doc_id long, mark long, f long"), "fingerprints")
    distinct = stored(marked.groupBy("f").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct)).withColumnRenamed("node", "f")
    linked = distinct.join(roots, "f")
    least = linked.groupBy("root").agg(F.min("first").alias("component"))
    owner = distinct.join(linked.join(least, "root").select("f", "root", "component"), "f", "left").select(
        "f", F.coalesce("root", "f").alias("root"), F.coalesce("component", "first").alias("component_id"))
    return marked.join(owner, "f")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    A to Z are lower-cased, words are runs of other than ASCII white space;
    fewer than three words form one shingle. A null or empty text has
    fingerprint zero and links like any other. component_id is the least id
    reachable over links of two differing bits or fewer; null ids never are the
    least unless a component has no other. Repeated rows share a component; an
    empty table gives no rows; extra columns are ignored.
    """
    return _owned(docs, id_col, text_col).select(
        "doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` a component, the least id first and null last, with all its columns.

    Rows are found again by id and text: null ids and ids that several texts
    share lose no component; rows that repeat both collapse to one.
    """
    least = F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "mark"))
    first = _owned(docs, id_col, text_col).groupBy("root").agg(least.alias("k")).select(
        F.col("k.doc_id").alias("first_id"), F.col("k.mark").alias("first_mark"))
    # whole rows travel as one column, so that no name can clash
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), _mark(text_col).alias("at"))
    same = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("at") == F.col("first_mark"))
    return keyed.join(first, same, "left_semi").dropDuplicates(["id", "at"]).select("row.*")
