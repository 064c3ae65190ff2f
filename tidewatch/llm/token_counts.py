"""Token counts by way of distinct pre-tokens.

Texts are cut into pre-tokens. Map tasks send each bucket of pre-tokens the
ones they met, once per slice of documents, with the frequencies per document.
The task that owns a bucket counts the pieces of every distinct pre-token once,
joins the counts to the frequencies and sums per document; the sums of all
buckets are then added per document. No ids are kept anywhere. A pre-token in
every document costs one entry per document, in the bucket that holds its
slice of the vocabulary only, and that entry is a count.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import shuffle_parts, slices
from tidewatch.llm.pieces import model_bytes, pretokens, processor

#: A slice of documents, in bytes of text, that is counted together.
SLICE_BYTES = 8 << 20

HEAD = "ids array<long>, sizes array<long>"
PARTS = f"bucket int, slice long, names binary, name_chars binary, per_name binary, docs binary, times binary, {HEAD}"
SUMS = f"slice long, docs binary, n binary, {HEAD}"
OUT = "doc_id long, n_bytes long, n_tokens long"


def _counted(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Pre-token frequencies of each slice, one row per bucket."""
    base = TaskContext.get().partitionId() << 32
    for no, part in enumerate(slices(batches, "text", SLICE_BYTES)):
        names: dict[str, int] = {}
        name_of, doc_of, times = [], [], []
        for d, text in enumerate(part.column("text").to_pylist()):
            freq = Counter(pretokens(text or ""))
            name_of.extend([names.setdefault(w, len(names)) for w in freq])
            times.extend(freq.values())
            doc_of.append(len(freq))
        words = list(names)
        bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.int64, len(words))
        name_at = np.array(name_of, np.int64)
        doc_at = np.repeat(np.arange(len(doc_of), dtype=np.uint32), doc_of)
        order = np.lexsort((name_at, bucket[name_at])) if len(words) else name_at
        name_at, doc_at, times = name_at[order], doc_at[order], np.array(times, np.uint32)[order]
        edges = np.searchsorted(bucket[name_at], np.arange(buckets + 1))
        rows = []
        for b in np.flatnonzero(np.diff(edges)):
            at = slice(edges[b], edges[b + 1])
            own, per = np.unique(name_at[at], return_counts=True)
            held = [words[i] for i in own]
            rows.append({
                "bucket": int(b), "slice": base + no, "names": "".join(held).encode(),
                "name_chars": _packed(np.array([len(w) for w in held])),
                "per_name": _packed(per), "docs": _packed(doc_at[at]), "times": _packed(times[at])})
        sizes = pa.compute.binary_length(part.column("text")).to_pylist()
        rows.append({
            "bucket": no % buckets, "slice": base + no, "ids": part.column("doc_id").to_pylist(),
            "sizes": [s or 0 for s in sizes]})
        yield pa.RecordBatch.from_pylist(rows, schema=_PARTS)


_HEAD = [("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))]
_PARTS = pa.schema([("bucket", pa.int32()), ("slice", pa.int64())] + [
    (n, pa.binary()) for n in ("names", "name_chars", "per_name", "docs", "times")] + _HEAD)
_SUMS = pa.schema([("slice", pa.int64()), ("docs", pa.binary()), ("n", pa.binary())] + _HEAD)
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def _packed(values: np.ndarray) -> bytes:
    """Counts in the least width that holds them, told by the first byte."""
    width = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([width.itemsize]) + values.astype(width).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"u{raw[0]}", offset=1).astype(np.int64)


def piece_counts(words: list[str], sp) -> list[int]:
    """Pieces of each pre-token; its first space is the one the library adds."""
    alone = 1 if sp.piece_to_id("▁") != sp.unk_id() else 3
    found = sp.encode([w[1:] for w in words], num_threads=1)
    return [alone if w == " " else len(ids) for w, ids in zip(words, found, strict=True)]


def _summed(batches: Iterator[pa.RecordBatch], proto: bytes) -> Iterator[pa.RecordBatch]:
    """Count each distinct pre-token of this task's bucket once; sum per document."""
    sp, known = processor(proto), {}
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if r["ids"] is not None:
                rows.append({"slice": r["slice"], "ids": r["ids"], "sizes": r["sizes"]})
                continue
            text, ends = r["names"].decode(), np.cumsum(_unpacked(r["name_chars"])).tolist()
            words = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            if new := [w for w in words if w not in known]:
                known.update(zip(new, piece_counts(new, sp), strict=True))
            each = np.repeat(np.array([known[w] for w in words], np.int64), _unpacked(r["per_name"]))
            docs = _unpacked(r["docs"])
            n = np.bincount(docs, weights=each * _unpacked(r["times"])).astype(np.int64)
            at = np.flatnonzero(n)
            rows.append({"slice": r["slice"], "docs": _packed(at), "n": _packed(n[at])})
        yield pa.RecordBatch.from_pylist(rows, schema=_SUMS)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the buckets' sums of each slice; all rows of a slice are in this task."""
    heads, sums = {}, {}
    for batch in batches:
        for r in batch.to_pylist():
            if r["ids"] is not None:
                heads[r["slice"]] = r["ids"], r["sizes"]
                continue
            at, n = _unpacked(r["docs"]), _unpacked(r["n"])
            have = sums.setdefault(r["slice"], np.zeros(0, np.int64))
            if len(at) and at[-1] >= len(have):
                have = sums[r["slice"]] = np.concatenate([have, np.zeros(int(at[-1]) + 1 - len(have), np.int64)])
            have[at] += n
    for no, (ids, sizes) in heads.items():
        n = sums.get(no, np.zeros(0, np.int64))
        n = np.concatenate([n, np.zeros(len(ids) - len(n), np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(n)], schema=_OUT)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    No begin, end or added tokens; whole texts. A null or empty text has no
    tokens. Repeated rows and null ids are counted row by row. An empty table
    gives no rows; extra columns are ignored.
    """
    proto, parts = model_bytes(model_path), shuffle_parts(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    met = rows.mapInArrow(lambda it: _counted(it, parts), PARTS)
    sums = met.repartitionById(parts, F.col("bucket")).mapInArrow(lambda it: _summed(it, proto), SUMS)
    return sums.repartition(parts, "slice").mapInArrow(_added, OUT).withColumn("over_limit", F.col("n_tokens") > limit)
