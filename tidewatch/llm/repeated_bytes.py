"""Repeated substrings across documents, found by suffix sorting in blocks.

Every ``length``-byte window has an anchor: the least hash of the shorter
strings inside it. Equal windows have equal anchors, and successive windows
mostly share theirs, so a text falls into stretches of one anchor each. First
only anchor hashes are exchanged, to learn which occur in two documents or
more; then the stretches of those, and no others, go to the task that owns
their anchor. There equal stretches of many documents are one string, the
strings are suffix-sorted in blocks, and each window learns the least document
that holds it. A passage in very many documents travels once per chunk of
documents, whatever the number of documents in the chunk.

Documents travel in chunks: some megabytes of text, compressed, written once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import shuffle_parts, slices
from tidewatch.llm.suffix_sort import least_owner
from tidewatch.session import fresh_path, stored

LAST = 2**63 - 1  # stands for a null id, after all others


@dataclass(frozen=True)
class RepeatConfig:
    """length: bytes of a repeated string. anchor: bytes hashed for anchors.
    chunk_bytes: text of a chunk. block_bytes: strings suffix-sorted together."""

    length: int = 50
    anchor: int = 24
    chunk_bytes: int = 4 << 20
    block_bytes: int = 1 << 20


CHUNK = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
                   ("raw_bytes", pa.int64()), ("body", pa.binary())])
CHUNK_SQL = "chunk long, ids array<long>, sizes array<long>, raw_bytes long, body binary"
MAIL = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64())] + [(c, pa.binary()) for c in ("a", "b", "c", "d")])
MAIL_SQL = "bucket int, chunk long, a binary, b binary, c binary, d binary"
REPLY = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("bits", pa.binary())])
REPLY_SQL = "chunk long, bucket int, bits binary"
OUT_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _chunked(batches: Iterator[pa.RecordBatch], cfg: RepeatConfig) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 32
    for no, part in enumerate(slices(batches, "text", cfg.chunk_bytes)):
        texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
        body = b"".join(texts)
        yield pa.RecordBatch.from_pylist([{
            "chunk": base + no, "ids": part.column("doc_id").to_pylist(), "sizes": [len(t) for t in texts],
            "raw_bytes": len(body), "body": pa.compress(body, codec="zstd", asbytes=True)}], schema=CHUNK)


class Chunk:
    """The text of one chunk and the anchor stretches of its windows."""

    def __init__(self, row: dict, cfg: RepeatConfig, parts: int):
        self.length, self.parts = cfg.length, parts
        self.ids = row["ids"]
        self.sizes = np.array(row["sizes"], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.body = pa.decompress(row["body"], decompressed_size=row["raw_bytes"], codec="zstd", asbytes=True) \
            if row["raw_bytes"] else b""
        self.text = np.frombuffer(self.body, np.uint8)
        least = _anchors(self.text, cfg)
        n = len(least)
        ok = np.zeros(n + 1, np.int32)
        counts = np.maximum(self.sizes - cfg.length + 1, 0)
        full = counts > 0
        first = (self.ends - self.sizes)[full]
        np.add.at(ok, first, 1)
        np.add.at(ok, first + counts[full], -1)
        ok = np.cumsum(ok)[:n] > 0
        new = ok.copy()
        new[1:] &= ~ok[:-1] | (least[1:] != least[:-1])
        self.start = np.flatnonzero(new)
        self.value = least[self.start]
        bound = np.flatnonzero(ok & ~np.append(ok[1:] & ~new[1:], False)) if n else np.zeros(0, np.int64)
        self.windows = bound + 1 - self.start
        self.doc = np.searchsorted(self.ends, self.start, side="right")
        self.owner = np.array([LAST if i is None else i for i in self.ids], np.int64)
        # distinct anchors of the chunk, and which of them two documents share already
        order = np.argsort(self.value, kind="stable")
        v, d = self.value[order], self.doc[order]
        new = np.ones(len(v), bool)
        new[1:] = v[1:] != v[:-1]
        self.distinct, rank = v[new], np.cumsum(new) - 1
        self.rank = np.empty(len(v), np.int64)
        self.rank[order] = rank
        self.shared_here = np.zeros(len(self.distinct), bool)
        self.shared_here[rank[1:][~new[1:] & (d[1:] != d[:-1])]] = True
        self.bucket = (self.distinct >> np.uint64(40)).astype(np.int64) % parts

    def flag(self, bits: list[dict]) -> None:
        """Mark the anchors that other chunks share, as the replies say, and pick what travels."""
        shared = self.shared_here.copy()
        for r in bits:
            at = np.flatnonzero(self.bucket == r["bucket"])
            shared[at] |= np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=len(at)).astype(bool)
        hit = np.flatnonzero(shared[self.rank])
        self.hit = hit
        # equal stretches travel once, with the least document of the chunk
        names: dict[bytes, int] = {}
        stops = self.start[hit] + self.windows[hit] + self.length - 1
        body = self.body
        self.string = np.array([names.setdefault(body[a:b], len(names)) for a, b in zip(
            self.start[hit].tolist(), stops.tolist(), strict=True)], np.int64)
        self.strings = list(names)
        self.least = np.full(len(names), LAST, np.int64)
        np.minimum.at(self.least, self.string, self.owner[self.doc[hit]])
        seen, at = np.unique(self.string, return_index=True)
        self.string_value = self.value[hit][at]
        self.string_windows = self.windows[hit][at]
        self.string_bucket = (self.string_value >> np.uint64(40)).astype(np.int64) % self.parts


def _anchors(text: np.ndarray, cfg: RepeatConfig) -> np.ndarray:
    """For each window the least hash of the anchor-sized strings in it."""
    n = len(text)
    if n < cfg.length:
        return np.zeros(0, np.uint64)
    mix = np.uint64(0x9E3779B97F4A7C15)
    h, width = (text.astype(np.uint64) + np.uint64(1)) * mix, 1
    tower = {1: h}
    while width * 2 <= cfg.anchor:
        factor = np.uint64(pow(0x100000001B3, width, 1 << 64))
        h = h[:-width] * factor + h[width:]
        width *= 2
        tower[width] = h
    got, have = tower[width], width
    for size in sorted(tower, reverse=True):
        while cfg.anchor - have >= size:
            factor = np.uint64(pow(0x100000001B3, size, 1 << 64))
            m = n - have - size + 1
            got = got[:m] * factor + tower[size][have:have + m]
            have += size
    got = got ^ (got >> np.uint64(31))
    got *= np.uint64(0xD6E8FEB86659FD93)
    got ^= got >> np.uint64(32)
    span, reach = cfg.length - cfg.anchor + 1, 1
    low = got
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if span > reach:
        low = np.minimum(low[:len(low) - (span - reach)], low[span - reach:])
    return low


def _ask(batches: Iterator[pa.RecordBatch], cfg: RepeatConfig, parts: int) -> Iterator[pa.RecordBatch]:
    """The distinct anchors of each chunk, 40 bits each, to the tasks that own them."""
    for batch in batches:
        for row in batch.to_pylist():
            c = Chunk(row, cfg, parts)
            order = np.argsort(c.bucket, kind="stable")
            low = c.distinct[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            edges = np.searchsorted(c.bucket[order], np.arange(parts + 1))
            rows = [{"bucket": int(b), "chunk": row["chunk"], "a": low[edges[b]:edges[b + 1]].tobytes()}
                    for b in np.flatnonzero(np.diff(edges))]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=MAIL)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which anchors of each chunk are also another chunk's."""
    rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("chunk", "bucket", "a")), strict=True)]
    if not rows:
        return
    values = []
    for _, _, raw in rows:
        v = np.zeros((len(raw) // 5, 8), np.uint8)
        v[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
        values.append(v.view("<u8").ravel())
    every = np.sort(np.concatenate(values))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    for (chunk, bucket, _), v in zip(rows, values, strict=True):
        at = np.minimum(np.searchsorted(twice, v), max(0, len(twice) - 1))
        bits = np.packbits(twice[at] == v if len(twice) else np.zeros(len(v), bool))
        if bits.any():
            yield pa.RecordBatch.from_pylist([{"chunk": chunk, "bucket": bucket, "bits": bits.tobytes()}], schema=REPLY)


def _flagged(row: dict, cfg: RepeatConfig, parts: int) -> Chunk:
    c = Chunk(row, cfg, parts)
    c.flag(row["flags"] or [])
    return c


def _send(batches: Iterator[pa.RecordBatch], cfg: RepeatConfig, parts: int) -> Iterator[pa.RecordBatch]:
    """The shared stretches of each chunk, to the tasks that own their anchors."""
    for batch in batches:
        for row in batch.to_pylist():
            c = _flagged(row, cfg, parts)
            order = np.argsort(c.string_bucket, kind="stable")
            edges = np.searchsorted(c.string_bucket[order], np.arange(parts + 1))
            for b in np.flatnonzero(np.diff(edges)):
                at = order[edges[b]:edges[b + 1]]
                held = [c.strings[i] for i in at]
                yield pa.RecordBatch.from_pylist([{
                    "bucket": int(b), "chunk": row["chunk"], "a": b"".join(held),
                    "b": np.array([len(s) for s in held], "<i8").tobytes(), "c": c.least[at].tobytes(),
                    "d": c.string_value[at].tobytes()}], schema=MAIL)


def _sorted_out(batches: Iterator[pa.RecordBatch], cfg: RepeatConfig) -> Iterator[pa.RecordBatch]:
    """Suffix-sort all strings of a bucket in blocks of whole anchors; answer every sender."""
    names: dict[bytes, int] = {}
    value, owner, senders = [], [], []
    for batch in batches:
        for r in batch.to_pylist():
            ends = np.cumsum(np.frombuffer(r["b"], "<i8")).tolist()
            at = np.array([names.setdefault(r["a"][a:b], len(names)) for a, b in zip([0, *ends], ends, strict=False)], np.int64)
            least, anchor = np.frombuffer(r["c"], np.int64), np.frombuffer(r["d"], np.uint64)
            fresh = np.flatnonzero(at >= len(value))
            value.extend(anchor[fresh].tolist())
            owner.extend(least[fresh].tolist())
            for i, o in zip(at.tolist(), least.tolist(), strict=True):
                if o < owner[i]:
                    owner[i] = o
            senders.append((r["chunk"], r["bucket"], at, least))
    if not names:
        return
    strings, value, owner = list(names), np.array(value, np.uint64), np.array(owner, np.int64)
    order = np.argsort(value, kind="stable")
    sizes = np.array([len(s) for s in strings], np.int64)
    counts = sizes - cfg.length + 1
    found: list[np.ndarray | None] = [None] * len(strings)
    cut, held = 0, 0
    for k in range(len(order) + 1):
        last = k == len(order)
        if last or (held >= cfg.block_bytes and value[order[k]] != value[order[k - 1]]):
            at = order[cut:k]
            if len(at):
                got = np.split(least_owner([strings[i] for i in at], owner[at], cfg.length), np.cumsum(counts[at])[:-1])
                for i, g in zip(at.tolist(), got, strict=True):
                    found[i] = g
            cut, held = k, 0
        if not last:
            held += int(sizes[order[k]])
    for chunk, bucket, at, least in senders:
        smaller = np.concatenate([found[i] for i in at]) < np.repeat(least, counts[at])
        yield pa.RecordBatch.from_pylist([{
            "chunk": chunk, "bucket": bucket, "bits": np.packbits(smaller).tobytes()}], schema=REPLY)


def _finished(batches: Iterator[pa.RecordBatch], cfg: RepeatConfig, parts: int) -> Iterator[pa.RecordBatch]:
    """Mark the removed bytes of each document and digest the rest."""
    for batch in batches:
        for row in batch.to_pylist():
            c = _flagged(row, cfg, parts)
            removed = _removed(c, row["answers"] or [])
            first = np.concatenate([[True], ~removed[:-1]]) if len(removed) else removed
            total, begins = np.concatenate([[0], np.cumsum(removed)]), c.ends - c.sizes
            out = []
            for i, (a, b) in enumerate(zip(begins.tolist(), c.ends.tolist(), strict=True)):
                gone = removed[a:b]
                spans = int((gone & first[a:b]).sum()) + int(b > a and gone[0] and not first[a])
                kept = c.text[a:b][~gone].tobytes() if total[b] > total[a] else c.body[a:b]
                out.append((c.ids[i], b - a, int(total[b] - total[a]), spans, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _removed(c: Chunk, answers: list[dict]) -> np.ndarray:
    firsts = np.cumsum(c.string_windows) - c.string_windows
    smaller = np.zeros(int(c.string_windows.sum()), bool)
    for r in answers:
        at = np.flatnonzero(c.string_bucket == r["bucket"])
        sizes = c.string_windows[at]
        to = np.repeat(firsts[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        smaller[to] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=len(to)).astype(bool)
    # each stretch takes the answers of its string; a later document than the sender loses all of it
    sizes = c.windows[c.hit]
    step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    gone = smaller[np.repeat(firsts[c.string], sizes) + step]
    gone |= np.repeat(c.owner[c.doc[c.hit]] > c.least[c.string], sizes)
    at = (np.repeat(c.start[c.hit], sizes) + step)[gone]
    edge = np.bincount(at, minlength=len(c.text) + 1)[:len(c.text) + 1].astype(np.int64)
    edge -= np.bincount(at + c.length, minlength=len(c.text) + 1)[:len(c.text) + 1]
    return np.cumsum(edge)[:len(c.text)] > 0


def without_repeats(docs: DataFrame, cfg: RepeatConfig = RepeatConfig(), id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes (null: empty). A byte goes if a ``cfg.length``-byte
    string over it also starts in a document of smaller id, judged on the input
    texts. Rows of equal id never remove each other's bytes; a null id counts
    as larger than any other. Texts shorter than the length are untouched. An
    empty table gives no rows; extra columns are ignored.
    """
    spark, parts = docs.sparkSession, shuffle_parts(docs)
    path = fresh_path(spark, "chunks")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows.mapInArrow(lambda it: _chunked(it, cfg), CHUNK_SQL).write.option("compression", "none").parquet(path)
    chunks = spark.read.schema(CHUNK_SQL).parquet(path)
    shared = chunks.mapInArrow(lambda it: _ask(it, cfg, parts), MAIL_SQL).select("bucket", "chunk", "a").repartitionById(
        parts, F.col("bucket")).mapInArrow(_shared, REPLY_SQL)
    flags = shared.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("flags"))
    told = chunks.join(stored(flags, "flags"), "chunk", "left")
    answers = told.mapInArrow(lambda it: _send(it, cfg, parts), MAIL_SQL).repartitionById(
        parts, F.col("bucket")).mapInArrow(lambda it: _sorted_out(it, cfg), REPLY_SQL)
    whole = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))
    return told.join(whole, "chunk", "left").mapInArrow(lambda it: _finished(it, cfg, parts), OUT_SQL)
