"""Token ids in training order: fixed-stride shards addressed by global slot.

Every document is tokenised, closed with the end id and cut into sequences.
Sequences are numbered in input order; a keyed Feistel network with
cycle-walking turns number i of n into slot i' of n, a bijection that needs no
table, so the order of training is random, repeatable and invertible. Ranges of
slots are sorted and written as shards of equal records, so slot s is found at
a byte offset and a reader resumes anywhere. A shard appears under its name
only when complete, and a complete one is not written again.

Before they lie in shards, ids are kept and exchanged in a code of one byte for
frequent ids and two for others, and the sequences a task sends to one range of
slots travel as one compressed pack.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import sys
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import slices
from tidewatch.llm.pieces import coded_pretokens, model_bytes, processor
from tidewatch.session import fresh_path

SLICE_BYTES = 2 << 20
#: Pre-tokens remembered per task; the memory is bounded, the result the same.
KNOWN = 1_000_000
#: Coded ids a task gathers before it packs them, so that a pack holds several sequences.
PACK_BYTES = 16 << 20
#: Texts and characters of each that the frequent ids are taken from.
SAMPLE_TEXTS, SAMPLE_CHARS = 500, 4000
HEAD = np.dtype([("doc_id", "<i8"), ("seq_no", "<u4"), ("n_tokens", "<u4")])
WITHOUT_ID = -(2**63)


@dataclass(frozen=True)
class OrderConfig:
    """seq_len: ids of a record (shorter ones are padded with the end id).
    shard_rows: records of a shard. key: of the permutation. most_tasks: more
    shards than this are written several to a task, as ranges of slots."""

    seq_len: int = 256
    shard_rows: int = 8192
    key: int = 20240229
    rounds: int = 4
    most_tasks: int = 20_000

    @property
    def stride(self) -> int:
        return HEAD.itemsize + 2 * self.seq_len


def permuted(i: np.ndarray, n: int, cfg: OrderConfig, back: bool = False) -> np.ndarray:
    """Slot of each sequence number below ``n``; ``back`` gives numbers of slots."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{cfg.key}:{r}".encode()).digest()[:8], "little")) for r in range(cfg.rounds)]

    def mixed(x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & mask

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for key in reversed(keys) if back else keys:
            if back:
                left, right = right ^ mixed(left, key), left
            else:
                left, right = right, left ^ mixed(right, key)
        return left << np.uint64(half) | right

    out = network(i.astype(np.uint64))
    while (outside := out >= n).any():  # walk the cycle back into the range
        out[outside] = network(out[outside])
    return out.astype(np.int64)


@dataclass(frozen=True)
class IdCode:
    """ranks: place of each id by frequency. short: ids of a smaller rank take one byte, the others two.

    Leading bytes and second bytes are kept apart. Every id has a code, whatever the ranks are.
    """

    ranks: np.ndarray
    short: int

    @classmethod
    def of(cls, counts: np.ndarray) -> IdCode:
        ranks = np.empty(len(counts), np.int32)
        ranks[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        return cls(ranks, (65536 - len(counts)) // 255)

    def coded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leading bytes, second bytes, and how many second bytes stand before each id and at the end."""
        rank = self.ranks[ids]
        long = rank >= self.short
        rest = rank - self.short
        lead = np.where(long, self.short + (rest >> 8), rank).astype(np.uint8)
        before = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(long, out=before[1:])
        return lead, rest[long].astype(np.uint8), before

    def decoded(self, lead: np.ndarray, tail: np.ndarray) -> np.ndarray:
        rank = lead.astype(np.int32)
        long = rank >= self.short
        rank[long] = ((rank[long] - self.short) << 8) + tail + self.short
        return np.argsort(self.ranks)[rank].astype("<u2")


def id_code(texts: Iterable[str | None], proto: bytes) -> IdCode:
    """The code that suits these texts."""
    sp = processor(proto)
    ids = [np.array(x, np.int64) for x in sp.encode([t for t in texts if t], num_threads=1)]
    return IdCode.of(np.bincount(np.concatenate([np.array([sp.eos_id()]), *ids]), minlength=sp.vocab_size()))


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie one after another in ``data``; ``ends`` begins with 0."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [
        None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


SEQ = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("no", pa.int64()), ("seq_no", pa.int32()), ("crc", pa.int64()),
                 ("lead", pa.binary()), ("tail", pa.binary())])
SEQ_SQL = "doc_id long, part long, no long, seq_no int, crc long, lead binary, tail binary"


def _sequences(batches: Iterator[pa.RecordBatch], proto: bytes, code: IdCode, cfg: OrderConfig) -> Iterator[pa.RecordBatch]:
    sp, part, no = processor(proto), TaskContext.get().partitionId(), 0
    if sp.vocab_size() > 1 << 16 or sys.byteorder != "little":
        raise ValueError("ids must fit in two little-endian bytes")
    alone, known = sp.piece_to_id("▁"), {}
    for piece in slices(batches, "text", SLICE_BYTES):
        if not known or len(known) > KNOWN:
            # number of each pre-token seen, the ids of all, and where each begins; number 0 is the end id
            known, ids, begins = {"": 0}, np.array([sp.eos_id()], "<u2"), np.array([0, 1])
        words, each, at = coded_pretokens(piece.column("text").to_pylist())
        new = [w for w in words if w not in known]
        found = [[alone] if w == " " else x for w, x in zip(new, sp.encode([w[1:] for w in new], num_threads=1), strict=True)]
        known.update(zip(new, itertools.count(len(known))))
        ids = np.concatenate([ids, np.fromiter(itertools.chain.from_iterable(found), "<u2")])
        begins = np.concatenate([begins, begins[-1] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        at = np.insert(np.fromiter(map(known.__getitem__, words), np.int64, len(words))[at], np.cumsum(each), 0)
        lens = np.diff(begins)[at]
        ends = np.concatenate([[0], np.cumsum(lens)])
        whole_ids = ids[np.repeat(begins[at] - ends[:-1], lens) + np.arange(ends[-1])]
        sizes = np.diff(ends[np.concatenate([[0], np.cumsum(each + 1)])])
        # documents lie one after another, and so do their sequences
        each = -(-sizes // cfg.seq_len)
        seq = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        n = np.minimum(cfg.seq_len, np.repeat(sizes, each) - seq * cfg.seq_len)
        ends = np.concatenate([[0], np.cumsum(n)])
        whole = memoryview(whole_ids.tobytes())
        crc = [zlib.crc32(whole[a:b]) for a, b in itertools.pairwise((2 * ends).tolist())]
        lead, tail, before = code.coded(whole_ids)
        yield pa.RecordBatch.from_arrays([
            piece.column("doc_id").take(pa.array(np.repeat(np.arange(len(sizes)), each))), pa.array(np.full(len(seq), part)),
            pa.array(no + np.arange(len(seq))), pa.array(seq.astype(np.int32)), pa.array(crc, pa.int64()),
            _binary(lead, ends), _binary(tail, before[ends])], schema=SEQ)
        no += len(seq)


PACK = pa.schema([("range_no", pa.int32()), ("n", pa.int32()), ("size", pa.int32()), ("pack", pa.binary())])
PACK_SQL = "range_no int, n int, size int, pack binary"
#: What a pack holds of its sequences, column after column, before the coded ids.
COLUMNS = [("slot", "<i8"), ("doc_id", "<i8"), ("known", "?"), ("seq_no", "<i4"), ("n_lead", "<i4"), ("n_tail", "<i4")]
SLOTTED = pa.schema([("slot", pa.int64()), ("doc_id", pa.int64()), ("seq_no", pa.int32()), ("ids", pa.binary())])
SLOTTED_SQL = "slot long, doc_id long, seq_no int, ids binary"


def _packed(held: list[pa.RecordBatch], offsets: dict[int, int], n: int, shards: int, tasks: int, cfg: OrderConfig) -> pa.RecordBatch:
    """One pack for each range of slots that these sequences go to."""
    t = pa.Table.from_batches(held)
    part = t.column("part").to_numpy()
    at, inverse = np.unique(part, return_inverse=True)
    slot = permuted(np.array([offsets[p] for p in at.tolist()], np.int64)[inverse] + t.column("no").to_numpy(), n, cfg)
    range_no = slot // cfg.shard_rows * tasks // shards
    order = np.argsort(range_no, kind="stable")
    t, slot, range_no = t.take(pa.array(order)), slot[order], range_no[order]
    lead, tail = (t.column(c).combine_chunks().cast(pa.binary()) for c in ("lead", "tail"))
    doc = t.column("doc_id")
    columns = [slot, doc.fill_null(WITHOUT_ID).to_numpy(), doc.is_valid().to_numpy(), t.column("seq_no").to_numpy(),
               *(pa.compute.binary_length(x).to_numpy() for x in (lead, tail))]
    columns = [c.astype(kind) for c, (_, kind) in zip(columns, COLUMNS, strict=True)]
    ends = [np.frombuffer(x.buffers()[1], np.int32, len(x) + 1, 4 * x.offset).tolist() for x in (lead, tail)]
    leads, tails = (memoryview(x.buffers()[2]) for x in (lead, tail))
    first = np.flatnonzero(np.diff(range_no, prepend=-1)).tolist()
    codec, rows = pa.Codec("zstd"), []
    for a, b in itertools.pairwise([*first, len(slot)]):
        raw = b"".join([*(c[a:b].tobytes() for c in columns), leads[ends[0][a]:ends[0][b]], tails[ends[1][a]:ends[1][b]]])
        rows.append((int(range_no[a]), b - a, len(raw), codec.compress(raw, asbytes=True)))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PACK, strict=True)], schema=PACK)


def _packs(batches: Iterator[pa.RecordBatch], offsets: dict[int, int], n: int, shards: int, tasks: int, cfg: OrderConfig) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.nbytes for x in held) >= PACK_BYTES:
            yield _packed(held, offsets, n, shards, tasks, cfg)
            held = []
    if held:
        yield _packed(held, offsets, n, shards, tasks, cfg)


def _unpacked(batches: Iterator[pa.RecordBatch], code: IdCode) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd")
    for b in batches:
        for n, size, pack in zip(*(b.column(c).to_pylist() for c in ("n", "size", "pack")), strict=True):
            raw, at, found = codec.decompress(pack, size, asbytes=True), 0, {}
            for name, kind in COLUMNS:
                found[name] = np.frombuffer(raw, kind, n, at)
                at += found[name].nbytes
            leads = int(found["n_lead"].sum())
            ids = code.decoded(np.frombuffer(raw, np.uint8, leads, at), np.frombuffer(raw, np.uint8, offset=at + leads))
            yield pa.RecordBatch.from_arrays([
                pa.array(found["slot"]), pa.array(found["doc_id"], mask=~found["known"]), pa.array(found["seq_no"]),
                _binary(ids, np.concatenate([[0], np.cumsum(2 * found["n_lead"])]))], schema=SLOTTED)


PLACED = pa.schema([("doc_id", pa.int64()), ("seq_no", pa.int32()), ("slot", pa.int64()), ("shard", pa.int64()),
                    ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string())])
PLACED_SQL = "doc_id long, seq_no int, slot long, shard long, place long, n_tokens long, ids_sha256 string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder given as URI or plain path."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def shard_name(shard: int) -> str:
    return f"shard-{shard:012d}.bin"


def _written(batches: Iterator[pa.RecordBatch], path: str, pad: int, cfg: OrderConfig) -> Iterator[pa.RecordBatch]:
    """Write the records, which arrive in slot order, shard after shard."""
    store, folder = opened(path)
    store.create_dir(folder)
    shard, out, temp = None, None, ""

    def close() -> None:
        if out is not None:
            out.close()
            store.move(temp, f"{folder}/{shard_name(shard)}")

    try:
        for b in batches:
            slot = b.column("slot").to_numpy()
            sizes = pa.compute.binary_length(b.column("ids")).to_numpy() // 2
            rows = np.zeros(len(slot), np.dtype([("head", HEAD), ("ids", "<u2", cfg.seq_len)]))
            rows["head"]["doc_id"] = b.column("doc_id").fill_null(WITHOUT_ID).to_numpy()
            rows["head"]["seq_no"] = b.column("seq_no").to_numpy()
            rows["head"]["n_tokens"] = sizes
            rows["ids"] = pad
            held = b.column("ids").to_pylist()
            ids = np.frombuffer(b"".join(held), "<u2")
            rows["ids"][np.arange(cfg.seq_len) < sizes[:, None]] = ids
            shards = slot // cfg.shard_rows
            for s in np.unique(shards).tolist():
                if s != shard:
                    close()
                    shard, temp = s, f"{folder}/.{shard_name(s)}.{uuid.uuid4().hex}"
                    ready = store.get_file_info(f"{folder}/{shard_name(s)}").type == fs.FileType.File
                    out = None if ready else store.open_output_stream(temp)
                if out is not None:
                    out.write(rows[shards == s].tobytes())
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), b.column("seq_no"), b.column("slot"), pa.array(shards), pa.array(slot % cfg.shard_rows),
                pa.array(sizes.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in held])], schema=PLACED)
        close()
        out = None
    finally:
        if out is not None:
            out.close()


MANIFEST = "manifest.json"


def claim(path: str, manifest: dict) -> None:
    """Write the folder's manifest, or check the one that is there; raises if it is of other sequences."""
    store, folder = opened(path)
    store.create_dir(folder)
    at, found = f"{folder}/{MANIFEST}", store.get_file_info(fs.FileSelector(folder))
    for f in found:
        if f.base_name.startswith(".shard-"):  # left by tasks that were lost
            store.delete_file(f.path)
    if store.get_file_info(at).type == fs.FileType.File:
        with store.open_input_stream(at) as f:
            there = json.loads(f.read())
        if there != manifest:
            raise ValueError(f"{path} holds shards of other sequences or another setting")
        return
    if any(f.base_name.startswith("shard-") for f in found):
        raise ValueError(f"{path} holds shards without a manifest")
    with store.open_output_stream(at) as f:
        f.write(json.dumps(manifest, sort_keys=True).encode())


def _content(cut: DataFrame, model_path: str) -> str:
    """What the sequences are, whatever the order of rows within the parts."""
    seen = cut.agg(F.bit_xor(F.xxhash64("part", "no", "doc_id", "seq_no", "crc"))).first()[0]
    return f"{seen or 0:x} {hashlib.sha256(model_bytes(model_path)).hexdigest()}"


def materialise(docs: DataFrame, path: str, model_path: str, cfg: OrderConfig = OrderConfig(), id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Write shards under ``path``; one row per sequence when the result is evaluated.

    A folder keeps the shards of one set of sequences: its manifest is written
    first, and another set, key or length is refused. What is there of the same
    set is kept, so a run that was lost may be repeated.

    doc_id, seq_no (within the document), slot, shard, place (record in the
    shard), n_tokens, ids_sha256 (of the ids as little-endian two-byte
    numbers). A null or empty text is a sequence of the end id alone. Repeated
    rows are separate documents; an empty table writes nothing; extra columns
    are ignored. The same files, splits and key give the same slots.
    """
    spark, proto = docs.sparkSession, model_bytes(model_path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kept = fresh_path(spark, "sequences")
    # any code gives the same shards; one that suits the first texts keeps the others short too
    code = id_code([r[0] for r in rows.select(F.substring("text", 1, SAMPLE_CHARS)).limit(SAMPLE_TEXTS).collect()], proto)
    rows.mapInArrow(lambda it: _sequences(it, proto, code, cfg), SEQ_SQL).write.option("compression", "zstd").parquet(kept)
    cut = spark.read.schema(SEQ_SQL).parquet(kept)
    # one number per input partition
    parts = cut.groupBy("part").agg((F.max("no") + 1).alias("n")).orderBy("part").collect()
    ends = np.cumsum([r["n"] for r in parts])
    offsets = {r["part"]: int(e - r["n"]) for r, e in zip(parts, ends, strict=True)}
    n = int(ends[-1]) if len(ends) else 0
    shards = max(1, -(-n // cfg.shard_rows))
    tasks = min(shards, cfg.most_tasks)
    pad = processor(proto).eos_id()
    if n:
        claim(path, {"n": n, "key": cfg.key, "seq_len": cfg.seq_len, "shard_rows": cfg.shard_rows, "pad": pad,
                     "content": _content(cut, model_path)})
    packs = cut.drop("crc").mapInArrow(lambda it: _packs(it, offsets, n, shards, tasks, cfg), PACK_SQL)
    slotted = packs.repartitionById(tasks, F.col("range_no")).mapInArrow(lambda it: _unpacked(it, code), SLOTTED_SQL)
    return slotted.sortWithinPartitions("slot").mapInArrow(lambda it: _written(it, path, pad, cfg), PLACED_SQL)


def read_slots(path: str, first: int, count: int, cfg: OrderConfig = OrderConfig()) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, seq_no, ids) of ``count`` slots from ``first`` on, read in sequence."""
    store, folder = opened(path)
    while count > 0:
        shard, place = divmod(first, cfg.shard_rows)
        info = store.get_file_info(f"{folder}/{shard_name(shard)}")
        if info.type != fs.FileType.File:
            return
        take = min(count, info.size // cfg.stride - place)
        if take <= 0:
            return
        with store.open_input_file(info.path) as f:
            raw = f.read_at(take * cfg.stride, place * cfg.stride)
        for r in np.frombuffer(raw, np.dtype([("head", HEAD), ("ids", "<u2", cfg.seq_len)])):
            doc = int(r["head"]["doc_id"])
            yield None if doc == WITHOUT_ID else doc, int(r["head"]["seq_no"]), r["ids"][:r["head"]["n_tokens"]]
        first, count = first + take, count - take
