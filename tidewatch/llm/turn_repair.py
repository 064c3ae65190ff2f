"""Conversation structure repair by a run-length dynamic programme.

Turns become symbols of role and fault. Four states (nothing yet, after a
system, a user, an assistant turn) say which turn may follow; keeping,
re-roling, deleting and inserting are edges with costs, so a turn is a 4 x 4
min-plus matrix. Equal consecutive symbols are one run; a run of any length is
advanced through cached binary powers of its matrix.

A conversation is cut into pieces wherever a batch of sorted turns ends, each
reduced to one matrix in its own task. A walk back over the few matrices gives
what follows every piece, the pieces are unrolled apart for every state they
may be entered in, and a walk forward picks the states. So one conversation may
hold a third of all rows; only its matrices and its audit string, which is one
cell of the result, come together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidewatch.llm.common import SPACES
from tidewatch.session import stored

START, SYSTEM, USER, ASSISTANT = range(4)
#: Role initials as codes, and the codes of faults.
INITIALS, OTHER = "sua", 3
SOUND, TRUNCATED, GONE = range(3)
#: State after keeping a turn with initial s, u, a or another; after putting the turn that is due.
KEPT = ((SYSTEM, USER, None, None), (None, USER, None, None), (None, None, ASSISTANT, None), (None, USER, None, None))
DUE = (USER, USER, ASSISTANT, USER)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 50


@dataclass(frozen=True)
class RepairCosts:
    """Costs of the edits; keeping is free. All must be positive.

    truncated: added for a truncated turn that is not deleted. Blank and
    repeated turns have to be deleted.
    """

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def symbol(role: int, fault: int) -> int:
    """Role and fault in one small number; the role of a turn that must go does not matter."""
    return 3 * (OTHER if fault == GONE else role) + fault


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), FAR)


class Repair:
    """Matrices, powers and choices for one set of costs, made once a task."""

    def __init__(self, costs: RepairCosts) -> None:
        self.costs = costs
        put = np.full((4, 4), FAR)
        np.fill_diagonal(put, 0)
        for s in range(4):
            put[s, DUE[s]] = costs.insert
        self.put = _times(put, _times(put, put))  # any number of insertions
        self.edges = {}
        for role in range(4):
            for fault in (SOUND, TRUNCATED, GONE):
                more = costs.truncated if fault == TRUNCATED else 0
                edges = [[("D", costs.delete, s)] for s in range(4)]
                for s in range(4):
                    if fault != GONE:
                        if KEPT[s][role] is not None:
                            edges[s].append(("K", more, KEPT[s][role]))
                        edges[s].append(("R", costs.rerole + more, DUE[s]))
                self.edges[symbol(role, fault)] = edges
        self.powers = {x: [_times(self.put, self._row(x))] for x in self.edges}
        self.end = tuple(int(min(self.put[s, START], self.put[s, ASSISTANT])) for s in range(4))
        self.step = lru_cache(1 << 16)(self._step)
        self.choice = lru_cache(1 << 16)(self._choice)
        self.short = lru_cache(1 << 12)(self._matrix)

    def _row(self, x: int) -> np.ndarray:
        m = np.full((4, 4), FAR)
        for s in range(4):
            for _, cost, t in self.edges[x][s]:
                m[s, t] = min(m[s, t], cost)
        return m

    def _matrix(self, runs: tuple[tuple[int, int], ...]) -> np.ndarray:
        whole = None
        for x, n in runs:
            powers, k = self.powers[x], 0
            while n >> k:
                if k == len(powers):
                    powers.append(_times(powers[-1], powers[-1]))
                if n >> k & 1:
                    whole = powers[k] if whole is None else _times(whole, powers[k])
                k += 1
        return whole

    def matrix(self, runs: tuple[tuple[int, int], ...]) -> np.ndarray:
        """Least cost from any state before the runs to any after them, insertions after them left open."""
        return self.short(runs) if len(runs) <= 32 else self._matrix(runs)

    def _step(self, x: int, after: tuple[int, ...]) -> tuple[int, ...]:
        """Costs to the end before a turn, less their least, from those after it."""
        before = (self.powers[x][0] + np.array(after)).min(axis=1)
        return tuple((before - before.min()).tolist())

    def _choice(self, x: int, after: tuple[int, ...], state: int) -> tuple[str, int]:
        """Letters up to and with the turn's own, of the cheapest way that is least in ASCII, and the next state."""
        whole = (self.powers[x][0] + np.array(after)).min(axis=1)
        letters = ""
        while True:
            ways = [(name, cost + after[t], t, True) for name, cost, t in self.edges[x][state]]
            ways.append(("I", self.costs.insert + int(whole[DUE[state]]), DUE[state], False))
            name, _, state, done = min(w for w in ways if w[1] == whole[state])
            letters += name
            if done:
                return letters, state

    def unroll(self, runs: list[tuple[int, int]], after: tuple[int, ...], starts: list[int]) -> list[tuple[str, int]]:
        """Edits and last state for each first state; ``after`` are the costs that follow the runs."""
        seen = [after]
        symbols = [x for x, n in runs for _ in range(n)]
        for x in reversed(symbols):
            seen.append(self.step(x, seen[-1]))
        seen.reverse()
        out = []
        for state in starts:
            edits = []
            for x, later in zip(symbols, seen[1:], strict=True):
                letters, state = self.choice(x, later, state)
                edits.append(letters)
            out.append(("".join(edits), state))
        return out

    def tail(self, state: int) -> str:
        """Insertions after the last turn."""
        out = ""
        while state not in (START, ASSISTANT):
            out, state = out + "I", DUE[state]
        return out


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def _ordered(rows: DataFrame) -> DataFrame:
    """conv, turn, role code, digest, blank, truncated, copies, first: one row for equal turns, whatever their number."""
    bare = F.regexp_replace("text", SPACES, "")
    start = F.substring("role", 1, 1)
    code = F.when(start == "s", 0).when(start == "u", 1).when(start == "a", 2).otherwise(OTHER)
    light = rows.select(
        "conv", "turn", "role", _digest(F.col("role"), F.col("text")).alias("digest"), code.alias("code"),
        (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
    light = light.groupBy("conv", "turn", "role", "digest", "code", "blank", "cut").agg(F.count("*").alias("n"))
    light = stored(light, "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = light.groupBy("conv", "digest").agg(F.min(place).alias("first"), F.count("*").alias("found")).filter(
        "found > 1").select(F.col("conv").alias("c"), F.col("digest").alias("d"), "first")
    met = light.join(again, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    return met.select("conv", "turn", "role", "digest", "code", "blank", "cut", "n",
                      (F.col("first").isNull() | (F.col("first") == place)).alias("first"))


PIECE = ("piece long, symbols binary, lengths array<long>, matrix array<long>, first_code int, last_code int, "
         "first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long")


def _legal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))


def _pieces(batches: Iterator[pa.RecordBatch], costs: RepairCosts) -> Iterator[pa.RecordBatch]:
    """One row for every conversation of a batch: its runs, its matrix and counts that add up."""
    repair, at = Repair(costs), TaskContext.get().partitionId() << 40
    for batch in batches:
        conv = batch.column("conv").to_pylist()
        col = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("code", "n", "first", "blank", "cut")}
        turn = batch.column("turn").to_pylist()
        # of equal turns the first may stay, the others repeat it
        sole = col["first"] & ~col["blank"]
        fault = np.where(~sole, GONE, np.where(col["cut"], TRUNCATED, SOUND))
        first = 3 * np.where(fault == GONE, OTHER, col["code"]) + fault
        sym = np.stack([first, np.full(len(first), symbol(OTHER, GONE))], 1)
        size = np.stack([np.ones_like(col["n"]), col["n"] - 1], 1)
        edges = [0, *(k for k in range(1, len(conv)) if conv[k] != conv[k - 1]), len(conv)]
        rows = []
        for a, b in zip(edges, edges[1:], strict=False):
            s, n = sym[a:b].ravel(), size[a:b].ravel()
            s, n = s[n > 0], n[n > 0]
            new = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            s, n = s[new], np.add.reduceat(n, new)
            code, copies, known = col["code"][a:b], col["n"][a:b], [t for t in turn[a:b] if t is not None]
            illegal = (copies - 1).sum() + (~_legal(code[:-1], code[1:])).sum()  # no role may follow itself
            blank = copies[col["blank"][a:b]].sum()
            single = sole[a:b]
            rows.append({
                "conv": conv[a], "piece": at, "symbols": s.astype(np.uint8).tobytes(), "lengths": n.tolist(),
                "matrix": repair.matrix(tuple(zip(s.tolist(), n.tolist(), strict=True))).ravel().tolist(),
                "first_code": int(code[0]), "last_code": int(code[-1]),
                "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "turns": len(set(known)),
                "blank": int(blank), "duplicate": int(copies.sum() - blank - single.sum()),
                "truncated": int((single & col["cut"][a:b]).sum()), "illegal": int(illegal)})
            at += 1
        yield _batch(rows, batch.schema.field("conv"), PIECE_ARROW)


PIECE_ARROW = [
    ("piece", pa.int64()), ("symbols", pa.binary()), ("lengths", pa.list_(pa.int64())), ("matrix", pa.list_(pa.int64())),
    ("first_code", pa.int32()), ("last_code", pa.int32()),
    *((k, pa.int64()) for k in ("first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal"))]
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
AFTER_ARROW = [("piece", pa.int64()), ("after", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())),
               *((k, pa.int64()) for k in COUNTS)]


def _batch(rows: list[dict], conv: pa.Field, fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([conv.with_name("conv"), *fields]))


def _afters(batches: Iterator[pa.RecordBatch], costs: RepairCosts) -> Iterator[pa.RecordBatch]:
    """For each piece what follows it costs, and the states it may be entered in; counts come with the first piece."""
    repair = Repair(costs)
    for batch in batches:
        rows = []
        for conv, pieces in zip(batch.column("conv").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
            after, offset, own = repair.end, 0, []
            for p in reversed(pieces):
                own.append({"conv": conv, "piece": p["piece"], "after": list(after), "starts": list(range(4))})
                before = (np.array(p["matrix"]).reshape(4, 4) + np.array(after)).min(axis=1)
                offset += int(before.min())
                after = tuple((before - before.min()).tolist())
            known = [p for p in pieces if p["turns"]]
            joint = list(zip(pieces, pieces[1:], strict=False))
            turns = sum(p["turns"] for p in known) - sum(
                a["last_turn"] == b["first_turn"] for a, b in zip(known, known[1:], strict=False))
            sums = {k: sum(p[k] for p in pieces) for k in ("blank", "duplicate", "truncated", "illegal")}
            sums["illegal"] += sum(not _legal(np.int64(a["last_code"]), np.int64(b["first_code"])) for a, b in joint)
            gaps = known[-1]["last_turn"] - known[0]["first_turn"] + 1 - turns if known else 0
            rows += [*own[:-1], own[-1] | sums | {"starts": [START], "gaps": gaps, "cost": offset + after[START]}]
        yield _batch(rows, batch.schema.field("conv"), AFTER_ARROW)


def _unrolled(batches: Iterator[pa.RecordBatch], costs: RepairCosts) -> Iterator[pa.RecordBatch]:
    repair = Repair(costs)
    for batch in batches:
        edits, states = [], []
        for sym, n, after, starts in zip(*(batch.column(k).to_pylist() for k in ("symbols", "lengths", "after", "starts")), strict=True):
            ways = repair.unroll(list(zip(sym, n, strict=True)), tuple(after), starts)
            edits.append([w[0] for w in ways])
            states.append([w[1] for w in ways])
        yield pa.RecordBatch.from_arrays(
            [batch.column("piece"), pa.array(edits, pa.list_(pa.string())), pa.array(states, pa.list_(pa.int32()))],
            names=["piece", "edits", "states"])


def _audits(batches: Iterator[pa.RecordBatch], costs: RepairCosts) -> Iterator[pa.RecordBatch]:
    repair = Repair(costs)
    for batch in batches:
        audits = []
        for pieces in batch.column("ways").to_pylist():
            state, audit = START, []
            for p in pieces:
                k = state if len(p["edits"]) > 1 else 0
                audit.append(p["edits"][k])
                state = p["states"][k]
            audits.append("".join(audit) + repair.tail(state))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("conv", *COUNTS)), pa.array(audits, pa.string())],
                                         names=["conv", *COUNTS, "audit"])


def _plain(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    return rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
                       F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def audit(rows: DataFrame, costs: RepairCosts = RepairCosts(), conv_col: str = "conv_id", turn_col: str = "turn",
          role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: its key, gaps, blank, duplicate, truncated, illegal, cost (long), audit (string).

    Turns stand in the order of turn, nulls first; of one turn, by role and a
    digest of role and text, so that equal rows are neighbours. The first fault
    of a row counts: blank, duplicate (role and text seen before in the
    conversation), truncated. Edits are Keep, Rerole, Delete, Insert; the audit
    has their initials for the cheapest repair to role initials ``(s?(ua)+)?``,
    the least in ASCII order among equals. A null role or text counts as empty;
    a role with another initial than s, u or a cannot stay. A null key is a
    conversation of its own; an empty table gives no rows; extra columns are
    ignored.
    """
    conv_type = rows.schema[conv_col].dataType
    kind = lambda ddl: StructType([StructField("conv", conv_type), *StructType.fromDDL(ddl)])
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    ranged = _ordered(_plain(rows, conv_col, turn_col, role_col, text_col)).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = stored(ranged.mapInArrow(lambda it: _pieces(it, costs), kind(PIECE)), "pieces")
    parts = [f.name for f in pieces.schema if f.name not in ("conv", "symbols", "lengths")]
    # one small matrix a piece: as many as a conversation has batches of sorted turns
    bones = pieces.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(*parts))).alias("pieces"))
    longs = ", ".join(f"{k} long" for k in COUNTS)
    afters = stored(bones.mapInArrow(lambda it: _afters(it, costs), kind(f"piece long, after array<long>, starts array<int>, {longs}")), "afters")
    ways = pieces.select("piece", "symbols", "lengths").join(afters.select("piece", "after", "starts"), "piece").mapInArrow(
        lambda it: _unrolled(it, costs), "piece long, edits array<string>, states array<int>")
    whole = ways.join(afters.select("conv", "piece", *COUNTS), "piece").groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("piece", "edits", "states"))).alias("ways"), *(F.max(k).alias(k) for k in COUNTS))
    return whole.mapInArrow(lambda it: _audits(it, costs), kind(f"{longs}, audit string")).withColumnRenamed("conv", conv_col)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follow the audit, which comes first in each conversation, over its turns; a batch of turns at a time."""
    conv, letters, state, at = None, iter(()), START, 0
    first = True

    def inserted(rows: list[dict]) -> str:
        nonlocal state, at
        for x in letters:
            if x != "I":
                return x
            state = DUE[state]
            rows.append({"conv": conv, "at": at, "edit": "I", "role": ROLE_OF[state], "text": ""})
            at += 1
        return ""

    for batch in batches:
        rows: list[dict] = []
        for r in batch.to_pylist():
            if r["kind"] == 0:
                if not first:
                    inserted(rows)
                conv, letters, state, at, first = r["conv"], iter(r["text"]), START, 0, False
                continue
            x = inserted(rows)
            if x == "D":
                continue
            if x == "R":
                state = DUE[state]
                role = ROLE_OF[state]
            else:
                role = r["role"]
                state = KEPT[state][INITIALS.index(role[0])]
            rows.append({"conv": conv, "at": at, "edit": x, "role": role, "text": r["text"]})
            at += 1
        yield _batch(rows, batch.schema.field("conv"), TURN_ARROW)
    rows = []
    if not first:
        inserted(rows)
    if rows:
        yield _batch(rows, batch.schema.field("conv"), TURN_ARROW)


TURN_ARROW = [("at", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]


def repaired(rows: DataFrame, audits: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """The turns that ``audit`` leaves: key, at (from 0), edit (K, R or I), role, text.

    Texts travel once. A conversation's turns come in order, within one
    partition; they are streamed, never gathered.
    """
    plain = _plain(rows, conv_col, turn_col, role_col, text_col)
    turns = plain.select("conv", F.lit(1).alias("kind"), "turn", "role", _digest(F.col("role"), F.col("text")).alias("digest"), "text")
    plans = audits.select(F.col(conv_col).alias("conv"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"),
                          F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"))
    order = ["conv", "kind", F.col("turn").asc_nulls_first(), "role", "digest"]
    made = plans.unionByName(turns).repartition("conv").sortWithinPartitions(*order).mapInArrow(
        _applied, StructType([StructField("conv", rows.schema[conv_col].dataType),
                              *StructType.fromDDL("at long, edit string, role string, text string")]))
    return made.withColumnRenamed("conv", conv_col)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import sha256

    now, field = None, None
    for batch in batches:
        done = []
        field = batch.schema.field(0).with_name("conv")
        for conv, turns in groupby(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True), key=lambda r: r[0]):
            if now is None or now[0] != conv:
                if now:
                    done.append({"conv": now[0], "sha": now[1].hexdigest()})
                now = (conv, sha256(), [])
            for _, role, text in turns:
                if now[2]:
                    now[1].update(b"\n")
                else:
                    now[2].append(True)
                now[1].update(f"{role}:{text}".encode())
        yield _batch(done, field, [("sha", pa.string())])
    if now:
        yield _batch([{"conv": now[0], "sha": now[1].hexdigest()}], field, [("sha", pa.string())])


def digests(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines, from ``repaired`` as it comes (no shuffle)."""
    kind = StructType([StructField("conv", turns.schema[conv_col].dataType), *StructType.fromDDL("repaired_sha256 string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _hashed(batches):
            yield b.rename_columns(["conv", "repaired_sha256"])

    return turns.select(conv_col, "role", "text").mapInArrow(run, kind).withColumnRenamed("conv", conv_col)


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """The rows with faults put in, by crc32 of ``conv_id:turn`` modulo 20; nulls count as one space.

    0 drops a row, 1 empties its text, 2 takes out its full stops, exclamation
    and question marks, 3 repeats it, 4 makes it a user's.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col))) % 20
    role = F.when(case == 4, "user").otherwise(space(role_col))
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace(space(text_col), "[.!?]", "")).otherwise(space(text_col))
    return rows.filter(case != 0).select(
        F.col(conv_col), F.col(turn_col).cast("long").alias(turn_col), role.alias(role_col), text.alias(text_col),
        F.explode(F.when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def repair_report(rows: DataFrame, costs: RepairCosts = RepairCosts(), conv_col: str = "conv_id", turn_col: str = "turn",
                  role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``audit`` with the digest of what the repair leaves; the digest of nothing where it leaves none."""
    names = {"conv_col": conv_col, "turn_col": turn_col, "role_col": role_col, "text_col": text_col}
    audits = stored(audit(rows, costs, **names), "audits")
    shas = digests(repaired(rows, audits, **names), conv_col).withColumnRenamed(conv_col, "c")
    return audits.join(shas, F.col(conv_col).eqNullSafe(F.col("c")), "left").select(
        conv_col, *COUNTS, "audit", F.coalesce("repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"))
