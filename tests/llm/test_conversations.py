"""Conversation repair against an exhaustive search over edits."""

import heapq
import random
import re
import zlib

import pytest
from brute import sha

from tidewatch.llm import queries, turn_repair
from tidewatch.llm.turn_repair import RepairCosts

SCHEMA = "conv_id long, turn long, role string, text string, conv string, piece long, digest string, n long, kind int, c string"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def in_order(rows):
    """By turn, nulls first; within a turn as the library says: by role, then digest."""
    import hashlib

    key = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), key(r)))


def brute_repair(rows, costs):
    """Cheapest, then least audit, by uniform-cost search over (turns done, output so far as a state)."""
    due = {"": "u", "s": "u", "u": "a", "a": "u"}
    faults, seen = [], set()
    for _, _, role, text in rows:
        body = re.sub("[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, letters, k, last, kept = heapq.heappop(heap)
        if (k, last) in done:
            continue
        done.add((k, last))
        if k == len(rows) and last in ("", "a"):
            break
        name = {"u": "user", "a": "assistant"}[due[last]]
        heapq.heappush(heap, (cost + costs.insert, letters + "I", k, due[last], (*kept, f"{name}:")))
        if k == len(rows):
            continue
        _, _, role, text = rows[k]
        heapq.heappush(heap, (cost + costs.delete, letters + "D", k + 1, last, kept))
        if faults[k] not in ("blank", "duplicate"):
            more = costs.truncated if faults[k] else 0
            if role[:1] == due[last] or (last == "" and role[:1] == "s"):
                heapq.heappush(heap, (cost + more, letters + "K", k + 1, role[0], (*kept, f"{role}:{text}")))
            heapq.heappush(heap, (cost + costs.rerole + more, letters + "R", k + 1, due[last], (*kept, f"{name}:{text}")))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    bad = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), bad, cost, letters, sha("\n".join(kept)))


def by_conv(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return {k: in_order(v) for k, v in groups.items()}


def plain(rows):
    """Nulls as the operator takes them."""
    return [(c, t, r or "", x or "") for c, t, r, x in rows]


def awkward():
    rng = random.Random(4)
    roles = ["user", "assistant", "system", "user", "assistant", None, "tool", "", "User", "ugly"]
    texts = ["Yes.", "no", "", " \t", None, "Why?", "ok!", "a. b", "x" * 20000 + ".", "é…", "line\ntwo."]
    rows = []
    for conv in [*range(120), None, -3]:
        for t in range(rng.randint(1, 9)):
            turn = None if rng.random() < 0.05 else t + (t > 4) * 2
            rows.append((conv, turn, rng.choice(roles[:rng.choice([2, 5, 10])]), rng.choice(texts)))
    rows += [(7, 1, "user", "Same."), (7, 1, "user", "Same."), (7, 1, "user", "Same."), (8, None, None, None), (9, 10**12, "user", "Far.")]
    rows += [(500, None, "user", "Hm."), (501, 3, "system", "Only."), (502, 1, None, None)]
    return rows


def long_one():
    """One conversation that holds most rows, with long runs."""
    rng = random.Random(9)
    rows, turn = [], 0
    for _ in range(40):
        role, n = rng.choice(["user", "assistant", "system"]), rng.choice([1, 1, 2, 3, 17])
        for _ in range(n):
            rows.append((1000, turn, role, rng.choice(["one.", "two", "", f"n{turn}.", f"n{turn}!", f"n{turn}"])))
            turn += rng.choice([1, 1, 2])
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, "b", 2, 3, "d") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("batch", "costs"), [("10000", RepairCosts()), ("3", RepairCosts()), ("2", RepairCosts(3, 9, 1, 2)), ("5", RepairCosts(7, 6, 2, 1))])
def test_repair_equals_search(spark, batch, costs):
    rows = awkward() + long_one()
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r[0]: tuple(r[1:]) for r in turn_repair.repair_report(frame(spark, rows), costs).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == {k: brute_repair(v, costs) for k, v in by_conv(plain(rows)).items()}
    if costs.insert < costs.delete:
        assert any("I" in v[6] for v in got.values())


def test_long_runs_use_powers():
    repair = turn_repair.Repair(RepairCosts())
    for x in (turn_repair.symbol(1, 0), turn_repair.symbol(2, 1), turn_repair.symbol(3, 2)):
        one = repair.matrix(((x, 1),))
        step = one
        for n in range(2, 70):
            step = turn_repair._times(step, one)
            assert (repair.matrix(((x, n),)) == step).all()
        assert len(repair.powers[x]) == 7


def test_repaired_turns(spark):
    rows = awkward()
    df = frame(spark, rows)
    audits = turn_repair.audit(df)
    turns = turn_repair.repaired(df, audits).collect()
    left = {}
    for r in turns:
        assert r["at"] == len(left.setdefault(r["conv_id"], []))
        left[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    want = {k: brute_repair(v, RepairCosts())[-1] for k, v in by_conv(plain(rows)).items()}
    assert {k: sha("\n".join(left.get(k, []))) for k in want} == want
    for lines in left.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))


def test_empty_table(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert turn_repair.repair_report(nothing).collect() == []
    assert turn_repair.damaged(nothing).collect() == []


def test_query_equals_search(spark, tmp_path):
    gone = [c for c in range(2000, 2100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    rows = awkward() + long_one() + [(c, 0, "user", "Dropped.") for c in gone]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.BUILDERS["op11_turn_repair"](spark, str(tmp_path))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = by_conv(brute_damage(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", sha(""))
    want = {k: brute_repair(found[k], RepairCosts()) if k in found else nothing for k in {r[0] for r in rows}}
    got = {r[0]: tuple(r[1:]) for r in out.collect()}
    assert {k: v for k, v in got.items() if v != want[k]} == {k: v for k, v in want.items() if got[k] != v}
    assert len(got) == len(want) and gone and all(got[c] == nothing for c in gone)
