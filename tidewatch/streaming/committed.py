"""Tables that grow batch by batch, seen by readers in whole batches only.

Every table of a folder is a set of Parquet folders. A batch writes into
folders of its own and then one small commit record that names them; readers
take what the records name, so they see a batch in all its tables or in none.
A batch that fails before its record leaves nothing behind but unnamed
folders, and one that comes again after its record is skipped.

Keyed state is kept in hash buckets. A batch rewrites only buckets it touches:
the record names their new folders, the others stay as they are. Rows of a
reset entity are taken out by a tombstone: a record with its key, which hides
what older records brought in. ``compact`` folds small folders and tombstones
into new ones, ``vacuum`` removes folders that no record names any more.

One writer at a time per folder, as a streaming query is one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "project_id"


def bucket(buckets: int, key: str = KEY) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


@dataclass
class View:
    """What the records up to some number say."""

    number: int = -1
    batches: dict[str, int] = field(default_factory=dict)  # writer -> its last batch
    rows: dict[str, list[tuple[int, str]]] = field(default_factory=dict)  # table -> (record, folder)
    state: dict[str, dict[int, tuple[int, str]]] = field(default_factory=dict)  # table -> bucket -> (record, folder)
    tombstones: list[tuple[int, list[str]]] = field(default_factory=list)  # (record, keys)
    notes: dict[str, object] = field(default_factory=dict)
    buckets: int | None = None


class Committed:
    """The tables under ``root``. ``buckets`` is fixed by the first record."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 32) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop
        self._path = hadoop.fs.Path
        self._fs = hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.buckets = self.view().buckets or buckets

    # ---- records ---------------------------------------------------------

    def _records(self) -> list[int]:
        at = self._path(f"{self.root}/_commits")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _read(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/_commits/{number:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def view(self) -> View:
        """Fold the records from the last compaction on."""
        numbers = self._records()
        tail: list[tuple[int, dict]] = []
        for n in reversed(numbers):
            tail.append((n, self._read(n)))
            if tail[-1][1]["kind"] == "compact":
                break
        v = View()
        for n, r in reversed(tail):
            v.number, v.buckets = n, r["buckets"]
            v.batches |= r.get("batches", {})
            for table, folder in r.get("rows", {}).items():
                v.rows.setdefault(table, []).append((n, folder))
            for table, folders in r.get("state", {}).items():
                v.state.setdefault(table, {}).update({int(b): (n, f) for b, f in folders.items()})
            if r.get("reset"):
                v.tombstones.append((n, r["reset"]))
            v.notes |= r.get("notes", {})
        return v

    def _commit(self, record: dict) -> None:
        """Write a record under a passing name, then give it its number: readers never see half of one."""
        number = (self._records() or [-1])[-1] + 1
        final = self._path(f"{self.root}/_commits/{number:012d}.json")
        passing = self._path(f"{self.root}/_commits/.{uuid.uuid4().hex}")
        out = self._fs.create(passing, True)
        out.write(bytearray(json.dumps({"buckets": self.buckets, **record}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(passing, final):
            raise RuntimeError(f"another writer has committed record {number} of {self.root}")

    # ---- writing ---------------------------------------------------------

    def batch(self, number: int, writer: str = "stream") -> Batch | None:
        """A batch to fill, or None if this writer has committed it before."""
        seen = self.view()
        return None if seen.batches.get(writer, -1) >= number else Batch(self, writer, number, seen)

    def reset(self, keys: Sequence[str]) -> None:
        """Hide these entities' rows, as they are now, from all readers of all tables. Later rows count again."""
        self._commit({"kind": "reset", "reset": [str(k) for k in keys]})

    def compact(self) -> None:
        """One folder per table and no tombstones; buckets are rewritten only where a tombstone may apply."""
        v = self.view()
        rows = {t: self._stored(self._rows(v, t), t) for t in v.rows}
        state: dict[str, dict[str, str]] = {}
        for t, folders in v.state.items():
            last = v.tombstones[-1][0] if v.tombstones else -1
            old = {b for b, (n, _) in folders.items() if n < last}
            kept = {str(b): f for b, (_, f) in folders.items() if b not in old}
            rest = self._state(v, t, sorted(old))
            state[t] = kept | (self._put_state(rest, t, sorted(old)) if rest else {})
        self._commit({"kind": "compact", "batches": v.batches, "rows": rows, "state": state, "notes": v.notes})

    def vacuum(self) -> list[str]:
        """Delete folders that no record since the last compaction names; returns them. Not while a reader or writer is at work."""
        v = self.view()
        named = {f for parts in v.rows.values() for _, f in parts} | {f for m in v.state.values() for _, f in m.values()}
        gone = []
        for t in self._fs.listStatus(self._path(self.root)):
            table = t.getPath().getName()
            if table == "_commits":
                continue
            for s in self._fs.listStatus(t.getPath()):
                name = f"{table}/{s.getPath().getName()}"
                if name not in named:
                    self._fs.delete(s.getPath(), True)
                    gone.append(name)
        return gone

    def _stored(self, df: DataFrame, table: str) -> str:
        folder = f"{table}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return folder

    def _put_state(self, df: DataFrame, table: str, touched: Sequence[int]) -> dict[str, str]:
        """All touched buckets in one folder, a subfolder each; a bucket that became empty has none."""
        folder = f"{table}/{uuid.uuid4().hex}"
        df.withColumn("_bucket", bucket(self.buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        return dict.fromkeys(map(str, touched), folder)

    # ---- reading ---------------------------------------------------------

    def read(self, table: str) -> DataFrame:
        """All committed rows of a table."""
        return self._rows(self.view(), table)

    def state(self, table: str, schema: str) -> DataFrame:
        """The state of all entities."""
        v = self.view()
        return self._state(v, table, sorted(v.state.get(table, {})), schema)

    def _open(self, folders: list[tuple[int, str]], v: View, schema: str | None = None) -> DataFrame:
        """The folders' rows less the entities whose tombstones are younger than the folder's record.

        Folders to which the same tombstones apply are read together.
        """
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        groups: dict[int, list[str]] = {}
        for n, f in folders:
            groups.setdefault(sum(m > n for m, _ in v.tombstones), []).append(f"{self.root}/{f}")
        parts = []
        for younger, paths in sorted(groups.items()):
            df = reader.parquet(*paths)
            if younger:
                keys = sorted({k for _, ks in v.tombstones[-younger:] for k in ks})
                gone = self.spark.createDataFrame([(k,) for k in keys], f"{KEY} string")
                df = df.join(gone, KEY, "left_anti").select(*df.columns)
            parts.append(df)
        return reduce(DataFrame.unionByName, parts)

    def _rows(self, v: View, table: str) -> DataFrame:
        if table not in v.rows:
            raise ValueError(f"no batch has committed rows of {table!r} under {self.root}")
        return self._open(v.rows[table], v)

    def _state(self, v: View, table: str, touched: Sequence[int], schema: str | None = None) -> DataFrame | None:
        """State rows of some buckets; what other buckets hold is not read. None if there are no files and no schema."""
        known = v.state.get(table, {})
        wanted = [(known[b][0], f"{known[b][1]}/_bucket={b}") for b in touched if b in known]
        wanted = [(n, f) for n, f in wanted if self._fs.exists(self._path(f"{self.root}/{f}"))]
        if not wanted:
            return self.spark.createDataFrame([], schema) if schema else None
        return self._open(wanted, v, schema)


class Batch:
    """What one batch writes; nothing counts before ``commit``."""

    def __init__(self, tables: Committed, writer: str, number: int, seen: View) -> None:
        self.tables, self.writer, self.number, self.seen = tables, writer, number, seen
        self._rows: dict[str, str] = {}
        self._state: dict[str, dict[str, str]] = {}
        self.notes: dict[str, object] = dict(seen.notes)

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of these rows: at most as many as there are."""
        return sorted(r[0] for r in rows.select(bucket(self.tables.buckets)).distinct().collect())

    def state(self, table: str, touched: Sequence[int], schema: str) -> DataFrame:
        """State of the entities in these buckets, as the records before this batch have it."""
        return self.tables._state(self.seen, table, touched, schema)

    def put(self, df: DataFrame, table: str) -> DataFrame:
        """Write rows of a table; the stored rows."""
        self._rows[table] = self.tables._stored(df, table)
        return df.sparkSession.read.schema(df.schema).parquet(f"{self.tables.root}/{self._rows[table]}")

    def keep(self, df: DataFrame, table: str) -> DataFrame:
        """Write rows that only this batch needs; no record names them."""
        folder = self.tables._stored(df, f"passing-{table}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{self.tables.root}/{folder}")

    def put_state(self, df: DataFrame, table: str, touched: Sequence[int]) -> None:
        """The whole new content of the touched buckets."""
        if touched:
            self._state[table] = self.tables._put_state(df, table, touched)

    def commit(self) -> None:
        self.tables._commit({"kind": "batch", "batches": {self.writer: self.number}, "rows": self._rows, "state": self._state, "notes": self.notes})
