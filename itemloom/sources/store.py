"""Versioned Parquet snapshots behind one commit log.

A warehouse is a folder: `_log/<n>.json` holds the whole state after commit n (every table's schema, status
and files), and `<table>/...` the data. A commit writes its files, then the next state aside, and then creates
`_log/<n>.lock`, which fails if that exists: so a commit is all or nothing over any number of tables, readers see one
state, and of two writers one has to start again. The lock names the state that was written aside; whoever finds
a lock without its entry puts the entry into place, so a writer that dies after that point has committed.
If it died before it could write the name, the lock is taken away once it is GRACE seconds old. Everything goes
through the session's file systems.

A table's rows are (pk, sk, item, one pair of columns per index), with key values as text in key order and
the item as a map of canonical text. Its files are a base and small deltas of (seq, gone) rows; a read
takes the last change of each key. `compact` rewrites the base, ordered by key, so that row groups hold
short key ranges.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.errors import CommitConflict, ResourceNotFound
from itemloom.functions.values import Item, checked_item, key_text, order_key, tag_of, text_of, value_of
from itemloom.plans.keys import Index, Key, TableSchema

ATTEMPTS = 3
#: Seconds after which a lock that names nothing is that of a writer that died.
GRACE = 60
#: Deltas after which a commit rewrites the base.
COMPACT_AFTER = 16


@dataclass
class TableState:
    schema: TableSchema
    base: list[str] = field(default_factory=list)
    deltas: list[str] = field(default_factory=list)
    status: str = "ACTIVE"
    info: dict = field(default_factory=dict)

    def as_json(self) -> dict:
        return {"schema": asdict(self.schema), "base": self.base, "deltas": self.deltas, "status": self.status, "info": self.info}

    @staticmethod
    def of_json(x: dict) -> "TableState":
        s = x["schema"]
        key = lambda k: Key(**k) if k else None
        indexes = {n: Index(i["name"], key(i["pk"]), key(i["sk"]), i["local"], i["serveable"], i["reason"], i.get("projection") or {}) for n, i in s["indexes"].items()}
        return TableState(TableSchema(s["name"], key(s["pk"]), key(s["sk"]), indexes), x["base"], x["deltas"], x["status"], x["info"])


@dataclass
class State:
    version: int
    tables: dict[str, TableState]

    def table(self, name: str) -> TableState:
        if name not in self.tables:
            raise ResourceNotFound(f"there is no table {name}")
        return self.tables[name]


def index_columns(schema: TableSchema) -> list[tuple[str, Key]]:
    """Derived columns: two per index, named after it."""
    return [(f"ix_{i.name}_{part}", k) for i in schema.indexes.values() for part, k in (("pk", i.pk), ("sk", i.sk)) if k]


def row_ddl(schema: TableSchema) -> str:
    return ", ".join(["pk string", "sk string", "item map<string,string>", *[f"`{c}` string" for c, _ in index_columns(schema)]])


def keys_of(schema: TableSchema, item: Item) -> tuple[str, str]:
    """Partition and sort key as ordered text; the sort key of a hash-only table is empty."""
    from itemloom.errors import ValidationError

    out = []
    for k in schema.keys():
        if k.name not in item:
            raise ValidationError(f"the key attribute {k.name} is missing")
        out.append(key_text(item[k.name], k.kind))
    return out[0], out[1] if len(out) > 1 else ""


def row_of(schema: TableSchema, item: Item) -> tuple:
    """A stored row. An index attribute that is missing or of another type leaves the item out of the index."""
    item = checked_item(item)
    derived = [key_text(item[k.name], k.kind) if k.name in item and tag_of(item[k.name]) == k.kind and item[k.name][k.kind] != "" else None for _, k in index_columns(schema)]
    return (*keys_of(schema, item), {n: text_of(v) for n, v in item.items()}, *derived)


def item_of(stored: dict[str, str]) -> Item:
    return {k: value_of(v) for k, v in stored.items()}


class Warehouse:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/_log"))

    # the log

    def _entry(self, version: int):
        return self._path(f"{self.path}/_log/{version:012d}.json")

    def _text(self, path) -> str:
        stream = self._fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, path, body: str) -> None:
        out = self._fs.create(path, False)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()

    def state(self, version: int | None = None) -> State:
        """The current state, or an earlier one."""
        if version is None:
            found: dict[str, list[int]] = {"json": [], "lock": []}
            for s in self._fs.listStatus(self._path(f"{self.path}/_log")):
                number, _, kind = s.getPath().getName().partition(".")
                if number.isdigit() and kind in found:
                    found[kind].append(int(number))
            version = max(found["json"], default=0)
            if version + 1 in found["lock"] and self._settled(version + 1):
                return self.state()
        if version == 0:
            return State(0, {})
        return State(version, {n: TableState.of_json(t) for n, t in json.loads(self._text(self._entry(version))).items()})

    def _lock(self, version: int):
        return self._path(f"{self.path}/_log/{version:012d}.lock")

    def _settled(self, version: int) -> bool:
        """Put the entry into place that the lock names; a lock that names none goes when it is old. Whether the log has changed."""
        lock = self._lock(version)
        try:
            name, age = self._text(lock), time.time() - self._fs.getFileStatus(lock).getModificationTime() / 1000
        except Exception:  # it is gone
            return True
        if len(name) == 33:
            aside = self._path(f"{self.path}/_log/{name}")
            if not self._fs.exists(self._entry(version)) and self._fs.exists(aside):
                self._fs.rename(aside, self._entry(version))
            return self._fs.exists(self._entry(version))
        return age > GRACE and self._fs.rename(lock, self._path(f"{self.path}/_log/.stale-{uuid.uuid4().hex}"))

    def commit(self, state: State, tables: dict[str, TableState]) -> State:
        """The state that follows `state`; CommitConflict if another commit has followed it already."""
        number, name = state.version + 1, f".{uuid.uuid4().hex}"
        aside, lock = self._path(f"{self.path}/_log/{name}"), self._lock(number)
        self._put(aside, json.dumps({n: t.as_json() for n, t in tables.items()}))
        try:
            if self._fs.exists(self._entry(number)):
                raise CommitConflict("another commit came first")
            self._put(lock, name)  # the exclusive step
        except Exception as e:
            self._fs.delete(aside, False)
            raise CommitConflict("another commit came first") from e
        if not self._settled(number) or self._text(lock) != name:  # the lock was taken away while this writer stood still
            raise CommitConflict("another commit came first")
        return State(number, tables)

    def change(self, apply: Callable[[State], dict[str, TableState]]) -> State:
        """Commit what apply(state) gives; after a lost race it is asked again, on the new state."""
        for attempt in range(ATTEMPTS):
            state = self.state()
            try:
                return self.commit(state, apply(state))
            except CommitConflict:
                if attempt == ATTEMPTS - 1:
                    raise
                time.sleep(min(1.0, 0.05 * 2**attempt) * random.uniform(0.75, 1.25))
        raise CommitConflict("another commit came first")

    # data

    def read(self, table: TableState) -> DataFrame:
        """The table's rows: pk, sk, item, and the index columns."""
        ddl = row_ddl(table.schema)
        columns = [f.split(" ")[0].strip("`") for f in ddl.split(", ")]
        base = self.spark.read.schema(ddl).parquet(*table.base) if table.base else self.spark.createDataFrame([], ddl)
        if not table.deltas:
            return base
        changes = self.spark.read.schema(f"{ddl}, seq long, gone boolean").parquet(*table.deltas)
        last = changes.groupBy("pk", "sk").agg(F.max_by(F.struct(*[f"`{c}`" for c in columns], "gone"), "seq").alias("r")).select("r.*")
        kept = base.join(last.select("pk", "sk"), ["pk", "sk"], "left_anti")
        return kept.select(*[f"`{c}`" for c in columns]).unionByName(last.where("NOT gone").drop("gone"))

    def fault(self, table: TableState) -> tuple[str, dict[str, str]]:
        """What is wrong with a table's files: missing, or without columns of the table's own (empty if nothing is); and of which indexes columns are missing."""
        own, indexes = "", {}
        for paths, more in ((table.base, []), (table.deltas, ["seq", "gone"])):
            for p in paths:
                if not self._fs.exists(self._path(p)):
                    return f"{p} is missing", indexes
                stored = set(self.spark.read.parquet(p).columns)
                if lost := [c for c in ("pk", "sk", "item", *more) if c not in stored]:
                    own = f"{p} lacks {', '.join(lost)}"
                for i in table.schema.indexes.values():
                    if lost := [c for c, _ in index_columns(TableSchema("", table.schema.pk, None, {i.name: i})) if c not in stored]:
                        indexes[i.name] = f"{p} lacks {', '.join(lost)}"
        return own, indexes

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete the data that none of the last `keep` states has, unless a commit began to write it within GRACE seconds; what was deleted."""
        now = self.state()
        states = [now, *(self.state(v) for v in range(max(1, now.version - keep + 1), now.version))]
        used = {p for s in states for t in s.tables.values() for p in (*t.base, *t.deltas)}
        gone = []
        for folder in self._fs.listStatus(self._path(self.path)):
            if folder.getPath().getName() == "_log" or not folder.isDirectory():
                continue
            for data in self._fs.listStatus(folder.getPath()):
                path = f"{self.path}/{folder.getPath().getName()}/{data.getPath().getName()}"
                if path not in used and time.time() - data.getModificationTime() / 1000 > GRACE:
                    self._fs.delete(data.getPath(), True)
                    gone.append(path)
        return gone

    def write_base(self, df: DataFrame, name: str) -> list[str]:
        """df as a new base, ordered by key."""
        at = f"{self.path}/{name}/{uuid.uuid4().hex}"
        df.repartitionByRange("pk", "sk").sortWithinPartitions("pk", "sk").write.parquet(at)
        return [at]

    def write_delta(self, table: TableState, seq: int, puts: list[Item], deletes: list[tuple[str, str]]) -> list[str]:
        """A few changes as one file."""
        empty = (None,) * len(index_columns(table.schema))
        rows = [(*row_of(table.schema, i), seq, False) for i in puts] + [(*k, None, *empty, seq, True) for k in deletes]
        at = f"{self.path}/{table.schema.name}/{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, f"{row_ddl(table.schema)}, seq long, gone boolean").coalesce(1).write.parquet(at)
        return [at]

    def changed(self, table: TableState, seq: int, puts: list[Item], deletes: list[tuple[str, str]]) -> TableState:
        """The table after a few changes, compacted if there were many before."""
        deltas = table.deltas + self.write_delta(table, seq, puts, deletes)
        after = TableState(table.schema, table.base, deltas, table.status, table.info)
        return self.compacted(after) if len(deltas) > COMPACT_AFTER else after

    def compacted(self, table: TableState) -> TableState:
        return TableState(table.schema, self.write_base(self.read(table), table.schema.name), [], table.status, table.info)

    def load(self, name: str, items: DataFrame) -> State:
        """Replace a table's rows by those of a DataFrame with one column `item` (map of canonical text)."""
        schema = self.state().table(name).schema
        rows = derived(items, schema)
        base = self.write_base(rows, name)
        return self.change(lambda s: {**s.tables, name: TableState(schema, base, [], "ACTIVE", s.table(name).info)})


def derived(items: DataFrame, schema: TableSchema, keep: list[str] | None = None) -> DataFrame:
    """Stored rows of a column `item`, with the columns `keep` beside them.

    Text and binary keys are taken from the item's text by built-in functions; numbers, which have 38 digits, are
    brought to ordered text in Arrow batches of their digits alone.
    """
    import pandas as pd

    from itemloom.plans.binding import ItemBinding

    def run(x):
        return pd.Series([order_key(v) if isinstance(v, str) else None for v in x], dtype=object)

    run.__annotations__ = {"x": pd.Series, "return": pd.Series}
    numbers = F.pandas_udf(run, "string")
    b = ItemBinding("item")

    def ordered(key: Key):
        text = b.body(key.name, key.kind)
        if key.kind == "N":
            return numbers(text)
        text = F.when(text != "", text)
        return F.lower(F.hex(F.unbase64(text))) if key.kind == "B" else text

    need = schema.keys()
    columns = [ordered(schema.pk).alias("pk"), (ordered(schema.sk) if schema.sk else F.lit("")).alias("sk"), "item", *[ordered(k).alias(c) for c, k in index_columns(schema)]]
    out = items.select(*columns, *[F.col(f"`{c}`") for c in keep or []])
    wrong = F.raise_error(F.lit(f"an item lacks a key attribute ({', '.join(k.name for k in need)}) of the right type"))
    return out.withColumn("pk", F.coalesce("pk", wrong)).withColumn("sk", F.coalesce("sk", wrong))
