"""The frame API: expressions in, lazy DataFrames out, over any DataFrame whose columns are attributes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.errors import ValidationError
from itemloom.functions.values import Item, Value, checked, tag_of
from itemloom.plans import compile as C
from itemloom.plans import expressions as X
from itemloom.plans.binding import TypedBinding
from itemloom.plans.keys import Index, Key, TableSchema, bounds

#: Key lists up to this many rows are broadcast; longer ones are joined by shuffle.
BROADCAST_KEYS = 100_000
#: Keys up to this many become literals of the scan.
MOST_LITERALS = 200


@dataclass
class Names:
    """Expression attribute names and values of a call."""

    names: dict[str, str] = field(default_factory=dict)
    values: dict[str, Value] = field(default_factory=dict)


def values(**given: object) -> dict[str, Value]:
    """Plain Python values as attribute values: str S, numbers N, bool BOOL, bytes B, list L, None NULL."""
    import base64

    def one(v: object) -> Value:
        if isinstance(v, dict):
            return checked(v)
        if isinstance(v, bool):
            return {"BOOL": v}
        if isinstance(v, (int, float)):
            return {"N": repr(v)}
        if isinstance(v, bytes):
            return {"B": base64.b64encode(v).decode()}
        if isinstance(v, list):
            return {"L": [one(x) for x in v]}
        return {"NULL": True} if v is None else {"S": str(v)}

    return {k: one(v) for k, v in given.items()}


class Table:
    def __init__(self, df: DataFrame, schema: TableSchema, sets: dict[str, str] | None = None):
        self.df, self.schema, self.sets = df, schema, sets or {}
        self.binding = TypedBinding(df, self.sets)

    def _with(self, df: DataFrame) -> "Table":
        return Table(df, self.schema, self.sets)

    # reads

    def _source(self, index: Index | None) -> DataFrame:
        """An index holds only the items that have its keys."""
        df = self.df
        for k in self.schema.read_keys(index) if index else []:
            df = df.where(F.col(k.name).isNotNull())
        return df

    def _literal(self, key: Key, v: Value) -> Column:
        if tag_of(v) != key.kind:
            raise ValidationError(f"{key.name} is of type {key.kind}")
        found = self.binding.literal(v, self.binding.types[key.name])
        if found is None:
            raise ValidationError(f"{v} can't be a value of {key.name}")
        return found

    def get(self, key: Item) -> DataFrame:
        df = self.df
        self._key_names(key)
        for k in self.schema.keys():
            df = df.where(F.col(k.name) == self._literal(k, key[k.name]))
        return df

    def _key_names(self, key: Item) -> None:
        if set(key) != {k.name for k in self.schema.keys()}:
            raise ValidationError("the key must have exactly the key attributes")

    def query(self, key_condition: str, filter: str | None = None, index: str | None = None, limit: int | None = None, start: Item | None = None, forward: bool = True, projection: str | None = None, names: dict | None = None, values: dict | None = None) -> DataFrame:
        """Rows of one partition in key order: those after `start`, at most `limit` of them, of these the ones that pass the filter."""
        at = self.schema.index(index)
        pk, sk = (at.pk, at.sk) if at else (self.schema.pk, self.schema.sk)
        found = bounds(X.condition(key_condition, names, values), pk, sk)
        b = self.binding
        df = self._source(at).where(b.equal(pk.name, found.pk))
        if found.sk:
            op, terms = found.sk
            if op == "BETWEEN":
                df = df.where(b.ordered(sk.name, ">=", terms[0]) & b.ordered(sk.name, "<=", terms[1]))
            elif op == "begins_with":
                df = df.where(b.begins_with(sk.name, terms[0]))
            else:
                df = df.where(b.equal(sk.name, terms[0]) if op == "=" else b.ordered(sk.name, op, terms[0]))
        order = [k for k in self.schema.read_keys(at) if k.name != pk.name]
        return self._page(df, order, filter, limit, start, forward, projection, names, values)

    def scan(self, filter: str | None = None, index: str | None = None, limit: int | None = None, start: Item | None = None, projection: str | None = None, segment: int | None = None, segments: int | None = None, names: dict | None = None, values: dict | None = None) -> DataFrame:
        """All rows; in key order only where a limit or a start asks for it. segment of segments: a share of the partitions."""
        at = self.schema.index(index)
        df = self._source(at)
        if segments is not None:
            df = df.where(F.pmod(F.xxhash64(self.schema.pk.name), F.lit(segments)) == segment)
        return self._page(df, self.schema.read_keys(at), filter, limit, start, True, projection, names, values)

    def _page(self, df, order, filter, limit, start, forward, projection, names, values) -> DataFrame:
        if start is not None:
            after = None
            for i, k in enumerate(order):  # (a > x) OR (a = x AND b > y): unlike a comparison of structs, it reaches the scan
                term = F.col(k.name) > self._literal(k, start[k.name]) if forward else F.col(k.name) < self._literal(k, start[k.name])
                for j in order[:i]:
                    term = (F.col(j.name) == self._literal(j, start[j.name])) & term
                after = term if after is None else after | term
            df = df.where(after)
        if limit is not None:
            if limit < 1:
                raise ValidationError("Limit is at least 1")
            df = df.orderBy(*[F.col(k.name).asc() if forward else F.col(k.name).desc() for k in order]).limit(limit)
        if filter:
            df = df.where(C.condition(X.condition(filter, names, values), self.binding))
        return C.project(df, X.projection(projection, names), self.binding)

    def counted(self, page: DataFrame, filter: str | None = None, names: dict | None = None, values: dict | None = None) -> DataFrame:
        """One row (count, scanned_count) of a page that was read without its filter."""
        passes = C.truth(X.condition(filter, names, values), self.binding) if filter else F.lit(True)
        return page.agg(F.count(F.when(passes, 1)).alias("count"), F.count("*").alias("scanned_count"))

    def _keys_frame(self, keys: list[Item]) -> DataFrame:
        spark = self.df.sparkSession
        rows = [tuple(str(i) if j < 0 else self._text(k, key[k.name]) for j, k in enumerate(self.schema.keys())) for i, key in enumerate(keys)]
        names = [f"__k{i}" for i in range(len(self.schema.keys()))]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ", ".join(["__ord int", *[f"{n} string" for n in names]]))
        return df.select("__ord", *[(F.unbase64(n) if k.kind == "B" else F.col(n).cast(self.binding.types[k.name])).alias(n) for n, k in zip(names, self.schema.keys())])

    @staticmethod
    def _text(key: Key, v: Value) -> str:
        if tag_of(v) != key.kind:
            raise ValidationError(f"{key.name} is of type {key.kind}")
        return v[key.kind]

    def _matched(self, keys: DataFrame) -> list[Column]:
        return [F.col(k.name) == F.col(f"__k{i}") for i, k in enumerate(self.schema.keys())]

    def batch_get(self, keys: list[Item] | DataFrame) -> DataFrame:
        """The rows with one of the keys; misses are silent. Keys in a DataFrame are columns named after the key attributes; they may be any number, and are joined as Spark sees fit."""
        if isinstance(keys, DataFrame):
            frame = keys.select(*[F.col(f"`{k.name}`").alias(f"__k{i}") for i, k in enumerate(self.schema.keys())])
            return self.df.join(frame, self._matched(frame), "left_semi")
        frame = self._keys_frame(keys)
        return self.df.join(F.broadcast(frame) if len(keys) <= BROADCAST_KEYS else frame, self._matched(frame), "left_semi")

    def transact_get(self, keys: list[Item]) -> DataFrame:
        """One row per key, with its position in `ord`; the attributes are NULL where nothing was found."""
        frame = self._keys_frame(keys)
        found = self.df
        if len(keys) <= BROADCAST_KEYS:  # the partition keys reach the scan, so few rows meet the keys
            found = self.df.where(self.binding.column(self.schema.pk.name).isin([self._literal(self.schema.pk, k[self.schema.pk.name]) for k in keys])) if len(keys) <= MOST_LITERALS else self.batch_get(keys)
        return frame.join(found, self._matched(frame), "left").select(F.col("__ord").alias("ord"), *[F.col(f"`{c}`") for c in self.df.columns])

    # writes: new states of the table

    def update(self, expression: str, where: str | None = None, names: dict | None = None, values: dict | None = None) -> "Table":
        """Every row that satisfies the condition, updated."""
        u = X.update(expression, names, values)
        if bad := {k.name for k in self.schema.keys()} & set(u.names()):
            raise ValidationError(f"key attributes can't be updated: {', '.join(sorted(bad))}")
        hit = C.truth(X.condition(where, names, values), self.binding) if where else None
        return self._with(C.typed_update(self.df, u, hit, self.sets))

    def put(self, rows: DataFrame, small: bool = False) -> "Table":
        """Rows replace those with their key, or are added. small: the caller has checked that they can be broadcast."""
        keys = [k.name for k in self.schema.keys()]
        side = rows.select(*keys)
        kept = self.df.join(F.broadcast(side) if small else side, keys, "left_anti")
        return self._with(kept.select(*self.df.columns).unionByName(rows.select(*self.df.columns)))

    def delete(self, keys: list[Item]) -> "Table":
        frame = self._keys_frame(keys)
        return self._with(self.df.join(F.broadcast(frame) if len(keys) <= BROADCAST_KEYS else frame, self._matched(frame), "left_anti"))

    def write(self, puts: DataFrame, deletes: list[Item], small: bool = False) -> "Table":
        """A batch of puts and deletes of different keys, as one overlay."""
        keys = [k.name for k in self.schema.keys()]
        frame = self._keys_frame(deletes)
        gone = frame.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)]).unionByName(puts.select(*keys))
        kept = self.df.join(F.broadcast(gone) if small else gone, keys, "left_anti")
        return self._with(kept.select(*self.df.columns).unionByName(puts.select(*self.df.columns)))

    def latest(self, changes: DataFrame, order: str) -> "Table":
        """Bulk load: the last change of each key, by `order`, then as put."""
        keys = [k.name for k in self.schema.keys()]
        last = changes.groupBy(*keys).agg(F.max_by(F.struct(*changes.columns), F.col(order)).alias("r")).select("r.*")
        return self.put(last)

    # indexes

    def clustered(self, index: str | None = None, partitions: int | None = None) -> DataFrame:
        """A copy ordered by the index's keys, for storing: row groups then hold short key ranges."""
        at = self.schema.index(index)
        order = [k.name for k in self.schema.read_keys(at)]
        return self._source(at).repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)

    def drift(self, stored: DataFrame, derived: dict[str, Column]) -> DataFrame:
        """One row (mismatches, checked): stored derived columns against the same ones recomputed, over all rows."""
        wrong = None
        for name, c in derived.items():
            w = ~F.col(name).eqNullSafe(c)
            wrong = w if wrong is None else wrong | w
        return stored.agg(F.count(F.when(wrong, 1)).alias("mismatches"), F.count("*").alias("checked"))
