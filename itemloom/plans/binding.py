"""How a condition's attributes are found in a DataFrame.

TypedBinding: each column is an attribute (string, timestamp, date: S; numbers: N; binary: B; boolean:
BOOL; array: L, or a set where declared; map and struct: M), and NULL means absent. Comparisons are on the
bare column with a literal of its own type, so they reach the Parquet scan.

ItemBinding: a column of type map<string,string> holds canonical text of each attribute. A value's type is how its
text begins; JSON is parsed only where a string has escapes, and for lists and sets. Numbers are compared as doubles,
and where these are equal by 38 digits (magnitudes up to 1e308).
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemloom.errors import ValidationError
from itemloom.functions.values import SETS, Value, number, tag_of, text_of


def _kind(t: T.DataType) -> str:
    if isinstance(t, (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "S"
    if isinstance(t, T.NumericType):
        return "N"
    if isinstance(t, T.BinaryType):
        return "B"
    if isinstance(t, T.BooleanType):
        return "BOOL"
    if isinstance(t, T.ArrayType):
        return "L"
    return "M"


class TypedBinding:
    def __init__(self, df: DataFrame, sets: dict[str, str] | None = None):
        """sets: array columns that are SS, NS or BS."""
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.kinds = {n: (sets or {}).get(n) or _kind(t) for n, t in self.types.items()}

    def column(self, name: str) -> Column | None:
        """The attribute, or None if no row can have it."""
        return F.col(f"`{name}`") if name in self.types else None

    def exists(self, name: str) -> Column:
        c = self.column(name)
        return F.lit(False) if c is None else c.isNotNull()

    def kind(self, name: str) -> str | None:
        return self.kinds.get(name)

    def literal(self, value: Value, t: T.DataType) -> Column | None:
        """The value in a column's type; None if it isn't exactly one of it."""
        tag = tag_of(value)
        if tag == "N" and isinstance(t, T.NumericType):
            n = number(value["N"])
            if isinstance(t, T.IntegralType):
                bits = {"byte": 7, "short": 15, "integer": 31, "long": 63}[t.typeName()]
                return F.lit(int(n)).cast(t) if n == n.to_integral_value() and -(1 << bits) <= n < 1 << bits else None
            if isinstance(t, T.DecimalType):
                q = n.quantize(Decimal(1).scaleb(-t.scale)) if abs(n) < Decimal(10) ** (t.precision - t.scale) else None
                return F.lit(q).cast(t) if q is not None and q == n else None
            return F.lit(float(n)).cast(t)
        if tag == "S" and _kind(t) == "S":
            return F.lit(value["S"]) if isinstance(t, T.StringType) else F.lit(value["S"]).try_cast(t)
        if tag == "B" and isinstance(t, T.BinaryType):
            return F.unbase64(F.lit(value["B"]))
        if tag == "BOOL" and isinstance(t, T.BooleanType):
            return F.lit(value["BOOL"])
        if tag in ("L", *SETS) and isinstance(t, T.ArrayType):
            inner = [self.literal(x if tag == "L" else {SETS[tag]: x}, t.elementType) for x in value[tag]]
            return None if any(x is None for x in inner) else (F.array(*inner) if inner else F.array()).cast(t)
        return None

    def equal(self, name: str, value: Value) -> Column:
        c = self.column(name)
        if c is None:
            return F.lit(None).cast("boolean")
        same_kind = self.kinds[name] == tag_of(value)
        found = self.literal(value, self.types[name]) if same_kind else None
        return c == found if found is not None else F.when(c.isNotNull(), F.lit(False))

    def ordered(self, name: str, op: str, value: Value) -> Column:
        c = self.column(name)
        tag = tag_of(value)
        if c is None or tag not in ("N", "S") or self.kinds[name] != tag:
            return F.lit(None).cast("boolean")
        t = self.types[name]
        found = self.literal(value, t)
        if found is None and isinstance(t, T.IntegralType):  # a fraction, or out of range: the nearest integer decides
            n = number(value["N"])
            low, high = -(1 << 63), (1 << 63) - 1
            if n > high or n < low:
                return F.when(c.isNotNull(), F.lit((n > high) == (op in ("<", "<="))))
            whole = math.floor(n) if op in ("<", "<=") else math.ceil(n)
            found, op = F.lit(whole), "<=" if op in ("<", "<=") else ">="
        if found is None:
            found = F.lit(str(number(value["N"]))).cast("double") if tag == "N" else F.lit(None)
        return {"<": c < found, "<=": c <= found, ">": c > found, ">=": c >= found}[op]

    def compare(self, op: str, left: str, right: str) -> Column:
        a, b = self.column(left), self.column(right)
        if a is None or b is None:
            return F.lit(None).cast("boolean")
        same = self.kinds[left] == self.kinds[right]
        if op == "=":
            return a == b if same else F.when(a.isNotNull() & b.isNotNull(), F.lit(False))
        if op == "<>":
            return a != b if same else F.when(a.isNotNull() & b.isNotNull(), F.lit(True))
        if not same or self.kinds[left] not in ("N", "S"):
            return F.lit(None).cast("boolean")
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

    def begins_with(self, name: str, value: Value) -> Column:
        c = self.column(name)
        return c.startswith(value["S"]) if c is not None and isinstance(self.types[name], T.StringType) and "S" in value else F.lit(None).cast("boolean")

    def contains(self, name: str, value: Value) -> Column:
        c, kind = self.column(name), self.kinds.get(name)
        if c is None:
            return F.lit(None).cast("boolean")
        if isinstance(self.types[name], T.StringType) and "S" in value:
            return c.contains(value["S"])
        t = self.types[name]
        if isinstance(t, T.ArrayType) and (kind == "L" or SETS[kind] == tag_of(value)):
            found = self.literal(value, t.elementType)
            if found is not None:
                return F.exists(c, lambda x: x == found)
        return F.when(c.isNotNull(), F.lit(False))

    def type_is(self, name: str, tag: str) -> Column:
        c = self.column(name)
        return F.lit(None).cast("boolean") if c is None else F.when(c.isNotNull(), F.lit(self.kinds[name] == tag))


class ItemBinding:
    def __init__(self, item: str | Column = "item"):
        self.item = F.col(item) if isinstance(item, str) else item

    def column(self, name: str) -> Column:
        return F.try_element_at(self.item, F.lit(name))

    def kind(self, name: str) -> None:
        return None

    def exists(self, name: str) -> Column:
        return F.map_contains_key(self.item, F.lit(name))

    def is_tag(self, name: str, tag: str) -> Column:
        return self.column(name).startswith(f'{{"{tag}":')

    def body(self, name: str, tag: str) -> Column:
        """The inner value's text, NULL if the attribute is of another type."""
        c = self.column(name)
        if tag in ("S", "N", "B"):
            plain = F.substring(c, F.lit(7), F.length(c) - 8)
            plain = F.when(c.contains("\\"), F.get_json_object(c, f"$.{tag}")).otherwise(plain) if tag != "B" else plain
        else:
            plain = F.get_json_object(c, f"$.{tag}")
        return F.when(self.is_tag(name, tag), plain)

    def equal(self, name: str, value: Value) -> Column:
        return self.column(name) == text_of(value)

    def ordered(self, name: str, op: str, value: Value) -> Column:
        tag = tag_of(value)
        if tag not in ("N", "S"):
            return F.lit(None).cast("boolean")
        if tag == "N":
            number(value["N"])
        return self._compared(self.body(name, tag), F.lit(value[tag]), op, tag)

    @staticmethod
    def _compared(a: Column, b: Column, op: str, tag: str) -> Column:
        if tag == "S":
            return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        x, y = a.try_cast("double"), b.try_cast("double")
        # Rounding never turns an order round, so unequal doubles decide; equal ones have the same magnitude.
        move = F.when(x == 0, F.lit(0)).otherwise(-F.floor(F.log10(F.abs(x))))

        def digits(t: Column) -> Column:
            t = F.btrim(t)
            power = F.coalesce(F.regexp_extract(t, "[eE](.+)$", 1).try_cast("int"), F.lit(0))
            return F.concat(F.regexp_extract(t, "^([^eE]*)", 1), F.lit("E"), (power + move).cast("string")).try_cast("decimal(38,37)")

        p, q = digits(a), digits(b)
        if op in ("<=", ">="):
            return F.when(x != y, x < y if op == "<=" else x > y).otherwise(p <= q if op == "<=" else p >= q)
        return F.when(x != y, x < y if op == "<" else x > y).otherwise(p < q if op == "<" else p > q)

    def compare(self, op: str, left: str, right: str) -> Column:
        a, b = self.column(left), self.column(right)
        if op in ("=", "<>"):
            return a == b if op == "=" else a != b
        return F.coalesce(*[self._compared(self.body(left, tag), self.body(right, tag), op, tag) for tag in ("N", "S")])

    def begins_with(self, name: str, value: Value) -> Column:
        if "S" not in value:
            return F.lit(None).cast("boolean")
        # An escaped text begins with its escaped beginning, and with no other.
        return F.when(self.is_tag(name, "S"), self.column(name).startswith(text_of(value)[:-2]))

    def contains(self, name: str, value: Value) -> Column:
        tag = tag_of(value)
        found = F.array_contains(F.from_json(self.body(name, "L"), "array<string>"), text_of(value))
        if tag == "S":
            found = F.coalesce(self.body(name, "S").contains(value["S"]), found)
        for name_of_set, inner in SETS.items():
            if inner == tag:
                found = F.coalesce(F.array_contains(F.from_json(self.body(name, name_of_set), "array<string>"), value[tag]), found)
        return found

    def type_is(self, name: str, tag: str) -> Column:
        return self.is_tag(name, tag)


Binding = TypedBinding | ItemBinding


def need(value: Value, tag: str, what: str) -> str:
    if tag_of(value) != tag:
        raise ValidationError(f"{what} takes {tag}")
    return value[tag]
