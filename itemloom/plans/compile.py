"""Conditions and updates compiled to Spark columns.

Conditions have two truth values. Negations are pushed to the leaves; a positive leaf is emitted bare
(NULL drops the row, as false would, and pushdown stays possible), a negated leaf as
`leaf IS NULL OR NOT leaf`. `condition` is for filters, `truth` where the boolean itself is wanted.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemloom.errors import ValidationError
from itemloom.functions import evaluate
from itemloom.functions.values import Value, number, tag_of, text_of, value_of
from itemloom.plans import expressions as X
from itemloom.plans.binding import Binding, ItemBinding, TypedBinding


def condition(c: X.Condition, b: Binding, positive: bool = True) -> Column:
    if isinstance(c, X.Not):
        return condition(c.inner, b, not positive)
    if isinstance(c, (X.And, X.Or)):
        left, right = condition(c.left, b, positive), condition(c.right, b, positive)
        return left & right if isinstance(c, X.And) == positive else left | right
    if isinstance(c, X.Between):
        return condition(X.And(X.Compare(">=", c.value, c.low), X.Compare("<=", c.value, c.high)), b, positive)
    leaf = _leaf(c, b)
    if isinstance(c, X.Exists):  # never NULL
        return leaf if positive else ~leaf
    return leaf if positive else leaf.isNull() | ~leaf


def truth(c: X.Condition, b: Binding) -> Column:
    return F.coalesce(condition(c, b), F.lit(False))


def _leaf(c: X.Condition, b: Binding) -> Column:
    if not X.paths(c):
        return F.lit(evaluate.holds(c, {}))
    if isinstance(c, X.Exists):
        return b.exists(c.path.name)
    if isinstance(c, X.Compare):
        return _compare(c.op, c.left, c.right, b)
    if isinstance(c, X.In):
        if isinstance(c.value, X.Path) and isinstance(b, TypedBinding) and all(isinstance(x, X.Const) for x in c.choices) and b.column(c.value.name) is not None:
            name = c.value.name
            same = [x.value for x in c.choices if tag_of(x.value) == b.kind(name)]
            plain = [_plain(v, b.types[name]) for v in same]
            if same and None not in plain:
                return b.column(name).isin(plain)
        out = None
        for x in c.choices:
            one = _compare("=", c.value, x, b)
            out = one if out is None else out | one
        return out
    if not isinstance(c.path, X.Path) or not isinstance(c.operand, X.Const):
        raise ValidationError(f"{c.name} takes an attribute and a value")
    if c.name == "begins_with":
        return b.begins_with(c.path.name, c.operand.value)
    if c.name == "contains":
        return b.contains(c.path.name, c.operand.value)
    return b.type_is(c.path.name, c.operand.value.get("S", ""))


def _plain(v: Value, t: T.DataType) -> object:
    """A literal for isin, in the column's own type; None if it takes a cast."""
    if "S" in v and isinstance(t, T.StringType):
        return v["S"]
    if "N" in v and isinstance(t, (T.IntegerType, T.LongType)):
        n = number(v["N"])
        return int(n) if n == n.to_integral_value() and abs(n) < 1 << 31 else None
    return float(number(v["N"])) if "N" in v and isinstance(t, T.DoubleType) else None


def _compare(op: str, left: X.Operand, right: X.Operand, b: Binding) -> Column:
    if isinstance(left, X.Path) and isinstance(right, X.Path):
        return b.compare(op, left.name, right.name)
    if isinstance(left, X.Const) and isinstance(right, X.Const):
        return F.lit(evaluate.holds(X.Compare(op, left, right), {}))
    name, value, op = (left.name, right.value, op) if isinstance(left, X.Path) else (right.name, left.value, X.MIRRORED[op])
    if op == "=":
        return b.equal(name, value)
    if op == "<>":
        return ~b.equal(name, value)
    return b.ordered(name, op, value)


# ---------------------------------------------------------------- updates


def typed_update(df: DataFrame, u: X.Update, where: Column | None = None, sets: dict[str, str] | None = None) -> DataFrame:
    """df with the update applied to the rows that satisfy `where` (NULL: not), all others unchanged.

    Rows whose update would be an error (arithmetic on an absent attribute, a copy of one) raise when read.
    """
    b = TypedBinding(df, sets)
    now = {n: F.col(f"`{n}`") for n in df.columns}
    out = dict(now)
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    # Errors are raised inside CASE branches, so rows that aren't hit can't raise.
    for name, r in u.sets:
        out[name] = _right(r, b, now, b.types.get(name))
    for name in u.removes:
        out[name] = F.lit(None).cast(b.types[name]) if name in b.types else F.lit(None)
    for name, v in u.adds:
        old = out.get(name)
        if tag_of(v) == "N":
            n = _number(v, b.types.get(name))
            out[name] = n if old is None else F.coalesce(old, F.lit(0)) + n
        else:
            new = _array(v, b, name)
            out[name] = new if old is None else F.array_union(F.coalesce(old, F.array().cast(b.types[name])), new)
    for name, v in u.deletes:
        if name in out:
            left = F.array_except(out[name], _array(v, b, name))
            out[name] = F.when(F.size(left) > 0, left)
    columns = []
    for name in [*df.columns, *(n for n in out if n not in now)]:
        if name in now and name not in u.names():
            columns.append(now[name])
        else:
            old = now.get(name, F.lit(None))
            new = out[name].cast(b.types[name]) if name in b.types else out[name]
            columns.append(F.when(hit, new).otherwise(old).alias(name))
    return df.select(*columns)


def _number(v: Value, t: T.DataType | None) -> Column:
    n = number(v["N"])
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return F.lit(float(n))
    return F.lit(int(n)) if n == n.to_integral_value() and abs(n) < 1 << 63 else F.lit(n)


def _array(v: Value, b: TypedBinding, name: str) -> Column:
    t = b.types.get(name, T.ArrayType(T.StringType()))
    found = b.literal(v, t)
    if found is None:
        raise ValidationError(f"{name} doesn't hold such a set")
    return found


def _right(r: X.Right, b: TypedBinding, now: dict[str, Column], t: T.DataType | None) -> Column:
    if isinstance(r, X.Const):
        if t is not None:
            found = b.literal(r.value, t)
            if found is None and tag_of(r.value) == "N" and isinstance(t, T.NumericType):
                found = F.lit(number(r.value["N"]))
            if found is None:
                raise ValidationError("the value doesn't have the column's type")
            return found
        tag = tag_of(r.value)
        return F.lit(r.value[tag]) if tag in ("S", "BOOL") else _number(r.value, None) if tag == "N" else F.lit(text_of(r.value))
    if isinstance(r, X.Path):
        if r.name not in now:
            raise ValidationError(f"{r.name} does not exist")
        return _present(now[r.name], r.name)
    if isinstance(r, X.IfNotExists):
        other = _right(r.other, b, now, b.types.get(r.path.name, t))
        return F.coalesce(now[r.path.name], other) if r.path.name in now else other
    if isinstance(r, X.ListAppend):
        return F.concat(_right(r.left, b, now, t), _right(r.right, b, now, t))
    sides = [_operand(x, b, now, t) for x in (r.left, r.right)]
    return sides[0] + sides[1] if r.op == "+" else sides[0] - sides[1]


def _operand(r: X.Right, b: TypedBinding, now: dict[str, Column], t: T.DataType | None) -> Column:
    if isinstance(r, X.Const):
        if tag_of(r.value) != "N":
            raise ValidationError("arithmetic takes numbers")
        return _number(r.value, t)
    return _right(r, b, now, t)


def _present(c: Column, name: str) -> Column:
    return F.coalesce(c, F.raise_error(F.lit(f"the expression reads {name}, an attribute that does not exist")))


def item_update(item: str, u: X.Update, where: X.Condition | None = None) -> Column:
    """The map column after an update of the items that satisfy a condition.

    The condition is compiled; only the attributes that the update reads or writes, of items that it hits, go through
    Arrow batches, since numbers have 38 digits. All others keep their text.
    """
    written = sorted(set(u.names()))
    reads = sorted(set(written) | X.paths([r for _, r in u.sets]))

    @F.pandas_udf("array<string>")
    def apply(hit: pd.Series, *columns: pd.Series) -> pd.Series:
        out: list = [None] * len(hit)
        for i, (now, *texts) in enumerate(zip(hit, *columns)):
            if now:
                done = evaluate.updated(u, {n: value_of(t) for n, t in zip(reads, texts) if t is not None})
                out[i] = [text_of(done[n]) if n in done else None for n in written]
        return pd.Series(out, dtype=object)

    c = F.col(item)
    hit = c.isNotNull() & (truth(where, ItemBinding(item)) if where is not None else F.lit(True))
    new = apply(hit, *[F.try_element_at(c, F.lit(n)) for n in reads])
    kept = F.map_filter(c, lambda k, _: ~k.isin(written))
    changed = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in written]), new), lambda _, v: v.isNotNull())
    return F.when(hit, F.map_concat(kept, changed)).otherwise(c)


def project(df: DataFrame, names: list[str] | None, b: Binding, item: str = "item") -> DataFrame:
    """Only the named attributes; absent ones are skipped."""
    if names is None:
        return df
    if isinstance(b, ItemBinding):
        return df.withColumn(item, F.map_filter(item, lambda k, _: k.isin(names)))
    return df.select(*[f"`{n}`" for n in names if n in df.columns])


def item_of(columns: dict[str, Column], types: dict[str, T.DataType]) -> Column:
    """Typed columns as a map of canonical text, absent ones left out."""
    parts = []
    for name, c in columns.items():
        t = types[name]
        quoted = lambda x: F.substring(F.to_json(F.array(x)), F.lit(2), F.length(F.to_json(F.array(x))) - 2)
        if isinstance(t, T.NumericType):
            body = F.concat(F.lit('{"N":'), quoted(c.cast("string")), F.lit("}"))
        elif isinstance(t, T.BooleanType):
            body = F.concat(F.lit('{"BOOL":'), c.cast("string"), F.lit("}"))
        elif isinstance(t, T.BinaryType):
            body = F.concat(F.lit('{"B":'), quoted(F.base64(c)), F.lit("}"))
        elif isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType):
            body = F.concat(F.lit('{"L":'), F.to_json(F.transform(c, lambda x: F.struct(x.alias("S")))), F.lit("}"))
        elif isinstance(t, T.ArrayType) and isinstance(t.elementType, T.NumericType):
            body = F.concat(F.lit('{"L":'), F.to_json(F.transform(c, lambda x: F.struct(x.cast("string").alias("N")))), F.lit("}"))
        else:
            body = F.concat(F.lit('{"S":'), quoted(c.cast("string")), F.lit("}"))
        parts += [F.lit(name), F.when(c.isNotNull(), body)]
    return F.map_filter(F.create_map(*parts), lambda _, v: v.isNotNull())


