"""Conditions and updates on plain items: the semantics that the compiled forms must match.

A condition is true or false, never unknown: a missing attribute makes any comparison false, so its
negation is true.
"""

from __future__ import annotations

import base64

from itemloom.errors import ValidationError
from itemloom.functions.values import SETS, Item, Value, DIGITS, number, number_text, tag_of, text_of
from itemloom.plans import expressions as X


def value(operand: X.Operand, item: Item) -> Value | None:
    return operand.value if isinstance(operand, X.Const) else item.get(operand.name)


def ordered(op: str, a: Value | None, b: Value | None) -> bool:
    if a is None or b is None or tag_of(a) != tag_of(b) or tag_of(a) not in ("N", "S"):
        return False
    x, y = (number(a["N"]), number(b["N"])) if "N" in a else (a["S"].encode(), b["S"].encode())
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def same(a: Value | None, b: Value | None) -> bool:
    return a is not None and b is not None and text_of(a) == text_of(b)


def holds(c: X.Condition, item: Item) -> bool:
    if isinstance(c, X.And):
        return holds(c.left, item) and holds(c.right, item)
    if isinstance(c, X.Or):
        return holds(c.left, item) or holds(c.right, item)
    if isinstance(c, X.Not):
        return not holds(c.inner, item)
    if isinstance(c, X.Exists):
        return c.path.name in item
    if isinstance(c, X.Compare):
        a, b = value(c.left, item), value(c.right, item)
        if c.op in ("=", "<>"):
            return a is not None and b is not None and same(a, b) == (c.op == "=")
        return ordered(c.op, a, b)
    if isinstance(c, X.Between):
        v = value(c.value, item)
        return ordered(">=", v, value(c.low, item)) and ordered("<=", v, value(c.high, item))
    if isinstance(c, X.In):
        return any(same(value(c.value, item), value(x, item)) for x in c.choices)
    a, b = value(c.path, item), value(c.operand, item)
    if a is None or b is None:
        return False
    if c.name == "attribute_type":
        return b.get("S") == tag_of(a)
    if c.name == "begins_with":
        return "S" in a and "S" in b and a["S"].startswith(b["S"])
    tag = tag_of(a)
    if tag == "S":
        return "S" in b and b["S"] in a["S"]
    if tag in SETS:
        return SETS[tag] == tag_of(b) and b[SETS[tag]] in a[tag]
    return tag == "L" and any(same(x, b) for x in a["L"])


def right(r: X.Right, item: Item) -> Value:
    if isinstance(r, X.Const):
        return r.value
    if isinstance(r, X.Path):
        if r.name not in item:
            raise ValidationError(f"the expression reads {r.name}, an attribute that does not exist")
        return item[r.name]
    if isinstance(r, X.IfNotExists):
        return item[r.path.name] if r.path.name in item else right(r.other, item)
    a, b = right(r.left, item), right(r.right, item)
    if isinstance(r, X.ListAppend):
        if "L" not in a or "L" not in b:
            raise ValidationError("list_append takes two lists")
        return {"L": a["L"] + b["L"]}
    if "N" not in a or "N" not in b:
        raise ValidationError(f"{r.op} takes two numbers")
    x, y = number(a["N"]), number(b["N"])
    return {"N": number_text(DIGITS.add(x, y) if r.op == "+" else DIGITS.subtract(x, y))}


def added(old: Value | None, new: Value) -> Value:
    tag = tag_of(new)
    if tag == "N":
        if old is not None and "N" not in old:
            raise ValidationError("ADD of a number to another type")
        return {"N": number_text(DIGITS.add(number(old["N"]) if old else number("0"), number(new["N"])))}
    if old is not None and tag_of(old) != tag:
        raise ValidationError("ADD of a set to another type")
    return {tag: list(dict.fromkeys([*(old[tag] if old else []), *new[tag]]))}


def updated(u: X.Update, item: Item) -> Item:
    """SET from the item as it was, then REMOVE, ADD and DELETE, each on the result."""
    out = dict(item)
    out.update({name: right(r, item) for name, r in u.sets})
    for name in u.removes:
        out.pop(name, None)
    for name, v in u.adds:
        out[name] = added(out.get(name), v)
    for name, v in u.deletes:
        tag = tag_of(v)
        if name not in out:
            continue
        if tag_of(out[name]) != tag:
            raise ValidationError("DELETE of a set from another type")
        left = [x for x in out[name][tag] if x not in v[tag]]
        if left:
            out[name] = {tag: left}
        else:
            del out[name]
    return out


def bytes_of(v: Value) -> bytes:
    return base64.b64decode(v["B"])
