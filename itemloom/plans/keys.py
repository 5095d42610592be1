"""Table schemas, and key conditions brought to bounds."""

from __future__ import annotations

from dataclasses import dataclass, field

from itemloom.errors import ResourceNotFound, ValidationError
from itemloom.functions.values import Value, tag_of
from itemloom.plans.expressions import MIRRORED, And, Between, Call, Compare, Condition, Const, Path


@dataclass(frozen=True)
class Key:
    name: str
    kind: str  # S, N or B


@dataclass(frozen=True)
class Index:
    name: str
    pk: Key
    sk: Key | None = None
    local: bool = False
    serveable: bool = True
    reason: str = ""
    projection: dict = field(default_factory=dict, hash=False, compare=False)  # as it was asked for; reads return whole items


@dataclass(frozen=True)
class TableSchema:
    name: str
    pk: Key
    sk: Key | None = None
    indexes: dict[str, Index] = field(default_factory=dict)

    def keys(self) -> list[Key]:
        return [self.pk] + ([self.sk] if self.sk else [])

    def index(self, name: str | None) -> Index | None:
        """The index to read; None for the table itself."""
        if name is None:
            return None
        if name not in self.indexes:
            raise ResourceNotFound(f"{self.name} has no index {name}")
        found = self.indexes[name]
        if not found.serveable:
            raise ResourceNotFound(f"index {name} can't be read: {found.reason}")
        return found

    def read_keys(self, index: Index | None) -> list[Key]:
        """The keys that a read through the index is ordered by: its own, then the table's as tie-breaks."""
        if index is None:
            return self.keys()
        own = [index.pk] + ([index.sk] if index.sk else [])
        return own + [k for k in self.keys() if k.name not in {o.name for o in own}]


@dataclass(frozen=True)
class Bounds:
    """pk = value, and (op, values) on the sort key: a comparison, BETWEEN or begins_with."""

    pk: Value
    sk: tuple[str, tuple[Value, ...]] | None = None


def bounds(condition: Condition, pk: Key, sk: Key | None) -> Bounds:
    """Bounds of a key condition: pk = :v, first, then perhaps one term on the sort key."""
    left, right = (condition.left, condition.right) if isinstance(condition, And) else (condition, None)
    if not isinstance(left, Compare):
        raise ValidationError("a key condition starts with an equality on the partition key")
    path, op, value = _sides(left)
    if path != pk.name:
        raise ValidationError(f"the key condition misses the partition key {pk.name}")
    if op != "=":
        raise ValidationError("the partition key takes = only")
    _typed(value, pk)
    if right is None:
        return Bounds(value)
    if sk is None:
        raise ValidationError("there is no sort key to restrict")
    if isinstance(right, Compare):
        path, op, low = _sides(right)
        terms: tuple[Value, ...] = (low,)
        if op == "<>":
            raise ValidationError("the sort key doesn't take <>")
    elif isinstance(right, Between) and isinstance(right.value, Path) and isinstance(right.low, Const) and isinstance(right.high, Const):
        path, op, terms = right.value.name, "BETWEEN", (right.low.value, right.high.value)
    elif isinstance(right, Call) and right.name == "begins_with" and isinstance(right.path, Path) and isinstance(right.operand, Const):
        path, op, terms = right.path.name, "begins_with", (right.operand.value,)
        if sk.kind != "S":
            raise ValidationError("begins_with needs a sort key of type S")
    else:
        raise ValidationError("unsupported condition on the sort key")
    if path != sk.name:
        raise ValidationError(f"{path} is not the sort key")
    for t in terms:
        _typed(t, sk)
    return Bounds(value, (op, terms))


def _sides(c: Compare) -> tuple[str, str, Value]:
    """Attribute, operator and value, with the operator mirrored where the value comes first."""
    if isinstance(c.left, Path) and isinstance(c.right, Const):
        return c.left.name, c.op, c.right.value
    if isinstance(c.left, Const) and isinstance(c.right, Path):
        return c.right.name, MIRRORED[c.op], c.left.value
    raise ValidationError("a key condition compares a key attribute with a value")


def _typed(value: Value, key: Key) -> None:
    if tag_of(value) != key.kind:
        raise ValidationError(f"{key.name} is of type {key.kind}")
