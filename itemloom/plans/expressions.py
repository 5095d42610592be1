"""The three expression languages: conditions, updates and projections, from text to bound trees.

Names (#n) and values (:v) are looked up in the request's maps, whose keys may come with or without
their sign. A bare name may not be reserved: `RESERVED` holds the common reserved words, and the full
published list can be set with `use_reserved_words`.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Union

from itemloom.errors import ValidationError
from itemloom.functions.values import SETS, Value, checked, tag_of

#: Fixed words, from the published list of reserved words of the item API; the whole list is a parameter.
RESERVED = set(
    "ABORT ADD AFTER ALL ALTER AND ANY ARRAY AS ASC AUTHORIZATION BEGIN BETWEEN BINARY BLOB BOOLEAN BOTH BY CASCADE CASE CAST CHAR CHECK CLUSTER COLLATE COLUMN COMMENT COMMIT CONNECT CONSTRAINT CONTAINS COUNT COUNTER CREATE CROSS CURRENT CURSOR DATA DATABASE DATE DAY DEFAULT DELETE DESC DISTINCT DOMAIN DOUBLE DROP ELSE END ERROR ESCAPE EXCEPT EXISTS EXPLAIN FALSE FETCH FILE FILTER FIRST FLOAT FOR FOREIGN FORMAT FROM FULL FUNCTION GLOBAL GRANT GROUP HASH HAVING HIDDEN HOUR IDENTIFIED IDENTITY IF IN INDEX INNER INSERT INT INTO IS ITEM ITEMS JOIN KEY KEYS LANGUAGE LAST LEFT LEVEL LIKE LIMIT LIST LOCAL LOCATION LOOP MAP MAX MERGE METHOD MIN MINUTE MODE MONTH NAME NAMES NEW NO NOT NULL NUMBER OBJECT OF ON OR ORDER OWNER PARTITION PATH PERCENT PLAN POSITION PRIMARY QUERY RANGE READ REGION REPLACE RIGHT ROLE ROW SCAN SECOND SELECT SET SIZE SOURCE STATUS STRING TABLE TEXT TIME TO TOKEN TRUE TYPE UNION UPDATE USER USING VALUE VALUES VIEW WHERE YEAR ZONE".split()
)


def use_reserved_words(words: Iterable[str]) -> None:
    """Take the words, any case, as the reserved ones."""
    RESERVED.clear()
    RESERVED.update(w.upper() for w in words)


# ---------------------------------------------------------------- trees


@dataclass(frozen=True)
class Path:
    name: str


@dataclass(frozen=True)
class Const:
    value: Value = field(hash=False)


Operand = Union[Path, Const]


@dataclass(frozen=True)
class Compare:
    op: str
    left: Operand
    right: Operand


@dataclass(frozen=True)
class Between:
    value: Operand
    low: Operand
    high: Operand


@dataclass(frozen=True)
class In:
    value: Operand
    choices: tuple[Operand, ...]


@dataclass(frozen=True)
class Exists:
    path: Path


@dataclass(frozen=True)
class Call:
    """begins_with, contains or attribute_type."""

    name: str
    path: Operand
    operand: Operand


@dataclass(frozen=True)
class And:
    left: "Condition"
    right: "Condition"


@dataclass(frozen=True)
class Or:
    left: "Condition"
    right: "Condition"


@dataclass(frozen=True)
class Not:
    inner: "Condition"


Condition = Union[Compare, Between, In, Exists, Call, And, Or, Not]


@dataclass(frozen=True)
class Arithmetic:
    op: str
    left: "Right"
    right: "Right"


@dataclass(frozen=True)
class IfNotExists:
    path: Path
    other: "Right"


@dataclass(frozen=True)
class ListAppend:
    left: "Right"
    right: "Right"


Right = Union[Path, Const, Arithmetic, IfNotExists, ListAppend]


@dataclass
class Update:
    sets: list[tuple[str, Right]] = field(default_factory=list)
    removes: list[str] = field(default_factory=list)
    adds: list[tuple[str, Value]] = field(default_factory=list)
    deletes: list[tuple[str, Value]] = field(default_factory=list)

    def names(self) -> list[str]:
        return [*(n for n, _ in self.sets), *self.removes, *(n for n, _ in self.adds), *(n for n, _ in self.deletes)]


# ---------------------------------------------------------------- parsing

TOKEN = re.compile(r"\s*(?:(?P<name>#?[A-Za-z_][A-Za-z0-9_]*|#[0-9][A-Za-z0-9_]*)|(?P<value>:[A-Za-z0-9_]+)|(?P<sign><>|<=|>=|[=<>(),+\-.\[\]]|[0-9]+))")
COMPARISONS = ("=", "<>", "<", "<=", ">", ">=")
MIRRORED = {"=": "=", "<>": "<>", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


class Parser:
    def __init__(self, text: str, names: dict[str, str] | None, values: dict[str, Value] | None):
        self.names = {k.lstrip("#"): v for k, v in (names or {}).items()}
        self.values = {k.lstrip(":"): v for k, v in (values or {}).items()}
        self.tokens: list[str] = []
        at = 0
        while text[at:].strip():
            m = TOKEN.match(text, at)
            if not m:
                raise ValidationError(f"syntax error at {text[at:].strip()[:20]!r}")
            self.tokens.append(m[0].strip())
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def word(self) -> str:
        return self.peek().upper()

    def take(self, expected: str | None = None) -> str:
        token = self.peek()
        if not token or expected is not None and token.upper() != expected:
            raise ValidationError(f"expected {expected or 'more'}, found {token or 'the end'!r}")
        self.at += 1
        return token

    def end(self) -> None:
        if self.peek():
            raise ValidationError(f"unexpected {self.peek()!r}")

    def path(self) -> Path:
        token = self.take()
        if token.startswith("#"):
            if token[1:] not in self.names:
                raise ValidationError(f"{token} is not among the expression attribute names")
            name = self.names[token[1:]]
        elif re.fullmatch(r"[A-Za-z_]\w*", token):
            if token.upper() in RESERVED:
                raise ValidationError(f"{token} is a reserved word; use an expression attribute name")
            name = token
        else:
            raise ValidationError(f"expected an attribute name, found {token!r}")
        if self.peek() in (".", "["):
            raise ValidationError("only top-level attributes are supported")
        return Path(name)

    def const(self) -> Const:
        token = self.take()
        if not token.startswith(":"):
            raise ValidationError(f"expected a value, found {token!r}")
        if token[1:] not in self.values:
            raise ValidationError(f"{token} is not among the expression attribute values")
        return Const(checked(self.values[token[1:]]))

    def operand(self) -> Operand:
        return self.const() if self.peek().startswith(":") else self.path()

    def follows_call(self) -> bool:
        return self.at + 1 < len(self.tokens) and self.tokens[self.at + 1] == "("

    # conditions

    def condition(self) -> Condition:
        left = self.conjunction()
        while self.word() == "OR":
            self.take()
            left = Or(left, self.conjunction())
        return left

    def conjunction(self) -> Condition:
        left = self.negation()
        while self.word() == "AND":
            self.take()
            left = And(left, self.negation())
        return left

    def negation(self) -> Condition:
        if self.word() == "NOT":
            self.take()
            return Not(self.negation())
        return self.atom()

    def atom(self) -> Condition:
        if self.peek() == "(":
            self.take()
            inner = self.condition()
            self.take(")")
            return inner
        name = self.peek().lower()
        if self.follows_call() and name in ("attribute_exists", "attribute_not_exists", "begins_with", "contains", "attribute_type"):
            self.take()
            self.take("(")
            first = self.operand()
            if name.startswith("attribute_") and name != "attribute_type":
                self.take(")")
                if not isinstance(first, Path):
                    raise ValidationError(f"{name} takes an attribute")
                return Exists(first) if name == "attribute_exists" else Not(Exists(first))
            self.take(",")
            second = self.operand()
            self.take(")")
            return Call(name, first, second)
        if self.follows_call() and name not in ("in",):
            raise ValidationError(f"unknown function {self.peek()}")
        left = self.operand()
        if self.word() == "BETWEEN":
            self.take()
            low = self.operand()
            self.take("AND")
            return Between(left, low, self.operand())
        if self.word() == "IN":
            self.take()
            self.take("(")
            choices = [self.operand()]
            while self.peek() == ",":
                self.take()
                choices.append(self.operand())
            self.take(")")
            return In(left, tuple(choices))
        op = self.take()
        if op not in COMPARISONS:
            raise ValidationError(f"expected a comparison, found {op!r}")
        return Compare(op, left, self.operand())

    # updates

    def update(self) -> Update:
        out, seen = Update(), set()
        while self.peek():
            clause = self.take().upper()
            if clause not in ("SET", "REMOVE", "ADD", "DELETE"):
                raise ValidationError(f"expected SET, REMOVE, ADD or DELETE, found {clause!r}")
            if clause in seen:
                raise ValidationError(f"{clause} may be given once only")
            seen.add(clause)
            while True:
                path = self.path().name
                if clause == "SET":
                    self.take("=")
                    out.sets.append((path, self.right()))
                elif clause == "REMOVE":
                    out.removes.append(path)
                else:
                    value = self.const().value
                    tag = tag_of(value)
                    if tag not in SETS and (clause == "DELETE" or tag != "N"):
                        raise ValidationError(f"{clause} takes a {'number or a ' if clause == 'ADD' else ''}set")
                    (out.adds if clause == "ADD" else out.deletes).append((path, value))
                if self.peek() != ",":
                    break
                self.take()
        if not seen:
            raise ValidationError("the update expression is empty")
        return out

    def right(self) -> Right:
        left = self.term()
        if self.peek() in ("+", "-"):
            op = self.take()
            return Arithmetic(op, left, self.term())
        return left

    def term(self) -> Right:
        name = self.peek().lower()
        if self.follows_call():
            if name not in ("if_not_exists", "list_append"):
                raise ValidationError(f"unknown function {self.peek()}")
            self.take()
            self.take("(")
            if name == "if_not_exists":
                path = self.path()
                self.take(",")
                out: Right = IfNotExists(path, self.right())
            else:
                left = self.term()
                self.take(",")
                out = ListAppend(left, self.term())
            self.take(")")
            return out
        return self.operand()


def condition(text: str, names: dict | None = None, values: dict | None = None) -> Condition:
    p = Parser(text, names, values)
    out = p.condition()
    p.end()
    return out


def update(text: str, names: dict | None = None, values: dict | None = None) -> Update:
    return Parser(text, names, values).update()


def projection(text: str | None, names: dict | None = None) -> list[str] | None:
    """The attributes of a projection, each once; None if it is blank."""
    if text is None or not text.strip():
        return None
    p = Parser(text, names, None)
    out = [p.path().name]
    while p.peek() == ",":
        p.take()
        out.append(p.path().name)
    p.end()
    return list(dict.fromkeys(out))


def paths(node: object) -> set[str]:
    """The attributes that a condition or an update's right side reads."""
    if isinstance(node, Path):
        return {node.name}
    if isinstance(node, Const) or not hasattr(node, "__dataclass_fields__"):
        return set().union(*map(paths, node)) if isinstance(node, (tuple, list)) else set()
    return set().union(*(paths(getattr(node, f)) for f in node.__dataclass_fields__))
