"""Attribute values: objects with one of ten type tags, their canonical text, and numbers of any precision.

An item is a dict from attribute names to values such as {"S": "x"}; its stored form is a map from
attribute names to canonical JSON text, in which equal values have equal text: object keys are sorted
and there is no white space. Numbers keep the text they came with.
"""

from __future__ import annotations

import base64
import binascii
import json
from decimal import ROUND_HALF_EVEN, Context, Decimal, InvalidOperation

from itemloom.errors import ValidationError

Value = dict
Item = dict[str, Value]

TAGS = ("S", "N", "B", "BOOL", "NULL", "L", "M", "SS", "NS", "BS")
SETS = {"SS": "S", "NS": "N", "BS": "B"}
KEY_TAGS = ("S", "N", "B")
#: 38 digits, as many as a number may have.
DIGITS = Context(prec=38, rounding=ROUND_HALF_EVEN, Emax=1000, Emin=-1000)


def tag_of(value: Value) -> str:
    return next(iter(value))


def checked(value: object) -> Value:
    """The value if it is well formed; base64 is brought to its standard form."""
    if not isinstance(value, dict) or len(value) != 1:
        raise ValidationError("an attribute value is an object with exactly one type")
    tag, body = next(iter(value.items()))
    if tag not in TAGS:
        raise ValidationError(f"unknown type {tag}")
    if tag in ("S", "N"):
        if not isinstance(body, str):
            raise ValidationError(f"{tag} takes a string")
        return {tag: body}
    if tag == "B":
        return {tag: _base64(body)}
    if tag == "BOOL":
        if not isinstance(body, bool):
            raise ValidationError("BOOL takes true or false")
        return {tag: body}
    if tag == "NULL":
        if body is not True:
            raise ValidationError("NULL takes true")
        return {tag: True}
    if tag == "M":
        if not isinstance(body, dict):
            raise ValidationError("M takes an object")
        return {tag: {k: checked(v) for k, v in body.items()}}
    if not isinstance(body, list):
        raise ValidationError(f"{tag} takes a list")
    if tag == "L":
        return {tag: [checked(v) for v in body]}
    if not all(isinstance(x, str) for x in body):
        raise ValidationError(f"{tag} takes a list of strings")
    return {tag: [_base64(x) for x in body] if tag == "BS" else body}


def _base64(body: object) -> str:
    if not isinstance(body, str):
        raise ValidationError("binary values are base64 text")
    try:
        return base64.b64encode(base64.b64decode(body, validate=True)).decode()
    except binascii.Error as e:
        raise ValidationError(f"bad base64: {e}") from e


def checked_item(item: object) -> Item:
    if not isinstance(item, dict):
        raise ValidationError("an item is an object")
    return {k: checked(v) for k, v in item.items()}


def text_of(value: Value) -> str:
    """Canonical text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def value_of(text: str) -> Value:
    return json.loads(text)


def number(text: str) -> Decimal:
    try:
        n = Decimal(text.strip())
    except InvalidOperation as e:
        raise ValidationError(f"{text!r} is not a number") from e
    if not n.is_finite():
        raise ValidationError(f"{text!r} is not a number")
    return n


def number_text(n: Decimal) -> str:
    """Plain digits without needless zeros; an exponent only where the digits would exceed 38."""
    n = DIGITS.plus(n).normalize(DIGITS)
    if not n:
        return "0"
    plain = format(n, "f")
    return plain if len(plain.strip("-0.")) <= 38 and len(plain) <= 41 else str(n)


def order_key(text: str) -> str:
    """Text whose byte order is numeric order: sign, exponent + 500, digits; complemented for negative numbers."""
    n = number(text)
    if not n:
        return "1"
    sign, digits, exponent = n.normalize(Context(prec=200)).as_tuple()
    places = len(digits) + int(exponent) + 500
    if not 0 <= places <= 999:
        raise ValidationError(f"{text!r} is out of range")
    body = f"{places:03d}" + "".join(map(str, digits))
    return "2" + body if not sign else "0" + "".join(str(9 - int(c)) for c in body) + "~"


def key_text(value: Value, kind: str) -> str:
    """A key value as text in key order: bytes for S, numbers for N, bytes for B."""
    if tag_of(value) != kind:
        raise ValidationError(f"the key must be of type {kind}")
    body = value[kind]
    if body == "":
        raise ValidationError("a key attribute may not be empty")
    return body if kind == "S" else order_key(body) if kind == "N" else base64.b64decode(body).hex()
