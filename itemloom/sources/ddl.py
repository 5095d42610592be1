"""Validation of table definitions, and their descriptions."""

from __future__ import annotations

import re

from itemloom.errors import ResourceInUse, ValidationError
from itemloom.plans.keys import Index, Key, TableSchema

MAX_LOCAL_INDEXES = 5
RESERVED_PREFIX = "_"
PROJECTIONS = ("ALL", "KEYS_ONLY", "INCLUDE")


def listed(request: dict, name: str) -> list[dict]:
    """A list of objects of a request; empty if it isn't given."""
    found = request.get(name) or []
    if not isinstance(found, list) or not all(isinstance(x, dict) for x in found):
        raise ValidationError(f"{name} is a list of objects")
    return found


def table_name(name: object) -> str:
    if not isinstance(name, str) or not re.fullmatch(r"[a-zA-Z0-9_.\-]{3,255}", name):
        raise ValidationError("a table name has 3 to 255 of a-z, A-Z, 0-9, _, . and -")
    if name.startswith(RESERVED_PREFIX):
        raise ValidationError(f"table names may not start with {RESERVED_PREFIX}")
    return name


def index_name(name: object) -> str:
    if not isinstance(name, str) or not re.fullmatch(r"[a-zA-Z0-9_.\-]{3,255}", name):
        raise ValidationError("an index name has 3 to 255 of a-z, A-Z, 0-9, _, . and -")
    return name


def attribute_types(request: dict) -> dict[str, str]:
    out: dict[str, str] = {}
    for d in listed(request, "AttributeDefinitions"):
        name, kind = d.get("AttributeName"), d.get("AttributeType")
        if not isinstance(name, str) or not 1 <= len(name.encode()) <= 255:
            raise ValidationError("an attribute name has 1 to 255 bytes")
        if kind not in ("S", "N", "B"):
            raise ValidationError(f"a key attribute is of type S, N or B, not {kind}")
        if name in out:
            raise ValidationError(f"{name} is defined twice")
        out[name] = kind
    return out


def key_schema(entries: object, types: dict[str, str]) -> tuple[Key, Key | None]:
    if not isinstance(entries, list) or not 1 <= len(entries) <= 2 or not all(isinstance(e, dict) for e in entries):
        raise ValidationError("a key schema has one or two entries")
    if [e.get("KeyType") for e in entries] != ["HASH", "RANGE"][: len(entries)]:
        raise ValidationError("a key schema is HASH, then perhaps RANGE")
    names = [e.get("AttributeName") for e in entries]
    if len(set(names)) < len(names):
        raise ValidationError("the same attribute is given twice in a key schema")
    for n in names:
        if n not in types:
            raise ValidationError(f"the key attribute {n} isn't defined")
    keys = [Key(n, types[n]) for n in names]
    return keys[0], keys[1] if len(keys) > 1 else None


def index(spec: dict, types: dict[str, str], local: bool, pk: Key, sk: Key | None) -> Index:
    name = index_name(spec.get("IndexName"))
    projection = spec.get("Projection") or {"ProjectionType": "ALL"}
    if not isinstance(projection, dict) or projection.get("ProjectionType", "ALL") not in PROJECTIONS:
        raise ValidationError(f"unknown projection {projection}")
    others = projection.get("NonKeyAttributes")
    if (projection.get("ProjectionType") == "INCLUDE") != bool(others) or others and not (isinstance(others, list) and all(isinstance(x, str) for x in others)):
        raise ValidationError("INCLUDE, and only that, takes a list of other attributes")
    own = Index(name, *key_schema(spec.get("KeySchema"), types), local=local, projection=projection)
    if local:
        if sk is None:
            raise ValidationError("a local index needs a table with a sort key")
        if own.pk != pk or own.sk is None or own.sk == sk:
            raise ValidationError("a local index has the table's partition key and another sort key")
    elif (own.pk, own.sk) == (pk, sk):
        raise ValidationError("a global index may not repeat the table's key")
    return own


def create(request: dict) -> tuple[TableSchema, dict]:
    """Schema and other settings of a CreateTable request."""
    name = table_name(request.get("TableName"))
    types = attribute_types(request)
    pk, sk = key_schema(request.get("KeySchema"), types)
    locals_, globals_ = listed(request, "LocalSecondaryIndexes"), listed(request, "GlobalSecondaryIndexes")
    if len(locals_) > MAX_LOCAL_INDEXES:
        raise ValidationError(f"a table has at most {MAX_LOCAL_INDEXES} local indexes")
    indexes: dict[str, Index] = {}
    for spec, local in [*((s, True) for s in locals_), *((s, False) for s in globals_)]:
        one = index(spec, types, local, pk, sk)
        if one.name in indexes:
            raise ValidationError(f"two indexes are named {one.name}")
        indexes[one.name] = one
    used = {k.name for k in (pk, sk, *(x for i in indexes.values() for x in (i.pk, i.sk))) if k}
    if extra := set(types) - used:
        raise ValidationError(f"attributes are defined but not used: {', '.join(sorted(extra))}")
    if (request.get("StreamSpecification") or {}).get("StreamEnabled"):
        raise ValidationError("streams aren't supported")
    schema = TableSchema(name, pk, sk, indexes)
    distinct_columns(schema)
    return schema, {"BillingMode": billing(request), "Tags": request.get("Tags") or []}


def distinct_columns(schema: TableSchema) -> None:
    """No two indexes may be stored in the same column: names are told apart without regard to case, as stored columns are."""
    names = ["pk", "sk", "item", *(f"ix_{i.name}_{part}".lower() for i in schema.indexes.values() for part in ("pk", "sk"))]
    if len(set(names)) < len(names):
        raise ValidationError("two indexes would be stored in the same column")


def billing(request: dict) -> str:
    mode = request.get("BillingMode", "PROVISIONED")
    if mode not in ("PROVISIONED", "PAY_PER_REQUEST"):
        raise ValidationError(f"unknown billing mode {mode}")
    given = request.get("ProvisionedThroughput")
    if mode == "PAY_PER_REQUEST" and given:
        raise ValidationError("PAY_PER_REQUEST takes no throughput")
    for v in (given or {}).values():
        if not isinstance(v, int) or v < 1:
            raise ValidationError("throughput is at least 1")
    return mode


def update(request: dict, schema: TableSchema) -> tuple[TableSchema, dict, list[str]]:
    """New schema, changed settings and the indexes that were added."""
    changes = listed(request, "GlobalSecondaryIndexUpdates")
    settings = {"BillingMode": billing(request)} if "BillingMode" in request or "ProvisionedThroughput" in request else {}
    if not changes and not settings:
        raise ValidationError("the request changes nothing")
    indexes, added = dict(schema.indexes), []
    types = {k.name: k.kind for k in [*schema.keys(), *(x for i in indexes.values() for x in (i.pk, i.sk) if x)]}
    for n, kind in attribute_types(request).items():
        if types.setdefault(n, kind) != kind:
            raise ValidationError(f"{n} is of type {types[n]}")
    for change in changes:
        if len(change) != 1 or not isinstance(next(iter(change.values())), dict):
            raise ValidationError("exactly one of Create, Update and Delete is given")
        kind, spec = next(iter(change.items()))
        if kind == "Create":
            one = index(spec, types, False, schema.pk, schema.sk)
            if one.name in indexes:
                raise ResourceInUse(f"there is an index {one.name} already")
            indexes[one.name] = one
            added.append(one.name)
        elif kind == "Delete":
            name = index_name(spec.get("IndexName"))
            if name not in indexes or indexes[name].local:
                raise ValidationError(f"there is no global index {name}")
            del indexes[name]
        else:
            raise ValidationError(f"{kind} of an index isn't supported")
    used = {k.name for k in [*schema.keys(), *(x for i in indexes.values() for x in (i.pk, i.sk) if x)]}
    if extra := {d["AttributeName"] for d in listed(request, "AttributeDefinitions")} - used:
        raise ValidationError(f"attributes are defined but not used: {', '.join(sorted(extra))}")
    after = TableSchema(schema.name, schema.pk, schema.sk, indexes)
    distinct_columns(after)
    return after, settings, added


def described(schema: TableSchema, status: str, info: dict, items: int = 0) -> dict:
    def keys(pk: Key, sk: Key | None) -> list[dict]:
        return [{"AttributeName": pk.name, "KeyType": "HASH"}] + ([{"AttributeName": sk.name, "KeyType": "RANGE"}] if sk else [])

    every = {k.name: k.kind for k in [*schema.keys(), *(x for i in schema.indexes.values() for x in (i.pk, i.sk) if x)]}
    out = {
        "TableName": schema.name,
        "TableStatus": status,
        "KeySchema": keys(schema.pk, schema.sk),
        "AttributeDefinitions": [{"AttributeName": n, "AttributeType": every[n]} for n in sorted(every)],
        "BillingModeSummary": {"BillingMode": info.get("BillingMode", "PROVISIONED")},
        "ItemCount": items,
    }
    for local, title in ((True, "LocalSecondaryIndexes"), (False, "GlobalSecondaryIndexes")):
        found = [i for _, i in sorted(schema.indexes.items()) if i.local == local]
        if found:
            out[title] = [{"IndexName": i.name, "KeySchema": keys(i.pk, i.sk), "Projection": i.projection or {"ProjectionType": "ALL"}} | ({} if local else {"IndexStatus": "ACTIVE" if i.serveable else "CREATING"}) for i in found]
    return out
