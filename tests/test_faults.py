"""What goes wrong: writers that die, tables out of service, numbers that doubles don't tell apart, streams that are replayed."""

import datetime
import itertools
import random

import pytest

from itemloom import errors as E
from itemloom.functions import evaluate
from itemloom.functions.values import text_of
from itemloom.operators.api import Engine
from itemloom.plans import compile as C
from itemloom.plans import expressions as X
from itemloom.plans.binding import ItemBinding
from itemloom.sources import ddl, store
from itemloom.streaming.upsert import upsert

S = lambda x: {"S": x}
N = lambda x: {"N": str(x)}
BOOKS = {"TableName": "books", "KeySchema": [{"AttributeName": "isbn", "KeyType": "HASH"}], "AttributeDefinitions": [{"AttributeName": "isbn", "AttributeType": "S"}]}


@pytest.fixture()
def db(spark, tmp_path):
    db = Engine(spark, str(tmp_path / "warehouse"))
    db.execute("CreateTable", BOOKS)
    db.execute("PutItem", {"TableName": "books", "Item": {"isbn": S("b1"), "copies": N(2)}})
    return db


def copies(db, isbn):
    return db.execute("GetItem", {"TableName": "books", "Key": {"isbn": S(isbn)}}).get("Item", {}).get("copies")


def test_a_writer_that_dies_after_its_lock_has_committed(db, monkeypatch):
    before = db.store.state()
    with monkeypatch.context() as m:
        m.setattr(store.Warehouse, "_settled", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            db.store.commit(before, {**before.tables, "marked": before.tables["books"]})
    after = db.store.state()
    assert after.version == before.version + 1 and set(after.tables) == {"books", "marked"}
    db.execute("PutItem", {"TableName": "books", "Item": {"isbn": S("b2"), "copies": N(5)}})
    assert copies(db, "b2") == N(5) and copies(db, "b1") == N(2)


def test_a_lock_that_names_nothing_is_taken_away_when_it_is_old(db, monkeypatch):
    number = db.store.state().version + 1
    db.store._fs.create(db.store._lock(number), False).close()
    with pytest.raises(E.CommitConflict):
        db.execute("PutItem", {"TableName": "books", "Item": {"isbn": S("b3"), "copies": N(1)}})
    monkeypatch.setattr(store, "GRACE", 0)
    db.execute("PutItem", {"TableName": "books", "Item": {"isbn": S("b3"), "copies": N(1)}})
    assert copies(db, "b3") == N(1) and db.store.state().version == number


def test_lost_races_cancel_a_transaction(db, monkeypatch):
    real = store.Warehouse.commit

    def late(self, state, tables):
        real(self, state, state.tables)
        return real(self, state, tables)

    monkeypatch.setattr(store.Warehouse, "commit", late)
    put = {"Put": {"TableName": "books", "Item": {"isbn": S("b4")}}}
    with pytest.raises(E.TransactionCanceled) as failed:
        db.execute("TransactWriteItems", {"TransactItems": [put]})
    assert [r["Code"] for r in failed.value.reasons] == ["TransactionConflict"]
    with pytest.raises(E.CommitConflict):
        db.execute("PutItem", {"TableName": "books", "Item": {"isbn": S("b4")}})


def test_storage_failures_cancel_a_transaction(db, monkeypatch):
    monkeypatch.setattr(store.Warehouse, "write_delta", lambda *_: 1 / 0)
    with pytest.raises(E.TransactionCanceled) as failed:
        db.execute("TransactWriteItems", {"TransactItems": [{"Put": {"TableName": "books", "Item": {"isbn": S("b4")}}}]})
    assert failed.value.reasons[0]["Code"] == "InternalServerError" and copies(db, "b4") is None


def test_no_operation_uses_a_table_out_of_service(db):
    path = db.store.state().table("books").deltas[0]
    db.store._fs.rename(db.store._path(path), db.store._path(path + ".away"))
    assert list(db.reconcile()) == ["books"]
    key, item = {"isbn": S("b1")}, {"isbn": S("b9")}
    requests = [
        ("GetItem", {"TableName": "books", "Key": key}), ("PutItem", {"TableName": "books", "Item": item}), ("DeleteItem", {"TableName": "books", "Key": key}),
        ("UpdateItem", {"TableName": "books", "Key": key, "UpdateExpression": "REMOVE copies"}), ("Scan", {"TableName": "books"}),
        ("Query", {"TableName": "books", "KeyConditionExpression": "isbn = :k", "ExpressionAttributeValues": {":k": S("b1")}}),
        ("BatchGetItem", {"RequestItems": {"books": {"Keys": [key]}}}), ("BatchWriteItem", {"RequestItems": {"books": [{"PutRequest": {"Item": item}}]}}),
        ("TransactGetItems", {"TransactItems": [{"Get": {"TableName": "books", "Key": key}}]}),
        ("UpdateTable", {"TableName": "books", "BillingMode": "PAY_PER_REQUEST"}),
    ]
    for operation, request in requests:
        with pytest.raises(E.ResourceNotFound):
            db.execute(operation, request)
    with pytest.raises(E.TransactionCanceled) as failed:
        db.execute("TransactWriteItems", {"TransactItems": [{"Put": {"TableName": "books", "Item": item}}]})
    assert failed.value.reasons[0]["Code"] == "ResourceNotFound"
    assert db.execute("DescribeTable", {"TableName": "books"})["Table"]["TableName"] == "books"


def test_an_index_without_its_columns_is_out_of_service_alone(db):
    db.execute("UpdateTable", {"TableName": "books", "AttributeDefinitions": [{"AttributeName": "copies", "AttributeType": "N"}], "GlobalSecondaryIndexUpdates": [{"Create": {"IndexName": "by_copies", "KeySchema": [{"AttributeName": "copies", "KeyType": "HASH"}]}}]})
    old = db.store.state().table("books")
    bare = db.store.write_base(db.store.read(old).drop("ix_by_copies_pk"), "books")
    db.store.change(lambda s: {**s.tables, "books": store.TableState(old.schema, bare, [], old.status, old.info)})
    assert list(db.reconcile()) == ["books/by_copies"] and copies(db, "b1") == N(2)
    with pytest.raises(E.ResourceNotFound):
        db.execute("Scan", {"TableName": "books", "IndexName": "by_copies"})
    db.store.change(lambda s: {**s.tables, "books": store.TableState(s.table("books").schema, old.base, old.deltas, old.status, old.info)})
    assert db.reconcile() == {} and len(db.execute("Scan", {"TableName": "books", "IndexName": "by_copies"})["Items"]) == 1


def test_deleted_data_goes(db, monkeypatch):
    files = db.store.state().table("books").deltas
    monkeypatch.setattr(store, "GRACE", -1)
    db.execute("DeleteTable", {"TableName": "books"})
    assert not any(db.store._fs.exists(db.store._path(f)) for f in files)


def test_projections_are_told_and_definitions_checked(db):
    add = lambda name, attribute, **more: {"TableName": "books", "AttributeDefinitions": [{"AttributeName": attribute, "AttributeType": "S"}], "GlobalSecondaryIndexUpdates": [{"Create": {"IndexName": name, "KeySchema": [{"AttributeName": attribute, "KeyType": "HASH"}], **more}}]}
    include = {"ProjectionType": "INCLUDE", "NonKeyAttributes": ["copies"]}
    told = db.execute("UpdateTable", add("by_title", "title", Projection=include))["TableDescription"]["GlobalSecondaryIndexes"][0]
    assert told["Projection"] == include and db.execute("DescribeTable", {"TableName": "books"})["Table"]["GlobalSecondaryIndexes"][0]["Projection"] == include
    unused = add("by_shelf", "shelf")
    unused["AttributeDefinitions"].append({"AttributeName": "other", "AttributeType": "S"})
    for bad in (unused, add("BY_TITLE", "shelf"), add("by_shelf", "shelf", Projection={"ProjectionType": "INCLUDE"}), {"TableName": "books", "GlobalSecondaryIndexUpdates": ["x"]}, {"TableName": "books", "GlobalSecondaryIndexUpdates": [{"Create": 1}]}):
        with pytest.raises(E.ValidationError):
            db.execute("UpdateTable", bad)
    for bad in ({"KeySchema": ["isbn"]}, {"AttributeDefinitions": ["isbn"]}, {"GlobalSecondaryIndexes": [1]}):
        with pytest.raises(E.ValidationError):
            ddl.create({**BOOKS, **bad})


def test_conditional_deletes(db):
    gone = {"TableName": "books", "Key": {"isbn": S("b1")}, "ExpressionAttributeValues": {":n": N(2)}}
    with pytest.raises(E.ConditionalCheckFailed):
        db.execute("DeleteItem", {**gone, "ConditionExpression": "copies > :n"})
    assert copies(db, "b1") == N(2)
    assert db.execute("DeleteItem", {**gone, "ConditionExpression": "copies = :n", "ReturnValues": "ALL_OLD"})["Attributes"]["copies"] == N(2) and copies(db, "b1") is None


NUMBERS = ["9007199254740992", "9007199254740993", "9007199254740993.00000000000000000001", "0.1", "0.10000000000000000000001", "-1e-30", "-1.0000000000000000000000000000000000001e-30", "1E+37", "10000000000000000000000000000000000001", "0", "-0", "0.0", "12345678901234567890123456789012345678", "12345678901234567890123456789012345677", "1e120", "-5", " 7"]


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
def test_numbers_of_items_are_compared_by_all_digits(spark, op):
    items = [{"a": N(x), "b": N(y)} for x, y in itertools.product(NUMBERS, NUMBERS)] + [{"a": S("1"), "b": S("\\\\2")}, {"a": S("1"), "b": N(2)}, {"b": N(1)}]
    df = spark.createDataFrame([(i, {k: text_of(v) for k, v in x.items()}) for i, x in enumerate(items)], "i int, item map<string,string>").coalesce(1)
    conditions = [X.condition(f"a {op} b", None, None), *(X.condition(f"a {op} :v", None, {":v": N(v)}) for v in NUMBERS[::3])]
    rows = df.select("i", *[C.truth(c, ItemBinding()).alias(f"c{j}") for j, c in enumerate(conditions)]).collect()
    for r in rows:
        assert [r[f"c{j}"] for j in range(len(conditions))] == [evaluate.holds(c, items[r.i]) for c in conditions], items[r.i]


def test_strings_of_items_with_escapes(spark):
    texts = ["", "a", 'a"b', "a\\b", "a\nb", "\\", "\\n", "n", "é ", "日本", "a\tb"]
    items = [{"a": S(x), "b": {"L": [S(x)]}, "c": {"SS": [x]}} for x in texts]
    df = spark.createDataFrame([(i, {k: text_of(v) for k, v in x.items()}) for i, x in enumerate(items)], "i int, item map<string,string>").coalesce(1)
    conditions = [X.condition(e, None, {":v": S(v)}) for v in texts for e in ("a = :v", "begins_with(a, :v)", "contains(a, :v)", "a < :v", "contains(b, :v)", "contains(c, :v)", "attribute_type(a, :v)")]
    rows = df.select("i", *[C.truth(c, ItemBinding()).alias(f"c{j}") for j, c in enumerate(conditions)]).collect()
    for r in rows:
        for j, c in enumerate(conditions):
            assert r[f"c{j}"] == evaluate.holds(c, items[r.i]), (items[r.i], c)


def changes(spark, rows, kind):
    return spark.createDataFrame([(o, {"isbn": text_of(S(k)), "copies": text_of(N(n))}) for o, k, n in rows], f"o {kind}, item map<string,string>").repartition(3)


@pytest.mark.parametrize("kind,orders", [("long", [2**53, 2**53 + 1, 2**53 - 1]), ("timestamp", [datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 1, 0, 0, 0, 1), datetime.datetime(2023, 1, 1)]), ("string", ["b", "c", "a"])])
def test_streamed_changes_are_ordered_in_their_own_type(db, spark, kind, orders):
    rows = [(o, "s1", i) for i, o in enumerate(orders)]
    random.Random(1).shuffle(rows)
    upsert(db.store, "books", "o")(changes(spark, rows, kind), 0)
    assert copies(db, "s1") == N(1)


def test_a_batch_that_is_delivered_again_changes_nothing(db, spark):
    write, batch = upsert(db.store, "books", "o"), changes(spark, [(1, "s1", 1)], "long")
    write(batch, 7)
    db.execute("PutItem", {"TableName": "books", "Item": {"isbn": S("s1"), "copies": N(99)}})
    version = db.store.state().version
    write(batch, 7)
    assert copies(db, "s1") == N(99) and db.store.state().version == version
    write(changes(spark, [(2, "s1", 3)], "long"), 8)
    assert copies(db, "s1") == N(3)
    with pytest.raises(E.ValidationError):
        upsert(db.store, "books", "nothing", "another")(batch, 0)
