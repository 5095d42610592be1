"""The registered queries of the item engine, each with the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.errors import ConditionalCheckFailed, ItemError, ResourceNotFound, TransactionCanceled
from itemloom.operators.api import Engine
from itemloom.operators.frame import Table, values
from itemloom.plans import compile as C
from itemloom.plans import expressions as X
from itemloom.plans.binding import ItemBinding
from itemloom.tables import open_table, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, sql: str, table: str, build: Callable[[Table], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(open_table(spark, sf_dir, table))
    ORACLE_SQL[name] = sql


V = values
EVENTS = "event_id, user_id, event_type, value"
LABELLED = "(SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
LABEL_COLUMNS = "doc_id, #l, n_chars, quality, toxic"
BARE_COLUMNS = "doc_id, #l, n_chars"
NL = {"#l": "lang"}

# ---------------------------------------------------------------- keyed reads

def _get_item(t: Table) -> DataFrame:
    key = t.df.orderBy("o_orderkey", "o_custkey").select("o_custkey", "o_orderkey").first()
    return t.get(V(o_custkey=key.o_custkey, o_orderkey=key.o_orderkey))


_add("get_item", "SELECT * FROM orders ORDER BY o_orderkey, o_custkey LIMIT 1", "cust_orders", _get_item)
_add("get_item_hash_only", "SELECT * FROM customer WHERE c_custkey = 77", "customers", lambda t: t.get(V(c_custkey=77)))

def _batch_get(t: Table) -> DataFrame:
    """The keys of five events, whoever their users are, and as many of users that don't exist."""
    keys = t.df.where(F.col("event_id").isin(5, 40, 77, 123, 500)).select(F.explode(F.array("user_id", -1 - F.col("user_id"))).alias("user_id"), "event_id")
    return t.batch_get(keys).select(*EVENTS.split(", "))


_add("batch_get", f"SELECT {EVENTS} FROM events WHERE (user_id, event_id) IN (SELECT user_id, event_id FROM events WHERE event_id IN (5, 40, 77, 123, 500)) AND event_id IN (5, 40, 77, 123, 500)", "user_events", _batch_get)
_add("batch_get_hash_only", "SELECT * FROM customer WHERE c_custkey IN (1, 5, 9, 100000000)", "customers", lambda t: t.batch_get([V(c_custkey=k) for k in (1, 5, 9, 100000000)]))
_add("transact_get", "SELECT ord, c_name, c_mktsegment FROM (VALUES (0, 5), (1, -3), (2, 1)) k(ord, id) LEFT JOIN customer c ON c.c_custkey = k.id", "customers", lambda t: t.transact_get([V(c_custkey=k) for k in (5, -3, 1)]).select("ord", "c_name", "c_mktsegment"))

# ---------------------------------------------------------------- key conditions

_add("query_pk", f"SELECT {EVENTS} FROM events WHERE user_id = 12", "user_events", lambda t: t.query("user_id = :u", values=V(u=12), projection=EVENTS.replace("value", "#v"), names={"#v": "value"}))
for _name, _op in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _add(f"query_sk_{_name}", f"SELECT {EVENTS} FROM events WHERE user_id = 12 AND event_id {_op} 300", "user_events",
         lambda t, op=_op: t.query(f"user_id = :u AND event_id {op} :e", values=V(u=12, e=300), projection=EVENTS.replace("value", "#v"), names={"#v": "value"}))
_add("query_sk_between", f"SELECT {EVENTS} FROM events WHERE user_id = 12 AND event_id BETWEEN 100 AND 700", "user_events", lambda t: t.query("user_id = :u AND event_id BETWEEN :a AND :b", values=V(u=12, a=100, b=700), projection=EVENTS.replace("value", "#v"), names={"#v": "value"}))
_add("query_sk_mirrored", f"SELECT {EVENTS} FROM events WHERE user_id = 12 AND event_id > 300", "user_events", lambda t: t.query(":u = user_id AND :e < event_id", values=V(u=12, e=300), projection=EVENTS.replace("value", "#v"), names={"#v": "value"}))


def _sk_eq(t: Table) -> DataFrame:
    e = t.df.orderBy("event_id").first()
    return t.query("user_id = :u AND event_id = :e", values=V(u=e.user_id, e=e.event_id), projection=EVENTS.replace("value", "#v"), names={"#v": "value"})


def _sk_begins_with(t: Table) -> DataFrame:
    nation = t.df.where("c_name = 'Customer#000000011'").first().c_nationkey
    return t.query("c_nationkey = :n AND begins_with(c_name, :p)", values=V(n=nation, p="Customer#00000001"))


_add("query_sk_eq", f"SELECT {EVENTS} FROM events ORDER BY event_id LIMIT 1", "user_events", _sk_eq)
_add("query_sk_begins_with", "SELECT * FROM customer WHERE c_nationkey = (SELECT c_nationkey FROM customer WHERE c_name = 'Customer#000000011') AND starts_with(c_name, 'Customer#00000001')", "nation_customers", _sk_begins_with)
_add("query_desc_limit", f"SELECT {EVENTS} FROM events WHERE user_id = 12 ORDER BY event_id DESC LIMIT 10", "user_events", lambda t: t.query("user_id = :u", values=V(u=12), forward=False, limit=10, projection=EVENTS.replace("value", "#v"), names={"#v": "value"}))
_add("query_filtered", f"SELECT {EVENTS} FROM events WHERE user_id = 12 AND event_type IN ('click', 'view') AND value > 10", "user_events",
     lambda t: t.query("user_id = :u", filter="event_type IN (:x, :y) AND #v > :v", values=V(u=12, x="click", y="view", v=10), names={"#v": "value"}, projection=EVENTS.replace("value", "#v")))

# ---------------------------------------------------------------- limits and paging

_add("query_limit_then_filter", f"SELECT {EVENTS} FROM (SELECT * FROM events WHERE user_id = 12 ORDER BY event_id LIMIT 20) WHERE event_type = 'view'", "user_events",
     lambda t: t.query("user_id = :u", filter="event_type = :t", limit=20, values=V(u=12, t="view"), names={"#v": "value"}, projection=EVENTS.replace("value", "#v")))
_add("query_count", "SELECT count(*) FILTER (event_type = 'view') AS \"count\", count(*) AS scanned_count FROM (SELECT * FROM events WHERE user_id = 12 ORDER BY event_id LIMIT 20)", "user_events",
     lambda t: t.counted(t.query("user_id = :u", limit=20, values=V(u=12)), "event_type = :t", values=V(t="view")))
_add("query_page2", "SELECT * FROM orders WHERE o_custkey = 370 AND o_orderkey > 1 ORDER BY o_orderkey LIMIT 5", "cust_orders", lambda t: t.query("o_custkey = :c", values=V(c=370), start=V(o_custkey=370, o_orderkey=1), limit=5))
_add("query_page2_desc", "SELECT * FROM orders WHERE o_custkey = 370 AND o_orderkey < 9000 ORDER BY o_orderkey DESC LIMIT 5", "cust_orders", lambda t: t.query("o_custkey = :c", values=V(c=370), start=V(o_custkey=370, o_orderkey=9000), forward=False, limit=5))
_add("scan_page1", "SELECT * FROM orders ORDER BY o_custkey, o_orderkey LIMIT 25", "cust_orders", lambda t: t.scan(limit=25))
_add("scan_page2", "SELECT * FROM orders WHERE o_custkey > 40 OR (o_custkey = 40 AND o_orderkey > 500) ORDER BY o_custkey, o_orderkey LIMIT 25", "cust_orders", lambda t: t.scan(start=V(o_custkey=40, o_orderkey=500), limit=25))
_add("scan_limit_then_filter", "SELECT * FROM (SELECT * FROM orders ORDER BY o_custkey, o_orderkey LIMIT 200) WHERE o_totalprice > 200000", "cust_orders", lambda t: t.scan(filter="o_totalprice > :p", values=V(p=200000), limit=200))
_add("scan_count", "SELECT count(*) FILTER (o_orderstatus = 'F') AS \"count\", count(*) AS scanned_count FROM orders", "cust_orders", lambda t: t.counted(t.scan(), "o_orderstatus = :s", values=V(s="F")))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = open_table(spark, sf_dir, "cust_orders")
    parts = [t.scan(segment=i, segments=4).select("o_custkey", "o_orderkey") for i in range(4)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


QUERIES["scan_segments"] = _segments
ORACLE_SQL["scan_segments"] = "SELECT o_custkey, o_orderkey FROM orders"

# ---------------------------------------------------------------- filters


def _filter(name: str, where: str, sql: str, table: str = "cust_orders", of: str = "o_orderkey, o_custkey, o_totalprice", source: str = "orders", names: dict | None = None, projection: str | None = None, **given: object) -> None:
    _add(name, f"SELECT {of} FROM {source} WHERE {sql}", table, lambda t: t.scan(filter=where, values=V(**given), names=names, projection=projection or of))


_filter("scan_filter_cmp", "o_totalprice >= :p AND o_orderstatus <> :s", "o_totalprice >= 150000 AND o_orderstatus <> 'O'", p=150000, s="O")
_filter("scan_filter_between", "o_totalprice BETWEEN :a AND :b", "o_totalprice BETWEEN 100000 AND 120000.5", a=100000, b=120000.5)
_filter("scan_filter_in", "o_orderpriority IN (:a, :b)", "o_orderpriority IN ('1-URGENT', '5-LOW')", a="1-URGENT", b="5-LOW")
_filter("scan_filter_in_numbers", "o_custkey IN (:a, :b, :c)", "o_custkey IN (3, 40, 370)", a=3, b=40, c=370)
_filter("scan_filter_begins_with", "begins_with(o_orderpriority, :p)", "starts_with(o_orderpriority, '2')", p="2")
_filter("scan_filter_contains", "contains(#t, :p)", "contains(text, 'rights reserved')", "docs", "doc_id, lang", "documents", {"#t": "text", **NL}, "doc_id, #l", p="rights reserved")
_filter("scan_filter_fraction", "o_custkey > :x AND o_custkey <= :y", "o_custkey > 99.5 AND o_custkey <= 120.7", x=99.5, y=120.7)
_filter("scan_filter_type_mismatch", "o_totalprice <> :s AND NOT o_custkey = :s", "o_totalprice IS NOT NULL", s="x")
_filter("scan_filter_paths", "l_extendedprice < l_quantity OR l_discount = l_tax", "l_extendedprice < l_quantity OR l_discount = l_tax", "lines", "l_orderkey, l_linenumber, l_discount", "lineitem")
_filter("scan_filter_lineitem_in", "l_returnflag IN (:a, :b) AND l_quantity < :q", "l_returnflag IN ('A', 'R') AND l_quantity < 5", "lines", "l_orderkey, l_linenumber, l_quantity", "lineitem", a="A", b="R", q=5)
_filter("scan_attr_exists", "attribute_exists(quality)", "quality IS NOT NULL", "doc_labels", "doc_id, lang, n_chars, quality, toxic", LABELLED, NL, LABEL_COLUMNS)
_filter("scan_filter_type", "attribute_type(quality, :n) AND NOT attribute_type(#l, :n) AND attribute_type(#l, :s)", "quality IS NOT NULL", "doc_labels", "doc_id, lang, n_chars, quality, toxic", LABELLED, NL, LABEL_COLUMNS, n="N", s="S")
_filter("scan_attr_not_exists", "attribute_not_exists(quality)", "quality IS NULL", "doc_labels", "doc_id, lang, n_chars", LABELLED, NL, "doc_id, #l, n_chars")
_filter("scan_unknown_attr", "attribute_not_exists(nothing) AND NOT nothing = :v", "true", "doc_labels", "doc_id, lang, n_chars", LABELLED, NL, "doc_id, #l, n_chars", v=1)
_filter("scan_not_missing", "NOT quality = :v", "quality IS NULL OR quality <> 1", "doc_labels", "doc_id, lang, n_chars", LABELLED, NL, BARE_COLUMNS, v=1)
_filter("scan_ne_missing", "quality <> :v", "quality <> 1", "doc_labels", "doc_id, lang, n_chars, quality, toxic", LABELLED, NL, LABEL_COLUMNS, v=1)
_filter("scan_bool_nested", "NOT (quality = :o OR n_chars < :n AND toxic = :z) AND #l <> :e", "NOT (coalesce(quality = 1, false) OR (n_chars < 900 AND coalesce(toxic = 0, false))) AND lang <> 'en'", "doc_labels", "doc_id, lang, n_chars", LABELLED, NL, BARE_COLUMNS, o=1, n=900, z=0, e="en")
_filter("scan_not_between", "NOT quality BETWEEN :a AND :b", "quality IS NULL OR NOT (quality BETWEEN 1 AND 3)", "doc_labels", "doc_id, lang, n_chars", LABELLED, NL, BARE_COLUMNS, a=1, b=3)
_filter("scan_not_in", "NOT toxic IN (:a, :b)", "toxic IS NULL OR toxic NOT IN (1, 2)", "doc_labels", "doc_id, lang, n_chars", LABELLED, NL, BARE_COLUMNS, a=1, b=2)
_filter("project_subset", "o_orderstatus = :s", "o_orderstatus = 'P'", of="o_orderkey, o_orderstatus", s="P")
_add("select_count", "SELECT count(*) AS \"count\", count(*) AS scanned_count FROM events WHERE user_id = 12", "user_events", lambda t: t.counted(t.query("user_id = :u", values=V(u=12))))
_add("list_contains_elem", "SELECT vec_id, label FROM embeddings WHERE list_contains(embedding, 0.25::FLOAT) OR label = 3", "vectors", lambda t: t.scan(filter="contains(embedding, :x) OR label = :l", values=V(x=0.25, l=3), projection="vec_id, label"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with their labels as schemaless items."""
    df = open_table(spark, sf_dir, "doc_labels").df
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select("doc_id", C.item_of({n: F.col(n) for n in df.columns}, types).alias("item"))


def _item_filter(name: str, where: str, sql: str, **given: object) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = C.condition(X.condition(where, NL, V(**given)), ItemBinding())
        return _items(spark, sf_dir).where(c).select("doc_id", F.get_json_object(F.try_element_at("item", F.lit("n_chars")), "$.N").cast("long").alias("n_chars"))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT doc_id, n_chars FROM {LABELLED} WHERE {sql}"


_item_filter("item_filter_not_missing", "NOT quality = :v AND n_chars > :n", "(quality IS NULL OR quality <> 1) AND n_chars > 700", v=1, n=700)
_item_filter("item_filter_nested", "attribute_type(quality, :t) OR begins_with(#l, :d) AND NOT contains(#l, :s)", "quality IS NOT NULL OR (starts_with(lang, 'd') AND NOT contains(lang, 's'))", t="N", d="d", s="s")
_item_filter("item_filter_between_in", "n_chars BETWEEN :a AND :b AND #l IN (:x, :y)", "n_chars BETWEEN 500 AND 2000 AND lang IN ('en', 'fr')", a=500, b=2000, x="en", y="fr")

# ---------------------------------------------------------------- indexes

_add("lsi_range", "SELECT * FROM orders WHERE o_custkey = 370 AND o_totalprice > 100000", "cust_orders", lambda t: t.query("o_custkey = :c AND o_totalprice > :p", index="by_price", values=V(c=370, p=100000)))
_add("lsi_desc_limit", "SELECT * FROM customer WHERE c_nationkey = 7 ORDER BY c_acctbal DESC, c_name DESC LIMIT 5", "nation_customers", lambda t: t.query("c_nationkey = :n", index="by_balance", forward=False, limit=5, values=V(n=7)))
_add("gsi_eq", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'", "customers", lambda t: t.query("c_mktsegment = :s", index="by_segment", values=V(s="BUILDING")))
_add("gsi_range_desc", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0 ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 20", "customers", lambda t: t.query("c_mktsegment = :s AND c_acctbal >= :z", index="by_segment", forward=False, limit=20, values=V(s="BUILDING", z=0)))
_add("gsi_hash_only", "SELECT conv_id, turn, role FROM conversations WHERE role = 'user' ORDER BY conv_id, turn LIMIT 30", "turns", lambda t: t.query("#r = :r", index="by_role", limit=30, values=V(r="user"), names={"#r": "role"}, projection="conv_id, turn, #r"))
_add("gsi_hash_only_page2", "SELECT conv_id, turn, role FROM conversations WHERE role = 'user' AND (conv_id > 10 OR (conv_id = 10 AND turn > 2)) ORDER BY conv_id, turn LIMIT 30", "turns",
     lambda t: t.query("#r = :r", index="by_role", limit=30, start=V(role="user", conv_id=10, turn=2), values=V(r="user"), names={"#r": "role"}, projection="conv_id, turn, #r"))
_add("gsi_sparse_scan", f"SELECT doc_id, quality FROM {LABELLED} WHERE quality IS NOT NULL", "doc_labels", lambda t: t.scan(index="by_quality", projection="doc_id, quality"))
_add("gsi_page2_ties", "SELECT * FROM part WHERE p_brand = 'Brand#11' AND (p_size > 10 OR (p_size = 10 AND p_partkey > 50)) ORDER BY p_size, p_partkey LIMIT 10", "parts",
     lambda t: t.query("p_brand = :b", index="by_brand", values=V(b="Brand#11"), start=V(p_brand="Brand#11", p_size=10, p_partkey=50), limit=10))
_add("gsi_filtered", "SELECT doc_id, n_chars FROM documents WHERE lang = 'de' AND n_chars < 2000 AND source <> 'src0'", "docs", lambda t: t.query("#l = :l AND n_chars < :n", filter="#s <> :s", index="by_lang", names={"#l": "lang", "#s": "source"}, values=V(l="de", n=2000, s="src0"), projection="doc_id, n_chars"))


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = open_table(spark, sf_dir, "customers")
    wrong = F.when(F.col("c_custkey") % 10 == 0, F.lit(None)).otherwise(F.col("c_mktsegment"))
    return t.drift(t.df.withColumn("segment_key", wrong), {"segment_key": F.col("c_mktsegment")})


QUERIES["gsi_drift_check"], ORACLE_SQL["gsi_drift_check"] = _drift, "SELECT count(*) FILTER (c_custkey % 10 = 0) AS mismatches, count(*) AS checked FROM customer"

# ---------------------------------------------------------------- updates


def _update(name: str, expression: str, sql: str, where: str | None = None, table: str = "cust_orders", of: str = "o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority", names: dict | None = None, **given: object) -> None:
    _add(name, sql, table, lambda t: t.update(expression, where, names, V(**given)).df.select(*of.split(", ")))


_BASE = "o_orderkey, o_custkey"
_update("update_set_literal", "SET o_orderstatus = :s", f"SELECT {_BASE}, o_totalprice, CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders", "o_totalprice > :p", s="X", p=200000)
_update("update_copy", "SET o_orderpriority = o_orderstatus", f"SELECT {_BASE}, o_totalprice, o_orderstatus, o_orderstatus AS o_orderpriority FROM orders")
_update("update_swap", "SET o_orderstatus = o_orderpriority, o_orderpriority = o_orderstatus", f"SELECT {_BASE}, o_totalprice, o_orderpriority AS o_orderstatus, o_orderstatus AS o_orderpriority FROM orders")
_update("update_arith", "SET l_quantity = l_quantity + :one, l_discount = l_discount - l_tax", "SELECT l_orderkey, l_linenumber, l_quantity + 1 AS l_quantity, l_discount - l_tax AS l_discount FROM lineitem", None, "lines", "l_orderkey, l_linenumber, l_quantity, l_discount", one=1)
_update("update_if_not_exists", "SET quality = if_not_exists(quality, :d)", f"SELECT doc_id, coalesce(quality, 7) AS quality FROM {LABELLED}", None, "doc_labels", "doc_id, quality", d=7)
_update("update_remove", "REMOVE o_orderpriority", f"SELECT {_BASE}, o_totalprice, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders", "o_orderstatus = :f", f="F")
_update("update_add_number", "ADD quality :n", f"SELECT doc_id, coalesce(quality, 0) + 5 AS quality FROM {LABELLED}", None, "doc_labels", "doc_id, quality", n=5)
_add("update_conditional", f"SELECT doc_id, coalesce(CASE WHEN quality IS NULL OR quality <> 1 THEN 9 ELSE toxic END, -1) AS toxic, coalesce(CASE WHEN quality = 1 THEN quality END, -1) AS quality FROM {LABELLED}", "doc_labels",
     lambda t: t.update("SET toxic = :n REMOVE quality", "NOT quality = :o", values=V(n=9, o=1)).df.select("doc_id", F.coalesce("toxic", F.lit(-1)).alias("toxic"), F.coalesce("quality", F.lit(-1)).alias("quality")))
_update("update_lineitem_arith", "SET l_extendedprice = l_extendedprice - :d", "SELECT l_orderkey, l_linenumber, l_extendedprice - CASE WHEN l_returnflag = 'A' THEN 10 ELSE 0 END AS l_extendedprice FROM lineitem", "l_returnflag = :a", "lines", "l_orderkey, l_linenumber, l_extendedprice", d=10, a="A")
_add("update_list_append", "SELECT vec_id, len(embedding) + 2 AS n, 0.5::FLOAT AS last FROM embeddings", "vectors",
     lambda t: t.update("SET embedding = list_append(embedding, :l)", values=V(l=[0.25, 0.5])).df.select("vec_id", F.size("embedding").cast("long").alias("n"), F.element_at("embedding", -1).alias("last")))


def _sets(spark: SparkSession, sf_dir: str) -> Table:
    """The parts with the words of their names as a string set."""
    from itemloom.plans.keys import Key, TableSchema

    df = read(spark, sf_dir, "part").select("p_partkey", F.array_distinct(F.split("p_name", " ")).alias("words"))
    return Table(df, TableSchema("tagged", Key("p_partkey", "N")), {"words": "SS"})


def _set_query(name: str, expression: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        done = _sets(spark, sf_dir).update(expression, values={"w": {"SS": ["zzz", "Part", "part"]}}).df
        return done.select("p_partkey", F.array_join(F.array_sort("words"), "|").alias("words"))

    QUERIES[name], ORACLE_SQL[name] = run, sql


_set_query("update_add_set", "ADD words :w", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(string_split(p_name, ' '), ['zzz', 'Part', 'part']))), '|') AS words FROM part")
_set_query("update_delete_set", "DELETE words :w", "SELECT p_partkey, CASE WHEN len(w) > 0 THEN array_to_string(list_sort(w), '|') END AS words FROM (SELECT p_partkey, list_filter(list_distinct(string_split(p_name, ' ')), lambda x: x NOT IN ('zzz', 'Part', 'part')) AS w FROM part)")


def _item_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same update on schemaless items, with 38 digits of precision."""
    u = X.update("SET total = n_chars + :h, grade = if_not_exists(quality, :z) REMOVE toxic ADD seen :one", None, V(h=0.5, z=-1, one=1))
    c = X.condition("#l = :l", NL, V(l="fr"))
    n = lambda name: F.get_json_object(F.try_element_at("item", F.lit(name)), "$.N").cast("double").alias(name)
    return _items(spark, sf_dir).withColumn("item", C.item_update("item", u, c)).select("doc_id", n("total"), n("grade"), n("seen"), n("toxic"))


QUERIES["item_update"] = _item_update
ORACLE_SQL["item_update"] = f"SELECT doc_id, CASE WHEN lang = 'fr' THEN n_chars + 0.5 END::DOUBLE AS total, CASE WHEN lang = 'fr' THEN coalesce(quality, -1) END::DOUBLE AS grade, CASE WHEN lang = 'fr' THEN 1 END::DOUBLE AS seen, CASE WHEN lang <> 'fr' THEN toxic END::DOUBLE AS toxic FROM {LABELLED}"

# ---------------------------------------------------------------- puts and deletes

_ORDERS = "o_orderkey, o_custkey, o_totalprice, o_orderstatus"
_add("put_overlay", f"SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders", "cust_orders",
     lambda t: t.put(t.df.where("o_orderkey % 10 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2)).df.select(*_ORDERS.split(", ")))
_add("delete_keys", "SELECT * FROM customer WHERE c_custkey NOT IN (1, 5, 9)", "customers", lambda t: t.delete([V(c_custkey=k) for k in (1, 5, 9)]).df)
_add("batch_write", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (2, 3) UNION ALL SELECT 2, 'new', 1.5", "customers",
     lambda t: t.write(t.df.where("c_custkey = 2").withColumn("c_name", F.lit("new")).withColumn("c_acctbal", F.lit(1.5)), [V(c_custkey=3)], small=True).df.select("c_custkey", "c_name", "c_acctbal"))
_add("bulk_load_latest", "SELECT user_id, event_id, event_type, value FROM events", "user_events",
     lambda t: t.latest(t.df.withColumn("seq", F.lit(1)).unionByName(t.df.withColumn("seq", F.lit(0)).withColumn("value", F.lit(-1.0))), "seq").df.select("user_id", "event_id", "event_type", "value"))

# ---------------------------------------------------------------- the item API


def _folder(spark: SparkSession, kind: str) -> str:
    """A new path, where all executors can write: beside the checkpoints, or in local runs without such a folder a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{base or tempfile.mkdtemp(prefix='itemloom-')}/{kind}-{uuid.uuid4().hex}"


def _warehouse(spark: SparkSession) -> str:
    return _folder(spark, "warehouse")


def _key_schema(pk: str, sk: str | None = None) -> list[dict]:
    return [{"AttributeName": pk, "KeyType": "HASH"}] + ([{"AttributeName": sk, "KeyType": "RANGE"}] if sk else [])


def _defined(**kinds: str) -> list[dict]:
    return [{"AttributeName": n, "AttributeType": k} for n, k in kinds.items()]


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine with the customers as items of the table `clients`."""
    db = Engine(spark, _warehouse(spark))
    db.execute("CreateTable", {"TableName": "clients", "KeySchema": _key_schema("c_custkey"), "AttributeDefinitions": _defined(c_custkey="N")})
    df = open_table(spark, sf_dir, "customers").df
    db.store.load("clients", df.select(C.item_of({n: F.col(n) for n in df.columns}, {f.name: f.dataType for f in df.schema.fields}).alias("item")))
    return db


def _stored(db: Engine, table: str, **kinds: str) -> DataFrame:
    """Attributes of all items as columns."""
    b = ItemBinding("item")
    return db.store.read(db.store.state().table(table)).select(*[b.body(n, "N" if k != "string" else "S").cast(k).alias(n) for n, k in kinds.items()])


def _plain_rows(items: Iterable[dict], ddl: str) -> Iterator[tuple]:
    """Returned items as rows; numbers are read as what ddl says."""
    kinds = [f.split(" ") for f in ddl.split(", ")]

    def one(v: dict | None, kind: str) -> object:
        body = None if v is None else next(iter(v.values()))
        return body if body is None or kind == "string" else float(body) if kind == "double" else int(body)

    return (tuple(one(i.get(n), k) for n, k in kinds) for i in items)


def _plain_items(spark: SparkSession, items: Iterable[dict], ddl: str) -> DataFrame:
    """A few returned items."""
    return spark.createDataFrame(list(_plain_rows(items, ddl)), ddl)


#: Rows that are held here until they are written.
HELD = 50_000


def _written(spark: SparkSession, items: Iterable[dict], ddl: str) -> DataFrame:
    """Any number of returned items: they go to files, HELD at a time."""
    at, rows = _folder(spark, "returned"), _plain_rows(items, ddl)
    batch = list(islice(rows, HELD))
    while True:
        spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(at)
        if not (batch := list(islice(rows, HELD))):
            return spark.read.schema(ddl).parquet(at)


def _refused(error: type[ItemError], run: Callable[[], object]) -> ItemError:
    try:
        run()
    except error as e:
        return e
    raise AssertionError(f"{error.__name__} was expected")


def _conditional_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional puts and deletes, those that are refused included."""
    db = _engine(spark, sf_dir)
    of = lambda k: {"TableName": "clients", "Key": V(c_custkey=k)}
    put = lambda k, **more: {"TableName": "clients", "Item": V(c_custkey=k, c_name="put", c_acctbal=0.5), **more}
    _refused(ConditionalCheckFailed, lambda: db.execute("PutItem", put(1, ConditionExpression="attribute_not_exists(c_custkey)")))
    db.execute("PutItem", put(2, ConditionExpression="attribute_exists(c_name) AND NOT c_name = :n", ExpressionAttributeValues={":n": {"S": "put"}}))
    db.execute("PutItem", put(-7, ConditionExpression="attribute_not_exists(c_custkey)"))
    for k in range(3, 9):
        condition = {"ConditionExpression": "c_acctbal < :z OR c_mktsegment IN (:a, :b)", "ExpressionAttributeValues": {":z": {"N": "0"}, ":a": {"S": "BUILDING"}, ":b": {"S": "MACHINERY"}}}
        with suppress(ConditionalCheckFailed):
            db.execute("DeleteItem", {**of(k), **condition})
    return _stored(db, "clients", c_custkey="long", c_name="string", c_acctbal="double")


QUERIES["api_conditional_writes"] = _conditional_writes
ORACLE_SQL["api_conditional_writes"] = """SELECT c_custkey, CASE WHEN c_custkey = 2 THEN 'put' ELSE c_name END AS c_name, CASE WHEN c_custkey = 2 THEN 0.5 ELSE c_acctbal END AS c_acctbal FROM customer
WHERE NOT (c_custkey BETWEEN 3 AND 8 AND (c_acctbal < 0 OR c_mktsegment IN ('BUILDING', 'MACHINERY'))) UNION ALL SELECT -7, 'put', 0.5"""


def _return_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images that puts, updates and deletes return, and that of a refused one."""
    db = _engine(spark, sf_dir)
    key = lambda k: {"TableName": "clients", "Key": V(c_custkey=k)}
    update = {"UpdateExpression": "SET c_acctbal = c_acctbal + :d REMOVE c_mktsegment", "ExpressionAttributeValues": {":d": {"N": "0.25"}}}
    images = [db.execute("UpdateItem", {**key(k), **update, "ReturnValues": mode}).get("Attributes", {}) for k, mode in ((1, "ALL_OLD"), (2, "ALL_NEW"), (3, "UPDATED_OLD"), (4, "UPDATED_NEW"), (5, "NONE"))]
    images.append(db.execute("PutItem", {"TableName": "clients", "Item": V(c_custkey=6), "ReturnValues": "ALL_OLD"})["Attributes"])
    images.append(db.execute("DeleteItem", {**key(7), "ReturnValues": "ALL_OLD"})["Attributes"])
    images.append(_refused(ConditionalCheckFailed, lambda: db.execute("DeleteItem", {**key(8), "ConditionExpression": "c_name = :x", "ExpressionAttributeValues": {":x": {"S": "x"}}, "ReturnValuesOnConditionCheckFailure": "ALL_OLD"})).item)
    return _plain_items(spark, [{"n": {"N": str(i)}, **x} for i, x in enumerate(images, 1)], "n int, c_custkey long, c_name string, c_acctbal double, c_mktsegment string")


QUERIES["api_return_values"] = _return_values
ORACLE_SQL["api_return_values"] = """SELECT n, CASE WHEN n NOT IN (3, 4, 5) THEN c_custkey END AS c_custkey, CASE WHEN n NOT IN (3, 4, 5) THEN c_name END AS c_name,
CASE WHEN n IN (2, 4) THEN c_acctbal + 0.25 WHEN n <> 5 THEN c_acctbal END AS c_acctbal, CASE WHEN n NOT IN (2, 4, 5) THEN c_mktsegment END AS c_mktsegment
FROM customer JOIN range(1, 9) r(n) ON c_custkey = n"""


def _transact_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction over two tables, then two that are cancelled, and what both tables hold."""
    db = _engine(spark, sf_dir)
    db.execute("CreateTable", {"TableName": "audits", "KeySchema": _key_schema("audit", "line"), "AttributeDefinitions": _defined(audit="S", line="N")})
    key = lambda k: {"TableName": "clients", "Key": V(c_custkey=k)}
    audit = lambda i: {"Put": {"TableName": "audits", "Item": {"audit": {"S": "a"}, "line": {"N": str(i)}}}}
    given = {"ExpressionAttributeValues": {":d": {"N": "100"}}}
    moved = [{"Update": {**key(1), "UpdateExpression": "SET c_acctbal = c_acctbal - :d", **given}}, {"Update": {**key(2), "UpdateExpression": "SET c_acctbal = c_acctbal + :d", **given}}]
    check = {"ConditionCheck": {**key(4), "ConditionExpression": "attribute_exists(c_name)"}}
    db.execute("TransactWriteItems", {"TransactItems": [*moved, {"Delete": key(3)}, check, audit(1)]})
    failed = _refused(TransactionCanceled, lambda: db.execute("TransactWriteItems", {"TransactItems": [*moved, {"ConditionCheck": {**key(3), "ConditionExpression": "attribute_exists(c_name)"}}, audit(2)]}))
    missing = _refused(TransactionCanceled, lambda: db.execute("TransactWriteItems", {"TransactItems": [audit(3), {"Delete": {"TableName": "nowhere", "Key": V(k=1)}}]}))
    codes = spark.createDataFrame([(f"{n}/{i}", None, r["Code"]) for n, x in enumerate((failed, missing)) for i, r in enumerate(x.reasons)], "what string, amount double, note string")
    audits = db.store.read(db.store.state().table("audits")).select(F.lit("audit").alias("what"), F.lit(None).cast("double").alias("amount"), ItemBinding("item").body("line", "N").alias("note"))
    return _stored(db, "clients", c_custkey="string", c_acctbal="double").select(F.lit("client").alias("what"), F.col("c_acctbal").alias("amount"), F.lit(None).cast("string").alias("note")).union(audits).union(codes)


QUERIES["api_transact_write"] = _transact_write
ORACLE_SQL["api_transact_write"] = """SELECT 'client' AS what, c_acctbal + CASE c_custkey WHEN 1 THEN -100 WHEN 2 THEN 100 ELSE 0 END AS amount, NULL::VARCHAR AS note FROM customer WHERE c_custkey <> 3
UNION ALL SELECT 'audit', NULL, '1'
UNION ALL SELECT * FROM (VALUES ('0/0', NULL, 'None'), ('0/1', NULL, 'None'), ('0/2', NULL, 'ConditionalCheckFailed'), ('0/3', NULL, 'None'), ('1/0', NULL, 'None'), ('1/1', NULL, 'ResourceNotFound'))"""


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BatchWriteItem, BatchGetItem with misses, and TransactGetItems."""
    db = _engine(spark, sf_dir)
    writes = [{"PutRequest": {"Item": V(c_custkey=k, c_name="new")}} for k in range(1, 11)] + [{"DeleteRequest": {"Key": V(c_custkey=k)}} for k in range(11, 21)]
    db.execute("BatchWriteItem", {"RequestItems": {"clients": writes}})
    got = db.execute("BatchGetItem", {"RequestItems": {"clients": {"Keys": [V(c_custkey=k) for k in range(8, 26)], "ProjectionExpression": "c_custkey, c_name"}}})["Responses"]["clients"]
    both = db.execute("TransactGetItems", {"TransactItems": [{"Get": {"TableName": "clients", "Key": V(c_custkey=k)}} for k in (30, 11, 31)]})["Responses"]
    return _plain_items(spark, [*got, *(x.get("Item", {}) for x in both)], "c_custkey long, c_name string")


QUERIES["api_batches"] = _batches
ORACLE_SQL["api_batches"] = """SELECT c_custkey, CASE WHEN c_custkey <= 10 THEN 'new' ELSE c_name END AS c_name FROM customer WHERE c_custkey BETWEEN 8 AND 10 OR c_custkey BETWEEN 21 AND 25 OR c_custkey IN (30, 31)
UNION ALL SELECT NULL, NULL"""


def _paged(db: Engine, operation: str, **request: object) -> Iterator[dict]:
    """The items of all pages, by cursor; one page is held."""
    start: dict | None = None
    while True:
        page = db.execute(operation, {"TableName": "clients", **request, **({"ExclusiveStartKey": start} if start else {})})
        yield from page["Items"]
        start = page.get("LastEvaluatedKey")
        if not start:
            return


def _index_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index added to a table with rows, written through by later changes, and read page by page."""
    db = _engine(spark, sf_dir)
    db.execute("UpdateTable", {"TableName": "clients", "AttributeDefinitions": _defined(c_mktsegment="S", c_acctbal="N"), "GlobalSecondaryIndexUpdates": [{"Create": {"IndexName": "by_segment", "KeySchema": _key_schema("c_mktsegment", "c_acctbal")}}]})
    db.execute("UpdateItem", {"TableName": "clients", "Key": V(c_custkey=1), "UpdateExpression": "SET c_mktsegment = :s, c_acctbal = :z", "ExpressionAttributeValues": V(**{":s": "BUILDING", ":z": 1})})
    db.execute("UpdateItem", {"TableName": "clients", "Key": V(c_custkey=2), "UpdateExpression": "REMOVE c_mktsegment"})
    if db.verify_index("clients", "by_segment") != {"Mismatches": 0}:
        raise AssertionError("the index differs from its rows")
    items = _paged(db, "Query", IndexName="by_segment", KeyConditionExpression="c_mktsegment = :s AND c_acctbal >= :z", ExpressionAttributeValues=V(**{":s": "BUILDING", ":z": 0}), ScanIndexForward=False, Limit=150)
    return _plain_items(spark, [{**x, "place": {"N": str(i)}} for i, x in enumerate(items)], "place long, c_custkey long, c_acctbal double")


QUERIES["api_index_added"] = _index_added
ORACLE_SQL["api_index_added"] = """SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey DESC) - 1 AS place, c_custkey, c_acctbal FROM (
SELECT c_custkey, CASE WHEN c_custkey = 1 THEN 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_custkey = 1) AND c_custkey <> 2) WHERE c_acctbal >= 0"""


def _backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of an index on an attribute that most items lack, added later."""
    db = Engine(spark, _warehouse(spark))
    db.execute("CreateTable", {"TableName": "papers", "KeySchema": _key_schema("doc_id"), "AttributeDefinitions": _defined(doc_id="N")})
    db.store.load("papers", _items(spark, sf_dir).select("item"))
    db.execute("UpdateTable", {"TableName": "papers", "AttributeDefinitions": _defined(quality="N"), "GlobalSecondaryIndexUpdates": [{"Create": {"IndexName": "by_quality", "KeySchema": _key_schema("quality")}}]})
    b = ItemBinding("item")
    return db.store.read(db.store.state().table("papers")).where("ix_by_quality_pk IS NOT NULL").select(b.body("doc_id", "N").cast("long").alias("doc_id"), b.body("quality", "N").cast("int").alias("quality_key"))


QUERIES["gsi_backfill"], ORACLE_SQL["gsi_backfill"] = _backfill, "SELECT doc_id, quality AS quality_key FROM labels WHERE quality IS NOT NULL AND doc_id IN (SELECT doc_id FROM documents)"


def _scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of a filtered Scan, and all segments of another one."""
    db = _engine(spark, sf_dir)
    given = {"FilterExpression": "c_acctbal > :p", "ExpressionAttributeValues": {":p": {"N": "5000"}}}
    pages = _written(spark, _paged(db, "Scan", Limit=600, **given), "c_custkey long, c_name string").withColumn("how", F.lit("pages"))
    parts = (x for i in range(2) for x in _paged(db, "Scan", Segment=i, TotalSegments=2))
    return pages.unionByName(_written(spark, parts, "c_custkey long, c_name string").withColumn("how", F.lit("segments")))


QUERIES["api_scan_pages"] = _scan_pages
ORACLE_SQL["api_scan_pages"] = "SELECT c_custkey, c_name, 'pages' AS how FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT c_custkey, c_name, 'segments' FROM customer"


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables are created, listed page by page, described and deleted."""
    db = Engine(spark, _warehouse(spark))
    for name in [f"{r.n_name.replace(' ', '_')}.{r.n_regionkey}" for r in read(spark, sf_dir, "nation").where("n_regionkey < 2").collect()]:
        db.execute("CreateTable", {"TableName": name, "KeySchema": _key_schema("place", "year"), "AttributeDefinitions": _defined(place="S", year="N", rank="N"), "LocalSecondaryIndexes": [{"IndexName": "by_rank", "KeySchema": _key_schema("place", "rank"), "Projection": {"ProjectionType": "KEYS_ONLY"}}]})
    first = db.execute("ListTables", {"Limit": 3})
    rest = db.execute("ListTables", {"ExclusiveStartTableName": first["LastEvaluatedTableName"]})["TableNames"]
    db.execute("DeleteTable", {"TableName": rest[-1]})
    told = [db.execute("DescribeTable", {"TableName": n})["Table"] for n in [*first["TableNames"], *rest[:-1]]]
    lost = _refused(ResourceNotFound, lambda: db.execute("DescribeTable", {"TableName": rest[-1]}))
    rows = [(t["TableName"], t["TableStatus"], t["LocalSecondaryIndexes"][0]["Projection"]["ProjectionType"]) for t in told]
    return spark.createDataFrame([*rows, (rest[-1], lost.code, None)], "name string, status string, projection string")


QUERIES["api_tables"] = _tables
ORACLE_SQL["api_tables"] = """SELECT name, CASE WHEN last THEN 'ResourceNotFoundException' ELSE 'ACTIVE' END AS status, CASE WHEN NOT last THEN 'KEYS_ONLY' END AS projection
FROM (SELECT replace(n_name, ' ', '_') || '.' || n_regionkey AS name, row_number() OVER (ORDER BY replace(n_name, ' ', '_') || '.' || n_regionkey DESC) = 1 AS last FROM nation WHERE n_regionkey < 2)"""
