"""Compiled conditions and updates against the plain evaluator, on random items and expressions, for both bindings."""

import random

import pytest
from pyspark.sql import functions as F

from itemloom.functions import evaluate
from itemloom.functions.values import text_of, value_of
from itemloom.plans import compile as C
from itemloom.plans import expressions as X
from itemloom.plans.binding import ItemBinding, TypedBinding

VALUES = {"one": {"N": "1"}, "two": {"N": "2"}, "half": {"N": "2.5"}, "a": {"S": "a"}, "ab": {"S": "ab"}, "t": {"BOOL": True}, "N": {"S": "N"}, "S": {"S": "S"}, "huge": {"N": "1e30"}}


def random_condition(rng, depth=3):
    if depth and rng.random() < 0.6:
        kind = rng.choice(["AND", "OR", "NOT"])
        if kind == "NOT":
            return f"NOT ({random_condition(rng, depth - 1)})"
        return f"({random_condition(rng, depth - 1)}) {kind} ({random_condition(rng, depth - 1)})"
    p, v, w = rng.choice(["n", "m", "s", "z", "b"]), ":" + rng.choice(list(VALUES)), ":" + rng.choice(list(VALUES))
    op = rng.choice(["=", "<>", "<", "<=", ">", ">="])
    return rng.choice([f"{p} {op} {v}", f"{v} {op} {p}", f"n {op} m", f"s {op} n", f"attribute_exists({p})", f"attribute_not_exists({p})", f"{p} BETWEEN {v} AND {w}", f"{p} IN ({v}, {w})", f"begins_with({p}, {v})", f"contains({p}, {v})", f"attribute_type({p}, :{rng.choice('NS')})"])


def items(rng, n=60):
    out = []
    for i in range(n):
        row = {"n": rng.choice([None, 0, 1, 2, 3]), "m": rng.choice([None, 1, 2]), "s": rng.choice([None, "", "a", "ab", "b", "xab"]), "b": rng.choice([None, True, False])}
        out.append((i, row))
    return out


def as_item(row):
    tags = {"n": "N", "m": "N", "s": "S", "b": "BOOL"}
    return {k: {tags[k]: str(v) if tags[k] == "N" else v} for k, v in row.items() if v is not None}


def test_conditions_agree_with_the_evaluator(spark):
    rng = random.Random(5)
    rows = items(rng)
    typed = spark.createDataFrame([(i, r["n"], r["m"], r["s"], r["b"]) for i, r in rows], "i int, n int, m int, s string, b boolean").cache()
    stored = spark.createDataFrame([(i, {k: text_of(v) for k, v in as_item(r).items()}) for i, r in rows], "i int, item map<string,string>").cache()
    conditions = [X.condition(random_condition(rng), None, VALUES) for _ in range(60)]
    for df, binding in ((typed, TypedBinding(typed)), (stored, ItemBinding())):
        got = {r.i: r for r in df.select("i", *[C.truth(c, binding).alias(f"c{k}") for k, c in enumerate(conditions)]).collect()}
        for k, c in enumerate(conditions):
            for i, r in rows:
                assert got[i][f"c{k}"] is evaluate.holds(c, as_item(r)), (c, r)
        for c in conditions[:8]:
            assert {r.i for r in df.where(C.condition(c, binding)).collect()} == {i for i, r in rows if evaluate.holds(c, as_item(r))}


@pytest.mark.parametrize("text", ["SET n = if_not_exists(n, :one) + :two", "SET s = :ab, m = if_not_exists(m, :two) REMOVE b", "ADD n :two, m :one", "SET q = :a ADD z :two"])
def test_updates_agree_with_the_evaluator(spark, text):
    rows = items(random.Random(6), 30)
    u = X.update(text, None, VALUES)
    stored = spark.createDataFrame([(i, {k: text_of(v) for k, v in as_item(r).items()}) for i, r in rows], "i int, item map<string,string>")
    want = {i: evaluate.updated(u, as_item(r)) for i, r in rows}
    assert {r.i: {k: value_of(v) for k, v in r["new"].items()} for r in stored.select("i", C.item_update("item", u).alias("new")).collect()} == want
    typed = spark.createDataFrame([(i, r["n"], r["m"], r["s"], r["b"]) for i, r in rows], "i int, n int, m int, s string, b boolean")
    got = {r.i: {k: v for k, v in r.asDict().items() if k != "i" and v is not None} for r in C.typed_update(typed, u).collect()}
    plain = lambda v: int(v["N"]) if "N" in v else next(iter(v.values()))
    assert got == {i: {k: plain(v) for k, v in item.items()} for i, item in want.items()}


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).withColumn("s", F.col("id").cast("string")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    c = X.condition("id BETWEEN :a AND :b AND begins_with(s, :p) AND id IN (:a, :c)", None, {"a": {"N": "3"}, "b": {"N": "40"}, "p": {"S": "3"}, "c": {"N": "30"}})
    q = df.where(C.condition(c, TypedBinding(df)))
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    pushed = q._jdf.queryExecution().executedPlan().toString().split("PushedFilters: ")[1].split("ReadSchema")[0]
    assert "GreaterThanOrEqual(id,3)" in pushed and "StringStartsWith(s,3)" in pushed and "In(id" in pushed
    assert sorted(r.id for r in q.collect()) == [3, 30]


def test_errors_only_for_rows_that_are_hit(spark):
    df = spark.createDataFrame([(1, None, 5), (2, 7, 5)], "i int, n int, m int")
    u = X.update("SET m = n + :one", None, VALUES)
    assert [r.m for r in C.typed_update(df, u, F.col("i") == 2).orderBy("i").collect()] == [5, 8]
    with pytest.raises(Exception, match="does not exist"):
        C.typed_update(df, u).collect()
