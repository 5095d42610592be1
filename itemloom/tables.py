"""The registered logical tables over the driver's Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from itemloom.operators.frame import Table
from itemloom.plans.keys import Index, Key, TableSchema


def _n(name: str) -> Key:
    return Key(name, "N")


def _s(name: str) -> Key:
    return Key(name, "S")


def _schema(name: str, pk: Key, sk: Key | None = None, *indexes: Index) -> TableSchema:
    return TableSchema(name, pk, sk, {i.name: i for i in indexes})


#: Parquet file and schema of each logical table.
TABLES = {
    "user_events": ("events", _schema("user_events", _n("user_id"), _n("event_id"), Index("by_ts", _n("user_id"), _s("ts"), local=True), Index("by_type", _s("event_type"), _s("ts")))),
    "cust_orders": ("orders", _schema("cust_orders", _n("o_custkey"), _n("o_orderkey"), Index("by_price", _n("o_custkey"), _n("o_totalprice"), local=True), Index("by_status", _s("o_orderstatus"), _s("o_orderdate")))),
    "customers": ("customer", _schema("customers", _n("c_custkey"), None, Index("by_segment", _s("c_mktsegment"), _n("c_acctbal")))),
    "nation_customers": ("customer", _schema("nation_customers", _n("c_nationkey"), _s("c_name"), Index("by_balance", _n("c_nationkey"), _n("c_acctbal"), local=True))),
    "parts": ("part", _schema("parts", _n("p_partkey"), None, Index("by_brand", _s("p_brand"), _n("p_size")))),
    "turns": ("conversations", _schema("turns", _n("conv_id"), _n("turn"), Index("by_role", _s("role")))),
    "docs": ("documents", _schema("docs", _n("doc_id"), None, Index("by_lang", _s("lang"), _n("n_chars")))),
    "doc_labels": ("documents", _schema("doc_labels", _n("doc_id"), None, Index("by_quality", _n("quality")))),
    "vectors": ("embeddings", _schema("vectors", _n("vec_id"), None, Index("by_label", _n("label")))),
    "lines": ("lineitem", _schema("lines", _n("l_orderkey"), _n("l_linenumber"))),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def open_table(spark: SparkSession, sf_dir: str, name: str) -> Table:
    source, schema = TABLES[name]
    df = read(spark, sf_dir, source)
    if name == "doc_labels":  # labels are absent for most documents
        df = df.select("doc_id", "lang", "source", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return Table(df, schema)
