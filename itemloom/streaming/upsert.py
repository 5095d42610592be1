"""A streaming sink: each micro-batch of changes becomes one commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.errors import ValidationError
from itemloom.sources.store import COMPACT_AFTER, State, TableState, Warehouse, derived, index_columns


def upsert(store: Warehouse, table: str, order: str, stream: str = "stream") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows (item, `order`); of several changes of a key in a batch the last one stays.

    `order` is compared in its own type (of rows that are equal in it, the one with the greater item text stays). The
    number of the last batch of each `stream` is committed with its rows, so a batch that is delivered again changes
    nothing, whatever was committed since.
    """

    def write(batch: DataFrame, number: int) -> None:
        mark = f"Batch of {stream}"
        state = store.state().table(table)
        if int(state.info.get(mark, -1)) >= number:
            return
        if order not in batch.columns:
            raise ValidationError(f"changes have no column {order}")
        schema = state.schema
        names = ["pk", "sk", "item", *[c for c, _ in index_columns(schema)]]
        rows = derived(batch.select("item", F.col(f"`{order}`").alias(" order")), schema, [" order"])
        by = F.struct(F.col("` order`"), F.to_json("item"))
        last = rows.groupBy("pk", "sk").agg(F.max_by(F.struct(*[f"`{c}`" for c in names]), by).alias("r")).select("r.*")

        def apply(s: State) -> dict:
            t = s.table(table)
            if int(t.info.get(mark, -1)) >= number:
                return s.tables
            at = f"{store.path}/{table}/batch-{number}-{s.version + 1}"
            last.select(*[f"`{c}`" for c in names], F.lit(s.version + 1).cast("long").alias("seq"), F.lit(False).alias("gone")).write.mode("overwrite").parquet(at)
            after = TableState(t.schema, t.base, [*t.deltas, at], t.status, {**t.info, mark: number})
            return {**s.tables, table: store.compacted(after) if len(after.deltas) > COMPACT_AFTER else after}

        store.change(apply)

    return write
