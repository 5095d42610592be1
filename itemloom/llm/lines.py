"""Line deduplication by site-relative frequency, in DataFrame operations only.

Per host: the pages that contain a line, divided by the host's pages. A line on at least `min_pages`
pages and on more than `max_percent` percent of its host's pages is boilerplate there and is dropped
from every page of that host.

Scale: lines travel as 64-bit hashes, counted on the map side before the one shuffle, so a hot host or
line is spread over (host, line) keys. What is dropped at a host is an array of hashes; as each of its
lines is on more than max_percent of the pages, the array has at most 100 / max_percent times the mean
number of lines of a page. The arrays are stored, their size is checked, and they are broadcast only up to
BROADCAST_HASHES hashes; beyond that the join is by shuffle, where adaptive execution splits hot hosts.

Defined results: pages without host or text stay as they are and count nowhere; a page counts once per
line, whatever its repeats; blank lines (space and tab to carriage return only) are never dropped; lines
end at \\n and are compared by 64-bit hashes (a host of n unlike lines takes two for one with odds of n**2 / 2**65);
repeated rows are pages of their own; null ids are ids like any other. A null text has no lines; a text of any length is
split whole. An empty table has no rows, and columns of any name are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.llm import blocks as B

MAX_PERCENT = 5
MIN_PAGES = 10
#: 16 MB of hashes at most.
BROADCAST_HASHES = 2_000_000
BLANKS = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, max_percent: int, min_pages: int, host_col: str, text_col: str) -> DataFrame:
    """Rows (__host, __drop): the hashes of each host's boilerplate lines."""
    pages = docs.where(F.col(host_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(host_col).alias("__host"), F.col(text_col).alias("__text"))
    told = F.filter(lines_of(F.col("__text")), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    counts = pages.select("__host", F.explode(F.array_distinct(F.transform(told, lambda x: F.xxhash64(x)))).alias("__line")).groupBy("__host", "__line").agg(F.count("*").alias("__n"))
    totals = pages.groupBy("__host").agg(F.count("*").alias("__pages"))
    often = counts.where(F.col("__n") >= min_pages).join(totals, "__host").where(F.col("__n") * 100 > F.col("__pages") * max_percent)
    return often.groupBy("__host").agg(F.collect_set("__line").alias("__drop"))


def dedup(docs: DataFrame, max_percent: int = MAX_PERCENT, min_pages: int = MIN_PAGES, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with n_lines, n_removed and kept_text, in place of columns with these names."""
    drop = B.kept(boilerplate(docs, max_percent, min_pages, host_col, text_col))
    hashes = drop.agg(F.sum(F.size("__drop"))).first()[0] or 0
    others = [c for c in docs.columns if c not in ("n_lines", "n_removed", "kept_text")]
    # One struct holds all of docs' columns, whatever their names.
    pages = docs.select(F.struct(*[f"`{c}`" for c in others]).alias("__row"), F.col(host_col).alias("__of"), F.col(text_col).alias("__text"))
    joined = pages.join(F.broadcast(drop) if hashes <= BROADCAST_HASHES else drop, F.col("__of") == F.col("__host"), "left")
    lines = lines_of(F.col("__text"))
    stay = F.when(F.col("__drop").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col("__drop"), F.xxhash64(x))))
    split = joined.select("__row", F.size(lines).alias("__lines"), stay.alias("__stay"))
    return split.select(
        *[F.col(f"__row.`{c}`") for c in others],
        F.coalesce(F.col("__lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.col("__lines") - F.size("__stay"), F.lit(0)).cast("long").alias("n_removed"),
        F.array_join("__stay", "\n").alias("kept_text"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH split AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
each AS (SELECT DISTINCT doc_id, source, unnest(lines) AS line FROM split WHERE source IS NOT NULL),
counts AS (SELECT source, line, count(*) AS n FROM each
           WHERE trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' GROUP BY ALL),
totals AS (SELECT source, count(*) AS pages FROM split WHERE source IS NOT NULL AND lines IS NOT NULL GROUP BY source),
often AS (SELECT source, list(line) AS gone FROM counts JOIN totals USING (source)
          WHERE n >= {MIN_PAGES} AND n * 100 > pages * {MAX_PERCENT} GROUP BY source),
done AS (SELECT doc_id, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(gone, []), x)) AS stay FROM split LEFT JOIN often USING (source))
SELECT doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - len(stay))::BIGINT AS n_removed,
       sha256(array_to_string(stay, chr(10))) AS kept_sha256 FROM done
"""
