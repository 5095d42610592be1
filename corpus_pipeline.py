"""From raw documents to packed token windows: each stage's rows are stored and read again by the next.

Quality classifier (rejected documents go), line dedup per source, n-gram Jaccard join (the smallest id of each
group stays), suffix-array dedup (repeated bytes of later documents go), packing. n_chars follows the text.
Each stage begins with executors that have given back the memory of the one before.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.llm import blocks, jaccard, lines, lm, packing, suffix
from itemloom.llm.queries import table, tokenizer_path


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rested(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        blocks.rest(spark)
        return stage(spark, docs, sf_dir)

    return begin


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


@rested
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lm.kept_documents(docs, table(spark, sf_dir, "labels"))


@rested
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = lines.dedup(docs).withColumn("text", F.col("kept_text"))
    return sized(done.select(*docs.columns))


@rested
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicated(docs)


@rested
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sized(suffix.cleaned(docs))


@rested
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("suffix_dedup", suffix_dedup),
    ("packing", pack),
]

#: Stages 1, 4 and 5 have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed windows of `documents`; stages are written to the shared checkpoint folder."""
    blocks.shared_dir(spark)
    at = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{at}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop(spark, before)
        before = path
        blocks.release(spark)
    return docs


def drop(spark: SparkSession, path: str) -> None:
    """Delete a stage's folder, on whichever file system it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
