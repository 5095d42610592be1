"""Quality rules: gradient-boosted trees over document statistics, with monotonic constraints.

The statistics of a whole text are computed over many texts at once in numpy; the trees are flat arrays
and score batches. The score may only fall with the shares of symbols, repeated lines and repeated
words. Training uses the labels of at most `sample` ids (those of the smallest hashes), whose documents'
statistics, not texts, come to the driver: one row an id, the least if several documents have it. Everything else
reads all documents, without a shuffle.

Defined results: a null text has no words, characters or lines; a text of any length is one piece of work, of some 25
times its size; labels that are null, or of ids without a document, are not used; several labels of one id count as the
lowest; without labels of both classes the trees are a constant and every document that passes the base rules is
kept. Repeated rows are judged alike, null ids as any other; an empty table has no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.llm import blocks as B
from itemloom.llm import gbt

SAMPLE = 8000
#: Documents are rejected below this probability of good quality.
LEAST = 0.35
#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
NAMES = ["log_words", "chars_a_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "wide_share", "words_a_line", "distinct_share", "longest_word", "loud_share"]
MONOTONE = {2: -1, 3: -1, 4: -1}
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key was there before, and how often it occurs."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    group = np.cumsum(first) - 1
    before, count = np.empty(len(k), bool), np.empty(len(k), np.int64)
    before[order] = ~first
    count[order] = np.bincount(group)[group] if len(k) else 0
    return before, count


def statistics(block: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """The five counts of the base rules (n x 5), and the features of the trees."""
    data, ends = block.data, block.ends
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)

    def per_doc(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return total[ends] - total[starts]

    def bytes_in(values) -> np.ndarray:
        t = np.zeros(256, bool)
        t[list(values)] = True
        return t

    words_table = ~bytes_in(B.SEPARATORS)
    starts_char = bytes_in([i for i in range(256) if i & 0xC0 != 0x80])
    ws, we, doc = B.word_spans(data, ends)
    n_words = np.bincount(doc, minlength=block.n)
    word_chars = per_doc(words_table & starts_char)
    symbols = per_doc(bytes_in(SYMBOLS))
    h = B.span_hashes(data, ws, we)

    breaks = np.flatnonzero(data == 10)
    ls = np.sort(np.concatenate([starts, breaks + 1]))
    line_doc = np.searchsorted(ends, breaks, "right")
    line_doc = np.sort(np.concatenate([np.arange(block.n), line_doc]))
    order_ends = np.sort(np.concatenate([ends, breaks]))
    spoken = np.concatenate([[0], np.cumsum(words_table[data], dtype=np.int64)])
    has_word = spoken[order_ends] > spoken[ls]
    key = B.mixed(B.span_hashes(data, ls[has_word], order_ends[has_word]) + line_doc[has_word].astype(np.uint64) * np.uint64(B.BASE))
    dup = np.bincount(line_doc[has_word][repeats(key)[0]], minlength=block.n)
    n_lines = np.bincount(line_doc[has_word], minlength=block.n)

    triple = B.mixed(B.rolled(h, 3))
    at = np.flatnonzero(doc[: len(triple)] == doc[2:][: len(triple)]) if len(triple) else np.zeros(0, np.int64)
    often = repeats(B.mixed(triple[at] + doc[at].astype(np.uint64) * np.uint64(B.BASE)))[1] > 1
    step = np.zeros(len(ws) + 3, np.int32)
    step[at[often]] = 1
    step[3:] -= step[:-3].copy()
    repeated = np.bincount(doc[np.cumsum(step[: len(ws)]) > 0], minlength=block.n)

    again = repeats(B.mixed(h + doc.astype(np.uint64) * np.uint64(B.BASE)))[0]
    distinct = n_words - np.bincount(doc[again], minlength=block.n)
    longest = np.zeros(block.n, np.int64)
    np.maximum.at(longest, doc, we - ws)
    size = np.maximum(word_chars, 1)
    words = np.maximum(n_words, 1)
    features = np.stack(
        [np.log1p(n_words), word_chars / words, symbols / size, dup / np.maximum(n_lines, 1), repeated / words, per_doc(bytes_in(range(65, 91))) / size, per_doc(bytes_in(range(48, 58))) / size,
         per_doc(bytes_in(b".,;:!?")) / size, per_doc(bytes_in(range(0xC0, 256))) / size, n_words / np.maximum(n_lines, 1), distinct / words, np.log1p(longest), per_doc(bytes_in(b"!")) / size], 1,
    )
    return np.stack([n_words, word_chars, symbols, dup, repeated], 1), features


def batch_blocks(batch: pa.RecordBatch, target: int = 1 << 22) -> Iterator[B.Block]:
    """The rows (id, text as binary) of a batch, some megabytes at a time."""
    at = 0
    while at < batch.num_rows:
        text = batch.column(1).slice(at).fill_null(b"")
        lens = np.diff(np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4).astype(np.int64))
        n = max(1, int(np.searchsorted(np.cumsum(lens), target)))
        ends = np.cumsum(lens[:n])
        offset = np.frombuffer(text.buffers()[1], np.int32, 1, text.offset * 4)[0]
        data = np.frombuffer(text.buffers()[2], np.uint8, int(ends[-1]), int(offset)) if text.buffers()[2] is not None and ends[-1] else np.zeros(0, np.uint8)
        yield B.Block(np.arange(at, at + len(ends)), batch.column(1).slice(at, n).is_null().to_numpy(zero_copy_only=False), ends, data, b"")
        at += len(ends)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> gbt.Trees:
    """Trees from the documents of a bounded, hashed sample of labels."""
    told = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min("quality").alias("__quality"))
    some = told.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("binary").alias("__text"))
    rows = texts.join(F.broadcast(some), F.col("__doc") == F.col("__id")).select(F.col("__quality").cast("double"), "__text", "__id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch_blocks(batch):
                x = statistics(block)[1]
                own = [batch.column(i).slice(int(block.ids[0]), block.n) for i in (0, 2)]
                yield pa.record_batch([*own, pa.array(list(x), pa.list_(pa.float64()))], names=["y", "id", "x"])

    got = rows.mapInArrow(run, f"y double, id {dict(rows.dtypes)['__id']}, x array<double>").groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x")).toPandas()
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, len(NAMES)))
    order = np.lexsort([*x.T, got["y"].to_numpy(float)])  # the same trees whatever the order of rows
    return gbt.fit(x[order], got["y"].to_numpy(float)[order], MONOTONE)


def judge(docs: DataFrame, model: gbt.Trees, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, the counts, base_failed, probability, kept."""
    names = [c.split()[0] for c in STATS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch_blocks(batch):
                counts, x = statistics(block)
                p = model.probability(x)
                failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
                yield pa.record_batch([batch.column(0).slice(int(block.ids[0]), block.n), *[pa.array(c) for c in counts.T], pa.array(failed), pa.array(p), pa.array(~failed & (p >= least))], names=["id", *names, "base_failed", "probability", "kept"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    return chosen.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, {STATS}, base_failed boolean, probability double, kept boolean").withColumnRenamed("id", id_col)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return judge(docs, train(docs, labels)).drop("probability")
