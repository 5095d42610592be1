"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text gives each document's perplexity.

The model is of order 2: pairs (history, word) of all trusted documents are counted; words are lower-cased in
A-Z. With counts c and the discounts D1, D2, D3+ of the counts of counts,

    P(w | h) = max(c(hw) - D(c(hw)), 0) / c(h) + (D1 N1(h.) + D2 N2(h.) + D3 N3+(h.)) / c(h) * P(w)
    P(w)     = max(N1+(.w) - D', 0) / N1+(..) + D' |{w}| / N1+(..) / VOCABULARY

and P(w | h) = P(w) after an unseen history. When a trusted document is scored, its own occurrences are left out of
c(hw) and c(h), and a pair that only it has is left out of N1+(.w). VOCABULARY is 2**SLOT_BITS, or the next power of
two above twice the number of trusted word forms. Histories are known by 32 bits of a hash and words by 32 bits more, so of
unseen followers of a history with F followers a share of F / 2**32 passes for seen ones, and of V word forms, a share
of V / 2**32 of unseen words.

Sharded count joins. Parts of the text send their pairs, sorted and delta-coded, to buckets by history:
trusted ones once to be counted, then all to be scored beside the counts. Continuations N1+(.w) are summed in shards by
word, and joined to the counted pairs. A bucket answers each part with its documents' sums of ln P(w | h) - ln P(w), for which
it needs P(w) of counted pairs only; ln P(w) comes from the shards of the words, as a sum a document as well. No text is
shuffled, and no table of words or pairs is gathered anywhere.

What spares work, and never changes a result: a bitmap of fixed size tells histories that the model surely lacks, and a
broadcast table of at most TOP words, those with the most continuations, spares most words the way to their shard
(16 MB together). Histories with more than half of a bucket's fair share of the trusted text (fewer than two per
bucket, by arithmetic) are split by word over SPLIT buckets, and their totals are summed over these; a document's own
occurrences of a history are counted where its text is, so they are left out alike on either path.

Thresholds. Log-perplexity is shrunk towards the language's trusted mean by PRIOR words, so that a few
rare words don't condemn a short text, and a document is kept up to the trusted documents' QUANTILE in
its language; languages without trusted text use the quantile of all trusted documents.

Defined results: documents without words (null or empty text) have no perplexity and are rejected; a null
language is one of its own; without any trusted document every document that has words is kept; labels
that are null, or without a document, don't count; an id is trusted if all of its labels say so; repeated
rows are scored alike; a text of any length is one piece of work, of some 25 times its size; an empty table has no rows;
columns of other names play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.llm import blocks as B

#: The least size of the vocabulary over which what is left for unseen words is spread.
SLOT_BITS = 22
WORD_BITS = 32
SPLIT = 16
#: Parts in which the bitmap is merged.
PARTS = 64
#: Words whose continuations all tasks know.
TOP = 1 << 20
#: Classes of numbers of continuations that are told apart when the bound of these words is chosen.
LEVELS = 4096
#: Parts of the documents that are scored one after the other; each reads the text once more and takes its share of the disk.
ROUNDS = 2
#: Buckets, unless the trusted text has more than as many times B.BUCKET_BYTES.
BUCKETS = 64
PRIOR = 30
QUANTILE = 0.995
#: Bits of a history by which a table of fixed size (8 MB) knows histories that the model lacks.
SEEN_BITS = 26
#: Text worked on at once.
PART = 4 << 20
#: Trusted ids up to which labels are broadcast (16 MB); beyond, documents and labels are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Rejected documents up to which what tells them is broadcast (32 MB and their languages); beyond, it is joined by shuffle.
BROADCAST_GONE = 1_000_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def bundle(parts: list[bytes]) -> bytes:
    return np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def unbundle(raw: bytes) -> list[bytes]:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(raw, np.int64, n, 8))
    return [raw[a:b] for a, b in zip([8 * (n + 1), *ends[:-1]], ends)]


def parts_of(batch: pa.RecordBatch, target: int) -> Iterator[tuple[int, int, B.Block]]:
    """The rows of a batch with the text (binary) in column 0, some megabytes at a time."""
    B.settle_memory()
    text = batch.column(0).fill_null(b"")
    offsets = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4).astype(np.int64) if len(text) else np.zeros(1, np.int64)
    at = 0
    while at < len(text):
        end = min(len(text), max(at + 1, int(np.searchsorted(offsets, offsets[at] + target))))
        data = np.frombuffer(text.buffers()[2], np.uint8, int(offsets[end] - offsets[at]), int(offsets[at])) if offsets[end] > offsets[at] else np.zeros(0, np.uint8)
        yield at, end, B.Block(np.arange(at, end), np.zeros(end - at, bool), offsets[at + 1 : end + 1] - offsets[at], data, b"")
        at = end


def pairs(block: B.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the pairs (32 bits of the history, 32 of the word), documents, and words per document; in order of text."""
    data = np.frombuffer(LOWER, np.uint8)[block.data]
    starts, ends, doc = B.word_spans(data, block.ends)
    h = B.span_hashes(data, starts, ends)
    history = np.empty_like(h)
    history[1:] = h[:-1]
    first = np.ones(len(h), bool)
    first[1:] = doc[1:] != doc[:-1]
    history[first] = np.uint64(B.MIX)  # the start of a text
    return (history >> np.uint64(WORD_BITS)) << np.uint64(WORD_BITS) | h >> np.uint64(64 - WORD_BITS), doc, np.bincount(doc, minlength=block.n)


def histories(keys: np.ndarray) -> np.ndarray:
    return keys >> np.uint64(WORD_BITS)


def word_of(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64((1 << WORD_BITS) - 1)).astype(np.uint32)


def shards(keys: np.ndarray, n: int, heavy: np.ndarray) -> np.ndarray:
    """The bucket of each pair: by history, and for heavy histories by word as well."""
    u = histories(keys)
    out = (B.mixed(u) % np.uint64(n)).astype(np.int64)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, u), len(heavy) - 1)
        split = heavy[at] == u
        out[split] = (out[split] + (keys[split] & np.uint64(SPLIT - 1)).astype(np.int64) * max(1, n // SPLIT)) % n
    return out


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of a sorted array."""
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    return at, np.diff(np.append(at, len(keys)))


def coded_keys(keys: np.ndarray) -> list[bytes]:
    """Sorted distinct pairs: histories by differences, how many words each has, words by differences."""
    u = histories(keys)
    at, n = grouped(u)
    w = word_of(keys)
    return [B.deltas(u[at]), B.planes(n.astype(np.uint32)), B.planes(np.diff(w, prepend=w[:1] * 0) & np.uint32((1 << WORD_BITS) - 1))]


def decoded_keys(parts: list[bytes]) -> np.ndarray:
    w = np.cumsum(B.unplanes(parts[2], np.uint32), dtype=np.uint32) & np.uint32((1 << WORD_BITS) - 1)
    return np.repeat(B.undeltas(parts[0]), B.unplanes(parts[1], np.uint32)) << np.uint64(WORD_BITS) | w.astype(np.uint64)


# ---------------------------------------------------------------- training


def heavy_histories(trusted: DataFrame, n_buckets: int) -> np.ndarray:
    """Histories with more than half of a bucket's share of the trusted pairs; fewer than 2 * n_buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, block in parts_of(batch, PART):
                u = np.sort(histories(pairs(block)[0]))
                at, n = grouped(u)
                often = n * 4 * n_buckets > len(u)  # a heavy history is so in some part
                yield pa.record_batch([pa.array(np.append(u[at][often].astype(np.int64), -1)), pa.array(np.append(n[often], len(u)))], names=["u", "n"])

    counts = trusted.mapInArrow(run, "u long, n long").groupBy("u").agg(F.sum("n").alias("n"))
    total = counts.where("u = -1").first()
    if not total:
        return np.zeros(0, np.uint64)
    rows = counts.where((F.col("u") >= 0) & (F.col("n") * (2 * n_buckets) > total.n)).select("u").collect()
    return np.sort(np.array([r.u for r in rows], np.int64).astype(np.uint64))


def discounts(n: list[int]) -> np.ndarray:
    """D1, D2 and D3+ from the counts of counts 1 to 4, within their bounds; index 0 is for unseen pairs."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    d = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else i / 2 for i in (1, 2, 3)]
    return np.array([0.0, *(min(max(x, 0.05), i - 0.05) for i, x in zip((1, 2, 3), d))])


class Model:
    """What all buckets share: discounts, totals of the lower order, the most frequent words' continuations, and the totals of split histories."""

    def __init__(self, counts_of_counts: list[int], lower: tuple[int, int, int, int], words: np.ndarray, times: np.ndarray, seen: np.ndarray, heavy: np.ndarray, totals: np.ndarray):
        """lower: sum of all continuations, number of words, and of those with one and with two; words: sorted, with their times."""
        self.parts = (counts_of_counts, lower, words, times, seen, heavy, totals)
        self.seen, self.words, self.times, self.heavy, self.totals = seen, words, times, heavy, totals
        self.d = discounts(counts_of_counts)
        self.all, self.some = float(lower[0]), lower[1]
        self.low = lower[2] / (lower[2] + 2 * lower[3]) if lower[2] else 0.5
        self.vocabulary = float(1 << max(SLOT_BITS, int(self.some).bit_length() + 1))
        self.complete = len(words) == self.some

    def maybe_seen(self, keys: np.ndarray) -> np.ndarray:
        """False for pairs whose history no trusted document has."""
        at = histories(keys) >> np.uint64(64 - WORD_BITS - SEEN_BITS)
        return (self.seen[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def continuations(self, words: np.ndarray) -> np.ndarray:
        """Of each word; -1 if its shard has to say."""
        if not len(self.words):
            return np.full(len(words), 0 if self.complete else -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.times[at].astype(np.int64), 0 if self.complete else -1)

    def word(self, n: np.ndarray) -> np.ndarray:
        """P(w) of words with n continuations."""
        if not self.all:
            return np.full(len(n), 1.0 / self.vocabulary)
        return (np.maximum(n - self.low, 0) + self.low * max(1, self.some) / self.vocabulary) / self.all


def contexts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The histories of sorted counted pairs, and of each: c(h), N1(h.), N2(h.), N3+(h.)."""
    u = histories(keys)
    at, _ = grouped(u)
    if not len(at):
        return u[at], np.zeros((0, 4))
    return u[at], np.stack([np.add.reduceat(x.astype(np.float64), at) for x in (counts, counts == 1, counts == 2, counts > 2)], 1)


def word_shard(words: np.ndarray, n: int) -> np.ndarray:
    return (words.astype(np.uint64) * np.uint64(n) >> np.uint64(WORD_BITS)).astype(np.int64)


def by_word(rows: DataFrame, n: int) -> DataFrame:
    """Rows (shard, bucket, body) of rows (bucket, words): each bucket's sorted words and their numbers, by shard."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for bucket, raw in zip(frame.bucket, frame.words):
                a, b = unbundle(raw)
                word, times = B.undeltas(a), B.unplanes(b, np.uint32)
                cuts = np.searchsorted(word_shard(word, n), np.arange(n + 1))
                some = np.flatnonzero(np.diff(cuts))
                yield pd.DataFrame({"shard": some.astype(np.int32), "bucket": np.full(len(some), bucket, np.int32), "body": [bundle([B.deltas(word[cuts[i] : cuts[i + 1]]), B.planes(times[cuts[i] : cuts[i + 1]])]) for i in some]})

    return rows.mapInPandas(split, "shard int, bucket int, body binary")


def level_of(times: np.ndarray) -> np.ndarray:
    """Exact up to half of LEVELS, then 64 to a doubling."""
    half = LEVELS // 2
    return np.where(times < half, times, np.minimum(LEVELS, half + 64 * np.log2(np.maximum(times, half) / half))).astype(np.int64)


def word_table(sent: DataFrame) -> DataFrame:
    """Rows (shard, bucket, words, levels): a shard's words and their continuations in row -1, and for each bucket those of its own words."""

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        got = [unbundle(raw) for raw in frame.body]
        words = [B.undeltas(a) for a, _ in got]
        word, at = np.unique(np.concatenate(words), return_inverse=True)
        times = np.bincount(at, np.concatenate([B.unplanes(b, np.uint32) for _, b in got])).astype(np.uint32)
        own = [B.planes(x) for x in np.split(times[at], np.cumsum([len(w) for w in words])[:-1])]
        levels = np.bincount(level_of(times), minlength=LEVELS + 1)
        first = pd.DataFrame({"shard": frame["shard"].iloc[:1], "bucket": np.int32(-1), "words": [bundle([B.deltas(word), B.planes(times)])], "levels": [np.append(levels, times.sum(dtype=np.int64)).tolist()]})
        return pd.concat([first, pd.DataFrame({"shard": frame["shard"], "bucket": frame.bucket, "words": own, "levels": None})])

    return sent.groupBy("shard").applyInPandas(merge, "shard int, bucket int, words binary, levels array<long>")


def top_words(table: DataFrame, levels: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted words, and their continuations, from the least level on of which there are at most `most` words."""
    above = np.cumsum(levels[::-1])[::-1]
    fitting = np.flatnonzero(above <= most)
    least = int(max(1, fitting[0])) if len(fitting) else LEVELS + 1  # with too many at LEVELS none is taken

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for raw in frame.words:
                a, b = unbundle(raw)
                word, times = B.undeltas(a), B.unplanes(b, np.uint32)
                some = level_of(times) >= least
                yield pd.DataFrame({"body": [bundle([B.deltas(word[some]), B.planes(times[some])])]})

    got = [unbundle(bytes(r.body)) for r in table.mapInPandas(pick, "body binary").collect()] if least <= LEVELS else []
    none = [np.zeros(0, np.uint32)]
    words, times = np.concatenate(none + [B.undeltas(a).astype(np.uint32) for a, _ in got]), np.concatenate(none + [B.unplanes(b, np.uint32) for _, b in got])
    order = np.argsort(words, kind="stable")
    return words[order], times[order]


def flags_of(rows: DataFrame, bits: int) -> np.ndarray:
    """As packed bits, which of 2 ** bits slots are in rows of sorted slots; merged in PARTS parts, so only the bits come to the driver."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for raw in frame.slots:
                slot = B.undeltas(raw)
                cuts = np.searchsorted(slot, np.arange(PARTS + 1, dtype=np.uint64) * np.uint64((1 << bits) // PARTS))
                yield pd.DataFrame({"part": range(PARTS), "body": [B.deltas(slot[i:j]) for i, j in zip(cuts, cuts[1:])]})

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((1 << bits) // PARTS, bool)
        base = int(frame.part.iloc[0]) * len(out)
        for raw in frame.body:
            out[B.undeltas(raw).astype(np.int64) - base] = True
        return pd.DataFrame({"part": frame.part.iloc[:1], "body": [zstandard.compress(np.packbits(out, bitorder="little").tobytes(), 1)]})

    table = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows.mapInPandas(split, "part int, body binary").groupBy("part").applyInPandas(merge, "part int, body binary").collect():
        part = np.frombuffer(zstandard.decompress(bytes(r.body)), table.dtype)
        table[r.part * len(part) : (r.part + 1) * len(part)] = part
    return table


def train(trusted: DataFrame, n_buckets: int, top: int = TOP) -> tuple[Model, DataFrame]:
    """The shared part, and rows (bucket, shard, counts, words) with each bucket's counted pairs and each shard's words. trusted: one column, text as binary."""
    heavy = heavy_histories(trusted, n_buckets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, block in parts_of(batch, PART):
                keys = np.sort(pairs(block)[0])
                at, n = grouped(keys)
                keys = keys[at]
                shard = shards(keys, n_buckets, heavy)
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(n_buckets + 1))
                own = [b for b in range(n_buckets) if cuts[b + 1] > cuts[b]]
                bodies = [bundle([*coded_keys(keys[order[cuts[b] : cuts[b + 1]]]), B.planes(n[order[cuts[b] : cuts[b + 1]]].astype(np.uint32))]) for b in own]
                yield pa.record_batch([pa.array(own, pa.int32()), pa.array(bodies, pa.binary())], names=["bucket", "body"])

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        got = [unbundle(x) for x in frame.body]
        keys = np.concatenate([decoded_keys(p) for p in got])
        n = np.concatenate([B.unplanes(p[3], np.uint32) for p in got])
        order = np.argsort(keys, kind="stable")
        at, _ = grouped(keys[order])
        keys, n = keys[order][at], np.add.reduceat(n[order].astype(np.int64), at)
        word, times = np.unique(word_of(keys), return_counts=True)
        u, sums = contexts(keys, n)
        split = np.isin(u, heavy)
        return pd.DataFrame({
            "bucket": frame.bucket.iloc[:1].astype("int32"),
            "counts": [bundle([*coded_keys(keys), B.planes(n.astype(np.uint32))])],
            "words": [bundle([B.deltas(word.astype(np.uint64)), B.planes(times.astype(np.uint32))])],
            "seen": [B.deltas(np.unique(u >> np.uint64(64 - WORD_BITS - SEEN_BITS)))],
            "n": [[int((n == i).sum()) for i in (1, 2, 3, 4)]],
            "totals": [bundle([u[split].tobytes(), sums[split].tobytes()])],
        })

    counted = B.kept(trusted.mapInArrow(send, "bucket int, body binary").groupBy("bucket").applyInPandas(count, "bucket int, counts binary, words binary, seen binary, n array<long>, totals binary"))
    n = counted.select(*[F.sum(F.col("n")[i]) for i in range(4)]).first()
    seen = flags_of(counted.select(F.col("seen").alias("slots")), SEEN_BITS)
    totals = np.zeros((len(heavy), 4))
    for r in counted.select("totals").collect() if len(heavy) else []:  # fewer than 2 * SPLIT rows a bucket
        u, sums = unbundle(bytes(r.totals))
        np.add.at(totals, np.searchsorted(heavy, np.frombuffer(u, np.uint64)), np.frombuffer(sums).reshape(-1, 4))
    table = B.kept(word_table(by_word(counted.select("bucket", "words"), n_buckets)))
    shards_of = table.where("bucket = -1")
    levels = np.zeros(LEVELS + 2, np.int64)
    for r in shards_of.select("levels").collect():
        levels += np.array(r.levels)
    lower = (int(levels[-1]), int(levels[:-1].sum()), int(levels[1]), int(levels[2]))
    words, times = top_words(shards_of.select("words"), levels[:-1], top)

    # Of each bucket: its pairs and words (shard -1), then its words' continuations by shard; from n_buckets on, the shards themselves.
    pairs_of = counted.select("bucket", F.lit(-1).alias("shard"), "counts", "words")
    own = table.where("bucket >= 0").select("bucket", "shard", F.lit(None).cast("binary").alias("counts"), "words")
    tables = pairs_of.union(own).union(shards_of.select((F.col("shard") + n_buckets).alias("bucket"), "shard", F.lit(None).cast("binary").alias("counts"), "words"))
    return Model([int(x or 0) for x in n], lower, words, times, seen, heavy, totals), tables


# ---------------------------------------------------------------- scoring


def gains(model: Model, counted: tuple[np.ndarray, ...], keys: np.ndarray, times: np.ndarray, own: np.ndarray, own_history: np.ndarray) -> np.ndarray:
    """ln P(w | h) - ln P(w) of each entry (pair of a document, times it occurs there). own: whether the document's counts are in the model; own_history: how often it has the history, if so."""
    known, counts, followers, u, sums = counted
    h = histories(keys)
    c, n = np.zeros(len(keys)), np.zeros(len(keys))
    context = np.zeros((len(keys), 4))
    found = np.zeros(len(keys), bool)
    if len(known):
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        found = known[at] == keys
        c, n = np.where(found, counts[at], 0).astype(np.float64), np.where(found, followers[at], 0).astype(np.float64)
        at = np.minimum(np.searchsorted(u, h), len(u) - 1)
        context = np.where((u[at] == h)[:, None], sums[at], 0.0)
    if len(model.heavy):
        at = np.minimum(np.searchsorted(model.heavy, h), len(model.heavy) - 1)
        split = model.heavy[at] == h
        context[split] = model.totals[at[split]]
    c = np.maximum(c - np.where(own, times, 0), 0)
    total = np.maximum(context[:, 0] - own_history, 0)
    alone = own & found & (c == 0)
    d = model.d
    share = np.minimum((context[:, 1:] @ d[1:]) / np.maximum(context[:, 0], 1), 1.0)
    # An uncounted pair's P(w) stands on both sides and cancels out.
    word, less = np.where(found, model.word(n), 1.0), np.where(found, model.word(np.maximum(n - alone, 0)), 1.0)
    p = np.where(total > 0, np.maximum(c - d[np.minimum(c, 3).astype(np.int64)], 0) / np.maximum(total, 1) + share * less, less)
    return np.log(np.minimum(p, 1.0) / word)


def scored(docs: DataFrame, model: Model, counted: DataFrame, n_buckets: int, keep: list[str]) -> DataFrame:
    """Rows with the columns `keep`, n_words and nll. docs: __text (binary), __own, and the columns to keep."""
    heavy = model.heavy
    shared = docs.sparkSession.sparkContext.broadcast(model.parts)  # plain arrays: 8 MB, and 8 bytes for each of TOP words
    kept = docs.select("__text", F.col("__own").alias("__flag"), *[F.col(c) for c in keep])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b, block in parts_of(batch, PART):
                keys, doc, words = pairs(block)
                own = batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool)
                sink = pa.BufferOutputStream()
                extra = batch.select(range(2, batch.num_columns)).slice(a, b - a)
                with pa.ipc.new_stream(sink, extra.schema) as out:
                    out.write_batch(extra)
                common = Model(*shared.value)
                n = common.continuations(word_of(keys))
                here = n >= 0
                near = np.bincount(doc[here], -np.log(common.word(n[here])), block.n)
                head = zstandard.compress(bundle([sink.getvalue().to_pybytes(), words.astype(np.int64).tobytes(), near.tobytes()]), 1)
                buckets, bodies = [], []

                def put(first_bucket: int, key: np.ndarray, of: np.ndarray, shard_of, code, more) -> None:
                    """Each (key, document) with its times, by bucket; more: what else belongs to these."""
                    order = np.argsort(key, kind="stable")  # documents stay in order within a key
                    key, of = key[order], of[order]
                    new = np.ones(len(key), bool)
                    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
                    at = np.flatnonzero(new)
                    times = np.diff(np.append(at, len(key))).astype(np.uint32)
                    key, of = key[at], of[at]
                    shard = shard_of(key)
                    order = np.argsort(shard, kind="stable")
                    cuts = np.searchsorted(shard[order], np.arange(n_buckets + 1))
                    extra_plane = more(key, of, times)
                    for k in range(n_buckets):
                        i = order[cuts[k] : cuts[k + 1]]
                        if len(i):
                            first, m = grouped(key[i])
                            bodies.append(bundle([np.int64(block.n).tobytes(), B.planes(m.astype(np.uint32)), B.planes(of[i].astype(np.uint32)), B.planes(times[i]), *extra_plane(i), *code(key[i][first])]))
                            buckets.append(first_bucket + k)

                def own_histories(key: np.ndarray, of: np.ndarray, times: np.ndarray):
                    mine = np.flatnonzero(own[of])
                    count = np.zeros(len(key), np.uint32)
                    if len(mine):
                        _, at = np.unique(of[mine].astype(np.uint64) << np.uint64(WORD_BITS) | histories(key[mine]), return_inverse=True)
                        count[mine] = np.bincount(at, times[mine])[at]
                    return lambda i: [B.planes(count[i])]

                far = common.maybe_seen(keys)
                put(0, keys[far], doc[far], lambda k: shards(k, n_buckets, heavy), coded_keys, own_histories)
                rare = np.flatnonzero(~here)
                put(n_buckets, word_of(keys[rare]).astype(np.uint64), doc[rare], lambda k: word_shard(k, n_buckets), lambda k: [B.deltas(k)], lambda *_: lambda i: [])
                buckets.append(-1 - (number * 0x9E3779B1 >> 16) % (1 << 20))  # what needs no counts, spread over groups of its own
                bodies.append(None)
                yield pa.record_batch([pa.array(buckets, pa.int32()), pa.array([number] * len(buckets)), pa.array(bodies, pa.binary()), pa.array([None if k >= 0 else head for k in buckets], pa.binary())], names=["bucket", "block", "body", "head"])
                number += 1

    def score(frame: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        B.settle_memory()
        bucket = int(frame.bucket.iloc[0]) if len(frame) else -1
        common = Model(*shared.value)
        known, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        own_counts: tuple = (known, n, n, *contexts(known, n))
        if 0 <= bucket < n_buckets and len(counts):
            mine, told = counts[counts["shard"] < 0].iloc[0], counts[counts["shard"] >= 0].sort_values("shard")
            parts = unbundle(mine.counts)
            known, n = decoded_keys(parts), B.unplanes(parts[3], np.uint32).astype(np.int64)
            followers = np.concatenate([B.unplanes(x, np.uint32) for x in told.words])
            own_counts = (known, n, followers[np.searchsorted(B.undeltas(unbundle(mine.words)[0]), word_of(known))], *contexts(known, n))
        elif bucket >= n_buckets and len(counts):
            parts = unbundle(counts.words.iloc[0])
            known, n = B.undeltas(parts[0]), B.unplanes(parts[1], np.uint32).astype(np.int64)
        out = []
        for body in frame.body if bucket >= 0 else []:
            parts = unbundle(body)
            size = int(np.frombuffer(parts[0], np.int64)[0])
            m, doc, times = (B.unplanes(x, np.uint32).astype(np.int64) for x in parts[1:4])
            if bucket < n_buckets:
                own_history = B.unplanes(parts[4], np.uint32).astype(np.float64)
                ln = gains(common, own_counts, np.repeat(decoded_keys(parts[5:8]), m), times, own_history > 0, own_history)
            else:
                key = np.repeat(B.undeltas(parts[4]), m)
                at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
                ln = np.log(common.word(np.where(known[at] == key, n[at], 0) if len(known) else np.zeros(len(key))))
            out.append(np.bincount(doc, -ln * times, size).astype(np.float32).tobytes())
        B.trim()
        return pd.DataFrame({"block": frame.block, "bucket": frame.bucket, "sums": out or None, "head": frame["head"]})

    answers = kept.mapInArrow(send, "bucket int, block long, body binary, head binary").groupBy("bucket").cogroup(counted.groupBy("bucket")).applyInPandas(score, "block long, bucket int, sums binary, head binary")
    ddl = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in keep)

    def total(batch: pa.Table) -> pa.Table:
        rows = sorted(batch.to_pylist(), key=lambda r: r["bucket"])
        extra, words, near = unbundle(zstandard.decompress(rows[0]["head"]))
        nll = np.sum([np.frombuffer(near), *[np.frombuffer(r["sums"], np.float32) for r in rows[1:]]], 0, dtype=np.float64)
        table = pa.ipc.open_stream(extra).read_all()
        return table.append_column("n_words", pa.array(np.frombuffer(words, np.int64))).append_column("nll", pa.array(nll))

    return answers.groupBy("block").applyInArrow(total, f"{ddl}, n_words long, nll double")


def judged(docs: DataFrame, labels: DataFrame, quantile: float, prior: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """One row per document: __id, __lang, __mark (hash of the text), n_words, perplexity, score, threshold, kept."""
    spark = docs.sparkSession
    good = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__label")).agg(F.min(F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))).alias("__own")).where("__own")
    size = good.count()
    told = docs.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), F.xxhash64(text_col).alias("__mark"), F.col(text_col).cast("binary").alias("__text"))
    same = F.col("__id") == F.col("__label")
    if size <= BROADCAST_IDS:
        joined = told.join(F.broadcast(good), same, "left")
    else:  # in an order of its own, so that a task that runs again makes the same parts
        joined = told.join(good, same, "left").sortWithinPartitions("__id", "__lang", "__mark", "__text")
    joined = joined.select("__id", "__lang", "__mark", "__text", F.coalesce("__own", F.lit(False)).alias("__own"))
    trusted = joined.where("__own").select("__text")
    n_bytes = trusted.agg(F.sum(F.length("__text"))).first()[0] or 0
    n_buckets = max(1, min(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2), -(-n_bytes // B.BUCKET_BYTES))
    model, tables = train(trusted, n_buckets)
    rows = None
    for i in range(ROUNDS):  # one after the other, so that the exchange of one only takes disk at a time
        some = joined.where(F.pmod("__mark", F.lit(ROUNDS)) == i)
        done = B.kept(scored(some, model, tables, n_buckets, ["__id", "__lang", "__mark", "__own"]))
        rows = done if rows is None else rows.union(done)
    del model, tables, some, done
    word = F.when(F.col("n_words") > 0, F.col("nll") / F.col("n_words"))
    trusted = rows.where(F.col("__own") & (F.col("n_words") > 0))
    mean = F.sum("nll") / F.sum("n_words")
    means = trusted.groupBy("__lang").agg(mean.alias("__mean"))
    overall = trusted.agg(mean.alias("__m")).first()[0]
    shrunk = (F.col("nll") + prior * F.coalesce(F.col("__mean"), F.lit(overall or 0.0))) / (F.col("n_words") + prior)
    with_means = rows.join(means.withColumnRenamed("__lang", "__l"), F.col("__lang").eqNullSafe(F.col("__l")), "left").withColumn("score", F.when(F.col("n_words") > 0, shrunk))
    at = F.percentile_approx("score", quantile, 100_000)
    own = with_means.where(F.col("__own") & F.col("score").isNotNull())
    limits = own.groupBy(F.col("__lang").alias("__k")).agg(at.alias("__limit"))
    general = own.agg(at.alias("x")).first()[0]
    limit = F.coalesce(F.col("__limit"), F.lit(general if general is not None else math.inf))
    out = with_means.join(limits, F.col("__lang").eqNullSafe(F.col("__k")), "left")
    return out.select("__id", "__lang", "__mark", "n_words", F.exp(word).alias("perplexity"), "score", limit.alias("threshold"), F.coalesce(F.col("score") <= limit, F.lit(False)).alias("kept"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, prior: int = PRIOR, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, lang, n_words, perplexity, score (shrunk, log), threshold, kept."""
    return judged(docs, labels, quantile, prior, id_col, text_col, lang_col).withColumnsRenamed({"__id": id_col, "__lang": lang_col}).drop("__mark")


def kept_documents(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, prior: int = PRIOR, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without those rejected. A verdict depends on id, language and text alone, so by these a row is told, null ids included."""
    gone = judged(docs, labels, quantile, prior, id_col, text_col, lang_col).where("NOT kept")
    gone = B.kept(gone.select(F.col("__id").alias("i"), F.col("__lang").alias("l"), F.col("__mark").alias("m")).distinct())
    told = B.beside(docs, id=F.col(id_col), lang=F.col(lang_col), mark=F.xxhash64(text_col))
    same = F.col("id").eqNullSafe(F.col("i")) & F.col("lang").eqNullSafe(F.col("l")) & (F.col("mark") == F.col("m"))
    return B.unpacked_rows(told.join(F.broadcast(gone) if gone.count() <= BROADCAST_GONE else gone, same, "left_anti"), docs.columns)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return classify(docs, labels)
