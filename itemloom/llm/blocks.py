"""Blocks of whole documents, and exchanges of sorted hashes between them.

A block is a run of documents, in order of their ids, held as one compressed row. Operators that compare every
window of every text with every other text work on blocks: a block sends its distinct window hashes,
sorted and delta-coded, to hash buckets; a bucket answers each block with a few bits per hash. So a
window costs a few bytes of shuffle rather than a row, a frequent window is sent once per block
however often it occurs, and no bucket ever holds more than one entry per block and hash.

Blocks are cut by size alone: equal and null ids may span any number of them, and their order means nothing.
A block is known by `uid` (partition and number), so blocks are stored before they are worked on.

Null ids order before all others (as the smallest id); null texts are kept apart from empty ones.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Text bytes of a block, unless one text is longer. 15 to 30 times as much memory is used while a block is worked on.
BLOCK_BYTES = 4 << 20
#: Text bytes of a bucket, on average, if there would otherwise be more: there are as many more buckets.
BUCKET_BYTES = 64 << 20
#: Bits by which a hash that only screens is longer than the number of bytes of all texts.
SCREEN_BITS = 8
NO_ID = -(1 << 63)
#: Compression of blocks, which are stored once and moved once.
LEVEL = 3
#: Odd multipliers of the polynomial hash and of the finalizer.
BASE = 0x9E3779B97F4A7C15
MIX = 0xD6E8FEB86659FD93
#: Fixed words of the contracts are separated by these bytes: space, and tab to carriage return.
SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
BLOCK_SCHEMA = "uid long, n_docs long, n_bytes long, body binary"
#: Documents of a block, and blocks of a partition: both have 22 bits, and partitions 19, in the numbers of rows.
MANY = 22

def trim() -> None:
    """Give what is left of small objects back to the system."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def settle_memory() -> None:
    """In a worker: large arrays, Arrow's as well, go back to the system as soon as they are freed, rather than stay while it waits."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, 1 << 20)
    pa.set_memory_pool(pa.system_memory_pool())


# ---------------------------------------------------------------- hashing


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64-bit words."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(MIX)
    return x ^ (x >> np.uint64(29))


def rolled(x: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hashes (polynomials in BASE modulo 2**64) of every k consecutive words of x, by doubling."""
    if len(x) < k:
        return np.zeros(0, np.uint64)
    out, done, power, width = None, 0, x, 1
    while True:
        if k & width:
            if out is None:
                out, done = power, width
            else:
                n = len(x) - done - width + 1
                out = out[:n] * np.uint64(pow(BASE, width, 1 << 64)) + power[done : done + n]
                done += width
        if done == k:
            return out[: len(x) - k + 1]
        n = len(power) - width
        power = power[:n] * np.uint64(pow(BASE, width, 1 << 64)) + power[width : width + n]
        width *= 2


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans, eight bytes at a time over all spans that are still longer."""
    n = ends - starts
    out = mixed(n.astype(np.uint64) * np.uint64(BASE) + np.uint64(seed * 2 + 1))
    if not len(n) or not len(data):
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    left = np.flatnonzero(n > 0)
    at = 0
    while len(left):
        lane = lanes[starts[left] + at]
        rest = n[left] - at
        short = rest < 8
        lane = np.where(short, lane & ((np.uint64(1) << (np.minimum(rest, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1)), lane)
        out[left] = mixed((out[left] ^ lane) * np.uint64(BASE))
        at += 8
        left = left[rest > 8]
    return out


def word_spans(data: np.ndarray, doc_ends: np.ndarray, separators: bytes = SEPARATORS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document indexes of the words of texts that lie one behind the other."""
    table = np.zeros(256, bool)
    table[list(separators)] = True
    gap = table[data]
    word = ~gap
    first = word.copy()
    first[1:] &= gap[:-1]
    last = word
    last[:-1] &= gap[1:]
    edge = doc_ends[(doc_ends > 0) & (doc_ends < len(data))]  # words never cross documents
    first[edge] |= ~gap[edge]
    last[edge - 1] |= ~gap[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(doc_ends, starts, "right")


def joined_words(block: Block, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> list[bytes]:
    """Each document's words, joined by one space."""
    lens = (ends - starts).astype(np.int64) + 1
    to = np.concatenate([[0], np.cumsum(lens)])
    cuts = to[np.searchsorted(doc, np.arange(block.n + 1))]
    out = np.full(int(to[-1]), 0x20, np.uint8)
    step = 1 << 16
    for a in range(0, len(lens), step):  # in parts, for the sake of memory
        n, base = lens[a : a + step] - 1, to[a : a + step]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(base[: len(n)], n) + within] = block.data[np.repeat(starts[a : a + step], n) + within]
    raw = out.tobytes()
    return [raw[a : max(a, b - 1)] for a, b in zip(cuts, cuts[1:])]


# ---------------------------------------------------------------- blocks


@dataclass
class Block:
    ids: np.ndarray
    null: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    extra: bytes

    @property
    def n(self) -> int:
        return len(self.ids)

    def rows(self) -> pa.Table:
        """The columns that were carried along."""
        return pa.ipc.open_stream(self.extra).read_all()

    def text(self, i: int) -> bytes | None:
        return None if self.null[i] else self.data[self.ends[i - 1] if i else 0 : self.ends[i]].tobytes()


def packed(ids: np.ndarray, null: np.ndarray, lens: np.ndarray, parts: list, extra: bytes) -> bytes:
    head = np.array([len(ids), int(lens.sum()), len(extra)], np.int64)
    return zstandard.compress(b"".join([head.tobytes(), ids.astype(np.int64).tobytes(), null.astype(np.uint8).tobytes(), lens.astype(np.int64).tobytes(), *parts, extra]), LEVEL)


def unpacked(body: bytes) -> Block:
    settle_memory()
    trim()  # what the last block has left
    raw = zstandard.decompress(body)
    n, size, more = np.frombuffer(raw, np.int64, 3)
    at = 24
    ids = np.frombuffer(raw, np.int64, n, at)
    null = np.frombuffer(raw, np.uint8, n, at + 8 * n).astype(bool)
    lens = np.frombuffer(raw, np.int64, n, at + 9 * n)
    at += 17 * int(n)
    return Block(ids, null, np.cumsum(lens), np.frombuffer(raw, np.uint8, size, at), raw[at + int(size) : at + int(size) + int(more)])


def _packer(target: int, carries: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle_memory()
        held: list[tuple] = []
        size = 0
        uid = TaskContext.get().partitionId() << MANY

        def flush() -> pa.RecordBatch:
            nonlocal uid, size
            ids, null, lens = (np.concatenate([h[i] for h in held]) for i in range(3))
            parts, rest = [h[3] for h in held], None
            if carries:
                rest = pa.Table.from_batches([h[4] for h in held])
            if (ids[1:] < ids[:-1]).any():
                order = np.argsort(ids, kind="stable")
                whole, ends = b"".join(parts), np.cumsum(lens)
                parts = [whole[ends[i] - lens[i] : ends[i]] for i in order]
                ids, null, lens = ids[order], null[order], lens[order]
                rest = rest.take(pa.array(order)) if carries else None
            extra = b""
            if carries:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest.schema) as out:
                    out.write_table(rest.combine_chunks())
                extra = sink.getvalue().to_pybytes()
            body = packed(ids, null, lens, parts, extra)
            held.clear()
            uid, size = uid + 1, 0
            return pa.record_batch([pa.array([uid - 1]), pa.array([len(ids)]), pa.array([int(lens.sum())]), pa.array([body], pa.binary())], names=["uid", "n_docs", "n_bytes", "body"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            text = batch.column(1).fill_null(b"")
            wide = pa.types.is_large_binary(text.type)
            offsets = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32, n + 1, text.offset * (8 if wide else 4)).astype(np.int64)
            data = text.buffers()[2]
            rest = batch.select(range(2, batch.num_columns)) if carries else None
            at = 0
            while at < n:
                end = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + target - size))))
                lens = np.diff(offsets[at : end + 1])
                part = bytes(memoryview(data)[offsets[at] : offsets[end]]) if data is not None and offsets[end] > offsets[at] else b""
                held.append((ids[at:end], null[at:end], lens, part, rest.slice(at, end - at) if carries else None))
                size += len(part) + 16 * (end - at)
                at = end
                if size >= target:
                    yield flush()
        if held:
            yield flush()
        trim()

    return run


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[Column] | None = None, size: int = BLOCK_BYTES) -> DataFrame:
    """Rows (uid, n_docs, n_bytes, body); to be stored before anything depends on a uid."""
    chosen = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("binary").alias("__text"), *(carry or []))
    return chosen.mapInArrow(_packer(size, bool(carry)), BLOCK_SCHEMA)


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[Column] | None = None, size: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """The blocks, computed once and kept, and the bytes of all texts."""
    seen = Observation()
    rows = kept(blocks(docs, id_col, text_col, carry, size).observe(seen, F.sum("n_bytes").alias("bytes")))
    return rows, int(seen.get["bytes"] or 0)


def shared_dir(spark: SparkSession) -> None:
    """Make sure that checkpoints have a folder: the cluster's, or in local runs without one a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not named and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="itemloom-"))


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and stored in the shared folder. Shuffle files of what came before, if nothing needs it any more, go first."""
    shared_dir(df.sparkSession)
    release(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Have Spark's cleaner drop the files of frames that are gone, rather than when the driver happens to collect its garbage.

    With spark.cleaner.referenceTracking.cleanCheckpoints these are their checkpoints as well.
    """
    gc.collect()
    waiting = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    while waiting:  # what Python has dropped; otherwise the JVM is told about once a second
        told = waiting.pop()
        if not isinstance(told, tuple):
            waiting.append(told)
            break
        told[0].garbage_collect_object(told[1], False)
    spark.sparkContext._jvm.System.gc()


def rest(spark: SparkSession) -> None:
    """Have each executor collect its garbage, by one task each, and give back the heap that this leaves empty.

    A JVM keeps the heap that earlier steps needed, beside the Python workers of the next one. Executors that are
    busy with other work, or join later, may be passed over: that costs memory alone.
    """
    release(spark)
    n = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)  # the driver is one of them
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def beside(docs: DataFrame, **more: Column) -> DataFrame:
    """Rows (row, and what `more` names): docs' rows as one struct each, whatever their columns' names."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(name) for name, c in more.items()])


def unpacked_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"row.`{c}`") for c in columns])


def map_rows(df: DataFrame, of: Callable[[Iterator[tuple]], Iterator[tuple]], ddl: str) -> DataFrame:
    """mapInArrow on plain tuples, of() sees all of a partition: exact integers beside nulls, batches of bounded size."""
    schema = to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                yield from zip(*[c.to_pylist() for c in whole.slice(at, 256).columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle_memory()
        rows: list[tuple] = []
        size = 0
        for row in of(plain(batches)):
            rows.append(row)
            size += 64 + sum(len(x) for x in row if isinstance(x, (bytes, str)))
            if size > 8 << 20:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)
        del rows
        trim()

    return df.mapInArrow(run, ddl)


# ---------------------------------------------------------------- hash exchange


def bucket_count(spark: SparkSession, n_bytes: int = 0) -> int:
    return max(1, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // BUCKET_BYTES))


def screening_bits(n_bytes: int) -> int:
    """Of hashes that only screen: so many that of 2**SCREEN_BITS unlike ones at most about one is equal to another by chance."""
    return min(64, max(32, n_bytes.bit_length() + SCREEN_BITS))


def top_bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes & np.uint64((1 << 64) - (1 << 64 - bits))


def planes(x: np.ndarray) -> bytes:
    """Integers as byte planes, compressed: leading zero bytes and equal bytes cost nothing."""
    x = np.ascontiguousarray(x)
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes(), 1)


def unplanes(raw: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    x = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(x.T).view(dtype).reshape(-1)


def deltas(x: np.ndarray) -> bytes:
    """A sorted array, by differences."""
    return planes(np.diff(x, prepend=x[:1] * 0))


def undeltas(raw: bytes, dtype=np.uint64) -> np.ndarray:
    return np.cumsum(unplanes(raw, dtype), dtype=dtype)


def bucket_edges(n: int) -> np.ndarray:
    return np.array([(i << 64) // n for i in range(1, n)], np.uint64)


def bucketed(hashes: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the parts of a sorted array that aren't empty."""
    cuts = np.concatenate([[0], np.searchsorted(hashes, bucket_edges(n)), [len(hashes)]])
    return [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]


def sent(block_rows: DataFrame, hashes_of, n: int, bits: int = 64) -> DataFrame:
    """Rows (bucket, uid, hashes): the upper bits of what hashes_of(Block) gives of each block, without repeats."""
    low = np.uint64(64 - bits)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uid, body in zip(frame.uid, frame.body):
                h = np.unique(top_bits(hashes_of(unpacked(body)), bits))
                parts = bucketed(h, n)
                yield pd.DataFrame({"bucket": np.array([p[0] for p in parts], np.int32), "uid": np.full(len(parts), uid, np.int64), "hashes": [deltas(h[a:b] >> low) for _, a, b in parts]})

    return block_rows.select("uid", "body").mapInPandas(run, "bucket int, uid long, hashes binary")


def merged(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's hashes in order, the row of each, and each one's place in the rows, one behind the other."""
    settle_memory()
    lists = [undeltas(x) for x in frame.hashes]
    every = np.concatenate(lists)
    row = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
    order = np.argsort(every, kind="stable")
    return every[order], row[order], order


def flags_joined(frame: pd.DataFrame, n: int) -> np.ndarray:
    """What the buckets answered to a block, one byte for each of its n hashes."""
    if not len(frame):
        return np.zeros(n, np.uint8)
    return np.concatenate([np.frombuffer(zstandard.decompress(x), np.uint8) for x in frame.sort_values("bucket")["flags"]])


def shared_elsewhere(h: np.ndarray, frame: pd.DataFrame, bits: int) -> np.ndarray:
    """Of a block's hashes, the answers to their upper bits."""
    if not len(h):
        return np.zeros(0, np.uint8)
    distinct, back = np.unique(top_bits(h, bits), return_inverse=True)
    return flags_joined(frame, len(distinct))[back]


def answered(rows: DataFrame, judge) -> DataFrame:
    """Rows (uid, bucket, flags): judge(row of each hash, group of equal hashes) gives a byte for each of a bucket's hashes, in order."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        h, row, order = merged(frame)
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        flags = np.empty(len(h), np.uint8)
        flags[order] = judge(row, np.cumsum(first) - 1)
        sizes = np.bincount(row, minlength=len(frame))
        parts = np.split(flags, np.cumsum(sizes)[:-1])
        return pd.DataFrame({"uid": frame.uid, "bucket": frame.bucket.astype("int32"), "flags": [zstandard.compress(p.tobytes(), 1) for p in parts]})

    return rows.groupBy("bucket").applyInPandas(run, "uid long, bucket int, flags binary")


def in_several(row: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether each hash is in more than one block: blocks send each of theirs once."""
    return (np.bincount(group) > 1)[group]
