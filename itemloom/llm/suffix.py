"""Suffix-array deduplication by a common-prefix-aware distributed merge sort.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id.

Which suffixes are sorted. Every string of `length` bytes is assigned to one of its own places: where the
hash of the KMER bytes there is least (leftmost on ties). Equal strings have that place at the same
offset, so strings need only be compared around equal places ("anchors", about 8 % of all positions),
and none is lost. A first exchange of the upper bits of the anchors' hashes (three bytes or so each, once a
block) finds those that one block alone has; their strings are unique but for those of this block.

How they are sorted. Each block sorts the suffixes at its other anchors (the bytes to the right as far as
the anchor's strings reach, then those to the left, outwards), front-codes each sorted run (the length of
the prefix shared with the one before, and the rest) and sends one run to each bucket. A bucket merges
its runs with a loser tree that keeps, for each run's head, the prefix it shares with the last winner:
heads with different values are ordered by these alone, heads with equal ones are compared from there on,
so no known prefix is compared again. The merged order and its common prefixes give, for every offset,
the classes of strings that are equal to the right; those to the left come from sorting the left sides.
Strings that agree in both are equal, and all but those of the smallest id are repeated.

Hot places. Suffixes that occur several times in one block are sent once, so a frequent passage costs a bucket one
entry a block. A place that more than HOT blocks share, each perhaps with other bytes around it, is sent twice: for
the strings that reach BESIDE bytes or more beyond its right end, to the bucket of these bytes, and for the others,
which then reach as far to its left, to the bucket of the bytes there. So its strings spread over buckets as their
surroundings do, and equal ones still meet.

Defined results: null and empty texts have no bytes and no spans; a text of any length is one piece of work, of some
20 times its size; null ids count as the smallest id; rows with equal ids are judged against smaller ids only, in
whichever blocks they are; an empty table has no rows; `cleaned` keeps all other columns, whatever their names.
Hashes only choose places and buckets, and drop anchors without any equal hash; equality is decided on the bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.llm import blocks as B

LENGTH = 50
KMER = 25
#: Blocks that share a place from which on it is hot, and the bytes beside it that then choose buckets.
HOT = 256
BESIDE = 12
#: Window starts worked on at once; small enough for a CPU cache.
PIECE = 1 << 16


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if step < width else x


def window_starts(block: B.Block, length: int) -> np.ndarray:
    """Whether a whole window starts at each byte."""
    ok = np.ones(len(block.data), np.int8)
    ends = block.ends
    starts = np.concatenate([[0], ends[:-1]])
    some = ends > starts
    a, b = np.maximum(starts, ends - length + 1)[some], ends[some]
    step = np.zeros(len(ok) + 1, np.int8)
    np.add.at(step, a, 1)
    np.add.at(step, b, -1)
    ok -= np.cumsum(step[:-1], dtype=np.int8)
    return ok.astype(bool)


def anchors(block: B.Block, length: int, kmer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, their hashes, and the least and the greatest offset of each place in the windows it stands for."""
    n = len(block.data) - length + 1
    table = B.mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(B.BASE))
    high, low = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
    valid = window_starts(block, length)
    found: list[list[np.ndarray]] = [[], [], [], []]
    for a in range(0, max(0, n), PIECE):
        b = min(n, a + PIECE)
        ok = valid[a:b]
        if not ok.any():
            continue
        h = B.mixed(B.rolled(table[block.data[a : b + length - 1]], kmer))
        place = (sliding_least((h & high) | np.arange(len(h), dtype=np.uint64), length - kmer + 1) & low).astype(np.int64)
        s = np.flatnonzero(ok)
        place = place[s]
        first = np.ones(len(s), bool)
        first[1:] = place[1:] != place[:-1]
        last = np.append(first[1:], True)
        for to, x in zip(found, (place[first] + a, h[place[first]], s[first] + a, s[last] + a)):
            to.append(x)
    if not found[0]:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    place, h, first, last = map(np.concatenate, found)
    new = np.ones(len(place), bool)  # a place at a seam stands in both pieces
    new[1:] = place[1:] != place[:-1]
    old = np.append(new[1:], True)
    place, h, first, last = place[new], h[new], first[new], last[old]
    # Anchors have small hashes, as the least of their windows; hashed once more, they spread over all buckets.
    return place, B.mixed(h * np.uint64(B.BASE)), place - last, place - first


def shared_anchors(block: B.Block, told: pd.DataFrame, length: int, kmer: int, bits: int) -> tuple[np.ndarray, ...]:
    """Of the anchors whose hash may occur in another block, or occurs under several ids of this: places, hashes, offsets, ids.

    Hot ones come twice, each with its share of the offsets and with a hash of the bytes beside that these strings share.
    """
    place, h, least, most = anchors(block, length, kmer)
    owner = block.ids[np.searchsorted(block.ends, place, "right")]
    if not len(h):
        return place, h, least, most, owner
    flags = B.shared_elsewhere(h, told, bits)
    distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
    last = np.zeros(len(distinct), np.int64)
    last[back] = np.arange(len(h))
    some = (flags > 0) | (owner[last] > owner[first])[back]  # a block is in order of its ids
    hot = flags[some] > 1
    place, h, least, most, owner = (x[some] for x in (place, h, least, most, owner))
    if not hot.any() or length - kmer < 2 * BESIDE:
        return place, h, least, most, owner
    limit = length - kmer - BESIDE  # a string that starts at most so far left reaches BESIDE bytes beyond the place
    out = [[x[~hot]] for x in (place, h, least, most, owner)]
    for side, keep in enumerate((hot & (least <= limit), hot & (most > limit))):
        p = place[keep]
        edge = (p + kmer, p + kmer + BESIDE) if not side else (p - limit - 1, p)
        own = B.mixed(h[keep] * np.uint64(B.BASE) + B.span_hashes(block.data, *edge, side + 1))
        low, high = (least[keep], np.minimum(most[keep], limit)) if not side else (np.maximum(least[keep], limit + 1), most[keep])
        for to, x in zip(out, (p, own, low, high, owner[keep])):
            to.append(x)
    return tuple(np.concatenate(x) for x in out)


def words_at(block: B.Block, place: np.ndarray, right: np.ndarray, left: np.ndarray, n_right: int, n_left: int) -> list[np.ndarray]:
    """The bytes right of each place, and those left of it outwards, as big-endian words; bytes beyond the given counts are 0."""
    front = 8 * n_left
    padded = np.zeros(front + len(block.data) + 8 * n_right + 8, np.uint8)
    padded[front : front + len(block.data)] = block.data
    lanes = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))

    def cut(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        n = np.clip(n, 0, 8).astype(np.uint64)
        return np.where(n == 0, np.uint64(0), x & (np.uint64(0xFFFFFFFFFFFFFFFF) << (np.minimum(np.uint64(8) - n, np.uint64(7)) * np.uint64(8))))

    out = [cut(lanes[front + place + 8 * j].byteswap(), right - 8 * j) for j in range(n_right)]
    return out + [cut(lanes[front + place - 8 * (j + 1)].copy(), left - 8 * j) for j in range(n_left)]


def shared_prefix(words: list[np.ndarray]) -> np.ndarray:
    """Bytes that each row shares with the one before; 0 for the first."""
    n = len(words[0])
    out = np.full(n, 8 * len(words), np.int64)
    if n:
        out[0] = 0
    left = np.arange(1, n)
    for j, w in enumerate(words):
        x = w[left] ^ w[left - 1]
        differ = np.flatnonzero(x)
        y, at = x[differ], left[differ]
        same = np.zeros(len(y), np.int64)
        for b in range(1, 8):
            same += (y >> np.uint64(64 - 8 * b)) == 0
        out[at] = 8 * j + same
        left = left[x == 0]
        if not len(left):
            break
    return out


def sorted_run(block: B.Block, told: pd.DataFrame, length: int, kmer: int, n_buckets: int, bits: int) -> dict[str, np.ndarray | list]:
    """The block's distinct suffixes in order of (bucket, bytes), and for each shared anchor which of them it is."""
    place, h, least, most, owner = shared_anchors(block, told, length, kmer, bits)
    words = words_at(block, place, length - least, most, -(-length // 8), -(-(length - kmer) // 8))
    bucket = np.searchsorted(B.bucket_edges(n_buckets), h, "right")
    order = np.lexsort([owner, most, least, *reversed(words), bucket])
    words = [w[order] for w in words]
    place, least, most, owner, bucket = (x[order] for x in (place, least, most, owner, bucket))
    new = np.ones(len(place), bool)
    if len(place):
        same = (bucket[1:] == bucket[:-1]) & (least[1:] == least[:-1]) & (most[1:] == most[:-1])
        for w in words:
            same &= w[1:] == w[:-1]
        new[1:] = ~same
    return {"place": place, "owner": owner, "least": least, "most": most, "of": np.cumsum(new) - 1, "new": new, "bucket": bucket[new], "words": [w[new] for w in words]}


def front_coded(words: list[np.ndarray]) -> tuple[bytes, bytes]:
    shared = shared_prefix(words)
    rows = np.ascontiguousarray(np.stack(words, 1).astype(">u8")).view(np.uint8).reshape(len(shared), -1)
    return zstandard.compress(shared.astype(np.uint8).tobytes(), 1), zstandard.compress(rows[np.arange(rows.shape[1]) >= shared[:, None]].tobytes(), 1)


def front_decoded(shared: bytes, rest: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    shared = np.frombuffer(zstandard.decompress(shared), np.uint8).astype(np.int64)
    rest = np.frombuffer(zstandard.decompress(rest), np.uint8)
    n = len(shared)
    start = np.cumsum(width - shared) - (width - shared) - shared
    rows = np.empty((n, width), np.uint8)
    for c in range(width):
        from_row = np.maximum.accumulate(np.where(shared <= c, np.arange(n), 0))
        rows[:, c] = rest[start[from_row] + c]
    return shared, rows


def merge_runs(shared: list[list[int]], strings: list[list[bytes]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs with a loser tree: the run of each output, and the bytes it shares with the output before.

    shared[r][i]: the bytes that string i of run r shares with string i - 1. Equal strings come in order of runs.
    """
    runs, end = len(strings), 1 << 30
    if not runs:
        return [], []
    width = len(strings[0][0])
    leaves = 1
    while leaves < runs:
        leaves *= 2
    head = [0] * leaves  # next string of each run
    prefix = [0] * runs + [-1] * (leaves - runs)  # shared with the last output; -1: the run is at its end
    now: list[bytes] = [s[0] for s in strings] + [b""] * (leaves - runs)
    size = [len(s) for s in strings] + [0] * (leaves - runs)
    tree = [0] * leaves

    def duel(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's prefix becomes the one it shares with the winner."""
        p, q = prefix[a], prefix[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        if p < 0:
            return (a, b)
        x, y = now[a], now[b]
        z = int.from_bytes(x[p:], "big") ^ int.from_bytes(y[p:], "big")
        same = width - (z.bit_length() + 7) // 8
        if same == width:
            a, b = (a, b) if a < b else (b, a)
        elif x[same] > y[same]:
            a, b = b, a
        prefix[b] = same
        return a, b

    def build(node: int) -> int:
        if node >= leaves:
            return node - leaves
        win, lose = duel(build(2 * node), build(2 * node + 1))
        tree[node] = lose
        return win

    win = build(1) if leaves > 1 else 0
    out_run: list[int] = []
    out_shared: list[int] = []
    for _ in range(sum(size)):
        out_run.append(win)
        out_shared.append(prefix[win])
        i = head[win] = head[win] + 1
        if i < size[win]:
            now[win] = strings[win][i]
            prefix[win] = shared[win][i]
        else:
            prefix[win] = -1
        p = prefix[win]
        node = (win + leaves) >> 1
        while node:
            other = tree[node]
            q = prefix[other]
            if q > p:
                tree[node], win, p = win, other, q
            elif q == p >= 0:
                x, y = now[win], now[other]
                z = int.from_bytes(x[p:], "big") ^ int.from_bytes(y[p:], "big")
                same = width - (z.bit_length() + 7) // 8
                if same == width:
                    if other < win:
                        prefix[win] = same
                        tree[node], win = win, other
                    else:
                        prefix[other] = same
                elif x[same] > y[same]:
                    prefix[win] = same
                    tree[node], win = win, other
                else:
                    prefix[other] = same
            node >>= 1
    return out_run, out_shared


def repeated_offsets(shared: np.ndarray, left: list[np.ndarray], least: np.ndarray, most: np.ndarray, owner: np.ndarray, length: int, kmer: int) -> np.ndarray:
    """For suffixes in order, with the bytes each shares with the one before: bit d is set if the window that
    starts d bytes left of it is also that of a suffix with a smaller owner."""
    n = len(shared)
    bits = np.zeros(n, np.uint64)
    by_left = np.lexsort(left[::-1])
    left_shared = shared_prefix([w[by_left] for w in left])
    for d in range(length - kmer + 1):
        some = np.flatnonzero((least <= d) & (d <= most))
        if len(some) < 2:
            continue
        right_class = np.cumsum(shared < length - d)
        left_class = np.empty(n, np.int64)
        left_class[by_left] = np.cumsum(left_shared < d)
        key = (right_class * (n + 1) + left_class)[some]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(first)
        smallest = np.minimum.reduceat(owner[some][order], at)
        late = owner[some][order] > np.repeat(smallest, np.diff(np.append(at, len(key))))
        bits[some[order[late]]] |= np.uint64(1 << d)
    return bits


def removed_bytes(block: B.Block, told: pd.DataFrame, length: int, kmer: int, n_buckets: int, bits: int) -> np.ndarray:
    """Whether each byte of the block goes. told: the answers of both exchanges (kind 0 and 1)."""
    run = sorted_run(block, told[told.kind == 0], length, kmer, n_buckets, bits)
    start = np.zeros(len(block.data) + length, np.int8)
    if len(run["place"]):
        answers = told[told.kind == 1].sort_values("bucket")
        bits = np.concatenate([B.unplanes(x, np.uint64) for x in answers["flags"]])[run["of"]]
        first_owner = run["owner"][run["new"]][run["of"]]  # owners are in order within equal suffixes
        for d in range(length - kmer + 1):
            here = (run["least"] <= d) & (d <= run["most"])
            seen = here & ((run["owner"] > first_owner) | (bits >> np.uint64(d) & np.uint64(1)).astype(bool))
            start[run["place"][seen] - d] = 1
    start[length:] -= start[: len(block.data)].copy()
    return np.cumsum(start[: len(block.data)], dtype=np.int8) > 0


def exchanges(docs: DataFrame, length: int, kmer: int, id_col: str, text_col: str, carry: list | None = None) -> tuple[DataFrame, DataFrame, int, int]:
    """The stored blocks, rows (uid, kind, bucket, flags) with both exchanges' answers, and how many buckets and screening bits there are."""
    rows, n_bytes = B.stored(docs, id_col, text_col, carry)
    n_buckets, bits = B.bucket_count(docs.sparkSession, n_bytes), B.screening_bits(n_bytes)
    asked = B.sent(rows, lambda block: anchors(block, length, kmer)[1], n_buckets, bits)

    def shared_by_blocks(row, group):
        blocks = np.bincount(group)
        return ((blocks > 1).astype(np.uint8) + (blocks > HOT))[group]

    screened = B.kept(B.answered(asked, shared_by_blocks).withColumn("kind", F.lit(0)))

    def runs(mine: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
        out = []
        for uid, body in zip(mine.uid, mine.body):
            run = sorted_run(B.unpacked(body), flags, length, kmer, n_buckets, bits)
            new = run["new"]
            cuts = np.searchsorted(run["bucket"], np.arange(n_buckets + 1))
            least, most, owner = (run[k][new] for k in ("least", "most", "owner"))
            lo = int(owner.min()) if len(owner) else 0
            for b in range(n_buckets):
                i, j = cuts[b], cuts[b + 1]
                if j > i:
                    shared, rest = front_coded([w[i:j] for w in run["words"]])
                    offsets = zstandard.compress(np.concatenate([least[i:j], most[i:j]]).astype(np.uint8).tobytes(), 1)
                    out.append((b, uid, lo, shared, rest, offsets, B.planes((owner[i:j] - lo).astype(np.uint64))))
        return pd.DataFrame(out, columns=["bucket", "uid", "lo", "shared", "rest", "offsets", "owner"]).astype({"bucket": "int32", "uid": "int64", "lo": "int64"})

    sent_runs = rows.select("uid", "body").groupBy("uid").cogroup(screened.groupBy("uid")).applyInPandas(runs, "bucket int, uid long, lo long, shared binary, rest binary, offsets binary, owner binary")
    n_right, n_left = -(-length // 8), -(-(length - kmer) // 8)
    width = 8 * (n_right + n_left)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        coded, strings, rows_of, least, most, owner = [], [], [], [], [], []
        for r in frame.itertuples():
            shared, mat = front_decoded(r.shared, r.rest, width)
            raw = mat.tobytes()
            coded.append(shared.tolist())
            strings.append([raw[i : i + width] for i in range(0, len(raw), width)])
            rows_of.append(mat)
            both = np.frombuffer(zstandard.decompress(r.offsets), np.uint8).reshape(2, -1).astype(np.int64)
            least.append(both[0])
            most.append(both[1])
            owner.append(B.unplanes(r.owner, np.uint64).astype(np.int64) + r.lo)
        sizes = [len(x) for x in strings]
        out_run, out_shared = merge_runs(coded, strings)
        out_run = np.array(out_run, np.int32)
        del coded, strings
        place = np.argsort(out_run, kind="stable")  # run after run, where its strings stand in the merged order
        order = np.empty(len(place), np.int64)
        order[place] = np.arange(len(place))
        mat = np.concatenate(rows_of)[:, 8 * n_right :]
        left = [np.ascontiguousarray(mat[:, 8 * j : 8 * j + 8]).view(">u8").reshape(-1).astype(np.uint64)[order] for j in range(n_left)]
        bits = np.empty(len(place), np.uint64)
        bits[order] = repeated_offsets(np.array(out_shared), left, np.concatenate(least)[order], np.concatenate(most)[order], np.concatenate(owner)[order], length, kmer)
        return pd.DataFrame({"uid": frame.uid, "kind": 1, "bucket": frame.bucket.astype("int32"), "flags": [B.planes(x) for x in np.split(bits, np.cumsum(sizes)[:-1])]})

    answers = sent_runs.groupBy("bucket").applyInPandas(merge, "uid long, kind int, bucket int, flags binary")
    return rows, screened.select("uid", "kind", "bucket", "flags").union(answers), n_buckets, bits


def dedup(docs: DataFrame, length: int = LENGTH, kmer: int = KMER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, spans (removed byte intervals, end exclusive), kept (the other bytes)."""
    if not 0 < kmer <= length <= 120:
        raise ValueError("0 < kmer <= length <= 120")
    rows, told, n_buckets, bits = exchanges(docs, length, kmer, id_col, text_col)

    def finish(mine: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
        out = []
        for body in mine.body:
            block = B.unpacked(body)
            gone = removed_bytes(block, flags, length, kmer, n_buckets, bits)
            for i in range(block.n):
                a, b = int(block.ends[i - 1]) if i else 0, int(block.ends[i])
                g = gone[a:b]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(np.int8), [0]])))
                out.append((block.ids[i] if block.ids[i] != B.NO_ID else None, b - a, int(g.sum()), edge.reshape(-1, 2).tolist(), block.data[a:b][~g].tobytes()))
        return pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "spans", "kept"]).astype({"id": "Int64"})

    done = rows.select("uid", "body").groupBy("uid").cogroup(told.groupBy("uid")).applyInPandas(finish, "id long, n_bytes long, n_removed long, spans array<array<long>>, kept binary")
    return done.withColumnRenamed("id", id_col)


def whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """gone, with all bytes of each UTF-8 character that has lost one: halves of two characters could make a third."""
    later = (data & 0xC0) == 0x80
    out = gone.copy()
    for _ in range(3):  # a character has four bytes at most
        out[1:] |= out[:-1] & later[1:]
        out[:-1] |= out[1:] & later[1:]
    return out


def cleaned(docs: DataFrame, length: int = LENGTH, kmer: int = KMER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated bytes taken out of their texts; what is left of a character that was cut goes too."""
    columns = docs.columns
    others = [c for c in columns if c != text_col]
    rows, told, n_buckets, bits = exchanges(docs, length, kmer, id_col, text_col, [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(others)])

    def finish(mine: pa.Table, flags: pa.Table) -> pa.Table:
        out = []
        for body in mine.column("body").to_pylist():
            block = B.unpacked(body)
            gone = whole_characters(block.data, removed_bytes(block, flags.to_pandas(), length, kmer, n_buckets, bits))
            texts = []
            for i in range(block.n):
                a, b = int(block.ends[i - 1]) if i else 0, int(block.ends[i])
                texts.append(None if block.null[i] else block.data[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore"))
            out.append(block.rows().rename_columns(others).append_column(text_col, pa.array(texts, pa.string())))
        return pa.concat_tables(out).select(columns)

    return rows.select("uid", "body").groupBy("uid").cogroup(told.groupBy("uid")).applyInArrow(finish, docs.schema)


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
