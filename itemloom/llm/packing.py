"""Packing documents into token windows by Karmarkar-Karp multiway differencing.

A document's ids (the tokenizer's, then the end id) are cut at multiples of the window; what is left over
is cut once more at half a window. Whole windows, and pairs of halves, are full. The rest is gathered to
groups of GROUP windows' worth and split into near-equal windows: each piece starts as a partition of one
filled and otherwise empty windows; the two partitions with the largest imbalances merge, the fullest
windows of one with the emptiest of the other, until one is left. If a window of it is over capacity, the
group is split anew into one window more.

Groups follow the rows of a partition, so nothing is shuffled or gathered, and memory is bounded by a group
and the longest text. A partition's last group is smaller; it leaves less than a window of padding more.
Sequence ids are unique over the table (partition, then number) and stable when a task runs again.

Defined results: null and empty texts are the end id alone; repeated rows are packed each; an empty
table has no pieces. Padding is what a sequence lacks to the window; a power of two needs none.
"""

from __future__ import annotations

import heapq
import json
import operator
import os
import re
import sys
import types
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.llm import agenda
from itemloom.llm import blocks as B

WINDOW = 2048
GROUP = 64
END_ID = 1
#: Words whose ids are kept in a task's memory, twice at most; about 200 bytes each.
CACHE = 300_000


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each piece; ties go to the earlier piece."""
    n = len(sizes)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    made: list[np.ndarray] = []
    count = n
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for i, s in enumerate(sizes):
        sums, nodes = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[-1], nodes[-1] = s, i
        heap.append((-int(s) if windows > 1 else 0, i, sums, nodes))
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, a, an = heapq.heappop(heap)
        _, _, b, bn = heapq.heappop(heap)
        bn = bn[::-1]
        sums, nodes = a + b[::-1], np.where(an < 0, bn, an)
        both = np.flatnonzero((an >= 0) & (bn >= 0))
        if len(both):
            new = np.arange(count, count + len(both))
            count += len(both)
            left.append(an[both])
            right.append(bn[both])
            made.append(new)
            nodes[both] = new
        by = np.argsort(sums, kind="stable")
        sums, nodes = sums[by], nodes[by]
        heapq.heappush(heap, (int(sums[0] - sums[-1]), order, sums, nodes))
        order += 1
    window = np.full(count, -1, np.int64)
    if heap:
        nodes = heap[0][3]
        window[nodes[nodes >= 0]] = np.flatnonzero(nodes >= 0)
    for a, b, new in zip(reversed(left), reversed(right), reversed(made)):
        window[a] = window[b] = window[new]
    return window[:n]


def balanced(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each piece, none over capacity, with as few windows as differencing manages."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        where = differencing(sizes, windows)
        if np.bincount(where, sizes, windows).max(initial=0) <= capacity:
            return where
        windows += 1


def cut(n: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    out = [(a, window) for a in range(0, n - window + 1, window)]
    at, rest, half = n - n % window, n % window, window // 2
    if rest > half:
        out.append((at, half))
        at, rest = at + half, rest - half
    return out + [(at, rest)] * (rest > 0)


def byte_symbols() -> list[str]:
    """The characters by which byte-level vocabularies write the bytes: printable ones stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [chr(others.get(b, b)) for b in range(256)]


def word_ids(path: str, cache: int = CACHE) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids (little-endian 32 bits), for tokenizers whose pre-tokens never span white space.

    Equal words of some megabytes of text are brought together by 64-bit hashes; each is encoded once: a word of letters and ASCII marks behind them is the ids of both, and letters
    count in lower case where they are ASCII. Such parts are one pre-token each; the merges of many are worked on
    beside each other (`agenda`). Anything else goes to the tokenizer as it is.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core a task
    from tokenizers import Tokenizer

    # Tables serve a worker's later tasks as well; words, those of one task. Words seen lately outlive the others: they
    # move from the old half to the new one when they are met again.
    state = sys.modules.setdefault("itemloom_word_ids", types.ModuleType("itemloom_word_ids")).__dict__
    if state.get("of") != path:
        tokenizer = Tokenizer.from_file(path)
        model = json.loads(tokenizer.to_str())["model"]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        found = [(vocabulary[x], vocabulary[y], i, vocabulary[x + y]) for i, (x, y) in enumerate(merges)]
        count = max(vocabulary.values()) + 1
        inner, last = (np.array([vocabulary.get(c + x, count) for c in byte_symbols()], np.int32) for x in ("", end))
        pairs = agenda.Pairs(*np.array(found, np.int64).reshape(-1, 4).T, count)
        state.update({"of": path, "tokenizer": tokenizer, "agenda": agenda.Agenda(pairs), "inner": inner, "last": last, "words": {}, "old": {}, "parts": {}})
    tokenizer, work, inner, last = (state[k] for k in ("tokenizer", "agenda", "inner", "last"))
    plain = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]*)")
    parts: dict[str, bytes] = state["parts"]

    def ids_of(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn_parts(new: list[str]) -> None:
        for a in range(0, len(new), 1 << 16):
            some = new[a : a + (1 << 16)]
            data = np.frombuffer("\0".join([*some, ""]).encode(), np.uint8)  # parts have letters or marks only
            breaks = np.flatnonzero(data == 0)
            symbols = inner[data]
            symbols[breaks - 1] = last[data[breaks - 1]]
            symbols = np.delete(symbols, breaks)
            starts = np.append(0, breaks[:-1] + 1) - np.arange(len(breaks))
            work.settle(symbols, starts)
            at = np.flatnonzero(symbols >= 0)
            raw = symbols[at].astype("<u4").tobytes()
            cuts = (4 * np.searchsorted(at, np.append(starts, len(symbols)))).tolist()
            parts.update(zip(some, [raw[i:j] for i, j in zip(cuts, cuts[1:])]))

    def learn(new: set[bytes], words: dict[bytes, bytes]) -> None:
        if len(parts) > cache:
            parts.clear()
        whole: list[bytes] = []
        heads: list[str] = []
        tails: list[str] = []
        rest: list[bytes] = []
        for w in new:
            m = plain.fullmatch(w.decode())
            if m:
                letters, marks = m.groups()
                if letters.isascii():
                    letters = letters.lower()
                else:
                    given, letters = letters, letters.lower()
                    simple = given.isalpha() and letters.isalpha() and not {"\u03a3", "\u0130"} & set(given)  # these lower by what stands around them
                    if not (simple and unicodedata.is_normalized("NFC", given) and unicodedata.is_normalized("NFC", letters)):
                        rest.append(w)
                        continue
                whole.append(w)
                heads.append(letters)
                tails.append(marks)
            else:
                rest.append(w)
        learn_parts(list(set(heads).union(tails).difference(parts, ("",))))
        parts[""] = b""
        words.update(zip(whole, map(operator.add, map(parts.__getitem__, heads), map(parts.__getitem__, tails))))
        words.update(zip(rest, ids_of([w.decode() for w in rest])))

    def encode(texts: list[str]) -> list[bytes]:
        data = "".join(texts).encode()
        lens = np.array([len(t) if t.isascii() else len(t.encode()) for t in texts], np.int64)
        starts, ends, doc = B.word_spans(np.frombuffer(data, np.uint8), np.cumsum(lens), b" \n")
        _, first, which = np.unique(B.span_hashes(np.frombuffer(data, np.uint8), starts, ends), return_index=True, return_inverse=True)
        own = [data[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist())]
        if len(state["words"]) > cache:
            state["words"], state["old"] = {}, state["words"]
        words, old = state["words"], state["old"]
        new = [w for w in own if w not in words]
        met = {w: old[w] for w in new if w in old}
        words.update(met)
        if len(new) > len(met):
            learn({w for w in new if w not in met}, words)
        ids = [words[w] for w in own]
        flat, size = np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64)
        n = size[which]
        to = np.concatenate([[0], np.cumsum(n)])
        raw = flat[np.repeat((np.cumsum(size) - size)[which] - to[:-1], n) + np.arange(to[-1])].tobytes()
        cuts = (4 * to[np.searchsorted(doc, np.arange(len(texts) + 1))]).tolist()
        return [raw[i:j] for i, j in zip(cuts, cuts[1:])]

    return encode


def forget() -> None:
    """At the end of a task: a worker that waits, or does other work next, doesn't keep the words."""
    state = sys.modules.get("itemloom_word_ids")
    if state:
        for name in ("words", "old", "parts"):
            getattr(state, name).clear()


def encoded(rows: Iterator[tuple], encode: Callable[[list[str]], list[bytes]], most: int = 3 << 19) -> Iterator[tuple]:
    """(id, ids) of rows (id, text), encoded some megabytes at a time."""
    held: list[tuple] = []
    size = 0
    for i, text in rows:
        held.append((i, text or ""))
        size += len(text or "") + 64
        if size > most:
            yield from zip([h[0] for h in held], encode([h[1] for h in held]))
            held, size = [], 0
    yield from zip([h[0] for h in held], encode([h[1] for h in held]))


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, group: int = GROUP, end_id: int = END_ID, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (packed, or null)."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        end = np.array([end_id], "<u4").tobytes()
        number = TaskContext.get().partitionId() << 40 if TaskContext.get() else 0
        held: list[tuple] = []
        halves: list[tuple] = []
        size = 0

        def placed(pieces: list[tuple], sequences: list[int]) -> Iterator[tuple]:
            used: dict[int, int] = {}
            for piece, s in zip(pieces, sequences):
                i, start, length, crc, total, ids = piece
                yield i, start, length, crc, total, s, used.get(s, 0), ids
                used[s] = used.get(s, 0) + length

        def flush() -> Iterator[tuple]:
            nonlocal number, size
            where = balanced(np.array([p[2] for p in held]), window)
            yield from placed(held, [number + int(w) for w in where])
            number += int(where.max()) + 1
            held.clear()
            size = 0

        for i, ids in encoded(rows, word_ids(tokenizer)):
            ids += end
            total = len(ids) // 4
            for start, length in cut(total, window):
                raw = ids[4 * start : 4 * (start + length)]
                piece = (i, start, length, zlib.crc32(raw), total, raw if with_ids else None)
                if length == window:
                    yield from placed([piece], [number])
                    number += 1
                elif 2 * length == window:
                    halves.append(piece)
                    if len(halves) == 2:
                        yield from placed(halves, [number, number])
                        number += 1
                        halves.clear()
                else:
                    held.append(piece)
                    size += length
                    if size >= group * window:
                        yield from flush()
        held += halves
        if held:
            yield from flush()
        forget()

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return B.map_rows(chosen, run, f"id {dict(docs.dtypes)[id_col]}, {PIECES}").withColumnRenamed("id", id_col)


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The columns of the registered query."""
    return pack(docs, tokenizer, with_ids=False).drop("ids")
