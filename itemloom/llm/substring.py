"""Substring deduplication by Rabin-Karp hashes of every fixed-length word window.

Every window of `width` consecutive words of one document is hashed (a polynomial over 64-bit word hashes, modulo
2**64, and another with an own base over own word hashes). Blocks of documents exchange the upper bits of their
distinct hashes to learn which windows other blocks may have, too. These, and those found twice in a block, are
then counted by 128 bits: Spark finds the least id under which each starts, and a window is repeated under all
larger ones. Overlapping and adjacent repeated windows merge into maximal intervals of words, which are removed.

Two windows are taken for equal if both hashes are: for n windows, that goes wrong with a chance of n**2 / 2**129
(1e13 windows, as of 100 TB: 1.5e-13). A window that many blocks share costs each of them one entry.

Defined results: a null or empty text has no words; fewer than `width` words, no window; a text of any length is
one piece of work, of some 25 times its size. Null ids count as the smallest id. Rows with equal ids are judged
against smaller ids only, never against each other, in whichever blocks they are. The table may be empty, and
columns of any other name are left alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.llm import blocks as B

WIDTH = 13


#: Base of the second polynomial, and the seed of its words' hashes.
OTHER = 0xC2B2AE3D27D4EB4F


def windows_of(block: B.Block, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends and documents; hashes of the windows and the word each starts with."""
    starts, ends, doc = B.word_spans(block.data, block.ends)
    h = B.mixed(B.rolled(B.span_hashes(block.data, starts, ends), width))
    at = np.flatnonzero(doc[: len(h)] == doc[width - 1 :][: len(h)]) if len(h) else np.zeros(0, np.int64)
    return starts, ends, doc, h[at], at


def covered(n: int, at: np.ndarray, width: int) -> np.ndarray:
    """Which of n places a window that starts in one of `at` covers."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, at + width, -1)
    return np.cumsum(step[:-1]) > 0


def second_hashes(block: B.Block, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Of the windows that start at some words only: their words' other hashes, by Horner's rule."""
    needed = np.flatnonzero(covered(len(starts), at, width))
    h = B.span_hashes(block.data, starts[needed], ends[needed], 1)
    first = np.searchsorted(needed, at)
    out = np.zeros(len(at), np.uint64)
    for j in range(width):
        out = out * np.uint64(OTHER) + h[first + j]
    return B.mixed(out)


def candidates(block: B.Block, told: pd.DataFrame, width: int, bits: int):
    """Word starts, ends, documents; of the windows that may be repeated: first words, owners, and which distinct one each is;
    of these: both hashes, in order, and the least owner here."""
    starts, ends, doc, h, at = windows_of(block, width)
    order = np.argsort(h, kind="stable")
    twice = np.zeros(len(h), bool)
    same = h[order][1:] == h[order][:-1]
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    some = np.flatnonzero(twice | (B.shared_elsewhere(h, told, bits) > 0))
    h, at = h[some], at[some]
    h2 = second_hashes(block, starts, ends, at, width) if len(at) else h
    owner = block.ids[doc[at]]
    order = np.lexsort([owner, h2, h])
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    first = order[new]
    return starts, ends, doc, at, owner, of, h[first], h2[first], owner[first]


def repeated_words(block: B.Block, told: pd.DataFrame, width: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends, documents, and whether each word is to go. told: the answers of both exchanges (kind 0 and 1)."""
    starts, ends, doc, at, owner, of, h, _, least = candidates(block, told[told.kind == 0], width, bits)
    earlier = B.flags_joined(told[told.kind == 1], len(h)).astype(bool)[of]
    return starts, ends, doc, covered(len(starts), at[earlier | (owner > least[of])], width)


def spans_of(mask: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-but-one places of the maximal runs of mask within documents."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(mask), bool)
    new[1:] = (mask[1:] != mask[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    to = np.append(at[1:], len(mask))
    return at[mask[at]], to[mask[at]]


def dedup(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, spans (word intervals removed, end exclusive), kept_text."""
    rows, n_bytes = B.stored(docs, id_col, text_col)
    n_buckets, bits = B.bucket_count(docs.sparkSession, n_bytes), B.screening_bits(n_bytes)
    screened = B.kept(B.answered(B.sent(rows, lambda block: windows_of(block, width)[3], n_buckets, bits), B.in_several))

    def send(mine: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
        out = []
        for uid, body in zip(mine.uid, mine.body):
            *_, h, h2, least = candidates(B.unpacked(body), flags, width, bits)
            lo = int(least.min()) if len(least) else 0
            out += [(k, uid, lo, B.deltas(h[a:b]), h2[a:b].tobytes(), B.planes((least[a:b] - lo).astype(np.uint64))) for k, a, b in B.bucketed(h, n_buckets)]
        return pd.DataFrame(out, columns=["bucket", "uid", "lo", "hashes", "others", "least"]).astype({"bucket": "int32", "uid": "int64", "lo": "int64"})

    def judge(frame: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([B.undeltas(x) for x in frame.hashes])
        h2 = np.concatenate([np.frombuffer(x, np.uint64) for x in frame.others])
        least = np.concatenate([B.unplanes(x, np.uint64).astype(np.int64) + lo for x, lo in zip(frame.least, frame.lo)])
        order = np.lexsort([least, h2, h])
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        earlier = np.empty(len(order), np.uint8)
        earlier[order] = least[order] > least[order][new][np.cumsum(new) - 1]
        cuts = np.cumsum([len(x) // 8 for x in frame.others])[:-1]
        return pd.DataFrame({"uid": frame.uid, "bucket": frame.bucket, "flags": [zstandard.compress(x.tobytes(), 1) for x in np.split(earlier, cuts)]})

    each = rows.select("uid", "body").groupBy("uid")
    asked = each.cogroup(screened.groupBy("uid")).applyInPandas(send, "bucket int, uid long, lo long, hashes binary, others binary, least binary")
    judged = asked.groupBy("bucket").applyInPandas(judge, "uid long, bucket int, flags binary")
    told = screened.withColumn("kind", F.lit(0)).unionByName(judged.withColumn("kind", F.lit(1)))

    def finish(mine: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
        out = []
        for body in mine.body:
            block = B.unpacked(body)
            starts, ends, doc, gone = repeated_words(block, flags, width, bits)
            texts = B.joined_words(block, starts[~gone], ends[~gone], doc[~gone])
            cuts = np.searchsorted(doc, np.arange(block.n + 1))
            removed = np.concatenate([[0], np.cumsum(gone)])[cuts]
            a, b = spans_of(gone, doc)
            of = np.searchsorted(a, cuts)
            for i in range(block.n):
                spans = np.stack([a[of[i] : of[i + 1]], b[of[i] : of[i + 1]]], 1) - cuts[i]
                out.append((block.ids[i] if block.ids[i] != B.NO_ID else None, int(cuts[i + 1] - cuts[i]), int(removed[i + 1] - removed[i]), spans.tolist(), texts[i]))
        return pd.DataFrame(out, columns=["id", "n_words", "n_removed", "spans", "kept"]).astype({"id": "Int64"})

    done = each.cogroup(told.groupBy("uid")).applyInPandas(finish, "id long, n_words long, n_removed long, spans array<array<long>>, kept binary")
    return done.select(F.col("id").alias(id_col), "n_words", "n_removed", "spans", F.decode("kept", "UTF-8").alias("kept_text"))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
