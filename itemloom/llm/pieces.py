"""SentencePiece encoding and decoding with seeded merge-dropout.

Merges of a BPE model are processed as an agenda: the adjacent pair whose union has the best score is
merged, leftmost on ties, until none is left. A candidate is skipped if its draw falls below the dropout rate;
the draw is a hash of the seed, the document's id, the unit's number in the document, and the candidate's two
spans. So each occurrence of a unit is split by draws of its own, and in the same way whenever it is computed
again. Symbols that the model lacks become byte pieces, as does a literal U+2581, so every text decodes exactly.

No merge crosses from a character to a following space, so texts are encoded unit by unit (spaces and
what follows up to the next space): many units beside each other (`agenda`), long ones by a heap. Nothing is
remembered between texts. Texts are worked on BATCH characters at a time, a longer one alone, so memory is
bounded by some 60 bytes a character of these.

Defined results: null and empty texts have no ids and decode to the empty text; ids that are null have
key 0; repeated rows are encoded alike; an empty table has no rows, and columns beside id and text play no part.
There is no shuffle, and nothing depends on other rows.
"""

from __future__ import annotations

import hashlib
import sys
import types
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.llm import agenda
from itemloom.llm import blocks as B

SPACE = "▁"
RATE = 0.1
SEED = 20_240_601
BATCH = 1 << 19
CODE_POINTS = 0x110000


def document_key(key: int, seed: int) -> int:
    return agenda.mixed((key ^ agenda.mixed(seed & agenda.ALL)) & agenda.ALL)


def own_key(number: int, key: int, seed: int) -> int:
    """Of a unit's occurrence, by its number in the document."""
    return agenda.mixed(number * B.BASE + document_key(key, seed) & agenda.ALL)


class Codec:
    """encode(texts, keys of the documents) to packed ids (little-endian 32 bits), and decode(ids) to UTF-8 bytes."""

    def __init__(self, path: str, rate: float, seed: int):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        bare = [model.is_control(i) or model.is_unknown(i) for i in range(n)]
        ids = {p: i for i, p in enumerate(names) if not (bare[i] or model.is_byte(i))}
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("pieces with inner spaces aren't supported")
        of_byte = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.seed = seed
        self.byte_ids = np.array([of_byte.get(i, 0) for i in range(256)], np.uint32)
        self.texts = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if bare[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        # Symbols: the pieces, then the characters that stand in pieces without being one.
        symbols = dict(ids)
        for c in sorted({c for p in ids for c in p}.difference(ids)):
            symbols[c] = n + len(symbols) - len(ids)
        count = n + len(symbols) - len(ids)
        self.pieces = n
        place: dict[float, int] = {}
        for p in sorted(ids, key=lambda p: -model.get_score(ids[p])):
            place.setdefault(model.get_score(ids[p]), len(place))  # equal scores are equal ranks: the leftmost goes first
        found = [(symbols[p[:i]], symbols[p[i:]], place[model.get_score(k)], k) for p, k in ids.items() for i in range(1, len(p)) if p[:i] in symbols and p[i:] in symbols]
        pairs = agenda.Pairs(*np.array(found, np.int64).reshape(-1, 4).T, count)
        self.agenda = agenda.Agenda(pairs, int(rate * (1 << 32)))
        self.none = count
        self.of_char = np.full(CODE_POINTS, count, np.int32)
        for c, s in symbols.items():
            if len(c) == 1 and c != SPACE:
                self.of_char[ord(c)] = s
        self.of_char[0x20] = symbols.get(SPACE, count)

    def encode(self, texts: list[str], keys: list[int]) -> list[bytes]:
        chars = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le"), "<u4")
        lens = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        doc_starts = np.cumsum(lens) - lens
        space = chars == 0x20
        first = space.copy()
        first[1:] &= ~space[:-1]
        some = lens > 0
        first[doc_starts[some]] = True
        starts = np.flatnonzero(first)
        of_doc = np.searchsorted(starts, doc_starts)  # each document's first unit
        units = np.diff(np.append(of_doc, len(starts)))
        number = np.arange(len(starts)) - np.repeat(of_doc, units)
        own = np.array([document_key(k, self.seed) for k in keys], np.uint64)
        owns = B.mixed(number.astype(np.uint64) * np.uint64(B.BASE) + np.repeat(own, units))
        symbols = self.of_char[chars]
        self.agenda.settle(symbols, starts, owns)
        at = np.flatnonzero(symbols >= 0)
        ids = symbols[at].astype(np.uint32)
        cuts = np.searchsorted(at, np.append(doc_starts, len(chars)))
        raw = np.flatnonzero(ids >= self.pieces)
        if len(raw):  # characters that the model lacks, by their bytes
            code = chars[at[raw]]
            size = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
            spread = np.ones(len(ids), np.int64)
            spread[raw] = size
            to = np.concatenate([[0], np.cumsum(spread)])
            cuts = to[cuts]
            ids = np.repeat(ids, spread)
            within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            ids[np.repeat(to[raw], size) + within] = self.byte_ids[np.frombuffer(code.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)]
        packed = ids.astype("<u4").tobytes()
        return [packed[4 * a : 4 * b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]

    def decode(self, raw: bytes) -> bytes:
        return b"".join(map(self.texts.__getitem__, np.frombuffer(raw, "<u4").tolist()))[1:]


def codec(path: str, rate: float, seed: int) -> Codec:
    """A worker's tasks share it."""
    state = sys.modules.setdefault("itemloom_pieces", types.ModuleType("itemloom_pieces")).__dict__
    if state.get("of") != (path, rate, seed):
        state.update({"of": (path, rate, seed), "codec": Codec(path, rate, seed)})
    return state["codec"]


def key_of(i: object, seed: int) -> int:
    """Of a document, by its id: a signed 64-bit hash."""
    return 0 if i is None else int.from_bytes(hashlib.blake2b(str(i).encode(), digest_size=8, key=b"%d" % seed).digest(), "little", signed=True)


def encode(docs: DataFrame, model: str, rate: float = RATE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, variant (the key of its draws), n_bytes, ids (packed, little-endian 32 bits)."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        own = codec(model, rate, seed)
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[tuple]:
            texts, keys = [t for _, t in held], [key_of(i, seed) for i, _ in held]
            yield from ((i, v, len(t.encode()), ids) for (i, t), v, ids in zip(held, keys, own.encode(texts, keys)))
            held.clear()

        for i, text in rows:
            if held and size + len(text or "") > BATCH:
                yield from flush()
                size = 0
            held.append((i, text or ""))
            size += len(text or "") + 16
        yield from flush()

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return B.map_rows(chosen, run, f"id {dict(docs.dtypes)[id_col]}, variant long, n_bytes long, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """The rows with `decoded` (UTF-8 bytes; null ids: null) in place of the ids."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        to_text = codec(model, 0.0, 0).decode
        for *kept, raw in rows:
            yield (*kept, zlib.crc32(raw) if raw is not None else None, len(raw) // 4 if raw is not None else None, to_text(raw) if raw is not None else None)

    keep = [c for c in encoded.columns if c != ids_col]
    kinds = dict(encoded.dtypes)
    ddl = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "ids_crc32 long", "n_ids long", "decoded binary"])
    return B.map_rows(encoded.select(*keep, ids_col), run, ddl)


def digest(docs: DataFrame, model: str) -> DataFrame:
    """The registered query: each document encoded, and decoded from those ids."""
    back = decode(encode(docs, model), model)
    return back.select("doc_id", "variant", "n_bytes", "n_ids", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"))
