"""Media columns: TIFF files written from bytes, and read back one row per page.

The reader follows the chain of image directories in either byte order, decodes uncompressed, PackBits,
LZW and deflate data in strips or tiles, undoes horizontal differencing for 8- and 16-bit samples, and
gives a row per page. The writer makes grey 8-bit pages; the query stores each payload as one page of 64
columns. Codec (PackBits, LZW, deflate), strips or tiles, and differencing (not with PackBits) are chosen by a hash
of the payload, so texts of every size take every path, and equal texts give equal files.

Defined results: a null or empty text is a payload of 64 zero bytes; null media give no page; damaged media (parts
that are missing, too short, too long or don't cover the page, sizes of 0 or of more than LIMIT bytes, unknown
codecs, circles) give the pages before the damage and one row whose error says why, rather than failing the job; an
empty table has no rows; repeated rows give repeated pages; kept columns may have any name. All work is within
rows, so there is no shuffle; memory is bounded by some eight times the largest text, or page.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.llm import blocks as B

COLUMNS = 64
STRIP_ROWS = 128
TILE = (32, 32)
#: Bytes of a page that are read at most.
LIMIT = 1 << 30
RUNS = re.compile(rb"(.)\1{2,127}", re.DOTALL)
#: Tags and values of the TIFF 6.0 specification.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 284, 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
FIELD_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}


# ---------------------------------------------------------------- codecs


def packbits(data: bytes) -> bytes:
    """Runs of three bytes or more as such, what lies between as it is, 128 at most at a time."""
    out, at = bytearray(), 0

    def literal(end: int) -> None:
        for a in range(at, end, 128):
            part = data[a : min(a + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for run in RUNS.finditer(data):
        literal(run.start())
        out.extend((257 - (run.end() - run.start()), data[run.start()]))
        at = run.end()
    literal(len(data))
    return bytes(out)


def unpackbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        head = data[at]
        if head < 128:
            out += data[at + 1 : at + 2 + head]
            at += 2 + head
        elif head > 128:
            out += data[at + 1 : at + 2] * (257 - head)
            at += 2
        else:
            at += 1
    return bytes(out)


def lzw_widths(n: int) -> np.ndarray:
    """Bits of the first n codes after the table was cleared: one more from the code on before which the table has 2**w - 1 entries."""
    return 9 + np.searchsorted(np.array([511, 1023, 2047]), np.arange(n) + 257, "right")


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widened one code early; the table is cleared before it is full."""
    codes: list[int] = [256]
    clears = [0]  # places of the clear codes
    table: dict[int, int] = {}  # (code of what is known, next byte) to the code of both
    following, have = 258, -1
    get = table.get
    for c in data:
        if have < 0:
            have = c
            continue
        key = have << 8 | c
        known = get(key)
        if known is not None:
            have = known
            continue
        codes.append(have)
        table[key] = following
        following += 1
        have = c
        if following == 4094:
            clears.append(len(codes))
            codes.append(256)
            table.clear()
            following = 258
    if have >= 0:
        codes.append(have)
    codes.append(257)
    # A clear code has the width that was reached; the codes behind it start anew.
    place = np.arange(len(codes))
    since = place - np.array(clears)[np.searchsorted(clears, place, "left") - 1] - 1
    since[0] = 0
    width = lzw_widths(int(since.max()) + 1)[since]
    ends = np.cumsum(width)
    bits = np.repeat(np.array(codes), width) >> (np.repeat(ends, width) - 1 - np.arange(ends[-1])) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def unlzw(data: bytes, most: int = LIMIT) -> bytes:
    bits = np.concatenate([np.unpackbits(np.frombuffer(data, np.uint8)), np.zeros(12, np.uint8)]).astype(np.int32)
    sums = sum(bits[i : len(bits) - 11 + i] << (11 - i) for i in range(12)) if data else np.zeros(0, np.int32)  # twelve bits from each place
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    out: list[bytes] = []
    at, size = 0, 0
    widths = lzw_widths(1 << 12)
    steps = np.cumsum(widths) - widths
    end = 8 * len(data)
    while True:  # from one clear code to the next
        n = int(np.searchsorted(at + steps + widths, end, "right"))
        codes = (sums[at + steps[:n]] >> (12 - widths[:n])).tolist()
        table, previous = list(start), b""
        for i, code in enumerate(codes):
            if code == 257:
                return b"".join(out)
            if code == 256:
                at += int(steps[i] + widths[i])
                break
            if code < len(table):
                entry = table[code]
            elif code == len(table) and previous:
                entry = previous + previous[:1]
            else:
                raise ValueError(f"LZW code {code} out of {len(table)}")
            out.append(entry)
            size += len(entry)
            if size > most:
                raise ValueError("a strip or tile is too long")
            if previous:
                table.append(previous + entry[:1])
            previous = entry
        else:
            if n == len(widths):
                raise ValueError("the LZW table was not cleared")
            return b"".join(out)


def compress(data: bytes, method: int) -> bytes:
    return {NONE: bytes, LZW: lzw, PACKBITS: packbits, DEFLATE: lambda x: zlib.compress(x, 1)}[method](data)


def inflate(data: bytes, most: int) -> bytes:
    work = zlib.decompressobj()
    out = work.decompress(data, most + 1)
    if not work.eof and len(out) <= most:
        raise ValueError("a deflate stream without its end")
    return out


def decompress(data: bytes, method: int, most: int = LIMIT) -> bytes:
    if method not in (NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS):
        raise ValueError(f"compression {method} isn't supported")
    return {NONE: lambda x, _: bytes(x), LZW: unlzw, PACKBITS: lambda x, _: unpackbits(x), DEFLATE: inflate, OLD_DEFLATE: inflate}[method](data, most)


def differenced(x: np.ndarray) -> np.ndarray:
    """x: rows, columns, samples."""
    out = x.copy()
    out[:, 1:] -= x[:, :-1]
    return out


def summed(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, axis=1, dtype=x.dtype)


# ---------------------------------------------------------------- files


@dataclass
class Page:
    pixels: np.ndarray
    compression: int = DEFLATE
    predictor: int = 1
    tile: tuple[int, int] | None = None  # height, width; None: strips


def written(pages: list[Page]) -> bytes:
    """A little-endian file of grey or multi-sample 8-bit pages."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        x = page.pixels if page.pixels.ndim == 3 else page.pixels[:, :, None]
        height, width, samples = x.shape
        if page.tile:
            th, tw = page.tile
            padded = np.zeros((-(-height // th) * th, -(-width // tw) * tw, samples), np.uint8)
            padded[:height, :width] = x
            parts = [padded[r : r + th, c : c + tw] for r in range(0, len(padded), th) for c in range(0, padded.shape[1], tw)]
        else:
            parts = [x[r : r + STRIP_ROWS] for r in range(0, height, STRIP_ROWS)]
        offsets, counts = [], []
        for part in parts:
            raw = compress((differenced(part) if page.predictor == 2 else part).tobytes(), page.compression)
            offsets.append(len(out))
            counts.append(len(raw))
            out += raw + b"\0" * (len(raw) & 1)
        fields = {WIDTH: [width], HEIGHT: [height], BITS: [8] * samples, COMPRESSION: [page.compression], PHOTOMETRIC: [1], SAMPLES: [samples], PLANAR: [1], PREDICTOR: [page.predictor]}
        fields |= {TILE_WIDTH: [page.tile[1]], TILE_HEIGHT: [page.tile[0]], TILE_OFFSETS: offsets, TILE_COUNTS: counts} if page.tile else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [STRIP_ROWS], STRIP_COUNTS: counts}
        entries = []
        for tag, values in sorted(fields.items()):
            raw = struct.pack(f"<{len(values)}I", *values)
            if len(raw) > 4:
                entries.append(struct.pack("<HHII", tag, 4, len(values), len(out)))
                out += raw
            else:
                entries.append(struct.pack("<HHI", tag, 4, len(values)) + raw)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    """Byte order and integer fields of each image directory."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if not order:
        raise ValueError("no TIFF header")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise ValueError("the directories form a circle")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        fields = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind in FIELD_CODES:
                place = at + 10 + 12 * i
                if FIELD_SIZES[kind] * count > 4:
                    (place,) = struct.unpack_from(order + "I", data, place)
                fields[tag] = list(struct.unpack_from(f"{order}{count}{FIELD_CODES[kind]}", data, place))
        yield order, fields
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def pixels(data: bytes, order: str, fields: dict[int, list[int]]) -> np.ndarray:
    """A page's samples: rows, columns, samples."""
    one = lambda tag, default=None: fields.get(tag, [default])[0]
    width, height, samples, bits = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), set(fields.get(BITS, [1]))
    if bits not in ({8}, {16}) or one(PLANAR, 1) != 1:
        raise ValueError("only interleaved samples of 8 or 16 bits are supported")
    dtype = np.dtype(np.uint8 if bits == {8} else order + "u2")
    method, predictor = one(COMPRESSION, 1), one(PREDICTOR, 1)
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor} isn't supported")
    if not 0 < width * height * samples * dtype.itemsize <= LIMIT:
        raise ValueError(f"a page of {width} x {height} x {samples} samples is empty or over the limit")

    def part(offset: int, count: int, rows: int, columns: int) -> np.ndarray:
        need = rows * columns * samples * dtype.itemsize
        if offset + count > len(data) or need > 4 * LIMIT:
            raise ValueError("a strip or tile is beyond the file or over the limit")
        raw = decompress(data[offset : offset + count], method, need + 8)  # some writers pad
        if len(raw) < need:
            raise ValueError("a strip or tile is too short")
        x = np.frombuffer(raw, dtype, rows * columns * samples).reshape(rows, columns, samples)
        x = x.astype(dtype.newbyteorder("="))
        return summed(x) if predictor == 2 else x

    def covered(offsets: int, counts: int, need: int) -> None:
        if min(len(fields.get(offsets, [])), len(fields.get(counts, []))) < need:
            raise ValueError("the strips or tiles don't cover the page")

    out = np.zeros((height, width, samples), dtype.newbyteorder("="))
    if TILE_OFFSETS in fields:
        tw, th = one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)
        if tw <= 0 or th <= 0:
            raise ValueError("tiles without a size")
        across = -(-width // tw)
        tiles = across * -(-height // th)
        covered(TILE_OFFSETS, TILE_COUNTS, tiles)
        for i, (offset, count) in enumerate(zip(fields[TILE_OFFSETS][:tiles], fields[TILE_COUNTS])):
            r, c = i // across * th, i % across * tw
            out[r : r + th, c : c + tw] = part(offset, count, th, tw)[: height - r, : width - c]
    else:
        per = min(one(ROWS_PER_STRIP, height), height)
        if per <= 0:
            raise ValueError("strips without rows")
        strips = -(-height // per)
        covered(STRIP_OFFSETS, STRIP_COUNTS, strips)
        for i, (offset, count) in enumerate(zip(fields[STRIP_OFFSETS][:strips], fields[STRIP_COUNTS])):
            rows = min(per, height - i * per)
            out[i * per : i * per + rows] = part(offset, count, rows, width)
    return out


def feature(x: np.ndarray) -> str:
    """Shape, mean, deviation and the entropy of the samples' upper four bits."""
    flat = x.reshape(-1)
    share = np.bincount(flat >> (8 * flat.dtype.itemsize - 4), minlength=16) / max(1, flat.size)
    share = share[share > 0]
    return f"{x.shape[0]}x{x.shape[1]}x{x.shape[2]} mean={flat.mean():.4f} std={flat.std():.4f} entropy={-(share * np.log2(share)).sum():.4f}"


PAGE_FIELDS = "page int, height int, width int, samples int, compression int, predictor int, data binary, feature string, error string"


def pages(media: DataFrame, media_col: str = "media", keep: list[str] | None = None) -> DataFrame:
    """One row per page of each file: the columns `keep`, then PAGE_FIELDS (data: the samples, row by row)."""
    keep = keep if keep is not None else [c for c in media.columns if c != media_col]
    names = [f.split()[0] for f in PAGE_FIELDS.split(", ")]

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for *kept, raw in rows:
            number = 0
            try:
                for order, fields in directories(raw) if raw is not None else []:
                    x = pixels(raw, order, fields)
                    yield (*kept, number, *x.shape, fields.get(COMPRESSION, [1])[0], fields.get(PREDICTOR, [1])[0], x.tobytes(), feature(x), None)
                    number += 1
            except (ValueError, TypeError, ArithmeticError, LookupError, MemoryError, struct.error, zlib.error) as e:
                yield (*kept, number, *[None] * 7, str(e) or type(e).__name__)

    chosen = media.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(media_col).alias("m"))
    kinds = [f"k{i} {dict(media.dtypes)[c]}" for i, c in enumerate(keep)]
    return B.map_rows(chosen, run, ", ".join([*kinds, PAGE_FIELDS])).toDF(*keep, *names)


def payload(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % COLUMNS if text else COLUMNS)


def stored(raw: bytes) -> bytes:
    """A payload as a TIFF file; how is chosen by a hash of it."""
    x = np.frombuffer(raw, np.uint8).reshape(-1, COLUMNS)
    pick = zlib.crc32(raw)
    method = (PACKBITS, LZW, DEFLATE)[pick % 3]
    return written([Page(x, method, 2 if method != PACKBITS and pick >> 8 & 1 else 1, TILE if pick >> 9 & 1 else None)])


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, media)."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for i, text in rows:
            yield i, len(text or b""), stored(payload(text or b""))

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    return B.map_rows(chosen, run, f"id {dict(docs.dtypes)[id_col]}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the registered query, from what was read back."""
    media = store(docs).withColumns({"media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    back = pages(media, "media", ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    return back.select("doc_id", "n_bytes", F.length("data").cast("long").alias("payload_bytes"), F.sha2("data", 256).alias("payload_sha256"), F.crc32(F.substring("data", -COLUMNS, COLUMNS)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature")
