"""TIFF images in a binary column: writing pages, and reading them back one row per page.

The reader walks the chain of image directories in either byte order, decodes strips or tiles stored plain, with PackBits, LZW or
deflate, undoes the horizontal predictor and returns the samples row by row. 8-bit samples, one or more per pixel, in one plane.

Defined cases: a null image gives no page; a directory that can't be read gives a row with its number, null samples and the reason in ``error``, and
the others are read; where the chain can't be followed, a row with page -1 comes after the pages before it (of joined pages, it is the only one);
an image without directories gives no page; repeated rows are read on their own; an empty table gives no rows. Columns of the input
whose names equal an output column are replaced by it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_arrow, schema_with, without

# values fixed by the TIFF 6.0 format
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES = 322, 323, 324, 325
TYPE_BYTES = {1: 1, 3: 2, 4: 4}
LZW_CLEAR, LZW_END, LZW_FIRST, LZW_MAX_BITS = 256, 257, 258, 12


def packbits_encode(data: bytes) -> bytes:
    """Runs of three and more as a count and a byte, what lies between them as it is, at most 128 bytes a packet."""
    a = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(a))
    long = ends - starts > 2
    out, at = bytearray(), 0

    def plain(upto: int) -> None:
        for i in range(at, upto, 128):
            part = data[i:min(i + 128, upto)]
            out.append(len(part) - 1)
            out.extend(part)

    for start, end in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        plain(start)
        for i in range(start, end, 128):
            out += bytes(((257 - min(128, end - i)) & 255, data[i]))
        at = end
    plain(len(a))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        head = data[i]
        if head < 128:
            out += data[i + 1:i + 2 + head]
            i += head + 2
        elif head > 128:
            out += data[i + 1:i + 2] * (257 - head)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw_widths(first: int, n: int) -> np.ndarray:
    """Bits of the codes number ``first`` and following after a clear code: the reader's table has one entry fewer than codes were read."""
    size = np.arange(first, first + n) - 1 + LZW_FIRST
    return 9 + (size >= 511).astype(np.int64) + (size >= 1023) + (size >= 2047)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; the width grows one code early, as the format asks."""
    none = [None] * (1 << LZW_MAX_BITS)
    table: list[dict[int, int] | None] = none.copy()  # for the code of a word, the codes of the words that are one byte longer
    codes, clears, size, word = [LZW_CLEAR], [0], LZW_FIRST, data[0] if data else -1
    add = codes.append
    for byte in data[1:]:
        longer = table[word]
        if longer is None:
            table[word] = {byte: size}
        elif byte in longer:
            word = longer[byte]
            continue
        else:
            longer[byte] = size
        add(word)
        word = byte
        size += 1
        if size == (1 << LZW_MAX_BITS) - 2:
            clears.append(len(codes))
            add(LZW_CLEAR)
            table = none.copy()
            size = LZW_FIRST
    codes += [word, LZW_END] if word >= 0 else [LZW_END]
    ends = [*clears[1:], len(codes) - 1]
    widths = np.concatenate([[9], *[lzw_widths(0, end - begin) for begin, end in zip(clears, ends, strict=True)]])
    bits = np.unpackbits(np.array(codes, ">u2").view(np.uint8)).reshape(-1, 16)
    return np.packbits(bits[np.arange(16) >= 16 - widths[:, None]]).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    """Whole arrays of codes at once: widths follow from a code's number since the clear code, lengths from the chain of entries, and every byte
    but a literal one is a copy of an earlier byte, at a distance that its code gives."""
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.int64)
    out, have, bit, limit = [], 0, 0, 8 * len(data)
    held = np.zeros(0, np.int64)  # codes since the clear code
    while have < size:
        widths = lzw_widths(len(held), min(4096, (limit - bit) // 9 + 1))
        ends = bit + np.cumsum(widths)
        n = int(np.searchsorted(ends, limit, "right"))
        if not n:  # no end code
            out.append(_lzw_words(held))
            break
        at, widths = ends[:n] - widths[:n], widths[:n]
        k = at >> 3
        codes = (raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]) >> (24 - (at & 7) - widths) & (1 << widths) - 1
        stop = np.flatnonzero((codes == LZW_CLEAR) | (codes == LZW_END))
        if not len(stop):
            held, bit = np.concatenate([held, codes]), int(ends[n - 1])
            continue
        out.append(_lzw_words(np.concatenate([held, codes[:stop[0]]])))
        have += len(out[-1])
        if codes[stop[0]] == LZW_END:
            break
        held, bit = np.zeros(0, np.int64), int(ends[stop[0]])
    return b"".join(x.tobytes() for x in out)


def _lzw_words(codes: np.ndarray) -> np.ndarray:
    """The bytes of the codes between two clear codes."""
    n = len(codes)
    number = np.arange(n)
    entry = np.where(codes < 256, number, codes - LZW_FIRST)  # the code that began the entry; a literal is its own
    if (entry > number - (codes >= 256)).any():
        raise ValueError("LZW code out of range")
    # a word is one byte longer than that of the code which began its entry
    length, upto = (codes >= 256).astype(np.int64), entry
    while (length[upto] > 0).any():
        length, upto = length + length[upto], upto[upto]
    length += 1
    start = np.cumsum(length) - length
    source = np.arange(int(length.sum())) - np.repeat(start - start[entry], length)
    while ((further := source[source]) != source).any():
        source = further
    return np.repeat(codes, length)[source].astype(np.uint8)


ENCODERS = {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1)}
DECODERS = {NONE: lambda b, n: b, PACKBITS: packbits_decode, LZW: lzw_decode, DEFLATE: lambda b, n: zlib.decompressobj().decompress(b, n), OLD_DEFLATE: lambda b, n: zlib.decompressobj().decompress(b, n)}


def _cells(pixels: np.ndarray, tile: tuple[int, int] | None, strip_rows: int) -> Iterator[np.ndarray]:
    h, w = pixels.shape[:2]
    if tile is None:
        yield from (pixels[y:y + strip_rows] for y in range(0, h, strip_rows))
        return
    tw, th = tile
    for y in range(0, h, th):
        for x in range(0, w, tw):
            part = pixels[y:y + th, x:x + tw]
            yield np.pad(part, [(0, th - part.shape[0]), (0, tw - part.shape[1]), (0, 0)])


def write_image(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, strip_rows: int = 1024, order: str = "<") -> bytes:
    """A TIFF with one directory per page; a page is an array (height, width) or (height, width, samples) of bytes."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        pixels = page if page.ndim == 3 else page[:, :, None]
        h, w, spp = pixels.shape
        at, sizes = [], []
        for cell in _cells(pixels, tile, strip_rows):
            if predictor == 2:
                cell = np.concatenate([cell[:, :1], np.diff(cell, axis=1)], axis=1)
            data = ENCODERS[compression](np.ascontiguousarray(cell).tobytes())
            at.append(len(out))
            sizes.append(len(data))
            out += data
        where = {STRIP_AT: at, STRIP_ROWS: [strip_rows], STRIP_BYTES: sizes} if tile is None else {TILE_WIDTH: [tile[0]], TILE_HEIGHT: [tile[1]], TILE_AT: at, TILE_BYTES: sizes}
        tags = {WIDTH: [w], HEIGHT: [h], BITS: [8] * spp, COMPRESSION: [compression], PHOTOMETRIC: [2 if spp == 3 else 1], SAMPLES: [spp], PLANAR: [1], PREDICTOR: [predictor]} | where
        entries, short = [], {BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, PREDICTOR}
        for tag in sorted(tags):
            values, kind, code = tags[tag], 3 if tag in short else 4, "H" if tag in short else "I"
            body = struct.pack(f"{order}{len(values)}{code}", *values)
            if len(body) > 4:
                out += b"\0" * (len(out) % 2)
                body, offset = struct.pack(order + "I", len(out)), body
                out += offset
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


READ_ERRORS = (ValueError, KeyError, IndexError, OverflowError, MemoryError, struct.error, zlib.error)
MOST_SAMPLES = 4096  # samples that no coding can keep in one byte


def _read_page(data: bytes, order: str, at: int, count: int) -> tuple[int, int, int, bytes]:
    tags = {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind in TYPE_BYTES:
            here = at + 10 + 12 * k
            start = here if n * TYPE_BYTES[kind] <= 4 else struct.unpack_from(order + "I", data, here)[0]
            tags[tag] = struct.unpack_from(f"{order}{n}{ {1: 'B', 3: 'H', 4: 'I'}[kind]}", data, start)
    w, h, spp = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
    coding, predictor = tags.get(COMPRESSION, (NONE,))[0], tags.get(PREDICTOR, (1,))[0]
    if any(b != 8 for b in tags.get(BITS, (1,))) or coding not in DECODERS or predictor not in (1, 2) or tags.get(PLANAR, (1,))[0] != 1:
        raise ValueError("bit depth, coding, predictor or plane order not supported")
    tiled = TILE_AT in tags
    cw, ch = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (w, min(h, tags.get(STRIP_ROWS, (h,))[0]))
    offsets, sizes = (tags[TILE_AT], tags[TILE_BYTES]) if tiled else (tags[STRIP_AT], tags[STRIP_BYTES])
    if max(h * w, ch * cw) * spp > MOST_SAMPLES * len(data):
        raise ValueError("more samples than the stored bytes can hold")
    pixels, k = np.zeros((h, w, spp), np.uint8), 0
    for y in range(0, h, ch):
        for x in range(0, w, cw):
            rows = ch if tiled else min(ch, h - y)
            raw = DECODERS[coding](data[offsets[k]:offsets[k] + sizes[k]], rows * cw * spp)
            cell = np.frombuffer(raw, np.uint8, rows * cw * spp).reshape(rows, cw, spp)
            if predictor == 2:
                cell = np.cumsum(cell, axis=1, dtype=np.uint8)
            pixels[y:y + rows, x:x + cw] = cell[:h - y, :w - x]
            k += 1
    return w, h, spp, pixels.tobytes()


def read_directories(data: bytes) -> Iterator[tuple[int, tuple[int, int, int, bytes] | Exception]]:
    """Number and page, or what went wrong with it, of each directory; raises ValueError or struct.error where the chain can't be followed."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no TIFF header")
    at, page, seen = struct.unpack_from(order + "I", data, 4)[0], 0, set()
    while at:
        if at in seen or at + 2 > len(data):
            raise ValueError("directory chain is broken")
        seen.add(at)
        count = struct.unpack_from(order + "H", data, at)[0]
        follow = struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]
        try:
            got = _read_page(data, order, at, count)
        except READ_ERRORS as e:
            got = e
        yield page, got
        at, page = follow, page + 1


def read_image(data: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    """``page, width, height, samples per pixel, samples`` of each directory; raises for the first that it can't read."""
    for page, got in read_directories(data):
        if isinstance(got, Exception):
            raise got
        yield page, *got


PAGE_WIDTH = 64


def choose_layout(payload: bytes) -> tuple[int, dict]:
    """Pages (1 to 3) and the writer's options by a hash of the payload, so that every coding, strip and tile is met at every size.

    The predictor goes with LZW and deflate only, for which the format defines it.
    """
    h = zlib.crc32(payload)
    h, coding = divmod(h, 3)
    h, predictor = divmod(h, 2)
    h, cells = divmod(h, 4)
    h, pages = divmod(h, 3)
    coding = (LZW, PACKBITS, DEFLATE)[coding]
    return 1 + pages, {
        "compression": coding, "predictor": 1 if coding == PACKBITS else 1 + predictor, "tile": (None, None, (32, 64), (48, 32))[cells],
        "strip_rows": (64, 1024)[cells % 2], "order": "<>"[h % 2]}


def write_tiffs(df: DataFrame, payload_col: str = "payload", out_col: str = "media") -> DataFrame:
    """Add a TIFF per row that holds the payload as grey pages of 64 samples a row; null for a null payload or one that isn't a multiple of 64.

    The rows are dealt evenly over the pages that ``choose_layout`` names, at least one a page.
    """
    keep = without(df, out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = []
            for p in b.column(payload_col).to_pylist():
                if p is None or not p or len(p) % PAGE_WIDTH:
                    media.append(None)
                    continue
                pages, options = choose_layout(p)
                pixels = np.frombuffer(p, np.uint8).reshape(-1, PAGE_WIDTH)
                media.append(write_image(np.array_split(pixels, min(pages, len(pixels))), **options))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(media, pa.binary())], names=[*keep, out_col])

    return map_arrow(df, run, schema_with(df, keep, f"{out_col} binary"))


PAGE_FIELDS = "page int, width int, height int, samples_per_pixel int, samples binary, feature string, error string"


def _feature(samples: bytes) -> str:
    """Share of samples in eight equal ranges (per mille), mean, and mean step between neighbours."""
    a = np.frombuffer(samples, np.uint8)
    if not len(a):
        return ""
    shares = np.bincount(a >> 5, minlength=8) * 1000 // len(a)
    step = np.abs(np.diff(a.astype(np.int16))).mean() if len(a) > 1 else 0.0
    return ",".join(map(str, shares)) + f";{a.mean():.3f};{step:.3f}"


def _joined(pages: list[tuple]) -> list[tuple]:
    """The pages of an image as one page, one below the other."""
    if len(pages) < 2:
        return pages
    if len({(w, spp) for _, w, _, spp, _ in pages}) > 1:
        raise ValueError("pages differ in width or samples")
    _, w, _, spp, _ = pages[0]
    return [(0, w, sum(p[2] for p in pages), spp, b"".join(p[4] for p in pages))]


def read_pages(df: DataFrame, media_col: str = "media", joined: bool = False) -> DataFrame:
    """One row per page: the input's columns, then the page's number, size, samples and feature; ``joined``: one row per image, its pages one below the other."""
    names = [f.split()[0] for f in PAGE_FIELDS.split(", ")]
    keep = without(df, *names)
    failed = lambda e: f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, pages = [], []
            for i, data in enumerate(b.column(media_col).to_pylist()):
                if data is None:
                    continue
                got = []
                try:
                    if joined:
                        got += [(p, w, h, spp, x, _feature(x), None) for p, w, h, spp, x in _joined(list(read_image(data)))]
                    else:
                        for p, part in read_directories(data):
                            got.append((p, None, None, None, None, None, failed(part)) if isinstance(part, Exception) else (p, *part, _feature(part[-1]), None))
                except READ_ERRORS as e:
                    got.append((-1, None, None, None, None, None, failed(e)))
                pages += got
                rows += [i] * len(got)
            kinds = [pa.int32()] * 4 + [pa.binary(), pa.string(), pa.string()]
            cols = [pa.array([p[k] for p in pages], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(rows, pa.int64())) for c in (b.column(k) for k in keep)] + cols, names=[*keep, *names])

    return map_arrow(df, run, schema_with(df, keep, PAGE_FIELDS))


def op9(spark, sf_dir: str) -> DataFrame:
    """Every text stored as TIFF pages and read back, one row per text."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    padded = F.greatest(F.ceil(F.octet_length(raw) / PAGE_WIDTH), F.lit(1)) * PAGE_WIDTH
    # rows are kept apart by their task, so nothing is shuffled: one image holds one document
    docs = documents(spark, sf_dir).select("doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), F.rpad(raw, padded.cast("int"), F.lit(b"\0")).alias("payload"))
    media = write_tiffs(docs, "payload").drop("payload").withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    pages = read_pages(media, joined=True)
    size = F.octet_length("samples")
    return pages.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -PAGE_WIDTH, PAGE_WIDTH)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature")
