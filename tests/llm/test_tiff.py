import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from catalogspark.llm import tiff as T
from catalogspark.llm.queries import QUERIES


@pytest.mark.parametrize("coding", [T.NONE, T.PACKBITS, T.LZW, T.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_images_round_trip(coding, predictor, tile, order):
    rnd = np.random.default_rng(1)
    pages = [rnd.integers(0, 256, (37, 50), np.uint8), np.zeros((70, 9), np.uint8), rnd.integers(0, 4, (33, 20, 3), np.uint8)]
    got = list(T.read_image(T.write_image(pages, coding, predictor, tile, 10, order)))
    assert [g[:4] for g in got] == [(0, 50, 37, 1), (1, 9, 70, 1), (2, 20, 33, 3)]
    assert [g[4] for g in got] == [p.tobytes() for p in pages]


def test_codings_round_trip():
    rnd = random.Random(2)
    for n in (0, 1, 2, 3, 127, 128, 129, 130, 300, 511, 512, 513, 5000, 40000):
        for letters in (1, 3, 256):
            raw = bytes(rnd.randrange(letters) for _ in range(n))
            assert T.packbits_decode(T.packbits_encode(raw), n) == raw
            assert T.lzw_decode(T.lzw_encode(raw), n) == raw


def test_query_gives_the_payloads_back(spark, table, fixture_dir, sentences):
    rows = [(i, t) for i, t in enumerate([None, "", "a", "b" * 64, "é" * 40, "c" * 65, "d" * 256, "e" * 257, sentences(1, 150), sentences(2, 3000), "\x00" * 70])] + [(8, sentences(1, 150))]
    got = QUERIES["op9_tiff_pages"](spark, fixture_dir(table(rows))).collect()
    assert len(got) == len(rows)
    seen = {}
    for r in got:
        raw = (dict(rows)[r.doc_id] or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert seen.setdefault(r.doc_id, r) == r and r.feature and r.media_bytes > 64


def test_every_layout_at_every_size(spark, sentences):
    rows = [(n * 100 + i, bytearray(sentences(i, 2 + n * 6).encode()[:n * 64].ljust(n * 64, b"\0"))) for n in (1, 4, 17, 200) for i in range(90)]
    df = spark.createDataFrame(rows, "k int, payload binary")
    media = T.write_tiffs(df).cache()
    met = {}
    for r in media.collect():
        order = "<" if r.media[:2] == b"II" else ">"
        at = struct.unpack_from(order + "I", r.media, 4)[0]
        tags = {t: struct.unpack_from(order + ("H" if kind == 3 else "I"), r.media, at + 10 + 12 * k)[0] for k in range(struct.unpack_from(order + "H", r.media, at)[0]) for t, kind in [struct.unpack_from(order + "HH", r.media, at + 2 + 12 * k)]}
        pages = list(T.read_image(bytes(r.media)))
        assert b"".join(p[4] for p in pages) == bytes(r.payload)
        met.setdefault(len(r.payload), set()).update([("coding", tags[T.COMPRESSION]), ("predictor", tags[T.PREDICTOR]), ("tiled", T.TILE_AT in tags), ("pages", len(pages)), ("order", order)])
    every = {("coding", c) for c in (T.LZW, T.PACKBITS, T.DEFLATE)} | {("predictor", 1), ("predictor", 2), ("tiled", True), ("tiled", False), ("order", "<"), ("order", ">")}
    for size, seen in met.items():
        assert seen == every | {("pages", n) for n in (1, 2, 3) if n * 64 <= size}
    assert {(r.k, r.page, bytes(r.samples)) for r in T.read_pages(media, joined=True).collect()} == {(k, 0, bytes(p)) for k, p in rows}
    assert len(set(T.choose_layout(bytes(p))[0] for _, p in rows)) == 3 and T.choose_layout(b"a" * 64) == T.choose_layout(b"a" * 64)


def test_pages_that_do_not_fit_are_not_joined(spark):
    mixed = T.write_image([np.zeros((2, 64), np.uint8), np.zeros((2, 32), np.uint8)])
    df = spark.createDataFrame([(1, bytearray(mixed))], "k int, media binary")
    assert [(r.page, r.error is None) for r in T.read_pages(df, joined=True).collect()] == [(-1, False)]
    assert [(r.page, r.width) for r in T.read_pages(df).orderBy("page").collect()] == [(0, 64), (1, 32)]


def test_readable_pages_of_mixed_files_stay(spark):
    data = bytearray(T.write_image([np.full((2, 64), k, np.uint8) for k in range(3)]))
    starts, at = [], struct.unpack_from("<I", data, 4)[0]
    while at:
        starts.append(at)
        at = struct.unpack_from("<I", data, at + 2 + 12 * struct.unpack_from("<H", data, at)[0])[0]
    bits = bytearray(data)
    assert struct.unpack_from("<H", bits, starts[1] + 2 + 24)[0] == T.BITS
    struct.pack_into("<H", bits, starts[1] + 2 + 24 + 8, 16)
    cut = data[:starts[2]]
    df = spark.createDataFrame([(1, bits), (2, cut)], "k int, media binary")
    got = [(r.k, r.page, r.samples and set(r.samples), r.error is None) for r in T.read_pages(df).orderBy("k", "page").collect()]
    assert got == [(1, 0, {0}, True), (1, 1, None, False), (1, 2, {2}, True), (2, -1, None, False), (2, 0, {0}, True), (2, 1, {1}, True)]
    assert [(r.page, r.error is None) for r in T.read_pages(df, joined=True).collect()] == [(-1, False)] * 2


def test_broken_images_are_reported(spark):
    good = T.write_image([np.zeros((2, 64), np.uint8)] * 2)
    loop = bytearray(good)
    df = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"II*")), (4, bytearray(good[:40])), (5, bytearray(b""))], "k int, media binary")
    got = {}
    for r in T.read_pages(df).collect():
        got.setdefault(r.k, []).append((r.page, r.error is None))
    assert got == {1: [(0, True), (1, True)], 3: [(-1, False)], 4: [(-1, False)], 5: [(-1, False)]} and loop
    assert T.read_pages(df.where("false")).collect() == []


def stream(*codes):
    """LZW codes of nine bits as bytes, highest bit first."""
    bits = "".join(f"{c:09b}" for c in codes)
    return bytes(int(bits[i:i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


def test_streams_of_other_writers():
    # the format's own example, a clear code in the middle, a word that repeats the one being written, an end without an end code
    assert T.lzw_decode(stream(256, 7, 258, 8, 8, 258, 6, 6, 257), 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert T.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == stream(256, 7, 258, 8, 8, 258, 6, 6, 257)
    assert T.lzw_decode(stream(256, 65, 66, 258, 256, 67, 258, 257), 99) == b"ABABCCC"
    assert T.lzw_decode(stream(65, 258, 259), 6) == b"AAAAAA"
    assert T.lzw_decode(stream(256, 65, 66), 2) == b"AB"
    many = bytes(random.Random(6).randrange(4) for _ in range(70_000))
    assert T.lzw_decode(T.lzw_encode(many)[:-1], len(many))[:69_000] == many[:69_000]
    with pytest.raises(ValueError, match="out of range"):
        T.lzw_decode(stream(256, 65, 300), 9)
    with pytest.raises(ValueError, match="out of range"):
        T.lzw_decode(stream(256, 259), 9)
    # the format's example of packed runs
    assert T.packbits_decode(bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA]), 24) == bytes([0xAA] * 3 + [0x80, 0, 0x2A] + [0xAA] * 4 + [0x80, 0, 0x2A, 0x22] + [0xAA] * 10)


def test_impossible_sizes_are_reported(spark):
    data = T.write_image([np.zeros((2, 64), np.uint8), np.ones((2, 64), np.uint8)])
    at = struct.unpack_from("<I", data, 4)[0]
    rows = []
    for k, (tag, value) in enumerate([(0, 2**31 - 1), (1, 2**31 - 1), (1, 2**20)]):
        bad = bytearray(data)
        struct.pack_into("<I", bad, at + 10 + 12 * tag, value)
        rows.append((k, bad))
    got = T.read_pages(spark.createDataFrame(rows, "k int, media binary")).orderBy("k", "page").collect()
    assert [(r.k, r.page, r.error is None) for r in got] == [(k, p, p == 1) for k in range(3) for p in range(2)]
