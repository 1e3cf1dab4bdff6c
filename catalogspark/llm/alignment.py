"""Alignment of two tokenizers over a corpus, computed once for every distinct text.

Equal texts are brought together by a shuffle on the full text, whose map-side combine leaves one row a text and task, so a group of copies of
any size is one row and a multiplicity. Each distinct text is encoded by both tokenizers. Token ends on one byte axis give everything else:
ends that both share cut the text into groups, and every stretch between two neighbouring ends of either lies in exactly one token of each, which is
one link. The distinct id pairs of a text count with its multiplicity, so a pair's count is the number of documents that hold it linked.

The counts come back to the texts in two exact ways. At most ``HOT_PAIRS`` pairs can have a ``HOT_PAIRS``-th of all entries each; these go to every task as
sorted arrays (24 MB at most). All other pairs are joined by a shuffle, in which no key is hot. Measures then join the documents on a 128-bit digest of
the text.

Tokens of A are those of the byte-level file, computed with the same ranks by ``tiktoken`` (the tests compare it with the file's own library); B is a
sentencepiece model that adds the leading space. A text longer than ``PART_CHARS`` is encoded in parts that begin at a single space between two letters or
digits. No token of A crosses such a place, and B is cut only if no piece of its vocabulary could cross it, so parts equal the whole.

Defined cases: null and empty texts, and texts whose joined bytes differ from a space and the text (a U+2581 in the text, for instance), have no tokens: zeros and an empty
digest; repeated rows are documents of their own and count each; ties for the highest count are all best; an empty table gives no rows; input columns
whose names equal an output column are replaced by it; ids may be of any type.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_arrow, without, written

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
HOT_PAIRS = 1 << 20
PART_CHARS = 200_000
FLUSH_PAIRS = 1 << 20  # entries whose counts a task holds before it hands them on
_CUT = re.compile(r"(?<=[^\W_]) (?=[^\W_])")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")

MEASURES = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "n_best": "long", "count_sum": "long", "groups_sha256": "string"}
TEXT_FIELDS = "key binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pair long, n long"


class Tokenizers:
    """Both tokenizers, the bytes of their tokens and the texts of their ids."""

    def __init__(self, byte_path: str, piece_path: str):
        with open(byte_path, encoding="utf-8") as f:
            spec = json.load(f)
        # fixed rule of byte-level files: printable bytes are themselves, the others the code points from 256 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - plain))}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(map(letters.__getitem__, piece)): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        self.a = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.separable = not any("▁" in p.lstrip("▁") for p in pieces)
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.width = max(len(self.bytes_a), len(self.bytes_b))
        self.kind = "<u2" if self.width <= 1 << 16 else "<u4"
        self.texts = [f"{i}{sep}" for sep in ("", ",", "|", ";") for i in range(self.width)]

    def parts(self, text: str) -> list[str]:
        out, begin = [], 0
        while self.separable and len(text) - begin > PART_CHARS and (m := _CUT.search(text, begin + PART_CHARS)):
            out.append(text[begin:m.start()])
            begin = m.end()
        return [*out, text[begin:]]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a space and the text in both vocabularies, or None where a tokenizer does not keep the bytes."""
        parts = self.parts(text)
        a = [i for p in parts for i in self.a.encode_ordinary(f" {p}")]
        b = [i for p in parts for i in self.b.encode(p, num_threads=1)]
        whole = f" {text}".encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def groups_text(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of A and B in each group."""
        side = np.concatenate([group_a * 2, group_b * 2 + 1])
        order = np.argsort(side, kind="stable")
        side = side[order]
        step = np.append(side[1:] - side[:-1], -1)  # within a side; to B of the group; to the next group; the end
        sep = np.where(step < 0, 0, np.where(step == 0, 1, np.where(side % 2 == 0, 2, 3)))
        return "".join(map(self.texts.__getitem__, (sep * self.width + np.concatenate([a, b])[order]).tolist()))


@lru_cache(maxsize=2)
def tokenizers(byte_path: str, piece_path: str) -> Tokenizers:
    return Tokenizers(byte_path, piece_path)


def align_ids(t: Tokenizers, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The group of each A token, the group of each B token, and the id pair (A in the upper half) of each link in order."""
    end_a, end_b = np.cumsum(t.size_a[a]), np.cumsum(t.size_b[b])
    ends = np.union1d(end_a, end_b)
    shared = np.intersect1d(end_a, end_b, assume_unique=True)
    links = a[np.searchsorted(end_a, ends)] << 32 | b[np.searchsorted(end_b, ends)]
    return np.searchsorted(shared, end_a), np.searchsorted(shared, end_b), links


def aligned_texts(docs: DataFrame, text_col: str, byte_path: str, piece_path: str) -> DataFrame:
    """Every distinct text aligned, as a written table: rows with ``key`` hold a text, rows with ``pair`` a part of a pair's count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(byte_path, piece_path)
        schema = pa.schema([("key", pa.binary()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("links", pa.binary()), ("pair", pa.int64()), ("n", pa.int64())])
        held, times, size = [], [], 0

        def counted() -> pa.RecordBatch:
            pairs, at = np.unique(np.concatenate(held), return_inverse=True)
            n = np.zeros(len(pairs), np.int64)
            np.add.at(n, at, np.concatenate(times))
            held.clear()
            times.clear()
            return pa.RecordBatch.from_arrays([pa.nulls(len(pairs), f.type) for f in schema][:7] + [pa.array(pairs), pa.array(n)], schema=schema)

        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                key, text, copies = (batch.column(c)[i].as_py() for c in ("key", "text", "copies"))
                ids = t.encode(text)
                if ids is None:
                    continue
                group_a, group_b, links = align_ids(t, *ids)
                digest = hashlib.sha256(t.groups_text(*ids, group_a, group_b).encode()).hexdigest()
                pairs, occurrences = np.unique(links, return_counts=True)
                rows.append((key, len(ids[0]), len(ids[1]), int(group_a[-1]) + 1, len(links), digest, pack_links(pairs, occurrences, t.kind), None, None))
                held.append(pairs)
                times.append(np.full(len(pairs), copies, np.int64))
                size += len(pairs)
                if size >= FLUSH_PAIRS:
                    yield counted()
                    size = 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if held:
            yield counted()

    texts = docs.select(F.col(text_col).alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    return written(map_arrow(texts.withColumn("key", text_key("text")), run, TEXT_FIELDS), "aligned")


def text_key(col: str):
    return F.unhex(F.md5(F.col(col).cast("binary")))


def pack_links(pairs: np.ndarray, occurrences: np.ndarray, kind: str) -> bytes:
    """Sorted id pairs and how often each is linked, in few bytes: steps of the A ids, B ids, occurrences."""
    a = pairs >> 32
    return b"".join([np.diff(a, prepend=0).astype(kind).tobytes(), (pairs & 0xFFFFFFFF).astype(kind).tobytes(), occurrences.astype("<u4").tobytes()])


def unpack_links(raw: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    width = np.dtype(kind).itemsize
    n = len(raw) // (2 * width + 4)
    a = np.cumsum(np.frombuffer(raw, kind, n).astype(np.int64))
    return a << 32 | np.frombuffer(raw, kind, n, n * width).astype(np.int64), np.frombuffer(raw, "<u4", n, 2 * n * width).astype(np.int64)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a, b, pair, count, best``: in how many documents a pair of ids is linked, and whether no pair of the same A id is linked in more."""
    counts = aligned.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("count"))
    counts = counts.withColumns({"a": F.shiftright("pair", 32), "b": F.col("pair").bitwiseAND(0xFFFFFFFF)})
    top = counts.groupBy("a").agg(F.max("count").alias("_top"))
    return counts.join(top, "a").select("a", "b", "pair", "count", (F.col("count") == F.col("_top")).alias("best"))


def text_measures(aligned: DataFrame, counts: DataFrame, kind: str) -> DataFrame:
    """``key`` and the measures of each distinct text."""
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    least = total // HOT_PAIRS + 1  # fewer than HOT_PAIRS pairs can reach it
    hot = counts.where(F.col("count") >= least).select("pair", "count", "best").toArrow().sort_by("pair")
    spark = aligned.sparkSession
    sent = spark.sparkContext.broadcast(tuple(hot.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "count", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = sent.value
        for batch in batches:
            sums, rest, times = [], [], []
            for raw in batch.column("links"):
                pairs, n = unpack_links(raw.as_py(), kind)
                at = np.minimum(np.searchsorted(pair, pairs), max(len(pair) - 1, 0))
                known = pair[at] == pairs if len(pair) else np.zeros(len(pairs), bool)
                at = at[known]
                sums.append((int((n[known] * best[at]).sum()), int((n[known] * count[at]).sum())))
                rest.append(pairs[~known])
                times.append(n[~known])
            ends = pa.array(np.cumsum([0, *map(len, rest)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *x]))) for x in (rest, times)]
            yield pa.RecordBatch.from_arrays([batch.column("tid"), *[pa.array([s[k] for s in sums], pa.int64()) for k in range(2)], *lists], names=["tid", "n_best", "count_sum", "pairs", "times"])

    texts = written(aligned.where("pair is null").drop("pair", "n").withColumn("tid", F.monotonically_increasing_id()), "texts")
    known = written(map_arrow(texts.select("tid", "links"), run, "tid long, n_best long, count_sum long, pairs array<long>, times array<long>"), "known-pairs")
    rare = known.select("tid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("tid", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    found = rare.join(counts.where(F.col("count") < least).select("pair", "count", "best"), "pair")
    parts = found.select("tid", (F.col("times") * F.col("best").cast("long")).alias("n_best"), (F.col("times") * F.col("count")).alias("count_sum"))
    sums = known.select("tid", "n_best", "count_sum").unionByName(parts).groupBy("tid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return texts.drop("links").join(sums, "tid").drop("tid")


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """The documents' columns and, for each, ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    byte_path, piece_path = byte_path or public_tokenizers.path(BYTE_BPE), piece_path or public_tokenizers.path(PIECE_BPE)
    aligned = aligned_texts(docs, text_col, byte_path, piece_path)
    counts = written(pair_counts(aligned), "pair-counts")
    measures = text_measures(aligned, counts, tokenizers(byte_path, piece_path).kind).withColumnRenamed("key", "_key")
    rows = docs.select(*without(docs, *MEASURES), text_key(text_col).alias("_own"))
    joined = rows.join(measures, F.col("_own") == F.col("_key"), "left")
    filled = [F.coalesce(c, F.lit("" if kind == "string" else 0).cast(kind)).alias(c) for c, kind in MEASURES.items()]
    return joined.select(*without(docs, *MEASURES), *filled)


def op11(spark, sf_dir: str) -> DataFrame:
    """Both tokenizers aligned over all documents: tokens, groups, links, and how common the linked id pairs are."""
    return align(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", *MEASURES)
