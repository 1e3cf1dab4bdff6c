"""BPE encoding and decoding with a pair occurrence index.

A task cuts its texts into words and encodes each distinct word once. The symbols of all distinct words form one linked list; an index
maps each active pair to all positions where it stands. Ranks are applied in ascending order: a rank merges all positions of its pair at
once, and only the lists of the pairs beside the merged positions are extended. A merge can only create pairs of higher rank, because its new
symbol is made by no other merge, so one ascending pass equals merging word by word. Positions in a list may be outdated; they are
checked when their rank comes up.

The vocabulary file is read by each worker from ``path``; it is never trained here. Texts go in blocks of ``BLOCK_CHARS`` characters, which bounds
the index whatever a task reads.

Defined cases: null and empty texts have no ids and decode to an empty text; the strings of special tokens in a text become their
ids, as in the tokenizers library; ids outside the vocabulary decode to nothing; repeated rows are encoded each; an empty table
gives no rows. Input columns whose names equal an output column are replaced by it.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.normalizers import NFC, Lowercase, Sequence

from .common import documents, map_arrow, schema_with, without
from .segment import span_hashes, split_words, unassigned

WORD_BPE = "word_bpe_49k.json"
PART_CHARS = 1_000_000  # characters cut into words at once
BLOCK_CHARS = 16_000_000  # characters whose distinct words share one index


def vocabulary_path(name: str = WORD_BPE) -> str:
    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(extra)) for b in range(256)]


class Vocabulary:
    """Merges and ids of a byte-level BPE file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        letters = _byte_letters()
        self.inner = np.array([ids[c] for c in letters], np.int32)
        self.final = np.array([ids[c + end] for c in letters], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int32)
        self.right = np.array([ids[b] for _, b in pairs], np.int32)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        keys = self.left.astype(np.int64) << 32 | self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        size = max(max(ids.values()), max(self.special.values(), default=0)) + 1
        names = [""] * size
        for text, i in [*ids.items(), *self.special.items()]:
            names[i] = text
        self.names = pa.array(names, pa.string())

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 if it is never merged. A negative symbol stands for the end of a word."""
        key = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0), self.order[at], -1)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PairIndex:
    """All positions of every active pair in a list of words."""

    def __init__(self, vocab: Vocabulary, words: list[bytes]):
        self.vocab = vocab
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        ends = np.cumsum(sizes) - 1
        self.symbol = np.append(vocab.inner[raw], np.int32(-1))  # the last place is the sentinel behind every word
        self.symbol[ends] = vocab.final[raw[ends]]
        self.after = np.append(np.arange(1, n + 1), n)
        self.after[ends] = n
        self.before = np.append(np.arange(-1, n - 1), n)
        self.before[ends[:-1] + 1] = n
        if n:
            self.before[0] = n
        self.word = np.repeat(np.arange(len(words)), sizes)
        self.lists: dict[int, list[np.ndarray]] = {}
        self.singles: dict[int, list[int]] = {}
        self.heap: list[int] = []
        self._add(np.arange(n), vocab.ranks(self.symbol[:-1], self.symbol[self.after[:-1]]))

    def _add(self, at: np.ndarray, rank: np.ndarray) -> None:
        hit = rank >= 0
        at, rank = at[hit], rank[hit]
        if len(at) <= 24:
            for r, p in zip(rank.tolist(), at.tolist(), strict=True):
                if r in self.singles:
                    self.singles[r].append(p)
                else:
                    if r not in self.lists:
                        heapq.heappush(self.heap, r)
                    self.singles[r] = [p]
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, part in zip(rank[np.append(0, cuts)].tolist(), np.split(at, cuts), strict=True):
            if r in self.lists:
                self.lists[r].append(part)
            else:
                if r not in self.singles:
                    heapq.heappush(self.heap, r)
                self.lists[r] = [part]

    def _positions(self, rank: int) -> np.ndarray:
        parts = self.lists.pop(rank, [])
        if rank in self.singles:
            parts.append(np.array(self.singles.pop(rank), np.int64))
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def merge_all(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words in order, and how many each word has."""
        v, symbol, after, before = self.vocab, self.symbol, self.after, self.before
        while self.heap:
            rank = heapq.heappop(self.heap)
            at = self._positions(rank)
            a, b, made = int(v.left[rank]), int(v.right[rank]), v.made[rank]
            nxt = after[at]
            ok = (symbol[at] == a) & (symbol[nxt] == b)
            at, nxt = at[ok], nxt[ok]
            if a == b and len(at) > 1:
                # in a row of equal symbols, pairs are taken from the left and do not overlap
                at = np.unique(at)
                taken, last = [], -1
                for p, q in zip(at.tolist(), after[at].tolist(), strict=True):
                    if p != last:
                        taken.append(p)
                        last = q
                at = np.array(taken, np.int64)
                nxt = after[at]
            if not len(at):
                continue
            then = after[nxt]
            symbol[at] = made
            symbol[nxt] = -2
            after[at] = then
            before[then] = at
            prev = before[at]
            where = np.concatenate([prev, at])
            self._add(where, v.ranks(symbol[where], symbol[np.concatenate([at, then])]))
        live = symbol[:-1] >= 0
        count = np.bincount(self.word[live], minlength=int(self.word[-1]) + 1 if len(self.word) else 0)
        return symbol[:-1][live], count


def _normal(text: str) -> str:
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    # letter by letter: the small final sigma is not used
    return text.replace("Σ", "σ").lower()


def _spread(values: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices ``which`` of a ragged array, one behind the other, and their sizes."""
    sizes = offsets[which + 1] - offsets[which]
    total = int(sizes.sum())
    lead = np.cumsum(sizes) - sizes
    return values[np.arange(total) + np.repeat(offsets[which] - lead, sizes)], sizes


def encode_block(texts: list[str], vocab: Vocabulary) -> list[np.ndarray]:
    """Ids of each text."""
    normalizer = Sequence([NFC(), Lowercase()])  # for letters newer than Python's Unicode version
    units: list[str] = []
    layout: list[list[int]] = []  # per text: unit numbers, or -1 - id for special tokens
    for t in texts:
        row, at = [], 0
        if "<|" in t:
            for m in vocab.special_pattern.finditer(t):
                if m.start() > at:
                    row.append(len(units))
                    units.append(_normal(t[at:m.start()]))
                row.append(-1 - vocab.special[m[0]])
                at = m.end()
        if at < len(t):
            row.append(len(units))
            units.append(_normal(t[at:]))
        layout.append(row)
    index: dict[int, int] = {}
    words: list[bytes] = []
    numbers: list[np.ndarray] = []
    k = 0
    while k < len(units):
        first, size = k, 0
        while k < len(units) and (size == 0 or size + len(units[k]) <= PART_CHARS):
            size += len(units[k])
            k += 1
        w = split_words(units[first:k])
        if unassigned()[w.points].any():
            units[first:k] = [normalizer.normalize_str(u) if unassigned()[np.frombuffer(u.encode("utf-32-le", "surrogatepass"), np.uint32)].any() else u for u in units[first:k]]
            w = split_words(units[first:k])
        if len(w.starts):
            hashes, where, back = np.unique(span_hashes(w.points, w.starts, w.ends), return_index=True, return_inverse=True)
            own = np.empty(len(hashes), np.int32)
            for j, (h, s, e) in enumerate(zip(hashes.tolist(), w.starts[where].tolist(), w.ends[where].tolist(), strict=True)):
                i = index.get(h)
                if i is None:
                    i = index[h] = len(words)
                    words.append(w.joined[s:e].encode("utf-8", "surrogatepass"))
                own[j] = i
            back = own[back]
        else:
            back = np.zeros(0, np.int32)
        cuts = np.cumsum(w.counts)
        numbers += np.split(back, cuts[:-1])
        # what the next part or the index doesn't need goes first
        units[first:k] = [""] * (k - first)
        del w
    if not words:
        symbols, offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)
    else:
        symbols, count = PairIndex(vocab, words).merge_all()
        offsets = np.concatenate([[0], np.cumsum(count)])
    out = []
    for row in layout:
        if len(row) == 1 and row[0] >= 0:
            out.append(_spread(symbols, offsets, numbers[row[0]])[0])
        else:
            out.append(np.concatenate([np.zeros(0, np.int32), *[np.array([-1 - u], np.int32) if u < 0 else _spread(symbols, offsets, numbers[u])[0] for u in row]]))
    return out


def encoded_batches(batches: Iterator[pa.RecordBatch], text_col: str, path: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches with the ids of their rows; batches are gathered until a block is full."""
    vocab = vocabulary(path)
    held: list[tuple[pa.RecordBatch, list[str]]] = []
    size = 0

    def flush() -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        ids = encode_block([t for _, texts in held for t in texts], vocab)
        at = 0
        for b, texts in held:
            yield b, ids[at:at + len(texts)]
            at += len(texts)

    for b in batches:
        texts = [t or "" for t in b.column(text_col).to_pylist()]
        held.append((b, texts))
        size += sum(map(len, texts))
        if size >= BLOCK_CHARS:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def encode(df: DataFrame, text_col: str = "text", out_col: str = "ids", path: str | None = None) -> DataFrame:
    """Add ``ids``, the tokens of each text."""
    path = path or vocabulary_path()
    keep = without(df, out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, ids in encoded_batches(batches, text_col, path):
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int32), *ids])
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[*keep, out_col])

    return map_arrow(df, run, schema_with(df, keep, f"{out_col} array<int>"))


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", path: str | None = None) -> DataFrame:
    """Add ``decoded``: the tokens' strings joined by one space, as a vocabulary without a decoder prescribes."""
    path = path or vocabulary_path()
    keep = without(df, out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = vocabulary(path).names
        for b in batches:
            ids = b.column(ids_col)
            flat = ids.flatten()
            known = pc.and_kleene(pc.greater_equal(flat, 0), pc.less(flat, len(names))).fill_null(False)
            if not pc.all(known, min_count=0).as_py():
                ids = pa.array([[i for i in row or [] if i is not None and 0 <= i < len(names)] for row in ids.to_pylist()], pa.list_(pa.int32()))
                flat = ids.flatten()
            sizes = pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), names.take(flat)), " ")
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [texts], names=[*keep, out_col])

    return map_arrow(df, run, schema_with(df, keep, f"{out_col} string"))


def op2(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; the digests are built from the ids and the decoded texts."""
    ids = encode(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    named = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), "ids")
    return decode(named).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
