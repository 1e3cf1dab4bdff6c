"""Exact substring de-duplication with suffix arrays built by bucket-pointer refinement.

A byte goes when it lies in a string of ``span`` bytes that also starts in a document with a smaller id. Texts are bytes (UTF-8); matches never cross
documents.

1. Texts are dealt into blocks by their id. Of equal texts only those with the smallest id take part; the others are covered whole.
2. Every stretch of ``span`` bytes is named by the smallest hash of the ``GRAM``-byte strings in it. Neighbouring stretches mostly share
   that name and form a run. Each block sends its distinct names, once each, to the buckets of their hashes; names of one document only
   can't hold a repeated stretch and end there.
3. Runs of the other names are sent to their buckets. Of runs with equal bytes in one block only that of the smallest id is sent. Runs of names that
   occur more than ``HOT`` times are cut into single stretches dealt by their own hash, so a very common line fills no bucket.
4. In a bucket suffix arrays of whole names' runs are built by bucket-pointer refinement: suffixes are put into buckets of equal q-grams, then buckets are
   refined by sorting on the bucket pointers of later offsets. Pointers are updated in place, and refinements that come later use them at once.
   Stretches with equal bytes lie side by side; those with a larger id than the smallest are covered.
5. Covered ranges return to the blocks, where bytes are cut.

Texts are shuffled once by block; the three joins with a block's notes use that shuffle. Blocks, buckets and runs are bounded, whatever the input.

Defined cases: null and empty texts have no bytes and lose none; a null id counts as the largest; rows with one id never cover each other; repeated rows
get the same result each; an empty table gives no rows; input columns that an output column replaces are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import documents, shuffle_parts, without, written
from .segment import mixed, span_hashes

SPAN, GRAM, FIRST_GRAM = 50, 16, 8
BLOCK_BYTES = 4_000_000
HOT = 20_000
SLICES = 4
PAD = 64
PART = 65_536  # places named at once, so that what they need in between stays in the cache
SORT_BYTES = 262_144  # bytes of whole names that share one suffix array
NAME_BITS = 48  # of a name's hash; two strings with one name cost time, not rows
LAST = (1 << 63) - 1


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number that sorts as they do; ``data`` must end with padding."""
    n = len(data) - 7
    return np.ndarray((n,), "<u8", buffer=data, strides=(1,)).byteswap()


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one behind the other, padded, and where each begins (and the last ends)."""
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer(b"".join([*texts, bytes(PAD)]), np.uint8), starts


def stretch_places(starts: np.ndarray, span: int) -> np.ndarray:
    """Where stretches of ``span`` bytes begin inside the texts."""
    n = int(starts[-1])
    inside = np.zeros(n + 1, np.int8)
    long = np.diff(starts) >= span
    np.add.at(inside, starts[:-1][long], 1)
    np.add.at(inside, starts[1:][long] - span + 1, -1)
    return np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` neighbours from each place on."""
    done, out = 1, values
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def runs_of(data: np.ndarray, starts: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring stretches with one name: first place, number of stretches, name."""
    places = stretch_places(starts, span)
    if not len(places):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    w = words_at(data)
    gram = min(GRAM, span)
    heads = np.searchsorted(places, starts[:-1][np.diff(starts) >= span])  # a text begins
    found = []
    for low in range(0, len(places), PART):
        part = places[low:low + PART]
        a, z = int(part[0]), int(part[-1]) + span - gram + 1
        h = mixed(w[a:z])
        if gram > 8:
            h = mixed(h ^ w[a + gram - 8:z + gram - 8])
        names = (_least(h, span - gram + 1) >> np.uint64(64 - NAME_BITS))[part - a]
        new = np.append(True, (names[1:] != names[:-1]) | (np.diff(part) != 1))
        new[heads[np.searchsorted(heads, low):np.searchsorted(heads, low + PART)] - low] = True
        at = np.flatnonzero(new)
        found.append((part[at], np.diff(np.append(at, len(part))), names[at]))
    first, count, names = (np.concatenate(x) for x in zip(*found, strict=True))
    # a run that the end of a part has cut
    new = np.append(True, (names[1:] != names[:-1]) | (first[1:] != first[:-1] + count[:-1]))
    new[np.searchsorted(first, places[heads])] = True
    at = np.flatnonzero(new)
    return first[at], np.add.reduceat(count, at), names[at]


def bucket_pointer_refinement(data: np.ndarray, depth: int, first: int = FIRST_GRAM, wanted: np.ndarray | None = None) -> np.ndarray:
    """Places of ``data`` (without its padding) in the order of their first ``depth`` bytes or more; with ``wanted`` flags, only
    these places need be in order, so the last refinement leaves the others out.

    ``pointer[p]`` is the last rank of the bucket that holds the suffix at ``p``. A bucket that is refined keeps its ranks, so pointers stay in order
    while others are refined with them.
    """
    n = len(data) - PAD
    grams = words_at(data)[:n]
    order = np.argsort(grams)
    pointer = np.zeros(n + PAD + depth, np.int64)

    def point(ranks: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Set the pointers of the suffixes at contiguous ``ranks`` whose sorted keys are given; returns the ranks in buckets of several."""
        cut = np.flatnonzero(np.append(key[1:] != key[:-1], True))
        sizes = np.diff(np.append(-1, cut))
        pointer[order[ranks]] = np.repeat(ranks[cut], sizes) + 1
        return ranks[np.repeat(sizes > 1, sizes)]

    open_ranks = point(np.arange(n), grams[order])
    offset = first
    while offset < depth and len(open_ranks):
        left = []
        if wanted is not None and 2 * offset >= depth:
            # the wanted places of each bucket, on the first of its ranks that are open
            keep = wanted[order[open_ranks]]
            last = pointer[order[open_ranks]]
            by = np.lexsort((~keep, last))
            order[open_ranks] = order[open_ranks][by]
            open_ranks = open_ranks[keep[by]]
            if not len(open_ranks):  # buckets of several held no wanted place
                break
        bounds = pointer[order[open_ranks]]
        edges = np.flatnonzero(np.append(True, bounds[1:] != bounds[:-1]))
        for part in np.array_split(edges, SLICES):
            if not len(part):
                continue
            stop = edges[np.searchsorted(edges, part[-1]) + 1] if part[-1] != edges[-1] else len(open_ranks)
            ranks = open_ranks[part[0]:stop]
            key = pointer[order[ranks]] * (n + 1) + pointer[order[ranks] + offset]
            by = np.argsort(key)
            order[ranks] = order[ranks][by]
            # ranks of one slice may have gaps between buckets; a bucket itself has none
            left.append(point(ranks, key[by]))
        open_ranks = np.concatenate(left)
        offset *= 2
    return order


def covered_stretches(data: np.ndarray, places: np.ndarray, ids: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Which stretches at ``places`` also start, byte for byte, at a place with a smaller id."""
    which = np.full(len(data), -1, np.int64)
    which[places] = np.arange(len(places))
    ranked = which[bucket_pointer_refinement(data, span, wanted=which >= 0)]
    ranked = ranked[ranked >= 0]
    at, w = places[ranked], words_at(data)
    same = np.ones(max(0, len(at) - 1), bool)
    for k in {*range(0, span - 7, 8), span - 8}:
        same &= w[at[1:] + k] == w[at[:-1] + k]
    heads = np.flatnonzero(np.append(True, ~same)) if len(at) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(ids[ranked], heads) if len(at) else ids
    out = np.zeros(len(places), bool)
    out[ranked] = ids[ranked] > np.repeat(least, np.diff(np.append(heads, len(at))))
    return out


def _ranges(first: np.ndarray, flags: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of set flags at neighbouring places of one group: first place, last place, index of the first."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    new = np.append(True, (np.diff(first[at]) != 1) | (group[at][1:] != group[at][:-1]))
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(at)) - 1
    return first[at[a]], first[at[b]], at[a]


@lru_cache(maxsize=1)
def _packer() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _dense(block: int, bucket: int, **arrays: np.ndarray) -> dict:
    pack = _packer()[0].compress
    return {"block": block, "bucket": bucket, **{k: pack(np.ascontiguousarray(v).tobytes()) if len(v) else b"" for k, v in arrays.items()}}


def _plain(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(_packer()[1].decompress(blob) if blob else b"", dtype)


def _steps(names: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending names of one bucket as steps, their bytes by place: high bytes are mostly 0."""
    steps = np.diff(names // np.uint64(buckets), prepend=np.uint64(0))
    return np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T)


def _from_steps(blob: bytes, bucket: int, buckets: int) -> np.ndarray:
    steps = np.ascontiguousarray(_plain(blob, np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64) * np.uint64(buckets) + np.uint64(bucket)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if len(bucket) and 0 <= bucket.min() and bucket.max() < 65536:
        bucket = bucket.astype(np.uint16)  # numpy sorts these by counting
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(bucket[order][1:] != bucket[order][:-1]) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(bucket[part[0]]), part


NOTE = "block int, bucket int, ids binary, values binary, flags binary, data binary"
_NOTE = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), *[(k, pa.binary()) for k in ("ids", "values", "flags", "data")]])


def _notes(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_NOTE)


class Block:
    """The texts of a block that take part: the smallest ids of each text, one row of each."""

    def __init__(self, texts: pa.Table, notes: pa.Table):
        copies = {x for b in notes.filter(pc.equal(notes["bucket"], COPY))["ids"].to_pylist() for x in np.frombuffer(b, np.int64).tolist()}
        seen: set[int] = set()
        rows, tids = [], texts["_tid"].to_pylist()
        for i, t in enumerate(tids):
            if t not in copies and t not in seen:
                seen.add(t)
                rows.append(i)
        self.copies = copies
        self.texts = [x or b"" for x in texts["_bytes"].take(pa.array(rows, pa.int64())).to_pylist()]
        self.tid = np.array([tids[i] for i in rows], np.int64)
        self.ord = texts["_ord"].to_numpy()[rows] if rows else np.zeros(0, np.int64)
        self.data, self.starts = joined(self.texts)


COPY, COVERED = -1, -2  # bucket numbers of notes that are no buckets; a note of what is covered has COVERED - its block


def _first_pass(buckets: int, span: int):
    """Distinct names of each block, with how often they occur there in different documents (two mean: in several)."""

    def run(key, texts, notes):
        block = Block(texts, notes)
        first, _, names = runs_of(block.data, block.starts, span)
        text = np.searchsorted(block.starts, first, "right")
        # one entry for a name and text
        order = np.lexsort((text, names))
        names, text = names[order], text[order]
        new = np.append(True, (names[1:] != names[:-1]) | (text[1:] != text[:-1])) if len(names) else np.zeros(0, bool)
        names, count = np.unique(names[new], return_counts=True)
        rows = [_dense(key[0].as_py(), b, values=_steps(names[at], buckets), flags=np.minimum(count[at], 65535).astype(np.uint16), ids=np.zeros(0), data=np.zeros(0)) for b, at in _by_bucket((names % np.uint64(buckets)).astype(np.int64))]
        return _notes(rows)

    return run


def _shared_names(hot: int, buckets: int):
    """Names met in several documents go back to the blocks they came from; common ones are marked."""

    def run(key, rows):
        bucket = key[0].as_py()
        names = [_from_steps(b, bucket, buckets) for b in rows["values"].to_pylist()]
        counts = [_plain(b, np.uint16) for b in rows["flags"].to_pylist()]
        every, back = np.unique(np.concatenate(names), return_inverse=True)
        total = np.bincount(back, np.concatenate(counts), len(every))
        out, at = [], 0
        for block, own in zip(rows["block"].to_pylist(), names, strict=True):
            t = total[back[at:at + len(own)]]
            at += len(own)
            keep = t > 1
            if keep.any():
                out.append(_dense(block, bucket, values=_steps(own[keep], buckets), flags=(t[keep] > hot).astype(np.uint8), ids=np.zeros(0), data=np.zeros(0)))
        return _notes(out)

    return run


def _covered_note(block: int, tid: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict:
    return _dense(block, COVERED - block, ids=tid.astype(np.int64), values=np.stack([start, end], axis=1).astype(np.int64) if len(tid) else np.zeros(0), flags=np.zeros(0), data=np.zeros(0))


def _second_pass(buckets: int, span: int):
    """Runs of shared names, each sent once with its smallest id; what they cover inside the block is settled here."""

    def run(key, texts, notes):
        number = key[0].as_py()
        block = Block(texts, notes)
        replies = notes.filter(pc.greater_equal(notes["bucket"], 0))
        if not replies.num_rows:
            return _notes([])
        shared = np.concatenate([_from_steps(b, k, buckets) for b, k in zip(replies["values"].to_pylist(), replies["bucket"].to_pylist(), strict=True)])
        common = np.concatenate([_plain(b, np.uint8) for b in replies["flags"].to_pylist()])
        by = np.argsort(shared)
        shared, common = shared[by], common[by]
        first, count, names = runs_of(block.data, block.starts, span)
        at = np.minimum(np.searchsorted(shared, names), len(shared) - 1)
        keep = shared[at] == names
        first, count, names, is_common = first[keep], count[keep], names[keep], common[at[keep]] > 0
        # runs of common names become single stretches
        single = np.repeat(first[is_common] - (np.cumsum(count[is_common]) - count[is_common]), count[is_common]) + np.arange(int(count[is_common].sum()))
        first = np.concatenate([first[~is_common], single])
        size = np.concatenate([count[~is_common] + span - 1, np.full(len(single), span)])
        content = _content_hashes(block.data, first, size)
        bucket_key = np.concatenate([names[~is_common], content[len(first) - len(single):]])
        text = np.searchsorted(block.starts, first, "right") - 1
        ids = block.ord[text]
        gone, _ = _later_equals(block.data, first, size, ids, content)
        sent = np.ones(len(first), bool)
        sent[gone] = False
        sent = np.flatnonzero(sent)
        out = [_covered_note(number, block.tid[text[gone]], first[gone] - block.starts[text[gone]], first[gone] + size[gone] - block.starts[text[gone]])] if len(gone) else []
        for b, part in _by_bucket((bucket_key[sent] % np.uint64(buckets)).astype(np.int64)):
            r = sent[part]
            meta = np.stack([ids[r], block.tid[text[r]], first[r] - block.starts[text[r]], bucket_key[r].view(np.int64)], axis=1)
            out.append(_dense(number, b, ids=meta, values=size[r], data=_gather(block.data, first[r], size[r]), flags=np.zeros(0)))
        return _notes(out)

    return run


def _content_hashes(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    if not len(first):
        return np.zeros(0, np.uint64)
    return span_hashes(data[:len(data) - PAD], first, first + size)


def _gather(data: np.ndarray | bytes, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Several stretches of the data, one behind the other."""
    raw = data if isinstance(data, bytes) else data.tobytes()
    return np.frombuffer(b"".join([raw[a:z] for a, z in zip(first.tolist(), (first + size).tolist(), strict=True)]), np.uint8)


def _later_equals(data: np.ndarray, first: np.ndarray, size: np.ndarray, ids: np.ndarray, content: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Runs whose bytes equal those of a run with a smaller id, and that run. Equal hashes are checked byte by byte."""
    content = _content_hashes(data, first, size) if content is None else content
    order = np.lexsort((first, ids, content))
    head = np.append(True, content[order][1:] != content[order][:-1]) if len(order) else np.zeros(0, bool)
    lead = order[head][np.cumsum(head) - 1] if len(order) else order
    later = ids[order] > ids[lead]
    gone, lead = order[later], lead[later]
    equal = _equal_runs(data, first, size, gone, lead)
    return gone[equal], lead[equal]


def _equal_runs(data: np.ndarray, first: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not len(a):
        return np.zeros(0, bool)
    raw = data.tobytes()
    pairs = zip(first[a].tolist(), (first + size)[a].tolist(), first[b].tolist(), (first + size)[b].tolist(), strict=True)
    return np.fromiter((raw[i:j] == raw[k:m] for i, j, k, m in pairs), bool, len(a))


def _settle(span: int):
    """The suffix array of a bucket's runs: which stretches are covered.

    Of runs with equal bytes only one of the smallest id is sorted, the later ones are covered whole; and a name that is left with one
    document's runs has nothing to compare.
    """

    def run(key, rows):
        if key[0].as_py() <= COVERED:
            return rows.select(_NOTE.names).cast(_NOTE)
        out = []
        sizes = [_plain(b, np.int64) for b in rows["values"].to_pylist()]
        meta = np.concatenate([_plain(b, np.int64).reshape(-1, 4) for b in rows["ids"].to_pylist()])
        block = np.repeat(np.array(rows["block"].to_pylist(), np.int64), [len(s) for s in sizes])
        size = np.concatenate(sizes)
        data = np.concatenate([*[_plain(b, np.uint8) for b in rows["data"].to_pylist()], np.zeros(PAD, np.uint8)])
        starts = np.concatenate([[0], np.cumsum(size)])
        gone, lead = _later_equals(data, starts[:-1], size, meta[:, 0])
        for number, part in _by_bucket(block[gone]):
            r = gone[part]
            out.append(_covered_note(number, meta[r, 1], meta[r, 2], meta[r, 2] + size[r]))
        left = np.ones(len(size), bool)
        left[gone] = False
        left = np.flatnonzero(left)
        name, number = np.unique(meta[left, 3], return_inverse=True)
        least, most = np.full(len(name), LAST), np.full(len(name), -LAST)
        np.minimum.at(least, number, meta[left, 0])
        np.maximum.at(most, number, meta[left, 0])
        left = left[(least < most)[number]]
        if not len(left):
            return _notes(out)
        # names one behind the other; a suffix array holds whole names, so equal stretches meet in it
        left = left[np.argsort(meta[left, 3], kind="stable")]
        size, meta, block, first = size[left], meta[left], block[left], starts[left]
        names = np.flatnonzero(np.append(True, meta[1:, 3] != meta[:-1, 3]))
        filled = (np.cumsum(size) - size)[names] // SORT_BYTES
        cuts = names[np.flatnonzero(filled[1:] != filled[:-1]) + 1]
        found, raw = [], data.tobytes()
        for part in np.split(np.arange(len(left)), cuts):
            own = np.append(_gather(raw, first[part], size[part]), np.zeros(PAD, np.uint8))
            begin = np.concatenate([[0], np.cumsum(size[part])])
            places = stretch_places(begin, span)
            run_of = np.searchsorted(begin, places, "right") - 1
            covered = covered_stretches(own, places, meta[part[run_of], 0], span)
            a, b, at = _ranges(places, covered, run_of)
            shift = meta[part[run_of[at]], 2] - begin[run_of[at]]
            found.append((part[run_of[at]], a + shift, b + shift + span))
        r, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        for number, part in _by_bucket(block[r]):
            out.append(_covered_note(number, meta[r[part], 1], a[part], b[part]))
        return _notes(out)

    return run


def _merged(tids: np.ndarray, ranges: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Ranges of each row in order; those that touch are one."""
    if not len(tids):
        return {}
    order = np.lexsort((ranges[:, 0], tids))
    tid, start, end = tids[order], ranges[order, 0], ranges[order, 1]
    # ends only grow: rows one behind the other, each on a stretch of its own
    row = np.cumsum(np.append(False, tid[1:] != tid[:-1])) * (int(end.max(initial=0)) + 1)
    last = np.maximum.accumulate(end + row)
    at = np.flatnonzero(np.append(True, start[1:] + row[1:] > last[:-1]))
    out: dict[int, list[tuple[int, int]]] = {}
    for t, a, z in zip(tid[at].tolist(), start[at].tolist(), (last - row)[np.append(at[1:], len(tid)) - 1].tolist(), strict=True):
        out.setdefault(t, []).append((a, z))
    return out


def _cut(keep: list[str], fields: list[pa.Field], span: int, as_text: bool):
    """Remove what is covered from every row of a block."""

    def run(key, texts, notes):
        copies, tids, ranges = set(), [], []
        for bucket, ids, values in zip(notes["bucket"].to_pylist(), notes["ids"].to_pylist(), notes["values"].to_pylist(), strict=True):
            if bucket == COPY:
                copies.update(np.frombuffer(ids, np.int64).tolist())
            elif bucket <= COVERED:
                tids.append(_plain(ids, np.int64))
                ranges.append(_plain(values, np.int64).reshape(-1, 2))
        covered = _merged(np.concatenate(tids), np.concatenate(ranges)) if tids else {}
        kept, removed, spans = [], [], []
        for tid, raw in zip(texts["_tid"].to_pylist(), texts["_bytes"].to_pylist(), strict=True):
            raw = raw or b""
            gone = [(0, len(raw))] if tid in copies and len(raw) >= span else [] if tid in copies else covered.get(tid, [])
            if gone:
                edges = [0, *(x for r in gone for x in r), len(raw)]
                kept.append(b"".join([raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)]))
            else:
                kept.append(raw)
            removed.append(sum(z - a for a, z in gone))
            spans.append(len(gone))
        cols = [texts[c].cast(f.type) for c, f in zip(keep, fields, strict=True)]
        return pa.table([*cols, texts["_n"], pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())], names=[*keep, "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, hot: int = HOT, block_bytes: int = BLOCK_BYTES, as_text: bool = False) -> DataFrame:
    """The input's columns but the text, with ``n_bytes, n_removed, n_spans, kept``: the bytes that stay, or the letters that are whole in them."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    keep = [c for c in without(docs, text_col, "n_bytes", "n_removed", "n_spans", "kept") if c not in ("_block", "_tid", "_ord", "_bytes", "_n")]
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    total = docs.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(shuffle_parts(spark), int(total // block_bytes) + 1)
    block = F.pmod(F.xxhash64(F.lit("block"), order), F.lit(blocks)).cast("int")
    tid = F.xxhash64(order, raw)
    narrow = docs.select(block.alias("block"), tid.alias("tid"), order.alias("ord"), F.sha2(raw, 256).alias("sha"))
    narrow = written(narrow, "text-ids")
    several = written(narrow.groupBy("sha").agg(F.min("ord").alias("least"), F.max("ord").alias("most")).where("least < most").select("sha", "least"), "texts-repeated")
    late = narrow.join(several, "sha").where("ord > least").select("block", "tid").distinct()
    copies = written(late.groupBy("block").agg(F.collect_list("tid").alias("tids")), "copies")  # bounded by a block's rows
    copies = _longs(copies)
    texts = docs.select(block.alias("block"), tid.alias("_tid"), order.alias("_ord"), raw.alias("_bytes"), F.octet_length(raw).cast("long").alias("_n"), *keep)
    by_block, note = texts.groupBy("block"), NOTE

    def with_notes(notes: DataFrame, fn, schema) -> DataFrame:
        return by_block.cogroup(notes.groupBy("block")).applyInArrow(fn, schema)

    names = with_notes(copies, _first_pass(blocks, span), note)
    shared = names.groupBy("bucket").applyInArrow(_shared_names(hot, blocks), note)
    sent = with_notes(copies.unionByName(shared), _second_pass(blocks, span), note)
    settled = sent.groupBy("bucket").applyInArrow(_settle(span), note)
    kinds = StructType([docs.schema[c] for c in keep])
    schema = StructType(list(kinds.fields)).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "string" if as_text else "binary")
    fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in kinds.fields]
    return with_notes(copies.unionByName(settled), _cut(keep, fields, span, as_text), schema)


def _longs(copies: DataFrame) -> DataFrame:
    """Lists of row names as notes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"block": k, "bucket": COPY, "ids": np.array(t, np.int64).tobytes(), "values": b"", "flags": b"", "data": b""} for k, t in zip(b["block"].to_pylist(), b["tids"].to_pylist(), strict=True)]
            yield from pa.Table.from_pylist(rows, schema=_NOTE).to_batches()

    return copies.mapInArrow(run, NOTE)


def op4(spark, sf_dir: str) -> DataFrame:
    """Repeated 50-byte strings removed from every document."""
    out = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
