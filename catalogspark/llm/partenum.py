"""Near duplicates by Jaccard similarity of word shingles, with PartEnum signatures.

Sets are put into size bands so that similar sets lie in one band or in neighbouring ones. For a pair of bands the threshold bounds the number of
features in which two similar sets differ, K. The feature domain is partitioned into K // 2 + 1 groups of three partitions and some spare ones: one more
group than there are spares holds at most one difference, so two of its three partitions agree. Each set is signed with every subset of two partitions of each
group; two similar sets share a signature, whatever their features are. Subsets without features say nothing and are not signed; a set with more such
groups than there are spares is signed again with other partitions, as its similar sets are, and with the empty subsets themselves only after ``LEVELS``
tries. The spares of a band follow from how many such groups its smallest sets are expected to have, so that long texts are seldom signed twice.

1. One pass over the texts gives each document's set size, set name (128 bits) and a parity sketch, whose width is a power of two and at least four times
   the differences that sets of its size may have: strangers differ in half the bits at every size. Documents with equal sets are one node.
2. A second pass sends signatures to buckets by their hash; equal sets of a task are sent once. Sets that share a signature are a list; its
   first set is its pivot. A bucket yields the pairs (pivot, member), not all pairs.
3. Pairs whose sketches differ in more bits than their sizes allow are dissimilar (of two widths the wider sketch is folded). The others are compared exactly on
   their texts: the text of a pivot goes to each ``CHUNK`` of its pairs once, the text of the other side follows it there.
4. Where a member did not come to its pivot's component, members of the list may still be similar to each other. These lists are taken up again:
   members of different components are compared by sketch (large lists in pieces that meet pairwise in separate tasks). What passes connects members to
   clumps; the texts of a clump meet in one task, which compares them exactly and yields the links that join components, fewer than the clump has members.
5. Components of the confirmed links are the duplicate groups.

Defined cases: a null text, or one without words, has no features and is linked with nothing; a text of fewer words than a shingle has one feature, the
whole sequence; a null id is the largest; repeated rows get the same result each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components, merged
from .common import discard, documents, map_arrow, shuffle_parts, written
from .segment import mixed, span_hashes

LEVELS, BITS, CHUNK = 4, 1024, 256
PART_BYTES = 1_500_000
PIECE_ROWS, PIECE_FEATURES = 2000, 2_000_000
LAST = (1 << 63) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


@dataclass
class Sets:
    """Distinct shingle hashes of several texts, text by text."""

    features: np.ndarray
    sizes: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums modulo 2**64 of one value per feature, per text."""
        out = np.zeros(len(self.sizes), np.uint64)
        some = np.flatnonzero(self.sizes)
        if len(some):
            out[some] = np.add.reduceat(values, (np.cumsum(self.sizes) - self.sizes)[some])
        return out


def shingle_sets(texts: list[bytes], words: int) -> Sets:
    """Lower-case A-Z, cut at ASCII white space, hash every ``words`` neighbouring words."""
    data = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    n = len(data)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[1], space.view(np.int8), [1]])))
    starts, ends = edge[::2], edge[1::2]
    ends = np.minimum(ends, n)
    firsts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1].astype(np.int64)
    owner = np.searchsorted(firsts, starts, "right") - 1
    h = span_hashes(data, starts, ends)
    count = np.bincount(owner, minlength=len(texts))
    out = mixed(h)
    for k in range(1, words):
        out = mixed(out[:len(h) - k] * np.uint64(3) + h[k:]) if len(h) > k else out[:0]
    whole = owner[:len(out)] == owner[words - 1:] if len(out) else np.zeros(0, bool)
    features, who = out[whole], owner[:len(out)][whole]
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        begin = np.cumsum(count) - count
        extra = []
        for d in short.tolist():
            v = np.full(1, count[d], np.uint64)
            for x in h[begin[d]:begin[d] + count[d]]:
                v = mixed(v * np.uint64(5) + x)
            extra.append(v)
        features, who = np.concatenate([features, *extra]), np.concatenate([who, short])
    order = np.lexsort((features, who))
    features, who = features[order], who[order]
    new = np.ones(len(features), bool)
    new[1:] = (features[1:] != features[:-1]) | (who[1:] != who[:-1])
    return Sets(features[new], np.bincount(who[new], minlength=len(texts)))


def set_names(s: Sets) -> tuple[np.ndarray, np.ndarray]:
    size = s.sizes.astype(np.uint64)
    return mixed(s.sums(mixed(s.features)) + size), mixed(s.sums(mixed(s.features ^ np.uint64(0x5851F42D4C957F2D))) ^ size)


def sketches(s: Sets, percent: int = 85) -> list[np.ndarray]:
    """Parities of the features per bit: as many bits differ as features do, or fewer."""
    need = np.maximum(4 * allowed(percent, 2 * s.sizes), BITS)
    width = np.int64(1) << np.ceil(np.log2(need)).astype(np.int64)
    first = np.cumsum(width) - width
    flips = np.zeros(int(width.sum()), np.uint8)
    bit = mixed(s.features ^ np.uint64(0x2545F4914F6CDD1D)) % np.repeat(width, s.sizes).astype(np.uint64)
    np.bitwise_xor.at(flips, np.repeat(first, s.sizes) + bit.astype(np.int64), np.uint8(1))
    # words with the lowest bit first: bit k of a sketch is bit k % 64 of its word k // 64, so that halves fold onto each other
    packed = np.packbits(flips, bitorder="little")
    return [packed[i // 8:(i + w) // 8] for i, w in zip(first.tolist(), width.tolist(), strict=True)]


class Bands:
    """Size bands of a threshold ``percent``, and how many features similar sets of two neighbouring bands differ in at most."""

    def __init__(self, percent: int, largest: int):
        self.percent = percent
        low, self.tops = 1, []
        while not self.tops or self.tops[-1] < largest:
            self.tops.append(100 * low // percent)
            low = self.tops[-1] + 1
        tops = np.array(self.tops, np.int64)
        self.differ = allowed(percent, tops + 100 * tops // percent)
        self.groups = self.differ // 2 + 2
        smallest = np.concatenate([[1], tops[:-1] + 1])
        for _ in range(4):  # spares make groups smaller, and so some more of them empty
            blank = self.groups * np.minimum(3 * np.exp(-2 * smallest / (3 * self.groups)), 1)
            spare = 1 + np.ceil(blank + 2 * np.sqrt(blank)).astype(np.int64)
            self.groups = self.differ // 2 + 1 + np.minimum(spare, 1 + self.differ // 12)
        self.spare = self.groups - self.differ // 2 - 1

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.tops, sizes)


def allowed(percent: int, both):
    """In how many features two similar sets of ``both`` features together differ at most."""
    return (100 - percent) * both // (100 + percent)


def signatures(s: Sets, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and the texts they belong to."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    band, begin = bands.of(s.sizes), np.cumsum(s.sizes) - s.sizes
    content = mixed(s.features ^ np.uint64(0x9FB21C651E98DF25))
    for shift in (0, 1):
        instance = band - shift
        active = np.flatnonzero((s.sizes > 0) & (instance >= 0))
        active = active[bands.differ[instance[active]] > 0]  # else only equal sets are similar
        for level in range(LEVELS):
            if not len(active):
                break
            sizes = s.sizes[active]
            where = np.arange(int(sizes.sum())) + np.repeat(begin[active] - (np.cumsum(sizes) - sizes), sizes)
            groups, spare = bands.groups[instance[active]], bands.spare[instance[active]]
            base = np.cumsum(groups) - groups
            salt = mixed(instance[active].astype(np.uint64) * np.uint64(LEVELS) + np.uint64(level))
            place = mixed(s.features[where] ^ np.repeat(salt, sizes))
            group = (place >> np.uint64(24)) % np.repeat(groups, sizes).astype(np.uint64)
            slot = (np.repeat(base, sizes) + group.astype(np.int64)) * 3 + (place % np.uint64(3)).astype(np.int64)
            total = int(groups.sum())
            sums = np.zeros(total * 3, np.uint64)
            np.add.at(sums, slot, content[where])
            held = np.bincount(slot, minlength=total * 3).reshape(-1, 3)
            sums = mixed(sums).reshape(-1, 3)
            text = np.repeat(active, groups)
            number = np.arange(total) - np.repeat(base, groups)
            key = mixed(np.repeat(salt, groups) + number.astype(np.uint64))
            empty = np.zeros((total, 3), bool)
            signed = np.zeros((total, 3), np.uint64)
            for left_out in range(3):
                a, b = (left_out + 1) % 3, (left_out + 2) % 3
                empty[:, left_out] = held[:, a] + held[:, b] == 0
                signed[:, left_out] = mixed(sums[:, a] * np.uint64(3) + sums[:, b] + key * np.uint64(5) + np.uint64(left_out))
            bad = np.add.reduceat(empty.any(axis=1).astype(np.int64), base) > spare
            use = ~empty
            if level == LEVELS - 1:
                use |= np.repeat(bad, groups)[:, None]
            rows, _ = np.nonzero(use)
            out.append((signed[use], text[rows]))
            active = active[bad]
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _parts(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    k = 0
    while k < len(texts):
        first, size = k, 0
        while k < len(texts) and (size == 0 or size + len(texts[k]) <= PART_BYTES):
            size += len(texts[k])
            k += 1
        yield first, k


FACT = "size long, s1 long, s2 long, sketch binary"


def set_facts(base: DataFrame, words: int, percent: int) -> DataFrame:
    """``doc_id, ord, tid`` with each document's set size, name and sketch."""
    keep = ["doc_id", "ord", "tid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column("raw").to_pylist()]
            size, one, two, sketch = [], [], [], []
            for i, j in _parts(texts):
                s = shingle_sets(texts[i:j], words)
                a, c = set_names(s)
                size.append(s.sizes)
                one.append(a.view(np.int64))
                two.append(c.view(np.int64))
                sketch += [x.tobytes() for x in sketches(s, percent)]
            none = [np.zeros(0, np.int64)]
            cols = [pa.array(np.concatenate(x or none).astype(np.int64)) for x in (size, one, two)] + [pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + cols, names=[*keep, "size", "s1", "s2", "sketch"])

    kinds = ", ".join(f"{c} {dict(base.dtypes)[c]}" for c in keep)
    return map_arrow(base, run, f"{kinds}, {FACT}")


def signature_notes(base: DataFrame, words: int, bands: Bands, buckets: int) -> DataFrame:
    """``bucket`` and packed signatures with the sets they belong to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        seen: set[int] = set()
        held: list[bytes] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            names, signs, who = [], [], []
            at = 0
            for i, j in _parts(held):
                s = shingle_sets(held[i:j], words)
                name, _ = set_names(s)
                fresh = np.zeros(len(name), bool)
                for k, x in enumerate(name.tolist()):
                    if x not in seen:
                        if len(seen) < 200_000:  # a set forgotten is only sent once more
                            seen.add(x)
                        fresh[k] = True
                keep = np.flatnonzero(fresh)
                first = np.cumsum(s.sizes) - s.sizes
                sizes = s.sizes[keep]
                where = np.arange(int(sizes.sum())) + np.repeat(first[keep] - (np.cumsum(sizes) - sizes), sizes)
                sig, text = signatures(Sets(s.features[where], sizes), bands)
                signs.append(sig)
                who.append(text + at)
                names.append(name[keep])
                at += len(keep)
            if not signs:
                return
            name, sig, text = np.concatenate(names), np.concatenate(signs), np.concatenate(who)
            bucket = (sig % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((text, bucket))
            rows = []
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
                texts, counts = np.unique(text[part], return_counts=True)
                short = np.ascontiguousarray(sig[part]).view(np.uint8).reshape(-1, 8)[:, 2:]  # the upper 48 bits
                rows.append({"bucket": int(bucket[part[0]]), "signs": short.tobytes(), "sets": name[texts].tobytes(), "counts": packer.compress(counts.astype(np.uint32).tobytes())})
            yield from pa.Table.from_pylist(rows, schema=pa.schema([("bucket", pa.int32()), ("signs", pa.binary()), ("sets", pa.binary()), ("counts", pa.binary())])).to_batches()

        for b in batches:
            for t in b.column("raw").to_pylist():
                held.append(t or b"")
                size += len(held[-1])
            if size >= 6 * PART_BYTES:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return map_arrow(base.select("raw"), run, "bucket int, signs binary, sets binary, counts binary")


def _lists(key, rows):
    """The sets of each signature that several share: the pivot and all members."""
    signs, sets = [], []
    for a, b, c in zip(rows["signs"].to_pylist(), rows["sets"].to_pylist(), rows["counts"].to_pylist(), strict=True):
        short = np.frombuffer(a, np.uint8).reshape(-1, 6)
        wide = np.zeros((len(short), 8), np.uint8)
        wide[:, :6] = short
        signs.append(wide.view(np.uint64).ravel())
        sets.append(np.repeat(np.frombuffer(b, np.int64), np.frombuffer(zstandard.ZstdDecompressor().decompress(c), np.uint32)))
    sign, name = np.concatenate(signs), np.concatenate(sets)
    # most signatures stand alone: drop them before sorting by set
    order = np.argsort(sign)
    same = sign[order][1:] == sign[order][:-1]
    several = order[np.append(same, False) | np.append(False, same)]
    order = several[np.lexsort((name[several], sign[several]))]
    sign, name = sign[order], name[order]
    new = np.ones(len(sign), bool)
    new[1:] = (sign[1:] != sign[:-1]) | (name[1:] != name[:-1])
    sign, name = sign[new], name[new]
    first = np.flatnonzero(np.append(True, sign[1:] != sign[:-1])) if len(sign) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(sign)))
    first, size = first[size > 1], size[size > 1]
    if not len(first):
        return pa.table({"pivot": pa.array([], pa.int64()), "members": pa.array([], pa.list_(pa.int64()))})
    # equal lists once
    where = np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)
    code = np.add.reduceat(mixed(name[where].view(np.uint64)), np.cumsum(size) - size) + size.astype(np.uint64)
    _, one = np.unique(code, return_index=True)
    first, size = first[one], size[one]
    where = np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.table({"pivot": pa.array(name[first]), "members": pa.ListArray.from_arrays(pa.array(offsets), pa.array(name[where]))})


def sketch_near(a: str, b: str, size_a: str, size_b: str, percent: int) -> Column:
    """Whether two sets may be similar, by their sizes and sketches (arrays of 64-bit words)."""
    n = F.least(F.size(a), F.size(b))
    folded = lambda x, i: F.aggregate(F.sequence(i, F.size(x) - 1, n), F.lit(0).cast("long"), lambda v, k: v.bitwiseXOR(F.get(F.col(x), k)))
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    other = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + F.bit_count(folded(a, i).bitwiseXOR(folded(b, i))))
    low, high = F.least(size_a, size_b), F.greatest(size_a, size_b)
    bits = F.when(F.size(a) == F.size(b), same).otherwise(other)
    return (low * 100 >= high * percent) & (bits <= F.floor((F.col(size_a) + F.col(size_b)) * (100 - percent) / (100 + percent)))


def _words(sketch: str) -> Column:
    """A sketch as 64-bit words."""
    last = F.expr(f"cast(length({sketch}) / 8 as int) - 1")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.conv(F.hex(F.substring(F.col(sketch), k * 8 + 1, F.lit(8))), 16, -10).cast("long"))


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` of nodes and whether their texts are similar; ``texts`` has ``node, raw``.

    A node ``a`` with many pairs is dealt to chunks by the hash of the other side; the rows of a chunk follow each other, the text of ``a`` first, so
    that a task holds one set besides its batch.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("m"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("m")).cast("int").alias("chunk"))
    none = F.lit(None).cast(pairs.schema["b"].dataType)
    heads = dealt.select("a", "chunk").distinct().select(F.col("a").alias("node"), "a", "chunk", none.alias("b"))
    rows = heads.unionByName(dealt.select(F.col("b").alias("node"), "a", "chunk", "b")).join(merged(texts), "node").select("a", "chunk", "b", "raw")
    together = rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for t in batches:
            raw, is_head = t.column("raw").to_pylist(), t.column("b").is_null().to_pylist()
            good = np.zeros(len(raw), bool)
            at = 0
            for i, j in _parts(raw):
                s = shingle_sets(raw[i:j], words)
                ends = np.cumsum(s.sizes)
                for k in range(j - i):
                    own = s.features[ends[k] - s.sizes[k]:ends[k]]
                    if is_head[at]:
                        head = own.copy()
                    else:
                        common = len(np.intersect1d(head, own, assume_unique=True))
                        good[at] = common > 0 and 100 * common >= percent * (len(head) + len(own) - common)
                    at += 1
            found = pa.Table.from_batches([t.select(["a", "b"])]).append_column("similar", pa.array(good, pa.bool_()))
            yield from found.filter(t.column("b").is_valid()).to_batches()

    kind = pairs.schema["a"].dataType.simpleString()
    return map_arrow(together, run, f"a {kind}, b {kind}, similar boolean")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row, and ``ord, tid`` that name the row."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    base = docs.select(F.col(id_col).alias("doc_id"), order.alias("ord"), F.xxhash64(order, raw).alias("tid"), raw.alias("raw"))
    facts = written(set_facts(base, words, percent), "set-facts")
    used: list[str] = []
    listed: list[str] = []
    largest = facts.agg(F.max("size")).first()[0] or 1
    bands = Bands(percent, largest)
    # a node is a set; it is named by the smallest of its documents
    nodes = facts.where("size > 0").groupBy("s1", "s2").agg(F.min(F.struct("ord", "tid")).alias("node"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    nodes = written(nodes.select("s1", "s2", "node", "size", _words("sketch").alias("sketch")), "set-nodes")
    buckets = 4 * shuffle_parts(spark)
    lists = written(signature_notes(base, words, bands, buckets).groupBy("bucket").applyInArrow(_lists, "pivot long, members array<long>"), "signature-lists", listed)
    pairs = lists.select("pivot", F.explode("members").alias("member")).where("pivot <> member").distinct()

    def judged(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs of nodes with what an exact comparison says of them."""
        done: list[str] = []
        pairs = written(pairs, f"{name}-pairs", done)
        out = written(confirm(pairs, texts, words, percent), f"{name}-judged", used)
        discard(spark, done)
        return out

    n = lambda side: nodes.select(F.col("s1").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("node", "size", "sketch")])
    seen = written(pairs.join(merged(n("pivot")), "pivot").join(merged(n("member")), "member").select(
        "pivot", "member", F.col("node_pivot").alias("a"), F.col("node_member").alias("b"), sketch_near("sketch_pivot", "sketch_member", "size_pivot", "size_member", percent).alias("near")), "pivot-pairs", listed)

    def apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
        """The pairs whose nodes are in different components."""
        of = lambda side: label.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))
        both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
        return both.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).drop("_a", "_b")

    def components(judgements: DataFrame, name: str) -> DataFrame:
        return written(connected_components(judgements.where("similar").select(F.col("a").alias("src"), F.col("b").alias("dst"))), name, used)

    # texts of lists' members are shuffled out of all texts once, at every size; later steps read these alone
    ids = seen.select(F.col("a").alias("node")).unionByName(seen.select(F.col("b").alias("node"))).distinct()
    ids = written(ids.select(F.col("node.tid").alias("tid"), "node"), "list-ids", used)
    texts = written(base.select("tid", "raw").join(merged(ids), "tid").dropDuplicates(["tid", "node"]).select("node", "raw"), "list-texts", used)

    # one pair a member first; of the others only those that would still join two components
    near = seen.where("near").select("a", "b").distinct()
    start = judged(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first-pivot")
    more = apart(near.join(start.select("a", "b"), ["a", "b"], "left_anti"), components(start, "first-components"))
    first = start.unionByName(judged(more, "pivot"))
    label = components(first, "pivot-components")

    # lists in which a member did not come to its pivot's component
    failed = apart(seen.select("pivot", "a", "b"), label).select("pivot").distinct()
    doubtful = lists.where(F.size("members") > 2).join(failed, "pivot", "left_semi").select(F.xxhash64("members").alias("g"), "pivot", "members").dropDuplicates(["g", "members"])
    members = doubtful.select("g", "pivot", F.size("members").alias("m"), F.explode("members").alias("s1")).withColumn("head", F.col("s1") == F.col("pivot"))
    # sketches stay behind until it is known which lists are compared
    sized = nodes.select("s1", "node", "size").join(label.select("node", "component"), "node", "left").select("s1", "node", "size", F.coalesce("component", "node").alias("component"))
    member = written(members.join(sized, "s1").select("g", "m", "head", "s1", "node", "size", "component"), "list-members", used)
    discard(spark, listed)
    mixed_lists = member.groupBy("g").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum("size").alias("features")).where("low <> high").select("g", "features")
    pieces = F.greatest(F.ceil(F.col("m") / PIECE_ROWS), F.ceil(F.col("features") / PIECE_FEATURES)).cast("int")
    own = F.pmod(F.xxhash64("node"), pieces).cast("int")
    again = written(member.join(mixed_lists, "g").select("g", pieces.alias("pieces"), own.alias("own"), "head", "s1", "node", "component"), "lists-again", used)
    again = again.join(merged(nodes.select("s1", "node", "size", "sketch")), ["s1", "node"])
    spread = again.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    spread = spread.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "head", "node", "size", "sketch", "component")
    kind = nodes.schema["node"].dataType.simpleString()
    clumps = written(spread.groupBy("g", "i", "j").applyInArrow(_clumps(percent), f"clump long, node {kind}, component {kind}").distinct(), "clumps", used)
    second = clump_links(clumps, texts, words, percent)
    links = written(first.where("similar").select("a", "b").unionByName(second).select(F.col("a").alias("src"), F.col("b").alias("dst")), "set-links", used)
    final = written(connected_components(links), "set-components")
    discard(spark, used)
    of_set = nodes.join(final, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("component"))
    result = facts.join(of_set, ["s1", "s2"], "left")
    own_id = F.when(F.col("component").isNotNull() & (F.col("component.ord") != LAST), F.col("component.ord")).otherwise(F.col("doc_id").cast("long"))
    return result.select("doc_id", F.col("size").alias("n_shingles"), own_id.alias("component_id"), "ord", "tid", "component")


class Sketches:
    """Sizes and sketches (arrays of 64-bit words) of some sets, those of one width stacked."""

    def __init__(self, size: np.ndarray, sketch: list[np.ndarray], percent: int):
        self.size, self.sketch, self.percent = size, sketch, percent
        self.width = np.array([len(x) for x in sketch], np.int64)
        self.place = np.zeros(len(sketch), np.int64)
        self.stacked = {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.place[at] = np.arange(len(at))
            self.stacked[w] = np.stack([sketch[k] for k in at.tolist()])

    def near(self, p: int, q: np.ndarray) -> np.ndarray:
        """Those of the sets ``q`` that may be similar to the set ``p``."""
        size = self.size
        q = q[np.minimum(size[q], size[p]) * 100 >= np.maximum(size[q], size[p]) * self.percent]
        bits = np.zeros(len(q), np.int64)
        for w in np.unique(self.width[q]).tolist():
            of, n = self.width[q] == w, min(w, len(self.sketch[p]))
            words = np.bitwise_xor.reduce(self.stacked[w][self.place[q[of]]].reshape(-1, w // n, n), axis=1)
            bits[of] = np.bitwise_count(words ^ np.bitwise_xor.reduce(self.sketch[p].reshape(-1, n), axis=0)).sum(axis=1)
        return q[bits <= allowed(self.percent, size[q] + size[p])]


def _clumps(percent: int):
    """Members of one piece pair of a list that may be similar to one of another component, each with the name of its clump: what such pairs connect.

    Pairs with the pivot were judged before. At most one row a member is returned, however many pairs there are.
    """

    def run(key, rows):
        i, j = key[1].as_py(), key[2].as_py()
        own, head = rows["own"].to_numpy(), rows["head"].to_numpy()
        nodes = np.array([(x["ord"], x["tid"]) for x in rows["node"].to_pylist()], np.int64)
        _, component = np.unique(np.array([(x["ord"], x["tid"]) for x in rows["component"].to_pylist()], np.int64), axis=0, return_inverse=True)
        component = component.ravel()
        sets = Sketches(rows["size"].to_numpy(), [np.array(x, np.int64).view(np.uint64) for x in rows["sketch"].to_pylist()], percent)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        clump, found = np.arange(len(nodes)), np.zeros(len(nodes), bool)
        for p in left.tolist():
            q = right[right > p] if i == j else right
            q = sets.near(p, q[(component[q] != component[p]) & (head[q] == head[p])])
            if len(q):
                found[p] = found[q] = True
                of = np.unique(clump[np.append(q, p)])
                clump[np.isin(clump, of)] = of[0]
        at = np.flatnonzero(found)
        names = nodes.view(np.uint64)
        total = np.zeros(len(nodes), np.uint64)
        np.add.at(total, clump[at], mixed(mixed(names[at, 0]) * np.uint64(3) + names[at, 1]))
        # the same members in another list are the same clump
        return pa.table({"clump": pa.array(mixed(total)[clump[at]].view(np.int64), pa.int64()), **{c: rows[c].take(pa.array(at)) for c in ("node", "component")}})

    return run


def joined(sets: list[np.ndarray], component: list, percent: int) -> list[tuple[int, int]]:
    """Similar pairs of sets that join their components: of the pairs compared exactly, no more than there are components to join."""
    size = np.array([len(x) for x in sets], np.int64)
    numbers: dict = {}
    root = np.array([numbers.setdefault(c, len(numbers)) for c in component], np.int64)
    sketch = Sketches(size, [np.frombuffer(x.tobytes(), np.uint64) for x in sketches(Sets(np.concatenate(sets), size), percent)], percent)
    out = []
    for p in range(len(sets) - 1):
        q = np.arange(p + 1, len(sets))
        q = sketch.near(p, q[root[q] != root[p]])
        if not len(q):
            continue
        own, others = sets[p], np.concatenate([sets[k] for k in q.tolist()])
        at = np.minimum(np.searchsorted(own, others), len(own) - 1)
        common = np.add.reduceat((own[at] == others).astype(np.int64), np.cumsum(size[q]) - size[q])
        for k in q[100 * common >= percent * (size[p] + size[q] - common)].tolist():
            if root[k] != root[p]:
                out.append((p, k))
                root[root == root[k]] = root[p]
    return out


def clump_links(clumps: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``a, b``: similar nodes that join the components in a clump. The rows of a clump follow each other, so that a task holds one clump's sets."""
    rows = clumps.join(merged(texts), "node").select("clump", "node", "component", "raw")
    together = rows.repartition("clump").sortWithinPartitions("clump", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, component, sets = None, [], [], []

        def found() -> Iterator[pa.RecordBatch]:
            pairs = joined(sets, component, percent) if len(sets) > 1 else []
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[x[side]] for x in pairs], kind) for side in (0, 1)], names=["a", "b"])

        for t in batches:
            kind = t.schema.field("node").type
            raw, clump, node, of = (t.column(c).to_pylist() for c in ("raw", "clump", "node", "component"))
            for i, j in _parts(raw):
                s = shingle_sets(raw[i:j], words)
                ends = np.cumsum(s.sizes)
                for k in range(j - i):
                    if clump[i + k] != now:
                        yield from found()
                        now, nodes, component, sets = clump[i + k], [], [], []
                    nodes.append(node[i + k])
                    component.append((of[i + k]["ord"], of[i + k]["tid"]))
                    sets.append(s.features[ends[k] - s.sizes[k]:ends[k]].copy())
        yield from found()

    kind = clumps.schema["node"].dataType.simpleString()
    return map_arrow(together, run, f"a {kind}, b {kind}")


def op6(spark, sf_dir: str) -> DataFrame:
    """Duplicate groups of all documents: 4-word shingles, similarity of 0.85 or more."""
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
