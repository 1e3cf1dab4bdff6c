"""Conversation prefix trie: union-find over the common prefixes of sorted neighbours.

Every conversation is a string of turn digests. The strings are sorted globally by ranges; neighbours in this order have a longest common prefix (LCP). A
task takes the edges between its neighbours in descending depth and joins their components with union-find: a join at a depth where neither
component has a node creates a branching node, so the components' history is the forest of the task's conversations, with one node per branching or end and a chain of
single children above it. Prefixes of a task's first and last string may go on in other tasks. The forest is contracted to these two paths, each node of
which carries the sums of what hangs from it, and the contracted forests are merged across boundaries: equal prefixes become one node, each merged node's sums are
given to one path through it, and sums from the deep end of each path bring them to all nodes above.

Strings longer than ``SEGMENT`` turns are cut into segments that begin at a known prefix; a segment is sorted among those that begin alike and holds a
forest of its own, so that no row and no task holds a whole conversation of any length. What later segments add to the subtrees above them is
summed per conversation first (each node counts for its smallest member) and enters as a further amount at the string's end.
The digest of very many equal conversations is computed from pieces in order, in bounded memory.

Turns are compared by 124 bits of hashes of position, role and text. ``numbered`` gives turns their places without sorting a conversation in one task.

Defined cases: a null role or text is empty; rows without a conversation number belong to no conversation; null turns come first, equal turn numbers are ordered by the digest of role and text and repeated
rows are turns of their own; a conversation without turns is a member of the root only; an empty table has no nodes, not even a root; other columns are not
used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from .common import map_arrow, written

SEGMENT = 4096
LANE = (1 << 62) - 1
PIECE_IDS = 50_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
NODE = ["depth", "p1", "p2"]
FIELDS = ("kind int, depth long, p1 long, p2 long, up1 long, up2 long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
          "own_leaf long, own_saved long, size long, goes_on boolean, path long, piece long, ends string")
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
FINAL, SPINE, ENDS = 0, 1, 2


def digested(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, pos, digest, size``: every turn's place from 1, the digest of role and text, and the text's bytes."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    role, text = empty(role_col), empty(text_col)
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = df.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("_turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    return numbered(rows, ["conv_id"], [F.col("_turn").asc_nulls_first(), F.col("digest").asc()], "pos").select("conv_id", F.col("pos").cast("long").alias("pos"), "digest", "size")


def strings(turns: DataFrame, lengths: DataFrame, segment: int) -> DataFrame:
    """``conv_id, seg, s1, s2, ends, turns``: each segment of each conversation with the hash of the prefix before it, written once."""
    lane = lambda k: F.xxhash64(F.lit(k), "pos", "digest").bitwiseAND(F.lit(LANE))
    seg = F.call_function("div", F.col("pos") - 1, F.lit(segment).cast("long"))
    rows = turns.join(lengths, "conv_id").select("conv_id", "length", seg.alias("seg"), "pos", lane(1).alias("x1"), lane(2).alias("x2"), "size")
    cut = rows.groupBy("conv_id", "seg").agg(F.max("length").alias("length"), F.array_sort(F.collect_list(F.struct("pos", "x1", "x2", "size"))).alias("turns"))
    cut = cut.withColumn("turns", F.transform("turns", lambda t: F.struct(t["x1"].alias("x1"), t["x2"].alias("x2"), t["size"].alias("size"))))
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    sums = rows.where(F.col("length") > segment).groupBy("conv_id", "seg").agg(total("x1").alias("t1"), total("x2").alias("t2"))
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda c: F.pmod(F.sum(c).over(before), F.lit(LANE + 1).cast("decimal(38,0)")).cast("long")
    starts = sums.select("conv_id", "seg", start("t1").alias("s1"), start("t2").alias("s2"))
    ends = F.col("length") <= (F.col("seg") + 1) * segment
    known = cut.join(starts, ["conv_id", "seg"], "left").select("conv_id", "seg", F.coalesce("s1", F.lit(0)).alias("s1"), F.coalesce("s2", F.lit(0)).alias("s2"), ends.alias("ends"), "turns")
    zero = F.lit(0).cast("long")
    none = lengths.where("length = 0").select("conv_id", zero.alias("seg"), zero.alias("s1"), zero.alias("s2"), F.lit(True).alias("ends"), F.array().cast(known.schema["turns"].dataType).alias("turns"))
    return written(known.unionByName(none), "strings")


def common_prefixes(group: np.ndarray, begin: np.ndarray, size: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """The LCP of each string and the next one; -1 where they are of different groups."""
    n = len(size) - 1
    if n < 1:
        return np.zeros(0, np.int64)
    shared = np.where(group[:-1] == group[1:], np.minimum(size[:-1], size[1:]), 0)
    first = np.concatenate([[0], np.cumsum(shared)])
    at = np.arange(first[-1]) - np.repeat(first[:-1], shared)
    one, two = np.repeat(begin[:-1], shared) + at, np.repeat(begin[1:], shared) + at
    lcp = shared.copy()
    differ = np.flatnonzero((x1[one] != x1[two]) | (x2[one] != x2[two]))
    np.minimum.at(lcp, np.repeat(np.arange(n), shared)[differ], at[differ])
    return np.where(group[:-1] == group[1:], lcp, -1)


class Forest:
    """The compressed trie of sorted strings by union-find over their LCP edges in descending depth."""

    def __init__(self, size: np.ndarray, lcp: np.ndarray, group: np.ndarray):
        n = len(size)
        self.depth, self.parent = size.tolist(), [-1] * n
        self.same = list(range(n))  # nodes found to be one
        over, top = list(range(n)), list(range(n))  # union-find over strings, and each component's highest node

        def find(i: int) -> int:
            while over[i] != i:
                over[i] = over[over[i]]
                i = over[i]
            return i

        for i in np.argsort(-lcp, kind="stable").tolist():
            d = int(lcp[i])
            if d < 0:
                break
            a, b = find(i), find(i + 1)
            u, v = top[a], top[b]
            over[b] = a
            if self.depth[u] == d == self.depth[v]:
                self.same[v] = u
            elif self.depth[u] == d:
                self.parent[v] = u
            elif self.depth[v] == d:
                self.parent[u] = top[a] = v
            else:
                top[a] = self._branch(d, u, v)
        self.root = {}
        for i in range(n):
            if group[i] not in self.root:
                t = top[find(i)]
                self.root[group[i]] = t if self.depth[t] == 0 else self._branch(0, t)
        self.node = [self.resolve(i) for i in range(n)]
        self.up = [self.resolve(p) if p >= 0 else -1 for p in self.parent]
        self.real = [v for v in range(len(self.depth)) if self.same[v] == v]

    def _branch(self, depth: int, *children: int) -> int:
        w = len(self.depth)
        self.depth.append(depth)
        self.parent.append(-1)
        self.same.append(w)
        for c in children:
            self.parent[c] = w
        return w

    def resolve(self, v: int) -> int:
        while self.same[v] != v:
            self.same[v] = self.same[self.same[v]]
            v = self.same[v]
        return v


def grow(rows: pa.Table, segment: int, part: int, first_conv: int) -> Iterator[pa.RecordBatch]:
    """The finished nodes of a task's strings, its two boundary paths, and the ends on these."""
    number = lambda c: rows.column(c).combine_chunks().to_numpy(zero_copy_only=False)
    conv, seg, ends, more_leaves, more_saved = map(number, ("conv_id", "seg", "ends", "more_leaves", "more_saved"))
    starts = [number(c).astype(np.uint64) for c in ("s1", "s2")]
    lists = rows.column("turns").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else lists.chunk(0)
    offset = lists.offsets.to_numpy().astype(np.int64)
    turn = lists.values
    x1, x2, bytes_ = (turn.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    begin, size, n = offset[:-1], np.diff(offset), len(conv)
    change = (seg[1:] != seg[:-1]) | (starts[0][1:] != starts[0][:-1]) | (starts[1][1:] != starts[1][:-1])
    group = np.concatenate([[0], np.cumsum(change)])
    forest = Forest(size, common_prefixes(group, begin, size, x1, x2), group)
    summed = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x.astype(np.uint64), dtype=np.uint64)]) for x in (x1, x2)]
    spent = np.concatenate([[0], np.cumsum(bytes_)])

    def prefix(i: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        """The hash of string ``i``'s first ``d`` turns of its segment and all before it."""
        return [((s[i] + c[begin[i] + d] - c[begin[i]]) & np.uint64(LANE)).astype(np.int64) for s, c in zip(starts, summed, strict=True)]

    bytes_to = lambda i, d: spent[begin[i] + np.maximum(d, 0)] - spent[begin[i]]

    m = len(forest.depth)
    depth, up = np.array(forest.depth), np.array(forest.up)
    members, least, some = np.zeros(m, np.int64), np.full(m, np.iinfo(np.int64).max), np.zeros(m, np.int64)
    kids, goes_on = np.zeros(m, np.int64), np.zeros(m, bool)
    leaves, saved = np.zeros(m, np.int64), np.zeros(m, np.int64)
    node = np.array(forest.node)
    np.add.at(members, node, 1)
    np.minimum.at(least, node, conv)
    some[node] = np.arange(n)
    np.logical_or.at(goes_on, node, ~ends)
    np.add.at(leaves, node, more_leaves)
    np.add.at(saved, node, more_saved)
    real = np.array(forest.real)
    np.add.at(kids, up[real][up[real] >= 0], 1)

    spine = [[], []]
    for side, i in ((0, 0), (1, n - 1)):
        v = forest.node[i]
        while v >= 0:
            spine[side].append(v)
            v = int(up[v])
    on_spine = np.zeros(m, bool)
    on_spine[spine[0] + spine[1]] = True

    # sums of subtrees, deepest nodes first; what finished children add to a boundary node is kept apart from the node's own
    below_leaves, below_saved, done_kids = leaves.copy(), saved.copy(), np.zeros(m, np.int64)
    own_leaf = np.zeros(m, np.int64)
    for v in real[np.argsort(-depth[real], kind="stable")].tolist():
        p, i, q = int(up[v]), some[v], int(depth[v])
        if not on_spine[v]:
            own_leaf[v] = kids[v] == 0 and not goes_on[v]
            leaves[v] = below_leaves[v] + own_leaf[v]
            saved[v] = below_saved[v] + (members[v] - 1) * (bytes_to(i, q) - bytes_to(i, q - 1))
        if p >= 0:
            members[p] += members[v]
            least[p] = min(least[p], least[v])
            some[p] = i
            if not on_spine[v]:
                done_kids[p] += 1
                below_leaves[p] += leaves[v]
                below_saved[p] += saved[v] + (members[v] - 1) * (bytes_to(i, q - 1) - bytes_to(i, int(depth[p])))

    order = np.argsort(node, kind="stable")
    cut = np.flatnonzero(np.diff(node[order])) + 1
    ending = {int(node[run[0]]): conv[run[ends[run]]] for run in np.split(order, cut)}
    joined = lambda ids: ",".join(map(str, ids.tolist()))

    # finished nodes, with the chain of single children above each
    final = real[~on_spine[real] & (up[real] >= 0)]
    if len(final):
        low = depth[up[final]]
        count = depth[final] - low
        v, first = np.repeat(final, count), np.repeat(np.cumsum(count) - count, count)
        d = np.arange(len(v)) - first + np.repeat(low, count) + 1
        i, bottom, top = some[v], d == depth[v], d == np.repeat(low, count) + 1
        one = members[v] - 1
        here = bytes_to(i, d) - bytes_to(i, d - 1)
        total = saved[v] + np.where(bottom, 0, one * (bytes_to(i, depth[v] - 1) - bytes_to(i, d - 1)))
        deep = seg[i] * segment + d
        parent = np.where(top, least[up[v]], least[v])
        away = top & (on_spine[up[v]] | (seg[i] > 0) & (d == 1))  # the parent's smallest member is not known here
        root = away & (deep == 1)
        parent = np.where(root, first_conv, parent)
        away &= ~root
        p1, p2 = prefix(i, d)
        u1, u2 = prefix(i, d - 1)
        digest = np.full(len(v), EMPTY_SHA, object)
        for k in np.flatnonzero(bottom).tolist():
            ids = ending.get(int(v[k]))
            if ids is not None and len(ids):
                digest[k] = hashlib.sha256(joined(ids).encode()).hexdigest()
        keep = deep % segment == 0
        yield batch(len(v), kind=FINAL, depth=deep, p1=(p1, ~keep), p2=(p2, ~keep), up1=(u1, ~away), up2=(u2, ~away), conv_id=least[v], parent_conv_id=(parent, away), n_convs=members[v], n_children=np.where(bottom, kids[v], 1),
                    n_leaves=leaves[v], saved_tokens=total, own_leaf=np.where(bottom, own_leaf[v], 0), own_saved=one * here, goes_on=bottom & goes_on[v], ends=digest)

    seen: set[int] = set()
    for side, i in ((0, 0), (1, n - 1)):
        for v in spine[side]:
            low = -1 if up[v] < 0 else int(depth[up[v]])
            low = max(low, 0) if seg[i] else low  # the beginning of a later segment is a node of the one before
            d = np.arange(low + 1, int(depth[v]) + 1)
            if not len(d):
                continue
            bottom, again, at = d == depth[v], v in seen, np.full(len(d), i)
            p1, p2 = prefix(at, d)
            u1, u2 = prefix(at, np.maximum(d - 1, 0))
            once = lambda x: np.zeros(len(d), np.int64) if again else np.where(bottom, x, 0)  # noqa: B023, E731
            yield batch(len(d), kind=SPINE, depth=seg[i] * segment + d, p1=p1, p2=p2, up1=u1, up2=u2, conv_id=np.full(len(d), least[v]), n_convs=np.full(len(d), 0 if again else members[v]),
                        n_children=once(done_kids[v]), n_leaves=once(below_leaves[v]), saved_tokens=once(below_saved[v]), size=bytes_to(at, d) - bytes_to(at, d - 1), goes_on=bottom & goes_on[v],
                        path=np.full(len(d), 2 * part + side))
            ids = ending.get(v)
            if not again and ids is not None and len(ids):
                for k in range(0, len(ids), PIECE_IDS):
                    yield batch(1, kind=ENDS, depth=np.array([seg[i] * segment + depth[v]]), p1=p1[-1:], p2=p2[-1:], path=np.array([2 * part]), piece=np.array([k]), ends=[joined(ids[k:k + PIECE_IDS])])
            seen.add(v)


def batch(n: int, kind: int, **columns) -> pa.RecordBatch:
    """A batch of output rows; a pair gives values and where they are null, and columns that are not named are null."""
    types = {"kind": pa.int32(), "goes_on": pa.bool_(), "ends": pa.string()}
    out = []
    for name in NAMES:
        kind_of = types.get(name, pa.int64())
        value = np.full(n, kind, np.int32) if name == "kind" else columns.get(name)
        out.append(pa.nulls(n, kind_of) if value is None else pa.array(value[0], kind_of, mask=value[1]) if isinstance(value, tuple) else pa.array(value, kind_of))
    return pa.RecordBatch.from_arrays(out, names=NAMES)


def forests(parts: DataFrame, segment: int, first_conv: int) -> DataFrame:
    """What every range of sorted strings gives, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if rows:
            yield from grow(pa.Table.from_batches(rows), segment, TaskContext.get().partitionId(), first_conv)

    by = ["seg", "s1", "s2", "turns", "conv_id"]
    ranged = parts.repartitionByRange(*by).sortWithinPartitions(*by)
    return written(map_arrow(ranged, run, FIELDS), "forests")


def merged(grown: DataFrame, segment: int) -> DataFrame:
    """The boundary paths of all forests as one: equal prefixes are one node, sums of subtrees and of all tasks together."""
    spine = grown.where(F.col("kind") == SPINE)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    nodes = spine.groupBy(*NODE).agg(*sums, F.min("conv_id").alias("conv_id"), F.min("up1").alias("up1"), F.min("up2").alias("up2"), F.max("size").alias("size"), F.max("goes_on").alias("goes_on"), F.min("path").alias("owner"))
    within = (F.col("depth") == 1) | ((F.col("depth") - 1) % segment != 0)  # children behind the end of a segment are counted elsewhere
    kids = nodes.where((F.col("depth") > 0) & within).groupBy((F.col("depth") - 1).alias("depth"), F.col("up1").alias("p1"), F.col("up2").alias("p2")).agg(F.count("*").alias("_kids"))
    nodes = nodes.join(kids, NODE, "left").withColumn("n_children", F.col("n_children") + F.coalesce("_kids", F.lit(0))).drop("_kids")
    leaf = ((F.col("n_children") == 0) & ~F.col("goes_on")).cast("long")
    nodes = written(nodes.withColumns({"own_leaf": leaf, "own_saved": F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("size")).otherwise(0)}), "boundary")
    owned = spine.select("path", *NODE).join(nodes.select(*NODE, "owner", (F.col("n_leaves") + F.col("own_leaf")).alias("l"), (F.col("saved_tokens") + F.col("own_saved")).alias("s")), NODE)
    mine = lambda c: F.when(F.col("path") == F.col("owner"), F.col(c)).otherwise(0)
    deeper = Window.partitionBy("path").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    along = owned.select(*NODE, F.sum(mine("l")).over(deeper).alias("n_leaves"), F.sum(mine("s")).over(deeper).alias("saved_tokens"))
    totals = along.groupBy(*NODE).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    return nodes.drop("n_leaves", "saved_tokens", "owner").join(totals, NODE)


def end_digests(grown: DataFrame) -> DataFrame:
    """The digest of the conversations that end at each boundary node, from their pieces in the order of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        out = lambda: pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in node], pa.array([state.hexdigest()])], names=[*NODE, "ends_sha256"])
        for b in batches:
            for *key, text in zip(*[b.column(c).to_pylist() for c in (*NODE, "ends")], strict=True):
                if key != node:
                    if node is not None:
                        yield out()
                    node, state = key, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
        if node is not None:
            yield out()

    pieces = grown.where(F.col("kind") == ENDS).select(*NODE, "path", "piece", "ends")
    return map_arrow(pieces.repartition(*NODE).sortWithinPartitions(*NODE, "path", "piece").select(*NODE, "ends"), run, "depth long, p1 long, p2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per node from ``turns`` (``conv_id, pos, digest, size``, places 1 to length) and ``lengths`` (``conv_id, length`` of every conversation).

    ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    """
    parts = strings(turns, lengths, segment)
    first_conv = lengths.agg(F.min("conv_id")).first()[0]
    zero = F.lit(0).cast("long")
    bare = parts.withColumns({"more_leaves": zero, "more_saved": zero})
    # what later segments add to the subtrees above them: every node counts for its smallest member
    late = forests(bare.where("seg > 0"), segment, first_conv)
    seg = F.call_function("div", F.col("depth") - 1, F.lit(segment).cast("long")).alias("seg")
    own = late.where(F.col("kind") == FINAL).select("conv_id", seg, "own_leaf", "own_saved").unionByName(merged(late, segment).select("conv_id", seg, "own_leaf", "own_saved"))
    own = own.groupBy("conv_id", "seg").agg(F.sum("own_leaf").alias("l"), F.sum("own_saved").alias("s"))
    after = Window.partitionBy("conv_id").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, -1)
    amount = lambda c: F.coalesce(F.sum(c).over(after), F.lit(0))
    every = parts.where("seg > 0").select("conv_id", "seg").unionByName(parts.where("not ends and seg = 0").select("conv_id", "seg"))
    more = every.join(own, ["conv_id", "seg"], "left").select("conv_id", "seg", amount("l").alias("more_leaves"), amount("s").alias("more_saved"))
    filled = [F.coalesce(c, zero).alias(c) for c in ("more_leaves", "more_saved")]
    grown = forests(parts.join(more, ["conv_id", "seg"], "left").select(*parts.columns, *filled), segment, first_conv)

    boundary = merged(grown, segment)
    out = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = grown.where(F.col("kind") == FINAL).withColumnRenamed("ends", "ends_sha256")
    shape = [*NODE, "up1", "up2", *out[1:]]
    outer = boundary.join(end_digests(grown), NODE, "left").withColumns({"ends_sha256": F.coalesce("ends_sha256", F.lit(EMPTY_SHA)), "parent_conv_id": F.lit(None).cast("long")})
    nodes = inner.select(*shape).unionByName(outer.select(*shape))
    # children behind the end of a segment
    later = parts.where("seg > 0").groupBy((F.col("seg") * segment).alias("depth"), F.col("s1").alias("p1"), F.col("s2").alias("p2")).agg(F.countDistinct(F.col("turns")[0]["x1"], F.col("turns")[0]["x2"]).alias("_later"))
    nodes = nodes.join(later, NODE, "left").withColumn("n_children", F.col("n_children") + F.coalesce("_later", F.lit(0)))
    # smallest members of parents that other tasks share
    border = inner.where(F.col("p1").isNotNull()).select(*NODE, "conv_id").unionByName(boundary.select(*NODE, "conv_id"))
    parents = border.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("up1"), F.col("p2").alias("up2"), F.col("conv_id").alias("_parent"))
    found = nodes.join(parents, ["depth", "up1", "up2"], "left")
    return found.select("conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "_parent")).alias("parent_conv_id"), *out[3:])


def conversation_trie(df: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The trie of conversations as they are."""
    turns = written(digested(df), "turns")
    return prefix_trie(turns, turns.groupBy("conv_id").agg(F.max("pos").alias("length")), segment)


def shared_openings(turns: DataFrame, of: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths after every conversation's first ``crc32(id) % (most + 1)`` turns were replaced by those of the conversation whose id is the multiple of ``of`` below."""
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    own = own.withColumns({"base": F.col("conv_id") - F.pmod("conv_id", F.lit(of)), "head": head.cast("long")})
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = own.join(bases, "base", "left").withColumn("taken", F.least("head", F.coalesce("base_n", F.lit(0))))
    plan = written(plan.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))), "openings")
    heads = turns.where((F.col("pos") <= most) & (F.pmod("conv_id", F.lit(of)) == 0)).withColumnRenamed("conv_id", "base")
    taken = plan.select("conv_id", "base", "taken").join(heads, "base").where("pos <= taken").select("conv_id", "pos", "digest", "size")
    kept = turns.where(F.col("pos") > head).join(plan.select("conv_id", "taken", "head"), "conv_id").select("conv_id", (F.col("pos") - F.col("head") + F.col("taken")).alias("pos"), "digest", "size")
    return taken.unionByName(kept), plan.select("conv_id", "length")


def op12(spark, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations with shared openings."""
    turns = written(digested(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")), "turns")
    return prefix_trie(*shared_openings(turns))


# every conversation's prefixes as rows; a node's subtree is summed over the paths of the nodes' smallest members
OP12_SQL = """
WITH given AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, c - ((c % 5) + 5) % 5 AS base, count(*) AS n,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 9 AS h
  FROM given GROUP BY c),
plan AS (SELECT o.c, o.base, o.h, least(o.h, coalesce(b.n, 0)) AS taken FROM convs o LEFT JOIN convs b ON b.c = o.base),
turns AS (
  SELECT p.c, g.pos, g.role, g.text FROM plan p JOIN given g ON g.c = p.base AND g.pos <= p.taken
  UNION ALL
  SELECT p.c, g.pos - p.h + p.taken, g.role, g.text FROM plan p JOIN given g ON g.c = p.c AND g.pos > p.h),
paths AS (
  SELECT c, pos AS d, md5(list((role, text)) OVER upto::VARCHAR) AS k, CASE WHEN pos = 1 THEN '' ELSE md5(list((role, text)) OVER before::VARCHAR) END AS up, strlen(text) AS size
  FROM turns WINDOW upto AS (PARTITION BY c ORDER BY pos ROWS UNBOUNDED PRECEDING), before AS (PARTITION BY c ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  UNION ALL SELECT c, 0, '', NULL, 0 FROM convs),
lasts AS (SELECT c, max(d) AS last FROM paths GROUP BY c),
nodes AS (
  SELECT d, k, min(up) AS up, min(c) AS conv_id, count(*) AS n_convs, max(size) AS size, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = last), '') AS ends
  FROM paths JOIN lasts USING (c) GROUP BY d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
sums AS (
  SELECT p.d, p.k, sum(CASE WHEN q.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.size) AS saved_tokens
  FROM nodes v LEFT JOIN kids q USING (d, k) JOIN paths p ON p.c = v.conv_id AND p.d <= v.d GROUP BY p.d, p.k)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(q.n, 0) AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM nodes v JOIN sums s USING (d, k) LEFT JOIN kids q USING (d, k) LEFT JOIN nodes u ON u.d = v.d - 1 AND u.k = v.up
"""
