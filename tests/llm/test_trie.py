import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from catalogspark.llm import trie
from catalogspark.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, extra string"


def plain_trie(convs):
    """Nodes of ``{conv: [(role, text), ...]}`` by a dictionary of all prefixes."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = own + sum(saved[k] for k in kids[p])
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(p)) for p, m in members.items()), key=str)


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(x)] for c, x in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def random_rows(seed, n, deep=6):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rnd.randrange(deep)):
            rows.append((c * rnd.choice([1, 1, 3]), rnd.choice([t, t, None]), rnd.choice(["user", "assistant", None]), rnd.choice(["a", "b", "é", "", None, "longer text"])))
    return rows


def test_query_equals_plain(spark, tmp_path):
    rows = [*random_rows(1, 120, 14), (None, 1, "user", "lost"), (7, 2, "user", "same"), (7, 2, "user", "same"), (-3, 0, "user", "minus"), (-5, 0, "user", "base"), (1 << 40, 1, None, None)]
    rows += [(500 + k, t, "user", f"opening {t}") for k in range(40) for t in range(3)] + [(600, t, "user", f"long {t}") for t in range(3000)] + [(605, t, "user", f"long {t}") for t in range(2500)]
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op12_prefix_trie"](spark, str(tmp_path))
    assert got.columns[:8] == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert as_rows(got) == plain_trie(rebuilt(ordered(rows)))


@pytest.mark.parametrize("segment", [1, 2, 3, 4096])
def test_segments_and_boundaries(spark, segment, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_IDS", 2)
    rows = random_rows(segment, 90, 9) + [(1000 + k, t, "u", "same") for k in range(25) for t in range(7)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many ranges, and so boundaries, as may be
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert as_rows(trie.conversation_trie(frame(spark, rows), segment)) == plain_trie(ordered(rows))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_conversations_without_turns(spark):
    # 1 takes nothing from an absent base and has no turns of its own beyond its opening
    c = next(k for k in range(1, 99) if k % 5 and zlib.crc32(str(k).encode()) % 9 >= 2)
    turns = trie.digested(frame(spark, [(c, 1, "user", "gone"), (200, 1, "user", "é")]))
    assert as_rows(trie.prefix_trie(*trie.shared_openings(turns))) == plain_trie(rebuilt(ordered([(c, 1, "user", "gone"), (200, 1, "user", "é")])))


def test_empty_table(spark):
    assert trie.conversation_trie(frame(spark, [(1, 1, "u", "t")]).where("false")).collect() == []
    assert trie.conversation_trie(frame(spark, [(None, 1, "u", "t")])).collect() == []


def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain_trie(rebuilt(ordered(rows)))
    assert as_rows(QUERIES["op12_prefix_trie"](spark, "/root/testdata/sf0.01")) == want
    db = duckdb.connect()
    db.sql("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    assert sorted(db.sql(ORACLES["op12_prefix_trie"]).fetchall(), key=str) == want
