import zlib
from collections import Counter, defaultdict

from catalogspark.llm import sharding
from catalogspark.llm.queries import QUERIES


def check(rows, got):
    n = len(rows)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    per = Counter(r["shard"] for r in got)
    assert all(per.get(s, 0) in (n // 8, -(-n // 8)) for s in range(8)) and set(per) <= set(range(8))
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def split_groups(rows, got):
    text, where, size = dict(rows), defaultdict(set), Counter()
    for r in got:
        t = text[r.doc_id] or ""
        where[t].add(r["shard"])
        size[t] += 1
    return {t: len(s) for t, s in where.items() if len(s) > -(-size[t] // (len(rows) // 8))}


def test_equal_texts_meet_and_counts_are_even(spark, table, fixture_dir, sentences):
    rows = [(i, sentences(i % 250, 8)) for i in range(333)] + [(1000 + i, sentences(5000 + i % 9, 8)) for i in range(120)] + [(2000, None), (2001, ""), (2002, "é")]
    got = QUERIES["op10_label_shards"](spark, fixture_dir(table(rows))).collect()
    check(rows, got)
    assert len(split_groups(rows, got)) <= 6  # of 92


def test_a_group_of_more_than_a_third(spark, table):
    rows = [(i, "one text") for i in range(90)] + [(100 + i, f"text {i}") for i in range(130)]
    got = sharding.shard_documents(table(rows)).collect()
    check(rows, got)
    assert len({r["shard"] for r in got if r.doc_id < 90}) <= 5


def test_tables_of_linked_documents_only(spark, table):
    rows = [(i, f"text {i // 2}") for i in range(160)]
    got = sharding.shard_documents(table(rows)).collect()
    check(rows, got)
    assert len(split_groups(rows, got)) <= 24  # of 80; no room to move in


def test_repeated_rows_small_and_empty_tables(spark, table):
    rows = [(1, "a"), (1, "a"), (2, "b")]
    check(rows, sharding.shard_documents(table(rows)).collect())
    assert sharding.shard_documents(table(rows).where("false")).collect() == []
    check([(i, "same") for i in range(40)], sharding.shard_documents(table([(i, "same") for i in range(40)])).collect())


def test_rounds_go_on_while_requests_are_met(spark):
    """Balanced swaps leave the counts per label equal; they do not end the rounds, and no round is left in which a request could be met."""
    start = [(i, f"k{i % 24}", (i * 7 + i // 24) % 4) for i in range(24 * 6)]
    caps = [60] * 4
    linked = spark.createDataFrame(start, "_row long, _key string, _label int")
    placed, used = sharding.propagate(linked, caps)
    rows = placed.collect()
    assert len(rows) == len(start) and [sum(r["_label"] == t for r in rows) for t in range(4)] == used
    parts = lambda rs: sum(n * n for n in Counter((k, label) for _, k, label in rs).values())
    assert parts([(r["_row"], r["_key"], r["_label"]) for r in rows]) > 2 * parts(start)
    again, _ = sharding.propagate(placed, caps)
    groups = lambda df: len({(r["_key"], r["_label"]) for r in df.collect()})
    assert groups(again) <= groups(placed) <= 28
