import random
import re

import numpy as np
import pytest
from catalogspark.llm import partenum as P
from catalogspark.llm.queries import QUERIES


def features(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)])


def brute(rows, words=4, percent=85):
    sets = [(d, features(t, words)) for d, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), P.LAST), P.LAST if d is None else d)
    return sorted(((d, len(s), None if least[find(i)] == P.LAST else least[find(i)]) for i, (d, s) in enumerate(sets)), key=repr)


def near_rows(sentences, seed=1, n=60):
    rnd = random.Random(seed)
    rows, ids = [], list(range(0, 4000, 7))
    rnd.shuffle(ids)
    for k in range(n):
        base = sentences(k, rnd.choice([1, 3, 4, 5, 9, 14, 25, 60, 150, 300])).split(" ")
        for _ in range(rnd.choice([1, 1, 2, 3, 6])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4, 8])):
                w[rnd.randrange(len(w))] = f"new{rnd.randrange(1000)}"
            rows.append((ids.pop(), rnd.choice([" ", "\n", "\t "]).join(w)))
    passage = sentences(900, 60)
    for k in range(40):
        rows.append((ids.pop(), f"{passage} {sentences(2000 + k, rnd.choice([4, 9, 30]))}"))
    rows += [(ids.pop(), None), (ids.pop(), ""), (ids.pop(), " \n"), (ids.pop(), "A b"), (ids.pop(), "a B"), (ids.pop(), "a b c"), (ids.pop(), "é\x0bû x y z"), (None, rows[3][1]), rows[5], (ids.pop(), rows[5][1])]
    return rows


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_groups_equal_brute_force(spark, table, sentences, words, percent):
    rows = near_rows(sentences, words)
    got = P.near_duplicates(table(rows), words=words, percent=percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, words, percent)


def test_query_and_large_lists_in_pieces(spark, table, sentences, fixture_dir, monkeypatch):
    monkeypatch.setattr(P, "PIECE_ROWS", 3)
    rows = near_rows(sentences, 9, 40)
    got = QUERIES["op6_partenum_join"](spark, fixture_dir(table(rows))).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_similar_sets_share_a_signature():
    rnd = np.random.default_rng(4)
    bands = P.Bands(85, 2000)
    for size in (2, 7, 8, 13, 14, 40, 41, 200, 700):
        for _ in range(30):
            base = rnd.integers(0, 1 << 62, size).astype(np.uint64)
            other = base.copy()
            worst = P.allowed(85, 2 * size) // 2
            other[:worst] = rnd.integers(0, 1 << 62, worst).astype(np.uint64)
            cut = int(rnd.integers(0, size - -(-85 * size // 100) + 1)) if not worst else 0
            both = [np.unique(base), np.unique(other[:size - cut])]
            common = len(np.intersect1d(*both))
            if 100 * common < 85 * (len(both[0]) + len(both[1]) - common) or np.array_equal(*both):
                continue
            s = P.Sets(np.concatenate(both), np.array([len(b) for b in both]))
            sign, text = P.signatures(s, bands)
            assert np.intersect1d(sign[text == 0], sign[text == 1]).size


def test_sketches_bound_differences():
    rnd = np.random.default_rng(5)
    a = rnd.integers(0, 1 << 62, 300).astype(np.uint64)
    b = np.concatenate([a[30:], rnd.integers(0, 1 << 62, 12).astype(np.uint64)])
    x = P.sketches(P.Sets(np.concatenate([np.sort(a), np.sort(b)]), np.array([len(a), len(b)])))
    assert np.unpackbits(x[0] ^ x[1]).sum() <= 42


def test_empty_table(spark, table):
    assert P.near_duplicates(table([(1, "x")]).where("false")).collect() == []


def test_long_texts(spark, table, sentences):
    """Texts of thousands of words: near copies link, strangers and texts that share a passage do not; sizes apart enough that sketch widths differ."""
    rnd = random.Random(8)
    rows = []
    for k in range(6):
        base = sentences(5000 + k, 4700 if k % 2 else 5200).split(" ")
        rows.append((10 * k, " ".join(base)))
        for j, share in enumerate((0.005, 0.02, 0.06), 1):
            w = list(base)
            for _ in range(int(len(w) * share)):
                w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
            rows.append((10 * k + j, " ".join(w[: len(w) - 90 * j * (k % 3)])))
    passage = sentences(7777, 300)
    rows += [(100 + k, f"{passage} {sentences(8000 + k, 2500)}") for k in range(8)]
    got = P.near_duplicates(table(rows), words=5, percent=80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, 5, 80)


def test_sketches_of_different_widths_fold(spark):
    rnd = np.random.default_rng(3)
    for n in (900, 1800, 5000, 9000):
        own = rnd.integers(0, 1 << 63, n, dtype=np.uint64)
        for extra in (0, n // 50, n // 8):
            both = [np.sort(own), np.sort(np.concatenate([own, rnd.integers(0, 1 << 63, extra, dtype=np.uint64)])), np.sort(rnd.integers(0, 1 << 63, n, dtype=np.uint64))]
            s = P.Sets(np.concatenate(both), np.array([len(x) for x in both]))
            facts = spark.createDataFrame([(i, len(b), bytearray(k.tobytes())) for i, (b, k) in enumerate(zip(both, P.sketches(s, 80), strict=True))], "i int, size long, sketch binary")
            words = facts.select("i", "size", P._words("sketch").alias("w"))
            a = words.where("i = 0").selectExpr("size size_a", "w a")
            pairs = a.join(words.where("i > 0").selectExpr("i", "size size_b", "w b"))
            got = {r.i: r.near for r in pairs.select("i", P.sketch_near("a", "b", "size_a", "size_b", 80).alias("near")).collect()}
            assert got == {1: True, 2: False}


def test_long_sets_are_signed_once():
    """The spares of a band keep sets of any size from being signed again and again."""
    rnd = np.random.default_rng(4)
    bands = P.Bands(80, 40_000)
    for n in (1000, 3000, 20_000):
        sizes = np.full(20, n)
        s = P.Sets(rnd.integers(0, 1 << 63, int(sizes.sum()), dtype=np.uint64), sizes)
        signed, _ = P.signatures(s, bands)
        band = int(bands.of(np.array([n]))[0])
        once = 3 * 20 * int(bands.groups[band] + bands.groups[band - 1])
        assert len(signed) < 1.25 * once
        assert (bands.groups <= 1.2 * (bands.differ // 2 + 2) + 1).all()


def test_a_hot_pivot_is_dealt_to_chunks(spark, table, sentences, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 7)
    base = sentences(42, 80)
    rows = [(k, f"{base} tail{k}") for k in range(60)]
    got = P.near_duplicates(table(rows)).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 60


def test_a_group_yields_fewer_links_than_members():
    rng = np.random.default_rng(2)
    core = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.append(core, rng.integers(0, 2**63, 8).astype(np.uint64))) for _ in range(60)]
    sets += [np.unique(rng.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(5)]
    found = P.joined(sets, list(range(len(sets))), 85)
    assert len(found) == 59 and {k for pair in found for k in pair} == set(range(60))
    assert P.joined(sets, [0] * 60 + list(range(1, 6)), 85) == []


def test_texts_of_lists_are_taken_out_of_all_texts_once(spark, table, sentences, monkeypatch):
    rows = [(k, sentences(k, 80)) for k in range(60)] + [(100 + k, sentences(k, 80) + " more") for k in range(10)]
    held, plain = [], P.written

    def noted(df, name, used=None):
        out = plain(df, name, used)
        if "raw" in df.columns:
            held.append((name, out.count()))
        return out

    monkeypatch.setattr(P, "written", noted)
    got = {r.doc_id: r.component_id for r in P.near_duplicates(table(rows)).collect()}
    assert all(got[100 + k] == k for k in range(10)) and all(got[k] == k for k in range(60))
    assert len(held) == 1 and 20 <= held[0][1] < len(rows)


def test_texts_and_sketches_are_shuffled_at_every_size(spark, table, sentences, monkeypatch):
    """What a small table sends to all tasks a large one shuffles: joins of texts and sketches keep one form, and rows of lists carry no sketches."""
    plans, columns, plain = {}, {}, P.written

    def noted(df, name, used=None):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())  # a name that is used twice: the first table
        columns[name] = df.columns
        return plain(df, name, used)

    monkeypatch.setattr(P, "written", noted)
    rows = near_rows(sentences, 3, 20)
    got = P.near_duplicates(table(rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)
    for name in ("list-texts", "pivot-pairs", "first-pivot-judged"):
        assert "SortMergeJoin" in plans[name], name
    assert "BroadcastHashJoin" not in plans["list-texts"] + plans["pivot-pairs"]
    assert "sketch" not in columns["list-members"] + columns["lists-again"]
