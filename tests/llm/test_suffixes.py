import hashlib
import random

import numpy as np
import pyarrow as pa
from catalogspark.llm import suffixes as S
from catalogspark.llm.queries import QUERIES


def brute(rows, span=50):
    texts = [(d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, b in texts:
        for i in range(len(b) - span + 1):
            w = b[i:i + span]
            key = S.LAST if d is None else d
            least[w] = min(least.get(w, key), key)
    out = []
    for d, b in texts:
        gone = [False] * len(b)
        for i in range(len(b) - span + 1):
            if least[b[i:i + span]] < (S.LAST if d is None else d):
                gone[i:i + span] = [True] * span
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows_with_repeats(sentences):
    rnd = random.Random(5)
    line = "the same licence line stands in very many of these texts, word for word."
    rows = []
    for k in range(120):
        t = sentences(k, rnd.randint(1, 60))
        if k % 2:
            t = f"{t}\n{line}\n{sentences(k + 500, 10)}"
        if k % 5 == 0:
            t = t + " " + sentences(7, 40)[rnd.randint(0, 40):]
        rows.append((k * 3, t))
    rows += [(1000, rows[4][1]), (1001, rows[4][1]), (2, rows[9][1]), (500, None), (501, ""), (502, "é" * 200), (503, "x" + "é" * 180), (None, rows[3][1]), (12, rows[4][1])]
    rows += [(7, "abc " * 100), (8, "bc a" * 100), (9, "abc " * 12), (15, "z" * 49), (16, "z" * 50), (17, "z" * 51)]
    return rows


def test_removed_bytes_equal_brute_force(spark, table, sentences, fixture_dir):
    rows = rows_with_repeats(sentences)
    got = QUERIES["op4_bucket_pointer_suffixes"](spark, fixture_dir(table(rows))).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_common_names_are_cut_into_single_stretches(spark, table, sentences):
    rows = rows_with_repeats(sentences)
    got = S.remove_repeats(table(rows), hot=3, block_bytes=2000).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got), key=repr) == brute(rows)


def test_other_columns_stay_and_clashing_ones_are_replaced(spark, table):
    docs = table([(1, "a" * 60), (2, "a" * 60)]).withColumnRenamed("n_chars", "n_bytes")
    got = {r.doc_id: r for r in S.remove_repeats(docs).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 60 and got[2].kept == b"" and got[2].lang == "en" and got[2].n_bytes == 60


def test_empty_table(spark, table):
    assert S.remove_repeats(table([(1, "x")]).where("false")).collect() == []


def test_refinement_sorts_suffixes():
    rnd = random.Random(3)
    for letters in ("ab", "abcdef", "a"):
        raw = "".join(rnd.choice(letters) for _ in range(700)).encode()
        data = np.frombuffer(raw + bytes(S.PAD), np.uint8)
        order = S.bucket_pointer_refinement(data, 50)
        padded = raw + bytes(S.PAD)
        keys = [padded[p:p + 50] for p in order.tolist()]
        assert sorted(order.tolist()) == list(range(700)) and keys == sorted(keys)


def test_repeated_strings_that_no_stretch_begins_with():
    """Two runs end in the same 49 bytes: buckets of several hold only places where no whole stretch begins."""
    rnd = random.Random(6)
    a, b, end = (bytes(rnd.choices(range(97, 123), k=n)) for n in (20, 20, 49))
    assert a[-1:] != b[-1:]
    for texts, ids, covered in (([a, b], [1, 2], [0, 0]), ([a, a, b], [1, 2, 3], [0, 1, 0])):
        data, starts = S.joined([t + end for t in texts])
        places = S.stretch_places(starts, 50)
        assert S.covered_stretches(data, places, np.repeat(ids, 20)).tolist() == np.repeat(covered, 20).astype(bool).tolist()


def test_runs_do_not_depend_on_parts(sentences, monkeypatch):
    texts = [sentences(k, 40).encode() for k in range(30)] + [b"", b"x" * 49, b"x" * 50, b"ab" * 300, sentences(3, 40).encode()]
    data, starts = S.joined(texts)
    whole = S.runs_of(data, starts)
    assert whole[1].sum() == sum(max(0, len(t) - 49) for t in texts)
    for part in (1, 7, 50, 333):
        monkeypatch.setattr(S, "PART", part)
        assert all((a == b).all() for a, b in zip(whole, S.runs_of(data, starts), strict=True))


def test_names_travel_in_few_bytes():
    rnd = random.Random(2)
    raw = [bytes(rnd.choices(range(97, 123), k=3000)) for _ in range(100)]
    texts = pa.table({"_tid": pa.array(range(100), pa.int64()), "_ord": pa.array(range(100), pa.int64()), "_bytes": pa.array(raw, pa.binary())})
    rows = S._first_pass(4, 50)([pa.scalar(0, pa.int32())], texts, S._notes([]))
    names = S.runs_of(*S.joined(raw))[2]
    assert sum(map(len, rows["values"].to_pylist())) < 6 * len(np.unique(names))
    found = [S._from_steps(v, b, 4) for v, b in zip(rows["values"].to_pylist(), rows["bucket"].to_pylist(), strict=True)]
    assert sorted(np.concatenate(found).tolist()) == sorted(set(names.tolist()))


def test_ranges_of_a_row_are_joined():
    tids = np.array([5, 3, 5, 5, 3, 9])
    ranges = np.array([[60, 120], [0, 50], [0, 60], [10, 40], [70, 121], [4, 54]])
    assert S._merged(tids, ranges) == {5: [(0, 120)], 3: [(0, 50), (70, 121)], 9: [(4, 54)]}
    assert S._merged(tids[:0], ranges[:0]) == {}
