import hashlib
import random
from collections import Counter

from catalogspark.llm import fingerprints as M
from catalogspark.llm.queries import QUERIES
from pyspark.sql import functions as F


def edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for k, (d, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        out[d] = (len(t), hashlib.sha256((t[:len(t) - half] + after[:half]).encode()).hexdigest(), t == after)
    return out


def test_query_edits_by_the_next_document(spark, table, fixture_dir, sentences):
    rows = [(k * 17 % 101, "\n".join(sentences(k * 9 + j, 20) for j in range(k % 12))) for k in range(80)]
    rows += [(200, None), (201, "é🙂" * 700), (202, "x" * 5000), (203, "x" * 5000), (None, "nil"), (-5, "first")]
    got = QUERIES["op1_merkle_fingerprints"](spark, fixture_dir(table(rows))).collect()
    want = edited(rows)
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        n, sha, same = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (r.near_next == 1) == same
        text = dict(rows)[r.doc_id] or ""
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
    assert len(set(by_text.values())) == len(by_text)
    long = [r for r in got if r.n_chars > 600 and r.doc_id < 101 and r.doc_id != 7]
    assert all(r.near_edited > r.near_next for r in long)


def test_repeated_rows_and_empty_table(spark, table):
    docs = table([(1, "a\nb"), (1, "a\nb"), (2, "c")])
    got = sorted((r.doc_id, r.next_doc_id, r.edited_sha256) for r in M.edited_neighbours(docs).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == [(1, 2, sha("a\nc")), (1, 2, sha("a\nc")), (2, 1, sha("c"))]
    assert M.edited_neighbours(docs.where("false")).collect() == []
    assert M.edited_neighbours(table([(4, "solo")])).first().near_next == 1.0


def test_tree_matches_its_definition_and_locates_edits(spark, sentences):
    lines = [sentences(k, 12) + "\n" for k in range(60)]
    text = "".join(lines)
    other = "".join([*lines[:30], "changed line\n", *lines[31:]])
    df = spark.createDataFrame([(text, other)], "a string, b string").select(M.fingerprint(F.col("a")).alias("a"), M.fingerprint(F.col("b")).alias("b"))
    r = df.select("a", "b", M.likeness(F.col("a"), F.col("b")).alias("near"), M.differing_leaves(F.col("a"), F.col("b")).alias("where")).first()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    body = "".join(f"{digest(x)}.{len(x)}" + (";" if digest(x)[-1] in "08" else ",") for x in lines).rstrip(",;")
    sections = [digest(s) for s in body.split(";")]
    shown = ";".join(",".join(f"{leaf[:16]}{leaf[64:]}" for leaf in s.split(",")) for s in body.split(";"))
    assert r.a == f"{digest(','.join(sections))}|{','.join(s[:16] for s in sections)}|{shown}"
    assert 0.9 < r.near < 1 and r.a.split("|")[0] != r.b.split("|")[0]
    at = len("".join(lines[:30]))
    assert [(w.start, w.end) for w in r["where"]] == [(at, at + len(lines[30]))]


def pieces(text):
    return [line[k:k + M.PIECE] + ("\n" if k + M.PIECE >= len(line) and ends else "") for line, ends in lines_of(text) for k in range(0, max(1, len(line)), M.PIECE)]


def lines_of(text):
    parts = text.split("\n")
    return [(x, True) for x in parts[:-1]] + ([(parts[-1], False)] if parts[-1] else [])


def compare(spark, pairs):
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k long, a string, b string").select("k", M.fingerprint(F.col("a")).alias("a"), M.fingerprint(F.col("b")).alias("b"))
    out = df.select("k", M.likeness(F.col("a"), F.col("b")).alias("near"), M.differing_leaves(F.col("a"), F.col("b")).alias("places")).collect()
    return [(r.near, [tuple(p) for p in r.places]) for r in sorted(out)]


def test_likeness_and_places_equal_brute_force(spark, sentences):
    rnd = random.Random(5)
    pool = [sentences(k, 6) + "\n" for k in range(12)] + ["\n", "same\n", "é" * 600 + "\n"]
    pairs = [("".join(rnd.choices(pool, k=k % 40)), "".join(rnd.choices(pool, k=k % 23))) for k in range(60)]
    pairs += [("a\nb\n", "b\na\n"), ("a\na\na\n", "a\n"), ("", "x"), ("x", ""), ("", ""), ("x" * 240, "x" * 480)]
    for (a, b), (near, places) in zip(pairs, compare(spark, pairs), strict=True):
        mine, theirs = Counter(pieces(a)), Counter(pieces(b))
        common = sum(len(x) * n for x, n in (mine & theirs).items())
        both = len(a) + len(b)
        assert near == (1.0 if a == b else min(2 * common, both - 1) / both)
        at, want = 0, []
        for x in pieces(a):
            if x not in theirs:
                want.append((at, at + len(x)))
            at += len(x)
        assert places == ([] if a == b else want)


def test_very_long_texts(spark):
    lines = [f"line {k}\n" for k in range(60_000)]
    other = [*lines[:20_000], "new\n", *lines[20_001:]]
    same = ["same\n"] * 60_000
    (near, places), (repeated, none) = compare(spark, [("".join(other), "".join(lines)), ("".join(same), "".join(same[:30_000]))])
    at = len("".join(lines[:20_000]))
    assert 0.99 < near < 1 and places == [(at, at + 4)]
    assert repeated == 2 / 3 and none == []


def test_query_lists_the_places_of_edits(spark, table, fixture_dir):
    rows = [(1, "".join(f"one {k}\n" for k in range(50))), (2, "".join(f"two {k}\n" for k in range(50)))]
    got = {r.doc_id: r for r in QUERIES["op1_merkle_fingerprints"](spark, fixture_dir(table(rows))).collect()}
    half = len(rows[0][1]) // 2
    first, last = got[1].edits.split(",")[0].split(":")[0], got[1].edits.split(",")[-1].split(":")[1]
    assert len(rows[0][1]) - half - 8 <= int(first) <= len(rows[0][1]) - half and int(last) == len(rows[0][1])
