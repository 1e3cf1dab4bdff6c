import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from catalogspark.llm import alignment
from catalogspark.llm.queries import QUERIES
from pyspark.sql import functions as F
from tokenizers import Tokenizer

TEXTS = [None, "", "a", " leading and  double  spaces ", "plain words, then more plain words.\n\n\ttab", "élève 日本語 🙂 ﬁ² é", "a ▁ b", "<|endoftext|> <s> </s> <unk> <0x41>", "don't we'll I'm 'S", "x" * 300, " ", "\n", "1234567890 12 3.14", " nbsp​", "nul\x00 byte", "plain words, then more plain words.\n\n\ttab"]


@pytest.fixture(scope="module")
def pair():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def plain(pair, text):
    """``(a ids, b ids, groups text, links)`` by walking both token lists, or None."""
    a, b = pair
    letters = {}
    extra = 256
    for x in range(256):
        if x in (*range(33, 127), *range(161, 173), *range(174, 256)):
            letters[chr(x)] = x
        else:
            letters[chr(extra)] = x
            extra += 1
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    pieces = [b.id_to_piece(i) for i in ids_b]
    bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return None
    spans = []
    for tokens in (bytes_a, bytes_b):
        at, out = 0, []
        for t in tokens:
            out.append((at, at + len(t)))
            at += len(t)
        spans.append(out)
    links = [(ids_a[i], ids_b[j]) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
    cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups, low = [], 0
    for cut in cuts:
        inside = [",".join(str(i) for i, (s, e) in zip(ids, sp, strict=True) if s >= low and e <= cut) for ids, sp in zip((ids_a, ids_b), spans, strict=True)]
        groups.append("|".join(inside))
        low = cut
    return ids_a, ids_b, ";".join(groups), links


def brute(pair, rows):
    found = [(i, plain(pair, t)) for i, t in rows]
    counts = Counter(p for _, x in found if x for p in set(x[3]))
    top = {}
    for (a, _), n in counts.items():
        top[a] = max(top.get(a, 0), n)
    return sorted(((i, len(x[0]), len(x[1]), x[2].count(";") + 1, len(x[3]), sum(counts[p] == top[p[0]] for p in x[3]), sum(counts[p] for p in x[3]), hashlib.sha256(x[2].encode()).hexdigest()) if x else (i, 0, 0, 0, 0, 0, 0, "") for i, x in found), key=str)


def test_query_equals_brute_force(spark, table, fixture_dir, pair, sentences):
    rows = [*enumerate(TEXTS), (None, TEXTS[4]), (3, TEXTS[3]), *[(100 + k, sentences(k % 5, 40, 60)) for k in range(12)]]
    got = QUERIES["op11_exact_text_alignment"](spark, fixture_dir(table(rows)))
    assert got.columns == ["doc_id", *alignment.MEASURES]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(pair, rows)


def test_rare_pairs_go_by_shuffle(spark, table, pair, sentences, monkeypatch):
    monkeypatch.setattr(alignment, "HOT_PAIRS", 8)  # nearly every pair is rare
    monkeypatch.setattr(alignment, "FLUSH_PAIRS", 50)
    rows = [(k, sentences(k % 7, 30, 50)) for k in range(20)]
    assert sorted((tuple(r) for r in alignment.align(table(rows)).select("doc_id", *alignment.MEASURES).collect()), key=str) == brute(pair, rows)


def test_parts_equal_the_whole(pair, monkeypatch):
    t = alignment.tokenizers(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    rnd = random.Random(5)
    monkeypatch.setattr(alignment, "PART_CHARS", 7)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "b", "é", " ", "  ", "\n", "'s", "1", ".", "日", "the", " of", "́", "²"]) for _ in range(60))
        want = plain(pair, text)
        got = t.encode(text)
        assert (got is None) == (want is None)
        if want:
            assert got[0].tolist() == want[0] and got[1].tolist() == want[1]


def test_byte_tokens_equal_the_library_for_every_letter_range(pair):
    t = alignment.tokenizers(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    for c in [*range(0x3000), *range(0x3000, 0x110000, 37)]:
        if not 0xD800 <= c < 0xE000:
            text = f" a{chr(c)}a 1{chr(c)}1 !{chr(c)}! {chr(c)} x{chr(c)}{chr(c)}  y"
            assert t.a.encode_ordinary(text) == pair[0].encode(text, add_special_tokens=False).ids, hex(c)


def test_a_very_long_text(spark, table):
    text = "some words of a very long text " * 60_000
    got = alignment.align(table([(1, text), (2, text), (3, "some")])).select("doc_id", "n_a", "n_groups", "n_links", "n_best").collect()
    long = next(r for r in got if r.doc_id == 1)
    assert long.n_a >= 60_000 * 7 and long.n_links >= long.n_a and long.n_best == long.n_links


def test_empty_table_clashing_columns_and_text_ids(spark, table):
    docs = table([(1, "one two"), (2, "one")]).withColumnRenamed("lang", "N_A").withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert alignment.align(docs.where("false")).collect() == []
    got = alignment.align(docs)
    assert sorted(got.columns) == sorted(["doc_id", "text", "source", "n_chars", *alignment.MEASURES])
    assert {r.doc_id: r.n_a for r in got.collect()} == {"d1": 2, "d2": 1}
