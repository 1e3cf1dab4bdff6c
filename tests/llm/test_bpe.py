import hashlib
import random

import pytest
from catalogspark.llm import bpe
from catalogspark.llm.queries import QUERIES
from tokenizers import Tokenizer

HARD = [None, "", " ", "\n\t", "a", "aaaaaaaaaaaaaaaa", "it's we're I'll 'tis ''s 'south !'s x's' 'LL 'Ve", "1234 ½ ² 12ab", "ΑΣ Σ ς İstanbul ǅ", "é ñ 한", "日本語のテキスト", "🙂👍🏽 e-mail@x.y",
        "<|endoftext|>", "a<|startoftext|>B <|endoftext|><|endoftext|>c <|other|> <|", "tab\x0bvt\x0cff\x1cfs\x85nel ls​zw﻿", "_under__score_", "don't " * 400, "ababab abab abababababab", " nbsp", "x" * 5000, "'", "'s", "a'", "''t'd"]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(bpe.vocabulary_path())


def expected(reference, text):
    ids = reference.encode(text or "", add_special_tokens=False).ids
    return ids, reference.decode(ids, skip_special_tokens=False)


def test_query_equals_the_library(spark, table, reference, fixture_dir, sentences):
    rows = [(i, t) for i, t in enumerate([*HARD, *[sentences(k, 50) for k in range(20)], HARD[6]])] + [(3, "\n\t")]
    got = sorted(tuple(r) for r in QUERIES["op2_pair_index_bpe"](spark, fixture_dir(table(rows))).collect())
    want = []
    for i, t in rows:
        ids, text = expected(reference, t)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)


def test_given_documents_equal_the_library(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for r in bpe.encode(docs).collect():
        assert r.ids == expected(reference, r.text)[0]


def test_random_code_points(reference):
    rnd = random.Random(1)
    planes = [(32, 127), (128, 0x250), (0x370, 0x600), (0x2000, 0x2100), (0x3040, 0x3100), (0x1F300, 0x1F700)]
    texts = ["".join(chr(rnd.randrange(*rnd.choice(planes))) for _ in range(rnd.randint(1, 60))) for _ in range(400)]
    vocab = bpe.vocabulary(bpe.vocabulary_path())
    for t, ids in zip(texts, bpe.encode_block(texts, vocab), strict=True):
        assert ids.tolist() == expected(reference, t)[0], repr(t)


def test_small_blocks_give_the_same_ids(monkeypatch, reference, sentences):
    monkeypatch.setattr(bpe, "PART_CHARS", 50)
    texts = [sentences(k, 20) for k in range(10)] + [""]
    for t, ids in zip(texts, bpe.encode_block(texts, bpe.vocabulary(bpe.vocabulary_path()))):
        assert ids.tolist() == expected(reference, t)[0]


def test_decoding_defined_cases(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [320, 99999999, None, -1, 320])], "k int, ids array<int>")
    got = {r.k: r.decoded for r in bpe.decode(df).collect()}
    name = bpe.vocabulary(bpe.vocabulary_path()).names[320].as_py()
    assert got == {1: "", 2: "", 3: f"{name} {name}"}


def test_empty_table_and_clashing_column(spark, table):
    docs = table([(1, "the end")]).withColumnRenamed("lang", "ids")
    assert bpe.encode(docs.where("false")).collect() == []
    assert len(bpe.encode(docs).first().ids) == 2
