import zlib

import numpy as np
import pytest
from catalogspark.llm import language as L
from catalogspark.llm.queries import QUERIES
from pyspark.sql import functions as F


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = QUERIES["op8_kneser_ney_language"](spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id for r in got} == set(docs) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    test = [r for r in got if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in test) >= 0.97 * len(test)
    assert sum(r.rejected for r in got) <= 0.03 * len(got)


def test_held_out_rows_teach_nothing(spark, table, sentences, fixture_dir):
    rows = [(i, sentences(i, 12), "aa") for i in range(60)] + [(i, "zq xv qz " * 9, "hid") for i in range(100, 400) if held(i)]
    rows += [(900, None), (901, " 12 !?"), (902, "")]
    got = {r.doc_id: r for r in QUERIES["op8_kneser_ney_language"](spark, fixture_dir(table(rows))).collect()}
    assert {r.lang_pred for r in got.values()} == {"aa", "und"}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 and got[k].rejected for k in (900, 901, 902))
    assert all(got[k].rejected for k in got if 100 <= k < 400) and not any(got[k].rejected for k in range(60))


def plain_probability(texts, word, order=L.ORDER):
    """Interpolated Kneser-Ney by its definition, with dictionaries."""
    from collections import Counter, defaultdict

    words = [f"\x02{w}\x03" for t in texts for w in t.split()]
    raw = [Counter() for _ in range(order + 1)]
    for w in words:
        for i in range(1, len(w)):
            for k in range(1, order + 1):
                if i - k + 1 >= 0:
                    raw[k][w[i - k + 1:i + 1]] += 1
    used = [None] * (order + 1)
    used[order] = raw[order]
    for k in range(order - 1, 0, -1):
        before = defaultdict(set)
        for g in raw[k + 1]:
            before[g[1:]].add(g[0])
        used[k] = {g: len(v) for g, v in before.items()} | {g: c for g, c in raw[k].items() if g[0] == "\x02"}
    letters = len(used[1])

    def prob(gram):
        k = len(gram)
        lower = prob(gram[1:]) if k > 1 else 1 / (letters + 1)
        same = {g: c for g, c in used[k].items() if g[:-1] == gram[:-1]}
        if not same:
            return lower
        d, total = L._discount(np.array(list(used[k].values()))), sum(same.values())
        return max(same.get(gram, 0) - d, 0) / total + d * len(same) / total * lower

    w = f"\x02{word}\x03"
    return sum(-np.log2(prob(w[max(0, i - order + 1):i + 1])) for i in range(1, len(w)))


def test_costs_equal_the_definition(sentences):
    texts = [sentences(k, 40) for k in range(3)]
    model = L.fit([("x", t) for t in texts])
    for word in ("kaleur", "mnrst", "zebra", "a", sentences(1, 1)):
        w = L.split_words([word], letters_only=True)
        got = L.word_costs(model, L._sequences(w.points, w.starts, w.ends))[0, 0]
        assert got == pytest.approx(plain_probability(texts, word), rel=1e-9)


def test_no_labels_and_empty_table(spark, table):
    docs = table([(1, "some text"), (2, "??")])
    assert L.fit(L.labelled_sample(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))) is None
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in L.identify(docs, None).collect()}
    assert got == {1: ("und", False), 2: ("und", True)}
    assert L.identify(docs.where("false"), None).collect() == []


def test_three_hundred_languages(spark, table):
    """Every language value is learned; each has its own syllables."""
    rnd = np.random.default_rng(6)
    rows = []
    for k in range(300):
        syllables = ["".join(chr(97 + c) for c in rnd.integers(0, 26, 3)) for _ in range(12)]
        for j in range(12):
            words = ["".join(syllables[i] for i in rnd.integers(0, 12, 2)) for _ in range(30)]
            rows.append((k * 100 + j, " ".join(words), f"lang{k:03}"))
    docs = table(rows)
    sample = L.labelled_sample(docs, F.col("doc_id") % 100 < 10)
    assert len({name for name, _ in sample}) == 300
    model = L.fit(sample)
    assert len(model.languages) == 300 and all(len(b.languages) <= L.BLOCK for b in model.blocks)
    got = L.identify(docs.where("doc_id % 100 >= 10"), model).collect()
    assert len(got) == 600 and sum(r.lang == r.lang_pred for r in got) >= 590


def test_blocks_do_not_change_costs(sentences, monkeypatch):
    rows = [(name, sentences(100 * k + j, 20) + tail * 5) for k, (name, tail) in enumerate([("a", " uno"), ("b", " dwa"), ("c", " tri")]) for j in range(8)]
    texts = [t for _, t in rows]
    one = L.text_entropies(L.fit(rows), texts)[0]
    monkeypatch.setattr(L, "BLOCK", 2)
    assert np.allclose(one, L.text_entropies(L.fit(rows), texts)[0])


def test_the_sample_is_bounded_by_characters(spark, table):
    rows = [(k, "ab cd " * 1000, "x") for k in range(5)] + [(9, "zu " * 5000, "y")]
    sample = L.labelled_sample(table(rows), F.lit(True), sample_chars=7000)
    chars = {n: sum(len(t) for m, t in sample if m == n) for n in ("x", "y")}
    assert chars == {"x": 7000, "y": 7000}


def test_the_driver_gives_memory_of_the_fit_back(table, monkeypatch):
    calls = []
    monkeypatch.setattr(L, "give_back", lambda: calls.append(1))
    docs = table([(k, "the cat sat on the mat and looked") for k in range(8)])
    model = L.fit(L.labelled_sample(docs, F.lit(True)))
    assert not calls
    L.identify(docs, model)
    assert calls == [1]
