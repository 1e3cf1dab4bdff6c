import corpus_pipeline as P
import pytest
from catalogspark.llm import pii
from test_partenum import brute, near_rows


def test_stages_and_registration():
    import __spark_entry__ as entry

    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "repeated_passages", "personal_data", "packing"]
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def test_one_of_each_group_stays(spark, table, sentences):
    rows = near_rows(sentences, 5)
    docs = table(rows)
    got = P.keep_one_of_each_group(spark, docs, "")
    assert got.columns == docs.columns
    text = {d: t for d, t in rows}
    want = sorted({d for d, n, c in brute(rows, 5, 80) if n and (c == d or (c is None and d is None))} | {d for d, t in rows if not (text[d] or "").strip()}, key=repr)
    assert sorted([r.doc_id for r in got.collect()], key=repr) == want


def test_passages_are_cut_and_data_redacted(spark, table, sentences):
    passage = sentences(77, 30)
    docs = table([(1, f"one {passage} end"), (2, f"two {passage} end é"), (3, None), (4, "mail a@b.cd é")])
    cut = {r.doc_id: r for r in P.cut_repeated_passages(spark, docs, "").collect()}
    assert cut[1].text == f"one {passage} end" and cut[2].text == "two é" and cut[2].n_chars == 5 and cut[4].text == "mail a@b.cd é"
    red = P.redact_personal_data(spark, docs, "")
    assert red.columns == docs.columns and {r.doc_id: r.text for r in red.collect()}[4] == "mail [EMAIL] é"


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES], ids=[n for n, _ in P.STAGES])
def test_stages_take_empty_tables(spark, table, stage):
    assert stage(spark, table([(1, "x")]).where("false"), "").collect() == []


def test_whole_run(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = P.run(spark, "/root/testdata/sf0.001").collect()
    kept = {r.doc_id for r in got}
    assert kept < {r.doc_id for r in docs.select("doc_id").collect()} and len(kept) > 0.8 * docs.select("text").distinct().count()
    assert not any(pii.find_spans(t) for t in ["".join(c for c in "no data")])
    filled = {}
    for r in got:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert all(n == 2048 for s, n in filled.items() if s != max(filled))
