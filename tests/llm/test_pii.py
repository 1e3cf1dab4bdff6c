import hashlib
import re
import time

from catalogspark.llm import pii
from catalogspark.llm.queries import QUERIES

TEXTS = [
    None, "", "no data here", "mail a.b+c@mail.example.com, or x@y.z; @ alone, a@b and a@-.-", "a@b.c@d.e@f.g", "..@x.y..z@q.w", "1.2.3.4 and 1.2.3.4.5.6.7.8 and 256.1.1.1 and 1.2.3", "99.999.1.1.2.3.4",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1111 and 4111111111111112 and 41111111111111111111", "4111 1111 1111 1111 4111 1111 1111 1111", "+1 (274) 555-9629 and +12 and +1--2 and +49 30 1234567890123456",
    "+1 234 567 8+9 876 543 21", "see https://example.com/a?b=c, and HTTP://x.y/z. mailto:me@you.org", "IBAN DE89 3704 0044 0532 0130 00 and IBAN DE89370400440532013001, account no: 12345678, Konto 123", "é@b.c 日本a@b.cd +１２３４５６７８",
    "12345678901234567 8", "1" * 400, "a" * 3000 + "@" + "b.c" * 10, "x@y.z" * 300]


def base_spans(text):
    """The base rules by plain regular expressions over the whole text."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"]
        odd = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
        if 16 <= len(d) <= 19 and odd % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_query_equals_plain_expressions(spark, table, fixture_dir):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, TEXTS[4])]
    got = {(r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in QUERIES["op7_pii_anchors"](spark, fixture_dir(table(rows))).collect()}
    want = set()
    for i, t in rows:
        spans = base_spans(t)
        n = [sum(s[0] == k for s in spans) for k in pii.BASE]
        want.add((i, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest(), *n))
    assert got == want


def test_given_documents(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.find_spans(r.text) if k < 4] == base_spans(r.text)


def test_added_kinds():
    kinds = lambda t: [(pii.KINDS[k], t[a:b]) for k, a, b in pii.find_spans(t) if k > 3]
    assert kinds(TEXTS[12]) == [("url", "https://example.com/a?b=c"), ("url", "HTTP://x.y/z"), ("url", "mailto:me@you.org")]
    assert kinds(TEXTS[13]) == [("account", "DE89 3704 0044 0532 0130 00"), ("account", "12345678")]


def test_parts_of_any_length_are_judged(spark, table, fixture_dir):
    long, zeros = "1" * 5000 + ".1.1.1", "0" * 5000 + "7.1.1.255"
    rows = [(1, f"{long} then 1.2.3.4"), (2, zeros), (3, "1.1.1." + "9" * 5000), (4, "0256.1.1.1 000.00.0.0255")]
    got = {r.doc_id: r.spans for r in QUERIES["op7_pii_anchors"](spark, fixture_dir(table(rows))).collect()}
    assert got == {1: f"ip:{len(long) + 6}:{len(long) + 13}", 2: f"ip:0:{len(zeros)}", 3: "", 4: "ip:11:24"}


def test_redaction_keeps_the_rest(spark, table):
    docs = table([(1, "call +1 (274) 555-9629 or a@b.cd now"), (2, None), (3, "clean")])
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert got == {1: "call [PHONE] or [EMAIL] now", 2: None, 3: "clean"}
    assert pii.redact(docs).columns == docs.columns


def test_empty_table_and_clashing_column(spark, table):
    docs = table([(1, "a@b.cd")]).withColumnRenamed("lang", "PII")
    assert pii.pii_spans(docs.where("false")).collect() == []
    assert pii.pii_spans(docs).first().pii[0].kind == "email"


def test_very_long_runs_take_linear_time():
    begin = time.time()
    for text in ("1" * 1_000_000, "1" * 1_000_000 + ".2.3.4 and 5.6.7.8", "12 " * 300_000, "+1 " * 300_000, "1.2." * 250_000, "a" * 1_000_000 + "@b.c", "@" * 300_000, "+" + "(" * 500_000):
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.find_spans(text) if k < 4] == base_spans_of_runs(text)
    assert time.time() - begin < 30


def base_spans_of_runs(text):
    """The base rules where a run of digits is tried from its first digit only, so that this check is linear too."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+)?", text):  # a run that no address follows is passed over whole
        if m[1]:
            out.append(("email", *m.span()))
    for m in re.finditer(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"]
        if 16 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out
