"""Secret scans with multipart credential linking, with DataFrame functions only.

Strong kinds are found by pattern: ``assign`` (a name that tells a secret, and its value), ``access`` (access identifiers) and ``hex`` (long runs of
hexadecimal digits). Weak candidates prove nothing alone: ``ident`` (a login or client name), ``blob`` (a mixed token that may be a secret) and
``endpoint`` (an address). They are reported only when the parts that complete a credential stand within ``REACH`` code points: a blob needs an
identifier, an identifier needs a secret, an endpoint needs both. Parts meet in an interval join on the document and the stretch of
``REACH`` code points they lie in; it is a semi join, so a candidate comes out once however many parts are near.

Each text is read once; what goes on are positions. A text's positions come from the lengths of matches and of the pieces between them. Weak
candidates that overlap a strong span are found by the same kind of join, so nothing grows with weak times strong spans of a text.

Defined cases: a null or empty text has no spans; a weak candidate that overlaps a strong span is left out; repeated rows are judged each; an empty
table gives no rows; positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, in_blocks, without, written

REACH = 200
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENT = r"""(?i:user_?name|login|client_?id|account_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
BLOB = r"[A-Za-z0-9+/]{20,}={0,2}"
ENDPOINT = r"""(?:https?://|[a-z]+\.(?:amazonaws|googleapis|azure)\.com)[^\s"'<>]*"""
STRONG = ("assign", "access", "hex")
WEAK = ("ident", "blob", "endpoint")
KINDS = STRONG + WEAK
IDENTIFIERS, SECRETS = ("access", "ident"), ("assign", "hex", "blob")


def matches(text: Column, kind: str, pattern: str, keep=lambda m: F.lit(True)) -> Column:
    """Leftmost matches as ``kind, start, end``; ``keep`` judges a match by its text. Most texts have none and are scanned once."""
    found = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda before, m: F.struct(F.length(before).alias("gap"), m.alias("m")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.when(x["m"].isNotNull() & keep(x["m"]), one).otherwise(none)).alias("spans"))

    # matches are walked in blocks, each from the end of the one before, so that no long list is copied per match
    begin = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    walked = F.aggregate(in_blocks(found), F.array(begin), lambda acc, block: F.concat(acc, F.array(F.aggregate(block, F.struct(F.element_at(acc, -1)["at"].alias("at"), none.alias("spans")), step))))
    return F.when(text.rlike(pattern), F.flatten(F.transform(walked, lambda w: w["spans"]))).otherwise(none)


def _long_value(m: Column) -> Column:
    return F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6


def _mixed(m: Column) -> Column:
    return m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")


def parts_of(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``strong`` and ``weak``: the spans of either sort in each text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    strong = F.concat(matches(text, "assign", ASSIGN, _long_value), matches(text, "access", ACCESS), matches(text, "hex", HEX))
    weak = F.concat(matches(text, "ident", IDENT), matches(text, "blob", BLOB, _mixed), matches(text, "endpoint", ENDPOINT))
    return df.withColumns({"strong": strong, "weak": weak})


def _cells(start: Column, end: Column, reach: int, margin: int) -> Column:
    return F.explode(F.sequence(F.floor((start - margin) / reach), F.floor((end + margin) / reach)))


def link_weak(facts: DataFrame, reach: int = REACH) -> DataFrame:
    """``_row, kind, start, end`` of the weak candidates that are completed by others; ``facts`` has ``_row, strong, weak``."""
    places = ["_row", "kind", "start", "end"]
    every = facts.where(F.size("weak") > 0).select("_row", F.explode(F.concat("strong", "weak")).alias("p")).select("_row", "p.*")
    cells = every.withColumn("cell", _cells(F.col("start"), F.col("end"), reach, 0))
    w, s = cells.where(F.col("kind").isin(*WEAK)).alias("w"), cells.where(F.col("kind").isin(*STRONG)).alias("s")
    overlaps = (F.col("s.start") < F.col("w.end")) & (F.col("w.start") < F.col("s.end"))
    covered = w.join(s, (F.col("w._row") == F.col("s._row")) & (F.col("w.cell") == F.col("s.cell")) & overlaps, "left_semi").select(*places)
    parts = written(every.join(covered, places, "left_anti"), "secret-candidates")
    near = parts.select("_row", F.col("kind").alias("pk"), F.col("start").alias("ps"), F.col("end").alias("pe"), _cells(F.col("start"), F.col("end"), reach, reach).alias("cell"))
    wanted = parts.where(F.col("kind").isin(*WEAK)).withColumn("cell", _cells(F.col("start"), F.col("end"), reach, 0))

    def beside(left: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
        a, b = left.alias("a"), near.where(F.col("pk").isin(*kinds)).alias("b")
        close = (F.col("b.ps") - reach < F.col("a.end")) & (F.col("a.start") < F.col("b.pe") + reach)
        return a.join(b, (F.col("a._row") == F.col("b._row")) & (F.col("a.cell") == F.col("b.cell")) & close, "left_semi")

    # an address lies in several stretches when it is long; either partner may be met in another one
    blobs = beside(wanted.where("kind = 'blob'"), IDENTIFIERS).select(*places)
    idents = beside(wanted.where("kind = 'ident'"), SECRETS).select(*places)
    ends = wanted.where("kind = 'endpoint'")
    whole = beside(ends, IDENTIFIERS).select(*places).distinct().join(beside(ends, SECRETS).select(*places).distinct(), places)
    return blobs.unionByName(idents).distinct().unionByName(whole.select(*places))


def scan(df: DataFrame, text_col: str = "text", reach: int = REACH) -> DataFrame:
    """Add ``spans``: strong spans and completed weak ones in order of start and kind, and ``strong``: the strong ones alone. The text is dropped."""
    keep = without(df, text_col, "strong", "weak", "spans", "_row")
    facts = written(parts_of(df, text_col).select(F.monotonically_increasing_id().alias("_row"), *keep, "strong", "weak"), "secret-parts")
    linked = link_weak(facts, reach).groupBy("_row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))
    kind = F.array(*[F.lit(k) for k in KINDS])
    ordered = lambda spans: F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(kind, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return facts.join(linked, "_row", "left").select(*keep, ordered(F.col("strong")).alias("strong"), ordered(F.concat("strong", F.coalesce("linked", none))).alias("spans"))


def op3(spark, sf_dir: str) -> DataFrame:
    """Secrets in every document; the digests are built from the operator's spans."""
    found = scan(documents(spark, sf_dir).select("doc_id", "text"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("strong", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in STRONG], F.sha2(listed(F.col("strong")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
