"""Document fingerprints: a Merkle tree over paragraphs and sections, with DataFrame functions only.

A leaf is a paragraph (a line with its line end; a longer one is cut after every ``PIECE`` code points). A leaf's digest decides whether a
section ends with it, so an edit moves section bounds only near itself. A section's digest covers the digests of its leaves, the root covers the
digests of the sections. Roots are equal when texts are equal; unequal documents are compared by descending into the sections whose
digests differ, down to the leaves, which locates the edits.

The fingerprint is text: root, section digests and leaves (``digest.length``), parted by ``|``; sections part the leaves with ``;``.

Defined cases: a null text is an empty one; an empty text has a root but no leaves; the likeness of two equal fingerprints is 1, of an empty and
another one 0. Rows that repeat an id and a text stand once in the order of documents and get the same result each; rows with one id and
different texts follow each other; a null id comes first. Of a single document, it is its own next. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound, documents, id_key, in_blocks, written

PIECE = 240
LEAF_HEX, SECTION_HEX = 16, 16


def leaves_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{PIECE}}}\n?|\n"), F.lit(0))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text that is not null. Digests are whole inside the tree; what is shown of leaves and sections is their beginning."""
    # one leaf in eight ends its section
    leaf = lambda piece, digest: F.concat(digest, F.lit("."), F.length(piece).cast("string"), F.when(F.right(digest, F.lit(1)).isin("0", "8"), F.lit(";")).otherwise(F.lit(",")))
    body = F.rtrim(F.array_join(F.transform(leaves_of(text), lambda p: leaf(p, F.sha2(p, 256))), ""), F.lit(",;"))
    sections = F.array_join(F.transform(F.split(body, ";"), lambda s: F.sha2(s, 256)), ",")
    shown = lambda digests, kept: F.regexp_replace(digests, rf"([0-9a-f]{{{kept}}})[0-9a-f]{{{64 - kept}}}", "$1")
    return F.concat_ws("|", F.sha2(sections, 256), shown(sections, SECTION_HEX), shown(body, LEAF_HEX))


def _part(fp: Column, k: int) -> Column:
    return F.element_at(F.split(fp, r"\|"), k)


def _leaf_list(fp: Column) -> Column:
    return F.filter(F.split(_part(fp, 3), "[,;]"), lambda leaf: leaf != "")


def _length(leaf: Column) -> Column:
    """Code points of a leaf, numbered or not."""
    return F.substring_index(F.substring_index(leaf, ".", -1), "#", 1).cast("long")


def _numbered(leaves: Column) -> Column:
    """Leaves with the number of their occurrence: equal ones follow each other in the sorted list and are found as runs."""
    runs = F.regexp_extract_all(F.concat(F.array_join(F.array_sort(leaves), ","), F.lit(",")), F.lit("([^,]+,)\\1*+"), F.lit(0))
    of = lambda run: F.substring_index(run, ",", 1)
    count = lambda run: (F.length(run) / (F.length(of(run)) + 1)).cast("int")
    return F.flatten(F.transform(runs, lambda run: F.transform(F.sequence(F.lit(1), count(run)), lambda k: F.concat(of(run), F.lit("#"), k.cast("string")))))


def _weight(leaves: Column) -> Column:
    """Code points in leaves, numbered or not."""
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda s, leaf: s + _length(leaf))


def likeness(a: Column, b: Column) -> Column:
    """Share of code points in leaves that both documents have, each as often as both have it: twice the common length by the sum of both lengths; 0 to 1.

    Only equal fingerprints have likeness 1: unequal ones with the same leaves in another order or section have half a code point less in common.
    """
    mine, theirs = _leaf_list(a), _leaf_list(b)
    common = _weight(F.array_intersect(_numbered(mine), _numbered(theirs)))
    both = _weight(mine) + _weight(theirs)
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(F.least(2.0 * common, both - 1.0), both.cast("double")), F.lit(0.0)))


def running(values: Column) -> Column:
    """Sums of the values before each one, and of all at the end; in blocks, so that no long list is copied for every value."""
    none = F.array().cast("array<bigint>")
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["sums"], F.array(acc["at"] + x)).alias("sums"))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array(F.lit(0).cast("long")).alias("sums"))
    walked = F.aggregate(in_blocks(values), F.array(begin), lambda acc, block: F.concat(acc, F.array(F.aggregate(block, F.struct(F.element_at(acc, -1)["at"].alias("at"), none.alias("sums")), step))))
    return F.flatten(F.transform(walked, lambda w: w["sums"]))


def _lacking(names: Column, known: Column) -> Column:
    """The ``n`` of those structs ``x, n`` (a name, and ten or more digits) whose name is not among the known ones.

    Both sides are sorted together: a known name comes right before the equal ones, and goes with them.
    """
    mine = F.transform(names, lambda v: F.concat(v["x"], F.lit(":"), v["n"]))
    theirs = F.transform(F.array_distinct(known), lambda x: F.concat(x, F.lit(":")))
    together = F.concat(F.array_join(F.array_sort(F.concat(mine, theirs)), ","), F.lit(","))
    left = F.regexp_replace(together, r"([^,:]+:),(?:\1\d+,)*+", "")
    return F.array_sort(F.regexp_extract_all(left, F.lit(r":(\d+),"), F.lit(1)))


def differing_leaves(a: Column, b: Column) -> Column:
    """Places (code points of ``a``) of the leaves that stand in sections of ``a`` which ``b`` lacks and that ``b`` itself lacks.

    The tree is descended: first the sections that ``b`` lacks are found, then the leaves below them.
    """
    digits = lambda i: F.lpad(i.cast("string"), 10, "0")
    sections = F.split(_part(a, 3), ";")
    other = _lacking(F.transform(F.split(_part(a, 2), ","), lambda d, i: F.struct(d.alias("x"), digits(i).alias("n"))), F.split(_part(b, 2), ","))
    below = lambda s, i: F.transform(F.split(F.get(s, i.cast("int")), ","), lambda leaf, j: F.struct(leaf.alias("x"), F.concat(i, digits(j)).alias("n")))
    names = F.filter(F.flatten(bound(sections, lambda s: F.transform(other, lambda i: below(s, i)))), lambda v: v["x"] != "")
    gone = _lacking(names, _leaf_list(b))
    first_leaf = running(F.transform(sections, lambda s: F.size(F.split(s, ",")).cast("long")))
    places = running(F.transform(_leaf_list(a), _length))
    number = lambda first, n: (F.get(first, F.left(n, F.lit(10)).cast("int")) + F.right(n, F.lit(10)).cast("int")).cast("int")
    numbers = bound(first_leaf, lambda first: F.transform(gone, lambda n: number(first, n)))
    found = bound(places, lambda at: F.transform(numbers, lambda k: F.struct(F.get(at, k).alias("start"), F.get(at, k + 1).alias("end"))))
    return F.when(a == b, F.array().cast("array<struct<start:bigint,end:bigint>>")).otherwise(found)


def fingerprints(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``fingerprint``."""
    return df.withColumn("fingerprint", fingerprint(F.coalesce(F.col(text_col), F.lit(""))))


def successors(ids: DataFrame) -> DataFrame:
    """``k, h`` of each document with ``nk, nh`` of the next one by id; the last is followed by the first.

    Documents are dealt into ranges of ids; inside a range the next one is a lead, and only the first document of each range is
    needed to close the gaps.
    """
    order = ["doc_id", "h"]
    ranged = written(ids.repartitionByRange(*order).withColumn("p", F.spark_partition_id()), "id-ranges")
    item = F.struct("doc_id", "h", "k")
    inside = ranged.withColumn("next", F.lead(item).over(Window.partitionBy("p").orderBy(*order)))
    firsts = ranged.groupBy("p").agg(F.min(item).alias("first"))  # one row a range
    every = Window.orderBy("p")
    following = firsts.select("p", F.coalesce(F.lead("first").over(every), F.first("first").over(every)).alias("follow"))
    return inside.join(following, "p").select("k", "h", "n", F.coalesce("next", "follow").alias("to")).select("k", "h", "n", F.col("to.k").alias("nk"), F.col("to.h").alias("nh"))


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document, of its edited text and their likenesses, and that to the next document.

    Only ids and lengths are ordered; texts are shuffled once by id. The next document sends the opening that an edit needs and its
    fingerprint, never its whole text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumns({"k": id_key("doc_id"), "h": F.xxhash64("text")})
    ids = base.select("doc_id", "k", "h", F.length("text").cast("long").alias("n")).distinct()
    asks = successors(ids).select(F.col("nk").alias("k"), F.col("nh").alias("h"), F.col("k").alias("ask_k"), F.col("h").alias("ask_h"), F.floor(F.col("n") / 2).cast("int").alias("half"))
    asks = written(asks, "openings-asked")
    # both joins below use these columns alike, so Spark shuffles the texts once
    full = base.withColumn("fingerprint", fingerprint(F.col("text")))
    sent = full.join(asks, ["k", "h"]).select(
        F.col("ask_k").alias("k"), F.col("ask_h").alias("h"), "half", F.left("text", F.col("half")).alias("opening"), F.col("fingerprint").alias("next_fingerprint"), F.col("doc_id").alias("next_doc_id"))
    once = sent.withColumn("r", F.row_number().over(Window.partitionBy("k", "h").orderBy("half"))).where("r = 1").drop("r")
    n = F.length("text")
    both = full.join(once, ["k", "h"]).withColumn("edited", F.concat(F.left("text", n - F.col("half")), F.col("opening")))
    marked = both.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_doc_id", "next_fingerprint")
    return marked.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), "next_doc_id", differing_leaves(F.col("edited_fingerprint"), F.col("fingerprint")).alias("edits"))


def op1(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text; ``edits`` lists the places of the edited text that the descent finds."""
    found = edited_neighbours(documents(spark, sf_dir))
    place = lambda e: F.concat_ws(":", e["start"].cast("string"), e["end"].cast("string"))
    return found.withColumn("edits", F.array_join(F.transform("edits", place), ","))
