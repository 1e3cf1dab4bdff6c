"""Mixture-controlled packing of token sequences by deficit round-robin.

Each source is a queue. A window of ``window`` tokens offers every queue a quantum in proportion to its weight; what a queue could not use as a whole
token is its deficit and is carried to the next window. As documents may be cut anywhere, a queue has sent exactly
``floor(w * window * weight / all weights)`` tokens when window ``w`` begins (or all it has), which is where round-robin with carried deficits
arrives. So a document's place follows from its position in its queue: positions are prefix sums over hash buckets of each queue, and no
task walks a queue. An exhausted queue sends no more; the others keep their proportions. Windows lie one behind the other in one stream
that is cut into sequences, so that every sequence but the last is full.

Queues: every source has its own. Queues, their tokens and weights are a table; where a queue's part of a window begins is a prefix sum over the
parts that are not empty, so nothing grows with windows times sources. The default weights are the sources' own token counts, so every window
has the mixture of the whole table. Only when ``max_queues`` is given do sources share a queue: those beyond so many with most tokens that the
targets do not name.

Defined cases: a null or empty text is its end token alone; a null source is a source of its own; a weight is given to a queue that the targets do not
name in proportion to its tokens (weights are whole numbers out of 2^16 to 2^40, as the token count allows); targets of sources without rows do not count; repeated rows are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import documents, map_arrow, schema_with, written

LENGTH, WINDOW, END_ID = 2048, 64 * 2048, 1
SPAN = 1024  # windows whose sizes one task sums


def token_table(docs: DataFrame, id_col: str, text_col: str, source_col: str, end_id: int, path: str | None) -> DataFrame:
    """``_row, doc_id, source, ids`` (unsigned 32-bit little-endian, cut to 16 bits when they fit) ``, n`` of each document, written once."""
    path = path or bpe.vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = id_type(len(bpe.vocabulary(path).names), end_id)
        for b, ids in bpe.encoded_batches(batches, "text", path):
            blobs = [np.append(x, end_id).astype(kind).tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(blobs, pa.binary()), pa.array([len(x) + 1 for x in ids], pa.int64())], names=["doc_id", "source", "ids", "n"])

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    tokens = map_arrow(base, run, schema_with(base, ["doc_id", "source"], "ids binary, n long"))
    return written(tokens.withColumn("_row", F.monotonically_increasing_id()), "tokens")


def id_type(vocabulary_size: int, end_id: int) -> str:
    return "<u2" if max(vocabulary_size, end_id + 1) <= 1 << 16 else "<u4"


def weight_bits(total: int, window: int) -> int:
    """Weights are whole numbers out of 2 to this power: as fine as products with tokens and windows stay below 2^62."""
    return min(40, max(16, 60 - max(total, window).bit_length()))


def queue_table(tokens: DataFrame, window: int, targets: dict[str, float] | None, max_queues: int | None) -> tuple[DataFrame, DataFrame, int]:
    """``source, queue`` of every source, ``queue, total, q`` (quantum times the sum of weights) of every queue, and the sum of weights.

    Names of queues are texts: ``s`` and the source, ``-`` for the null source, ``+`` for the shared queue.
    """
    spark = tokens.sparkSession
    named = spark.createDataFrame([(f"s{k}", float(v)) for k, v in (targets or {}).items()], "queue string, target double")
    sums = tokens.groupBy("source").agg(F.sum("n").alias("n"))
    own = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-"))  # a null source differs from every text
    sources = written(sums.select("source", "n", own.alias("queue")).join(named, "queue", "left"), "sources")
    if max_queues is not None:
        top = sources.orderBy(F.desc("n"), "source").limit(max_queues).select("queue", F.lit(True).alias("top"))
        sources = sources.join(top, "queue", "left").withColumn("queue", F.when(F.col("top") | F.col("target").isNotNull(), F.col("queue")).otherwise("+"))
    queues = sources.groupBy("queue").agg(F.sum("n").alias("total"), F.max("target").alias("target"))
    free = F.when(F.col("target").isNull(), F.col("total")).otherwise(0)
    total, free, wanted = queues.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum(free), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    # targets stand for the share of tokens of their sources, so the others keep theirs
    factor = wanted / (1 - free / total) if wanted and free < total else 1.0
    whole = wanted + factor * free / max(1, total) or 1.0
    bits = weight_bits(total, window)
    raw = F.coalesce(F.col("target"), F.col("total") / F.lit(float(max(1, total))) * F.lit(factor)) / F.lit(whole)
    least = F.when(F.col("target").isNull(), F.lit(1)).otherwise(F.lit(1 << bits - 16))  # a target of 0 is not dealt token by token
    weight = F.greatest(least.cast("long"), F.round(raw * F.lit(float(1 << bits))).cast("long"))
    weighted = written(queues.select("queue", "total", (weight * window).alias("q")), "queues")
    return sources.select("source", "queue"), weighted, (weighted.agg(F.sum("q")).first()[0] or window) // window


def layout(narrow: DataFrame, queues: DataFrame, whole: int, length: int, buckets: int) -> DataFrame:
    """``_row, pieces`` from ``_row, queue, n`` and the table of queues: where each part of a document lies."""
    b = F.pmod(F.xxhash64(F.lit("order"), "_row"), F.lit(buckets)).cast("int")
    rows = narrow.withColumn("b", b)
    sums = rows.groupBy("queue", "b").agg(F.sum("n").alias("s"))
    before = Window.partitionBy("queue").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    # one row a queue and bucket takes the queue's numbers to the documents
    shift = sums.select("queue", "b", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("shift")).join(queues, "queue")
    inside = Window.partitionBy("queue", "b").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("local", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    placed = local.join(shift, ["queue", "b"]).select("_row", "queue", "n", "total", "q", (F.col("shift") + F.col("local")).alias("x"))

    div = lambda a, c: F.call_function("div", a, c)
    sent = lambda w: F.least(F.col("total"), div(w * F.col("q"), F.lit(whole).cast("long")))
    # the window that holds token x of a queue
    holds = lambda x: div((x + 1) * F.lit(whole).cast("long") - 1, F.col("q"))
    first, last, end = holds(F.col("x")), holds(F.col("x") + F.col("n") - 1), F.col("x") + F.col("n")
    # a document of a rare source may lie in few of the windows it spans
    windows = F.when(last - first < F.col("n"), F.sequence(first, last)).otherwise(F.array_distinct(F.transform(F.sequence(F.col("x"), end - 1), holds)))
    spread = placed.withColumn("w", F.explode(windows)).withColumns({"lo": F.greatest(F.col("x"), sent(F.col("w"))), "hi": F.least(end, sent(F.col("w") + 1))}).where("hi > lo")
    stretches = written(spread.select("_row", "queue", "total", "w", (F.col("lo") - F.col("x")).alias("start"), (F.col("lo") - sent(F.col("w"))).alias("at"), (F.col("hi") - F.col("lo")).alias("len")), "stretches")

    # where windows begin: sums over the windows of a span and over spans; where queues begin in a window: sums over its queues
    cells = stretches.groupBy("w", "queue", "total").agg(F.sum("len").alias("len"))
    sizes = cells.groupBy("w").agg(F.sum("len").alias("len")).withColumn("span", div(F.col("w"), F.lit(SPAN).cast("long")))
    sizes = written(sizes, "windows")
    upto = lambda *part, by: F.coalesce(F.sum("len").over(Window.partitionBy(*part).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = sizes.groupBy("span").agg(F.sum("len").alias("len")).select("span", upto(by=["span"]).alias("span_at"))
    begins = sizes.withColumn("in_span", upto("span", by=["w"])).join(spans, "span").select("w", (F.col("span_at") + F.col("in_span")).alias("window_at"))
    starts = cells.withColumn("in_window", upto("w", by=[F.desc("total"), "queue"])).join(begins, "w").select("w", "queue", (F.col("window_at") + F.col("in_window")).alias("cell_at"))
    found = stretches.join(starts, ["w", "queue"]).withColumn("g", F.col("cell_at") + F.col("at"))

    def piece(k: Column) -> Column:
        a, z = F.greatest(F.col("g"), k * length), F.least(F.col("g") + F.col("len"), (k + 1) * length)
        return F.struct((F.col("start") + a - F.col("g")).alias("start"), (z - a).alias("length"), k.alias("sequence_id"), (a - k * length).alias("offset"))

    size = F.lit(length).cast("long")
    pieces = F.transform(F.sequence(div(F.col("g"), size), div(F.col("g") + F.col("len") - 1, size)), piece)
    return found.select("_row", pieces.alias("pieces")).groupBy("_row").agg(F.flatten(F.collect_list("pieces")).alias("pieces"))


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length: int = LENGTH, window: int = WINDOW, end_id: int = END_ID,
         targets: dict[str, float] | None = None, max_queues: int | None = None, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source`` and, if asked for, the ids themselves."""
    path = path or bpe.vocabulary_path()
    tokens = token_table(docs, id_col, text_col, source_col, end_id, path)
    rows = tokens.count()
    sources, queues, whole = queue_table(tokens, window, targets, max_queues)
    narrow = tokens.select("_row", "source", "n").join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select("_row", "queue", "n")
    places = layout(narrow, queues, whole, length, min(16384, max(256, rows // 4096)))
    both = tokens.join(places, "_row")
    keep = ["doc_id", "source"]
    fields = PIECE if with_ids else PIECE.removesuffix(", ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = id_type(len(bpe.vocabulary(path).names), end_id)
        for b in batches:
            src, out, slices = [], [], []
            for i, (raw, pieces) in enumerate(zip(b.column("ids").to_pylist(), b.column("pieces").to_pylist(), strict=True)):
                ids = np.frombuffer(raw, kind).astype("<u4")
                for p in pieces:
                    part = ids[p["start"]:p["start"] + p["length"]]
                    src.append(i)
                    slices.append(part)
                    out.append((p["start"], p["length"], zlib.crc32(part.tobytes()), len(ids), p["sequence_id"], p["offset"]))
            at = pa.array(src, pa.int64())
            cols = [b.column(c).take(at) for c in keep] + [pa.array([r[k] for r in out], pa.int64()) for k in range(6)]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum([len(s) for s in slices])]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, "<u4"), *slices]).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *[f.split()[0] for f in fields.split(", ")]])

    return map_arrow(both.select(*keep, "ids", "pieces"), run, schema_with(both, keep, fields))


def op5(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens, every window with the mixture of the table."""
    return pack(documents(spark, sf_dir).select("doc_id", "text", "source"), with_ids=False)
