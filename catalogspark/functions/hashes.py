"""Content keys and 64-bit perceptual hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def quick_key(body, n_bytes, head: int = 65536) -> Column:
    """Size plus the first and last ``head`` characters: cheap to compare, blind to the middle."""
    b = col(body)
    return F.md5(F.concat_ws("|", col(n_bytes).cast("string"), F.left(b, F.lit(head)), F.right(b, F.lit(head))))


def content_key(body) -> Column:
    return F.md5(col(body))


def fingerprint(*parts) -> Column:
    """One hash over all inputs of a step; equal fingerprints mean there is nothing new to do."""
    return F.md5(F.concat_ws("\u001f", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]))


def _bits(flags) -> Column:
    """Fold an array of 0/1 into a long, first element in the highest place."""
    return F.aggregate(flags, F.lit(0).cast("bigint"), lambda h, b: F.shiftleft(h, 1).bitwiseOR(b.cast("bigint")))


def dhash72(cells) -> Column:
    """Difference hash of 8 rows x 9 grey cells: a bit is set where a cell is brighter than its right neighbour."""
    c = col(cells)
    bit = lambda i: F.when(F.get(c, F.floor(i / 8).cast("int") * 9 + i % 8) > F.get(c, F.floor(i / 8).cast("int") * 9 + i % 8 + 1), 1).otherwise(0)
    return _bits(F.transform(F.sequence(F.lit(0), F.lit(63)), bit))


def dhash_of_vector(vec) -> Column:
    """The same comparison along a ring of 64 values."""
    v = col(vec)
    return _bits(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.get(v, i) > F.get(v, (i + 1) % 64), 1).otherwise(0)))


def hamming64(a, b) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def informative_hash(h) -> Column:
    """Flat pictures hash to nearly all zeros or ones and would match each other."""
    return F.bit_count(col(h)).between(4, 60)


def aspect_value(w, h) -> Column:
    """|ln(width/height)|: two pictures agree in shape, either way up, when these differ by less than -ln 0.94."""
    return F.when((col(w) > 0) & (col(h) > 0), F.abs(F.ln(col(w) / col(h))))


ASPECT_STEP = 0.0618754037180875  # -ln 0.94


def aspect_ok(w1, h1, w2, h2) -> Column:
    """Aspect ratios within 6 %, either way up; unknown sizes pass."""
    a, b = col(w1) / F.nullif(col(h1), F.lit(0)), col(w2) / F.nullif(col(h2), F.lit(0))
    close = lambda x, y: (F.abs(x - y) / F.greatest(x, y)) < 0.06
    known = (col(w1) > 0) & (col(h1) > 0) & (col(w2) > 0) & (col(h2) > 0)
    return ~known | F.coalesce(close(a, b) | close(a, F.lit(1.0) / b), F.lit(False))
