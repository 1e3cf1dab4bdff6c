"""Sharding by balanced label propagation, with DataFrame operations only.

Documents that share a link value (by default: equal texts) are neighbours. Every document starts with a label drawn from its row
number; in each round a document asks to move to the label that weighs most among its neighbours, if it weighs more than its own (after
the first round, among labels that have a twentieth of their room left or enough for the rest of its group), and a quota per label, its room and what its leavers free, decides
which requests are met. Rounds go on until no request is met: every move joins a row to a heavier part of its group, so that the sum of the squared
parts grows and rounds come to an end. Afterwards the unlinked documents fill what room is left, so that shard counts differ by one at most (law ``rows``).

Neighbours meet through the link value (a hub), so a group of k documents costs k rows a round instead of k*k pairs; the weights are
counted per (group, label) before they are shuffled. Quotas and positions come from prefix sums over hash buckets, so that no task
sorts a whole shard. Only numbers per shard reach the driver.

Defined cases: a null text has no bytes (size 1) and is equal to other null or empty texts; repeated rows are separate documents;
an empty table gives no rows; a group larger than a shard fills shards one after the other; columns of the input other than
the id and the text do not matter.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

FIELDS, ROW_FIELDS = 64, 256


def _caps(n: int, shards: int) -> list[int]:
    return [n // shards + (t < n % shards) for t in range(shards)]


def _lit_array(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def _numbered(df: DataFrame, keys: list[str], row: str, buckets: int, out: str) -> DataFrame:
    """Gapless numbers from 0 within ``keys``: position in a hash bucket plus the sizes of the buckets before it."""
    df = df.withColumn("_b", F.pmod(F.xxhash64(F.lit("number"), row), F.lit(buckets)).cast("int"))
    sizes = df.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    local = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(row)) - 1
    return df.withColumn("_local", local).join(shift, [*keys, "_b"]).withColumn(out, F.col("_shift") + F.col("_local")).drop("_b", "_local", "_shift")


def propagate(linked: DataFrame, caps: list[int]) -> tuple[DataFrame, list[int]]:
    """Move ``_row, _key, _label`` towards their neighbours' labels under ``caps``; returns the rows and the counts per label.

    Stops when no request is met. A row keeps its label when its wish has no room.
    """
    shards, spark = len(caps), linked.sparkSession
    before: list[str] = []

    def counts(df: DataFrame) -> list[int]:
        got = {r["_label"]: r["count"] for r in df.groupBy("_label").count().collect()}  # one number a shard
        return [got.get(t, 0) for t in range(shards)]

    used = counts(linked)
    for turn in count():
        used_up: list[str] = []
        free = [max(0, c - u) for c, u in zip(caps, used, strict=True)]
        weights = linked.groupBy("_key", "_label").agg(F.count(F.lit(1)).alias("_w"))
        per_key = weights.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("_label", "_w"))).alias("_m"))  # at most one entry a shard
        # the heaviest label with room; among equals a label that depends on the group, so that groups do not all ask for the same one
        choices = F.array(*[F.struct(F.coalesce(F.try_element_at("_m", F.lit(t)), F.lit(0)).alias("w"), F.pmod(F.xxhash64("_key", F.lit(t)), F.lit(1 << 20)).alias("tie"), F.lit(t).alias("t")) for t in range(shards)])
        open_ = [t for t in range(shards) if turn == 0 or free[t] > caps[t] // 20]
        rest = lambda c: F.aggregate("_choices", F.lit(0).cast("long"), lambda s, x: s + x["w"]) - c["w"]
        best = F.array_max(F.filter("_choices", lambda c: (c["w"] > 0) & (c["t"].isin(open_) | (rest(c) <= F.element_at(_lit_array(free), c["t"] + 1)))))
        wish = written(per_key.select("_key", choices.alias("_choices")).withColumn("_best", best), "wishes", used_up)
        asked = linked.join(wish, "_key").withColumn("_to", F.when(F.col("_best") > F.get("_choices", F.col("_label")), F.col("_best.t")))
        # requests are met in the order of these fields: groups stay together, and a group too large for the room left is cut
        field = F.pmod(F.xxhash64("_key"), F.lit(FIELDS)) * ROW_FIELDS + F.pmod(F.xxhash64("_row", F.lit(turn)), F.lit(ROW_FIELDS))
        asked = written(asked.select("_row", "_key", "_label", "_to", field.cast("int").alias("_f")), "asked", used_up)
        # rows that ask to leave a label make room there; where they are not let in elsewhere, the surplus is settled at the end
        leaving = {r["_label"]: r["count"] for r in asked.where("_to is not null").groupBy("_label").count().collect()}
        quota = [max(0, c - u + leaving.get(t, 0)) for t, (c, u) in enumerate(zip(caps, used, strict=True))]
        per_field = asked.where("_to is not null").groupBy("_to", "_f").agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy("_to").orderBy("_f"))
        met = per_field.select("_to", "_f", "_n", (upto <= F.element_at(_lit_array(quota), F.col("_to") + 1)).alias("_met")).where("_met")
        met = written(met, "met", used_up)  # at most one row a label and field
        if not met.agg(F.sum("_n")).first()[0]:
            discard(spark, used_up)
            break
        moved = written(asked.join(met.drop("_n"), ["_to", "_f"], "left").select("_row", "_key", F.when(F.col("_met"), F.col("_to")).otherwise(F.col("_label")).alias("_label")), "labels", after := [])
        discard(spark, used_up + before)
        linked, used, before = moved, counts(moved), after
    return linked, used


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", link: Column | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    facts = written(docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"), (F.sha2(raw, 256) if link is None else link.cast("string")).alias("_key")), "shard-facts")
    n = facts.count()
    caps = _caps(n, shards)
    buckets = min(16384, max(256, n // 4096))
    groups = written(facts.where("_key is not null").groupBy("_key").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1"), "shard-groups")
    tagged = written(facts.select("_row", "_key").join(groups, "_key", "left").select("_row", "_key", F.col("_size").isNotNull().alias("_linked")), "shard-tagged")
    start = tagged.where("_linked").select("_row", "_key", F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("int").alias("_label"))
    placed, used = propagate(start, caps)
    # labels may start over a shard's room only when linked rows alone exceed it; the surplus is dealt out like unlinked rows
    if any(u > c for u, c in zip(used, caps, strict=True)):
        ranked = _numbered(placed, ["_label"], "_row", buckets, "_rank").withColumn("_keep", F.col("_rank") < F.element_at(_lit_array(caps), F.col("_label") + 1))
        ranked = written(ranked.select("_row", "_label", "_keep"), "shard-ranked")
        kept, loose = ranked.where("_keep").select("_row", F.col("_label").alias("shard")), ranked.where("not _keep").select("_row")
        used = [min(u, c) for u, c in zip(used, caps, strict=True)]
    else:
        kept, loose = placed.select("_row", F.col("_label").alias("shard")), None
    singles = tagged.where("not _linked").select("_row")
    singles = singles if loose is None else singles.unionByName(loose)
    ends, total = [], 0
    for c, u in zip(caps, used, strict=True):
        total += c - u
        ends.append(total)
    filled = _numbered(singles, [], "_row", buckets, "_n").select("_row", F.size(F.filter(_lit_array(ends), lambda e: e <= F.col("_n"))).alias("shard"))
    shard = written(kept.unionByName(filled), "shard-of-row")
    slots = _numbered(shard, ["shard"], "_row", buckets, "slot")
    return facts.join(slots, "_row").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
