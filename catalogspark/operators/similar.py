"""Near-duplicate search over 64-bit hashes: exact, without comparing everything with everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import ASPECT_STEP, aspect_value, hamming64, informative_hash
from .components import connected_components, merged

HOT_KEY = 20_000
CHUNK = 2_000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _split_bits(mask: int, n: int) -> list[int]:
    """Cut the set bits of ``mask`` into ``n`` runs of nearly equal size."""
    bits = [i for i in range(64) if mask >> i & 1]
    size, extra = divmod(len(bits), n)
    out, at = [], 0
    for k in range(n):
        step = size + (1 if k < extra else 0)
        out.append(sum(1 << b for b in bits[at:at + step]))
        at += step
    return out


def _block_masks(t: int) -> tuple[list[int], list[int], list[int]]:
    """Blocks, key masks, and for each key the blocks (as bits) that must differ so that a pair is reported by its first common key only.

    ``t`` differing bits over ``t + 2`` blocks leave at least two clean ones: the key is the first two clean blocks. Above 8 bits
    the blocks get too narrow for pairs, and the key is the first clean one of ``t + 1``.
    """
    full = (1 << 64) - 1
    if t <= 8:
        blocks = _split_bits(full, t + 2)
        masks, earlier = [], []
        for i in range(len(blocks)):
            for j in range(i + 1, len(blocks)):
                masks.append(blocks[i] | blocks[j])
                earlier.append(sum(1 << k for k in range(j) if k != i))
        return blocks, masks, earlier
    blocks = _split_bits(full, t + 1)
    return blocks, blocks, [(1 << k) - 1 for k in range(len(blocks))]


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(_signed(v)) for v in values])


def _first_common(x: Column, idx: Column, blocks: list[int], earlier: list[int]) -> Column:
    """All earlier blocks differ. The blocks that differ are gathered once, so that the condition does not grow with the number of keys."""
    dirty = F.lit(0).cast("bigint")
    for k, m in enumerate(blocks):
        dirty = dirty.bitwiseOR(F.when(x.bitwiseAND(F.lit(_signed(m))) != 0, F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint"))
    need = F.get(_longs(earlier), idx)
    return dirty.bitwiseAND(need) == need


def hamming_pairs(nodes: DataFrame, threshold: int = 6, *, node: str = "node", h: str = "h", also: Column | None = None,
                  hot_key: int = HOT_KEY, chunk: int = CHUNK) -> DataFrame:
    """``a, b, dist``: every pair of nodes whose hashes differ in at most ``threshold`` bits, once each.

    ``nodes`` should hold distinct hashes. Rows meet on block keys by equi-join; the distance is part of the join condition, so
    candidates are never written out. A key shared by very many rows is first refined by further blocks of its remaining bits
    (again exact by the pigeonhole argument); what is still hot is cut into chunks that meet pair by pair in separate tasks.
    ``also`` is an extra condition over the sides ``l`` and ``r``.
    """
    blocks, masks, earlier = _block_masks(threshold)
    subs = [_split_bits(((1 << 64) - 1) & ~m, threshold + 1) for m in masks]
    mask_col, sub_col = _longs(masks), F.array(*[_longs(row) for row in subs])
    base = nodes.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))))
    base = base.withColumn("_v", F.col(h).bitwiseAND(F.get(mask_col, F.col("_k")))).withColumn("_s", F.lit(-1)).withColumn("_sv", F.lit(0).cast("bigint"))
    hot = base.groupBy("_k", "_v").count().where(F.col("count") > hot_key).select("_k", "_v")
    x = F.col(f"l.{h}").bitwiseXOR(F.col(f"r.{h}"))
    near = (F.bit_count(x) <= threshold) & _first_common(x, F.col("l._k"), blocks, earlier)
    if also is not None:
        near = near & also

    def pairs(left: DataFrame, keys: list[str], extra: Column) -> DataFrame:
        cond = near & extra
        for k in keys:
            cond = cond & (F.col(f"l.{k}") == F.col(f"r.{k}"))
        return left.alias("l").join(merged(left.alias("r")), cond).select(F.col(f"l.{node}").alias("a"), F.col(f"r.{node}").alias("b"), F.bit_count(x).alias("dist"))

    smaller = F.col(f"l.{node}") < F.col(f"r.{node}")
    cold = base.join(merged(hot), ["_k", "_v"], "left_anti")
    out = pairs(cold, ["_k", "_v"], smaller)
    if not hot.limit(1).count():
        return out
    fine = (base.join(merged(hot), ["_k", "_v"], "left_semi").withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(threshold))))
            .withColumn("_sv", F.col(h).bitwiseAND(F.get(F.get(sub_col, F.col("_k")), F.col("_s")))))
    first_sub = F.lit(True)
    for s in range(threshold):
        first_sub = first_sub & ((F.col("l._s") <= s) | (x.bitwiseAND(F.get(F.get(sub_col, F.col("l._k")), F.lit(s))) != 0))
    keys = ["_k", "_v", "_s", "_sv"]
    sizes = fine.groupBy(*keys).count()
    sized = fine.join(merged(sizes), keys)
    out = out.unionByName(pairs(sized.where(F.col("count") <= hot_key), keys, smaller & first_sub))
    chunks = F.ceil(F.col("count") / chunk).cast("int")
    own = sized.where(F.col("count") > hot_key).withColumn("_c", F.pmod(F.xxhash64(node), chunks).cast("int"))
    # every unordered pair of chunks is one small key; a row joins the keys of all chunks with its own
    meet = own.withColumn("_o", F.explode(F.sequence(F.lit(0), chunks - 1)))
    meet = meet.withColumn("_lo", F.least("_c", "_o")).withColumn("_hi", F.greatest("_c", "_o"))
    owner = smaller & ((F.col("l._c") != F.col("r._c")) | (F.col("l._lo") == F.col("l._hi")))
    return out.unionByName(pairs(meet, [*keys, "_lo", "_hi"], owner & first_sub))


def cluster_similar(df: DataFrame, threshold: int = 6, *, id_: str = "id", h: str = "h", w: str = "w", ht: str = "ht", size: str = "sz",
                    **pair_options) -> DataFrame:
    """``id, similar_to, dist``: members of near-duplicate clusters and the representative each links to.

    Rows with one hash and one shape class are the same node, however many they are. Shape classes are steps of the allowed
    aspect difference, so two rows of a class always agree and neighbouring classes need only their extreme values.
    """
    rows = df.where(informative_hash(h)).withColumn("_a", aspect_value(w, ht))
    rows = rows.withColumn("_class", F.coalesce(F.floor(F.col("_a") / ASPECT_STEP), F.lit(-1)))
    rows = rows.withColumn("_node", F.struct(F.col(h).alias("h"), F.col("_class").alias("c")))  # exact: a hash of the pair could merge strangers
    nodes = rows.groupBy("_node", h, "_class").agg(F.min("_a").alias("lo"), F.max("_a").alias("hi"))

    def shapes(a, b):
        """Some pair of the two nodes agrees in shape."""
        return ((F.col(f"{a}._class") == -1) | (F.col(f"{b}._class") == -1) | (F.col(f"{a}._class") == F.col(f"{b}._class"))
                | ((F.col(f"{a}.lo") - F.col(f"{b}.hi") < ASPECT_STEP) & (F.col(f"{b}.lo") - F.col(f"{a}.hi") < ASPECT_STEP)))

    # one hash in several shape classes: at most a few dozen classes per hash
    same = (nodes.alias("l").join(merged(nodes.alias("r")), (F.col(f"l.{h}") == F.col(f"r.{h}")) & (F.col("l._class") < F.col("r._class")) & shapes("l", "r"))
            .select(F.col("l._node").alias("a"), F.col("r._node").alias("b")))
    # distinct hashes meet once; their shape classes are attached afterwards
    by_hash = nodes.select(h).distinct().withColumn("node", F.col(h))
    hp = hamming_pairs(by_hash, threshold, h=h, **pair_options).select(F.col("a").alias("ha"), F.col("b").alias("hb"))
    cross = (hp.join(merged(nodes.alias("l")), F.col("ha") == F.col(f"l.{h}")).join(merged(nodes.alias("r")), F.col("hb") == F.col(f"r.{h}"))
             .where(shapes("l", "r")).select(F.col("l._node").alias("a"), F.col("r._node").alias("b")))
    comp = connected_components(same.unionByName(cross), "a", "b")
    member = rows.join(merged(comp), F.col("_node") == F.col("node"), "left").withColumn("_comp", F.coalesce("component", "_node"))
    pixels = F.col(w) * F.col(ht)
    # most pixels, then most bytes, then first
    rep = member.groupBy("_comp").agg(F.max_by(F.struct(F.col(id_).alias("rid"), F.col(h).alias("rh")),
                                               F.struct(pixels, F.col(size), -F.col(id_))).alias("rep"), F.count("*").alias("n"))
    out = member.join(merged(rep.where("n > 1")), "_comp").where(F.col(id_) != F.col("rep.rid"))
    return out.select(F.col(id_), F.col("rep.rid").alias("similar_to"), hamming64(h, F.col("rep.rh")).alias("dist"))
