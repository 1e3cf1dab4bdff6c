"""Embedding-to-vocabulary tagging: scores, calibrated confidences and the tags to keep."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tags import SEARCHABLE
from ..functions.text import alower, col
from .ranking import stage

LOGIT_SCALE = 100.0  # fixed value: softmax temperature of the embedding model


def presence_scale(category: str) -> float:
    """The probability a category must hold to count as fully present."""
    return 0.6 if category == "composition" else 0.3


def prompt_ensemble(df: DataFrame, key: str, vec: str) -> DataFrame:
    """``key, vec``: mean of several vectors per key, scaled to unit length. Means combine map-side per dimension."""
    dims = df.select(key, F.posexplode(vec).alias("d", "x")).groupBy(key, "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    # one entry per dimension: the list has a fixed length
    v = dims.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("v")).select(key, F.transform("v", lambda s: s["m"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return v.withColumn("_n", norm).select(key, F.transform("v", lambda x: x / F.col("_n")).alias("vec"))


@dataclass(frozen=True)
class Vocabulary:
    """A hand-edited tag list with its vectors. It travels with the task closures as arrays; plans do not grow with it."""

    tags: list[str]
    categories: list[str]
    vectors: np.ndarray

    @classmethod
    def load(cls, df: DataFrame) -> Vocabulary:
        rows = df.select("tag", "category", "pos", "vec").collect()
        rows.sort(key=lambda r: r["pos"])
        return cls([r["tag"] for r in rows], [r["category"] for r in rows], np.array([r["vec"] for r in rows], dtype=np.float64))

    @property
    def names(self) -> list[str]:
        """Categories in order of first appearance."""
        return list(dict.fromkeys(self.categories))

    @property
    def index(self) -> np.ndarray:
        """The number of each tag's category."""
        at = {n: i for i, n in enumerate(self.names)}
        return np.array([at[c] for c in self.categories], dtype=np.int64)


def _per_vector(kind, fn):
    """A UDF that gives ``fn`` the known vectors of a batch as one matrix; rows without a vector get null."""

    @F.pandas_udf(kind)
    def run(v: pd.Series) -> pd.Series:
        return _filled(v, lambda known: fn(np.stack(v[known].to_numpy()).astype(np.float64)))

    return run


def _filled(v: pd.Series, fn) -> pd.Series:
    """``fn(known)`` gives a value for each known entry of ``v``; the others are null."""
    known = v.notna().to_numpy()
    out: list = [None] * len(v)
    if known.any():
        for i, x in zip(np.flatnonzero(known).tolist(), fn(known), strict=True):
            out[i] = x
    return pd.Series(out, index=v.index, dtype=object)


def cosines(vec, matrix: np.ndarray) -> Column:
    """Dot products of each row's vector with a fixed matrix, as ``array<double>`` (Arrow batches, one matrix product each); null without a vector."""
    fixed = np.ascontiguousarray(matrix, dtype=np.float64).T

    return _per_vector(T.ArrayType(T.DoubleType()), lambda m: list(m @ fixed))(col(vec))


def score_vocab(df: DataFrame, vec: str, vocab: Vocabulary) -> DataFrame:
    """Add ``logits``: 100 x cosine to every tag, in vocabulary order."""
    return stage(df.withColumn("logits", F.transform(cosines(vec, vocab.vectors), lambda c: c * LOGIT_SCALE)), "logits")


def category_sums(logits: np.ndarray, index: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Log of the summed exponentials over all tags, and per category."""
    top = logits.max(axis=1, keepdims=True)
    e = np.exp(logits - top)
    each = np.stack([e[:, index == k].sum(axis=1) for k in range(n)], axis=1)
    return np.log(e.sum(axis=1)) + top[:, 0], np.log(each) + top


def log_sum_exp(df: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Add ``lse`` over the vocabulary and ``cat_lse`` per category (in the order of ``vocab.names``)."""
    index, n = vocab.index, len(vocab.names)

    def sums(m: np.ndarray) -> list:
        whole, each = category_sums(m, index, n)
        return [{"lse": a, "cat_lse": b} for a, b in zip(whole.tolist(), each.tolist(), strict=True)]

    kind = T.StructType().add("lse", "double").add("cat_lse", T.ArrayType(T.DoubleType()))
    # a struct result comes as a frame, so the pair travels in a list of one
    both = F.get(_per_vector(T.ArrayType(kind), lambda m: [[x] for x in sums(m)])(F.col("logits")), F.lit(0))
    return stage(df.withColumn("_b", both).withColumn("lse", F.col("_b.lse")).withColumn("cat_lse", F.col("_b.cat_lse")).drop("_b"), "sums")


# fixed values: from which share, mass and confidence a tag may be picked
MIN_MEDIUM_SHARE, MIN_MASS, MIN_SHARE, MIN_CONF = 0.3, 0.08, 0.25, 0.12
SCORE = "array<struct<tag:string,cat:string,share:double,mass:double,conf:double,logit:double,i:int>>"


def tag_scores(df: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Add ``scored``: the tags that may be picked, with their share inside the category, the category's mass and the confidence."""
    index, n, tags, cats = vocab.index, len(vocab.names), vocab.tags, vocab.categories
    scale, medium = np.array([presence_scale(c) for c in cats]), np.array([c == "medium" for c in cats])

    def scores(m: np.ndarray) -> list:
        whole, each = category_sums(m, index, n)
        share, mass = np.exp(m - each[:, index]), np.exp(each - whole[:, None])[:, index]
        conf = np.where(medium, share, share * np.minimum(1.0, mass / scale))
        good = np.where(medium, share >= MIN_MEDIUM_SHARE, (mass >= MIN_MASS) & (share >= MIN_SHARE) & (conf >= MIN_CONF))
        return [[{"tag": tags[i], "cat": cats[i], "share": share[r, i], "mass": mass[r, i], "conf": conf[r, i], "logit": m[r, i], "i": i} for i in np.flatnonzero(good[r]).tolist()] for r in range(len(m))]

    return stage(df.withColumn("scored", _per_vector(SCORE, scores)(F.col("logits"))), "scores")


def pick_tags(df: DataFrame, max_tags: int = 8) -> DataFrame:
    """Add ``picked``: of the scored tags, limits per category, then the best few. Works on one row at a time, so nothing is shuffled.

    Fixed values: the limits (medium and scene 1, people 3, others 2).
    """
    df = df.withColumn("_good", F.col("scored"))
    limit = lambda t: F.when(t["cat"].isin("medium", "scene"), 1).when(t["cat"] == "people", 3).otherwise(2)
    ahead = lambda t: F.size(F.filter("_good", lambda o: (o["cat"] == t["cat"]) & ((o["logit"] > t["logit"]) | ((o["logit"] == t["logit"]) & (o["i"] < t["i"])))))
    kept = F.filter("_good", lambda t: ahead(t) < limit(t))
    order = F.array_sort(kept, lambda a, b: F.when(a["conf"] != b["conf"], F.when(a["conf"] > b["conf"], -1).otherwise(1)).when(
        a["logit"] != b["logit"], F.when(a["logit"] > b["logit"], -1).otherwise(1)).otherwise(F.when(a["i"] < b["i"], -1).otherwise(1)))
    return df.withColumn("picked", F.slice(F.transform(order, lambda t: F.struct(t["tag"].alias("tag"), t["conf"].alias("conf"))), F.lit(1), F.lit(max_tags))).drop("_good")


def tag_assets(df: DataFrame, vec: str, vocab: Vocabulary, max_tags: int = 8) -> DataFrame:
    return pick_tags(tag_scores(log_sum_exp(score_vocab(df, vec, vocab), vocab), vocab), max_tags)


def nearest_tag(df: DataFrame, vec: str, vocab: Vocabulary, name: str | None = None) -> DataFrame:
    """Add ``near`` (tag, category, cos): the closest tag; an exact tag name short-cuts the search."""
    matrix, tags, cats = np.ascontiguousarray(vocab.vectors, dtype=np.float64).T, vocab.tags, vocab.categories
    known = {t.lower(): i for i, t in reversed(list(enumerate(tags)))}

    @F.pandas_udf("array<struct<tag:string,category:string,cos:double>>")
    def closest(v: pd.Series, names: pd.Series) -> pd.Series:
        def best(has: np.ndarray) -> list:
            c = np.stack(v[has].to_numpy()).astype(np.float64) @ matrix
            at = [known.get(n, b) for n, b in zip(names[has], c.argmax(axis=1).tolist(), strict=True)]
            return [[{"tag": tags[i], "category": cats[i], "cos": c[r, i]}] for r, i in enumerate(at)]

        return _filled(v, best)

    wanted = alower(name) if name is not None else F.lit(None).cast("string")
    return df.withColumn("near", F.get(closest(col(vec), wanted), F.lit(0)))


def phrase_confidence(df: DataFrame, vec: str, vocab: Vocabulary, query: np.ndarray, category: str, same: int | None = None) -> DataFrame:
    """Add ``p``: how sure the picture shows a phrase that competes inside its category.

    A known tag uses its own confidence; a new phrase joins the sums. Needs ``lse`` and ``cat_lse``.
    """
    ci = vocab.names.index(category)
    lq = F.get(cosines(vec, np.array([query])), F.lit(0)) * LOGIT_SCALE
    df = df.withColumn("_q", lq).withColumn("_all", F.col("lse")).withColumn("_cat", F.get("cat_lse", F.lit(ci)))
    m = F.greatest("_q", "_all", "_cat")
    eq, ea, ec = (F.exp(F.col(c) - m) for c in ("_q", "_all", "_cat"))
    if same is None:
        share, mass = eq / (ec + eq), (ec + eq) / (ea + eq)
    else:
        share, mass = F.exp(F.col("_q") - F.col("_cat")), F.exp(F.col("_cat") - F.col("_all"))
    p = share if category == "medium" else share * F.least(F.lit(1.0), mass / presence_scale(category))
    return df.withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))).drop("_q", "_all", "_cat")


def similar_to(df: DataFrame, vec: str, target: np.ndarray, threshold: float = 0.80) -> DataFrame:
    """Rows that look like the target vector; ``score`` is three times the cosine."""
    return df.withColumn("cos", F.get(cosines(vec, np.array([target])), F.lit(0))).where(F.col("cos") >= threshold).withColumn("score", F.col("cos") * 3.0)


def find_target(df: DataFrame, vec: str, wanted: str) -> np.ndarray | None:
    """The vector of the asset named by id, or the first (by id) whose name contains the text."""
    w = wanted.lstrip("#")
    row = df.where((F.col("id").cast("string") == w) | F.contains(alower("name"), F.lit(w))).orderBy("id").select(vec).first()
    return None if row is None else np.array(row[0], dtype=np.float64)


def tag_coverage(df: DataFrame) -> DataFrame:
    """Nine counters over tag rows (``tagged, stale, user_edited, best`` and what the files carry)."""
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return df.agg(F.count("*").alias("total"), n(~F.col("tagged") & ~F.col("user_edited")).alias("untagged"),
                  n((F.col("tagged") | F.col("user_edited")) & (F.col("best") < SEARCHABLE)).alias("weak"),
                  n(F.col("stale") & ~F.col("user_edited")).alias("stale"), n(F.col("user_edited")).alias("edited"),
                  n(~F.col("has_date")).alias("no_date"), n(~F.col("has_kw")).alias("no_keywords"), n(~F.col("has_desc")).alias("no_description"),
                  n(~F.col("has_place")).alias("no_place"), n(F.col("gen_tool").isNotNull()).alias("generated"))


TAG_PANEL = {
    "untagged": lambda: ~F.col("tagged") & ~F.col("user_edited"),
    "weak": lambda: (F.col("tagged") | F.col("user_edited")) & (F.col("best") < SEARCHABLE),
    "stale": lambda: F.col("stale") & ~F.col("user_edited"),
    "edited": lambda: F.col("user_edited"),
    "no_date": lambda: ~F.col("has_date"),
    "no_keywords": lambda: ~F.col("has_kw"),
    "no_description": lambda: ~F.col("has_desc"),
    "no_place": lambda: ~F.col("has_place"),
    "generated": lambda: F.col("gen_tool").isNotNull(),
}


def smart_update(df: DataFrame, current: str, answers: DataFrame | None = None) -> DataFrame:
    """Which assets are worth analysing again, and how much. Needs ``model, best, sure, tiny, user_tags``.

    Close calls (well tagged by another model) take the second opinion's probability where there is one.
    """
    if answers is not None:
        df = df.join(answers.select("id", F.col("p").alias("_p")), "id", "left")
    else:
        df = df.withColumn("_p", F.lit(None).cast("double"))
    fresh, other = F.col("model").isNull(), F.col("model") != current
    close = other & (F.col("best") >= 0.5) & (F.col("sure") >= 3) & ~F.col("tiny")
    few = (F.col("sure") < 2) | (F.col("best") < SEARCHABLE)
    worth = (F.when(fresh, F.when(F.col("tiny"), 0.3).otherwise(1.0)).when(close, F.coalesce("_p", F.lit(0.5)))
             .when(other, F.when(F.col("tiny"), 0.3).otherwise(0.85)).when(few, 0.6))
    action = F.when(fresh | other, "reanalyse").when(few, "retag")
    by = F.when(close & F.col("_p").isNotNull(), "arbiter").otherwise("rules")
    out = df.where(~F.col("user_tags")).withColumn("action", action).withColumn("worth", worth).withColumn("decided_by", by)
    return out.where(F.col("action").isNotNull()).withColumn("tick", F.col("worth") >= 0.6).drop("_p")
