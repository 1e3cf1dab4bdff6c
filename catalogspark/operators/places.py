"""Places: one decision per folder from a weighted vote, applied to its assets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import placenames as pn

WEIGHTS = {"rules": 0.25, "vision": 0.60, "arbiter": 0.15}
ACCEPT = 0.50


def decide_places(folders: DataFrame, vision: DataFrame | None = None, arbiter: DataFrame | None = None, weights: dict = WEIGHTS,
                  accept: float = ACCEPT, key: str = "dir") -> DataFrame:
    """``dir, place, place_conf, place_source`` from ``dir, candidates``.

    ``vision: dir, answer, conf`` names one place in free text; ``arbiter: dir, probs`` scores the candidates in order. The second
    opinion only breaks ties: a candidate needs half a vote from the rules or the vision model first.
    """
    df = folders.withColumn("_rules", pn.rules_scores("candidates"))
    none = F.lit(None)
    if vision is not None:
        df = df.join(vision.select(key, F.col("answer").alias("_ans"), F.col("conf").cast("double").alias("_vc")), key, "left")
        df = df.withColumn("_at", pn.match_answer("candidates", "_ans"))
        df = df.withColumn("_vision", F.when(F.col("_vc").isNotNull(), F.transform("candidates", lambda c, i: F.when(i == F.col("_at"), F.col("_vc")).otherwise(0.0))))
    else:
        df = df.withColumn("_vision", none.cast("array<double>"))
    if arbiter is not None:
        df = df.join(arbiter.select(key, F.col("probs").alias("_arb")), key, "left").withColumn("_arb", F.when(F.size("_arb") == F.size("candidates"), F.col("_arb")))
    else:
        df = df.withColumn("_arb", none.cast("array<double>"))
    wsum = (F.lit(weights["rules"]) + F.when(F.col("_vision").isNotNull(), weights["vision"]).otherwise(0.0) + F.when(F.col("_arb").isNotNull(), weights["arbiter"]).otherwise(0.0))

    def total(c, i):
        r, v, a = F.get("_rules", i), F.coalesce(F.get("_vision", i), F.lit(0.0)), F.coalesce(F.get("_arb", i), F.lit(0.0))
        score = (weights["rules"] * r + weights["vision"] * v + weights["arbiter"] * a) / wsum
        return F.struct(score.alias("score"), (-i).alias("i"), c.alias("c"), ((r >= 0.5) | (v >= 0.5)).alias("ok"))

    df = df.withColumn("_best", F.array_max(F.filter(F.transform("candidates", total), lambda t: t["ok"])))
    yes = F.col("_best.score") >= accept
    src = F.when(F.col("_best.c.level") < 0, "file-name").otherwise(F.concat(F.lit("folder:"), F.col("_best.c.origin")))
    return (df.withColumn("place", F.when(yes, F.col("_best.c.text"))).withColumn("place_conf", F.when(yes, F.col("_best.score")))
            .withColumn("place_source", F.when(yes, src)).drop("_rules", "_vision", "_arb", "_best", "_ans", "_vc", "_at"))


def apply_dir_place(assets: DataFrame, places: DataFrame, meta_place="meta_place", has_gps="has_gps", accept: float = ACCEPT) -> DataFrame:
    """Metadata place, else the folder's decision, else a trip-cued file name, else just the position as source.

    The folder table has one row per folder; whether it is broadcast is left to its measured size at run time.
    """
    df = assets.join(places.select("dir", "place", "place_conf", "place_source"), "dir", "left")
    named = F.get(F.filter(pn.place_candidates(F.array().cast("array<string>"), "stem"), lambda c: c["cue"] & (c["prior"] >= accept)), F.lit(0))
    df = df.withColumn("_n", F.when(F.col(meta_place).isNull() & F.col("place").isNull(), named))
    loc = F.coalesce(F.col(meta_place), F.col("place"), F.col("_n.text"))
    src = (F.when(F.col(meta_place).isNotNull(), "metadata").when(F.col("place").isNotNull(), F.col("place_source"))
           .when(F.col("_n").isNotNull(), "file-name").when(F.col(has_gps), "gps"))
    conf = F.when(F.col(meta_place).isNotNull(), 1.0).otherwise(F.coalesce("place_conf", "_n.prior", F.lit(0.0)))
    return df.withColumn("location", loc).withColumn("location_source", src).withColumn("location_conf", conf).drop("place", "place_conf", "place_source", "_n")
