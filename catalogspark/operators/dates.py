"""Capture-date recovery: collect evidence per asset, let agreeing evidence support each other, decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import civil
from ..functions import evidence as ev
from ..functions.text import alower, col, dirname
from .ranking import stage

REVIEW_BELOW = 0.55
CLOSE_CALL_MARGIN = 0.70
ARBITER_WEIGHT = 0.30
SCORED = ("struct<src:int,secs:bigint,prec:int,base:double,weight:double,raw:string,note:string,idx:int,day:bigint,ym:int,fam:int,"
          "ub:boolean,support:double>")
_FIELDS = (*ev.FACTS, "idx", "day", "ym", "fam", "ub")


def union_candidates(df: DataFrame, now: int, min_year: int = 1900, *, meta=None, stem="stem", dirs="dirs", mtime="mtime", btime=None,
                     bulk=None, extra=None, named: str | None = None) -> DataFrame:
    """Add ``candidates``: all evidence of one asset in its fixed order, weighed. ``named`` is a column of name dates found before."""
    df = df.withColumn("_named", F.col(named)) if named else ev.with_name_dates(df, F.array(col(stem)), False, "_named", now)
    df = ev.with_name_dates(df, F.slice(col(dirs), F.lit(1), F.lit(4)), True, "_foldered")
    parts = []
    if meta is not None:
        df, parts = ev.with_metadata_dates(df, meta, "_embedded"), ["_embedded"]
    parts += ["_named", "_foldered", ev.file_time_dates(col(mtime), F.lit(0) if btime is None else col(btime),
                                                        F.lit(False) if bulk is None else col(bulk))]
    df = df.withColumn("_all", F.concat(*parts)).withColumn("candidates", ev.weigh("_all", now, min_year))
    if extra is not None:
        df = df.withColumn("candidates", F.concat("candidates", extra))
    return stage(df.drop("_embedded", "_named", "_foldered", "_all"), "evidence")


def manual_candidate(value) -> Column:
    """The user's own date as one more candidate; an empty list without one."""
    when = civil.parse_manual(value)
    c = ev.candidate("manual", when, col(value), weight=F.when(when.isNotNull(), 1.0).otherwise(0.0))
    return F.when(col(value).isNotNull(), F.array(c)).otherwise(F.array().cast(f"array<{ev.CANDIDATE}>"))


def _rank_key(x) -> Column:
    return F.struct(F.round(x["support"], 9).alias("s"), x["prec"].alias("p"), x["base"].alias("b"), (-x["idx"]).alias("i"), x.alias("c"))


def rank_candidates(df: DataFrame) -> DataFrame:
    """Add ``ranked``: usable candidates by support, then precision, base reliability and order of collection."""
    def scored(x):
        support = F.aggregate("_live", x["weight"], lambda s, y: s + F.when(y["idx"] == x["idx"], 0.0).otherwise(
            y["weight"] * ev.agree(x, y) * ev.independence(x, y)))
        return F.struct(*[x[f].alias(f) for f in _FIELDS], support.alias("support")).cast(SCORED)

    live = F.filter(F.transform("candidates", lambda c, i: ev.with_facts(c, i)), lambda c: c["weight"] > 0)
    df = df.withColumn("_live", live).withColumn("_scored", F.transform("_live", scored))
    keyed = F.sort_array(F.transform("_scored", _rank_key), asc=False)
    return stage(df.withColumn("ranked", F.transform(keyed, lambda k: k["c"])).drop("_live", "_scored"), "ranked")


def _pick_winner(ranked: Column) -> Column:
    top = F.get(ranked, F.lit(0))
    earlier = F.filter(ranked, lambda x: ~x["ub"] & (x["weight"] >= 0.25) & (x["secs"] <= top["secs"] + ev.SLACK))
    manual = F.filter(ranked, lambda x: x["src"] == ev.SRC["manual"])
    return (F.when(F.size(manual) > 0, F.element_at(manual, -1))
            .when(top["ub"] & (F.size(earlier) > 0), F.get(earlier, F.lit(0)))
            .otherwise(top))


def distinct_alternatives(ranked: Column, winner: Column, limit: int = 4) -> Column:
    """The winner and up to three contradicting candidates that also disagree among themselves."""
    start = F.array(winner).cast(f"array<{SCORED}>")
    return F.aggregate(ranked, start, lambda acc, k: F.when(
        (F.size(acc) < limit) & (k["idx"] != winner["idx"]) & ev.contradicts(winner, k)
        & F.forall(acc, lambda a: ev.agree(a, k) < 0.3), F.concat(acc, F.array(k))).otherwise(acc))


def borrow_detail(ranked: Column, winner: Column) -> Column:
    """The strongest finer candidate inside a coarse winner's period."""
    inside = lambda x: (F.when(winner["prec"] == civil.DAY, x["day"] == winner["day"])
                        .when(winner["prec"] == civil.MONTH, x["ym"] == winner["ym"])
                        .otherwise(F.floor(x["ym"] / 12) == F.floor(winner["ym"] / 12)))
    finer = F.filter(ranked, lambda x: (x["idx"] != winner["idx"]) & (x["weight"] >= 0.25) & (x["prec"] > winner["prec"]) & inside(x))
    best = F.array_max(F.transform(finer, lambda x: F.struct(x["weight"].alias("w"), (-x["idx"]).alias("i"), x.alias("c"))))
    return F.when(winner["prec"] < civil.MINUTE, best["c"])


def _with_outcome(df: DataFrame, review_below: float) -> DataFrame:
    """Fill the decision columns from ``winner`` and ``ranked``."""
    w = F.col("winner")
    df = df.withColumn("detail", borrow_detail(F.col("ranked"), w))
    against = F.array_max(F.transform(F.filter("ranked", lambda k: (k["idx"] != w["idx"]) & ev.contradicts(w, k)), lambda k: k["support"]))
    df = df.withColumn("margin", F.when(w.isNotNull(), w["support"] / (w["support"] + F.coalesce(against, F.lit(0.0)))))
    source = F.when(w.isNull(), "none").otherwise(F.concat(
        ev.source_id(w["src"]),
        F.when(F.col("detail").isNull(), "").otherwise(F.concat(
            F.when(w["prec"] == civil.DAY, "+time:").otherwise("+detail:"), ev.source_id(F.col("detail")["src"])))))
    manual = F.coalesce(w["src"] == ev.SRC["manual"], F.lit(False))
    conf = F.when(w.isNull(), 0.0).when(manual, 1.0).otherwise(F.col("margin") * F.least(F.lit(1.0), w["support"]))
    return (df.withColumn("date_secs", F.coalesce(F.col("detail")["secs"], w["secs"]))
            .withColumn("date_prec", F.coalesce(F.col("detail")["prec"], w["prec"], F.lit(0)))
            .withColumn("date_source", source).withColumn("date_conf", conf)
            .withColumn("margin", F.coalesce("margin", F.lit(1.0)))
            .withColumn("needs_review", F.when(manual, False).otherwise(F.col("date_conf") < review_below))
            .withColumn("date_decider", F.when(manual, "manual").otherwise("rules")))


def decide_dates(df: DataFrame, review_below: float = REVIEW_BELOW) -> DataFrame:
    """Decide every row from its ``candidates``. No shuffle: all evidence travels with its asset."""
    df = rank_candidates(df).withColumn("winner", _pick_winner(F.col("ranked")))
    df = df.withColumn("alternatives", F.when(F.col("winner").isNotNull(), distinct_alternatives(F.col("ranked"), F.col("winner"))))
    return stage(_with_outcome(df, review_below), "decided")


def blend_arbiter(decided: DataFrame, answers: DataFrame, key: str = "id", weight: float = ARBITER_WEIGHT,
                  close_call: float = CLOSE_CALL_MARGIN, review_below: float = REVIEW_BELOW) -> DataFrame:
    """Mix a second opinion (``answers: key, probs array<double>``) into close calls; other rows pass unchanged."""
    df = decided.join(answers.select(F.col(key), F.col("probs").alias("_p")), key, "left")
    asked = ((F.size("alternatives") >= 2) & (F.col("margin") < close_call) & (F.col("date_decider") == "rules")
             & (F.size("_p") == F.size("alternatives")))
    total = F.aggregate("alternatives", F.lit(0.0), lambda s, a: s + a["support"])
    final = F.transform(F.arrays_zip(F.col("alternatives").alias("a"), F.col("_p").alias("p")), lambda x, i: F.struct(
        ((1 - weight) * x["a"]["support"] / total + weight * x["p"]).alias("f"), (-i).alias("i"), x["a"].alias("c")))
    df = df.withColumn("_on", F.coalesce(asked, F.lit(False))).withColumn("_final", F.when(F.col("_on"), final))
    df = df.withColumn("_best", F.array_max("_final"))
    df = df.withColumn("winner", F.coalesce(F.col("_best")["c"], F.col("winner")))
    df = df.withColumn("_old", F.struct("date_secs", "margin", "date_conf", "date_source", "needs_review", "date_decider", "date_prec"))
    df = _with_outcome(df, review_below)
    second = F.array_max(F.transform(F.filter("_final", lambda x: x["i"] != F.col("_best")["i"]), lambda x: x["f"]))
    df = df.withColumn("_m", F.col("_best")["f"] / (F.col("_best")["f"] + second))
    df = df.withColumn("_c", F.col("_m") * F.least(F.lit(1.0), F.col("winner")["support"]))
    new = {"margin": F.col("_m"), "date_conf": F.col("_c"), "needs_review": F.col("_c") < review_below, "date_decider": F.lit("rules+arbiter")}
    for c in ("date_secs", "date_prec", "date_source", "margin", "date_conf", "needs_review", "date_decider"):
        df = df.withColumn(c, F.when(F.col("_on"), new.get(c, F.col(c))).otherwise(F.col("_old")[c]))
    before = F.col("_old")["date_secs"]
    return df.withColumn("changed", F.col("_on") & ~F.col("date_secs").eqNullSafe(before)).drop("_p", "_on", "_final", "_best", "_old", "_m", "_c")


def option_text(cand: Column, all_cands: Column) -> Column:
    """Self-describing text of one date option, naming up to two agreeing sources of other families."""
    others = F.filter(all_cands, lambda o: (o["idx"] != cand["idx"]) & (o["fam"] != cand["fam"]) & (ev.agree(cand, o) >= 0.5))
    names = F.array_join(F.transform(F.slice(F.array_sort(others, lambda a, b: a["idx"] - b["idx"]), 1, 2), lambda o: ev.source_label(o["src"])), ", ")
    return F.concat(civil.civil_pretty(cand["secs"], cand["prec"]), F.lit(" from "), ev.source_label(cand["src"]),
                    F.when(names != "", F.concat(F.lit("; matches "), names)).otherwise(""),
                    F.when(cand["note"].isNotNull(), F.concat(F.lit(" ("), F.substring_index(cand["note"], "; ", 1), F.lit(")"))).otherwise(""))


# ---- evidence that needs other assets

def evidence_days(candidates: Column) -> Column:
    """Distinct day numbers of usable day-or-finer evidence other than file times."""
    usable = F.filter(candidates, lambda c: (c["weight"] > 0) & (c["prec"] >= civil.DAY) & ~ev.is_file_time(c["src"]))
    return F.array_distinct(F.transform(usable, lambda c: civil.day_number(c["secs"])))


def bulk_copy_groups(df: DataFrame, days: str = "days", path: str = "src_path", mtime: str = "mtime") -> DataFrame:
    """Per (folder, minute of mtime): files, distinct evidence days and whether this was a bulk copy."""
    # a file with several evidence days is several rows here and counts with its first
    keyed = df.select(dirname(path).alias("dir"), F.floor(F.col(mtime) / 60).alias("minute"), F.posexplode_outer(days).alias("nth", "day"))
    first = F.coalesce("nth", F.lit(0)) == 0
    return (keyed.groupBy("dir", "minute").agg(F.count(F.when(first, 1)).alias("files"), F.count_distinct("day").alias("days"))
            .withColumn("bulk", ((F.col("files") >= 5) & (F.col("days") >= 2)) | (F.col("files") >= 20)))


def flag_bulk(df: DataFrame, days: str = "days", path: str = "src_path", mtime: str = "mtime") -> DataFrame:
    """Add ``bulk`` to every asset. "Two or more days" only needs the smallest and largest day, so it combines map-side."""
    keyed = df.withColumn("_dir", dirname(path)).withColumn("_minute", F.floor(F.col(mtime) / 60))
    groups = keyed.groupBy("_dir", "_minute").agg(F.count("*").alias("_files"), F.min(F.array_min(days)).alias("_lo"), F.max(F.array_max(days)).alias("_hi"))
    bulk = groups.where(((F.col("_files") >= 5) & (F.col("_lo") < F.col("_hi"))) | (F.col("_files") >= 20)).select("_dir", "_minute", F.lit(True).alias("_b"))
    return (keyed.join(bulk, ["_dir", "_minute"], "left").withColumn("bulk", F.coalesce("_b", F.lit(False))).drop("_dir", "_minute", "_b"))


SEQUENCE = r"^(.*?)([0-9]{3,6})$"


def sequence_neighbors(df: DataFrame, reach: int = 20, *, path: str = "src_path", stem: str = "stem", strong: str = "strong",
                       secs: str = "date_secs") -> DataFrame:
    """For weak assets of a numbered sequence: the nearest strong number below and above, within ``reach``.

    Anchors are first reduced to one per number, then to one short list per bucket of ``reach + 1`` numbers, so the look-up is an
    equi-join whose right side has one bounded row per key, however many files a folder holds.
    """
    num = F.regexp_extract(F.col(stem), SEQUENCE, 2).try_cast("bigint")
    seq = (df.withColumn("_dir", dirname(path)).withColumn("_prefix", alower(F.regexp_extract(F.col(stem), SEQUENCE, 1)))
           .withColumn("num", num))
    width = reach + 1
    anchors = (seq.where(F.col(strong) & F.col("num").isNotNull()).groupBy("_dir", "_prefix", "num").agg(F.min_by(secs, "id").alias("secs"))
               .withColumn("_bucket", F.explode(F.array(*[F.floor(F.col("num") / width) + k for k in (-1, 0, 1)])))
               .groupBy("_dir", "_prefix", "_bucket").agg(F.collect_list(F.struct("num", "secs")).alias("_near")))
    weak = seq.where(~F.col(strong) & F.col("num").isNotNull()).withColumn("_bucket", F.floor(F.col("num") / width))
    hit = weak.join(anchors, ["_dir", "_prefix", "_bucket"], "inner")
    lower = F.array_max(F.filter("_near", lambda a: (a["num"] < F.col("num")) & (F.col("num") - a["num"] <= reach)))
    upper = F.array_min(F.filter("_near", lambda a: (a["num"] > F.col("num")) & (a["num"] - F.col("num") <= reach)))
    return (hit.withColumn("prev", lower).withColumn("next", upper).where(F.col("prev").isNotNull() | F.col("next").isNotNull())
            .drop("_dir", "_prefix", "_bucket", "_near"))


def neighbor_candidate(prev="prev", next_="next") -> Column:
    """Evidence from the neighbours: the previous day when both sides are at most three days apart, else the one known side."""
    p, n = F.col(prev), F.col(next_)
    both = p.isNotNull() & n.isNotNull()
    gap = F.abs(civil.day_number(p["secs"]) - civil.day_number(n["secs"]))
    base_day = civil.day_number(F.coalesce(p["secs"], n["secs"])) * ev.DAY_SECONDS
    weight = F.when(both, 0.60).otherwise(0.40)
    raw = F.when(both, F.concat(F.lit("between #"), p["num"].cast("string"), F.lit(" and #"), n["num"].cast("string"))).otherwise(
        F.concat(F.lit("next to #"), F.coalesce(p["num"], n["num"]).cast("string")))
    c = F.struct(F.lit(ev.SRC["neighbor"]).alias("src"), base_day.alias("secs"), F.lit(civil.DAY).alias("prec"), weight.alias("base"),
                 weight.alias("weight"), raw.alias("raw"), F.lit(None).cast("string").alias("note")).cast(ev.CANDIDATE)
    return F.when(~both | (gap <= 3), c)


def is_strong() -> Column:
    return ~F.col("needs_review") & (F.col("date_conf") >= 0.8) & ~F.col("date_prec").isin(civil.MONTH, civil.YEAR)


def neighbor_redate(decided: DataFrame, review_below: float = REVIEW_BELOW, reach: int = 20) -> DataFrame:
    """Re-decide weak assets of numbered sequences with their neighbours' day as one more candidate; the changed rows only."""
    found = sequence_neighbors(decided.withColumn("strong", is_strong()), reach)
    again = (found.withColumn("_c", neighbor_candidate()).where(F.col("_c").isNotNull())
             .withColumn("candidates", F.concat("candidates", F.array("_c"))))
    keep = [c for c in again.columns if c not in ("ranked", "winner", "alternatives", "detail", "margin", "date_secs", "date_prec", "date_source",
                                                  "date_conf", "needs_review", "date_decider", "strong", "_c")]
    return decide_dates(again.select(*keep), review_below)


def confirm_dates(df: DataFrame, choices: DataFrame) -> DataFrame:
    """Dates chosen by the user (``id, value, prec``; ``at`` orders repeats) become certain."""
    last = choices.groupBy("id").agg(F.max_by(F.struct("value", "prec"), "at").alias("_u"))
    df = df.join(last, "id", "left")
    u = F.col("_u")
    return (df.withColumn("date_value", F.coalesce(u["value"], F.col("date_value")))
            .withColumn("date_prec", F.coalesce(u["prec"], F.col("date_prec")))
            .withColumn("manual_date", F.when(u.isNotNull(), F.concat(u["value"], F.lit("|"), u["prec"])))
            .withColumn("date_source", F.when(u.isNotNull(), "you").otherwise(F.lit("rules")))
            .withColumn("date_conf", F.when(u.isNotNull(), 1.0).otherwise(F.col("date_conf")))
            .withColumn("needs_review", F.when(u.isNotNull(), False).otherwise(F.col("needs_review"))).drop("_u"))


def accept_guesses(df: DataFrame, min_conf: float = 0.0) -> DataFrame:
    """The uncertain dated rows a bulk confirmation would settle."""
    return df.where(F.col("needs_review") & F.col("date_value").isNotNull() & (F.col("date_conf") >= min_conf))
