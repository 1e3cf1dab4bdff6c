"""Correction proposals: rules that compare automatic tags and names with other evidence, and folding accepted ones in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import long_name, serial_name, short_prefix
from ..functions.tags import TAG, TAGS
from ..functions.text import alower, basename, ext_lower, screenshot_name, stem

# fixed values: tags that say what kind of picture it is, and tags of screen contents
ART_MEDIA = ["screenshot", "scanned document", "illustration", "anime", "cartoon", "digital art", "3d render", "painting", "drawing", "pencil sketch", "meme"]
SCREEN_TAGS = ["screenshot", "website", "app screen", "chat conversation", "code", "presentation slide", "text document", "qr code"]
KIND_TAGS = [*ART_MEDIA, "photo", "black and white photo", "old photo"]
MIN_CONFIDENCE = 0.3
PROPOSAL = "struct<field:string,action:string,current:string,proposed:string,confidence:double,source:string>"


def _proposal(field, action, current, proposed, conf, source) -> Column:
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(c(field).alias("field"), c(action).alias("action"), c(current).alias("current"), c(proposed).alias("proposed"),
                    conf.alias("confidence"), c(source).alias("source")).cast(PROPOSAL)


def propose_corrections(df: DataFrame, answers: DataFrame | None = None, decided: DataFrame | None = None, blocked: list[str] = (), sep: str = "_",
                        digits: int = 5) -> DataFrame:
    """``id`` and the proposals for it, one row each.

    Needs ``id, src_path, dest_path, tags (tag,conf), user_tags, camera, prompt, name_words (word, p = picture confidence),
    name_decided``, and ``sources`` (input images of a generated picture, whose prompt then only says what changed) where known; rows with
    user tags only get naming proposals. The rules stand in order: of two proposals for one change the earlier one is kept. ``answers: id, wrong array<struct<tag,confidence>>`` holds the rating
    model's verdicts, ``decided: id, field, current, proposed`` what the user settled before.
    """
    none = F.array().cast(f"array<{PROPOSAL}>")
    if answers is None:
        df = df.withColumn("_wrong", F.lit(None).cast("array<struct<tag:string,confidence:double>>"))
    else:
        df = df.join(answers.select("id", F.col("wrong").cast("array<struct<tag:string,confidence:double>>").alias("_wrong")), "id", "left")
    tags, prompt = F.col("tags"), alower("prompt")
    edit = F.coalesce(F.size("sources") > 0, F.lit(False)) if "sources" in df.columns else F.lit(False)
    low = lambda t: alower(t["tag"])
    auto, made = ~F.col("user_tags"), F.col("prompt").isNotNull() & (F.col("prompt") != "")
    camera = F.col("camera") & ~made
    art = F.transform(F.filter(tags, lambda t: low(t).isin(ART_MEDIA + SCREEN_TAGS)),
                      lambda t: _proposal("tag", "remove", t["tag"], "", 0.9 - 0.3 * t["conf"], "camera EXIF"))
    shot = F.array(_proposal("tag", "add", "", "screenshot", F.lit(0.85), "file name"))
    is_shot = ~camera & screenshot_name(basename("src_path")) & ~F.exists(tags, lambda t: low(t) == "screenshot")

    def judged(w):
        mine = F.get(F.filter(tags, lambda t: low(t) == alower(w["tag"])), F.lit(0))
        sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), w["confidence"] / 100.0))
        weight = 1.0 - F.when(low(mine).isin(KIND_TAGS), 0.3).otherwise(0.5) * mine["conf"]
        return F.when(mine.isNotNull() & ~F.contains(prompt, low(mine)), _proposal("tag", "remove", mine["tag"], "", F.least(F.lit(0.95), sure * weight), "prompt + rating"))

    verdicts = F.filter(F.transform("_wrong", judged), lambda p: p.isNotNull())
    screens = prompt.rlike("screen|website| ui|interface")
    unanswered = F.transform(F.filter(tags, lambda t: low(t).isin(SCREEN_TAGS)), lambda t: _proposal("tag", "remove", t["tag"], "", 0.75 - 0.2 * t["conf"], "prompt"))
    by_prompt = F.when(F.col("_wrong").isNotNull(), verdicts).when(~screens, unanswered).otherwise(none)
    seen = F.transform(F.filter("name_words", lambda w: (w["p"] >= 0.4) & (F.char_length(w["word"]) >= 3) & ~F.exists(tags, lambda t: low(t) == w["word"])),
                       lambda w: _proposal("tag", "add", "", w["word"], 0.3 + 0.6 * w["p"], "file name + vector"))
    parts = F.concat(
        F.when(auto & camera, art).otherwise(none), F.when(auto & is_shot, shot).otherwise(none),
        F.when(auto & made & ~edit & (F.size(tags) > 0), F.coalesce(by_prompt, none)).otherwise(none), F.when(auto & ~made, F.coalesce(seen, none)).otherwise(none),
        F.coalesce(_rename(sep, digits), none))
    good = F.filter(parts, lambda p: (p["confidence"] >= MIN_CONFIDENCE) & ~((p["field"] == "tag") & (p["action"] == "add") & alower(p["proposed"]).isin(list(blocked) or [""])))
    # the first proposal for one change stands; all proposals of an asset are in its own row
    same = lambda a, b: (a["field"] == b["field"]) & (a["current"] == b["current"]) & (a["proposed"] == b["proposed"])
    df = df.withColumn("_good", good)
    first = F.filter("_good", lambda p, i: ~F.exists(F.slice("_good", 1, i), lambda q: same(p, q)))
    out = df.select("id", F.explode(first).alias("p")).select("id", "p.*").withColumn("confidence", F.round("confidence", 2))
    return out if decided is None else drop_decided(out, decided)


def _rename(sep: str, digits: int) -> Column:
    """A name that kept a long prefix, shortened to its key words."""
    s = stem("dest_path")
    ser = serial_name(s, sep)
    number = ser["sn"].cast("string")
    tail = F.concat(ser["day_key"], F.lit(sep), F.when(F.length(number) >= digits, number).otherwise(F.lpad(number, digits, "0")))
    prefix = F.left(s, F.length(s) - F.length(tail) - len(sep))
    want = short_prefix(stem("src_path"), F.transform("name_words", lambda w: w["word"]))
    to = F.concat(want, F.lit(sep), tail, F.lit("."), ext_lower("dest_path"))
    conf = F.when(F.col("name_decided"), 0.8).otherwise(0.6)
    src = F.when(F.col("name_decided"), "file name + rating").otherwise("file name")
    return F.when(ser.isNotNull() & long_name(prefix) & (want != "") & (want != prefix),
                  F.array(_proposal("name", "rename", basename("dest_path"), to, conf, src)))


def drop_decided(proposals: DataFrame, decided: DataFrame, keys: tuple = ("id", "field", "current", "proposed")) -> DataFrame:
    """Proposals the user has neither rejected nor applied before."""
    d = decided.select(*[F.col(k).alias(f"_{k}") for k in keys])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_{k}"))
        cond = c if cond is None else cond & c
    return proposals.join(d, cond, "left_anti")


def corrections_view(corrections: DataFrame, assets: DataFrame) -> DataFrame:
    """Pending proposals of known assets, most certain first."""
    a = assets.select(F.col("id").alias("photo_id"), "src_path")
    return corrections.where("status = 'pending'").join(a, "photo_id").orderBy(F.desc("confidence"), "src_path", "id")


def apply_corrections(accepted: DataFrame) -> DataFrame:
    """``photo_id, removed, added``: the fix layer after applying proposals in order; the last action on a tag wins."""
    tag = alower(F.when(F.col("action") == "remove", F.col("current")).otherwise(F.col("proposed")))
    last = accepted.groupBy("photo_id", tag.alias("tag")).agg(F.max_by(F.struct("action", "confidence", "id"), "id").alias("l"))
    # the corrected tags of one asset
    g = last.groupBy("photo_id").agg(F.array_sort(F.collect_list(F.struct(F.col("l.id").alias("id"), F.col("l.action").alias("action"), "tag", F.round("l.confidence", 2).alias("conf")))).alias("f"))
    return g.select("photo_id", F.transform(F.filter("f", lambda x: x["action"] == "remove"), lambda x: x["tag"]).alias("removed"),
                    F.transform(F.filter("f", lambda x: x["action"] != "remove"), lambda x: F.struct(x["tag"].alias("tag"), x["conf"].alias("conf")).cast(TAG)).cast(TAGS).alias("added"))
