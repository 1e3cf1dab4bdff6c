"""Tag lists: parsing, the effective list of an asset, keyword merging and phrasings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import alower, col

TAG = "struct<tag:string,conf:double>"
TAGS = f"array<{TAG}>"
SEARCHABLE = 0.25  # fixed value: confidence from which a tag is a searchable word


def empty_tags() -> Column:
    return F.array().cast(TAGS)


def tag(name, conf) -> Column:
    return F.struct(col(name).alias("tag"), conf.cast("double").alias("conf")).cast(TAG)


def parse_tag_list(text) -> Column:
    """``["a", ...]`` or ``[["a", 0.5], ...]`` as tags with confidences (1 when not given)."""
    items = F.coalesce(F.from_json(col(text), "array<string>"), F.array().cast("array<string>"))
    pair = lambda x: x.startswith("[")
    parsed = F.transform(items, lambda x: F.struct(
        F.when(pair(x), F.get_json_object(x, "$[0]")).otherwise(x).alias("tag"),
        F.when(pair(x), F.coalesce(F.get_json_object(x, "$[1]").try_cast("double"), F.lit(1.0))).otherwise(1.0).alias("conf")).cast(TAG))
    return F.filter(parsed, lambda t: t["tag"].isNotNull() & (t["tag"] != ""))


def distinct_tags(tags: Column) -> Column:
    """First spelling of each tag, compared without case; order kept."""
    keys = F.transform(tags, lambda t: alower(F.trim(t["tag"])))
    # a tag stays where its key first occurs
    return F.filter(tags, lambda t, i: F.array_position(keys, alower(F.trim(t["tag"]))) == i + 1)


def effective_tags(user, vision, clip, removed, added, blocked: list[str] = ()) -> Column:
    """The user's list if there is one; else automatic tags minus removals plus additions; blocked tags never."""
    gone = F.transform(F.coalesce(col(removed), F.array().cast("array<string>")), alower)
    keep = lambda t: ~F.array_contains(gone, alower(t["tag"]))
    auto = F.concat(F.filter(col(vision), keep), F.filter(col(clip), lambda t: (t["conf"] >= SEARCHABLE) & keep(t)), col(added))
    own = F.transform(col(user), lambda t: F.struct(t["tag"].alias("tag"), F.lit(1.0).alias("conf")).cast(TAG))
    chosen = F.when(F.size(col(user)) > 0, own).otherwise(auto)
    shown = F.transform(chosen, lambda t: F.struct(F.trim(t["tag"]).alias("tag"), t["conf"].alias("conf")))
    usable = F.filter(shown, lambda t: (t["tag"] != "") & (~alower(t["tag"]).isin(list(blocked)) if blocked else F.lit(True)))
    return distinct_tags(usable)


def drop_blocked(tags, blocked: list[str]) -> Column:
    words = [b.strip().lower() for b in blocked]
    return F.filter(col(tags), lambda t: ~alower(F.trim(t)).isin(words))


def tag_names(tags) -> Column:
    return F.transform(col(tags), lambda t: t["tag"])


def merge_keywords(existing, wanted, ours_before) -> Column:
    """``struct<result, added, removed, ours_now>`` for a keyword list that is partly ours.

    Keywords we wrote earlier and no longer want go, everybody else's stay, wanted ones are appended. All comparisons ignore case.
    """
    low = lambda a: F.transform(col(a), alower)
    ours, want = low(ours_before), low(wanted)
    stays = lambda k: ~F.array_contains(ours, alower(k)) | F.array_contains(want, alower(k))
    keep, removed = F.filter(col(existing), stays), F.filter(col(existing), lambda k: ~stays(k))
    have = F.transform(keep, alower)
    distinct = F.filter(col(wanted), lambda k, i: F.array_position(want, alower(k)) == i + 1)
    added = F.filter(distinct, lambda k: ~F.array_contains(have, alower(k)))
    theirs = F.filter(low(existing), lambda k: ~F.array_contains(ours, k))
    ours_now = F.filter(distinct, lambda k: ~F.array_contains(theirs, alower(k)))
    return F.struct(F.concat(keep, added).alias("result"), added.alias("added"), removed.alias("removed"), ours_now.alias("ours_now"))


# fixed values: words used without an article
MASS_WORDS = ["food", "rice", "tea", "coffee", "wine", "beer", "sushi", "fruit", "noodles", "breakfast", "snow", "rain", "fog", "sky", "clouds",
              "night", "sunset", "sunrise", "summer", "winter", "nudity", "partial nudity", "revealing clothes", "lingerie", "furniture", "jewelry",
              "code", "handwriting", "christmas", "halloween", "chinese new year", "travel", "vacation", "camping", "hiking", "skiing", "swimming",
              "surfing", "cycling", "running", "football", "basketball", "tennis", "outer space", "traditional clothing", "cosplay", "underwater",
              "countryside", "spring flowers", "autumn leaves"]


def tag_phrases(name, category) -> Column:
    """Several phrasings of a tag, by category."""
    t, c = col(name), col(category)
    plural = t.isin(MASS_WORDS) | ((F.length(t) > 2) & t.rlike("[^s]s$"))
    a = F.when(plural, t).when(t.rlike("^[aeiou]"), F.concat(F.lit("an "), t)).otherwise(F.concat(F.lit("a "), t))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    # fixed values: the phrasings, as they decide which vectors are averaged
    return (F.when(c.isin("medium", "composition"), F.array(a, say("an image that is ", a), say("this is ", a), say(a, " of something")))
            .when(c == "document", F.array(say("a screenshot of ", a), say("an image of ", a), a, say("a photo of ", a)))
            .otherwise(F.array(say("a photo of ", a), say("a picture of ", a), say("an image showing ", a), say("an illustration of ", a), a)))
