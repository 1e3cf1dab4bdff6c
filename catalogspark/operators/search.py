"""Search documents and the ways to query them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.query import MIN_MATCH, best_term_weight, term_weight
from ..functions.text import alower, basename, col, excerpt_at, meta_line, utf8_cut

OWN_NAMESPACE = "Xmp.catalog."


def exif_lines(meta) -> Column:
    """"key = value" lines of a metadata map in key order, without our own namespace."""
    entries = F.array_sort(F.filter(F.map_entries(col(meta)), lambda e: ~e["key"].startswith(OWN_NAMESPACE)), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return F.array_join(F.flatten(F.transform(entries, lambda e: F.transform(e["value"]["v"], lambda v: F.concat(e["key"], F.lit(" = "), v, F.lit("\n"))))), "")


def joined_description(caption, parts: Column) -> Column:
    """Caption and parts joined by " | ", skipping empty parts and those already contained."""
    start = F.coalesce(col(caption), F.lit(""))
    return F.aggregate(parts, start, lambda acc, p: F.when(p.isNull() | (p == "") | F.contains(acc, p), acc).when(acc == "", p).otherwise(
        F.concat(acc, F.lit(" | "), p)))


def build_docs(df: DataFrame, *, caption="caption", parts: Column, name="src_path", dest="dest_path", tags="tags") -> DataFrame:
    """Search documents of everything that is not a duplicate: raw and lower-case text per field."""
    df = df.where(F.coalesce(F.col("dup_of"), F.lit(0)) == 0)
    raw = F.concat(F.col(name), F.when(F.col(dest).isNull(), "").otherwise(F.concat(F.lit("\n"), F.col(dest))))
    return (df.withColumn("name_raw", raw).withColumn("name", alower("name_raw")).withColumn("desc_raw", joined_description(caption, parts))
            .withColumn("desc", alower("desc_raw")).withColumn("doc_tags", F.transform(tags, alower)))


def search_text(*parts) -> Column:
    """The indexed text: all parts in order, joined and lower-cased."""
    return alower(F.array_join(F.array(*[F.coalesce(col(p), F.lit("")) for p in parts]), " | "))


def top_hits(df: DataFrame, limit: int, score: str = "score") -> DataFrame:
    return df.orderBy(F.desc(score), "id").limit(limit)


def regex_search(df: DataFrame, pattern: str, fields: dict) -> DataFrame:
    """Case-insensitive matches: the first field that matches, the matched text, and ``why``: its label with the start of a name, the text
    around the match, or the metadata line it stands in (field ``exif``)."""
    p = "(?i)" + pattern

    def shown(field: str, c) -> Column:
        hit = F.regexp_extract(col(c), p, 0)
        if field == "name":
            text = F.left(hit, F.lit(80))
        elif field == "exif":
            text = meta_line(c, hit)
        else:
            text = excerpt_at(c, F.regexp_instr(col(c), F.lit(p)), F.length(hit))
        return F.when(col(c).rlike(p), F.struct(F.lit(field).alias("field"), hit.alias("hit"), F.concat(F.lit(f"{field}: "), text).alias("why")))

    found = df.withColumn("_m", F.coalesce(*[shown(f, c) for f, c in fields.items()])).where("_m is not null")
    return found.withColumns({k: F.col(f"_m.{k}") for k in ("field", "hit", "why")}).drop("_m")


def search_words(df: DataFrame, terms: list[str], excludes: list[str], fields: dict, alts: dict | None = None) -> DataFrame:
    """Rows with every term (or an equivalent) and no excluded one; ``score`` is the weight share of a perfect hit."""
    scored = keyword_scores(df, terms, excludes, fields, alts)
    return scored.where("all_terms AND NOT excluded").withColumn("score", F.col("kw")).drop("all_terms", "excluded", "kw")


def keyword_scores(df: DataFrame, terms: list[str], excludes: list[str], fields: dict, alts: dict | None = None) -> DataFrame:
    """Add ``kw, all_terms, excluded``."""
    alts = alts or {}
    hits = [best_term_weight(alts.get(t, [t]), fields) for t in terms]
    bad = [best_term_weight(alts.get(t, [t]), fields) > 0 for t in excludes]
    total = reduce(lambda a, b: a + b, hits) if hits else F.lit(0.0)
    return (df.withColumn("kw", total / (3.3 * max(1, len(terms))))
            .withColumn("all_terms", reduce(lambda a, b: a & b, [h > 0 for h in hits]) if hits else F.lit(False))
            .withColumn("excluded", reduce(lambda a, b: a | b, bad) if bad else F.lit(False)))


def search_meaning(df: DataFrame, p: str = "p") -> DataFrame:
    return df.where(F.col(p) >= MIN_MATCH).withColumn("score", F.col(p))


def search_smart(df: DataFrame, p: str = "p") -> DataFrame:
    """Words or meaning: 0.6 meaning + 0.4 words (at least half) + 0.2 when both. Needs ``kw, all_terms, excluded``."""
    sem, words = F.col(p) >= MIN_MATCH, F.col("all_terms")
    score = (0.6 * F.col(p) + F.when(words, 0.4 * F.greatest(F.col("kw"), F.lit(0.5))).otherwise(0.0) + F.when(words & sem, 0.2).otherwise(0.0))
    return df.where(~F.col("excluded") & (words | sem)).withColumn("score", score)


def ask_candidates(df: DataFrame, keywords: list[str], excludes: list[str], fields: dict, p: str = "p", limit: int = 100) -> DataFrame:
    """Local candidates for a question: half the keywords or a clear visual match; the best ``limit``."""
    count = reduce(lambda a, b: a + b, [F.when(term_weight(k, fields) > 0, 1).otherwise(0) for k in keywords]) if keywords else F.lit(0)
    kwf = F.least(F.lit(1.0), 2.0 * count / max(1, len(keywords))) if keywords else F.lit(0.0)
    sem = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(p) / 0.6))
    local = F.least(F.lit(1.0), F.greatest(kwf, sem) + F.when((kwf > 0) & (sem > 0.3), 0.15).otherwise(0.0))
    bad = [term_weight(x, fields) > 0 for x in excludes]
    if bad:
        df = df.where(~reduce(lambda a, b: a | b, bad))
    out = df.withColumn("local", local).where("local >= 0.5")
    return out.orderBy(F.desc("local"), "id").limit(limit) if limit else out


def ask_blend(cands: DataFrame, rating: DataFrame, arbiter: DataFrame, keep: float = 50.0) -> DataFrame:
    """Fold model ratings (0-100) and second opinions into the local score.

    ``rating: id, r`` · ``arbiter: id, q``. A second opinion counts for close calls of the rating (30-70), and alone where the rating failed.
    Rows without any answer keep the local score.
    """
    df = cands.join(rating.select("id", F.col("r").cast("double").alias("r")), "id", "left").join(arbiter.select("id", F.col("q").cast("double").alias("q")), "id", "left")
    df = df.withColumn("q", F.when(F.col("r").isNull() | F.col("r").between(30, 70), F.col("q")))
    decision = F.when(F.col("r").isNotNull() & F.col("q").isNotNull(), 0.5 * F.col("r") + 0.5 * F.col("q")).otherwise(F.coalesce("r", "q"))
    df = df.withColumn("decision", decision).withColumn("kept", F.coalesce(F.col("decision") >= keep, F.lit(True)))
    before = F.col("r") >= keep
    df = df.withColumn("changed", F.coalesce(F.col("q").isNotNull() & (before != F.col("kept")), F.lit(False)))
    return df.withColumn("score", F.when(F.col("decision").isNull(), F.col("local")).otherwise(0.3 * F.col("local") + 0.7 * F.col("decision") / 100.0))


def ask_decision_log(blended: DataFrame, text: str, name: str = "name") -> DataFrame:
    """A log row for every candidate the second opinion judged."""
    return blended.where(F.col("q").isNotNull()).select(
        F.lit("search").alias("kind"), F.col("id").alias("photo_id"), F.lit(text).alias("subject"), basename(name).alias("question"),
        F.when(F.col("r").isNull(), "-").when(F.col("r") >= 50, "keep").otherwise("drop").alias("rules_pick"), F.when(F.col("q") >= 50, "yes").otherwise("no").alias("arbiter_pick"),
        F.when(F.col("kept"), "keep").otherwise("drop").alias("final_pick"), "changed")


def describe_doc(desc, prompt, date, prec, path) -> Column:
    """Compact text of a candidate for a rating request."""
    d = F.translate(utf8_cut(desc, 220), "\n", " ")
    own = F.split_part(col(prompt), F.lit("\nNegative: "), F.lit(1))
    short = F.translate(F.when(F.octet_length(own) > 240, F.concat(utf8_cut(own, 240), F.lit("…"))).otherwise(own), "\n", " ")
    day = F.left(col(date), F.when(col(prec) == "year", 4).when(col(prec) == "month", 7).otherwise(10))
    return F.concat(d, F.when(F.coalesce(col(prompt), F.lit("")) != "", F.concat(F.lit(" | prompt: "), short)).otherwise(""),
                    F.lit(" | date "), F.coalesce(day, F.lit("unknown")), F.lit(" | file "), basename(path))


def hits_to_rows(hits: DataFrame, assets: DataFrame) -> DataFrame:
    """Hits with their catalog rows; hits whose row is gone disappear."""
    return assets.join(hits.select("id", "score", "why"), "id", "inner")


def expand_terms(terms: DataFrame, translations: DataFrame) -> DataFrame:
    """``term, alts``: the lower-case term itself, then its cached equivalents."""
    t = terms.select(alower(F.trim("term")).alias("term")).distinct()
    tr = translations.select(F.col("term").alias("_t"), F.col("alts").alias("_a"))
    return t.join(tr, F.col("term") == F.col("_t"), "left").select(
        "term", F.array_union(F.array("term"), F.coalesce(F.transform("_a", alower), F.array().cast("array<string>"))).alias("alts"))


def terms_to_translate(terms: DataFrame, translations: DataFrame) -> DataFrame:
    """Distinct terms worth asking about: two characters or more, not numbers, not known yet."""
    t = terms.select(alower(F.trim("term")).alias("term")).where((F.char_length("term") >= 2) & ~F.col("term").rlike(r"^[0-9\-_]*$")).distinct()
    return t.join(translations.select("term"), "term", "left_anti")


def english_phrase(queries: DataFrame, translations: DataFrame) -> DataFrame:
    """``id, phrase, english``: the first ASCII equivalent of the whole phrase, else one word at a time."""
    plain = lambda x: ~x.rlike(r"[^\x00-\x7F]")
    tr = translations.select(F.col("term").alias("_t"), F.filter("alts", plain).alias("_a"))
    q = queries.withColumn("_p", alower("phrase"))
    whole = q.join(tr, F.col("_p") == F.col("_t"), "left").withColumn("_whole", F.get("_a", F.lit(0))).drop("_t", "_a")
    words = q.select("id", F.posexplode(F.split("_p", " +")).alias("pos", "w"))
    picked = words.join(tr, F.col("w") == F.col("_t"), "left").withColumn("e", F.when(plain(F.col("w")), F.col("w")).otherwise(F.get("_a", F.lit(0))))
    # the words of one query
    each = picked.where("e IS NOT NULL").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "e"))), lambda x: x["e"]), " ").alias("_each"))
    out = whole.join(each, "id", "left")
    return out.select("id", "phrase", F.when(plain(F.col("phrase")), F.col("phrase")).otherwise(F.coalesce("_whole", "_each", "phrase")).alias("english"))


def date_listing(df: DataFrame) -> DataFrame:
    """An empty query with a date range lists its pool in catalog order."""
    return df.select("id", F.lit(0.0).alias("score"), F.left("date_value", F.lit(10)).alias("why")).orderBy("id")
