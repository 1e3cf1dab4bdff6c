"""Organize planning: names and serials, metadata changes, descriptions, validation, journal and undo. Nothing touches files."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import fingerprint
from ..functions.tags import merge_keywords
from ..functions.text import alower, basename, clean_value, col, dirname, ext_lower, human_size, norm_ext, placeholder_text, text_covers, utf8_cut
from ..session import written
from .ranking import numbered

LAYOUTS = {"y/y-m": lambda y, m: F.concat(y, F.lit("/"), y, F.lit("-"), m), "y-m": lambda y, m: F.concat(y, F.lit("-"), m), "y/m": lambda y, m: F.concat(y, F.lit("/"), m)}


def day_key(date="date_value", prec="date_prec") -> Column:
    """YYYYMMDD with zeros where the precision ends; 00000000 when undated."""
    d, p = col(date), col(prec)
    digits = F.translate(F.left(d, F.lit(10)), "-", "")
    return F.when(d.isNull(), "00000000").when(p == "year", F.concat(F.left(digits, F.lit(4)), F.lit("0000"))).when(
        p == "month", F.concat(F.left(digits, F.lit(6)), F.lit("00"))).otherwise(digits)


def next_serial(df: DataFrame, root="out_root") -> DataFrame:
    """The next free serial per output root and day."""
    return df.groupBy(root, "day_key").agg((F.coalesce(F.max("sn"), F.lit(0)) + 1).alias("next"))


def free_destinations(planned: DataFrame, *taken: DataFrame) -> DataFrame:
    """Planned rows whose ``dest_path`` nobody uses."""
    for t in taken:
        planned = planned.join(t.select("dest_path").where("dest_path IS NOT NULL"), "dest_path", "left_anti")
    return planned


SERIAL_BUCKET = 256


def assign_serials(todo: DataFrame, taken: DataFrame | None, keys: list[str], order: list[Column]) -> DataFrame:
    """Give every row the next free serial of its key, in order.

    Numbering starts at the row's ``first_sn`` and skips the serials in ``taken`` (``keys, sn``). Used serials of a key become intervals of wanted
    numbers that are shifted alike: the k-th used serial s shifts every number from s - k + 1 on, until the next one does. Intervals are cut at
    buckets of ``SERIAL_BUCKET`` numbers, so every row finds its own by an equi-join on key and bucket, and no key is worked on in one task.
    ``todo`` is read twice; pass a written table if it is dear.
    """
    ranked = numbered(todo, keys, order, "_rank").withColumn("_want", (F.col("first_sn") + F.col("_rank") - 1).cast("bigint")).drop("_rank")
    if taken is None:
        return ranked.withColumn("sn", F.col("_want")).drop("_want")
    ranges = todo.groupBy(*keys).agg(F.min("first_sn").alias("_from"), (F.max("first_sn") + F.count("*") - 1).alias("_last"))
    t, r = taken.alias("t"), ranges.alias("r")
    used = t.join(r, _same(keys, "t", "r")).where(F.col("t.sn") >= F.col("r._from")).select(*[F.col(f"r.{k}") for k in keys], F.col("t.sn").cast("bigint").alias("sn"), "_last").distinct()
    steps = written(numbered(used, keys, [F.col("sn").asc()], "_k").select(*keys, "_last", "_k", (F.col("sn") - F.col("_k") + 1).alias("_lo")), "serials")
    following = steps.select(*keys, (F.col("_k") - 1).alias("_k"), (F.col("_lo") - 1).alias("_hi"))
    a, b = steps.alias("a"), following.alias("b")
    gaps = a.join(b, _same([*keys, "_k"], "a", "b"), "left").select("a.*", F.least(F.coalesce("b._hi", "a._last"), "a._last").alias("_hi")).where("_lo <= _hi")
    bucket = lambda c: F.call_function("div", F.col(c), F.lit(SERIAL_BUCKET))
    gaps = gaps.withColumn("_bucket", F.explode(F.sequence(bucket("_lo"), bucket("_hi"))))
    w, g = ranked.withColumn("_bucket", bucket("_want")).alias("w"), gaps.alias("g")
    found = w.join(g, _same([*keys, "_bucket"], "w", "g") & F.col("w._want").between(F.col("g._lo"), F.col("g._hi")), "left")
    return found.select(*[F.col(f"w.{c}") for c in todo.columns], (F.col("w._want") + F.coalesce("g._k", F.lit(0))).alias("sn"))


def _same(keys: list[str], left: str, right: str) -> Column:
    """Equal keys, a missing one included."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def plan_organize(df: DataFrame, *, file_op: str = "rename", layout: str = "y/y-m", write_mode: str = "embed", library: str = "/out", sep: str = "_", digits: int = 5,
                  prefix: Column | None = None, excluded: DataFrame | None = None, on_disk: DataFrame | None = None, libraries: dict[str, str] | None = None,
                  listing: DataFrame | None = None, changes: DataFrame | None = None) -> DataFrame:
    """``id, action, src, old_dest, dest, sn, include, note``: what organizing would do to every decided asset.

    Up-to-date rows are left out, excluded rows keep their place without a name, duplicates are listed but never included. Files go to the
    library of their source root (``libraries``), else to ``library``. Serials continue after the catalog's largest of the day in the
    folder or below it, and skip names that exist: ``on_disk`` (``_key`` folder or library, ``_day``, ``sn``), and the files and
    sidecars of a ``listing`` (``path``) that would have the same name. ``changes: id, added, removed, desc_action`` tells what a
    metadata write would do: items without anything new are left out, those that wait for a choice are not ticked.
    """
    d = df.where("resolved").withColumn("_day", day_key())
    if excluded is not None:
        d = d.join(excluded.select("id", F.lit(True).alias("_x")), "id", "left").withColumn("include", F.col("_x").isNull()).drop("_x")
    else:
        d = d.withColumn("include", F.lit(True))
    dup = F.col("dup_of") > 0
    placed = F.col("dest_path").isNotNull()
    refile = placed & (F.col("day_key") != F.col("_day"))
    ready = (F.col("vision_status") == "done") | F.col("clip_model").isNotNull()
    behind = placed & F.coalesce(ready, F.lit(False)) & ~F.col("meta_state").eqNullSafe("full") & F.lit(write_mode != "catalog")
    if file_op == "metadata":
        action = F.when(F.lit(write_mode != "catalog"), "metadata")
    else:
        action = F.when(refile, "refile").when(~placed, file_op).when(behind, "metadata")
    plan = d.where(~dup).withColumn("action", action).where("action IS NOT NULL")
    y, m = F.left("_day", F.lit(4)), F.substring("_day", 5, 2)
    folder = F.when(F.col("_day") == "00000000", "undated").otherwise(LAYOUTS[layout](y, m))
    here = dirname(F.when(F.col("action") == "refile", F.col("dest_path")).otherwise(F.col("src_path")))
    lib = F.lit(library)
    for root, place in (libraries or {}).items():
        lib = F.when(F.col("src_root") == root, place).otherwise(lib)
    plan = plan.withColumn("_dir", here if file_op == "rename" else F.concat(lib, F.lit("/"), folder))
    plan = plan.withColumn("_key", F.col("_dir") if file_op == "rename" else lib)
    naming = F.col("include") & (F.col("action") != "metadata")
    if file_op == "rename":  # every folder above a file, its own included
        parts = F.split(dirname("dest_path"), "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    else:
        above = F.filter(F.array(*[F.lit(x) for x in sorted({library, *(libraries or {}).values()})]), lambda x: F.col("dest_path").startswith(F.concat(x, F.lit("/"))))
    used = df.where("dest_path IS NOT NULL").select(F.explode(above).alias("_key"), F.col("day_key").alias("_day"), F.col("sn").cast("bigint").alias("sn"))
    start = used.groupBy("_key", "_day").agg((F.max("sn") + 1).alias("first_sn"))
    named = plan.where(naming).join(start, ["_key", "_day"], "left").withColumn("first_sn", F.coalesce("first_sn", F.lit(1)))
    lead = F.when(F.coalesce(prefix, F.lit("")) != "", F.concat(prefix, F.lit(sep))).otherwise("") if prefix is not None else F.lit("")
    named = named.withColumn("_lead", lead).withColumn("_ext", norm_ext(ext_lower("src_path")))
    # the names to give, computed once: numbering, names in use and the plan read this table
    named = written(named.select("id", "action", "src_path", "dest_path", "include", "size", "mtime", "needs_review", "date_value", "first_sn", "_key", "_dir", "_day", "_lead", "_ext"), "named")
    if listing is not None:
        paths = listing.select(F.regexp_replace("path", r"\.xmp$", "").alias("p")).unionByName(df.where("dest_path IS NOT NULL").select(F.col("dest_path").alias("p")))
        known = _names_in_use(paths, named, sep, digits)
        on_disk = known if on_disk is None else on_disk.select("_key", "_day", "sn").unionByName(known)
    named = assign_serials(named, on_disk, ["_key", "_day"], [F.col("date_value").asc_nulls_last(), F.col("src_path").asc(), F.col("id").asc()])
    new = F.concat(F.col("_dir"), F.lit("/"), F.col("_lead"), F.col("_day"), F.lit(sep), _padded(F.col("sn"), digits), F.lit("."), F.col("_ext"))
    review = F.when(F.col("needs_review"), "date needs review")
    cols = lambda x, dest, sn, note, inc=None: x.select(
        "id", "action", F.col("src_path").alias("src"), F.when(F.col("action") == "refile", F.col("dest_path")).alias("old_dest"), dest.alias("dest"),
        sn.cast("bigint").alias("sn"), (F.col("include") if inc is None else inc).alias("include"), F.nullif(F.concat_ws("; ", note, review), F.lit("")).alias("note"),
        "size", "mtime", "needs_review")
    null = F.lit(None)
    out = cols(named, new, F.col("sn"), null.cast("string"))
    rest = plan.where(~naming)
    choice = F.lit(False)
    if changes is not None:
        rest = rest.join(changes.select("id", F.col("added").alias("_added"), F.col("removed").alias("_removed"), F.col("desc_action").alias("_desc")), "id", "left")
        nothing = (F.col("action") == "metadata") & F.col("include") & (F.coalesce("_added", F.lit(0)) <= 0) & (F.coalesce("_removed", F.lit(0)) <= 0)
        undecided = F.coalesce(F.col("_desc") == "decide", F.lit(False))
        rest = rest.where(~nothing | undecided).withColumn("_choice", nothing & undecided)
        choice = F.col("_choice")
    kept = F.coalesce("dest_path", "src_path")
    reason = (F.when(F.col("dest_path").isNull(), "adds missing fields to the original").otherwise("adds missing fields to the organized copy")
              if file_op == "metadata" else F.lit("tags changed after organizing"))
    out = out.unionByName(cols(rest, F.when(F.col("action") == "metadata", kept).otherwise("(excluded)"), null,
                               F.when(choice, "description: your choice (keep / append / replace)").when(F.col("action") == "metadata", reason), F.col("include") & ~choice))
    copies = d.where(dup).withColumn("action", F.lit("duplicate"))
    return out.unionByName(copies.select("id", "action", F.col("src_path").alias("src"), null.cast("string").alias("old_dest"), null.cast("string").alias("dest"),
                                         null.cast("bigint").alias("sn"), F.lit(False).alias("include"),
                                         F.concat(F.lit("same content as #"), F.col("dup_of").cast("string"), F.lit(", not copied ("), human_size("size"), F.lit(")")).alias("note"), "size", "mtime", "needs_review"))


def _padded(number: Column, digits: int) -> Column:
    text = number.cast("string")
    return F.when(F.length(text) >= digits, text).otherwise(F.lpad(text, digits, "0"))


def _names_in_use(paths: DataFrame, named: DataFrame, sep: str, digits: int) -> DataFrame:
    """``_key, _day, sn`` of the paths that a planned row could be given as its name."""
    part = lambda k: F.regexp_extract(basename("p"), r"^(.*?)(\d{8})" + re.escape(sep) + r"(\d+)\.([^.]*)$", k)
    names = paths.select(dirname("p").alias("_dir"), part(1).alias("_lead"), part(2).alias("_day"), part(3).alias("_n"), part(4).alias("_ext")).where("_n <> '' AND length(_n) < 18")
    names = names.withColumn("sn", F.col("_n").cast("bigint")).where(F.col("_n") == _padded(F.col("sn"), digits))
    like = ["_dir", "_lead", "_day", "_ext"]
    return names.join(named.select(*like, "_key").distinct(), like).select("_key", "_day", "sn").distinct()


def plan_totals(plan: DataFrame, write_mode: str = "embed") -> DataFrame:
    """Items, bytes, estimated seconds and items that need review. The estimates."""
    live = (F.col("action") != "duplicate") & F.col("include")
    secs = F.when(F.col("action") == "copy", F.col("size") / 150e6).otherwise(0.0) + (0.005 if write_mode == "catalog" else 0.04)
    return plan.agg(F.count(F.when(live, 1)).alias("items"), F.coalesce(F.sum(F.when(live, F.col("size"))), F.lit(0)).alias("bytes"),
                    F.round(F.coalesce(F.sum(F.when(live, secs)), F.lit(0.0)), 3).alias("seconds"), F.count(F.when(live & F.col("needs_review"), 1)).alias("review"))


def plan_action_counts(plan: DataFrame) -> DataFrame:
    a = F.col("action")
    return plan.agg(F.count(F.when(a.isin("copy", "move", "rename"), 1)).alias("place"), F.count(F.when(a == "refile", 1)).alias("refile"),
                    F.count(F.when(a == "metadata", 1)).alias("metadata"), F.count(F.when(a == "duplicate", 1)).alias("duplicate"),
                    F.count(F.when(F.col("needs_review") & (a != "duplicate"), 1)).alias("review"))


def plan_metadata(df: DataFrame) -> DataFrame:
    """``id, key, value``: the fields a metadata write would set; a field that has a value is never touched.

    Needs ``keys`` (existing metadata keys), ``existing_kw, wanted_kw, ours_kw, date_text, date_trusted, date_fine, location, description``.
    """
    has = lambda *ks: F.arrays_overlap("keys", F.array(*[F.lit(k) for k in ks]))
    fine = F.col("date_text").isNotNull() & F.col("date_trusted") & F.col("date_fine")
    kw = merge_keywords(F.transform("existing_kw", lambda k: k), F.transform("wanted_kw", lambda k: clean_value(F.replace(k, F.lit(","), F.lit(" ")), 64)), "ours_kw")
    change = lambda key, cond, value: F.when(cond, F.struct(F.lit(key).alias("key"), value.alias("value")))
    fields = F.array(
        change("Exif.Photo.DateTimeOriginal", fine & ~has("Exif.Photo.DateTimeOriginal", "Xmp.exif.DateTimeOriginal"), F.translate("date_text", "-", ":")),
        change("Xmp.photoshop.DateCreated", F.col("date_text").isNotNull() & F.col("date_trusted") & ~has("Xmp.photoshop.DateCreated"), F.col("date_text")),
        change("Xmp.iptc.Location", F.col("location").isNotNull() & ~has("Xmp.iptc.Location", "Xmp.photoshop.City", "Iptc.Application2.City", "Iptc.Application2.SubLocation"),
               clean_value("location", 200)),
        change("Xmp.dc.description", (F.col("description") != "") & ~has("Xmp.dc.description"), clean_value("description", 2000)),
        change("Xmp.catalog.ResolvedDate", F.col("date_text").isNotNull(), F.col("date_text")))
    df = df.withColumn("_kw", kw)
    words = F.transform(F.col("_kw.added"), lambda k: F.struct(F.lit("Xmp.dc.subject").alias("key"), k.alias("value")))
    gone = F.transform(F.col("_kw.removed"), lambda k: F.struct(F.lit("-Xmp.dc.subject").alias("key"), k.alias("value")))
    allc = F.concat(F.filter(fields, lambda f: f.isNotNull() & (f["value"] != "")), words, gone)
    return df.select("id", F.explode(allc).alias("c")).select("id", "c.key", "c.value")


def our_description(prompt, caption, tags) -> Column:
    """Prompt, caption and "Shows: tags." joined by a dash."""
    p = F.translate(col(prompt), "\n", " ")
    p = F.when(F.octet_length(p) > 1500, F.concat(utf8_cut(p, 1500), F.lit("…"))).otherwise(p)
    shows = F.array_join(F.filter(col(tags), lambda t: alower(t) != "photo"), ", ")
    return F.concat_ws(" — ", F.nullif(p, F.lit("")), F.nullif(col(caption), F.lit("")), F.when(shows != "", F.concat(F.lit("Shows: "), shows, F.lit("."))))


def decide_description(df: DataFrame, policy: str = "agree", answers: DataFrame | None = None, cached: DataFrame | None = None) -> DataFrame:
    """Add ``desc_action, desc_by``: what to do with a description the file already has.

    ``have, ours, prev, file_stem`` per row; ``answers: id, action, conf, p_junk, p_adds`` (the rating model, then the second opinion,
    whose probabilities may be missing); ``cached: key, action, by`` are settled text pairs.
    """
    df = df.withColumn("_key", fingerprint("have", "ours"))
    if answers is not None:
        df = df.join(answers.select("id", F.col("action").alias("_a"), F.col("conf").alias("_c"), F.col("p_junk").alias("_j"), F.col("p_adds").alias("_d")), "id", "left")
    else:
        for c, t in (("_a", "string"), ("_c", "int"), ("_j", "double"), ("_d", "double")):
            df = df.withColumn(c, F.lit(None).cast(t))
    if cached is not None:
        df = df.join(cached.where("action <> 'decide'").select(F.col("key").alias("_key"), F.col("action").alias("_ca"), F.col("by").alias("_cb")), "_key", "left")
    else:
        df = df.withColumn("_ca", F.lit(None).cast("string")).withColumn("_cb", F.lit(None).cast("string"))
    second = F.when(F.col("_j") > 0.5, "replace").when(F.col("_d") > 0.5, "append").otherwise("keep")
    opinions = F.when(F.col("_a").isNull() | ~F.col("_a").isin("keep", "append", "replace"), F.struct(F.lit("decide").alias("a"), F.lit("you").alias("b"))).when(
        F.lit(policy == "rating") | F.col("_j").isNull(),
        F.when(F.col("_c") >= 70, F.struct(F.col("_a").alias("a"), F.lit("rating").alias("b"))).otherwise(F.struct(F.lit("decide").alias("a"), F.lit("you").alias("b")))).when(
        second == F.col("_a"), F.struct(F.col("_a").alias("a"), F.lit("rating + arbiter").alias("b"))).otherwise(F.struct(F.lit("decide").alias("a"), F.lit("you").alias("b")))
    say = lambda a, b: F.struct(F.lit(a).cast("string").alias("a"), F.lit(b).cast("string").alias("b"))
    has_prev = F.coalesce((F.col("prev") != "") & F.contains("have", F.col("prev")), F.lit(False))
    ladder = (F.when(F.coalesce("ours", F.lit("")) == "", say(None, None)).when(F.coalesce("have", F.lit("")) == "", say("add", "rules"))
              .when(has_prev, say("update", "ours")).when(F.contains("have", F.col("ours")), say("keep", "same"))
              .when(F.col("_ca").isNotNull(), F.struct(F.col("_ca").alias("a"), F.col("_cb").alias("b"))))
    if policy == "fill":
        ladder = ladder.otherwise(say("keep", "settings"))
    else:
        ladder = ladder.when(placeholder_text("have", "file_stem"), say("replace", "rules")).when(text_covers("have", "ours"), say("keep", "rules"))
        ladder = ladder.otherwise(say("decide", "you") if policy == "ask" else opinions)
    df = df.withColumn("_o", ladder)
    return df.withColumn("desc_action", F.col("_o.a")).withColumn("desc_by", F.col("_o.b")).drop("_key", "_a", "_c", "_j", "_d", "_ca", "_cb", "_o")


def validate_plan(plan: DataFrame, catalog: DataFrame, fresh: DataFrame) -> DataFrame:
    """Add ``problem`` to included items: destination taken, source missing, its size or time changed since the scan (``fresh: src_path, size, mtime``)."""
    taken = fresh.select(F.col("src_path").alias("dest")).unionByName(catalog.where("dest_path IS NOT NULL").select(F.col("dest_path").alias("dest"))).distinct()
    p = plan.where(F.col("include") & (F.col("action") != "duplicate"))
    p = p.withColumn("_from", F.coalesce("old_dest", "src"))
    p = p.join(taken.select("dest", F.lit(True).alias("_t")), "dest", "left")
    p = p.join(fresh.select(F.col("src_path").alias("_from"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime")), "_from", "left")
    moves = F.col("action").isin("copy", "move", "rename", "refile")
    changed = (F.col("_size") != F.col("size")) | (F.col("_mtime") != F.col("mtime"))
    return p.withColumn("problem", F.when(moves & F.col("_t"), "destination taken").when(F.col("_size").isNull(), "source missing").when(
        (F.col("action") != "refile") & changed, "source changed")).drop("_from", "_t", "_size", "_mtime")


def record_run(plan: DataFrame, run: str) -> DataFrame:
    """Journal rows of the applied items of one run."""
    done = plan.where(F.col("include") & (F.col("action") != "duplicate"))
    return done.select(F.lit(run).alias("run"), F.when(F.col("action") == "metadata", "meta").otherwise(F.col("action")).alias("kind"), F.col("id").alias("photo_id"),
                       F.coalesce("old_dest", "src").alias("src"), F.col("dest").alias("dst"), F.lit(False).alias("undone"))


def plan_undo(journal: DataFrame, occupied: DataFrame) -> DataFrame:
    """Inverse of every entry not undone yet, newest first; a move back is blocked when the old name is taken (``path``)."""
    j = journal.where("NOT undone")
    o = occupied.select(F.col("path").alias("src")).distinct().withColumn("_taken", F.lit(True))
    j = j.join(o, "src", "left")
    back = F.col("kind").isin("move", "rename", "refile")
    return j.select("id", "kind", "photo_id", F.when(F.col("kind") == "copy", "trash").when(F.col("kind") == "meta", "restore").otherwise("move back").alias("undo"),
                    F.col("dst").alias("from_path"), F.when(back, F.col("src")).alias("to_path"), F.coalesce(back & F.col("_taken"), F.lit(False)).alias("blocked")).orderBy(F.desc("id"))


def apply_run_results(assets: DataFrame, results: DataFrame) -> DataFrame:
    """The catalog after a run: new paths, destinations and sizes; removed rows gone; cleared destinations empty.

    ``results: id, at, outcome ('moved', 'placed', 'refreshed', 'removed', 'cleared'), path, size``; the last outcome per asset counts.
    """
    last = results.groupBy("id").agg(F.max_by(F.struct("outcome", "path", F.col("size").alias("new_size")), "at").alias("_r"))
    df = assets.join(last, "id", "left")
    o = F.col("_r.outcome")
    out = df.where(~F.coalesce(o == "removed", F.lit(False)))
    return (out.withColumn("src_path", F.when(o == "moved", F.col("_r.path")).otherwise(F.col("src_path")))
            .withColumn("dest_path", F.when(o == "placed", F.col("_r.path")).when(o == "cleared", None).otherwise(F.col("dest_path")))
            .withColumn("meta_state", F.when(o == "cleared", None).otherwise(F.col("meta_state")))
            .withColumn("size", F.when(o == "refreshed", F.col("_r.new_size")).otherwise(F.col("size"))).drop("_r"))


