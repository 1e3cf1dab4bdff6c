"""Queries: the incremental runs, driven to completion over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..functions import civil
from ..functions import evidence as ev
from ..functions.text import ancestor_dirs
from ..operators import catalog as cat
from ..operators import dates, tags
from ..session import ensure_checkpoint_dir, written
from ..sources.views import _SPARK, _VIEWS, _render, label_vocabulary, read, view
from ..streaming.incremental import LiveCatalog, watch_live
from ..streaming.watch import Catalog, metric_columns, watch_catalog
from .dates import EVIDENCE, NOW, camera_time
from .registry import query
from .tags import SCORES


def scan_rows(events):
    """Scan rows from events: every user's folder is one path that changes with every event."""
    a = events.selectExpr(*[f"{_render(e, _SPARK)} as {c}" for c, e in _VIEWS["assets"][1]])
    return a.select(F.concat(F.lit("/lib/user_"), F.col("user_id").cast("string"), F.lit("/"), F.col("kind"), F.lit(".jpg")).alias("src_path"), "size", "mtime",
                    F.struct(F.col("mtime").alias("m"), F.col("id").alias("i")).alias("at"))


@query("latest_version", using=("assets",), oracle="""
SELECT '/lib/user_'||user_id||'/'||kind||'.jpg' AS src_path, max_by(size, struct_pack(m := mtime, i := id)) AS size, max_by(mtime, struct_pack(m := mtime, i := id)) AS mtime FROM assets GROUP BY 1""")
def latest_version(spark, sf):
    return cat.latest_version(scan_rows(read(spark, sf, "events"))).select("src_path", "size", "mtime")


@query("watch_catalog", using=("assets",), oracle="""
SELECT '/lib/user_'||user_id||'/'||kind||'.jpg' AS src_path, max_by(size, struct_pack(m := mtime, i := id)) AS size, false AS resolved FROM assets GROUP BY 1""")
def watch(spark, sf):
    """The catalog that two file streams build from the event table, in batches out of order, equals the newest version of every path."""
    base = f"{ensure_checkpoint_dir(spark)}/watch-{uuid.uuid4().hex}"
    events = read(spark, sf, "events")
    # files that each hold events of all times, so later batches bring older rows
    for half in (0, 1):
        events.where(F.col("event_id") % 2 == half).repartition(3, F.xxhash64("event_id")).write.parquet(f"{base}/arrived-{half}")
        stream = watch_catalog(spark, f"{base}/arrived-{half}", events.schema, f"{base}/catalog", f"{base}/progress-{half}", prepare=scan_rows, files_per_batch=1)
        stream.awaitTermination()
        if not half:
            Catalog(spark, f"{base}/catalog").compact()
    return Catalog(spark, f"{base}/catalog").read().select("src_path", "size", "resolved")


@query("run_metrics", using=("assets",), oracle="""
SELECT count(*) AS done, sum(CASE WHEN id%50=0 THEN 0 ELSE size END)::bigint AS bytes, count(*) FILTER (id%50=0 OR size<=0) AS errors FROM assets""")
def metrics(spark, sf):
    """The figures that a stage reports beside its rows, read back after it ran."""
    seen = Observation(f"scan-{uuid.uuid4().hex[:8]}")
    assets = view(spark, sf, "assets").withColumn("size", F.when(F.col("id") % 50 == 0, 0).otherwise(F.col("size")))
    assets.observe(seen, *metric_columns()).select("id", "size").write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.range(1).select(*[F.lit(got[k]).cast("bigint").alias(k) for k in ("done", "bytes", "errors")])


# files of the watched folder as they end: every 13th event's file is deleted
LIVE = "live AS (SELECT * FROM assets WHERE id%13<>0)"


def live_rows(spark, sf, events):
    """Scan rows from versions of events: an earlier state of some files, the last state of all, the deletion of some."""
    a = events.selectExpr("version", *[f"{_render(e, _SPARK)} as {c}" for c, e in _VIEWS["assets"][1]])
    early = F.col("version") == 0
    # the earlier state has another content, and all of it lies in one minute of file time
    a = a.withColumns({"size": F.col("size") % 300 + F.when(early, 1001).otherwise(1), "mtime": F.when(early, F.lit(1_600_000_000).cast("bigint")).otherwise(F.col("mtime")), "deleted": F.col("version") == 2, "at": F.col("version")})
    a = a.withColumn("src_path", F.concat("src_root", F.lit("/"), "folder", F.lit("/"), "stem", F.lit("_"), F.col("id").cast("string"), F.lit("."), "ext"))
    a = a.withColumns({"full": F.concat("kind", F.lit("-"), "size"), "dest_path": F.lit(None).cast("string"), "meta_len": F.lit(0)})
    a = ev.with_name_dates(a, F.array("stem"), False, "_names", NOW).withColumn("days", dates.evidence_days(F.col("_names"))).drop("_names")
    # a row is moved in every step of a batch: vectors are looked up and folders and metadata derived when a file is decided
    a = a.withColumn("vec_id", F.col("id") % read(spark, sf, "embeddings").count())
    return a.select("src_path", "at", "deleted", "id", "size", "mtime", "pinned", "full", "dest_path", "meta_len", "src_root", "stem", "manual_date", "exif_original", "days", "vec_id")


def live_catalog(spark, sf) -> LiveCatalog:
    """Duplicates, dates and tags after a stream of files that change and go, in batches out of order."""
    base = f"{ensure_checkpoint_dir(spark)}/live-{uuid.uuid4().hex}"
    versions = F.array(F.when(F.col("event_id") % 3 == 0, 0), F.lit(1), F.when(F.col("event_id") % 13 == 0, 2))
    events = read(spark, sf, "events").withColumn("version", F.explode(F.filter(versions, lambda v: v.isNotNull())))
    vocabulary = tags.Vocabulary.load(label_vocabulary(spark, sf))
    # a repeated id has one vector, as a path has one result
    vectors = written(read(spark, sf, "embeddings").select("vec_id", "embedding").dropDuplicates(["vec_id"]), "vectors")
    dated = ["src_path", "id", "date_secs", "date_prec", "date_source", "date_conf", "margin", "needs_review"]

    def decide(rows):
        rows = rows.withColumns({"dirs": ancestor_dirs("src_root", "src_path"), "meta": camera_time()})
        found = dates.decide_dates(dates.union_candidates(rows, NOW, meta="meta", bulk="bulk", extra=dates.manual_candidate("manual_date")))
        return tags.tag_assets(found.select(*dated, "vec_id").join(vectors, "vec_id", "left"), "embedding", vocabulary).select(*dated, "picked")

    catalog = LiveCatalog(spark, f"{base}/catalog", live_rows(spark, sf, events).schema, decide, buckets=8)
    # each arriving file holds versions of all kinds, so older ones follow newer ones
    events.repartition(3, F.xxhash64("event_id", "version")).write.parquet(f"{base}/arrived")
    watch_live(spark, f"{base}/arrived", events.schema, catalog, f"{base}/progress", prepare=lambda e: live_rows(spark, sf, e), files_per_batch=1).awaitTermination()
    return catalog


@query("watch_live", using=("assets", "cosines"), oracle=f"""
WITH {LIVE}, {EVIDENCE.replace("assets", "live")}, {SCORES},
m AS (SELECT id, size%300+1 AS size, kind, folder, pinned, mtime, '/lib/'||folder||'/'||stem||'_'||id||'.'||ext AS path FROM live),
r AS (SELECT *, first_value(id) OVER (PARTITION BY size, kind ORDER BY NOT pinned, folder='backup', mtime=0, mtime, strlen(path), id) AS dup_of FROM m)
SELECT 'duplicate' AS what, id, dup_of::varchar AS value, NULL::double AS conf FROM r WHERE id<>dup_of
UNION ALL SELECT 'date', id, strftime(to_timestamp(secs) AT TIME ZONE 'UTC','%Y-%m-%d %H:%M:%S')||' '||prec||' '||source||CASE WHEN src<>'manual' AND conf<0.55 THEN ' ?' ELSE '' END, round(conf,6) FROM fin
UNION ALL SELECT 'tag', live.id, tag, round(conf,6) FROM live JOIN picked ON picked.id=live.id%(SELECT count(*) FROM embeddings) WHERE rank<=8""")
def watched(spark, sf):
    """Duplicates, dates and tags of the watched folder: those of one batch over the files that are left."""
    catalog = live_catalog(spark, sf)
    row = lambda df, what, value, conf: df.select(F.lit(what).alias("what"), "id", value.alias("value"), conf.alias("conf"))
    d = catalog.decisions()
    date = F.concat_ws(" ", civil.civil_str("date_secs"), F.col("date_prec").cast("string"), "date_source", F.when(F.col("needs_review"), "?"))
    tagged = d.select("id", F.explode("picked").alias("t"))
    found = row(d, "date", date, F.round("date_conf", 6)).unionByName(row(tagged, "tag", F.col("t.tag"), F.round("t.conf", 6)))
    return found.unionByName(row(catalog.duplicates(), "duplicate", F.col("dup_of").cast("string"), F.lit(None).cast("double")))
