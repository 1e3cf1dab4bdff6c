"""Queries: exact and near duplicates as whole jobs."""

from __future__ import annotations

from ..operators import dedupe, similar
from ..sources.views import hashes, view
from .aggregates import KEEPER
from .registry import query


@query("dedupe_exact", using=("docs",), oracle=f"""
WITH k AS (SELECT *, {KEEPER.replace("lang, n_chars%7", "n_chars, md5(body)")} AS rn, count(*) OVER (PARTITION BY n_chars, md5(body)) AS c FROM docs WHERE n_chars>0)
SELECT a.id, b.id AS dup_of, a.n_chars AS size FROM k a JOIN k b ON a.n_chars=b.n_chars AND a.body=b.body AND b.rn=1 WHERE a.c>1 AND a.rn>1""")
def dedupe_exact(spark, sf):
    return dedupe.dedupe_exact(view(spark, sf, "docs"), "n_chars", "body")


# near pairs, components by smallest reachable id, then the member with most pixels, bytes, lowest id
CLUSTERS = """WITH RECURSIVE info AS (SELECT *, w/ht AS r FROM hashes WHERE bit_count(h) BETWEEN 4 AND 60),
e AS (SELECT a.id AS x, b.id AS y FROM info a JOIN info b ON a.id<>b.id AND bit_count(xor(a.h,b.h))<=6 AND (abs(a.r-b.r)/greatest(a.r,b.r)<0.06 OR abs(a.r-1/b.r)/greatest(a.r,1/b.r)<0.06)),
reach(x, y) AS (SELECT id, id FROM info UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x=r.y),
comp AS (SELECT x AS id, min(y) AS c, count(*) AS n FROM reach GROUP BY x),
rep AS (SELECT comp.id, c, n, first_value(i.id) OVER (PARTITION BY c ORDER BY w*ht DESC, sz DESC, i.id) AS rid, i.h FROM comp JOIN info i ON i.id=comp.id)
SELECT rep.id, rid AS similar_to, bit_count(xor(rep.h, t.h))::int AS dist FROM rep JOIN info t ON t.id=rid WHERE n>1 AND rep.id<>rid"""


@query("cluster_similar", using=("hashes",), oracle=CLUSTERS)
def cluster_similar(spark, sf):
    return similar.cluster_similar(hashes(spark, sf), 6)


@query("cluster_similar_hot_keys", using=("hashes",), oracle=CLUSTERS)
def cluster_similar_hot_keys(spark, sf):
    """The same clusters when every block key counts as hot and is refined and cut into chunks."""
    return similar.cluster_similar(hashes(spark, sf), 6, hot_key=2, chunk=2)
