"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained from a small labelled URL table (``url``, ``label`` 1 to block, 0 to allow). Every URL becomes the set of its character
n-grams, the host's between ``<`` and ``>``, the path's between ``[`` and ``]``, hashed into ``2^bits`` features; a regularised logistic regression (L-BFGS,
Spark's own) gives each feature a weight. The table is gathered in one partition, so that the sums and with them the model are the same on every
cluster; ``MAX_LABELLED`` rows, those with the smallest hash of the URL, bound it. Judging is one pass over the URLs: no shuffle, no Python.

Rules are a list of ``(verdict, host, path prefix)`` that the caller holds, so plans carry them as literals. A rule fits its host and all subdomains if the path starts
with the rule's; the longest fitting rule wins (by host and path together, then by host, then ``block`` before ``allow``). Without a rule the model decides:
``block`` from a score of ``threshold`` on.

Defined cases: a null URL or one without ``://`` has an empty host and path and is judged by the model like any other; only A-Z are lower-cased, ports and user names stay part of the host; an empty path fits
only rules without a path; labelled rows with a null URL or label are not used, repeated ones count each; an empty table gives no rows; input columns
whose names equal an output column are replaced by it. Training needs both labels and raises ``ValueError`` otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import without

Rule = tuple[str, str, str]
BITS, GRAMS, THRESHOLD, PENALTY, MAX_LABELLED = 18, (3, 4, 5), 0.5, 0.002, 100_000

# fixed values: the rules of the registered query
RULES: list[Rule] = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

# fixed values: a small labelled table, hosts and paths of kinds that public block lists name, and ordinary ones
BLOCKED_URLS = """
https://www.casino-win.test/play  http://best-casino.test/slots/free-spins  https://win-big-casino.test/en/1  https://online-casino-bonus.test/  http://m.casino-royal.test/jackpot
https://free-bets.test/en/12  http://www.sports-bets.test/odds  https://bets-free.test/fr/9.html  http://bet-and-win.test/live  https://daily-bets.test/tips
http://cheap-pills.test/en/5  https://www.cheap-meds.test/order  http://buy-pills-online.test/shop/pills  https://pills-cheap.test/de/31  http://blog.diet-pills.test/offer
https://spam-farm.test/en/7  http://link-farm.test/links/all  https://www.content-farm.test/es/8  http://spam-links.test/go?page=2  https://m.spam-site.test/x
http://ads-track.test/pixel  https://www.ad-tracker.test/click/99  http://track-ads.test/r.gif  https://ads-server.test/banner/3  http://tracking-ads.test/en/2
https://adult-x.test/en/4  http://www.xxx-adult.test/videos  https://adult-cams.test/live  http://m.adult-x-video.test/fr/6  https://x-adult.test/hot
"""
ALLOWED_URLS = """
https://www.thenews.test/en/2024/election  http://blog.garden.test/spring  https://docs.python.test/library/re.html  https://en.encyclopedia.test/wiki/River  http://www.library.test/catalogue/11
https://www.university.test/physics/papers  http://m.weather.test/de/berlin  https://recipes.test/bread.html  https://www.museum.test/fr/visite  http://blog.mathematics.test/primes
https://forum.astronomy.test/threads/42  http://www.citycouncil.test/en/meeting/7  https://history.test/es/siglo  https://maps.test/route?from=a  http://therain.test/en/100
https://www.theother.test/de/200  http://m.thenation.test/en/5  https://blog.another.test/fr/33/  https://nation.test/en/9  http://www.thorn.test/es/71
https://station.test/en/64  http://www.ration.test/en/12.html  https://trains.test/timetable  https://music.test/en/scores/8  http://shop.bookstore.test/novels
https://www.hospital.test/contact  http://school.test/lessons/maths  https://code.test/project/readme  https://photos.test/album/3  http://m.thread.test/en/77
https://theatre.test/en/programme  http://www.threads.test/de/18  https://blog.health.test/en/sleep  http://with.test/en/6#top  https://onion.test/en/14?page=2
http://www.whether.test/es/2  https://handbook.test/en/index.html  http://reading.test/en/1  https://www.tiger.test/fr/28  http://blog.thing.test/en/50
"""


def labelled_urls(spark: SparkSession) -> DataFrame:
    """``url, label``: the small labelled table that the registered query is trained from."""
    rows = [(u, 1) for u in BLOCKED_URLS.split()] + [(u, 0) for u in ALLOWED_URLS.split()]
    return spark.createDataFrame(rows, "url string, label int")


def host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/ ? #``, A-Z lower-cased."""
    text = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host_col: Column, path_col: Column, rules: Sequence[Rule]) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits, else null."""
    ranked = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]), r[0] != "block", r[1], r[2]))
    if not ranked:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    found = [F.when(((host_col == h) | host_col.endswith(f".{h}")) & path_col.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in ranked]
    return F.coalesce(*found)


def _grams(text: Column, sizes: Sequence[int]) -> Column:
    """All n-grams of a text, put together from its list of characters: the cost grows with the length only."""
    letters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))

    def of(chars: Column, n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))
        return F.when(F.size(chars) >= n, grams).otherwise(F.array().cast("array<string>"))

    # the list is computed once a text and bound by a one-element transform
    return F.flatten(F.transform(F.array(letters), lambda chars: F.flatten(F.array(*[of(chars, n) for n in sizes]))))


def grams(host_col: Column, path_col: Column, sizes: Sequence[int] = GRAMS) -> Column:
    """The character n-grams of host and path; those of the host differ from those of the path by a leading ``h``."""
    mark = lambda c, a, z: F.concat(F.lit(a), c, F.lit(z))
    hosts = F.transform(_grams(mark(host_col, "<", ">"), sizes), lambda g: F.concat(F.lit("h"), g))
    return F.concat(hosts, F.transform(_grams(mark(path_col, "[", "]"), sizes), lambda g: F.concat(F.lit("p"), g)))


def featured(df: DataFrame, url_col: str, bits: int, sizes: Sequence[int]) -> DataFrame:
    hashing = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=1 << bits, binary=True)
    return hashing.transform(df.withColumn("_grams", grams(host(F.col(url_col)), path(F.col(url_col)), sizes))).drop("_grams")


def fit(labelled: DataFrame, bits: int = BITS, sizes: Sequence[int] = GRAMS, penalty: float = PENALTY, max_labelled: int = MAX_LABELLED):
    """A logistic regression from ``url, label``; ``max_labelled`` bounds the rows of the fit."""
    rows = labelled.where("url is not null and label is not null").select("url", F.col("label").cast("double").alias("label"))
    bounded = rows.orderBy(F.xxhash64("url"), "url", "label").limit(max_labelled).coalesce(1)
    labels = bounded.agg(F.countDistinct("label")).first()[0]
    if labels != 2:
        raise ValueError(f"a model needs labelled URLs of both kinds; there are {labels}")
    model = LogisticRegression(featuresCol="_features", labelCol="label", regParam=penalty, maxIter=200, standardization=False, aggregationDepth=2)
    return model.fit(featured(bounded, "url", bits, sizes))


def judge(df: DataFrame, model, rules: Sequence[Rule] = (), url_col: str = "url", threshold: float = THRESHOLD, sizes: Sequence[int] = GRAMS) -> DataFrame:
    """The input's columns with ``host, path, rule, verdict, score``; ``score`` is the model's probability that the URL is to be blocked."""
    bits = model.numFeatures.bit_length() - 1
    base = df.select(*without(df, "host", "path", "rule", "verdict", "score"), F.col(url_col).alias("_url"))
    scored = model.transform(featured(base, "_url", bits, sizes))
    own = {"host": host(F.col("_url")), "path": path(F.col("_url")), "score": vector_to_array(F.col(model.getProbabilityCol()))[1]}
    found = scored.withColumns(own).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return found.select(*without(df, "host", "path", "rule", "verdict", "score"), "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "score")


def filter_urls(df: DataFrame, model, rules: Sequence[Rule] = (), url_col: str = "url") -> DataFrame:
    """The rows whose URL is allowed, with their own columns."""
    judged = judge(df.select(F.struct(*df.columns).alias("_row"), F.col(url_col).alias("_given")), model, rules, "_given")
    return judged.where("verdict = 'allow'").select("_row.*")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules, else by the model."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, fit(labelled_urls(spark)), RULES).select("page_id", "host", "path", "rule", "verdict", "score")
