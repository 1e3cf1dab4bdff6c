"""A training-data pipeline over ``documents``: language, near duplicates, repeated passages, personal data, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again for the next one. All but the last return
the columns of ``documents``; ``n_chars`` follows the text. The last returns pieces of token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalogspark.llm import language, packing, partenum, pii, suffixes
from catalogspark.llm.common import documents, prepare, written

WORDS, PERCENT = 5, 80


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject go; what has a text in a learned language stays."""
    prepare(spark)
    model = language.fit(language.labelled_sample(docs, F.lit(True)))
    return language.identify(docs, model).where("not rejected").select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by similarity, directly or through others, the one with the smallest id stays; of repeated rows one."""
    prepare(spark)
    found = partenum.near_duplicates(docs.select("doc_id", "text"), words=WORDS, percent=PERCENT)
    kept = found.where((F.col("n_shingles") > 0) & (F.col("component") == F.struct("ord", "tid"))).select(F.col("tid").alias("_tid")).distinct()
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    named = docs.withColumn("_tid", F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(partenum.LAST)), F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    first = Window.partitionBy("_tid").orderBy("n_chars")
    chosen = named.where(has_words).join(kept, "_tid").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return chosen.select(*docs.columns).unionByName(docs.where(~has_words))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that a document with a smaller id has are cut; a letter that loses some of its bytes goes whole."""
    prepare(spark)
    cut = suffixes.remove_repeats(docs, as_text=True).withColumnRenamed("kept", "text")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    prepare(spark)
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_each_group),
    ("repeated_passages", cut_repeated_passages),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL can't express the models, the tokens or the suffix arrays; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(prepare(spark), sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
