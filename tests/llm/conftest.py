import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])


@pytest.fixture(scope="session")
def spark(spark):
    from catalogspark.llm.common import prepare

    return prepare(spark)


@pytest.fixture(scope="session")
def table(spark):
    """Documents from ``(doc_id, text[, lang, source])`` rows."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def sentences():
    """Made-up sentences of a few hundred words, repeatable."""

    def make(seed, n=30, pool=400):
        rnd = random.Random(seed)
        words = ["".join(random.Random(k).choice("aeiouklmnrst") for _ in range(3 + k % 7)) for k in range(pool)]
        return " ".join(rnd.choice(words) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def fixture_dir(spark, tmp_path_factory):
    """A folder with a documents table, for the registered queries."""

    def make(df):
        path = tmp_path_factory.mktemp("docs")
        df.write.parquet(f"{path}/documents.parquet")
        return str(path)

    return make
