import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties, and columns named like the operators' own."""
    long_text = " ".join(f"word{i % 977} of{i % 13}" for i in range(20_000))
    rows = [(1, None, "en"), (2, "", None), (3, "  \n ", "en"), (4, long_text, "en"), (5, long_text, "de"), (None, "a null id", "en"),
            (None, "a null id", "en"), (7, "same row", "fr"), (7, "same row", "fr"), (8, "Ünï çødé ☃ 😀", None), (9, "1234 --- ###", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.col("lang")).withColumn(
        "n_chars", F.length("text").cast("long"))
    for name in ("key", "fp", "block", "packed", "runs", "sequence_id", "bucket", "hash", "rank", "label", "piece"):
        df = df.withColumn(name, F.lit("theirs"))
    return df


@pytest.fixture
def none(spark, docs):
    return docs.limit(0)
