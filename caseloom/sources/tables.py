"""Scans, manifests, upserts and append-only logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHOLE_FILE_BYTES = 1 << 30  # one file is one value, which cannot hold more than 2 GB


def scan(spark: SparkSession, path: str, columns: Sequence[str], where: Column | None = None) -> DataFrame:
    """Parquet scan; filter and columns reach the reader."""
    df = spark.read.parquet(path)
    return (df.filter(where) if where is not None else df).select(*columns)


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, content, size) of all landed files; content is null where a file is too large for one value."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    found = files.load(folder).withColumnRenamed("length", "size_bytes")
    small = found.filter(F.col("size_bytes") <= WHOLE_FILE_BYTES).select("path", "content", "size_bytes")
    large = found.filter(F.col("size_bytes") > WHOLE_FILE_BYTES)
    return small.unionByName(large.select("path", F.lit(None).cast("binary").alias("content"), "size_bytes"))


def manifest(files: DataFrame) -> DataFrame:
    """path, SHA-256 and size of each landed file; a file without content keeps its row, with no hash."""
    size = F.octet_length("content").cast("long")
    if "size_bytes" in files.columns:
        size = F.coalesce(size, "size_bytes")
    return files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), size.alias("size_bytes"))


def register_unseen(entries: DataFrame, known: DataFrame) -> DataFrame:
    """One entry (lowest path) per content hash that the known manifest lacks."""
    first = entries.groupBy("sha256").agg(F.min("path").alias("path"), F.max("size_bytes").alias("size_bytes"))
    return first.join(known.select("sha256"), "sha256", "left_anti").select("path", "sha256", "size_bytes")


def exact_copies(df: DataFrame, key: str, content: Column) -> DataFrame:
    """(key of the first arrival, content hash, number of copies) per distinct content.

    Only hashes and keys are shuffled, combined on the map side, so a content
    with very many copies costs one row per map task.
    """
    return df.select(F.col(key), F.sha2(content, 256).alias("content_hash")).groupBy("content_hash").agg(
        F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))


def upsert_first_wins(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], fill: Sequence[str],
                      order: str, union: str | None = None) -> DataFrame:
    """Known keys keep their values; null attributes are filled by the first later value; lists are united."""
    keys = list(keys)
    both = existing.withColumn("_b", F.lit(0)).unionByName(
        incoming.withColumn("_b", F.lit(1)), allowMissingColumns=True).withColumn("_o", F.struct("_b", order))
    aggs = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_o"))).alias(c) for c in fill]
    rows = both.groupBy(*keys).agg(F.min("_o").getField(order).alias(order), *aggs)
    if union is None:
        return rows
    lists = (
        both.select(*keys, F.explode(union).alias("_item")).distinct()
        .groupBy(*keys).agg(F.array_sort(F.collect_set("_item")).alias(union))
    )
    return rows.join(lists, keys, "left").withColumn(union, F.coalesce(union, F.array().cast("array<string>")))


def upsert_last_wins(rows: DataFrame, key: str, version: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The newest row of each key."""
    newest = rows.groupBy(key).agg(F.max(F.struct(*version, *columns)).alias("_r"))
    return newest.select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
