"""Sharding by proportional stratified interleaving (DataFrame functions only).

Every source is shuffled by a seeded hash; a row's fractional rank is its place among the rows of its
source, shifted by a seeded offset of the source and divided by the number of its rows. Sorted by
fractional rank the sources interleave in proportion, so equal cuts of that order match the mixture.

Ranks never order one source, or all rows, in one task: rows are ranked inside (source, hash range) and
(rank range) buckets of about ``rows_per_bucket`` rows, and running counts of the bucket table are added.

Nulls: a null text counts 0 bytes and its crc32 is that of the empty text; null sources form one source;
null or repeated ids are rows like any other, ordered by their crc32 and size. An empty table gives no
rows. Columns besides id, text and source are ignored. Copies of a text are spread like other rows: the
law ``rows`` allows no group to stay together beyond the size of a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import cut


def _hash32(*parts) -> F.Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def stratified_shards(
    docs: DataFrame, shards: int = 40, seed: int = 17, stratum: str = "source", key: str = "doc_id", text: str = "text",
    rows_per_bucket: int = 10_000,
) -> DataFrame:
    """(doc_id, size, text_crc32, source, shard, slot): shard sizes differ by one row at most."""
    source = F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    rows = cut(docs.select(
        F.col(key).alias("doc_id"), source.alias("source"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        _hash32(F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("h")), "shard-rows")
    order = ["h", "doc_id", "text_crc32", "size"]
    sources = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_source")).withColumn(
        "shift", _hash32(F.lit(str(seed)), F.lit("source"), "source") / F.lit(float(1 << 32)))
    bucketed = cut(rows.join(sources, "source").withColumn(
        "bucket", F.shiftright(F.col("h") * F.ceil(F.col("n_source") / rows_per_bucket), 32)), "shard-buckets")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = bucketed.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    rank = F.col("ahead") + F.row_number().over(Window.partitionBy("source", "bucket").orderBy(*order))
    part = ((F.col("rank") - F.col("shift")) / F.col("n_source")).alias("part")
    ranked = cut(bucketed.join(starts, ["source", "bucket"]).withColumn("rank", rank).select(
        "doc_id", "source", "size", "text_crc32", "h", part), "shard-ranks")
    total = sources.agg(F.coalesce(F.sum("n_source"), F.lit(0)).alias("n")).first().n
    if total == 0:
        return ranked.select("doc_id", "size", "text_crc32", "source", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranges = -(-total // rows_per_bucket)
    ranked = ranked.withColumn("bucket", F.floor(F.col("part") * ranges).cast("long"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranked.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("bucket").orderBy("part", "source", *order)) - 1
    shard = F.expr(f"(place * {shards}) div {total}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return ranked.join(starts, "bucket").withColumn("place", place).withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", "source", "shard", (F.col("place") - first).cast("long").alias("slot"))
