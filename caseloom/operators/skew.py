"""Ordered computations per key that stay parallel when one key is hot.

A plain window puts all rows of a key into one task. Here every key is cut
into buckets that follow the order (a month, a score, a range of ids). Work
happens per (key, bucket); only one row per bucket is ordered per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _per_key(keys: Sequence[str]):
    return Window.partitionBy(*(list(keys) or [F.lit(0)]))


def bucketed_rank(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column],
                  out: str = "rn", descending: bool = False) -> DataFrame:
    """1-based position of each row of a key in the order (bucket, *order)."""
    keys = list(keys)
    by_bucket = F.col(bucket).desc() if descending else F.col(bucket).asc()
    before = _per_key(keys).orderBy(by_bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, bucket)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    return (
        df.withColumn("_local", F.row_number().over(inside))
        .join(offsets, [*keys, bucket])
        .withColumn(out, (F.col("_before") + F.col("_local")).cast("long"))
        .drop("_local", "_before")
    )


def bucketed_neighbours(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str],
                        values: Sequence[str], prev: str | None = None, following: str | None = None) -> DataFrame:
    """Add struct columns holding ``values`` of the previous / following row of the key."""
    keys, order = list(keys), list(order)
    record = F.struct(*order, *[v for v in values if v not in order])
    per_bucket = df.groupBy(*keys, bucket).agg(F.min(record).alias("_first"), F.max(record).alias("_last"))
    chain = _per_key(keys).orderBy(bucket)
    edges = per_bucket.select(
        *keys, bucket, F.lag("_last").over(chain).alias("_in"), F.lead("_first").over(chain).alias("_out")
    )
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    joined = df.join(edges, [*keys, bucket])
    if prev:
        joined = joined.withColumn(prev, F.coalesce(F.lag(record).over(inside), F.col("_in")))
    if following:
        joined = joined.withColumn(following, F.coalesce(F.lead(record).over(inside), F.col("_out")))
    return joined.drop("_in", "_out")


def bucketed_last(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], value: Column,
                  out: str, strict: bool = False) -> DataFrame:
    """Latest non-null ``value`` of the key at or before each row (before it, if ``strict``)."""
    keys, order = list(keys), list(order)
    df = df.withColumn("_v", value)
    seen = df.groupBy(*keys, bucket).agg(
        F.max(F.when(F.col("_v").isNotNull(), F.struct(*order, "_v"))).alias("_newest")
    )
    chain = _per_key(keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carry = seen.select(*keys, bucket, F.last(F.col("_newest._v"), ignorenulls=True).over(chain).alias("_carry"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    return (
        df.join(carry, [*keys, bucket])
        .withColumn(out, F.coalesce(F.last("_v", ignorenulls=True).over(inside), F.col("_carry")))
        .drop("_v", "_carry")
    )


def bucketed_before(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column], value: Column,
                    out: str) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the key."""
    keys = list(keys)
    df = df.withColumn("_v", value)
    chain = _per_key(keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, bucket).agg(F.sum("_v").alias("_s"))
        .select(*keys, bucket, F.coalesce(F.sum("_s").over(chain), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(offsets, [*keys, bucket])
        .withColumn(out, F.col("_before") + F.coalesce(F.sum("_v").over(inside), F.lit(0)))
        .drop("_v", "_before")
    )


def page_of(df: DataFrame, bucket: str, order: Sequence[Column], page: int, size: int,
            descending: bool = False) -> DataFrame:
    """One page of the total order (bucket, *order), with its position and the number of pages.

    A page past either end becomes the nearest one. Only the buckets that meet
    the page are ordered, so a deep page costs as much as a shallow one.
    """
    by = F.col(bucket).desc() if descending else F.col(bucket).asc()
    everything = Window.partitionBy(F.lit(0))
    sizes = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n"))
    upto = everything.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    pages = F.greatest(F.ceil(F.col("_total") / size), F.lit(1))
    placed = (
        sizes.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
        .withColumn("_total", F.sum("_n").over(everything))
        .withColumn("total_pages", pages.cast("long"))
        .withColumn("_from", (F.least(F.lit(max(page, 1)), F.col("total_pages")) - 1) * size)
        .filter((F.col("_before") < F.col("_from") + size) & (F.col("_before") + F.col("_n") > F.col("_from")))
    )
    inside = Window.partitionBy(bucket).orderBy(*order)
    ranked = df.join(placed, bucket).withColumn("position", F.col("_before") + F.row_number().over(inside))
    return ranked.filter((F.col("position") > F.col("_from")) & (F.col("position") <= F.col("_from") + size)).drop(
        "_n", "_before", "_total", "_from")


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, most: int = 20000) -> DataFrame:
    """Inner join where keys with very many rows on the right are cut into parts.

    Rows of a hot key on the right are divided by a hash of ``spread``; left
    rows of that key are copied to every part. Results equal the plain join.
    """
    hot = right.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(
        key, F.ceil(F.col("_n") / most).alias("_parts"))
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    r = right.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(spread), parts)).drop("_parts")
    le = left.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return le.join(r, [key, "_part"]).drop("_part")


def dealt(df: DataFrame, rows: int, *keys: str, each: int = 1 << 17) -> DataFrame:
    """``df`` of ``rows`` rows dealt by ``keys`` to so many tasks that each gets about ``each`` of them, however large the table is.

    Groups and windows over ``keys`` and more columns then work in place.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(-(-rows // each), min(cores, -(-rows // 16384)), 1), *keys)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Share out rows for per-row work when the input has fewer files than there are cores.

    A table of many files is already split and passes through without a shuffle.
    """
    cores, files = df.sparkSession.sparkContext.defaultParallelism, len(df.inputFiles())
    return df.repartition(cores, key) if 0 < files < cores else df
