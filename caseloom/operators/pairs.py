"""Pairs of items that share a group, with hot groups cut into tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.session import cut

TILE = 256  # rows of one group that a single task may pair up


def _tiled_pairs(rows: DataFrame, group: list[str], item: str, tile: int) -> DataFrame:
    """Pairs of hot groups: k parts make k(k+1)/2 tiles, each a join key of its own."""
    distinct = rows.distinct()
    parts = distinct.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / tile).alias("_parts"))
    base = distinct.join(parts, group).withColumn("_part", F.pmod(F.xxhash64(item), F.col("_parts")))
    left = base.select(
        *group, F.col(item).alias("_x"), F.col("_part").alias("_ti"),
        F.explode(F.sequence("_part", F.col("_parts") - 1)).alias("_tj"))
    right = base.select(
        *group, F.col(item).alias("_y"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_part"))).alias("_ti"),
        F.col("_part").alias("_tj"))
    return (
        left.join(right, [*group, "_ti", "_tj"])
        .filter((F.col("_x") != F.col("_y")) & ((F.col("_ti") < F.col("_tj")) | (F.col("_x") < F.col("_y"))))
        .select(*group, F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))
    )


def shared_pairs(members: DataFrame, group: str | list[str], item: str, tile: int = TILE) -> DataFrame:
    """(group, a, b) for each unordered pair a < b of distinct items of a group, named by one or more columns.

    Groups of at most ``tile`` rows are gathered once, by group, and paired in
    place. The others are few; they are written down first and cut into tiles, so that one hot group
    is spread over many tasks. Nothing is left out on either way.
    """
    group = [group] if isinstance(group, str) else group
    rows = members.select(*group, item)
    hot = cut(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > tile).select(*group), "hot")
    some = not hot.isEmpty()
    gathered = (rows.join(hot, group, "left_anti") if some else rows).groupBy(*group).agg(F.array_sort(F.collect_set(item)).alias("_items"))
    paired = (
        gathered.select(*group, "_items", F.posexplode("_items").alias("_i", "a"))
        .select(*group, "a", F.explode(F.slice("_items", F.col("_i") + 2, F.size("_items"))).alias("b"))
    )
    return paired.unionByName(_tiled_pairs(rows.join(hot, group, "left_semi"), group, item, tile)) if some else paired


def pair_counts(members: DataFrame, group: str, item: str, at_least: int = 1, tile: int = TILE) -> DataFrame:
    """(a, b, groups): number of shared groups, kept from ``at_least``. Counting combines on the map side."""
    counted = shared_pairs(members, group, item, tile).groupBy("a", "b").agg(F.count(F.lit(1)).alias("groups"))
    return counted.filter(F.col("groups") >= at_least)
