"""Set operations on rows and on arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.names import normalize_name
from caseloom.functions.urls import normalize_url


def url_difference(mirror: DataFrame, current: DataFrame, url: str = "url") -> DataFrame:
    """Normalised addresses of the mirror that the current listing lacks."""
    return mirror.select(normalize_url(F.col(url)).alias("address")).subtract(
        current.select(normalize_url(F.col(url)).alias("address")))


def month_sets(mentions: DataFrame, target: int) -> DataFrame:
    """Months shared with a target and months of either, per entity; months come distinct, so arrays stay small."""
    months = mentions.select("entity_id", F.date_format("event_ts", "yyyy-MM").alias("month")).distinct()
    sets = months.groupBy("entity_id").agg(F.collect_list("month").alias("ms"))
    goal = months.filter(F.col("entity_id") == target).agg(F.collect_list("month").alias("ms")).scalar()
    return sets.select("entity_id", F.size(F.array_intersect("ms", goal)).alias("common"),
                       F.size(F.array_union("ms", goal)).alias("either"))


def missing_values(have: Column, available: list[int]) -> Column:
    return F.array_sort(F.array_except(F.array(*[F.lit(v).cast("long") for v in available]), have))


def merge_aliases(existing: Column, new: Column) -> Column:
    """Both lists in order, one spelling (the first) per canonical form."""
    both = F.concat(existing, new)
    keys = F.transform(both, lambda a: normalize_name(a))
    return F.filter(both, lambda a, i: (normalize_name(a) != "") & (F.array_position(keys, normalize_name(a)) == i + 1))
