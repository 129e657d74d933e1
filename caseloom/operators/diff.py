"""Differences between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions.urls import normalize_url


def removed(known: DataFrame, current: DataFrame, url: str = "url") -> DataFrame:
    """Known addresses that the current listing no longer has, whatever their spelling."""
    now = current.select(normalize_url(F.col(url)).alias("_k"))
    return known.withColumn("_k", normalize_url(F.col(url))).join(now, "_k", "left_anti").drop("_k")


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """verified, changed, missing or added for every path of two manifests."""
    o = old.select("path", F.col("sha256").alias("_oh"), F.col("size_bytes").alias("_os"))
    n = new.select("path", F.col("sha256").alias("_nh"), F.col("size_bytes").alias("_ns"))
    state = (F.when(F.col("_oh").isNull(), "added").when(F.col("_nh").isNull(), "missing")
             .when((F.col("_oh") == F.col("_nh")) & (F.col("_os") == F.col("_ns")), "verified").otherwise("changed"))
    return o.join(n, "path", "full").select("path", state.alias("state"))
