"""Parsers of landed listings, pages and posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom import fixed
from caseloom.functions.text import find_all
from caseloom.functions.urls import file_type, normalize_url, safe_filename, url_filename

ANCHOR = r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'


def html_links(pages: DataFrame, key: str, extensions: Sequence[str] | None = fixed.LINK_EXTENSIONS,
               paths: Sequence[str] = fixed.MEDIA_PATHS) -> DataFrame:
    """Links of landed pages: absolute address, file name, type, text. No extensions keeps every link."""
    host = F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]*)", 1)
    href = F.regexp_extract("a", ANCHOR, 1)
    text = F.trim(F.regexp_replace(F.regexp_extract("a", ANCHOR, 2), "<[^>]*>", ""))
    links = (
        pages.select(key, host.alias("host"), F.posexplode(find_all(F.col("html"), ANCHOR)).alias("pos", "a"))
        .select(key, "pos", F.when(F.startswith(href, F.lit("/")), F.concat("host", href)).otherwise(href).alias("link"),
                text.alias("link_text"))
    )
    if extensions:
        low, wanted = F.lower("link"), F.lit(False)
        for ext in extensions:
            wanted = wanted | F.endswith(low, F.lit(f".{ext}"))
        for path in paths:
            wanted = wanted | F.contains(low, F.lit(path))
        links = links.filter(wanted)
    return links.withColumn("filename", safe_filename(url_filename(F.col("link")))).withColumn(
        "file_type", file_type(F.col("filename")))


def text_links(posts: DataFrame, key: str, text: Column) -> DataFrame:
    """File addresses and magnet links in free text, one row each."""
    files = r"(?i)https?://[^\s\"'<>)\]]+\.(?:" + "|".join(e.replace(".", r"\.") for e in fixed.ARCHIVE_EXTENSIONS) + ")"
    magnets = r"magnet:\?xt=urn:[^\s\"'<>)\]]+"
    found = F.concat(
        F.transform(find_all(text, files), lambda u: F.struct(u.alias("url"), F.lit(False).alias("is_magnet"))),
        F.transform(find_all(text, magnets), lambda u: F.struct(u.alias("url"), F.lit(True).alias("is_magnet"))))
    rows = posts.select(key, F.explode(found).alias("r")).select(key, "r.url", "r.is_magnet")
    name = F.when(F.col("is_magnet"), F.concat(F.lit("magnet_from_"), F.col(key).cast("string"))).otherwise(
        safe_filename(url_filename(F.col("url"))))
    return rows.withColumn("filename", name)


def inventory(sources: Sequence[tuple[str, DataFrame]], key: str = "url") -> DataFrame:
    """All source listings as one; an address keeps the row of the first source that lists it."""
    union = None
    for rank, (name, df) in enumerate(sources):
        part = df.withColumn("source", F.lit(name)).withColumn("source_rank", F.lit(rank))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    rest = [c for c in union.columns if c not in (key, "source_rank")]
    best = union.withColumn("_k", normalize_url(F.col(key))).groupBy("_k").agg(
        F.min(F.struct("source_rank", key, *rest)).alias("_r"))
    return best.select(F.col("_k").alias("address"), F.col(f"_r.{key}").alias(key),
                       *[F.col(f"_r.{c}").alias(c) for c in rest])


def listing_rows(df: DataFrame, key: str, listing: str) -> DataFrame:
    """A header row followed by value rows (JSON arrays) flattened to (row, field, value)."""
    rows = df.withColumn("_rows", F.from_json(listing, "array<array<string>>"))
    body = rows.select(key, F.element_at("_rows", 1).alias("_head"),
                       F.posexplode(F.slice("_rows", F.lit(2), F.greatest(F.size("_rows") - 1, F.lit(0)))).alias("row", "_v"))
    return body.select(key, "row", F.explode(F.map_from_arrays("_head", "_v")).alias("field", "value"))


def latest_snapshot(df: DataFrame, key: str, stamp: str, tie: str) -> DataFrame:
    """Number of captures and the last capture per key."""
    last = F.max(F.struct(stamp, tie))
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("snapshots"), last.getField(stamp).alias("last_ts"),
                               last.getField(tie).alias("last_id"))
