"""Addresses and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom import fixed
from caseloom.operators.scoring import literal_map


def normalize_url(c: Column) -> Column:
    """scheme://host + lower-case path; no query, fragment or trailing slash."""
    host = F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(host, F.regexp_replace(F.lower(path), "/+$", ""))


def url_filename(c: Column) -> Column:
    """Decoded last piece of the path, without the query."""
    last = F.element_at(F.split(F.element_at(F.split(c, "/"), -1), r"\?"), 1)
    return F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)


def extension(c: Column) -> Column:
    """Lower-case suffix with its dot, empty where there is none."""
    return F.lower(F.regexp_extract(c, r"[^/.](\.[^./\\]+)$", 1))


def file_type(c: Column) -> Column:
    return literal_map(fixed.FILE_TYPES, "other")(extension(c))


def safe_filename(c: Column) -> Column:
    """A name every file system takes; at most 200 characters before the suffix."""
    clean = F.replace(F.regexp_replace(c, r'[<>:"/\\|?*]', "_"), F.lit(".."), F.lit("_"))
    clean = F.regexp_replace(clean, r"^[. ]+|[. ]+$", "")
    stem = F.upper(F.regexp_replace(clean, r"\.[^.]*$", ""))
    clean = F.when(stem.isin(fixed.RESERVED_STEMS), F.concat(F.lit("_"), clean)).otherwise(clean)
    suffix = F.regexp_extract(clean, r"[^.](\.[^.]*)$", 1)
    base = F.substring(F.regexp_replace(clean, r"(?<=[^.])\.[^.]*$", ""), 1, 200)
    clean = F.when(F.length(clean) > 200, F.concat(base, suffix)).otherwise(clean)
    return F.when(clean == "", "_unnamed").otherwise(clean)
