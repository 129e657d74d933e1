"""Predicates, searches and integrity checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.text import phrase_pattern, phrase_words, token_text
from caseloom.operators.skew import page_of


def where_all(df: DataFrame, equal: Mapping | None = None, at_least: Mapping | None = None,
              at_most: Mapping | None = None, among: Mapping | None = None) -> DataFrame:
    """AND of the predicates that are given; a value of None switches its predicate off."""
    tests = [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    tests += [F.col(c) >= v for c, v in (at_least or {}).items() if v is not None]
    tests += [F.col(c) <= v for c, v in (at_most or {}).items() if v is not None]
    tests += [F.col(c).isin(list(v)) for c, v in (among or {}).items() if v is not None]
    for test in tests:
        df = df.filter(test)
    return df


def contains_literal(c: Column, needle: str) -> Column:
    """Case-insensitive contains; % and _ stand for themselves."""
    return F.contains(F.lower(c), F.lit(needle.lower()))


def phrase_hits(df: DataFrame, text: str, phrase: str) -> DataFrame:
    """Rows with the words of the phrase in sequence; a phrase without words is matched literally."""
    words = phrase_words(phrase)
    if words:
        return df.filter(F.lower(text).rlike(phrase_pattern(words)))
    return df.filter(contains_literal(F.col(text), phrase))


def snippet(c: Column, words: str, size: int = 64) -> Column:
    """Window of ``size`` tokens around the first hit, the hit in brackets; else the first 200 characters."""
    pad, count = F.lit(" "), len(words.split())
    norm = F.concat(pad, token_text(c), pad)
    at = F.instr(norm, f" {words} ")
    tokens = F.split(token_text(c), " ")
    pos = F.size(F.split(F.substr(norm, F.lit(1), at), " ")) - 1  # 1-based index of the first hit token
    first = F.greatest(pos - size // 2, F.lit(1))
    left = F.slice(tokens, first, pos - first)
    right = F.slice(tokens, pos + count, F.greatest(first + size - pos - count, F.lit(0)))
    marked = F.concat(left, F.array(F.lit(f"[{words}]")), right)
    return F.when(at > 0, F.array_join(marked, " ")).otherwise(c)


def outside_domain(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows whose coded value is not in its list."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(list(allowed)))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows with a key that the parent lacks."""
    keys = parent.select(F.col(parent_key).alias(child_key))
    return child.filter(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def safe_number(c: Column, default: float = 0.0) -> Column:
    """Number or default; NaN and infinities count as missing."""
    n = c.try_cast("double")
    finite = ~F.isnan(n) & (F.abs(n) != F.lit(float("inf")))
    return F.when(n.isNotNull() & finite, n).otherwise(F.lit(default))


def in_request_order(df: DataFrame, key: str, ids: Sequence[int]) -> DataFrame:
    """Rows of the requested ids in the order of the request; unknown ids drop out."""
    seen = list(dict.fromkeys(int(i) for i in ids))
    wanted = df.sparkSession.createDataFrame(list(enumerate(seen)), f"pos int, {key} long")
    return df.join(wanted, key).orderBy("pos")


def derived_state(status: Column, flagged: Column) -> Column:
    return F.when(flagged, "flagged").when(status == "F", "done").when(status == "P", "running").otherwise("pending")


def document_page(docs: DataFrame, key: str, state: str | None, bucket: Column, order: Sequence[Column], page: int, size: int,
                  descending: bool = False) -> DataFrame:
    """Documents of one state in the order (bucket, *order, key), one page of them, with its position; only the buckets that meet the page are ordered."""
    kept = docs if state is None else docs.filter(F.col("state") == state)
    return page_of(kept.withColumn("_bucket", bucket), "_bucket", [*order, F.asc(key)], page, size, descending).drop("_bucket")
