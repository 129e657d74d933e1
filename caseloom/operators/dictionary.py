"""Names of a dictionary found in texts, the longest first, by joins on word runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions.text import token_text


def longest_matches(texts: DataFrame, text_id: str, text: str, terms: DataFrame, term_id: str, term: str) -> DataFrame:
    """(text_id, place, words, term_id): terms in each text from left to right, at each place the longest, none inside or across another.

    Texts and terms are compared by their folded words; ``place`` counts words from 1. Every run of as many words as some term has becomes
    the key of one equality join, so a text costs its words times the number of different term lengths, and texts are not joined to
    terms. The walk from left to right is over the matches of one text. A term that several ids spell stands for the lowest of them.
    """
    spelt = terms.select(term_id, token_text(F.col(term)).alias("_t")).filter("_t <> ''").groupBy("_t").agg(F.min(term_id).alias(term_id))
    sizes = sorted(r["n"] for r in spelt.select(F.size(F.split("_t", " ")).alias("n")).distinct().collect())  # a few lengths
    words = texts.select(text_id, F.split(token_text(F.col(text)), " ").alias("_w"))
    starts = words.select(text_id, "_w", F.explode(F.sequence(F.lit(1), F.size("_w"))).alias("place"))
    runs = [F.struct(F.lit(n).alias("n"), F.array_join(F.slice("_w", F.col("place"), F.lit(n)), " ").alias("_t"), (F.col("place") + n - 1 <= F.size("_w")).alias("whole"))
            for n in sizes]
    if not runs:
        return texts.select(text_id, F.lit(1).alias("place"), F.lit(1).alias("words")).join(terms.select(term_id).limit(0), F.lit(False))
    keyed = starts.select(text_id, "place", F.explode(F.array(*runs)).alias("r")).filter("r.whole").select(text_id, "place", "r.n", "r._t")
    found = keyed.join(spelt, "_t").groupBy(text_id, "place").agg(F.max(F.struct(F.col("n").alias("words"), term_id)).alias("m"))
    ordered = found.groupBy(text_id).agg(F.array_sort(F.collect_list(F.struct("place", "m.words", f"m.{term_id}"))).alias("_all"))
    kind = ordered.schema["_all"].dataType
    start = F.struct(F.lit(1).alias("next"), F.array().cast(kind).alias("kept"))
    walked = F.aggregate("_all", start, lambda s, m: F.when(
        m["place"] >= s["next"], F.struct((m["place"] + m["words"]).alias("next"), F.concat(s["kept"], F.array(m)).alias("kept"))).otherwise(s))
    return ordered.select(text_id, F.explode(walked["kept"]).alias("m")).select(text_id, "m.place", "m.words", f"m.{term_id}")
