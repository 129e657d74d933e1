"""Exact text matching by equality joins on keys taken from both sides.

A plain ``contains`` join compares all texts with all needles. Here every
needle gets one key that any text holding it must have too; texts offer the
keys of the kinds in use, and only equal keys are compared. Needles few enough
to be sent to the tasks are looked for where the texts are read instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.text import token_text
from caseloom.operators import needles as few
from caseloom.operators.skew import spread
from caseloom.session import cut

EDGE = 3   # letters taken on each side of a blank
GRAM = 3   # letters of a needle without a blank


def _pairs(c: Column) -> Column:
    """Neighbouring words as an array of (a, b)."""
    words = F.split(c, " ")
    size = F.greatest(F.size(words) - 1, F.lit(0))
    return F.arrays_zip(F.slice(words, F.lit(1), size).alias("a"), F.slice(words, F.lit(2), size).alias("b"))


def _edge_key(a: Column, b: Column, left: Column | int, right: Column | int) -> Column:
    """The ``left`` letters before and the ``right`` letters behind the blank between two words."""
    before, behind = (F.lit(n) if isinstance(n, int) else n for n in (left, right))
    return F.concat(F.right(a, before), F.lit(" "), F.left(b, behind))


def _runs(items: Column, n: int, glue: str) -> Column:
    """All runs of ``n`` neighbouring array items, joined. Shifted copies are zipped, so this is linear."""
    size = F.greatest(F.size(items) - n + 1, F.lit(0))
    shifted = [F.slice(items, F.lit(k + 1), size).alias(f"c{k}") for k in range(n)]
    return F.transform(F.arrays_zip(*shifted), lambda p: F.concat_ws(glue, *[p[f"c{k}"] for k in range(n)]))


KIND = 1000  # of a kind, letters before a blank times this, and letters behind it


def needle_keys(needles: DataFrame, needle_id: str, needle: str, reach: int | None = None) -> DataFrame:
    """(needle_id, kind, key): every key that a text holding the needle must offer.

    Between two words the key takes as many letters of both as they have, at
    most three: the first word may be a suffix and the last a prefix of the
    text's words. A needle of one word gives a leading gram (kind below zero).
    With ``reach`` up to so many letters behind the blank, or of the gram, are taken, so that
    the texts of a key do not grow with the table where words are numbers; each is one more row that a text may offer.
    """
    rows = needles.filter(F.length(needle) > 0).select(needle_id, F.col(needle).alias("_n"), F.explode_outer(_pairs(F.col(needle))).alias("_w"))
    a, b = F.col("_w.a"), F.col("_w.b")
    left = F.least(F.length(a), F.lit(EDGE)) if reach else F.least(F.length(a), F.length(b), F.lit(EDGE))
    right = F.least(F.length(b), F.lit(reach)) if reach else left
    gram = F.substring("_n", 1, reach or GRAM)
    return rows.select(
        needle_id, F.col("_n").alias("_needle"), F.when(F.col("_w").isNull(), -F.length(gram)).otherwise(left * KIND + right).alias("_kind"),
        F.when(F.col("_w").isNull(), gram).otherwise(_edge_key(a, b, left, right)).alias("_key"))


def offered_keys(texts: DataFrame, text_id: str, text: str, kinds: list[int]) -> DataFrame:
    """(text_id, key) of the kinds in use, one row per place in the text."""
    rows, edges = None, [k for k in kinds if k >= 0]
    if edges:
        pairs = texts.select(text_id, F.explode(_pairs(F.col(text))).alias("_w")).select(text_id, "_w.a", "_w.b")
        sizes = [divmod(k, KIND) for k in edges]
        keys = F.array(*[F.when((F.length("a") >= m) & (F.length("b") >= n), _edge_key(F.col("a"), F.col("b"), m, n)) for m, n in sizes])
        rows = pairs.select(text_id, F.explode(keys).alias("_key")).filter(F.col("_key").isNotNull())
    for k in kinds:
        if k < 0:
            grams = texts.select(text_id, F.explode(_runs(F.split(F.col(text), ""), -k, "")).alias("_key"))
            rows = grams if rows is None else rows.unionByName(grams)
    return rows


def containing(texts: DataFrame, text_id: str, text: str, needles: DataFrame, needle_id: str, needle: str,
               reach: int | None = None) -> DataFrame:
    """(text_id, needle_id) where the text contains the needle literally.

    Each needle is looked up by the key that the fewest texts offer; a needle
    with a key that no text offers is in none of them. ``reach`` gives longer keys, for short texts.
    """
    known = few.bounded(needles, needle_id, needle)
    if known is not None:
        return few.occurring(texts, text_id, text, known, needle_id).distinct()
    keyed = needle_keys(needles, needle_id, needle, reach)
    kinds = sorted(r["_kind"] for r in keyed.select("_kind").distinct().collect())  # at most 7 kinds, or 4 times ``reach``
    texts = spread(texts, text_id)
    if not kinds:
        return texts.select(text_id).join(needles.select(needle_id).limit(0), F.lit(False))
    wanted = keyed.select("_key").distinct()
    held = cut(offered_keys(texts, text_id, text, kinds).join(wanted, "_key", "left_semi").distinct(), "keys")
    often = held.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    ranked = keyed.join(often, "_key", "left").groupBy(needle_id, "_needle").agg(
        F.min_by("_key", F.struct("_n", "_key")).alias("_key"), F.count_if(F.col("_n").isNull()).alias("_absent"))
    rare = ranked.filter("_absent = 0").drop("_absent")
    pairs = held.join(rare, "_key").select(text_id, needle_id, "_needle")
    return (
        pairs.join(texts.select(text_id, F.col(text).alias("_text")), text_id)
        .filter(F.contains("_text", F.col("_needle"))).select(text_id, needle_id)
    )


def phrase_matches(texts: DataFrame, text_id: str, text: str, phrases: DataFrame, phrase_id: str,
                   phrase: str) -> DataFrame:
    """(text_id, phrase_id) where the words of the phrase follow each other in the text.

    Each phrase is looked up by its rarest word, so frequent words do not
    multiply candidates.
    """
    normal = phrases.select(phrase_id, token_text(F.col(phrase)).alias("_p")).filter("_p <> ''")
    known = few.bounded(normal.withColumn("_q", F.concat(F.lit(" "), "_p", F.lit(" "))), phrase_id, "_q")
    if known is not None:
        padded = texts.select(text_id, F.concat(F.lit(" "), token_text(F.col(text)), F.lit(" ")).alias("_t"))
        return few.occurring(padded, text_id, "_t", known, phrase_id).distinct()
    texts = spread(texts, text_id)
    words = normal.select(phrase_id, "_p", F.explode(F.array_distinct(F.split("_p", " "))).alias("_w"))
    held = cut(
        texts.select(text_id, F.explode(F.array_distinct(F.split(token_text(F.col(text)), " "))).alias("_w"))
        .join(words.select("_w").distinct(), "_w", "left_semi"), "words")
    often = held.groupBy("_w").agg(F.count(F.lit(1)).alias("_n"))
    ranked = words.join(often, "_w", "left").groupBy(phrase_id, "_p").agg(
        F.min_by("_w", F.struct("_n", "_w")).alias("_w"), F.count_if(F.col("_n").isNull()).alias("_absent"))
    rare = ranked.filter("_absent = 0").drop("_absent")
    pairs = held.join(rare, "_w").select(text_id, phrase_id, "_p")
    asked = texts.join(pairs.select(text_id).distinct(), text_id, "left_semi")  # only these are normalised again
    padded = asked.select(text_id, F.concat(F.lit(" "), token_text(F.col(text)), F.lit(" ")).alias("_t"))
    return (
        pairs.join(padded, text_id)
        .filter(F.contains("_t", F.concat(F.lit(" "), F.col("_p"), F.lit(" ")))).select(text_id, phrase_id)
    )


def placeholder_candidates(contexts: DataFrame, entities: DataFrame, threshold: float = 0.3, protected: DataFrame | None = None) -> DataFrame:
    """(context_id, entity_id, score): 0.6 name in context, 0.5 canonical name, 0.3 half of the name's words.

    ``contexts`` is (context_id, context), ``entities`` (entity_id, name, canonical). Those of ``protected`` (entity_id) are no candidates.
    """
    if protected is not None:
        entities = entities.join(protected.select("entity_id").distinct(), "entity_id", "left_anti")
    low = spread(contexts, "context_id").select("context_id", F.lower("context").alias("context"))
    needles = entities.select("entity_id", F.explode(F.array(
        F.struct(F.lit(0.6).alias("s"), F.lower("name").alias("n")),
        F.struct(F.lit(0.5).alias("s"), F.lower("canonical").alias("n")))).alias("x")).select(
        F.struct("entity_id", "x.s").alias("needle"), "x.n").filter(F.col("n").isNotNull())
    found = containing(low, "context_id", "context", needles, "needle", "n").select(
        "context_id", "needle.entity_id", F.col("needle.s").alias("score"))
    if threshold <= 0.3:
        names = entities.select("entity_id", F.array_distinct(F.filter(
            F.split(F.lower("name"), r"\s+"), lambda w: w != "")).alias("ws"))
        words = names.select("entity_id", F.size("ws").alias("total"), F.explode("ws").alias("w"))
        held = low.select("context_id", F.explode(F.array_distinct(F.split("context", r"\s+"))).alias("w"))
        part = held.join(words, "w").groupBy("context_id", "entity_id").agg(
            (F.count(F.lit(1)) / F.max("total")).alias("share")).filter("share >= 0.5")
        found = found.unionByName(part.select("context_id", "entity_id", F.lit(0.3).alias("score")))
    best = found.groupBy("context_id", "entity_id").agg(F.max("score").alias("score"))
    return best.filter(F.col("score") >= threshold)


def _interior(c: Column) -> Column:
    """Up to three whole words inside an anchor; its first and last pieces may be cut words."""
    words = F.split(c, " ")
    return F.array_join(F.slice(words, F.lit(2), F.greatest(F.least(F.size(words) - 2, F.lit(3)), F.lit(0))), " ")


def between_anchors(text: Column, before: Column, after: Column, size: int) -> Column:
    """Text between the anchors of ``size`` characters, null where it is missing or empty."""
    left, right = F.right(before, F.lit(size)), F.left(after, F.lit(size))
    start = F.instr(text, left)
    rest = F.substr(text, start + F.length(left))
    stop = F.instr(rest, right)
    inside = F.regexp_replace(F.substr(rest, F.lit(1), stop - 1), r"^\s+|\s+$", "")
    return F.when((start > 0) & (stop > 0) & (inside != ""), inside)


def anchor_join(gaps: DataFrame, texts: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """Best passage between both context anchors of each gap, from another document.

    ``gaps`` is (gap_id, doc_id, before, after, expected), ``texts`` (doc_id, text).
    Texts offer runs of one to three words; an anchor without a whole word
    inside falls back to its first eight characters. A passage that holds a
    name of ``protected`` (name) is never returned.
    """
    texts = spread(texts, "doc_id")
    anchor = F.right("before", F.lit(30))
    inner = _interior(anchor)
    count = F.when(inner == "", 0).otherwise(F.size(F.split(inner, " ")))
    keyed = gaps.withColumn("_n", count).withColumn("_key", F.when(count == 0, F.left(anchor, F.lit(8))).otherwise(inner))
    kinds = sorted(r["_n"] for r in keyed.select("_n").distinct().collect())  # at most four values
    words = F.split("text", " ")
    offers = [_runs(words, n, " ") if n else _runs(F.split("text", ""), 8, "") for n in kinds]
    if not offers:
        offers = [F.array().cast("array<string>")]
    hits = (
        texts.select("doc_id", F.explode(F.array_distinct(F.flatten(F.array(*offers)))).alias("_key"))
        .join(keyed.select("_key").distinct(), "_key", "left_semi")
    )
    pairs = hits.withColumnRenamed("doc_id", "found_in").join(keyed, "_key").filter(F.col("found_in") != F.col("doc_id"))
    full = pairs.join(texts.select(F.col("doc_id").alias("found_in"), "text"), "found_in")
    text = F.coalesce(*[between_anchors(F.col("text"), F.col("before"), F.col("after"), n) for n in (30, 50, 80)])
    ratio = F.length("recovered") / F.col("expected")
    score = F.when((F.col("expected") > 0) & (ratio >= 0.7) & (ratio <= 1.3), 0.85).otherwise(0.80)
    found = full.withColumn("recovered", text).filter(F.col("recovered").isNotNull()).withColumn("score", score)
    if protected is not None:
        found = found.withColumn("_place", F.struct("gap_id", "found_in"))
        named = phrase_matches(found.select("_place", "recovered"), "_place", "recovered",
                               protected.select("name").distinct().withColumn("_who", F.col("name")), "_who", "name")
        found = found.join(named.select("_place").distinct(), "_place", "left_anti")
    best = F.max(F.struct("score", (-F.col("found_in")).alias("o"), "recovered", "found_in"))
    return found.groupBy("gap_id").agg(best.alias("m")).select(
        "gap_id", F.col("m.found_in").alias("found_in"), F.col("m.recovered").alias("recovered"),
        F.col("m.score").alias("score"))
