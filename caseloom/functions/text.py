"""Text: normalised tokens, message bodies, subjects, patterns, labels."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom import fixed

# accented Latin letters and their base letters, by Unicode decomposition
_ACCENTED = [chr(i) for i in range(0xC0, 0x180) if len(unicodedata.normalize("NFD", chr(i))) > 1]
_BASE = "".join(unicodedata.normalize("NFD", ch)[0] for ch in _ACCENTED)


def fold(c: Column) -> Column:
    """Lower case without accents; plain ASCII texts skip the letter by letter pass."""
    low = F.lower(c)
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.translate(low, "".join(_ACCENTED), _BASE)).otherwise(low)


def upper(c: Column) -> Column:
    """Upper case letter by letter: the sharp s has its capital, another letter without a single one stays as it is."""
    letters = F.transform(F.split(c, ""), lambda x: F.when(x == "\u00DF", "\u1E9E").when(
        F.length(F.upper(x)) == 1, F.upper(x)).otherwise(x))
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.array_join(letters, "")).otherwise(F.upper(c))


def token_text(c: Column) -> Column:
    """Folded words joined by single blanks: the searchable form of a text."""
    return F.trim(F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", " "))


def phrase_words(phrase: str) -> str:
    """The same form of a query text, made on the driver."""
    plain = "".join(ch for ch in unicodedata.normalize("NFD", phrase.lower()) if not unicodedata.combining(ch))
    return " ".join("".join(ch if ch.isalnum() else " " for ch in plain).split())


def phrase_pattern(words: str) -> str:
    """Matches lower-case text where ``words`` (from ``phrase_words``) follow each other, with any accents."""
    def letter(ch: str) -> str:
        accented = "".join(a for a, base in zip(_ACCENTED, _BASE) if base == ch)
        return f"[{ch}{accented}]" if accented else ch

    between = r"[^\p{L}\p{N}]+".join("".join(map(letter, word)) for word in words.split())
    return rf"(?<![\p{{L}}\p{{N}}]){between}(?![\p{{L}}\p{{N}}])"


def tokens(c: Column) -> Column:
    return F.filter(F.split(token_text(c), " "), lambda w: w != "")


def clean_body(c: Column) -> Column:
    """Body without quoted lines, ``On … wrote:`` lines and the original-message block."""
    body = F.regexp_replace(c, r"(?is)-{3,}\s*Original Message\s*-{3,}.*", "")
    return F.trim(F.regexp_replace(body, r"(?mi)^>[^\n]*$|^On [^\n]+ wrote:[^\n]*$", ""))


def normalize_subject(c: Column) -> Column:
    """Subject without reply prefixes, lower case, blanks squeezed."""
    bare = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"(?i)^(?:(?:re|fw|fwd)\s*:\s*)+", "")
    return F.regexp_replace(F.trim(F.lower(bare)), r"\s+", " ")


def thread_key(subject: Column, people: Column) -> Column:
    """First 32 hex digits of the hash of subject and sorted participants."""
    seed = F.concat(normalize_subject(subject), F.lit("|"), F.array_join(F.array_sort(F.array_distinct(people)), ","))
    return F.substring(F.sha2(seed, 256), 1, 32)


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def around(text: Column, piece: Column, width: int) -> Column:
    """Up to ``width`` characters on both sides of the first occurrence of ``piece``."""
    start = F.instr(text, piece)
    first = F.greatest(start - width, F.lit(1))
    return F.substr(text, first, start + F.length(piece) + width - first)


def registry_ids(*texts: Column) -> Column:
    """Sorted distinct registry ids of several texts."""
    found = find_all(F.upper(F.concat_ws(" ", *texts)), fixed.REGISTRY_ID)
    return F.array_sort(F.array_distinct(found))


def split_context(text: Column, ratio: Column, width: int = 500) -> tuple[Column, Column]:
    """Text before and after a relative position on the page, by lines."""
    lines = F.split(text, "\n")
    cut = F.greatest(F.lit(0), F.least(F.floor(ratio * F.size(lines)).cast("int"), F.size(lines) - 1))
    before = F.array_join(F.slice(lines, F.lit(1), cut), "\n")
    after = F.array_join(F.slice(lines, cut + 1, F.size(lines)), "\n")
    tail = F.substr(before, F.greatest(F.length(before) - width + 1, F.lit(1)), F.lit(width))
    return F.nullif(tail, F.lit("")), F.nullif(F.substring(after, 1, width), F.lit(""))


def truncate(c: Column, size: int = 300) -> Column:
    return F.when(F.length(c) <= size, c).otherwise(F.concat(F.substring(c, 1, size - 3), F.lit("...")))


def score_label(c: Column) -> Column:
    return F.when(c >= 75, "HIGH").when(c >= 50, "MEDIUM").when(c >= 25, "LOW").otherwise("MINIMAL")


def categorize(c: Column, groups=None) -> Column:
    """Name of the first keyword group with a keyword in the text."""
    low, result = F.lower(F.coalesce(c, F.lit(""))), None
    for name, keywords in groups or fixed.CATEGORIES:
        hit = contains_any(low, keywords)
        result = F.when(hit, name) if result is None else result.when(hit, name)
    return result.otherwise("other")


def contains_any(c: Column, needles) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(c, F.lit(needle))
    return hit


def confidence_class(top: Column, agreement: Column) -> Column:
    agreed = agreement.isin("full", "majority")
    return F.when((top >= 85) & agreed, "confirmed").when((top >= 60) | agreed, "likely").otherwise("unverified")


def pattern_class(score: Column) -> Column:
    return (F.when(score >= 0.85, "very_high").when(score >= 0.70, "high").when(score >= 0.50, "medium")
            .when(score >= 0.30, "low").otherwise("very_low"))


def token_overlap(name: Column, context: Column) -> Column:
    """Share of the distinct words of the name that occur in the context."""
    mine = F.array_distinct(F.filter(F.split(F.lower(name), r"\s+"), lambda w: w != ""))
    return F.size(F.array_intersect(mine, F.split(F.lower(context), r"\s+"))) / F.greatest(F.size(mine), F.lit(1))


def stem_hints(name: Column) -> dict[str, Column]:
    """Ten points per document type that the file name hints at."""
    low, points = F.lower(name), {}
    for kind, parts in fixed.STEM_HINTS.items():
        hit = contains_any(low, parts)
        for ending in fixed.STEM_ENDINGS.get(kind, []):
            hit = hit | F.endswith(low, F.lit(ending))
        points[kind] = F.when(hit, 10).otherwise(0)
    return points


def _addresses(raw: Column) -> Column:
    """Parts of an address line, one per address."""
    parts = F.filter(F.transform(F.split(raw, "[;,]"), lambda p: F.trim(p)), lambda p: p != "")

    def key(p):
        found = F.regexp_extract(p, fixed.EMAIL, 0)
        return F.lower(F.when(found != "", found).otherwise(p))

    keyed = F.transform(parts, lambda p: F.struct(key(p).alias("k"), p.alias("p")))
    keys = F.transform(keyed, lambda s: s["k"])
    first = F.filter(keyed, lambda s, i: F.array_position(keys, s["k"]) == i + 1)
    return F.coalesce(F.transform(first, lambda s: s["p"]), F.array().cast("array<string>"))


def _first(pattern: str, c: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(c, pattern, 1)), F.lit(""))


def email_fields(df: DataFrame, text: str) -> DataFrame:
    """Adds from_name, from_address, to, cc, subject, date and body of a message text.

    Steps are columns of their own, so that no header is searched twice.
    """
    names = {"_from": "From", "_to": "To", "_cc": "CC", "_subject": "Subject", "_date": "Date|Sent"}
    head = df.withColumn("_win", F.col(text)).select(
        "*", find_all(F.col("_win"), fixed.EMAIL).alias("_found"),
        *[F.regexp_extract(text, rf"(?i)(?:^|\n)\s*(?:{h})\s*:\s*[^\n]+", 0).alias(c) for c, h in names.items()])
    value = {c: _first(r"^\s*[A-Za-z]+\s*:\s*([^\n]+)", c).alias(c + "_v") for c in names}
    ends = [F.when(F.col(c) != "", F.instr(F.col(text), F.col(c)) + F.length(c)).otherwise(F.lit(1)) for c in names]
    lowered = F.transform("_found", lambda a: F.lower(a))
    step = head.select("*", *value.values(), F.greatest(*ends).alias("_start"), lowered.alias("_keys"))
    step = step.withColumn("_seen", F.filter("_found", lambda a, i: F.array_position("_keys", F.lower(a)) == i + 1))
    step = step.withColumn("_own", F.nullif(F.regexp_extract("_from_v", fixed.EMAIL, 0), F.lit("")))
    step = step.withColumn("from_address", F.coalesce("_own", F.get("_seen", F.lit(0)))).withColumn(
        "_listed", _addresses(F.col("_to_v")))
    bare = F.regexp_replace(F.replace(F.col("_from_v"), F.col("_own"), F.lit("")), "^[ <>\t\"']+|[ <>\t\"']+$", "")
    start = F.col("_start")
    return step.select(
        *df.columns, F.coalesce(F.when(F.col("_own").isNotNull(), bare), "_from_v", "from_address").alias("from_name"), "from_address",
        F.when((F.size("_listed") == 0) & (F.size("_seen") > 1), F.slice("_seen", F.lit(2), F.size("_seen") - 1)).otherwise(F.col("_listed")).alias("to"),
        _addresses(F.col("_cc_v")).alias("cc"), F.coalesce("_subject_v", _first(fixed.SUBJECT_HINT, "_win")).alias("subject"),
        F.coalesce("_date_v", _first(fixed.DAY_HINT, "_win")).alias("date"),
        F.when(start > 1, F.regexp_replace(F.substr(F.col(text), start), r"^\s+|\s+$", "")).otherwise(F.col(text)).alias("body"))
