"""Names: canonical forms, matching, debris tests, type and relation synonyms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom import fixed
from caseloom.operators.scoring import literal_map


def squeeze(c: Column) -> Column:
    """Single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_name(c: Column) -> Column:
    """Canonical name: one title and one suffix removed, blanks squeezed, upper case."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), fixed.TITLE, ""), fixed.SUFFIX, "")
    return F.upper(squeeze(F.coalesce(bare, F.lit(""))))


def title_name(c: Column) -> Column:
    return F.initcap(squeeze(c))


def match_form(c: Column) -> Column:
    """What ``forms_match`` compares: lower case, single blanks."""
    return F.lower(squeeze(c))


def names_match(a: Column, b: Column) -> Column:
    """Equal, or one contains the other: from 6 letters anywhere, 4-5 letters as whole words."""
    return forms_match(match_form(a), match_form(b))


def forms_match(x: Column, y: Column) -> Column:
    """``names_match`` of forms that were made before, once a name instead of once a pair."""
    def inside(small: Column, large: Column) -> Column:
        padded = F.contains(F.concat(F.lit(" "), large, F.lit(" ")), F.concat(F.lit(" "), small, F.lit(" ")))
        size = F.length(small)
        return ((size >= 6) & F.contains(large, small)) | ((size >= 4) & (size <= 5) & padded)

    filled = (F.length(x) > 0) & (F.length(y) > 0)
    return F.coalesce(filled & ((x == y) | inside(x, y) | inside(y, x)), F.lit(False))


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def alpha_ratio(c: Column) -> Column:
    """Letters over length."""
    return letters(c) / F.greatest(F.length(c), F.lit(1))


def vowels(c: Column, which: str = "aeiouy") -> Column:
    return F.length(F.regexp_replace(F.lower(c), f"[^{which}]", ""))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def repeated(c: Column) -> Column:
    """Five equal characters in a row."""
    return c.rlike(r"(.)\1{4,}")


def repeated_pairs(c: Column) -> Column:
    """The same two characters four times in a row."""
    return c.rlike(r"(.{2})\1{3,}")


def is_noise(name: Column, kind: Column) -> Column:
    """Debris test used at extraction."""
    s = F.trim(name)
    tokens = words(F.regexp_replace(s, r"[^A-Za-z\s'.-]", ""))
    few_vowels = F.size(F.filter(tokens, lambda w: (F.length(w) >= 5) & (vowels(w) / F.length(w) < 0.2)))
    count = F.size(tokens)
    shape = (
        s.rlike(r"^[A-Z]{1,3}\d{3,}$") | repeated(s) | (count == 0)
        | ((count == 1) & (F.length(F.element_at(tokens, 1)) > 18))
        | ((count >= 2) & (few_vowels >= F.greatest(F.lit(2), F.floor(count / 2))))
    )
    named = kind.isin("person", "organization", "location")
    return F.coalesce((F.length(s) < 2) | (F.length(s) > 200) | s.rlike(r"[\n\r]") | (named & shape), F.lit(True))


def is_garbage(name: Column) -> Column:
    """Stricter debris test for names written by annotators."""
    s = F.trim(name)
    money, tokens = F.startswith(s, F.lit("$")), words(s)
    no_vowel = F.exists(tokens, lambda w: (F.length(F.regexp_replace(w, "[^a-zA-Z]", "")) >= 4) & (vowels(w) == 0))
    odd = F.size(F.filter(tokens, lambda w: (F.length(w) >= 4) & (
        (vowels(w) / F.length(w) < 0.15) | w.rlike(r"(.)\1{2,}"))))
    return F.coalesce(
        (F.length(s) <= 2) | s.rlike(r"[\n\r]")
        | ((alpha_ratio(s) < 0.5) & ~money) | repeated(s) | repeated_pairs(s)
        | (s.rlike(r"(?U)[^\w\s.,'\-/&()#@$%:]") & ~money)
        | (F.contains(s, F.lit("_")) & ~F.lower(s).rlike(r"u\.s\.|u\.k\.|d\.c\."))
        | s.rlike(r"[^aeiouAEIOU\s]{5,}") | no_vowel
        | ((F.size(tokens) == 1) & (F.length(s) > 12))
        | ((F.size(tokens) >= 2) & (odd >= 2) & (odd >= F.size(tokens) * 0.5)), F.lit(True))


def looks_noisy(name: Column) -> Column:
    """Milder debris test of the graph view."""
    s = F.trim(name)
    return F.coalesce(
        (F.length(s) < 3) | s.rlike(r"[\n\r]") | ((alpha_ratio(s) < 0.38) & ~F.startswith(s, F.lit("$")))
        | repeated(s) | repeated_pairs(s) | s.rlike(r"(?U)[^\w\s.,'\-/&()#:$%]"), F.lit(True))


def map_entity_type(c: Column) -> Column:
    return literal_map(fixed.ENTITY_TYPES, "person")(F.lower(F.trim(c)))


def norm_rel_type(c: Column) -> Column:
    return literal_map(fixed.RELATIONS, "associated_with")(F.replace(F.lower(squeeze(c)), F.lit(" "), F.lit("_")))
