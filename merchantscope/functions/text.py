"""Text column expressions (tokens, similarity). All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_tokens(s: Column) -> Column:
    """Distinct upper-case alphanumeric tokens longer than two characters."""
    parts = F.split(F.upper(F.coalesce(s, F.lit(""))), "[^A-Z0-9]+")
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) > 2))


def space_tokens(s: Column) -> Column:
    """Upper-case tokens between white space, without empty ones."""
    parts = F.split(F.upper(F.coalesce(s, F.lit(""))), r"\s+")
    return F.filter(parts, lambda t: F.length(t) > 0)


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays seen as sets; 1 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(a, b)).cast("double") / union
    )


def name_overlap(name: Column, descriptor: Column) -> Column:
    """Token Jaccard of a descriptor and a name; 0 when either has no token."""
    a, b = name_tokens(name), name_tokens(descriptor)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(set_jaccard(a, b))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein/longer length of the trimmed upper-case strings."""
    x = F.upper(F.trim(F.coalesce(a, F.lit(""))))
    y = F.upper(F.trim(F.coalesce(b, F.lit(""))))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.levenshtein(x, y).cast("double") / longest
    )


def char_trigrams(s: Column) -> Column:
    """Distinct character 3-grams of the normalised, space-padded string."""
    clean = F.regexp_replace(F.upper(F.coalesce(s, F.lit(""))), "[^A-Z0-9]", " ")
    padded = F.concat(F.lit(" "), F.trim(F.regexp_replace(clean, r"\s+", " ")), F.lit(" "))
    grams = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))),
        lambda i: F.substring(padded, i, F.lit(3)),
    )
    return F.array_distinct(F.filter(grams, lambda g: F.length(g) == 3))


def trigram_similarity(a: Column, b: Column) -> Column:
    return set_jaccard(char_trigrams(a), char_trigrams(b))


def best_brand_similarity(descriptor: Column, brands: list[str]) -> Column:
    """Highest trigram similarity to any of the given brands."""
    mine = char_trigrams(descriptor)
    scores = [set_jaccard(mine, char_trigrams(F.lit(b))) for b in brands]
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def generic_share(descriptor: Column, generic: list[str]) -> Column:
    """Share of the descriptor's tokens that are generic words."""
    toks = space_tokens(descriptor)
    hits = F.size(F.filter(toks, lambda t: t.isin(generic))).cast("double")
    return F.when(F.size(toks) == 0, F.lit(0.0)).otherwise(hits / F.size(toks))


def has_generic_token(descriptor: Column, generic: list[str]) -> Column:
    return F.arrays_overlap(name_tokens(descriptor), F.array(*[F.lit(g) for g in generic]))


def looks_like_url(descriptor: Column) -> Column:
    d = F.coalesce(descriptor, F.lit(""))
    return d.contains("WWW.") | d.contains(".COM")


def valid_string(s: Column) -> Column:
    """Not NULL and not one of the usual spellings of a missing value."""
    return s.isNotNull() & ~s.isin("", "nan", "None", "NaT")
