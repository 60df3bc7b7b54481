"""Product text as column expressions: normal forms, keys, families, token similarity."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens that name colours, and tokens without meaning for a product.
COLOR_WORDS = ("RED", "GREEN", "BLUE", "PINK", "WHITE", "BLACK", "SILVER", "GOLD", "IVORY", "CREAM", "GREY", "GRAY", "PURPLE", "YELLOW", "ORANGE", "BROWN", "BEIGE", "NAVY", "TEAL", "LILAC", "TURQUOISE", "CLEAR", "LIGHT", "DARK")
STOPWORDS = ("THE", "A", "AN", "AND", "&", "OF", "FOR", "WITH", "IN", "ON", "TO")


def _array(words: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, words))


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def normalize_desc(text: Column) -> Column:
    """Trimmed, white space collapsed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def family_no_space(text: Column) -> Column:
    """Upper case without white space."""
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"\s+", "")


def normalize_text(text: Column) -> Column:
    """Upper case; all but letters and digits of ASCII become single spaces."""
    return F.trim(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9]+", " "))


def normalize_family(text: Column) -> Column:
    return F.replace(normalize_text(text), F.lit(" "), F.lit(""))


def slugify(text: Column, longest: int = 48) -> Column:
    """Lower case with hyphens, cut, never empty."""
    slug = F.replace(F.lower(normalize_text(text)), F.lit(" "), F.lit("-"))
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(slug, 1, longest), "-+$", ""), F.lit("")), F.lit("product"))


def product_key(cluster: Column, name: Column) -> Column:
    """c{cluster}-{slug}-{first eight digits of the name's MD5}."""
    return F.concat(F.lit("c"), cluster.cast("string"), F.lit("-"), slugify(name), F.lit("-"), F.substring(F.md5(normalize_text(name).cast("binary")), 1, 8))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits in upper case."""
    return F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit("([A-Z0-9]+)"), F.lit(1))


def heuristic_family(desc: Column) -> Column:
    """struct(family_name, variant_hint) by token rules: stop words go; colours and alphabetic tokens of 3 to 8 letters (but SET, PACK)
    are variants, at most six; the rest, at most four, is the family, or the description where nothing is left."""
    meant = F.filter(tokens(desc), lambda t: ~F.array_contains(_array(STOPWORDS), t))
    hint = lambda t: F.array_contains(_array(COLOR_WORDS), t) | (t.rlike("^[A-Z]{3,8}$") & ~t.isin("SET", "PACK"))
    family = F.array_join(F.slice(F.filter(meant, lambda t: ~hint(t)), 1, 4), " ")
    variant = F.array_join(F.slice(F.filter(meant, hint), 1, 6), " ")
    return F.struct(F.coalesce(F.nullif(family, F.lit("")), desc).alias("family_name"), variant.alias("variant_hint"))


def postprocess_family(desc: Column, family: Column, variant: Column) -> Column:
    """struct(family_name, variant_hint) of a proposed family: colour tokens move to the variant; an empty family falls back to rules."""
    parts = F.filter(F.split(F.upper(F.trim(F.coalesce(family, F.lit("")))), r"\s+"), lambda t: t != "")
    colour = lambda t: F.array_contains(_array(COLOR_WORDS), t)
    kept, moved = F.filter(parts, lambda t: ~colour(t)), F.filter(parts, colour)
    own = F.struct(F.array_join(kept, " ").alias("family_name"), F.trim(F.concat_ws(" ", F.trim(F.coalesce(variant, F.lit(""))), F.array_join(moved, " "))).alias("variant_hint"))
    return F.when(F.size(kept) > 0, own).otherwise(heuristic_family(desc))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda t: t != ""))


def jaccard(one: Column, two: Column) -> Column:
    """Of the token sets; 0 where both are empty."""
    a, b = token_set(one), token_set(two)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def contains_words(text: Column, part: Column) -> Column:
    """Whether part stands in text at word bounds."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), part, F.lit(" ")))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(one: pd.Series, two: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; Catalyst has no such expression."""
    return pd.Series([SequenceMatcher(None, a or "", b or "").ratio() for a, b in zip(one, two, strict=True)])
