"""Text normalisation, token sets and URL hosts as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TOKEN = "[0-9a-zа-яё]+"


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition, for which there is no built-in."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def tokens(text: Column, compose: bool = False, fold: bool = True) -> Column:
    """Lower-case Latin, Cyrillic and digit runs; null gives none. ``compose`` applies NFKC first, ``fold`` reads ё as е."""
    low = F.lower(F.coalesce(nfkc(text) if compose else text, F.lit("")))
    return F.regexp_extract_all(F.regexp_replace(low, "ё", "е") if fold else low, F.lit(TOKEN), 0)


def normalize(text: Column, compose: bool = False) -> Column:
    """Tokens joined by single spaces."""
    return F.array_join(tokens(text, compose), " ")


def squeeze(text: Column) -> Column:
    """Lower case with runs of white space as one space; punctuation stays."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def normalizers(text: Column) -> dict[str, Column]:
    """The six ways in which texts are told apart, from the text itself to its tokens in sorted order; null is empty."""
    known = F.coalesce(text, F.lit(""))
    return {
        "raw": known,
        "trim_lower": F.lower(F.trim(known)),
        "nfkc": F.lower(nfkc(known)),
        "whitespace": squeeze(known),
        "project": normalize(known, compose=True),
        "canonical": F.array_join(F.array_sort(tokens(known, compose=True)), " "),
    }


def first_tokens(text: Column, n: int, prefix: str = "") -> Column:
    """The first ``n`` distinct tokens, each with ``prefix``."""
    return F.transform(F.slice(F.array_distinct(tokens(text)), 1, n), lambda t: F.concat(F.lit(prefix), t))


def canonical(text: Column) -> Column:
    """Tokens in sorted order."""
    return F.array_join(F.array_sort(tokens(text)), " ")


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; of two empty ones 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, 0 where ``b`` is as good as 0."""
    return F.when(F.abs(b) > 1e-12, a / b).otherwise(0.0)


def trigrams(text: Column) -> Column:
    """Distinct character trigrams of a text after two spaces and before one."""
    padded = F.concat(F.lit("  "), text, F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))
    return F.when(F.length(text) > 0, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def share(text: Column, pattern: str) -> Column:
    """Share of characters that match."""
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(pattern)) / F.length(text)).otherwise(0.0)


def url_domain(url: Column) -> Column:
    """Host in lower case without ``www.``, user and port; the scheme may be missing; empty if there is none."""
    rest = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^([a-z][a-z0-9+.-]*:)?//", "")
    return F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^([^@]*@)?(www\.)?|:[0-9]*$", "")


def url_host(url: Column) -> Column:
    """What stands between the scheme and the first slash, as it is."""
    return F.split_part(F.element_at(F.split(F.coalesce(url, F.lit("")), "://"), -1), F.lit("/"), F.lit(1))
