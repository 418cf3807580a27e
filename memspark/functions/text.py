"""Column functions on texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memspark.functions import vocab as V


def tokens(text: Column) -> Column:
    """Estimate of tokens: a quarter of the characters."""
    return F.floor(F.length(text) / 4).cast("bigint")


def split_words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(split_words(text))


def repetition(text: Column) -> Column:
    """Share of the most frequent word; 0 for none. One pass over the sorted words."""
    words = F.array_sort(split_words(F.lower(text)))
    none = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(s: Column, w: Column) -> Column:
        run = F.when(s["word"] == w, s["run"] + 1).otherwise(1)
        return F.struct(w.alias("word"), run.alias("run"), F.greatest(s["most"], run).alias("most"))

    return F.aggregate(words, none, step, lambda s: F.when(s["most"] > 0, s["most"] / F.size(words)).otherwise(F.lit(0.0)))


def strip_filler(text: Column) -> Column:
    out = text
    for pattern in V.FILLER:
        out = F.trim(F.regexp_replace(out, "(?is)" + pattern, ""))
    return F.when(out == "", text).otherwise(out)


def noise_hits(text: Column) -> Column:
    return sum((F.coalesce(text.rlike("(?i)" + p), F.lit(False)).cast("int") for p, _ in V.ASSISTANT_NOISE), F.lit(0))


def clean_response(text: Column) -> Column:
    """The reply without filler, or null if it holds nothing worth storing."""
    bare = F.trim(text)
    out = strip_filler(bare)
    hits = noise_hits(bare)
    return F.when((bare != "") & (hits < 2) & ~((hits == 1) & (word_count(bare) < 12)) & (F.length(out) >= V.MIN_CHARS), out)


def keywords(text: Column) -> Column:
    """Up to 15 distinct words of two letters or more that are no stop words, first seen first."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\b([a-zA-Z0-9-]{2,})\b"), F.lit(1))
    return F.slice(F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in V.KEYWORD_STOP])), 1, 15)


def name_tokens(name: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit(r"(\w+)"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def name_similarity(a: Column, b: Column) -> Column:
    """The larger of token overlap and 0.8 if one name contains the other."""
    la, lb = F.lower(a), F.lower(b)
    inside = F.when((la != "") & (lb != "") & (F.contains(la, lb) | F.contains(lb, la)), F.lit(0.8)).otherwise(F.lit(0.0))
    return F.greatest(jaccard(name_tokens(a), name_tokens(b)), inside)


def contains_any(text: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t))
    return out


def count_terms(text: Column, terms: list[str]) -> Column:
    return sum((F.contains(text, F.lit(t)).cast("int") for t in terms), F.lit(0))


def preview(text: Column, n: int, mark: str) -> Column:
    return F.concat(F.substring(text, 1, n), F.when(F.length(text) > n, F.lit(mark)).otherwise(F.lit("")))


def archived(text: Column) -> Column:
    words = split_words(text)
    return F.concat(F.lit("[ARCHIVED] "), F.array_join(F.slice(words, 1, 20), " "), F.when(F.size(words) > 20, F.lit("...")).otherwise(F.lit("")))


def key_tokens(text: Column) -> Column:
    words = F.array_distinct(split_words(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", "")))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(V.KEY_TOKEN_STOP))
