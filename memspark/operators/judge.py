"""Grading of answers: deterministic gates, diagnosis and coverage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memspark.functions import text as X
from memspark.functions import vocab as V
from memspark.operators import extract as E


def error_gate(response: Column) -> Column:
    """False for empty, short or error responses, else null."""
    t = F.trim(F.coalesce(response, F.lit("")))
    bad = (t == "") | (X.word_count(t) < 3)
    for p in V.ERROR_PREFIXES:
        bad = bad | t.startswith(p)
    return F.when(bad, F.lit(False))


def abstention_gate(response: Column) -> Column:
    """False if a phrase of not knowing stands in the first words, else null."""
    opening = F.lower(F.array_join(F.slice(X.split_words(response), 1, V.OPENING_WORDS), " "))
    return F.when(X.contains_any(opening, V.ABSTENTION), F.lit(False))


def purely_numeric(expected: Column) -> Column:
    words = F.regexp_extract_all(F.lower(expected), F.lit(r"([a-z']+)"), F.lit(1))
    other = F.filter(words, lambda w: ~w.isin(V.NUMERIC_UNITS))
    return expected.rlike(r"\b\d+(\.\d+)?\b") & (F.size(other) <= 1)


def _duration(text: Column) -> Column:
    y, m = F.regexp_extract(F.lower(text), r"(\d+)\s*years?\D+?(\d+)\s*months?", 1), F.regexp_extract(F.lower(text), r"(\d+)\s*years?\D+?(\d+)\s*months?", 2)
    return F.when(y != "", y.cast("int") * 12 + m.cast("int"))


def numeric_gate(expected: Column, response: Column) -> Column:
    """For numeric answers: durations of years and months as a pair, else any number shared; null if neither tells."""
    pair, said = _duration(expected), _duration(response)
    a, b = E.numbers(expected), E.numbers(response)
    stated = F.regexp_extract(F.lower(response), r"\b(\d+(?:\.\d+)?)\s*(day|days|month|months|year|years|week|weeks)\b", 1)
    simple = F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(None)).when(F.arrays_overlap(a, b), F.lit(True)).when(stated != "", F.lit(False))
    return F.when(purely_numeric(expected), F.when(pair.isNotNull(), F.when(said.isNotNull(), pair == said)).otherwise(simple))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", ""), r"\s+", " "))


def substring_match(expected: Column, claim: Column) -> Column:
    """True if one contains the other, or a word of four letters or more begins one of the other's; else null."""
    a, b = squeezed(expected), squeezed(claim)
    words = lambda t: F.filter(F.split(t, " "), lambda w: (F.length(w) >= 4) & ~w.isin(V.UNIT_WORDS))
    begins = F.exists(words(a), lambda x: F.exists(words(b), lambda y: x.startswith(y) | y.startswith(x)))
    return F.when((a == "") | (b == ""), F.lit(None)).when(F.contains(a, b) | F.contains(b, a) | begins, F.lit(True))


def verdict(expected: Column, response: Column) -> Column:
    """Struct (passed, gate): the first gate that tells; no gate leaves passed null."""
    gate = lambda c, n: F.when(c.isNotNull(), F.struct(c.alias("passed"), F.lit(n).alias("gate")))
    return F.coalesce(
        gate(error_gate(response), "ERROR_GATE"),
        gate(abstention_gate(response), "ABSTENTION_GATE"),
        gate(numeric_gate(expected, response), "NUMERIC_GATE"),
        gate(substring_match(expected, response), "SUBSTRING_MATCH"),
        F.struct(F.lit(None).cast("boolean").alias("passed"), F.lit("UNDECIDED").alias("gate")),
    )


def overlap(expected: Column, response: Column) -> Column:
    """Share of the expected answer's key tokens that the response has."""
    e = X.key_tokens(expected)
    return F.when(F.size(e) > 0, F.size(F.array_intersect(e, X.key_tokens(response))) / F.size(e)).otherwise(F.lit(0.0))


def log_severity(line: Column) -> Column:
    t = F.lower(line)
    return F.when(t.rlike("error|exception|traceback|failed"), "error").when(t.rlike("warn"), "warning").when(t.rlike("pass|success|complete"), "success").otherwise("info")
