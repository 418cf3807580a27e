"""Column functions for priorities, salience and weighted ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from memspark.functions import vocab as V

_DAY = 86_400_000_000


def mapped(key: Column, table: dict, default: object = None) -> Column:
    """The value of ``key`` in a small literal table."""
    out = reduce(lambda acc, kv: acc.when(key == kv[0], F.lit(kv[1])), list(table.items())[1:], F.when(key == next(iter(table)), F.lit(next(iter(table.values())))))
    return out.otherwise(F.lit(default)) if default is not None else out


def age_days(as_of: Column, then: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(then)) / F.lit(float(_DAY))


def gap_days(a: Column, b: Column) -> Column:
    """Whole days of a - b rounded down, without sign: -1.5 gives 2 and 1.5 gives 1."""
    return F.abs(F.floor((F.unix_micros(a) - F.unix_micros(b)) / F.lit(float(_DAY)))).cast("bigint")


def p_eff(importance: Column, tag: Column, access_count: Column, age: Column) -> Column:
    """Importance decayed by age in days; each access slows the decay. Unknown tags decay as EPISODIC."""
    return importance * F.exp(-(mapped(tag, V.DECAY, V.DECAY["EPISODIC"]) / (F.greatest(access_count, F.lit(1)) / F.lit(V.STABILITY))) * age)


def salience(age: Column, count: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(0.5) / (1 + F.lit(0.01) * age) + F.lit(0.5) * F.log1p(count) / 10)


def weighted(intent: Column, signals: dict[str, Column], weights: dict[str, tuple[float, ...]] = V.WEIGHTS) -> Column:
    """Sum of signal times weight by intent; an unknown intent counts as FACTUAL."""
    total = F.lit(0.0)
    for k, name in enumerate(V.SIGNALS):
        total = total + signals[name] * mapped(intent, {i: w[k] for i, w in weights.items()}, weights["FACTUAL"][k])
    return total


def ablated(mode: str) -> dict[str, tuple[float, ...]]:
    """Weights without one signal: no_intent gives every intent the FACTUAL row, the others move theirs to similarity."""
    drop = {"no_keyword": "ent", "no_recency": "time", "no_peff": "sal"}
    if mode == "none":
        return dict(V.WEIGHTS)
    if mode == "no_intent":
        return {k: V.WEIGHTS["FACTUAL"] for k in V.WEIGHTS}
    at = V.SIGNALS.index(drop[mode])
    return {k: tuple(0.0 if i == at else x + (w[at] if i == 0 else 0.0) for i, x in enumerate(w)) for k, w in V.WEIGHTS.items()}


def round6(x: Column) -> Column:
    return F.round(x, 6)
