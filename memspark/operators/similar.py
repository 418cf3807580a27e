"""Pairs of similar names without a cross join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import text as X
from memspark.session import cut


def _pieces(k: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length("low") - (k - 1)), lambda i: F.substr("low", i, F.lit(k)))


def _grams(names: DataFrame) -> DataFrame:
    """(low, token): every sequence of one to three characters of each name."""
    pieces = [F.when(F.length("low") >= k, _pieces(k)).otherwise(F.array().cast("array<string>")) for k in (1, 2, 3)]
    return names.select("low", F.explode(F.array_distinct(F.concat(*pieces))).alias("token"))


def _rarest(grams: DataFrame, seen: DataFrame) -> DataFrame:
    """Each name under the rarest of its character trigrams (a shorter name: itself)."""
    inner = grams.filter(F.length("token") == F.least(F.length("low"), F.lit(3)))
    return inner.join(seen, "token", "left").groupBy("low").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))


def similar(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs (left_low, right_low, similarity) of lower-case names of at least ``least`` by ``text.name_similarity``.

    left, right: name; null and empty names have no partner. Names of n words whose words overlap to ``least`` share one
    of the floor((1 - least) * n) + 1 rarest words of either, in one order of all words; a name that another one
    contains has all its trigrams there, so the rarest of them too (only asked for where ``least`` is 0.8 or less).
    Every pair is found; common words and trigrams lead nowhere unless they are the rarest of a name."""
    a, b = (cut(df.select(F.lower("name").alias("low")).filter("low <> ''").distinct()) for df in (left, right))
    words = {k: df.withColumn("tokens", X.name_tokens(F.col("low"))).withColumns({"n_tokens": F.size("tokens"), "token": F.explode("tokens")}) for k, df in (("a", a), ("b", b))}
    seen = words["a"].select("token").unionByName(words["b"].select("token")).groupBy("token").agg(F.count("*").alias("n"))
    order = Window.partitionBy("low").orderBy("n", "token")
    part = F.floor(F.lit(1 - least + 1e-9) * F.col("n_tokens")) + 1
    prefix = {k: df.join(seen, "token").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= part).select("token", "low") for k, df in words.items()}
    side = lambda df, name: df.select("token", F.col("low").alias(name))
    # each kind of candidates is a job of its own: one plan of all takes much of the driver's memory
    met = cut(side(prefix["a"], "left_low").join(side(prefix["b"], "right_low"), "token").select("left_low", "right_low").distinct())
    if least <= 0.8 + 1e-9:
        outer = {k: _grams(df) for k, df in (("a", a), ("b", b))}
        count = {k: df.groupBy("token").agg(F.count("*").alias("n")) for k, df in outer.items()}
        held = side(_rarest(outer["a"], count["b"]), "left_low").join(side(outer["b"], "right_low"), "token"), side(outer["a"], "left_low").join(side(_rarest(outer["b"], count["a"]), "right_low"), "token")
        for part in held:
            met = met.unionByName(cut(part.select("left_low", "right_low").distinct()))
    pairs = met.distinct()
    return pairs.withColumn("similarity", F.round(X.name_similarity(F.col("left_low"), F.col("right_low")), 6)).filter(F.col("similarity") >= least - 1e-9)

