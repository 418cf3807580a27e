"""Blocks, facts and events: current rows, lookups, projections and mutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions import scoring as S
from memspark.functions import text as X


def current(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by ``order`` (insert or replace); partial aggregation, so hot keys cost no more."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_"))
    return best.select(key, *[F.col(f"_.{c}").alias(c) for c in rest])


def current_blocks(blocks: DataFrame) -> DataFrame:
    return current(blocks, "id", ["last_accessed_at", "access_count"])


def with_priority(blocks: DataFrame, as_of: Column) -> DataFrame:
    aged = blocks.withColumn("age_days", S.age_days(as_of, F.col("last_accessed_at")))
    return aged.withColumn("p_eff", S.p_eff(F.col("importance_score"), F.col("tag"), F.col("access_count"), F.col("age_days")))


def lookup_ordered(requests: DataFrame, blocks: DataFrame) -> DataFrame:
    """(request, ids) -> blocks in the order asked for: request, pos, id, tier; missing ids are left out."""
    asked = requests.select("request", F.posexplode("ids").alias("pos", "id"))
    return asked.join(blocks.select("id", "tier"), "id").select("request", "pos", "id", "tier")


def snippet(blocks: DataFrame) -> Column:
    return F.coalesce(F.when(F.col("summary") != "", F.col("summary")), F.col("content"))


def upsert(stored: DataFrame, new: DataFrame, mutable: list[str], key: str = "id") -> DataFrame:
    """Rows of ``stored`` with the ``mutable`` columns of ``new`` where it has the key, and the new keys' rows whole."""
    n = new.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_n_{c}") for c in stored.columns if c != key])
    both = stored.join(n, F.col(key) == F.col("_k"), "full_outer")
    has_new, has_old = F.col("_k").isNotNull(), F.col(key).isNotNull()
    pick = lambda c: F.when(~has_old | (has_new & F.lit(c in mutable)), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(F.coalesce(key, "_k").alias(key), *[pick(c) for c in stored.columns if c != key])


def delete_events(events: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events and links without the events of the memories in ``gone`` (memory_id)."""
    kept = events.join(gone.select("memory_id").distinct(), "memory_id", "left_anti")
    dropped = events.join(gone.select("memory_id").distinct(), "memory_id", "left_semi").select(F.col("id").alias("event_id")).distinct()
    return kept, links.join(dropped, "event_id", "left_anti")


def sweep(blocks: DataFrame, as_of: Column) -> DataFrame:
    """Adds new_tier of one eviction sweep: L2 under 2.0 to L3, L3 under 0.5 to L4, L4 under 0.05 deleted; a block may
    fall several tiers at once; L1 is exempt. ``new_summary`` is made on the way to L4."""
    from memspark.functions import vocab as V

    p, tier = F.col("p_eff"), F.col("tier")
    scored = with_priority(blocks, as_of)
    low3 = (tier == "L2_ACTIVE_RAM") & (p < V.L2_FLOOR) | (tier == "L3_VIRTUAL_SWAP")
    low4 = low3 & (p < V.L3_FLOOR) | (tier == "L4_ARCHIVE")
    gone = low4 & (p < V.L4_FLOOR)
    new = F.when(tier == "L1_HOT_CACHE", tier).when(gone, "DELETED").when(low4, "L4_ARCHIVE").when(low3, "L3_VIRTUAL_SWAP").otherwise(tier)
    out = scored.withColumn("new_tier", new)
    made = (F.col("new_tier") == "L4_ARCHIVE") & (tier != "L4_ARCHIVE") & (F.coalesce(F.col("summary"), F.lit("")) == "")
    return out.withColumn("new_summary", F.when(made, X.archived(F.col("content"))).otherwise(F.col("summary")))
