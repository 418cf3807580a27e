"""Queries on memory blocks: scans, lookups, projections, scoring, tiers, mutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark.functions import scoring as S
from memspark.functions import text as X
from memspark.functions import vocab as V
from memspark.operators import store
from memspark.sources import load

AS_OF = "2025-06-01 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def blocks(spark: SparkSession, root: str) -> DataFrame:
    return store.current_blocks(load(spark, root, "memory_blocks"))


def tier_histogram(spark: SparkSession, root: str) -> DataFrame:
    return blocks(spark, root).rollup("tier").agg(F.count("*").alias("n_blocks")).select(F.coalesce("tier", F.lit("ALL")).alias("tier"), "n_blocks")


def block_scan_tier(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "memory_blocks").filter("tier = 'L2_ACTIVE_RAM'").select("id", "tag", "source", F.unix_micros("created_at").alias("created_us")).distinct()


def block_lookup_ordered(spark: SparkSession, root: str) -> DataFrame:
    asked = load(spark, root, "entities").groupBy(F.col("id").alias("request")).agg(F.max("memory_ids").alias("ids")).filter("ids IS NOT NULL")
    return store.lookup_ordered(asked, blocks(spark, root))


def snippet_projection(spark: SparkSession, root: str) -> DataFrame:
    b = blocks(spark, root)
    return b.select("id", store.snippet(b).alias("snippet"))


def pool_dump(spark: SparkSession, root: str) -> DataFrame:
    b = store.with_priority(blocks(spark, root), as_of())
    return b.select("id", "tier", "tag", F.substring("content", 1, 60).alias("preview"), F.round("p_eff", 6).alias("p_eff"), F.round("age_days", 4).alias("age_days"))


def memory_list(spark: SparkSession, root: str) -> DataFrame:
    b = blocks(spark, root).filter(F.upper("tag") == "USER_PROFILE")
    return b.orderBy(F.desc("importance_score"), "id").limit(20).select("id", "importance_score", X.preview(F.col("content"), 120, "…").alias("preview"))


def memory_search_filter(spark: SparkSession, root: str) -> DataFrame:
    b = blocks(spark, root)
    return b.filter(F.lower(F.concat_ws(" ", "id", "content", "summary", "tag", "source")).contains("lease")).select("id", "tag")


def keyword_lookup(spark: SparkSession, root: str) -> DataFrame:
    b = blocks(spark, root)
    return b.filter(F.arrays_overlap("keywords", F.array(F.lit("check"), F.lit("lease"), F.lit("library")))).select("id", "tier", F.size("keywords").alias("n_keywords"))


def token_estimate(spark: SparkSession, root: str) -> DataFrame:
    b = blocks(spark, root).filter(F.col("tier").isin("L1_HOT_CACHE", "L2_ACTIVE_RAM"))
    return b.groupBy("tier").agg(F.sum(X.tokens(store.snippet(b))).alias("tokens"), F.count("*").alias("n_blocks"))


def peff_score(spark: SparkSession, root: str) -> DataFrame:
    return store.with_priority(blocks(spark, root), as_of()).select("id", F.round("p_eff", 6).alias("p_eff"))


def salience_score(spark: SparkSession, root: str) -> DataFrame:
    b = blocks(spark, root)
    return b.select("id", F.round(S.salience(S.age_days(as_of(), F.col("created_at")), F.col("access_count")), 6).alias("salience"))


def eviction_sweep(spark: SparkSession, root: str) -> DataFrame:
    return store.sweep(blocks(spark, root), as_of()).select("id", "tier", "new_tier", F.coalesce(F.length("new_summary"), F.lit(-1)).alias("summary_chars"))


def l2_cap(spark: SparkSession, root: str) -> DataFrame:
    """L2 blocks of a session beyond the 20 of highest priority move to L3."""
    b = store.with_priority(blocks(spark, root).filter("tier = 'L2_ACTIVE_RAM'"), as_of())
    order = Window.partitionBy("session_id").orderBy(F.desc(F.round("p_eff", 6)), F.desc("last_accessed_at"), "id")
    # keep the best of each session; whatever is not kept moves: no session is sorted in one task, as top rows are taken per partition first
    kept = b.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= V.L2_CAP).select("id")
    return b.join(kept, "id", "left_anti").select("id", F.lit("L3_VIRTUAL_SWAP").alias("new_tier"))


def context_assembly(spark: SparkSession, root: str) -> DataFrame:
    """L1 blocks first, then those of L2 by last access, each with its place there."""
    b = blocks(spark, root)
    first = b.filter("tier = 'L1_HOT_CACHE'").select("id", F.lit(1).alias("section"))
    # places by day first, so that the order is never made in one task
    l2 = b.filter("tier = 'L2_ACTIVE_RAM'").select("id", "last_accessed_at", F.to_date("last_accessed_at").alias("day"))
    later = Window.orderBy(F.desc_nulls_last("day")).rowsBetween(Window.unboundedPreceding, -1)  # one row per day
    before = l2.groupBy("day").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(later), F.lit(0))).select("day", "before")
    within = Window.partitionBy("day").orderBy(F.desc("last_accessed_at"), "id")
    placed = l2.withColumn("w", F.row_number().over(within)).join(before, l2["day"].eqNullSafe(before["day"]))
    rest = placed.select("id", F.lit(2).alias("section"), (F.col("before") + F.col("w")).cast("bigint").alias("place"))
    return first.withColumn("place", F.lit(0).cast("bigint")).unionByName(rest)


def tag_inference(spark: SparkSession, root: str) -> DataFrame:
    from memspark.operators import extract as E

    return blocks(spark, root).select("id", E.tag_of(F.col("content")).alias("inferred_tag"))


def keyword_extract(spark: SparkSession, root: str) -> DataFrame:
    return blocks(spark, root).select("id", F.array_join(X.keywords(F.col("content")), " ").alias("words"))


def block_validation(spark: SparkSession, root: str) -> DataFrame:
    """Rows that break a constraint, with the constraint."""
    b = blocks(spark, root)
    none = F.coalesce(F.col("summary"), F.lit("")) == ""
    rules = {
        "L1_has_summary": (F.col("tier") == "L1_HOT_CACHE") & ~none, "L4_without_summary": (F.col("tier") == "L4_ARCHIVE") & none, "importance_out_of_range": ~F.col("importance_score").between(1, 10),
        "access_count_below_1": F.col("access_count") < 1, "empty_content": F.coalesce(F.col("content"), F.lit("")) == "",
    }
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return b.select("id", F.explode(broken).alias("rule"))


def block_upsert(spark: SparkSession, root: str) -> DataFrame:
    """Blocks sent twice: the first rows upserted with the last ones; only summary, tier, last access and count change."""
    raw = load(spark, root, "memory_blocks")
    rest = [c for c in raw.columns if c != "id"]
    first = raw.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("last_accessed_at", "access_count")).alias("_")).select("id", *[F.col(f"_.{c}").alias(c) for c in rest])
    done = store.upsert(first, store.current_blocks(raw), ["summary", "tier", "last_accessed_at", "access_count"])
    return done.select("id", "tier", "access_count", F.unix_micros("last_accessed_at").alias("accessed_us"), F.length("content").alias("content_chars"))


def pollution(spark: SparkSession, root: str) -> DataFrame:
    b = blocks(spark, root)
    return b.groupBy(F.coalesce("session_id", F.lit("none")).alias("session")).agg(F.round((F.count("*") - F.count_distinct("tag")) / F.count("*"), 6).alias("pollution"), F.count("*").alias("n_blocks"))


def orphan_anti_join(spark: SparkSession, root: str) -> DataFrame:
    m = load(spark, root, "entity_mentions").select("mention_id", "memory_id").distinct()
    return m.join(load(spark, root, "memory_blocks").select(F.col("id").alias("memory_id")), "memory_id", "left_anti").select("mention_id", "memory_id")


QUERIES = {f.__name__: f for f in (
    tier_histogram, block_scan_tier, block_lookup_ordered, snippet_projection, pool_dump, memory_list, memory_search_filter, keyword_lookup, token_estimate, peff_score, salience_score, eviction_sweep, l2_cap, context_assembly,
    tag_inference, keyword_extract, block_validation, block_upsert, pollution, orphan_anti_join,
)}

B = "WITH b AS (SELECT * FROM memory_blocks QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_accessed_at DESC, access_count DESC) = 1)\n"
DECAY = "(CASE tag WHEN 'CORE_RULE' THEN 0.001 WHEN 'USER_PROFILE' THEN 0.002 WHEN 'PROJECT_FACT' THEN 0.01 WHEN 'TASK' THEN 0.05 WHEN 'SMALL_TALK' THEN 0.2 ELSE 0.08 END)::DOUBLE"
AGE = "((1748736000000000 - epoch_us(last_accessed_at)) / 86400000000.0)::DOUBLE"
PEFF = f"(importance_score * exp(-({DECAY} / (greatest(access_count, 1) / 10.0::DOUBLE)) * {AGE}))"
P = B[:-1] + f", p AS (SELECT *, {AGE} AS age, {PEFF} AS peff FROM b)\n"
SQL = {
    "tier_histogram": B + "SELECT coalesce(tier, 'ALL') AS tier, count(*)::BIGINT AS n_blocks FROM b GROUP BY ROLLUP (tier)",
    "block_scan_tier": "SELECT DISTINCT id, tag, source, epoch_us(created_at)::BIGINT AS created_us FROM memory_blocks WHERE tier = 'L2_ACTIVE_RAM'",
    "block_lookup_ordered": B[:-1]
    + """, e AS (SELECT id, max(memory_ids) AS ids FROM entities GROUP BY id), r AS (SELECT id AS request, unnest(ids) AS m, generate_subscripts(ids, 1) - 1 AS pos FROM e)
SELECT r.request, r.pos::INTEGER AS pos, b.id, b.tier FROM r JOIN b ON b.id = r.m""",
    "snippet_projection": B + "SELECT id, coalesce(nullif(summary, ''), content) AS snippet FROM b",
    "pool_dump": P + "SELECT id, tier, tag, content[1:60] AS preview, round(peff, 6) AS p_eff, round(age, 4) AS age_days FROM p",
    "memory_list": B + "SELECT id, importance_score, content[1:120] || CASE WHEN length(content) > 120 THEN '…' ELSE '' END AS preview FROM b WHERE upper(tag) = 'USER_PROFILE' ORDER BY importance_score DESC, id LIMIT 20",
    "memory_search_filter": B + "SELECT id, tag FROM b WHERE contains(lower(concat_ws(' ', id, content, summary, tag, source)), 'lease')",
    "keyword_lookup": B + "SELECT id, tier, len(keywords)::INTEGER AS n_keywords FROM b WHERE list_has_any(keywords, ['check', 'lease', 'library'])",
    "token_estimate": B + "SELECT tier, sum(length(coalesce(nullif(summary, ''), content)) // 4)::BIGINT AS tokens, count(*)::BIGINT AS n_blocks FROM b WHERE tier IN ('L1_HOT_CACHE', 'L2_ACTIVE_RAM') GROUP BY tier",
    "peff_score": P + "SELECT id, round(peff, 6) AS p_eff FROM p",
    "salience_score": B
    + "SELECT id, round(least(1.0::DOUBLE, 0.5 / (1 + 0.01 * ((1748736000000000 - epoch_us(created_at)) / 86400000000.0)::DOUBLE) + 0.5 * ln(1 + access_count::DOUBLE) / 10), 6) AS salience FROM b",
    "eviction_sweep": P[:-1]
    + """, s AS (SELECT *, tier = 'L2_ACTIVE_RAM' AND peff < 2.0 OR tier = 'L3_VIRTUAL_SWAP' AS low3 FROM p),
t AS (SELECT *, low3 AND peff < 0.5 OR tier = 'L4_ARCHIVE' AS low4 FROM s),
u AS (SELECT *, CASE WHEN tier = 'L1_HOT_CACHE' THEN tier WHEN low4 AND peff < 0.05 THEN 'DELETED' WHEN low4 THEN 'L4_ARCHIVE' WHEN low3 THEN 'L3_VIRTUAL_SWAP' ELSE tier END AS new_tier,
  list_filter(regexp_split_to_array(trim(content), '\\s+'), lambda x: x <> '') AS ws FROM t)
SELECT id, tier, new_tier, coalesce(length(CASE WHEN new_tier = 'L4_ARCHIVE' AND tier <> 'L4_ARCHIVE' AND coalesce(summary, '') = ''
  THEN '[ARCHIVED] ' || array_to_string(ws[1:20], ' ') || CASE WHEN len(ws) > 20 THEN '...' ELSE '' END ELSE summary END), -1)::INTEGER AS summary_chars FROM u""",
    "l2_cap": P
    + "SELECT id, 'L3_VIRTUAL_SWAP' AS new_tier FROM p WHERE tier = 'L2_ACTIVE_RAM' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY round(peff, 6) DESC, last_accessed_at DESC, id) > 20",
    "context_assembly": B + "SELECT id, 1 AS section, 0::BIGINT AS place FROM b WHERE tier = 'L1_HOT_CACHE' UNION ALL SELECT id, 2, row_number() OVER (ORDER BY last_accessed_at DESC NULLS LAST, id)::BIGINT FROM b WHERE tier = 'L2_ACTIVE_RAM'",
    "tag_inference": B
    + """SELECT id, CASE WHEN regexp_matches(lower(content), 'project|retrieval|memory|embedding|benchmark') THEN 'PROJECT_FACT' WHEN regexp_matches(lower(content), 'my name|favorite|i prefer|i like') THEN 'USER_PROFILE'
WHEN regexp_matches(lower(content), 'todo|need to|remind') THEN 'TASK' ELSE 'EPISODIC' END AS inferred_tag FROM b""",
    "keyword_extract": B[:-1]
    + """, w AS (SELECT id, list_filter(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_][\\p{L}\\p{N}_-]*[\\p{L}\\p{N}_]'), lambda x: regexp_full_match(x, '[a-z0-9-]{2,}')) AS ws FROM b),
f AS (SELECT id, list_filter(ws, lambda x, i: list_position(ws, x) = i AND NOT list_contains(['the','a','an','is','it','in','on','at','to','for','of','and','or','but','i','you','we','they','was','are','be','this','that'], x)) AS ws FROM w)
SELECT id, array_to_string(ws[1:15], ' ') AS words FROM f""",
    "block_validation": B
    + """SELECT id, 'L1_has_summary' AS rule FROM b WHERE tier = 'L1_HOT_CACHE' AND coalesce(summary, '') <> '' UNION ALL SELECT id, 'L4_without_summary' FROM b WHERE tier = 'L4_ARCHIVE' AND coalesce(summary, '') = ''
UNION ALL SELECT id, 'importance_out_of_range' FROM b WHERE importance_score NOT BETWEEN 1 AND 10 UNION ALL SELECT id, 'access_count_below_1' FROM b WHERE access_count < 1 UNION ALL SELECT id, 'empty_content' FROM b WHERE coalesce(content, '') = ''""",
    "block_upsert": B + "SELECT id, tier, access_count, epoch_us(last_accessed_at)::BIGINT AS accessed_us, length(content)::INTEGER AS content_chars FROM b",
    "pollution": B + "SELECT coalesce(session_id, 'none') AS session, round((count(*) - count(DISTINCT tag)) / count(*)::DOUBLE, 6) AS pollution, count(*)::BIGINT AS n_blocks FROM b GROUP BY 1",
    "orphan_anti_join": "SELECT DISTINCT mention_id, memory_id FROM entity_mentions m WHERE memory_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM memory_blocks b WHERE b.id = m.memory_id)",
}
