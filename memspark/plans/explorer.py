"""Explorer and registry queries: top lists, resolution of mentions, running peaks, keys of ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark.functions import text as X
from memspark.operators import store
from memspark.plans.blocks import blocks
from memspark.plans.timeline import events, facts
from memspark.sources import load
from memspark.sources.files import ingestion_key


def entities(spark: SparkSession, root: str) -> DataFrame:
    return store.current(load(spark, root, "entities"), "id", ["reference_count", "last_seen"])


def entity_explorer(spark: SparkSession, root: str) -> DataFrame:
    return entities(spark, root).orderBy(F.desc("reference_count"), "id").limit(50).select("id", "name", "entity_type", "reference_count", "needs_review")


def fact_explorer(spark: SparkSession, root: str) -> DataFrame:
    return facts(spark, root).orderBy(F.desc("confidence"), "id").limit(50).select("id", "subject", "predicate", "object_value", "confidence")


def recent_turns(spark: SparkSession, root: str) -> DataFrame:
    t = load(spark, root, "turns").dropDuplicates(["turn_id"])
    return t.orderBy(F.desc("logged_at"), F.desc("turn_id")).limit(10).select("turn_id", X.preview(F.col("user_message"), 80, "…").alias("preview"))


def latest_memories(spark: SparkSession, root: str) -> DataFrame:
    """The last three blocks of every tag."""
    order = Window.partitionBy("tag").orderBy(F.desc("created_at"), "id")
    return blocks(spark, root).withColumn("place", F.row_number().over(order)).filter("place <= 3").select("tag", "place", "id")


def recent_of_type(spark: SparkSession, root: str) -> DataFrame:
    """The entity of each type seen last."""
    e = entities(spark, root).filter("last_seen IS NOT NULL")
    return e.groupBy("entity_type").agg(F.max_by("id", F.struct("last_seen", "id")).alias("id"))


def newest_event_per_memory(spark: SparkSession, root: str) -> DataFrame:
    e = events(spark, root)
    return e.groupBy("memory_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"), F.count("*").alias("n_events"))


def entity_resolution(spark: SparkSession, root: str) -> DataFrame:
    """Mentions against names, then aliases, both without regard to case: exact, alias or new."""
    e = entities(spark, root)
    low = lambda c: F.lower(F.trim(c))
    names = e.filter("name IS NOT NULL").groupBy(low("name").alias("k")).agg(F.min("id").alias("by_name"))
    alias = e.select("id", F.explode("aliases").alias("a")).filter("a IS NOT NULL").groupBy(low("a").alias("k")).agg(F.min("id").alias("by_alias"))
    m = load(spark, root, "entity_mentions").filter("NOT is_shorthand").select("mention_id", low("surface_form").alias("k")).distinct()
    r = m.join(names, "k", "left").join(alias, "k", "left")
    kind = F.when(F.col("by_name").isNotNull(), "exact").when(F.col("by_alias").isNotNull(), "alias").otherwise("new")
    return r.select("mention_id", F.coalesce("by_name", "by_alias", F.lit("none")).alias("entity_id"), kind.alias("match_type"))


def daily_peaks(spark: SparkSession, root: str) -> DataFrame:
    """Blocks by day and tier with the running total of the tier; the window is over days, not rows."""
    d = blocks(spark, root).groupBy("tier", F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n_blocks"))
    upto = Window.partitionBy("tier").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("so_far", F.sum("n_blocks").over(upto))


def action_counts(spark: SparkSession, root: str) -> DataFrame:
    """What one consolidation would do, by action."""
    from memspark.plans import timeline as T

    parts = [("stable_fact", T.stable_facts), ("conflict", T.conflict_flags), ("demoted", T.cold_demotion)]
    out = None
    for name, f in parts:
        one = f(spark, root).agg(F.count("*").alias("n")).select(F.lit(name).alias("action"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def predicate_histogram(spark: SparkSession, root: str) -> DataFrame:
    f = facts(spark, root)
    return f.groupBy("predicate").agg(F.count("*").alias("n_facts"), F.count_if(F.col("earliest").isNotNull()).alias("n_dated"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.5)), 6).alias("mean_confidence"), F.count_if("needs_review").alias("n_review"))


def replay_keys(spark: SparkSession, root: str) -> DataFrame:
    """Key of each session's messages, for reuse of what was ingested before. The messages' hashes, each with its
    place, are summed, so no session is gathered."""
    t = load(spark, root, "turns").dropDuplicates(["turn_id"])
    h = lambda seed: F.sum(F.xxhash64("turn_index", "user_message", F.lit(seed)).cast("decimal(38,0)")).cast("string")
    s = t.groupBy(F.coalesce("session_id", F.lit("none")).alias("session")).agg(F.array(h(1), h(2), F.count("*").cast("string")).alias("m"))
    return s.select("session", ingestion_key(F.col("m"), F.lit("none")).alias("key"))


QUERIES = {f.__name__: f for f in (entity_explorer, fact_explorer, recent_turns, latest_memories, recent_of_type, newest_event_per_memory, entity_resolution, daily_peaks, action_counts, predicate_histogram, replay_keys)}

_E = "WITH e AS (SELECT * FROM entities QUALIFY row_number() OVER (PARTITION BY id ORDER BY reference_count DESC, last_seen DESC) = 1)\n"
_B = "WITH b AS (SELECT * FROM memory_blocks QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_accessed_at DESC, access_count DESC) = 1)\n"
_F = "WITH f AS (SELECT * FROM structured_facts QUALIFY row_number() OVER (PARTITION BY id ORDER BY id) = 1)\n"
SQL = {
    "entity_explorer": _E + "SELECT id, name, entity_type, reference_count, needs_review FROM e ORDER BY reference_count DESC, id LIMIT 50",
    "recent_of_type": _E + "SELECT entity_type, arg_max(id, (last_seen, id)) AS id FROM e WHERE last_seen IS NOT NULL GROUP BY 1",
    "fact_explorer": _F + "SELECT id, subject, predicate, object_value, confidence FROM f ORDER BY confidence DESC, id LIMIT 50",
    "recent_turns": "WITH t AS (SELECT DISTINCT turn_id, logged_at, user_message FROM turns) SELECT turn_id, user_message[1:80] || CASE WHEN length(user_message) > 80 THEN '…' ELSE '' END AS preview FROM t ORDER BY logged_at DESC, turn_id DESC LIMIT 10",
    "latest_memories": _B + "SELECT tag, row_number() OVER (PARTITION BY tag ORDER BY created_at DESC, id)::INTEGER AS place, id FROM b QUALIFY place <= 3",
    "newest_event_per_memory": "WITH e AS (SELECT * FROM timeline_events QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC) = 1) SELECT memory_id, arg_max(id, (created_at, id)) AS id, count(*)::BIGINT AS n_events FROM e GROUP BY 1",
    "entity_resolution": _E[:-1]
    + """, n AS (SELECT lower(trim(name)) AS k, min(id) AS i FROM e WHERE name IS NOT NULL GROUP BY 1), a AS (SELECT lower(trim(x)) AS k, min(id) AS i FROM (SELECT id, unnest(aliases) AS x FROM e) WHERE x IS NOT NULL GROUP BY 1),
m AS (SELECT DISTINCT mention_id, lower(trim(surface_form)) AS k FROM entity_mentions WHERE NOT is_shorthand)
SELECT mention_id, coalesce(n.i, a.i, 'none') AS entity_id, CASE WHEN n.i IS NOT NULL THEN 'exact' WHEN a.i IS NOT NULL THEN 'alias' ELSE 'new' END AS match_type FROM m LEFT JOIN n ON n.k = m.k LEFT JOIN a ON a.k = m.k""",
    "daily_peaks": _B[:-1]
    + ", d AS (SELECT tier, strftime(created_at, '%Y-%m-%d') AS day, count(*)::BIGINT AS n_blocks FROM b GROUP BY 1, 2) SELECT tier, day, n_blocks, (sum(n_blocks) OVER (PARTITION BY tier ORDER BY day))::BIGINT AS so_far FROM d",
    "predicate_histogram": _F + "SELECT predicate, count(*)::BIGINT AS n_facts, count(earliest)::BIGINT AS n_dated, round(coalesce(avg(confidence), 0.5), 6) AS mean_confidence, count(*) FILTER (needs_review)::BIGINT AS n_review FROM f GROUP BY 1",
}
