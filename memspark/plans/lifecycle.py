"""Lookups, the life of blocks between tiers, registry rows, and consolidation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark.functions import vocab as V
from memspark.operators import extract as E
from memspark.operators import store
from memspark.operators.similar import similar
from memspark.plans import conversation, evaluation, timeline
from memspark.plans.blocks import SQL as BLOCK_SQL
from memspark.plans.blocks import as_of, blocks
from memspark.plans.conversation import turns
from memspark.plans.timeline import events, facts
from memspark.session import cut
from memspark.sources import load

L1, L2, L3, L4 = "L1_HOT_CACHE", "L2_ACTIVE_RAM", "L3_VIRTUAL_SWAP", "L4_ARCHIVE"


def _key(c: str):
    return F.lower(F.trim(c))


# ---------------------------------------------------------------- lookups
def tiered_lookup(spark: SparkSession, root: str) -> DataFrame:
    """Where each memory that an entity names is found: first tier, second tier, the store, or nowhere."""
    asked = load(spark, root, "entities").select(F.explode("memory_ids").alias("m")).select(_key("m").alias("memory_id")).filter("memory_id <> ''").distinct()
    b = blocks(spark, root).select(_key("id").alias("memory_id"), "tier")
    place = F.when(F.col("tier") == L1, "L1").when(F.col("tier") == L2, "L2").when(F.col("tier").isNotNull(), "store").otherwise("nowhere")
    return asked.join(b, "memory_id", "left").select("memory_id", place.alias("found_in"))


def facts_for_memory(spark: SparkSession, root: str) -> DataFrame:
    """Each memory's facts in order of their ids."""
    order = Window.partitionBy("memory_id").orderBy("id")
    return facts(spark, root).select("memory_id", "id", "predicate").withColumn("place", F.row_number().over(order))


def events_for_memory(spark: SparkSession, root: str) -> DataFrame:
    """Each memory's events in order of time, undated ones first."""
    order = Window.partitionBy("memory_id").orderBy(F.col("earliest").asc_nulls_first(), "id")
    return events(spark, root).select(_key("memory_id").alias("memory_id"), "id", "earliest").withColumn("place", F.row_number().over(order)).select("memory_id", "id", "place")


def entity_map(spark: SparkSession, root: str) -> DataFrame:
    """The bridge of entities and their memories, those present only."""
    m = load(spark, root, "entities").select(F.col("id").alias("entity_id"), F.explode("memory_ids").alias("m")).select("entity_id", _key("m").alias("memory_id")).distinct()
    return m.join(blocks(spark, root).select(_key("id").alias("memory_id")), "memory_id", "left_semi")


def session_rehydrate(spark: SparkSession, root: str) -> DataFrame:
    """What a session loads at its start: the blocks of the first two tiers."""
    return blocks(spark, root).filter(F.col("tier").isin(L1, L2)).select("id", "tier", F.coalesce("session_id", F.lit("none")).alias("session"))


def search_index_action(spark: SparkSession, root: str) -> DataFrame:
    """What the search index does with a block: second and third tier are kept in it, first and fourth are not."""
    return blocks(spark, root).select("id", F.when(F.col("tier").isin(L2, L3), "upsert").otherwise("delete").alias("action"))


# ---------------------------------------------------------------- tiers
def _paged(spark: SparkSession, root: str) -> DataFrame:
    """(id, n, last): how often each block was paged in, and when last; counted before any join."""
    t = turns(spark, root).select("turn_id", "logged_at", F.explode(F.array_distinct("paged_in_ids")).alias("i"))
    return t.groupBy(_key("i").alias("key")).agg(F.count("*").alias("n"), F.max("logged_at").alias("last"))


def touched_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Blocks after all page-ins: each adds an access and sets the time of the last one."""
    b = blocks(spark, root).withColumn("key", _key("id")).join(_paged(spark, root), "key")
    return b.select("id", (F.col("access_count") + F.col("n")).cast("bigint").alias("access_count"), F.unix_micros(F.greatest("last_accessed_at", "last")).alias("accessed_us"))


def page_in(spark: SparkSession, root: str) -> DataFrame:
    """Blocks that page-ins bring to the second tier; those that are in the first two stay."""
    b = blocks(spark, root).withColumn("key", _key("id")).join(_paged(spark, root), "key", "left_semi")
    return b.filter(~F.col("tier").isin(L1, L2)).select("id", F.col("tier").alias("from_tier"), F.lit(L2).alias("to_tier"))


def tier_normalised(spark: SparkSession, root: str) -> DataFrame:
    """Where new blocks of each tier go: the first tier stays, all else goes to the second."""
    b = blocks(spark, root).withColumn("new_tier", F.when(F.col("tier") == L1, L1).otherwise(L2))
    return b.groupBy("tier", "new_tier").agg(F.count("*").alias("n_blocks"))


def controller_state(spark: SparkSession, root: str) -> DataFrame:
    """Blocks that one sweep leaves in a tier or moves between two."""
    s = store.sweep(blocks(spark, root), as_of())
    return s.groupBy("tier", "new_tier").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("tier") != F.col("new_tier")).alias("n_moved"))


def block_delete(spark: SparkSession, root: str) -> DataFrame:
    """Blocks left, by tier, after those on the log of deletions are gone."""
    gone = load(spark, root, "removed_records").filter("record_table = 'memory_blocks'").select(_key("record_id").alias("key")).distinct()
    return blocks(spark, root).withColumn("key", _key("id")).join(gone, "key", "left_anti").groupBy("tier").agg(F.count("*").alias("n_blocks"))


# ---------------------------------------------------------------- texts
def storable(spark: SparkSession, root: str) -> DataFrame:
    c = conversation.classify_turns(spark, root)
    return c.withColumn("should_store", F.col("memory_type") != "NOISE")


def message_tags(spark: SparkSession, root: str) -> DataFrame:
    """The tag and importance of what a user says, by the first words that mark one."""
    low = F.lower("user_message")
    tag, score = F.lit("EPISODIC"), F.lit(5.0)
    for words, name, value in reversed(V.MESSAGE_TAGS):
        hit = reduce(lambda a, w: a | F.contains(low, F.lit(w)), words, F.lit(False))
        tag, score = F.when(hit, name).otherwise(tag), F.when(hit, value).otherwise(score)
    return turns(spark, root).filter("user_message IS NOT NULL").select("turn_id", tag.alias("tag"), score.alias("importance"))


def dates_in_texts(spark: SparkSession, root: str) -> DataFrame:
    """The first date in each block's text."""
    b = blocks(spark, root).select("id", F.trim(F.regexp_extract("content", V.DATE_IN_TEXT, 1)).alias("date_raw"))
    return b.filter("date_raw <> ''")


def mention_extract(spark: SparkSession, root: str) -> DataFrame:
    """Mentions in whole block texts: shorthands, then the patterns in order; a name counts once, as what found it first."""
    b = blocks(spark, root).select("id", "content")
    hand = [F.when(F.col("content").rlike(rf"(?i)\b{s}\b"), F.array(F.struct(F.lit(0).alias("k"), F.lit(s).alias("name"), F.lit(t).alias("kind")))).otherwise(F.array()) for s, t in V.SHORTHAND.items()]
    as_kind = lambda k, t: lambda n: F.struct(F.lit(k + 1).alias("k"), F.trim(n).alias("name"), F.lit(t).alias("kind"))
    found = [F.transform(F.regexp_extract_all("content", F.lit(p), F.lit(1)), as_kind(k, t)) for k, (p, t) in enumerate(V.MENTIONS)]
    rows = b.select("id", F.explode(F.concat(*hand, *found)).alias("m")).select("id", "m.*").filter("length(name) >= 2")
    one = rows.groupBy("id", F.lower("name").alias("name")).agg(F.min(F.struct("k", "kind")).alias("f"))
    return one.select("id", "name", F.col("f.kind").alias("entity_type"), (F.col("f.k") == 0).alias("is_shorthand"))


def mention_links(spark: SparkSession, root: str) -> DataFrame:
    """What the registry makes of each mentioned name: the most similar entity of its type as exact or alias match or for
    review, or a new entity, for review if one is similar at all. (name, entity_type, entity_id, match_type, needs_review)"""
    m = load(spark, root, "entity_mentions").filter("NOT is_shorthand AND surface_form <> ''").select(F.lower("surface_form").alias("name"), F.coalesce("entity_type", F.lit("unknown")).alias("entity_type")).distinct()
    e = load(spark, root, "entities").select(F.col("id").alias("entity_id"), F.coalesce("entity_type", F.lit("unknown")).alias("entity_type"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    known = cut(e.select("entity_id", "entity_type", F.lower("n").alias("right_low")).filter("right_low <> ''").distinct())
    pairs = similar(m, known.select(F.col("right_low").alias("name")), V.REVIEW_FROM).withColumnRenamed("left_low", "name").join(known, "right_low")
    best = m.join(pairs, ["name", "entity_type"]).groupBy("name", "entity_type", "similarity").agg(F.min("entity_id").alias("entity_id"))
    best = best.groupBy("name", "entity_type").agg(F.max(F.struct("similarity", "entity_id")).alias("b")).select("name", "entity_type", "b.*")
    s = F.coalesce("similarity", F.lit(0.0))
    kind = F.when(s == 1.0, "exact").when(s >= V.ALIAS_FROM, "alias").when(s >= V.FUZZY_FROM, "fuzzy").otherwise("new")
    out = m.join(best, ["name", "entity_type"], "left").select("name", "entity_type", F.when(s >= V.FUZZY_FROM, F.col("entity_id")).otherwise("").alias("entity_id"), kind.alias("match_type"), ((s >= V.REVIEW_FROM) & (s < V.ALIAS_FROM)).alias("needs_review"))
    return out


def memory_hit_labels(spark: SparkSession, root: str) -> DataFrame:
    """What a turn shows of its retrieval: the intent and the number of memories; nothing without any."""
    t = turns(spark, root).filter("user_message IS NOT NULL AND context_block_count > 0").select("turn_id", "context_block_count", "user_message")
    i = E.with_intent(t, "user_message")
    return i.select("turn_id", F.concat(F.initcap(F.lower("intent.intent")), F.lit(" · "), F.col("context_block_count").cast("string"), F.lit(" memories")).alias("label"))


# ---------------------------------------------------------------- events and consolidation
def event_bridge(spark: SparkSession, root: str) -> DataFrame:
    """Events made of facts with the entities of their memory: (fact_id, entity_id); facts without one have none."""
    f = E.indexable(facts(spark, root)).select(F.col("id").alias("fact_id"), _key("memory_id").alias("memory_id"))
    e = load(spark, root, "entities").select(F.col("id").alias("entity_id"), F.explode("memory_ids").alias("m")).select("entity_id", _key("m").alias("memory_id")).distinct()
    return f.join(e, "memory_id").select("fact_id", "entity_id")


def consolidation_report(spark: SparkSession, root: str) -> DataFrame:
    """Counts of a consolidation run's steps and its summary line."""
    step = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("step"), "n")
    steps = reduce(DataFrame.unionByName, [step("stable", timeline.stable_facts(spark, root)), step("demoted", timeline.cold_demotion(spark, root)), step("conflicts", timeline.conflict_flags(spark, root)), step("entities", timeline.entity_merge(spark, root))])
    n = lambda name: F.max(F.when(F.col("step") == name, F.col("n")))
    return steps.agg(F.format_string("stable=%d demoted=%d conflicts=%d entities=%d", n("stable"), n("demoted"), n("conflicts"), n("entities")).alias("summary"))


QUERIES = {f.__name__: f for f in (
    tiered_lookup, facts_for_memory, events_for_memory, entity_map, session_rehydrate, search_index_action, touched_blocks, page_in, tier_normalised, controller_state, block_delete, storable, message_tags, dates_in_texts,
    mention_extract, mention_links, memory_hit_labels, event_bridge, consolidation_report,
)}

_B = "b AS (SELECT * FROM memory_blocks QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_accessed_at DESC, access_count DESC) = 1)"
_T = "t AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY turn_id) = 1)"
_F = "f AS (SELECT * FROM structured_facts QUALIFY row_number() OVER (PARTITION BY id ORDER BY id) = 1)"
_EV = "ev AS (SELECT * FROM timeline_events QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC) = 1)"
_M = "m AS (SELECT DISTINCT id AS entity_id, lower(trim(x)) AS memory_id FROM (SELECT id, unnest(memory_ids) AS x FROM entities) WHERE x IS NOT NULL)"
_P = "p AS (SELECT lower(trim(i)) AS key, count(*) AS n, max(logged_at) AS last FROM (SELECT logged_at, unnest(list_distinct(paged_in_ids)) AS i FROM t) GROUP BY 1)"
_q = lambda s: s.replace("'", "''")
_TAGS = lambda k: "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(user_message), '{_q(w)}')" for w in ws) + f" THEN {v[k]!r}" for ws, *v in V.MESSAGE_TAGS) + f" ELSE {('EPISODIC', 5.0)[k]!r} END"
_MENTION = " UNION ALL ".join([f"SELECT id, '{s}' AS name, 0 AS k, '{t}' AS kind FROM b WHERE regexp_matches(content, '(?i)\\b{s}\\b')" for s, t in V.SHORTHAND.items()] + [f"SELECT id, unnest(regexp_extract_all(content, '{_q(p)}', 1)), {k + 1}, '{t}' FROM b" for k, (p, t) in enumerate(V.MENTIONS)])
SQL = {
    "tiered_lookup": f"WITH {_B}, {_M} SELECT a.memory_id, CASE WHEN tier = '{L1}' THEN 'L1' WHEN tier = '{L2}' THEN 'L2' WHEN tier IS NOT NULL THEN 'store' ELSE 'nowhere' END AS found_in FROM (SELECT DISTINCT memory_id FROM m WHERE memory_id <> '') a LEFT JOIN b ON lower(trim(b.id)) = a.memory_id",
    "facts_for_memory": f"WITH {_F} SELECT memory_id, id, predicate, row_number() OVER (PARTITION BY memory_id ORDER BY id)::INTEGER AS place FROM f",
    "events_for_memory": f"WITH {_EV} SELECT lower(trim(memory_id)) AS memory_id, id, row_number() OVER (PARTITION BY lower(trim(memory_id)) ORDER BY earliest NULLS FIRST, id)::INTEGER AS place FROM ev",
    "entity_map": f"WITH {_M} SELECT memory_id, entity_id FROM m WHERE memory_id IN (SELECT lower(trim(id)) FROM memory_blocks)",
    "session_rehydrate": f"WITH {_B} SELECT id, tier, coalesce(session_id, 'none') AS session FROM b WHERE tier IN ('{L1}', '{L2}')",
    "search_index_action": f"WITH {_B} SELECT id, CASE WHEN tier IN ('{L2}', '{L3}') THEN 'upsert' ELSE 'delete' END AS action FROM b",
    "touched_blocks": f"WITH {_B}, {_T}, {_P} SELECT id, (access_count + n)::BIGINT AS access_count, epoch_us(greatest(last_accessed_at, last))::BIGINT AS accessed_us FROM b JOIN p ON lower(trim(id)) = key",
    "page_in": f"WITH {_B}, {_T}, {_P} SELECT id, tier AS from_tier, '{L2}' AS to_tier FROM b WHERE tier NOT IN ('{L1}', '{L2}') AND lower(trim(id)) IN (SELECT key FROM p)",
    "tier_normalised": f"WITH {_B} SELECT tier, CASE WHEN tier = '{L1}' THEN tier ELSE '{L2}' END AS new_tier, count(*)::BIGINT AS n_blocks FROM b GROUP BY 1, 2",
    "block_delete": f"WITH {_B} SELECT tier, count(*)::BIGINT AS n_blocks FROM b WHERE lower(trim(id)) NOT IN (SELECT lower(trim(record_id)) FROM removed_records WHERE record_table = 'memory_blocks' AND record_id IS NOT NULL) GROUP BY 1",
    "message_tags": f"WITH {_T} SELECT turn_id, {_TAGS(0)} AS tag, ({_TAGS(1)})::DOUBLE AS importance FROM t WHERE user_message IS NOT NULL",
    "dates_in_texts": f"WITH {_B} SELECT id, trim(regexp_extract(content, '{V.DATE_IN_TEXT}', 1)) AS date_raw FROM b WHERE trim(regexp_extract(content, '{V.DATE_IN_TEXT}', 1)) <> ''",
    "mention_extract": f"WITH {_B}, r AS ({_MENTION}) SELECT id, lower(trim(name)) AS name, arg_min(kind, k) AS entity_type, min(k) = 0 AS is_shorthand FROM r WHERE length(trim(name)) >= 2 GROUP BY 1, 2",
    "event_bridge": f"WITH {_F}, {_M}, x AS (SELECT id AS fact_id, lower(trim(memory_id)) AS memory_id FROM f WHERE earliest IS NOT NULL AND latest IS NOT NULL AND temporal_confidence >= 0.25 AND predicate IN ({', '.join(repr(p) for p in V.INDEXABLE)})) SELECT fact_id, entity_id FROM x JOIN m USING (memory_id)",
    "mention_links": """WITH m AS (SELECT DISTINCT lower(surface_form) AS name, coalesce(entity_type, 'unknown') AS entity_type FROM entity_mentions WHERE NOT is_shorthand AND surface_form <> ''),
k AS (SELECT DISTINCT id AS entity_id, coalesce(entity_type, 'unknown') AS entity_type, lower(n) AS b FROM (SELECT id, entity_type, unnest(list_concat([name], coalesce(aliases, []))) AS n FROM entities) WHERE n <> ''),
mt AS (SELECT *, list_distinct(regexp_extract_all(name, '\\w+')) AS ta FROM m), kt AS (SELECT *, list_distinct(regexp_extract_all(b, '\\w+')) AS tb FROM k),
s AS (SELECT mt.name, mt.entity_type, entity_id, round(greatest(CASE WHEN len(list_distinct(ta || tb)) > 0 THEN len(list_intersect(ta, tb)) / len(list_distinct(ta || tb))::DOUBLE ELSE 0 END, CASE WHEN contains(name, b) OR contains(b, name) THEN 0.8 ELSE 0 END), 6) AS s FROM mt JOIN kt ON mt.entity_type = kt.entity_type),
g AS (SELECT * FROM s WHERE s >= 0.6 QUALIFY row_number() OVER (PARTITION BY name, entity_type ORDER BY s DESC, entity_id) = 1)
SELECT m.name, m.entity_type, CASE WHEN s >= 0.85 THEN entity_id ELSE '' END AS entity_id, CASE WHEN s = 1 THEN 'exact' WHEN s >= 0.95 THEN 'alias' WHEN s >= 0.85 THEN 'fuzzy' ELSE 'new' END AS match_type, coalesce(s >= 0.6 AND s < 0.95, false) AS needs_review
FROM m LEFT JOIN g ON g.name = m.name AND g.entity_type = m.entity_type""",
    "storable": f"SELECT *, memory_type <> 'NOISE' AS should_store FROM ({conversation.SQL['classify_turns']})",
    "consolidation_report": " ".join(["SELECT 'stable=' || (SELECT count(*) FROM (", timeline.SQL["stable_facts"], ")) || ' demoted=' || (SELECT count(*) FROM (", timeline.SQL["cold_demotion"], ")) || ' conflicts=' || (SELECT count(*) FROM (", timeline.SQL["conflict_flags"], ")) || ' entities=' || (SELECT count(*) FROM (", timeline.SQL["entity_merge"], ")) AS summary"]),
    "memory_hit_labels": f"WITH qi AS ({conversation.SQL['query_intent']}), {_T} SELECT turn_id, upper(intent[1]) || lower(intent[2:]) || ' · ' || context_block_count || ' memories' AS label FROM t JOIN (SELECT DISTINCT qid, intent FROM qi) ON qid = 't' || turn_id WHERE user_message IS NOT NULL AND context_block_count > 0",
}
SQL["controller_state"] = f"SELECT tier, new_tier, count(*)::BIGINT AS n_blocks, count_if(tier <> new_tier)::BIGINT AS n_moved FROM ({BLOCK_SQL['eviction_sweep']}) GROUP BY 1, 2"
# queries of other modules whose SQL is put together from that of several
_CLASSES = conversation.SQL["classify_turns"]
_SIDES = "SELECT turn_id, 'user' AS source, user_message AS text FROM t UNION ALL SELECT turn_id, 'assistant', assistant_reply FROM t"
_KINDS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.SHORTHAND.items())
_DAY = lambda c: f"floor(epoch_us({c}) / 86400000000.0)"
_STOP = ", ".join(f"'{w}'" for w in V.KEYWORD_STOP)
SQL["type_promotion"] = f"""WITH {_B}, c AS ({_CLASSES.replace(_SIDES, "SELECT id AS turn_id, lower(trim(source)) AS source, content AS text FROM b")})
SELECT id, 'USER_FACT' AS new_type FROM b JOIN c ON c.turn_id = b.id WHERE memory_type = 'TEMPORARY_CONTEXT' AND access_count >= 8"""
SQL["action_counts"] = " UNION ALL ".join(f"SELECT '{name}' AS action, count(*)::BIGINT AS n FROM ({timeline.SQL[query]})" for name, query in (("stable_fact", "stable_facts"), ("conflict", "conflict_flags"), ("demoted", "cold_demotion")))
SQL["shorthand_asof"] = f"""WITH {_B}, m AS (SELECT DISTINCT mention_id, memory_id, CASE lower(surface_form) {_KINDS} END AS kind FROM entity_mentions WHERE is_shorthand),
d AS (SELECT mention_id, memory_id, kind, {_DAY('created_at')} AS day FROM m JOIN b ON b.id = memory_id WHERE kind IS NOT NULL)
SELECT mention_id, arg_max(e.id, (e.first_seen, e.id)) AS entity_id FROM d JOIN entities e ON e.entity_type = kind AND {_DAY('e.first_seen')} + 1 <= day GROUP BY mention_id, memory_id"""
SQL["keyword_coverage"] = evaluation.SQL["judge_cascade"].split(",\na1 AS")[0] + f""", w AS (SELECT item_id, response, list_filter(regexp_extract_all(lower(expected), '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_-]*[\\p{{L}}\\p{{N}}_]'), lambda x: regexp_full_match(x, '[a-z0-9-]{{2,}}')) AS ws FROM a0),
k AS (SELECT item_id, response, list_filter(ws, lambda x, i: list_position(ws, x) = i AND NOT list_contains([{_STOP}], x))[1:15] AS ws FROM w)
SELECT item_id, round(CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda x: contains(lower(response), x))) / len(ws)::DOUBLE ELSE 0.0 END, 6) AS coverage FROM k"""
