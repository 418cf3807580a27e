"""Queries on facts, events and entities: intervals, first events, orders, conflicts, stable facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark.functions import scoring as S
from memspark.functions import temporal as T
from memspark.functions import text as X
from memspark.functions import vocab as V
from memspark.operators import extract as E
from memspark.operators import store
from memspark.plans.blocks import as_of, blocks
from memspark.sources import load

ANCHOR = "2024-03-15 10:00:00"


def facts(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "structured_facts").dropDuplicates(["id"])


def events(spark: SparkSession, root: str) -> DataFrame:
    return store.current(load(spark, root, "timeline_events"), "id", ["created_at"])


def links(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "entity_event_map").select("entity_id", F.lower(F.trim("event_id")).alias("event_id")).distinct()


def predicate_norm(spark: SparkSession, root: str) -> DataFrame:
    table = F.transform(F.array(*[F.lit(x) for x in ["  Bought ", "picked up", "WENT TO", "live in", "hate", "sketched"]]), lambda x: x)
    raw = facts(spark, root).select("predicate").unionByName(spark.range(1).select(F.explode(table).alias("predicate")))
    return raw.groupBy("predicate").agg(F.count("*").alias("n_facts")).withColumn("normalised", E.normalise_predicate(F.col("predicate")))


def temporal_bound(spark: SparkSession, root: str) -> DataFrame:
    raw = facts(spark, root).filter("date_raw <> ''").groupBy("date_raw").agg(F.count("*").alias("n_facts"))
    more = ["yesterday", "today", "last week", "last month", "last year", "3 days ago", "2 weeks ago", "3 months ago", "2 years ago", "early 2024", "mid 2023", "late 2022", "recently", "a while ago", "December", "in March", "no date"]
    raw = raw.unionByName(spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in more])).alias("date_raw"), F.lit(0).cast("bigint").alias("n_facts")))
    out = E.dated(raw, "date_raw", F.lit(ANCHOR).cast("timestamp"))
    return out.select("date_raw", "n_facts", F.coalesce(F.unix_micros("p_earliest"), F.lit(-1)).alias("earliest_us"), F.coalesce(F.unix_micros("p_latest"), F.lit(-1)).alias("latest_us"), F.coalesce("p_confidence", F.lit(0.0)).alias("p_confidence"), "p_granularity").distinct()


def interval_midpoint(spark: SparkSession, root: str) -> DataFrame:
    e = events(spark, root).filter("earliest IS NOT NULL AND latest IS NOT NULL")
    return e.select("id", F.unix_micros(T.midpoint(F.col("earliest"), F.col("latest"))).alias("mid_us"))


def events_in_range(spark: SparkSession, root: str) -> DataFrame:
    """Events that overlap each month: every interval is exploded to its months, so the join is on equal months."""
    e = events(spark, root).filter("earliest <= latest").select("event_type", F.explode(F.expr("sequence(trunc(earliest, 'month'), trunc(latest, 'month'), interval 1 month)")).alias("month"))
    return e.groupBy(F.date_format("month", "yyyy-MM").alias("month"), "event_type").agg(F.count("*").alias("n_events"))


def is_before(spark: SparkSession, root: str) -> DataFrame:
    """Each event of a memory against the first one of the memory."""
    e = events(spark, root).filter("earliest IS NOT NULL AND latest IS NOT NULL")
    cols = ["earliest", "latest", "temporal_confidence", "id"]
    first = e.groupBy("memory_id").agg(F.min(F.struct(*cols)).alias("f"))
    both = e.join(first, "memory_id").filter("id <> f.id")
    order = T.is_before(F.col("f.earliest"), F.col("f.latest"), F.col("f.temporal_confidence"), F.col("earliest"), F.col("latest"), F.col("temporal_confidence"))
    return both.select("id", F.coalesce(order.cast("string"), F.lit("unknown")).alias("first_is_before"))


def timeline_store(spark: SparkSession, root: str) -> DataFrame:
    f = E.indexable(facts(spark, root))
    return f.select("id", "memory_id", F.concat_ws(" ", "subject", "predicate", "object_value").alias("description"), F.col("predicate").alias("event_type"), F.unix_micros("earliest").alias("earliest_us"))


def events_for_entity(spark: SparkSession, root: str) -> DataFrame:
    e = events(spark, root).select(F.lower(F.trim("id")).alias("event_id"), "event_type", F.unix_micros("earliest").alias("earliest_us"))
    who = load(spark, root, "entities").filter("entity_type = 'device'").select(F.col("id").alias("entity_id")).distinct()
    return links(spark, root).join(who, "entity_id", "left_semi").join(e, "event_id").select("entity_id", "event_id", "event_type", "earliest_us")


def events_union(spark: SparkSession, root: str) -> DataFrame:
    """Distinct events of all places and projects."""
    who = load(spark, root, "entities").filter("entity_type IN ('place', 'project')").select(F.col("id").alias("entity_id")).distinct()
    ids = links(spark, root).join(who, "entity_id", "left_semi").select("event_id").distinct()
    return events(spark, root).withColumn("event_id", F.lower(F.trim("id"))).join(ids, "event_id", "left_semi").select("event_id", "event_type")


def events_for_every_entity(spark: SparkSession, root: str) -> DataFrame:
    """Events of all linked entities, those of unknown type included."""
    e = events(spark, root).select(F.lower(F.trim("id")).alias("event_id"), "event_type", F.unix_micros("earliest").alias("earliest_us"))
    return links(spark, root).join(e, "event_id").select("entity_id", "event_id", "event_type", "earliest_us").distinct()


def events_union_every(spark: SparkSession, root: str) -> DataFrame:
    """Distinct events of all linked entities."""
    ids = links(spark, root).select("event_id").distinct()
    return events(spark, root).withColumn("event_id", F.lower(F.trim("id"))).join(ids, "event_id", "left_semi").select("event_id", "event_type").distinct()


def _first(spark: SparkSession, root: str) -> DataFrame:
    e = events(spark, root).filter("earliest IS NOT NULL AND latest IS NOT NULL").select(F.lower(F.trim("id")).alias("event_id"), "event_type", "earliest", "latest", "temporal_confidence")
    one = links(spark, root).join(e, "event_id").groupBy("entity_id").agg(F.min(F.struct("earliest", "event_id", "latest", "temporal_confidence", "event_type")).alias("f"))
    return one.select("entity_id", "f.*")


def first_event(spark: SparkSession, root: str) -> DataFrame:
    return _first(spark, root).select("entity_id", "event_id", "event_type", F.unix_micros("earliest").alias("earliest_us"))


def compare_order(spark: SparkSession, root: str) -> DataFrame:
    """Each entity's first event against that of the entity of its type with the smallest id."""
    who = load(spark, root, "entities").select(F.col("id").alias("entity_id"), "entity_type").distinct()
    f = _first(spark, root).join(who, "entity_id")
    base = f.groupBy("entity_type").agg(F.min(F.struct("entity_id", "earliest", "latest", "temporal_confidence")).alias("b"))
    p = f.join(base, "entity_type").filter("entity_id <> b.entity_id")
    a, b = T.midpoint(F.col("b.earliest"), F.col("b.latest")), T.midpoint(F.col("earliest"), F.col("latest"))
    unsure = (F.col("b.temporal_confidence") < V.COMPARE_CONFIDENCE) | (F.col("temporal_confidence") < V.COMPARE_CONFIDENCE)
    result = F.when(unsure, "low_confidence").when(T.overlaps(F.col("b.earliest"), F.col("b.latest"), F.col("earliest"), F.col("latest")), "overlap").when(a < b, "before").otherwise("after")
    return p.select(F.col("b.entity_id").alias("entity_a"), F.col("entity_id").alias("entity_b"), result.alias("result"), S.gap_days(a, b).alias("delta_days"))


def build_timeline(spark: SparkSession, root: str) -> DataFrame:
    e = events(spark, root)
    return e.filter((F.col("event_type") == "purchased") & (F.col("latest") >= "2023-06-01") & (F.col("earliest") <= "2023-12-31")).select("id", F.unix_micros("earliest").alias("earliest_us"), "granularity")


def timeline_first_200(spark: SparkSession, root: str) -> DataFrame:
    return events(spark, root).filter("earliest IS NOT NULL").orderBy("earliest", "id").limit(200).select("id", "event_type")


def event_delete_cascade(spark: SparkSession, root: str) -> DataFrame:
    """Links left after the events of removed memories are gone, per entity."""
    gone = load(spark, root, "removed_records").filter("record_table = 'memory_blocks'").select(F.col("record_id").alias("memory_id"))
    e = events(spark, root).withColumn("id", F.lower(F.trim("id"))).withColumn("memory_id", F.lower(F.trim("memory_id")))
    _, kept = store.delete_events(e, links(spark, root), gone)
    return kept.groupBy("entity_id").agg(F.count("*").alias("n_links"))


def stable_facts(spark: SparkSession, root: str) -> DataFrame:
    norm = lambda c: F.lower(F.trim(c))
    g = facts(spark, root).groupBy(norm("subject").alias("subject"), norm("predicate").alias("predicate"), norm("object_value").alias("object_value"))
    c = g.agg(F.count("*").alias("n_facts"), F.avg("confidence").alias("mean"), F.count_distinct("memory_id").alias("n_memories"), F.max("temporal_confidence").alias("best_temporal")).filter("n_facts >= 3")
    conf = F.least(F.lit(0.99), F.lit(0.6) * F.col("mean") + F.lit(0.4) * (1 - 1 / (1 + F.lit(0.5) * F.col("n_facts"))))
    return c.select("subject", "predicate", "object_value", "n_facts", "n_memories", "best_temporal", F.round(conf, 6).alias("confidence"))


def conflict_flags(spark: SparkSession, root: str) -> DataFrame:
    """Facts whose subject and object stand with several predicates; flagged by aggregation and a join back, not a window."""
    f = facts(spark, root).withColumns({"s": F.lower("subject"), "o": F.lower("object_value")})
    bad = f.groupBy("s", "o").agg(F.count_distinct("predicate").alias("n_predicates")).filter("n_predicates > 1")
    return f.join(bad, ["s", "o"]).select("id", "n_predicates")


def fact_accessors(spark: SparkSession, root: str) -> DataFrame:
    f = facts(spark, root)
    dated = F.col("earliest").isNotNull() & F.col("latest").isNotNull()
    return f.select("id", F.when(dated, F.unix_micros(T.midpoint(F.col("earliest"), F.col("latest")))).otherwise(-1).alias("date_us"), F.when(dated, F.col("temporal_confidence")).otherwise(0.0).alias("date_confidence"))


def fact_extract(spark: SparkSession, root: str) -> DataFrame:
    """First-person sentences made of the stored facts, read back by the extraction rules."""
    verb = F.when(F.col("predicate") == "purchased", "bought a").when(F.col("predicate") == "works_at", "work at").when(F.col("predicate") == "lives_in", "live in").when(F.col("predicate") == "attended", "attended the").otherwise("prefer")
    f = facts(spark, root).select(F.col("id").alias("memory_id"), F.concat(F.lit("I "), verb, F.lit(" "), F.col("object_value"), F.when(F.col("date_raw") != "", F.concat(F.lit(" in "), F.col("date_raw"))).otherwise(F.lit("")), F.lit(".")).alias("text"))
    return E.facts(f)


def fact_extract_stored(spark: SparkSession, root: str) -> DataFrame:
    """Facts stated in the whole texts of memory blocks and of users' messages."""
    b = load(spark, root, "memory_blocks").select(F.lit("memory_blocks").alias("src"), F.col("id").alias("memory_id"), F.col("content").alias("text"))
    t = load(spark, root, "turns").select(F.lit("turns").alias("src"), F.col("turn_id").cast("string").alias("memory_id"), F.col("user_message").alias("text"))
    parts = [E.facts(x.filter("memory_id IS NOT NULL").distinct()).withColumn("src_table", F.lit(k)) for k, x in (("memory_blocks", b), ("turns", t))]
    return E.union_all(parts)


def name_similarity(spark: SparkSession, root: str) -> DataFrame:
    """Mentions against the names of the entities of their memory."""
    m = load(spark, root, "entity_mentions").filter("NOT is_shorthand").select("mention_id", "memory_id", "surface_form").distinct()
    e = load(spark, root, "entities").select(F.col("id").alias("entity_id"), "name", F.explode("memory_ids").alias("memory_id")).distinct()
    s = X.name_similarity(F.col("surface_form"), F.col("name"))
    return m.join(e, "memory_id").withColumn("similarity", F.round(s, 6)).filter("similarity >= 0.6").select("mention_id", "entity_id", "similarity").distinct()


def entity_merge(spark: SparkSession, root: str) -> DataFrame:
    """Entities of one type and lower-case name as one: aliases and memories united, counts summed, times widened."""
    e = load(spark, root, "entities").groupBy("id").agg(F.max_by(F.struct("name", "entity_type", "aliases", "memory_ids", "reference_count", "first_seen", "last_seen"), F.struct("reference_count", "last_seen")).alias("_")).select("id", "_.*")
    key = F.lower("name").alias("name")
    g = e.groupBy("entity_type", key).agg(
        F.min("id").alias("id"), F.sum("reference_count").cast("bigint").alias("reference_count"), F.coalesce(F.unix_micros(F.min("first_seen")), F.lit(-1)).alias("first_us"), F.coalesce(F.unix_micros(F.max("last_seen")), F.lit(-1)).alias("last_us"), F.count("*").alias("n_rows")
    )
    # memories are counted by explosion: a name's lists are never gathered in one row
    m = e.select("entity_type", key, F.explode("memory_ids").alias("m")).groupBy(F.col("entity_type").alias("t"), F.col("name").alias("k")).agg(F.count_distinct("m").cast("int").alias("n_memories"))
    both = g.join(m, g["entity_type"].eqNullSafe(m["t"]) & g["name"].eqNullSafe(m["k"]), "left")
    return both.select("entity_type", "name", "id", "reference_count", "first_us", "last_us", F.coalesce("n_memories", F.lit(0)).alias("n_memories"), "n_rows")


def _like_flagged(spark: SparkSession, root: str) -> DataFrame:
    """Flagged entities against all of their type, of similarity at least 0.75: (left_id, right_id, a, b, similarity).

    Names of n words whose words overlap to 0.75 share one of the floor(n / 4) + 1 rarest words of either. A name that
    another one contains has all its character trigrams there (if it is shorter, itself), so the rarest of them too."""
    e = load(spark, root, "entities").select("id", "name", "entity_type", "needs_review").filter("name IS NOT NULL AND entity_type IS NOT NULL").dropDuplicates(["id"])
    t = e.withColumn("tokens", X.name_tokens(F.col("name"))).withColumns({"n_tokens": F.size("tokens"), "token": F.explode("tokens")})
    seen = t.groupBy("entity_type", "token").agg(F.count("*").alias("n"))
    order = Window.partitionBy("id").orderBy("n", "token")
    prefix = t.join(seen, ["entity_type", "token"]).withColumn("place", F.row_number().over(order)).filter("place <= n_tokens div 4 + 1").select("token", "entity_type", "id", "name", "needs_review")
    pieces = lambda k: F.transform(F.sequence(F.lit(1), F.length("low") - (k - 1)), lambda i: F.substr("low", i, F.lit(k)))
    low = e.withColumn("low", F.lower("name")).filter("low <> ''")
    grams = {k: low.filter(F.length("low") >= k).withColumn("token", F.explode(F.array_distinct(pieces(k)))) for k in (1, 2, 3)}
    inner = E.union_all([grams[1].filter("length(low) = 1"), grams[2].filter("length(low) = 2"), grams[3]])
    outer = E.union_all(list(grams.values()))
    seen = outer.groupBy("entity_type", "token").agg(F.count("*").alias("n"))
    rarest = inner.join(seen, ["entity_type", "token"]).groupBy("id", "entity_type", "name", "needs_review").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    left = lambda df: df.filter("needs_review").select("token", "entity_type", F.col("id").alias("left_id"), F.col("name").alias("a"))
    right = lambda df: df.select("token", "entity_type", F.col("id").alias("right_id"), F.col("name").alias("b"))
    met = [left(x).join(right(y), ["token", "entity_type"]).filter("left_id <> right_id").select("left_id", "right_id", "a", "b") for x, y in ((prefix, prefix), (rarest, outer), (outer, rarest))]
    return E.union_all(met).distinct().withColumn("similarity", F.round(X.name_similarity(F.col("a"), F.col("b")), 6)).filter("similarity >= 0.75")


def duplicate_entities(spark: SparkSession, root: str) -> DataFrame:
    """Flagged entities against all of their type, of similarity at least 0.75, that share a word."""
    return _like_flagged(spark, root).filter(F.arrays_overlap(X.name_tokens(F.col("a")), X.name_tokens(F.col("b")))).select("left_id", "right_id", "similarity")


def duplicate_entities_every(spark: SparkSession, root: str) -> DataFrame:
    """The same with names that one name contains without a whole word in common."""
    return _like_flagged(spark, root).select("left_id", "right_id", "similarity")


def entity_overlap(spark: SparkSession, root: str) -> DataFrame:
    """Share of each event's entities that its memory is listed with."""
    e = load(spark, root, "timeline_events").select("id", "memory_id", "entities").filter("size(entities) > 0").dropDuplicates(["id"])
    q = e.select("id", F.lower(F.trim("memory_id")).alias("memory_id"), F.explode(F.array_distinct("entities")).alias("entity_id"))
    m = load(spark, root, "entities").select(F.col("id").alias("entity_id"), F.explode("memory_ids").alias("memory_id")).select("entity_id", F.lower(F.trim("memory_id")).alias("memory_id"), F.lit(1).alias("hit")).distinct()
    return q.join(m, ["entity_id", "memory_id"], "left").groupBy("id").agg(F.round(F.coalesce(F.sum("hit"), F.lit(0)) / F.count("*"), 6).alias("overlap"))


def timeline_relevance(spark: SparkSession, root: str) -> DataFrame:
    e = events(spark, root)
    return e.groupBy(F.lower(F.trim("memory_id")).alias("memory_id")).agg(F.round(F.least(F.lit(1.0), F.max("temporal_confidence")), 6).alias("relevance"), F.round(F.avg("temporal_confidence"), 6).alias("mean_confidence"), F.count("*").alias("n_events"))


def cold_demotion(spark: SparkSession, root: str) -> DataFrame:
    """Old blocks of low salience get weight 0.3."""
    b = blocks(spark, root)
    age = S.age_days(as_of(), F.col("last_accessed_at"))
    return b.filter((age >= 180) & (S.salience(age, F.col("access_count")) < 0.30)).select("id", F.lit(0.3).alias("weight"))


def type_promotion(spark: SparkSession, root: str) -> DataFrame:
    b = blocks(spark, root).withColumn("c", E.classify(F.col("content"), F.lower(F.trim("source"))))
    return b.filter("c.memory_type = 'TEMPORARY_CONTEXT' AND access_count >= 8").select("id", F.lit("USER_FACT").alias("new_type"))


def shorthand_asof(spark: SparkSession, root: str) -> DataFrame:
    """Shorthand mentions linked to the entity of their type that was last seen first before the day of their block.

    Entities are reduced to one per type and day, so the running maximum is over days, not rows."""
    kinds = F.create_map(*[x for k, v in V.SHORTHAND.items() for x in (F.lit(k), F.lit(v))])
    m = load(spark, root, "entity_mentions").filter("is_shorthand").select("mention_id", "memory_id", kinds[F.lower("surface_form")].alias("entity_type")).filter("entity_type IS NOT NULL").distinct()
    m = m.join(blocks(spark, root).select(F.col("id").alias("memory_id"), F.to_date("created_at").alias("day")), "memory_id")
    e = load(spark, root, "entities").filter("first_seen IS NOT NULL").groupBy("entity_type", F.date_add(F.to_date("first_seen"), 1).alias("day")).agg(F.max(F.struct("first_seen", "id")).alias("best"))
    days = m.select("entity_type", "day").distinct()
    order = Window.partitionBy("entity_type").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    line = e.unionByName(days, allowMissingColumns=True).groupBy("entity_type", "day").agg(F.max("best").alias("best")).withColumn("best", F.max("best").over(order))
    return m.join(line, ["entity_type", "day"]).filter("best IS NOT NULL").select("mention_id", F.col("best.id").alias("entity_id"))


QUERIES = {f.__name__: f for f in (
    predicate_norm, temporal_bound, interval_midpoint, events_in_range, is_before, timeline_store, events_for_entity, events_union, events_for_every_entity, events_union_every, first_event, compare_order, build_timeline, timeline_first_200, event_delete_cascade, stable_facts,
    conflict_flags, fact_accessors, fact_extract, fact_extract_stored, name_similarity, entity_merge, duplicate_entities, duplicate_entities_every, entity_overlap, timeline_relevance, cold_demotion, type_promotion, shorthand_asof,
)}

EV = "WITH ev AS (SELECT * FROM timeline_events QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC) = 1),\nfa AS (SELECT * FROM structured_facts QUALIFY row_number() OVER (PARTITION BY id ORDER BY id) = 1),\nli AS (SELECT DISTINCT entity_id, lower(trim(event_id)) AS event_id FROM entity_event_map),\nfirst AS (SELECT entity_id, lower(trim(id)) AS event_id, event_type, earliest, latest, temporal_confidence FROM li JOIN ev ON lower(trim(ev.id)) = li.event_id WHERE earliest IS NOT NULL AND latest IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY earliest, event_id) = 1)\n"
_MON = "list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], {0}[1:3])"
_PAIRS = ", ".join(f"('{k}', '{v}')" for k, v in V.PREDICATES.items())
_ANCH = f"TIMESTAMP '{ANCHOR}'"
_M = "(january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)"
_us = "epoch_us({0})::BIGINT"
_mid = "(epoch_us({0}) + (epoch_us({1}) - epoch_us({0})) // 2)::BIGINT"
_SIM = "greatest(CASE WHEN len(list_distinct(ta || tb)) > 0 THEN len(list_intersect(ta, tb)) / len(list_distinct(ta || tb))::DOUBLE ELSE 0 END, CASE WHEN a <> '' AND b <> '' AND (contains(lower(a), lower(b)) OR contains(lower(b), lower(a))) THEN 0.8 ELSE 0 END)"
_TOK = "list_distinct(regexp_extract_all(lower({0}), '\\w+'))"

SQL = {
    "predicate_norm": EV
    + f""", raw AS (SELECT predicate FROM fa UNION ALL SELECT unnest(['  Bought ', 'picked up', 'WENT TO', 'live in', 'hate', 'sketched'])), m(k, v) AS (VALUES {_PAIRS})
SELECT predicate, count(*)::BIGINT AS n_facts, coalesce(any_value(v), lower(trim(predicate))) AS normalised FROM raw LEFT JOIN m ON m.k = lower(trim(predicate)) GROUP BY predicate""",
    "temporal_bound": EV
    + f""", raw AS (SELECT date_raw, count(*)::BIGINT AS n_facts FROM fa WHERE date_raw <> '' GROUP BY 1 UNION ALL
  SELECT unnest(['yesterday','today','last week','last month','last year','3 days ago','2 weeks ago','3 months ago','2 years ago','early 2024','mid 2023','late 2022','recently','a while ago','December','in March','no date']), 0),
x AS (SELECT *, lower(trim(date_raw)) AS t FROM raw),
y AS (SELECT *, regexp_extract(t, '^(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) AS iso, regexp_extract(t, '^(?:in\\s+)?{_M}\\.?,?\\s+(\\d{{4}})\\b', 1) AS mw, regexp_extract(t, '^(?:in\\s+)?{_M}\\.?,?\\s+(\\d{{4}})\\b', 2) AS my,
  regexp_extract(t, '\\b(early|mid|late)[\\s-]+(\\d{{4}})\\b', 1) AS part, regexp_extract(t, '\\b(early|mid|late)[\\s-]+(\\d{{4}})\\b', 2) AS py, regexp_extract(t, '\\b((?:19|20)\\d{{2}})\\b', 1) AS yr, regexp_extract(t, '\\b{_M}\\b', 1) AS mo,
  try_cast(nullif(regexp_extract(t, '\\b(\\d{{1,4}})\\s+(day|week|month|year)s?\\s+ago\\b', 1), '') AS INTEGER) AS k, regexp_extract(t, '\\b(\\d{{1,4}})\\s+(day|week|month|year)s?\\s+ago\\b', 2) AS unit FROM x),
z AS (SELECT *, CASE
  WHEN iso <> '' THEN struct_pack(a := try_cast(iso AS TIMESTAMP), b := try_cast(iso AS TIMESTAMP), c := 1.0::DOUBLE, g := 'exact')
  WHEN my <> '' THEN struct_pack(a := make_date(my::INT, {_MON.format("mw")}::INT, 1)::TIMESTAMP, b := last_day(make_date(my::INT, {_MON.format("mw")}::INT, 1))::TIMESTAMP, c := 0.7::DOUBLE, g := 'month')
  WHEN py <> '' THEN struct_pack(a := make_date(py::INT, CASE part WHEN 'early' THEN 1 WHEN 'mid' THEN 4 ELSE 9 END, 1)::TIMESTAMP, b := last_day(make_date(py::INT, CASE part WHEN 'early' THEN 4 WHEN 'mid' THEN 9 ELSE 12 END, 1))::TIMESTAMP, c := 0.55::DOUBLE, g := 'year')
  WHEN yr <> '' THEN struct_pack(a := make_date(yr::INT, 1, 1)::TIMESTAMP, b := make_date(yr::INT, 12, 31)::TIMESTAMP, c := 0.55::DOUBLE, g := 'year')
  WHEN mo <> '' THEN struct_pack(a := make_date(CASE WHEN {_MON.format("mo")} > 3 THEN 2023 ELSE 2024 END, {_MON.format("mo")}::INT, 1)::TIMESTAMP, b := last_day(make_date(CASE WHEN {_MON.format("mo")} > 3 THEN 2023 ELSE 2024 END, {_MON.format("mo")}::INT, 1))::TIMESTAMP, c := 0.5::DOUBLE, g := 'month')
  WHEN t = 'yesterday' THEN struct_pack(a := {_ANCH} - INTERVAL 1 DAY, b := {_ANCH} - INTERVAL 1 DAY, c := 0.95::DOUBLE, g := 'day')
  WHEN t = 'today' THEN struct_pack(a := {_ANCH}, b := {_ANCH}, c := 0.95::DOUBLE, g := 'day')
  WHEN t = 'last week' THEN struct_pack(a := TIMESTAMP '2024-03-04 10:00:00', b := TIMESTAMP '2024-03-10 10:00:00', c := 0.75::DOUBLE, g := 'week')
  WHEN t = 'last month' THEN struct_pack(a := TIMESTAMP '2024-02-01', b := TIMESTAMP '2024-02-29', c := 0.75::DOUBLE, g := 'month')
  WHEN t = 'last year' THEN struct_pack(a := TIMESTAMP '2023-01-01', b := TIMESTAMP '2023-12-31', c := 0.65::DOUBLE, g := 'year')
  WHEN unit = 'day' THEN struct_pack(a := {_ANCH} - to_days(k), b := {_ANCH} - to_days(k), c := 0.85::DOUBLE, g := 'day')
  WHEN unit = 'week' THEN struct_pack(a := {_ANCH} - to_days(7 * k + 6), b := {_ANCH} - to_days(7 * k), c := 0.75::DOUBLE, g := 'week')
  WHEN unit = 'month' THEN struct_pack(a := DATE '2024-03-01' - to_months(k), b := last_day(DATE '2024-03-01' - to_months(k))::TIMESTAMP, c := 0.7::DOUBLE, g := 'month')
  WHEN unit = 'year' THEN struct_pack(a := DATE '2024-01-01' - to_months(12 * k), b := last_day(DATE '2024-12-01' - to_months(12 * k))::TIMESTAMP, c := 0.65::DOUBLE, g := 'year')
  WHEN t = 'recently' THEN struct_pack(a := {_ANCH} - to_days(30), b := {_ANCH}, c := 0.4::DOUBLE, g := 'month')
  WHEN t = 'a while ago' THEN struct_pack(a := {_ANCH} - to_days(365), b := {_ANCH} - to_days(30), c := 0.25::DOUBLE, g := 'year') END AS s FROM y)
SELECT DISTINCT date_raw, n_facts, coalesce(epoch_us(s.a), -1)::BIGINT AS earliest_us, coalesce(epoch_us(s.b), -1)::BIGINT AS latest_us, coalesce(s.c, 0) AS p_confidence, s.g AS p_granularity FROM z""",
    "interval_midpoint": EV + f"SELECT id, {_mid.format('earliest', 'latest')} AS mid_us FROM ev WHERE earliest IS NOT NULL AND latest IS NOT NULL",
    "events_in_range": EV
    + """, m AS (SELECT event_type, unnest(generate_series(date_trunc('month', earliest::TIMESTAMP), date_trunc('month', latest::TIMESTAMP), INTERVAL 1 MONTH)) AS month FROM ev WHERE earliest <= latest)
SELECT strftime(month, '%Y-%m') AS month, event_type, count(*)::BIGINT AS n_events FROM m GROUP BY 1, 2""",
    "is_before": EV
    + """, d AS (SELECT * FROM ev WHERE earliest IS NOT NULL AND latest IS NOT NULL), f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY earliest, latest, temporal_confidence, id) = 1)
SELECT d.id, coalesce(CASE WHEN f.temporal_confidence >= 0.4 AND d.temporal_confidence >= 0.4 AND NOT (f.earliest <= d.latest AND f.latest >= d.earliest) THEN CASE WHEN f.earliest < d.earliest THEN 'true' ELSE 'false' END END, 'unknown') AS first_is_before
FROM d JOIN f ON f.memory_id = d.memory_id AND f.id <> d.id""",
    "timeline_store": EV
    + f"SELECT id, memory_id, subject || ' ' || predicate || ' ' || object_value AS description, predicate AS event_type, epoch_us(earliest)::BIGINT AS earliest_us FROM fa WHERE earliest IS NOT NULL AND latest IS NOT NULL AND temporal_confidence >= 0.25 AND predicate IN ({', '.join(repr(p) for p in V.INDEXABLE)})",
    "events_for_entity": EV
    + "SELECT DISTINCT entity_id, event_id, event_type, epoch_us(earliest)::BIGINT AS earliest_us FROM li JOIN ev ON lower(trim(ev.id)) = event_id WHERE entity_id IN (SELECT id FROM entities WHERE entity_type = 'device')",
    "events_union": EV + "SELECT DISTINCT lower(trim(ev.id)) AS event_id, event_type FROM ev WHERE lower(trim(ev.id)) IN (SELECT event_id FROM li WHERE entity_id IN (SELECT id FROM entities WHERE entity_type IN ('place', 'project')))",
    "events_for_every_entity": EV + "SELECT DISTINCT entity_id, event_id, event_type, epoch_us(earliest)::BIGINT AS earliest_us FROM li JOIN ev ON lower(trim(ev.id)) = event_id",
    "events_union_every": EV + "SELECT DISTINCT lower(trim(ev.id)) AS event_id, event_type FROM ev WHERE lower(trim(ev.id)) IN (SELECT event_id FROM li)",
    "first_event": EV + "SELECT entity_id, event_id, event_type, epoch_us(earliest)::BIGINT AS earliest_us FROM first",
    "compare_order": EV
    + f""", w AS (SELECT DISTINCT first.*, e.entity_type FROM first JOIN entities e ON e.id = first.entity_id), b AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY entity_type ORDER BY entity_id) = 1),
p AS (SELECT b.entity_id AS entity_a, w.entity_id AS entity_b, {_mid.format("b.earliest", "b.latest")} AS ma, {_mid.format("w.earliest", "w.latest")} AS mb, b.temporal_confidence < 0.4 OR w.temporal_confidence < 0.4 AS unsure, b.earliest <= w.latest AND b.latest >= w.earliest AS over
  FROM w JOIN b ON b.entity_type = w.entity_type AND b.entity_id <> w.entity_id)
SELECT entity_a, entity_b, CASE WHEN unsure THEN 'low_confidence' WHEN over THEN 'overlap' WHEN ma < mb THEN 'before' ELSE 'after' END AS result, abs(floor((ma - mb) / 86400000000.0))::BIGINT AS delta_days FROM p""",
    "build_timeline": EV + "SELECT id, epoch_us(earliest)::BIGINT AS earliest_us, granularity FROM ev WHERE event_type = 'purchased' AND latest >= TIMESTAMP '2023-06-01' AND earliest <= TIMESTAMP '2023-12-31'",
    "timeline_first_200": EV + "SELECT id, event_type FROM ev WHERE earliest IS NOT NULL ORDER BY earliest, id LIMIT 200",
    "event_delete_cascade": EV
    + """, gone AS (SELECT lower(trim(ev.id)) AS event_id FROM ev WHERE lower(trim(memory_id)) IN (SELECT record_id FROM removed_records WHERE record_table = 'memory_blocks'))
SELECT entity_id, count(*)::BIGINT AS n_links FROM li WHERE event_id IS NULL OR event_id NOT IN (SELECT event_id FROM gone) GROUP BY entity_id""",
    "stable_facts": EV
    + """, g AS (SELECT lower(trim(subject)) AS subject, lower(trim(predicate)) AS predicate, lower(trim(object_value)) AS object_value, count(*)::BIGINT AS n_facts, avg(confidence) AS m, count(DISTINCT memory_id)::BIGINT AS n_memories, max(temporal_confidence) AS best_temporal FROM fa GROUP BY 1, 2, 3 HAVING count(*) >= 3)
SELECT subject, predicate, object_value, n_facts, n_memories, best_temporal, round(least(0.99::DOUBLE, 0.6 * m + 0.4 * (1 - 1 / (1 + 0.5 * n_facts::DOUBLE))), 6) AS confidence FROM g""",
    "conflict_flags": EV + ", g AS (SELECT lower(subject) AS s, lower(object_value) AS o, count(DISTINCT predicate)::BIGINT AS n_predicates FROM fa GROUP BY 1, 2 HAVING count(DISTINCT predicate) > 1) SELECT id, n_predicates FROM fa JOIN g ON g.s = lower(subject) AND g.o = lower(object_value)",
    "fact_accessors": EV
    + f"SELECT id, CASE WHEN earliest IS NOT NULL AND latest IS NOT NULL THEN {_mid.format('earliest', 'latest')} ELSE -1 END AS date_us, CASE WHEN earliest IS NOT NULL AND latest IS NOT NULL THEN temporal_confidence ELSE 0 END AS date_confidence FROM fa",
    "name_similarity": f"""WITH m AS (SELECT DISTINCT mention_id, memory_id, surface_form FROM entity_mentions WHERE NOT is_shorthand), e AS (SELECT DISTINCT id AS entity_id, name, unnest(memory_ids) AS memory_id FROM entities),
p AS (SELECT mention_id, entity_id, surface_form AS a, name AS b, {_TOK.format("surface_form")} AS ta, {_TOK.format("name")} AS tb FROM m JOIN e USING (memory_id)),
s AS (SELECT mention_id, entity_id, round({_SIM}, 6) AS similarity FROM p) SELECT DISTINCT mention_id, entity_id, similarity FROM s WHERE similarity >= 0.6""",
    "entity_merge": """WITH e AS (SELECT * FROM entities QUALIFY row_number() OVER (PARTITION BY id ORDER BY reference_count DESC, last_seen DESC) = 1), m AS (SELECT entity_type, lower(name) AS name, count(DISTINCT x)::INTEGER AS n FROM (SELECT entity_type, name, unnest(memory_ids) AS x FROM e) GROUP BY 1, 2)
SELECT e.entity_type, lower(e.name) AS name, min(id) AS id, sum(reference_count)::BIGINT AS reference_count, coalesce(epoch_us(min(first_seen)), -1)::BIGINT AS first_us, coalesce(epoch_us(max(last_seen)), -1)::BIGINT AS last_us, coalesce(any_value(m.n), 0)::INTEGER AS n_memories, count(*)::BIGINT AS n_rows
FROM e LEFT JOIN m ON m.entity_type IS NOT DISTINCT FROM e.entity_type AND m.name = lower(e.name) GROUP BY 1, 2""",
    "duplicate_entities": f"""WITH e AS (SELECT * FROM entities WHERE name IS NOT NULL AND entity_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY id) = 1),
p AS (SELECT x.id AS left_id, y.id AS right_id, x.name AS a, y.name AS b, {_TOK.format("x.name")} AS ta, {_TOK.format("y.name")} AS tb FROM e x JOIN e y ON x.entity_type = y.entity_type AND x.id <> y.id AND x.needs_review),
s AS (SELECT left_id, right_id, round({_SIM}, 6) AS similarity FROM p WHERE list_has_any(ta, tb)) SELECT * FROM s WHERE similarity >= 0.75""",
    "duplicate_entities_every": f"""WITH e AS (SELECT * FROM entities WHERE name IS NOT NULL AND entity_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY id) = 1),
p AS (SELECT x.id AS left_id, y.id AS right_id, x.name AS a, y.name AS b, {_TOK.format("x.name")} AS ta, {_TOK.format("y.name")} AS tb FROM e x JOIN e y ON x.entity_type = y.entity_type AND x.id <> y.id AND x.needs_review),
s AS (SELECT left_id, right_id, round({_SIM}, 6) AS similarity FROM p) SELECT * FROM s WHERE similarity >= 0.75""",
    "entity_overlap": """WITH e AS (SELECT id, memory_id, entities FROM timeline_events WHERE len(entities) > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY id) = 1), q AS (SELECT DISTINCT id, lower(trim(memory_id)) AS memory_id, unnest(entities) AS entity_id FROM e),
m AS (SELECT DISTINCT id AS entity_id, lower(trim(x)) AS memory_id FROM (SELECT id, unnest(memory_ids) AS x FROM entities))
SELECT q.id, round(count(m.entity_id) / count(*)::DOUBLE, 6) AS overlap FROM q LEFT JOIN m ON m.entity_id = q.entity_id AND m.memory_id = q.memory_id GROUP BY q.id""",
    "timeline_relevance": EV + "SELECT lower(trim(memory_id)) AS memory_id, round(least(1.0::DOUBLE, max(temporal_confidence)), 6) AS relevance, round(avg(temporal_confidence), 6) AS mean_confidence, count(*)::BIGINT AS n_events FROM ev GROUP BY 1",
    "cold_demotion": """WITH b AS (SELECT * FROM memory_blocks QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_accessed_at DESC, access_count DESC) = 1), a AS (SELECT *, ((1748736000000000 - epoch_us(last_accessed_at)) / 86400000000.0)::DOUBLE AS age FROM b)
SELECT id, 0.3::DOUBLE AS weight FROM a WHERE age >= 180 AND least(1.0::DOUBLE, 0.5 / (1 + 0.01 * age) + 0.5 * ln(1 + access_count::DOUBLE) / 10) < 0.30""",
    "fact_extract": EV
    + """, t AS (SELECT id AS memory_id, 'I ' || CASE predicate WHEN 'purchased' THEN 'bought a' WHEN 'works_at' THEN 'work at' WHEN 'lives_in' THEN 'live in' WHEN 'attended' THEN 'attended the' ELSE 'prefer' END || ' ' || object_value || CASE WHEN date_raw <> '' THEN ' in ' || date_raw ELSE '' END || '.' AS text FROM fa), r AS ("""
    + " UNION ALL ".join(f"SELECT memory_id, '{p}' AS predicate, unnest(regexp_extract_all(text, '{rx.replace(chr(39), chr(39) * 2)}', {g})) AS o, '{k}' AS fact_type FROM t" for rx, g, p, k in V.FACT_RULES)
    + """), c AS (SELECT memory_id, predicate, regexp_replace(trim(o), '[.,;]+$', '') AS object_value, fact_type FROM r)
SELECT memory_id, 'user' AS subject, predicate, object_value, fact_type, 0.65::DOUBLE AS confidence FROM c WHERE object_value <> '' AND length(object_value) <= 120""",
    "fact_extract_stored": """WITH t AS (SELECT DISTINCT 'memory_blocks' AS src_table, id AS memory_id, content AS text FROM memory_blocks WHERE id IS NOT NULL UNION ALL SELECT DISTINCT 'turns', turn_id::VARCHAR, user_message FROM turns WHERE turn_id IS NOT NULL), r AS ("""
    + " UNION ALL ".join(f"SELECT src_table, memory_id, '{p}' AS predicate, unnest(regexp_extract_all(text, '{rx.replace(chr(39), chr(39) * 2)}', {g})) AS o, '{k}' AS fact_type FROM t" for rx, g, p, k in V.FACT_RULES)
    + """), c AS (SELECT src_table, memory_id, predicate, regexp_replace(trim(o), '[.,;]+$', '') AS object_value, fact_type FROM r)
SELECT memory_id, 'user' AS subject, predicate, object_value, fact_type, 0.65::DOUBLE AS confidence, src_table FROM c WHERE object_value <> '' AND length(object_value) <= 120""",
}
