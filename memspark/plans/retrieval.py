"""Questions to memories: names in questions, their entities, and retrieval by time, order and comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark.functions import temporal as T
from memspark.functions import text as X
from memspark.functions import vocab as V
from memspark.operators import extract as E
from memspark.operators.similar import similar
from memspark.plans import conversation
from memspark.plans.blocks import blocks
from memspark.plans.conversation import questions
from memspark.plans.timeline import events, links
from memspark.session import cut
from memspark.sources import load


#: Memories and questions in an array, and about how many rows of a result a task makes.
MEMORIES, QUESTIONS, ROWS_OF_A_TASK = 256, 1024, 4_000_000


def _stripped(name: Column) -> Column:
    return F.regexp_replace(F.btrim(name), r"^[?,.!]+|[?,.!]+$", "")


def with_names(df: DataFrame, question: str = "question") -> DataFrame:
    """Adds the names in a question: brands, quoted phrases, then capitalised words that no common word begins; what
    another name contains goes, and eight stay. Each step is a projection of its own, so none is computed twice."""
    found = lambda pattern: F.transform(F.regexp_extract_all(question, F.lit(pattern), F.lit(1)), _stripped)
    steps = df.withColumns({"_brand": found("(?i)" + V.BRANDS), "_quoted": found(V.QUOTED), "_proper": found(V.PROPER)})
    steps = steps.withColumn("_proper", F.filter("_proper", lambda n: ~F.lower(F.split(n, r"\s+")[0]).isin(V.NO_NAMES)))
    steps = steps.withColumn("_every", F.filter(F.array_distinct(F.concat("_brand", "_quoted", "_proper")), lambda n: n != ""))
    kept = F.filter("_every", lambda n: ~F.exists("_every", lambda o: (o != n) & F.contains(o, n)))
    return steps.withColumn("names", F.slice(kept, 1, V.NAMES_OF_A_QUESTION)).select(*df.columns, "names")


def with_target(df: DataFrame, phrase: str, out: str) -> DataFrame:
    """Adds the words after the last article of a phrase, if any follow, without marks at the ends."""
    steps = df.withColumn("_ws", X.split_words(F.col(phrase)))
    places = F.transform("_ws", lambda w, i: F.when(F.lower(F.btrim(w, F.lit(",.?!"))).isin(V.ARTICLES), i + 1).otherwise(0))
    steps = steps.withColumn("_last", F.coalesce(F.array_max(places), F.lit(0)))
    kept = F.when(F.col("_last") < F.size("_ws"), F.slice("_ws", F.col("_last") + 1, F.greatest(F.lit(1), F.size("_ws") - F.col("_last")))).otherwise(F.col("_ws"))
    return steps.withColumn(out, F.btrim(F.array_join(kept, " "), F.lit("?,.! "))).drop("_ws", "_last")


def _asked(spark: SparkSession, root: str) -> DataFrame:
    return questions(spark, root).select("qid", "question").distinct()


def query_entities(spark: SparkSession, root: str) -> DataFrame:
    q = cut(with_names(_asked(spark, root))).filter("size(names) > 0")
    return q.select("qid", F.array_join("names", "|").alias("names"))


def _targets(q: DataFrame) -> DataFrame:
    """Adds the two cleaned targets of a comparison; null without."""
    t = cut(q.withColumn("t", E.comparison_targets(F.col("question")))).withColumns({"_a": F.get("t", F.lit(0)), "_b": F.get("t", F.lit(1))})
    return cut(with_target(with_target(t, "_a", "target_a"), "_b", "target_b").drop("t", "_a", "_b"))


def clean_targets(spark: SparkSession, root: str) -> DataFrame:
    return _targets(_asked(spark, root)).filter("target_a IS NOT NULL").select("qid", "target_a", "target_b")


def entity_names(spark: SparkSession, root: str) -> DataFrame:
    """(entity_id, name) of all names and aliases, in lower case."""
    e = load(spark, root, "entities")
    every = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return e.select(F.col("id").alias("entity_id"), F.explode(F.transform(every, F.lower)).alias("name")).filter("name <> ''").distinct()


def resolve(names: DataFrame, known: DataFrame, least: float = V.REVIEW_FROM) -> DataFrame:
    """Distinct (name) -> (name, entity_id, similarity): the most similar entity of at least ``least``, the smallest id of equals."""
    pairs = similar(names, known.select("name"), least).join(known.select("entity_id", F.col("name").alias("right_low")), "right_low")
    tops = pairs.join(pairs.groupBy("left_low").agg(F.max("similarity").alias("top")), "left_low").filter("similarity = top")
    one = tops.groupBy("left_low", "similarity").agg(F.min("entity_id").alias("entity_id"))
    return names.select("name").distinct().withColumn("left_low", F.lower("name")).join(one, "left_low").select("name", "entity_id", "similarity")


def _resolved(spark: SparkSession, root: str) -> DataFrame:
    """(qid, pos, entity_id): distinct entities of the names in each question, by the first name that means them."""
    named = cut(with_names(_asked(spark, root)).select("qid", F.posexplode("names").alias("pos", "name")))
    hit = named.join(resolve(named, entity_names(spark, root)), "name")
    return cut(hit.groupBy("qid", "entity_id").agg(F.min("pos").alias("pos")))


def query_entity_ids(spark: SparkSession, root: str) -> DataFrame:
    return _resolved(spark, root).select("qid", "entity_id", "pos")


def _events(spark: SparkSession, root: str) -> DataFrame:
    e = events(spark, root).select(F.lower(F.trim("id")).alias("event_id"), F.lower(F.trim("memory_id")).alias("memory_id"), "event_type", "earliest", "latest", "temporal_confidence")
    return links(spark, root).join(e, "event_id")


def temporal_retrieve(spark: SparkSession, root: str) -> DataFrame:
    """Memories of questions about time. (qid, strategy, memory_id, score)

    A question with an order word and two entities compares the first events of both (of the type asked for): the
    earlier one's memory scores 0.95 and the other's 0.80, or both 0.60 where neither is surely earlier. Any other with
    an entity, or without events to compare, takes the memories of its entities' events of the type asked for, or else
    of all, by mean confidence. What is left is ``fallback`` without a memory, for a search by meaning."""
    order = reduce(lambda a, m: a | F.contains(F.lower("question"), F.lit(m)), V.ORDER_MARKERS, F.lit(False))
    # written before it is filtered, else the long expression of the intent stands in the plan twice
    q = cut(E.with_intent(_asked(spark, root), "question").select("qid", E.event_type(F.col("question")).alias("kind"), order.alias("marked"), F.col("intent.intent").alias("intent"))).filter("intent IN ('TEMPORAL', 'EVENT')")
    ids = _resolved(spark, root)
    top = ids.groupBy("qid").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entity_id"))), lambda x: x["entity_id"]), 1, 2).alias("two"))
    q = cut(q.join(top, "qid", "left").select("qid", "kind", "two", (F.col("marked") & (F.size("two") == 2)).alias("order")))
    ev = _events(spark, root).join(q.join(ids, "qid").select("entity_id").distinct(), "entity_id", "left_semi")
    ev = cut(ev)
    here = blocks(spark, root).select(F.lower("id").alias("memory_id"))
    both = ev.filter("earliest IS NOT NULL AND latest IS NOT NULL").withColumn("kind", F.explode(F.array(F.col("event_type"), F.lit("*"))))
    first = both.groupBy("entity_id", "kind").agg(F.min(F.struct("earliest", "event_id", "latest", "temporal_confidence", "memory_id")).alias("f"))
    c = q.filter("order").select("qid", F.coalesce("kind", F.lit("*")).alias("want"), F.col("two")[0].alias("ea"), F.col("two")[1].alias("eb"))
    for s in "ab":
        c = c.join(first.select(F.col("entity_id").alias(f"e{s}"), F.col("kind").alias("want"), F.col("f").alias(s)), [f"e{s}", "want"], "left")
    unsure = F.col("a").isNull() | F.col("b").isNull() | (F.col("a.temporal_confidence") < V.COMPARE_CONFIDENCE) | (F.col("b.temporal_confidence") < V.COMPARE_CONFIDENCE) | T.overlaps(F.col("a.earliest"), F.col("a.latest"), F.col("b.earliest"), F.col("b.latest"))
    a_first = T.midpoint(F.col("a.earliest"), F.col("a.latest")) < T.midpoint(F.col("b.earliest"), F.col("b.latest"))
    score = lambda mine: F.when(unsure, 0.60).when(mine, 0.95).otherwise(0.80)
    rows = c.select("qid", F.explode(F.array(F.struct(F.col("a.memory_id").alias("memory_id"), score(a_first).alias("score")), F.struct(F.col("b.memory_id").alias("memory_id"), score(~a_first).alias("score")))).alias("r"))
    ordered = rows.select("qid", "r.*").join(here, "memory_id").groupBy("qid", "memory_id").agg(F.max("score").alias("score"))
    ordered = cut(ordered.withColumn("strategy", F.lit("ordering")))
    plan, line = _timelines(q.join(ordered.select("qid").distinct(), "qid", "left_anti").select("qid", "kind"), ids, ev, here)
    # the result is written once, by the caller: only the questions that have one are needed here
    done = ordered.select("qid").unionByName(plan.select("qid")).distinct()
    rest = q.join(done, "qid", "left_anti").select("qid", F.lit("fallback").alias("strategy"), F.lit("").alias("memory_id"), F.lit(0.0).alias("score"))
    columns = ["qid", "strategy", "memory_id", "score"]
    return ordered.select(columns).unionByName(line.withColumn("strategy", F.lit("timeline")).select(columns)).unionByName(rest).withColumn("score", F.round("score", 6))


def _timelines(q: DataFrame, ids: DataFrame, ev: DataFrame, here: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(qid, kind) -> the questions that have a timeline, and (qid, memory_id, score).

    The result has a row for each question and memory of its entities, which grows as their product, so it is made by
    the last join and never shuffled. Questions of the same entities and type go one way, and come in arrays; so do the
    memories of an entity. Only memories that several entities of a way share are summed up for that way."""
    typed = ev.groupBy("entity_id", "event_type", "memory_id").agg(F.sum("temporal_confidence").alias("s"), F.count("temporal_confidence").alias("n"))
    typed = typed.withColumn("kind", F.explode(F.array(F.col("event_type"), F.lit("*")))).filter("kind IS NOT NULL").join(here, "memory_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("entity_id", "kind").orderBy("memory_id")) - 1
    sums = cut(typed.groupBy("entity_id", "kind", "memory_id").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).withColumn("block", F.floor(place / MEMORIES)))
    sizes = sums.groupBy("entity_id", "kind").agg(F.count("*").alias("size"))
    asked = q.join(ids.select("qid", "entity_id"), "qid")
    fits = ev.select("entity_id", F.col("event_type").alias("kind"), F.lit(True).alias("fits")).distinct()
    kind = asked.join(fits, ["entity_id", "kind"], "left").groupBy("qid").agg(F.when(F.max("fits"), F.max("kind")).otherwise("*").alias("kind"))
    met = asked.select("qid", "entity_id").join(kind, "qid").join(sizes, ["entity_id", "kind"], "left_semi")
    plan = cut(met.groupBy("qid", "kind").agg(F.array_sort(F.collect_list("entity_id")).alias("of")))
    plan = plan.withColumn("way", F.concat_ws("\x01", "kind", "of"))
    ways = plan.select("way", "kind", F.explode("of").alias("entity_id"), (F.size("of") > 1).alias("many")).distinct()
    number = F.row_number().over(Window.partitionBy("way").orderBy("qid")) - 1
    askers = plan.select("way", "qid").withColumn("part", F.floor(number / QUESTIONS)).groupBy("way", "part").agg(F.collect_list("qid").alias("qids")).drop("part")
    # memories that two entities of a way share: those of the entity that has fewer, looked up in the other one's
    many = ways.filter("many").drop("many").join(sizes, ["entity_id", "kind"])
    one, other = many.select("way", "kind", F.struct("size", "entity_id").alias("a")), many.select("way", F.struct("size", "entity_id").alias("b"))
    two = one.join(other, "way").filter("a < b").select("way", "kind", F.col("a.entity_id").alias("a"), F.col("b.entity_id").alias("b"))
    of = sums.select("kind", F.col("entity_id").alias("a"), "memory_id")
    common = two.select("kind", "a", "b").distinct().join(of, ["kind", "a"]).join(of.withColumnRenamed("a", "b"), ["kind", "b", "memory_id"], "left_semi")
    shared = cut(two.join(common, ["kind", "a", "b"]).select("way", "kind", "memory_id").distinct().join(many.drop("size"), ["way", "kind"]).join(sums, ["entity_id", "kind", "memory_id"]))
    merged = shared.groupBy("way", "memory_id").agg((F.sum("s") / F.sum("n")).alias("score")).join(askers, "way").select(F.explode("qids").alias("qid"), "memory_id", "score")
    # all others, by blocks: arrays of memories meet arrays of questions
    lists = sums.groupBy("entity_id", "kind", "block").agg(F.collect_list(F.struct("memory_id", (F.col("s") / F.col("n")).alias("score"))).alias("memories"))
    out = shared.groupBy("way", "entity_id", "block").agg(F.collect_list(F.struct("memory_id", (F.col("s") / F.col("n")).alias("score"))).alias("not"))
    each = ways.drop("many").join(sums.select("entity_id", "kind", "block").distinct(), ["entity_id", "kind"]).join(out, ["way", "entity_id", "block"], "left")
    each = cut(each.join(askers, "way").select("entity_id", "kind", "block", "qids", "not"))
    rows = each.agg(F.sum(F.size("qids"))).first()[0] or 0
    parts = max(int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(10_000, rows * MEMORIES // ROWS_OF_A_TASK))
    left = F.when(F.col("not").isNull(), F.col("memories")).otherwise(F.array_except("memories", "not"))
    own = each.repartition(parts, "entity_id", "kind", "block").join(lists, ["entity_id", "kind", "block"]).select("qids", left.alias("memories"))
    own = own.select("qids", F.explode("memories").alias("m")).select(F.explode("qids").alias("qid"), "m.memory_id", "m.score")
    return plan, own.unionByName(merged)


def entity_memories(spark: SparkSession, root: str) -> DataFrame:
    """(entity_id, memory_id, score) of the best memories of every entity.

    All memories that tell of getting or setting up a thing are candidates, and the latest others up to eight in all;
    the score is three times the names' occurrences over the root of the words, more with such a phrase, from 0.40 to
    0.95; the best eight stay."""
    e = load(spark, root, "entities").select(F.col("id").alias("entity_id"), F.explode("memory_ids").alias("memory_id")).select("entity_id", F.lower(F.trim("memory_id")).alias("memory_id")).distinct()
    low = F.lower("content")
    b = blocks(spark, root).filter("content <> ''").select(F.lower("id").alias("memory_id"), "created_at", low.alias("low"), X.contains_any(low, V.EVENT_PHRASES).alias("about"), F.greatest(F.lit(1), X.word_count(F.col("content"))).alias("n_words"))
    met = e.join(b.select("memory_id", "created_at", "about"), "memory_id")
    latest = Window.partitionBy("entity_id").orderBy(F.desc("about"), F.desc("created_at"), "memory_id")
    kept = met.withColumn("place", F.row_number().over(latest)).filter(F.col("about") | (F.col("place") <= V.PER_ENTITY)).select("entity_id", "memory_id")
    hits = kept.join(b, "memory_id").join(entity_names(spark, root), "entity_id")
    count = (F.length("low") - F.length(F.replace(F.col("low"), F.col("name"), F.lit("")))) / F.length("name")
    scored = hits.groupBy("entity_id", "memory_id").agg(F.sum(count).alias("n"), F.max("n_words").alias("n_words"), F.max("about").alias("about"))
    score = F.least(F.lit(0.95), F.greatest(F.lit(0.40), F.lit(3.0) * F.col("n") / F.sqrt("n_words") + F.when(F.col("about"), V.EVENT_BOOST).otherwise(0.0)))
    best = Window.partitionBy("entity_id").orderBy(F.desc("score"), "memory_id")
    return scored.withColumn("score", F.round(score, 6)).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= V.PER_ENTITY).select("entity_id", "memory_id", "score", "rank")


def entity_best(spark: SparkSession, root: str) -> DataFrame:
    """Each entity's best score and number of memories; 0 without any."""
    m = cut(entity_memories(spark, root)).groupBy("entity_id").agg(F.max("score").alias("best"), F.count("*").alias("n"))
    e = load(spark, root, "entities").select(F.col("id").alias("entity_id")).distinct()
    return e.join(m, "entity_id", "left").select("entity_id", F.coalesce("best", F.lit(0.0)).alias("best"), F.coalesce("n", F.lit(0)).alias("n_memories"))


def _compared(spark: SparkSession, root: str) -> DataFrame:
    """(qid, pos, entity_id) of the two targets of each comparison, or else of the names in the question."""
    q = cut(E.with_intent(_asked(spark, root), "question").filter("intent.intent = 'COMPARISON'").select("qid", "question"))
    q = with_names(_targets(q))
    named = q.select("qid", F.posexplode(F.when(F.col("target_a").isNotNull(), F.array("target_a", "target_b")).otherwise(F.col("names"))).alias("pos", "name")).filter("name <> ''")
    hit = cut(named).join(resolve(named, entity_names(spark, root)), "name")
    return cut(hit.groupBy("qid", "entity_id").agg(F.min("pos").alias("pos")))


def comparison_retrieve(spark: SparkSession, root: str) -> DataFrame:
    """Memories of comparisons: (qid, memory_id, score); a memory of several targets counts once, with 0.10 more for
    each other one, at most 0.98."""
    ids = _compared(spark, root)
    g = ids.join(entity_memories(spark, root), "entity_id")
    m = g.groupBy("qid", "memory_id").agg(F.min_by("score", "pos").alias("s"), F.count("*").alias("n"))
    return m.select("qid", "memory_id", F.round(F.least(F.lit(0.98), F.col("s") + F.lit(0.10) * (F.col("n") - 1)), 6).alias("score"))


def comparison_found(spark: SparkSession, root: str) -> DataFrame:
    """Of every comparison: its entities in order, whether all and whether any of them have memories."""
    q = E.with_intent(_asked(spark, root), "question").filter("intent.intent = 'COMPARISON'").select("qid")
    per = _compared(spark, root).join(entity_memories(spark, root).select("entity_id").distinct().withColumn("has", F.lit(True)), "entity_id", "left").withColumn("has", F.coalesce("has", F.lit(False)))
    f = per.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entity_id"))), lambda x: x["entity_id"]), ",").alias("ids"), F.bool_and("has").alias("every"), F.bool_or("has").alias("one"))
    return q.join(f, "qid", "left").select("qid", F.coalesce("ids", F.lit("")).alias("entity_ids"), F.coalesce("every", F.lit(False)).alias("found_both"), F.coalesce("one", F.lit(False)).alias("found_answer"))


def intent_router(spark: SparkSession, root: str) -> DataFrame:
    """Which retriever a question goes to, whether its intent is unsure, and whether a second one is armed."""
    q = E.with_intent(_asked(spark, root), "question")
    i, c = F.col("intent.intent"), F.col("intent.confidence")
    route = F.when(i.isin("TEMPORAL", "EVENT"), "temporal").when(i == "COMPARISON", "comparison").otherwise("semantic")
    return q.select("qid", route.alias("route"), ((c < 0.70) | (i == "AMBIGUOUS")).alias("is_ambiguous"), ((c < 0.70) & F.col("intent.secondary").isNotNull()).alias("needs_fallback"))


QUERIES = {f.__name__: f for f in (query_entities, clean_targets, query_entity_ids, temporal_retrieve, entity_memories, entity_best, comparison_retrieve, comparison_found, intent_router)}

_Q = conversation.SQL["query_intent"]
_ARTICLES = ", ".join(f"'{w}'" for w in V.ARTICLES)
_NO = ", ".join(f"'{w}'" for w in V.NO_NAMES)
_esc = lambda s: s.replace("'", "''")
_STRIP = lambda x: f"regexp_replace(regexp_replace(trim({x}), '^[?,.!]+', ''), '[?,.!]+$', '')"
_FOUND = lambda p: f"list_transform(regexp_extract_all(question, '{_esc(p)}', 1), lambda n: {_STRIP('n')})"
NAMES = f"""n0 AS (SELECT DISTINCT qid, question FROM qs),
n1 AS (SELECT qid, question, {_FOUND('(?i)' + V.BRANDS)} || {_FOUND(V.QUOTED)} || list_filter({_FOUND(V.PROPER)}, lambda n: NOT list_contains([{_NO}], lower(regexp_split_to_array(n, '\\s+')[1]))) AS l FROM n0),
n2 AS (SELECT qid, question, list_filter(l, lambda n, i: n <> '' AND list_position(l, n) = i) AS l FROM n1),
n3 AS (SELECT qid, question, list_filter(l, lambda n: len(list_filter(l, lambda o: o <> n AND contains(o, n))) = 0)[1:8] AS names FROM n2)"""
_SIM = """round(greatest(CASE WHEN len(list_distinct(ta || tb)) > 0 THEN len(list_intersect(ta, tb)) / len(list_distinct(ta || tb))::DOUBLE ELSE 0 END, CASE WHEN contains(a, b) OR contains(b, a) THEN 0.8 ELSE 0 END), 6)"""
RESOLVE = f"""kn AS (SELECT DISTINCT id AS entity_id, lower(n) AS b FROM (SELECT id, unnest(list_concat([name], coalesce(aliases, []))) AS n FROM entities) WHERE n <> ''),
kt AS (SELECT *, list_distinct(regexp_extract_all(b, '\\w+')) AS tb FROM kn), ask AS (SELECT DISTINCT lower(name) AS a FROM named WHERE name <> ''), at2 AS (SELECT a, list_distinct(regexp_extract_all(a, '\\w+')) AS ta FROM ask),
sm AS (SELECT a, entity_id, {_SIM} AS s FROM at2, kt), rs AS (SELECT a, entity_id FROM sm WHERE s >= 0.6 QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, entity_id) = 1)"""
_QS = conversation.SQL["event_type_infer"].split("SELECT qid, CASE")[0].rstrip()
_ET = "SELECT qid, CASE" + conversation.SQL["event_type_infer"].split("SELECT qid, CASE")[1]
_CLEAN = lambda x: f"""(SELECT trim(array_to_string(CASE WHEN la < len(ws) THEN ws[la + 1:] ELSE ws END, ' '), '?,.! ') FROM (SELECT ws, coalesce(list_max(list_transform(ws, lambda w, i: CASE WHEN list_contains([{_ARTICLES}], lower(trim(w, ',.?!'))) THEN i ELSE 0 END)), 0) AS la
  FROM (SELECT list_filter(regexp_split_to_array(trim({x}), '\\s+'), lambda w: w <> '') AS ws)))"""  # noqa: E731
_EM = """eb AS (SELECT * FROM memory_blocks WHERE content <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_accessed_at DESC, access_count DESC) = 1),
em AS (SELECT DISTINCT id AS entity_id, lower(trim(m)) AS memory_id FROM (SELECT id, unnest(memory_ids) AS m FROM entities) WHERE m IS NOT NULL),
ec AS (SELECT entity_id, memory_id, created_at, lower(content) AS low, %ABOUT% AS about, greatest(1, len(list_filter(regexp_split_to_array(trim(content), '\\s+'), lambda w: w <> ''))) AS n_words FROM em JOIN eb ON lower(eb.id) = memory_id),
ek AS (SELECT * FROM ec QUALIFY about OR row_number() OVER (PARTITION BY entity_id ORDER BY about DESC, created_at DESC, memory_id) <= 8),
en AS (SELECT DISTINCT id AS entity_id, lower(n) AS name FROM (SELECT id, unnest(list_concat([name], coalesce(aliases, []))) AS n FROM entities) WHERE n <> ''),
es AS (SELECT entity_id, memory_id, round(least(0.95, greatest(0.40, 3.0::DOUBLE * sum((length(low) - length(replace(low, name, ''))) / length(name)::DOUBLE) / sqrt(max(n_words)) + CASE WHEN bool_or(about) THEN 0.25 ELSE 0.0 END))::DOUBLE, 6) AS score FROM ek JOIN en USING (entity_id) GROUP BY 1, 2),
er AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, memory_id)::INTEGER AS rank FROM es QUALIFY rank <= 8)""".replace("%ABOUT%", "(" + " OR ".join(f"contains(lower(content), '{p}')" for p in V.EVENT_PHRASES) + ")")
_MARK = " OR ".join(f"contains(lower(question), '{m}')" for m in V.ORDER_MARKERS)
_MID = lambda x: f"(epoch_us({x}_earliest) + (epoch_us({x}_latest) - epoch_us({x}_earliest)) // 2)"
_IDS = f"named AS (SELECT qid, unnest(names) AS name, generate_subscripts(names, 1) - 1 AS pos FROM n3), {RESOLVE}, ids AS (SELECT qid, entity_id, min(pos)::INTEGER AS pos FROM named JOIN rs ON lower(name) = a GROUP BY 1, 2)"
SQL = {
    "query_entities": f"{_QS}, {NAMES} SELECT qid, array_to_string(names, '|') AS names FROM n3 WHERE len(names) > 0",
    "query_entity_ids": f"{_QS}, {NAMES}, {_IDS} SELECT qid, entity_id, pos FROM ids",
    "intent_router": f"WITH qi AS ({_Q}) SELECT DISTINCT qid, CASE WHEN intent IN ('TEMPORAL', 'EVENT') THEN 'temporal' WHEN intent = 'COMPARISON' THEN 'comparison' ELSE 'semantic' END AS route, confidence < 0.70 OR intent = 'AMBIGUOUS' AS is_ambiguous, confidence < 0.70 AND secondary <> 'none' AS needs_fallback FROM qi",
    "entity_memories": f"WITH {_EM} SELECT entity_id, memory_id, score, rank FROM er",
    "entity_best": f"WITH {_EM} SELECT e.entity_id, coalesce(max(score), 0)::DOUBLE AS best, count(score)::BIGINT AS n_memories FROM (SELECT DISTINCT id AS entity_id FROM entities) e LEFT JOIN er USING (entity_id) GROUP BY 1",
    "temporal_retrieve": f"""{_QS}, qi AS ({_Q}), et AS ({_ET}), {NAMES}, {_IDS},
q AS (SELECT n3.qid, n3.question, nullif(et.event_type, 'none') AS kind, (SELECT list(entity_id ORDER BY pos, entity_id)[1:2] FROM ids WHERE ids.qid = n3.qid) AS two FROM n3 JOIN (SELECT DISTINCT qid, intent FROM qi) i ON i.qid = n3.qid JOIN (SELECT DISTINCT * FROM et) et ON et.qid = n3.qid WHERE intent IN ('TEMPORAL', 'EVENT')),
o AS (SELECT *, ({_MARK}) AND len(two) = 2 AS ord FROM q),
e0 AS (SELECT * FROM timeline_events QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC) = 1),
ev AS (SELECT l.entity_id, l.event_id, lower(trim(memory_id)) AS memory_id, event_type, earliest, latest, temporal_confidence FROM (SELECT DISTINCT entity_id, lower(trim(event_id)) AS event_id FROM entity_event_map) l JOIN e0 ON lower(trim(e0.id)) = l.event_id),
ft AS (SELECT entity_id, k AS kind, memory_id, event_id, earliest, latest, temporal_confidence FROM (SELECT *, unnest([event_type, '*']) AS k FROM ev WHERE earliest IS NOT NULL AND latest IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY entity_id, k ORDER BY earliest, event_id) = 1),
c AS (SELECT o.qid, a.memory_id AS ma, b.memory_id AS mb, a.earliest AS a_earliest, a.latest AS a_latest, b.earliest AS b_earliest, b.latest AS b_latest, a.temporal_confidence AS ca, b.temporal_confidence AS cb
  FROM o LEFT JOIN ft a ON a.entity_id = two[1] AND a.kind = coalesce(o.kind, '*') LEFT JOIN ft b ON b.entity_id = two[2] AND b.kind = coalesce(o.kind, '*') WHERE ord),
d AS (SELECT *, ma IS NULL OR mb IS NULL OR ca < 0.4 OR cb < 0.4 OR (a_earliest <= b_latest AND a_latest >= b_earliest) AS unsure, {_MID('a')} < {_MID('b')} AS af FROM c),
h AS (SELECT DISTINCT lower(id) AS memory_id FROM memory_blocks),
r AS (SELECT qid, memory_id, max(score) AS score FROM (SELECT qid, ma AS memory_id, CASE WHEN unsure THEN 0.6 WHEN af THEN 0.95 ELSE 0.8 END AS score FROM d UNION ALL SELECT qid, mb, CASE WHEN unsure THEN 0.6 WHEN NOT af THEN 0.95 ELSE 0.8 END FROM d) JOIN h USING (memory_id) GROUP BY 1, 2),
w AS (SELECT o.qid, ev.memory_id, temporal_confidence, coalesce(ev.event_type = o.kind, false) AS fits FROM o JOIN ids ON ids.qid = o.qid JOIN ev ON ev.entity_id = ids.entity_id WHERE o.qid NOT IN (SELECT qid FROM r)),
x AS (SELECT *, bool_or(fits) OVER (PARTITION BY qid) AS anyfit FROM w),
t2 AS (SELECT qid, memory_id, avg(temporal_confidence) AS score FROM x JOIN h USING (memory_id) WHERE fits OR NOT anyfit GROUP BY 1, 2),
done AS (SELECT qid, 'ordering' AS strategy, memory_id, score::DOUBLE AS score FROM r UNION ALL SELECT qid, 'timeline', memory_id, score FROM t2)
SELECT qid, strategy, memory_id, round(score, 6) AS score FROM done UNION ALL SELECT qid, 'fallback', '', 0.0 FROM q WHERE qid NOT IN (SELECT qid FROM done)""",
}
_FIRST = "regexp_extract(question, '(?is)^(.*?)\\s+(?:or|vs\\.?|versus)\\s+(.*)$', {k})"
_WS = lambda x: f"list_filter(regexp_split_to_array(trim({x}), '\\s+'), lambda w: w <> '')"
_BARE = lambda ws: f"array_to_string(list_transform({ws}, lambda w: regexp_replace(regexp_replace(w, '^[^\\w]+', ''), '[^\\w]+$', '')), ' ')"
_PAIR = f"""p0 AS (SELECT DISTINCT qid, question FROM qs), p1 AS (SELECT qid, question, {_WS(_FIRST.format(k=1))} AS l, {_WS(_FIRST.format(k=2))} AS r, regexp_matches(question, '(?is)\\s+(?:or|vs\\.?|versus)\\s+') AS two FROM p0),
p2 AS (SELECT qid, question, two, {_BARE('l[greatest(1, len(l) - 3):]')} AS ta, {_BARE('r[1:4]')} AS tb FROM p1)"""
SQL["clean_targets"] = f"{_QS}, {_PAIR} SELECT qid, {_CLEAN('ta')} AS target_a, {_CLEAN('tb')} AS target_b FROM p2 WHERE two"
_CMP = f"""{_QS}, qi AS ({_Q}), {NAMES}, {_PAIR}, cq AS (SELECT p2.qid, CASE WHEN two THEN [{_CLEAN('ta')}, {_CLEAN('tb')}] ELSE names END AS l FROM p2 JOIN n3 ON n3.qid = p2.qid JOIN (SELECT DISTINCT qid, intent FROM qi) i ON i.qid = p2.qid WHERE intent = 'COMPARISON'),
named AS (SELECT * FROM (SELECT qid, unnest(l) AS name, generate_subscripts(l, 1) - 1 AS pos FROM cq) WHERE name <> ''), {RESOLVE}, ids AS (SELECT qid, entity_id, min(pos)::INTEGER AS pos FROM named JOIN rs ON lower(name) = a GROUP BY 1, 2), {_EM}"""
SQL["comparison_retrieve"] = f"{_CMP} SELECT qid, memory_id, round(least(0.98, arg_min(score, pos) + 0.10 * (count(*) - 1))::DOUBLE, 6) AS score FROM ids JOIN er USING (entity_id) GROUP BY 1, 2"
SQL["comparison_found"] = f"""{_CMP}, f AS (SELECT qid, array_to_string(list(entity_id ORDER BY pos, entity_id), ',') AS ids, bool_and(entity_id IN (SELECT entity_id FROM er)) AS every, bool_or(entity_id IN (SELECT entity_id FROM er)) AS one FROM ids GROUP BY 1)
SELECT cq.qid, coalesce(ids, '') AS entity_ids, coalesce(every, false) AS found_both, coalesce(one, false) AS found_answer FROM cq LEFT JOIN f USING (qid)"""
SQL["comparison_targets"] = f"{_QS}, {_PAIR} SELECT qid, ta AS target_a, tb AS target_b FROM p2 WHERE two"
