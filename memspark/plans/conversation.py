"""Queries on turns and questions: hygiene, classification, intents, ranking, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark.functions import scoring as S
from memspark.functions import text as X
from memspark.functions import vocab as V
from memspark.operators import extract as E
from memspark.operators import store, vector
from memspark.plans.blocks import as_of, blocks
from memspark.sources import load


def turns(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "turns").dropDuplicates(["turn_id"])


def messages(spark: SparkSession, root: str) -> DataFrame:
    """(turn_id, source, text) of both sides of every turn."""
    t = turns(spark, root)
    return t.select("turn_id", F.explode(F.create_map(F.lit("user"), "user_message", F.lit("assistant"), "assistant_reply")).alias("source", "text"))


def questions(spark: SparkSession, root: str) -> DataFrame:
    """Questions of the evaluation items and first messages of turns, as (qid, question)."""
    q = load(spark, root, "eval_items").select(F.concat(F.lit("q"), "item_id").alias("qid"), "question")
    return q.unionByName(turns(spark, root).filter("user_message IS NOT NULL").select(F.concat(F.lit("t"), "turn_id").alias("qid"), F.col("user_message").alias("question")))


def chat_window(spark: SparkSession, root: str) -> DataFrame:
    t = turns(spark, root)
    order = Window.partitionBy("session_id").orderBy(F.desc("logged_at"), F.desc("turn_id"))
    return t.withColumn("back", F.row_number().over(order)).filter("back <= 6").select(F.coalesce("session_id", F.lit("none")).alias("session"), "turn_id", "back")


def hygiene_verdict(spark: SparkSession, root: str) -> DataFrame:
    m = messages(spark, root).withColumn("h", E.hygiene(F.col("text"), F.col("source")))
    return m.select("turn_id", "source", "h.verdict", "h.reason")


def clean_response(spark: SparkSession, root: str) -> DataFrame:
    m = turns(spark, root).select("turn_id", X.clean_response(F.concat(F.lit("Sure, I'd be happy to help. "), F.col("assistant_reply"), F.lit(" Hope this helps!"))).alias("cleaned"))
    return m.filter("cleaned IS NOT NULL")


def classify_turns(spark: SparkSession, root: str) -> DataFrame:
    m = messages(spark, root).filter("text IS NOT NULL").withColumn("c", E.classify(F.col("text"), F.col("source")))
    return m.select("turn_id", "source", "c.memory_type", "c.confidence", "c.method")


def query_intent(spark: SparkSession, root: str) -> DataFrame:
    q = E.with_intent(questions(spark, root), "question")
    return q.select("qid", "intent.intent", "intent.confidence", F.coalesce("intent.secondary", F.lit("none")).alias("secondary"))


def comparison_targets(spark: SparkSession, root: str) -> DataFrame:
    q = questions(spark, root).withColumn("t", E.comparison_targets(F.col("question"))).filter("size(t) = 2")
    return q.select("qid", F.col("t")[0].alias("target_a"), F.col("t")[1].alias("target_b"))


def event_type_infer(spark: SparkSession, root: str) -> DataFrame:
    return questions(spark, root).select("qid", F.coalesce(E.event_type(F.col("question")), F.lit("none")).alias("event_type"))


def knn_cosine(spark: SparkSession, root: str) -> DataFrame:
    v = load(spark, root, "embeddings").select("vec_id", "embedding")
    return vector.knn(v, v.filter("vec_id % 100 = 0"), 5).select("query_id", "neighbour_id", F.round("score", 5).alias("score"), "rank")


def knn_label_vote(spark: SparkSession, root: str) -> DataFrame:
    """Label of the majority of the ten nearest, the smallest of equals."""
    v = load(spark, root, "embeddings")
    near = vector.knn(v, v.filter("vec_id % 100 = 0"), 10).join(v.select(F.col("vec_id").alias("neighbour_id"), "label"), "neighbour_id")
    votes = near.groupBy("query_id", "label").agg(F.count("*").alias("n"))
    return votes.groupBy("query_id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))


def _scored(spark: SparkSession, root: str) -> DataFrame:
    """Candidates of each query (its twenty nearest vectors) with priority, recency and keyword signals by row number."""
    v = load(spark, root, "embeddings").select("vec_id", "embedding", "label")
    near = vector.knn(v, v.filter("vec_id % 100 = 0"), 20).join(v.select(F.col("vec_id").alias("neighbour_id"), "label"), "neighbour_id")
    n = F.col("neighbour_id")
    p = S.p_eff((1 + n % 10).cast("double"), F.lit("EPISODIC"), (1 + n % 20).cast("int"), (n % 60).cast("double"))
    return near.withColumns({"score": F.round("score", 6), "p": F.round(p, 6), "recency": F.exp(-(n % 60) / F.lit(14.0)), "keyword": F.least(F.lit(1.0), (F.col("label") % 3) / 2)})


def hybrid_rerank(spark: SparkSession, root: str) -> DataFrame:
    """0.6 similarity, 0.2 priority over its maximum, 0.1 recency, 0.1 keywords; under 0.35 similarity, under 0.65 of
    the best, and beyond five are rejected with the reason."""
    c = _scored(spark, root)
    per = Window.partitionBy("query_id")
    top = F.max("p").over(per)
    h = c.withColumn("hybrid", F.round(F.lit(0.6) * F.col("score") + F.lit(0.2) * F.col("p") / F.when(top > 0, top).otherwise(1.0) + F.lit(0.1) * F.col("recency") + F.lit(0.1) * F.col("keyword"), 6))
    h = h.withColumn("low", F.col("score") < 0.35)
    best = F.max(F.when(~F.col("low"), F.col("hybrid"))).over(per)
    h = h.withColumn("drop", ~F.col("low") & (F.col("hybrid") < F.lit(0.65) * best))
    place = F.row_number().over(per.orderBy(F.col("low") | F.col("drop"), F.desc("hybrid"), "neighbour_id"))
    reason = F.when(F.col("low"), "low_similarity").when(F.col("drop"), "score_dropoff").when(place > 5, "max_results").otherwise("accepted")
    return h.select("query_id", "neighbour_id", "hybrid", reason.alias("reason"))


def _ranked(spark: SparkSession, root: str) -> DataFrame:
    """Blocks of each session ranked for the intent of the session's first question."""
    t = turns(spark, root).filter("session_id IS NOT NULL AND user_message IS NOT NULL")
    first = t.groupBy("session_id").agg(F.min_by("user_message", F.struct("logged_at", "turn_id")).alias("question"))
    first = E.with_intent(first, "question").select("session_id", "question", F.col("intent.intent").alias("intent"))
    b = blocks(spark, root).filter("session_id IS NOT NULL")
    facts = load(spark, root, "structured_facts").dropDuplicates(["id"]).groupBy(F.lower(F.trim("memory_id")).alias("id")).agg(F.avg("confidence").alias("fact"))
    ev = load(spark, root, "timeline_events").groupBy(F.lower(F.trim("memory_id")).alias("id")).agg(F.max("temporal_confidence").alias("time"))
    c = b.join(first, "session_id").join(facts, "id", "left").join(ev, "id", "left")
    kind = F.when(F.col("tag") == "USER_PROFILE", "USER_FACT").when(F.col("tag") == "PROJECT_FACT", "PROJECT_FACT").when(F.col("tag") == "EPISODIC", "EVENT").otherwise("TEMPORARY_CONTEXT")
    fits = F.lit(False)
    for i, kinds in V.FITTING.items():
        fits = fits | ((F.col("intent") == i) & kind.isin(kinds))
    c = c.withColumns({
        "sim": X.jaccard(X.name_tokens(F.col("question")), X.name_tokens(F.col("content"))), "ent": F.least(F.lit(1.0), F.size(F.coalesce("keywords", F.array().cast("array<string>"))) / 5), "time": F.least(F.lit(1.0), F.coalesce("time", F.lit(0.0))),
        "fact": F.coalesce("fact", F.lit(0.5)), "type": F.when(fits, 1.0).otherwise(0.2), "sal": S.salience(S.age_days(as_of(), F.col("created_at")), F.col("access_count")),
    })
    total = F.round(S.weighted(F.col("intent"), {s: F.col(s) for s in V.SIGNALS}), 4)
    order = Window.partitionBy("session_id").orderBy(F.desc("score"), "id")
    return c.withColumn("score", total).withColumn("rank", F.row_number().over(order)).filter("rank <= 10")


def intent_weighted_rank(spark: SparkSession, root: str) -> DataFrame:
    return _ranked(spark, root).select("session_id", "intent", "id", "score", "rank")


def audit_top5(spark: SparkSession, root: str) -> DataFrame:
    r = _ranked(spark, root).filter("rank <= 5")
    top = F.array_sort(F.collect_list(F.struct("rank", "id")))
    return r.groupBy("session_id", "intent").agg(F.array_join(F.transform(top, lambda x: x["id"]), ",").alias("top5"), F.max("score").alias("best"))


def rank_reasoning(spark: SparkSession, root: str) -> DataFrame:
    """The two signals that contribute most to each session's first block."""
    r = _ranked(spark, root).filter("rank = 1")
    parts = F.array(*[F.struct(F.round(F.col(s) * S.mapped(F.col("intent"), {i: w[k] for i, w in V.WEIGHTS.items()}, V.WEIGHTS["FACTUAL"][k]), 6).alias("c"), F.lit(-k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(V.SIGNALS)])
    best = F.slice(F.filter(F.sort_array(parts, asc=False), lambda x: x["c"] > 0.01), 1, 2)
    return r.select("session_id", "id", F.array_join(F.transform(best, lambda x: x["s"]), "+").alias("signals"))


def ablation_weights(spark: SparkSession, root: str) -> DataFrame:
    rows = [(m, i, s, float(x)) for m in ("none", "no_intent", "no_keyword", "no_recency", "no_peff") for i, w in S.ablated(m).items() for s, x in zip(V.SIGNALS, w)]
    return spark.createDataFrame(rows, "mode string, intent string, signal string, weight double").withColumn("weight", F.round("weight", 6))


def comparison_groups(spark: SparkSession, root: str) -> DataFrame:
    """Memories of each device and organization: all about getting or setting up a thing, then the latest up to eight in all."""
    return _groups(spark, root, load(spark, root, "entities").filter("entity_type IN ('device', 'organization')"))


def comparison_groups_every(spark: SparkSession, root: str) -> DataFrame:
    """The same of every entity."""
    return _groups(spark, root, load(spark, root, "entities"))


def _groups(spark: SparkSession, root: str, entities: DataFrame) -> DataFrame:
    e = entities.select(F.col("id").alias("entity_id"), F.explode("memory_ids").alias("memory_id")).distinct()
    b = blocks(spark, root).select(F.col("id").alias("memory_id"), "created_at", X.contains_any(F.lower("content"), V.EVENT_PHRASES).alias("about"))
    order = Window.partitionBy("entity_id").orderBy(F.desc("about"), F.desc("created_at"), "memory_id")
    return e.join(b, "memory_id").withColumn("place", F.row_number().over(order)).filter(F.col("about") | (F.col("place") <= V.PER_ENTITY)).select("entity_id", "memory_id", "about", "place")


def merge_flat(spark: SparkSession, root: str) -> DataFrame:
    """Memories of several comparison groups once: the first group's score, 0.10 more for each other, at most 0.98."""
    g = comparison_groups(spark, root).withColumn("score", F.lit(0.95) - F.lit(0.05) * F.col("place"))
    m = g.groupBy("memory_id").agg(F.min_by("score", "entity_id").alias("first"), F.count("*").alias("n"))
    return m.select("memory_id", F.round(F.least(F.lit(0.98), F.col("first") + F.lit(0.10) * (F.col("n") - 1)), 6).alias("score"), "n")


def merge_and_rank(spark: SparkSession, root: str) -> DataFrame:
    """Comparison groups joined by the memories of flagged entities that are not in them, at 0.3 of their score."""
    first = merge_flat(spark, root).select("memory_id", "score", F.lit("primary").alias("origin"))
    more = load(spark, root, "entities").filter("needs_review").select(F.explode("memory_ids").alias("memory_id")).filter("memory_id <> ''").distinct().join(first.select("memory_id"), "memory_id", "left_anti")
    return first.unionByName(more.select("memory_id", F.round(F.lit(0.5) * 0.3, 6).alias("score"), F.lit("secondary").alias("origin")))


def run_summary(spark: SparkSession, root: str) -> DataFrame:
    t = turns(spark, root)
    g = t.groupBy("provider", "model").agg(F.count("*").alias("n_turns"), F.round(F.avg("latency_ms"), 4).alias("mean_latency"), F.round(F.avg("context_block_count"), 4).alias("mean_blocks"), F.max("context_token_estimate").alias("peak_tokens"))
    return g


def stage_timing(spark: SparkSession, root: str) -> DataFrame:
    g = turns(spark, root).groupBy("model").agg(F.round(F.sum("latency_ms"), 4).alias("total_ms"), F.count("latency_ms").alias("calls"), F.round(F.avg("latency_ms"), 1).alias("avg_ms"))
    whole = g.agg(F.sum("total_ms").alias("whole"))
    return g.join(F.broadcast(whole)).select("model", "total_ms", "calls", "avg_ms", F.round(100 * F.col("total_ms") / F.col("whole"), 4).alias("pct"))


def session_index(spark: SparkSession, root: str) -> DataFrame:
    """Turns counted within their session in order of time; stored indices that differ. Counting goes by days: places
    within a session's day, and the turns of its earlier days, so a session of a third of all turns is spread."""
    t = turns(spark, root).select("turn_id", "turn_index", "logged_at", F.coalesce("session_id", F.lit("")).alias("session"), F.to_date("logged_at").alias("day"))
    days = t.groupBy("session", "day").agg(F.count("*").alias("n_day"))
    before = Window.partitionBy("session").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("session", "day", F.coalesce(F.sum("n_day").over(before), F.lit(0)).alias("earlier"))
    place = F.row_number().over(Window.partitionBy("session", "day").orderBy("logged_at", "turn_id"))
    n = t.withColumn("place", place).join(days, ["session", "day"]).withColumn("n", (F.col("earlier") + F.col("place")).cast("int"))
    return n.select("turn_id", "n", (F.col("n") - 1 != F.col("turn_index")).alias("differs"))


_ABOUT = "(" + " OR ".join(f"contains(lower(content), '{p}')" for p in V.EVENT_PHRASES) + ")"
QUERIES = {f.__name__: f for f in (
    chat_window, hygiene_verdict, clean_response, classify_turns, query_intent, comparison_targets, event_type_infer, knn_cosine, knn_label_vote, hybrid_rerank, intent_weighted_rank, audit_top5, rank_reasoning, ablation_weights, comparison_groups, comparison_groups_every,
    merge_flat, merge_and_rank, run_summary, stage_timing, session_index,
)}


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _any(terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(q, {_lit(t)})" for t in terms) + ")"


def _count(terms: list[str]) -> str:
    return "(" + " + ".join(f"contains(q, {_lit(t)})::INT" for t in terms) + ")"


T = "WITH t AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY turn_id) = 1),\nm AS (SELECT turn_id, 'user' AS source, user_message AS text FROM t UNION ALL SELECT turn_id, 'assistant', assistant_reply FROM t),\nqs AS (SELECT 'q' || item_id AS qid, question FROM eval_items UNION ALL SELECT 't' || turn_id, user_message FROM t WHERE user_message IS NOT NULL)\n"
_RULES = ", ".join(f"CASE WHEN source = '{s}' AND regexp_matches(text, {_lit('(?is)' + p)}) THEN struct_pack(c := {c}::DOUBLE, k := {-k}, t := '{t}') END" for k, (p, t, c, s) in enumerate(V.TYPE_RULES))
_SCORES = f"""q2 AS (SELECT qid, question, lower(question) AS q FROM qs),
q3 AS (SELECT *, {_any(V.TEMPORAL_STRONG)} AS strong, {_count(V.TEMPORAL_WEAK)} AS weak, regexp_matches(q, '\\b(first|before|after|earlier|later|oldest|newest|most recent)\\b') AS ord, {_any(V.COMPARISON_STRONG)} AS cmp, {_any(V.COMPARISON_WEAK)} AS cmpw,
  regexp_matches(q, '(?s)\\bwhich\\b.{{1,60}}\\bfirst\\b.{{0,80}}\\bor\\b') AS whichf, regexp_matches(q, '\\bwhat (happened|went wrong|occurred)\\b') AS whath, regexp_matches(q, '\\s(or|vs\\.?|versus)\\s') AS sep,
  {_any(V.EVENT_MARKERS)} AS ev, {_any(V.RELATIONSHIP_MARKERS)} AS rel, {_any(V.FACTUAL_MARKERS)} AS fac FROM q2),
q4 AS (SELECT qid, question, list_reverse_sort([
  struct_pack(s := round(0.40 + CASE WHEN fac THEN 0.35 ELSE 0 END, 6)::DOUBLE, k := 0, n := 'FACTUAL'),
  struct_pack(s := round(CASE WHEN strong THEN 0.55 ELSE 0 END + 0.30 * least(weak, 2) + CASE WHEN ord THEN 0.30 ELSE 0 END - CASE WHEN whath AND ord THEN 0.15 ELSE 0 END - CASE WHEN whichf THEN 0.20 ELSE 0 END, 6)::DOUBLE, k := -1, n := 'TEMPORAL'),
  struct_pack(s := round(CASE WHEN ev THEN 0.55 ELSE 0 END + CASE WHEN whath AND ord THEN 0.25 ELSE 0 END + CASE WHEN weak > 0 AND NOT strong THEN 0.10 ELSE 0 END, 6)::DOUBLE, k := -2, n := 'EVENT'),
  struct_pack(s := round(CASE WHEN cmp THEN 0.55 ELSE 0 END + CASE WHEN (cmp OR cmpw) AND sep THEN 0.15 ELSE 0 END + CASE WHEN whichf THEN 0.40 ELSE 0 END, 6)::DOUBLE, k := -3, n := 'COMPARISON'),
  struct_pack(s := round(CASE WHEN rel THEN 0.60 ELSE 0 END, 6)::DOUBLE, k := -4, n := 'RELATIONSHIP')]) AS r FROM q3),
q5 AS (SELECT qid, question, CASE WHEN round(r[1].s - r[2].s, 6) < 0.10 AND r[1].s < 0.70 THEN 'AMBIGUOUS' WHEN r[1].s < 0.45 THEN 'FACTUAL' ELSE r[1].n END AS intent,
  CASE WHEN round(r[1].s - r[2].s, 6) < 0.10 AND r[1].s < 0.70 THEN round(greatest(r[1].s, 0.45), 3) WHEN r[1].s < 0.45 THEN 0.45 ELSE round(least(r[1].s, 0.92), 3) END::DOUBLE AS confidence,
  CASE WHEN round(r[1].s - r[2].s, 6) < 0.10 AND r[1].s < 0.70 THEN r[2].n WHEN r[2].s > 0.30 THEN r[2].n ELSE 'none' END AS secondary FROM q4)"""
_COS = "list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / sqrt(list_sum(list_transform(x.embedding, lambda z: z::DOUBLE * z::DOUBLE)) * list_sum(list_transform(y.embedding, lambda z: z::DOUBLE * z::DOUBLE)))"
_NEAR = f"WITH s AS (SELECT x.vec_id AS query_id, y.vec_id AS neighbour_id, y.label, {_COS} AS score FROM embeddings x JOIN embeddings y ON x.vec_id % 100 = 0 AND x.vec_id <> y.vec_id),\nnear AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour_id) AS rank FROM s)\n"
_GROUPS = """WITH b AS (SELECT * FROM memory_blocks QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_accessed_at DESC, access_count DESC) = 1),
e AS (SELECT DISTINCT id AS entity_id, unnest(memory_ids) AS memory_id FROM entities WHERE entity_type IN ('device', 'organization')),
g AS (SELECT entity_id, memory_id, @ABOUT@ AS about, row_number() OVER (PARTITION BY entity_id ORDER BY @ABOUT@ DESC, created_at DESC, memory_id)::INTEGER AS place
  FROM e JOIN b ON b.id = memory_id QUALIFY about OR place <= 8),
f AS (SELECT memory_id, round(least(0.98::DOUBLE, arg_min(0.95::DOUBLE - 0.05::DOUBLE * place, entity_id) + 0.10::DOUBLE * (count(*) - 1)), 6) AS score, count(*)::BIGINT AS n FROM g GROUP BY memory_id)
"""
_GROUPS_EVERY = """WITH b AS (SELECT * FROM memory_blocks QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_accessed_at DESC, access_count DESC) = 1),
e AS (SELECT DISTINCT id AS entity_id, unnest(memory_ids) AS memory_id FROM entities),
g AS (SELECT entity_id, memory_id, @ABOUT@ AS about, row_number() OVER (PARTITION BY entity_id ORDER BY @ABOUT@ DESC, created_at DESC, memory_id)::INTEGER AS place
  FROM e JOIN b ON b.id = memory_id QUALIFY about OR place <= 8)
"""
_KIND = "CASE tag WHEN 'USER_PROFILE' THEN 'USER_FACT' WHEN 'PROJECT_FACT' THEN 'PROJECT_FACT' WHEN 'EPISODIC' THEN 'EVENT' ELSE 'TEMPORARY_CONTEXT' END"
_FITS = " OR ".join(f"(intent = '{i}' AND kind IN ({', '.join(_lit(k) for k in ks)}))" for i, ks in V.FITTING.items())
_W = lambda k: "(CASE intent " + " ".join(f"WHEN '{i}' THEN {w[k]}" for i, w in V.WEIGHTS.items()) + " END)::DOUBLE"
_RANK = (
    T[:-1]
    + ",\nfq AS (SELECT session_id, arg_min(user_message, (logged_at, turn_id)) AS question FROM t WHERE session_id IS NOT NULL AND user_message IS NOT NULL GROUP BY session_id),\n"
    + _SCORES.replace("FROM qs", "FROM (SELECT session_id AS qid, question FROM fq)")
    + f""",
b AS (SELECT * FROM memory_blocks QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_accessed_at DESC, access_count DESC) = 1),
fa AS (SELECT lower(trim(memory_id)) AS memory_id, avg(confidence) AS fact FROM (SELECT DISTINCT id, memory_id, confidence FROM structured_facts) GROUP BY 1), ti AS (SELECT lower(trim(memory_id)) AS memory_id, max(temporal_confidence) AS time FROM timeline_events GROUP BY 1),
c AS (SELECT b.id, b.session_id, intent, list_distinct(regexp_extract_all(lower(question), '\\w+')) AS ta, list_distinct(regexp_extract_all(lower(content), '\\w+')) AS tb, least(1.0::DOUBLE, len(coalesce(keywords, [])) / 5.0::DOUBLE) AS ent, least(1.0::DOUBLE, coalesce(time, 0)) AS time,
  coalesce(fact, 0.5::DOUBLE) AS fact, {_KIND} AS kind, least(1.0::DOUBLE, 0.5 / (1 + 0.01 * ((1748736000000000 - epoch_us(created_at)) / 86400000000.0)::DOUBLE) + 0.5 * ln(1 + access_count::DOUBLE) / 10) AS sal
  FROM b JOIN q5 ON q5.qid = b.session_id LEFT JOIN fa ON fa.memory_id = b.id LEFT JOIN ti ON ti.memory_id = b.id),
d AS (SELECT *, len(list_intersect(ta, tb)) / len(list_distinct(ta || tb))::DOUBLE AS sim, CASE WHEN {_FITS} THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END AS type FROM c),
r AS (SELECT *, round({" + ".join(f"{s} * {_W(k)}" for k, s in enumerate(V.SIGNALS))}, 4) AS score FROM d),
rk AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, id)::INTEGER AS rank FROM r QUALIFY rank <= 10)
"""
)
SQL = {
    "chat_window": T + "SELECT coalesce(session_id, 'none') AS session, turn_id, row_number() OVER (PARTITION BY session_id ORDER BY logged_at DESC, turn_id DESC)::INTEGER AS back FROM t QUALIFY back <= 6",
    "hygiene_verdict": T[:-1]
    + f""", h AS (SELECT turn_id, source, trim(coalesce(text, '')) AS x, list_filter(regexp_split_to_array(lower(trim(coalesce(text, ''))), '\\s+'), lambda w: w <> '') AS ws FROM m),
g AS (SELECT *, list_max(list_transform(list_distinct(ws), lambda k: len(list_filter(ws, lambda w: w = k)))) / len(ws)::DOUBLE AS rep FROM h),
v AS (SELECT turn_id, source, CASE WHEN length(x) < 8 OR len(ws) < 2 THEN 'too_short' WHEN rep > 0.6 THEN 'repetition' {" ".join(f"WHEN source = 'assistant' AND regexp_matches(x, {_lit('(?i)' + p)}) THEN 'assistant_noise:{lab}'" for p, lab in V.ASSISTANT_NOISE)}
 {" ".join(f"WHEN source = 'user' AND regexp_matches(x, {_lit('(?i)' + p)}) THEN 'user_noise:{lab}'" for p, lab in V.USER_NOISE)} WHEN source = 'assistant' THEN 'assistant_clean' ELSE 'user_message_clean' END AS reason FROM g)
SELECT turn_id, source, CASE reason WHEN 'assistant_clean' THEN 'STORE_COLD' WHEN 'user_message_clean' THEN 'STORE' ELSE 'DISCARD' END AS verdict, reason FROM v""",
    "classify_turns": T[:-1]
    + f""", r AS (SELECT turn_id, source, list_max(list_filter([{_RULES}], lambda x: x IS NOT NULL)) AS b FROM m WHERE text IS NOT NULL)
SELECT turn_id, source, CASE WHEN b.c >= 0.78 THEN b.t WHEN source = 'assistant' THEN 'ASSISTANT_RESPONSE' WHEN b IS NOT NULL THEN b.t ELSE 'TEMPORARY_CONTEXT' END AS memory_type,
 CASE WHEN b.c >= 0.78 THEN b.c WHEN source = 'assistant' THEN 0.7 WHEN b IS NOT NULL THEN b.c ELSE 0.3 END::DOUBLE AS confidence, CASE WHEN b.c >= 0.78 THEN 'heuristic' WHEN source = 'assistant' THEN 'source' WHEN b IS NOT NULL THEN 'heuristic' ELSE 'fallback' END AS method FROM r""",
    "query_intent": T[:-1] + ",\n" + _SCORES + " SELECT qid, intent, confidence, secondary FROM q5",
    "event_type_infer": T
    + """SELECT qid, CASE WHEN regexp_matches(lower(question), '\\b(bought|buy|purchased?|order(ed)?|pick(ed)? up|got|get|received?)\\b') THEN 'purchased' WHEN regexp_matches(lower(question), '\\b(attend(ed)?|went to|visit(ed)?)\\b') THEN 'attended'
 WHEN regexp_matches(lower(question), '\\b(start(ed)?|began|begin|launch(ed)?)\\b') THEN 'started' WHEN regexp_matches(lower(question), '\\b(complet(ed)?|finish(ed)?|done|wrap(ped)? up)\\b') THEN 'completed' WHEN regexp_matches(lower(question), '\\b(mov(ed)?|relocat(ed)?)\\b') THEN 'moved_to'
 WHEN regexp_matches(lower(question), '\\b(first device|first laptop|first phone)\\b') THEN 'purchased' ELSE 'none' END AS event_type FROM qs""",
    "knn_cosine": _NEAR + "SELECT query_id, neighbour_id, round(score, 5) AS score, rank::INTEGER AS rank FROM near WHERE rank <= 5",
    "knn_label_vote": _NEAR + ", v AS (SELECT query_id, label, count(*) AS n FROM near WHERE rank <= 10 GROUP BY 1, 2) SELECT query_id, arg_max(label, (n, -label)) AS label FROM v GROUP BY query_id",
    "hybrid_rerank": _NEAR[:-1]
    + """, c AS (SELECT query_id, neighbour_id, round(score, 6) AS score, round((1 + neighbour_id % 10) * exp(-(0.08::DOUBLE / ((1 + neighbour_id % 20) / 10.0::DOUBLE)) * (neighbour_id % 60)), 6) AS p, exp(-(neighbour_id % 60) / 14.0::DOUBLE) AS recency, least(1.0::DOUBLE, (label % 3) / 2.0::DOUBLE) AS keyword FROM near WHERE rank <= 20),
h AS (SELECT *, round(0.6::DOUBLE * score + 0.2::DOUBLE * p / max(p) OVER (PARTITION BY query_id) + 0.1::DOUBLE * recency + 0.1::DOUBLE * keyword, 6) AS hybrid, score < 0.35 AS low FROM c),
d AS (SELECT *, NOT low AND hybrid < 0.65::DOUBLE * max(CASE WHEN NOT low THEN hybrid END) OVER (PARTITION BY query_id) AS drp FROM h)
SELECT query_id, neighbour_id, hybrid, CASE WHEN low THEN 'low_similarity' WHEN drp THEN 'score_dropoff' WHEN row_number() OVER (PARTITION BY query_id ORDER BY low OR drp, hybrid DESC, neighbour_id) > 5 THEN 'max_results' ELSE 'accepted' END AS reason FROM d""",
    "intent_weighted_rank": _RANK + "SELECT session_id, intent, id, score, rank FROM rk",
    "audit_top5": _RANK + "SELECT session_id, intent, string_agg(id, ',' ORDER BY rank) AS top5, max(score) AS best FROM rk WHERE rank <= 5 GROUP BY 1, 2",
    "ablation_weights": "SELECT * FROM (VALUES "
    + ", ".join(
        f"('{m}', '{i}', '{s}', {w}::DOUBLE)"
        for m in ("none", "no_intent", "no_keyword", "no_recency", "no_peff")
        for i, row in V.WEIGHTS.items()
        for s, w in [
            (s, round(V.WEIGHTS["FACTUAL"][k] if m == "no_intent" else 0 if s == {"no_keyword": "ent", "no_recency": "time", "no_peff": "sal"}.get(m) else row[k] + (row[V.SIGNALS.index({"no_keyword": "ent", "no_recency": "time", "no_peff": "sal"}[m])] if k == 0 and m.startswith("no_") else 0), 6))
            for k, s in enumerate(V.SIGNALS)
        ]
    )
    + ") v(mode, intent, signal, weight)",
    "comparison_groups": _GROUPS + "SELECT entity_id, memory_id, about, place FROM g",
    "comparison_groups_every": _GROUPS_EVERY + "SELECT entity_id, memory_id, about, place FROM g",
    "merge_flat": _GROUPS + "SELECT memory_id, score, n FROM f",
    "merge_and_rank": _GROUPS + "SELECT memory_id, score, 'primary' AS origin FROM f UNION ALL SELECT DISTINCT x, 0.15::DOUBLE, 'secondary' FROM (SELECT unnest(memory_ids) AS x FROM entities WHERE needs_review) WHERE x <> '' AND x NOT IN (SELECT memory_id FROM f)",
    "run_summary": T + "SELECT provider, model, count(*)::BIGINT AS n_turns, round(avg(CASE WHEN isnan(latency_ms) THEN NULL ELSE latency_ms END), 4) AS mean_latency, round(avg(context_block_count), 4) AS mean_blocks, max(context_token_estimate) AS peak_tokens FROM t GROUP BY 1, 2",
    "stage_timing": T[:-1]
    + ", g AS (SELECT model, round(sum(latency_ms), 4) AS total_ms, count(latency_ms)::BIGINT AS calls, round(avg(latency_ms), 1) AS avg_ms FROM t GROUP BY 1) SELECT model, total_ms, calls, avg_ms, round(100 * total_ms / (SELECT sum(total_ms) FROM g), 4) AS pct FROM g",
    "session_index": T + "SELECT turn_id, row_number() OVER (PARTITION BY coalesce(session_id, '') ORDER BY logged_at, turn_id)::INTEGER AS n, row_number() OVER (PARTITION BY coalesce(session_id, '') ORDER BY logged_at, turn_id) - 1 <> turn_index AS differs FROM t",
}
SQL = {name: text.replace("@ABOUT@", _ABOUT) for name, text in SQL.items()}
