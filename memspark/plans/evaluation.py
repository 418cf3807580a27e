"""Queries on evaluation items, logs, nested sessions, and event streams read as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions import text as X
from memspark.functions import vocab as V
from memspark.operators import judge as J
from memspark.plans.blocks import blocks
from memspark.sources import load
from memspark.streaming import windows as W


def answers(spark: SparkSession, root: str) -> DataFrame:
    """Evaluation items with made responses: right, hedged, empty, erring, other numbers, and a passage's start."""
    k = F.pmod("item_id", F.lit(6))
    made = (
        F.when(k == 0, F.concat(F.lit("I think the answer is "), F.col("answer"), F.lit(".")))
        .when(k == 1, F.concat(F.lit("I don't have any information about "), F.col("question")))
        .when(k == 2, F.lit(""))
        .when(k == 3, F.concat(F.lit("ERROR: "), F.col("question")))
        .when(k == 4, F.concat(F.lit("It was about "), (F.col("item_id") + 3).cast("string"), F.lit(" days, or 2 weeks")))
        .otherwise(F.substring("passage", 1, 120))
    )
    return load(spark, root, "eval_items").select("item_id", "question_type", F.col("answer").alias("expected"), made.alias("response"))


def judge_gates(spark: SparkSession, root: str) -> DataFrame:
    a, e, r = answers(spark, root), F.col("expected"), F.col("response")
    text = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    return a.select("item_id", text(J.error_gate(r)).alias("error"), text(J.abstention_gate(r)).alias("abstention"), text(J.numeric_gate(e, r)).alias("numeric"), text(J.substring_match(e, r)).alias("substring"))


def judge_cascade(spark: SparkSession, root: str) -> DataFrame:
    a = answers(spark, root).withColumn("v", J.verdict(F.col("expected"), F.col("response")))
    return a.select("item_id", F.coalesce(F.col("v.passed").cast("string"), F.lit("none")).alias("passed"), "v.gate")


def verdict_diagnosis(spark: SparkSession, root: str) -> DataFrame:
    a = answers(spark, root).withColumn("v", J.verdict(F.col("expected"), F.col("response"))).withColumn("overlap", F.round(J.overlap(F.col("expected"), F.col("response")), 6))
    d = F.when(F.col("v.passed"), "TRUE_PASS").when(F.col("overlap") >= 0.6, "JUDGE_ERROR").otherwise("TRUE_FAIL")
    return a.select("item_id", "overlap", d.alias("diagnosis"))


def probe_breakdown(spark: SparkSession, root: str) -> DataFrame:
    a = answers(spark, root).withColumn("v", J.verdict(F.col("expected"), F.col("response")))
    return a.groupBy("question_type").agg(F.count("*").alias("n_items"), F.round(100 * F.avg(F.coalesce(F.col("v.passed"), F.lit(False)).cast("int")), 4).alias("accuracy"))


def keyword_coverage(spark: SparkSession, root: str) -> DataFrame:
    a = answers(spark, root)
    words = X.keywords(F.col("expected"))
    hit = F.size(F.filter(words, lambda w: F.contains(F.lower("response"), w)))
    return a.select("item_id", F.round(F.when(F.size(words) > 0, hit / F.size(words)).otherwise(0.0), 6).alias("coverage"))


def json_fields(spark: SparkSession, root: str) -> DataFrame:
    """The number in each event's JSON, with broken and fenced JSON as null."""
    e = load(spark, root, "events")
    bare = F.regexp_replace("props", r"^```(?:json)?\s*|\s*```$", "")
    k = F.from_json(bare, "k bigint")["k"]
    return e.groupBy("event_type").agg(F.sum(k).alias("total"), F.count(k).alias("parsed"), F.count("*").alias("n_events"))


def log_severity(spark: SparkSession, root: str) -> DataFrame:
    lines = blocks(spark, root).select("id", F.concat(F.date_format("created_at", "HH:mm:ss"), F.lit(" "), F.col("content")).alias("line"))
    return lines.select("id", J.log_severity(F.col("line")).alias("severity"), F.regexp_extract("line", r"\b(\d{2}:\d{2}:\d{2})\b", 1).alias("at"))


def session_flatten(spark: SparkSession, root: str) -> DataFrame:
    """Sessions as arrays of messages and back, with both positions."""
    d = load(spark, root, "documents").filter("doc_kind = 'session'")
    lines = d.select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line")).filter("line <> ''")
    return lines.select("doc_id", "pos", F.regexp_extract("line", r"^([A-Z]):", 1).alias("speaker"), F.length("line").alias("n_chars"))


def block_sources(spark: SparkSession, root: str) -> DataFrame:
    """Odd spellings of sources folded to user, assistant, system, or other."""
    low = F.lower(F.regexp_replace(F.coalesce("source", F.lit("")), r"[\s_-]+", ""))
    known = F.when(low.startswith("u"), "user").when(low.startswith("a"), "assistant").when(low.startswith("s"), "system").otherwise("other")
    return blocks(spark, root).groupBy(known.alias("kind")).agg(F.count("*").alias("n_blocks"))


def stream_tumbling(spark: SparkSession, root: str) -> DataFrame:
    """Counts per hour and type, computed by a stream over the table, equal to the batch result."""
    return W.run_once(W.tumbling(W.read_table(spark, root, "events"), "1 hour"))


def stream_sessions(spark: SparkSession, root: str) -> DataFrame:
    return W.run_once(W.sessions(W.read_table(spark, root, "events"), "30 minutes"))


def stream_dedup(spark: SparkSession, root: str) -> DataFrame:
    """Blocks sent twice, once each, by a stream that keeps their ids within the watermark."""
    return W.run_once(W.first_seen(W.read_table(spark, root, "memory_blocks"), "id", "created_at").select("id", "tag"))


QUERIES = {f.__name__: f for f in (
    judge_gates, judge_cascade, verdict_diagnosis, probe_breakdown, keyword_coverage, json_fields, log_severity, session_flatten, block_sources, stream_tumbling, stream_sessions, stream_dedup,
)}


def _q(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


_NUMS = lambda c: (
    f"list_distinct(list_transform(regexp_extract_all({c}, '\\b(\\d+(?:\\.\\d+)?)\\b', 1), lambda x: x::DOUBLE) || list_filter([{', '.join(f'CASE WHEN regexp_matches(lower({c}), {_q(chr(92) + chr(98) + w + chr(92) + chr(98))}) THEN {n}::DOUBLE END' for w, n in V.NUMBER_WORDS.items())}], lambda x: x IS NOT NULL)"
    f" || list_transform(regexp_extract_all(lower({c}), '(\\d+(?:\\.\\d+)?)\\s*(?:week|weeks)\\b', 1), lambda x: x::DOUBLE * 7))"
)
_SQZ = lambda c: f"trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_UNITS = "[" + ", ".join(_q(u) for u in V.UNIT_WORDS) + "]"
_KEYS = lambda c: f"list_filter(list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(lower({c}), '[^a-z0-9\\s]', '', 'g')), '\\s+'), lambda w: w <> '')), lambda w: length(w) > 2 AND NOT list_contains([{', '.join(_q(x) for x in V.KEY_TOKEN_STOP)}], w))"
A = f"""WITH a0 AS (SELECT item_id, question_type, answer AS expected, CASE item_id % 6 WHEN 0 THEN 'I think the answer is ' || answer || '.' WHEN 1 THEN 'I don''t have any information about ' || question WHEN 2 THEN '' WHEN 3 THEN 'ERROR: ' || question
  WHEN 4 THEN 'It was about ' || (item_id + 3) || ' days, or 2 weeks' ELSE passage[1:120] END AS response FROM eval_items),
a1 AS (SELECT *, list_filter(regexp_split_to_array(trim(response), '\\s+'), lambda w: w <> '') AS ws, {_SQZ("expected")} AS ne, {_SQZ("response")} AS nr, {_NUMS("expected")} AS xe, {_NUMS("response")} AS xr,
  try_cast(nullif(regexp_extract(lower(expected), '(\\d+)\\s*years?\\D+?(\\d+)\\s*months?', 1), '') AS INT) * 12 + try_cast(nullif(regexp_extract(lower(expected), '(\\d+)\\s*years?\\D+?(\\d+)\\s*months?', 2), '') AS INT) AS de,
  try_cast(nullif(regexp_extract(lower(response), '(\\d+)\\s*years?\\D+?(\\d+)\\s*months?', 1), '') AS INT) * 12 + try_cast(nullif(regexp_extract(lower(response), '(\\d+)\\s*years?\\D+?(\\d+)\\s*months?', 2), '') AS INT) AS dr,
  regexp_matches(expected, '\\b\\d+(\\.\\d+)?\\b') AND len(list_filter(regexp_extract_all(lower(expected), '[a-z'']+'), lambda w: NOT list_contains([{", ".join(_q(u) for u in V.NUMERIC_UNITS)}], w))) <= 1 AS numeric FROM a0),
a2 AS (SELECT *, CASE WHEN trim(response) = '' OR len(ws) < 3 OR {" OR ".join(f"starts_with(trim(response), {_q(p)})" for p in V.ERROR_PREFIXES)} THEN false END AS g_error,
  CASE WHEN {" OR ".join(f"contains(lower(array_to_string(ws[1:14], ' ')), {_q(p)})" for p in V.ABSTENTION)} THEN false END AS g_abst,
  CASE WHEN numeric THEN CASE WHEN de IS NOT NULL THEN de = dr WHEN len(xe) = 0 OR len(xr) = 0 THEN NULL WHEN list_has_any(xe, xr) THEN true WHEN regexp_matches(lower(response), '\\b(\\d+(?:\\.\\d+)?)\\s*(day|days|month|months|year|years|week|weeks)\\b') THEN false END END AS g_num,
  CASE WHEN ne = '' OR nr = '' THEN NULL WHEN contains(ne, nr) OR contains(nr, ne) OR len(list_filter(list_filter(string_split(ne, ' '), lambda w: length(w) >= 4 AND NOT list_contains({_UNITS}, w)), lambda x: len(list_filter(list_filter(string_split(nr, ' '), lambda w: length(w) >= 4 AND NOT list_contains({_UNITS}, w)), lambda y: starts_with(x, y) OR starts_with(y, x))) > 0)) > 0 THEN true END AS g_sub FROM a1),
a AS (SELECT *, coalesce(g_error, g_abst, g_num, g_sub) AS passed, CASE WHEN g_error IS NOT NULL THEN 'ERROR_GATE' WHEN g_abst IS NOT NULL THEN 'ABSTENTION_GATE' WHEN g_num IS NOT NULL THEN 'NUMERIC_GATE' WHEN g_sub IS NOT NULL THEN 'SUBSTRING_MATCH' ELSE 'UNDECIDED' END AS gate,
  {_KEYS("expected")} AS ke, {_KEYS("response")} AS kr FROM a2)
"""
_B = "WITH b AS (SELECT * FROM memory_blocks QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_accessed_at DESC, access_count DESC) = 1)\n"
SQL = {
    "judge_gates": A + "SELECT item_id, coalesce(g_error::VARCHAR, 'none') AS error, coalesce(g_abst::VARCHAR, 'none') AS abstention, coalesce(g_num::VARCHAR, 'none') AS numeric, coalesce(g_sub::VARCHAR, 'none') AS substring FROM a",
    "judge_cascade": A + "SELECT item_id, coalesce(passed::VARCHAR, 'none') AS passed, gate FROM a",
    "verdict_diagnosis": A[:-1]
    + ", d AS (SELECT item_id, passed, round(CASE WHEN len(ke) > 0 THEN len(list_intersect(ke, kr)) / len(ke)::DOUBLE ELSE 0 END, 6)::DOUBLE AS overlap FROM a) SELECT item_id, overlap, CASE WHEN passed THEN 'TRUE_PASS' WHEN overlap >= 0.6 THEN 'JUDGE_ERROR' ELSE 'TRUE_FAIL' END AS diagnosis FROM d",
    "probe_breakdown": A + "SELECT question_type, count(*)::BIGINT AS n_items, round(100 * avg(coalesce(passed, false)::INT), 4) AS accuracy FROM a GROUP BY 1",
    "json_fields": "SELECT event_type, sum((props::JSON->>'k')::BIGINT)::BIGINT AS total, count(props::JSON->>'k')::BIGINT AS parsed, count(*)::BIGINT AS n_events FROM events GROUP BY 1",
    "log_severity": _B
    + "SELECT id, CASE WHEN regexp_matches(lower(content), 'error|exception|traceback|failed') THEN 'error' WHEN contains(lower(content), 'warn') THEN 'warning' WHEN regexp_matches(lower(content), 'pass|success|complete') THEN 'success' ELSE 'info' END AS severity, strftime(created_at, '%H:%M:%S') AS at FROM b",
    "session_flatten": """WITH s AS (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS ls FROM documents WHERE doc_kind = 'session'), l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM s)
SELECT doc_id, pos::INTEGER AS pos, regexp_extract(line, '^([A-Z]):', 1) AS speaker, length(line)::INTEGER AS n_chars FROM l WHERE line <> ''""",
    "block_sources": _B
    + "SELECT CASE regexp_replace(lower(coalesce(source, '')), '[\\s_-]+', '', 'g')[1] WHEN 'u' THEN 'user' WHEN 'a' THEN 'assistant' WHEN 's' THEN 'system' ELSE 'other' END AS kind, count(*)::BIGINT AS n_blocks FROM b GROUP BY 1",
    "stream_tumbling": "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start_us, event_type, count(*)::BIGINT AS n_events FROM events GROUP BY 1, 2",
    "stream_sessions": """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, epoch_us(min(ts))::BIGINT AS start_us, count(*)::BIGINT AS n_events FROM s GROUP BY user_id, k""",
    "stream_dedup": "SELECT DISTINCT id, tag FROM memory_blocks",
}
