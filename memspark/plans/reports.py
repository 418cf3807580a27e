"""Reports on evaluation runs: traces of retrieval, their faults, joins with results, and counts of verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark.operators import judge as J
from memspark.operators import store
from memspark.plans import evaluation
from memspark.plans.conversation import turns
from memspark.plans.evaluation import answers
from memspark.sources import load


def trace_extract(spark: SparkSession, root: str) -> DataFrame:
    """Each turn's trace: memories in its context, those paged in, and those rejected."""
    n = F.coalesce(F.size("paged_in_ids"), F.lit(0))
    return turns(spark, root).select("turn_id", F.coalesce("context_block_count", F.lit(0)).alias("n_context"), F.greatest(n, F.lit(0)).alias("n_paged"), F.greatest(F.lit(0), F.coalesce("context_block_count", F.lit(0)) - F.greatest(n, F.lit(0))).alias("n_rejected"))


def trace_issues(spark: SparkSession, root: str) -> DataFrame:
    """Turns whose trace does not agree with itself: found but none paged in, paged in but none in the context, or
    evicted with neither."""
    t = trace_extract(spark, root).join(turns(spark, root).select("turn_id", F.greatest(F.coalesce(F.size("evicted_ids"), F.lit(0)), F.lit(0)).alias("n_evicted")), "turn_id")
    c, p, e = F.col("n_context"), F.col("n_paged"), F.col("n_evicted")
    issue = F.array_compact(F.array(F.when((c > 0) & (p == 0), "found_not_paged"), F.when((p > 0) & (c == 0), "paged_not_in_context"), F.when((e > 0) & (c == 0) & (p == 0), "evicted_only")))
    return t.select("turn_id", F.explode(issue).alias("issue"))


def newest_traces(spark: SparkSession, root: str) -> DataFrame:
    """The newest turn of each message, by its text without outer blanks."""
    t = turns(spark, root).select(F.trim("user_message").alias("question"), "turn_id", "logged_at", "paged_in_ids", "context_block_count").filter("question <> ''")
    return store.current(t, "question", ["logged_at", "turn_id"])


def newest_trace_ids(spark: SparkSession, root: str) -> DataFrame:
    return newest_traces(spark, root).select("question", "turn_id")


def results_with_traces(spark: SparkSession, root: str) -> DataFrame:
    """Results of the evaluation items with the newest trace of their question, and why the failed ones failed: nothing
    retrieved, the answer in the reply after all, or not."""
    q = load(spark, root, "eval_items").select("item_id", F.trim("question").alias("question"))
    v = answers(spark, root).withColumn("v", J.verdict(F.col("expected"), F.col("response"))).withColumn("overlap", F.round(J.overlap(F.col("expected"), F.col("response")), 6)).join(q, "item_id")
    r = v.join(newest_traces(spark, root), "question", "left")
    n = F.greatest(F.coalesce(F.size("paged_in_ids"), F.lit(0)), F.lit(0))
    cause = F.when(F.col("v.passed"), "passed").when(n == 0, "nothing_retrieved").when(F.col("overlap") > 0.5, "wrong_conclusion").otherwise("answer_not_in_reply")
    return r.select("item_id", n.alias("n_retrieved"), F.coalesce("context_block_count", F.lit(-1)).alias("n_context"), cause.alias("cause"))


def verdict_lines(spark: SparkSession, root: str) -> DataFrame:
    """Each item's verdict as one line."""
    v = evaluation.judge_cascade(spark, root)
    return v.select("item_id", F.format_string("[%s @ %s]", F.when(F.col("passed") == "true", "PASS").when(F.col("passed") == "false", "FAIL").otherwise("OPEN"), F.coalesce("gate", F.lit("NONE"))).alias("line"))


def diagnosis_summary(spark: SparkSession, root: str) -> DataFrame:
    """Items by diagnosis with the accuracy that counts the judge's errors as right."""
    d = evaluation.verdict_diagnosis(spark, root)
    total = d.agg(F.count("*").alias("n_all"), F.count_if(F.col("diagnosis").isin("TRUE_PASS", "JUDGE_ERROR")).alias("n_good"))
    return d.groupBy("diagnosis").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("diagnosis", "n", F.round(100 * F.col("n_good") / F.col("n_all"), 6).alias("adjusted_accuracy"))


def accuracy_by_type(spark: SparkSession, root: str) -> DataFrame:
    """Share of passed items of each question type, and of all."""
    a = answers(spark, root).withColumn("ok", F.coalesce(J.verdict(F.col("expected"), F.col("response"))["passed"], F.lit(False)).cast("int")).select("item_id", "question_type", "ok")
    return a.rollup("question_type").agg(F.count("*").alias("n"), F.round(100 * F.avg("ok"), 6).alias("accuracy")).select(F.coalesce("question_type", F.lit("ALL")).alias("question_type"), "n", "accuracy")


def stage_ranks(spark: SparkSession, root: str) -> DataFrame:
    """The slowest turn of each model, and its place among models by it."""
    t = turns(spark, root).filter("latency_ms IS NOT NULL").groupBy(F.coalesce("model", F.lit("none")).alias("model")).agg(F.max("latency_ms").alias("slowest_ms"), F.count("*").alias("n_turns"))
    return t.withColumn("place", F.row_number().over(Window.orderBy(F.desc("slowest_ms"), "model")))  # one row per model


QUERIES = {f.__name__: f for f in (trace_extract, trace_issues, newest_trace_ids, results_with_traces, verdict_lines, diagnosis_summary, accuracy_by_type, stage_ranks)}

_T = "t AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY turn_id) = 1)"
_X = "x AS (SELECT turn_id, coalesce(context_block_count, 0)::INTEGER AS n_context, coalesce(len(paged_in_ids), 0)::INTEGER AS n_paged, coalesce(len(evicted_ids), 0)::INTEGER AS n_evicted FROM t)"
_N = "n AS (SELECT trim(user_message) AS question, turn_id, paged_in_ids, context_block_count FROM t WHERE trim(user_message) <> '' QUALIFY row_number() OVER (PARTITION BY trim(user_message) ORDER BY logged_at DESC, turn_id DESC) = 1)"
SQL = {
    "trace_extract": f"WITH {_T}, {_X} SELECT turn_id, n_context, n_paged, greatest(0, n_context - n_paged)::INTEGER AS n_rejected FROM x",
    "trace_issues": f"WITH {_T}, {_X} SELECT turn_id, 'found_not_paged' AS issue FROM x WHERE n_context > 0 AND n_paged = 0 UNION ALL SELECT turn_id, 'paged_not_in_context' FROM x WHERE n_paged > 0 AND n_context = 0 UNION ALL SELECT turn_id, 'evicted_only' FROM x WHERE n_evicted > 0 AND n_context = 0 AND n_paged = 0",
    "newest_trace_ids": f"WITH {_T}, {_N} SELECT question, turn_id FROM n",
    "results_with_traces": f"""WITH {_T}, {_N}, d AS ({evaluation.SQL['verdict_diagnosis']}), c AS ({evaluation.SQL['judge_cascade']})
SELECT d.item_id, coalesce(len(paged_in_ids), 0)::INTEGER AS n_retrieved, coalesce(context_block_count, -1)::INTEGER AS n_context, CASE WHEN passed = 'true' THEN 'passed' WHEN coalesce(len(paged_in_ids), 0) = 0 THEN 'nothing_retrieved' WHEN overlap > 0.5 THEN 'wrong_conclusion' ELSE 'answer_not_in_reply' END AS cause
FROM d JOIN c USING (item_id) JOIN eval_items e USING (item_id) LEFT JOIN n ON n.question = trim(e.question)""",
    "verdict_lines": f"SELECT item_id, '[' || CASE passed WHEN 'true' THEN 'PASS' WHEN 'false' THEN 'FAIL' ELSE 'OPEN' END || ' @ ' || coalesce(gate, 'NONE') || ']' AS line FROM ({evaluation.SQL['judge_cascade']})",
    "diagnosis_summary": f"WITH d AS ({evaluation.SQL['verdict_diagnosis']}) SELECT diagnosis, count(*)::BIGINT AS n, (SELECT round(100.0 * count_if(diagnosis IN ('TRUE_PASS', 'JUDGE_ERROR')) / count(*), 6) FROM d)::DOUBLE AS adjusted_accuracy FROM d GROUP BY 1",
    "accuracy_by_type": f"WITH c AS ({evaluation.SQL['judge_cascade']}) SELECT coalesce(question_type, 'ALL') AS question_type, count(*)::BIGINT AS n, round(100 * avg((passed = 'true')::INT), 6) AS accuracy FROM c JOIN eval_items USING (item_id) GROUP BY ROLLUP (question_type)",
    "stage_ranks": f"WITH {_T}, g AS (SELECT coalesce(model, 'none') AS model, max(latency_ms) AS slowest_ms, count(*)::BIGINT AS n_turns FROM t WHERE latency_ms IS NOT NULL GROUP BY 1) SELECT *, row_number() OVER (ORDER BY slowest_ms DESC, model)::INTEGER AS place FROM g",
}
