"""Texts to typed rows: hygiene, classification, facts, mentions and intents, all as native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions import temporal as T
from memspark.functions import text as X
from memspark.functions import vocab as V


def hygiene(text: Column, source: Column, extra_assistant: tuple[str, ...] = (), extra_user: tuple[str, ...] = (), min_chars: int = V.MIN_CHARS, min_words: int = V.MIN_WORDS) -> Column:
    """Struct (verdict, reason) of a text. Null or short texts are discarded; own patterns are labelled ``custom``."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    out = F.when((F.length(bare) < min_chars) | (X.word_count(bare) < min_words), _verdict("DISCARD", "too_short"))
    out = out.when(X.repetition(bare) > V.MAX_REPETITION, _verdict("DISCARD", "repetition"))
    for pattern, label in [*V.ASSISTANT_NOISE, *((p, "custom") for p in extra_assistant)]:
        out = out.when((source == "assistant") & bare.rlike("(?i)" + pattern), _verdict("DISCARD", f"assistant_noise:{label}"))
    for pattern, label in [*V.USER_NOISE, *((p, "custom") for p in extra_user)]:
        out = out.when((source == "user") & bare.rlike("(?i)" + pattern), _verdict("DISCARD", f"user_noise:{label}"))
    return out.when(source == "assistant", _verdict("STORE_COLD", "assistant_clean")).when(source == "system", _verdict("STORE_COLD", "system_message")).otherwise(_verdict("STORE", "user_message_clean"))


def _verdict(verdict: str, reason: str) -> Column:
    return F.struct(F.lit(verdict).alias("verdict"), F.lit(reason).alias("reason"))


def classify(text: Column, source: Column, gate: float = 0.78) -> Column:
    """Struct (memory_type, confidence, method). The rule of the highest confidence wins, the first of equals; noise
    needs 0.85; assistant texts under the gate are responses; without a rule the fallback has 0.30."""
    rules = F.array(*[F.when((source == s) & text.rlike("(?is)" + p), F.struct(F.lit(c).alias("c"), F.lit(-k).alias("k"), F.lit(t).alias("t"))) for k, (p, t, c, s) in enumerate(V.TYPE_RULES)])
    best = F.array_max(F.filter(rules, lambda r: r.isNotNull()))
    kind = lambda t, c, m: F.struct(t.alias("memory_type") if isinstance(t, Column) else F.lit(t).alias("memory_type"), (c if isinstance(c, Column) else F.lit(c)).alias("confidence"), F.lit(m).alias("method"))
    return (
        F.when(source == "system", kind("TEMPORARY_CONTEXT", 0.80, "source"))
        .when(best["c"] >= gate, kind(best["t"], best["c"], "heuristic"))
        .when(source == "assistant", kind("ASSISTANT_RESPONSE", 0.70, "source"))
        .when(best.isNotNull(), kind(best["t"], best["c"], "heuristic"))
        .otherwise(kind("TEMPORARY_CONTEXT", 0.30, "fallback"))
    )


def normalise_predicate(raw: Column) -> Column:
    key = F.trim(F.lower(raw))
    table = F.create_map(*[x for k, v in V.PREDICATES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(table[key], key)


def _made(predicate: str, kind: str):
    """Turns a matched object into a fact's struct."""
    return lambda o: F.struct(F.lit(predicate).alias("predicate"), F.regexp_replace(F.trim(o), r"[.,;]+$", "").alias("object_value"), F.lit(kind).alias("fact_type"))


def facts(memories: DataFrame) -> DataFrame:
    """(memory_id, text) -> (memory_id, subject, predicate, object_value, fact_type, confidence), one row per match.

    An object loses trailing dots, commas and semicolons; empty ones and those of over 120 characters are dropped."""
    parts = []
    for pattern, group, predicate, kind in V.FACT_RULES:
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
        parts.append(F.transform(found, _made(predicate, kind)))
    rows = memories.select("memory_id", F.explode(F.concat(*parts)).alias("f")).select("memory_id", F.lit("user").alias("subject"), "f.predicate", "f.object_value", "f.fact_type", F.lit(0.65).alias("confidence"))
    return rows.filter((F.col("object_value") != "") & (F.length("object_value") <= 120))


def with_intent(df: DataFrame, question: str) -> DataFrame:
    """Adds the struct intent (intent, confidence, secondary) of a question by its marker words.

    Markers, scores and the choice are columns of successive projections, so none is computed twice."""
    q = F.lower(question)
    add = lambda c, x: F.when(F.col(c), F.lit(x)).otherwise(F.lit(0.0))
    marks = df.withColumns({
        "_strong": X.contains_any(q, V.TEMPORAL_STRONG), "_weak": X.count_terms(q, V.TEMPORAL_WEAK), "_order": q.rlike(r"\b(first|before|after|earlier|later|oldest|newest|most recent)\b"),
        "_what": q.rlike(r"\bwhat (happened|went wrong|occurred)\b"), "_which": q.rlike(r"(?s)\bwhich\b.{1,60}\bfirst\b.{0,80}\bor\b"), "_compare": X.contains_any(q, V.COMPARISON_STRONG), "_maybe": X.contains_any(q, V.COMPARISON_WEAK),
        "_halves": q.rlike(r"\s(or|vs\.?|versus)\s"), "_event": X.contains_any(q, V.EVENT_MARKERS), "_relation": X.contains_any(q, V.RELATIONSHIP_MARKERS), "_fact": X.contains_any(q, V.FACTUAL_MARKERS),
    })
    marks = marks.withColumns({"_what": F.col("_what") & F.col("_order"), "_targets": (F.col("_compare") | F.col("_maybe")) & F.col("_halves"), "_only_weak": (F.col("_weak") > 0) & ~F.col("_strong")})
    scores = {
        "FACTUAL": F.lit(0.40) + add("_fact", 0.35),
        "TEMPORAL": add("_strong", 0.55) + F.lit(0.30) * F.least(F.col("_weak"), F.lit(2)) + add("_order", 0.30) - add("_what", 0.15) - add("_which", 0.20),
        "EVENT": add("_event", 0.55) + add("_what", 0.25) + add("_only_weak", 0.10),
        "COMPARISON": add("_compare", 0.55) + add("_targets", 0.15) + add("_which", 0.40),
        "RELATIONSHIP": add("_relation", 0.60),
    }
    ranked = F.sort_array(F.array(*[F.struct(F.round(s, 6).alias("s"), F.lit(-k).alias("k"), F.lit(n).alias("n")) for k, (n, s) in enumerate(scores.items())]), asc=False)
    best, second = F.col("_ranked")[0], F.col("_ranked")[1]
    close = (F.round(best["s"] - second["s"], 6) < 0.10) & (best["s"] < 0.70)
    also = F.when(second["s"] > 0.30, second["n"])
    choice = (
        F.when(close, F.struct(F.lit("AMBIGUOUS").alias("intent"), F.round(F.greatest(best["s"], F.lit(0.45)), 3).alias("confidence"), second["n"].alias("secondary")))
        .when(best["s"] < 0.45, F.struct(F.lit("FACTUAL").alias("intent"), F.lit(0.45).alias("confidence"), also.alias("secondary")))
        .otherwise(F.struct(best["n"].alias("intent"), F.round(F.least(best["s"], F.lit(0.92)), 3).alias("confidence"), also.alias("secondary")))
    )
    kept = [F.col(c) for c in df.columns if c != "intent"]
    return marks.withColumn("_ranked", ranked).select(*kept, choice.alias("intent"))


def comparison_targets(question: Column) -> Column:
    """The last four words before and the first four after the first or, vs or versus; empty without one."""
    halves = F.split(question, r"(?i)\s+(?:or|vs\.?|versus)\s+", 2)
    clean = lambda ws: F.array_join(F.transform(ws, lambda w: F.regexp_replace(w, r"^[^\w]+|[^\w]+$", "")), " ")
    left = X.split_words(halves[0])
    tail = F.slice(left, F.greatest(F.lit(1), F.size(left) - 3), 4)
    return F.when(F.size(halves) == 2, F.array(clean(tail), clean(F.slice(X.split_words(halves[1]), 1, 4)))).otherwise(F.array().cast("array<string>"))


def event_type(question: Column) -> Column:
    q = F.lower(question)
    return (
        F.when(q.rlike(r"\b(bought|buy|purchased?|order(ed)?|pick(ed)? up|got|get|received?)\b"), "purchased")
        .when(q.rlike(r"\b(attend(ed)?|went to|visit(ed)?)\b"), "attended")
        .when(q.rlike(r"\b(start(ed)?|began|begin|launch(ed)?)\b"), "started")
        .when(q.rlike(r"\b(complet(ed)?|finish(ed)?|done|wrap(ped)? up)\b"), "completed")
        .when(q.rlike(r"\b(mov(ed)?|relocat(ed)?)\b"), "moved_to")
        .when(q.rlike(r"\b(first device|first laptop|first phone)\b"), "purchased")
    )


def indexable(facts: DataFrame) -> DataFrame:
    """Facts that make timeline events: dated, sure enough, of an indexed predicate."""
    return facts.filter(F.col("earliest").isNotNull() & F.col("latest").isNotNull() & (F.col("temporal_confidence") >= V.INDEX_CONFIDENCE) & F.col("predicate").isin(V.INDEXABLE))


def dated(df: DataFrame, raw: str, anchor: Column) -> DataFrame:
    """Adds earliest, latest, date_confidence and granularity of the date words in ``raw``."""
    return df.withColumn("_b", T.parse(F.col(raw), anchor)).select(*df.columns, F.col("_b.earliest").alias("p_earliest"), F.col("_b.latest").alias("p_latest"), F.col("_b.confidence").alias("p_confidence"), F.col("_b.granularity").alias("p_granularity"))


def tag_of(text: Column) -> Column:
    t = F.lower(text)
    return (
        F.when(X.contains_any(t, ["project", "retrieval", "memory", "embedding", "benchmark"]), "PROJECT_FACT")
        .when(X.contains_any(t, ["my name", "favorite", "i prefer", "i like"]), "USER_PROFILE")
        .when(X.contains_any(t, ["todo", "need to", "remind"]), "TASK")
        .otherwise("EPISODIC")
    )


def numbers(text: Column) -> Column:
    """Distinct numbers in a text: digits, number words, and weeks also as days."""
    low = F.lower(text)
    digits = F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d+(?:\.\d+)?)\b"), F.lit(1)), lambda x: x.cast("double"))
    words = F.filter(F.array(*[F.when(low.rlike(rf"\b{w}\b"), F.lit(float(n))) for w, n in V.NUMBER_WORDS.items()]), lambda x: x.isNotNull())
    weeks = F.transform(F.regexp_extract_all(low, F.lit(r"(\d+(?:\.\d+)?)\s*(?:week|weeks)\b"), F.lit(1)), lambda x: x.cast("double") * 7)
    return F.array_distinct(F.concat(digits, words, weeks))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
