"""Replies of language models as columns: what a model said, parsed and checked.

The engine calls no model. Whoever runs one adds its replies as a text column; these expressions turn them into the
typed values that the rules of ``extract`` and ``judge`` give, and ``first_of`` prefers one over the other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memspark.functions import vocab as V

TYPES = ["USER_FACT", "USER_PREFERENCE", "EVENT", "PROJECT_FACT", "TEMPORARY_CONTEXT", "ASSISTANT_RESPONSE", "NOISE"]


def json_of(reply: Column) -> Column:
    """The JSON in a reply: without code fences, from the first opening bracket to the last closing one; null without."""
    bare = F.regexp_replace(reply, r"(?s)```(?:json)?", "")
    found = F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.when(found != "", found)


def unit(x: Column) -> Column:
    """Between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def classification(reply: Column) -> Column:
    """Struct (memory_type, confidence); null if the type is none of the known ones."""
    j = F.from_json(json_of(reply), "memory_type string, type string, confidence double")
    kind = F.upper(F.coalesce(j["memory_type"], j["type"]))
    return F.when(kind.isin(TYPES), F.struct(kind.alias("memory_type"), F.round(unit(F.coalesce(j["confidence"], F.lit(0.5))), 4).alias("confidence")))


def facts(reply: Column) -> Column:
    """Array of (subject, predicate, object_value, confidence); those without predicate or object are left out, an
    empty subject is the user."""
    j = F.from_json(json_of(reply), "array<struct<subject:string,predicate:string,object:string,confidence:double>>")
    kept = F.filter(F.coalesce(j, F.array()), lambda f: (F.coalesce(F.trim(f["predicate"]), F.lit("")) != "") & (F.coalesce(F.trim(f["object"]), F.lit("")) != ""))
    subject = lambda f: F.when(F.coalesce(F.trim(f["subject"]), F.lit("")) != "", F.trim(f["subject"])).otherwise("user")
    return F.transform(kept, lambda f: F.struct(subject(f).alias("subject"), F.lower(F.trim(f["predicate"])).alias("predicate"), F.trim(f["object"]).alias("object_value"), unit(F.coalesce(f["confidence"], F.lit(0.7))).alias("confidence")))


def mentions(reply: Column) -> Column:
    """Array of (name, entity_type), each name once, its first type; blank names are left out, an empty type is a concept."""
    j = F.from_json(json_of(reply), "array<struct<name:string,type:string>>")
    named = F.filter(F.coalesce(j, F.array()), lambda m: F.coalesce(F.trim(m["name"]), F.lit("")) != "")
    clean = F.transform(named, lambda m: F.struct(F.trim(m["name"]).alias("name"), F.lower(F.coalesce(m["type"], F.lit("concept"))).alias("entity_type")))
    low = F.transform(clean, lambda m: F.lower(m["name"]))
    return F.filter(clean, lambda m, i: F.array_position(low, F.lower(m["name"])) == i + 1)


def strings(reply: Column) -> Column:
    """A JSON list as strings: texts as they are, objects by their name, value, entity or text, all else as written."""
    items = F.coalesce(F.from_json(json_of(reply), "array<string>"), F.array().cast("array<string>"))

    def one(x: Column) -> Column:
        named = F.coalesce(*[F.get_json_object(x, f"$.{k}") for k in ("name", "value", "entity", "text")])
        return F.when(x.startswith("{"), F.coalesce(named, x)).otherwise(x)

    return F.filter(F.transform(items, one), lambda x: x.isNotNull())


def intent(reply: Column) -> Column:
    """Struct (intent, confidence); null if the intent is none of the known ones."""
    j = F.from_json(json_of(reply), "intent string, intent_type string, confidence double")
    kind = F.upper(F.coalesce(j["intent"], j["intent_type"]))
    return F.when(kind.isin(list(V.WEIGHTS)), F.struct(kind.alias("intent"), unit(F.coalesce(j["confidence"], F.lit(0.5))).alias("confidence")))


def claim(reply: Column) -> Column:
    """What a model took from an answer; null where it says that there is no clear one."""
    bare = F.trim(F.regexp_replace(reply, r"(?i)^\s*(?:extracted\s+)?answer\s*:\s*", ""))
    return F.when((bare != "") & ~F.upper(F.regexp_replace(bare, r"[\s.]+", "_")).rlike("^_*NO_CLEAR_ANSWER_*$"), bare)


def yes(reply: Column) -> Column:
    """Whether a judge's reply begins with yes or pass (true), no or fail (false); null for anything else."""
    word = F.lower(F.regexp_extract(reply, r"^\W*(\w+)", 1))
    return F.when(word.isin("yes", "pass", "true", "correct"), True).when(word.isin("no", "fail", "false", "incorrect"), False)


def first_of(said: Column, ruled: Column, least: float = 0.6) -> Column:
    """What the model said if it is sure enough, else what the rules say."""
    return F.when(said.isNotNull() & (said["confidence"] >= least), said).otherwise(ruled)
