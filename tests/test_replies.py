"""Replies of models as columns."""

import pytest
from pyspark.sql import functions as F

from memspark.operators import replies as R


def value(spark, text, f):
    row = spark.createDataFrame([(text,)], "r string").select(f(F.col("r")).alias("v")).first()
    return row["v"]


@pytest.mark.parametrize("text, want", [('```json\n{"type": "event", "confidence": 3}\n```', ("EVENT", 1.0)), ('Sure! {"memory_type": "USER_FACT"} ok', ("USER_FACT", 0.5)), ('{"type": "POEM"}', None), ("no json", None), ("", None), (None, None), ('{"type": ', None)])
def test_classification(spark, text, want):
    got = value(spark, text, R.classification)
    assert (got and tuple(got)) == want


def test_facts(spark):
    got = value(spark, 'Here: [{"subject": "", "predicate": " Bought ", "object": "lamp"}, {"predicate": "", "object": "x"}, {"subject": "Ann", "predicate": "likes", "object": "tea", "confidence": -1}]', R.facts)
    assert [tuple(f) for f in got] == [("user", "bought", "lamp", 0.7), ("Ann", "likes", "tea", 0.0)]
    assert value(spark, None, R.facts) == [] and value(spark, "[", R.facts) == []


def test_mentions_and_strings(spark):
    got = value(spark, '[{"name": "Lamp", "type": "Device"}, {"name": "lamp", "type": "x"}, {"name": " "}, {"name": "Ann"}]', R.mentions)
    assert [tuple(m) for m in got] == [("Lamp", "device"), ("Ann", "concept")]
    assert value(spark, '["a", {"name": "b"}, {"value": "c"}, {"k": 1}, 7, null]', R.strings) == ["a", "b", "c", '{"k":1}', "7"]
    assert value(spark, "nothing", R.strings) == []


def test_intent_claim_and_verdict(spark):
    assert tuple(value(spark, '{"intent_type": "temporal", "confidence": 0.8}', R.intent)) == ("TEMPORAL", 0.8) and value(spark, '{"intent": "x"}', R.intent) is None
    assert value(spark, "Answer: 7 days", R.claim) == "7 days" and value(spark, "NO CLEAR ANSWER.", R.claim) is None and value(spark, " ", R.claim) is None
    assert value(spark, "**Yes**, it is", R.yes) is True and value(spark, "no.", R.yes) is False and value(spark, "perhaps", R.yes) is None
    ruled = lambda r: R.first_of(R.intent(r), F.struct(F.lit("FACTUAL").alias("intent"), F.lit(0.45).alias("confidence")))["intent"]
    assert value(spark, '{"intent": "EVENT", "confidence": 0.9}', ruled) == "EVENT" and value(spark, '{"intent": "EVENT", "confidence": 0.2}', ruled) == "FACTUAL" and value(spark, None, ruled) == "FACTUAL"
