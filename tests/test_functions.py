"""Golden values of scalar functions and operators, and properties."""

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memspark.functions import scoring as S
from memspark.functions import temporal as T
from memspark.functions import text as X
from memspark.functions import vocab as V
from memspark.operators import extract as E
from memspark.operators import judge as J
from memspark.operators import store, vector
from memspark.operators.graph import components


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "importance, tag, n, age, want",
    [(8.0, "PROJECT_FACT", 1, 0.0, 8.0), (5.0, "SMALL_TALK", 1, 50.0, 5 * math.exp(-100)), (6.0, "EPISODIC", 1, 1.0, 2.695974), (6.0, "EPISODIC", 1, 2.0, 1.211379), (6.0, "EPISODIC", 2, 2.0, 2.695974)],
)
def test_priority(spark, importance, tag, n, age, want):
    assert value(spark, S.p_eff(F.lit(importance), F.lit(tag), F.lit(n), F.lit(age))) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(
    "raw, first, last, confidence, grain",
    [
        ("2024-01-05", "2024-01-05", "2024-01-05", 1.0, "exact"), ("January 2024", "2024-01-01", "2024-01-31", 0.7, "month"), ("in January 2024", "2024-01-01", "2024-01-31", 0.7, "month"), ("early 2024", "2024-01-01", "2024-04-30", 0.55, "year"),
        ("December", "2023-12-01", "2023-12-31", 0.5, "month"), ("yesterday", "2024-03-14 10:00:00", "2024-03-14 10:00:00", 0.95, "day"), ("last week", "2024-03-04 10:00:00", "2024-03-10 10:00:00", 0.75, "week"), ("last month", "2024-02-01", "2024-02-29", 0.75, "month"),
        ("2 weeks ago", "2024-02-24 10:00:00", "2024-03-01 10:00:00", 0.75, "week"), ("3 months ago", "2023-12-01", "2023-12-31", 0.7, "month"), ("recently", "2024-02-14 10:00:00", "2024-03-15 10:00:00", 0.4, "month"), ("a while ago", "2023-03-16 10:00:00", "2024-02-14 10:00:00", 0.25, "year"),
    ],
)
def test_dates_in_words(spark, raw, first, last, confidence, grain):
    b = value(spark, T.parse(F.lit(raw), F.lit("2024-03-15 10:00:00").cast("timestamp")))
    assert (b["earliest"], b["latest"]) == (dt.datetime.fromisoformat(first), dt.datetime.fromisoformat(last))
    assert (b["confidence"], b["granularity"]) == (confidence, grain)


@pytest.mark.parametrize("raw", ["", None, "no date", "2024-99-99"])
def test_no_date(spark, raw):
    b = value(spark, T.parse(F.lit(raw).cast("string"), F.lit("2024-03-15 10:00:00").cast("timestamp")))
    assert b is None or b["earliest"] is None


@pytest.mark.parametrize("hours, want", [(-36, 2), (36, 1), (0, 0)])
def test_gap_days(spark, hours, want):
    a, b = dt.datetime(2024, 1, 10) + dt.timedelta(hours=hours), dt.datetime(2024, 1, 10)
    assert value(spark, S.gap_days(F.lit(a), F.lit(b))) == want


@pytest.mark.parametrize("a, b, want", [("Galaxy S22", "Samsung Galaxy S22", 0.8), ("Dell XPS 13", "Dell XPS 15", 0.5), ("", "x", 0.0)])
def test_name_similarity(spark, a, b, want):
    assert value(spark, X.name_similarity(F.lit(a), F.lit(b))) == pytest.approx(want)


@pytest.mark.parametrize("text, source, want", [("thanks", "user", "too_short"), ("thank you", "user", "user_noise:acknowledgement"), ("I apologize for that", "assistant", "assistant_noise:assistant_apology"), (None, "user", "too_short"), ("x " * 50, "user", "repetition")])
def test_hygiene(spark, text, source, want):
    assert value(spark, E.hygiene(F.lit(text).cast("string"), F.lit(source)))["reason"] == want


def test_custom_pattern(spark):
    assert value(spark, E.hygiene(F.lit("the secret word here"), F.lit("user"), extra_user=("secret",)))["reason"] == "user_noise:custom"


def test_intent(spark):
    asked = spark.createDataFrame([("Which did I get first — Samsung or Dell?",), (None,), ("",)], "question string")
    got = E.with_intent(asked, "question").collect()[0]["intent"]
    assert (got["intent"], got["confidence"], got["secondary"]) == ("COMPARISON", 0.92, "TEMPORAL")
    assert value(spark, E.comparison_targets(F.lit("Which did I get first — Samsung or Dell?")))[1] == "Dell"


@pytest.mark.parametrize("expected, response, want", [("4 years and 9 months", "It was 4 years and 3 months", False), ("7 days. 8 days (including the last day) is also acceptable.", "About 8 days passed between them", True), ("Samsung", "8 days", None)])
def test_numeric_gate(spark, expected, response, want):
    assert value(spark, J.numeric_gate(F.lit(expected), F.lit(response))) is want


def test_substring(spark):
    assert value(spark, J.substring_match(F.lit("'Data Analysis using Python' webinar"), F.lit("Data Analysis using Python"))) is True


def test_facts(spark):
    df = spark.createDataFrame([("m", "I bought a Dell XPS 13 in January 2024."), ("n", None), ("e", "")], "memory_id string, text string")
    assert [(r.predicate, r.object_value) for r in E.facts(df).collect()] == [("purchased", "Dell XPS")]


def test_weights_sum_to_one():
    for mode in ("none", "no_intent", "no_keyword", "no_recency", "no_peff"):
        for w in S.ablated(mode).values():
            assert sum(w) == pytest.approx(1.0)
    assert set(V.FITTING) == set(V.WEIGHTS)


def test_upsert_is_idempotent(spark):
    schema = "id string, a int, b int"
    old, new = spark.createDataFrame([("x", 1, 1), ("y", 2, 2)], schema), spark.createDataFrame([("y", 9, 9), ("z", 3, 3)], schema)
    once = store.upsert(old, new, ["b"])
    want = [("x", 1, 1), ("y", 2, 9), ("z", 3, 3)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, store.upsert(once, new, ["b"]).collect())) == want


def test_sweep_is_idempotent(spark):
    from memspark.plans.blocks import as_of

    rows = [("a", "text of a block", None, "EPISODIC", t, 5.0, dt.datetime(2025, 5, d), 1) for t in ("L1_HOT_CACHE", "L2_ACTIVE_RAM", "L3_VIRTUAL_SWAP", "L4_ARCHIVE") for d in (1, 20, 31)]
    df = spark.createDataFrame(rows, "id string, content string, summary string, tag string, tier string, importance_score double, last_accessed_at timestamp, access_count int")
    once = store.sweep(df, as_of())
    kept = once.filter("new_tier <> 'DELETED'").drop("tier", "summary", "age_days", "p_eff").withColumnsRenamed({"new_tier": "tier", "new_summary": "summary"})
    again = store.sweep(kept, as_of())
    assert once.count() == 12 and again.filter("tier <> new_tier").count() == 0


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            ra, rb = sorted((find(a), find(b)))
            root[rb] = ra
    return {x: find(x) for x in root}


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(f"n{a:03d}", f"n{b:03d}") for a, b in rng.integers(0, 300, (220, 2))] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(40)] + [("x", None), (None, "y"), ("s", "s")]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == brute(edges)
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 8))
    v[5] = v[9]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 8)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in vector.knn(df, df.filter("vec_id % 100 = 0"), 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.neighbour_id)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (0, 100, 200):
        s = u @ u[q]
        s[q] = -9
        assert got[q] == np.lexsort((np.arange(300), -s))[:4].tolist()
    assert 900 not in got


@settings(max_examples=20, deadline=None)
@given(st.floats(0, 500), st.floats(0, 500), st.integers(1, 50))
def test_priority_falls_with_age_and_rises_with_use(a, b, n):
    f = lambda age, k: 5 * math.exp(-(0.08 / (k / 10)) * age)
    assert f(min(a, b), n) >= f(max(a, b), n) and f(a, n + 1) >= f(a, n)


def test_ingest_stream(spark, sf):
    from memspark.streaming import windows as W

    got = []
    W.ingest(W.read_table(spark, sf, "turns"), lambda df, n: got.append(df.count())).awaitTermination()
    assert sum(got) > 0
