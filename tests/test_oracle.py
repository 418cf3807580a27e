"""Every query with SQL gives the rows of the SQL on the same tables."""

from collections import Counter

import pandas as pd
import pytest

import __spark_entry__ as entry

SQL = {k: v for k, v in entry.oracle_sql().items()}


def cells(df: pd.DataFrame) -> Counter:
    def one(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return None
        if isinstance(v, float):
            return format(v, ".9g")
        return str(v)

    df = df[sorted(df.columns)]
    return Counter(tuple(one(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, sf, name):
    ours = entry.queries()[name](spark, sf).toPandas()
    theirs = duck.execute(SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert cells(ours) == cells(theirs)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["session_id", "intent", "id", "score", "rank"]
    assert df.count() > 0


@pytest.mark.parametrize("name", ["clean_response", "rank_reasoning", "replay_keys"])
def test_without_sql(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_events_of_every_entity(spark, sf, duck):
    """Every entity with a link to an event comes out, whatever its type."""
    q = entry.queries()
    want = duck.execute("SELECT count(DISTINCT entity_id) FROM entity_event_map WHERE lower(trim(event_id)) IN (SELECT lower(trim(id)) FROM timeline_events)").fetchone()[0]
    assert q["events_for_every_entity"](spark, sf).select("entity_id").distinct().count() == want
    assert q["events_for_entity"](spark, sf).select("entity_id").distinct().count() < want
    assert {r[0] for r in q["events_for_every_entity"](spark, sf).select("event_id").collect()} == {r[0] for r in q["events_union_every"](spark, sf).select("event_id").collect()}


def test_facts_of_stored_texts(spark, tmp_path):
    text = "Es war schön.\nI bought a lamp in May 2021.\nBut " + "long " * 3000 + "\nI live in Berlin."
    spark.createDataFrame([("b1", text)], "id string, content string").write.parquet(str(tmp_path / "memory_blocks.parquet"))
    spark.createDataFrame([(7, "Hello\nI work at Zabok."), (8, None)], "turn_id bigint, user_message string").write.parquet(str(tmp_path / "turns.parquet"))
    got = {(r.src_table, r.memory_id, r.predicate, r.object_value) for r in entry.queries()["fact_extract_stored"](spark, str(tmp_path)).collect()}
    assert got == {("memory_blocks", "b1", "purchased", "lamp"), ("memory_blocks", "b1", "lives_in", "Berlin"), ("turns", "7", "works_at", "Zabok")}


def test_duplicates_that_share_no_rarest_word(spark, tmp_path):
    names = {"g2": "Galaxy S2", "g22": "Galaxy S22", "w1": "a1 b c d e f g", "w2": "a2 b c d e f g", "p": "Ann", "q": "Annabel Lee", "s": "An"}
    rows = [(i, n, "device", True) for i, n in names.items()] + [(f"x{i}", f"Galaxy {w} b c d e f g", "device", False) for i, w in enumerate("klmn")]
    spark.createDataFrame(rows, "id string, name string, entity_type string, needs_review boolean").write.parquet(str(tmp_path / "entities.parquet"))
    q = entry.queries()
    shared = {("g2", "g22"), ("w1", "w2")}
    got = {(r.left_id, r.right_id) for r in q["duplicate_entities"](spark, str(tmp_path)).collect() if not r.right_id.startswith("x") and r.left_id < r.right_id}
    assert got == shared
    got = {(r.left_id, r.right_id) for r in q["duplicate_entities_every"](spark, str(tmp_path)).collect() if not r.right_id.startswith("x") and r.left_id < r.right_id}
    assert got == shared | {("p", "q"), ("p", "s"), ("q", "s")}


def test_timelines_are_not_written_twice(spark, tmp_path, monkeypatch):
    """Rows of each question and memory are the result alone: tables written on the way hold far fewer."""
    monkeypatch.setattr("memspark.session.checkpoint_dir", lambda _: str(tmp_path))
    rows = entry.queries()["temporal_retrieve"](spark, "/root/testdata/sf0.01").count()
    written = [spark.read.parquet(str(p)).count() for p in tmp_path.iterdir()]
    assert written and max(written) < rows / 5
