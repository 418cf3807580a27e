"""Sources and sinks besides tables."""

import json

import pytest
from pyspark.sql import functions as F

from memspark.sources import files as S


def test_instances(spark, tmp_path):
    data = [{"question": "q", "answer": "a", "question_type": "t", "haystack_sessions": [[{"role": "user", "content": "hi"}, {"content": " "}], [{"content": "bye", "x": 1}]]}, {"question": "none"}]
    (tmp_path / "d.json").write_text(json.dumps(data))
    got = S.session_turns(S.read_instances(spark, str(tmp_path / "d.json")))
    assert sorted(map(tuple, got.collect())) == [("q", 0, 0, "user", "hi"), ("q", 1, 0, None, "bye")]


def test_reports_and_leaderboard(spark, tmp_path):
    runs = spark.createDataFrame([("a", 50.0, 1), ("b", 70.0, 2)], "run string, accuracy double, ended_at int")
    S.write_report(runs, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2
    S.write_leaderboard(runs, str(tmp_path / "board"))
    assert [r.run for r in spark.read.csv(str(tmp_path / "board"), header=True).collect()] == ["b", "a"]
    assert [r.run for r in S.pending(runs, runs.filter("run = 'a'")).collect()] == ["b"]
    assert [r.run for r in S.append_history(runs, runs.withColumn("run", F.concat("run", F.lit("2"))), 2).collect()] == ["b", "b2"]
    assert S.reports(spark, str(tmp_path / "report")).count() >= 1


def test_log_and_keys(spark, tmp_path):
    (tmp_path / "l.log").write_text("x\nQuestion 1/5\nQuestion 3/5\n")
    lines = S.log_lines(spark, str(tmp_path / "l.log")).withColumn("n", F.monotonically_increasing_id())
    assert tuple(S.progress(lines).first()) == (3, 5)
    df = spark.createDataFrame([(["a", "b"], "none"), (["a", "b"], "none"), (["b", "a"], "none")], "s array<string>, a string")
    keys = [r.k for r in df.select(S.ingestion_key(F.col("s"), F.col("a")).alias("k")).collect()]
    assert keys[0] == keys[1] != keys[2] and len(keys[0]) == 16


def test_resolve(tmp_path):
    (tmp_path / "x.json").write_text("[]")
    assert S.resolve("/abs/x") == "/abs/x" and S.resolve("x.json", str(tmp_path)) == str(tmp_path / "x.json")


@pytest.mark.parametrize("master, fails", [("local[1]", False), ("spark://far:7077", True)])
def test_checkpoint_folder_without_a_setting(spark, monkeypatch, master, fails):
    """A session that names no folder gets one where it is a single machine, and an error elsewhere."""
    from types import SimpleNamespace

    from memspark.session import checkpoint_dir

    class Held:
        def __init__(self):
            self.at = None

        def isDefined(self):
            return self.at is not None

        def get(self):
            return self.at

    held = Held()
    context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: held)), setCheckpointDir=lambda d: setattr(held, "at", d))
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=context)
    if fails:
        with pytest.raises(RuntimeError):
            checkpoint_dir(fake)
    else:
        assert checkpoint_dir(fake) == checkpoint_dir(fake) == held.at
    assert checkpoint_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: "s3://x"))) == "s3://x"
