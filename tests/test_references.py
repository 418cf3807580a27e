"""Dangling references against brute force, with every kind of awkward row."""

import datetime as dt
import random

import pytest

from memspark.operators import references as R

T = dt.datetime
REFS = "ref_table string, ref_field string, row_id string, target string, parent_table string, seen timestamp, period string, more int"
PARENTS = "parent_table string, id string, born timestamp, n int"
GONE = "parent_table string, id string"


def run(spark, refs, parents, gone):
    out = R.dangling(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), spark.createDataFrame(gone, GONE)).collect()
    return sorted((r.ref_table, r.row_id, r.target_id, r.kind) for r in out)


def expected(refs, parents, gone):
    norm = lambda s: s.strip(" \t\n\r\x0b\x0c ").lower()
    born = {}
    for table, key, at, _ in parents:
        if key is not None and norm(key):
            k = (table, norm(key))
            born[k] = min([x for x in (born.get(k), at) if x is not None], default=None)
    dead = {(t, norm(k)) for t, k in gone if k is not None}
    out = set()
    for table, _, row, target, parent, seen, _, _ in refs:
        if target is None or not norm(target):
            continue
        k = (parent, norm(target))
        if k not in born:
            out.add((table, row, norm(target), "deleted" if k in dead else "missing"))
        elif seen is not None and born[k] is not None and born[k] > seen:
            out.add((table, row, norm(target), "late"))
    return sorted(out)


def test_brute_force(spark):
    rng = random.Random(3)
    keys = [f"mem_{i:04x}" for i in range(40, 2100)] + [f"mem_{rng.getrandbits(64):016x}" for _ in range(300)] + ["mem_ffffffffffffffff", "mem_0000000000000000", "odd key", "é-1", "MEM_00AB"]
    kept = [k for k in keys if rng.random() < 0.7]
    parents = [("b", k if rng.random() < 0.9 else f" {k.upper()}\t", rng.choice([None, T(2024, 1, 1), T(2024, 6, 1)]), 1) for k in kept for _ in range(rng.choice([1, 1, 2]))] + [("b", None, None, 1), ("b", "  ", None, 1), ("f", "mem_0033", None, 1)]
    gone = [("b", k) for k in keys if rng.random() < 0.2] + [("b", None)]
    refs = [("t", "f", f"r{i}", rng.choice([*keys, f"mem_{rng.getrandbits(20):x}", "", " ", None, "other"]), rng.choice(["b", "b", "b", "f"]), rng.choice([None, T(2024, 3, 1), T(2024, 9, 1)]), "p", i) for i in range(4000)]
    refs += refs[:50]
    assert run(spark, refs, parents, gone) == expected(refs, parents, gone)


def test_hot_key_is_salted(spark):
    refs = [("t", "f", f"r{i}", "mem_dead" if i % 3 else "mem_0001", "b", None, "p", 0) for i in range(36_000)]
    found = run(spark, refs, [("b", "mem_0001", None, 0)], [])
    assert len(found) == 24_000 and {f[3] for f in found} == {"missing"}


def test_empty_tables(spark):
    assert run(spark, [], [], []) == []
    assert run(spark, [("t", "f", "r", "x", "b", None, "p", 0)], [], []) == [("t", "r", "x", "missing")]
    assert run(spark, [], [("b", "x", None, 0)], [("b", "x")]) == []


def test_runs_compress_sequences(spark):
    rows = [("b", f"mem_{i:06x}", None, 0) for i in range(5000) if i != 777]
    parents = spark.createDataFrame(rows, PARENTS)
    table = R.runs(parents.withColumn("target_id", R.normalise(parents["id"]))).collect()
    assert sum(r["end"] - r["start"] + 1 for r in table) == 4999 and len(table) == 6


def test_long_keys(spark):
    long = "k" * 100_000
    assert run(spark, [("t", "f", "r", long, "b", None, "p", 0), ("t", "f", "s", long + "x", "b", None, "p", 0)], [("b", long, None, 0)], []) == [("t", "s", long + "x", "missing")]


@pytest.mark.parametrize("shape", ["mem_{:016x}", "doc-{:06d}", "{:d}", "123e4567-e89b-42d3-a456-{:012x}", "{:032x}", "Fact {:04x}"])
def test_sequential_keys_of_every_shape_are_few_runs(spark, shape):
    """Keys 2000 to 4999 without 3000: runs by block (of tens, where digits are decimal), and only what is absent dangles."""
    keys = [shape.format(i) for i in range(2000, 5000) if i != 3000]
    parents = spark.createDataFrame([("t", k, None) for k in keys], "parent_table string, target_id string, born timestamp").selectExpr("parent_table", "lower(target_id) AS target_id", "born")
    assert R.runs(parents).count() <= (310 if "d}" in shape else 12)
    refs = [("r", "f", str(i), shape.format(i).upper() + " ", "t", None, "unknown") for i in (1999, 2000, 3000, 4999, 5000)]
    got = R.dangling(
        spark.createDataFrame(refs, "ref_table string, ref_field string, row_id string, target string, parent_table string, seen timestamp, period string"),
        spark.createDataFrame([("t", k, None) for k in keys], "parent_table string, id string, born timestamp"),
        spark.createDataFrame([], "parent_table string, id string"),
    )
    assert {r.row_id for r in got.collect()} == {"1999", "3000", "5000"}
