"""Keyed state over streams against the same fold in one go."""

from datetime import datetime, timedelta

from memspark.streaming import state as S

DAY = datetime(2024, 1, 1)


def run(spark, tmp_path, batches, schema, operator, name):
    """Rows that the operator gives for the batches, in order."""
    source = tmp_path / name
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / f"b{k}"))
    got = []
    stream = operator(spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(source)))
    query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / f"{name}-state")).foreachBatch(lambda df, k: got.extend((k, *r) for r in df.collect())).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return got


def test_registry(spark, tmp_path):
    batches = [
        [("Kettle", "device", DAY), (" kettle", "device", DAY - timedelta(days=1)), (None, "device", DAY), ("Kettle", None, DAY)],
        [("KETTLE", "device", DAY + timedelta(days=2)), ("Lamp", "device", None)],
        [("Ann", "person", DAY + timedelta(days=900))],
        [("Ann", "person", DAY + timedelta(days=901))],
        [("Kettle", "device", DAY + timedelta(days=902))],
    ]
    got = run(spark, tmp_path, batches, "surface_form string, entity_type string, seen_at timestamp", S.registry, "registry")
    last = {}
    for _, kind, name, n, first, seen in got:
        last.setdefault((kind, name), []).append((n, first, seen))
    assert max(n for n, _, _ in last["device", "kettle"]) == 3 and last["unknown", "kettle"][0][0] == 1
    assert (3, DAY - timedelta(days=1), DAY + timedelta(days=2)) in last["device", "kettle"]
    # the state has ended, so the name is created anew
    assert last["device", "kettle"][-1] == (1, DAY + timedelta(days=902), DAY + timedelta(days=902))
    assert [n for n, _, _ in last["person", "ann"]] == [1, 2] and ("device", "lamp") not in last


def test_accesses(spark, tmp_path):
    batches = [[(["B1", " b1", None, "b2"], DAY), (None, DAY)], [(["b2"], DAY + timedelta(days=5))], [(["b3"], DAY + timedelta(days=100))], [(["b3"], DAY + timedelta(days=101))]]
    got = run(spark, tmp_path, batches, "paged_in_ids array<string>, logged_at timestamp", S.accesses, "accesses")
    of = lambda i: [(n, tier) for _, key, n, _, tier in got if key == i]
    assert of("b1")[0] == (2, "L2_ACTIVE_RAM") and of("b1")[-1] == (2, "L3_VIRTUAL_SWAP")
    assert (2, "L2_ACTIVE_RAM") in of("b2") and of("b2")[-1] == (2, "L3_VIRTUAL_SWAP") and of("b3")[-1] == (2, "L2_ACTIVE_RAM")


def test_empty_streams(spark, tmp_path):
    assert run(spark, tmp_path, [[]], "paged_in_ids array<string>, logged_at timestamp", S.accesses, "none") == []
