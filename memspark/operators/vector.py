"""Exact cosine search: a stated set of queries, in blocks, against all vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries broadcast at once: the proven bound of what every task holds.
BLOCK = 4096


def _blocks(rows: DataFrame) -> Iterator[list[tuple]]:
    """The rows in blocks of at most ``BLOCK``, one at a time on the driver; one empty block without any."""
    block: list[tuple] = []
    some = False
    for r in rows.toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == BLOCK:
            yield block
            block, some = [], True
    if block or not some:
        yield block


def knn(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, neighbour_id, score, rank): the k nearest rows by cosine for each query, itself left out.

    Queries are read in blocks of at most ``BLOCK``; a task keeps k candidates per query and batch, so what is
    shuffled is bounded by queries, k and batches. Null or zero vectors have no neighbours; ties go to smaller ids."""
    spark = vectors.sparkSession
    parts = []
    for b in _blocks(queries.select(key, column).filter(F.col(column).isNotNull())):
        held = spark.sparkContext.broadcast((np.array([i for i, _ in b], np.int64), np.array([v for _, v in b], np.float64)))

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, q = held.value
            if not len(ids):
                return
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            for batch in batches:
                own = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if v]
                if not own:
                    continue
                keys, m = np.array([i for i, _ in own], np.int64), np.array([v for _, v in own], np.float64)
                norm = np.linalg.norm(m, axis=1)
                keys, m = keys[norm > 0], m[norm > 0] / norm[norm > 0, None]
                s = q @ m.T
                s[ids[:, None] == keys[None, :]] = -2
                out = [[], [], []]
                for r in range(len(ids)):
                    row = s[r]
                    # only what reaches the k-th score is put in order
                    near = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k]) if len(row) > k else np.arange(len(row))
                    top = near[np.lexsort((keys[near], -row[near]))[:k]]
                    top = top[s[r][top] > -1.5]
                    out[0].append(np.full(len(top), ids[r]))
                    out[1].append(keys[top])
                    out[2].append(s[r][top])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query_id", "neighbour_id", "score"])

        parts.append(vectors.select(key, column).mapInArrow(search, "query_id bigint, neighbour_id bigint, score double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbour_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
