"""Bounded samples of labelled rows for training on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

_PARTS = 1_000_000


def bounded(rows: DataFrame, key: str, most: int, seed: int, label: str | None = None) -> list[Row]:
    """At most ``most`` rows (for each label, if one is given), the first by the hash of ``key``.

    Groups are counted first; only rows whose hash lies under the share needed, with a margin, leave the executors,
    so what the driver gets does not grow with the table or its partitions. Labels must be few."""
    group = F.col(label) if label else F.lit("")
    rows = rows.withColumn("_g", group).withColumn("_h", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(_PARTS)))
    counts = {r["_g"]: r["count"] for r in rows.groupBy("_g").count().limit(1000).collect()}
    if not counts:
        return []
    want = F.lit(0)
    for g, n in counts.items():
        want = F.when(F.col("_g") == g, F.lit(min(_PARTS, int(_PARTS * (1.5 * most + 20) / n) + 1))).otherwise(want)
    got = rows.filter(F.col("_h") < want).limit(3 * (most + 20) * len(counts)).collect()
    out: list[Row] = []
    for g in sorted(counts):
        out += sorted((r for r in got if r["_g"] == g), key=lambda r: (r["_h"], r[key]))[:most]
    return out
