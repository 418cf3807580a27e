"""Keyed state over streams: the registry of mentioned names, and blocks' accesses with decay by event time."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Time without a mention or an access after which a key's state is dropped (and, of a block, its fall is told).
REGISTRY_DAYS, BLOCK_DAYS = 365, 30

REGISTRY = "entity_type string, name string, reference_count bigint, first_seen timestamp, last_seen timestamp"


def _us(times: pd.Series) -> pd.Series:
    return pd.to_datetime(times, utc=True).astype("datetime64[us, UTC]").astype("int64")


def _time(us: int) -> datetime:
    return datetime.fromtimestamp(us / 1e6, timezone.utc).replace(tzinfo=None)


def registry(mentions: DataFrame, lateness: str = "7 days", keep_days: int = REGISTRY_DAYS) -> DataFrame:
    """Stream of mentions (surface_form, entity_type, seen_at) -> rows of the registry, one for each key and batch.

    The first mention of a name (by lower case and type) creates its row, every other one links to it: the count grows
    and the times widen, in whatever order mentions come. Null names and times are dropped; a null type is ``unknown``.
    The state of a key is one small row; a hot name's mentions are read in portions. State ends ``keep_days`` after the last mention."""
    clean = mentions.filter("surface_form IS NOT NULL AND seen_at IS NOT NULL").withWatermark("seen_at", lateness)
    keyed = clean.select(F.coalesce("entity_type", F.lit("unknown")).alias("entity_type"), F.lower(F.trim("surface_form")).alias("name"), "seen_at")

    def step(key: tuple[str, str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, first, last = state.get if state.exists else (0, None, None)
        for part in parts:
            at = _us(part["seen_at"])
            n += len(part)
            first, last = min(x for x in (first, int(at.min())) if x is not None), max(x for x in (last, int(at.max())) if x is not None)
        state.update((n, first, last))
        ends = int(last / 1000) + keep_days * 86_400_000
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"entity_type": [key[0]], "name": [key[1]], "reference_count": [n], "first_seen": [_time(first)], "last_seen": [_time(last)]})

    return keyed.groupBy("entity_type", "name").applyInPandasWithState(step, REGISTRY, "n bigint, first bigint, last bigint", "update", GroupStateTimeout.EventTimeTimeout)


ACCESS = "memory_id string, access_count bigint, last_accessed_at timestamp, tier string"


def accesses(turns: DataFrame, lateness: str = "1 day", idle_days: int = BLOCK_DAYS) -> DataFrame:
    """Stream of turns (paged_in_ids, logged_at) -> blocks' access counts and tiers.

    An access brings a block to the second tier and is counted; without one for ``idle_days`` of event time the block
    falls to the third and its state ends. Null ids and times are dropped; other columns are ignored."""
    each = turns.filter("logged_at IS NOT NULL").withWatermark("logged_at", lateness).select("logged_at", F.explode("paged_in_ids").alias("i"))
    keyed = each.select(F.lower(F.trim("i")).alias("memory_id"), "logged_at").filter("memory_id <> ''")

    def step(key: tuple[str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, 0)
        tier = "L2_ACTIVE_RAM"
        if state.hasTimedOut:
            state.remove()
            tier = "L3_VIRTUAL_SWAP"
        else:
            for part in parts:
                n, last = n + len(part), max(last, int(_us(part["logged_at"]).max()))
            state.update((n, last))
            state.setTimeoutTimestamp(max(int(last / 1000) + timedelta(days=idle_days) // timedelta(milliseconds=1), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"memory_id": [key[0]], "access_count": [n], "last_accessed_at": [_time(last)], "tier": [tier]})

    return keyed.groupBy("memory_id").applyInPandasWithState(step, ACCESS, "n bigint, last bigint", "update", GroupStateTimeout.EventTimeTimeout)
