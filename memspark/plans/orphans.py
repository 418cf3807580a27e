"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memspark.operators import references as R
from memspark.sources import load


def _links(spark: SparkSession, root: str) -> DataFrame:
    events = load(spark, root, "timeline_events")
    refs = R.memory_references(events, load(spark, root, "entity_event_map"), load(spark, root, "entities"))
    parents = R.memory_parents(load(spark, root, "memory_blocks"), load(spark, root, "structured_facts"), events)
    removed = load(spark, root, "removed_records").selectExpr("lower(trim(record_table)) AS parent_table", "record_id AS id")
    return R.dangling(refs, parents, removed)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return _links(spark, root).select("ref_table", "ref_field", "row_id", "target_id", "kind").distinct()


def p1_by_month(spark: SparkSession, root: str) -> DataFrame:
    return R.by_period(_links(spark, root))


QUERIES = {"p1_found": p1_found, "p1_by_month": p1_by_month}

_CTE = r"""
WITH refs AS (
  SELECT 'timeline_events' AS ref_table, 'memory_id' AS ref_field, id AS row_id, memory_id AS target, 'memory_blocks' AS parent_table, created_at AS seen, strftime(created_at, '%Y-%m') AS period FROM timeline_events
  UNION ALL SELECT 'timeline_events', 'fact_id', id, fact_id, 'structured_facts', NULL, strftime(created_at, '%Y-%m') FROM timeline_events
  UNION ALL SELECT 'entity_event_map', 'event_id', entity_id, event_id, 'timeline_events', NULL, NULL FROM entity_event_map
  UNION ALL SELECT 'entities', 'memory_ids', id, m, 'memory_blocks', NULL, strftime(first_seen, '%Y-%m') FROM (SELECT id, first_seen, unnest(memory_ids) AS m FROM entities)),
r AS (SELECT ref_table, ref_field, row_id, lower(trim(target, e' \t\n\r ')) AS target_id, parent_table, seen, coalesce(period, 'unknown') AS period FROM refs),
p AS (
  SELECT parent_table, lower(trim(id, e' \t\n\r ')) AS k, min(born) AS born FROM (
    SELECT 'memory_blocks' AS parent_table, id, created_at AS born FROM memory_blocks
    UNION ALL SELECT 'structured_facts', id, NULL FROM structured_facts
    UNION ALL SELECT 'timeline_events', id, NULL FROM timeline_events) GROUP BY 1, 2),
g AS (SELECT DISTINCT lower(trim(record_table)) AS parent_table, lower(trim(record_id, e' \t\n\r ')) AS k FROM removed_records),
found AS (
  SELECT DISTINCT ref_table, ref_field, row_id, target_id, period,
    CASE WHEN p.k IS NULL AND g.k IS NOT NULL THEN 'deleted' WHEN p.k IS NULL THEN 'missing' WHEN p.born > r.seen THEN 'late' END AS kind
  FROM r LEFT JOIN p ON p.parent_table = r.parent_table AND p.k = r.target_id
         LEFT JOIN g ON g.parent_table = r.parent_table AND g.k = r.target_id
  WHERE r.target_id <> '')
"""

SQL = {
    "p1_found": _CTE + "SELECT DISTINCT ref_table, ref_field, row_id, target_id, kind FROM found WHERE kind IS NOT NULL",
    "p1_by_month": _CTE
    + """SELECT ref_table, ref_field, period, kind, count(*)::BIGINT AS n_links, count(DISTINCT row_id)::BIGINT AS n_rows
FROM found WHERE kind IS NOT NULL GROUP BY 1, 2, 3, 4""",
}
