"""Queries over the parent-child links of trace records, and the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.operators.hierarchy import hierarchies
from turnledger.operators.orphans import orphan_counts, orphan_references
from turnledger.session import table

SCOPE = ("trace_id", "session_id", "branch_id")


def generations(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "trace").where(F.col("record_type") == "generation").select(*columns)


def _orphans(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    rows = generations(spark, folder, *SCOPE, "turn_id", "parent_turn_id", "sequence", *keep)
    return orphan_references(
        rows, rows, scope=SCOPE, parent_key="turn_id", child_key="parent_turn_id", parent_order="sequence", child_order="sequence", keep=keep
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("trace_id", "sequence").distinct()


def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    found = _orphans(spark, folder, "captured_at").withColumn("missing", F.struct("session_id", "branch_id", "parent_turn_id"))
    counts = orphan_counts(found, table=F.col("trace_id"), key="missing", period=F.to_date("captured_at"))
    return counts.select(F.col("table_name").alias("trace_id"), F.col("period").alias("capture_day"), "n_orphans", "n_missing_keys")


def _turns(spark: SparkSession, folder: str, lists: bool) -> DataFrame:
    rows = generations(spark, folder, *SCOPE, "turn_id", "parent_turn_id", "sequence")
    return hierarchies(rows, scope=SCOPE, node="turn_id", parent="parent_turn_id", order="sequence", lists=lists)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _turns(spark, folder, False)


def p4_lineage(spark: SparkSession, folder: str) -> DataFrame:
    return _turns(spark, folder, True).select(
        *SCOPE, "turn_id", "root_turn_id", "depth",
        F.array_join("path", " ").alias("path"), F.array_join("descendants", " ").alias("descendants"), F.size("descendants").cast("bigint").alias("n_descendants"),
    )


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p4_found": p4_found, "p4_lineage": p4_lineage}

_G = "SELECT DISTINCT trace_id, session_id, branch_id, turn_id, parent_turn_id, sequence, captured_at FROM trace WHERE record_type = 'generation'"
_ORPHANS = f"""
g AS ({_G}),
o AS (
  SELECT c.* FROM g c
  WHERE c.parent_turn_id IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM g p WHERE p.trace_id IS NOT DISTINCT FROM c.trace_id AND p.session_id IS NOT DISTINCT FROM c.session_id
      AND p.branch_id IS NOT DISTINCT FROM c.branch_id AND p.turn_id = c.parent_turn_id AND p.sequence < c.sequence))
"""
_TREES = f"""
g AS ({_G}),
n AS (
  SELECT trace_id, session_id, branch_id, turn_id, arg_min(struct_pack(p := parent_turn_id), sequence).p AS parent_turn_id
  FROM g WHERE turn_id IS NOT NULL GROUP BY trace_id, session_id, branch_id, turn_id),
e AS (
  SELECT c.*, p.turn_id AS up FROM n c LEFT JOIN n p ON p.trace_id IS NOT DISTINCT FROM c.trace_id
    AND p.session_id IS NOT DISTINCT FROM c.session_id AND p.branch_id IS NOT DISTINCT FROM c.branch_id AND p.turn_id = c.parent_turn_id),
walk AS (
  SELECT trace_id, session_id, branch_id, turn_id, turn_id AS stand, up, [turn_id] AS way FROM e
  UNION ALL
  SELECT w.trace_id, w.session_id, w.branch_id, w.turn_id, e.turn_id, e.up, list_append(w.way, e.turn_id)
  FROM walk w JOIN e ON e.trace_id IS NOT DISTINCT FROM w.trace_id AND e.session_id IS NOT DISTINCT FROM w.session_id
    AND e.branch_id IS NOT DISTINCT FROM w.branch_id AND e.turn_id = w.up
  WHERE NOT list_contains(w.way, w.up)),
t AS (
  SELECT trace_id, session_id, branch_id, turn_id, stand AS root_turn_id, CAST(len(way) - 1 AS INTEGER) AS depth, list_reverse(way) AS way
  FROM walk WHERE up IS NULL
  UNION ALL
  SELECT trace_id, session_id, branch_id, turn_id, list_min(way[list_position(way, up):]), -1, NULL FROM walk WHERE up IS NOT NULL AND list_contains(way, up))
"""
ORACLE = {
    "p1_found": f"WITH {_ORPHANS} SELECT DISTINCT trace_id, sequence FROM o",
    "p1_counts": f"""WITH {_ORPHANS}
SELECT trace_id, CAST(captured_at AS DATE) AS capture_day, count(*) AS n_orphans, count(DISTINCT (session_id, branch_id, parent_turn_id)) AS n_missing_keys
FROM (SELECT DISTINCT trace_id, session_id, branch_id, parent_turn_id, sequence, captured_at FROM o) GROUP BY 1, 2""",
    "p4_found": f"WITH RECURSIVE {_TREES} SELECT trace_id, session_id, branch_id, turn_id, root_turn_id, depth FROM t",
    "p4_lineage": f"""WITH RECURSIVE {_TREES},
d AS (
  SELECT trace_id, session_id, branch_id, a AS turn_id, string_agg(turn_id, ' ' ORDER BY turn_id) AS descendants, count(*) AS n_descendants
  FROM (SELECT *, unnest(way[1:depth]) AS a FROM t WHERE depth > 0) GROUP BY 1, 2, 3, 4)
SELECT t.trace_id, t.session_id, t.branch_id, t.turn_id, t.root_turn_id, t.depth, array_to_string(t.way, ' ') AS path,
  CASE WHEN t.depth >= 0 THEN coalesce(d.descendants, '') END AS descendants,
  CASE WHEN t.depth >= 0 THEN coalesce(d.n_descendants, 0) END AS n_descendants
FROM t LEFT JOIN d ON d.trace_id IS NOT DISTINCT FROM t.trace_id AND d.session_id IS NOT DISTINCT FROM t.session_id
  AND d.branch_id IS NOT DISTINCT FROM t.branch_id AND d.turn_id = t.turn_id""",
}
