"""Queries of captures: the admission machine, which SQL follows step by step, and files, which tests check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.sinks.recorder import sealed_traces
from turnledger.session import table
from turnledger.streaming.admission import EVENTS, replayed


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """Every generation record as a request and its response at once, and each trace's end with the owner's count of
    requests, too high for traces of an even number. Some requests stream, carry a foreign bearer or name another
    session, some handlers fail, by remainders of the sequence, in traces whose name's length is a multiple of four."""
    made = table(spark, folder, "trace").where(F.col("record_type") == "generation").dropDuplicates(["trace_id", "sequence"])
    n = F.col("sequence")
    hit = lambda k, r: (n % k == r) & (F.length("trace_id") % 4 == 0)
    some = lambda k, r, yes, no: F.when(hit(k, r), yes).otherwise(no)
    none = F.lit(None)
    request = {
        "event_no": 2 * n, "kind": F.lit("request"), "request_id": n.cast("string"), **{c: F.col(c) for c in ("session_id", "branch_id", "turn_id", "parent_turn_id")}, "metadata_session": some(41, 7, F.lit("other"), F.col("session_id")),
        "contract_mode": F.col("contract.mode"), "streaming": hit(37, 5), "bearer": some(43, 6, F.lit("else"), none),
    }
    response = {
        "event_no": 2 * n + 1, "kind": F.lit("response"), "request_id": n.cast("string"), "status": F.when(hit(31, 4), none).when(hit(29, 3), 500).otherwise(200), "calls": some(23, 2, 2, 1), "captured": F.lit(1),
        "input_ids": F.col("input_ids"), "output_ids": F.col("output_ids"),
    }
    end = made.groupBy("trace_id").agg(F.max("sequence").alias("last"), F.count("*").alias("n"))
    finish = {"event_no": 2 * F.col("last") + 2, "kind": F.lit("finish"), "expected": F.col("n") + (F.col("n") % 2 == 0).cast("int")}
    kinds = dict(c.split(" ", 1) for c in EVENTS.split(", "))
    row = lambda df, own: df.select(*({"trace_id": F.col("trace_id"), **own}.get(c, none).cast(t).alias(c) for c, t in kinds.items()))
    return row(made, request).unionByName(row(made, response)).unionByName(row(end, finish))


def admission_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """What became of every event of a live capture of the trace table."""
    return replayed(_events(spark, folder)).select("trace_id", "event_no", "record_type", "reason", "reply", "sequence", "expected_generations", "generations", "capture_gaps")


def capture_admission(spark: SparkSession, folder: str) -> DataFrame:
    return replayed(_events(spark, folder)).groupBy("record_type", "reason", "reply").agg(F.count("*").alias("n"))


def sealed_files(spark: SparkSession, folder: str) -> DataFrame:
    """The trace table as files, one per trace, with their digests and sizes."""
    df = sealed_traces(table(spark, folder, "trace"))
    return df.select("trace_id", F.octet_length("content").alias("bytes"), "sha256", "error")


QUERIES = {"capture_admission": capture_admission, "admission_outcomes": admission_outcomes, "sealed_files": sealed_files}

# one record of every trace a step; the state is what was admitted and what was completed
_WALK = r"""
g AS (SELECT DISTINCT ON (trace_id, sequence) *, CASE WHEN length(trace_id) % 4 = 0 THEN sequence ELSE 0 END AS d FROM trace WHERE record_type = 'generation'),
q AS (SELECT trace_id, sequence AS n, row_number() OVER (PARTITION BY trace_id ORDER BY sequence) AS i, to_json([session_id, branch_id, turn_id]) AS k, CASE WHEN parent_turn_id IS NOT NULL THEN to_json([session_id, branch_id, parent_turn_id]) END AS p,
  CASE WHEN NOT coalesce(regexp_full_match(session_id, '[A-Za-z0-9_.-]{1,128}') AND regexp_full_match(branch_id, '[A-Za-z0-9_.-]{1,128}') AND regexp_full_match(turn_id, '[A-Za-z0-9_.-]{1,128}'), false)
      OR NOT coalesce(regexp_full_match(parent_turn_id, '[A-Za-z0-9_.-]{1,128}'), true) OR (d % 41 = 7 AND session_id IS DISTINCT FROM 'other') OR coalesce(parent_turn_id = turn_id, false)
      OR NOT coalesce(contract.mode IN ('unknown', 'append_only', 'history_rewrite'), true) THEN 'http_context_invalid'
    WHEN d % 37 = 5 THEN 'http_stream_unsupported' WHEN d % 43 = 6 AND session_id <> 'else' THEN 'http_session_auth_mismatch' END AS refused,
  CASE WHEN d % 31 = 4 THEN 'http_handler_failed_or_cancelled' WHEN d % 29 = 3 THEN 'http_unsuccessful_response'
    WHEN input_ids IS NULL OR len(list_filter(input_ids, lambda v: v IS NULL)) > 0 OR coalesce(len(output_ids), 0) = 0 OR len(list_filter(output_ids, lambda v: v IS NULL OR v < 0)) > 0 THEN 'turn_record_capture_failed'
    WHEN d % 23 = 2 THEN 'http_callback_coverage_mismatch' ELSE 'generation' END AS outcome FROM g),
w AS (
  SELECT trace_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS what, [] :: VARCHAR[] AS admitted, [] :: VARCHAR[] AS done FROM q GROUP BY trace_id
  UNION ALL
  SELECT trace_id, i, n, what, CASE WHEN open_ THEN list_append(admitted, k) ELSE admitted END, CASE WHEN open_ AND what = 'generation' THEN list_append(done, k) ELSE done END
  FROM (SELECT *, CASE WHEN open_ THEN outcome WHEN refused IS NOT NULL THEN refused WHEN list_contains(admitted, k) THEN 'http_duplicate_turn' ELSE 'http_parent_not_completed' END AS what
    FROM (SELECT q.*, w.admitted, w.done, refused IS NULL AND NOT list_contains(admitted, k) AND (p IS NULL OR list_contains(done, p)) AS open_ FROM w JOIN q ON q.trace_id = w.trace_id AND q.i = w.i + 1))),
o AS (SELECT trace_id, n, what, what IN ('http_context_invalid', 'http_stream_unsupported', 'http_session_auth_mismatch', 'http_duplicate_turn', 'http_parent_not_completed') AS early FROM w WHERE i > 0),
t AS (SELECT trace_id, max(n) AS last, count(*) AS n, count(*) FILTER (what = 'generation') AS made, count(*) FILTER (what <> 'generation') AS gaps, count(*) FILTER (NOT early AND what NOT IN ('http_handler_failed_or_cancelled', 'http_unsuccessful_response')) AS succeeded FROM o GROUP BY trace_id),
r AS (
  SELECT trace_id, CASE WHEN early THEN 2 * n ELSE 2 * n + 1 END AS event_no, CASE WHEN what = 'generation' THEN 'generation' ELSE 'capture_gap' END AS record_type, CASE WHEN what <> 'generation' THEN what END AS reason,
    CASE WHEN what IN ('http_duplicate_turn', 'http_parent_not_completed') THEN 409 WHEN early THEN 422 WHEN what = 'http_handler_failed_or_cancelled' THEN NULL WHEN what = 'http_unsuccessful_response' THEN 500 ELSE 200 END AS reply,
    NULL::BIGINT AS expected_generations, NULL::BIGINT AS generations, NULL::BIGINT AS capture_gaps FROM o
  UNION ALL SELECT trace_id, 2 * last + 2, 'capture_gap', 'http_request_count_mismatch', NULL, NULL, NULL, NULL FROM t WHERE n % 2 = 0
  UNION ALL SELECT trace_id, 2 * last + 2, 'capture_complete', NULL, NULL, succeeded, made, gaps FROM t WHERE n % 2 <> 0 AND gaps = 0),
x AS (SELECT trace_id, event_no, record_type, reason, reply, row_number() OVER (PARTITION BY trace_id ORDER BY event_no) - 1 AS sequence, expected_generations, generations, capture_gaps FROM r
  UNION ALL SELECT trace_id, 2 * last + 2, 'refused', 'capture_incomplete', NULL, NULL, NULL, NULL, NULL FROM t WHERE n % 2 = 0 OR gaps > 0
  UNION ALL SELECT trace_id, 2 * n + 1, 'refused', 'response_unknown', NULL, NULL, NULL, NULL, NULL FROM o WHERE early)
"""
ORACLE: dict[str, str] = {
    "admission_outcomes": f"WITH RECURSIVE {_WALK} SELECT * FROM x",
    "capture_admission": f"WITH RECURSIVE {_WALK} SELECT record_type, reason, reply, count(*) AS n FROM x GROUP BY ALL",
}
