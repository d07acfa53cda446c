"""Queries of the history contract over the trace table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.functions.arrays import joined
from turnledger.functions.scalars import is_alias
from turnledger.operators.contract import FOLLOWING, PREVIOUS, PRIORITY
from turnledger.operators.rules import EVIDENCE, MODES, ORIGINS, POLICIES, VERSION
from turnledger.operators.traces import KEY, record_error, trace_errors, trace_reports, verdicts
from turnledger.session import table


def _trace(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "trace")


def history_check(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("first_difference")
    return verdicts(_trace(spark, folder)).select(
        *KEY, "status", "reason", "expected_history_tokens", "next_input_tokens",
        d["index"].alias("first_index"), d["region"].alias("region"), d["kind"].alias("kind"), d["expected_id"].alias("expected_id"), d["actual_id"].alias("actual_id"),
    )


def history_windows(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("first_difference")
    return verdicts(_trace(spark, folder)).where(F.col("status") == "FAIL").select(
        *KEY, d["window_start"].alias("window_start"), joined(d["expected_window"]).alias("expected_window"), joined(d["actual_window"]).alias("actual_window")
    )


def missing_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return verdicts(_trace(spark, folder)).where(F.col("missing").isNotNull()).select(*KEY, F.array_join("missing", " ").alias("missing"))


def boundary_localization(spark: SparkSession, folder: str) -> DataFrame:
    offsets = F.transform("boundary_comparisons", lambda b: F.concat_ws(":", b["name"], b["origin"], F.coalesce(b["first_difference"].cast("string"), F.lit("kept"))))
    return verdicts(_trace(spark, folder)).where(F.col("localization").isNotNull() | (F.size("boundary_comparisons") > 0)).select(
        *KEY, F.col("localization.after").alias("after"), F.col("localization.at_or_before").alias("at_or_before"),
        F.array_join(offsets, " ").alias("comparisons"), F.array_join("evidence_gaps", " ").alias("gaps"),
    )


def verdict_counts(spark: SparkSession, folder: str) -> DataFrame:
    contract = _trace(spark, folder).where(F.col("record_type") == "generation").select(*KEY, "contract.version", "contract.mode", "contract.history_policy").dropDuplicates(list(KEY))
    return verdicts(_trace(spark, folder)).select(*KEY, "status", "reason").join(contract, list(KEY)).groupBy("version", "mode", "history_policy", "status", "reason").agg(F.count("*").alias("n"))


def triage(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty most telling transitions: the report's own limit."""
    rank = F.array_position(F.array(F.lit("ERROR"), *map(F.lit, PRIORITY)), F.col("status"))
    return verdicts(_trace(spark, folder)).select(*KEY, "status", "reason", rank.alias("priority")).orderBy("priority", *KEY).limit(20)


def record_validation(spark: SparkSession, folder: str) -> DataFrame:
    return _trace(spark, folder).select(*KEY, record_error().alias("error")).where(F.col("error").isNotNull()).distinct()


def trace_validation(spark: SparkSession, folder: str) -> DataFrame:
    return trace_errors(_trace(spark, folder))


def trace_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return trace_reports(_trace(spark, folder))


def gap_reasons(spark: SparkSession, folder: str) -> DataFrame:
    gaps = _trace(spark, folder).where(F.col("record_type") == "capture_gap").select(*KEY, "reason").distinct()
    by_trace = gaps.groupBy("reason", "trace_id").agg(F.count("*").alias("n"))
    return by_trace.groupBy("reason").agg(F.sum("n").alias("n_gaps"), F.count("*").alias("n_traces"))


def repeated_turns(spark: SparkSession, folder: str) -> DataFrame:
    made = _trace(spark, folder).where((F.col("record_type") == "generation") & F.col("turn_id").isNotNull()).select(*KEY, "session_id", "branch_id", "turn_id").distinct()
    return made.groupBy("trace_id", "session_id", "branch_id", "turn_id").agg(F.count("*").alias("n"), F.min("sequence").alias("first_sequence")).where(F.col("n") > 1)


def public_aliases(spark: SparkSession, folder: str) -> DataFrame:
    made = _trace(spark, folder).where(F.col("record_type") == "generation").select(*KEY, "session_id", "branch_id", "turn_id", "parent_turn_id").distinct()
    fields = ("session_id", "branch_id", "turn_id", "parent_turn_id")
    long = made.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in fields))).alias("z"))
    return long.where(F.col("z.v").isNotNull()).groupBy("z.field").agg(F.count("*").alias("n"), F.count_if(is_alias(F.col("z.v"))).alias("n_public"))


def terminations(spark: SparkSession, folder: str) -> DataFrame:
    """Stop reasons and end-of-sequence flags of the free-form termination objects."""
    made = _trace(spark, folder).where(F.col("record_type") == "generation").select(*KEY, "termination").dropDuplicates(list(KEY))
    v = F.try_parse_json("termination")
    get = lambda p: F.try_variant_get(v, p, "string")
    reason = F.coalesce(get("$.upstream_finish_reason"), get("$.stop_reason"))
    return made.groupBy(reason.alias("finish"), get("$.terminal_eos_present").alias("eos_present"), v.isNotNull().alias("is_json")).agg(F.count("*").alias("n"))


def turn_digests(spark: SparkSession, folder: str) -> DataFrame:
    """A digest per branch over its turns in order: equal branches have equal digests."""
    made = _trace(spark, folder).where(F.col("record_type") == "generation").select(*KEY, "session_id", "branch_id", "turn_id").distinct()
    turns = F.transform(F.sort_array(F.collect_list(F.struct("sequence", "turn_id"))), lambda t: t["turn_id"])
    return made.groupBy("trace_id", "session_id", "branch_id").agg(F.sha2(F.array_join(turns, "\n"), 256).alias("digest"), F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (history_check, history_windows, missing_evidence, boundary_localization, verdict_counts, triage, record_validation, trace_validation,
              trace_rollup, gap_reasons, repeated_turns, public_aliases, terminations, turn_digests)
}

_IN = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
_BAD = lambda x: f"({x} IS NOT NULL AND len(list_filter({x}, lambda v: v IS NULL OR v < 0)) > 0)"
_FULL = lambda x: f"coalesce(length({x}) > 0, false)"
_BOUNDARY = lambda b: f"""CASE
  WHEN {b} IS NULL THEN NULL
  WHEN len(list_filter({b}, lambda z: z IS NULL OR NOT {_FULL('z.name')})) > 0 OR len(list_distinct(list_transform({b}, lambda z: z.name))) < len({b}) THEN 'boundary_name'
  WHEN len(list_filter({b}, lambda z: NOT coalesce(z.origin IN {_IN(ORIGINS)}, false))) > 0 THEN 'boundary_origin'
  WHEN len(list_filter({b}, lambda z: z.input_ids IS NULL OR len(list_filter(z.input_ids, lambda v: v IS NULL OR v < 0)) > 0)) > 0 THEN 'boundary_tokens'
  WHEN len(list_filter({b}, lambda z: NOT {_FULL('z.token_space')})) > 0 THEN 'boundary_token_space' END"""  # noqa: E731
_CONTRACT = lambda c: f"""CASE WHEN {c}.mode NOT IN {_IN(MODES)} THEN 'contract_mode' WHEN {c}.history_policy NOT IN {_IN(POLICIES)} THEN 'contract_policy' END"""
_DIFFERENCE = lambda e, a: f"list_position(list_transform(range(1, len({e}) + 1), lambda i: {e}[i] IS DISTINCT FROM {a}[i]), true) - 1"
_SIDE = {**{f"previous.{c}": f"p.{c}" for c in PREVIOUS}, **{f"following.{c}": "c.parent_turn_id" if c == "previous_turn_id" else f"c.{c}" for c in FOLLOWING}}
_ERROR = f"CASE WHEN NOT coalesce(c.evidence_kind IN {_IN(EVIDENCE)}, false) THEN 'evidence_kind' " + " ".join(
    f"WHEN {_BAD(x) if x.endswith('_ids') else f'length({x}) = 0'} THEN '{n}'" for n, x in _SIDE.items()
) + " END"
_MISSING = "list_filter([" + ", ".join(f"CASE WHEN {x} IS NULL THEN '{n}' END" for n, x in _SIDE.items()) + "], lambda z: z IS NOT NULL)"
_VERDICTS = f"""
r AS (SELECT DISTINCT ON (trace_id, sequence) * FROM trace),
g AS (SELECT * FROM r WHERE record_type = 'generation'),
first AS (SELECT * FROM g WHERE turn_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trace_id, session_id, branch_id, turn_id ORDER BY sequence) = 1),
j AS (
  SELECT c.trace_id, c.sequence, c.contract AS k, c.boundaries AS b, p.input_ids AS pi, p.token_space AS ps, c.token_space AS cs, c.input_ids AS a, list_concat(p.input_ids, p.output_ids) AS e0,
    p.session_id AS p1, p.branch_id AS p2, p.turn_id AS p3, p.output_ids AS po, c.session_id AS c1, c.branch_id AS c2, c.parent_turn_id AS c3,
    coalesce({_ERROR}, {_BOUNDARY('c.boundaries')}, {_CONTRACT('c.contract')}) AS error, {_MISSING} AS missing
  FROM g c LEFT JOIN first p ON p.turn_id = c.parent_turn_id AND p.sequence < c.sequence AND p.trace_id IS NOT DISTINCT FROM c.trace_id
    AND p.session_id IS NOT DISTINCT FROM c.session_id AND p.branch_id IS NOT DISTINCT FROM c.branch_id
  WHERE c.parent_turn_id IS NOT NULL),
w AS (
  SELECT *, CASE WHEN pi IS NOT NULL AND po IS NOT NULL THEN e0 END AS e, CASE WHEN error IS NOT NULL THEN 'malformed:' || error
    WHEN k.mode = 'history_rewrite' OR k.history_policy = 'truncated' THEN 'rewriting_permitted'
    WHEN k.version IS DISTINCT FROM '{VERSION}' OR k.mode IS DISTINCT FROM 'append_only' THEN 'contract_unsupported'
    WHEN k.history_policy IS DISTINCT FROM 'preserved' THEN 'retention_unknown'
    WHEN len(missing) > 0 THEN 'evidence_missing'
    WHEN p1 <> c1 OR p2 <> c2 THEN 'scope_differs'
    WHEN ps <> cs THEN 'token_space_differs'
    WHEN p3 <> c3 THEN 'continuity_unknown'
    WHEN len(pi) + len(po) = 0 THEN 'history_empty' END AS why FROM j),
x AS (SELECT *, CASE WHEN why IS NULL THEN {_DIFFERENCE('e', 'a')} END AS i FROM w),
v AS (
  SELECT *, CASE WHEN why LIKE 'malformed:%' THEN 'ERROR' WHEN why IN ('rewriting_permitted', 'scope_differs', 'token_space_differs') THEN 'NOT_APPLICABLE'
      WHEN why IS NOT NULL THEN 'INCONCLUSIVE' WHEN i IS NULL THEN 'PASS' ELSE 'FAIL' END AS status,
    coalesce(why, CASE WHEN i IS NULL THEN 'prefix_kept' ELSE 'prefix_changed' END) AS reason FROM x)
"""
_RECORD = f"""CASE
  WHEN NOT coalesce(trace_version IN (1, 2) AND record_type IN ('generation', 'capture_gap', 'capture_complete'), false) THEN 'version_or_type'
  WHEN NOT {_FULL('trace_id')} THEN 'trace_id'
  WHEN NOT coalesce(evidence_kind IN {_IN(EVIDENCE)}, false) THEN 'evidence_kind'
  WHEN NOT coalesce(sequence >= 0, false) THEN 'sequence'
  WHEN record_type = 'capture_complete' THEN CASE WHEN trace_version <> 2 THEN 'footer_version'
    WHEN NOT coalesce(expected_generations >= 0, false) THEN 'footer_expected_generations' WHEN NOT coalesce(generations >= 0, false) THEN 'footer_generations'
    WHEN NOT coalesce(capture_gaps >= 0, false) THEN 'footer_capture_gaps' WHEN NOT coalesce(regexp_full_match(prefix_sha256, '[0-9a-f]{{64}}'), false) THEN 'footer_digest' END
  WHEN record_type = 'capture_gap' THEN CASE WHEN NOT {_FULL('reason')} THEN 'gap_reason' END
  WHEN NOT {_FULL('session_id')} THEN 'session_id' WHEN NOT {_FULL('branch_id')} THEN 'branch_id' WHEN NOT {_FULL('turn_id')} THEN 'turn_id' WHEN NOT {_FULL('token_space')} THEN 'token_space'
  WHEN parent_turn_id = '' THEN 'parent_turn_id' WHEN parent_turn_id = turn_id THEN 'own_parent'
  WHEN input_ids IS NULL OR {_BAD('input_ids')} THEN 'input_ids' WHEN output_ids IS NULL OR {_BAD('output_ids')} THEN 'output_ids' WHEN len(output_ids) = 0 THEN 'output_empty'
  WHEN contract IS NULL THEN 'contract' WHEN metadata IS NULL THEN 'metadata' WHEN termination IS NULL THEN 'termination'
  ELSE coalesce({_BOUNDARY('boundaries')}, {_CONTRACT('contract')}) END"""
_ERRORS = f"""
q AS (SELECT *, {_RECORD} AS err FROM r),
m AS (SELECT trace_id, max(n) AS most FROM (SELECT trace_id, session_id, branch_id, turn_id, count(*) AS n FROM g GROUP BY ALL) GROUP BY trace_id),
s AS (
  SELECT trace_id, count(*) AS rows_, arg_min(err, sequence) FILTER (err IS NOT NULL) AS re, min(sequence) AS lo, max(sequence) AS hi, min(trace_version) AS v0, max(trace_version) AS v1,
    min(evidence_kind) AS e0, max(evidence_kind) AS e1, count(*) FILTER (record_type = 'capture_complete') AS feet, max(sequence) FILTER (record_type = 'capture_complete') AS foot,
    arg_max(struct_pack(x := expected_generations, g := generations, c := capture_gaps), sequence) FILTER (record_type = 'capture_complete') AS f,
    count(*) FILTER (record_type = 'generation') AS made, count(*) FILTER (record_type = 'capture_gap') AS gaps, count(*) FILTER (record_type = 'generation' AND parent_turn_id IS NULL) AS roots
  FROM q GROUP BY trace_id),
te AS (
  SELECT s.trace_id, CASE WHEN re IS NOT NULL THEN 'record:' || re WHEN lo <> 0 OR hi <> rows_ - 1 THEN 'sequence_gap' WHEN v0 <> v1 THEN 'version_changes' WHEN e0 <> e1 THEN 'evidence_changes'
      WHEN feet > 1 OR foot < hi THEN 'after_footer' WHEN coalesce(most, 0) > 1 THEN 'turn_repeated'
      WHEN feet = 1 AND NOT coalesce(f.g = made AND f.x = made AND f.c = gaps, false) THEN 'footer_counts' END AS error,
    rows_ - feet AS records, roots, made AS generations, gaps, CASE WHEN v1 = 2 THEN CASE WHEN feet > 0 THEN 'complete' ELSE 'missing' END END AS completion
  FROM s LEFT JOIN m ON m.trace_id = s.trace_id)
"""
ORACLE = {
    "history_check": f"""WITH {_VERDICTS} SELECT trace_id, sequence, status, reason, CASE WHEN why IS NULL THEN len(e) END AS expected_history_tokens, CASE WHEN why IS NULL THEN len(a) END AS next_input_tokens,
  i AS first_index, CASE WHEN i < len(pi) THEN 'previous_input' WHEN i IS NOT NULL THEN 'previous_output' END AS region,
  CASE WHEN i >= len(a) THEN 'missing_suffix' WHEN i IS NOT NULL THEN 'different_token' END AS kind, e[i + 1] AS expected_id, a[i + 1] AS actual_id FROM v""",
    "history_windows": f"""WITH {_VERDICTS} SELECT trace_id, sequence, greatest(0, i - 4) AS window_start, array_to_string(e[greatest(0, i - 4) + 1:i + 5], ' ') AS expected_window,
  array_to_string(a[greatest(0, i - 4) + 1:least(i + 5, len(e))], ' ') AS actual_window FROM v WHERE status = 'FAIL'""",
    "missing_evidence": f"WITH {_VERDICTS} SELECT trace_id, sequence, array_to_string(missing, ' ') AS missing FROM v WHERE why = 'evidence_missing'",
    "boundary_localization": f"""WITH {_VERDICTS},
l AS (SELECT *, list_transform(list_filter(b, lambda z: z.token_space = ps), lambda z: struct_pack(n := z.name, o := z.origin, d := {_DIFFERENCE('e', 'z.input_ids')})) AS cmp FROM v WHERE why IS NULL),
c AS (SELECT *, list_filter(cmp, lambda z: z.o = 'captured') AS cap FROM l),
o AS (SELECT *, coalesce(list_position(list_transform(cap, lambda z: z.d IS NOT NULL), true), 0) AS pos FROM c)
SELECT trace_id, sequence,
  CASE WHEN i IS NOT NULL THEN coalesce(CASE WHEN pos > 0 THEN CASE WHEN pos > 1 THEN cap[pos - 1].n END ELSE cap[len(cap)].n END, 'previous.input_ids + previous.output_ids') END AS after,
  CASE WHEN i IS NOT NULL THEN CASE WHEN pos > 0 THEN cap[pos].n ELSE 'next.input_ids' END END AS at_or_before,
  coalesce(array_to_string(list_transform(cmp, lambda z: z.n || ':' || z.o || ':' || coalesce(CAST(z.d AS VARCHAR), 'kept')), ' '), '') AS comparisons,
  coalesce(array_to_string(list_filter(list_transform(b, lambda z: CASE WHEN z.token_space <> ps THEN z.name || ':token_space' WHEN z.origin = 'derived' THEN z.name || ':derived' END), lambda z: z IS NOT NULL), ' '), '') AS gaps
FROM o WHERE i IS NOT NULL OR len(cmp) > 0""",
    "verdict_counts": f"WITH {_VERDICTS} SELECT k.version AS version, k.mode AS mode, k.history_policy AS history_policy, status, reason, count(*) AS n FROM v GROUP BY ALL",
    "triage": f"WITH {_VERDICTS} SELECT trace_id, sequence, status, reason, list_position(['ERROR', 'FAIL', 'INCONCLUSIVE', 'NOT_APPLICABLE', 'PASS'], status) AS priority FROM v ORDER BY priority, trace_id, sequence LIMIT 20",
    "record_validation": f"SELECT DISTINCT trace_id, sequence, {_RECORD} AS error FROM trace WHERE {_RECORD} IS NOT NULL",
    "trace_validation": f"WITH {_VERDICTS}, {_ERRORS} SELECT * FROM te",
    "trace_rollup": f"""WITH {_VERDICTS}, {_ERRORS},
n AS (SELECT trace_id, count(*) AS t, count(*) FILTER (status = 'FAIL') AS f, count(*) FILTER (status = 'INCONCLUSIVE') AS i, count(*) FILTER (status = 'NOT_APPLICABLE') AS a, count(*) FILTER (status = 'PASS') AS p FROM v GROUP BY trace_id)
SELECT te.trace_id, CASE WHEN error IS NOT NULL THEN 'ERROR' WHEN f > 0 THEN 'FAIL' WHEN gaps > 0 OR coalesce(completion = 'missing', false) OR i > 0 THEN 'INCONCLUSIVE' WHEN a > 0 THEN 'NOT_APPLICABLE' WHEN p > 0 THEN 'PASS' ELSE 'INCONCLUSIVE' END AS status,
  error, records, roots, generations, gaps, completion, coalesce(t, 0) AS transitions, coalesce(f, 0) AS n_fail, coalesce(i, 0) AS n_inconclusive, coalesce(a, 0) AS n_not_applicable, coalesce(p, 0) AS n_pass
FROM te LEFT JOIN n ON n.trace_id = te.trace_id""",
    "gap_reasons": "SELECT reason, count(*) AS n_gaps, count(DISTINCT trace_id) AS n_traces FROM (SELECT DISTINCT trace_id, sequence, reason FROM trace WHERE record_type = 'capture_gap') GROUP BY reason",
    "repeated_turns": """SELECT trace_id, session_id, branch_id, turn_id, count(*) AS n, min(sequence) AS first_sequence
FROM (SELECT DISTINCT trace_id, sequence, session_id, branch_id, turn_id FROM trace WHERE record_type = 'generation' AND turn_id IS NOT NULL) GROUP BY ALL HAVING count(*) > 1""",
    "public_aliases": """SELECT field, count(*) AS n, count(*) FILTER (regexp_full_match(v, '[A-Za-z0-9_.-]{1,128}')) AS n_public
FROM (SELECT DISTINCT trace_id, sequence, session_id, branch_id, turn_id, parent_turn_id FROM trace WHERE record_type = 'generation') UNPIVOT (v FOR field IN (session_id, branch_id, turn_id, parent_turn_id)) GROUP BY field""",
    "terminations": """SELECT coalesce(t ->> '$.upstream_finish_reason', t ->> '$.stop_reason') AS finish, t ->> '$.terminal_eos_present' AS eos_present, t IS NOT NULL AS is_json, count(*) AS n
FROM (SELECT CASE WHEN json_valid(termination) THEN CAST(termination AS JSON) END AS t FROM (SELECT DISTINCT ON (trace_id, sequence) termination FROM trace WHERE record_type = 'generation')) GROUP BY ALL""",
    "turn_digests": """SELECT trace_id, session_id, branch_id, sha256(string_agg(turn_id, chr(10) ORDER BY sequence, turn_id)) AS digest, count(*) AS n
FROM (SELECT DISTINCT trace_id, sequence, session_id, branch_id, turn_id FROM trace WHERE record_type = 'generation') GROUP BY ALL""",
}
