"""Queries of engine responses, manifests, captures and run evidence, and their SQL.

Where a table has no such field, both sides of a query derive it by the same stated rule from fields it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.functions.arrays import IGNORED, count_where, joined
from turnledger.operators.batches import feature_error
from turnledger.operators.engines import ends_with_end_token, gradient_errors, is_loopback, returned_outputs, stop_reason, zipped
from turnledger.operators.manifests import file_differences, run_error, same_keys, summed_maps
from turnledger.operators.paired import callback_statistics
from turnledger.operators.rounds import round_statistics
from turnledger.operators.traces import KEY, capture_gaps, transitions
from turnledger.session import table
from turnledger.sources.captures import parsed, response_tokens

SCOPE = ["trace_id", "session_id", "branch_id"]


def _made(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "trace").where(F.col("record_type") == "generation").select(*KEY, *columns).dropDuplicates(list(KEY))


def gap_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Every trace's gaps in order, as one text."""
    df = capture_gaps(table(spark, folder, "trace"))
    return df.select("trace_id", F.array_join(F.transform("gaps", lambda g: F.concat_ws(":", g["sequence"].cast("string"), F.coalesce(g["reason"], F.lit("-")))), " ").alias("gaps"), F.size("gaps").alias("n_gaps"))


def declared_transitions(spark: SparkSession, folder: str) -> DataFrame:
    """Case names of all transitions with the parent each found, its sequence and its tokens."""
    df = transitions(table(spark, folder, "trace")).select(*KEY, "case_id", "previous_sequence", F.md5(joined(F.col("previous.input_ids"))).alias("input_md5"), F.md5(joined(F.col("previous.output_ids"))).alias("output_md5"))
    return df.distinct()


def metadata_objects(spark: SparkSession, folder: str) -> DataFrame:
    """How the free-form metadata texts parse, and which have exactly the keys of a wrapper's point of capture."""
    df = _made(spark, folder, "metadata").where(F.col("metadata").isNotNull())
    v, error = parsed(F.col("metadata"))
    keys = F.map_from_entries(F.transform(F.map_keys(F.from_json("metadata", "map<string,string>")), lambda k: F.struct(k, F.lit(1))))
    closed = same_keys(df.select(error.alias("error"), F.when(error.isNull(), keys).alias("keys")), column="keys", expected=("capture_point", "scope"))
    return closed.groupBy(F.coalesce("error", F.lit("good")).alias("outcome"), "closed").agg(F.count("*").alias("n"))


def _damage(i: Column, cases: dict[int, Column], sound: Column) -> Column:
    out = F.when(F.lit(False), sound)
    for k, c in cases.items():
        out = out.when(i % 13 == k, c)
    return out.otherwise(sound)


def engine_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Every generation as an engine would answer it, some damaged by the remainder of their sequence by 13."""
    i = F.col("sequence")
    df = _made(spark, folder, "output_ids", F.size("input_ids").alias("n_prompt")).where((F.size("output_ids") > 0) & (F.col("n_prompt") >= 0))
    tuples = F.array_join(F.transform("output_ids", lambda t: F.concat(F.lit("[-0.5,"), t.cast("string"), F.lit(",null]"))), ",")
    pairs = _damage(i, {1: F.lit(""), 2: F.concat(tuples, F.lit(',["x",5]')), 3: F.concat(tuples, F.lit(",[0,-5]")), 4: F.concat(tuples, F.lit(",[0,1.5]"))}, tuples)
    finish = _damage(i, {5: F.lit('{"type":"abort"}'), 6: F.lit('{"type":"length"}'), 7: F.lit("null")}, F.lit('{"type":"stop"}'))
    top = _damage(i, {8: F.lit(',"output_ids":[0]'), 9: F.concat(F.lit(',"output_ids":['), F.array_join(F.col("output_ids").cast("array<string>"), ","), F.lit("]"))}, F.lit(""))
    counts = F.concat(F.lit('"prompt_tokens":'), (F.col("n_prompt") + (i % 13 == 10).cast("int")).cast("string"), F.lit(',"completion_tokens":'), (F.size("output_ids") + (i % 13 == 11).cast("int")).cast("string"))
    text = F.concat(F.lit('{"meta_info":{"output_token_logprobs":['), pairs, F.lit("],"), counts, F.lit(',"finish_reason":'), finish, F.lit("}"), top, F.lit("}"))
    found = response_tokens(df.select(*KEY, "n_prompt", _damage(i, {12: F.lit("[")}, text).alias("response")), "response", "n_prompt")
    return found.select(*KEY, "response_error", F.size("output_ids").alias("n_outputs"))


def stop_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Stop reasons if a record's first output were the end token, with a limit of 32 tokens; every fifth has none known."""
    df = _made(spark, folder, "output_ids").where(F.col("output_ids").isNotNull())
    ends = F.when(F.col("sequence") % 5 != 0, F.slice("output_ids", 1, 1))
    return df.groupBy(stop_reason(F.col("output_ids"), ends, F.lit(32)).alias("reason"), ends_with_end_token(F.col("output_ids"), ends).alias("terminal_eos")).agg(F.count("*").alias("n"))


def returned_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    """What was generated if an engine returned each record's input, of which the first half was the prompt; every seventh
    prompt is another one."""
    df = _made(spark, folder, "input_ids").where(F.size("input_ids") > 1)
    half = F.slice("input_ids", F.lit(1), F.floor(F.size("input_ids") / 2).cast("int"))
    prompt = F.when(F.col("sequence") % 7 == 0, F.reverse(half)).otherwise(half)
    got = returned_outputs(prompt, F.col("input_ids"))
    return df.select(*KEY, F.size(got).alias("n_generated"), F.md5(joined(got)).alias("generated_md5"))


def loopback_urls(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("s_suppkey")
    forms = [F.lit("http://127.0.0.1:"), F.lit("http://localhost:"), F.lit("http://[::1]:"), F.lit("https://localhost:"), F.lit("http://0.0.0.0:"), F.lit("http://me@localhost:"), F.lit("http://localhost.example:")]
    ends = [F.lit(""), F.lit("/"), F.lit("/v1"), F.lit("?a=1")]
    url = F.concat(F.get(F.array(*forms), (k % 7).cast("int")), (k * 997 % 70000).cast("string"), F.get(F.array(*ends), (k % 4).cast("int")))
    df = table(spark, folder, "supplier").select("s_suppkey", url.alias("url"))
    return df.select("s_suppkey", "url", is_loopback(F.col("url")).alias("loopback"))


def gradient_checks(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of an order as the gradient norms of a run of four rounds."""
    q = F.col("l_quantity")
    value = F.when(F.col("l_partkey") % 19 == 1, float("nan")).when(F.col("l_partkey") % 19 == 2, -q).when(F.col("l_orderkey") % 5 == 0, 0.0).otherwise(q)
    steps = table(spark, folder, "lineitem").select("l_orderkey", value.alias("norm"))
    return gradient_errors(steps, run=["l_orderkey"], value="norm", expected=4).groupBy("error").agg(F.count("*").alias("n_runs"))


def file_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files, listed by their number, size and digest, against a folder from which some are gone, changed,
    cut, doubled or added."""
    i = F.col("doc_id")
    df = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    row = lambda name, size, text: (name.cast("string").alias("name"), size.cast("bigint").alias("bytes"), F.sha2(text, 256).alias("sha256"))
    listed = df.where(i % 31 != 5).select(*row(i, F.octet_length("t"), F.col("t")))
    found = df.where(i % 31 != 1).select(*row(i, F.octet_length("t") - (i % 31 == 2).cast("int"), F.when(i % 31 == 3, F.concat("t", F.lit("."))).otherwise(F.col("t"))))
    return file_differences(listed, found.unionByName(found.where(F.col("name").cast("bigint") % 31 == 4)))


def zipped_captures(spark: SparkSession, folder: str) -> DataFrame:
    """The records of each session in order beside a wire log that lost the last record of some sessions and changed others."""
    df = _made(spark, folder, "session_id", "turn_id", F.size("output_ids").alias("n"))
    last = df.groupBy("trace_id", "session_id").agg(F.max("sequence").alias("last"))
    wire = df.join(last, ["trace_id", "session_id"]).where((F.col("sequence") < F.col("last")) | (F.col("last") % 3 > 0))
    wire = wire.select("trace_id", "session_id", "sequence", "turn_id", (F.col("n") + (F.col("sequence") % 17 == 3).cast("int")).alias("n"))
    found = zipped(df, wire, scope=["trace_id", "session_id"], order="sequence", fields=["turn_id", "n"])
    return found.where(F.col("error").isNotNull())


def callback_timings(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of events as trials, the first value the callback's and the second the finalizer's seconds."""
    e = table(spark, folder, "events").select((F.floor(F.col("event_id") / 2) % 50).alias("bench"), F.col("event_id"), "value")
    trials = e.select("bench", F.when(F.col("event_id") % 2 == 0, F.array("value")).alias("callback_seconds"), F.when(F.col("event_id") % 2 == 1, F.col("value")).alias("finalize_seconds"))
    return callback_statistics(trials, by=["bench"])


def round_totals(spark: SparkSession, folder: str) -> DataFrame:
    once = table(spark, folder, "rollout_samples").dropDuplicates(["index"])
    df = round_statistics(once, round_="rollout_id", group=["rollout_id", "group_index"])
    return df.withColumn("reward_sum", F.round("reward_sum", 6))


def step_consumption(spark: SparkSession, folder: str) -> DataFrame:
    """Supervised tokens of each run's steps of batch_size features, against those of all its features."""
    from turnledger.operators.ranking import ranked

    good = table(spark, folder, "features").where(feature_error(F.col("input_ids"), F.col("labels")).isNull())
    narrow = good.select("run_id", "feature_id", count_where(F.col("labels"), lambda y: y != IGNORED).alias("n")).dropDuplicates(["feature_id"])
    runs = table(spark, folder, "run_result").groupBy("run_id").agg(F.max("batch_size").alias("size")).where(F.col("size") > 0)
    placed = ranked(narrow, within=["run_id"], order=["feature_id"]).join(runs, "run_id")
    steps = placed.groupBy("run_id", F.floor(F.col("position") / F.col("size")).alias("step")).agg(F.sum("n").alias("n"))
    by_run = steps.groupBy("run_id").agg(F.count("*").alias("n_steps"), F.sum("n").alias("consumed"), F.max("n").alias("most"))
    audit = narrow.groupBy("run_id").agg(F.sum("n").alias("trainable"))
    return by_run.join(audit, "run_id").select("run_id", "n_steps", "consumed", "most", "trainable", (F.col("consumed") == F.col("trainable")).alias("equal"))


def state_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Users as optimizers whose states are event types: elements per user and state."""
    counts = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    states = counts.select("user_id", F.create_map("event_type", "n").alias("state"))
    return summed_maps(states, by=["user_id"], column="state")


def run_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Receipts as finished runs, judged by exit codes, memory, configuration and marker, damaged by their step count."""
    k = F.col("global_step")
    runs = table(spark, folder, "run_result").distinct()
    config = lambda pad: F.create_map(F.lit("batch_size"), F.col("batch_size").cast("string"), F.lit("pad"), pad.cast("string"))
    df = runs.select(
        "run_id", F.array(F.lit(0), (k % 11 == 1).cast("int")).alias("exit_codes"), (k % 11 == 2).alias("oom"), config(F.col("pad_token_id") + (k % 11 == 3).cast("int")).alias("config"),
        config(F.col("pad_token_id")).alias("expected"), F.when(k % 11 != 4, F.col("finished_at").cast("string")).alias("marker"),
    )
    return df.select("run_id", run_error().alias("error")).groupBy("error").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (gap_lists, declared_transitions, metadata_objects, engine_responses, stop_reasons, returned_suffixes, loopback_urls, gradient_checks, file_manifests, zipped_captures, callback_timings, round_totals,
              step_consumption, state_sizes, run_profiles)
}

_G = "g AS (SELECT DISTINCT ON (trace_id, sequence) * FROM trace WHERE record_type = 'generation')"
_TEXT = lambda x: f"md5(array_to_string(list_transform({x}, lambda v: coalesce(CAST(v AS VARCHAR), '-')), ' '))"
_BAD = lambda x: f"len(list_filter({x}, lambda v: v IS NULL OR v < 0)) > 0"
_SUPERVISED = """f AS (SELECT DISTINCT ON (feature_id) run_id, feature_id, len(list_filter(labels, lambda v: v <> -100)) AS n FROM features WHERE len(input_ids) > 0 AND len(list_filter(input_ids, lambda v: v IS NULL OR v < 0)) = 0
  AND len(labels) = len(input_ids) AND len(list_filter(list_zip(input_ids, labels), lambda z: NOT coalesce(z[2] = -100 OR z[2] = z[1], false))) = 0 AND labels[1] = -100 AND len(list_filter(labels, lambda v: v <> -100)) > 0)"""
ORACLE = {
    "gap_lists": """SELECT trace_id, string_agg(sequence || ':' || coalesce(reason, '-'), ' ' ORDER BY sequence) AS gaps, CAST(count(*) AS INTEGER) AS n_gaps
FROM (SELECT DISTINCT trace_id, sequence, reason FROM trace WHERE record_type = 'capture_gap') GROUP BY trace_id""",
    "declared_transitions": f"""WITH {_G}, p AS (SELECT * FROM g WHERE turn_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trace_id, session_id, branch_id, turn_id ORDER BY sequence) = 1)
SELECT c.trace_id, c.sequence, printf('transition-%06d', c.sequence) AS case_id, p.sequence AS previous_sequence, {_TEXT('p.input_ids')} AS input_md5, {_TEXT('p.output_ids')} AS output_md5
FROM g c LEFT JOIN p ON p.turn_id = c.parent_turn_id AND p.sequence < c.sequence AND p.trace_id IS NOT DISTINCT FROM c.trace_id AND p.session_id IS NOT DISTINCT FROM c.session_id AND p.branch_id IS NOT DISTINCT FROM c.branch_id
WHERE c.parent_turn_id IS NOT NULL""",
    "metadata_objects": f"""WITH {_G}, m AS (SELECT CASE WHEN NOT json_valid(metadata) THEN 'json' WHEN json_type(metadata) <> 'OBJECT' THEN 'no_object' ELSE 'good' END AS outcome, metadata FROM g WHERE metadata IS NOT NULL)
SELECT outcome, CASE WHEN outcome = 'good' THEN list_sort(json_keys(metadata)) = ['capture_point', 'scope'] ELSE false END AS closed, count(*) AS n FROM m GROUP BY ALL""",
    "engine_responses": f"""WITH {_G}, r AS (SELECT trace_id, sequence, len(output_ids) AS n, sequence % 13 AS i, {_BAD('output_ids')} AS bad FROM g WHERE len(output_ids) > 0 AND input_ids IS NOT NULL),
e AS (SELECT *, CASE WHEN i = 12 THEN 'meta_info' WHEN i = 1 THEN 'no_tokens' WHEN i = 2 THEN 'score' WHEN bad OR i IN (3, 4) THEN 'token' WHEN i = 10 THEN 'prompt_tokens' WHEN i = 11 THEN 'completion_tokens'
  WHEN i IN (5, 7) THEN 'finish_reason' WHEN i = 8 THEN 'output_ids' END AS response_error FROM r)
SELECT trace_id, sequence, response_error, CASE WHEN response_error IS NULL THEN CAST(n AS INTEGER) END AS n_outputs FROM e""",
    "stop_reasons": f"""WITH {_G}, s AS (SELECT output_ids AS o, CASE WHEN sequence % 5 <> 0 THEN output_ids[1:1] END AS ends FROM g WHERE output_ids IS NOT NULL),
t AS (SELECT o, CASE WHEN ends IS NOT NULL THEN coalesce(list_contains(ends, o[len(o)]), false) END AS terminal_eos FROM s)
SELECT CASE WHEN terminal_eos THEN 'eos' WHEN len(o) >= 32 THEN 'length' ELSE 'other' END AS reason, terminal_eos, count(*) AS n FROM t GROUP BY ALL""",
    "returned_suffixes": f"""WITH {_G}, p AS (SELECT trace_id, sequence, input_ids AS x, CASE WHEN sequence % 7 = 0 THEN list_reverse(input_ids[1:len(input_ids) // 2]) ELSE input_ids[1:len(input_ids) // 2] END AS p FROM g WHERE len(input_ids) > 1),
r AS (SELECT *, CASE WHEN x[1:len(p)] = p THEN x[len(p) + 1:] END AS y FROM p)
SELECT trace_id, sequence, CAST(len(y) AS INTEGER) AS n_generated, {_TEXT('y')} AS generated_md5 FROM r""",
    "loopback_urls": """WITH u AS (SELECT s_suppkey, (s_suppkey * 997) % 70000 AS port, s_suppkey % 7 AS f, s_suppkey % 4 AS e FROM supplier)
SELECT s_suppkey, ['http://127.0.0.1:', 'http://localhost:', 'http://[::1]:', 'https://localhost:', 'http://0.0.0.0:', 'http://me@localhost:', 'http://localhost.example:'][f + 1] || port || ['', '/', '/v1', '?a=1'][e + 1] AS url,
  f < 3 AND e < 2 AND port BETWEEN 1 AND 65535 AS loopback FROM u""",
    "gradient_checks": """WITH v AS (SELECT l_orderkey, CASE WHEN l_partkey % 19 = 1 THEN 'NaN'::DOUBLE WHEN l_partkey % 19 = 2 THEN -l_quantity WHEN l_orderkey % 5 = 0 THEN 0 ELSE l_quantity END AS x FROM lineitem),
e AS (SELECT l_orderkey, CASE WHEN count(*) <> 4 THEN 'count' WHEN bool_or(isnan(x)) THEN 'not_finite' WHEN min(x) < 0 THEN 'negative' WHEN max(x) = 0 THEN 'all_zero' END AS error FROM v GROUP BY l_orderkey)
SELECT error, count(*) AS n_runs FROM e GROUP BY error""",
    "file_manifests": """SELECT CAST(doc_id AS VARCHAR) AS name, CASE doc_id % 31 WHEN 1 THEN 'missing' WHEN 2 THEN 'bytes' WHEN 3 THEN 'sha256' WHEN 4 THEN 'repeated' WHEN 5 THEN 'unexpected' END AS problem
FROM documents WHERE doc_id % 31 BETWEEN 1 AND 5""",
    "zipped_captures": f"""WITH {_G}, d AS (SELECT trace_id, session_id, sequence, turn_id, len(output_ids) AS n, max(sequence) OVER (PARTITION BY trace_id, session_id) AS last FROM g),
a AS (SELECT *, row_number() OVER (PARTITION BY trace_id, session_id ORDER BY sequence) - 1 AS position FROM d),
w AS (SELECT trace_id, session_id, turn_id, n + CASE WHEN sequence % 17 = 3 THEN 1 ELSE 0 END AS n, row_number() OVER (PARTITION BY trace_id, session_id ORDER BY sequence) - 1 AS position FROM d WHERE sequence < last OR last % 3 > 0),
z AS (SELECT trace_id, session_id, position, CASE WHEN a.n IS NULL AND a.turn_id IS NULL AND a.last IS NULL THEN 'missing_left' WHEN w.turn_id IS NULL AND w.n IS NULL THEN 'missing_right' WHEN a.turn_id IS DISTINCT FROM w.turn_id THEN 'turn_id'
  WHEN a.n IS DISTINCT FROM w.n THEN 'n' END AS error FROM a FULL JOIN w USING (trace_id, session_id, position))
SELECT * FROM z WHERE error IS NOT NULL""",
    "callback_timings": """SELECT (event_id // 2) % 50 AS bench, median(value) FILTER (event_id % 2 = 0) AS callback_median, quantile_cont(value, 0.95) FILTER (event_id % 2 = 0) AS callback_p95,
  median(value) FILTER (event_id % 2 = 1) AS finalize_median FROM events GROUP BY 1""",
    "round_totals": """WITH s AS (SELECT DISTINCT ON (index) * FROM rollout_samples), g AS (SELECT rollout_id, group_index, avg(reward) AS m, stddev_samp(reward) AS d, count(DISTINCT reward) AS k FROM s GROUP BY ALL),
j AS (SELECT s.*, g.d IS NOT NULL AND abs((reward - m) / (d + 1e-6)) > 0 AS moved FROM s JOIN g ON g.rollout_id IS NOT DISTINCT FROM s.rollout_id AND g.group_index IS NOT DISTINCT FROM s.group_index),
v AS (SELECT rollout_id, count(*) FILTER (k > 1) AS n_varied FROM g GROUP BY rollout_id)
SELECT j.rollout_id, any_value(n_varied) AS n_varied_groups, count(*) FILTER (moved) AS n_nonzero, round(sum(reward), 6) AS reward_sum, CAST(coalesce(sum(response_length) FILTER (response_length BETWEEN 0 AND len(tokens)), 0) AS BIGINT) AS trainable
FROM j JOIN v ON v.rollout_id IS NOT DISTINCT FROM j.rollout_id GROUP BY j.rollout_id""",
    "step_consumption": f"""WITH {_SUPERVISED}, r AS (SELECT run_id, max(batch_size) AS size FROM run_result GROUP BY run_id HAVING max(batch_size) > 0),
p AS (SELECT f.run_id, n, (row_number() OVER (PARTITION BY f.run_id ORDER BY feature_id) - 1) // size AS step FROM f JOIN r USING (run_id)),
s AS (SELECT run_id, step, sum(n) AS n FROM p GROUP BY ALL)
SELECT run_id, count(*) AS n_steps, CAST(sum(s.n) AS BIGINT) AS consumed, CAST(max(s.n) AS BIGINT) AS most, CAST(any_value(t) AS BIGINT) AS trainable, sum(s.n) = any_value(t) AS equal
FROM s JOIN (SELECT run_id, sum(n) AS t FROM f GROUP BY run_id) USING (run_id) GROUP BY run_id""",
    "state_sizes": "SELECT user_id, event_type AS name, count(*) AS total FROM events GROUP BY ALL",
    "run_profiles": """SELECT CASE WHEN global_step % 11 = 1 THEN 'exit_code' WHEN global_step % 11 = 2 THEN 'out_of_memory' WHEN global_step % 11 = 3 AND pad_token_id IS NOT NULL THEN 'config' WHEN global_step % 11 = 4 OR finished_at IS NULL THEN 'marker' END AS error, count(*) AS n
FROM (SELECT DISTINCT * FROM run_result) GROUP BY 1""",
}
