"""Queries over samples, features, batches and rounds, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.functions.arrays import IGNORED, count_where, history, joined, labels_of, prompt_of
from turnledger.functions.scalars import answer_score, float32
from turnledger.operators.attribution import attribution_totals, retention
from turnledger.operators.batches import audit_batches, feature_error, pad_batches, with_widths
from turnledger.operators.continuation import append_only, continued, restored, shared_prefix
from turnledger.operators.ranking import ranked
from turnledger.operators.rounds import bijection, changed_arrays, group_rewards, handoff_violations, leaked_prompts, normalised_rewards, sample_violations
from turnledger.operators.traces import KEY
from turnledger.session import table, written

SCOPE = ["trace_id", "session_id", "branch_id"]


def _samples(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "rollout_samples").select("index", *columns).dropDuplicates(["index"])


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    made = table(spark, folder, "trace").where((F.col("record_type") == "generation") & (F.size("input_ids") > 0) & (F.size("output_ids") > 0))
    turns = made.groupBy(*SCOPE, "turn_id").agg(F.min_by(F.struct("sequence", "input_ids", "output_ids"), "sequence").alias("r"))
    return written(turns.select(*SCOPE, "turn_id", "r.sequence", "r.input_ids", "r.output_ids"), "turns")


def _emitted(turns: DataFrame) -> DataFrame:
    """Training samples as a retaining policy emits them: the last turn of each branch with all tokens after the first
    turn's input as response, the token after every tenth masked out."""
    ends = turns.groupBy(*SCOPE).agg(F.max_by(F.struct("input_ids", "output_ids"), "sequence").alias("z"), F.min_by(F.size("input_ids"), "sequence").alias("prompt"))
    tokens = history(F.col("z.input_ids"), F.col("z.output_ids"))
    df = ends.select(*SCOPE, F.lit("last").alias("sample_id"), tokens.alias("tokens"), (F.size(tokens) - F.col("prompt")).alias("response_length")).where(F.col("response_length") > 0)
    # some samples are trained on twice
    df = df.unionByName(df.where(F.size("tokens") % 3 == 0).withColumn("sample_id", F.lit("again")))
    return df.withColumn("loss_mask", F.transform(F.sequence(F.lit(1), F.col("response_length")), lambda i: F.when(i % 10 == 0, 0).otherwise(1)))


def _retried(turns: DataFrame) -> DataFrame:
    """Turns of which some were sampled twice with the same tokens: what they made cannot be told apart."""
    return turns.unionByName(turns.where(F.size("output_ids") % 5 == 0).withColumn("turn_id", F.concat("turn_id", F.lit("~retry"))))


def attribution(spark: SparkSession, folder: str) -> DataFrame:
    turns = _turns(spark, folder)
    return attribution_totals(_retried(turns), _emitted(turns), scope=SCOPE)


def turn_retention(spark: SparkSession, folder: str) -> DataFrame:
    turns = _turns(spark, folder)
    return retention(_retried(turns), _emitted(turns), scope=SCOPE)


def sample_labels(spark: SparkSession, folder: str) -> DataFrame:
    df = _samples(spark, folder, "tokens", "response_length").where((F.col("response_length") >= 0) & (F.col("response_length") <= F.size("tokens")))
    labels = labels_of(F.col("tokens"), F.col("response_length"))
    return df.select("index", F.size("tokens").alias("n_tokens"), count_where(labels, lambda y: y != IGNORED).alias("n_supervised"), F.md5(joined(labels)).alias("labels_md5"))


def feature_checks(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "features").select("feature_id", feature_error(F.col("input_ids"), F.col("labels"), F.lit(2048)).alias("error"))
    return df.where(F.col("error").isNotNull()).distinct()


def _batches(spark: SparkSession, folder: str) -> DataFrame:
    good = table(spark, folder, "features").where(feature_error(F.col("input_ids"), F.col("labels")).isNull()).dropDuplicates(["feature_id"])
    runs = table(spark, folder, "run_result").groupBy("run_id").agg(F.max("batch_size").alias("batch_size"), F.max("pad_token_id").alias("pad")).where(F.col("batch_size") > 0)
    narrow = ranked(good.select("run_id", "feature_id", F.size("input_ids").alias("size")), within=["run_id"], order=["feature_id"]).join(runs, "run_id")
    placed = narrow.select("run_id", "feature_id", "pad", "size", F.floor(F.col("position") / F.col("batch_size")).alias("batch_no"))
    # widths come from sizes, so that the tokens move once, to their place
    placed = with_widths(placed, batch=["run_id", "batch_no"]).select("feature_id", "pad", "batch_no", "width")
    return pad_batches(good.join(placed, "feature_id").select("run_id", "batch_no", "feature_id", "pad", "width", "input_ids", "labels"), batch=["run_id", "batch_no"], pad=F.col("pad"))


def batch_padding(spark: SparkSession, folder: str) -> DataFrame:
    return _batches(spark, folder).groupBy("run_id", "batch_no").agg(
        F.count("*").alias("n"), F.max("width").alias("width"), F.sum(F.col("width") - F.size("input_ids")).alias("padding"),
        F.sum(count_where(F.col("padded_labels"), lambda y: y != IGNORED)).alias("supervised"), F.sum(F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)).alias("attended"),
    )


def collator_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The audit of a collator that trains on every token that is not padding, and so on prompts too."""
    expected = written(_batches(spark, folder).select("feature_id", "padded_ids", "attention_mask", "padded_labels", "pad"), "batches")
    wrong = F.transform("padded_ids", lambda x: F.when(x == F.col("pad"), F.lit(IGNORED).cast("bigint")).otherwise(x))
    actual = expected.withColumn("padded_labels", F.when(F.col("feature_id") % 3 == 0, wrong).otherwise(F.col("padded_labels")))
    return audit_batches(expected, actual, on=["feature_id"], fields=["padded_ids", "attention_mask", "padded_labels"])


def reward_groups(spark: SparkSession, folder: str) -> DataFrame:
    df = group_rewards(_samples(spark, folder, "group_index", "reward"), group=["group_index"])
    return df.withColumns({"mean": F.round("mean", 6), "deviation": F.round("deviation", 6)})


def reward_normalisation(spark: SparkSession, folder: str) -> DataFrame:
    df = normalised_rewards(_samples(spark, folder, "group_index", "reward"), group=["group_index"])
    return df.select("index", "group_size", F.round("normalised", 6).alias("normalised"))


def answer_scores(spark: SparkSession, folder: str) -> DataFrame:
    df = _samples(spark, folder, "response", "label", "reward")
    score = answer_score(F.col("response"), F.col("label"))
    return df.select("index", score.alias("score"), (~score.eqNullSafe(F.col("reward"))).alias("differs"))


def round_violations(spark: SparkSession, folder: str) -> DataFrame:
    return sample_violations(table(spark, folder, "rollout_samples"))


def trainer_handoff(spark: SparkSession, folder: str) -> DataFrame:
    """The samples of each round against a trainer's copy of them in which every eleventh is damaged in some way."""
    df = normalised_rewards(_samples(spark, folder, "group_index", "tokens", "response_length", "reward", "rollout_log_probs"), group=["group_index"])
    df = df.where((F.col("response_length") > 0) & (F.size("rollout_log_probs") == F.col("response_length")) & F.col("normalised").isNotNull())
    df = written(df, "rollout")
    rollout = df.select(F.col("index").alias("position"), "index", "tokens", "response_length", "normalised", "rollout_log_probs")
    i, n, r = F.col("index"), F.col("response_length"), F.col("normalised")
    train = df.where(i % 11 != 1).select(
        i.alias("rollout_position"), F.when(i % 11 == 2, i + 1).otherwise(i).alias("sample_index"), "tokens", F.when(i % 11 == 3, n - 1).otherwise(n).alias("response_lengths"),
        F.array_repeat(F.lit(1), n).alias("loss_masks"), F.when(i % 11 == 4, r + 0.001).otherwise(r).alias("rewards"), F.array_repeat(F.when(i % 11 == 5, r + 0.001).otherwise(r), n).alias("advantages"),
        F.array_repeat(r, n).alias("returns"), F.when(i % 11 == 6, F.transform("rollout_log_probs", lambda x: x + 0.5)).otherwise(F.transform("rollout_log_probs", float32)).alias("rollout_log_probs"),
    )
    return handoff_violations(rollout, train)


def sample_features(spark: SparkSession, folder: str) -> DataFrame:
    """Which samples became features, and which features come from no sample."""
    features = table(spark, folder, "features").select("feature_id", "sample_index").dropDuplicates(["feature_id"])
    return bijection(_samples(spark, folder), features, left_key="index", right_key="sample_index")


def exact_prompt_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_prompts(table(spark, folder, "rollout_samples"), held_out=("eval", "test"))


def array_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Each embedding against the one before it, as two exports of a tensor."""
    vectors = table(spark, folder, "embeddings")
    after = vectors.select((F.col("vec_id") + 1).alias("vec_id"), "embedding")
    return changed_arrays(vectors, after, key="vec_id", values="embedding").withColumn("largest", F.round("largest", 5))


def _links(spark: SparkSession, folder: str) -> DataFrame:
    turns = _turns(spark, folder)
    parents = table(spark, folder, "trace").where((F.col("record_type") == "generation") & F.col("parent_turn_id").isNotNull()).select(*KEY, "parent_turn_id").distinct()
    child = turns.join(parents, ["trace_id", "sequence"])
    p = turns.select(*SCOPE, F.col("turn_id").alias("parent_turn_id"), history(F.col("input_ids"), F.col("output_ids")).alias("history"), F.size("input_ids").alias("kept"))
    return child.join(p, [*SCOPE, "parent_turn_id"])


def continuations(spark: SparkSession, folder: str) -> DataFrame:
    """Each request against its parent's history: shared tokens, whether it only appends, and the exact continuation."""
    df = shared_prefix(_links(spark, folder), "history", "input_ids")
    return df.select(
        *KEY, "turn_id", "shared", append_only(F.col("history"), F.col("input_ids")).alias("change"),
        F.md5(joined(continued(F.col("history"), F.col("input_ids"), F.least(F.size("history"), F.size("input_ids"))))).alias("continued_md5"),
    )


def restored_replies(spark: SparkSession, folder: str) -> DataFrame:
    """Every branch's turn ids given back to a copy that lost its oldest turn and all wording."""
    turns = table(spark, folder, "trace").where((F.col("record_type") == "generation") & F.col("turn_id").isNotNull()).select(*SCOPE, "sequence", "turn_id").distinct()
    blank = turns.where(F.col("sequence") > 0).select(*SCOPE, "sequence", F.lit("?").alias("turn_id"))
    return restored(blank, turns, scope=SCOPE, order="sequence", content="turn_id")


def prompt_lengths(spark: SparkSession, folder: str) -> DataFrame:
    df = _samples(spark, folder, "split", "tokens", "response_length")
    size = F.size(prompt_of(F.col("tokens"), F.col("response_length")))
    return df.where(size.isNotNull()).groupBy("split").agg(F.count("*").alias("n"), F.sum(size).alias("tokens"), F.max(size).alias("longest"), F.percentile(size, F.lit(0.95)).alias("p95"))


QUERIES = {
    f.__name__: f
    for f in (attribution, turn_retention, sample_labels, feature_checks, batch_padding, collator_audit, reward_groups, reward_normalisation, answer_scores, round_violations,
              trainer_handoff, sample_features, exact_prompt_leaks, array_changes, continuations, restored_replies, prompt_lengths)
}

_S = "s AS (SELECT DISTINCT ON (index) * FROM rollout_samples)"
_T = """
g AS (SELECT * FROM trace WHERE record_type = 'generation' AND len(input_ids) > 0 AND len(output_ids) > 0),
t AS (SELECT trace_id, session_id, branch_id, turn_id, sequence, input_ids, output_ids FROM g QUALIFY row_number() OVER (PARTITION BY trace_id, session_id, branch_id, turn_id ORDER BY sequence) = 1)"""
_A = f"""{_T},
z AS (SELECT trace_id, session_id, branch_id, arg_max(list_concat(input_ids, output_ids), sequence) AS tokens, arg_min(len(input_ids), sequence) AS prompt FROM t GROUP BY ALL),
e AS (SELECT *, len(tokens) - prompt AS n, unnest(CASE WHEN len(tokens) % 3 = 0 THEN [1, 2] ELSE [1] END) AS copy FROM z WHERE len(tokens) > prompt),
tt AS (SELECT * FROM t UNION ALL SELECT trace_id, session_id, branch_id, turn_id || '~retry', sequence, input_ids, output_ids FROM t WHERE len(output_ids) % 5 = 0),
mk AS (SELECT trace_id, session_id, branch_id, turn_id, len(output_ids) AS made, i, md5(list_concat(input_ids, output_ids)[1:len(input_ids) + i + 1]::VARCHAR) AS k FROM (SELECT *, unnest(range(0, len(output_ids))) AS i FROM tt)),
kk AS (SELECT trace_id, session_id, branch_id, k, count(*) AS c, min(turn_id) AS turn_id, min(i) AS i FROM mk GROUP BY ALL),
sp AS (SELECT trace_id, session_id, branch_id, md5(tokens[1:prompt + i + 1]::VARCHAR) AS k FROM (SELECT *, unnest(range(0, n)) AS i FROM e) WHERE (i + 1) % 10 <> 0),
f AS (SELECT sp.trace_id, sp.session_id, sp.branch_id, coalesce(c, 0) AS c, turn_id, i FROM sp LEFT JOIN kk ON kk.trace_id = sp.trace_id AND kk.session_id = sp.session_id AND kk.branch_id = sp.branch_id AND kk.k = sp.k),
m AS (SELECT trace_id, session_id, branch_id, turn_id, i, count(*) AS n FROM f WHERE c = 1 GROUP BY ALL)"""
_E = lambda x="input_ids", y="labels": f"""CASE WHEN {x} IS NULL OR len({x}) = 0 THEN 'no_tokens' WHEN len(list_filter({x}, lambda v: v IS NULL OR v < 0)) > 0 THEN 'bad_token' WHEN {y} IS NULL THEN 'no_labels'
  WHEN len({y}) <> len({x}) THEN 'label_length' WHEN len(list_filter(list_zip({x}, {y}), lambda z: NOT coalesce(z[2] = -100 OR z[2] = z[1], false))) > 0 THEN 'foreign_label'
  WHEN {y}[1] <> -100 THEN 'supervised_start' WHEN len(list_filter({y}, lambda v: v <> -100)) = 0 THEN 'unsupervised' ELSE %s END"""  # noqa: E731
_B = f"""
g AS (SELECT DISTINCT ON (feature_id) * FROM features WHERE {_E() % 'NULL'} IS NULL),
r AS (SELECT run_id, max(batch_size) AS bs, max(pad_token_id) AS pad FROM run_result GROUP BY run_id HAVING max(batch_size) > 0),
b AS (SELECT g.*, pad, (row_number() OVER (PARTITION BY g.run_id ORDER BY feature_id) - 1) // bs AS batch_no FROM g JOIN r USING (run_id)),
w AS (SELECT *, max(len(input_ids)) OVER (PARTITION BY run_id, batch_no) AS width FROM b)"""
_SCORE = r"""CASE WHEN response IS NULL OR label IS NULL THEN NULL ELSE CAST(coalesce(regexp_full_match(a, '-?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)') AND open_ AND try_cast(replace(a, ',', '') AS HUGEINT) = try_cast(label AS HUGEINT), false) AS DOUBLE) END"""
_ANSWER = r"""
b AS (SELECT *, regexp_matches(response, '\\boxed\s*\{') AS boxed, regexp_extract(response, '(?s)^.*\\boxed\s*\{(.*)$', 1) AS body FROM s),
a AS (SELECT *, NOT boxed OR contains(body, '}') AS open_, regexp_replace(CASE WHEN boxed THEN split_part(body, '}', 1) ELSE response END, '^\s+|\s+$', '', 'g') AS a FROM b)"""
_L = f"""{_T},
c AS (SELECT DISTINCT t.*, p.parent_turn_id FROM t JOIN trace p ON p.trace_id = t.trace_id AND p.sequence = t.sequence WHERE p.record_type = 'generation' AND p.parent_turn_id IS NOT NULL),
l AS (SELECT c.trace_id, c.sequence, c.turn_id, list_concat(p.input_ids, p.output_ids) AS h, c.input_ids AS a FROM c JOIN t p ON p.trace_id = c.trace_id AND p.session_id = c.session_id AND p.branch_id = c.branch_id AND p.turn_id = c.parent_turn_id),
d AS (SELECT *, list_position(list_transform(range(1, len(h) + 1), lambda i: h[i] IS DISTINCT FROM a[i]), true) - 1 AS i FROM l)"""
_TEXT = lambda x: f"md5(array_to_string(list_transform({x}, lambda v: coalesce(CAST(v AS VARCHAR), '-')), ' '))"

ORACLE = {
    "attribution": f"""WITH {_A},
k AS (SELECT DISTINCT trace_id, session_id, branch_id FROM tt),
x AS (SELECT trace_id, session_id, branch_id, count(*) AS t, count(*) FILTER (c = 0) AS u, count(*) FILTER (c > 1) AS a FROM f GROUP BY ALL),
y AS (SELECT trace_id, session_id, branch_id, count(*) AS r, sum(n - 1) AS d FROM m GROUP BY ALL),
o AS (SELECT trace_id, session_id, branch_id, sum(len(output_ids)) AS made FROM tt GROUP BY ALL)
SELECT trace_id, session_id, branch_id, CAST(made AS BIGINT) AS generated, coalesce(t, 0) AS trainable, coalesce(u, 0) AS unmatched, coalesce(a, 0) AS ambiguous, CAST(coalesce(d, 0) AS BIGINT) AS duplicate,
  CAST(made - coalesce(r, 0) AS BIGINT) AS unaccounted, CASE WHEN u > 0 THEN 'UNMATCHED' WHEN a > 0 THEN 'AMBIGUOUS' WHEN coalesce(t, 0) = 0 THEN 'NO_TRAINABLE_TOKENS' ELSE 'MATCHED' END AS status
FROM k JOIN o USING (trace_id, session_id, branch_id) LEFT JOIN x USING (trace_id, session_id, branch_id) LEFT JOIN y USING (trace_id, session_id, branch_id)""",
    "turn_retention": f"""WITH {_A}
SELECT tt.trace_id, tt.session_id, tt.branch_id, tt.turn_id, len(output_ids) AS generated, coalesce(n, 0) AS represented, len(output_ids) - coalesce(n, 0) AS unaccounted
FROM tt LEFT JOIN (SELECT trace_id, session_id, branch_id, turn_id, count(*) AS n FROM m GROUP BY ALL) USING (trace_id, session_id, branch_id, turn_id)""",
    "sample_labels": f"""WITH {_S}, l AS (SELECT index, tokens, list_concat(list_transform(tokens[1:len(tokens) - response_length], lambda v: -100), tokens[len(tokens) - response_length + 1:]) AS y FROM s WHERE response_length BETWEEN 0 AND len(tokens))
SELECT index, len(tokens) AS n_tokens, len(list_filter(y, lambda v: v <> -100)) AS n_supervised, {_TEXT('y')} AS labels_md5 FROM l""",
    "feature_checks": f"""SELECT * FROM (SELECT DISTINCT feature_id, {_E() % "CASE WHEN len(input_ids) > 2048 THEN 'too_long' END"} AS error FROM features) WHERE error IS NOT NULL""",
    "batch_padding": f"""WITH {_B} SELECT run_id, batch_no, count(*) AS n, max(width) AS width, CAST(sum(width - len(input_ids)) AS BIGINT) AS padding,
  CAST(sum(len(list_filter(labels, lambda v: v <> -100))) AS BIGINT) AS supervised, CAST(sum(len(input_ids)) AS BIGINT) AS attended FROM w GROUP BY ALL""",
    "collator_audit": f"""WITH {_B},
q AS (SELECT feature_id, pad, list_concat(labels, list_transform(range(0, width - len(labels)), lambda i: -100)) AS x, list_concat(input_ids, list_transform(range(0, width - len(input_ids)), lambda i: pad)) AS p FROM w),
h AS (SELECT feature_id, x, CASE WHEN feature_id % 3 = 0 THEN list_transform(p, lambda v: CASE WHEN v = pad THEN -100 ELSE v END) ELSE x END AS y FROM q)
SELECT feature_id, CASE WHEN x = y THEN '' ELSE 'padded_labels' END AS mismatched, CASE WHEN x = y THEN 'MATCHED' ELSE 'MISMATCH' END AS status, len(list_filter(x, lambda v: v <> -100)) AS expected_supervised,
  len(list_filter(list_zip(x, y), lambda z: z[2] <> -100 AND z[1] = -100)) AS unexpected, len(list_filter(list_zip(x, y), lambda z: z[1] <> -100 AND z[2] = -100)) AS removed FROM h""",
    "reward_groups": f"WITH {_S} SELECT group_index, count(reward) AS n, round(avg(reward), 6) AS mean, round(stddev_samp(reward), 6) AS deviation, count(DISTINCT reward) AS n_rewards FROM s GROUP BY group_index",
    "reward_normalisation": f"""WITH {_S}, g AS (SELECT group_index, count(reward) AS n, avg(reward) AS m, stddev_samp(reward) AS d FROM s GROUP BY group_index)
SELECT index, n AS group_size, round((reward - m) / (d + 1e-6), 6) AS normalised FROM s JOIN g ON g.group_index IS NOT DISTINCT FROM s.group_index""",
    "answer_scores": f"WITH {_S}, {_ANSWER} SELECT index, {_SCORE} AS score, ({_SCORE}) IS DISTINCT FROM reward AS differs FROM a",
    "round_violations": f"""WITH s AS (SELECT DISTINCT * FROM rollout_samples), {_ANSWER},
x AS (SELECT index, unnest([CASE WHEN tokens IS NULL THEN 'tokens_missing' END, CASE WHEN coalesce(response_length IS NULL OR response_length <= 0 OR response_length >= len(tokens), false) THEN 'response_length' END,
  CASE WHEN group_index IS NULL THEN 'group_missing' END, CASE WHEN remove_sample THEN 'removed' END, CASE WHEN weight_versions IS DISTINCT FROM [CAST(rollout_id + 1 AS VARCHAR)] THEN 'weight_version' END,
  CASE WHEN reward IS DISTINCT FROM {_SCORE} THEN 'reward' END, CASE WHEN rollout_log_probs IS NULL OR len(rollout_log_probs) <> response_length THEN 'log_prob_length' END,
  CASE WHEN len(list_filter(rollout_log_probs, lambda v: v IS NULL OR NOT isfinite(v))) > 0 THEN 'log_prob_value' END]) AS rule FROM a)
SELECT DISTINCT * FROM x WHERE rule IS NOT NULL""",
    "trainer_handoff": f"""WITH {_S}, g AS (SELECT group_index, avg(reward) AS m, stddev_samp(reward) AS d FROM s GROUP BY group_index),
x AS (SELECT s.* FROM s JOIN g ON g.group_index IS NOT DISTINCT FROM s.group_index WHERE response_length > 0 AND len(rollout_log_probs) = response_length AND reward IS NOT NULL AND d IS NOT NULL)
SELECT index AS position, unnest(CASE index % 11 WHEN 1 THEN ['position_missing'] WHEN 2 THEN ['sample_index'] WHEN 3 THEN ['response_length'] WHEN 4 THEN ['reward'] WHEN 5 THEN ['advantages'] WHEN 6 THEN ['log_probs'] ELSE [] END) AS rule FROM x""",
    "sample_features": """WITH l AS (SELECT CAST(index AS VARCHAR) AS key, 1 AS l, 0 AS r FROM (SELECT DISTINCT index FROM rollout_samples) UNION ALL SELECT CAST(sample_index AS VARCHAR), 0, 1 FROM (SELECT DISTINCT ON (feature_id) * FROM features))
SELECT key, CAST(sum(l) AS BIGINT) AS n_left, CAST(sum(r) AS BIGINT) AS n_right, CASE WHEN sum(r) = 0 THEN 'left_only' WHEN sum(l) = 0 THEN 'right_only' WHEN sum(l) = 1 AND sum(r) = 1 THEN 'one_to_one' ELSE 'repeated' END AS status FROM l GROUP BY key""",
    "exact_prompt_leaks": """WITH p AS (SELECT index, split, tokens[1:len(tokens) - response_length] AS p FROM rollout_samples WHERE response_length BETWEEN 0 AND len(tokens) - 1)
SELECT DISTINCT index, split FROM p WHERE split IN ('eval', 'test') AND p IN (SELECT p FROM p WHERE split = 'train')""",
    "array_changes": """WITH a AS (SELECT vec_id, embedding AS v FROM embeddings), b AS (SELECT vec_id + 1 AS vec_id, embedding AS v FROM embeddings),
j AS (SELECT coalesce(a.vec_id, b.vec_id) AS vec_id, a.v AS x, b.v AS y, a.vec_id IS NULL AS na, b.vec_id IS NULL AS nb FROM a FULL JOIN b ON a.vec_id = b.vec_id)
SELECT vec_id, CASE WHEN nb THEN 'before_only' WHEN na THEN 'after_only' WHEN len(x) <> len(y) THEN 'shape' WHEN x = y THEN 'equal' ELSE 'changed' END AS status,
  CASE WHEN len(x) = len(y) THEN len(list_filter(list_zip(x, y), lambda z: z[1] <> z[2])) END AS n_changed, CASE WHEN len(x) = len(y) THEN round(list_max(list_transform(list_zip(x, y), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))), 5) END AS largest FROM j""",
    "continuations": f"""WITH {_L} SELECT trace_id, sequence, turn_id, least(coalesce(i, len(h)), len(a)) AS shared, CASE WHEN i IS NOT NULL THEN 'prefix changes at ' || i || ' of ' || len(h) END AS change,
  {_TEXT('list_concat(h, a[least(len(h), len(a)) + 1:])')} AS continued_md5 FROM d""",
    "restored_replies": """WITH t AS (SELECT DISTINCT trace_id, session_id, branch_id, sequence, turn_id FROM trace WHERE record_type = 'generation' AND turn_id IS NOT NULL)
SELECT trace_id, session_id, branch_id, sequence, turn_id FROM t WHERE sequence > 0""",
    "prompt_lengths": f"WITH {_S} SELECT split, count(*) AS n, CAST(sum(len(tokens) - response_length) AS BIGINT) AS tokens, max(len(tokens) - response_length) AS longest, quantile_cont(len(tokens) - response_length, 0.95) AS p95 FROM s WHERE response_length BETWEEN 0 AND len(tokens) GROUP BY split",
}
