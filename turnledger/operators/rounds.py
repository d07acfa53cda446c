"""Checks of reinforcement-learning rounds, evaluations, exported tensors and optimizer records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.functions.arrays import prompt_of
from turnledger.functions.scalars import answer_score, float32, is_close, is_finite
from turnledger.operators.ranking import ranked

#: Absolute tolerance of normalised rewards, and what is added to the deviation (fixed values of the training recipe).
TOLERANCE, EPSILON = 5e-6, 1e-6


def group_rewards(samples: DataFrame, *, group: Sequence[str], reward: str = "reward") -> DataFrame:
    """Per group: n, mean and sample deviation (null for one sample), and how many rewards differ."""
    return samples.groupBy(*group).agg(
        F.count(reward).alias("n"), F.avg(reward).alias("mean"), F.stddev_samp(reward).alias("deviation"), F.count_distinct(reward).alias("n_rewards")
    )


def normalised_rewards(samples: DataFrame, *, group: Sequence[str], reward: str = "reward") -> DataFrame:
    """samples with normalised = (reward - group mean) / (sample deviation + EPSILON); null in groups of one.

    The group statistics are pre-aggregated and joined back rather than windowed, so a hot group is no single task."""
    stats = group_rewards(samples, group=group, reward=reward)
    on = F.lit(True)
    for c in group:
        on = on & F.col(f"s.{c}").eqNullSafe(F.col(f"g.{c}"))
    return samples.alias("s").join(stats.alias("g"), on).select(
        "s.*", F.col("g.n").alias("group_size"), ((F.col(f"s.{reward}") - F.col("g.mean")) / (F.col("g.deviation") + EPSILON)).alias("normalised")
    )


def round_statistics(samples: DataFrame, *, round_: str, group: Sequence[str]) -> DataFrame:
    """Per round: groups whose rewards differ, samples with a nonzero advantage (normalised reward), the sum of rewards and
    the trainable (response) tokens. Null rounds are a round; the keys of a group include its round."""
    rows = normalised_rewards(samples, group=group)
    varied = group_rewards(samples, group=group).groupBy(round_).agg(F.count_if(F.col("n_rewards") > 1).alias("n_varied_groups"))
    fits = F.col("response_length").between(0, F.size("tokens"))
    sums = rows.groupBy(round_).agg(
        F.count_if(F.coalesce(F.abs("normalised") > 0, F.lit(False))).alias("n_nonzero"), F.sum("reward").alias("reward_sum"),
        F.coalesce(F.sum(F.when(fits, F.col("response_length"))), F.lit(0)).cast("bigint").alias("trainable"),
    )
    return varied.alias("v").join(sums.alias("s"), F.col(f"v.{round_}").eqNullSafe(F.col(f"s.{round_}"))).select("v.*", "s.n_nonzero", "s.reward_sum", "s.trainable")


def sample_violations(samples: DataFrame) -> DataFrame:
    """One row per sample and rule it breaks: index, rule. Needs the columns of rollout samples."""
    tokens, length, logs = F.col("tokens"), F.col("response_length"), F.col("rollout_log_probs")
    rules: dict[str, Column] = {
        "tokens_missing": tokens.isNull(),
        "response_length": length.isNull() | (length <= 0) | (length >= F.size(tokens)),
        "group_missing": F.col("group_index").isNull(),
        "removed": F.coalesce(F.col("remove_sample"), F.lit(False)),
        "weight_version": ~F.col("weight_versions").eqNullSafe(F.array((F.col("rollout_id") + 1).cast("string"))),
        "reward": ~F.col("reward").eqNullSafe(answer_score(F.col("response"), F.col("label"))),
        "log_prob_length": logs.isNull() | (F.size(logs) != length),
        "log_prob_value": F.exists(logs, lambda x: ~is_finite(x)),
    }
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))
    return samples.select("index", F.explode(broken).alias("rule")).distinct()


def handoff_violations(rollout: DataFrame, train: DataFrame) -> DataFrame:
    """Rollout samples against what the trainer got, by position: a full bijection, and equal in every field.

    rollout: position, index, tokens, response_length, reward, normalised, rollout_log_probs. train: rollout_position,
    sample_index, tokens, response_lengths, loss_masks, rewards, advantages, returns, rollout_log_probs. One row per
    position and rule; a repeated position breaks "position_repeated".
    """
    near = lambda values: F.forall(values, lambda v: F.coalesce(is_close(v, F.col("g.normalised"), TOLERANCE), F.lit(False)))
    once = train.groupBy("rollout_position").agg(F.count("*").alias("n"))
    g, t = rollout.alias("g"), train.join(once, "rollout_position").alias("t")
    both = g.join(t, F.col("g.position") == F.col("t.rollout_position"), "full")
    present = F.col("g.position").isNotNull() & F.col("t.rollout_position").isNotNull()
    n = F.col("g.response_length")
    rules = {
        "position_missing": F.col("t.rollout_position").isNull(),
        "position_unknown": F.col("g.position").isNull(),
        "position_repeated": F.col("t.n") > 1,
        "tokens": present & ~F.col("g.tokens").eqNullSafe(F.col("t.tokens")),
        "response_length": present & ~n.eqNullSafe(F.col("t.response_lengths")),
        "sample_index": present & ~F.col("g.index").eqNullSafe(F.col("t.sample_index")),
        "loss_mask": present & ~F.coalesce((F.size("t.loss_masks") == n) & F.forall("t.loss_masks", lambda b: b == 1), F.lit(False)),
        "log_probs": present & ~F.coalesce(F.transform("g.rollout_log_probs", float32) == F.transform("t.rollout_log_probs", lambda x: x.cast("double")), F.lit(False)),
        "reward": present & ~F.coalesce(is_close(F.col("t.rewards"), F.col("g.normalised"), TOLERANCE), F.lit(False)),
        "advantages": present & ~F.coalesce((F.size("t.advantages") == n) & near(F.col("t.advantages")), F.lit(False)),
        "returns": present & ~F.coalesce((F.size("t.returns") == n) & near(F.col("t.returns")), F.lit(False)),
    }
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items())))
    return both.select(F.coalesce("g.position", "t.rollout_position").alias("position"), F.explode(broken).alias("rule")).distinct()


def leaked_prompts(samples: DataFrame, *, held_out: Sequence[str], train: str = "train") -> DataFrame:
    """index and split of held-out samples whose whole prompt is also a training prompt. Prompts meet by their SHA-256."""
    prompt = prompt_of(F.col("tokens"), F.col("response_length"))
    digest = F.sha2(F.array_join(prompt.cast("array<string>"), ",", "-"), 256)
    prompts = samples.where(F.size(prompt) > 0).select("index", "split", digest.alias("prompt"))
    known = prompts.where(F.col("split") == train).select("prompt").distinct()
    return prompts.where(F.col("split").isin(*held_out)).join(known, "prompt", "left_semi").select("index", "split").distinct()


def bijection(left: DataFrame, right: DataFrame, *, left_key: str, right_key: str) -> DataFrame:
    """Keys of two sides with how often each side has them, in long form and one grouping; null keys keep a row."""
    long = left.select(F.col(left_key).cast("string").alias("key"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(F.col(right_key).cast("string").alias("key"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    sums = long.groupBy("key").agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))
    status = F.when(F.col("n_right") == 0, "left_only").when(F.col("n_left") == 0, "right_only").when((F.col("n_left") == 1) & (F.col("n_right") == 1), "one_to_one").otherwise("repeated")
    return sums.withColumn("status", status)


def changed_arrays(before: DataFrame, after: DataFrame, *, key: str, values: str) -> DataFrame:
    """Named arrays of two exports: status (equal, changed, shape, before_only, after_only), how many values changed and
    by how much at most."""
    a, b = before.select(F.col(key).alias("k"), F.col(values).alias("v")).alias("a"), after.select(F.col(key).alias("k"), F.col(values).alias("v")).alias("b")
    gap = F.zip_with("a.v", "b.v", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    status = (
        F.when(F.col("b.k").isNull(), "before_only").when(F.col("a.k").isNull(), "after_only").when(F.size("a.v") != F.size("b.v"), "shape").when(F.col("a.v") == F.col("b.v"), "equal").otherwise("changed")
    )
    same_shape = F.size("a.v") == F.size("b.v")
    return a.join(b, F.col("a.k") == F.col("b.k"), "full").select(
        F.coalesce("a.k", "b.k").alias(key), status.alias("status"), F.when(same_shape, F.size(F.filter(gap, lambda x: x > 0))).alias("n_changed"), F.when(same_shape, F.array_max(gap)).alias("largest")
    )


def step_continuity(records: DataFrame, *, run: Sequence[str], order: Sequence[str], rollout: str, step: str, counter: str, per_round: int) -> DataFrame:
    """records with position (from 0 within a run) and continuous: (rollout, step) is position divided by per_round, with
    remainder, and the counter equals the position."""
    p = F.col("position")
    good = (F.col(rollout) == F.floor(p / per_round)) & (F.col(step) == p % per_round) & (F.col(counter) == p)
    return ranked(records, within=run, order=order).withColumn("continuous", F.coalesce(good, F.lit(False)))
