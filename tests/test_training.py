import random

import pytest
from pyspark.sql import functions as F

from turnledger.functions.arrays import common_prefix, first_difference, labels_of
from turnledger.functions.scalars import answer_score, is_alias, is_close, is_digest, is_finite
from turnledger.operators.attribution import attribute, attribution_totals, retention
from turnledger.operators.batches import audit_batches, feature_error, pad_batches
from turnledger.operators.continuation import append_only, branch_replaced, continued, restored
from turnledger.operators.paired import bootstrap_interval, order_plan, pair_statistics, pairs_of, schedule_errors, trial_error
from turnledger.operators.ranking import ranked
from turnledger.operators.rounds import bijection, changed_arrays, leaked_prompts, normalised_rewards, sample_violations, step_continuity


def test_first_difference_against_python(spark):
    rng = random.Random(1)
    say = lambda: None if rng.random() < 0.05 else [rng.choice([1, 2, None]) if rng.random() < 0.1 else rng.randrange(3) for _ in range(rng.randrange(6))]
    rows = [(i, say(), say()) for i in range(300)]

    def brute(e, a):
        if e is None or a is None:
            return None
        return next((i for i, x in enumerate(e) if i >= len(a) or a[i] != x), None)

    df = spark.createDataFrame(rows, "i int, e array<bigint>, a array<bigint>")
    got = df.select("i", first_difference(F.col("e"), F.col("a")).alias("d"), common_prefix(F.col("e"), F.col("a")).alias("p"), append_only(F.col("e"), F.col("a")).alias("m")).collect()
    for r in got:
        _, e, a = rows[r["i"]]
        d = brute(e, a)
        assert r["d"] == d
        if e is not None and a is not None:
            assert r["p"] == (len(e) if d is None else min(d, len(a))) and (r["m"] is None) == (d is None)


def brute_attribution(turns, samples):
    sources = {}
    for s, t, i, o in turns:
        for k in range(len(o)):
            sources.setdefault((s, tuple((i + o)[: len(i) + k + 1])), []).append((t, k))
    out = {}
    for s, n, tokens, length, mask in samples:
        if tokens is None or length is None or not 0 <= length <= len(tokens):
            continue
        start = len(tokens) - length
        for p in range(start, len(tokens)):
            if mask is None or mask[p - start]:
                c = sources.get((s, tuple(tokens[: p + 1])), [])
                out[s, n, p - start] = (len(c), *(c[0] if len(c) == 1 else (None, None)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_attribution_against_dictionaries_of_prefixes(spark, seed):
    rng = random.Random(seed)
    say = lambda n: [rng.randrange(2) for _ in range(rng.randrange(1, n))]
    scopes = ["x", "y", None]
    turns = [(rng.choice(scopes), f"t{i}", say(4), say(5)) for i in range(40)]
    samples = []
    for i in range(60):
        tokens = rng.choice([say(8), *(t[2] + t[3] for t in turns)])
        n = rng.randrange(len(tokens) + 1)
        samples.append((rng.choice(scopes), i, tokens, n, rng.choice([None, [rng.randrange(2) for _ in range(n)]])))
    samples += [("x", 90, None, 1, None), ("x", 91, [1], 5, None), ("x", 92, [], 0, []), ("z", 93, [1, 0], 2, None)]
    t = spark.createDataFrame(turns, "s string, turn_id string, input_ids array<bigint>, output_ids array<bigint>")
    a = spark.createDataFrame(samples, "s string, sample_id int, tokens array<bigint>, response_length int, loss_mask array<int>")
    want = brute_attribution(turns, samples)
    got = {(r["s"], r["sample_id"], r["index"]): (r["candidates"], r["turn_id"], r["output_index"]) for r in attribute(t, a, scope=["s"]).collect()}
    assert got == want
    for r in attribution_totals(t, a, scope=["s"]).collect():
        own = [v for k, v in want.items() if k[0] == r["s"]]
        sources = [v[1:] for v in own if v[0] == 1]
        assert (r["trainable"], r["unmatched"], r["ambiguous"], r["duplicate"]) == (len(own), sum(v[0] == 0 for v in own), sum(v[0] > 1 for v in own), len(sources) - len(set(sources)))
        assert r["unaccounted"] == r["generated"] - len(set(sources))
    assert sum(r["represented"] for r in retention(t, a, scope=["s"]).collect()) == len({(k[0], *v[1:]) for k, v in want.items() if v[0] == 1})
    empty = attribution_totals(t.limit(0), a.limit(0), scope=["s"])
    assert empty.count() == 0


def test_features_and_batches(spark):
    rows = [
        (1, [5, 6, 7], [-100, 6, 7], None), (2, [5], [-100], "unsupervised"), (3, [], [], "no_tokens"), (4, None, None, "no_tokens"), (5, [5, 6], None, "no_labels"), (6, [5, 6], [-100], "label_length"),
        (7, [5, 6], [-100, 9], "foreign_label"), (8, [5, 6], [5, 6], "supervised_start"), (9, [5, -6], [-100, -6], "bad_token"), (10, [0] * 9, [-100] + [0] * 8, "too_long"), (11, [0, 0], [-100, 0], None),
    ]
    df = spark.createDataFrame(rows, "i int, input_ids array<bigint>, labels array<bigint>, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", feature_error(F.col("input_ids"), F.col("labels"), F.lit(8)).alias("got")).collect())
    good = df.where("want is null").select("i", F.lit(None).cast("int").alias("batch"), "input_ids", "labels")
    padded = pad_batches(good, batch=["batch"], pad=F.lit(0))
    got = {r["i"]: r for r in padded.collect()}
    assert got[11]["padded_ids"] == [0, 0, 0] and got[11]["attention_mask"] == [1, 1, 0] and got[11]["padded_labels"] == [-100, 0, -100] and got[1]["width"] == 3
    wrong = padded.withColumn("padded_labels", F.when(F.col("i") == 11, F.array(*[F.lit(-100).cast("bigint")] * 3)).otherwise(F.col("padded_labels"))).where("i = 11")
    audit = {r["i"]: r for r in audit_batches(padded, wrong, on=["i"], fields=["padded_ids", "attention_mask", "padded_labels"]).collect()}
    assert (audit[11]["mismatched"], audit[11]["removed"], audit[11]["unexpected"]) == ("padded_labels", 1, 0) and audit[1]["status"] == "MISMATCH"
    labels = spark.range(1).select(labels_of(F.array(*(F.lit(x).cast("bigint") for x in (1, 2, 3, 4))), F.lit(3), F.array(F.lit(1), F.lit(0), F.lit(1))).alias("y")).first()["y"]
    assert labels == [-100, 2, -100, 4]


def test_scores_and_scalars(spark):
    rows = [
        ("42", "42", 1.0), (" 42\n", "42", 1.0), ("\\boxed{42}", "42", 1.0), ("\\boxed {1} then \\boxed{ 1,234 }", "1234", 1.0), ("\\boxed{42", "42", 0.0), ("it is 42", "42", 0.0), ("12,34", "1234", 0.0),
        ("-7", "-7", 1.0), ("007", "7", 1.0), ("\\boxed{7.0}", "7", 0.0), ("", "0", 0.0), ("0", "-0", 1.0), (None, "1", None), ("1", None, None), ("+5", "5", 0.0), ("\\boxed{}", "1", 0.0), ("9" * 60, "9" * 60, 1.0),
    ]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, r string, l string, w double").select("i", answer_score(F.col("r"), F.col("l")).alias("s")).collect()
    assert {r["i"]: r["s"] for r in got} == {i: r[2] for i, r in enumerate(rows)}
    v = spark.createDataFrame([("a.b-c_9", "0" * 64, 1.0), ("x\n", "0" * 64 + "\n", float("nan")), ("", "A" * 64, float("inf")), (None, None, None), ("a" * 129, "", -1e308)], "a string, d string, x double")
    got = v.select(is_alias(F.col("a")).alias("a"), is_digest(F.col("d")).alias("d"), is_finite(F.col("x")).alias("x")).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, False, False), (False, False, False), (False, False, False), (False, False, True)]
    assert spark.range(1).select(is_close(F.lit(1.0), F.lit(1.000004), 5e-6)).first()[0] and not spark.range(1).select(is_close(F.lit(1.0), F.lit(1.00001), 5e-6)).first()[0]


def test_rounds(spark):
    s = spark.createDataFrame([(1, 0, 1.0), (2, 0, 0.0), (3, 1, 1.0), (4, None, 0.5), (5, None, None)], "index int, g int, reward double")
    got = {r["index"]: r["normalised"] for r in normalised_rewards(s, group=["g"]).collect()}
    assert got[1] == pytest.approx(0.5 / (0.5**0.5 + 1e-6)) and got[3] is None and got[4] is None and len(got) == 5
    rows = [
        (1, 0, [1, 2, 3], 1, "\\boxed{4}", "4", 1.0, False, ["1"], 0, [-0.5]), (2, None, None, 1, "4", "4", 0.0, True, ["2"], 0, None), (3, 0, [1, 2], 2, "x", "4", 0.0, False, None, 0, [float("nan"), -1.0]),
    ]
    df = spark.createDataFrame(rows, "index int, group_index int, tokens array<bigint>, response_length int, response string, label string, reward double, remove_sample boolean, weight_versions array<string>, rollout_id int, rollout_log_probs array<double>")
    got = {(r["index"], r["rule"]) for r in sample_violations(df).collect()}
    assert got == {(2, x) for x in ("tokens_missing", "group_missing", "removed", "weight_version", "reward", "log_prob_length")} | {(3, x) for x in ("response_length", "weight_version", "log_prob_value")}
    p = spark.createDataFrame([(1, "eval", [1, 2, 9], 1), (2, "train", [1, 2, 8], 1), (3, "test", [1, 3], 1), (4, "eval", None, 1), (5, "eval", [1], 4)], "index int, split string, tokens array<bigint>, response_length int")
    assert [r["index"] for r in leaked_prompts(p, held_out=("eval", "test")).collect()] == [1]
    keys = bijection(spark.createDataFrame([(1,), (2,), (2,), (None,)], "a int"), spark.createDataFrame([(1,), (3,)], "b int"), left_key="a", right_key="b")
    assert {r["key"]: r["status"] for r in keys.collect()} == {"1": "one_to_one", "2": "left_only", "3": "right_only", None: "left_only"}
    a = spark.createDataFrame([("x", [1.0, 2.0]), ("y", [1.0]), ("z", [1.0]), ("u", [1.0])], "n string, v array<float>")
    b = spark.createDataFrame([("x", [1.0, 2.5]), ("y", [1.0]), ("z", [1.0, 2.0]), ("w", [])], "n string, v array<float>")
    got = {r["n"]: (r["status"], r["n_changed"], r["largest"]) for r in changed_arrays(a, b, key="n", values="v").collect()}
    assert got == {"x": ("changed", 1, 0.5), "y": ("equal", 0, 0.0), "z": ("shape", None, None), "u": ("before_only", None, None), "w": ("after_only", None, None)}


def test_positions_and_steps(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), i, "clash") for i in rng.sample(range(500), 120)]
    got = ranked(spark.createDataFrame(rows, "g string, k int, part string").repartition(5), within=["g"], order=["k"]).collect()
    for g in ("a", "b", None):
        assert [r["position"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["k"])] == list(range(sum(x[0] == g for x in rows)))
    steps = spark.createDataFrame([("r", k, k // 2, k % 2, k if k < 3 else 0) for k in range(5)] + [("q", 0, 1, 0, 0)], "run string, k int, rollout int, step int, counter int")
    got = step_continuity(steps, run=["run"], order=["k"], rollout="rollout", step="step", counter="counter", per_round=2).collect()
    assert {(r["run"], r["k"]): r["continuous"] for r in got} == {("r", k): k < 3 for k in range(5)} | {("q", 0): False}
    assert ranked(spark.createDataFrame([], "g string, k int"), within=["g"], order=["k"]).count() == 0


def test_paired_measures(spark):
    rows = [("b", p, m, 10.0 + p + (2.0 if m == "on" else 0.0), "w") for p in range(4) for m in ("on", "off")]
    rows += [("c", p, m, 1.0, f"{m}{p}" if p == 1 else "w") for p in range(3) for m in ("on", "off")] + [("d", 0, "on", 1.0, "w")]
    t = spark.createDataFrame(rows, "bench string, pair int, mode string, seconds double, work string")
    got = {r["bench"]: r for r in pair_statistics(pairs_of(t, pair=["bench", "pair"], value="seconds", work="work"), by=["bench"]).collect()}
    assert (got["b"]["status"], got["b"]["delta_mean"], got["b"]["delta_median"], got["b"]["delta_percent"]) == ("COMPARABLE", 2.0, 2.0, pytest.approx(100 * 2 / 11.5))
    assert (got["c"]["status"], got["c"]["delta_mean"], got["c"]["n_mismatched"]) == ("NOT_COMPARABLE", None, 1) and got["d"]["status"] == "INCOMPLETE"
    assert bootstrap_interval([2.0] * 5) == (2.0, 2.0) and sorted(map(tuple, order_plan(6, 1))) == [("off", "on")] * 3 + [("on", "off")] * 3
    with pytest.raises(ValueError):
        order_plan(3, 0)
    trial = spark.createDataFrame(
        [("on", 1.0, 0.1, [0.1, 0.2], [1, 2], True), ("off", 1.0, 0.0, [], [1, 2], None), ("x", 1.0, 0.0, [], [1, 2], None), ("on", float("nan"), 0.0, [0.1, 0.1], [1, 2], True), ("on", 0.0, 0.0, [0.1, 0.1], [1, 2], True),
         ("off", 1.0, 0.5, [], [1, 2], None), ("on", 1.0, 0.0, [0.1], [1, 2], True), ("on", 1.0, 0.0, [0.1, -1.0], [1, 2], True), ("on", 1.0, 0.0, [0.1, 0.1], [1, 2], False), ("on", 1.0, 0.0, [0.1, 0.1], [1], True)],
        "mode string, elapsed_seconds double, finalize_seconds double, callback_seconds array<double>, turns array<int>, capture_complete boolean",
    )
    assert [r[0] for r in trial.select(trial_error()).collect()] == [None, None, "mode", "timing", "elapsed", "off_arm_collected", "callbacks", "callback_timing", "incomplete", "turns"]
    plan = spark.createDataFrame([(0, "on"), (1, "off"), (2, "on")], "p int, m string")
    assert sorted(r["p"] for r in schedule_errors(spark.createDataFrame([(0, "on"), (1, "on"), (3, "on")], "p int, m string"), plan, position="p", fields=["m"]).collect()) == [1, 2, 3]


def test_continuations(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 9, 4], 2)], "h array<bigint>, r array<bigint>, k int")
    assert df.select(continued(F.col("h"), F.col("r"), F.col("k"))).first()[0] == [1, 2, 3, 9, 4]
    t = spark.createDataFrame([("a {x} b {x}",), ("none",), (None,)], "t string").select(branch_replaced(F.col("t"), "{x}", "Y").alias("o"))
    assert [r["o"] for r in t.collect()] == ["a Y b {x}", None, None]
    m = spark.createDataFrame([("s", 1, "?", 7), ("s", 2, "?", 8), ("s", 4, "?", 9), (None, 1, "kept", 1)], "s string, n int, text string, more int")
    o = spark.createDataFrame([("s", 10, "first"), ("s", 20, "second"), ("t", 1, "x")], "s string, n int, text string")
    got = {(r["s"], r["n"]): (r["text"], r["more"]) for r in restored(m, o, scope=["s"], order="n", content="text").collect()}
    assert got == {("s", 4): ("second", 9), ("s", 2): ("first", 8), ("s", 1): ("?", 7), (None, 1): ("kept", 1)}


def test_bootstrap_and_schedule_of_every_benchmark(spark, tmp_path):
    from collections import defaultdict

    import numpy as np

    from turnledger.operators.paired import PRIME, WEIGHT_FROM, bootstrap_by_hash
    from turnledger.plans import measures

    n = 4_460  # 50 benchmarks of 44 or 45 pairs
    rows = [(i, float(i * 7919 % 101), "t") for i in range(n) if i != 9]
    spark.createDataFrame(rows, "event_id bigint, value double, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    pairs = pairs_of(measures._trials(spark, str(tmp_path)), pair=["bench", "pair"], value="elapsed_seconds").where("complete")

    def weight(k, r):
        x = pow(k * 48271 + r * 69621 + 11, 3, PRIME)
        x = pow(x + k * 40692 + r * 12211, 3, PRIME)
        return sum(x >= w for w in WEIGHT_FROM)

    value, deltas, arms, keys = {i: v for i, v, _ in rows}, defaultdict(list), defaultdict(list), defaultdict(list)
    for p in range(n // 2):
        if 2 * p in value and 2 * p + 1 in value:
            deltas[p % 50].append(value[2 * p + 1] - value[2 * p])
            keys[p % 50].append(p)
        arms[p % 50] += [m for i, m in ((2 * p, "off"), (2 * p + 1, "on")) if i in value]
    got = {r["bench"]: (r["low"], r["high"], r["n_resamples"]) for r in bootstrap_by_hash(pairs, value="delta", order="pair", resamples=30, by=["bench"]).collect()}
    assert set(got) == set(range(50))
    seen = []
    for b, d in deltas.items():
        means = []
        for r in range(30):
            w = [weight(k, r) for k in keys[b]]
            seen += w
            means.append(np.average(d, weights=w))
        assert got[b] == pytest.approx((*np.quantile(means, (0.025, 0.975)), 30))
    # Poisson with mean 1
    assert np.mean(seen) == pytest.approx(1, abs=0.02) and np.var(seen) == pytest.approx(1, abs=0.03) and np.mean(np.array(seen) == 0) == pytest.approx(np.exp(-1), abs=0.01)
    plan = [m for arms in order_plan(20, 0) for m in arms]
    want = {(b, i) for b, a in arms.items() for i in range(-(-len(a) // 40) * 40) if i >= len(a) or a[i] != plan[i % 40]}
    assert {(r["bench"], r["position"]) for r in measures.schedule(spark, str(tmp_path)).collect()} == want and max(i for _, i in want) > 40


def test_bootstrap_bounds_do_not_hang_on_the_order_of_addition(spark):
    import math
    from fractions import Fraction

    from turnledger.operators.paired import PRIME, WEIGHT_FROM, bootstrap_by_hash

    pick = random.Random(5).choice
    groups = {
        "mixed": [(k, pick((1e16, -1e16, 0.1, 3.7, -2.5e-9, 1.0))) for k in range(60)], None: [(k, pick((0.1, 0.2, -0.3, 122.79 - 29.27))) for k in range(60, 90)],
        "wide": list(enumerate((1.7e308, 1.7e308, -1.7e308, 5e-324, -3e-310, 0.0))), "one": [(PRIME + 7, -0.1)],
        "inf": list(enumerate((math.inf, 1.0, 2.0))), "nan": list(enumerate((1.0, math.nan, 2.0))), "both": list(enumerate((math.inf, -math.inf))),
    }
    rows = [(g, k, v) for g, l in groups.items() for k, v in l] + [("mixed", 70, None), ("mixed", None, 5.0), ("none", 1, None)]
    pairs = spark.createDataFrame(rows, "g string, k bigint, v double")

    def weight(k, r):
        x = pow(k * 48271 + r * 69621 + 11, 3, PRIME)
        x = pow(x + k * 40692 + r * 12211, 3, PRIME)
        return sum(x >= w for w in WEIGHT_FROM)

    def bounds(rows):
        means = []
        for r in range(50):
            if n := sum(weight(k, r) for k, _ in rows):
                means.append(sum((Fraction(v) * weight(k, r) for k, v in rows), Fraction(0)) / n)
        means.sort()
        for q in (0.025, 0.975):
            at = (len(means) - 1) * q
            a, b = means[math.floor(at)], means[math.ceil(at)]
            yield float(a + (b - a) * Fraction(at - math.floor(at)))
        yield len(means)

    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 5):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = {r["g"]: tuple(r)[1:] for r in bootstrap_by_hash(pairs, value="v", order="k", resamples=50, by=["g"]).collect()}
            assert set(got) == set(groups)
            for g in ("mixed", None, "wide", "one"):
                assert got[g] == tuple(bounds(groups[g])), g
            assert got["inf"][1] == math.inf and math.isfinite(got["inf"][0]) and math.isnan(got["nan"][1]) and got["both"][0] == -math.inf and math.isnan(got["both"][1])
            whole = bootstrap_by_hash(pairs.where("g is null"), value="v", order="k", resamples=50).collect()
            assert [tuple(r) for r in whole] == [got[None]]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
