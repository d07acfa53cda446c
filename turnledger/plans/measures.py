"""Queries of paired statistics, schedules, step counters and set predicates, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.operators.paired import PRIME, WEIGHT_FROM, bootstrap_by_hash, order_plan, pair_statistics, pairs_of, schedule_errors, trial_error
from turnledger.operators.ranking import ranked
from turnledger.operators.rounds import step_continuity
from turnledger.session import table


def _trials(spark: SparkSession, folder: str) -> DataFrame:
    """Events as trials: two in a row are a pair of arms. In every tenth benchmark the type of an event is its work."""
    e = table(spark, folder, "events")
    pair, mode = F.floor(F.col("event_id") / 2), F.when(F.col("event_id") % 2 == 0, "off").otherwise("on")
    return e.select((pair % 50).alias("bench"), pair.alias("pair"), mode.alias("mode"), F.col("value").alias("elapsed_seconds"), F.when(pair % 10 == 3, F.col("event_type")).alias("work"), "event_type")


def paired_deltas(spark: SparkSession, folder: str) -> DataFrame:
    pairs = pairs_of(_trials(spark, folder), pair=["bench", "pair"], value="elapsed_seconds", work="work")
    df = pair_statistics(pairs, by=["bench"])
    return df.select("bench", "status", "n_pairs", "n_incomplete", "n_mismatched", *(F.round(c, 6).alias(c) for c in df.columns if c.endswith(("_mean", "_median", "_percent"))))


def mismatched_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs whose arms saw different event types: what makes a benchmark not comparable."""
    pairs = pairs_of(_trials(spark, folder), pair=["bench", "pair"], value="elapsed_seconds", work="event_type")
    return pairs.where("complete").groupBy("bench").agg(F.count("*").alias("n_pairs"), F.count_if(~F.col("same_work")).alias("n_mismatched"))


def value_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("event_type").agg(
        F.median("value").alias("median"), F.percentile("value", F.lit(0.95)).alias("p95"), F.min("value").alias("least"), F.max("value").alias("most")
    )


def bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """Per benchmark the interval of the mean delta of its complete pairs."""
    pairs = pairs_of(_trials(spark, folder), pair=["bench", "pair"], value="elapsed_seconds").where("complete")
    df = bootstrap_by_hash(pairs, value="delta", order="pair", resamples=10_000, by=["bench"])
    return df.select("bench", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n_resamples")


def schedule(spark: SparkSession, folder: str) -> DataFrame:
    """Where the arms of each benchmark's trials differ from balanced plans of twenty pairs, one after the other."""
    plan = [m for arms in order_plan(20, 0) for m in arms]
    t = table(spark, folder, "events").select((F.floor(F.col("event_id") / 2) % 50).alias("bench"), "event_id", F.when(F.col("event_id") % 2 == 0, "off").otherwise("on").alias("mode"))
    actual = ranked(t, within=["bench"], order=["event_id"])
    # every benchmark is to run whole plans
    rounds = actual.groupBy("bench").agg(F.floor(F.max("position") / len(plan)).alias("last"))
    expected = rounds.select("bench", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("round")).select(
        "bench", "round", F.posexplode(F.array(*map(F.lit, plan))).alias("i", "mode")
    )
    expected = expected.select("bench", (F.col("round") * len(plan) + F.col("i")).alias("position"), "mode")
    return schedule_errors(actual, expected, position="position", fields=["mode"], by=["bench"])


def trial_errors(spark: SparkSession, folder: str) -> DataFrame:
    t = _trials(spark, folder)
    i = F.col("pair") % 23
    on = F.col("mode") == "on"
    df = t.select(
        "pair", F.when(i == 1, "both").otherwise(F.col("mode")).alias("mode"), F.when(i == 2, -1.0).when(i == 3, float("nan")).otherwise(F.col("elapsed_seconds") + 1).alias("elapsed_seconds"),
        F.when(on | (i == 4), 0.1).otherwise(0.0).alias("finalize_seconds"), F.when(on & (i != 5), F.array(F.lit(0.1), F.when(i == 6, -0.5).otherwise(0.2))).otherwise(F.array().cast("array<double>")).alias("callback_seconds"),
        F.when(i == 7, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2))).alias("turns"), (on & (i != 8)).alias("capture_complete"),
    )
    return df.groupBy(trial_error().alias("error")).agg(F.count("*").alias("n"))


def step_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of each customer as optimizer records: two steps a round, a counter that a restart resets."""
    p = F.col("position")
    o = ranked(table(spark, folder, "orders").select("o_custkey", "o_orderkey"), within=["o_custkey"], order=["o_orderkey"])
    records = o.select("o_custkey", "o_orderkey", F.floor(p / 2).alias("rollout_id"), (p % 2).alias("step_id"), F.when(F.col("o_custkey") % 5 == 0, p % 3).otherwise(p).alias("counter"))
    df = step_continuity(records, run=["o_custkey"], order=["o_orderkey"], rollout="rollout_id", step="step_id", counter="counter", per_round=2)
    return df.groupBy("o_custkey").agg(F.count("*").alias("n_steps"), F.bool_and("continuous").alias("continuous"), F.min(F.when(~F.col("continuous"), F.col("position"))).alias("first_break"))


def set_predicates(spark: SparkSession, folder: str) -> DataFrame:
    """Key sets of two sides compared: equal, one inside the other, overlapping or disjoint, each key once."""
    t = lambda n: table(spark, folder, n)
    sides = {
        "customers of orders": (t("customer").select(F.col("c_custkey").alias("k")), t("orders").select(F.col("o_custkey").alias("k"))),
        "runs of features": (t("run_result").select(F.col("run_id").alias("k")), t("features").select(F.col("run_id").alias("k"))),
        "samples of features": (t("rollout_samples").select(F.col("index").alias("k")), t("features").select(F.col("sample_index").alias("k"))),
        "splits": (t("rollout_samples").where("split = 'train'").select(F.col("group_index").alias("k")), t("rollout_samples").where("split = 'eval'").select(F.col("group_index").alias("k"))),
    }
    long = None
    for name, (a, b) in sides.items():
        for df, mark in ((a, 1), (b, 2)):
            part = df.where(F.col("k").isNotNull()).select(F.lit(name).alias("name"), F.col("k").cast("string").alias("k"), F.lit(mark).alias("mark"))
            long = part if long is None else long.unionByName(part)
    keys = long.groupBy("name", "k").agg(F.bit_or("mark").alias("m"))
    n = lambda m: F.count_if(F.col("m") == m)
    sums = keys.groupBy("name").agg(n(1).alias("left_only"), n(2).alias("right_only"), n(3).alias("in_both"))
    relation = F.when(F.col("in_both") == 0, "disjoint").when((F.col("left_only") == 0) & (F.col("right_only") == 0), "equal").when(F.col("left_only") == 0, "left_inside").when(F.col("right_only") == 0, "right_inside").otherwise("overlap")
    return sums.withColumn("relation", relation)


def run_durations(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "run_result").select("run_id", "state", "started_at", "finished_at").distinct()
    seconds = F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("finished_at")) / 1e6
    return runs.withColumn("s", seconds).groupBy("state").agg(
        F.count("*").alias("n"), F.count("s").alias("n_finished"), F.round(F.median("s"), 4).alias("median"), F.round(F.min("s"), 4).alias("least"), F.round(F.max("s"), 4).alias("most")
    )


QUERIES = {f.__name__: f for f in (paired_deltas, mismatched_pairs, value_percentiles, bootstrap, schedule, trial_errors, step_counters, set_predicates, run_durations)}

_P = "p AS (SELECT (event_id // 2) % 50 AS bench, event_id // 2 AS pair, max(value) FILTER (event_id % 2 = 1) AS on_, max(value) FILTER (event_id % 2 = 0) AS off_, count(*) AS c, count(DISTINCT event_type) AS k FROM events GROUP BY ALL)"
_PLAN = ", ".join(f"({i}, '{m}')" for i, m in enumerate(m for arms in order_plan(20, 0) for m in arms))
_WEIGHT = " + ".join(f"(h >= {x})::INT" for x in WEIGHT_FROM)
ORACLE = {
    "paired_deltas": f"""WITH {_P},
s AS (SELECT bench, count(*) FILTER (c = 2) AS n_pairs, count(*) FILTER (c <> 2) AS n_incomplete, count(*) FILTER (c = 2 AND k > 1 AND bench % 10 = 3) AS n_mismatched, avg(on_) AS a, avg(off_) AS b, avg(on_ - off_) AS d,
  median(on_) AS ma, median(off_) AS mb, median(on_ - off_) AS md FROM p GROUP BY bench),
t AS (SELECT *, CASE WHEN n_pairs < 2 OR n_incomplete > 0 THEN 'INCOMPLETE' WHEN n_mismatched > 0 THEN 'NOT_COMPARABLE' ELSE 'COMPARABLE' END AS status FROM s)
SELECT bench, status, n_pairs, n_incomplete, n_mismatched, {", ".join(f"CASE WHEN status = 'COMPARABLE' THEN round({x}, 6) END AS {n}" for x, n in (("a", "on_mean"), ("b", "off_mean"), ("d", "delta_mean"), ("ma", "on_median"), ("mb", "off_median"), ("md", "delta_median"), ("100 * d / b", "delta_percent")))} FROM t""",
    "mismatched_pairs": f"WITH {_P} SELECT bench, count(*) AS n_pairs, count(*) FILTER (k > 1) AS n_mismatched FROM p WHERE c = 2 GROUP BY bench",
    "value_percentiles": "SELECT event_type, median(value) AS median, quantile_cont(value, 0.95) AS p95, min(value) AS least, max(value) AS most FROM events GROUP BY event_type",
    "bootstrap": f"""WITH {_P}, d AS (SELECT bench, pair AS k, on_ - off_ AS v FROM p WHERE c = 2),
x AS (SELECT bench, k, v, r, (k * 48271 + r * 69621 + 11) % {PRIME} AS x FROM (SELECT *, unnest(range(0, 10000)) AS r FROM d)),
y AS (SELECT *, (x * x % {PRIME} * x % {PRIME} + k * 40692 + r * 12211) % {PRIME} AS y FROM x),
w AS (SELECT bench, r, v, y * y % {PRIME} * y % {PRIME} AS h FROM y),
m AS (SELECT bench, r, sum(v * ({_WEIGHT})) / sum({_WEIGHT}) AS m FROM w WHERE h >= {WEIGHT_FROM[0]} GROUP BY bench, r)
SELECT bench, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high, count(*) AS n_resamples FROM m GROUP BY bench""",
    "schedule": f"""WITH t AS (SELECT event_id, (event_id // 2) % 50 AS bench, CASE WHEN event_id % 2 = 0 THEN 'off' ELSE 'on' END AS mode FROM events),
a AS (SELECT bench, mode, row_number() OVER (PARTITION BY bench ORDER BY event_id) - 1 AS position FROM t),
n AS (SELECT bench, unnest(range(0, max(position) // 40 + 1)) AS turn FROM a GROUP BY bench),
e AS (SELECT bench, turn * 40 + i AS position, m FROM n, (VALUES {_PLAN}) AS x(i, m))
SELECT bench, position FROM e FULL JOIN a USING (bench, position) WHERE m IS DISTINCT FROM mode""",
    "trial_errors": """SELECT CASE i WHEN 1 THEN 'mode' WHEN 2 THEN 'elapsed' WHEN 3 THEN 'timing' WHEN 4 THEN CASE WHEN NOT on_ THEN 'off_arm_collected' END WHEN 5 THEN CASE WHEN on_ THEN 'callbacks' END
  WHEN 6 THEN CASE WHEN on_ THEN 'callback_timing' END WHEN 7 THEN 'turns' WHEN 8 THEN CASE WHEN on_ THEN 'incomplete' END END AS error, count(*) AS n
FROM (SELECT (event_id // 2) % 23 AS i, event_id % 2 = 1 AS on_ FROM events) GROUP BY ALL""",
    "step_counters": """WITH o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS p FROM orders), c AS (SELECT *, o_custkey % 5 <> 0 OR p < 3 AS ok FROM o)
SELECT o_custkey, count(*) AS n_steps, bool_and(ok) AS continuous, min(p) FILTER (NOT ok) AS first_break FROM c GROUP BY o_custkey""",
    "set_predicates": """WITH l AS (SELECT 'customers of orders' AS name, CAST(c_custkey AS VARCHAR) AS k, 1 AS m FROM customer UNION ALL SELECT 'customers of orders', CAST(o_custkey AS VARCHAR), 2 FROM orders
  UNION ALL SELECT 'runs of features', run_id, 1 FROM run_result UNION ALL SELECT 'runs of features', run_id, 2 FROM features
  UNION ALL SELECT 'samples of features', CAST(index AS VARCHAR), 1 FROM rollout_samples UNION ALL SELECT 'samples of features', CAST(sample_index AS VARCHAR), 2 FROM features
  UNION ALL SELECT 'splits', CAST(group_index AS VARCHAR), 1 FROM rollout_samples WHERE split = 'train' UNION ALL SELECT 'splits', CAST(group_index AS VARCHAR), 2 FROM rollout_samples WHERE split = 'eval'),
k AS (SELECT name, k, bit_or(m) AS m FROM l WHERE k IS NOT NULL GROUP BY ALL),
s AS (SELECT name, count(*) FILTER (m = 1) AS left_only, count(*) FILTER (m = 2) AS right_only, count(*) FILTER (m = 3) AS in_both FROM k GROUP BY name)
SELECT *, CASE WHEN in_both = 0 THEN 'disjoint' WHEN left_only = 0 AND right_only = 0 THEN 'equal' WHEN left_only = 0 THEN 'left_inside' WHEN right_only = 0 THEN 'right_inside' ELSE 'overlap' END AS relation FROM s""",
    "run_durations": """SELECT state, count(*) AS n, count(s) AS n_finished, round(median(s), 4) AS median, round(min(s), 4) AS least, round(max(s), 4) AS most
FROM (SELECT DISTINCT run_id, state, started_at, finished_at, (epoch_us(finished_at) - epoch_us(started_at)) / 1e6 AS s FROM run_result) GROUP BY state""",
}
