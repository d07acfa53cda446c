"""Listed files against found ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_differences(listed: DataFrame, found: DataFrame, *, within: Sequence[str] = (), name: str = "name", fields: Sequence[str] = ("bytes", "sha256")) -> DataFrame:
    """Every file that is not on both sides exactly once with equal fields: within, name, problem (missing, unexpected,
    repeated, or the first field that differs)."""
    keys = [*within, name]
    long = listed.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("f"), *(F.col(c).cast("string").alias(c) for c in fields)).unionByName(
        found.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("f"), *(F.col(c).cast("string").alias(c) for c in fields))
    )
    sums = long.groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("f").alias("f"), *(F.count_distinct(F.coalesce(c, F.lit("-"))).alias(c) for c in fields))
    problem = F.when(F.col("f") == 0, "missing").when(F.col("l") == 0, "unexpected").when((F.col("l") > 1) | (F.col("f") > 1), "repeated")
    for c in fields:
        problem = problem.when(F.col(c) > 1, c)
    return sums.select(*keys, problem.alias("problem")).where(F.col("problem").isNotNull())


def same_keys(df: DataFrame, *, column: str, expected: Sequence[str]) -> DataFrame:
    """df with closed: whether a map column has exactly the expected keys."""
    return df.withColumn("closed", F.coalesce(F.array_sort(F.map_keys(column)) == F.array(*map(F.lit, sorted(expected))), F.lit(False)))


def summed_maps(df: DataFrame, *, by: Sequence[str], column: str) -> DataFrame:
    """Sums of the values of a map column per key, in long form: by, name, total."""
    return df.select(*by, F.explode(column).alias("name", "value")).groupBy(*by, "name").agg(F.sum("value").alias("total"))


def run_error() -> Column:
    """Why a run (exit_codes, oom, config and expected as maps, marker) is no evidence, null if it is: every process ended
    with 0, none ran out of memory, the configuration is the expected one key by key, and the marker of the end is there."""
    pairs = lambda c: F.array_sort(F.map_entries(c))
    ended = (F.size("exit_codes") > 0) & F.forall("exit_codes", lambda x: F.coalesce(x == 0, F.lit(False)))
    return (
        F.when(~F.coalesce(ended, F.lit(False)), "exit_code")
        .when(~F.coalesce(~F.col("oom"), F.lit(False)), "out_of_memory")
        .when(~F.coalesce(pairs("config").eqNullSafe(pairs("expected")) & F.col("config").isNotNull(), F.lit(False)), "config")
        .when(~F.coalesce(F.length("marker") > 0, F.lit(False)), "marker")
    )


def argument_error(steps: Column, stop_after: Column, device: Column, same_tokenizer: Column) -> Column:
    """Why a training run must not start, null if it may: at least one step, a stop within them, a known device, and the
    tokenizer of the data."""
    positive = F.coalesce(steps >= 1, F.lit(False))
    return (
        F.when(~positive, "steps")
        .when(stop_after.isNotNull() & ~stop_after.between(1, steps), "stop_after")
        .when(~F.coalesce(device.rlike(r"\A(cpu|cuda(:[0-9]+)?|mps)\z"), F.lit(False)), "device")
        .when(~F.coalesce(same_tokenizer, F.lit(False)), "tokenizer")
    )
