"""Keeping a rendered conversation an exact continuation of what was sampled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.functions.arrays import common_prefix, first_difference
from turnledger.operators.ranking import ranked


def append_only(expected: Column, prompt: Column) -> Column:
    """Null if prompt starts with expected, else a message that names the first changed place."""
    at = first_difference(expected, prompt)
    return F.when(at.isNotNull(), F.format_string("prefix changes at %d of %d", at, F.size(expected)))


def continued(history: Column, rendered: Column, kept: Column) -> Column:
    """history followed by what comes after the first ``kept`` tokens of the re-rendered prompt."""
    return F.concat(history, F.slice(rendered, kept + 1, F.greatest(F.lit(0), F.size(rendered) - kept)))


def shared_prefix(df: DataFrame, a: str, b: str, name: str = "shared") -> DataFrame:
    return df.withColumn(name, common_prefix(F.col(a), F.col(b)))


def restored(messages: DataFrame, originals: DataFrame, *, scope: Sequence[str], order: str, content: str) -> DataFrame:
    """messages with each row's content replaced by the original of the same rank, counted from the newest (greatest
    ``order``, a number) of its scope; rows without an original keep theirs. Ranks are positions, contents are not
    compared. Null scopes are scopes."""
    newest = lambda df: ranked(df.withColumn("__back", -F.col(order)), within=scope, order=["__back"], name="__rank").drop("__back")
    m = newest(messages).alias("m")
    o = newest(originals.select(*scope, order, content)).select(*scope, "__rank", F.col(content).alias("__original")).alias("o")
    on = F.col("m.__rank") == F.col("o.__rank")
    for c in scope:
        on = on & F.col(f"m.{c}").eqNullSafe(F.col(f"o.{c}"))
    return m.join(o, on, "left").select(*(F.coalesce("o.__original", f"m.{c}").alias(c) if c == content else F.col(f"m.{c}").alias(c) for c in messages.columns))


def branch_replaced(text: Column, old: str, new: str) -> Column:
    """text with the first occurrence of old replaced; null if it does not occur."""
    at = F.locate(old, text)
    return F.when(at > 0, F.overlay(text, F.lit(new), at, F.lit(len(old))))
