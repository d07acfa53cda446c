"""Supervised features and right-padded batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.functions.arrays import IGNORED, count_where, padded, valid_tokens


def feature_error(input_ids: Column, labels: Column, max_length: Column | None = None) -> Column:
    """The first rule a feature breaks: ids there and valid, labels of their length, each label ignored or its own token,
    the first ignored, one supervised at least, not longer than max_length. Null for a good one."""
    own = F.forall(F.arrays_zip(input_ids.alias("x"), labels.alias("y")), lambda z: F.coalesce((z["y"] == IGNORED) | (z["y"] == z["x"]), F.lit(False)))
    rule = (
        F.when(input_ids.isNull() | (F.size(input_ids) == 0), "no_tokens")
        .when(~valid_tokens(input_ids), "bad_token")
        .when(labels.isNull(), "no_labels")
        .when(F.size(labels) != F.size(input_ids), "label_length")
        .when(~own, "foreign_label")
        .when(F.element_at(F.slice(labels, 1, 1), 1) != IGNORED, "supervised_start")
        .when(count_where(labels, lambda y: y != IGNORED) == 0, "unsupervised")
    )
    return rule if max_length is None else rule.when(F.size(input_ids) > max_length, "too_long")


def with_widths(sizes: DataFrame, *, batch: list[str], size: str = "size") -> DataFrame:
    """Rows without tokens (batch, size, and what names a feature) with width, the greatest size of their batch, which a
    batch's own bound keeps small."""
    return sizes.withColumn("width", F.max(size).over(Window.partitionBy(*batch)))


def pad_batches(features: DataFrame, *, batch: list[str], pad: Column) -> DataFrame:
    """features (input_ids, labels) with width, attention_mask and both arrays right-padded to the longest of the batch.

    Rows that have their width already (with_widths, before the tokens joined) stay where they are; else one shuffle by
    batch gives it. Padding is not supervised; a real end token keeps its label even if it equals the pad token.
    """
    size = F.size("input_ids")
    joined = features if "width" in features.columns else with_widths(features.withColumn("__size", size), batch=batch, size="__size").drop("__size")
    width = F.col("width")
    return joined.withColumns(
        {
            "attention_mask": F.concat(F.array_repeat(F.lit(1), size), F.array_repeat(F.lit(0), width - size)),
            "padded_ids": padded(F.col("input_ids"), width, pad.cast("bigint")),
            "padded_labels": padded(F.col("labels"), width, F.lit(IGNORED).cast("bigint")),
        }
    )


def audit_batches(expected: DataFrame, actual: DataFrame, *, on: list[str], fields: list[str]) -> DataFrame:
    """Row by row, which fields of an actual batch differ from the expected one: on, mismatched (names in order),
    status, expected_supervised, unexpected and removed (supervised positions). Rows on one side only mismatch in all."""
    e, a = expected.alias("e"), actual.alias("a")
    joined = e.join(a, [F.col(f"e.{c}") == F.col(f"a.{c}") for c in on], "full")
    differs = F.array_compact(F.array(*(F.when(~F.col(f"e.{f}").eqNullSafe(F.col(f"a.{f}")), F.lit(f)) for f in fields)))
    pairs = F.arrays_zip(F.col("e.padded_labels").alias("x"), F.col("a.padded_labels").alias("y"))
    supervised = lambda c: F.coalesce(c != IGNORED, F.lit(False))
    return joined.select(
        *(F.coalesce(f"e.{c}", f"a.{c}").alias(c) for c in on),
        F.array_join(differs, ",").alias("mismatched"),
        F.when(F.size(differs) > 0, "MISMATCH").otherwise("MATCHED").alias("status"),
        count_where(F.col("e.padded_labels"), lambda y: y != IGNORED).alias("expected_supervised"),
        F.size(F.filter(pairs, lambda z: supervised(z["y"]) & ~supervised(z["x"]))).alias("unexpected"),
        F.size(F.filter(pairs, lambda z: supervised(z["x"]) & ~supervised(z["y"]))).alias("removed"),
    )
