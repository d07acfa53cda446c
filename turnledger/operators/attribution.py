"""Which sampled token each trained position is.

A trained position belongs to a sampled token if the token and the entire context before it are equal. Both sides are
keyed by a 128-bit hash of the context up to and with the token, so attribution is one equi-join of positions, linear
in the tokens; pairs of turns and samples are never formed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = x * np.uint64(2 * salt + 0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB + 2 * salt)
    return x ^ (x >> np.uint64(29))


def context_keys(values: np.ndarray, offsets: np.ndarray, seeds: np.ndarray, salt: int) -> np.ndarray:
    """For every value of every list a hash of the list's seed and of its values up to and with this one: a running sum
    of hashed (place, value) pairs."""
    sizes = np.diff(offsets)
    place = np.arange(1, len(values) + 1) - np.repeat(offsets[:-1], sizes)
    total = np.cumsum(_mixed(values.view(np.uint64) ^ _mixed(place.astype(np.uint64), salt + 7), salt))
    before = np.concatenate([np.zeros(1, np.uint64), total])[offsets[:-1]]
    return _mixed(total - np.repeat(before, sizes) + np.repeat(seeds.view(np.uint64), sizes), salt + 3)


def _positions(n_ids: int, names: Sequence[str]):
    """(ids..., tokens, first, mask or null, two seeds) to a row per position from first on whose mask is 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, masks = batch.column(n_ids), batch.column(n_ids + 2)
            offsets = np.asarray(tokens.offsets)
            values = tokens.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_numpy()
            offsets = (offsets - offsets[0]).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            index = np.arange(len(values)) - offsets[row] - batch.column(n_ids + 1).to_numpy()[row]
            keep = index >= 0
            plain = masks.is_null().to_numpy(zero_copy_only=False)
            if not plain.all():
                cuts = np.asarray(masks.offsets).astype(np.int64)
                bits = np.append(masks.values.fill_null(0).to_numpy(zero_copy_only=False), 0)
                at = cuts[row] + index
                inside = keep & (at < cuts[row + 1])
                keep &= plain[row] | (inside & (bits[np.where(inside, at, len(bits) - 1)] == 1))
            at = np.flatnonzero(keep)
            if len(at):
                keys = [context_keys(values, offsets, batch.column(n_ids + 2 + k).to_numpy(), k)[at] for k in (1, 2)]
                rows = pa.array(row[at])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(rows) for k in range(n_ids)), pa.array(index[at].astype(np.int32)), *(pa.array(k.view(np.int64)) for k in keys)], list(names)
                )

    return run


def _exploded(df: DataFrame, scope: Sequence[str], ids: Sequence[str], tokens, first, mask) -> DataFrame:
    names = [*ids, "index", "ka", "kb"]
    whole = [*(F.col(c) for c in scope), *(F.col(c).isNull() for c in scope)]  # a hash passes over nulls
    rows = df.select(
        *ids, tokens.cast("array<bigint>").alias("__t"), first.cast("bigint").alias("__f"), mask.cast("array<int>").alias("__m"),
        F.xxhash64(F.lit(1), *whole).alias("__a"), F.xxhash64(F.lit(2), *whole).alias("__b"),
    )
    rows = rows.where(F.col("__t").isNotNull() & ~F.exists("__t", lambda x: x.isNull()) & (F.col("__f") >= 0))
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in ids] + [T.StructField("index", T.IntegerType()), T.StructField("ka", T.LongType()), T.StructField("kb", T.LongType())])
    return rows.mapInArrow(_positions(len(ids), names), schema)


def attribute(turns: DataFrame, samples: DataFrame, *, scope: Sequence[str]) -> DataFrame:
    """A row per trained position: scope, sample_id, index (in the response), candidates, and turn_id and output_index of
    the candidate if there is just one.

    turns: scope, turn_id, input_ids, output_ids. samples: scope, sample_id, tokens, response_length, loss_mask (0 or 1
    per response token; null for all ones). Rows with null or impossible arrays take no part here; validity is for the
    caller to report. Scope columns compare null-safely (the scope is part of the hashed context, so only samples carry
    it through the join). Equal sampled contexts stay ambiguous, they are never told apart by order.
    """
    scope = list(scope)
    made = _exploded(turns, scope, ["turn_id"], F.concat("input_ids", "output_ids"), F.size("input_ids"), F.lit(None))
    by_key = made.groupBy("ka", "kb").agg(F.count("*").alias("candidates"), F.min("turn_id").alias("turn_id"), F.min("index").alias("output_index"))
    usable = samples.where((F.col("response_length") >= 0) & (F.col("response_length") <= F.size("tokens")))
    trained = _exploded(usable, scope, [*scope, "sample_id"], F.col("tokens"), F.size("tokens") - F.col("response_length"), F.col("loss_mask"))
    one = F.col("candidates") == 1
    return trained.join(by_key, ["ka", "kb"], "left").select(
        *scope, "sample_id", "index", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.when(one, F.col("turn_id")).alias("turn_id"), F.when(one, F.col("output_index")).alias("output_index")
    )


def attribution_totals(turns: DataFrame, samples: DataFrame, *, scope: Sequence[str]) -> DataFrame:
    """Per scope that has turns or samples: generated, trainable, unmatched, ambiguous, duplicate and unaccounted tokens,
    and the status UNMATCHED, AMBIGUOUS, NO_TRAINABLE_TOKENS or MATCHED, in this order of precedence."""
    scope = list(scope)
    # per source (or none) first: what is trained twice is counted in the same pass
    found = attribute(turns, samples, scope=scope).withColumn("c", F.least("candidates", F.lit(2)))
    by_source = found.groupBy(*scope, "c", "turn_id", "output_index").agg(F.count("*").alias("n"))
    one = F.col("c") == 1
    trained = by_source.groupBy(*scope).agg(
        F.sum("n").alias("trainable"), F.sum(F.when(F.col("c") == 0, F.col("n"))).alias("unmatched"), F.sum(F.when(F.col("c") == 2, F.col("n"))).alias("ambiguous"),
        F.sum(F.when(one, F.col("n") - 1)).alias("duplicate"), F.count_if(one).alias("represented"),
    )
    made = turns.groupBy(*scope).agg(F.sum(F.size("output_ids")).alias("generated"))
    # long form and one grouping, so that scopes missing on a side stay
    columns = ("generated", "trainable", "unmatched", "ambiguous", "duplicate", "represented")
    part = lambda df, own: df.select(*scope, *(F.coalesce(F.col(c) if c in own else F.lit(0), F.lit(0)).cast("bigint").alias(c) for c in columns))
    whole = part(made, ("generated",)).unionByName(part(trained, columns[1:]))
    whole = whole.unionByName(part(samples.select(*scope).distinct(), ()))
    sums = whole.groupBy(*scope).agg(*(F.sum(c).alias(c) for c in columns))
    status = F.when(F.col("unmatched") > 0, "UNMATCHED").when(F.col("ambiguous") > 0, "AMBIGUOUS").when(F.col("trainable") == 0, "NO_TRAINABLE_TOKENS").otherwise("MATCHED")
    return sums.withColumns({"unaccounted": F.col("generated") - F.col("represented"), "status": status}).drop("represented")


def retention(turns: DataFrame, samples: DataFrame, *, scope: Sequence[str]) -> DataFrame:
    """Per turn: generated, represented (by just one candidate) and unaccounted tokens."""
    scope = list(scope)
    found = attribute(turns, samples, scope=scope).where(F.col("candidates") == 1)
    represented = found.groupBy(*scope, "turn_id").agg(F.count_distinct("output_index").alias("represented"))
    on = F.col("a.turn_id") == F.col("b.turn_id")
    for c in scope:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    n = F.coalesce("b.represented", F.lit(0))
    return turns.select(*scope, "turn_id", F.size("output_ids").alias("generated")).alias("a").join(represented.alias("b"), on, "left").select(
        *(F.col(f"a.{c}").alias(c) for c in scope), "a.turn_id", "a.generated", n.alias("represented"), (F.col("a.generated") - n).alias("unaccounted")
    )


def sample_counts(samples: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Per sample its tokens and its trainable tokens (response tokens whose mask is 1, all of them without a mask; 0 is a
    count). Impossible lengths have none."""
    n = F.col("response_length")
    trained = F.when(F.col("loss_mask").isNull(), n).otherwise(F.size(F.filter(F.slice("loss_mask", 1, n), lambda b: b == 1)))
    fits = F.coalesce((n >= 0) & (n <= F.size("tokens")), F.lit(False))
    return samples.select(*keys, F.size("tokens").alias("tokens"), F.when(fits, trained).otherwise(0).cast("bigint").alias("trainable_tokens"))
