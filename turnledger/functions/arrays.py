"""Expressions over token arrays. All are built-in column expressions and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED = -100


def history(inputs: Column, outputs: Column) -> Column:
    """What a turn leaves behind: its input followed by its output; null if either is."""
    return F.concat(inputs, outputs)


def first_difference(expected: Column, actual: Column) -> Column:
    """Index of the first expected value that ``actual`` lacks or changes, null if all of expected is a prefix of it.

    Equal prefixes are settled by one array comparison; only the rest is walked.
    """
    kept = F.slice(actual, F.lit(1), F.size(expected)) == expected
    differs = F.transform(expected, lambda x, i: ~x.eqNullSafe(F.get(actual, i)))
    return F.when(expected.isNull() | actual.isNull() | kept, F.lit(None)).otherwise(F.array_position(differs, True) - 1).cast("int")


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading values two arrays share."""
    return F.least(F.coalesce(first_difference(a, b), F.size(a)), F.size(b))


def window_around(values: Column, index: Column, before: int, after: int, limit: Column | None = None) -> Column:
    """values[index - before : index + after], cut at the array's start and at limit."""
    start = F.greatest(F.lit(0), index - before)
    end = index + after if limit is None else F.least(index + after, limit)
    return F.slice(values, start + 1, F.greatest(F.lit(0), end - start))


def valid_tokens(values: Column) -> Column:
    """Whether an array is there and holds only non-negative ids. Without a lambda, which would not be compiled: to look
    for -1 gives null if there is a null, and the least value passes over nulls."""
    clean = F.coalesce(~F.array_contains(values, F.lit(-1)), F.lit(False))
    return clean & ((F.size(values) == 0) | (F.array_min(values) >= 0))


def joined(values: Column, separator: str = " ") -> Column:
    return F.array_join(values.cast("array<string>"), separator, "-")


def prompt_of(tokens: Column, response_length: Column) -> Column:
    """tokens without the last response_length; null where the length cannot be."""
    fits = (response_length >= 0) & (response_length <= F.size(tokens))
    return F.when(fits, F.slice(tokens, F.lit(1), F.size(tokens) - response_length))


def response_of(tokens: Column, response_length: Column) -> Column:
    fits = (response_length >= 0) & (response_length <= F.size(tokens))
    return F.when(fits, F.slice(tokens, F.size(tokens) - response_length + 1, response_length))


def labels_of(tokens: Column, response_length: Column, mask: Column | None = None) -> Column:
    """Unshifted labels: IGNORED over the prompt and where the mask is 0, the token itself elsewhere."""
    start = F.size(tokens) - response_length
    seen = lambda i: i >= start if mask is None else (i >= start) & (F.get(mask, (i - start).cast("int")) == 1)
    return F.transform(tokens, lambda x, i: F.when(seen(i), x).otherwise(F.lit(IGNORED).cast("bigint")))


def padded(values: Column, width: Column, fill: Column) -> Column:
    return F.concat(values, F.array_repeat(fill, (width - F.size(values)).cast("int")))


def count_where(values: Column, test) -> Column:
    return F.size(F.filter(values, test))
