"""Scalar rules: identities, digests, numbers, rewards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The public forms of an alias, a digest and an integer answer.
ALIAS = r"\A[A-Za-z0-9_.-]{1,128}\z"
DIGEST = r"\A[0-9a-f]{64}\z"
ANSWER = r"\A-?(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)\z"
BOX = r"(?s)\A.*\\boxed\s*\{(.*)\z"


def is_alias(value: Column) -> Column:
    return F.coalesce(value.rlike(ALIAS), F.lit(False))


def is_digest(value: Column) -> Column:
    return F.coalesce(value.rlike(DIGEST), F.lit(False))


def filled(value: Column) -> Column:
    """Whether a string is there and not empty."""
    return F.coalesce(F.length(value) > 0, F.lit(False))


def is_finite(value: Column) -> Column:
    return F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.lit(False))


def is_close(a: Column, b: Column, absolute: float, relative: float = 1e-9) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def float32(value: Column) -> Column:
    """A double as it comes back from single precision."""
    return value.cast("float").cast("double")


def answer_score(response: Column, label: Column) -> Column:
    """1.0 if the response's answer is the label's integer, else 0.0; null if either is null.

    The answer is what stands in the last \\boxed{...}, else the whole response; it must be an integer, perhaps with
    thousands commas. An unclosed box scores 0.
    """
    text = F.trim(F.regexp_replace(response, r"\A\s+|\s+\z", ""))
    boxed = text.rlike(r"\\boxed\s*\{")
    body = F.regexp_extract(text, BOX, 1)
    closed = F.locate("}", body) > 0
    answer = F.when(boxed, F.regexp_replace(F.substring_index(body, "}", 1), r"\A\s+|\s+\z", "")).otherwise(text)
    whole = answer.rlike(ANSWER)
    plain = lambda c: F.regexp_replace(F.replace(c, F.lit(","), F.lit("")), r"\A(-?)0+(?=[0-9])", "$1")
    same = plain(answer).eqNullSafe(plain(label)) | (plain(answer).isin("0", "-0") & plain(label).isin("0", "-0"))
    good = F.when(boxed, closed & whole).otherwise(whole) & same
    return F.when(response.isNull() | label.isNull(), F.lit(None)).otherwise(good.cast("double"))
