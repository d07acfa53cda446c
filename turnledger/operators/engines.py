"""Rules over what an inference engine or a trainer reports: stop reasons, returned arrays, request settings, gradients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.functions.scalars import is_finite


def end_tokens(value: Column, many: Column) -> Column:
    """One end-of-sequence id or a list of them, as a list; null if neither is given."""
    return F.coalesce(many, F.when(value.isNotNull(), F.array(value)))


def ends_with_end_token(outputs: Column, ends: Column) -> Column:
    """Whether the last output is an end token; null if the end tokens are unknown, false without outputs."""
    return F.when(ends.isNotNull(), F.coalesce(F.array_contains(ends, F.get(outputs, F.size(outputs) - 1)), F.lit(False)))


def stop_reason(outputs: Column, ends: Column, limit: Column) -> Column:
    """eos, length or other."""
    return F.when(ends_with_end_token(outputs, ends), "eos").when(F.size(outputs) >= limit, "length").otherwise("other")


def returned_outputs(prompt: Column, returned: Column) -> Column:
    """What an engine that returns prompt and outputs in one array generated; null if it does not start with the prompt."""
    n = F.size(prompt)
    return F.when(F.slice(returned, F.lit(1), n) == prompt, F.slice(returned, n + 1, F.greatest(F.lit(0), F.size(returned) - n)))


def is_loopback(url: Column) -> Column:
    """Whether a URL is plain http to this host, without user, path, query or fragment."""
    host = F.regexp_extract(url, r"\Ahttp://(127\.0\.0\.1|localhost|\[::1\])(?::([0-9]{1,5}))?/?\z", 1)
    port = F.regexp_extract(url, r"\Ahttp://[^/]*?:([0-9]{1,5})/?\z", 1)
    return F.coalesce((host != "") & ((port == "") | F.coalesce(port.try_cast("int").between(1, 65535), F.lit(False))), F.lit(False))


def generation_mode_error(config: Column) -> Column:
    """Why a generation setting (VARIANT) is no plain sampling of one sequence from a decoder, null if it is."""
    get = lambda p, t: F.try_variant_get(config, f"$.{p}", t)
    more = lambda p: F.coalesce(get(p, "int") > 1, F.lit(False))
    there = lambda p: F.variant_get(config, f"$.{p}", "variant").isNotNull() & ~F.is_variant_null(F.variant_get(config, f"$.{p}", "variant"))
    on = lambda p: F.coalesce(get(p, "boolean"), F.lit(False))
    return (
        F.when(on("is_encoder_decoder"), "encoder_decoder").when(more("batch_size"), "batch").when(more("num_beams"), "beams").when(more("num_return_sequences"), "sequences")
        .when(there("stop_strings") | there("penalty_alpha") | on("token_healing"), "rewriting_decoder").when(on("return_dict_in_generate"), "rich_output")
        .when(~there("max_new_tokens"), "no_limit").when(~there("eos_token_id") | ~there("pad_token_id"), "no_end_or_pad").when(there("forced_bos_token_id") | there("forced_eos_token_id"), "forced_tokens")
    )


def gradient_errors(steps: DataFrame, *, run: Sequence[str], value: str, expected: int) -> DataFrame:
    """Per run the first rule its gradient norms break: their number, finite, not negative, some above 0."""
    v = F.col(value)
    sums = steps.groupBy(*run).agg(F.count("*").alias("n"), F.bool_and(is_finite(v)).alias("finite"), F.bool_and(F.coalesce(v >= 0, F.lit(False))).alias("positive"), F.bool_or(F.coalesce(v > 0, F.lit(False))).alias("some"))
    error = F.when(F.col("n") != expected, "count").when(~F.col("finite"), "not_finite").when(~F.col("positive"), "negative").when(~F.col("some"), "all_zero")
    return sums.select(*run, "n", error.alias("error"))


def zipped(left: DataFrame, right: DataFrame, *, scope: Sequence[str], order: str, fields: Sequence[str]) -> DataFrame:
    """Two ordered observations of the same scopes laid side by side: scope, position, error. Never across scopes; a side
    that ends early is missing_left or missing_right, else the first field that differs (null-safely)."""
    from turnledger.operators.ranking import ranked

    a = ranked(left.select(*scope, order, *fields), within=scope, order=[order]).alias("a")
    b = ranked(right.select(*scope, order, *fields), within=scope, order=[order]).alias("b")
    on = F.col("a.position") == F.col("b.position")
    for c in scope:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    error = F.when(F.col("a.position").isNull(), "missing_left").when(F.col("b.position").isNull(), "missing_right")
    for f in fields:
        error = error.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f)
    here = F.col("a.position").isNotNull()
    side = lambda c: F.when(here, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    return a.join(b, on, "full").select(*(side(c) for c in [*scope, "position"]), error.alias("error"))
