"""The history contract: does the next request keep, as an exact prefix, the tokens its parent turn left behind?

One row is one declared transition. The rules are tried in a fixed order and the first that applies decides; malformed
data is an ERROR before anything else, missing evidence is never a success.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.functions.arrays import first_difference, history, valid_tokens, window_around
from turnledger.operators.rules import EVIDENCE, VERSION, first_broken, rules_on

#: Statuses, most telling first, with the exit code of each.
PRIORITY = ("FAIL", "INCONCLUSIVE", "NOT_APPLICABLE", "PASS")
EXIT_CODES = {"PASS": 0, "FAIL": 1, "ERROR": 2, "INCONCLUSIVE": 3, "NOT_APPLICABLE": 4}
PREVIOUS = ("session_id", "branch_id", "turn_id", "token_space", "input_ids", "output_ids")
FOLLOWING = ("session_id", "branch_id", "previous_turn_id", "token_space", "input_ids")
BOUNDARY = "array<struct<name:string,origin:string,token_space:string,input_ids:array<bigint>>>"

#: Tokens shown before and after the first difference.
BEFORE, AFTER = 4, 5


def _bad_text(value: Column) -> Column:
    return value.isNotNull() & (F.length(value) == 0)


def _bad_ids(value: Column) -> Column:
    return value.isNotNull() & ~valid_tokens(value)


def nested_error(boundaries: Column, mode: Column, policy: Column) -> Column:
    """The first rule that boundaries or contract break, null if none."""
    return first_broken({"boundaries": boundaries, "contract.mode": mode, "contract.history_policy": policy}.__getitem__, rules_on("boundaries", "contract"))


def check_transitions(df: DataFrame) -> DataFrame:
    """Adds the verdict of each transition to df.

    Needs evidence_kind, contract (version, mode, history_policy), previous and following (structs of PREVIOUS and
    FOLLOWING; a null field is an absent one) and boundaries (BOUNDARY or null, in order). Adds status, reason, missing,
    expected_history_tokens, next_input_tokens, first_difference, localization, boundary_comparisons and evidence_gaps;
    what does not apply is null. Columns of these names must not exist yet. Rows stay as they are, one verdict each.
    """
    contract, before, after, marks = F.col("contract"), F.col("previous"), F.col("following"), F.col("boundaries")
    wrong = F.lit(None).cast("string")
    wrong = F.when(~F.coalesce(F.col("evidence_kind").isin(*EVIDENCE), F.lit(False)), "evidence_kind")
    for label, side, names in (("previous", before, PREVIOUS), ("following", after, FOLLOWING)):
        for c in names:
            bad = _bad_ids(side[c]) if c.endswith("_ids") else _bad_text(side[c])
            wrong = wrong.when(bad, f"{label}.{c}")
    wrong = F.coalesce(wrong, nested_error(marks, contract["mode"], contract["history_policy"]))
    absent = lambda label, side, names: [F.when(side[c].isNull(), F.lit(f"{label}.{c}")) for c in names]
    missing = F.array_compact(F.array(*absent("previous", before, PREVIOUS), *absent("following", after, FOLLOWING)))
    same = lambda c: before[c] == after[c]
    staged = df.withColumns({"__error": wrong, "__missing": missing, "__expected": history(before["input_ids"], before["output_ids"])})
    # rules 1 to 8; what is left is compared
    reason = (
        F.when(F.col("__error").isNotNull(), F.concat(F.lit("malformed:"), F.col("__error")))
        .when((contract["mode"] == "history_rewrite") | (contract["history_policy"] == "truncated"), "rewriting_permitted")
        .when(~contract["version"].eqNullSafe(F.lit(VERSION)) | ~contract["mode"].eqNullSafe(F.lit("append_only")), "contract_unsupported")
        .when(~contract["history_policy"].eqNullSafe(F.lit("preserved")), "retention_unknown")
        .when(F.size("__missing") > 0, "evidence_missing")
        .when(~same("session_id") | ~same("branch_id"), "scope_differs")
        .when(~same("token_space"), "token_space_differs")
        .when(before["turn_id"] != after["previous_turn_id"], "continuity_unknown")
        .when(F.size("__expected") == 0, "history_empty")
    )
    staged = staged.withColumn("__reason", reason)
    compared = F.col("__reason").isNull()
    staged = staged.withColumn("__at", F.when(compared, first_difference(F.col("__expected"), after["input_ids"])))
    at, expected, actual = F.col("__at"), F.col("__expected"), after["input_ids"]
    comparable = F.filter(F.coalesce(marks, F.array().cast(BOUNDARY)), lambda b: b["token_space"] == before["token_space"])
    comparisons = F.transform(
        comparable, lambda b: F.struct(b["name"].alias("name"), b["origin"].alias("origin"), first_difference(expected, b["input_ids"]).alias("first_difference"))
    )
    gaps = F.array_compact(
        F.transform(
            F.coalesce(marks, F.array().cast(BOUNDARY)),
            lambda b: F.when(b["token_space"] != before["token_space"], F.concat(b["name"], F.lit(":token_space"))).when(
                b["origin"] == "derived", F.concat(b["name"], F.lit(":derived"))
            ),
        )
    )
    staged = staged.withColumns({"boundary_comparisons": F.when(compared, comparisons), "evidence_gaps": F.when(compared, gaps)})
    captured = F.filter("boundary_comparisons", lambda b: b["origin"] == "captured")
    broken = F.array_position(F.transform(captured, lambda b: b["first_difference"].isNotNull()), True).cast("int")
    name = lambda i: F.get(F.transform(captured, lambda b: b["name"]), i)
    interval = F.struct(
        F.coalesce(F.when(broken > 0, F.when(broken > 1, name(broken - 2))).otherwise(F.when(F.size(captured) > 0, name(F.size(captured) - 1))), F.lit("previous.input_ids + previous.output_ids")).alias("after"),
        F.when(broken > 0, name(broken - 1)).otherwise("next.input_ids").alias("at_or_before"),
    )
    past = at >= F.size(actual)
    difference = F.struct(
        at.alias("index"),
        F.when(at < F.size(before["input_ids"]), "previous_input").otherwise("previous_output").alias("region"),
        F.get(expected, at).alias("expected_id"),
        F.get(actual, at).alias("actual_id"),
        F.when(past, "missing_suffix").otherwise("different_token").alias("kind"),
        F.greatest(F.lit(0), at - BEFORE).alias("window_start"),
        window_around(expected, at, BEFORE, AFTER).alias("expected_window"),
        window_around(actual, at, BEFORE, AFTER, F.size(expected)).alias("actual_window"),
    )
    why = F.col("__reason")
    status = (
        F.when(why.startswith("malformed:"), "ERROR")
        .when(why.isin("rewriting_permitted", "scope_differs", "token_space_differs"), "NOT_APPLICABLE")
        .when(why.isNotNull(), "INCONCLUSIVE")
        .when(at.isNull(), "PASS")
        .otherwise("FAIL")
    )
    return staged.withColumns(
        {
            "status": status,
            "reason": F.coalesce(why, F.when(at.isNull(), "prefix_kept").otherwise("prefix_changed")),
            "missing": F.when(why == "evidence_missing", F.col("__missing")),
            "expected_history_tokens": F.when(compared, F.size(expected)),
            "next_input_tokens": F.when(compared, F.size(actual)),
            "first_difference": F.when(at.isNotNull(), difference),
            "localization": F.when(at.isNotNull(), interval),
        }
    ).drop("__error", "__missing", "__expected", "__reason", "__at")
