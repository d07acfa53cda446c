"""Traces: validity of their records, transitions to declared parents, and the roll-up to one verdict per trace."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.functions.arrays import history, valid_tokens
from turnledger.operators.contract import FOLLOWING, PREVIOUS, PRIORITY, check_transitions
from turnledger.operators.rules import first_broken
from turnledger.session import written

KEY = ("trace_id", "sequence")
SCOPE = ("trace_id", "session_id", "branch_id")
#: Children whose parents (about 200 bytes each) are sent to the tasks; beyond, they are joined.
SENT = 300_000


def record_error(has_parent_key: Column | None = None) -> Column:
    """The first rule that a trace record breaks, null for a valid one. has_parent_key: whether the record has the key
    parent_turn_id at all (in tables it always has)."""
    return first_broken(F.col, kind=F.col("record_type"), declared=has_parent_key)


def _same(left: str, right: str, columns: Sequence[str]) -> Column:
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return same


def _digest(tokens: Column) -> Column:
    return F.sha2(F.array_join(tokens.cast("array<string>"), ",", "-"), 256)


def transitions(records: DataFrame, *, sent: int = SENT) -> DataFrame:
    """One row per generation with a declared parent, in the form check_transitions needs.

    The parent is the first record of that turn in the same trace, session and branch, and must come earlier; a child
    without one keeps its row with an empty previous. Contract and evidence come from the child.

    Children find their parents without tokens: keys, lengths and the SHA-256 of what the parent left behind are joined,
    the parents' side reduced to one row per turn, so that its key is unique and skew of the other side can be split.
    A child whose input begins with tokens of that digest has the parent's tokens itself. Only for the others are the
    parents' tokens fetched. With up to ``sent`` children, what was found goes to where the tokens lie; beyond, the tokens
    of children, and those of parents to fetch, are moved once.
    """
    made = records.where(F.col("record_type") == "generation")
    link = ("session_id", "branch_id", "turn_id", "parent_turn_id")
    left_behind = history(F.col("input_ids"), F.col("output_ids"))
    sound = valid_tokens(F.col("input_ids")) & valid_tokens(F.col("output_ids"))
    narrow = F.struct("sequence", "token_space", F.size("input_ids").alias("n_in"), F.size("output_ids").alias("n_out"), F.when(sound, _digest(left_behind)).alias("digest"))
    first = made.where(F.col("turn_id").isNotNull()).groupBy(*SCOPE, "turn_id").agg(F.min_by(narrow, "sequence").alias("p"))
    child = made.where(F.col("parent_turn_id").isNotNull())
    keys = child.select("trace_id", "sequence", *link).distinct().alias("c")
    on = _same("c", "f", SCOPE) & (F.col("f.turn_id") == F.col("c.parent_turn_id")) & (F.col("f.p.sequence") < F.col("c.sequence"))
    met = keys.join(first.alias("f"), on).select(*(F.col(f"c.{c}") for c in ("trace_id", "sequence", *link)), "p")
    # no more parents are found, or fetched, than there are children; counting these reads two columns
    few = child.count() <= sent
    at_hand = F.broadcast if few else lambda df: written(df, "parents")
    near = at_hand(met)
    p = F.col("m.p")
    own = F.slice("c.input_ids", F.lit(1), p["n_in"] + p["n_out"])
    kept = F.coalesce((F.size(own) == p["n_in"] + p["n_out"]) & (_digest(own) == p["digest"]), F.lit(False))
    wide = child.alias("c").join(near.alias("m"), _same("c", "m", ("trace_id", "sequence", *link)), "left").select(*(F.col(f"c.{c}") for c in child.columns), F.col("m.p").alias("__p"), kept.alias("__kept"))
    # the parent's own tokens, where the child does not have them
    asked = at_hand(wide.where(~F.col("__kept") & F.col("__p").isNotNull()).select("trace_id", "session_id", "branch_id", F.col("parent_turn_id").alias("turn_id"), F.col("__p.sequence").alias("sequence")).distinct())
    whole = made.alias("a").join(asked.alias("l"), _same("a", "l", ("trace_id", "session_id", "branch_id", "turn_id", "sequence")), "left_semi")
    fetched = whole.groupBy(*SCOPE, "turn_id", "sequence").agg(F.first(F.struct("input_ids", "output_ids")).alias("t"))
    here, p = wide.alias("c"), F.col("c.__p")
    on = _same("c", "x", SCOPE) & (F.col("x.turn_id") == F.col("c.parent_turn_id")) & F.col("x.sequence").eqNullSafe(p["sequence"]) & ~F.col("c.__kept")
    joined = here.join(fetched.alias("x"), on, "left")
    ids = {"input_ids": F.slice("c.input_ids", F.lit(1), p["n_in"]), "output_ids": F.slice("c.input_ids", p["n_in"] + 1, p["n_out"])}
    ids = {c: F.when(F.col("c.__kept"), own).otherwise(F.col(f"x.t.{c}")) for c, own in ids.items()}
    before = {"session_id": F.col("c.session_id"), "branch_id": F.col("c.branch_id"), "turn_id": F.col("c.parent_turn_id"), "token_space": p["token_space"], **ids}
    previous = F.struct(*(F.when(p.isNotNull(), before[c]).alias(c) for c in PREVIOUS))
    following = F.struct(*(F.col("c.parent_turn_id" if x == "previous_turn_id" else f"c.{x}").alias(x) for x in FOLLOWING))
    return joined.select(
        *(F.col(f"c.{x}").alias(x) for x in ("trace_id", "sequence", "turn_id", "evidence_kind", "contract", "boundaries")),
        F.format_string("transition-%06d", F.col("c.sequence")).alias("case_id"), p["sequence"].alias("previous_sequence"), previous.alias("previous"), following.alias("following"),
    )


def verdicts(records: DataFrame, *, identities: bool = False) -> DataFrame:
    """The verdict of every transition, each once: deliveries are told apart only after the token arrays are gone. With
    identities also session_id, branch_id and previous_turn_id, the parent that the turn declares."""
    df = check_transitions(transitions(records))
    if identities:
        df = df.withColumns({c: F.col(f"following.{c}") for c in ("session_id", "branch_id", "previous_turn_id")})
    return df.drop("contract", "boundaries", "previous", "following").dropDuplicates(list(KEY))


def trace_errors(records: DataFrame) -> DataFrame:
    """Per trace the first rule it breaks as a whole (null for a valid one), with its counts. Redelivered records count
    once.

    Arrays are reduced to the record's own error before any shuffle, and every grouping is pre-aggregated; repeated
    turns are found over (trace, turn), so a trace that holds a third of all rows is no hot task.
    """
    narrow = ("record_type", "session_id", "branch_id", "turn_id", "parent_turn_id", "trace_version", "evidence_kind", "expected_generations", "generations", "capture_gaps")
    own = records.select(*KEY, *narrow, record_error().alias("__error")).dropDuplicates(list(KEY))
    turns = own.where(F.col("record_type") == "generation").groupBy(*SCOPE, "turn_id").agg(F.count("*").alias("n"))
    repeated = turns.groupBy("trace_id").agg(F.max("n").alias("most"))
    is_footer, made, gap = (F.col("record_type") == x for x in ("capture_complete", "generation", "capture_gap"))
    by = own.groupBy("trace_id").agg(
        F.count("*").alias("rows"),
        F.min_by("__error", F.when(F.col("__error").isNotNull(), F.coalesce("sequence", F.lit(-1)))).alias("record_error"),
        F.min("sequence").alias("low"), F.max("sequence").alias("high"),
        F.min("trace_version").alias("v0"), F.max("trace_version").alias("v1"),
        F.min("evidence_kind").alias("e0"), F.max("evidence_kind").alias("e1"),
        F.count_if(is_footer).alias("footers"), F.max(F.when(is_footer, F.col("sequence"))).alias("footer_at"),
        F.max_by(F.struct("expected_generations", "generations", "capture_gaps"), F.when(is_footer, F.col("sequence"))).alias("footer"),
        F.count_if(made).alias("made"), F.count_if(gap).alias("gaps"), F.count_if(made & F.col("parent_turn_id").isNull()).alias("roots"),
    )
    f = F.col("footer")
    agrees = (f["generations"] == F.col("made")) & (f["expected_generations"] == F.col("made")) & (f["capture_gaps"] == F.col("gaps"))
    error = (
        F.when(F.col("record_error").isNotNull(), F.concat(F.lit("record:"), F.col("record_error")))
        .when((F.col("low") != 0) | (F.col("high") != F.col("rows") - 1), "sequence_gap")
        .when(F.col("v0") != F.col("v1"), "version_changes")
        .when(F.col("e0") != F.col("e1"), "evidence_changes")
        .when((F.col("footers") > 1) | (F.col("footer_at") < F.col("high")), "after_footer")
        .when(F.coalesce(F.col("most"), F.lit(0)) > 1, "turn_repeated")
        .when((F.col("footers") == 1) & ~F.coalesce(agrees, F.lit(False)), "footer_counts")
    )
    return by.join(repeated, "trace_id", "left").select(
        "trace_id", error.alias("error"), (F.col("rows") - F.col("footers")).alias("records"), "roots", F.col("made").alias("generations"), "gaps",
        F.when(F.col("v1") == 2, F.when(F.col("footers") > 0, "complete").otherwise("missing")).alias("completion"),
    )


def capture_gaps(records: DataFrame) -> DataFrame:
    """Per trace with gaps: gaps, the (sequence, reason) of all of them in order, each once. Gaps are rare by nature; a trace
    of nothing but gaps is the one case in which its row is as long as the trace."""
    once = records.where(F.col("record_type") == "capture_gap").select("trace_id", "sequence", "reason").distinct()
    return once.groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct("sequence", "reason"))).alias("gaps"))


def trace_reports(records: DataFrame) -> DataFrame:
    """One verdict per trace. A broken trace is an ERROR whatever its transitions say; a gap, or a missing footer in
    version 2, makes anything but FAIL inconclusive; a trace without transitions is inconclusive."""
    found = verdicts(records).groupBy("trace_id").agg(
        F.count("*").alias("transitions"), *(F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in PRIORITY)
    )
    df = trace_errors(records).join(found, "trace_id", "left")
    n = {s: F.coalesce(F.col(f"n_{s.lower()}"), F.lit(0)) for s in PRIORITY}
    doubt = (F.col("gaps") > 0) | F.coalesce(F.col("completion") == "missing", F.lit(False))
    status = F.when(F.col("error").isNotNull(), "ERROR").when(n["FAIL"] > 0, "FAIL").when(doubt | (n["INCONCLUSIVE"] > 0), "INCONCLUSIVE")
    status = status.when(n["NOT_APPLICABLE"] > 0, "NOT_APPLICABLE").when(n["PASS"] > 0, "PASS").otherwise("INCONCLUSIVE")
    return df.select(
        "trace_id", status.alias("status"), "error", "records", "roots", "generations", "gaps", "completion",
        F.coalesce("transitions", F.lit(0)).alias("transitions"), *(n[s].alias(f"n_{s.lower()}") for s in PRIORITY),
    )
