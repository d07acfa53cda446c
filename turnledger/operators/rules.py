"""The rules of trace records, stated once as a table and read in two ways: as column expressions over a table, and over
single records on the driver."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnledger.functions.arrays import valid_tokens
from turnledger.functions.scalars import DIGEST

# Fixed values of the record format and the contract.
RECORDS = ("generation", "capture_gap", "capture_complete")
GENERATION, GAP, FOOTER = RECORDS
VERSION = "history-prefix/v1"
EVIDENCE = ("synthetic", "controlled_upstream_transform", "observed_rollout")
MODES = ("unknown", "append_only", "history_rewrite")
POLICIES = ("unknown", "preserved", "truncated")
ORIGINS = ("captured", "derived")

_INT64 = range(2**63)
_exact = lambda x, values: any(type(x) is type(v) and x == v for v in values)
_ids = lambda x: isinstance(x, list) and all(type(i) is int and i in _INT64 for i in x)

#: What a value must be: as a column (null counts as broken) and as plain data (JSON types are told apart).
TESTS: dict[str, tuple[Callable, Callable]] = {
    "one of": (lambda x, *v: x.isin(*v), lambda x, *v: _exact(x, v)),
    "absent or one of": (lambda x, *v: x.isNull() | x.isin(*v), lambda x, *v: x is None or _exact(x, v)),
    "text": (lambda x: F.length(x) > 0, lambda x: isinstance(x, str) and x > ""),
    "null or text": (lambda x: x.isNull() | (F.length(x) > 0), lambda x: x is None or isinstance(x, str) and x > ""),
    "count": (lambda x: x >= 0, lambda x: type(x) is int and x in _INT64),
    "digest": (lambda x: x.rlike(DIGEST), lambda x: isinstance(x, str) and re.fullmatch(DIGEST.strip(r"\Az"), x) is not None),
    "tokens": (valid_tokens, _ids),
    "some": (lambda x: F.size(x) > 0, lambda x: len(x) > 0),
    "object": (lambda x: x.isNotNull(), lambda x: isinstance(x, dict)),
    "absent or list": (lambda x: F.lit(True), lambda x: x is None or isinstance(x, list) and all(isinstance(i, dict) for i in x)),
}

#: (error, kinds of record, field, test, arguments), in the order that decides which error a record has. "each" applies a
#: test to a field of every entry of a list, "distinct" wants that field to differ, "other than" names another field.
RULES = (
    ("version_or_type", RECORDS, "trace_version", "one of", 1, 2),
    ("version_or_type", RECORDS, "record_type", "one of", *RECORDS),
    ("trace_id", RECORDS, "trace_id", "text"),
    ("evidence_kind", RECORDS, "evidence_kind", "one of", *EVIDENCE),
    ("sequence", RECORDS, "sequence", "count"),
    ("footer_version", (FOOTER,), "trace_version", "one of", 2),
    *((f"footer_{c}", (FOOTER,), c, "count") for c in ("expected_generations", "generations", "capture_gaps")),
    ("footer_digest", (FOOTER,), "prefix_sha256", "digest"),
    ("gap_reason", (GAP,), "reason", "text"),
    *((c, (GENERATION,), c, "text") for c in ("session_id", "branch_id", "turn_id", "token_space")),
    ("parent_undeclared", (GENERATION,), "parent_turn_id", "declared"),
    ("parent_turn_id", (GENERATION,), "parent_turn_id", "null or text"),
    ("own_parent", (GENERATION,), "parent_turn_id", "other than", "turn_id"),
    *((c, (GENERATION,), c, "tokens") for c in ("input_ids", "output_ids")),
    ("output_empty", (GENERATION,), "output_ids", "some"),
    *((c, (GENERATION,), c, "object") for c in ("contract", "metadata", "termination")),
    ("boundaries", (GENERATION,), "boundaries", "absent or list"),
    ("boundary_name", (GENERATION,), "boundaries", "each", "name", "text"),
    ("boundary_name", (GENERATION,), "boundaries", "distinct", "name"),
    ("boundary_origin", (GENERATION,), "boundaries", "each", "origin", "one of", *ORIGINS),
    ("boundary_tokens", (GENERATION,), "boundaries", "each", "input_ids", "tokens"),
    ("boundary_token_space", (GENERATION,), "boundaries", "each", "token_space", "text"),
    ("contract_mode", (GENERATION,), "contract.mode", "absent or one of", *MODES),
    ("contract_policy", (GENERATION,), "contract.history_policy", "absent or one of", *POLICIES),
)


def _holds(x: Column, get: Callable[[str], Column], test: str, *args) -> Column:
    if test == "each":
        field, inner, *rest = args
        return x.isNull() | ~F.exists(x, lambda e: e.isNull() | ~_holds(e[field], get, inner, *rest))
    if test == "distinct":
        values = F.transform(x, lambda e: e[args[0]])
        return x.isNull() | (F.size(F.array_distinct(values)) == F.size(values))
    if test == "other than":
        return x.isNull() | get(args[0]).isNull() | (x != get(args[0]))
    return F.coalesce(TESTS[test][0](x, *args), F.lit(False))


def first_broken(get: Callable[[str], Column], rules: Iterable[tuple] = RULES, kind: Column | None = None, declared: Column | None = None) -> Column:
    """The error of the first rule that is broken, null if none is. get: a field's column. kind: the type of record, for
    which only its own rules count. declared: whether a generation names its parent at all (null for none)."""
    out = F.when(F.lit(False), "")
    for error, kinds, field, test, *args in rules:
        if test == "declared":
            if declared is None:
                continue
            good = declared
        else:
            good = _holds(get(field), get, test, *args)
        applies = F.lit(True) if kind is None or kinds == RECORDS else F.coalesce(kind.isin(*kinds), F.lit(False))
        out = out.when(applies & ~good, error)
    return out


def rules_on(*fields: str) -> tuple:
    return tuple(r for r in RULES if r[2].split(".")[0] in fields and r[0].startswith(("boundary_", "contract_")))


def problem_of(record: dict) -> str | None:
    """first_broken for one record as plain data."""

    def value(path: str):
        at = record
        for key in path.split("."):
            at = at.get(key) if isinstance(at, dict) else None
        return at

    def good(x, test: str, *args) -> bool:
        match test:
            case "declared":
                return "parent_turn_id" in record
            case "each":
                return x is None or all(good(e.get(args[0]), *args[1:]) for e in x)
            case "distinct":
                return x is None or len({e[args[0]] for e in x}) == len(x)
            case "other than":
                return x is None or x != value(args[0])
        return TESTS[test][1](x, *args)

    broken = (error for error, kinds, field, *how in RULES if record.get("record_type") in kinds or kinds == RECORDS if not good(value(field), *how))
    return next(broken, None)
