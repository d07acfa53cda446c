"""Raw captures as tables: JSONL traces, single-JSON cases and handoff snapshots.

Files are read as bytes, so digests and offsets are those of what was captured. Parsing is strict: duplicate keys,
non-finite numbers, invalid UTF-8 and anything but an object at the root are errors of the record, never dropped rows.
Values keep their JSON types until they are checked: a token id must be an integer, not true, 1.0 or "1".
"""

from __future__ import annotations

import json
import math
import os
import stat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnledger.operators.contract import BOUNDARY, FOLLOWING, PREVIOUS, check_transitions
from turnledger.operators.traces import trace_reports, transitions, verdicts
from turnledger.session import written

# Fixed limits of the formats, in bytes.
MAX_CASE, MAX_TRACE = 16 * 1024 * 1024, 64 * 1024 * 1024
_CONTRACT = "struct<version:string,mode:string,history_policy:string>"


class CaptureError(ValueError):
    """An invalid or unsupported capture."""


def strict_object(raw: bytes) -> dict:
    """One JSON object, on the driver, by the same rules the tables follow."""

    def pairs(items: list[tuple]) -> dict:
        if len({k for k, _ in items}) < len(items):
            raise CaptureError("duplicate key")
        return dict(items)

    def number(text: str) -> float:
        value = float(text)
        if not math.isfinite(value):
            raise CaptureError("number out of range")
        return value

    def constant(text: str) -> None:
        raise CaptureError(f"{text} is no JSON number")

    if len(raw) > MAX_CASE:
        raise CaptureError("too large")
    try:
        value = json.loads(raw.decode("utf-8"), object_pairs_hook=pairs, parse_float=number, parse_constant=constant)
    except (ValueError, RecursionError) as error:
        raise error if isinstance(error, CaptureError) else CaptureError(f"no JSON: {error}") from error
    if not isinstance(value, dict):
        raise CaptureError("no object")
    return value


def read_regular(path: str, limit: int) -> bytes:
    """The bytes of a regular file that is no link, up to a limit. What is asked and what is read is the open file, which a
    change of the directory no longer touches; opening never waits for a pipe."""
    try:
        handle = os.open(path, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK)
    except OSError as error:
        raise CaptureError(f"cannot be opened as a file: {os.path.basename(path)}") from error
    with os.fdopen(handle, "rb") as stream:
        if not stat.S_ISREG(os.fstat(handle).st_mode):
            raise CaptureError(f"no regular file: {os.path.basename(path)}")
        raw = stream.read(limit + 1)
    if len(raw) > limit:
        raise CaptureError(f"larger than {limit} bytes: {os.path.basename(path)}")
    return raw


@F.pandas_udf(T.BooleanType())
def _holds(lines: pd.Series) -> pd.Series:
    def good(line: str | None) -> bool | None:
        if line is None:
            return None
        try:
            strict_object(line.encode())
        except (CaptureError, UnicodeError):
            return False
        return True

    return lines.map(good)


def raw_files(spark: SparkSession, path: str, limit: int = MAX_TRACE) -> DataFrame:
    """path, bytes, sha256, content and error of each file; content is null beyond the limit. Files beyond the limit are
    listed without being opened (the source cannot read those above 2 GB), so they are rows like all others. Spark's
    file source passes over empty files, which hold no records."""
    df = spark.read.format("binaryFile").load(path)
    small = df.where(F.col("length") <= limit).select("path", F.col("length").alias("bytes"), "content", F.sha2("content", 256).alias("sha256"), F.lit(None).cast("string").alias("error"))
    large = df.where(F.col("length") > limit).select("path", F.col("length").alias("bytes"), F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("sha256"), F.lit("too_large").alias("error"))
    return small.unionByName(large)


def parsed(text: Column, name: str = "v") -> tuple[Column, Column]:
    """A VARIANT of a JSON object (null if it is none) and the parse error. Numbers that could overflow, which the
    parser lets through as infinite, are parsed once more by the strict rules; other rows never reach Python."""
    v = F.try_parse_json(text)
    suspect = text.rlike(r"[eE]\+?[0-9]{3,}|[0-9]{300,}")
    error = (
        F.when(F.octet_length(text) > MAX_CASE, "too_large")
        .when(~F.is_valid_utf8(text), "utf8")
        .when(v.isNull(), "json")
        .when(~F.schema_of_variant(v).startswith("OBJECT"), "no_object")
        .when(suspect & ~_holds(F.when(suspect, text)), "number_range")
    )
    return v, error


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.variant_get(v, path, "variant"))


def _text(v: Column, path: str) -> tuple[Column, Column]:
    """A string field and whether something else stands there."""
    kind = _kind(v, path)
    return F.when(kind == "STRING", F.try_variant_get(v, path, "string")), kind.isNotNull() & (kind != "STRING") & (kind != "VOID")


def _whole(v: Column, path: str) -> tuple[Column, Column]:
    kind = _kind(v, path)
    return F.when(kind == "BIGINT", F.try_variant_get(v, path, "bigint")), kind.isNotNull() & (kind != "BIGINT")


def _ids(v: Column, path: str) -> tuple[Column, Column]:
    kind = _kind(v, path)
    good = kind.isin("ARRAY<BIGINT>", "ARRAY<VOID>")
    none = F.array().cast("array<bigint>")
    return F.when(kind == "ARRAY<BIGINT>", F.try_variant_get(v, path, "array<bigint>")).when(kind == "ARRAY<VOID>", F.when(F.try_variant_get(v, path + "[0]", "variant").isNull(), none)), kind.isNotNull() & ~good


def _object(v: Column, path: str) -> tuple[Column, Column]:
    kind = _kind(v, path)
    return F.when(kind.startswith("OBJECT"), F.to_json(F.variant_get(v, path, "variant"))), kind.isNotNull() & ~kind.startswith("OBJECT")


def _marks(v: Column, path: str) -> tuple[Column, Column]:
    """Boundaries; wrong if the field is no list of objects with string names, origins and token spaces and integer ids."""
    kind = _kind(v, path)
    value = F.try_variant_get(v, path, BOUNDARY)
    back = F.try_variant_get(v, path, "array<variant>")
    loose = F.exists(
        back,
        lambda b: ~F.coalesce(F.schema_of_variant(b).startswith("OBJECT"), F.lit(False))
        | ~F.coalesce(_kind(b, "$.name") == "STRING", F.lit(False))
        | ~F.coalesce(_kind(b, "$.origin") == "STRING", F.lit(False))
        | ~F.coalesce(_kind(b, "$.token_space") == "STRING", F.lit(False))
        | ~F.coalesce(_kind(b, "$.input_ids").isin("ARRAY<BIGINT>", "ARRAY<VOID>"), F.lit(False)),
    )
    return value, kind.isNotNull() & (~kind.startswith("ARRAY") | F.coalesce(loose, F.lit(False)))


def trace_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, line_no, offset (bytes before the line), line and file_error of each line of JSONL files. The text
    after the last newline is only a line if it is not empty, and then the file is incomplete. An empty file has no
    lines; a blank line is one."""
    files = raw_files(spark, path)
    text = F.col("content").cast("string")
    cut = F.split(text, "\r\n|\n|\r")
    lines = F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)
    error = F.coalesce("error", F.when((F.col("bytes") > 0) & ~F.endswith(text, F.lit("\n")), "incomplete"), F.when(~F.is_valid_utf8(text), "utf8"))
    exploded = files.select("path", "sha256", "bytes", error.alias("file_error"), F.posexplode_outer(lines).alias("line_no", "line"))
    # offsets by a running sum in the array would be quadratic; the lines of one file are bounded by MAX_TRACE
    from pyspark.sql import Window

    before = F.sum(F.octet_length("line") + 1).over(Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    return exploded.withColumn("offset", F.coalesce(before, F.lit(0)))


def trace_records(spark: SparkSession, path: str) -> DataFrame:
    """Every line of JSONL traces as a typed record, in the columns of the trace table, with path, line_no, offset and
    error (the file's, the parser's, or a wrong type). Written once, so that no consumer parses again."""
    lines = trace_lines(spark, path).where(F.col("line").isNotNull() | F.col("file_error").isNotNull())
    v, error = parsed(F.col("line"))
    df = lines.withColumns({"v": v, "__parse": error})
    v = F.col("v")
    fields: dict[str, Column] = {}
    wrong = F.when(F.lit(False), "")
    for name in ("record_type", "trace_id", "evidence_kind", "session_id", "branch_id", "turn_id", "parent_turn_id", "token_space", "reason", "prefix_sha256"):
        fields[name], bad = _text(v, f"$.{name}")
        wrong = wrong.when(bad, F.lit(f"type:{name}"))
    for name in ("trace_version", "sequence", "expected_generations", "generations", "capture_gaps"):
        fields[name], bad = _whole(v, f"$.{name}")
        wrong = wrong.when(bad, F.lit(f"type:{name}"))
    for name in ("input_ids", "output_ids"):
        fields[name], bad = _ids(v, f"$.{name}")
        wrong = wrong.when(bad, F.lit(f"type:{name}"))
    for name in ("contract", "metadata", "termination"):
        fields[name], bad = _object(v, f"$.{name}")
        wrong = wrong.when(bad, F.lit(f"type:{name}"))
    fields["boundaries"], bad = _marks(v, "$.boundaries")
    wrong = wrong.when(bad, "type:boundaries")
    contract = F.try_variant_get(v, "$.contract", _CONTRACT)
    fields["contract"] = F.when(fields["contract"].isNotNull(), contract)
    typed = df.select(
        "path", "sha256", "line_no", "offset", *(c.alias(n) for n, c in fields.items()),
        _kind(v, "$.parent_turn_id").isNotNull().alias("has_parent_key"), F.coalesce("file_error", "__parse", wrong).alias("error"),
    )
    return written(typed, "trace-records")


def _as_table(records: DataFrame) -> DataFrame:
    """Records with the file in place of the trace id, so that one file is one trace whatever it claims."""
    return records.withColumns({"trace_id": F.col("path"), "trace_version": F.col("trace_version").cast("int")})


def trace_file_reports(spark: SparkSession, path: str, records: DataFrame | None = None) -> DataFrame:
    """One report per file: path, sha256, trace_id, status, error, the counts of trace_reports. Any broken record makes
    the file an ERROR; a footer must also carry the digest of all bytes before it. records: what trace_records gave."""
    records = trace_records(spark, path) if records is None else records
    table = _as_table(records)
    own = F.coalesce(
        "error",
        F.when(F.col("trace_id").isNull() | (F.length("trace_id") == 0), "trace_id"),
        F.when((F.col("record_type") == "generation") & ~F.col("has_parent_key"), "parent_undeclared"),
        F.when(F.col("sequence") != F.col("line_no"), "sequence"),
    )
    files = records.groupBy("path").agg(
        F.first("sha256").alias("sha256"), F.min_by(own, F.when(own.isNotNull(), F.col("line_no"))).alias("own"), F.min("trace_id").alias("t0"), F.max("trace_id").alias("t1"),
        F.max(F.when(F.col("record_type") == "capture_complete", F.struct("offset", "prefix_sha256"))).alias("foot"),
    )
    contents = raw_files(spark, path).select("path", "content")
    sealed = files.where(F.col("foot").isNotNull()).join(contents, "path")
    broken = sealed.where(F.sha2(F.substring(F.col("content"), F.lit(1), F.col("foot.offset").cast("int")), 256) != F.col("foot.prefix_sha256")).select("path", F.lit("footer_digest").alias("seal"))
    good = table.where(F.col("error").isNull())
    reports = trace_reports(good.drop("error")).withColumnsRenamed({"trace_id": "path", "error": "trace_error"})
    df = raw_files(spark, path).select("path", F.col("sha256").alias("digest"), F.col("error").alias("size_error")).join(files, "path", "left").join(broken, "path", "left").join(reports, "path", "left")
    error = F.coalesce("size_error", "own", F.when(F.col("t0") != F.col("t1"), "trace_id_changes"), "trace_error", "seal")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return df.select(
        "path", F.col("digest").alias("sha256"), F.col("t0").alias("trace_id"), F.when(error.isNotNull(), "ERROR").otherwise(F.coalesce("status", F.lit("INCONCLUSIVE"))).alias("status"), error.alias("error"),
        *(count(c) for c in ("records", "roots", "generations", "gaps")), "completion", *(count(c) for c in ("transitions", "n_fail", "n_inconclusive", "n_not_applicable", "n_pass")),
    )


def trace_file_verdicts(spark: SparkSession, path: str, records: DataFrame | None = None) -> DataFrame:
    """The transitions of JSONL traces with their verdicts and identities (trace_id is the path). Those of files that are an
    ERROR mean nothing; join with trace_file_reports to leave them out."""
    return verdicts(_as_table(trace_records(spark, path) if records is None else records).drop("error"), identities=True)


def trace_gaps(records: DataFrame) -> DataFrame:
    """sequence and reason of the gaps of one trace (with several, trace_id too would be needed to tell them apart)."""
    return records.where(F.col("record_type") == "capture_gap").select("sequence", "reason")


def case_texts(records: DataFrame, digest: str | None = None) -> DataFrame:
    """case_id and case of every transition: a JSON case that ``cases`` can check, with the digest of the trace it is from.
    What a trace lacks is absent there."""
    rows = transitions(_as_table(records))
    label = lambda side, name: F.col(side).alias(name)
    case = F.struct(
        F.lit(1).alias("schema_version"), "case_id", F.struct(F.col("evidence_kind").alias("kind"), F.lit(digest).alias("trace_sha256")).alias("evidence"), "contract", label("previous", "previous"), label("following", "next"), "boundaries",
    )
    return rows.select("case_id", F.to_json(case, {"pretty": "true"}).alias("case"))


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Single-JSON cases with their verdicts, one row per file: path, sha256, case_id, status, reason and the columns of
    check_transitions. An explicit null counts as a wrong type, an absent field as missing evidence."""
    files = raw_files(spark, path, MAX_CASE)
    text = F.col("content").cast("string")
    v, error = parsed(text)
    df = files.select("path", "sha256", F.coalesce("error", error).alias("__parse"), v.alias("v"))
    v = F.col("v")
    wrong = F.when(F.col("__parse").isNotNull(), F.col("__parse"))
    version, bad = _whole(v, "$.schema_version")
    wrong = wrong.when(bad | ~F.coalesce(version == 1, F.lit(False)), "schema_version")
    name, bad = _text(v, "$.case_id")
    wrong = wrong.when(bad | ~F.coalesce(F.length(name) > 0, F.lit(False)), "case_id")
    for key in ("contract", "evidence", "previous", "next"):
        wrong = wrong.when(_object(v, f"$.{key}")[1], F.lit(key))
    evidence, bad = _text(v, "$.evidence.kind")
    wrong = wrong.when(bad, "evidence_kind")
    sides = {}
    for label, at, names in (("previous", "previous", PREVIOUS), ("following", "next", FOLLOWING)):
        parts = []
        for c in names:
            p = f"$.{at}.{c}"
            value, bad = _ids(v, p) if c.endswith("_ids") else _text(v, p)
            wrong = wrong.when(bad | F.coalesce(F.is_variant_null(F.variant_get(v, p, "variant")), F.lit(False)), F.lit(f"{label}.{c}"))
            parts.append(value.alias(c))
        sides[label] = F.struct(*parts)
    marks, bad = _marks(v, "$.boundaries")
    wrong = wrong.when(bad, "boundaries")
    contract = F.coalesce(F.try_variant_get(v, "$.contract", _CONTRACT), F.from_json(F.lit("{}"), _CONTRACT))
    typed = df.select("path", "sha256", wrong.alias("__wrong"), name.alias("case_id"), evidence.alias("evidence_kind"), contract.alias("contract"), marks.alias("boundaries"), *(s.alias(k) for k, s in sides.items()))
    checked = check_transitions(written(typed, "cases"))
    failed = F.col("__wrong").isNotNull()
    details = ("missing", "expected_history_tokens", "next_input_tokens", "first_difference", "localization", "boundary_comparisons", "evidence_gaps")
    return checked.withColumns(
        {"status": F.when(failed, "ERROR").otherwise(F.col("status")), "reason": F.when(failed, F.concat(F.lit("malformed:"), "__wrong")).otherwise(F.col("reason")), **{c: F.when(~failed, F.col(c)) for c in details}}
    ).drop("__wrong")


def handoffs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Handoff snapshots as (files, turns, samples), scoped by path. files has path, sha256 and error: what the parser or
    the shape of a turn or sample breaks, as one rule per file."""
    files = raw_files(spark, path, MAX_CASE)
    v, error = parsed(F.col("content").cast("string"))
    df = files.select("path", "sha256", F.coalesce("error", error).alias("__parse"), v.alias("v"))
    v = F.col("v")
    lists = {n: F.try_variant_get(v, f"$.{n}", "array<variant>") for n in ("turns", "samples")}
    turn = lambda t: F.struct(_text(t, "$.turn_id")[0].alias("turn_id"), _ids(t, "$.input_ids")[0].alias("input_ids"), _ids(t, "$.output_ids")[0].alias("output_ids"))
    sample = lambda s: F.struct(_ids(s, "$.tokens")[0].alias("tokens"), _whole(s, "$.response_length")[0].alias("response_length"), _ids(s, "$.loss_mask")[0].alias("loss_mask"))
    typed = written(df.select("path", "sha256", "__parse", F.transform(lists["turns"], turn).alias("turns"), F.transform(lists["samples"], sample).alias("samples")), "handoffs")
    bad_ids = lambda x: x.isNull() | F.exists(x, lambda y: y < 0)
    names = F.transform("turns", lambda t: t["turn_id"])
    n = lambda s: s["response_length"]
    total = F.aggregate("turns", F.lit(0), lambda a, t: a + F.size(t["input_ids"]) + F.size(t["output_ids"])) + F.aggregate("samples", F.lit(0), lambda a, s: a + F.size(s["tokens"]))
    rule = (
        F.when(F.col("turns").isNull() | F.col("samples").isNull(), "lists")
        .when(F.size("turns") + F.size("samples") > 4096, "too_many")
        .when(F.exists("turns", lambda t: t["turn_id"].isNull() | ~F.length(t["turn_id"]).between(1, 128)) | (F.size(F.array_distinct(names)) < F.size(names)), "turn_id")
        .when(F.exists("turns", lambda t: bad_ids(t["input_ids"]) | bad_ids(t["output_ids"]) | (F.size(t["input_ids"]) == 0) | (F.size(t["output_ids"]) == 0)), "turn_tokens")
        .when(F.exists("samples", lambda s: bad_ids(s["tokens"])), "sample_tokens")
        .when(F.exists("samples", lambda s: n(s).isNull() | (n(s) < 0) | (n(s) > F.size(s["tokens"]))), "response_length")
        .when(F.exists("samples", lambda s: s["loss_mask"].isNull() | (F.size(s["loss_mask"]) != n(s)) | F.exists(s["loss_mask"], lambda b: ~b.isin(0, 1))), "loss_mask")
        .when(total > 131072, "too_many_tokens")
    )
    files = typed.select("path", "sha256", F.coalesce("__parse", rule).alias("error"))
    good = typed.join(files.where(F.col("error").isNull()).select("path"), "path", "left_semi")
    turns = good.select("path", F.inline("turns"))
    samples = good.select("path", F.posexplode("samples").alias("sample_id", "s")).select("path", "sample_id", "s.tokens", "s.response_length", F.col("s.loss_mask").cast("array<int>").alias("loss_mask"))
    return files, turns, samples


def response_tokens(df: DataFrame, response: str, expected_prompt: str) -> DataFrame:
    """df with output_ids and response_error of engine responses (JSON text): non-empty [score, token, ...] tuples with
    finite scores, counts that agree, a stop or length finish, and equal top-level ids where given."""
    v = F.try_parse_json(response)
    pairs = F.try_variant_get(v, "$.meta_info.output_token_logprobs", "array<variant>")
    score = lambda p: F.schema_of_variant(F.variant_get(p, "$[0]", "variant"))
    tokens = F.transform(pairs, lambda p: F.when(F.schema_of_variant(F.variant_get(p, "$[1]", "variant")) == "BIGINT", F.try_variant_get(p, "$[1]", "bigint")))
    number = lambda p: F.coalesce(score(p).rlike(r"\A(BIGINT|DOUBLE|FLOAT|DECIMAL.*)\z"), F.lit(False)) & F.coalesce(F.abs(F.try_variant_get(p, "$[0]", "double")) < F.lit(float("inf")), F.lit(False))
    finish = F.try_variant_get(v, "$.meta_info.finish_reason.type", "string")
    top, bad_top = _ids(v, "$.output_ids")
    agree = lambda p, n: F.coalesce(_whole(v, p)[0] == n, F.lit(False))
    error = (
        F.when(v.isNull() | ~F.coalesce(_kind(v, "$.meta_info").startswith("OBJECT"), F.lit(False)), "meta_info")
        .when(pairs.isNull() | (F.size(pairs) == 0), "no_tokens")
        .when(F.exists(pairs, lambda p: ~number(p)), "score")
        .when(F.exists(tokens, lambda t: t.isNull() | (t < 0)), "token")
        .when(~agree("$.meta_info.prompt_tokens", F.col(expected_prompt)), "prompt_tokens")
        .when(~agree("$.meta_info.completion_tokens", F.size(pairs)), "completion_tokens")
        .when(~F.coalesce(finish.isin("stop", "length"), F.lit(False)), "finish_reason")
        .when(bad_top | (top.isNotNull() & (top != tokens)), "output_ids")
    )
    return df.withColumns({"output_ids": F.when(error.isNull(), tokens), "response_error": error})
