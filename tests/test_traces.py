import pytest
from pyspark.sql import functions as F

from turnledger.operators.traces import record_error, trace_errors, trace_reports, transitions, verdicts

SCHEMA = (
    "trace_version int, record_type string, trace_id string, sequence bigint, evidence_kind string, session_id string, branch_id string, turn_id string, parent_turn_id string, token_space string, "
    "input_ids array<bigint>, output_ids array<bigint>, contract struct<version:string,mode:string,history_policy:string>, termination string, metadata string, "
    "boundaries array<struct<name:string,origin:string,token_space:string,input_ids:array<bigint>>>, reason string, expected_generations bigint, generations bigint, capture_gaps bigint, prefix_sha256 string, received_at timestamp, status string"
)
NAMES = [c.strip().split(" ")[0] for c in SCHEMA.replace("<version:string,mode:string,history_policy:string>", "").replace("array<struct<name:string,origin:string,token_space:string,input_ids:array<bigint>>>", "x").split(", ")]
GOOD = ("history-prefix/v1", "append_only", "preserved")


def generation(n, turn, parent, inputs, outputs, **more):
    base = {"trace_version": 2, "record_type": "generation", "trace_id": "t", "sequence": n, "evidence_kind": "synthetic", "session_id": "s", "branch_id": "b", "turn_id": turn, "parent_turn_id": parent, "token_space": "x", "input_ids": inputs, "output_ids": outputs, "contract": GOOD, "termination": "{}", "metadata": "{}"}
    return base | more


def footer(n, made, gaps=0, **more):
    return {"trace_version": 2, "record_type": "capture_complete", "trace_id": "t", "sequence": n, "evidence_kind": "synthetic", "expected_generations": made, "generations": made, "capture_gaps": gaps, "prefix_sha256": "0" * 64} | more


def table(spark, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in NAMES) for r in rows], SCHEMA)


def test_repeated_deliveries_count_once(spark):
    rows = [generation(0, "a", None, [1], [2]), generation(1, "b", "a", [1, 2, 9], [3]), footer(2, 2)]
    got = trace_reports(table(spark, rows + rows[1:])).first()
    assert (got["status"], got["records"], got["transitions"], got["n_pass"], got["completion"], got["error"]) == ("PASS", 2, 1, 1, "complete", None)


def test_nulls_and_empty_tables(spark):
    none = table(spark, [])
    assert trace_reports(none).count() == verdicts(none).count() == transitions(none).count() == trace_errors(none).count() == 0
    blank = table(spark, [{}])
    assert blank.select(record_error()).first()[0] == "version_or_type" and trace_errors(blank).first()["error"] == "record:version_or_type"
    odd = generation(0, "a", None, [1, None], [2]), generation(1, "a", None, [1], []), generation(2, None, None, [1], [1]), generation(3, "a", "a", [1], [1]), generation(4, "a", None, None, [1]), generation(5, "a", None, [1], [1], contract=None), generation(6, "a", None, [1], [1], boundaries=[None])
    assert [r[0] for r in table(spark, odd).orderBy("sequence").select(record_error()).collect()] == ["input_ids", "output_empty", "turn_id", "own_parent", "input_ids", "contract", "boundary_name"]


@pytest.mark.parametrize(
    ("rows", "error"),
    [
        ([generation(0, "a", None, [1], [2]), generation(2, "b", None, [1], [2])], "sequence_gap"),
        ([generation(0, "a", None, [1], [2]), generation(1, "b", None, [1], [2], trace_version=1)], "version_changes"),
        ([generation(0, "a", None, [1], [2]), generation(1, "b", None, [1], [2], evidence_kind="observed_rollout")], "evidence_changes"),
        ([footer(0, 0), generation(1, "b", None, [1], [2])], "after_footer"),
        ([generation(0, "a", None, [1], [2]), generation(1, "a", None, [1], [2])], "turn_repeated"),
        ([generation(0, "a", None, [1], [2]), footer(1, 3)], "footer_counts"),
        ([generation(0, "a", None, [1], [2]), footer(1, 1, prefix_sha256="xyz")], "record:footer_digest"),
    ],
)
def test_whole_trace_rules(spark, rows, error):
    got = trace_reports(table(spark, rows)).first()
    assert (got["status"], got["error"]) == ("ERROR", error)


def test_parents_never_cross_branches_or_come_later(spark):
    rows = [
        generation(0, "late", "p", [1, 2], [3]), generation(1, "p", None, [1], [2]), generation(2, "other-branch", "p", [1, 2], [3], branch_id="c"), generation(3, "other-session", "p", [1, 2], [3], session_id=None),
        generation(4, "first-wins", "p", [1, 2], [3]), generation(5, "p", None, [9], [9]), generation(6, "empty", "p", [], [1]), generation(7, "space", "p", [1, 2], [3], token_space="y"),
    ]
    got = {r["turn_id"]: (r["status"], r["reason"]) for r in verdicts(table(spark, rows)).collect()}
    lacking = ("INCONCLUSIVE", "evidence_missing")
    assert got == {"late": lacking, "other-branch": lacking, "other-session": lacking, "first-wins": ("PASS", "prefix_kept"), "empty": ("FAIL", "prefix_changed"), "space": ("NOT_APPLICABLE", "token_space_differs")}
    missing = verdicts(table(spark, rows[:1])).first()["missing"]
    assert missing == [f"previous.{c}" for c in ("session_id", "branch_id", "turn_id", "token_space", "input_ids", "output_ids")]


def test_hot_parent(spark):
    """One parent with most of the rows: its side of the join is a single row."""
    rows = [generation(0, "p", None, [1], [2])]
    df = table(spark, rows)
    children = spark.range(1, 3000).select(*(F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("sequence",) else F.col("id").alias("sequence") for f in df.schema.fields))
    children = children.withColumns({"trace_version": F.lit(2), "record_type": F.lit("generation"), "trace_id": F.lit("t"), "evidence_kind": F.lit("synthetic"), "session_id": F.lit("s"), "branch_id": F.lit("b"), "turn_id": F.concat(F.lit("c"), "sequence"), "parent_turn_id": F.lit("p"), "token_space": F.lit("x"), "input_ids": F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")), "output_ids": F.array(F.lit(3).cast("bigint")), "contract": F.struct(F.lit(GOOD[0]).alias("version"), F.lit(GOOD[1]).alias("mode"), F.lit(GOOD[2]).alias("history_policy"))})
    found = verdicts(df.unionByName(children)).groupBy("status").count().collect()
    assert [(r["status"], r["count"]) for r in found] == [("PASS", 2999)]


def test_parents_are_the_same_sent_or_joined(spark):
    """Children that keep, change, shorten or contain nulls in what their parent left, redelivered, and with a repeated turn."""
    rows = [generation(0, "a", None, [1, 2], [3]), generation(1, "b", "a", [1, 2, 3, 4], [5]), generation(2, "c", "a", [1, 9, 3], [5]), generation(3, "d", "a", [1, 2], [5]), generation(4, "e", "a", [1, 2, None], [5])]
    rows += [generation(5, "n", None, [1, None], [2]), generation(6, "f", "n", [1, None, 2], [5]), generation(7, "g", "n", [1, 2], [5]), generation(8, "a", None, [7], [8]), generation(9, "h", "a", [1, 2, 3], [5]), generation(10, "i", "none", [1], [1])]
    rows += [generation(11, "x", None, None, [2]), generation(12, "y", "x", [2], [2]), generation(13, "z", "x", None, [2]), rows[1], rows[2]]
    df = table(spark, rows)
    shown = lambda sent: sorted(map(str, transitions(df, sent=sent).collect()))
    assert shown(0) == shown(1000) and len(shown(0)) == 12
    got = {r["sequence"]: (r["status"], r["previous_sequence"], r["previous"]["input_ids"]) for r in verdicts_with_previous(df)}
    assert got[1] == ("PASS", 0, [1, 2]) and got[2] == ("FAIL", 0, [1, 2]) and got[3] == ("FAIL", 0, [1, 2]) and got[9] == ("PASS", 0, [1, 2])
    assert got[4][0] == "ERROR" and got[6] == ("ERROR", 5, [1, None]) and got[10] == ("INCONCLUSIVE", None, None) and got[12] == ("INCONCLUSIVE", 11, None)


def verdicts_with_previous(df):
    from turnledger.operators.contract import check_transitions

    return check_transitions(transitions(df)).collect()
