import json
import re

import pytest
from pyspark.sql import functions as F

from turnledger.cli import main
from turnledger.report import render, safe
from turnledger.sinks.evidence import export_bundle, report_of, verify_bundle
from turnledger.sinks.recorder import TraceWriter, sealed_traces
from turnledger.sources.captures import CaptureError, cases, response_tokens, strict_object, trace_file_reports, trace_records

CONTRACT = {"version": "history-prefix/v1", "mode": "append_only", "history_policy": "preserved"}


def turn(i, parent, inputs, outputs, **more):
    return {"session_id": "s", "branch_id": "b", "turn_id": f"t{i}", "parent_turn_id": parent, "token_space": "x", "input_ids": inputs, "output_ids": outputs, "contract": CONTRACT, "termination": {}, **more}


def trace(path, *turns, gaps=(), seal=True, version=2):
    with TraceWriter(str(path), trace_id="run", evidence_kind="synthetic", trace_version=version) as out:
        for t in turns:
            out.generation(**t)
        for g in gaps:
            out.gap(g)
        if seal and version == 2:
            out.seal(expected_generations=len(turns))
    return path


GOOD = (turn(0, None, [1, 2], [3, 4]), turn(1, "t0", [1, 2, 3, 4, 9], [5]))
DRIFT = (turn(0, None, [1, 2], [3, 4]), turn(1, "t0", [1, 2, 3, 7], [5]))


def reports(spark, folder):
    return {r["path"].rsplit("/", 1)[1]: r for r in trace_file_reports(spark, f"file://{folder}/*.jsonl").collect()}


def test_trace_files(spark, tmp_path):
    trace(tmp_path / "pass.jsonl", *GOOD)
    trace(tmp_path / "fail.jsonl", *DRIFT)
    trace(tmp_path / "gap.jsonl", *GOOD, gaps=["lost"])
    trace(tmp_path / "fail-gap.jsonl", *DRIFT, gaps=["lost"], seal=False)
    trace(tmp_path / "open.jsonl", *GOOD, seal=False)
    trace(tmp_path / "v1.jsonl", *GOOD, version=1)
    trace(tmp_path / "root.jsonl", GOOD[0])
    trace(tmp_path / "orphan.jsonl", turn(1, "gone", [1], [2]))
    trace(tmp_path / "late-parent.jsonl", GOOD[1], GOOD[0])
    rewrite = {**CONTRACT, "mode": "history_rewrite"}
    trace(tmp_path / "rewrite.jsonl", turn(1, "gone", [1], [2], contract=rewrite))
    (tmp_path / "empty.jsonl").write_bytes(b"")  # the file source passes over empty files
    text = (tmp_path / "pass.jsonl").read_text()
    lines = text.splitlines(keepends=True)
    bad = {
        "no-newline": text[:-1], "blank": lines[0] + "\n" + "".join(lines[1:]), "duplicate-key": text.replace('"trace_version": 2', '"trace_version": 2, "trace_version": 2', 1),
        "nan": text.replace('"metadata": {}', '"metadata": {"a": NaN}', 1), "infinite": text.replace('"metadata": {}', '"metadata": {"a": 1e999}', 1), "list": "[1]\n" + text,
        "true-token": text.replace("[1, 2]", "[1, true]", 1), "float-token": text.replace("[1, 2]", "[1, 2.0]", 1), "huge-token": text.replace("[1, 2]", "[1, 99999999999999999999]", 1),
        "negative": text.replace("[1, 2]", "[1, -2]", 1), "order": lines[1] + lines[0] + lines[2], "missing-line": lines[0] + lines[2], "after-footer": text + lines[2],
        "edited": text.replace('"t1"', '"t9"'), "no-parent-key": text.replace('"parent_turn_id": null, ', "", 1), "other-id": text.replace('"trace_id": "run"', '"trace_id": "ran"', 1),
        "twice": lines[0] + lines[0].replace('"sequence": 0', '"sequence": 1'), "bool-version": text.replace('"trace_version": 2', '"trace_version": true'),
    }
    for name, content in bad.items():
        (tmp_path / f"bad-{name}.jsonl").write_text(content)
    (tmp_path / "bad-utf8.jsonl").write_bytes(text.encode().replace(b'"run"', b'"r\xffn"'))
    got = reports(spark, tmp_path)
    want = {"pass": "PASS", "fail": "FAIL", "gap": "INCONCLUSIVE", "fail-gap": "FAIL", "open": "INCONCLUSIVE", "v1": "PASS", "root": "INCONCLUSIVE", "orphan": "INCONCLUSIVE", "late-parent": "INCONCLUSIVE", "rewrite": "NOT_APPLICABLE"}
    assert {n.removesuffix(".jsonl"): r["status"] for n, r in got.items() if not n.startswith("bad-")} == want
    assert {n: r["status"] for n, r in got.items() if n.startswith("bad-") and r["status"] != "ERROR"} == {}
    errors = {n.removesuffix(".jsonl")[4:]: r["error"] for n, r in got.items() if n.startswith("bad-")}
    assert errors["edited"] == "footer_digest" and errors["no-newline"] == "incomplete" and errors["true-token"] == "type:input_ids" and errors["infinite"] == "number_range"
    assert errors["order"] == "sequence" and errors["utf8"] == "utf8" and errors["twice"] == "turn_repeated"


def test_tables_become_sealed_files_again(spark, tmp_path):
    trace(tmp_path / "a.jsonl", *DRIFT, gaps=["lost"])
    records = trace_records(spark, f"file://{tmp_path}/a.jsonl").withColumns({"termination": F.col("termination"), "trace_version": F.col("trace_version").cast("int")})
    row = sealed_traces(records).first()
    assert row["error"] is None
    (tmp_path / "b.jsonl").write_text(row["content"])
    got = reports(spark, tmp_path)
    assert got["b.jsonl"]["status"] == "FAIL" and got["b.jsonl"]["gaps"] == 1 and got["b.jsonl"]["completion"] == "complete" and got["b.jsonl"]["sha256"] == row["sha256"]


def case(**more):
    previous = {"session_id": "s", "branch_id": "b", "turn_id": "p", "token_space": "x", "input_ids": [1, 2], "output_ids": [3]}
    following = {"session_id": "s", "branch_id": "b", "previous_turn_id": "p", "token_space": "x", "input_ids": [1, 2, 3, 4]}
    return {"schema_version": 1, "case_id": "c", "evidence": {"kind": "synthetic"}, "contract": CONTRACT, "previous": previous, "next": following} | more


def test_cases_in_order_of_the_rules(spark, tmp_path):
    base = case()
    side = lambda k, **v: case(**{k: {**base[k], **v}})
    without = lambda k, f: case(**{k: {a: b for a, b in base[k].items() if a != f}})
    mark = lambda n, ids, origin="captured", space="x": {"name": n, "origin": origin, "token_space": space, "input_ids": ids}
    want = {
        "pass": (base, "PASS"), "suffix": (side("next", input_ids=[1, 2, 3]), "PASS"), "short": (side("next", input_ids=[1, 2]), "FAIL"), "changed": (side("next", input_ids=[9, 2, 3]), "FAIL"),
        "absent": (without("previous", "output_ids"), "INCONCLUSIVE"), "null": (side("previous", output_ids=None), "ERROR"), "bool": (side("next", input_ids=[True]), "ERROR"), "string": (side("next", input_ids="12"), "ERROR"),
        "rewrite": (case(contract={**CONTRACT, "mode": "history_rewrite"}), "NOT_APPLICABLE"), "bad-beats-rewrite": (side("next", input_ids=[-1]) | {"contract": {**CONTRACT, "mode": "history_rewrite"}}, "ERROR"),
        "no-contract": ({k: v for k, v in base.items() if k != "contract"}, "INCONCLUSIVE"), "mode": (case(contract={**CONTRACT, "mode": "odd"}), "ERROR"), "policy": (case(contract={**CONTRACT, "history_policy": "unknown"}), "INCONCLUSIVE"),
        "session": (side("next", session_id="other"), "NOT_APPLICABLE"), "space": (side("next", token_space="y"), "NOT_APPLICABLE"), "parent": (side("next", previous_turn_id="q"), "INCONCLUSIVE"),
        "empty": (side("previous", input_ids=[], output_ids=[]), "INCONCLUSIVE"), "version": (case(schema_version=True), "ERROR"), "kind": (case(evidence={"kind": "guess"}), "ERROR"), "list": (case(previous=[]), "ERROR"),
        "marks": (side("next", input_ids=[1, 2, 8]) | {"boundaries": [mark("a", [1, 2, 3]), mark("d", [9], "derived"), mark("o", [9], space="y"), mark("b", [1, 2, 8]), mark("c", [1, 2, 3])]}, "FAIL"),
        "marks-twice": (case(boundaries=[mark("a", []), mark("a", [])]), "ERROR"), "marks-origin": (case(boundaries=[mark("a", [], "seen")]), "ERROR"), "marks-type": (case(boundaries=[mark("a", [1.5])]), "ERROR"),
    }
    for n, (value, _) in want.items():
        (tmp_path / f"{n}.json").write_text(json.dumps(value))
    got = {r["path"].rsplit("/", 1)[1].removesuffix(".json"): r for r in cases(spark, f"file://{tmp_path}/*.json").collect()}
    assert {n: r["status"] for n, r in got.items()} == {n: s for n, (_, s) in want.items()}
    assert got["absent"]["missing"] == ["previous.output_ids"]
    d = got["short"]["first_difference"]
    assert (d["index"], d["region"], d["expected_id"], d["actual_id"], d["kind"], d["expected_window"], d["actual_window"]) == (2, "previous_output", 3, None, "missing_suffix", [1, 2, 3], [1, 2])
    m = got["marks"]
    assert m["localization"]["after"] == "a" and m["localization"]["at_or_before"] == "b"
    assert [(b["name"], b["first_difference"]) for b in m["boundary_comparisons"]] == [("a", None), ("d", 0), ("b", 2), ("c", None)] and m["evidence_gaps"] == ["d:derived", "o:token_space"]


def test_every_single_change_is_found(spark, tmp_path):
    history = [1, 2, 3]
    for i in range(3):
        for name, ids in ((f"m{i}", history[:i] + [99] + history[i + 1 :]), (f"t{i}", history[:i])):
            (tmp_path / f"{name}.json").write_text(json.dumps(case(next={**case()["next"], "input_ids": ids})))
    for r in cases(spark, f"file://{tmp_path}/*.json").collect():
        assert r["status"] == "FAIL" and r["first_difference"]["index"] == int(r["path"][-6])


def test_writer_guards(tmp_path):
    path = str(tmp_path / "w.jsonl")
    with TraceWriter(path, trace_id="r", evidence_kind="synthetic") as out:
        out.generation(**GOOD[0])
        for wrong in ({**GOOD[0]}, turn(5, "t5", [1], [1]), turn(6, None, [1], []), turn(7, None, [True], [1]), turn(8, None, [1], [1], metadata={"a": float("nan")})):
            with pytest.raises(CaptureError):
                out.generation(**wrong)
        with pytest.raises(CaptureError, match="mismatch"):
            out.seal(expected_generations=3)
        out.seal(expected_generations=1)
        with pytest.raises(CaptureError):
            out.gap("late")
    assert [json.loads(x)["record_type"] for x in open(path)] == ["generation", "capture_gap", "capture_complete"]
    with pytest.raises(FileExistsError):
        TraceWriter(path, trace_id="r", evidence_kind="synthetic")
    for raw in (b"[]", b'{"a":1,"a":2}', b'{"a":1e999}', b'{"a":NaN}', b"\xff{}", b"{"):
        with pytest.raises(CaptureError):
            strict_object(raw)


def test_bundles(spark, tmp_path):
    source = str(trace(tmp_path / "t.jsonl", *DRIFT))
    report = export_bundle(spark, source, str(tmp_path / "bundle"), "trace")
    assert report["status"] == "FAIL" and verify_bundle(spark, str(tmp_path / "bundle"))["verification"]["integrity"] == "verified"
    with pytest.raises(FileExistsError):
        export_bundle(spark, source, str(tmp_path / "bundle"), "trace")
    manifest = json.loads((tmp_path / "bundle/manifest.json").read_text())
    lie = (tmp_path / "bundle/report.json").read_text().replace('"FAIL"', '"PASS"')
    (tmp_path / "bundle/report.json").write_text(lie)
    with pytest.raises(CaptureError, match="manifest"):
        verify_bundle(spark, str(tmp_path / "bundle"))
    import hashlib

    own = next(f for f in manifest["files"] if f["name"] == "report.json")
    own |= {"bytes": len(lie.encode()), "sha256": hashlib.sha256(lie.encode()).hexdigest()}
    (tmp_path / "bundle/manifest.json").write_text(json.dumps(manifest))
    with pytest.raises(CaptureError, match="saved report"):
        verify_bundle(spark, str(tmp_path / "bundle"))
    for wrong in ({**manifest, "more": 1}, {**manifest, "format": "x"}, {**manifest, "files": manifest["files"][:2]}, {**manifest, "files": manifest["files"] + manifest["files"][:1]}):
        (tmp_path / "bundle/manifest.json").write_text(json.dumps(wrong))
        with pytest.raises(CaptureError, match="manifest"):
            verify_bundle(spark, str(tmp_path / "bundle"))
    (tmp_path / "bundle/README.md").unlink()
    (tmp_path / "bundle/README.md").symlink_to(source)
    with pytest.raises(CaptureError):
        verify_bundle(spark, str(tmp_path / "bundle"))


def test_text_and_command_line(spark, tmp_path, capsys):
    source = str(trace(tmp_path / "t.jsonl", *DRIFT))
    assert main(["inspect-trace", source, "--format", "text", "--cases-dir", str(tmp_path / "cases")], spark) == 1
    text = capsys.readouterr().out
    assert "Status: FAIL" in text and "expected 4, found 7" in text and 'session "s", branch "b", turn "t1", declared parent "t0"' in text
    extracted = str(tmp_path / "cases/transition-000001.json")
    assert main(["inspect", extracted], spark) == 1 and json.loads((tmp_path / "cases/trace.report.json").read_text())["capture_gaps"] == []
    assert json.loads(open(extracted).read())["evidence"]["trace_sha256"] == json.loads((tmp_path / "cases/trace.report.json").read_text())["sha256"]
    capsys.readouterr()
    assert main(["inspect-trace", str(trace(tmp_path / "gaps.jsonl", *GOOD, gaps=["lost", "late"])), "--format", "text"], spark) == 3
    text = capsys.readouterr().out
    assert text.index('gap at record 2: "lost"') < text.index('gap at record 3: "late"')
    assert main(["inspect-trace", str(trace(tmp_path / "g.jsonl", *GOOD))], spark) == 0
    assert main(["inspect-trace", str(tmp_path / "none")], spark) == 2
    (tmp_path / "empty.jsonl").write_bytes(b"")
    assert main(["inspect-trace", str(tmp_path / "empty.jsonl")], spark) == 3 and main(["inspect", str(tmp_path / "empty.jsonl")], spark) == 2
    (tmp_path / "c.json").write_text(json.dumps(case()))
    assert main(["export-evidence", str(tmp_path / "c.json"), str(tmp_path / "b")], spark) == 0 and main(["verify-evidence", str(tmp_path / "b")], spark) == 0
    handoff = {"turns": [{"turn_id": "a", "input_ids": [1], "output_ids": [2, 3]}], "samples": [{"tokens": [1, 2, 9], "response_length": 2, "loss_mask": [1, 0]}]}
    (tmp_path / "h.json").write_text(json.dumps(handoff))
    capsys.readouterr()
    assert main(["audit-samples", str(tmp_path / "h.json")], spark) == 0
    assert json.loads(capsys.readouterr().out)["samples"] == [{"sample_index": 0, "tokens": 3, "trainable_tokens": 1}]
    assert main(["audit-samples", str(tmp_path / "h.json"), "--require-all-generated"], spark) == 1
    handoff["samples"][0]["loss_mask"] = [True, 0]
    (tmp_path / "h.json").write_text(json.dumps(handoff))
    assert main(["audit-samples", str(tmp_path / "h.json")], spark) == 2
    assert re.fullmatch(r"[\x20-\x7e]+", safe("a\n\x1b‮é" + "x" * 200)) and safe(None) == "unknown"
    rows = [{"status": s, "case_id": f"c{i}", "reason": ""} for i, s in enumerate(["PASS"] * 25 + ["FAIL"])]
    shown = render({"status": "FAIL", "reports": rows, "trace_id": "t", "records": 1, "roots": 1, "transitions": 26, "gaps": 0, "completion": None, "n_fail": 1, "n_pass": 25, "n_inconclusive": 0, "n_not_applicable": 0})
    assert shown.index('"c25"') < shown.index('"c0"') and "6 more transitions" in shown


def test_responses(spark):
    good = {"meta_info": {"output_token_logprobs": [[-0.5, 7, None], [-1, 8]], "prompt_tokens": 3, "completion_tokens": 2, "finish_reason": {"type": "stop"}}, "output_ids": [7, 8]}
    change = lambda f: (lambda d: (f(d), d)[1])(json.loads(json.dumps(good)))
    rows = [
        (json.dumps(good), 3, None), (json.dumps(good), 4, "prompt_tokens"), ("{", 3, "meta_info"), (json.dumps(change(lambda d: d["meta_info"].update(output_token_logprobs=[]))), 3, "no_tokens"),
        (json.dumps(change(lambda d: d["meta_info"]["output_token_logprobs"].append([0]))), 3, "token"), (json.dumps(change(lambda d: d["meta_info"]["output_token_logprobs"].append(["x", 3]))), 3, "score"),
        (json.dumps(change(lambda d: d["meta_info"].update(completion_tokens=5))), 3, "completion_tokens"), (json.dumps(change(lambda d: d["meta_info"].update(finish_reason={"type": "abort"}))), 3, "finish_reason"),
        (json.dumps(change(lambda d: d.update(output_ids=[7]))), 3, "output_ids"),
    ]
    got = response_tokens(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, r string, n int, want string"), "r", "n").orderBy("i").collect()
    assert [r["response_error"] for r in got] == [r[2] for r in rows] and got[0]["output_ids"] == [7, 8]
