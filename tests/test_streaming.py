import json
import os

from pyspark.sql import functions as F

from turnledger.streaming.admission import EVENTS, admitted, replayed

NAMES = [c.split()[0] for c in EVENTS.split(", ")]


def event(n, kind, trace="t", **more):
    return {k: None for k in NAMES} | {"trace_id": trace, "event_no": n, "kind": kind} | more


def request(n, turn, parent=None, **more):
    return event(n, "request", request_id=f"r{n}", session_id="s", branch_id="b", turn_id=turn, parent_turn_id=parent, metadata_session="s", streaming=False, **more)


def response(n, of, status=200, calls=1, captured=1, **more):
    return event(n, "response", request_id=f"r{of}", status=status, calls=calls, captured=captured, input_ids=[1], output_ids=[2], **more)


def story(trace, last=True):
    events = [
        request(0, "a"), request(1, "b", "a"), response(2, 0), request(3, "b", "a"), request(4, "a"), request(5, "c", "a") | {"streaming": True}, request(6, "d", "a") | {"bearer": "x"},
        request(7, "bad name!"), request(8, "e", "a"), response(9, 8, status=500), request(10, "f", "a"), response(11, 10, calls=2), response(12, 3), response(13, 3), request(14, "g", "b"), response(15, 14, status=None),
    ]
    return [e | {"trace_id": trace} for e in [*events, *([event(16, "finish")] if last else [])]]


def clean(trace):
    events = [request(0, "a"), request(1, "z"), response(2, 0), event(3, "finish", expected=2), response(4, 1), request(5, "late"), event(6, "abort")]
    return [e | {"trace_id": trace} for e in events]


def table(spark, events):
    return spark.createDataFrame([tuple(e[k] for k in NAMES) for e in events], EVENTS)


def shown(rows):
    return sorted((r["trace_id"], r["event_no"], r["record_type"], r["sequence"], r["reason"], r["reply"], r["turn_id"], r["chain_sha256"]) if r["sequence"] is not None else (r["trace_id"], r["event_no"], r["record_type"], -1, r["reason"], r["reply"], None, None) for r in rows)


def test_rules_of_admission(spark):
    got = replayed(table(spark, story("t"))).orderBy("event_no").collect()
    assert [(r["event_no"], r["record_type"], r["reason"], r["reply"]) for r in got] == [
        (1, "capture_gap", "http_parent_not_completed", 409), (2, "generation", None, 200), (4, "capture_gap", "http_duplicate_turn", 409), (5, "capture_gap", "http_stream_unsupported", 422),
        (6, "capture_gap", "http_session_auth_mismatch", 422), (7, "capture_gap", "http_context_invalid", 422), (9, "capture_gap", "http_unsuccessful_response", 500),
        (11, "capture_gap", "http_callback_coverage_mismatch", 200), (12, "generation", None, 200), (13, "refused", "response_unknown", None), (15, "capture_gap", "http_handler_failed_or_cancelled", None), (16, "refused", "capture_incomplete", None),
    ]
    assert [r["sequence"] for r in got if r["sequence"] is not None] == list(range(10))


def test_seal_waits_for_requests_and_counts(spark):
    ordered = lambda df: df.orderBy("event_no", F.col("sequence").isNull(), "sequence").collect()
    got = ordered(replayed(table(spark, clean("t"))))
    kinds = [(r["event_no"], r["record_type"], r["reason"]) for r in got]
    assert kinds == [(2, "generation", None), (4, "generation", None), (4, "capture_complete", None), (5, "refused", "sealed"), (6, "refused", "sealed")]
    assert got[2]["generations"] == got[2]["expected_generations"] == 2 and got[2]["capture_gaps"] == 0
    short = [e | ({"expected": 9} if e["kind"] == "finish" else {}) for e in clean("t")][:5]
    assert [r["reason"] for r in ordered(replayed(table(spark, short)))][2:] == ["http_request_count_mismatch", "capture_incomplete"]
    limited = ordered(replayed(table(spark, clean("t")), limit=1))
    assert (limited[0]["record_type"], limited[0]["reason"]) == ("refused", "admission_closed")


def test_stream_equals_table(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = story("x") + clean("y")
    source = tmp_path / "in"
    source.mkdir()
    for k, part in enumerate((lambda e: e["event_no"] < 6, lambda e: 6 <= e["event_no"])):
        (source / f"{k}.json").write_text("\n".join(json.dumps(e) for e in events if part(e)))
        os.utime(source / f"{k}.json", (1_700_000_000 + 60 * k,) * 2)  # the file source takes the older file first
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(source))
    query = admitted(stream).writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    assert shown(spark.table("admitted").collect()) == shown(replayed(table(spark, events)).collect())


def test_callbacks_stops_and_wire_limit(spark):
    def callback(n, turn, **more):
        return event(n, "callback", session_id="s", branch_id="b", turn_id=turn, input_ids=[1, 2], output_ids=[3], **more)

    def reasons(events, **how):
        return [(r["event_no"], r["record_type"], r["reason"]) for r in replayed(table(spark, events), **how).orderBy("event_no", F.col("sequence").isNull(), "sequence").collect()]

    nameless = {"session_id": None, "branch_id": None, "turn_id": None}
    bad = [callback(0, "a", reason="it raised"), callback(1, "b") | nameless, callback(2, "c") | {"output_ids": []}, callback(3, "d"), callback(4, "d"), event(5, "health", expected=9)]
    assert reasons(bad) == [
        (0, "capture_gap", "context_resolver_failed"), (1, "capture_gap", "turn_context_missing"), (2, "capture_gap", "turn_record_capture_failed"), (3, "generation", None), (4, "capture_gap", "turn_record_capture_failed"),
        (5, "capture_gap", "served_turn_count_mismatch"), (5, "refused", "capture_incomplete"),
    ]
    assert reasons([callback(0, "a"), callback(1, "b", parent_turn_id="a"), event(2, "health", expected=2)])[-1] == (2, "capture_complete", None)
    assert replayed(table(spark, [callback(0, "a")])).first()["input_ids"] == [1, 2]
    for kind, reason in (("deadline", "http_run_deadline_exceeded"), ("interrupt", "http_run_interrupted"), ("abort", "http_owner_aborted")):
        assert reasons([request(0, "a"), event(1, kind), request(2, "b"), response(3, 0)]) == [(1, "capture_gap", reason), (2, "refused", "admission_closed"), (3, "generation", None)]
    wide = response(3, 2) | {"output_ids": list(range(100))}
    assert reasons([request(0, "a"), response(1, 0), request(2, "b"), wide, request(4, "c")], wire_limit=50) == [(1, "generation", None), (3, "capture_gap", "http_wire_size_limit"), (4, "refused", "admission_closed")]
