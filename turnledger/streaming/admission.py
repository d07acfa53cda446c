"""Capture of live requests as a stateful stream.

Each trace is one state machine: requests are admitted or turned away with a gap, a turn is reserved before its
handler runs and completed only by a successful response with exactly one capture, and the trace is sealed once all
requests have drained and the owner's own count agrees. Completeness is never inferred from time: order is the event
number, and a watermark decides nothing. The same machine runs over a stream (state in the state store, a map entry
per turn) and over a table.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, MutableMapping

from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from turnledger.functions.arrays import valid_tokens
from turnledger.functions.scalars import ALIAS

#: Characters of tokens that one capture may pass on.
MAX_WIRE = 64 * 1024 * 1024

# The reasons that capture gaps give.
CONTEXT_INVALID = "http_context_invalid"
STREAM_UNSUPPORTED = "http_stream_unsupported"
AUTH_MISMATCH = "http_session_auth_mismatch"
DUPLICATE_TURN = "http_duplicate_turn"
PARENT_NOT_COMPLETED = "http_parent_not_completed"
COVERAGE_MISMATCH = "http_callback_coverage_mismatch"
UNSUCCESSFUL = "http_unsuccessful_response"
FAILED_OR_CANCELLED = "http_handler_failed_or_cancelled"
RECORD_FAILED = "turn_record_capture_failed"
ABORTED = "http_owner_aborted"
SHUTDOWN_TIMEOUT = "http_shutdown_timeout"
COUNT_MISMATCH = "http_request_count_mismatch"
DEADLINE = "http_run_deadline_exceeded"
INTERRUPTED = "http_run_interrupted"
WIRE_LIMIT = "http_wire_size_limit"
RESOLVER_FAILED = "context_resolver_failed"
CONTEXT_MISSING = "turn_context_missing"
SERVED_MISMATCH = "served_turn_count_mismatch"

EVENTS = (
    "trace_id string, event_no bigint, kind string, request_id string, session_id string, branch_id string, turn_id string, parent_turn_id string, "
    "metadata_session string, contract_mode string, streaming boolean, bearer string, status int, calls int, captured int, input_ids array<bigint>, output_ids array<bigint>, expected bigint, reason string"
)
RECORDS = (
    "trace_id string, event_no bigint, sequence bigint, record_type string, reply int, session_id string, branch_id string, turn_id string, parent_turn_id string, "
    "input_ids array<bigint>, output_ids array<bigint>, reason string, expected_generations bigint, generations bigint, capture_gaps bigint, chain_sha256 string"
)
_NAMES = [c.split()[0] for c in RECORDS.split(", ")]
_ALIAS = re.compile(ALIAS.replace(r"\z", r"\Z"))
_START = {"invocations": 0, "wire": 0, "received": 0, "succeeded": 0, "failed": 0, "active": 0, "sequence": 0, "generations": 0, "gaps": 0, "accepting": True, "sealed": False, "waiting": None, "chain": ""}


def _none(value):
    """pandas' missing values as None."""
    if value is None or isinstance(value, float) and value != value or value is pd.NaT or value is pd.NA:
        return None
    return value


def _list(value) -> list[int] | None:
    return None if _none(value) is None else [int(x) for x in value]


class Tokens(NamedTuple):
    """What the machine needs of an event's tokens; the tokens themselves only where they travel with the event."""

    sound: bool
    digest: str
    size: int
    kept: dict

    @classmethod
    def of(cls, e: dict) -> Tokens:
        if "sound" in e:
            return cls(bool(e["sound"]), _none(e["digest"]) or "", int(e["size"]), {})
        inputs, outputs = _list(e["input_ids"]), _list(e["output_ids"])
        sound = bool(outputs) and min(outputs) >= 0 and inputs is not None
        text = ",".join(map(str, inputs or [])) + ";" + ",".join(map(str, outputs or []))
        return cls(sound, hashlib.sha256(text.encode()).hexdigest(), len(text), {"input_ids": inputs, "output_ids": outputs})


def _told(events: DataFrame) -> DataFrame:
    """Events with what Tokens.of finds, in place of their tokens. An event with a null among its tokens is not sound."""
    text = lambda c: F.coalesce(F.array_join(F.col(c).cast("array<string>"), ","), F.lit(""))
    whole = F.concat(text("input_ids"), F.lit(";"), text("output_ids"))
    sound = F.col("input_ids").isNotNull() & ~F.exists(F.coalesce("input_ids", F.array().cast("array<bigint>")), lambda x: x.isNull()) & valid_tokens(F.col("output_ids")) & (F.size("output_ids") > 0)
    told = {"sound": F.coalesce(sound, F.lit(False)), "digest": F.sha2(whole, 256), "size": F.length(whole)}
    return events.withColumns(told).drop("input_ids", "output_ids")


class Admission:
    """The machine of one trace. counters: a dict that survives; turns: a mapping of turn or request keys to JSON text."""

    def __init__(self, trace_id: str, counters: dict, turns: MutableMapping[str, str], limit: int | None = None, wire_limit: int = MAX_WIRE):
        self.trace_id, self.c, self.turns, self.limit, self.wire_limit = trace_id, counters, turns, limit, wire_limit
        self.rows: list[dict] = []

    def _write(self, event_no: int, record_type: str, tokens: Tokens | None = None, **fields) -> None:
        row = {"trace_id": self.trace_id, "event_no": event_no, "sequence": self.c["sequence"], "record_type": record_type, **fields}
        self.c["sequence"] += 1
        link = self.c["chain"] + json.dumps(row, sort_keys=True) + (tokens.digest if tokens else "")
        self.c["chain"] = hashlib.sha256(link.encode()).hexdigest()
        self.rows.append(row | {"chain_sha256": self.c["chain"]} | (tokens.kept if tokens else {}))

    def _gap(self, event_no: int, reason: str, reply: int | None = None) -> None:
        self.c["failed"] += 1
        self.c["gaps"] += 1
        self._write(event_no, "capture_gap", reason=reason, reply=reply)

    def _refused(self, event_no: int, reason: str, reply: int | None = None) -> None:
        """An answer that leaves no record."""
        self.rows.append({"trace_id": self.trace_id, "event_no": event_no, "record_type": "refused", "reason": reason, "reply": reply})

    def handle(self, e: dict) -> None:
        number = int(e["event_no"])
        if self.c["sealed"]:
            self._refused(number, "sealed", 503)
            return
        getattr(self, f"_{e['kind']}", self._unknown)(number, e)
        if self.c["waiting"] is not None and self.c["active"] == 0:
            self._seal(number)

    def _unknown(self, number: int, e: dict) -> None:
        self._gap(number, "event_unknown")

    def _request(self, number: int, e: dict) -> None:
        c = self.c
        if not c["accepting"]:
            self._refused(number, "admission_closed", 503)
            return
        c["received"] += 1
        if self.limit is not None and c["received"] >= self.limit:
            c["accepting"] = False
        names = [_none(e[k]) for k in ("session_id", "branch_id", "turn_id")]
        parent = _none(e["parent_turn_id"])
        good = all(isinstance(x, str) and _ALIAS.match(x) for x in [*names, *([parent] if parent is not None else [])])
        if not good or _none(e["metadata_session"]) != names[0] or parent == names[2] or _none(e["contract_mode"]) not in (None, "unknown", "append_only", "history_rewrite"):
            self._gap(number, CONTEXT_INVALID, 422)
        elif _none(e["streaming"]):
            self._gap(number, STREAM_UNSUPPORTED, 422)
        elif _none(e["bearer"]) not in (None, names[0]):
            self._gap(number, AUTH_MISMATCH, 422)
        elif (key := json.dumps(["turn", *names])) in self.turns:
            self._gap(number, DUPLICATE_TURN, 409)
        elif parent is not None and self.turns.get(json.dumps(["turn", *names[:2], parent])) != "completed":
            self._gap(number, PARENT_NOT_COMPLETED, 409)
        else:
            self.turns[key] = "reserved"
            self.turns[json.dumps(["request", e["request_id"]])] = json.dumps([*names, parent])
            c["active"] += 1

    def _response(self, number: int, e: dict) -> None:
        c, request = self.c, json.dumps(["request", e["request_id"]])
        known = self.turns.get(request)
        if not known or known == "done":
            self._refused(number, "response_unknown")
            return
        self.turns[request] = "done"
        c["active"] -= 1
        *names, parent = json.loads(known)
        status = _none(e["status"])
        if status is None:
            self._gap(number, FAILED_OR_CANCELLED)
        elif not 200 <= int(status) < 300:
            self._gap(number, UNSUCCESSFUL, int(status))
        else:
            c["succeeded"] += 1
            tokens = Tokens.of(e)
            c["wire"] += tokens.size
            if c["wire"] > self.wire_limit:
                c["accepting"] = False
                self._gap(number, WIRE_LIMIT, 502)
            elif not tokens.sound:
                self._gap(number, RECORD_FAILED, int(status))
            elif (_none(e["calls"]), _none(e["captured"])) != (1, 1):
                self._gap(number, COVERAGE_MISMATCH, int(status))
            else:
                self._generation(number, names, parent, tokens, int(status))

    def _generation(self, number: int, names: list[str], parent: str | None, tokens: Tokens, reply: int | None = None) -> None:
        self.c["generations"] += 1
        own = dict(zip(("session_id", "branch_id", "turn_id"), names, strict=True))
        self._write(number, "generation", tokens, reply=reply, **own, parent_turn_id=parent)
        self.turns[json.dumps(["turn", *names])] = "completed"

    def _callback(self, number: int, e: dict) -> None:
        """A turn that an adapter's callback hands over: its context may be one that could not be resolved (then reason says
        why) or may be missing, and the turn one that cannot be recorded."""
        self.c["invocations"] += 1
        names = [_none(e[k]) for k in ("session_id", "branch_id", "turn_id")]
        tokens = Tokens.of(e)
        if _none(e["reason"]):
            self._gap(number, RESOLVER_FAILED)
        elif names == [None] * 3:
            self._gap(number, CONTEXT_MISSING)
        elif not all(names) or not tokens.sound or json.dumps(["turn", *names]) in self.turns:
            self._gap(number, RECORD_FAILED)
        else:
            self.c["succeeded"] += 1
            self._generation(number, names, _none(e["parent_turn_id"]), tokens)

    def _health(self, number: int, e: dict) -> None:
        """The owner's count of served turns against the callbacks; then as finish, without a count of requests."""
        if self.c["invocations"] != _none(e["expected"]):
            self._gap(number, SERVED_MISMATCH)
        self.c["accepting"], self.c["waiting"] = False, -1

    def _stopped(self, number: int, reason: str) -> None:
        self.c["accepting"] = False
        self._gap(number, reason)

    def _abort(self, number: int, e: dict) -> None:
        self._stopped(number, _none(e["reason"]) or ABORTED)

    def _deadline(self, number: int, e: dict) -> None:
        self._stopped(number, DEADLINE)

    def _interrupt(self, number: int, e: dict) -> None:
        self._stopped(number, INTERRUPTED)

    def _finish(self, number: int, e: dict) -> None:
        """Stops admission; the seal waits until nothing is active."""
        self.c["accepting"] = False
        expected = _none(e["expected"])
        self.c["waiting"] = -1 if expected is None else int(expected)

    def timeout(self) -> None:
        """The time to drain is over."""
        if self.c["waiting"] is not None and not self.c["sealed"]:
            self.c["waiting"] = None
            self._gap(-1, SHUTDOWN_TIMEOUT)

    def _seal(self, number: int) -> None:
        c = self.c
        expected, c["waiting"] = c["waiting"], None
        if expected >= 0 and c["received"] != expected:
            self._gap(number, COUNT_MISMATCH)
        if c["failed"]:
            self._refused(number, "capture_incomplete")
            return
        self._write(number, "capture_complete", expected_generations=c["succeeded"], generations=c["generations"], capture_gaps=c["gaps"])
        c["sealed"] = True


def _frame(rows: list[dict]) -> pd.DataFrame:
    df = pd.DataFrame([{k: r.get(k) for k in _NAMES} for r in rows], columns=_NAMES, dtype=object)
    return df.astype({k: "Int64" for k in ("event_no", "sequence", "reply", "expected_generations", "generations", "capture_gaps")})


class _Entries(MutableMapping):
    """A map state as a mapping of text to text."""

    def __init__(self, state):
        self.state = state

    def __getitem__(self, key):
        if not self.state.containsKey((key,)):
            raise KeyError(key)
        return self.state.getValue((key,))[0]

    def __setitem__(self, key, value):
        self.state.updateValue((key,), (value,))

    def __delitem__(self, key):
        self.state.removeKey((key,))

    def __iter__(self):
        return (k[0] for k in self.state.keys())

    def __len__(self):
        return sum(1 for _ in self.state.keys())


class AdmissionProcessor(StatefulProcessor):
    def __init__(self, limit: int | None, drain_ms: int | None):
        self.limit, self.drain_ms = limit, drain_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", "counters string")
        self.turns = handle.getMapState("turns", "key string", "value string")

    def _machine(self, key) -> Admission:
        kept = self.counters.get() if self.counters.exists() else None
        return Admission(key[0], json.loads(kept[0]) if kept else dict(_START), _Entries(self.turns), self.limit)

    def _save(self, machine: Admission) -> Iterator[pd.DataFrame]:
        self.counters.update((json.dumps(machine.c),))
        if machine.rows:
            yield _frame(machine.rows)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        machine = self._machine(key)
        for e in pd.concat(list(rows)).sort_values("event_no", kind="stable").to_dict("records"):
            machine.handle(e)
        if self.drain_ms is not None and machine.c["waiting"] is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.drain_ms)
        yield from self._save(machine)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        machine = self._machine(key)
        machine.timeout()
        yield from self._save(machine)

    def close(self) -> None:
        pass


def admitted(events: DataFrame, *, limit: int | None = None, drain_ms: int | None = None) -> DataFrame:
    """Records of a stream of EVENTS, in RECORDS. Needs the RocksDB state store. Within a micro-batch events are taken in
    event order; the source must not deliver an event of a trace before an earlier one in an earlier batch."""
    return events.groupBy("trace_id").transformWithStateInPandas(AdmissionProcessor(limit, drain_ms), RECORDS, "Append", "ProcessingTime" if drain_ms is not None else "None")


def replayed(events: DataFrame, *, limit: int | None = None, wire_limit: int = MAX_WIRE) -> DataFrame:
    """The same over a table. A trace is one sequential machine and so one task; its rows pass through one by one, without
    their tokens, which join the recorded turns afterwards."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        machine = Admission(rows["trace_id"].iloc[0], dict(_START), {}, limit, wire_limit)
        for e in rows.sort_values("event_no", kind="stable").to_dict("records"):
            machine.handle(e)
        return _frame(machine.rows)

    made = _told(events).groupBy("trace_id").applyInPandas(run, RECORDS).drop("input_ids", "output_ids")
    tokens = events.where(F.col("output_ids").isNotNull()).select("trace_id", "event_no", "input_ids", "output_ids").dropDuplicates(["trace_id", "event_no"])
    r, t = made.alias("r"), tokens.alias("t")
    on = F.col("r.trace_id").eqNullSafe(F.col("t.trace_id")) & (F.col("r.event_no") == F.col("t.event_no")) & (F.col("r.record_type") == "generation")
    return r.join(t, on, "left").select(*(F.col(f"{'t' if c in ('input_ids', 'output_ids') else 'r'}.{c}") for c in _NAMES))
