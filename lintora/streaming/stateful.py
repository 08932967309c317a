"""Operators with state by key: bursts of changes, profiles, sessions, live findings.

They need spark.sql.streaming.stateStore.providerClass to be ROCKSDB.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lintora.operators import learning

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BURST = "document string, kind string, text string, n_changes long, changed_at timestamp, fires_at timestamp"
PROFILE = "developer_id long, vuln_type string, rule_id string, detections long, fixes long, ignored long, false_positives long, suppressed boolean, adjusted_confidence double, n_actions long, hashes array<string>"
#: A stored profile: rows by part, type (counts), rule (confidence, n_actions) or hashes.
STORED = "developer_id long, part string, vuln_type string, rule_id string, counts array<bigint>, first_seen timestamp, last_seen timestamp, adjusted_confidence double, n_actions long, hashes array<string>"
DELIVERY = "event_id string, status string, attempts int, error string, payload string"
FINDING = "finding_key string, type string, severity string, confidence double, line_number int, rule_id string"
SNAPSHOT = f"document string, at timestamp, seq long, deleted boolean, {FINDING}"
SESSION = "session_id long, developer_id long, finding_id string, started_at timestamp, ended_at timestamp, n_findings long"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _ms(ts) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


def _ts(ms: int) -> dt.datetime:
    return dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc).replace(tzinfo=None)


class Bursts(StatefulProcessor):
    """One row for each burst of a document's changes, a gap after its last
    change, or at once when it is saved. A save takes the place of the pending
    burst; its number counts the changes of both. A close is a row of its own."""

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "text string, n long, at long")

    def _row(self, key: tuple, kind: str, text: str, n: int, at: int, fires: int) -> pd.DataFrame:
        return pd.DataFrame({"document": [key[0]], "kind": [kind], "text": [text], "n_changes": [n], "changed_at": [_ts(at)], "fires_at": [_ts(fires)]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "kind"], kind="stable")
        held = self.pending.get() if self.pending.exists() else None
        for ts, kind, text in zip(events["ts"], events["kind"], events["text"]):
            at = _ms(ts)
            if kind == "close":
                yield self._row(key, kind, None, 1, at, at)
                continue
            if held is not None and at - held[2] >= self.gap:
                yield self._row(key, "change", held[0], held[1], held[2], held[2] + self.gap)
                held = None
            n = 1 + (held[1] if held is not None else 0)
            if kind == "save":
                yield self._row(key, "save", text, n, at, at)
                held = None
            else:
                held = (text, n, at)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held is None:
            self.pending.clear()
        else:
            self.pending.update(held)
            self.handle.registerTimer(held[2] + self.gap)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.pending.exists():
            text, n, at = self.pending.get()
            self.pending.clear()
            yield self._row(key, "change", text, n, at, at + self.gap)

    def close(self) -> None:
        pass


class Profiles(StatefulProcessor):
    """A developer's learning profile: counters and suppression by type, the
    learned confidence by rule, and the window of false positives. Every batch
    gives the rows of the types and rules that it touched.

    Rows of a stored profile (STORED) may come before all events: state goes on
    from there."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.types = handle.getMapState("types", "vuln_type string", "detections long, fixes long, ignored long, false_positives long")
        self.rules = handle.getMapState("rules", "vuln_type string, rule_id string", "cents long, n long")
        self.hashes = handle.getValueState("hashes", "held string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for kind, vuln, rule, counts, confidence, n, hashes in zip(*(initialState[c] for c in ("part", "vuln_type", "rule_id", "counts", "adjusted_confidence", "n_actions", "hashes"))):
            if kind == "type":
                self.types.updateValue((vuln,), tuple(int(x) for x in counts))
            elif kind == "rule":
                self.rules.updateValue((vuln, rule), (round(confidence * 100), int(n)))
            else:
                self.hashes.update((json.dumps(list(hashes)),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        held = dict.fromkeys(json.loads(self.hashes.get()[0])) if self.hashes.exists() else {}
        types, touched = {}, {}
        places = {"DETECTED": 0, "FIXED": 1, "IGNORED": 2, "FALSE_POSITIVE": 3}
        least, most, start = (round(x * 100) for x in (learning.LEAST_CONFIDENCE, learning.MOST_CONFIDENCE, learning.START_CONFIDENCE))
        for kind, vuln, rule, snippet in zip(events["kind"], events["vuln_type"], events["rule_id"], events["snippet_hash"]):
            if vuln not in types:
                types[vuln] = list(self.types.getValue((vuln,))) if self.types.containsKey((vuln,)) else [0, 0, 0, 0]
            if (vuln, rule) not in touched:
                touched[vuln, rule] = list(self.rules.getValue((vuln, rule))) if self.rules.containsKey((vuln, rule)) else [start, 0]
            if kind in places:
                types[vuln][places[kind]] += 1
            if kind in learning.DELTAS:
                cents, n = touched[vuln, rule]
                touched[vuln, rule] = [max(least, min(most, cents + round(learning.DELTAS[kind] * 100))), n + 1]
            if kind == "FALSE_POSITIVE" and snippet not in held:
                held[snippet] = None
                if len(held) > learning.HASH_WINDOW:
                    del held[next(iter(held))]
        for vuln, counts in types.items():
            self.types.updateValue((vuln,), tuple(counts))
        for (vuln, rule), state in touched.items():
            self.rules.updateValue((vuln, rule), tuple(state))
        self.hashes.update((json.dumps(list(held)),))
        out = []
        for (vuln, rule), (cents, n) in touched.items():
            counts = types[vuln]
            out.append((key[0], vuln, rule, *counts, counts[3] >= learning.SUPPRESS_AFTER, cents / 100 if n else None, n, list(held)))
        yield pd.DataFrame(out, columns=_names(PROFILE))

    def close(self) -> None:
        pass


class Sessions(StatefulProcessor):
    """A developer's sessions from starts, findings and ends. A start ends the
    open session; a start of a session that was there already is nothing. A
    finding counts once, in the session that it names and only while that is open.
    An end overwrites the end of a session that has one already. Ended sessions
    are held until `keep_ms` of the developer's event time have passed; what comes
    for them later, or for a session that never began, is nothing.

    Each end gives a row with the session's times and number of findings, each
    new finding one without an end."""

    def __init__(self, keep_ms: int):
        self.keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "session_id long, started long, n long")
        self.seen = handle.getMapState("seen", "finding_id string", "at long")
        self.ended = handle.getMapState("ended", "session_id long", "started long, n long, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, now = [], self.open.get() if self.open.exists() else None

        def end(session: int, started: int, n: int, at: int) -> None:
            self.ended.updateValue((session,), (started, n, at))
            out.append((session, key[0], None, _ts(started), _ts(at), n))

        events = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        for ts, op, session, finding in zip(events["ts"], events["op"], events["session_id"], events["finding_id"]):
            at, session = _ms(ts), int(session)
            if op == "start":
                if self.ended.containsKey((session,)) or now is not None and now[0] == session:
                    continue
                if now is not None:
                    end(*now, at)
                self.seen.clear()
                now = (session, at, 0)
            elif op == "end":
                if now is not None and now[0] == session:
                    end(*now, at)
                    self.seen.clear()
                    now = None
                elif self.ended.containsKey((session,)):
                    end(session, *self.ended.getValue((session,))[:2], at)
            elif op == "finding" and now is not None and now[0] == session and not self.seen.containsKey((finding,)):
                self.seen.updateValue((finding,), (at,))
                now = (now[0], now[1], now[2] + 1)
                out.append((session, key[0], finding, _ts(now[1]), None, now[2]))
        if now is None:
            self.open.clear()
        else:
            self.open.update(now)
        old = [s for s, (_, _, at) in self.ended.iterator() if at < _ms(events["ts"].max()) - self.keep]
        for session in old:
            self.ended.removeKey(session)
        yield pd.DataFrame(out, columns=_names(SESSION))

    def close(self) -> None:
        pass


class LiveFindings(StatefulProcessor):
    """What the last analysis of a document has found. An analysis takes the
    place of all findings of the one before, also where it finds nothing; a close
    drops them. A row that is older than what is held changes nothing.

    Each batch gives the document's new snapshot: a row for each finding, or one
    with `deleted` and no finding where there is none."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "ts long, seq long")
        self.findings = handle.getListState("findings", FINDING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        last = events.iloc[-1]
        at = (_ms(last["ts"]), int(last["seq"]))
        if self.at.exists() and tuple(self.at.get()) >= at:
            return
        found = [] if last["kind"] == "close" or last["findings"] is None else [tuple(x[c] for c in _names(FINDING)) for x in last["findings"]]
        self.at.update(at)
        self.findings.put(found) if found else self.findings.clear()
        shown = [(key[0], _ts(at[0]), at[1], False, *x) for x in found] or [(key[0], _ts(at[0]), at[1], True, *[None] * len(_names(FINDING)))]
        yield pd.DataFrame(shown, columns=_names(SNAPSHOT)).astype({c: "object" for c in _names(FINDING)})

    def close(self) -> None:
        pass


class Deliveries(StatefulProcessor):
    """An event that is sent until it arrives or has been sent `attempts` times,
    a wait apart, with no more than one row of state. Every attempt gives a row:
    delivered, again, or dead. An event that comes again while it is held, or in
    the same batch, is sent once."""

    def __init__(self, post, attempts: int, wait_ms: int):
        self.post, self.attempts, self.wait = post, attempts, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "payload string, attempts int")

    def _send(self, key: tuple, payload: str, before: int, now: int) -> pd.DataFrame:
        status, error = "delivered", None
        try:
            self.post(json.loads(payload))
        except Exception as failure:  # noqa: BLE001  any failure of the receiver counts
            error = f"{type(failure).__name__}: {failure}"[:500]
            status = "again" if before + 1 < self.attempts else "dead"
        if status == "again":
            self.held.update((payload, before + 1))
            self.handle.registerTimer(now + self.wait)
        else:
            self.held.clear()
        return pd.DataFrame({"event_id": [key[0]], "status": [status], "attempts": [before + 1], "error": [error], "payload": [payload if status == "dead" else None]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        payload = [frame["payload"].iloc[-1] for frame in rows if len(frame)][-1]
        if not self.held.exists():
            yield self._send(key, payload, 0, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            yield self._send(key, *self.held.get(), timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass
