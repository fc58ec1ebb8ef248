"""Investigation sessions: thirteen kinds of events drive one typed state; what does not fit changes nothing.

A session resolves its symbol, reads the source, has it assessed and collects tests, one pending action at a
time.  Results must name the pending action, so results of older actions are stale.  A new revision, changed facts
and a redirection take back all that was derived; changed claims take back the assessment's report and tests only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What an event of a kind has to say, and whether it may (None), must or must not name an action.
SHAPES: dict[str, tuple[tuple[str, ...], bool | None]] = {
    "started": (("goal", "path", "symbol", "revision"), False),
    "symbol_resolved": (("symbol", "evidence"), True),
    "source_read": (("evidence",), True),
    "source_assessed": (("operation",), True),
    "test_references_found": (("symbol",), True),
    "repository_changed": (("revision",), False),
    "fact_context_changed": (("message",), False),
    "claim_context_changed": (("message",), False),
    "redirected": (("goal", "symbol"), False),
    "canceled": ((), None),
    "budget_exhausted": ((), False),
    "action_failed": (("message",), True),
    "finished": ((), True),
}
TERMINAL = ("completed", "canceled", "blocked")
FIELDS = ("kind", "action", "goal", "path", "symbol", "evidence", "revision", "operation", "local", "message")
EVENT = "session string, at timestamp, seq long, kind string, action string, goal string, path string, symbol string, evidence string, revision string, operation string, local boolean, message string"
OUT = "session string, at timestamp, seq long, kind string, accepted boolean, reason string, state string, pending string, revision string, evidence string, stop string"


class Event(NamedTuple):
    kind: str | None
    action: str | None
    goal: str | None
    path: str | None
    symbol: str | None
    evidence: str | None
    revision: str | None
    operation: str | None
    local: bool | None
    message: str | None


class Session(NamedTuple):
    """What is known of a session; state is empty before it has started."""

    state: str = ""
    sequence: int = 0
    goal: str | None = None
    path: str | None = None
    symbol: str | None = None
    revision: str | None = None
    local: bool = False
    evidence: str | None = None
    source: bool = False
    assessed: bool = False
    operation: str | None = None
    tests: bool = False
    pending: str | None = None
    stop: str | None = None


def _issue(s: Session, action: str, state: str) -> Session:
    n = s.sequence + 1
    return s._replace(sequence=n, state=state, stop=None, pending=f"step-{n:03d}-{action}")


def _again(s: Session) -> Session:
    """Nothing derived is left: the symbol is to be resolved anew."""
    return _issue(s._replace(evidence=None, source=False, assessed=False, operation=None, tests=False, pending=None, stop=None), "resolve_symbol", "resolving_symbol")


def _end(s: Session, state: str, stop: str) -> Session:
    return s._replace(state=state, pending=None, stop=stop)


def step(s: Session, e: Event) -> tuple[Session, str | None]:
    """The session after an event, and why the event was refused, if it was."""
    said, action = SHAPES.get(e.kind, (None, None))
    blank = lambda v: v is None or not str(v).strip()
    if said is None:
        return s, "unknown_kind"
    if any(blank(getattr(e, f)) for f in said) or (action is not None and blank(e.action) == action):
        return s, "invalid_payload"
    if e.kind == "started":
        if s.state:
            return s, "already_started"
        return _again(Session(goal=e.goal, path=e.path, symbol=e.symbol, revision=e.revision, local=bool(e.local))), None
    if not s.state:
        return s, "not_started"
    if e.kind == "repository_changed":
        return (s, "unchanged_revision") if e.revision == s.revision else (_again(s._replace(revision=e.revision, local=False)), None)
    if e.kind == "fact_context_changed":
        return _again(s), None
    if e.kind == "claim_context_changed":
        if not s.assessed or s.operation is None:
            return s, "no_claims"
        return _issue(s._replace(operation=None, tests=False, stop=None), "assess_source", "assessing_source"), None
    if e.kind == "redirected":
        if not blank(e.revision) and e.revision != s.revision:
            return s, "other_revision"
        return _again(s._replace(goal=e.goal, symbol=e.symbol)), None
    if e.kind == "budget_exhausted":
        return (s, "terminal") if s.state in TERMINAL else (_end(s, "blocked", "budget_exhausted"), None)
    if e.kind == "canceled" and s.state in TERMINAL:
        return s, "terminal"
    if not blank(e.action) and e.action != s.pending:
        return s, "stale_action"
    if e.kind == "canceled":
        return _end(s, "canceled", "canceled"), None
    if e.kind == "action_failed":
        return _end(s, "blocked", "action_failed"), None
    if e.kind == "symbol_resolved" and s.state == "resolving_symbol":
        return (s, "other_symbol") if e.symbol != s.symbol else (_issue(s._replace(evidence=e.evidence), "read_source", "reading_source"), None)
    if e.kind == "source_read" and s.state == "reading_source":
        if s.local:
            return _issue(s._replace(source=True), "find_test_references", "finding_test_references"), None
        return (s, "other_evidence") if e.evidence != s.evidence else (_issue(s._replace(source=True, assessed=True), "assess_source", "assessing_source"), None)
    if e.kind == "source_assessed" and s.state == "assessing_source":
        if e.operation not in ("find_tests", "read_callee"):
            return s, "unknown_operation"
        s = s._replace(operation=e.operation)
        return (_issue(s, "find_tests", "finding_tests") if e.operation == "find_tests" else _issue(s, "await_user", "waiting_user")), None
    if e.kind == "test_references_found" and s.state in ("finding_tests", "finding_test_references"):
        if e.symbol != s.symbol:
            return s, "other_symbol"
        s = s._replace(tests=True)
        return (_issue(s, "await_user", "waiting_user") if s.state == "finding_tests" else _end(s, "completed", "finished")), None
    if e.kind == "finished" and s.state == "waiting_user":
        return _end(s, "completed", "finished"), None
    return s, "wrong_state"


def _told(key: str, at, seq: int, e: Event, s: Session, reason: str | None) -> tuple:
    return key, at, seq, e.kind, reason is None, reason, s.state, s.pending, s.revision, s.evidence, s.stop


_NAMES = [c.split()[0] for c in OUT.split(", ")]


def _none(v):
    return None if v is None or v is pd.NaT or v != v else v


def fold(events: DataFrame) -> DataFrame:
    """Every event (EVENT's columns) with accepted, reason and the session after it: state, pending action, revision, evidence, stop.

    Events of a session go in order of time, then seq, then their own columns; those without a session are left out.  A
    session is folded in one task from sorted batches, of which only its state is held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, now = None, Session()
        for rows in batches:
            out = []
            for key, at, seq, *values in rows.itertuples(index=False, name=None):
                if key != held:
                    held, now = key, Session()
                event = Event(*map(_none, values))
                now, reason = step(now, event)
                out.append(_told(key, at, seq, event, now, reason))
            yield pd.DataFrame(out, columns=_NAMES)

    columns = ["session", "at", "seq", *FIELDS]
    return events.select(*columns).where("session is not null").repartition("session").sortWithinPartitions(*columns).mapInPandas(run, OUT)


class Investigations(StatefulProcessor):
    """Events wait until the watermark has passed them, then are applied in order; one value and one list a session."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "state string, sequence int, goal string, path string, symbol string, revision string, local boolean, evidence string, source boolean, assessed boolean, operation string, tests boolean, pending string, stop string")
        self.waiting = handle.getListState("waiting", "at long, seq long, kind string, action string, goal string, path string, symbol string, evidence string, revision string, operation string, local boolean, message string")

    def _apply(self, key: tuple, mark: int) -> Iterator[pd.DataFrame]:
        held = [tuple(w) for w in self.waiting.get()] if self.waiting.exists() else []
        late = lambda w: tuple((v is not None, v) for v in w)  # noqa: E731  nulls first, as Spark sorts
        ready, rest = sorted((w for w in held if w[0] <= mark), key=late), [w for w in held if w[0] > mark]
        if ready:
            now, out = Session(*self.session.get()) if self.session.exists() else Session(), []
            for at, seq, *values in ready:
                event = Event(*values)
                now, reason = step(now, event)
                out.append(_told(key[0], pd.Timestamp(at, unit="us"), seq, event, now, reason))
            self.session.update(tuple(now))
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            yield pd.DataFrame(out, columns=_NAMES)
        if rest:
            self.handle.registerTimer(max(min(w[0] for w in rest) // 1000 + 1, mark // 1000 + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = []
        for part in rows:
            part = part[["at", "seq", *FIELDS]]
            came += [(int(at.timestamp() * 1_000_000), int(seq), *map(_none, values)) for at, seq, *values in part.itertuples(index=False, name=None)]
        if came:
            self.waiting.appendList(came)
        yield from self._apply(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._apply(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, late: str) -> DataFrame:
    """fold() over a stream: an event is applied once the watermark, `late` behind the newest one, has passed it; one later
    than that is left out.  State lives in RocksDB: set spark.sql.streaming.stateStore.providerClass to its provider.
    """
    marked = events.select("session", "at", "seq", *FIELDS).where("session is not null").withWatermark("at", late)
    return marked.groupBy("session").transformWithStateInPandas(Investigations(), OUT, "Append", "EventTime")
