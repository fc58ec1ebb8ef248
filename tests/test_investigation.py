"""Sessions of thirteen kinds of events: the plain steps, the batch, and the stream."""

import random
from datetime import datetime, timedelta

from gleaner.streaming import investigation as V

BLANK = V.Event(*[None] * 10)


def event(kind, action=None, **more):
    return BLANK._replace(kind=kind, action=action, **more)


def run(*events, session=None):
    session = session or V.Session()
    for e in events:
        session, reason = V.step(session, e)
        assert reason is None, (e.kind, reason)
    return session


START = event("started", goal="know put", path="/r", symbol="Put", revision="r1")
RESOLVED = event("symbol_resolved", "step-001-resolve_symbol", symbol="Put", evidence="e1")
READ = event("source_read", "step-002-read_source", evidence="e1")
ASSESSED = event("source_assessed", "step-003-assess_source", operation="find_tests")
FOUND = event("test_references_found", "step-004-find_tests", symbol="Put")
DONE = event("finished", "step-005-await_user")


def test_a_whole_session():
    s = run(START, RESOLVED, READ, ASSESSED, FOUND)
    assert (s.state, s.pending, s.tests) == ("waiting_user", "step-005-await_user", True)
    s = run(DONE, session=s)
    assert (s.state, s.pending, s.stop) == ("completed", None, "finished")
    s = run(START, RESOLVED, READ, ASSESSED._replace(operation="read_callee"))
    assert s.pending == "step-004-await_user"


def test_a_local_component_ends_with_its_test_references():
    s = run(START._replace(local=True), RESOLVED, READ, event("test_references_found", "step-003-find_test_references", symbol="Put"))
    assert (s.state, s.stop, s.assessed) == ("completed", "finished", False)


def test_stale_and_misplaced_events_change_nothing():
    s = run(START)
    for e, why in (
        (RESOLVED._replace(action="step-999-resolve_symbol"), "stale_action"), (event("source_read", s.pending, evidence="e1"), "wrong_state"), (event("finished", s.pending), "wrong_state"), (START, "already_started"),
        (RESOLVED._replace(symbol="Get"), "other_symbol"), (event("claim_context_changed", message="x"), "no_claims"), (event("repository_changed", revision="r1"), "unchanged_revision"), (event("repository_changed", revision=" "), "invalid_payload"),
        (event("redirected", goal="g", symbol="s", revision="r9"), "other_revision"), (event("budget_exhausted", s.pending), "invalid_payload"), (event("nothing"), "unknown_kind"), (event(None), "unknown_kind"), (event("canceled", "step-000-x"), "stale_action"),
    ):
        assert V.step(s, e) == (s, why)
    assert V.step(V.Session(), RESOLVED) == (V.Session(), "not_started")


def test_changes_take_back_what_they_touch():
    s = run(START, RESOLVED, READ, ASSESSED)
    again = run(event("claim_context_changed", message="m"), session=s)
    assert (again.pending, again.evidence, again.assessed, again.operation) == ("step-005-assess_source", "e1", True, None)
    for e in (event("fact_context_changed", message="m"), event("repository_changed", revision="r2"), event("redirected", goal="g", symbol="Del")):
        reset = run(e, session=s)
        assert (reset.state, reset.pending, reset.evidence, reset.source, reset.assessed, reset.operation) == ("resolving_symbol", "step-005-resolve_symbol", None, False, False, None)
        assert V.step(reset, READ)[1] == "stale_action"
    ended = run(event("action_failed", s.pending, message="m"), session=s)
    assert (ended.state, V.step(ended, event("canceled"))[1], V.step(ended, event("budget_exhausted"))[1]) == ("blocked", "terminal", "terminal")
    assert run(event("repository_changed", revision="r2"), session=ended).state == "resolving_symbol"


def random_events(rnd):
    """Sessions mostly in step, with stale, early and unknown events among them."""
    rows, begin = [], datetime(2024, 1, 1)
    for name in "abcdefgh":
        s, at = V.Session(), 0
        for seq in range(60):
            at += rnd.choice([0, 1, 7])
            due = {"resolving_symbol": "symbol_resolved", "reading_source": "source_read", "assessing_source": "source_assessed", "finding_tests": "test_references_found", "finding_test_references": "test_references_found", "": "started"}
            kind = due[s.state] if s.state in due and rnd.random() < 0.6 else rnd.choice([*V.SHAPES, "unknown", None])
            values = {"goal": "g", "path": "/p", "symbol": s.symbol or "S", "evidence": s.evidence or f"e{seq}", "revision": rnd.choice([s.revision or "r", f"r{seq}"]), "operation": rnd.choice(["find_tests", "read_callee", "odd"]), "message": "m", "local": rnd.random() < 0.2}
            if kind == "redirected":
                values["symbol"] = f"S{seq}"
            action = s.pending if V.SHAPES.get(kind, ((), False))[1] else None
            e = V.Event(kind, action if rnd.random() < 0.9 else "step-001-resolve_symbol", **{k: values[k] if rnd.random() < 0.97 else None for k in V.Event._fields[2:]})
            s, _ = V.step(s, e)
            rows.append((name, begin + timedelta(minutes=at), seq, *e))
    return rows


def test_batch_and_stream_agree_on_shuffled_and_late_events(spark, tmp_path):
    rnd = random.Random(2)
    rows = random_events(rnd)
    want = set()
    for name in "abcdefgh":
        s = V.Session()
        for _, at, seq, *values in sorted((r for r in rows if r[0] == name), key=lambda r: r[1:3]):
            s, reason = V.step(s, V.Event(*values))
            want.add((name, seq, reason is None, reason, s.state, s.pending, s.revision, s.evidence, s.stop))
    assert sum(w[2] for w in want) > 100 and len({w[3] for w in want}) > 8
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    batch = spark.createDataFrame([*shuffled, (None, datetime(2024, 1, 1), 1, *BLANK)], V.EVENT)
    told = lambda df: {tuple(r) for r in df.select("session", "seq", "accepted", "reason", "state", "pending", "revision", "evidence", "stop").collect()}
    assert told(V.fold(batch)) == want and V.fold(batch.where("false")).count() == 0
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    batch.where("session <= 'd'").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = V.fold_stream(stream, "10 minutes").writeStream.format("memory").queryName("investigated").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        query.processAllAvailable()
        last = spark.createDataFrame([("z", datetime(2024, 1, 3), 1, *BLANK), ("z", datetime(2024, 1, 4), 2, *BLANK)], V.EVENT)
        last.coalesce(1).write.parquet(f"{tmp_path}/in/b")
        query.processAllAvailable()
        late = spark.createDataFrame([(*r[:2], 1000 + r[2], *r[3:]) for r in rows if r[0] == "a"], V.EVENT)
        late.coalesce(1).write.parquet(f"{tmp_path}/in/c")  # all behind the watermark: left out
        query.processAllAvailable()
        found = told(spark.table("investigated").where("session <= 'd'"))
    finally:
        query.stop()
        spark.conf.unset(store)
    assert found == {w for w in want if w[0] <= "d"}
