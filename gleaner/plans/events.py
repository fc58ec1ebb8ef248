"""Queries over the event log: state machines, windows, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.plans.bindings import Registry, table
from gleaner.streaming import investigation as I
from gleaner.streaming import sessions as Z

registry = Registry()
add = registry.add
_CASE = "CASE " + " ".join(f"WHEN w.state = '{a}' AND e.event_type = '{k}' THEN '{b}'" for (a, k), b in Z.MOVES.items())


@add("k2_session_fold", f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT user_id, 0 AS k, CAST(NULL AS BIGINT) AS event_id, 'new' AS state, true AS accepted FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT e.user_id, e.k, e.event_id, {_CASE} ELSE w.state END, {_CASE} END IS NOT NULL FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
SELECT event_id, state, accepted FROM w WHERE event_id IS NOT NULL""")
def session_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))
    return Z.fold(e).select(F.col("seq").alias("event_id"), "state", "accepted")


@add("d14_windowed_usage", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS calls, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.windowed_usage(table(spark, sf_dir, "events"), "ts", "10 minutes", "1 hour", ["event_type"], "value")


@add("k2_session_windows", """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS n FROM events), b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS i FROM a)
SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, i""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("start"))
    return found.select("user_id", "start", "n")


#: What the log's users do in turn after their start, the kind of action each step answers, and what it adds to the
#: count of actions; an error in the log is an event out of turn, which repeats an old action.
TURNS = [("symbol_resolved", "resolve_symbol"), ("source_read", "read_source"), ("source_assessed", "assess_source"), ("test_references_found", "find_tests"), ("claim_context_changed", None), ("source_assessed", "assess_source"), ("redirected", None), ("symbol_resolved", "resolve_symbol"), ("fact_context_changed", None), ("symbol_resolved", "resolve_symbol"), ("source_read", "read_source"), ("action_failed", "assess_source"), ("repository_changed", None)]
_KINDS = [k for k, _ in TURNS]
_ODD = ["started", "finished", "canceled", "budget_exhausted", "source_read", "unknown", "redirected"]


def investigation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as investigations of its users."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("k", F.row_number().over(w)).withColumn("m", F.sum(F.when((F.col("event_type") == "error") & (F.col("k") > 1), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = len(TURNS)
    e = e.withColumn("odd", (F.col("event_type") == "error") & (F.col("k") > 1)).withColumn("at_", F.pmod(F.col("m") - 2, F.lit(n)).cast("int")).withColumn("round", F.floor((F.col("m") - 2) / n))
    pick = lambda values, i: F.element_at(F.array(*(F.lit(v) for v in values)), (i + 1).cast("int"))
    kind = F.when(F.col("odd"), pick(_ODD, F.col("event_id") % len(_ODD))).when(F.col("m") == 1, "started").otherwise(pick(_KINDS, F.col("at_")))
    step = 1 + F.col("round") * (n - 1) + F.least("at_", F.lit(n - 2))
    action = F.format_string("step-%03d-%s", step.cast("long"), pick([a for _, a in TURNS], F.col("at_")))
    own = F.when(F.col("odd"), F.when((F.col("event_id") % len(_ODD)).isin(1, 4), "step-001-resolve_symbol")).when((F.col("m") > 1) & pick([a for _, a in TURNS], F.col("at_")).isNotNull(), action)
    moved = F.when(F.col("odd"), F.col("event_id") + 1000).when(F.col("m") == 1, 0).otherwise(F.col("round") + F.when(F.col("at_") >= 6, 1).otherwise(0))
    symbol, say = F.concat(F.lit("s"), moved.cast("string")), lambda c, kinds: F.when(F.col("kind").isin(kinds), c)
    rows = e.select(F.col("user_id").cast("string").alias("session"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"), own.alias("action"), symbol.alias("s"), "m", "at_", "round", "value")
    return rows.select(
        "session", "at", "seq", "kind", "action", say(F.lit("goal"), ["started", "redirected"]).alias("goal"), say(F.lit("/r"), ["started"]).alias("path"), say(F.col("s"), ["started", "redirected", "symbol_resolved", "test_references_found"]).alias("symbol"),
        say(F.concat(F.lit("e"), F.col("round").cast("string"), F.when(F.col("at_") > 8, "b").otherwise("a")), ["symbol_resolved", "source_read"]).alias("evidence"), F.when(F.col("kind") == "started", "r0").when(F.col("kind") == "repository_changed", F.concat(F.lit("r"), (F.col("round") + 1).cast("string"))).alias("revision"),
        say(F.when(F.col("at_") == 2, "find_tests").otherwise("read_callee"), ["source_assessed"]).alias("operation"), F.lit(False).alias("local"), say(F.when(F.col("value") > 2, "m"), ["fact_context_changed", "claim_context_changed", "action_failed"]).alias("message"),
    )


def _investigation_sql() -> str:
    n, lst = len(TURNS), lambda values: "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"
    actions = lst([a for _, a in TURNS])
    shapes = " ".join(f"WHEN kind = '{k}' THEN {' AND '.join(f'''coalesce(trim(e.{f}), '') <> '' ''' for f in fields) or 'true'} AND {'true' if named is None else f'''(coalesce(trim(action), '') <> '') = {str(named).lower()}'''}" for k, (fields, named) in I.SHAPES.items())
    issue = lambda action, state, more="": f"{{'ok': true, 'why': NULL, 'state': '{state}', 'seq': w.n + 1, 'pending': printf('step-%03d-{action}', w.n + 1), 'stop': NULL{more}}}"
    keep = {"goal": "w.goal", "symbol": "w.symbol", "revision": "w.revision", "evidence": "w.evidence", "assessed": "w.assessed", "operation": "w.operation"}
    with_ = lambda **new: "".join(f", '{k}': {v}" for k, v in (keep | new).items())
    again = lambda **new: issue("resolve_symbol", "resolving_symbol", with_(evidence="NULL", assessed="false", operation="NULL", **new))
    end = lambda state, stop: f"{{'ok': true, 'why': NULL, 'state': '{state}', 'seq': w.n, 'pending': NULL, 'stop': '{stop}'{with_()}}}"
    no = lambda why: f"{{'ok': false, 'why': '{why}', 'state': w.state, 'seq': w.n, 'pending': w.pending, 'stop': w.stop{with_()}}}"
    over = "w.state IN ('completed', 'canceled', 'blocked')"
    rules = [
        (f"kind NOT IN ({', '.join(repr(k) for k in I.SHAPES)})", no("unknown_kind")), (f"NOT CASE {shapes} END", no("invalid_payload")),
        ("kind = 'started' AND w.state <> ''", no("already_started")), ("kind = 'started'", issue("resolve_symbol", "resolving_symbol", with_(goal="e.goal", symbol="e.symbol", revision="e.revision", evidence="NULL", assessed="false", operation="NULL"))),
        ("w.state = ''", no("not_started")), ("kind = 'repository_changed' AND e.revision = w.revision", no("unchanged_revision")), ("kind = 'repository_changed'", again(revision="e.revision")),
        ("kind = 'fact_context_changed'", again()), ("kind = 'claim_context_changed' AND NOT (w.assessed AND w.operation IS NOT NULL)", no("no_claims")), ("kind = 'claim_context_changed'", issue("assess_source", "assessing_source", with_(operation="NULL"))),
        ("kind = 'redirected' AND e.revision <> w.revision", no("other_revision")), ("kind = 'redirected'", again(goal="e.goal", symbol="e.symbol")),
        (f"kind IN ('budget_exhausted', 'canceled') AND {over}", no("terminal")), ("kind = 'budget_exhausted'", end("blocked", "budget_exhausted")), ("action IS NOT NULL AND action IS DISTINCT FROM w.pending", no("stale_action")),
        ("kind = 'canceled'", end("canceled", "canceled")), ("kind = 'action_failed'", end("blocked", "action_failed")),
        ("kind = 'symbol_resolved' AND w.state = 'resolving_symbol' AND e.symbol <> w.symbol", no("other_symbol")), ("kind = 'symbol_resolved' AND w.state = 'resolving_symbol'", issue("read_source", "reading_source", with_(evidence="e.evidence"))),
        ("kind = 'source_read' AND w.state = 'reading_source' AND e.evidence <> w.evidence", no("other_evidence")), ("kind = 'source_read' AND w.state = 'reading_source'", issue("assess_source", "assessing_source", with_(assessed="true"))),
        ("kind = 'source_assessed' AND w.state = 'assessing_source' AND e.operation = 'find_tests'", issue("find_tests", "finding_tests", with_(operation="e.operation"))), ("kind = 'source_assessed' AND w.state = 'assessing_source'", issue("await_user", "waiting_user", with_(operation="e.operation"))),
        ("kind = 'test_references_found' AND w.state = 'finding_tests' AND e.symbol <> w.symbol", no("other_symbol")), ("kind = 'test_references_found' AND w.state = 'finding_tests'", issue("await_user", "waiting_user", with_())), ("kind = 'finished' AND w.state = 'waiting_user'", end("completed", "finished")),
    ]
    cases = " ".join(f"WHEN {when} THEN {then}" for when, then in rules)
    odd = len(_ODD)
    return f"""WITH RECURSIVE a AS (SELECT *, row_number() OVER u AS k FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT *, event_type = 'error' AND k > 1 AS odd, sum(CASE WHEN event_type = 'error' AND k > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY k) AS m FROM a),
    c AS (SELECT *, ((m - 2 + {n}) % {n})::INT AS p, floor((m - 2) / {n})::BIGINT AS r FROM b),
    d AS (SELECT *, CASE WHEN odd THEN {lst(_ODD)}[event_id % {odd} + 1] WHEN m = 1 THEN 'started' ELSE {lst(_KINDS)}[p + 1] END AS kind, CASE WHEN odd THEN CASE WHEN event_id % {odd} IN (1, 4) THEN 'step-001-resolve_symbol' END WHEN m > 1 AND {actions}[p + 1] IS NOT NULL THEN printf('step-%03d-%s', 1 + r * {n - 1} + least(p, {n - 2}), {actions}[p + 1]) END AS action,
      's' || CASE WHEN odd THEN event_id + 1000 WHEN m = 1 THEN 0 ELSE r + CASE WHEN p >= 6 THEN 1 ELSE 0 END END AS s FROM c),
    e AS (SELECT user_id, event_id, k, kind, action, CASE WHEN kind IN ('started', 'redirected') THEN 'goal' END AS goal, CASE kind WHEN 'started' THEN '/r' END AS path, CASE WHEN kind IN ('started', 'redirected', 'symbol_resolved', 'test_references_found') THEN s END AS symbol,
      CASE WHEN kind IN ('symbol_resolved', 'source_read') THEN 'e' || r || CASE WHEN p > 8 THEN 'b' ELSE 'a' END END AS evidence, CASE kind WHEN 'started' THEN 'r0' WHEN 'repository_changed' THEN 'r' || (r + 1) END AS revision, CASE kind WHEN 'source_assessed' THEN CASE p WHEN 2 THEN 'find_tests' ELSE 'read_callee' END END AS operation,
      CASE WHEN kind IN ('fact_context_changed', 'claim_context_changed', 'action_failed') AND value > 2 THEN 'm' END AS message FROM d),
    walk AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, true AS ok, NULL::VARCHAR AS why, '' AS state, 0::BIGINT AS n, NULL::VARCHAR AS pending, NULL::VARCHAR AS stop, NULL::VARCHAR AS goal, NULL::VARCHAR AS symbol, NULL::VARCHAR AS revision, NULL::VARCHAR AS evidence, false AS assessed, NULL::VARCHAR AS operation FROM (SELECT DISTINCT user_id FROM e) UNION ALL
      SELECT user_id, k, event_id, t.ok, t.why, t.state, t.seq, t.pending, t.stop, t.goal, t.symbol, t.revision, t.evidence, t.assessed, t.operation FROM (SELECT e.user_id, e.k, e.event_id, CASE {cases} ELSE {no('wrong_state')} END AS t FROM walk w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1))
    SELECT event_id, ok AS accepted, why AS reason, state, pending, revision, evidence, stop FROM walk WHERE event_id IS NOT NULL"""


@add("k2_investigation_fold", _investigation_sql())
def investigation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.fold(investigation_events(spark, sf_dir)).select(F.col("seq").alias("event_id"), "accepted", "reason", "state", "pending", "revision", "evidence", "stop")
