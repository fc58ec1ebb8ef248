"""Evaluation of responses on hand-made tasks."""

from gleaner.operators import responses as R

FLOWS = "task int, name string, confidence double, files array<string>, evidence array<string>, entry string"


def test_responses_pass_only_as_a_whole(spark):
    tasks = spark.createDataFrame([(k,) for k in range(1, 7)], "task int")
    directions = spark.createDataFrame([
        (1, "put", ["store", "PUT"], ["a.go", "b.go"]), (2, "put", ["put"], ["a.go"]), (3, "put", ["put"], ["z.go"]), (4, "get", ["get"], None), (5, "put", ["put"], []),
    ], "task int, direction string, aliases array<string>, paths array<string>")
    flows = spark.createDataFrame([
        (1, "Put path", 0.4, ["a.go"], ["b.go", "why it is so", "../x.go"], "main"), (2, "put one", 0.5, ["c.go"], [], None), (2, "put two", 0.9, ["a.go"], None, "cmd/main.GO"),
        (3, "put", 1.0, None, ["README.md", "*.go"], ""), (4, "none", None, [], [], None), (4, None, 1.0, ["q.go"], [], None), (5, "put", 0.1, ["a.go", "a.go"], ["a.go"], "a.go"),
    ], FLOWS)
    first = spark.createDataFrame([(1, "a.go"), (2, None), (6, "lost.go")], "task int, path string")
    allowed = spark.createDataFrame([(1, "a.go"), (1, "b.go"), (1, "a.go"), (2, "a.go"), (3, "*.go"), (5, "a.go")], "task int, path string")
    drill = "task int, symbol string, path string, seen_symbol string, seen_path string, test_target string, predicates array<string>, seen_predicates array<string>, tests array<string>, seen_tests array<string>"
    drilldowns = spark.createDataFrame([
        (1, "Put", "b.go", "Put", "b.go", "Put", ["w"], ["v", "w"], None, None), (2, "Put", "a.go", "Put", "a.go", "Get", [], [], [], []), (3, "Put", "no.go", "Put", "no.go", "Put", [], [], [], []), (5, "Put", "a.go", "Put", "a.go", "Put", [], [], ["t"], ["t"]),
    ], drill)
    forbidden = spark.createDataFrame([(1, "x", "o", ["always", "safe"]), (5, "x", "o", ["Always", "safe"]), (5, "y", "d", ["z"]), (5, "e", "o", [])], "task int, id string, scope string, contains_all array<string>")
    said = spark.createDataFrame([(1, "o", "always"), (1, "o", "safe"), (1, "d", "always safe"), (5, "o", "It is ALWAYS, truly, Safe."), (5, "o", None)], "task int, scope string, text string")
    checks = {(r["task"], r["direction"]): tuple(r)[2:] for r in R.direction_checks(directions, flows).collect()}
    assert checks[1, "put"] == (1, "PUT", "Put path", ["a.go", "b.go"], []) and checks[2, "put"] == (2, "put", "put two", ["a.go"], []) and checks[4, "get"] == (0, None, None, [], [])
    found = {r["task"]: tuple(r)[1:] for r in R.evaluate(tasks, directions, flows, first, allowed, drilldowns, forbidden, said).collect()}
    #   expected missing ambiguous missing_paths referenced invalid triggered linked drilled passed; evidence that leaves the repository is prose
    assert found[1] == (1, 0, 0, 0, 2, 0, 0, True, True, True)
    assert found[2] == (1, 0, 1, 0, 3, 2, 0, True, False, False)
    assert found[3] == (1, 0, 0, 1, 2, 1, 0, False, False, False)
    assert found[4] == (1, 1, 0, 0, 1, 1, 0, False, False, False)
    assert found[5] == (1, 0, 0, 0, 1, 0, 1, True, True, False)
    assert found[6] == (0, 0, 0, 0, 1, 1, 0, False, False, False)
    assert {r["task"]: r["unscored"] for r in R.grounding(first, flows, allowed).collect()}[1] == 2


def test_flows_and_paths_move_once(spark):
    """Flows meet directions once, with what they are linked to; references and allowed paths meet in one group, without a join."""
    flows = spark.createDataFrame([
        (1, "put a", 0.5, ["a.go", None], ["x y", "b.go", None, "x y", "ok prose"], "m.Go"), (1, "put a", 0.4, ["c.go"], None, None), (1, "put b", 0.9, ["d.go"], [], ""), (2, "get", 1.0, None, ["only prose"], None),
    ], FLOWS)
    first = spark.createDataFrame([(1, "a.go"), (1, None), (3, "f.go")], "task int, path string")
    allowed = spark.createDataFrame([(1, "a.go"), (1, "ok prose"), (1, "unused.go"), (1, None), (4, "unused.go")], "task int, path string")
    found = R.grounding(first, flows, allowed)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    # of task 1: a.go, b.go, m.Go, c.go, d.go and the allowed prose; task 4 has nothing that refers to a path
    assert {r["task"]: tuple(r)[1:] for r in found.collect()} == {1: (6, 4, 3), 2: (0, 0, 1), 3: (1, 1, 0)}
    directions = spark.createDataFrame([(1, "put", ["put"], ["a.go"]), (2, "put", ["put"], [])], "task int, direction string, aliases array<string>, paths array<string>")
    linked = lambda path: {r["task"]: (r["flow"], r["matched"], r["linked"]) for r in R._answers(directions, flows, spark.createDataFrame([(1, path), (1, None)], "task int, path string")).collect()}
    # another flow of the chosen one's name links it, one of another name does not
    assert linked("c.go") == {1: ("put a", 3, True), 2: (None, 0, False)} and linked("d.go")[1] == ("put a", 3, False)
