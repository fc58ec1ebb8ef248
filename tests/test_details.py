"""Owners, spreads, duplicates, checks and differences on odd tables and against plain loops."""

import json
import random
import re

from pyspark.sql import functions as F

from gleaner.operators import details as D


def test_first_opportunities_equal_the_plain_loop(spark):
    rnd = random.Random(3)
    for size, texts in ((60, 12), (120, 40), (40, 2)):
        rows, support = [], []
        for k in range(size):
            rows.append((k, rnd.choice("ab"), rnd.choice(["Why  so", "why SO", "how"]) + f" {rnd.randrange(texts)}", size - k))
            support += [(k, m) for m in rnd.sample(range(9), rnd.choice([0, 2, 3, 4]))]
        sets = {k: {m for i, m in support if i == k} for k in range(size)}
        want = []
        for k, kind, text, rank in sorted(rows, key=lambda r: r[3]):
            said = re.sub(r"\s+", " ", text).lower()
            if not any(kind == o[1] and (said == o[2] or (sets[k] | sets[o[0]] and len(sets[k] & sets[o[0]]) >= 0.75 * len(sets[k] | sets[o[0]]))) for o in want):
                want.append((k, kind, said))
        found = D.first_opportunities(spark.createDataFrame(rows, "id int, kind string, text string, rank int"), spark.createDataFrame(support, "id int, member int"), "kind", "id", "rank", F.col("text"))
        assert {r["id"] for r in found.collect()} == {w[0] for w in want}


def test_positions_spread_over_a_group(spark):
    rows = spark.createDataFrame([(n, i) for n in (1, 2, 3, 5, 9, 20) for i in range(n)], "g int, i int")
    quotas = spark.createDataFrame([(n, 6) for n in (1, 2, 3, 5, 9, 20)] + [(77, 2)], "g int, quota int")
    found = {}
    for r in D.spread_positions(rows, ["g"], [F.col("i")], quotas).orderBy("turn").collect():
        found.setdefault(r["g"], []).append(r["i"])
    want = {}
    for n in (1, 2, 3, 5, 9, 20):
        order = []
        for i in [n // 2, 0, n - 1, n // 4, 3 * (n - 1) // 4, n // 3, 2 * (n - 1) // 3, *range(n)]:
            if i not in order:
                order.append(i)
        want[n] = order[:6]
    assert found == want


def test_owners_fall_back_and_stay_apart(spark):
    d = spark.createDataFrame([(1, "f", "a.go", 3, 0), (2, "f", "a.go", 3, 7), (3, "g", "b.go", 1, 1), (4, "h", "c.go", 1, 1), (5, None, "b.go", 1, 1)], "declaration int, symbol string, path string, line int, column int")
    m = spark.createDataFrame([("f", "a.go", 3, 5, "x"), ("f", "a.go", 3, 0, "y"), ("g", "b.go", 2, 0, "z"), ("g", "b.go", 1, 1, None)], "symbol string, path string, line int, column int, owner string")
    files = spark.createDataFrame([("b.go", "p"), ("b.go", "q"), ("a.go", "p")], "path string, package string")
    packages = spark.createDataFrame([("p", "one"), ("q", "two"), ("q", "two"), ("r", None)], "package string, owner string")
    found = {r["declaration"]: (r["tier"], r["owners"]) for r in D.declared_owners(d, m, files, packages).collect()}
    assert found == {1: (0, ["x", "y"]), 2: (0, ["y"]), 3: (1, ["one", "two"]), 4: (None, []), 5: (1, ["one", "two"])}


def test_names_tell_signals_in_order(spark):
    names = ["CheckError", "wrapError", "Put", "Put2", "fillPut", "Persist", "saver", "unsave", "fsync", "Reader", "other", None]
    got = [r[0] for r in spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string").orderBy("k").select(D.name_signal(F.col("n"), F.lit("kv.Server.put"))).collect()]
    assert got == ["validation_name", "error_translation_name", "delegation_name", None, "response_enrichment_name", "persistence_name", "persistence_name", None, "io_name", "io_name", None, None]


def test_traces_come_back_as_they_were(spark):
    trace = {"kind": "bug", "candidates": [{"id": 2, "path": "a", "score": 5, "roles": ["x", "y"]}, {"id": 1, "path": "b", "score": 7, "roles": []}], "selected": [{"id": 1, "rank": 1}], "dropped": [{"id": 2, "reason": "file_limit"}]}
    texts = spark.createDataFrame([(1, json.dumps(trace)), (2, "{"), (3, None), (4, '{"kind": "x"}')], "k int, text string")
    rows = D.trace_rows(texts, "k", "text")
    assert {(r["k"], r["id"], r["rank"], r["reason"], r["readable"]) for r in rows.collect()} == {(1, 1, 1, None, True), (1, 2, None, "file_limit", True), (2, None, None, None, False), (3, None, None, None, False), (4, None, None, None, False)}
    (back,) = D.trace_json(rows, "k").collect()
    trace["candidates"].sort(key=lambda c: c["id"])
    assert json.loads(back["text"]) == trace


def test_relations_imports_coverage_and_paths(spark):
    relations = spark.createDataFrame([(1, "a", "b", "calls", "exact", "p", "o", "s"), (2, "a", "b", "calls", "exact", "p", "o", None), (3, "a", "z", None, "odd", " ", "o", "t"), (4, None, "b", "calls", "exact", "p", None, None)], "id int, src string, dst string, kind string, resolution string, provider string, operation string, scenario string")
    found = D.relation_violations(relations, spark.createDataFrame([("a",), ("b",)], "node string"), ["calls"], ["exact"], spark.createDataFrame([("s",)], "scenario string"))
    assert sorted(map(tuple, found.collect())) == sorted([("unknown_dst", 3), ("unknown_src", 4), ("bad_kind", 3), ("bad_resolution", 3), ("no_provenance", 3), ("no_provenance", 4), ("unknown_scenario", 3), ("duplicate_edge", 2)])
    used = spark.createDataFrame([(1, "m", "x", "fmt"), (1, "m", "x", "fmt"), (1, "m", "y", "fmt"), (1, "n", "x", "os"), (1, "n", "z", None)], "repo int, module string, importer string, name string")
    assert {tuple(r) for r in D.import_usage(used, "repo", "module", "importer", "name", 1, 1).collect()} == {(1, None, "fmt", 2, 1), (1, "m", "fmt", 2, 1), (1, "n", "os", 1, 1)}
    members = spark.createDataFrame([(1, "p", True, True, "u", None), (1, "q", True, True, "u", None), (1, "s", False, True, "u", "p"), (1, "t", False, False, "u", "q"), (1, "w", False, True, "v", "q"), (2, "p", True, True, "u", None)], "repo int, member string, primary boolean, production boolean, unit string, parent string")
    covered = spark.createDataFrame([(1, m) for m in "sstwx"], "repo int, member string")
    assert {tuple(r) for r in D.coverage_counts(members, covered, "repo").collect()} == {(1, 2, 1, 1, 3), (2, 1, 0, 1, 0)}
    state = "repo int, path string, from_path string, sha256 string"
    a = spark.createDataFrame([(1, "same", None, "1"), (1, "moved", "old", "2"), (1, "gone", "", "3"), (1, "back", None, None)], state)
    b = spark.createDataFrame([(1, "same", None, "1"), (1, "moved", "older", "2"), (1, "new", "gone2", "3"), (1, "back", None, None), (2, "gone", None, "3")], state)
    assert {tuple(r) for r in D.changed_paths(a, b, ["repo"]).collect()} == {(1, "moved"), (1, "old"), (1, "older"), (1, "gone"), (1, "new"), (1, "gone2"), (2, "gone")}


def test_acceptance_takes_the_newest_run_or_the_one_asked_for(spark):
    repos = spark.createDataFrame([("a", None), ("b", 7), ("c", 7), ("d", 99), ("e", None), ("f", 4)], "repository string, run int")
    runs = spark.createDataFrame([(1, "a", 5), (2, "a", 9), (3, "a", 9), (7, "x", 1), (4, "f", 0), (None, "e", 3)], "run int, repository string, created int")
    stages = spark.createDataFrame([(3, "facts", "ok", 2, 10, 5), (3, "study", "late", None, 1, None), (7, "facts", "ok", 1, 1, 1), (4, "study", None, 1, 1, 1)], "run int, stage string, state string, calls int, latency_ms int, request_bytes int")
    found = {r["repository"]: tuple(r)[1:] for r in D.acceptance_matrix(repos, runs, stages, ["facts"]).collect()}
    assert found == {
        "a": (3, "DEGRADED", "study:late", "facts:ok,study:late", 2, 11, 5), "b": (7, "SHARED", "", "facts:ok", 1, 1, 1), "c": (7, "SHARED", "", "facts:ok", 1, 1, 1),
        "d": (None, "MISSING", "", "", 0, 0, 0), "e": (None, "MISSING", "", "", 0, 0, 0), "f": (4, "FAILED", "facts:absent,study:none", "study:none", 1, 1, 1),
    }


def test_atlas_rows_hang_together(spark):
    units = spark.createDataFrame([("u", "repo"), ("u", "repo"), (None, "repo")], "unit string, kind string")
    entities = spark.createDataFrame([("u", "package", "p"), ("u", "package", "p"), ("v", "package", "q"), ("u", "module", None)], "unit string, kind string, name string")
    observations = spark.createDataFrame([("u", "package", "p", "calls", "x", "a.go", 3), ("u", "package", "p", "calls", "x", "a.go", 3), ("u", "package", "p", "calls", "x", "b.go", None), ("u", "module", "p", "calls", "x", None, None)], "unit string, entity_kind string, entity string, kind string, detail string, path string, line int")
    rows = D.atlas_tables(units, entities, observations).collect()
    kinds = [r["part"] for r in rows]
    assert {k: kinds.count(k) for k in set(kinds)} == {"unit": 1, "entity": 1, "observation": 1, "evidence": 2, "unresolved_entity": 1, "unresolved_observation": 1}
    ids = [r["id"] for r in rows if r["id"]]
    assert len(set(ids)) == len(ids) and all(r["parent"] in ids for r in rows if r["parent"])


def test_owners_meet_their_declarations_in_one_group(spark):
    d = spark.createDataFrame([(1, 7, 10, 1, 0), (2, 7, 10, 2, 5), (3, 8, 11, 1, 1), (4, 9, 12, 1, 1), (4, 9, 10, 1, 1), (None, 7, 10, 1, 0), (5, 1, None, 1, 1)], "declaration long, symbol long, path long, line int, column int")
    m = spark.createDataFrame([(7, 10, 1, 3, "B"), (7, 10, 1, 4, "A"), (7, 10, 1, 4, None), (7, 10, 2, 6, "C")], "symbol long, path long, line int, column int, owner string")
    files = spark.createDataFrame([(10, 100), (10, 101), (11, 102)], "path long, package long")
    packages = spark.createDataFrame([(100, "P"), (101, "O"), (102, None)], "package long, owner string")
    found = D.declared_owners(d, m, files, packages)
    assert {r[0]: (r[1], r[2]) for r in found.collect()} == {1: (0, ["A", "B"]), 2: (1, ["O", "P"]), 3: (None, []), 4: (1, ["O", "P"]), 5: (None, []), None: (None, [])}
    assert "LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_atlas_works_its_tables_out_once(spark, tmp_path):
    spark.createDataFrame([("u", "package", "p", "k", "d", "f", 3), ("u", "package", "q", "k", "d", "f", 3)], "unit string, entity_kind string, entity string, kind string, detail string, path string, line long").write.parquet(f"{tmp_path}/seen")
    units, entities = spark.createDataFrame([("u", "repository")], "unit string, kind string"), spark.createDataFrame([("u", "package", "p")], "unit string, kind string, name string")
    found = D.atlas_tables(units, entities, spark.read.parquet(f"{tmp_path}/seen"))
    assert sorted(r["part"] for r in found.collect()) == ["entity", "evidence", "observation", "unit", "unresolved_observation"]
    assert f"{tmp_path}/seen" not in found._jdf.queryExecution().toString()
