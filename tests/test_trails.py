"""Provenance trails, unit catalogs, searches by kind and archives against plain versions."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gleaner.operators import retrieval, trail, units
from gleaner.sources.archive import Archive, compare_variants

NODES = "kind string, source_id string, section string, label string, basis string, path string, line int"
EDGES = "kind string, from_kind string, from_source string, to_kind string, to_source string, basis string"


def test_trail_resolves_or_tells(spark):
    one = spark.createDataFrame([("question", "q", "s", "Why?", "b", None, None), ("claim", "1", "s", "x", "b", None, None), ("claim", "1", "s", "x", "b", None, None), ("claim", "2", "s", "b", "b", None, None), ("claim", "2", "s", "a", "b", None, None)], NODES)
    two = spark.createDataFrame([("frontier", "f", "s", "far", "t", None, None), ("frontier", "g", "s", "near", "t", "a.go", 3), ("claim", None, "s", "?", "b", None, None), ("evidence", "1", "s", "e", "b", "b.go", None)], NODES)
    drawn = spark.createDataFrame(
        [("answers", "question", "q", "claim", "1", "m"), ("answers", "question", "q", "claim", "1", "k"), ("answers", "question", "q", "claim", "9", "m"), ("supports", "evidence", "7", "claim", "1", "m"), ("supports", "evidence", "7", "claim", "1", "m"), ("leaves_open", "claim", "2", "frontier", "g", "t"), ("supports", None, "1", "claim", None, "m")], EDGES
    )
    found = trail.provenance_trail([one, two], [drawn, drawn.where("false")], ("question", "q"))
    nodes = {r["id"]: r for r in found.nodes.collect()}
    edges = found.edges.collect()
    assert len(nodes) == 6 and all(e["src"] in nodes and e["dst"] in nodes for e in edges) and len({e["id"] for e in edges}) == len(edges)
    name = lambda i: (nodes[i]["kind"], nodes[i]["source_id"])
    assert {(e["kind"], name(e["src"]), name(e["dst"]), e["basis"]) for e in edges} == {("answers", ("question", "q"), ("claim", "1"), "k"), ("leaves_open", ("claim", "2"), ("frontier", "g"), "t"), ("frontier", ("question", "q"), ("frontier", "f"), "t")}
    assert next(r["label"] for r in nodes.values() if r["source_id"] == "2") == "a"
    assert {(name(r["id"]), r["path"], r["line"]) for r in found.locators.collect()} == {(("frontier", "g"), "a.go", 3), (("evidence", "1"), "b.go", None)}
    told = [(r["code"], r["kind"], r["n"]) for r in found.diagnostics.collect()]
    assert sorted(told) == sorted([("missing_source", "claim", 1), ("conflicting_node", "claim", 2), ("unknown_to", "answers", 1), ("unknown_from", "supports", 2), ("unknown_from", "supports", 1), ("unknown_to", "supports", 1)])
    again = trail.provenance_trail([two, one], [drawn], ("question", "none"))
    assert {r["id"] for r in again.nodes.collect()} == set(nodes) and "frontier" not in {e["kind"] for e in again.edges.collect()}
    empty = trail.provenance_trail([one.where("false")], [drawn.where("false")])
    assert all(df.count() == 0 for df in empty)


def module_of(path):
    parts = path.strip().removesuffix("/").split("/") if path is not None else [""]
    own, key = (parts[1], f"cmd/{parts[1]}") if parts[0] == "cmd" and len(parts) > 1 else (parts[0], parts[0])
    return key if own and "." not in own else None


def plain_units(members, chunk, threshold, most, levels):
    unit = {m: f"seed:{m[0] or ''}" if m[2] else f"module:{m[1]}:{module_of(m[0])}" if module_of(m[0]) else f"rest:{m[1]}" for m in members}
    key = {m: None if m[2] else module_of(m[0]) for m in members}
    chunks = lambda n: -(-n // chunk)
    for _ in range(levels):
        by = defaultdict(list)
        for m, u in unit.items():
            by[u].append(m)
        total = sum(chunks(len(ms)) for ms in by.values())
        for u in sorted(by):
            if not u.startswith("module:") or len(by[u]) <= threshold:
                continue
            nxt = {}
            for m in by[u]:
                rest = m[0].strip().removesuffix("/")[len(key[m]) + 1 :].split("/")[0]
                at_root = len(m[0].strip().removesuffix("/")) <= len(key[m])
                nxt[m] = key[m] if at_root else None if rest in ("", ".", "..") else f"{key[m]}/{rest}"
            kinds = defaultdict(int)
            for k in nxt.values():
                kinds[k] += 1
            more = sum(map(chunks, kinds.values())) - chunks(len(by[u]))
            if None in kinds or len(kinds) < 2 or total + more > most:
                continue
            total += more
            for m, k in nxt.items():
                key[m], unit[m] = k, f"module:{m[1]}:{k}"
    return unit


@pytest.mark.parametrize(("chunk", "threshold", "most", "levels"), [(4, 5, 30, 1), (2, 3, 45, 3), (48, 48, 64, 1)])
def test_units_split_while_the_budget_lasts(spark, chunk, threshold, most, levels):
    rnd = random.Random(levels)
    rows = []
    for scope in range(12):
        paths = {"/".join(rnd.choice(["a", "b", "cmd", "x.y", "", "..", "core"]) for _ in range(rnd.randint(1, 4))) for _ in range(60)} | {"cmd", "a", "b/", " a/q"}
        rows += [(scope, p, rnd.choice("rs"), rnd.random() < 0.1) for p in sorted(paths)]
    df = spark.createDataFrame([*rows, (99, None, "r", False)], "scope int, path string, role string, seed boolean")
    found = units.unit_catalog(df, ["scope"], "path", "role", "seed", chunk, threshold, most, levels)
    got = defaultdict(dict)
    for r in found.collect():
        got[r["scope"]][r["path"], r["role"], r["seed"]] = (r["unit"], r["chunk"])
    assert got.pop(99) == {(None, "r", False): ("rest:r", 0)}
    for scope, own in got.items():
        want = plain_units([m[1:] for m in rows if m[0] == scope], chunk, threshold, most, levels)
        assert {m: u for m, (u, _) in own.items()} == want
        by = defaultdict(list)
        for m, (u, c) in own.items():
            by[u].append((m[0], c))
        assert all([c for _, c in sorted(ms)] == [k // chunk for k in range(len(ms))] for ms in by.values())


def test_long_queries_meet_few_entries(spark):
    rows = [(k, "file", f"src/item{k * 7919 % 100_000:05d}.go", f"item{k * 7919 % 100_000:05d}.go") for k in range(2_000)]
    entries = spark.createDataFrame(rows, "entry int, kind string, path string, name string")
    asked = entries.where("entry < 50").select(F.col("path").alias("query"), F.col("path").alias("text"))
    met = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(retrieval, "_meet", lambda q, low, own=retrieval._meet: met.append(own(q, low)) or met[-1])
        assert retrieval.search_entries(asked, entries, "query", "text").where("match = 'exact_path'").count() == 50
    assert met[0].count() <= 100


def test_search_ranks_ten_levels(spark):
    rnd = random.Random(4)
    parts = ["io", "net", "Net/IO", "read", "reader", "a", "the", "theme", "é", "x y"]
    entries = [(k, rnd.choice(["symbol", "document", "file", None]), rnd.choice([None, "/".join(rnd.choice(parts) for _ in range(2))]), rnd.choice([None, *parts])) for k in range(200)]
    queries = [*parts, "IO", " the ", "", None, "zzz", "o", "net/", "x", "heme", "Net/IO/read"]
    df = spark.createDataFrame([(f"{k}", q) for k, q in enumerate(queries)], "query string, text string")
    found = defaultdict(list)
    for r in retrieval.search_entries(df, spark.createDataFrame(entries, "entry int, kind string, path string, name string"), "query", "text", 7).collect():
        found[r["query"]].append((r["rank"], r["priority"], r["match"], r["entry"]))
    low = lambda s: None if s is None else s.lower()
    want = {}
    for k, q in enumerate(queries):
        t = (q or "").strip().lower()
        hits = []
        for entry, kind, path, name in entries if t else ():
            p, n = low(path), low(name)
            both = [x for x in (p, n) if x is not None]
            level = 0 if p == t else 1 if n == t else 2 if any(x.startswith(t) for x in both) else 3 if any(t in x for x in both) else None
            if level is None:
                continue
            of = {"symbol": 0, "document": 1}.get(kind, 2)
            match = ["exact_path", "exact_name", "prefix", "substring"][level]
            first = lambda v: (v is not None, v or "")  # noqa: E731  nulls first, as Spark sorts
            hits.append(((retrieval.PRIORITY[match][of], first(p), first(n), first(path), first(name), entry), match))
        if hits:
            want[f"{k}"] = [(i, key[0], match, key[-1]) for i, (key, match) in enumerate(sorted(hits)[:7], 1)]
    assert {q: sorted(v) for q, v in found.items()} == want


def test_archive_keeps_changes_and_survives_replays(spark, tmp_path):
    archive = Archive(spark, f"{tmp_path}/archive", ["k"])
    schema = "k string, a int, b string"
    batches = [(1, [("x", 1, None), ("y", 2, "q"), (None, 5, "n")]), (2, [("x", 1, None), ("y", 3, "q"), ("z", 1, "")]), (3, [("x", 1, ""), (None, 5, "n")]), (2, [("x", 1, None), ("y", 3, "q"), ("z", 1, "")]), (4, [("x", 1, None)])]
    for number, rows in batches:
        archive.append(spark.createDataFrame(rows, schema), number)
    kept = archive.read(spark.createDataFrame([], schema).schema)
    assert {(r["k"], r["a"], r["b"], r["version"], r["batch"]) for r in kept.collect()} == {("x", 1, None, 1, 1), ("y", 2, "q", 1, 1), (None, 5, "n", 1, 1), ("y", 3, "q", 2, 2), ("z", 1, "", 1, 2), ("x", 1, "", 2, 3), ("x", 1, None, 3, 4)}
    rows = spark.createDataFrame([(1, "m", 5), (1, "f", 7), (2, "f", 1), (2, "f", 3), (3, "other", 9)], "k int, variant string, cost int")
    assert {tuple(r) for r in compare_variants(rows, ["k"], "variant", ["cost"], ["m", "f"]).collect()} == {(1, 5, 7), (2, None, 3), (3, None, None)}


def test_edges_meet_before_their_ids_are_made(spark, monkeypatch):
    plans, real = [], trail.settle
    monkeypatch.setattr(trail, "settle", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    nodes = spark.createDataFrame([("a", "1", "s", "l", "b", None, None), ("b", "", "s", "l", "b", None, None)], "kind string, source_id string, section string, label string, basis string, path string, line int")
    edges = spark.createDataFrame([("e", "a", "1", "b", None, "z"), ("e", "a", "1", "b", "", "y")], "kind string, from_kind string, from_source string, to_kind string, to_source string, basis string")
    found = trail.provenance_trail([nodes], [edges])
    assert [(r["kind"], r["basis"]) for r in found.edges.collect()] == [("e", "y")] and not found.diagnostics.collect()
    top, below = plans[1].split("\n", 1)
    assert top.startswith("Aggregate") and "sha2" not in top.split("], [")[0] and "sha2" not in below
