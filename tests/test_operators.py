"""Operators against hand-made tables: ambiguity, caps, ties, cycles, gaps, nulls."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from gleaner.functions import paths as P
from gleaner.functions import text as X
from gleaner.functions.rules import PROSE_RULES, SIGNAL_RULES
from gleaner.operators import evaluation as V
from gleaner.operators import evidence
from gleaner.operators import graph as G
from gleaner.operators import incremental as C
from gleaner.operators import intervals as I
from gleaner.operators import joins as J
from gleaner.operators import quality as Q
from gleaner.operators import ranking as R
from gleaner.operators import retrieval as T
from gleaner.operators import scan as N
from gleaner.operators import selection
from gleaner.operators import sets as S
from gleaner.sources import listing as L
from gleaner.streaming import sessions as Z


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_roles_follow_the_ordered_rules(spark):
    want = {
        "api/gen/x.pb.go": "generated", "a/testdata/b.go": "fixture", "pkg/a_test.go": "test", "eval-tools/x.go": "playground_preview_evaluator", "demo/main.go": "example", "labs/x.go": "experimental",
        "scripts/x.sh": "tooling", "docs/a.md": "current_documentation", "docs/adr/a.md": "historical_decision_documentation", "cmd/x/y.go": "primary_production_entry", "sdk/x.go": "public_api",
        "src/store/x.go": "effect_integration_boundary", "src/x.go": "production_core", "\\a\\\\main.py": "primary_production_entry",
    }
    df = spark.createDataFrame([(p,) for p in want], "path string").withColumn("role", P.artifact_role(F.col("path")))
    assert dict(rows(df)) == want
    hinted = spark.createDataFrame([("src/x.go", True), ("tests/x.go", True)], "path string, api boolean")
    assert [r["role"] for r in hinted.select(P.artifact_role(F.col("path"), {"public_api": F.col("api")}).alias("role")).collect()] == ["public_api", "test"]


def test_path_and_text_expressions(spark):
    df = spark.createDataFrame([("a/b/c.go", "a/d.go", "HTTPServerName_v2", "tried running classes", "http://H.com:80/x?b=1&a=2#f")], "p string, q string, n string, t string, u string")
    got = df.select(
        P.directory_distance(F.col("p"), F.col("q")), F.array_join(X.identifier_words(F.col("n")), " "), X.snake_case(F.lit("camelCaseName")), X.stem(F.lit("studies")), X.stem(F.lit("glass")), F.array_join(X.variants(F.lit("named")), " "), X.endpoint(F.col("u")),
        X.task_kind(F.lit("It FAILS: a nil pointer")), X.task_kind(F.lit("")), P.is_safe_path(F.lit("a/../b")), P.is_safe_path(F.lit("a/b")),
    ).first()
    assert list(got) == [1, "h t t p server name v2", "camel_case_name", "study", "glass", "named name nam nameds", "http://h.com/x?a=2&b=1", "bug", "unknown", False, True]
    red = spark.range(1).select(X.redact(F.lit('token = "abcdef1234567" Bearer abcdefgh12 sk-abcdefghij1')).alias("r")).first()["r"]
    assert red == 'token = "[redacted]" Bearer [redacted] [redacted]'


def test_required_literals_never_lose_a_match(spark):
    assert X.required_literals(r"a|b") == [] and X.required_literals(r"\blicensed?\b") == ["license"] and X.required_literals(r"x?(foo|barr)[a-z]+") == ["foo", "barr"]
    lines = ["func (s *srv) Put(x)", "quota Quota xquota équota", "Licensed", "licence license", "a@b.io", "go func(", "restore", "no"]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(lines)], "f int, line int, text string")
    got = {(r["line"], r["rule"]) for r in N.signals(df, ["f"], SIGNAL_RULES + PROSE_RULES).collect()}
    import re

    ascii_word = lambda p: re.compile(p, re.ASCII)
    want = {(k, j) for k, t in enumerate(lines) for j, (_, p, _, _) in enumerate(SIGNAL_RULES + PROSE_RULES) if ascii_word(p).search(t)}
    assert got == want


def test_lines_windows_and_caps(spark):
    files = spark.createDataFrame([(1, "a\nb\n\nc\n"), (2, ""), (3, None), (4, "x")], "f int, text string")
    assert rows(N.lines(files, ["f"], "text")) == [(1, 1, "a"), (1, 2, "b"), (1, 3, ""), (1, 4, "c"), (4, 1, "x")]
    wanted = spark.createDataFrame([(1, 1, 2), (1, 2, 2), (1, 4, 9)], "f int, start int, end int")
    assert [r[1] for r in rows(N.windows(files, wanted, ["f"], "text"))] == [1, 2, 4]
    hits = spark.createDataFrame([("s", f, line, w, 0) for f in (1, 2, 3) for line, w in ((1, 5), (2, 9), (2, 1))], "s string, f int, line int, weight int, rule int")
    best = N.best_signals(hits, ["s", "f"], 2)
    assert best.count() == 6 and {(r["line"], r["weight"]) for r in best.collect()} == {(1, 5), (2, 9)}
    assert N.capped(best, ["s"], ["s", "f"], [F.col("f")], 3).groupBy("f").count().orderBy("f").collect() == [(1, 2), (2, 1)]


def test_ledger_identity_and_partitioning(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([(g, i, rnd.randint(0, 5)) for i, g in enumerate(rnd.choices("abc", k=300))], "g string, id int, w int")
    results = []
    for parts in (1, 7):
        ledger = R.omission_ledger(df.repartition(parts), ["g"], [F.desc("w"), F.col("id")], 40, "id")
        assert all(r["eligible"] == r["selected"] + r["omitted"] for r in ledger.collect())
        results.append((rows(ledger), rows(R.top_k(df.repartition(parts), ["g"], [F.desc("w"), F.col("id")], 40))))
    assert results[0] == results[1]


def test_batches_budgets_and_winners(spark):
    df = spark.createDataFrame([("a", k, s) for k, s in enumerate([5, 5, 9, 1, 1, 1])], "g string, k int, size int")
    assert [r["batch"] for r in R.greedy_batches(df, ["g"], ["k"], "size", 3, 10).orderBy("k").collect()] == [1, 1, 2, 2, 3, 3]
    big = df.sparkSession.range(150_000).selectExpr("0 AS g", "id AS k", "1L AS size")
    batches = R.greedy_batches(big, ["g"], ["k"], "size", 3, 10)
    assert "collect_list" not in batches._jdf.queryExecution().toString()  # a scope's rows never meet in one row
    assert batches.where("batch <> k div 3 + 1").count() == 0 and batches.count() == 150_000
    assert rows(R.largest_fit(df, ["g"], [F.col("k")], "size", 10)) == [("a", 2, 10)] and rows(R.largest_fit(df, ["g"], [F.col("k")], "size", 4)) == [("a", 0, 0)]
    tiers = spark.createDataFrame([("x", 0, "p"), ("x", 0, "q"), ("x", 1, "r"), ("y", 1, "s"), ("z", 3, "t"), ("z", 3, "u"), ("z", 4, "v"), ("w", 3, "a"), ("w", 3, "b")], "k string, tier int, c string")
    assert rows(R.unique_winner(tiers, ["k"], "tier", "c")) == [("w", "unresolved", None), ("x", "ambiguous", None), ("y", "resolved", "s"), ("z", "resolved", "v")]


def test_intervals(spark):
    df = spark.createDataFrame([("p", 1, 3), ("p", 4, 6), ("p", 5, 5), ("p", 9, 9), ("q", 1, 200)], "p string, start int, end int")
    assert rows(I.merge(df, ["p"], "start", "end")) == [("p", 1, 6, 3), ("p", 9, 9, 1), ("q", 1, 200, 1)]
    points = spark.createDataFrame([("p", 4, 1), ("p", 5, 2), ("p", 7, 3), ("q", 150, 4), ("r", 1, 5)], "p string, at int, id int")
    ranges = df.withColumn("rid", F.col("start") * 1000 + F.col("end"))
    assert rows(I.narrowest(points, ranges, ["p"], "at", "start", "end", "rid")) == [("p", 4, 4006), ("p", 5, 5005), ("q", 150, 1200)]
    assert [r[1] for r in rows(I.uncovered(points, ranges, ["p"], "at", "start", "end").select("p", "at"))] == [7, 1]
    assert rows(I.resolve(points, ranges, "id", ["p"], "at", "start", "end", "rid")) == [(1, "resolved", 4006), (2, "resolved", 5005), (3, "unresolved", None), (4, "resolved", 1200), (5, "unresolved", None)]
    assert rows(I.clusters(points, ["p"], "at", 1)) == [("p", 4, 5, 2), ("p", 7, 7, 1), ("q", 150, 150, 1), ("r", 1, 1, 1)]


def test_near_duplicates_are_not_transitive(spark):
    df = spark.createDataFrame([(k, k) for k in range(1, 5)], "id int, r int")
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a int, b int")
    assert [r[0] for r in rows(S.keep_first(df, chain, "id", "r"))] == [1, 3]
    rnd = random.Random(3)
    sets = {i: set(rnd.sample(range(9), rnd.randint(1, 6))) for i in range(60)}
    got = {(r["a"], r["b"]) for r in S.overlaps(spark.createDataFrame([("s", i, m) for i, x in sets.items() for m in x], "s string, i int, m int"), ["s"], "i", "m", 0.75).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])}


def test_ambiguity_is_a_result(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,), (3,)], "n int")
    edges = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (1, 9)], "s int, t int")
    assert rows(J.closed_edges(edges, nodes, "s", "t", "n")) == [(1, 2)]
    found = J.attach_unique(spark.createDataFrame([(1,), (2,), (3,)], "k int"), spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "c")], "k int, v string"), ["k"], "v", "got")
    assert rows(found) == [(1, "resolved", "a"), (2, "ambiguous", None), (3, "missing", None)]
    assert rows(Q.key_conflicts(spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, None), (3, "c")], "k int, v string"), ["k"])) == [(1, 2, 1, "duplicate"), (2, 2, 2, "conflict")]


def test_graph_with_cycle_and_diamond(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (4, 5), (8, 9)], "src long, dst long")
    start = spark.createDataFrame([(1,)], "node long")
    assert rows(G.distances(edges, start)) == [(1, 0), (2, 1), (3, 1), (4, 2), (5, 3)]
    assert rows(G.distances(edges, start, 1)) == [(1, 0), (2, 1), (3, 1)]
    tight = G.shortest_predecessors(edges, start, spark.createDataFrame([(4,)], "node long"))
    assert rows(tight) == [(1, 2, 1), (1, 3, 1), (2, 4, 2), (3, 4, 2)]
    parents = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4)], "node long, parent long")
    assert rows(G.top_of_chain(parents, start)) == [(1, 1), (2, 1), (3, 1), (4, None), (5, None)]


def test_changes_and_budgets(spark):
    old, new = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1)], "k int, x string, y int"), spark.createDataFrame([(1, "a", None), (2, "z", 2), (4, "d", 1)], "k int, x string, y int")
    assert rows(C.context_diff(old, new, ["k"], ["x", "y"])) == [(1, "same", ""), (2, "changed", "x,y"), (3, "missing", ""), (4, "new", "")]
    work = spark.createDataFrame([("s", k, z, t) for k, (z, t) in enumerate([(5, "a"), (5, "b"), (5, "a"), (1, "b")])], "s string, k int, z int, t string")
    assert [r["reason"] for r in C.budget_gate(work, ["s"], ["k"], "z", 3, 9, 99, "t").orderBy("k").collect()] == ["", "", "stage_bytes", "calls"]


def test_unknown_latency_is_not_zero(spark):
    log = spark.createDataFrame([("a", 1, None), ("a", 2, 0), ("b", 3, None)], "s string, b int, l int")
    assert rows(V.usage_rollup(log, ["s"], "b", "l")) == [("a", 2, 3, 0, 1), ("b", 1, 3, None, 1), (None, 3, 6, 0, 2)]


def test_retrieval_covers_terms_greedily(spark):
    tasks = spark.createDataFrame([(1, "Fix `parseURL` when parseURL fails, the cache cache cache")], "t int, x string")
    terms = {r["term"]: (r["weight"], r["times"]) for r in T.weighted_terms(tasks, "t", "x").collect()}
    assert terms["parseurl"] == (16, 3) and terms["cache"] == (6, 3) and terms["fix"] == (4, 1)
    held = spark.createDataFrame([(1, f, t, w) for f, t, w in [("a", "x", 5), ("a", "y", 5), ("b", "y", 5), ("b", "z", 1), ("c", "x", 5)]], "t int, f string, term string, w int")
    assert rows(T.coverage_greedy(held, "t", "f", "term", "w").select("f", "gain", "position")) == [("a", 10, 1), ("b", 1, 2)]


def test_snapshots_refuse_another_context(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "k int")
    L.save_snapshot(df, str(tmp_path / "s"), {"head": "x", "tool": "1"})
    assert rows(L.load_snapshot(spark, str(tmp_path / "s"), {"head": "x", "tool": "1"})) == [(1,)]
    with pytest.raises(ValueError, match="head"):
        L.load_snapshot(spark, str(tmp_path / "s"), {"head": "y", "tool": "1"})
    records = spark.createDataFrame([("100644 ab 0\ta b",), ("100644 ab 0\ta b",), ("120000 cd 0\tl",), ("100644 ef 2\tu",)], "r string")
    assert rows(L.read_listing(records, [], "r").select("path", "is_regular")) == [("a b", True), ("l", False), ("u", False)]


def test_stream_and_batch_fold_agree(spark, tmp_path):
    kinds = ["view", "click", "purchase", "purchase", "view", "error", "click"]
    events = [(s, f"2024-01-01 00:{10 + k:02d}:00", k, kind) for s in (1, 2) for k, kind in enumerate(kinds[s - 1 :])] + [(9, "2024-01-01 09:00:00", 0, "view")]
    batch = spark.createDataFrame(events, "session long, at string, seq long, kind string").withColumn("at", F.to_timestamp("at"))
    want = rows(Z.fold(batch).where("session < 9").select("session", "seq", "state", "accepted"))
    assert [r for r in want if not r[3]] == [(1, 3, "done", False), (1, 6, "failed", False), (2, 0, "new", False), (2, 1, "new", False), (2, 2, "new", False), (2, 5, "failed", False)]
    shuffled = batch.orderBy(F.rand(4)).coalesce(1)
    shuffled.where("session < 9").write.parquet(f"{tmp_path}/in/a")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in/*")
    query = Z.fold_stream(stream, "1 minute").writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        query.processAllAvailable()
        batch.where("session = 9").coalesce(1).write.parquet(f"{tmp_path}/in/b")
        query.processAllAvailable()
        got = rows(spark.sql("select session, seq, state, accepted from folded where session < 9"))
    finally:
        query.stop()
    assert got == want


def test_diverse_directions_match_plain_choice(spark):
    rnd = random.Random(4)
    rows = [(s, i, sorted(rnd.sample(range(5), rnd.randint(0, 4))), rnd.choice("ab"), sorted(rnd.sample(range(6), rnd.randint(0, 5)))) for s in range(12) for i in range(20)]
    df = spark.createDataFrame(rows, "s int, i int, anchors array<int>, stage string, terms array<int>")
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0.0
    want = set()
    for s in range(12):
        kept = []
        for r in (r for r in rows if r[0] == s):
            if len(kept) < 4 and not any((j := jaccard(r[2], k[2])) >= 0.8 or (j >= 0.6 and r[3] == k[3]) or jaccard(r[4], k[4]) >= 0.68 for k in kept):
                kept.append(r)
        want |= {(s, r[1]) for r in kept}
    found = selection.diverse_directions(df, ["s"], ["i"], "anchors", "stage", "terms", 4)
    assert {(r["s"], r["i"]) for r in found.where("selected").collect()} == want and found.count() == len(rows)
    assert selection.diverse_directions(df.where("false"), ["s"], ["i"], "anchors", "stage", "terms", 4).count() == 0


def test_role_contract_matches_plain_choice(spark):
    rnd = random.Random(5)
    rows = [(s, rnd.choice("xyz"), a, f"f{rnd.randrange(6)}", rnd.randrange(9)) for s in range(10) for a in range(30)]
    df = spark.createDataFrame(rows, "s int, role string, anchor int, file string, score int")
    minimum, want = {"y": 2, "x": 1}, set()
    for s in range(10):
        seen, files, chosen = set(), {}, []
        own = [r for r in rows if r[0] == s]
        near = [r for role in "xyz" for r in sorted((r for r in own if r[1] == role), key=lambda r: (-r[4], r[2]))[:16]]
        queue = [(r, role) for role in minimum for r in sorted((r for r in near if r[1] == role), key=lambda r: (-r[4], r[2]))] + [(r, None) for r in sorted(near, key=lambda r: (-r[4], r[2], r[1]))]
        count = dict.fromkeys(minimum, 0)
        for r, role in queue:
            if r[2] in seen or (role and count[role] >= minimum[role]) or files.get(r[3], 0) >= 2 or len(chosen) >= 8:
                continue
            seen.add(r[2])
            files[r[3]] = files.get(r[3], 0) + 1
            chosen.append((s, r[2], "reserved" if role else "filled"))
            if role:
                count[role] += 1
        want |= set(chosen)
    found = selection.role_contract(df, ["s"], "role", "anchor", "file", "score", minimum, 2, 8)
    assert {(r["s"], r["anchor"], r["reason"]) for r in found.collect()} == want


def test_bytes_of_a_corpus_are_cut_between_characters(spark, tmp_path):
    texts = ["", "plain", "ééé", "日本語", "a🙂b", "🙂🙂", None, "x" * 50]
    spark.createDataFrame(list(enumerate(texts)), "i int, content string").write.parquet(f"{tmp_path}/c")
    for most in (1, 2, 3, 4, 5, 7):
        for r in L.read_corpus(spark, f"{tmp_path}/c", most_bytes=most).collect():
            data = None if texts[r["i"]] is None else texts[r["i"]].encode()
            assert r["content"] == (None if data is None else data[:most].decode(errors="ignore")) and r["truncated"] == (data is not None and len(data) > most), (most, r)


def test_short_names_are_searched(spark):
    queries = spark.createDataFrame([("io",), ("n",), ("",), ("net/io",)], "query string")
    names = spark.createDataFrame([("io",), ("net/io",), ("n",), ("",), (None,)], "name string")
    found = {(r["query"], r["name"], r["match"]) for r in T.lexical_search(queries.withColumn("text", queries["query"]), names, "query", "text", "name").collect()}
    assert found == {("io", "io", "exact"), ("io", "net/io", "substring"), ("n", "n", "exact"), ("n", "net/io", "prefix"), ("net/io", "net/io", "exact")}


def test_evidence_of_odd_tables(spark):
    rows = spark.createDataFrame([(1, "a/b/c"), (1, "a/b/d"), (2, None), (3, "x"), (4, "a"), (4, "a/b")], "g int, path string")
    assert {(r["g"], r["prefix"]) for r in evidence.common_prefix(rows, ["g"], "path").collect()} >= {(1, "a/b"), (3, "x"), (4, "a")}
    keyed = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None)], "k int, v string")
    assert {tuple(r) for r in evidence.unique_rows(keyed, ["k"], ["v"]).collect()} == {(1, "a"), (3, None)}
    votes = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None)], "g int, o string")
    assert {tuple(r) for r in evidence.majority(votes, ["g"], "o").collect()} == {(1, "a", 1)}


def test_task_retrieval_matches_plain_choice(spark):
    """Terms, scores, the best candidates and the choice that covers the terms, in plain Python."""
    rnd = random.Random(6)
    words = [f"word{i}" for i in range(40)] + ["do_it", "MixedCase", "a.b"]
    tasks = [(i, " ".join(rnd.choice(words) for _ in range(8))) for i in range(6)]
    files = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30)))) for i in range(50)] + [(99, None)]
    terms = T.weighted_terms(spark.createDataFrame(tasks, "task int, text string"), "task", "text")
    docs = spark.createDataFrame(files, "file int, text string")
    index = T.inverted_index(docs, "file", "text")
    best = T.score_files(terms, index, "task", "file", 20)
    held = best.select("task", "file").join(terms, "task").join(index.withColumnRenamed("token", "term"), ["file", "term"])
    found = {(r["task"], r["file"], r["gain"], r["position"]) for r in T.coverage_greedy(held.select("task", "file", "term", "weight"), "task", "file", "term", "weight", 5).collect()}
    weights = {(r["task"], r["term"]): r["weight"] for r in terms.collect()}
    want = set()
    for task, _ in tasks:
        own = {t: w for (k, t), w in weights.items() if k == task}
        hits = {f: {t: n for t in own if (n := sum(x == t for x in re.findall(r"\w+", text.lower())))} for f, text in files if text}
        score = {f: sum(own[t] + 8 + min(n, 6) * 2 for t, n in h.items()) for f, h in hits.items() if h}
        near = sorted(score, key=lambda f: (-score[f], -len(hits[f]), f))[:20]
        covered = set()
        for position in range(1, 6):
            if not near:
                break
            pick = min(near, key=lambda f: (-sum(own[t] for t in hits[f] if t not in covered), f))
            gain = sum(own[t] for t in hits[pick] if t not in covered)
            if gain <= 0:
                break
            want.add((task, pick, gain, position))
            near.remove(pick)
            covered |= hits[pick].keys()
    assert found == want
    asked = spark.createDataFrame([("word1",), ("do_it",)], "token string")
    assert rows(T.inverted_index(docs, "file", "text", asked)) == rows(index.where("token in ('word1', 'do_it')"))


def test_group_quota_places_pins_of_crowded_folders_by_order(spark):
    rows = [("s", "source", "full", True, k, f"full{k}") for k in range(8)] + [("s", "source", f"d{k}", True, 100 + k, f"d{k}") for k in range(8)]
    df = spark.createDataFrame(rows, "s string, grp string, dir string, pin boolean, order long, path string")
    found = selection.group_quota(df, ["s"], "grp", "dir", "pin", ["order", "path"], {"source": 3}, 2, 6)
    assert [r.path for r in found.orderBy("position").collect()] == [f"full{k}" for k in range(6)]


def _shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("WindowGroupLimit")


def test_top_k_cuts_groups_before_its_only_shuffle(spark):
    from pyspark.sql import functions as F

    from gleaner.operators.ranking import top_k

    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), F.hash("id").alias("v"), "id")
    best = top_k(rows, ["g"], [F.desc("v"), F.col("id")], 5)
    assert _shuffles(best) == (1, 2)
    want = {(r.g, r.id, r.rank) for r in top_k(rows, ["g"], [F.desc("v"), F.col("id")], 2000).where("rank <= 5").collect()}
    assert {(r.g, r.id, r.rank) for r in best.collect()} == want


def test_role_scores_shuffle_whole_candidates_once(spark):
    from gleaner.operators import roles

    one = spark.createDataFrame([("s", 1, "a/b", "ring bolt", 5, ["ring"], ["R"], True)], "s string, anchor long, path string, symbol string, base long, terms array<string>, roles array<string>, complete boolean")
    terms = spark.createDataFrame([("s", "ring", 3), ("s", "rings", None), ("t", "ring", 9)], "s string, term string, weight int")
    with_limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = roles.role_scores(one, terms, ["s"], ["R"], {}, {}, {})
        assert "anchor" not in " ".join(line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line)
        assert [r.score for r in out.collect()] == [5 - 12 + 2 * 3 + 12 * 3 + 24]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_limit)


def test_branches_of_many_roots_go_together(spark):
    from gleaner.operators import graph

    links = [(k, 1000) for k in range(200)] + [(1000, 1001), (1001, 1002), (1002, 1001), (7, 1003), (None, 5)]
    edges = spark.createDataFrame(links, "src long, dst long")
    roots = spark.createDataFrame([(k,) for k in range(200)], "node long")
    found = graph.branches(edges, roots)
    want = {(k, n) for k in range(200) for n in (k, 1000, 1001, 1002)} | {(7, 1003)}
    assert sorted((r.root, r.node) for r in found.collect()) == sorted(want)
    assert "bits" in found._jdf.queryExecution().analyzed().toString()  # chunks of 64 roots travel, not each by itself


def test_overlaps_read_their_sets_once_and_count_nulls(spark, tmp_path):
    sets = {1: [1, 2, 3, None], 2: [1, 2, 3, None], 3: [4, 5, 6, 7], 4: [4, 5, 6, 7], 5: [8], 6: [None]}
    spark.createDataFrame([("s", i, m) for i, x in sets.items() for m in x] + [("s", None, 4), (None, 7, 4), (None, 8, 4)], "s string, i int, m int").write.parquet(f"{tmp_path}/sets")
    found = S.overlaps(spark.read.parquet(f"{tmp_path}/sets"), ["s"], "i", "m", 0.5)
    assert f"{tmp_path}/sets" not in found._jdf.queryExecution().toString()
    assert sorted((r["a"], r["b"], r["shared"], r["jaccard"]) for r in found.collect()) == [(1, 2, 3, 0.6), (3, 4, 4, 1.0)]


def test_undirected_edges_move_once_a_pair(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 3), (5, None), (None, 5), (None, None), (4, 1)], "src long, dst long")
    found = G.undirected(edges)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, [(1, 2), (2, 1), (3, 3), (5, None), (None, 5), (None, None), (4, 1), (1, 4)]))
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_files_are_scored_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(T, "INDEX_ROWS", 10)
    terms = spark.createDataFrame([(1, "a", 2), (1, "b", 4), (2, "b", 4), (2, "z", 16)], "task long, term string, weight int")
    index = spark.createDataFrame([(f, t, f % 9) for f in range(200) for t in "ab" if f % 3 or t == "b"], "file long, token string, hits long")
    found = T.score_files(terms, index, "task", "file", 5)
    want = {}
    for f in range(200):
        for task, weight, t in ((1, 2, "a"), (1, 4, "b"), (2, 4, "b")):
            if f % 3 or t == "b":
                score, n = want.get((task, f), (0, 0))
                want[task, f] = (score + weight + 8 + 2 * min(f % 9, 6), n + 1)
    best = {task: sorted((-s, -n, f) for (t, f), (s, n) in want.items() if t == task)[:5] for task in (1, 2)}
    assert sorted(map(tuple, found.collect())) == sorted((task, f, -s, -n, k + 1) for task, rows_ in best.items() for k, (s, n, f) in enumerate(rows_))
    assert re.search(r"RepartitionByExpression \[file#\d+L?\], (3[3-9]|[4-9]\d|\d{3})", found._jdf.queryExecution().optimizedPlan().toString())


def test_nodes_on_common_cycles_walk_as_one(spark, monkeypatch):
    """Rows equal a plain walk, with roots on cycles too; what a cycle's nodes are told of is what they reach both ways."""
    import random

    from gleaner.operators import graph

    rnd = random.Random(5)
    links = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(260)] + [(k, k + 1) for k in range(200, 240)] + [(240, 200), (5, 300), (300, 301), (None, 4), (7, None)]
    ahead = {}
    for a, b in links:
        if a is not None and b is not None:
            ahead.setdefault(a, set()).add(b)

    def reach(a):
        seen, todo = {a}, [a]
        while todo:
            for b in ahead.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    edges = spark.createDataFrame(links * 2, "src long, dst long")
    roots = [*range(0, 120, 2), 200, 301, 999]
    monkeypatch.setattr(graph, "MANY_ROOTS", 3)
    found = sorted(map(tuple, graph.branches(edges, spark.createDataFrame([(r,) for r in roots], "node long")).collect()))
    assert found == sorted((r, n) for r in roots for n in reach(r))
    tied = {r.node: r.head for r in graph.cycles(edges.where("src is not null and dst is not null").distinct()).collect()}
    assert len(tied) > 40 and all(h in reach(n) and n in reach(h) and tied[h] == h for n, h in tied.items())
