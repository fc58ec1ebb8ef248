"""Roles, covering frontiers and walks with caps against plain versions."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gleaner.operators import expansion, frontier, roles, selection


def plain_contract(rows, minimum, per_file, total):
    """Choices from the whole queue of each scope: rows (scope, role, anchor, file, score, fill)."""
    want = set()
    for s in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == s]
        seen, files, chosen, count = set(), defaultdict(int), 0, defaultdict(int)
        by_role, by_anchor = {}, {}
        for r in own:
            by_role.setdefault((r[1], r[2]), []).append(r)
            by_anchor.setdefault(r[2], []).append(r)
        asked = [min(v, key=lambda r: (-r[4], r[3])) for v in by_role.values()]
        rest = [min(v, key=lambda r: (-r[5], r[1], r[3])) for v in by_anchor.values()]
        queue = [(r, role) for role in minimum for r in sorted((r for r in asked if r[1] == role), key=lambda r: (-r[4], r[2]))]
        queue += [(r, None) for r in sorted(rest, key=lambda r: (-r[5], r[2], r[1]))]
        for r, role in queue:
            if r[2] in seen or (role and count[role] >= minimum[role]) or files[r[3]] >= per_file or chosen >= total:
                continue
            seen.add(r[2])
            files[r[3]] += 1
            chosen += 1
            count[role] += 1
            want.add((s, r[2], "reserved" if role else "filled"))
    return want


@pytest.mark.parametrize(("minimum", "per_file", "total"), [({"R": 6}, 3, 8), ({"y": 2, "x": 1}, 2, 8), ({"x": 4, "y": 4, "z": 4}, 1, 5), ({"y": 9}, 4, 6)])
def test_role_contract_sees_past_crowded_files(spark, minimum, per_file, total):
    rnd = random.Random(total)
    rows = [(0, "R", a, "full" if a < 20 else f"f{a}", 100 - a, 0) for a in range(40)]  # twenty best in one file
    for s in range(1, 25):
        for a in range(rnd.randrange(60)):
            for role in rnd.sample("xyz", rnd.randint(1, 3)):
                rows.append((s, role, a, "full" if rnd.random() < 0.6 else f"f{rnd.randrange(5)}", rnd.randrange(9), rnd.randrange(9)))
    df = spark.createDataFrame(rows, "s int, role string, anchor int, file string, score int, fill int")
    found = selection.role_contract(df, ["s"], "role", "anchor", "file", "score", minimum, per_file, total, "fill")
    assert {(r["s"], r["anchor"], r["reason"]) for r in found.collect()} == plain_contract(rows, minimum, per_file, total)


def test_role_scores_of_the_fixed_words(spark):
    schema = "s int, anchor int, path string, symbol string, base int, terms array<string>, roles array<string>, complete boolean, profile string"
    rows = [
        (1, 1, "a/b/c.go", "SendErrorStatus", 50, ["send", "send", "nil"], ["error_mapping", "symptom_site", "other"], True, "error_status_mapping_bug"),
        (1, 2, "go.mod", None, None, None, ["module_or_topology_source"], None, None),
        (2, 3, "a_test.go", "validation of maps", 7, ["map"], ["verification_anchor"], False, None),
        (2, 4, "x.go", "y", 1, [], ["nobody"], True, None),
    ]
    terms = spark.createDataFrame([(1, "send", 8), (1, "status", 4), (2, "validate", 60), (2, "map", 2), (2, None, 9)], "s int, term string, weight int")
    out = roles.role_scores(spark.createDataFrame(rows, schema), terms, ["s"], ["error_mapping", "symptom_site", "module_or_topology_source", "verification_anchor"], profile="profile")
    found = {(r["anchor"], r["role"]): r["score"] for r in out.collect()}
    same = 50 - 24 + 16 + (8 + 4) * 12 + 24
    # "validation" is like "validate" by five letters, "maps" is like nothing of three letters: 720 is cut to 600
    assert found == {(1, "error_mapping"): same + 130 + 180 + 120, (1, "symptom_site"): same + 100 + 220, (2, "module_or_topology_source"): 140, (3, "verification_anchor"): 7 + 4 + 600 + 100}


def plain_frontier(spans, preferred, limit):
    """spans: {span: (order, targets, [(role, bucket)])}; the choices in order, or None."""
    keys = {s: {f"{r}\0{b}" for r, b in held} for s, (_, _, held) in spans.items()}
    order = sorted(spans, key=lambda s: spans[s][0])
    rank = {f"{r}\0{b}": k for (r, b), k in preferred.items()}
    chosen, covered, of_roles = [], set(), set()
    for role in sorted({r for _, _, held in spans.values() for r, _ in held}):
        if role in of_roles:
            continue
        best = min((s for s in order if any(r == role for r, _ in spans[s][2])), key=lambda s: (min((rank.get(k, 1 << 62) for k in keys[s]), default=1 << 62), spans[s][1], spans[s][0]))
        if len(chosen) == limit:
            return None
        chosen.append((best, "role"))
        covered |= keys[best]
        of_roles |= {r for r, _ in spans[best][2]}
    taken = {s for s, _ in chosen}
    for bucket in sorted({k for ks in keys.values() for k in ks}, key=lambda k: (rank.get(k, 1 << 62), k)):
        if bucket in covered or len(chosen) == limit:
            continue
        best = max((s for s in order if bucket in keys[s] and s not in taken), key=lambda s: len(keys[s] - covered))
        chosen.append((best, "bucket"))
        taken.add(best)
        covered |= keys[best]
    for s in order:
        if len(chosen) < limit and s not in taken:
            chosen.append((s, "fill"))
            taken.add(s)
    return chosen


def test_frontier_equals_the_plain_greedy(spark):
    rnd = random.Random(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    for limit in (2, 5, 12):
        rows, named, want = [], [], {}
        for scope in range(30):
            own = {}
            for k in range(rnd.randint(1, 40)):
                held = {(rnd.choice("abc"), rnd.randrange(6)) for _ in range(rnd.randint(1, 4))}
                own[f"s{k}"] = (rnd.randrange(10**6), rnd.randint(1, 5), sorted(held))
            first = {(rnd.choice("abc"), rnd.randrange(6)): k for k in range(rnd.randrange(4))}
            named += [(scope, r, b, k) for (r, b), k in first.items()]
            rows += [(scope, s, r, b, t, o) for s, (o, t, held) in own.items() for r, b in held]
            got = plain_frontier(own, first, limit)
            want[scope] = [(None, "unavailable")] if got is None else got
        df = spark.createDataFrame([*rows, *rows[:7], (0, None, "a", 1, 1, -1), (0, "s0", None, 1, 1, -1)], "scope int, span string, role string, bucket int, targets int, order int")
        near = spark.createDataFrame(named, "scope int, role string, bucket int, rank int")
        found = defaultdict(list)
        for r in frontier.coverage_frontier(df, ["scope"], "span", "role", "bucket", "targets", "order", limit, near).collect():
            found[r["scope"]].append((r["position"], r["span"], r["phase"]))
        assert {s: [(span, phase) for _, span, phase in sorted(v)] for s, v in found.items()} == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_frontier_of_one_large_scope(spark):
    """A hundred thousand spans of one scope, each of three of two hundred buckets."""
    spans = spark.range(100_000).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    rows = spans.select(F.lit(1).alias("scope"), F.col("id").alias("span"), F.when(F.col("k") == 0, "x").otherwise("y").alias("role"), ((F.col("id") * (7 + F.col("k")) + F.col("k")) % 200).alias("bucket"), F.lit(1).alias("targets"), F.col("id").alias("order"))
    own = defaultdict(list)
    for s in range(100_000):
        for k in range(3):
            own[s].append(("x" if k == 0 else "y", (s * (7 + k) + k) % 200))
    want = plain_frontier({s: (s, 1, held) for s, held in own.items()}, {}, 60)
    found = frontier.coverage_frontier(rows, ["scope"], "span", "role", "bucket", "targets", "order", 60).orderBy("position").collect()
    assert [(r["span"], r["phase"]) for r in found] == want
    assert frontier.coverage_frontier(rows.where("false"), ["scope"], "span", "role", "bucket", "targets", "order", 60).count() == 0


def words_of(name):
    out, now = [], ""
    for k, c in enumerate(name):
        if not c.isalnum() or (c.isupper() and k and now):
            out += [now.lower()] * bool(now)
            now = ""
        now += c if c.isalnum() else ""
    return [*out, now.lower()] if now else out


def plain_expansion(callables, edges, terms, hops, expansions, most):
    names, paths = {n: words_of(name or "") for n, name, _ in callables}, {n: p or "" for n, _, p in callables}
    whole = {n: name for n, name, _ in callables}
    test = {n: p.endswith("_test.go") or bool({"test", "tests", "testdata"} & set(p.lower().split("/"))) for n, p in paths.items()}
    begins = lambda w, t: w.startswith(t) or t.startswith(w)
    near = defaultdict(set)
    for a, b in edges:
        if a in names and b in names and a != b:
            near[a].add(b)
            near[b].add(a)
    scored = {}
    for n, words in names.items():
        hit = {t for t in terms for w in words if begins(w, t)}
        if hit:
            scored[n] = (40 + 5 * len(hit) + 10 * (not test[n]) + sum(30 if w == t else 10 for t in terms for w in words if begins(w, t)) + 15 * (whole[n] in terms), len(hit))
    if not scored:
        return []
    over = lambda n: sum(3 if w == t else 1 for t in terms for w in names[n] if begins(w, t))
    root = min(scored, key=lambda n: (-scored[n][0], -scored[n][1], test[n], n))
    nodes, done = {root: (0, None, 0, scored[root][0])}, []
    for _ in range(expansions):
        fresh = [n for n in nodes if n not in done]
        if not fresh:
            break
        now = min(fresh, key=lambda n: (-over(n), paths[n] != paths[root], nodes[n][0], test[n], n))
        done.append(now)
        for other in sorted(near[now]):
            if other not in nodes and nodes[now][0] < hops and len(nodes) < most:
                nodes[other] = (nodes[now][0] + 1, now, len(nodes), over(other))
    return [(n, *v, done.index(n) + 1 if n in done else None) for n, v in nodes.items()]


def test_question_expansion_equals_best_first(spark):
    rnd = random.Random(11)
    stems = ["send", "sending", "s", "parse", "read", "reader", "map", "mapError", "x1", "Über"]
    callables = [(k, "".join(rnd.choice(stems).capitalize() if rnd.random() < 0.5 else rnd.choice(stems) + "_" for _ in range(rnd.randint(1, 3))), rnd.choice(["a.go", "a_test.go", "test/x.go", "b/c.go"])) for k in range(80)]
    callables += [(90, None, None), (91, "parse", "a.go")]
    edges = [(rnd.randrange(83), rnd.randrange(83)) for _ in range(200)] + [(5, k) for k in range(80)] + [(None, 1), (7, 7)]
    asked = {q: {rnd.choice(["send", "pars", "reader", "maps", "parse", "über", "none", "x"]) for _ in range(rnd.randint(1, 4))} for q in range(25)} | {99: {"zzz"}}
    for hops, expansions, most in ((2, 3, 64), (1, 4, 9), (2, 3, 5)):
        found = defaultdict(set)
        args = (spark.createDataFrame(callables, "node int, name string, path string"), spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts] + [(3, None)], "query int, term string"))
        for r in expansion.question_expansion(*args, hops, expansions, most).collect():
            found[r["query"]].add(tuple(r)[1:])
        assert found == {q: set(rows) for q, ts in asked.items() if (rows := plain_expansion(callables, edges, ts, hops, expansions, most))}


def test_question_expansion_holds_blocks_of_names_against_blocks_of_questions(spark, monkeypatch):
    """Names and questions that all share their words are more pairs than rows could be; small blocks give the same roots."""
    rnd = random.Random(5)
    words = ["the", "then", "of", "office", "and", "an", "on", "onward"]
    callables = [(k, "_".join(rnd.choices(words, k=8)) + (f"_w{k}" if k % 7 == 0 else ""), rnd.choice(["a.go", "a_test.go"])) for k in range(1500)]
    asked = {q: {*rnd.sample(words, 6), f"w{rnd.randrange(1500)}"} for q in range(1500)}
    frames = spark.createDataFrame(callables, "node int, name string, path string"), spark.createDataFrame([(1, 2)], "src int, dst int"), spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "query int, term string")
    roots = lambda: {r["query"]: tuple(r)[1:] for r in expansion.question_expansion(*frames).where("position = 0").collect()}
    found = roots()
    assert len(found) == len(asked)
    for q in range(0, 1500, 300):
        assert found[q] == plain_expansion(callables, [(1, 2)], asked[q], 2, 3, 64)[0]
    monkeypatch.setattr(expansion, "BLOCK_NAMES", 400)
    monkeypatch.setattr(expansion, "BLOCK_QUESTIONS", 500)
    monkeypatch.setattr(expansion, "MOST_ROWS", 4)
    assert roots() == found


def plain_calls(edges, root, depth, fan_out, most_nodes, most_families):
    out = defaultdict(list)
    for a, b, n in edges:
        out[a].append((b, n))
    at, queue, families, lost = {root: 0}, [(root, 0)], [], defaultdict(lambda: [0, 0])

    def refuse(node, reason, rest):
        if rest:
            lost[node, reason][0] += len(rest)
            lost[node, reason][1] += sum(n for _, n in rest)

    for node, level in queue:
        own = sorted(out[node], key=lambda f: (-f[1], f[0]))
        if level >= depth:
            refuse(node, "depth_limit", own)
            continue
        refuse(node, "outgoing_limit", own[fan_out:])
        for k, (callee, n) in enumerate(own[:fan_out]):
            if callee not in at and len(at) >= most_nodes:
                refuse(node, "node_limit", own[k:fan_out])
                break
            if len(families) >= most_families:
                refuse(node, "family_limit", own[k:fan_out])
                break
            if callee not in at:
                at[callee] = len(at)
                queue.append((callee, level + 1))
            families.append((node, callee, n, level, len(families) + 1))
    return families, lost, at


def test_entry_calls_equal_a_plain_walk(spark):
    rnd = random.Random(4)
    edges = sorted({(rnd.randrange(60), rnd.randrange(60)): rnd.randint(1, 9) for _ in range(500)}.items())
    edges = [(a, b, n) for (a, b), n in edges] + [(0, k, 2) for k in range(100, 140)]
    df = spark.createDataFrame([*edges, (None, 3, 1)], "src int, dst int, n int")
    roots = spark.createDataFrame([(k,) for k in [*range(25), 999, 7]], "node int")
    extra = spark.createDataFrame([(0, "dynamic_invoke", 3), (5, "non_static", 0)], "node int, reason string, n int")
    for limits in ((3, 12, 32, 48), (2, 4, 9, 100), (3, 5, 100, 11), (1, 50, 20, 30)):
        families, rest = expansion.entry_calls(df, roots, "n", *limits, left_out=extra)
        got, left = defaultdict(set), defaultdict(set)
        for r in families.collect():
            got[r["root"]].add(tuple(r)[1:])
        for r in rest.collect():
            left[r["root"]].add(tuple(r)[1:])
        for root in [*range(25), 999]:
            want, lost, at = plain_calls(edges, root, *limits)
            assert got[root] == set(want)
            assert left[root] == {(n, reason, f, w) for (n, reason), (f, w) in lost.items()} | ({(0, "dynamic_invoke", 3, 3)} if 0 in at else set())
            every = [n for a, _, n in edges if a in at]
            assert sum(f[2] for f in want) + sum(w for _, w in lost.values()) == sum(every) and len(want) + sum(f for f, _ in lost.values()) == len(every)


def test_anchor_relations_are_dealt_over_parts_of_bounded_rows(spark, monkeypatch):
    from gleaner.operators import evidence, sets

    anchors = spark.createDataFrame([(t, k, 10 * k) for t in range(40) for k in range(4)], "task int, id int, score int")
    calls = anchors.where("id < 3").select("task", F.col("id").alias("left"), (F.col("id") + 1).alias("right"))
    terms = anchors.select("task", "id", (F.col("id") % 2).alias("term"), F.when(F.col("id") > 0, F.col("id")).alias("weight"))
    terms = terms.union(anchors.select("task", "id", F.lit(7), F.lit(2)))
    ask = lambda: evidence.anchor_relations(anchors, calls, calls.where("left = 9"), terms, "task", 3)
    want = sorted(map(tuple, ask().collect()))
    assert [r[1:] for r in want if r[0] == 5] == [(0, 1, "direct_call", 4010), (1, 2, "direct_call", 4030), (2, 3, "direct_call", 4050)]
    monkeypatch.setattr(sets, "DEALT_ROWS", 2)
    many = ask()
    assert many.rdd.getNumPartitions() == 80 and sorted(map(tuple, many.collect())) == want


def test_terms_that_go_with_the_same_words_share_a_row(spark, monkeypatch):
    """A row of points is counted once for all terms that go with the same words, and small tables make blocks for several tasks."""
    import numpy as np
    import pyarrow as pa

    names = [(f"n{k:03}", w, k % 5 == 0, [w, "th"] if k % 2 else [w]) for k, w in enumerate(f"{a}{b}" for a in ("the", "on", "re") for b in ("", "n", "ward", "d"))]
    asked = [(k, [f"the{k}x", f"th{k}", "then", "onw"]) for k in range(400)]
    side = lambda own, rest, k: [r[k] for r in rest] if own else None
    pad = lambda a, b: [None] * (len(asked) if b else len(names)) if a is None else a
    column = lambda k, j, t: pa.array(pad(side(k is not None, asked, k or 0), True) + pad(side(j is not None, names, j or 0), False), t)
    block = pa.table({
        "own": [0] * len(asked) + [1] * len(names), "query": column(0, None, pa.int64()), "terms": column(1, None, pa.list_(pa.string())),
        "node": column(None, 0, pa.string()), "name": column(None, 1, pa.string()), "test": column(None, 2, pa.bool_()), "words": column(None, 3, pa.list_(pa.string())),
    })
    counted, bincount = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: counted.append(1) or bincount(*a, **k))
    found = expansion._best_names(block)
    assert len(counted) < 20 and len(found) == 400  # 802 different terms
    over = lambda words, terms: sum(30 if w == t else 10 if w.startswith(t) or t.startswith(w) else 0 for w in words for t in terms)
    for q, node, score in zip(*(found[c].to_pylist() for c in ("query", "node", "score")), strict=True):
        terms = asked[q][1]
        points = lambda n: sum((p := over(n[3], [t])) and p + 5 + 15 * (n[1] == t) for t in terms)  # noqa: E731, B023
        best = min((-(points(n) + 40 + 10 * (not n[2])), n[2], n[0]) for n in names if points(n))
        assert (node, score) == (best[2], -best[0])
