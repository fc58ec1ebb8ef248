"""Seeds, chains and references against plain loops."""

import random
import re
from collections import defaultdict

from gleaner.operators import matching

P = "[A-Za-z0-9_./-]"


def plain_references(text, paths):
    """Longest path first, each searched by itself, boundaries looked at but not taken."""
    out = {}
    for path in sorted(paths, key=len, reverse=True):
        for m in re.finditer(f"(?<!{P})(?={re.escape(path)}(?::([0-9]+)(?!{P})|(?!{P})))", text or ""):
            key = (path, int(m[1]) if m[1] else None)
            out.setdefault(key, m.start())
    return {(p, n, at) for (p, n), at in out.items()}


def test_references_equal_the_longest_first_loop(spark):
    rnd = random.Random(6)
    paths = ["a/b.go", "b.go", "a b.go", "my a b.go", "Makefile", "x/Makefile", "(app)/page.tsx", "docs/[id]", "a", "12", "é/ü.go", "a/b.go:3", "日本", "", "d//e", "-", "tail )", "b.go a/b.go"]
    glue = [" ", "\n", ":", ":7", ":7x", ":12 ", ",", "(", ")", "x", "/", ".", "日", "", ": ", "#", "]", ":99999999999999999999 "]
    texts = [(k, "".join(rnd.choice(glue) + rnd.choice(paths) + rnd.choice(glue) for _ in range(rnd.randint(0, 9)))) for k in range(150)]
    texts += [(900, None), (901, ""), (902, "a/b.go " * 5000), (903, "b.go:1 b.go:2 b.go:1 a b.go:3")]
    df = spark.createDataFrame([(*t, "x", "y") for t in texts], "id long, text string, core string, path string").repartition(3)
    named = spark.createDataFrame([(p, 1) for p in [*paths, "a", None]], "path string, line int")
    found = defaultdict(set)
    for r in matching.references(df, named, "id", "text").collect():
        found[r["id"]].add((r["path"], r["line"], r["position"]))
    sought = [p for p in paths if re.search(P, p)]
    # a line that no long can hold is none
    want = {k: {(p, n if n is None or n < 1 << 63 else None, at) for p, n, at in rows} for k, t in texts if (rows := plain_references(t, sought))}
    assert {k: {(p, n) for p, n, _ in v} for k, v in found.items()} == {k: {(p, n) for p, n, _ in v} for k, v in want.items()}
    small = {k for k, t in texts if t and "999999" not in t}
    assert all(found[k] == want[k] for k in small & want.keys())
    assert matching.references(df.where("false"), named, "id", "text").count() == 0 and matching.references(df, named.where("false"), "id", "text").count() == 0


def test_statements_become_canonical(spark):
    texts = [
        (1, "As a/b.go line 3 and a/b.go line 9 say, b.go shows it at line 2."),
        (2, "x/Makefile:7 but Makefile:7, Makefile#8; Makefile lines 4 - 6"),
        (3, "nothing here at line 3"), (4, None), (5, "a/b.goo:3 stays, (a b.go:1) is known"), (6, "b.go:0003"),
    ]
    df = spark.createDataFrame(texts, "id int, text string")
    paths = spark.createDataFrame([("a/b.go",), ("b.go",), ("a b.go",), ("Makefile",), ("x/Makefile",)], "path string")
    known = spark.createDataFrame([("a/b.go", 3), ("b.go", 2), ("b.go", 3), ("Makefile", 8), ("Makefile", 4), ("a b.go", 1), ("b.go", None), (None, 2)], "path string, line int")
    found = {r["id"]: (r["text"], r["grounded"]) for r in matching.canonical_statements(df, paths, known, "id", "text").collect()}
    assert found == {
        1: ("As a/b.go:3 and a/b.go say, b.go:2 shows it.", False),
        2: ("x/Makefile but Makefile, Makefile:8; Makefile:4", False),
        3: ("nothing here at line 3", True), 4: (None, True), 5: ("a/b.goo:3 stays, (a b.go) is known", False), 6: ("b.go:3", True),
    }


def test_seed_lattice_equals_a_plain_loop(spark):
    rnd = random.Random(8)
    pick = lambda of: rnd.choice([None, *of])
    fields = {"p": ("argument", 0, None, "d", None), "r": ("receiver", None, None, None, None), "f": ("receiver_field", None, None, "x", "F"), "c": ("constant", None, "v", None, None), "n": ("argument", -1, None, None, None)}
    seeds = [(k, pick("ab"), pick("rs"), pick("xyz"), pick([0, 1, 2]), pick([True, False]), fields if k % 3 else None) for k in range(60)]
    sites = [(k, pick("abc"), pick("rs"), pick("xyz"), rnd.choice([None, [], ["1"], ["1", "2"], [None, "2", "3"]]), pick([True, False])) for k in range(300)]
    df = spark.createDataFrame(sites, "site int, package string, receiver string, name string, args array<string>, variadic boolean")
    rules = spark.createDataFrame(seeds, "seed int, package string, receiver string, name string, min_args int, variadic boolean, projections map<string,struct<source:string,index:int,value:string,default:string,field:string>>")
    found = {r["site"]: (r["status"], r["seed"], r["candidates"], r["fields"]) for r in matching.seed_matches(df, rules).collect()}
    want = {}
    for k, p, r, n, args, v in sites:
        fit = []
        for s in seeds:
            keys, own = s[1:4], (p, r, n)
            if any(keys) and all(a is None or a == b for a, b in zip(keys, own, strict=True)) and len(args or []) >= (s[4] or 0) and (s[5] is None or s[5] == v):
                fit.append(((-sum(a is not None for a in keys), *(a is None for a in keys), -(s[4] or 0), s[5] is None), s))
        if not fit:
            continue
        best = [s for rank, s in fit if rank == min(rank for rank, _ in fit)]
        if len(best) > 1:
            want[k] = ("ambiguous", None, [s[0] for s in best][:8], None)
            continue
        out = None
        if best[0][6] is not None:
            a = args or []
            out = {"p": (a[0] if a and a[0] is not None else "d"), "r": r, "f": f"{r}.F" if r else "x", "c": "v", "n": None}
        want[k] = ("matched", best[0][0], None, out or {})
    assert found == want
    assert matching.seed_matches(df, rules.where("false")).count() == 0


def test_chains_attach_only_one_of_each(spark):
    rows = "id int, exact boolean, to_id int, candidate_ids array<int>"
    descriptors = spark.createDataFrame([(1,), (2,), (3,), (4,), (4,), (None,)], "id int")
    bindings = spark.createDataFrame([(10, True, 1, None), (10, True, 1, None), (11, True, 2, []), (12, True, 2, None), (13, False, None, [1, 9, 3, 3]), (14, True, 9, None), (15, None, 3, None)], rows)
    activations = spark.createDataFrame([(20, True, 1, None), (21, True, 2, None), *((30 + k, True, 3, None) for k in range(5)), (None, True, 1, None)], rows)
    chains, frontiers = matching.attached_chains(descriptors, bindings, activations, 3)
    assert {tuple(r) for r in chains.collect()} == {(1, 10, 20, "complete"), (2, None, 21, "binding_ambiguous"), (3, None, None, "no_binding,activation_ambiguous"), (4, None, None, "no_binding,no_activation")}
    assert sorted(map(tuple, frontiers.collect())) == sorted([
        (2, "binding_ambiguous", "11"), (2, "binding_ambiguous", "12"), *((3, "activation_ambiguous", str(30 + k)) for k in range(3)), (3, "evidence_limit", "2"),
        (1, "binding_candidate", "13"), (3, "binding_candidate", "13"), (3, "binding_candidate", "15"),
    ])


def test_chains_meet_both_sides_in_one_sort(spark):
    """Descriptors and exact rows meet in one window, not in a join for each side; an only activation is no part of a crowd."""
    from gleaner.operators import matching

    shape = "id int, exact boolean, to_id int, candidate_ids array<int>"
    bindings = spark.createDataFrame([(k, True, 1, None) for k in range(10, 15)], shape)
    activations = spark.createDataFrame([(20, True, 1, None), (21, True, 9, None), (22, True, 9, None)], shape)
    chains, frontiers = matching.attached_chains(spark.createDataFrame([(1,), (1,), (None,), (2,)], "id int"), bindings, activations, 4)
    assert {tuple(r) for r in chains.collect()} == {(1, None, 20, "binding_ambiguous"), (2, None, None, "no_binding,no_activation")}
    assert sorted(map(tuple, frontiers.collect())) == [(1, "binding_ambiguous", str(k)) for k in range(10, 14)] + [(1, "evidence_limit", "1")]
    assert "Join" not in chains._jdf.queryExecution().optimizedPlan().toString()


def test_words_that_are_no_path_stay_out_of_the_shuffle(spark):
    from gleaner.operators import matching

    cores = spark.createDataFrame([(f"d/f{k}.go",) for k in range(3000)], "core string")
    bits = matching._bits(cores, 3000)
    text = " ".join(f"word{k} d/f{k}.go" for k in range(1000))
    said = spark.createDataFrame([(1, text)], "id long, text string")
    out = said.mapInArrow(matching._runs(2, 40, 1, bits), "id long, start int, core string, before string, behind string").select("core").collect()
    held = [r.core for r in out if r.core.startswith("d/f") and " " not in r.core]
    assert held == [f"d/f{k}.go" for k in range(1000)] and len(out) < 1400


def test_seeds_of_one_open_key_meet_a_site_as_one_row(spark):
    from gleaner.operators import matching

    seeds = spark.range(5000).selectExpr("id as seed", "'p' as package", "cast(null as string) receiver", "cast(null as string) name", "1 as min_args", "cast(null as boolean) variadic", "cast(null as map<string, struct<source: string, index: int, value: string, default: string, field: string>>) projections")
    sites = spark.range(50).selectExpr("id as site", "'p' as package", "'r' as receiver", "'n' as name", "array('x') as args", "false as variadic")
    found = matching.seed_matches(sites, seeds)
    assert {(r.status, tuple(r.candidates)) for r in found.collect()} == {("ambiguous", tuple(range(8)))} and found.count() == 50
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "__seeds" in plan and "rank(" not in plan  # what meets a site are groups of seeds, not 250,000 pairs


def test_sites_of_one_shape_look_their_seeds_up_once(spark):
    """Sites are not grouped or sorted by their key: the best seeds of a shape are known before sites meet them."""
    from gleaner.operators import matching

    seeds = spark.range(12).selectExpr("id as seed", "if(id % 3 > 0, 'p', null) as package", "if(id % 2 > 0, 'r', null) as receiver", "'n' as name", "cast(id % 4 as int) as min_args", "if(id > 8, true, null) as variadic", "cast(null as map<string, struct<source: string, index: int, value: string, default: string, field: string>>) projections")
    sites = spark.range(1000).selectExpr("id as site", "'p' as package", "if(id % 5 > 0, 'r', null) as receiver", "'n' as name", "array_repeat('x', cast(id % 3 as int)) as args", "id % 7 = 0 as variadic")
    found = matching.seed_matches(sites, seeds)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.site: r.seed if r.seed is not None else tuple(r.candidates) for r in found.collect()}
    assert len(got) == 1000
    for site in range(1000):
        best = {}
        for k in range(12):
            if site % 3 >= k % 4 and (k % 2 == 0 or site % 5) and (k <= 8 or site % 7 == 0):
                best.setdefault((-(k % 3 > 0) - (k % 2 > 0), k % 3 == 0, k % 2 == 0, -(k % 4), k <= 8), []).append(k)
        want = best[min(best)]
        assert got[site] == (want[0] if len(want) == 1 else tuple(want))
