"""Terms, candidate files and anchors of tasks against plain loops."""

import random
import re
from collections import defaultdict

import regex
from pyspark.sql import functions as F

from gleaner.operators import tasks as K

TRIM = "`'\".,;:()[]{}<>"


def parts_of(w):
    out = []
    for p in regex.findall(r"[\p{L}\p{Nd}]+", w):
        if p != w and p.lower() not in {o.lower() for o in out}:
            out.append(p)
    return out


def capital(w):
    return len(w) >= 3 and regex.match(r"\p{Lu}.*\p{Ll}", w) is not None


def plain_terms(text, most):
    told = []
    for q in re.findall(r"`([^`\r\n]{1,160})`", text or ""):
        told += [(q, 16), *((p, 8) for p in parts_of(q))]
    for w in regex.findall(r"[\p{L}\p{N}_][\p{L}\p{N}_.:/-]*", text or ""):
        w = w.strip(" ").strip(TRIM)
        told.append((w, 10 if regex.search(r"\p{Ll}\p{Lu}|[_./]", w) else 4 if capital(w) else 2))
        marked = re.search(r"[_./:\[\](){}<>*-]", w)
        told += [(p, 8 if marked and (len(p) >= 5 or regex.search(r"\p{Ll}\p{Lu}", p) or capital(p)) else 3) for p in parts_of(w)]
    seen = {}
    for k, (raw, weight) in enumerate(told):
        raw = raw.strip(" ").strip(TRIM)
        term = raw.lower()
        if 3 <= len(term.encode()) <= 96 and term not in K.STOP_WORDS:
            w, times, at, shown = seen.get(term, (0, 0, k, None))
            seen[term] = (max(w, weight), times + 1, at, raw if weight > w else shown)
    rows = []
    for term, (w, times, at, shown) in seen.items():
        if times > 1 and w < 8:
            w = min(8, w + (times - 1) * (4 if w >= 4 else 2))
        rows.append((term, shown, w, times, at))
    rows.sort(key=lambda r: (-r[2], -r[3], r[4], r[0]))
    return [(t, shown, w, n, k) for k, (t, shown, w, n, _) in enumerate(rows[:most], 1)]


WORDS = ["send", "Send", "sendError", "pkg/send.go", "a.b", "HTTP", "Für", "user", "the", "x", "map[string]", "io:read", "`q.Run_Fast`", "`", "(*T).Go", "go-work", "über_alles", "send", "élan", "12", "a_b_c", "Reader."]


def test_terms_equal_a_plain_loop(spark):
    rnd = random.Random(5)
    texts = [(k, rnd.choice([" ", "\n"]).join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 30)))) for k in range(60)] + [(100, None), (101, ""), (102, "a" * 97 + " bb " + "é" * 48)]
    df = spark.createDataFrame([(*t, "z") for t in texts], "task int, text string, term string")
    found = defaultdict(list)
    for r in K.task_terms(df, "task", "text", 9).collect():
        found[r["task"]].append((r["term"], r["text"], r["weight"], r["times"], r["position"]))
    assert {k: sorted(v, key=lambda r: r[4]) for k, v in found.items()} == {k: want for k, t in texts if (want := plain_terms(t, 9))}
    assert K.task_terms(df.where("false"), "task", "text").count() == 0


def line_words(line):
    out = set()
    for w in regex.findall(r"[\p{L}\p{N}_][\p{L}\p{N}_.:/-]*", line):
        w = w.strip(TRIM)
        out |= {w.lower(), *(p.lower() for p in parts_of(w))}
    return out


def test_candidates_and_anchors_equal_plain_loops(spark):
    rnd = random.Random(9)
    said = ["send", "func send", "type reader", "// send", "map", "go-work", "x", "func sendAll", "", "read the map", "über_alles send"]
    paths = ["send/a.go", "cmd/read.go", "examples/map.go", "pkg/adapter/x.go", "go.work", "docs/send.md", "a_test.go", "deep/er/send_map.go", "lib/z.py", "docs/other.md"]
    files = [(k, paths[k % len(paths)] if k < len(paths) else f"d{k}/{paths[k % len(paths)]}", "\n".join(rnd.choice(said) for _ in range(rnd.randint(0, 14)))) for k in range(60)] + [(90, "null.go", None)]
    tasks = [(1, "send the map"), (2, "add support for sending"), (3, "documentation of compatibility reader"), (4, None), (5, "zzzz"), (6, "extension documentation nothing")]
    f = spark.createDataFrame(files, "file int, path string, text string")
    t = spark.createDataFrame(tasks, "task int, text string")
    terms = K.task_terms(t, "task", "text")
    hits = K.term_lines(f, terms, "file", "text")
    best = K.candidate_files(t, terms, f, hits, "task", "text", "file", "path", 12)
    kind = {2: "extension", 3: "compatibility", 6: "extension"}
    want, lines_of, terms_of = set(), {}, {}
    for task, text in tasks:
        own = terms_of[task] = {term: w for term, _, w, _, _ in plain_terms(text, 32)}
        rows = []
        for file, path, body in files:
            lines = lines_of[file] = [line_words(line) for line in (body or "").split("\n")] if body is not None else []
            score, matched = 0, set()
            for term, w in own.items():
                n = sum(term in words for words in lines)
                if n:
                    declared = any(term in words and re.match("(func|type|var|const) ", raw.strip()) and term in [x for x in re.sub("([a-z])([A-Z])", r"\1 \2", re.sub(r"[^\w]+|_", " ", raw)).lower().split()] for words, raw in zip(lines, body.split("\n"), strict=True))
                    score += w + 8 + 2 * min(n, 6) + 12 * declared
                    matched.add(term)
                if len(term) >= 3 and term in path.lower():
                    score += w + 5
                    matched.add(term)
            low = path.lower()
            bonus = 9 * (low.endswith(".md") and (kind.get(task) == "compatibility" or "documentation" in (text or "")))
            if kind.get(task) == "extension":
                bonus += 8 * (low.split("/")[-1] == "go.work") + 7 * (low.startswith("examples/") or "/adapter" in low)
            if matched or bonus:
                rows.append((-(score + bonus), -len(matched), path, file))
        want |= {(task, r[3], -r[0], -r[1], k) for k, r in enumerate(sorted(rows)[:12], 1)}
    got = {(r["task"], r["file"], r["score"], r["matched"], r["rank"]) for r in best.collect()}
    assert got == want
    anchors = K.line_anchors(best, terms, hits, f, "task", "file", "path", 3, 7).collect()
    by = defaultdict(list)
    for r in anchors:
        by[r["task"]].append(r)
        assert r["term"] in lines_of[r["file"]][r["line"] - 1] and r["term"] in terms_of[r["task"]]
    for task, rows in by.items():
        assert sorted(r["position"] for r in rows) == list(range(1, len(rows) + 1)) and len(rows) <= 7
        assert len({(r["file"], r["line"]) for r in rows}) == len(rows) and max(sum(r["file"] == x["file"] for r in rows) for x in rows) <= 3
        assert [r["score"] for r in sorted(rows, key=lambda r: r["position"])] == sorted((r["score"] for r in rows), reverse=True)
    assert set(by) == {task for task, file, _, _, _ in want if any(terms_of[task].keys() & words for words in lines_of[file])}
    assert K.candidate_files(t, terms, f.where("false"), hits.where("false"), "task", "text", "file", "path").count() == 0


def test_capitals_are_one_letter_for_one(spark):
    from gleaner.plans.retrievals import capitalised

    words = spark.createDataFrame([("ßung",), ("öRE",), ("x",), ("",), ("ŉab",)], "w string")
    assert [r[0] for r in words.select(capitalised(F.col("w"))).collect()] == ["ẞung", "Öre", "X", "", "ŉab"]


def test_hits_go_without_the_text_of_their_lines(spark):
    line = "func SendMap(send_all) " + " ".join(f"w{k}" for k in range(50))
    f = spark.createDataFrame([(1, "a.go", line + "\n// send")], "file int, path string, text string")
    terms = spark.createDataFrame([(1, w) for w in ("send", "map", "send_all", "sendmap", "w7")], "task int, term string")
    hits = K.term_lines(f, terms, "file", "text")
    assert all(kind != "string" or name == "term" for name, kind in hits.dtypes)
    got = {(r["term"], r["line"], r["declared"], r["named"], r["comment"]) for r in hits.collect()}
    assert got == {("send", 1, True, False, False), ("send_all", 1, False, True, False), ("sendmap", 1, False, True, False), ("w7", 1, True, True, False), ("send", 2, False, False, True)}


def _retrieval(spark):
    f = spark.createDataFrame([(k, ["a.md", "examples/b.go", "c.go", "send/d.go"][k % 4], "send\nfunc map\nmap" if k % 3 else "") for k in range(12)], "file int, path string, text string")
    t = spark.createDataFrame([(1, "send the map, documentation"), (2, "add support for map"), (3, "zzzz")], "task int, text string")
    terms = K.settle(K.task_terms(t, "task", "text"))
    return f, t, terms, K.settle(K.term_lines(f, terms, "file", "text"))


def test_files_are_dealt_once_and_texts_of_tasks_stay(spark):
    """What speaks for a file meets in one deal by file: no second look at what matched, no text of a task beside each file."""
    f, t, terms, hits = _retrieval(spark)
    found = K.candidate_files(t, terms, f, hits, "task", "text", "file", "path", 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("RepartitionByExpression [file") == 1 and not re.search(r"__text|contains\(lower\(text", plan)
    best = {task: sorted((-r["score"], r["rank"], r["file"]) for r in found.collect() if r["task"] == task) for task in (1, 2, 3)}
    assert not best[3] and len(best[1]) == 5 and [r for _, r, _ in best[1]] == [1, 2, 3, 4, 5]
    assert {file for _, _, file in best[2]} <= {1, 5, 9, 2, 4, 7, 8, 10, 11} and best[2][0][2] in (1, 5)


def test_lines_of_other_files_go_before_they_meet_terms(spark, monkeypatch):
    f, t, terms, hits = _retrieval(spark)
    best = K.settle(K.candidate_files(t, terms, f, hits, "task", "text", "file", "path", 2))
    settled, settle = [], K.settle
    monkeypatch.setattr(K, "settle", lambda df: settled.append(df._jdf.queryExecution().optimizedPlan().toString()) or settle(df))
    found = K.line_anchors(best, terms, hits, f, "task", "file", "path").collect()
    assert {r["file"] for r in found} <= {r["file"] for r in best.collect()} and len(found) > 3
    assert any(plan.count("LeftSemi") == 2 for plan in settled)  # by file first, then by file and term


def test_only_hits_of_candidates_meet_the_choice(spark, monkeypatch):
    from gleaner.operators import retrieval
    from gleaner.plans import retrievals

    met, greedy = [], retrieval.coverage_greedy
    monkeypatch.setattr(retrieval, "coverage_greedy", lambda held, *a: met.append(held._jdf.queryExecution().analyzed().toString()) or greedy(held, *a))
    assert retrievals.choice_trace(spark, "/root/testdata/sf0.001").count() > 0
    assert "declared" not in met[0]
