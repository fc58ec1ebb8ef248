"""Queries over documents, conversations and pages: scans, retrieval, and evidence in text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.rules import PROSE_RULES, SIGNAL_RULES
from gleaner.operators import ranking as R
from gleaner.operators import retrieval as T
from gleaner.operators import scan as N
from gleaner.operators import sets as S
from gleaner.plans.bindings import LINES, Registry, table

registry = Registry()
add = registry.add
RULES = PROSE_RULES + SIGNAL_RULES


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_RULES = "rules(rule, category, pattern, weight) AS (VALUES " + ", ".join(f"({k}, '{c}', {_quoted(p)}, {w})" for k, (c, p, w, _) in enumerate(RULES)) + ")"
_HITS = f"{LINES}, {_RULES}, hits AS (SELECT doc_id, source, line, rule, category, weight FROM lines JOIN rules ON regexp_matches(text, pattern))"
_BEST = f"""{_HITS}, best AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id ORDER BY weight DESC, line) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY source, doc_id, line ORDER BY weight DESC, rule) AS k FROM hits) WHERE k = 1)"""


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.lines(table(spark, sf_dir, "documents"), ["source", "doc_id"], "text")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.signals(document_lines(spark, sf_dir), ["source", "doc_id"], RULES)


@add("a4_lines", f"WITH {LINES} SELECT doc_id, line, text FROM lines")
def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_lines(spark, sf_dir).select("doc_id", "line", "text")


@add("a5_line_windows", f"""WITH {LINES} SELECT DISTINCT doc_id, line, text FROM lines WHERE line BETWEEN doc_id % 5 AND doc_id % 5 + 3 OR line BETWEEN doc_id % 7 AND doc_id % 7 + 1""")
def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    one = docs.select("doc_id", (F.col("doc_id") % 5).alias("start"), (F.col("doc_id") % 5 + 3).alias("end"))
    two = docs.select("doc_id", (F.col("doc_id") % 7).alias("start"), (F.col("doc_id") % 7 + 1).alias("end"))
    return N.windows(docs, one.union(two), ["doc_id"], "text")


@add("h1_signal_scan", f"WITH {_HITS} SELECT doc_id, line, rule, category, weight FROM hits")
def signal_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select("doc_id", "line", "rule", "category", "weight")


@add("e2_best_per_line", f"WITH {_BEST} SELECT doc_id, line, rule, weight, rank FROM best WHERE rank <= 5")
def best_per_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.best_signals(found(spark, sf_dir), ["source", "doc_id"], 5).select("doc_id", "line", "rule", "weight", "rank")


@add("e2_total_cap", f"""WITH {_BEST}, five AS (SELECT * FROM best WHERE rank <= 5), f AS (SELECT source, doc_id, count(*) AS n FROM five GROUP BY ALL),
r AS (SELECT source, doc_id, 60 - coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM f)
SELECT doc_id, line, rank FROM five JOIN r USING (source, doc_id) WHERE room > 0 AND rank <= room""")
def total_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = N.best_signals(found(spark, sf_dir), ["source", "doc_id"], 5)
    return N.capped(best, ["source"], ["source", "doc_id"], [F.col("doc_id")], 60).select("doc_id", "line", "rank")


@add("d2_signal_summary", f"WITH {_HITS}, g AS (SELECT doc_id, category, min(line) AS at_, count(*) AS n FROM hits GROUP BY ALL) SELECT doc_id, string_agg(category, ',' ORDER BY at_, category) AS categories, CAST(sum(n) AS BIGINT) AS hits FROM g GROUP BY 1")
def signal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.category_summary(found(spark, sf_dir), ["doc_id"])


@add("d7_flow_candidates", f"""WITH {_HITS}, t AS (SELECT *, row_number() OVER (PARTITION BY source, category ORDER BY weight DESC, doc_id, line) AS k FROM (SELECT DISTINCT source, doc_id, line, category, weight FROM hits)),
g AS (SELECT source, category, count(*) AS n, count(DISTINCT doc_id) AS files, max(weight) AS top FROM t WHERE k <= 10 GROUP BY ALL)
SELECT source, category, n, files, CAST(2 + least((n + 1) // 3, 3) - CASE WHEN files = 1 THEN 1 ELSE 0 END AS BIGINT) AS priority FROM g WHERE top >= 35 OR (n >= 2 AND files >= 2)""")
def flow_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = found(spark, sf_dir).select("source", "doc_id", "line", "category", "weight").distinct()
    return N.flow_candidates(hits, ["source"], "doc_id")


@add("h14_manifest_names", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def manifest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))


@add("h15_trace_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def trace_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


_TERMS = """w AS (SELECT item_id, generate_subscripts(l, 1) AS pos, unnest(l) AS w FROM (SELECT item_id, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_./]*'), lambda x: regexp_replace(x, '^[./]+|[./]+$', '', 'g')), lambda x: length(x) > 1) AS l FROM benchmark)),
o AS (SELECT item_id, lower(w) AS term, max(CASE WHEN regexp_matches(w, '[a-z0-9][A-Z]|[_./]') THEN 10 WHEN regexp_matches(w, '^[A-Z]') THEN 4 ELSE 2 END) AS w, count(*) AS times, min(pos) AS pos FROM w GROUP BY ALL),
b AS (SELECT item_id, term, CASE WHEN times > 1 AND w < 8 THEN least(8, w + (times - 1) * CASE WHEN w >= 4 THEN 4 ELSE 2 END) ELSE w END AS weight, times, pos FROM o),
terms AS (SELECT * FROM (SELECT item_id, term, CAST(weight AS INTEGER) AS weight, times, row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, times DESC, pos, term) AS position FROM b) WHERE position <= 32)"""
_INDEX = r"idx AS (SELECT doc_id, token, count(*) AS hits FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}_]+')) AS token FROM documents) GROUP BY ALL)"
_SCORES = f"""{_TERMS}, {_INDEX}, sc AS (SELECT item_id, doc_id, sum(weight + 8 + least(hits, 6) * 2) AS score, count(*) AS matched FROM terms JOIN idx ON term = token GROUP BY ALL),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, matched DESC, doc_id) AS rank FROM sc) WHERE rank <= 40)"""


def task_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.weighted_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")


def terms_and_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The tasks' terms, and the documents' index of those terms, both settled."""
    terms = S.settle(task_terms(spark, sf_dir))
    asked = S.settle(terms.select(F.col("term").alias("token")).distinct())
    return terms, S.settle(T.inverted_index(table(spark, sf_dir, "documents"), "doc_id", "text", asked))


def task_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.score_files(*terms_and_index(spark, sf_dir), "item_id", "doc_id")


@add("h2_weighted_terms", f"WITH {_TERMS} SELECT item_id, term, weight, times, position FROM terms")
def weighted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return task_terms(spark, sf_dir)


@add("h5_term_file_score", f"WITH {_SCORES} SELECT item_id, doc_id, CAST(score AS BIGINT) AS score, matched, rank FROM ranked")
def term_file_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return task_scores(spark, sf_dir)


@add("j1_task_retrieval")
def task_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms, scored documents, and the twelve that cover the terms best, one by one."""
    terms, index = terms_and_index(spark, sf_dir)
    best = T.score_files(terms, index, "item_id", "doc_id").select("item_id", "doc_id")
    held = best.join(terms, "item_id").join(index.withColumnRenamed("token", "term"), ["doc_id", "term"])
    return T.coverage_greedy(held.select("item_id", "doc_id", "term", "weight"), "item_id", "doc_id", "term", "weight")


@add("j4_retrieval_trace", f"WITH {_SCORES} SELECT item_id, doc_id, CAST(score AS BIGINT) AS score, CASE WHEN rank <= 12 THEN 'selected' WHEN score < 300 THEN 'below_floor' ELSE 'not_covered' END AS outcome FROM ranked")
def retrieval_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = S.settle(task_scores(spark, sf_dir))  # read twice, worked out once
    return T.trace(ranked, ranked.where("rank <= 12"), "item_id", "doc_id", 300)


@add("d25_term_coverage", f"""WITH {_TERMS}, {_INDEX}, p AS (SELECT item_id, term, count(doc_id) AS n FROM terms LEFT JOIN (SELECT token, doc_id FROM idx WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = 'src0')) i ON term = token GROUP BY ALL)
SELECT item_id, count(*) FILTER (n > 0) AS covered, count(*) AS total, CASE WHEN count(*) FILTER (n > 0) = 0 THEN 'none' WHEN count(*) FILTER (n > 0) = count(*) THEN 'all' ELSE 'partial' END AS status FROM p GROUP BY 1""")
def term_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that the support set, the documents of one source, can back."""
    support = T.inverted_index(table(spark, sf_dir, "documents").where("source = 'src0'"), "doc_id", "text").withColumnRenamed("token", "term")
    return T.term_coverage(task_terms(spark, sf_dir), support, "item_id", "term", "doc_id")


@add("e1_lexical_search", """WITH q AS (SELECT DISTINCT p_name AS query FROM part), n AS (SELECT DISTINCT p_type || ' ' || p_name AS name FROM part UNION SELECT DISTINCT p_name FROM part),
m AS (SELECT query, name, CASE WHEN lower(name) = lower(query) THEN 'exact' WHEN starts_with(lower(name), lower(query)) THEN 'prefix' ELSE 'substring' END AS match FROM q JOIN n ON contains(lower(name), lower(query)))
SELECT * FROM (SELECT query, name, match, row_number() OVER (PARTITION BY query ORDER BY CASE match WHEN 'exact' THEN 0 WHEN 'prefix' THEN 1 ELSE 2 END, name) AS rank FROM m) WHERE rank <= 20""")
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    queries = part.select(F.col("p_name").alias("query")).distinct()
    names = part.select(F.concat_ws(" ", "p_type", "p_name").alias("name")).union(part.select("p_name"))
    return T.lexical_search(queries.withColumn("text", F.col("query")), names, "query", "text", "name")


@add("c15_reference_extraction", """WITH c AS (SELECT page_id, generate_subscripts(l, 1) AS ord, unnest(l) AS ref FROM (SELECT page_id, regexp_extract_all(html, 'href="/([^"]+)"', 1) AS l FROM pages)), k AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS token FROM benchmark)
SELECT page_id, ref, min(ord) AS ord FROM c WHERE lower(ref) IN (SELECT token FROM k) GROUP BY ALL""")
def reference_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in pages that an allow-list knows, in the order they appear: tokens first, then an equi-join."""
    refs = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), F.lit(1))).alias("ord", "ref"))
    known = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("token")).distinct()
    return refs.join(known, F.lower("ref") == F.col("token"), "left_semi").groupBy("page_id", "ref").agg((F.min("ord") + 1).cast("long").alias("ord"))


@add("c17_grounding_check", """WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) AS ref FROM pages), k AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS token FROM benchmark)
SELECT page_id, count(DISTINCT ref) AS refs, count(DISTINCT ref) FILTER (lower(ref) NOT IN (SELECT token FROM k)) AS ungrounded FROM c GROUP BY 1""")
def grounding_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), F.lit(1))).alias("ref")).distinct()
    known = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("token")).distinct().withColumn("known", F.lit(True))
    met = refs.join(known, F.lower("ref") == F.col("token"), "left")
    return met.groupBy("page_id").agg(F.count("*").alias("refs"), F.count(F.when(F.col("known").isNull(), 1)).alias("ungrounded"))


@add("d24_anchor_groups", """WITH c AS (SELECT unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) AS ref, page_id FROM pages) SELECT ref, count(*) AS mentions, count(DISTINCT page_id) AS pages, min(page_id) AS first_page FROM c GROUP BY 1""")
def anchor_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), F.lit(1))).alias("ref"))
    return refs.groupBy("ref").agg(F.count("*").alias("mentions"), F.countDistinct("page_id").alias("pages"), F.min("page_id").alias("first_page"))


@add("h13_name_signals", "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '^(why|how|what)') THEN 'question' WHEN role = 'system' THEN 'rule' WHEN length(text) < 80 THEN 'short' ELSE 'prose' END AS signal FROM conversations")
def name_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(low.rlike("^(why|how|what)"), "question").when(F.col("role") == "system", "rule").when(F.length("text") < 80, "short").otherwise("prose").alias("signal"))


@add("k1_signal_ledger", f"""WITH {_BEST} SELECT doc_id, count(*) AS eligible, least(count(*), 3) AS selected, count(*) - least(count(*), 3) AS omitted, CASE WHEN count(*) > 3 THEN 'max_per_group' ELSE 'none' END AS cutoff,
  coalesce(string_agg(CASE WHEN rank BETWEEN 4 AND 6 THEN CAST(line AS VARCHAR) END, ',' ORDER BY rank), '') AS omitted_sample FROM best GROUP BY 1""")
def signal_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = N.best_of_lines(found(spark, sf_dir), ["source", "doc_id"])
    return R.omission_ledger(best, ["doc_id"], [F.desc("weight"), F.col("line")], 3, "line")
