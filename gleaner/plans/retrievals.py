"""Queries over retrieval for tasks: terms, candidate files, anchors and what was left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import responses as R
from gleaner.operators import retrieval as T
from gleaner.operators import sets as S
from gleaner.operators import tasks as K
from gleaner.plans.bindings import FILES, Registry, files, table

registry = Registry()
add = registry.add
_SAID = [" See add support.", " Its compatibility fails.", " The documentation lies.", ""]


def capitalised(word: Column) -> Column:
    """A word with a capital first letter, of one character for one: no ß turns into two letters."""
    first = F.substring(word, 1, 1)
    capital = F.when(first == "ß", "ẞ").when(F.length(F.upper(first)) == 1, F.upper(first)).otherwise(first)
    return F.concat(capital, F.lower(F.substring(word, 2, 1 << 30)))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as tasks: their text, and names made of its words in the spellings of code."""
    w = F.split("text", " ")
    at = lambda k: F.coalesce(F.get(w, F.lit(k)), F.lit("x"))
    code = F.concat(F.lit(" In `"), at(0), F.lit("."), capitalised(at(1)), F.lit("` and "), at(2), F.lit("/"), at(3), F.lit(".go, "), at(4), capitalised(at(5)), F.lit(" (*"), capitalised(at(6)), F.lit(").Run_"), at(7), F.lit(";"))
    said = F.element_at(F.array(*map(F.lit, _SAID)), (F.col("item_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.concat("text", code, said).alias("text"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a path by source, language and id; lines that begin with a letter t declare something."""
    ends = F.element_at(F.array(*map(F.lit, [".go", ".md", "_test.go", ".py"])), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat(F.when(F.col("doc_id") % 11 == 0, "examples/").otherwise(""), F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("xx")), F.lit("/then"), F.col("doc_id").cast("string"), ends)
    return table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", path.alias("path"), F.regexp_replace("text", "(^|\n)([tT])", "$1func $2").alias("text"))


_SQL_TASKS = """w AS (SELECT item_id, text, string_split(text, ' ') AS w FROM benchmark),
tasks AS (SELECT item_id, text || ' In `' || coalesce(w[1], 'x') || '.' || upper(left(coalesce(w[2], 'x'), 1)) || lower(substr(coalesce(w[2], 'x'), 2)) || '` and ' || coalesce(w[3], 'x') || '/' || coalesce(w[4], 'x') || '.go, ' || coalesce(w[5], 'x') || upper(left(coalesce(w[6], 'x'), 1)) || lower(substr(coalesce(w[6], 'x'), 2)) || ' (*' || upper(left(coalesce(w[7], 'x'), 1)) || lower(substr(coalesce(w[7], 'x'), 2)) || ').Run_' || coalesce(w[8], 'x') || ';'
  || [' See add support.', ' Its compatibility fails.', ' The documentation lies.', ''][item_id % 4 + 1] AS text FROM w)"""
_STOP = ", ".join(f"'{w}'" for w in K.STOP_WORDS)
_TRIM = K.TRIM.replace("'", "''")
_PARTS = r"list_filter(regexp_extract_all({w}, '[\p{{L}}\p{{Nd}}]+'), lambda p: p <> {w})"
_CAPITAL = r"(regexp_matches({w}, '^\p{{Lu}}.*\p{{Ll}}') AND length({w}) >= 3)"
_SQL_TERMS = rf"""q AS (SELECT item_id, 0 AS sec, generate_subscripts(l, 1) AS i, unnest(l) AS w FROM (SELECT item_id, regexp_extract_all(text, '`([^`\r\n]{{1,160}})`', 1) AS l FROM tasks)
  UNION ALL SELECT item_id, 1, generate_subscripts(l, 1), trim(trim(unnest(l)), '{_TRIM}') FROM (SELECT item_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_.:/-]*') AS l FROM tasks)),
parts AS (SELECT item_id, sec, i, w, generate_subscripts(l, 1) AS j, unnest(l) AS p FROM (SELECT *, {_PARTS.format(w='w')} AS l FROM q)), once AS (SELECT *, row_number() OVER (PARTITION BY item_id, sec, i, lower(p) ORDER BY j) AS k FROM parts),
told AS (SELECT item_id, sec, i, 0 AS j, w AS raw, CASE WHEN sec = 0 THEN 16 WHEN regexp_matches(w, '\p{{Ll}}\p{{Lu}}|[_./]') THEN 10 WHEN {_CAPITAL.format(w='w')} THEN 4 ELSE 2 END AS weight FROM q
  UNION ALL SELECT item_id, sec, i, j, p, CASE WHEN sec = 0 THEN 8 WHEN regexp_matches(w, '[_./:\[\](){{}}<>*-]') AND (length(p) >= 5 OR regexp_matches(p, '\p{{Ll}}\p{{Lu}}') OR {_CAPITAL.format(w='p')}) THEN 8 ELSE 3 END FROM once WHERE k = 1),
said AS (SELECT *, lower(raw) AS term, (sec, i, j) AS pos FROM (SELECT item_id, sec, i, j, trim(trim(raw), '{_TRIM}') AS raw, weight FROM told)),
agg AS (SELECT item_id, term, max(weight) AS w, count(*) AS times, min(pos) AS pos, arg_min(raw, (-weight, pos)) AS text FROM said WHERE octet_length(encode(term)) BETWEEN 3 AND 96 AND term NOT IN ({_STOP}) GROUP BY ALL),
boost AS (SELECT item_id, term, text, times, pos, (CASE WHEN times > 1 AND w < 8 THEN least(8, w + (times - 1) * CASE WHEN w >= 4 THEN 4 ELSE 2 END) ELSE w END)::INTEGER AS weight FROM agg),
terms AS (SELECT item_id, term, text, weight, times, position FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, times DESC, pos, term) AS position FROM boost) WHERE position <= 32)"""


@add("h2_task_terms", f"WITH {_SQL_TASKS}, {_SQL_TERMS} SELECT item_id, term, text, weight, times, position FROM terms")
def task_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.task_terms(tasks(spark, sf_dir), "item_id", "text").select("item_id", "term", "text", "weight", "times", F.col("position").cast("long").alias("position"))


def retrieved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(terms, files, hits, candidates)"""
    asked = tasks(spark, sf_dir)
    terms, own = S.settle(K.task_terms(asked, "item_id", "text")), sources(spark, sf_dir)
    hits = S.settle(K.term_lines(own, terms, "doc_id", "text"))
    return terms, own, hits, K.candidate_files(asked, terms, own, hits, "item_id", "text", "doc_id", "path")


_SQL_FILES = r"""files AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'examples/' ELSE '' END || coalesce(source, 'none') || '/' || coalesce(lang, 'xx') || '/then' || doc_id || ['.go', '.md', '_test.go', '.py'][doc_id % 4 + 1] AS path, regexp_replace(text, '(^|\n)([tT])', '\1func \2', 'g') AS text FROM documents WHERE doc_id IS NOT NULL),
lines AS (SELECT doc_id, generate_subscripts(l, 1) AS line, unnest(l) AS said FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM files)),
cut AS (SELECT doc_id, line, said, unnest(list_transform(regexp_extract_all(said, '[\p{L}\p{N}_][\p{L}\p{N}_.:/-]*'), lambda w: trim(trim(w), 'TRIM'))) AS w FROM lines),
word AS (SELECT DISTINCT doc_id, line, said, lower(w) AS term FROM (SELECT doc_id, line, said, w FROM cut UNION ALL SELECT doc_id, line, said, unnest(list_filter(regexp_extract_all(w, '[\p{L}\p{Nd}]+'), lambda p: p <> w)) FROM cut) WHERE lower(w) IN (SELECT term FROM terms)),
hit AS (SELECT doc_id, line, term, regexp_matches(trim(said), '^(func|type|var|const) ') AND list_contains(string_split(lower(regexp_replace(regexp_replace(said, '[^\p{L}\p{Nd}]+', ' ', 'g'), '([\p{L}\p{Nd}])(\p{Lu})', '\1 \2', 'g')), ' '), term) AS declared FROM word),
worth AS (SELECT doc_id, term, sum(more)::BIGINT AS more, sum(times)::BIGINT AS times FROM (SELECT doc_id, term, 8 + least(count(DISTINCT line), 6) * 2 + CASE WHEN bool_or(declared) THEN 12 ELSE 0 END AS more, 1 AS times FROM hit GROUP BY ALL UNION ALL SELECT DISTINCT doc_id, term, 5, 1 FROM files JOIN (SELECT DISTINCT term FROM terms) t ON length(term) >= 3 AND contains(lower(path), term)) GROUP BY ALL),
met AS (SELECT item_id, doc_id, sum(weight * worth.times + more) AS score, count(*) AS matched FROM terms JOIN worth USING (term) GROUP BY ALL),
kind AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'extension' WHEN 1 THEN 'compatibility' ELSE 'unknown' END AS kind, item_id % 4 = 2 AS doc FROM tasks),
bonus AS (SELECT item_id, doc_id, path, CASE WHEN ends_with(path, '.md') AND (kind = 'compatibility' OR doc) THEN 9 ELSE 0 END + CASE WHEN kind = 'extension' AND starts_with(path, 'examples/') THEN 7 ELSE 0 END AS b FROM kind, files),
every AS (SELECT b.item_id, b.doc_id, path, coalesce(score, 0) + b AS score, coalesce(matched, 0) AS matched FROM bonus b LEFT JOIN met m ON m.item_id = b.item_id AND m.doc_id = b.doc_id WHERE score IS NOT NULL OR b > 0),
cand AS (SELECT item_id, doc_id, score::BIGINT AS score, matched, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, matched DESC, path) AS rank FROM every) WHERE rank <= 40)""".replace("TRIM", _TRIM)


@add("h5_candidate_files", f"WITH {_SQL_TASKS}, {_SQL_TERMS}, {_SQL_FILES} SELECT item_id, doc_id, score, matched, rank FROM cand")
def candidate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieved(spark, sf_dir)[3].select("item_id", "doc_id", "score", "matched", F.col("rank").cast("long").alias("rank"))


@add("j1_task_anchors")
def task_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixteen lines that each task's candidates offer to start from."""
    terms, own, hits, candidates = retrieved(spark, sf_dir)
    return K.line_anchors(candidates, terms, hits, own, "item_id", "doc_id", "path")


@add("j4_choice_trace")
def choice_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of each task: chosen, as one of the twelve that cover its terms best, or why not."""
    terms, _, hits, candidates = retrieved(spark, sf_dir)
    best = S.settle(candidates)
    only = S.settle(best.select("doc_id").distinct())  # a handful: the hits of other files go before anything is shuffled
    near = S.settle(hits.select("doc_id", "term").join(only, "doc_id", "left_semi").distinct())
    held = best.select("item_id", "doc_id").join(terms, "item_id").join(near, ["doc_id", "term"])
    chosen = T.coverage_greedy(held.select("item_id", "doc_id", "term", "weight"), "item_id", "doc_id", "term", "weight")
    return T.trace(best, chosen, "item_id", "doc_id", 300)


@add("j5_whole_evaluation", f"""WITH {FILES}, i AS (SELECT o_custkey AS task, o_orderkey, o_orderpriority, o_orderstatus, l_linenumber, l_returnflag, path, size FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN files ON part = l_partkey),
flows AS (SELECT task, o_orderpriority || ' ' || o_orderkey AS name, (o_orderkey % 10) / 10 AS confidence, list(path) FILTER (l_returnflag <> 'R') AS files, list(CASE WHEN size > 40 THEN 'prose about ' || path ELSE path END) FILTER (l_returnflag = 'R') AS evidence, max(path) AS entry FROM i GROUP BY task, o_orderkey, o_orderpriority),
paths AS (SELECT task, name, list_distinct(list_concat(list_concat(coalesce(files, []), list_filter(coalesce(evidence, []), lambda e: NOT regexp_matches(e, '(^|/)[.][.]?(/|$)|//|/$'))), CASE WHEN ends_with(lower(entry), '.go') THEN [entry] ELSE [] END)) AS p, confidence, evidence, files, entry FROM flows),
directions AS (SELECT task, lower(split_part(o_orderpriority, '-', 2)) AS direction, ['none such', upper(split_part(o_orderpriority, '-', 2)), split_part(o_orderpriority, '-', 1) || '-'] AS aliases, list_distinct(list(path) FILTER (l_linenumber = 1)) AS paths FROM i WHERE o_orderstatus = 'P' GROUP BY ALL),
m AS (SELECT d.task, direction, d.paths, name, confidence, list_intersect(coalesce(d.paths, []), p) AS held FROM directions d JOIN paths f ON f.task = d.task AND len(list_filter(aliases, lambda a: contains(lower(name), lower(a)))) > 0),
b AS (SELECT *, row_number() OVER (PARTITION BY task, direction ORDER BY len(held) DESC, confidence DESC, name) AS k, count(*) OVER (PARTITION BY task, direction) AS n FROM m),
c AS (SELECT d.task, d.direction, coalesce(n, 0) AS n, name, len(coalesce(d.paths, [])) - len(coalesce(held, [])) AS gone FROM directions d LEFT JOIN b ON b.task = d.task AND b.direction = d.direction AND k = 1),
cov AS (SELECT task, count(*) AS expected, count(*) FILTER (n = 0) AS missing, count(*) FILTER (n > 1) AS ambiguous, sum(gone)::BIGINT AS missing_paths FROM c GROUP BY 1),
allowed AS (SELECT DISTINCT task, path FROM i WHERE size <= 46), ev AS (SELECT task, unnest(evidence) AS path FROM flows), sure AS (SELECT task, path FROM ev WHERE (task, path) IN (SELECT (task, path) FROM allowed) OR (NOT regexp_matches(path, '(^|/)[.][.]?(/|$)|//|/$|[\\s*?]|^/') AND regexp_matches(lower(path), '[.](go|md|yaml|yml|json|toml|proto|mod|sum|sh|c|h|rs|py|js|ts)$'))),
refs AS (SELECT task, unnest(files) AS path FROM flows UNION SELECT task, entry FROM flows WHERE ends_with(lower(entry), '.go') UNION SELECT task, path FROM sure UNION SELECT task, path FROM i WHERE l_linenumber = 1),
g AS (SELECT task, count(*) AS referenced, count(*) FILTER ((task, path) NOT IN (SELECT (task, path) FROM allowed)) AS invalid FROM refs GROUP BY 1),
dd AS (SELECT task, min(path) AS path, max(path) AS seen, count(*) % 2 = 0 AS even FROM i GROUP BY 1), linked AS (SELECT DISTINCT c.task FROM c JOIN paths f ON f.task = c.task AND f.name = c.name JOIN dd ON dd.task = c.task WHERE list_contains(f.p, dd.path)),
w AS (SELECT o_custkey AS task, count(*) FILTER (o_orderstatus = 'P' AND o_totalprice > 480000) AS triggered FROM orders GROUP BY 1),
r AS (SELECT c_custkey AS task, coalesce(expected, 0) AS expected, coalesce(missing, 0) AS missing, coalesce(ambiguous, 0) AS ambiguous, coalesce(missing_paths, 0) AS missing_paths, coalesce(referenced, 0) AS referenced, coalesce(invalid, 0) AS invalid, coalesce(triggered, 0) AS triggered, c_custkey IN (SELECT task FROM linked) AS linked, c_custkey IN (SELECT task FROM linked) AND coalesce(even, false) AS drilled
  FROM customer LEFT JOIN cov ON cov.task = c_custkey LEFT JOIN g ON g.task = c_custkey LEFT JOIN w ON w.task = c_custkey LEFT JOIN dd ON dd.task = c_custkey)
SELECT *, missing = 0 AND ambiguous = 0 AND missing_paths = 0 AND invalid = 0 AND drilled AND triggered = 0 AS passed FROM r""")
def whole_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tasks: their orders as flows, named by priority; pending priorities as directions; files of small size allowed."""
    own = files(spark, sf_dir).select(F.col("part").alias("l_partkey"), "path", "size")
    orders = table(spark, sf_dir, "orders")
    items = table(spark, sf_dir, "lineitem").join(own, "l_partkey").select("l_orderkey", "l_linenumber", "l_returnflag", "path", "size")
    met = orders.join(items, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("task"), "o_orderkey", "o_orderpriority")
    of = S.settle(met.agg(F.collect_list(F.struct("o_orderstatus", "l_linenumber", "l_returnflag", "path", "size")).alias("items")))  # a row an order: what follows takes its lists from here
    i = of.select("task", "o_orderpriority", F.inline("items"))
    said = lambda x: F.when(x["size"] > 40, F.concat(F.lit("prose about "), x["path"])).otherwise(x["path"])
    part = lambda keep, to: F.transform(F.filter("items", keep), to)
    flows = of.select("task", "o_orderkey", "o_orderpriority", part(lambda x: x["l_returnflag"] != "R", lambda x: x["path"]).alias("files"), part(lambda x: x["l_returnflag"] == "R", said).alias("evidence"), F.array_max(F.col("items.path")).alias("entry"))
    flows = flows.select("task", F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("name"), (F.col("o_orderkey") % 10 / 10).alias("confidence"), "files", "evidence", "entry")
    word = F.split_part("o_orderpriority", F.lit("-"), F.lit(2))
    directions = i.where("o_orderstatus = 'P'").groupBy("task", "o_orderpriority").agg(F.collect_set(F.when(F.col("l_linenumber") == 1, F.col("path"))).alias("paths"))
    directions = directions.select("task", F.lower(word).alias("direction"), F.array(F.lit("none such"), F.upper(word), F.concat(F.split_part("o_orderpriority", F.lit("-"), F.lit(1)), F.lit("-"))).alias("aliases"), "paths")
    drill = i.groupBy("task").agg(F.min("path").alias("path"), (F.count("*") % 2 == 0).alias("even"))
    drill = drill.select("task", F.lit("Put").alias("symbol"), "path", F.lit("Put").alias("seen_symbol"), F.col("path").alias("seen_path"), F.when(F.col("even"), "Put").otherwise("Get").alias("test_target"), F.array(F.lit("p")).alias("predicates"), F.array(F.lit("q"), F.lit("p")).alias("seen_predicates"), F.array().cast("array<string>").alias("tests"), F.array(F.lit("t")).alias("seen_tests"))
    keyed = orders.select(F.col("o_custkey").alias("task"), F.col("o_orderkey").cast("string").alias("scope"), "o_orderstatus", "o_totalprice")
    forbidden = keyed.select("task", F.col("scope").alias("id"), "scope", F.array(F.lit("STATUS P"), F.lit("dear")).alias("contains_all"))
    told = keyed.select("task", "scope", F.concat(F.lit("Status "), "o_orderstatus", F.when(F.col("o_totalprice") > 480000, " is DEAR").otherwise(" is cheap")).alias("text"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task"))
    return R.evaluate(people, directions, flows, i.where("l_linenumber = 1").select("task", "path"), i.where("size <= 46").select("task", "path"), drill, forbidden, told)
