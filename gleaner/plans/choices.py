"""Queries over choices: roles, covering frontiers, walks under limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import expansion as Z
from gleaner.operators import frontier as Y
from gleaner.operators import retrieval as W
from gleaner.operators import roles as O
from gleaner.operators import selection as X
from gleaner.operators import sets as S
from gleaner.plans.bindings import FILES, Registry, choice_sql, edges, files, table

registry = Registry()
add = registry.add

#: Words of the given parts' names that speak for a role, in the shape of roles.ROLE_WORDS.
WORDS = {"R": [[(120, ["widget", "gear"]), (80, ["ring", "bolt"])], [(15, ["red", "small"])]], "A": [[(100, ["ring", "small"])]], "N": []}
PAIRS = {"A": [(60, ["blue", "red"], ["bolt", "gear"])]}


def role_candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as tasks: (their items as candidates, words of the parts they returned as terms).

    An item's file is its part's, its symbol the part's name and type, its roles its own flag and N.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_discount").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    own = files(spark, sf_dir).select(F.col("part").alias("l_partkey"), "path")
    named = F.split("p_name", " ")
    rows = items.join(own, "l_partkey").select(
        F.col("o_custkey").alias("task"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("anchor"), "path", F.concat_ws(" ", "p_name", F.lower("p_type")).alias("symbol"),
        F.col("l_quantity").cast("long").alias("base"), named.alias("terms"), F.array(F.col("l_returnflag"), F.lit("N")).alias("roles"), (F.col("l_discount") > 0.05).alias("complete"),
    )
    rows = rows.groupBy("task", "anchor").agg(*(F.max(c).alias(c) for c in ("path", "symbol", "base", "terms", "roles", "complete")))
    said = items.where("l_returnflag = 'R'").select(F.col("o_custkey").alias("task"), F.explode(named).alias("term"))
    return rows, said.groupBy("task", "term").agg(F.least(F.count("*"), F.lit(16)).alias("weight"))


_ITEMS = f"""{FILES}, items AS (SELECT o_custkey AS task, l_orderkey * 10 + l_linenumber AS anchor, path, p_name || ' ' || lower(p_type) AS symbol, l_quantity::BIGINT AS base, string_split(p_name, ' ') AS terms, l_returnflag AS flag, l_discount > 0.05 AS complete
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN files ON part = l_partkey),
cand AS (SELECT task, anchor, max(path) AS path, max(symbol) AS symbol, max(base) AS base, max(terms) AS terms, max(flag) AS flag, max(complete) AS complete FROM items GROUP BY ALL),
terms AS (SELECT task, term, least(count(*), 16) AS weight FROM (SELECT task, unnest(terms) AS term FROM items WHERE flag = 'R') GROUP BY ALL),
words AS (SELECT DISTINCT task, anchor, unnest(regexp_extract_all(symbol, '[a-z0-9]+')) AS word FROM cand),
alike AS (SELECT w.task, anchor, least(sum(weight * 12), 600) AS n FROM words w JOIN terms t ON t.task = w.task AND length(word) >= 3 AND length(term) >= 3 AND (word = term OR (length(word) >= 5 AND length(term) >= 5 AND left(word, 5) = left(term, 5))) GROUP BY ALL),
said AS (SELECT c.task, anchor, sum(weight * 2) AS n FROM (SELECT DISTINCT task, anchor, unnest(terms) AS term FROM cand) c JOIN terms t ON t.task = c.task AND t.term = c.term GROUP BY ALL),
has AS (SELECT task, anchor, list(word) AS w FROM words GROUP BY ALL),
scored AS (SELECT task, role, anchor, path, base, (base - 12 * (length(path) - length(replace(path, '/', ''))) + coalesce(s.n, 0) + coalesce(a.n, 0) + CASE WHEN complete THEN 24 ELSE 0 END
  + CASE role WHEN 'R' THEN CASE WHEN list_has_any(w, ['widget', 'gear']) THEN 120 WHEN list_has_any(w, ['ring', 'bolt']) THEN 80 ELSE 0 END + CASE WHEN list_has_any(w, ['red', 'small']) THEN 15 ELSE 0 END
    WHEN 'A' THEN CASE WHEN list_has_any(w, ['ring', 'small']) THEN 100 ELSE 0 END + CASE WHEN list_has_any(w, ['blue', 'red']) AND list_has_any(w, ['bolt', 'gear']) THEN 60 ELSE 0 END ELSE 0 END)::BIGINT AS score
  FROM (SELECT *, unnest(list_distinct([flag, 'N'])) AS role FROM cand) LEFT JOIN has USING (task, anchor) LEFT JOIN said s USING (task, anchor) LEFT JOIN alike a USING (task, anchor))"""


def role_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, terms = role_candidates(spark, sf_dir)
    return O.role_scores(rows, terms, ["task"], ["R", "A", "N"], WORDS, PAIRS, {})


@add("e21_role_scores", f"WITH {_ITEMS} SELECT task, role, anchor, score FROM scored")
def e21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_scores(spark, sf_dir).select("task", "role", "anchor", "score")


@add("j2_role_selection", f"WITH RECURSIVE {_ITEMS}, ranked AS (SELECT task AS scope, role, anchor, path AS file, score, base AS fill FROM scored), {choice_sql('ranked', 'scope AS task, q.role, q.anchor, reason', {'R': 3, 'A': 2}, 2, 12)}")
def role_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer's items, three for R and two for A by their scores for the role, then the largest; two of a file, twelve in all."""
    scored = role_scores(spark, sf_dir).select("task", "role", "anchor", "path", "score", "base")
    chosen = X.role_contract(scored, ["task"], "role", "anchor", "path", "score", {"R": 3, "A": 2}, 2, 12, "base")
    return chosen.select("task", "role", "anchor", "reason")


@add("j8_coverage_frontier")
def coverage_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as spans of their customer's nation: buckets are the nations of their suppliers under each flag; each
    scope's own nation is preferred, then its neighbours by number; forty orders at most, shorter ones for roles."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("scope"))
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    size = items.groupBy("l_orderkey").agg(F.count("*").alias("targets"))
    spans = table(spark, sf_dir, "orders").join(customers, "o_custkey").select("scope", F.col("o_orderkey").alias("l_orderkey"))
    members = items.select("l_orderkey", F.col("l_returnflag").alias("role"), F.col("s_nationkey").alias("bucket")).distinct()
    rows = spans.join(members, "l_orderkey").join(size, "l_orderkey").select("scope", F.col("l_orderkey").alias("span"), "role", "bucket", "targets", F.col("l_orderkey").alias("order"))
    near = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("scope"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("rank"))
    near = near.select("scope", F.explode(F.array(F.lit("R"), F.lit("A"))).alias("role"), ((F.col("scope") + F.col("rank")) % 25).alias("bucket"), "rank")
    return Y.coverage_frontier(rows, ["scope"], "span", "role", "bucket", "targets", "order", 40, near)


def link_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(callables, edges): pages by their titles, and what they link to by its own name."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    links = pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]+)"'), F.lit(1))).alias("dst")).distinct()
    titles = pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("node"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("name"), F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    refs = links.select(F.col("dst").alias("node")).distinct().select("node", F.substring("node", 2, 1 << 30).alias("name"), F.col("node").alias("path"))
    return titles.union(refs), links


def asked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, term): the twelve strongest words of each conversation's first turn."""
    first = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    terms = W.weighted_terms(first, "conv_id", "text", 12)
    return terms.where("length(term) > 2").select(F.col("conv_id").alias("query"), "term")


@add("g16_question_expansion")
def question_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a question over the whole graph of pages and links."""
    callables, links = link_graph(spark, sf_dir)
    return Z.question_expansion(callables, links, asked_terms(spark, sf_dir))


@add("g7_entry_calls")
def entry_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier as a root of the whole call graph: families admitted (reason null) and left out, of each node."""
    calls = S.settle(edges(spark, sf_dir))
    roots = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))
    late = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O' and l_tax > 0.07").groupBy(F.col("l_suppkey").alias("node")).agg(F.count("*").alias("n")).withColumn("reason", F.lit("dynamic_invoke"))
    families, rest = Z.entry_calls(calls, roots, left_out=late)
    kept = families.select("root", F.col("caller").alias("node"), "callee", F.lit(None).cast("string").alias("reason"), F.lit(1).cast("long").alias("families"), "witnesses", "position")
    return kept.unionByName(rest.select("root", "node", F.lit(None).cast("long").alias("callee"), "reason", "families", "witnesses", F.lit(None).cast("int").alias("position")))
