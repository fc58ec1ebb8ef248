"""The given tables seen as repositories, files, lines, graphs and runs; with the same views in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
DIRS = ["cmd/app", "internal/core", "pkg/api", "examples", "tests", "testdata", "docs", "docs/archive", "scripts", "gen", "eval-tools", "labs", "src/storage", "vendor/x", ".github"]
ENDS = [".go", "_test.go", ".md", ".py", ".pb.go", ".ts", ".sh", ".rs", ".png", ".key"]


class Registry:
    """Queries with their DuckDB twins."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, part, size): parts as files, brands as repositories."""
    part = table(spark, sf_dir, "part")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    path = F.concat(pick(DIRS, F.col("p_size") % len(DIRS)), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_partkey").cast("string"), pick(ENDS, F.col("p_partkey") % len(ENDS)))
    return part.select(F.col("p_brand").alias("repo"), path.alias("path"), F.col("p_partkey").alias("part"), F.col("p_size").alias("size"))


FILES = f"""files AS (SELECT p_brand AS repo, ({DIRS})[p_size % {len(DIRS)} + 1] || '/' || replace(p_name, ' ', '_') || p_partkey || ({ENDS})[p_partkey % {len(ENDS)} + 1] AS path,
  p_partkey AS part, p_size AS size FROM part)"""

LINES = """lines AS (SELECT doc_id, source, unnest(l) AS text, generate_subscripts(l, 1) AS line FROM (
  SELECT doc_id, source, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents WHERE length(text) > 0))""".replace("\\\\n", "\\n")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, n): every item is a call: of its part by its supplier, or if it came back the other way round.

    Parts are numbered from 10**9 on, so that both stand in one space of node ids.
    """
    items = table(spark, sf_dir, "lineitem")
    part = F.col("l_partkey") + 1_000_000_000
    down = items.where("l_returnflag <> 'R'").groupBy(F.col("l_suppkey").alias("src"), part.alias("dst")).agg(F.count("*").alias("n"))
    up = items.where("l_returnflag = 'R'").groupBy(part.alias("src"), F.col("l_suppkey").alias("dst")).agg(F.count("*").alias("n"))
    return down.union(up)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): a row an item, the relations of edges() before they are counted."""
    part, up = F.col("l_partkey") + 1_000_000_000, F.col("l_returnflag") == "R"
    items = table(spark, sf_dir, "lineitem").where("l_returnflag is not null")
    return items.select(F.when(up, part).otherwise(F.col("l_suppkey")).alias("src"), F.when(up, F.col("l_suppkey")).otherwise(part).alias("dst"))


EDGES = """edges AS (
  SELECT l_suppkey AS src, l_partkey + 1000000000 AS dst, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL
  UNION ALL SELECT l_partkey + 1000000000, l_suppkey, count(*) FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)"""


def choice_sql(rows: str, columns: str, minimum: dict[str, int], per_file: int, total: int) -> str:
    """Anchors chosen one by one from the whole queue of each scope, in SQL: reserved by role, then filled.

    `rows` has scope, role, anchor, file, score and fill; nothing is cut beforehand.
    """
    turn = "CASE role " + " ".join(f"WHEN '{r}' THEN {k}" for k, r in enumerate(minimum)) + " END"
    least = "CASE q.role " + " ".join(f"WHEN '{r}' THEN {n}" for r, n in minimum.items()) + " END"
    return f"""queue AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY pass, turn, down, anchor, role) AS k FROM (
      SELECT scope, role, anchor, file, 0 AS pass, {turn} AS turn, -score AS down FROM (SELECT * FROM {rows} WHERE role IN ({', '.join(f"'{r}'" for r in minimum)}) QUALIFY row_number() OVER (PARTITION BY scope, role, anchor ORDER BY score DESC, file) = 1)
      UNION ALL SELECT scope, role, anchor, file, 1, 0, -fill FROM (SELECT * FROM {rows} QUALIFY row_number() OVER (PARTITION BY scope, anchor ORDER BY fill DESC, role, file) = 1))),
    walk AS (SELECT scope, 0::BIGINT AS k, []::BIGINT[] AS seen, []::VARCHAR[] AS held, []::VARCHAR[] AS roles, NULL::VARCHAR AS reason FROM (SELECT DISTINCT scope FROM queue) UNION ALL
      SELECT scope, k, CASE WHEN ok THEN list_append(seen, anchor) ELSE seen END, CASE WHEN ok THEN list_append(held, file) ELSE held END, CASE WHEN ok AND pass = 0 THEN list_append(roles, role) ELSE roles END, CASE WHEN ok THEN CASE pass WHEN 0 THEN 'reserved' ELSE 'filled' END END
      FROM (SELECT w.scope, q.k, w.seen, w.held, w.roles, q.anchor, q.file, q.pass, q.role, NOT list_contains(w.seen, q.anchor) AND (q.pass = 1 OR len(list_filter(w.roles, lambda r: r = q.role)) < {least}) AND len(list_filter(w.held, lambda f: f = q.file)) < {per_file} AND len(w.seen) < {total} AS ok
        FROM walk w JOIN queue q ON q.scope = w.scope AND q.k = w.k + 1))
    SELECT {columns} FROM walk JOIN queue q USING (scope, k) WHERE reason IS NOT NULL"""
