"""Queries over provenance trails, unit catalogs, searches by kind and archived comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.operators import retrieval as W
from gleaner.operators import sets as S
from gleaner.operators import trail as P
from gleaner.operators import units as U
from gleaner.plans.bindings import FILES, Registry, files, table
from gleaner.sources.archive import Archive, compare_variants

registry = Registry()
add = registry.add


def study_trail(spark: SparkSession, sf_dir: str) -> P.Trail:
    """Nations as components, customers as questions, orders as claims, parts as evidence, suppliers as frontiers, the
    log's events as probes.  Parts of the largest sizes are not authorised, so items that cite them don't resolve."""
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    none = F.lit(None).cast("string")

    def nodes(rows: DataFrame, kind: Column | str, source: str, section: str, label: Column | str, basis: str, path: Column = none, line: Column | None = None) -> DataFrame:
        line = F.lit(None).cast("int") if line is None else line
        return rows.select((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), text(source).alias("source_id"), F.lit(section).alias("section"), text(label).alias("label"), F.lit(basis).alias("basis"), path.alias("path"), line.cast("int").alias("line"))

    def edges(rows: DataFrame, kind: str, src: tuple[Column | str, str], dst: tuple[Column | str, str], basis: Column | str) -> DataFrame:
        lit = lambda v: F.lit(v) if isinstance(v, str) else v
        return rows.select(F.lit(kind).alias("kind"), lit(src[0]).alias("from_kind"), text(src[1]).alias("from_source"), lit(dst[0]).alias("to_kind"), text(dst[1]).alias("to_source"), lit(basis).alias("basis"))

    customers, orders, items, parts = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "part"))
    known = files(spark, sf_dir).where("size <= 48").join(parts.select(F.col("p_partkey").alias("part"), "p_name"), "part")
    claim = F.when(F.col("o_orderstatus") == "F", "lifecycle_step").otherwise("claim")
    ordered = orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", claim.alias("claim"))
    said = items.join(ordered, F.col("l_orderkey") == F.col("o_orderkey"))
    events = table(spark, sf_dir, "events")
    every = [
        nodes(table(spark, sf_dir, "nation"), "component", "n_nationkey", "planning", "n_name", "orientation_hypothesis"),
        nodes(customers, "question", "c_custkey", "planning", "c_name", "model_synthesis"),
        nodes(ordered, F.col("claim"), "o_orderkey", "mental_model", "o_orderpriority", "model_synthesis"),
        nodes(known, "evidence", "part", "evidence", "p_name", "exact_source", F.col("path"), F.col("size")),
        nodes(table(spark, sf_dir, "supplier"), "frontier", "s_suppkey", "next_dive", "s_name", "static"),
        nodes(events, "probe", "event_id", "probes", "event_type", "observed"), nodes(events.where("event_type = 'error'"), "probe", "event_id", "probes", F.lit("failed"), "observed"),
    ]
    drawn = [
        edges(customers, "frames_question", ("component", "c_nationkey"), ("question", "c_custkey"), "orientation_hypothesis"),
        edges(ordered, "answers", ("question", "o_custkey"), (F.col("claim"), "o_orderkey"), "model_synthesis"),
        edges(said.where("l_returnflag <> 'R'"), "supports", ("evidence", "l_partkey"), (F.col("claim"), "o_orderkey"), F.when(F.col("l_returnflag") == "A", "exact_source").otherwise("navigation")),
        edges(said.where("l_returnflag = 'R' and l_quantity > 49"), "leaves_open", (F.col("claim"), "o_orderkey"), ("frontier", "l_suppkey"), "static"),
        edges(events, "probes", ("probe", "event_id"), ("question", "user_id"), "observed"),
        P.next_edges(ordered.where("claim = 'lifecycle_step'"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "teaching_next", "lifecycle_step", "o_orderkey", "model_synthesis"),
    ]
    return P.provenance_trail(every, drawn, ("question", "0"))


@add("g17_provenance_trail", f"""WITH {FILES}, o AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'lifecycle_step' ELSE 'claim' END AS claim FROM orders), i AS (SELECT * FROM lineitem JOIN o ON o_orderkey = l_orderkey),
raw AS (SELECT 'component' AS kind, n_nationkey::VARCHAR AS sid, n_name AS label, NULL AS path FROM nation UNION ALL SELECT 'question', c_custkey::VARCHAR, c_name, NULL FROM customer UNION ALL SELECT claim, o_orderkey::VARCHAR, o_orderpriority, NULL FROM o UNION ALL SELECT 'evidence', part::VARCHAR, p_name, path || ':' || size FROM files JOIN part p ON p_partkey = part WHERE size <= 48
  UNION ALL SELECT 'frontier', s_suppkey::VARCHAR, s_name, NULL FROM supplier UNION ALL SELECT 'probe', event_id::VARCHAR, event_type, NULL FROM events UNION ALL SELECT 'probe', event_id::VARCHAR, 'failed', NULL FROM events WHERE event_type = 'error'),
n AS (SELECT kind, sid, kind || '-' || sha256(kind || chr(0) || sid)[:24] AS id, min(label) AS label, min(path) AS path, count(*) AS k, count(DISTINCT label) AS d FROM raw GROUP BY kind, sid),
drawn AS (SELECT 'frames_question' AS kind, 'component' AS fk, c_nationkey::VARCHAR AS f, 'question' AS tk, c_custkey::VARCHAR AS t, 'orientation_hypothesis' AS basis FROM customer UNION ALL SELECT 'answers', 'question', o_custkey::VARCHAR, claim, o_orderkey::VARCHAR, 'model_synthesis' FROM o
  UNION ALL SELECT 'supports', 'evidence', l_partkey::VARCHAR, claim, o_orderkey::VARCHAR, CASE l_returnflag WHEN 'A' THEN 'exact_source' ELSE 'navigation' END FROM i WHERE l_returnflag <> 'R' UNION ALL SELECT 'leaves_open', claim, o_orderkey::VARCHAR, 'frontier', l_suppkey::VARCHAR, 'static' FROM i WHERE l_returnflag = 'R' AND l_quantity > 49
  UNION ALL SELECT 'probes', 'probe', event_id::VARCHAR, 'question', user_id::VARCHAR, 'observed' FROM events UNION ALL SELECT * FROM (SELECT 'teaching_next', 'lifecycle_step', o_orderkey::VARCHAR, 'lifecycle_step', lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::VARCHAR AS t, 'model_synthesis' FROM o WHERE claim = 'lifecycle_step') WHERE t IS NOT NULL),
e AS (SELECT kind, fk || '-' || sha256(fk || chr(0) || f)[:24] AS src, tk || '-' || sha256(tk || chr(0) || t)[:24] AS dst, min(basis) AS basis, count(*) AS k FROM drawn GROUP BY ALL), ok AS (SELECT kind, src, dst, basis FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)),
every AS (SELECT * FROM ok UNION ALL SELECT 'frontier', (SELECT id FROM n WHERE kind = 'question' AND sid = '0'), id, 'static' FROM n WHERE kind = 'frontier' AND id NOT IN (SELECT dst FROM ok))
SELECT 'node' AS part, kind, id, label AS detail, 1::BIGINT AS n FROM n UNION ALL SELECT 'edge', kind, src || '>' || dst, basis, 1 FROM every UNION ALL SELECT 'locator', 'evidence', id, path, 1 FROM n WHERE path IS NOT NULL
UNION ALL SELECT 'conflicting_node', kind, id, '', k FROM n WHERE d > 1 UNION ALL SELECT 'unknown_from', kind, src, '', sum(k)::BIGINT FROM e WHERE src NOT IN (SELECT id FROM n) GROUP BY ALL UNION ALL SELECT 'unknown_to', kind, dst, '', sum(k)::BIGINT FROM e WHERE dst NOT IN (SELECT id FROM n) GROUP BY ALL""")
def provenance_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = study_trail(spark, sf_dir)
    one = F.lit(1).cast("long").alias("n")
    rows = found.nodes.select(F.lit("node").alias("part"), "kind", "id", F.col("label").alias("detail"), one)
    rows = rows.union(found.edges.select(F.lit("edge"), "kind", F.concat("src", F.lit(">"), "dst"), "basis", one))
    rows = rows.union(found.locators.select(F.lit("locator"), F.lit("evidence"), "id", F.concat_ws(":", "path", F.col("line").cast("string")), one))
    return rows.union(found.diagnostics.select("code", "kind", "detail", F.lit(""), "n"))


@add("g12_refined_units", f"""WITH RECURSIVE {FILES}, m AS (SELECT repo, split_part(p_name, ' ', 1) || '/' || regexp_extract(path, '^(.*)/', 1) AS p, part, size % 2 AS role, part % 41 = 0 AS seed FROM files JOIN part ON p_partkey = part),
u AS (SELECT *, CASE WHEN seed THEN 'seed:' || p ELSE 'module:' || role || ':' || split_part(p, '/', 1) END AS unit, split_part(p, '/', 1) || '/' || split_part(p, '/', 2) AS nxt FROM m),
c AS (SELECT repo, unit, nxt, count(*) AS n FROM u GROUP BY ALL), s AS (SELECT repo, unit, sum(n) AS n, count(*) AS children, sum(ceil(n / 2)) AS after FROM c GROUP BY ALL), t AS (SELECT repo, sum(ceil(n / 2))::BIGINT AS total FROM s GROUP BY 1),
plans AS (SELECT repo, unit, total, (after - ceil(n / 2))::BIGINT AS more, row_number() OVER (PARTITION BY repo ORDER BY unit) AS k FROM s JOIN t USING (repo) WHERE starts_with(unit, 'module:') AND children > 1 AND n > 5),
walk AS (SELECT repo, 0::BIGINT AS k, total AS used, NULL::VARCHAR AS unit FROM t UNION ALL SELECT w.repo, p.k, CASE WHEN used + more <= 52 THEN used + more ELSE used END, CASE WHEN used + more <= 52 THEN p.unit END FROM walk w JOIN plans p ON p.repo = w.repo AND p.k = w.k + 1),
f AS (SELECT u.repo, p, part, CASE WHEN w.unit IS NULL THEN u.unit ELSE 'module:' || role || ':' || nxt END AS unit FROM u LEFT JOIN walk w ON w.repo = u.repo AND w.unit = u.unit)
SELECT repo, unit, (row_number() OVER (PARTITION BY repo, unit ORDER BY p, part) - 1) // 2 AS chunk, p || '#' || part AS member FROM f""")
def refined_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as packages below the first word of their name: broad words split by folder, 52 units of two a brand at most."""
    own = files(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_name"), "part")
    place = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("/"), F.regexp_extract("path", "^(.*)/", 1))
    rows = own.select("repo", place.alias("p"), "part", (F.col("size") % 2).cast("string").alias("role"), (F.col("part") % 41 == 0).alias("seed"))
    out = U.unit_catalog(rows, ["repo"], "p", "role", "seed", 2, 5, 52)
    turn = F.row_number().over(Window.partitionBy("repo", "unit").orderBy("p", "part")) - 1
    return out.select("repo", "unit", F.floor(turn / 2).cast("long").alias("chunk"), F.concat_ws("#", "p", F.col("part").cast("string")).alias("member"))


@add("e1_search_by_kind", f"""WITH {FILES}, e AS (SELECT part AS entry, CASE part % 3 WHEN 0 THEN 'symbol' WHEN 1 THEN 'document' ELSE 'file' END AS kind, path, CASE WHEN part % 3 = 0 THEN p_name ELSE regexp_extract(path, '[^/]*$') END AS name FROM files JOIN part ON p_partkey = part),
q AS (SELECT DISTINCT p_name AS query FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part UNION SELECT DISTINCT lower(p_brand[-1:]) FROM part UNION SELECT DISTINCT substr(p_name, 1, 2) FROM part UNION SELECT path FROM files WHERE size = 9),
m AS (SELECT query, e.*, CASE WHEN lower(path) = lower(query) THEN 0 WHEN lower(name) = lower(query) THEN 1 WHEN starts_with(lower(name), lower(query)) OR starts_with(lower(path), lower(query)) THEN 2 ELSE 3 END AS l FROM q JOIN e ON contains(lower(path), lower(query)) OR contains(lower(name), lower(query))),
p AS (SELECT *, CASE l WHEN 0 THEN CASE kind WHEN 'symbol' THEN 1 ELSE 0 END WHEN 1 THEN CASE kind WHEN 'symbol' THEN 2 ELSE 3 END ELSE l * 4 - 4 + CASE kind WHEN 'symbol' THEN 0 WHEN 'document' THEN 1 ELSE 2 END END AS priority FROM m)
SELECT query, entry, ['exact_path', 'exact_name', 'prefix', 'substring'][l + 1] AS match, priority, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY priority, lower(path), lower(name), path, name, entry) AS rank FROM p) WHERE rank <= 20""")
def search_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, their first words and letters, digits and whole paths as queries over all files; every third file is a symbol."""
    part = table(spark, sf_dir, "part")
    own = files(spark, sf_dir).join(part.select(F.col("p_partkey").alias("part"), "p_name"), "part")
    kind = F.when(F.col("part") % 3 == 0, "symbol").when(F.col("part") % 3 == 1, "document").otherwise("file")
    entries = own.select(F.col("part").alias("entry"), kind.alias("kind"), "path", F.when(F.col("part") % 3 == 0, F.col("p_name")).otherwise(F.regexp_extract("path", "[^/]*$", 0)).alias("name"))
    asked = [part.select(F.col("p_name").alias("query")), part.select(F.split_part("p_name", F.lit(" "), F.lit(1))), part.select(F.lower(F.right("p_brand", F.lit(1)))), part.select(F.substring("p_name", 1, 2)), own.where("size = 9").select("path")]
    queries = reduce(DataFrame.union, asked).distinct()
    return W.search_entries(queries.withColumn("text", F.col("query")), entries, "query", "text")


@add("j12_strategy_archive", """WITH m AS (SELECT c_nationkey AS nation, year(o_orderdate) AS y, CASE o_orderstatus WHEN 'F' THEN 'monolithic' ELSE 'fan_out' END AS v, o_orderpriority, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O')),
c AS (SELECT nation, y, count(DISTINCT o_orderpriority) FILTER (v = 'monolithic') AS a, count(*) FILTER (v = 'monolithic') // 4 AS b, count(DISTINCT o_orderpriority) FILTER (v = 'fan_out') AS d, count(*) FILTER (v = 'fan_out') // 4 AS e, count(*) FILTER (v = 'monolithic') AS na, count(*) FILTER (v = 'fan_out') AS nd FROM m GROUP BY ALL),
r AS (SELECT nation, y, CASE WHEN na > 0 THEN a END AS a, CASE WHEN na > 0 THEN b END AS b, CASE WHEN nd > 0 THEN d END AS d, CASE WHEN nd > 0 THEN e END AS e FROM c), l AS (SELECT *, row_number() OVER w AS k, lag((a, b, d, e)) OVER w IS DISTINCT FROM (a, b, d, e) AS new FROM r WINDOW w AS (PARTITION BY nation ORDER BY y))
SELECT nation, a AS monolithic_coverage, b AS monolithic_calls, d AS fan_out_coverage, e AS fan_out_calls, sum(1) OVER (PARTITION BY nation ORDER BY y)::BIGINT AS version, y AS batch FROM l WHERE new OR k = 1""")
def strategy_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years as batches in turn: what two ways of handling orders cover and cost in each nation, archived when it changed.

    The first batch is appended twice, as after a lost attempt.
    """
    met = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).where("o_orderstatus in ('F', 'O')")
    rows = met.groupBy(F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("y"), F.when(F.col("o_orderstatus") == "F", "monolithic").otherwise("fan_out").alias("variant"))
    rows = S.settle(rows.agg(F.countDistinct("o_orderpriority").alias("coverage"), F.floor(F.count("*") / 4).alias("calls")))
    years = sorted(r["y"] for r in rows.select("y").distinct().collect())  # a handful, whatever the input
    archive = Archive(spark, S.folder(spark), ["nation"])
    kept = None
    for year in [*years[:1], *years]:
        kept = compare_variants(rows.where(F.col("y") == year), ["nation"], "variant", ["coverage", "calls"], ["monolithic", "fan_out"])
        archive.append(kept, year)
    return archive.read(kept.schema).drop("fingerprint")
