"""Queries over owners, spreads, duplicates, checks and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import labels as L
from gleaner.operators import details as D
from gleaner.operators import graph as G
from gleaner.operators import sets as S
from gleaner.plans.bindings import EDGES, FILES, Registry, edges, files, table

registry = Registry()
add = registry.add


@add("c24_declared_owner", """WITH d AS (SELECT l_orderkey * 10 + l_linenumber AS declaration, max(l_partkey) AS symbol, max(l_suppkey) AS path, max(l_linenumber) AS line, max(CASE WHEN l_tax > 0.04 THEN 0 ELSE l_quantity % 3 END)::INT AS col FROM lineitem GROUP BY 1),
m AS (SELECT l_partkey AS symbol, l_suppkey AS path, l_linenumber AS line, (l_quantity % 4)::INT AS col, l_returnflag AS owner FROM lineitem WHERE l_discount > 0.05), a AS (SELECT declaration, list_sort(list(DISTINCT owner)) AS o FROM d JOIN m USING (symbol, path, line) WHERE d.col = 0 OR m.col = 0 OR d.col = m.col GROUP BY 1),
b AS (SELECT declaration, list_sort(list(DISTINCT n_name)) AS o FROM d JOIN supplier ON s_suppkey = path JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey <> 3 AND declaration NOT IN (SELECT declaration FROM a) GROUP BY 1)
SELECT d.declaration, CASE WHEN a.o IS NOT NULL THEN 0 WHEN b.o IS NOT NULL THEN 1 END AS tier, array_to_string(coalesce(a.o, b.o, []), ',') AS owners FROM d LEFT JOIN a USING (declaration) LEFT JOIN b USING (declaration)""")
def declared_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as declarations of their part in their supplier's file; discounted items as members, suppliers' nations as packages."""
    items = table(spark, sf_dir, "lineitem")
    col = F.when(F.col("l_tax") > 0.04, 0).otherwise(F.col("l_quantity") % 3).cast("int")
    d = items.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("declaration")).agg(F.max("l_partkey").alias("symbol"), F.max("l_suppkey").alias("path"), F.max("l_linenumber").alias("line"), F.max(col).alias("column"))
    m = items.where("l_discount > 0.05").select(F.col("l_partkey").alias("symbol"), F.col("l_suppkey").alias("path"), F.col("l_linenumber").alias("line"), (F.col("l_quantity") % 4).cast("int").alias("column"), F.col("l_returnflag").alias("owner"))
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("path"), F.col("s_nationkey").alias("package"))
    packages = table(spark, sf_dir, "nation").where("n_regionkey <> 3").select(F.col("n_nationkey").alias("package"), F.col("n_name").alias("owner"))
    return D.declared_owners(d, m, own, packages).select("declaration", "tier", F.array_join("owners", ",").alias("owners"))


@add("e7_scored_by_hops", f"""WITH RECURSIVE {EDGES}, {FILES}, walk(node, distance) AS (SELECT s_suppkey, 0 FROM supplier WHERE s_acctbal > 9000 UNION SELECT e.dst, w.distance + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.distance < 3), r AS (SELECT node, min(distance) AS hop FROM walk GROUP BY 1)
SELECT path, CASE WHEN part % 50 = 0 THEN 100 ELSE 0 END + CASE hop WHEN 1 THEN 80 WHEN 2 THEN 50 WHEN 3 THEN 30 ELSE 0 END AS score, concat_ws(',', CASE WHEN part % 50 = 0 THEN 'entrypoint' END, CASE hop WHEN 1 THEN 'dependency' WHEN 2 THEN 'second_hop' WHEN 3 THEN 'third_hop' END) AS reasons FROM files LEFT JOIN r ON node = part + 1000000000""")
def scored_by_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by their distance from the entries over the whole call graph."""
    entries = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_suppkey").alias("node"))
    reach = G.distances(S.settle(edges(spark, sf_dir)), entries, 3).select((F.col("node") - 1_000_000_000).alias("part"), F.col("distance").alias("hop"))
    hop = F.coalesce("hop", F.lit(0))
    scored = files(spark, sf_dir).join(reach, "part", "left").select("path", L.signal_sum([(F.col("part") % 50 == 0, "entrypoint", 100), (hop == 1, "dependency", 80), (hop == 2, "second_hop", 50), (hop == 3, "third_hop", 30)]).alias("s"))
    return scored.select("path", "s.score", F.array_join("s.reasons", ",").alias("reasons"))


@add("e14_spread_positions", """WITH n AS (SELECT o_custkey AS task, count(*) AS n FROM orders GROUP BY 1), i AS (SELECT o_custkey AS task, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, n FROM orders JOIN n ON task = o_custkey),
p AS (SELECT *, coalesce(list_position(list_distinct_ordered, i), 99) AS t FROM (SELECT *, list_filter([n // 2, 0, n - 1, n // 4, 3 * (n - 1) // 4, n // 3, 2 * (n - 1) // 3], lambda x, k: list_position([n // 2, 0, n - 1, n // 4, 3 * (n - 1) // 4, n // 3, 2 * (n - 1) // 3], x) = k) AS list_distinct_ordered FROM i))
SELECT task, o_orderkey, turn FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY CASE WHEN t = 0 THEN 99 ELSE t END, i) AS turn FROM p) WHERE turn <= least(n, 1 + task % 9)""")
def spread_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer's orders by date, one to nine, spread over all."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task"), "o_orderkey", "o_orderdate")
    quotas = orders.groupBy("task").agg(F.least(F.count("*"), 1 + F.first("task") % 9).alias("quota"))
    return D.spread_positions(orders, ["task"], [F.col("o_orderdate"), F.col("o_orderkey")], quotas).select("task", "o_orderkey", F.col("turn").cast("long").alias("turn"))


@add("f6_first_opportunities")
def first_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as opportunities of their status: text by customer and date, support by parts, dear ones first."""
    o = table(spark, sf_dir, "orders")
    turn = F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    rows = o.select("o_orderstatus", "o_orderkey", turn.alias("rank"), F.concat_ws("  ", F.lit("Why"), F.col("o_custkey").cast("string"), F.upper(F.col("o_orderpriority"))).alias("text"))
    support = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("member"))
    return D.first_opportunities(rows, support, "o_orderstatus", "o_orderkey", "rank", F.col("text")).select("o_orderstatus", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@add("g14_relation_violations", """WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, max(l_suppkey) AS src, max(l_partkey) AS dst, max(l_returnflag) AS kind, max(l_linestatus) AS resolution, max(CASE WHEN l_tax > 0.07 THEN ' ' ELSE 'p' END) AS provider, max(CASE WHEN l_discount > 0.09 THEN NULL ELSE 'o' END) AS operation, max(l_orderkey % 20) AS scenario FROM lineitem GROUP BY 1)
SELECT 'unknown_src' AS code, id FROM r WHERE src NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) UNION ALL SELECT 'unknown_dst', id FROM r WHERE dst NOT IN (SELECT p_partkey FROM part WHERE p_size < 49) UNION ALL SELECT 'bad_kind', id FROM r WHERE kind NOT IN ('A', 'R') UNION ALL SELECT 'bad_resolution', id FROM r WHERE resolution <> 'F'
UNION ALL SELECT 'no_provenance', id FROM r WHERE trim(provider) = '' OR operation IS NULL UNION ALL SELECT 'unknown_scenario', id FROM r WHERE scenario >= 19 UNION ALL SELECT 'duplicate_edge', id FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, kind ORDER BY id) AS k FROM r) WHERE k > 1""")
def relation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as relations of suppliers to parts."""
    items = table(spark, sf_dir, "lineitem")
    rows = items.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(
        F.max("l_suppkey").alias("src"), F.max("l_partkey").alias("dst"), F.max("l_returnflag").alias("kind"), F.max("l_linestatus").alias("resolution"), F.max(F.when(F.col("l_tax") > 0.07, " ").otherwise("p")).alias("provider"), F.max(F.when(F.col("l_discount") <= 0.09, "o")).alias("operation"), F.max(F.col("l_orderkey") % 20).alias("scenario")
    )
    nodes = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("node"))
    known = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 19).alias("scenario")).distinct()
    ends = [("src", nodes), ("dst", table(spark, sf_dir, "part").where("p_size < 49").select(F.col("p_partkey").alias("node")))]
    shift = rows.withColumn("dst", F.col("dst") + 1_000_000_000)
    every = ends[0][1].union(ends[1][1].select(F.col("node") + 1_000_000_000))
    return D.relation_violations(shift, every, ["A", "R"], ["F"], known)


VERBS = ["Check", "saveAll", "syncError", "fillHeader", "Commit", "ReadAll", "revalidate", "noop", "bolt", "store"]


@add("h13_callee_signals", f"""WITH c AS (SELECT l_orderkey, l_linenumber, max({VERBS}[l_partkey % 10 + 1] || CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'Ring' END) AS callee, max('pkg.Type.' || split_part(p_name, ' ', 2)) AS target FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
SELECT l_orderkey, l_linenumber, callee, CASE WHEN regexp_matches(lower(callee), 'check|validat') THEN 'validation_name' WHEN contains(lower(callee), 'error') THEN 'error_translation_name' WHEN lower(callee) = lower(split_part(target, '.', -1)) THEN 'delegation_name' WHEN regexp_matches(lower(callee), 'fill|header|enrich') THEN 'response_enrichment_name'
  WHEN regexp_matches(lower(callee), '^save|store|persist|commit') THEN 'persistence_name' WHEN regexp_matches(lower(callee), 'sync|flush|fsync|read|write') THEN 'io_name' END AS signal FROM c""")
def callee_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as calls of functions named by their part, from one named like the part."""
    met = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    verb = F.element_at(F.array(*map(F.lit, VERBS)), (F.col("l_partkey") % 10 + 1).cast("int"))
    calls = met.groupBy("l_orderkey", "l_linenumber").agg(F.max(F.concat(verb, F.when(F.col("l_suppkey") % 3 == 0, "").otherwise("Ring"))).alias("callee"), F.max(F.concat(F.lit("pkg.Type."), F.split_part("p_name", F.lit(" "), F.lit(2)))).alias("target"))
    return calls.select("l_orderkey", "l_linenumber", "callee", D.name_signal(F.col("callee"), F.col("target")).alias("signal"))


@add("h15_trace_round_trip", """WITH i AS (SELECT l_orderkey AS trace, l_linenumber::BIGINT AS id, max(l_partkey) AS score, max(l_quantity) AS q, max(l_returnflag) AS role FROM lineitem GROUP BY ALL)
SELECT o_orderkey AS trace, id, score, CASE WHEN o_orderkey % 50 <> 0 AND q > 20 THEN id END AS rank, CASE WHEN o_orderkey % 50 <> 0 AND q <= 20 THEN 'file_limit' END AS reason, role, o_orderkey % 50 <> 0 AS readable FROM orders JOIN i ON trace = o_orderkey WHERE o_orderkey % 50 <> 0
UNION ALL SELECT DISTINCT o_orderkey, NULL, NULL, NULL, NULL, NULL, false FROM orders JOIN i ON trace = o_orderkey WHERE o_orderkey % 50 = 0""")
def trace_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as saved traces, every fiftieth of them broken: written as JSON, read as rows, written and read again."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trace"), F.col("l_linenumber").cast("long").alias("id")).agg(F.max("l_partkey").alias("score"), F.max("l_quantity").alias("q"), F.array(F.max("l_returnflag")).alias("roles"))
    met = items.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trace")), "trace", "left_semi")
    rows = met.select("trace", F.lit("bug").alias("kind"), "id", F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), "score", "roles", F.when(F.col("q") > 20, F.col("id")).cast("int").alias("rank"), F.when(F.col("q") <= 20, "file_limit").alias("reason"), F.lit(True).alias("readable"))
    broken = D.trace_json(rows, "trace").withColumn("text", F.when(F.col("trace") % 50 == 0, F.lit("{not json")).otherwise(F.col("text")))
    once = D.trace_rows(broken, "trace", "text")
    again = D.trace_rows(D.trace_json(once, "trace"), "trace", "text").unionByName(once.where("not readable"))
    return again.select("trace", "id", "score", F.col("rank").cast("long").alias("rank"), "reason", F.get("roles", F.lit(0)).alias("role"), "readable")


@add("d3_import_tops", """WITH o AS (SELECT DISTINCT s_nationkey AS repo, l_suppkey AS module, l_orderkey AS importer, l_partkey % 300 AS name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey), w AS (SELECT repo, name, count(DISTINCT importer) AS importers FROM o GROUP BY ALL), m AS (SELECT repo, module, name, count(DISTINCT importer) AS importers FROM o GROUP BY ALL)
SELECT repo, NULL::BIGINT AS module, name, importers, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY importers DESC, name) AS rank FROM w) WHERE rank <= 50 UNION ALL SELECT repo, module, name, importers, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo, module ORDER BY importers DESC, name) AS rank FROM m) WHERE rank <= 10""")
def import_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    rows = met.select(F.col("s_nationkey").alias("repo"), F.col("l_suppkey").alias("module"), F.col("l_orderkey").alias("importer"), (F.col("l_partkey") % 300).alias("name"))
    return D.import_usage(rows, "repo", "module", "importer", "name").withColumn("rank", F.col("rank").cast("long"))


@add("d9_parent_credit", """WITH m AS (SELECT p_brand AS scope, p_partkey AS member, p_size > 30 AS prim, p_type <> 'PROMO' AS prod, p_partkey % 2 AS unit, p_partkey // 2 AS parent FROM part), c AS (SELECT DISTINCT l_partkey AS member FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45), o AS (SELECT m.*, member IN (SELECT member FROM c) AS cov FROM m),
k AS (SELECT scope, member FROM o WHERE cov AND prim UNION SELECT o.scope, p.member FROM o JOIN m p ON p.scope = o.scope AND p.member = o.parent AND p.unit = o.unit WHERE o.cov AND o.prod AND NOT o.prim AND p.prim AND p.prod)
SELECT scope, count(*) FILTER (prim) AS requested, (SELECT count(*) FROM k WHERE k.scope = o.scope) AS covered, count(*) FILTER (prim) - (SELECT count(*) FROM k WHERE k.scope = o.scope) AS uncovered, count(*) FILTER (cov AND NOT prim) AS supporting FROM o GROUP BY scope""")
def parent_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as members of their brand, half their number as parent; those much returned are covered."""
    part = table(spark, sf_dir, "part")
    members = part.select(F.col("p_brand").alias("scope"), F.col("p_partkey").alias("member"), (F.col("p_size") > 30).alias("primary"), (F.col("p_type") != "PROMO").alias("production"), (F.col("p_partkey") % 2).alias("unit"), F.floor(F.col("p_partkey") / 2).alias("parent"))
    met = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("member"))
    return D.coverage_counts(members, met.join(members.select("scope", "member"), "member").select("scope", "member"), "scope")


@add("k5_renamed_paths", f"""WITH {FILES}, a AS (SELECT repo, path, CASE WHEN part % 5 = 0 THEN 'old/' || path END AS f, size % 7 AS h FROM files WHERE size <> 1), b AS (SELECT repo, path, CASE WHEN part % 5 = 0 AND size % 2 = 0 THEN 'old/' || path WHEN part % 11 = 0 THEN 'new/' || path END AS f, CASE WHEN size = 20 THEN -1 ELSE size % 7 END AS h FROM files WHERE size <> 2),
d AS (SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.path, b.path) AS path, a.f AS x, b.f AS y FROM a FULL JOIN b ON a.repo = b.repo AND a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.f IS DISTINCT FROM b.f OR a.h <> b.h)
SELECT DISTINCT repo, path FROM (SELECT repo, unnest([path, x, y]) AS path FROM d) WHERE path IS NOT NULL""")
def renamed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    old = F.concat(F.lit("old/"), "path")
    a = f.where("size <> 1").select("repo", "path", F.when(F.col("part") % 5 == 0, old).alias("from_path"), (F.col("size") % 7).cast("string").alias("sha256"))
    came = F.when((F.col("part") % 5 == 0) & (F.col("size") % 2 == 0), old).when(F.col("part") % 11 == 0, F.concat(F.lit("new/"), "path"))
    b = f.where("size <> 2").select("repo", "path", came.alias("from_path"), F.when(F.col("size") == 20, "-1").otherwise((F.col("size") % 7).cast("string")).alias("sha256"))
    return D.changed_paths(a, b, ["repo"])


@add("j7_acceptance_matrix", """WITH r AS (SELECT o_orderkey AS run, o_custkey AS repository, o_orderdate AS created FROM orders), n AS (SELECT repository, max((created, run)) AS t FROM r GROUP BY 1), p AS (SELECT c_custkey AS repository, CASE WHEN c_custkey % 100 = 7 THEN (c_custkey // 100 % 3) * 11 WHEN n.t IS NOT NULL THEN (SELECT max(run) FROM r WHERE r.repository = c_custkey AND r.created = (SELECT max(created) FROM r x WHERE x.repository = c_custkey)) END AS run FROM customer LEFT JOIN n ON n.repository = c_custkey),
k AS (SELECT repository, CASE WHEN run IN (SELECT run FROM r) THEN run END AS run FROM p), s AS (SELECT l_orderkey AS run, l_linenumber::VARCHAR AS stage, min(CASE l_returnflag WHEN 'A' THEN 'failed' ELSE 'ok' END) AS state, count(*) AS calls, sum(l_quantity)::BIGINT AS latency, sum(l_partkey)::BIGINT AS bytes FROM lineitem GROUP BY ALL),
a AS (SELECT run, string_agg(stage || ':' || state, ',' ORDER BY stage) AS states, string_agg(CASE state WHEN 'failed' THEN stage || ':failed' END, ',' ORDER BY stage) AS bad, count(*) FILTER (stage = '1') AS one, count(*) FILTER (stage = '1' AND state = 'failed') AS lost, count(*) FILTER (state = 'failed') AS f, sum(calls)::BIGINT AS calls, sum(latency)::BIGINT AS latency, sum(bytes)::BIGINT AS bytes FROM s GROUP BY 1)
SELECT repository, k.run, CASE WHEN k.run IS NULL THEN 'MISSING' WHEN count(*) OVER (PARTITION BY k.run) > 1 THEN 'SHARED' WHEN coalesce(one, 0) = 0 OR lost > 0 THEN 'FAILED' WHEN f > 0 THEN 'DEGRADED' ELSE 'READY' END AS status,
  CASE WHEN k.run IS NULL THEN '' ELSE concat_ws(',', CASE WHEN coalesce(one, 0) = 0 THEN '1:absent' END, bad) END AS reasons, coalesce(states, '') AS states, coalesce(calls, 0) AS calls, coalesce(latency, 0) AS latency, coalesce(bytes, 0) AS bytes FROM k LEFT JOIN a ON a.run = k.run""")
def acceptance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as repositories, their orders as runs, items as stages; every hundredth asks for a run of its own choice."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("repository"), F.col("o_orderdate").alias("created"))
    asked = F.when(F.col("c_custkey") % 100 == 7, F.floor(F.col("c_custkey") / 100) % 3 * 11)
    repositories = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repository"), asked.alias("run"))
    stages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").cast("string").alias("stage"), F.when(F.col("l_returnflag") == "A", "failed").otherwise("ok").alias("state"), F.lit(1).alias("calls"), F.col("l_quantity").alias("latency_ms"), F.col("l_partkey").alias("request_bytes"))
    one = stages.groupBy("run", "stage").agg(F.min("state").alias("state"), F.sum("calls").alias("calls"), F.sum("latency_ms").alias("latency_ms"), F.sum("request_bytes").alias("request_bytes"))
    return D.acceptance_matrix(repositories, runs, one, ["1"])


@add("a12_atlas_tables", f"""WITH {FILES}, k AS (SELECT repo, part, path, size FROM files), u AS (SELECT DISTINCT repo FROM k WHERE repo <> 'Brand#3'), e AS (SELECT repo, CASE WHEN size % 2 = 0 THEN 'package' ELSE 'module' END AS kind, path FROM k), o AS (SELECT DISTINCT repo, CASE WHEN size % 2 = 0 OR part % 10 = 1 THEN 'package' ELSE 'module' END AS ek, path, l_returnflag AS kind, 'd' || l_linenumber AS detail, CASE WHEN l_tax > 0.03 THEN path END AS at_, l_suppkey AS line FROM lineitem JOIN k ON part = l_partkey WHERE l_quantity > 40),
m AS (SELECT o.*, e.path IS NOT NULL AND o.repo IN (SELECT repo FROM u) AS ok FROM o LEFT JOIN e ON e.repo = o.repo AND e.kind = ek AND e.path = o.path), i AS (SELECT *, sha256('entity' || chr(0) || repo || chr(0) || ek || chr(0) || path) AS parent FROM m WHERE ok), j AS (SELECT *, sha256('observation' || chr(0) || parent || chr(0) || kind || chr(0) || detail) AS oid FROM i)
SELECT 'unit' AS part, sha256('unit' || chr(0) || repo) AS id, NULL AS parent, 'repository' AS kind, repo AS name FROM u UNION ALL SELECT 'entity', sha256('entity' || chr(0) || repo || chr(0) || kind || chr(0) || path), sha256('unit' || chr(0) || repo), kind, path FROM e WHERE repo IN (SELECT repo FROM u)
UNION ALL SELECT DISTINCT 'observation', oid, parent, kind, detail FROM j UNION ALL SELECT DISTINCT 'evidence', sha256('evidence' || chr(0) || oid || chr(0) || at_ || chr(0) || line), oid, 'location', at_ || ':' || line FROM j WHERE at_ IS NOT NULL
UNION ALL SELECT 'unresolved_entity', NULL, NULL, kind, path FROM e WHERE repo NOT IN (SELECT repo FROM u) UNION ALL SELECT DISTINCT 'unresolved_observation', NULL, NULL, kind, path FROM m WHERE NOT ok""")
def atlas_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands but one as units, files as packages and modules, items as observations, some of the wrong kind."""
    own = files(spark, sf_dir)
    even = F.col("size") % 2 == 0
    units = own.where("repo <> 'Brand#3'").select(F.col("repo").alias("unit"), F.lit("repository").alias("kind"))
    entities = own.select(F.col("repo").alias("unit"), F.when(even, "package").otherwise("module").alias("kind"), F.col("path").alias("name"))
    met = table(spark, sf_dir, "lineitem").where("l_quantity > 40").join(own, F.col("l_partkey") == F.col("part"))
    seen = met.select(F.col("repo").alias("unit"), F.when(even | (F.col("part") % 10 == 1), "package").otherwise("module").alias("entity_kind"), F.col("path").alias("entity"), F.col("l_returnflag").alias("kind"), F.concat(F.lit("d"), F.col("l_linenumber").cast("string")).alias("detail"), F.when(F.col("l_tax") > 0.03, F.col("path")).alias("path"), F.col("l_suppkey").alias("line"))
    return D.atlas_tables(units, entities, seen)
