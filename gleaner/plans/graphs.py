"""Queries over joins, graphs, changes and evaluation facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import evaluation as V
from gleaner.operators import graph as G
from gleaner.operators import incremental as C
from gleaner.operators import joins as J
from gleaner.operators import sets as S
from gleaner.plans.bindings import EDGES, FILES, Registry, edges, files, table
from gleaner.plans.rows import PAIRS, part_sets
from gleaner.sources.listing import read_runs, source_catalog

registry = Registry()
add = registry.add
_SEEDS = "seeds AS (SELECT s_suppkey AS node FROM supplier WHERE s_acctbal > 9000)"
_REACH = f"{EDGES}, {_SEEDS}, walk(node, distance) AS (SELECT node, 0 FROM seeds UNION SELECT e.dst, w.distance + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.distance < 4), reach AS (SELECT node, min(distance) AS distance FROM walk GROUP BY node)"


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry nodes: suppliers of a high balance stand for process entries."""
    return table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_suppkey").alias("node"))


@add("a6_source_catalog", f"""WITH {FILES}, i AS (SELECT repo, path, CASE WHEN size % 9 = 0 THEN NULL ELSE sha256(path) END AS sha256 FROM files WHERE size < 40 UNION ALL SELECT repo, path, 'x' FROM files WHERE size = 7),
h AS (SELECT repo, path, count(*) AS n, max(sha256) AS sha256 FROM i GROUP BY ALL)
SELECT f.repo, f.path, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' WHEN sha256 IS NULL THEN 'unhashed' ELSE 'authorised' END AS status FROM files f LEFT JOIN h USING (repo, path)""")
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    inputs = rows.where("size < 40").select("repo", "path", F.when(F.col("size") % 9 != 0, F.sha2("path", 256)).alias("sha256")).union(rows.where("size = 7").select("repo", "path", F.lit("x")))
    return source_catalog(rows, inputs, ["repo"]).select("repo", "path", "status")


@add("a8_run_facts", "SELECT c_custkey, n, CASE WHEN n IS NULL THEN 'FAILED' ELSE 'PRESENT' END AS state FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey")
def run_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return read_runs(table(spark, sf_dir, "customer"), runs, ["c_custkey"], ["n"])


@add("a12_atlas", f"""WITH {FILES} SELECT 'unit' AS kind, sha256('unit' || chr(0) || repo) AS id, repo AS name FROM (SELECT DISTINCT repo FROM files) UNION ALL SELECT 'entity', sha256('entity' || chr(0) || repo || chr(0) || path), path FROM files""")
def atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units and entities in one table with stable ids."""
    from gleaner.functions.text import digest_of

    rows = files(spark, sf_dir)
    units = rows.select("repo").distinct().select(F.lit("unit").alias("kind"), digest_of(F.lit("unit"), F.col("repo")).alias("id"), F.col("repo").alias("name"))
    return units.unionByName(rows.select(F.lit("entity").alias("kind"), digest_of(F.lit("entity"), F.col("repo"), F.col("path")).alias("id"), F.col("path").alias("name")))


@add("c1_closed_edges", "WITH n AS (SELECT p_partkey AS id FROM part WHERE p_type <> 'SMALL' UNION ALL SELECT p_partkey FROM part WHERE p_size = 50), o AS (SELECT id FROM n GROUP BY 1 HAVING count(*) = 1) SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey IN (SELECT id FROM o) AND l_partkey IN (SELECT id FROM o)")
def closed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    nodes = part.where("p_type <> 'SMALL'").select("id").union(part.where("p_size = 50").select("id"))
    return J.closed_edges(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")), nodes, "src", "dst", "id")


@add("c2_internal_external", "SELECT l_returnflag, l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'SMALL') AS internal, count(*) AS n FROM lineitem GROUP BY ALL")
def internal_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = J.split_known(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey"), table(spark, sf_dir, "part").where("p_type = 'SMALL'"), "l_partkey", "p_partkey")
    return found.groupBy("l_returnflag", "internal").agg(F.count("*").alias("n"))


@add("c3_module_ownership", "SELECT c_custkey, coalesce(c_acctbal > 2000 OR n_regionkey = 1, false) AS consistent FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def module_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return J.owned(table(spark, sf_dir, "customer"), nation, ["c_nationkey"], (F.col("c_acctbal") > 2000) | (F.col("n_regionkey") == 1)).select("c_custkey", "consistent")


@add("c4_file_openable", "SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') AS openable FROM orders")
def file_openable(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.exists_flag(table(spark, sf_dir, "orders").select("o_orderkey"), known, ["o_orderkey"])


@add("c6_authorise_selection", """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem), w AS (SELECT l_orderkey FROM a GROUP BY 1 HAVING bool_and(l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 45)))
SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 100000000 + l_partkey) AS position FROM a WHERE l_orderkey IN (SELECT l_orderkey FROM w)""")
def authorise_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_linenumber") * F.lit(100_000_000).cast("long") + F.col("l_partkey")).alias("ord"))
    allowed = table(spark, sf_dir, "part").where("p_size < 45").select(F.col("p_partkey").alias("l_partkey"))
    return J.authorise(rows, allowed, "l_orderkey", ["l_partkey"], "ord").select("l_orderkey", "l_partkey", "position")


@add("c12_descriptor_binding", """WITH b AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN s END AS supplier FROM orders LEFT JOIN b ON l_orderkey = o_orderkey""")
def descriptor_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    bindings = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return J.attach_unique(table(spark, sf_dir, "orders").select("o_orderkey"), bindings, ["o_orderkey"], "l_suppkey", "supplier")


@add("c11_seed_match", """SELECT l_orderkey, l_linenumber, rule FROM lineitem JOIN (SELECT n_nationkey AS rule, n_regionkey FROM nation) r ON l_partkey % 25 = rule WHERE l_quantity >= rule AND (n_regionkey <> 2 OR l_discount = 0.05) GROUP BY ALL""")
def seed_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items against rules that agree on a key and whose least count and option hold."""
    rules = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("rule"), F.col("n_nationkey").cast("long").alias("key"), "n_regionkey")
    rows = table(spark, sf_dir, "lineitem").withColumn("key", F.col("l_partkey") % 25).withColumn("site", F.struct("l_orderkey", "l_linenumber"))
    found = J.match_rules(rows, rules, ["key"], (F.col("l_quantity") >= F.col("key")) & ((F.col("n_regionkey") != 2) | (F.col("l_discount") == 0.05)), "site", "rule")
    return found.select("site.l_orderkey", "site.l_linenumber", "rule")


@add("c14_witness_pairs", "SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS witnesses FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem WHERE l_returnflag = 'R') a JOIN (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem WHERE l_returnflag = 'A') b USING (l_orderkey) GROUP BY ALL")
def witness_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    side = lambda flag, name: items.where(F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias(name), "l_orderkey")
    return J.pair_overlaps(side("R", "a"), side("A", "b"), ["l_orderkey"], "a", "b")


@add("c19_lift_edges", """SELECT s_nationkey AS from_group, c_nationkey AS to_group, count(*) AS witnesses FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY ALL""")
def lift_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    edge = met.groupBy(F.col("l_suppkey").alias("src"), (F.col("o_custkey") + 1_000_000_000).alias("dst")).agg(F.count("*").alias("n"))
    member = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("m"), F.col("s_nationkey").alias("g")).union(table(spark, sf_dir, "customer").select(F.col("c_custkey") + 1_000_000_000, "c_nationkey"))
    return J.lift_edges(edge, member, "src", "dst", "m", "g", "n")


@add("c24_tiered_owner", """WITH t AS (SELECT l_orderkey AS id, 0 AS tier, l_suppkey % 7 AS o FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1 UNION SELECT o_orderkey, 1, o_custkey % 5 FROM orders WHERE o_orderstatus <> 'P'), f AS (SELECT id, min(tier) AS tier FROM t GROUP BY 1)
SELECT x.o_orderkey AS id, f.tier, array_to_string(list_sort(list(DISTINCT t.o)), ',') AS owners, count(DISTINCT t.o) AS n FROM orders x LEFT JOIN f ON f.id = x.o_orderkey LEFT JOIN t ON t.id = f.id AND t.tier = f.tier GROUP BY ALL""")
def tiered_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderstatus")
    one = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_linenumber = 1").select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 7).alias("o"))
    found = J.tiered_owner(o, "id", [one, o.where("o_orderstatus <> 'P'").select("id", (F.col("o_custkey") % 5).alias("o"))], "o")
    return found.select("id", "tier", F.array_join(F.col("owners").cast("array<string>"), ",").alias("owners"), F.col("n").cast("long").alias("n"))


@add("c26_membership_apply", """WITH p AS (SELECT DISTINCT l_suppkey % 9 AS grp, l_orderkey AS member FROM lineitem WHERE l_linenumber = 1), q AS (SELECT *, count(*) OVER (PARTITION BY member) AS n FROM p), k AS (SELECT o_orderkey AS member FROM orders WHERE o_orderstatus <> 'P')
SELECT coalesce(q.member, k.member) AS member, grp, CASE WHEN k.member IS NULL THEN 'unknown' WHEN grp IS NULL THEN 'unassigned' WHEN n > 1 THEN 'duplicate' ELSE 'accepted' END AS outcome FROM q FULL JOIN k ON q.member = k.member""")
def membership_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposed = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select((F.col("l_suppkey") % 9).alias("grp"), F.col("l_orderkey").alias("member"))
    return J.apply_membership(proposed, table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("member")), "grp", "member")


@add("c27_either_key", """SELECT DISTINCT a.s_suppkey AS a, b.c_custkey AS b FROM supplier a JOIN customer b ON a.s_nationkey = b.c_nationkey AND floor(a.s_acctbal / 100) = floor(b.c_acctbal / 100) UNION SELECT a.s_suppkey, b.c_custkey FROM supplier a JOIN customer b ON a.s_suppkey = b.c_custkey""")
def either_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 100).alias("balance"), F.col("s_suppkey").alias("num"))
    right = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("b"), F.col("c_nationkey").alias("nation"), F.floor(F.col("c_acctbal") / 100).alias("balance"), F.col("c_custkey").alias("num"))
    return J.either(left, right, [["nation", "balance"], ["num"]], "a", "b")


@add("c25_text_overlay", r"""WITH n AS (SELECT item_id AS k, CASE WHEN item_id % 4 = 0 THEN text || ' {name}' WHEN item_id % 4 = 1 THEN repeat(text, 3) ELSE upper(text) END AS t FROM benchmark WHERE item_id % 5 <> 2 UNION ALL SELECT 100000, 'x')
SELECT coalesce(b.item_id, n.k) AS item_id, CASE WHEN b.item_id IS NULL THEN 'unknown' WHEN n.k IS NULL THEN 'missing' WHEN octet_length(encode(n.t)) > 500 THEN 'too_large' WHEN contains(n.t, '{name}') THEN 'placeholder_mismatch' ELSE '' END AS reason FROM benchmark b FULL JOIN n ON n.k = b.item_id""")
def text_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "benchmark").select("item_id", "text")
    text = F.when(F.col("item_id") % 4 == 0, F.concat("text", F.lit(" {name}"))).when(F.col("item_id") % 4 == 1, F.repeat("text", F.lit(3))).otherwise(F.upper("text"))
    new = old.where("item_id % 5 <> 2").select("item_id", text.alias("text")).union(spark.createDataFrame([(100000, "x")], "item_id long, text string"))
    return J.overlay(old, new, "item_id", "text", 500).select("item_id", "reason")


@add("g1_outgoing_closure", f"WITH RECURSIVE {EDGES}, {_SEEDS}, walk(node) AS (SELECT node FROM seeds UNION SELECT e.dst FROM walk w JOIN edges e ON e.src = w.node) SELECT node FROM walk")
def outgoing_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.closure(S.settle(edges(spark, sf_dir)), seeds(spark, sf_dir))


@add("g3_bounded_distances", f"WITH RECURSIVE {_REACH} SELECT node, distance FROM reach")
def bounded_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.distances(S.settle(edges(spark, sf_dir)), seeds(spark, sf_dir), 4)


@add("g5_shortest_predecessors", f"""WITH RECURSIVE {_REACH}, tight AS (SELECT DISTINCT e.src, e.dst, d.distance FROM edges e JOIN reach s ON s.node = e.src JOIN reach d ON d.node = e.dst WHERE d.distance = s.distance + 1),
back(src, dst, distance) AS (SELECT src, dst, distance FROM tight WHERE dst IN (SELECT p_partkey + 1000000000 FROM part WHERE p_size = 50) UNION SELECT t.src, t.dst, t.distance FROM back b JOIN tight t ON t.dst = b.src) SELECT src, dst, distance FROM back""")
def shortest_predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = S.settle(edges(spark, sf_dir))
    targets = table(spark, sf_dir, "part").where("p_size = 50").select((F.col("p_partkey") + 1_000_000_000).alias("node"))
    return G.shortest_predecessors(graph, seeds(spark, sf_dir), targets, 4)


@add("g9_adjacent", f"WITH {EDGES}, {_SEEDS} SELECT DISTINCT src AS node, 'out' AS direction, dst AS other FROM edges WHERE src IN (SELECT node FROM seeds) UNION SELECT dst, 'in', src FROM edges WHERE dst IN (SELECT node FROM seeds)")
def adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbours(edges(spark, sf_dir), seeds(spark, sf_dir))


@add("g7_entry_expansion", f"""WITH RECURSIVE {EDGES}, {_SEEDS}, kept AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS k FROM edges) WHERE k <= 4),
walk(node, distance) AS (SELECT node, 0 FROM seeds UNION SELECT e.dst, w.distance + 1 FROM walk w JOIN kept e ON e.src = w.node WHERE w.distance < 3) SELECT node, min(distance) AS distance FROM walk GROUP BY node""")
def entry_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.expand(edges(spark, sf_dir), seeds(spark, sf_dir), 3, 4, "n")


@add("g11_nearest_owner", """WITH RECURSIVE p AS (SELECT p_partkey AS node, CASE WHEN p_partkey = 0 THEN NULL ELSE p_partkey // 3 END AS parent, p_type = 'SMALL' AS owns FROM part), up(node, cur, k) AS (SELECT node, node, 0 FROM p UNION ALL SELECT up.node, p.parent, k + 1 FROM up JOIN p ON p.node = up.cur WHERE p.parent IS NOT NULL AND NOT p.owns)
SELECT p.node, o.cur AS owner FROM p LEFT JOIN (SELECT node, arg_min(cur, k) AS cur FROM up WHERE cur IN (SELECT node FROM p WHERE owns) GROUP BY 1) o ON o.node = p.node""")
def nearest_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), "p_type")
    parents = part.select("node", F.when(F.col("node") != 0, F.floor(F.col("node") / 3)).alias("parent"))
    return G.top_of_chain(parents, part.where("p_type = 'SMALL'"))


@add("g14_graph_validation", f"""WITH {EDGES}, n AS (SELECT s_suppkey AS node, CASE WHEN s_acctbal < 0 THEN 'odd' ELSE 'supplier' END AS kind FROM supplier UNION ALL SELECT p_partkey + 1000000000, p_type FROM part WHERE p_size > 2 UNION ALL SELECT p_partkey + 1000000000, p_type FROM part WHERE p_size = 50)
SELECT 'duplicate_node' AS code, node AS id FROM n GROUP BY node HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'unknown_kind', node FROM n WHERE kind NOT IN ('supplier', 'SMALL', 'ECONOMY')
UNION ALL SELECT DISTINCT 'unknown_src', src FROM edges WHERE src NOT IN (SELECT node FROM n) UNION ALL SELECT DISTINCT 'unknown_dst', dst FROM edges WHERE dst NOT IN (SELECT node FROM n)""")
def graph_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1_000_000_000).alias("node"), F.col("p_type").alias("kind"), "p_size")
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.when(F.col("s_acctbal") < 0, "odd").otherwise("supplier").alias("kind"))
    nodes = nodes.union(part.where("p_size > 2").drop("p_size")).union(part.where("p_size = 50").drop("p_size"))
    return G.invalid(nodes, edges(spark, sf_dir), ["supplier", "SMALL", "ECONOMY"])


@add("f6_support_overlap", f"WITH {PAIRS} SELECT flag, a, b, shared FROM pairs")
def support_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with like support sets: orders by their parts."""
    return S.overlaps(part_sets(spark, sf_dir), ["flag"], "id", "member", 0.75).select("flag", "a", "b", "shared")


@add("f6_keep_first", f"""WITH RECURSIVE {PAIRS}, d AS (SELECT flag, a AS id FROM pairs UNION SELECT flag, b FROM pairs), r AS (SELECT flag, id, row_number() OVER (PARTITION BY flag ORDER BY id) AS k FROM d),
walk(flag, k, kept) AS (SELECT flag, 0, CAST([] AS BIGINT[]) FROM (SELECT DISTINCT flag FROM r) UNION ALL
  SELECT w.flag, w.k + 1, CASE WHEN EXISTS (SELECT 1 FROM pairs p WHERE p.flag = w.flag AND p.b = r.id AND list_contains(w.kept, p.a)) THEN kept ELSE list_append(kept, r.id) END FROM walk w JOIN r ON r.flag = w.flag AND r.k = w.k + 1)
SELECT flag, unnest(kept) AS id FROM (SELECT flag, arg_max(kept, k) AS kept FROM walk GROUP BY 1) UNION ALL SELECT flag, id FROM (SELECT DISTINCT flag, id FROM m) WHERE (flag, id) NOT IN (SELECT (flag, id) FROM d)""")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = part_sets(spark, sf_dir)
    rows = sets.select("flag", "id").distinct()
    pairs = S.overlaps(sets, ["flag"], "id", "member", 0.75)
    return S.keep_first(rows.withColumn("rank", F.col("id")), pairs, "id", "rank").select("flag", "id")


@add("k4_context_diff", """WITH s AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW'), c AS (SELECT o_orderkey, CASE WHEN o_custkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_totalprice < 400000)
SELECT coalesce(s.o_orderkey, c.o_orderkey) AS o_orderkey, CASE WHEN s.o_orderkey IS NULL THEN 'new' WHEN c.o_orderkey IS NULL THEN 'missing' WHEN s.o_orderstatus IS NOT DISTINCT FROM c.o_orderstatus AND s.o_orderpriority IS NOT DISTINCT FROM c.o_orderpriority THEN 'same' ELSE 'changed' END AS status,
  CASE WHEN s.o_orderkey IS NULL OR c.o_orderkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN s.o_orderstatus IS DISTINCT FROM c.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN s.o_orderpriority IS DISTINCT FROM c.o_orderpriority THEN 'o_orderpriority' END) END AS reasons FROM s FULL JOIN c ON s.o_orderkey = c.o_orderkey""")
def context_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved and current snapshots: orders of some priority, and orders below a price with some fields changed."""
    o = table(spark, sf_dir, "orders")
    now = o.where("o_totalprice < 400000").withColumn("o_orderstatus", F.when(F.col("o_custkey") % 6 == 0, "X").otherwise(F.col("o_orderstatus"))).withColumn("o_orderpriority", F.when(F.col("o_custkey") % 4 != 0, F.col("o_orderpriority")))
    return C.context_diff(o.where("o_orderpriority <> '5-LOW'"), now, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@add("k5_dirty_paths", f"WITH {FILES} SELECT repo, path, 'saved' AS side FROM files WHERE size = 2 UNION ALL SELECT repo, path, 'current' FROM files WHERE size = 1")
def dirty_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return C.symmetric_difference(f.where("size <> 1"), f.where("size <> 2"), ["repo", "path"])


@add("k6_input_freshness", """WITH c AS (SELECT o_custkey % 40 AS scope, o_orderkey % 400 AS owner, o_orderkey AS path, o_orderstatus AS h FROM orders), n AS (SELECT o_orderkey AS path, CASE WHEN o_orderkey % 97 = 0 THEN 'Z' ELSE o_orderstatus END AS h FROM orders WHERE o_orderkey % 89 > 0),
f AS (SELECT scope, owner, count(*) AS n, count(*) FILTER (n.h IS NULL) AS gone, count(*) FILTER (c.h IS DISTINCT FROM n.h) AS affected FROM c LEFT JOIN n USING (path) GROUP BY ALL), m AS (SELECT *, sum(affected) OVER (PARTITION BY scope) AS moved FROM f)
SELECT scope, owner, CASE WHEN affected = 0 AND moved > 0 THEN 'unrelated' WHEN affected = 0 THEN 'fresh' WHEN gone = n THEN 'unavailable' ELSE 'partially_stale' END AS status, affected FROM m""")
def input_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    captured = o.select((F.col("o_custkey") % 40).alias("scope"), (F.col("o_orderkey") % 400).alias("owner"), F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("h"))
    now = o.where("o_orderkey % 89 > 0").select(F.col("o_orderkey").alias("path"), F.when(F.col("o_orderkey") % 97 == 0, "Z").otherwise(F.col("o_orderstatus")).alias("h"))
    return C.input_freshness(captured, now, ["scope", "owner"], "path", "h", ["scope"])


@add("k7_index_invalidation", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 50))")
def index_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cites = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("path"))
    changed = table(spark, sf_dir, "part").where("p_size = 50").select(F.col("p_partkey").alias("path"))
    return C.invalidate(table(spark, sf_dir, "orders").select("o_orderkey"), cites, changed, "o_orderkey", "path")


@add("k8_layered_invalidation", "SELECT c_custkey, CASE WHEN c_nationkey % 9 = 0 THEN 'repository' WHEN c_custkey % 5 = 0 THEN 'facts' WHEN c_acctbal < 0 THEN 'claims' ELSE 'none' END AS layer FROM customer")
def layered_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    side = lambda e: c.select("c_custkey", F.expr(e).alias("changed"))
    return C.layered(side("c_nationkey % 9 = 0"), side("c_custkey % 5 = 0"), side("c_acctbal < 0"), "c_custkey")


@add("k9_result_cache", "SELECT e.event_id, c.v IS NOT NULL AS hit, c.v AS cached FROM events e LEFT JOIN (SELECT user_id, event_type, max(event_id) AS v FROM events WHERE value > 10 GROUP BY ALL) c USING (user_id, event_type)")
def result_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.functions.text import digest_of

    e = table(spark, sf_dir, "events")
    key = digest_of(F.col("user_id").cast("string"), F.col("event_type"))
    cache = e.where("value > 10").groupBy(key.alias("fingerprint")).agg(F.max("event_id").alias("v"))
    return C.cache_lookup(e, cache, ["user_id", "event_type"], "v").select("event_id", "hit", "cached")


@add("k3_budget_gate", """WITH w AS (SELECT *, event_id % 97 AS z FROM events), r AS (SELECT event_id, count(*) OVER u AS c, sum(z) OVER s AS st, sum(z) OVER u AS t FROM w WINDOW u AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), s AS (PARTITION BY user_id, event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, CASE WHEN c > 50 THEN 'calls' WHEN st > 600 THEN 'stage_bytes' WHEN t > 2000 THEN 'total_bytes' ELSE '' END AS reason FROM r""")
def budget_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("z", F.col("event_id") % 97)
    return C.budget_gate(e, ["user_id"], ["event_id"], "z", 50, 600, 2000, "event_type").select("event_id", "reason")


@add("k10_no_progress", """WITH i AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS i FROM events), r AS (SELECT user_id, i, count(*) AS n FROM i WHERE event_type <> 'purchase' GROUP BY ALL)
SELECT user_id, coalesce(max(n), 0) AS streak, coalesce(max(n), 0) >= 12 AS stalled FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN r USING (user_id) GROUP BY 1""")
def no_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("progress", F.col("event_type") == "purchase")
    return C.stalled(e, ["user_id"], ["event_id"], "progress", 12)


@add("d5_graph_summary", "SELECT l_returnflag AS certainty, count(*) AS n FROM lineitem GROUP BY 1")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("certainty")).agg(F.count("*").alias("n"))


@add("d3_import_usage", "SELECT l_partkey, count(DISTINCT l_suppkey) AS importers FROM lineitem GROUP BY 1 ORDER BY importers DESC, l_partkey LIMIT 50")
def import_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("importers")).orderBy(F.desc("importers"), "l_partkey").limit(50)


@add("d9_coverage_counts", """WITH q AS (SELECT DISTINCT o_custkey, o_orderkey FROM orders), h AS (SELECT l_orderkey, bool_or(l_returnflag = 'A') AS p FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT o_custkey, count(*) AS requested, count(p) AS covered, count(*) FILTER (p) AS "primary", count(*) FILTER (NOT p) AS supporting, count(*) - count(p) AS uncovered FROM q LEFT JOIN h ON l_orderkey = o_orderkey GROUP BY 1""")
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    role = F.when(F.col("l_returnflag") == "A", "primary").otherwise("supporting").alias("role")
    held = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "o_orderkey", role)
    return V.coverage(o, held, ["o_custkey"], "o_orderkey", "role")


@add("d12_concentration", """WITH p AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT l_orderkey, CAST(sum(n) AS BIGINT) AS total, count(*) AS f FROM p GROUP BY 1)
SELECT l_orderkey, l_returnflag, n, total FROM p JOIN t USING (l_orderkey) WHERE n * 2 > total AND n >= 2 AND f >= 2""")
def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of whose items one flag dominates."""
    return V.concentration(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag")


@add("d14_usage_rollup", """SELECT user_id, event_type, count(*) AS calls, CAST(sum(event_id % 100) AS BIGINT) AS bytes, max(CASE WHEN event_id % 5 > 0 THEN event_id % 1000 END) AS max_latency, count(*) FILTER (event_id % 5 = 0) AS unknown_latency FROM events GROUP BY ROLLUP (user_id, event_type)""")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("bytes", F.col("event_id") % 100).withColumn("latency", F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 1000))
    return V.usage_rollup(e, ["user_id", "event_type"], "bytes", "latency")


@add("d15_scorecard", """WITH t AS (SELECT count(*) AS total, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 0) AS clean FROM labels)
SELECT 'good' AS "check", good AS passed, total, CAST(300 AS BIGINT) AS target, good >= 300 AS ok FROM t UNION ALL SELECT 'clean', clean, total, CAST(390 AS BIGINT), clean >= 390 FROM t""")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.scorecard(table(spark, sf_dir, "labels"), {"good": (F.col("quality") == 1, 300), "clean": (F.col("toxic") == 0, 390)})


@add("d16_weighted_checks", "SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') AS passed, count(*) AS total, CAST(sum(CASE WHEN l_returnflag <> 'R' THEN l_linenumber ELSE 0 END) AS BIGINT) AS score, CAST(sum(l_linenumber) AS BIGINT) AS max_score FROM lineitem GROUP BY 1")
def weighted_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.weighted_score(table(spark, sf_dir, "lineitem").withColumn("ok", F.col("l_returnflag") != "R"), ["l_orderkey"], "ok", "l_linenumber")


@add("d20_loss_ledger", """SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') THEN 'kept' WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N') THEN 'dropped'
  WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 'before_ranking' ELSE 'never_generated' END AS disposition FROM orders""")
def loss_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return V.loss_ledger(table(spark, sf_dir, "orders"), ["o_orderkey"], items, items.where("l_returnflag = 'N'"), items.where("l_returnflag = 'A'"))


@add("d22_api_counts", "SELECT p_brand, count(*) FILTER (p_type = 'ECONOMY') AS ECONOMY, count(*) FILTER (p_type = 'SMALL') AS SMALL, count(*) FILTER (p_type = 'LARGE') AS LARGE FROM part WHERE p_type IN ('ECONOMY', 'SMALL', 'LARGE') GROUP BY 1")
def api_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["ECONOMY", "SMALL", "LARGE"]
    return table(spark, sf_dir, "part").where(F.col("p_type").isin(kinds)).groupBy("p_brand").pivot("p_type", kinds).agg(F.count("p_partkey")).na.fill(0)


@add("d26_status_fold", """SELECT o_custkey, CAST(sum(o_orderkey % 10) AS BIGINT) AS units, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) ELSE 'partial' END AS status FROM orders GROUP BY 1""")
def status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.status_fold(table(spark, sf_dir, "orders").withColumn("units", F.col("o_orderkey") % 10), ["o_custkey"], "o_orderstatus", "units")


@add("j6_version_regression", """WITH s AS (SELECT user_id, event_type, count(*) FILTER (event_id % 2 = 0) AS before, count(*) FILTER (event_id % 2 = 1) AS after FROM events GROUP BY ALL)
SELECT user_id, event_type, before, after, CASE WHEN before >= 3 AND after < before THEN 'regression' WHEN after > before THEN 'improved' WHEN after = before THEN 'same' ELSE 'lower' END AS verdict FROM s WHERE before > 0 AND after > 0""")
def version_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "events").groupBy("user_id", "event_type", F.when(F.col("event_id") % 2 == 0, "v1").otherwise("v2").alias("version")).agg(F.count("*").alias("score"))
    return V.regressions(scores, ["user_id", "event_type"], "version", "v1", "v2", "score", 3)


@add("j11_slot_proofs", """SELECT o_custkey, count(*) FILTER (EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')) AS proven, count(*) AS required, CASE WHEN count(*) FILTER (EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')) = count(*) THEN 'complete'
  WHEN count(*) FILTER (EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')) > 0 THEN 'partial' ELSE 'open' END AS status FROM orders GROUP BY 1""".replace("EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')", "o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"))
def slot_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    proofs = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return V.required_slots(o, proofs, ["o_custkey"], "o_orderkey")


@add("b17_readiness", """WITH u AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'purchase') AS p FROM events GROUP BY 1)
SELECT user_id, CASE WHEN e > 20 OR n < 30 THEN 'FAILED' WHEN p < 10 THEN 'DEGRADED' ELSE 'READY' END AS state, CASE WHEN e > 20 OR n < 30 THEN concat_ws(',', CASE WHEN e > 20 THEN 'errors' END, CASE WHEN n < 30 THEN 'short' END) WHEN p < 10 THEN 'few_purchases' ELSE '' END AS reasons FROM u""")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda kind: F.count(F.when(F.col("event_type") == kind, 1))
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), n("error").alias("e"), n("purchase").alias("p"))
    return V.readiness(u, ["user_id"], {"errors": F.col("e") > 20, "short": F.col("n") < 30}, {"few_purchases": F.col("p") < 10})


@add("e13_best_candidate", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc(F.col("o_orderstatus") == "F"), F.desc("o_totalprice"), F.col("o_orderkey")]
    return V.best_candidate(table(spark, sf_dir, "orders"), ["o_custkey"], order, ["o_orderkey"])
