"""Queries over ranked rows, ranges, sets and checks of the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import intervals as I
from gleaner.operators import quality as Q
from gleaner.operators import ranking as R
from gleaner.operators import sets as S
from gleaner.plans.bindings import Registry, table

registry = Registry()
add = registry.add
DAY = "date_diff('day', DATE '1990-01-01', CAST({} AS DATE))"


def day(col: str) -> F.Column:
    return F.datediff(col, F.lit("1990-01-01")).cast("long")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cust, id, start, end): each order as a range of days."""
    o = table(spark, sf_dir, "orders")
    start = day("o_orderdate")
    return o.select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("id"), start.alias("start"), (start + F.col("o_orderkey") % 40).alias("end"))


SPANS = f"spans AS (SELECT o_custkey AS cust, o_orderkey AS id, {DAY.format('o_orderdate')} AS s, {DAY.format('o_orderdate')} + o_orderkey % 40 AS e FROM orders)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cust, at): ship days of each customer's items."""
    met = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.select(F.col("o_custkey").alias("cust"), day("l_shipdate").alias("at")).distinct()


POINTS = f"points AS (SELECT DISTINCT o_custkey AS cust, {DAY.format('l_shipdate')} AS at_ FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@add("e10_top_k", "SELECT c_nationkey, c_custkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 20")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(table(spark, sf_dir, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 20).select("c_nationkey", "c_custkey", "rank")


@add("k1_omission_ledger", """WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer)
SELECT c_nationkey, count(*) AS eligible, least(count(*), 20) AS selected, count(*) - least(count(*), 20) AS omitted, CASE WHEN count(*) > 20 THEN 'max_per_group' ELSE 'none' END AS cutoff,
  coalesce(string_agg(CASE WHEN k BETWEEN 21 AND 23 THEN CAST(c_custkey AS VARCHAR) END, ',' ORDER BY k), '') AS omitted_sample FROM r GROUP BY 1""")
def omission_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.omission_ledger(table(spark, sf_dir, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 20, "c_custkey")


@add("e11_kind_diverse", """WITH t AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) <= 1 AS f FROM customer), p AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY f DESC, c_custkey) AS position FROM t)
SELECT c_nationkey, c_custkey, f AS first_of_kind, position FROM p WHERE position <= 8""")
def kind_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.diverse_first(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment", [F.col("c_custkey")], 8).select("c_nationkey", "c_custkey", "first_of_kind", "position")


@add("e4_round_robin", "WITH t AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS turn FROM customer) SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY turn, c_mktsegment, c_custkey) AS position FROM t")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.interleave(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment", F.lit(0), F.col("c_mktsegment"), [F.col("c_custkey")]).select("c_custkey", "position")


@add("e16_budget_prefix", "SELECT o_custkey, o_orderkey FROM (SELECT *, sum(o_orderkey % 1000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS r FROM orders) WHERE r <= 2500")
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("size", F.col("o_orderkey") % 1000)
    return R.budget_prefix(o, ["o_custkey"], [F.col("o_orderkey")], "size", 2500).select("o_custkey", "o_orderkey")


@add("e17_largest_fit", """WITH r AS (SELECT o_custkey, sum(o_orderkey % 1000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS r FROM orders)
SELECT o_custkey, count(*) FILTER (r <= 2500) AS k, coalesce(max(r) FILTER (r <= 2500), 0) AS bytes FROM r GROUP BY 1""")
def largest_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("size", F.col("o_orderkey") % 1000)
    return R.largest_fit(o, ["o_custkey"], [F.col("o_orderkey")], "size", 2500)


@add("e15_greedy_batches", """WITH RECURSIVE o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderkey % 1000 AS z, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
b AS (SELECT c, k, i, 1 AS batch, 1 AS n, z AS t FROM o WHERE i = 1 UNION ALL
  SELECT o.c, o.k, o.i, CASE WHEN b.n + 1 > 4 OR b.t + o.z > 1500 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.n + 1 > 4 OR b.t + o.z > 1500 THEN 1 ELSE b.n + 1 END, CASE WHEN b.n + 1 > 4 OR b.t + o.z > 1500 THEN o.z ELSE b.t + o.z END
  FROM b JOIN o ON o.c = b.c AND o.i = b.i + 1) SELECT c AS o_custkey, k AS o_orderkey, batch FROM b""")
def greedy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 1000).alias("size"))
    return R.greedy_batches(o, ["o_custkey"], ["o_orderkey"], "size", 4, 1500).select("o_custkey", "o_orderkey", "batch")


@add("e14_spread_quota", """WITH g AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), s AS (SELECT c_nationkey, c_mktsegment, n, unnest(range(0, least(n, 10))) AS k FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY k / CAST(n AS DOUBLE), c_mktsegment) AS p FROM s) SELECT c_nationkey, c_mktsegment, count(*) AS quota FROM r WHERE p <= 10 GROUP BY ALL""")
def spread_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return R.spread_quota(groups, ["c_nationkey"], "c_mktsegment", "n", 10)


@add("e18_unique_winner", """WITH t AS (SELECT c_custkey AS k, o_orderkey % 4 AS tier, o_orderkey % 3 AS c FROM orders JOIN customer ON o_custkey = c_custkey), g AS (SELECT k, tier, count(DISTINCT c) AS n, min(c) AS c FROM t GROUP BY ALL),
w AS (SELECT k, arg_min(c, tier) FILTER (n = 1) AS c, min(tier) FILTER (n = 1) AS s, min(tier) FILTER (n > 1 AND tier < 2) AS m FROM g GROUP BY k)
SELECT k, CASE WHEN m IS NOT NULL AND (s IS NULL OR m < s) THEN 'ambiguous' WHEN s IS NOT NULL THEN 'resolved' ELSE 'unresolved' END AS status, CASE WHEN s IS NOT NULL AND (m IS NULL OR m > s) THEN c END AS winner FROM w""")
def unique_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = met.select(F.col("c_custkey").alias("k"), (F.col("o_orderkey") % 4).alias("tier"), (F.col("o_orderkey") % 3).alias("c"))
    return R.unique_winner(rows, ["k"], "tier", "c")


@add("f3_merge_intervals", f"""WITH {SPANS}, a AS (SELECT *, max(e) OVER (PARTITION BY cust ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM spans), b AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY cust ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM a)
SELECT cust, min(s) AS start, max(e) AS "end", count(*) AS parts FROM b GROUP BY cust, i""")
def merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merge(spans(spark, sf_dir), ["cust"], "start", "end")


@add("f4_clusters", f"""WITH {POINTS}, a AS (SELECT *, CASE WHEN at_ - lag(at_) OVER (PARTITION BY cust ORDER BY at_) <= 10 THEN 0 ELSE 1 END AS n FROM points), b AS (SELECT *, sum(n) OVER (PARTITION BY cust ORDER BY at_) AS i FROM a)
SELECT cust, min(at_) AS "first", max(at_) AS "last", count(*) AS points, max(at_ % 7) AS strongest FROM b GROUP BY cust, i""")
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.clusters(points(spark, sf_dir), ["cust"], "at", 10, F.max(F.col("at") % 7).alias("strongest"))


@add("f5_line_runs", f"""WITH {POINTS}, a AS (SELECT cust, at_, at_ - row_number() OVER (PARTITION BY cust ORDER BY at_) AS i FROM points) SELECT cust, min(at_) AS "first", max(at_) AS "last" FROM a GROUP BY cust, i""")
def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.runs(points(spark, sf_dir), ["cust"], "at")


@add("c7_range_resolve", f"""WITH {SPANS}, {POINTS}, p AS (SELECT *, cust * 100000 + at_ AS pid FROM points), h AS (SELECT pid, CASE WHEN at_ = s THEN 0 ELSE 1 END AS tier, id FROM p JOIN spans USING (cust) WHERE at_ BETWEEN s AND e),
g AS (SELECT pid, tier, count(DISTINCT id) AS n, min(id) AS id FROM h GROUP BY ALL), b AS (SELECT pid, arg_min(n, tier) AS n, arg_min(id, tier) AS id FROM g GROUP BY pid)
SELECT pid, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN id END AS id FROM p LEFT JOIN b USING (pid)""")
def range_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points(spark, sf_dir).withColumn("pid", F.col("cust") * 100_000 + F.col("at"))
    return I.resolve(own, spans(spark, sf_dir), "pid", ["cust"], "at", "start", "end", "id")


@add("c8_narrowest_interval", f"WITH {SPANS}, {POINTS} SELECT cust, at_ AS at, arg_min(id, (e - s) * 10000000 + id) AS id FROM points JOIN spans USING (cust) WHERE at_ BETWEEN s AND e GROUP BY cust, at_")
def narrowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.narrowest(points(spark, sf_dir), spans(spark, sf_dir), ["cust"], "at", "start", "end", "id")


@add("c9_uncovered_points", f"WITH {SPANS}, {POINTS} SELECT cust, at_ AS at FROM points p WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.cust = p.cust AND p.at_ BETWEEN s.s AND s.e)")
def uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.uncovered(points(spark, sf_dir), spans(spark, sf_dir), ["cust"], "at", "start", "end")


@add("f1_set_difference", """WITH l AS (SELECT o_custkey, o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM l)
SELECT o_custkey, count(*) AS missing, array_to_string(list_sort(list(CAST(o_orderkey AS VARCHAR)) FILTER (k <= 5)), ',') AS sample FROM r GROUP BY 1""")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.difference(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), chosen, ["o_orderkey"], ["o_custkey"], "o_orderkey")


@add("f2_union_distinct", "SELECT user_id, string_agg(event_type, ',' ORDER BY p) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS p FROM events GROUP BY ALL) GROUP BY 1")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.union_distinct(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type", "kinds")
    return found.withColumn("kinds", F.array_join("kinds", ","))


def part_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(flag, id, member): parts of each order, as support sets of candidates."""
    met = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.select(F.col("o_orderstatus").alias("flag"), F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("member")).distinct()


PAIRS = """m AS (SELECT DISTINCT o_orderstatus AS flag, l_orderkey AS id, l_partkey AS member FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
z AS (SELECT flag, id, count(*) AS n FROM m GROUP BY ALL), j AS (SELECT a.flag, a.id AS a, b.id AS b, count(*) AS shared FROM m a JOIN m b ON a.flag = b.flag AND a.member = b.member AND a.id < b.id GROUP BY ALL),
pairs AS (SELECT j.flag, a, b, shared, shared / CAST(x.n + y.n - shared AS DOUBLE) AS jaccard FROM j JOIN z x ON x.flag = j.flag AND x.id = a JOIN z y ON y.flag = j.flag AND y.id = b WHERE shared / CAST(x.n + y.n - shared AS DOUBLE) >= 0.75)"""


@add("f8_fold_equal", """WITH s AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS k, min(o_orderkey) AS r FROM orders GROUP BY 1), c AS (SELECT c_nationkey, c_custkey, array_to_string(k, ',') AS k, r FROM customer JOIN s ON o_custkey = c_custkey)
SELECT c_custkey, first_value(c_custkey) OVER (PARTITION BY c_nationkey, k ORDER BY r, c_custkey) AS first_id FROM c""")
def fold_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("k"), F.min("o_orderkey").alias("r"))
    rows = table(spark, sf_dir, "customer").join(own, "c_custkey")
    return S.fold_equal(rows, ["c_nationkey"], "c_custkey", "r", F.col("k")).select("c_custkey", "first_id")


@add("f9_better_in_place", "SELECT l_orderkey, l_suppkey % 5 AS ref, min(l_linenumber) AS l_linenumber, arg_min(l_partkey, l_returnflag || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || lpad(CAST(l_partkey AS VARCHAR), 12, '0')) AS l_partkey FROM lineitem GROUP BY ALL")
def better_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("ref", F.col("l_suppkey") % 5)
    return S.better_in_place(rows, ["l_orderkey", "ref"], "l_linenumber", "l_returnflag", "l_partkey")


@add("f10_merge_fields", """SELECT user_id, arg_min(event_type, event_id) FILTER (event_type <> 'error') AS kind, arg_min(props, event_id) AS props, min(value) AS value FROM (SELECT * FROM events) GROUP BY 1""")
def merge_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("kind", F.when(F.col("event_type") != "error", F.col("event_type")).otherwise(""))
    return S.merge_fields(rows, ["user_id"], "event_id", ["kind", "props"], ["value"])


@add("d17_relation_merge", "SELECT l_suppkey, l_partkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags, arg_min(l_orderkey, l_orderkey * 10 + l_linenumber) AS l_orderkey FROM lineitem GROUP BY ALL")
def relation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.merge_best(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey"], ["l_orderkey", "l_linenumber"], ["l_orderkey"], "l_returnflag")
    return found.select("l_suppkey", "l_partkey", F.array_join("l_returnflag", ",").alias("flags"), "l_orderkey")


@add("f11_tiered_anti", """SELECT o_orderkey FROM orders o WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM orders k WHERE k.o_orderstatus = 'F' AND k.o_custkey % 3 = 0 AND o.o_custkey % 3 = 0 AND k.o_custkey = o.o_custkey)
  AND NOT EXISTS (SELECT 1 FROM orders k WHERE k.o_orderstatus = 'F' AND k.o_totalprice = o.o_totalprice AND k.o_orderdate = o.o_orderdate)""")
def tiered_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("ctor", F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey")))
    return S.tiered_anti(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'"), [["ctor"], ["o_totalprice", "o_orderdate"]]).select("o_orderkey")


@add("i1_row_rules", """SELECT o_orderkey, unnest(list_filter([CASE WHEN NOT coalesce(o_totalprice < 490000, false) THEN 'price' END, CASE WHEN NOT coalesce(o_orderstatus IN ('O', 'F'), false) THEN 'status' END], lambda x: x IS NOT NULL)) AS code FROM orders""")
def row_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.violations(table(spark, sf_dir, "orders"), ["o_orderkey"], {"price": F.col("o_totalprice") < 490_000, "status": F.col("o_orderstatus").isin("O", "F")})


@add("i2_referential_integrity", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')")
def referential_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.orphans(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'"), [("l_orderkey", "o_orderkey")]).select("l_orderkey", "l_linenumber")


@add("i3_key_conflicts", "SELECT l_orderkey, l_partkey, count(*) AS copies, count(DISTINCT l_returnflag || l_linestatus) AS versions, CASE WHEN count(DISTINCT l_returnflag || l_linestatus) > 1 THEN 'conflict' ELSE 'duplicate' END AS status FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def key_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.key_conflicts(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus"), ["l_orderkey", "l_partkey"])


@add("i4_bounds_preflight", "SELECT doc_id FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING count(*) <= 50 AND sum(octet_length(encode(text))) <= 120000)")
def bounds_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.within_bounds(table(spark, sf_dir, "documents"), ["source"], 50, 120_000, "text").select("doc_id")


@add("i5_run_gate", """SELECT user_id, len(f) = 0 AS passed, array_to_string(f, ',') AS failures FROM (SELECT user_id, list_filter([CASE WHEN count(*) < 90 THEN 'too_few' END, CASE WHEN count(*) FILTER (event_type = 'error') > 25 THEN 'errors' END, CASE WHEN count(*) FILTER (event_type = 'signup') = 0 THEN 'no_signup' END], lambda x: x IS NOT NULL) AS f FROM events GROUP BY 1)""")
def run_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda kind: F.count(F.when(F.col("event_type") == kind, 1))
    facts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), n("error").alias("errors"), n("signup").alias("signups"))
    return Q.gate(facts, ["user_id"], {"too_few": F.col("n") >= 90, "errors": F.col("errors") <= 25, "no_signup": F.col("signups") > 0})
