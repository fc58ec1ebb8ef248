"""Queries over matches against catalogs and references in prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import matching as M
from gleaner.plans.bindings import Registry, files, table

registry = Registry()
add = registry.add


@add("c11_seed_lattice", """WITH sites AS (SELECT l_orderkey * 10 + l_linenumber AS site, max(p_brand) AS package, max(p_type) AS receiver, max(split_part(p_name, ' ', 2)) AS name, max(split_part(p_name, ' ', 1)) AS word, max(l_linenumber) AS n, bool_or(l_returnflag = 'R') AS variadic FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
seeds AS (SELECT p_partkey AS seed, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS package, CASE WHEN p_partkey % 4 > 0 THEN p_type END AS receiver, CASE WHEN p_partkey % 5 > 0 THEN split_part(p_name, ' ', 2) END AS name, p_partkey % 4 AS least, CASE p_partkey % 7 WHEN 0 THEN true WHEN 1 THEN false END AS variadic, p_size FROM part WHERE p_size > 40),
fit AS (SELECT s.*, seed, e.variadic AS v, p_size, rank() OVER (PARTITION BY site ORDER BY (e.package IS NOT NULL)::INT + (e.receiver IS NOT NULL)::INT + (e.name IS NOT NULL)::INT DESC, e.package IS NULL, e.receiver IS NULL, e.name IS NULL, least DESC, e.variadic IS NULL) AS best
  FROM sites s JOIN seeds e ON (e.package IS NULL OR e.package = s.package) AND (e.receiver IS NULL OR e.receiver = s.receiver) AND (e.name IS NULL OR e.name = s.name) AND (e.package IS NOT NULL OR e.receiver IS NOT NULL OR e.name IS NOT NULL) AND n % 4 >= least AND (e.variadic IS NULL OR e.variadic = s.variadic)),
one AS (SELECT site, count(*) AS k, min(seed) AS seed, min(receiver) AS receiver, min(word) AS word, min(n) AS n, list_sort(list(seed))[:8] AS ids, min(p_size) AS size FROM fit WHERE best = 1 GROUP BY 1)
SELECT site, CASE k WHEN 1 THEN 'matched' ELSE 'ambiguous' END AS status, CASE k WHEN 1 THEN seed END AS seed, CASE WHEN k > 1 THEN array_to_string(ids, ',') END AS candidates, CASE k WHEN 1 THEN CASE WHEN n % 4 > 1 THEN 'arg1' ELSE 'none' END || '/' || receiver || '/' || receiver || '.f' || '/' || size END AS fields FROM one""")
def seed_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as call sites of their part's brand, type and name; large parts as seeds that leave keys open by their number."""
    part = table(spark, sf_dir, "part")
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    items = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    sites = items.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("site")).agg(
        F.max("p_brand").alias("package"), F.max("p_type").alias("receiver"), F.max(noun).alias("name"), F.max("l_linenumber").alias("n"), F.bool_or(F.col("l_returnflag") == "R").alias("variadic")
    )
    names = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.concat(F.lit("arg"), k.cast("string")))
    sites = sites.withColumn("args", F.slice(names, 1, F.col("n") % 4))
    open_ = lambda k, c: F.when(F.col("p_partkey") % k > 0, c)
    from_ = lambda source, index=None, value=None, default=None, field=None: F.struct(F.lit(source).alias("source"), F.lit(index).cast("int").alias("index"), (value if isinstance(value, Column) else F.lit(value).cast("string")).alias("value"), F.lit(default).cast("string").alias("default"), F.lit(field).cast("string").alias("field"))
    fields = F.create_map(F.lit("a"), from_("argument", 1, default="none"), F.lit("b"), from_("receiver"), F.lit("c"), from_("receiver_field", field="f"), F.lit("d"), from_("constant", value=F.col("p_size").cast("string")))
    seeds = part.where("p_size > 40").select(
        F.col("p_partkey").alias("seed"), open_(3, F.col("p_brand")).alias("package"), open_(4, F.col("p_type")).alias("receiver"), open_(5, noun).alias("name"), (F.col("p_partkey") % 4).alias("min_args"),
        F.when(F.col("p_partkey") % 7 == 0, True).when(F.col("p_partkey") % 7 == 1, False).alias("variadic"), fields.alias("projections"),
    )
    out = M.seed_matches(sites, seeds)
    shown = F.when(F.col("fields").isNotNull(), F.concat_ws("/", *(F.element_at("fields", k) for k in "abcd")))
    return out.select("site", "status", "seed", F.when(F.col("candidates").isNotNull(), F.array_join(F.col("candidates").cast("array<string>"), ",")).alias("candidates"), shown.alias("fields"))


@add("c12_attached_chains", """WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS row, l_returnflag AS flag, min({'exact': l_discount > 0.03, 'to_id': l_orderkey, 'other': CASE WHEN l_discount > 0.03 THEN NULL ELSE l_orderkey + l_linenumber END}) AS f FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY ALL),
e AS (SELECT f.to_id AS id, flag, row FROM r WHERE f.exact), n AS (SELECT id, count(*) FILTER (flag = 'R') AS b, count(*) FILTER (flag = 'A') AS a, min(row) FILTER (flag = 'R') AS binding, min(row) FILTER (flag = 'A') AS activation FROM e GROUP BY 1),
c AS (SELECT id, flag, row, row_number() OVER (PARTITION BY id ORDER BY flag, row) AS k, count(*) OVER (PARTITION BY id) AS n FROM (SELECT *, count(*) OVER (PARTITION BY id, flag) AS n FROM e) WHERE n > 1),
v AS (SELECT DISTINCT flag, row, unnest([f.to_id, f.other]) AS id FROM r WHERE NOT f.exact)
SELECT o_orderkey AS id, 'chain' AS kind, coalesce(CASE WHEN b = 1 THEN binding::VARCHAR END, '-') || '/' || coalesce(CASE WHEN a = 1 THEN activation::VARCHAR END, '-') || '/' || CASE WHEN b = 1 AND a = 1 THEN 'complete' ELSE concat_ws(',', CASE WHEN coalesce(b, 0) = 0 THEN 'no_binding' WHEN b > 1 THEN 'binding_ambiguous' END, CASE WHEN coalesce(a, 0) = 0 THEN 'no_activation' WHEN a > 1 THEN 'activation_ambiguous' END) END AS detail FROM orders LEFT JOIN n ON id = o_orderkey
UNION ALL SELECT id, CASE flag WHEN 'A' THEN 'activation_ambiguous' ELSE 'binding_ambiguous' END, row::VARCHAR FROM c WHERE k <= 3 AND id IN (SELECT o_orderkey FROM orders) UNION ALL SELECT DISTINCT id, 'evidence_limit', (n - 3)::VARCHAR FROM c WHERE n > 3 AND id IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT id, CASE flag WHEN 'A' THEN 'activation_candidate' ELSE 'binding_candidate' END, row::VARCHAR FROM v WHERE id IN (SELECT o_orderkey FROM orders)""")
def attached_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as descriptors; returned items as bindings, accepted ones as activations, exact from a discount on."""
    exact = F.col("l_discount") > 0.03
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), exact.alias("exact"), F.col("l_orderkey").alias("to_id"), F.array(F.when(~exact, F.col("l_orderkey") + F.col("l_linenumber"))).alias("candidate_ids"))
    side = lambda flag: items.where(F.col("l_returnflag") == flag).drop("l_returnflag")
    chains, frontiers = M.attached_chains(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), side("R"), side("A"), 3)
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return chains.select("id", F.lit("chain").alias("kind"), F.concat_ws("/", dash("binding"), dash("activation"), "status").alias("detail")).union(frontiers)


def prose(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(texts, paths): orders' items told in prose, by their parts' files; the files, and some of their folders.

    Paths of every third part hold a blank; of every seventh have no extension; lines and text beside them vary.
    """
    own = files(spark, sf_dir).select("part", F.when(F.col("part") % 3 == 0, F.replace("path", F.lit("_"), F.lit(" "))).when(F.col("part") % 7 == 0, F.regexp_replace("path", r"\.[a-z.]+$", "")).otherwise(F.col("path")).alias("path"))
    items = table(spark, sf_dir, "lineitem").join(own, F.col("l_partkey") == F.col("part"))
    line = F.col("l_linenumber").cast("string")
    forms = [("see ", F.concat(F.lit(":"), line, F.lit(","))), ("(", F.lit(")")), ("./", F.lit(" is not it;")), ("as ", F.concat(F.lit(" line "), line, F.lit(" has it."))), ("", F.concat(F.lit(" shows it at line "), line, F.lit("."))), ("at ", F.concat(F.lit("#"), line)), ("in ", F.lit("x:3")), ("and ", F.concat(F.lit(":"), line, F.lit("b")))]
    said = F.coalesce(*(F.when((F.col("l_partkey") + F.col("l_orderkey")) % len(forms) == k, F.concat(F.lit(lead), F.col("path"), tail)) for k, (lead, tail) in enumerate(forms)))
    told = items.select(F.col("l_orderkey").alias("statement"), F.struct("l_linenumber", "l_partkey", said.alias("said")).alias("s"))
    texts = told.groupBy("statement").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["said"]), " ").alias("text"))
    return texts, own.select("path").union(own.select(F.regexp_replace("path", "/[^/]*$", "")).distinct())


@add("c15_prose_references")
def prose_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, paths = prose(spark, sf_dir)
    return M.references(texts, paths, "statement", "text").select("statement", "path", "line", F.col("position").cast("long").alias("position"))


@add("c16_canonical_statements")
def canonical_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines up to four are known."""
    texts, paths = prose(spark, sf_dir)
    known = paths.select("path", F.explode(F.array(*(F.lit(k) for k in range(1, 5)))).alias("line"))
    return M.canonical_statements(texts, paths, known, "statement", "text")
