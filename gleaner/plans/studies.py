"""Queries over labels of counted facts, authorised evidence, bounded selection and walks from entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import labels as L
from gleaner.operators import evidence as E
from gleaner.operators import graph as G
from gleaner.operators import joins as J
from gleaner.operators import ranking as R
from gleaner.operators import selection as X
from gleaner.operators import sets as S
from gleaner.plans.bindings import EDGES, FILES, Registry, calls, choice_sql, edges, files, table

registry = Registry()
add = registry.add

KINDS = [k for of in L.PILLARS for k in of] + ["process_entry", "helper"]
_KIND = f"({KINDS})[l_partkey % {len(KINDS)} + 1]"
_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, kind, live, l_suppkey, l_quantity): items as anchors of a kind; those not returned are reachable."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("l_partkey") % len(KINDS) + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", kind.alias("kind"), (F.col("l_returnflag") != "R").alias("live"), "l_suppkey", "l_quantity")


def _pillars(of: str) -> str:
    return " + ".join(f"CAST(list_has_any({of}, {_LIST(p)}) AS INT)" for p in L.PILLARS)


_DIR = "regexp_replace(path, '/[^/]*$', '')"


@add("b5_entry_kind", f"""WITH {FILES}, d AS (SELECT path, {_DIR} AS dir, split_part(path, '/', 1) AS module FROM files)
SELECT path, CASE WHEN module = 'server' OR dir = 'server' THEN 'primary_binary' WHEN contains(lower(dir), 'ctl') THEN 'cli' WHEN starts_with(lower(dir), 'tools/') OR lower(dir) = 'tools' OR starts_with(module, 'tools/') THEN 'tool'
  WHEN starts_with(lower(dir) || '/', 'contrib/') OR contains(lower(dir), 'example') THEN 'example' WHEN starts_with(lower(dir) || '/', 'tests/') OR contains(lower(dir), '/test-template/') THEN 'test_binary' ELSE 'unknown' END AS kind,
  CASE WHEN module = 'server' THEN 'server_runtime' WHEN contains(module, 'client') THEN 'client_library' WHEN module = 'api' THEN 'api_definitions' WHEN module = 'tests' THEN 'tests' WHEN starts_with(module, 'tools') THEN 'tools' WHEN module = 'pkg' THEN 'shared_library' WHEN module = '.' THEN 'repository_root' ELSE 'unknown' END AS role FROM d""")
def entry_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    package, module = F.regexp_replace("path", "/[^/]*$", ""), F.split("path", "/")[0]
    return files(spark, sf_dir).select("path", L.entry_kind(package, module).alias("kind"), L.module_role(module).alias("role"))


@add("b7_locality", """WITH t AS (SELECT conv_id, count(*) AS anchors, count(*) FILTER (length(text) >= 80) AS strong, count(*) FILTER (role = 'assistant') AS relations, bool_or(regexp_matches(lower(text), '(^|[^a-z0-9])(config|nil|panic|dependency|documentation|the)([^a-z0-9]|$)')) AS cue, bool_or(role = 'system') AS grounded FROM conversations GROUP BY 1),
k AS (SELECT *, (['extension', 'configuration', 'compatibility', 'defect', 'other'])[conv_id % 5 + 1] AS kind FROM t)
SELECT conv_id, CASE WHEN anchors = 0 THEN 'broad_dynamic' WHEN kind = 'extension' THEN 'extension' WHEN kind IN ('configuration', 'compatibility') AND grounded THEN 'local_exact' WHEN strong >= 1 AND anchors <= 8 AND cue THEN 'local_exact' WHEN anchors >= 3 AND (strong >= 1 OR relations > 0) THEN 'bounded_cross_file' ELSE 'broad_dynamic' END AS locality FROM k""")
def locality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as tasks, their turns as anchors."""
    low = F.lower("text")
    facts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("anchors"),
        F.count_if(F.length("text") >= 80).alias("strong"),
        F.count_if(F.col("role") == "assistant").alias("relations"),
        F.bool_or(low.rlike("(^|[^a-z0-9])(config|nil|panic|dependency|documentation|the)([^a-z0-9]|$)")).alias("cue"),
        F.bool_or(F.col("role") == "system").alias("grounded"),
    )
    kind = F.element_at(F.array(*map(F.lit, ["extension", "configuration", "compatibility", "defect", "other"])), (F.col("conv_id") % 5 + 1).cast("int"))
    return facts.select("conv_id", L.locality(kind, *map(F.col, ("anchors", "strong", "relations", "cue", "grounded"))).alias("locality"))


@add("b13_grounding_mode", f"""WITH k AS (SELECT l_orderkey, list(DISTINCT {_KIND}) AS kinds, coalesce(list(DISTINCT {_KIND}) FILTER (l_returnflag <> 'R'), []) AS live FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN list_contains(kinds, 'process_entry') AND {_pillars('live')} >= 4 THEN 'behavior_grounded' WHEN list_contains(kinds, 'process_entry') AND {_pillars('kinds')} >= 2 THEN 'mixed' ELSE 'package_landscape' END AS mode FROM k""")
def grounding_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = kinds(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_set("kind").alias("kinds"), F.collect_set(F.when(F.col("live"), F.col("kind"))).alias("live"))
    return own.select("l_orderkey", L.grounding_mode(F.col("kinds"), F.col("live")).alias("mode"))


@add("b18_confidence_cap", """WITH f AS (SELECT o_orderkey, least(o_totalprice / 500000, 1) AS c, o_orderpriority = '1-URGENT' AND coalesce(bool_and(l_returnflag <> 'A'), true) AS execution, o_orderstatus = 'F' AND coalesce(bool_and(l_returnflag <> 'N'), true) AS entrypoint,
  o_orderstatus = 'F' AND count(l_orderkey) < 3 AS dispatch, o_orderstatus = 'F' AND count(l_orderkey) >= 3 AND max(l_quantity) < 40 AS core_call, o_custkey % 7 = 0 AS context FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice, o_orderpriority, o_orderstatus, o_custkey),
g AS (SELECT *, least(1.0, CASE WHEN execution OR entrypoint OR dispatch THEN 0.3 ELSE 1.0 END, CASE WHEN core_call THEN 0.5 ELSE 1.0 END, CASE WHEN context THEN 0.6 ELSE 1.0 END) AS cap, concat_ws(',', CASE WHEN execution THEN 'execution' END, CASE WHEN entrypoint THEN 'entrypoint' END, CASE WHEN dispatch THEN 'dispatch' END, CASE WHEN core_call THEN 'core_call' END, CASE WHEN context THEN 'context' END) AS missing FROM f)
SELECT o_orderkey, CAST(least(c, cap) AS DOUBLE) AS confidence, CAST(cap AS DOUBLE) AS cap, missing, CASE WHEN missing = '' THEN 'verified' ELSE 'partial' END AS status, c > cap AS capped FROM g""")
def confidence_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidate flows, their items as the evidence for them."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    met = o.join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy(*o.columns).agg(
        F.count("l_orderkey").alias("n"), F.max("l_quantity").alias("q"), *(F.coalesce(F.bool_or(F.col("l_returnflag") == f), F.lit(False)).alias(f"has_{f}") for f in "AN")
    )
    cli = F.col("o_orderstatus") == "F"
    missing = {
        "execution": (F.col("o_orderpriority") == "1-URGENT") & ~F.col("has_A"),
        "entrypoint": cli & ~F.col("has_N"),
        "dispatch": cli & (F.col("n") < 3),
        "core_call": cli & (F.col("n") >= 3) & (F.col("q") < 40),
        "context": F.col("o_custkey") % 7 == 0,
    }
    made = L.capped_confidence(F.least(F.col("o_totalprice") / 500000, F.lit(1.0)), missing)
    return met.withColumn("m", made).select("o_orderkey", "m.confidence", "m.cap", F.array_join("m.missing", ",").alias("missing"), "m.status", "m.capped")


@add("b19_primary_score", """SELECT l_orderkey, least(count(*), 6) + CASE WHEN max(l_quantity) > 45 THEN 8 ELSE 0 END + 3 * least(count(DISTINCT l_suppkey % 4), 3) + CASE WHEN bool_or(l_returnflag = 'R') AND bool_or(l_returnflag = 'A') THEN 5 ELSE 0 END + least(count(DISTINCT l_partkey), 4) AS score FROM lineitem GROUP BY 1""")
def primary_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("steps"), (F.max("l_quantity") > 45).alias("purpose"), F.countDistinct(F.col("l_suppkey") % 4).alias("areas"), (F.bool_or(F.col("l_returnflag") == "R") & F.bool_or(F.col("l_returnflag") == "A")).alias("effect"), F.countDistinct("l_partkey").alias("files")
    )
    return facts.select("l_orderkey", L.primary_score(*map(F.col, ("steps", "purpose", "areas", "effect", "files"))).alias("score"))


@add("b20_archetype", f"""WITH k AS (SELECT l_orderkey, list(DISTINCT {_KIND}) AS kinds, count(*) FILTER ({_KIND} = 'process_entry') AS entries, bool_and(l_returnflag <> 'N') AS aux, max(l_quantity) > 48 AS library, count(*) FILTER (l_discount = 0) AS workers, count(*) FILTER (l_tax = 0) AS tasks FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN aux AND library THEN 'library_framework' WHEN list_has_any(kinds, ['registry_write', 'extension_family']) AND list_has_any(kinds, ['request_dispatch_root', 'admin_control_plane']) THEN 'modular_platform_server' WHEN workers > 0 OR tasks > 1 THEN 'daemon_worker_system'
  WHEN list_contains(kinds, 'command_dispatch') AND NOT list_contains(kinds, 'request_dispatch_root') THEN 'cli_tool' WHEN entries = 0 THEN 'library_framework' WHEN entries > 3 THEN 'monorepo_mixed' ELSE 'application' END AS archetype FROM k""")
def archetype(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("l_partkey") % len(KINDS) + 1).cast("int"))
    facts = items.groupBy("l_orderkey").agg(
        F.collect_set(kind).alias("kinds"), F.count_if(kind == "process_entry").alias("entries"), F.bool_and(F.col("l_returnflag") != "N").alias("aux"), (F.max("l_quantity") > 48).alias("library"), F.count_if(F.col("l_discount") == 0).alias("workers"), F.count_if(F.col("l_tax") == 0).alias("tasks")
    )
    made = L.archetype(*map(F.col, ("kinds", "entries", "aux", "library", "workers", "tasks")))
    return facts.select("l_orderkey", made["archetype"].alias("archetype"))


@add("h6_match_score", f"""WITH {FILES}, s AS (SELECT path, CASE WHEN part % 3 = 0 THEN 'func ' || replace(path, '/', ' ') WHEN part % 3 = 1 THEN '// ' || path ELSE path END AS line, split_part(split_part(path, '/', 2), '_', 1) AS term, part % 12 AS hits, part % 10 = 1 AS test FROM files)
SELECT path, 40 - (length(path) - length(replace(path, '/', ''))) * 4 + CASE WHEN contains(lower(path), term) THEN 40 ELSE 0 END + CASE WHEN test THEN 2 ELSE 0 END + least(hits, 8) * 3
  + CASE WHEN regexp_matches(trim(line), '^(func|type|var|const) ') AND list_contains(string_split_regex(lower(trim(line)), '[^a-z0-9_]+'), term) THEN 24 ELSE 0 END - CASE WHEN starts_with(trim(line), '//') OR starts_with(trim(line), '#') THEN 4 ELSE 0 END AS score FROM s""")
def match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("part") % 3 == 0, F.concat(F.lit("func "), F.replace("path", F.lit("/"), F.lit(" ")))).when(F.col("part") % 3 == 1, F.concat(F.lit("// "), "path")).otherwise(F.col("path"))
    term = F.split(F.split("path", "/")[1], "_")[0]
    return files(spark, sf_dir).select("path", L.line_match_score(F.col("path"), line, term, F.col("part") % 12, F.col("part") % 10 == 1).alias("score"))


@add("h7_range_score", """WITH w AS (SELECT DISTINCT conv_id, unnest(string_split(lower(text), ' ')) AS term FROM conversations WHERE turn = 0), t AS (SELECT * FROM (SELECT conv_id, term, length(term) AS weight, row_number() OVER (PARTITION BY conv_id ORDER BY length(term) DESC, term) AS k FROM w) WHERE k <= 6),
r AS (SELECT DISTINCT c.conv_id, c.turn // 2 AS block, t.term, t.weight FROM conversations c JOIN t ON t.conv_id = c.conv_id AND contains(lower(c.text), t.term)) SELECT conv_id, block, CAST(sum(weight) AS BIGINT) AS score, string_agg(term, ',' ORDER BY term) AS hits FROM r GROUP BY ALL""")
def range_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of two turns as line ranges, scored by the six longest words of the conversation's first turn."""
    turns = table(spark, sf_dir, "conversations")
    words = turns.where("turn = 0").select("conv_id", F.explode(F.split(F.lower("text"), " ")).alias("term")).distinct()
    terms = R.top_k(words.withColumn("weight", F.length("term")), ["conv_id"], [F.desc("weight"), F.col("term")], 6)
    lines = turns.select("conv_id", F.floor(F.col("turn") / 2).cast("long").alias("block"), F.lower("text").alias("text"))
    hits = lines.join(terms, "conv_id").where(F.contains("text", F.col("term"))).select("conv_id", "block", "term", "weight").distinct()
    return hits.groupBy("conv_id", "block").agg(F.sum("weight").alias("score"), F.array_join(F.array_sort(F.collect_list("term")), ",").alias("hits"))


@add("h9_operational_kind", f"""WITH {FILES}, o AS (SELECT path, CASE part % 8 WHEN 0 THEN 'README.md' WHEN 1 THEN regexp_replace(path, '[^/]+$', 'Makefile') WHEN 2 THEN regexp_replace(path, '[^/]+$', 'package.json') WHEN 3 THEN regexp_replace(path, '[^/]+$', '.env.example') WHEN 4 THEN regexp_replace(path, '[^/]+$', 'Taskfile.yml') ELSE path END AS p,
  'see http://localhost:' || size || '/' || repo || ' and /var/log/' || replace(repo, '#', '_') || '.log with ${{HOME}} or <name> ' || path AS text FROM files)
SELECT path, CASE WHEN NOT contains(p, '/') AND lower(p) = 'readme.md' THEN 'markdown' WHEN ends_with(lower(p), '/makefile') THEN 'makefile' WHEN ends_with(p, '/package.json') THEN 'package_json' WHEN ends_with(p, '/.env.example') THEN 'environment' WHEN ends_with(lower(p), '/taskfile.yml') THEN 'taskfile' END AS kind,
  regexp_extract(text, 'http://localhost:[0-9]+/[^ ]*') AS endpoints, regexp_extract(text, '/var/log/[^ ]*\\.log') AS logs, '${{HOME}},<name>' AS placeholders FROM o""")
def operational_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files under operational names, with a line of text that names an endpoint, a log and placeholders."""
    named = F.when(F.col("part") % 8 == 0, "README.md")
    for k, name in enumerate(("Makefile", "package.json", ".env.example", "Taskfile.yml"), 1):
        named = named.when(F.col("part") % 8 == k, F.regexp_replace("path", "[^/]+$", name))
    text = F.concat(F.lit("see http://localhost:"), F.col("size").cast("string"), F.lit("/"), "repo", F.lit(" and /var/log/"), F.replace("repo", F.lit("#"), F.lit("_")), F.lit(".log with ${HOME} or <name> "), "path")
    of = lambda pattern: F.array_join(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), ",")
    return files(spark, sf_dir).select("path", L.operational_kind(named.otherwise(F.col("path"))).alias("kind"), of(L.ENDPOINT).alias("endpoints"), of(L.LOG_PATH).alias("logs"), of(L.PLACEHOLDER).alias("placeholders"))


@add("c5_entry_authorisation", """WITH p AS (SELECT p_partkey, min(p_brand) AS brand FROM part GROUP BY 1), e AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL HAVING count(DISTINCT (l_partkey, l_suppkey)) = 1)
SELECT l_orderkey, l_linenumber, brand, s_nationkey, o_orderstatus FROM e JOIN p ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey WHERE p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size = 50)""")
def entry_authorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as entrypoints that must meet one agreed part, supplier and order; parts of size 50 stand twice, in conflict."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"), "p_size")
    parts = part.drop("p_size").union(part.where("p_size = 50").select("l_partkey", F.lit("another").alias("brand")))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    sides = [(parts, ["l_partkey"], ["brand"]), (suppliers.union(suppliers), ["l_suppkey"], ["s_nationkey"]), (orders, ["l_orderkey"], ["o_orderstatus"])]
    return E.authorised_entries(items, ["l_orderkey", "l_linenumber"], sides).select("l_orderkey", "l_linenumber", "brand", "s_nationkey", "o_orderstatus")


@add("c10_detector_match", """WITH s AS (SELECT l_orderkey, l_linenumber, p_brand AS package, CASE WHEN l_quantity > 30 THEN 'NewPoolClient' WHEN l_quantity > 15 THEN 'Open' ELSE 'Send' END AS callee, l_returnflag = 'N' AS external FROM lineitem JOIN part ON p_partkey = l_partkey),
d AS (SELECT DISTINCT p_brand AS package, CASE WHEN p_brand < 'Brand#3' THEN ['Open', 'Send'] END AS names, 'detector ' || p_brand AS detector FROM part WHERE p_brand < 'Brand#4')
SELECT l_orderkey, l_linenumber, detector FROM (SELECT DISTINCT s.*, detector FROM s JOIN d USING (package) WHERE names IS NULL OR list_contains(names, callee)) UNION ALL SELECT l_orderkey, l_linenumber, 'constructor' FROM (SELECT DISTINCT * FROM s) s WHERE package NOT IN (SELECT package FROM d) AND external AND callee = 'NewPoolClient'""")
def detector_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as call sites of their part's brand; detectors for some brands, by name or for every callee."""
    part = table(spark, sf_dir, "part")
    callee = F.when(F.col("l_quantity") > 30, "NewPoolClient").when(F.col("l_quantity") > 15, "Open").otherwise("Send")
    sites = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.col("p_brand").alias("package"), callee.alias("callee"), (F.col("l_returnflag") == "N").alias("external"))
    names = F.when(F.col("p_brand") < "Brand#3", F.array(F.lit("Open"), F.lit("Send")))
    detectors = part.where("p_brand < 'Brand#4'").select(F.col("p_brand").alias("package"), names.alias("names"), F.concat(F.lit("detector "), "p_brand").alias("detector")).distinct()
    return E.detector_matches(sites, detectors, "package", "callee", "names").select("l_orderkey", "l_linenumber", "detector")


@add("c13_unit_component", f"""WITH {FILES}, c AS (SELECT CASE WHEN size % 2 = 0 THEN path ELSE path || '/x' END AS path, repo || size AS component FROM files)
SELECT f.repo, f.path, c.component, CASE WHEN c.component IS NULL THEN 'omitted' ELSE 'matched' END AS outcome FROM files f LEFT JOIN (SELECT DISTINCT path, component FROM c) c USING (path)""")
def unit_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = files(spark, sf_dir)
    components = own.select(F.when(F.col("size") % 2 == 0, F.col("path")).otherwise(F.concat("path", F.lit("/x"))).alias("path"), F.concat("repo", F.col("size").cast("string")).alias("component"))
    return E.associate_exact(own.select("repo", "path"), components, "path").select("repo", "path", "component", "outcome")


@add("c16_canonical_claims", """WITH x AS (SELECT l_orderkey AS claim, 'src/p' || l_partkey || '.go' AS path, l_linenumber AS line, l_returnflag AS form FROM lineitem)
SELECT DISTINCT claim, path, line, line <= 3 AS grounded FROM x""")
def canonical_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item cites a line of its part's file in one of three forms; lines up to 3 are known."""
    path = F.concat(F.lit("src/p"), F.col("l_partkey").cast("string"), F.lit(".go"))
    line = F.col("l_linenumber").cast("string")
    form = F.when(F.col("l_returnflag") == "A", F.concat(path, F.lit(" line "), line)).when(F.col("l_returnflag") == "N", F.concat(path, F.lit(" shows this at line "), line)).otherwise(F.concat(path, F.lit(":"), line))
    items = table(spark, sf_dir, "lineitem")
    claims = items.select("l_orderkey", F.concat(F.lit("As "), form, F.lit(" says.")).alias("s")).groupBy(F.col("l_orderkey").alias("claim")).agg(F.array_join(F.collect_list("s"), " ").alias("text"))
    known = items.where("l_linenumber <= 3").select(path.alias("path"), F.col("l_linenumber").cast("long").alias("line"))
    known = known.union(items.select(path.alias("path"), F.explode(F.array(*(F.lit(k).cast("long") for k in (1, 2, 3)))).alias("line")))
    return E.canonical_claims(claims, known, "claim", "text")


@add("c20_test_evidence", """WITH m AS (SELECT DISTINCT p_partkey AS search, l_suppkey AS anchor, l_orderkey AS place FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_suppkey % 3 <> 0),
f AS (SELECT search, anchor, place, row_number() OVER (PARTITION BY search ORDER BY anchor, place) AS rank, count(*) OVER (PARTITION BY search) AS found FROM m) SELECT search, anchor, place, rank, found FROM f WHERE rank <= 5""")
def test_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as searches, items as reference places; suppliers but every third are test files."""
    searches = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("search"))
    places = table(spark, sf_dir, "lineitem").where("l_suppkey % 3 <> 0").select(F.col("l_partkey").alias("search"), F.col("l_suppkey").alias("anchor"), F.col("l_orderkey").alias("place"))
    found = E.attach_capped(searches, places, ["search"], "search", ["anchor", "place"], [F.col("anchor"), F.col("place")], 5)
    return found.select("search", "anchor", "place", "rank", "found")


@add("c21_scenario_match", """WITH t AS (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS tags FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, coalesce(tags, '') AS tags FROM orders LEFT JOIN t ON l_orderkey = o_orderkey),
e AS (SELECT DISTINCT o_orderstatus, o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN 'A,N' ELSE 'R' END AS tags FROM orders WHERE o_custkey % 5 = 0) SELECT o_orderkey, e.tags IS NOT NULL AS compatible FROM o LEFT JOIN e USING (o_orderstatus, o_orderpriority, tags)""")
def scenario_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose status, priority and set of flags equal those of an expected scenario."""
    orders = table(spark, sf_dir, "orders")
    tags = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(E.set_key(F.collect_list("l_returnflag")).alias("tags"))
    own = orders.select("o_orderkey", "o_orderstatus", "o_orderpriority").join(tags, "o_orderkey", "left").withColumn("tags", F.coalesce("tags", F.lit("")))
    expected = orders.where("o_custkey % 5 = 0").select("o_orderstatus", "o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, E.set_key(F.array(F.lit("N"), F.lit("A"), F.lit("N")))).otherwise("R").alias("tags"))
    return J.exists_flag(own, expected, ["o_orderstatus", "o_orderpriority", "tags"]).select("o_orderkey", F.col("openable").alias("compatible"))


@add("c22_seed_validation", f"WITH {FILES}, s AS (SELECT part, CASE WHEN part % 3 = 0 THEN path || '.gone' ELSE path END AS path FROM files) SELECT part, path, CASE WHEN path IN (SELECT path FROM files) THEN 'valid' ELSE 'unverified' END AS status FROM s")
def seed_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = files(spark, sf_dir)
    named = own.select("part", F.when(F.col("part") % 3 == 0, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("path"))
    return J.exists_flag(named, own, ["path"]).select("part", "path", F.when(F.col("openable"), "valid").otherwise("unverified").alias("status"))


@add("c23_graph_authorisation", """WITH ok AS (SELECT p_partkey FROM part WHERE p_size < 40), r AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst, (l_partkey + l_suppkey) % (SELECT count(*) FROM part) AS prov FROM lineitem)
SELECT id, src, dst FROM r WHERE src IN (SELECT p_partkey FROM ok) AND dst IN (SELECT p_partkey FROM ok) AND id NOT IN (SELECT id FROM r WHERE prov NOT IN (SELECT p_partkey FROM ok))""")
def graph_authorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of an order in turn as relations; small parts are in the catalog, and each relation has a place of origin."""
    from pyspark.sql import Window

    part = table(spark, sf_dir, "part")
    total = part.agg(F.count("*").alias("parts"))
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    rows = table(spark, sf_dir, "lineitem").join(F.broadcast(total)).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("src"), after.alias("dst"), ((F.col("l_partkey") + F.col("l_suppkey")) % F.col("parts")).alias("path"))
    nodes = part.select(F.col("p_partkey").alias("node"), F.col("p_partkey").alias("path"))
    return E.authorised_graph(nodes, rows.select("id", "src", "dst"), part.where("p_size < 40").select(F.col("p_partkey").alias("path")), rows.select("id", "path"))


@add("c28_exact_else_near", """WITH m AS (SELECT o_orderkey AS cite, l_partkey AS signal, l_quantity AS w, l_linenumber AS line, l_linenumber = o_custkey % 7 + 1 AS exact FROM orders JOIN lineitem ON l_orderkey = o_orderkey), t AS (SELECT *, bool_or(exact) OVER (PARTITION BY cite) AS best FROM m)
SELECT cite, line, signal, exact, rank FROM (SELECT *, row_number() OVER (PARTITION BY cite ORDER BY w DESC, line, signal) AS rank FROM t WHERE exact = best) WHERE rank <= 3""")
def exact_else_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    cites = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cite"), F.col("o_orderkey").alias("path"), (F.col("o_custkey") % 7 + 1).alias("line"))
    signals = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("signal"), F.col("l_quantity").alias("w"))
    return J.exact_else_near(cites, signals, "cite", "path", "line", "w", 3, ["signal"]).select("cite", "line", "signal", "exact", "rank")


@add("c29_call_target", """WITH i AS (SELECT o_orderkey AS file, 'q' || (o_custkey % 5) AS qualifier, o_custkey AS package FROM orders), o AS (SELECT o_orderkey AS file, o_custkey + 1000000 AS package FROM orders WHERE o_orderstatus <> 'P'),
c AS (SELECT l_orderkey AS file, l_linenumber AS site, CASE WHEN l_quantity > 25 THEN 'q' || (l_suppkey % 5) ELSE '' END AS qualifier FROM lineitem)
SELECT c.file, c.site, CASE WHEN c.qualifier <> '' THEN i.package ELSE o.package END AS target, CASE WHEN (CASE WHEN c.qualifier <> '' THEN i.package ELSE o.package END) IS NULL THEN 'unknown' WHEN c.qualifier <> '' THEN 'import' ELSE 'owner' END AS how FROM c LEFT JOIN i USING (file, qualifier) LEFT JOIN o USING (file)""")
def call_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    imports = orders.select(F.col("o_orderkey").alias("file"), F.concat(F.lit("q"), (F.col("o_custkey") % 5).cast("string")).alias("qualifier"), F.col("o_custkey").alias("package"))
    owners = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("file"), (F.col("o_custkey") + 1_000_000).alias("package"))
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("site"), F.when(F.col("l_quantity") > 25, F.concat(F.lit("q"), (F.col("l_suppkey") % 5).cast("string"))).otherwise("").alias("qualifier"))
    return E.call_targets(calls, imports, owners, ["file", "site"])


@add("c30_related_flows", """SELECT l_orderkey AS card, array_to_string(list_sort(list(DISTINCT f.flow)), ',') AS flows FROM lineitem JOIN (SELECT ps.l_suppkey AS flow, ps.l_partkey AS path FROM lineitem ps WHERE ps.l_linenumber = 1 AND ps.l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)) f ON f.path = l_partkey GROUP BY 1""")
def related_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as flows over the parts that lead their orders, orders as cards; suppliers in debt are rejected."""
    items = table(spark, sf_dir, "lineitem")
    flows = items.where("l_linenumber = 1").select(F.col("l_suppkey").alias("flow"), F.col("l_partkey").alias("path"))
    rejected = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("flow"))
    found = E.related_flows(flows.distinct(), items.select(F.col("l_orderkey").alias("card"), F.col("l_partkey").alias("path")).distinct(), rejected, "card")
    return found.select("card", F.array_join(F.col("flows").cast("array<string>"), ",").alias("flows"))


@add("d4_module_summary", """WITH m AS (SELECT c_nationkey, count(*) AS packages, count(*) FILTER (c_acctbal > 5000) AS entrypoints FROM customer GROUP BY 1), t AS (SELECT c_nationkey, l_suppkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, l_suppkey) AS k FROM t) SELECT m.c_nationkey, packages, entrypoints, string_agg(l_suppkey || ':' || n, ',' ORDER BY k) AS top FROM m LEFT JOIN (SELECT * FROM r WHERE k <= 10) r ON r.c_nationkey = m.c_nationkey GROUP BY ALL""")
def module_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as modules, customers as packages, suppliers as what they import."""
    customer = table(spark, sf_dir, "customer")
    counts = customer.groupBy("c_nationkey").agg(F.count("*").alias("packages"), F.count_if(F.col("c_acctbal") > 5000).alias("entrypoints"))
    imports = customer.join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return counts.join(E.top_list(imports, ["c_nationkey"], "l_suppkey", 10, "top"), "c_nationkey", "left")


@add("d6_association_rollup", """SELECT l_returnflag AS kind, l_suppkey AS unit, p_brand AS family, count(*) AS observations, count(*) FILTER (l_discount > 0.05) AS direct, array_to_string(list_slice(list_sort(list(DISTINCT l_orderkey)), 1, 5), ',') AS witnesses FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def association_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    group = [F.col("l_returnflag").alias("kind"), F.col("l_suppkey").alias("unit"), F.col("p_brand").alias("family")]
    rows = met.select(*group, "l_orderkey", (F.col("l_discount") > 0.05).alias("direct"))
    counts = rows.groupBy("kind", "unit", "family").agg(F.count("*").alias("observations"), F.count_if("direct").alias("direct"))
    least = R.top_k(rows.select("kind", "unit", "family", "l_orderkey").distinct(), ["kind", "unit", "family"], [F.col("l_orderkey")], 5)
    witnesses = least.groupBy("kind", "unit", "family").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_orderkey")), lambda x: x.cast("string")), ",").alias("witnesses"))
    return counts.join(witnesses, ["kind", "unit", "family"])


@add("d8_unit_relations", """SELECT s_nationkey AS unit, count(*) AS outgoing, count(DISTINCT c_nationkey) AS targets FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE s_nationkey <> c_nationkey GROUP BY 1""")
def unit_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations that leave a unit: items from suppliers to customers of another nation."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    own = items.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).where("s_nationkey <> c_nationkey")
    return own.groupBy(F.col("s_nationkey").alias("unit")).agg(F.count("*").alias("outgoing"), F.countDistinct("c_nationkey").alias("targets"))


@add("d10_story_coverage", """WITH a AS (SELECT DISTINCT l_orderkey, 'part' AS axis, l_partkey AS id, l_returnflag = 'A' AS used FROM lineitem UNION SELECT l_orderkey, 'supplier', l_suppkey, l_returnflag = 'A' FROM lineitem UNION SELECT l_orderkey, 'line', l_linenumber, l_returnflag = 'A' FROM lineitem UNION SELECT l_orderkey, 'quantity', CAST(l_quantity AS BIGINT), l_returnflag = 'A' FROM lineitem)
SELECT l_orderkey, axis, count(DISTINCT id) AS available, count(DISTINCT id) FILTER (used) AS referenced FROM a GROUP BY ALL""")
def story_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ids on four axes of each story, and those that accepted items refer to."""
    axes = {"part": "l_partkey", "supplier": "l_suppkey", "line": "l_linenumber", "quantity": "l_quantity"}
    ids = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(c).cast("long").alias("id")) for a, c in axes.items()))).alias("x")
    # items move once, before they are four rows each; an order's ids are made distinct and counted where they lie
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", *axes.values(), (F.col("l_returnflag") == "A").alias("used")).repartition("l_orderkey")
    rows = items.select("l_orderkey", ids, "used").select("l_orderkey", "x.axis", "x.id", "used")
    once = rows.groupBy("l_orderkey", "axis", "id").agg(F.max("used").alias("used"))
    return once.groupBy("l_orderkey", "axis").agg(F.count("id").alias("available"), F.count(F.when(F.col("used"), F.col("id"))).alias("referenced"))


@add("d11_aspect_coverage", """WITH c AS (SELECT l_suppkey AS aspect, l_partkey AS fact, (['direct', 'derived', 'assumed'])[l_linenumber % 3 + 1] AS status FROM lineitem WHERE l_returnflag <> 'R'), f AS (SELECT DISTINCT l_suppkey AS aspect, l_partkey AS fact FROM lineitem),
b AS (SELECT aspect, arg_min(status, CASE status WHEN 'direct' THEN 0 WHEN 'derived' THEN 1 ELSE 2 END) AS status FROM c GROUP BY 1) SELECT f.aspect, count(*) AS facts, count(*) FILTER ((f.aspect, f.fact) IN (SELECT (aspect, fact) FROM c)) AS used, coalesce(any_value(b.status), 'unsupported') AS status FROM f LEFT JOIN b USING (aspect) GROUP BY 1""")
def aspect_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    status = F.element_at(F.array(*map(F.lit, ["direct", "derived", "assumed"])), (F.col("l_linenumber") % 3 + 1).cast("int"))
    both = [F.col("l_suppkey").alias("aspect"), F.col("l_partkey").alias("fact")]
    claims = items.where("l_returnflag <> 'R'").select(*both, status.alias("status"))
    return E.aspect_coverage(claims, items.select(*both).distinct(), "aspect", "status", {"direct": 0, "derived": 1, "assumed": 2})


@add("d13_repeated_sets", """WITH s AS (SELECT o_custkey, o_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) SELECT o_custkey, count(*) AS cards, count(*) - count(DISTINCT k) AS duplicates FROM s GROUP BY 1""")
def repeated_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return E.repeated_sets(met, "o_custkey", "o_orderkey", "l_returnflag")


@add("d18_trigger_merge", """WITH r AS (SELECT l_partkey, l_suppkey, l_orderkey, l_returnflag, l_linenumber, [CAST(l_linenumber AS VARCHAR), l_returnflag] AS ev FROM lineitem), e AS (SELECT l_partkey, array_to_string(list_sort(list(DISTINCT v)), ',') AS evidence FROM (SELECT l_partkey, unnest(ev) AS v FROM r) GROUP BY 1)
SELECT b.l_partkey, b.l_suppkey, b.l_orderkey, evidence FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag, l_linenumber, l_orderkey, l_suppkey) AS k FROM r) b JOIN e USING (l_partkey) WHERE k = 1""")
def trigger_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("evidence", F.array(F.col("l_linenumber").cast("string"), "l_returnflag"))
    rank = [F.col("l_returnflag"), F.col("l_linenumber"), F.col("l_orderkey"), F.col("l_suppkey")]
    return E.merged_best(rows, ["l_partkey"], rank, ["l_suppkey", "l_orderkey"], "evidence").withColumn("evidence", F.array_join("evidence", ","))


@add("d19_common_prefix", f"""WITH {FILES}, p AS (SELECT part % 40 AS grp, repo || '/' || CASE WHEN part % 2 = 0 THEN path ELSE regexp_replace(path, '^[^/]*/', 'cmd/') END AS path FROM files WHERE repo < 'Brand#2'), s AS (SELECT grp, path, string_split(path, '/') AS seg FROM p),
n AS (SELECT grp, i FROM (SELECT grp, min(len(seg)) AS m FROM s GROUP BY 1), range(1, 9) t(i) WHERE i <= m), ok AS (SELECT n.grp, n.i FROM n JOIN s USING (grp) GROUP BY ALL HAVING count(DISTINCT seg[1:n.i]) = 1)
SELECT g.grp, coalesce(array_to_string(any_value(s.seg)[1:max(ok.i)], '/'), '') AS prefix FROM (SELECT DISTINCT grp FROM s) g LEFT JOIN ok ON ok.grp = g.grp LEFT JOIN s ON s.grp = g.grp GROUP BY g.grp""".replace(" WHERE repo < 'Brand#2'", ""))
def common_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("repo", F.lit("/"), F.when(F.col("part") % 2 == 0, F.col("path")).otherwise(F.regexp_replace("path", "^[^/]*/", "cmd/")))
    return E.common_prefix(files(spark, sf_dir).select((F.col("part") % 40).alias("grp"), path.alias("path")), ["grp"], "path")


@add("d21_considered_selected", """WITH c AS (SELECT DISTINCT l_orderkey, l_returnflag AS role, l_suppkey AS target, o.o_orderkey IS NOT NULL AS chosen FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') o ON o_orderkey = l_orderkey), t AS (SELECT role, target, bool_or(chosen) AS chosen FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY role, chosen ORDER BY target) AS k FROM t) SELECT role, count(*) AS considered, count(*) FILTER (chosen) AS selected, coalesce(string_agg(CASE WHEN NOT chosen AND k <= 3 THEN CAST(target AS VARCHAR) END, ',' ORDER BY k), '') AS sample FROM r GROUP BY 1""")
def considered_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("role"), F.col("l_suppkey").alias("target"))
    return E.considered_selected(items, table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey")), ["l_orderkey"], "role", "target")


@add("d23_catalog_counts", """SELECT p_type, p_brand, CASE WHEN bool_or(p_size = 50) THEN coalesce(max(p_size * 10), count(*)) ELSE count(*) END AS total, count(*) FILTER (p_size > 25) AS available FROM part GROUP BY ALL""")
def catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as surfaces; a list with a part of size 50 was cut, and carries its raw total."""
    rows = table(spark, sf_dir, "part").withColumn("cut", F.col("p_size") == 50).withColumn("raw", F.col("p_size") * 10)
    return E.raw_or_counted(rows, ["p_type", "p_brand"], F.col("p_size") > 25, "cut", "raw")


@add("d27_majority_owner", """WITH n AS (SELECT l_orderkey, CASE WHEN l_returnflag <> 'R' THEN l_suppkey % 5 END AS owner, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, owner) AS k FROM n WHERE owner IS NOT NULL) SELECT l_orderkey, owner, n FROM r WHERE k = 1""")
def majority_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") != "R", F.col("l_suppkey") % 5).alias("owner"))
    return E.majority(rows, ["l_orderkey"], "owner")


@add("e6_group_quota", f"""WITH {FILES}, g AS (SELECT repo, path, part, CASE WHEN part % 10 = 1 THEN 'test' WHEN part % 10 = 2 THEN 'doc' ELSE 'source' END AS grp, {_DIR} AS dir, part % 37 = 0 AS pin, size FROM files),
f AS (SELECT *, row_number() OVER (PARTITION BY repo, grp, dir ORDER BY pin DESC, size DESC, path) AS f FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY repo, grp ORDER BY pin DESC, f > 4, size DESC, path) AS k FROM f),
t AS (SELECT *, CASE WHEN pin THEN 0 WHEN k <= CASE grp WHEN 'test' THEN 2 WHEN 'doc' THEN 1 ELSE 15 END THEN 1 ELSE 2 END AS tier FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY tier, size DESC, path) AS position FROM t) SELECT repo, path, tier, position FROM p WHERE position <= 20""")
def group_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty files of each repository: pins first, a tenth tests, a fifteenth documents, sources at most four of a folder first."""
    own = files(spark, sf_dir)
    grp = F.when(F.col("part") % 10 == 1, "test").when(F.col("part") % 10 == 2, "doc").otherwise("source")
    rows = own.select("repo", "path", grp.alias("grp"), F.regexp_replace("path", "/[^/]*$", "").alias("dir"), (F.col("part") % 37 == 0).alias("pin"), (-F.col("size")).alias("order"))
    return X.group_quota(rows, ["repo"], "grp", "dir", "pin", ["order", "path"], {"source": 15, "test": 2, "doc": 1}, 4, 20).select("repo", "path", "tier", "position")


@add("e7_file_score", f"""WITH {FILES}, d AS (SELECT repo, path, size, part, {_DIR} AS dir, split_part({_DIR}, '/', -1) AS leaf, regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]*$', '') AS stem FROM files)
SELECT path, CASE WHEN part % 50 = 0 THEN 100 ELSE 0 END + CASE WHEN size % 7 = 1 THEN 80 WHEN size % 7 = 2 THEN 50 WHEN size % 7 = 3 THEN 30 ELSE 0 END + CASE WHEN starts_with(stem, leaf) THEN 20 ELSE 0 END AS score,
  concat_ws(',', CASE WHEN part % 50 = 0 THEN 'entrypoint' END, CASE WHEN size % 7 = 1 THEN 'dependency' WHEN size % 7 = 2 THEN 'second_hop' WHEN size % 7 = 3 THEN 'third_hop' END, CASE WHEN starts_with(stem, leaf) THEN 'directory_anchor' END) AS reasons FROM d""")
def file_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive score with reasons: entrypoint files, distance of the folder from one, files named after their folder."""
    hop = F.col("size") % 7
    leaf = F.element_at(F.split(F.regexp_replace("path", "/[^/]*$", ""), "/"), -1)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "[.][^.]*$", "")
    return files(spark, sf_dir).select("path", L.signal_sum([(F.col("part") % 50 == 0, "entrypoint", 100), (hop == 1, "dependency", 80), (hop == 2, "second_hop", 50), (hop == 3, "third_hop", 30), (F.startswith(stem, leaf), "directory_anchor", 20)]).alias("s")).select(
        "path", "s.score", F.array_join("s.reasons", ",").alias("reasons")
    )


@add("e9_call_top_k", """WITH c AS (SELECT l_partkey AS target, 'in' AS direction, l_suppkey AS other, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS tier, l_orderkey AS at_ FROM lineitem UNION ALL SELECT l_suppkey + 1000000000, 'out', l_partkey, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END, l_orderkey FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY target, direction ORDER BY tier, other, at_) AS rank, count(*) OVER (PARTITION BY target, direction) AS n FROM c) SELECT target, direction, other, at_, rank, n - 5 AS omitted FROM r WHERE rank <= 5""")
def call_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five calls into each part and out of each supplier, exact ones first, with how many were left out."""
    items = table(spark, sf_dir, "lineitem").withColumn("tier", F.when(F.col("l_returnflag") == "N", 0).otherwise(1))
    into = items.select(F.col("l_partkey").alias("target"), F.lit("in").alias("direction"), F.col("l_suppkey").alias("other"), "tier", F.col("l_orderkey").alias("at_"))
    calls = into.union(items.select(F.col("l_suppkey") + 1_000_000_000, F.lit("out"), "l_partkey", "tier", "l_orderkey"))
    best = R.top_k(calls, ["target", "direction"], [F.col("tier"), F.col("other"), F.col("at_")], 5)
    total = calls.groupBy("target", "direction").agg((F.count("*") - 5).alias("omitted"))
    return best.join(total, ["target", "direction"]).select("target", "direction", "other", "at_", "rank", "omitted")


@add("e12_suggestions", """WITH t AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS turn FROM customer), p AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY turn > 2, turn, c_mktsegment, c_custkey) AS position FROM t WHERE turn <= 2 OR c_acctbal > 9000)
SELECT c_nationkey, c_custkey, position FROM p WHERE position <= 8""")
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of every segment in turn, then others of a high balance, eight in all."""
    order = [F.desc("c_acctbal"), F.col("c_custkey")]
    rows = R.ranked(R.limit_first(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], order, 8), ["c_nationkey", "c_mktsegment"], order, "turn").where("turn <= 2 or c_acctbal > 9000")
    return R.top_k(rows, ["c_nationkey"], [F.col("turn") > 2, F.col("turn"), F.col("c_mktsegment"), F.col("c_custkey")], 8, "position").select("c_nationkey", "c_custkey", "position")


@add("e19_dependency_pick", """WITH RECURSIVE i AS (SELECT l_orderkey AS k, l_linenumber AS n, l_returnflag AS kind, CAST(l_quantity AS BIGINT) AS z, CASE WHEN l_discount > 0.05 AND l_linenumber > 1 THEN l_linenumber - 1 END AS ref, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CASE WHEN l_discount > 0.05 AND l_linenumber > 1 THEN 1 ELSE 0 END, l_returnflag, l_quantity) AS p FROM lineitem),
w AS (SELECT k, n, p, d, CASE WHEN d = 'admitted' THEN [n] ELSE [] END AS ins, CASE WHEN d = 'admitted' THEN [kind] ELSE [] END AS kinds, 100 - CASE WHEN d = 'admitted' THEN z ELSE 0 END AS room FROM (SELECT *, CASE WHEN ref IS NOT NULL THEN 'missing_reference' WHEN z > 100 THEN 'budget' ELSE 'admitted' END AS d FROM i WHERE p = 1)
 UNION ALL SELECT k, n, p, d, CASE WHEN d = 'admitted' THEN list_append(ins, n) ELSE ins END, CASE WHEN d = 'admitted' THEN list_append(kinds, kind) ELSE kinds END, room - CASE WHEN d = 'admitted' THEN z ELSE 0 END
 FROM (SELECT i.*, w.ins, w.kinds, w.room, CASE WHEN i.ref IS NOT NULL AND NOT list_contains(w.ins, i.ref) THEN 'missing_reference' WHEN len(list_filter(w.kinds, lambda x: x = i.kind)) >= 2 THEN 'kind_limit' WHEN i.z > w.room THEN 'budget' ELSE 'admitted' END AS d FROM w JOIN i ON i.k = w.k AND i.p = w.p + 1))
SELECT k AS l_orderkey, n AS l_linenumber, d AS decision FROM w""")
def dependency_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in order, of which discounted ones need the one before; two of a flag and a quantity of 100 in all."""
    ref = F.when((F.col("l_discount") > 0.05) & (F.col("l_linenumber") > 1), F.array((F.col("l_linenumber") - 1).cast("long")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), ref.alias("refs"), "l_returnflag", F.col("l_quantity").cast("long").alias("size"))
    return X.dependency_pick(rows, ["l_orderkey"], ["l_linenumber"], "l_linenumber", "refs", "l_returnflag", "size", 2, 100).select("l_orderkey", "l_linenumber", "decision")


_FULL = "b.n + 1 > 5 OR b.t + o.z > 1500 OR b.u + o.y > 100"


@add("e20_limited_batches", f"""WITH RECURSIVE o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderkey % 1000 AS z, o_orderkey % 60 AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
b AS (SELECT c, k, i, 1 AS batch, 1 AS n, z AS t, y AS u FROM o WHERE i = 1 UNION ALL SELECT o.c, o.k, o.i, CASE WHEN {_FULL} THEN b.batch + 1 ELSE b.batch END, CASE WHEN {_FULL} THEN 1 ELSE b.n + 1 END, CASE WHEN {_FULL} THEN o.z ELSE b.t + o.z END, CASE WHEN {_FULL} THEN o.y ELSE b.u + o.y END
  FROM b JOIN o ON o.c = b.c AND o.i = b.i + 1) SELECT c AS o_custkey, k AS o_orderkey, CASE WHEN batch <= 4 THEN batch END AS batch FROM b""")
def limited_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in batches bounded by count and two sizes; what comes after four batches isn't requested."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lit(1).alias("cards"), (F.col("o_orderkey") % 1000).alias("bytes"), (F.col("o_orderkey") % 60).alias("edges"))
    return X.limited_batches(o, ["o_custkey"], ["o_orderkey"], {"cards": 5, "bytes": 1500, "edges": 100}, 4).select("o_custkey", "o_orderkey", "batch")


@add("e22_argmax_relation", """WITH s AS (SELECT l_orderkey AS g, l_orderkey * 10 + l_linenumber AS id, CASE l_returnflag WHEN 'A' THEN 30 WHEN 'N' THEN 10 ELSE 0 END * 10 + CAST(floor(p_size * 20 / 4) AS BIGINT) + CAST(floor(coalesce(s_acctbal, 0) / 4) AS BIGINT) - CASE WHEN l_discount > 0.08 THEN 1500 ELSE 0 END - CASE WHEN l_tax > 0.07 THEN 1000 ELSE 0 END AS score
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey) SELECT g AS l_orderkey, id, score FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, id) AS k FROM s WHERE score > 0) WHERE k = 1""")
def argmax_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best relation of each order, its items scored by kind and both ends, less for tests and fixtures."""
    relations = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("kind"), (F.col("l_partkey") + 1_000_000_000).alias("src"), F.col("l_suppkey").alias("dst"), "l_discount", "l_tax")
    nodes = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1_000_000_000).alias("node"), (F.col("p_size") * 20).cast("double").alias("score")).union(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").cast("double")))
    penalty = F.when(F.col("l_discount") > 0.08, 1500).otherwise(0) + F.when(F.col("l_tax") > 0.07, 1000).otherwise(0)
    return E.argmax_relation(relations, nodes, ["l_orderkey"], {"A": 30, "N": 10}, penalty)


@add("e23_ten_key_rank", """SELECT l_partkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag, l_discount DESC, l_tax, l_quantity % 7, l_suppkey % 3 DESC, l_suppkey % 5, l_quantity DESC, l_shipdate, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 6""")
def ten_key_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six anchors of each part by ten keys in turn: authority, link, distances, affinities, score, path, symbol, id."""
    order = [F.col("l_returnflag"), F.desc("l_discount"), F.col("l_tax"), F.col("l_quantity") % 7, F.desc(F.col("l_suppkey") % 3), F.col("l_suppkey") % 5, F.desc("l_quantity"), F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")]
    return R.top_k(table(spark, sf_dir, "lineitem"), ["l_partkey"], order, 6).select("l_partkey", "l_orderkey", "l_linenumber", "rank")


@add("e25_fact_priority", f"""WITH f AS (SELECT l_orderkey, l_linenumber, l_suppkey % 4 * 10 + CASE WHEN {_KIND} IN ('command_dispatch', 'lifecycle_start') THEN 6 ELSE 0 END + CASE WHEN l_returnflag = 'A' THEN 3 ELSE 0 END + CAST(least(l_quantity, 20) AS BIGINT) AS priority, l_partkey, l_suppkey FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY priority DESC, l_linenumber, l_partkey, l_suppkey) AS k FROM f) SELECT l_orderkey, l_linenumber, priority, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS position FROM r WHERE k <= 3""")
def fact_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three facts of greatest priority in each order, back in their own order."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("l_partkey") % len(KINDS) + 1).cast("int"))
    priority = F.col("l_suppkey") % 4 * 10 + F.when(kind.isin("command_dispatch", "lifecycle_start"), 6).otherwise(0) + F.when(F.col("l_returnflag") == "A", 3).otherwise(0) + F.least(F.col("l_quantity"), F.lit(20)).cast("long")
    best = R.top_k(table(spark, sf_dir, "lineitem").withColumn("priority", priority), ["l_orderkey"], [F.desc("priority"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], 3).drop("rank")
    return R.ranked(best, ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], "position").select("l_orderkey", "l_linenumber", "priority", "position")


@add("e26_vector_rank", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice DESC, p_type, length(p_name) DESC, -p_partkey) AS rank FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY rank) AS turn FROM r)
SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY turn > 1, rank) AS position FROM k QUALIFY position <= 6""")
def vector_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by five criteria, the last negated; one of each type before others."""
    order = [F.desc("p_size"), F.desc("p_retailprice"), F.col("p_type"), F.desc(F.length("p_name")), -F.col("p_partkey")]
    near = R.limit_first(table(spark, sf_dir, "part"), ["p_brand", "p_type"], order, 6)
    return R.diverse_first(near, ["p_brand"], "p_type", order, 6).select("p_brand", "p_partkey", "position")


@add("g2_retention_priority", f"WITH RECURSIVE {EDGES}, seeds AS (SELECT s_suppkey AS node FROM supplier WHERE s_acctbal > 9000), walk(node) AS (SELECT node FROM seeds UNION SELECT e.dst FROM walk w JOIN edges e ON e.src = w.node), n AS (SELECT s_suppkey AS node FROM supplier UNION ALL SELECT p_partkey + 1000000000 FROM part) SELECT node, CASE WHEN node IN (SELECT node FROM seeds) THEN 0 WHEN node IN (SELECT node FROM walk) THEN 1 ELSE 2 END AS priority FROM n")
def retention_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0 for entries, 1 for what they reach, 2 for the rest."""
    entries = _entries(spark, sf_dir)
    return _nodes(spark, sf_dir).join(G.distances(S.settle(edges(spark, sf_dir)), entries), "node", "left").select("node", F.when(F.col("distance").isNull(), 2).otherwise(F.least("distance", F.lit(1))).alias("priority"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_suppkey").alias("node"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node")).union(table(spark, sf_dir, "part").select(F.col("p_partkey") + 1_000_000_000))


@add("g4_undirected_walk", f"""WITH RECURSIVE {EDGES}, ok AS (SELECT src, dst FROM edges WHERE n = 1 AND dst NOT IN (SELECT p_partkey + 1000000000 FROM part WHERE p_size > 45) AND src NOT IN (SELECT p_partkey + 1000000000 FROM part WHERE p_size > 45)), both_ AS (SELECT src, dst FROM ok UNION SELECT dst, src FROM ok),
walk(node, distance) AS (SELECT s_suppkey, 0 FROM supplier WHERE s_acctbal > 9000 UNION SELECT e.dst, w.distance + 1 FROM walk w JOIN both_ e ON e.src = w.node WHERE w.distance < 3) SELECT node, min(distance) AS distance FROM walk GROUP BY 1""")
def undirected_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances either way over relations of one witness; large parts are terminals that no walk enters."""
    terminal = table(spark, sf_dir, "part").where("p_size > 45").select((F.col("p_partkey") + 1_000_000_000).alias("node"))
    allowed = edges(spark, sf_dir).where("n = 1")
    for end in ("src", "dst"):
        allowed = allowed.join(terminal.withColumnRenamed("node", end), end, "left_anti")
    return G.distances(S.settle(G.undirected(allowed)), _entries(spark, sf_dir), 3)


@add("g6_two_hop", f"""WITH {EDGES}, both_ AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), s AS (SELECT s_suppkey AS seed FROM supplier WHERE s_acctbal > 9000),
one AS (SELECT seed, node FROM (SELECT seed, dst AS node, row_number() OVER (PARTITION BY seed ORDER BY dst) AS k FROM s JOIN both_ ON src = seed WHERE dst <> seed) WHERE k <= 6), far AS (SELECT DISTINCT o.seed, b.dst AS node FROM one o JOIN both_ b ON b.src = o.node WHERE b.dst <> o.seed AND (o.seed, b.dst) NOT IN (SELECT (seed, node) FROM one)),
two AS (SELECT seed, node FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY node) AS k FROM far) WHERE k <= 6) SELECT seed, node, 1 AS hop FROM one UNION ALL SELECT seed, node, 2 FROM two""")
def two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.two_hop(S.settle(edges(spark, sf_dir)), _entries(spark, sf_dir), 6)


@add("g10_hop_tags", f"""WITH RECURSIVE {EDGES}, walk(node, distance) AS (SELECT s_suppkey, 0 FROM supplier WHERE s_acctbal > 9000 UNION SELECT e.dst, w.distance + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.distance < 3), {FILES},
t AS (SELECT {_DIR} AS dir, min(distance) AS hop FROM files JOIN walk ON node = part + 1000000000 WHERE distance > 0 GROUP BY repo, dir) SELECT dir, hop, count(*) AS repositories FROM t GROUP BY ALL""")
def hop_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many repositories hold each folder one, two or three steps from an entry."""
    reach = G.distances(S.settle(edges(spark, sf_dir)), _entries(spark, sf_dir), 3).where("distance > 0")
    met = files(spark, sf_dir).withColumn("node", F.col("part") + 1_000_000_000).join(reach, "node")
    tags = met.groupBy("repo", F.regexp_replace("path", "/[^/]*$", "").alias("dir")).agg(F.min("distance").alias("hop"))
    return tags.groupBy("dir", "hop").agg(F.count("*").alias("repositories"))


@add("g12_unit_clusters", f"""WITH {FILES}, c AS (SELECT repo, path, CASE WHEN part % 41 = 0 THEN 'seed:' || path ELSE split_part(path, '/', 1) || ':' || size % 3 END AS bucket FROM files), k AS (SELECT *, (row_number() OVER (PARTITION BY repo, bucket ORDER BY path) - 1) // 8 AS chunk FROM c)
SELECT repo, bucket, chunk, count(*) AS members, min(path) AS first FROM k GROUP BY ALL""")
def unit_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds stay single, other files gather by folder and role, in chunks of at most eight."""
    bucket = F.when(F.col("part") % 41 == 0, F.concat(F.lit("seed:"), "path")).otherwise(F.concat(F.split("path", "/")[0], F.lit(":"), (F.col("size") % 3).cast("string")))
    cut = E.chunked(files(spark, sf_dir).select("repo", "path", bucket.alias("bucket")), ["repo", "bucket"], [F.col("path")], 8)
    return cut.groupBy("repo", "bucket", "chunk").agg(F.count("*").alias("members"), F.min("path").alias("first"))


@add("g13_branch_reach", f"""WITH RECURSIVE {EDGES}, roots AS (SELECT s_suppkey AS node FROM supplier WHERE s_acctbal > 9000), walk(root, node) AS (SELECT node, node FROM roots UNION SELECT w.root, e.dst FROM walk w JOIN edges e ON e.src = w.node WHERE e.dst NOT IN (SELECT node FROM roots)) SELECT root, node FROM walk""")
def branch_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each root reaches without crossing another root."""
    roots = _entries(spark, sf_dir)
    return G.branches(calls(spark, sf_dir).join(roots.withColumnRenamed("node", "dst"), "dst", "left_anti"), roots)


@add("e24_capped_graph", f"""WITH RECURSIVE {EDGES}, n AS (SELECT s_suppkey AS node, CASE WHEN s_acctbal > 9000 THEN 'process_entry' ELSE 'supplier' END AS kind FROM supplier UNION ALL SELECT p_partkey + 1000000000, p_type FROM part), walk(node) AS (SELECT node FROM n WHERE kind = 'process_entry' UNION SELECT e.dst FROM walk w JOIN edges e ON e.src = w.node),
t AS (SELECT *, CASE WHEN kind = 'process_entry' THEN 0 WHEN node IN (SELECT node FROM walk) THEN 1 ELSE 2 END AS tier FROM n), a AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY tier, node) AS k FROM t), b AS (SELECT *, row_number() OVER (ORDER BY tier, kind, node) AS p FROM a WHERE k <= CASE WHEN kind = 'process_entry' THEN 12 ELSE 40 END),
c AS (SELECT node, tier < 2 AS r FROM b WHERE p <= 150), e AS (SELECT DISTINCT src, dst, x.r AND y.r AS r FROM edges JOIN c x ON x.node = src JOIN c y ON y.node = dst), f AS (SELECT *, row_number() OVER (ORDER BY r DESC, src, dst) AS q FROM e)
SELECT 'node' AS part, CAST(node AS VARCHAR) AS id FROM c UNION ALL SELECT 'edge', src || '>' || dst FROM f WHERE q <= 300""")
def capped_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.when(F.col("s_acctbal") > 9000, "process_entry").otherwise("supplier").alias("kind"))
    nodes = nodes.union(table(spark, sf_dir, "part").select(F.col("p_partkey") + 1_000_000_000, "p_type"))
    graph = S.settle(edges(spark, sf_dir))
    return E.retained_graph(nodes, graph, G.closure(graph, _entries(spark, sf_dir)), "process_entry", 40, 12, 150, 300)


@add("a3_corpus_source", """SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, coalesce(strlen(text) > 400, false) AS truncated, CASE WHEN strlen(text) > 400 THEN left(text, CAST(list_max(list_filter(range(100, 401), lambda k: strlen(left(text, CAST(k AS BIGINT))) <= 400)) AS BIGINT)) ELSE text END AS text FROM documents""")
def corpus_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut at 400 bytes, never inside a character."""
    from gleaner.sources.listing import read_corpus

    return read_corpus(spark, f"{sf_dir}/documents.parquet", text="text", most_bytes=400).select("doc_id", "n_bytes", "truncated", "text")


@add("a7_rule_catalog", "SELECT n_nationkey AS rule, n_name AS name, n_regionkey AS level FROM nation")
def rule_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as rules: written as one JSON file a region, and read back as a catalog."""
    from gleaner.sources.listing import read_rules

    seed = F.struct(F.col("n_nationkey").alias("rule"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("level"))
    packs = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(seed).alias("seeds")).select("n_regionkey", F.to_json(F.struct("seeds")).alias("value"))
    path = S.folder(spark)
    packs.repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    return read_rules(spark, path).select("rule", "name", "level")


@add("a9_snapshot_store", "SELECT s_suppkey, s_nationkey FROM supplier")
def snapshot_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers saved with their context and loaded under the same one."""
    from gleaner.sources.listing import load_snapshot, save_snapshot

    path = S.folder(spark)
    save_snapshot(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), path, {"version": "1", "revision": "a"})
    return load_snapshot(spark, path, {"version": "1", "revision": "a"})


@add("a10_content_sink", "SELECT DISTINCT sha256(l_returnflag || chr(0) || l_suppkey) AS key, l_returnflag, l_suppkey FROM lineitem")
def content_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts keyed by their content, appended twice: the second time only those not there yet are written."""
    from gleaner.functions.text import digest_of
    from gleaner.operators.incremental import append_content

    facts = table(spark, sf_dir, "lineitem").select(digest_of(F.col("l_returnflag"), F.col("l_suppkey").cast("string")).alias("key"), "l_returnflag", "l_suppkey")
    path = S.folder(spark)
    append_content(path, facts.where("l_returnflag <> 'R'"), "key")
    append_content(path, facts, "key", spark.read.parquet(path))
    return spark.read.parquet(path)


@add("a11_acceptance_matrix", """WITH r AS (SELECT o_custkey, count(*) AS runs, count(*) FILTER (o_orderstatus = 'F') AS failed, count(*) - count(DISTINCT o_orderpriority) AS repeated FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(runs, 0) AS runs, coalesce(failed, 0) AS failed, CASE WHEN runs IS NULL THEN 'FAILED' WHEN failed > 0 OR repeated > 5 THEN 'DEGRADED' ELSE 'READY' END AS readiness FROM customer LEFT JOIN r ON o_custkey = c_custkey""")
def acceptance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every expected customer: runs, failures and readiness (J7), written as JSON and read back."""
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("runs"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"), (F.count("*") - F.countDistinct("o_orderpriority")).alias("repeated"))
    met = table(spark, sf_dir, "customer").select("c_custkey").join(runs, "c_custkey", "left")
    readiness = F.when(F.col("runs").isNull(), "FAILED").when((F.col("failed") > 0) | (F.col("repeated") > 5), "DEGRADED").otherwise("READY")
    matrix = met.select("c_custkey", F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("failed", F.lit(0)).alias("failed"), readiness.alias("readiness"))
    path = S.folder(spark)
    matrix.write.json(path)
    return spark.read.schema("c_custkey long, runs long, failed long, readiness string").json(path)


@add("j9_target_scope", f"""WITH RECURSIVE {EDGES}, walk(node) AS (SELECT 1 UNION SELECT e.dst FROM walk w JOIN edges e ON e.src = w.node), s AS (SELECT 'part' AS fact, count(*) AS n FROM part WHERE p_partkey + 1000000000 IN (SELECT node FROM walk) UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE s_suppkey IN (SELECT node FROM walk)
  UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_suppkey IN (SELECT node FROM walk) AND l_partkey + 1000000000 IN (SELECT node FROM walk)) SELECT fact, n FROM s""")
def target_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fact tables cut to one target's closure, and counted again."""
    graph = S.settle(edges(spark, sf_dir))
    reach = S.settle(G.closure(graph, table(spark, sf_dir, "supplier").where("s_suppkey = 1").select(F.col("s_suppkey").alias("node"))))
    part, supplier = reach.select((F.col("node") - 1_000_000_000).alias("l_partkey")), reach.select(F.col("node").alias("l_suppkey"))
    tables = {
        "part": table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey").join(part, "l_partkey", "left_semi"),
        "supplier": table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "l_suppkey").join(supplier, "l_suppkey", "left_semi"),
        "lineitem": table(spark, sf_dir, "lineitem").join(part, "l_partkey", "left_semi").join(supplier, "l_suppkey", "left_semi"),
    }
    counts = [rows.agg(F.lit(name).alias("fact"), F.count("*").alias("n")) for name, rows in tables.items()]
    return counts[0].union(counts[1]).union(counts[2])


@add("j12_strategy_comparison", """WITH v AS (SELECT o_custkey, o_orderkey % 2 AS variant, count(DISTINCT l_partkey) AS parts, sum(l_quantity) AS cost FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), w AS (SELECT o_custkey, max(parts) FILTER (variant = 0) AS parts_0, max(parts) FILTER (variant = 1) AS parts_1, CAST(max(cost) FILTER (variant = 0) AS DOUBLE) AS cost_0, CAST(max(cost) FILTER (variant = 1) AS DOUBLE) AS cost_1 FROM v GROUP BY 1)
SELECT *, CASE WHEN parts_0 IS NULL OR parts_1 IS NULL THEN 'incomplete' WHEN parts_0 > parts_1 THEN 'first' WHEN parts_1 > parts_0 THEN 'second' WHEN cost_0 <= cost_1 THEN 'first' ELSE 'second' END AS better FROM w""")
def strategy_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variants of each customer's orders, by parts covered and then by cost."""
    met = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    per = met.groupBy("o_custkey", (F.col("o_orderkey") % 2).alias("variant")).agg(F.countDistinct("l_partkey").alias("parts"), F.sum("l_quantity").cast("double").alias("cost"))
    wide = per.groupBy("o_custkey").agg(*(F.max(F.when(F.col("variant") == v, F.col(c))).alias(f"{c}_{v}") for c in ("parts", "cost") for v in (0, 1)))
    better = F.when(F.col("parts_0").isNull() | F.col("parts_1").isNull(), "incomplete").when(F.col("parts_0") > F.col("parts_1"), "first").when(F.col("parts_1") > F.col("parts_0"), "second").when(F.col("cost_0") <= F.col("cost_1"), "first").otherwise("second")
    return wide.withColumn("better", better)


_TERMS = ["widget", "bolt", "gear", "small", "cold", "core", "app"]


@add("e8_layered_score", f"""WITH {FILES}, s AS (SELECT path, lower(path) AS low, split_part(lower(path), '/', -1) AS base, part % 29 = 0 AS seed, {_LIST(_TERMS)} AS terms FROM files), t AS (SELECT *, regexp_replace(base, '[.][^.]*$', '') AS stem, string_split_regex(base, '[^a-z0-9]+') AS words, list_slice(string_split(low, '/'), 1, len(string_split(low, '/')) - 1) AS dirs, contains(low, 'archive') OR contains(low, 'testdata') AS legacy FROM s),
r AS (SELECT *, list_contains(terms, stem) OR list_contains(terms, base) AS a, list_has_any(terms, words) AS b, list_has_any(terms, dirs) AS c FROM t)
SELECT path, CASE WHEN seed THEN 200 ELSE CASE WHEN a THEN 100 ELSE 0 END + CASE WHEN b THEN 70 ELSE 0 END + CASE WHEN c THEN 60 ELSE 0 END - CASE WHEN legacy THEN 100 ELSE 0 END END AS score,
  CASE WHEN seed THEN 'seed' ELSE concat_ws(',', CASE WHEN a THEN 'exact_base' END, CASE WHEN b THEN 'base_word' END, CASE WHEN c THEN 'folder' END, CASE WHEN legacy THEN 'legacy' END) END AS reasons FROM r""")
def layered_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = L.layered_score(F.col("path"), F.array(*map(F.lit, _TERMS)), F.col("part") % 29 == 0, ["archive", "testdata"])
    return files(spark, sf_dir).select("path", made.alias("s")).select("path", "s.score", F.array_join("s.reasons", ",").alias("reasons"))


@add("h4_shared_tokens", f"""WITH {FILES}, t AS (SELECT path, part, list_distinct(list_filter(string_split_regex(lower(path), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains({_LIST(L.COMMON_WORDS)}, w))) AS tokens, string_split_regex(lower(path), '[^a-z0-9]+') AS seg FROM files)
SELECT t.path, len(t.tokens) AS tokens, len(list_intersect(t.tokens, {_LIST(_TERMS)})) AS shared, CAST(list_sum(list_transform({_LIST(_TERMS)}, lambda x: CASE WHEN len(list_filter(seg, lambda s: contains(s, x))) > 0 THEN 1 ELSE 0 END)) AS BIGINT) AS path_score FROM t""")
def shared_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, tokens = F.array(*map(F.lit, _TERMS)), L.semantic_tokens(F.col("path"))
    return files(spark, sf_dir).select("path", F.size(tokens).alias("tokens"), L.shared_tokens(tokens, terms).alias("shared"), L.path_term_score(F.col("path"), terms).alias("path_score"))


@add("h3_query_terms", """WITH w AS (SELECT DISTINCT conv_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM conversations), ig AS (SELECT term FROM w GROUP BY 1 HAVING count(DISTINCT conv_id) > 12), al AS (SELECT DISTINCT a.term, b.term AS alias FROM (SELECT DISTINCT term FROM w WHERE length(term) >= 6) a JOIN (SELECT DISTINCT term FROM w WHERE length(term) = 5) b ON left(a.term, 5) = b.term)
SELECT conv_id, w.term, coalesce(alias, w.term) AS alias FROM w LEFT JOIN al ON al.term = w.term WHERE length(w.term) >= 2 AND w.term NOT IN (SELECT term FROM ig)""")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of conversations; words of many are ignored, and long words stand for the five-letter words they begin with."""
    turns = table(spark, sf_dir, "conversations")
    words = turns.select("conv_id", F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("term")).distinct()
    ignored = words.groupBy("term").agg(F.count("*").alias("n")).where("n > 12")
    every = words.select("term").distinct()
    short = every.where("length(term) = 5").select(F.col("term").alias("alias"))
    aliases = every.where("length(term) >= 6").withColumn("alias", F.substring("term", 1, 5)).join(short, "alias")
    return E.query_terms(turns, "conv_id", "text", ignored, aliases)


@add("b12_surface_quality", f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, (['process_entry', 'cli_command', 'http_route', 'http_server', 'http_route_descriptor'])[l_partkey % 5 + 1] AS kind, l_returnflag <> 'R' AS exact, l_tax < 0.08 AS available, l_discount > 0.09 AS dep, l_suppkey % 3 <> 0 AS idn, l_suppkey % 4 <> 0 AS reg, l_suppkey % 7 <> 0 AS han, l_quantity > 10 AS sta FROM lineitem),
r AS (SELECT *, CASE WHEN kind = 'process_entry' AND exact THEN 'entry_surface/partial' WHEN NOT available THEN 'rejected/rejected' WHEN dep THEN 'noisy/unsupported' WHEN kind IN ('cli_command', 'http_route') AND idn AND reg AND han AND sta AND exact THEN 'entry_surface/ready' WHEN kind = 'cli_command' THEN 'entry_surface/partial'
  WHEN kind = 'http_route' AND idn AND reg THEN 'entry_surface/partial' WHEN kind = 'http_route' THEN 'dynamic_frontier/unsupported' WHEN kind = 'http_server' AND reg THEN 'entry_surface/partial' WHEN kind = 'http_server' THEN 'entry_surface/unsupported' WHEN idn AND reg THEN 'descriptor/partial' ELSE 'dynamic_frontier/unsupported' END AS q FROM t)
SELECT kind, split_part(q, '/', 1) AS role, split_part(q, '/', 2) AS readiness, count(*) AS n FROM r GROUP BY ALL""")
def surface_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as runtime surfaces with five dimensions of quality."""
    kind = F.element_at(F.array(*map(F.lit, ["process_entry", "cli_command", "http_route", "http_server", "http_route_descriptor"])), (F.col("l_partkey") % 5 + 1).cast("int"))
    s = F.col("l_suppkey")
    made = L.surface_quality(F.col("kind"), F.col("l_returnflag") != "R", F.col("l_tax") < 0.08, F.col("l_discount") > 0.09, s % 3 != 0, s % 4 != 0, s % 7 != 0, F.col("l_quantity") > 10)
    rows = table(spark, sf_dir, "lineitem").withColumn("kind", kind).select("kind", made.alias("q"))
    return rows.groupBy("kind", "q.role", "q.readiness").agg(F.count("*").alias("n"))


@add("c18_anchor_relations", """WITH a AS (SELECT l_orderkey AS task, l_linenumber AS id, max(CAST(l_quantity AS BIGINT)) AS score FROM lineitem GROUP BY ALL), c AS (SELECT DISTINCT x.l_orderkey AS task, x.l_linenumber AS l, y.l_linenumber AS r FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber + 1 = y.l_linenumber WHERE x.l_returnflag = 'A'),
t AS (SELECT DISTINCT x.l_orderkey AS task, x.l_linenumber AS l, y.l_linenumber AS r FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber = y.l_linenumber + 2 WHERE x.l_returnflag = 'N'), m AS (SELECT DISTINCT l_orderkey AS task, l_linenumber AS id, l_suppkey % 5 AS term, l_suppkey % 5 + 8 AS weight FROM lineitem),
s AS (SELECT x.task, x.id AS l, y.id AS r, max(x.weight) AS w FROM m x JOIN m y ON x.task = y.task AND x.term = y.term AND x.id < y.id GROUP BY ALL), k AS (SELECT task, l, r, 0 AS o, 'direct_call' AS kind, 4000 AS bonus FROM c UNION ALL SELECT task, l, r, 1, 'test_reference', 3000 FROM t UNION ALL SELECT task, l, r, 2, 'shared_task_term', 1000 + w * 10 FROM s),
b AS (SELECT *, row_number() OVER (PARTITION BY task, least(l, r), greatest(l, r) ORDER BY o, l, r) AS p FROM k), z AS (SELECT b.task, l, r, kind, x.score + y.score + bonus AS score FROM b JOIN a x ON x.task = b.task AND x.id = l JOIN a y ON y.task = b.task AND y.id = r WHERE p = 1)
SELECT task, l AS "left", r AS "right", kind, score FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score DESC, l, r) AS q FROM z) WHERE q <= 4""")
def anchor_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of an order as anchors: calls to the next line, tests of the line two before, terms by supplier."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_linenumber").cast("long").alias("id"), "l_returnflag", "l_suppkey", F.col("l_quantity").cast("long").alias("score"))
    parts = S.parts_of(items)
    items = items.repartition(parts, "task")
    anchors = S.settle(items.groupBy("task", "id").agg(F.max("score").alias("score")))
    lines = anchors.select("task", F.col("id").alias("right"))
    near = lambda flag, step: items.where(F.col("l_returnflag") == flag).select("task", F.col("id").alias("left"), (F.col("id") + step).alias("right")).distinct().repartition(parts, "task", "right").join(lines, ["task", "right"], "left_semi")
    terms = items.select("task", "id", (F.col("l_suppkey") % 5).alias("term"), (F.col("l_suppkey") % 5 + 8).alias("weight")).distinct()
    return E.anchor_relations(anchors, near("A", 1), near("N", -2), terms, "task", 4)


@add("j3_verification_frontier", f"""WITH RECURSIVE {EDGES}, both_ AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), walk(node, distance) AS (SELECT s_suppkey, 0 FROM supplier WHERE s_acctbal > 9000 UNION SELECT b.dst, w.distance + 1 FROM walk w JOIN both_ b ON b.src = w.node WHERE w.distance < 2),
d AS (SELECT node, min(distance) AS distance FROM walk GROUP BY 1), c AS (SELECT p_type AS kind, p_partkey, distance, p_size FROM part JOIN d ON d.node = p_partkey + 1000000000) SELECT kind, p_partkey, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY distance, p_size DESC, p_partkey) AS rank FROM c) WHERE rank <= 6""")
def verification_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six parts of each type nearest to the entries over relations either way: what to check first."""
    linked = S.settle(G.undirected(calls(spark, sf_dir)))
    reach = G.distances(linked, _entries(spark, sf_dir), 2)
    met = table(spark, sf_dir, "part").withColumn("node", F.col("p_partkey") + 1_000_000_000).join(reach, "node").withColumnRenamed("p_type", "kind")
    return R.top_k(met, ["kind"], [F.col("distance"), F.desc("p_size"), F.col("p_partkey")], 6).select("kind", "p_partkey", "distance", "rank")


@add("j5_response_evaluation", """WITH c AS (SELECT o_custkey AS task, count(*) AS expected, count(*) FILTER (o_orderstatus <> 'F') AS covered, bool_or(o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') AS tripped FROM orders GROUP BY 1), g AS (SELECT o_custkey AS task, count(*) AS refs, count(*) FILTER (l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45)) AS invalid, count(DISTINCT l_suppkey) AS evidence FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
r AS (SELECT c.task, round(covered / CAST(expected AS DOUBLE), 6) AS coverage, coalesce(invalid, 0) AS invalid, coalesce(evidence, 0) AS evidence, NOT tripped AS clear FROM c LEFT JOIN g USING (task)) SELECT *, coverage >= 0.4 AND invalid <= 4 AND evidence >= 3 AND clear AS passed FROM r""")
def response_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tasks: directions covered, references grounded, evidence seen, tripwires clear; all must hold."""
    orders = table(spark, sf_dir, "orders")
    directions = orders.groupBy(F.col("o_custkey").alias("task")).agg(
        F.count("*").alias("expected"), F.count_if(F.col("o_orderstatus") != "F").alias("covered"), F.bool_or((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")).alias("tripped")
    )
    met = orders.join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("task"), F.col("l_partkey").alias("p_partkey"), "l_suppkey")
    grounded = J.exists_flag(met, table(spark, sf_dir, "part").where("p_size <= 45"), ["p_partkey"], "known")
    evidence = grounded.groupBy("task").agg(F.count_if(~F.col("known")).alias("invalid"), F.countDistinct("l_suppkey").alias("evidence"))
    out = directions.join(evidence, "task", "left").select("task", F.round(F.col("covered") / F.col("expected"), 6).alias("coverage"), F.coalesce("invalid", F.lit(0)).alias("invalid"), F.coalesce("evidence", F.lit(0)).alias("evidence"), (~F.col("tripped")).alias("clear"))
    return out.withColumn("passed", (F.col("coverage") >= 0.4) & (F.col("invalid") <= 4) & (F.col("evidence") >= 3) & F.col("clear"))


@add("j10_theme_cards", """SELECT l_orderkey AS card, count(DISTINCT l_partkey) AS members, CASE WHEN count(DISTINCT l_partkey) FILTER (l_returnflag <> 'R') >= 3 THEN 'full' ELSE 'partial' END AS badge FROM lineitem GROUP BY 1""")
def theme_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.cards_of(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "card"), "card", "l_partkey", F.col("l_returnflag") != "R", 3)


@add("g18_handoff_groups", """WITH h AS (SELECT o_orderkey AS entry, s_nationkey AS target, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag <> 'R' GROUP BY ALL), t AS (SELECT o_orderkey AS entry, count(l_orderkey) AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag <> 'R' GROUP BY 1)
SELECT t.entry, coalesce(string_agg(target || ':' || n, ',' ORDER BY target), '') AS handoffs, total, coalesce(sum(n), 0) = total AS checked FROM t LEFT JOIN h USING (entry) GROUP BY t.entry, total""")
def handoff_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as process entries: exact handoffs grouped by the target's nation, with the totals checked."""
    items = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("entry"), "l_suppkey")
    groups = items.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("entry", F.col("s_nationkey").alias("target")).agg(F.count("*").alias("n"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("target", "n"))), lambda g: F.concat_ws(":", g["target"].cast("string"), g["n"].cast("string")))
    listed = groups.groupBy("entry").agg(F.array_join(text, ",").alias("handoffs"), F.sum("n").alias("sum"))
    total = items.groupBy("entry").agg(F.count("*").alias("total"))
    out = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry")).join(total, "entry", "left").join(listed, "entry", "left")
    return out.select("entry", F.coalesce("handoffs", F.lit("")).alias("handoffs"), F.coalesce("total", F.lit(0)).alias("total"), (F.coalesce("sum", F.lit(0)) == F.coalesce("total", F.lit(0))).alias("checked"))


@add("f7_diverse_directions")
def diverse_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as directions of their customer: anchors by supplier, terms by part, six unlike ones of the dearest first."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set(F.col("l_suppkey") % 6)).alias("anchors"), F.sort_array(F.collect_set(F.col("l_partkey") % 20)).alias("terms"))
    rows = table(spark, sf_dir, "orders").join(items, "o_orderkey").select("o_custkey", (-F.col("o_totalprice")).alias("down"), "o_orderkey", "anchors", F.col("o_orderstatus").alias("stage"), "terms")
    return X.diverse_directions(rows, ["o_custkey"], ["down", "o_orderkey"], "anchors", "stage", "terms", 6).select("o_custkey", "o_orderkey", "selected")


@add("j2_role_contract", f"""WITH RECURSIVE cand AS (SELECT DISTINCT o_custkey AS scope, l_returnflag AS role, l_orderkey * 10 + l_linenumber AS anchor, p_brand AS file, l_quantity::BIGINT AS score, l_quantity::BIGINT AS fill FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
{choice_sql('cand', 'scope AS o_custkey, q.role, q.anchor, q.file, -q.down AS score, reason', {'R': 2, 'A': 1}, 3, 8)}""")
def role_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each customer as candidates for roles: two of one flag and one of the next reserved, eight in all, three of a part's brand."""
    met = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = met.select("o_custkey", F.col("l_returnflag").alias("role"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("anchor"), F.col("p_brand").alias("file"), F.col("l_quantity").cast("long").alias("score")).distinct()
    return X.role_contract(rows, ["o_custkey"], "role", "anchor", "file", "score", {"R": 2, "A": 1}, 3, 8).select("o_custkey", "role", "anchor", "file", "score", "reason")


@add("e27_candidate_paths", f"""WITH {FILES}, b AS (SELECT repo, path, part, regexp_extract(lower(path), '[^/]*$') AS base FROM files), r AS (SELECT repo, min(base) AS receiver FROM b WHERE ends_with(base, '.go') GROUP BY 1),
s AS (SELECT b.repo, path, CASE WHEN base = receiver THEN 100 ELSE 0 END + 20 * len(list_intersect(list_distinct(string_split_regex(base, '[^a-z0-9]+')), ['widget0', 'small', 'test'])) + 4 * len(list_intersect(list_distinct(string_split_regex(base, '[^a-z0-9]+')), ['cold', 'go'])) + CASE WHEN part % 10 = 0 THEN 8 ELSE 0 END AS score FROM b JOIN r USING (repo))
SELECT repo, path, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, path) AS rank FROM s) WHERE rank <= 5""")
def candidate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five files of each repository for a call whose receiver is its first Go file by name."""
    own = files(spark, sf_dir)
    base = F.element_at(F.split(F.lower("path"), "/"), -1)
    receivers = own.where(F.endswith(base, F.lit(".go"))).groupBy("repo").agg(F.min(base).alias("receiver"))
    words = lambda *of: F.array(*map(F.lit, of))
    score = L.candidate_path_score(F.col("path"), F.col("receiver"), words("widget0", "small", "test"), words("cold", "go"), F.col("part") % 10 == 0)
    return R.top_k(own.join(receivers, "repo").select("repo", "path", score.alias("score")), ["repo"], [F.desc("score"), F.col("path")], 5).select("repo", "path", "score", "rank")


@add("g8_critical_edges", f"""WITH RECURSIVE {EDGES}, one AS (SELECT src, dst FROM edges), walk(node, distance) AS (SELECT s_suppkey, 0 FROM supplier WHERE s_acctbal > 9000 UNION SELECT e.dst, w.distance + 1 FROM walk w JOIN one e ON e.src = w.node WHERE w.distance < 4), reach AS (SELECT node, min(distance) AS distance FROM walk GROUP BY 1),
tree AS (SELECT e.dst, d.distance, min(e.src) AS src FROM one e JOIN reach s ON s.node = e.src JOIN reach d ON d.node = e.dst WHERE d.distance = s.distance + 1 GROUP BY ALL), t AS (SELECT p_partkey + 1000000000 AS node, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS rank FROM part), goal AS (SELECT node, rank FROM t WHERE rank <= 200),
back(src, dst, distance, rank) AS (SELECT tree.src, tree.dst, tree.distance, rank FROM goal JOIN tree ON tree.dst = node UNION SELECT tree.src, tree.dst, tree.distance, b.rank FROM back b JOIN tree ON tree.dst = b.src), best AS (SELECT src, dst, distance, min(rank) AS rank FROM back GROUP BY ALL)
SELECT src, dst, distance, rank, position FROM (SELECT *, row_number() OVER (ORDER BY rank, distance, src, dst) AS position FROM best) WHERE position <= 60""")
def critical_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty edges at most on the way from the entries to the two hundred largest parts."""
    graph = S.settle(edges(spark, sf_dir).select("src", "dst"))
    targets = R.top_k(table(spark, sf_dir, "part").withColumn("__all", F.lit(0)), ["__all"], [F.desc("p_size"), F.col("p_partkey")], 200)
    return G.critical_edges(graph, _entries(spark, sf_dir), targets.select((F.col("p_partkey") + 1_000_000_000).alias("node"), "rank"), 4, 60)
