"""Queries over paths, names and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import paths as P
from gleaner.functions import text as X
from gleaner.operators import ranking as R
from gleaner.plans.bindings import FILES, Registry, files, table

registry = Registry()
add = registry.add


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _seg(values: list[str]) -> str:
    return f"list_has_any(string_split(low, '/'), {values})"


def _word(values: list[str]) -> str:
    return f"list_has_any(string_split_regex(low, '[/_.\\-]+'), {values})"


ROLE = f"""parts AS (SELECT *, lower(path) AS low, string_split(lower(path), '/')[-1] AS base, regexp_extract(lower(path), '(\\.[^./]*)$', 1) AS ext FROM files),
roles AS (SELECT *, CASE
  WHEN regexp_matches(base, '\\.pb\\.go$|\\.pb\\.gw\\.go$|^zz_generated') OR {_seg(P.GENERATED_DIRS)} THEN 'generated'
  WHEN {_seg(P.FIXTURE_DIRS)} THEN 'fixture'
  WHEN regexp_matches(base, '_test\\.go$|^test_|_test\\.py$') OR regexp_matches('/' || low || '/', '/(test|tests|testing|[^/]*-test|[^/]*_test)/') THEN 'test'
  WHEN {_word(P.PLAYGROUND_WORDS)} THEN 'playground_preview_evaluator'
  WHEN {_seg(P.EXAMPLE_DIRS)} THEN 'example'
  WHEN {_seg(P.EXPERIMENT_DIRS)} THEN 'experimental'
  WHEN {_seg(P.TOOLING_DIRS)} THEN 'tooling'
  WHEN ext IN {_in(P.DOCUMENT_EXTENSIONS)} OR base IN {_in(P.DOCUMENT_NAMES)} THEN
    CASE WHEN {_seg(P.HISTORY_DIRS)} OR regexp_matches(regexp_replace(base, '\\.[^.]*$', ''), '^(decision-|adr-)|^[0-9].{{3}}') THEN 'historical_decision_documentation' ELSE 'current_documentation' END
  WHEN base IN {_in(P.MAIN_NAMES)} OR regexp_matches(low, '(^|/)(cmd|bin)/') THEN 'primary_production_entry'
  WHEN {_seg(P.API_DIRS)} THEN 'public_api'
  WHEN {_seg(P.EFFECT_DIRS)} OR {_word(P.EFFECT_WORDS)} THEN 'effect_integration_boundary'
  ELSE 'production_core' END AS role FROM parts)"""
PRIORITY = "CASE role " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in P.ROLE_PRIORITY.items()) + " ELSE 0 END"
SKIP = f"""CASE WHEN regexp_matches(lower(path), '(^|/)\\.env') THEN 'env'
  WHEN regexp_matches(lower(path), '(^|/)({"|".join(d.replace(".", chr(92) + ".") for d in P.SKIPPED_DIRS)})') THEN 'directory'
  WHEN regexp_extract(lower(path), '(\\.[^./]*)$', 1) IN {_in(P.BINARY_EXTENSIONS)} THEN 'binary' WHEN regexp_extract(lower(path), '(\\.[^./]*)$', 1) IN {_in(P.SECRET_EXTENSIONS)} THEN 'secret' END"""


@add("a1_file_listing", f"WITH {FILES} SELECT DISTINCT repo, path, size % 3 <> 2 AS is_regular FROM files")
def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index records (mode, stage, path) as distinct paths; regular ones have stage 0 and a file mode."""
    from gleaner.sources.listing import read_listing

    mode = F.when(F.col("size") % 3 == 0, "100644").when(F.col("size") % 3 == 1, "100755").otherwise("120000")
    records = files(spark, sf_dir).select("repo", F.concat_ws("\t", F.concat(mode, F.lit(" "), F.sha1("path"), F.lit(" 0")), "path").alias("record"))
    return read_listing(records, ["repo"], "record").select("repo", "path", "is_regular")


@add("a2_path_filter", f"WITH {FILES} SELECT repo, coalesce({SKIP}, 'kept') AS outcome, count(*) AS n FROM files GROUP BY ALL")
def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.coalesce(P.skip_reason(F.col("path")), F.lit("kept"))
    return files(spark, sf_dir).groupBy("repo", reason.alias("outcome")).agg(F.count("*").alias("n"))


@add("b1_artifact_role", f"WITH {FILES}, {ROLE} SELECT repo, path, role FROM roles")
def artifact_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("repo", "path", P.artifact_role(F.col("path")).alias("role"))


@add("b2_role_priority", f"WITH {FILES}, {ROLE} SELECT role, {PRIORITY} AS priority, role IN {_in(P.PRODUCTION_ROLES)} AS production, count(*) AS n FROM roles GROUP BY ALL")
def role_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.col("role")
    found = files(spark, sf_dir).select(P.artifact_role(F.col("path")).alias("role"))
    return found.groupBy("role", P.role_priority(role).alias("priority"), P.is_production(role).alias("production")).agg(F.count("*").alias("n"))


@add("b3_source_or_document", f"WITH {FILES}, {ROLE} SELECT path, ext IN {_in(P.SOURCE_EXTENSIONS)} AS is_source, ext IN {_in(P.DOCUMENT_EXTENSIONS)} OR base IN {_in(P.DOCUMENT_NAMES)} AS is_document FROM parts")
def source_or_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", P.is_source(F.col("path")).alias("is_source"), P.is_document(F.col("path")).alias("is_document"))


@add("b4_language_counts", f"WITH {FILES}, {ROLE} SELECT CASE ext {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in P.LANGUAGES.items())} END AS language, count(*) AS n FROM parts GROUP BY ALL HAVING language IS NOT NULL")
def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).groupBy(P.language(F.col("path")).alias("language")).agg(F.count("*").alias("n")).where("language is not null")


@add("b8_import_family", "SELECT url, CASE WHEN contains(p[1], '.') THEN array_to_string(p[1:3], '/') ELSE p[1] END AS family, contains(p[1], '.') AS hosted FROM (SELECT url, string_split(regexp_replace(url, '^https?://', ''), '/') AS p FROM pages)")
def import_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf_dir, "pages").select("url", P.import_family(path).alias("family"), P.is_hosted(path).alias("hosted"))


@add("b9_external_imports", """WITH p AS (SELECT DISTINCT regexp_replace(url, '^https?://', '') AS path FROM pages), own AS (SELECT DISTINCT string_split(path, '/')[1] AS module FROM p WHERE path LIKE 'blog.%')
SELECT path FROM p WHERE contains(string_split(path, '/')[1], '.') AND NOT EXISTS (SELECT 1 FROM own WHERE module = string_split(path, '/')[1])""")
def external_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosted imports that aren't under one of the repository's own modules."""
    imports = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path")).distinct()
    module = F.element_at(P.segments(F.col("path")), 1)
    own = imports.where("path like 'blog.%'").select(module.alias("module")).distinct()
    return imports.where(P.is_hosted(F.col("path"))).withColumn("module", module).join(own, "module", "left_anti").select("path")


@add("b10_path_family", f"WITH {FILES} SELECT CASE WHEN s[1] IN ('internal', 'pkg') AND len(s) > 1 THEN s[2] ELSE s[1] END AS family, count(*) AS n FROM (SELECT string_split(path, '/') AS s FROM files) GROUP BY ALL")
def path_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).groupBy(P.path_family(F.col("path")).alias("family")).agg(F.count("*").alias("n"))


@add("b11_path_tier", f"WITH {FILES}, {ROLE} SELECT path, CASE WHEN role IN {_in(P.PRODUCTION_ROLES)} THEN 0 WHEN role = 'generated' THEN 4 WHEN role IN ('test', 'fixture') THEN 3 WHEN role IN ('example', 'tooling', 'experimental', 'playground_preview_evaluator') THEN 2 ELSE 1 END AS tier FROM roles")
def path_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", P.path_tier(F.col("path")).alias("tier"))


@add("b14_endpoint_key", """WITH u AS (SELECT url, regexp_extract(url, '^([a-z]+)://', 1) AS s, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS h, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages)
SELECT url, s || '://' || h || p || CASE WHEN q = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(q, '&')), '&') END AS endpoint FROM u""")
def endpoint_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("url", X.endpoint(F.col("url")).alias("endpoint"))


@add("b15_slug", """SELECT p_partkey, CASE WHEN w = '' THEN 'flow-' || substr(sha256(n), 1, 12) ELSE w END AS slug FROM (
  SELECT p_partkey, n, regexp_replace(regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS w FROM (SELECT p_partkey, CASE WHEN p_size = 1 THEN '***' ELSE p_type || ' / ' || p_name END AS n FROM part))""")
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_size") == 1, "***").otherwise(F.concat("p_type", F.lit(" / "), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", X.slug(name).alias("slug"))


@add("b16_safe_paths", """SELECT p, length(p) > 0 AND NOT regexp_matches(p, '[\\x00-\\x1f\\x7f\\\\]') AND NOT regexp_matches(p, '^/|/$|//') AND NOT regexp_matches('/' || p || '/', '/\\.{1,2}/') AS safe
FROM (SELECT DISTINCT regexp_replace(url, '^https?://[^/]*', CASE WHEN page_id % 2 = 0 THEN '' ELSE 'a/..' END) AS p FROM pages)""")
def safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("page_id") % 2 == 0, "").otherwise("a/..")
    made = table(spark, sf_dir, "pages").select(F.concat(head, F.regexp_extract("url", r"^https?://[^/]*(.*)$", 1)).alias("p")).distinct()
    return made.select("p", P.is_safe_path(F.col("p")).alias("safe"))


@add("d1_top_directories", f"WITH {FILES} SELECT repo, string_split(path, '/')[1] AS directory, count(*) AS n FROM files GROUP BY ALL")
def top_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).groupBy("repo", F.element_at(P.segments(F.col("path")), 1).alias("directory")).agg(F.count("*").alias("n"))


@add("e3_role_interleave", f"""WITH {FILES}, {ROLE}, p AS (SELECT repo, path, role, {PRIORITY} AS pr FROM roles), t AS (SELECT *, row_number() OVER (PARTITION BY repo, role ORDER BY len(string_split(path, '/')), path) AS turn FROM p)
SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY CASE WHEN role IN {_in(P.PRODUCTION_ROLES)} THEN 0 ELSE 1 END, turn, -pr, len(string_split(path, '/')), path) AS position FROM t""")
def role_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.col("role")
    rows = files(spark, sf_dir).withColumn("role", P.artifact_role(F.col("path")))
    found = R.interleave(rows, ["repo"], "role", F.when(P.is_production(role), 0).otherwise(1), -P.role_priority(role), [P.depth(F.col("path")), F.col("path")])
    return found.select("repo", "path", "position")


@add("e5_role_quota", f"""WITH {FILES}, {ROLE}, t AS (SELECT repo, path, part, row_number() OVER (PARTITION BY repo, role ORDER BY size DESC, part) <= 2 AS reserved, size FROM roles),
o AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY reserved DESC, size DESC, part) AS position FROM t) SELECT repo, path, reserved, position FROM o WHERE position <= 12""")
def role_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).withColumn("role", P.artifact_role(F.col("path")))
    return R.quota_then_fill(rows, ["repo"], "role", [F.desc("size"), F.col("part")], 2, 12).select("repo", "path", "reserved", "position")


@add("g15_directory_distance", f"""WITH {FILES}, a AS (SELECT repo, min(path) AS p FROM files GROUP BY repo), j AS (SELECT f.path, a.p, string_split(f.path, '/')[:-2] AS x, string_split(a.p, '/')[:-2] AS y FROM files f JOIN a USING (repo))
SELECT path, len(x) + len(y) - 2 * (CASE WHEN x[1] = y[1] THEN CASE WHEN x[2] = y[2] THEN 2 ELSE 1 END ELSE 0 END) AS distance FROM j""")
def directory_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    first = rows.groupBy("repo").agg(F.min("path").alias("p"))
    return rows.join(first, "repo").select("path", P.directory_distance(F.col("path"), F.col("p")).cast("long").alias("distance"))


@add("h12_stable_ids", "SELECT o_orderkey, sha256(array_to_string(list_sort(list_distinct(list(CAST(l_partkey AS VARCHAR)))), chr(0))) AS id FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return items.groupBy("o_orderkey").agg(X.set_digest(F.collect_set(F.col("l_partkey").cast("string"))).alias("id"))


@add("h16_identifier_words", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name) || ' ' || lower(p_brand), '[^a-z0-9]+', ' ', 'g'), '^ | $', '', 'g') AS words FROM part")
def identifier_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.initcap("p_name"), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.identifier_words(name), " ").alias("words"))


@add("h17_stems", """SELECT DISTINCT w, CASE WHEN length(w) > 5 AND w LIKE '%ies' THEN w[:-4] || 'y' WHEN length(w) > 5 AND w LIKE '%ing' THEN w[:-4] WHEN length(w) > 4 AND w LIKE '%ed' THEN w[:-2]
  WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END AS stem FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations)""")
def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    return words.select("w", X.stem(F.col("w")).alias("stem"))


@add("h18_snake_case", "SELECT p_partkey, lower(regexp_replace(regexp_replace(p_type || p_brand, '#', '', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS name FROM part")
def snake_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.snake_case(F.regexp_replace(F.concat("p_type", "p_brand"), "#", "")).alias("name"))


@add("b6_task_kind", "WITH t AS (SELECT item_id, ' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{Nd}_]+', ' ', 'g')) || ' ' AS p FROM benchmark) SELECT item_id, CASE " + " ".join("WHEN " + " OR ".join([f"contains(p, ' {x} ')" for x in ph + wo] + [f"contains(p, ' {x}')" for x in pre]) + f" THEN '{k}'" for k, ph, wo, pre in X.TASK_RULES) + " ELSE 'unknown' END AS kind FROM t")
def task_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", X.task_kind(F.col("text")).alias("kind"))


@add("h8_redact_secrets", r"""SELECT doc_id, len(regexp_extract_all(text, '(?i)\b(?:api[_-]?key|token|secret|password|passwd)\s*[:=]\s*"?[A-Za-z0-9_\-./+]{8,}|\bbearer\s+[A-Za-z0-9_\-.=]{8,}|\b(?:ghp_|sk-|akia)[A-Za-z0-9]{10,}')) AS secrets,
  sha256(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\b(api[_-]?key|token|secret|password|passwd)(\s*[:=]\s*"?)[A-Za-z0-9_\-./+]{8,}', '\1\2[redacted]', 'g'), '(?i)\bbearer\s+[A-Za-z0-9_\-.=]{8,}', 'Bearer [redacted]', 'g'), '\b(ghp_|sk-|AKIA)[A-Za-z0-9]{10,}', '[redacted]', 'g')) AS redacted_sha256 FROM documents""")
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.secret_count(F.col("text")).cast("long").alias("secrets"), F.sha2(X.redact(F.col("text")), 256).alias("redacted_sha256"))


@add("h10_tripwire", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') AND contains(lower(text), 'mit')")
def tripwire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(X.holds_all(F.col("text"), F.array(F.lit("License"), F.lit("MIT")))).select("doc_id")


@add("h11_snippets", r"SELECT conv_id, turn, CASE WHEN length(s) > 60 THEN substr(s, 1, 57) || '...' ELSE s END AS snippet FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM conversations)")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.squeeze(F.col("text"), 60).alias("snippet"))
