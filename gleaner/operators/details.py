"""Owners, spreads, duplicates, checks and differences that follow several rules at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.ranking import top_k
from gleaner.operators.sets import keep_first, overlaps, settle


def declared_owners(declarations: DataFrame, members: DataFrame, files: DataFrame, packages: DataFrame) -> DataFrame:
    """(declaration, tier, owners): who owns each declaration: 0 by the declaration itself, 1 by its file's package; null
    without any.  All owners of the first tier that has one, sorted, so none, one and several stay apart.

    declarations (declaration, symbol, path, line, column), members (symbol, path, line, column, owner), files (path, package),
    packages (package, owner).  Symbol, path and line must agree; a column of 0 on either side agrees with any.
    """
    d, m = declarations.select("declaration", "symbol", "path", "line", F.col("column").alias("__d")), members.select("symbol", "path", "line", F.col("column").alias("__m"), "owner")
    exact = d.join(m, ["symbol", "path", "line"]).where("__d = 0 or __m = 0 or __d = __m").where("owner is not null")
    per_path = files.select("path", "package").distinct().join(packages.select("package", "owner").where("owner is not null").distinct(), "package").groupBy("path").agg(F.collect_set("owner").alias("__near"))
    none = F.array().cast(per_path.schema["__near"].dataType)
    second = declarations.select("declaration", "path").join(per_path, "path", "left").select("declaration", F.lit(None).cast(members.schema["owner"].dataType).alias("owner"), F.when(F.col("declaration").isNotNull(), F.col("__near")).alias("__near"))
    told = second.union(exact.where("declaration is not null").select("declaration", "owner", F.lit(None).cast(per_path.schema["__near"].dataType)))
    met = told.groupBy("declaration").agg(F.collect_set("owner").alias("__own"), F.flatten(F.collect_set("__near")).alias("__near"))
    tier = F.when(F.size("__own") > 0, 0).when(F.size("__near") > 0, 1)
    return met.select("declaration", tier.alias("tier"), F.when(tier == 0, F.array_sort("__own")).when(tier == 1, F.array_sort(F.array_distinct("__near"))).otherwise(none).alias("owners"))


def spread_positions(rows: DataFrame, group: list[str], order: list[Column], quotas: DataFrame) -> DataFrame:
    """rows chosen with turn (from 1): of each group as many as its quota (quotas: group, quota), in fixed order of place:
    the middle, the ends, the quarters, the thirds, then what is left from the front."""
    at = Window.partitionBy(*group)
    placed = rows.join(quotas.select(*group, "quota"), group).withColumn("__i", F.row_number().over(at.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(at))
    n = F.col("__n")
    first = F.array_distinct(F.array(*(F.floor(x).cast("long") for x in (n / 2, F.lit(0), n - 1, n / 4, 3 * (n - 1) / 4, n / 3, 2 * (n - 1) / 3))))
    turn = F.array_position(first, F.col("__i").cast("long"))
    ranked = placed.withColumn("turn", F.row_number().over(at.orderBy(F.when(turn > 0, turn).otherwise(8), "__i")))
    return ranked.where(F.col("turn") <= F.col("quota")).drop("__i", "__n", "quota")


def first_opportunities(rows: DataFrame, support: DataFrame, kind: str, id_col: str, rank: str, text: Column, threshold: float = 0.75) -> DataFrame:
    """Rows left when, in order of rank, a row goes if one that stays has its kind and the same text, whatever case and
    blanks, or support sets (support: id, member) of that Jaccard similarity.  Ranks are unique within a kind; empty
    support is like nothing.

    Of rows with one text, all behind the first one without a support neighbour go for sure, as it stays or goes for an equal
    one; only the rows before it, all of them support neighbours, are paired by text.
    """
    said = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    own = rows.withColumn("__text", F.xxhash64(said)).withColumn("__said", said)
    pairs = settle(overlaps(rows.select(kind, id_col).join(support.select(F.col(support.columns[0]).alias(id_col), F.col(support.columns[1]).alias("__m")), id_col), [kind], id_col, "__m", threshold).select("a", "b"))
    near = pairs.select(F.col("a").alias(id_col)).union(pairs.select("b")).distinct().withColumn("__near", F.lit(True))
    known = own.join(near, id_col, "left")
    alone = F.min(F.when(F.col("__near").isNull(), F.col(rank))).over(Window.partitionBy(kind, "__text", "__said"))
    left = settle(known.withColumn("__stop", alone).where(F.col("__stop").isNull() | (F.col(rank) <= F.col("__stop"))).select(*rows.columns, "__text", "__said"))
    a = left.select(kind, "__text", "__said", F.col(id_col).alias("a"))
    equal = a.join(a.withColumnRenamed("a", "b"), [kind, "__text", "__said"]).where("a < b").select("a", "b")
    here = left.select(F.col(id_col).alias("a"))
    among = pairs.join(here, "a", "left_semi").join(here.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b")
    return keep_first(left.select(*rows.columns), among.union(equal).distinct(), id_col, rank)


def relation_violations(relations: DataFrame, nodes: DataFrame, kinds: list[str], resolutions: list[str], scenarios: DataFrame) -> DataFrame:
    """(code, id): what is wrong with relations (id, src, dst, kind, resolution, provider, operation, scenario) of a graph:
    unknown_src, unknown_dst, bad_kind, bad_resolution, no_provenance (a blank provider or operation), unknown_scenario, and
    duplicate_edge (another relation of a lesser id has its ends and kind)."""
    known, named = nodes.select("node").distinct(), scenarios.select("scenario").distinct()
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    lost = [relations.join(known.withColumnRenamed("node", end), end, "left_anti").select(F.lit(f"unknown_{end}").alias("code"), "id") for end in ("src", "dst")]
    rules = [("bad_kind", ~F.coalesce(F.col("kind").isin(kinds), F.lit(False))), ("bad_resolution", ~F.coalesce(F.col("resolution").isin(resolutions), F.lit(False))), ("no_provenance", blank("provider") | blank("operation"))]
    told = F.explode(F.array_compact(F.array(*(F.when(rule, code) for code, rule in rules))))
    far = relations.where("scenario is not null").join(named, "scenario", "left_anti").select(F.lit("unknown_scenario").alias("code"), "id")
    twice = relations.withColumn("__k", F.row_number().over(Window.partitionBy("src", "dst", "kind").orderBy("id"))).where("__k > 1").select(F.lit("duplicate_edge").alias("code"), "id")
    return reduce(DataFrame.union, [*lost, relations.select(told.alias("code"), "id"), far, twice])


#: Fixed rules: what the name of a callee tells, first one that holds; delegation is a callee of the caller's own name.
NAME_RULES = [("validation_name", "check|validat"), ("error_translation_name", "error"), ("delegation_name", None), ("response_enrichment_name", "fill|header|enrich"), ("persistence_name", "^save|store|persist|commit"), ("io_name", "sync|flush|fsync|read|write")]
#: Fixed order in which signals are shown.
NAME_ORDER = ["validation_name", "delegation_name", "error_translation_name", "response_enrichment_name", "persistence_name", "io_name", "coordination_name", "other"]


def name_signal(callee: Column, target: Column) -> Column:
    """The signal of a callee's name for a caller `target` (its last dotted part counts), or null."""
    name, own = F.lower(callee), F.lower(F.element_at(F.split(target, r"\."), -1))
    return F.coalesce(*(F.when(name == own if pattern is None else name.rlike(pattern), signal) for signal, pattern in NAME_RULES))


def import_usage(rows: DataFrame, scope: str, module: str, importer: str, name: str, most: int = 50, per_module: int = 10) -> DataFrame:
    """(scope, module, import, importers, rank): distinct importers of each import: the first `most` of a scope (module null)
    and the first per_module of each module, by importers, then name."""
    once = rows.select(scope, module, importer, name).where(F.col(name).isNotNull()).distinct()
    order = [F.desc("importers"), F.col(name)]
    whole = top_k(once.groupBy(scope, name).agg(F.count_distinct(importer).alias("importers")), [scope], order, most)
    own = top_k(once.groupBy(scope, module, name).agg(F.count_distinct(importer).alias("importers")), [scope, module], order, per_module)
    return whole.select(scope, F.lit(None).cast(rows.schema[module].dataType).alias(module), name, "importers", "rank").unionByName(own.select(scope, module, name, "importers", "rank"))


def coverage_counts(members: DataFrame, covered: DataFrame, scope: str) -> DataFrame:
    """(scope, requested, covered, uncovered, supporting): members of primary scope asked for and covered, and supporting ones covered.

    members (scope, member, primary, production, unit, parent), a row a member; covered (scope, member).  A primary member covers
    itself; a covered supporting one of production credits its parent, if that is a primary member of production of the same
    unit; the credit is coverage only, the parent does not become a covered member.
    """
    named = covered.select(scope, "member").distinct().withColumn("__c", F.lit(True))
    own = members.join(named, [scope, "member"], "left").withColumn("__c", F.coalesce("__c", F.lit(False)))
    up = members.where("primary and production").select(scope, F.col("member").alias("parent"), "unit")
    credit = own.where("__c and production and not primary and parent is not null").join(up, [scope, "parent", "unit"]).select(scope, F.col("parent").alias("member"))
    primary = own.where("__c and primary").select(scope, "member").union(credit).distinct().groupBy(scope).agg(F.count("*").alias("covered"))
    sums = own.groupBy(scope).agg(F.count_if("primary").alias("requested"), F.count_if(F.col("__c") & ~F.col("primary")).alias("supporting"))
    out = sums.join(primary, scope, "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return out.select(scope, "requested", "covered", (F.col("requested") - F.col("covered")).alias("uncovered"), "supporting")


def changed_paths(saved: DataFrame, current: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, path): paths of files (scope, path, from_path, sha256) that differ between two states or stand in one alone, and the
    paths they came from, of both sides.  A path stands once a state."""
    side = lambda df, name: df.select(*scope, "path", F.struct("from_path", "sha256").alias(name))
    met = side(saved, "__a").join(side(current, "__b"), [*scope, "path"], "full").where(~F.equal_null("__a", "__b"))
    every = met.select(*scope, F.explode(F.array("path", "__a.from_path", "__b.from_path")).alias("path"))
    return every.where("path is not null and path <> ''").distinct()


#: The shape of a saved retrieval trace.
TRACE = "kind string, candidates array<struct<id:long,path:string,score:long,roles:array<string>>>, selected array<struct<id:long,rank:int>>, dropped array<struct<id:long,reason:string>>"


def trace_rows(traces: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, id, path, score, roles, rank, reason, readable): a row a candidate of each saved trace (JSON), with its rank if it was
    selected and the reason if it was dropped; a trace that is no JSON of that shape has one row that is not readable."""
    read = traces.select(key, F.from_json(text, TRACE).alias("t"))
    good = read.where("t is not null and t.candidates is not null")
    found = good.select(key, "t.kind", F.explode("t.candidates").alias("c"), "t.selected", "t.dropped")
    own = lambda many, field: F.get(F.filter(many, lambda s: s["id"] == F.col("c.id")), F.lit(0))[field]
    rows = found.select(key, "kind", "c.id", "c.path", "c.score", "c.roles", own("selected", "rank").alias("rank"), own("dropped", "reason").alias("reason"), F.lit(True).alias("readable"))
    bad = read.where("t is null or t.candidates is null").select(key, *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns[1:-1]), F.lit(False).alias("readable"))
    return rows.unionByName(bad)


def trace_json(rows: DataFrame, key: str) -> DataFrame:
    """(key, text): the traces of trace_rows' readable rows, candidates by id, selected ones by rank."""
    c = F.array_sort(F.collect_list(F.struct("id", "path", "score", "roles")))
    s = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "id")))), lambda x: F.struct(x["id"].alias("id"), x["rank"].alias("rank")))
    d = F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("id", "reason"))))
    told = rows.where("readable").groupBy(key).agg(F.first("kind").alias("kind"), c.alias("candidates"), s.alias("selected"), d.alias("dropped"))
    return told.select(key, F.to_json(F.struct("kind", "candidates", "selected", "dropped")).alias("text"))


def acceptance_matrix(repositories: DataFrame, runs: DataFrame, stages: DataFrame, required: list[str]) -> DataFrame:
    """(repository, run, status, reasons, states, calls, latency, bytes): the run that speaks for each repository, and how it went.

    repositories (repository, run: a run asked for, or null), runs (run, repository, created), stages (run, stage, state, calls,
    latency_ms, request_bytes), a row a stage.  Asked for nothing, the newest run counts, of equally new ones the largest id.  status: MISSING without a
    run, SHARED if two repositories ask for the same one, FAILED if a required stage is absent or failed, DEGRADED if any other
    stage did not succeed, READY.  reasons and states are by stage, `stage:state` joined by commas; sums of a run without stages are 0.
    """
    own = runs.where("run is not null").groupBy("repository").agg(F.max(F.struct("created", "run"))["run"].alias("__newest"))
    known = runs.select(F.col("run").alias("__known")).distinct()
    picked = repositories.join(own, "repository", "left").select("repository", F.coalesce("run", "__newest").alias("__asked")).join(known, F.col("__asked") == F.col("__known"), "left").select("repository", F.col("__known").alias("run"))
    shared = picked.where("run is not null").groupBy("run").agg((F.count("*") > 1).alias("__shared"))
    needed = F.array(*map(F.lit, required)).cast("array<string>")
    rows = stages.groupBy("run", "stage").agg(F.max("state").alias("state"), F.sum("calls").alias("calls"), F.sum("latency_ms").alias("latency"), F.sum("request_bytes").alias("bytes"))
    rows = rows.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("stage", "state"))).alias("__s"), *(F.sum(c).alias(c) for c in ("calls", "latency", "bytes")))
    bad = lambda s: ~F.coalesce(s["state"] == "ok", F.lit(False))
    none = F.array().cast(rows.schema["__s"].dataType)
    out = picked.join(shared, "run", "left").join(rows, "run", "left").withColumn("__s", F.coalesce("__s", none))
    wrong = F.filter("__s", bad)
    absent = F.array_except(needed, F.transform("__s", lambda s: s["stage"]))
    failed = (F.size(absent) > 0) | F.exists(wrong, lambda s: F.array_contains(needed, s["stage"]))
    status = F.when(F.col("run").isNull(), "MISSING").when(F.col("__shared"), "SHARED").when(failed, "FAILED").when(F.size(wrong) > 0, "DEGRADED").otherwise("READY")
    tell = lambda many: F.transform(many, lambda s: F.concat_ws(":", s["stage"], F.coalesce(s["state"], F.lit("none"))))
    reasons = F.when(F.col("run").isNotNull(), F.array_join(F.array_sort(F.concat(tell(wrong), F.transform(absent, lambda s: F.concat(s, F.lit(":absent"))))), ",")).otherwise("")
    return out.select("repository", "run", status.alias("status"), reasons.alias("reasons"), F.array_join(tell("__s"), ",").alias("states"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("calls", "latency", "bytes")))


def atlas_tables(units: DataFrame, entities: DataFrame, observations: DataFrame) -> DataFrame:
    """(part, id, parent, kind, name): units, entities, observations and their evidence as one star table with stable ids, and what
    did not resolve.

    units (unit, kind), entities (unit, kind, name), observations (unit, entity_kind, entity, kind, detail, path, line).  An observation
    hangs on its entity and each place it was seen is a row of evidence below it, once; an entity of an unknown unit, or an
    observation of an unknown entity, is a row unresolved_entity or unresolved_observation instead, by its name.
    """
    from gleaner.functions.text import digest_of

    key = lambda *parts: digest_of(*(F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p, F.lit("")) for p in parts))
    u = units.where("unit is not null").groupBy("unit").agg(F.min("kind").alias("kind")).select(key(F.lit("unit"), "unit").alias("id"), "kind", "unit")
    u = settle(u)  # each table is worked out once, not for every part that reads it
    e = entities.where("unit is not null and name is not null").select("unit", "kind", "name").distinct().join(u.select("unit", F.col("id").alias("parent")), "unit", "left")
    e = e.select(F.when(F.col("parent").isNotNull(), key(F.lit("entity"), "unit", "kind", "name")).alias("id"), "parent", "kind", "name", "unit")
    e = settle(e)
    known = e.where("parent is not null").select("unit", F.col("kind").alias("entity_kind"), F.col("name").alias("entity"), F.col("id").alias("parent"))
    o = observations.select("unit", "entity_kind", "entity", "kind", "detail", "path", "line").distinct().join(known, ["unit", "entity_kind", "entity"], "left").withColumn("oid", key(F.lit("observation"), "parent", "kind", "detail"))
    o = settle(o)
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    seen = o.where("parent is not null")
    place = F.concat_ws(":", F.coalesce("path", F.lit("")), text("line"))
    parts = [
        u.select(F.lit("unit").alias("part"), "id", none.alias("parent"), "kind", text("unit").alias("name")),
        e.where("parent is not null").select(F.lit("entity"), "id", "parent", "kind", text("name")),
        seen.select(F.lit("observation"), F.col("oid").alias("id"), "parent", "kind", "detail").distinct(),
        seen.where("path is not null").select(F.lit("evidence"), key(F.lit("evidence"), "oid", "path", "line"), F.col("oid"), F.lit("location"), place).distinct(),
        e.where("parent is null").select(F.lit("unresolved_entity"), none, none, "kind", text("name")),
        o.where("parent is null").select(F.lit("unresolved_observation"), none, none, "kind", text("entity")).distinct(),
    ]
    return reduce(DataFrame.union, parts)
