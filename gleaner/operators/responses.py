"""Evaluation of saved responses: directions by their aliases, grounding, evidence, drill-down and tripwires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.ranking import top_k

#: Endings by which a piece of evidence reads as a path.
PATH_ENDS = ["go", "md", "yaml", "yml", "json", "toml", "proto", "mod", "sum", "sh", "c", "h", "rs", "py", "js", "ts"]


def _relative(path: Column) -> Column:
    """A clean path inside the repository."""
    return (path != "") & ~F.startswith(path, F.lit("/")) & ~path.rlike(r"(^|/)\.\.?(/|$)|//|/$|\\|^[A-Za-z]:")


def reads_as_path(value: Column) -> Column:
    return _relative(value) & ~value.rlike(r"[\s*?\[\]]") & F.lower(F.regexp_extract(value, r"\.([A-Za-z0-9]+)$", 1)).isin(PATH_ENDS)


def flow_paths(files: Column, evidence: Column, entry: Column) -> Column:
    """All paths that a flow stands on: its files, evidence that may be a path, and an entry that is a Go file."""
    none = F.array().cast("array<string>")
    entries = F.when(F.endswith(F.lower(entry), F.lit(".go")), F.array(entry)).otherwise(none)
    return F.array_distinct(F.array_compact(F.concat(F.coalesce(files, none), F.filter(F.coalesce(evidence, none), _relative), F.coalesce(entries, none))))


def direction_checks(directions: DataFrame, flows: DataFrame) -> DataFrame:
    """(task, direction, matched, alias, flow, found, missing): which flow answers each direction.

    directions (task, direction, aliases, paths), flows (task, name, confidence, files, evidence, entry).  A flow matches by the
    first alias that its name holds, whatever the case.  Of several the one that has all important paths, then most of them,
    then the highest confidence, then the least name is chosen; matched counts all, found and missing hold the important paths.
    """
    return _answers(directions, flows, None).drop("linked")


def _answers(directions: DataFrame, flows: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """direction_checks() with linked: whether a flow of the chosen name stands on one of the paths that `wanted` (task, path)
    has for the task.  Flows of one name match one alias, so all of them meet here, and flows move once."""
    none = F.array().cast("array<string>")
    named = directions.select("task", "direction", "aliases", F.array_distinct(F.coalesce("paths", none)).alias("paths"))
    if wanted is None:
        sought = named.withColumn("__sought", none)
    else:
        sought = named.join(wanted.groupBy("task").agg(F.collect_set("path").alias("__sought")), "task", "left")
    met = sought.join(flows.where("name is not null"), "task")
    met = met.withColumn("alias", F.get(F.filter("aliases", lambda a: F.contains(F.lower("name"), F.lower(a))), F.lit(0))).where("alias is not null")
    met = met.withColumn("__on", flow_paths(F.col("files"), F.col("evidence"), F.col("entry")))
    met = met.select("task", "direction", "alias", "name", "confidence", F.array_intersect("paths", "__on").alias("held"), F.coalesce(F.arrays_overlap("__sought", "__on"), F.lit(False)).alias("linked"))
    of = Window.partitionBy("task", "direction")
    met = met.withColumn("matched", F.count("*").over(of)).withColumn("linked", F.max("linked").over(Window.partitionBy("task", "direction", "name")))
    order = [F.desc(F.size("held")), F.desc_nulls_last("confidence"), F.col("name")]  # all important paths are also most of them
    best = top_k(met, ["task", "direction"], order, 1, "__k").drop("__k")
    out = named.join(best, ["task", "direction"], "left")
    found = F.coalesce("held", none)
    return out.select("task", "direction", F.coalesce("matched", F.lit(0)).alias("matched"), "alias", F.col("name").alias("flow"), F.array_sort(found).alias("found"), F.array_sort(F.array_except("paths", found)).alias("missing"), F.coalesce("linked", F.lit(False)).alias("linked"))


def grounding(first: DataFrame, flows: DataFrame, allowed: DataFrame) -> DataFrame:
    """(task, referenced, invalid, unscored): distinct paths that a response refers to, those not allowed, and pieces of
    evidence that are no paths.

    first (task, path), flows as in direction_checks, allowed (task, path).  Evidence counts as a path if it is allowed or
    reads as one; every other piece is prose and is only counted.  All of them meet once, by task and path.
    """
    none = F.array().cast("array<string>")
    marked = lambda ref, maybe, known: F.struct(F.lit(ref).alias("ref"), F.lit(maybe).cast("long").alias("maybe"), F.lit(known).alias("known"))
    piece = lambda p: F.struct(p.alias("path"), F.when(F.coalesce(reads_as_path(p), F.lit(False)), marked(True, 0, False)).otherwise(marked(False, 1, False)).alias("m"))
    sure = lambda p: F.struct(p.alias("path"), marked(True, 0, False).alias("m"))
    entries = F.when(F.like(F.lower("entry"), F.lit("%.go")), F.array(F.col("entry"))).otherwise(none)
    told = F.concat(F.transform(F.coalesce("files", none), sure), F.transform(F.coalesce(entries, none), sure), F.transform(F.coalesce("evidence", none), piece))
    rows = flows.select("task", F.explode(told).alias("t")).select("task", "t.path", "t.m")
    rows = rows.union(first.select("task", "path", marked(True, 0, False))).union(allowed.select("task", "path", marked(False, 0, True)))
    once = rows.groupBy("task", "path").agg(F.max("m.ref").alias("ref"), F.sum("m.maybe").alias("maybe"), F.max("m.known").alias("known"))
    known = F.col("known") & F.col("path").isNotNull()
    named = F.col("path").isNotNull() & (F.col("ref") | (known & (F.col("maybe") > 0)))
    return once.groupBy("task").agg(
        F.count_if(named).alias("referenced"), F.count_if(named & ~known).alias("invalid"), F.coalesce(F.sum(F.when(~known, F.col("maybe"))), F.lit(0)).alias("unscored"), F.max("ref").alias("__ref"), F.max("maybe").alias("__maybe")
    ).where("__ref or __maybe > 0").drop("__ref", "__maybe")


def tripwires(forbidden: DataFrame, said: DataFrame) -> DataFrame:
    """(task, id, triggered): whether any text of the scope holds all fragments, whatever the case; said (task, scope, text)."""
    low = said.groupBy("task", "scope").agg(F.collect_list(F.lower("text")).alias("__texts"))
    met = forbidden.join(low, ["task", "scope"], "left")
    holds = F.exists(F.coalesce("__texts", F.array().cast("array<string>")), lambda t: F.forall("contains_all", lambda c: F.contains(t, F.lower(c))))
    return met.select("task", "id", F.coalesce(holds & (F.size("contains_all") > 0), F.lit(False)).alias("triggered"))


def evaluate(tasks: DataFrame, directions: DataFrame, flows: DataFrame, first: DataFrame, allowed: DataFrame, drilldowns: DataFrame, forbidden: DataFrame, said: DataFrame) -> DataFrame:
    """A row a task (tasks: task): what its response covers, and whether all of it holds.

    expected, missing and ambiguous directions (ambiguous: matched by several flows); important paths missing; referenced
    and invalid paths; linked: whether a chosen flow has the drill-down's path; drilled: whether symbol, path, test target,
    predicates and test paths are those expected and it is linked; triggered tripwires; passed.

    drilldowns (task, symbol, path, seen_symbol, seen_path, test_target, predicates, seen_predicates, tests, seen_tests): a task
    without one is not drilled.  All sides are summed by task before they meet.
    """
    checks = _answers(directions, flows, drilldowns.select("task", "path"))
    covered = checks.groupBy("task").agg(
        F.count("*").alias("expected"), F.count_if(F.col("matched") == 0).alias("missing"), F.count_if(F.col("matched") > 1).alias("ambiguous"), F.sum(F.size("missing")).alias("missing_paths"), F.max("linked").alias("linked")
    )
    within = lambda a, b: F.size(F.array_except(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))) == 0
    right = F.equal_null("symbol", "seen_symbol") & F.equal_null("path", "seen_path") & F.equal_null("symbol", "test_target") & within("predicates", "seen_predicates") & within("tests", "seen_tests")
    drilled = drilldowns.groupBy("task").agg(F.bool_and(right).alias("right"))
    wires = tripwires(forbidden, said).groupBy("task").agg(F.count_if("triggered").alias("triggered"))
    out = tasks.select("task").distinct()
    for side in (covered, grounding(first, flows, allowed), drilled, wires):
        out = out.join(side, "task", "left")
    numbers = ("expected", "missing", "ambiguous", "missing_paths", "referenced", "invalid", "triggered")
    out = out.select("task", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce("linked", F.lit(False)).alias("linked"), (F.coalesce("linked", F.lit(False)) & F.coalesce("right", F.lit(False))).alias("drilled"))
    return out.withColumn("passed", (F.col("missing") == 0) & (F.col("ambiguous") == 0) & (F.col("missing_paths") == 0) & (F.col("invalid") == 0) & F.col("drilled") & (F.col("triggered") == 0))
