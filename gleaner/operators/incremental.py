"""What a change makes stale, and budgets over ordered work."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def context_diff(saved: DataFrame, current: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(key, status, reasons): missing, new, same or changed with the fields that differ, in order."""
    a = saved.select(*key, F.struct(*fields).alias("__a"))
    b = current.select(*key, F.struct(*fields).alias("__b"))
    both = a.join(b, key, "full_outer")
    reasons = F.array_join(F.array_compact(F.array(*(F.when(~F.col(f"__a.{f}").eqNullSafe(F.col(f"__b.{f}")), F.lit(f)) for f in fields))), ",")
    status = F.when(F.col("__a").isNull(), "new").when(F.col("__b").isNull(), "missing").when(reasons == "", "same").otherwise("changed")
    return both.select(*key, status.alias("status"), F.when(status == "changed", reasons).otherwise("").alias("reasons"))


def symmetric_difference(saved: DataFrame, current: DataFrame, on: list[str]) -> DataFrame:
    """(on, side): rows that stand on one side alone, with that side."""
    a, b = saved.select(*on).distinct(), current.select(*on).distinct()
    return a.join(b, on, "left_anti").withColumn("side", F.lit("saved")).union(b.join(a, on, "left_anti").withColumn("side", F.lit("current")))


def input_freshness(captured: DataFrame, current: DataFrame, owner: list[str], path: str, digest: str, scope: list[str] | None = None) -> DataFrame:
    """(owner, status, affected): fresh, unrelated (only inputs of other owners in the scope changed), partially_stale
    (some input changed or gone) or unavailable (all gone).  scope: columns of the owner; none: nothing is unrelated."""
    now = current.select(path, F.col(digest).alias("__now"))
    met = captured.join(now, path, "left")
    stale = F.count(F.when(~F.col(digest).eqNullSafe(F.col("__now")), 1))
    gone = F.count(F.when(F.col("__now").isNull(), 1))
    out = met.groupBy(*owner).agg(stale.alias("affected"), gone.alias("__gone"), F.count("*").alias("__n")).withColumn("__moved", F.lit(0))
    if scope:
        moved = out.groupBy(*scope).agg(F.sum("affected").alias("__moved"))
        out = out.drop("__moved").join(moved, scope)
    status = F.when((F.col("affected") == 0) & (F.col("__moved") > 0), "unrelated").when(F.col("affected") == 0, "fresh").when(F.col("__gone") == F.col("__n"), "unavailable").otherwise("partially_stale")
    return out.select(*owner, status.alias("status"), "affected")


def invalidate(bundles: DataFrame, cites: DataFrame, changed: DataFrame, bundle: str, path: str) -> DataFrame:
    """bundles without those that cite a changed path."""
    hit = cites.join(changed.select(path).distinct(), path, "left_semi").select(bundle).distinct()
    return bundles.join(hit, bundle, "left_anti")


def layered(repo: DataFrame, facts: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """(key, layer): the highest layer that changed makes all below it stale: repository, facts, claims or none.

    Each input is (key, changed boolean).
    """
    named = [df.select(key, F.col("changed").alias(n)) for df, n in ((repo, "r"), (facts, "f"), (claims, "c"))]
    met = named[0].join(named[1], key, "left").join(named[2], key, "left")
    return met.select(key, F.when(F.col("r"), "repository").when(F.col("f"), "facts").when(F.col("c"), "claims").otherwise("none").alias("layer"))


def cache_lookup(requests: DataFrame, cache: DataFrame, parts: list[str], value: str) -> DataFrame:
    """requests with fingerprint, hit and the cached value; a miss has null."""
    from gleaner.functions.text import digest_of

    keyed = requests.withColumn("fingerprint", digest_of(*(F.col(p).cast("string") for p in parts)))
    met = keyed.join(cache.select("fingerprint", F.col(value).alias("cached")), "fingerprint", "left")
    return met.withColumn("hit", F.col("cached").isNotNull())


def budget_gate(work: DataFrame, scope: list[str], order: list[str], size: str, most_calls: int, most_stage: int, most_total: int, stage: str) -> DataFrame:
    """work with allowed and reason: calls, stage_bytes or total_bytes, whichever running sum passes first.

    Running sums cover every row before, allowed or not, so a denial never makes room for a later row.
    """
    per = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    in_stage = Window.partitionBy(*scope, stage).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    reason = F.when(F.count("*").over(per) > most_calls, "calls").when(F.sum(size).over(in_stage) > most_stage, "stage_bytes").when(F.sum(size).over(per) > most_total, "total_bytes").otherwise("")
    return work.withColumn("reason", reason).withColumn("allowed", F.col("reason") == "")


def stalled(steps: DataFrame, scope: list[str], order: list[str], progress: str, limit: int) -> DataFrame:
    """(scope, streak, stalled): the longest run of steps without progress, and whether it reaches the limit."""
    w = Window.partitionBy(*scope).orderBy(*order)
    island = F.sum(F.when(F.col(progress), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = steps.withColumn("__i", island).where(~F.col(progress)).groupBy(*scope, "__i").agg(F.count("*").alias("n"))
    out = steps.select(*scope).distinct().join(runs.groupBy(*scope).agg(F.max("n").alias("streak")), scope, "left").na.fill(0, ["streak"])
    return out.withColumn("stalled", F.col("streak") >= limit)


def append_content(path: str, rows: DataFrame, key: str, existing: DataFrame | None = None) -> int:
    """Appends the rows whose key isn't there yet to the Parquet table at `path`; returns how many."""
    new = rows.dropDuplicates([key])
    if existing is not None:
        new = new.join(existing.select(key), key, "left_anti")
    new.write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path).count() - (existing.count() if existing is not None else 0)
