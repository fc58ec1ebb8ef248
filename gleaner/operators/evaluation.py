"""Scores of saved results against expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(requested: DataFrame, covered: DataFrame, scope: list[str], item: str, role: str) -> DataFrame:
    """(scope, requested, covered, primary, supporting, uncovered) counts of requested items."""
    held = covered.groupBy(*scope, item).agg(F.bool_or(F.col(role) == "primary").alias("__p"))
    met = requested.select(*scope, item).distinct().join(held, [*scope, item], "left")
    hit = F.col("__p").isNotNull()
    return met.groupBy(*scope).agg(
        F.count("*").alias("requested"), F.count(F.when(hit, 1)).alias("covered"), F.count(F.when(F.col("__p"), 1)).alias("primary"), F.count(F.when(~F.col("__p"), 1)).alias("supporting"), F.count(F.when(~hit, 1)).alias("uncovered")
    )


def usage_rollup(log: DataFrame, levels: list[str], bytes_: str, latency: str) -> DataFrame:
    """Calls, bytes and latency by level with totals; unknown latencies are counted, never taken as 0."""
    return log.rollup(*levels).agg(F.count("*").alias("calls"), F.sum(bytes_).alias("bytes"), F.max(latency).alias("max_latency"), F.count(F.when(F.col(latency).isNull(), 1)).alias("unknown_latency"))


def scorecard(facts: DataFrame, checks: dict[str, tuple[Column, int]]) -> DataFrame:
    """(check, passed, total, target, ok) for each check: (condition, least count that must pass)."""
    total = facts.agg(F.count("*").alias("total"), *(F.count(F.when(c, 1)).alias(k) for k, (c, _) in checks.items()))
    rows = F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).alias("passed"), F.col("total"), F.lit(t).cast("long").alias("target"), (F.col(k) >= t).alias("ok")) for k, (_, t) in checks.items()))
    return total.select(F.inline(rows))


def weighted_score(checks: DataFrame, scope: list[str], passed: str, weight: str) -> DataFrame:
    """(scope, passed, total, score, max_score)."""
    return checks.groupBy(*scope).agg(F.count(F.when(F.col(passed), 1)).alias("passed"), F.count("*").alias("total"), F.sum(F.when(F.col(passed), F.col(weight)).otherwise(0)).alias("score"), F.sum(weight).alias("max_score"))


def loss_ledger(gold: DataFrame, key: list[str], generated: DataFrame, ranked: DataFrame, kept: DataFrame) -> DataFrame:
    """(key, disposition): where a wanted item was lost: never_generated, before_ranking, dropped or kept."""
    out = gold.select(*key).distinct()
    for name, df in (("__g", generated), ("__r", ranked), ("__k", kept)):
        out = out.join(df.select(*key).distinct().withColumn(name, F.lit(True)), key, "left")
    fate = F.when(F.col("__k"), "kept").when(F.col("__r"), "dropped").when(F.col("__g"), "before_ranking").otherwise("never_generated")
    return out.select(*key, fate.alias("disposition"))


def regressions(scores: DataFrame, key: list[str], version: str, before: str, after: str, score: str, floor: float) -> DataFrame:
    """(key, before, after, verdict): regression if it was at the floor or above and fell; improved, same or lower."""
    old = scores.where(F.col(version) == before).select(*key, F.col(score).alias("before"))
    new = scores.where(F.col(version) == after).select(*key, F.col(score).alias("after"))
    verdict = F.when((F.col("before") >= floor) & (F.col("after") < F.col("before")), "regression").when(F.col("after") > F.col("before"), "improved").when(F.col("after") == F.col("before"), "same").otherwise("lower")
    return old.join(new, key).withColumn("verdict", verdict)


def best_candidate(candidates: DataFrame, expectation: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    from gleaner.operators.ranking import top_k

    return top_k(candidates, expectation, order, 1).select(*expectation, *keep)


def status_fold(rows: DataFrame, scope: list[str], status: str, units: str) -> DataFrame:
    """(scope, units, status): not_run, accepted, failed or the one status all share; else partial."""
    seen = rows.groupBy(*scope).agg(F.sum(units).alias("units"), F.sort_array(F.collect_set(status)).alias("__s"))
    folded = F.when(F.size("__s") == 0, "not_run").when(F.size("__s") == 1, F.col("__s")[0]).when(F.array_contains("__s", "failed") & ~F.array_contains("__s", "accepted"), "failed").otherwise("partial")
    return seen.select(*scope, "units", folded.alias("status"))


def required_slots(slots: DataFrame, proofs: DataFrame, scope: list[str], slot: str) -> DataFrame:
    """(scope, proven, required, status): complete if every required slot has a proof, else partial or open."""
    met = slots.select(*scope, slot).distinct().join(proofs.select(*scope, slot).distinct().withColumn("__p", F.lit(1)), [*scope, slot], "left")
    out = met.groupBy(*scope).agg(F.count("__p").alias("proven"), F.count("*").alias("required"))
    return out.withColumn("status", F.when(F.col("proven") == F.col("required"), "complete").when(F.col("proven") > 0, "partial").otherwise("open"))


def concentration(rows: DataFrame, scope: list[str], family: str) -> DataFrame:
    """(scope, family, n, total): the family of more than half of a scope's rows, if it has two or more rows and
    isn't the only family."""
    per = rows.groupBy(*scope, family).agg(F.count("*").alias("n"))
    total = per.groupBy(*scope).agg(F.sum("n").alias("total"), F.count("*").alias("families"))
    return per.join(total, scope).where((F.col("n") * 2 > F.col("total")) & (F.col("n") >= 2) & (F.col("families") >= 2)).select(*scope, family, "n", "total")


def readiness(runs: DataFrame, key: list[str], failures: dict[str, Column], degradations: dict[str, Column]) -> DataFrame:
    """(key, state, reasons): FAILED with the failed conditions, else DEGRADED with the others, else READY."""
    listed = lambda rules: F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items())))
    bad, weak = listed(failures), listed(degradations)
    state = F.when(F.size(bad) > 0, "FAILED").when(F.size(weak) > 0, "DEGRADED").otherwise("READY")
    return runs.select(*key, state.alias("state"), F.array_join(F.when(F.size(bad) > 0, bad).otherwise(weak), ",").alias("reasons"))
