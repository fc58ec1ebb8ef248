"""Ranked selection under quotas and budgets, with an account of what was left out.

Windows are partitioned by the caller's group; Spark keeps the best n rows of each group in every task before a
group meets in one window, where n is below spark.sql.optimizer.windowGroupLimitThreshold; beyond, `limit_first`
keeps the best rows of each salt.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SALTS = 32
#: Rows of a group up to which Spark cuts them before the shuffle by itself.
FEW = 1000


def limit_first(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """At most n rows of each of SALTS parts of a group, which hold the group's best n."""
    salt = F.pmod(F.xxhash64(*(F.to_json(F.struct(c)) for c in rows.columns)), F.lit(SALTS))
    within = Window.partitionBy(*group, "__salt").orderBy(*order)
    return rows.withColumn("__salt", salt).withColumn("__k", F.row_number().over(within)).where(F.col("__k") <= n).drop("__salt", "__k")


def top_k(rows: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The best n rows of each group with their rank."""
    best = rows if n < FEW else limit_first(rows, group, order, n)
    return best.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def ranked(rows: DataFrame, group: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def omission_ledger(rows: DataFrame, group: list[str], order: list[Column], n: int, sample: str, samples: int = 3) -> DataFrame:
    """(group, eligible, selected, omitted, cutoff, omitted_sample) of a top-n selection; the sample holds the
    first rows left out, joined by commas, and eligible = selected + omitted."""
    totals = rows.groupBy(*group).agg(F.count("*").alias("eligible"))
    near = top_k(rows, group, order, n + samples).where(F.col("rank") > n)
    out = near.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(sample).cast("string").alias("v")))), lambda s: s["v"]), ",").alias("omitted_sample"))
    selected = F.least(F.col("eligible"), F.lit(n))
    counted = totals.select(*group, "eligible", selected.alias("selected"), (F.col("eligible") - selected).alias("omitted"))
    return counted.join(out, group, "left").withColumn("cutoff", F.when(F.col("omitted") > 0, "max_per_group").otherwise("none")).withColumn("omitted_sample", F.coalesce("omitted_sample", F.lit("")))


def interleave(rows: DataFrame, scope: list[str], kind: str, tiers: Column, kind_rank: Column, order: list[Column], rank: str = "position") -> DataFrame:
    """Round-robin over kinds within each tier: first of every kind by kind_rank, then second of every kind."""
    turned = rows.withColumn("__turn", F.row_number().over(Window.partitionBy(*scope, kind).orderBy(*order))).withColumn("__tier", tiers).withColumn("__kind", kind_rank)
    return turned.withColumn(rank, F.row_number().over(Window.partitionBy(*scope).orderBy("__tier", "__turn", "__kind", *order))).drop("__turn", "__tier", "__kind")


def quota_then_fill(rows: DataFrame, scope: list[str], kind: str, order: list[Column], per_kind: int, total: int) -> DataFrame:
    """Up to per_kind rows of each kind first, then the best of the rest, `total` in all; adds reserved and position."""
    own = rows.withColumn("__turn", F.row_number().over(Window.partitionBy(*scope, kind).orderBy(*order))).withColumn("reserved", F.col("__turn") <= per_kind)
    placed = own.withColumn("position", F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc("reserved"), *order)))
    return placed.where(F.col("position") <= total).drop("__turn")


def diverse_first(rows: DataFrame, scope: list[str], kind: str, order: list[Column], total: int) -> DataFrame:
    """The best of each kind first, then the rest by order."""
    return quota_then_fill(rows, scope, kind, order, 1, total).withColumnRenamed("reserved", "first_of_kind")


def budget_prefix(rows: DataFrame, scope: list[str], order: list[Column], size: str, budget: int) -> DataFrame:
    """Rows in order as long as their running size stays within the budget; adds running."""
    total = F.sum(size).over(Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running", total).where(F.col("running") <= budget)


def largest_fit(rows: DataFrame, scope: list[str], order: list[Column], size: str, budget: int) -> DataFrame:
    """(scope, k, bytes): the most leading rows whose summed size fits the budget; 0 where not even one does."""
    kept = budget_prefix(rows, scope, order, size, budget).groupBy(*scope).agg(F.count("*").alias("k"), F.max("running").alias("bytes"))
    return rows.select(*scope).distinct().join(kept, scope, "left").na.fill(0, ["k", "bytes"])


def greedy_batches(rows: DataFrame, scope: list[str], order: list[str], size: str, most_rows: int, most_size: int) -> DataFrame:
    """Batches filled in order: a row that would pass either limit opens the next one.

    Adds batch (from 1).  A scope is folded in one task from sorted batches: only its running batch is held,
    never its rows.
    """
    columns = [*scope, *order, *(c for c in rows.columns if c not in {*order, *scope})]
    at = [columns.index(c) for c in (*scope, size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, batch, n, total = None, 0, 0, 0
        for part in batches:
            out = []
            for *key, z in zip(*(part.column(k).to_pylist() for k in at), strict=True):
                if key != held:
                    held, batch = key, 0
                # a missing size passes no limit, and unknown totals none until the next batch
                full = batch == 0 or n + 1 > most_rows or (total is not None and z is not None and total + z > most_size)
                batch, n = (batch + 1, 1) if full else (batch, n + 1)
                total = z if full else None if total is None or z is None else total + z
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.int32())], [*part.schema.names, "batch"])

    ordered = rows.select(*columns).repartition(*scope).sortWithinPartitions(*scope, *columns[len(scope) :])
    return ordered.mapInArrow(run, T.StructType([*ordered.schema.fields, T.StructField("batch", T.IntegerType())]))


def unique_winner(rows: DataFrame, key: list[str], tier: str, candidate: str, strict_tiers: int = 2) -> DataFrame:
    """(key, status, winner): the first tier with exactly one candidate wins; more than one in one of the first
    `strict_tiers` tiers is ambiguous; else unresolved."""
    per = rows.groupBy(*key, tier).agg(F.countDistinct(candidate).alias("n"), F.min(candidate).alias("c"))
    sole = F.min(F.when(F.col("n") == 1, F.struct(F.col(tier).alias("t"), F.col("c").alias("c"))))
    crowded = F.min(F.when((F.col("n") > 1) & (F.col(tier) < strict_tiers), F.col(tier)))
    out = per.groupBy(*key).agg(sole.alias("s"), crowded.alias("m"))
    status = F.when(F.col("m").isNotNull() & (F.col("s").isNull() | (F.col("m") < F.col("s.t"))), "ambiguous").when(F.col("s").isNotNull(), "resolved").otherwise("unresolved")
    return out.select(*key, status.alias("status"), F.when(status == "resolved", F.col("s.c")).alias("winner"))


def spread_quota(groups: DataFrame, scope: list[str], group: str, size: str, total: int) -> DataFrame:
    """(scope, group, quota): slots dealt in proportion to size, one at a time to the least served share."""
    slots = groups.where(F.col(size) > 0).select(*scope, group, size, F.explode(F.sequence(F.lit(0), F.least(F.col(size), F.lit(total)).cast("int") - 1)).alias("k"))
    dealt = top_k(slots, scope, [(F.col("k") / F.col(size)).asc(), F.col(group).asc()], total)
    return dealt.groupBy(*scope, group).agg(F.count("*").alias("quota"))
