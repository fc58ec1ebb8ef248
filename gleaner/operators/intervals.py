"""Ranges of lines or days: merging, islands, containment.

Containment joins meet on a bucket of the range as well as the key, so neither side is compared whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(rows: DataFrame, key: list[str], start: str, end: str, gap: int = 1) -> DataFrame:
    """(key, start, end, parts): overlapping ranges, and those at most `gap` apart, as one."""
    order = Window.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = rows.withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0))
    island = opens.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*key, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts")).drop("__island")


def clusters(points: DataFrame, key: list[str], at: str, gap: int, *aggregates: Column) -> DataFrame:
    """(key, first, last, points, aggregates): points at most `gap` after the one before are one cluster."""
    order = Window.partitionBy(*key).orderBy(at)
    before = F.lag(at).over(order)
    cut = points.withColumn("__new", F.when(before.isNull() | (F.col(at) - before > gap), 1).otherwise(0))
    island = cut.withColumn("__island", F.sum("__new").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*key, "__island").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("points"), *aggregates).drop("__island")


def runs(points: DataFrame, key: list[str], at: str) -> DataFrame:
    """(key, first, last): consecutive whole numbers as ranges; repeated points count once."""
    own = points.select(*key, at).distinct()
    island = F.col(at) - F.row_number().over(Window.partitionBy(*key).orderBy(at))
    return own.withColumn("__island", island).groupBy(*key, "__island").agg(F.min(at).alias("first"), F.max(at).alias("last")).drop("__island")


def _bucketed(ranges: DataFrame, start: str, end: str, width: int) -> DataFrame:
    return ranges.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))


def containing(points: DataFrame, ranges: DataFrame, key: list[str], at: str, start: str, end: str, width: int = 64) -> DataFrame:
    """Each point with each range of its key that holds it: an equi-join on key and bucket, then the exact test."""
    own = points.withColumn("__bucket", F.floor(F.col(at) / width))
    met = own.join(_bucketed(ranges, start, end, width), [*key, "__bucket"])
    return met.where(F.col(at).between(F.col(start), F.col(end))).drop("__bucket")


def narrowest(points: DataFrame, ranges: DataFrame, key: list[str], at: str, start: str, end: str, range_id: str, width: int = 64) -> DataFrame:
    """Each point's narrowest holding range (least id on ties); points without one are left out."""
    held = containing(points, ranges, key, at, start, end, width)
    return held.groupBy(*key, at).agg(F.min_by(range_id, F.struct(F.col(end) - F.col(start), F.col(range_id))).alias(range_id))


def uncovered(points: DataFrame, ranges: DataFrame, key: list[str], at: str, start: str, end: str, width: int = 64) -> DataFrame:
    """Points that no range of their key holds."""
    own = points.withColumn("__bucket", F.floor(F.col(at) / width))
    buckets = _bucketed(ranges.select(*key, start, end), start, end, width)
    on = [own[k] == buckets[k] for k in [*key, "__bucket"]] + [own[at].between(buckets[start], buckets[end])]
    return own.join(buckets, on, "left_anti").drop("__bucket")


def resolve(points: DataFrame, ranges: DataFrame, point_id: str, key: list[str], at: str, start: str, end: str, range_id: str, width: int = 64) -> DataFrame:
    """(point_id, status, range_id): a range that starts at the point wins, else one that holds it; several
    of the better kind are ambiguous and resolve to none."""
    held = containing(points, ranges, key, at, start, end, width).withColumn("__tier", F.when(F.col(at) == F.col(start), 0).otherwise(1))
    tiers = held.groupBy(point_id, "__tier").agg(F.countDistinct(range_id).alias("n"), F.min(range_id).alias("r"))
    best = tiers.groupBy(point_id).agg(F.min_by(F.struct("n", "r"), "__tier").alias("b"))
    out = points.select(point_id).distinct().join(best, point_id, "left")
    status = F.when(F.col("b").isNull(), "unresolved").when(F.col("b.n") == 1, "resolved").otherwise("ambiguous")
    return out.select(point_id, status.alias("status"), F.when(status == "resolved", F.col("b.r")).alias(range_id))
