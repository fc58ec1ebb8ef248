"""Set operations, folding of equal things, and near-duplicate removal in rank order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new path in the shared folder: the checkpoint folder set, or spark.checkpoint.dir; in local mode, one made here."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return f"{context.getCheckpointDir()}/table-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage: a Parquet table in the folder the cluster names in
    spark.checkpoint.dir, so that the next plan knows its true size."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows, about, of a part of a table that is dealt out.
DEALT_ROWS = 1 << 17


def parts_of(df: DataFrame) -> int:
    """Parts of about DEALT_ROWS rows that df makes, no fewer than a shuffle has: joins and groups over so many parts hold
    in a task what does not grow with the table.  df is counted, so it should be cheap to read."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // DEALT_ROWS))


def difference(every: DataFrame, chosen: DataFrame, on: list[str], scope: list[str], sample: str, samples: int = 5) -> DataFrame:
    """(scope, missing, sample): how many rows of `every` aren't chosen, and the least of their samples.

    The sample passes through a bounded top list per scope, never the whole difference.
    """
    from gleaner.operators.ranking import top_k

    left = every.join(chosen.select(*on).distinct(), on, "left_anti")
    first = top_k(left, scope, [F.col(sample)], samples).groupBy(*scope).agg(F.array_join(F.array_sort(F.collect_list(F.col(sample).cast("string"))), ",").alias("sample"))
    return left.groupBy(*scope).agg(F.count("*").alias("missing")).join(first, scope)


def union_distinct(rows: DataFrame, key: list[str], position: str, value: str, name: str) -> DataFrame:
    """(key, name): each key's distinct values in the order of their first position."""
    first = rows.groupBy(*key, value).agg(F.min(position).alias("__p"))
    return first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", F.col(value).alias("v")))), lambda s: s["v"]).alias(name))


def merge_fields(rows: DataFrame, key: list[str], position: str, fill: list[str], least: list[str]) -> DataFrame:
    """One row per key: of the `fill` columns the first value that isn't null or empty, of `least` the minimum."""
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(position))).alias(c) for c in fill]
    return rows.groupBy(*key).agg(*firsts, *(F.min(c).alias(c) for c in least))


def overlaps(sets: DataFrame, scope: list[str], id_col: str, member: str, threshold: float) -> DataFrame:
    """(scope, a, b, shared, jaccard) for ids a < b of a scope whose member sets reach the threshold.

    Exact, by an inverted index over the rarest members: of two sets with that Jaccard similarity each holds a
    common member among its n - ceil(threshold * n) + 1 rarest, so common members make no pairs.
    """
    own = settle(sets.select(*scope, id_col, member).repartition(*scope, id_col).distinct())
    rare = own.join(own.groupBy(*scope, member).agg(F.count("*").alias("df")), [*scope, member], "left")
    one = Window.partitionBy(*scope, id_col)  # sets move once to be counted and ordered
    sized = rare.withColumn("n", F.count("*").over(one)).withColumn("k", F.row_number().over(one.orderBy(F.asc_nulls_last("df"), member)))
    index = sized.where(F.col("k") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1)
    index = settle(index.where("df > 1").select(*scope, member, id_col, "n"))  # a member of one set makes no pair
    left = index.select(*scope, member, F.col(id_col).alias("a"), F.col("n").alias("na"))
    right = index.select(*scope, member, F.col(id_col).alias("b"), F.col("n").alias("nb"))
    near = left.join(right, [*scope, member]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb")))
    pairs = settle(near.select(*scope, "a", "b", "na", "nb").distinct())  # of known size: few pairs go to the sets, not these to them
    met = pairs.join(own.withColumnRenamed(id_col, "a"), [*scope, "a"]).join(own.withColumnRenamed(id_col, "b"), [*scope, "b", member])
    counted = met.groupBy(*scope, "a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    jaccard = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return counted.withColumn("jaccard", jaccard).where(F.col("jaccard") >= threshold).select(*scope, "a", "b", "shared", "jaccard")


def keep_first(rows: DataFrame, pairs: DataFrame, id_col: str, rank: str) -> DataFrame:
    """Rows left when, in rank order, each kept row removes its later duplicates.

    pairs (a, b) of ids are duplicates, which need not be transitive: a row goes only for a row that stays.
    Rounds: a row without an earlier undecided neighbour stays and its neighbours go, until all are decided.
    """
    order = rows.select(F.col(id_col).alias("id"), F.col(rank).alias("r"))
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = settle(
        both.join(order.select(F.col("id").alias("a"), F.col("r").alias("ra")), "a").join(order.select(F.col("id").alias("b"), F.col("r").alias("rb")), "b").where(F.struct("ra", "a") > F.struct("rb", "b")).select("a", "b")
    )
    gone = None
    while True:
        blocked = edges.select(F.col("a").alias("id")).distinct()
        stays = edges.select(F.col("b").alias("id")).distinct().join(blocked, "id", "left_anti")
        out = settle(edges.join(stays.withColumnRenamed("id", "b"), "b", "left_semi").select(F.col("a").alias("id")).distinct())
        if not out.take(1):
            break
        gone = out if gone is None else gone.union(out)
        edges = settle(edges.join(out.withColumnRenamed("id", "a"), "a", "left_anti").join(out.withColumnRenamed("id", "b"), "b", "left_anti"))
    return rows if gone is None else rows.join(gone.withColumnRenamed("id", id_col), id_col, "left_anti").select(rows.columns)


def fold_equal(rows: DataFrame, scope: list[str], id_col: str, rank: str, identity: Column) -> DataFrame:
    """rows with first_id: the first row by rank of the same identity; a row is a card if first_id is its own
    id, else an alternate of that card."""
    own = Window.partitionBy(*scope, "__identity").orderBy(rank, id_col)
    return rows.withColumn("__identity", identity).withColumn("first_id", F.first(id_col).over(own)).drop("__identity")


def better_in_place(rows: DataFrame, key: list[str], position: str, quality: str, payload: str) -> DataFrame:
    """One row per key at its first position, with the payload of its best quality (earliest, then least, on ties)."""
    return rows.groupBy(*key).agg(F.min(position).alias(position), F.min_by(payload, F.struct(quality, position, payload)).alias(payload))


def merge_best(rows: DataFrame, key: list[str], order: list[str], payload: list[str], union: str) -> DataFrame:
    """One row per key: the payload of the least row by `order`, and the sorted distinct values of `union`."""
    return rows.groupBy(*key).agg(F.min_by(F.struct(*payload), F.struct(*order)).alias("__p"), F.sort_array(F.collect_set(union)).alias(union)).select(*key, "__p.*", union)


def tiered_anti(rows: DataFrame, known: DataFrame, tiers: list[list[str]]) -> DataFrame:
    """Rows equal to none of `known` under any tier of columns; a tier counts only where all its columns are set
    on both sides."""
    left = rows
    for tier in tiers:
        keys = known.select(*tier).dropna().distinct()
        left = left.join(keys, tier, "left_anti").select(rows.columns)
    return left
