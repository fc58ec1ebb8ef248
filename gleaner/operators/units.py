"""Unit catalogs: members clustered by role and module, broad modules split while a budget of units allows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.operators.selection import fold_sorted
from gleaner.operators.sets import settle


def module_key(path: Column) -> Column:
    """Fixed rule: the first segment, or cmd and the one behind it; null if it is empty, a dot name or holds a dot."""
    parts = F.split(F.regexp_replace(F.trim(path), "/$", ""), "/")
    own = F.when((parts[0] == "cmd") & (F.size(parts) > 1), F.get(parts, F.lit(1))).otherwise(parts[0])
    key = F.when((parts[0] == "cmd") & (F.size(parts) > 1), F.concat(F.lit("cmd/"), own)).otherwise(own)
    return F.when((own != "") & ~F.contains(own, F.lit(".")), key)


def _next_key(key: Column, path: Column) -> Column:
    """The key and the path's next segment below it; the key itself for what stands right there; null if that is a dot name."""
    rest = F.split(F.substring(F.regexp_replace(F.trim(path), "/$", ""), F.length(key) + 2, F.lit(1 << 30)), "/")[0]
    below = F.length(F.regexp_replace(F.trim(path), "/$", "")) > F.length(key)
    return F.when(~below, key).when(~rest.isin("", ".", ".."), F.concat(key, F.lit("/"), rest))


def unit_catalog(members: DataFrame, scope: list[str], path: str, role: str, seed: str, chunk: int = 48, threshold: int = 48, most: int = 64, levels: int = 1) -> DataFrame:
    """members (scope, path, role, seed) with unit (a key) and chunk (from 0).

    Seeds are units of their own; others gather by role and module, those without a module by role alone.  A unit
    shows as chunks of `chunk` members by path.  A module of more than `threshold` members is split by the next
    segment of their paths if that makes more than one unit, all of them have such a segment, and the scope's chunks
    then number `most` at most; modules are tried by name, `levels` times over.  Null paths have no module.

    A round counts members by unit and by child for all scopes at once; the choice passes over a scope's broad modules
    in order with one running number.
    """
    base = F.concat_ws(":", F.lit("module"), F.coalesce(role, F.lit("")), "__key")
    rows = settle(members.withColumn("__key", F.when(F.col(seed), None).otherwise(module_key(F.col(path)))))
    rows = rows.withColumn("unit", F.when(F.col(seed), F.concat(F.lit("seed:"), F.coalesce(path, F.lit("")))).when(F.col("__key").isNotNull(), base).otherwise(F.concat(F.lit("rest:"), F.coalesce(role, F.lit("")))))
    chunks = lambda n: F.ceil(n / chunk)
    shape = {"fits": (T.BooleanType(), pa.bool_())}

    def start() -> Callable:
        used = None

        def step(total, more):
            nonlocal used
            used = total if used is None else used
            if used + more > most:
                return (False,)
            used += more
            return (True,)

        return step

    for _ in range(levels):
        child = rows.withColumn("__next", _next_key(F.col("__key"), F.col(path)))
        parts = child.groupBy(*scope, "unit", "__next").agg(F.count("*").alias("n"), F.max(F.col("__key").isNotNull()).alias("module"))
        unit = settle(parts.groupBy(*scope, "unit").agg(F.sum("n").alias("n"), F.count("__next").alias("children"), F.max(F.col("__next").isNull()).alias("bare"), F.sum(chunks(F.col("n"))).alias("after"), F.max("module").alias("module")))
        total = unit.groupBy(*scope).agg(F.sum(chunks(F.col("n"))).alias("total"))
        plans = unit.where("module and not bare and children > 1").where(F.col("n") > threshold).join(total, scope).select(*scope, "unit", "total", (F.col("after") - chunks(F.col("n"))).alias("more"))
        taken = fold_sorted(plans, scope, ["unit"], ["total", "more"], shape, start).where("fits").select(*scope, "unit", F.lit(True).alias("__split"))
        split = child.join(taken, [*scope, "unit"], "left")
        key = F.when(F.col("__split"), F.col("__next")).otherwise(F.col("__key"))
        name = F.when(F.col("__split"), F.concat_ws(":", F.lit("module"), F.coalesce(role, F.lit("")), "__next")).otherwise(F.col("unit"))
        rows = settle(split.select(*members.columns, key.alias("__key"), name.alias("unit")))
    from gleaner.operators.evidence import chunked

    return chunked(rows.drop("__key"), [*scope, "unit"], [F.col(path)], chunk)
