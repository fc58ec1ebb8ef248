"""Data-quality checks: each gives a table of violations, empty where the data is right."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, keys: list[str], rules: Mapping[str, Column]) -> DataFrame:
    """(keys, code) for each rule that a row breaks; a rule is a condition that must hold, null counting as broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in rules.items())))
    return rows.select(*keys, F.explode(broken).alias("code"))


def orphans(rows: DataFrame, parents: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Rows whose non-null reference has no parent."""
    some = rows
    for own, _ in on:
        some = some.where(F.col(own).isNotNull())
    keys = parents.select(*(F.col(parent).alias(own) for own, parent in on)).distinct()
    return some.join(keys, [own for own, _ in on], "left_anti").select(rows.columns)


def key_conflicts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, copies, versions, status) of keys that stand more than once: `duplicate` if all their rows are
    equal, else `conflict`."""
    rest = [c for c in rows.columns if c not in keys]
    version = F.xxhash64(*(F.to_json(F.struct(c)) for c in rest)) if rest else F.lit(0)
    found = rows.groupBy(*keys).agg(F.count("*").alias("copies"), F.countDistinct(version).alias("versions")).where("copies > 1")
    return found.withColumn("status", F.when(F.col("versions") > 1, "conflict").otherwise("duplicate"))


def within_bounds(rows: DataFrame, group: list[str], most_rows: int, most_bytes: int, text: str) -> DataFrame:
    """Rows of the groups within both bounds; a group over either is left out whole."""
    fits = rows.groupBy(*group).agg(F.count("*").alias("__n"), F.sum(F.octet_length(text)).alias("__b")).where((F.col("__n") <= most_rows) & (F.coalesce("__b", F.lit(0)) <= most_bytes))
    return rows.join(fits.select(*group), group, "left_semi")


def gate(facts: DataFrame, keys: list[str], conditions: Mapping[str, Column]) -> DataFrame:
    """(keys, passed, failures): conditions that don't hold, joined by commas in their order; passed if none."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in conditions.items())))
    return facts.select(*keys, (F.size(failed) == 0).alias("passed"), F.array_join(failed, ",").alias("failures"))
