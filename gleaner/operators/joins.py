"""Joins with explicit ambiguity: a key that matches several rows is a result of its own, never a pick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def closed_edges(edges: DataFrame, nodes: DataFrame, source: str, target: str, node: str) -> DataFrame:
    """Distinct edges whose two ends are each exactly one node."""
    once = nodes.groupBy(node).count().where("count = 1")
    return (
        edges.select(source, target).distinct()
        .join(once.select(F.col(node).alias(source)), source, "left_semi")
        .join(once.select(F.col(node).alias(target)), target, "left_semi")
        .select(source, target)
    )


def split_known(edges: DataFrame, nodes: DataFrame, target: str, node: str, name: str = "internal") -> DataFrame:
    """Edges with a flag: whether the target is a known node."""
    known = nodes.select(F.col(node).alias(target)).distinct().withColumn(name, F.lit(True))
    return edges.join(known, target, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def owned(rows: DataFrame, owners: DataFrame, on: list[str], agree: Column) -> DataFrame:
    """rows with consistent: whether the owner on the key exists and satisfies the residual condition."""
    met = rows.join(owners, on, "left")
    return met.withColumn("consistent", F.coalesce(agree, F.lit(False)))


def exists_flag(rows: DataFrame, catalog: DataFrame, on: list[str], name: str = "openable") -> DataFrame:
    known = catalog.select(*on).distinct().withColumn(name, F.lit(True))
    return rows.join(known, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def authorise(selections: DataFrame, allowed: DataFrame, selection: str, on: list[str], ordinal: str) -> DataFrame:
    """Rows of the selections all of whose members are allowed, in their order; the others go whole."""
    flagged = exists_flag(selections, allowed, on, "__ok")
    whole = flagged.groupBy(selection).agg(F.bool_and("__ok").alias("__all")).where("__all").select(selection)
    return selections.join(whole, selection, "left_semi").withColumn("position", F.row_number().over(Window.partitionBy(selection).orderBy(ordinal)))


def attach_unique(rows: DataFrame, others: DataFrame, key: list[str], value: str, name: str) -> DataFrame:
    """rows with the value of the one matching row, and status resolved, ambiguous or missing."""
    held = others.groupBy(*key).agg(F.countDistinct(value).alias("__n"), F.min(value).alias("__v"))
    met = rows.join(held, key, "left")
    status = F.when(F.col("__n").isNull(), "missing").when(F.col("__n") == 1, "resolved").otherwise("ambiguous")
    return met.withColumn("status", status).withColumn(name, F.when(F.col("status") == "resolved", F.col("__v"))).drop("__n", "__v")


def tiered_owner(rows: DataFrame, id_col: str, tiers: list[DataFrame], owner: str) -> DataFrame:
    """(id, tier, owners, n): owners by the first tier (a table of id, owner) that has any; none is tier null."""
    met = None
    for k, tier in enumerate(tiers):
        part = tier.select(id_col, owner).distinct().withColumn("tier", F.lit(k))
        met = part if met is None else met.union(part)
    first = met.groupBy(id_col).agg(F.min("tier").alias("tier"))
    best = met.join(first, [id_col, "tier"]).groupBy(id_col, "tier").agg(F.sort_array(F.collect_set(owner)).alias("owners"))
    return rows.select(id_col).distinct().join(best, id_col, "left").withColumn("n", F.coalesce(F.size("owners"), F.lit(0))).withColumn("n", F.when(F.col("tier").isNull(), 0).otherwise(F.col("n")))


def match_rules(rows: DataFrame, rules: DataFrame, on: list[str], residual: Column, row_id: str, rule_id: str) -> DataFrame:
    """(row_id, rule_id) of each row and rule that agree on the key columns and satisfy the residual; the rules
    are a small table that Spark may broadcast by its size."""
    return rows.join(rules, on).where(residual).select(row_id, rule_id).distinct()


def pair_overlaps(left: DataFrame, right: DataFrame, witness: list[str], a: str, b: str) -> DataFrame:
    """(a, b, witnesses): pairs whose witness sets meet, by an equi-join on the witness."""
    met = left.select(a, *witness).distinct().join(right.select(b, *witness).distinct(), witness)
    return met.groupBy(a, b).agg(F.count("*").alias("witnesses"))


def lift_edges(edges: DataFrame, membership: DataFrame, source: str, target: str, member: str, group: str, witnesses: str) -> DataFrame:
    """(from_group, to_group, witnesses): edges between members as edges between their groups, own edges left out."""
    a = membership.select(F.col(member).alias(source), F.col(group).alias("from_group"))
    b = membership.select(F.col(member).alias(target), F.col(group).alias("to_group"))
    lifted = edges.join(a, source).join(b, target).where(F.col("from_group") != F.col("to_group"))
    return lifted.groupBy("from_group", "to_group").agg(F.sum(witnesses).alias("witnesses"))


def overlay(originals: DataFrame, replacements: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """(key, text, reason): the replacement where it is sound, else the original with the reason: missing,
    too_large or placeholder_mismatch; a replacement without an original is unknown and has no text."""
    old, new = originals.select(key, F.col(text).alias("__old")), replacements.select(key, F.col(text).alias("__new"))
    marks = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit(r"\{[a-z]+\}"), F.lit(0)))
    reason = (
        F.when(F.col("__old").isNull(), "unknown").when(F.col("__new").isNull(), "missing").when(F.octet_length("__new") > most, "too_large")
        .when(marks(F.col("__old")) != marks(F.col("__new")), "placeholder_mismatch").otherwise("")
    )
    return old.join(new, key, "full_outer").select(key, F.when(reason == "", F.col("__new")).otherwise(F.col("__old")).alias(text), reason.alias("reason"))


def apply_membership(proposed: DataFrame, members: DataFrame, group: str, member: str) -> DataFrame:
    """(member, group, outcome): accepted, unknown (no such member), duplicate (in several groups) or unassigned."""
    own = proposed.select(group, member).distinct()
    many = own.withColumn("__n", F.count("*").over(Window.partitionBy(member)))
    known = members.select(member).distinct().withColumn("__known", F.lit(True))
    met = many.join(known, member, "full_outer")
    outcome = F.when(F.col("__known").isNull(), "unknown").when(F.col(group).isNull(), "unassigned").when(F.col("__n") > 1, "duplicate").otherwise("accepted")
    return met.select(member, group, outcome.alias("outcome"))


def either(left: DataFrame, right: DataFrame, ways: list[list[str]], a: str, b: str) -> DataFrame:
    """Distinct (a, b) pairs that agree on any of the ways: one equi-join each, never an OR."""
    out = None
    for on in ways:
        part = left.select(a, *on).dropna().distinct().join(right.select(b, *on).dropna().distinct(), on).select(a, b)
        out = part if out is None else out.union(part)
    return out.distinct()


def exact_else_near(cites: DataFrame, signals: DataFrame, cite: str, path: str, at: str, weight: str, n: int = 3, ties: list[str] | None = None) -> DataFrame:
    """Up to n signals on each cite's own line; only if there are none, up to n others of its path; ties: what tells
    signals of one weight and line apart."""
    from gleaner.operators.ranking import top_k

    met = cites.select(cite, path, F.col(at).alias("__at")).join(signals, path).withColumn("exact", F.col(at) == F.col("__at"))
    tier = met.groupBy(cite).agg(F.max("exact").alias("exact"))
    return top_k(met.join(tier, [cite, "exact"]).drop("__at"), [cite], [F.desc(weight), F.col(at), *map(F.col, ties or [])], n)
