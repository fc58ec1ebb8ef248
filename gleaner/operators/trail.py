"""Provenance trails: what many sources say, as one table of typed nodes and edges whose ends all resolve."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import digest_of
from gleaner.operators.sets import settle

FACTS = ("section", "label", "basis", "path", "line")


class Trail(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    locators: DataFrame
    diagnostics: DataFrame


def node_id(kind: Column, source: Column) -> Column:
    """A node's identity: its kind and a digest of kind and source id."""
    return F.concat_ws("-", kind, F.substring(digest_of(kind, source), 1, 24))


def next_edges(rows: DataFrame, scope: list[str], order: list[Column], kind: str, node_kind: str, source: str, basis: str) -> DataFrame:
    """Edges from each row of a scope to the next one in order, between nodes of one kind, in provenance_trail's shape."""
    ahead = F.lead(source).over(Window.partitionBy(*scope).orderBy(*order))
    return rows.withColumn("__to", ahead).where("__to is not null").select(
        F.lit(kind).alias("kind"), F.lit(node_kind).alias("from_kind"), F.col(source).cast("string").alias("from_source"), F.lit(node_kind).alias("to_kind"), F.col("__to").cast("string").alias("to_source"), F.lit(basis).alias("basis")
    )


def provenance_trail(nodes: list[DataFrame], edges: list[DataFrame], primary: tuple[str, str] | None = None, open_kind: str = "frontier") -> Trail:
    """Conforms sources of nodes (kind, source_id, section, label, basis, path, line) and of edges (kind, from_kind,
    from_source, to_kind, to_source, basis) into one trail.

    nodes: (id, kind, source_id, section, label, basis); ids depend on kind and source id alone, so every run and every
    source names a node alike.  Equal rows of a node fall together; of differing ones the least counts.
    edges: (id, kind, src, dst, basis): distinct by kind and ends, the least basis counts.  Nodes of `open_kind` that no
    edge leads to are led to from the primary node (kind, source id), if one is given and there.
    locators: (id, path, line): where nodes with a path stand.  It is a table of its own, so that a trail can go without paths.
    diagnostics: (code, kind, detail, n): missing_source (nodes without a source id), conflicting_node (rows that differ),
    unknown_from and unknown_to (ends that no node has; such edges are left out), by id of the node or end.

    Ends are looked up as distinct ids, so a node of many edges is looked up once, and only ids that don't resolve meet the
    edges again.
    """
    said = reduce(DataFrame.unionByName, (n.select("kind", F.col("source_id").cast("string").alias("source_id"), *FACTS) for n in nodes))
    missing = said.where("source_id is null").groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("missing_source").alias("code"), "kind", F.lit("").alias("detail"), "n")
    facts = F.struct(*FACTS)
    one = said.where("source_id is not null").groupBy("kind", "source_id").agg(F.min(facts).alias("__f"), F.max(facts).alias("__g"), F.count("*").alias("__n"))
    one = settle(one.withColumn("id", node_id(F.col("kind"), F.col("source_id"))))
    conflicts = one.where(~F.col("__f").eqNullSafe(F.col("__g"))).select(F.lit("conflicting_node").alias("code"), "kind", F.col("id").alias("detail"), F.col("__n").alias("n"))
    told = reduce(DataFrame.unionByName, (e.select("kind", "from_kind", "from_source", "to_kind", "to_source", "basis") for e in edges))
    # edges meet by what they are told by, which is short; ids, which are long and alike in nothing, are made of what is left
    told = told.withColumn("from_source", F.coalesce("from_source", F.lit(""))).withColumn("to_source", F.coalesce("to_source", F.lit("")))
    told = told.groupBy("kind", "from_kind", "from_source", "to_kind", "to_source").agg(F.min("basis").alias("basis"), F.count("*").alias("n"))
    drawn = settle(told.select("kind", node_id(F.col("from_kind"), F.col("from_source")).alias("src"), node_id(F.col("to_kind"), F.col("to_source")).alias("dst"), "basis", "n"))
    ends = drawn.select(F.col("src").alias("id")).union(drawn.select("dst")).distinct()
    lost = settle(ends.join(one.select("id"), "id", "left_anti"))
    bad = [drawn.join(lost.withColumnRenamed("id", end), end, "left_semi").groupBy("kind", F.col(end).alias("detail")).agg(F.sum("n").alias("n")).select(F.lit(f"unknown_{name}").alias("code"), "kind", "detail", "n") for end, name in (("src", "from"), ("dst", "to"))]
    kept = drawn.join(lost.withColumnRenamed("id", "src"), "src", "left_anti").join(lost.withColumnRenamed("id", "dst"), "dst", "left_anti").select("kind", "src", "dst", "basis")
    if primary:
        loose = one.where(F.col("kind") == open_kind).join(kept.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").select(F.lit(open_kind).alias("kind"), F.col("id").alias("dst"), F.col("__f.basis").alias("basis"))
        led = loose.withColumn("src", node_id(F.lit(primary[0]), F.lit(primary[1]))).join(one.select(F.col("id").alias("src")), "src", "left_semi").where("src <> dst")
        kept = kept.unionByName(led.select("kind", "src", "dst", "basis"))
    shown = kept.select(digest_of(F.col("kind"), F.col("src"), F.col("dst")).alias("id"), "kind", "src", "dst", "basis")
    described = one.select("id", "kind", "source_id", *(F.col(f"__f.{c}").alias(c) for c in FACTS))
    places = described.where("path is not null").select("id", "path", "line")
    return Trail(described.drop("path", "line"), shown, places, missing.union(conflicts).union(bad[0]).union(bad[1]))
