"""Joins that authorise, match and attach evidence, and rollups over what they attach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.ranking import top_k
from gleaner.operators.sets import parts_of


def unique_rows(rows: DataFrame, key: list[str], facts: list[str]) -> DataFrame:
    """Rows of the keys that all their rows agree on: equal duplicates fall together, conflicting ones go."""
    one = rows.groupBy(*key).agg(F.min(F.struct(*facts)).alias("__lo"), F.max(F.struct(*facts)).alias("__hi"))
    return one.where(F.col("__lo").eqNullSafe(F.col("__hi"))).select(*key, "__lo.*")


def authorised_entries(entries: DataFrame, key: list[str], sides: list[tuple[DataFrame, list[str], list[str]]]) -> DataFrame:
    """Entries that meet every side (rows, join columns, facts) in exactly one agreed row; entries that conflict go."""
    out = unique_rows(entries, key, [c for c in entries.columns if c not in key])
    for rows, on, facts in sides:
        out = out.join(unique_rows(rows, on, facts), on)
    return out


def detector_matches(sites: DataFrame, detectors: DataFrame, package: str, callee: str, names: str, constructor: str = "^New.*Client$") -> DataFrame:
    """(site columns, detector): sites of a detector's package whose callee is among its names, or any callee if it
    names none; sites of external packages without a detector match `constructor` by their callee's name.  Sites that are
    equal in all columns fall together."""
    named = sites.join(detectors, package).where(F.col(names).isNull() | F.array_contains(F.col(names), F.col(callee))).select(*sites.columns, "detector")
    rest = sites.join(detectors.select(package).distinct(), package, "left_anti").where(F.col("external") & F.col(callee).rlike(constructor))
    return named.union(rest.select(*sites.columns, F.lit("constructor").alias("detector"))).distinct()


def associate_exact(units: DataFrame, components: DataFrame, path: str) -> DataFrame:
    """units with component and outcome: matched by the very path, or omitted; a prefix owns nothing."""
    return units.join(components.select(path, "component").dropDuplicates([path, "component"]), path, "left").withColumn("outcome", F.when(F.col("component").isNull(), "omitted").otherwise("matched"))


CITES = (r"([A-Za-z0-9_./-]+\.[a-z]+) line ([0-9]+)", r"([A-Za-z0-9_./-]+\.[a-z]+) [a-z ]*at line ([0-9]+)", r"([A-Za-z0-9_./-]+\.[a-z]+):([0-9]+)")


def canonical_claims(claims: DataFrame, known: DataFrame, claim: str, text: str) -> DataFrame:
    """(claim, path, line, grounded): every `path line N`, `path ... at line N` and `path:N` of a claim; grounded
    where (path, line) is known."""
    whole = F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(f"({c})"), F.lit(1)) for c in CITES))))
    cites = claims.select(claim, F.explode(whole).alias("__c"))
    found = cites.select(claim, F.regexp_extract("__c", r"^([A-Za-z0-9_./-]+\.[a-z]+)", 1).alias("path"), F.regexp_extract("__c", "([0-9]+)$", 1).cast("long").alias("line")).distinct()
    return found.join(known.select("path", "line").distinct().withColumn("grounded", F.lit(True)), ["path", "line"], "left").select(claim, "path", "line", F.coalesce("grounded", F.lit(False)).alias("grounded"))


def attach_capped(searches: DataFrame, places: DataFrame, on: list[str], search: str, anchor: list[str], order: list[Column], most: int) -> DataFrame:
    """Up to `most` places of each search, each (search, anchor) once, with rank and how many there were."""
    met = searches.join(places, on).dropDuplicates([search, *anchor])
    total = met.groupBy(search).agg(F.count("*").alias("found"))
    return top_k(met, [search], order, most).join(total, search)


def set_key(values: Column) -> Column:
    """An array as a key that ignores order and repeats."""
    return F.array_join(F.array_sort(F.array_distinct(values)), ",")


def authorised_graph(entities: DataFrame, relations: DataFrame, catalog: DataFrame, provenance: DataFrame) -> DataFrame:
    """Relations (id, src, dst) of which both ends lie in the catalog and every provenance path does."""
    kept = entities.join(catalog.select("path").distinct(), "path", "left_semi").select("node").distinct()
    bad = provenance.join(catalog.select("path").distinct(), "path", "left_anti").select("id").distinct()
    ends = relations.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return ends.join(bad, "id", "left_anti").select("id", "src", "dst")


def call_targets(calls: DataFrame, imports: DataFrame, owners: DataFrame, call: list[str]) -> DataFrame:
    """(call, target, how): with a qualifier the file's imports alone decide; without one, the caller file's package."""
    met = calls.join(imports.select("file", "qualifier", F.col("package").alias("__i")), ["file", "qualifier"], "left").join(owners.select("file", F.col("package").alias("__o")), "file", "left")
    qualified = F.coalesce("qualifier", F.lit("")) != ""
    target = F.when(qualified, F.col("__i")).otherwise(F.col("__o"))
    return met.select(*call, target.alias("target"), F.when(target.isNull(), "unknown").when(qualified, "import").otherwise("owner").alias("how"))


def related_flows(flows: DataFrame, anchors: DataFrame, rejected: DataFrame, card: str) -> DataFrame:
    """(card, flows): flows (flow, path) that share a path with a card's anchors, but for rejected ones."""
    live = flows.join(rejected.select("flow").distinct(), "flow", "left_anti")
    return anchors.join(live, "path").select(card, "flow").distinct().groupBy(card).agg(F.array_sort(F.collect_list("flow")).alias("flows"))


def top_list(rows: DataFrame, group: list[str], value: str, n: int, name: str) -> DataFrame:
    """(group, name): the n commonest values of each group as value:count, joined by commas."""
    counted = rows.groupBy(*group, value).agg(F.count("*").alias("__n"))
    best = top_k(counted, group, [F.desc("__n"), F.col(value)], n)
    text = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", F.col(value).cast("string"), F.col("__n").cast("string")).alias("v")))), lambda s: s["v"])
    return best.groupBy(*group).agg(F.array_join(text, ",").alias(name))


def aspect_coverage(claims: DataFrame, facts: DataFrame, aspect: str, status: str, basis: dict[str, int]) -> DataFrame:
    """(aspect, status, facts, used): each aspect's status of best basis rank, and how many of its facts claims use.

    claims (aspect, fact, status); facts (aspect, fact)."""
    rank = F.element_at(F.create_map(*(F.lit(x) for pair in basis.items() for x in pair)), F.col(status))
    best = claims.groupBy(aspect).agg(F.min_by(status, F.struct(F.coalesce(rank, F.lit(len(basis))), F.col(status))).alias(status))
    used = facts.join(claims.select(aspect, "fact").distinct().withColumn("__u", F.lit(1)), [aspect, "fact"], "left").groupBy(aspect).agg(F.count("*").alias("facts"), F.count("__u").alias("used"))
    return used.join(best, aspect, "left").withColumn(status, F.coalesce(status, F.lit("unsupported")))


def considered_selected(candidates: DataFrame, selected: DataFrame, key: list[str], group: str, target: str, samples: int = 3) -> DataFrame:
    """(group, considered, selected, sample): distinct targets seen and chosen, and the least of those left out."""
    met = candidates.select(*key, group, target).distinct().join(selected.select(*key).distinct().withColumn("__s", F.lit(1)), key, "left")
    counts = met.groupBy(group).agg(F.countDistinct(target).alias("considered"), F.countDistinct(F.when(F.col("__s") == 1, F.col(target))).alias("selected"))
    chosen = met.where("__s = 1").select(group, target).distinct()
    left = top_k(met.select(group, target).distinct().join(chosen, [group, target], "left_anti"), [group], [F.col(target)], samples)
    sample = left.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(target)), lambda x: x.cast("string")), ",").alias("sample"))
    return counts.join(sample, group, "left").withColumn("sample", F.coalesce("sample", F.lit("")))


def majority(rows: DataFrame, group: list[str], owner: str) -> DataFrame:
    """(group, owner, n): the owner of most rows, the least on ties; rows without one don't vote."""
    counted = rows.where(F.col(owner).isNotNull()).groupBy(*group, owner).agg(F.count("*").alias("n"))
    return counted.groupBy(*group).agg(F.min_by(F.struct(owner, "n"), F.struct(-F.col("n"), F.col(owner))).alias("__b")).select(*group, "__b.*")


def common_prefix(rows: DataFrame, group: list[str], path: str) -> DataFrame:
    """(group, prefix): the leading path segments that all of a group's paths share: those of the least and greatest."""
    ends = rows.groupBy(*group).agg(F.min(F.split(path, "/")).alias("__a"), F.max(F.split(path, "/")).alias("__b"))
    alike = F.zip_with("__a", "__b", lambda a, b: a.eqNullSafe(b))
    n = F.coalesce(F.array_position(alike, False), F.lit(0))
    kept = F.when(n == 0, F.size("__a")).otherwise(n - 1).cast("int")
    return ends.select(*group, F.array_join(F.slice("__a", F.lit(1), kept), "/").alias("prefix"))


def raw_or_counted(rows: DataFrame, group: list[str], available: Column, truncated: str, raw_total: str) -> DataFrame:
    """(group, total, available): counts, with the raw total in place of the count where the list was cut."""
    out = rows.groupBy(*group).agg(F.count("*").alias("__n"), F.count_if(available).alias("available"), F.bool_or(truncated).alias("__t"), F.max(raw_total).alias("__r"))
    return out.select(*group, F.when(F.col("__t"), F.coalesce("__r", "__n")).otherwise(F.col("__n")).alias("total"), "available")


def merged_best(rows: DataFrame, key: list[str], rank: list[Column], payload: list[str], evidence: str) -> DataFrame:
    """One row a key: the payload of the best rank, and all distinct evidence of the arrays together."""
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*payload), F.struct(*rank)).alias("__p"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(evidence)))).alias(evidence))
    return best.select(*key, "__p.*", evidence)


def argmax_relation(relations: DataFrame, nodes: DataFrame, group: list[str], kinds: dict[str, int], penalty: Column) -> DataFrame:
    """(group, id, score): the relation of greatest positive score in each group, least id on ties.

    Score: ten times the kind's priority, a quarter of each end's score, less the penalty.
    """
    node = lambda end: nodes.select(F.col("node").alias(end), F.col("score").alias(f"__{end}"))
    priority = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair)), F.col("kind")), F.lit(0))
    met = relations.join(node("src"), "src").join(node("dst"), "dst")
    scored = met.withColumn("score", priority * 10 + F.floor(F.col("__src") / 4) + F.floor(F.col("__dst") / 4) - penalty).where("score > 0")
    return scored.groupBy(*group).agg(F.min_by(F.struct("id", "score"), F.struct(-F.col("score"), F.col("id"))).alias("__b")).select(*group, "__b.*")


def repeated_sets(rows: DataFrame, run: str, card: str, member: str) -> DataFrame:
    """(run, cards, duplicates): how many cards of a run have the very members of another one of it."""
    sets = rows.groupBy(run, card).agg(F.sha2(F.concat_ws("\u0000", F.array_sort(F.collect_set(F.col(member).cast("string")))), 256).alias("__k"))
    return sets.groupBy(run).agg(F.count("*").alias("cards"), (F.count("*") - F.countDistinct("__k")).alias("duplicates"))


def retained_graph(nodes: DataFrame, edges: DataFrame, reachable: DataFrame, entry: str, per_kind: int, per_entry: int, total: int, most_edges: int) -> DataFrame:
    """(kind, id): nodes and edges kept of a graph under caps.

    Nodes rank by entry, reachable, other, then kind and id; each kind has a cap, and the total cap counts only
    those that passed it.  Edges need both ends, those between reachable nodes first.
    """
    known = reachable.select("node").distinct().withColumn("__r", F.lit(True))
    tier = F.when(F.col("kind") == entry, 0).when(F.col("__r"), 1).otherwise(2)
    ranked = nodes.join(known, "node", "left").withColumn("tier", tier)
    cap = F.when(F.col("kind") == entry, per_entry).otherwise(per_kind)
    within = top_k(ranked, ["kind"], [F.col("tier"), F.col("node")], max(per_kind, per_entry)).where(F.col("rank") <= cap).drop("rank")
    kept = top_k(within.withColumn("__all", F.lit(0)), ["__all"], [F.col("tier"), F.col("kind"), F.col("node")], total).select("node", "__r")
    end = lambda name: kept.select(F.col("node").alias(name), F.coalesce("__r", F.lit(False)).alias(f"__{name}"))
    both = edges.select("src", "dst").distinct().join(end("src"), "src").join(end("dst"), "dst").withColumn("__all", F.lit(0))
    best = top_k(both, ["__all"], [F.desc(F.col("__src") & F.col("__dst")), F.col("src"), F.col("dst")], most_edges)
    return kept.select(F.lit("node").alias("part"), F.col("node").cast("string").alias("id")).union(best.select(F.lit("edge"), F.concat_ws(">", F.col("src").cast("string"), F.col("dst").cast("string"))))


def chunked(rows: DataFrame, bucket: list[str], order: list[Column], size: int) -> DataFrame:
    """rows with chunk: buckets cut into chunks of `size` in order, numbered from 0."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*bucket).orderBy(*order)) - 1) / size).cast("long"))


def query_terms(rows: DataFrame, key: str, text: str, ignored: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, term, alias): distinct words of two characters or more without ignored ones; alias: the words that stand
    for it in searches, itself where the table (term, alias) has none."""
    words = rows.select(key, F.explode(F.split(F.lower(text), "[^a-z0-9]+")).alias("term")).where("length(term) >= 2").distinct()
    kept = words.join(ignored.select("term").distinct(), "term", "left_anti")
    return kept.join(aliases.select("term", "alias").distinct(), "term", "left").select(key, "term", F.coalesce("alias", "term").alias("alias"))


def anchor_relations(anchors: DataFrame, calls: DataFrame, tests: DataFrame, terms: DataFrame, scope: str, most: int) -> DataFrame:
    """(scope, left, right, kind, score): the best kind of relation of each pair of a scope's anchors, `most` in all.

    anchors (scope, id, score); calls (scope, left, right) and tests (scope, left, right) as observed; terms (scope,
    id, term, weight): pairs meet over the terms that they share, never all against all.  Every step is dealt over parts of
    bounded rows; the anchors are counted first, so they should be settled.
    """
    parts = parts_of(anchors)
    terms = terms.repartition(parts, scope, "term")
    a, b = terms.select(scope, "term", "weight", F.col("id").alias("left")), terms.select(scope, "term", F.col("id").alias("right"))
    shared = a.join(b, [scope, "term"]).where("left < right")
    kinds = calls.select(scope, "left", "right", F.lit(0).alias("order"), F.lit("direct_call").alias("kind"), F.lit(4000).alias("bonus"))
    kinds = kinds.union(tests.select(scope, "left", "right", F.lit(1), F.lit("test_reference"), F.lit(3000)))
    kinds = kinds.union(shared.select(scope, "left", "right", F.lit(2), F.lit("shared_task_term"), (1000 + F.col("weight") * 10).cast("int")))
    pair = [F.least("left", "right").alias("lo"), F.greatest("left", "right").alias("hi")]
    best = kinds.where("left <> right").repartition(parts, scope).groupBy(scope, *pair).agg(F.min_by(F.struct("left", "right", "kind", "bonus"), F.struct("order", "left", "right", F.col("bonus").isNull(), -F.col("bonus"))).alias("b")).select(scope, "b.*")
    score = lambda end: anchors.select(scope, F.col("id").alias(end), F.col("score").alias(f"__{end}"))
    scored = best.repartition(parts, scope, "left").join(score("left"), [scope, "left"]).repartition(parts, scope, "right").join(score("right"), [scope, "right"]).withColumn("score", F.col("__left") + F.col("__right") + F.col("bonus"))
    return top_k(scored.repartition(parts, scope), [scope], [F.desc("score"), F.col("left"), F.col("right")], most).select(scope, "left", "right", "kind", "score")


def cards_of(rows: DataFrame, card: str, member: str, complete: Column, needed: int) -> DataFrame:
    """(card, members, badge): cards with their distinct members; full where so many are complete, else partial."""
    per = rows.groupBy(card).agg(F.countDistinct(member).alias("members"), F.countDistinct(F.when(complete, F.col(member))).alias("__c"))
    return per.select(card, "members", F.when(F.col("__c") >= needed, "full").otherwise("partial").alias("badge"))
