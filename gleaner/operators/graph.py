"""Graph walks by frontier joins over edge tables (src, dst).

Each round joins only the newest nodes, drops those already seen, and settles; it ends when a round finds
nothing.  Graphs keyed by repository carry that key inside their node ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.sets import folder, parts_of, settle


def distances(edges: DataFrame, sources: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, distance): fewest steps from any source (node), up to `depth`; unreachable nodes are left out."""
    frontier = settle(sources.select("node").distinct().withColumn("distance", F.lit(0)))
    seen, k = frontier, 0
    while depth is None or k < depth:
        k += 1
        ahead = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = settle(ahead.join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(k)))
        if not frontier.take(1):
            break
        seen = settle(seen.union(frontier)) if k % 8 == 0 else seen.union(frontier)
    return seen


def closure(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node): everything reachable from the sources, themselves included."""
    return distances(edges, sources).select("node")


#: From so many roots on, nodes on common cycles walk as one; below, the walk costs less than finding them.
MANY_ROOTS = 256
#: Steps, at most, by which cycles are looked for.
CYCLE_STEPS = 8


def cycles(links: DataFrame) -> DataFrame:
    """(node, head): nodes that reach their head and are reached by it, so that they reach the same nodes.

    Links (src, dst) are distinct numbers without nulls.  Found by a few links of each node, either way, in CYCLE_STEPS steps:
    each node takes the busiest node that reaches it, and belongs to it if it leads back there.  What that
    misses is left out; it is never wrong.  Heads stand among their nodes; heads of one node are left out.
    """
    few = []
    for end, other in (("src", "dst"), ("dst", "src")):
        masks = [F.xxhash64(end, F.lit(k)) for k in range(2)]  # the links nearest to two random numbers of the node
        picked = links.groupBy(end).agg(F.count("*").alias("n"), *(F.min(F.col(other).bitwiseXOR(m)).alias(f"m{k}") for k, m in enumerate(masks)))
        few.append(settle(picked.select(F.col(end).alias("node"), "n", *(F.col(f"m{k}").bitwiseXOR(m).alias(f"o{k}") for k, m in enumerate(masks)))))
    out, back = few
    at = lambda df, *names: df.select("node", F.explode(F.array("o0", "o1")).alias("o")).select(*(F.col(c).alias(n) for c, n in zip(("node", "o"), names, strict=True)))
    some = settle(at(out, "src", "dst").unionByName(at(back, "dst", "src")).distinct())
    inner = out.select("node", "n").join(back.select("node", F.col("n").alias("m")), "node").withColumn("busy", F.least("n", "m"))
    state = settle(inner.repartitionByRange("busy", "node").sortWithinPartitions("busy", "node").select("node", F.monotonically_increasing_id().alias("own")))
    state = fresh = state.withColumn("head", F.col("own"))
    for _ in range(CYCLE_STEPS):
        ahead = fresh.select(F.col("node").alias("src"), "head").join(some, "src").groupBy(F.col("dst").alias("node")).agg(F.max("head").alias("ahead"))
        state = settle(state.join(ahead, "node", "left").select("node", "own", F.greatest("head", "ahead").alias("head"), F.coalesce(F.col("ahead") > F.col("head"), F.lit(False)).alias("new")))
        fresh = settle(state.where("new").select("node", "head"))
        if not fresh.take(1):
            break
    tops = lambda end: state.select(F.col("node").alias(end), F.col("head").alias(f"head_{end}"))
    near = settle(some.join(tops("src"), "src").join(tops("dst"), "dst").where("head_src = head_dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    held = settle(distances(near, state.where("own = head").select("node"), CYCLE_STEPS).select("node").join(state.select("node", "own", "head"), "node"))
    heads = held.where("own = head").select("head", F.col("node").alias("name"))
    large = held.groupBy("head").agg(F.count("*").alias("n")).where("n > 1").join(heads, "head")
    return held.join(large, "head").select("node", F.col("name").alias("head"))


def branches(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node): what each root reaches, itself included; edges must not lead into other roots where walks end there.

    Roots that stand next to each other in order go together, 64 as the bits of one number: an edge carries a chunk of
    roots at a step, and only the nodes that some of them reach anew go on.  From MANY_ROOTS roots on, nodes on common cycles
    (cycles) walk as one, so that the links between them carry no roots.
    """
    links = settle(edges.where("src is not null and dst is not null").select("src", "dst").repartition("src").distinct())
    numbered = settle(roots.select(F.col("node").alias("root")).distinct().repartitionByRange("root").sortWithinPartitions("root").withColumn("__n", F.monotonically_increasing_id()))
    roots_ = numbered.select("root", F.shiftright("__n", 6).alias("chunk"), F.expr("shiftleft(1L, cast(__n & 63 as int))").alias("bit"))
    if numbered.count() < MANY_ROOTS:
        seen = _walked(links, roots_.select(F.col("root").alias("node"), "chunk", "bit"))
    else:
        tied = settle(cycles(links))
        short = links
        for end in ("src", "dst"):
            own = tied.select(F.col("node").alias(end), "head")
            short = short.join(own, end, "left").withColumn(end, F.coalesce("head", end)).drop("head")
        short = settle(short.where("src <> dst").distinct())
        ends = roots_.join(tied.withColumnRenamed("node", "root"), "root", "left")
        walked = _walked(short, ends.select(F.coalesce("head", "root").alias("node"), "chunk", "bit"))
        whole = settle(walked.join(tied.select(F.col("head").alias("node")).distinct(), "node", "left_semi"))
        spread = tied.repartition(parts_of(tied), "node").join(whole.withColumnRenamed("node", "head"), "head")
        seen = spread.select("node", "chunk", "bits").union(walked.join(tied.select("node"), "node", "left_anti").select("node", "chunk", "bits"))
    return seen.join(roots_, "chunk").where(F.col("bits").bitwiseAND(F.col("bit")) != 0).select("root", "node")


def _walked(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, chunk, bits): which roots of a chunk reach a node, from starts (node, chunk, bit) on.

    What a step finds anew is a table of its own, whose size the next step's join knows; all of them are what is known.
    """
    paths = []

    def keep(found: DataFrame) -> DataFrame:
        paths.append(folder(found.sparkSession))
        found.write.parquet(paths[-1])
        return found.sparkSession.read.schema(found.schema).parquet(paths[-1])

    fresh = keep(starts.groupBy("node", "chunk").agg(F.bit_or("bit").alias("bits")))
    known = lambda: fresh.sparkSession.read.schema(fresh.schema).parquet(*paths)
    none = F.lit(0).cast("long")
    while fresh.take(1):
        ahead = fresh.join(links.withColumnRenamed("src", "node"), "node").select(F.col("dst").alias("node"), "chunk", none.alias("had"), F.col("bits").alias("came"))
        both = ahead.union(known().select("node", "chunk", F.col("bits").alias("had"), none.alias("came")))
        met = both.groupBy("node", "chunk").agg(F.bit_or("had").alias("had"), F.bit_or("came").alias("came"))
        fresh = keep(met.select("node", "chunk", F.col("came").bitwiseAND(F.bitwise_not("had")).alias("bits")).where("bits <> 0"))
    return known().groupBy("node", "chunk").agg(F.bit_or("bits").alias("bits"))


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct edges both ways; each pair of ends moves once, whichever way and however often it was linked."""
    first = F.coalesce(F.col("src") <= F.col("dst"), F.col("src").isNull())
    once = edges.select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("b")).distinct()
    one, other = F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))
    return once.select(F.explode(F.when(F.equal_null("a", "b"), F.array(one)).otherwise(F.array(one, other))).alias("e")).select("e.src", "e.dst")


def shortest_predecessors(edges: DataFrame, sources: DataFrame, targets: DataFrame, depth: int | None = None) -> DataFrame:
    """(src, dst, distance): edges that lie on some shortest path from the sources to a target; two such edges
    into one node make it ambiguous."""
    reach = settle(distances(edges, sources, depth))
    tight = edges.select("src", "dst").distinct().join(reach.select(F.col("node").alias("src"), F.col("distance").alias("d")), "src").join(reach.select(F.col("node").alias("dst"), "distance"), "dst").where("distance = d + 1")
    tight = settle(tight.select("src", "dst", "distance"))
    wanted = settle(reach.join(targets.select("node").distinct(), "node").select("node"))
    out = None
    while True:
        step = settle(tight.join(wanted.select(F.col("node").alias("dst")), "dst").select("src", "dst", "distance").distinct())
        if not step.take(1):
            break
        out = step if out is None else settle(out.union(step).distinct())
        wanted = step.select(F.col("src").alias("node")).distinct()
    return out if out is not None else tight.limit(0)


def top_of_chain(parents: DataFrame, owners: DataFrame) -> DataFrame:
    """(node, owner): the nearest node up the chain, itself included, that is an owner; cycles end without one.

    parents (node, parent); pointer jumping doubles the distance looked at in each round.
    """
    own = owners.select("node").distinct().withColumn("owner", F.col("node"))
    state = settle(parents.join(own, "node", "left").select("node", F.when(F.col("owner").isNull(), F.col("parent")).alias("up"), "owner"))
    jumps = 0
    while state.where("owner is null and up is not null").take(1) and jumps < 40:
        jumps += 1
        ahead = state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("owner").alias("found"))
        roots = own.join(state, "node", "left_anti").select(F.col("node").alias("up"), F.lit(None).cast("long").alias("next"), F.col("owner").alias("found"))
        met = state.join(ahead.unionByName(roots), "up", "left")
        state = settle(met.select("node", F.when(F.col("owner").isNull() & F.col("found").isNull(), F.col("next")).alias("up"), F.coalesce("owner", "found").alias("owner")))
    return state.select("node", "owner")


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, direction, other): adjacent nodes both ways."""
    out = edges.join(nodes.select(F.col("node").alias("src")).distinct(), "src").select(F.col("src").alias("node"), F.lit("out").alias("direction"), F.col("dst").alias("other"))
    back = edges.join(nodes.select(F.col("node").alias("dst")).distinct(), "dst").select(F.col("dst").alias("node"), F.lit("in").alias("direction"), F.col("src").alias("other"))
    return out.union(back).distinct()


def expand(edges: DataFrame, entries: DataFrame, depth: int, fan_out: int, weight: str) -> DataFrame:
    """(node, distance): a walk from the entries that follows each node's `fan_out` heaviest edges."""
    from gleaner.operators.ranking import top_k

    kept = settle(top_k(edges.select("src", "dst", weight), ["src"], [F.desc(weight), F.col("dst")], fan_out))
    return distances(kept, entries, depth)


def two_hop(edges: DataFrame, seeds: DataFrame, per_hop: int) -> DataFrame:
    """(seed, node, hop): up to per_hop least neighbours of each seed, then of those, either way."""
    from gleaner.operators.ranking import top_k

    both = undirected(edges)
    one = top_k(seeds.select(F.col("node").alias("seed")).distinct().join(both, F.col("seed") == F.col("src")).select("seed", F.col("dst").alias("node")).where("seed <> node").distinct(), ["seed"], [F.col("node")], per_hop).drop("rank")
    one = settle(one.withColumn("hop", F.lit(1)))
    far = one.join(both, one["node"] == both["src"]).select("seed", F.col("dst").alias("node")).where("seed <> node").distinct().join(one.select("seed", "node"), ["seed", "node"], "left_anti")
    two = top_k(far, ["seed"], [F.col("node")], per_hop).drop("rank").withColumn("hop", F.lit(2))
    return one.unionByName(two)


def invalid(nodes: DataFrame, edges: DataFrame, kinds: list[str]) -> DataFrame:
    """(code, id): duplicate nodes, edges with an unknown end, nodes of an unknown kind."""
    twice = nodes.groupBy("node").count().where("count > 1").select(F.lit("duplicate_node").alias("code"), F.col("node").alias("id"))
    odd = nodes.where(~F.coalesce(F.col("kind").isin(kinds), F.lit(False))).select(F.lit("unknown_kind").alias("code"), F.col("node").alias("id")).distinct()
    known = nodes.select("node").distinct()
    ends = [edges.join(known.select(F.col("node").alias(end)), end, "left_anti").select(F.lit(f"unknown_{end}").alias("code"), F.col(end).alias("id")).distinct() for end in ("src", "dst")]
    return twice.union(odd).union(ends[0]).union(ends[1])


def critical_edges(edges: DataFrame, sources: DataFrame, targets: DataFrame, depth: int, budget: int) -> DataFrame:
    """(src, dst, distance, rank, position): edges of the breadth-first tree's paths to targets (node, rank), each edge
    for its best target, `budget` of them in all: best targets first, from the sources on."""
    from gleaner.operators.ranking import top_k

    reach = settle(distances(edges, sources, depth))
    at = lambda end, name: reach.select(F.col("node").alias(end), F.col("distance").alias(name))
    tree = edges.select("src", "dst").distinct().join(at("src", "before"), "src").join(at("dst", "distance"), "dst").where("distance = before + 1")
    tree = settle(tree.groupBy("dst", "distance").agg(F.min("src").alias("src")))
    front, out = settle(targets.join(reach, "node").select("node", "rank")), None
    for _ in range(depth):
        step = settle(front.withColumnRenamed("node", "dst").join(tree, "dst").groupBy("src", "dst", "distance").agg(F.min("rank").alias("rank")))
        out = step if out is None else out.union(step)
        front = step.groupBy(F.col("src").alias("node")).agg(F.min("rank").alias("rank"))
    best = out.groupBy("src", "dst", "distance").agg(F.min("rank").alias("rank")).withColumn("__all", F.lit(0))
    return top_k(best, ["__all"], [F.col("rank"), F.col("distance"), F.col("src"), F.col("dst")], budget, "position").drop("__all")
