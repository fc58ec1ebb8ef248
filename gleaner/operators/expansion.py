"""Walks under limits: best-first from a question's best match, and breadth-first from entries with an account of
what the limits left out.  Every round takes one step for all questions or roots at once."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.text import identifier_words
from gleaner.operators.ranking import top_k
from gleaner.operators.selection import fold_sorted
from gleaner.operators.sets import settle

#: Fixed values of a match: its base, what each matched term adds, what a path outside tests adds, a name's word that is
#: a term, one that begins a term or begins with it, and a name that is a term; the last two pairs again for the order of a walk.
BASE, HIT, LIVE, SAME, BEGINS, WHOLE = 40, 5, 10, 30, 10, 15
OVERLAP_SAME, OVERLAP_BEGINS = 3, 1
#: Distinct names and questions of a block, bytes of either, and terms whose row of points a task keeps.
BLOCK_NAMES, BLOCK_QUESTIONS, BLOCK_BYTES, MOST_ROWS = 8192, 32768, 8 << 20, 2048
#: Questions of a block below which more tasks gain nothing.
FEW_QUESTIONS = 2048
#: Folders of tests.
TEST_FOLDERS = ["test", "tests", "testdata", "benchmark", "benchmarks"]


def is_test(path: Column) -> Column:
    low = F.lower(F.coalesce(path, F.lit("")))
    return F.endswith(low, F.lit("_test.go")) | F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, TEST_FOLDERS)))


def _likeness(words: Column, terms: Column, same: int, begins: int) -> Column:
    """Points of all pairs of a word and a term of which one begins with the other."""
    points = lambda w, t: F.when(w == t, same).when(F.startswith(w, t) | F.startswith(t, w), begins).otherwise(0)
    of_word = lambda w: F.aggregate(terms, F.lit(0).cast("long"), lambda n, t: n + points(w, t))
    return F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + of_word(w))


def _best_names(block: pa.Table) -> pa.Table:
    """The best name of a block for each question of the block that shares anything with one: a row of numbers for each
    term, points and hits of every name at once, and their sum for each question.  A row is counted in one go from the places
    of all words that the term goes with; terms that go with the same words share it, and those most asked for are kept."""
    own = block["own"]
    names = block.filter(pc.equal(own, 1)).sort_by([("test", "ascending"), ("node", "ascending")])
    asked = block.filter(pc.equal(own, 0))
    size, held = len(names), names["words"].combine_chunks()
    code = held.flatten().dictionary_encode()
    every = code.dictionary.to_pylist()
    order = sorted(range(len(every)), key=every.__getitem__)
    words, place = [every[k] for k in order], np.empty(len(every), np.int64)
    place[order] = np.arange(len(every))
    rank = place[code.indices.to_numpy(zero_copy_only=False)]
    by_word = np.argsort(rank, kind="stable")
    at = np.searchsorted(rank[by_word], np.arange(len(words) + 1))
    name_of = np.repeat(np.arange(size), held.value_lengths().to_numpy(zero_copy_only=False))[by_word]
    known, longest = {w: k for k, w in enumerate(words)}, max(map(len, words), default=0)
    whole = {n: k for k, n in enumerate(names["name"].to_pylist())}
    terms_of = asked["terms"].to_pylist()
    shift = max(map(len, terms_of), default=0).bit_length()
    most = (int(held.value_lengths().to_numpy(zero_copy_only=False).max(initial=0)) * SAME + WHOLE + HIT) * max(map(len, terms_of), default=0) + BASE + LIVE
    kind = np.int32 if most << shift < 1 << 31 else np.int64
    base = ((BASE + np.where(names["test"].to_numpy(), 0, LIVE)) << shift).astype(kind)
    hits, of_shift = kind((HIT << shift) + 1), kind(shift)

    def sort(term: str) -> tuple:
        """What decides on a term's row: the words that begin with it, the longest word it begins with, and its being a word or a name."""
        low, high = bisect_left(words, term), bisect_left(words, term + "\U0010ffff")
        start = next((known[term[:n]] for n in range(min(len(term) - 1, longest), 0, -1) if term[:n] in known), None)
        return (low, high) if low < high else None, start, term in known, whole.get(term)

    def row(term: str, of: tuple) -> np.ndarray | None:
        """Points and hit of every name for a term of a sort, or None."""
        low, high = of[0] or (0, 0)
        met = [name_of[at[low] : at[high]]] if low < high else []
        if of[1] is not None:
            for n in range(1, len(words[of[1]]) + 1):
                k = known.get(term[:n])
                if k is not None:
                    met.append(name_of[at[k] : at[k + 1]])
        if not met:
            return None
        points = np.bincount(np.concatenate(met) if len(met) > 1 else met[0], minlength=size).astype(kind)
        points *= BEGINS
        if term in known:
            np.add.at(points, name_of[at[low] : at[low + 1]], SAME - BEGINS)
        hit = points > 0
        if term in whole and hit[whole[term]]:
            points[whole[term]] += WHOLE
        points <<= of_shift
        points += hit * hits
        return points

    sorts = {t: sort(t) for t in {t for terms in terms_of for t in terms}}
    often = Counter(sorts[t] for terms in terms_of for t in terms)
    kept = {of for of, n in often.most_common(MOST_ROWS) if n > 1}
    rows: dict[tuple, np.ndarray | None] = {}
    query, node, key = [], [], []
    total = np.zeros(size, kind)
    for q, terms in enumerate(terms_of):
        total[:] = 0
        for t in terms:
            of = sorts[t]
            if of in rows:
                more = rows[of]
            else:
                more = row(t, of)
                if of in kept:
                    rows[of] = more
            if more is not None:
                total += more
        np.add(total, base, out=total, where=total > 0)
        best = int(total.argmax()) if size else 0  # names stand in order: the first of the best
        if size and total[best]:
            query.append(q)
            node.append(best)
            key.append(int(total[best]))
    keys, chosen = np.array(key, np.int64), names.take(pa.array(node, pa.int64()))
    return pa.table({"query": asked["query"].take(pa.array(query, pa.int64())), "node": chosen["node"], "score": keys >> shift, "hits": keys & ((1 << shift) - 1), "test": chosen["test"]})


def best_matches(known: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, node, score): the callable (node, name, test, words) whose name shares most with a question (query, terms).

    Equal names score alike but for tests, so the first node of each name stands for all.  Blocks of names meet blocks of
    questions, both bounded in rows and bytes, and leave one row a question: every name is held against every question,
    but no pair of them becomes a row.
    """
    names = settle(known.where("size(words) > 0").groupBy("name").agg(F.min(F.struct("test", "node", "words")).alias("r")).select("name", "r.*"))
    n, n_bytes = names.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("name")), F.lit(0))).first()
    q, q_bytes = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.array_join("terms", " "))), F.lit(0))).first()
    parts = max(1, -(-n // BLOCK_NAMES), -(-n_bytes // BLOCK_BYTES))
    least = -(-int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")) // parts)  # small tables fill the tasks too
    groups = max(1, -(-q // BLOCK_QUESTIONS), -(-q_bytes // BLOCK_BYTES), min(least, -(-q // FEW_QUESTIONS)))
    lot = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    asking = asked.select(lot("query", groups).alias("g"), every(parts).alias("b"), F.lit(0).alias("own"), "query", "terms")
    named = names.select(every(groups).alias("g"), lot("name", parts).alias("b"), F.lit(1).alias("own"), "node", "name", "test", "words")
    met = asking.unionByName(named, allowMissingColumns=True).repartition(groups * parts, "g", "b")
    kind = {c: met.schema[c].dataType.simpleString() for c in ("query", "node")}
    found = met.groupBy("g", "b").applyInArrow(_best_names, f"query {kind['query']}, node {kind['node']}, score long, hits long, test boolean")
    return top_k(found, ["query"], [F.desc("score"), F.desc("hits"), F.col("test"), F.col("node")], 1).select("query", "node", "score")


def question_expansion(callables: DataFrame, edges: DataFrame, questions: DataFrame, hops: int = 2, expansions: int = 3, most: int = 64) -> DataFrame:
    """(query, node, distance, parent, position, score, expanded): what each question reads of a call graph, best first.

    A question starts at the callable whose name shares most with its terms (by score, then matched terms, then
    paths outside tests, then id).  `expansions` times it expands the best node it knows and has not expanded: most
    overlap with the terms, then the root's own path, then fewer hops, then paths outside tests, then id.
    Neighbours, either way and in order of id, come in within `hops` of the root until `most` nodes are known; each
    keeps the node that brought it.  position: order of coming in, from 0; expanded: which expansion, or null.

    `callables` (node, name, path) has a row a node, `edges` (src, dst), `questions` (query, term).  Nodes that no
    callable describes are none; a question that matches nothing has no row.

    The first callables are found by best_matches.  A round joins one node a question with its neighbours; a node that
    comes in is held against its question's terms alone.  No more than twice `most` of a node can matter (as many may be
    known already), so a hub never brings all its edges; a question's state is `most` rows.
    """
    named = callables.select("node", "name", "path").where("node is not null")
    known = settle(named.select("*", is_test(F.col("path")).alias("test"), identifier_words(F.col("name")).alias("words")))
    asked = settle(questions.where("query is not null and term <> ''").groupBy("query").agg(F.collect_set("term").alias("terms")))
    ends = edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").join(known.select(F.col("node").alias("src")), "src", "left_semi").join(known.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
    both = ends.union(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    near = settle(top_k(both, ["src"], [F.col("dst")], 2 * most, "turn"))

    def judged(nodes: DataFrame) -> DataFrame:
        """Nodes (query, node, ...) with overlap, path and test."""
        met = nodes.join(known.select("node", "path", "test", "words"), "node").join(asked, "query")
        overlap = F.coalesce(_likeness(F.col("words"), F.col("terms"), OVERLAP_SAME, OVERLAP_BEGINS), F.lit(0).cast("long"))
        return met.withColumn("overlap", overlap).drop("words", "terms")

    best = best_matches(known, asked)
    no = F.lit(None)
    roots = settle(judged(best).select("query", "node", F.lit(0).alias("distance"), no.cast(callables.schema["node"].dataType).alias("parent"), F.lit(0).alias("position"), "score", "overlap", "path", "test", no.cast("int").alias("expanded")))
    home, nodes = roots.select("query", F.col("path").alias("home")), roots
    for k in range(1, expansions + 1):
        fresh = nodes.where("expanded is null").join(home, "query").withColumn("own", F.equal_null("path", F.col("home")))
        order = [F.desc("overlap"), F.desc("own"), F.col("distance"), F.col("test"), F.col("node")]
        now = settle(top_k(fresh, ["query"], order, 1).select("query", "node", "distance"))
        held = nodes.groupBy("query").agg(F.count("*").alias("held"))
        ahead = now.where(F.col("distance") < hops).select("query", F.col("node").alias("src"), (F.col("distance") + 1).alias("distance")).join(near, "src")
        ahead = ahead.withColumnRenamed("dst", "node").join(nodes.select("query", "node"), ["query", "node"], "left_anti").join(held, "query")
        place = F.row_number().over(Window.partitionBy("query").orderBy("turn"))
        came = ahead.withColumn("position", F.col("held") + place - 1).where(F.col("position") < most)
        came = came.select("query", "node", "distance", F.col("src").alias("parent"), F.col("position").cast("int").alias("position"), no.cast("long").alias("score"))
        came = judged(came).select("query", "node", "distance", "parent", "position", "score", "overlap", "path", "test", no.cast("int").alias("expanded"))
        marked = nodes.join(now.select("query", "node", F.lit(k).alias("mark")), ["query", "node"], "left").withColumn("expanded", F.coalesce("expanded", "mark")).select(*came.columns)
        nodes = settle(marked.unionByName(came))
    return nodes.select("query", "node", "distance", "parent", "position", F.coalesce("score", "overlap").alias("score"), "expanded")


def entry_calls(edges: DataFrame, roots: DataFrame, weight: str = "n", depth: int = 3, fan_out: int = 12, most_nodes: int = 32, most_families: int = 48, left_out: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What each root calls under limits, and what the limits leave out.

    First: (root, caller, callee, witnesses, depth, position): the families admitted, in order of their admission a
    root (from 1); depth is the caller's.  Second: (root, node, reason, families, witnesses): what is left out at each
    admitted node.  Of each node, nodes in order of admission, the `fan_out` families of most witnesses are
    taken (then by callee); a family whose callee would be a node too many ends its caller (node_limit), one
    family too many too (family_limit); the other families of a node are outgoing_limit, those of nodes at `depth`
    depth_limit.  `left_out` (node, reason, n): calls that were never families, carried along.

    edges (src, dst, weight) has a row a family; roots (node).  For every root, admitted and left out families sum up to all
    families of its nodes, and witnesses likewise.

    Level by level: all roots' newest nodes meet their heaviest families, and one fold a level, at most most_nodes *
    fan_out rows a root, decides in order.  Families beyond the fan-out are only ever counted.
    """
    base = edges.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.sum(weight).cast("long").alias("witnesses"))
    heavy = settle(top_k(base, ["src"], [F.desc("witnesses"), F.col("dst")], fan_out, "turn"))
    totals = settle(base.groupBy("src").agg(F.count("*").alias("families"), F.sum("witnesses").alias("all")))
    nodes = settle(roots.where("node is not null").select("node").distinct().select(F.col("node").alias("root"), "node", F.lit(0).alias("at"), F.lit(0).alias("depth")))
    admitted: DataFrame | None = None
    refused: DataFrame | None = None

    def start() -> Callable:
        new, blocked, counted, families = {}, None, None, None

        def step(caller, callee, held, n, f):
            nonlocal blocked, counted, families
            if counted is None:
                counted, families = n, f
            if blocked is not None and blocked[0] == caller:
                return (blocked[1], None, None)
            place = held if held is not None else new.get(callee)
            if place is None and counted >= most_nodes:
                blocked = (caller, "node_limit")
            elif families >= most_families:
                blocked = (caller, "family_limit")
            if blocked is not None and blocked[0] == caller:
                return (blocked[1], None, None)
            if place is None:
                place = new[callee] = counted
                counted += 1
            families += 1
            return ("admitted", place, families)

        return step

    shape = {"outcome": (T.StringType(), pa.string()), "place": (T.IntegerType(), pa.int32()), "position": (T.IntegerType(), pa.int32())}
    for level in range(depth):
        used = nodes.groupBy("root").agg(F.count("*").cast("int").alias("n_nodes"))
        spent = admitted.groupBy("root").agg(F.count("*").cast("int").alias("n_families")) if admitted is not None else used.select("root", F.lit(0).alias("n_families"))
        callers = nodes.where(F.col("depth") == level).select("root", F.col("node").alias("caller"), F.col("at").alias("caller_at"))
        rows = callers.join(heavy.select(F.col("src").alias("caller"), F.col("dst").alias("callee"), "witnesses", "turn"), "caller")
        rows = rows.join(nodes.select("root", F.col("node").alias("callee"), F.col("at").alias("held")), ["root", "callee"], "left").join(used, "root").join(spent, "root", "left").fillna(0, ["n_families"])
        done = settle(fold_sorted(rows, ["root"], ["caller_at", "turn"], ["caller", "callee", "held", "n_nodes", "n_families"], shape, start))
        taken = done.where("outcome = 'admitted'").select("root", "caller", "callee", "witnesses", F.lit(level).alias("depth"), "position")
        lost = done.where("outcome <> 'admitted'").groupBy("root", F.col("caller").alias("node"), F.col("outcome").alias("reason")).agg(F.count("*").alias("families"), F.sum("witnesses").alias("witnesses"))
        admitted, refused = (taken, lost) if admitted is None else (admitted.unionByName(taken), refused.unionByName(lost))
        fresh = done.where("outcome = 'admitted' and held is null").select("root", F.col("callee").alias("node"), F.col("place").alias("at"), F.lit(level + 1).alias("depth")).distinct()
        nodes = settle(nodes.unionByName(fresh))
    counted = nodes.join(totals.withColumnRenamed("src", "node"), "node")
    far = counted.where(F.col("depth") == depth).select("root", "node", F.lit("depth_limit").alias("reason"), "families", F.col("all").alias("witnesses"))
    top = heavy.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("kept"), F.sum("witnesses").alias("held"))
    wide = counted.where(F.col("depth") < depth).join(top, "node").where("families > kept").select("root", "node", F.lit("outgoing_limit").alias("reason"), (F.col("families") - F.col("kept")).alias("families"), (F.col("all") - F.col("held")).alias("witnesses"))
    refused = refused.unionByName(far).unionByName(wide)
    if left_out is not None:
        refused = refused.unionByName(nodes.select("root", "node").join(left_out.where("n > 0"), "node").select("root", "node", "reason", F.col("n").cast("long").alias("families"), F.col("n").cast("long").alias("witnesses")))
    return admitted, refused
