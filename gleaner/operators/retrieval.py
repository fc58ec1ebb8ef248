"""Retrieval of evidence for text queries over many documents at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.ranking import ranked, top_k

#: Rows of an index whose files a task scores, about; each file has a sum for every task text that shares a term.
INDEX_ROWS = 1 << 17
WORD = r"[A-Za-z_][A-Za-z0-9_./]*"


def weighted_terms(tasks: DataFrame, task: str, text: str, most: int = 32) -> DataFrame:
    """(task, term, weight, times, position): terms of a task text, strongest first, `most` of them.

    Back-quoted terms weigh 16, code-like ones (with _ . / or an inner capital) 10, capitalised ones 4, plain
    words 2; repetition adds 2 (4 from weight 4 on) a time up to 8, unless the term already weighs 8.
    """
    quoted = F.transform(F.regexp_extract_all(text, F.lit("`([^`]+)`"), F.lit(1)), lambda w: F.struct(w.alias("w"), F.lit(16).alias("weight")))
    bare = F.filter(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.regexp_replace(w, "^[./]+|[./]+$", "")), lambda w: F.length(w) > 1)
    plain = F.transform(bare, lambda w: F.struct(w.alias("w"), F.when(w.rlike("[a-z0-9][A-Z]|[_./]"), 10).when(w.rlike("^[A-Z]"), 4).otherwise(2).alias("weight")))
    found = tasks.select(task, F.posexplode(F.concat(quoted, plain)).alias("pos", "__t")).select(task, "pos", F.lower("__t.w").alias("term"), "__t.weight")
    once = found.groupBy(task, "term").agg(F.max("weight").alias("w"), F.count("*").alias("times"), F.min("pos").alias("pos"))
    boost = F.when((F.col("times") > 1) & (F.col("w") < 8), F.least(F.lit(8), F.col("w") + (F.col("times") - 1) * F.when(F.col("w") >= 4, 4).otherwise(2))).otherwise(F.col("w"))
    return top_k(once.select(task, "term", boost.cast("int").alias("weight"), "times", "pos"), [task], [F.desc("weight"), F.desc("times"), F.col("pos"), F.col("term")], most, "position").drop("pos")


def inverted_index(files: DataFrame, file: str, text: str, only: DataFrame | None = None) -> DataFrame:
    """(file, token, hits) over lower-cased word tokens; only: the tokens (column token) that are asked for.

    Tokens that nobody asks for go before anything is counted or shuffled: at once where `only` is a settled table
    small enough for Spark to broadcast.
    """
    tokens = files.select(file, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}_]+"), F.lit(0))).alias("token"))
    asked = tokens if only is None else tokens.join(only.select("token").distinct(), "token", "left_semi")
    return asked.groupBy(file, "token").agg(F.count("*").alias("hits"))


def score_files(terms: DataFrame, index: DataFrame, task: str, file: str, most: int = 40) -> DataFrame:
    """(task, file, score, matched, rank): files by the terms they hold.

    A term in the text adds weight + 8 + min(hits, 6) * 2.  Terms and files meet on the token, so a file is
    only looked at for terms it has.  The index is dealt by file, about INDEX_ROWS rows a task: where
    Spark broadcasts the terms, a file's sums stay in its task and only each task's best `most` files of a task text go
    on.  The index is counted first, so it should be settled.
    """
    parts = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // INDEX_ROWS))
    met = index.repartition(parts, file).join(terms.withColumnRenamed("term", "token"), "token")
    scored = met.groupBy(task, file).agg(F.sum(F.col("weight") + 8 + F.least("hits", F.lit(6)) * 2).alias("score"), F.count("*").alias("matched"))
    return top_k(scored, [task], [F.desc("score"), F.desc("matched"), F.col(file)], most)


def coverage_greedy(candidates: DataFrame, task: str, file: str, term: str, weight: str, most: int = 12) -> DataFrame:
    """(task, file, gain, position): files chosen one by one for the weight of terms not yet covered.

    candidates has a row per task, file and term and is bounded a task (score_files' `most`); the greedy tail
    runs per task in its own task.
    """
    import pandas as pd

    schema = f"{task} {candidates.schema[task].dataType.simpleString()}, {file} {candidates.schema[file].dataType.simpleString()}, gain long, position int"

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        held = {f: dict(zip(g[term], g[weight], strict=True)) for f, g in rows.groupby(file)}
        out, covered = [], set()
        while held and len(out) < most:
            gain, best = min((-sum(int(w) for t, w in ts.items() if t not in covered), f) for f, ts in held.items())
            if gain == 0:
                break
            covered |= held.pop(best).keys()
            out.append((rows[task].iloc[0], best, -gain, len(out) + 1))
        return pd.DataFrame(out, columns=[task, file, "gain", "position"])

    return candidates.select(task, file, term, weight).groupBy(task).applyInPandas(pick, schema)


def trace(candidates: DataFrame, selected: DataFrame, task: str, file: str, floor: int) -> DataFrame:
    """(task, file, score, outcome): selected, below_floor or not_covered for every candidate."""
    kept = selected.select(task, file).withColumn("__in", F.lit(True))
    outcome = F.when(F.col("__in"), "selected").when(F.col("score") < floor, "below_floor").otherwise("not_covered")
    return candidates.join(kept, [task, file], "left").select(task, file, "score", outcome.alias("outcome"))


def lexical_search(queries: DataFrame, entries: DataFrame, query: str, text: str, name: str, most: int = 20) -> DataFrame:
    """(query, name, match, rank): entries whose name equals, starts with or holds the query, in that order.

    Matching is by lower-cased name, in an equi-join on the query's first three characters (or as many as it has), so a
    query is held against the names that hold those, never all.  An empty query finds nothing.
    """
    q = queries.select(query, F.lower(F.trim(text)).alias("__q")).where("length(__q) >= 1").withColumn("__size", F.least(F.length("__q"), F.lit(3)))
    e = entries.select(name, F.lower(name).alias("__n")).distinct()
    sizes = F.broadcast(q.select("__size").distinct())
    grams = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("__n") - F.col("__size") + 1), lambda k: F.substring(F.col("__n"), k, F.col("__size")))))
    indexed = e.join(sizes, F.length("__n") >= F.col("__size")).select(name, "__n", grams.alias("__g"))
    met = q.withColumn("__g", F.substring("__q", 1, 3)).join(indexed, "__g").where(F.contains("__n", F.col("__q")))
    match = F.when(F.col("__n") == F.col("__q"), "exact").when(F.startswith("__n", F.col("__q")), "prefix").otherwise("substring")
    order = F.when(F.col("match") == "exact", 0).when(F.col("match") == "prefix", 1).otherwise(2)
    return ranked(met.select(query, name, match.alias("match")), [query], [order, F.col(name)]).where(F.col("rank") <= most)


def term_coverage(terms: DataFrame, support: DataFrame, task: str, term: str, target: str, most: int = 5) -> DataFrame:
    """(task, covered, total, status): how many terms have a target, and none, partial or all."""
    near = support.select(term, target).distinct()
    k = F.row_number().over(Window.partitionBy(task, term).orderBy(target))
    per = terms.select(task, term).distinct().join(near, term, "left").withColumn("__k", k).where(F.col("__k") <= most).groupBy(task, term).agg(F.count(target).alias("n"))
    out = per.groupBy(task).agg(F.count(F.when(F.col("n") > 0, 1)).alias("covered"), F.count("*").alias("total"))
    return out.withColumn("status", F.when(F.col("covered") == 0, "none").when(F.col("covered") == F.col("total"), "all").otherwise("partial"))


#: Where a match of a kind of entry ranks, by how it matches: symbols, documents, others.
PRIORITY = {"exact_path": [1, 0, 0], "exact_name": [2, 3, 3], "prefix": [4, 5, 6], "substring": [8, 9, 10]}
GRAM = 3
#: The same for queries that are at least so long.
LONG_GRAM = 8


def _meet(q: DataFrame, low: DataFrame) -> DataFrame:
    """Rows of q (__query, __q, __size) beside the rows of low (__p, __n and others) that hold their rarest gram."""
    grams = lambda c, size: F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda k: F.substring(c, k, size))
    asked = q.select("__query", "__size", F.explode(F.array_distinct(grams(F.col("__q"), F.col("__size")))).alias("__g"))
    sizes = sorted(r[0] for r in q.select("__size").distinct().collect()) or [GRAM]  # GRAM + 1 numbers at most
    empty = F.array().cast("array<string>")
    held = lambda c: F.when(F.length(c) >= F.col("__size"), grams(F.col(c), F.col("__size"))).otherwise(empty)
    indexed = low.withColumn("__size", F.explode(F.array(*map(F.lit, sizes)))).withColumn("__g", F.explode(F.array_distinct(F.concat(F.coalesce(held("__p"), empty), F.coalesce(held("__n"), empty))))).drop("__size")
    wanted = indexed.join(asked.select("__g").distinct(), "__g", "left_semi")
    often = wanted.groupBy("__g").agg(F.count("*").alias("__often"))
    rarest = asked.join(often, "__g", "left").groupBy("__query").agg(F.min(F.struct(F.coalesce("__often", F.lit(0)).alias("n"), "__g")).alias("__r"))
    keyed = q.join(rarest, "__query").select("__query", "__q", F.col("__r.__g").alias("__g"))
    return keyed.join(wanted, "__g")


def search_entries(queries: DataFrame, entries: DataFrame, query: str, text: str, most: int = 20) -> DataFrame:
    """(query, entry, match, priority, rank): entries whose path or name is, starts with or holds the query, `most` a query.

    `entries`: entry (its key), kind (symbol, document, others), path and name.  Case counts for nothing, blanks around a
    query neither; exact_path goes before exact_name, prefix and substring; PRIORITY ranks kinds within them,
    then lower-cased path and name, then path, name and entry.  Blank queries find nothing; null names and paths match
    nothing.

    A query meets the entries that hold its rarest eight letters, its rarest three if it is shorter than that, or itself
    if it is shorter still: eight letters of a path hold most of what tells it from others, so what a query meets does
    not grow with the number of entries as it does with three.  Only grams that queries ask for are counted, and the rarest
    one decides, so frequent grams don't gather their entries.  The best `most` of a query
    are cut in salted parts first, so one that matches everything is never ranked in one task.
    """
    q = queries.select(F.col(query).alias("__query"), F.lower(F.trim(text)).alias("__q")).where("__q <> ''")
    q = q.withColumn("__size", F.when(F.length("__q") >= LONG_GRAM, LONG_GRAM).otherwise(F.least(F.length("__q"), F.lit(GRAM))))
    low = entries.select("entry", "kind", F.col("path").alias("__path"), F.col("name").alias("__name"), F.lower("path").alias("__p"), F.lower("name").alias("__n"))
    met = _meet(q, low)
    p, n, t = F.col("__p"), F.col("__n"), F.col("__q")
    match = F.when(p == t, "exact_path").when(n == t, "exact_name").when(F.coalesce(F.startswith(n, t), F.lit(False)) | F.coalesce(F.startswith(p, t), F.lit(False)), "prefix").when(F.coalesce(F.contains(n, t), F.lit(False)) | F.coalesce(F.contains(p, t), F.lit(False)), "substring")
    of_kind = F.when(F.col("kind") == "symbol", 0).when(F.col("kind") == "document", 1).otherwise(2)
    priority = F.coalesce(*(F.when(F.col("match") == m, F.element_at(F.array(*map(F.lit, levels)), of_kind + 1)) for m, levels in PRIORITY.items()))
    found = met.withColumn("match", match).where("match is not null").withColumn("priority", priority)
    order = [F.col("priority"), F.col("__p"), F.col("__n"), F.col("__path"), F.col("__name"), F.col("entry")]
    return top_k(found.select("__query", "entry", "match", "priority", "__p", "__n", "__path", "__name"), ["__query"], order, most).select(F.col("__query").alias(query), "entry", "match", "priority", "rank")
