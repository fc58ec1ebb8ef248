"""Text scans: lines, rule hits, the best of them, and what they say about a source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import go_boundaries, holds_any, required_literals, squeeze
from gleaner.operators.ranking import top_k


def lines(files: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, line, text): every line from 1 on; the empty piece after a last line break isn't a line."""
    pieces = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\n$", ""), "\n", -1)
    held = files.where(F.length(text) > 0)
    return held.select(*key, F.posexplode(pieces).alias("line", "text")).withColumn("line", F.col("line") + 1)


def windows(files: DataFrame, wanted: DataFrame, key: list[str], text: str, start: str = "start", end: str = "end") -> DataFrame:
    """(key, line, text) of the lines inside the wanted ranges, each line once however many ranges hold it."""
    from gleaner.operators.intervals import containing, merge

    merged = merge(wanted, key, start, end)
    return containing(lines(files, key, text), merged, key, "line", start, end).select(*key, "line", "text")


def signals(rows: DataFrame, key: list[str], rules: list[tuple[str, str, int, str]]) -> DataFrame:
    r"""(key, line, category, weight, reason, rule, match) of each line and rule (category, pattern, weight,
    reason) that matches it.

    A rule's pattern runs only on lines that hold a string it needs, and lines that hold none of them are
    dropped first, so that most text costs plain substring searches.
    """
    needs = [required_literals(p) for _, p, _, _ in rules]
    some = reduce(lambda a, b: a | b, (holds_any(F.col("text"), n) for n in needs))
    hit = lambda k, c, p, w, r: F.when(
        holds_any(F.col("text"), needs[k]) & F.col("text").rlike(go_boundaries(p)),
        F.struct(F.lit(k).alias("rule"), F.lit(c).alias("category"), F.lit(w).alias("weight"), F.lit(r).alias("reason"), squeeze(F.regexp_extract("text", go_boundaries(p), 0), 80).alias("match")),
    )
    hits = F.array_compact(F.array(*(hit(k, *rule) for k, rule in enumerate(rules))))
    return rows.where(some).select(*key, "line", F.inline(hits))


def best_of_lines(found: DataFrame, file: list[str]) -> DataFrame:
    """The strongest signal of each line (first rule on ties)."""
    line = Window.partitionBy(*file, "line").orderBy(F.desc("weight"), "rule")
    return found.withColumn("__k", F.row_number().over(line)).where("__k = 1").drop("__k")


def best_signals(found: DataFrame, file: list[str], per_file: int) -> DataFrame:
    """The strongest signal of each line, then the strongest per_file lines of each file."""
    return top_k(best_of_lines(found, file), file, [F.desc("weight"), F.col("line")], per_file, "rank")


def capped(best: DataFrame, scope: list[str], file: list[str], file_order: list, total: int) -> DataFrame:
    """best_signals cut to `total` a scope, taking files in file_order: each file gives what is left."""
    sizes = best.groupBy(*scope, *[f for f in file if f not in scope]).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*scope).orderBy(*file_order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = sizes.withColumn("__room", F.lit(total) - before).where("__room > 0")
    return best.join(room.drop("__n"), list(dict.fromkeys([*scope, *file]))).where(F.col("rank") <= F.col("__room")).drop("__room")


def category_summary(found: DataFrame, file: list[str]) -> DataFrame:
    """(file, categories, hits): distinct categories in the order they first appear."""
    first = found.groupBy(*file, "category").agg(F.min("line").alias("at"), F.count("*").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "category"))), lambda s: s["category"])
    return first.groupBy(*file).agg(F.array_join(ordered, ",").alias("categories"), F.sum("n").alias("hits"))


def flow_candidates(found: DataFrame, scope: list[str], path: str, per_category: int = 10, strong: int = 35) -> DataFrame:
    """(scope, category, n, files, priority): categories with a strong signal, or with two in two files.

    Only the strongest per_category signals count; priority is 2 + min((n + 1) div 3, 3), one less for one file.
    """
    best = top_k(found, [*scope, "category"], [F.desc("weight"), F.col(path), F.col("line")], per_category)
    held = best.groupBy(*scope, "category").agg(F.count("*").alias("n"), F.countDistinct(path).alias("files"), F.max("weight").alias("top"))
    good = held.where((F.col("top") >= strong) | ((F.col("n") >= 2) & (F.col("files") >= 2)))
    priority = F.lit(2) + F.least(F.floor((F.col("n") + 1) / 3), F.lit(3)) - F.when(F.col("files") == 1, 1).otherwise(0)
    return good.select(*scope, "category", "n", "files", priority.cast("long").alias("priority"))
