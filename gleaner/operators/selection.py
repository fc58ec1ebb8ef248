"""Selection whose every choice depends on those before it, folded over sorted rows in bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold_sorted(rows: DataFrame, scope: list[str], order: list[str], inputs: list[str], outputs: dict[str, tuple[T.DataType, pa.DataType]], start: Callable[[], Callable]) -> DataFrame:
    """rows with further columns, each row's made by the function that start() gives for its scope, row by row in order."""
    columns = [*scope, *order, *(c for c in rows.columns if c not in {*order, *scope})]
    at, wide = [columns.index(c) for c in (*scope, *inputs)], len(scope)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, step = None, None
        for part in batches:
            out = []
            for values in zip(*(part.column(k).to_pylist() for k in at), strict=True):
                if values[:wide] != held:
                    held, step = values[:wide], start()
                out.append(step(*values[wide:]))
            made = [pa.array([o[k] for o in out], kind) for k, (_, kind) in enumerate(outputs.values())]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *outputs])

    ordered = rows.select(*columns).repartition(*scope).sortWithinPartitions(*scope, *columns[wide:])
    return ordered.mapInArrow(run, T.StructType([*ordered.schema.fields, *(T.StructField(n, t) for n, (t, _) in outputs.items())]))


def dependency_pick(rows: DataFrame, scope: list[str], order: list[str], item: str, refs: str, kind: str, size: str, per_kind: int, budget: int) -> DataFrame:
    """rows with decision: admitted, or why not: missing_reference, kind_limit or budget, in that order of checks.

    An item needs all items it refers to admitted before it.  A task holds the admitted ids of one scope, which
    the kinds' limits bound.
    """

    def start() -> Callable:
        inside, counts, left = set(), {}, budget

        def step(own, needs, k, n):
            nonlocal left
            if not set(needs or ()) <= inside:
                return ("missing_reference",)
            if counts.get(k, 0) >= per_kind:
                return ("kind_limit",)
            if n > left:
                return ("budget",)
            inside.add(own)
            counts[k] = counts.get(k, 0) + 1
            left -= n
            return ("admitted",)

        return step

    return fold_sorted(rows, scope, order, [item, refs, kind, size], {"decision": (T.StringType(), pa.string())}, start)


def limited_batches(rows: DataFrame, scope: list[str], order: list[str], limits: dict[str, int], calls: int) -> DataFrame:
    """rows with batch (from 1): a row that would pass any limit opens the next one; null beyond `calls` batches."""
    most = list(limits.values())

    def start() -> Callable:
        batch, totals = 0, [0] * len(most)

        def step(*sizes):
            nonlocal batch, totals
            ahead = [t + (s or 0) for t, s in zip(totals, sizes, strict=True)]
            if batch == 0 or any(a > m for a, m in zip(ahead, most, strict=True)):
                batch, ahead = batch + 1, [s or 0 for s in sizes]
            totals = ahead
            return (batch if batch <= calls else None,)

        return step

    return fold_sorted(rows, scope, order, list(limits), {"batch": (T.IntegerType(), pa.int32())}, start)


def diverse_directions(rows: DataFrame, scope: list[str], order: list[str], anchors: str, stage: str, terms: str, most: int) -> DataFrame:
    """rows with selected: in order, those unlike all selected before, `most` in all.

    Alike: anchors with a Jaccard similarity of 0.8, or of 0.6 at the same stage, or question terms with one of
    0.68.  A task holds the selected rows of one scope, `most` at the most.
    """

    def alike(a: set, b: set) -> float:
        return len(a & b) / len(a | b) if a or b else 0.0

    def start() -> Callable:
        chosen: list[tuple[set, object, set]] = []

        def step(own, at, words):
            own, words = set(own or ()), set(words or ())
            if len(chosen) == most:
                return (False,)
            for other, there, said in chosen:
                both = alike(own, other)
                if both >= 0.8 or (both >= 0.6 and at == there) or alike(words, said) >= 0.68:
                    return (False,)
            chosen.append((own, at, words))
            return (True,)

        return step

    return fold_sorted(rows, scope, order, [anchors, stage, terms], {"selected": (T.BooleanType(), pa.bool_())}, start)


def group_quota(rows: DataFrame, scope: list[str], group: str, folder: str, first: str, order: list[str], quotas: dict[str, int], per_folder: int, total: int) -> DataFrame:
    """rows chosen with their position: those of `first` before all, then each group's best up to its quota, at most
    `per_folder` of a folder while others are left, then the best of the rest, `total` in all.

    Windows run by group and folder first and keep `total` rows of each, so that what meets in a scope is bounded.
    """
    keys = [F.col(c) for c in order]
    quota = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in quotas.items() for x in pair)), F.col(group)), F.lit(0))
    near = rows.withColumn("__f", F.row_number().over(Window.partitionBy(*scope, group, folder).orderBy(F.desc(first), *keys))).where(F.col("__f") <= total)
    turned = near.withColumn("__late", F.col("__f") > per_folder)
    place = lambda *order: F.row_number().over(Window.partitionBy(*scope, group).orderBy(*order))
    # all of `first` and those before it by order come before a row, whatever their folder
    ranked = turned.withColumn("__g", place(F.desc(first), "__late", *keys)).withColumn("__k", place(F.desc(first), *keys)).where((F.col("__g") <= F.greatest(quota, F.lit(total))) | (F.col("__k") <= total))
    tier = F.when(F.col(first), 0).when(F.col("__g") <= quota, 1).otherwise(2)
    placed = ranked.withColumn("tier", tier).withColumn("position", F.row_number().over(Window.partitionBy(*scope).orderBy("tier", *keys)))
    return placed.where(F.col("position") <= total).drop("__f", "__late", "__g", "__k")


def role_contract(candidates: DataFrame, scope: list[str], role: str, anchor: str, file: str, score: str, minimum: dict[str, int], per_file: int, total: int, fill: str | None = None) -> DataFrame:
    """rows with reason: each required role's best anchors up to its minimum, roles in the order given, then the best
    of the rest by `fill` (the score, if none is named); an anchor once, at most per_file of a file and `total` of a
    scope.  Of several rows of an anchor and role the best counts, then the least file; of an anchor's rows, the
    best by fill, then the least role and file, where the rest is filled.

    Before a scope meets in one task, its candidates are cut to those that can still be chosen.  Of a file, a role
    passes over `total` chosen anchors at most before it has chosen per_file or the file is full; on its way to
    `total` choices it passes over `total` chosen anchors and the rows left of total / per_file full files.  So the
    rows that are kept decide the same as all do, and a task holds what it has selected.
    """
    from gleaner.operators.ranking import top_k

    fill = fill or score
    turn = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in {r: k for k, r in enumerate(minimum)}.items() for x in pair)), F.col(role)), F.lit(len(minimum)))
    of_file = per_file + total
    of_role = 2 * total + total // max(1, per_file) * of_file

    def cut(rows: DataFrame, one: list[str], group: list[str], by: str) -> DataFrame:
        once = top_k(rows, one, [F.desc(by), F.col(role), F.col(file)], 1, "__rank").drop("__rank")
        order = [F.desc(by), F.col(anchor), F.col(role)]
        near = top_k(once, [*group, file], order, of_file, "__rank").drop("__rank")
        return top_k(near, group, order, of_role, "__rank").drop("__rank")

    columns = candidates.columns
    asked = cut(candidates.where(F.col(role).isin(list(minimum))), [*scope, role, anchor], [*scope, role], score).select(*columns, F.lit(0).alias("pass"), turn.alias("turn"), (-F.col(score)).alias("down"))
    rest = cut(candidates, [*scope, anchor], scope, fill).select(*columns, F.lit(1).alias("pass"), F.lit(0).alias("turn"), (-F.col(fill)).alias("down"))

    def start():
        seen, files, roles, chosen = set(), {}, {}, 0

        def step(turn, r, a, f):
            nonlocal chosen
            if a in seen:
                return (False, "duplicate")
            if turn == 0 and roles.get(r, 0) >= minimum[r]:
                return (False, "role_filled")
            if files.get(f, 0) >= per_file:
                return (False, "file_limit")
            if chosen >= total:
                return (False, "total_limit")
            seen.add(a)
            files[f] = files.get(f, 0) + 1
            chosen += 1
            if turn == 0:
                roles[r] = roles.get(r, 0) + 1
            return (True, "reserved" if turn == 0 else "filled")

        return step

    shape = {"selected": (T.BooleanType(), pa.bool_()), "reason": (T.StringType(), pa.string())}
    out = fold_sorted(asked.union(rest), scope, ["pass", "turn", "down", anchor, role], ["pass", role, anchor, file], shape, start)
    return out.where("selected").drop("pass", "turn", "down", "selected")
