"""Covering choices: spans that represent every role, then as many buckets as the budget allows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.ranking import top_k


class _Scope:
    """The choice of one scope on its way: what is chosen and covered, and the best span of the bucket at hand."""

    def __init__(self, key: tuple, limit: int) -> None:
        self.key, self.limit = key, limit
        self.chosen: list[tuple] = []
        self.spans, self.roles, self.buckets = set(), set(), set()
        self.open, self.bucket, self.best = True, None, None

    def _take(self, span, phase: str, gain: int, held: list[str]) -> None:
        self.spans.add(span)
        self.buckets.update(held)
        self.roles.update(b.split("\0", 1)[0] for b in held)
        self.chosen.append((*self.key, span, phase, gain, len(self.chosen) + 1))

    def close_bucket(self) -> None:
        if self.best is not None:
            self._take(self.best[1], "bucket", self.best[0], self.best[2])
        self.bucket = self.best = None

    def row(self, phase: int, bucket: str | None, span, held: list[str]) -> None:
        if not self.open:
            return
        if phase == 0:  # a role's own first span; a role covered by an earlier one asks for none
            if bucket not in self.roles:
                if len(self.chosen) == self.limit:
                    self.open, self.chosen = False, [(*self.key, None, "unavailable", 0, 0)]
                    return
                self._take(span, "role", len(set(held) - self.buckets), held)
            return
        if bucket != self.bucket:
            self.close_bucket()
            self.bucket = bucket
        if len(self.chosen) == self.limit:
            return
        if phase == 2:
            if span not in self.spans:
                self._take(span, "fill", 0, held)
        elif bucket not in self.buckets:
            gain = len(set(held) - self.buckets)
            if self.best is None or gain > self.best[0]:
                self.best = (gain, span, held)


def coverage_frontier(members: DataFrame, scope: list[str], span: str, role: str, bucket: str, targets: str, order: str, limit: int, preferred: DataFrame | None = None) -> DataFrame:
    """(scope, span, phase, gain, position): `limit` spans of each scope at most, in the order of their choice.

    Every role is represented first, roles by name: by the span of the best preferred bucket, of the fewest targets,
    then by order.  Then bucket by bucket, preferred ones first, the others by name: a bucket that nothing chosen
    covers gets the span of it that covers most uncovered buckets.  Then spans by order.  If `limit` spans can't
    represent all roles, the scope has one row, phase unavailable and no span.  gain: buckets newly covered.

    `members` has a row for each span and bucket it needs: scope columns, span, role, bucket, and the span's targets
    (a number) and order (unique within a scope); a bucket is one of its role.  `preferred`: scope, role, bucket, rank.
    Rows without span, role or bucket are none.

    A role's first span is a grouped minimum.  For buckets, spans with the same set of them are alike but for their
    order, and the first one stands for all.  What is left passes through one task a scope, sorted by bucket: as
    the covered ones don't change within a bucket, one pass finds each best gain.  A task holds what is chosen and one
    candidate, never a scope's spans.
    """
    rows = members.where(F.col(span).isNotNull() & F.col(role).isNotNull() & F.col(bucket).isNotNull())
    rows = rows.withColumn("__bucket", F.concat_ws("\0", F.col(role).cast("string"), F.col(bucket).cast("string")))
    if preferred is None:
        ranked = rows.withColumn("__rank", F.lit(None).cast("long"))
    else:
        named = preferred.select(*scope, F.concat_ws("\0", F.col(role).cast("string"), F.col(bucket).cast("string")).alias("__bucket"), F.col("rank").cast("long").alias("__rank"))
        ranked = rows.join(named.groupBy(*scope, "__bucket").agg(F.min("__rank").alias("__rank")), [*scope, "__bucket"], "left")
    last = F.lit((1 << 62)).cast("long")
    spans = ranked.groupBy(*scope, F.col(span).alias("__span")).agg(
        F.array_sort(F.collect_set(F.struct(F.coalesce("__rank", last).alias("rank"), F.col("__bucket").alias("bucket")))).alias("__held"), F.first(targets).alias("__targets"), F.first(order).alias("__order")
    )
    names = F.transform("__held", lambda h: h["bucket"])
    spans = spans.select(*scope, "__span", "__targets", "__order", F.transform("__held", lambda h: h["rank"]).alias("__ranks"), names.alias("__names"))
    best = F.array_min("__ranks")
    roles = spans.select(*scope, F.explode(F.array_distinct(F.transform("__names", lambda b: F.substring_index(b, "\0", 1)))).alias("__of"), F.struct(best.alias("a"), F.col("__targets").alias("b"), F.col("__order").alias("c"), "__span", "__names").alias("__key"))
    roles = roles.groupBy(*scope, "__of").agg(F.min("__key").alias("__key"))
    first = roles.select(*scope, F.lit(0).alias("phase"), F.lit(0).cast("long").alias("rank"), F.col("__of").alias("bucket"), F.col("__key.c").alias("order"), "__key.__span", "__key.__names")
    alike = spans.groupBy(*scope, "__names").agg(F.min(F.struct(F.col("__order").alias("order"), "__span", "__ranks")).alias("__one"))
    at = F.explode(F.arrays_zip(F.col("__one.__ranks").alias("rank"), F.col("__names").alias("bucket"))).alias("at")
    by_bucket = alike.select(*scope, "__names", "__one", at).select(*scope, F.lit(1).alias("phase"), "at.rank", "at.bucket", "__one.order", "__one.__span", "__names")
    fill = top_k(spans, scope, [F.col("__order")], limit, "__k").select(*scope, F.lit(2).alias("phase"), F.lit(0).cast("long").alias("rank"), F.lit(None).cast("string").alias("bucket"), F.col("__order").alias("order"), "__span", "__names")
    queue = first.union(by_bucket).union(fill).repartition(*scope).sortWithinPartitions(*scope, "phase", "rank", "bucket", "order")
    wide = len(scope)
    schema = [*members.select(*scope, span).schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Scope | None = None
        for part in batches:
            done = []
            for *key, phase, _, name, _, own, held in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if now is None or tuple(key) != now.key:
                    if now is not None:
                        now.close_bucket()
                        done += now.chosen
                    now = _Scope(tuple(key), limit)
                now.row(phase, name, own, held)
            yield _batch(done, part, wide)
        if now is not None:
            now.close_bucket()
            yield _batch(now.chosen, part, wide)

    from pyspark.sql import types as T

    shape = T.StructType([*schema, T.StructField("phase", T.StringType()), T.StructField("gain", T.IntegerType()), T.StructField("position", T.IntegerType())])
    return queue.mapInArrow(run, shape)


def _batch(rows: list[tuple], like: pa.RecordBatch, wide: int) -> pa.RecordBatch:
    kinds = [*(like.schema.types[:wide]), like.schema.field("__span").type, pa.string(), pa.int32(), pa.int32()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*like.schema.names[:wide], "span", "phase", "gain", "position"])
