"""Hard-negative mining with a residue number system.

Exact integer scores come from float32 matrix products: components are reduced modulo several primes small
enough that a product over `DEPTH` components stays below 2**24, where float32 is exact.  As many primes are
used as the largest possible score asks for, and the Chinese remainders put the signed scores together.

Anchors and rows meet in blocks: every block of anchors with every block of rows, each of a bounded number of
bytes.  A first pass keeps each anchor's best rows of its own label (positives); a second one keeps, for each
positive, the best rows of other labels whose scores lie in its window.  Blocks hand on the few rows that
may yet be chosen, and windows over them choose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import rewrite, table

#: Components that one float32 product sums: DEPTH * 509**2 < 2**24, for residues of primes below 1020.
DEPTH = 64
PRIMES = [p for p in range(1019, 2, -2) if all(p % q for q in range(3, 32, 2))]
#: Components of this magnitude and more count as not finite.
HUGE = 2.0**200
#: Bytes of vectors in a block, and rows of it at most; rows at least, and blocks wished for where there are more.
BLOCK_BYTES, BLOCK_ROWS, LEAST_ROWS, BLOCKS = 16 << 20, 1 << 16, 2048, 32
#: Scores looked at together.
TILE = 1 << 20
#: Stands for an id that is null: behind all others.
LAST = (1 << 63) - 1


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Whole numbers modulo p, between -p/2 and p/2, exact for doubles of any size."""
    r = np.fmod(x, p)
    r[r > p // 2] -= p
    r[r < -(p // 2)] += p
    return r.astype(np.float32)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with the rows of b, which hold whole numbers as doubles, exactly.

    A score that no long can hold becomes the nearest one.
    """
    size = a.shape[1]
    bound = size * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    digits: list[np.ndarray] = []
    product = 1
    for p in PRIMES:
        left, right = residues(a, p), residues(b, p).T
        rest = np.zeros((len(a), len(b)), np.int64)
        for k in range(0, size, DEPTH):
            rest += (left[:, k : k + DEPTH] @ right[k : k + DEPTH]).astype(np.int64)
        # the digit of p in mixed radix: what the earlier digits leave, divided by the earlier primes
        place = 1
        for d, q in zip(digits, PRIMES, strict=False):
            rest -= d * (place % p)
            place *= q
        digit = rest % p * pow(place, -1, p) % p
        digits.append(np.where(digit > p // 2, digit - p, digit))
        product *= p
        if product > 2 * bound:
            break
    else:
        raise ValueError(f"scores up to {bound} need more primes")
    whole = digits[-1].astype(np.int64 if bound <= LAST else object)
    for d, p in reversed([*zip(digits[:-1], PRIMES, strict=False)]):
        whole = whole * p + d
    return whole if bound <= LAST else np.clip(whole, -LAST - 1, LAST).astype(np.int64)


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(256 x) of all components, as doubles; shorter vectors go on with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), width))
    out[np.arange(width) < sizes[:, None]] = np.floor(256.0 * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    return out


class Best:
    """The first `k` of each slot by falling score, then id; what can't be among them is let go as it comes."""

    def __init__(self, slots: int, k: int) -> None:
        self.k, self.floor = k, np.full(slots, -LAST - 1, np.int64)
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.waiting.append((slot, score, ids))
        self.held += len(slot)
        if self.held > TILE:
            self.settle()

    def settle(self) -> None:
        parts = [(self.slot, self.score, self.id), *self.waiting]
        slot, score, ids = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((ids, ~score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        place = np.arange(len(slot)) - np.repeat(first, np.diff(first, append=len(slot)))
        full = place == self.k - 1
        self.floor[slot[full]] = score[full]
        keep = place < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]
        self.waiting, self.held = [], 0


def _sides(block: pa.Table) -> tuple[dict[str, np.ndarray], pa.Table]:
    """The block's rows as arrays (matrix, uid, id, label), and its anchors as a table with theirs."""
    own = block["own"].to_numpy()
    sizes = np.diff(block["embedding"].combine_chunks().offsets.to_numpy())
    width = int(sizes.max(initial=0))

    def side(part: pa.Table) -> dict[str, np.ndarray]:
        vectors = part["embedding"].combine_chunks()
        return {"matrix": _matrix(vectors, width)} | {c: part[c].to_numpy() for c in ("uid", "id", "label")}

    anchors = block.filter(pa.array(own == 0))
    return side(block.filter(pa.array(own == 1))), anchors, side(anchors)


def _tiles(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Scores of anchors and rows, TILE of them at a time."""
    wide = min(len(b["id"]), 2048)
    tall = max(1, TILE // max(1, wide))
    for i in range(0, len(a["id"]), tall):
        for j in range(0, len(b["id"]), wide):
            s, t = slice(i, i + tall), slice(j, j + wide)
            yield s, t, scores(a["matrix"][s], b["matrix"][t])


def _positives(k: int):
    def run(block: pa.Table) -> pa.Table:
        rows, _, anchors = _sides(block)
        best = Best(len(anchors["id"]), k)
        for s, t, score in _tiles(anchors, rows):
            fit = (anchors["label"][s, None] == rows["label"][t]) & (anchors["uid"][s, None] != rows["uid"][t]) & (score >= best.floor[s, None])
            i, j = np.nonzero(fit)
            best.add(i + s.start, score[i, j], rows["id"][t][j])
        best.settle()
        return pa.table({"uid": anchors["uid"][best.slot], "score": best.score, "id": best.id})

    return run


def _negatives(k: int, low: int, high: int):
    def run(block: pa.Table) -> pa.Table:
        rows, table, anchors = _sides(block)
        chosen = table["positives"].combine_chunks()
        counts = np.diff(chosen.offsets.to_numpy())
        each = chosen.flatten()
        score_of, id_of = each.field("score").to_numpy(), each.field("id").to_numpy()
        # a slot for each anchor and place of a positive; the window of a place that no positive takes is empty
        places = int(counts.max(initial=0))
        taken = np.arange(places) < counts[:, None]
        least, most = np.ones(taken.shape, np.int64), np.zeros(taken.shape, np.int64)
        least[taken] = [-(-low * s // 100) for s in score_of.tolist()]
        most[taken] = [high * s // 100 for s in score_of.tolist()]
        best = Best(taken.size, k)
        for s, t, score in _tiles(anchors, rows):
            other = anchors["label"][s, None] != rows["label"][t]
            for n in range(places):
                floor = np.maximum(least[s, n], best.floor[n :: places][s])
                i, j = np.nonzero(other & (score >= floor[:, None]) & (score <= most[s, n, None]))
                best.add((i + s.start) * places + n, score[i, j], rows["id"][t][j])
        best.settle()
        at, place = np.divmod(best.slot, max(1, places))
        start = np.cumsum(counts) - counts
        of = start[at] + place
        return pa.table({"uid": anchors["uid"][at], "place": place.astype(np.int32), "anchor_id": anchors["id"][at], "positive_id": id_of[of], "positive_score": score_of[of], "negative_id": best.id, "negative_score": best.score})

    return run


def _first(rows: DataFrame, by: list[str], k: int, score: str, key: str) -> DataFrame:
    """The first k rows of each group by falling score, then id, with their place as `rank`."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), key))).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: Column | None = None, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90)) -> DataFrame:
    """For each anchor and each of its first `positives` other rows of the same label, the first `negatives` rows of
    other labels whose score is between the two percentages of the positive's: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score.

    `rows` has vec_id, embedding (an array of numbers) and label; further columns are not read.  `anchors` says
    which rows are anchors (by default those whose vec_id is divisible by 100).  Scores are inner products of
    floor(256 x); higher ones come first, ties by smaller vec_id, rows without one behind all others.

    Rows with a null label, a null vector, or a component that is null, not finite or 2**192 and more take no
    part.  Vectors of unequal length meet as if the shorter went on with zeros.  Rows that repeat are rows of their
    own: each is an anchor, a positive ("other" means any other row) and a negative; two positives of one id give
    their rows twice.  Scores beyond a long count as the nearest long.  Without rows or anchors the result is empty.

    The rows taken are settled once.  A task holds one block of each side (BLOCK_BYTES of vectors or one row more)
    and the few rows that each anchor may yet choose.  Every row moves once for each block of anchors, and every
    anchor once for each block of rows.
    """
    spark = rows.sparkSession
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * 256 < HUGE)
    taken = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST)).alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("wide"),
        F.col("embedding"), F.coalesce(anchors if anchors is not None else F.col("vec_id") % 100 == 0, F.lit(False)).alias("anchor"),
    )
    taken = rewrite(taken.where(F.forall("wide", sound)).drop("wide").withColumn("uid", F.monotonically_increasing_id()))
    n, width, asked = taken.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0)), F.count_if("anchor")).first()
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, width))))
    parts = -(-n // min(most, max(LEAST_ROWS, n // BLOCKS))) or 1
    groups = -(-asked // most) or 1
    lot = lambda of, salt: F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    vectors = taken.select(every(groups).alias("g"), lot(parts, 1).alias("b"), F.lit(1).alias("own"), "uid", "id", "label", "embedding")

    def met(asking: DataFrame, more: list[str]) -> DataFrame:
        side = asking.select(lot(groups, 2).alias("g"), every(parts).alias("b"), F.lit(0).alias("own"), "uid", "id", "label", "embedding", *more)
        return side.unionByName(vectors, allowMissingColumns=True).repartition(groups * parts, "g", "b").groupBy("g", "b")

    asking = taken.where("anchor").drop("anchor")
    found = met(asking, []).applyInArrow(_positives(positives), "uid long, score long, id long")
    chosen = _first(found, ["uid"], positives, "score", "id").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("positives"))
    schema = "uid long, place int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = met(asking.join(chosen, "uid"), ["positives"]).applyInArrow(_negatives(negatives, *window), schema)
    known = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias(c)
    return _first(found, ["uid", "place"], negatives, "negative_score", "negative_id").select(known("anchor_id"), known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score")


def relabelled(rows: DataFrame) -> DataFrame:
    """The contract's labels: where vec_id is divisible by 7, (label + 1) % 10."""
    label = F.col("label").cast("long")
    return rows.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(relabelled(table(spark, sf_dir, "embeddings")))


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
SQL = {
    "op13_hard_negatives": """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, row_number() OVER () AS uid FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.uid, a.vec_id AS anchor_id, e.vec_id, e.label = a.label AS same, e.uid = a.uid AS self, list_inner_product(a.v, e.v)::BIGINT AS score FROM e a JOIN e ON true WHERE a.vec_id % 100 = 0),
    p AS (SELECT uid, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS place FROM s WHERE same AND NOT self QUALIFY place <= 5)
    SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.uid, place ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s ON s.uid = p.uid WHERE NOT same AND score * 100 BETWEEN 30 * positive_score AND 90 * positive_score QUALIFY rank <= 10"""
}
