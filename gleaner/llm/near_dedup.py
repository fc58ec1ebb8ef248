"""MinHash near-dedup with SetSketch registers.

Each distinct shingle set gets `BANDS * ROWS` registers of a SetSketch (Ertl, 2021): a register keeps
the minimum over the set of exponentially distributed hash values, truncated to exponentially spaced
levels, so sketches of parts merge by maximum and equal registers signal similar sets.  Bands of
register values propose pairs, the joint likelihood of the register comparison screens them, and
the full shingle sets decide.

Hot groups stay linear.  Equal sets collapse to one node first.  Within a bucket every set is paired
with the least one only; once those links have made components, the buckets that still hold more than
one component are compared across components in blocks of bounded size inside the tasks, by exact
intersection counts, and only links that join components leave a task, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import components, lean, meet, of_ids, release, rewrite, settle, table
from gleaner.llm.words import flat, mix, shingle_set, shingles, slices, words

BANDS, ROWS = 30, 5
REGISTERS = BANDS * ROWS
#: Ratio of neighbouring register levels: so near 1 that two sets' registers agree about as often as minima do.
LEVEL = 1.001
#: Log-likelihood by which the best similarity may beat the threshold before a pair is given up (about 5.5 sigma).
SLACK = 15.0
#: Sets of a bucket, and shingles of theirs, that are compared with as many others at once, about.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: Columns of the membership matrices multiplied at once.
COLUMNS = 8192
#: Bytes of texts sketched at once, or one text more.
PART_BYTES = 1 << 19

_SEEDS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def registers(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of registers (uint16) for each non-empty run hashes[at[i]:at[i + 1]].

    A register is clip(1 - floor(log_b x), 0, 65535) for the least exponential value x of the run,
    with x scaled so that sets of 1 to 10**9 shingles stay clear of both ends.
    """
    out = np.empty((len(at) - 1, REGISTERS), np.uint16)
    step = np.log(LEVEL)
    for r in range(REGISTERS):
        least = np.minimum.reduceat((hashes ^ (hashes >> np.uint64(29))) * _SEEDS[r], at[:-1])
        uniform = (least >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
        level = 1 - np.floor((np.log(-np.log1p(-uniform)) + 0.0) / step)
        out[:, r] = np.clip(level + 20000, 0, 65535)
    return out


def likelihood(more: np.ndarray, less: np.ndarray, same: np.ndarray, share: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Log-likelihood of Jaccard similarity j, given how many registers of the first set are above,
    below and equal to the second's, and the first set's share of the sum of both sizes."""
    b = LEVEL

    def above(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (b - 1) / b) / np.log(b)

    other = 1 - share
    p, q = above(share - other * j), above(other - share * j)
    tiny = 1e-9
    return more * np.log(p + tiny) + less * np.log(q + tiny) + same * np.log(np.maximum(1 - p - q, tiny))


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Estimated similarity of each pair of register rows, or 0 where the threshold is out of reach."""
    more, same = (a > b).sum(1), (a == b).sum(1)
    less = REGISTERS - more - same
    share = na / (na + nb)
    top = np.minimum(share, 1 - share) / np.maximum(share, 1 - share)
    low, high = np.zeros(len(share)), top.copy()
    for _ in range(25):
        x, y = low + (high - low) * 0.382, low + (high - low) * 0.618
        right = likelihood(more, less, same, share, x) < likelihood(more, less, same, share, y)
        low, high = np.where(right, x, low), np.where(right, high, y)
    best = (low + high) / 2
    reach = likelihood(more, less, same, share, np.minimum(threshold, top))
    ok = (top >= threshold - 1e-12) & ((best >= threshold) | (likelihood(more, less, same, share, best) - reach <= SLACK))
    return np.where(ok, np.maximum(best, 1e-6), 0.0)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = flat(batch.column(1))
        for i, j in slices(np.diff(at), PART_BYTES):
            h, s_at = shingles(words(data[at[i] : at[j]], at[i : j + 1] - at[i]))
            sets = [np.unique(h[s:e]) for s, e in zip(s_at[:-1].tolist(), s_at[1:].tolist(), strict=True)]
            sizes = np.array([len(s) for s in sets])
            some = np.flatnonzero(sizes)
            first, second, rows = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64), [None] * (j - i)
            if len(some):
                every = np.concatenate(sets)
                start = np.concatenate([[0], np.cumsum(sizes[some])])
                first[some] = np.add.reduceat(every, start[:-1])
                second[some] = np.bitwise_xor.reduceat(mix(every), start[:-1])
                for k, row in zip(some.tolist(), registers(every, start), strict=True):
                    rows[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), pa.array(rows, pa.binary())],
                ["id", "n", "k1", "k2", "regs"],
            )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def _screen(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b, na, nb, ra, rb = batch.columns
                est = plausible(_matrix(ra), _matrix(rb), na.to_numpy(), nb.to_numpy(), threshold)
                ok = est > 0
                yield pa.RecordBatch.from_arrays([a.filter(pa.array(ok)), b.filter(pa.array(ok)), pa.array(est[ok])], ["a", "b", "est"])

    return run


def _small_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's shingle set with 32 bits of each hash, for screening in blocks."""
    for batch in batches:
        sets = [(shingle_set(t.as_py()) >> np.uint64(32)).astype(np.uint32).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["set_id", "small"])


def shared_counts(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sets, by products of membership matrices."""
    every, back = np.unique(np.concatenate([*one, *two]), return_inverse=True)
    row = np.repeat(np.arange(len(one) + len(two)), [len(s) for s in (*one, *two)])
    often = np.flatnonzero(np.bincount(back, minlength=len(every)) > 1)  # a hash held once is in no intersection
    place = np.full(len(every), -1)
    place[often] = np.arange(len(often))
    at = place[back]
    row, at = row[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out = np.zeros((len(one), len(two)), np.float32)
    for c in range(0, len(often), COLUMNS):
        i, j = np.searchsorted(at, [c, c + COLUMNS])
        held = np.zeros((len(one) + len(two), min(COLUMNS, len(often) - c)), np.float32)
        held[row[i:j], at[i:j] - c] = 1
        out += held[: len(one)] @ held[len(one) :].T
    return out


def _linked(numerator: int, denominator: int):
    """Pairs (a, b) of different components in one block whose small sets reach the threshold.

    Pairs beyond doubt are thinned to those that join components not joined yet in the block; pairs that a
    chance collision of small hashes could decide all go on to the full sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for left, right, members in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                one, two = ([m for m in members if m["block"] == side] for side in (left, right))
                sets = [[np.frombuffer(m["small"], np.uint32) for m in side] for side in (one, two)]
                if not one or not two:
                    continue
                both = shared_counts(*sets)
                total = np.array([m["n"] for m in one])[:, None] + np.array([m["n"] for m in two])[None, :]
                passes = lambda n, total=total: denominator * n >= numerator * (total - n)
                apart = np.array([m["component"] for m in one])[:, None] != np.array([m["component"] for m in two])[None, :]
                root: dict[int, int] = {}

                def top(c: int, root=root) -> int:
                    while (up := root.get(c, c)) != c:
                        c = up
                    return c

                most = np.maximum(np.array([m["n"] for m in one])[:, None], np.array([m["n"] for m in two])[None, :]) ** 2 / 2.0**32
                doubt = 2 + most + 6 * np.sqrt(most)  # small hashes that fall together by chance, about Poisson
                sure = passes(both - doubt)
                for i, j in np.argwhere(apart & passes(both + doubt)).tolist():
                    a, b = one[i], two[j]
                    if sure[i, j]:
                        x, y = top(a["component"]), top(b["component"])
                        if x == y:
                            continue
                        root[max(x, y)] = min(x, y)
                    found.append((max(a["set_id"], b["set_id"]), min(a["set_id"], b["set_id"])))
            rows = sorted(set(found))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], ["a", "b"])

    return run


def _confirm(numerator: int, denominator: int):
    """Rows come sorted by (b, part), the text of b (own = 0) before those that are held against it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept = None, []
        for batch in batches:
            out = []
            for b, part, own, a, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own == 0:
                    kept = [*kept, shingle_set(text)] if held == (b, part) else [shingle_set(text)]
                    held = (b, part)
                    continue
                mine = shingle_set(text)
                for other in kept if held == (b, part) else []:
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    if both and denominator * both >= numerator * (len(mine) + len(other) - both):
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], ["a", "b"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) of ids whose full shingle sets reach numerator / denominator."""
    return meet(pairs, texts).mapInArrow(lean(_confirm(numerator, denominator)), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, numerator: int = 80, denominator: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate classes of documents.

    Two documents are linked when denominator * |A & B| >= numerator * |A | B| for their sets A, B of
    distinct five-word shingles.  Returns one row per row of docs: id_col, n_shingles (set size),
    component_id (least id reachable by links, itself included) and kept (whether that is its own id).

    A text of fewer than five words has one shingle, its whole word sequence; a null or wordless text
    has none and is linked with nothing.  Ids should be unique: rows of one id count as one document.
    A null id is linked with nothing and is kept.  Other columns of docs are ignored.
    """
    threshold = numerator / denominator
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = rewrite(texts.mapInArrow(lean(_sketch), "id long, n long, k1 long, k2 long, regs binary"))
    sets = rewrite(
        sketches.where("n > 0 and id is not null").groupBy("k1", "k2").agg(F.min("id").alias("set_id"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    )
    width = 2 * ROWS
    bands = sets.select("set_id", F.explode(F.array(*(F.xxhash64(F.lit(k), F.substring("regs", k * width + 1, width)) for k in range(BANDS)))).alias("band"))
    buckets = bands.groupBy("band").agg(F.min("set_id").alias("b"), F.max("set_id").alias("top")).where("b < top").select("band", "b")
    shared = rewrite(bands.join(buckets, "band"))
    star = shared.where("set_id <> b").select(F.col("set_id").alias("a"), "b").distinct()
    of = lambda side: sets.select(F.col("set_id").alias(side), F.col("n").alias(f"n{side}"), F.col("regs").alias(f"r{side}"))
    sized = star.join(of("a"), "a").join(of("b"), "b").where(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)
    screened = sized.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(lean(_screen(threshold)), "a long, b long, est double")
    best = screened.groupBy("a").agg(F.max_by("b", F.struct("est", -F.col("b"))).alias("b"))
    links = settle(confirm(best, texts, numerator, denominator))
    first = settle(components(links))
    release(docs.sparkSession)

    owner = shared.select("band", "set_id").join(first.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    sized = owner.join(sets.select("set_id", "n"), "set_id")
    mixed = sized.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES).alias("size")).where("low < high")
    members = rewrite(sized.join(mixed.select("band", F.ceil("size").cast("int").alias("blocks")), "band").withColumn("block", F.pmod(F.xxhash64("set_id"), "blocks").cast("int")))
    small = rewrite(of_ids(members.select(F.col("set_id").alias("id")).distinct(), texts).mapInArrow(lean(_small_sets), "set_id long, small binary").dropDuplicates(["set_id"]))
    spread = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(small, "set_id")
    blocks = spread.groupBy("band", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")).agg(
        F.collect_list(F.struct("set_id", "component", "n", "block", "small")).alias("members")
    )
    across = blocks.select("left", "right", "members").mapInArrow(lean(_linked(numerator, denominator)), "a long, b long").distinct()
    more = settle(confirm(across.join(best, ["a", "b"], "left_anti"), texts, numerator, denominator))
    last = components(links.union(more)) if more.take(1) else first
    owned = sets.select("k1", "k2", "set_id").join(last.withColumnRenamed("node", "set_id"), "set_id", "left")
    known = owned.select("k1", "k2", F.coalesce("component", "set_id").alias("component_id"))
    own = sketches.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("k1")).alias("k1"), "k2").join(known, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "id")
    return own.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 85, 100)


QUERIES = {"op1_near_dedup": op1_near_dedup}
SQL = {
    "op1_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)""",
}
