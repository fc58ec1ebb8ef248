"""Quality scores by Bradley-Terry ranking.

Preference pairs set a text labelled 1 against one labelled 0.  Under the Bradley-Terry model the first
wins with probability sigmoid(w . (x - y)) for their feature vectors x and y; w maximises the pairs'
likelihood by Newton steps whose gradient and curvature are summed by Spark.  The margin w . x of a text
is then put on the scale of label frequencies by a logistic curve, and a threshold decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import digest, settle, table
from gleaner.llm.words import Words, flat, mix, shingles, slices, words

#: Labelled rows learned from at most, and preference pairs that each of them joins at most as the winner.
ROWS, PAIRS = 20_000, 3
RIDGE = 1e-2

_CLASS = np.zeros((8, 256), np.float32)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'-", b"!?", b"#$%&*|<>=+~^_{}[]()/\\@\"`", b" ", b"\n\r\t", bytes(range(128, 256)))):
    _CLASS[_k, list(_chars)] = 1


def _distinct(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of distinct hashes in each row."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    keys = mix(hashes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.bincount(row[np.unique(keys, return_index=True)[1]], minlength=len(at) - 1)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of numbers for each text: shares of character classes, shapes of words, and repetition."""
    w: Words = words(data, at)
    size, n = np.diff(at), np.diff(w.at)
    some, word = np.maximum(size, 1), np.maximum(n, 1)
    cols = [_sums(_CLASS[k][data], at) / some for k in range(len(_CLASS))]
    length = (w.end - w.start).astype(np.float64)
    mean = _sums(length, w.at) / word
    cols += [mean, np.sqrt(np.maximum(_sums(length**2, w.at) / word - mean**2, 0)), _sums(length > 20, w.at) / word, _sums(length == 1, w.at) / word]
    last = data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    cols += [_sums(_CLASS[3][last] + _CLASS[4][last], w.at) / word, _sums(_CLASS[2][last], w.at) / word]
    again = np.concatenate([[False], w.hashes[1:] == w.hashes[:-1]]) if len(w.hashes) else np.zeros(0, bool)
    again[w.at[:-1][n > 0]] = False
    cols += [_sums(again, w.at) / word, _distinct(w.hashes, w.at) / word]
    runs, run_at = shingles(w, 3)
    cols.append(_distinct(runs, run_at) / np.maximum(np.diff(run_at), 1))
    lines = _sums(data == 10, at) + 1
    cols += [np.log1p(size), np.log1p(n), np.log1p(n / lines)]
    x = np.stack(cols, 1)
    return np.concatenate([x, np.sqrt(np.abs(x)), np.minimum(x[:, 14:17] ** 2, 4)], 1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = flat(batch.column(2))
        for i, j in slices(np.diff(at)):
            x = features(data[at[i] : at[j]], at[i : j + 1] - at[i])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), lists], ["h", "label", "x"])


class Model(NamedTuple):
    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.clip((x - self.middle) / self.spread, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50)))


def _vector(values: np.ndarray) -> F.Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _newton(rows: DataFrame, steps: int, size: int, ridge: float) -> np.ndarray:
    """Maximum-likelihood weights of rows (x array<double>, y 0 or 1); Spark sums, the driver solves size x size."""
    w = np.zeros(size)
    for _ in range(steps):
        shared = w.copy()

        def part(batches: Iterator[pa.RecordBatch], w: np.ndarray = shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size + size * size)
            for batch in batches:
                x = batch.column(0).flatten().to_numpy().reshape(-1, size)
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                total[:size] += x.T @ (batch.column(1).to_numpy() - p)
                total[size:] += ((x * (p * (1 - p))[:, None]).T @ x).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["sums"])

        sums = np.sum([r[0] for r in rows.mapInArrow(part, "sums array<double>").collect()], axis=0)
        n = ridge * np.eye(size)
        step = np.linalg.solve(sums[size:].reshape(size, size) + n, sums[:size] - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "quality", id_col: str = "doc_id", rows: int = ROWS) -> Model | None:
    """Model from at most about `rows` labelled rows, those least by hash of their id; None without both labels."""
    known = labelled.where(F.col(label_col).isin(0, 1)).select(F.xxhash64(id_col, F.lit(9)).alias("h"), F.col(label_col).cast("int").alias("label"), F.col(text_col).alias("text"))
    share = min(1.0, rows / max(known.count(), 1))
    sample = settle(known.where(F.col("h") / F.lit(2.0**63) <= 2 * share - 1).mapInArrow(_features, "h long, label int, x array<double>"))
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not (sizes.get(0) and sizes.get(1)):
        return None
    width = len(sample.first()["x"])
    stats = sample.agg(*(f(F.col("x")[k]) for k in range(width) for f in (F.avg, F.stddev_pop))).first()
    middle, spread = np.array(stats[::2], float), np.maximum(np.array(stats[1::2], float), 1e-3)
    ranked = sample.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("h")) - 1)
    scaled = F.transform("x", lambda v, k: F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (v - F.get(_vector(middle), k)) / F.get(_vector(spread), k))))
    placed = settle(ranked.select("label", "k", scaled.alias("x")))
    partner = F.pmod(F.col("k") * PAIRS + F.col("j"), F.lit(sizes[0]))
    winners = placed.where("label = 1").select("x", "k", F.explode(F.array(*map(F.lit, range(PAIRS)))).alias("j")).select(F.col("x").alias("good"), partner.alias("k"))
    pairs = winners.join(placed.where("label = 0").select("k", F.col("x").alias("bad")), "k").select(F.zip_with("good", "bad", lambda a, b: a - b).alias("x"), F.lit(1.0).alias("y"))
    weights = _newton(settle(pairs), 15, width, RIDGE * sizes[1] * PAIRS)
    margin = F.aggregate(F.zip_with("x", _vector(weights), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    curve = settle(placed.select(F.array(margin, F.lit(1.0)).alias("x"), F.col("label").cast("double").alias("y")))
    slope, shift = _newton(curve, 25, 2, 1e-3)
    return Model(middle, spread, weights, float(slope), float(shift))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score (0 to 1, higher: label 1 likelier) of each text.

    A null text scores as an empty one.  Without a model every score is 0.5.  One row per row of docs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, at = flat(batch.column(1))
            for i, j in slices(np.diff(at)):
                x = features(data[at[i] : at[j]], at[i : j + 1] - at[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(own.score(x) if own else np.full(j - i, 0.5))], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def quantile_cut(scored: DataFrame, share: float, score_col: str = "score") -> float:
    """Score that about `share` of the rows lie below: the threshold that keeps the best 1 - share."""
    return scored.agg(F.percentile_approx(score_col, share, 10_000)).first()[0]


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    train = digest("doc_id") % 4 != 2
    learned = docs.where(train).select("doc_id", "text").join(labels.where(train & F.col("quality").isNotNull()).select("doc_id", "quality"), "doc_id")
    scored = score(docs, fit(learned))
    return scored.select("doc_id", (digest("doc_id") % 4 == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op9_quality": op9_quality}
SQL: dict[str, str] = {}
