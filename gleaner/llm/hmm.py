"""Language-model scores by a hidden Markov model.

States emit symbols: each of the SYMBOLS commonest training words and the end of the text are symbols of
their own, every other word is one of RARE classes by its last two bytes and, within its class, has
probability by its count.  Baum-Welch runs over all training texts: tasks add up expected counts, Spark
sums them, the driver sees states times symbols numbers a round.  A text's probability is exact, by the
scaled forward recursion over its whole token sequence, many texts side by side.

Word counts are kept for every training word.  The TABLE commonest, a bounded number, go to every task;
the other words of each text meet their counts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import digest, settle, table
from gleaner.llm.words import _LOWER, Words, flat, slices, words

STATES, SYMBOLS, RARE, ROUNDS = 8, 4096, 256, 4
TABLE = 1 << 18
#: Tokens over which the expected counts run back and forth at once.  What a stretch takes over from the text on
#: either side is worked out over WARM tokens and then twice as many again and again, until it changes by less than
#: SETTLED or reaches the text's end.
STRETCH, WARM, SETTLED = 1024, 64, 1e-5
#: Cells of the grid of steps and texts that the recursion takes side by side: with expected counts, and without.
TOGETHER, ALONG, TEXTS = 1 << 19, 1 << 22, 512
#: Tokens gathered before they are scored, so that long texts find company of their length.
GATHERED = 3_000_000
END = 0x5DEECE66D

_BYTES = _LOWER.astype(np.uint8)


class Lookup:
    """Positions of uint64 keys by open addressing; -1 where absent."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.key = np.zeros(1 << self.bits, np.uint64)
        rest, home = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(rest):
            free = self.slot[home] < 0
            self.slot[home[free]] = rest[free]
            placed = self.slot[home] == rest
            self.key[home[placed]] = keys[rest[placed]]
            rest, home = rest[~placed], (home[~placed] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        home = self._home(keys)
        out = self.slot[home]
        wrong = np.flatnonzero((out >= 0) & (self.key[home] != keys))
        while len(wrong):
            home[wrong] = (home[wrong] + 1) & ((1 << self.bits) - 1)
            out[wrong] = self.slot[home[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.key[home[wrong]] != keys[wrong])]
        return out


class Model(NamedTuple):
    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray  # symbol by state


def classes(data: np.ndarray, w: Words) -> np.ndarray:
    """Rare class of each word: its last two bytes, lower-cased."""
    last = _BYTES[data[w.end - 1]].astype(np.int64)
    before = np.where(w.end - w.start > 1, _BYTES[data[np.maximum(w.end - 2, 0)]], 0).astype(np.int64)
    return (before * 37 + last) % RARE


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Words]]:
    for batch in batches:
        data, at = flat(batch.column(column))
        for i, j in slices(np.diff(at)):
            part = data[at[i] : at[j]]
            yield batch.slice(i, j - i), part, words(part, at[i : j + 1] - at[i])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count of each word, added up over several slices before it leaves the task."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if not held:
            return []
        w, c, n = (np.concatenate(x) for x in zip(*held, strict=True))
        keys, first, back = np.unique(w, return_index=True, return_inverse=True)
        return [(keys, c[first], np.bincount(back, n, len(keys)).astype(np.int64))]

    ends = 0
    for batch, data, w in _texts(batches, 0):
        ends += batch.num_rows
        keys, first, n = np.unique(w.hashes, return_index=True, return_counts=True)
        held.append((keys, classes(data, w)[first], n))
        if len(held) >= 8:
            held = merged()
            if len(held[0][0]) > 500_000:
                yield _rows(*held.pop())
    held.append((np.array([END], np.uint64), np.array([-1]), np.array([ends])))
    yield _rows(*merged()[0])


def _rows(w: np.ndarray, c: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c.astype(np.int32)), pa.array(n.astype(np.int64))], ["w", "class", "n"])


def _groups(lengths: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    """Sequences of like length, longest first in each group."""
    order = np.argsort(-lengths, kind="stable")
    i = 0
    while i < len(order):
        size = int(max(1, min(TEXTS, cells // max(lengths[order[i]], 1))))
        yield order[i : i + size]
        i += size


def _grid(symbols: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols by step and sequence, and how many sequences are still running at each step."""
    n = at[group + 1] - at[group]
    steps = np.arange(n[0])
    place = np.minimum(at[group][None, :] + steps[:, None], at[group + 1][None, :] - 1)
    return symbols[place], np.searchsorted(-n, -steps, side="left")


def forward(model: Model, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log10 probability of each non-empty sequence symbols[at[i]:at[i + 1]]."""
    out = np.zeros(len(at) - 1)
    for group in _groups(np.diff(at), ALONG):
        grid, running = _grid(symbols, at, group)
        total = np.zeros(len(group))
        alpha = np.broadcast_to(model.start, (len(group), len(model.start)))
        for t in range(len(grid)):
            n = running[t]
            alpha = (alpha[:n] @ model.moves if t else alpha) * model.emits[grid[t, :n]]
            scale = alpha.sum(1)
            alpha /= scale[:, None]
            total[:n] += np.log10(scale)
        out[group] = total
    return out


def stationary(moves: np.ndarray) -> np.ndarray:
    now = np.full(len(moves), 1 / len(moves))
    for _ in range(200):
        now = now @ moves
    return now / now.sum()


def _carried(symbols: np.ndarray, first: np.ndarray, size: np.ndarray, value: np.ndarray, toward: int, update) -> np.ndarray:
    """value of each sequence after update() by its `size` symbols from `first` on, going on (1) or back (-1)."""
    some = np.flatnonzero(size)
    for part in _groups(size[some], ALONG):
        group = some[part]
        n = size[group]
        steps = np.arange(n[0])
        grid = symbols[first[group][None, :] + toward * np.minimum(steps[:, None], n[None, :] - 1)]
        running = np.searchsorted(-n, -steps, side="left")
        now = value[group]
        for t in range(n[0]):
            m = running[t]
            now[:m] = update(now[:m], grid[t, :m])
            now[:m] /= now[:m].sum(1, keepdims=True)
        value[group] = now
    return value


def _settled(run, most: np.ndarray) -> np.ndarray:
    """run(which, width) over doubling widths, up to `most`, until the values hardly change."""
    width = WARM
    value, rest = run(np.arange(len(most)), width), np.flatnonzero(most > width)
    while len(rest):
        width *= 2
        new = run(rest, width)
        moved = np.abs(new - value[rest]).max(1) > SETTLED
        value[rest] = new
        rest = rest[moved & (most[rest] > width)]
    return value


def expected(model: Model, symbols: np.ndarray, at: np.ndarray, into: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """Adds the expected starts, moves and emissions of the sequences (Baum-Welch's first half).

    Sequences go in stretches side by side, each with the forward and backward values of the text around it.
    """
    starts, moves, emits = into
    k = len(model.start)
    lengths = np.diff(at)
    parts = -(-lengths // STRETCH)
    of = np.repeat(np.arange(len(lengths)), parts)
    number = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    cuts = np.append(at[of] + number * STRETCH, at[-1:])
    begin, end = at[of], at[of + 1]
    usual = stationary(model.moves).astype(np.float32)
    start, step, emit = (x.astype(np.float32) for x in model)
    back = np.ascontiguousarray(step.T)

    def before(which: np.ndarray, width: int) -> np.ndarray:
        """Forward values just before the stretches, from `width` tokens on."""
        place = cuts[:-1][which]
        first = np.maximum(begin[which], place - width)
        whole = first == begin[which]
        value = np.where(whole[:, None], start * emit[symbols[first]], usual)
        value /= value.sum(1, keepdims=True)
        return _carried(symbols, first + whole, place - first - whole, value, 1, lambda v, s: (v @ step) * emit[s])

    def after(which: np.ndarray, width: int) -> np.ndarray:
        """Backward values at the stretches' ends, from `width` tokens beyond."""
        place = cuts[1:][which]
        size = np.minimum(end[which], place + width) - place
        return _carried(symbols, place + size - 1, size, np.full((len(which), k), 1 / k, np.float32), -1, lambda v, s: (v * emit[s]) @ back)

    fresh, last = begin == cuts[:-1], end == cuts[1:]
    old, on = np.flatnonzero(~fresh), np.flatnonzero(~last)
    inflow, outflow = np.zeros((len(of), k), np.float32), np.ones((len(of), k), np.float32)
    inflow[old] = _settled(lambda r, w: before(old[r], w), cuts[:-1][old] - begin[old])
    outflow[on] = _settled(lambda r, w: after(on[r], w), end[on] - cuts[1:][on])
    for group in _groups(np.diff(cuts), TOGETHER):
        grid, running = _grid(symbols, cuts, group)
        steps, size = grid.shape
        alpha = np.zeros((steps, size, k), np.float32)
        now = np.where(fresh[group][:, None], start, inflow[group] @ step)
        for t in range(steps):
            n = running[t]
            now = (now[:n] @ step if t else now) * emit[grid[t, :n]]
            now /= now.sum(1, keepdims=True)
            alpha[t, :n] = now
        beta = outflow[group]
        for t in range(steps - 1, -1, -1):
            n = running[t]
            if t + 1 < steps and (m := running[t + 1]):
                # beta holds, for the sequences that go on, the emission-weighted value of step t + 1
                ahead = beta[:m]
                pair = alpha[t, :m] @ step
                norm = (pair * ahead).sum(1, keepdims=True)
                ahead = ahead / norm
                moves += model.moves * (alpha[t, :m].T @ ahead).astype(np.float64)
                beta[:m] = ahead @ back
            gamma = alpha[t, :n] * beta[:n]
            gamma /= gamma.sum(1, keepdims=True)
            alpha[t, :n] = gamma
            beta[:n] *= emit[grid[t, :n]]
        entered = ~fresh[group]
        ahead = beta[entered] / ((inflow[group][entered] @ step) * beta[entered]).sum(1, keepdims=True)
        moves += model.moves * (inflow[group][entered].T @ ahead).astype(np.float64)
        starts += alpha[0][fresh[group]].sum(0, dtype=np.float64)
        live = np.arange(size)[None, :] < running[:, None]
        flat_symbols, flat_gamma = grid[live], alpha[live]
        for s in range(k):
            emits[:, s] += np.bincount(flat_symbols, flat_gamma[:, s], len(emits))


class Words2Symbols(NamedTuple):
    common: np.ndarray  # hashes of the commonest words; position is the symbol

    def sequences(self, find: Lookup, data: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of each text's words and then its end, and the texts' offsets; places of the words."""
        size = len(self.common)
        own = find.find(w.hashes)
        symbol = np.where((own >= 0) & (own < size), own, size + 1 + classes(data, w))
        at = w.at + np.arange(len(w.at))
        out = np.full(at[-1], size, np.int64)
        place = np.arange(len(w.hashes)) + np.repeat(np.arange(len(w.at) - 1), np.diff(w.at))
        out[place] = symbol
        return out, at, own


def train(texts: DataFrame, common: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS, states: int = STATES) -> Model:
    """Baum-Welch over all texts (one column), from a start that favours other symbols in each state."""
    spark = texts.sparkSession
    size = len(common) + 1 + RARE
    noise = np.random.default_rng(11)
    prior = (weight + 0.5) / (weight + 0.5).sum()
    emits = prior[:, None] * noise.gamma(1.0, 1.0, (size, states))
    model = Model(np.full(states, 1 / states), np.full((states, states), 0.1 / (states - 1)) + np.eye(states) * (0.9 - 0.1 / (states - 1)), emits / emits.sum(0))
    shared_words = spark.sparkContext.broadcast(common)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def part(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            code, find = Words2Symbols(shared_words.value), Lookup(shared_words.value)
            sums = (np.zeros(states), np.zeros((states, states)), np.zeros((size, states)))
            for _, data, w in _texts(batches, 0):
                symbols, at, _ = code.sequences(find, data, w)
                expected(shared.value, symbols, at, sums)
            every = np.concatenate([s.ravel() for s in sums])
            some = np.flatnonzero(every)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(every[some])], ["at", "v"])

        total = np.zeros(states + states * states + size * states)
        for r in texts.mapInArrow(part, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toLocalIterator():
            total[r["at"]] = r["v"]
        starts, moves, counts = total[:states], total[states : states + states**2].reshape(states, states), total[states + states**2 :].reshape(size, states)
        starts, moves, counts = starts + 0.1, moves + 0.1, counts + prior[:, None] * 10
        model = Model(starts / starts.sum(), moves / moves.sum(1, keepdims=True), counts / counts.sum(0))
        shared.unpersist()
    return model


def _commonest(counts: DataFrame) -> pa.Table:
    """The commonest words, TABLE at most, by falling count: those above a count that so many reach.

    The cut comes from a histogram of counts over steps of a 32nd of an octave, so no task sorts them all.
    """
    step = F.floor(F.log2("n") * 32)
    left, cut = TABLE, None
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("v")).orderBy(F.desc("step")).collect():
        left -= r["v"]
        if left < 0:
            break
        cut = r["step"]
    chosen = counts.where(step >= cut if cut is not None else F.lit(False)).select("w", "class", "n")
    return chosen.toArrow().combine_chunks().sort_by([("n", "descending"), ("w", "ascending")])


def score_texts(docs: DataFrame, training: F.Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Scores every text after learning from the rows where `training` holds.

    Returns id_col, n_tokens (words and the end), n_known (tokens that training texts have), train_tokens,
    base_score (log10 probability by add-one counts) and score (log10 probability by the hidden Markov
    model).  A null text is empty: its end alone.  Without training texts both scores come from no counts
    and agree.  Every row gives a row, repeated ids and rows too.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), training.alias("training"))
    learned = rows.where("training").select("text")
    counts = settle(learned.mapInArrow(_counts, "w long, class int, n long").where("n > 0").groupBy("w", "class").agg(F.sum("n").alias("n")))
    n_all, v_all = (x or 0 for x in counts.agg(F.sum("n"), F.count("*")).first())
    top = _commonest(counts.where("class >= 0"))
    held, held_class, held_n = (top.column(k).to_numpy() for k in ("w", "class", "n"))
    held = held.view(np.uint64)
    size = min(SYMBOLS, len(held))
    common = held[:size]
    rare = {r["class"]: (r["n"], r["v"]) for r in counts.where("class >= 0").groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    rare_n, rare_v = np.zeros(RARE), np.zeros(RARE)
    for c, (n, v) in rare.items():
        rare_n[c], rare_v[c] = n, v
    rare_n -= np.bincount(held_class[:size], held_n[:size], RARE)
    rare_v -= np.bincount(held_class[:size], minlength=RARE)
    ends = sum(r["n"] for r in counts.where("class < 0").select("n").collect())
    weight = np.concatenate([held_n[:size], [ends], rare_n])
    model = train(learned, common, weight, rounds) if n_all else None
    known = spark.sparkContext.broadcast((held, held_n, common, model, np.log10(rare_n + rare_v + 1)))
    base = float(np.log10(n_all + v_all + 1))

    def main(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_n, common, model, within = known.value
        find, code, logs = Lookup(held), Words2Symbols(common), np.append(np.log10(held_n + 1.0), 0.0)
        held_rows, held_symbols, held_at = [], [], [np.zeros(1, np.int64)]

        def scored() -> Iterator[pa.RecordBatch]:
            symbols, at = np.concatenate(held_symbols), np.concatenate(held_at)
            hmm, first = forward(model, symbols, at) if model is not None else np.zeros(len(at) - 1), 0
            for ids, keys, n, seen, basic, inside in held_rows:
                own = hmm[first : first + len(n)] + inside if model is not None else basic
                first += len(n)
                yield pa.RecordBatch.from_arrays([ids, keys, pa.array(n.astype(np.int64)), pa.array(seen.astype(np.int64)), pa.array(basic), pa.array(own)], ["id", "key", "n_tokens", "known", "base", "hmm"])

        for batch, data, w in _texts(batches, 2):
            symbols, at, own = code.sequences(find, data, w)
            between = lambda values, w=w: (total := np.concatenate([[0.0], np.cumsum(values)]))[w.at[1:]] - total[w.at[:-1]]
            rare_at = (own >= len(common)) | (own < 0)
            inside = between(np.where(rare_at, logs[own] - within[classes(data, w)], 0.0))
            n = np.diff(at)
            held_rows.append((batch.column(0), batch.column(1), n, between(own >= 0) + (ends > 0), between(logs[own]) + np.log10(ends + 1.0) - n * base, inside))
            held_symbols.append(symbols.astype(np.int16))
            held_at.append(at[1:] + held_at[-1][-1])
            if held_at[-1][-1] >= GATHERED:
                yield from scored()
                held_rows, held_symbols, held_at = [], [], [np.zeros(1, np.int64)]
        if held_rows:
            yield from scored()

    def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words of each text outside the table, with their number; and for each row of the key one of number 0."""
        find = Lookup(known.value[0])
        for batch, _, w in _texts(batches, 1):
            keys = batch.column(0).to_numpy()
            own = np.repeat(np.arange(batch.num_rows), np.diff(w.at))
            out = find.find(w.hashes) < 0
            pair = np.stack([own[out].astype(np.uint64), w.hashes[out]], 1)
            order = np.lexsort((pair[:, 1], pair[:, 0]))
            pair = pair[order]
            new = np.ones(len(pair), bool)
            new[1:] = (pair[1:] != pair[:-1]).any(1)
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(pair)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(keys[pair[first, 0].astype(np.int64)], keys)), pa.array(np.append(pair[first, 1].view(np.int64), keys)), pa.array(np.append(n, np.zeros(len(keys), np.int64)).astype(np.int64))],
                ["key", "w", "n"],
            )

    keyed = rows.select("id", F.xxhash64("id", "text").alias("key"), "text")
    scored = keyed.mapInArrow(main, "id long, key long, n_tokens long, known long, base double, hmm double")
    rest = keyed.select("key", "text").mapInArrow(tail, "key long, w long, n long")
    met = rest.join(counts.select("w", F.col("n").alias("c")), "w", "left")
    more = met.groupBy("key").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("logs"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more"),
        F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).alias("copies"),
    )
    joined = scored.join(more, "key")
    logs, seen = F.col("logs") / F.col("copies"), (F.col("more") / F.col("copies")).cast("long")
    return joined.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("known") + seen).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("hmm") + logs).alias("score")
    )


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs, digest("doc_id") % 7 != 2)
    return scored.select("doc_id", (digest("doc_id") % 7 == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op6_lm_score": op6_lm_score}
SQL: dict[str, str] = {}
