"""Substring dedup by compact windows.

Under a hash function the Cartesian tree over a text's shingle hashes groups all its stretches by their
minimum: the node of shingle c, with l and r the places of the nearest smaller hashes beside it, stands
for every stretch that lies between l and r and holds c.  Only nodes that span `least` shingles matter,
about two in least + 1 of all; their minima are the signatures that near-duplicate passages share.

Signatures meet in a window: each text that holds one is paired with the first text
(by id) that does, with every earlier one where at most SMALL texts do, and beyond with the first that also
has the same words near it.  Beside each signature stands a code of what surrounds it: a byte for the least
hash of each of the four stretches of shingles after and before it.  A pair that shares a single signature
goes on only if two of these bytes agree, as a passage's do, so that common phrases move no texts.  Within
a pair the runs of equal shingles, over all places of both texts, are chained and verified by the Jaccard
similarity of their shingles.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import COARSE, lean, meet, release, rewrite, table
from gleaner.llm.words import SHINGLE, flat, mix, powers, shingles, slices, words

#: Hash functions, and words of the shortest passage.  A passage has at least one signature of each function;
#: copies with similarity s share each with probability s, and one shared signature makes a pair.
HASHES, WORDS = 4, 50
#: Texts that hold a signature up to which all their pairs are made.
SMALL = 8
#: Shingles of the longest run that a passage with similarity 0.8 has at least: each break leaves four or more
#: unlike on both sides, so m breaks need 32 m shared ones in m + 1 runs.
LONG = 16
#: Stretches coded on each side of a signature, and codes that a pair of a single signature has in common: a passage
#: covers four stretches at least, of which one break leaves two or more.
SIDES, COMMON = 4, 2
#: Shingles on both sides of a place by which two places of one text are told apart.
AROUND = 64
#: Bytes of texts whose shingles a task holds at once.
TEXT_BYTES = 1 << 19
#: Pairs of equal shingles held at once; runs that are all chained, and width about long ones beyond.
PAIRS, MANY, CELL = 1 << 20, 64, 64
_SEEDS = mix(np.arange(101, 101 + HASHES, dtype=np.uint64))


def sliding(values: np.ndarray, size: int, op: np.ufunc) -> np.ndarray:
    """op over each run of `size` values, in log2(size) steps."""
    out, width = values, 1
    while width * 2 <= size:
        out = op(out[:-width], out[width:])
        width *= 2
    n = len(values) - size + 1
    return op(out[:n], out[size - width : size - width + n])


def centres(hashes: np.ndarray, row: np.ndarray, least: int) -> np.ndarray:
    """Places whose hash is the minimum of some run of `least` hashes of one row: the nodes of the rows'
    Cartesian trees that span so many."""
    if len(hashes) < least:
        return np.zeros(0, np.int64)
    low = sliding(hashes, least, np.minimum)
    low[row[: len(low)] != row[least - 1 :]] = 0
    pad = np.zeros(least - 1, np.uint64)
    return np.flatnonzero((sliding(np.concatenate([pad, low, pad]), least, np.maximum) == hashes) & (hashes > 0))


def spans(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the tree nodes of one text in order: first and last place of the stretches each stands for.

    The nearest smaller hashes of a node are its ancestors, so they are among the nodes given.
    """
    left, right, stack = np.zeros(len(at), np.int64), np.full(len(at), len(hashes) - 1, np.int64), []
    for k, value in enumerate(hashes[at].tolist()):
        while stack and stack[-1][1] > value:
            right[stack.pop()[0]] = at[k] - 1
        if stack:
            left[k] = at[stack[-1][0]] + 1
        stack.append((k, value))
    return left, right


def stretch(least: int) -> int:
    """Shingles of a coded stretch: so few that any run of `least` about a signature covers SIDES of them."""
    return max(1, (least + 2) // 6)


def surroundings(code: np.ndarray, row: np.ndarray, c: np.ndarray, width: int) -> np.ndarray:
    """Eight bytes for each place c: the codes of the stretches of `width` shingles before and after it, or 0
    beyond the text's edge.  code: of the stretch that begins at each place."""
    out = np.zeros(len(c), np.uint64)
    for k, step in enumerate([-width * s for s in range(SIDES, 0, -1)] + [1 + width * s for s in range(SIDES)]):
        at = c + step
        inside = np.flatnonzero((at >= 0) & (at < len(code)))
        inside = inside[(row[at[inside]] == row[c[inside]]) & (row[at[inside] + width - 1] == row[c[inside]])]
        out[inside] |= code[at[inside]] << np.uint64(8 * k)
    return out


def _signatures(least: int):
    """Rows (v, doc, near, again) of each text's nodes under every hash function."""
    width = stretch(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, at = flat(batch.column(1))
            for i, j in slices(np.diff(at), TEXT_BYTES):
                own, own_at = shingles(words(data[at[i] : at[j]], at[i : j + 1] - at[i]))
                if len(own) < least:
                    continue
                row = np.repeat(np.arange(j - i), np.diff(own_at))
                code = sliding(mix(own ^ _SEEDS[0]), width, np.minimum) % np.uint64(255) + np.uint64(1)
                for k in range(HASHES):
                    hashes = mix(own ^ _SEEDS[k])
                    c = centres(hashes, row, least)
                    v = mix(hashes[c] + np.uint64(k))
                    order = np.lexsort((c, v, row[c]))
                    new = np.ones(len(c), bool)
                    new[1:] = (v[order][1:] != v[order][:-1]) | (row[c][order][1:] != row[c][order][:-1])
                    first = np.flatnonzero(new)  # a text has each signature once, at its first place
                    again = np.diff(np.append(first, len(c))) > 1
                    c, v = c[order[first]], v[order[first]]
                    near = surroundings(code, row, c, width)
                    yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(ids[i:j][row[c]]), pa.array(near.view(np.int64)), pa.array(again)], ["v", "doc", "near", "again"])

    return run


def _distinct(y: np.ndarray, repeated: int) -> np.ndarray:
    """The places of y, of which `repeated` hold the shingle of an earlier one, but those whose AROUND shingles on both sides stand around an earlier place as well: what
    matches there matches here, and texts that repeat themselves don't meet all their places with all."""
    width = 2 * AROUND + 1
    if repeated < width:
        return np.arange(len(y))
    power, inverse = powers(len(y))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(y) * power)])
    key = (total[width:] - total[:-width]) * inverse[: len(y) - width + 1]
    first = np.unique(key, return_index=True)[1] + AROUND
    return np.concatenate([np.arange(AROUND), np.sort(first), np.arange(len(y) - AROUND, len(y))])


class Target(NamedTuple):
    """A text that others are held against: its shingles, and its distinct places in order of their shingle."""

    own: np.ndarray
    order: np.ndarray
    sorted: np.ndarray


def target(y: np.ndarray) -> Target:
    order = np.argsort(y, kind="stable")
    held = y[order]
    places = _distinct(y, int((held[1:] == held[:-1]).sum()))
    if len(places) < len(y):
        order = places[np.argsort(y[places], kind="stable")]
        held = y[order]
    return Target(y, order, held)


def _runs(x: np.ndarray, y: Target, apart: int) -> np.ndarray:
    """Rows (place in x, place in y, length) of the maximal runs of shingles that x and y share, over all distinct
    places in y; apart: only runs at least so far behind their place in y, for a text held against itself."""
    low = np.searchsorted(y.sorted, x)
    at = np.flatnonzero(y.sorted[np.minimum(low, len(y.sorted) - 1)] == x)
    low, high = low[at], np.searchsorted(y.sorted, x[at], "right")
    total = np.cumsum(high - low)
    out, s = [], 0
    while s < len(at):
        e = max(s + 1, int(np.searchsorted(total, (total[s - 1] if s else 0) + PAIRS, "right")))
        n = high[s:e] - low[s:e]
        i = np.repeat(at[s:e], n)
        j = y.order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n - low[s:e], n)]
        if apart:
            i, j = i[i - j >= apart], j[i - j >= apart]
        key = np.sort((i - j + len(y.own)) * (len(x) + 1) + i)
        first = np.flatnonzero(np.diff(key, prepend=-2) != 1)
        out.append(np.stack([key[first], np.diff(np.append(first, len(key)))], 1))
        s = e
    if not out:
        return np.zeros((0, 3), np.int64)
    key, n = np.concatenate(out).T
    if len(out) > 1:  # runs that go on from one part of the pairs to the next
        order = np.argsort(key)
        key, n = key[order], n[order]
        first = np.flatnonzero(np.append(-1, key[:-1] + n[:-1]) != key)
        key, n = key[first], np.add.reduceat(n, first)
    place = key % (len(x) + 1)
    return np.stack([place, place + len(y.own) - key // (len(x) + 1), n], 1)


def _pieces(runs: np.ndarray) -> np.ndarray:
    """Runs of a text with itself, those that reach into their own place cut into pieces that do not."""
    out = []
    for i, j, n in runs.tolist():
        most = i - j - SHINGLE + 1
        out += [(i + k, j + k, min(n, most)) for k in [*range(0, n - most, most), max(0, n - most)]]
    return np.array(out, np.int64).reshape(-1, 3)


def _outer(runs: np.ndarray, least: int) -> np.ndarray:
    """Of the runs of at least `least` shingles as few as cover their places in x, and the others that lie in none of those."""
    runs = runs[np.lexsort((runs[:, 1], -runs[:, 2], runs[:, 0]))]
    big = runs[runs[:, 2] >= least]
    chosen = np.array([k for _, _, k in _cover([(i, i + n, k) for k, (i, _, n) in enumerate(big.tolist())])], np.int64)
    end = runs[:, 0] + runs[:, 2]
    held = np.maximum.accumulate(np.where(runs[:, 2] >= least, end, 0))
    return np.concatenate([big[chosen], runs[(runs[:, 2] < least) & (end > held)]])


def _near_long(runs: np.ndarray, long: int) -> np.ndarray:
    """The runs of at least `long` shingles, and others within about CELL places and diagonals of one."""
    i, d, n = runs[:, 0], runs[:, 1] - runs[:, 0], runs[:, 2]
    big = n >= long
    cells = n[big] // CELL + 4
    row = np.repeat(i[big] // CELL - 1, cells) + np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
    col = np.repeat(d[big] // CELL, cells)
    held = np.concatenate([row * (1 << 32) + col + k for k in (-1, 0, 1)])
    return runs[big | np.isin(i // CELL * (1 << 32) + d // CELL, held)]


def _diagonals(runs: np.ndarray, same: bool, spare: float) -> list[list[tuple[int, int, int]]]:
    """Chains of the runs that follow each other on one diagonal without more unlike shingles between them than allowed."""
    chains: list[list[tuple[int, int, int]]] = []
    held = end = 0
    for i, j, n in runs[np.lexsort((runs[:, 0], runs[:, 0] - runs[:, 1]))].tolist():
        on = chains and chains[-1][0][0] - chains[-1][0][1] == i - j and 2 * (i - end) <= spare * (held + n)
        if on and not (same and j + n + SHINGLE - 1 > chains[-1][0][0]):
            chains[-1].append((i, j, n))
            held += n
        else:
            chains.append([(i, j, n)])
            held = n
        end = i + n
    return chains


def _chains(runs: np.ndarray, same: bool, threshold: float) -> list[list[tuple[int, int, int]]]:
    """Runs joined into chains: again and again, neighbours that are each other's nearest and leave no more
    unlike shingles between them than the threshold allows for what they share.

    Of a passage's runs some two neighbours always are so: else its gaps would pass what it allows itself.
    """
    spare = 1 / threshold - 1
    chains = _diagonals(runs, same, spare)
    i0, j0 = (np.array([c[0][k] for c in chains]) for k in (0, 1))
    i1, j1 = (np.array([c[-1][k] + c[-1][2] for c in chains]) for k in (0, 1))
    n = np.array([sum(r[2] for r in c) for c in chains])
    while len(chains) > 1:
        size = len(chains)
        best, follower = np.full(size, np.inf), np.zeros(size, np.int64)  # of each chain, what comes after it
        least, leader = np.full(size, np.inf), np.zeros(size, np.int64)  # and before it
        step = max(1, PAIRS // size)
        for s in range(0, size, step):
            part = slice(s, s + step)
            gx, gy = i0[None, :] - i1[part, None], j0[None, :] - j1[part, None]
            lap = np.minimum(0, np.minimum(gx, gy))  # shingles that both hold are counted once
            gx, gy = gx - lap, gy - lap
            fit = (i0[None, :] > i0[part, None]) & (j0[None, :] > j0[part, None]) & (i1[None, :] > i1[part, None]) & (j1[None, :] > j1[part, None])
            both = n[part, None] + n[None, :] + lap
            fit &= gx + gy <= spare * both
            if same:
                fit &= j1[None, :] + SHINGLE - 1 <= i0[part, None]
            cost = np.where(fit, gx + gy - both / (1 << 32), np.inf)
            follower[part], best[part] = cost.argmin(1), cost.min(1)
            top = cost.argmin(0)
            value = cost[top, np.arange(size)]
            better = value < least
            least[better], leader[better] = value[better], top[better] + s
        mutual = np.flatnonzero(np.isfinite(best) & (leader[follower] == np.arange(size)))
        if not len(mutual):
            break
        keep, used = np.ones(size, bool), set()
        for a in mutual.tolist():
            b = int(follower[a])
            if a in used or b in used:
                continue
            used |= {a, b}
            n[a] += n[b] + min(0, i0[b] - i1[a], j0[b] - j1[a])
            i1[a], j1[a] = i1[b], j1[b]
            chains[a] += chains[b]
            keep[b] = False
        chains = [c for c, k in zip(chains, keep.tolist(), strict=True) if k]
        i0, i1, j0, j1, n = i0[keep], i1[keep], j0[keep], j1[keep], n[keep]
    return chains


def _sorted_set(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def _verified(x: np.ndarray, y: np.ndarray, runs: list[tuple[int, int, int]], least: int, threshold: float) -> Iterator[tuple[int, int, int, int, float]]:
    """Passages of a chain of runs (place in x, place in y, length); an unlike chain is split at its widest gap."""
    a, b = runs[0][0], runs[-1][0] + runs[-1][2]
    c, d = runs[0][1], runs[-1][1] + runs[-1][2]
    if b - a < least:
        return
    if len(runs) == 1:  # a run is the same shingles on both sides
        yield a, b, c, d, 1.0
        return
    mine, other = _sorted_set(x[a:b]), _sorted_set(y[c:d])
    every = np.sort(np.concatenate([mine, other]))
    both = int((every[1:] == every[:-1]).sum())
    alike = both / (len(mine) + len(other) - both)
    if alike >= threshold:
        yield a, b, c, d, alike
    else:
        k = max(range(1, len(runs)), key=lambda k: max(runs[k][0] - runs[k - 1][0] - runs[k - 1][2], runs[k][1] - runs[k - 1][1] - runs[k - 1][2]))
        yield from _verified(x, y, runs[:k], least, threshold)
        yield from _verified(x, y, runs[k:], least, threshold)


def passages(x: np.ndarray, to: np.ndarray | Target, same: bool, words_: int = WORDS, threshold: float = 0.8) -> list[tuple[int, int, int, int, float]]:
    """Near-duplicate passages of two texts' shingles: (start and end word in x, in y, similarity).

    Of those that overlap in x, as few are given as cover every place.  same: x is y, and its later passages are held against
    its earlier ones, which they do not overlap.  Where two texts share more than MANY runs, of those
    that are passages by themselves as few count as cover their places, those within them do not count, and those
    shorter than LONG only near a longer one.
    """
    least, y = words_ - SHINGLE + 1, to.own if isinstance(to, Target) else to
    if min(len(x), len(y)) < least:
        return []
    if not same and np.array_equal(x, y):
        return [(0, len(x) + SHINGLE - 1, 0, len(y) + SHINGLE - 1, 1.0)]
    long = min(LONG, least)
    runs = _runs(x, to if isinstance(to, Target) else target(y), words_ if same else 0)
    if not len(runs) or runs[:, 2].max() < long:
        return []
    if len(runs) > MANY:
        runs = _near_long(_outer(runs, least), long)
    if len(runs) == 1 and not same and runs[0, 2] < least:
        return []
    if same:
        runs = _pieces(runs)
    found = {p for ch in _chains(runs, same, threshold) for p in _verified(x, y, ch, least, threshold)}
    return [(a, b + SHINGLE - 1, c, d + SHINGLE - 1, s) for a, b, c, d, s in _cover(sorted(found, key=lambda p: (p[0], -p[1], -p[4], p[2])))]


def _cover(found: list[tuple]) -> Iterator[tuple]:
    """Of rows (start, end, ...) in order of start, as few as cover every place that any of them covers."""
    end, k = -1, 0
    while k < len(found):
        reach, best = max(end, found[k][0]), None
        while k < len(found) and found[k][0] <= reach:
            if found[k][1] > (best[1] if best else end):
                best = found[k]
            k += 1
        if best:
            yield best
            end = best[1]


def _matched(words_: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept = None, []
        for batch in batches:
            out = []
            data, at = flat(batch.column(4))
            for i, j in slices(np.diff(at), TEXT_BYTES):
                own, own_at = shingles(words(data[at[i] : at[j]], at[i : j + 1] - at[i]))
                part = batch.slice(i, j - i)
                for k, (b, p, role, a) in enumerate(zip(*(part.column(c).to_pylist() for c in range(4)), strict=True)):
                    x = own[own_at[k] : own_at[k + 1]].copy()
                    if role == 0:
                        kept = [*kept, target(x)] if held == (b, p) else [target(x)]
                        held = (b, p)
                    else:
                        found = [f for y in (kept if held == (b, p) else []) for f in passages(x, y, a == b, words_, threshold)]
                        crc = zlib.crc32(data[at[i + k] : at[i + k + 1]]) if found else 0
                        out += [(a, s, e, b, c, d, alike, crc) for s, e, c, d, alike in found]
            columns = list(zip(*out, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 6 else pa.int64()) for k, c in enumerate(columns)], ["a", "start_word", "end_word", "match_id", "match_start", "match_end", "similarity", "text_crc"])

    return run


def repeated_passages(docs: DataFrame, words_: int = WORDS, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages that repeat one of an earlier document, or an earlier one of their own text.

    One row per passage of at least `words_` words whose five-word shingles have a Jaccard similarity of
    `threshold` or more to a passage of the document match_id: id_col, start_word, end_word (exclusive),
    match_id, match_start, match_end, similarity, text_crc (crc32 of the text).  Earlier means a smaller id; a passage's first holder has
    no row for it.  Passages of one text may overlap where it repeats several documents.

    Null or shorter texts have none.  Rows with a null id take no part.  Ids should be unique: rows of one
    id count as one document's texts.
    """
    least = words_ - SHINGLE + 1
    common = COMMON if least > SIDES else 0
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = texts.mapInArrow(lean(_signatures(least)), "v long, doc long, near long, again boolean")
    group = Window.partitionBy("v")  # one pass over the texts: their signatures are worked out and moved once
    sized = rows.withColumn("b", F.min("doc").over(group)).withColumn("holders", F.sum(F.when(F.col("again"), 2).otherwise(1)).over(group))
    shared = rewrite(sized.where("holders > 1"))
    release(docs.sparkSession)
    own = shared.where("doc <> b").select("v", F.col("doc").alias("a"), "near", "b", "holders")
    held = shared.where("doc = b").select("v", "b", F.col("near").alias("other"))
    star = own.join(held, ["v", "b"]).select("a", "b", "near", "other")
    few = own.where(F.col("holders") <= SMALL).select("v", "a", "near")
    few = few.join(few.select("v", F.col("a").alias("b"), F.col("near").alias("other")), "v").where("a > b").select("a", "b", "near", "other")
    alike = rewrite(star.union(few).groupBy("a", "b").agg(F.count("*").alias("agree"), F.max(_agreeing("near", "other")).alias("alike")).where((F.col("agree") > 1) | (F.col("alike") >= common)))

    release(docs.sparkSession)
    many = own.where(F.col("holders") > SMALL).select("v", "a", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), _codes("near", k, 2).alias("code")) for k in range(0, 2 * SIDES, 2)))).alias("at"))
    keyed = many.where("at.code > 255 and at.code % 256 > 0").select(F.xxhash64("v", "at").alias("key"), "a")
    leaders = keyed.groupBy("key").agg(F.min("a").alias("b"), F.max("a").alias("top")).where("b < top").select("key", "b")
    near = keyed.join(leaders, "key").where("a <> b").select("a", "b")
    met = alike.select("a", "b").union(near).union(shared.where("again").select(F.col("doc").alias("a"), F.col("doc").alias("b")))
    found = meet(met.distinct(), texts).mapInArrow(
        lean(_matched(words_, threshold)), "a long, start_word long, end_word long, match_id long, match_start long, match_end long, similarity double, text_crc long"
    )
    return found.distinct().withColumnRenamed("a", id_col)


def _codes(near: str, k: int, n: int = 1) -> F.Column:
    """n of the bytes of a signature's surroundings, from the k-th on."""
    return F.shiftrightunsigned(near, 8 * k).bitwiseAND(F.lit((1 << 8 * n) - 1))


def _agreeing(near: str, other: str) -> F.Column:
    """How many stretches about a signature have the same code in both texts."""
    return sum(((_codes(near, k) == _codes(other, k)) & (_codes(near, k) != 0)).cast("int") for k in range(2 * SIDES))


def remove_repeats(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the words of the passages found (id_col, text_crc, start_word, end_word).

    A passage is cut from the rows that have its id and its very text.  White space before a removed passage stays, that after it goes.  Texts without passages are untouched;
    a text may become empty.  Rows without an id stay as they are.
    """
    name = "cuts"
    while {name, f"{name}_key", f"{name}_few"} & set(docs.columns):
        name += "_"
    key, known = f"{name}_key", f"{name}_few"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_text = batch.schema.get_field_index(text_col)
            texts = batch.column(at_text).to_pylist()
            for k, cuts in enumerate(batch.column(batch.schema.get_field_index(name)).to_pylist()):
                if cuts is None:
                    continue
                code = (texts[k] or "").encode()
                w = words(np.frombuffer(code, np.uint8), np.array([0, len(code)]))
                gone = np.zeros(len(w.start) + 1, bool)
                for cut in cuts:
                    gone[cut["start_word"] : cut["end_word"]] = True
                bounds = [*w.start.tolist(), len(code)]
                out = [code[: bounds[0]]] + [code[bounds[n] : bounds[n + 1]] for n in range(len(w.start)) if not gone[n]]
                texts[k] = b"".join(out).decode()
            columns = [pa.array(texts, pa.string()) if n == at_text else c for n, c in enumerate(batch.columns)]
            keep = [n for n, column in enumerate(batch.schema.names) if column != name]
            yield pa.RecordBatch.from_arrays([columns[n] for n in keep], [batch.schema.names[n] for n in keep])

    cuts = rewrite(found.groupBy(F.col(id_col).alias("id"), "text_crc").agg(F.collect_set(F.struct("start_word", "end_word")).alias("places")).select("id", F.col("text_crc").alias("crc"), F.col("places").alias("cut")))
    release(docs.sparkSession)
    few = F.pmod(F.xxhash64("id"), F.lit(COARSE))  # texts without cuts stay where they are, but for a few
    maybe = F.broadcast(cuts.select(few.alias(known)).distinct())
    own = docs.withColumn(key, F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(COARSE)))
    stay = own.join(maybe, F.col(key) == F.col(known), "left_anti").select(*docs.columns)
    near = own.join(maybe, F.col(key) == F.col(known), "left_semi").alias("d")
    met = near.join(cuts.alias("c"), (F.col(f"d.{id_col}") == F.col("c.id")) & (F.crc32(f"d.{text_col}") == F.col("c.crc")), "left")
    joined = met.select(*(F.col(f"d.{c}") for c in docs.columns), F.col("c.cut").alias(name))
    return stay.union(joined.mapInArrow(lean(run), docs.schema))


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


QUERIES = {"op2_repeated_passages": op2_repeated_passages}
SQL: dict[str, str] = {}
