"""Benchmark decontamination by SimHash windows.

Every item is cut into windows of a size class fit for its length, at every place; documents are cut
into windows of the same sizes at a stride short enough that a copied item holds whole document windows.
Windows are compared as 64-bit SimHash fingerprints of their word shingles.  A multi-index finds all
item fingerprints within RADIUS bits: of four 16-bit blocks at least one differs in at most one bit, and
the index lists each item window under all such values.  An item that reaches the threshold in spite of
words changed, added or removed in its middle has an unbroken part: windows of a small size find it by
equal fingerprints.  Candidates are decided by the weighted Jaccard
similarity of shingle counts over the aligned stretch of the document.

One pass over the documents and no shuffle; items travel to the tasks in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import table
from gleaner.llm.words import SHINGLE, flat, mix, shingles, slices, words

#: Window sizes in shingles, each with the documents' stride.
SIZES = ((1, 1), (2, 1), (4, 1), (6, 2), (9, 3), (14, 4), (21, 6), (32, 8), (48, 12), (72, 18), (108, 27), (162, 40), (243, 60))
RADIUS = 7
#: Window size and stride for unbroken parts: with m breaks similarity 0.8 needs 40 m shingles, which leaves one part of
#: 17 or more; items of fewer than 40 shingles have no break inside.
PART = (14, 4)
#: Bytes of item texts that go to the tasks at once.
BLOCK_BYTES = 4 << 20
#: Bytes of documents gone through at once, and places fingerprinted at once: bits take a few hundred bytes a place.
PART_BYTES, PLACES = 256 << 10, 1 << 16


class Index(NamedTuple):
    """Item windows of one size: fingerprint, item, place; and by block, the windows listed under each value."""

    size: int
    stride: int
    prints: np.ndarray
    item: np.ndarray
    place: np.ndarray
    first: list[np.ndarray]
    listed: list[np.ndarray]


class Items(NamedTuple):
    ids: list[int]
    grams: list[np.ndarray]
    weights: list[dict[int, int]]
    indexes: list[Index]
    parts: tuple[np.ndarray, np.ndarray, np.ndarray]  # fingerprints of PART windows in order, item, place


def size_class(n: int) -> tuple[int, int]:
    """Largest size of which a copy of n shingles holds some document window with a fifth to spare."""
    fit = [(w, s) for w, s in SIZES if w + s - 1 <= max(1, int(n * 0.8))]
    return fit[-1]


def bits_before(hashes: np.ndarray) -> np.ndarray:
    """By place, how many of the hashes before it have each bit set."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    out = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=out[1:])
    return out


def prints(before: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of `size` shingles at the given places; a bit is set if most hashes have it."""
    most = 2 * (before[starts + size] - before[starts]) > size
    return np.packbits(most, axis=1).view(np.uint64).ravel()


def prepare(rows: list[tuple[int, str | None]]) -> Items:
    """Index of items (id, text); items without words are never found."""
    ids, grams = [], []
    for i, text in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        own, _ = shingles(words(data, np.array([0, len(data)])))
        if len(own) and i is not None:
            ids.append(i)
            grams.append(own)
    found: dict[tuple[int, int], list[int]] = {}
    for k, own in enumerate(grams):
        found.setdefault(size_class(len(own)), []).append(k)
    indexes = []
    for (size, stride), of in sorted(found.items()):
        fps = [prints(bits_before(mix(grams[k])), np.arange(len(grams[k]) - size + 1), size) for k in of]
        every = np.concatenate(fps)
        item = np.repeat(np.array(of), [len(f) for f in fps])
        place = np.concatenate([np.arange(len(f)) for f in fps])
        first, listed = [], []
        flips = np.concatenate([[0], 1 << np.arange(16)])
        for b in range(4):
            keys = (((every >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)[:, None] ^ flips[None, :]).ravel()
            order = np.argsort(keys, kind="stable")
            first.append(np.searchsorted(keys[order], np.arange((1 << 16) + 1)).astype(np.int32))
            listed.append((order // len(flips)).astype(np.int32))
        indexes.append(Index(size, stride, every, item, place, first, listed))
    weights = [dict(zip(*(x.tolist() for x in np.unique(g, return_counts=True)), strict=True)) for g in grams]
    of = [k for k, own in enumerate(grams) if len(own) >= PART[0] + PART[1] - 1]
    fps = [prints(bits_before(mix(grams[k])), np.arange(len(grams[k]) - PART[0] + 1), PART[0]) for k in of]
    every = np.concatenate([np.zeros(0, np.uint64), *fps])
    order = np.argsort(every, kind="stable")
    item = np.repeat(np.array(of, np.int64), [len(f) for f in fps])
    place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(f)) for f in fps)])
    return Items(ids, grams, weights, indexes, (every[order], item[order], place[order]))


def lookup(index: Index, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (position in fps, item window) within RADIUS bits."""
    left, right = [], []
    for b in range(4):
        key = ((fps >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
        n = index.first[b][key + 1] - index.first[b][key]
        some = np.flatnonzero(n)
        if not len(some):
            continue
        n = n[some]
        at = np.repeat(some, n)
        step = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        window = index.listed[b][index.first[b][key[at]] + step]
        near = np.bitwise_count(fps[at] ^ index.prints[window]) <= RADIUS
        left.append(at[near])
        right.append(window[near])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pair = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
    return pair[:, 0], pair[:, 1]


def equal_parts(items: Items, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (position in fps, item window of PART) with equal fingerprints."""
    low, high = (np.searchsorted(items.parts[0], fps, side) for side in ("left", "right"))
    n = high - low
    hit = np.repeat(np.arange(len(fps)), n)
    return hit, np.arange(len(hit)) - np.repeat(np.cumsum(n) - n - low, n)


def similarity(grams: list[int], weight: dict[int, int]) -> float:
    """Weighted Jaccard: shared counts over the greater counts."""
    own: dict[int, int] = {}
    for g in grams:
        own[g] = own.get(g, 0) + 1
    both = sum(min(n, weight.get(g, 0)) for g, n in own.items())
    return both / (len(grams) + sum(weight.values()) - both)


def best_match(own: np.ndarray, start: int, item: np.ndarray, weight: dict[int, int]) -> tuple[float, int, int]:
    """Similarity, place and length of the stretch of `own` about `start` that matches the item best: the
    aligned one of the item's length, or the one from the first to the last shared shingle near it."""
    m, slack = len(item), len(item) // 4 + 1
    low, high = max(0, start - slack), min(len(own), start + m + slack)
    near = own[low:high].tolist()
    shared = [k for k, g in enumerate(near) if g in weight]
    if not shared:
        return 0.0, start, 0
    a = min(max(0, start - low), len(near))
    options = {(a, min(len(near), a + m)), (shared[0], shared[-1] + 1)}
    return max((similarity(near[i:j], weight), -(low + i), j - i) for i, j in options if j > i)


def find(items: Items, data: np.ndarray, at: np.ndarray, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(row, item, similarity, first word, words) of each row's best match of each item found in it."""
    w = words(data, at)
    own, own_at = shingles(w)
    if not len(own):
        return []
    row = np.repeat(np.arange(len(at) - 1), np.diff(own_at))
    longest, tries = max([PART[0], *(index.size for index in items.indexes)]), set()
    for c in range(0, len(own), PLACES):
        before = bits_before(mix(own[c : c + PLACES + longest]))
        for index in (*items.indexes, None):
            size, stride = (index.size, index.stride) if index else PART
            starts = np.arange(-(-c // stride) * stride, min(c + PLACES, len(own) - size + 1), stride)
            starts = starts[row[starts] == row[starts + size - 1]]
            if not len(starts):
                continue
            fps = prints(before, starts - c, size)
            hit, window = lookup(index, fps) if index else equal_parts(items, fps)
            item, place_of = (index.item, index.place) if index else items.parts[1:]
            begin = starts[hit] - place_of[window]
            tries |= {(int(r), int(i), int(b)) for r, i, b in zip(row[starts[hit]], item[window], begin, strict=True)}
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for r, i, b in sorted(tries):
        mine = own[own_at[r] : own_at[r + 1]]
        s, place, n = best_match(mine, b - int(own_at[r]), items.grams[i], items.weights[i])
        if s >= threshold and (s, place, n) > best.get((r, i), (0.0, 0, 0)):
            best[r, i] = (s, place, n)
    words_of = np.diff(w.at)
    return [(r, i, s, -place, min(int(n + SHINGLE - 1), int(words_of[r]))) for (r, i), (s, place, n) in sorted(best.items())]


def _blocks(benchmark: DataFrame, item_id: str, item_text: str) -> Iterator[Broadcast]:
    """The items, prepared in blocks of about BLOCK_BYTES that go to the tasks one after the other."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    for b in range(blocks):
        block = [(r["item"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()]
        yield benchmark.sparkSession.sparkContext.broadcast(prepare(block))


def contaminations(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Benchmark items found in documents: id_col, item_id, similarity, start_word, n_words.

    One row per document row and item whose best stretch of the document reaches `threshold` in weighted
    Jaccard similarity of five-word shingles (the earliest on ties).  A text or item of fewer than five
    words has its whole word sequence as its one shingle.  Null or wordless texts and items, and items with
    a null id, match nothing; repeated rows each give their rows.  Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = None
    for shared in _blocks(benchmark, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                data, at = flat(batch.column(1))
                for i, j in slices(np.diff(at), PART_BYTES):
                    out = find(own, data[at[i] : at[j]], at[i : j + 1] - at[i], threshold)
                    ids = batch.column(0).take(pa.array([i + r for r, *_ in out], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([own.ids[k] for _, k, *_ in out], pa.int64()), pa.array([s for _, _, s, *_ in out], pa.float64()), pa.array([p for *_, p, _ in out], pa.int64()), pa.array([n for *_, n in out], pa.int64())],
                        ["id", "item_id", "similarity", "start_word", "n_words"],
                    )

        part = rows.mapInArrow(run, "id long, item_id long, similarity double, start_word long, n_words long")
        found = part if found is None else found.union(part)
    return found.withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text holds no benchmark item, by the rule of contaminations().

    Each row is judged by itself, whatever its id; nothing is shuffled.
    """
    for shared in _blocks(benchmark, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, at = flat(batch.column(batch.schema.get_field_index(text_col)))
                for i, j in slices(np.diff(at), PART_BYTES):
                    clean = np.ones(j - i, bool)
                    clean[[r for r, *_ in find(shared.value, data[at[i] : at[j]], at[i : j + 1] - at[i], threshold)]] = False
                    yield batch.slice(i, j - i).filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontaminate": op3_decontaminate}
SQL: dict[str, str] = {}
