"""Language identification by prediction by partial matching.

Each language has a byte context tree of orders 0 to `ORDER` with counts from its training texts.  A
text's code length under a language is exact PPM (method C, frozen counts): a byte is coded in the
longest context that the tree holds, and each context that has not seen the byte costs its escape.
The language of least code length is the prediction.

The trees of all languages are kept as one table of (context, byte) nodes with a probability per
language, already including the escapes on the way down, so that scoring is array look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import digest, lean, table
from gleaner.llm.words import SLICE_BYTES, flat, slices

#: Longest context in bytes.
ORDER = 3
#: Training texts per language at most, whole: those least by hash of their id.
DOCS_PER_LANG = 400
#: Bytes of texts judged at once; a few arrays of a number a byte and language stand beside them.
PART_BYTES = 512 << 10
#: Longer texts' code lengths are scaled to this many bytes for the score, so that it says more than 0 or 1.
CONFIDENT_BYTES = 40


class Tree(NamedTuple):
    """Nodes of one order: sorted keys of context and byte, log2 probability by language, and for each
    context (sorted keys) log2 of its escape by language (0 where the language lacks the context)."""

    keys: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escapes: np.ndarray


class Model(NamedTuple):
    languages: list[str]
    base: np.ndarray
    trees: list[Tree]


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """Context and byte of each place from `order` on, packed into one number."""
    n = len(data) - order
    out = np.zeros(max(n, 0), np.uint32)
    for k in range(order + 1):
        out = (out << np.uint32(8)) | data[k : k + n].astype(np.uint32)
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (language, order, context and byte), text by text."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        data, at = flat(batch.column(1))
        for k, lang in enumerate(langs):
            for start, order in product(range(at[k], at[k + 1], SLICE_BYTES), range(ORDER + 1)):
                keys, n = np.unique(_grams(data[max(at[k], start - order) : min(at[k + 1], start + SLICE_BYTES)], order), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), order, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "ord", "gram", "n"])


def _model(rows: list) -> Model:
    """Frozen statistics from counts (lang, ord, gram, n)."""
    langs = sorted({r[0] for r in rows})
    own = {lang: k for k, lang in enumerate(langs)}
    code, order, gram, n = (np.array([f(r) for r in rows], np.int64) for f in (lambda r: own[r[0]], lambda r: r[1], lambda r: r[2], lambda r: r[3]))
    trees: list[Tree] = []
    below, base = None, np.full((256, len(langs)), -8.0, np.float32)
    for k in range(ORDER + 1):
        at = order == k
        keys = np.unique(gram[at]).astype(np.uint32)
        counts = np.zeros((len(keys), len(langs)))
        counts[np.searchsorted(keys, gram[at]), code[at]] = n[at]
        contexts, place = np.unique(keys >> np.uint32(8), return_inverse=True)
        total, kinds = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
        np.add.at(total, place, counts)
        np.add.at(kinds, place, counts > 0)
        with np.errstate(divide="ignore"):
            escapes = np.where(total > 0, np.log2(kinds / np.maximum(total + kinds, 1)), 0.0)
            seen = np.log2(counts / np.maximum(total + kinds, 1)[place])
        lower = base[keys & np.uint32(0xFF)] if k == 0 else below[np.searchsorted(trees[-1].keys, keys & np.uint32((1 << 8 * k) - 1))]
        below = np.where(counts > 0, seen, escapes[place] + lower).astype(np.float32)
        trees.append(Tree(keys, below, contexts, escapes.astype(np.float32)))
    return Model(langs, base, trees)


class Slots:
    """Positions of keys in a sorted array by open addressing; len(keys) where absent."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.none = len(keys)
        self.slot = np.full(1 << self.bits, self.none, np.int32)
        self.key = np.zeros(1 << self.bits, np.uint32)
        rest, home = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(rest):
            free = self.slot[home] == self.none
            self.slot[home[free]] = rest[free]  # of equal homes the last stays
            placed = self.slot[home] == rest
            self.key[home[placed]] = keys[rest[placed]]
            rest, home = rest[~placed], (home[~placed] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        home = self._home(keys)
        out = self.slot[home]
        wrong = np.flatnonzero((out != self.none) & (self.key[home] != keys))
        while len(wrong):
            home[wrong] = (home[wrong] + 1) & ((1 << self.bits) - 1)
            out[wrong] = self.slot[home[wrong]]
            wrong = wrong[(out[wrong] != self.none) & (self.key[home[wrong]] != keys[wrong])]
        return out


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.nodes = [Slots(t.keys) for t in model.trees]
        self.contexts = [Slots(t.contexts) for t in model.trees]
        self.bits = [np.vstack([t.bits, np.zeros((1, t.bits.shape[1]), np.float32)]) for t in model.trees]
        self.escapes = [np.vstack([t.escapes, np.zeros((1, t.escapes.shape[1]), np.float32)]) for t in model.trees]

    def lengths(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code length in bits of each row data[at[i]:at[i + 1]] under each language."""
        n, langs = len(data), len(self.model.languages)
        if not n:
            return np.zeros((len(at) - 1, langs))
        start = np.repeat(at[:-1], np.diff(at))
        room = np.minimum(np.arange(n) - start, ORDER)
        value = np.empty((n, langs), np.float32)
        rest = np.arange(n)
        packed = np.zeros(n, np.uint32)
        for k in range(ORDER, -1, -1):
            packed[k:] |= data[: n - k].astype(np.uint32) << np.uint32(8 * k)
        cost = np.zeros((n, langs), np.float32)
        for k in range(ORDER, -1, -1):
            mine = rest[room[rest] >= k]
            late = rest[room[rest] < k]
            key = packed[mine] & np.uint32((1 << 8 * (k + 1)) - 1 & 0xFFFFFFFF)
            slot = self.nodes[k].find(key)
            hit = slot != self.nodes[k].none
            value[mine[hit]] = cost[mine[hit]] + self.bits[k][slot[hit]]
            miss = mine[~hit]
            cost[miss] += self.escapes[k][self.contexts[k].find(key[~hit] >> np.uint32(8))]
            rest = np.concatenate([miss, late])
        value[rest] = cost[rest] + self.model.base[data[rest]]
        some = np.flatnonzero(np.diff(at))
        out = np.zeros((len(at) - 1, langs))
        for j in range(langs):
            out[some, j] = -np.add.reduceat(value[:, j].astype(np.float64), at[some])
        return out


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_lang: int = DOCS_PER_LANG) -> Model:
    """Statistics from at most `per_lang` texts of each language, those least by hash of their id."""
    rows = labelled.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).alias("lang"), F.xxhash64(id_col, F.lit(8)).alias("h"), F.col(text_col).alias("text"))
    kept = rows.groupBy("lang").agg(F.count("*").alias("n"))
    # hashes are uniform over the longs: a cut at 2 * per_lang / n of their range keeps about twice the texts asked for
    cut = F.least(F.lit(1.0), F.lit(2.0 * per_lang) / F.col("n")) * 2.0 - 1.0
    few = rows.join(F.broadcast(kept), "lang").where(F.col("h") / F.lit(2.0**63) <= cut)
    best = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("k") <= per_lang)
    counted = best.select("lang", "text").mapInArrow(_counts, "lang string, ord int, gram long, n long")
    return _model([tuple(r) for r in counted.groupBy("lang", "ord", "gram").agg(F.sum("n")).collect()])


class _Judge:
    """Predictions for the texts of a column: (language or und, score, bits per byte) arrays."""

    def __init__(self, model: Model) -> None:
        import regex

        self.scorer, self.letter = Scorer(model), regex.compile(r"\p{L}").search
        self.names = np.array([*model.languages, "und"], object)

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        data, at = flat(texts)
        for i, j in slices(np.diff(at), PART_BYTES):
            size = np.diff(at[i : j + 1])
            letters = np.array([bool(t) and self.letter(t) is not None for t in texts.slice(i, j - i).to_pylist()], bool)
            bits = self.scorer.lengths(data[at[i] : at[j]], at[i : j + 1] - at[i])
            some = bits.shape[1] > 0
            best = bits.argmin(1) if some else np.zeros(j - i, int)
            least = bits.min(1, initial=np.inf)
            part = np.minimum(1.0, CONFIDENT_BYTES / np.maximum(size, 1))
            odds = np.exp2(-(bits - least[:, None]) * part[:, None]).sum(1)
            ok = letters & some
            yield i, j, self.names[np.where(ok, best, len(self.names) - 1)], np.where(ok, 1 / np.maximum(odds, 1), 0.0), np.where(ok, least / np.maximum(size, 1), 0.0)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of each text: id_col, lang_pred, score, bits_per_byte.

    lang_pred is a language of the model, or `und` with score 0 if the text is null or has no letter;
    ties go to the language first in order.  score is the posterior of the predicted language with the
    code lengths of texts over CONFIDENT_BYTES bytes scaled to that many.  One row per row of docs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(shared.value)
        for batch in batches:
            for i, j, lang, score, bits in judge(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(lang, pa.string()), pa.array(score), pa.array(bits)], ["id", "lang_pred", "score", "bits_per_byte"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "id long, lang_pred string, score double, bits_per_byte double").withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, model: Model, bits_a_byte: float = 8.0, bits_beside: float = 64.0, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text its likeliest language codes in at most `bits_a_byte` bits a byte
    and `bits_beside` more, so that a name or number in a short text does not decide.

    Null texts and those without a letter have no language and go, as all do if the model knows none.  Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for i, j, lang, _, bits in judge(texts):
                size = np.diff(flat(texts.slice(i, j - i))[1])
                yield batch.slice(i, j - i).filter(pa.array((lang != "und") & (bits * size <= bits_a_byte * size + bits_beside)))

    return docs.mapInArrow(lean(run), docs.schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(digest("doc_id") % 4 != 2))
    found = identify(docs, model)
    return found.select("doc_id", (digest("doc_id") % 4 == 2).alias("held_out"), "lang_pred", "score", "bits_per_byte")


QUERIES = {"op8_language_id": op8_language_id}
SQL: dict[str, str] = {}
