"""Token counts by overlap resynchronisation.

Texts up to `HUGE` characters are counted whole.  A longer one is cut into overlapping chunks that are
counted in parallel, each noting where the tokenizer's pre-tokens end inside its overlaps.  Pre-tokens
depend only on the text from their own start on, so a place where both neighbours end a pre-token, and
which lies clear of the earlier chunk's cut, is a boundary of the whole text's encoding too: there the
counts are spliced.  Where neighbours share no such place, chunks and overlaps grow eightfold until they do.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import settle, table
from gleaner.llm.words import slices

HUGE = 32_768
CHUNK, OVERLAP = 16_384, 512
#: Characters before a chunk's end within which the cut may have changed a pre-token; it covers the
#: longest contraction and the special string, and a longer run of one kind ends at the cut itself.
MARGIN = 32
#: Pieces whose token count a worker keeps.
KEPT = 400_000


class Counter(dict):
    """Token counts of pre-tokens, and of texts by the library at `path`; bounded.

    Pre-tokens of common characters are found by the split pattern and counted by the library once
    each; any text with other characters or with a special string goes to the library whole.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.find = regex.compile(pattern).findall
        special = "|".join(regex.escape(t.content) for t in self.library.get_added_tokens_decoder().values())
        self.other = regex.compile(r"[^\t\n\r -~¡-ɏ]" + f"|{special}" * bool(special)).search

    def pieces(self, text: str) -> list[str] | None:
        """The text's pre-tokens, all of them counted; None if the library must take it whole."""
        if self.other(text):
            return None
        found = self.find(text)
        new = [p for p in set(found) if p not in self]
        if new:
            if len(self) + len(new) > KEPT:
                self.clear()
                new = list(set(found))
            self.update(zip(new, (len(e.ids) for e in self.library.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        return found

    def count(self, text: str) -> int:
        found = self.pieces(text)
        if found is None:
            return len(self.library.encode(text, add_special_tokens=False).ids)
        return sum(map(self.__getitem__, found))

    def ends(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Positions where pre-tokens end, from 0 on, and the number of tokens before each."""
        found = self.pieces(text)
        if found is not None:
            at = np.cumsum([0, *map(len, found)])
            return at, np.cumsum([0, *map(self.__getitem__, found)])
        code = self.library.encode(text, add_special_tokens=False)
        ids, spans = code.word_ids, code.offsets
        cut = [k for k in range(1, len(ids)) if ids[k] != ids[k - 1] and spans[k][0] == spans[k - 1][1]]
        return np.array([0, *(spans[k][0] for k in cut), len(text)]), np.array([0, *cut, len(ids)])


@cache
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


def _whole(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([own.count(t.as_py() or "") for t in batch.column(2)], pa.int64())], ["id", "n_bytes", "n_tokens"])

    return run


def _chunks(size: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                whole = text.as_py()
                starts = range(0, max(1, len(whole) - overlap), size)
                for i, j in slices(np.full(len(starts), size + overlap)):
                    part = starts[i:j]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key.as_py()] * len(part)), pa.array(range(i, j), pa.int32()), pa.array([s + size >= len(whole) - overlap for s in part]), pa.array([whole[s : s + size + overlap] for s in part])],
                        ["key", "no", "last", "text"],
                    )

    return run


def _ends(path: str, pattern: str, size: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, pattern)
        for batch in batches:
            heads, head_n, tails, tail_n, totals = [], [], [], [], []
            for last, text in zip(batch.column(2), batch.column(3), strict=True):
                at, n = own.ends(text.as_py())
                head = at <= overlap - MARGIN
                tail = (at >= size) & (at <= size + overlap - MARGIN) & (not last.as_py())
                heads.append(at[head])
                head_n.append(n[head])
                tails.append(at[tail] - size)
                tail_n.append(n[tail])
                totals.append(int(n[-1]))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (heads, head_n, tails, tail_n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists, pa.array(totals, pa.int64())], ["key", "no", "last", "head", "head_n", "tail", "tail_n", "total"])

    return run


def _spliced(texts: DataFrame, path: str, pattern: str, size: int, overlap: int) -> DataFrame:
    """Token count of each (key, text); null where two neighbours share no stable boundary."""
    chunks = texts.mapInArrow(_chunks(size, overlap), "key long, no int, last boolean, text string").repartition("key", "no")
    ends = chunks.mapInArrow(
        _ends(path, pattern, size, overlap), "key long, no int, last boolean, head array<long>, head_n array<long>, tail array<long>, tail_n array<long>, total long"
    )
    ends = settle(ends)
    following = ends.where("no > 0").select("key", (F.col("no") - 1).alias("no"), F.col("head").alias("next_head"), F.col("head_n").alias("next_n"))
    seam = ends.join(following, ["key", "no"], "left").withColumn("cut", F.get(F.array_intersect("tail", "next_head"), F.lit(0)))
    left = F.when(F.col("last"), F.col("total")).otherwise(F.element_at("tail_n", F.array_position("tail", F.col("cut")).cast("int")))
    skipped = F.when(F.col("last"), 0).otherwise(F.element_at("next_n", F.array_position("next_head", F.col("cut")).cast("int")))
    part = seam.select("key", F.when(F.col("last") | F.col("cut").isNotNull(), left - skipped).alias("n"))
    return part.groupBy("key").agg(F.when(F.count("n") == F.count("*"), F.sum("n")).alias("n_tokens"))


def token_counts(docs: DataFrame, path: str | None = None, pattern: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Exact token counts: id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty.  Every row gives a row, repeated ids too; equal huge texts are counted once.
    """
    import public_tokenizers

    path, pattern = path or public_tokenizers.path("byte_bpe_50k.json"), pattern or public_tokenizers.PATTERN
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    short = rows.where(F.length("text") <= huge).mapInArrow(_whole(path, pattern), "id long, n_bytes long, n_tokens long")
    long = rows.where(F.length("text") > huge).withColumn("key", F.xxhash64("text", "n_bytes"))
    texts = long.groupBy("key").agg(F.first("text").alias("text"))
    counted, pending = None, texts
    while True:
        counts = settle(_spliced(pending, path, pattern, chunk, overlap))
        done = counts.where("n_tokens is not null")
        counted = done if counted is None else counted.union(done)
        failed = counts.where("n_tokens is null").select("key")
        if not failed.take(1):
            break
        pending, chunk, overlap = texts.join(failed, "key", "left_semi"), chunk * 8, overlap * 8
    every = short.union(long.select("id", "n_bytes", "key").join(counted, "key").select("id", "n_bytes", "n_tokens"))
    return every.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op10_token_counts": op10_token_counts}
SQL: dict[str, str] = {}
