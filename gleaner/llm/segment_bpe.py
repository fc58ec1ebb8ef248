"""BPE encoding and decoding over a segment tree.

The leaves of the tree hold the ranks of a piece's adjacent pairs, each with its place in the low bits, and an
inner node the smaller of its two children: the root is the leftmost pair of the lowest rank.  Merging it
changes three leaves at most, each a walk of logarithmic length towards the root, until no pair can merge; a
piece of n bytes takes O(n log n) whatever its content.  Symbols are linked both ways by arrays of places.

Vocabulary, merges and added tokens come from a tokenizer file in JSON.  Added tokens that stand in a text
are found first and cut it; the split pattern works on what lies between them.
"""

from __future__ import annotations

import gc
import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.bpe import LONG, MEMO, PIECE_BYTES, RUN, Utf8Stream
from gleaner.llm.common import table

#: Stands for "no pair to merge"; every rank and place is less.
NONE = (1 << 63) - 1
#: Bytes of a piece beyond which its tree is packed, at eight bytes a node.
PACKED = 1 << 12


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: bytes that print stand for
    themselves, the others for code points from 256 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class SegmentMerges:
    """Merges by a segment tree: `tokens` maps an id to its bytes; encode() gives the ids of one piece."""

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        letters = byte_letters()
        of = {c: b for b, c in enumerate(letters)}
        self.tokens = {i: bytes(map(of.__getitem__, t)) for t, i in vocab.items()}
        self.first = [vocab[c] for c in letters]
        self.width = max(vocab.values(), default=0).bit_length()
        self.pairs: dict[int, int] = {}
        self.made: list[int] = []
        for merge in merges:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault(vocab[left] << self.width | vocab[right], len(self.made))
            self.made.append(vocab[left + right])

    def encode(self, piece: bytes) -> list[int]:
        n, rank, made, width = len(piece), self.pairs.get, self.made, self.width
        ids = list(map(self.first.__getitem__, piece))
        if n < 2:
            return ids
        bits = (n - 2).bit_length()
        size, low = 1 << bits, (1 << bits) - 1
        tree = [NONE] * (2 * size) if n <= PACKED else array("q", [NONE]) * (2 * size)
        after, before = range(1, n + 1), range(-1, n - 1)
        after, before = (list(after), list(before)) if n <= PACKED else (array("q", after), array("q", before))
        for i in range(n - 1):
            if (r := rank(ids[i] << width | ids[i + 1])) is not None:
                tree[size + i] = r << bits | i
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            while k > 1:
                k >>= 1
                value = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == value:
                    return
                tree[k] = value

        def leaf(i: int, j: int) -> int:
            r = rank(ids[i] << width | ids[j])
            return NONE if r is None else r << bits | i

        while (root := tree[1]) != NONE:
            i = root & low
            gone, h = after[i], before[i]
            ids[i], ids[gone] = made[root >> bits], -1
            after[i] = then = after[gone]
            if then < n:
                before[then] = i
                put(gone, NONE)
                put(i, leaf(i, then))
            else:
                put(i, NONE)
            if h >= 0:
                put(h, leaf(h, i))
        return [t for t in ids if t >= 0]


class Encoder(dict):
    """Pieces of text, each mapped to its packed ids, by a tokenizer file; bounded by bytes in two generations."""

    def __init__(self, path: str, pattern: str, memo: int = MEMO) -> None:
        import regex

        super().__init__()
        with open(path, encoding="utf-8") as lines:
            said = json.load(lines)
        split, added = said.get("pre_tokenizer") or {}, said.get("added_tokens") or []
        if said["model"]["type"] != "BPE" or said.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or any(t[k] for t in added for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path}: only byte-level BPE without a normalizer, prefix spaces and stripping added tokens")
        self.memo, self.taken, self.older = memo, 0, {}
        self.merges = SegmentMerges(said["model"]["vocab"], said["model"]["merges"])
        self.added = {t["content"]: t["id"] for t in added}
        self.tokens = self.merges.tokens | {i: t.encode() for t, i in self.added.items()}
        self.packed = "H" if max(self.tokens) < 1 << 16 else "I"
        self.find = regex.compile(pattern)
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def __missing__(self, piece: str) -> bytes:
        if self.taken > self.memo:  # pieces not met since the last turn go, the others come back as they are met
            self.older = dict(self)
            self.clear()
            self.taken = 0
        if (found := self.older.get(piece)) is None:
            found = array(self.packed, self.merges.encode(piece.encode("utf-8", "surrogatepass"))).tobytes()
        self[piece] = found
        self.taken += PIECE_BYTES + len(piece) + len(found)
        return found

    def _between(self, text: str, start: int, end: int) -> Iterator[array]:
        """Ids of text[start:end], which holds no added token, at most RUN pieces of a long one at a time."""
        part = text[start:end] if start or end < len(text) else text
        pieces = iter(self.find.findall(part)) if len(part) <= LONG else (m[0] for m in self.find.finditer(part))
        while run := list(islice(pieces, RUN)):
            out = array(self.packed)
            out.frombytes(b"".join(map(self.__getitem__, run)))
            yield out

    def runs(self, text: str) -> Iterator[array]:
        """The ids of a text in order."""
        start = 0
        for mark in self.marks.finditer(text) if self.marks else ():
            yield from self._between(text, start, mark.start())
            yield array(self.packed, [self.added[mark[0]]])
            start = mark.end()
        yield from self._between(text, start, len(text))

    def encode(self, text: str) -> list[int]:
        return [i for run in self.runs(text) for i in run]

    def decode(self, ids) -> str:
        """Text of the ids, added tokens kept; ids that no token has are left out."""
        stream, of = Utf8Stream(), self.tokens.get
        return "".join([stream.feed(of(i, b"")) for i in ids]) + stream.end()


@cache
def encoder(path: str, pattern: str, memo: int = MEMO) -> Encoder:
    """This worker's encoder; its tables live as long as the worker, so the garbage collector passes over them."""
    pa.default_memory_pool().release_unused()
    made = Encoder(path, pattern, memo)
    gc.freeze()
    gc.set_threshold(100_000, 20, 100)
    return made


def _digests(path: str, pattern: str, memo: int):
    """mapInArrow function: (id, text) to the token count, the ids' digest and the decoded text's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, pattern, memo)
        of = code.tokens.__getitem__
        name = [str(i) for i in range(max(code.tokens) + 1)].__getitem__
        for batch in batches:
            counts, id_hashes, text_hashes = [], [], []
            for text in batch.column(1):
                n, ids_sha, text_sha, stream = 0, hashlib.sha256(), hashlib.sha256(), Utf8Stream()
                for ids in code.runs(text.as_py() or ""):
                    ids_sha.update((("," if n else "") + ",".join(map(name, ids))).encode())
                    n += len(ids)
                    text_sha.update(stream.feed(b"".join(map(of, ids))).encode())
                text_sha.update(stream.end().encode())
                counts.append(n)
                id_hashes.append(ids_sha.hexdigest())
                text_hashes.append(text_sha.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _rows(docs: DataFrame, id_col: str, col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(col).alias("of"))


def encode_tokens(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of each text: id_col, token_ids array<int>.  A null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, pattern)
        for batch in batches:
            for i in range(batch.num_rows):  # a row at a time: the ids of many long texts never stand together
                ids = pa.array([code.encode(batch.column(1)[i].as_py() or "")], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), ids], ["id", "token_ids"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "id long, token_ids array<int>").withColumnRenamed("id", id_col)


def decode_tokens(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """The inverse of encode_tokens: id_col, text.  Null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([code.decode(x.as_py() or ()) for x in batch.column(1)], pa.string())], ["id", "text"])

    return _rows(rows, id_col, ids_col).mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def token_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO) -> DataFrame:
    """Encodes every text and decodes its ids again: id_col, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty (no tokens, digests of nothing).  Added tokens that stand in a text are single
    ids, as the tokenizers library has it.  Repeated ids and rows give a row each; further columns are not read.
    One pass without a shuffle: a task holds one Arrow batch, the ids of at most RUN pieces, the tree of one
    piece (up to about 40 bytes a byte of the longest piece) and a memo of twice about `memo` bytes.
    """
    import public_tokenizers

    path, pattern = path or public_tokenizers.path("byte_bpe_50k.json"), pattern or public_tokenizers.PATTERN
    out = _rows(docs, id_col, text_col).mapInArrow(_digests(path, pattern, memo), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def op11_segment_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op11_segment_bpe": op11_segment_bpe}
SQL: dict[str, str] = {}
