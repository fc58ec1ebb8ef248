"""Byte-level BPE encoding and decoding.

`Transducer` compiles a rank file into a finite-state transducer over bytes that is determinised
lazily.  A state stands for every way the bytes read since the last emitted token may yet be grouped:
each live configuration is an unfinished token after the chain of tokens before it.  Reading a byte
advances all configurations; once they agree on a first token it is emitted, so the lookahead is
bounded by the longest token.  Whether one token may follow another is decided at their seam: the
pair stands unless some merge across it would have come before the merges that built the two sides.
States, transitions and seams are computed when first needed and kept up to a stated number.

`Utf8Stream` decodes bytes as they come, holding back an incomplete character.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import lean, table
from gleaner.llm.words import slices

#: Bytes, about, that a worker keeps of pieces already encoded in each of two generations, and what a piece takes beside
#: its characters and tokens; transducer states kept, at most, and three times as many seams.
MEMO, PIECE_BYTES, STATES = 160 << 20, 150, 100_000
#: Characters of a text beyond which it is encoded in runs of RUN pieces, so that the ids of a huge text
#: never stand in memory together.
LONG, RUN = 1 << 20, 50_000
BYTES = [bytes((b,)) for b in range(256)]


class State:
    """Bytes not yet emitted after the token `before`; `live` holds (start, tokens up to it) of each
    configuration in order of start, the last one with no byte of an unfinished token."""

    __slots__ = ("before", "tail", "live", "moves")

    def __init__(self, before: int, tail: bytes, live: list[tuple[int, tuple[int, ...]]]) -> None:
        self.before, self.tail, self.live, self.moves = before, tail, live, {}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], kept: int = STATES) -> None:
        self.ranks, self.kept = ranks, kept
        self.tokens = {i: t for t, i in ranks.items()}
        #: token or prefix of one -> (rank or -1, whether a longer token starts so)
        self.known: dict[bytes, tuple[int, bool]] = {t: (r, False) for t, r in ranks.items()}
        for prefix in {t[:k] for t in ranks for k in range(1, len(t))}:
            self.known[prefix] = (ranks.get(prefix, -1), True)
        self.spines: tuple[dict[int, list[tuple[bytes, int]]], dict[int, list[tuple[bytes, int]]]] = ({}, {})
        self.parts: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._clear()

    def _clear(self) -> None:
        self.start = State(-1, b"", [(0, ())])
        self.states: dict[tuple[int, bytes], State] = {(-1, b""): self.start}
        self.seams: dict[tuple[int, int], bool] = {}
        if sum(map(len, self.spines)) + len(self.parts) > self.kept:
            self.spines, self.parts = ({}, {}), {}

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes the token, or None if merging its bytes never gives it."""
        if token in self.parts:
            return self.parts[token]
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, k = min((self.ranks.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        self.parts[token] = found = (parts[0], parts[1]) if len(parts) == 2 else None
        return found

    def _spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """Parts of the token along its right (side 1) or left (side 0) edge, each with the rank of the
        merge that takes it in; empty if the token can't arise by merges."""
        if (out := self.spines[side].get(token)) is None:
            part, taken, out = self.tokens[token], 1 << 60, []
            while True:
                out.append((part, taken))
                if len(part) == 1:
                    break
                halves = self._halves(part)
                if halves is None:
                    out = []
                    break
                taken, part = self.ranks[part], halves[side]
            self.spines[side][token] = out
        return out

    def follows(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes is these two tokens; left -1: none before."""
        self.seams[left, right] = ok = self._seam(left, right)
        return ok

    def _seam(self, left: int, right: int) -> bool:
        ys = self._spine(right, 0)
        if left < 0 or not ys:
            return bool(ys)
        xs, get = self._spine(left, 1), self.ranks.get
        for x, x_in in xs:
            for y, y_in in ys:
                if (r := get(x + y)) is not None and r < x_in and r <= y_in:
                    return False
        return bool(xs)

    def _advance(self, state: State, tail: bytes) -> list[tuple[int, tuple[int, ...]]]:
        """Configurations after one more byte."""
        known, live, done = self.known.get, [], None
        for config in state.live:
            s, tokens = config
            if (of := known(tail[s:])) is None:
                continue
            rank, extends = of
            if done is None and rank >= 0:
                seam = (tokens[-1] if tokens else state.before, rank)
                if (ok := self.seams.get(seam)) is None:
                    ok = self.follows(*seam)
                if ok:
                    done = (*tokens, rank)
            if extends:
                live.append(config)
        live.append((len(tail), done))
        return live

    def _finish(self, state: State, tail: bytes) -> tuple[int, ...]:
        """Tokens after the piece's last byte: those of the one configuration that is finished."""
        ranks = self.ranks.get
        for s, tokens in state.live:
            if (rank := ranks(tail[s:])) is not None:
                seam = (tokens[-1] if tokens else state.before, rank)
                if (ok := self.seams.get(seam)) is None:
                    ok = self.follows(*seam)
                if ok:
                    return (*tokens, rank)
        raise ValueError("no encoding")

    def _move(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        tail = state.tail + BYTES[byte]
        live = self._advance(state, tail)
        sent, before = live[0][1], state.before
        for _, tokens in live:  # the tokens that all configurations begin with
            if not sent:
                break
            while tokens[: len(sent)] != sent:
                sent = sent[:-1]
        if sent:
            size, agreed, before = sum([len(self.tokens[t]) for t in sent]), len(sent), sent[-1]
            tail, live = tail[size:], [(s - size, c[agreed:]) for s, c in live]
        if (to := self.states.get((before, tail))) is None:
            to = self.states[before, tail] = State(before, tail, live)
        state.moves[byte] = move = (to, sent)
        return move

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Token ids of one pre-split piece."""
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        if not piece:
            return ()
        if len(self.states) > self.kept or len(self.seams) > 3 * self.kept:
            self._clear()
        state, out = self.start, []
        for byte in piece[:-1]:
            state, sent = state.moves.get(byte) or self._move(state, byte)
            if sent:
                out += sent
        return (*out, *self._finish(state, state.tail + piece[-1:]))


class Utf8Stream:
    """Incremental UTF-8: feed() returns the text of all complete characters so far, end() the rest."""

    _NEED = [1] * 0xC0 + [2] * 0x20 + [3] * 0x10 + [4] * 0x10

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        for back in range(1, min(4, len(data)) + 1):
            if data[-back] & 0xC0 != 0x80:  # the last lead byte: does its character end here?
                cut = len(data) - back if self._NEED[data[-back]] > back else len(data)
                break
        else:
            cut = len(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder(dict):
    """Pieces of text by the split pattern, each mapped to its packed ids; bounded by bytes."""

    def __init__(self, path: str, pattern: str, memo: int = MEMO, states: int = STATES) -> None:
        import regex

        super().__init__()
        self.memo, self.taken = memo, 0
        self.find = regex.compile(pattern)
        self.older: dict[str, bytes] = {}
        self.transducer = Transducer(read_ranks(path), states)
        self.packed = "H" if max(self.transducer.tokens, default=0) < 1 << 16 else "I"

    def __missing__(self, piece: str) -> bytes:
        if self.taken > self.memo:  # pieces not met since the last turn go, the others come back as they are met
            self.older = dict(self)
            self.clear()
            self.taken = 0
        if (found := self.older.get(piece)) is None:
            found = array(self.packed, self.transducer.encode(piece.encode("utf-8", "surrogatepass"))).tobytes()
        self[piece] = found
        self.taken += PIECE_BYTES + len(piece) + len(found)
        return found

    def runs(self, text: str) -> Iterator[array]:
        """The ids of a text, at most RUN pieces of a long one at a time."""
        if len(text) <= LONG:
            if text:
                yield self.unpacked(map(self.__getitem__, self.find.findall(text)))
            return
        found = (m[0] for m in self.find.finditer(text))
        while run := list(islice(found, RUN)):
            yield self.unpacked(map(self.__getitem__, run))

    def unpacked(self, pieces: Iterable[bytes]) -> array:
        out = array(self.packed)
        out.frombytes(b"".join(pieces))
        return out

    def encode(self, text: str) -> list[int]:
        return [i for run in self.runs(text) for i in run]

    def decode(self, ids: Iterable[int]) -> str:
        stream, tokens = Utf8Stream(), self.transducer.tokens
        return "".join([stream.feed(tokens[i]) for i in ids]) + stream.end()


@cache
def encoder(path: str, pattern: str, memo: int = MEMO, states: int = STATES) -> Encoder:
    """This worker's encoder.  Its tables are large and live as long as the worker, so the garbage
    collector is kept from walking them over and over."""
    pa.default_memory_pool().release_unused()
    made = Encoder(path, pattern, memo, states)
    gc.freeze()
    gc.set_threshold(100_000, 20, 100)
    return made


def digests(path: str, pattern: str, memo: int = MEMO, states: int = STATES):
    """mapInArrow function: (id, text) to the token count, the ids' digest and the decoded text's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, pattern, memo, states)
        of = code.transducer.tokens.__getitem__
        name = [str(i) for i in range(max(code.transducer.tokens, default=-1) + 1)].__getitem__
        for batch in batches:
            counts, id_hashes, text_hashes = [], [], []
            for text in batch.column(1):
                n, ids_sha, text_sha, stream = 0, hashlib.sha256(), hashlib.sha256(), Utf8Stream()
                for ids in code.runs(text.as_py() or ""):
                    ids_sha.update(((" " if n else "") + " ".join(map(name, ids))).encode())
                    n += len(ids)
                    text_sha.update(stream.feed(b"".join(map(of, ids))).encode())
                text_sha.update(stream.end().encode())
                counts.append(n)
                id_hashes.append(ids_sha.hexdigest())
                text_hashes.append(text_sha.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_tokens(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of each text: id_col, token_ids array<int>.  A null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, pattern)
        for batch in batches:
            sizes = [len(t.as_py() or "") for t in batch.column(1)]
            import numpy as np

            for i, j in slices(np.array(sizes, int)):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([code.encode(t.as_py() or "") for t in part.column(1)], pa.list_(pa.int32()))], ["id", "token_ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, token_ids array<int>").withColumnRenamed("id", id_col)


def decode_tokens(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """The inverse of encode_tokens: id_col, text.  Null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([code.decode(x.as_py() or ()) for x in batch.column(1)], pa.string())], ["id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def token_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO, states: int = STATES) -> DataFrame:
    """Encodes every text and decodes its ids again: id_col, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty (no tokens).  One pass over the rows without a shuffle; a task holds
    one Arrow batch, the ids of at most RUN pieces, and a memo of twice about `memo` bytes and `states` states of the transducer, which
    change the speed alone.  Repeated ids and rows give a row each.
    """
    import public_tokenizers

    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(digests(path, pattern, memo, states)), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op4_byte_bpe": op4_byte_bpe}
SQL: dict[str, str] = {}
