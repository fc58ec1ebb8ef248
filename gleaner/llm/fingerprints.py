"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes ends a piece wherever it meets a block size, which is 3 * 2**k;
each piece gives one base64 character of its hash.  A fingerprint holds the pieces' characters at a
block size fit for the text's length and at twice that size, so that texts of up to twice the length
compare.  Likeness is one minus the edit distance (insertions and deletions) of the character strings
at a common block size over their lengths; strings without a common run of seven characters (three where they are
short) are unlike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import table
from gleaner.llm.words import _BASE, _BYTE, _INVERSE, SLICE_BYTES, mix, powers

SMALLEST, LENGTH, COMMON, SHORT = 3, 64, 7, 3
WINDOW, LEVELS = 7, 31
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_WEIGHTS = (np.random.default_rng(5).integers(1, 1 << 31, WINDOW, dtype=np.uint32) * np.uint32(2)) | np.uint32(1)


def _triggers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of pieces at the smallest block size, and the power of two by which larger sizes end there too."""
    rolled = np.zeros(len(data), np.uint32)
    for k in range(min(WINDOW, len(data))):
        rolled[k:] += (data[: len(data) - k].astype(np.uint32) + np.uint32(1)) * _WEIGHTS[k]
    rolled = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    rolled ^= rolled >> np.uint32(13)
    at = np.flatnonzero(rolled % np.uint32(SMALLEST) == 0)
    rest = rolled[at] // np.uint32(SMALLEST)
    low = rest & (~rest + np.uint32(1))
    return at + 1, np.where(rest == 0, LEVELS - 1, np.log2(np.maximum(low, 1)).astype(np.int64))


def _ends(data: np.ndarray, step: int) -> tuple[list[np.ndarray], np.ndarray]:
    """By level: the first LENGTH ends of at least that level, and how many there are in all."""
    first: list[list[np.ndarray]] = [[] for _ in range(LEVELS)]
    counts = np.zeros(LEVELS, np.int64)
    for o in range(0, len(data), step):
        back = min(o, WINDOW - 1)
        ends, levels = _triggers(data[o - back : o + step])
        ends, levels = ends[ends > back] + (o - back), levels[ends > back]
        for k in range(LEVELS):
            ends, levels = ends[levels >= k], levels[levels >= k]
            if counts[k] < LENGTH:
                first[k].append(ends[: LENGTH - counts[k]])
            counts[k] += len(ends)
            if not len(ends):
                break
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in first], counts


def _totals(data: np.ndarray, cuts: np.ndarray, step: int) -> np.ndarray:
    """The polynomial hash of the bytes before each of the ascending cuts."""
    out, before, scale = np.zeros(len(cuts), np.uint64), 0, 1
    for o in range(0, len(data), step):
        part = data[o : o + step]
        power, _ = powers(len(part))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_PLAIN[part] * power)])
        mine = (cuts >= o) & (cuts <= o + len(part))
        out[mine] = np.uint64(before) + total[cuts[mine] - o] * np.uint64(scale)
        before = (before + int(total[-1]) * scale) % (1 << 64)
        scale = scale * pow(_BASE, len(part), 1 << 64) % (1 << 64)
    return out


def _letters(data: np.ndarray, ends: np.ndarray, step: int) -> str:
    """One character for each piece, the bytes after the last end included."""
    inner = ends[: LENGTH - 1]
    cuts = np.concatenate([[0], inner, [len(data)] if not len(inner) or inner[-1] < len(data) else []]).astype(np.int64)
    totals = _totals(data, cuts, step)
    _, table_ = powers(SLICE_BYTES)
    starts = cuts[:-1]
    shift = table_[starts] if starts[-1] < SLICE_BYTES else np.array([pow(_INVERSE, int(c), 1 << 64) for c in starts], np.uint64)
    return _LETTERS[(mix((totals[1:] - totals[:-1]) * shift) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: bytes, step: int = SLICE_BYTES) -> str:
    """`size:letters:letters at twice the size`; equal texts have equal fingerprints.

    A text is read in slices of `step` bytes, so memory doesn't follow its length.
    """
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    if not n:
        return f"{SMALLEST}::"
    ends, counts = _ends(data, step)
    level = min(LEVELS - 2, max(0, int(np.ceil(np.log2(max(n / (SMALLEST * LENGTH), 1))))))
    while level and counts[level] < LENGTH // 2:
        level -= 1
    return f"{SMALLEST << level}:{_letters(data, ends[level], step)}:{_letters(data, ends[level + 1], step)}"


_BYTE_PLAIN = _BYTE.copy()
_BYTE_PLAIN[65:91] ^= np.uint64(0x5851F42D4C957F2D)  # unlike words, pieces tell cases apart


def _common(a: str, b: str) -> bool:
    """Whether both share a run of COMMON letters, or of SHORT where one has fewer than 2 * COMMON."""
    size = COMMON if min(len(a), len(b)) >= 2 * COMMON else SHORT
    runs = {a[i : i + size] for i in range(len(a) - size + 1)}
    return any(b[i : i + size] in runs for i in range(len(b) - size + 1))


def _overlap(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def likeness(one: str, two: str) -> float:
    """0 to 1; 1 for equal fingerprints of texts long enough to compare or equal outright."""
    if one == two:
        return 1.0
    (s, a, a2), (t, b, b2) = one.split(":"), two.split(":")
    s, t = int(s), int(t)
    pairs = [(a, b), (a2, b2)] if s == t else [(a2, b)] if t == 2 * s else [(a, b2)] if s == 2 * t else []
    best = 0.0
    for x, y in pairs:
        if x == y and len(x) >= COMMON:
            return 1.0
        if _common(x, y):
            best = max(best, 2 * _overlap(x, y) / (len(x) + len(y)))
    return best


def compare(rows: DataFrame, a: str = "a", b: str = "b", name: str = "likeness") -> DataFrame:
    """rows with the likeness of two fingerprint columns; null where either is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (a, b))
            found = [likeness(p, q) if p is not None and q is not None else None for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, name])

    return rows.mapInArrow(run, rows.withColumn(name, F.lit(0.0)).schema)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and fingerprint of each text; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint((t.as_py() or "").encode()) for t in batch.column(1)], pa.string())], ["id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fingerprint string").withColumnRenamed("id", id_col)


def _in_turn(docs: DataFrame) -> DataFrame:
    """Rows (part, id, text, own) so that each part, read in descending id, ends with a row that isn't its
    own: the first of the part after it, or for the last part the first row of all.

    Parts are ranges of ids cut at approximate quantiles.  What passes through the driver is the cuts and
    the largest id of each part, as many as there are shuffle partitions.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)], 1000)).first()[0] if parts > 1 else None
    edges = sorted(set(cuts or ()))
    marks = F.array(*map(F.lit, edges)) if edges else F.array().cast("array<bigint>")
    place = F.size(F.filter(marks, lambda m: m < F.col("id")))
    dealt = docs.withColumn("part", place)
    tops = {r["part"]: r["top"] for r in dealt.groupBy("part").agg(F.max("id").alias("top")).collect()}
    order = sorted(tops)
    if not order:
        return dealt.withColumn("own", F.lit(True))
    # the first row of part p closes the part above it; the very first closes the lowest
    closes = {tops[p]: order[(k + 1) % len(order)] for k, p in enumerate(order)}
    also = F.element_at(F.create_map(*(F.lit(x) for pair in closes.items() for x in pair)), F.col("id"))
    copies = F.when(also.isNotNull(), F.array(F.struct(F.col("part").alias("part"), F.lit(True).alias("own")), F.struct(also.alias("part"), F.lit(False).alias("own")))).otherwise(
        F.array(F.struct(F.col("part").alias("part"), F.lit(True).alias("own")))
    )
    spread = dealt.select("id", "text", F.explode(copies).alias("c")).select("c.part", "id", "text", "c.own")
    return spread.repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.desc("own"), F.desc("id"), "text")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each own row against the row after it in its part."""
    held: tuple[int, int, str, bool] | None = None
    last: tuple[bytes, str] = (b"", "")
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    for batch in batches:
        out = []
        for part, i, text, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            code = text.encode()
            print_ = last[1] if code == last[0] and last[1] else fingerprint(code)
            last = (code, print_)
            if held and held[0] == part and held[3]:
                was = held[2]
                third = len(was) // 3
                edited = (was[: len(was) - third] + text[:third]).encode()
                changed = fingerprint(edited)
                out.append((held[1], len(was), hashlib.sha256(edited).hexdigest(), held[4], changed, likeness(held[4], changed), likeness(held[4], print_)))
                held = None
            if own or held is None or held[0] != part:
                held = (part, i, text, own, print_)
        columns = list(zip(*out, strict=True)) or [[]] * len(names)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints every text and an edited copy whose last third is replaced by the start of the next
    document's text (descending id; after the last the first), and compares the fingerprint with the
    edited text's (near_edited) and the next document's (near_next).

    Columns: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  A
    null text counts as empty; rows of one id follow each other in the order of their texts, null first;
    rows with a null id are left out, having no place in the order.  A single row follows itself.  Texts
    move once, in ranges of ids; a task reads its range in order and holds two texts.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = _in_turn(rows).select("part", "id", "text", "own").mapInArrow(
        _compared, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    return found.withColumnRenamed("id", id_col)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


QUERIES = {"op5_fingerprints": op5_fingerprints}
SQL: dict[str, str] = {}
