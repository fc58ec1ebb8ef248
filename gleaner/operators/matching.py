"""Matching against catalogs: seeds with optional keys, chains that need exactly one of each, references in prose."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.ranking import top_k
from gleaner.operators.sets import settle

KEYS = ("package", "receiver", "name")


def _lattice_key(columns: list[Column], mask: Column) -> Column:
    """The keys that `mask` names, each in its place; the others are left open."""
    parts = [F.when(mask.bitwiseAND(F.lit(1 << k)) > 0, F.concat(F.length(c).cast("string"), F.lit(":"), c)).otherwise("*") for k, c in enumerate(columns)]
    return F.concat_ws("|", *parts)


def seed_matches(sites: DataFrame, seeds: DataFrame, site: str = "site", seed: str = "seed", samples: int = 8) -> DataFrame:
    """(site, status, seed, candidates, fields): what each call site is, by the most specific seed that fits.

    `sites`: site (its key), package, receiver, name, args (array of strings), variadic.  `seeds`: seed (its key), package,
    receiver and name (null: any; at least one is named), min_args (null: 0), variadic (null: either), projections
    (a map of field to struct<source, index, value, default, field>).

    A seed fits if its named keys are the site's, the site has at least min_args arguments and, if the seed says so,
    is variadic or not.  More named keys win, then a named package, receiver, name, then more arguments, then a
    said variadic.  One such seed: status matched, fields filled in from the argument of an index (from 0), the
    receiver, a field of it, or a constant, or else the default.  Several: ambiguous, no seed, and the first
    `samples` of them in `candidates`.  Sites that nothing fits, and those with null keys where a seed names one, have no row.

    Seeds with the same named keys, min_args and variadic rank alike, so the first `samples` of them stand for all, and
    all are numbered by rank.  Sites of the same keys, number of arguments and variadic are one shape and get the same seeds:
    only shapes carry a key for each set of named keys that any seed uses, at most seven, meet a row for each min_args and
    variadic there, and keep the least number.  Sites are settled once and look their shape up; nothing is sorted by site.
    """
    mask = sum((F.when(F.col(k).isNotNull(), 1 << n).otherwise(0) for n, k in enumerate(KEYS)), F.lit(0))
    named = seeds.withColumn("__mask", mask.cast("int")).where("__mask > 0")
    rule = named.select(F.col(seed).alias("__seed"), "__mask", _lattice_key([F.col(k) for k in KEYS], F.col("__mask")).alias("__key"), F.coalesce("min_args", F.lit(0)).alias("__least"), F.col("variadic").alias("__said"), "projections")
    alike = ["__mask", "__key", "__least", "__said"]
    near = top_k(rule.dropDuplicates([*alike, "__seed"]), alike, [F.col("__seed")], max(samples, 2))
    rank = [-F.bit_count("__mask"), *(-F.col("__mask").bitwiseAND(F.lit(1 << k)) for k in range(len(KEYS))), -F.col("__least"), F.col("__said").isNull()]
    grouped = near.groupBy(*alike).agg(F.array_sort(F.collect_list("__seed")).alias("__seeds"), F.min_by("projections", "__seed").alias("projections"))
    sorts = settle(grouped.repartitionByRange(*rank).sortWithinPartitions(*rank).withColumn("__no", F.monotonically_increasing_id()))
    used = sorted(r[0] for r in sorts.select("__mask").distinct().collect())  # at most seven
    own = settle(sites.select(site, *KEYS, "args", "variadic")).withColumn("__n", F.coalesce(F.size("args"), F.lit(0)))
    shape = [*KEYS, "__n", "variadic"]
    wide = own.select(*shape).distinct().withColumn("__mask", F.explode(F.array(*(F.lit(m) for m in used)) if used else F.array().cast("array<int>")))
    met = wide.withColumn("__key", _lattice_key([F.col(k) for k in KEYS], F.col("__mask"))).where("__key is not null").join(sorts.select(*alike, "__no"), ["__mask", "__key"])
    fits = (F.col("__n") >= F.col("__least")) & (F.col("__said").isNull() | F.equal_null("__said", "variadic"))
    best = met.where(fits).groupBy(*shape).agg(F.min("__no").alias("__no")).join(sorts.select("__no", "__seeds", "projections"), "__no")
    best = settle(best.select(*(F.col(c).alias(f"__of_{c}") for c in shape), "__seeds", "projections"))
    one = own.join(best, reduce(and_, (F.equal_null(c, f"__of_{c}") for c in shape)))
    at = {c: F.col(c) for c in ("receiver", "args", "projections", "__seeds")}
    found = at["__seeds"]

    def filled(p: Column) -> Column:
        inside = (p["index"] >= 0) & (p["index"] < F.coalesce(F.size(at["args"]), F.lit(0)))
        value = F.when(p["source"] == "argument", F.when(inside, F.get(at["args"], p["index"]))).when(p["source"] == "receiver", at["receiver"]).when(p["source"] == "receiver_field", F.concat(at["receiver"], F.lit("."), p["field"])).when(p["source"] == "constant", p["value"])
        return F.coalesce(value, p["default"])

    sole = F.size(found) == 1
    fields = F.when(sole, F.transform_values(F.coalesce(at["projections"], F.create_map().cast(seeds.schema["projections"].dataType)), lambda _, p: filled(p)))
    return one.select(site, F.when(sole, "matched").otherwise("ambiguous").alias("status"), F.when(sole, found[0]).alias("seed"), F.when(~sole, F.slice(found, 1, samples)).alias("candidates"), fields.alias("fields"))


def attached_chains(descriptors: DataFrame, bindings: DataFrame, activations: DataFrame, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """(chains, frontiers): each descriptor with the one binding and the one activation that lead to it exactly.

    descriptors (id); bindings and activations (id, exact, to_id, candidate_ids); of rows with one id the least counts.
    chains: (id, binding, activation, status), one row a descriptor: complete, or which of both is missing or
    ambiguous, side by side.  A side is attached only if exactly one exact row leads to the descriptor.

    frontiers: (id, kind, detail): for a side with several exact rows, binding_ambiguous or activation_ambiguous with the
    ids of the rows, `most` of a descriptor's in all, activations first, each by id; what goes beyond is one
    row evidence_limit with their number.  A row that is not exact adds binding_candidate or activation_candidate to
    every descriptor it may mean.  Rows that lead to no known descriptor have no part.

    Descriptors and the exact rows of both sides meet as one table, sorted once by descriptor.
    """
    own = descriptors.where("id is not null").select("id").distinct()

    def side(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        once = rows.where("id is not null").groupBy(F.col("id").alias("row")).agg(F.min(F.struct("exact", "to_id", "candidate_ids")).alias("r")).select("row", "r.*")
        exact = once.where("exact and to_id is not null").select(F.col("to_id").alias("id"), F.col("row").alias(name))
        vague = once.where("not coalesce(exact, false)").select("row", F.explode(F.array_distinct(F.array_compact(F.concat(F.array("to_id"), F.coalesce("candidate_ids", F.array().cast(rows.schema["candidate_ids"].dataType)))))).alias("id"))
        return exact, vague.select("id", F.lit(f"{name}_candidate").alias("kind"), F.col("row").cast("string").alias("detail"))

    (b, b_vague), (a, a_vague) = side(bindings, "binding"), side(activations, "activation")
    rows = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)), allowMissingColumns=True).unionByName(own.withColumn("side", F.lit(2)), allowMissingColumns=True)
    of, place = Window.partitionBy("id"), Window.partitionBy("id").orderBy("side", "activation", "binding")
    placed = rows.withColumn("place", F.row_number().over(place))
    for name in ("activation", "binding"):
        placed = placed.withColumn(f"{name}s", F.count(name).over(of)).withColumn(f"first_{name}", F.min(name).over(of))
    placed = settle(placed.withColumn("known", F.max("side").over(of) == 2).where("known").drop("known"))
    met = placed.where("side = 2")
    word = lambda n: F.when(F.col(n) == 0, f"no_{n[:-1]}").when(F.col(n) > 1, f"{n[:-1]}_ambiguous")
    status = F.concat_ws(",", word("bindings"), word("activations"))
    chains = met.select("id", F.when(F.col("bindings") == 1, F.col("first_binding")).alias("binding"), F.when(F.col("activations") == 1, F.col("first_activation")).alias("activation"), F.when(status == "", "complete").otherwise(status).alias("status"))
    turn = F.col("place") - F.when((F.col("side") == 1) & (F.col("activations") == 1), 1).otherwise(0)  # an only activation is no crowd
    crowd = placed.where(((F.col("side") == 0) & (F.col("activations") > 1)) | ((F.col("side") == 1) & (F.col("bindings") > 1)))
    first = F.col("side") == 0
    shown = crowd.where(turn <= most).select("id", F.when(first, "activation_ambiguous").otherwise("binding_ambiguous").alias("kind"), F.when(first, F.col("activation").cast("string")).otherwise(F.col("binding").cast("string")).alias("detail"))
    several = sum((F.when(F.col(n) > 1, F.col(n)).otherwise(0) for n in ("activations", "bindings")), F.lit(-most))
    beyond = met.where(several > 0).select("id", F.lit("evidence_limit").alias("kind"), several.cast("string").alias("detail"))
    vague = b_vague.union(a_vague).join(own, "id", "left_semi")
    return chains, shown.union(beyond).union(vague)


#: Fixed class: characters that may be part of a path; a reference has none of them right before or behind it.
PATH_CHARS = "A-Za-z0-9_./-"
_RUN = re.compile(f"[{PATH_CHARS}]+")
#: Bits of the filter that holds stretches which are no path back from the shuffle, at most.
MOST_BITS = 1 << 27


def _runs(runs: int, longest: int, beside: int, bits: bytes):
    """mapInArrow function: (id, text) to every stretch of up to `runs` runs of path characters whose crc32 has its bit
    in `bits`, with where it starts and what stands beside it."""
    last = len(bits) * 8 - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, core, before, behind = [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                spans = [m.span() for m in _RUN.finditer(text)]
                for i, (a, _) in enumerate(spans):
                    for _, b in spans[i : i + runs]:
                        if b - a > longest:
                            break
                        bit = zlib.crc32(text[a:b].encode()) & last
                        if bits[bit >> 3] >> (bit & 7) & 1:
                            row.append(k)
                            start.append(a)
                            core.append(text[a:b])
                            before.append(text[max(0, a - beside) : a])
                            behind.append(text[b : b + beside + 20])
            ids = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(start, pa.int32()), pa.array(core, pa.string()), pa.array(before, pa.string()), pa.array(behind, pa.string())], ["id", "start", "core", "before", "behind"])

    return run


def _bits(cores: DataFrame, n: int) -> bytes:
    """A bit for the crc32 of each core, about 16 times as many bits as cores and MOST_BITS at most: 16 MB, whatever the input."""
    size = min(MOST_BITS, max(1 << 15, 1 << (16 * n - 1).bit_length()))
    at = F.crc32("core").bitwiseAND(F.lit(size - 1)) + 1  # Spark numbers bits from 1
    rows = cores.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m")).collect()
    out = bytearray(size // 8)
    for r in rows:
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = r["m"]
    return bytes(out)


def references(texts: DataFrame, paths: DataFrame, id_col: str, text_col: str, path_col: str = "path") -> DataFrame:
    """(id, path, line, position): known paths that a text refers to, each with and without a line once, in order.

    A reference is the very path, with no character of a path right before or behind it; `:` and digits behind it that end
    likewise are its line (null without).  A path may hold blanks, have no extension, or be part of a longer one; position
    is the character (from 0) where the first such reference starts, and order is by it, longer paths first.
    Paths without any character of PATH_CHARS are not looked for; null or empty texts have no references.

    Texts and paths meet on the stretch from a path's first to its last run of path characters, in one equi-join.  Texts
    give stretches of as many runs as any path has, and a filter of bounded size keeps those back that no path begins
    and ends with, so few words are shuffled, and no text is ever held against all paths.
    """
    known = paths.select(F.col(path_col).alias("path")).where(F.col("path").rlike(f"[{PATH_CHARS}]")).distinct()
    parts = known.select(
        "path", F.regexp_extract("path", f"^([^{PATH_CHARS}]*)", 1).alias("lead"), F.regexp_extract("path", f"([^{PATH_CHARS}]*)\\z", 1).alias("trail"),
        F.size(F.regexp_extract_all("path", F.lit(f"[{PATH_CHARS}]+"), F.lit(0))).alias("runs"),
    )
    cores = settle(parts.withColumn("core", F.substring("path", F.length("lead") + 1, F.length("path") - F.length("lead") - F.length("trail"))))
    runs, longest, beside, n = cores.agg(F.max("runs"), F.max(F.length("core")), F.max(F.greatest(F.length("lead"), F.length("trail"))), F.count("*")).first()
    said = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    kind = said.schema["id"].dataType.simpleString()
    found = said.mapInArrow(_runs(runs or 0, longest or 0, (beside or 0) + 1, _bits(cores, n)), f"id {kind}, start int, core string, before string, behind string").join(cores, "core")
    rest = F.substring("behind", F.length("trail") + 1, F.length("behind"))
    fits = F.endswith("before", F.col("lead")) & F.startswith("behind", F.col("trail"))
    ahead = F.substring("before", 1, F.length("before") - F.length("lead"))
    clear = ~ahead.rlike(f"[{PATH_CHARS}]\\z") & ~rest.rlike(f"^[{PATH_CHARS}]")
    line = F.regexp_extract(rest, f"^:([0-9]+)(?![{PATH_CHARS}])", 1)
    out = found.where(fits & clear).select("id", "path", F.when(line != "", line.try_cast("long")).alias("line"), (F.col("start") - F.length("lead")).alias("position"))
    return out.groupBy("id", "path", "line").agg(F.min("position").alias("position")).withColumnRenamed("id", id_col)


_OF_PATH = re.compile(f"[{PATH_CHARS}]")
#: What follows a path in each form of a claim.
_CLAIMS = [re.compile(form) for form in (r"\s+lines?\s+(?P<line>[0-9]+)(?:\s*-\s*[0-9]+)?", r"(?P<between>[^.;\n]{0,160}?)\s+at\s+line\s+(?P<line>[0-9]+)", "[:#](?P<line>[0-9]+)")]


def _rewritten(text: str, path: str, lines: set[int]) -> tuple[str, bool]:
    """text with its claims about one path rewritten, and whether all their lines are known."""
    grounded = True
    for form in _CLAIMS:
        out, done, i = [], 0, text.find(path)
        while i >= 0:
            # the character before a path belongs to its claim, so claims have one between them
            open_ = i == 0 or (i > done and not _OF_PATH.match(text, i - 1))
            claim = form.match(text, i + len(path)) if open_ else None
            if claim is None:
                i = text.find(path, i + 1)
                continue
            sure = int(claim["line"]) in lines
            grounded &= sure
            between = (claim["between"] if "between" in form.groupindex else "").rstrip(" \t")
            out += [text[done : i + len(path)], f":{int(claim['line'])}" if sure else "", between]
            done = claim.end()
            i = text.find(path, done + 1)
        text = "".join([*out, text[done:]]) if out else text
    return text, grounded


def _canonical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, held: the paths in it with their known lines) to the rewritten text and whether all lines are known."""
    for batch in batches:
        texts, sound = [], []
        for text, held in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            grounded = True
            for path, lines in sorted(((h["path"], set(h["lines"])) for h in held or ()), key=lambda h: (-len(h[0]), h[0])):
                text, sure = _rewritten(text, path, lines)
                grounded &= sure
            texts.append(text)
            sound.append(grounded)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(sound)], ["id", "text", "grounded"])


def canonical_statements(texts: DataFrame, paths: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, grounded): statements whose claims `path line N`, `path ... at line N` and `path:N` read `path:N` if the
    line is known (known: path, line), and lose the line if not; grounded says that none was lost.

    Longer paths first, each form in turn.  A text meets the paths that references() finds in it, with their lines, never
    all paths; a null text stays null and is grounded.
    """
    lines = known.where("path is not null and line > 0").groupBy("path").agg(F.collect_set(F.col("line").cast("long")).alias("lines"))
    held = references(texts, paths, id_col, text_col).select(id_col, "path").distinct().join(lines, "path", "left")
    held = held.groupBy(F.col(id_col).alias("__id")).agg(F.collect_list(F.struct("path", F.coalesce("lines", F.array().cast("array<bigint>")).alias("lines"))).alias("held"))
    met = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(held, F.col("id") == F.col("__id"), "left")
    bare = met.where("held is null").select("id", "text", F.lit(True).alias("grounded"))
    kind = met.schema["id"].dataType.simpleString()
    return bare.union(met.where("held is not null").select("id", "text", "held").mapInArrow(_canonical, f"id {kind}, text string, grounded boolean")).withColumnRenamed("id", id_col)
