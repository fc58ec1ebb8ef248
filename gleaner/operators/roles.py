"""Scores of candidates for the roles that a task asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import labels as L
from gleaner.functions import paths as P
from gleaner.functions.text import identifier_words

#: What words of a symbol add for a role.  Of one list the first entry with a word counts; lists add up.
ROLE_WORDS: dict[str, list[list[tuple[int, list[str]]]]] = {
    "public_or_cli_entry": [[(120, ["register", "serve", "main", "command", "run"]), (80, ["handle", "send", "read", "generate", "output"]), (40, ["new", "create", "build"])]],
    "symptom_site": [[(100, ["send", "response", "status", "handle", "validate", "register"])]],
    "transformation_or_parsing": [[(180, ["parse", "transform", "convert", "customizer", "customize", "determine", "decode", "encode", "normalize"])]],
    "error_creation": [[(100, ["error", "err"])]],
    "error_mapping": [[(130, ["map", "mapper", "status", "serialize", "serializer", "handler"])]],
    "unsafe_operation": [[(160, ["validate", "dereference", "reflect", "unsafe"])]],
    "nil_capable_handoff": [[(120, ["body", "validate", "decode", "read", "transform"])]],
    "configuration_copy": [[(160, ["with", "copy", "apply", "merge", "set"])]],
    "configuration_source": [[(100, ["config", "configuration", "option", "settings", "engine"])]],
    "effective_destination": [[(100, ["config", "configuration", "option", "settings", "engine"])]],
    "error_normalizer": [[(180, ["handle", "handler", "normalize", "normalizer"])]],
    "public_error_exposure": [[(140, ["public", "send", "serialize", "response", "handler"])]],
}
#: What it adds if a symbol has a word of both lists.
ROLE_PAIRS: dict[str, list[tuple[int, list[str], list[str]]]] = {
    "error_mapping": [
        (180, ["send"], ["error", "err"]),
        (120, ["send", "write", "respond", "response", "handle", "handler", "map", "mapper", "normalize", "translate", "serialize", "render"], ["error", "err", "failure", "status"]),
    ]
}
#: Further words for a role in tasks of one profile.
PROFILE_WORDS: dict[tuple[str, str], tuple[int, list[str]]] = {
    ("public_or_cli_entry", "nil_panic_bug"): (180, ["validate", "transform", "body"]),
    ("symptom_site", "error_status_mapping_bug"): (220, ["send"]),
}
#: What a level of the path takes off; a term, a word alike a term and a complete scope add.
DEPTH, TERM, ALIKE, MOST_ALIKE, COMPLETE = 12, 2, 12, 600, 24


def path_bonus(path: Column) -> dict[str, Column]:
    """What a path adds for roles that are told by their place."""
    base = P.base_name(F.lower(path))
    points = lambda *ways: F.coalesce(*(F.when(c, n) for c, n in ways), F.lit(0))
    operational = points((L.operational_kind(path).isNotNull(), 180))
    return {
        "verification_anchor": points((P.artifact_role(path).isin("test", "fixture"), 100)),
        "documentation_contract": points((base.rlike("contribut|release"), 160)),
        "module_or_topology_source": points((base == "go.work", 220), ((base == "go.mod") & ~F.contains(path, F.lit("/")), 140)),
        "operational_entry": operational,
        "procedural_body": operational,
        "safety_check": operational,
    }


def stem_key(word: Column) -> Column:
    """Two words are alike if they share their first five letters, or are equal and of three or four; this key is then
    the same, and null for words that are like nothing."""
    return F.when(F.length(word) >= 3, F.substring(word, 1, 5))


def _word_points(words: Column, lists: list[list[tuple[int, list[str]]]], pairs: list[tuple[int, list[str], list[str]]]) -> Column:
    has = lambda of: F.arrays_overlap(words, F.array(*map(F.lit, of)))
    total = F.lit(0)
    for entries in lists:
        total = total + F.coalesce(*(F.when(has(of), n) for n, of in entries), F.lit(0))
    for n, left, right in pairs:
        total = total + F.when(has(left) & has(right), n).otherwise(0)
    return total


def role_scores(candidates: DataFrame, terms: DataFrame, scope: list[str], roles: list[str], words: dict | None = None, pairs: dict | None = None, places: dict[str, Column] | None = None, profile: str | None = None) -> DataFrame:
    """A row for each candidate and role of it that is asked for: the candidate's columns, role and score.

    `candidates` has scope columns, anchor (its key), path, symbol, base, terms and roles (arrays of strings) and complete;
    `terms` has the scope, term and weight.  A score is the base, less the path's depth, plus the weights of the
    candidate's terms, plus the words of its symbol that are like terms (MOST_ALIKE at most), plus what it being
    complete, its words and its path add for the role; `profile` names a column of tasks' profiles.

    A scope's terms meet its candidates as one map of their weights by key, so that no candidate is held against all
    terms, and only whole candidates are shuffled, once; nulls count as nothing, candidates without a role asked for
    have no row.
    """
    words, pairs = ROLE_WORDS if words is None else words, ROLE_PAIRS if pairs is None else pairs
    places = path_bonus(F.col("path")) if places is None else places
    own = F.array_distinct(identifier_words(F.coalesce("symbol", F.lit(""))))
    wanted = F.filter(F.array_distinct("roles"), lambda r: r.isin(roles))
    rows = candidates.withColumn("__words", own).withColumn("__wanted", wanted).where(F.size("__wanted") > 0)
    none = F.array().cast("array<string>")
    asked = terms.where("term is not null").select(*scope, "weight", F.explode(F.array(F.struct(F.lit("t").alias("how"), F.col("term").alias("key")), F.struct(F.lit("s").alias("how"), stem_key(F.lower(F.trim("term"))).alias("key")))).alias("at"))
    asked = asked.where("at.key is not null").groupBy(*scope, "at").agg(F.sum("weight").alias("weight")).groupBy(*scope).agg(F.map_from_entries(F.collect_list(F.struct(F.concat("at.how", "at.key"), "weight"))).alias("__asked"))
    said = lambda how, keys: F.aggregate(F.filter(F.transform(keys, lambda k: F.element_at("__asked", F.concat(F.lit(how), k)).cast("long")), lambda w: w.isNotNull()), F.lit(0).cast("long"), lambda n, w: n + w)
    met = F.when(F.col("__asked").isNull(), F.lit(0)).otherwise(
        said("t", F.array_distinct(F.coalesce("terms", none))) * TERM + F.least(said("s", F.transform("__words", lambda w: stem_key(w))) * ALIKE, F.lit(MOST_ALIKE))
    )
    depth = F.length("path") - F.length(F.replace("path", F.lit("/")))
    of_role = F.coalesce(*(F.when(F.col("role") == r, _word_points(F.col("__words"), words.get(r, []), pairs.get(r, [])) + places.get(r, F.lit(0))) for r in roles), F.lit(0))
    of_profile = F.lit(0)
    for (role, name), (points, of) in PROFILE_WORDS.items() if profile else ():
        of_profile = of_profile + F.when((F.col("role") == role) & (F.col(profile) == name) & F.arrays_overlap("__words", F.array(*map(F.lit, of))), points).otherwise(0)
    score = F.coalesce("base", F.lit(0)) - F.coalesce(depth, F.lit(0)) * DEPTH + met + F.when(F.col("complete"), COMPLETE).otherwise(0) + of_role + of_profile
    out = rows.join(asked, scope, "left").withColumn("role", F.explode("__wanted")).withColumn("score", score.cast("long"))
    return out.drop("__words", "__wanted", "__asked")
