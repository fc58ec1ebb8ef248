"""Labels and scores from counted facts: ordered rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of anchors that stand for one pillar of a repository's architecture each.
PILLARS = [
    ["command_dispatch"],
    ["config_ingress", "config_adapter", "config_apply"],
    ["registry_write", "registry_lookup", "extension_family"],
    ["lifecycle_interface", "lifecycle_start"],
    ["admin_control_plane"],
    ["request_dispatch_root", "application_data_plane"],
    ["tls_or_security_boundary"],
]
#: What confidence may reach at most while this evidence is missing.
CAPS = {"execution": 0.3, "entrypoint": 0.3, "dispatch": 0.3, "core_call": 0.5, "context": 0.6}


def entry_kind(package: Column, module: Column) -> Column:
    """Kind of an entrypoint by its package's and its module's directory: the first rule that holds."""
    low = F.lower(package)
    top = F.split(low, "/")[0]
    return (
        F.when((module == "server") | (package == "server"), "primary_binary")
        .when(F.contains(low, F.lit("ctl")), "cli")
        .when((top == "tools") | F.startswith(module, F.lit("tools/")), "tool")
        .when((top == "contrib") | F.contains(low, F.lit("example")), "example")
        .when((top == "tests") | F.contains(low, F.lit("/test-template/")), "test_binary")
        .otherwise("unknown")
    )


def module_role(module: Column) -> Column:
    """Likely role of a module by its directory."""
    return (
        F.when(module == "server", "server_runtime")
        .when(F.contains(module, F.lit("client")), "client_library")
        .when(module == "api", "api_definitions")
        .when(module == "tests", "tests")
        .when(F.startswith(module, F.lit("tools")), "tools")
        .when(module == "pkg", "shared_library")
        .when(module == ".", "repository_root")
        .otherwise("unknown")
    )


def pillars(kinds: Column) -> Column:
    """How many pillars an array of anchor kinds shows."""
    return sum((F.arrays_overlap(kinds, F.array(*map(F.lit, of)))).cast("int") for of in PILLARS)


def grounding_mode(kinds: Column, reachable: Column) -> Column:
    entry = F.array_contains(kinds, "process_entry")
    return F.when(entry & (pillars(reachable) >= 4), "behavior_grounded").when(entry & (pillars(kinds) >= 2), "mixed").otherwise("package_landscape")


def archetype(kinds: Column, entries: Column, auxiliary_only: Column, library: Column, workers: Column, async_tasks: Column) -> Column:
    """Struct (archetype, evidence, alternatives) of a repository's aggregates: the first rule that holds."""
    has = lambda *names: F.arrays_overlap(kinds, F.array(*map(F.lit, names)))
    rules = [
        (auxiliary_only & library, "library_framework", "only auxiliary entrypoints beside a library", ["application"]),
        (has("registry_write", "extension_family") & has("request_dispatch_root", "admin_control_plane"), "modular_platform_server", "registry and server anchors", ["application"]),
        ((workers > 0) | (async_tasks > 1), "daemon_worker_system", "worker registrations", ["application"]),
        (has("command_dispatch") & ~has("request_dispatch_root"), "cli_tool", "command dispatch anchors", ["application"]),
        (entries == 0, "library_framework", "no entrypoint", []),
        (entries > 3, "monorepo_mixed", "several entrypoints", ["application"]),
    ]
    made = lambda name, why, other: F.struct(F.lit(name).alias("archetype"), F.lit(why).alias("evidence"), F.array(*map(F.lit, other)).cast("array<string>").alias("alternatives"))
    out = made("application", "entrypoints", ["cli_tool", "daemon_worker_system"])
    for holds, name, why, other in reversed(rules):
        out = F.when(holds, made(name, why, other)).otherwise(out)
    return out


def capped_confidence(confidence: Column, missing: dict[str, Column]) -> Column:
    """Struct (confidence, cap, missing, status, capped): confidence cut to the least cap of what is missing."""
    cap = F.least(F.lit(1.0), *(F.when(m, CAPS[name]).otherwise(1.0) for name, m in missing.items()))
    names = F.array_compact(F.array(*(F.when(m, name) for name, m in missing.items())))
    return F.struct(
        F.least(confidence, cap).alias("confidence"), cap.alias("cap"), names.alias("missing"), F.when(F.size(names) > 0, "partial").otherwise("verified").alias("status"), (confidence > cap).alias("capped")
    )


def signal_sum(signals: list[tuple[Column, str, int]]) -> Column:
    """Struct (score, reasons) of the signals (condition, reason, score) that hold."""
    holds = [F.coalesce(c, F.lit(False)) for c, _, _ in signals]
    score = sum((F.when(h, s).otherwise(0) for h, (_, _, s) in zip(holds, signals, strict=True)), F.lit(0))
    return F.struct(score.alias("score"), F.array_compact(F.array(*(F.when(h, r) for h, (_, r, _) in zip(holds, signals, strict=True)))).alias("reasons"))


def primary_score(steps: Column, purpose: Column, areas: Column, effect: Column, files: Column) -> Column:
    """Additive score with clipped terms."""
    return F.least(steps, F.lit(6)) + F.when(purpose, 8).otherwise(0) + 3 * F.least(areas, F.lit(3)) + F.when(effect, 5).otherwise(0) + F.least(files, F.lit(4))


def locality(kind: Column, anchors: Column, strong: Column, relations: Column, cue: Column, grounded: Column) -> Column:
    """How local a task is: by kind, the anchors kept, strong terms found, relations, cue words, and whether a
    strong term stands on an anchor of the role that owns it."""
    return (
        F.when(anchors == 0, "broad_dynamic")
        .when(kind == "extension", "extension")
        .when(kind.isin("configuration", "compatibility") & grounded, "local_exact")
        .when((strong >= 1) & (anchors <= 8) & cue, "local_exact")
        .when((anchors >= 3) & ((strong >= 1) | (relations > 0)), "bounded_cross_file")
        .otherwise("broad_dynamic")
    )


def path_match_score(path: Column, term: Column, test: Column) -> Column:
    """Score of a path for a lower-case term: shallow paths, paths that hold it, and tests a little."""
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return 40 - slashes * 4 + F.when(F.contains(F.lower(path), term), 40).otherwise(0) + F.when(test, 2).otherwise(0)


def line_match_facts(line: Column) -> tuple[Column, Column]:
    """(words, comment): the words that a line declares something by (none, if it declares nothing), and whether it is a comment."""
    text = F.trim(line)
    words = F.when(text.rlike("^(func|type|var|const) "), F.split(F.lower(text), "[^a-z0-9_]+")).otherwise(F.array().cast("array<string>"))
    return words, F.startswith(text, F.lit("//")) | F.startswith(text, F.lit("#"))


def line_match_points(path: Column, term: Column, hits: Column, test: Column, named: Column, comment: Column) -> Column:
    """line_match_score() of a line by its facts: whether the term is one of its words, and whether it is a comment."""
    return path_match_score(path, term, test) + F.least(hits, F.lit(8)) * 3 + F.when(named, 24).otherwise(0) - F.when(comment, 4).otherwise(0)


def line_match_score(path: Column, line: Column, term: Column, hits: Column, test: Column) -> Column:
    """Score of a line that holds the term: that of its path, of the path's hits, of declarations, less for comments."""
    words, comment = line_match_facts(line)
    return line_match_points(path, term, hits, test, F.array_contains(words, term), comment)


def operational_kind(path: Column) -> Column:
    """Kind of operational evidence by file name, or null."""
    low = F.lower(path)
    base = F.element_at(F.split(low, "/"), -1)
    root = ~F.contains(path, F.lit("/"))
    return (
        F.when(root & base.isin("readme", "readme.md", "readme.rst", "readme.adoc", "contributing", "contributing.md", "contributing.rst"), "markdown")
        .when(base.isin("makefile", "gnumakefile"), "makefile")
        .when(base.isin("taskfile.yml", "taskfile.yaml"), "taskfile")
        .when(base == "justfile", "justfile")
        .when(base == "package.json", "package_json")
        .when(base.rlike(r"^\.?env[._-]?(example|sample|template)$"), "environment")
    )


#: Fixed patterns: local endpoints, log paths, placeholders.
ENDPOINT = r"https?://(?:localhost|127\.0\.0\.1)(?::[0-9]{1,5})?(?:/[^\s\])}>\"']*)?"
LOG_PATH = r"(?:/|\.\.?/)[A-Za-z0-9_.~/-]+\.log\b"
PLACEHOLDER = r"<[^>]+>|\$\{?[A-Za-z_][A-Za-z0-9_]*\}?"


#: Fixed words that carry no meaning of their own in names of components.
COMMON_WORDS = ["and", "api", "core", "engine", "flow", "for", "framework", "layer", "management", "module", "operations", "request", "service", "system", "the", "tool"]


def semantic_tokens(text: Column) -> Column:
    """Distinct lower-case words of three characters or more, in order, without common ones."""
    words = F.split(F.lower(text), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(COMMON_WORDS)))


def shared_tokens(left: Column, right: Column) -> Column:
    return F.size(F.array_intersect(left, right))


def path_term_score(path: Column, terms: Column) -> Column:
    """One for each term that a segment of the path holds, and one more if it is the file's own name."""
    segments = F.split(F.lower(path), "[^a-z0-9]+")
    base = F.regexp_replace(F.element_at(F.split(F.lower(path), "/"), -1), "[.][^.]*$", "")
    held = lambda term: F.exists(segments, lambda s: (s == term) | ((F.length(term) >= 3) & F.contains(s, term)))
    each = F.transform(terms, lambda t: F.when(held(t), F.when(base == t, 2).otherwise(1)).otherwise(0))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def layered_score(path: Column, terms: Column, seed: Column, legacy: list[str]) -> Column:
    """Struct (score, reasons) of a path for terms: seeds before all; then the first rule of each layer that holds."""
    low = F.lower(path)
    base = F.element_at(F.split(low, "/"), -1)
    stem = F.regexp_replace(base, "[.][^.]*$", "")
    words = lambda of: F.split(of, "[^a-z0-9]+")
    folders = F.slice(F.split(low, "/"), F.lit(1), F.greatest(F.size(F.split(low, "/")) - 1, F.lit(0)))
    long = F.filter(terms, lambda t: F.length(t) >= 3)
    rules = [
        (F.exists(terms, lambda t: (t == stem) | (t == base)), "exact_base", 100),
        (F.arrays_overlap(long, words(base)), "base_word", 70),
        (F.arrays_overlap(long, folders), "folder", 60),
        (F.exists(F.array(*map(F.lit, legacy)), lambda w: F.contains(low, w)), "legacy", -100),
        (F.contains(low, F.lit("patch/")) | F.contains(low, F.lit("diff/")), "patch", -20),
    ]
    own = signal_sum(rules)
    return F.when(seed, F.struct(F.lit(200).alias("score"), F.array(F.lit("seed")).alias("reasons"))).otherwise(own)


def surface_quality(kind: Column, exact: Column, available: Column, dependency: Column, identity: Column, registration: Column, handler: Column, static: Column) -> Column:
    """Struct (role, readiness) of a runtime surface from its quality dimensions: the first rule that holds."""
    made = lambda role, readiness: F.struct(F.lit(role).alias("role"), F.lit(readiness).alias("readiness"))
    whole = identity & registration & handler & static & exact
    return (
        F.when((kind == "process_entry") & exact, made("entry_surface", "partial"))
        .when(~available, made("rejected", "rejected"))
        .when(dependency, made("noisy", "unsupported"))
        .when((kind == "cli_command") & whole, made("entry_surface", "ready"))
        .when(kind == "cli_command", made("entry_surface", "partial"))
        .when((kind == "http_route") & whole, made("entry_surface", "ready"))
        .when((kind == "http_route") & identity & registration, made("entry_surface", "partial"))
        .when(kind == "http_route", made("dynamic_frontier", "unsupported"))
        .when((kind == "http_server") & registration, made("entry_surface", "partial"))
        .when(kind == "http_server", made("entry_surface", "unsupported"))
        .when(identity & registration, made("descriptor", "partial"))
        .otherwise(made("dynamic_frontier", "unsupported"))
    )


def candidate_path_score(path: Column, receiver_file: Column, method: Column, question: Column, saved: Column) -> Column:
    """Score of a file for a call: named after the receiver, words of its name that the method or the question has, read before."""
    base = F.element_at(F.split(F.lower(path), "/"), -1)
    words = F.array_distinct(F.split(base, "[^a-z0-9]+"))
    return F.when(base == receiver_file, 100).otherwise(0) + 20 * F.size(F.array_intersect(words, method)) + 4 * F.size(F.array_intersect(words, question)) + F.when(saved, 8).otherwise(0)
