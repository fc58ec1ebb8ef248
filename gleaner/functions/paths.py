"""Column expressions over repository paths: parts, classes and predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path vocabulary, extensions and priorities that users' rules and results depend on.
GENERATED_DIRS = ["generated", "gen"]
FIXTURE_DIRS = ["testdata", "fixture", "fixtures", "golden", "mock", "mocks", "fake", "fakes", "stub", "stubs", "testutil", "testingutil"]
PLAYGROUND_WORDS = ["playground", "preview", "evaluator", "evaluation", "eval"]
EXAMPLE_DIRS = ["example", "examples", "_examples", "sample", "samples", "demo", "demos"]
EXPERIMENT_DIRS = ["experiment", "experiments", "experimental", "prototype", "prototypes", "lab", "labs"]
TOOLING_DIRS = ["script", "scripts"]
HISTORY_DIRS = ["archive", "archives", "history", "historical", "decisions", "decision", "adr", "adrs"]
DOCUMENT_EXTENSIONS = [".md", ".markdown", ".mdx", ".rst", ".adoc", ".asciidoc", ".drawio"]
DOCUMENT_NAMES = ["readme", "contributing", "changelog", "architecture", "design"]
MAIN_NAMES = ["main.go", "main.py", "__main__.py", "cli.py"]
API_DIRS = ["api", "public", "sdk", "client"]
EFFECT_DIRS = ["backend", "backends", "storage", "store", "stores", "database", "db", "transport", "network", "output", "outputs", "sink", "sinks", "writer", "writers", "persistence", "replica", "replication", "remote"]
EFFECT_WORDS = ["backend", "database", "persist", "transport", "network", "client", "writer", "output"]
SOURCE_EXTENSIONS = [".go", ".py", ".pyi", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".java", ".rs", ".c", ".h", ".cc", ".cpp", ".cxx", ".hh", ".hpp", ".hxx"]
SKIPPED_DIRS = [".git/", ".github/", "vendor/", "node_modules/", "dist/", "build/", "coverage/"]
BINARY_EXTENSIONS = [".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".bmp", ".svg", ".zip", ".tar", ".gz", ".tgz", ".7z", ".rar"]
SECRET_EXTENSIONS = [".key", ".pem", ".crt", ".cer"]
ROLE_PRIORITY = {
    "primary_production_entry": 120,
    "effect_integration_boundary": 115,
    "public_api": 110,
    "production_core": 100,
    "current_documentation": 90,
    "experimental": 45,
    "tooling": 40,
    "example": 35,
    "historical_decision_documentation": 30,
    "playground_preview_evaluator": 20,
    "test": 15,
    "fixture": 10,
    "generated": 5,
}
PRODUCTION_ROLES = ["primary_production_entry", "production_core", "effect_integration_boundary", "public_api"]
LANGUAGES = {
    ".go": "Go", ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".jsx": "JavaScript", ".java": "Java", ".rs": "Rust", ".c": "C", ".h": "C/C++ Header",
    ".cpp": "C++", ".cc": "C++", ".rb": "Ruby", ".php": "PHP", ".sh": "Shell", ".yaml": "YAML", ".yml": "YAML", ".json": "JSON", ".md": "Markdown", ".proto": "Protocol Buffers",
}


def clean(path: Column) -> Column:
    """Forward slashes, no repeated, leading or trailing ones."""
    return F.regexp_replace(F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "/+", "/"), "^/|/$", "")


def segments(path: Column) -> Column:
    return F.split(path, "/")


def base_name(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot, empty without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def has_segment(path: Column, names: list[str]) -> Column:
    return F.arrays_overlap(segments(path), F.array(*map(F.lit, names)))


def has_word(path: Column, words: list[str], marks: str = "/_.-") -> Column:
    """Whether a word of the path, cut at any of the marks, is among `words`."""
    return F.arrays_overlap(F.split(path, "[" + marks.replace("-", r"\-") + "]+"), F.array(*map(F.lit, words)))


def artifact_role(path: Column, hints: dict[str, Column] | None = None) -> Column:
    """One of thirteen roles by ordered path rules; hints (generated, test, documentation, primary_entry,
    public_api, effect_boundary) are boolean columns that never beat an earlier path rule."""
    hint = lambda k: F.coalesce(hints[k], F.lit(False)) if hints and k in hints else F.lit(False)
    low = F.lower(clean(path))
    base, stem = base_name(low), F.regexp_replace(base_name(low), r"\.[^.]*$", "")
    generated = base.rlike(r"\.pb\.go$|\.pb\.gw\.go$|^zz_generated") | has_segment(low, GENERATED_DIRS)
    test = base.rlike(r"_test\.go$|^test_|_test\.py$") | F.concat(F.lit("/"), low, F.lit("/")).rlike("/(test|tests|testing|[^/]*-test|[^/]*_test)/")
    document = extension(low).isin(DOCUMENT_EXTENSIONS) | base.isin(DOCUMENT_NAMES)
    history = has_segment(low, HISTORY_DIRS) | stem.rlike("^(decision-|adr-)") | stem.rlike("^[0-9].{3}")
    entry = base.isin(MAIN_NAMES) | low.rlike("(^|/)(cmd|bin)/")
    effect = has_segment(low, EFFECT_DIRS) | has_word(low, EFFECT_WORDS)
    return (
        F.when(hint("generated") | generated, "generated")
        .when(has_segment(low, FIXTURE_DIRS), "fixture")
        .when(hint("test") | test, "test")
        .when(has_word(low, PLAYGROUND_WORDS), "playground_preview_evaluator")
        .when(has_segment(low, EXAMPLE_DIRS), "example")
        .when(has_segment(low, EXPERIMENT_DIRS), "experimental")
        .when(has_segment(low, TOOLING_DIRS), "tooling")
        .when(hint("documentation") | document, F.when(history, "historical_decision_documentation").otherwise("current_documentation"))
        .when(hint("primary_entry") | entry, "primary_production_entry")
        .when(hint("public_api") | has_segment(low, API_DIRS), "public_api")
        .when(hint("effect_boundary") | effect, "effect_integration_boundary")
        .otherwise("production_core")
    )


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def role_priority(role: Column) -> Column:
    return F.coalesce(F.element_at(_map(ROLE_PRIORITY), role), F.lit(0))


def is_production(role: Column) -> Column:
    return role.isin(PRODUCTION_ROLES)


def is_source(path: Column) -> Column:
    return extension(path).isin(SOURCE_EXTENSIONS)


def is_document(path: Column) -> Column:
    return extension(path).isin(DOCUMENT_EXTENSIONS) | F.lower(base_name(path)).isin(DOCUMENT_NAMES)


def language(path: Column) -> Column:
    """Language by extension; null where unknown."""
    return F.element_at(_map(LANGUAGES), extension(path))


def skip_reason(path: Column) -> Column:
    """Why a path stays out of a corpus, null if it doesn't: env, directory, binary or secret."""
    low = F.lower(clean(path))
    return (
        F.when(low.rlike(r"(^|/)\.env"), "env")
        .when(low.rlike("(^|/)(" + "|".join(d.replace(".", r"\.") for d in SKIPPED_DIRS) + ")"), "directory")
        .when(extension(low).isin(BINARY_EXTENSIONS), "binary")
        .when(extension(low).isin(SECRET_EXTENSIONS), "secret")
    )


def path_family(path: Column) -> Column:
    """First directory that says something: internal and pkg are passed over."""
    parts = segments(F.regexp_replace(path, r"^(\./|/)", ""))
    inner = F.element_at(parts, 1).isin("internal", "pkg") & (F.size(parts) > 1)
    return F.when(inner, F.element_at(parts, 2)).otherwise(F.element_at(parts, 1))


def import_family(path: Column) -> Column:
    """Three segments of an import that starts with a host, else its first."""
    parts = segments(F.trim(path))
    return F.when(F.contains(F.element_at(parts, 1), F.lit(".")), F.array_join(F.slice(parts, 1, 3), "/")).otherwise(F.element_at(parts, 1))


def is_hosted(path: Column) -> Column:
    """Whether an import's first segment names a host: the first half of the external-import test."""
    return F.contains(F.element_at(segments(F.trim(path)), 1), F.lit("."))


def path_tier(path: Column) -> Column:
    """0 production source, 1 other, 2 examples and tools, 3 tests and fixtures, 4 generated."""
    role = artifact_role(path)
    return F.when(is_production(role), 0).when(role == "generated", 4).when(role.isin("test", "fixture"), 3).when(role.isin("example", "tooling", "experimental", "playground_preview_evaluator"), 2).otherwise(1)


def is_safe_path(path: Column) -> Column:
    """Relative, clean, and free of control characters and of steps upwards."""
    return (
        (F.length(path) > 0) & ~path.rlike(r"[\x00-\x1f\x7f\\]") & ~path.rlike("^/|/$|//") & ~F.concat(F.lit("/"), path, F.lit("/")).rlike(r"/\.{1,2}/")
    )


def directory_distance(a: Column, b: Column) -> Column:
    """Steps up and down between the directories of two paths."""
    x, y = (F.slice(segments(p), 1, F.size(segments(p)) - 1) for p in (a, b))
    pairs = F.arrays_zip(x.alias("x"), y.alias("y"))
    shared = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, p: F.struct((s["n"] + F.when(s["on"] & p["x"].eqNullSafe(p["y"]), 1).otherwise(0)).alias("n"), (s["on"] & p["x"].eqNullSafe(p["y"])).alias("on")),
    )["n"]
    return F.size(x) + F.size(y) - 2 * shared


def depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(segments(path)))
