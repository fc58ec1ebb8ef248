"""Column expressions over text, names and keys."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered rules that name what a task asks for.
TASK_RULES = [
    ("extension", ["add support", "new integration"], ["adapter", "adaptor", "contribution", "extension"], []),
    ("compatibility", ["version mismatch", "older specification", "dependency import", "no longer renders"], [], ["compatib"]),
    ("configuration", ["config field"], ["configuration", "setting", "option"], []),
    ("bug", ["wrong status", "incorrect status", "silently ignored"], ["panic", "bug", "fails", "failure", "nil"], []),
    ("operational", [], ["release", "deploy", "operational", "script"], []),
    ("feature", [], ["implement", "feature"], []),
]


def digest_of(*parts: Column) -> Column:
    """SHA-256 in hex over parts joined by a NUL, the identity of a composite key."""
    return F.sha2(F.concat_ws("\u0000", *parts), 256)


def set_digest(members: Column) -> Column:
    """Identity of a set of strings, whatever their order and repetition."""
    return F.sha2(F.concat_ws("\u0000", F.array_sort(F.array_distinct(members))), 256)


def slug(text: Column, prefix: str = "flow-") -> Column:
    """Lower-case words joined by dashes; a hash of the text where no word is left."""
    words = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(words == "", F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, 12))).otherwise(words)


def squeeze(text: Column, limit: int | None = None) -> Column:
    """White space runs as one blank, ends trimmed, cut to `limit` characters with an ellipsis."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    return one if limit is None else F.when(F.length(one) > limit, F.concat(F.substring(one, 1, limit - 3), F.lit("..."))).otherwise(one)


def identifier_words(name: Column) -> Column:
    """Lower-case words of an identifier: marks and every capital start one, so acronyms become letters."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{Nd}]+", " "), r"(?<=[\p{L}\p{Nd}])(\p{Lu})", " $1")
    return F.filter(F.split(F.lower(spaced), " "), lambda w: w != "")


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "(?<=[a-z0-9])([A-Z])", "_$1"))


def stem(word: Column) -> Column:
    """Light English stem: ies, ing, ed and s endings."""
    n = F.length(word)
    without = lambda suffix: F.regexp_replace(word, suffix + "$", "")
    return (
        F.when((n > 5) & word.endswith("ies"), F.concat(without("ies"), F.lit("y")))
        .when((n > 5) & word.endswith("ing"), without("ing"))
        .when((n > 4) & word.endswith("ed"), without("d"))
        .when((n > 3) & word.endswith("s") & ~word.endswith("ss"), without("s"))
        .otherwise(word)
    )


def variants(word: Column) -> Column:
    """The word, its stem and its plural, -e and -ed forms, distinct, in that order."""
    n = F.length(word)
    without = lambda suffix: F.regexp_replace(word, suffix + "$", "")
    options = F.array(
        word,
        stem(word),
        F.when((n > 4) & word.endswith("e"), without("e")),
        F.when((n > 4) & word.endswith("ed"), without("ed")),
        F.when((n > 4) & word.endswith("ed"), F.concat(without("ed"), F.lit("e"))),
        F.when((n > 3) & word.endswith("y"), F.concat(without("y"), F.lit("ies"))),
        F.when((n > 3) & ~word.endswith("s"), F.concat(word, F.lit("s"))),
    )
    return F.array_distinct(F.array_compact(options))


def task_kind(text: Column) -> Column:
    """What a task asks for, by ordered word, phrase and prefix rules; `unknown` if none holds."""
    padded = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}_]+", " ")), F.lit(" "))
    kind = F.lit("unknown")
    for name, phrases, words, prefixes in reversed(TASK_RULES):
        found = [F.contains(padded, F.lit(f" {p} ")) for p in phrases + words] + [F.contains(padded, F.lit(f" {p}")) for p in prefixes]
        rule = found[0]
        for f in found[1:]:
            rule = rule | f
        kind = F.when(rule, name).otherwise(kind)
    return kind


def endpoint(url: Column) -> Column:
    """A URL in one spelling: lower-case scheme and host, no default port, query in order, no fragment."""
    scheme, host = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lower(F.try_parse_url(url, F.lit("AUTHORITY")))
    port = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    query = F.array_join(F.array_sort(F.split(F.try_parse_url(url, F.lit("QUERY")), "&")), "&")
    return F.concat(scheme, F.lit("://"), port, path, F.coalesce(F.concat(F.lit("?"), query), F.lit("")))


def redact(text: Column) -> Column:
    """Secrets replaced: values of sensitive keys, bearer tokens and well-known token shapes."""
    out = F.regexp_replace(text, r"(?i)\b(api[_-]?key|token|secret|password|passwd)(\s*[:=]\s*\"?)[A-Za-z0-9_\-./+]{8,}", "$1$2[redacted]")
    out = F.regexp_replace(out, r"(?i)\bbearer\s+[A-Za-z0-9_\-.=]{8,}", "Bearer [redacted]")
    return F.regexp_replace(out, r"\b(ghp_|sk-|AKIA)[A-Za-z0-9]{10,}", "[redacted]")


SECRETS = r"(?i)\b(api[_-]?key|token|secret|password|passwd)(\s*[:=]\s*\"?)[A-Za-z0-9_\-./+]{8,}|\bbearer\s+[A-Za-z0-9_\-.=]{8,}|\b(ghp_|sk-|akia)[A-Za-z0-9]{10,}"


def secret_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SECRETS))


def holds_all(text: Column, fragments: Column) -> Column:
    """Whether every fragment is in the text, whatever the case."""
    return F.forall(fragments, lambda f: F.contains(F.lower(text), F.lower(f)))


def go_boundaries(pattern: str) -> str:
    r"""A pattern whose \b means the edge of [0-9A-Za-z_] in Java's engine as it does in RE2."""
    return pattern.replace(r"\b", r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))")


def required_literals(pattern: str) -> list[str]:
    """Strings of which every match of the pattern holds at least one; empty if none can be told.

    Read off plain runs and groups of plain alternatives at the top level, the longest of them.
    """
    best: list[str] = []
    run, k = "", 0

    def offer(options: list[str]) -> None:
        nonlocal best
        if options and min(map(len, options)) > min(map(len, best), default=0):
            best = options

    while k < len(pattern):
        c, optional = pattern[k], False
        if c == "|":
            return []
        if c == "(":
            depth, end = 0, k
            while True:
                end += {"\\": 1}.get(pattern[end], 0)
                depth += {"(": 1, ")": -1}.get(pattern[end], 0)
                if depth == 0:
                    break
                end += 1
            inner, k = pattern[k + 1 : end], end + 1
            optional = pattern[k : k + 1] in ("?", "*")
            offer([run])
            run = ""
            if not optional and re.fullmatch(r"[\w/ |]+", inner):
                offer(inner.split("|"))
            elif not optional and not inner.startswith("?"):
                offer(required_literals(inner))
            continue
        if c == "[":
            k = pattern.index("]", k + 2) + 1
            offer([run])
            run = ""
            continue
        if c == "\\":
            c, k = ("" if pattern[k + 1].isalnum() else pattern[k + 1]), k + 1
        elif c in ".^$?*+{":
            k = pattern.index("}", k) + 1 if c == "{" else k + 1
            offer([run])
            run = ""
            continue
        k += 1
        optional = pattern[k : k + 1] in ("?", "*", "{")
        if c and not optional:
            run += c
        elif pattern[k - 1] != "b" or not c == "":
            offer([run])
            run = ""
    offer([run])
    return [b for b in best if b]


def holds_any(text: Column, options: list[str]) -> Column:
    """Whether the text holds one of the strings; true for none."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(o)) for o in options)) if options else F.lit(True)
