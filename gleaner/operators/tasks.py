"""Retrieval for tasks told in prose: their terms, the files that may matter, and the lines to start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import labels as L
from gleaner.functions import paths as P
from gleaner.functions.text import identifier_words, task_kind
from gleaner.operators.ranking import top_k
from gleaner.operators.sets import parts_of, settle

#: Fixed words that say nothing about a task.
STOP_WORDS = [
    "about", "after", "also", "and", "before", "behavior", "both", "can", "code", "could", "create", "determine", "does", "exact", "explain", "fails",
    "file", "find", "from", "have", "into", "likely", "minimal", "identify", "inspect", "more", "only", "other", "paths", "produce", "propose", "repository",
    "should", "similar", "smallest", "source", "such", "task", "that", "their", "then", "the", "this", "through", "using", "when", "where", "which", "while",
    "whose", "with", "without", "would", "verify", "verification", "user",
]
#: Fixed patterns: quoted terms, words, what is trimmed from them, and the marks of code in them.
QUOTED, WORD = r"`([^`\r\n]{1,160})`", r"[\p{L}\p{N}_][\p{L}\p{N}_.:/-]*"
TRIM = "`'\".,;:()[]{}<>"
#: Fixed weights: quoted terms and their parts, code-like words, capitalised words, others, and the parts of words.
IN_QUOTES, QUOTED_PART, CODE, CAPITAL, PLAIN, CODE_PART, PART = 16, 8, 10, 4, 2, 8, 3
#: Fixed values of a file's score: a term in its path, in its text, a line of it, as many at most, a declaration.
IN_PATH, IN_TEXT, LINE, LINES, DECLARED = 5, 8, 2, 6, 12


def _trimmed(word: Column) -> Column:
    return F.btrim(F.trim(word), F.lit(TRIM))


def _capital(word: Column) -> Column:
    return word.rlike(r"^\p{Lu}.*\p{Ll}") & (F.length(word) >= 3)


def _parts(word: Column) -> Column:
    """The runs of letters and digits of a word, each once whatever its case, unless it is the word itself."""
    runs = F.filter(F.regexp_extract_all(word, F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)), lambda p: p != word)
    low = F.transform(runs, lambda p: F.lower(p))
    return F.filter(runs, lambda p, k: F.array_position(low, F.lower(p)) == k + 1)


def _told(raw: Column, weight: Column | int) -> Column:
    return F.struct(raw.alias("raw"), (F.lit(weight) if isinstance(weight, int) else weight).alias("weight"))


def task_terms(tasks: DataFrame, task: str, text: str, most: int = 32) -> DataFrame:
    """(task, term, text, weight, times, position): the terms of a task's text, strongest first, `most` of them.

    Quoted terms, code-like words (an inner capital, or one of _ . /), capitalised ones and plain ones weigh as the fixed
    weights say, and so do the runs of letters and digits inside them; a run in a word with marks of code counts more if
    it has five letters or looks like a name.  A term takes its best weight, and its spelling there.  Terms of less than
    three bytes or more than 96 and STOP_WORDS are none.  Repetition adds 2 (4 from weight 4 on) a time up to 8, unless the term
    weighs 8 already.  Order: weight, times, first place, term.  Null texts have no terms.
    """
    quoted = F.transform(F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1)), lambda q: F.concat(F.array(_told(q, IN_QUOTES)), F.transform(_parts(q), lambda p: _told(p, QUOTED_PART))))
    clean = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), _trimmed)

    def of_word(w: Column) -> Column:
        weight = F.when(w.rlike(r"\p{Ll}\p{Lu}|[_./]"), CODE).when(_capital(w), CAPITAL).otherwise(PLAIN)
        marked = w.rlike(r"[_./:\[\](){}<>*-]")
        strong = lambda p: (F.length(p) >= 5) | p.rlike(r"\p{Ll}\p{Lu}") | _capital(p)
        return F.concat(F.array(_told(w, weight)), F.transform(_parts(w), lambda p: _told(p, F.when(marked & strong(p), CODE_PART).otherwise(PART))))

    told = tasks.select(task, F.posexplode(F.concat(F.flatten(quoted), F.flatten(F.transform(clean, of_word)))).alias("pos", "__t"))
    told = told.select(task, "pos", _trimmed(F.col("__t.raw")).alias("raw"), "__t.weight").withColumn("term", F.lower("raw"))
    kept = told.where(F.octet_length("term").between(3, 96) & ~F.col("term").isin(STOP_WORDS))
    once = kept.groupBy(task, "term").agg(F.max("weight").alias("w"), F.count("*").alias("times"), F.min("pos").alias("pos"), F.max_by("raw", F.struct("weight", -F.col("pos"))).alias("text"))
    more = (F.col("times") - 1) * F.when(F.col("w") >= 4, 4).otherwise(2)
    weight = F.when((F.col("times") > 1) & (F.col("w") < 8), F.least(F.lit(8), F.col("w") + more)).otherwise(F.col("w"))
    order = [F.desc("weight"), F.desc("times"), F.col("pos"), F.col("term")]
    return top_k(once.select(task, "term", "text", weight.cast("int").alias("weight"), "times", "pos"), [task], order, most, "position").drop("pos")


def line_words(line: Column) -> Column:
    """Lower-cased words of a line, as task_terms cuts them, and their parts, each once."""
    clean = F.transform(F.regexp_extract_all(line, F.lit(WORD), F.lit(0)), _trimmed)
    return F.array_distinct(F.transform(F.concat(clean, F.flatten(F.transform(clean, _parts))), lambda w: F.lower(w)))


def declares(line: Column) -> Column:
    return F.trim(line).rlike("^(func|type|var|const) ")


def term_lines(files: DataFrame, terms: DataFrame, file: str, text: str) -> DataFrame:
    """(file, term, line, declared, named, comment): lines (from 1) that have a term of any task as a word or a part of
    one, whether they declare it (as a word of an identifier, or by its very name), and whether they are comments.

    Lines keep only words that some task asks for before anything is shuffled; their text goes with none of them, as
    a long line has many words.
    """
    asked = settle(terms.select("term").distinct())
    lines = files.select(file, F.posexplode(F.split(text, "\n")).alias("at", "said"))
    names, comment = L.line_match_facts(F.col("said"))
    owns = F.when(declares(F.col("said")), identifier_words(F.col("said"))).otherwise(F.array().cast("array<string>"))
    facts = lines.select(file, (F.col("at") + 1).alias("line"), comment.alias("comment"), line_words(F.col("said")).alias("__w"), owns.alias("__o"), names.alias("__n"))
    own, other = F.array_intersect("__w", "__o"), F.array_except("__w", "__o")
    of = lambda words, declared, named: F.transform(words, lambda w: F.struct(w.alias("term"), F.lit(declared).alias("declared"), F.lit(named).alias("named")))
    each = F.concat(of(F.array_intersect(own, "__n"), True, True), of(F.array_except(own, "__n"), True, False), of(F.array_intersect(other, "__n"), False, True), of(F.array_except(other, "__n"), False, False))
    return facts.select(file, "line", "comment", F.explode(each).alias("__t")).select(file, "__t.term", "line", "__t.declared", "__t.named", "comment").join(asked, "term", "left_semi").select(file, "term", "line", "declared", "named", "comment")


def _path_hits(files: DataFrame, terms: DataFrame, file: str, path: str) -> DataFrame:
    """(file, term), maybe repeated: paths that hold a term, met on the term's rarest three letters; shorter terms meet none.

    Those letters are settled, so that paths whose letters are no term's rarest go before anything is shuffled.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda k: F.substring(c, k, F.lit(3))))
    asked = terms.select("term").distinct().where("length(term) >= 3").select("term", F.explode(grams(F.col("term"))).alias("g"))
    low = files.select(file, F.lower(path).alias("__p")).where("length(__p) >= 3")
    held = low.select(file, "__p", F.explode(grams(F.col("__p"))).alias("g")).join(asked.select("g").distinct(), "g", "left_semi")
    often = held.groupBy("g").agg(F.count("*").alias("n"))
    rarest = settle(asked.join(often, "g").groupBy("term").agg(F.min(F.struct("n", "g")).alias("r")).select("term", F.col("r.g").alias("g")))
    return held.join(rarest, "g").where(F.contains("__p", F.col("term"))).select(file, "term")


def role_bonus(path: Column, kind: Column, text: Column) -> Column:
    """What a file's place adds for a kind of task."""
    low = F.lower(path)
    document = P.is_document(path) & ((kind == "compatibility") | F.contains(F.lower(text), F.lit("documentation")))
    place = F.startswith(low, F.lit("examples/")) | low.rlike("/adapter|/adaptor|/integration")
    return F.when(document, 9).otherwise(0) + F.when((kind == "extension") & (P.base_name(low) == "go.work"), 8).otherwise(0) + F.when((kind == "extension") & place, 7).otherwise(0)


def candidate_files(tasks: DataFrame, terms: DataFrame, files: DataFrame, hits: DataFrame, task: str, task_text: str, file: str, path: str, most: int = 40) -> DataFrame:
    """(task, file, score, matched, rank): the files that may matter to a task, `most` of them.

    A term in the path adds its weight and IN_PATH; in the text its weight, IN_TEXT, LINE for each line of up to LINES, and DECLARED
    if a line declares it; the file's place adds what its kind of task gives (role_bonus).  Order: score, terms matched, path.

    `terms` is task_terms(), `hits` term_lines() of the same files, both settled.  What speaks for a file (lines with a term,
    its path, its place) is dealt by file, once: where Spark broadcasts the terms, a file's sums stay in its task, and only
    each task's best `most` files of a task text go on.  A place stands as a term of its own, which the tasks that it
    matters to ask for.
    """
    said = F.lower(F.col(task_text))
    kinds = settle(tasks.select(task, task_kind(F.col(task_text)).alias("__kind"), F.coalesce(F.contains(said, F.lit("documentation")), F.lit(False)).alias("__doc")))
    sorts = [tuple(r) for r in kinds.select("__kind", "__doc").distinct().collect()]  # kinds, twice over, at most
    bonus = lambda kind, doc: role_bonus(F.col("__path"), kind, F.when(doc, "documentation").otherwise(""))
    sort = lambda kind, doc: F.concat(F.lit("\n"), F.coalesce(kind, F.lit("")), F.lit("\n"), doc.cast("string"))  # noqa: E731  no term has a line break
    places = files.select(file, F.col(path).alias("__path"))
    spoken = F.array(*(F.when(bonus(F.lit(k), F.lit(d)) > 0, sort(F.lit(k), F.lit(d))) for k, d in sorts or [(None, False)]))
    no = lambda kind: F.lit(None).cast(kind)
    text = hits.select(file, "term", "line", "declared", F.lit(False).alias("named"))
    named = _path_hits(files, terms, file, path).select(file, "term", no("int").alias("line"), F.lit(False).alias("declared"), F.lit(True).alias("named"))
    at = places.select(file, F.explode(F.array_compact(spoken)).alias("term"), no("int").alias("line"), F.lit(False).alias("declared"), F.lit(False).alias("named"))
    dealt = text.union(named).union(at).repartition(parts_of(hits), file)
    worth = dealt.groupBy(file, "term").agg(F.count_distinct("line").alias("n"), F.max("declared").alias("declared"), F.max("named").alias("named"))
    more = F.when(F.col("n") > 0, IN_TEXT + F.least("n", F.lit(LINES)) * LINE + F.when(F.col("declared"), DECLARED).otherwise(0)).otherwise(0) + F.when(F.col("named"), IN_PATH).otherwise(0)
    worth = worth.select(file, "term", more.alias("more"), ((F.col("n") > 0).cast("int") + F.col("named").cast("int")).alias("times"))
    asked = settle(terms.select(task, "term", "weight").union(kinds.select(task, sort(F.col("__kind"), F.col("__doc")), F.lit(0))))
    met = worth.join(asked, "term").groupBy(task, file).agg(F.sum(F.col("weight") * F.col("times") + F.col("more")).alias("score"), F.count_if(F.col("times") > 0).alias("matched"))
    placed = met.join(places, file).join(kinds, task).withColumn("__bonus", bonus(F.col("__kind"), F.col("__doc"))).where("matched > 0 or __bonus > 0")
    scored = placed.select(task, file, "__path", (F.col("score") + F.col("__bonus")).alias("score"), "matched")
    return top_k(scored, [task], [F.desc("score"), F.desc("matched"), F.col("__path")], most).drop("__path")


def line_anchors(candidates: DataFrame, terms: DataFrame, hits: DataFrame, files: DataFrame, task: str, file: str, path: str, per_file: int = 8, total: int = 16) -> DataFrame:
    """(task, file, line, term, score, position): the lines of a task's candidates to start from, `total` of them.

    A line scores by the best of its terms: its path's score, its declaration, its being a comment (labels.line_match_points) and three for
    each line of the file with the term, up to eight; at most per_file of a file, files and lines by score, then path and line.
    """
    chosen = settle(candidates.select(task, file))
    only = settle(chosen.select(file).distinct())  # a handful: the lines of other files go before anything is shuffled
    pairs = settle(chosen.join(terms.select(task, "term"), task))
    own = settle(hits.join(only, file, "left_semi").join(pairs.select(file, "term").distinct(), [file, "term"], "left_semi"))
    often = own.groupBy(file, "term").agg(F.count_distinct("line").alias("__n"))
    near = pairs.join(own, [file, "term"]).join(often, [file, "term"]).join(files.select(file, F.col(path).alias("__path")).join(only, file, "left_semi"), file)
    test = P.artifact_role(F.col("__path")).isin("test", "fixture")
    scored = near.withColumn("score", L.line_match_points(F.col("__path"), F.col("term"), F.col("__n"), test, F.col("named"), F.col("comment")).cast("long"))
    scored = scored.select(task, file, "__path", "line", "term", "score")
    best = top_k(scored, [task, file, "line"], [F.desc("score"), F.col("term")], 1, "__k").drop("__k")
    own = top_k(best, [task, file], [F.desc("score"), F.col("line")], per_file, "__k").drop("__k")
    return top_k(own, [task], [F.desc("score"), F.col("__path"), F.col("line")], total, "position").select(task, file, "line", "term", "score", "position")
