"""Training-corpus pipeline over the documents table.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read again as the next one's docs.  All but the last return the columns of
documents.  run() applies them to the documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import bpe, decontaminate, language, near_dedup, passages
from gleaner.llm.common import release, settle, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the likeliest language's statistics code about as short as plain bytes stay; those that no
    known language fits are rejected, and so are null texts and those without a letter.

    The model learns from the labelled languages of the stage's own input; without any, all are rejected.
    Each row is judged by itself, whatever its id.
    """
    return language.keep_known(docs, language.fit(docs))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one with the least id.

    Rows of one id count as one document: all go or stay, but of rows with equal texts one stays.  Rows
    without an id belong to no class and stay.
    """
    gone = near_dedup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    twice = settle(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not twice.take(1):
        return left
    once = left.join(twice, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return left.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(once)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat an earlier document's go from the text; a text of which no word is left goes whole.

    Rows of one id count as one document's texts, each cut by its own passages; rows without an id stay uncut.
    """
    release(spark)
    cut = passages.remove_repeats(docs, passages.repeated_passages(docs))
    left = cut.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; each row is judged by itself, whatever its id."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them.

    The encoder's memo is small here: its workers hold what other stages left.
    """
    return bpe.token_digests(docs, memo=24 << 20, states=bpe.STATES // 2)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("bpe", encoding),
]
#: None: the stages' models and fingerprints have no SQL form; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each settled in the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else settle(docs), sf_dir)
    return docs
