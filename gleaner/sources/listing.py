"""Sources of tracked files, corpora, rules and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_listing(records: DataFrame, key: list[str], record: str) -> DataFrame:
    """(key, path, mode, object, stage, is_regular) from index records `mode object stage<TAB>path`.

    A path stands once; of several stages stage 0 wins.  Regular: stage 0 and mode 100644 or 100755.
    """
    head, path = F.split(F.split(record, "\t", 2)[0], " "), F.split(F.col(record), "\t", 2)[1]
    rows = records.select(*key, path.alias("path"), head[0].alias("mode"), head[1].alias("object"), head[2].cast("int").alias("stage"))
    first = rows.groupBy(*key, "path").agg(F.min(F.struct("stage", "mode", "object")).alias("m"))
    regular = (F.col("m.stage") == 0) & F.col("m.mode").isin("100644", "100755")
    return first.select(*key, "path", "m.mode", "m.object", "m.stage", regular.alias("is_regular"))


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet", text: str = "content", most_bytes: int | None = None) -> DataFrame:
    """A content table with n_bytes and truncated; text files are read whole, one row each (path, content).

    Contents beyond most_bytes are cut there, or up to three bytes before, where a character would be cut in two.
    """
    if fmt == "text":
        rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias(text))
    else:
        rows = spark.read.format(fmt).load(path)
    sized = rows.withColumn("n_bytes", F.octet_length(text).cast("long"))
    if most_bytes is None:
        return sized.withColumn("truncated", F.lit(False))
    over, data = F.coalesce(F.col("n_bytes") > most_bytes, F.lit(False)), F.encode(text, "UTF-8")
    begins = lambda k: ~F.hex(F.substring(data, most_bytes - k + 1, 1)).rlike("^[89AB]")
    size = F.when(begins(0), most_bytes).when(begins(1), most_bytes - 1).when(begins(2), most_bytes - 2).otherwise(most_bytes - 3)
    return sized.withColumn("truncated", over).withColumn(text, F.when(over, F.decode(F.substring(data, F.lit(1), size), "UTF-8")).otherwise(F.col(text)))


def source_catalog(paths: DataFrame, inputs: DataFrame, key: list[str]) -> DataFrame:
    """(key, path, sha256, status): authorised, missing, unhashed or duplicate."""
    held = inputs.groupBy(*key, "path").agg(F.count("*").alias("n"), F.max("sha256").alias("sha256"))
    met = paths.select(*key, "path").distinct().join(held, [*key, "path"], "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").when(F.col("sha256").isNull(), "unhashed").otherwise("authorised")
    return met.select(*key, "path", "sha256", status.alias("status"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule files (multi-line JSON with a list `seeds`) as one row per rule."""
    return spark.read.json(path, multiLine=True).select(F.explode("seeds").alias("seed")).select("seed.*")


def read_runs(expected: DataFrame, runs: DataFrame, key: list[str], facts: list[str]) -> DataFrame:
    """A fact row for every expected run; a run without data is FAILED."""
    met = expected.select(*key).distinct().join(runs.select(*key, *facts).withColumn("__in", F.lit(True)), key, "left")
    return met.withColumn("state", F.when(F.col("__in"), "PRESENT").otherwise("FAILED")).drop("__in")


def save_snapshot(rows: DataFrame, path: str, context: dict[str, str]) -> None:
    """Writes the rows with their context, so that load_snapshot can refuse another one."""
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    spark = rows.sparkSession
    spark.createDataFrame(sorted(context.items()), "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/context")


def load_snapshot(spark: SparkSession, path: str, context: dict[str, str]) -> DataFrame:
    """The saved rows; a ValueError names the parts of the context that differ."""
    saved = {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/context").collect()}
    differ = sorted(k for k in saved.keys() | context.keys() if saved.get(k) != context.get(k))
    if differ:
        raise ValueError(f"snapshot context differs: {', '.join(differ)}")
    return spark.read.parquet(f"{path}/rows")
