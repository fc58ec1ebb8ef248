"""An archive of results by key: a new version is written only where a result differs from the last one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import digest_of


def compare_variants(rows: DataFrame, key: list[str], variant: str, measures: list[str], names: list[str]) -> DataFrame:
    """One row a key: every measure of every variant in names (variant_measure), null where a variant has no row.

    Rows of one key and variant are expected once; of several, the largest measures count.
    """
    cells = [F.max(F.when(F.col(variant) == name, F.col(m))).alias(f"{name}_{m}") for name in names for m in measures]
    return rows.groupBy(*key).agg(*cells)


class Archive:
    """Versions of results in a folder that all executors share, a subfolder a batch.

    append() is safe to repeat: a batch is judged against the batches before it alone and replaces what an earlier
    attempt of it wrote, so a batch that failed half way or is replayed leaves the same archive.  Batches go by number.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str]) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def read(self, schema, before: int | None = None) -> DataFrame:
        """All versions (the results' columns, fingerprint, version, batch), or those of batches before one."""
        from pyspark.sql import types as T

        full = T.StructType([*schema.fields, T.StructField("fingerprint", T.StringType()), T.StructField("version", T.LongType()), T.StructField("batch", T.LongType())])
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], full)
        found = self.spark.read.schema(full).parquet(self.path)
        return found if before is None else found.where(F.col("batch") < before)

    def append(self, rows: DataFrame, batch: int) -> DataFrame:
        """Writes the rows that differ from their key's last version, and returns them.

        A row is new if its key has none yet; equal ones are passed over, whatever batch they came with.
        """
        values = [c for c in rows.columns if c not in self.key]
        mark = digest_of(*(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in values))
        now = rows.withColumn("fingerprint", mark)
        last = self.read(rows.schema, batch).groupBy(*self.key).agg(F.max(F.struct("version", "fingerprint")).alias("__last"))
        same_key = reduce(lambda a, b: a & b, (F.equal_null(F.col(f"n.{k}"), F.col(f"l.{k}")) for k in self.key))
        met = now.alias("n").join(last.alias("l"), same_key, "left").where(~F.equal_null(F.col("l.__last.fingerprint"), F.col("n.fingerprint")))
        out = met.select(*(F.col(f"n.{c}") for c in now.columns), (F.coalesce(F.col("l.__last.version"), F.lit(0)) + 1).alias("version"))
        out.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return self.read(rows.schema).where(F.col("batch") == batch)
