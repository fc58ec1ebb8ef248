"""Reading, settling and linking shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Texts held against one copy of another's in a task.
PART = 256
#: Keys of the filter that holds texts without partners back from the shuffle, at most.
COARSE = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one set already, or that of spark.checkpoint.dir; in local mode, one made here."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files behind tables that are settled: Spark deletes them when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lean(run: Callable) -> Callable:
    """A mapInArrow function that gives free memory back to the system when its task ends.

    Python workers live on between stages: what one stage's arrays took would else count beside the next stage's.
    """

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # not glibc: nothing to trim
            pass

    return task


def settle(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage, in the folder the cluster names in spark.checkpoint.dir."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def rewrite(df: DataFrame) -> DataFrame:
    """settle() through a Parquet table in the same folder, for wide rows and for loops: a checkpoint is not compressed and
    keeps the size that the optimizer guessed, and guesses of joins upon joins multiply round by round until they burst."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def digest(col: str) -> F.Column:
    """crc32 of an id written as text, for the contracts' held-out folds."""
    return F.crc32(F.col(col).cast("string"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) per linked node, the component
    being the least node of it.

    Large-star and small-star rounds (Kiveris et al., 2014): each round is two grouped minima and two
    joins over the edges alone, hubs lose their fan-out as they go, and the number of rounds grows
    with the logarithm of the node count rather than with the length of chains.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = rewrite(small.union(root.select("u", F.col("m").alias("v"))).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def mostly_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of texts (id, text) whose id is among ids, and a few others.

    A filter of at most COARSE keys, whatever the input, keeps most other texts out of the shuffle to come.
    """
    coarse = F.pmod(F.xxhash64("id"), F.lit(COARSE)).alias("coarse")
    return texts.withColumn("coarse", coarse).join(F.broadcast(ids.select(coarse).distinct()), "coarse", "left_semi").drop("coarse")


def of_ids(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of texts (id, text) whose id is among ids."""
    return mostly_of(ids, texts).join(ids.select("id").distinct(), "id", "left_semi")


def meet(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Brings the texts (id, text) of pairs (a, b) of ids together: rows (b, part, own, a, text) in tasks
    sorted so that the text of b, with own 0, comes before those of its partners a, with own 1.

    The partners of b are dealt over parts of about PART, each with its own copy of b's text, so that
    every text moves about once and no b gathers all its partners in one task.
    """
    pairs = rewrite(pairs)
    load = pairs.groupBy("b").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    against = pairs.join(load, "b").select(F.col("a").alias("id"), "b", F.pmod(F.xxhash64("a"), "parts").cast("int").alias("part"), F.lit(1).alias("own"))
    bases = load.select(F.col("b").alias("id"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("own"))
    wanted = rewrite(against.union(bases))
    rows = wanted.join(mostly_of(wanted, texts), "id").select("b", "part", "own", F.col("id").alias("a"), "text")
    return rows.repartition("b", "part").sortWithinPartitions("b", "part", "own")
