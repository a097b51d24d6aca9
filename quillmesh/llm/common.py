"""What the operators share: table access, lineage cuts, bounded Arrow batches, connected components."""

from __future__ import annotations

import gc

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.sources.shared import new_folder, removed, shared_dir

#: Rows in one Arrow batch: texts can be very long, so a batch holds few of them.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Python worker holds: at most BATCH_ROWS texts at a time; Spark itself ends a batch after 64 MB."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more: it does so when their objects are
    collected, which a driver with little to do puts off."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage: df, computed once, in the shared folder."""
    spark = df.sparkSession
    shared_dir(spark)
    out = df.checkpoint()
    del df
    release(spark)
    return out


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, for what is large or is read by columns."""
    spark = df.sparkSession
    path = new_folder(spark, "tables")
    schema = df.schema
    df.write.parquet(path)
    del df
    release(spark)
    out = spark.read.schema(schema).parquet(path)
    out.table_path = path
    return out


def keyed_once(df: DataFrame) -> DataFrame:
    """df as the side of a join that holds each key once, or few times: the tasks look its rows up in a hash table of their
    partition's rows, and neither side is sorted. No hot key can make that table large."""
    return df.hint("shuffle_hash")


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() from which nothing is left to compute."""
    for df in tables:
        removed(df.sparkSession, df.table_path)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (src, dst) as (node, root), root the smallest node that is reachable.

    Each round, every node hooks on to its smallest neighbour, pointers jump once, and the edges are contracted
    to the parents; the edges shrink each round and only their number comes to the driver. Minima are
    pre-aggregated before each shuffle, and each join reads written rows on both sides, so that Spark can split
    a hot root.
    """
    edges = checkpoint(edges.select("src", "dst").where("src <> dst").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        parent = checkpoint(both.groupBy(F.col("src").alias("node")).agg(F.least("src", F.min("dst")).alias("up")))
        above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        parent = checkpoint(parent.join(above, "up").select("node", F.col("top").alias("up")))
        if labels is None:
            labels = parent.select("node", F.col("up").alias("root"))
        else:
            above = parent.select(F.col("node").alias("root"), F.col("up").alias("top"))
            labels = labels.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        labels = checkpoint(labels)
        a = parent.select(F.col("node").alias("src"), F.col("up").alias("a"))
        b = parent.select(F.col("node").alias("dst"), F.col("up").alias("b"))
        edges = edges.join(a, "src").join(b, "dst").where("a <> b")
        edges = checkpoint(edges.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
    if labels is None:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return labels


class Filter:
    """A Bloom filter with two slots a key, of a fixed number of bits; the keys are numpy uint64 hashes."""

    def __init__(self, bits: int, words: np.ndarray) -> None:
        self.bits, self.words = bits, words

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for slot in (keys & np.uint64(self.bits - 1), (keys >> np.uint64(32)) & np.uint64(self.bits - 1)):
            out &= (self.words[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def bloom(keys: DataFrame, bits: int) -> Filter:
    """The filter of a column key (long) of hashes. bits / 64 rows at most come to the driver, whatever keys holds."""
    key = F.col("key")
    mask = F.lit(bits - 1)
    slots = F.array(key.bitwiseAND(mask), F.shiftrightunsigned(key, 32).bitwiseAND(mask))
    rows = keys.select(F.explode(slots).alias("slot")).groupBy(F.shiftrightunsigned("slot", 6).alias("word"))
    rows = rows.agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("value")).toArrow()
    words = np.zeros(max(1, bits // 64), np.uint64)
    words[rows["word"].to_numpy()] = rows["value"].to_numpy().view(np.uint64)
    return Filter(bits, words)
