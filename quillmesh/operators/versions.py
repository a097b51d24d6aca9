"""Append-only postings: latest versions, tombstones, deletes, shard splits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmesh.functions.similarity import distance

KEY = ["shard_id", "document_id", "start", "length"]


def latest(postings: DataFrame) -> DataFrame:
    """The newest row (highest seq) of each key; a mergeable maximum, not a sort."""
    rest = [c for c in postings.columns if c not in KEY]
    newest = postings.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "seq").alias("newest"))
    return newest.select(*KEY, "newest.*").select(*postings.columns)


def buried(postings: DataFrame, deletes: DataFrame) -> DataFrame:
    """postings with deleted set where deletes(document_id, deleted_at) has a later delete of the document."""
    d = deletes.groupBy("document_id").agg(F.max("deleted_at").alias("deleted_at"))
    out = postings.join(d, "document_id", "left")
    gone = F.col("deleted") | F.coalesce(F.col("deleted_at") > F.col("seq"), F.lit(False))
    return out.withColumn("deleted", gone).select(*postings.columns)


def delete_counts(postings: DataFrame, ids: DataFrame) -> DataFrame:
    """(document_id, removed) for each id asked for: its live postings, 0 for unknown ones."""
    live = latest(postings).where("not deleted").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    return ids.select("document_id").distinct().join(live, "document_id", "left").select("document_id", F.coalesce("n", F.lit(0).cast("long")).alias("removed"))


def survivors(postings: DataFrame, ids: DataFrame) -> DataFrame:
    return latest(postings).where("not deleted").join(ids.select("document_id").distinct(), "document_id", "left_anti")


def candidate_shards(postings: DataFrame, ids: DataFrame) -> DataFrame:
    """(document_id, shard_id): the shards that hold a document, exactly."""
    return postings.select("document_id", "shard_id").distinct().join(ids.select("document_id").distinct(), "document_id", "left_semi")


#: Rows of a shard that a task compares with as many others at once.
BLOCK = 1024


def furthest(m: np.ndarray, other: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[float, int, int] | None:
    """(distance, seq, seq) of the rows furthest from each other, a row of distances at a time; of equal ones those of
    the highest seq; the higher seq first. None if no two rows differ in seq."""
    best = None
    for i in range(len(m)):
        d = np.round(np.sqrt(((other - m[i]) ** 2).sum(axis=1)), 6)
        d[b == a[i]] = -1
        if len(d) and d.max() >= 0:
            at = np.flatnonzero(d == d.max())
            high, low = np.maximum(a[i], b[at]), np.minimum(a[i], b[at])
            j = np.lexsort((low, high))[-1]
            best = max(best or (-1.0, 0, 0), (float(d.max()), int(high[j]), int(low[j])))
    return best


def furthest_pairs(live: DataFrame) -> DataFrame:
    """(shard_id, seq_a, seq_b, distance): each shard's furthest pair, the first of equal ones in newest-first order.

    A shard of any size is cut into blocks of about BLOCK rows by a hash of seq; every two blocks meet in a task of
    their own and pass on one pair. seq tells the rows of a shard apart.
    """
    kind = live.schema["shard_id"].dataType.simpleString()
    counts = live.groupBy("shard_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    rows = live.select("shard_id", "seq", "vector").join(counts, "shard_id")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("seq"), "blocks")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    rows = rows.select("shard_id", "seq", "vector", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        first, second = p[p.block == p.low.iloc[0]], p[p.block == p.high.iloc[0]]
        vectors = (np.array(x["vector"].tolist(), np.float64).reshape(len(x), -1) for x in (first, second))
        found = furthest(*vectors, first.seq.to_numpy(), second.seq.to_numpy())
        return pd.DataFrame([(p.shard_id.iloc[0], *found)] if found else [], columns=["shard_id", "distance", "seq_a", "seq_b"])

    pairs = rows.groupBy("shard_id", "low", "high").applyInPandas(run, f"shard_id {kind}, distance double, seq_a long, seq_b long")
    best = pairs.groupBy("shard_id").agg(F.max(F.struct("distance", "seq_a", "seq_b")).alias("best"))
    return best.select("shard_id", "best.seq_a", "best.seq_b", "best.distance")


def split(live: DataFrame) -> DataFrame:
    """(shard_id, document_id, start, length, seq, side): each shard in two, around its furthest pair.

    Shards of four rows or fewer, of equal vectors, or with an empty side are halved in the order of rows, newest
    first, as seq tells them. All but the pairs are joins and aggregates that pass over rows.
    """
    pairs = furthest_pairs(live)
    seeds = pairs
    for n in "ab":
        vector = live.select("shard_id", F.col("seq").alias(f"seq_{n}"), F.col("vector").alias(n))
        seeds = seeds.join(vector, ["shard_id", f"seq_{n}"])
    size = live.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"))
    rows = live.join(size, "shard_id").join(seeds.select("shard_id", F.col("distance").alias("most"), "a", "b"), "shard_id", "left")
    far = "n > 4 and most > 1e-6"
    rows = rows.withColumn("nearer", F.expr(f"case when {far} then round({distance('vector', 'b')}, 6) < round({distance('vector', 'a')}, 6) end"))
    sides = rows.groupBy("shard_id").agg((F.min("nearer") < F.max("nearer")).alias("parted"))
    rows = rows.drop("a", "b", "most").join(sides, "shard_id")
    apart = rows.where("parted").withColumn("side", F.expr("if(nearer, 'b', 'a')"))
    place = F.row_number().over(Window.partitionBy("shard_id").orderBy(F.desc("seq"))) - 1
    halves = rows.where("not coalesce(parted, false)").withColumn("side", F.when(place >= F.expr("(n + 1) div 2"), "b").otherwise("a"))
    columns = ["shard_id", "document_id", "start", "length", "seq", "side"]
    return apart.select(*columns).unionByName(halves.select(*columns))


def point_lookup(postings: DataFrame, shard_id: int, seq: int) -> DataFrame:
    """The row of a shard that was written as number seq, whatever has replaced it since."""
    return postings.where((F.col("shard_id") == shard_id) & (F.col("seq") == seq))


def slots_of(postings: DataFrame, ids: DataFrame) -> DataFrame:
    """(document_id, shard_id, seq, current): every row ever written of the documents asked for, and whether it is the
    live newest one of its key."""
    asked = postings.join(ids.select("document_id").distinct(), "document_id", "left_semi")
    newest = latest(asked).where("not deleted").select("shard_id", "seq", F.lit(True).alias("current"))
    rows = asked.select("document_id", "shard_id", "seq").join(newest, ["shard_id", "seq"], "left")
    return rows.select("document_id", "shard_id", "seq", F.coalesce("current", F.lit(False)).alias("current"))
