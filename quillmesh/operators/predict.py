"""Which documents are asked for next: sequence and co-occurrence scores over an access log (document_id, ts, pos).

pos numbers the accesses 0, 1, ... in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Accesses looked back on, seconds between two that count together, partners kept, and the least strength.
REACH, SECONDS, PARTNERS, LEAST = 10, 1800, 50, 0.1


def sequence_scores(log: DataFrame, document: int) -> DataFrame:
    """(next_id, score): each earlier access i of the document adds 1 / (n - i) to the one that follows it."""
    n = log.agg(F.count(F.lit(1)).alias("n"))  # one row
    follow = log.select((F.col("pos") - 1).alias("pos"), F.col("document_id").alias("next_id"))
    hits = log.where(F.col("document_id") == document).join(follow, "pos").join(F.broadcast(n))
    return hits.groupBy("next_id").agg(F.round(F.sum(F.lit(1.0) / (F.col("n") - F.col("pos"))), 6).alias("score"))


def cooccurrence(log: DataFrame) -> DataFrame:
    """(document_id, partner_id, strength), PARTNERS strongest a document: an access at distance d (1 the access itself)
    within REACH accesses and SECONDS adds 1 / (d + 1), d the partner's latest in reach.

    The accesses in reach come by equi-joins on pos, one for each distance: REACH - 1 rows an access.
    """
    back = log.select("pos", "ts", "document_id", F.explode(F.sequence(F.lit(1), F.lit(REACH - 1))).alias("back"))
    back = back.withColumn("at", F.col("pos") - F.col("back"))
    other = log.select(F.col("pos").alias("at"), F.col("ts").alias("ts2"), F.col("document_id").alias("partner_id"))
    near = back.join(other, "at").where(f"partner_id <> document_id and ts - ts2 <= interval {SECONDS} seconds")
    seen = near.groupBy("pos", "document_id", "partner_id").agg(F.min("back").alias("back"), F.count(F.lit(1)).alias("times"))
    pairs = seen.groupBy("document_id", "partner_id").agg(F.round(F.sum(F.col("times") / (F.col("back") + 2.0)), 6).alias("strength"))
    best = Window.partitionBy("document_id").orderBy(F.desc("strength"), "partner_id")
    return pairs.where(F.col("strength") >= LEAST).withColumn("place", F.row_number().over(best)).where(F.col("place") <= PARTNERS).drop("place")


def predicted(log: DataFrame, document: int, limit: int) -> DataFrame:
    """The ids to prefetch: the best half by sequence and the best by co-occurrence, without the document, by id."""
    a = sequence_scores(log, document).orderBy(F.desc("score"), "next_id").limit(limit // 2).select(F.col("next_id").alias("document_id"))
    b = cooccurrence(log).where(F.col("document_id") == document).orderBy(F.desc("strength"), "partner_id").limit(limit)
    both = a.unionByName(b.select(F.col("partner_id").alias("document_id"))).distinct()
    return both.where(F.col("document_id") != document).orderBy("document_id").limit(limit)
