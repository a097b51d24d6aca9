"""Which of several hits on the same thing a result keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Policy: its key columns; None: no dedup.
POLICIES = {
    "none": None,
    "by_document": ["document_id"],
    "by_position": ["document_id", "start"],
    "exact": ["document_id", "start", "length", "quantised"],
}
QUANTISED = "transform(vector, x -> cast(round(cast(x as double) * 1000000) as bigint))"


def deduplicated(hits: DataFrame, policy: str) -> DataFrame:
    """hits(shard_rank, score, seq, ...) under a policy: by_document keeps the best score, the others what is seen first
    (nearest shard, then score, then newest)."""
    key = POLICIES[policy]
    if key is None:
        return hits
    seen = [F.asc("shard_rank"), F.desc("score"), F.desc("seq")]
    order = [F.desc("score"), F.asc("shard_rank"), F.desc("seq")] if policy == "by_document" else seen
    rows = hits.withColumn("quantised", F.expr(QUANTISED)) if policy == "exact" else hits
    rows = rows.withColumn("seen", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return rows.where("seen = 1").drop("seen", "quantised")


def dedup_stats(hits: DataFrame, policy: str) -> DataFrame:
    """policy, processed, removed, kept, efficiency (1 - removed / processed, 1 if nothing was)."""
    before, after = hits.agg(F.count(F.lit(1)).alias("processed")), deduplicated(hits, policy).agg(F.count(F.lit(1)).alias("kept"))
    out = before.join(F.broadcast(after))
    ratio = "case when processed = 0 then 1D else round(1D - (processed - kept) / processed, 6) end"
    return out.selectExpr(f"'{policy}' as policy", "processed", "processed - kept as removed", "kept", f"{ratio} as efficiency")
