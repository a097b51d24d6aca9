"""Statistics of an index and of its operations' latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.versions import latest


def shard_stats(postings: DataFrame, capacity: int) -> DataFrame:
    """By shard: rows written, live latest ones, superseded or deleted ones, utilization (live rows of the capacity),
    should_split (by the rows written, which take up its room), overfull (by utilization: the shards that an index
    picks to split), is_full, and the room remaining."""
    total = postings.groupBy("shard_id").agg(F.count(F.lit(1)).alias("total_count"))
    live = latest(postings).where("not deleted").groupBy("shard_id").agg(F.count(F.lit(1)).alias("active_count"))
    rows = total.join(live, "shard_id", "left").withColumn("active_count", F.coalesce("active_count", F.lit(0).cast("long")))
    return rows.selectExpr(
        "shard_id", "total_count", "active_count", "total_count - active_count as inactive_count",
        f"round(active_count / {capacity}D, 6) as utilization", f"total_count >= floor(0.9 * {capacity}) as should_split",
        f"active_count / {capacity}D >= 0.9D as overfull", f"total_count >= {capacity} as is_full", f"greatest({capacity} - total_count, 0L) as remaining",
    )


def index_stats(postings: DataFrame, capacity: int, dimension: int) -> DataFrame:
    """One row over all shards; disk is an estimate of 4 bytes an element and 64 a posting."""
    return shard_stats(postings, capacity).selectExpr(
        "count(1) as n_shards", "coalesce(sum(total_count), 0L) as total_postings", "coalesce(sum(active_count), 0L) as active_postings",
        "coalesce(sum(inactive_count), 0L) as inactive_postings", "coalesce(round(avg(utilization), 6), 0D) as average_utilization",
        f"coalesce(sum(total_count), 0L) * {4 * dimension + 64}L as disk_bytes", f"{dimension} as dimension",
    )


def latency_percentiles(metrics: DataFrame) -> DataFrame:
    """By op_type: count, mean, min, max and exact nearest-rank percentiles of latency_us, clamped to 1 us .. 1 h."""
    rows = metrics.withColumn("us", F.expr("greatest(1L, least(3600000000L, latency_us))"))
    p = lambda q: F.expr(f"cast(percentile_disc({q}) within group (order by us) as bigint)").alias(f"p{int(q * 100)}_us")
    return rows.groupBy("op_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("us"), 6).alias("mean_us"), F.min("us").alias("min_us"), F.max("us").alias("max_us"), p(0.5), p(0.95), p(0.99)
    )


def throughput(metrics: DataFrame, seconds: int = 60) -> DataFrame:
    """Operations a second in the last so many seconds before the newest."""
    newest = metrics.agg(F.max("ts").alias("newest"))
    rows = metrics.join(F.broadcast(newest)).where(f"ts > newest - interval {seconds} seconds")
    return rows.selectExpr("count(1) as n_ops", f"round(count(1) / {seconds}D, 6) as ops_per_second")


def hit_rates(metrics: DataFrame) -> DataFrame:
    """Shares of hits, and of false ones among them; 0 where there was nothing."""
    return metrics.selectExpr(
        "count_if(bloom_hit) as hits", "count_if(not bloom_hit) as misses",
        "coalesce(round(try_divide(count_if(bloom_hit), count_if(bloom_hit is not null)), 6), 0D) as hit_rate",
        "coalesce(round(try_divide(count_if(bloom_false_positive), count_if(bloom_hit)), 6), 0D) as false_positive_rate",
    )


def per_op_latency(metrics: DataFrame) -> DataFrame:
    """By op_type: its operations, their mean latency, and its share of all time, beside the mean over all operations."""
    by = metrics.groupBy("op_type").agg(F.count(F.lit(1)).alias("n"), F.sum("latency_us").alias("total_us"))
    every = by.agg(F.sum("n").alias("all_n"), F.sum("total_us").alias("all_us"))
    return by.join(F.broadcast(every)).selectExpr(  # one row
        "op_type", "n", "round(total_us / n, 6) as mean_us", "round(try_divide(total_us, all_us), 6) as share", "round(all_us / all_n, 6) as overall_mean_us"
    )


def health(metrics: DataFrame) -> DataFrame:
    """By op_type: success rate, p95 and whether it is healthy (p95 below a second and 99 % successes)."""
    return metrics.groupBy("op_type").agg(
        F.expr("round(count_if(success) / count(1), 6)").alias("success_rate"), F.expr("cast(percentile_disc(0.95) within group (order by latency_us) as bigint)").alias("p95_us")
    ).withColumn("healthy", F.expr("p95_us < 1000000 and success_rate >= 0.99D"))
