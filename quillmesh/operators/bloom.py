"""Bloom filters of shards as rows of 64-bit words, so that building and probing are aggregates and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmesh.functions.config import bloom_parameters


def slots(key: str, bits: int, hashes: int) -> Column:
    """The places of a key in a filter of so many bits."""
    return F.array(*(F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(bits)) for i in range(hashes)))


def filters(postings: DataFrame, n: int, rate: float) -> DataFrame:
    """(shard_id, word, bits): the filter of each shard's documents, for n of them at a rate of false positives. The
    filters of two sets of postings merge by bit_or."""
    m, k = bloom_parameters(n, rate)
    rows = postings.select("shard_id", "document_id").distinct().select("shard_id", F.explode(slots("document_id", m, k)).alias("slot"))
    return rows.groupBy("shard_id", F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits"))


def candidate_shards(filters: DataFrame, ids: DataFrame, n: int, rate: float) -> DataFrame:
    """(document_id, shard_id) for the shards that may hold a document: all that do, and few others."""
    m, k = bloom_parameters(n, rate)
    asked = ids.select("document_id").distinct().select("document_id", F.explode(F.array_distinct(slots("document_id", m, k))).alias("slot"))
    asked = asked.withColumn("need", F.count(F.lit(1)).over(Window.partitionBy("document_id")))
    hits = asked.withColumn("word", F.shiftright("slot", 6)).join(filters, "word").where("shiftrightunsigned(bits, cast(slot & 63 as int)) & 1 = 1")
    return hits.groupBy("document_id", "shard_id", "need").count().where("count = need").select("document_id", "shard_id")


def filter_stats(filters: DataFrame, n: int, rate: float) -> DataFrame:
    """By shard: bits set, load, and the rate of false positives at that load."""
    m, k = bloom_parameters(n, rate)
    rows = filters.groupBy("shard_id").agg(F.sum(F.bit_count("bits")).alias("bits_set"))
    return rows.selectExpr("shard_id", "bits_set", f"round(bits_set / {m}D, 6) as load", f"round(power(bits_set / {m}D, {k}), 6) as false_positive_rate")
