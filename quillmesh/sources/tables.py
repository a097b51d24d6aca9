"""The library's inputs, derived from the driver's tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned postings with several versions of a key; vectors are scaled, so that the metrics rank differently."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id % 50 as document_id", "(vec_id % 7) * 10 as start", "10L as length", "cast(label as bigint) as shard_id", "vec_id as seq",
        "transform(embedding, x -> cast(x as double) * (1 + vec_id % 5)) as vector", "false as deleted",
    )


def deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh document is deleted after all postings were written."""
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id % 50 as document_id").distinct().where("document_id % 11 = 0").selectExpr("document_id", "1000000000L as deleted_at")


def vector_of(spark: SparkSession, sf_dir: str, seq: int) -> list[float]:
    """One posting's vector, as a query."""
    return postings(spark, sf_dir).where(F.col("seq") == seq).first()["vector"]


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of every third document, one of which is then deleted for every ninth."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id as document_id", "1L as version", "text", "false as deleted")
    second = docs.where("document_id % 3 = 0").selectExpr("document_id", "2L", "concat('v2 ', text)", "document_id % 9 = 0")
    return docs.union(second)


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings, removes and texts numbered into transactions of a hundred ids."""
    vec, docs = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    none = "cast(null as array<double>)"
    add = vec.selectExpr("vec_id div 100 as txn_id", "vec_id % 100 as op_ordinal", "'add_posting' as op", "vec_id % 50 as document_id", "(vec_id % 7) * 10 as start", "(vec_id % 13) as length", "transform(embedding, x -> cast(x as double)) as vector", "cast(null as string) as text")
    remove = vec.where("vec_id % 100 = 37").selectExpr("vec_id div 100", "100L", "'remove_document'", "vec_id div 100", "cast(null as bigint)", "cast(null as bigint)", none, "cast(null as string)")
    store = docs.selectExpr("doc_id div 100", "200L + doc_id % 100", "'store_text'", "doc_id % 60", "cast(null as bigint)", "cast(null as bigint)", none, "text")
    return add.union(remove).union(store)


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as latencies of operations."""
    return table(spark, sf_dir, "events").selectExpr(
        "cast(ts as timestamp) as ts", "event_type as op_type", "cast(round(value * 1000) as bigint) as latency_us", "event_id % 100 <> 0 as success",
        "case when event_id % 4 = 0 then null else event_id % 3 = 0 end as bloom_hit", "event_id % 30 = 3 as bloom_false_positive",
    )


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses in the order of event_id, which numbers them from the smallest on."""
    return table(spark, sf_dir, "events").selectExpr("user_id as document_id", "cast(ts as timestamp) as ts", "event_id as pos")
