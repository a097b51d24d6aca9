"""Micro-batch commits of the operations log: files in, each transaction applied once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators import ops
from quillmesh.sources.shared import new_folder

#: Bytes of operations in a file of a delivered log, and the most files of a micro-batch of it.
FILE_BYTES, BATCH_FILES = 64 << 20, 16


def commit(batch: DataFrame, batch_id: int, target: str) -> None:
    """Append a micro-batch under its own number. A batch that is tried again replaces its own files, and operations
    (txn_id, op_ordinal) that an earlier batch has committed are left out, so that every operation is applied once,
    also where a transaction's operations come in several batches. Of earlier batches, the files whose range of
    txn_id meets the batch's are read, and the two key columns alone."""
    key = ["txn_id", "op_ordinal"]
    rows = batch.dropDuplicates(key)
    if batch_id > 0 and (ends := batch.agg(F.min("txn_id").alias("low"), F.max("txn_id").alias("high")).first()).low is not None:
        earlier = batch.sparkSession.read.parquet(target).where((F.col("batch") < batch_id) & F.col("txn_id").between(ends.low, ends.high))
        rows = rows.join(earlier.select(*key), key, "left_anti")
    rows.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")


def start(spark: SparkSession, source: str, schema, target: str, checkpoint: str, files: int = 8, interval_ms: int | None = None):
    """The streaming query that commits the files of a folder; with an interval it runs on, without it ends when all are in."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    writer = rows.writeStream.foreachBatch(lambda df, i: commit(df, i, target)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{interval_ms} milliseconds") if interval_ms else writer.trigger(availableNow=True)).start()


def delivered(operations: DataFrame, at: str) -> int:
    """Write the operations twice as files of a folder, which cut transactions apart: each delivery as files of about
    FILE_BYTES, four at least, by a sum over the log. Returns the files of a delivery."""
    size = ops.sized(operations).agg(F.sum("bytes")).first()[0] or 0
    n = max(4, -(-size // FILE_BYTES))
    for seed in ("a", "b"):
        operations.repartition(n, F.xxhash64("txn_id", "op_ordinal", F.lit(seed))).write.mode("append").parquet(at)
    return n


def replayed(operations: DataFrame) -> DataFrame:
    """operations after a trip through the stream, each delivered twice; the files cut transactions apart. A log of any
    size comes in files and micro-batches of bounded bytes, four batches at least."""
    spark, at = operations.sparkSession, new_folder(operations.sparkSession, "streams")
    n = delivered(operations, f"{at}/in")
    start(spark, f"{at}/in", operations.schema, f"{at}/out", f"{at}/state", files=min(n // 2, BATCH_FILES)).awaitTermination()
    return spark.read.parquet(f"{at}/out").drop("batch")
