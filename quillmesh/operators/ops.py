"""The operations log: validation, sizes, batches, idempotent replay and the fold into state.

operations(txn_id, op_ordinal, op, document_id, start, length, vector, text); op is add_posting, remove_document,
store_text or delete_text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed by the format: bytes of an operation of each kind, without its vector or text.
SIZE = """case op when 'add_posting' then 29 + 4 * coalesce(size(vector), 0) when 'store_text' then 21 + coalesce(octet_length(text), 0)
  else 17 end"""


def faults(dimension: int, max_text_bytes: int) -> str:
    """Why an operation is refused, as an SQL expression; null where it isn't."""
    return f"""case
      when op not in ('add_posting', 'remove_document', 'store_text', 'delete_text') then 'unknown operation'
      when document_id is null or document_id = 0 then 'no document id'
      when op = 'add_posting' and (length is null or length <= 0) then 'length is zero'
      when op = 'add_posting' and start + length > 4294967295 then 'range overflows'
      when op = 'add_posting' and (vector is null or size(vector) <> {dimension}) then 'wrong dimension'
      when op = 'add_posting' and exists(vector, x -> x is null or isnan(x) or abs(x) = cast('infinity' as float)) then 'not finite'
      when op = 'store_text' and (text is null or text = '') then 'empty text'
      when op = 'store_text' and {max_text_bytes} > 0 and octet_length(text) > {max_text_bytes} then 'text too long'
      when op = 'store_text' and instr(text, char(0)) > 0 then 'text has a null byte' end"""


def validated(operations: DataFrame, dimension: int, max_text_bytes: int = 10 << 20) -> DataFrame:
    return operations.withColumn("fault", F.expr(faults(dimension, max_text_bytes)))


def sized(operations: DataFrame) -> DataFrame:
    return operations.withColumn("bytes", F.expr(f"cast({SIZE} as bigint)"))


def unprocessed(operations: DataFrame, processed: DataFrame) -> DataFrame:
    """The operations of transactions that have not been applied, each transaction once."""
    return operations.dropDuplicates(["txn_id", "op_ordinal"]).join(processed.select("txn_id").distinct(), "txn_id", "left_anti")


def postings_of(operations: DataFrame) -> DataFrame:
    """The postings that stand after all operations in the order (txn_id, op_ordinal): those that no later remove of
    their document follows; of equal keys in one operation the one with the greatest vector. One maximum a document
    and a join; no ordered walk."""
    at = F.struct("txn_id", "op_ordinal")
    removes = operations.where("op = 'remove_document'").groupBy("document_id").agg(F.max(at).alias("removed_at"))
    adds = operations.where("op = 'add_posting'").withColumn("at", F.struct("txn_id", "op_ordinal", "vector")).join(removes, "document_id", "left")
    adds = adds.where("removed_at is null or struct(txn_id, op_ordinal) > removed_at")
    newest = adds.groupBy("document_id", "start", "length").agg(F.max_by(F.struct("txn_id", "op_ordinal", "vector"), "at").alias("n"))
    return newest.select("document_id", "start", "length", "n.*")


def texts_of(operations: DataFrame) -> DataFrame:
    """(document_id, text) after all operations."""
    at = F.struct("txn_id", "op_ordinal")
    newest = operations.where("op in ('store_text', 'delete_text')").groupBy("document_id").agg(F.max_by(F.struct("op", "text"), at).alias("n"))
    return newest.where("n.op = 'store_text'").select("document_id", "n.text")


def batches(operations: DataFrame, max_ops: int, max_bytes: int) -> DataFrame:
    """(txn_id, batch, n_ops, bytes): each transaction's operations in batches; a batch ends with the operation that
    makes it max_ops, or more than max_bytes.

    Where a batch ends depends on where the one before did, so a task walks along each transaction: two numbers an
    operation, in Arrow batches.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        out, n, total = [], 0, 0
        for size in p.sort_values("op_ordinal")["bytes"]:
            n, total = n + 1, total + size
            if n >= max_ops or total > max_bytes:
                out.append((n, total))
                n = total = 0
        if n:
            out.append((n, total))
        found = pd.DataFrame(out, columns=["n_ops", "bytes"])
        return found.assign(txn_id=p["txn_id"].iloc[0], batch=range(len(found)))

    kind = operations.schema["txn_id"].dataType.simpleString()
    rows = sized(operations).select("txn_id", "op_ordinal", "bytes")
    return rows.groupBy("txn_id").applyInPandas(run, f"txn_id {kind}, batch long, n_ops long, bytes long").select("txn_id", "batch", "n_ops", "bytes")


def replay_stats(operations: DataFrame, processed: DataFrame) -> DataFrame:
    """One row: transactions seen, replayed and skipped, operations applied by kind, success rate in percent."""
    done = processed.select("txn_id").distinct().withColumn("done", F.lit(True))
    rows = operations.dropDuplicates(["txn_id", "op_ordinal"]).join(done, "txn_id", "left")
    n = lambda c: F.expr(f"count(distinct case when {c} then txn_id end)")
    k = lambda op: F.expr(f"count_if(done is null and op = '{op}')").alias(f"n_{op}")
    out = rows.agg(n("true").alias("n_transactions"), n("done is null").alias("n_replayed"), n("done").alias("n_skipped"), k("add_posting"), k("remove_document"), k("store_text"))
    return out.withColumn("success_rate", F.expr("case when n_transactions = 0 then 100D else round(100D * n_replayed / n_transactions, 6) end"))
