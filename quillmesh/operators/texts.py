"""Document texts: latest versions, byte-range snippets and their validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_texts(texts: DataFrame) -> DataFrame:
    """(document_id, version, text) of the newest version, without documents whose newest version is a deletion."""
    newest = texts.groupBy("document_id").agg(F.max_by(F.struct("version", "text", "deleted"), "version").alias("n"))
    return newest.where("not n.deleted").select("document_id", "n.version", "n.text")


#: Why a byte range of a text can't be cut out; null where it can. Columns text, start, length.
RANGE_FAULT = """case
  when text is null then 'no text'
  when length <= 0 then 'empty range'
  when start + length > 4294967295 then 'overflow'
  when start > octet_length(text) then 'start beyond text'
  when start + length > octet_length(text) then 'end beyond text'
  when not is_valid_utf8(substring(cast(text as binary), cast(start + 1 as int), cast(length as int)))
    then 'inside a character' end"""


def snippets(texts: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(document_id, start, length) with snippet, or the fault of the range; offsets are bytes."""
    rows = requests.join(texts.select("document_id", "text"), "document_id", "left")
    rows = rows.withColumn("fault", F.expr(RANGE_FAULT))
    cut = "case when fault is null then cast(substring(cast(text as binary), cast(start + 1 as int), cast(length as int)) as string) end"
    return rows.selectExpr("document_id", "start", "length", f"{cut} as snippet", "fault")


def overlaps(postings: DataFrame) -> DataFrame:
    """Per document, postings that overlap an earlier one (by start, then seq): document_id, n_overlapping.

    A running maximum of ends finds them in one sorted pass; no pairs are made.
    """
    before = Window.partitionBy("document_id").orderBy("start", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = postings.withColumn("upto", F.max(F.col("start") + F.col("length")).over(before))
    return rows.groupBy("document_id").agg(F.count_if(F.col("start") < F.col("upto")).alias("n_overlapping"))


def text_stats(texts: DataFrame) -> DataFrame:
    return texts.agg(
        F.count(F.lit(1)).alias("n_versions"), F.count_distinct("document_id").alias("n_documents"),
        F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0).cast("long")).alias("total_bytes"),
        F.expr("coalesce(sum(cast(octet_length(text) as bigint)) div count(1), 0L)").alias("average_bytes"),
    )
