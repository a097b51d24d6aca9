"""WARC fixity: hash trees over the records and offset ranges of replicas, compared from the roots down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table, written
from .conversations import carried

#: Children of a tree node, and how many consecutive record ids a WARC file (a volume) holds.
FAN, VOLUME = 16, 1024


def record(url: Column, payload: Column) -> Column:
    """The bytes of a WARC resource record, as text; a null url or payload is empty."""
    url, payload = F.coalesce(url, F.lit("")), F.coalesce(payload, F.lit(""))
    size = F.octet_length(payload).cast("string")
    head = [F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), size]
    return F.concat(*head, F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """The records of every volume in their order, as a written table: volume, key, idx, offset, length, digest.

    A volume holds the records of VOLUME consecutive keys, by key, then digest (ties of both are the same bytes);
    null keys make volumes of their own, by their digests. A key may have any number of records: place and offset are
    sums that run along ranges of the volume.
    """
    k, text = F.col(key), record(F.col(url), F.col(payload))
    rows = pages.select(k.cast("long").alias("key"), F.octet_length(text).cast("long").alias("length"), F.sha2(text, 256).alias("digest"))
    volume = F.coalesce(F.shiftright("key", VOLUME.bit_length() - 1), -(1 << 60) - F.pmod(F.xxhash64("digest"), F.lit(4096)))
    rows = rows.withColumn("volume", volume).withColumn("one", F.lit(1).cast("long"))
    rows = carried(rows, ["volume"], ["key", "digest"], upto=("sum", "length"), place=("sum", "one"))
    return rows.select("volume", "key", (F.col("place") - 1).alias("idx"), (F.col("upto") - F.col("length")).alias("offset"), "length", "digest")


def tree(rows: DataFrame) -> DataFrame:
    """All nodes (volume, level, idx, first_byte, upto_byte, digest); level 0 has a node a record, the highest one a
    volume. A node's digest covers its children's digests and offset ranges, in order, FAN at most."""
    level = rows.select("volume", F.lit(0).alias("level"), "idx", F.col("offset").alias("first_byte"), (F.col("offset") + F.col("length")).alias("upto_byte"), "digest")
    levels = [level]
    most = rows.agg(F.max("idx")).first()[0] or 0
    while most > 0 or len(levels) == 1:
        text = F.concat_ws(":", "first_byte", "upto_byte", "digest")
        kids = F.array_sort(F.collect_list(F.struct("idx", text.alias("text"))))
        level = level.groupBy("volume", F.shiftright("idx", FAN.bit_length() - 1).alias("parent")).agg(
            F.min("first_byte").alias("first_byte"), F.max("upto_byte").alias("upto_byte"), F.sha2(F.concat_ws("|", kids["text"]), 256).alias("digest")
        )
        level = checkpoint(level.select("volume", F.lit(len(levels)).alias("level"), F.col("parent").alias("idx"), "first_byte", "upto_byte", "digest"))
        levels.append(level)
        most //= FAN
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def damaged(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(volume, idx) of the leaves that differ between two trees: compared at the roots, then only below the nodes
    that differ. Leaves that one side lacks differ too."""
    top = max(t.agg(F.max("level")).first()[0] or 0 for t in (ours, theirs))
    open_nodes = None
    for level in range(top, -1, -1):
        a, b = (t.where(F.col("level") == level).select("volume", "idx", F.struct("first_byte", "upto_byte", "digest").alias(c)) for t, c in ((ours, "a"), (theirs, "b")))
        if open_nodes is not None:
            up = open_nodes.withColumnRenamed("idx", "up")
            a, b = (x.withColumn("up", F.shiftright("idx", FAN.bit_length() - 1)).join(up, ["volume", "up"], "left_semi").drop("up") for x in (a, b))
        open_nodes = checkpoint(a.join(b, ["volume", "idx"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("volume", "idx"))
    return open_nodes


def audit(ours: DataFrame, theirs: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """For each record of ours, and each that stands in the replica where ours has none: volume, key, idx, offset,
    length, digest, side (ours, replica), intact, moved.

    intact is false where the replica has other bytes or another offset at the record's place, or none; for these,
    moved tells whether the replica holds the record's bytes under the same key elsewhere in the volume, as after an
    insertion or a loss further ahead. Nulls in url or payload are empty ones, records with a null key are audited
    too, repeated rows are records of their own; two empty tables give no rows. A record may be very long: it is
    hashed where it is read. Further columns are not read.
    """
    mine, other = leaves(ours, key, url, payload), leaves(theirs, key, url, payload)
    bad = damaged(tree(mine), tree(other)).withColumn("bad", F.lit(True))
    out = mine.join(bad, ["volume", "idx"], "left").withColumn("side", F.lit("ours"))
    extra = other.join(bad, ["volume", "idx"]).join(mine.select("volume", "idx"), ["volume", "idx"], "left_anti").withColumn("side", F.lit("replica"))
    out = out.unionByName(extra.select(*out.columns))
    # the bytes of what differs, looked for on the other side: equal records are counted, not paired
    what = ["volume", "key", "digest"]
    same = lambda a, b: F.col(f"{a}.volume").eqNullSafe(F.col(f"{b}.volume")) & F.col(f"{a}.key").eqNullSafe(F.col(f"{b}.key")) & (F.col(f"{a}.digest") == F.col(f"{b}.digest"))
    lost = checkpoint(out.where("bad").select("side", *what).distinct())
    held = mine.select(F.lit("replica").alias("side"), *what).unionByName(other.select(F.lit("ours").alias("side"), *what))
    there = held.alias("a").join(lost.alias("b"), same("a", "b") & (F.col("a.side") == F.col("b.side")), "left_semi").distinct().withColumn("moved", F.lit(True))
    out = out.alias("a").join(checkpoint(there).alias("b"), same("a", "b") & (F.col("a.side") == F.col("b.side")) & F.col("a.bad"), "left")
    return out.select("a.volume", "a.key", "idx", "offset", "length", "a.digest", "a.side", F.col("bad").isNull().alias("intact"), F.coalesce("moved", F.lit(False)).alias("moved"))


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all pages against a replica that has lost a bit of every 50th page: its last character is another."""
    pages = table(spark, sf_dir, "pages")
    broken = F.expr("case when page_id % 50 = 0 and length(html) > 0 then concat(substring(html, 1, length(html) - 1), '?') else html end")
    out = audit(pages, pages.withColumn("html", broken))
    return out.select(F.col("key").alias("page_id"), "volume", "idx", "offset", "length", "digest", "intact")


OP7_SQL = f"""
with r as (select page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
  || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(html)) || chr(13) || chr(10) || chr(13) || chr(10) || html
  || chr(13) || chr(10) || chr(13) || chr(10) as t, page_id % 50 <> 0 or right(html, 1) = '?' or html = '' as intact from pages),
d as (select page_id, page_id // {VOLUME} as volume, octet_length(encode(t))::bigint as length, sha256(t) as digest, intact from r)
select page_id, volume::bigint as volume, (row_number() over w - 1)::bigint as idx, (sum(length) over w - length)::bigint as "offset", length, digest, intact
from d window w as (partition by volume order by page_id, digest)
"""
