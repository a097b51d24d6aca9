"""SimHash near-duplicates: fingerprints, a grid join over segment popcounts, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, components, discard, small_batches, table, written

#: A fingerprint has 16 segments of 4 bits; a segment's popcount (0 to 4) fits its own 4 bits of a long.
SEGMENTS, WIDTH = 16, 4
#: Links are fingerprints that differ in at most so many bits.
MAX_BITS = 2


def simhash(text: bytes, words: int) -> int:
    """The 64-bit fingerprint of UTF-8 bytes. bytes.lower() lowers A-Z alone, bytes.split() splits at \\x20\\x09-\\x0D."""
    w = text.lower().split()
    if not w:
        return 0
    if len(w) < words:
        shingles, n = iter([b" ".join(w)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)), len(w) - words + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        size = min(n - at, 1 << 16)
        h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s, _ in zip(shingles, range(size))), np.dtype("<u8"), size)
        ones += np.unpackbits(h.view(np.uint8).reshape(size, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) for each row of docs; a null text is an empty one, and its fingerprint 0."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [simhash(t or b"", words) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def popcounts(fp: Column) -> Column:
    """The embedding: each segment's number of set bits, packed into the segment's place of a long."""
    out = F.lit(0).cast("long")
    for i in range(SEGMENTS):
        mask = ((15 << WIDTH * i) + (1 << 63)) % (1 << 64) - (1 << 63)
        out = out.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseAND(F.lit(mask))).cast("long"), WIDTH * i))
    return out


def cells(at: Column) -> Column:
    """The grid cells within Manhattan distance 1 of a cell, itself included."""
    out = [at]
    for i in range(SEGMENTS):
        here = F.shiftrightunsigned(at, WIDTH * i).bitwiseAND(F.lit(15))
        out += [F.when(here < WIDTH, at + F.lit(1 << WIDTH * i)), F.when(here > 0, at - F.lit(1 << WIDTH * i))]
    return F.array_compact(F.array(*out))


def grid(fps: DataFrame) -> DataFrame:
    """(fp, cell) for the grid cells within Manhattan distance 1 of each fingerprint's popcounts.

    Moving one bit moves one popcount by one, so the Manhattan distance of two embeddings is a lower bound of the
    differing bits: two fingerprints within 2 bits have a grid cell within distance 1 of both.
    """
    return fps.select("fp", popcounts(F.col("fp")).alias("at")).select("fp", F.explode(cells(F.col("at"))).alias("cell"))


DIFFER = "bit_count(a.fp ^ b.fp)"


def linked(fps: DataFrame) -> DataFrame:
    """The fingerprints (fp, all different) that link to another one: a semi-join on the cells that verifies the exact
    distance and keeps the rows that have a link, never the pairs."""
    cells = grid(fps)  # one plan on both sides: dealt out once
    on = F.expr(f"a.cell = b.cell and {DIFFER} between 1 and {MAX_BITS}")
    return cells.alias("a").join(cells.alias("b"), on, "left_semi").select("fp").distinct()


def links(fps: DataFrame) -> DataFrame:
    """Edges (src, dst) between fingerprints that link, by the range join on the cells and the exact distance.

    fps are those of linked(). A fingerprint has at most 2,080 others within 2 bits, so a group of n has no more than
    that many times n edges, whatever the data.
    """
    cells = grid(fps)
    on = F.expr(f"a.cell = b.cell and a.fp < b.fp and {DIFFER} <= {MAX_BITS}")
    return cells.alias("a").join(cells.alias("b"), on).select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst")).distinct()


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id, n_rows) for each row of docs(doc_id, text, ...).

    fp is the signed 64-bit fingerprint over shingles of so many words, component_id the smallest doc_id of the
    fingerprints linked directly or through others (2 bits or fewer), n_rows how many rows share doc_id and fp.
    Nulls: a null text counts as empty; a null doc_id keeps its row and never is a component_id, unless all ids
    of the component are null. Repeated rows come back as often. An empty table gives no rows. Further columns
    of docs are not read.
    """
    rows = checkpoint(fingerprints(docs, words).groupBy("doc_id", "fp").agg(F.count(F.lit(1)).alias("n_rows")))
    ids = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("lowest")))
    near = checkpoint(linked(ids.select("fp")))
    roots = components(links(near)).withColumnRenamed("node", "fp")
    lowest = ids.join(roots, "fp").groupBy("root").agg(F.min("lowest").alias("component_id"))
    known = checkpoint(roots.join(lowest, "root").select("fp", "component_id"))
    every = ids.join(known, "fp", "left").select("fp", F.coalesce("component_id", "lowest").alias("component_id"))
    return rows.join(checkpoint(every), "fp").select("doc_id", "fp", "component_id", "n_rows")


def keyed(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, fp) for each row of docs: doc_id and text_hash tell rows with different texts apart."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [simhash(t or b"", words) for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["doc_id", "text_hash", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, fp long")


def keep_one(docs: DataFrame, words: int = 3, jaccard: bool = False) -> DataFrame:
    """The rows of docs that stay if each group of near-duplicates keeps its smallest doc_id; columns as in docs.

    With jaccard, rows whose sets of shingles have a Jaccard similarity of 0.8 or more are linked too.

    Rows are told apart by doc_id and text, so that each group keeps one row whatever ids repeat or are null: of
    rows that repeat the smallest doc_id in the group, one stays, and a group whose ids all are null keeps one row.
    """
    from . import shingles  # it uses the fingerprints of this module

    rank = shingles.ranked(docs, words) if jaccard else None
    keys = written(shingles.keyed(docs, words, rank) if jaccard else keyed(docs, words))
    edges = links(checkpoint(linked(checkpoint(keys.select("fp").distinct()))))
    if jaccard:
        edges = shingles.similar(docs, keys, edges, words, rank)
    rows = keys.groupBy("doc_id", "text_hash", "fp").agg(F.count(F.lit(1)).alias("n_rows"))
    rows = rows.join(components(edges).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "n_rows")).alias("first")
    stays = checkpoint(rows.groupBy("root").agg(first).selectExpr("first.doc_id as keep_id", "first.text_hash as keep_hash", "first.n_rows as keep_n"))
    discard(keys)
    kept = docs.join(stays, F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.xxhash64("text") == F.col("keep_hash")))
    once = kept.where("keep_n = 1").select(*docs.columns)
    return once.unionByName(kept.where("keep_n > 1").dropDuplicates(["doc_id", "keep_hash"]).select(*docs.columns))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    found = found.select("doc_id", "fp", "component_id", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
