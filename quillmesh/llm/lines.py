"""Line dedup: an exact set-similarity join of lines, and the removal of later matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sets
from .common import checkpoint, discard, keyed_once, small_batches, table, written


def line_rows(docs: DataFrame, rank: Broadcast) -> DataFrame:
    """A row for each line with words: doc_id, text_hash, line, and its set of words as described() in sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, line, h = sets.words_of(b.column(2))
            if not len(h):
                continue
            new = np.ones(len(h), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])
            at, number = sets.as_sets(np.cumsum(new), h, rank.value)
            of = pa.array(doc[new])
            found = {"doc_id": b.column(0).take(of), "text_hash": b.column(1).take(of), "line": pa.array(line[new], pa.int32()), **sets.described(at, number)}
            yield pa.RecordBatch.from_arrays(list(found.values()), list(found))

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, f"doc_id long, text_hash long, line int, {sets.SETS}")


def line_texts(docs: DataFrame, near: DataFrame, rank: Broadcast) -> DataFrame:
    """(id, words, n_words, signature) of the lines near(id, doc_id, text_hash, line); the different words with one space between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()  # rows that repeat a document mostly come to one task; what comes twice all the same changes no result
        for b in batches:
            ids, words, sizes = [], [], []
            for text, wanted in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
                if wanted[0]["id"] in done:
                    continue
                done.add(wanted[0]["id"])
                lines = text.split(b"\n")
                for w in wanted:
                    some = set(lines[w["line"]].lower().split())
                    ids.append(w["id"]), words.append(b" ".join(some)), sizes.append(len(some))
            texts = pa.array(words, pa.binary()).cast(pa.string())
            of, _, h = sets.words_of(texts)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids), texts, pa.array(sizes, pa.int32()), *sets.signatures(*sets.as_sets(of, h, rank.value))], ["id", "words", "n_words", *(f"s{i}" for i in range(sets.LONGS))])

    wanted = near.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("line", "id")).alias("wanted"))
    df = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(keyed_once(wanted), ["doc_id", "text_hash"])
    return df.select("text", "wanted").mapInArrow(run, f"id long, words string, n_words int, {sets.SIGNATURE}")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (id1, id2), the id1 whose words really match."""
    texts = keyed_once(texts.select("id", "words", "n_words"))  # under one name on both sides: dealt out once
    both = pairs.join(texts.alias("a"), F.expr("id1 = a.id")).join(texts.alias("b"), F.expr("id2 = b.id"))
    shared = "size(array_intersect(split(a.words, ' '), split(b.words, ' ')))"
    return both.where(f"9 * {shared} >= 4 * (a.n_words + b.n_words)").select(F.col("id1").alias("id")).distinct()


def matched(later: DataFrame, signed: DataFrame, texts: DataFrame, share: int, found: DataFrame | None) -> DataFrame:
    """The id of found and of those that a round of the join adds. Nothing that it has dealt out is held any longer."""

    def candidates() -> DataFrame:
        left = later if found is None else later.join(keyed_once(found), "id", "left_anti")
        some = sets.pairs(left, signed, EARLIER, share, ["a.id as id1", "b.id as id2"])
        return some.groupBy("id1").agg(F.min_by("id2", "differ").alias("id2")) if share > 1 else some.select("id1", "id2").distinct()

    more = verified(checkpoint(candidates()), texts)
    return more if found is None else found.unionByName(more)


#: Which of two lines stands earlier; lines at one place are those of texts that share a doc_id.
EARLIER = "b.doc_id < a.doc_id or b.doc_id = a.doc_id and (b.line < a.line or b.line = a.line and b.text_hash < a.text_hash)"


def later_matches(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines (doc_id, text_hash, line, sig, sig2), and the classes of equal word sets (sig, sig2, first_doc,
    first_line, first_hash, n, matches): where a class first stands, its lines, and whether that first line matches one
    of a class that stands earlier.

    Lines with equal word sets are one class. A semi-join finds the classes with possible matches; only their words
    are fetched. In each round (sets.pairs) a class still without a match is verified against its closest partner
    that takes part, in the last one against all.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null")
    small_batches(spark)
    total = sets.counted(docs, lambda texts: sets.words_of(texts)[2])
    rank = spark.sparkContext.broadcast(sets.in_order(total))
    every = written(line_rows(docs, rank))
    first = F.min(F.struct("doc_id", "line", "text_hash", "size", "bits", "prefix")).alias("first")
    classes = every.groupBy("sig", "sig2").agg(first, F.count(F.lit(1)).alias("n"))
    classes = written(classes.select("sig", "sig2", "first.*", "n", F.monotonically_increasing_id().alias("id")))
    lines = written(every.select("doc_id", "text_hash", "line", "sig", "sig2"))
    discard(every)

    rows = sets.near_rows(classes, long_from=sets.common(total))
    near = written(classes.select("id", "doc_id", "line", "text_hash").join(keyed_once(rows.select("id")), "id", "left_semi"))
    texts = written(line_texts(docs, near, rank))
    place = F.struct("doc_id", "line", "text_hash")
    placed = written(rows.join(keyed_once(near), "id"))
    lists = checkpoint(placed.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1"))
    signed = written(placed.join(keyed_once(lists), "word").withColumn("later", place > F.col("first")).drop("first").join(keyed_once(texts.drop("words", "n_words")), "id"))
    discard(rows, placed)
    found, later = None, signed.where("later")  # the first row of a list has no earlier partner in it
    for share in sets.shares(lists.agg(F.max("n")).first()[0] or 0):
        found = checkpoint(matched(later, signed, texts, share, found))
    out = classes.join(keyed_once(found.withColumn("matches", F.lit(True))), "id", "left")
    out = out.selectExpr("sig", "sig2", "doc_id as first_doc", "line as first_line", "text_hash as first_hash", "n", "coalesce(matches, false) as matches")
    out = written(out)
    discard(classes, near, texts, signed)
    return lines, out


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, gone): the numbers of the lines to remove, for the documents that have any."""
    lines, classes = later_matches(docs)
    first = "doc_id = first_doc and line = first_line and text_hash = first_hash"
    gone = lines.join(keyed_once(classes.where("n > 1 or matches")), ["sig", "sig2"]).where(f"matches or not ({first})")
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("gone"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with line_text (text without the lines that match an earlier one), n_lines and n_removed beside row.

    A line is the set of its words between white space, A-Z lower-cased; lines match at a Jaccard similarity of
    0.8 or more. A line is removed if an earlier one matches it, removed itself or not; earlier is a smaller doc_id,
    then a smaller line number. Lines without words stay. Rows that repeat a doc_id with the same text are one
    document. Rows with a null doc_id or text stay as they are. Columns of docs are in the struct row.
    """
    found = checkpoint(removed_lines(docs))
    found = found.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "gone")
    df = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", F.xxhash64("text").alias("text_hash"))
    df = df.join(keyed_once(found), F.expr("doc_id = gone_id and text_hash = gone_hash"), "left")
    kept = "array_join(filter(split(text, '\\n'), (x, i) -> not array_contains(gone, i)), '\\n')"
    return df.select(
        "row",
        F.expr(f"case when gone is null then text else {kept} end").alias("line_text"),
        F.expr("cast(size(filter(split(coalesce(text, ''), '\\n'), x -> x rlike '[^ \\t-\\r]')) as bigint)").alias("n_lines"),
        F.expr("cast(coalesce(size(gone), 0) as bigint)").alias("n_removed"),
    )


def drop_lines(docs: DataFrame) -> DataFrame:
    """docs with the repeated lines out of text, and n_chars anew; documents left without a word go, those that had
    none before stay. Columns as in docs."""
    df = line_dedup(docs).where("n_lines = 0 or n_removed < n_lines")
    new = {"text": F.col("line_text"), "n_chars": F.length("line_text").cast("long")}
    return df.select(*(new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: its lines with words, how many go, and the digest of the text that stays."""
    df = line_dedup(table(spark, sf_dir, "documents"))
    return df.select("row.doc_id", "n_lines", "n_removed", F.sha2("line_text", 256).alias("kept_sha256"))
