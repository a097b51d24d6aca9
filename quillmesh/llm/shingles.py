"""Near-duplicates by an exact set-similarity join: documents whose shingles have a Jaccard similarity of 0.8 or more."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sets
from .common import checkpoint, components, discard, small_batches, written
from .simhash import simhash


def shingles_of(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Text (its place in the array) and hash of each shingle of so many words; a text of fewer is one shingle, one
    without words has none."""
    text, _, h = sets.words_of(texts)
    first = np.searchsorted(text, np.arange(len(texts)))
    n = np.bincount(text, minlength=len(texts))

    def hashed(at: np.ndarray, k: int) -> np.ndarray:
        out = np.full(len(at), k, np.uint64)
        for i in range(k):
            out = sets.mixed(out ^ h[at + i])
        return out

    at = np.arange(max(0, len(h) - words + 1))
    at = at[text[at] == text[at + words - 1]]
    of, found = [text[at]], [hashed(at, words)]
    for k in range(1, words):
        short = np.flatnonzero(n == k)
        of.append(short), found.append(hashed(first[short], k))
    of, found = np.concatenate(of), np.concatenate(found)
    order = np.argsort(of, kind="stable")
    return of[order], found[order]


def shingle_set(text: bytes, words: int) -> set[tuple[bytes, ...]]:
    w = text.lower().split()
    n = min(words, len(w))
    return set(zip(*(w[i : len(w) - n + 1 + i] for i in range(n)), strict=True))


def described(texts: pa.Array, words: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts that have shingles, and their sets as as_sets() in sets."""
    of, h = shingles_of(texts, words)
    return (np.unique(of), *sets.as_sets(of, h, rank))


def ranked(docs: DataFrame, words: int) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast(sets.ranked(docs, lambda texts: shingles_of(texts, words)[1]))


def keyed(docs: DataFrame, words: int, rank: Broadcast) -> DataFrame:
    """(doc_id, text_hash, fp) for each row of docs, fp the SimHash, and its set of shingles as described() in sets; the
    set's columns are null without a word."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([simhash(t or b"", words) for t in b.column(2).cast(pa.binary()).to_pylist()], pa.int64())
            of, at, number = described(b.column(2), words, rank.value)
            place = np.full(b.num_rows, -1)
            place[of] = np.arange(len(of))
            place = pa.array(place, mask=place < 0)
            found = sets.described(at, number) if len(of) else {}
            columns = [x.take(place) if found else None for x in found.values()]
            if not found:
                columns = [pa.nulls(b.num_rows, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fps, *columns], ["doc_id", "text_hash", "fp", "sig", "sig2", "size", "bits", "prefix"])

    kind = f"doc_id long, text_hash long, fp long, {sets.SETS}"
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, kind)


def near_texts(docs: DataFrame, ids: DataFrame, words: int, rank: Broadcast) -> DataFrame:
    """(id, text, signature) for ids(id, key_id, key_hash): whole texts, of those with a possible match alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, at, number = described(b.column(1), words, rank.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *sets.signatures(at, number)], ["id", "text", *(f"s{i}" for i in range(sets.LONGS))])

    same = F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.xxhash64("text") == F.col("key_hash"))
    rows = docs.select("doc_id", "text").join(ids, same).select("id", "text")
    return rows.mapInArrow(run, f"id long, text string, {sets.SIGNATURE}").dropDuplicates(["id"])


def verified(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(src, dst): the components of the pairs (id1, comp1, id2, comp2) whose sets of shingles really match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yes = []
            for one, two in zip(*(b.column(i).cast(pa.binary()).to_pylist() for i in (2, 3)), strict=True):
                s, t = shingle_set(one, words), shingle_set(two, words)
                yes.append(9 * len(s & t) >= 4 * (len(s) + len(t)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["src", "dst"]).filter(pa.array(yes, pa.bool_()))

    texts = texts.select("id", "text")  # under one name on both sides: dealt out once
    both = pairs.join(texts.alias("a"), F.expr("id1 = a.id")).join(texts.alias("b"), F.expr("id2 = b.id")).selectExpr("comp1", "comp2", "a.text as text1", "b.text as text2")
    return both.mapInArrow(run, "src long, dst long").distinct()


def across(signed: DataFrame, found: DataFrame | None) -> DataFrame:
    """The rows of signed under the components that the edges found make, with n, the length of their word's list, for
    the words that stand in more than one component; a written table."""
    if found is not None:
        roots = components(found).select(F.col("node").alias("comp"), "root")
        signed = signed.join(roots, "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root")
    lists = signed.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    return written(signed.join(checkpoint(lists.where("low <> high").select("word", "n")), "word"))


def connected(rows: DataFrame, texts: DataFrame, words: int, share: int, found: DataFrame | None) -> DataFrame:
    """The edges found and those that a round of the join adds. Nothing that it has dealt out is held any longer."""

    def candidates() -> DataFrame:
        columns = ["a.id as id1", "a.comp as comp1", "b.id as id2", "b.comp as comp2"]
        pairs = sets.pairs(rows, rows, "a.comp <> b.comp" if share > 1 else "a.comp < b.comp", share, columns)
        if share == 1:
            return pairs.drop("differ").distinct()
        return pairs.groupBy("id1", "comp1").agg(F.min_by(F.struct("id2", "comp2"), "differ").alias("b")).select("id1", "comp1", "b.*")

    more = verified(checkpoint(candidates()), texts, words)
    return more if found is None else found.unionByName(more)


def similar(docs: DataFrame, keys: DataFrame, edges: DataFrame, words: int, rank: Broadcast) -> DataFrame:
    """Edges (src, dst) between fingerprints that, with the edges given, connect all rows of docs whose sets of
    shingles have a Jaccard similarity of 0.8 or more. keys is keyed(docs, words, rank), written.

    Rows with equal sets are one class. A pair inside a component adds nothing. A semi-join finds the classes with a
    possible match in another component. In each round (sets.pairs) a class is verified against its closest partner
    that takes part, and what this connects is one component in the next; in the last one all pairs between
    components that are left are verified. So a family of near copies makes about as many pairs as it has members.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "fp", "size", "bits", "prefix")).alias("first")
    some = keys.where("size is not null")
    classes = written(some.groupBy("sig", "sig2").agg(first).select("sig", "sig2", "first.*", F.monotonically_increasing_id().alias("id")))
    base = classes.select("sig", "sig2", F.col("fp").alias("src"))
    equal = some.select("sig", "sig2", F.col("fp").alias("dst")).distinct().join(base, ["sig", "sig2"]).where("src <> dst").select("src", "dst")
    edges = checkpoint(edges.unionByName(equal))
    roots = components(edges).select(F.col("node").alias("fp"), "root")
    rows = sets.near_rows(classes.join(roots, "fp", "left").withColumn("comp", F.coalesce("root", "fp")), "comp")
    ids = checkpoint(rows.select("id").distinct()).join(classes, "id").select("id", F.col("doc_id").alias("key_id"), F.col("text_hash").alias("key_hash"))
    texts = written(near_texts(docs, ids, words, rank))
    signed = written(rows.join(texts.drop("text"), "id"))
    discard(classes, rows)

    found = None
    most = signed.groupBy("word").count().agg(F.max("count")).first()[0] or 0
    for share in sets.shares(most):
        now = across(signed, found)
        found = checkpoint(connected(now, texts, words, share, found))
        discard(now)
    discard(texts, signed)
    return edges.unionByName(found)
