"""Benchmark decontamination: winnowed k-gram fingerprints are joined, hits extended to shared windows of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Filter, bloom, checkpoint, small_batches, table, written

#: Words in a window, in a fingerprint, and fingerprints in a winnowing window: any shared WINDOW words have one in common.
WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1
#: Bits of the filter of benchmark fingerprints that goes to every task (512 KB, whatever the benchmark's size).
FILTER_BITS = 1 << 22
#: Bytes that are no part of a word: ASCII but for digits and lower-case letters.
WORDS = bytes(b if b > 127 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else 32 for b in range(256))

MARK = "struct<size: int, hash: long, at: long, before: string, core: string, after: string>"
MARKS = pa.list_(pa.struct([("size", pa.int32()), ("hash", pa.int64()), ("at", pa.int64()), ("before", pa.string()), ("core", pa.string()), ("after", pa.string())]))


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(WORDS).split()


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words, of the words' own hashes."""
    size, out = max(0, len(h) - n + 1), np.full(max(0, len(h) - n + 1), n, np.uint64)
    for i in range(n):
        out = (out ^ h[i : i + size]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def winnow(g: np.ndarray) -> np.ndarray:
    """The places of the smallest fingerprint, the last of equal ones, of each SPAN consecutive ones."""
    if len(g) < SPAN:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(g, SPAN)[:, ::-1]
    return np.unique(np.arange(len(views)) + SPAN - 1 - views.argmin(axis=1))


def marks(w: list[bytes], short: list[int], seen: Filter | None, whole: bool) -> list[dict]:
    """The fingerprints of a text with the words around them; of a document those alone that the filter lets pass.

    Items of fewer words than a window (whole) have one fingerprint, of all their words, and their number as size;
    in documents every place has one of each such number (short).
    """
    h, out = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w)), []
    found = []
    if len(w) >= WINDOW:
        found.append((0, GRAM, winnow(grams(h, GRAM)), WINDOW - GRAM))
    elif whole and w:
        found.append((len(w), len(w), np.zeros(1, np.int64), 0))
    found += [(n, n, np.arange(max(0, len(w) - n + 1)), 0) for n in short]
    for size, n, at, wide in found:
        g = grams(h, n)
        if seen is not None:
            at = at[seen(g[at])]
        for p, value in zip(at.tolist(), g[at].view(np.int64).tolist(), strict=True):
            around = w[max(0, p - wide) : p], w[p : p + n], w[p + n : p + n + wide]
            before, core, after = (b" ".join(x).decode() for x in around)
            out.append({"size": size, "hash": value, "at": p, "before": before, "core": core, "after": after})
    return out


def marked(df: DataFrame, key: str, short: list[int], seen: Broadcast | None, whole: bool) -> DataFrame:
    """(uid, key, text_hash, n_words, marks) for each row."""
    small_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, found = [], []
            for t in b.column(3).cast(pa.binary()).to_pylist():
                w = words(t or b"")
                n.append(len(w))
                found.append(marks(w, short, seen and seen.value, whole))
            arrays = [b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(found, MARKS)]
            yield pa.RecordBatch.from_arrays(arrays, ["uid", key, "text_hash", "n_words", "marks"])

    uid = F.monotonically_increasing_id().alias("uid")
    out = f"uid long, {key} {kind}, text_hash long, n_words long, marks array<{MARK}>"
    return df.select(uid, key, F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, out)


def same(a: str, b: str) -> str:
    """How many words two arrays begin with in common."""
    least = f"least(size({a}), size({b}))"
    first = f"array_position(zip_with(slice({a}, 1, {least}), slice({b}, 1, {least}), (x, y) -> x = y), false)"
    return f"case when {first} = 0 then {least} else {first} - 1 end"


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For each row of docs(doc_id, text, ...): doc_id, text_hash, n_words, n_hit, n_items, items (the sorted ids as strings).

    A window is WINDOW consecutive words of an item of benchmark(item_id, text, ...), or all words of a shorter
    one; n_hit counts the words inside any occurrence of one. A null text has no words; items without words are
    left out, those with a null id count in n_hit but are not listed; repeated items count once, repeated documents keep their rows. Empty tables are
    fine on either side. Further columns are not read.
    """
    spark = docs.sparkSession
    items = marked(benchmark, "item_id", [], None, True).where("n_words > 0")
    items = checkpoint(items.select("item_id", F.inline("marks")))
    variants = checkpoint(items.groupBy("size", "hash", "before", "core", "after").agg(F.min("at").alias("at")).select("*", F.monotonically_increasing_id().alias("variant")))
    same_text = ["size", "hash", "before", "core", "after"]
    owners = checkpoint(items.join(variants.drop("at"), same_text).where("item_id is not null").select("variant", "item_id").distinct())
    short = sorted(r[0] for r in variants.where("size > 0").select("size").distinct().collect())  # below WINDOW
    seen = spark.sparkContext.broadcast(bloom(variants.select(F.col("hash").alias("key")), FILTER_BITS))

    found = written(marked(docs, "doc_id", short, seen, False))
    hits = found.where("size(marks) > 0").select("uid", F.inline("marks"))
    hits = hits.withColumnsRenamed({"before": "b2", "after": "a2"})
    both = hits.join(variants.drop("at"), ["size", "hash", "core"])
    flat = lambda c: f"array_remove(split({c}, ' '), '')"
    both = both.selectExpr(
        "uid", "variant", "at", "size", f"reverse({flat('before')}) as l1", f"reverse({flat('b2')}) as l2", f"{flat('after')} as r1", f"{flat('a2')} as r2"
    )
    both = both.selectExpr("uid", "variant", "at", "size", f"{same('l1', 'l2')} as l", f"{same('r1', 'r2')} as r")
    spans = both.where(f"size > 0 or l + {GRAM} + r >= {WINDOW}")
    spans = checkpoint(spans.selectExpr("uid", "variant", "at - l as a", f"at + case when size > 0 then size else {GRAM} end + r as b").distinct())

    before = Window.partitionBy("uid").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    places = spans.select("uid", "a", "b").distinct().withColumn("upto", F.coalesce(F.max("b").over(before), F.lit(0)))
    n_hit = places.groupBy("uid").agg(F.sum(F.expr("greatest(0L, b - greatest(a, upto))")).alias("n_hit"))
    of = spans.select("uid", "variant").distinct().join(owners, "variant").select("uid", "item_id").distinct()
    of = of.groupBy("uid").agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    out = found.select("uid", "doc_id", "text_hash", "n_words").join(n_hit, "uid", "left").join(of, "uid", "left")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.select("doc_id", "text_hash", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a contaminated word; columns as in docs. Rows are told apart by doc_id and text, so a
    row with a null or repeated doc_id stays or goes by its own text."""
    bad = contamination(docs, benchmark).where("n_hit > 0").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64("text") == F.col("bad_hash"))
    return docs.join(checkpoint(bad.distinct()), same, "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document stands in the benchmark."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


WORD_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = f"""
with d as (select doc_id, {WORD_SQL} as w from documents),
i as (select item_id, {WORD_SQL} as w from benchmark),
k as (select item_id, w, least({WINDOW}, len(w)) as n from i where len(w) > 0),
iw as (select distinct item_id, n, array_to_string(w[s : s + n - 1], ' ') as t from (select *, unnest(range(1, len(w) - n + 2)) as s from k)),
dw as (select doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') as t
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, (select distinct n from iw) where len(w) >= n)),
h as (select doc_id, item_id, s, dw.n from dw join iw on dw.t = iw.t and dw.n = iw.n),
c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from (select distinct doc_id, s, n from h)) group by doc_id),
o as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from h group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c on d.doc_id = c.doc_id left join o on d.doc_id = o.doc_id
"""
