"""Packing: documents become windows of a fixed number of tokens, by best-fit decreasing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, written
from .tokens import WordEncoder, vocabulary

#: Tokens in a window, and the id that ends a document.
WINDOW, END = 2048, 1
#: Pieces that are packed together: bounds a task, and few enough windows stay open beside so many.
GROUP = 4096
#: Windows of packed pieces are numbered from here, full ones below.
PACKED = 1 << 62

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, ids: bool = False) -> DataFrame:
    """Each document's tokens and END, cut into full windows and a rest: doc_id, start, length, ids_crc32,
    doc_tokens, and on demand the ids themselves (little-endian unsigned 32-bit)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = WordEncoder(tokenizer), END.to_bytes(4, "little")
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                every = encode(text or "") + end
                n = len(every) // 4
                for at in range(0, n, window):
                    part = every[4 * at : 4 * (at + window)]
                    rows.append((doc, at, len(part) // 4, zlib.crc32(part), n, part))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64()] * 5 + [pa.binary()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + ids], names[: 5 + ids])

    return docs.select("doc_id", "text").mapInArrow(run, PIECE + ", ids binary" * ids)


class OpenWindows:
    """A segment tree over remaining capacities: how many open windows there are in each range of room left."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def change(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, which: int) -> None:
        if room:
            self.open[room].append(which)
            self.change(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The window with the least room that is enough, and that room."""
        at = least + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        self.change(room, -1)
        return self.open[room].pop(), room


def best_fit(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(window number, offset) of each piece; lengths come in decreasing order."""
    tree, n, out = OpenWindows(window), 0, []
    for length in lengths:
        got = tree.take(length)
        if got is None:
            got, n = (n, window), n + 1
        which, room = got
        out.append((which, window - room))
        tree.put(room - length, which)
    return out


def pack(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """The pieces of a written table (doc_id, start, length, ...) with sequence_id and offset.

    A full piece is a window of its own. The others are dealt out row by row to groups of about GROUP, whatever
    their keys, and each group is packed best-fit decreasing; as many groups as the table needs.
    """
    full = cut.where(F.col("length") == window)
    full = full.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = cut.where(F.col("length") < window)
    groups = max(1, -(-rest.count() // GROUP))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        placed = best_fit(part["length"].tolist(), window)
        part["sequence_id"] = [PACKED + key[0] * GROUP * 1024 + w for w, _ in placed]
        part["offset"] = [at for _, at in placed]
        return part.drop(columns="bin")

    # ids begin at a multiple of 2^33 in each partition: its number moves where its rows begin
    rest = rest.withColumn("bin", F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(groups)))
    rest = rest.groupBy("bin").applyInPandas(run, full.schema)
    return full.unionByName(rest)


def packed(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, ids: bool = False) -> DataFrame:
    """Pieces of all rows of docs(doc_id, text, ...) and where they lie in windows of so many tokens.

    Null texts are empty ones: their piece is END alone. Rows with a null or repeated doc_id are packed like any
    other; an empty table gives no rows; further columns are not read. ids=True adds each piece's ids.
    """
    return pack(written(pieces(docs, tokenizer or vocabulary("word_bpe_49k.json"), window, ids)), window)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of documents with its window and offset."""
    return packed(table(spark, sf_dir, "documents"))
