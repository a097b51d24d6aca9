"""Exact set-similarity join: word hashes of whole batches, the order by rarity, prefixes, and the filters on them.

Two sets match if their Jaccard similarity is 4/5 or more: 9 shared >= 4 (size1 + size2). A set's members are numbered
by rarity; any match shares a member among the first size - ceil(4/5 size) + 1 of both, its prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Counters of the frequency sketch that orders members by rarity; any common order gives right results.
SKETCH_BITS = 20
SKETCH = 1 << SKETCH_BITS
#: Counters that go to the driver in one row.
BLOCK = 1 << 12
#: Longs of a signature: 512 bits.
LONGS = 8
#: Prefix members that may stand more often than this are joined by Spark, which splits and spills lists of any length.
LONG_LIST = 1 << 18
#: Sets of fewer members match equal sets alone.
LEAST = 4
#: A round of the join meets this many times as many partners as the one before.
STEP = 16

LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes of a word that are hashed by steps over all words; longer words are hashed one by one.
STEPS_TO = 256


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits."""
    x = x ^ x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text (its place in the array), line (of the text) and hash of each word, A-Z lower-cased, nulls as empty texts."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.zeros(int(at[-1] - at[0]) + 8, np.uint8)  # room for the last eight bytes
    n = len(raw) - 8
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    np.take(LOWER, np.frombuffer(data, np.uint8)[at[0] : at[-1]], out=raw[:n])
    at = at - at[0]
    word = (raw[:n] != 32) & (raw[:n] - np.uint8(9) > 4)
    turns = np.empty(n + 1, bool)  # where a word begins or has ended
    turns[0], turns[n] = word[0], word[-1]
    np.not_equal(word[1:], word[:-1], out=turns[1:n])
    turns = np.flatnonzero(turns)
    joint = np.unique(at[(at > 0) & (at < n)])  # texts stand side by side: a word ends with its text
    joint = joint[word[joint] & word[joint - 1]]
    if len(joint):
        turns = np.sort(np.concatenate([turns, joint, joint]))
    start, end = turns[::2], turns[1::2]
    text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, at)))
    breaks = np.flatnonzero(raw[:n] == 10)
    line = np.cumsum(np.bincount(np.searchsorted(start, breaks), minlength=len(start) + 1)[: len(start)]) - np.searchsorted(breaks, at)[text]

    size = end - start
    eight = np.ndarray((n + 1,), "<u8", raw, strides=(1,))
    h = mixed(mixed(size.astype(np.uint64)) ^ eight[start] & KEEP[np.minimum(size, 8)])
    todo = np.flatnonzero((size > 8) & (size <= STEPS_TO))
    here, left = start[todo] + 8, size[todo] - 8
    while len(todo):
        h[todo] = mixed(h[todo] ^ (eight[here] & KEEP[np.minimum(left, 8)]))
        more = left > 8
        todo, here, left = todo[more], here[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > STEPS_TO):
        h[i] = xxhash.xxh64_intdigest(raw[start[i] : end[i]].tobytes())
    return text, line, h


def as_sets(group: np.ndarray, h: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group's members begin, and the different members' numbers, the rarest first. Groups don't fall.

    A number is the rank of the hash's counter, then the rest of the hash: one number a hash.
    """
    slot = (h & np.uint64(SKETCH - 1)).astype(np.int64)
    number = rank[slot].astype(np.uint64) << np.uint64(64 - SKETCH_BITS) | h >> np.uint64(SKETCH_BITS)
    dense = np.cumsum(np.diff(group, prepend=group[:1]) != 0)
    key = dense.astype(np.uint64) << np.uint64(44) | number >> np.uint64(20)
    order = np.argsort(key)
    a, b = order[:-1], order[1:]
    if len(h) and (dense[-1] >> 20 or ((key[a] == key[b]) & (number[a] != number[b])).any()):  # the short key doesn't do
        order = np.lexsort((number, dense))
    number, dense = number[order], dense[order]
    new = np.ones(len(number), bool)
    new[1:] = (number[1:] != number[:-1]) | (dense[1:] != dense[:-1])
    return np.flatnonzero(np.diff(dense[new], prepend=-1)), number[new]


def described(at: np.ndarray, number: np.ndarray) -> dict[str, pa.Array]:
    """For each set: sig and sig2, equal for equal sets (two sums of 64 bits); size; bits, in which two sets differ at
    most as much as in members; prefix."""
    size = np.diff(at, append=len(number))
    n = np.where(size < LEAST, 0, size - -(-4 * size // 5) + 1)
    keep = np.arange(len(number)) - np.repeat(at, size) < np.repeat(n, size)
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    one, two = mixed(number), mixed(number ^ np.uint64(0x9E3779B97F4A7C15))
    add = lambda x: pa.array(np.add.reduceat(x, at).view(np.int64))
    bits = np.bitwise_xor.reduceat(np.uint64(1) << (one >> np.uint64(58)), at).view(np.int64)
    prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(number[keep].view(np.int64)))
    return {"sig": add(one), "sig2": add(two), "size": pa.array(size.astype(np.int32)), "bits": pa.array(bits), "prefix": prefix}


SETS = "sig long, sig2 long, size int, bits long, prefix array<long>"


def signatures(at: np.ndarray, number: np.ndarray) -> list[pa.Array]:
    """512 bits for each set, in which two sets differ at most as much as in members, as columns s0 to s7."""
    slot = mixed(number) >> np.uint64(55)
    bit, part = np.uint64(1) << (slot & np.uint64(63)), slot >> np.uint64(6)
    return [pa.array(np.bitwise_xor.reduceat(np.where(part == i, bit, np.uint64(0)), at).view(np.int64)) for i in range(LONGS)]


SIGNATURE = ", ".join(f"s{i} long" for i in range(LONGS))


def counted(docs: DataFrame, members) -> np.ndarray:
    """How many members each counter of the sketch has.

    members: pa.Array of texts -> hashes of all members, each as often as it stands. Every task counts all its rows;
    BLOCK counters are a row, so that SKETCH / BLOCK rows come to the driver, whatever the input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, slots, waiting = np.zeros(SKETCH, np.int64), [], 0
        for b in batches:
            slots.append((members(b.column(0)) & np.uint64(SKETCH - 1)).astype(np.int32))
            waiting += len(slots[-1])
            if waiting >= SKETCH:  # counted together: a batch has fewer members than there are counters
                total += np.bincount(np.concatenate(slots), minlength=SKETCH)
                slots, waiting = [], 0
        if slots:
            total += np.bincount(np.concatenate(slots), minlength=SKETCH)
        blocks = total.reshape(-1, BLOCK)
        some = np.flatnonzero(blocks.any(axis=1))
        rows = [blocks[i].tobytes() for i in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(rows, pa.binary())], ["block", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in t["counts"].to_pylist())
        return pa.table({"block": t["block"].slice(0, 1).cast(pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})

    kind = "block long, counts binary"
    found = docs.select("text").mapInArrow(count, kind).groupBy("block").applyInArrow(add, kind).toArrow()
    total = np.zeros((SKETCH // BLOCK, BLOCK), np.int64)
    for i, x in zip(found["block"].to_pylist(), found["counts"].to_pylist(), strict=True):
        total[i] = np.frombuffer(x, np.int64)
    return total.ravel()


def in_order(total: np.ndarray) -> np.ndarray:
    """The place of each counter of the sketch in the order of members, the rarest first."""
    out = np.empty(SKETCH, np.uint32)
    out[np.argsort(total, kind="stable")] = np.arange(SKETCH, dtype=np.uint32)
    return out


def ranked(docs: DataFrame, members) -> np.ndarray:
    """The order of members of docs, as in_order()."""
    return in_order(counted(docs, members))


def common(total: np.ndarray) -> int:
    """The first place in the order of members whose counter is over LONG_LIST: a member before it stands in no more sets."""
    return int(np.count_nonzero(total <= LONG_LIST))


#: Length and positional filters on two rows a and b of one prefix member.
MAY_MATCH = "5 * least(a.size, b.size) >= 4 * greatest(a.size, b.size) and 9 * least(a.size - a.pos, b.size - b.pos) >= 4 * (a.size + b.size)"
DIFFER = " + ".join(f"bit_count(a.s{i} ^ b.s{i})" for i in range(LONGS))


#: A prefix member's row, as tasks pack them by buckets of members.
ROW = np.dtype([("word", "<u8"), ("id", "<i8"), ("bits", "<u8"), ("size", "<i4"), ("pos", "<i4")])
#: Rows that a task packs at once; sets to a bucket.
PACKED, BUCKET_SETS = 1 << 18, 1 << 15


def sharing(rows: np.ndarray) -> np.ndarray:
    """Which rows of ROW pass all filters of near_rows() with another row of their word.

    By word and size, a row's longer partners follow it. A row looks at them, the nearest first, until it has one; a row
    without one then looks at the shorter ones that have. Of a pair's shorter set the member stands among the first ninth.
    """
    order = np.lexsort((rows["size"], rows["word"]))
    word = rows["word"][order]
    same = word[1:] == word[:-1]
    order = order[np.append(same, False) | np.insert(same, 0, False)]  # a word of one row has no partner
    rows = rows[order]
    seen = np.zeros(len(rows), bool)
    size, bits = rows["size"].astype(np.int64), rows["bits"]
    left = 9 * (size - rows["pos"])
    run = np.cumsum(np.diff(rows["word"], prepend=rows["word"][:1]) != 0) << 32
    key = run | size
    end = np.searchsorted(key, run | 5 * size // 4, side="right")

    def meet(a: np.ndarray, partner: np.ndarray, last: np.ndarray, others: np.ndarray) -> None:
        """Rows a against others[partner], others[partner + 1] and so on before last."""
        while len(a):
            more = partner < last
            a, partner, last = a[more], partner[more], last[more]
            b = others[partner]
            both = size[a] + size[b]
            yes = (np.minimum(left[a], left[b]) >= 4 * both) & (9 * np.bitwise_count(bits[a] ^ bits[b]).astype(np.int64) <= both)
            seen[a[yes]] = seen[b[yes]] = True
            open_ = ~seen[a]
            a, partner, last = a[open_], partner[open_] + 1, last[open_]

    every = np.arange(len(rows))
    first = np.flatnonzero(left >= 8 * size)
    meet(first, first + 1, end[first], every)
    have = np.flatnonzero(seen & (left >= 8 * size))
    rest = np.flatnonzero(~seen)
    least = np.searchsorted(key, run[rest] | -(-4 * size[rest] // 5))
    meet(rest, np.searchsorted(have, least), np.searchsorted(have, rest), have)
    return order[seen]


def near_hashed(sets: DataFrame, long_from: int) -> DataFrame:
    """near_rows() for the members before the place long_from: rows are packed by buckets of members, as many as the sets
    need, and each bucket finds its own."""
    buckets = -(-sets.count() // BUCKET_SETS) or 1

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
            rows = np.concatenate(parts)
            bucket = (mixed(rows["word"]) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            some, at = np.unique(bucket[order], return_index=True)
            data = [x.tobytes() for x in np.split(rows[order], at[1:])]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])

        parts, waiting = [], 0
        for b in batches:
            prefix = b.column(3)
            n = prefix.value_lengths().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(n)), n)
            rows = np.empty(len(of), ROW)
            rows["word"] = prefix.flatten().to_numpy().view(np.uint64)
            rows["pos"] = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            rows["id"], rows["size"] = b.column(0).to_numpy()[of], b.column(1).to_numpy()[of]
            rows["bits"] = b.column(2).to_numpy().view(np.uint64)[of]
            parts.append(rows[rows["word"] >> np.uint64(64 - SKETCH_BITS) < long_from])
            waiting += len(parts[-1])
            if waiting >= PACKED:
                yield flush(parts)
                parts, waiting = [], 0
        if waiting:
            yield flush(parts)

    def shared(t: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(t["data"].to_pylist()), ROW)
        rows = rows[sharing(rows)]
        return pa.table({"id": rows["id"], "word": rows["word"].view(np.int64), "pos": rows["pos"], "size": rows["size"]})

    rows = sets.select("id", "size", "bits", "prefix").mapInArrow(packed, "bucket int, data binary")
    return rows.groupBy("bucket").applyInArrow(shared, "id long, word long, pos int, size int")


def near_rows(sets: DataFrame, apart: str = "id", long_from: int = 0) -> DataFrame:
    """(id, word, pos, size) for the prefix members that another of sets(id, size, bits, prefix) shares and that pass
    the length, positional and bit filters: a semi-join, so no pairs are made. Sets with an equal column apart don't
    count as others; it is returned too.

    long_from: a place in the order of members, as of common(), if apart is id. The lists of members before it are short,
    and each is searched in one task, by size; the others, which few prefixes have, are joined, at any length."""
    own = list(dict.fromkeys(["id", apart]))
    kept = [c for c in sets.columns if c in {*own, "size", "bits"}]  # as they stand, so that neither side has a step of its own and both are dealt out once
    on = F.expr(f"a.word = b.word and a.{apart} <> b.{apart} and {MAY_MATCH} and 9 * bit_count(a.bits ^ b.bits) <= a.size + b.size")
    from_there = f"shiftrightunsigned(%s, {64 - SKETCH_BITS}) >= {long_from}"
    some = sets.where(from_there % "get(prefix, size(prefix) - 1)") if long_from else sets  # the last is the commonest
    rows = some.select(*kept, F.posexplode("prefix").alias("pos", "word"))
    rows = rows.where(from_there % "word") if long_from else rows
    found = rows.alias("a").join(rows.alias("b"), on, "left_semi").select(*own, "word", "pos", "size")
    return written(found.unionByName(near_hashed(sets, long_from)) if long_from else found)


def shares(most: int) -> list[int]:
    """The rounds of a join over lists of up to most rows: in each, one in so many sets takes part as a partner, in the
    last one all do. In the first, the longest list has about STEP partners."""
    out = [1]
    while out[0] * STEP < most:
        out.insert(0, out[0] * STEP)
    return out


def pairs(rows: DataFrame, partners: DataFrame, on: str, share: int, columns: list[str]) -> DataFrame:
    """(columns..., differ) of the rows and partners that pass all filters, of one in share partners.

    rows have n, the length of their word's list; but in the last round the lists of more than share rows alone count.
    What has found its match in an earlier round no longer takes part, so that a family of n sets that match each
    other makes about n pairs and not their square; the last round meets all partners, so that no match is lost.
    """
    some = partners.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0)
    on = F.expr(f"a.word = b.word and {MAY_MATCH} and ({on}) and 9 * ({DIFFER}) <= a.size + b.size")
    return rows.where(F.col("n") > (share if share > 1 else 0)).alias("a").join(some.alias("b"), on).selectExpr(*columns, f"{DIFFER} as differ")
