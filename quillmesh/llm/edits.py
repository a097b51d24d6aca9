"""Edit-aware token counts: a segment tree of pre-tokens per document, of which an edit re-encodes only its surroundings."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .tokens import vocabulary

#: Fixed by the vocabulary: how byte_bpe_50k cuts a text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A pre-token is decided by its own characters and at most so many that follow.
LOOK_AHEAD = 3
#: Pre-tokens in a leaf, and in a leaf that has grown too large.
LEAF, LARGE = 64, 512
#: Pre-tokens whose counts a worker remembers; beyond, it starts anew.
MEMORY = 400_000


class Counter(dict):
    """Number of tokens of a pre-token, each encoded once."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(PATTERN).findall

    def __missing__(self, word: str) -> int:
        if len(self) > MEMORY:
            self.clear()
        self[word] = n = len(self.encoding.encode_ordinary(word))
        return n


class TokenTree:
    """Leaves of consecutive pre-tokens; every node has the sums of characters and tokens below it."""

    def __init__(self, text: str, counter: Counter, kept: list[dict] | None = None) -> None:
        """A new tree of a text, or the one that kept() has described: then nothing is cut or encoded."""
        self.counter = counter
        self.encoded = 0
        if kept is None:
            self.build(counter.cut(text))
            return
        leaves, at = [], 0
        for leaf in kept:
            ends = list(accumulate(leaf["sizes"], initial=at))
            leaves.append([text[a:b] for a, b in pairwise(ends)])
            at = ends[-1]
        self.grow(leaves or [[]], [leaf["tokens"] for leaf in kept])

    def kept(self) -> list[dict]:
        """The leaves as rows: the lengths of their pre-tokens and their tokens; empty ones go."""
        return [{"sizes": list(map(len, words)), "tokens": self.tokens[self.size + i]} for i, words in enumerate(self.leaves) if words]

    def build(self, words: list[str]) -> None:
        self.grow([words[i : i + LEAF] for i in range(0, len(words), LEAF)] or [[]])

    def grow(self, leaves: list[list[str]], tokens: list[int] | None = None) -> None:
        self.leaves = leaves
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i in range(len(self.leaves)):
            if tokens:
                self.chars[self.size + i], self.tokens[self.size + i] = sum(map(len, self.leaves[i])), tokens[i]
            else:
                self.weigh(i)
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def weigh(self, leaf: int) -> None:
        words = self.leaves[leaf]
        self.chars[self.size + leaf] = sum(map(len, words))
        self.tokens[self.size + leaf] = sum(map(self.counter.__getitem__, words))

    def update(self, leaf: int) -> None:
        self.weigh(leaf)
        at = (self.size + leaf) >> 1
        while at:
            self.chars[at] = self.chars[2 * at] + self.chars[2 * at + 1]
            self.tokens[at] = self.tokens[2 * at] + self.tokens[2 * at + 1]
            at >>= 1

    def find(self, at: int) -> tuple[int, int]:
        """The leaf with the character at this place, or the last, and where the leaf begins."""
        node, begin = 1, 0
        while node < self.size:
            node *= 2
            if at >= begin + self.chars[node] and self.chars[node + 1]:
                begin += self.chars[node]
                node += 1
        return node - self.size, begin

    def edit(self, at: int, cut: int, put: str) -> None:
        """Replace cut characters at this place; places beyond the text are its end."""
        n = self.chars[1]
        at = min(max(0, at), n)
        cut = min(max(0, cut), n - at)
        if not cut and not put:
            return
        first, begin = self.find(max(0, at - LOOK_AHEAD))
        kept, start = [], begin
        for w in self.leaves[first]:
            if start + len(w) + LOOK_AHEAD > at:
                break
            kept.append(w)
            start += len(w)
        # what follows: old words from start on, leaf by leaf, until the new words fall in step with the old
        last, words, ends = first, self.leaves[first][len(kept) :], []
        upto = start
        for w in words:
            upto += len(w)
            ends.append(upto)
        while True:
            old = "".join(words)
            new = old[: at - start] + put + old[at - start + cut :]
            whole = last + 1 >= len(self.leaves)
            if upto >= at + cut:
                steps, fresh, place, joins = {start: 0} | {e: i + 1 for i, e in enumerate(ends)}, [], start, None
                for w in self.counter.cut(new):
                    if place >= at + len(put) and (i := steps.get(place - len(put) + cut)) is not None and i < len(words):
                        joins = i
                        break
                    if not whole and place + len(w) + LOOK_AHEAD > start + len(new):
                        break
                    fresh.append(w)
                    place += len(w)
                else:
                    joins = len(words) if whole else None
                if joins is not None:
                    break
            last += 1
            for w in self.leaves[last]:
                upto += len(w)
                ends.append(upto)
            words = words + self.leaves[last]
        self.encoded += len(fresh)
        self.leaves[first] = kept + fresh + words[joins:]
        if len(self.leaves[first]) > LARGE:
            self.leaves[first + 1 : last + 1] = []
            self.build([w for leaf in self.leaves for w in leaf])
            return
        for i in range(first + 1, last + 1):
            self.leaves[i] = []
            self.update(i)
        self.update(first)

    def text(self) -> str:
        return "".join(w for leaf in self.leaves for w in leaf)


LEAVES = pa.list_(pa.struct([("sizes", pa.list_(pa.int32())), ("tokens", pa.int64())]))
LEAVES_SQL = "array<struct<sizes: array<int>, tokens: long>>"
EDITS = "array<struct<at: long, cut: long, put: string>>"


def trees(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, text, leaves): the trees of docs, to be written as a table that apply_edits() keeps up to date. Nulls,
    repeats, empty tables and further columns as in apply_edits()."""
    none = F.lit(None)
    return apply_edits(docs.select("doc_id", "text", none.cast(LEAVES_SQL).alias("leaves")), none, tokenizer).select("doc_id", F.col("text_after").alias("text"), "leaves")


def apply_edits(trees: DataFrame, edits: Column, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_after, n_pretokens_after, n_reencoded, text_after, leaves) for each row of
    trees(doc_id, text, leaves): only what the edits touch is encoded; without leaves (null) the whole text is.

    edits: array<struct<at, cut, put>> of the columns, applied in order; each replaces cut characters at a place of
    the text as the edits before have left it. n_reencoded: the pre-tokens encoded for the edits. leaves describe the
    tree after them, for the next batch of edits. A null text counts as empty, null edits as none, a null in an edit
    as 0 or empty; rows are counted one by one, whatever their ids; a very long text is one tree in one task; an
    empty table gives no rows; further columns are not read.
    """
    small_batches(trees.sparkSession)
    path = tokenizer or vocabulary("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for b in batches:
            out: list[list] = [[] for _ in names[1:]]
            for text, kept, todo in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                tree = TokenTree(text or "", counter, kept)
                before = tree.tokens[1]
                for e in todo or []:
                    tree.edit(e["at"] or 0, e["cut"] or 0, e["put"] or "")
                row = before, len(todo or []), tree.tokens[1], sum(map(len, tree.leaves)), tree.encoded, tree.text(), tree.kept()
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            arrays = [pa.array(x, pa.int64()) for x in out[:5]] + [pa.array(out[5], pa.string()), pa.array(out[6], LEAVES)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names)

    names = ["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_pretokens_after", "n_reencoded", "text_after", "leaves"]
    kind = ", ".join(f"{n} long" for n in names[:-2]) + f", text_after string, leaves {LEAVES_SQL}"
    return trees.select("doc_id", "text", "leaves", edits.cast(EDITS).alias("edits")).mapInArrow(run, kind)


def edited_counts(docs: DataFrame, edits: Column, tokenizer: str | None = None) -> DataFrame:
    """apply_edits() on documents whose trees are not kept: each is built, edited and counted in one pass."""
    fresh = docs.select("*", edits.cast(EDITS).alias("_edits")).select("doc_id", "text", F.lit(None).cast(LEAVES_SQL).alias("leaves"), "_edits")
    return apply_edits(fresh, F.col("_edits"), tokenizer)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after three edits: an insertion in the middle, a deletion and a replacement."""
    n = "length(coalesce(text, ''))"
    edits = f"array(struct({n} div 2 as at, 0L as cut, 'inserted words, ' as put), struct({n} div 3 as at, 7L as cut, '' as put), struct(2 * {n} div 3 as at, 5L as cut, ' it''s 42' as put))"
    out = edited_counts(table(spark, sf_dir, "documents"), F.expr(edits))
    return out.select("doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_pretokens_after", "n_reencoded", F.sha2("text_after", 256).alias("text_sha256"))
