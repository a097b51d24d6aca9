"""op10 against a plain computation."""

import re
from collections import Counter

from quillmesh.llm import quality as Q
from tests.llm.util import docs, sample, texts_of


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, windows = len(w), Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + k for i in range(n - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    m = dict(
        n_words=n, word_chars=sum(map(len, w)), n_symbols=len(re.findall(r"[#*$%&|<>]", text)), n_capitals=len(re.findall("[A-Z]", text)),
        n_lines=len(lines), n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(hit),
    )
    rules = [
        n < 50, 100 * m["n_repeat_words"] > 50 * n, 10 * m["n_symbols"] > n, 2 * m["n_dup_lines"] > m["n_lines"],
        2 * m["n_capitals"] > m["word_chars"], m["word_chars"] < 2 * n, m["word_chars"] > 15 * n,
    ]
    return m | {"failed": sum(1 << i for i, x in enumerate(rules) if x)}


def got(df):
    return {r.row.doc_id: {k: r[k] for k in [*Q.MEASURES, "failed"]} for r in Q.ledger(df).collect()}


TEXTS = [
    None, "", " \n\t\x0b\x0c\r", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x y z x y", "l\nl\n\nl \n l", "é ü\xa0ñ # * < É",
    "A B C " * 30, "one two three four five. " * 4000, "#" * 5000, "w1 w2 w3 10 w1 w2 w3 9", "a\x1cb c\x0bd",
]


def test_edge_cases(spark):
    df = docs(spark, TEXTS)
    assert got(df) == {i: brute(t) for i, t in enumerate(TEXTS)}
    assert Q.ledger(df.limit(0)).collect() == []
    assert Q.ledger(docs(spark, ["x", "x"], [None, None])).count() == 2


def test_sample(spark):
    df = sample(spark)
    assert got(df) == {i: brute(t) for i, t in texts_of(df).items()}


def test_policies(spark):
    df = sample(spark)
    kept = Q.keep_good(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, t in texts_of(df).items() if not brute(t)["failed"]}


def test_ablations(spark):
    df = sample(spark)
    bits = [brute(t)["failed"] for t in texts_of(df).values()]
    for r in Q.ablations(Q.ledger(df)).collect():
        mask, bit = Q.mask(r.policy), Q.BITS[r.rule]
        assert (r.n_docs, r.n_failed, r.n_kept, r.n_kept_without) == (
            len(bits), sum(b & bit > 0 for b in bits), sum(b & mask == 0 for b in bits), sum(b & (mask & ~bit) == 0 for b in bits)
        )


def test_good_documents_stay(spark):
    """Of documents labelled as good, those that the base rules pass are kept; most of the bad ones go."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = Q.op10_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("not base_failed").collect()
    assert all(r.kept for r in rows if r.quality == 1)
    bad = [r for r in rows if r.quality == 0]
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)
