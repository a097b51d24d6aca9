"""op1 against a brute-force computation over all pairs."""

import re

import pytest
import xxhash

from quillmesh.llm import simhash as S
from quillmesh.llm.common import components
from tests.llm.util import docs, lower, sample, texts_of


def fingerprint(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(texts, n=3):
    fps = {i: fingerprint(t, n) for i, t in texts.items()}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (f"{fps[i]:016x}", find(i)) for i in fps}


def got(df):
    return {r.doc_id: (f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in df.collect()}


def test_sample(spark):
    df = sample(spark)
    assert got(S.near_duplicates(df)) == brute(texts_of(df))


def test_query_has_a_row_for_each_document(spark):
    rows = S.op1_simhash(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == brute(texts_of(sample(spark)))


def test_chains_of_close_fingerprints(spark):
    """Fingerprints that link only through others, at word and sign boundaries."""
    base = 0x8000000000000001
    chain = [base, base ^ 3, base ^ 15, base ^ 63, base ^ (1 << 63), 0x0F0F0F0F0F0F0F0F, 0x0F0F0F0F0F0F0F0F ^ (7 << 20)]
    signed = [x - (1 << 64) if x >> 63 else x for x in chain]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    near = {r.fp for r in S.linked(df).collect()}
    assert near == set(signed[:5])
    roots = {r.node: r.root for r in components(S.links(S.linked(df))).collect()}
    assert len({roots[x] for x in signed[:5]}) == 1


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    texts = [None, "", " \t\n", "a", "A", "a b", "a b c", "a b c", "É\x0b b\x1cc  d", long]
    df = docs(spark, texts)
    assert got(S.near_duplicates(df)) == brute(dict(enumerate(texts)))
    assert S.near_duplicates(df.limit(0)).collect() == []
    assert S.keep_one(df).columns == df.columns
    kept = {r.doc_id for r in S.keep_one(df).collect()}
    assert kept == {c for _, c in brute(dict(enumerate(texts))).values()}


def test_null_and_repeated_ids(spark):
    df = docs(spark, ["x y z", "x y z", "x y z", "other one here", "other one here", "lone words stand"], [None, 4, 4, None, None, 9])
    rows = S.near_duplicates(df).collect()
    assert sum(r.n_rows for r in rows) == 6
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == [(-1, -1), (-1, 4), (4, 4), (9, 9)]
    assert sorted((r.doc_id or -1) for r in S.keep_one(df).collect()) == [-1, 4, 9]


def test_null_and_repeated_ids_of_different_texts(spark):
    """Two groups whose ids are null, two texts of one id, and a group whose smallest id also has another text."""
    texts = ["x y z", "x y z", "other one here", "lone words stand", "some more to read", "third text of all", "third text of all", "x y z again and again"]
    ids = [None, None, None, 9, 9, 9, 12, None]
    kept = sorted((r.doc_id or -1, r.text) for r in S.keep_one(docs(spark, texts, ids)).collect())
    assert kept == sorted([(-1, "x y z"), (-1, "other one here"), (9, "lone words stand"), (9, "some more to read"), (9, "third text of all"), (-1, "x y z again and again")])


@pytest.mark.parametrize("n", [1, 5])
def test_other_shingles(spark, n):
    df = sample(spark).limit(60)
    texts = texts_of(df)
    assert got(S.near_duplicates(docs(spark, list(texts.values()), list(texts)), n)) == brute(texts, n)
