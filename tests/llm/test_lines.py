"""op2 against all pairs of lines."""

import re

from quillmesh.llm import lines as L
from tests.llm.util import docs, lower, sample, texts_of


def brute(texts):
    every = []
    for i, t in sorted(texts.items()):
        for n, line in enumerate((t or "").split("\n")):
            if found := frozenset(w for w in re.split("[ \t-\r]+", lower(line)) if w):
                every.append((i, n, found))
    gone = set()
    for k, (i, n, x) in enumerate(every):
        if any(9 * len(x & y) >= 4 * (len(x) + len(y)) for _, _, y in every[:k]):
            gone.add((i, n))
    return {i: t if t is None else "\n".join(line for n, line in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in texts.items()}, gone


def got(df):
    return {r.row.doc_id: r.line_text for r in L.line_dedup(df).collect()}


def test_sample(spark):
    df = sample(spark)
    want, gone = brute(texts_of(df))
    assert got(df) == want
    assert sum(r.n_removed for r in L.op2_line_dedup(spark, "/root/testdata/sf0.001").collect()) == len(gone)


def test_families_of_near_copies(spark):
    """Many variants of one line, chains, common and rare words, sizes around the threshold."""
    base = [f"w{i}" for i in range(20)]
    texts = {0: " ".join(base)}
    for k in range(1, 60):
        w = list(base)
        w[k % 20] = f"x{k}"
        if k % 3 == 0:
            w[(k * 7) % 20] = f"y{k}"
        if k % 5 == 0:
            w += ["z1", "z2", "z3", f"z{k}"]
        texts[k] = " ".join(w) + f"\nfresh{k} line{k} of{k} its{k} own{k}\na b c d {'e' if k % 2 else ''}"
    want, _ = brute(texts)
    assert got(docs(spark, list(texts.values()), list(texts))) == want


def test_edge_cases(spark):
    texts = {0: None, 1: "", 2: "\n \n\t", 3: "Same Words here\nwords same HERE\n\nx", 4: "same words here", 5: "x\r\ny é É", 6: " ".join(f"v{i}" for i in range(50_000)), 7: " ".join(f"v{i}" for i in range(1, 50_000))}
    df = docs(spark, list(texts.values()), list(texts))
    want, _ = brute(texts)
    assert got(df) == want
    kept = L.drop_lines(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {0, 1, 2, 3, 5, 6}
    assert L.line_dedup(df.limit(0)).collect() == []


def test_null_and_repeated_ids(spark):
    df = docs(spark, ["one two three", "one two three", "one two three", "one two three\nnew words stand"], [None, 1, 1, 2])
    rows = sorted((r.row.doc_id or -1, r.line_text, r.n_removed) for r in L.line_dedup(df).collect())
    assert rows == [(-1, "one two three", 0), (1, "one two three", 0), (1, "one two three", 0), (2, "new words stand", 1)]
