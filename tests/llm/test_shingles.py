"""The near-dedup stage against all pairs: fingerprints within 2 bits, or a Jaccard similarity of 0.8 or more."""

import random

import pyarrow as pa

import corpus_pipeline as P
from quillmesh.llm import shingles
from tests.llm.test_simhash import fingerprint
from tests.llm.util import docs, lower


def grams(text, n=5):
    w = [x for x in lower(text).split()]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(texts):
    """The places of the texts that stay: the first of each component."""
    fps, sets, root = [fingerprint(t, 5) for t in texts], [grams(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 or sets[i] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return set(root)


def edited(rnd, text, n):
    w = text.split()
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
    return " ".join(w)


def test_near_copies(spark):
    """Families of copies with edited words, chains of edits, cut texts, other line breaks and a common passage."""
    rnd = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [None, "", "one two", "One  two", "one two three"]
    for f in range(6):
        text = " ".join(f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([40, 150, 400]))) + " " + passage
        texts += [text, text.replace(" ", "\n", 40), text.upper(), text.rsplit(" ", 12)[0]]
        texts += [edited(rnd, text, n) for n in (1, 1, 2, 3, 5, 9, 20)]
        for _ in range(6):
            text = edited(rnd, text, 2)
            texts.append(text)
    rnd.shuffle(texts)
    kept = P.simhash_near_dedup(spark, docs(spark, texts), "")
    assert {r.doc_id for r in kept.collect()} == brute(texts)
    assert len(brute(texts)) < len({fingerprint(t, 5) for t in texts}) - 20  # the fingerprints alone leave many


def test_null_ids_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(100))
    df = docs(spark, [text + " a", text + " b", "other " * 9, text, "lone words"], [None, 5, None, 4, 4])
    kept = sorted((r.doc_id or -1, r.text) for r in P.simhash_near_dedup(spark, df, "").collect())
    assert kept == sorted([(4, text), (4, "lone words"), (-1, "other " * 9)])
    assert P.simhash_near_dedup(spark, df.limit(0), "").collect() == []


def test_sets_of_hashes_are_those_of_shingles():
    texts = ["", "a", "a b c d e", None, "A b\nc  d e f a b c d e", "x " * 50, "é ü", "y" * 1000 + " z", "last word\t"]
    of, h = shingles.shingles_of(pa.array(texts, pa.string()), 5)
    for i, text in enumerate(texts):
        own = set(h[of == i].tolist())
        assert len(own) == len(shingles.shingle_set((text or "").encode(), 5)) == len(grams(text))
    of, h = shingles.shingles_of(pa.array(["skipped", *texts, "p q r s t", "P q r s T"], pa.string()).slice(1), 5)
    assert set(h[of == 9].tolist()) == set(h[of == 10].tolist()) and of.max() == 10
    assert len(shingles.shingles_of(pa.array([], pa.string()), 5)[0]) == 0


def test_a_large_star_of_near_copies(spark):
    """Each copy has edits of its own, so that copies match the base more than each other; the base comes last."""
    rnd = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(300):
        w = list(base)
        at = rnd.randrange(110)
        w[at : at + 2] = [f"e{rnd.randrange(10**9)}" for _ in range(2)]
        texts.append(" ".join(w))
    texts.append(" ".join(base))
    kept = P.simhash_near_dedup(spark, docs(spark, texts), "")
    assert {r.doc_id for r in kept.collect()} == brute(texts) == {0}
