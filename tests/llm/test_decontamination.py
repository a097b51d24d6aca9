"""op8 against a search for every window."""

import hashlib
import random
import re

import duckdb

from quillmesh.llm import decontamination as D
from tests.llm.util import docs, lower, sample


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute(texts, items):
    out = {}
    for i, t in texts.items():
        w, hit, found = words(t), set(), set()
        for item, x in items:
            x = words(x)
            n = min(10, len(x))
            windows = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n and item is not None else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add(item)
        out[i] = (len(w), len(hit), sorted(map(str, found)))
    return out


def got(df):
    return {r.doc_id: (r.n_words, r.n_hit, list(r.items)) for r in df.collect()}


def bench(spark, items):
    return spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, at long")


def test_sample_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet/*.parquet'" if __import__("os").path.isdir(f"/root/testdata/sf0.001/{t}.parquet") else f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    want = sorted(con.execute("select doc_id, n_words, n_hit, n_items, items_sha256, contaminated from (" + D.OP8_SQL + ")").fetchall())
    df = D.op8_decontamination(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, df.collect())) == want
    assert any(r[5] for r in want)


def test_random_texts_of_few_words(spark):
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choice("aa bb cc dd".split()) + rnd.choice([" ", ". ", "-", "  "]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([0, 1, 2, 5, 9, 9, 10, 11, 15, 30])] + [(3, text(12)), (None, text(20))]
    texts = {i: text(rnd.randint(0, 80)) for i in range(60)}
    for chosen in (items[4:], items[5:], items):
        assert got(D.contamination(docs(spark, list(texts.values()), list(texts)), bench(spark, chosen))) == brute(texts, chosen)


def test_edge_cases(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    texts = {0: None, 1: "", 2: passage, 3: "x " + passage[:30], 4: passage.upper() + " é", 5: " ".join(f"v{i}" for i in range(100_000)) + " " + passage, 6: "w0 w1 w2 w3 w4 w5 w6 w7 w8", 7: "w0-w1;w2 w3 w4 w5 w6 w7 w8\nw9"}
    items = [(7, passage), (8, passage), (9, None), (10, "")]
    df = docs(spark, list(texts.values()), list(texts))
    assert got(D.contamination(df, bench(spark, items))) == brute(texts, items)
    assert {r.doc_id for r in D.drop_contaminated(df, bench(spark, items)).collect()} == {0, 1, 6}
    assert D.drop_contaminated(df, bench(spark, items)).columns == df.columns
    assert D.contamination(df.limit(0), bench(spark, items)).collect() == []
    assert got(D.contamination(df, bench(spark, []))) == brute(texts, [])
    again = docs(spark, [passage, passage, None, passage], [None, 1, 1, 1])
    rows = D.contamination(again, bench(spark, items)).collect()
    assert sorted((r.doc_id or -1, r.n_hit) for r in rows) == [(-1, 40), (1, 0), (1, 40), (1, 40)]


def test_null_and_repeated_ids(spark):
    """A row stays or goes by its own text, and an item without an id counts though it isn't listed."""
    passage, nameless, clean = (" ".join(f"{c}{i}" for i in range(20)) for c in "wnc")
    df = docs(spark, [passage, clean, passage, clean + " a", nameless, None], [None, None, 1, 1, 2, None])
    items = bench(spark, [(7, passage), (None, nameless)])
    assert sorted((r.doc_id or -1, r.n_hit, list(r.items)) for r in D.contamination(df, items).collect()) == [(-1, 0, []), (-1, 0, []), (-1, 20, ["7"]), (1, 0, []), (1, 20, ["7"]), (2, 20, [])]
    assert {(r.doc_id, r.text) for r in D.drop_contaminated(df, items).collect()} == {(None, clean), (1, clean + " a"), (None, None)}


def test_any_shared_window_has_a_common_fingerprint():
    rnd = random.Random(2)
    for _ in range(300):
        shared = [rnd.choice([b"a", b"b", b"c"]) for _ in range(10)]
        sides = [[rnd.choice([b"a", b"b", b"d"]) for _ in range(rnd.randint(0, 15))] + shared + [rnd.choice([b"b", b"c", b"e"]) for _ in range(rnd.randint(0, 15))] for _ in "12"]
        a, b = ({m["hash"] for m in D.marks(s, [], None, False)} for s in sides)
        assert a & b
    assert hashlib.sha256(b"").hexdigest() and sample
