"""Words of whole batches, and the semi-join of the set-similarity joins."""

import re

import numpy as np
import pyarrow as pa

from quillmesh.llm import sets
from tests.llm.util import lower


def test_words_of():
    """Against a split of each text: words end with their text, lines begin anew, empty texts and nulls have none."""
    long = "w" * 257 + " " + "W" * 256 + "\n" + "w" * 9 + "\tw\x0b\x1cw"
    texts = ["a B", "b", "", None, "b a\n\n\na", "\n", "é\r\nÉ é", "x", "", long, "x"]
    for column in (pa.array(texts), pa.array(texts).slice(1, 6), pa.array(["", None]), pa.array([], pa.string())):
        want = []
        for i, t in enumerate(column.to_pylist()):
            for n, line in enumerate((t or "").split("\n")):
                want += [(i, n, w) for w in re.split("[ \t-\r]+", lower(line)) if w]
        text, line, h = sets.words_of(column)
        assert list(zip(text.tolist(), line.tolist(), strict=True)) == [w[:2] for w in want]
        assert len(set(h.tolist())) == len({w[2] for w in want}) == len(set(zip(h.tolist(), (w[2] for w in want), strict=True)))


def test_counts_of_ranked(spark):
    """More members than counters, over several batches: the commonest word ranks last, one without a place first."""
    df = spark.createDataFrame([("a a a b",)] * 400, "text string").repartition(1)
    members = lambda texts: np.tile(sets.words_of(texts)[2], 1024)
    rank = sets.ranked(df, members)
    a, b = (int(sets.words_of(pa.array([w]))[2][0] & np.uint64(sets.SKETCH - 1)) for w in "ab")
    assert (rank[a], rank[b]) == (sets.SKETCH - 1, sets.SKETCH - 2)
    assert sorted(rank.tolist()) == list(range(sets.SKETCH))


def test_semi_join_is_dealt_out_once(spark, monkeypatch, tmp_path):
    """Both sides of the semi-join on prefix members read one exchange."""
    monkeypatch.setattr(sets, "written", lambda df: df)
    kind = "sig long, sig2 long, size int, bits long, prefix array<long>, n long, id long"
    spark.createDataFrame([(i, i, 5, 0, [1, i + 2], 1, i) for i in range(100)], kind).write.parquet(f"{tmp_path}/classes")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = sets.near_rows(spark.read.parquet(f"{tmp_path}/classes"))
        assert len(found.collect()) == 100
        assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_sharing():
    """Rows with a partner in their word's list, against all pairs; lists of one row and of near copies."""
    rng = np.random.default_rng(0)
    for n in (1, 2, 40, 400):
        r = np.zeros(n, sets.ROW)
        r["word"], r["id"], r["size"] = rng.integers(0, 12, n), np.arange(n), rng.integers(4, 40, n)
        r["pos"] = rng.integers(0, 9, n) % (r["size"] // 5 + 1)
        r["bits"] = rng.integers(0, 1 << 62, 6)[rng.integers(0, 6, n)] ^ 1 << rng.integers(0, 62, n)
        x = r.tolist()
        may = lambda w, m: w[0] == m[0] and 5 * min(w[3], m[3]) >= 4 * max(w[3], m[3]) and 9 * min(w[3] - w[4], m[3] - m[4]) >= 4 * (w[3] + m[3])
        want = [i for i, w in enumerate(x) if any(i != j and may(w, m) and 9 * (w[2] ^ m[2]).bit_count() <= w[3] + m[3] for j, m in enumerate(x))]
        assert sorted(sets.sharing(r).tolist()) == want


def test_near_rows_by_buckets(spark, tmp_path):
    """The semi-join gives the same rows wherever members go from the buckets to Spark's join, without a row for each member in the buckets' exchange."""
    kind = "sig long, sig2 long, size int, bits long, prefix array<long>, n long, id long"
    place = lambda i: i << 44
    data = [(i, i, 5 + i % 9, i % 3, [place(i), place(1000 + i % 7), place(2000 + i % 2) + i % 5], 1, i) for i in range(300)] + [(9, 9, 3, 0, [], 1, 999)]
    spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/classes")
    classes = spark.read.parquet(f"{tmp_path}/classes")
    rows = lambda df: sorted(tuple(r) for r in df.select("id", "word", "pos", "size").collect())
    want = rows(sets.near_rows(classes))
    assert 0 < len(want) < 900
    for long_from in (1, 1003, 2000, sets.SKETCH):
        assert rows(sets.near_rows(classes, long_from=long_from)) == want
    total = np.zeros(sets.SKETCH, np.int64)
    total[[3, 5]] = sets.LONG_LIST, sets.LONG_LIST + 1
    assert sets.common(total) == sets.in_order(total)[5] == sets.SKETCH - 1
