import re

import numpy as np
import pytest

from quillmesh.functions import config as C
from quillmesh.functions.config import Config, ConfigError, DataError, QueryError
from quillmesh.operators import search
from quillmesh.sources import index
from quillmesh.sources.index import Index

POSTING = "document_id long, start long, length long, vector array<double>"


def rows(spark, *data):
    return spark.createDataFrame(list(data), POSTING)


def test_life_of_an_index(spark, tmp_path):
    ix = Index.create(spark, str(tmp_path / "i"), Config(vector_size=2))
    with pytest.raises(ConfigError):
        Index.create(spark, str(tmp_path / "i"), Config(vector_size=2))
    assert ix.search([1.0, 0.0]).collect() == []
    ix.add(rows(spark, (1, 0, 10, [1.0, 0.0]), (2, 0, 10, [0.0, 1.0]), (3, 0, 10, [-1.0, 0.0])), flush=True)
    ix.add(rows(spark, (1, 0, 10, [0.6, 0.8])), flush=True)
    got = [(r.document_id, r.score) for r in ix.search([1.0, 0.0]).collect()]
    assert got == [(1, 0.8), (2, 0.5), (3, 0.0)]  # the newest version of document 1
    removed = {r.document_id: r.removed for r in ix.remove(spark.createDataFrame([(2,), (9,)], "document_id long")).collect()}
    assert removed == {2: 1, 9: 0}
    assert ix.postings().count() == 3
    ix.flush()
    assert ix.postings().count() == 2 and ix.flush() is None
    again = Index.open(spark, str(tmp_path / "i"))
    assert [r.document_id for r in again.search([1.0, 0.0], k=1).collect()] == [1]
    assert again.stats().first().total_postings == 2


def clustered(n, groups, seed):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(groups, 8)) * 4
    return centres[rnd.integers(0, groups, n)] + rnd.normal(size=(n, 8))


def test_many_shards(spark, tmp_path):
    """Routed inserts, splits, replaced and removed rows, and the recall of a search that reads few shards."""
    v = clustered(1200, 25, 1)
    ix = Index.create(spark, str(tmp_path / "s"), Config(vector_size=8, shard_size=40))
    ix.add(rows(spark, *((i + 1, 0, 5, x.tolist()) for i, x in enumerate(v[:700]))), flush=True)
    before = {r.shard_id for r in ix.shards().collect()}
    ix.add(rows(spark, *((i + 1, 0, 5, x.tolist()) for i, x in enumerate(v) if i >= 700)), flush=True)
    v[:20] = v[600:620] + 0.5
    ix.add(rows(spark, *((i + 1, 0, 5, x.tolist()) for i, x in enumerate(v[:20]))))  # to other shards
    ix.remove(spark.createDataFrame([(i,) for i in range(31, 41)], "document_id long"))
    ix.flush()
    shards = ix.shards().collect()
    live = {r.document_id: r for r in ix.postings().collect()}
    assert sorted(live) == [i for i in range(1, 1201) if not 31 <= i <= 40]
    assert all(np.allclose(live[i + 1].vector, v[i]) for i in range(30))
    assert len(shards) >= 40 and before - {r.shard_id for r in shards} and before & {r.shard_id for r in shards}
    for s in shards:
        own = np.array([r.vector for r in live.values() if r.shard_id == s.shard_id])
        assert len(own) == s.n <= 36 and np.allclose(own.mean(axis=0), s.centroid)
    queries = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 1200, 50)], "query_id long, vector array<double>")
    recall = {r.slop: r.recall for r in ix.recall(queries).collect()}
    assert recall[3] >= 0.9  # the default
    for q in range(0, 1200, 400):
        want = {r.document_id for r in search.search_exact(ix.postings(), v[q].tolist(), 10).collect()}
        assert len(want & {r.document_id for r in ix.search(v[q].tolist()).collect()}) >= 8
    plan = ix.search(v[0].tolist())._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*shard_id", plan)  # other shards' files are not read


def test_a_slop_is_tuned_where_vectors_have_no_groups(spark, tmp_path):
    rnd = np.random.default_rng(2)
    ix = Index.create(spark, str(tmp_path / "u"), Config(vector_size=16, shard_size=25))
    ix.add(rows(spark, *((i + 1, 0, 5, rnd.normal(size=16).tolist()) for i in range(400))), flush=True)
    queries = spark.createDataFrame([(i, rnd.normal(size=16).tolist()) for i in range(20)], "query_id long, vector array<double>")
    slop, recall = ix.tune(queries, 0.9), {r.slop: r.recall for r in ix.recall(queries).collect()}
    assert recall[slop] >= 0.9 > max([r for s, r in recall.items() if s < slop], default=0) and ix.slop() == slop > 3


def test_a_commit_that_was_not_routed(spark, tmp_path, monkeypatch):
    ix = Index.create(spark, str(tmp_path / "c"), Config(vector_size=2))
    monkeypatch.setattr(Index, "route", lambda self: None)
    ix.add(rows(spark, (1, 0, 10, [1.0, 0.0])), flush=True)
    monkeypatch.undo()
    assert [r.document_id for r in Index.open(spark, str(tmp_path / "c")).search([1.0, 0.0]).collect()] == [1]


def test_repeats_in_one_call_and_limits(spark, tmp_path, monkeypatch):
    ix = Index.create(spark, str(tmp_path / "l"), Config(vector_size=2))
    ix.add(rows(spark, (1, 0, 10, [1.0, 0.0]), (1, 0, 10, [2.0, 0.0])), flush=True)
    assert [r.vector for r in ix.postings().collect()] == [[2.0, 0.0]]
    monkeypatch.setattr(index, "MAX_ADD", 1)
    ix.add(rows(spark, (1, 0, 10, [1.0, 0.0]), (2, 0, 10, [2.0, 0.0])))
    with pytest.raises(DataError):
        ix.flush()
    assert ix.version() == 1


def test_replacements_are_checked_against_the_new_text(spark, tmp_path):
    ix = Index.create(spark, str(tmp_path / "v"), Config(vector_size=2))
    text = spark.createDataFrame([(1, "añb")], "document_id long, text string")
    for start, length in ((0, 9), (0, 2), (2, 1)):
        with pytest.raises(DataError):
            ix.replace_documents(text, rows(spark, (1, start, length, [1.0, 0.0])))
    with pytest.raises(DataError):
        ix.replace_documents(text, rows(spark, (2, 0, 1, [1.0, 0.0])))
    assert ix.version() == 0 and not ix.staged


def test_texts(spark, tmp_path):
    ix = Index.create(spark, str(tmp_path / "t"), Config(vector_size=2))
    text = spark.createDataFrame([(1, "añb"), (2, "x")], "document_id long, text string")
    ix.replace_documents(text, rows(spark, (1, 0, 3, [1.0, 0.0])))
    asked = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 1, 2), (1, 3, 9), (7, 0, 1), (1, 0, 0)], "document_id long, start long, length long")
    got = {(r.document_id, r.start, r.length): (r.snippet, r.fault) for r in ix.snippets(asked).collect()}
    assert got == {
        (1, 0, 1): ("a", None), (1, 0, 2): (None, "inside a character"), (1, 1, 2): ("ñ", None), (1, 3, 9): (None, "end beyond text"),
        (7, 0, 1): (None, "no text"), (1, 0, 0): (None, "empty range"),
    }
    ix.delete_texts(spark.createDataFrame([(1,)], "document_id long"))
    ix.flush()
    assert [r.document_id for r in ix.texts().collect()] == [2]
    with pytest.raises(DataError):
        ix.replace_documents(text.union(text), rows(spark))


@pytest.mark.parametrize("bad", [(0, 0, 1, [1.0, 0.0]), (1, 0, 0, [1.0, 0.0]), (1, 0, 1, [1.0]), (1, 0, 1, [float("nan"), 0.0]), (1, 2**32, 1, [1.0, 0.0])])
def test_refused_rows(spark, tmp_path, bad):
    ix = Index.create(spark, str(tmp_path / "r"), Config(vector_size=2))
    ix.add(rows(spark, bad))
    with pytest.raises(DataError):
        ix.flush()


def test_refused_queries(spark, tmp_path):
    ix = Index.create(spark, str(tmp_path / "q"), Config(vector_size=2))
    for query, k, slop in (([1.0], 1, 1), ([], 1, 1), ([float("inf"), 0.0], 1, 1), ([1.0, 0.0], 0, 1), ([1.0, 0.0], 10_001, 1), ([1.0, 0.0], 1, -1)):
        with pytest.raises(QueryError):
            ix.search(query, k, slop)


def test_config():
    assert Config().is_valid() and not Config(vector_size=0).is_valid() and not Config(slop=200).is_valid()
    assert Config.from_json(Config(vector_size=7).to_json()) == Config(vector_size=7)
    with pytest.raises(ConfigError):
        Config().merged(vector_size=5)
    assert Config().merged(slop=7).slop == 7
    assert C.effective_slop(Config(), 1000) == 3 and C.effective_slop(Config(adaptive_slop=True), 1000) == 3 + 0 + 10
    assert [C.optimal_slop(64, n) for n in (1, 2, 6, 500)] == [1, 2, 3, 3] and C.optimal_slop(600, 500) == 5 and C.optimal_slop(300, 4) == 4
    assert C.bloom_parameters(1000, 0.01) == (9586, 7)
    assert Config.high_performance().is_valid() and Config.memory_optimized().is_valid()


def test_a_split_moves_no_shard_to_one_task(spark):
    """Joins of rows with what is known of their shards deal out no rows by shard, however large a shard is."""
    v = clustered(300, 4, 3)
    df = spark.createDataFrame([(9 if i < 280 else 5, i, x.tolist()) for i, x in enumerate(v)], "shard_id long, key long, vector array<double>")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = search.split_round(df, 100, 20)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r.key: r.shard_id for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert out.rdd.getNumPartitions() == df.rdd.getNumPartitions()  # rounds add none
    assert "BroadcastHashJoin" in plan and not re.search("SortMergeJoin|ShuffledHashJoin", plan)
    assert set(got) == set(range(300)) and all((got[i] in (20, 21)) == (i < 280) for i in got) and {20, 21} <= set(got.values())
