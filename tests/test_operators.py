"""Semantic anchors of versions, deletes, splits and dedup."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmesh.functions.similarity import METRICS, similarity
from quillmesh.operators import dedup, search, versions
from quillmesh.streaming import commits

P = "shard_id long, document_id long, start long, length long, seq long, vector array<double>, deleted boolean"


def test_the_latest_version_wins(spark):
    df = spark.createDataFrame([(0, 1, 100, 50, 1, [1.0, 2.0], False), (0, 1, 100, 50, 2, [4.0, 5.0], False)], P)
    assert [r.vector for r in versions.latest(df).collect()] == [[4.0, 5.0]]


def test_a_deletion_supersedes_older_versions(spark):
    df = spark.createDataFrame([(0, 1, 0, 5, 1, [1.0], False), (0, 1, 0, 5, 2, [1.0], True), (0, 2, 0, 5, 3, [1.0], False)], P)
    assert [r.document_id for r in versions.latest(df).where("not deleted").collect()] == [2]


def test_centroids_count_live_rows_alone(spark):
    df = spark.createDataFrame([(0, 1, 0, 5, 1, [2.0, 0.0], False), (0, 2, 0, 5, 2, [0.0, 2.0], False), (0, 3, 0, 5, 3, [9.0, 9.0], True)], P)
    assert search.centroids(versions.latest(df).where("not deleted")).first().centroid == [1.0, 1.0]


@pytest.mark.parametrize("n", [1, 2, 4, 5, 8])
def test_equal_vectors_split_in_halves(spark, n):
    df = spark.createDataFrame([(0, i, 0, 5, i, [1.0, 1.0], False) for i in range(n)], P)
    sides = [r.side for r in versions.split(df).collect()]
    assert (sides.count("a"), sides.count("b")) == ((n + 1) // 2, n // 2)


def test_a_split_parts_two_clusters(spark):
    df = spark.createDataFrame([(0, i, 0, 5, i, [float(i % 2) * 10, i / 10], False) for i in range(10)], P)
    sides = {r.seq: r.side for r in versions.split(df).collect()}
    assert len({sides[i] for i in range(0, 10, 2)}) == 1 and len(set(sides.values())) == 2


def test_policies(spark):
    kind = "shard_rank int, document_id long, start long, length long, seq long, score double, vector array<double>"
    df = spark.createDataFrame([(1, 1, 0, 5, 1, 0.5, [1.0]), (2, 1, 0, 6, 2, 0.9, [1.0]), (2, 1, 9, 5, 3, 0.7, [1.0]), (2, 1, 9, 5, 4, 0.6, [1.0 + 1e-9])], kind)
    kept = {p: sorted(r.seq for r in dedup.deduplicated(df, p).collect()) for p in dedup.POLICIES}
    assert kept == {"none": [1, 2, 3, 4], "by_document": [2], "by_position": [1, 3], "exact": [1, 2, 3]}


def test_unlike_dimensions_are_an_error(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0])], "a array<double>, b array<double>")
    for metric in METRICS:
        with pytest.raises(Exception, match="vectors of 2 and 1"):
            df.selectExpr(similarity(metric, "a", "b")).collect()


def test_zero_vectors_score_a_half(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "id long, vector array<double>")
    got = {(r.query_id, r.id): r.score for r in search.search_batch(df, [(7, [1.0, 0.0]), (8, [0.0, 0.0])], 5, block=1).collect()}
    assert got == {(7, 1): 0.5, (7, 2): 1.0, (8, 1): 0.5, (8, 2): 0.5}
    assert search.search_batch(df, [], 5).collect() == []


def test_assignment_in_blocks(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    v, c = rnd.normal(size=(60, 4)), rnd.normal(size=(11, 4))
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    shards = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "shard_id long, centroid array<double>")
    monkeypatch.setattr(search, "BLOCK", 3)
    got = {r.id: r.shard_id for r in search.assigned(vectors, shards, rows=7).collect()}
    assert got == {i: int(((x - c) ** 2).sum(axis=1).argmin()) for i, x in enumerate(v)}


def test_the_furthest_pair_over_several_blocks(spark, monkeypatch):
    rnd = np.random.default_rng(6)
    v = rnd.normal(size=(50, 3)).round(1)
    df = spark.createDataFrame([(0, i, 0, 5, i, x.tolist(), False) for i, x in enumerate(v)], P)
    monkeypatch.setattr(versions, "BLOCK", 8)
    every = [(round(float(np.sqrt(((v[i] - v[j]) ** 2).sum())), 6), i, j) for i in range(50) for j in range(i)]
    row = versions.furthest_pairs(df).first()
    assert (row.distance, row.seq_a, row.seq_b) == max(every)


def test_a_transaction_over_several_micro_batches(spark, tmp_path):
    at, kind = str(tmp_path), "txn_id long, op_ordinal long, x string"
    for batch, rows in enumerate([[(1, 0, "a"), (1, 1, "b"), (1, 1, "b")], [(1, 2, "c"), (1, 1, "b"), (2, 0, "d")], []]):
        for _ in range(2):  # a batch is tried again
            commits.commit(spark.createDataFrame(rows, kind), batch, at)
    assert sorted((r.txn_id, r.op_ordinal) for r in spark.read.parquet(at).collect()) == [(1, 0), (1, 1), (1, 2), (2, 0)]


def test_the_recall_of_routed_shards(spark):
    from quillmesh.plans import catalogue

    for name in ("knn_recall_by_slop", "knn_recall_routed"):
        recall = {r.slop: r.recall for r in catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").collect()}
        assert max(recall.values()) == 1.0 and [recall[s] for s in sorted(recall)] == sorted(recall.values())


def test_bloom_filters_miss_no_shard(spark):
    from quillmesh.operators import bloom
    from quillmesh.sources import tables as T

    rows, ids = T.postings(spark, "/root/testdata/sf0.01"), spark.range(0, 200).withColumnRenamed("id", "document_id")
    maybe = {tuple(r) for r in bloom.candidate_shards(bloom.filters(rows, 64, 0.01), ids, 64, 0.01).collect()}
    exact = {tuple(r) for r in versions.candidate_shards(rows, ids).collect()}
    assert exact <= maybe and len(maybe - exact) <= 0.05 * 200 * 10
    assert all(0 < r.load < 1 for r in bloom.filter_stats(bloom.filters(rows, 64, 0.01), 64, 0.01).collect())


def test_batch_search_holds_little_however_long_batches_are():
    """A task passes on k rows a query, not k a batch, and its products stay small; ties go to the smaller id."""
    rnd = np.random.default_rng(8)
    v = rnd.normal(size=(12_000, 8)).round(1)
    v[5_000:5_400] = v[7]
    ids, q = np.arange(600) * 3, search.unit(v[:600])
    name = rnd.permutation(len(v))
    of = lambda a, b: pa.RecordBatch.from_arrays([pa.array(name[a:b]), pa.array(list(v[a:b]), pa.list_(pa.float64()))], ["id", "vector"])
    batches = [of(0, 10_000), of(10_000, 10_003), of(10_003, 12_000)]
    tracemalloc.start()
    got = pa.Table.from_batches(search.best_rows(batches, ids, q, 5)).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 5 * 600 and peak < 40e6  # all products of the first batch take 48 MB
    s = np.round((np.clip(search.unit(v) @ q.T, -1, 1) + 1) / 2, 6)
    order = np.lexsort((np.broadcast_to(name[:, None], s.shape), -s), axis=0)[:5]
    want = {(int(ids[j]), int(name[i])): s[i, j] for j in range(600) for i in order[:, j]}
    assert {(r.query_id, r.id): r.score for r in got.itertuples()} == want


def test_a_larger_log_comes_in_more_files(spark, tmp_path, monkeypatch):
    """What a task deals out and a micro-batch takes in is bounded, and every operation is applied once."""
    kind = "txn_id long, op_ordinal long, op string, document_id long, start long, length long, vector array<double>, text string"
    log = spark.createDataFrame([(i // 10, i % 10, "store_text", i, None, None, None, "x" * 79) for i in range(400)], kind)  # 100 bytes each
    assert commits.delivered(log, f"{tmp_path}/whole") == 4
    monkeypatch.setattr(commits, "FILE_BYTES", 2500)
    assert commits.delivered(log, f"{tmp_path}/cut") == 16
    files = spark.read.parquet(f"{tmp_path}/cut").groupBy(F.input_file_name()).count().collect()
    assert len(files) == 32 and max(r["count"] for r in files) <= 50
    got = commits.replayed(log).groupBy("txn_id").count().collect()
    assert {(r.txn_id, r["count"]) for r in got} == {(i, 10) for i in range(40)}
