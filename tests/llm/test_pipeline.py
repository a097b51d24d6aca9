"""The pipeline, stage by stage, against brute force on each stage's own input."""

import corpus_pipeline as P
from quillmesh.llm.common import written
from tests.llm import test_decontamination, test_lines, test_packing, test_quality, test_simhash
from tests.llm.util import FULL, texts_of

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in P.STAGES:
        before = texts_of(docs)
        out = stage(spark, docs, SF)
        if name == "best_fit_packing":
            windows, tokens = test_packing.verify(out.collect(), before)
            assert windows <= 1.05 * tokens / 2048 + 1
            break
        assert sorted(out.columns) == sorted(FULL)
        docs = written(out)
        after = texts_of(docs)
        if name == "quality_rules":
            assert after == {i: t for i, t in before.items() if not test_quality.brute(t)["failed"]}
        elif name == "line_dedup":
            want, _ = test_lines.brute(before)
            assert after == {i: t for i, t in want.items() if t is None or t.split() or not before[i].split()}
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        elif name == "simhash_near_dedup":
            assert after == {i: before[i] for i in {c for _, c in test_simhash.brute(before, 5).values()}}
        else:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert after == {i: before[i] for i, (_, n, _) in test_decontamination.brute(before, items).items() if not n}


def test_run(spark):
    assert P.run(spark, SF).count() > 0
