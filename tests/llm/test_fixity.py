"""op7: hash trees find exactly the records that differ."""

import hashlib

from quillmesh.llm import fixity as F

KIND = "page_id long, url string, html string, volume long, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 5, "d") for r in rows], KIND)


def test_damage_is_located(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 7)) for i in range(3000)]
    bad = [(i, u, h + "!" if i in (1023, 2500) else h.replace("1", "7") if i == 11 else h) for i, u, h in rows]
    got = F.audit(pages(spark, rows), pages(spark, bad)).collect()
    broken = {r.key for r in got if not r.intact}
    # a record that grew moves those after it in its volume; one of the same length moves none
    assert broken == {11, 1023} | set(range(2500, 3000))
    assert all(r.intact for r in F.audit(pages(spark, rows), pages(spark, rows)).collect())


def test_root_is_the_hash_of_its_children(spark):
    rows = F.leaves(pages(spark, [(i, "u", "x" * i) for i in range(20)]), "page_id", "url", "html")
    nodes = {(r.level, r.idx): r for r in F.tree(rows).collect()}
    text = lambda r: f"{r.first_byte}:{r.upto_byte}:{r.digest}"
    for level in (1, 2):
        for (lv, i), r in nodes.items():
            if lv == level:
                kids = [nodes[level - 1, k] for k in range(16 * i, 16 * i + 16) if (level - 1, k) in nodes]
                assert r.digest == hashlib.sha256("|".join(map(text, kids)).encode()).hexdigest()
    assert max(lv for lv, _ in nodes) == 2 and nodes[2, 0].upto_byte == nodes[0, 19].upto_byte


def test_missing_records_differ(spark):
    rows = [(i, "u", "x") for i in range(40)]
    got = F.audit(pages(spark, rows), pages(spark, rows[:39])).collect()
    assert [r.key for r in got if not r.intact] == [39]


def test_records_of_the_replica_alone(spark):
    rows = [(i, "u", f"x{i}") for i in range(30)]
    got = F.audit(pages(spark, rows[:10] + rows[11:]), pages(spark, rows)).collect()
    ours, replica = ([r for r in got if r.side == side] for side in ("ours", "replica"))
    assert {r.key for r in ours if not r.intact} == set(range(11, 30)) == {r.key for r in ours if r.moved}
    assert [(r.key, r.intact, r.moved) for r in replica] == [(29, False, True)]
    # at its end: the record itself
    got = F.audit(pages(spark, rows[:29]), pages(spark, rows)).collect()
    assert [(r.side, r.key, r.moved) for r in got if not r.intact] == [("replica", 29, False)]


def test_a_key_of_very_many_records(spark):
    rows = [(7, "u", f"x{i % 900}") for i in range(4000)] + [(2**60 + 1, "u", "far"), (2**60 - 1, "u", "near")]
    got = F.audit(pages(spark, rows), pages(spark, rows[::-1])).collect()
    assert all(r.intact for r in got) and len(got) == 4002
    hot = sorted((r.idx, r.offset, r.length, r.digest) for r in got if r.key == 7)
    assert [x[0] for x in hot] == list(range(4000)) and [x[3] for x in hot] == sorted(x[3] for x in hot)
    assert [x[1] for x in hot] == [sum(y[2] for y in hot[:i]) for i in range(4000)]
    assert {r.volume for r in got} == {0, 2**50, 2**50 - 1}


def test_edge_cases(spark):
    rows = [(None, "u", "x"), (None, None, None), (1, None, "é" * 50_000), (1, None, "é" * 50_000), (-5, "", ""), (2000, "u", None)]
    got = F.audit(pages(spark, rows), pages(spark, rows)).collect()
    assert len(got) == 6 and all(r.intact for r in got)
    assert F.audit(pages(spark, []), pages(spark, [])).collect() == []
    assert not any(r.intact for r in F.audit(pages(spark, rows), pages(spark, [])).collect())
