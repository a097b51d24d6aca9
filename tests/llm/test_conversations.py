"""op3: parents, branches and texts of conversations with quotations."""

import random
import re
from collections import Counter

from quillmesh.llm import conversations as C

KIND = "conv_id long, turn long, role string, text string, place long, thread string"


def order(spark, rows):
    out = C.reply_order(spark.createDataFrame([(*r, 99, "x") for r in rows], KIND)).collect()
    return {(r.conv_id, r.place): r for r in out}


def test_quotations_link_and_go(spark):
    rows = [
        (1, 0, "user", "How do I sort?\nAnd how do I join?"),
        (1, 1, "assistant", "Use sorted."),
        (1, 2, "user", "Thanks, that works."),
        (1, 3, "assistant", "On Monday Ann wrote:\n> And how  do I JOIN?\nUse join."),
        (1, 4, "user", "> Use join.\n>> And how do I join?\nOn what key?"),
        (1, 5, "user", "> Use sorted.\nIs it stable?"),
        (1, 6, "assistant", "> nobody said this\nIt is."),
    ]
    got = order(spark, rows)
    assert [got[1, i].parent_place for i in range(7)] == [None, 0, 1, 0, 3, 1, 5]
    assert [got[1, i].own for i in (3, 4, 5)] == ["Use join.", "On what key?", "Is it stable?"]
    assert [list(got[1, i].thread) for i in range(7)] == [[0], [0], [0], [0, 3], [0, 3], [0, 5], [0, 5]]
    assert [got[1, i].n_quotes for i in range(7)] == [0, 0, 0, 1, 2, 1, 1]
    places = sorted(range(7), key=lambda i: got[1, i].position)
    assert all(places.index(got[1, i].parent_place) < places.index(i) for i in range(1, 7))


def test_a_common_line_links_to_the_latest_message_before(spark):
    rows = [(c, t, "user", "hello" if t < 5 else "> hello\nmine") for c in range(30) for t in range(7)]
    got = order(spark, rows)
    assert all(got[c, t].parent_place == 4 for c in range(30) for t in (5, 6))


def test_a_whole_passage_counts_before_its_lines(spark):
    rows = [(1, 0, "u", "A\nB"), (1, 1, "u", "x"), (1, 2, "u", "A\nB\nC"), (1, 3, "u", "B\nA\nC\nD"), (1, 4, "u", "> A\n>\n> B\n> C\nyes"), (1, 5, "u", "> C\n> nowhere\n> D\nno")]
    got = order(spark, rows)
    assert got[1, 4].parent_place == 2 and got[1, 5].parent_place == 3


LINES = [f"line {c}" for c in "abcdefg"]


def brute(texts):
    """Parents of one conversation's messages, by going through all earlier ones."""
    own, parents = [], []
    for place, text in enumerate(texts):
        runs, mine, last = [], [], 0
        for line in text.split("\n"):
            marks = re.match(r"(?:[ \t]?>)*", line)[0]
            level, rest = marks.count(">"), " ".join(line[len(marks) :].lower().split())
            if level and rest:
                if level != last:
                    runs.append((level, []))
                runs[-1][1].append(rest)
                last = level
            elif not level:
                last = 0
                mine += [rest] if rest else []
        votes = Counter()
        for level, lines in runs:
            for whole, unit in [(1, lines)] * (len(lines) > 0) + [(0, [x]) for x in dict.fromkeys(lines)]:
                if whole or len(lines) > 1:
                    holders = [p for p in range(place) if any(own[p][i : i + len(unit)] == unit for i in range(len(own[p])))]
                    if holders:
                        votes[level, whole, holders[-1], tuple(unit)] = len(unit)
        sums = Counter()
        for (level, whole, source, _), n in votes.items():
            sums[level, -whole, source] += n
        best = min(((level, whole, -n, -source) for (level, whole, source), n in sums.items()), default=None)
        parents.append(-best[3] if best else place - 1 if place else None)
        own.append(mine)
    return parents


def test_random_nested_quotations(spark):
    rnd, rows, want = random.Random(8), [], {}
    for conv in range(40):
        texts = []
        for _ in range(rnd.randrange(1, 14)):
            lines = []
            for _ in range(rnd.randrange(0, 4)):
                level, size = rnd.choice([0, 0, 1, 1, 2]), rnd.randrange(1, 4)
                at = rnd.randrange(len(LINES))
                lines += [(rnd.choice(["> ", ">"]) * level) + x.upper() + " " * rnd.randrange(3) for x in (LINES[at : at + size])]
                lines += [">"] * rnd.randrange(2) + [""] * rnd.randrange(2)
            texts.append("\n".join(lines))
        rows += [(conv, t, "u", text) for t, text in enumerate(texts)]
        want |= {(conv, p): x for p, x in enumerate(brute(texts))}
    got = order(spark, rows)
    assert {k: r.parent_place for k, r in got.items()} == want
    assert sum(r.parent_place not in (None, r.place - 1) for r in got.values()) > 40
    for (conv, place), r in got.items():
        up = got.get((conv, r.parent_place))
        assert r.thread[-1] <= place and (up is None or r.position > up.position and (r.thread == up.thread or r.thread[:-1] == up.thread))
    for conv in range(40):
        assert sorted(r.position for k, r in got.items() if k[0] == conv) == list(range(sum(k[0] == conv for k in got)))


def test_one_hot_conversation_with_a_long_chain(spark):
    """Every message quotes the second one before it: branches of branches, and one very common line."""
    rows = [(1, 0, "u", "a0\nhi")] + [(1, t, "u", f"> a{max(0, t - 2)}\n> hi\nhi\na{t}") for t in range(1, 300)]
    got = order(spark, rows)
    assert [r.parent_place for _, r in sorted(got.items())] == brute([r[3] for r in rows])
    assert sorted(r.position for r in got.values()) == list(range(300))


def test_branches_of_branches(spark):
    rows = [(1, 0, "u", "a0")] + [(1, t, "u", f"> a{max(0, t - 2)}\na{t}") for t in range(1, 9)]
    got = order(spark, rows)
    assert [got[1, t].parent_place for t in range(9)] == [None, 0, 0, 1, 2, 3, 4, 5, 6]
    assert sorted(r.position for r in got.values()) == list(range(9))
    for r in got.values():
        assert r.parent_place is None or got[1, r.parent_place].position < r.position


def test_edge_cases(spark):
    rows = [(None, 0, "u", "x"), (None, 1, None, None), (None, None, "u", "> x"), (2, 0, "u", ""), (2, 0, "u", ""), (2, 1, "u", ">\n> >\n>>> deep"), (3, 0, "u", "a\n" * 5000)]
    got = order(spark, rows)
    assert len(got) == 7
    assert C.reply_order(spark.createDataFrame([], KIND)).collect() == []
    assert got[2, 2].own == "" and got[2, 2].n_quotes == 1


def test_query(spark):
    src = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    out = C.op3_chat_formatting(spark, "/root/testdata/sf0.001")
    assert out.count() == src.count()
