"""op9 against encoding the whole edited text."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmesh.llm import edits as E
from quillmesh.llm.tokens import vocabulary
from tests.llm.util import docs, sample, texts_of

COUNT = E.Counter(vocabulary("byte_bpe_50k.tiktoken"))
CHARS = st.text(alphabet="abé 's\n\t'relv1２!?日 -", max_size=400)
EDITS = st.lists(st.tuples(st.integers(0, 420), st.integers(0, 60), st.text(alphabet="ab's \n1!é", max_size=12)), max_size=12)


def whole(text):
    return len(COUNT.encoding.encode_ordinary(text))


@settings(max_examples=400, deadline=None)
@given(CHARS, EDITS, st.integers(1, 40))
def test_any_edits(text, todo, repeat):
    text = text * repeat
    tree = E.TokenTree(text, COUNT)
    for at, cut, put in todo:
        tree.edit(at, cut, put)
        at = min(at, len(text))
        text = text[:at] + put + text[at + cut :]
        assert tree.text() == text and tree.tokens[1] == whole(text) and tree.chars[1] == len(text)


@settings(max_examples=100, deadline=None)
@given(CHARS, st.lists(EDITS, max_size=4), st.integers(1, 40))
def test_trees_that_are_kept(text, batches, repeat):
    text = text * repeat
    tree = E.TokenTree(text, COUNT)
    for todo in batches:
        tree = E.TokenTree(tree.text(), COUNT, tree.kept())
        assert tree.encoded == 0 and tree.tokens[1] == whole(text)
        for at, cut, put in todo:
            tree.edit(at, cut, put)
            at = min(at, len(text))
            text = text[:at] + put + text[at + cut :]
    assert tree.text() == text and tree.tokens[1] == whole(text)


def test_batches_of_edits_on_a_table_of_trees(spark):
    text = " ".join(f"word{i}" for i in range(20_000))
    table = E.trees(docs(spark, [text, None, "ab cd"], [1, 2, None]))
    for k in range(3):
        edit = F.expr(f"array(struct(length(coalesce(text, '')) div 2 as at, 3L as cut, 'new{k} ' as put))")
        out = E.apply_edits(table, edit).collect()
        table = spark.createDataFrame([(r.doc_id, r.text_after, r.leaves) for r in out], f"doc_id long, text string, leaves {E.LEAVES_SQL}")
        assert all(r.n_tokens_after == whole(r.text_after) and r.n_reencoded < 200 for r in out)
    assert E.trees(docs(spark, [])).collect() == []


def test_an_edit_re_encodes_little():
    text = " ".join(f"word{i}" for i in range(50_000))
    tree = E.TokenTree(text, COUNT)
    tree.edit(len(text) // 2, 5, "other")
    assert tree.encoded < 200


def test_query_on_the_sample(spark):
    texts = texts_of(sample(spark))
    for r in E.op9_token_counts(spark, "/root/testdata/sf0.001").collect():
        t = texts[r.doc_id] or ""
        assert r.n_tokens == whole(t)
        n = len(t)
        for at, cut, put in ((n // 2, 0, "inserted words, "), (n // 3, 7, ""), (2 * n // 3, 5, " it's 42")):
            t = t[:at] + put + t[at + cut :]
        assert (r.n_tokens_after, r.n_edits) == (whole(t), 3)


def test_edge_cases(spark):
    df = docs(spark, [None, "", "x" * 100_000, "<|endoftext|>", "a", "a"], [0, 1, 2, 3, None, None])
    none = F.lit(None).cast("array<struct<at: long, cut: long, put: string>>")
    assert E.edited_counts(df, none).count() == 6
    assert E.edited_counts(df.limit(0), none).collect() == []
    odd = F.expr("array(struct(-5L as at, cast(null as bigint) as cut, 'b' as put), struct(cast(null as bigint) as at, 99L as cut, cast(null as string) as put))")
    assert {r.text_after for r in E.edited_counts(df, odd).collect()} == {"", "x" * 99_902}
