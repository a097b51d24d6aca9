"""op4: ids against the tokenizer itself, windows against the rules of packing."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillmesh.llm import packing as P
from quillmesh.llm.tokens import WordEncoder, vocabulary
from tests.llm.util import docs, sample, texts_of

PATH = vocabulary("word_bpe_49k.json")
ENCODE, FULL = WordEncoder(PATH), Tokenizer.from_file(PATH)


def ids(text):
    return np.array(FULL.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(), st.sampled_from("aAeé'ſİßΣ <|>endoftext\x00\x1c\x85\xa0 \t\n12ŉǅ́"))))
def test_ids_are_the_tokenizers(text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert ENCODE(text) == ids(text)[:-1].tobytes()


@pytest.mark.parametrize("text", ["<|endoftext|> x<|startoftext|>", "don't I'LL 'sup '' 12a34", "ﬁ é é Å K", "a\x00b \x00"])
def test_odd_words(text):
    assert ENCODE(text) == ids(text)[:-1].tobytes()


def test_best_fit_is_the_tightest():
    rnd, window = random.Random(3), 64
    for _ in range(50):
        sizes = sorted((rnd.randint(1, window) for _ in range(80)), reverse=True)
        rooms, want = [], []
        for s in sizes:
            fits = [r for r in rooms if r[0] >= s]
            if not fits:
                rooms.append([window])
                fits = [rooms[-1]]
            best = min(fits)
            want.append(best[0])
            best[0] -= s
        placed = P.best_fit(sizes, window)
        assert [window - at for _, at in placed] == want
        assert len({w for w, _ in placed}) == len(rooms)


def verify(rows, texts, window=P.WINDOW):
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        every, at = ids(texts[i]), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(every))
            at += r.length
            assert r.ids_crc32 == zlib.crc32(every[r.start : at].tobytes())
        assert at == len(every)
    for pieces in by_window.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return len(by_window), sum(len(ids(t)) for t in texts.values())


def test_sample(spark):
    windows, tokens = verify(P.op4_packing(spark, "/root/testdata/sf0.001").collect(), texts_of(sample(spark)))
    assert windows <= 1.05 * tokens / P.WINDOW + 1


def test_edge_cases(spark):
    texts = [None, "", "one", "word " * 30_000, "é ñ", "x " * 2047, "x " * 2046]
    df = docs(spark, texts)
    verify(P.packed(df).collect(), dict(enumerate(texts)))
    assert P.packed(df.limit(0)).collect() == []
    again = P.packed(docs(spark, ["a b", "a b", None], [None, None, 3])).collect()
    assert len(again) == 3 and len({r.offset for r in again}) == 3
    with_ids = P.packed(df, ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in with_ids)
