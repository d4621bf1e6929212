import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rostrum.llm import pieces, tokenizing

from .helpers import documents, frame, rows


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizing.tokenizer_path(pieces.MODEL))


def same(library, texts):
    store = pieces.store(pieces.MODEL)
    ids, n = store.encode_texts(texts)
    want = library.encode([t or "" for t in texts], add_bos=True, add_eos=True)
    assert np.split(ids, np.cumsum(n)[:-1])[0].tolist() == want[0]
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want
    assert store.decode(ids, n) == [library.decode(w) for w in want]


EDGES = [None, "", " ", "  ", "   a", "a  b ", "▁x", "▁", "▁▁ ▁", "a\nb\t\x00c", "\n", "\r\n\n a", "<s> </s> <0x41>", "<unk>", "é ﬁ Ａ", "日本 語"]
EDGES += ["x　y\xa0z\x85", " " * 15, "a" + " " * 31 + "b", " " * 33 + "日", " " * 100 + "the", "👩‍👩‍👧 🇩🇪", "aaaaaaa", "abababab", "�﻿x"]


def test_edge_texts(library):
    same(library, EDGES)


@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_any_text(library, texts):
    same(library, texts)


@given(st.lists(st.text(alphabet="ab ▁\nthe", max_size=60), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_few_letters(library, texts):
    same(library, texts)


def test_long_words_and_texts(library):
    rng = random.Random(5)
    letters = "".join(rng.choice("etaoinshrdlu") for _ in range(30_000))
    same(library, [letters, " " * 20_000, "the" * 20_000, "日本" * 20_000, "word and words " * 100_000])


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_heap_goes_on_where_rounds_stop(rounds):
    merges = pieces.store(pieces.MODEL).merges
    rng = random.Random(rounds)
    words = ["▁" * rng.randint(0, 20) + "".join(rng.choice("theinga") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    for a, b in zip(merges.merge(words), merges.merge(words, rounds), strict=True):
        assert a.tolist() == b.tolist()


def test_stretches_and_small_store(library, monkeypatch):
    monkeypatch.setattr(pieces, "STRETCH", 50)
    small = pieces.PieceStore(tokenizing.tokenizer_path(pieces.MODEL), limit=40)
    texts = [t for _, t, *_ in documents()] + EDGES
    assert all("".join(small.stretches(t, 50)) == t for t in texts if t)
    ids, n = small.encode_texts(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == library.encode([t or "" for t in texts], add_bos=True, add_eos=True)


def test_decoding_other_lists_of_ids(library):
    """Ids that no text gives: broken bytes, begin ids in the middle, no ids."""
    store, rng = pieces.store(pieces.MODEL), random.Random(3)
    lists = [[rng.choice([1, 2, rng.randint(3, 258), rng.randint(259, 31_999)]) for _ in range(rng.randint(0, 12))] for _ in range(500)]
    lists += [[1, 2], [], [230, 151], [1, 230, 2, 151], [259, 259], [28705, 28705]]
    flat = np.array([i for x in lists for i in x], np.uint32)
    got = store.decode(flat, np.array([len(x) for x in lists]))
    assert got == [library.decode(x) for x in lists]


def test_operator_on_documents(spark, library):
    got = pieces.digest(frame(spark, extra=True)).collect()
    want = {}
    for doc, text, *_ in documents():
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want[doc] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want


def test_empty_table_nulls_and_repeated_rows(spark):
    assert pieces.digest(frame(spark, [])).count() == 0
    got = rows(pieces.encode(frame(spark, [(None, None, None, None, None)] * 2 + [(1, "a", None, None, None)] * 2)), "doc_id", "n_tokens", "ids")
    assert len(got) == 4 and len(set(got)) == 2
    none = spark.createDataFrame([(1, 0, None)], "doc_id long, n_tokens long, ids binary")
    assert pieces.decode(none).first().text == ""
