import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rostrum.llm import packing, rans, token_files, tokenizing

from .helpers import documents, frame, rows


def direct(name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizing.tokenizer_path(name))
    t.encode_special_tokens = True
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@given(st.lists(st.integers(1, 64), max_size=200))
@settings(max_examples=60, deadline=None)
def test_sum_of_squares_fills_without_overlap(lengths):
    a = np.array(lengths, np.int64)
    seq, off = packing.sum_of_squares(a, 64)
    for s in set(seq.tolist()):
        own = sorted((o, n) for q, o, n in zip(seq.tolist(), off.tolist(), lengths, strict=True) if q == s)
        at = 0
        for o, n in own:
            assert o == at
            at += n
        assert at <= 64
    if len(a):
        assert len(set(seq.tolist())) <= 1.25 * -(-a.sum() // 64) + 3


def test_packing_against_direct_encoding(spark):
    encode = direct("word_bpe_49k.json", 1)
    got = packing.pack_documents(frame(spark, extra=True)).collect()
    want = {}
    for doc, text, *_ in documents():
        ids = encode(text)
        for j, at in enumerate(range(0, len(ids), 4096)):
            piece = ids[at : at + 4096]
            want[doc, j] = (at, len(piece), zlib.crc32(piece.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 4096


def test_packing_repeated_rows_and_empty(spark):
    assert packing.pack_documents(frame(spark, [])).count() == 0
    three = [(1, "a b", None, None, None)] * 2 + [(None, None, None, None, None)]
    assert rows(packing.pack_documents(frame(spark, three)), "doc_id", "length") == [(1, 3), (1, 3), (None, 1)]


@pytest.mark.parametrize("name,spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
@given(st.lists(st.text(alphabet="ab'sé1 \n\t 　\x1c.,ΑΣ́", max_size=30), max_size=6))
@settings(max_examples=60, deadline=None)
def test_word_store_equals_library(name, spaced, texts):
    import pyarrow as pa

    s = tokenizing.store(tokenizing.tokenizer_path(name), spaced)
    ids, n = s.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(n)
    for t, e, k in zip(texts, ends, n, strict=True):
        assert ids[e - k : e].tolist() == s.tok.encode(t, add_special_tokens=False).ids


def test_word_store_starts_anew_when_full():
    import pyarrow as pa

    s = tokenizing.WordStore(tokenizing.tokenizer_path("word_bpe_49k.json"), False, limit=5)
    for texts in (["a b c d"], ["e f g", "a e"], ["one two three four five six seven"]):
        ids, n = s.encode(pa.array(texts))
        assert ids.tolist() == [i for t in texts for i in s.tok.encode(t, add_special_tokens=False).ids]


def test_full_word_store_keeps_words_met_again(monkeypatch):
    import pyarrow as pa

    s = tokenizing.WordStore(tokenizing.tokenizer_path("byte_bpe_50k.json"), True, limit=12)
    encoded, plain = [], s._encode
    monkeypatch.setattr(s, "_encode", lambda chunks: encoded.append(chunks) or plain(chunks))
    for texts in (["x one two"], ["x one two a1 b2 c3"], ["x one d4 e5 f6 two"], ["x g7 one h8 two i9"], ["x two one j0"]):
        ids, _ = s.encode(pa.array(texts))
        assert ids.tolist() == [i for t in texts for i in s.tok.encode(t, add_special_tokens=False).ids]
    assert sorted(encoded[0]) == [" one", " two", "x"] and sum(map(len, encoded)) == 13 and len(s.k1) <= 12


def test_new_words_are_encoded_many_to_a_text(monkeypatch):
    """One text a word would take most of the library's time for each text's own overhead."""
    import pyarrow as pa

    s = tokenizing.WordStore(tokenizing.tokenizer_path("byte_bpe_50k.json"), True)
    real, texts = s.tok, []

    class Counted:
        def __getattr__(self, name):
            return lambda batch, **k: texts.extend(batch) or getattr(real, name)(batch, **k)

    words = [f"w{i}'s-{i * i}é" if i % 9 else f"line{i}\nnext\t{i}" for i in range(3000)]
    docs = [" ".join(words), "<|endoftext|> a <|endoftext|>", " led  by\n\n spaces \u3000 ", "", "x", "Ġ ĠĠ Ġa \x1c b"]
    monkeypatch.setattr(s, "tok", Counted())
    ids, n = s.encode(pa.array(docs))
    assert len(texts) < 200
    for t, got in zip(docs, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert got.tolist() == real.encode(t, add_special_tokens=False).ids


@given(st.lists(st.integers(0, 300), max_size=900), st.integers(1, 40), st.integers(1, 7))
@settings(max_examples=60, deadline=None)
def test_rans_round_trip(ids, lanes, every):
    a = np.array(ids, np.uint16)
    t = rans.Table.fit(np.bincount(a, minlength=2), 12)
    data = rans.encode(a, np.array([5]), np.array([len(a)]), 3, t, lanes, every)
    f = rans.Frame(data, t)
    assert f.decode().tolist() == ids and f.first == 3
    sections = [f.decode(k).tolist() for k in reversed(range(len(f.marks) + 1))]
    assert [x for s in reversed(sections) for x in s] == ids
    broken = bytearray(data)
    broken[len(broken) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.Frame(bytes(broken), t)


def test_rans_table_of_a_skewed_alphabet():
    counts = np.array([10**9, *[1] * 3000, 0, 5])
    t = rans.Table.fit(counts, 12)
    assert t.freq.sum() == 4096 and (t.freq[counts > 0] > 0).all() and t.freq[3001] == 0


def test_token_files_round_trip(spark, tmp_path):
    encode = direct("byte_bpe_50k.json", 0)
    docs = documents() + [(-5, "first", None, None, None), (None, "no id", None, None, None)]
    path = f"file://{tmp_path}/tokens"
    token_files.write_tokens(frame(spark, docs, extra=True), path, block_tokens=500, parts=3)
    got = rows(token_files.read_tokens(spark, path), "doc_id", "start", "n_tokens", "ids_crc32")
    want, at = [], 0
    for doc, text, *_ in sorted(docs, key=lambda r: -(1 << 63) if r[0] is None else r[0]):
        ids = encode(text)
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == sorted(want, key=repr)
    frames = [r.frame for r in spark.read.parquet(path + "/blocks").collect()]
    assert len(frames) > 3


def test_token_files_empty(spark):
    assert token_files.token_digest(frame(spark, [])).count() == 0
