import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from rostrum.llm import components, simhash, substrings

from .helpers import documents, frame, rows


def slow_fingerprint(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def slow_components(fp, distance):
    root = list(range(len(fp)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fp))]


@given(st.text(alphabet="aB éİ\n\x1c ß", max_size=60))
@settings(max_examples=80, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_fingerprint_equals_engine_hash(spark):
    from pyspark.sql import functions as F

    (h,) = spark.range(1).select(F.xxhash64(F.lit("one two three four"))).first()
    assert h % (1 << 64) == xxhash.xxh64_intdigest(b"one two three four", 42)


def test_near_duplicates_against_all_pairs(spark):
    docs = documents(n=80)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(frame(spark, docs, extra=True)).collect()}
    fp = [slow_fingerprint(d[1]) for d in docs]
    want = slow_components(fp, 4)
    assert got == {d[0]: (f, w) for d, f, w in zip(docs, fp, want, strict=True)}


@pytest.mark.parametrize("split", [4096, 3])
def test_links_between_random_fingerprints(spark, split):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(25)]
    fp = [*centres]
    for c in centres:
        for _ in range(12):
            x = c
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
            fp.append(x)
            c = x if rng.random() < 0.5 else c
    fp = sorted(set(fp))
    signed = [x - (1 << 64) if x >> 63 else x for x in fp]
    reps = spark.createDataFrame(list(zip(range(len(fp)), signed, strict=True)), "rep long, fp long")
    comp = {r.node: r.component for r in components.components(simhash.links(reps, 4, split)).collect()}
    assert [comp.get(i, i) for i in range(len(fp))] == slow_components(fp, 4)


def test_allotment_covers_the_distance():
    rng = np.random.default_rng(0)
    for n in (10, 10**5, 10**9):
        both = rng.random((64, 64)) * n
        both[np.diag_indices(64)] = n / 2
        plan = simhash.allot(n, both, 4)
        # Partitions that are not probed count -1: the sum over all must reach 4 - m + 1.
        assert sum(t + 1 for _, t in plan) == 5


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 500), (7, 3)]
    got = components.components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.component for r in got.collect()} == {i: 0 for i in range(201)}


def test_duplicates_edge_tables(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    docs = [(7, None, None, None, None), (7, None, None, None, None), (None, "", None, None, None), (3, " ", None, None, None)]
    assert rows(simhash.near_duplicates(frame(spark, docs)), "doc_id", "component_id") == [(3, 3), (7, 3), (7, 3), (None, 3)]
    assert sorted(r.doc_id for r in simhash.keep_one(frame(spark, docs)).collect()) == [3]


def slow_substrings(docs, length=50):
    docs = [((1 << 62) if i is None else i, (t or "").encode()) for i, t, *_ in docs]
    first, out = {}, []
    for i, t in docs:
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            first[w] = min(first.get(w, 1 << 70), i)
    for i, t in docs:
        gone = np.zeros(len(t) + 2, bool)
        for s in range(len(t) - length + 1):
            if first[t[s : s + length]] < i:
                gone[s + 1 : s + 1 + length] = True
        kept = bytes(b for b, g in zip(t, gone[1:], strict=False) if not g)
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]))
        out.append((None if i == 1 << 62 else i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


COLS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_substrings_against_brute_force(spark):
    docs = documents(n=80)
    assert rows(substrings.digest(frame(spark, docs, extra=True)), *COLS) == slow_substrings(docs)


@pytest.mark.parametrize("length", [32, 50, 69])
def test_substrings_in_small_chunks(spark, length):
    rng = random.Random(length)
    base = "".join(rng.choice("abc ") for _ in range(2500))
    docs = []
    for i in range(90):
        kind = rng.random()
        if kind < 0.2:
            t = "a" * rng.randint(0, 300)
        elif kind < 0.4:
            t = ("xyzé" * 100)[: rng.randint(0, 300)]
        else:
            a = rng.randint(0, 2400)
            t = "".join(rng.choice("abé") for _ in range(rng.randint(0, 50))) + base[a : a + rng.randint(20, 200)]
        docs.append((rng.choice([i, i, i // 2, None]), t if rng.random() > 0.03 else None))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = substrings.repeated(df, length, chunk_bytes=600, stretch=400).selectExpr(
        "doc_id", "n_bytes", "aggregate(spans, 0L, (s, x) -> s + x.end - x.start) n_removed", "size(spans) n_spans", "kept_sha256"
    )
    assert rows(got, *COLS) == slow_substrings(docs, length)


def test_strip_and_edges(spark):
    a, b = "é" * 40, "0123456789" * 6
    docs = [(1, f"{a} {b}", "en", "s", 1), (2, f"x{b}y", "en", "s", None), (3, None, None, None, None)]
    got = {r.doc_id: r for r in substrings.strip(frame(spark, docs, extra=True)).collect()}
    assert got[1].text == docs[0][1] and got[1].n_chars == 1 and got[3].text is None
    assert got[2].text == "xy" and got[2].n_chars == 2 and got[2].chunk == "clash"
    assert substrings.digest(frame(spark, [])).count() == 0


def test_packed_keys_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        key = np.sort(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        run, doc = rng.integers(0, 1 << 64, n, dtype=np.uint64), rng.integers(-5, 5, n)
        for second in (run, None):
            k, r, d = substrings._open(substrings._message(0, 0, key, second, doc)[2], second is not None)
            assert (k == key).all() and (d == doc).all() and (second is None or (r == run).all())
