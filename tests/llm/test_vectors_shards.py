import os

import json

import numpy as np
import pytest

from rostrum.llm import neighbours, shards

from ..conftest import SF
from .helpers import documents, frame, rows


def table(spark, v, ids=None):
    data = [(int(i), None if x is None else [None if c is None else float(c) for c in x]) for i, x in zip(ids if ids is not None else range(len(v)), v, strict=True)]
    return spark.createDataFrame(data, "vec_id long, embedding array<double>").selectExpr("*", "'clash' AS shard", "1 AS rank")


def brute(v, ids, k=5, every=50):
    out = {}
    n = v / np.linalg.norm(v, axis=1)[:, None]
    for i, q in enumerate(ids):
        if q % every == 0:
            s = n @ n[i]
            out[q] = [x for _, x in sorted((-round(s[j], 12), ids[j]) for j in range(len(ids)) if ids[j] != q)][:k]
    return out


def test_recall_and_order(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((3000, 32))
    v[1000:1300] = v[0] * rng.uniform(0.5, 2, 300)[:, None]  # one direction, 300 lengths
    v[2000:2200] = v[50]  # one very common vector
    got = {}
    for r in neighbours.nearest(table(spark, v), shard_rows=700).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(v, list(range(3000)))
    hits = 0
    for q, w in want.items():
        assert [r for r, _, _ in got[q]] == [1, 2, 3, 4, 5]
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(got[q], got[q][1:], strict=False))
        hits += len({x for _, x, _ in got[q]} & set(w))
    assert hits >= 0.9 * 5 * len(want)
    assert [x for _, x, _ in got[50]] == [2000, 2001, 2002, 2003, 2004]


def test_all_candidates_are_exact(spark):
    v = np.random.default_rng(1).standard_normal((400, 8))
    got = {}
    for r in neighbours.nearest(table(spark, v), share=1.0, shard_rows=100, block=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute(v, list(range(400)))


def test_every_length_takes_part(spark):
    rng = np.random.default_rng(2)
    v = [rng.standard_normal(3 + i % 2).tolist() for i in range(60)]
    got = {}
    for r in neighbours.nearest(table(spark, v), every=10, share=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    own = brute(np.array(v[::2]), list(range(0, 60, 2)), every=10)
    assert got == own


def test_scored_share():
    v = np.random.default_rng(3).standard_normal((4000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    f = neighbours.Forest(v, 128, neighbours.directions(64, 128, 7))
    q = np.arange(0, 4000, 50)
    cand = f.candidates(v[q], 1000, 2800)
    hits = sum(len(set(np.argsort(-np.where(np.arange(4000) == i, -9, v @ v[i]))[:5].tolist()) & set(c.tolist())) for i, c in zip(q, cand, strict=True))
    assert hits >= 0.93 * 5 * len(q) and sum(map(len, cand)) == 1000 * len(q)
    # The same number of entries without the forest's votes finds a quarter.
    blind = np.random.default_rng(4).permutation(4000)[:1000].tolist()
    hits = sum(len(set(np.argsort(-np.where(np.arange(4000) == i, -9, v @ v[i]))[:5].tolist()) & set(blind)) for i in q)
    assert hits < 0.4 * 5 * len(q)


@pytest.mark.parametrize("name", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_tables(spark, name):
    path = os.path.join(os.path.dirname(SF), name)
    if not os.path.isdir(path):
        pytest.skip("no such table")
    df = spark.read.parquet(f"{path}/embeddings.parquet")
    data = {r.vec_id: np.array(r.embedding, float) for r in df.collect() if r.embedding is not None}
    ids = np.array(sorted(data))
    v = np.stack([data[i] / np.linalg.norm(data[i]) for i in ids])
    got = {}
    for r in neighbours.nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for j in np.flatnonzero(ids % 50 == 0):
        score = v @ v[j]
        score[j] = -9
        hits += len(got[ids[j]] & set(ids[np.argsort(-score)[:5]].tolist()))
    assert hits >= 0.93 * 5 * len(got)


def test_unusable_vectors(spark):
    v = [[1, 0], None, [0, 0], [None, 1], [float("nan"), 1], [float("inf"), 1], [], [1, 1], [2, 2, 2]]
    got = neighbours.nearest(table(spark, v, [0, 1, 2, 3, 4, 5, 6, 7, 50]))
    assert rows(got, "query_id", "rank", "vec_id") == [(0, 1, 7)]
    assert neighbours.nearest(table(spark, [None])).count() == 0
    assert neighbours.nearest(table(spark, [])).count() == 0


def test_store_keeps_every_row_and_every_version(spark, tmp_path):
    docs = frame(spark, extra=True)
    store = shards.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=1 << 14, fan_in=3, small_bytes=512)
    assert store.version() == 0 and store.shards() == []
    store.append(docs.where("doc_id < 20"), rows_per_file=4)
    store.append(docs.where("doc_id >= 20"), rows_per_file=4)
    assert store.version() == 2
    before = len(store.shards())
    store.compact()
    assert len(store.shards()) < before and len(store.shards(2)) == before
    assert rows(store.read(), *docs.columns) == rows(docs, *docs.columns) == rows(store.read(2), *docs.columns)
    below = [s for s in store.shards() if s.bytes < store.target // 2]
    assert all(sum(x.tier == s.tier for x in below) < 3 for s in below)
    assert store.vacuum() > 0 and store.vacuum() == 0
    assert rows(store.read(), "doc_id") == rows(docs, "doc_id")


def test_two_writers(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/s")
    store.append(frame(spark, []))
    other = shards.ShardStore(spark, store.path)
    base = other.version()
    store.append(frame(spark))
    with pytest.raises(shards.Conflict):
        other._commit(base, [], json.dumps({}))
    assert store.version() == 2 and store.read().count() == len(documents()) and store.read(1).count() == 0


def test_sharded_documents(spark):
    import hashlib

    got = rows(shards.shard_documents(frame(spark), rows_per_file=5, target_bytes=1 << 13), "doc_id", "n_bytes", "text_sha256")
    want = [(d[0], None, None) if d[1] is None else (d[0], len(d[1].encode()), hashlib.sha256(d[1].encode()).hexdigest()) for d in documents()]
    assert got == sorted(want, key=repr)
    assert shards.shard_documents(frame(spark, [])).count() == 0


def test_one_of_many_writers_gets_a_version(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    store = shards.ShardStore(spark, f"file://{tmp_path}/race")
    store.append(frame(spark))

    def claim(i):
        try:
            return store._commit(1, [shards.Shard(f"w{i}", 1, 0)], store.schema())
        except shards.Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        got = [x for x in pool.map(claim, range(16)) if x]
    assert got == [2] and store.version() == 2 and len(store.shards()) == 1
    assert store.vacuum(older_than_s=3600) == 0
