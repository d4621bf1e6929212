"""Approximate nearest neighbours by cosine: a hash-prefix forest over shards of the vectors.

Each tree hashes a vector to a long string of bits, the signs of its products with random unit
directions.  A shard keeps, per tree, its strings sorted; the vectors that share the first k bits
with a query are one stretch of that array, found by bisection.  A query descends every tree to its
longest match and then ascends all trees together, one bit at a time, until the stretches hold
``wide`` of the shard's distinct vectors.  A vector gets a vote for every tree and every level on which it is met, so
long and frequent matches count most; the ``share`` of the shard with most votes (``least`` at least) is scored exactly.

Vectors are indexed by direction: vectors that differ by a factor share one entry (unit vectors equal to
twelve decimals) with their ``k + 1`` smallest ids, enough for any answer.  So they tie exactly, and a vector
that a third of all rows repeat is one entry.  Shards hold about ``shard_rows`` entries each, dealt by hash;
the stated query set meets every shard in blocks of ``block`` queries.  Nothing is broadcast, and no
candidate list leaves its shard: only the best ``k`` per query and shard do.

Recall against brute force, and the share of vectors scored for it, are in the README and the tests.

Edge cases: vectors that are null, empty, zero or hold null or non-finite numbers take no part; a
vector meets only vectors of its own length; ties go to the smaller id; repeated ids count as one row
each, but a query never answers with its own id; fewer than ``k`` other vectors give as many rows as
there are; no vectors give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEPTH = 63
#: Levels below the first wide one whose matches are counted.
LEVELS = 3


def usable(v: str = "embedding") -> Column:
    """True for a vector of finite numbers that is not zero."""
    x = F.col(v).cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.coalesce(x.isNotNull() & fine & F.exists(x, lambda e: e != 0), F.lit(False))


def directions(dim: int, trees: int, seed: int) -> np.ndarray:
    """Random directions, orthogonal in runs of ``dim``, one per bit of every tree."""
    rng, rows = np.random.default_rng(seed), []
    while len(rows) * dim < trees * DEPTH:
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        rows.append((q * np.sign(np.diag(r))).T)
    return np.concatenate(rows)[: trees * DEPTH].astype(np.float64)


def hash_strings(v: np.ndarray, planes: np.ndarray, trees: int) -> np.ndarray:
    """(rows, trees) hash strings as unsigned numbers, the first bit highest."""
    out = np.empty((len(v), trees), np.uint64)
    for t in range(trees):
        bits = (v @ planes[t * DEPTH : (t + 1) * DEPTH].T) > 0
        out[:, t] = bits @ (np.uint64(1) << np.arange(DEPTH - 1, -1, -1, dtype=np.uint64))
    return out


class Forest:
    """The sorted arrays of one shard."""

    def __init__(self, v: np.ndarray, trees: int, planes: np.ndarray):
        self.v, self.trees, self.planes = v, trees, planes
        h = hash_strings(v, planes, trees)
        self.order = np.argsort(h, axis=0, kind="stable").astype(np.int32)
        self.sorted = [np.ascontiguousarray(h[self.order[:, t], t]) for t in range(trees)]

    def candidates(self, q: np.ndarray, want: int, wide: int) -> list[np.ndarray]:
        """Indexes of each query's ``want`` candidates with most votes, when ``wide`` entries have any."""
        h = hash_strings(q, self.planes, self.trees)
        n = len(self.v)
        deepest = min(DEPTH, 2 * max(1, n.bit_length()) + 8)  # no stretch of distinct vectors is longer in practice
        lo = np.empty((deepest + 1, self.trees, len(q)), np.int32)
        hi = np.empty_like(lo)
        for t in range(self.trees):
            for d in range(deepest + 1):
                shift = np.uint64(DEPTH - d)
                start = (h[:, t] >> shift) << shift
                lo[d, t] = np.searchsorted(self.sorted[t], start)
                hi[d, t] = np.searchsorted(self.sorted[t], start + (np.uint64(1) << shift) - np.uint64(1), side="right")
        out = []
        total = (hi - lo).sum(axis=1)
        for j in range(len(q)):
            # The sum of stretches bounds their union from above, so the ascent can begin where it is wide enough;
            # the levels below that still hold more than a vector or two give their votes first.
            d = max(int(np.count_nonzero(total[:, j] >= wide)) - 1, 0)
            votes = np.zeros(n, np.int32)
            level = min(deepest, d + LEVELS)
            while True:
                for t in range(self.trees):
                    votes[self.order[lo[level, t, j] : hi[level, t, j], t]] += 1
                if level == 0 or level <= d and np.count_nonzero(votes) >= wide:
                    break
                level -= 1
            out.append(np.argpartition(-votes, want - 1)[:want] if want < n else np.arange(n))
        return out


def direction(v: str = "v") -> Column:
    """The unit vector to twelve decimals, without overflow on the way."""
    return F.expr(
        f"transform(array(transform({v}, x -> x / array_max(transform({v}, y -> abs(y))))), "
        "w -> transform(w, x -> round(x / sqrt(aggregate(w, 0d, (s, y) -> s + y * y)), 12) + 0d))[0]"
    )


def nearest(
    vectors: DataFrame,
    every: int = 50,
    k: int = 5,
    trees: int = 128,
    share: float = 0.25,
    wide: float = 0.7,
    least: int = 256,
    shard_rows: int = 8192,
    block: int = 2048,
    seed: int = 7,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row with vec_id divisible by ``every``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(usable("embedding"))
    rows = rows.where("vec_id is not null").withColumn("dim", F.size("v"))
    n = rows.count()
    # The rank filter is pushed below the exchange, so a hot direction sends k + 1 rows a task.
    by_value = Window.partitionBy("u").orderBy("vec_id")
    few = rows.withColumn("u", direction()).withColumn("r", F.row_number().over(by_value)).where(F.col("r") <= k + 1)
    entries = few.groupBy("u").agg(F.first("dim").alias("dim"), F.min_by("v", "vec_id").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    shards = max(1, round(n / shard_rows))
    queries = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-n // every // block))
    index = entries.select("dim", "v", "ids", F.pmod(F.xxhash64("u"), F.lit(shards)).cast("int").alias("shard"))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )

    def matrix(t: pa.Table) -> np.ndarray:
        return t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)

    def search(shard: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if shard.num_rows and asked.num_rows:
            v, q = matrix(shard), matrix(asked)
            ids, qid = shard.column("ids").to_pylist(), asked.column("vec_id").to_pylist()
            nv, nq = np.sqrt(np.einsum("ij,ij->i", v, v)), np.sqrt(np.einsum("ij,ij->i", q, q))
            scale = np.abs(v).max(axis=1, keepdims=True)
            forest = Forest(v / scale, trees, directions(v.shape[1], trees, seed))
            want = min(len(v), max(least, int(share * len(v))))
            met = max(want, int(wide * len(v)))
            for a in range(0, len(q), 256):
                for j, cand in enumerate(forest.candidates(q[a : a + 256], want, met), a):
                    score = (v[cand] @ q[j]) / (nv[cand] * nq[j])
                    keep = len(score)
                    if keep > k + 1:  # all that can be among the best, ties at the edge too
                        edge = np.partition(score, keep - k - 1)[keep - k - 1]
                        near = np.flatnonzero(score >= edge - 1e-12)
                    else:
                        near = np.arange(keep)
                    best = sorted(((-_cosine(v[cand[i]], q[j]), x) for i in near for x in ids[cand[i]] if x != qid[j]))[:k]
                    for s, x in best:
                        out["query_id"].append(qid[j])
                        out["vec_id"].append(x)
                        out["score"].append(-s)
        return pa.table({n: pa.array(x, pa.float64() if n == "score" else pa.int64()) for n, x in out.items()})

    # The index goes to each block of queries: with one block (up to block * every rows) it moves once.
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else index.withColumn("block", F.lit(0))
    keys = ["dim", "shard", "block"]
    found = index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.dot(a, b) / (np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b))))
