"""SimHash near-duplicates: fingerprints, links by generalised pigeonhole search, components.

Distinct fingerprints are searched, not documents, so exact copies cost one row.  The 64 bits are
dealt to partitions, correlated bits together; if the thresholds t_i of m partitions add up to
``distance - m + 1``, two fingerprints within ``distance`` differ in at most t_i bits of some
partition i.  Bit statistics over all distinct fingerprints give, for every partition and
threshold, the expected candidates; a dynamic programme allots unequal thresholds at least cost,
for each number of partitions.  A fingerprint is probed under each partition with every choice of
t_i bits masked out; fingerprints that share a probe are verified against each other.

A probe's bucket links what it verifies as a spanning forest (one edge less than members), never as
all pairs.  Buckets above ``split`` members are cut by a second pigeonhole on all bits (five
blocks, one of which must agree), over other tasks; what is left is searched breadth first, in
memory proportional to its members.  No bucket is capped.

Edge cases: null or empty text has no words and fingerprint zero, linked like any other; fewer
than four words are one shingle; a null doc_id is kept and never becomes a component id where its
group has another; an empty table gives no rows; repeated rows link to themselves; other columns
are not read.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from .components import components

BITS = 64


def shingle_hashes(text: str | None, shingle: int = 4):
    """XXH64 (seed 42) of the shingles in order, in arrays of up to 65 536; nothing without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII white space
    if not words:
        return
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.concatenate([[0], np.cumsum(size)])
    n = max(1, len(words) - shingle + 1)
    ends = (start[min(shingle, len(words)) :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        yield np.array([digest(joined[a:b], 42) for a, b in zip(start[at : min(n, at + (1 << 16))].tolist(), ends[at : at + (1 << 16)], strict=False)], np.uint64)


def majority(hashes) -> int:
    """The bits set in over half of all numbers in some arrays; 0 for none."""
    n, total = 0, np.zeros(BITS, np.int64)
    for h in hashes:
        n += len(h)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Bit i is set if it is set in over half the shingles' XXH64 (seed 42); 0 without words."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long)."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together, over all of them."""

    def run(batches):
        both, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            m = np.unpackbits(b.column("fp").to_numpy().view(np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both, n = both + (m.T @ m), n + len(m)
        at = np.arange(BITS * BITS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(both.ravel(), n))], names=["at", "n"])

    got = dict(fps.select("fp").mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect())
    return int(got.get(BITS * BITS, 0)), np.array([got.get(i, 0.0) for i in range(BITS * BITS)]).reshape(BITS, BITS)


def correlated_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Deal the bits to ``m`` groups of nearly equal size: each next bit joins where it correlates most."""
    p = both.diagonal() / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    groups: list[list[int]] = []
    free = set(range(BITS))
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        first = max(free, key=lambda b: (corr[b, sorted(free)].sum(), -b))
        own = [first]
        free.remove(first)
        while len(own) < size:
            nxt = max(free, key=lambda b: (corr[b, own].sum(), -b))
            own.append(nxt)
            free.remove(nxt)
        groups.append(sorted(own))
    return groups


def candidate_costs(n: int, both: np.ndarray, bits: list[int], most: int) -> list[float]:
    """Cost of threshold -1 (partition not probed), 0, 1, .. most: probes written plus pairs to verify."""
    p = both.diagonal()[bits] / max(n, 1)
    differ = 2 * p * (1 - p)
    dist = np.zeros(len(bits) + 1)
    dist[0] = 1
    for q in differ:
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    out = [0.0]
    for t in range(most + 1):
        if t > len(bits):
            out.append(float("inf"))
            continue
        # A pair at d differing bits meets under C(len - d, t - d) masks; a probe costs PROBE pairs.
        pairs = sum(dist[d] * comb(len(bits) - d, t - d) for d in range(t + 1)) * n * n / 2
        out.append(PROBE * n * comb(len(bits), t) + pairs)
    return out


#: What writing, moving and sorting one probe costs, in verified pairs.
PROBE = 200.0


def allot(n: int, both: np.ndarray, distance: int, partitions=(1, 2, 3, 4, 5)) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe, of least expected cost."""
    best: tuple[float, list] = (float("inf"), [])
    for m in partitions:
        groups = correlated_groups(n, both, m)
        costs = [candidate_costs(n, both, g, distance) for g in groups]
        # Thresholds from -1; with s_i = t_i + 1 the s_i add up to distance + 1.
        need = distance + 1
        table: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * need
        for c in costs:
            table = [min(((table[s - k][0] + c[k], [*table[s - k][1], k]) for k in range(min(s, len(c) - 1) + 1)), key=lambda x: x[0]) for s in range(need + 1)]
        if table[need][0] < best[0]:
            best = (table[need][0], [(g, k - 1) for g, k in zip(groups, table[need][1], strict=True) if k > 0])
    return best[1]


def _masks(plan: list[tuple[list[int], int]]) -> list[tuple[int, int]]:
    """(probe number, bits that must agree) of every probe."""
    out = []
    for bits, t in plan:
        for gone in combinations(bits, t):
            out.append(sum(1 << b for b in bits if b not in gone))
    return list(enumerate(out))


def forest(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges (indexes) of a spanning forest of the graph of fingerprints within ``distance``.

    Breadth first: each fingerprint is compared once with those not reached yet, in one numpy step.
    """
    free, edges = np.arange(len(fp)), []
    while len(free) > 1:
        queue, free = [int(free[0])], free[1:]
        while queue and len(free):
            i = queue.pop()
            near = np.bitwise_count(fp[free] ^ fp[i]) <= distance
            if near.any():
                hit = free[near].tolist()
                edges += [(i, j) for j in hit]
                queue += hit
                free = free[~near]
    return edges


def links(reps: DataFrame, distance: int = 4, split: int = 4096) -> DataFrame:
    """Edges (u, v) between representatives (rep, fp) that keep every component of the link graph."""
    n, both = bit_statistics(reps)
    if n < 2:
        return reps.sparkSession.createDataFrame([], "u long, v long")
    masks = _masks(allot(n, both, distance))
    signed = [(k, np.uint64(m).astype(np.int64).item()) for k, m in masks]

    def probe(batches):
        for b in batches:
            rep, fp = b.column("rep").to_numpy(), b.column("fp").to_numpy()
            for k, m in signed:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(fp), k, np.int32)), pa.array(fp & m), b.column("rep"), b.column("fp")], names=["probe", "key", "rep", "fp"]
                )

    probes = reps.select("rep", "fp").mapInArrow(probe, "probe int, key long, rep long, fp long")
    hot = probes.groupBy("probe", "key").agg(F.count("*").alias("n")).where(F.col("n") > split).select("probe", "key", F.lit(True).alias("hot"))
    # A hot bucket: at most ``distance`` bits differ, so one of distance + 1 blocks of all bits agrees.
    cuts = np.linspace(0, BITS, distance + 2).astype(int)
    block = [F.shiftrightunsigned(F.shiftleft("fp", int(BITS - b)), int(BITS - (b - a))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    subs = F.array(*[F.struct(F.lit(i).alias("i"), x.alias("x")) for i, x in enumerate(block)])
    whole = F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).cast("long").alias("x")))
    probes = (
        probes.join(hot, ["probe", "key"], "left")
        .select("probe", "key", "rep", "fp", F.explode(F.when(F.col("hot"), subs).otherwise(whole)).alias("s"))
        .select(F.xxhash64("probe", "key", "s.i", "s.x").alias("bucket"), "rep", "fp")
    )

    def verify(batches):
        """Sorted by bucket; a bucket's rows follow each other, over batches too."""
        last, rep, fp = None, [], []

        def done():
            r, f = np.concatenate(rep), np.concatenate(fp)
            f, first = np.unique(f, return_index=True)
            r = r[first]
            e = forest(f, distance) if len(f) > 1 else []
            return [(int(r[i]), int(r[j])) for i, j in e]

        for b in batches:
            key = b.column("bucket").to_numpy()
            r, f = b.column("rep").to_numpy(), b.column("fp").to_numpy().view(np.uint64)
            cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else [0]
            edges: list[tuple[int, int]] = []
            # Buckets of one row, nearly all of them, are skipped at once.
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                if last is not None and key[a] != last:
                    if len(rep) > 1 or len(rep[0]) > 1:
                        edges += done()
                    rep, fp = [], []
                last = key[a]
                rep.append(r[a:z])
                fp.append(f[a:z])
            if edges:
                u, v = zip(*edges, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
        if rep and (len(rep) > 1 or len(rep[0]) > 1) and (edges := done()):
            u, v = zip(*edges, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return probes.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(verify, "u long, v long")


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, split: int = 4096) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable)."""
    fps = scratch(fingerprints(docs, shingle), "simhash")
    # Documents without an id stand behind all others, so an id names the group where there is one.
    far = (1 << 63) - 1
    reps = scratch(fps.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(far))).alias("rep")), "simhash-reps")
    comp = components(links(reps, distance, split))
    named = reps.join(comp, reps["rep"] == comp["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    named = named.withColumn("component_id", F.nullif("component_id", F.lit(far)))
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each group, one with the smallest doc_id (null last), with all its columns."""
    # Rows are told apart by their place in a written copy, so repeated and null ids decide nothing together.
    keyed = scratch(docs.withColumn("__row", F.monotonically_increasing_id()), "simhash-rows")
    group = near_duplicates(keyed.select(F.col("__row").alias("doc_id"), "text"), **options).select(F.col("doc_id").alias("__row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__row")
    best = keyed.select("__row", "doc_id").join(group, "__row").groupBy("component_id").agg(F.min(order).alias("first"))
    return keyed.join(best.select(F.col("first")["__row"].alias("__row")), "__row", "left_semi").select(*docs.columns)
