"""Near copies: SimHash search carried on to a Jaccard similarity of at least ``least`` of five-word shingles.

Pairs of a similarity of 0.8 differ in 9.7 of 64 fingerprint bits on average, so the pigeonhole search of
:mod:`simhash` at four bits meets only the closest of them, and at the 18 bits that would meet 99.8 % its
buckets are no smaller than the corpus.  So its links are the first candidates, and those it must miss
come from min-hashes: a pair shares none of ``BANDS`` bands of ``ROWS`` at similarity 0.8 with probability
(1 - 0.8**5)**50 = 2.4e-9.  Every link is verified on the exact sets.

Distinct sets are searched, not documents, so exact copies cost one row.  The members of a band are
first compared with its smallest member; bands that then still hold several components go, with their
texts, to one task each, which compares across components until nothing more links.  No band is
capped and no list of all its pairs is made.

Edge cases: null or empty text has no words, and all such texts are equal; fewer than five words are
one shingle; a null doc_id comes last in its group; rows are told apart by their place in a written
copy of the table, so repeated doc_ids are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_scratch, scratch
from .components import components
from .simhash import links, majority, shingle_hashes

BANDS, ROWS = 50, 5
_RNG = np.random.default_rng(42)
_A = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
#: Rows a centre's text is spread over, so that the centre of a large group is no hot key.
SALT = 16


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles; empty without words."""
    got = list(shingle_hashes(text, shingle))
    return np.unique(np.concatenate(got)) if got else np.empty(0, np.uint64)


def band_keys(s: np.ndarray) -> np.ndarray:
    """One 64-bit key per band: a hash of its least hashes."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(s), 1 << 12):
        x = s[at : at + (1 << 12), None] ^ _B
        x *= _A
        x ^= x >> np.uint64(32)
        x *= _A
        least = np.minimum(least, x.min(axis=0))
    raw = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(raw)], np.uint64).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def cross_links(sets: list[np.ndarray], label: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges (places) between members of different labels, enough to join all that pairs join."""
    size = np.array([len(s) for s in sets])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    ids, at = np.unique(np.concatenate(sets), return_inverse=True)
    label, edges, mark = label.copy(), [], np.zeros(len(ids), np.int64)
    names, n = np.unique(label, return_counts=True)
    # The largest component is compared by all others with it, so its own members never start.
    starts = np.flatnonzero(label != names[n.argmax()])
    for i in starts.tolist():
        own = at[start[i] : start[i] + size[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[at], start)
        mark[own] = 0
        near = (both >= least * (size + size[i] - both)) & (label != label[i])
        for name in np.unique(label[near]).tolist():
            edges.append((i, int(np.flatnonzero(near & (label == name))[0])))
            label[label == name] = label[i]
    return edges


def sketches(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """row, doc (the largest long for null), h0 and h1 (128 bits that name the set), n, fp, keys (none for an empty set)."""

    def run(batches):
        for b in batches:
            names, n, fp, keys = [], [], [], []
            for t in b.column("text").to_pylist():
                s = shingle_set(t, shingle)
                names.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64))
                n.append(len(s))
                fp.append(majority(s[at : at + (1 << 16)] for at in range(0, len(s), 1 << 16)))
                keys.append(band_keys(s) if len(s) else ())
            h = np.array(names, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc"), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(n, pa.int64()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
                names=["row", "doc", "h0", "h1", "n", "fp", "keys"],
            )

    far = F.lit((1 << 63) - 1)
    cols = docs.select(F.col("__row").alias("row"), F.coalesce(F.col("doc_id").cast("long"), far).alias("doc"), "text")
    return cols.mapInArrow(run, "row long, doc long, h0 long, h1 long, n long, fp long, keys array<long>")


def verified(pairs: DataFrame, texts: DataFrame, least: float, shingle: int) -> DataFrame:
    """The pairs (u, v) that are similar; texts has row and text."""
    salt = F.pmod("u", F.lit(SALT)).alias("salt")
    right = pairs.select("v", salt).distinct().join(texts.select(F.col("row").alias("v"), F.col("text").alias("tv")), "v")
    both = pairs.select("u", "v", salt).join(texts.select(F.col("row").alias("u"), F.col("text").alias("tu")), "u").join(right, ["v", "salt"])

    def run(batches):
        last, s = None, None
        for b in batches:
            ok = []
            for v, tu, tv in zip(*(b.column(c).to_pylist() for c in ("v", "tu", "tv")), strict=True):
                if v != last:
                    last, s = v, shingle_set(tv, shingle)
                ok.append(similar(shingle_set(tu, shingle), s, least))
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return both.select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long")


def linked(buckets: DataFrame, least: float, shingle: int) -> DataFrame:
    """Edges (u, v) across the components of each bucket (key, row, label, text)."""

    def run(batches):
        last, rows, labels, sets = None, [], [], []

        def done():
            if len(set(labels)) < 2:
                return []
            return [(rows[i], rows[j]) for i, j in cross_links(sets, np.array(labels, np.int64), least)]

        def batch(edges):
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for b in batches:
            edges = []
            for key, row, label, text in zip(*(b.column(c).to_pylist() for c in ("key", "row", "label", "text")), strict=True):
                if key != last:
                    edges += done()
                    last, rows, labels, sets = key, [], [], []
                rows.append(row)
                labels.append(label)
                sets.append(shingle_set(text, shingle))
            yield batch(edges)
        yield batch(done())

    parts = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return buckets.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


#: Row ids are sent to every task up to so many (16 MB), beyond that joined by key.
BROADCAST_ROWS = 2_000_000


def of_rows(df: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The rows of ``df`` (``how`` left_semi) or all others (left_anti) by the column of ``rows``: texts do not move for few ids."""
    return df.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows, rows.columns[0], how)


def keep_one(docs: DataFrame, least: float = 0.8, shingle: int = 5, distance: int = 4) -> DataFrame:
    """One row of each component of near copies, the one with the smallest doc_id, with all its columns."""
    keyed = scratch(docs.withColumn("__row", F.monotonically_increasing_id()), "near-rows")
    first = F.min(F.struct("doc", "row")).alias("first")
    reps = sketches(keyed, shingle).groupBy("h0", "h1").agg(first, F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    reps = scratch(reps.select("first.doc", "first.row", "n", "fp", "keys"), "near-sets")
    # Fingerprints within the distance: one row for each fingerprint searches, its others link to it.
    leads = scratch(reps.groupBy("fp").agg(F.min("row").alias("rep")), "near-leads")
    close = links(leads, distance).unionByName(reps.join(leads, "fp").where("row <> rep").select(F.col("row").alias("u"), F.col("rep").alias("v")))
    texts = keyed.select(F.col("__row").alias("row"), "text")
    # One exchange serves the count of each band and the join with it.
    bands = reps.select("row", "n", F.explode("keys").alias("key")).repartition("key")
    centre = bands.groupBy("key").agg(F.min(F.struct("row", "n")).alias("c"), F.count("*").alias("members")).where("members > 1")
    bands = scratch(bands.join(centre, "key"), "near-bands")
    # Sets whose sizes differ too much cannot be similar.
    fits = F.least("n", "c.n") >= F.lit(least) * F.greatest("n", "c.n")
    pairs = bands.where((F.col("row") != F.col("c.row")) & fits).select(F.col("row").alias("u"), F.col("c.row").alias("v"))
    pairs = scratch(pairs.unionByName(close.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))).distinct(), "near-pairs")
    asked = scratch(pairs.select(F.col("u").alias("row")).unionByName(pairs.select(F.col("v").alias("row"))).distinct(), "near-asked")
    some = scratch(of_rows(texts, asked, "left_semi"), "near-texts")
    edges = scratch(verified(pairs, some, least, shingle), "near-edges")
    drop_scratch(asked, some)
    comp = components(edges)
    # A band of two is settled by its one pair; of the others, those that hold several components.
    more = bands.where("members > 2").join(comp, bands["row"] == comp["node"], "left").select("key", "row", F.coalesce("component", "row").alias("label"))
    more = scratch(more, "near-more")
    left = more.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key")
    open_bands = scratch(more.join(left, "key"), "near-open")
    some = scratch(of_rows(texts, scratch(open_bands.select("row").distinct(), "near-asked"), "left_semi"), "near-texts")
    rest = scratch(linked(open_bands.join(some, "row"), least, shingle), "near-edges")
    drop_scratch(more, open_bands, some)
    comp = components(edges.unionByName(rest))
    named = reps.join(comp, reps["row"] == comp["node"], "left").groupBy(F.coalesce("component", "row").alias("group")).agg(first)
    kept = scratch(named.select(F.col("first.row").alias("__row")), "near-kept")
    drop_scratch(reps, leads, bands, pairs, edges, rest)
    gone = scratch(keyed.select("__row").join(kept, "__row", "left_anti"), "near-gone")
    return of_rows(keyed, gone, "left_anti").select(*docs.columns)
