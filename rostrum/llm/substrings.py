"""Exact substring deduplication: suffix buckets by q-gram, refined on identifiers of later offsets.

A byte goes if some ``length``-byte string over it also starts in a document with a smaller doc_id.

*Identifiers.* Every position gets an identifier of its bucket: first of its byte, then, doubling,
``id_2k[i]`` names the pair ``(id_k[i], id_k[i + k])``.  That is bucket-pointer refinement: a bucket
is split by the identifiers that its suffixes' later offsets already have, and each refinement
serves the next.  Here an identifier is a 64-bit name computed from the pair instead of a rank, so
documents on different machines agree on it without a global sort.

*Initial buckets.* A suffix array of everything is not needed, only buckets that reach over
documents.  Each window of ``length`` bytes is filed under the least identifier of its ``Q``-grams;
neighbours under one identifier form a run.  So there is one entry per run, about every fourteenth
byte, and equal windows always meet under the same initial bucket.

*Refinement.* A bucket's entries meet in one task.  First they are sorted by (bucket, identifiers at the
run's later offsets, document): a run also met in a smaller document is wholly repeated.  Only buckets
that then still hold different runs are refined again: the smallest document of each run sends its windows,
sorted by (bucket, identifier over all ``length`` bytes, document).  Names are compared inside a bucket only,
that is among the few dozen different strings over one q-gram, so even 10^12 windows leave an expected
10^12 * 10^2 / 2^64 = 5e-6 pairs of different strings with one name.

Documents are dealt by hash to chunks of about ``chunk_bytes``; a chunk sends each distinct entry
once, with its smallest document, packed in arrays, and gets back bits in the same order.  A passage
that every document holds is one entry per chunk.  Bytes move once; the second and third pass
read the same exchange.  Buckets are dealt to parts by ranges of identifiers with even shares, each
of about ``part_bytes`` of text, whatever the number of chunks.

Edge cases: null text is empty; texts shorter than ``length`` keep all bytes; documents with the
same doc_id never remove each other's bytes; a null doc_id counts as larger than all others; an
empty table gives no rows; ``strip`` leaves out bytes of split characters and keeps extra columns.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Q = 24
MAX_RUN = 27
_U = np.uint64
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xFF51AFD7ED558CCD)
NO_ID = (1 << 63) - 1


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifier of the pair of two identifiers."""
    x = a * _M1
    x ^= x >> _U(29)
    x += b
    x *= _M2
    x ^= x >> _U(32)
    return x


def _finish(x: np.ndarray) -> np.ndarray:
    x = x * _M3
    x ^= x >> _U(33)
    return x


class Names:
    """Identifiers of one stretch of bytes: several documents in a row, ``own[i]``: i starts a whole window."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, length: int, buckets: bool = True):
        self.length = length
        n = len(data) - length + 1
        ends = np.cumsum(sizes)
        own = np.zeros(max(0, len(data)), np.int8)
        starts = (ends - sizes)[sizes >= length]
        stops = ends[sizes >= length] - length + 1
        mark = np.zeros(len(data) + 1, np.int8)
        np.add.at(mark, starts, 1)
        np.add.at(mark, stops, -1)
        own = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
        self.own = own[: max(0, n)]
        i1 = (data.astype(_U) + _U(1)) * _M3
        i2 = _pair(i1[:-1], i1[1:])
        i4 = _pair(i2[:-2], i2[2:])
        i8 = _pair(i4[:-4], i4[4:])
        i16 = _pair(i8[:-8], i8[8:])
        self.i32 = _pair(i16[:-16], i16[16:])
        if not buckets:
            return
        m = len(data) - Q + 1
        iq = _finish(_pair(i16[:m], i8[16 : 16 + m]))
        # Least identifier of the length - Q + 1 grams of each window.
        span, k, least = length - Q + 1, 1, iq
        while 2 * k <= span:
            least = np.minimum(least[: len(least) - k], least[k:])
            k *= 2
        if k < span:
            rest = span - k
            least = np.minimum(least[: len(least) - rest], least[rest:])
        self.bucket = least[:n]

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, number of windows) of maximal runs of own windows in one bucket, of MAX_RUN windows at most."""
        b, own = self.bucket, self.own
        new = np.empty(len(b), bool)
        new[0] = True
        new[1:] = (b[1:] != b[:-1]) | (own[1:] != own[:-1])
        # Two documents can follow each other only with length - 1 foreign windows in between.
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(b)))
        at, n = at[own[at]], n[own[at]]
        pieces = -(-n // MAX_RUN)
        if (pieces > 1).any():
            k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            at = np.repeat(at, pieces) + k * MAX_RUN
            n = np.minimum(MAX_RUN, np.repeat(n, pieces) - k * MAX_RUN)
        return at, n

    def run_names(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        end = at + n - 1 + self.length - 32
        mid = at + (end - at) // 2
        return _finish(_pair(_pair(self.i32[at], self.i32[mid]), self.i32[end]) + n.astype(_U) * _M1)

    def window_names(self, at: np.ndarray) -> np.ndarray:
        return _finish(_pair(self.i32[at], self.i32[at + self.length - 32]))


class Chunk:
    """The documents of one chunk in a fixed order, walked in stretches of bounded size."""

    def __init__(self, table: pa.Table, length: int, stretch: int):
        ids = [NO_ID if x is None else x for x in table.column("doc_id").to_pylist()]
        col = table.column("text").combine_chunks()
        text = [b"" if x is None else x for x in col.cast(pa.binary()).to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], len(text[i]), text[i]))
        self.order = order
        self.text, self.doc = [text[i] for i in order], np.array([ids[i] for i in order], np.int64)
        self.null = np.array([table.column("doc_id")[i].as_py() is None for i in order], bool)
        self.length, self.stretch = length, stretch
        self.doc_list = np.unique(self.doc)

    def bounds(self):
        """(first document, sizes) of stretches of whole documents."""
        i = 0
        while i < len(self.text):
            j, held = i, 0
            while j < len(self.text) and (j == i or held + len(self.text[j]) <= self.stretch):
                held += len(self.text[j])
                j += 1
            yield i, np.array([len(t) for t in self.text[i:j]], np.int64)
            i = j

    def names(self, i: int, sizes: np.ndarray, buckets: bool = True) -> Names:
        return Names(np.frombuffer(b"".join(self.text[i : i + len(sizes)]), np.uint8), sizes, self.length, buckets)

    def walk(self) -> "Runs":
        """All runs of the chunk; identifiers are held for one stretch at a time."""
        got = []
        for i, sizes in self.bounds():
            if (sizes >= self.length).any():
                names = self.names(i, sizes)
                at, n = names.runs()
                doc = self.doc[i + np.searchsorted(np.cumsum(sizes), at, side="right")]
                got.append((np.full(len(at), i, np.int32), at.astype(np.int32), n.astype(np.int8), names.bucket[at], names.run_names(at, n), doc))
        kinds = (np.int32, np.int32, np.int8, _U, _U, np.int64)
        return Runs(*(np.concatenate(x) for x in zip(*got, strict=True))) if got else Runs(*(np.empty(0, k) for k in kinds))


class Runs:
    """Runs of a chunk: stretch, start, windows, bucket, name and document, and their distinct entries.

    Entry ``place[j]`` of the sorted distinct (bucket, name) is that of run j; ``first`` has its smallest document.
    """

    def __init__(self, stretch, at, n, bucket, name, doc):
        self.stretch, self.at, self.n, self.doc, self.own = stretch, at, n, doc, bucket
        self.bucket, self.name, self.first, self.place = _distinct(bucket, name, doc)


def _distinct(b, r, d):
    """Sorted distinct (b, r) with the least d of each, and the place of every given pair among them."""
    order = np.lexsort((d, r, b))
    b, r, d = b[order], r[order], d[order]
    new = np.ones(len(b), bool)
    new[1:] = (b[1:] != b[:-1]) | (r[1:] != r[:-1])
    place = np.empty(len(b), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return b[new], r[new], d[new], place


# Messages are packed: the sorted first key as byte-wise differences, documents as places in a list.


def _pack_sorted(x: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit numbers as varying-length differences."""
    diff = np.diff(x, prepend=_U(0))
    width = np.maximum(1, (64 - _leading(diff) + 7) // 8).astype(np.uint8)
    raw = diff.astype("<u8").view(np.uint8).reshape(-1, 8)
    return width.tobytes() + raw[np.arange(8) < width[:, None]].tobytes()


def _leading(x: np.ndarray) -> np.ndarray:
    n = np.full(len(x), 64, np.int64)
    y = x.copy()
    for s in (32, 16, 8, 4, 2, 1):
        big = y >> _U(s)
        m = big != 0
        n[m] -= s
        y[m] = big[m]
    return n - (y != 0)


def _unpack_sorted(data: memoryview, n: int) -> tuple[np.ndarray, int]:
    width = np.frombuffer(data, np.uint8, n)
    used = int(width.sum())
    raw = np.zeros((n, 8), np.uint8)
    raw[np.arange(8) < width[:, None]] = np.frombuffer(data, np.uint8, used, n)
    return np.cumsum(raw.view("<u8").ravel(), dtype=_U), n + used


def _message(part: int, chunk: int, key: np.ndarray, second: np.ndarray | None, doc: np.ndarray) -> tuple:
    docs, at = np.unique(doc, return_inverse=True)
    kind = "<u2" if len(docs) <= 1 << 16 else "<u4"
    first = docs[0] if len(docs) else np.int64(0)
    head = np.array([len(key), len(docs), first], "<i8").tobytes()
    body = head + _pack_sorted((docs - first).astype(_U)) + at.astype(kind).tobytes() + (b"" if second is None else second.astype("<u8").tobytes()) + _pack_sorted(key)
    return part, chunk, body


def _open(body: bytes, second: bool = True):
    m = memoryview(body)
    n, k, first = np.frombuffer(m, "<i8", 3).tolist()
    docs, used = _unpack_sorted(m[24:], k)
    docs = docs.astype(np.int64) + first
    at = 24 + used
    kind = "<u2" if k <= 1 << 16 else "<u4"
    place = np.frombuffer(m, kind, n, at)
    at += place.nbytes
    r = None
    if second:
        r = np.frombuffer(m, "<u8", n, at)
        at += r.nbytes
    key, _ = _unpack_sorted(m[at:], n)
    return key, r, docs[place]


def _split(key: np.ndarray, parts: int, draws: int = 1) -> np.ndarray:
    """Where each part's share of the sorted keys begins: parts are ranges of the key space.

    A key that is the least of ``draws`` identifiers is small more often than not; the ranges are
    quantiles of that distribution, so parts get equal shares.
    """
    p = np.arange(1, parts) / parts
    edge = (-np.expm1(np.log1p(-p) / draws) * 2.0**64).astype(_U)
    return np.concatenate([[0], np.searchsorted(key, edge), [len(key)]])


def _rows(rows: list[tuple], names: list[str]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    kinds = {"part": pa.int32(), "chunk": pa.int32(), "kind": pa.int32(), "body": pa.binary()}
    return pa.table({n: pa.array(c, kinds[n]) for n, c in zip(names, cols, strict=True)})


def _refine(table: pa.Table, first: bool) -> pa.Table:
    """All messages of one part: sort by (bucket, later identifiers, document) and answer every sender.

    Answer bits, in the order of the sender's entries: the entry is in a smaller document too; and,
    for runs, its windows must be compared (it has the smallest document of its run, and its bucket
    holds other runs).
    """
    chunks = table.column("chunk").to_pylist()
    opened = [_open(b) for b in table.column("body").to_pylist()]
    size = [len(x[0]) for x in opened]
    key = np.concatenate([x[0] for x in opened])
    run = np.concatenate([x[1] for x in opened])
    doc = np.concatenate([x[2] for x in opened])
    del opened
    order = np.lexsort((doc, run, key))
    k, r, d = key[order], run[order], doc[order]
    new_key = np.ones(len(k), bool)
    new_key[1:] = k[1:] != k[:-1]
    new = new_key.copy()
    new[1:] |= r[1:] != r[:-1]
    again = d > d[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
    answer = [np.empty(len(k), bool), np.empty(len(k), bool)]
    answer[0][order] = again
    group = np.cumsum(new_key) - 1
    many = (np.bincount(group, weights=new) > 1)[group] if len(k) else np.zeros(0, bool)
    answer[1][order] = many & ~again
    out, at = [], 0
    for c, n in zip(chunks, size, strict=True):
        bits = b"".join(np.packbits(a[at : at + n]).tobytes() for a in answer[: 2 if first else 1])
        out.append((table.column("part")[0].as_py(), c, 1 if first else 2, bits))
        at += n
    return _rows(out, ["part", "chunk", "kind", "body"])


def _answers(messages: pa.Table, kind: int, cuts: np.ndarray, bits: int) -> list[np.ndarray]:
    """The answers to one chunk's entries, put together from all parts."""
    out = [np.zeros(int(cuts[-1]), bool) for _ in range(bits)]
    for p, k, body in zip(*(messages.column(x).to_pylist() for x in ("part", "kind", "body")), strict=True):
        if k == kind:
            a, z = int(cuts[p]), int(cuts[p + 1])
            raw = np.frombuffer(body, np.uint8).reshape(bits, -1)
            for o, x in zip(out, raw, strict=True):
                o[a:z] = np.unpackbits(x, count=z - a)
    return out


class Pending:
    """A chunk's runs after the first answers: those wholly repeated, and the windows still to compare."""

    def __init__(self, chunk: Chunk, runs: Runs, again: np.ndarray, compare: np.ndarray):
        self.gone = again[runs.place] | (runs.doc > runs.first[runs.place])
        ask = np.flatnonzero(compare[runs.place] & ~self.gone)
        got = []
        for i, sizes in chunk.bounds():
            own = ask[np.searchsorted(runs.stretch[ask], i) : np.searchsorted(runs.stretch[ask], i, side="right")]
            if len(own):
                at, n = runs.at[own].astype(np.int64), runs.n[own].astype(np.int64)
                pos = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                rep = np.repeat(own, n)
                got.append((runs.stretch[rep], pos.astype(np.int32), runs.own[rep], chunk.names(i, sizes, False).window_names(pos), runs.doc[rep]))
        kinds = (np.int32, np.int32, _U, _U, np.int64)
        self.stretch, self.at, bucket, name, self.doc = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.empty(0, k) for k in kinds)
        self.bucket, self.name, self.first, self.place = _distinct(bucket, name, self.doc)


def repeated(docs: DataFrame, length: int = 50, whole: bool = False, chunk_bytes: int = 4 << 20, stretch: int = 1 << 18, part_bytes: int = 4 << 20) -> DataFrame:
    """Per document: doc_id, n_bytes, spans (array of start, end of removed bytes), kept_sha256, kept.

    With ``whole``, ``kept`` is the remaining text (null for null; bytes of a character that was cut are left
    out of it) and ``rest`` a struct of the document's other columns; else ``kept`` is null.
    """
    if not Q + 1 <= length <= 96 - MAX_RUN or length < 32:
        raise ValueError("length must be 32 to 69 bytes")
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, parts, draws = max(1, -(-total // chunk_bytes)), max(1, -(-total // part_bytes)), length - Q + 1
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")]
    cols = docs.select(*cols, F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("rest")) if whole else docs.select(*cols)
    # A repeated doc_id is no hot key: the text takes part in the deal.
    cols = cols.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")).repartition(chunks, "chunk")

    def send(table: pa.Table, x) -> pa.Table:
        """One message per part with entries (bucket, name, first)."""
        c, cuts = table.column("chunk")[0].as_py(), _split(x.bucket, parts, draws)
        rows = [_message(p, c, x.bucket[a:z], x.name[a:z], x.first[a:z]) for p, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if z > a]
        return _rows(rows, ["part", "chunk", "body"])

    def send_runs(table: pa.Table) -> pa.Table:
        return send(table, Chunk(table, length, stretch).walk())

    def settle(chunk: Chunk, messages: pa.Table) -> tuple[Runs, Pending]:
        runs = chunk.walk()
        return runs, Pending(chunk, runs, *_answers(messages, 1, _split(runs.bucket, parts, draws), 2))

    def send_windows(table: pa.Table, messages: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows([], ["part", "chunk", "body"])
        return send(table, settle(Chunk(table, length, stretch), messages)[1])

    def finish(table: pa.Table, messages: pa.Table) -> pa.Table:
        out = {"doc_id": [], "n_bytes": [], "spans": [], "kept_sha256": [], "kept": []}
        rest = None
        if table.num_rows:
            chunk = Chunk(table, length, stretch)
            empty = table.column("text").is_null().combine_chunks().take(pa.array(chunk.order)).to_pylist()
            runs, late = settle(chunk, messages)
            (again,) = _answers(messages, 2, _split(late.bucket, parts, draws), 1)
            gone = again[late.place] | (late.doc > late.first[late.place])
            where = np.concatenate([runs.stretch[late.gone], late.stretch[gone]])
            start = np.concatenate([runs.at[late.gone], late.at[gone]]).astype(np.int64)
            end = start + np.concatenate([runs.n[late.gone].astype(np.int64), np.ones(int(gone.sum()), np.int64)]) - 1 + length
            order = np.lexsort((start, where))
            where, start, end = where[order], start[order], end[order]
            del runs, late, order
            for i, sizes in chunk.bounds():
                own = slice(*np.searchsorted(where, [i, i + 1]))
                a, z = start[own], end[own]
                begin = np.cumsum(sizes) - sizes
                lo, hi = np.searchsorted(a, begin), np.searchsorted(a, begin + sizes)
                for j in range(len(sizes)):
                    cut = _merge(a[lo[j] : hi[j]] - begin[j], z[lo[j] : hi[j]] - begin[j])
                    text, kept, at = chunk.text[i + j], [], 0
                    for x, y in cut:
                        kept.append(text[at:x])
                        at = y
                    kept.append(text[at:])
                    body = b"".join(kept)
                    out["doc_id"].append(None if chunk.null[i + j] else int(chunk.doc[i + j]))
                    out["n_bytes"].append(len(text))
                    out["spans"].append([{"start": x, "end": y} for x, y in cut])
                    out["kept_sha256"].append(hashlib.sha256(body).hexdigest())
                    out["kept"].append(body.decode("utf-8", "ignore") if whole and not empty[i + j] else None)
            if whole:
                rest = table.column("rest").combine_chunks().take(pa.array(chunk.order))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string(), pa.string()]
        made = pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})
        return made.append_column("rest", rest if rest is not None else table.column("rest")) if whole else made

    by_chunk = cols.groupBy("chunk")
    runs = by_chunk.applyInArrow(send_runs, "part int, chunk int, body binary")
    reply = "part int, chunk int, kind int, body binary"
    # One query: the exchanges of the documents and of the first answers are planned once and read again.
    first = runs.groupBy("part").applyInArrow(lambda t: _refine(t, True), reply).repartition(chunks, "chunk")
    windows = by_chunk.cogroup(first.groupBy("chunk")).applyInArrow(send_windows, "part int, chunk int, body binary")
    second = windows.groupBy("part").applyInArrow(lambda t: _refine(t, False), reply)
    answers = first.unionByName(second).repartition(chunks, "chunk")
    result = StructType.fromDDL("doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept_sha256 string, kept string")
    if whole:
        result = result.add(cols.schema["rest"])
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(finish, result)


def _merge(a: np.ndarray, z: np.ndarray) -> list[tuple[int, int]]:
    """Sorted intervals, those that touch or overlap as one."""
    if not len(a):
        return []
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > np.maximum.accumulate(z)[:-1]
    g = np.flatnonzero(new)
    return list(zip(a[g].tolist(), np.maximum.reduceat(z, g).tolist(), strict=True))


def digest(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per document."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return repeated(docs, length).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def strip(docs: DataFrame, length: int = 50) -> DataFrame:
    """``docs`` with the repeated bytes out of ``text``; ``n_chars``, where there, follows a text that was cut.

    The other columns travel with the text, so nothing is joined afterwards.
    """
    cut = repeated(docs, length, whole=True)
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        old = F.col("rest")["n_chars"]
        new["n_chars"] = F.when(F.size("spans") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(old)
    return cut.select(*[new.get(c, F.col("rest")[c]).alias(c) for c in docs.columns])
