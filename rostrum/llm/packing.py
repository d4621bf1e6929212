"""Best-fit packing of tokenised documents into fixed-length sequences: sum of squares.

``pack_documents`` tokenises whole texts (``tokenizing``), appends the end id, cuts documents longer
than a sequence into full pieces and a remainder, and places each remainder where the sum, over all
residual gaps, of the squared number of open sequences with that gap becomes smallest (ties: the
smallest gap left).  Pieces are dealt by hash to shards of about ``shard_items`` documents, each
packed on its own, longest first: a task's work and memory do not grow with the input, and a shard
wastes a few sequences of tens of thousands.

Edge cases: a null or empty text is the end id alone; an empty table gives no rows; repeated rows
and repeated or null ids are packed like any other row; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenizing


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, none above ``capacity``; sequences count from 0."""
    order = np.argsort(-lengths, kind="stable")
    seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    n = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    made, big = 0, np.iinfo(np.int64).max // 4
    for i in order:
        s = int(lengths[i])
        # Change of the sum of squares, halved, if a sequence with gap s + k is taken (k is left).
        change = np.where(n[s:] > 0, n[: capacity + 1 - s] - n[s:] + 1, big)
        change[0] = -n[s] if n[s] else big  # a gap of zero is not open any more
        k = int(change.argmin())
        if change[k] <= n[capacity - s] and change[k] < big:
            gap = s + k
            b = open_by_gap[gap].pop()
            n[gap] -= 1
        else:
            gap, b, made = capacity, made, made + 1
        seq[i], off[i] = b, capacity - gap
        left = gap - s
        if left:
            n[left] += 1
            open_by_gap[left].append(b)
    return seq, off


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (unsigned, of little-endian uint32 ids)."""

    def run(batches):
        path = tokenizing.tokenizer_path(tokenizer)
        spaced = tokenizer.startswith("byte")
        for batch in batches:
            for part in tokenizing.slices(batch, "text"):
                ids, n = tokenizing.store(path, spaced).encode(part.column("text"))
                ends = np.cumsum(n)
                rows: list[list] = [[], [], [], [], []]
                for doc, e, k in zip(part.column("doc_id").to_pylist(), ends.tolist(), n.tolist(), strict=True):
                    own = np.append(ids[e - k : e], np.uint32(end_id)).astype("<u4", copy=False)
                    for j, at in enumerate(range(0, len(own), capacity)):
                        piece = own[at : at + capacity]
                        for col, v in zip(rows, (doc, j, at, len(piece), zlib.crc32(piece.tobytes())), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:])],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def pack_pieces(pieces: DataFrame, capacity: int, shards: int) -> DataFrame:
    """Add sequence_id and offset; sequence ids are unique over all shards."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32")])
        seq, off = sum_of_squares(table.column("length").to_numpy(), capacity)
        seq = seq + (np.int64(table.column("shard")[0].as_py()) << 32)
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "length"), F.lit(shards)).cast("int")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return pieces.withColumn("shard", shard).groupBy("shard").applyInArrow(run, schema)


def pack_documents(
    docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 4096, end_id: int = 1, shard_items: int = 40_000
) -> DataFrame:
    """Pack all ``docs``; the number of shards follows their count (from the files' footers)."""
    shards = max(1, -(-docs.count() // shard_items))
    return pack_pieces(token_pieces(docs, tokenizer, capacity, end_id), capacity, shards)
