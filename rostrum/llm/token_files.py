"""Token-ID output: whole texts to ids, ids to files of entropy-coded blocks, and back.

``write_tokens`` tokenises every text once (``tokenizing``), stages the ids in the shared folder,
counts all of them for one frequency table (bounded by the vocabulary), orders documents by doc_id
with a range exchange of ids and writes one Parquet file of ``rans`` frames per range, next to the
table.  Frames never share a document, so readers need no neighbour.  ``read_tokens`` checks and
decodes frames in parallel.

Edge cases: a null text is empty, so its document is the end id alone; an empty table gives files
without frames and no rows; rows with one doc_id stand side by side, ordered by length and ids; a
null doc_id sorts first; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import drop_scratch, scratch, scratch_path
from . import rans, tokenizing

BLOCK_TOKENS = 1 << 20


def token_rows(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint16 where the vocabulary fits, else uint32)."""

    def run(batches):
        path, spaced = tokenizing.tokenizer_path(tokenizer), tokenizer.startswith("byte")
        for batch in batches:
            for part in tokenizing.slices(batch, "text"):
                st = tokenizing.store(path, spaced)
                ids, n = st.encode(part.column("text"))
                kind = "<u2" if st.tok.get_vocab_size() <= 1 << 16 else "<u4"
                ends = np.cumsum(n)
                all_ids = np.insert(ids, ends, end_id).astype(kind).tobytes()
                width = int(kind[-1])
                edges = np.concatenate([[0], (ends + np.arange(1, len(n) + 1)) * width]).astype(np.int64)
                blob = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(edges), pa.py_buffer(all_ids)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n + 1), blob.cast(pa.binary())], names=["doc_id", "n_tokens", "ids"]
                )

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cols.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def _ids(col: pa.Array, n: np.ndarray) -> list[np.ndarray]:
    return [np.frombuffer(b.as_buffer(), "<u2" if len(b.as_buffer()) == 2 * k else "<u4") for b, k in zip(col, n, strict=True)]


def frequency_table(tokens: DataFrame, bits: int) -> rans.Table:
    """Counts of every id in all documents: one row per id and task, summed before the driver sees them."""

    def count(batches):
        total = np.zeros(1, np.int64)
        for b in batches:
            for a in _ids(b.column("ids"), b.column("n_tokens").to_numpy()):
                c = np.bincount(a, minlength=len(total))
                c[: len(total)] += total
                total = c
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int64)), pa.array(total[i])], names=["id", "n"])

    got = tokens.select("n_tokens", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(max(got.column("id").to_pylist(), default=0) + 1, np.int64)
    counts[got.column("id").to_numpy()] = got.column("n").to_numpy()
    return rans.Table.fit(counts, bits)


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 0,
    bits: int = 20,
    block_tokens: int = BLOCK_TOKENS,
    parts: int | None = None,
) -> None:
    """Write ``path``/table and ``path``/blocks; files follow ascending doc_id by part and block."""
    spark = docs.sparkSession
    staged = scratch(token_rows(docs, tokenizer, end_id), "tokens")
    table = frequency_table(staged, bits)
    freq = table.freq.astype(np.int64).tolist()
    spark.createDataFrame([(bits, freq)], "bits int, freq array<long>").coalesce(1).write.parquet(f"{path}/table")

    def pack(batches):
        from pyspark import TaskContext

        part, block, first = TaskContext.get().partitionId(), 0, 0
        tab = rans.Table(np.array(freq, np.int64), bits)
        docs_, sizes, parts_, held = [], [], [], 0

        def flush():
            nonlocal block, first, docs_, sizes, parts_, held
            data = rans.encode(np.concatenate(parts_), np.array(docs_), np.array(sizes), first, tab)
            row = pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "first": [first], "n_tokens": [held], "frame": pa.array([data], pa.binary())}
            )
            block, first = block + 1, first + held
            docs_, sizes, parts_, held = [], [], [], 0
            return row

        for b in batches:
            n = b.column("n_tokens").to_numpy()
            for doc, k, a in zip(b.column("doc_id").to_pylist(), n.tolist(), _ids(b.column("ids"), n), strict=True):
                docs_.append(_NULL if doc is None else doc)
                sizes.append(k)
                parts_.append(a)
                held += k
                if held >= block_tokens:
                    yield flush()
        if held:
            yield flush()

    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        staged.repartitionByRange(n, "doc_id")
        .sortWithinPartitions("doc_id", "n_tokens", "ids")
        .mapInArrow(pack, "part int, block int, first long, n_tokens long, frame binary")
        .write.option("compression", "none")
        .parquet(f"{path}/blocks")
    )
    drop_scratch(staged)


_NULL = -(1 << 63)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Decode the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    bits, freq = spark.read.parquet(f"{path}/table").first()
    blocks = spark.read.schema("part int, block int, first long, n_tokens long, frame binary").parquet(f"{path}/blocks")

    def unpack(batches):
        tab = rans.Table(np.array(freq, np.int64), bits)
        for b in batches:
            for part, data in zip(b.column("part").to_pylist(), b.column("frame").to_pylist(), strict=True):
                f = rans.Frame(data, tab)
                raw = memoryview(f.decode().astype("<u4", copy=False)).cast("B")
                ends = np.cumsum(f.sizes)
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), f.sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(crc), part, np.int32)),
                        pa.array(f.docs, pa.int64(), mask=f.docs == _NULL),
                        pa.array(f.first + ends - f.sizes),
                        pa.array(f.sizes),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["part", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    # One row per part: its length, then the lengths of the parts before it.
    sums = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    rows = blocks.select("part", "frame").mapInArrow(unpack, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(before, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_digest(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """Write all documents' ids to files in the shared folder and return what a reader finds there."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)
