"""Token counts of a byte-pair vocabulary that is given as a file."""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

_encodings: dict = {}


def _encoding(path: str, pattern: str):
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counter(path: str, pattern: str):
    """An Arrow UDF with the number of tokens of a text, 0 for null; each worker reads the file once.

    A worker holds Arrow's batch, one text of it as a string and that text's ids in four bytes each.
    """

    @F.arrow_udf(LongType())
    def count(text: pa.Array) -> pa.Array:
        e = _encoding(path, pattern)
        return pa.array((len(e.encode_to_numpy(t, disallowed_special=())) if (t := x.as_py()) else 0 for x in text), pa.int64())

    return count
