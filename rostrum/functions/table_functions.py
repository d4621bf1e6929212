"""Table functions for SQL. ``register(spark)`` makes them known to a session.

``parse_cues(TABLE(lines))``: cues of WebVTT files given line by line, as ``spark.read.text`` reads them: columns key, n (the line's number)
and line.  The function asks for its input in partitions of key, ordered by n, and holds one cue at a time.

Edge cases: lines before the first time stamp, notes and cue names give nothing; a cue without text has an empty one; null lines count as blank;
other columns are not read; an input without the three columns, or with a line that is no string, is refused when the query is analysed.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

_STAMP = r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{3})"
_TIMES = re.compile(rf"\s*{_STAMP}\s*-->\s*{_STAMP}")


def _seconds(h: str | None, m: str, s: str, ms: str) -> float:
    return int(h or 0) * 3600 + int(m) * 60 + int(s) + int(ms) / 1000


@udtf
class ParseCues:
    """key, pos (from 0), start, end (seconds), text (its lines joined by a space)."""

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        kinds = {f.name: f.dataType for f in lines.dataType.fields} if lines.isTable else {}
        if not {"key", "n", "line"} <= set(kinds) or not isinstance(kinds["line"], StringType):
            raise ValueError("parse_cues takes a table with the columns key, n and line, the last one a string")
        schema = StructType().add("key", kinds["key"]).add("pos", IntegerType()).add("start", DoubleType()).add("end", DoubleType()).add("text", StringType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("key")], orderBy=[OrderingColumn("n")])

    def __init__(self):
        self.key, self.pos, self.times, self.text = None, 0, None, []

    def _done(self):
        if self.times:
            row = (self.key, self.pos, *self.times, " ".join(self.text))
            self.pos, self.times, self.text = self.pos + 1, None, []
            return row
        return None

    def eval(self, row):
        self.key = row["key"]
        line = (row["line"] or "").strip()
        found = _TIMES.match(line)
        if (found or not line) and (cue := self._done()):
            yield cue
        if found:
            g = found.groups()
            self.times = (_seconds(*g[:4]), _seconds(*g[4:]))
        elif self.times and line:
            self.text.append(line)

    def terminate(self):
        if cue := self._done():
            yield cue


def register(spark: SparkSession) -> None:
    spark.udtf.register("parse_cues", ParseCues)
