"""Sources: captions, transcripts, playlists, event logs, configuration and paged services."""

from __future__ import annotations

import json
import tomllib

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# Captions

CUE = r"(?:(\d+):)?(\d{2}):(\d{2})\.(\d{3})\s+-->\s+(?:(\d+):)?(\d{2}):(\d{2})\.(\d{3})"


def _seconds(s: Column, first: int) -> Column:
    g = [F.coalesce(F.regexp_extract(s, CUE, first + i).try_cast("double"), F.lit(0.0)) for i in range(4)]
    return g[0] * 3600 + g[1] * 60 + g[2] + g[3] / 1000


def vtt_cues(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per cue of WebVTT texts: pos, start, end (seconds), text (lines joined by a space)."""
    blocks = F.filter(F.split(F.regexp_replace(text, "\r\n?", "\n"), r"\n[ \t]*\n+"), lambda b: b.rlike(CUE))
    c = df.select(*keep, F.posexplode(blocks).alias("pos", "b"))
    body = F.array_join(F.filter(F.transform(F.split(F.regexp_replace("b", r"(?s)^.*?-->[^\n]*\n?", ""), "\n"), lambda x: F.trim(x)), lambda x: x != ""), " ")
    return c.select(*keep, "pos", _seconds(F.col("b"), 1).alias("start"), _seconds(F.col("b"), 5).alias("end"), body.alias("text"))


# Playlists


def playlist_uris(text: Column) -> Column:
    """Lines of a playlist that are no tags or blank."""
    return F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))


def first_variant(text: Column) -> Column:
    return F.try_element_at(playlist_uris(text), F.lit(1))


def subtitle_uri(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r'#EXT-X-MEDIA:[^\n]*TYPE=SUBTITLES[^\n]*URI="([^"]+)"', 1), F.lit(""))


# Event logs


EVENT_LOG = "startedAt string, events array<struct<eventType: string, eventStart: string, objectId: string>>"


def event_log(df: DataFrame, raw: str, *keep: str) -> DataFrame:
    """kind, object_id, seconds since the log began; incomplete entries are left out."""
    j = df.select(*keep, F.from_json(raw, EVENT_LOG).alias("j")).select(*keep, "j.startedAt", F.explode("j.events").alias("e"))
    t = lambda c: F.unix_micros(F.try_to_timestamp(F.col(c))) / 1e6
    out = j.select(*keep, F.col("e.eventType").alias("kind"), F.col("e.objectId").alias("object_id"), (t("e.eventStart") - t("startedAt")).alias("seconds"))
    return out.where("kind IS NOT NULL AND object_id IS NOT NULL AND seconds IS NOT NULL")


# Transcripts


def transcript_turns(spark: SparkSession, paths: list[str], row_tag: str = "activity") -> DataFrame:
    """file, activity, title, pos, speaker, kind, text: every turn with speaker and text, nested in activities."""
    schema = "_id string, title string, turn array<struct<_kind: string, speaker: string, text: string>>"
    x = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", True).schema(schema).load(paths)
    t = x.select(F.input_file_name().alias("file"), F.col("_id").alias("activity"), "title", F.posexplode("turn").alias("pos", "t"))
    return t.select("file", "activity", "title", "pos", "t.speaker", F.col("t._kind").alias("kind"), "t.text").where("speaker IS NOT NULL AND text IS NOT NULL")


def with_sidecar(turns: DataFrame, sidecars: DataFrame, key: Column, name: str) -> DataFrame:
    """Turns of the files that have a row of metadata; ``key`` gets a file's name ``name`` from its path."""
    return turns.withColumn(name, key).join(sidecars, name)


def topic_turns(turns: DataFrame, *keywords: str) -> DataFrame:
    """Title has a keyword: all turns of the activity; else only turns whose text has one."""
    has = lambda c: F.greatest(F.lit(False), *[F.contains(F.lower(c), F.lit(k.lower())) for k in keywords])
    return turns.where(has("title") | has("text"))


# Configuration and records


def toml_tables(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """An array of tables of a small TOML file, in any store Spark reads, as rows; unknown fields are an error."""
    rows = tomllib.loads(spark.read.text(path, wholetext=True).first().value)[key]
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    if extra := {k for r in rows for k in r} - set(names):
        raise ValueError(f"unknown fields {sorted(extra)}")
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def csv_table(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank ones are skipped."""
    return spark.read.schema(schema).json(path)


# Answers of services, recorded as text


def bindings(df: DataFrame, raw: str, fields: list[str], *keep: str) -> DataFrame:
    """The rows of a SPARQL answer in JSON; a field that a row does not bind is null."""
    row = ", ".join(f"{f}: struct<value: string>" for f in fields)
    j = F.from_json(raw, f"results struct<bindings: array<struct<{row}>>>")
    b = df.select(*keep, F.explode(j["results"]["bindings"]).alias("b"))
    return b.select(*keep, *[F.col(f"b.{f}.value").alias(f) for f in fields])


def entity_id(uri: Column) -> Column:
    """The last part of an entity's address."""
    return F.element_at(F.split(uri, "/"), -1)


def agenda(days: DataFrame, raw: str, date: str) -> DataFrame:
    """date, id, start, end of every debate of the recorded days; real times go before planned ones."""
    debate = "id: string, startedAt: string, endedAt: string, startsAt: string, endsAt: string"
    d = days.select(date, F.inline(F.from_json(raw, f"debates array<struct<{debate}>>")["debates"]))
    return d.select(date, "id", F.coalesce("startedAt", "startsAt").alias("start"), F.coalesce("endedAt", "endsAt").alias("end"))


# Paged services


def page_url(entity: str, select: list[str] = (), where: str = "", expand: str = "", order: str = "", top: int = 250, skip: int = 0, limit: int = 250) -> str:
    """Query of one page; the service caps pages at ``limit``."""
    from urllib.parse import quote

    parts = {"$filter": where, "$select": ",".join(select), "$expand": expand, "$orderby": order, "$top": str(min(top, limit)), "$skip": str(skip) if skip else ""}
    return entity + "?" + "&".join(f"{k}={quote(v, safe='/,')}" for k, v in parts.items() if v)


class PagedSource(DataSource):
    """``spark.read.format("paged")``: one partition per page of a service.

    Options: ``pages`` (number), ``path`` (folder of page-N.json files, or of folders page=N of such files,
    that stand for the service, in a store that workers reach; a client for a live one overrides ``fetch``).
    Rows are JSON objects in the array ``value``.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, record string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PagedReader(dict(self.options))


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(int(self.options.get("pages", 1)))]

    def fetch(self, page: int) -> list:
        store, root = fs.FileSystem.from_uri(self.options["path"])
        found = store.get_file_info([f"{root}/page-{page}.json"])
        found += store.get_file_info(fs.FileSelector(f"{root}/page={page}", allow_not_found=True))
        rows = []
        for f in found:
            if f.is_file and not f.base_name.startswith((".", "_")):
                with store.open_input_stream(f.path) as stream:
                    rows += json.loads(stream.read()).get("value", [])
        return rows

    def read(self, partition: InputPartition):
        for record in self.fetch(partition.value):
            yield partition.value, json.dumps(record, sort_keys=True)
