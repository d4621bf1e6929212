"""JSON out of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract(raw: Column, schema: str) -> Column:
    """The object in a fenced block, else from the first { to the last }; null for truncated or broken JSON."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    body = F.when(fenced != "", fenced).otherwise(bare)
    clean = F.regexp_replace(body, r",\s*([}\]])", "$1")  # trailing commas
    return F.when(F.try_parse_json(clean).isNotNull() & (clean != ""), F.from_json(clean, schema))


def coerce_tag(raw: Column) -> Column:
    """struct(tag, reason) from a JSON string, an object or null."""
    v = F.try_parse_json(raw)
    text = F.try_variant_get(v, "$", "string")
    obj = F.try_variant_get(v, "$.tag", "string")
    reason = F.try_variant_get(v, "$.reason", "string")
    is_obj = raw.startswith("{")
    return F.struct(F.when(is_obj, obj).when(raw != "null", text).alias("tag"), F.when(is_obj, reason).alias("reason"))
