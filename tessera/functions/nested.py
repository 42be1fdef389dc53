"""Expressions over JSON, maps, arrays and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_array(c: Column, schema: str) -> Column:
    """A JSON array out of a model's answer: code fences stripped, else the outermost [...]; null if unreadable."""
    t = F.regexp_replace(c, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    return F.coalesce(F.from_json(t, schema), F.from_json(F.regexp_extract(t, r"(?s)(\[.*\])", 1), schema))


def json_object(c: Column, schema: str) -> Column:
    """A JSON object out of a model's answer, as json_array."""
    t = F.regexp_replace(c, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    inner = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.from_json(F.when(inner != "", inner), schema)


def flat_json(df: DataFrame) -> DataFrame:
    """Every array, map and struct column as JSON text, for sinks that hold only scalars."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields])


def vector_text(c: Column, digits: int = 6) -> Column:
    """[0.100000, 0.250000]"""
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.format_string(f"%.{digits}f", x.cast("double"))), ", "), F.lit("]"))


def merge_first(*maps: Column) -> Column:
    """Union of maps in which the first map that has a key wins."""
    entries = F.flatten(F.array(*[F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))) for m in maps]))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == k), 1)["value"].alias("value"))))


def cleaned(c: Column) -> Column:
    """Array of texts trimmed, without null, blank and repeated entries."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def missing_text(c: Column) -> Column:
    """A text that is null, blank, or null written as text."""
    return c.isNull() | F.lower(F.trim(c)).isin("", "null", "none", "nan", "n/a", "na", "unknown", "-")
