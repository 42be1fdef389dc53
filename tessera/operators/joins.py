"""Joins beyond the plain ones: zero-filled, first-match, banded, ranged, exact-then-fallback, evidence resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zero_filled(left: DataFrame, counts: DataFrame, key: str, *columns: str) -> DataFrame:
    """left with counts attached, 0 where there are none."""
    return left.join(counts, key, "left").fillna(0, subset=list(columns))


def processed_removed(df: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    """Rows whose key has not been processed yet."""
    return df.join(done.select(*key), list(key), "left_anti")


def on_first(df: DataFrame, dimension: DataFrame, key: str, *order: str) -> DataFrame:
    """Inner join on a dimension of which each key counts once (the first by order), so that nothing fans out."""
    first = dimension.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")
    return df.join(first, key)


def star(base: DataFrame, key: str, *others: DataFrame, fill: object = 0) -> DataFrame:
    """Chained left joins on one key with null-fill; all sides are partitioned by the key once."""
    for o in others:
        base = base.join(o, key, "left")
    return base.fillna(fill)


def band(left: DataFrame, right: DataFrame, a: str, b: str, width: int) -> DataFrame:
    """Pairs with |a - b| <= width, as an equi-join on buckets of that width: each right row stands in three buckets.

    No nested loop: a row meets only the rows of its bucket and the two beside it.
    """
    size = max(1, width)
    l = left.withColumn("__b", F.floor(F.col(a) / size))
    r = right.withColumn("__b", F.explode(F.array(*[F.floor(F.col(b) / size) + k for k in (-1, 0, 1)])))
    return l.join(r, "__b").where(F.abs(F.col(a) - F.col(b)) <= width).drop("__b")


def in_range(left: DataFrame, right: DataFrame, value: str, lo: str, hi: str, width: int, *equal: str) -> DataFrame:
    """Pairs with lo <= value < hi: ranges are exploded over buckets of `width`, values fall into one; an equi-join again."""
    l = left.withColumn("__b", F.floor(F.col(value) / width))
    r = right.where(F.col(lo) < F.col(hi)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))))
    return l.join(r, ["__b", *equal]).where((F.col(value) >= F.col(lo)) & (F.col(value) < F.col(hi))).drop("__b")


def exact_then_fallback(left: DataFrame, exact: DataFrame, exact_key: Sequence[str], rough: DataFrame, rough_key: Sequence[str], value: str) -> DataFrame:
    """left with `value` from the exact table, else from the rough one, and confidence exact / approximate / none."""
    e, r = exact.select(*exact_key, F.col(value).alias("__e")), rough.select(*rough_key, F.col(value).alias("__r"))
    out = left.join(e, list(exact_key), "left").join(r, list(rough_key), "left")
    confidence = F.when(F.col("__e").isNotNull(), "exact").when(F.col("__r").isNotNull(), "approximate").otherwise("none")
    return out.withColumn("confidence", confidence).withColumn(value, F.coalesce("__e", "__r")).drop("__e", "__r")


def first_match(df: DataFrame, id: str, text: str, lexicon: Sequence[tuple[str, str]], into: str = "code") -> DataFrame:
    """The first code in lexicon order whose pattern occurs in the text; null if none. A case chain, no join."""
    out = F
    for code, pattern in lexicon:
        out = out.when(F.col(text).rlike(pattern), code)
    return df.withColumn(into, out.otherwise(F.lit(None).cast("string")) if lexicon else F.lit(None).cast("string"))


def resolved_evidence(df: DataFrame, id: str, evidence: str, source: DataFrame, key: str, *fields: str) -> DataFrame:
    """(id, evidence: array<struct<key, fields...>> in order, distinct_<field>...): references resolved, unknown ones dropped."""
    refs = df.select(id, F.posexplode(evidence).alias("__pos", key))
    hit = refs.join(source.select(key, *fields), key)
    nested = hit.groupBy(id).agg(F.array_sort(F.collect_list(F.struct("__pos", key, *fields))).alias("__e"), *[F.count_distinct(f).alias(f"distinct_{f}") for f in fields])
    nested = nested.select(id, F.transform("__e", lambda e: F.struct(e[key].alias(key), *[e[f].alias(f) for f in fields])).alias(evidence), *[f"distinct_{f}" for f in fields])
    return df.select(id).join(nested, id, "left")


def fallback_fields(df: DataFrame, raw: DataFrame, key: str, *fields: str) -> DataFrame:
    """Own value, else the raw record's; blank counts as missing."""
    r = raw.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    return df.join(r, key, "left").withColumns({f: F.coalesce(clean(F.col(f)), clean(F.col(f"__{f}"))) for f in fields}).drop(*[f"__{f}" for f in fields])


def entity_templates(entities: DataFrame, templates: Sequence[str], entity: str, ordinal: str) -> DataFrame:
    """(ordinal, template_no, query): each template filled for each entity, the first of equal queries kept. Templates are few and literal."""
    exploded = entities.select(ordinal, entity, F.posexplode(F.array(*map(F.lit, templates))).alias("template_no", "__t"))
    filled = exploded.select(ordinal, "template_no", F.replace(F.col("__t"), F.lit("{entity}"), F.col(entity)).alias("query"))
    w = Window.partitionBy(F.lower("query")).orderBy(ordinal, "template_no")
    return filled.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def pattern_matrix(df: DataFrame, id: str, text: str, truth: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """(id, issue, hits, total): how many of each issue's patterns occur in each text. The patterns are literals, so nothing is joined."""
    from tessera.functions.text import pattern_hits

    rows = F.array(*[F.struct(F.lit(name).alias("issue"), pattern_hits(F.col(text), ps).alias("hits"), F.lit(len(ps)).alias("total")) for name, ps in truth])
    return df.select(id, F.inline(rows))


def near_spans(spans: Column, at: Column, within: int) -> Column:
    """Whether a position is within so many characters of any span (array<struct<a, z>>)."""
    return F.exists(spans, lambda s: F.greatest(s["a"] - at, at - s["z"], F.lit(0)) <= within)


def long(df: DataFrame, id: str, columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide to long."""
    return df.unpivot(id, list(columns), name, value)


def compatible(df: DataFrame, other: DataFrame, value: str, accepted: str, year: str, lo: str, hi: str) -> DataFrame:
    """Pairs in which `value` is in the other side's list and the year in its range: the lists are exploded into an equi-join."""
    o = other.withColumn("__v", F.explode(accepted))
    return df.join(o, F.col(value) == F.col("__v")).where(F.col(year).between(F.col(lo), F.col(hi))).drop("__v")
