"""Interval-set algebra over array<struct<lo int, hi int>>, both bounds included; neighbours merge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<lo:int,hi:int>>"


def span(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def union(c: Column) -> Column:
    """Spans that overlap or follow on the next integer are one; sorted."""
    empty = F.array().cast(SPANS)

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        merged = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(span(last["lo"], F.greatest(last["hi"], s["hi"]))))
        return F.when(F.size(done) == 0, F.array(s)).when(s["lo"] <= last["hi"] + 1, merged).otherwise(F.concat(done, F.array(s))).cast(SPANS)

    return F.aggregate(F.array_sort(c), empty, step)


def intersect(a: Column, b: Column) -> Column:
    pairs = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: span(F.greatest(x["lo"], y["lo"]), F.least(x["hi"], y["hi"])))))
    return union(F.filter(pairs, lambda s: s["lo"] <= s["hi"]))


def clamp(c: Column, lo: Column, hi: Column) -> Column:
    return F.filter(F.transform(c, lambda s: span(F.greatest(s["lo"], lo), F.least(s["hi"], hi))), lambda s: s["lo"] <= s["hi"])


def covers(a: Column, year: Column) -> Column:
    return F.exists(a, lambda s: (s["lo"] <= year) & (year <= s["hi"]))


def label(c: Column) -> Column:
    """least-greatest, or the one year; null for no span."""
    lo, hi = F.array_min(F.transform(c, lambda s: s["lo"])), F.array_max(F.transform(c, lambda s: s["hi"]))
    return F.when(lo == hi, lo.cast("string")).otherwise(F.concat_ws("-", lo.cast("string"), hi.cast("string"))) if c is not None else None
