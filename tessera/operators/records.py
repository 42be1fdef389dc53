"""Source records to flat rows, and issue records to one normal form: defaults, coercions, unknown keys kept apart."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.nested import cleaned, missing_text
from tessera.functions.numbers import to_int


def known(c: Column) -> Column:
    """A text, or null where it is blank or null written as text."""
    return F.when(~missing_text(c), F.trim(c))


def joined_sections(*columns: Column, separator: str = " ") -> Column:
    """Non-blank sections joined; null if all are blank."""
    return F.nullif(F.concat_ws(separator, *[F.nullif(F.trim(c), F.lit("")) for c in columns]), F.lit(""))


def flat_record(record: Column, fields: Mapping[str, tuple[Sequence[str], str]], limits: Mapping[str, int] = {}) -> list[Column]:  # noqa: B006
    """Columns out of a JSON object: field -> (names to try in order, type); lists become `a; b`, texts are cut to a limit."""
    out = []
    for name, (paths, kind) in fields.items():
        values = []
        for p in paths:
            text = F.get_json_object(record, f"$.{p}")
            listed = F.array_join(F.from_json(text, "array<string>"), "; ")
            values.append(F.nullif(F.trim(F.when(text.startswith("["), F.coalesce(listed, text)).otherwise(text)), F.lit("")))
        c = F.coalesce(*values)
        if name in limits:
            c = F.substring(c, 1, limits[name])
        out.append((to_int(c) if kind == "int" else c.try_cast(kind)).alias(name))
    return out


def normal_issues(df: DataFrame, id: str, texts: Sequence[str], enums: Mapping[str, Sequence[str]], lists: Sequence[str], ints: Sequence[str]) -> DataFrame:
    """One normal form of issue records: blanks null, enumerations in small letters with `unknown` for others, lists cleaned,
    counts as integers (0 for none), and every other column gathered as text in the map `extra_fields`."""
    used = {id, *texts, *enums, *lists, *ints}
    extra = [c for c in df.columns if c not in used]
    enum = lambda c, values: F.when(F.lower(F.trim(c)).isin(*values), F.lower(F.trim(c))).otherwise("unknown")
    entries = F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in extra]) if extra else F.array().cast("array<struct<key:string,value:string>>")
    return df.select(
        F.coalesce(known(F.col(id)), F.lit("unknown")).alias(id),
        *[known(F.col(c)).alias(c) for c in texts],
        *[enum(F.col(c), v).alias(c) for c, v in enums.items()],
        *[cleaned(F.col(c)).alias(c) for c in lists],
        *[F.coalesce(to_int(F.col(c)), F.lit(0)).alias(c) for c in ints],
        F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("extra_fields"),
    )


def year_context(rows: DataFrame, key: Sequence[str], spans: Column, hits: str, lo: int = 1990, hi: int = 2030) -> DataFrame:
    """(key..., year_lo, year_hi, years, hits): all years of a key's spans together, clipped, and its evidence added up; a key without a year left has none, but its evidence."""
    years = rows.select(*key, F.explode_outer(F.flatten(F.transform(spans, lambda s: F.sequence(s["lo"], s["hi"])))).alias("y")).where(F.col("y").between(lo, hi) | F.col("y").isNull())
    per = years.groupBy(*key).agg(F.min("y").alias("year_lo"), F.max("y").alias("year_hi"), F.count_distinct("y").alias("years"))
    out = rows.groupBy(*key).agg(F.sum(hits).alias("hits")).join(per, list(key), "left")
    return out.select(*key, "year_lo", "year_hi", F.coalesce("years", F.lit(0)).alias("years"), "hits")


def with_window(df: DataFrame, id: str, engines: str, reference: DataFrame, code: str, lo: str, hi: str) -> DataFrame:
    """(id, window_lo, window_hi): the production window of the engines an issue names, over those that the reference knows."""
    named = df.select(id, F.explode(engines).alias(code)).join(reference.select(code, lo, hi), code)
    return named.groupBy(id).agg(F.min(lo).alias("window_lo"), F.max(hi).alias("window_hi"))


def engines_in_window(df: DataFrame, id: str, engines: str, year_lo: str, year_hi: str, reference: DataFrame, code: str, lo: str, hi: str) -> DataFrame:
    """(id, engines, dropped): engines whose production window misses the issue's years are dropped, unless all would be."""
    named = df.select(id, year_lo, year_hi, F.explode(engines).alias(code)).join(reference.select(code, lo, hi), code, "left")
    fits = F.col(lo).isNull() | F.col(year_lo).isNull() | ((F.col(lo) <= F.col(year_hi)) & (F.col(year_lo) <= F.col(hi)))
    return _fitting(named, id, engines, code, fits)


def engines_in_spans(df: DataFrame, id: str, engines: str, spans: str, reference: DataFrame, code: str, lo: str, hi: str) -> DataFrame:
    """(id, engines, dropped): as engines_in_window, against all spans of the issue: one that the window meets is enough; an issue without spans drops none."""
    named = df.select(id, spans, F.explode(engines).alias(code)).join(reference.select(code, lo, hi), code, "left")
    meets = F.exists(spans, lambda s: (F.col(lo) <= s["hi"]) & (s["lo"] <= F.col(hi)))
    return _fitting(named, id, engines, code, F.col(lo).isNull() | (F.size(spans) == 0) | meets)


def _fitting(named: DataFrame, id: str, engines: str, code: str, fits: Column) -> DataFrame:
    g = named.groupBy(id).agg(F.array_sort(F.collect_set(F.when(fits, F.col(code)))).alias("__fit"), F.array_sort(F.collect_set(code)).alias("__all"))
    return g.select(id, F.when(F.size("__fit") > 0, F.col("__fit")).otherwise(F.col("__all")).alias(engines), F.when(F.size("__fit") > 0, F.array_except("__all", "__fit")).otherwise(F.array().cast("array<string>")).alias("dropped"))
