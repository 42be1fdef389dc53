"""Expressions over numbers, years and mileages read from text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MILE = 1.60934
_MONTH_DAY = "(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])"
RANGE_MARK = "(?:-|to|through|thru|until)"


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def digits_only(c: Column) -> Column:
    """All digits of a text as one number; null if there is none."""
    return F.expr("null") if c is None else F.nullif(F.regexp_replace(c, r"[^0-9]", ""), F.lit("")).try_cast("bigint")


def to_int(c: Column) -> Column:
    """Robust integer: text with blanks, separators or decimals; null where nothing is left."""
    return F.regexp_replace(F.trim(c.cast("string")), ",", "").try_cast("double").cast("int")


def years(c: Column, lo: int, hi: int) -> Column:
    """Distinct years of a text within [lo, hi], sorted."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"), F.lit(1)), lambda y: y.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda y: (y >= lo) & (y <= hi))))


def first_year(c: Column, lo: int = 1996, hi: int = 2026) -> Column:
    """The first year of a text within [lo, hi]; eight digits are read as YYYYMMDD if month and day can be."""
    found = F.transform(F.regexp_extract_all(c, F.lit(rf"(?<![0-9])((?:19|20)[0-9]{{2}})(?:(?![0-9])|(?={_MONTH_DAY}(?![0-9])))"), F.lit(1)), lambda y: y.cast("int"))
    return F.try_element_at(F.filter(found, lambda y: (y >= lo) & (y <= hi)), F.lit(1))


def phrase_window(c: Column, lo: int = 1990, hi: int = 2030) -> Column:
    """struct(lo, hi): pre- opens the left side, post- and since the right; else least and greatest year; null without a year."""
    ys = years(c, 1900, 2099)
    low, high = F.array_min(ys), F.array_max(ys)
    t = F.lower(c)
    return F.when(F.size(ys) > 0, F.struct(F.when(t.rlike(r"\b(pre|before|until|up to)\b"), lo).otherwise(low).alias("lo"), F.when(t.rlike(r"\b(post|after|since|from|onwards?)\b|\+"), hi).otherwise(high).alias("hi")))


def km(number: Column, unit: Column) -> Column:
    """Kilometres of a number as written (200k, 200.000, 124,000) in km or miles, rounded half to even."""
    t = F.lower(number)
    thousand = t.endswith("k")
    value = F.regexp_replace(t, r"[^0-9]", "").try_cast("double") * F.when(thousand, 1000).otherwise(1)
    return F.bround(value * F.when(F.lower(unit).rlike(r"^mi"), MILE).otherwise(1.0)).cast("bigint")


def mileage_km(c: Column) -> Column:
    """struct(km, confidence) of the first form found, in this order: a range of thousands gives its low bound (range),
    `120k` and `125 bin` with or without a unit are medium, a full figure with its unit or after `kilometre` or `mileage` high."""
    t = F.lower(c)
    number = lambda p: F.regexp_replace(_first(t, p), r"[^0-9]", "").try_cast("bigint")
    unit, figure = r"(?:km|kilomet[a-zıçğöşü]*)", r"([0-9]{1,3}(?:[.,][0-9]{3})+|[0-9]{4,})"
    forms = [
        (number(rf"\b([0-9]{{1,3}})\s*[-–]\s*[0-9]{{1,3}}\s*(?:k|bin)\s*{unit}?\b") * 1000, "range"),
        (number(rf"\b({figure[1:-1]})\s*[-–]\s*(?:{figure[1:-1]})\s*{unit}\b"), "range"),
        (number(rf"\b([0-9]{{1,3}})\s*(?:k|bin)\s*{unit}?\b") * 1000, "medium"),
        (number(rf"\b{figure}\s*{unit}\b"), "high"),
        (number(rf"\bkilometre(?:de|si|yi|ye)?\s*[:=]?\s*{figure}\b"), "high"),
        (number(rf"\bmileage\s*[:=]?\s*{figure}\b"), "high"),
    ]
    return F.coalesce(*[F.when(n.isNotNull(), F.struct(n.alias("km"), F.lit(label).alias("confidence"))) for n, label in forms])


def mileage_miles(c: Column) -> Column:
    """Miles: `85k miles`, `85,000 miles`, `85000 on the clock`, `mileage: 85000`, else kilometres / 1.609."""
    t = F.lower(c)
    number = lambda p: F.regexp_replace(_first(t, p), r"[^0-9]", "").try_cast("bigint")
    return F.coalesce(
        number(r"([0-9]{2,3})\s*k\s*miles") * 1000,
        number(r"([0-9]{1,3},[0-9]{3}|[0-9]{4,6})\s*miles"),
        number(r"([0-9]{1,3},[0-9]{3}|[0-9]{4,6})\s*on the clock"),
        number(r"mileage:?\s*([0-9]{1,3},[0-9]{3}|[0-9]{4,6})"),
        F.bround(number(r"([0-9]{1,3}[.,][0-9]{3}|[0-9]{4,6})\s*km") / 1.609).cast("bigint"),
    )


def listing_basics(c: Column) -> Column:
    """struct(year, km, power): labelled year else the least one, kilometres, horse power."""
    year = F.coalesce(_first(F.lower(c), r"(?:year|yıl|model)\s*:?\s*((?:19|20)[0-9]{2})").cast("int"), F.array_min(years(c, 1900, 2099)))
    return F.struct(year.alias("year"), mileage_km(c)["km"].alias("km"), _first(F.lower(c), r"([0-9]{2,3})\s*(?:hp|ps|bhp|bg)\b").cast("int").alias("power"))


def bucket(c: Column, edges: Sequence[float], labels: Sequence[str], missing: str = "unknown") -> Column:
    """labels[i] for values below edges[i] (and not below an earlier one); the last label from the last edge on."""
    out = F.when(c.isNull(), missing)
    for edge, label in zip(edges, labels):
        out = out.when(c < edge, label)
    return out.otherwise(labels[len(edges)])


def mileage_band(c: Column, width: int = 30_000, bands: int = 8) -> Column:
    """Bands of equal width, the last one open."""
    return bucket(c, [width * (i + 1) for i in range(bands - 1)], [f"{width * i // 1000}-{width * (i + 1) // 1000}k" for i in range(bands - 1)] + [f"{width * (bands - 1) // 1000}k+"])


def steps(c: Column, edges: Sequence[float]) -> Column:
    """Number of edges that the value reaches: 0, 1, ... len(edges); a null counts as 0."""
    return F.coalesce(sum(((c >= e).cast("int") for e in edges), F.lit(0)), F.lit(0))


def spec_of(cc: Column, fuel: Column, table: Mapping[tuple[int, str], str], otherwise: str = "unknown") -> Column:
    """Engine specification of a displacement and a fuel, from a fixed table."""
    lookup = F.create_map(*[F.lit(x) for (c, f), s in table.items() for x in (f"{c}|{f}", s)]) if table else F.create_map().cast("map<string,string>")
    return F.coalesce(F.element_at(lookup, F.concat(cc.cast("string"), F.lit("|"), F.lower(fuel))), F.lit(otherwise))


def centred(c: Column, centre: float) -> Column:
    return c - F.lit(centre)


def log_clipped(c: Column) -> Column:
    return F.log1p(F.greatest(c, F.lit(0)))


def ranked(c: Column, order: Sequence[str]) -> Column:
    """Position of an ordered category (0, 1, ...); null for others."""
    out = F
    for i, name in enumerate(order):
        out = out.when(F.lower(c) == name, i)
    return out.otherwise(F.lit(None).cast("int"))
