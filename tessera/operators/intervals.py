"""Overlapping and gapped year intervals: reading spans from free text, and the sweep line over them.

The sweep turns each span into a +1 event at its first year and a -1 event after its last, adds the events of a year
up before anything is sorted (so an entity holds at most one row a distinct year, however many spans it has), and
reads covered periods and zero-count gaps off the prefix sum of the active count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds that an open side of a span means.
OPEN_LO, OPEN_HI = 2000, 2024

_YEAR = r"(?:(?:19|20)[0-9]{2})"
_DASH = r"[-‐-―−]"


def _sub(column: Column, *rules: tuple[str, str]) -> Column:
    for pattern, replacement in rules:
        column = F.regexp_replace(column, pattern, replacement)
    return column


def year_spans(text: Column) -> Column:
    """array<struct<lo int, hi int>> of all spans readable from free text; empty for null or text without a year.

    Two-digit years are 20xx (after an apostrophe, after MY, or as the second half of a range such as 2011-13).
    The text is brought to one notation (each span `lo~hi`, an open side empty) by ordered rewriting rules, then read.
    """
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.translate(t, "    　’‘ʼ`＇", "     '''''")
    t = F.translate(t, "０１２３４５６７８９", "0123456789")
    t = _sub(
        t,
        (_DASH, "-"),
        (r"(?<![a-z0-9])(?:model year|my) ?'?((?:19|20)?[0-9]{2})(?![0-9])", "'$1"),
        (r"'((?:19|20)[0-9]{2})(?![0-9])", " $1"),
        (r"'([0-9]{2})(?![0-9])", " 20$1"),
        (r"(?<![a-z])(?:early|mid|late)[- ]*(?=(?:19|20)[0-9]{2})", " "),
        # 2011-13 and 2011/13: the short second year takes the century 20
        (rf"(?<![0-9])({_YEAR}) *[-/] *([0-9]{{2}})(?![0-9]|-[0-9])", "$1-20$2"),
        (rf"({_YEAR}) *(?:-|/|through|thru|until|till|to) *({_YEAR})(?![0-9])", " $1~$2 "),
        (rf"between *({_YEAR}) *(?:and|&) *({_YEAR})", " $1~$2 "),
        (rf"from *({_YEAR}) *(?:and|&) *({_YEAR})", " $1~$2 "),
        # exclusive open sides are marked and moved by one year when read
        (rf"(?:before|pre|prior to)[- ]*({_YEAR})(?!~)", " ~x$1 "),
        (rf"(?:post|after)[- ]*({_YEAR})(?!~)", " x$1~ "),
        (rf"(?:up to|until|till|through|to)[- ]*({_YEAR})(?!~)", " ~$1 "),
        (rf"(?<![0-9~x])- *({_YEAR})(?!~)", " ~$1 "),
        (rf"(?:since|from|as of|starting)[- ]*({_YEAR})(?!~)", " $1~ "),
        (rf"(?<![~x0-9])({_YEAR}) *(?:\+|- *(?:present|now|today|on|onwards?)|(?:and )?(?:onwards?|on|later|newer|up|present))(?![a-z])", " $1~ "),
        (rf"(?<![~x0-9])({_YEAR}) *-(?! *[0-9])", " $1~ "),
        (rf"(?<![~x0-9])({_YEAR}) *(?:and (?:earlier|older|before)|or earlier)", " ~$1 "),
        (rf"(?<![~x0-9])({_YEAR})(?![~0-9])", " $1~$1 "),
    )
    found = F.regexp_extract_all(t, F.lit(rf"((?:x?{_YEAR})?~(?:x?{_YEAR})?)"), F.lit(1))

    def read(s: Column) -> Column:
        a, b = F.split(s, "~")[0], F.split(s, "~")[1]
        year = lambda c: F.try_to_number(F.regexp_replace(c, "x", ""), F.lit("9999")).cast("int")
        lo = F.when(a == "", OPEN_LO).otherwise(year(a) + F.when(a.startswith("x"), 1).otherwise(0))
        hi = F.when(b == "", OPEN_HI).otherwise(year(b) - F.when(b.startswith("x"), 1).otherwise(0))
        closed = (a != "") & (b != "")
        # the smaller year first, whichever is written first; an open side that leaves nothing is no span
        return F.struct(
            F.when(closed, F.least(lo, hi)).otherwise(lo).alias("lo"),
            F.when(closed, F.greatest(lo, hi)).otherwise(hi).alias("hi"),
        )

    spans = F.transform(F.filter(found, lambda s: s != "~"), read)
    return F.filter(spans, lambda s: s["lo"].isNotNull() & s["hi"].isNotNull() & (s["lo"] <= s["hi"]))


def sweep(spans: DataFrame, *entity: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(entity..., kind, lo, hi): kind `period` for each merged span of an entity, `gap` for each hole between two.

    Integer bounds, both included; spans that overlap, nest or follow on the next integer merge. Repeated spans,
    ties and any order are fine. Rows with a null bound or lo > hi cover nothing; a null entity is an entity of its
    own; an empty input gives no row. Columns other than the entity and the bounds are ignored, whatever their names.
    """
    keys = [F.col(f"`{c}`").alias(f"e{i}") for i, c in enumerate(entity)]
    names = [f"e{i}" for i in range(len(entity))]
    a, b = F.col(f"`{lo}`").cast("long"), F.col(f"`{hi}`").cast("long")
    events = (
        spans.where(a.isNotNull() & b.isNotNull() & (a <= b))
        .select(*keys, F.explode(F.array(F.struct(a.alias("at"), F.lit(1).alias("d")), F.struct((b + 1).alias("at"), F.lit(-1).alias("d")))).alias("v"))
        .groupBy(*names, F.col("v.at").alias("at"))
        .agg(F.sum("v.d").alias("d"))
        .where("d <> 0")
    )
    w = Window.partitionBy(*names).orderBy("at")
    counted = events.select("*", F.sum("d").over(w).alias("now"))
    # a period begins where the count leaves zero, a gap where it falls back to zero; the last fall has nothing after it
    turns = counted.where((F.col("now") == 0) | (F.col("now") == F.col("d"))).select("*", F.lead("at").over(w).alias("until"))
    out = turns.where("until is not null").select(
        *names, F.when(F.col("now") > 0, "period").otherwise("gap").alias("kind"), F.col("at").alias("lo"), (F.col("until") - 1).alias("hi")
    )
    return out.select(*[F.col(f"e{i}").alias(c) for i, c in enumerate(entity)], "kind", F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"))
