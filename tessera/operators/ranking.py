"""Tiers, scores and tags of evidence against a specification; lexicon-driven, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import pattern_hits

NO_TEXTS = "array<string>"


@dataclass(frozen=True)
class Lexicon:
    """code -> pattern by kind, in order; codes of a kind may imply codes of another (engine -> family, fuel, drive)."""

    patterns: Mapping[str, Sequence[tuple[str, str]]]
    implies: Mapping[tuple[str, str], Mapping[str, str]] = field(default_factory=dict)

    def tags(self, text: Column, kind: str) -> Column:
        rules = self.patterns.get(kind, ())
        return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(c)) for c, p in rules])) if rules else F.array().cast(NO_TEXTS)

    def implied(self, tags: Column, kind: str, other: str) -> Column:
        table = self.implies.get((kind, other), {})
        if not table:
            return F.array().cast(NO_TEXTS)
        lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        return F.array_sort(F.array_distinct(F.filter(F.transform(tags, lambda t: F.element_at(lookup, t)), lambda x: x.isNotNull())))


def tag(df: DataFrame, text: Column, lexicon: Lexicon, kinds: Sequence[str], derived: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """df with one array column a kind; derived (kind, other) adds what the found codes of a kind imply to another."""
    out = df.withColumns({k: lexicon.tags(text, k) for k in kinds})
    for kind, other in derived:
        out = out.withColumn(other, F.array_distinct(F.concat(F.col(other), lexicon.implied(F.col(kind), kind, other))))
    return out


def signal(text: Column, problem: Sequence[str], specific: Sequence[str], negation: Sequence[str]) -> Column:
    """max(0, problem + specific - negation), counted in patterns that occur."""
    return F.greatest(F.lit(0), pattern_hits(text, problem) + pattern_hits(text, specific) - pattern_hits(text, negation))


def tiered(start: int, lowering: Sequence[tuple[Column, int]], raising: Sequence[tuple[Column, int]] = (), shifts: Sequence[tuple[Column, int]] = (), floors: Sequence[tuple[Column, int]] = (), best: int = 0, worst: int = 5) -> Column:
    """A tier from ordered rules: conditions that lower it to at most n, raise it to at least n, shift it, and floors that hold at the end."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    t = F.lit(start)
    for condition, n in lowering:
        t = F.when(yes(condition), F.least(t, F.lit(n))).otherwise(t)
    for condition, n in raising:
        t = F.when(yes(condition), F.greatest(t, F.lit(n))).otherwise(t)
    t = F.greatest(F.lit(best), F.least(F.lit(worst), t + sum((F.when(yes(c), n).otherwise(0) for c, n in shifts), F.lit(0))))
    for condition, n in floors:
        t = F.when(yes(condition), F.greatest(t, F.lit(n))).otherwise(t)
    return F.greatest(F.lit(best), F.least(F.lit(worst), t))


def overlap_tier(tags: Sequence[tuple[Column, Column]], risk: Column) -> Column:
    """1, 2, ... for the first pair of arrays that overlaps, one more than their number for none; a risk adds one, not beyond that."""
    worst = len(tags) + 1
    t = F
    for i, (a, b) in enumerate(tags):
        t = t.when(F.arrays_overlap(a, b), i + 1)
    return F.least(F.lit(worst), t.otherwise(worst) + F.coalesce(risk, F.lit(False)).cast("int"))


def focus(technical: Column, chronic: Column, hint: Column, penalties: Sequence[Column], cap: int | None = None) -> Column:
    """technical + 2 x chronic (only with technical) + hint - penalties (their sum capped)."""
    p = sum(penalties, F.lit(0))
    return technical + F.when(technical > 0, 2 * chronic).otherwise(0) + hint - (F.least(p, F.lit(cap)) if cap is not None else p)


def level(score: Column, high: int = 4, medium: int = 2) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def narrowed(values: Column, ok) -> Column:
    """values that satisfy ok, or all of them where none does: a guard never empties a list."""
    kept = F.filter(values, ok)
    return F.when(F.size(kept) > 0, kept).otherwise(values)


def coverage(t1: Column, t2: Column, t3: Column, component: Column) -> Column:
    """high / medium / low / minimal evidence from the counts of the tiers."""
    return (
        F.when((t1 >= 10) | (t1 + t2 + component >= 15), "high").when((t1 >= 3) | (t1 + t2 + component >= 5), "medium").when((t1 > 0) | (t2 + t3 >= 5), "low").otherwise("minimal")
    )


def probes(base: Sequence[str], *more: Sequence[str]) -> list[str]:
    """Probe texts in order, the first of those that differ in case only."""
    seen: dict[str, str] = {}
    for p in [*base, *(x for xs in more for x in xs)]:
        seen.setdefault(" ".join(p.lower().split()), p)
    return [p for k, p in seen.items() if k]


def confirmed(corroboration: Column, confidence: Column, quality: Column, rescue: Column, least: int = 2) -> Column:
    return (corroboration >= least) | ((corroboration >= 1) & (confidence == "high") & ((quality == "high") | rescue))


def triangulated(content, context, titles, window) -> Column:
    """struct(spans, confidence) of an issue's years: its own phrase, else the context's; intersected with titles and the window.

    high: content agrees with titles; medium: content (or context with titles) within the window; low: context or titles
    alone; conflict: content outside the window; none: nothing known. All four are arrays of spans (functions.spans).
    """
    from tessera.functions import spans as S

    some = lambda c: F.size(c) > 0
    base = F.when(some(content), content).otherwise(context)
    inside = F.when(some(window), S.intersect(base, window)).otherwise(S.union(base))
    with_titles = S.intersect(inside, titles)
    result = (
        F.when(~some(base) & some(titles), F.struct(S.union(titles).alias("spans"), F.lit("low").alias("confidence")))
        .when(~some(base), F.struct(F.array().cast(S.SPANS).alias("spans"), F.lit("none").alias("confidence")))
        .when(~some(inside), F.struct(S.union(base).alias("spans"), F.lit("conflict").alias("confidence")))
        .when(some(with_titles), F.struct(with_titles.alias("spans"), F.when(some(content), "high").otherwise("medium").alias("confidence")))
        .otherwise(F.struct(inside.alias("spans"), F.when(some(content), "medium").otherwise("low").alias("confidence")))
    )
    return result


def scopes(blob: Column, rules: Sequence[tuple[str, str]], everything: str) -> Column:
    """Scopes a text speaks of (fuel, gearbox, before or after a facelift), or the one that stands for all."""
    found = F.array_compact(F.array(*[F.when(blob.rlike(p), F.lit(n)) for n, p in rules]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(everything)))


def scoped(values: Column, component: Column, powertrain: Sequence[str]) -> Column:
    """Engine lists only where the component belongs to the powertrain; empty elsewhere."""
    return F.when(component.isin(*powertrain), values).otherwise(F.array().cast(NO_TEXTS))


def by_priority(*candidates: Column) -> Column:
    """The first known of several sources (name, first message, first messages), and which one it was, from 1."""
    source = F
    for i, c in enumerate(candidates):
        source = source.when(c.isNotNull(), i + 1)
    return F.struct(F.coalesce(*candidates).alias("value"), source.otherwise(0).alias("source"))
