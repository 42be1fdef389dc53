"""Filters that keep a reason: ordered rule cascades, gates with relaxation, metadata predicates, accept/reject splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rule = tuple[str, Column, bool]


def cascade(rules: Sequence[Rule], otherwise: tuple[str, bool] = ("kept", True)) -> Column:
    """struct(keep, reason) of the first rule (reason, condition, keep) that holds. A null condition doesn't."""
    out = F
    for reason, condition, keep in rules:
        out = out.when(condition, F.struct(F.lit(keep).alias("keep"), F.lit(reason).alias("reason")))
    return out.otherwise(F.struct(F.lit(otherwise[1]).alias("keep"), F.lit(otherwise[0]).alias("reason")))


def gate(df: DataFrame, verdict: Column) -> DataFrame:
    """df with keep and reason; one pass, callers take the two sides with where."""
    return df.withColumn("__v", verdict).select(*[F.col(f"`{c}`") for c in df.columns if c not in ("keep", "reason")], F.col("__v.keep").alias("keep"), F.col("__v.reason").alias("reason"))


def reasons(gated: DataFrame) -> DataFrame:
    """(reason, keep, n, share in percent), most frequent first."""
    counts = gated.groupBy("reason", "keep").agg(F.count("*").alias("n"))
    return counts.select("*", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2).alias("share")).orderBy(F.desc("n"), "reason")


def message_rules(
    text: Column, mechanical: str, signal: str, noise: str, off_topic: Mapping[str, tuple[str, int]], words: Column, noise_hits: Column, share: float = 0.3, few: int = 3, some: int = 5, many: int = 8,
    quote: str = r"(?i)^\s*quote from:?[^\n]*(?:\n|$)",
) -> list[Rule]:
    """The order in which forum messages are judged; vocabularies are parameters. A message that no rule takes has no signal (see NO_SIGNAL).

    A leading quotation header counts for nothing. off_topic: reason -> (pattern, hits that are still fine); such a message
    stays if it is mechanical. A short message stays if it is mechanical or (from `few` words on) holds a signal.
    """
    t = F.lower(F.trim(F.regexp_replace(text, quote, "")))
    is_mechanical, has_signal = t.rlike(mechanical), t.rlike(signal)
    return [
        ("empty", text.isNull() | (F.trim(text) == ""), False),
        ("quote_only", t == "", False),
        ("only_number", t.rlike(r"^[0-9]+$"), False),
        ("only_link", t.rlike(r"^(?:https?://|www\.)\S+$"), False),
        ("only_punctuation", t.rlike(r"^[^\p{L}\p{N}]+$"), False),
        *[(name, (F.regexp_count(t, F.lit(p)) > fine) & ~is_mechanical, False) for name, (p, fine) in off_topic.items()],
        ("pure_noise", t.rlike(rf"^\s*(?:{noise})\W*$") & ~has_signal, False),
        ("noise_dominated", (noise_hits / F.greatest(words, F.lit(1)) > share) & ~has_signal, False),
        ("very_short_mechanical", (words < few) & is_mechanical, True),
        ("too_short", words < few, False),
        ("short_with_signal", (words < some) & (is_mechanical | has_signal), True),
        ("short_without_signal", words < some, False),
        ("mechanical", is_mechanical, True),
        ("mileage", t.rlike(r"[0-9]\s*(?:km|miles|k\b)"), True),
        ("signal", has_signal, True),
        ("long_enough", words >= many, True),
    ]


#: What becomes of a message that none of message_rules takes.
NO_SIGNAL = ("no_signal", False)


def relaxed(df: DataFrame, *gates: Column) -> DataFrame:
    """Rows that pass each gate in turn; a gate that would drop everything is ignored. A null verdict passes."""
    for g in gates:
        ok = F.coalesce(g, F.lit(True))
        passing = df.agg(F.max(ok).alias("__any"))
        df = df.withColumn("__ok", ok).crossJoin(F.broadcast(passing)).where(F.col("__ok") | ~F.coalesce(F.col("__any"), F.lit(False))).drop("__ok", "__any")
    return df


def metadata_filter(spec: Mapping[str, object], flagged: str = "is_flagged") -> tuple[Column, Column]:
    """(broad, strict): broad drops flagged rows, strict also asks for every non-null field of the specification."""
    broad = ~F.coalesce(F.col(flagged), F.lit(False))
    terms = [F.col(k) == F.lit(v) for k, v in spec.items() if v is not None]
    return broad, reduce(lambda a, b: a & b, terms, broad)


def differs(value: Column, wanted: object) -> Column:
    """Whether a known value conflicts with a known wish; unknown and empty values conflict with nothing."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    return F.lit(wanted is not None) & (v != "") & (v != "unknown") & (v != F.lit(str(wanted)))


def far_years(years: Column, year: Column, most: int = 6) -> Column:
    """Whether all of a row's years (at least one) are more than `most` away."""
    return (F.size(years) > 0) & F.forall(years, lambda y: F.abs(y - year) > most)


def marker_only(text: Column) -> Column:
    return text.rlike(r"^\s*(?:\[[^\]]+\]\s*)+$")


def admissible(text: Column, least: int = 40) -> Column:
    return (F.length(text) >= least) & ~marker_only(text)


def at_least(value: Column, order: Sequence[str], least: str) -> Column:
    rank = F
    for i, name in enumerate(order):
        rank = rank.when(value == name, i)
    return rank.otherwise(-1) >= order.index(least)


def title_scope(title: Column, model: str, scope: str, foreign: Mapping[str, str], other_scope: str) -> Column:
    """Why a title is off topic (null if it is not): a brand or engine of another make, another generation, another model."""
    out = F.when(title.isNull() | (F.trim(title) == ""), F.lit(None).cast("string"))
    for reason, pattern in foreign.items():
        out = out.when(title.rlike(pattern) & ~title.rlike(model), F.concat(F.lit(f"{reason}:"), F.lower(F.regexp_extract(title, f"({pattern})", 1))))
    return out.when(title.rlike(model) & title.rlike(other_scope) & ~title.rlike(scope), "wrong_generation").when(~title.rlike(model) & title.rlike(scope), "wrong_model").when(~title.rlike(model), "off_topic_title")


def contaminated(blob: Column, allowed: Sequence[str], brands: Sequence[str]) -> Column:
    """The first brand outside the allowed group that a text names, or null."""
    others = [b for b in brands if b not in allowed]
    return F.nullif(F.regexp_extract(F.lower(blob), r"\b(" + "|".join(sorted(others, key=len, reverse=True)) + r")\b", 1), F.lit("")) if others else F.lit(None).cast("string")


def faceted(df: DataFrame, text: Column, query: str | None, facets: Mapping[str, object], arrays: Mapping[str, object] = {}, least: Mapping[str, int] = {}) -> DataFrame:  # noqa: B006
    """Text containment over a haystack, equality facets, array facets (value or `all`), least counts; 'all' and None are open."""
    if query:
        df = df.where(F.contains(text, F.lit(query.lower())))
    for c, v in facets.items():
        df = df if v in (None, "all") else df.where(F.col(c) == v)
    for c, v in arrays.items():
        df = df if v in (None, "all") else df.where(F.array_contains(c, F.lit(v)) | F.array_contains(c, F.lit("all")))
    for c, v in least.items():
        df = df.where(F.col(c) >= v)
    return df


def category_filter(df: DataFrame, group: str, least: int, rare: str = "other") -> DataFrame:
    """Values of `group` with fewer rows than `least` become `rare`; one aggregation, broadcast back only if Spark finds it small."""
    counts = df.groupBy(group).agg(F.count("*").alias("__n"))
    return df.join(counts, group, "left").withColumn(group, F.when(F.col("__n") < least, rare).otherwise(F.col(group))).drop("__n")
