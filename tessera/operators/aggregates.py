"""Aggregations: threads, clusters, shares, guarded quantiles, weighted means, vocabularies, collocations, evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def threads(df: DataFrame, key: Sequence[str], order: Sequence[str], text: str, keep: Column | None = None, double_first: bool = False, separator: str = " ", part: Column | None = None) -> DataFrame:
    """(key..., text, n_messages): messages of a thread joined in order; the first is always kept, the others where `keep` holds.

    One shuffle on the key with a partial sort inside the group; a thread's text is what the caller asks for, so its
    size is the group's. Threads of any size come in parts: with `part` (a month, say, of the first column of the order)
    the result has a column `part`, and every part is assembled by itself. first_<...> values are taken with first_known.
    """
    if part is not None:
        df, key = df.withColumn("part", part), [*key, "part"]
    k = F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(True)
    rows = df.select(*key, F.struct(*order, k.alias("__keep"), F.col(text).alias("__t")).alias("__m"))
    g = rows.groupBy(*key).agg(F.array_sort(F.collect_list("__m")).alias("__m"))
    kept = F.concat(F.slice("__m", 1, 1), F.filter(F.slice("__m", F.lit(2), F.greatest(F.size("__m") - 1, F.lit(0))), lambda m: m["__keep"]))
    if double_first:
        kept = F.concat(F.slice("__m", 1, 1), kept)
    return g.select(*key, F.array_join(F.transform(kept, lambda m: m["__t"]), separator).alias(text), F.size("__m").alias("n_messages"))


def first_known(df: DataFrame, key: Sequence[str], order: Sequence[str], *columns: str) -> DataFrame:
    """(key..., columns...): each column's first non-null value in order; a partial aggregate, nothing is sorted."""
    return df.groupBy(*key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns])


def distinct_messages(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, messages): distinct texts of a key in first-seen order."""
    first = df.groupBy(key, text).agg(F.min(order).alias("__o"))
    g = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__o", text))).alias("m"))
    return g.select(key, F.transform("m", lambda m: m[text]).alias("messages"))


def merge_clusters(df: DataFrame, cluster: str, id: str, weight: Sequence[Column], longest: Sequence[str] = (), shortest: Sequence[str] = (), unions: Sequence[str] = (), worst: Mapping[str, Sequence[str]] = {}, sums: Sequence[str] = ()) -> DataFrame:  # noqa: B006
    """One row a cluster: the id of most weight, longest and shortest texts, unions of arrays (sorted), highest ranks, sums, merged ids."""
    rank = lambda c, order: F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.lower(F.col(c))), F.lit(0))
    some = F.array().cast("array<string>")
    return df.groupBy(cluster).agg(
        F.max_by(id, F.struct(*weight, F.col(id))).alias(id),
        F.count("*").alias("merged"),
        F.array_sort(F.collect_set(id)).alias("merged_ids"),
        *[F.max_by(c, F.struct(F.length(c), F.col(c))).alias(c) for c in longest],
        *[F.min_by(c, F.struct(F.length(c), F.col(c))).alias(c) for c in shortest],
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, some))))).alias(c) for c in unions],
        *[F.max_by(c, F.struct(rank(c, order), F.col(c))).alias(c) for c, order in worst.items()],
        *[F.sum(c).alias(c) for c in sums],
    )


def shares(df: DataFrame, a: str, b: str, digits: int = 2) -> DataFrame:
    """(a, b, n, share_of_a, share_of_b): counts and percentages in both directions."""
    n = df.groupBy(a, b).agg(F.count("*").alias("n"))
    part = lambda c: F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(c)), digits)
    return n.select(a, b, "n", part(a).alias("share_of_a"), part(b).alias("share_of_b"))


def guarded_quantiles(df: DataFrame, key: str, value: Column, least: int = 5, where: Column | None = None) -> DataFrame:
    """(key, n, p20, median, p80): exact quantiles of the values that count, null for groups of fewer than `least`."""
    v = value if where is None else F.when(where, value)
    q = lambda p: F.when(F.count(v) >= least, F.percentile(v, F.lit(p)))
    return df.groupBy(key).agg(F.count(v).alias("n"), q(0.2).alias("p20"), q(0.5).alias("median"), q(0.8).alias("p80"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum(value x weight) / sum(weight) over rows that have both; null for no weight."""
    both = value.isNotNull() & weight.isNotNull()
    return F.sum(F.when(both, value * weight)) / F.nullif(F.sum(F.when(both, weight)), F.lit(0))


def top_values(df: DataFrame, key: str, value: str, n: int, skip: Sequence[str] = ()) -> DataFrame:
    """(key, top): 'value: share%' of a key's n most frequent values, joined by '; '."""
    counts = df.where(F.col(value).isNotNull() & ~F.col(value).cast("string").isin(*(skip or [""]))).groupBy(key, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(key)
    ranked = counts.select("*", F.row_number().over(w.orderBy(F.desc("c"), F.col(value))).alias("r"), F.round(100.0 * F.col("c") / F.sum("c").over(w), 1).alias("p")).where(F.col("r") <= n)
    text = F.format_string("%s: %.1f%%", F.col(value).cast("string"), F.col("p"))
    return ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("r", text.alias("t")))).alias("x")).select(key, F.array_join(F.transform("x", lambda x: x["t"]), "; ").alias("top"))


def token_mode(found: Column) -> Column:
    """Most frequent entry of a (short) array, the first seen on a tie."""
    distinct = F.array_distinct(found)
    scored = F.transform(distinct, lambda x, i: F.struct(F.size(F.filter(found, lambda y: y == x)).alias("n"), (-i).alias("i"), x.alias("x")))
    return F.array_max(scored)["x"]


def exploded_counts(df: DataFrame, values: Column, n: int | None = None) -> DataFrame:
    """(value, n): counts of array entries, trimmed, blank ones left out; the n most frequent."""
    c = df.select(F.explode(values).alias("value")).select(F.trim("value").alias("value")).where("value <> ''").groupBy("value").agg(F.count("*").alias("n"))
    return c.orderBy(F.desc("n"), "value").limit(n) if n else c


def histograms(df: DataFrame, *columns: str) -> DataFrame:
    """(facet, value, n) of several columns in one pass over the data: each row is turned into its facets, then counted."""
    facets = F.array(*[F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in columns])
    return df.select(F.inline(facets)).groupBy("facet", "value").agg(F.count("*").alias("n"))


def vocabulary(tokens: DataFrame, doc: str, term: str, least_tf: int = 1, least_df: int = 1, most_share: float = 1.0) -> DataFrame:
    """(term, tf, df) of terms frequent enough and in not too large a share of the documents."""
    n = tokens.agg(F.count_distinct(doc).alias("__docs"))
    per = tokens.groupBy(doc, term).agg(F.count("*").alias("c")).groupBy(term).agg(F.sum("c").alias("tf"), F.count("*").alias("df"))
    return per.crossJoin(F.broadcast(n)).where((F.col("tf") >= least_tf) & (F.col("df") >= least_df) & (F.col("df") <= most_share * F.col("__docs"))).drop("__docs")


def doc_term(tokens: DataFrame, vocabulary: DataFrame, doc: str, term: str) -> DataFrame:
    """(doc, term, n): the document-feature matrix in long form; documents without a term of the vocabulary drop out."""
    return tokens.join(vocabulary.select(term), term, "left_semi").groupBy(doc, term).agg(F.count("*").alias("n"))


def collocations(df: DataFrame, tokens: Column, stop: Sequence[str] = (), least: int = 3, z: float = 3.0) -> DataFrame:
    """(a, b, n, z): neighbouring words more frequent than chance: z = (n - E) / sqrt(E), E = n_a n_b / N.

    Stop words leave a hole, so no pair jumps over one.
    """
    padded = df.select(F.transform(tokens, lambda w: F.when(~w.isin(*(stop or [""])), w)).alias("t"))
    single = padded.select(F.explode("t").alias("w")).where("w is not null").groupBy("w").agg(F.count("*").alias("c"))
    pairs = padded.where("size(t) > 1").select(F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.struct(F.element_at("t", i).alias("a"), F.element_at("t", i + 1).alias("b")))).alias("p"))
    pairs = pairs.select("p.a", "p.b").where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    total = single.agg(F.sum("c").alias("__total"))
    out = pairs.join(single.select(F.col("w").alias("a"), F.col("c").alias("ca")), "a").join(single.select(F.col("w").alias("b"), F.col("c").alias("cb")), "b").crossJoin(F.broadcast(total))
    expected = F.col("ca") * F.col("cb") / F.col("__total")
    return out.select("a", "b", "n", ((F.col("n") - expected) / F.sqrt(expected)).alias("z")).where(F.col("z") > z)


def coherence(doc_terms: DataFrame, top_terms: DataFrame, topic: str, doc: str, term: str, rank: str) -> DataFrame:
    """(topic, coherence): sum over pairs of a topic's top terms of log((co + 1) / (df_j + 1)); only documents with top terms are read."""
    hit = doc_terms.select(doc, term).distinct().join(top_terms.select(topic, term, rank), term)
    df = hit.groupBy(topic, term).agg(F.count("*").alias("df"))
    # a document holds at most the few top terms of a topic, so the pairs of a document are bounded by the caller's n
    both = hit.groupBy(topic, doc).agg(F.collect_list(F.struct(rank, term)).alias("x"))
    pairs = both.select(topic, F.explode("x").alias("i"), F.col("x")).select(topic, F.col(f"i.{term}").alias("a"), F.col(f"i.{rank}").alias("ra"), F.explode("x").alias("j")).where(F.col("ra") > F.col(f"j.{rank}"))
    co = pairs.groupBy(topic, "a", F.col(f"j.{term}").alias("b")).agg(F.count("*").alias("co"))
    a, b = top_terms.select(topic, F.col(term).alias("a"), F.col(rank).alias("ra")), top_terms.select(topic, F.col(term).alias("b"), F.col(rank).alias("rb"))
    every = a.join(b, topic).where("ra > rb").join(co, [topic, "a", "b"], "left").join(df.select(topic, F.col(term).alias("b"), "df"), [topic, "b"], "left")
    return every.groupBy(topic).agg(F.sum(F.log((F.coalesce("co", F.lit(0)) + 1) / (F.coalesce("df", F.lit(0)) + 1))).alias("coherence"))


def ground_truth(hits: DataFrame, row: str, issue: str = "issue", threshold: int = 1) -> DataFrame:
    """One row: recall (issues hit), precision (rows hitting any), coverage (mean best hit ratio), pattern_recall."""
    best = hits.groupBy(issue).agg(F.max("hits").alias("best"), F.max("total").alias("total"))
    rows = hits.groupBy(row).agg(F.max((F.col("hits") >= threshold).cast("int")).alias("mapped"))
    a = best.agg(F.avg((F.col("best") >= threshold).cast("int")).alias("recall"), F.avg(F.col("best") / F.col("total")).alias("coverage"), (F.sum("best") / F.sum("total")).alias("pattern_recall"))
    return a.crossJoin(F.broadcast(rows.agg(F.avg("mapped").alias("precision"))))


def failure_rates(df: DataFrame, *key: str, failed: Column, passed: Column, mileage: Column) -> DataFrame:
    """(key..., tests, passes, fail_rate percent, mean_mileage)"""
    return df.groupBy(*key).agg(F.count("*").alias("tests"), F.sum(passed.cast("int")).alias("passes"), F.round(100.0 * F.avg(failed.cast("int")), 1).alias("fail_rate"), F.round(F.avg(mileage), 2).alias("mean_mileage"))
