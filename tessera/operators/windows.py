"""Windows and sequential folds: sessions, neighbourhoods, quota walks, budgets, packing, overlapping chunks, ECDF and FREX."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, key: Sequence[str], n: int, *order: Column, ties: bool = False) -> DataFrame:
    """The first n rows of each key by order; with ties, all rows of rank n and better."""
    rank = F.rank() if ties else F.row_number()
    return df.withColumn("__r", rank.over(Window.partitionBy(*key).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def first_wins(df: DataFrame, key: Sequence[str], *order: Column | str) -> DataFrame:
    return top_n(df, key, 1, *order)


def union_first_wins(key: str, *sources: DataFrame) -> DataFrame:
    """Union by key in which the earlier source wins."""
    tagged = [s.withColumn("__s", F.lit(i)) for i, s in enumerate(sources)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return first_wins(out, [key], F.col("__s")).drop("__s")


def sessions(df: DataFrame, key: Sequence[str], order: str, gap: Column, into: str = "session", breaks: Column | None = None) -> DataFrame:
    """df with a session number from 1: a new one where `gap` to the row before exceeds 0, or where the row before breaks.

    gap: expression over `order` and `__before` (the previous row's order), true where a session begins.
    """
    w = Window.partitionBy(*key).orderBy(order)
    b = F.coalesce(F.lag(F.coalesce(breaks, F.lit(False)).cast("int")).over(w), F.lit(0)) if breaks is not None else F.lit(0)
    marked = df.withColumn("__before", F.lag(order).over(w)).withColumn("__break", b)
    new = F.col("__before").isNull() | gap | (F.col("__break") == 1)
    return marked.withColumn(into, F.sum(new.cast("int")).over(w)).drop("__before", "__break")


def neighbourhood(df: DataFrame, key: Sequence[str], order: str, values: str, before: int, after: int, into: str) -> DataFrame:
    """df with the distinct, sorted union of an array column over the rows from -before to +after."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(-before, after)
    return df.withColumn(into, F.array_sort(F.array_distinct(F.flatten(F.collect_list(values).over(w)))))


def quota_walk(df: DataFrame, tier: str, quota: int, cap: int, *order: Column) -> DataFrame:
    """Whole tiers are added until the quota is reached, then the best `cap` rows: a tier stays if the tiers before hold less.

    Tier counts are a handful of rows, added up apart from the data and broadcast back.
    """
    counts = df.groupBy(tier).agg(F.count("*").alias("__n"))
    before = counts.select(tier, F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy(tier).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return df.join(F.broadcast(before.where(F.col("__before") < quota)), tier).drop("__before").orderBy(tier, *order).limit(cap)


def diversified(ranked: DataFrame, rank: str, category: str, head: int = 30, general: Sequence[str] = ("general",)) -> DataFrame:
    """Within the head the first row of each non-general category moves to the front; the rest keep their order. Adds `position`.

    The head is at most `head` rows, so its window runs over those alone; the tail keeps its rank.
    """
    top = ranked.where(F.col(rank) <= head)
    first = (F.row_number().over(Window.partitionBy(category).orderBy(rank)) == 1) & ~F.col(category).isin(*general)
    lead = top.withColumn("__lead", F.when(first, 0).otherwise(1))
    lead = lead.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__lead", rank))).drop("__lead")
    return lead.unionByName(ranked.where(F.col(rank) > head).withColumn("position", F.col(rank)))


def fixed_batches(df: DataFrame, number: str, size: int, stride: int) -> DataFrame:
    """df with `batch`: overlapping batches of `size` rows every `stride`, by a row number from 0; a row may be in several."""
    k = -(-size // stride)
    last = F.floor(F.col(number) / stride)
    return df.withColumn("batch", F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: last - i), lambda b: (b >= 0) & (F.col(number) < b * stride + size))))


def ecdf(df: DataFrame, key: Sequence[str], value: str, into: str, ties: str) -> DataFrame:
    w = Window.partitionBy(*key)
    return df.withColumn(into, F.row_number().over(w.orderBy(value, ties)) / F.count("*").over(w))


def frex(beta: DataFrame, topic: str, term: str, value: str, weight: float = 0.5) -> DataFrame:
    """beta with `frex`: harmonic blend of the ranks of frequency and of exclusivity within each topic."""
    exclusive = beta.withColumn("__e", F.col(value) / F.sum(value).over(Window.partitionBy(term)))
    both = ecdf(ecdf(exclusive, [topic], value, "__f", term), [topic], "__e", "__x", term)
    return both.withColumn("frex", 1 / (weight / F.col("__x") + (1 - weight) / F.col("__f"))).drop("__e", "__f", "__x")


def run_delta(df: DataFrame, key: str, run: str, *metrics: str) -> DataFrame:
    """df with <metric>_delta against the run before."""
    w = Window.partitionBy(key).orderBy(run)
    return df.withColumns({f"{m}_delta": F.col(m) - F.lag(m).over(w) for m in metrics})


def global_rank(df: DataFrame, into: str, *order: Column | str) -> DataFrame:
    """df with its position (from 1) in one order over all rows, without bringing them into one task.

    Rows are range-partitioned by the order and numbered inside their range; the ranges' counts, one row each, are added
    up and broadcast. The order should be total (an id last), else ties are numbered arbitrarily.
    """
    from tessera.session import cut

    ranged = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    numbered = ranged.withColumn("__r", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    return numbered.join(F.broadcast(offsets), "__range").withColumn(into, F.col("__r") + F.col("__before")).drop("__range", "__r", "__before")


def share_cap(df: DataFrame, capped: Column, share: float, *order: Column | str) -> DataFrame:
    """Capped rows are kept up to floor(share x others / (1 - share)), best first by order; the others all stay.

    The counts are one aggregate row; the capped rows alone are ranked, in ranges.
    """
    n = df.agg(F.count_if(~F.coalesce(capped, F.lit(False))).alias("__others"))
    some = df.where(F.coalesce(capped, F.lit(False)))
    rest = df.where(~F.coalesce(capped, F.lit(False)))
    limit = F.floor(F.lit(share) * F.col("__others") / F.lit(1 - share))
    ranked = global_rank(some, "__position", *order).crossJoin(F.broadcast(n)).where(F.col("__position") <= limit).drop("__position", "__others")
    return rest.unionByName(ranked)


# -- order-dependent folds: each decision depends on the ones before, so they run per key in Arrow batches


def interval_dedupe(df: DataFrame, key: str, lo: str, hi: str, score: str, tolerance: float) -> DataFrame:
    """Best first (the earlier one on a tie), a row stays unless its interval, widened by the tolerance, overlaps one that stayed (per key).

    What stayed doesn't overlap, so only its neighbours are looked at.
    """

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values([score, lo], ascending=[False, True], kind="stable")
        done: list[tuple[float, float]] = []
        keep = []
        for i, a, z in zip(b.index, b[lo], b[hi]):
            k = bisect_left(done, (a, z))
            if all(not (a - tolerance < y and x < z + tolerance) for x, y in done[max(0, k - 1) : k + 1]):
                done.insert(k, (a, z))
                keep.append(i)
        return b.loc[keep]

    return df.groupBy(key).applyInPandas(run, df.schema)


def duration_windows(segments: DataFrame, key: str, start: str = "start", duration: str = "duration", text: str = "text", least: float = 35.0, most: float = 45.0, overlap: float = 10.0) -> DataFrame:
    """(key, chunk_no, start, end, text): windows that grow to `least` seconds (not beyond `most` but for a single segment), the next begins `overlap` before the end."""
    kind = dict(segments.dtypes)[key]

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.dropna(subset=[start]).sort_values([start, text], kind="stable").reset_index(drop=True)
        s, e, t = b[start].to_numpy(), (b[start] + b[duration].fillna(0)).to_numpy(), b[text].fillna("").tolist()
        out, i, n = [], 0, len(b)
        while i < n:
            j = i
            while j + 1 < n and e[j] - s[i] < least and e[j + 1] - s[i] <= most:
                j += 1
            out.append((b[key].iloc[0], len(out), float(s[i]), float(e[j]), " ".join(x for x in t[i : j + 1] if x)))
            if j + 1 >= n:
                break
            k = j + 1
            while k - 1 > i and s[k - 1] >= e[j] - overlap:
                k -= 1
            i = max(k, i + 1)
        return pd.DataFrame(out, columns=[key, "chunk_no", "start", "end", "text"])

    return segments.select(key, start, duration, text).groupBy(key).applyInPandas(run, f"`{key}` {kind}, chunk_no int, start double, end double, text string")


def greedy_budget(df: DataFrame, key: str, score: str, cost: str, order: str, budget: int) -> DataFrame:
    """Per key, best score first, rows that still fit the budget (a row too large is skipped, smaller ones may follow); scores of 0 never."""
    cols = df.columns

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b[b[score] > 0].sort_values([score, order], ascending=[False, True], kind="stable")
        left, keep = budget, []
        for i, c in zip(b.index, b[cost]):
            if c <= left:
                left -= c
                keep.append(i)
        return b.loc[keep].sort_values(order)[cols]

    return df.groupBy(key).applyInPandas(run, df.schema)


def greedy_batches(df: DataFrame, key: str, cost: str, order: str, most: int, into: str = "batch") -> DataFrame:
    """Per key, consecutive rows in batches; a batch is closed when the next row would exceed `most`."""
    from pyspark.sql import types as T

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(order, kind="stable")
        batch, total, out = 0, 0, []
        for c in b[cost]:
            if total and total + c > most:
                batch, total = batch + 1, 0
            total += c
            out.append(batch)
        return b.assign(**{into: pd.Series(out, index=b.index, dtype="int32")})

    return df.groupBy(key).applyInPandas(run, T.StructType([*df.schema.fields, T.StructField(into, T.IntegerType())]))


def entity_cap(df: DataFrame, scope: str, entity: str, item: str, order: str, most: int) -> DataFrame:
    """Within a scope, first come first served: an entity takes at most `most` new items; one refused may go to a later entity."""
    def run(b: pd.DataFrame) -> pd.DataFrame:
        taken: set = set()
        count: dict = {}
        keep = []
        b = b.sort_values(order, kind="stable")
        for i, e, x in zip(b.index, b[entity], b[item]):
            if x not in taken and count.get(e, 0) < most:
                taken.add(x)
                count[e] = count.get(e, 0) + 1
                keep.append(i)
        return b.loc[keep]

    return df.groupBy(scope).applyInPandas(run, df.schema)


def signature_dedupe(df: DataFrame, scope: str, id: str, tokens: str, order: str, threshold: float = 0.45) -> DataFrame:
    """(scope, id, kept_id): in order, a row joins the first kept row of Jaccard similarity >= threshold, whose signature grows by it."""
    kinds = dict(df.dtypes)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[object, set]] = []
        holders: dict[object, list[int]] = {}  # kept rows by token, so that only rows that share one are compared
        out = []
        for i, t in zip(*[b.sort_values(order, kind="stable")[c] for c in (id, tokens)]):
            s = set(t)
            shared = Counter(k for w in s for k in holders.get(w, ()))
            hit = min((k for k, n in shared.items() if n >= threshold * (len(kept[k][1]) + len(s) - n)), default=None)
            if hit is None:
                hit, new = len(kept), s
                kept.append((i, set()))
            else:
                new = s - kept[hit][1]
            kept[hit][1].update(new)
            for w in new:
                holders.setdefault(w, []).append(hit)
            out.append((b[scope].iloc[0], i, kept[hit][0]))
        return pd.DataFrame(out, columns=[scope, id, "kept_id"])

    return df.groupBy(scope).applyInPandas(run, f"`{scope}` {kinds[scope]}, `{id}` {kinds[id]}, kept_id {kinds[id]}")
