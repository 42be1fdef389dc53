"""Topic statistics and models on Spark ML: clusters with outliers, LDA, class-based TF-IDF, covariates, held-out cells.

The clusters and topics stand in for density clustering and structural topic models, which have no counterpart offline;
they are approximations of the capability, not of its numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seed topics that are sent to every task, and features of one linear regression.
MOST_SEEDS, MOST_FEATURES = 10_000, 200


def cluster_vectors(df: DataFrame, vector: str, k: int, least: int = 5, reduce_to: int | None = None, seed: int = 42, into: str = "topic") -> DataFrame:
    """df with a topic by k-means on (reduced) vectors; topics of fewer than `least` rows are -1 (outliers)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("__v", array_to_vector(F.col(vector)))
    if reduce_to:
        rows = PCA(k=reduce_to, inputCol="__v", outputCol="__p").fit(rows).transform(rows).drop("__v").withColumnRenamed("__p", "__v")
    out = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="__c", maxIter=20).fit(rows).transform(rows).drop("__v")
    n = out.groupBy("__c").agg(F.count("*").alias("__n"))
    return out.join(F.broadcast(n), "__c").withColumn(into, F.when(F.col("__n") >= least, F.col("__c")).otherwise(-1)).drop("__c", "__n")


def lda_topics(doc_terms: DataFrame, doc: str, term: str, n: str, k: int, seed: int = 42, iterations: int = 10) -> tuple[DataFrame, DataFrame]:
    """(gamma: doc, topic, gamma; beta: topic, term, beta) of a latent Dirichlet model over a long document-term table.

    Every term takes part: terms are numbered in a table, documents are sparse vectors over it, and the topics' weights
    meet their terms again in a join on the number.
    """
    from pyspark.ml.clustering import LDA
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import SparseVector, VectorUDT

    from tessera.operators.windows import global_rank

    terms = global_rank(doc_terms.groupBy(term).agg(F.sum(n).alias("__all")), "__i", F.desc("__all"), term).select(term, (F.col("__i") - 1).alias("__i"))
    size = terms.count()
    cells = doc_terms.join(terms, term).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col("__i").cast("int"), F.col(n).cast("double")))).alias("__c"))

    @F.udf(VectorUDT())
    def sparse(c):
        return SparseVector(size, [x[0] for x in c], [x[1] for x in c])

    rows = cells.select(doc, sparse("__c").alias("features"))
    model = LDA(k=k, seed=seed, maxIter=iterations).fit(rows)
    gamma = model.transform(rows).select(doc, F.posexplode(vector_to_array("topicDistribution")).alias("topic", "gamma"))
    beta = model.describeTopics(size).select("topic", F.explode(F.arrays_zip("termIndices", "termWeights")).alias("x")).select("topic", F.col("x.termIndices").cast("long").alias("__i"), F.col("x.termWeights").alias("beta"))
    return gamma, beta.join(terms, "__i").select("topic", term, "beta").withColumnRenamed(term, "term")


def design_matrix(df: DataFrame, id: str, numbers: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """(id, feature, value): numbers (missing ones as the median) and one-hot categories without their first level, in long form."""
    middle = df.agg(*[F.percentile(F.col(c).cast("double"), 0.5).alias(c) for c in numbers]) if numbers else None
    rows = df.select(id, *[F.col(c).cast("double").alias(c) for c in numbers], *[F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(f"{c}__") for c in categories])
    out = None
    for c in numbers:
        part = rows.crossJoin(F.broadcast(middle.select(F.col(c).alias("__m")))).select(id, F.lit(c).alias("feature"), F.coalesce(c, "__m").alias("value"))
        out = part if out is None else out.unionByName(part)
    for c in categories:
        first = rows.agg(F.min(f"{c}__").alias("__m"))
        part = rows.crossJoin(F.broadcast(first)).where(F.col(f"{c}__") != F.col("__m")).select(id, F.concat(F.lit(f"{c}="), f"{c}__").alias("feature"), F.lit(1.0).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def counterfactual(df: DataFrame, category: str, level: str | None) -> DataFrame:
    """df as if every row were of one level of a category; all else as it is."""
    return df.withColumn(category, F.lit(level).cast("string"))


def dominant(gamma: DataFrame, doc: str, topic: str = "topic", value: str = "gamma") -> DataFrame:
    """(doc, topic, gamma): the topic of greatest share, the first on a tie; one row a document."""
    return gamma.groupBy(doc).agg(F.max_by(F.struct(topic, value), F.struct(F.col(value), -F.col(topic))).alias("x")).select(doc, f"x.{topic}", f"x.{value}")


def class_tfidf(tokens: DataFrame, topic: str, term: str) -> DataFrame:
    """(topic, term, score): tf in the topic x log(1 + mean topic size / tf overall)."""
    c = tokens.groupBy(topic, term).agg(F.count("*").alias("n"))
    size = c.agg((F.sum("n") / F.count_distinct(topic)).alias("__mean"))
    overall = c.groupBy(term).agg(F.sum("n").alias("__all"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(topic))
    return c.withColumn("__share", share).join(overall, term).crossJoin(F.broadcast(size)).select(topic, term, (F.col("__share") * F.log(1 + F.col("__mean") / F.col("__all"))).alias("score"))


def watchlist_topics(df: DataFrame, doc: str, text: str, phrases: Sequence[tuple[str, Sequence[str]]], first: int = 2000) -> DataFrame:
    """(doc, topic, name): pseudo-topics of documents that contain a phrase of a watch list."""
    from tessera.functions.text import contains_any

    rows = F.array_compact(F.array(*[F.when(contains_any(F.lower(text), ps), F.struct(F.lit(first + i).alias("topic"), F.lit(name).alias("name"))) for i, (name, ps) in enumerate(phrases)]))
    return df.select(doc, F.inline(rows))


def exclusivity(beta: DataFrame, topic: str, term: str, value: str, n: int) -> DataFrame:
    """(topic, exclusivity): mean ECDF of the exclusiveness of a topic's n likeliest terms."""
    from tessera.operators.windows import ecdf, top_n

    shared = beta.withColumn("__e", F.col(value) / F.sum(value).over(Window.partitionBy(term)))
    return top_n(ecdf(shared, [topic], "__e", "__x", term), [topic], n, F.desc(value), F.col(term)).groupBy(topic).agg(F.avg("__x").alias("exclusivity"))


def held_out(doc_terms: DataFrame, n: str, share: float) -> DataFrame:
    """doc_terms with `held` (round half even of share x n) and `train` = n - held for every cell."""
    held = F.bround(F.col(n) * share).cast("bigint")
    return doc_terms.withColumn("held", held).withColumn("train", F.col(n) - held)


def covariate_model(df: DataFrame, topic: str, numbers: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """(topic, feature, coefficient) of a multinomial logistic regression; numbers imputed by median, categories one-hot, first level dropped."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler

    rows = df.select(topic, *[F.col(c).cast("double").alias(c) for c in numbers], *[F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in categories])
    imputed = [f"__i_{c}" for c in numbers]
    # descending order puts the first level last, which is the one that the encoder drops
    stages = [
        StringIndexer(inputCol=topic, outputCol="label", stringOrderType="alphabetAsc"),
        Imputer(strategy="median", inputCols=list(numbers), outputCols=imputed),
        *[StringIndexer(inputCol=c, outputCol=f"__s_{c}", stringOrderType="alphabetDesc") for c in categories],
        OneHotEncoder(inputCols=[f"__s_{c}" for c in categories], outputCols=[f"__o_{c}" for c in categories], dropLast=True),
        VectorAssembler(inputCols=[*imputed, *[f"__o_{c}" for c in categories]], outputCol="features"),
        LogisticRegression(family="multinomial", maxIter=30, regParam=0.01),
    ]
    model = Pipeline(stages=stages).fit(rows)
    topics = model.stages[0].labels
    names = [*numbers, *[f"{c}={v}" for c, s in zip(categories, model.stages[2 : 2 + len(categories)]) for v in s.labels[:-1]]]
    m = model.stages[-1].coefficientMatrix.toArray()
    return df.sparkSession.createDataFrame([(t, f, float(m[i, j])) for i, t in enumerate(topics) for j, f in enumerate(names)], "topic string, feature string, coefficient double")


def effects(gamma: DataFrame, topic: str, group: str, value: str) -> DataFrame:
    """(topic, group, estimate, ci_lower, ci_upper, contrast): mean share with a normal interval, and its difference from the topic's mean."""
    g = gamma.groupBy(topic, group).agg(F.avg(value).alias("estimate"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("__se"), F.sum(value).alias("__s"), F.count(value).alias("__n"))
    w = Window.partitionBy(topic)
    grand = F.sum("__s").over(w) / F.sum("__n").over(w)
    return g.select(topic, group, "estimate", (F.col("estimate") - 1.96 * F.col("__se")).alias("ci_lower"), (F.col("estimate") + 1.96 * F.col("__se")).alias("ci_upper"), (F.col("estimate") - grand).alias("contrast"))


def rescued_outliers(df: DataFrame, vector: str, topic: str, score: Column, k: int, least_rows: int = 6, least_score: float = 0.005, first: int = 1000) -> DataFrame:
    """Outliers (-1) of enough score are clustered again; their new topics are numbered from `first`. Too few of them stay."""
    again = (F.col(topic) == -1) & (score >= least_score)
    rest, some = df.where(~F.coalesce(again, F.lit(False))), df.where(F.coalesce(again, F.lit(False)))
    if some.limit(least_rows).count() < least_rows:
        return df
    new = cluster_vectors(some.drop(topic), vector, min(k, least_rows), least_rows // 2, into=topic)
    return rest.unionByName(new.withColumn(topic, F.when(F.col(topic) >= 0, F.col(topic) + first).otherwise(-1)), allowMissingColumns=True)


def search_k(doc_terms: DataFrame, doc: str, term: str, n: str, ks: Sequence[int], top: int = 10, seed: int = 42) -> DataFrame:
    """(k, exclusivity, coherence): mean diagnostics of a topic model for each number of topics; one fit each."""
    from tessera.operators.aggregates import coherence
    from tessera.operators.windows import top_n

    out = None
    for k in ks:
        _, beta = lda_topics(doc_terms, doc, term, n, k, seed)
        best = top_n(beta, ["topic"], top, F.desc("beta"), F.col("term")).withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("beta"), "term")))
        c = coherence(doc_terms.select(F.col(doc).alias("doc"), F.col(term).alias("term")), best, "topic", "doc", "term", "r").agg(F.avg("coherence").alias("coherence"))
        e = exclusivity(beta, "topic", "term", "beta", top).agg(F.avg("exclusivity").alias("exclusivity"))
        row = e.crossJoin(F.broadcast(c)).select(F.lit(k).alias("k"), "exclusivity", "coherence")
        out = row if out is None else out.unionByName(row)
    return out


def number_of_topics(documents: int, steps: Sequence[tuple[int, int]] = ((200, 5), (1000, 10), (5000, 15)), most: int = 25) -> int:
    """A number of topics by the size of the corpus."""
    return next((k for size, k in steps if documents < size), most)


def varying(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The covariates that take more than one value; one aggregation."""
    row = df.agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] > 1]


def dominant_ties(gamma: DataFrame, doc: str, topic: str = "topic", value: str = "gamma") -> DataFrame:
    """(doc, topic, gamma): every topic of greatest share, several rows a document where they tie."""
    best = gamma.groupBy(doc).agg(F.max(value).alias(value))
    return gamma.join(best, [doc, value]).select(doc, topic, value)


def reassigned(tokens: DataFrame, doc: str, topic: str, term: str) -> DataFrame:
    """(doc, topic) of every document: outliers (-1) go to the topic whose class-based TF-IDF weighs most over their words, if any does."""
    scores = class_tfidf(tokens.where(F.col(topic) >= 0), topic, term).withColumnRenamed(topic, "__topic")
    outliers = tokens.where(F.col(topic) < 0).select(doc, term)
    sums = outliers.join(scores, term).groupBy(doc, "__topic").agg(F.sum("score").alias("s"))
    best = sums.groupBy(doc).agg(F.max_by("__topic", F.struct("s", -F.col("__topic"))).alias("__best"))
    return tokens.select(doc, topic).distinct().join(best, doc, "left").select(doc, F.when(F.col(topic) < 0, F.coalesce("__best", topic)).otherwise(F.col(topic)).alias(topic))


def guided(df: DataFrame, vector: str, seeds: DataFrame, least: float = 0.0, into: str = "topic") -> DataFrame:
    """df with the nearest of the seed topics (topic, embedding; a short list) by cosine, -1 below the least similarity."""
    from tessera.functions.nested import cosine

    if seeds.limit(MOST_SEEDS + 1).count() > MOST_SEEDS:
        raise ValueError("more seed topics than may be sent to every task")
    pairs = df.crossJoin(F.broadcast(seeds.select(F.col("topic").alias("__t"), F.col("embedding").alias("__e"))))
    near = F.max_by("__t", F.struct("__s", -F.col("__t")))
    scored = pairs.withColumn("__s", F.coalesce(cosine(F.col(vector), F.col("__e")), F.lit(-1.0)))
    others = [c for c in df.columns if c != into]
    return scored.groupBy(*others).agg(F.when(F.max("__s") >= least, near).otherwise(-1).alias(into))


def simulated_effects(gamma: DataFrame, topic: str, group: str, value: str, draws: int = 500) -> DataFrame:
    """(topic, group, estimate, ci_lower, ci_upper): mean share with the 2.5th and 97.5th percentile of simulated means.

    The draws are quantiles of the normal law of each mean, evenly spaced, so the interval is the same every time.
    """
    from statistics import NormalDist

    z = F.array(*[F.lit(NormalDist().inv_cdf((i + 0.5) / draws)) for i in range(draws)])
    g = gamma.groupBy(topic, group).agg(F.avg(value).alias("estimate"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("__se"))
    drawn = g.select(topic, group, "estimate", F.explode(F.transform(z, lambda x: F.col("estimate") + x * F.col("__se"))).alias("__d"))
    return drawn.groupBy(topic, group, "estimate").agg(F.percentile("__d", 0.025).alias("ci_lower"), F.percentile("__d", 0.975).alias("ci_upper"))


def held_out_likelihood(gamma: DataFrame, beta: DataFrame, cells: DataFrame, doc: str, term: str, held: str = "held") -> DataFrame:
    """(log_likelihood): mean log probability of a held-out word under its document's topics; words unknown to the topics count for nothing."""
    p = cells.where(F.col(held) > 0).join(gamma, doc).join(beta.withColumnRenamed("term", term), ["topic", term]).groupBy(doc, term, held).agg(F.sum(F.col("gamma") * F.col("beta")).alias("p"))
    return p.where("p > 0").agg((F.sum(F.col(held) * F.log("p")) / F.sum(held)).alias("log_likelihood"))


def linear_effects(df: DataFrame, value: str, numbers: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """(feature, estimate, std_error, ci_lower, ci_upper, significant) of a linear regression: est. +- 1.96 se, significant if |est / se| > 1.96.

    Terms that are a combination of others come out with a null error.
    """
    import numpy as np

    id = "__row"
    rows = df.where(F.col(value).isNotNull()).withColumn(id, F.monotonically_increasing_id())
    long = design_matrix(rows, id, numbers, categories)
    names = [r[0] for r in long.select("feature").distinct().orderBy("feature").limit(MOST_FEATURES + 1).collect()]
    if len(names) > MOST_FEATURES:
        raise ValueError("more features than one regression may hold")
    wide = rows.select(id, F.col(value).cast("double").alias("__y")).join(long.groupBy(id).pivot("feature", names).agg(F.first("value")), id, "left").fillna(0.0)
    x = [F.lit(1.0), *[F.col(f"`{n}`") for n in names]]
    # the normal equations are one aggregate row: sums of products of the columns
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    sums = wide.agg(*[F.sum(x[i] * x[j]) for i, j in pairs], *[F.sum(c * F.col("__y")) for c in x], F.sum(F.col("__y") * F.col("__y")), F.count("*")).first()
    k = len(x)
    a = np.zeros((k, k))
    for (i, j), s in zip(pairs, sums):
        a[i, j] = a[j, i] = s or 0.0
    b, yy, n = np.array([s or 0.0 for s in sums[len(pairs) : len(pairs) + k]]), sums[-2] or 0.0, sums[-1]
    inverse = np.linalg.pinv(a)
    est = inverse @ b
    free = n - np.linalg.matrix_rank(a)
    se = np.sqrt(np.maximum(np.diag(inverse), 0) * max(yy - est @ b, 0.0) / free) if free > 0 else np.zeros(k)
    out = [(f, float(e), float(s) if s > 0 else None) for f, e, s in zip(["(intercept)", *names], est, se)]
    found = df.sparkSession.createDataFrame(out, "feature string, estimate double, std_error double")
    return found.select("*", (F.col("estimate") - 1.96 * F.col("std_error")).alias("ci_lower"), (F.col("estimate") + 1.96 * F.col("std_error")).alias("ci_upper"), (F.abs(F.col("estimate") / F.col("std_error")) > 1.96).alias("significant"))
