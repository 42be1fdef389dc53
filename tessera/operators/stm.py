"""A structural topic model by variational EM: logistic-normal topic shares whose means depend on covariates.

Documents stay distributed: each round is one pass in which every task finds the shares of its documents by Newton steps
(E), and only sums leave it - topics x terms, and matrices of topics and covariates - from which the driver updates the
model (M). What is gathered is bounded by MOST_TERMS and the number of topics, whatever the number of documents. Every
round is written to the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms that the model may have (trim the vocabulary before), and the most frequent ones that the spectral start looks at.
MOST_TERMS, SPECTRAL_TERMS = 200_000, 1_000
NEWTON_STEPS = 30


@dataclass
class Model:
    terms: list
    features: list[str]
    beta: np.ndarray  # topics x terms
    coefficients: np.ndarray  # features x (topics - 1), against the last topic
    sigma: np.ndarray
    bounds: list[float] = field(default_factory=list)


def shares(counts: np.ndarray, beta: np.ndarray, mu: np.ndarray, precision: np.ndarray, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(eta, covariance, expected topics x terms, bound) of one document: the mode of its log shares by damped Newton steps.

    counts and beta are those of the document's own terms; the last topic's log share is 0.
    """
    total = counts.sum()

    def value(e):
        full = np.append(e, 0.0)
        top = full.max()
        w = np.exp(full - top)
        return counts @ np.log(np.maximum(w @ beta, 1e-300)) - total * np.log(w.sum()) - 0.5 * (e - mu) @ precision @ (e - mu)

    def parts(e):
        full = np.append(e, 0.0)
        w = np.exp(full - full.max())
        theta = w / w.sum()
        phi = theta[:, None] * beta
        phi = phi / np.maximum(phi.sum(axis=0), 1e-300)
        return theta, phi

    def curvature(theta, phi):
        """The negative second derivative; without the part that could turn its sign where that does."""
        sure = total * (np.diag(theta) - np.outer(theta, theta))[:-1, :-1] + precision
        whole = sure - (np.diag(phi @ counts) - (phi * counts) @ phi.T)[:-1, :-1]
        return whole if np.linalg.eigvalsh(whole)[0] > 1e-8 else sure

    now = value(eta)
    for _ in range(NEWTON_STEPS):
        theta, phi = parts(eta)
        gradient = (phi @ counts - total * theta)[:-1] - precision @ (eta - mu)
        step, size = np.linalg.solve(curvature(theta, phi), gradient), 1.0
        while (then := value(eta + size * step)) < now and size > 1e-4:
            size /= 2
        if then <= now + 1e-10:
            break
        eta, now = eta + size * step, then
    theta, phi = parts(eta)
    covariance = np.linalg.inv(curvature(theta, phi))
    bound = now + 0.5 * np.linalg.slogdet(covariance)[1] + 0.5 * np.linalg.slogdet(precision)[1]
    return eta, covariance, phi * counts, float(bound)


def spectral_start(docs: DataFrame, terms: int, k: int) -> np.ndarray:
    """Topics x terms to begin with: the leading singular vectors of the co-occurrences of the most frequent terms, made positive and normed."""
    m = min(terms, SPECTRAL_TERMS)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = np.zeros((m, m))
        for b in batches:
            for idx, cnt in zip(b["idx"], b["cnt"]):
                c, n = np.zeros(m), float(np.sum(cnt))
                few = np.asarray(idx) < m  # terms are numbered by frequency
                c[np.asarray(idx)[few]] = np.asarray(cnt)[few]
                if n > 1:
                    q += (np.outer(c, c) - np.diag(c)) / (n * (n - 1))
        yield pd.DataFrame({"i": np.arange(m), "q": list(q)})

    def add(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": p["i"].iloc[:1], "q": [np.sum(np.stack(p["q"].to_numpy()), axis=0)]})

    rows = docs.select("idx", "cnt").mapInPandas(count, "i int, q array<double>").groupBy("i").applyInPandas(add, "i int, q array<double>").toPandas().sort_values("i")
    q = np.stack(rows["q"].to_numpy())
    norm = q / np.maximum(q.sum(axis=1, keepdims=True), 1e-12)
    # a term for each topic: each time the row that is farthest from the span of those before
    left, anchors = norm.copy(), []
    for _ in range(min(k, m)):
        a = int(np.argmax((left**2).sum(axis=1)))
        anchors.append(a)
        unit = left[a] / max(np.linalg.norm(left[a]), 1e-12)
        left = left - np.outer(left @ unit, unit)
    u, s, vt = np.linalg.svd(norm[anchors], full_matrices=False)
    start = np.abs(u @ np.diag(s) @ vt)
    beta = np.full((k, terms), 1e-3 / terms)
    beta[: len(start), :m] += start
    beta[len(start) :] += 1.0 / terms
    return beta / beta.sum(axis=1, keepdims=True)


def fit(doc_terms: DataFrame, covariates: DataFrame, doc: str, term: str, n: str, features: Sequence[str], k: int, rounds: int = 20, tolerance: float = 1e-4, ridge: float = 1e-3) -> tuple[Model, DataFrame]:
    """(model, gamma: doc, topic, gamma) from a long document-term table and one row of numeric features a document.

    An intercept is added; missing features count as 0; documents without terms take no part. The rounds end when the
    bound moves by less than the tolerance (relative), which the model keeps round by round.
    """
    from tessera.operators.windows import global_rank
    from tessera.session import cut

    spark = doc_terms.sparkSession
    kind = dict(doc_terms.dtypes)[doc]
    numbered = cut(global_rank(doc_terms.groupBy(F.col(term).alias("term")).agg(F.sum(n).alias("all")), "i", F.desc("all"), "term").select("term", (F.col("i") - 1).cast("int").alias("i")))
    names = [r[0] for r in numbered.orderBy("i").limit(MOST_TERMS + 1).collect()]
    if len(names) > MOST_TERMS:
        raise ValueError("more terms than a model may have; trim the vocabulary")
    cells = doc_terms.select(F.col(doc).alias("doc"), F.col(term).alias("term"), F.col(n).cast("double").alias("n")).join(numbered, "term").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("i", "n"))).alias("c"))
    x = covariates.select(F.col(doc).alias("doc"), F.array(F.lit(1.0), *[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) for f in features]).alias("x"))
    docs = cut(cells.join(x, "doc").select("doc", F.col("c.i").alias("idx"), F.col("c.n").alias("cnt"), "x", F.array_repeat(F.lit(0.0), k - 1).alias("eta")))
    p = len(features) + 1
    model = Model(names, ["(intercept)", *features], spectral_start(docs, len(names), k), np.zeros((p, k - 1)), 20.0 * np.eye(k - 1))
    state = f"doc {kind}, idx array<int>, cnt array<double>, x array<double>, eta array<double>, term int, stats array<double>"

    def expectation(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            beta, coefficients, sigma = shared.value
            precision = np.linalg.inv(sigma)
            words = np.zeros_like(beta)
            xx, xl, ll, bound, count = np.zeros((p, p)), np.zeros((p, k - 1)), np.zeros((k - 1, k - 1)), 0.0, 0
            for b in batches:
                etas = []
                for idx, cnt, own, eta in zip(b["idx"], b["cnt"], b["x"], b["eta"]):
                    own = np.asarray(own)
                    eta, cov, ss, f = shares(np.asarray(cnt), beta[:, idx], own @ coefficients, precision, np.asarray(eta))
                    words[:, idx] += ss
                    xx += np.outer(own, own)
                    xl += np.outer(own, eta)
                    ll += cov + np.outer(eta, eta)
                    bound, count = bound + f, count + 1
                    etas.append(eta)
                yield b.assign(eta=etas, term=-1, stats=None)
            if count:
                used = np.flatnonzero(words.any(axis=0))
                none = {"doc": None, "idx": None, "cnt": None, "x": None, "eta": None}
                rows = [{**none, "term": int(v), "stats": words[:, v]} for v in used]
                rows.append({**none, "term": -2, "stats": np.concatenate([xx.ravel(), xl.ravel(), ll.ravel(), [bound, count]])})
                yield pd.DataFrame(rows, columns=["doc", "idx", "cnt", "x", "eta", "term", "stats"]).astype({"doc": b["doc"].dtype}, errors="ignore")

        return run

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((model.beta, model.coefficients, model.sigma))
        out = cut(docs.mapInPandas(expectation(shared), state))
        shared.destroy()
        docs = out.where("term = -1").select("doc", "idx", "cnt", "x", "eta")
        sums = out.where("term >= 0").groupBy("term").agg(F.array(*[F.sum(F.col("stats")[i]) for i in range(k)]).alias("s")).toPandas()
        parts = out.where("term = -2").select("stats").toLocalIterator()  # one short row a task
        total = np.sum([np.asarray(r[0]) for r in parts], axis=0)
        if not len(sums):
            break
        beta = np.full_like(model.beta, 1e-9)
        beta[:, sums["term"].to_numpy()] += np.stack(sums["s"].to_numpy()).T
        model.beta = beta / beta.sum(axis=1, keepdims=True)
        xx, total = total[: p * p].reshape(p, p), total[p * p :]
        xl, total = total[: p * (k - 1)].reshape(p, k - 1), total[p * (k - 1) :]
        ll, (bound, count) = total[: (k - 1) ** 2].reshape(k - 1, k - 1), total[(k - 1) ** 2 :]
        c = np.linalg.solve(xx + ridge * np.eye(p), xl)
        model.coefficients = c
        sigma = (ll - c.T @ xl - xl.T @ c + c.T @ xx @ c) / count
        model.sigma = (sigma + sigma.T) / 2 + 1e-4 * np.eye(k - 1)
        model.bounds.append(float(bound))
        if len(model.bounds) > 1 and abs(model.bounds[-1] - model.bounds[-2]) < tolerance * abs(model.bounds[-2]):
            break
    full = F.concat("eta", F.array(F.lit(0.0)))
    weights = F.transform(full, lambda e: F.exp(e - F.array_max(full)))
    gamma = docs.select(F.col("doc").alias(doc), F.posexplode(F.transform(weights, lambda w: w / F.aggregate(weights, F.lit(0.0), lambda a, y: a + y))).alias("topic", "gamma"))
    return model, gamma


def covariates(df: DataFrame, doc: str, formula: str) -> tuple[DataFrame, list[str]]:
    """(one row a document with numeric features, their names) of a formula such as `~ engine + log(mileage) + year`.

    Texts become one-hot columns without their first level, missing numbers the median; log() is log(1 + x) of what is
    not negative. A one-hot column is named `term=level`.
    """
    from tessera.functions.numbers import log_clipped
    from tessera.operators.topics import MOST_FEATURES, design_matrix

    kinds = dict(df.dtypes)
    numbers, categories = [], []
    for part in (x.strip() for x in formula.split("~", 1)[-1].split("+")):
        if part in ("", "1"):
            continue
        if part.startswith("log(") and part.endswith(")"):
            x = F.col(part[4:-1].strip()).cast("double")
            df = df.withColumn(part, F.when(x.isNotNull(), log_clipped(x)))
            numbers.append(part)
        elif kinds[part] in ("string", "boolean"):
            categories.append(part)
        else:
            numbers.append(part)
    rows = df.dropDuplicates([doc])
    if not numbers and not categories:
        return rows.select(doc), []
    plain = rows.select(doc, *[F.col(f"`{c}`").alias(f"n{i}") for i, c in enumerate(numbers)], *[F.col(c).alias(f"c{i}") for i, c in enumerate(categories)])
    long = design_matrix(plain, doc, [f"n{i}" for i in range(len(numbers))], [f"c{i}" for i in range(len(categories))])
    names = [r[0] for r in long.select("feature").distinct().orderBy("feature").limit(MOST_FEATURES + 1).collect()]
    if len(names) > MOST_FEATURES:
        raise ValueError("more features than a model may have")
    shown = [numbers[int(n[1:])] if n[0] == "n" else categories[int(n[1 : n.index("=")])] + n[n.index("=") :] for n in names]
    wide = long.groupBy(doc).pivot("feature", names).agg(F.first("value"))
    return rows.select(doc).join(wide, doc, "left").fillna(0.0).select(doc, *[F.col(f"`{n}`").alias(s) for n, s in zip(names, shown)]), shown


def beta_table(spark, model: Model) -> DataFrame:
    """(topic, term, beta) of a model; bounded as the model is."""
    k, v = model.beta.shape
    return spark.createDataFrame(pd.DataFrame({"topic": np.repeat(np.arange(k), v), "term": np.tile(np.array(model.terms, dtype=object), k), "beta": model.beta.ravel()}))


def effect_draws(gamma: DataFrame, covariates: DataFrame, doc: str, feature: str, draws: int = 500) -> DataFrame:
    """(topic, estimate, ci_lower, ci_upper): how a topic's share moves with a feature, with percentiles of simulated slopes."""
    from statistics import NormalDist

    z = F.array(*[F.lit(NormalDist().inv_cdf((i + 0.5) / draws)) for i in range(draws)])
    g = gamma.join(covariates.select(doc, F.col(feature).cast("double").alias("__x")), doc)
    r = g.groupBy("topic").agg(F.regr_slope("gamma", "__x").alias("estimate"), F.regr_syy("gamma", "__x").alias("syy"), F.regr_sxx("gamma", "__x").alias("sxx"), F.regr_sxy("gamma", "__x").alias("sxy"), F.count("*").alias("n"))
    r = r.withColumn("se", F.sqrt(F.greatest(F.col("syy") - F.col("estimate") * F.col("sxy"), F.lit(0.0)) / (F.col("n") - 2) / F.col("sxx")))
    drawn = r.select("topic", "estimate", F.explode(F.transform(z, lambda q: F.col("estimate") + q * F.col("se"))).alias("__d"))
    return drawn.groupBy("topic", "estimate").agg(F.percentile("__d", 0.025).alias("ci_lower"), F.percentile("__d", 0.975).alias("ci_upper"))
