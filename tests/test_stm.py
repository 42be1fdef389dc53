import numpy as np

from tessera.operators import stm, topics


def test_shares_are_the_mode():
    rng = np.random.default_rng(2)
    beta = rng.dirichlet(np.ones(12), 4)
    counts, mu, precision = rng.integers(1, 6, 12).astype(float), rng.normal(size=3), np.eye(3) * 0.7
    eta, covariance, expected, _ = stm.shares(counts, beta, mu, precision, np.zeros(3))

    def value(e):
        w = np.exp(np.append(e, 0.0))
        return counts @ np.log(w @ beta / w.sum()) - 0.5 * (e - mu) @ precision @ (e - mu)

    assert all(value(eta) >= value(eta + d) - 1e-9 for d in rng.normal(scale=0.05, size=(200, 3)))
    assert np.isclose(expected.sum(), counts.sum()) and np.all(np.linalg.eigvalsh(covariance) > 0)


def test_topics_and_covariates_are_recovered(spark):
    """Two vocabularies; the greater the feature, the more a document draws from the first."""
    rng = np.random.default_rng(5)
    rows, features = [], []
    for d in range(120):
        x = d / 119
        features.append((d, float(x), None if d % 50 == 0 else 1.0))
        words = [f"a{rng.integers(15)}" if rng.random() < 0.02 + 0.96 * x else f"b{rng.integers(15)}" for _ in range(40)]
        rows += [(d, w, words.count(w)) for w in set(words)]
    cells = spark.createDataFrame(rows, "doc int, term string, n int")
    covariates = spark.createDataFrame(features, "doc int, x double, y double")
    model, gamma = stm.fit(cells, covariates, "doc", "term", "n", ["x"], 2, rounds=15)
    assert np.allclose(model.beta.sum(axis=1), 1) and model.bounds[-1] > model.bounds[0]
    first = np.array([t[0] == "a" for t in model.terms])
    share = model.beta[:, first].sum(axis=1)
    a = int(share.argmax())
    assert share[a] > 0.85 and share[1 - a] < 0.15
    assert model.coefficients[1, 0] * (1 if a == 0 else -1) > 1
    got = {r.doc: r.gamma for r in gamma.where(f"topic = {a}").collect()}
    assert len(got) == 120 and got[119] > 0.75 and got[0] < 0.25
    slopes = {r.topic: r for r in stm.effect_draws(gamma, covariates, "doc", "x").collect()}
    assert slopes[a].ci_lower > 0.4 and slopes[1 - a].ci_upper < -0.4 and slopes[a].ci_lower < slopes[a].estimate < slopes[a].ci_upper
    beta = stm.beta_table(spark, model)
    held = topics.held_out_likelihood(gamma, beta, topics.held_out(cells, "n", 0.5), "doc", "term").first().log_likelihood
    assert -4.0 < held < -2.0 and beta.count() == 2 * len(model.terms)


def test_formula(spark):
    df = spark.createDataFrame([(1, "a", 9.0, None), (2, "b", 0.0, 4), (3, None, None, 6), (3, None, None, 6)], "d int, k string, x double, y int")
    wide, names = stm.covariates(df, "d", "~ k + log(x) + y")
    got = {r.d: tuple(round(float(r[n]), 4) for n in names) for r in wide.collect()}
    assert names == ["k=b", "k=unknown", "log(x)", "y"] and wide.count() == 3
    assert got == {1: (0.0, 0.0, 2.3026, 5.0), 2: (1.0, 0.0, 0.0, 4.0), 3: (0.0, 1.0, 1.1513, 6.0)}
    assert stm.covariates(df, "d", "~ 1")[1] == []
