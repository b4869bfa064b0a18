"""Models against plain numpy and published table values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortis.stats import compare, curve, dist, glm, linear, mixed


def test_distributions():
    assert dist.t_cdf(2.0, 10) == pytest.approx(0.9633059826, abs=1e-9)
    assert 1 - dist.f_p(2.0, 2, 10) == pytest.approx(0.8140655679, abs=1e-9)
    assert dist.normal_p(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert dist.t_p(1.96, 1e7) == pytest.approx(dist.normal_p(1.96), abs=1e-6)
    # Two means: the studentised range is sqrt(2) times |t|.
    for df in (2, 5, 10, 60):
        t = 2.3
        assert 1 - dist.tukey_cdf(t * math.sqrt(2), 2, df) == pytest.approx(dist.t_p(t, df), abs=1e-6)
    # Table of the upper 5 % points.
    for k, df, q in ((3, 20, 3.578), (5, 20, 4.232), (4, 30, 3.845), (5, 120, 3.917), (5, 10**6, 3.858)):
        assert dist.tukey_quantile(0.95, k, df) == pytest.approx(q, abs=6e-4)


def test_distributions_match_the_jvm(spark):
    d = spark._jvm.org.apache.commons.math3.distribution
    for t, df in ((0.3, 3.0), (2.5, 17.0), (4.0, 6000.0)):
        assert dist.t_cdf(t, df) == pytest.approx(d.TDistribution(df).cumulativeProbability(t), abs=1e-10)
    for f, a, b in ((0.4, 1.0, 7.0), (3.3, 4.0, 200.0), (1.02, 30.0, 59995.0)):
        assert 1 - dist.f_p(f, a, b) == pytest.approx(d.FDistribution(a, b).cumulativeProbability(f), abs=1e-10)


@pytest.fixture(scope="module")
def xy(spark):
    return spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 5.0), (None, 100.0), (7.0, None)], "x double, y double")


def test_correlation_and_line(xy):
    r = linear.corr_test(xy, "x", "y").first()
    assert (r.n, r.df) == (3, 1) and r.r == pytest.approx(0.720576692122892)
    assert r.t == pytest.approx(0.720576692122892 * math.sqrt(1 / (1 - 0.720576692122892**2))) and r.conf_low is None
    assert linear.corr(xy, "x", "y").first().r == pytest.approx(0.720576692122892)
    assert linear.corr(xy, "x", "y", "everything").first().r is None
    with pytest.raises(ValueError):
        linear.corr(xy, "x", "y", "some")
    fit = linear.lm(xy, "y", "x")
    assert fit.slope == pytest.approx(1.5) and fit.intercept == pytest.approx(-1 / 3)
    assert fit.r_squared == pytest.approx(0.519230769230769)
    t = {x.term: x for x in fit.tidy().collect()}
    assert t["x"].p_value == pytest.approx(r.p_value)
    assert fit.glance().first().statistic == pytest.approx(t["x"].statistic ** 2)
    got = [x.fitted for x in linear.lm_fitted(xy, fit).collect()]
    assert got[0] == pytest.approx(1.5 - 1 / 3) and got[3] is None
    assert linear.lm(xy.filter("x = 1"), "y", "x") is None


@pytest.fixture(scope="module")
def classes(spark):
    return spark.createDataFrame([(0, 1.0)] * 3 + [(0, 0.0)] + [(1, 1.0)] + [(1, 0.0)] * 3 + [(None, 1.0), (1, None)], "c int, y double")


def test_anova_and_tukey(classes):
    group, rest = linear.anova_oneway(classes, "y", "c").collect()
    assert (group.df, rest.df, group.sumsq, rest.sumsq) == (1, 6, pytest.approx(0.5), pytest.approx(1.5))
    assert group.statistic == pytest.approx(2.0) and group.p_value == pytest.approx(dist.t_p(math.sqrt(2), 6))
    (t,) = linear.tukey_hsd(classes, "y", "c").collect()
    assert (t.comparison, t.diff) == ("1-0", -0.5) and t.p_adj == pytest.approx(group.p_value, abs=1e-6)
    assert t.conf_low < -0.5 < t.conf_high


def test_factor_model(classes):
    fit = glm.glm_logit(classes, "y", ["c"], ["c"])
    assert fit.terms == ["(Intercept)", "c[1]"]
    assert fit.coefs == pytest.approx([math.log(3), -2 * math.log(3)], abs=1e-7)
    closed = {r.term: r for r in glm.glm_by_class(classes, "y", "c").collect()}
    assert closed["c[1]"].estimate == pytest.approx(-2 * math.log(3)) and closed["c[1]"].std_error == pytest.approx(fit.std_errors[1], abs=1e-6)
    only = classes.filter("y = 1 or c = 0")
    assert {r.term: r.estimate for r in glm.glm_by_class(only, "y", "c").collect()}["c[1]"] is None
    null = glm.glm_logit(classes.dropna(), "y", [])
    assert null.coefs == pytest.approx([0.0]) and null.deviance == pytest.approx(null.null_deviance) and null.n == 8


def irls(x, y):
    b = np.zeros(x.shape[1])
    for _ in range(60):
        m = 1 / (1 + np.exp(-x @ b))
        h = x.T @ (x * (m * (1 - m))[:, None])
        b = b + np.linalg.solve(h, x.T @ (y - m))
    return b, h, m


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    n = 600
    g = rng.integers(0, 6, n)
    x = rng.integers(0, 8, n).astype(float)
    z = rng.normal(size=n)
    eff = np.array([-1.2, -0.4, 0.1, 0.3, 0.9, 1.3])
    y = (rng.random(n) < 1 / (1 + np.exp(-(-0.6 + 0.25 * x + 0.5 * z + eff[g])))).astype(float)
    df = spark.createDataFrame([(f"{2010 + a}-{2011 + a}", float(b), float(c), float(d)) for a, b, c, d in zip(g, x, z, y)], "g string, x double, z double, y double")
    return df.repartition(3).cache(), g, x, z, y


def test_glm_against_numpy(sample, spark):
    df, g, x, z, y = sample
    fit = glm.glm_logit(df.unionByName(df.limit(3).withColumn("x", F.lit(None).cast("double"))), "y", ["x", "z"])
    X = np.column_stack([np.ones_like(x), x, z])
    b, h, m = irls(X, y)
    assert fit.n == 600 and fit.converged
    assert fit.coefs == pytest.approx(b, abs=1e-6)
    assert fit.std_errors == pytest.approx(np.sqrt(np.diag(np.linalg.inv(h))), abs=1e-6)
    dev = -2 * np.sum(y * np.log(m) + (1 - y) * np.log(1 - m))
    assert fit.deviance == pytest.approx(dev) and fit.aic == pytest.approx(dev + 6)
    assert fit.rmse("working") == pytest.approx(math.sqrt(np.mean(((y - m) / (m * (1 - m))) ** 2)))
    assert fit.rmse("deviance") == pytest.approx(math.sqrt(dev / 600))
    quasi = glm.glm_quasi(df, "y", ["x", "z"])
    phi = np.sum((y - m) ** 2 / (m * (1 - m))) / 597
    assert quasi.dispersion == pytest.approx(phi) and quasi.aic is None
    assert quasi.std_errors == pytest.approx(fit.std_errors * math.sqrt(phi), abs=1e-6)
    p = fit.predict(df).agg(F.sum("predicted")).first()[0]
    assert p == pytest.approx(m.sum())


def test_quasi_on_proportions(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=40)
    y = np.clip(1 / (1 + np.exp(-(0.3 + 0.8 * x))) + rng.normal(scale=0.05, size=40), 0, 1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    fit = glm.glm_quasi(df, "y", ["x"])
    b, h, m = irls(np.column_stack([np.ones(40), x]), y)
    phi = np.sum((y - m) ** 2 / (m * (1 - m))) / 38
    assert fit.coefs == pytest.approx(b, abs=1e-6)
    assert fit.std_errors == pytest.approx(np.sqrt(phi * np.diag(np.linalg.inv(h))), abs=1e-6)


def test_aliased_columns_are_reported_missing(sample):
    df = sample[0].withColumn("twice", F.col("x") * 2 + 1)
    fit = glm.glm_logit(df, "y", ["x", "twice", "z"])
    assert fit.aliased == ["twice"] and fit.terms == ["(Intercept)", "x", "z"]
    assert {r.term: r.estimate for r in fit.tidy().collect()}["twice"] is None


def test_separation_is_flagged(spark):
    df = spark.createDataFrame([(float(i), float(i > 5)) for i in range(12)], "x double, y double")
    assert not glm.glm_logit(df, "y", ["x"]).converged


def test_step_aic(sample):
    df = sample[0].withColumn("noise", F.pmod(F.hash("x", "z"), F.lit(7)).cast("double"))
    fit, trace = glm.step_aic(df, "y", ["x", "noise", "g"], ["g"])
    rows = trace.collect()
    assert "x" in fit.design.names and rows[0].term == "<none>"
    chosen = [r for r in rows if r.chosen]
    assert all(b.aic < a.aic for a, b in zip(chosen, chosen[1:])) and fit.aic == pytest.approx(chosen[-1].aic)


def laplace(beta, sigma, X, y, g, k):
    """Objective by direct evaluation, modes by scalar Newton."""
    total, modes = 0.0, []
    for j in range(k):
        Xj, yj, b = X[g == j], y[g == j], 0.0
        for _ in range(100):
            m = 1 / (1 + np.exp(-(Xj @ beta + sigma * b)))
            b += (sigma * np.sum(yj - m) - b) / (1 + sigma**2 * np.sum(m * (1 - m)))
        eta = Xj @ beta + sigma * b
        m = 1 / (1 + np.exp(-eta))
        total += np.sum(yj * eta - np.logaddexp(0, eta)) - b * b / 2 - 0.5 * np.log1p(sigma**2 * np.sum(m * (1 - m)))
        modes.append(sigma * b)
    return total, np.array(modes)


@pytest.fixture(scope="module")
def fitted(sample):
    return mixed.glmm_logit(sample[0], "y", ["x"], "g")


def test_glmm_is_at_the_laplace_optimum(sample, fitted):
    _, g, x, _, y = sample
    X = np.column_stack([np.ones_like(x), x])
    at, modes = laplace(fitted.beta, fitted.sigma, X, y, g, 6)
    assert fitted.converged and not fitted.singular
    assert fitted.loglik == pytest.approx(at, abs=1e-7)
    theta = np.array([*fitted.beta, fitted.sigma])
    f = lambda t: laplace(t[:2], t[2], X, y, g, 6)[0]
    for e in np.eye(3) * 1e-4:
        assert abs(f(theta + e) - f(theta - e)) / 2e-4 < 2e-3
        assert f(theta + 50 * e) < at and f(theta - 50 * e) < at
    h = np.array([[(f(theta + a + b) - f(theta + a - b) - f(theta - a + b) + f(theta - a - b)) / 4e-6 for a in np.eye(3) * 1e-3] for b in np.eye(3) * 1e-3])
    assert np.sqrt(np.diag(fitted.vcov)) == pytest.approx(np.sqrt(np.diag(np.linalg.inv(-h)))[:2], rel=1e-3)
    got = {r.g: r for r in fitted.ranef().collect()}
    assert [got[f"{2010 + j}-{2011 + j}"].condval for j in range(6)] == pytest.approx(modes, abs=1e-6)
    assert fitted.aic == pytest.approx(-2 * at + 6) and fitted.bic == pytest.approx(-2 * at + 3 * math.log(600))


def test_laplace_is_near_the_integral(sample, fitted):
    """Brute-force integration over the group effect gives nearly the same likelihood."""
    _, g, x, _, y = sample
    u, w = np.polynomial.hermite_e.hermegauss(60)
    X = np.column_stack([np.ones_like(x), x])
    total = 0.0
    for j in range(6):
        eta = (X[g == j] @ fitted.beta)[:, None] + fitted.sigma * u[None, :]
        ll = np.sum(y[g == j][:, None] * eta - np.logaddexp(0, eta), axis=0)
        total += ll.max() + math.log(np.sum(w * np.exp(ll - ll.max())) / math.sqrt(2 * math.pi))
    assert fitted.loglik == pytest.approx(total, abs=0.05)


def test_glmm_tables(fitted, sample):
    tidy = fitted.tidy().collect()
    assert [r.term for r in tidy] == ["(Intercept)", "x", "sd__(Intercept)"]
    one = fitted.glance().first()
    assert one.n == 600 and one.df_residual == 597 and one.deviance > 0
    assert fitted.rmse("deviance") == pytest.approx(math.sqrt(one.deviance / 600))
    shifted = {r.g: r["(Intercept)"] for r in fitted.coef().collect()}
    assert sum(shifted.values()) / 6 == pytest.approx(fitted.beta[0], abs=0.3)


def test_glmm_with_many_groups_is_salted(sample, fitted, monkeypatch):
    monkeypatch.setattr(mixed, "BROADCAST_ROWS", 1)
    again = mixed.glmm_logit(sample[0], "y", ["x"], "g")
    assert again.beta == pytest.approx(fitted.beta, abs=1e-7) and again.loglik == pytest.approx(fitted.loglik, abs=1e-8)


def test_glmm_without_spread_is_singular(spark):
    rows = [(str(i % 4), float(v), float(k < 2 + v)) for i in range(8) for v in (0, 1, 2) for k in range(6)]
    fit = mixed.glmm_logit(spark.createDataFrame(rows, "g string, x double, y double"), "y", ["x"], "g")
    assert fit.singular and fit.sigma == 0.0
    assert [r.condval for r in fit.ranef().collect()] == [0.0] * 4
    plain = glm.glm_logit(spark.createDataFrame(rows, "g string, x double, y double"), "y", ["x"])
    assert fit.beta == pytest.approx(plain.coefs, abs=1e-5) and fit.loglik == pytest.approx(plain.loglik, abs=1e-6)


def test_effects_beside_climate(spark, fitted):
    climate = spark.createDataFrame([(y, float(y % 4)) for y in range(2011, 2017)], "WINTER int, snow double")
    r = mixed.ranef_vs_climate(fitted, climate, ["snow"]).first()
    both = mixed.ranef_with_climate(fitted, climate).collect()
    assert len(both) == 6 and r.n == 6
    assert r.r == pytest.approx(np.corrcoef([b.snow for b in both], [b.condval for b in both])[0, 1])


def test_curve_against_numpy(sample):
    df, _, x, _, y = sample
    fit = curve.fit_logistic_curve(df, "x", "y", start=(2.0, 1.0))
    f = lambda a, b: np.sum((y - 1 / (1 + np.exp(b * (x - a)))) ** 2)
    best = f(fit.a, fit.b)
    assert fit.converged and fit.rss == pytest.approx(best)
    for da, db in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3)):
        assert f(fit.a + da, fit.b + db) >= best
    pred = 1 / (1 + np.exp(fit.b * (x - fit.a)))
    assert fit.goodness(df).first().r == pytest.approx(np.corrcoef(y, pred)[0, 1])
    assert [r.term for r in fit.tidy().collect()] == ["a", "b"] and fit.glance().first().n == 600


def test_model_grid(sample):
    df = sample[0].withColumn("z", F.when(F.col("z") < 1.5, F.col("z")))
    specs = [compare.ModelSpec("a", ["x"]), compare.ModelSpec("b", ["x", "z"]), compare.ModelSpec("c", ["x"], "quasi"), compare.ModelSpec("d", ["x"], "glmm", "g")]
    same = {r.model: r for r in compare.compare_models(df, "y", specs).collect()}
    assert len({r.n for r in same.values()}) == 1 and same["c"].aic is None and same["d"].aic < same["a"].aic
    own = {r.model: r for r in compare.compare_models(df, "y", specs[:2], common_frame=False).collect()}
    assert own["a"].n == 600 > own["b"].n


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 5.0), (math.nan, 100.0), (7.0, None)], "x double, y double")
    (r,) = linear.corr_tests(df, [("x", "y")]).collect()
    assert r.n == 3 and r.r == pytest.approx(0.720576692122892) and r.p_value > 0.1
    assert linear.corr(df, "x", "y").first()[0] == pytest.approx(0.720576692122892)
    assert linear.corr(df, "x", "y", use="everything").first()[0] is None
    assert linear.lm(df, "y", "x").slope == pytest.approx(1.5)
    (c,) = linear.corr_tests(spark.createDataFrame([(1.0, 2.0)] * 4, "x double, y double"), [("x", "y")]).collect()
    assert c.r is None and c.p_value is None


def test_empty_and_even_classes(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "g string, y double")
    assert [r.statistic for r in linear.anova_oneway(df.limit(0), "y", "g").collect()] == [None, None]
    assert linear.tukey_hsd(df.limit(0), "y", "g").collect() == []
    assert [(r.diff, r.p_adj) for r in linear.tukey_hsd(df, "y", "g").collect()] == [(1.0, None)]


def test_anova_of_many_classes(spark):
    df = spark.range(6000).selectExpr("id % 2000 AS g", "cast(id % 7 AS double) AS y")
    group, rest = linear.anova_oneway(df, "y", "g").collect()
    assert (group.df, rest.df) == (1999, 4000)


def test_number_levels_in_number_order(spark):
    from cohortis.stats.glm import in_order

    assert in_order(["10", "9", "2.5"]) == ["2.5", "9", "10"] and in_order(["b", "10", "a"]) == ["10", "a", "b"]


def test_mixed_model_refuses_infinite_values(spark):
    from cohortis.stats.mixed import glmm_logit

    df = spark.createDataFrame([(float(i % 2), math.inf if i == 3 else float(i), str(i % 3)) for i in range(30)], "y double, x double, g string")
    with pytest.raises(ValueError):
        glmm_logit(df, "y", ["x"], "g")


def test_absorbed_factor_equals_expanded_one(spark, sample):
    df = sample[0]
    for family in ("binomial", "quasibinomial"):
        wide = glm.glm_logit(df, "y", ["x", "g"], ["g"], family, absorb="g")
        narrow = glm.glm_logit(df, "y", ["x", "g"], ["g"], family)
        a, b = ({r.term: r for r in f.tidy().collect()} for f in (wide, narrow))
        assert a.keys() == b.keys()
        for term in a:
            assert tuple(a[term])[1:] == pytest.approx(tuple(b[term])[1:], rel=1e-6, abs=1e-8)
        ours, theirs = ([v for v in f.glance().first()[1:] if v is not None] for f in (wide, narrow))
        assert ours == pytest.approx(theirs, rel=1e-9)
        assert wide.rmse("working") == pytest.approx(narrow.rmse("working"))
    p, q = (sorted(r.predicted for r in f.predict(df).collect()) for f in (wide, narrow))
    assert p == pytest.approx(q, abs=1e-8)
    constant = df.withColumn("of_level", F.hash("g").cast("double"))
    fit = glm.glm_logit(constant, "y", ["x", "of_level", "g"], ["g"], absorb="g")
    assert fit.aliased == ["of_level"] and fit.terms == ["x"]


def test_factor_of_very_many_levels(spark):
    """More levels than a design has room for are absorbed without being named; none of them is collected."""
    n = 20_000
    df = spark.range(20 * n).selectExpr(f"id % {n} AS level", "pmod(hash(id), 1000) / 1000D AS x", "pmod(xxhash64(id), 97) AS u")
    df = df.selectExpr("level", "x", "CAST(u / 97D < 1 / (1 + exp(0.5 - x)) AS DOUBLE) AS y")
    fit = glm.glm_logit(df, "y", ["x", "level"], ["level"])
    assert fit.n_levels == n and fit.n == 20 * n and fit.tidy().count() == n + 1
    # Score equations: within every level, and for x.
    left = fit.predict(df).groupBy("level").agg(F.sum(F.expr("y - predicted")).alias("r"), F.sum(F.expr("x * (y - predicted)")).alias("rx"), F.avg("y").alias("m"))
    worst = left.where("m > 0 AND m < 1").agg(F.max(F.abs("r"))).first()[0]
    assert worst < 1e-5 and abs(left.agg(F.sum("rx")).first()[0]) < 1e-3
    with pytest.raises(ValueError, match="levels"):
        glm.glm_logit(df.withColumn("other", F.col("level") + 1), "y", ["level", "other"], ["level", "other"])


def test_jobs_do_not_grow_with_models(spark, sample):
    df = sample[0].withColumns({f"n{k}": F.pmod(F.hash("x", F.lit(k)), F.lit(5)).cast("double") for k in range(5)})
    tracker = spark.sparkContext.statusTracker()

    def jobs(group, run):
        spark.sparkContext.setJobGroup(group, group)
        out = run()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return out, len(tracker.getJobIdsForGroup(group))

    cells = glm.to_cells(df, "y", ["x", *[f"n{k}" for k in range(5)]]).persist()
    cells.count()
    one, alone = jobs("one", lambda: glm.fit_many(cells, "y", [(["x", "n0"], "binomial")]))
    terms = [["x", f"n{k}"] for k in range(5)] + [["x"], []]
    many, together = jobs("many", lambda: glm.fit_many(cells, "y", [(t, "binomial") for t in terms]))
    assert together <= alone + 4
    assert many[0].coefs == pytest.approx(one[0].coefs, abs=1e-9)
    for t, fit in zip(terms, many):
        assert fit.coefs == pytest.approx(glm.fit_cells(cells, "y", t).coefs, abs=1e-8)


def test_models_on_their_own_rows(spark, sample):
    df = sample[0].withColumn("gap", F.when(F.pmod(F.hash("x", "y"), F.lit(3)) > 0, F.col("x")))
    from cohortis.stats.compare import ModelSpec, compare_models

    specs = [ModelSpec("all", ["x"]), ModelSpec("some", ["gap"])]
    got = {r.model: r for r in compare_models(df, "y", specs, common_frame=False).collect()}
    assert got["some"].n < got["all"].n
    for name, terms in (("all", ["x"]), ("some", ["gap"])):
        fit = glm.glm_logit(df, "y", terms)
        assert (got[name].n, got[name].aic) == (fit.n, pytest.approx(fit.aic, abs=1e-8))


def test_tails_as_columns(spark):
    from cohortis.stats.tails import tail_column

    rows = spark.createDataFrame([(v,) for v in (0.0, 1e-9, 0.3, -1.96, 4.0, 9.5, 30.0, None, float("nan"))], "z double")
    for fn in (dist.normal_p, lambda t: dist.t_p(t, 3), lambda t: dist.t_p(t, 400)):
        for z, p in rows.select("z", tail_column(fn, F.col("z"))).collect():
            assert (p is None) if z is None or math.isnan(z) else p == pytest.approx(fn(z), rel=1e-8)
    for z, p in rows.where("z >= 0").select("z", tail_column(lambda q: 1 - dist.tukey_cdf(q, 6, 40), F.col("z"), False, 1e-12, 24)).collect():
        assert math.isnan(z) or p == pytest.approx(1 - dist.tukey_cdf(z, 6, 40), abs=1e-9)


def test_tukey_of_many_classes(spark):
    df = spark.range(6000).selectExpr("id % 1500 AS c", "CAST(pmod(hash(id), 1000) AS DOUBLE) AS y")
    out = linear.tukey_hsd(df, "y", "c")
    assert out.count() == 1500 * 1499 // 2 == out.select("comparison").distinct().count()
    means = {r.c: (r.m, r.n) for r in df.groupBy("c").agg(F.avg("y").alias("m"), F.count("y").alias("n")).collect()}
    for r in out.limit(50).collect():
        b, a = map(int, r.comparison.split("-"))
        assert r.diff == pytest.approx(means[b][0] - means[a][0]) and r.conf_low < r.diff < r.conf_high and 0 <= r.p_adj <= 1


def test_confidence_band(spark):
    xy = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 5.0), (4.0, 4.0)], "x double, y double")
    fit = linear.lm(xy, "y", "x")
    rows = linear.lm_fitted(xy, fit).collect()
    reach = 4.302652729911275  # t with 2 degrees of freedom, 97.5 %
    for r in rows:
        se = fit.sigma * math.sqrt(1 / 4 + (r.x - 2.5) ** 2 / 5)
        assert (r.std_error, r.conf_low, r.conf_high) == pytest.approx((se, r.fitted - reach * se, r.fitted + reach * se))


def test_glmm_derivatives_are_those_of_the_objective(sample):
    cells = glm.to_cells(sample[0], "y", ["x", "z"], "g").selectExpr("y", "w", "g", "x AS x0", "z AS x1").persist()
    lap, theta, h = mixed._Laplace(cells, "g", 2), np.array([0.2, 0.5, -0.1, 0.8]), 1e-4
    _, grad, hess, _ = lap.evaluate(theta, 4)
    for j, step in enumerate(np.eye(4) * h):
        up, down = lap.evaluate(theta + step, 4), lap.evaluate(theta - step, 4)
        assert grad[j] == pytest.approx((up[0] - down[0]) / (2 * h), abs=1e-5)
        assert hess[j] == pytest.approx((up[1] - down[1]) / (2 * h), abs=1e-4)
    lap.close()
    cells.unpersist()
