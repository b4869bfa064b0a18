"""Correlation, regression, logistic, mixed and curve models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.season import season_year
from ...operators import aggregate as agg
from ...operators.panel import age_from_start
from ...stats import curve, glm, linear, mixed
from ...stats.compare import ModelSpec, compare_models
from ..climate import intervals_with_climate
from ..order_panel import interval_records
from . import query, rounded
from .aggregates import RETURNED_SQL, SEASON_SQL, returned, seasons
from .panel import GRID

# -- SQL pieces: tail probabilities by Simpson's rule, Newton steps by recursion --


def _simpson(density: str, upper: str, n: int = 2000) -> str:
    """Integral of ``density`` (in x) from 0 to ``upper``, inside a query that has the named columns."""
    return (
        f"(SELECT sum(CASE WHEN i IN (0, {n}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * ({density})) * max(u) / {n} / 3 "
        f"FROM (SELECT i, u, u * i / {n} AS x FROM (SELECT range AS i, ({upper})::DOUBLE AS u FROM range({n + 1}))))"
    )


def _t_p(t: str, df: str) -> str:
    pdf = f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi()) * power(1 + x * x / {df}, -({df} + 1) / 2.0)"
    return f"round(greatest(0, 1 - 2 * {_simpson(pdf, f'least(abs({t}), 60)')}), 6)"


def _normal_p(z: str) -> str:
    return f"round(greatest(0, 1 - 2 * {_simpson('exp(-x * x / 2) / sqrt(2 * pi())', f'least(abs({z}), 40)')}), 6)"


def _f_p(f: str, d1: str, d2: str) -> str:
    log_beta = f"lgamma({d1} / 2.0) + lgamma({d2} / 2.0) - lgamma(({d1} + {d2}) / 2.0)"
    pdf = f"CASE WHEN x = 0 AND {d1} > 2 THEN 0 ELSE exp(({d1} / 2.0 - 1) * ln(greatest(x, 1e-300)) + ({d2} / 2.0 - 1) * ln(1 - x) - ({log_beta})) END"
    return f"round(greatest(0, 1 - {_simpson(pdf, f'{d1} * {f} / ({d1} * {f} + {d2})', 20000)}), 6)"


def _newton_logit(cells: str) -> str:
    """CTEs ``it`` (iterations) and ``fit`` for logit(y) ~ x on ``cells(x, n, k)``: estimates and the information matrix."""
    return f"""it AS (SELECT 0 AS i, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 UNION ALL
      SELECT i + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
      FROM (SELECT i, any_value(b0) AS b0, any_value(b1) AS b1, sum(n * m * (1 - m)) AS h00, sum(n * m * (1 - m) * x) AS h01,
              sum(n * m * (1 - m) * x * x) AS h11, sum(k - n * m) AS g0, sum((k - n * m) * x) AS g1
            FROM (SELECT i, b0, b1, x, n, k, 1 / (1 + exp(-(b0 + b1 * x))) AS m FROM it, {cells} WHERE i < 25) GROUP BY i)),
    best AS (SELECT b0, b1 FROM it ORDER BY i DESC LIMIT 1),
    obs AS (SELECT b0, b1, x, n, k, 1 / (1 + exp(-(b0 + b1 * x))) AS m FROM best, {cells}),
    fit AS (SELECT any_value(b0) AS b0, any_value(b1) AS b1, sum(n * m * (1 - m)) AS h00, sum(n * m * (1 - m) * x) AS h01,
      sum(n * m * (1 - m) * x * x) AS h11, sum(n) AS n FROM obs),
    tidy AS (SELECT '(Intercept)' AS term, b0 AS estimate, sqrt(h11 / (h00 * h11 - h01 * h01)) AS se, n FROM fit UNION ALL
      SELECT 'x', b1, sqrt(h00 / (h00 * h11 - h01 * h01)), n FROM fit)"""


_RETURNED_R = RETURNED_SQL.replace("WITH", "WITH RECURSIVE", 1)
_GRID_R = GRID.replace("WITH", "WITH RECURSIVE", 1)
_AGED_SQL = """, aged AS (SELECT *, (start_int - coalesce(birth, min(start_int) OVER (PARTITION BY id)) + 1)::DOUBLE AS age FROM iv)
"""


def aged_intervals(t):
    """Interval records with the age at their start."""
    age = age_from_start(F.col("BirthYear"), F.col("start_int"), F.col("first_start")).cast("double")
    return interval_records(t.orders, []).withColumn("yearsAlive", age)


# -- correlation and regression ----------------------------------------------

_PAIRS = (("y", "discount"), ("quantity", "tax"), ("known", "quantity"), ("class", "open"))


@query(
    RETURNED_SQL + ", v AS (SELECT *, NULLIF(discount, 0) AS known FROM r), c AS ("
    + " UNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, regr_count({y}, {x})::BIGINT AS n, corr({x}, {y}) AS r FROM v" for x, y in _PAIRS
    )
    + f"""), d AS (SELECT *, n - 2 AS df, r * sqrt((n - 2) / (1 - r * r)) AS t, 1.959963984540054::DOUBLE / sqrt(n - 3) AS h FROM c)
    SELECT x, y, n, round(r, 6) AS r, round(t, 6) AS t, df, {_t_p('t', 'df')} AS p_value,
    round(tanh(atanh(r) - h), 6) AS conf_low, round(tanh(atanh(r) + h), 6) AS conf_high FROM d"""
)
def corr_tests(t):
    rows = returned(t).withColumn("known", F.nullif(F.col("discount"), F.lit(0.0)))
    return rounded(linear.corr_tests(rows, list(_PAIRS)))


@query(
    """SELECT round(corr(o_totalprice, substr(o_orderpriority, 1, 1)::DOUBLE), 6) AS r,
    round(corr(CASE WHEN o_totalprice > 2000 THEN o_totalprice END, substr(o_orderpriority, 1, 1)::DOUBLE), 6) AS r_known,
    CAST(NULL AS DOUBLE) AS r_poisoned FROM orders"""
)
def correlation(t):
    o = t.orders.select(
        F.col("o_totalprice").alias("x"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("y"),
        F.when(F.col("o_totalprice") > 2000, F.col("o_totalprice")).alias("known"),
    )
    full = linear.corr(o, "x", "y", use="everything")
    pair = linear.corr(o, "known", "y", name="r_known")
    poisoned = linear.corr(o, "known", "y", use="everything", name="r_poisoned")
    return rounded(full.select("r", pair.scalar().alias("r_known"), poisoned.scalar().alias("r_poisoned")))


_LM = """, pts AS (SELECT 'meanprice' AS response, "WINTER"::DOUBLE AS x, meanprice AS y FROM s UNION ALL
  SELECT 'highdays', "WINTER", highdays FROM s),
q AS (SELECT response, regr_count(y, x)::DOUBLE AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx,
  regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, regr_avgx(y, x) AS mx FROM pts GROUP BY 1),
q2 AS (SELECT *, (syy - b * sxy) AS rss, n - 2 AS df FROM q), q3 AS (SELECT *, sqrt(rss / df) AS sigma FROM q2),
td AS (SELECT response, '(Intercept)' AS term, a AS estimate, sigma * sqrt(1 / n + mx * mx / sxx) AS se, df FROM q3 UNION ALL
  SELECT response, 'WINTER', b, sigma / sqrt(sxx), df FROM q3)
"""
_LM_PAIRS = [("meanprice", "WINTER"), ("highdays", "WINTER")]


@query(
    SEASON_SQL + _LM + f"""SELECT response, term, round(estimate, 4) AS estimate, round(se, 4) AS std_error, round(estimate / se, 6) AS statistic,
    {_t_p('(estimate / se)', 'df')} AS p_value FROM td"""
)
def lm_simple(t):
    first, second = linear.lms(seasons(t), _LM_PAIRS)
    out = rounded(first.tidy().unionByName(second.tidy()))
    # Intercepts extrapolate to year 0, which leaves fewer reliable digits.
    return out.withColumns({c: F.round(c, 4) for c in ("estimate", "std_error")})


@query(
    SEASON_SQL + _LM + f"""SELECT response, 'WINTER' AS term, round(1 - rss / syy, 6) AS r_squared, round(1 - (rss / syy) * (n - 1) / df, 6) AS adj_r_squared,
    round(sigma, 6) AS sigma, round(b * sxy / (rss / df), 6) AS statistic,
    {_t_p('(b / (sigma / sqrt(sxx)))', 'df')} AS p_value, df::BIGINT AS df_residual, n::BIGINT AS n FROM q3"""
)
def lm_glance(t):
    first, second = linear.lms(seasons(t), _LM_PAIRS)
    return rounded(first.glance().unionByName(second.glance()))


# The limits of t with many degrees of freedom, from those of the normal distribution.
_T_975 = "(z + (z ** 3 + z) / (4 * df) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * df ** 2) + (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / (384 * df ** 3))"


@query(
    f"""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a,
      regr_count(l_extendedprice, l_quantity)::DOUBLE AS n, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy,
      regr_sxy(l_extendedprice, l_quantity) AS sxy, regr_avgx(l_extendedprice, l_quantity) AS mx FROM lineitem),
    g AS (SELECT *, n - 2 AS df, sqrt((syy - b * sxy) / (n - 2)) AS sigma, 1.959963984540054::DOUBLE AS z FROM f),
    q AS (SELECT l_orderkey, l_quantity, a + b * l_quantity AS fitted, sigma * sqrt(1 / n + (l_quantity - mx) * (l_quantity - mx) / sxx) AS se, {_T_975} AS reach FROM lineitem, g)
    SELECT l_orderkey, l_quantity, round(fitted, 6) AS fitted, round(se, 4) AS std_error, round(fitted - reach * se, 3) AS conf_low, round(fitted + reach * se, 3) AS conf_high FROM q"""
)
def lm_fitted(t):
    fit = linear.lm(t.lineitem, "l_extendedprice", "l_quantity")
    out = linear.lm_fitted(t.lineitem.select("l_orderkey", "l_quantity"), fit)
    return out.withColumns({c: F.round(c, d) for c, d in (("fitted", 6), ("std_error", 4), ("conf_low", 3), ("conf_high", 3))})


# -- classes -------------------------------------------------------------------

_CLASSES = """, c AS (SELECT class, count(*)::DOUBLE AS n, avg(y) AS m, var_samp(y) AS v FROM r GROUP BY 1),
a AS (SELECT (SELECT avg(y) FROM r) AS g, count(*) - 1 AS df1, sum(n) - count(*) AS df2, sum((n - 1) * v) AS ssw FROM c),
b AS (SELECT df1, df2, ssw, (SELECT sum(n * power(m - g, 2)) FROM c) AS ssb FROM a)
"""


@query(
    RETURNED_SQL + _CLASSES + f"""SELECT 'class' AS term, df1::BIGINT AS df, round(ssb, 6) AS sumsq, round(ssb / df1, 6) AS meansq,
    round((ssb / df1) / (ssw / df2), 6) AS statistic, {_f_p('((ssb / df1) / (ssw / df2))', 'df1', 'df2')} AS p_value FROM b UNION ALL
    SELECT 'Residuals', df2::BIGINT, round(ssw, 6), round(ssw / df2, 6), NULL, NULL FROM b"""
)
def anova_oneway(t):
    return rounded(linear.anova_oneway(returned(t), "y", "class"))


@query(
    RETURNED_SQL + _CLASSES + """SELECT y.class || '-' || x.class AS comparison, round(y.m - x.m, 6) AS diff,
    round(abs(y.m - x.m) / sqrt(ssw / df2 / 2 * (1 / x.n + 1 / y.n)), 6) AS statistic
    FROM c x JOIN c y ON x.class < y.class CROSS JOIN b"""
)
def tukey_differences(t):
    return rounded(linear.tukey_hsd(returned(t), "y", "class").select("comparison", "diff", "statistic"))


# Studentised range: the range of k normals, averaged over the scale (one node where the residual
# degrees of freedom are beyond 25000). Both normal distribution functions are summed along the grid and
# corrected at the end point; the 95 % point is read off between grid values.
_RANGE_P = """, cmp AS (SELECT y.class || '-' || x.class AS comparison, y.m - x.m AS diff, sqrt(ssw / df2 / 2 * (1 / x.n + 1 / y.n)) AS scale
    FROM c x JOIN c y ON x.class < y.class CROSS JOIN b),
  qs AS (SELECT comparison AS id, abs(diff) / scale AS q FROM cmp UNION ALL SELECT 'grid', 3.855::DOUBLE + 0.001::DOUBLE * range FROM range(41)),
  sn AS (SELECT CASE WHEN df2 > 25000 THEN 1.0::DOUBLE ELSE 1 + (range - 30) / 30.0::DOUBLE * 8 / sqrt(2 * df2) END AS sc, range AS i, df2::DOUBLE AS df2 FROM b, range(61)),
  sw AS (SELECT sc, CASE WHEN df2 > 25000 THEN CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0 END ELSE
    CASE WHEN i IN (0, 60) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * 8 / 30.0::DOUBLE / sqrt(2 * df2) / 3
    * exp(ln(2) + df2 / 2 * ln(df2 / 2) - lgamma(df2 / 2) + (df2 - 1) * ln(sc) - df2 * sc * sc / 2) END AS sw FROM sn),
  z AS (SELECT id, q, sc, sw, q * sc AS w, -9 + 0.02::DOUBLE * range AS z FROM qs, sw, range(901) WHERE sw > 0),
  f AS (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) AS f1, exp(-(z - w) * (z - w) / 2) / sqrt(2 * pi()) AS f2 FROM z),
  cdf AS (SELECT *, 0.02::DOUBLE * (sum(f1) OVER v - f1 / 2) + 0.0004::DOUBLE / 12 * z * f1 AS c1,
    0.02::DOUBLE * (sum(f2) OVER v - f2 / 2) + 0.0004::DOUBLE / 12 * (z - w) * f2 AS c2 FROM f WINDOW v AS (PARTITION BY id, q, sc ORDER BY z)),
  pq AS (SELECT id, q, (SELECT count(*) FROM c) * sum(sw * 0.02::DOUBLE * f1 * power(c1 - c2, (SELECT count(*) FROM c) - 1)) AS p FROM cdf GROUP BY 1, 2),
  steps AS (SELECT q, p, lead(q) OVER (ORDER BY q) AS q2, lead(p) OVER (ORDER BY q) AS p2 FROM pq WHERE id = 'grid'),
  crit AS (SELECT q + (0.95 - p) / (p2 - p) * (q2 - q) AS crit FROM steps WHERE p <= 0.95 AND p2 > 0.95)
"""


@query(
    RETURNED_SQL + _CLASSES + _RANGE_P + """SELECT comparison, round(diff, 6) AS diff, round(q, 6) AS statistic,
    round(diff - crit * scale, 6) AS conf_low, round(diff + crit * scale, 6) AS conf_high,
    round(greatest(1 - p, 0), 6) AS p_adj FROM cmp JOIN pq ON id = comparison CROSS JOIN crit"""
)
def tukey_hsd(t):
    """With simultaneous limits and adjusted p-values from the studentised range."""
    return rounded(linear.tukey_hsd(returned(t), "y", "class"))


# -- logistic models -------------------------------------------------------------

_BY_CLASS = """, c AS (SELECT class, sum(y) AS k, count(*)::DOUBLE AS n FROM r GROUP BY 1),
  z AS (SELECT c.class, c0.class = c.class AS base, ln(c.k / (c.n - c.k)) AS l, 1 / c.k + 1 / (c.n - c.k) AS v,
    ln(c0.k / (c0.n - c0.k)) AS l0, 1 / c0.k + 1 / (c0.n - c0.k) AS v0
    FROM c, (SELECT * FROM c ORDER BY class LIMIT 1) c0),
  e AS (SELECT CASE WHEN base THEN '(Intercept)' ELSE 'class[' || class || ']' END AS term, CASE WHEN base THEN l ELSE l - l0 END AS estimate,
    sqrt(CASE WHEN base THEN v ELSE v + v0 END) AS se FROM z)
"""


@query(
    RETURNED_SQL + _BY_CLASS + f"""SELECT term, round(estimate, 6) AS estimate, round(se, 6) AS std_error, round(estimate / se, 6) AS statistic,
    {_normal_p('(estimate / se)')} AS p_value FROM e"""
)
def glm_factor(t):
    return rounded(glm.glm_logit(returned(t), "y", ["class"], ["class"]).tidy())


def _absorbed_sql(steps: int = 9) -> str:
    """Newton steps, one after another: level effects as a table, the slope on discount by its Schur complement."""
    out = """, cl AS MATERIALIZED (SELECT supplier AS l, discount AS x, sum(y) AS k, count(*)::DOUBLE AS n FROM s GROUP BY 1, 2),
  a0 AS MATERIALIZED (SELECT l, ln(sum(k) / (sum(n) - sum(k))) AS al, 0.0::DOUBLE AS b FROM cl GROUP BY 1)"""
    for i in range(steps):
        out += f""",
  s{i} AS MATERIALIZED (SELECT l, any_value(al) AS al, any_value(b) AS b, sum(n * m * (1 - m)) AS a, sum(k - n * m) AS g, sum(n * m * (1 - m) * x) AS bx, sum((k - n * m) * x) AS h,
    sum(n * m * (1 - m) * x * x) AS c FROM (SELECT *, 1 / (1 + exp(-(al + b * x))) AS m FROM cl JOIN a{i} USING (l)) GROUP BY l),
  d{i} AS MATERIALIZED (SELECT sum(h - bx * g / a) / sum(c - bx * bx / a) AS db, sum(c - bx * bx / a) AS schur FROM s{i}),
  a{i + 1} AS MATERIALIZED (SELECT l, al + (g - bx * db) / a AS al, b + db AS b FROM s{i}, d{i})"""
    last = steps - 1
    return out + f""",
  z AS (SELECT s{last}.*, schur FROM s{last}, d{last}), z0 AS (SELECT al AS al0, a AS aa0, bx / a AS q0 FROM z ORDER BY l LIMIT 1),
  e AS (SELECT CASE WHEN al = al0 AND a = aa0 THEN '(Intercept)' ELSE 'supplier[' || l || ']' END AS term, CASE WHEN al = al0 AND a = aa0 THEN al ELSE al - al0 END AS estimate,
    sqrt(CASE WHEN al = al0 AND a = aa0 THEN 1 / a + q0 * q0 / schur ELSE 1 / a + 1 / aa0 + power(bx / a - q0, 2) / schur END) AS se FROM z, z0
    UNION ALL SELECT 'discount', any_value(b), sqrt(1 / any_value(schur)) FROM z)
"""


_SUPPLIED_SQL = """WITH s AS (SELECT l_suppkey AS supplier, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, l_discount AS discount FROM lineitem)
"""


@query(
    _SUPPLIED_SQL + _absorbed_sql() + """SELECT term, round(estimate, 6) AS estimate, round(se, 6) AS std_error, round(estimate / se, 5) AS statistic FROM e"""
)
def glm_many_levels(t):
    """A factor with a level per supplier, absorbed: its levels are fitted and reported in their own table."""
    rows = t.lineitem.select(
        F.col("l_suppkey").alias("supplier"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"), F.col("l_discount").alias("discount")
    )
    fit = glm.glm_logit(rows, "y", ["discount", "supplier"], ["supplier"], absorb="supplier")
    digits = {"estimate": 6, "std_error": 6, "statistic": 5}
    return fit.tidy().select("term", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query(RETURNED_SQL + _BY_CLASS + "SELECT term, round(estimate, 6) AS estimate, round(se, 6) AS std_error FROM e")
def glm_by_class(t):
    return rounded(glm.glm_by_class(returned(t), "y", "class"))


@query(
    RETURNED_SQL + """, m AS (SELECT avg(y) AS p, count(*)::DOUBLE AS n FROM r)
    SELECT '(Intercept)' AS term, round(ln(p / (1 - p)), 6) AS estimate, round(sqrt(1 / (n * p * (1 - p))), 6) AS std_error,
    round(ln(p / (1 - p)) / sqrt(1 / (n * p * (1 - p))), 5) AS statistic, 0.0::DOUBLE AS p_value FROM m"""
)
def glm_intercept(t):
    return rounded(glm.glm_logit(returned(t), "y", []).tidy()).withColumn("statistic", F.round("statistic", 5))


_AGE_CELLS = _AGED_SQL + ", cells AS (SELECT age AS x, count(*)::DOUBLE AS n, sum(survival) AS k FROM aged GROUP BY 1), "


@query(
    _GRID_R + _AGE_CELLS + _newton_logit("cells") + f"""SELECT CASE term WHEN 'x' THEN 'yearsAlive' ELSE term END AS term, round(estimate, 6) AS estimate,
    round(se, 6) AS std_error, round(estimate / se, 5) AS statistic, {_normal_p('(estimate / se)')} AS p_value FROM tidy"""
)
def glm_logit(t):
    tidy = rounded(glm.glm_logit(aged_intervals(t), "survival", ["yearsAlive"]).tidy())
    return tidy.withColumn("statistic", F.round("statistic", 5))


_DEVIANCE = """, dev AS (SELECT sum(-2 * (k * ln(m) + (n - k) * ln(1 - m))) AS d, sum(k * power(1 - m, 2) / (m * (1 - m)) + (n - k) * m * m / (m * (1 - m))) AS pearson,
  sum(k / (m * m) + (n - k) / power(1 - m, 2)) AS working, sum(n) AS n, sum(k) AS k FROM obs)
"""


@query(
    _GRID_R + _AGE_CELLS + _newton_logit("cells") + _DEVIANCE + """SELECT 'binomial' AS family,
    round(-2 * (k * ln(k / n) + (n - k) * ln(1 - k / n)), 6) AS null_deviance, (n - 1)::BIGINT AS df_null, round(d, 6) AS deviance,
    (n - 2)::BIGINT AS df_residual, 1.0::DOUBLE AS dispersion, round(d + 4, 6) AS aic, round(-d / 2, 6) AS loglik, n::BIGINT AS n, true AS converged FROM dev"""
)
def glm_glance(t):
    return rounded(glm.glm_logit(aged_intervals(t), "survival", ["yearsAlive"]).glance())


@query(
    _GRID_R + _AGE_CELLS + _newton_logit("cells") + _DEVIANCE + """SELECT 'deviance' AS kind, round(sqrt(d / n), 6) AS rmse FROM dev UNION ALL
    SELECT 'working', round(sqrt(working / n), 6) FROM dev UNION ALL SELECT 'pearson', round(sqrt(pearson / n), 6) FROM dev"""
)
def glm_rmse(t):
    fit = glm.glm_logit(aged_intervals(t), "survival", ["yearsAlive"])
    kinds = [(k, fit.rmse(k)) for k in ("deviance", "working", "pearson")]
    return rounded(fit._spark.createDataFrame(kinds, "kind string, rmse double"))


_PLOT_SQL = """, cells AS (SELECT avg(quantity) AS x, 1.0::DOUBLE AS n, avg(y) AS k FROM (SELECT *, l_suppkey FROM
  (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, l_quantity AS quantity, l_suppkey FROM lineitem)) GROUP BY l_suppkey),
"""


@query(
    _RETURNED_R + _PLOT_SQL + _newton_logit("cells") + f""", phi AS (SELECT sum(power(k - m, 2) / (m * (1 - m))) / (sum(n) - 2) AS phi FROM obs),
    t2 AS (SELECT term, estimate, se * sqrt(phi) AS se, n - 2 AS df FROM tidy, phi)
    SELECT CASE term WHEN 'x' THEN 'mean_quantity' ELSE term END AS term, round(estimate, 6) AS estimate, round(se, 6) AS std_error,
    round(estimate / se, 5) AS statistic, {_t_p('(estimate / se)', 'df')} AS p_value FROM t2"""
)
def glm_quasi(t):
    li = t.lineitem.select("l_suppkey", "l_quantity", F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"))
    plots = agg.mean_by(li, ["l_suppkey"], {"rate": "y", "mean_quantity": "l_quantity"})
    tidy = rounded(glm.glm_quasi(plots, "rate", ["mean_quantity"]).tidy())
    return tidy.withColumn("statistic", F.round("statistic", 5))


# All eight models of three centred covariates at once, one Newton step per coefficient and round.
_STEP = """, c0 AS (SELECT discount, tax, open, count(*)::DOUBLE AS n, sum(y) AS k FROM r GROUP BY 1, 2, 3),
cen AS (SELECT sum(n * discount) / sum(n) AS m1, sum(n * tax) / sum(n) AS m2, sum(n * open) / sum(n) AS m3 FROM c0),
cells AS (SELECT discount - m1 AS x1, tax - m2 AS x2, open - m3 AS x3, n, k FROM c0, cen),
mods AS (SELECT a.range AS u1, b.range AS u2, c.range AS u3 FROM range(2) a, range(2) b, range(2) c),
it AS (SELECT 0 AS i, u1, u2, u3, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b3 FROM mods UNION ALL
  SELECT i + 1, u1, u2, u3, b0 + sum(r) / sum(v), b1 + u1 * sum(r * x1) / sum(v * x1 * x1), b2 + u2 * sum(r * x2) / sum(v * x2 * x2),
    b3 + u3 * sum(r * x3) / sum(v * x3 * x3)
  FROM (SELECT *, k - n * m AS r, n * m * (1 - m) AS v FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2 + b3 * x3))) AS m FROM it, cells WHERE i < 40))
  GROUP BY i, u1, u2, u3, b0, b1, b2, b3),
fit AS (SELECT u1, u2, u3, sum(-2 * (k * ln(m) + (n - k) * ln(1 - m))) AS d, u1 + u2 + u3 + 1 AS p
  FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2 + b3 * x3))) AS m FROM it, cells WHERE i = 40) GROUP BY 1, 2, 3),
f AS (SELECT *, d + 2 * p AS aic FROM fit),
names AS (SELECT * FROM (VALUES (1, 'discount'), (2, 'tax'), (3, 'open')) t(j, term)),
tr AS (SELECT 0 AS step, '<none>' AS term, u1, u2, u3, p, d, aic, true AS chosen FROM f WHERE p = 4 UNION ALL
  SELECT step + 1, '- ' || term, u1, u2, u3, p, d, aic, aic < old AND rn = 1 FROM (
    SELECT tr.step, names.term, f.u1, f.u2, f.u3, f.p, f.d, f.aic, tr.aic AS old, row_number() OVER (ORDER BY f.aic) AS rn
    FROM tr, names, f WHERE tr.chosen AND f.u1 = tr.u1 - (j = 1)::INT AND f.u2 = tr.u2 - (j = 2)::INT AND f.u3 = tr.u3 - (j = 3)::INT))
"""


@query(
    _RETURNED_R + _STEP + """SELECT step::BIGINT AS step, term, p::BIGINT AS n_coef, round(d, 5) AS deviance, round(aic, 5) AS aic, chosen FROM tr"""
)
def step_aic(t):
    _, trace = glm.step_aic(returned(t), "y", ["discount", "tax", "open"])
    return trace.withColumns({c: F.round(c, 5) for c in ("deviance", "aic")})


# -- curve -------------------------------------------------------------------------

_GN = """it AS (SELECT 0 AS i, 8.0::DOUBLE AS a, 0.2::DOUBLE AS b UNION ALL
  SELECT i + 1, a + (bb * ar - ab * br) / (aa * bb - ab * ab), b + (aa * br - ab * ar) / (aa * bb - ab * ab)
  FROM (SELECT i, any_value(a) AS a, any_value(b) AS b, sum(n * ja * ja) AS aa, sum(n * ja * jb) AS ab, sum(n * jb * jb) AS bb,
      sum(ja * (k - n * f)) AS ar, sum(jb * (k - n * f)) AS br
    FROM (SELECT *, b * f * (1 - f) AS ja, -(x - a) * f * (1 - f) AS jb FROM (SELECT i, a, b, x, n, k, 1 / (1 + exp(b * (x - a))) AS f FROM it, cells WHERE i < 60))
    GROUP BY i)),
best AS (SELECT a, b FROM it ORDER BY i DESC LIMIT 1)
"""


@query(
    _GRID_R + _AGE_CELLS + _GN + "SELECT 'a' AS term, round(a, 5) AS estimate FROM best UNION ALL SELECT 'b', round(b, 5) FROM best"
)
def logistic_curve(t):
    fit = curve.fit_logistic_curve(aged_intervals(t), "yearsAlive", "survival", start=(8.0, 0.2))
    return fit.tidy().select("term", F.round("estimate", 5).alias("estimate"))


@query(
    _GRID_R + _AGE_CELLS + _GN + "SELECT round(corr(survival, 1 / (1 + exp(b * (age - a)))), 6) AS r FROM aged, best"
)
def curve_goodness(t):
    rows = aged_intervals(t)
    return rounded(curve.fit_logistic_curve(rows, "yearsAlive", "survival", start=(8.0, 0.2)).goodness(rows))


# -- mixed models --------------------------------------------------------------------

# Everything per group that the likelihood and its derivatives need, at (b0, b1, s) and scaled effect b.
_G_SUMS = """sum(k - n * m) AS ra0, sum((k - n * m) * x) AS ra1, sum(n * m * (1 - m)) AS vb0, sum(n * m * (1 - m) * x) AS vb1,
  sum(n * m * (1 - m) * x * x) AS vb2, sum(n * m * (1 - m) * (1 - 2 * m)) AS wc0, sum(n * m * (1 - m) * (1 - 2 * m) * x) AS wc1,
  sum(k * eta - n * ln(1 + exp(eta))) AS ll"""
_G_GRAD = """ra0 - s * s * (wc0 - s * s * vb0 / dd * wc0) / (2 * dd) AS g0, ra1 - s * s * (wc1 - s * s * vb1 / dd * wc0) / (2 * dd) AS g1,
  b * ra0 - (2 * s * vb0 + s * s * wc0 * (b + s * (ra0 - s * b * vb0) / dd)) / (2 * dd) AS gs"""


def _mixed_sql(slope: bool = True, tag: str = "") -> str:
    """CTEs over ``mc(g, x, n, k)``: four rounds for the effects, one for coefficients and spread, and so on; then ``gf{tag}`` per group."""
    u = int(slope)
    return f"""it{tag} AS (SELECT 0 AS i, g, 0.0::DOUBLE AS b, 1.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.4::DOUBLE AS s FROM (SELECT DISTINCT g FROM mc) UNION ALL
  SELECT i + 1, g, b + (s * ra0 - b) / dd,
    b0 + CASE WHEN i % 5 < 4 THEN 0 WHEN {u} = 1 THEN (I11 * tg0 - I01 * tg1) / (I00 * I11 - I01 * I01) ELSE tg0 / I00 END,
    b1 + CASE WHEN i % 5 < 4 THEN 0 ELSE {u} * (I00 * tg1 - I01 * tg0) / (I00 * I11 - I01 * I01) END,
    s + CASE WHEN i % 5 < 4 THEN 0 ELSE greatest(-0.1, least(0.1, tgs * s * s / (2 * ng))) END
  FROM (SELECT *, sum(g0) OVER () AS tg0, sum(g1) OVER () AS tg1, sum(gs) OVER () AS tgs, count(*) OVER () AS ng, sum(vb0 - s * s * vb0 * vb0 / dd) OVER () AS I00,
      sum(vb1 - s * s * vb0 * vb1 / dd) OVER () AS I01, sum(vb2 - s * s * vb1 * vb1 / dd) OVER () AS I11
    FROM (SELECT *, {_G_GRAD} FROM (SELECT *, 1 + s * s * vb0 AS dd FROM (SELECT i, g, b, b0, b1, s, {_G_SUMS}
      FROM (SELECT *, 1 / (1 + exp(-eta)) AS m FROM (SELECT i, it{tag}.g, b, b0, b1, s, x, n, k, b0 + b1 * x + s * b AS eta FROM it{tag} JOIN mc ON mc.g = it{tag}.g WHERE i < 254))
      GROUP BY i, g, b, b0, b1, s))))),
gf{tag} AS (SELECT *, 1 + s * s * vb0 AS dd FROM (SELECT g, b, b0, b1, s, {_G_SUMS}, sum(n) AS n
  FROM (SELECT *, 1 / (1 + exp(-eta)) AS m FROM (SELECT it{tag}.g, b, b0, b1, s, x, n, k, b0 + b1 * x + s * b AS eta FROM it{tag} JOIN mc ON mc.g = it{tag}.g WHERE i = 254))
  GROUP BY g, b, b0, b1, s)),
gl{tag} AS (SELECT any_value(b0) AS b0, any_value(b1) AS b1, any_value(s) AS s, sum(ll - b * b / 2 - ln(dd) / 2) AS loglik, -2 * sum(ll) AS dev, sum(n) AS n FROM gf{tag})"""


_MC = _AGED_SQL + ", mc AS (SELECT interval AS g, age AS x, count(*)::DOUBLE AS n, sum(survival) AS k FROM aged GROUP BY 1, 2), "

# Hessian of the log-likelihood by differences of its gradient; the effects are solved for every shifted point.
_HESSIAN = f""", sh AS (SELECT a.range AS par, CASE b.range WHEN 0 THEN -1 ELSE 1 END AS sgn FROM range(3) a, range(2) b),
hi AS (SELECT 0 AS i, par, sgn, g, b, b0 + CASE WHEN par = 0 THEN sgn * 1e-4::DOUBLE ELSE 0 END AS b0, b1 + CASE WHEN par = 1 THEN sgn * 1e-4::DOUBLE ELSE 0 END AS b1,
    s + CASE WHEN par = 2 THEN sgn * 1e-4::DOUBLE ELSE 0 END AS s FROM gf, sh UNION ALL
  SELECT i + 1, par, sgn, g, b + (s * sum(k - n * m) - b) / (1 + s * s * sum(n * m * (1 - m))), b0, b1, s
  FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x + s * b))) AS m FROM (SELECT hi.*, x, n, k FROM hi JOIN mc ON mc.g = hi.g WHERE i < 8)) GROUP BY i, par, sgn, g, b, b0, b1, s),
hg AS (SELECT par, sgn, sum(g0) AS g0, sum(g1) AS g1, sum(gs) AS gs FROM (SELECT *, {_G_GRAD} FROM (SELECT *, 1 + s * s * vb0 AS dd FROM (
    SELECT par, sgn, g, b, b0, b1, s, {_G_SUMS} FROM (SELECT *, 1 / (1 + exp(-eta)) AS m FROM (SELECT hi.*, x, n, k, b0 + b1 * x + s * b AS eta
      FROM hi JOIN mc ON mc.g = hi.g WHERE i = 8)) GROUP BY par, sgn, g, b, b0, b1, s))) GROUP BY par, sgn),
hh AS (SELECT par, -sum(sgn * g0) / 2e-4::DOUBLE AS h0, -sum(sgn * g1) / 2e-4::DOUBLE AS h1, -sum(sgn * gs) / 2e-4::DOUBLE AS h2 FROM hg GROUP BY par),
h AS (SELECT max(CASE WHEN par = 0 THEN h0 END) AS a, max(CASE WHEN par = 0 THEN h1 END) AS b, max(CASE WHEN par = 0 THEN h2 END) AS c,
  max(CASE WHEN par = 1 THEN h1 END) AS d, max(CASE WHEN par = 1 THEN h2 END) AS e, max(CASE WHEN par = 2 THEN h2 END) AS f FROM hh),
se AS (SELECT sqrt((d * f - e * e) / det) AS se0, sqrt((a * f - c * c) / det) AS se1
  FROM (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM h))
"""


def _mixed(t):
    return mixed.glmm_logit(aged_intervals(t), "survival", ["yearsAlive"], "interval")


@query(
    _GRID_R + _MC + _mixed_sql() + _HESSIAN + f""", td AS (SELECT 'fixed' AS effect, NULL AS "group", '(Intercept)' AS term, b0 AS est, se0 AS se FROM gl, se UNION ALL
    SELECT 'fixed', NULL, 'yearsAlive', b1, se1 FROM gl, se)
    SELECT effect, "group", term, round(est, 5) AS estimate, round(se, 4) AS std_error, round(est / se, 3) AS statistic, round({_normal_p('(est / se)')}, 4) AS p_value FROM td UNION ALL
    SELECT 'ran_pars', 'interval', 'sd__(Intercept)', round(s, 5), NULL, NULL, NULL FROM gl"""
)
def glmm_fit(t):
    digits = {"estimate": 5, "std_error": 4, "statistic": 3, "p_value": 4}
    return _mixed(t).tidy().withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(
    _GRID_R + _MC + _mixed_sql() + """SELECT n::BIGINT AS n, 1.0::DOUBLE AS sigma, round(loglik, 4) AS loglik, round(-2 * loglik + 6, 4) AS aic,
    round(-2 * loglik + 3 * ln(n), 4) AS bic, round(dev, 3) AS deviance, (n - 3)::BIGINT AS df_residual, true AS converged, false AS singular FROM gl"""
)
def glmm_glance(t):
    digits = {"loglik": 4, "aic": 4, "bic": 4, "deviance": 3}
    return _mixed(t).glance().withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(
    _GRID_R + _MC + _mixed_sql() + """SELECT g AS interval, round(s * b, 5) AS condval, round(s / sqrt(dd), 5) AS condsd FROM gf"""
)
def glmm_ranef(t):
    return _mixed(t).ranef().withColumns({c: F.round(c, 5) for c in ("condval", "condsd")})


@query(
    _GRID_R + _MC + _mixed_sql() + """SELECT g AS interval, round(b0 + s * b, 5) AS "(Intercept)", round(b1, 5) AS "yearsAlive" FROM gf"""
)
def glmm_coef(t):
    return _mixed(t).coef().withColumns({c: F.round(c, 5) for c in ("(Intercept)", "yearsAlive")})


_ALL_SEASONS = """, sea AS (SELECT CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) = 12 THEN 1 ELSE 0 END AS INTEGER) AS w,
    median(o_totalprice) AS medprice, count(*) FILTER (WHERE o_totalprice >= 250000)::DOUBLE AS highdays FROM orders GROUP BY 1),
  rw AS (SELECT s * b AS v, medprice, highdays FROM gf LEFT JOIN sea ON w = split_part(g, '-', 2)::INT),
  rs AS ("""


def _climate_line(x: str) -> str:
    return (
        f"SELECT '{x}' AS x, regr_count(v, {x})::BIGINT AS n, corr(v, {x}) AS r, regr_slope(v, {x}) AS slope, "
        f"regr_intercept(v, {x}) AS intercept, regr_r2(v, {x}) AS r_squared FROM rw"
    )


@query(
    GRID + """, sea AS (SELECT CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) = 12 THEN 1 ELSE 0 END AS INTEGER) AS w,
      median(o_totalprice) AS medprice FROM orders GROUP BY 1),
    j AS (SELECT id, interval, survival, end_int AS "WINTER", medprice FROM iv LEFT JOIN sea ON w = end_int)
    SELECT id, interval, survival, "WINTER", round(medprice, 6) AS medprice,
    round((medprice - (SELECT avg(medprice) FROM j)) / (SELECT stddev_samp(medprice) FROM j), 6) AS scalemedprice FROM j"""
)
def interval_climate(t):
    """Interval records with the season they end in, one season value standardised over the records."""
    rows = t.orders.withColumn("WINTER", season_year("o_orderdate"))
    records = interval_records(t.orders, []).select("id", "interval", "end_int", "survival")
    return rounded(intervals_with_climate(records, seasons(t, rows).select("WINTER", "medprice"), "medprice").drop("end_int"))


@query(
    _GRID_R + _MC + _mixed_sql() + _ALL_SEASONS + _climate_line("medprice") + " UNION ALL " + _climate_line("highdays") + """)
    SELECT x, n, round(r, 3) AS r, n - 2 AS df, round(slope, 5) AS slope, round(intercept, 2) AS intercept, round(r_squared, 3) AS r_squared FROM rs"""
)
def ranef_climate(t):
    rows = t.orders.withColumn("WINTER", season_year("o_orderdate"))
    out = mixed.ranef_vs_climate(_mixed(t), seasons(t, rows), ["medprice", "highdays"])
    digits = {"r": 3, "slope": 5, "intercept": 2, "r_squared": 3}
    return out.select("x", "n", "df", *[F.round(c, d).alias(c) for c, d in digits.items()])


_BY_INTERVAL = """, ci AS (SELECT interval, count(*)::DOUBLE AS n, sum(survival) AS k FROM aged GROUP BY 1)
"""


@query(
    _GRID_R + _MC + _mixed_sql(False, "_a") + ", " + _mixed_sql(True, "_b")
    + ", cells AS (SELECT x, sum(n) AS n, sum(k) AS k FROM mc GROUP BY 1), " + _newton_logit("cells")
    + _DEVIANCE + _BY_INTERVAL + """SELECT 'null' AS model, 'glmm' AS kind, n::BIGINT AS n, 1::BIGINT AS n_coef, round(-2 * loglik + 4, 4) AS aic, round(dev, 3) AS deviance,
      round(sqrt(dev / n), 5) AS rmse, true AS converged FROM gl_a UNION ALL
    SELECT 'age', 'glmm', n::BIGINT, 2, round(-2 * loglik + 6, 4), round(dev, 3), round(sqrt(dev / n), 5), true FROM gl_b UNION ALL
    SELECT 'age_fixed', 'glm', n::BIGINT, 2, round(d + 4, 4), round(d, 3), round(sqrt(working / n), 5), true FROM dev UNION ALL
    SELECT 'interval_fixed', 'quasi', sum(n)::BIGINT, count(*)::BIGINT, NULL, round(sum(-2 * (k * ln(k / n) + (n - k) * ln(1 - k / n))), 3),
      round(sqrt(sum(n * n / k + n * n / (n - k)) / sum(n)), 5), true FROM ci"""
)
def model_grid(t):
    specs = [
        ModelSpec("null", [], "glmm", "interval"),
        ModelSpec("age", ["yearsAlive"], "glmm", "interval"),
        ModelSpec("age_fixed", ["yearsAlive"]),
        ModelSpec("interval_fixed", ["interval"], "quasi", None, ["interval"]),
    ]
    digits = {"aic": 4, "deviance": 3, "rmse": 5}
    return compare_models(aged_intervals(t), "survival", specs).withColumns({c: F.round(c, d) for c, d in digits.items()})
