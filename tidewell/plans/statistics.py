"""Queries of the statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import forecasts as A
from tidewell.operators import regression as G
from tidewell.operators import resampling as R
from tidewell.operators import statistics as S
from tidewell.operators import unit_roots as U
from tidewell.plans.registry import query, read

RANKS = "SELECT *, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {n} FROM ({t})"


def line(spark, sf):
    return read(spark, sf, "lineitem").withColumn("net", F.expr("l_extendedprice * (1 - l_discount)"))


@query("SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'net', corr(l_quantity, l_extendedprice * (1 - l_discount)) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'net', corr(l_extendedprice, l_extendedprice * (1 - l_discount)) FROM lineitem")
def corr_pearson(spark, sf):
    return S.corr_pearson(line(spark, sf), ["l_quantity", "l_extendedprice", "net"])


@query(f"WITH t AS ({RANKS.format(c='net', n='rb', t=RANKS.format(c='l_extendedprice', n='ra', t='SELECT l_extendedprice, l_extendedprice * (1 - l_discount) AS net FROM lineitem'))}) SELECT corr(ra, rb) AS rho FROM t")
def corr_spearman(spark, sf):
    return S.corr_spearman(line(spark, sf), "l_extendedprice", "net")


CELLS = "SELECT l_linenumber % 40 AS x, l_quantity + (l_linenumber % 40) AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2"


@query(f"""WITH c AS ({CELLS}), p AS (SELECT sum(a.n * b.n) FILTER ((a.x - b.x) * (a.y - b.y) > 0) / 2 AS conc, coalesce(sum(a.n * b.n) FILTER ((a.x - b.x) * (a.y - b.y) < 0) / 2, 0) AS disc FROM c a, c b),
n AS (SELECT sum(n) AS n FROM c), tx AS (SELECT sum(m * (m - 1) / 2) AS t FROM (SELECT sum(n) AS m FROM c GROUP BY x)), ty AS (SELECT sum(m * (m - 1) / 2) AS t FROM (SELECT sum(n) AS m FROM c GROUP BY y))
SELECT (conc - disc) / sqrt((n * (n - 1) / 2 - tx.t) * (n * (n - 1) / 2 - ty.t)) AS tau FROM p, n, tx, ty""")
def corr_kendall(spark, sf):
    df = read(spark, sf, "lineitem").selectExpr("l_linenumber % 40 AS x", "l_quantity + (l_linenumber % 40) AS y")
    return S.corr_kendall(df, "x", "y")


CHI = """WITH c AS (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS n FROM {t} GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS cb, sum(n) OVER () AS g FROM c),
s AS (SELECT any_value(g) * (sum(n * n / (ra * cb)) - 1) AS chi2, any_value(g) AS n, count(DISTINCT a)::DOUBLE AS r, count(DISTINCT b)::DOUBLE AS c FROM m)"""


@query(CHI.format(a="c_mktsegment", b="c_nationkey", t="customer") + " SELECT chi2, ((r - 1) * (c - 1))::BIGINT AS dof, sqrt(chi2 / n / (least(r, c) - 1)) AS v, sqrt(greatest(chi2 / n - (c - 1) * (r - 1) / (n - 1), 0) / (least(r - (r - 1) * (r - 1) / (n - 1), c - (c - 1) * (c - 1) / (n - 1)) - 1)) AS v_corrected, n::BIGINT AS n FROM s")
def chi_square(spark, sf):
    return S.chi_square(read(spark, sf, "customer"), "c_mktsegment", "c_nationkey")


@query(CHI.format(a="source", b="lang", t="documents") + " SELECT sqrt(chi2 / n / (least(r, c) - 1)) AS v, sqrt(greatest(chi2 / n - (c - 1) * (r - 1) / (n - 1), 0) / (least(r - (r - 1) * (r - 1) / (n - 1), c - (c - 1) * (c - 1) / (n - 1)) - 1)) AS v_corrected FROM s")
def cramers_v(spark, sf):
    return S.cramers_v(read(spark, sf, "documents"), "source", "lang")


@query("SELECT 'l_extendedprice' AS a, 'net' AS b, corr(l_extendedprice, l_extendedprice * (1 - l_discount)) AS r, 'NEAR_DUPLICATE' AS kind FROM lineitem")
def corr_highlights(spark, sf):
    return S.corr_highlights(S.corr_pearson(line(spark, sf), ["l_quantity", "l_extendedprice", "net"]))


@query("SELECT 'net' AS \"column\", corr(l_extendedprice, l_extendedprice * (1 - l_discount)) AS r FROM lineitem UNION ALL SELECT 'l_quantity', corr(l_extendedprice, l_quantity) FROM lineitem")
def target_correlation(spark, sf):
    return S.target_correlation(line(spark, sf), "l_extendedprice", ["net", "l_quantity"])


@query("SELECT a, b, r FROM (SELECT 'l_extendedprice' AS a, 'net' AS b, corr(l_extendedprice, l_extendedprice * (1 - l_discount)) AS r FROM lineitem) ORDER BY abs(r) DESC LIMIT 1")
def topk_correlations(spark, sf):
    return S.corr_pearson(line(spark, sf), ["l_quantity", "l_extendedprice", "net"]).orderBy(F.desc(F.abs("r"))).limit(1)


@query("SELECT unnest(['l_extendedprice', 'net']) AS \"column\", 1 / (1 - pow(corr(l_extendedprice, l_extendedprice * (1 - l_discount)), 2)) AS vif FROM lineitem")
def vif(spark, sf):
    return S.vif(line(spark, sf), ["l_extendedprice", "net"])


@query("SELECT 'net' AS \"column\", 1 / (1 - pow(corr(l_extendedprice, l_extendedprice * (1 - l_discount)), 2)) AS vif FROM lineitem UNION ALL SELECT 'l_extendedprice', 1 / (1 - pow(corr(l_extendedprice, l_extendedprice * (1 - l_discount)), 2)) FROM lineitem")
def check_multicollinearity(spark, sf):
    return S.vif(line(spark, sf), ["l_extendedprice", "net"]).where("vif >= 5")


@query("SELECT t, dof, d AS cohen_d FROM (SELECT (avg(value) - 50) / (stddev_samp(value) / sqrt(count(*))) AS t, (count(*) - 1)::DOUBLE AS dof, (avg(value) - 50) / stddev_pop(value) AS d FROM events)")
def ttest_one(spark, sf):
    return S.ttest_one(read(spark, sf, "events"), "value", 50.0).drop("p")


MOMENTS = "SELECT avg(value) FILTER (event_type = 'click') AS m0, avg(value) FILTER (event_type = 'purchase') AS m1, var_samp(value) FILTER (event_type = 'click') AS v0, var_samp(value) FILTER (event_type = 'purchase') AS v1, count(*) FILTER (event_type = 'click') AS n0, count(*) FILTER (event_type = 'purchase') AS n1, var_pop(value) FILTER (event_type = 'click') AS p0, var_pop(value) FILTER (event_type = 'purchase') AS p1 FROM events"


@query(f"SELECT (m0 - m1) / sqrt(v0 / n0 + v1 / n1) AS t, pow(v0 / n0 + v1 / n1, 2) / (pow(v0 / n0, 2) / (n0 - 1) + pow(v1 / n1, 2) / (n1 - 1)) AS dof, (m0 - m1) / sqrt((p0 + p1) / 2) AS cohen_d FROM ({MOMENTS})")
def ttest_two(spark, sf):
    return S.ttest_two(read(spark, sf, "events"), "value", "event_type", "click", "purchase").drop("p")


@query("SELECT avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t, (count(*) - 1)::DOUBLE AS dof, avg(d) / stddev_pop(d) AS cohen_d FROM (SELECT l_discount - l_tax AS d FROM lineitem)")
def ttest_paired(spark, sf):
    return S.ttest_paired(read(spark, sf, "lineitem"), "l_discount", "l_tax").drop("p")


ANOVA = "WITH g AS (SELECT {g}, count(*)::DOUBLE AS n, avg({c}) AS m, var_pop({c}) AS v FROM {t} GROUP BY 1), s AS (SELECT sum(n * m * m) - pow(sum(n * m), 2) / sum(n) AS b, sum(n * v) AS w, count(*) - 1.0::DOUBLE AS d1, sum(n) - count(*) AS d2 FROM g)"


@query(ANOVA.format(g="l_returnflag", c="l_quantity", t="lineitem") + " SELECT b / d1 / (w / d2) AS f, d1 AS dof1, d2 AS dof2, b / (b + w) AS eta2 FROM s")
def anova_oneway(spark, sf):
    return S.anova_oneway(read(spark, sf, "lineitem"), "l_quantity", "l_returnflag").drop("p")


PAIR = "SELECT event_type, value FROM events WHERE event_type IN ('click', 'purchase')"


@query(f"WITH r AS ({RANKS.format(c='value', n='rk', t=PAIR)}), s AS (SELECT sum(rk) FILTER (event_type = 'click') AS ra, count(*) FILTER (event_type = 'click') AS na, count(*) FILTER (event_type = 'purchase') AS nb FROM r) SELECT ra - na * (na + 1) / 2 AS u, 2 * (ra - na * (na + 1) / 2) / (na * nb) - 1 AS rank_biserial FROM s")
def mann_whitney_u(spark, sf):
    return S.mann_whitney_u(read(spark, sf, "events"), "value", "event_type", "click", "purchase")


@query(f"""WITH r AS ({RANKS.format(c='l_quantity', n='rk', t='SELECT l_returnflag, l_quantity FROM lineitem')}), n AS (SELECT count(*)::DOUBLE AS n FROM r), t AS (SELECT sum(pow(m, 3) - m) AS t FROM (SELECT count(*)::DOUBLE AS m FROM r GROUP BY l_quantity)),
s AS (SELECT sum(q) AS q, count(*) AS k FROM (SELECT pow(sum(rk), 2) / count(*) AS q FROM r GROUP BY l_returnflag)) SELECT (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (pow(n, 3) - n)) AS h, (k - 1)::DOUBLE AS dof FROM n, t, s""")
def kruskal_wallis(spark, sf):
    return S.kruskal_wallis(read(spark, sf, "lineitem"), "l_quantity", "l_returnflag").drop("p")


@query(f"WITH r AS ({RANKS.format(c='a', n='rk', t='SELECT round(l_discount * 100) - round(l_tax * 100) AS d, abs(round(l_discount * 100) - round(l_tax * 100)) AS a FROM lineitem WHERE round(l_discount * 100) <> round(l_tax * 100)')}) SELECT least(sum(rk) FILTER (d > 0), sum(rk) FILTER (d < 0)) AS w, count(*) AS n FROM r")
def wilcoxon_signed_rank(spark, sf):
    return S.wilcoxon_signed_rank(read(spark, sf, "lineitem").selectExpr("round(l_discount * 100) AS a", "round(l_tax * 100) AS b"), "a", "b")


@query("WITH z AS (SELECT event_type, abs(value - median(value) OVER (PARTITION BY event_type)) AS z FROM events), " + ANOVA.format(g="event_type", c="z", t="z").removeprefix("WITH ") + " SELECT b / d1 / (w / d2) AS w FROM s")
def levene_test(spark, sf):
    return S.levene_test(read(spark, sf, "events"), "value", "event_type").drop("p")


@query("""WITH m AS (SELECT count(value)::DOUBLE AS n, skewness(value) * (count(value) - 2) / sqrt(count(value) * (count(value) - 1.0)) AS g1, kurtosis_pop(value) AS g2 FROM events),
s AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
  (g2 + 6 / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / (pow(n + 1, 2) * (n + 3) * (n + 5))) AS x, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS b FROM m),
a AS (SELECT *, 6 + 8 / b * (2 / b + sqrt(1 + 4 / (b * b))) AS a FROM s), z AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, (1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))) AS q FROM a),
k AS (SELECT *, z1 * z1 + pow((1 - 2 / (9 * a) - sign(q) * pow(abs(q), 1 / 3.0::DOUBLE)) / sqrt(2 / (9 * a)), 2) AS k2 FROM z) SELECT k2, exp(-k2 / 2) AS p, exp(-k2 / 2) >= 0.05 AS normal, n / 6 * (g1 * g1 + g2 * g2 / 4) AS jarque_bera FROM k""")
def dagostino_pearson(spark, sf):
    return S.dagostino_pearson(read(spark, sf, "events"), "value")


@query("SELECT avg(value) AS mean FROM events")
def ci_mean(spark, sf):
    return S.ci_mean(read(spark, sf, "events"), "value").where("lo < mean AND mean < hi").select("mean")


@query(f"SELECT m0 - m1 AS diff FROM ({MOMENTS})")
def ci_diff_means(spark, sf):
    return S.ci_diff_means(read(spark, sf, "events"), "value", "event_type", "click", "purchase").where("lo < diff AND diff < hi").select("diff")


@query("""WITH g AS (SELECT avg((quality = 1)::INT) AS p, count(*)::DOUBLE AS n, 1.959963984540054 AS z FROM labels)
SELECT p, ((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) AS wilson_lo, ((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) AS wilson_hi,
p - z * sqrt(p * (1 - p) / n) AS wald_lo, p + z * sqrt(p * (1 - p) / n) AS wald_hi FROM g""")
def ci_proportion(spark, sf):
    return S.ci_proportion(read(spark, sf, "labels"), F.col("quality") == 1)


@query()
def bootstrap_ci(spark, sf):
    return R.bootstrap_ci(read(spark, sf, "events"), "value", "event_id")


@query()
def bootstrap_bca(spark, sf):
    return R.bootstrap_ci(read(spark, sf, "events"), "value", "event_id", method="bca")


@query()
def permutation_test(spark, sf):
    return R.permutation_test(read(spark, sf, "events"), "value", "event_type", "click", "purchase", "event_id")


@query()
def permutation_anova(spark, sf):
    return R.permutation_anova(read(spark, sf, "events"), "value", "event_type", "event_id")


@query()
def permutation_correlation(spark, sf):
    return R.permutation_correlation(read(spark, sf, "events").withColumn("h", F.hour("ts").cast("double")), "value", "h", "event_id")


P = "SELECT o_orderkey AS id, x * x * x AS p FROM (SELECT o_orderkey, ((o_orderkey * 7919) % 10007 + 1) / 10008.0::DOUBLE AS x FROM orders)"


@query(f"""WITH t AS ({P}), k AS (SELECT *, row_number() OVER (ORDER BY p, id) AS k, count(*) OVER () AS m FROM t), h AS (SELECT sum(1.0 / i) AS c FROM (SELECT unnest(generate_series(1, (SELECT any_value(m) FROM k))) AS i))
SELECT id, p, least(1, p * m) AS bonferroni, least(1, max(p * (m - k + 1)) OVER (ORDER BY k)) AS holm, least(1, min(p * m / k) OVER (ORDER BY k DESC)) AS bh, least(1, min(p * m * c / k) OVER (ORDER BY k DESC)) AS "by" FROM k, h""")
def multiple_testing(spark, sf):
    x = ((F.col("o_orderkey") * 7919) % 10007 + 1) / 10008.0
    t = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), x.alias("x")).select("id", (F.col("x") * F.col("x") * F.col("x")).alias("p"))
    return S.multiple_testing(t, "id")


@query("SELECT regr_slope(l_extendedprice * (1 - l_discount), l_extendedprice) AS slope, regr_intercept(l_extendedprice * (1 - l_discount), l_extendedprice) AS intercept, regr_r2(l_extendedprice * (1 - l_discount), l_extendedprice) AS r2 FROM lineitem")
def simple_regression(spark, sf):
    return S.simple_regression(line(spark, sf), "net", "l_extendedprice")


@query("SELECT 'intercept' AS feature, round(regr_intercept(l_extendedprice * (1 - l_discount), l_extendedprice), 4) AS coef FROM lineitem UNION ALL SELECT 'l_extendedprice', round(regr_slope(l_extendedprice * (1 - l_discount), l_extendedprice), 4) FROM lineitem")
def ols(spark, sf):
    return S.ols(line(spark, sf), "net", ["l_extendedprice"]).select("feature", F.round("coef", 4).alias("coef"))


@query("""WITH t AS (SELECT (l_extendedprice > 50000)::INT AS y, (l_quantity > 25)::INT AS x FROM lineitem), n AS (SELECT count(*) FILTER (x = 0 AND y = 0) AS a, count(*) FILTER (x = 0 AND y = 1) AS b, count(*) FILTER (x = 1 AND y = 0) AS c, count(*) FILTER (x = 1 AND y = 1) AS d FROM t),
l AS (SELECT *, a * ln(a / (a + b)) + b * ln(b / (a + b)) + c * ln(c / (c + d)) + d * ln(d / (c + d)) AS ll FROM n)
SELECT 'intercept' AS feature, ln(b / a) AS coef, sqrt(1 / a + 1 / b) AS se, ll AS log_likelihood, 4 - 2 * ll AS aic, 2 * ln(a + b + c + d) - 2 * ll AS bic FROM l
UNION ALL SELECT 'x', ln(d / c) - ln(b / a), sqrt(1 / a + 1 / b + 1 / c + 1 / d), ll, 4 - 2 * ll, 2 * ln(a + b + c + d) - 2 * ll FROM l""")
def logistic_odds(spark, sf):
    """With one 0/1 feature the fit is the table's log odds."""
    df = read(spark, sf, "lineitem").select((F.col("l_extendedprice") > 50000).cast("int").alias("y"), (F.col("l_quantity") > 25).cast("int").alias("x"))
    return G.logistic_report(df, "y", ["x"]).select("feature", "coef", "se", "log_likelihood", "aic", "bic")


@query()
def logistic_glm(spark, sf):
    df = read(spark, sf, "lineitem").withColumn("y", (F.col("l_extendedprice") > 50000).cast("double"))
    return G.logistic_report(df.withColumn("x", F.col("l_quantity") / 50 + F.col("l_extendedprice") / 400000), "y", ["x", "l_discount"])


@query("""WITH t AS (SELECT l_quantity AS a, l_discount AS b, l_extendedprice * (1 - l_discount) AS y, (l_orderkey % 5)::INT AS fold FROM lineitem), f AS (SELECT unnest(range(5)) AS fold UNION ALL SELECT NULL),
s AS (SELECT f.fold, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, regr_sxx(y, a) AS aa, regr_sxx(y, b) AS bb, regr_sxy(b, a) AS ab, regr_sxy(y, a) AS ay, regr_sxy(y, b) AS yb FROM f JOIN t ON f.fold IS NULL OR t.fold <> f.fold GROUP BY 1),
c AS (SELECT s.*, alpha, (ay * (bb + alpha) - yb * ab) / ((aa + alpha) * (bb + alpha) - ab * ab) AS ca, (yb * (aa + alpha) - ay * ab) / ((aa + alpha) * (bb + alpha) - ab * ab) AS cb FROM s, (SELECT unnest([0.1, 1.0, 10.0]) AS alpha)),
e AS (SELECT alpha, t.fold, avg(pow(y - my - ca * (a - ma) - cb * (b - mb), 2)) AS mse FROM c JOIN t USING (fold) GROUP BY 1, 2), k AS (SELECT alpha FROM e GROUP BY 1 ORDER BY avg(mse), alpha DESC LIMIT 1)
SELECT unnest(['intercept', 'l_quantity', 'l_discount']) AS feature, unnest([my - ca * ma - cb * mb, ca, cb]) AS coef, alpha::DOUBLE AS alpha FROM c JOIN k USING (alpha) WHERE fold IS NULL""")
def ridge_cv(spark, sf):
    return G.regularised_cv(line(spark, sf), "net", ["l_quantity", "l_discount"], 0.0, fold=F.col("l_orderkey") % 5).drop("r2")


@query()
def lasso_cv(spark, sf):
    return G.regularised_cv(line(spark, sf), "net", ["l_quantity", "l_discount"], 1.0)


@query("""WITH t AS (SELECT l_extendedprice AS x, l_extendedprice * (1 - l_discount) AS y, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem), s AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS xx, regr_syy(y, x) AS yy, regr_r2(y, x) AS r2, avg(x) AS mx FROM t),
e AS (SELECT sum(e * e) AS rss, sum(pow(e - p, 2)) AS d FROM (SELECT e, lag(e) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, x) AS p FROM (SELECT y - a - b * x AS e, x, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM t, s))),
u AS (SELECT *, -n / 2.0 * (ln(2 * pi() * rss / n) + 1) AS ll FROM s, e)
SELECT unnest(['intercept', 'l_extendedprice']) AS feature, unnest([a, b]) AS coef, unnest([sqrt(rss / (n - 2) * (1.0 / n + mx * mx / xx)), sqrt(rss / (n - 2) / xx)]) AS se, n, r2, 1 - (1 - r2) * (n - 1) / (n - 2) AS adj_r2, 4 - 2 * ll AS aic, 2 * ln(n) - 2 * ll AS bic, (yy - rss) / (rss / (n - 2)) AS f, d / rss AS dw FROM u""")
def ols_report(spark, sf):
    out = G.ols_report(line(spark, sf), "net", ["l_extendedprice"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return out.select("feature", "coef", "se", "n", "r2", "adj_r2", "aic", "bic", "f", "dw")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice - avg(o_totalprice) OVER () AS e FROM orders), d AS (SELECT *, e - lag(e) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS x FROM r)
SELECT o_custkey, sum(x * x) / sum(e * e) AS dw FROM d GROUP BY 1""")
def residual_diagnostics(spark, sf):
    df = read(spark, sf, "orders")
    m = df.agg(F.avg("o_totalprice")).first()[0]
    return S.durbin_watson(df.withColumn("e", F.col("o_totalprice") - m), "e", ["o_orderkey"], ["o_custkey"])


LAGS = "SELECT event_type, e, n, " + ", ".join(f"lag(e, {k}) OVER (PARTITION BY event_type ORDER BY d) AS l{k}" for k in range(1, 11)) + " FROM x"


@query(f"""WITH x AS (SELECT event_type, d, v - avg(v) OVER (PARTITION BY event_type) AS e, count(*) OVER (PARTITION BY event_type) AS n FROM (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS d, sum(value) AS v FROM events GROUP BY 1, 2)), l AS ({LAGS}),
r AS (SELECT event_type, any_value(n) AS n, [{", ".join(f"sum(e * l{k}) / sum(e * e)" for k in range(1, 11))}] AS r FROM l GROUP BY 1), u AS (SELECT event_type, n, unnest(range(1, 11)) AS k, unnest(r) AS a FROM r)
SELECT event_type, any_value(n) * (any_value(n) + 2) * sum(a * a / (n - k)) AS q, count(*) AS dof FROM u WHERE k <= n / 2.0 - 1 GROUP BY 1""")
def ljung_box(spark, sf):
    return S.ljung_box(days(spark, sf), "v", ["d"], ["event_type"]).where("p BETWEEN 0 AND 1").drop("p")


@query("""WITH f AS (SELECT regr_slope(o_totalprice, o_custkey) AS b, regr_intercept(o_totalprice, o_custkey) AS a, avg(o_custkey) AS mx, regr_sxx(o_totalprice, o_custkey) AS sxx, count(*) AS n FROM orders),
e AS (SELECT o_orderkey, o_totalprice - a - b * o_custkey AS residual, 1.0 / n + pow(o_custkey - mx, 2) / sxx AS leverage, n FROM orders, f), s AS (SELECT sum(residual * residual) / (any_value(n) - 2) AS s2 FROM e)
SELECT o_orderkey, round(leverage, 9) AS leverage, residual * residual * leverage / (2 * s2 * pow(1 - leverage, 2)) > 4.0 / n AS influential FROM e, s""")
def cooks_distance(spark, sf):
    return S.cooks_distance(read(spark, sf, "orders"), "o_totalprice", ["o_custkey"]).select("o_orderkey", F.round("leverage", 9).alias("leverage"), "influential")


@query("SELECT count(*) * regr_r2(e * e, x) AS lm FROM (SELECT l_extendedprice AS x, l_extendedprice * (1 - l_discount) - l_extendedprice * 0.95 AS e FROM lineitem)")
def breusch_pagan(spark, sf):
    # p needs a tail that SQL lacks; it is tested apart
    return S.breusch_pagan(line(spark, sf).withColumn("e", F.col("net") - F.col("l_extendedprice") * 0.95), "e", ["l_extendedprice"]).drop("p")


DAYS = "SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS d, sum(value) AS v FROM events GROUP BY 1, 2"


def days(spark, sf):
    return read(spark, sf, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("d")).agg(F.sum("value").alias("v"))


@query(f"""WITH x AS (SELECT *, v - avg(v) OVER (PARTITION BY event_type) AS e, count(*) OVER (PARTITION BY event_type) AS n FROM ({DAYS})), l AS (SELECT event_type, n, e, lag(e, 1) OVER w AS l1, lag(e, 2) OVER w AS l2 FROM x WINDOW w AS (PARTITION BY event_type ORDER BY d))
SELECT event_type, 1 AS lag, sum(e * l1) / sum(e * e) AS acf FROM l GROUP BY 1 UNION ALL SELECT event_type, 2, sum(e * l2) / sum(e * e) FROM l GROUP BY 1""")
def acf(spark, sf):
    return S.acf(days(spark, sf), "v", ["d"], ["event_type"], 2)


@query()
def pacf(spark, sf):
    return S.pacf(days(spark, sf), "v", ["d"], ["event_type"], 5)


@query(f"""WITH x AS (SELECT event_type, d, v - lag(v) OVER w AS y, lag(v) OVER w AS l FROM ({DAYS}) WINDOW w AS (PARTITION BY event_type ORDER BY d)), z AS (SELECT *, lag(y) OVER (PARTITION BY event_type ORDER BY d) AS m FROM x),
s AS (SELECT event_type, count(*) AS n, regr_sxx(y, l) AS ll, regr_sxx(y, m) AS mm, regr_sxy(m, l) AS lm, regr_sxy(y, l) AS ly, regr_sxy(y, m) AS my, regr_syy(y, l) AS yy FROM z WHERE m IS NOT NULL GROUP BY 1),
b AS (SELECT *, (ly * mm - my * lm) / (ll * mm - lm * lm) AS b, (my * ll - ly * lm) / (ll * mm - lm * lm) AS c FROM s),
t AS (SELECT event_type, n, b / sqrt((yy - b * ly - c * my) / (n - 3) * mm / (ll * mm - lm * lm)) AS stat FROM b)
SELECT event_type, stat, 1 AS lags, n AS n_used, stat < -2.86154 - 2.8903 / n - 4.234 / (n * n) - 40.040 / (n * n * n) AS stationary FROM t""")
def adf_test(spark, sf):
    # p needs a tail that SQL lacks; it is tested apart
    return U.adf_test(days(spark, sf), "v", ["d"], ["event_type"], lags=1).drop("p", "critical")


@query()
def adf_test_aic(spark, sf):
    return U.adf_test(days(spark, sf), "v", ["d"], ["event_type"])


@query(f"""WITH x AS (SELECT *, v - avg(v) OVER (PARTITION BY event_type) AS e FROM ({DAYS})), s AS (SELECT event_type, e, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2, sum(e) OVER (PARTITION BY event_type ORDER BY d ROWS UNBOUNDED PRECEDING) AS s FROM x WINDOW w AS (PARTITION BY event_type ORDER BY d)),
t AS (SELECT event_type, sum(s * s) / (count(*) * (sum(e * e) + 2 * sum(e * e1) * 2 / 3 + 2 * sum(e * e2) / 3)) AS stat FROM s GROUP BY 1),
q AS (SELECT *, CASE WHEN stat <= 0.347 THEN 0.1 WHEN stat <= 0.463 THEN 0.1 - (stat - 0.347) / 0.116 * 0.05 WHEN stat <= 0.574 THEN 0.05 - (stat - 0.463) / 0.111 * 0.025 WHEN stat <= 0.739 THEN 0.025 - (stat - 0.574) / 0.165 * 0.015 ELSE 0.01 END AS p FROM t)
SELECT event_type, stat, p, 2 AS lags, p > 0.05 AS stationary FROM q""")
def kpss_test(spark, sf):
    return U.kpss_test(days(spark, sf), "v", ["d"], ["event_type"], lags=2)


@query(f"""WITH x AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n, avg(v) OVER (PARTITION BY event_type ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS a FROM ({DAYS}) WINDOW w AS (PARTITION BY event_type ORDER BY d)),
t AS (SELECT *, CASE WHEN i >= 3 AND i < n - 3 THEN a END AS trend FROM x), m AS (SELECT event_type, i % 7 AS k, avg(v - trend) AS m FROM t GROUP BY 1, 2), c AS (SELECT *, m - avg(m) OVER (PARTITION BY event_type) AS seasonal FROM m)
SELECT t.event_type, d, v, trend, seasonal, v - trend - seasonal AS resid FROM t JOIN c ON t.event_type = c.event_type AND t.i % 7 = c.k""")
def seasonal_decompose(spark, sf):
    return S.seasonal_decompose(days(spark, sf), "v", "d", ["event_type"], 7).withColumn("d", F.col("d").cast("timestamp_ntz")).select("event_type", "d", "v", "trend", "seasonal", "resid")


@query(f"""WITH x AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n, avg(v) OVER (PARTITION BY event_type ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS a FROM ({DAYS}) WINDOW w AS (PARTITION BY event_type ORDER BY d)),
t AS (SELECT *, CASE WHEN i >= 3 AND i < n - 3 THEN a END AS trend FROM x), m AS (SELECT event_type, i % 7 AS k, avg(v / trend) AS m FROM t GROUP BY 1, 2), c AS (SELECT *, m / avg(m) OVER (PARTITION BY event_type) AS seasonal FROM m)
SELECT t.event_type, d, v, trend, seasonal, v / (trend * seasonal) AS resid FROM t JOIN c ON t.event_type = c.event_type AND t.i % 7 = c.k""")
def seasonal_decompose_multiplicative(spark, sf):
    out = S.seasonal_decompose(days(spark, sf), "v", "d", ["event_type"], 7, multiplicative=True)
    return out.withColumn("d", F.col("d").cast("timestamp_ntz")).select("event_type", "d", "v", "trend", "seasonal", "resid")


@query()
def arima_forecast(spark, sf):
    return A.ar_forecast(days(spark, sf), "v", ["d"], ["event_type"])


@query()
def statistical_test_battery(spark, sf):
    return S.statistical_test_battery(read(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_returnflag", ["l_orderkey", "l_linenumber"])
