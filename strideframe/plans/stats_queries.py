"""Paired, categorical and permutation tests over `orders`, `customer` and `labels`."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.operators import paired as R
from strideframe.operators.permutation import permutation_test
from strideframe.plans.registry import query, rounded, table


def t_p_sql(t: str, nu: str) -> str:
    """Two-sided t p for integer df as a finite trigonometric sum (independent of the Spark side)."""
    th = f"atan(abs({t}) / sqrt({nu}))"
    odd = (f"1 - 2 / pi() * ({th} + CASE WHEN {nu} > 1 THEN sin({th}) * list_sum(list_transform(range(0, CAST(({nu} - 1) / 2 AS BIGINT)), "
           f"lambda j: sqrt(pi()) / 2 * exp(lgamma(j + 1) - lgamma(j + 1.5)) * pow(cos({th}), 2 * j + 1))) ELSE 0 END)")
    even = (f"1 - sin({th}) * list_sum(list_transform(range(0, CAST({nu} / 2 AS BIGINT)), "
            f"lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * pow(cos({th}), 2 * j)))")
    return f"(CASE WHEN CAST({nu} AS BIGINT) % 2 = 1 THEN {odd} ELSE {even} END)"


def chi2_p_sql(x: str) -> str:
    """Upper tail of chi-square(1) from the power series of erf."""
    z = f"sqrt({x} / 2)"
    return (f"(CASE WHEN {x} = 0 THEN 1.0 ELSE 1 - list_sum(list_transform(range(0, 600), "
            f"lambda j: exp((2 * j + 1) * ln({z}) - lgamma(j + 1.5) - {x} / 2))) END)")


def order_sessions(spark, sf):
    """All orders, before 1998 (T0) and from 1998 (T1)."""
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", F.quarter("o_orderdate").alias("q"),
                                          F.when(F.year("o_orderdate") < 1998, "T0").otherwise("T1").alias("session"))


_PAIRS = """e AS (SELECT o_custkey, o_orderpriority, avg(o_totalprice) FILTER (year(o_orderdate) < 1998) AS v0, avg(o_totalprice) FILTER (year(o_orderdate) >= 1998) AS v1
  FROM orders GROUP BY 1, 2)"""
_T = """t AS (SELECT o_orderpriority, count(*) AS n_pairs, avg(v0) AS mean_T0, stddev_samp(v0) AS sd_T0, median(v0) AS median_T0, avg(v1) AS mean_T1, stddev_samp(v1) AS sd_T1, median(v1) AS median_T1,
  avg(v1 - v0) AS mean_change, stddev_samp(v1 - v0) AS sd_change, count(*) - 1 AS df, avg(v1 - v0) / (stddev_samp(v1 - v0) / sqrt(count(*))) AS t_stat
  FROM e WHERE v0 IS NOT NULL AND v1 IS NOT NULL GROUP BY 1)"""


def _pairs(spark, sf):
    return R.pair_sessions(order_sessions(spark, sf), ["o_custkey", "o_orderpriority"], "session", ["o_totalprice"]).select(
        "o_custkey", "o_orderpriority", F.col("o_totalprice_T0").alias("v0"), F.col("o_totalprice_T1").alias("v1"))


@query("paired_stats_fdr", f"""
WITH {_PAIRS}, {_T}, p AS (SELECT *, {t_p_sql("t_stat", "df")} AS p_value FROM t),
r AS (SELECT *, p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value, o_orderpriority) AS raw, row_number() OVER (ORDER BY p_value, o_orderpriority) AS rk FROM p)
SELECT o_orderpriority, n_pairs, round(mean_T0, 4) AS mean_T0, round(sd_T0, 4) AS sd_T0, round(median_T0, 4) AS median_T0, round(mean_T1, 4) AS mean_T1, round(sd_T1, 4) AS sd_T1,
  round(median_T1, 4) AS median_T1, round(mean_change, 4) AS mean_change, round(sd_change, 4) AS sd_change, CAST(df AS DOUBLE) AS df, round(t_stat, 6) AS t_stat,
  round(mean_change / sd_change, 6) AS effect_size_dz, round(p_value, 6) AS p_value, '' AS notes,
  round(least(1, min(raw) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q_value FROM r""")
def paired_stats_fdr(spark, sf):
    rep = R.paired_t(_pairs(spark, sf), ["o_orderpriority"], medians=True).drop("ci95_low", "ci95_high")
    out = R.bh_fdr(rep, [], "p_value", ["o_orderpriority"])
    return rounded(out, 4, t_stat=6, effect_size_dz=6, p_value=6, q_value=6)


@query("paired_report_ci", f"""
WITH {_PAIRS}, {_T}
SELECT o_orderpriority, n_pairs, round(mean_change - 1.96 * sd_change / sqrt(n_pairs), 4) AS ci95_low, round(mean_change + 1.96 * sd_change / sqrt(n_pairs), 4) AS ci95_high FROM t""")
def paired_report_ci(spark, sf):
    rep = R.paired_t(_pairs(spark, sf), ["o_orderpriority"], interval="z")
    return rounded(rep.select("o_orderpriority", "n_pairs", "ci95_low", "ci95_high"), 4)


@query("paired_report_t_ci", f"""
WITH RECURSIVE {_PAIRS}, {_T},
b AS (SELECT o_orderpriority, df, CAST(0 AS DOUBLE) AS lo, CAST(100 AS DOUBLE) AS hi, 0 AS i FROM t UNION ALL
  SELECT o_orderpriority, df, CASE WHEN p > 0.05 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN p > 0.05 THEN hi ELSE (lo + hi) / 2 END, i + 1
  FROM (SELECT *, {t_p_sql("((lo + hi) / 2)", "df")} AS p FROM b WHERE i < 55))
SELECT o_orderpriority, n_pairs, CAST(t.df AS DOUBLE) AS df, round(mean_change, 4) AS mean_change, round(mean_change - lo * sd_change / sqrt(n_pairs), 4) AS ci95_low,
  round(mean_change + lo * sd_change / sqrt(n_pairs), 4) AS ci95_high FROM t JOIN b USING (o_orderpriority) WHERE i = 55""")
def paired_report_t_ci(spark, sf):
    rep = R.paired_t(_pairs(spark, sf), ["o_orderpriority"])
    return rounded(rep.select("o_orderpriority", "n_pairs", "df", "mean_change", "ci95_low", "ci95_high"), 4)


@query("one_sample_deltas", f"""
WITH {_PAIRS}, t AS (SELECT o_orderpriority, count(v1 - v0) AS n, avg(v1 - v0) AS m, stddev_samp(v1 - v0) AS sd FROM e GROUP BY 1)
SELECT o_orderpriority, n, round(m, 4) AS mean_delta, round(m / sd, 6) AS effect_size_dz, round({t_p_sql("(m / (sd / sqrt(n)))", "(n - 1)")}, 6) AS p_value FROM t""")
def one_sample_deltas(spark, sf):
    d = _pairs(spark, sf).withColumn("delta", F.col("v1") - F.col("v0"))
    return rounded(R.one_sample_p(d, ["o_orderpriority"], "delta"), 6, mean_delta=4)


_SIGNED = """d AS (SELECT {k}, v1 - v0 AS d FROM e WHERE v0 IS NOT NULL AND v1 IS NOT NULL),
r AS (SELECT {k}, d, rank() OVER (PARTITION BY {k} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {k}, abs(d)) - 1) / 2.0 AS rk,
  count(*) OVER (PARTITION BY {k}, abs(d)) AS c FROM d WHERE d <> 0),
w AS (SELECT {k}, count(*) AS m, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS w, sum(c * c - 1) AS ties FROM r GROUP BY 1),
z AS (SELECT w.*, (least(w, m * (m + 1) / 2 - w) - m * (m + 1) / 4) / sqrt((m * (m + 1) * (2 * m + 1) - ties / 2) / 24) AS z FROM w)"""


def _wilcoxon_sql(k: str, pairs: str, name: str) -> str:
    """Signed-rank test with the null distribution enumerated sign by sign up to 20 pairs, normal beyond."""
    return f"""
WITH RECURSIVE {pairs},
{_SIGNED.format(k=k)}, n AS (SELECT {k}, count(*) AS n_pairs FROM d GROUP BY 1),
sub(n, i, s) AS (SELECT DISTINCT m, 0, CAST(0 AS BIGINT) FROM w WHERE m <= 20 UNION ALL
  SELECT n, i + 1, s + x.x * (i + 1) FROM sub, (VALUES (0), (1)) x(x) WHERE i < n),
cnt AS (SELECT n AS m, s, count(*) / pow(2, n) AS p FROM sub WHERE i = n GROUP BY 1, 2),
ex AS (SELECT {k}, least(1.0, 2 * least(sum(CASE WHEN s <= floor(w) THEN p ELSE 0 END), sum(CASE WHEN s >= floor(w) THEN p ELSE 0 END))) AS p FROM w JOIN cnt USING (m) GROUP BY {k})
SELECT z.{k} AS {name}, n_pairs, CAST(w AS DOUBLE) AS w_plus,
  round(CASE WHEN n_pairs < 2 THEN NULL WHEN n_pairs <= 20 AND n_pairs = m THEN p ELSE {chi2_p_sql("(z * z)")} END, 6) AS p_wilcoxon, n_pairs <= 20 AND n_pairs = m AS exact
FROM z JOIN n ON z.{k} = n.{k} LEFT JOIN ex ON ex.{k} = z.{k}"""


@query("wilcoxon_normal", _wilcoxon_sql("o_orderpriority", _PAIRS, "o_orderpriority"))
def wilcoxon_normal(spark, sf):
    return rounded(R.wilcoxon(_pairs(spark, sf), ["o_orderpriority"]))


@query("wilcoxon_exact", _wilcoxon_sql("g", """e AS (SELECT c_nationkey || ' ' || o_orderpriority AS g, o_custkey, avg(o_totalprice) FILTER (year(o_orderdate) < 1998) AS v0,
  avg(o_totalprice) FILTER (year(o_orderdate) >= 1998) AS v1 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)""", "nation_priority"))
def wilcoxon_exact(spark, sf):
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = order_sessions(spark, sf).join(cust, "o_custkey").withColumn("nation_priority", F.concat_ws(" ", F.col("c_nationkey").cast("string"), "o_orderpriority"))
    pairs = R.pair_sessions(orders, ["nation_priority", "o_custkey"], "session", ["o_totalprice"])
    return rounded(R.wilcoxon(pairs, ["nation_priority"], "o_totalprice_T0", "o_totalprice_T1"))


@query("mcnemar_labels", f"""
WITH m AS (SELECT lang, count(*) AS n_pairs, count(*) FILTER (quality = 1) AS p0, count(*) FILTER (toxic = 1) AS p1,
  count(*) FILTER (quality = 0 AND toxic = 1) AS b, count(*) FILTER (quality = 1 AND toxic = 0) AS c, count(*) FILTER (quality = 1 AND toxic = 1) AS d
  FROM labels JOIN documents USING (doc_id) GROUP BY 1),
x AS (SELECT *, CASE WHEN b + c = 0 THEN 0.0 ELSE pow(abs(b - c) - 1, 2) / (b + c) END AS chi2, p0 / n_pairs AS m0, p1 / n_pairs AS m1 FROM m),
y AS (SELECT *, sqrt((m0 * (1 - m0) + m1 * (1 - m1) - 2 * (d / n_pairs - m0 * m1)) / n_pairs) AS se FROM x)
SELECT lang, n_pairs, p0 AS "count_present_T0", p1 AS "count_present_T1", n_pairs - p0 AS "count_absent_T0", n_pairs - p1 AS "count_absent_T1", b, c,
  round(m0, 6) AS "mean_T0", round(m1, 6) AS "mean_T1", round(m1 - m0, 6) AS mean_change, round(chi2, 6) AS chi2, round(CASE WHEN se > 1e-12 THEN m1 - m0 - 1.96 * se END, 6) AS ci95_low, round(CASE WHEN se > 1e-12 THEN m1 - m0 + 1.96 * se END, 6) AS ci95_high,
  round(sqrt(chi2 / n_pairs), 6) AS phi, round(CASE WHEN b + c = 0 THEN 1.0 ELSE {chi2_p_sql("chi2")} END, 6) AS p_value FROM y""")
def mcnemar_labels(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    pairs = table(spark, sf, "labels").join(docs, "doc_id").select("lang", F.col("quality").alias("v0"), F.col("toxic").alias("v1"))
    return rounded(R.mcnemar(pairs, ["lang"]))


_SEG = """m AS (SELECT c_mktsegment AS grp, o_custkey, year(o_orderdate) < 1998 AS y, avg(o_totalprice) AS mean_price, CAST(count(*) AS DOUBLE) AS n_orders,
   CAST(max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS DOUBLE) AS any_urgent, CAST(max(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS DOUBLE) AS low_presence
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
u AS (UNPIVOT m ON mean_price, n_orders, any_urgent, low_presence INTO NAME metric VALUE value),
e AS (SELECT metric, grp, max(value) FILTER (y) AS v0, max(value) FILTER (NOT y) AS v1 FROM u GROUP BY metric, grp, o_custkey HAVING v0 IS NOT NULL AND v1 IS NOT NULL)"""


def _segment_metrics(spark, sf):
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("grp"))
    wide = order_sessions(spark, sf).join(cust, "o_custkey").groupBy("grp", "o_custkey", "session").agg(
        F.avg("o_totalprice").alias("mean_price"), F.count(F.lit(1)).alias("n_orders"),
        F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("any_urgent"),
        F.max((F.col("o_orderpriority") == "5-LOW").cast("int")).alias("low_presence"))
    long = R.unpivot_metrics(wide, ["grp", "o_custkey", "session"], ["mean_price", "n_orders", "any_urgent", "low_presence"])
    return R.pair_sessions(long, ["metric", "grp", "o_custkey"], "session", ["value"]).select(
        "metric", "grp", "o_custkey", F.col("value_T0").alias("v0"), F.col("value_T1").alias("v1"))


@query("paired_tests_dispatch", f"""
WITH {_SEG},
a AS (SELECT metric, grp, count(*) AS n, avg(v0) AS m0, avg(v1) AS m1, avg(v1 - v0) AS md, stddev_samp(v1 - v0) AS sd,
  count(*) FILTER (v0 = 0 AND v1 = 1) AS b, count(*) FILTER (v0 = 1 AND v1 = 0) AS c,
  CASE WHEN metric LIKE '%presence%' THEN 'chi2' WHEN metric = 'any_urgent' THEN 'mcnemar' ELSE 'paired_t' END AS test_type FROM e GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN test_type = 'paired_t' THEN md / (sd / sqrt(n)) WHEN b + c = 0 THEN 0 ELSE pow(abs(b - c) - 1, 2) / (b + c) END AS stat FROM a),
p AS (SELECT *, CASE WHEN test_type = 'paired_t' THEN {t_p_sql("stat", "(n - 1)")} ELSE {chi2_p_sql("abs(stat)")} END AS p_value FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p_value, metric) AS rk, count(*) OVER (PARTITION BY grp) AS mm FROM p)
SELECT metric, grp, n AS n_pairs, round(m0, 5) AS "mean_T0", round(m1, 5) AS "mean_T1", round(md, 5) AS mean_change, round(stat, 5) AS stat,
  CAST(CASE WHEN test_type = 'paired_t' THEN n - 1 ELSE 1 END AS DOUBLE) AS df, round(p_value, 5) AS p_value, round(CASE WHEN test_type = 'paired_t' THEN md / sd ELSE sqrt(stat / n) END, 5) AS effect,
  test_type, CASE WHEN md > 0 THEN 'increase' WHEN md < 0 THEN 'decrease' ELSE 'none' END AS direction,
  round(least(1, min(p_value * mm / rk) OVER (PARTITION BY grp ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 5) AS p_value_fdr FROM r""")
def paired_tests_dispatch(spark, sf):
    out = R.paired_tests(_segment_metrics(spark, sf), ["metric", "grp"]).drop("ci95_low", "ci95_high")
    return rounded(R.bh_fdr(out, ["grp"], "p_value", ["metric"], "p_value_fdr"), 5)


@query("effect_panel", f"""
WITH {_SEG}, a AS (SELECT metric, grp, count(*) AS n, avg(v1 - v0) AS md, stddev_samp(v1 - v0) AS sd FROM e GROUP BY 1, 2),
p AS (SELECT *, {t_p_sql("(md / (sd / sqrt(n)))", "(n - 1)")} AS p_value FROM a)
SELECT metric, grp, n, round(md, 5) AS mean_delta, round(md / sd, 5) AS effect_size_dz, round(p_value, 5) AS p_value,
  round(md / sd, 5) * CASE WHEN metric = 'any_urgent' THEN -1 ELSE 1 END AS improvement, p_value < 0.05 AS significant FROM p""")
def effect_panel(spark, sf):
    d = _segment_metrics(spark, sf).withColumn("delta", F.col("v1") - F.col("v0"))
    d = d.where("v0 is not null and v1 is not null")
    out = R.significance_panel(R.one_sample_p(d, ["metric", "grp"], "delta"), better_down=["any_urgent"])
    return rounded(out, 5)


N_PERM = 100
_CURVES = ", ".join(f"coalesce(sum(o_totalprice) FILTER (quarter(o_orderdate) = {i}), 0) AS q{i}" for i in (1, 2, 3, 4))
_OBS = " + ".join(f"abs(a{i} / n0 - (s{i} - a{i}) / n1)" for i in (1, 2, 3, 4))


@query("permutation_test", f"""
WITH u AS (SELECT o_orderpriority AS k, o_custkey, CASE WHEN year(o_orderdate) < 1998 THEN 'T0' ELSE 'T1' END AS sess, {_CURVES}
  FROM orders GROUP BY 1, 2, 3),
t AS (SELECT k, count(*) FILTER (sess = 'T0') AS n0, count(*) FILTER (sess = 'T1') AS n1, {", ".join(f"sum(q{i}) AS s{i}, sum(q{i}) FILTER (sess = 'T0') AS a{i}" for i in (1, 2, 3, 4))} FROM u GROUP BY 1),
o AS (SELECT *, ({_OBS}) / 4 AS obs FROM t),
d AS (SELECT u.*, p.p AS perm, row_number() OVER (PARTITION BY k, p.p ORDER BY md5(CAST(p.p AS VARCHAR) || ':' || o_custkey || ':' || sess)) AS rk FROM u, range(1, {N_PERM + 1}) p(p)),
g AS (SELECT d.k, perm, {", ".join(f"sum(q{i}) AS a{i}" for i in (1, 2, 3, 4))} FROM d JOIN t ON d.k = t.k WHERE rk <= n0 GROUP BY 1, 2),
z AS (SELECT g.k, ({_OBS.replace("a1", "g.a1").replace("a2", "g.a2").replace("a3", "g.a3").replace("a4", "g.a4")}) / 4 AS st, obs, n0, n1 FROM g JOIN o ON g.k = o.k)
SELECT k AS o_orderpriority, n0 AS "n_T0", n1 AS "n_T1", round(obs, 4) AS stat_observed, round((1 + count(*) FILTER (st >= obs * (1 - 1e-9))) / {N_PERM + 1}.0, 6) AS p_value,
  CAST({N_PERM} AS INTEGER) AS n_permutations FROM z GROUP BY k, n0, n1, obs""")
def permutation(spark, sf):
    by_q = [F.coalesce(F.sum(F.when(F.col("q") == i, F.col("o_totalprice"))), F.lit(0.0)) for i in (1, 2, 3, 4)]
    units = order_sessions(spark, sf).groupBy("o_orderpriority", "o_custkey", "session").agg(F.array(*by_q).alias("curve"))
    out = permutation_test(units, ["o_orderpriority"], "o_custkey", "session", "curve", 4, N_PERM)
    return rounded(out, 6, stat_observed=4)
