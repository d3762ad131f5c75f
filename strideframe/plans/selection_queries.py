"""Goodness of fit and selection rules: `orders` prices quantised to k levels stand in for fits with k components."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.operators import clusters as K
from strideframe.operators import selection as V
from strideframe.operators.quantiles import exact_quantile
from strideframe.plans.registry import query, rounded, table

TASK = ["o_orderpriority", "y"]
LIMITS = {"reached": 0.985, "improvement": 0.0075}
LEVELS = 500_000.0


def channel_fits(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", F.year("o_orderdate").alias("y"), F.col("o_orderstatus").alias("channel"), F.col("o_totalprice").alias("x"))
    o = o.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(8))))
    o = o.withColumn("fit", (F.floor(F.col("x") * F.col("k") / LEVELS) + 0.5) * LEVELS / F.col("k"))
    return V.explained(o, [*TASK, "k"], "channel", "x", "fit")


_FITS = """x AS (SELECT o_orderpriority, year(o_orderdate) AS y, o_orderstatus AS channel, o_totalprice AS x, CAST(k.k AS INTEGER) AS k,
    (floor(o_totalprice * k.k / 500000.0) + 0.5) * 500000.0 / k.k AS fit FROM orders, range(1, 9) k(k)),
c AS (SELECT o_orderpriority, y, k, channel, sum(x * x) AS sst, sum(pow(x - fit, 2)) AS sse, count(*) AS n, 1 - sum(pow(x - fit, 2)) / sum(x * x) AS vaf FROM x GROUP BY 1, 2, 3, 4),
f AS (SELECT o_orderpriority, y, k, 1 - sum(sse) / sum(sst) AS global_vaf, avg(vaf) AS mean_channel_vaf, min(vaf) AS min_channel_vaf, sum(sse) AS rss, max(n) AS n_samples, count(*) AS n_channels FROM c GROUP BY 1, 2, 3),
i AS (SELECT *, n_samples * n_channels AS cells, k * (n_channels + n_samples) - k * k AS params FROM f),
s AS (SELECT *, cells * ln(rss / cells) + 2 * params AS aic, cells * ln(rss / cells) + ln(cells) * params AS bic FROM i)"""


@query("fit_by_k", f"""
WITH {_FITS} SELECT o_orderpriority, CAST(y AS INTEGER) AS y, k, round(global_vaf, 6) AS global_vaf, round(mean_channel_vaf, 6) AS mean_channel_vaf, round(min_channel_vaf, 6) AS min_channel_vaf,
  round(aic, 3) AS aic, round(bic, 3) AS bic, n_samples, n_channels, round(global_vaf - lag(global_vaf) OVER (PARTITION BY o_orderpriority, s.y ORDER BY k), 6) AS delta_vaf FROM s""")
def fit_by_k(spark, sf):
    out = V.vaf_gain(V.fit_summary(channel_fits(spark, sf), TASK), TASK)
    return rounded(out.drop("rss", "n_valid_channels"), 6, aic=3, bic=3)


_TRANS = f"""{_FITS},
l AS (SELECT *, CASE WHEN lead(k) OVER o = k + 1 THEN lead(vaf) OVER o END AS nv, min(vaf) OVER (PARTITION BY o_orderpriority, y, k) AS mn FROM c WINDOW o AS (PARTITION BY o_orderpriority, y, channel ORDER BY k)),
w AS (SELECT *, abs(vaf - mn) <= 1e-8 + 1e-5 * abs(mn) AS worst FROM l),
t AS (SELECT o_orderpriority, y, k, max(mn) AS min_valid_vaf, list(channel ORDER BY channel) FILTER (worst) AS wc, max(nv - vaf) FILTER (worst) AS mi,
  count(*) FILTER (worst) = count(nv - vaf) FILTER (worst) AND coalesce(max(nv - vaf) FILTER (worst) <= 0.0075, false) AS stop FROM w GROUP BY 1, 2, 3),
ch AS (SELECT o_orderpriority, y, min(k) FILTER (min_valid_vaf >= 0.985) AS c, min(k) FILTER (stop) AS d, max(k) AS km FROM t GROUP BY 1, 2),
sel AS (SELECT o_orderpriority, y, CASE WHEN c IS NOT NULL AND (d IS NULL OR c <= d) THEN c ELSE coalesce(d, km) END AS selected_k,
  CASE WHEN c IS NOT NULL AND (d IS NULL OR c <= d) THEN 'C' WHEN d IS NOT NULL THEN 'D' ELSE 'F' END AS criterion FROM ch)"""


@query("k_transitions", f"""
WITH {_TRANS} SELECT o_orderpriority, CAST(y AS INTEGER) AS y, k, CAST(k + 1 AS INTEGER) AS k_next, round(min_valid_vaf, 6) AS min_valid_vaf, array_to_string(wc, ',') AS worst_channels,
  round(mi, 6) AS max_improvement, stop AS would_stop FROM t""")
def k_transitions(spark, sf):
    t = V.transitions(channel_fits(spark, sf), TASK, LIMITS["improvement"])
    return rounded(t.withColumn("worst_channels", F.array_join("worst_channels", ",")).drop("n_valid", "n_invalid"))


@query("select_k", f"""
WITH {_TRANS} SELECT sel.o_orderpriority, CAST(sel.y AS INTEGER) AS y, selected_k, criterion, round(min_valid_vaf, 6) AS selected_min_vaf, array_to_string(wc, ',') AS selected_worst_channels
FROM sel JOIN t ON t.o_orderpriority = sel.o_orderpriority AND t.y = sel.y AND t.k = selected_k""")
def select_k(spark, sf):
    out = V.select_k(channel_fits(spark, sf), TASK, **LIMITS).drop("reason")
    return rounded(out.withColumn("selected_worst_channels", F.array_join("selected_worst_channels", ",")))


@query("secondary_k", f"""
WITH {_FITS} SELECT o_orderpriority, CAST(y AS INTEGER) AS y, coalesce(min(k) FILTER (global_vaf >= 0.9), max(k)) AS k_vaf_global, min(k) FILTER (aic = ma) AS k_aic, min(k) FILTER (bic = mb) AS k_bic,
  round(max(global_vaf), 6) AS best_global_vaf FROM (SELECT *, min(aic) OVER (PARTITION BY o_orderpriority, y) AS ma, min(bic) OVER (PARTITION BY o_orderpriority, y) AS mb FROM s) GROUP BY 1, 2""")
def secondary_k(spark, sf):
    return rounded(V.secondary_k(V.fit_summary(channel_fits(spark, sf), TASK), TASK))


@query("representative_tasks", f"""
WITH {_TRANS}, m AS (SELECT criterion, median(selected_k) AS mk FROM sel GROUP BY 1)
SELECT criterion, o_orderpriority, CAST(y AS INTEGER) AS y, selected_k FROM sel JOIN m USING (criterion)
QUALIFY row_number() OVER (PARTITION BY criterion ORDER BY abs(selected_k - mk), o_orderpriority, sel.y) = 1""")
def representative_tasks(spark, sf):
    sel = V.select_k(channel_fits(spark, sf), TASK, **LIMITS)
    return V.representatives(sel, TASK, exact_quantile(sel, ["criterion"], "selected_k", 0.5, "median_k"))


@query("k_histogram", f"WITH {_TRANS} SELECT selected_k, criterion, count(*) AS n_tasks FROM sel GROUP BY 1, 2")
def k_histogram(spark, sf):
    return V.k_histogram(V.select_k(channel_fits(spark, sf), TASK, **LIMITS))


@query("driver_frequency", f"""
WITH {_TRANS}, d AS (SELECT unnest(wc) AS channel FROM sel JOIN t ON t.o_orderpriority = sel.o_orderpriority AND t.y = sel.y AND t.k = selected_k WHERE criterion = 'D')
SELECT channel, count(*) AS n_stops FROM d GROUP BY 1""")
def driver_frequency(spark, sf):
    sel = V.select_k(channel_fits(spark, sf), TASK, **LIMITS).where("criterion = 'D'")
    return V.driver_frequency(sel, "selected_worst_channels")


@query("vaf_trajectory", f"""
WITH {_FITS} SELECT k, round(avg(global_vaf), 6) AS global_vaf_mean, round(stddev_samp(global_vaf) / sqrt(count(*)), 6) AS global_vaf_sem, count(*) AS global_vaf_n,
  round(avg(min_channel_vaf), 6) AS min_channel_vaf_mean, round(stddev_samp(min_channel_vaf) / sqrt(count(*)), 6) AS min_channel_vaf_sem, count(*) AS min_channel_vaf_n FROM s GROUP BY 1""")
def vaf_trajectory(spark, sf):
    return rounded(V.trajectory(V.fit_summary(channel_fits(spark, sf), TASK), ["global_vaf", "min_channel_vaf"]))


@query("elbow", f"""
WITH {_FITS}, p AS (SELECT o_orderpriority, k, sum(rss) / 1e12 AS rss FROM s GROUP BY 1, 2),
e AS (SELECT *, first_value(k) OVER o AS k0, last_value(k) OVER o AS k1, first_value(rss) OVER o AS y0, last_value(rss) OVER o AS y1 FROM p WINDOW o AS (PARTITION BY o_orderpriority ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT o_orderpriority, k AS elbow_k FROM e QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY abs((k1 - k0) * (rss - y0) - (y1 - y0) * (k - k0)) DESC, k) = 1""")
def elbow(spark, sf):
    curve = V.fit_summary(channel_fits(spark, sf), TASK).groupBy("o_orderpriority", "k").agg((F.sum("rss") / 1e12).alias("inertia"))
    return K.elbow(curve, ["o_orderpriority"])


@query("embedding_vaf", """
WITH c AS (SELECT label, d.d AS d, avg(CAST(embedding[d.d] AS DOUBLE)) AS m FROM embeddings, range(1, 65) d(d) GROUP BY 1, 2),
x AS (SELECT d.d AS d, CAST(embedding[d.d] AS DOUBLE) AS x, m FROM embeddings e, range(1, 65) d(d) JOIN c ON c.label = e.label AND c.d = d.d)
SELECT CAST(d - 1 AS INTEGER) AS channel, count(*) AS n, round(1 - sum(pow(x - m, 2)) / sum(x * x), 6) AS vaf FROM x GROUP BY 1""")
def embedding_vaf(spark, sf):
    x = table(spark, sf, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("channel", "x"))
    fit = x.groupBy("label", "channel").agg(F.avg("x").alias("fit"))
    return rounded(V.explained(x.join(fit, ["label", "channel"]), [], "channel", "x", "fit").select("channel", "n", "vaf"))
