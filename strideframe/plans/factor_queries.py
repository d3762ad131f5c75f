"""Factorisation over `orders`: per nation, samples are customers' price profiles over the five priorities."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.operators import factorize as N
from strideframe.operators import selection as V
from strideframe.operators import similarity as M
from strideframe.plans.cluster_queries import PRIORITIES
from strideframe.plans.registry import query, rounded, table

FIT = {"restarts": 2, "max_iter": 60}


def profiles(spark, sf):
    """One row per customer: nation and total price (in 1e5) per priority."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    cells = [F.coalesce(F.sum(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice"))), F.lit(0.0)) / 1e5 for p in PRIORITIES]
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array(*cells).alias("vector"))
    return per.join(c, "o_custkey")


@query("factor_fits")
def factor_fits(spark, sf):
    """Best fit per (nation, k): iterations, rss and global VAF."""
    fits = N.best_fits(N.factorize(profiles(spark, sf), ["c_nationkey"], [1, 2, 3], **FIT), ["c_nationkey"])
    total = F.aggregate("sst", F.lit(0.0), lambda a, x: a + x)
    return fits.select("c_nationkey", "k", "n_samples", "hit_max_iter", F.round("rss", 3).alias("rss"), F.round(1 - F.col("rss") / total, 4).alias("global_vaf"))


_IN = range(len(PRIORITIES))
_G = lambda i, j: f"g{min(i, j)}{max(i, j)}"
_MOVED = [" + ".join(f"{_G(i, j)} * w{j}" for j in _IN) for i in _IN]
_LENGTH = "sqrt(" + " + ".join(f"pow({m}, 2)" for m in _MOVED) + ")"
_TRACE = " + ".join(_G(i, i) for i in _IN)


@query("factor_rank_one", f"""
WITH RECURSIVE p AS (SELECT o_custkey, {", ".join(f"coalesce(sum(o_totalprice) FILTER (o_orderpriority = '{p}'), 0) / 1e5 AS x{i}" for i, p in enumerate(PRIORITIES))} FROM orders GROUP BY 1),
g AS (SELECT c_nationkey, count(*) AS n_samples, {", ".join(f"sum(x{i} * x{j}) AS {_G(i, j)}" for i in _IN for j in _IN if i <= j)} FROM p JOIN customer ON c_custkey = o_custkey GROUP BY 1),
w AS (SELECT g.*, {", ".join(f"CAST(1 AS DOUBLE) AS w{i}" for i in _IN)}, 0 AS step FROM g UNION ALL
  SELECT c_nationkey, n_samples, {", ".join(_G(i, j) for i in _IN for j in _IN if i <= j)}, {", ".join(f"({m}) / {_LENGTH}" for m in _MOVED)}, step + 1 FROM w WHERE step < 200)
SELECT c_nationkey, n_samples, {", ".join(f"round(w{i}, 4) AS w{i}" for i in _IN)},
  round(({" + ".join(f"w{i} * ({m})" for i, m in enumerate(_MOVED))}) / ({_TRACE}), 5) AS global_vaf FROM w WHERE step = 200""")
def factor_rank_one(spark, sf):
    """One component per nation: with non-negative samples the alternation is a power iteration, which SQL can run."""
    fits = N.factorize(profiles(spark, sf), ["c_nationkey"], [1], restarts=1, max_iter=400, tol=1e-13)
    total = F.aggregate("sst", F.lit(0.0), lambda a, x: a + x)
    shown = [F.round(F.col("weights")[0][i], 4).alias(f"w{i}") for i in _IN]
    return fits.select("c_nationkey", "n_samples", *shown, F.round(1 - F.col("rss") / total, 5).alias("global_vaf"))


@query("factor_select_k")
def factor_select_k(spark, sf):
    """Number of components per nation by the ordered rule."""
    best = N.best_fits(N.factorize(profiles(spark, sf), ["c_nationkey"], [1, 2, 3, 4], **FIT), ["c_nationkey"])
    return rounded(V.select_k(N.channel_table(best, ["c_nationkey"], PRIORITIES), ["c_nationkey"]), 4)


@query("factor_stability")
def factor_stability(spark, sf):
    """Similarity of the components across restarts."""
    fits = N.factorize(profiles(spark, sf), ["c_nationkey"], [2, 3], **FIT).where("status = 'ok'")
    return rounded(M.restart_stability(N.components(fits, ["c_nationkey", "k", "restart"]), ["c_nationkey", "k"]), 4)


_NNLS = """CASE WHEN det > 0 AND (b1 * g22 - b2 * g12) / det >= 0 AND (b2 * g11 - b1 * g12) / det >= 0 THEN (b1 * g22 - b2 * g12) / det
  WHEN det > 0 AND (b2 * g11 - b1 * g12) / det < 0 THEN greatest(b1 / g11, 0) ELSE 0 END AS h1,
  CASE WHEN det > 0 AND (b1 * g22 - b2 * g12) / det >= 0 AND (b2 * g11 - b1 * g12) / det >= 0 THEN (b2 * g11 - b1 * g12) / det
  WHEN det > 0 AND (b2 * g11 - b1 * g12) / det < 0 THEN 0 ELSE greatest(b2 / g22, 0) END AS h2"""


@query("nnls_k2", f"""
WITH x AS (SELECT o_orderpriority, month(o_orderdate) AS m, sum(o_totalprice) / 1e6 AS v FROM orders GROUP BY 1, 2),
g AS (SELECT o_orderpriority, CAST(sum(1) AS DOUBLE) AS g11, CAST(sum(m) AS DOUBLE) AS g12, CAST(sum(m * m) AS DOUBLE) AS g22, sum(v) AS b1, sum(m * v) AS b2 FROM x GROUP BY 1),
d AS (SELECT *, g11 * g22 - g12 * g12 AS det FROM g)
SELECT o_orderpriority, round(h1, 6) AS h1, round(h2, 6) AS h2 FROM (SELECT o_orderpriority, {_NNLS} FROM d)""")
def nnls_k2(spark, sf):
    x = table(spark, sf, "orders").groupBy("o_orderpriority", F.month("o_orderdate").alias("m")).agg((F.sum("o_totalprice") / 1e6).alias("v"))
    m = F.col("m").cast("double")
    g = x.groupBy("o_orderpriority").agg(F.sum(F.lit(1.0)).alias("g11"), F.sum(m).alias("g12"), F.sum(m * m).alias("g22"), F.sum("v").alias("b1"), F.sum(m * F.col("v")).alias("b2"))
    h1, h2 = N.nnls_two(*[F.col(c) for c in ("g11", "g12", "g22", "b1", "b2")])
    return rounded(g.select("o_orderpriority", h1.alias("h1"), h2.alias("h2")))


@query("nnls_activations", f"""
WITH p AS (SELECT o_custkey, {", ".join(f"coalesce(sum(o_totalprice) FILTER (o_orderpriority = '{p}'), 0) / 1e5 AS x{i}" for i, p in enumerate(PRIORITIES))} FROM orders GROUP BY 1),
g AS (SELECT *, CAST(3.25 AS DOUBLE) AS g11, CAST(2 AS DOUBLE) AS g12, CAST(3.25 AS DOUBLE) AS g22, CAST(3.25 * 3.25 - 4 AS DOUBLE) AS det,
  x0 + x1 + x2 + 0.5 * x3 AS b1, 0.5 * x1 + x2 + x3 + x4 AS b2 FROM p WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey))
SELECT o_custkey, round(h1, 6) AS h1, round(h2, 6) AS h2 FROM (SELECT o_custkey, {_NNLS} FROM g)""")
def nnls_activations(spark, sf):
    """Two overlapping components (early and late priorities) fitted to every customer by the general solver."""
    w = spark.range(1).select(F.array(F.array(*[F.lit(float(v)) for v in (1, 1, 1, 0.5, 0)]), F.array(*[F.lit(float(v)) for v in (0, 0.5, 1, 1, 1)])).alias("weights"))
    rows = profiles(spark, sf)
    weights = rows.select("c_nationkey").distinct().withColumn("weights", w.scalar())
    h = N.activations(rows, weights, ["c_nationkey"], ["o_custkey"])
    return rounded(h.select("o_custkey", F.col("h")[0].alias("h1"), F.col("h")[1].alias("h2")))
