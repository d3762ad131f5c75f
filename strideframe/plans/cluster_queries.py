"""Component similarity, clusters and folded activations over `embeddings`, `orders` and `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.operators import clusters as K
from strideframe.operators import segments as S
from strideframe.operators import signals as G
from strideframe.operators import similarity as M
from strideframe.operators.ordered import row_index
from strideframe.plans.quality_queries import _CURVES, event_grid
from strideframe.plans.registry import EVENT_TYPES, query, rounded, table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("vector"))


def label_centroids(vecs):
    """Unit-norm mean vector per label."""
    means = vecs.select("cluster", F.posexplode("vector").alias("_i", "_x")).groupBy("cluster", "_i").agg(F.avg("_x").alias("_x"))
    return means.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_v")).select(
        "cluster", M.unit(F.transform("_v", lambda s: s["_x"])).alias("vector"))


_CENTROIDS = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
c AS (SELECT label AS cluster, list(m ORDER BY i) AS cv FROM (SELECT label, i.i AS i, avg(v[i.i]) AS m FROM e, range(1, 65) i(i) GROUP BY 1, 2) GROUP BY 1),
sim AS (SELECT vec_id, label, cluster, list_dot_product(v, cv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(cv, cv))) AS s FROM e, c)"""


@query("nearest_centroid", f"""
WITH {_CENTROIDS} SELECT vec_id, cluster AS meta_cluster, round(s, 6) AS similarity FROM sim QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cluster) = 1""")
def nearest_centroid(spark, sf):
    v = vectors(spark, sf)
    return rounded(M.nearest_centroid(v, label_centroids(v)).select("vec_id", "meta_cluster", "similarity"))


@query("similarity_matrix", f"""
WITH {_CENTROIDS} SELECT label AS grp, CAST(dense_rank() OVER (ORDER BY cluster) - 1 AS INTEGER) AS cluster, round(avg(s), 6) AS mean_similarity FROM sim GROUP BY label, sim.cluster""")
def similarity_matrix(spark, sf):
    v = vectors(spark, sf)
    scored = M.nearest_centroid(v, label_centroids(v), with_all=True).withColumnRenamed("cluster", "grp")
    return rounded(K.mean_similarity_matrix(scored.withColumn("comp", F.lit(0)), ["grp"]).select("grp", "cluster", "mean_similarity"))


@query("cluster_presence", f"""
WITH {_CENTROIDS}, b AS (SELECT * FROM sim QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cluster) = 1),
g AS (SELECT DISTINCT label AS task FROM embeddings)
SELECT task, CAST(k.k AS INTEGER) AS cluster, CAST(CASE WHEN count(b.vec_id) > 0 THEN 1 ELSE 0 END AS INTEGER) AS presence, round(max(s), 6) AS simmax
FROM g CROSS JOIN range(0, 10) k(k) LEFT JOIN b ON b.label = task AND b.cluster = k.k GROUP BY 1, 2""")
def cluster_presence(spark, sf):
    v = vectors(spark, sf)
    assigned = M.nearest_centroid(v, label_centroids(v)).withColumnRenamed("cluster", "task")
    return rounded(K.presence(assigned, ["task"], 10))


@query("channel_order", f"""
WITH {_CENTROIDS}, u AS (SELECT cluster, i.i AS i, cv[i.i] / sqrt(list_dot_product(cv, cv)) AS w FROM c, range(1, 65) i(i)),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY i ORDER BY w DESC, cluster) = 1)
SELECT 'd' || (i - 1) AS channel, cluster AS dominant_cluster, round(w, 6) AS loading, CAST(row_number() OVER (ORDER BY cluster, w DESC, i) AS INTEGER) AS position FROM b""")
def channel_order(spark, sf):
    return rounded(K.order_channels(label_centroids(vectors(spark, sf)), [f"d{i}" for i in range(64)]))


YEAR, SESSION, WHOLE = "year(o_orderdate)", "if(year(o_orderdate) < 1998, 0, 1)", "0"


def order_weights(spark, sf, period=YEAR):
    """Weights per nation and period y: component = order status, channel = priority, weight = total price."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", F.expr(period).alias("y"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    comp = F.array_position(F.array(F.lit("F"), F.lit("O"), F.lit("P")), F.col("o_orderstatus")).cast("int") - 1
    return o.join(c, "o_custkey").groupBy("c_nationkey", "y", comp.alias("comp"), F.col("o_orderpriority").alias("channel")).agg(
        F.sum("o_totalprice").alias("weight"))


_WEIGHTS = """w AS (SELECT c_nationkey, year(o_orderdate) AS y, CAST(instr('FOP', o_orderstatus) - 1 AS INTEGER) AS comp, o_orderpriority AS channel, sum(o_totalprice) AS weight
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
nt AS (SELECT count(*) AS n FROM (SELECT DISTINCT c_nationkey, y FROM w)),
cc AS (SELECT channel FROM (SELECT DISTINCT c_nationkey, y, channel FROM w) GROUP BY 1 HAVING count(*) = (SELECT n FROM nt)),
g AS (SELECT DISTINCT c_nationkey, y, comp FROM w),
u AS (SELECT g.c_nationkey, g.y, g.comp, cc.channel, coalesce(coalesce(weight, 0) / nullif(sqrt(sum(coalesce(weight, 0) * coalesce(weight, 0)) OVER (PARTITION BY g.c_nationkey, g.y, g.comp)), 0), 0) AS weight
  FROM g CROSS JOIN cc LEFT JOIN w ON w.c_nationkey = g.c_nationkey AND w.y = g.y AND w.comp = g.comp AND w.channel = cc.channel),
ps AS (SELECT a.c_nationkey, a.y AS ya, b.y AS yb, a.comp AS ca, b.comp AS cb, sum(a.weight * b.weight) AS s FROM u a JOIN u b ON a.c_nationkey = b.c_nationkey AND a.channel = b.channel AND a.y < b.y GROUP BY ALL),
pm AS (SELECT * FROM (VALUES (0,1,2),(0,2,1),(1,0,2),(1,2,0),(2,0,1),(2,1,0)) p(p0,p1,p2)),
al AS (SELECT c_nationkey, ya, yb, CASE WHEN max(na) = max(nb) THEN max(t) / max(na) END AS w_similarity FROM (SELECT c_nationkey, ya, yb, p0, p1, p2, count(DISTINCT ca) AS na, count(DISTINCT cb) AS nb,
  coalesce(sum(s) FILTER (ca = p0 AND cb = 0), 0) + coalesce(sum(s) FILTER (ca = p1 AND cb = 1), 0) + coalesce(sum(s) FILTER (ca = p2 AND cb = 2), 0) AS t
  FROM ps, pm GROUP BY ALL) GROUP BY ALL)"""


_BY_SESSION = _WEIGHTS.replace(f"{YEAR} AS y", f"CASE WHEN {YEAR} < 1998 THEN 0 ELSE 1 END AS y")


def _stacked(spark, sf, period=YEAR):
    return M.stack_components(order_weights(spark, sf, period), ["c_nationkey", "y"])


@query("stack_components", f"""
WITH {_WEIGHTS} SELECT c_nationkey, CAST(y AS INTEGER) AS y, u.comp, channel, round(weight, 6) AS weight, round(1.0 / count(*) OVER (PARTITION BY c_nationkey, y, channel), 6) AS sample_weight FROM u""")
def stack_components(spark, sf):
    s = _stacked(spark, sf)
    return rounded(s.select("c_nationkey", "y", "comp", F.inline(F.zip_with("channels", "vector", lambda c, w: F.struct(c.alias("channel"), w.alias("weight")))), "sample_weight"))


@query("component_similarity", f"""
WITH {_BY_SESSION} SELECT c_nationkey, round(w_similarity, 6) AS w_similarity FROM al""")
def component_similarity(spark, sf):
    s = _stacked(spark, sf, SESSION)
    return rounded(M.component_similarity(s.where("y = 1"), s.where("y = 0"), ["c_nationkey"]))


@query("restart_stability", f"""
WITH {_WEIGHTS} SELECT c_nationkey, round(avg(w_similarity), 6) AS stability_mean, round(stddev_pop(w_similarity), 6) AS stability_std, count(w_similarity) AS n_restart_pairs FROM al GROUP BY 1""")
def restart_stability(spark, sf):
    return rounded(M.restart_stability(_stacked(spark, sf), ["c_nationkey"], restart="y"))


@query("weight_sparsity", """
WITH w AS (SELECT c_nationkey, o_orderstatus AS comp, o_orderpriority AS channel, sum(o_totalprice) AS weight FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_nationkey, round(avg(a), 6) AS w_sparsity FROM (SELECT c_nationkey, comp, avg(CASE WHEN weight >= 0.1 * top THEN 1.0 ELSE 0 END) AS a
  FROM (SELECT *, max(weight) OVER (PARTITION BY c_nationkey, comp) AS top FROM w) GROUP BY 1, 2) GROUP BY 1""")
def weight_sparsity(spark, sf):
    return rounded(M.sparsity(order_weights(spark, sf, WHOLE), ["c_nationkey"]))


@query("aligned_weights", f"""
WITH {_WEIGHTS}, r AS (SELECT c_nationkey, comp, channel, weight FROM u WHERE y = 1995),
s AS (SELECT u.c_nationkey, u.y, u.comp AS ca, r.comp AS cb, sum(u.weight * r.weight) AS s FROM u JOIN r ON u.c_nationkey = r.c_nationkey AND u.channel = r.channel GROUP BY ALL),
t AS (SELECT c_nationkey, y, p0, p1, p2, sum(s) FILTER (ca = p0 AND cb = 0) + sum(s) FILTER (ca = p1 AND cb = 1) + sum(s) FILTER (ca = p2 AND cb = 2) AS t FROM s, pm GROUP BY ALL),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY c_nationkey, y ORDER BY t DESC) = 1),
x AS (SELECT u.y, CASE u.comp WHEN p0 THEN 0 WHEN p1 THEN 1 ELSE 2 END AS ref_comp, channel, weight FROM u JOIN b ON u.c_nationkey = b.c_nationkey AND u.y = b.y)
SELECT CAST(ref_comp AS INTEGER) AS ref_comp, channel, round(avg(weight) FILTER (y < 1998), 6) AS "w_T0", round(avg(weight) FILTER (y >= 1998), 6) AS "w_T1",
  round(avg(weight) FILTER (y >= 1998) - avg(weight) FILTER (y < 1998), 6) AS w_delta FROM x GROUP BY 1, 2""")
def aligned_weights(spark, sf):
    s = _stacked(spark, sf)
    w = s.withColumn("session", F.when(F.col("y") < 1998, "T0").otherwise("T1"))
    years = w.select("c_nationkey", "y").distinct()
    ref = s.where("y = 1995").drop("y").join(years, "c_nationkey")
    return rounded(M.aligned_mean_weights(w, ref, ["c_nationkey", "y"], [], "session", PRIORITIES))


@query("activation_profile_similarity", """
WITH h AS (SELECT c_nationkey, month(o_orderdate) AS w, avg(o_totalprice) FILTER (year(o_orderdate) < 1998) AS a, avg(o_totalprice) FILTER (year(o_orderdate) >= 1998) AS b
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT c_nationkey, round(corr(a, b), 6) AS h_profile_similarity FROM h WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""")
def activation_profile_similarity(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_totalprice").alias("h"), F.month("o_orderdate").alias("window_index"), F.year("o_orderdate").alias("y"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    h = o.join(c, "o_custkey").withColumn("session", F.when(F.col("y") < 1998, "T0").otherwise("T1"))
    return rounded(M.activation_profile_similarity(h, ["c_nationkey"], "session"))


# comp = event type, cluster from its mean level; cluster 3 is never used and must come out as zeros
_META = f"""{_CURVES},
asg AS (SELECT user_id AS entity, event_type AS channel, CAST(least(2, floor(avg(value) / 10)) AS INTEGER) AS meta_cluster FROM events GROUP BY 1, 2),
hm AS (SELECT c.entity, k.k AS cluster, phase_idx, sum(CASE WHEN meta_cluster = k.k THEN v ELSE 0 END) AS h FROM curves c JOIN asg USING (entity, channel), range(0, 4) k(k) GROUP BY ALL)"""


def event_assignment(spark, sf):
    level = table(spark, sf, "events").groupBy(F.col("user_id").alias("entity"), F.col("event_type").alias("comp")).agg(F.avg("value").alias("_m"))
    return level.select("entity", "comp", F.least(F.lit(2), F.floor(F.col("_m") / 10)).cast("int").alias("meta_cluster"))


def folded(spark, sf):
    h = event_grid(spark, sf).select("entity", F.col("channel").alias("comp"), F.lit(0).alias("window_index"), F.col("phase_idx").alias("sample_idx"), F.col("v").alias("h"))
    return K.cluster_activations(h, event_assignment(spark, sf), ["entity"], 4)


@query("cluster_activations", f"WITH {_META} SELECT entity, CAST(cluster AS INTEGER) AS cluster, CAST(phase_idx AS INTEGER) AS sample_idx, round(h, 5) AS h FROM hm")
def cluster_activations(spark, sf):
    return rounded(folded(spark, sf).select("entity", "cluster", "sample_idx", "h"), 5)


@query("activation_summary", f"""
WITH {_META}, p AS (SELECT *, max(h) OVER (PARTITION BY entity, cluster) AS pk, phase_idx / 100.0 AS ph FROM hm)
SELECT entity, CAST(cluster AS INTEGER) AS cluster, round(avg(h), 5) AS mean, round(max(h), 5) AS max, round(sum(h * CASE WHEN phase_idx IN (0, 100) THEN 0.005 ELSE 0.01 END), 5) AS auc,
  round(CASE WHEN sum(h) > 1e-12 THEN sum(ph * h) / sum(h) END, 5) AS centroid, round(min(CASE WHEN h = pk THEN ph END), 5) AS peak_time FROM p GROUP BY 1, 2""")
def activation_summary(spark, sf):
    per_window = G.activation_summary(folded(spark, sf), ["entity", "window_index", "cluster"])
    means = per_window.groupBy("entity", "cluster").agg(*[F.avg(c).alias(c) for c in ("mean", "max", "auc", "centroid", "peak_time")])
    return rounded(means, 5)


@query("present_curves", f"""
WITH {_META} SELECT CAST(hm.cluster AS INTEGER) AS cluster, CAST(phase_idx AS INTEGER) AS phase_idx, round(avg(h), 5) AS mean, count(DISTINCT hm.entity) AS n_subjects
FROM hm WHERE EXISTS (SELECT 1 FROM asg WHERE asg.entity = hm.entity AND asg.meta_cluster = hm.cluster) GROUP BY 1, 2""")
def present_curves(spark, sf):
    present = event_assignment(spark, sf).select("entity", F.col("meta_cluster").alias("cluster")).distinct()
    kept = folded(spark, sf).join(present, ["entity", "cluster"], "left_semi")
    return rounded(kept.groupBy("cluster", F.col("sample_idx").alias("phase_idx")).agg(F.avg("h").alias("mean"), F.count_distinct("entity").alias("n_subjects")), 5)


@query("summary_consistency", f"""
WITH {_META}, a AS (SELECT cluster, avg(m) AS s FROM (SELECT cluster, entity, avg(h) AS m FROM hm GROUP BY 1, 2) GROUP BY 1), b AS (SELECT cluster, avg(h) AS c FROM hm GROUP BY 1)
SELECT CAST(cluster AS INTEGER) AS cluster, round(s, 5) AS summary_mean, round(c, 5) AS curve_mean, abs(s - c) < 0.01 AS consistent FROM a JOIN b USING (cluster)""")
def summary_consistency(spark, sf):
    from strideframe.operators.checks import means_agree

    h = folded(spark, sf)
    tasks = h.groupBy("entity", "cluster").agg(F.avg("h").alias("mean"))
    return rounded(means_agree(tasks, "mean", h, "h", ["cluster"]), 5)


@query("window_profile", f"""
WITH {_CURVES}, hw AS (SELECT entity, channel, phase_idx // 10 AS w, avg(v) AS y FROM curves GROUP BY ALL),
k AS (SELECT entity, channel, max(w) AS n FROM hw GROUP BY 1, 2),
g AS (SELECT i AS phase_idx, i / 100.0 AS ph FROM range(101) r(i)),
p AS (SELECT entity, channel, CAST(w AS DOUBLE) / n AS p0, y, lead(CAST(w AS DOUBLE) / n) OVER o AS p1, lead(y) OVER o AS ny FROM hw JOIN k USING (entity, channel) WINDOW o AS (PARTITION BY entity, channel ORDER BY w))
SELECT channel, CAST(phase_idx AS INTEGER) AS phase_idx, round(avg(CASE WHEN p1 IS NULL THEN y ELSE y + (ny - y) * (ph - p0) / (p1 - p0) END), 5) AS mean
FROM g JOIN p ON p0 <= ph AND (p1 IS NULL OR ph < p1) GROUP BY 1, 2""")
def window_profile(spark, sf):
    """Window means of an activation read as a 101-point profile, averaged per component."""
    per_window = event_grid(spark, sf).groupBy("entity", "channel", F.floor(F.col("phase_idx") / 10).alias("w")).agg(F.avg("v").alias("v"))
    curves = S.phase_grid(per_window, ["entity", "channel"], "w")
    return rounded(curves.groupBy("channel", "phase_idx").agg(F.avg("v").alias("mean")), 5)


@query("kmeans_clusters")
def kmeans_clusters(spark, sf):
    """K-means on unit vectors: cluster sizes and total inertia."""
    v = vectors(spark, sf).withColumn("vector", M.unit(F.col("vector")))
    labelled, _, inertia = K.fit_clusters(v, 4, restarts=3)
    return labelled.groupBy("meta_cluster").agg(F.count(F.lit(1)).alias("n"), F.lit(round(inertia, 6)).alias("inertia"))


@query("cluster_count_sweep")
def cluster_count_sweep(spark, sf):
    """Inertia, silhouette and elbow for K = 2..4."""
    v = row_index(vectors(spark, sf).withColumn("all", F.lit(1)), ["all"], "vec_id").select("idx", "vector")
    curve = K.sweep_k(v, 2, 4, restarts=1)
    return curve.join(K.elbow(curve).withColumnRenamed("elbow_k", "k").withColumn("is_elbow", F.lit(True)), "k", "left")


@query("label_silhouette", """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.vec_id, a.label, b.label AS k, sum(sqrt(greatest(list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v) - 2 * list_dot_product(a.v, b.v), 0))) FILTER (a.vec_id <> b.vec_id) AS s, count(*) AS n FROM e a, e b GROUP BY ALL),
p AS (SELECT vec_id, max(CASE WHEN label = k THEN s / (n - 1) END) AS a, min(CASE WHEN label <> k THEN s / n END) AS b FROM d GROUP BY 1)
SELECT round(avg((b - a) / greatest(a, b)), 5) AS silhouette FROM p""")
def label_silhouette(spark, sf):
    v = row_index(vectors(spark, sf).withColumn("all", F.lit(1)), ["all"], "vec_id").withColumnRenamed("cluster", "meta_cluster")
    return rounded(K.silhouette(v, "idx"), 5)
