"""Clustering of component vectors, choice of K, and activations folded onto clusters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strideframe.operators.ordered import row_index
from strideframe.operators.similarity import unit
from strideframe.session import stage

#: Points of a class, and those compared at once.
BLOCK, TILE = 16_384, 1024


def fit_clusters(vectors: DataFrame, k: int, vector: str = "vector", weight: str | None = None, restarts: int = 10, seed: int = 42,
                 max_iter: int = 300) -> tuple[DataFrame, DataFrame, float]:
    """Distributed K-means, best of ``restarts`` seeds: (labelled vectors, unit-norm centroids, inertia)."""
    spark = vectors.sparkSession
    data = vectors.withColumn("_x", array_to_vector(F.col(vector).cast("array<double>"))).persist()
    best = None
    for r in range(restarts):
        est = KMeans(k=k, seed=seed + r, maxIter=max_iter, tol=1e-4, featuresCol="_x", predictionCol="meta_cluster")
        model = (est.setWeightCol(weight) if weight else est).fit(data)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    data.unpersist()
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(best.clusterCenters())], "cluster int, vector array<double>")
    return best.transform(data).drop("_x"), centres.withColumn("vector", unit(F.col("vector"))), float(best.summary.trainingCost)



def _cell_sums(key: tuple, rows: pa.Table) -> pa.Table:
    """Weighted sums of distances from each point of a cell's two classes to every cluster of the other class."""
    own, ids, w = (rows[c].to_numpy() for c in ("_own", "_i", "_w"))
    x = pc.list_flatten(rows["_x"]).to_numpy().reshape(len(ids), -1)
    c = pc.list_flatten(rows["_c"]).to_numpy().reshape(len(ids), -1)
    a, b = (np.flatnonzero(own == k.as_py()) for k in key)
    same = key[0].as_py() == key[1].as_py()

    def marks(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The set and the number of each cluster, and a row of weights for each point."""
        found = [np.unique(c[at, j], return_inverse=True) for j in range(c.shape[1])]
        which = np.concatenate([np.full(len(k), j) for j, (k, _) in enumerate(found)])
        return which, np.concatenate([k for k, _ in found]), np.hstack([(inv[:, None] == np.arange(len(k))) * w[at][:, None].astype(float) for k, inv in found])

    (set_a, k_a, m_a), (set_b, k_b, m_b) = marks(a), marks(b)
    sum_a, sum_b = np.zeros((len(a), len(k_b))), np.zeros((len(b), len(k_a)))
    square = np.einsum("ij,ij->i", x, x)
    for p in range(0, len(a), TILE):
        for q in range(0, len(b), TILE):
            i, j = a[p : p + TILE], b[q : q + TILE]
            d = x[i] @ x[j].T
            d *= -2
            d += square[i][:, None]
            d += square[j][None]
            np.sqrt(np.maximum(d, 0.0, out=d), out=d)
            if same and p == q:
                np.fill_diagonal(d, 0.0)
            sum_a[p : p + TILE] += d @ m_b[q : q + TILE]
            if not same:
                sum_b[q : q + TILE] += d.T @ m_a[p : p + TILE]
    sides = [(a, set_b, k_b, sum_a)] + ([] if same else [(b, set_a, k_a, sum_b)])
    out = [(np.repeat(ids[at], len(k)), np.tile(which, len(at)), np.tile(k, len(at)), sums.ravel()) for at, which, k, sums in sides]
    i, which, k, total = (np.concatenate(part) for part in zip(*out))
    return pa.table({"i": i.astype(np.int64), "j": which.astype(np.int32), "k": k.astype(np.int32), "s": total})


def block_grid(packed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two copies of a table of blocks numbered by ``_b``, whose join on (_row, _column) makes each pair of blocks meet once.

    The cells of the grid are about as many as the blocks.  A left block goes along its row, a right one down its column,
    so each is copied as often as the root of their number, and that is all that is shuffled.
    """
    side = F.ceil(F.sqrt(F.col("_b") + 1))
    side = packed.agg(F.max(side).alias("m")).scalar()
    own, every = F.col("_b") % side, F.explode(F.sequence(F.lit(0).cast("long"), side - 1))
    left = packed.withColumn("_row", own).select("*", every.alias("_column"))
    return left, packed.withColumn("_column", own).select("*", every.alias("_row"))


def silhouettes(labelled: DataFrame, idx: str, vector: str, clusters: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Mean Euclidean silhouette of each column of cluster numbers, in one row with those columns.

    NULL unless there are two clusters of at least two points each.  The plain (not squared) Euclidean score needs every
    distance, and each is taken once, for all columns and for both of its points.  Points with equal vectors and labels
    are one point with their number as weight.  Points are dealt to classes of at most ``block``; each two classes meet in
    a cell, which returns one sum per point and cluster, so distances are never emitted.
    """
    rows = labelled.select(F.col(idx).cast("long").alias("_i"), F.col(vector).cast("array<double>").alias("_x"), F.array(*[F.col(c).cast("int") for c in clusters]).alias("_c"))
    merged = rows.groupBy("_x", "_c").agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_w")).withColumn("_set", F.lit(0))
    points = stage(row_index(merged, ["_set"], "_first").select(F.col("idx").alias("_i"), "_x", "_c", "_w"))
    classes = max(1, -(-points.count() // block))
    sizes = points.select("_w", F.posexplode("_c").alias("j", "k")).groupBy("j", "k").agg(F.sum("_w").alias("_n"))
    other = points.withColumn("_own", F.col("_i") % classes).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(classes - 1).cast("long"))))
    cells = other.select(F.least("_own", "_other").alias("_a"), F.greatest("_own", "_other").alias("_b"), "_own", "_i", "_x", "_c", "_w")
    cells = cells.repartition(classes * (classes + 1) // 2, "_a", "_b") if classes > 1 else cells
    met = cells.groupBy("_a", "_b").applyInArrow(_cell_sums, "i long, j int, k int, s double")
    sums = met.groupBy("i", "j", "k").agg(F.sum("s").alias("_s")).join(sizes, ["j", "k"]).join(points.select(F.col("_i").alias("i"), "_c", "_w"), "i")
    inside = F.col("k") == F.get("_c", F.col("j"))
    own = sums.groupBy("i", "j").agg(
        F.max(F.when(inside & (F.col("_n") > 1), F.col("_s") / F.when(F.col("_n") > 1, F.col("_n") - 1))).alias("a"),
        F.min(F.when(~inside, F.col("_s") / F.col("_n"))).alias("b"), F.first("_w").alias("_w"))
    top = F.greatest("a", "b")
    score = F.when(F.col("a").isNull(), 0.0).otherwise(F.coalesce((F.col("b") - F.col("a")) / F.when(top > 0, top), F.lit(0.0)))
    means = own.groupBy("j").agg((F.sum(score * F.col("_w")) / F.sum("_w")).alias("mean"))
    enough = sizes.groupBy("j").agg(((F.min("_n") >= 2) & (F.count(F.lit(1)) >= 2)).alias("ok"))
    return means.join(enough, "j").agg(*[F.max(F.when((F.col("j") == j) & F.col("ok"), F.col("mean"))).alias(c) for j, c in enumerate(clusters)])


def silhouette(labelled: DataFrame, idx: str, vector: str = "vector", cluster: str = "meta_cluster", block: int = BLOCK) -> DataFrame:
    """`silhouettes` of one column, named silhouette."""
    return silhouettes(labelled, idx, vector, [cluster], block).select(F.col(cluster).alias("silhouette"))


def sweep_k(vectors: DataFrame, k_min: int = 2, k_max: int = 8, vector: str = "vector", idx: str = "idx", restarts: int = 10,
            seed: int = 42) -> DataFrame:
    """Inertia and silhouette for each K; the distances are taken once for all."""
    labelled, inertias, ks = vectors, [], list(range(k_min, k_max + 1))
    for k in ks:
        fitted, _, inertia = fit_clusters(labelled, k, vector, None, restarts, seed)
        labelled = fitted.withColumnRenamed("meta_cluster", f"_k{k}")
        inertias.append(inertia)
    scores = silhouettes(labelled, idx, vector, [f"_k{k}" for k in ks])
    return scores.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("inertia"), F.col(f"_k{k}").alias("silhouette")) for k, i in zip(ks, inertias)])))


def elbow(curve: DataFrame, keys: Sequence[str] = (), k: str = "k", inertia: str = "inertia") -> DataFrame:
    """K farthest from the chord between the first and last point; under three points the last K, flat chord the first.

    A curve has one row per K, so its window is small.
    """
    w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    run = w.orderBy(k).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    c = curve.withColumns({"_k0": F.first(k).over(run), "_k1": F.last(k).over(run), "_y0": F.first(inertia).over(run), "_y1": F.last(inertia).over(run),
                           "_n": F.count(F.lit(1)).over(w)})
    dk, dy = (F.col("_k1") - F.col("_k0")).cast("double"), F.col("_y1") - F.col("_y0")
    length = F.sqrt(dk * dk + dy * dy)
    dist = F.when(F.col("_n") < 3, F.col(k).cast("double")).when(length < 1e-12, -F.col(k).cast("double")).otherwise(
        F.abs(dk * (F.col(inertia) - F.col("_y0")) - dy * (F.col(k) - F.col("_k0"))) / F.when(length >= 1e-12, length))
    ranked = c.withColumn("_d", dist).withColumn("_r", F.row_number().over(w.orderBy(F.desc("_d"), k)))
    return ranked.where("_r = 1").select(*keys, F.col(k).alias("elbow_k"))


def presence(assigned: DataFrame, tasks: Sequence[str], n_clusters: int, cluster: str = "meta_cluster", sim: str = "similarity") -> DataFrame:
    """presence 0/1 and largest similarity per (task, cluster) on the full cluster grid."""
    hit = assigned.groupBy(*tasks).agg(*[F.max(F.when(F.col(cluster) == c, F.col(sim))).alias(f"_s{c}") for c in range(n_clusters)],
                                       *[F.count_if(F.col(cluster) == c).alias(f"_n{c}") for c in range(n_clusters)])
    rows = F.array(*[F.struct(F.lit(c).alias("cluster"), F.when(F.col(f"_n{c}") > 0, 1).otherwise(0).alias("presence"), F.col(f"_s{c}").alias("simmax"))
                     for c in range(n_clusters)])
    return hit.select(*tasks, F.inline(rows))


def cluster_activations(h: DataFrame, assigned: DataFrame, tasks: Sequence[str], n_clusters: int, comp: str = "comp", window: str = "window_index",
                        sample: str = "sample_idx", v: str = "h", cluster: str = "meta_cluster") -> DataFrame:
    """Sum component activations into every cluster; a cluster without components is all zeros."""
    link = assigned.select(*tasks, comp, cluster)
    joined = h.join(link, [*tasks, comp])
    sums = joined.groupBy(*tasks, window, sample).agg(
        *[F.sum(F.when(F.col(cluster) == c, F.col(v)).otherwise(0.0)).alias(f"_c{c}") for c in range(n_clusters)])
    rows = F.array(*[F.struct(F.lit(c).alias("cluster"), F.col(f"_c{c}").alias(v)) for c in range(n_clusters)])
    return sums.select(*tasks, window, sample, F.inline(rows))


def mean_similarity_matrix(assigned: DataFrame, groups: Sequence[str], comp: str = "comp", similarities: str = "similarities") -> DataFrame:
    """Average similarity per (group, component, cluster)."""
    rows = assigned.select(*groups, comp, F.posexplode(similarities).alias("cluster", "_s"))
    return rows.groupBy(*groups, comp, "cluster").agg(F.avg("_s").alias("mean_similarity"))


def order_channels(centroids: DataFrame, channels: Sequence[str], cluster: str = "cluster", vector: str = "vector") -> DataFrame:
    """Channels by dominant cluster (lowest on ties), then loading descending (a table of K x channels cells)."""
    names = F.array(*[F.lit(c) for c in channels])
    cells = centroids.select(cluster, F.posexplode(vector).alias("_i", "_w")).withColumn("channel", names[F.col("_i")])
    best = cells.withColumn("_r", F.row_number().over(W.partitionBy("channel").orderBy(F.desc("_w"), cluster))).where("_r = 1")
    pos = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(cluster, F.desc("_w"), "_i"))
    return best.select("channel", F.col(cluster).alias("dominant_cluster"), F.col("_w").alias("loading"), pos.alias("position"))
