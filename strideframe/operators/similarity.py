"""Component matrices: unit vectors, cosine similarity, one-to-one alignment.

Component counts and channel lists are small by nature (k up to about a dozen), so a component is one
row with an array, and a k x k similarity matrix fits in one row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from strideframe.functions.numeric import corr_guarded

CENTROID_BYTES = 256 << 20
ROWS_AT_ONCE = 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean norm, 1 for (near) zero vectors."""
    n = F.sqrt(dot(a, a))
    return F.when(n < 1e-12, 1.0).otherwise(n)


def unit(a: Column) -> Column:
    # the one-element array binds the norm, so it is computed once and not per element
    return F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x / n))[0]


def unit_columns(w: DataFrame, task: Sequence[str], comp: str = "comp", weight: str = "weight") -> DataFrame:
    """L2-normalise every component of long weights, keeping its norm to rescale activations."""
    sq = w.groupBy(*task, comp).agg(F.sqrt(F.sum(F.col(weight) * F.col(weight))).alias("norm"))
    safe = F.when(F.col("norm") > 1e-12, F.col("norm")).otherwise(1.0)
    return w.join(sq, [*task, comp]).withColumn("norm", safe).withColumn(weight, F.col(weight) / F.col("norm"))


def stack_components(w: DataFrame, task: Sequence[str], comp: str = "comp", channel: str = "channel", weight: str = "weight") -> DataFrame:
    """Unit vectors over the channels that every task has, in name order, with weight 1/k per task.

    Returns task, comp, vector, channels, k, sample_weight; no rows when no channel is common to all.
    """
    w = w.where(F.col(weight).isNotNull())
    tasks = w.select(*task).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    common = w.select(*task, channel).distinct().groupBy(channel).agg(F.count(F.lit(1)).alias("_t")).where(F.col("_t") == tasks)
    names = common.agg(F.array_sort(F.collect_list(channel)).alias("names")).scalar()
    w = w.groupBy(*task, comp, channel).agg(F.max(weight).alias(weight))  # rows that repeat a channel count once
    rows = w.groupBy(*task, comp).agg(F.map_from_entries(F.collect_list(F.struct(channel, F.col(weight).cast("double")))).alias("_m"))
    rows = rows.withColumn("channels", names).where(F.size("channels") > 0).withColumn(
        "vector", F.transform("channels", lambda c: F.coalesce(F.try_element_at(F.col("_m"), c), F.lit(0.0))))
    k = F.count(F.lit(1)).over(W.partitionBy(*task))
    return rows.select(*task, comp, unit(F.col("vector")).alias("vector"), "channels", k.alias("k"), (1.0 / k).alias("sample_weight"))


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, vector: str = "vector", cluster: str = "cluster", centre: str = "vector",
                     with_all: bool = False) -> DataFrame:
    """Add ``meta_cluster`` and ``similarity`` by largest cosine, lowest cluster on ties; a narrow map, no join.

    The centroids are a model and are shipped with the task, up to CENTROID_BYTES; vectors meet them in blocks.
    ``with_all`` also adds ``similarities``, the row of the similarity matrix in cluster order.  A NULL vector has
    NULL results, as has every vector when there are no centroids.
    """
    ordered = centroids.where(F.col(centre).isNotNull()).select(F.col(cluster).cast("int").alias("c"), F.col(centre).alias("v"))
    size = ordered.agg(F.coalesce(F.sum(8 * F.size("v")), F.lit(0))).first()[0]
    if size > CENTROID_BYTES:
        raise ValueError(f"centroids of {size} bytes; a model of at most {CENTROID_BYTES} is expected")
    rows = ordered.orderBy("c").collect()
    ids = np.array([r["c"] for r in rows], dtype=int)
    centres = np.array([r["v"] for r in rows], dtype=float) if rows else np.zeros((0, 1))
    lengths = np.linalg.norm(centres, axis=1, keepdims=True)
    centres = centres / np.where(lengths < 1e-12, 1.0, lengths)
    fields = [T.StructField("c", T.IntegerType()), T.StructField("s", T.DoubleType())]
    fields += [T.StructField("all", T.ArrayType(T.DoubleType()))] if with_all else []

    @F.pandas_udf(T.StructType(fields))
    def score(v: pd.Series) -> pd.DataFrame:
        names = ["c", "s", "all"] if with_all else ["c", "s"]
        out = pd.DataFrame({n: [None] * len(v) for n in names}, dtype=object)
        there = np.flatnonzero(v.notna().to_numpy())
        for at in range(0, len(there) if len(ids) else 0, ROWS_AT_ONCE):
            own = there[at : at + ROWS_AT_ONCE]
            x = np.stack(v.iloc[own].to_numpy()).astype(float)
            size = np.linalg.norm(x, axis=1, keepdims=True)
            sims = (x / np.where(size < 1e-12, 1.0, size)) @ centres.T
            best = sims.argmax(axis=1)
            for i, b, s in zip(own, best, sims):
                out.iat[i, 0], out.iat[i, 1] = int(ids[b]), float(s[b])
                if with_all:
                    out.iat[i, 2] = list(map(float, s))
        return out

    out = vectors.withColumn("_b", score(F.col(vector))).withColumns({"meta_cluster": F.col("_b.c"), "similarity": F.col("_b.s")})
    if with_all:
        out = out.withColumn("similarities", F.col("_b.all"))
    return out.drop("_b")


def _assign(cost: np.ndarray) -> np.ndarray:
    """Minimum-cost perfect matching of a square matrix by shortest augmenting paths; row for each column."""
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    match, way = np.zeros(n + 1, int), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        best, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            row = match[j0]
            red = cost[row - 1] - u[row] - v[1:]
            free = ~used[1:]
            better = free & (red < best[1:])
            best[1:][better], way[1:][better] = red[better], j0
            j1 = 1 + int(np.argmin(np.where(free, best[1:], np.inf)))
            delta = best[j1]
            u[match[used]] += delta
            v[used] -= delta
            best[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return match[1:] - 1


def align_components(new: DataFrame, ref: DataFrame, on: Sequence[str], comp: str = "comp", vector: str = "vector") -> DataFrame:
    """Match components of ``new`` to ``ref`` one to one by total cosine: on, comp (of new), ref_comp, similarity.

    Components are taken in ``comp`` order; unequal counts give the identity order over shared positions.
    """
    def packed(df: DataFrame, name: str) -> DataFrame:
        item = F.struct(F.col(comp).alias("c"), unit(F.col(vector)).alias("u"))
        return df.groupBy(*on).agg(F.array_sort(F.collect_list(item)).alias(name))

    both = packed(new, "_a").join(packed(ref, "_b"), list(on))
    sims = F.flatten(F.transform("_a", lambda a: F.transform(F.col("_b"), lambda b: dot(a["u"], b["u"]))))
    both = both.select(*on, F.transform("_a", lambda a: a["c"]).alias("_ca"), F.transform("_b", lambda b: b["c"]).alias("_cb"), sims.alias("_sim"))
    kind = new.schema[comp].dataType
    schema = T.StructType([*[new.schema[k] for k in on], T.StructField(comp, kind), T.StructField("ref_comp", kind), T.StructField("similarity", T.DoubleType())])

    def match(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                *key, ca, cb, sim = row
                s = np.nan_to_num(np.asarray(sim, dtype=float)).reshape(len(ca), len(cb))
                order = _assign(-s) if len(ca) == len(cb) else np.arange(min(s.shape))
                out += [(*key, ca[i], cb[j], float(s[i, j])) for j, i in enumerate(order)]
            yield pd.DataFrame(out, columns=schema.names)

    return both.mapInPandas(match, schema)


def component_similarity(new: DataFrame, ref: DataFrame, on: Sequence[str], comp: str = "comp", vector: str = "vector") -> DataFrame:
    """Mean matched cosine per key; keys whose component counts differ give NULL."""
    counts = new.groupBy(*on).agg(F.count(F.lit(1)).alias("_ka")).join(ref.groupBy(*on).agg(F.count(F.lit(1)).alias("_kb")), list(on))
    mean = align_components(new, ref, on, comp, vector).groupBy(*on).agg(F.avg("similarity").alias("_s"))
    return counts.join(mean, list(on), "left").select(*on, F.when(F.col("_ka") == F.col("_kb"), F.col("_s")).alias("w_similarity"))


def restart_stability(fits: DataFrame, keys: Sequence[str], restart: str = "restart", comp: str = "comp", vector: str = "vector") -> DataFrame:
    """Mean and population sd of the matched similarity over all pairs of restarts (restarts are few and fixed)."""
    one = fits.select(*keys, F.col(restart).alias("_ra"), comp, vector)
    runs = fits.select(*keys, F.col(restart).alias("_rb")).distinct()
    left = one.join(runs, list(keys)).where("_ra < _rb")
    right = fits.select(*keys, F.col(restart).alias("_rb"), comp, vector).join(
        fits.select(*keys, F.col(restart).alias("_ra")).distinct(), list(keys)).where("_ra < _rb")
    sims = component_similarity(left, right, [*keys, "_ra", "_rb"], comp, vector)
    return sims.groupBy(*keys).agg(F.avg("w_similarity").alias("stability_mean"), F.stddev_pop("w_similarity").alias("stability_std"),
                                   F.count("w_similarity").alias("n_restart_pairs"))


def sparsity(w: DataFrame, task: Sequence[str], comp: str = "comp", weight: str = "weight", fraction: float = 0.1) -> DataFrame:
    """Mean share of channels at or above ``fraction`` of their component's largest weight."""
    top = w.groupBy(*task, comp).agg(F.max(weight).alias("_top"))
    act = w.join(top, [*task, comp]).groupBy(*task, comp).agg(F.avg((F.col(weight) >= fraction * F.col("_top")).cast("double")).alias("_a"))
    return act.groupBy(*task).agg(F.avg("_a").alias("w_sparsity"))


def activation_profile_similarity(h: DataFrame, keys: Sequence[str], session: str, window: str = "window_index", v: str = "h",
                                  labels: tuple = ("T0", "T1")) -> DataFrame:
    """r between the window means of two sessions over the windows both have."""
    means = h.groupBy(*keys, window).agg(*[F.avg(F.when(F.col(session) == s, F.col(v))).alias(n) for s, n in zip(labels, ("_a", "_b"))])
    return means.where("_a is not null and _b is not null").groupBy(*keys).agg(
        corr_guarded(F.col("_a"), F.col("_b")).alias("h_profile_similarity"))


def aligned_mean_weights(w: DataFrame, ref: DataFrame, on: Sequence[str], group: Sequence[str], session: str, channels: Sequence[str],
                         comp: str = "comp", vector: str = "vector") -> DataFrame:
    """Mean T0 and T1 weights and their difference per (group, ref component, channel) after alignment to ``ref``.

    ``on`` identifies one matrix; ``ref`` carries the reference components under the same keys.
    """
    links = align_components(w, ref, on, comp, vector)
    rows = w.join(links, [*on, comp]).select(*group, session, "ref_comp", F.posexplode(vector).alias("_i", "_w"))
    names = F.array(*[F.lit(c) for c in channels])
    agg = rows.groupBy(*group, "ref_comp", "_i").agg(
        F.avg(F.when(F.col(session) == "T0", F.col("_w"))).alias("w_T0"), F.avg(F.when(F.col(session) == "T1", F.col("_w"))).alias("w_T1"))
    return agg.select(*group, "ref_comp", names[F.col("_i")].alias("channel"), "w_T0", "w_T1", (F.col("w_T1") - F.col("w_T0")).alias("w_delta"))


