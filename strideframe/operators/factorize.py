"""Non-negative factorisation X ~ W H per task, and activations for a fixed W.

A row is one sample with its channels as a short array.  Both factors are solved exactly in turn:
given W every sample's activation is its own small non-negative least-squares problem, and given the
activations W follows from two sums over samples (X H' and H H').  A task that is one matrix of samples
iterates where that matrix is; larger ones stay distributed and only those sums travel.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from strideframe.functions.numeric import div
from strideframe.session import stage

BLOCK_ROWS = 65_536
SALTS = 64


def nnls_two(g11: Column, g12: Column, g22: Column, b1: Column, b2: Column) -> tuple[Column, Column]:
    """Exact non-negative least squares with two columns, from the normal equations."""
    det = g11 * g22 - g12 * g12
    h1, h2 = div(b1 * g22 - b2 * g12, det), div(b2 * g11 - b1 * g12, det)
    both = (h1 >= 0) & (h2 >= 0)
    only1, only2 = F.greatest(div(b1, g11), F.lit(0.0)), F.greatest(div(b2, g22), F.lit(0.0))
    first = (h2 < 0) | h2.isNull()
    return F.when(both, h1).when(first, only1).otherwise(0.0), F.when(both, h2).when(first, 0.0).otherwise(only2)


def nnls_rows(b: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Solve min h'Gh/2 - b'h, h >= 0 for every row of b by block principal pivoting.

    Rows that share a support are solved together.  Exchanging every infeasible index is tried while
    it helps; otherwise only the last one is exchanged, which cannot cycle.
    """
    n, k = b.shape
    g = g + np.eye(k) * (1e-12 * max(np.trace(g) / max(k, 1), 1e-300))
    eps = 1e-12 * max(float(np.abs(b).max(initial=0.0)), 1e-300)
    x, y = np.zeros((n, k)), -b.copy()
    free = np.zeros((n, k), bool)
    tries, lowest = np.full(n, 3), np.full(n, k + 1)
    for _ in range(50 * (k + 1)):
        bad = (free & (x < 0)) | (~free & (y < -eps))
        count = bad.sum(axis=1)
        todo = np.flatnonzero(count)
        if not len(todo):
            break
        better = count[todo] < lowest[todo]
        lowest[todo[better]], tries[todo[better]] = count[todo[better]], 3
        patient = ~better & (tries[todo] > 0)
        tries[todo[patient]] -= 1
        careful = todo[~better & ~patient]
        flip = bad[todo]
        if len(careful):
            rows = np.isin(todo, careful)
            last = k - 1 - np.argmax(flip[rows][:, ::-1], axis=1)
            flip[rows] = False
            flip[np.flatnonzero(rows), last] = True
        free[todo] ^= flip
        code = free[todo] @ (1 << np.arange(k))
        for c in np.unique(code):
            rows, on = todo[code == c], free[todo[code == c][0]]
            x[rows], y[rows] = 0.0, 0.0
            if on.any():
                sol = np.linalg.solve(g[np.ix_(on, on)], b[np.ix_(rows, on)].T).T
                x[np.ix_(rows, on)] = sol
                y[np.ix_(rows, ~on)] = sol @ g[np.ix_(on, ~on)] - b[np.ix_(rows, ~on)]
            else:
                y[rows] = -b[rows]
    return np.maximum(x, 0.0)


def _unit(w: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(w, axis=0)
    return w / np.where(size > 1e-12, size, 1.0)


def start_weights(gram: np.ndarray, mean: float, k: int, restart: int, seed: int) -> np.ndarray:
    """First restart from the leading directions of X X' with zeros filled by the mean level; the others random."""
    m = len(gram)
    if restart == 0:
        values, vectors = np.linalg.eigh(gram)
        w = np.zeros((m, k))
        for j, u in enumerate(vectors[:, ::-1].T[:k]):
            part = np.maximum(u, 0) if np.linalg.norm(np.maximum(u, 0)) >= np.linalg.norm(np.maximum(-u, 0)) else np.maximum(-u, 0)
            w[:, j] = part * max(values[::-1][j], 0.0) ** 0.25
        return _unit(np.where(w > 0, w, max(mean, 1e-9) * 1e-2))
    return _unit(np.random.default_rng([seed, restart, k, m]).random((m, k)) + 1e-6)


def batch_sums(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """X H' and H H' of a batch for the best activations under w."""
    h = nnls_rows(x @ w, w.T @ w)
    return x.T @ h, h.T @ h


def residual(energy: float, w: np.ndarray, xh: np.ndarray, hh: np.ndarray) -> float:
    return max(float(energy - 2 * np.sum(w * xh) + np.sum((w.T @ w) * hh)), 0.0)


class _Fit:
    """Alternation state of one (k, restart)."""

    def __init__(self, k: int, restart: int, w: np.ndarray, rss: float = np.inf, iters: int = 0):
        self.k, self.restart, self.w, self.rss, self.iters, self.done = k, restart, w, rss, iters, False

    def advance(self, xh: np.ndarray, hh: np.ndarray, energy: float, max_iter: int, tol: float) -> None:
        rss = residual(energy, self.w, xh, hh)
        self.iters += 1
        settled = self.iters > 1 and self.rss - rss <= tol * 1e-2 * max(self.rss, 1e-12 * energy)
        self.rss = rss
        if settled or self.iters >= max_iter or rss <= 1e-14 * energy:
            self.done = True
        else:
            self.w = _unit(nnls_rows(xh, hh))


def _starts(gram: np.ndarray, n: int, total: float, ks: Sequence[int], restarts: int, seed: int) -> list[_Fit]:
    m = len(gram)
    mean = total / max(n * m, 1)
    return [_Fit(k, r, start_weights(gram, mean, k, r, seed)) for k in ks if k <= min(m, n) for r in range(restarts)]


def _channel_errors(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.sum((x - nnls_rows(x @ w, w.T @ w) @ w.T) ** 2, axis=0)


_NUMBERS = T.ArrayType(T.DoubleType())
_RESULT = [
    T.StructField("k", T.IntegerType()), T.StructField("restart", T.IntegerType()), T.StructField("weights", T.ArrayType(_NUMBERS)),
    T.StructField("rss", T.DoubleType()), T.StructField("n_iter", T.IntegerType()), T.StructField("hit_max_iter", T.BooleanType()),
    T.StructField("n_samples", T.LongType()), T.StructField("sst", _NUMBERS), T.StructField("sse", _NUMBERS),
    T.StructField("status", T.StringType()),
]
_NAMES = [f.name for f in _RESULT]


def _packed(clean: DataFrame, keys: Sequence[str], block_rows: int) -> DataFrame:
    """Samples as matrices of at most about ``block_rows`` rows, packed where they are read: keys, n, least, most (vector length), finite, x."""
    names = list(keys)
    schema = T.StructType([*[clean.schema[c] for c in keys], T.StructField("n", T.LongType()), T.StructField("least", T.IntegerType()),
                           T.StructField("most", T.IntegerType()), T.StructField("finite", T.BooleanType()), T.StructField("x", T.BinaryType())])

    def rows_of(held: dict) -> pd.DataFrame:
        out = []
        for key, (own, vectors) in held.items():
            least, most = min(map(len, vectors)), max(map(len, vectors))
            x = np.stack(vectors).astype(float) if least == most else np.empty(0)
            out.append((*own, len(vectors), least, most, bool(np.isfinite(x).all()), x.tobytes()))
        return pd.DataFrame(out, columns=[f.name for f in schema])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        count = 0
        for pdf in batches:
            for own, x in zip(pdf[names].itertuples(index=False, name=None), pdf["_x"]):
                held.setdefault(repr(own), (own, []))[1].append(x)
                count += 1
                if count >= block_rows:
                    yield rows_of(held)
                    held, count = {}, 0
        if held:
            yield rows_of(held)

    return clean.select(*keys, "_x").mapInPandas(pack, schema)


def factorize(rows: DataFrame, keys: Sequence[str], ks: Sequence[int], restarts: int = 10, max_iter: int = 500, tol: float = 1e-3, seed: int = 42,
              vector: str = "vector", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All (k, restart) fits of every task: keys, k, restart, weights (k unit vectors), rss, iterations, sst and sse per channel, status.

    ``rows`` needs one fixed-length ``vector`` per sample; negatives count as zero.  Every task comes back: with its
    fits, or with one row whose status says why it failed (vectors of different lengths or none, values that are not
    finite), whatever its size.  Samples are packed into matrices.  The same alternation runs on all tasks; where a
    task is more than one matrix, its sums are added over the cluster and the fits between two passes are a staged
    table.  Fitting happens here, once; the result is a stage table.
    """
    clean = rows.select(*keys, F.transform(F.coalesce(F.col(vector), F.array()), lambda v: F.greatest(F.nanvl(F.coalesce(v.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))).alias("_x"))
    packed = stage(_packed(clean, keys, block_rows))
    tasks = packed.groupBy(*keys).agg(F.sum("n").alias("_n"), F.min("least").alias("_least"), F.max("most").alias("_most"), F.min("finite").alias("_finite"))
    bad = F.when((F.col("_least") != F.col("_most")) | (F.col("_most") == 0), "failed: vectors differ in length or are empty").when(~F.col("_finite"), "failed: values are not finite")
    tasks = stage(tasks.withColumn("_bad", bad))
    schema = T.StructType([*[rows.schema[c] for c in keys], *_RESULT])
    wanted = tuple(ks)
    failed = tasks.where("_bad is not null").select(*keys, *[F.lit(None).cast(f.dataType).alias(f.name) for f in _RESULT[:-1]], F.col("_bad").alias("status"))

    def local(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = int(pdf["most"].iloc[0])
        x = np.concatenate([np.frombuffer(b, float) for b in sorted(pdf["x"])]).reshape(-1, m)
        energy, out = float(np.sum(x * x)), []
        sst = list(map(float, np.sum(x * x, axis=0)))
        for f in _starts(x.T @ x, len(x), float(x.sum()), wanted, restarts, seed):
            while not f.done:
                f.advance(*batch_sums(x, f.w), energy, max_iter, tol)
            out.append([*key, f.k, f.restart, [list(map(float, c)) for c in f.w.T], float(f.rss), f.iters, f.iters >= max_iter, len(x), sst, list(map(float, _channel_errors(x, f.w))), "ok"])
        return pd.DataFrame(out, columns=[*keys, *_NAMES])

    good = tasks.where("_bad is null")
    one, many = (packed.join(good.where(cond).select(*keys), list(keys), "left_semi") for cond in (f"_n <= {block_rows}", f"_n > {block_rows}"))
    # few rows, much work: they must not be coalesced into one partition
    wide = max(packed.sparkSession.sparkContext.defaultParallelism, int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = one.repartition(wide, *keys).groupBy(*keys).applyInPandas(local, schema).unionByName(failed)
    if not good.where(F.col("_n") > block_rows).isEmpty():
        found = found.unionByName(_fit_over_blocks(stage(many), keys, wanted, restarts, max_iter, tol, seed, schema))
    return stage(found)


def _sums_over_blocks(packed: DataFrame, fits: DataFrame, keys: Sequence[str], fn) -> DataFrame:
    """keys, k, restart and the sum over the task's blocks of the vectors ``fn(x, w)``, for every fit (k, restart, w).

    Blocks of one task are dealt over SALTS partitions; what a partition has summed leaves it once.
    """
    names = list(keys)
    per_task = fits.groupBy(*keys).agg(F.collect_list(F.struct("k", "restart", "w")).alias("fits")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = packed.withColumn("_salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int")).join(per_task, [*keys, "_salt"]).select(*keys, "most", "x", "fits")
    schema = T.StructType([*[packed.schema[c] for c in keys], T.StructField("k", T.IntegerType()), T.StructField("restart", T.IntegerType()),
                           T.StructField("pos", T.IntegerType()), T.StructField("val", T.DoubleType())])

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for pdf in batches:
            for own, m, raw, fits_ in zip(pdf[names].itertuples(index=False, name=None), pdf["most"], pdf["x"], pdf["fits"]):
                x = np.frombuffer(raw, float).reshape(-1, int(m))
                for f in fits_:
                    w = np.asarray(f["w"], float).reshape(int(m), -1)
                    key = (*own, int(f["k"]), int(f["restart"]))
                    vec = fn(x, w)
                    total[key] = total[key] + vec if key in total else vec
        for key, vec in total.items():
            out = pd.DataFrame({c: [v] * len(vec) for c, v in zip([*names, "k", "restart"], key)})
            yield out.assign(pos=np.arange(len(vec), dtype="int32"), val=vec)

    sums = joined.mapInPandas(part, schema).groupBy(*keys, "k", "restart", "pos").agg(F.sum("val").alias("val"))
    return sums.groupBy(*keys, "k", "restart").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "val"))), lambda e: e["val"]).alias("sums"))


def _fit_over_blocks(packed: DataFrame, keys: Sequence[str], ks: Sequence[int], restarts: int, max_iter: int, tol: float, seed: int, schema: T.StructType) -> DataFrame:
    """Fits of tasks that are several matrices: each pass adds X H' and H H' over the blocks, state stays in staged tables."""
    names = list(keys)
    key_fields = [packed.schema[c] for c in keys]
    state_schema = T.StructType([*key_fields, T.StructField("k", T.IntegerType()), T.StructField("restart", T.IntegerType()), T.StructField("w", _NUMBERS),
                                 T.StructField("rss", T.DoubleType()), T.StructField("iters", T.IntegerType()), T.StructField("done", T.BooleanType()),
                                 T.StructField("n", T.LongType()), T.StructField("sst", _NUMBERS)])
    columns = [f.name for f in state_schema]
    nothing = packed.select(*keys).distinct().select(*keys, F.lit(0).alias("k"), F.lit(0).alias("restart"), F.array().cast("array<double>").alias("w"))
    facts = _sums_over_blocks(packed, nothing, keys, lambda x, w: np.concatenate([[len(x), x.sum()], (x.T @ x).ravel()]))

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for own, sums in zip(pdf[names].itertuples(index=False, name=None), pdf["sums"]):
                f = np.asarray(sums, float)
                gram = f[2:].reshape(int(round((len(f) - 2) ** 0.5)), -1)
                n = int(round(f[0]))
                out += [(*own, s.k, s.restart, s.w.ravel(), np.inf, 0, False, n, np.diag(gram)) for s in _starts(gram, n, float(f[1]), ks, restarts, seed)]
            yield pd.DataFrame(out, columns=columns)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                m, k, sums = len(r["sst"]), int(r["k"]), np.asarray(r["sums"], float)
                f = _Fit(k, int(r["restart"]), np.asarray(r["w"], float).reshape(m, k), r["rss"], int(r["iters"]))
                f.advance(sums[: m * k].reshape(m, k), sums[m * k :].reshape(k, k), float(np.sum(r["sst"])), max_iter, tol)
                out.append((*[r[c] for c in names], k, f.restart, f.w.ravel(), f.rss, f.iters, f.done, r["n"], r["sst"]))
            yield pd.DataFrame(out, columns=columns)

    live, ended = stage(facts.mapInPandas(start, state_schema)), []
    fit_key = [*keys, "k", "restart"]
    while not live.isEmpty():
        sums = _sums_over_blocks(packed, live, keys, lambda x, w: np.concatenate([a.ravel() for a in batch_sums(x, w)]))
        moved = stage(live.join(sums, fit_key).mapInPandas(step, state_schema))
        ended.append(moved.where("done"))
        live = moved.where("not done")
    state = ended[0]
    for more in ended[1:]:
        state = state.unionByName(more)
    state = stage(state)
    errors = _sums_over_blocks(packed, state, keys, _channel_errors).withColumnRenamed("sums", "sse")
    k = F.col("k")
    at = lambda j: F.transform(F.sequence(F.lit(0), F.size("sst") - 1), lambda i: F.col("w")[i * k + j])
    weights = F.transform(F.sequence(F.lit(0), k - 1), at)
    out = state.join(errors, fit_key).select(*keys, "k", "restart", weights.alias("weights"), "rss", F.col("iters").alias("n_iter"),
                                             (F.col("iters") >= max_iter).alias("hit_max_iter"), F.col("n").alias("n_samples"), "sst", "sse", F.lit("ok").alias("status"))
    return out.select(*[F.col(f.name).cast(f.dataType) for f in schema])


def best_fits(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lowest-rss restart per (task, k)."""
    order = W.partitionBy(*keys, "k").orderBy("rss", "restart")  # as many rows as restarts
    return fits.where("status = 'ok'").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def channel_table(best: DataFrame, keys: Sequence[str], channels: Sequence[str], floor: float = 1e-10) -> DataFrame:
    """(keys, k, channel, sst, sse, n, vaf) as the selection rules expect it; near-zero energy gives NULL."""
    names = F.array(*[F.lit(c) for c in channels])
    rows = best.select(*keys, "k", "n_samples", "sse", F.posexplode("sst").alias("_i", "_sst"))
    sse = F.col("sse")[F.col("_i")]
    ok = F.col("_sst") > floor
    return rows.select(*keys, "k", names[F.col("_i")].alias("channel"), F.col("_sst").alias("sst"), sse.alias("sse"), F.col("n_samples").alias("n"),
                       F.when(ok, 1 - sse / F.when(ok, F.col("_sst"))).alias("vaf"))


def components(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per component: keys, comp, vector."""
    return fits.select(*keys, F.posexplode("weights").alias("comp", "vector"))


def activations(rows: DataFrame, weights: DataFrame, keys: Sequence[str], sample: Sequence[str], vector: str = "vector") -> DataFrame:
    """Non-negative activations of every sample for its task's fixed components: keys, sample, h (array), squared_error.

    ``weights`` has one row per task with ``weights`` as k arrays; it is a small table next to the
    samples.  Batches group their rows by task, so each distinct W is factored once per batch.
    """
    joined = rows.select(*keys, *sample, F.col(vector).alias("_x")).join(weights.select(*keys, F.flatten("weights").alias("_w"), F.size("weights").alias("_k")), list(keys))
    fields = [rows.schema[c] for c in (*keys, *sample)]
    schema = T.StructType([*fields, T.StructField("h", T.ArrayType(T.DoubleType())), T.StructField("squared_error", T.DoubleType())])
    cols = [f.name for f in fields]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, g in pdf.groupby(list(keys), sort=False, dropna=False):
                x = np.maximum(np.nan_to_num(np.stack(g["_x"].to_numpy()).astype(float)), 0.0)
                w = np.asarray(g["_w"].iloc[0], dtype=float).reshape(int(g["_k"].iloc[0]), -1).T
                h = nnls_rows(x @ w, w.T @ w)
                out = g[cols].copy()
                out["h"], out["squared_error"] = list(h), np.sum((x - h @ w.T) ** 2, axis=1)
                yield out

    return joined.mapInPandas(solve, schema)
