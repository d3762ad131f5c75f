"""Independent components of multichannel recordings by a symmetric fixed point.

Samples are packed into matrices of bounded size once.  Means, covariances and the sums of every
step are added up over the blocks of a recording on all tasks; what one step hands to the next is a
staged table with one small row per recording, so a recording may have any number of samples.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.session import stage

BLOCK_ROWS = 4096
#: Directions with a smaller share of the largest variance carry no signal and are left out.
FLAT = 1e-10


def _kinds(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def packed(wide: DataFrame, keys: Sequence[str], channels: Sequence[str], rows: int = BLOCK_ROWS) -> DataFrame:
    """keys, n and x: the complete samples of a task's stretch of rows as a matrix (n x channels, doubles as bytes)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for key, part in f.groupby(list(keys), sort=False):
                x = part[list(channels)].to_numpy(float)
                for at in range(0, len(x), rows):
                    piece = np.ascontiguousarray(x[at : at + rows])
                    yield pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, "n": [len(piece)], "x": [piece.tobytes()]})

    whole = wide.dropna(subset=list(channels)).select(*keys, *[F.col(c).cast("double").alias(c) for c in channels])
    return whole.mapInPandas(run, f"{_kinds(wide, keys)}, n long, x binary")


def _summed(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and s: the arrays `s` of a key's rows added up place by place."""
    each = partials.select(*keys, F.posexplode("s").alias("_at", "_v")).groupBy(*keys, "_at").agg(F.sum("_v").alias("_v"))
    return each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_v"))), lambda r: r["_v"]).alias("s"))


def _over_blocks(blocks: DataFrame, keys: Sequence[str], n_channels: int, of) -> DataFrame:
    """Sums over blocks of the arrays `of(x, row)`."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [of(np.frombuffer(r.x).reshape(-1, n_channels), r) for r in f.itertuples(index=False)]
            yield pd.DataFrame({**{k: f[k] for k in keys}, "s": rows})

    return _summed(blocks.mapInPandas(run, f"{_kinds(blocks, keys)}, s array<double>"), keys)


def _mapped(table: DataFrame, keys: Sequence[str], columns: str, of) -> DataFrame:
    """One row of `of(row)` for each row of a table of small states."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [of(r) for r in f.itertuples(index=False)]
            yield pd.DataFrame({**{k: f[k] for k in keys}, **{c: [r[i] for r in rows] for i, c in enumerate(names)}})

    return table.mapInPandas(run, f"{_kinds(table, keys)}, {columns}")


def whitening(blocks: DataFrame, keys: Sequence[str], n_channels: int, n_components: int | None = None, share: float = 1.0) -> DataFrame:
    """keys, n, mean, whiten (components x channels) and colour, its pseudo-inverse; flat arrays.

    Components are the principal directions, largest variance first, each with its largest entry positive.  At most
    ``n_components`` are kept, and of those as many as reach ``share`` of the variance.
    """
    first = _over_blocks(blocks, keys, n_channels, lambda x, r: np.concatenate([[len(x)], x.sum(axis=0)]))
    first = stage(first.withColumn("m", F.transform(F.slice("s", 2, n_channels), lambda v: v / F.col("s")[0])).select(*keys, F.col("s")[0].alias("total"), "m"))
    # deviations from the mean are squared, not values, so a large offset costs no digits
    centred = blocks.join(first, list(keys))
    second = _over_blocks(centred, keys, n_channels, lambda x, r: ((x - r.m).T @ (x - r.m)).ravel())

    def directions(r) -> tuple:
        value, vector = np.linalg.eigh(np.array(r.s).reshape(n_channels, n_channels) / r.total)
        value, vector = value[::-1], vector[:, ::-1]
        kept = int((value > FLAT * max(value[0], 0)).sum()) if value[0] > 0 else 0
        if share < 1 and kept:
            kept = min(kept, int(np.searchsorted(np.cumsum(value) / value.sum(), share - 1e-12)) + 1)
        kept = min(kept, n_components or n_channels)
        value, vector = value[:kept], vector[:, :kept]
        vector = vector * np.where(vector[np.abs(vector).argmax(axis=0), np.arange(kept)] < 0, -1, 1)
        return int(r.total), r.m, (vector / np.sqrt(value)).T.ravel(), (vector * np.sqrt(value)).ravel()

    return _mapped(second.join(first, list(keys)), keys, "n long, mean array<double>, whiten array<double>, colour array<double>", directions)


def _start(k: int) -> np.ndarray:
    """A fixed orthogonal start without zeros: a discrete cosine basis."""
    i, j = np.mgrid[:k, :k]
    w = np.cos(np.pi * (2 * j + 1) * i / (2 * k))
    return w / np.linalg.norm(w, axis=1, keepdims=True)


def _orthogonal(w: np.ndarray) -> np.ndarray:
    u, _, v = np.linalg.svd(w)
    return u @ v


def unmix(wide: DataFrame, keys: Sequence[str], channels: Sequence[str], n_components: int | None = None, share: float = 1.0,
          max_iter: int = 60, tol: float = 1e-8, rows: int = BLOCK_ROWS) -> DataFrame:
    """Independent components per key: n, mean, unmixing (components x channels), mixing (channels x components), steps, settled.

    ``wide`` has one row per sample with a column per channel; samples with a missing channel are left out.  A step takes
    W to E[tanh(Wz) z'] - E[1 - tanh(Wz)^2] W, made orthogonal, with z the whitened samples and expectations summed over
    blocks; it starts from a fixed matrix.  A key is done once its rows turn by less than ``tol``; done keys are not read
    again.  Components come in order of the variance they explain, with the largest mixing entry positive.  Keys without
    variance have empty arrays.
    """
    c = len(channels)
    blocks = stage(packed(wide, keys, channels, rows))
    base = stage(whitening(blocks, keys, c, n_components, share))
    state = stage(_mapped(base, keys, "w array<double>, turn double", lambda r: (_start(len(r.whiten) // c).ravel(), 1.0 if len(r.whiten) else 0.0)).withColumn("steps", F.lit(0)))

    def sums(x: np.ndarray, r) -> np.ndarray:
        white = np.array(r.whiten).reshape(-1, c)
        z = (x - r.mean) @ white.T
        g = np.tanh(z @ np.array(r.w).reshape(len(white), -1).T)
        return np.concatenate([(g.T @ z).ravel(), (1 - g * g).sum(axis=0)])

    def step(r) -> tuple:
        s, k = np.array(r.s) / r.n, int(np.sqrt(len(r.w)))
        old = np.array(r.w).reshape(k, k)
        new = _orthogonal(s[: k * k].reshape(k, k) - s[k * k :, None] * old)
        return new.ravel(), float(np.abs(1 - np.abs((new * old).sum(axis=1))).max()), r.steps + 1

    for _ in range(max_iter):
        open_keys = state.where(F.col("turn") > tol)
        if open_keys.isEmpty():
            break
        facts = open_keys.select(*keys, "w").join(base.select(*keys, "mean", "whiten"), list(keys))
        summed = _over_blocks(blocks.join(facts, list(keys)), keys, c, sums)
        moved = _mapped(summed.join(open_keys, list(keys)).join(base.select(*keys, "n"), list(keys)), keys, "w array<double>, turn double, steps int", step)
        state = stage(moved.unionByName(state.where(F.col("turn") <= tol)))

    def finished(r) -> tuple:
        k = int(np.sqrt(len(r.w)))
        w = np.array(r.w).reshape(k, k)
        mixing = np.array(r.colour).reshape(c, k) @ w.T
        order = np.argsort(-(mixing**2).sum(axis=0), kind="stable")
        mixing, unmixing = mixing[:, order], (w @ np.array(r.whiten).reshape(k, c))[order]
        sign = np.where(mixing[np.abs(mixing).argmax(axis=0), np.arange(k)] < 0, -1, 1) if k else np.empty(0)
        return r.n, r.mean, (unmixing * sign[:, None]).ravel(), (mixing * sign).ravel(), r.steps, bool(r.turn <= tol)

    kinds = "n long, mean array<double>, unmixing array<double>, mixing array<double>, steps int, settled boolean"
    return _mapped(base.join(state, list(keys)), keys, kinds, finished)


def sources(wide: DataFrame, fits: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """``wide`` with `sources`, the array of component values of each sample; expressions only."""
    c = len(channels)
    centred = F.zip_with(F.array(*[F.col(x).cast("double") for x in channels]), F.col("mean"), lambda v, m: v - m)
    n = (F.size("unmixing") / c).cast("int")
    row = lambda i: F.slice("unmixing", (i * c + 1).cast("int"), c)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    values = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: dot(row(i), centred))).otherwise(F.array().cast("array<double>"))
    return wide.join(fits.select(*keys, "mean", "unmixing"), list(keys)).withColumn("sources", values).drop("mean", "unmixing")


def without_components(wide: DataFrame, fits: DataFrame, dropped: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """``wide`` with the channels' shares of the components of ``dropped`` (keys, component: 0, 1, ...) taken out."""
    c = len(channels)
    gone = dropped.groupBy(*keys).agg(F.sort_array(F.collect_set("component")).alias("_gone"))
    rows = sources(wide, fits, keys, channels).join(fits.select(*keys, "mixing"), list(keys)).join(gone, list(keys), "left")
    n = (F.size("mixing") / c).cast("int")
    share = lambda j: F.aggregate(F.coalesce("_gone", F.array().cast("array<int>")), F.lit(0.0),
                                  lambda s, i: s + F.element_at("mixing", (F.lit(j) * n + i + 1).cast("int")) * F.element_at("sources", (i + 1).cast("int")))
    return rows.select(*[x for x in wide.columns if x not in channels], *[(F.col(x) - share(j)).alias(x) for j, x in enumerate(channels)])
