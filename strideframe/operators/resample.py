"""Rate changes of whole channels."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from strideframe.operators.fourier import TILE, fourier_sums, many_sums
from strideframe.operators.ordered import CELL, PIECE_ROWS, TARGET_ROWS, add_cell, attach_totals, row_index
from strideframe.session import stage


def _resampled(x: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Short channels, each a row of ``x`` with zeros behind its n samples, at m places; what is behind these is void."""
    top = np.minimum(n, m) // 2
    spectrum = many_sums(x, n, top + 1, n, -1)
    k, mirrored = np.arange(spectrum.shape[1]), (np.minimum(n, m) % 2 == 1) | (m < n)
    twice = (k > 0) & ((k < top[:, None]) | mirrored[:, None])
    weighed = np.where(k <= top[:, None], spectrum * np.where(twice, 2.0, 1.0) / n[:, None], 0)
    return many_sums(weighed, top + 1, m, m, 1).real


def _short_ones(schema: T.StructType, keys: Sequence[str], target_fs: float, tile: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Resamples, in rows sorted by (key, cell, rank), the channels whose grid is one tile; packs the samples of all others.

    Holds about two tiles of rows at a time.  ``_x`` has at most PIECE_ROWS values, of the result from place ``_start`` on if
    ``_done``, else samples from rank ``_start`` in the cell on.
    """
    kinds = to_arrow_schema(schema)

    def packed(rows: pa.Table, at: np.ndarray, values: np.ndarray, lengths: np.ndarray, own: dict) -> pa.RecordBatch:
        """Pieces of the values of channels whose first rows are ``at``."""
        pieces = -(-lengths // PIECE_ROWS)
        which = np.repeat(np.arange(len(at)), pieces)
        start = (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE_ROWS
        count = np.minimum(PIECE_ROWS, lengths[which] - start)
        x = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(values))
        first = rows.select([*keys, CELL, "_r"]).take(at[which])
        rank = start if own["_done"] else start + first["_r"].to_numpy() - 1
        columns = {c: pa.array(own[c][which], from_pandas=True) for c in ("_m", "_t0", "_t1") if c in own} | {"_done": pa.repeat(own["_done"], len(which)), "_start": pa.array(rank), "_n": pa.array(count), "_x": x}
        columns = {c: columns[c] if c in columns else first[c] if c in first.column_names else pa.nulls(len(which), kinds.field(c).type) for c in kinds.names}
        return pa.table(columns).cast(kinds).combine_chunks().to_batches()[0]

    def work(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        r, t, v, whole = (rows[c].to_numpy() for c in ("_r", "_t", "_v", "_whole"))
        at = np.flatnonzero((r - 1) % tile == 0)
        n = np.diff(np.append(at, len(r)))
        t0, t1 = np.fmin.reduceat(t, at), np.fmax.reduceat(t, at)
        places = np.nan_to_num((t1 - t0) * target_fs)
        m = np.where(n < 2, n, np.maximum(2, np.floor(places) + (places - np.floor(places) >= 0.5)))
        # a full tile of samples may go on behind it
        short = whole[at] & (r[at] == 1) & (n < tile) & (np.maximum(n, m) + np.minimum(n, m) // 2 <= tile)
        ends = {"_t0": t0, "_t1": t1}
        if not short.all():
            rest = np.flatnonzero(~short)
            yield packed(rows, at[rest], v[np.repeat(~short, n)], n[rest], {c: x[rest] for c, x in ends.items()} | {"_done": False})
        m = np.where(short, m, 1).astype(int)
        # the longer of the two transforms decides with which others a channel goes
        bits = np.frexp(np.maximum(n, m) + np.minimum(n, m) // 2 - 1)[1]
        for b in np.unique(bits[short]):
            alike = np.flatnonzero(short & (bits == b))
            for g in np.split(alike, np.arange(max(1, tile >> b), len(alike), max(1, tile >> b))):
                i = np.arange(n[g].max())
                x = np.where(i < n[g, None], v[np.minimum(at[g, None] + i, len(v) - 1)], 0.0)
                y = _resampled(x, n[g], m[g])
                yield packed(rows, at[g], y[np.arange(y.shape[1]) < m[g, None]], m[g], {c: x[g] for c, x in ends.items()} | {"_m": m[g], "_done": True})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            at = np.flatnonzero((batch["_r"].to_numpy() - 1) % tile == 0)
            if len(at) and size + at[-1] >= tile:
                yield from work([*held, batch.slice(0, at[-1])])
                held, size, batch = [], 0, batch.slice(at[-1])
            held, size = [*held, batch], size + len(batch)
        if size:
            yield from work(held)

    return run


def fourier_resample(df: DataFrame, keys: Sequence[str], t: str, target_fs: float, v: str = "v", tie: Sequence[str] = (), tile: int = TILE,
                     target_rows: int = TARGET_ROWS) -> DataFrame:
    """Spectral resampling to max(2, round(duration * fs)) samples on an end-inclusive time axis: keys, sample_idx, t, v.

    Half the spectrum up to the smaller rate is taken and summed again at the new places, both in groups of at most
    ``tile`` values (see `fourier`), whatever the channel's length.  Channels that fill less than a group are done many at a
    time where their samples are sorted.  NULL samples count as zero.
    """
    tile = 1 << (max(tile, 1).bit_length() - 1)
    marked = add_cell(df.select(*keys, t, *tie, v).where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])), keys, t, target_rows, tie, whole="_whole")
    rank = F.row_number().over(W.partitionBy(*keys, CELL).orderBy(t, *tie))
    sorted_rows = marked.select(*keys, CELL, "_whole", rank.cast("long").alias("_r"), F.col(t).cast("double").alias("_t"), F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias("_v"))
    schema = T.StructType([*[df.schema[k] for k in keys], *[T.StructField(c, T.LongType()) for c in (CELL, "_start", "_n", "_m")], T.StructField("_done", T.BooleanType()),
                           *[T.StructField(c, T.DoubleType()) for c in ("_t0", "_t1")], T.StructField("_x", T.ArrayType(T.DoubleType()))])
    pieces = stage(sorted_rows.mapInArrow(_short_ones(schema, keys, target_fs, tile), schema))
    done = pieces.where("_done").select(*keys, "_start", "_m", "_t0", "_t1", F.posexplode("_x").alias("idx", "re")).withColumn("idx", F.col("_start") + F.col("idx"))

    long = pieces.where("not _done")
    whole = W.partitionBy(*keys)
    earlier = whole.orderBy(CELL, "_start").rowsBetween(W.unboundedPreceding, -1)
    sizes = long.select(*keys, CELL, "_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"), F.sum("_n").over(whole).alias("_n"),
                        F.min("_t0").over(whole).alias("_t0"), F.max("_t1").over(whole).alias("_t1"))
    sizes = sizes.withColumn("_m", F.when(F.col("_n") < 2, F.col("_n")).otherwise(F.greatest(F.lit(2), F.round((F.col("_t1") - F.col("_t0")) * target_fs))).cast("long"))
    carry = ["_n", "_m", "_t0", "_t1"]
    rows = long.select(*keys, CELL, "_start", "_x").join(sizes, [*keys, CELL, "_start"]).select(*keys, "_off", *carry, F.posexplode("_x").alias("idx", "re"))
    size = F.least("_n", "_m")
    top = F.floor(size / 2)
    samples = rows.select(*keys, (F.col("_off") + F.col("idx")).alias("idx"), "re", F.lit(0.0).alias("im"), *carry)
    spectrum = fourier_sums(samples.select("*", F.col("_n").alias("period"), F.col("_n").alias("n_in"), (top + 1).alias("n_out")), keys, -1, carry, tile)
    # a bin stands for itself and its mirror image, but the middle bin of an even spectrum that isn't cut stands alone
    alone = (F.col("idx") == 0) | ((size % 2 == 0) & (F.col("idx") == top) & (F.col("_m") >= F.col("_n")))
    weight = F.when(alone, 1.0).otherwise(2.0) / F.col("_n")
    weighed = spectrum.select(*keys, "idx", (F.col("re") * weight).alias("re"), (F.col("im") * weight).alias("im"), *carry)
    y = fourier_sums(weighed.select("*", F.col("_m").alias("period"), (top + 1).alias("n_in"), F.col("_m").alias("n_out")), keys, 1, carry, tile)
    same = [*keys, "idx", "re", "_m", "_t0", "_t1"]
    y = done.select(same).unionByName(y.select(same))
    # multiplied first, so that a place is rounded once and the last one is the end itself
    apart = F.col("idx") * (F.col("_t1") - F.col("_t0")) / F.greatest(F.col("_m") - 1, F.lit(1))
    return y.select(*keys, F.col("idx").alias("sample_idx"), (F.col("_t0") + apart).alias("t"), F.col("re").alias("v"))


def polyphase_resample(df: DataFrame, keys: Sequence[str], order: str, up: int, down: int, v: str = "v", tie: Sequence[str] = (), block: int = 65_536,
                       target_rows: int = TARGET_ROWS) -> DataFrame:
    """Rational rate change through a Kaiser(5) windowed-sinc filter: keys, sample_idx, v, ceil(n*up/down) samples.

    An output sample reads a few neighbours only, so blocks with a short halo give the whole result.
    """
    g = math.gcd(up, down)
    up, down = up // g, down // g
    rate = max(up, down)
    half = 10 * rate
    k = np.arange(2 * half + 1)
    taps = np.sinc((k - half) / rate) / rate * np.kaiser(2 * half + 1, 5.0)
    taps = taps / taps.sum() * up
    reach = half // up + 2
    from strideframe.operators.ordered import blocks

    rows = blocks(row_index(df.select(*dict.fromkeys([*keys, order, *tie, v])), keys, order, tie, target_rows), block, reach, reach)
    schema = T.StructType([*[df.schema[c] for c in keys], T.StructField("sample_idx", T.LongType()), T.StructField("v", T.DoubleType())])

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        n, b, i0 = int(pdf["n"].iloc[0]), int(key[-1]), int(pdf["idx"].iloc[0])
        x = np.nan_to_num(pdf[v].to_numpy(dtype=float))
        total = -(-n * up // down)
        first, last = -(-b * block * up // down), min(-(-(b + 1) * block * up // down), total)
        j = np.arange(first, last)
        low = np.maximum(-((half - j * down) // up), 0)
        y = np.zeros(len(j))
        for s in range(2 * half // up + 2):
            i = low + s
            pos = j * down - i * up + half
            ok = (pos >= 0) & (pos <= 2 * half) & (i < n) & (i >= i0) & (i < i0 + len(x))
            y[ok] += x[i[ok] - i0] * taps[pos[ok]]
        return pd.DataFrame({**dict(zip(keys, key)), "sample_idx": j, "v": y})

    return rows.groupBy(*keys, "block").applyInPandas(kernel, schema)


def epochs(df: DataFrame, keys: Sequence[str], t: str = "t", length_s: float = 4.0, overlap: float = 0.5) -> DataFrame:
    """Give each sample the fixed-length epochs that hold it: ``epoch``, ``epoch_start_s`` relative to the key's first sample."""
    step = length_s * (1 - overlap)
    rows = attach_totals(add_cell(df, keys, t), keys, {"_t0": ("min", F.col(t)), "_t1": ("max", F.col(t))}).drop("_cell")
    rel = F.col(t) - F.col("_t0")
    lo = F.greatest(F.floor((rel - length_s) / step) + 1, F.lit(0))
    hi = F.least(F.floor(rel / step), F.floor((F.col("_t1") - F.col("_t0") - length_s) / step))
    ids = F.when(hi >= lo, F.sequence(lo.cast("long"), F.greatest(lo, hi).cast("long")))
    return rows.withColumn("epoch", F.explode(ids)).withColumn("epoch_start_s", F.col("epoch") * F.lit(step)).drop("_t0", "_t1")


def active_bursts(df: DataFrame, keys: Sequence[str], order: str, threshold: float, v: str = "v", tie: Sequence[str] = (), target_rows: int = TARGET_ROWS) -> DataFrame:
    """Onset and offset of every run with v >= threshold: keys, burst, onset, offset, n_samples, peak.

    Runs are found from the rows where activity switches on, counted per key by the row index.
    """
    from strideframe.operators.ordered import running_weight

    marked = row_index(df.select(*keys, F.col(order).cast("double").alias("_o"), *tie, v), keys, "_o", tie, target_rows)
    on = marked.withColumn("_on", (F.col(v) >= threshold).cast("int"))
    # active rows minus their rank among active rows is constant inside a run
    active = on.where("_on = 1").withColumn("_w", F.lit(1))
    ranked = running_weight(active.select(*keys, "idx", "_o", v, "_w"), keys, "idx", "_w", target_rows)
    runs = ranked.withColumn("_run", F.col("idx") - F.col("before")).groupBy(*keys, "_run").agg(
        F.min("_o").alias("onset"), F.max("_o").alias("offset"), F.count(F.lit(1)).alias("n_samples"), F.max(v).alias("peak"))
    return row_index(runs, keys, "_run", (), target_rows).select(*keys, F.col("idx").alias("burst"), "onset", "offset", "n_samples", "peak")
