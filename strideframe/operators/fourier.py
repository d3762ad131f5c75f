"""Fourier sums of channels of any length, in groups of bounded size.

A sum of any period is a convolution with a chirp, and that runs through transforms whose length is a power of two.
Those are taken in two steps on a grid: transforms down the columns, twiddles, transforms along the rows.  Tiles of
the grid travel between the steps as bytes, so a group holds some columns or some rows and never a channel.  Channels
whose grid is a single tile need not travel: `many_sums` takes as many of them at once as fill a tile.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE = 1 << 18
_SIZES = ["period", "n_in", "n_out"]


def _chirp(k: np.ndarray, period: int, sign: int) -> np.ndarray:
    """exp(sign * i * pi * k^2 / period); squares stay exact for k up to 3e9."""
    return np.exp(sign * 1j * np.pi * (np.mod(k * k, 2 * period) / period))


def _grid(n_in: int, n_out: int, tile: int) -> tuple[int, int, int, int]:
    """Rows and columns of the grid, columns to a group of columns, rows to a group of rows; all powers of two."""
    bits = (n_in + n_out - 2).bit_length()
    rows, cols = 1 << (bits - bits // 2), 1 << (bits // 2)
    return rows, cols, max(1, min(cols, tile // rows)), max(1, min(rows, tile // cols))


def _twiddle(k: np.ndarray, c: np.ndarray, size: int, sign: int) -> np.ndarray:
    return np.exp(sign * 2j * np.pi * ((k[:, None] * c[None, :]) / size))


def many_sums(x: np.ndarray, n_in: np.ndarray, n_out: np.ndarray, period: np.ndarray, sign: int) -> np.ndarray:
    """`fourier_sums` of short channels, each a row of ``x`` with zeros behind its n_in values; what is behind its n_out sums is void."""
    size = 1 << int((n_in + n_out - 2).max()).bit_length()
    i, j, k = np.arange(x.shape[1]), np.arange(n_out.max()), np.arange(size)
    n_in, n_out, period = n_in[:, None], n_out[:, None], period[:, None]
    apart = np.where(k < n_out, k, k - size)
    b = np.where(apart > -n_in, _chirp(apart, period, -sign), 0)
    y = np.fft.ifft(np.fft.fft(x * _chirp(i, period, sign), size) * np.fft.fft(b))
    return y[:, : len(j)] * _chirp(j, period, sign)


def fourier_sums(df: DataFrame, keys: Sequence[str], sign: int, carry: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Per key: sum over idx of (re + i im) * exp(sign * 2 pi i * j * idx / period) for 0 <= j < n_out.

    ``df`` has keys, ``idx`` (0 to n_in - 1, each once), ``re``, ``im`` and, the same in all rows of a key, ``period``,
    ``n_in``, ``n_out`` and the columns ``carry``.  Returns keys, idx (= j), re, im, carry.  ``tile`` is the number of
    complex values in a group; three shuffles, each about the size of the padded channel.
    """
    tile = 1 << (max(tile, 1).bit_length() - 1)
    same = [*_SIZES, *carry]
    kept = [df.schema[c] for c in keys]
    const = [df.schema[c] for c in same]
    tiles = T.StructType([*kept, T.StructField("part", T.LongType()), T.StructField("at", T.LongType()), T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()), *const])
    sums = T.StructType([*kept, T.StructField("idx", T.LongType()), T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType()), *[df.schema[c] for c in carry]])

    bits = F.when(F.col("n_in") + F.col("n_out") <= 2, 0).otherwise(F.length(F.bin(F.col("n_in") + F.col("n_out") - 2)))
    sized = df.select(*keys, "idx", "re", "im", *same, bits.alias("_bits")).withColumn("_cols", F.expr("shiftleft(1L, cast(_bits div 2 as int))"))
    wide = F.greatest(F.lit(1), F.least(F.col("_cols"), F.floor(F.lit(tile) / F.expr("shiftleft(1L, cast(_bits - _bits div 2 as int))")))).cast("long")
    sized = sized.withColumn("_wide", wide)
    # every group of columns needs a row, for the chirp stands in all of them
    seeds = sized.where("idx = 0").select(*keys, F.lit(-1).cast("long").alias("idx"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im"), *same,
                                          F.explode(F.expr("sequence(0L, cast(_cols / _wide as long) - 1)")).alias("part"))
    placed = sized.select(*keys, F.col("idx").cast("long").alias("idx"), "re", "im", *same, F.floor((F.col("idx") % F.col("_cols")) / F.col("_wide")).cast("long").alias("part"))

    def sizes(rows: pa.Table) -> tuple:
        period, n_in, n_out = (rows[c][0].as_py() for c in _SIZES)
        return period, n_in, n_out, *_grid(n_in, n_out, tile)

    def labelled(key: tuple, rows: pa.Table, n: int, own: dict, constants: Sequence[str]) -> pa.Table:
        """The group's columns between its key and its constants."""
        fixed = {c: pa.repeat(x, n) for c, x in [*zip(keys, key), *[(c, rows[c][0]) for c in constants]]}
        return pa.table({c: fixed[c] for c in keys} | own | {c: fixed[c] for c in constants})

    def cut(key: tuple, rows: pa.Table, a: np.ndarray, b: np.ndarray | None, axis: int, step: int) -> pa.Table:
        """The array in tiles along an axis; ``part`` names the group that reads it next, ``at`` the one it came from."""
        pieces = a.shape[axis] // step
        raw = [pa.array([None] * pieces if x is None else [np.ascontiguousarray(p).tobytes() for p in np.split(x, pieces, axis)], pa.binary()) for x in (a, b)]
        return labelled(key, rows, pieces, {"part": pa.array(np.arange(pieces)), "at": pa.repeat(key[-1], pieces), "a": raw[0], "b": raw[1]}, same)

    def gather(rows: pa.Table, col: str, shape: tuple[int, int], axis: int) -> np.ndarray:
        order = np.argsort(rows["at"].to_numpy())
        return np.concatenate([np.frombuffer(rows[col][int(i)].as_buffer(), complex).reshape(shape) for i in order], axis)

    def down(key: tuple, rows: pa.Table) -> pa.Table:
        period, n_in, n_out, high, cols, nc, nr = sizes(rows)
        c, r, size = key[-1].as_py() * nc + np.arange(nc), np.arange(high), high * cols
        i, re, im = (rows[x].to_numpy() for x in ("idx", "re", "im"))
        real = i >= 0
        i, x = i[real], re[real] + 1j * im[real]
        a = np.zeros((high, nc), complex)
        a[i // cols, i % cols - c[0]] = x * _chirp(i, period, sign)
        apart = r[:, None] * cols + c[None, :]
        apart = np.where(apart < n_out, apart, apart - size)
        b = np.where(apart > -n_in, _chirp(apart, period, -sign), 0)
        turn = _twiddle(r, c, size, -1)
        return cut(key, rows, np.fft.fft(a, axis=0) * turn, np.fft.fft(b, axis=0) * turn, 0, nr)

    def along(key: tuple, rows: pa.Table) -> pa.Table:
        _, _, _, high, cols, nc, nr = sizes(rows)
        a, b = (np.fft.fft(gather(rows, x, (nr, nc), 1), axis=1) for x in "ab")
        k = key[-1].as_py() * nr + np.arange(nr)
        return cut(key, rows, np.fft.ifft(a * b, axis=1) * _twiddle(k, np.arange(cols), high * cols, 1), None, 1, nc)

    def back(key: tuple, rows: pa.Table) -> pa.Table:
        period, _, n_out, high, cols, nc, nr = sizes(rows)
        y = np.fft.ifft(gather(rows, "a", (nr, nc), 0), axis=0)
        j = np.arange(high)[:, None] * cols + key[-1].as_py() * nc + np.arange(nc)[None, :]
        j, y = j[j < n_out], y[j < n_out]
        y = y * _chirp(j, period, sign)
        return labelled(key, rows, len(j), {"idx": pa.array(j), "re": pa.array(y.real), "im": pa.array(y.imag)}, carry)

    grid = placed.unionByName(seeds).groupBy(*keys, "part").applyInArrow(down, tiles)
    grid = grid.groupBy(*keys, "part").applyInArrow(along, tiles)
    return grid.groupBy(*keys, "part").applyInArrow(back, sums)
