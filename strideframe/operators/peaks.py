"""Peaks with a minimum distance and prominence, exact on channels of any length.

A block decides the peaks it owns from its own rows plus a halo.  A peak whose outcome could depend on
rows beyond the halo is left open; open blocks are read again with a larger halo, until none is left.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideframe.operators.ordered import TARGET_ROWS, blocks, row_index
from strideframe.session import stage

BLOCK_ROWS = 65_536


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Samples (plateau centres, rounded down) higher than both neighbours; never the first or last."""
    change = np.flatnonzero(np.diff(x) != 0)
    start, end = np.r_[0, change + 1], np.r_[change, len(x) - 1]
    level = x[start]
    inner = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1 if len(level) > 2 else np.empty(0, int)
    return (start[inner] + end[inner]) // 2


def _thin(pos: np.ndarray, height: np.ndarray, distance: int, lo_open: int, hi_open: int) -> np.ndarray:
    """Highest-first thinning: 1 kept, 0 dropped, -1 not decidable because an unseen peak could matter."""
    state = np.full(len(pos), 2)
    for i in np.lexsort((pos, height))[::-1]:
        left, right = np.searchsorted(pos, [pos[i] - distance + 1, pos[i] + distance - 1 + 1])
        near = state[left:right]
        if (near == 1).any():
            state[i] = 0
        elif (near == -1).any() or pos[i] - distance < lo_open or pos[i] + distance > hi_open:
            state[i] = -1
        else:
            state[i] = 1
    return state


def _next_higher(x: np.ndarray) -> np.ndarray:
    """For every sample the place of the first higher one after it, len(x) if none; one pass with a stack."""
    out, open_ = np.full(len(x), len(x)), []
    for i, v in enumerate(np.where(np.isnan(x), -np.inf, x).tolist()):
        while open_ and open_[-1][1] < v:
            out[open_.pop()[0]] = i
        open_.append((i, v))
    return out


class _Drops:
    """The prominence test of one context, both sides, in constant time for each peak."""

    def __init__(self, x: np.ndarray):
        self.x, n = x, len(x)
        self.right, self.left = _next_higher(x), n - 1 - _next_higher(x[::-1])[::-1]
        self.least = [x]
        while 2 << (len(self.least) - 1) <= n:  # minima of 1, 2, 4, ... samples
            half = 1 << (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def test(self, i: int, need: float, step: int, at_end: bool) -> int:
        """1 passes, 0 fails, -1 undecided inside this context."""
        a, b = (i + 1, int(self.right[i])) if step > 0 else (int(self.left[i]) + 1, i)
        if a < b:
            level = int(b - a).bit_length() - 1
            if min(self.least[level][a], self.least[level][b - (1 << level)]) <= self.x[i] - need:
                return 1
        bounded = b < len(self.x) if step > 0 else a > 0
        return 0 if bounded or at_end else -1


def find_peaks(df: DataFrame, keys: Sequence[str], order: str, v: str = "v", tie: Sequence[str] = (), distance: int = 50, prominence: float = 0.1,
               height: float | None = None, block_rows: int = BLOCK_ROWS, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Peaks of each key: keys, idx, order, v."""
    indexed = stage(row_index(df.select(*dict.fromkeys([*keys, order, *tie, v])), keys, order, tie, target_rows))
    schema = T.StructType([*[df.schema[c] for c in keys], T.StructField("block", T.LongType()), T.StructField("idx", T.LongType()), T.StructField(order, df.schema[order].dataType),
                           T.StructField(v, T.DoubleType()), T.StructField("open", T.BooleanType())])

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        x, idx, core, n = pdf[v].to_numpy(dtype=float), pdf["idx"].to_numpy(), pdf["core"].to_numpy(dtype=bool), int(pdf["n"].iloc[0])
        first, last = bool(idx[0] == 0), bool(idx[-1] == n - 1)
        pos = local_maxima(x)
        if height is not None:
            pos = pos[x[pos] >= height]
        # a plateau at the edge of the context hides whether it is a peak
        level = np.flatnonzero(np.diff(x) != 0)
        lo = -np.inf if first else (level[0] + 1 if len(level) else len(x))
        hi = np.inf if last else (level[-1] if len(level) else -1)
        state = _thin(pos, x[pos], max(distance, 1), lo, hi)
        rows, undecided = [], False
        drops = _Drops(x) if prominence > 0 and len(pos) else None
        for i, s in zip(pos, state):
            if not core[i] or s == 0:
                continue
            sides = (1, 1) if drops is None else (drops.test(i, prominence, -1, first), drops.test(i, prominence, 1, last))
            if 0 in sides:
                continue
            if s == -1 or -1 in sides:
                undecided = True
            else:
                rows.append(i)
        own = np.flatnonzero(core)
        undecided = undecided or bool(len(own)) and (own[0] < lo or own[-1] > hi)
        if undecided:
            return pd.DataFrame([[*key, -1, None, None, True]], columns=schema.names)
        return pd.DataFrame({**dict(zip([*keys, "block"], key)), "idx": idx[rows], order: pdf[order].to_numpy()[rows], v: x[rows], "open": False})

    halo = max(4 * distance, 256)
    found, todo = None, None
    while True:
        placed = blocks(indexed, block_rows, halo, halo)
        if todo is not None:
            placed = placed.join(todo, [*keys, "block"], "left_semi")
        done = stage(placed.groupBy(*keys, "block").applyInPandas(kernel, schema))
        part = done.where("not open")
        found = part if found is None else found.unionByName(part)
        todo = done.where("open").select(*keys, "block")
        if todo.isEmpty():
            return found.select(*keys, "idx", order, v)
        halo *= 8
