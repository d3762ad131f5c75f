"""Block-wise peaks against a direct implementation on the whole channel."""

import numpy as np
import pandas as pd
import pytest

from strideframe.operators import peaks


def direct(x, distance, prominence):
    pos = list(peaks.local_maxima(x))
    keep = {}
    for i in sorted(pos, key=lambda p: (x[p], p), reverse=True):
        keep[i] = not any(keep.get(j) and abs(i - j) < distance for j in pos)
    out = []
    for i in (p for p in pos if keep[p]):
        left = i
        while left > 0 and x[left - 1] <= x[i]:
            left -= 1
        right = i
        while right < len(x) - 1 and x[right + 1] <= x[i]:
            right += 1
        if x[i] - max(x[left : i + 1].min(), x[i : right + 1].min()) >= prominence:
            out.append(i)
    return out


def test_local_maxima_and_plateaus():
    assert list(peaks.local_maxima(np.array([0, 1, 0, 2, 2, 2, 1, 3, 3.0]))) == [1, 4]
    assert list(peaks.local_maxima(np.array([1.0, 1.0]))) == []


@pytest.mark.parametrize("block", [64, 10_000])
@pytest.mark.parametrize("distance,prominence", [(1, 0.0), (5, 0.5), (50, 2.0), (40, 30.0)])
def test_blocks_agree_with_whole_channel(spark, block, distance, prominence):
    rng = np.random.default_rng(11)
    noise = np.round(np.cumsum(rng.normal(size=1500)), 1)
    ramp = np.arange(900) * 0.1 + np.tile([0.0, 1.0, 0.0], 300)
    rows = pd.concat([pd.DataFrame({"k": k, "t": np.arange(len(x)), "v": x}) for k, x in (("noise", noise), ("ramp", ramp), ("flat", np.ones(300)))])
    got = peaks.find_peaks(spark.createDataFrame(rows), ["k"], "t", distance=distance, prominence=prominence, block_rows=block, target_rows=400).toPandas()
    for k, x in (("noise", noise), ("ramp", ramp), ("flat", np.ones(300))):
        assert sorted(got.loc[got["k"] == k, "idx"]) == direct(x, distance, prominence), k
