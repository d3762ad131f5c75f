"""Operators that need a sampling rate, over channels with rates of their own."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.fixed import FALLBACK_HZ


def by_rate(df: DataFrame, fs: str, run: Callable[[DataFrame, float], DataFrame], fallback: float = FALLBACK_HZ) -> DataFrame:
    """``run(rows, rate)`` for the rows of every distinct value of ``fs``, put together again with that column.

    Filter designs and segment lengths follow from the rate, so each distinct one has its own plan; recordings have as
    many as there are sensor models and modalities.  Missing rates, and rates that are not positive, take ``fallback``.
    """
    rated = df.withColumn(fs, F.when(F.col(fs) > 0, F.col(fs).cast("double")).otherwise(F.lit(float(fallback))))
    found = [r[0] for r in rated.select(fs).distinct().orderBy(fs).collect()] or [float(fallback)]
    parts = [run(rated.where(F.col(fs) == rate).drop(fs), rate).withColumn(fs, F.lit(rate)) for rate in found]
    return reduce(DataFrame.unionByName, parts)
