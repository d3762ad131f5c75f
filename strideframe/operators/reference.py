"""Robust average reference: channels that stand out are left out of it until the set is stable."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from strideframe.functions.numeric import EPS, corr_guarded
from strideframe.operators.ordered import CELL, add_cell, adjacent_pairs
from strideframe.session import stage

#: Robust z-scores beyond LIMIT are bad, as is a channel whose best correlation stays below LEAST_CORR; fixed values.
LIMIT, LEAST_CORR = 5.0, 0.4
#: Median absolute deviation to standard deviation.
SCALE = 1.4826
#: Second moments are trusted while this share of a sum of squares is left after the reference is taken off.
LEFT = 1e-6


def _average(values: Column, bad: Column) -> Column:
    """Mean of the values whose place in `bad` is false."""
    good = F.filter(F.zip_with(values, bad, lambda v, b: F.when(~b, v)), lambda v: v.isNotNull())
    return F.when(F.size(good) > 0, F.aggregate(good, F.lit(0.0), lambda a, v: a + v) / F.size(good))


def _robust_z(value: str, of: Column, keys: Sequence[str]) -> dict[str, Column]:
    """`_m`, `_s` and `z_<value>`, to be added one after another: distance from the median of a key's good channels in robust
    deviations; channels are few."""
    whole = W.partitionBy(*keys)
    return {"_m": F.median(F.when(of, F.col(value))).over(whole), "_s": F.median(F.when(of, F.abs(F.col(value) - F.col("_m")))).over(whole),
            f"z_{value}": (F.col(value) - F.col("_m")) / F.nullif(F.col("_s") * SCALE, F.lit(0.0))}


def _moments(rows: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """keys, channel, range, deviation, roughness and best_corr of every channel of (keys, x, d, e: arrays of values, the same
    less the reference, and their differences)."""
    n = len(channels)
    d, e = [F.col("d")[i] for i in range(n)], [F.col("e")[i] for i in range(n)]
    facts = [F.struct(F.lit(c).alias("channel"), (F.max(F.col("x")[i]) - F.min(F.col("x")[i])).alias("range"), F.stddev_pop(d[i]).alias("deviation"),
                      (F.sum(e[i] * e[i]) / F.nullif(F.sum(d[i] * d[i]), F.lit(0.0))).alias("roughness"),
                      F.greatest(F.lit(0.0), *[F.abs(corr_guarded(*sorted_pair(d, i, j))) for j in range(n) if j != i]).alias("best_corr")) for i, c in enumerate(channels)]
    return rows.groupBy(*keys).agg(F.array(*facts).alias("f")).select(*keys, F.inline("f"))


def sorted_pair(d: list[Column], i: int, j: int) -> tuple[Column, Column]:
    """The pair in one order, so that its sums are computed once for both channels."""
    return d[min(i, j)], d[max(i, j)]


def with_differences(wide: DataFrame, keys: Sequence[str], channels: Sequence[str], order: str, tie: Sequence[str] = ()) -> DataFrame:
    """keys, order, tie, x (the channels' values) and dx, their steps from the sample before (null in the first)."""
    values = wide.select(*keys, order, *tie, F.array(*[F.col(c).cast("double") for c in channels]).alias("x"))
    pairs = adjacent_pairs(values, keys, order, tie, ["x"])
    steps = pairs.select(*keys, *[F.col(f"cur.{c}").alias(c) for c in (order, *tie)], F.zip_with("cur.x", "prev.x", lambda a, b: a - b).alias("dx"))
    return values.join(steps, [*keys, order, *tie], "left")


def _second_moments(values: DataFrame, keys: Sequence[str], names: Sequence[str], order: str, tie: Sequence[str]) -> DataFrame:
    """keys, n, missing (rows with a null), range, means and cov (of the samples) and steps (sums of products of the differences
    from the sample before) of each key; cov and steps are upper triangles, row by row."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    x = [F.col(c) for c in names]
    missing = F.count_if(reduce(lambda a, c: a | c, [c.isNull() for c in x])).alias("missing")
    facts = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), missing, F.array(*[F.max(c) - F.min(c) for c in x]).alias("range"),
                                      F.array(*[F.avg(c) for c in x]).alias("means"), F.array(*[F.covar_pop(x[i], x[j]) for i, j in pairs]).alias("cov"))
    cell = W.partitionBy(*keys, CELL).orderBy(order, *tie)
    marked = add_cell(values, keys, order, tie=tie).select(
        *keys, CELL, *names, *[(F.col(c) - F.lag(c).over(cell)).alias(f"_d{i}") for i, c in enumerate(names)],
        F.lag(F.lit(1)).over(cell).isNull().alias("_first"), F.lead(F.lit(1)).over(cell).isNull().alias("_last"))
    d = [F.col(f"_d{i}") for i in range(len(names))]
    cells = marked.groupBy(*keys, CELL).agg(*[F.sum(d[i] * d[j]).alias(f"_p{k}") for k, (i, j) in enumerate(pairs)],
                                            *[F.max(F.when(F.col("_first"), c)).alias(f"_head{i}") for i, c in enumerate(x)],
                                            *[F.max(F.when(F.col("_last"), c)).alias(f"_tail{i}") for i, c in enumerate(x)])
    before = W.partitionBy(*keys).orderBy(CELL)
    cells = cells.select(*keys, *[f"_p{k}" for k in range(len(pairs))], *[(F.col(f"_head{i}") - F.lag(f"_tail{i}").over(before)).alias(f"_d{i}") for i in range(len(names))])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    steps = cells.groupBy(*keys).agg(F.array(*[total(f"_p{k}") + total(d[i] * d[j]) for k, (i, j) in enumerate(pairs)]).alias("steps"))
    return facts.join(steps, list(keys))


@F.pandas_udf(T.StructType([*[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("deviation", "roughness", "best_corr")], T.StructField("sure", T.BooleanType())]))
def _from_moments(n: pd.Series, missing: pd.Series, means: pd.Series, cov: pd.Series, steps: pd.Series, bad: pd.Series) -> pd.DataFrame:
    """What `_moments` sums over the samples, from second moments: taking off a mean of channels is a linear map.

    Not `sure` where values are missing, or where so much cancels that fewer than ten digits are left.
    """
    out = []
    for n, missing, means, cov, steps, bad in zip(n, missing, means, cov, steps, bad):
        if missing:
            out.append((None, None, None, False))
            continue
        size = len(means)
        upper = np.triu_indices(size)
        c, e = np.zeros((size, size)), np.zeros((size, size))
        c[upper], e[upper] = cov, steps
        c, e = c + np.triu(c, 1).T, e + np.triu(e, 1).T
        good = ~np.asarray(bad, dtype=bool)
        w = np.eye(size) - good / good.sum()
        d, ee = w @ c @ w.T, np.diag(w @ e @ w.T)
        var = np.diag(d)
        whole, whole_e = (np.diag(np.abs(w) @ np.abs(m) @ np.abs(w).T) for m in (c, e))
        sure = bool(np.all(var > LEFT * whole) and np.all((ee > LEFT * whole_e) | (whole_e == 0)))
        if not sure:
            out.append((None, None, None, False))
            continue
        dev = np.sqrt(var)
        corr = np.abs(d) / np.outer(dev, dev) * ((dev > EPS)[:, None] & (dev > EPS) & (n >= 2))
        np.fill_diagonal(corr, 0.0)
        out.append((dev, ee / (n * (var + (w @ means) ** 2)), corr.max(axis=1), True))
    return pd.DataFrame(out, columns=["deviation", "roughness", "best_corr", "sure"])


def bad_channels(wide: DataFrame, keys: Sequence[str], channels: Sequence[str], order: str, tie: Sequence[str] = (), limit: float = LIMIT,
                 least_corr: float = LEAST_CORR, max_iter: int = 20) -> DataFrame:
    """keys, channel, deviation, roughness, best_corr, bad, why and rounds: what is left out of the robust reference.

    ``wide`` has a row per sample and a column per channel (a fixed list; ``order`` with ``tie`` is unique per key).  In
    each round the mean of the channels not yet found bad is taken off every sample; a channel is bad when its deviation
    or the share of its steps in its power (high frequencies) lies more than ``limit`` robust deviations above the median
    of the good channels, when the deviation lies as far below, when it has one value only (flat), or when no other channel correlates with it by
    ``least_corr``.  Found ones stay out; it ends when a round finds none.  A key never loses its last two channels: if a
    round would, its channels of that round are kept.  The samples are read for their second moments once; a round takes its
    figures from these.  Keys with missing values, and those where the reference cancels nearly everything, are one
    aggregation over their samples in each round.  A round is a staged table with one row per channel.
    """
    n = len(channels)
    names = [f"_x{i}" for i in range(n)]
    values = stage(wide.select(*keys, order, *tie, *[F.col(c).cast("double").alias(x) for c, x in zip(channels, names)]))
    sums = stage(_second_moments(values, keys, names, order, tie))
    live = sums.select(*keys, F.array_repeat(F.lit(False), n).alias("bad"), F.array_repeat(F.lit(None).cast("string"), n).alias("whys"), F.lit(0).alias("rounds"))
    rows, rounds, whole = None, [], W.partitionBy(*keys)
    label = F.array(*[F.lit(c) for c in channels])
    while len(rounds) < max_iter and not live.isEmpty():
        facts = sums.join(live, list(keys)).withColumn("f", _from_moments("n", "missing", "means", "cov", "steps", "bad"))
        unsure = facts.where("not f.sure").select(*keys, *live.drop(*keys).columns)
        facts = facts.where("f.sure").select(*keys, "bad", "whys", "rounds", F.inline(F.arrays_zip(
            label.alias("channel"), F.col("range"), F.col("f.deviation").alias("deviation"), F.col("f.roughness").alias("roughness"), F.col("f.best_corr").alias("best_corr"))))
        if not unsure.isEmpty():
            if rows is None:
                rows = stage(with_differences(values.withColumnsRenamed(dict(zip(names, channels))), keys, channels, order, tie))
            off = lambda x: F.transform(x, lambda v: v - _average(x, F.col("bad")))
            joined = rows.join(unsure, list(keys)).select(*keys, "x", off(F.col("x")).alias("d"), off(F.col("dx")).alias("e"))
            facts = facts.unionByName(_moments(joined, keys, channels).join(unsure, list(keys)))
        place = F.array_position(label, F.col("channel")).cast("int")
        found = facts.withColumn("place", place).withColumns({"was": F.element_at("bad", F.col("place")), "old": F.element_at("whys", F.col("place"))})
        for value in ("deviation", "roughness"):
            for name, column in _robust_z(value, ~F.col("was"), keys).items():
                found = found.withColumn(name, column)
        why = F.when(F.col("range").isNull() | (F.col("range") == 0), "flat").when(F.abs("z_deviation") > limit, "deviation").when(
            F.col("z_roughness") > limit, "roughness").when(F.col("best_corr") < least_corr, "correlation")
        found = found.withColumn("new", F.when(~F.col("was"), why))
        next_bad = F.col("was") | F.col("new").isNotNull()
        enough = F.sum(F.when(~next_bad, 1).otherwise(0)).over(whole) >= 2
        found = found.withColumns({"now": F.when(enough, next_bad).otherwise(F.col("was")), "open": enough & (F.count("new").over(whole) > 0)})
        found = stage(found.select(*keys, "channel", "place", "deviation", "roughness", "best_corr", F.col("now").alias("bad"),
                                   F.coalesce("old", F.when(F.col("now"), F.col("new"))).alias("why"), (F.col("rounds") + 1).alias("rounds"), "open"))
        rounds.append(found)
        marks = F.sort_array(F.collect_list(F.struct("place", "bad", "why")))
        live = found.where("open").groupBy(*keys).agg(marks["bad"].alias("bad"), marks["why"].alias("whys"), F.first("rounds").alias("rounds"))
    if not rounds:
        return values.select(*keys, F.lit("").alias("channel"), *[F.lit(0.0).alias(c) for c in ("deviation", "roughness", "best_corr")],
                             F.lit(False).alias("bad"), F.lit("").alias("why"), F.lit(0).alias("rounds")).limit(0)
    # a key's rows are those of its last round
    last = reduce(DataFrame.unionByName, [*[r.where("not open") for r in rounds[:-1]], rounds[-1]])
    return last.drop("place", "open")


def referenced(wide: DataFrame, marks: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """``wide`` with the mean of the channels that ``marks`` (``bad_channels``) leaves good taken off every channel, and `reference`."""
    good = marks.groupBy(*keys).agg(F.collect_set(F.when(~F.col("bad"), F.col("channel"))).alias("_good"))
    rows = wide.join(good, list(keys))
    bad = F.array(*[~F.array_contains("_good", c) for c in channels])
    rows = rows.withColumn("reference", _average(F.array(*[F.col(c).cast("double") for c in channels]), bad)).drop("_good")
    return rows.select(*[(F.col(c) - F.col("reference")).alias(c) if c in channels else F.col(c) for c in rows.columns])
