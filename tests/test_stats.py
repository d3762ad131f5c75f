"""Tests and corrections on hand-worked input."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strideframe.functions.distributions import chi2_1_sf, normal_two_sided_p, t_quantile, t_two_sided_p
from strideframe.operators import paired, permutation


def test_tails(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.5, 10.0), (0.0, 3.0)], "x double, df double")
    got = df.select(t_two_sided_p(F.col("x"), F.col("df")), chi2_1_sf(F.col("x")), normal_two_sided_p(F.col("x"))).collect()
    assert abs(got[0][0] - 0.5) < 1e-12 and abs(got[1][0] - 0.031446844236) < 1e-9 and abs(got[2][0] - 1) < 1e-12
    for r, x in zip(got, (1.0, 2.5, 0.0)):
        assert abs(r[1] - math.erfc(math.sqrt(x / 2))) < 1e-12 and abs(r[2] - math.erfc(x / math.sqrt(2))) < 1e-12


def test_t_quantile_inverts_tail(spark):
    df = spark.createDataFrame([(float(n),) for n in (1, 2, 5, 30, 400, 100000)], "df double").withColumn("q", t_quantile(F.col("df")))
    back = df.select("df", "q", t_two_sided_p(F.col("q"), F.col("df")).alias("p")).toPandas()
    np.testing.assert_allclose(back["p"], 0.05, rtol=1e-7)
    assert abs(back["q"][0] - 12.706204736) < 1e-6


def test_paired_edge_cases(spark):
    rows = [("ok", 1.0, 2.0), ("ok", 2.0, 4.0), ("ok", 3.0, 4.0), ("ok", None, 1.0), ("ok", float("nan"), 1.0), ("flat", 1.0, 2.0), ("flat", 2.0, 3.0), ("one", 1.0, 2.0), ("none", None, 1.0)]
    got = paired.paired_t(spark.createDataFrame(rows, "k string, v0 double, v1 double"), ["k"], medians=False).toPandas().set_index("k")
    assert got.loc["ok", "n_pairs"] == 3 and abs(got.loc["ok", "t_stat"] - 4.0) < 1e-12 and abs(got.loc["ok", "mean_change"] - 4 / 3) < 1e-12
    assert got.loc["flat", "notes"] == "zero_variance_in_difference" and pd.isna(got.loc["flat", "p_value"]) and got.loc["flat", "mean_change"] == 1
    assert got.loc["one", "notes"] == "too_few_pairs" and got.loc["none", "n_pairs"] == 0


def test_bh_with_ties_and_nulls(spark):
    p = [0.01, 0.04, 0.03, 0.03, None, 0.9]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(p)] + [(None, 9, 0.2)], "fam string, i int, p_value double")
    got = paired.bh_fdr(df, ["fam"], "p_value", ["i"]).toPandas().set_index("i")["q_value"]
    np.testing.assert_allclose(got[[0, 1, 2, 3, 5, 9]], [0.05, 0.05, 0.05, 0.05, 0.9, 0.2])
    assert pd.isna(got[4])


@pytest.mark.parametrize("b,c,p", [(0, 0, 1.0), (0, 5, math.erfc(math.sqrt(3.2 / 2))), (3, 9, math.erfc(math.sqrt(25 / 12 / 2)))])
def test_mcnemar(spark, b, c, p):
    rows = [("g", 0.0, 1.0)] * b + [("g", 1.0, 0.0)] * c + [("g", 1.0, 1.0)] * 4 + [("g", 0.0, 0.0)] * 3
    got = paired.mcnemar(spark.createDataFrame(rows, "k string, v0 double, v1 double"), ["k"]).collect()[0]
    assert (got["b"], got["c"]) == (b, c) and abs(got["p_value"] - p) < 1e-12


def test_wilcoxon_exact_small(spark):
    # differences 1..5 all positive: p = 2 / 2**5
    rows = [("g", 0.0, float(d)) for d in range(1, 6)]
    got = paired.wilcoxon(spark.createDataFrame(rows, "k string, v0 double, v1 double"), ["k"]).collect()[0]
    assert got["exact"] and got["w_plus"] == 15 and abs(got["p_wilcoxon"] - 2 / 32) < 1e-12


@pytest.mark.parametrize("size", [3, 60, 900])
def test_permutation_equals_sorting_all_hashes(spark, size):
    rng = np.random.default_rng(2)
    rows = [("g", i, s, [float(x) for x in rng.normal(0.4 * (s == "T1") / size**0.5, 1, 3)]) for s in ("T0", "T1") for i in range(size + (s == "T1"))]
    rows += [("tiny", 1, "T0", [1.0, 2.0, 3.0]), ("tiny", 1, "T1", [1.0, 2.0, 3.0]), ("left", 1, "T0", [1.0, 2.0, 3.0]), ("g", 1, "T9", [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "k string, u int, s string, y array<double>")
    got = permutation.permutation_test(df, ["k"], "u", "s", "y", 3, 50).toPandas().set_index("k")
    own = [r for r in rows if r[0] == "g" and r[2] != "T9"]
    y, first = np.array([r[3] for r in own]), np.array([r[2] == "T0" for r in own])

    def stat(chosen):
        return np.abs(y[chosen].mean(0) - y[~chosen].mean(0)).mean()

    reached = 0
    for perm in range(1, 51):
        order = np.argsort([hashlib.md5(f"{perm}:{u}:{s}".encode()).hexdigest() for _, u, s, _ in own])
        chosen = np.zeros(len(own), bool)
        chosen[order[: first.sum()]] = True
        reached += stat(chosen) >= stat(first) * (1 - 1e-9)
    assert abs(got.loc["g", "stat_observed"] - stat(first)) < 1e-12
    assert abs(got.loc["g", "p_value"] - (1 + reached) / 51) < 1e-12
    assert got.loc["tiny", "p_value"] == 1.0 and pd.isna(got.loc["left", "p_value"])


def test_dispatch_and_labels(spark):
    rows = [("m", 0.5, 1.5), ("m", 1.0, 3.0), ("m", 2.0, 2.5), ("b", 0.0, 1.0), ("b", 1.0, 1.0), ("x_presence", 0.0, 1.0), ("x_presence", 0.2, 0.9)]
    got = paired.paired_tests(spark.createDataFrame(rows, "metric string, v0 double, v1 double"), ["metric"]).toPandas().set_index("metric")
    assert got["test_type"].to_dict() == {"m": "paired_t", "b": "mcnemar", "x_presence": "chi2"}
    assert (got["direction"] == "increase").all()
