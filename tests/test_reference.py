"""The robust reference from second moments against the same rounds over the samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.operators import reference

NAMES = [f"c{i}" for i in range(5)]


def recordings(spark, missing=False):
    r = np.random.default_rng(11)
    rows = []
    for rec, n in (("long", 2500), ("short", 40), ("two", 2), ("one", 1), ("common", 300), ("same", 90)):
        common = np.cumsum(r.normal(size=n))
        x = np.stack([common * g + r.normal(size=n) for g in (0.2, 0.5, 0.9, 1.3, 1.7)])
        if rec == "long":
            x[4] *= 25
            x[0] = r.normal(size=n) * 8
        if rec == "common":  # nearly everything is taken off
            x = 1e7 * common + 0.01 * x
        if rec == "same":
            x[:] = x[0]
        rows += [(rec, i, *(None if missing and rec in ("long", "two") and (i + k) % 7 == 0 else float(v[i]) for k, v in enumerate(x))) for i in range(n)]
    return spark.createDataFrame(rows, "rec string, i long, " + ", ".join(f"{c} double" for c in NAMES)).repartition(5)


@pytest.mark.parametrize("missing", [False, True])
def test_moments_give_the_rounds_over_the_samples(spark, monkeypatch, missing):
    wide = recordings(spark, missing)
    marks = lambda: reference.bad_channels(wide, ["rec"], NAMES, "i", limit=2.5, least_corr=0.05, max_iter=5).toPandas().set_index(["rec", "channel"]).sort_index()
    got = marks()
    assert len(got) == 30 and got.loc["long", "bad"].any()
    unknown = F.lit(None).cast("array<double>")
    monkeypatch.setattr(reference, "_from_moments", lambda *_: F.struct(
        *[unknown.alias(c) for c in ("deviation", "roughness", "best_corr")], F.lit(False).alias("sure")))  # every recording goes over its samples
    want = marks()
    for c in ("bad", "rounds"):
        assert (got[c] == want[c]).all(), c
    assert got["why"].fillna("").tolist() == want["why"].fillna("").tolist()
    for c in ("deviation", "roughness", "best_corr"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-12, err_msg=c)


def test_steps_cross_cells(spark, monkeypatch):
    wide = recordings(spark).where("rec in ('long', 'short')")
    whole = reference._second_moments(wide, ["rec"], NAMES, "i", []).orderBy("rec").toPandas()
    cut = reference.add_cell
    monkeypatch.setattr(reference, "add_cell", lambda df, keys, order, tie: cut(df, keys, order, 100, tie))
    many = reference._second_moments(wide, ["rec"], NAMES, "i", []).orderBy("rec").toPandas()
    x = wide.where("rec = 'long'").orderBy("i").toPandas()[NAMES].to_numpy()
    d = np.diff(x, axis=0)
    for got in (whole, many):
        assert got["n"].tolist() == [2500, 40] and got["missing"].tolist() == [0, 0]
        np.testing.assert_allclose(got["steps"][0], (d.T @ d)[np.triu_indices(5)], rtol=1e-9)
        np.testing.assert_allclose(got["cov"][0], np.cov(x.T, bias=True)[np.triu_indices(5)], rtol=1e-9)


def test_complete_samples_are_read_once(spark, monkeypatch):
    """No round goes back to the samples of complete recordings."""
    monkeypatch.setattr(reference, "with_differences", None)
    monkeypatch.setattr(reference, "_moments", None)
    marks = reference.bad_channels(recordings(spark).where("rec in ('long', 'short')"), ["rec"], NAMES, "i", limit=2.5, least_corr=0.05)
    assert marks.count() == 10 and marks.where("rounds > 1").count() > 0
