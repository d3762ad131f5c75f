"""Numeric kernels against direct definitions."""

import itertools

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strideframe.operators import clusters, factorize, filters, fourier, resample, similarity


def recursive_filtfilt(x, b, a):
    """Textbook forward-backward filter with odd extension and steady-state start."""
    pad = 3 * max(len(a), len(b))

    def once(y):
        comp = np.zeros((len(a) - 1, len(a) - 1))
        comp[:, 0] = -a[1:]
        comp[:-1, 1:] = np.eye(len(a) - 2)
        z = np.linalg.solve(np.eye(len(a) - 1) - comp, b[1:] - a[1:] * b[0]) * y[0]
        out = np.empty_like(y)
        for i, v in enumerate(y):
            out[i] = b[0] * v + z[0]
            z = np.append(z[1:], 0.0) + b[1:] * v - a[1:] * out[i]
        return out

    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    return once(once(ext)[::-1])[::-1][pad:-pad]


def as_frame(spark, x, key="a"):
    return spark.createDataFrame(pd.DataFrame({"k": key, "t": np.arange(len(x)) / 100.0, "v": x}))


@pytest.mark.parametrize("block", [300, 100_000])
@pytest.mark.parametrize("cut", [[5.0], [8.0, 30.0]])
def test_filter_equals_recursion(spark, cut, block):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(size=2500))
    b, a = filters._transfer(4, cut, 100.0)
    stage = filters.lowpass(100.0, 5.0) if len(cut) == 1 else filters.bandpass(100.0, *cut)
    got = filters.filter_channels(as_frame(spark, x), ["k"], "t", [stage], block_rows=block).toPandas().sort_values("t")["filtered"]
    np.testing.assert_allclose(got, recursive_filtfilt(x, b, a), atol=1e-8)


def test_lowpass_design():
    b, a = filters._transfer(4, [10.0], 100.0)
    w = np.exp(-2j * np.pi * np.array([0.0, 10.0]) / 100.0)
    gain = np.abs(np.polyval(b[::-1], w) / np.polyval(a[::-1], w))
    np.testing.assert_allclose(gain, [1.0, np.sqrt(0.5)], rtol=1e-9)


def test_envelope_blocks_agree(spark):
    rng = np.random.default_rng(4)
    df = as_frame(spark, rng.normal(size=4000))
    chain = filters.envelope(100.0)
    one = filters.filter_channels(df, ["k"], "t", chain, block_rows=10**6).toPandas().sort_values("t")["filtered"].to_numpy()
    many = filters.filter_channels(df, ["k"], "t", chain, block_rows=700, target_rows=500).toPandas().sort_values("t")["filtered"].to_numpy()
    np.testing.assert_allclose(one, many, atol=1e-10)
    assert (one >= 0).all()


def test_short_channels_have_a_status(spark):
    df = as_frame(spark, np.ones(5), "five").unionByName(as_frame(spark, np.ones(12), "twelve"))
    got = filters.filter_channels(df, ["k"], "t", [filters.lowpass(100.0, 5.0)]).groupBy("k", "status").count().collect()
    assert {(r["k"], r["status"], r["count"]) for r in got} == {("five", "passthrough", 5), ("twelve", "too_short", 12)}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(0, 10_000))
def test_nnls_is_optimal(k, seed):
    rng = np.random.default_rng(seed)
    w = rng.random((9, k)) * (rng.random((9, k)) > 0.3) + 1e-3
    x = rng.normal(size=(15, 9))
    h = factorize.nnls_rows(x @ w, w.T @ w)
    grad = h @ (w.T @ w) - x @ w
    assert (h >= 0).all() and (grad > -1e-6).all() and np.abs(h * grad).max() < 1e-6


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(0, 10_000))
def test_assignment_is_optimal(k, seed):
    cost = np.random.default_rng(seed).normal(size=(k, k))
    rows = similarity._assign(cost)
    best = min(sum(cost[p[j], j] for j in range(k)) for p in itertools.permutations(range(k)))
    assert sorted(rows) == list(range(k)) and abs(sum(cost[r, j] for j, r in enumerate(rows)) - best) < 1e-9


def test_factorization_recovers_low_rank(spark):
    rng = np.random.default_rng(5)
    w, h = rng.random((8, 2)) * (rng.random((8, 2)) > 0.4), rng.random((120, 2))
    rows = [("t1", [float(v) for v in r]) for r in h @ w.T] + [("t2", [float(v) for v in r]) for r in rng.random((60, 8))]
    df = spark.createDataFrame(rows, "task string, vector array<double>")
    how = {"restarts": 2, "max_iter": 12, "tol": 1e-6}
    near = factorize.factorize(df, ["task"], [1, 2], **how)
    far = factorize.factorize(df, ["task"], [1, 2], **how, block_rows=70)  # t1 over several matrices, t2 in one
    every = factorize.factorize(df, ["task"], [1, 2], **how, block_rows=25)
    assert every.count() == 8 and abs(every.agg({"rss": "sum"}).collect()[0][0] - near.agg({"rss": "sum"}).collect()[0][0]) < 1e-5
    a, b = (x.toPandas().sort_values(["task", "k", "restart"]).reset_index(drop=True) for x in (near, far))
    np.testing.assert_allclose(a["rss"], b["rss"], rtol=1e-6, atol=1e-6)
    assert (a["status"] == "ok").all() and len(a) == 8
    table = factorize.channel_table(factorize.best_fits(near, ["task"]), ["task"], [f"c{i}" for i in range(8)]).where("task = 't1' and k = 2").toPandas()
    assert table["vaf"].dropna().min() > 0.99


@pytest.mark.parametrize("block_rows", [65_536, 40])
def test_factorization_returns_every_task(spark, block_rows):
    rng = np.random.default_rng(6)
    rows = [("big", list(r)) for r in rng.random((150, 5))] + [("wide", list(r)) for r in rng.random((8, 260))] + [("ragged", [1.0] * (2 + i % 2)) for i in range(100)]
    rows += [("none", None), ("inf", [1.0, float("inf")]), ("small", [0.0, 1.0]), ("small", [float("nan"), 2.0])]
    df = spark.createDataFrame([(t, None if v is None else [float(x) for x in v]) for t, v in rows], "task string, vector array<double>")
    got = factorize.factorize(df, ["task"], [1, 2], restarts=1, max_iter=4, block_rows=block_rows).groupBy("task").agg({"status": "max", "k": "count"}).collect()
    assert {r["task"]: (r["max(status)"].split(":")[0], r["count(k)"]) for r in got} == {
        "big": ("ok", 2), "wide": ("ok", 2), "small": ("ok", 2), "ragged": ("failed", 0), "none": ("failed", 0), "inf": ("failed", 0)}


def by_spectrum(x, m):
    """Resampling through the whole spectrum with the library's own transform of any length."""
    n, size = len(x), min(len(x), m)
    spec, out = np.fft.rfft(x), np.zeros(m // 2 + 1, complex)
    out[: size // 2 + 1] = spec[: size // 2 + 1]
    if size % 2 == 0 and m != n:
        out[size // 2] *= 2.0 if m < n else 0.5
    return np.fft.irfft(out, m) * (m / n)


@pytest.mark.parametrize("fs,tile", [(30.0, 16), (171.0, 16), (100.0, 1 << 18), (77.0, 1 << 18)])
def test_fourier_resample_equals_the_spectrum(spark, fs, tile):
    rng = np.random.default_rng(9)
    channels = {f"c{n}": rng.normal(size=n) for n in (1, 2, 40, 41, 50, 51, 211)}
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"k": k, "t": np.arange(len(x)) / 100.0, "v": x}) for k, x in channels.items()]))
    got = resample.fourier_resample(df, ["k"], "t", fs, tile=tile, target_rows=100).toPandas().sort_values(["k", "sample_idx"])
    for key, x in channels.items():
        part = got[got["k"] == key]
        m = max(2, int(np.floor((len(x) - 1) / 100 * fs + 0.5))) if len(x) > 1 else 1  # halves go up
        assert list(part["sample_idx"]) == list(range(m))
        np.testing.assert_allclose(part["v"], by_spectrum(x, m), atol=1e-10)
        np.testing.assert_allclose(part["t"], np.linspace(0, (len(x) - 1) / 100, m), atol=1e-9)


@pytest.mark.parametrize("n_in,n_out,period", [(1, 1, 1), (3, 200, 7), (97, 5, 11), (64, 64, 64)])
def test_fourier_sums_of_any_period(spark, n_in, n_out, period):
    rng = np.random.default_rng(n_out)
    x = rng.normal(size=n_in) + 1j * rng.normal(size=n_in)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "idx": np.arange(n_in), "re": x.real, "im": x.imag, "period": period, "n_in": n_in, "n_out": n_out}))
    got = fourier.fourier_sums(df, ["k"], 1, tile=16).toPandas().sort_values("idx")
    want = np.exp(2j * np.pi * np.outer(np.arange(n_out), np.arange(n_in)) / period) @ x
    np.testing.assert_allclose(got["re"] + 1j * got["im"], want, atol=1e-9)


def test_fourier_of_nothing(spark):
    assert resample.fourier_resample(as_frame(spark, np.zeros(3)).where("false"), ["k"], "t", 10.0).count() == 0


def test_fourier_keeps_a_tone(spark):
    i = np.arange(64)
    df = as_frame(spark, np.cos(2 * np.pi * 3 * i / 64))
    got = resample.fourier_resample(df, ["k"], "t", 32 / 0.63).toPandas().sort_values("sample_idx")["v"]
    np.testing.assert_allclose(got, np.cos(2 * np.pi * 3 * np.arange(32) / 32), atol=1e-12)


@pytest.mark.parametrize("up,down", [(3, 5), (5, 3), (1, 2)])
def test_polyphase_blocks_and_level(spark, up, down):
    rng = np.random.default_rng(6)
    x = 5 + rng.normal(size=900) * 0.1
    one = resample.polyphase_resample(as_frame(spark, x), ["k"], "t", up, down).toPandas().sort_values("sample_idx")["v"].to_numpy()
    many = resample.polyphase_resample(as_frame(spark, x), ["k"], "t", up, down, block=97).toPandas().sort_values("sample_idx")["v"].to_numpy()
    assert len(one) == -(-900 * up // down)
    np.testing.assert_allclose(one, many, atol=1e-12)
    assert abs(one[60:-60].mean() - 5) < 0.02


def test_silhouette_matches_definition(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(0, 1, (30, 3)), rng.normal(4, 1, (20, 3))])
    lab = np.repeat([0, 1], [30, 20])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    a = np.array([d[i, (lab == lab[i]) & (np.arange(50) != i)].mean() for i in range(50)])
    b = np.array([d[i, lab != lab[i]].mean() for i in range(50)])
    df = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, lab))], "idx long, vector array<double>, meta_cluster int")
    got = clusters.silhouette(df, "idx", block=7).collect()[0][0]
    assert abs(got - ((b - a) / np.maximum(a, b)).mean()) < 1e-9


def test_rounding_is_that_of_the_sql(spark):
    import duckdb

    from strideframe.plans.registry import rounded

    values = [38772.60425, 1.0000005, -2.5, 0.0, None, 1e15 + 0.5] + [i / 10**5 for i in range(-3_000_005, 3_000_005, 490)] + [0.1 * i + 5e-7 for i in range(2000)]
    df = spark.createDataFrame([(i, x, x) for i, x in enumerate(values)], "i long, a double, b double")
    got = rounded(df, 6, b=4).orderBy("i").toPandas()
    con = duckdb.connect()
    con.execute("create table x (i bigint, a double)")
    con.executemany("insert into x values (?, ?)", list(enumerate(values)))
    want = con.execute("select round(a, 6) as a, round(a, 4) as b from x order by i").df()
    for c in "ab":
        np.testing.assert_array_equal(got[c].to_numpy(float), want[c].to_numpy(float))


def test_fourier_places_end_with_the_signal(spark):
    t0, t1 = 38772.60425, 2567544.278327
    df = spark.createDataFrame([("a", t0 + (t1 - t0) * i / 7 if i < 7 else t1, float(i)) for i in range(8)], "k string, t double, v double")
    got = resample.fourier_resample(df, ["k"], "t", 10 / 2592000.0).orderBy("sample_idx").toPandas()["t"].tolist()
    assert got == [t0 + j * (t1 - t0) / (len(got) - 1) for j in range(len(got))] and len(got) > 5


def test_silhouettes_of_several_columns_merge_copies(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(40, 3))[rng.integers(0, 40, 90)]
    one, two = rng.integers(0, 3, 90), rng.integers(0, 2, 90)
    two[0] = 5  # a cluster of one point: no score
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    means = np.array([[d[i, (one == k) & (np.arange(90) != i)].mean() for k in range(3)] for i in range(90)])
    a = means[np.arange(90), one]
    b = np.where(one[:, None] == np.arange(3), np.inf, means).min(1)
    rows = [(i, [float(v) for v in r], int(p), int(q)) for i, (r, p, q) in enumerate(zip(x, one, two))]
    df = spark.createDataFrame(rows, "idx long, vector array<double>, one int, two int")
    for block in (7, 1000):
        got = clusters.silhouettes(df, "idx", "vector", ["one", "two"], block).collect()
        assert len(got) == 1 and abs(got[0]["one"] - ((b - a) / np.maximum(a, b)).mean()) < 1e-9 and got[0]["two"] is None
    assert clusters.silhouettes(df.limit(0), "idx", "vector", ["one"]).collect()[0]["one"] is None


def test_kmeans_inertia_falls_with_k(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(120, 4)))], "idx long, vector array<double>")
    curve = clusters.sweep_k(df, 2, 4, restarts=4).orderBy("k").toPandas()
    assert curve["inertia"].is_monotonic_decreasing and curve["silhouette"].between(-1, 1).all()


def test_every_pair_of_blocks_meets_once_with_few_copies(spark):
    for n in (1, 2, 9, 20):
        left, right = clusters.block_grid(spark.range(n).withColumnRenamed("id", "_b"))
        side = int(np.ceil(np.sqrt(n)))
        assert {r["count"] for t in (left, right) for r in t.groupBy("_b").count().collect()} == {side}
        met = left.withColumnRenamed("_b", "a").join(right.withColumnRenamed("_b", "b"), ["_row", "_column"]).select("a", "b").collect()
        assert sorted(map(tuple, met)) == [(a, b) for a in range(n) for b in range(n)]


def spied(monkeypatch):
    """Keys of all rows that go through tiles, as `fourier_resample` hands them over."""
    seen, real = set(), resample.fourier_sums

    def sums(df, keys, *rest):
        seen.update(r[0] for r in df.select(*keys).distinct().collect())
        return real(df, keys, *rest)

    monkeypatch.setattr(resample, "fourier_sums", sums)
    return seen


def test_short_channels_are_resampled_where_they_are_sorted(spark, monkeypatch):
    rng = np.random.default_rng(14)
    short = {f"s{i}": rng.normal(size=n) for i, n in enumerate(rng.integers(1, 43, 300))}
    df = pd.concat([pd.DataFrame({"k": k, "t": np.arange(len(x)) / 100.0, "v": x}) for k, x in (short | {"long": rng.normal(size=70)}).items()])
    seen = spied(monkeypatch)
    got = resample.fourier_resample(spark.createDataFrame(df.sample(frac=1, random_state=1)), ["k"], "t", 30.0, tile=64).toPandas()
    assert seen == {"long"} and set(got["k"]) == {*short, "long"}
    for key, part in got.sort_values("sample_idx").groupby("k"):
        x = df.loc[df["k"] == key, "v"].to_numpy()
        np.testing.assert_allclose(part["v"], by_spectrum(x, len(part)), atol=1e-10)


@pytest.mark.parametrize("rows", [3, 10_000])
def test_fourier_of_odd_channels(cached, monkeypatch, rows):
    """Null keys, times and samples, channels that go on over batches, results and samples of several pieces, channels a tile just holds or doesn't."""
    monkeypatch.setattr(resample, "PIECE_ROWS", 8)
    before = cached.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    cached.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        rng = np.random.default_rng(15)
        channels = {n: rng.normal(size=n) for n in (1, 2, 3, 31, 32, 42, 43, 44, 63, 64, 65, 130)}
        data = [(n, f"c{n}", i / 100.0, float(v)) for n, x in channels.items() for i, v in enumerate(x)]
        odd = [(None, "c", 0.0, 1.0), (None, "c", 1.0, 1.0), (9, None, 0.0, 1.0), (7, "untimed", None, 4.0), (7, "untimed", None, 4.0), (8, "half", None, 3.0), (8, "half", 0.0, None), (8, "half", 0.5, 5.0)]
        df = cached.createDataFrame(data + odd, "k int, name string, t double, v double")
        seen = spied(monkeypatch)
        got = resample.fourier_resample(df, ["k", "name"], "t", 50.0, tile=64).toPandas().sort_values(["k", "sample_idx"])
    finally:
        cached.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert seen == {63, 64, 65, 130}  # 44 samples and 11 bins lie in a tile of 64, 63 samples and 15 bins don't
    assert set(got["k"]) == {*channels, 7, 8} and set(got["name"]) == {*(f"c{n}" for n in channels), "untimed", "half"}
    for n, x in channels.items():
        part = got[got["k"] == n]
        m = max(2, int(np.floor((n - 1) / 100 * 50.0 + 0.5))) if n > 1 else 1
        assert list(part["sample_idx"]) == list(range(m))
        np.testing.assert_allclose(part["v"], by_spectrum(x, m), atol=1e-10)
        np.testing.assert_allclose(part["t"], np.linspace(0, (n - 1) / 100, m), atol=1e-9)
    untimed, half = got[got["k"] == 7], got[got["k"] == 8]
    assert untimed["t"].isna().all() and np.allclose(untimed["v"], 4.0) and len(untimed) == 2
    np.testing.assert_allclose(half["v"], by_spectrum(np.array([3.0, 0.0, 5.0]), 25), atol=1e-10)
    np.testing.assert_allclose(half["t"], np.linspace(0, 0.5, 25), atol=1e-12)


def test_short_channels_of_long_results(spark, monkeypatch):
    seen = spied(monkeypatch)
    x = np.random.default_rng(16).normal(size=50)
    got = resample.fourier_resample(as_frame(spark, x), ["k"], "t", 41_000.0).toPandas().sort_values("sample_idx")
    assert not seen and list(got["sample_idx"]) == list(range(20_090))
    np.testing.assert_allclose(got["v"], by_spectrum(x, 20_090), atol=1e-10)
