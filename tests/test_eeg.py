"""EEG steps against direct NumPy definitions, planted faults, and EDF files written here."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strideframe.operators import reference, rejection, splines, unmixing
from strideframe.sources.edf import ANNOTATIONS, read_edf

SF = "/root/testdata/sf0.001"
NAMES = ["a", "b", "c", "d"]


def mixture(seed, n, k=3):
    """n samples of four channels mixed from k uneven sources."""
    r = np.random.default_rng(seed)
    s = np.stack([r.uniform(-1, 1, n), np.sign(r.normal(size=n)) * r.exponential(1, n), np.sin(np.arange(n) / 7.0)][:k])
    return r.normal(size=(4, k)) @ s + np.array([[100.0], [0], [-5], [3]]), s


def wide_frame(spark, parts):
    rows = [(rec, i, *map(float, x)) for rec, data in parts.items() for i, x in enumerate(data.T)]
    return spark.createDataFrame(rows, "rec string, sample long, a double, b double, c double, d double").repartition(3)


def brute_unmix(x, steps, tol):
    """The same fixed point over one matrix."""
    x = x - x.mean(axis=1, keepdims=True)
    value, vector = np.linalg.eigh(x @ x.T / x.shape[1])
    keep = value > 1e-10 * value.max()
    white = (vector[:, keep] / np.sqrt(value[keep])).T[::-1]
    white = white * np.where((vector[:, keep].T[::-1])[np.arange(len(white)), np.abs(vector[:, keep].T[::-1]).argmax(axis=1)] < 0, -1, 1)[:, None]
    z, w = white @ x, unmixing._start(len(white))
    for _ in range(steps):
        g = np.tanh(w @ z)
        u, _, v = np.linalg.svd(g @ z.T / z.shape[1] - (1 - g * g).mean(axis=1)[:, None] * w)
        turn, w = np.abs(1 - np.abs(((u @ v) * w).sum(axis=1))).max(), u @ v
        if turn <= tol:
            break
    return w @ white


def test_unmix_equals_one_matrix_and_finds_sources(spark):
    parts = {"x": mixture(1, 900)[0], "y": mixture(2, 400)[0], "flat": np.ones((4, 5))}
    wide = wide_frame(spark, parts)
    fits = {r["rec"]: r for r in unmixing.unmix(wide, ["rec"], NAMES, max_iter=25, tol=1e-9, rows=64).collect()}
    assert list(fits["flat"]["unmixing"]) == [] and fits["flat"]["n"] == 5
    for rec, seed, n in (("x", 1, 900), ("y", 2, 400)):
        got = np.array(fits[rec]["unmixing"]).reshape(3, 4)
        want = brute_unmix(parts[rec], 25, 1e-9)
        match = np.abs(got @ want.T) / np.linalg.norm(got, axis=1)[:, None] / np.linalg.norm(want, axis=1)
        assert np.allclose(np.sort(match.max(axis=1)), 1, atol=1e-6)
        found = got @ (parts[rec] - parts[rec].mean(axis=1, keepdims=True))
        assert (np.abs(np.corrcoef(found, mixture(seed, n)[1])[:3, 3:]).max(axis=0) > 0.95).all()
        mixing = np.array(fits[rec]["mixing"]).reshape(4, 3)
        assert np.allclose(mixing @ found, parts[rec] - parts[rec].mean(axis=1, keepdims=True), atol=1e-6)


def test_unmix_share_and_dropped_components(spark):
    data = mixture(3, 300)[0]
    wide = wide_frame(spark, {"x": data})
    fits = unmixing.unmix(wide, ["rec"], NAMES, n_components=2, max_iter=5)
    assert len(fits.first()["unmixing"]) == 8 and len(unmixing.unmix(wide, ["rec"], NAMES, share=1e-6, max_iter=2).first()["unmixing"]) == 4
    gone = spark.createDataFrame([("x", 0)], "rec string, component int")
    clean = unmixing.without_components(wide, fits, gone, ["rec"], NAMES).orderBy("sample").toPandas()[NAMES].to_numpy().T
    row = fits.first()
    u, m = np.array(row["unmixing"]).reshape(2, 4), np.array(row["mixing"]).reshape(4, 2)
    centred = data - data.mean(axis=1, keepdims=True)
    assert np.allclose(clean, data - m[:, :1] @ (u[:1] @ centred), atol=1e-8)
    assert unmixing.unmix(wide.limit(0), ["rec"], NAMES).count() == 0


def test_splines_rebuild_a_smooth_field(spark):
    r = np.random.default_rng(5)
    p = r.normal(size=(40, 3))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    field = 2 + p[:, 0] - 0.5 * p[:, 1] * p[:, 2]
    sensors = spark.createDataFrame([("s", f"E{i}", *map(float, 9 * x), i in (3, 17)) for i, x in enumerate(p)] + [("s", "E99", None, None, None, False)],
                                    "rec string, channel string, x double, y double, z double, bad boolean")
    samples = spark.createDataFrame([("s", k, f"E{i}", None if (k, i) == (2, 5) else float(v * (k + 1))) for k in range(3) for i, v in enumerate(field)],
                                    "rec string, sample int, channel string, v double")
    got = {(x["channel"], x["sample"]): x["v"] for x in splines.repaired(samples, sensors, ["rec"], ["sample"]).where("rebuilt").collect()}
    assert len(got) == 6 and got["E3", 2] is None
    assert all(abs(got[f"E{i}", k] - field[i] * (k + 1)) < 0.05 * (k + 1) for i in (3, 17) for k in range(2))
    assert np.allclose(splines.weights_of(p[:30], p[30:]).sum(axis=1), 1)
    assert splines.repaired(samples, sensors.withColumn("bad", F.lit(True)), ["rec"], ["sample"]).count() == 0


def planted(seed, fault):
    """Six channels of a common course with own noise; `fault` spoils the last."""
    r = np.random.default_rng(seed)
    n = 600
    common = np.cumsum(r.normal(size=n)) * 0.3
    x = np.stack([common * g + r.normal(size=n) * 0.4 for g in (0.2, 0.5, 0.8, 1.2, 1.5, 1.8)])
    if fault == "deviation":
        x[5] = x[5] * 60
    if fault == "flat":
        x[5] = 0.0
    if fault == "roughness":
        x[5] = r.normal(size=n) * 2 + common
    return x


def test_planted_bad_channels(spark):
    names = [f"c{i}" for i in range(6)]
    faults = ["deviation", "roughness", "flat"]
    rows = [(f, i, *map(float, v)) for k, f in enumerate(faults) for i, v in enumerate(planted(k, f).T)]
    wide = spark.createDataFrame(rows, "rec string, i long, " + ", ".join(f"{n} double" for n in names)).repartition(3)
    marks = reference.bad_channels(wide, ["rec"], names, "i", least_corr=0.0)
    found = {(r["rec"], r["channel"]): r["why"] for r in marks.collect() if r["bad"]}
    assert all(found.get((f, "c5")) == f for f in faults) and marks.count() == 18
    clean = reference.referenced(wide, marks, ["rec"], names).where("rec = 'deviation'").orderBy("i").toPandas()
    good = [int(c[1]) for c in names if ("deviation", c) not in found]
    x = planted(0, "deviation")
    assert np.allclose(clean[names].to_numpy().T, x - x[good].mean(axis=0), atol=1e-9)
    assert reference.bad_channels(wide.limit(0), ["rec"], names, "i").count() == 0


def test_a_channel_without_partner_is_bad(spark):
    r = np.random.default_rng(9)
    t = np.arange(500) / 20
    x = np.stack([np.sin(t), 1.1 * np.sin(t) + 0.01 * np.cos(3 * t), -np.sin(t), -0.9 * np.sin(t), 0.9 * np.sign(np.sin(17.3 * t))])
    names = [f"c{i}" for i in range(5)]
    wide = spark.createDataFrame([("r", i, *map(float, v + 0.001 * r.normal(size=5))) for i, v in enumerate(x.T)], "rec string, i long, " + ", ".join(f"{n} double" for n in names))
    found = {m["channel"]: m["why"] for m in reference.bad_channels(wide, ["rec"], names, "i", limit=1e9, max_iter=1).collect() if m["bad"]}
    assert found == {"c4": "correlation"}


def test_thresholds_reject_planted_epochs(spark):
    r = np.random.default_rng(4)
    course = np.sin(np.arange(20) / 3)
    rows = []
    for e in range(60):
        v = course + 0.1 * r.normal(size=20)
        if e % 10 == 7:
            v[5] += 40
        rows += [("Cz", e, i, float(x)) for i, x in enumerate(v)]
    rows += [("Pz", 0, i, float(i)) for i in range(20)] + [("Pz", 1, 3, None)]
    samples = spark.createDataFrame(rows, "channel string, epoch long, pos int, v double").repartition(3)
    got = {x["channel"]: x for x in rejection.rejection_thresholds(samples, ["channel"]).collect()}
    assert got["Cz"]["n_rejected"] == 6 and got["Cz"]["n_epochs"] == 60 and 2 < got["Cz"]["threshold"] < 4
    assert got["Pz"]["threshold"] is None and got["Pz"]["n_rejected"] == 0
    marks = rejection.epoch_marks(samples.withColumn("rec", F.lit(1)), rejection.rejection_thresholds(samples.withColumn("rec", F.lit(1)), ["rec", "channel"]), ["rec"], consensus=0.6)
    assert sorted(x["epoch"] for x in marks.where("rejected").collect()) == [7, 17, 27, 37, 47, 57]


def edf_bytes(signals, seconds, records, notes=(), kind="", stated=None):
    """signals: (label, unit, low, high, samples per record, values as int16); notes: bytes of each record's track."""
    track = max([len(x) for x in notes], default=0)
    track += track % 2
    all_signals = [*signals, *([(ANNOTATIONS, "", -1, 1, track // 2, None)] if track else [])]
    pad = lambda x, n: str(x).ljust(n).encode("latin-1")[:n]
    head = pad("0", 8) + pad("patient", 80) + pad("rec", 80) + pad("01.01.24", 8) + pad("00.00.00", 8) + pad(256 * (len(all_signals) + 1), 8) + pad(kind, 44)
    head += pad(records if stated is None else stated, 8) + pad(seconds, 8) + pad(len(all_signals), 4)
    columns = [(16, [s[0] for s in all_signals]), (80, ["AgCl"] * len(all_signals)), (8, [s[1] for s in all_signals]), (8, [s[2] for s in all_signals]), (8, [s[3] for s in all_signals]),
               (8, [-32768] * len(all_signals)), (8, [32767] * len(all_signals)), (80, ["HP:0.1"] * len(all_signals)), (8, [s[4] for s in all_signals]), (32, [""] * len(all_signals))]
    head += b"".join(pad(x, n) for n, xs in columns for x in xs)
    body = b""
    for k in range(records):
        for label, _, _, _, n, values in all_signals:
            body += notes[k].ljust(track, b"\x00") if values is None else values[k * n : (k + 1) * n].astype("<i2").tobytes()
    return head + body


@pytest.fixture(scope="module")
def edf(tmp_path_factory):
    """A recording from `events`: two signals of different rates, and an interrupted one with annotations, cut short."""
    root = tmp_path_factory.mktemp("edf")
    v = pd.read_parquet(f"{SF}/events.parquet").sort_values("event_id")["value"].to_numpy()
    x = np.clip(v * 100, -32768, 32767).astype(np.int16)[:960]
    (root / "sub").mkdir()
    (root / "sub" / "one.edf").write_bytes(edf_bytes([("EEG 1", "uV", -100, 100, 8, x[:640]), ("EEG 2", "uV", -50, 50, 4, x[640:])], 0.5, 80, stated=-1))
    notes = [f"+{k * 3}\x14\x14\x00+{k * 3 + 0.25}\x150.5\x14blink\x14\x00".encode() for k in range(5)]
    (root / "two.EDF").write_bytes(edf_bytes([("EEG 1", "mV", 0, 1, 4, x[:20])], 1, 5, notes, "EDF+D")[:-3])
    (root / "readme.txt").write_text("no recording")
    return root, x


def test_edf_is_read_in_ranges(spark, edf):
    root, x = edf
    got = read_edf(spark, str(root), part_bytes=240)
    assert got.rdd.getNumPartitions() > 8
    one = got.where("path like '%one.edf'").toPandas().sort_values(["channel", "sample_idx"])
    a, b = one[one.channel == "EEG 1"], one[one.channel == "EEG 2"]
    scale = lambda v, low, high: (v + 32768.0) * (high - low) / 65535 + low
    assert np.allclose(a.v, scale(x[:640], -100, 100)) and np.allclose(b.v, scale(x[640:], -50, 50))
    assert np.allclose(a.t, np.arange(640) / 16) and np.allclose(b.t, np.arange(320) / 8) and list(b.sample_idx) == list(range(320))
    two = got.where("path like '%two.EDF'").toPandas().sort_values("sample_idx")  # four whole records are left, three seconds apart
    assert len(two) == 16 and np.allclose(two.t, np.repeat(np.arange(4) * 3, 4) + np.tile(np.arange(4) / 4, 4))


def test_edf_filters_channels_and_annotations(spark, edf):
    root, _ = edf
    some = read_edf(spark, str(root)).where("channel = 'EEG 2'")
    assert some.count() == 320 and "EEG 2" not in some._jdf.queryExecution().optimizedPlan().toString()  # the reader has it
    assert read_edf(spark, str(root)).where("channel in ('EEG 2', 'EEG 7') and sample_idx < 10").count() == 10
    assert read_edf(spark, str(root)).where("channel = 'EEG 7'").count() == 0
    facts = {(r["path"].split("/")[-1], r["channel"]): (r["unit"], r["fs"], r["n_points"]) for r in read_edf(spark, str(root), "channels").collect()}
    assert facts == {("one.edf", "EEG 1"): ("uV", 16.0, 640), ("one.edf", "EEG 2"): ("uV", 8.0, 320), ("two.EDF", "EEG 1"): ("mV", 4.0, 16)}
    notes = read_edf(spark, str(root), "annotations").orderBy("onset").collect()
    assert [(r["onset"], r["duration"], r["text"]) for r in notes] == [(k * 3 + 0.25, 0.5, "blink") for k in range(4)]
    assert read_edf(spark, [str(root / "two.EDF")], "channels").count() == 1
    (root / "bad.edf").write_bytes(b"x" * 600)
    with pytest.raises(Exception):
        read_edf(spark, str(root / "bad.edf")).count()
    (root / "bad.edf").write_bytes((root / "two.EDF").read_bytes())


def test_cleaning_chain(spark):
    """Seven channels of an alpha rhythm with mains hum, a dead channel, a blink and one spoilt stretch."""
    from strideframe.plans.eeg_workflow import clean_eeg

    r = np.random.default_rng(12)
    fs, n = 128.0, 128 * 32
    t = np.arange(n) / fs
    p = r.normal(size=(7, 3))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    rhythm, slow = np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 4 * t + 1)
    pure = np.array([(1 + 0.5 * x) * rhythm + y * slow for x, y, _ in p])
    data = pure + 0.05 * r.normal(size=pure.shape) + 3 * np.sin(2 * np.pi * 50 * t)
    data[4] = 0.0
    rows = [("r", f"E{i}", float(a), float(v)) for i in range(7) for a, v in zip(t, data[i])]
    samples = spark.createDataFrame(pd.DataFrame(rows, columns=["path", "channel", "t", "v"]))
    sensors = spark.createDataFrame([("r", f"E{i}", *map(float, x)) for i, x in enumerate(p)], "path string, channel string, x double, y double, z double")
    out = clean_eeg(samples, sensors, [f"E{i}" for i in range(7)], fs, band=(1.0, 60.0), limit=50.0, least_corr=0.0, target_hz=None)
    bad = {x["channel"]: x["why"] for x in out["bad"].where("bad").collect()}
    assert bad == {"E4": "flat"}
    clean = out["clean"].toPandas()
    assert len(clean) == 7 * n and clean["v"].notna().all()
    want = pure - pure[[0, 1, 2, 3, 5, 6]].mean(axis=0)
    for i in (0, 1, 2, 3, 5, 6):
        v = clean[clean.channel == f"E{i}"].sort_values("idx")["v"].to_numpy()
        assert np.corrcoef(v[256:-256], want[i][256:-256])[0, 1] > 0.95
        power = np.abs(np.fft.rfft(v)) ** 2
        assert power[50 * 32] < 1e-3 * power[10 * 32 - 8 : 10 * 32 + 8].max()
    epochs = out["epochs"].toPandas()
    assert len(epochs) == 14 and (epochs.n_channels == 7).all() and out["fits"].first()["n"] == n
