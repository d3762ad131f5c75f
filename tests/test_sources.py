"""Vendor files, label files, sinks and the stream, on small files written here."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.operators import checks, reshape
from strideframe.plans import workflows
from strideframe.sources import read_recordings, read_segments, sniff_format, tables
from strideframe.sources import recordings as R
from strideframe.sources import sinks
from strideframe.streaming import epoch_statistics


@pytest.fixture()
def labelled(tmp_path):
    names = ["Brachioradialis: EMG 1", "Brachioradialis: Acc 1.X", "Brachioradialis: Acc 1.Y", "Brachioradialis: Acc 1.Z", "Infraspinatus: EMG 2"]
    lines = [f"Label: {n} Sampling frequency: {1000.0 if 'EMG' in n else 100.0} Number of points: 6 X start: 0.0 Unit: Volts Domain Unit: s" for n in names]
    lines += ["Device: demo", "Operator: nobody"]
    for g in range(5):
        lines += [f"System Gain: {g + 1}", "A/D card Gain: 1", "Bits: 16", "Bias: 0", "Min: -1", "Max: 1"]
    lines.append(",".join(f"X [s],{n} [Volts]" for n in names))
    for i in range(6):
        lines.append(",".join(f"{i / 1000:.3e},{i * (c + 1):.3e}" if not (c == 4 and i == 2) else f"{i / 1000:.3e},nan" for c in range(5)))
    (tmp_path / "P_001").mkdir()
    path = tmp_path / "P_001" / "P_001_Task_DS_T0.csv"
    path.write_text("\n".join(lines) + "\n")
    (tmp_path / "P_001" / "P_001_Calibrazione_T0.csv").write_text("x\n")
    return tmp_path, path


def test_labelled_file(spark, labelled):
    _, path = labelled
    rec = read_recordings(spark, str(path))
    s = rec.samples.toPandas()
    assert set(s["patient_id"]) == {"P_001"} and set(s["task_name"]) == {"Task_T0_DS"}
    counts = s.groupby("channel").size().to_dict()
    assert counts == {"Brachioradialis: EMG 1": 6, "Brachioradialis: Acc 1.X": 6, "Brachioradialis: Acc 1.Y": 6, "Brachioradialis: Acc 1.Z": 6, "Infraspinatus: EMG 2": 5}
    last = s[(s["channel"] == "Infraspinatus: EMG 2")].sort_values("t").iloc[-1]
    assert last["v"] == 25.0 and abs(last["t"] - 0.005) < 1e-12
    ch = rec.channels.toPandas().set_index("channel")
    assert ch.loc["Infraspinatus: EMG 2", "fs"] == 1000.0 and len(ch) == 5
    assert rec.metadata.collect()[0]["metadata"] == {"Device": "demo", "Operator": "nobody"}
    blocks = R.channel_settings(R.read_lines(spark, str(path))).orderBy("block").collect()
    assert [b["settings"]["System Gain"] for b in blocks] == [1, 2, 3, 4, 5]


def test_import_writes_each_modality_at_its_rate(spark, labelled):
    root, path = labelled
    out = workflows.import_recordings(read_recordings(spark, str(path)), str(root / "imported"), {"emg": 2000.0, "acc": None})
    counts = {r["channel"]: r["count"] for r in out["samples"].groupBy("channel").count().collect()}
    assert counts == {"Brachioradialis: EMG 1": 10, "Brachioradialis: Acc 1.X": 6, "Brachioradialis: Acc 1.Y": 6, "Brachioradialis: Acc 1.Z": 6, "Infraspinatus: EMG 2": 10}
    assert {r["modality"] for r in out["samples"].select("modality").distinct().collect()} == {"emg", "acc"}
    quality = out["quality"].collect()[0]
    facts = {c["name"]: c for c in json.loads(quality["channels"])}
    assert quality["n_channels"] == 5 and facts["Infraspinatus: EMG 2"]["n_samples_before_resample"] == 5 and out["channels"].count() == 5


def test_lines_are_numbered_across_splits(spark, labelled):
    _, path = labelled
    want = path.read_text().splitlines()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        got = R.read_lines(spark, str(path)).orderBy("line_no").toPandas()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert list(got["line"]) == want and list(got["line_no"]) == list(range(1, len(want) + 1))


@pytest.fixture()
def semicolon(tmp_path):
    def cells(t, v):
        return f"{t:.3f};{v:.2f}".replace(".", ",")

    rows = ["Application:; Trigno Discover;", "Date:; today;", "Note:; none;", "Deltoide anteriore (85281);" + ";" * 12 + ";Unknown (1);" + ";" * 12 + ";Anterior Deltoid (2);",
            "mode", ";".join(["h"] * 42), ";".join((["x"] + ["1259,2593 Hz"] + ["x", "148,1481 Hz"] * 6) * 3), "res"]
    for i in range(10):
        rows.append(";".join([cells(i / 10, i)] + [cells(i / 5, 10 + i)] * 6 + [cells(i / 10, 50)] * 7 + [cells(i / 10, 99)] * 7))
    rows.append("0,95;7,5")
    path = tmp_path / "P_002_Task_T1_SN.csv"
    path.write_text("\n".join(rows) + "\n")
    return path


def test_semicolon_file(spark, semicolon):
    path = semicolon
    lines = R.read_lines(spark, str(path))
    assert sniff_format(lines).collect()[0]["format"] == "semicolon"
    rec = read_recordings(spark, str(path))
    s = rec.samples.toPandas()
    assert set(s["channel"]) == {"Anterior Deltoid: EMG 1", "Anterior Deltoid: Acc 1.X", "Anterior Deltoid: Acc 1.Y", "Anterior Deltoid: Acc 1.Z"}
    emg = s[s["channel"].str.contains("EMG")]
    assert emg["t"].max() == 0.95 and len(emg) == 11 and 99.0 not in set(emg["v"])
    assert s[s["channel"].str.contains("Acc 1.X")]["t"].max() <= 0.95
    ch = rec.channels.toPandas().set_index("channel")
    assert ch.loc["Anterior Deltoid: EMG 1", "fs"] == 1259.2593 and ch.loc["Anterior Deltoid: Acc 1.Y", "fs"] == 148.1481


def test_discovery_skips_calibration(spark, labelled):
    root, _ = labelled
    assert R.discover_recordings(spark, str(root)).count() == 1
    assert R.discover_recordings(spark, str(root), tasks_only=False).count() == 2


def test_segments_and_coverage(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"patient": "P_1", "task": "Task_T0_DS", "channels": ["x"], "pairs": [{"start_s": 0.5, "end_s": 1.0}, {"start_s": 2, "end_s": 3}]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"patient": "P_2", "task": "Task_T0_DS", "channels": [], "pairs": []}))
    seg = read_segments(spark, str(tmp_path))
    assert [(r["cycle_index"], r["start_s"], r["end_s"]) for r in seg.orderBy("cycle_index").collect()] == [(0, 0.5, 1.0), (1, 2.0, 3.0)]
    rec = spark.createDataFrame([("P_1", "Task_T0_DS"), ("P_2", "Task_T0_DS")], "patient_id string, task_name string")
    assert [r["patient_id"] for r in tables.with_segments(rec, seg).collect()] == ["P_1"]
    assert [r["patient_id"] for r in tables.with_segments(rec, seg, present=False).collect()] == ["P_2"]


def test_tables_and_sinks(spark, tmp_path):
    empty = tables.read_or_empty(spark, str(tmp_path / "missing.csv"), "a int, b string")
    assert empty.count() == 0 and empty.columns == ["a", "b"]
    (tmp_path / "demo.csv").write_text("patient_id,Lato più colpito\nP_1,dx\n")
    demo = tables.read_demographics(spark, str(tmp_path / "demo.csv"))
    from strideframe.functions.text import AFFECTED_ALIASES, find_column

    side = find_column(demo.columns, AFFECTED_ALIASES)
    assert demo.columns[0] == "id" and side == "Lato più colpito"
    groups = {(r["condition"], r["affected_group"]) for r in reshape.affected_groups(demo, side).collect()}
    assert groups == {("DS", "more_affected"), ("SN", "less_affected")}
    (tmp_path / "f.csv").write_text("ID,timing,a.b\nP_1_F,T0,1.5\nP_2_M,T1,nan\n")
    feats = tables.read_features(spark, str(tmp_path / "f.csv")).orderBy("ID").collect()
    assert feats[0]["a.b"] == 1.5 and feats[1]["a.b"] is None
    s = spark.createDataFrame([("P_1", "Task_T0_DS", "A: EMG 1", i, i / 10, float(i)) for i in range(5)] + [("P_1", "Task_T0_DS", "A: Acc 1.X", 0, 0.0, 1.0)],
                              "patient_id string, task_name string, channel string, sample_idx long, t double, v double")
    sinks.write_samples(s, str(tmp_path / "samples"))
    back = spark.read.parquet(str(tmp_path / "samples"))
    assert back.where("modality = 'emg'").count() == 5 and back.count() == 6
    sinks.write_stage(s, str(tmp_path), "stage", ["patient_id"])
    assert tables.read_stage(spark, str(tmp_path), "stage").count() == 6
    assert tables.read_stage(spark, str(tmp_path / "no"), "stage", [str(tmp_path)]).count() == 6
    sinks.write_named({"x": s}, str(tmp_path / "report"), csv=["x"])
    assert spark.read.option("header", "true").csv(str(tmp_path / "report/csv/x")).count() == 6
    sinks.write_profiles(s, ["patient_id", "channel"], str(tmp_path / "profiles"), "sample_idx")
    assert tables.read_profiles(spark, str(tmp_path / "profiles")).where("size(profile) = 5").count() == 1
    sinks.write_config(spark, {"windows": {"length": 0.2}}, str(tmp_path / "cfg"))
    assert json.loads(spark.read.text(str(tmp_path / "cfg")).collect()[0][0])["windows"]["length"] == 0.2
    meta = sinks.quality_metadata(s, ["patient_id"], before=s).collect()[0]
    assert meta["n_channels"] == 2 and json.loads(meta["channels"])[1]["n_samples_before_resample"] == 5


def test_checks_fail_loudly(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.5)], "k string, o int, v double")
    with pytest.raises(Exception, match="disagree"):
        checks.unique_rows(df, ["k"], ["v"], ["o"]).collect()
    assert checks.unique_rows(df, ["k"], ["v"], ["o"], strict=False).collect()[0]["agrees"] is False
    rec = spark.createDataFrame([("tX", "c")], "task string, who string")
    none = spark.createDataFrame([], "who string, task string, k int, o int")
    with pytest.raises(Exception, match="recommendation"):
        reshape.lookup(rec, none, "who", "task", "k", "o", 3, required=True).collect()


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [("k%d" % (i % 3), 1_700_000_000 + float(s), float(v)) for i, (s, v) in enumerate(zip(np.sort(rng.uniform(0, 120, 400)), rng.normal(size=400)))]
    df = spark.createDataFrame(rows, "k string, s double, v double").select("k", F.timestamp_seconds("s").alias("ts"), "v")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = epoch_statistics(stream, ["k"], late="10 minutes").writeStream.outputMode("complete").format("memory").queryName("epochs").option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("epochs").select("k", "epoch_start", "n").collect()}
    want = {tuple(r) for r in epoch_statistics(df, ["k"]).select("k", "epoch_start", "n").collect()}
    assert got == want and len(got) > 100


def test_eeg_side_files(spark, tmp_path):
    from strideframe.operators.reshape import pair_files
    from strideframe.sources import eeg_channel_type, file_keys, read_sensor_layout

    def layout(name, n):
        rows = "".join(f"<sensor><name/><number>{i}</number><x>{i}.0</x><y>1.0</y><z>2.0</z></sensor>" for i in range(1, n + 1))
        (tmp_path / name).write_text(f'<?xml version="1.0"?><sensorLayout xmlns="http://example.org/l"><sensors>{rows}</sensors></sensorLayout>')
        return str(tmp_path / name)

    got = read_sensor_layout(spark, layout("full.xml", 257)).orderBy("number").collect()
    assert len(got) == 257 and got[0]["channel"] == "EEG 1" and abs(got[9]["x"] - 0.1) < 1e-12 and got[-1]["channel"] == "EEG VREF"
    with pytest.raises(Exception, match="lacks"):
        read_sensor_layout(spark, layout("part.xml", 200)).collect()
    kinds = spark.createDataFrame([("EEG 5",), ("EEG VREF",), ("EDF Annotations",), ("ECG",)], "c string").select(eeg_channel_type(F.col("c"))).collect()
    assert [r[0] for r in kinds] == ["eeg", "misc", "stim", "misc"]
    names = ["AB_1_T0_20200101_101010.edf", "AB_1_F_T0_20200101_101010.mff", "AB_2_T0_20200101_101010_fil.edf", "AB_2_T0_20200101_101110.mff", "AB_2_T1_20200101_101010.edf", "notes.txt"]
    keys = file_keys(spark.createDataFrame([(f"/x/{n}",) for n in names], "path string"))
    pairs = pair_files(keys.where("kind = 'edf'").drop("kind"), keys.where("kind = 'mff'").drop("kind"), by=["subject"]).orderBy("subject").collect()
    assert [(r["subject"], r["visit"]) for r in pairs] == [("AB_1", "T0"), ("AB_2", "T0")] and pairs[1]["path_b"].endswith("101110.mff")


def test_data_source_reads_what_the_text_source_reads(spark, labelled, semicolon):
    from strideframe.sources import on_common_span, scan_recordings

    cols = ["patient_id", "task_name", "channel", "t", "v"]
    rows = lambda d: sorted(map(tuple, d.select(*cols).collect()))
    for path in (labelled[1], semicolon):
        want = rows(read_recordings(spark, str(path)).samples)
        for size in (16 << 20, 60):
            got = scan_recordings(spark, str(path), part_bytes=size)
            assert rows(on_common_span(got)) == want and len(want) > 0
        assert got.rdd.getNumPartitions() > 5
        one = want[0][2]
        some = scan_recordings(spark, str(path), part_bytes=200).where(F.col("channel") == one)
        assert {r["channel"] for r in some.collect()} == {one} and one not in some._jdf.queryExecution().optimizedPlan().toString()
        assert scan_recordings(spark, str(path)).where("channel = 'none'").count() == 0
