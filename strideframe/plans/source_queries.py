"""Export parsers and task summaries: `events` is written out as the lines of each format and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strideframe.operators import paired as R
from strideframe.plans import workflows as P
from strideframe.plans.registry import EVENT_TYPES, SIGNAL_CTE, SQL, query, rounded, signals
from strideframe.plans.stats_queries import paired_tests_dispatch
from strideframe.sources import recordings

RATE = "1.25e3"
SENSOR_COLUMNS = {"click": 0, "view": 2, "error": 4, "purchase": 6, "signup": 14}
SENSOR_CHANNELS = {"click": "Brachioradialis: EMG 10", "view": "Brachioradialis: Acc 10.X", "error": "Brachioradialis: Acc 10.Y",
                   "purchase": "Brachioradialis: Acc 10.Z", "signup": "Infraspinatus: EMG 8"}


def _file(stem):
    return F.concat(F.lit("/exports/P_"), F.col("entity").cast("string"), F.lit(stem))


def labelled_lines(spark, sf):
    """A comma file per user with a column pair for every event type; cells of other types are `nan`."""
    s = signals(spark, sf).withColumn("path", _file("_Task_DS_T0.csv"))
    counts = s.groupBy("path").agg(*[F.count_if(F.col("channel") == c).alias(c) for c in EVENT_TYPES])
    label = lambda c: F.format_string(f"Label: {c} Sampling frequency: {RATE} Number of points: %d X start: 0.0 Unit: V Domain Unit: s", F.col(c))
    head = [label(c) for c in EVENT_TYPES] + [F.lit("Device: first"), F.lit("Device: last"), F.lit("System Gain: 1"), F.lit(",".join(f"X [s],{c} [V]" for c in EVENT_TYPES))]
    header = counts.select("path", F.posexplode(F.array(*head)).alias("line_no", "line"))
    cells = [F.format_string("%.12e,%s", F.col("t"), F.when(F.col("channel") == c, F.format_string("%.9e", F.col("v"))).otherwise("nan")) for c in EVENT_TYPES]
    number = F.row_number().over(W.partitionBy("path").orderBy("t", "sample")) + (len(head) - 1)
    return header.unionByName(s.select("path", number.alias("line_no"), F.concat_ws(",", *cells).alias("line"))).withColumn("line_no", F.col("line_no") + 1)


@query("parse_labelled", f"""
WITH {SIGNAL_CTE} SELECT 'P_' || entity AS patient_id, 'Task_T0_DS' AS task_name, channel, round(t, 6) AS t, round(v, 6) AS v FROM s""")
def parse_labelled(spark, sf):
    files = recordings.parse_recordings(labelled_lines(spark, sf))
    return rounded(files.samples.select("patient_id", "task_name", "channel", "t", "v"))


@query("parse_channels", f"""
WITH {SIGNAL_CTE}, c AS (SELECT DISTINCT entity FROM s)
SELECT 'P_' || c.entity AS patient_id, k.k AS channel, CAST({RATE} AS DOUBLE) AS fs, count(s.v) AS n_points, 'V' AS unit, 'last' AS device
FROM c CROSS JOIN (SELECT unnest({EVENT_TYPES}) AS k) k LEFT JOIN s ON s.entity = c.entity AND s.channel = k.k GROUP BY 1, 2""")
def parse_channels(spark, sf):
    """Channel facts of every file, and a header line that a later one replaces."""
    files = recordings.parse_recordings(labelled_lines(spark, sf))
    device = files.metadata.select("patient_id", F.col("metadata")["Device"].alias("device"))
    return recordings.channel_table(files).join(device, "patient_id").select("patient_id", "channel", "fs", "n_points", "unit", "device")


def semicolon_lines(spark, sf):
    """A semicolon file per user with two sensors and decimal commas; each row holds one channel's pair."""
    s = signals(spark, sf).withColumn("path", _file("_Task_T1_SN.csv"))
    width = 28
    head = ["Application:; Trigno Discover;", "Date:; today;", "Note:; none;", "Brachioradialis (1);" + ";" * 13 + "Infraspinatus (2);" + ";" * 13, "mode", "h", ";".join(["x"] * width), "res"]
    header = s.select("path").distinct().select("path", F.posexplode(F.array(*[F.lit(h) for h in head])).alias("line_no", "line"))
    at = F.create_map(*[F.lit(x) for pair in SENSOR_COLUMNS.items() for x in pair])[F.col("channel")]
    pair = F.replace(F.format_string("%.6f;%.6f", "t", "v"), F.lit("."), F.lit(","))
    line = F.concat(F.repeat(F.lit(";"), at), pair, F.repeat(F.lit(";"), width - 2 - at))
    number = F.row_number().over(W.partitionBy("path").orderBy("t", "sample")) + (len(head) - 1)
    return header.unionByName(s.select("path", number.alias("line_no"), line.alias("line"))).withColumn("line_no", F.col("line_no") + 1)


@query("parse_semicolon", f"""
WITH {SIGNAL_CTE}, e AS (SELECT entity, channel, min(t) AS a, max(t) AS b, count(*) AS n FROM s GROUP BY 1, 2),
p AS (SELECT entity, max(a) AS lo, min(b) AS hi FROM e WHERE n >= 2 GROUP BY 1)
SELECT 'P_' || s.entity AS patient_id, {" ".join(["CASE s.channel", *[f"WHEN '{k}' THEN '{v}'" for k, v in SENSOR_CHANNELS.items()], "END"])} AS channel, round(t, 6) AS t, round(v, 6) AS v
FROM s LEFT JOIN p ON s.entity = p.entity WHERE lo IS NULL OR lo >= hi OR t BETWEEN lo AND hi""")
def parse_semicolon(spark, sf):
    files = recordings.parse_recordings(semicolon_lines(spark, sf))
    return rounded(files.samples.select("patient_id", "channel", "t", "v"))


@query("stats_row", f"""SELECT * FROM ({SQL["paired_tests_dispatch"]}) WHERE test_type = 'paired_t' AND metric = 'mean_price'""")
def stats_row(spark, sf):
    return R.stats_row(paired_tests_dispatch(spark, sf), test_type="paired_t", metric="mean_price")


_TASKS = f"""{SIGNAL_CTE}, x AS (SELECT 'P_' || (entity % 20) AS patient_id, CASE WHEN t < 1296000 THEN 'T0' ELSE 'T1' END AS ses, CASE WHEN entity % 2 = 0 THEN 'DS' ELSE 'SN' END AS cnd, v FROM s)"""


def _task_tables(spark, sf):
    """Windows, cycle metrics and stability per task, all from the events of the task."""
    task = F.concat(F.lit("Task_"), F.when(F.col("t") < 1296000, "T0").otherwise("T1"), F.when(F.col("entity") % 2 == 0, "_DS").otherwise("_SN"))
    v = F.col("v")
    x = signals(spark, sf).select(F.concat(F.lit("P_"), (F.col("entity") % 20).cast("string")).alias("patient_id"), task.alias("task_name"), "v")
    windows = x.select(*P.TASK, (v < 2).alias("skip_flag"), F.when(v >= 2, v / 100).alias("global_vaf"), F.when(v >= 2, v / 10).alias("reconstruction_error"))
    cycles = x.select(*P.TASK, v.alias("mean_amp"), (v * 2).alias("peak_amp"), (v / 2).alias("auc"), (v / 3).alias("duration"), (v / 4).alias("centroid"))
    stability = x.select(*P.TASK, v.alias("cv_mean_amp"), (v * 3).alias("cv_peak_amp"), (v / 5).alias("cv_auc"), (v / 6).alias("mean_similarity_to_mean_cycle"))
    return windows, cycles, stability


@query("task_summary", f"""
WITH {_TASKS} SELECT patient_id, 'Task_' || ses || '_' || cnd AS task_name, count(*) FILTER (v >= 2) AS n_valid_windows, round(avg(v / 100) FILTER (v >= 2), 6) AS mean_global_vaf,
  round(avg(v / 10) FILTER (v >= 2), 6) AS mean_reconstruction_error, round(avg(v), 6) AS mean_cycle_mean_amp, round(avg(v * 2), 6) AS mean_cycle_peak_amp, round(avg(v / 2), 6) AS mean_cycle_auc,
  round(avg(v / 3), 6) AS mean_cycle_duration, round(avg(v / 4), 6) AS mean_cycle_centroid, round(avg(v), 6) AS mean_cv_mean_amp, round(avg(v * 3), 6) AS mean_cv_peak_amp,
  round(avg(v / 5), 6) AS mean_cv_auc, round(avg(v / 6), 6) AS mean_similarity_to_mean_cycle, ses AS session, cnd AS condition FROM x GROUP BY patient_id, ses, cnd""")
def task_summary(spark, sf):
    return rounded(P.task_summary(*_task_tables(spark, sf)))


@query("cohort_pairs", f"""
WITH {_TASKS}, g AS (SELECT patient_id, cnd AS condition, avg(v / 10) FILTER (v >= 2 AND ses = 'T0') AS e0, avg(v / 10) FILTER (v >= 2 AND ses = 'T1') AS e1,
  avg(v / 2) FILTER (ses = 'T0') AS a0, avg(v / 2) FILTER (ses = 'T1') AS a1 FROM x GROUP BY 1, 2)
SELECT patient_id, condition, round(e0, 6) AS "mean_reconstruction_error_T0", round(e1, 6) AS "mean_reconstruction_error_T1", round(e1 - e0, 6) AS mean_reconstruction_error_delta,
  round(a0, 6) AS "mean_cycle_auc_T0", round(a1, 6) AS "mean_cycle_auc_T1", round(a1 - a0, 6) AS mean_cycle_auc_delta, round(e1 / greatest(e0, 1e-12), 6) AS mean_reconstruction_error_ratio FROM g""")
def cohort_pairs(spark, sf):
    return rounded(P.cohort_pairs(P.task_summary(*_task_tables(spark, sf)), ["mean_reconstruction_error", "mean_cycle_auc"]))
