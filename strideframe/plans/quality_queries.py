"""Channel quality over `lineitem` (channel = supplier) and coordination over `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.fixed import ENVELOPE_BAND, SMOOTH_HZ
from strideframe.operators import coordination as C
from strideframe.operators import filters as L
from strideframe.operators import qc as Q
from strideframe.operators import segments as S
from strideframe.plans.registry import EVENT_TYPES, SIGNAL_CTE, query, rounded, signals, table
from strideframe.plans.signal_queries import _GRID_SQL

_QC = """x AS (SELECT l_suppkey, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS i FROM lineitem),
m AS (SELECT l_suppkey, count(*) AS n, avg(v) AS mu, stddev_pop(v) AS sd, min(v) AS lo, max(v) AS hi, sqrt(avg(v * v)) AS rms FROM x GROUP BY 1),
d AS (SELECT x.l_suppkey, sum(CAST(v <= lo + 0.005 * (hi - lo) AS INT)) + sum(CAST(v >= hi - 0.005 * (hi - lo) AS INT)) AS clip FROM x JOIN m USING (l_suppkey) GROUP BY 1),
f AS (SELECT l_suppkey, count(*) FILTER (abs(v - p) < 0.0001 * (hi - lo)) AS flat FROM (SELECT l_suppkey, v, lag(v) OVER (PARTITION BY l_suppkey ORDER BY i) AS p FROM x) JOIN m USING (l_suppkey) GROUP BY 1),
q AS (SELECT m.l_suppkey, s_nationkey, n AS n_samples, CAST(n AS DOUBLE) AS duration_s, CAST(1 AS DOUBLE) AS fs, CASE WHEN n >= 50 THEN mu END AS signal_mean, CASE WHEN n >= 50 THEN sd END AS signal_std,
  CASE WHEN n >= 50 THEN lo END AS signal_min, CASE WHEN n >= 50 THEN hi END AS signal_max, CASE WHEN n >= 50 THEN rms END AS rms, CASE WHEN n >= 50 THEN abs(mu) / sd END AS offset_ratio,
  CASE WHEN n >= 50 THEN clip / n END AS clipping_fraction, CASE WHEN n >= 50 THEN flat / (n - 1) END AS flatline_fraction
  FROM m JOIN d USING (l_suppkey) JOIN f USING (l_suppkey) JOIN supplier ON s_suppkey = m.l_suppkey),
z AS (SELECT *, CAST(CASE WHEN offset_ratio > 0.1 THEN 1 ELSE 0 END + CASE WHEN clipping_fraction > 0.01 THEN 2 ELSE 0 END + CASE WHEN flatline_fraction > 0.05 THEN 2 ELSE 0 END
  + CASE WHEN rms < 1e-9 THEN 2 ELSE 0 END AS INTEGER) AS qc_score FROM q),
qc AS (SELECT *, CASE WHEN n_samples < 50 THEN 'too_short' WHEN qc_score >= 4 THEN 'bad' WHEN qc_score >= 2 THEN 'warning' ELSE 'ok' END AS qc_flag FROM z)"""


def supplier_samples(spark, sf):
    return table(spark, sf, "lineitem").select("l_suppkey", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', l_shipdate)").alias("t"), "l_orderkey",
                                               "l_linenumber", F.col("l_extendedprice").alias("v"))


def supplier_qc(spark, sf):
    qc = Q.score(Q.time_metrics(supplier_samples(spark, sf), ["l_suppkey"], "t", tie=["l_orderkey", "l_linenumber", "v"]))
    sup = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return qc.join(sup, "l_suppkey")


@query("channel_qc_time", f"""
WITH {_QC} SELECT l_suppkey, s_nationkey, n_samples, duration_s, fs, round(signal_mean, 4) AS signal_mean, round(signal_std, 4) AS signal_std, round(signal_min, 4) AS signal_min,
  round(signal_max, 4) AS signal_max, round(rms, 4) AS rms, round(offset_ratio, 4) AS offset_ratio, round(clipping_fraction, 4) AS clipping_fraction,
  round(flatline_fraction, 4) AS flatline_fraction, qc_score, qc_flag FROM qc""")
def channel_qc_time(spark, sf):
    return rounded(supplier_qc(spark, sf), 4)


def _pass_sql(name: str, source: str, b: list[float], a: list[float]) -> str:
    """The difference equation of one filter over ``source`` (channel, i, x), row after row, as if the first value had always stood there."""
    back = [f"coalesce(lag(x, {k}) OVER w, first_value(x) OVER w)" if k else "x" for k in range(len(b))]
    order = len(a) - 1
    return f"""{name}_u AS MATERIALIZED (SELECT channel, i, {" + ".join(f"{c!r} * {x}" for c, x in zip(b, back))} AS u, {sum(b) / sum(a)!r} * first_value(x) OVER w AS y0
  FROM {source} WINDOW w AS (PARTITION BY channel ORDER BY i)),
{name}_r(channel, i, h) AS (SELECT channel, CAST(-1 AS BIGINT), [{", ".join(["y0"] * order)}] FROM {name}_u WHERE i = 0
  UNION ALL SELECT r.channel, r.i + 1, [u.u - ({" + ".join(f"{c!r} * r.h[{k}]" for k, c in enumerate(a[1:], 1))}){"".join(f", r.h[{k}]" for k in range(1, order))}]
  FROM {name}_r r JOIN {name}_u u ON u.channel = r.channel AND u.i = r.i + 1),
{name} AS (SELECT channel, max(i) OVER (PARTITION BY channel) - i AS i, h[1] AS x FROM {name}_r WHERE i >= 0)"""


def _zero_phase_sql(name: str, source: str, cut_hz: list[float], fs: float) -> str:
    """Forward and backward passes over the oddly extended channel; every pass turns the order of rows around."""
    b, a = ([float(c) for c in x] for x in L._transfer(4, cut_hz, fs))
    pad = 3 * max(len(a), len(b))
    return f"""{name}_s AS (SELECT channel, max(i) AS last, arg_min(x, i) AS x0, arg_max(x, i) AS x1 FROM {source} GROUP BY 1),
{name}_e AS (SELECT channel, i + {pad} AS i, x FROM {source}
  UNION ALL SELECT channel, {pad} - i, 2 * x0 - x FROM {source} JOIN {name}_s USING (channel) WHERE i BETWEEN 1 AND {pad}
  UNION ALL SELECT channel, {pad} + 2 * last - i, 2 * x1 - x FROM {source} JOIN {name}_s USING (channel) WHERE i BETWEEN last - {pad} AND last - 1),
{_pass_sql(f"{name}_f", f"{name}_e", b, a)}, {_pass_sql(f"{name}_b", f"{name}_f", b, a)},
{name} AS (SELECT channel, i - {pad} AS i, x FROM {name}_b JOIN {name}_s USING (channel) WHERE i BETWEEN {pad} AND {pad} + last)"""


def _band_sql(name: str, low: float, high: float) -> str:
    """Trapezoids between neighbouring bins that both lie in a band; NULL when it holds no bin."""
    return f"CASE WHEN count(*) FILTER (freq BETWEEN {low} AND {high}) > 0 THEN coalesce(sum(area) FILTER (freq BETWEEN {low} AND {high} AND pf >= {low}), 0) END AS {name}"


_MOMENTS = ["signal_mean", "signal_std", "signal_min", "signal_max", "rms"]


@query("channel_qc_full", f"""
WITH RECURSIVE {_QC}, c AS (SELECT l_suppkey AS channel, i - 1 AS i, v AS x FROM x),
{_zero_phase_sql("trend", "c", [Q.DRIFT_HZ], 150.0)}, tr AS (SELECT channel, sqrt(avg(x * x)) AS trend FROM trend GROUP BY 1),
np AS (SELECT *, least(n, 300) AS nper FROM (SELECT *, count(*) OVER (PARTITION BY channel) AS n FROM c) WHERE n >= 50),
sg AS (SELECT channel, n, nper, w.w AS seg, i - w.w * (nper - nper // 2) AS j, x FROM np, unnest(range(CAST(greatest(ceil((i - nper + 1) / (nper - nper // 2)), 0) AS BIGINT),
  CAST(least(i // (nper - nper // 2), (n - nper) // (nper - nper // 2)) AS BIGINT) + 1)) w(w)),
hx AS (SELECT channel, seg, nper, j, (x - avg(x) OVER (PARTITION BY channel, seg)) * (0.5 - 0.5 * cos(2 * pi() * j / nper)) AS x, pow(0.5 - 0.5 * cos(2 * pi() * j / nper), 2) AS w2 FROM sg),
hb AS (SELECT hx.*, b.b AS bin FROM hx, unnest(range(0, nper // 2 + 1)) b(b)),
pp AS (SELECT channel, seg, nper, bin, (pow(sum(x * cos(2 * pi() * ((bin * j) % nper) / nper)), 2) + pow(sum(x * sin(2 * pi() * ((bin * j) % nper) / nper)), 2)) / sum(w2)
  * CASE WHEN bin = 0 OR 2 * bin = nper THEN 1 ELSE 2 END AS p FROM hb GROUP BY channel, seg, nper, bin),
psd AS (SELECT channel, bin, bin * 150.0::DOUBLE / nper AS freq, avg(p) / 150 AS power FROM pp GROUP BY channel, bin, nper),
ar AS (SELECT channel, freq, lag(freq) OVER o AS pf, (freq - lag(freq) OVER o) * (power + lag(power) OVER o) / 2 AS area FROM psd WINDOW o AS (PARTITION BY channel ORDER BY bin)),
bp AS (SELECT channel, {_band_sql("emg", 20, 71.25)}, {_band_sql("motion", 1, 20)}, {_band_sql("line", 49, 51)} FROM ar GROUP BY 1),
r AS (SELECT q.*, CASE WHEN n_samples >= 50 THEN trend / rms END AS drift_ratio, motion / CASE WHEN coalesce(emg, 0) <= 0 THEN 1e-30 ELSE emg END AS motion_artifact_ratio,
  line / CASE WHEN coalesce(emg, 0) <= 0 THEN 1e-30 ELSE emg END AS line_noise_ratio FROM q LEFT JOIN tr ON tr.channel = l_suppkey LEFT JOIN bp ON bp.channel = l_suppkey),
p AS (SELECT *, CAST(CASE WHEN offset_ratio > 0.1 THEN 1 ELSE 0 END + CASE WHEN clipping_fraction > 0.01 THEN 2 ELSE 0 END + CASE WHEN flatline_fraction > 0.05 THEN 2 ELSE 0 END
  + CASE WHEN rms < 1e-9 THEN 2 ELSE 0 END + CASE WHEN drift_ratio > 0.2 THEN 1 ELSE 0 END + CASE WHEN motion_artifact_ratio > 0.3 THEN 1 ELSE 0 END
  + CASE WHEN line_noise_ratio > 0.2 THEN 1 ELSE 0 END AS INTEGER) AS score FROM r)
SELECT l_suppkey, n_samples, round(n_samples / 150.0::DOUBLE, 6) AS duration_s, CAST(150 AS DOUBLE) AS fs, {", ".join(f"round({c}, 4) AS {c}" for c in _MOMENTS)},
  {", ".join(f"round({c}, 6) AS {c}" for c in ("offset_ratio", "clipping_fraction", "flatline_fraction", "drift_ratio", "motion_artifact_ratio", "line_noise_ratio"))},
  score AS qc_score, CASE WHEN n_samples < 50 THEN 'too_short' WHEN score >= 4 THEN 'bad' WHEN score >= 2 THEN 'warning' ELSE 'ok' END AS qc_flag FROM p""")
def channel_qc_full(spark, sf):
    """All seven quality rules of each supplier's prices, taken as samples at 150 Hz."""
    qc = Q.channel_qc(supplier_samples(spark, sf), ["l_suppkey"], "t", "v", ["l_orderkey", "l_linenumber", "v"], fs=150.0)
    return rounded(qc, 6, **dict.fromkeys(_MOMENTS, 4))


@query("qc_summary", f"""
WITH {_QC} SELECT s_nationkey, count(*) AS n_channels, round(avg(offset_ratio), 6) AS offset_ratio, round(avg(clipping_fraction), 6) AS clipping_fraction,
  round(avg(flatline_fraction), 6) AS flatline_fraction, round(avg(rms), 4) AS rms, round(avg(qc_score), 6) AS qc_score, count(*) FILTER (qc_flag = 'bad') AS n_bad,
  count(*) FILTER (qc_flag = 'warning') AS n_warning, count(*) FILTER (qc_flag = 'ok') AS n_ok, round(count(*) FILTER (qc_flag = 'bad') / count(*), 6) AS frac_bad,
  round(count(*) FILTER (qc_flag = 'warning') / count(*), 6) AS frac_warning FROM qc GROUP BY 1""")
def qc_summary(spark, sf):
    return rounded(Q.summary(supplier_qc(spark, sf), "s_nationkey"), 6, rms=4)


@query("qc_flag_shares", f"""
WITH {_QC} SELECT s_nationkey, {", ".join(f"count(*) FILTER (qc_flag = '{f}') AS {f}" for f in Q.FLAGS)},
  {", ".join(f"round(count(*) FILTER (qc_flag = '{f}') / count(*), 6) AS {f}_frac" for f in Q.FLAGS)} FROM qc GROUP BY 1""")
def qc_flag_shares(spark, sf):
    return rounded(Q.flag_shares(supplier_qc(spark, sf), "s_nationkey"))


@query("qc_bad_percent_top", f"""
WITH {_QC} SELECT s_nationkey, round(avg(CASE WHEN qc_flag = 'bad' THEN 100.0 ELSE 0 END), 6) AS bad_pct FROM qc GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def qc_bad_percent_top(spark, sf):
    return rounded(Q.bad_percent(supplier_qc(spark, sf), "s_nationkey", 15))


@query("qc_score_histogram", f"WITH {_QC} SELECT qc_score, qc_flag, count(*) AS n_channels FROM qc GROUP BY 1, 2")
def qc_score_histogram(spark, sf):
    return Q.score_histogram(supplier_qc(spark, sf))


@query("qc_worst_channels", f"""
WITH {_QC} SELECT l_suppkey, qc_score, round(clipping_fraction, 6) AS clipping_fraction, round(flatline_fraction, 6) AS flatline_fraction FROM qc
ORDER BY qc_score DESC, qc.clipping_fraction DESC, qc.flatline_fraction DESC, l_suppkey LIMIT 50""")
def qc_worst_channels(spark, sf):
    worst = Q.worst_channels(supplier_qc(spark, sf), ["l_suppkey"], 50)
    return rounded(worst.select("l_suppkey", "qc_score", "clipping_fraction", "flatline_fraction"))


_CURVES = f"""curves AS ({_GRID_SQL.replace("round(%s, 6)", "(%s)") % "CASE WHEN nph IS NULL THEN v ELSE v + (nv - v) * (phase - ph) / (nph - ph) END"})"""


def event_grid(spark, sf):
    return S.phase_grid(signals(spark, sf), ["entity", "channel"], tie=["sample"])


@query("pairwise_correlation", f"""
WITH {_CURVES}
SELECT a.entity, a.channel AS channel_a, b.channel AS channel_b, round(CASE WHEN stddev_pop(a.v) > 1e-12 AND stddev_pop(b.v) > 1e-12 THEN corr(a.v, b.v) END, 6) AS corr
FROM curves a JOIN curves b ON a.entity = b.entity AND a.phase_idx = b.phase_idx AND a.channel < b.channel GROUP BY 1, 2, 3""")
def pairwise_correlation(spark, sf):
    return rounded(C.pairwise_correlation(event_grid(spark, sf), ["entity"], EVENT_TYPES))


@query("correlation_matrix", f"""
WITH {_CURVES},
p AS (SELECT a.entity, a.channel AS ca, b.channel AS cb, corr(a.v, b.v) AS r FROM curves a JOIN curves b ON a.entity = b.entity AND a.phase_idx = b.phase_idx AND a.channel <> b.channel GROUP BY 1, 2, 3),
m AS (SELECT ca, cb, avg(r) AS r FROM p GROUP BY 1, 2)
SELECT ca AS channel_a, {", ".join(f"round(CASE WHEN ca = '{c}' THEN 1.0 ELSE max(r) FILTER (cb = '{c}') END, 6) AS {c}" for c in EVENT_TYPES)} FROM m GROUP BY 1""")
def correlation_matrix(spark, sf):
    mean = C.pairwise_correlation(event_grid(spark, sf), ["entity"], EVENT_TYPES).groupBy("channel_a", "channel_b").agg(F.avg("corr").alias("corr"))
    return rounded(C.symmetric_matrix(mean, [], EVENT_TYPES, "corr"))


_W = "CASE WHEN a.phase_idx IN (0, 100) THEN 0.005 ELSE 0.01 END"


@query("cocontraction", f"""
WITH {_CURVES}
SELECT a.entity, a.channel AS channel_a, b.channel AS channel_b, round(CASE WHEN sum((a.v + b.v) * {_W}) > 1e-12 THEN 2 * sum(least(a.v, b.v) * {_W}) / sum((a.v + b.v) * {_W}) END, 6) AS cci
FROM curves a JOIN curves b ON a.entity = b.entity AND a.phase_idx = b.phase_idx AND ((a.channel = 'view' AND b.channel = 'click') OR (a.channel = 'signup' AND b.channel = 'purchase')) GROUP BY 1, 2, 3""")
def cocontraction(spark, sf):
    return rounded(C.cocontraction(event_grid(spark, sf), ["entity"], [("view", "click"), ("signup", "purchase")], 101))


@query("cycle_stability", f"""
WITH {_CURVES},
c AS (SELECT channel, entity, avg(v) AS m, max(v) AS p, sum(v * CASE WHEN phase_idx IN (0, 100) THEN 0.005 ELSE 0.01 END) AS a FROM curves GROUP BY 1, 2),
mc AS (SELECT channel, phase_idx, avg(v) AS mv FROM curves GROUP BY 1, 2),
s AS (SELECT channel, entity, CASE WHEN stddev_pop(v) > 1e-12 AND stddev_pop(mv) > 1e-12 THEN corr(v, mv) END AS r FROM curves JOIN mc USING (channel, phase_idx) GROUP BY 1, 2)
SELECT channel, round(stddev_pop(m) / avg(m), 6) AS cv_mean_amp, round(stddev_pop(p) / avg(p), 6) AS cv_peak_amp, round(stddev_pop(a) / avg(a), 6) AS cv_auc,
  round(avg(r), 6) AS mean_similarity_to_mean_cycle, round(stddev_pop(r), 6) AS std_similarity_to_mean_cycle FROM c JOIN s USING (channel, entity) GROUP BY 1""")
def cycle_stability(spark, sf):
    return rounded(C.stability(event_grid(spark, sf), ["channel"], ["entity"], 101))


_HZ = 150.0
_BAND = [max(1.0, ENVELOPE_BAND[0]), min(ENVELOPE_BAND[1], _HZ / 2 * 0.99)]


@query("filtered_channels", f"""
WITH RECURSIVE {SIGNAL_CTE}, x AS (SELECT channel, row_number() OVER (PARTITION BY channel ORDER BY t, sample) - 1 AS i, coalesce(v, 0) AS x FROM s),
{_zero_phase_sql("band", "x", _BAND, _HZ)}, rectified AS (SELECT channel, i, abs(x) AS x FROM band),
{_zero_phase_sql("smooth", "rectified", [SMOOTH_HZ], _HZ)}
SELECT channel, 'ok' AS status, count(*) AS n, round(avg(greatest(x, 0)), 6) AS mean_envelope, round(max(greatest(x, 0)), 6) AS peak_envelope FROM smooth GROUP BY channel""")
def filtered_channels(spark, sf):
    """Band-pass, rectify and envelope of each event channel at a nominal 150 Hz, summarised per channel."""
    y = L.filter_channels(signals(spark, sf), ["channel"], "t", L.envelope(150.0), tie=["sample"])
    return rounded(y.groupBy("channel", "status").agg(F.count(F.lit(1)).alias("n"), F.avg("filtered").alias("mean_envelope"), F.max("filtered").alias("peak_envelope")))
