"""Rate changes, epochs, bursts and recording metadata over `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.operators import resample as R
from strideframe.operators.peaks import find_peaks
from strideframe.plans.registry import SIGNAL_CTE, query, rounded, signals, table
from strideframe.sources.sinks import quality_metadata
from strideframe.streaming import epoch_statistics

#: m: the local maxima of every channel; i: its numbered samples.
MAXIMA_CTE = f"""{SIGNAL_CTE}, i AS (SELECT channel, t, v, row_number() OVER (PARTITION BY channel ORDER BY t, sample) - 1 AS idx FROM s),
c AS (SELECT *, sum(CASE WHEN v IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY idx) AS run FROM (SELECT *, lag(v) OVER (PARTITION BY channel ORDER BY idx) AS p FROM i)),
r AS (SELECT channel, run, any_value(v) AS v, (min(idx) + max(idx)) // 2 AS pos FROM c GROUP BY 1, 2),
m AS (SELECT channel, v AS top, pos FROM (SELECT *, lag(v) OVER o AS a, lead(v) OVER o AS b FROM r WINDOW o AS (PARTITION BY channel ORDER BY run)) WHERE v > a AND v > b)"""
#: d: the lowest sample between each maximum of m and the next higher sample, on both sides.
PROMINENCE_CTE = """h AS (SELECT channel, pos, top, coalesce(max(CASE WHEN idx < pos AND v > top THEN idx END), -1) AS l, coalesce(min(CASE WHEN idx > pos AND v > top THEN idx END), 1000000000) AS r FROM m JOIN i USING (channel) GROUP BY 1, 2, 3),
d AS (SELECT channel, pos, top, min(CASE WHEN idx > l AND idx <= pos THEN v END) AS ml, min(CASE WHEN idx < r AND idx >= pos THEN v END) AS mr FROM h JOIN i USING (channel) GROUP BY 1, 2, 3)"""


@query("fourier_resample", f"""
WITH {SIGNAL_CTE}, i AS (SELECT channel, entity, v, row_number() OVER (PARTITION BY entity, channel ORDER BY t, sample) - 1 AS i, count(*) OVER (PARTITION BY entity, channel) AS n,
  min(t) OVER (PARTITION BY entity, channel) AS t0, max(t) OVER (PARTITION BY entity, channel) AS t1 FROM s),
m AS (SELECT *, greatest(2, CAST(round((t1 - t0) * 10 / 2592000.0) AS BIGINT)) AS m FROM i WHERE n >= 2),
k AS (SELECT m.*, j.j AS j, least(n, m) AS sz, pi() * (((j.j * n - i * m) % (n * m) + n * m) % (n * m)) / (n * m) AS h FROM m, unnest(range(0, m)) j(j)),
w AS (SELECT *, (CASE WHEN abs(sin(h)) < 1e-9 THEN 2 * ((sz - 1) // 2) + 1 ELSE sin((2 * ((sz - 1) // 2) + 1) * h) / sin(h) END
  + CASE WHEN sz % 2 = 0 THEN (CASE WHEN m < n THEN 2.0 ELSE 1.0 END) * cos(sz * h) ELSE 0 END) / n AS kern FROM k)
SELECT entity, channel, j AS sample_idx, round(max(t0) + j * (max(t1) - max(t0)) / (max(m) - 1), 4) AS t, round(sum(v * kern), 6) AS v FROM w GROUP BY entity, channel, j""")
def fourier_resample(spark, sf):
    """Every signal to ten samples per thirty days."""
    return rounded(R.fourier_resample(signals(spark, sf), ["entity", "channel"], "t", 10 / 2592000.0, tie=["sample"]), 6, t=4)


@query("polyphase_resample", f"""
WITH {SIGNAL_CTE}, i AS (SELECT channel, coalesce(v, 0) AS v, row_number() OVER (PARTITION BY channel ORDER BY t, sample) - 1 AS i, count(*) OVER (PARTITION BY channel) AS n FROM s),
z AS (SELECT k.k AS k, pi() * (k.k - 50) / 5.0 AS a, 5.0 * sqrt(1 - ((k.k - 50) / 50.0) ** 2) AS z FROM range(0, 101) k(k)),
b AS (SELECT k, any_value(a) AS a, sum((z / 2) ** (2 * m.m) / gamma(m.m + 1) ** 2) AS bessel FROM z, range(0, 40) m(m) GROUP BY k),
w AS (SELECT k, CASE WHEN a = 0 THEN 1 ELSE sin(a) / a END * bessel AS w FROM b), h AS (SELECT k, 3 * w / sum(w) OVER () AS h FROM w),
p AS (SELECT channel, v, i, j.j AS j FROM i, unnest(range(greatest(0, (3 * i - 46) // 5), least((3 * n + 4) // 5, (3 * i + 50) // 5 + 1))) j(j)),
y AS (SELECT channel, j, sum(v * h) AS y FROM p JOIN h ON h.k = 5 * p.j - 3 * p.i + 50 GROUP BY 1, 2)
SELECT channel, count(*) AS n, round(avg(y), 5) AS mean, round(max(y), 5) AS max FROM y GROUP BY channel""")
def polyphase_resample(spark, sf):
    """Every channel to three fifths of its rate, summarised."""
    y = R.polyphase_resample(signals(spark, sf), ["channel"], "t", 3, 5, tie=["sample"])
    return rounded(y.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.max("v").alias("max")), 5)


@query("epochs", f"""
WITH {SIGNAL_CTE}, k AS (SELECT *, t - min(t) OVER (PARTITION BY channel) AS r, max(t) OVER (PARTITION BY channel) - min(t) OVER (PARTITION BY channel) AS d FROM s)
SELECT channel, e.e AS epoch, e.e * CAST(43200 AS DOUBLE) AS epoch_start_s, count(*) AS n, round(avg(v), 6) AS mean FROM k, unnest(range(CAST(greatest(floor((r - 86400) / 43200) + 1, 0) AS BIGINT),
  CAST(least(floor(r / 43200), floor((d - 86400) / 43200)) AS BIGINT) + 1)) e(e) GROUP BY 1, 2""")
def epochs(spark, sf):
    """One-day epochs with half overlap per channel."""
    e = R.epochs(signals(spark, sf), ["channel"], "t", 86400.0, 0.5)
    return rounded(e.groupBy("channel", "epoch", "epoch_start_s").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean")))


@query("active_bursts", f"""
WITH {SIGNAL_CTE}, i AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t, sample) AS i FROM s), a AS (SELECT *, i - row_number() OVER (PARTITION BY entity ORDER BY i) AS run FROM i WHERE v >= 20),
r AS (SELECT entity, run, min(t) AS onset, max(t) AS "offset", count(*) AS n_samples, max(v) AS peak FROM a GROUP BY 1, 2)
SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY run) - 1 AS burst, round(onset, 6) AS onset, round("offset", 6) AS "offset", n_samples, peak FROM r""")
def active_bursts(spark, sf):
    return rounded(R.active_bursts(signals(spark, sf), ["entity"], "t", 20.0, tie=["sample"]))


@query("quality_metadata", f"""
WITH {SIGNAL_CTE}, c AS (SELECT entity, channel, count(*) AS n, round(max(t) - min(t), 3) AS d, min(v) AS lo, max(v) AS hi, avg(v) AS mean, stddev_pop(v) AS std,
  round(avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END), 4) AS nan_ratio FROM s GROUP BY 1, 2)
SELECT entity, count(*) OVER (PARTITION BY entity) AS n_channels, max(d) OVER (PARTITION BY entity) AS duration_s, channel AS name, n AS n_samples_actual, d AS channel_s, round(lo, 6) AS "min",
  round(hi, 6) AS "max", round(mean, 6) AS mean, round(std, 6) AS std, nan_ratio FROM c""")
def metadata(spark, sf):
    """What the JSON record of each recording says about it and its channels."""
    facts = "array<struct<name string, n_samples_actual bigint, duration_s double, min double, max double, mean double, std double, nan_ratio double>>"
    out = quality_metadata(signals(spark, sf), ["entity"]).select("*", F.explode(F.from_json("channels", facts)).alias("x"))
    return rounded(out.select("entity", "n_channels", "duration_s", "x.name", "x.n_samples_actual", F.col("x.duration_s").alias("channel_s"), "x.min", "x.max", "x.mean", "x.std", "x.nan_ratio"))


@query("epoch_statistics", """
WITH e AS (SELECT event_type AS channel, value AS v, epoch_us(ts) // 43200000000 AS b FROM events), w AS (SELECT channel, v, b - o.o AS b FROM e, range(0, 2) o(o))
SELECT channel, b * CAST(43200 AS BIGINT) AS epoch_start, count(*) AS n, round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max FROM w GROUP BY 1, 2""")
def epoch_stats(spark, sf):
    """The streaming epoch operator on the whole batch table."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("channel"), "ts", F.col("value").alias("v"))
    out = epoch_statistics(e, ["channel"], length="1 day", step="12 hours")
    return rounded(out.withColumn("epoch_start", F.unix_seconds("epoch_start")))


@query("peaks", f"""
WITH {MAXIMA_CTE},
{PROMINENCE_CTE}
SELECT d.channel, pos AS idx, round(t, 6) AS t, v FROM d JOIN i ON i.channel = d.channel AND i.idx = pos WHERE top - greatest(ml, mr) >= 20""")
def peaks(spark, sf):
    """Peaks of each channel by prominence alone."""
    return rounded(find_peaks(signals(spark, sf), ["channel"], "t", tie=["sample"], distance=1, prominence=20.0))


@query("peaks_thinned", f"""
WITH RECURSIVE {MAXIMA_CTE},
q AS (SELECT channel, pos, row_number() OVER (PARTITION BY channel ORDER BY top DESC, pos DESC) AS k FROM m),
g(channel, k, kept) AS (SELECT DISTINCT channel, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM q UNION ALL
  SELECT q.channel, q.k, CASE WHEN len(list_filter(g.kept, lambda x: abs(x - q.pos) < 25)) > 0 THEN g.kept ELSE list_append(g.kept, CAST(q.pos AS BIGINT)) END
  FROM g JOIN q ON q.channel = g.channel AND q.k = g.k + 1),
apart AS (SELECT channel, unnest(arg_max(kept, k)) AS pos FROM g GROUP BY channel),
{PROMINENCE_CTE}
SELECT channel, count(*) AS n_peaks, round(avg(top), 6) AS mean_height FROM d JOIN apart USING (channel, pos) WHERE top - greatest(ml, mr) >= 5 GROUP BY channel""")
def peaks_thinned(spark, sf):
    """Peaks with a minimum distance as well, counted per channel."""
    p = find_peaks(signals(spark, sf), ["channel"], "t", tie=["sample"], distance=25, prominence=5.0)
    return rounded(p.groupBy("channel").agg(F.count(F.lit(1)).alias("n_peaks"), F.avg("v").alias("mean_height")))
