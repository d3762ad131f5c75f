"""Windows, complexity and spectra over `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.operators import complexity as C
from strideframe.operators import features as X
from strideframe.operators import spectral as P
from strideframe.operators import windows as N
from strideframe.operators.ordered import row_index
from strideframe.operators.rates import by_rate
from strideframe.plans.registry import EVENT_TYPES, SIGNAL_CTE, query, rounded, signals
from strideframe.plans.signal_queries import SEGMENT_CTE, signup_segments

KEYS = ["entity", "channel"]

_WINDOWS = f"""{SIGNAL_CTE},
i AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t, sample) - 1 AS idx, count(*) OVER (PARTITION BY entity) AS n FROM s),
w AS (SELECT i.*, w.w AS window_index FROM i,
  unnest(range(CAST(greatest(ceil((idx - 7) / 4.0), 0) AS BIGINT), CAST(least(floor(idx / 4.0), floor((n - 8) / 4.0)) AS BIGINT) + 1)) w(w) WHERE n >= 8)"""


@query("sliding_windows", f"""
WITH {_WINDOWS}
SELECT entity, window_index, round(min(t), 6) AS start_s, round(max(t), 6) AS end_s, (min(t) + max(t)) / 2 AS center_s,
  CAST(count(*) AS INTEGER) AS n_samples, CAST(count(*) FILTER (v > 0.5) AS INTEGER) AS n_valid
FROM w GROUP BY 1, 2 HAVING count(*) FILTER (v > 0.5) >= 6""")
def sliding_windows(spark, sf):
    out = N.sliding_windows(signals(spark, sf), ["entity"], "t", 8, 4, ["sample"], min_valid=6, valid=F.col("v") > 0.5)
    return out.withColumns({c: F.round(c, 6) for c in ("start_s", "end_s")})


@query("windows_in_segments", f"""
WITH {_WINDOWS}, {SEGMENT_CTE},
ww AS (SELECT entity, window_index, min(t) AS start_s, max(t) AS end_s FROM w GROUP BY 1, 2)
SELECT entity, window_index, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM ww
WHERE EXISTS (SELECT 1 FROM seg WHERE seg.entity = ww.entity AND ww.start_s >= seg.start_s AND ww.end_s <= seg.end_s)""")
def windows_in_segments(spark, sf):
    wins = N.sliding_windows(signals(spark, sf), ["entity"], "t", 8, 4, ["sample"]).select("entity", "window_index", "start_s", "end_s")
    return rounded(N.windows_inside_segments(wins, signup_segments(spark, sf), ["entity"]))


@query("window_quality", f"""
WITH {_WINDOWS},
c AS (SELECT entity, window_index, channel, count(*) AS cells, avg(CASE WHEN v > 2 THEN 1.0 ELSE 0.0 END) AS active, sum(CASE WHEN v > 2 THEN v ELSE 0 END) AS total,
  var_pop(CASE WHEN v > 2 THEN v ELSE 0 END) AS vr, count(CASE WHEN v > 2 THEN v END) AS present FROM w GROUP BY 1, 2, 3),
g AS (SELECT entity, window_index, max(cells) AS n_samples, count(*) FILTER (active >= 0.01) AS n_active, sum(total) AS total,
  max(vr) AS vr, sum(present) AS present FROM c GROUP BY 1, 2)
SELECT entity, window_index, n_samples, skip_reason IS NOT NULL AS skip_flag, skip_reason FROM (
  SELECT *, CASE WHEN 1 - present / (n_samples * 5.0) > 0.7 THEN 'too_many_nans' WHEN n_samples < 2 THEN 'too_few_samples'
    WHEN n_active < 4 THEN 'too_few_active_muscles' WHEN total / (n_samples * 5.0) < 12 THEN 'too_low_activation'
    WHEN vr < 1e-20 THEN 'zero_variance' END AS skip_reason FROM g)""")
def window_quality(spark, sf):
    rows = N.expand_windows(row_index(signals(spark, sf), ["entity"], "t", ["sample"]), 8, 4)
    rows = rows.withColumn("v", F.when(F.col("v") > 2, F.col("v")))
    return N.window_quality(rows, ["entity", "window_index"], "channel", "v", len(EVENT_TYPES), samples_from=2, missing_to=0.7, active_from=4, level_from=12.0)


_ROUGH = """r AS (SELECT entity, channel, count(*) n, stddev_samp(v) sd,
  sqrt(avg(dd) / max(var) + 1e-12) AS rms_derivative, sum(z * nz) / sum(CASE WHEN nz IS NOT NULL THEN z * z END) AS lag1_autocorr
  FROM (SELECT *, v - avg(v) OVER k AS z, lead(v) OVER o - avg(v) OVER k AS nz, (v - lag(v) OVER o) * (v - lag(v) OVER o) AS dd,
        var_samp(v) OVER k AS var FROM s WINDOW o AS (PARTITION BY entity, channel ORDER BY t, sample), k AS (PARTITION BY entity, channel))
  GROUP BY 1, 2)"""


@query("roughness", f"""
WITH {SIGNAL_CTE}, {_ROUGH}
SELECT entity, channel, CASE WHEN n >= 3 THEN round(rms_derivative, 6) END AS rms_derivative,
  CASE WHEN n >= 3 THEN round(lag1_autocorr, 6) END AS lag1_autocorr FROM r""")
def roughness(spark, sf):
    return rounded(C.roughness(signals(spark, sf), KEYS, "t", tie=["sample"]))


_PE = """pe AS (SELECT entity, channel, abs(sum(p * log2(p))) / log2(6) AS permutation_entropy FROM (
  SELECT entity, channel, count(*) / sum(count(*)) OVER (PARTITION BY entity, channel) AS p FROM (
    SELECT entity, channel, CAST(v <= b AS INT) * 4 + CAST(b <= c AS INT) * 2 + CAST(v <= c AS INT) AS code FROM (
      SELECT *, lead(v, 1) OVER o AS b, lead(v, 2) OVER o AS c, lead(v, 3) OVER o AS d, count(*) OVER (PARTITION BY entity, channel) AS n
      FROM s WINDOW o AS (PARTITION BY entity, channel ORDER BY t, sample)) WHERE d IS NOT NULL AND n >= 6)
  GROUP BY entity, channel, code) GROUP BY 1, 2)"""


@query("permutation_entropy", f"""
WITH {SIGNAL_CTE}, {_PE} SELECT entity, channel, round(permutation_entropy, 6) AS permutation_entropy FROM pe""")
def permutation_entropy(spark, sf):
    return rounded(C.permutation_entropy(signals(spark, sf), KEYS, "t", tie=["sample"]))


def _psd(k: str, value: str = "v") -> str:
    return f"""i AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY t, sample) - 1 AS idx, count(*) OVER (PARTITION BY {k}) AS n,
  avg(v) OVER (PARTITION BY {k}) AS mu, stddev_samp(v) OVER (PARTITION BY {k}) AS sdv FROM s),
np AS (SELECT *, greatest(least(256, n), 16) AS nper, {value} AS y FROM i WHERE n >= 16),
sg AS (SELECT {k}, n, nper, w.w AS seg, idx - w.w * (nper - nper // 2) AS j, y FROM np,
  unnest(range(CAST(greatest(ceil((idx - nper + 1) / (nper - nper // 2)), 0) AS BIGINT),
    CAST(least(idx // (nper - nper // 2), (n - nper) // (nper - nper // 2)) AS BIGINT) + 1)) w(w)),
hx AS (SELECT *, (y - avg(y) OVER (PARTITION BY {k}, seg)) * (0.5 - 0.5 * cos(2 * pi() * j / nper)) AS x,
  pow(0.5 - 0.5 * cos(2 * pi() * j / nper), 2) AS w2 FROM sg),
hb AS (SELECT hx.*, b.b AS bin FROM hx, unnest(range(0, nper // 2 + 1)) b(b)),
pp AS (SELECT {k}, seg, bin, n, nper, (pow(sum(x * cos(2 * pi() * ((bin * j) % nper) / nper)), 2)
    + pow(sum(x * sin(2 * pi() * ((bin * j) % nper) / nper)), 2)) / sum(w2) * CASE WHEN bin = 0 OR 2 * bin = nper THEN 1 ELSE 2 END AS p
  FROM hb GROUP BY {k}, seg, bin, n, nper),
psd AS (SELECT {k}, bin, n, nper, CAST(bin AS DOUBLE) / nper AS freq, avg(p) AS power FROM pp GROUP BY {k}, bin, n, nper)"""


@query("welch_psd", f"""
WITH {SIGNAL_CTE}, {_psd("channel")}
SELECT channel, CAST(bin AS INTEGER) AS bin, round(freq, 6) AS freq, round(power, 5) AS power, n, CAST(nper AS INTEGER) AS nper FROM psd""")
def welch_psd(spark, sf):
    return rounded(P.welch(signals(spark, sf), ["channel"], "t", P.feature_segment, tie=["sample"]), power=5)


@query("band_power", f"""
WITH {SIGNAL_CTE}, {_psd("channel")},
a AS (SELECT *, lag(freq) OVER o AS pf, (freq - lag(freq) OVER o) * (power + lag(power) OVER o) / 2 AS area FROM psd WINDOW o AS (PARTITION BY channel ORDER BY bin))
SELECT channel, round(sum(CASE WHEN freq BETWEEN 0.01 AND 0.1 AND pf >= 0.01 THEN area END), 5) AS low,
  round(sum(CASE WHEN freq BETWEEN 0.1 AND 0.4 AND pf >= 0.1 THEN area END), 5) AS mid,
  CAST(NULL AS DOUBLE) AS above FROM a GROUP BY 1""")
def band_power(spark, sf):
    psd = P.welch(signals(spark, sf), ["channel"], "t", P.feature_segment, tie=["sample"])
    return rounded(P.band_power(psd, ["channel"], {"low": (0.01, 0.1), "mid": (0.1, 0.4), "above": (0.6, 0.9)}), 5)


@query("band_power_rates", f"""
WITH {SIGNAL_CTE}, {_psd("channel")},
r AS (SELECT channel, bin, freq * hz AS freq, power / hz AS power, hz FROM (SELECT *, CASE WHEN channel IN ('click', 'view') THEN 1.0 ELSE 2.5 END AS hz FROM psd)),
a AS (SELECT *, lag(freq) OVER o AS pf, (freq - lag(freq) OVER o) * (power + lag(power) OVER o) / 2 AS area FROM r WINDOW o AS (PARTITION BY channel ORDER BY bin))
SELECT channel, CAST(any_value(hz) AS DOUBLE) AS fs, round(sum(CASE WHEN freq BETWEEN 0.1 AND 0.4 AND pf >= 0.1 THEN area END), 5) AS mid,
  round(sum(CASE WHEN freq BETWEEN 0.6 AND 0.9 AND pf >= 0.6 THEN area END), 5) AS above FROM a GROUP BY 1""")
def band_power_rates(spark, sf):
    """Channels of two sampling rates; the upper band lies beyond the slower ones' Nyquist frequency."""
    rated = signals(spark, sf).withColumn("fs", F.when(F.col("channel").isin("click", "view"), 1.0).otherwise(2.5))
    psd = by_rate(rated, "fs", lambda rows, hz: P.welch(rows, ["channel"], "t", P.feature_segment, tie=["sample"], fs=hz))
    return rounded(P.band_power(psd, ["channel", "fs"], {"mid": (0.1, 0.4), "above": (0.6, 0.9)}), 5)


_CYCLES = SIGNAL_CTE.replace("event_type AS channel", "CAST(floor((epoch_us(ts) - 1704067200000000) / 864000000000.0) AS BIGINT) AS channel")
_FEATS = f"""{_CYCLES}, {_psd("entity, channel", "(v - mu) / sdv")},
sp AS (SELECT entity, channel, min(CASE WHEN power = pk THEN freq END) AS dominant_frequency_hz, -sum(q * log2(q + 1e-12)) / log2(count(*)) AS spectral_entropy
  FROM (SELECT *, max(power) OVER k AS pk, greatest(power, 1e-12) / sum(greatest(power, 1e-12)) OVER k AS q FROM psd WINDOW k AS (PARTITION BY entity, channel)) GROUP BY 1, 2),
{_ROUGH}, {_PE},
b AS (SELECT entity, channel, count(*) AS n_samples, max(t) - min(t) AS cycle_duration_s FROM s GROUP BY 1, 2 HAVING count(*) >= 2 AND max(t) > min(t)),
f AS (SELECT entity, channel AS cycle, n_samples, cycle_duration_s, dominant_frequency_hz, spectral_entropy,
  CASE WHEN n >= 3 THEN rms_derivative END AS normalized_rms_derivative, CASE WHEN n >= 3 THEN lag1_autocorr END AS lag1_autocorr, permutation_entropy
  FROM b LEFT JOIN r USING (entity, channel) LEFT JOIN sp USING (entity, channel) LEFT JOIN pe USING (entity, channel))"""


def _cycles(spark, sf):
    return signals(spark, sf).select("entity", F.floor(F.col("t") / 864000).alias("cycle"), "sample", "t", "v")


@query("cycle_features", f"""
WITH {_FEATS}
SELECT entity, cycle, n_samples, round(cycle_duration_s, 6) AS cycle_duration_s, round(dominant_frequency_hz, 6) AS dominant_frequency_hz,
  round(spectral_entropy, 5) AS spectral_entropy, round(normalized_rms_derivative, 5) AS normalized_rms_derivative,
  round(lag1_autocorr, 5) AS lag1_autocorr, round(permutation_entropy, 5) AS permutation_entropy FROM f""")
def cycle_features(spark, sf):
    out = X.cycle_features(_cycles(spark, sf), ["entity", "cycle"], tie=["sample"])
    return rounded(out, 5, cycle_duration_s=6, dominant_frequency_hz=6)


@query("cycle_feature_means", f"""
WITH {_FEATS},
a AS (SELECT entity, count(*) AS n_segments, count(coalesce(dominant_frequency_hz, spectral_entropy, normalized_rms_derivative, lag1_autocorr, permutation_entropy)) AS n_valid,
  median(cycle_duration_s) AS md, min(cycle_duration_s) AS mn, max(cycle_duration_s) AS mx, avg(cycle_duration_s) AS cd, avg(dominant_frequency_hz) AS df, avg(spectral_entropy) AS se,
  avg(normalized_rms_derivative) AS rd, avg(lag1_autocorr) AS la, avg(permutation_entropy) AS pe FROM f GROUP BY 1)
SELECT entity, n_segments, n_valid, n_segments - n_valid AS n_discarded, round(md, 3) AS median_duration_s, round(mn, 3) AS min_duration_s, round(mx, 3) AS max_duration_s,
  CASE WHEN n_valid < 3 THEN 'too_few_cycles (n=' || n_valid || ' < min=3)' END AS exclusion_reason,
  CASE WHEN n_valid >= 3 THEN round(cd, 3) END AS cycle_duration_s, CASE WHEN n_valid >= 3 THEN round(df, 5) END AS dominant_frequency_hz,
  CASE WHEN n_valid >= 3 THEN round(se, 5) END AS spectral_entropy, CASE WHEN n_valid >= 3 THEN round(rd, 5) END AS normalized_rms_derivative,
  CASE WHEN n_valid >= 3 THEN round(la, 5) END AS lag1_autocorr, CASE WHEN n_valid >= 3 THEN round(pe, 5) END AS permutation_entropy FROM a""")
def cycle_feature_means(spark, sf):
    feats = X.cycle_features(_cycles(spark, sf), ["entity", "cycle"], tie=["sample"])
    return rounded(X.aggregate_cycles(feats, ["entity"], 3), 5, median_duration_s=3, min_duration_s=3, max_duration_s=3,
                   cycle_duration_s=3)
