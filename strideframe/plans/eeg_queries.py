"""Cleaning steps of multichannel recordings over `events`: a user is in one of a few recordings, a sample is a user's day."""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from strideframe.operators import reference, rejection, splines, unmixing
from strideframe.plans.registry import EVENT_TYPES, query, rounded, table

RECORDINGS = 7


def wide_samples(spark, sf):
    """rec, sample and one column per channel: the day's sum, zero without events."""
    sums = [F.coalesce(F.sum(F.when(F.col("event_type") == c, F.col("value"))), F.lit(0.0)).alias(c) for c in EVENT_TYPES]
    e = table(spark, sf, "events")
    return e.groupBy((F.col("user_id") % RECORDINGS).alias("rec"), (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("sample")).agg(*sums)


def long_samples(spark, sf):
    return wide_samples(spark, sf).unpivot(["rec", "sample"], EVENT_TYPES, "channel", "v")


WIDE = f"""x AS (SELECT user_id % {RECORDINGS} AS rec, user_id * 100 + day(ts) AS sample,
  {", ".join(f"coalesce(sum(value) FILTER (event_type = '{c}'), 0) AS {c}" for c in EVENT_TYPES)} FROM events GROUP BY 1, 2)"""

_POLAR = "sqrt(pow(p + sg * s, 2) + pow(q - sg * r, 2))"


@query("independent_components", f"""
WITH RECURSIVE {WIDE},
m AS (SELECT rec, count(*) AS n, avg(click) AS mc, avg(view) AS mv, var_pop(click) AS a, covar_pop(click, view) AS b, var_pop(view) AS d FROM x GROUP BY rec),
l AS (SELECT *, (a + d) / 2 + sqrt(pow((a - d) / 2, 2) + b * b) AS l1, (a + d) / 2 - sqrt(pow((a - d) / 2, 2) + b * b) AS l2 FROM m),
v AS (SELECT *, b / sqrt(b * b + pow(l1 - a, 2)) AS e0, (l1 - a) / sqrt(b * b + pow(l1 - a, 2)) AS f0 FROM l),
u AS (SELECT *, CASE WHEN (abs(e0) >= abs(f0) AND e0 < 0) OR (abs(f0) > abs(e0) AND f0 < 0) THEN -1 ELSE 1 END AS s1,
             CASE WHEN (abs(f0) >= abs(e0) AND f0 > 0) OR (abs(e0) > abs(f0) AND e0 < 0) THEN -1 ELSE 1 END AS s2 FROM v),
k AS (SELECT rec, n, mc, mv, e0 * s1 AS e1, f0 * s1 AS f1, -f0 * s2 AS e2, e0 * s2 AS f2, sqrt(l1) AS t1, sqrt(l2) AS t2 FROM u),
z AS (SELECT x.rec, ((click - mc) * e1 + (view - mv) * f1) / t1 AS z1, ((click - mc) * e2 + (view - mv) * f2) / t2 AS z2 FROM x JOIN k USING (rec)),
w AS (SELECT rec, sqrt(0.5) AS p, sqrt(0.5) AS q, sqrt(0.5) AS r, -sqrt(0.5) AS s, 0 AS step FROM k
  UNION ALL SELECT rec, (p + sg * s) / {_POLAR}, (q - sg * r) / {_POLAR}, (r - sg * q) / {_POLAR}, (s + sg * p) / {_POLAR}, step + 1 FROM (
    SELECT *, CASE WHEN p * s - q * r < 0 THEN -1 ELSE 1 END AS sg FROM (
      SELECT w.rec, step, avg(tanh(p * z1 + q * z2) * z1) - avg(1 - pow(tanh(p * z1 + q * z2), 2)) * p AS p, avg(tanh(p * z1 + q * z2) * z2) - avg(1 - pow(tanh(p * z1 + q * z2), 2)) * q AS q,
             avg(tanh(r * z1 + s * z2) * z1) - avg(1 - pow(tanh(r * z1 + s * z2), 2)) * r AS r, avg(tanh(r * z1 + s * z2) * z2) - avg(1 - pow(tanh(r * z1 + s * z2), 2)) * s AS s
      FROM w JOIN z ON z.rec = w.rec WHERE step < 80 GROUP BY w.rec, step, w.p, w.q, w.r, w.s))),
c AS (SELECT rec, n, unnest([struct_pack(a := p, b := q), struct_pack(a := r, b := s)]) AS h, e1, f1, e2, f2, t1, t2 FROM w JOIN k USING (rec) WHERE step = 80),
g AS (SELECT rec, n, h.a * e1 / t1 + h.b * e2 / t2 AS uc, h.a * f1 / t1 + h.b * f2 / t2 AS uv, h.a * e1 * t1 + h.b * e2 * t2 AS xc, h.a * f1 * t1 + h.b * f2 * t2 AS xv FROM c),
o AS (SELECT *, CASE WHEN (abs(xc) >= abs(xv) AND xc < 0) OR (abs(xv) > abs(xc) AND xv < 0) THEN -1 ELSE 1 END AS sg FROM g)
SELECT rec, n, CAST(row_number() OVER (PARTITION BY rec ORDER BY xc * xc + xv * xv DESC) - 1 AS INTEGER) AS component, round(sg * uc, 3) AS unmix_click, round(sg * uv, 3) AS unmix_view,
       round(sg * xc, 2) AS mix_click, round(sg * xv, 2) AS mix_view FROM o""")
def independent_components(spark, sf):
    """Two channels of every recording unmixed."""
    fits = unmixing.unmix(wide_samples(spark, sf), ["rec"], ["click", "view"], max_iter=80, tol=1e-12)
    rows = fits.select("rec", "n", "unmixing", "mixing", F.explode(F.array(F.lit(0), F.lit(1))).alias("component"))
    at = lambda a, i: F.element_at(a, (i + 1).cast("int"))
    i = F.col("component")
    return rows.select("rec", "n", "component", F.round(at("unmixing", 2 * i), 3).alias("unmix_click"), F.round(at("unmixing", 2 * i + 1), 3).alias("unmix_view"),
                       F.round(at("mixing", i), 2).alias("mix_click"), F.round(at("mixing", i + 2), 2).alias("mix_view"))


#: Directions of five sensors around the head (degrees of longitude and latitude); fixed values of the queries.
SENSORS = {"click": (0.0, 20.0), "error": (80.0, 35.0), "purchase": (150.0, 10.0), "signup": (220.0, 50.0), "view": (300.0, 30.0)}
LOST, SERIES = "signup", 7


def _kernel_sql(c: str) -> str:
    """The spline's kernel as a polynomial in a cosine, its series cut at SERIES terms."""
    total = np.zeros(SERIES + 1)
    for n in range(1, SERIES + 1):
        p = np.polynomial.legendre.leg2poly([0] * n + [1])
        total[: n + 1] += (2 * n + 1) / (n * (n + 1.0)) ** splines.STIFFNESS * p / (4 * np.pi)
    return "(" + " + ".join(f"({t!r}) * pow({c}, {i})" for i, t in enumerate(total.tolist())) + ")"


def _cosine_sql(a: str, b: str) -> str:
    (la, fa), (lb, fb) = SENSORS[a], SENSORS[b]
    return f"(sin(radians({fa})) * sin(radians({fb})) + cos(radians({fa})) * cos(radians({fb})) * cos(radians({la - lb})))"


_GOOD = [c for c in EVENT_TYPES if c != LOST]
_SIZE = len(_GOOD) + 1


def _det_sql(cell) -> str:
    """Determinant of a matrix of column names by permutations."""
    terms = []
    for p in permutations(range(_SIZE)):
        even = sum(p[i] > p[j] for i in range(_SIZE) for j in range(i + 1, _SIZE)) % 2 == 0
        factors = [cell(i, j) for i, j in enumerate(p)]
        if "0" not in factors:
            terms.append(("+" if even else "-") + " * ".join(f for f in factors if f != "1"))
    return "(" + " ".join(terms) + ")"


def _cell(i: int, j: int) -> str:
    last = _SIZE - 1
    return "0" if i == j == last else "1" if last in (i, j) else f"g{min(i, j)}{max(i, j)}"


_SYSTEM = ", ".join(f"{_kernel_sql(_cosine_sql(_GOOD[i], _GOOD[j]))}{f' + {splines.DIAGONAL!r}' if i == j else ''} AS g{i}{j}" for i in range(_SIZE - 1) for j in range(i, _SIZE - 1))
_TARGET = ", ".join(f"{_kernel_sql(_cosine_sql(LOST, c))} AS h{i}" for i, c in enumerate(_GOOD))
_WEIGHTS = ", ".join(f"{_det_sql(lambda i, j, k=k: (f'h{i}' if i < _SIZE - 1 else '1') if j == k else _cell(i, j))} / {_det_sql(_cell)} AS w{k}" for k in range(_SIZE - 1))


@query("spline_rebuilt", f"""
WITH {WIDE}, g AS (SELECT {_SYSTEM}, {_TARGET}), w AS (SELECT {_WEIGHTS} FROM g)
SELECT rec, sample, '{LOST}' AS channel, round({" + ".join(f"w{i} * {c}" for i, c in enumerate(_GOOD))}, 4) AS v FROM x, w""")
def spline_rebuilt(spark, sf):
    """One channel of every recording removed and rebuilt from the four others."""
    rows = long_samples(spark, sf)
    lon = F.create_map(*[F.lit(x) for c, p in SENSORS.items() for x in (c, p[0])])[F.col("channel")]
    lat = F.create_map(*[F.lit(x) for c, p in SENSORS.items() for x in (c, p[1])])[F.col("channel")]
    place = {"x": F.cos(F.radians(lat)) * F.cos(F.radians(lon)), "y": F.cos(F.radians(lat)) * F.sin(F.radians(lon)), "z": F.sin(F.radians(lat))}
    sensors = rows.select("rec", "channel").distinct().withColumns({**place, "bad": F.col("channel") == LOST})
    weights = splines.spline_weights(sensors, ["rec"], terms=SERIES)
    return rounded(splines.interpolated(rows.where(F.col("channel") != LOST), weights, ["rec"], ["sample"]), 4)


_LIMIT, _CORR, _ROUNDS = 2.5, 0.01, 6


def _round_sql(i: int) -> str:
    """One round: `b{i}` names bad channels so far, `f{i}` has the figures and `b{i+1}` the next set."""
    return f"""
r{i} AS (SELECT l.*, v - avg(v) FILTER (NOT bad) OVER q AS d, dv - avg(dv) FILTER (NOT bad) OVER q AS e, bad FROM l JOIN b{i} USING (rec, channel) WINDOW q AS (PARTITION BY rec, sample)),
c{i} AS (SELECT rec, channel, max(abs(c)) AS best_corr FROM (SELECT p.rec, p.channel, corr(p.d, o.d) AS c FROM r{i} p JOIN r{i} o ON o.rec = p.rec AND o.sample = p.sample AND o.channel <> p.channel
  GROUP BY p.rec, p.channel, o.channel) GROUP BY 1, 2),
s{i} AS (SELECT rec, channel, any_value(bad) AS was, max(v) - min(v) AS span, stddev_pop(d) AS deviation, sum(e * e) / sum(d * d) AS roughness, any_value(best_corr) AS best_corr FROM r{i} JOIN c{i} USING (rec, channel) GROUP BY 1, 2),
m{i} AS (SELECT rec, median(deviation) AS md, median(roughness) AS mr FROM s{i} WHERE NOT was GROUP BY rec),
a{i} AS (SELECT rec, median(abs(deviation - md)) * 1.4826 AS ad, median(abs(roughness - mr)) * 1.4826 AS ar FROM s{i} JOIN m{i} USING (rec) WHERE NOT was GROUP BY rec),
f{i} AS (SELECT s{i}.*, CASE WHEN was THEN NULL WHEN span = 0 THEN 'flat' WHEN abs(deviation - md) / nullif(ad, 0) > {_LIMIT} THEN 'deviation' WHEN (roughness - mr) / nullif(ar, 0) > {_LIMIT} THEN 'roughness'
  WHEN best_corr < {_CORR} THEN 'correlation' END AS why FROM s{i} JOIN m{i} USING (rec) JOIN a{i} USING (rec)),
b{i + 1} AS (SELECT rec, channel, CASE WHEN count(*) FILTER (NOT was AND why IS NULL) OVER (PARTITION BY rec) >= 2 THEN was OR why IS NOT NULL ELSE was END AS bad, why FROM f{i})"""


@query("robust_reference", f"""
WITH {WIDE}, y AS (UNPIVOT x ON {", ".join(EVENT_TYPES)} INTO NAME channel VALUE v), l AS (SELECT *, v - lag(v) OVER (PARTITION BY rec, channel ORDER BY sample) AS dv FROM y),
b0 AS (SELECT DISTINCT rec, channel, false AS bad, NULL AS why FROM l), {",".join(_round_sql(i) for i in range(_ROUNDS))}
SELECT f.rec, f.channel, round(deviation, 4) AS deviation, round(roughness, 4) AS roughness, round(best_corr, 4) AS best_corr, b.bad,
  CASE WHEN b.bad THEN coalesce({", ".join(f"b{i}.why" for i in range(1, _ROUNDS + 1))}) END AS why
FROM f{_ROUNDS - 1} f JOIN b{_ROUNDS} b USING (rec, channel) {" ".join(f"JOIN b{i} USING (rec, channel)" for i in range(1, _ROUNDS))}
""".replace(f"b{_ROUNDS}.why", "b.why"))
def robust_reference(spark, sf):
    """Channels left out of every recording's average reference."""
    marks = reference.bad_channels(wide_samples(spark, sf), ["rec"], EVENT_TYPES, "sample", limit=_LIMIT, least_corr=_CORR, max_iter=_ROUNDS)
    return rounded(marks.drop("rounds"), 4)


_EPOCHS = """e AS (SELECT event_type AS channel, user_id AS epoch, dayofweek(ts) AS pos, avg(value) AS v FROM events GROUP BY 1, 2, 3)"""
_THRESHOLDS = f"""{_EPOCHS}, p AS (SELECT channel, epoch, max(v) - min(v) AS ptp FROM e GROUP BY 1, 2),
k AS (SELECT *, (row_number() OVER (PARTITION BY channel ORDER BY ptp, epoch) - 1) * 10 // count(*) OVER (PARTITION BY channel) AS part FROM p),
t AS (SELECT DISTINCT channel, max(ptp) AS thr FROM k GROUP BY channel, part),
r AS (SELECT e.*, ptp, epoch % 5 AS fold FROM e JOIN p USING (channel, epoch)),
f AS (SELECT channel, fold, pos, median(v) AS mid FROM r GROUP BY 1, 2, 3),
n AS (SELECT f.channel, f.fold, f.pos, t.thr, any_value(f.mid) AS mid, avg(r.v) AS mean FROM f JOIN t ON t.channel = f.channel JOIN r ON r.channel = f.channel AND r.pos = f.pos AND r.fold <> f.fold AND r.ptp <= t.thr GROUP BY 1, 2, 3, 4),
g AS (SELECT channel, thr, avg(err) AS error FROM (SELECT channel, thr, fold, sqrt(avg(pow(mean - mid, 2))) AS err FROM n GROUP BY 1, 2, 3) GROUP BY 1, 2),
c AS (SELECT channel, arg_min(thr, struct_pack(error := error, thr := thr)) AS threshold, min(error) AS error FROM g GROUP BY 1)"""


def weekly_epochs(spark, sf):
    """channel, epoch (a user), pos (day of the week) and v: the day's mean."""
    e = table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("channel"), F.col("user_id").alias("epoch"), (F.dayofweek("ts") - 1).alias("pos")).agg(F.avg("value").alias("v"))


def _chosen(spark, sf):
    return rejection.rejection_thresholds(weekly_epochs(spark, sf), ["channel"], fold=F.col("epoch") % 5)


@query("rejection_thresholds", f"""
WITH {_THRESHOLDS} SELECT channel, round(any_value(threshold), 5) AS threshold, round(any_value(error), 5) AS error, count(*) AS n_epochs, count(*) FILTER (ptp > threshold) AS n_rejected
FROM p JOIN c USING (channel) GROUP BY channel""")
def rejection_thresholds(spark, sf):
    """The peak-to-peak threshold of every channel by cross-validation over users."""
    return rounded(_chosen(spark, sf), 5)


@query("rejected_epochs", f"""
WITH {_THRESHOLDS} SELECT epoch, count(*) AS n_channels, count(*) FILTER (ptp > threshold) AS n_bad, count(*) FILTER (ptp > threshold) > count(*) * 0.4 AS rejected FROM p JOIN c USING (channel) GROUP BY epoch""")
def rejected_epochs(spark, sf):
    """Users dropped because too many of their channels exceed the thresholds."""
    return rejection.epoch_marks(weekly_epochs(spark, sf), _chosen(spark, sf), [])
