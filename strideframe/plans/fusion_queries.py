"""Fusion, recoding, lookups, reshaping and text keys over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.functions import text as X
from strideframe.operators import checks as C
from strideframe.operators import paired as R
from strideframe.operators import reshape as H
from strideframe.operators.signals import sensor_magnitude, zscore
from strideframe.plans.registry import query, rounded, signals, table
from strideframe.plans.registry import SIGNAL_CTE


@query("fuse_wide", """
WITH o AS (SELECT o_custkey AS id, count(*) AS n_orders, avg(o_totalprice) AS mean_price FROM orders GROUP BY 1),
l AS (SELECT o_custkey AS id, sum(l_quantity) AS qty, avg(l_discount) AS disc FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey AS id, c_mktsegment, c_nationkey, n_orders, round(mean_price, 6) AS mean_price, round(qty, 2) AS qty, round(disc, 6) AS disc, n_name, r_name
FROM customer LEFT JOIN o ON o.id = c_custkey LEFT JOIN l ON l.id = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def fuse_wide(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("id"), "o_totalprice")
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity", "l_discount")
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment", "c_nationkey")
    geo = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    per_o = o.groupBy("id").agg(F.count(F.lit(1)).alias("n_orders"), F.avg("o_totalprice").alias("mean_price"))
    per_l = o.join(li, "o_orderkey").groupBy("id").agg(F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"))
    out = H.fuse(cust, [(per_o, ["id"]), (per_l, ["id"]), (geo, ["c_nationkey"])], ["id", "c_mktsegment", "c_nationkey"])
    return rounded(out, 6, qty=2)


def _sessions(spark, sf):
    """All orders; those before 1998 are T0."""
    return table(spark, sf, "orders").withColumn("session", F.when(F.year("o_orderdate") < 1998, "T0").otherwise("T1"))


@query("delta_ratio", f"""
SELECT o_custkey, round(avg(o_totalprice) FILTER (year(o_orderdate) < 1998), 6) AS "o_totalprice_T0", round(avg(o_totalprice) FILTER (year(o_orderdate) >= 1998), 6) AS "o_totalprice_T1",
  round(avg(o_totalprice) FILTER (year(o_orderdate) >= 1998) - avg(o_totalprice) FILTER (year(o_orderdate) < 1998), 6) AS o_totalprice_delta,
  round(avg(o_totalprice) FILTER (year(o_orderdate) >= 1998) / greatest(avg(o_totalprice) FILTER (year(o_orderdate) < 1998), 1e-12), 6) AS o_totalprice_ratio
FROM orders GROUP BY 1 HAVING count(*) FILTER (year(o_orderdate) < 1998) > 0""")
def delta_ratio(spark, sf):
    out = R.with_ratio(R.pair_sessions(_sessions(spark, sf), ["o_custkey"], "session", ["o_totalprice"]), "o_totalprice")
    return rounded(out.where("o_totalprice_T0 is not null"))


@query("inner_pairs", f"""
SELECT o_custkey, o_orderpriority, round(avg(o_totalprice) FILTER (year(o_orderdate) < 1998), 6) AS "o_totalprice_T0", round(avg(o_totalprice) FILTER (year(o_orderdate) >= 1998), 6) AS "o_totalprice_T1"
FROM orders GROUP BY 1, 2 HAVING count(DISTINCT year(o_orderdate) < 1998) = 2""")
def inner_pairs(spark, sf):
    return rounded(H.mean_then_pair(_sessions(spark, sf), ["o_custkey", "o_orderpriority"], "session", ["o_totalprice"]))


_STATUS = ["F", "O", "P"]


@query("flatten_wide", f"""
SELECT c_nationkey, {", ".join(f"round(avg(o_totalprice) FILTER (o_orderstatus = '{s}' AND o_orderpriority = '{p}'), 6) AS \"x_{s}_{p.replace('-', '_').replace(' ', '_')}_price\"" for s in _STATUS for p in ("1-URGENT", "4-NOT SPECIFIED"))}
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def flatten_wide(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    long = table(spark, sf, "orders").join(c, "o_custkey").groupBy("c_nationkey", "o_orderstatus", "o_orderpriority").agg(F.avg("o_totalprice").alias("price"))
    names = [f"x_{s}_{p}" for s in _STATUS for p in ("1_URGENT", "4_NOT_SPECIFIED")]
    return rounded(H.flatten_wide(long, ["c_nationkey"], ["o_orderstatus", "o_orderpriority"], ["price"], "x", names))


@query("wide_sessions", f"""
SELECT o_custkey, min_by(o_totalprice, o_orderkey) FILTER (year(o_orderdate) < 1998) AS "o_totalprice__T0", min_by(o_totalprice, o_orderkey) FILTER (year(o_orderdate) >= 1998) AS "o_totalprice__T1"
FROM orders GROUP BY 1""")
def wide_sessions(spark, sf):
    return H.wide_sessions(_sessions(spark, sf), ["o_custkey"], "session", ["o_totalprice"], "o_orderkey")


@query("wide_group_sessions", f"""
SELECT o_custkey, {", ".join(f"min_by(o_totalprice, o_orderkey) FILTER (year(o_orderdate) {y} AND o_orderstatus = '{s}') AS \"o_totalprice__{s}__{t}\"" for s in ("F", "O") for y, t in (("< 1998", "T0"), (">= 1998", "T1")))}
FROM orders GROUP BY 1""")
def wide_group_sessions(spark, sf):
    return H.wide_sessions(_sessions(spark, sf), ["o_custkey"], "session", ["o_totalprice"], "o_orderkey", "o_orderstatus", ["F", "O"])


_COMP = "CAST(instr('FOP', o_orderstatus) - 1 AS INTEGER)"


def _component_summary(spark, sf):
    """Wide task table: mean_synergy_<status>_<metric> per (segment, priority, session)."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    aggs = [f(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))).alias(f"mean_synergy_{i}_{m}")
            for i, s in enumerate(_STATUS) for m, f in (("mean", F.avg), ("max", F.max))]
    return _sessions(spark, sf).join(c, "o_custkey").groupBy("c_mktsegment", "o_orderpriority", "session").agg(*aggs)


@query("component_pairs", f"""
WITH r AS (SELECT c_mktsegment, o_orderpriority, {_COMP} AS comp, CASE WHEN year(o_orderdate) < 1998 THEN 'T0' ELSE 'T1' END AS session, avg(o_totalprice) AS mean, max(o_totalprice) AS max
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4),
u AS (SELECT c_mktsegment, comp, session, metric, value FROM (UNPIVOT r ON mean, max INTO NAME metric VALUE value))
SELECT c_mktsegment, comp, metric, round(avg(value) FILTER (session = 'T0'), 6) AS "T0", round(avg(value) FILTER (session = 'T1'), 6) AS "T1",
  round(avg(value) FILTER (session = 'T1') - avg(value) FILTER (session = 'T0'), 6) AS delta FROM u GROUP BY 1, 2, 3""")
def component_pairs(spark, sf):
    long = H.unpivot_components(_component_summary(spark, sf), ["c_mktsegment", "o_orderpriority", "session"], "mean_synergy_", ["mean", "max"])
    return rounded(H.component_pairs(long, ["c_mktsegment"]))


@query("clustered_pairs", f"""
WITH r AS (SELECT c_mktsegment, o_orderpriority, {_COMP} AS comp, CASE WHEN year(o_orderdate) < 1998 THEN 'T0' ELSE 'T1' END AS session, avg(o_totalprice) AS mean, max(o_totalprice) AS max, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4),
u AS (SELECT c_mktsegment, CAST(n % 2 AS INTEGER) AS meta_cluster, session, metric, value FROM (UNPIVOT r ON mean, max INTO NAME metric VALUE value))
SELECT c_mktsegment, meta_cluster, metric, round(avg(value) FILTER (session = 'T0'), 6) AS "T0", round(avg(value) FILTER (session = 'T1'), 6) AS "T1",
  round(avg(value) FILTER (session = 'T1') - avg(value) FILTER (session = 'T0'), 6) AS delta FROM u GROUP BY 1, 2, 3""")
def clustered_pairs(spark, sf):
    keys = ["c_mktsegment", "o_orderpriority", "session"]
    long = H.unpivot_components(_component_summary(spark, sf), keys, "mean_synergy_", ["mean", "max"]).where("value is not null")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    comp = F.array_position(F.array(*[F.lit(s) for s in _STATUS]), F.col("o_orderstatus")).cast("int") - 1
    clusters = _sessions(spark, sf).join(c, "o_custkey").groupBy(*keys, comp.alias("comp")).agg((F.count(F.lit(1)) % 2).cast("int").alias("meta_cluster"))
    return rounded(H.component_pairs(long, ["c_mktsegment"], clusters=clusters, task=keys))


# sides from the customer's segment, conditions from the order status
_SIDE = "CASE c_mktsegment WHEN 'BUILDING' THEN 'Destro' WHEN 'AUTOMOBILE' THEN ' dx ' WHEN 'MACHINERY' THEN 'left' WHEN 'HOUSEHOLD' THEN 'SX' ELSE 'n/a' END"
_COND = "CASE o_orderstatus WHEN 'F' THEN 'DS' WHEN 'O' THEN 'sn' ELSE '?' END"
_RECODED = f"""x AS (SELECT o.*, c_mktsegment, {_SIDE} AS side, {_COND} AS cond FROM orders o JOIN customer ON o_custkey = c_custkey),
n AS (SELECT *, CASE WHEN upper(trim(side)) IN ('DX','DESTRO','RIGHT','D') THEN 'DX' WHEN upper(trim(side)) IN ('SX','SINISTRO','LEFT','L') THEN 'SX' END AS ns,
  CASE upper(cond) WHEN 'DS' THEN 'DX' WHEN 'SN' THEN 'SX' END AS ps FROM x)"""


def _sided(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, sf, "orders").join(c, "o_custkey").withColumns({"side": F.expr(_SIDE), "cond": F.expr(_COND)})


@query("recode_group", f"""
WITH {_RECODED} SELECT c_mktsegment, CASE WHEN ps IS NOT NULL THEN CASE WHEN ps = ns THEN 'more_affected' ELSE 'less_affected' END END AS recoded_group, count(*) AS n, round(avg(o_totalprice), 6) AS mean_price
FROM n WHERE ns IS NOT NULL GROUP BY 1, 2""")
def recode_group(spark, sf):
    out = H.recode(_sided(spark, sf), "cond", "side").groupBy("c_mktsegment", "recoded_group")
    return rounded(out.agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean_price")))


@query("affected_groups", f"""
WITH d AS (SELECT c_custkey AS id, {_SIDE} AS side FROM customer), n AS (SELECT id, CASE WHEN upper(trim(side)) IN ('DX','DESTRO') THEN 'DX' WHEN upper(trim(side)) IN ('SX','LEFT') THEN 'SX' END AS s FROM d)
SELECT id, condition, CASE WHEN (condition = 'DS') = (s = 'DX') THEN 'more_affected' ELSE 'less_affected' END AS affected_group FROM n, (VALUES ('SN'), ('DS')) c(condition) WHERE s IS NOT NULL""")
def affected_groups(spark, sf):
    d = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.expr(_SIDE).alias("side"))
    return H.affected_groups(d, "side")


@query("side_report", f"""
WITH d AS (SELECT c_custkey AS id, {_SIDE} AS side FROM customer)
SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_missing_id, CAST(0 AS BIGINT) AS n_missing_side, count(*) FILTER (side = 'n/a') AS n_unknown_side,
  count(*) FILTER (side IN ('Destro', ' dx ')) AS "n_DX", count(*) FILTER (side IN ('left', 'SX')) AS "n_SX" FROM d""")
def side_report(spark, sf):
    return C.side_report(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.expr(_SIDE).alias("side")), "side")


@query("group_gaps", f"""
WITH {_RECODED} SELECT o_custkey, CASE WHEN max(CASE WHEN cond = 'DS' THEN 1 ELSE 0 END) = 0 THEN 'DS' ELSE 'sn' END AS missing FROM n GROUP BY 1
HAVING max(CASE WHEN cond = 'DS' THEN 1 ELSE 0 END) + max(CASE WHEN cond = 'sn' THEN 1 ELSE 0 END) = 1""")
def group_gaps(spark, sf):
    out = C.group_complete(_sided(spark, sf), ["o_custkey"], "cond", ["DS", "sn"])
    return out.where(F.size("missing") == 1).select("o_custkey", F.col("missing")[0].alias("missing"))


# task names in three spellings, from the order number
_NAME = """CASE o_orderkey % 4 WHEN 0 THEN 'Task_' || cnd || '_' || ses WHEN 1 THEN 'Task_' || ses || '_' || cnd WHEN 2 THEN 'reach-' || ses || ' ' || lower(cnd) ELSE 'free text' END"""
_NAMED = f"""q AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'DS' ELSE 'SN' END AS cnd, CASE WHEN year(o_orderdate) < 1998 THEN 'T0' ELSE 'T1' END AS ses FROM orders),
t AS (SELECT *, {_NAME} AS task FROM q)"""


def _named(spark, sf):
    q = table(spark, sf, "orders").withColumns({"cnd": F.expr("CASE WHEN o_orderstatus = 'F' THEN 'DS' ELSE 'SN' END"),
                                                "ses": F.when(F.year("o_orderdate") < 1998, "T0").otherwise("T1")})
    return q.withColumn("task", F.expr(_NAME))


_CANON = "CASE o_orderkey % 4 WHEN 0 THEN 'Task_' || ses || '_' || cnd WHEN 1 THEN 'Task_' || ses || '_' || cnd WHEN 2 THEN 'reach_' || ses || '_' || cnd ELSE 'free text' END"


@query("task_keys", f"""
WITH {_NAMED} SELECT o_orderkey, task, {_CANON} AS canonical, CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE ses END AS session, CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE cnd END AS condition,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Task_' || ses || '_' || cnd ELSE task END AS session_first,
  CASE WHEN o_orderkey % 4 < 2 THEN substr(task, 6) ELSE substr(task, 1, 10) END AS short, trim(regexp_replace(task, '[^0-9a-zA-Z]+', '_', 'g'), '_') AS slug FROM t""")
def task_keys(spark, sf):
    n = F.col("task")
    return _named(spark, sf).select("o_orderkey", "task", X.canonical_task(n).alias("canonical"), X.session_of(n).alias("session"), X.condition_of(n).alias("condition"),
                                    X.session_first(n).alias("session_first"), X.short_task(n).alias("short"), X.slug(n).alias("slug"))


@query("lookup_precedence", f"""
WITH {_NAMED}, c AS (SELECT *, {_CANON} AS canonical FROM t), rec AS (SELECT * FROM c WHERE o_orderpriority = '1-URGENT'),
ex AS (SELECT o_custkey, task, max_by(o_orderkey % 8 + 1, o_orderkey) AS k FROM rec GROUP BY 1, 2), ca AS (SELECT o_custkey, canonical, min_by(o_orderkey % 8 + 1, o_orderkey) AS k FROM rec GROUP BY 1, 2)
SELECT c.o_orderkey, coalesce(ex.k, ca.k, 3) AS k, CASE WHEN ex.k IS NOT NULL THEN 'exact' WHEN ca.k IS NOT NULL THEN 'canonical' ELSE 'default' END AS k_source
FROM c LEFT JOIN ex ON ex.o_custkey = c.o_custkey AND ex.task = c.task LEFT JOIN ca ON ca.o_custkey = c.o_custkey AND ca.canonical = c.canonical""")
def lookup_precedence(spark, sf):
    named = _named(spark, sf).select("o_orderkey", "o_custkey", "o_orderpriority", "task")
    rec = named.where("o_orderpriority = '1-URGENT'").select("o_custkey", "task", (F.col("o_orderkey") % 8 + 1).alias("k"), F.col("o_orderkey").alias("ord"))
    out = H.lookup(named, rec, "o_custkey", "task", "k", "ord", 3)
    return out.select("o_orderkey", F.col("k").cast("long").alias("k"), "k_source")


@query("metric_profile", """
SELECT * FROM (VALUES ('patient_id', '', false, 'meta_id'), ('l_linestatus', '', false, 'non_numeric'), ('imu_quantity', 'IMU', true, ''), ('emg_meta_C0_discount', 'emg_meta_synergy', true, ''),
  ('l_tax', 'emg_movement', true, ''), ('eeg_one', '', false, 'constant'), ('eeg_none', '', false, 'all_missing')) v(metric, metric_family, included_in_stats, exclusion_reason)
WHERE (SELECT count(DISTINCT l_quantity) > 1 AND count(DISTINCT l_discount) > 1 AND count(DISTINCT l_tax) > 1 FROM lineitem)""")
def metric_profile(spark, sf):
    wide = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("patient_id"), "l_linestatus", F.col("l_quantity").alias("imu_quantity"), F.col("l_discount").alias("mean_meta_synergy_0_discount"),
        "l_tax", F.lit(1.0).alias("eeg_one"), F.lit(None).cast("double").alias("eeg_none"))
    return H.profile_metrics(H.rename_family(wide))


@query("common_items", """
WITH g AS (SELECT DISTINCT p_brand, p_type, p_size FROM part JOIN lineitem ON l_partkey = p_partkey)
SELECT p_size, count(DISTINCT p_type) AS n_groups FROM g GROUP BY 1 HAVING count(DISTINCT p_type) = (SELECT count(DISTINCT p_type) FROM g)""")
def common_items(spark, sf):
    g = table(spark, sf, "part").join(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")
    return H.common_to_all(g, ["p_type"], "p_size")


@query("paired_first", f"""
WITH {_RECODED}, v AS (SELECT *, CASE WHEN ps = ns THEN 'more_affected' ELSE 'less_affected' END AS g FROM n WHERE ns IS NOT NULL AND ps IS NOT NULL)
SELECT o_custkey, g AS recoded_group, min_by(o_totalprice, o_orderkey) FILTER (year(o_orderdate) < 1998) AS "o_totalprice_T0", min_by(o_totalprice, o_orderkey) FILTER (year(o_orderdate) >= 1998) AS "o_totalprice_T1"
FROM v GROUP BY 1, 2 HAVING count(DISTINCT year(o_orderdate) < 1998) = 2""")
def paired_first(spark, sf):
    rows = H.recode(_sided(spark, sf), "cond", "side").where("recoded_group is not null")
    rows = rows.withColumn("session", F.when(F.year("o_orderdate") < 1998, "T0").otherwise("T1"))
    return H.paired_first(rows, "o_custkey", "session", "recoded_group", ["o_totalprice"], "o_orderkey")


@query("unique_rows", """
SELECT l_orderkey, min(l_partkey) FILTER (rn = 1) AS l_partkey, any_value(l_tax) FILTER (rn = 1) AS l_tax, max(l_tax) - min(l_tax) <= 1e-9 AS agrees
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_tax) AS rn FROM lineitem) GROUP BY 1""")
def unique_rows(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_tax")
    return C.unique_rows(li, ["l_orderkey"], ["l_tax"], ["l_linenumber"], strict=False).select("l_orderkey", "l_partkey", "l_tax", "agrees")


@query("expand_conditions", """
SELECT regexp_replace('P' || c_custkey || CASE c_nationkey % 3 WHEN 0 THEN '_F' WHEN 1 THEN '_M' ELSE '' END, '_F$|_M$', '') AS patient_id, c_mktsegment AS time, condition, c_acctbal AS eeg_c_acctbal
FROM customer, (VALUES ('SN'), ('DS')) v(condition)""")
def expand_conditions(spark, sf):
    suffix = F.when(F.col("c_nationkey") % 3 == 0, "_F").when(F.col("c_nationkey") % 3 == 1, "_M").otherwise("")
    df = table(spark, sf, "customer").select(F.concat(F.lit("P"), F.col("c_custkey").cast("string"), suffix).alias("ID"), F.col("c_mktsegment").alias("timing"), "c_acctbal")
    return H.expand_conditions(df)


@query("stacked_frames", """
SELECT 'customer' AS source, c_custkey AS key, c_acctbal AS acctbal, c_mktsegment AS mktsegment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier""")
def stacked_frames(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("mktsegment"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("acctbal"))
    return H.stack_frames([H.with_task(c, source="customer"), H.with_task(s, source="supplier")])


@query("first_groups", """
WITH g AS (SELECT DISTINCT c_nationkey FROM customer ORDER BY 1 LIMIT 5) SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey IN (SELECT * FROM g) GROUP BY 1""")
def first_groups(spark, sf):
    return C.first_n_groups(table(spark, sf, "customer"), ["c_nationkey"], 5).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("duration_check", f"""
WITH {SIGNAL_CTE}, d AS (SELECT entity, channel, max(t) - min(t) AS d FROM s GROUP BY 1, 2)
SELECT entity, count(*) AS n_channels, round(min(d), 6) AS min_duration_s, round(max(d), 6) AS max_duration_s, max(d) - min(d) <= 432000 AS consistent FROM d GROUP BY 1""")
def duration_check(spark, sf):
    return rounded(C.durations_agree(signals(spark, sf), ["entity"], tolerance_s=432000))


@query("zscore", f"""
WITH {SIGNAL_CTE}, z AS (SELECT entity, channel, sample, (v - avg(v) OVER k) / stddev_samp(v) OVER k AS z, stddev_samp(v) OVER k AS sd, v - avg(v) OVER k AS d FROM s WINDOW k AS (PARTITION BY entity, channel))
SELECT entity, channel, sample, round(CASE WHEN sd > 1e-12 THEN z ELSE d END, 6) AS v FROM z""")
def zscored(spark, sf):
    return rounded(zscore(signals(spark, sf), ["entity", "channel"], "t").select("entity", "channel", "sample", "v"))


@query("sensor_magnitude", """
WITH d AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, avg(value) FILTER (event_type IN ('click', 'purchase')) AS x, avg(value) FILTER (event_type IN ('view', 'signup')) AS y, avg(value) FILTER (event_type = 'error') AS z FROM events GROUP BY 1, 2)
SELECT user_id, day, round(sqrt(x * x + y * y + z * z), 6) AS smv FROM d WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL""")
def magnitude(spark, sf):
    axis = F.when(F.col("event_type").isin("click", "purchase"), "X").when(F.col("event_type").isin("view", "signup"), "Y").otherwise("Z")
    daily = table(spark, sf, "events").groupBy("user_id", F.col("ts").cast("date").cast("string").alias("day"), axis.alias("axis")).agg(F.avg("value").alias("v"))
    return rounded(sensor_magnitude(daily, ["user_id", "day"]))


@query("text_numbers", r"""
SELECT event_id, CAST(replace(nullif(regexp_extract(replace(CAST(value AS VARCHAR), '.', ',') || ' Hz', '[\d,]+(?:\.\d+)?', 0), ''), ',', '.') AS DOUBLE) AS parsed,
  CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def text_numbers(spark, sf):
    e = table(spark, sf, "events")
    shown = F.concat(F.replace(F.col("value").cast("string"), F.lit("."), F.lit(",")), F.lit(" Hz"))
    return e.select("event_id", X.decimal_comma_double(shown).alias("parsed"), F.from_json("props", "k bigint")["k"].alias("k"))


@query("stat_labels", """
WITH d AS (SELECT o_orderkey, (ln(o_totalprice) - 12) / 2 AS d FROM orders), p AS (SELECT o_orderkey, d, abs(d) / 2 AS p FROM d)
SELECT o_orderkey, CASE WHEN p < 0.001 THEN 'p<0.001' ELSE 'p=' || printf('%.3f', p) END AS p_label, CASE WHEN p < 0.001 THEN 'q<0.001' ELSE 'q=' || printf('%.3f', p) END AS q_label,
  'Δ=' || CASE WHEN d >= 0 THEN '+' ELSE '' END || printf('%.3f', d) AS d_label FROM p""")
def stat_labels(spark, sf):
    """Display labels of probabilities and differences; logarithms keep the values off rounding ties."""
    d = table(spark, sf, "orders").select("o_orderkey", ((F.ln("o_totalprice") - 12) / 2).alias("d")).withColumn("p", F.abs("d") / 2)
    return d.select("o_orderkey", X.p_label(F.col("p")).alias("p_label"), X.p_label(F.col("p"), "q").alias("q_label"), X.delta_label(F.col("d")).alias("d_label"))


# channel names by supplier number: muscle in one of three languages or spellings, slot, and axis
_MUSCLE = "CASE s_nationkey % 5 WHEN 0 THEN 'Deltoide anteriore' WHEN 1 THEN ' infraspinato ' WHEN 2 THEN 'Pectoralis Major' WHEN 3 THEN 'TRAPEZIO MEDIO' ELSE 'Unknown thing' END"
_CANON_M = "CASE s_nationkey % 5 WHEN 0 THEN 'Anterior Deltoid' WHEN 1 THEN 'Infraspinatus' WHEN 2 THEN 'Pectoralis Major' WHEN 3 THEN 'Trapezius Middle' ELSE 'Unknown thing' END"
_SLOT = "CASE s_nationkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 8 WHEN 2 THEN 12 WHEN 3 THEN 7 END"


@query("muscle_names", f"""
SELECT s_suppkey, {_CANON_M} AS muscle, CAST(coalesce({_SLOT}, 0) AS INTEGER) AS slot, CASE WHEN s_nationkey % 5 < 4 THEN {_CANON_M} || ': EMG ' || ({_SLOT}) END AS emg_channel,
  CASE WHEN s_nationkey % 5 < 4 THEN {_CANON_M} || ': Acc ' || ({_SLOT}) || '.Y' END AS acc_channel FROM supplier""")
def muscle_names(spark, sf):
    m = F.expr(_MUSCLE)
    return table(spark, sf, "supplier").select("s_suppkey", X.muscle_name(m).alias("muscle"), F.coalesce(X.muscle_slot(m), F.lit(0)).alias("slot"), X.muscle_channel(m).alias("emg_channel"),
                                               X.muscle_channel(m, F.lit("Y")).alias("acc_channel"))


def _channels(spark, sf):
    """Channel list per nation: one sensor per supplier with axes chosen by number, in two spellings, plus its EMG channel."""
    base = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", F.expr(_CANON_M).alias("m"))
    sp = F.col("s_suppkey").cast("string")
    axes = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("X"), F.lit("Y"))).otherwise(F.array(F.lit("X"), F.lit("Y"), F.lit("Z")))
    acc = F.transform(axes, lambda a: F.when(F.col("s_suppkey") % 2 == 0, F.concat("m", F.lit(": Acc "), sp, F.lit("."), a)).otherwise(F.concat("m", F.lit(": ACC."), a, F.lit(" "), sp)))
    names = F.concat(F.array(F.concat("m", F.lit(": EMG "), sp)), acc)
    return base.select("s_nationkey", F.col("s_suppkey").alias("channel_index"), F.explode(names).alias("channel"))


@query("sensor_axes", f"""
SELECT s_nationkey, {_CANON_M} || ': Acc ' || s_suppkey AS sensor, {_CANON_M} || CASE WHEN s_suppkey % 2 = 0 THEN ': Acc ' || s_suppkey || '.X' ELSE ': ACC.X ' || s_suppkey END AS x,
  {_CANON_M} || CASE WHEN s_suppkey % 2 = 0 THEN ': Acc ' || s_suppkey || '.Y' ELSE ': ACC.Y ' || s_suppkey END AS y, {_CANON_M} || CASE WHEN s_suppkey % 2 = 0 THEN ': Acc ' || s_suppkey || '.Z' ELSE ': ACC.Z ' || s_suppkey END AS z,
  {_CANON_M} || ': EMG ' || s_suppkey AS emg FROM supplier WHERE s_suppkey % 3 <> 0""")
def sensor_axes(spark, sf):
    return H.sensor_axes(_channels(spark, sf), ["s_nationkey"]).withColumn("emg", X.acc_to_emg(F.col("x")))


@query("resolved_channels", f"""
WITH c AS (SELECT s_nationkey, min(s_suppkey) AS i, {_CANON_M} AS m FROM supplier GROUP BY ALL)
SELECT s_nationkey, wanted, m || ': EMG ' || i AS channel, CAST(CASE wanted WHEN 'Middle Trapezius' THEN 1 WHEN 'petto' THEN 2 ELSE 0 END AS INTEGER) AS match_rank
FROM c, (VALUES ('anterior deltoid', 'Anterior Deltoid'), ('Middle Trapezius', 'Trapezius Middle'), ('petto', 'Pectoralis Major')) w(wanted, target) WHERE m = target""")
def resolved_channels(spark, sf):
    emg = _channels(spark, sf).where(X.channel_kind(F.col("channel")) == "emg")
    return H.resolve_channels(emg, ["s_nationkey"], ["anterior deltoid", "Middle Trapezius", "petto"], variants={"petto": "pectoralis"})


@query("paired_files", """
WITH a AS (SELECT c_nationkey AS subject, c_custkey AS visit, CASE WHEN c_nationkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'a' END AS stamp, c_name || '.edf' AS path FROM customer),
b AS (SELECT s_nationkey AS subject, s_suppkey AS visit, CASE WHEN s_nationkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE 'b' END AS stamp, s_name || '.mff' AS path FROM supplier),
x AS (SELECT a.subject, a.visit, a.stamp, a.path AS path_a, b.path AS path_b FROM a JOIN b ON a.subject = b.subject AND a.visit = b.visit AND a.stamp = b.stamp),
l AS (SELECT subject, visit, min(stamp) AS stamp, min(path) AS path_a FROM a GROUP BY 1, 2 HAVING count(*) = 1), r AS (SELECT subject, visit, min(path) AS path_b FROM b GROUP BY 1, 2 HAVING count(*) = 1)
SELECT * FROM x UNION ALL SELECT l.subject, l.visit, stamp, path_a, path_b FROM l JOIN r ON l.subject = r.subject AND l.visit = r.visit WHERE l.subject NOT IN (SELECT subject FROM x)""")
def paired_files(spark, sf):
    """Customers play .edf files and suppliers .mff files of their nation; stamps agree in even nations only, the others pair by visit."""
    def listing(name, key, nat, title, ext, own):
        stamp = F.when(F.col(nat) % 2 == 0, F.col(key).cast("string")).otherwise(own)
        return table(spark, sf, name).select(F.col(nat).alias("subject"), F.col(key).alias("visit"), stamp.alias("stamp"), F.concat(F.col(title), F.lit(ext)).alias("path"))
    a = listing("customer", "c_custkey", "c_nationkey", "c_name", ".edf", "a")
    return H.pair_files(a, listing("supplier", "s_suppkey", "s_nationkey", "s_name", ".mff", "b"), by=["subject"])
