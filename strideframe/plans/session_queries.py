"""Sessions, duplicates and marked segments of `events`, as the streaming operators find them."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.plans.registry import query, rounded, table
from strideframe.streaming import batch_segments, distinct_events, sessions


def marks(spark, sf):
    return table(spark, sf, "events").select("user_id", F.col("event_type").alias("mark"), "ts")


@query("user_sessions", """
WITH e AS (SELECT user_id, epoch_us(ts) AS us, value AS v FROM events),
r AS (SELECT *, sum(CASE WHEN us - p < 86400000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us) AS run FROM (SELECT *, lag(us) OVER (PARTITION BY user_id ORDER BY us) AS p FROM e))
SELECT user_id, min(us) AS session_start, max(us) + 86400000000 AS session_end, count(*) AS n, round(avg(v), 6) AS mean, arg_min(v, us) AS "first", arg_max(v, us) AS "last" FROM r GROUP BY user_id, run""")
def user_sessions(spark, sf):
    """Runs of a user's events less than a day apart."""
    e = table(spark, sf, "events").select("user_id", "ts", F.col("value").alias("v"))
    out = sessions(e, ["user_id"], gap="1 day")
    return rounded(out.withColumns({c: F.unix_micros(c) for c in ("session_start", "session_end")}))


@query("distinct_days", """
SELECT user_id, event_type, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1, 2""")
def distinct_days(spark, sf):
    """Days on which a user has an event of a type, by dropping the day's later events."""
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return distinct_events(e, ["user_id", "event_type", "day"]).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("days"))


@query("marked_segments", """
WITH m AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, event_type AS mark FROM events WHERE event_type IN ('view', 'purchase')),
n AS (SELECT *, lead(ms) OVER (PARTITION BY user_id ORDER BY ms, mark) AS ms2, lead(mark) OVER (PARTITION BY user_id ORDER BY ms, mark) AS mark2 FROM m)
SELECT user_id, ms AS start_ms, CASE WHEN ms2 - ms <= 259200000 AND mark2 = 'purchase' THEN ms2 END AS end_ms,
       CASE WHEN ms2 - ms <= 259200000 THEN CASE mark2 WHEN 'purchase' THEN 'closed' ELSE 'replaced' END ELSE 'timed_out' END AS status FROM n WHERE mark = 'view'""")
def marked_segments(spark, sf):
    """From a view to the user's purchase within three days."""
    out = batch_segments(marks(spark, sf), ["user_id"], "ts", "mark", "view", "purchase", 259200.0)
    return out.select("user_id", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "status")
