"""Streaming operators run to the end of a folder of files against the same operators on the whole table."""

import pytest
from pyspark.sql import functions as F

from strideframe.streaming import batch_segments, distinct_events, sessions, stream_segments

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """`events` in files by time with neighbours swapped, some rows twice, and a last row that moves the watermark on."""
    root = str(tmp_path_factory.mktemp("feed") / "f")
    e = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", F.col("event_type").alias("mark"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v"))
    late = e.withColumn("part", F.floor((F.unix_timestamp("ts") + F.pmod(F.xxhash64("event_id"), F.lit(3600))) / (6 * 86400)))
    twice = late.where("event_id % 5 = 0")
    for n, (rows, part) in enumerate([(late.where(F.col("part") == p["part"]), p["part"]) for p in late.select("part").distinct().orderBy("part").collect()]):
        rows.unionByName(twice.where(F.col("part") == part)).drop("part").coalesce(1).write.mode("append").parquet(root)
    end = e.limit(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("mark"), F.expr("timestamp'2030-01-01 00:00:00'").alias("ts"), F.lit(0.0).alias("v"))
    end.coalesce(1).write.mode("append").parquet(root)
    return root, e


def run_stream(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert not q.isActive and q.exception() is None
    return spark.table(name)


def source(spark, root, e):
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(root)


def test_distinct_then_sessions(spark, feed, tmp_path):
    root, e = feed
    once = distinct_events(source(spark, root, e), ["event_id"], late="2 hours")
    got = run_stream(spark, once.groupBy("user_id", F.session_window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean")), "stream_sessions", tmp_path)
    want = sessions(e, ["user_id"], gap="1 day").select("user_id", F.col("session_start"), "n", F.round("mean", 9))
    rows = got.where("user_id >= 0").select("user_id", F.col("session_window.start"), "n", F.round("mean", 9))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, want.collect()))


def test_sessions_operator_on_a_stream(spark, feed, tmp_path):
    root, e = feed
    got = run_stream(spark, sessions(source(spark, root, e), ["user_id"], gap="1 day", late="2 hours"), "plain_sessions", tmp_path)
    twice = e.unionByName(e.where("event_id % 5 = 0"))
    want = sessions(twice, ["user_id"], gap="1 day")
    cols = ["user_id", "session_start", "session_end", "n", F.round("mean", 9), "first", "last"]
    assert sorted(map(tuple, got.where("user_id >= 0").select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_segments_equal_the_batch(spark, feed, tmp_path):
    root, e = feed
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        marks = source(spark, root, e.drop("part")).withColumn("mark", F.when(F.col("mark") == "end", "view").otherwise(F.col("mark")))
        got = run_stream(spark, stream_segments(marks, ["user_id"], "ts", "mark", "view", "purchase", 259200.0, late="2 hours"), "segments", tmp_path)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    twice = e.unionByName(e.where("event_id % 5 = 0"))
    want = batch_segments(twice, ["user_id"], "ts", "mark", "view", "purchase", 259200.0)
    rows = lambda d: sorted(((r["user_id"], str(r["start"]), str(r["end"]), r["status"]) for r in d.where("user_id >= 0").collect()))
    assert rows(got) == rows(want) and got.where("status = 'closed'").count() > 0
