"""Streams give what batches give."""

from __future__ import annotations

import datetime as dt

from quire.streaming.jobs import fresh_fetches, fresh_fetches_batch


def test_fresh_fetches_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    hours = [0, 1, 20, 30, 49, 50, 80, 200]
    rows = [(k, t0 + dt.timedelta(hours=h + k)) for h in hours for k in (1, 2)]
    df = spark.createDataFrame(rows, "key long, ts timestamp")
    want = sorted(tuple(r) for r in fresh_fetches_batch(df, key="key", ts="ts", ttl_days=1).collect())
    for i in range(4):  # files in order of time: one small batch each
        part = [r for r in rows if i * 60 <= (r[1] - t0).total_seconds() / 3600 < (i + 1) * 60]
        spark.createDataFrame(part, "key long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = fresh_fetches(stream, key="key", ts="ts", ttl_days=1).writeStream.format("memory").queryName("fetched").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.table("fetched").select("key", "ts", "fetched").collect())
    assert got == want and len(want) == len(rows)


def test_fetches_of_keys_without_a_name_or_a_time(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(None, t0), (None, t0 + dt.timedelta(days=1)), (None, t0 + dt.timedelta(days=3)), ("a", None), ("a", t0)]
    got = fresh_fetches_batch(spark.createDataFrame(rows, "key string, ts timestamp"), key="key", ts="ts", ttl_days=1).collect()
    assert sorted((r["key"] or "", str(r["ts"]), r["fetched"]) for r in got) == sorted([("", str(t0), True), ("", str(rows[1][1]), False), ("", str(rows[2][1]), True), ("a", "None", True), ("a", str(t0), True)])
