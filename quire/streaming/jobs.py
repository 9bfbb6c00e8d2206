"""Jobs on streams: checks on documents as they arrive, and fetches with a time to live."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from quire.functions.helpers import fetches

FETCHES = "key string, ts timestamp, fetched boolean"


def stream_lint(spark: SparkSession, in_dir: str, out: str, checkpoint: str, *, schema: str, check: Callable[[DataFrame], DataFrame]):
    """Starts a query that writes ``check``'s findings for each new Parquet file in ``in_dir``.

    A batch of the stream is checked like any table, joins and windows included, and written under its number: a batch
    that runs again after a failure replaces what it wrote before.
    """

    def batch(docs: DataFrame, n: int) -> None:
        check(docs).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return spark.readStream.schema(schema).parquet(in_dir).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Fetches(StatefulProcessor):
    """Of each key, the time of its last fetch, and a timer that drops it when no request can find it fresh any more."""

    def __init__(self, ttl_us: int):
        self.ttl = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def _expiry(self, last: int) -> int:
        return (last + self.ttl) // 1000 + 1

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values("ts", kind="stable")
        times = frame.ts.astype("datetime64[us]").astype("int64").tolist()
        was = self.last.get()[0] if self.last.exists() else None
        new = fetches(times, self.ttl, was)
        last = max([t for t, x in zip(times, new, strict=True) if x], default=was)
        if last != was:
            if was is not None:
                self.handle.deleteTimer(self._expiry(was))
            self.handle.registerTimer(self._expiry(last))
            self.last.update((last,))
        yield pd.DataFrame({"key": key[0], "ts": frame.ts, "fetched": new})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def fresh_fetches(requests: DataFrame, *, key: str, ts: str, ttl_days: int = 14, delay: str = "1 day") -> DataFrame:
    """A stream of requests (key, ts) with ``fetched``: whether the cached copy was missing or older than the time to live.

    State is one time for each key, in a store on disk; a timer of the event time drops it once its time to live is over
    everywhere, as the watermark says. Requests later than ``delay`` are dropped by the watermark. Within a batch requests
    count in order of their time: a task holds one key's requests of one batch.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = requests.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts")).withWatermark("ts", delay)
    return src.groupBy("key").transformWithStateInPandas(_Fetches(ttl_days * 86_400 * 10**6), FETCHES, "Append", "EventTime")


def fetch_job(spark: SparkSession, in_dir: str, out: str, checkpoint: str, *, schema: str, key: str, ts: str, ttl_days: int = 14, delay: str = "1 day"):
    """Starts a query that decides on the requests in the files of ``in_dir`` that are new since its last run, and ends with them.

    What it knows of earlier requests is in ``checkpoint``: a run goes on where the one before it ended, or broke off.
    """
    stream = fresh_fetches(spark.readStream.schema(schema).parquet(in_dir), key=key, ts=ts, ttl_days=ttl_days, delay=delay)
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def fresh_fetches_batch(requests: DataFrame, *, key: str, ts: str, ttl_days: int = 14) -> DataFrame:
    """The same over a table. A task reads its requests by key and time and keeps one time, however many a key has.

    A request without a time is fetched and changes nothing for others.
    """
    ttl = ttl_days * 86_400 * 10**9

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine, last = None, None
        for rows in parts:
            new = []
            for k, t in zip(rows.key, rows.ts, strict=True):
                if k != mine:
                    mine, last = k, None
                fetched = t is pd.NaT or last is None or t.value - last > ttl
                if fetched and t is not pd.NaT:
                    last = t.value
                new.append(fetched)
            yield rows.assign(fetched=new)

    src = requests.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"))
    return src.repartition("key").sortWithinPartitions("key", "ts").mapInPandas(run, FETCHES)
