"""Stateful audits of event streams, each with a batch twin that gives the same rows.

A key's events are worked on in (time, id) order with a state of a few numbers. The batch twin sorts by key and time inside partitions and
carries the state from row to row, so a key of any size streams through. The stream deals keys into buckets and keeps a bucket's events in a list of state, an
entry for each batch that brings some, until the watermark has passed them, whatever files and batches they came in; then it works them off in order. A task's memory is that of
one bucket's events within the delay, so buckets are chosen by the number of events.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusmill.operators.store import KeyedStore
from corpusmill.workspace import Workspace

OUT = "key string, event_id long, ts timestamp, verdict string"


class TokenBucket:
    """allowed or throttled: ``rps`` tokens a second up to ``burst``; a key idle for ``ttl`` seconds starts anew."""

    def __init__(self, rps: float = 100.0, burst: int = 200, ttl: float = 600.0):
        self.rps, self.burst, self.ttl = rps, burst, ttl

    def fresh(self) -> tuple[float, float]:
        return float(self.burst), float("nan")

    def step(self, state: tuple[float, float], at: float, ok: bool) -> tuple[tuple[float, float], str]:
        tokens, last = state
        if last == last:
            tokens = float(self.burst) if at - last > self.ttl else min(float(self.burst), tokens + max(0.0, at - last) * self.rps)
        return ((tokens - 1, at), "allowed") if tokens >= 1 else ((tokens, at), "throttled")


class Breaker:
    """State of a circuit breaker after each event: ``most`` failures in ``window`` seconds open it; after ``wait`` one probe goes through, whose outcome closes or re-opens it. Events that meet an open breaker are rejected."""

    def __init__(self, most: int = 5, window: float = 30.0, wait: float = 60.0):
        self.most, self.window, self.wait = most, window, wait

    def fresh(self) -> tuple:
        return ("closed", 0.0, ())

    def step(self, state: tuple, at: float, ok: bool) -> tuple[tuple, str]:
        mode, opened, failures = state
        probing = mode == "open" and at - opened >= self.wait
        if mode == "open" and not probing:
            return state, "rejected"
        if ok:
            return ("closed", 0.0, ()), "closed"
        failures = (*(f for f in failures if f > at - self.window), at)
        if probing or len(failures) >= self.most:
            return ("open", at, ()), "open"
        return ("closed", 0.0, failures), "closed"


def _verdicts(machine, state, rows: pd.DataFrame) -> tuple[object, list[str]]:
    out = []
    seconds = rows["ts"].astype("datetime64[us]").astype("int64") / 1e6
    for at, ok in zip(seconds.tolist(), rows["ok"].tolist()):
        state, verdict = machine.step(state, at, ok)
        out.append(verdict)
    return state, out


def batch_audit(events: DataFrame, machine, partitions: int | None = None) -> DataFrame:
    """events: key, event_id, ts, ok."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in frames:
            parts = []
            for k, rows in pdf.groupby("key", sort=False):
                if k != key:
                    key, state = k, machine.fresh()
                state, verdict = _verdicts(machine, state, rows)
                parts.append(rows[["key", "event_id", "ts"]].assign(verdict=verdict))
            if parts:
                yield pd.concat(parts)

    rows = events.select(F.col("key").cast("string"), "event_id", "ts", "ok").filter("key is not null and ts is not null")
    dealt = rows.repartition(partitions, "key") if partitions else rows.repartition("key")
    return dealt.sortWithinPartitions("key", "ts", "event_id").mapInPandas(run, OUT)


class _Audit(StatefulProcessor):
    """Events of a bucket of keys wait in a list; a timer at the earliest of them goes off when the watermark reaches it, and all that the watermark has passed go through the machines of their keys."""

    def __init__(self, machine):
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "keys array<string>, us array<long>, event_ids array<long>, oks array<boolean>")
        self.machines = handle.getMapState("machines", "key string", "state string")
        self.due = handle.getValueState("due", "ms long")

    def _wake(self, us: int | None) -> None:
        """One timer a bucket: at the earliest event that waits."""
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()
        if us is not None:
            self.handle.registerTimer(us // 1000)
            self.due.update((us // 1000,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        least = None
        for pdf in rows if key[0] >= 0 else ():
            us = pdf["ts"].astype("datetime64[us]").astype("int64")
            self.waiting.appendValue((pdf["key"].tolist(), us.tolist(), pdf["event_id"].tolist(), pdf["ok"].tolist()))
            least = min(int(us.min()), least if least is not None else int(us.min()))
        if least is not None and (not self.due.exists() or least // 1000 < self.due.get()[0]):
            self._wake(least)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A timer goes off in milliseconds; no event up to the watermark can still come.
        passed = timerValues.getCurrentWatermarkInMs() * 1000 + 999
        events = pd.concat([pd.DataFrame(dict(zip(("key", "us", "event_id", "ok"), e))) for e in self.waiting.get()])
        later = events[events["us"] > passed]
        now = events[events["us"] <= passed].sort_values(["key", "us", "event_id", "ok"])
        verdicts = []
        for name, rows in now.groupby("key", sort=False):
            state = _thawed(json.loads(self.machines.getValue((name,))[0])) if self.machines.containsKey((name,)) else self.machine.fresh()
            for us, ok in zip(rows["us"].tolist(), rows["ok"].tolist()):
                state, verdict = self.machine.step(state, us / 1e6, ok)
                verdicts.append(verdict)
            self.machines.updateValue((name,), (json.dumps(state),))
        self.waiting.clear()
        if len(later):
            self.waiting.appendValue(tuple(later[c].tolist() for c in ("key", "us", "event_id", "ok")))
        self.due.clear()
        if len(later):
            self._wake(int(later["us"].min()))
        if len(now):
            yield pd.DataFrame({"key": now["key"], "event_id": now["event_id"], "ts": pd.to_datetime(now["us"], unit="us"), "verdict": verdicts})

    def close(self) -> None:
        pass


def _thawed(x):
    return tuple(map(_thawed, x)) if isinstance(x, list) else x


#: The time of the event without a key that ends a stream.
CLOSING = dt.datetime(2250, 1, 1)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_audit(events: DataFrame, machine, late: str = "10 minutes", buckets: int = 256) -> DataFrame:
    """The same over a stream, in whatever order files and micro-batches bring the events: each comes out once the watermark, ``late`` behind the latest event, has passed it. Events that come later than that are dropped. An event without a key advances the watermark and gives no row. Keys are dealt to ``buckets``, which a checkpoint keeps. Needs the RocksDB state store."""
    key = F.col("key").cast("string")
    bucket = F.when(key.isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int")
    rows = events.select(bucket.alias("bucket"), key.alias("key"), F.coalesce("event_id", F.lit(0)).cast("long").alias("event_id"), "ts", F.coalesce("ok", F.lit(False)).alias("ok")).withWatermark("ts", late)
    # A condition on the time stays above the watermark, so that events without a key still move it.
    kept = rows.filter((F.col("bucket") >= 0) | (F.col("ts") >= F.lit(CLOSING - dt.timedelta(days=2))))
    return kept.groupBy("bucket").transformWithStateInPandas(_Audit(machine), OUT, "append", "EventTime")


def audit_to_end(events: DataFrame, machine, out: str, checkpoint: str, closing: str, late: str = "10 minutes", buckets: int = 256) -> None:
    """Works off all that is there now, to the last event: when the source is used up a closing event, in the folder ``closing``, moves the watermark past all of them. Run again with the same folders it goes on with what is new, except what lies before the end that was declared."""
    spark = events.sparkSession
    schema = "key string, event_id long, ts timestamp, ok boolean"
    spark.createDataFrame([], schema).write.mode("append").parquet(closing)
    both = events.select(F.col("key").cast("string"), F.col("event_id").cast("long"), "ts", "ok").unionByName(spark.readStream.schema(schema).parquet(closing))
    name, given = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, ROCKSDB)
    try:
        run_to_end(stream_audit(both, machine, late, buckets), out, checkpoint)
        spark.createDataFrame([(None, None, CLOSING, None)], schema).write.mode("append").parquet(closing)
        run_to_end(stream_audit(both, machine, late, buckets), out, checkpoint)
    finally:
        spark.conf.set(name, given)


def failure_alarms(events: DataFrame, seconds: int = 30, least: int = 5) -> DataFrame:
    """Failures with at least ``least`` failures of their key in (ts - seconds, ts]."""
    from pyspark.sql import Window

    us = F.unix_micros("ts")
    w = Window.partitionBy("key").orderBy(us).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.filter("not ok").withColumn("failures", F.count("*").over(w)).filter(F.col("failures") >= least)


def stream_failure_windows(events: DataFrame, size: str = "30 seconds", slide: str = "10 seconds", late: str = "10 minutes") -> DataFrame:
    return events.filter("not ok").withWatermark("ts", late).groupBy("key", F.window("ts", size, slide)).agg(F.count("*").alias("failures"))


def not_revoked(events: DataFrame, revoked: DataFrame) -> DataFrame:
    """Events whose key is not revoked at their time. revoked: key, expires_at. Also for a stream of events against a table."""
    live = revoked.groupBy(F.col("key").alias("r_key")).agg(F.max("expires_at").alias("expires_at"))
    joined = events.join(live, F.col("key") == F.col("r_key"), "left")
    return joined.filter("r_key is null or ts >= expires_at").drop("r_key", "expires_at")


def deduplicated(stream: DataFrame, key: str, ts: str, within: str = "1 day") -> DataFrame:
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Works off all that is there now, writing Parquet."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _key_store(spark: SparkSession, stored_path: str, key: T.StructField, buckets: int = 64) -> KeyedStore:
    return KeyedStore(spark, stored_path.rstrip("/") + "-keys", [key.name], T.StructType([key]), buckets=buckets)


def ingested_keys(spark: SparkSession, stored_path: str, key: T.StructField) -> DataFrame:
    """The keys that ``ingest_stream`` has stored, those whose rows gave no chunk too."""
    return _key_store(spark, stored_path, key).read()


def ingest_stream(files: DataFrame, chunk: Callable[[DataFrame], DataFrame], stored_path: str, checkpoint: str, key: str = "content_hash", buckets: int = 64) -> None:
    """Each micro-batch of files, less those whose key an earlier one has stored, goes through ``chunk``. Rows of a batch are written as its own epoch; its keys go to a keyed store beside the rows, which looks into the filters of their buckets only. A batch that runs again before its keys were complete replaces what it had written; after that it does nothing."""

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        ws = Workspace(spark, "ingest")
        keys = _key_store(spark, stored_path, files.schema[key], buckets)
        if epoch in keys.epochs():
            return
        # Keys are looked up alone. Rows move once, to be met with the new keys and made distinct on the same columns, never null.
        new = ws.keep(keys.unseen(batch.select(key).distinct()), "new")
        met = {"__key": F.coalesce(F.col(key).cast("string"), F.lit("")), "__none": F.col(key).isNull()}
        fresh = batch.withColumns(met).join(new.withColumns(met).select(*met), [*met], "left_semi").dropDuplicates([*met]).drop(*met)
        chunk(fresh).write.mode("overwrite").parquet(f"{stored_path}/epoch={epoch}")
        keys.insert(new, epoch)
        ws.drop(new)

    files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
