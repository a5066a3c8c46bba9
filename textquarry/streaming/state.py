"""Keyed state of usage streams: the last calls of each tool, entries that expire, and joins of two streams."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.shared import shared_folder

#: The state store that keyed state of several variables needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Calls that are kept of each tool.
KEPT = 5000
CALL = "event_id long, ts timestamp, duration_ms double, success boolean"


class LastCalls(StatefulProcessor):
    """A list of the last `most` calls of a tool, by time and identifier; what is older goes as new calls come in.

    Of a batch no more than `most` rows are held beside the state, however many calls of one tool it has. With a
    time to live calls also go when they haven't been written for so long.
    """

    def __init__(self, most: int = KEPT, ttl_ms: int | None = None) -> None:
        self.most, self.ttl_ms = most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.calls = handle.getListState("calls", CALL, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in CALL.split(", ")]
        held = pd.DataFrame([tuple(r) for r in self.calls.get()], columns=names)
        seen = 0
        for part in rows:
            seen += len(part)
            both = pd.concat([held, part[names]], ignore_index=True) if len(held) else part[names]
            held = both.sort_values(["ts", "event_id"], ascending=False, kind="stable").head(self.most)
        self.calls.put([(int(i), t.to_pydatetime(), None if pd.isna(v) else float(v), bool(ok)) for i, t, v, ok in held.itertuples(index=False)])
        yield pd.DataFrame({"tool": [key[0]], "seen": [seen], "kept": [len(held)], "oldest": [held["ts"].min()], "newest": [held["ts"].max()]})

    def close(self) -> None:
        pass


def last_calls(usage: DataFrame, most: int = KEPT, ttl_ms: int | None = None) -> DataFrame:
    """tool, seen, kept, oldest, newest of each batch's tools; the calls themselves are state, which kept_calls() reads.

    usage: tool, event_id, ts, duration_ms, success; rows without ts, identifier or success are left out.
    """
    good = usage.where("ts IS NOT NULL AND event_id IS NOT NULL AND success IS NOT NULL")
    return good.groupBy("tool").transformWithStateInPandas(LastCalls(most, ttl_ms), "tool string, seen long, kept long, oldest timestamp, newest timestamp", "Update", "None" if ttl_ms is None else "ProcessingTime")


def kept_calls(spark: SparkSession, checkpoint: str) -> DataFrame:
    """tool and CALL of the state that a stream of last_calls() left at a checkpoint."""
    state = spark.read.format("statestore").option("stateVarName", "calls").load(checkpoint)
    return state.select("key.tool", "list_element.*")


class Expiring(StatefulProcessor):
    """A cache entry for each key, set by a miss and gone `ttl_ms` after that; hits don't prolong it.

    Time is that of the events. A timer removes the entry of a key that isn't asked for again.
    """

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.since = handle.getValueState("since", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows), ignore_index=True).sort_values(["at", "event_id"], kind="stable")
        since = self.since.get()[0] if self.since.exists() else None
        first, hits = since, []
        for at in given["at"].tolist():
            hits.append(since is not None and at - since <= self.ttl_ms)
            if not hits[-1]:
                since = at
        if since != first:
            if first is not None:
                self.handle.deleteTimer(first + self.ttl_ms + 1)
            self.since.update((since,))
            self.handle.registerTimer(since + self.ttl_ms + 1)
        yield pd.DataFrame({"event_id": given["event_id"], "key": key[0], "hit": hits})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.since.clear()
        return iter(())

    def close(self) -> None:
        pass


def cache_hits(asked: DataFrame, ttl_ms: int = 60_000, late: str = "0 seconds") -> DataFrame:
    """event_id, key, hit of requests (event_id, key, ts): a hit if the key's last miss is at most ttl_ms ago.

    Requests of one batch are taken in order of time; those behind the watermark are left out, as are rows with nulls.
    """
    good = asked.where("event_id IS NOT NULL AND key IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late).withColumn("at", F.unix_millis("ts"))
    return good.groupBy("key").transformWithStateInPandas(Expiring(ttl_ms), "event_id long, key string, hit boolean", "Append", "EventTime")


def followed_by(first: DataFrame, then: DataFrame, within: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """user_id, first_id, first_ts, then_id, then_ts: each event of `then` with the events of `first` of the same user that
    came at most `within` before it. Both sides: user_id, event_id, ts.

    As streams both sides are state until the watermark, `late` behind the newest event, says that no partner can come
    any more; rows behind the watermark are left out. As tables it is the same join of all rows.
    """
    a = first.select(F.col("user_id"), F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts")).withWatermark("first_ts", late)
    b = then.select(F.col("user_id").alias("_user"), F.col("event_id").alias("then_id"), F.col("ts").alias("then_ts")).withWatermark("then_ts", late)
    near = (F.col("user_id") == F.col("_user")) & (F.col("then_ts") >= F.col("first_ts")) & (F.col("then_ts") <= F.col("first_ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, near).drop("_user")


def finished(stream: DataFrame, name: str, mode: str = "append", timed: bool = False) -> tuple[DataFrame, str]:
    """(rows, checkpoint): all that is there now through a Parquet sink in the shared folder; update mode is written batch by batch.

    timed: the stream has processing time of its own, so it never runs out of batches and is stopped when all input is done.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/textquarry/{name}"
    out, checkpoint = f"{folder}/rows", f"{folder}/checkpoint"
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        writer = writer if timed else writer.trigger(availableNow=True)
        if mode == "append":
            query = writer.format("parquet").start(out)
        else:
            query = writer.foreachBatch(lambda rows, k: rows.write.mode("overwrite").parquet(f"{out}/batch={k}")).start()
        if timed:
            while query.isActive and (query.lastProgress is None or query.lastProgress["numInputRows"]):
                time.sleep(0.2)  # a batch without input follows the last one with any
            query.stop()
        else:
            query.awaitTermination()
    finally:
        spark.conf.set(STORE[0], before) if before else spark.conf.unset(STORE[0])
    return spark.read.schema(stream.schema).parquet(out), checkpoint
