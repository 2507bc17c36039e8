"""Sessions whose state lives until some time after their last update (arbitrary stateful processing)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestone.streaming.counters import event_stream

#: Hours that a session's state outlives its last event.
HOURS = 24
#: Groups that users are dealt to by hash, each with one state; a checkpoint keeps their number.
BUCKETS = 4096
#: Events that a task holds at a time.
HELD = 1 << 21
#: What transformWithState keeps its state in.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _pieces(hours: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of events (user_id, at, value), pieces of sessions (user_id, first, last, n, total): a user's events without a longer gap."""
    gap = int(hours * 3_600_000_000)

    def cut(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches)
        known, user = rows["user_id"].is_valid().to_numpy(), rows["user_id"].fill_null(0).to_numpy()
        at, value, valid = rows["at"].to_numpy(), rows["value"].fill_null(0).to_numpy(), rows["value"].is_valid().to_numpy()
        order = np.lexsort((value, at, user, known))
        known, user, at, value, valid = known[order], user[order], at[order], value[order], valid[order]
        begins = np.flatnonzero(np.r_[True, (known[1:] != known[:-1]) | (user[1:] != user[:-1]) | (at[1:] - at[:-1] > gap)])
        ends = np.r_[begins[1:], len(at)]
        columns = [pa.array(user[begins], mask=~known[begins]), at[begins], at[ends - 1], ends - begins, pa.array(np.add.reduceat(value, begins), mask=~np.logical_or.reduceat(valid, begins))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["user_id", "first", "last", "n", "total"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= HELD:
                yield cut(held)
                held, size = [], 0
        if held:
            yield cut(held)

    return pieces


class _Sessions(StatefulProcessor):
    """The open sessions of a bucket of users, and a timer at the first of their ends; every update moves its session's end on.

    Each call of the state is a message, so a bucket is read and written as a whole.
    """

    def __init__(self, hours: float):
        self.gap = int(hours * 3_600_000_000)

    def _ends(self, held: dict) -> int | None:
        """When the first session ends, in milliseconds; events are in microseconds."""
        return min((last + self.gap) // 1000 for _, last, _, _ in held.values()) if held else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("sessions", "user_id bigint, first bigint, last bigint, n bigint, total double")

    def _held(self) -> dict:
        return {user: tuple(own) for user, *own in list(self.state.get())}

    def _closed(self, user: int | None, own: tuple) -> Row:
        return Row(user_id=user, first=own[0], last=own[1], n=own[2], total=own[3])

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803 - names of the interface
        held = self._held()
        before = self._ends(held)
        # the pieces of a bucket's sessions in one micro-batch, whose size the trigger bounds
        for user, first, last, n, total in sorted(((r["user_id"], r["first"], r["last"], r["n"], r["total"]) for r in rows), key=lambda p: p[1:4]):
            own = held.get(user)
            if own is not None and first - own[1] > self.gap:
                yield self._closed(user, own)
                own = None
            held[user] = (first, last, n, total) if own is None else (min(first, own[0]), max(last, own[1]), own[2] + n, own[3] if total is None else total + (own[3] or 0.0))
        self.state.put([(user, *own) for user, own in held.items()])
        ends = self._ends(held)
        if ends != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(ends)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803 - names of the interface
        held, now = self._held(), timerValues.getCurrentWatermarkInMs()
        left = {user: own for user, own in held.items() if (own[1] + self.gap) // 1000 >= now}
        for user in held.keys() - left.keys():
            yield self._closed(user, held[user])
        if not left:
            self.state.clear()
            return
        if len(left) < len(held):
            self.state.put([(user, *own) for user, own in left.items()])
        # the timer that fires is deleted after this call
        self.handle.registerTimer(max(self._ends(left), expiredTimerInfo.getExpiryTimeInMs() + 1))

    def close(self) -> None:
        pass


def closed_sessions(events: DataFrame, hours: float = HOURS, late: str = "0 seconds") -> DataFrame:
    """(user_id, first, last, n, total) of each session that has ended: no event of the user for more than ``hours`` after the last.

    Every event refreshes its session's time to live, which is event time. A
    session is emitted once, when a later event or the watermark shows that it
    has ended, and its state goes. A null value counts 0, and a session of nulls has
    a null total; events without a time are dropped. A user's events of one micro-batch are joined to pieces of
    sessions first, and the state, which is that of a bucket of users, sees the
    pieces; those whose last event is later than ``late`` are dropped.
    """
    rows = events.where("ts IS NOT NULL").select("user_id", F.unix_micros("ts").alias("at"), F.col("value").cast("double").alias("value"))
    pieces = rows.repartition("user_id").mapInArrow(_pieces(hours), "user_id bigint, first bigint, last bigint, n bigint, total double")
    pieces = pieces.withColumn("ts", F.timestamp_micros("last")).withWatermark("ts", late)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)))
    made = pieces.groupBy("bucket").transformWithState(_Sessions(hours), "user_id bigint, first bigint, last bigint, n bigint, total double", "Append", "EventTime")
    return made.select("user_id", F.timestamp_micros("first").alias("first"), F.timestamp_micros("last").alias("last"), "n", "total")


def replay(spark: SparkSession, folder: str, home: str, name: str = "events.parquet", hours: float = HOURS) -> None:
    """Run ``closed_sessions`` over the files there are now, after those that earlier calls have seen; batches go to ``home``/out.

    State and progress are kept below ``home``, so a call goes on where the one before ended, in another process too.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{home}/out/batch={batch}")

    stream = closed_sessions(event_stream(spark, folder, name), hours)
    stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{home}/at").trigger(availableNow=True).start().awaitTermination()


def sessions_of(spark: SparkSession, home: str) -> DataFrame:
    """The sessions that calls of ``replay`` have emitted so far."""
    return spark.read.schema("user_id bigint, first timestamp, last timestamp, n bigint, total double").parquet(f"{home}/out").drop("batch")
