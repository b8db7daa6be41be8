"""Status of runs from an event stream (ts, event_id, task, realization, event)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from varigrid.operators.variants import VariantFrame, vjoin_new

STATES = {"begin": "running", "fail": "failed", "succeed": "completed", "skip": "completed"}


def live_status(events: DataFrame) -> DataFrame:
    """Last status of each result, batch or stream (update or complete mode); ties of ts go to the larger event_id.

    State holds one row per result and never expires; put a watermark on ts and filter before, where results come without end.
    """
    state = F.create_map(*(F.lit(x) for kv in STATES.items() for x in kv))[F.col("event")]
    return events.where(state.isNotNull()).groupBy("task", "realization").agg(F.max_by(state, F.struct("ts", "event_id")).alias("status"))


#: Keys of a stateful stream are dealt to so many buckets; a checkpoint holds for one number of them.
BUCKETS = 1024


def _packed(df: pd.DataFrame, schema: pa.Schema) -> tuple[bytes]:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
        w.write_table(pa.Table.from_pandas(df, schema, preserve_index=False))
    return (out.getvalue().to_pybytes(),)


def _unpacked(state) -> pd.DataFrame | None:
    return pa.ipc.open_stream(state.get()[0]).read_pandas() if state.exists() else None


class _Latest(StatefulProcessor):
    """The last status of each result of a bucket, as one table: a call for each result, and a trip to the store for each value, took milliseconds a result."""

    schema = pa.schema([("task", pa.string()), ("realization", pa.string()), ("at", pa.int64()), ("event_id", pa.int64()), ("status", pa.string())])

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "rows binary")

    def _keep(self, rows: pd.DataFrame, watermark: int) -> None:
        """Rows whose time has not passed, and a timer at the first that will pass."""
        until = rows["at"] // 1000 + self.keep_ms
        rows, until = rows[until > watermark], until[until > watermark]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if len(rows):
            self.handle.registerTimer(int(until.min()))
            self.last.update(_packed(rows, self.schema))
        else:
            self.last.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = pd.concat([r[self.schema.names] for r in rows], ignore_index=True).assign(new=True)
        before = _unpacked(self.last)
        # The rows before come last, so that of equal ones those stay.
        both = new if before is None else pd.concat([new, before.assign(new=False)], ignore_index=True)
        best = both.sort_values(["at", "event_id"], kind="stable").drop_duplicates(["task", "realization"], keep="last")
        changed = best[best["new"]]
        if len(changed):
            self._keep(best[self.schema.names], timer.getCurrentWatermarkInMs())
            yield changed[self.schema.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        before = _unpacked(self.last)
        if before is not None:
            self._keep(before, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


def live_status_changes(events: DataFrame, late: str, keep_seconds: int, buckets: int = BUCKETS) -> DataFrame:
    """A stream of changes of results' last statuses: task, realization, at (microseconds), event_id, status; for a result the last in (at, event_id) holds.

    Events that come more than ``late`` (an interval of time) after later ones are not taken in. An event that is late within it changes nothing if its result has had a
    later one. A result's state goes when ``keep_seconds`` of event time have passed since its last event, so that results without end
    do not fill the store. Longer than ``late`` it has to be kept, or a late event could set an older status; shorter times are an error.
    A batch reads and writes the state of the ``buckets`` that it has events of; a checkpoint holds for one number of them.
    """
    if keep_seconds < events.sparkSession.sql(f"SELECT unix_seconds(timestamp_seconds(0) + INTERVAL {late}) AS s").first().s:
        raise ValueError("state must be kept for as long as events may be late")
    state = F.create_map(*(F.lit(x) for kv in STATES.items() for x in kv))[F.col("event")]
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).where(state.isNotNull()).select("task", "realization", "ts", F.unix_micros("ts").alias("at"), "event_id", state.alias("status"))
    schema = "task string, realization string, at long, event_id long, status string"
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("task", "realization"), F.lit(buckets)))
    return dealt.groupBy("bucket").transformWithStateInPandas(_Latest(keep_seconds * 1000), schema, "Update", "EventTime")


def display_status(flags: Column) -> Column:
    """completed over running over failed over other, of an array of statuses."""
    return F.when(F.array_contains(flags, "completed"), "completed").when(F.array_contains(flags, "running"), "running").when(F.array_contains(flags, "failed"), "failed").otherwise("other")


def ready_batch(done: DataFrame, edges: DataFrame, block_on_failure: bool = True) -> DataFrame:
    """Children of which all parents are completed; with ``block_on_failure`` none failed. done has parent, status."""
    rows = edges.select("parent", "child").distinct().join(done, "parent", "left")
    ok = F.every(F.coalesce(F.col("status").isin("completed", *([] if block_on_failure else ["failed"])), F.lit(False)))
    return rows.groupBy("child").agg(ok.alias("ok"), F.count(F.lit(1)).alias("n_parents")).where("ok").select("child", "n_parents")


class _Gate(StatefulProcessor):
    """The parents' last statuses of each child of a bucket that is not sent yet, and the sent children (without parent and status), as one table."""

    schema = pa.schema([("child", pa.string()), ("parent", pa.string()), ("status", pa.string())])

    def __init__(self, block: bool) -> None:
        self.block = block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("parents", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")
        before = _unpacked(self.state)
        both = new[self.schema.names]
        if before is not None:
            sent = before["parent"].isna()
            new = new[~new["child"].isin(before["child"][sent])]
            if new.empty:
                return
            both = pd.concat([before, new[self.schema.names]], ignore_index=True)
        both = both.drop_duplicates(["child", "parent"], keep="last")
        done = both["status"].isin(["completed"] if self.block else ["completed", "failed"])
        n_done = done.groupby(both["child"]).sum()
        need = new.drop_duplicates("child", keep="last").set_index("child")["n_parents"]
        ready = need[n_done.reindex(need.index) == need]
        open_ = both[~both["child"].isin(ready.index)]
        sent_now = pd.DataFrame({"child": ready.index, "parent": None, "status": None})
        self.state.update(_packed(pd.concat([open_, sent_now], ignore_index=True), self.schema))
        if len(ready):
            yield ready.rename_axis("child").reset_index()[["child", "n_parents"]]

    def close(self) -> None:
        pass


def with_need(edges: DataFrame) -> DataFrame:
    """The distinct edges with ``n_parents``, the number of parents of their child."""
    e = edges.select("parent", "child").distinct()
    return e.join(e.groupBy("child").agg(F.count(F.lit(1)).alias("n_parents")), "child")


def ready(events: DataFrame, edges: DataFrame, block_on_failure: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """Stream of children, each sent once, when its last parent completes. events: ts, event_id, parent, status; edges is static.

    A failed parent holds its children back; a later success lets them go. edges from ``with_need``, stored, are not counted again in each batch.
    A batch reads and writes the state of the ``buckets`` that it has events of; a checkpoint holds for one number of them.
    """
    need = edges if "n_parents" in edges.columns else with_need(edges)
    rows = events.join(need, "parent").select("child", "parent", "status", "n_parents", "ts", "event_id")
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("child"), F.lit(buckets)))
    return dealt.groupBy("bucket").transformWithStateInPandas(_Gate(block_on_failure), "child string, n_parents long", "Append", "None")


@dataclass(frozen=True)
class Arrivals:
    """Rows of several parents that arrive in batches, and the combinations that they make, each derived once, with the batch that completes it.

    parents: for each parent what takes its rows from a batch. What has arrived and what is derived are tables below ``path``, with a folder for each
    batch. A batch that is run again after a failure sees the batches before it alone and replaces its own folders, so nothing is derived twice.
    """

    path: str
    parents: Mapping[str, Callable[[DataFrame], VariantFrame]]
    on: Sequence[str] = ()

    def add(self, rows: DataFrame, batch: int) -> None:
        """One batch; pass it to ``foreachBatch``."""
        old, new = [], []
        for name, take in self.parents.items():
            vf, place = take(rows), f"{self.path}/arrived/{name}"
            vf.df.write.mode("overwrite").parquet(f"{place}/batch={batch}")
            schema = StructType([*vf.df.schema.fields, StructField("batch", LongType())])
            arrived = rows.sparkSession.read.schema(schema).parquet(place)
            own = lambda test, vf=vf, arrived=arrived: replace(vf, df=arrived.where(test).drop("batch"))
            old.append(own(F.col("batch") < batch))
            new.append(own(F.col("batch") == batch))
        vjoin_new(old, new, self.on).df.write.mode("overwrite").parquet(f"{self.path}/derived/batch={batch}")

    def derived(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/derived")


def watch_files(spark: SparkSession, path: str, schema: str | StructType, fmt: str = "json", seconds: int = 15, glob: str = "*"):
    """A stream of new files whose names fit a glob, and the trigger to start it with."""
    return spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", glob).load(path), {"processingTime": f"{seconds} seconds"}
