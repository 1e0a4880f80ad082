"""Streaming forms of the operational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprism.operators.evaluate import histogram


def tumbling(events: DataFrame, ts: str = "ts", width: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Events in each tumbling window; with a watermark where the input is a stream."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def latency(events: DataFrame, bounds: list[float], route: str = "event_type", value: str = "value") -> DataFrame:
    """Cumulative latency buckets by route, for a batch or a stream (complete output)."""
    return histogram(events, value, [route], bounds)


#: First and longest wait in seconds, and the count at which failures saturate.
FIRST_WAIT, LONGEST_WAIT, MOST_FAILURES = 5, 60, 5


def wait(failures):
    """Seconds to wait after so many failures in a row: doubled each time up to the longest; none without a failure."""
    return F.when(failures > 0, F.least(F.lit(LONGEST_WAIT), FIRST_WAIT * F.pow(F.lit(2), failures - 1))).otherwise(0).cast("long")


def backoff(events: DataFrame, worker: str, order: list[str], failed: str) -> DataFrame:
    """State of each worker after its last event, of a batch: ``failures`` in a row, ``wait`` and the time ``since`` which it counts.

    ``order``: the time and what breaks its ties.  ``failed``: boolean; null
    rows say nothing.  Two aggregations in place of a window, as one worker may
    have most of the events: the last success, then the failures after it.
    """
    rows = events.where(F.col(failed).isNotNull()).select(worker, F.struct(*order).alias("_at"), F.col(failed).alias("_failed"))
    last = rows.groupBy(worker).agg(F.max(F.when(~F.col("_failed"), F.col("_at"))).alias("_last"))
    after = rows.join(last.withColumnRenamed(worker, "_w"), F.col(worker).eqNullSafe(F.col("_w")))
    after = after.withColumn("_counts", F.col("_failed") & (F.col("_last").isNull() | (F.col("_at") > F.col("_last"))))
    out = after.groupBy(worker).agg(F.least(F.count_if("_counts"), F.lit(MOST_FAILURES)).alias("failures"), F.max(F.when(F.col("_counts"), F.col(f"_at.{order[0]}"))).alias("since"))
    return out.select(worker, "failures", wait(F.col("failures")).alias("wait"), "since")


def backoff_stream(events: DataFrame, worker: str, order: list[str], failed: str) -> DataFrame:
    """The same state from a stream, a row a worker whenever new events come; it holds one small count a worker.

    Events within a micro-batch are taken in order; an event older than the state's last one is late and left out.
    """
    import pandas as pd

    def step(key, batches, state):
        n, since, upto = state.get if state.exists else (0, None, None)
        for batch in batches:
            batch = batch[batch["_failed"].notna()].sort_values(order)
            for at, bad in zip(batch[order[0]], batch["_failed"]):
                if upto is not None and at.value < upto:
                    continue
                n, since, upto = (min(n + 1, MOST_FAILURES), at.value, at.value) if bad else (0, None, at.value)
        state.update((n, since, upto))
        pause = min(LONGEST_WAIT, FIRST_WAIT * 2 ** (n - 1)) if n else 0
        yield pd.DataFrame({worker: [key[0]], "failures": [n], "wait": [pause], "since": [pd.Timestamp(since) if since is not None else pd.NaT]})

    kind = events.schema[worker].dataType.simpleString()
    rows = events.select(worker, *order, F.col(failed).alias("_failed"))
    return rows.groupBy(worker).applyInPandasWithState(
        step, f"{worker} {kind}, failures long, wait long, since timestamp", "n int, since long, upto long", "update", "NoTimeout",
    )


def backoff_timed(events: DataFrame, worker: str, order: list[str], failed: str, late: str = "10 minutes", idle: str = "1 day") -> DataFrame:
    """The state of :func:`backoff` from a stream, whatever the order in which its events come.

    Events wait in the state until the watermark passes them, at ``late`` behind the
    newest one; a timer then takes them in the order of time and ties, and a row of
    the worker's state comes out.  A worker without an event for ``idle`` is
    forgotten: its next failure is its first.  Null ``failed`` says nothing.  Needs
    the RocksDB state store.
    """
    import pandas as pd
    from pyspark.sql import types as T
    from pyspark.sql.streaming import StatefulProcessor

    if "RocksDB" not in events.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        raise ValueError("set spark.sql.streaming.stateStore.providerClass to the RocksDB provider")
    rest = int(pd.Timedelta(idle).total_seconds() * 1000)
    kinds = [events.schema[c].dataType.simpleString() for c in order[1:]]
    pending = ", ".join(["at long", *(f"k{i} {kind}" for i, kind in enumerate(kinds)), "failed boolean"])

    class Waits(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.pending = handle.getListState("pending", pending)
            self.state = handle.getValueState("state", "n int, since long, upto long")

        def handleInputRows(self, key, rows, timerValues):
            for batch in rows:
                batch = batch[batch["is_failed"].notna()]
                at = batch[order[0]].astype("datetime64[us]").astype("int64").tolist()
                held = list(zip(at, *(batch[c].tolist() for c in order[1:]), batch["is_failed"].astype(bool).tolist()))
                if held:
                    self.pending.appendList(held)
                    for ms in {-(-t // 1000) for t in at}:
                        self.handle.registerTimer(ms)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            upto = timerValues.getCurrentWatermarkInMs() * 1000
            held = sorted(self.pending.get())
            n, since, last = self.state.get() if self.state.exists() else (0, None, None)
            ready = [e for e in held if e[0] <= upto]
            if not ready:  # a timer of events that are taken already, or the idle one
                if not held and last is not None and last + rest * 1000 <= upto:
                    self.state.clear()
                return
            for at, *_, bad in ready:
                n, since, last = (min(n + 1, MOST_FAILURES), at, at) if bad else (0, None, at)
            self.pending.put(held[len(ready) :]) if len(held) > len(ready) else self.pending.clear()
            self.state.update((n, since, last))
            self.handle.registerTimer(last // 1000 + 1 + rest)
            pause = min(LONGEST_WAIT, FIRST_WAIT * 2 ** (n - 1)) if n else 0
            yield pd.DataFrame({worker: [key[0]], "failures": [n], "wait": [pause], "since": [pd.Timestamp(since, unit="us") if since is not None else pd.NaT]})

        def close(self):
            pass

    out = T.StructType([T.StructField(worker, events.schema[worker].dataType), T.StructField("failures", T.LongType()), T.StructField("wait", T.LongType()), T.StructField("since", T.TimestampType())])
    rows = events.withWatermark(order[0], late).select(worker, *order, F.col(failed).alias("is_failed"))
    return rows.groupBy(worker).transformWithStateInPandas(Waits(), out, "Update", "EventTime")
