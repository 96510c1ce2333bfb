"""What a ledger accepts of gossiped checkpoints, judged in order with state in the state store: timers, a time to live, and late rows as verdicts of their own.

State lies in RocksDB on the executors and in the stream's checkpoint, so it may be larger than memory, and a lost executor loses none of it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "size long, previous string, root string, seen long, arrival long, verdict string"


class Judge(StatefulProcessor):
    """State of an identity: the size and root accepted last, and until when they hold (milliseconds). It ends by a timer, so identities that fall silent are forgotten."""

    def __init__(self, identity: list[str], live: int) -> None:
        self.identity, self.live = identity, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "size long, root string, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        own = pd.concat(list(rows)).sort_values(["arrival"], kind="stable")
        held = tuple(self.held.get()) if self.held.exists() else None
        was, verdicts = held, []
        if held and held[2] <= mark:  # its timer is due in this batch
            held = None
        for size, previous, root, seen in zip(own["size"], own["previous"], own["root"], own["seen"], strict=True):
            if seen < mark:
                verdicts.append("late")
                continue
            if held and held[2] <= seen:
                held = None
            verdict = "stale" if held and size <= held[0] else "spliced" if held and size == held[0] + 1 and previous != held[1] else "accepted"
            held = (int(size), root, int(seen) + self.live) if verdict == "accepted" else held
            verdicts.append(verdict)
        if held != was:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if held:
                self.held.update(held)
                self.handle.registerTimer(held[2])
            else:
                self.held.clear()
        named = {c: [k] * len(own) for c, k in zip(self.identity, key if isinstance(key, tuple) else (key,), strict=True)}
        yield pd.DataFrame({**named, **{c: own[c].to_numpy() for c in ("size", "previous", "root", "seen", "arrival")}, "verdict": verdicts})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists() and self.held.get()[2] <= timerValues.getCurrentWatermarkInMs():
            self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def judged(stream: DataFrame, identity: list[str], *, live: int, late: str, size: str = "size", root: str = "root", previous: str = "previous", time: str = "ts", arrival: str = "arrival") -> DataFrame:
    """Each row of an identity (columns) with a verdict, in order of arrival within a batch: (identity, size, previous, root, seen in milliseconds, arrival, verdict).

    ``late``: it is older than the newest row of earlier batches by more than that; it is judged by nothing else. ``spliced``: it appends one and does not name the root accepted last. ``stale``: it is no larger than that.
    Else ``accepted``: size and root become the identity's, for ``live`` milliseconds of event time; after that, and at first, any is accepted. Rows of one identity and batch share a task."""
    named = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    # The time goes along as a number, so that late rows come through to be judged.
    seen = F.unix_millis(F.col(time)).alias("seen")
    kinds = dict(stream.dtypes)
    rows = named.select(*identity, F.col(size).cast("long").alias("size"), F.col(previous).cast("string").alias("previous"), F.col(root).cast("string").alias("root"), seen, F.col(arrival).cast("long").alias("arrival"))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in identity) + f", {OUT}"
    return rows.groupBy(*identity).transformWithStateInPandas(Judge(identity, live), schema, "append", "eventtime")


def stored(stream: DataFrame, path: str, checkpoint: str, **options: str) -> DataFrame:
    """What the stream gives until its input is used up, as Parquet files in a shared folder; its state lies in RocksDB. May be called again with the same checkpoint when there is more input."""
    conf = stream.sparkSession.conf
    before = conf.get(*PROVIDER[:1], None)
    conf.set(*PROVIDER)
    try:
        q = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).start()
    finally:
        conf.set(PROVIDER[0], before) if before else conf.unset(PROVIDER[0])
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
