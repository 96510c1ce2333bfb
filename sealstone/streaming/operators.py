"""Structured Streaming forms: counts in windows (fixed, sliding, by session), replay dedup with a time to live, and what an identity is accepted with, in order of arrival."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream of its files; the schema is the table's."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if not path.endswith(".parquet") else path + "*")


def windowed_counts(stream: DataFrame, time: str, by: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Rows in each window of ``width``, one every ``slide`` (as wide, if not given). Rows later than ``late`` behind the newest are left out."""
    stamped = stream.withColumn(time, F.col(time).cast("timestamp"))
    return stamped.withWatermark(time, late).groupBy(F.window(time, width, slide), by).agg(F.count("*").alias("n")).select(by, F.col("window.start").alias("start"), "n")


def session_counts(stream: DataFrame, time: str, by: str, gap: str, late: str) -> DataFrame:
    """Rows in each run of rows of ``by`` with less than ``gap`` between neighbours."""
    stamped = stream.withColumn(time, F.col(time).cast("timestamp"))
    return stamped.withWatermark(time, late).groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_uses(stream: DataFrame, time: str, nonce: str, live: str) -> DataFrame:
    """The first row of each nonce; a nonce may come again after its time to live."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, live).dropDuplicatesWithinWatermark([nonce])


def latest_accepted(stream: DataFrame, by: tuple[str, ...], size: str) -> DataFrame:
    return stream.groupBy(*by).agg(F.max(size).alias(size))


ARRIVALS = "size long, previous string, root string, arrival long, verdict string"


def accepted_in_order(stream: DataFrame, identity: str, *, size: str = "size", root: str = "root", previous: str = "previous", arrival: str = "arrival") -> DataFrame:
    """Each row of an identity, in order of arrival, with a verdict against what was accepted before: (identity, size, previous, root, arrival, verdict).

    A row that appends one must name the last accepted root, else it is ``spliced``; one that is no larger than the last is ``stale``; larger jumps are ``accepted`` unlinked. Only accepted rows
    move the state, a size and a root. Within a batch rows are put in order; of one identity they share a task, which holds the batch's rows of it."""
    kind = dict(stream.dtypes)[identity]

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else None
        rows = pd.concat(list(batches)).sort_values("arrival", kind="stable")
        verdicts = []
        for n, prev, own in zip(rows["size"], rows["previous"], rows["root"], strict=True):
            verdict = "stale" if held and n <= held[0] else "spliced" if held and n == held[0] + 1 and prev != held[1] else "accepted"
            held = (int(n), own) if verdict == "accepted" else held
            verdicts.append(verdict)
        if held:
            state.update(held)
        yield pd.DataFrame({identity: [key[0]] * len(rows), **{c: rows[c].to_numpy() for c in ("size", "previous", "root", "arrival")}, "verdict": verdicts})

    named = stream.select(identity, F.col(size).cast("long").alias("size"), F.col(previous).cast("string").alias("previous"), F.col(root).cast("string").alias("root"), F.col(arrival).cast("long").alias("arrival"))
    return named.groupBy(identity).applyInPandasWithState(judge, f"{identity} {kind}, {ARRIVALS}", "size long, root string", "append", GroupStateTimeout.NoTimeout)


def stored(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Everything the stream gives until its input is used up, as Parquet files in a shared folder, for results of any size (append mode)."""
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Everything the stream gives until its input is used up, as a table in memory: for small results."""
    name = f"drained_{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
