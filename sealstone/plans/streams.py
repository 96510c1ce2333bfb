"""Streaming operators run to the end over a table, as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sealstone.plans.registry import query
from sealstone.sources.fixtures import read
from sealstone.sources.tables import shared_dir
from sealstone.streaming import gossip, operators


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark, d):
    counts = operators.windowed_counts(operators.table_stream(spark, f"{d}/events.parquet"), "ts", "event_type", "1 day", "30 days")
    return operators.drained(counts, "complete").select("event_type", F.col("start").cast("timestamp_ntz").alias("day") if dict(read(spark, d, "events").dtypes)["ts"] == "timestamp_ntz" else F.col("start").alias("day"), "n")


@query("SELECT DISTINCT user_id AS nonce FROM events")
def stream_replay_dedup(spark, d):
    """First uses, written as files with a checkpoint in the shared folder: results of any size."""
    s = operators.table_stream(spark, f"{d}/events.parquet").withColumn("nonce", F.col("user_id"))
    at = f"{shared_dir(spark)}/first-uses-{uuid.uuid4().hex}"
    return operators.stored(operators.first_uses(s, "ts", "nonce", "400 days").select("nonce"), f"{at}/out", f"{at}/checkpoint")


@query("SELECT user_id % 20 AS signer, event_type AS shard_id, max(event_id % 50) AS tree_size FROM events GROUP BY 1, 2")
def stream_latest_accepted(spark, d):
    s = operators.table_stream(spark, f"{d}/events.parquet").select((F.col("user_id") % 20).alias("signer"), F.col("event_type").alias("shard_id"), (F.col("event_id") % 50).alias("tree_size"))
    return operators.drained(operators.latest_accepted(s, ("signer", "shard_id"), "tree_size"), "complete")


@query("SELECT event_type, w AS start, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY]) AS w FROM events) GROUP BY 1, 2")
def stream_sliding_counts(spark, d):
    """Windows of two days, one every day."""
    counts = operators.windowed_counts(operators.table_stream(spark, f"{d}/events.parquet"), "ts", "event_type", "2 days", "400 days", "1 day")
    return operators.drained(counts, "complete").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH e AS (SELECT user_id % 20 AS user, ts FROM events), g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user ORDER BY ts) < INTERVAL 30 MINUTE AS joins FROM e),
    s AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY user ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user, k""")
def stream_session_counts(spark, d):
    """Runs of events with less than half an hour between."""
    s = operators.table_stream(spark, f"{d}/events.parquet").withColumn("user", F.col("user_id") % 20)
    counts = operators.session_counts(s, "ts", "user", "30 minutes", "400 days")
    return operators.drained(counts, "complete").select("user", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query()
def stream_accepted_in_order(spark, d):
    """Verdicts on gossiped sizes, by order of arrival."""
    size, k = F.col("event_id") % 50, F.col("event_id")
    s = operators.table_stream(spark, f"{d}/events.parquet").select((F.col("user_id") % 40).alias("signer"), size.alias("size"), F.concat(F.lit("r"), (size - F.when(k % 3 == 0, 2).otherwise(1)).cast("string")).alias("previous"), F.concat(F.lit("r"), size.cast("string")).alias("root"), k.alias("arrival"))
    at = f"{shared_dir(spark)}/accepted-{uuid.uuid4().hex}"
    return operators.stored(operators.accepted_in_order(s, "signer"), f"{at}/out", f"{at}/checkpoint")


@query()
def stream_judged(spark, d):
    """Verdicts on gossiped checkpoints of each (signer, scope, shard), with state that ends by timers and lies in RocksDB; results as files."""
    size, k = F.col("event_id") % 50, F.col("event_id")
    s = operators.table_stream(spark, f"{d}/events.parquet").select((F.col("user_id") % 40).alias("signer"), F.lit("shard").alias("scope"), F.col("event_type").alias("shard_id"), size.alias("size"), F.concat(F.lit("r"), (size - F.when(k % 3 == 0, 2).otherwise(1)).cast("string")).alias("previous"), F.concat(F.lit("r"), size.cast("string")).alias("root"), "ts", k.alias("arrival"))
    at = f"{shared_dir(spark)}/judged-{uuid.uuid4().hex}"
    return gossip.stored(gossip.judged(s, ["signer", "scope", "shard_id"], live=86_400_000, late="1 hour"), f"{at}/out", f"{at}/checkpoint")
