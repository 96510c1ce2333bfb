"""Ledger analytics: forks, publication delay, quorums, trust windows, queues, summaries.

Every predicate on time takes the moment as an argument. Signatures are not verified here: ``verified`` and ``valid`` are input columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MERGE_DELAY, MERGE_DELAY_LEAST = 86_400, 60
#: Seconds of a range of a key, where windows are counted.
RANGE = 7 * 86_400
#: Arrivals of a range of an identity.
ARRIVALS = 65_536


def equivocations(checkpoints: DataFrame, *, identity: tuple[str, ...] = ("signer", "scope", "shard_id"), root: str = "ledger_root") -> DataFrame:
    """All rows with ``equivocates``: verified, and another verified row of the identity has another root for the same timestamp or the same size.

    Two groupings joined back; no self-join, so a hot identity costs its rows, not their square."""
    good = checkpoints.filter("verified")

    def forked(by: str) -> DataFrame:
        return good.groupBy(*identity, by).agg(F.min(root).alias("lo"), F.max(root).alias("hi")).filter("lo <> hi").select(*identity, by, F.lit(True).alias(f"fork_{by}"))

    both = checkpoints.join(forked("checkpoint_timestamp"), [*identity, "checkpoint_timestamp"], "left").join(forked("tree_size"), [*identity, "tree_size"], "left")
    flag = F.col("verified") & (F.col("fork_checkpoint_timestamp").isNotNull() | F.col("fork_tree_size").isNotNull())
    return both.select(*checkpoints.columns, F.coalesce(flag, F.lit(False)).alias("equivocates"))


def equivocating_identities(flagged: DataFrame, identity: tuple[str, ...] = ("signer", "scope")) -> DataFrame:
    """Number of distinct identities with a flagged row."""
    return flagged.filter("equivocates").agg(F.countDistinct(*identity).alias("n_identities"))


def auto_block(peers: DataFrame, flagged: DataFrame, key: str = "signer") -> DataFrame:
    """Peers with ``blocked``: whether any of their checkpoints equivocates."""
    bad = flagged.filter("equivocates").select(key).distinct().withColumn("bad", F.lit(True))
    return peers.join(bad, key, "left").withColumn("blocked", F.col("bad").isNotNull()).drop("bad")


def first_covering(records: DataFrame, checkpoints: DataFrame, *, shard: str = "shard_id") -> DataFrame:
    """Each record with the earliest-published checkpoint (``cp_ts``, ``cp_id``) of its shard whose tree holds it; null if none does.

    Checkpoints and records of a shard in one order of size, largest first: the running minimum of (time, id) is the answer. A sort, no range join.
    Shards are split by size ranges, whose minima are carried over, so a hot shard is not one task."""
    kinds = dict(records.dtypes)
    blank = [F.lit(None).cast(kinds[c]).alias(c) for c in records.columns if c != shard]
    cp = checkpoints.select(F.col(shard), *blank, F.col("tree_size").alias("size_"), F.lit(0).alias("is_record"), F.struct(F.col("checkpoint_timestamp").alias("ts_"), F.col("id").alias("id_")).alias("cp_"))
    rec = records.select(F.col(shard), *(F.col(c) for c in records.columns if c != shard), F.col("snapshot_size").alias("size_"), F.lit(1).alias("is_record"), F.lit(None).cast("struct<ts_: bigint, id_: bigint>").alias("cp_"))
    rows = cp.unionByName(rec).withColumn("range_", F.floor(F.col("size_") / F.lit(65536)))
    ahead = Window.partitionBy(shard).orderBy(F.desc("range_")).rowsBetween(Window.unboundedPreceding, -1)
    above = rows.filter("is_record = 0").groupBy(shard, "range_").agg(F.min("cp_").alias("own_"))
    # Ranges of a shard that hold rows, with the minimum of all ranges above.
    spans = rows.select(shard, "range_").distinct().join(above, [shard, "range_"], "left").withColumn("above_", F.min("own_").over(ahead)).drop("own_")
    within = Window.partitionBy(shard, "range_").orderBy(F.desc("size_"), "is_record").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = rows.withColumn("best_", F.min("cp_").over(within)).filter("is_record = 1").join(spans, [shard, "range_"], "left")
    first = F.coalesce(F.least("best_", "above_"), F.col("best_"), F.col("above_"))
    return best.withColumn("first_", first).select(*records.columns, F.col("first_.ts_").alias("cp_ts"), F.col("first_.id_").alias("cp_id"))


def merge_delay(covered: DataFrame, as_of: int, delay: int = MERGE_DELAY) -> DataFrame:
    """``first_covering`` rows with ``elapsed`` and ``status``; the bound is inclusive, and no delay is below zero."""
    most = max(delay, MERGE_DELAY_LEAST)
    elapsed = F.greatest(F.coalesce("cp_ts", F.lit(as_of)) - F.col("ts"), F.lit(0))
    within = F.col("elapsed") <= most
    status = F.when(F.col("cp_ts").isNotNull(), F.when(within, "within").otherwise("breach")).otherwise(F.when(within, "pending").otherwise("pending-breach"))
    return covered.withColumn("elapsed", elapsed).withColumn("status", status)


def quorum(cosignatures: DataFrame, eligible: DataFrame, threshold: int) -> DataFrame:
    """Per checkpoint the number of distinct eligible signers with a valid signature, and whether it reaches the threshold (1 at least)."""
    ok = cosignatures.filter("valid").join(eligible, "signer", "left_semi").groupBy("checkpoint_id").agg(F.countDistinct("signer").alias("n_signers"))
    n = F.coalesce("n_signers", F.lit(0)).cast("long")
    return cosignatures.select("checkpoint_id").distinct().join(ok, "checkpoint_id", "left").select("checkpoint_id", n.alias("n_signers"), (F.lit(threshold >= 1) & (n >= threshold)).alias("reached"))


def issuer_anchored(sets: DataFrame, cosignatures: DataFrame) -> DataFrame:
    """``sets(checkpoint_id, issuer, signers array)`` with ``anchored``: the issuer is the first pinned signer and has signed."""
    signed = cosignatures.filter("valid").select("checkpoint_id", F.col("signer").alias("issuer")).distinct().withColumn("signed", F.lit(True))
    first = F.try_element_at("signers", F.lit(1)) == F.col("issuer")
    return sets.join(signed, ["checkpoint_id", "issuer"], "left").withColumn("anchored", F.coalesce(first & F.col("signed"), F.lit(False))).drop("signed")


def trusted_at(rows: DataFrame, windows: DataFrame, *, at: str = "ts", closed: bool = False, width: int = RANGE) -> DataFrame:
    """Rows with ``trusted``: a window of their (signer, role) holds at their time. Half-open, or with ``closed`` the end included; a null end is open. Null signers, roles and times are trusted by none.

    A sweep: starts, ends and moments of a key in one order, and the number of open windows as a running count, within ranges of ``width`` seconds and carried over them.
    So a key costs its windows and moments, not their product, and a hot one is as many tasks as it has ranges."""
    by, kinds = ["signer", "role"], dict(rows.dtypes)
    held = windows.filter(F.col("signer").isNotNull() & F.col("role").isNotNull() & F.col("valid_from").isNotNull())
    held = held.filter(F.col("valid_until").isNull() | ((F.col("valid_from") <= F.col("valid_until")) if closed else (F.col("valid_from") < F.col("valid_until"))))
    # At one time windows start first; they end before a moment, or behind it if their end is included.
    mark = lambda time, turn, step: held.select(*by, F.col(time).cast(kinds[at]).alias("time_"), F.lit(turn).alias("turn_"), F.lit(step).cast("long").alias("step_"))
    marks = mark("valid_from", 0, 1).union(mark("valid_until", 2 if closed else 0, -1).filter("time_ is not null"))
    blank = [F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c not in by]
    moments = rows.withColumns({"time_": F.col(at), "turn_": F.lit(1), "step_": F.lit(0).cast("long")})
    every = marks.select(*marks.columns, *blank).unionByName(moments).withColumn("range_", F.floor(F.col("time_") / F.lit(width)))
    spans = every.groupBy(*by, "range_").agg(F.sum("step_").alias("own_"))
    ahead = Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("open_", F.coalesce(F.sum("own_").over(ahead), F.lit(0))).select(*(F.col(c).alias(f"{c}_of") for c in (*by, "range_")), "open_")
    within = Window.partitionBy(*by, "range_").orderBy("time_", "turn_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = every.withColumn("inside_", F.sum("step_").over(within)).filter("turn_ = 1")
    same = F.lit(True)
    for c in (*by, "range_"):
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of"))
    told = counted.join(spans, same, "left")
    trusted = F.coalesce((F.col("inside_") + F.col("open_") > 0) & F.col(at).isNotNull(), F.lit(False))
    return told.select(*rows.columns, trusted.alias("trusted"))


def freshness(snapshots: DataFrame, as_of: int, *, skew: int = 300, max_age: int | None = 7 * 86400, max_lifetime: int | None = 30 * 86400) -> DataFrame:
    """Snapshots (issued_at, expires_at) with the first rule they break, in fixed order, or ``fresh``. The clock skew is granted to the issue time alone."""
    issued, expires = F.col("issued_at"), F.col("expires_at")
    rules = [("future-dated", F.lit(as_of) < issued - skew), ("expired", F.lit(as_of) >= expires)]
    rules += [("too-old", F.lit(as_of) - issued > max_age)] if max_age is not None else []
    rules += [("lifetime-too-long", expires - issued > max_lifetime)] if max_lifetime is not None else []
    out = F.lit("fresh")
    for name, broken in reversed(rules):
        out = F.when(broken, name).otherwise(out)
    return snapshots.withColumn("freshness", out)


def merge_registry(overrides: DataFrame, registry: DataFrame, by: tuple[str, ...] = ("signer", "role")) -> DataFrame:
    """Windows of the registry but where an override names the key, which has precedence; distinct."""
    return overrides.unionByName(registry.join(overrides.select(*by).distinct(), list(by), "left_anti")).distinct()


def ready_receipts(receipts: DataFrame, as_of: int) -> DataFrame:
    """Receipts to work on: no successor, not done, due, no live lease; fair order: never tried first, then longest due, then id."""
    done = F.get_json_object("metadata", "$.phase").eqNullSafe("F")
    superseded = receipts.select(F.col("supersedes_id").alias("id")).filter("id is not null").distinct()
    due = (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= as_of)) & (F.col("lease_until").isNull() | (F.col("lease_until") < as_of))
    return receipts.filter(~done & due).join(superseded, "id", "left_anti").orderBy(F.asc_nulls_first("next_attempt_at"), "submitted_at", "id")


def splices(checkpoints: DataFrame, *, identity: tuple[str, ...] = ("signer", "shard_id"), arrival: str = "id") -> DataFrame:
    """Rows with the latest earlier row of the identity: ``prev_size``, and ``contiguous``: whether this one appends exactly one. ``arrival`` is a number; an identity is split
    by ranges of it, whose largest sizes are carried over, so a hot one is not one task."""
    by = [*identity, "range_"]
    rows = checkpoints.withColumn("range_", F.floor(F.col(arrival) / F.lit(ARRIVALS)))
    within = Window.partitionBy(*by).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*identity).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(*by).agg(F.max("tree_size").alias("top_")).withColumn("before_", F.max("top_").over(ahead)).drop("top_")
    prev = F.greatest("inside_", "before_")  # either may be null
    out = rows.withColumn("inside_", F.max("tree_size").over(within)).join(tops, by).withColumn("prev_size", prev)
    return out.withColumn("contiguous", F.coalesce(F.col("tree_size") == F.col("prev_size") + 1, F.lit(False))).select(*checkpoints.columns, "prev_size", "contiguous")


def latest(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The latest row of each group, the last of ``order`` breaking ties: one aggregation, combined before the shuffle."""
    value = F.struct(*order, *(c for c in rows.columns if c not in {*by, *order}))
    return rows.groupBy(*by).agg(F.max(value).alias("m")).select(*by, *(F.col(f"m.{c}").alias(c) for c in rows.columns if c not in by))


def backoff(attempts: Column, base: int, most: int = 6 * 3600, first_is_zero: bool = True) -> Column:
    """Seconds to the next attempt: base doubled with each, up to ``most``."""
    n = F.least(attempts - (1 if first_is_zero else 0), F.lit(16))
    return F.least(F.lit(base) * F.pow(F.lit(2), F.greatest(n, F.lit(0))), F.lit(most)).cast("long")


def uptime(seconds: Column) -> Column:
    """Whole seconds, minutes, hours or days: the largest unit that is reached."""
    whole = lambda unit, name: F.concat(F.floor(seconds / unit).cast("string"), F.lit(name))
    return F.when(seconds < 60, whole(1, "s")).when(seconds < 3600, whole(60, "m")).when(seconds < 86400, whole(3600, "h")).otherwise(whole(86400, "d"))


def tree_depth(n: Column) -> Column:
    """Levels of a binary tree over n leaves, in integers: ceil(log2 n)."""
    return F.when(n <= 1, F.lit(0)).otherwise(F.length(F.bin(n - 1))).cast("int")


def csv_safe(c: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def clean_filename(c: Column) -> Column:
    """Without control characters, 255 characters at most."""
    return F.substring(F.regexp_replace(c, r"[\x00-\x1f\x7f]", ""), 1, 255)


#: Pages and rows of a page that a client may ask for.
PAGES, PER_PAGE = 10_000, 100


def clamped(wanted: int, least: int, most: int) -> int:
    """A client's limit within its bounds."""
    return max(least, min(most, wanted))


def page(df: DataFrame, order: list[Column | str], number: int, per_page: int) -> DataFrame:
    """A page of results in order, from page 1; number and size are clamped, so that no client asks for a scan past everything."""
    size = clamped(per_page, 1, PER_PAGE)
    return df.orderBy(*order).offset((clamped(number, 1, PAGES) - 1) * size).limit(size)


def chain_faults(links: DataFrame) -> DataFrame:
    """``links(chain_id, sequence, kind, digest, previous_digest, snapshot_digest, snapshot_sequence, activation_at, activated)`` with ``verdict``: the first rule that a link breaks, or valid.

    Rules in order: its columns agree with the signed snapshot (recomputed digest, sequence); the first is a genesis of sequence 1; no gap; it names its predecessor's digest; activation
    does not go back; and it is not activated before its predecessor. A chain is an ordered look back by one, so links of one chain sort together, and chains apart."""
    w = Window.partitionBy("chain_id").orderBy("sequence")
    prev = lambda c: F.lag(c).over(w)
    c = F.col
    first = prev("sequence").isNull()
    rules = [
        (~c("digest").eqNullSafe(c("snapshot_digest")), "digest-disagrees"),
        (~c("sequence").eqNullSafe(c("snapshot_sequence")), "sequence-disagrees"),
        (first & ((c("sequence") != 1) | (c("kind") != "genesis")), "missing-genesis"),
        (~first & (c("sequence") != prev("sequence") + 1), "sequence-gap"),
        (~first & ~c("previous_digest").eqNullSafe(prev("digest")), "linkage-broken"),
        (~first & (c("activation_at") < prev("activation_at")), "activation-order"),
        (~first & c("activated") & ~prev("activated"), "activation-gap"),
    ]
    verdict = F.lit("valid")
    for broken, name in reversed(rules):
        verdict = F.when(F.coalesce(broken, F.lit(False)), name).otherwise(verdict)
    return links.withColumn("verdict", verdict)
