"""Signed trust lists as tables: the rules a snapshot must meet, and a role's view of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_faults(snapshots: DataFrame, entries: DataFrame, policies: DataFrame, *, max_lifetime: int | None = None) -> DataFrame:
    """Snapshots with the first rule they break, or ``valid``.

    ``snapshots(list_id, sequence, previous, issued_at, activation_at, expires_at, active_roles array)``,
    ``entries(list_id, pubkey, roles array, valid_from, valid_until)``, ``policies(list_id, role, signers array, recovery)``. Keys are taken as canonical texts. Each rule
    is one aggregation over a list's rows."""
    e = entries.join(snapshots.select("list_id", "issued_at", "activation_at", "expires_at"), "list_id")
    bad_window = ~((F.col("issued_at") <= F.col("valid_from")) & (F.col("valid_from") < F.col("valid_until")) & (F.col("valid_until") <= F.col("expires_at")))
    each = e.groupBy("list_id").agg(F.max(F.size("roles") == 0).alias("no_roles"), F.max(bad_window).alias("bad_window"))
    twice = entries.groupBy("list_id", "pubkey").agg((F.countDistinct("valid_from", "valid_until") > 1).alias("t")).groupBy("list_id").agg(F.max("t").alias("ambiguous"))
    covers = e.filter((F.col("valid_from") <= F.col("activation_at")) & (F.col("activation_at") < F.col("valid_until"))).select("list_id", F.explode("roles").alias("role")).distinct().withColumn("covered", F.lit(True))
    active = snapshots.select("list_id", F.explode("active_roles").alias("role")).join(covers, ["list_id", "role"], "left").join(policies, ["list_id", "role"], "left")
    roles = active.groupBy("list_id").agg(F.max(F.col("covered").isNull()).alias("uncovered"), F.max(F.col("signers").isNull()).alias("no_policy"), F.max(F.col("recovery").isNull()).alias("no_recovery"), F.max(F.array_contains("signers", F.col("recovery"))).alias("in_quorum"))
    c = F.col
    rules = [
        (c("sequence") == 0, "zero-sequence"),
        ((c("sequence") == 1) & c("previous").isNotNull(), "genesis-has-predecessor"),
        ((c("sequence") > 1) & c("previous").isNull(), "missing-predecessor"),
        (~((c("issued_at") <= c("activation_at")) & (c("activation_at") < c("expires_at"))), "timestamps-out-of-order"),
        *([(c("expires_at") - c("issued_at") > max_lifetime, "lifetime-too-long")] if max_lifetime is not None else []),
        (c("no_roles"), "issuer-without-roles"),
        (c("bad_window"), "issuer-window-out-of-bounds"),
        (c("ambiguous"), "ambiguous-duplicate"),
        (c("uncovered"), "role-not-covered"),
        (c("no_policy"), "role-without-policy"),
        (c("no_recovery"), "role-without-recovery-key"),
        (c("in_quorum"), "recovery-key-in-quorum"),
    ]
    verdict = F.lit("valid")
    for broken, name in reversed(rules):
        verdict = F.when(F.coalesce(broken, F.lit(False)), name).otherwise(verdict)
    joined = snapshots.join(each, "list_id", "left").join(twice, "list_id", "left").join(roles, "list_id", "left")
    return joined.select(*snapshots.columns, verdict.alias("verdict"))


def project_role(entries: DataFrame, role: str) -> DataFrame:
    """What a role sees of each list: its issuers and their windows, in order, without their other roles; as (list_id, digest)."""
    rows = entries.filter(F.array_contains("roles", role)).select("list_id", F.struct("pubkey", "valid_from", "valid_until").alias("x")).distinct()
    return rows.groupBy("list_id").agg(F.sha2(F.to_json(F.sort_array(F.collect_list("x"))), 256).alias("digest"))


def same_projection(before: DataFrame, after: DataFrame, role: str) -> DataFrame:
    """(list_id, same): whether a change of lists leaves a role's view alone. Lists in which the role has no issuer count as empty views."""
    a, b = project_role(before, role), project_role(after, role).withColumnRenamed("digest", "other")
    ids = before.select("list_id").union(after.select("list_id")).distinct()
    return ids.join(a, "list_id", "left").join(b, "list_id", "left").select("list_id", F.col("digest").eqNullSafe(F.col("other")).alias("same"))
