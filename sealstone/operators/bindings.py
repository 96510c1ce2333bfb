"""Manifests as tables, what binds them to the ledger, and updates from a relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A manifest's layout. The last two fields may be left out.
MANIFEST = (
    "schema string, dataset_id string, version long, created_at long, metadata struct<name: string, description: string, license: string, source: string, parser_id: string, canonical_parser_version: string, model_hash: string>, shards array<struct<shard_id: string, shard_root: string, record_count: long, byte_size: long>>, "
    "manifest_root string, record_count long, parent struct<version: long, manifest_root: string>, diff struct<added: long, removed: long, diff_root: string>"
)
_HEX = "^[0-9a-f]{64}$"


def parse_manifests(rows: DataFrame, *, key: str, json: str = "json", schema_name: str | None = None) -> DataFrame:
    """(key, verdict, manifest): manifests parsed with their declared layout. The first fault: ``not-json`` (or a field of another kind), ``missing-field``, ``other-schema`` (than ``schema_name``, if one is given),
    ``bad-root`` (a root that is no lower-case hex of 32 bytes), ``bad-count`` (shards that do not add up), ``bad-order`` (shards not in order of their ids, or one twice); or ``ok``. A null text is not JSON."""
    m = F.col("manifest")
    hex_ = lambda c: F.coalesce(~c.rlike(_HEX), F.lit(False))
    shards, parent = m["shards"], m["parent"]
    missing = F.exists(shards, lambda s: s["shard_id"].isNull() | s["shard_root"].isNull() | s["record_count"].isNull()) | (parent.isNotNull() & (parent["version"].isNull() | parent["manifest_root"].isNull()))
    for f in ("schema", "dataset_id", "version", "created_at", "shards", "manifest_root", "record_count"):
        missing = m[f].isNull() | missing
    ids = F.transform(shards, lambda s: s["shard_id"])
    rules = [
        (m.isNull() | m["broken"].isNotNull(), "not-json"), (missing, "missing-field"), (m["schema"] != F.lit(schema_name) if schema_name else F.lit(False), "other-schema"),
        (hex_(m["manifest_root"]) | F.exists(shards, lambda s: hex_(s["shard_root"])) | hex_(parent["manifest_root"]) | hex_(m["diff"]["diff_root"]), "bad-root"),
        (F.aggregate(shards, F.lit(0).cast("long"), lambda a, s: a + s["record_count"]) != m["record_count"], "bad-count"), (F.array_sort(F.array_distinct(ids)) != ids, "bad-order"),
    ]
    verdict = F.lit("ok")
    for broken, name in reversed(rules):
        verdict = F.when(broken, name).otherwise(verdict)
    parsed = F.from_json(F.col(json), MANIFEST + ", broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    return rows.select(key, parsed.alias("manifest")).select(key, verdict.alias("verdict"), m.dropFields("broken").alias("manifest"))


def anchor_bindings(manifests: DataFrame, records: DataFrame, *, key: str = "id") -> DataFrame:
    """``manifests(key, content_hash, shard_id, original_root)`` against committed ``records(content_hash, shard_id, original_root, snapshot_committed, ts, proof_id)``: (key, verdict, proof_id).

    A manifest is ``bound`` by the earliest committed record of its content, shard and root (hex in any case); else the verdict tells what is nearest: ``other-root`` for the content and shard, ``other-shard``, ``not-committed``, ``unknown-content``.
    Joins by equality; a hot content is first reduced to a row for each shard and root."""
    root = F.lower("original_root")
    known = records.filter(F.col("content_hash").isNotNull()).groupBy("content_hash", "shard_id", root.alias("root")).agg(F.min(F.when(F.col("snapshot_committed") & root.isNotNull(), F.struct("ts", "proof_id"))).alias("first"))
    asked = manifests.select(key, "content_hash", "shard_id", root.alias("root"))
    exact = known.filter("first is not null and root is not null").select("content_hash", "shard_id", "root", F.col("first.proof_id").alias("proof_id"))
    of_shard = known.groupBy("content_hash", "shard_id").agg(F.max(F.col("first").isNotNull()).alias("committed"))
    of_content = of_shard.groupBy("content_hash").agg(F.max("committed").alias("any_committed"))
    out = asked.join(exact, ["content_hash", "shard_id", "root"], "left").join(of_shard, ["content_hash", "shard_id"], "left").join(of_content, "content_hash", "left")
    verdict = F.when(F.col("proof_id").isNotNull(), "bound").when(F.col("committed"), "other-root").when(F.col("any_committed"), "other-shard").when(F.col("any_committed").isNotNull(), "not-committed").otherwise("unknown-content")
    return out.select(key, verdict.alias("verdict"), "proof_id")


def update_from(rows: DataFrame, changes: DataFrame, *, keys: list[str], columns: list[str]) -> DataFrame:
    """An update of ``columns`` from a relation of the same names: rows with a change take its values, nulls too; all others stay. A key with more than one change is an error, as its outcome would be chance."""
    one = changes.groupBy(*keys).agg(F.count("*").alias("n_"), *(F.first(c).alias(f"{c}_new") for c in columns))
    checked = F.when(F.col("n_") > 1, F.raise_error(F.lit("a row has more than one change"))).otherwise(F.col("n_"))
    both = rows.join(one.withColumn("n_", checked), keys, "left")
    return both.select(*(F.when(F.col("n_").isNotNull(), F.col(f"{c}_new")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns))


def approved_chain(links: DataFrame, approvals: DataFrame, members: DataFrame) -> DataFrame:
    """Chains of trust transitions with their approvals: ``links(chain_id, sequence, ..., threshold)`` whose own check gave ``verdict`` (``ledger.chain_faults``), ``approvals(chain_id, sequence, signer, valid)``,
    ``members(chain_id, sequence, signer)`` of each state. Adds ``n_approvals`` and ``accepted``.

    A transition needs ``threshold`` (of the state before; its own for the first) distinct members of the state before with a valid approval. A chain is loaded up to its first fault: nothing behind it is accepted."""
    w = Window.partitionBy("chain_id").orderBy("sequence")
    stated = links.withColumn("needs_", F.coalesce(F.lag("threshold").over(w), F.col("threshold"))).withColumn("before_", F.coalesce(F.lag("sequence").over(w), F.col("sequence")))
    able = members.select("chain_id", F.col("sequence").alias("before_"), "signer").distinct()
    signed = approvals.filter("valid").select("chain_id", "sequence", "signer").distinct()
    given = stated.select("chain_id", "sequence", "before_").join(signed, ["chain_id", "sequence"]).join(able, ["chain_id", "before_", "signer"]).groupBy("chain_id", "sequence").agg(F.count("*").alias("n_approvals"))
    counted = stated.join(given, ["chain_id", "sequence"], "left").withColumn("n_approvals", F.coalesce("n_approvals", F.lit(0)).cast("long"))
    good = (F.col("verdict") == "valid") & (F.col("needs_") > 0) & (F.col("n_approvals") >= F.col("needs_"))
    return counted.withColumn("accepted", F.min(good).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("needs_", "before_")


def packed_path(bits: Column) -> Column:
    """A partial path (array of 0 and 1) as bytes, first bit highest, zeros behind; null if it holds anything else. Native."""
    text = F.array_join(F.transform(bits, lambda b: b.cast("string")), "")
    whole = F.rpad(text, (F.ceil(F.size(bits) / 8) * 8).cast("int"), "0")
    hex_ = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(bits) / 8).cast("int") - 1, F.lit(0))), lambda i: F.lpad(F.conv(F.substring(whole, i * 8 + 1, F.lit(8)), 2, 16), 2, "0"))
    good = F.forall(bits, lambda b: b.isNotNull() & b.isin(0, 1))
    return F.when(good, F.when(F.size(bits) == 0, F.lit(b"")).otherwise(F.unhex(F.array_join(hex_, ""))))


def unpacked_path(raw: Column, n: Column) -> Column:
    """The first ``n`` bits of a packed path as an array; null if there are not so many. What is behind them is not looked at. Native."""
    digits = F.split(F.hex(raw), "")
    bits = F.array_join(F.transform(F.filter(digits, lambda x: x != ""), lambda x: F.lpad(F.conv(x, 16, 2), 4, "0")), "")
    each = F.transform(F.filter(F.split(F.substring(bits, F.lit(1), n.cast("int")), ""), lambda x: x != ""), lambda x: x.cast("int"))
    return F.when(F.octet_length(raw) * 8 >= n, each)
