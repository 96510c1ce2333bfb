"""Manifests, bindings, updates, approvals and paths as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sealstone.functions.canonical import nfc
from sealstone.operators import bindings, diff, smt
from sealstone.plans.registry import query
from sealstone.sources import fixtures as fx
from sealstone.sources.fixtures import AS_OF, ctes, read
from sealstone.sources.tables import table


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 11 WHEN 1 THEN 'not-json' WHEN 2 THEN 'missing-field' WHEN 3 THEN 'other-schema' WHEN 4 THEN 'bad-root' WHEN 5 THEN 'bad-count' WHEN 6 THEN 'bad-order' WHEN 7 THEN 'not-json' ELSE 'ok' END AS verdict,
    CASE WHEN o_orderkey % 11 NOT IN (1, 2, 7) THEN 2 END AS n_shards, CASE WHEN o_orderkey % 11 NOT IN (1, 7) THEN o_custkey END AS version FROM orders""")
def manifests_parsed(spark, d):
    """A manifest an order, written as JSON by Spark and parsed with its declared layout; many break a rule."""
    k = F.col("o_orderkey")
    case = k % 11
    root = lambda x: F.sha2(F.concat(F.lit(x), k.cast("string")), 256)
    shard = lambda name, x, n: F.struct(F.lit(name).alias("shard_id"), root(x).alias("shard_root"), n.cast("long").alias("record_count"))
    first, second = shard("a", "1", k % 5), shard("b", "2", k % 7)
    shards = F.when(case == 6, F.array(second, first)).otherwise(F.array(first, second))
    m = F.struct(F.when(case == 3, "other/v2").otherwise("dataset/v1").alias("schema"), F.when(case != 2, F.lit("set")).alias("dataset_id"), F.col("o_custkey").alias("version"), k.alias("created_at"), F.struct(F.lit("n").alias("name")).alias("metadata"), shards.alias("shards"), F.when(case == 4, F.upper(root("m"))).otherwise(root("m")).alias("manifest_root"), (k % 5 + k % 7 + F.when(case == 5, 1).otherwise(0)).cast("long").alias("record_count"))
    text = F.to_json(m)
    text = F.when(case == 1, F.substring(text, F.lit(1), F.length(text) - 5)).when(case == 7, F.regexp_replace(text, '"version":([0-9]+)', '"version":"$1x"')).otherwise(text)
    out = bindings.parse_manifests(read(spark, d, "orders").select(k.alias("id"), text.alias("json")), key="id", schema_name="dataset/v1")
    shown = F.col("verdict") != "not-json"
    return out.select("id", "verdict", F.when(shown & (F.col("verdict") != "missing-field"), F.size("manifest.shards")).alias("n_shards"), F.when(shown, F.col("manifest.version")).alias("version"))


@query("""WITH c AS (SELECT event_id AS proof_id, 'h' || user_id % 50 AS content_hash, event_type AS shard_id, 'r' || event_id % 9 AS original_root, event_id % 4 > 0 AS snapshot_committed, ts FROM events),
    m AS (SELECT o_orderkey AS id, 'h' || o_custkey % 60 AS content_hash, (['click', 'view', 'nowhere'])[o_orderkey % 3 + 1] AS shard_id, 'R' || o_orderkey % 12 AS original_root FROM orders),
    f AS (SELECT m.id, arg_min(proof_id, (c.ts, proof_id)) AS proof_id FROM m JOIN c ON c.content_hash = m.content_hash AND c.shard_id = m.shard_id AND c.original_root = lower(m.original_root) AND c.snapshot_committed GROUP BY 1)
    SELECT m.id, f.proof_id, CASE WHEN f.proof_id IS NOT NULL THEN 'bound' WHEN m.content_hash || '/' || m.shard_id IN (SELECT content_hash || '/' || shard_id FROM c WHERE snapshot_committed) THEN 'other-root'
        WHEN m.content_hash IN (SELECT content_hash FROM c WHERE snapshot_committed) THEN 'other-shard' WHEN m.content_hash IN (SELECT content_hash FROM c) THEN 'not-committed' ELSE 'unknown-content' END AS verdict FROM m LEFT JOIN f USING (id)""")
def anchor_bindings(spark, d):
    """Redaction manifests bound to the earliest committed record of their content, shard and root."""
    e, o = read(spark, d, "events"), read(spark, d, "orders")
    tag = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    records = e.select(F.col("event_id").alias("proof_id"), tag("h", F.col("user_id") % 50).alias("content_hash"), F.col("event_type").alias("shard_id"), tag("r", F.col("event_id") % 9).alias("original_root"), (F.col("event_id") % 4 > 0).alias("snapshot_committed"), "ts")
    k = F.col("o_orderkey")
    shard = F.element_at(F.array(F.lit("click"), F.lit("view"), F.lit("nowhere")), (k % 3 + 1).cast("int"))
    return bindings.anchor_bindings(o.select(k.alias("id"), tag("h", F.col("o_custkey") % 60).alias("content_hash"), shard.alias("shard_id"), tag("R", k % 12).alias("original_root")), records)


@query(ctes("receipts") + f""", ready AS (SELECT id, submitted_at FROM receipts WHERE next_attempt_at IS NULL OR next_attempt_at <= {AS_OF})
    SELECT r.id, CASE WHEN ready.id IS NOT NULL THEN {AS_OF} + 600 ELSE lease_until END AS lease_until, CASE WHEN ready.id IS NOT NULL THEN NULL ELSE next_attempt_at END AS next_attempt_at FROM receipts r LEFT JOIN ready USING (id)""")
def update_from_relation(spark, d):
    """Leases of the receipts that are due, set from the relation of those."""
    rows = fx.receipts(spark, d)
    ready = rows.filter(F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= AS_OF)).select("id", (F.lit(AS_OF) + 600).cast("long").alias("lease_until"), F.lit(None).cast("long").alias("next_attempt_at"))
    rows = rows.withColumns({c: F.col(c).cast("long") for c in ("lease_until", "next_attempt_at")})
    return bindings.update_from(rows, ready, keys=["id"], columns=["lease_until", "next_attempt_at"]).select("id", "lease_until", "next_attempt_at")


@query("""WITH n AS (SELECT c_custkey AS k, c_nationkey AS chain_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS BIGINT) AS sequence FROM customer),
    s AS (SELECT *, 2 + sequence % 2 AS threshold, CASE WHEN chain_id % 5 = 1 AND sequence = 9 THEN 'linkage-broken' ELSE 'valid' END AS verdict FROM n),
    needed AS (SELECT *, coalesce(lag(threshold) OVER (PARTITION BY chain_id ORDER BY sequence), threshold) AS needs, coalesce(lag(sequence) OVER (PARTITION BY chain_id ORDER BY sequence), sequence) AS before FROM s),
    a AS (SELECT DISTINCT chain_id, sequence, (k + j) % 6 AS signer FROM n, unnest(range(5)) AS u(j) WHERE (k + j) % 4 > 0 OR sequence < 4), m AS (SELECT DISTINCT chain_id, sequence, (sequence + j) % 6 AS signer FROM n, unnest(range(4)) AS u(j)),
    g AS (SELECT d.k, count(*) AS n_approvals FROM needed d JOIN a ON a.chain_id = d.chain_id AND a.sequence = d.sequence JOIN m ON m.chain_id = d.chain_id AND m.sequence = d.before AND m.signer = a.signer GROUP BY 1)
    SELECT k, CAST(coalesce(n_approvals, 0) AS BIGINT) AS n_approvals, bool_and(verdict = 'valid' AND coalesce(n_approvals, 0) >= needs) OVER (PARTITION BY chain_id ORDER BY sequence) AS accepted FROM needed LEFT JOIN g USING (k)""")
def approved_chain(spark, d):
    """Chains of trust transitions, one a nation, accepted as far as their links and their approvals hold."""
    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).cast("long")
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("chain_id"), n.alias("sequence"))
    links = rows.withColumn("threshold", 2 + F.col("sequence") % 2).withColumn("verdict", F.when((F.col("chain_id") % 5 == 1) & (F.col("sequence") == 9), "linkage-broken").otherwise("valid"))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    approvals = rows.withColumn("j", each(5)).select("chain_id", "sequence", ((F.col("k") + F.col("j")) % 6).alias("signer"), (((F.col("k") + F.col("j")) % 4 > 0) | (F.col("sequence") < 4)).alias("valid"))
    members = rows.withColumn("j", each(4)).select("chain_id", "sequence", ((F.col("sequence") + F.col("j")) % 6).alias("signer"))
    return bindings.approved_chain(links, approvals, members).select("k", "n_approvals", "accepted")


@query("SELECT doc_id, lower(hex(unhex(left(sha256(text), CAST((doc_id % 60 + 7) // 8 * 2 AS INTEGER))::VARCHAR))) IS NOT NULL AS ok, sha256(rpad(left(CAST(CAST(unhex(sha256(text)) AS BIT) AS VARCHAR), CAST(doc_id % 60 AS INTEGER)), CAST((doc_id % 60 + 7) // 8 * 8 AS INTEGER), '0')) AS packed, left(CAST(CAST(unhex(sha256(text)) AS BIT) AS VARCHAR), CAST(doc_id % 60 AS INTEGER)) AS path FROM documents")
def packed_paths(spark, d):
    """The first bits of each text's digest as a partial path, packed and taken out again."""
    n = (F.col("doc_id") % 60).cast("int")
    bits = bindings.unpacked_path(F.unhex(F.sha2("text", 256)), n)
    rows = read(spark, d, "documents").select("doc_id", n.alias("n"), bits.alias("bits")).select("doc_id", "n", bindings.packed_path(F.col("bits")).alias("raw"))
    shown = F.array_join(F.transform(F.filter(F.split(F.hex("raw"), ""), lambda x: x != ""), lambda x: F.lpad(F.conv(x, 16, 2), 4, "0")), "")
    path = F.array_join(F.transform(bindings.unpacked_path(F.col("raw"), F.col("n")), lambda b: b.cast("string")), "")
    return rows.select("doc_id", F.col("raw").isNotNull().alias("ok"), F.sha2(shown, 256).alias("packed"), path.alias("path"))


@query("SELECT doc_id, sha256(nfc_normalize(text || 'e' || chr(769) || chr(8491) || chr(4352) || chr(4449))) AS digest, length(nfc_normalize(text || 'e' || chr(769))) AS n FROM documents")
def texts_composed(spark, d):
    """Whole texts in Unicode's composed form."""
    text = lambda more: nfc(F.concat("text", F.lit(more)))
    return read(spark, d, "documents").select("doc_id", F.sha2(text("e\u0301\u212b\u1100\u1161"), 256).alias("digest"), F.char_length(text("e\u0301")).cast("long").alias("n"))


@query("SELECT DISTINCT source AS shard_id, CASE CAST(substr(source, 4) AS INTEGER) % 5 WHEN 1 THEN 'no-parent' WHEN 2 THEN 'parent-mismatch' WHEN 3 THEN 'no-diff' WHEN 4 THEN 'diff-mismatch' ELSE 'valid' END AS verdict FROM documents")
def sealed_link_verdicts(spark, d):
    """Both versions sealed, each shard's statement of its parent's root and of the difference held against what they are; many state something else."""
    old, new = fx.records(spark, d), fx.records_v2(spark, d)
    before = smt.seal(old, "sha256").select("shard_id", "shard_root")
    root = table(diff.diff_root(diff.diff(old, new)), "sealed-diff").select("diff_root")
    k = F.regexp_replace("shard_id", "^src", "").cast("int") % 5
    stated = before.join(F.broadcast(root)).withColumn("parent_root", F.col("shard_root"))
    stated = stated.withColumn("child_parent_root", F.when(k == 2, F.sha2("shard_root", 256)).when(k != 1, F.col("shard_root"))).withColumn("stated_diff_root", F.when(k == 4, F.sha2("diff_root", 256)).when(k != 3, F.col("diff_root")))
    return diff.verify_link(stated).select("shard_id", "verdict")
