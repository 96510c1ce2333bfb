"""Ledger analytics and dataset integrity as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sealstone.functions import framing
from sealstone.operators import diff, ledger, merkle, segments, smt
from sealstone.plans.registry import query
from sealstone.sources import fixtures as fx
from sealstone.sources.fixtures import AS_OF, ctes, read
from sealstone.sources.tables import table

_EQUIVOCATES = ctes("peer_checkpoints") + """, f AS (SELECT *, verified AND (
    EXISTS (SELECT 1 FROM g1 WHERE g1.signer = p.signer AND g1.shard_id = p.shard_id AND g1.checkpoint_timestamp = p.checkpoint_timestamp)
    OR EXISTS (SELECT 1 FROM g2 WHERE g2.signer = p.signer AND g2.shard_id = p.shard_id AND g2.tree_size = p.tree_size)) AS equivocates FROM p)"""


def _equivocates(select: str) -> str:
    base = ctes("peer_checkpoints") + ", p AS (SELECT id, signer % 20 AS signer, scope, shard_id, ledger_root, tree_size, checkpoint_timestamp, verified FROM peer_checkpoints)"
    groups = "".join(f", g{i} AS (SELECT signer, shard_id, {by} FROM p WHERE verified GROUP BY ALL HAVING count(DISTINCT ledger_root) > 1)" for i, by in ((1, "checkpoint_timestamp"), (2, "tree_size")))
    return base + groups + _EQUIVOCATES[_EQUIVOCATES.index(", f AS") :] + select


def _peers(spark, d):
    return fx.peer_checkpoints(spark, d).withColumn("signer", F.col("signer") % 20)


@query(_equivocates(" SELECT id, signer, shard_id, coalesce(equivocates, false) AS equivocates FROM f"))
def equivocation(spark, d):
    return ledger.equivocations(_peers(spark, d)).select("id", "signer", "shard_id", "equivocates")


@query(_equivocates(" SELECT count(DISTINCT (signer, scope)) AS n_identities FROM f WHERE equivocates"))
def equivocating_identities(spark, d):
    return ledger.equivocating_identities(ledger.equivocations(_peers(spark, d)))


@query(_equivocates(" SELECT signer, bool_or(coalesce(equivocates, false)) AS blocked FROM f GROUP BY 1"))
def auto_blocked(spark, d):
    p = _peers(spark, d)
    return ledger.auto_block(p.select("signer").distinct(), ledger.equivocations(p)).select("signer", "blocked")


_COVER = ctes("ingest_records", "own_checkpoints") + """, c AS (SELECT r.proof_id, r.shard_id, r.ts, r.snapshot_size, arg_min((k.checkpoint_timestamp, k.id), (k.checkpoint_timestamp, k.id)) AS m
    FROM ingest_records r LEFT JOIN own_checkpoints k ON k.shard_id = r.shard_id AND k.tree_size >= r.snapshot_size GROUP BY 1, 2, 3, 4),
    e AS (SELECT proof_id, shard_id, ts, m[1] AS cp_ts, m[2] AS cp_id FROM c)"""


@query(_COVER + " SELECT proof_id, cp_ts, cp_id FROM e")
def first_covering_checkpoint(spark, d):
    r = fx.ingest_records(spark, d).select("proof_id", "shard_id", "ts", "snapshot_size")
    return ledger.first_covering(r, fx.own_checkpoints(spark, d)).select("proof_id", "cp_ts", "cp_id")


@query(_COVER + f", s AS (SELECT *, greatest(coalesce(cp_ts, {AS_OF}) - ts, 0) AS elapsed FROM e) SELECT shard_id, CASE WHEN cp_ts IS NOT NULL THEN CASE WHEN elapsed <= 86400 THEN 'within' ELSE 'breach' END ELSE CASE WHEN elapsed <= 86400 THEN 'pending' ELSE 'pending-breach' END END AS status, count(*) AS n, CAST(max(elapsed) AS BIGINT) AS worst FROM s GROUP BY 1, 2")
def merge_delay_classes(spark, d):
    r = fx.ingest_records(spark, d).select("proof_id", "shard_id", "ts", "snapshot_size")
    return ledger.merge_delay(ledger.first_covering(r, fx.own_checkpoints(spark, d)), AS_OF).groupBy("shard_id", "status").agg(F.count("*").alias("n"), F.max("elapsed").alias("worst"))


@query(ctes("cosignatures", "eligible") + " SELECT checkpoint_id, count(DISTINCT signer) FILTER (WHERE valid AND signer IN (SELECT signer FROM eligible)) AS n_signers, count(DISTINCT signer) FILTER (WHERE valid AND signer IN (SELECT signer FROM eligible)) >= 3 AS reached FROM cosignatures GROUP BY 1")
def quorum_reached(spark, d):
    return ledger.quorum(fx.cosignatures(spark, d), fx.eligible(spark, d), 3)


@query(ctes("cosignatures") + ", s AS (SELECT DISTINCT checkpoint_id, checkpoint_id % 8 AS issuer, [checkpoint_id % 4, 4 + checkpoint_id % 3] AS signers FROM cosignatures) SELECT checkpoint_id, signers[1] = issuer AND EXISTS (SELECT 1 FROM cosignatures c WHERE c.valid AND c.checkpoint_id = s.checkpoint_id AND c.signer = s.issuer) AS anchored FROM s")
def issuer_anchors(spark, d):
    co = fx.cosignatures(spark, d)
    c = F.col("checkpoint_id")
    sets = co.select("checkpoint_id").distinct().select("checkpoint_id", (c % 8).alias("issuer"), F.array(c % 4, 4 + c % 3).alias("signers"))
    return ledger.issuer_anchored(sets, co).select("checkpoint_id", "anchored")


def _trusted(end: str) -> str:
    return ctes("trust_windows") + f", q AS (SELECT o_orderkey AS id, o_custkey AS signer, (['publisher', 'witness', 'auditor'])[o_custkey % 3 + 1] AS role, 1704067200 + (o_orderkey % 40) * 86400 AS ts FROM orders) SELECT id, EXISTS (SELECT 1 FROM trust_windows w WHERE w.signer = q.signer AND w.role = q.role AND w.valid_from <= q.ts AND (w.valid_until IS NULL OR q.ts {end} w.valid_until)) AS trusted FROM q"


def _asked(spark, d):
    o = read(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("signer"), F.element_at(F.array(F.lit("publisher"), F.lit("witness"), F.lit("auditor")), (F.col("o_custkey") % 3 + 1).cast("int")).alias("role"), (F.lit(1704067200) + (F.col("o_orderkey") % 40) * 86400).alias("ts"))


@query(_trusted("<"))
def trust_half_open(spark, d):
    return ledger.trusted_at(_asked(spark, d), fx.trust_windows(spark, d)).select("id", "trusted")


@query(_trusted("<="))
def trust_closed(spark, d):
    return ledger.trusted_at(_asked(spark, d), fx.trust_windows(spark, d), closed=True).select("id", "trusted")


@query(f"SELECT id, CASE WHEN {AS_OF} < i - 300 THEN 'future-dated' WHEN {AS_OF} >= e THEN 'expired' WHEN {AS_OF} - i > 604800 THEN 'too-old' WHEN e - i > 2592000 THEN 'lifetime-too-long' ELSE 'fresh' END AS freshness FROM (SELECT c_custkey AS id, {AS_OF} + (c_custkey % 25 - 20) * 43200 AS i, {AS_OF} + (c_custkey % 7 - 2) * 1000000 AS e FROM customer)")
def snapshot_freshness(spark, d):
    c = F.col("c_custkey")
    s = read(spark, d, "customer").select(c.alias("id"), (F.lit(AS_OF) + (c % 25 - 20) * 43200).alias("issued_at"), (F.lit(AS_OF) + (c % 7 - 2) * 1000000).alias("expires_at"))
    return ledger.freshness(s, AS_OF).select("id", "freshness")


@query(ctes("trust_windows") + ", o AS (SELECT signer, role, valid_from - 5 AS valid_from, valid_until FROM trust_windows WHERE signer % 9 = 0) SELECT signer, role, valid_from, valid_until FROM o UNION SELECT w.signer, w.role, w.valid_from, w.valid_until FROM trust_windows w WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.signer = w.signer AND o.role = w.role)")
def registry_merge(spark, d):
    w = fx.trust_windows(spark, d)
    over = w.filter("signer % 9 = 0").withColumn("valid_from", F.col("valid_from") - 5)
    return ledger.merge_registry(over, w)


@query(ctes("receipts") + f" SELECT id, submitted_at FROM receipts r WHERE metadata NOT LIKE '%\"F\"%' AND (next_attempt_at IS NULL OR next_attempt_at <= {AS_OF}) AND (lease_until IS NULL OR lease_until < {AS_OF}) AND NOT EXISTS (SELECT 1 FROM receipts s WHERE s.supersedes_id = r.id) ORDER BY next_attempt_at NULLS FIRST, submitted_at, id LIMIT 200")
def queue_readiness(spark, d):
    return ledger.ready_receipts(fx.receipts(spark, d), AS_OF).limit(200).select("id", "submitted_at")


@query(ctes("peer_checkpoints") + " SELECT id, prev_size, coalesce(tree_size = prev_size + 1, false) AS contiguous FROM (SELECT *, max(tree_size) OVER (PARTITION BY signer, shard_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_size FROM peer_checkpoints)")
def append_linkage(spark, d):
    return ledger.splices(fx.peer_checkpoints(spark, d)).select("id", "prev_size", "contiguous")


@query(ctes("records") + """, r AS (SELECT shard_id, count(*) AS n, max_by(content_hash, (byte_size, record_id)) AS root FROM records GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS n_shards, sha256(unhex(hex(encode('OLY:GLOBAL_ROOT:V1')) || string_agg('00000020' || root, '' ORDER BY shard_id))) AS global_root FROM r""")
def ledger_state(spark, d):
    """Totals, and the root folded over the shards' latest roots in order; shards are few."""
    last = fx.records(spark, d).groupBy("shard_id").agg(F.count("*").alias("n"), F.max_by("content_hash", F.struct("byte_size", "record_id")).alias("root"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("shard_id", "root"))), lambda x: F.concat(F.lit("00000020"), x["root"])), "")
    return last.agg(F.sum("n").alias("total"), F.count("*").alias("n_shards"), body.alias("body")).select("total", "n_shards", F.sha2(framing.joined(framing.GLOBAL_ROOT, F.unhex("body")), 256).alias("global_root"))


@query("SELECT event_id, event_type, total FROM (SELECT event_id, event_type, ts, count(*) OVER () AS total FROM events WHERE upper(event_type) = upper('Click')) ORDER BY ts DESC, event_id DESC LIMIT 20")
def activity_feed(spark, d):
    e = read(spark, d, "events").filter(F.upper("event_type") == F.upper(F.lit("Click")))
    total = e.agg(F.count("*").alias("total"))
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "event_type").join(F.broadcast(total))


@query("SELECT (SELECT count(*) FROM documents) + (SELECT count(*) FROM pages) AS records, greatest((SELECT count(*) FROM benchmark WHERE false), 1) AS nodes, (SELECT count(DISTINCT source) FROM documents) AS shards")
def public_stats(spark, d):
    """Counts over tables; no node at all is told as one."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    a, b, c = n(read(spark, d, "documents"), "a"), n(read(spark, d, "pages"), "b"), n(read(spark, d, "benchmark").filter("false"), "c")
    s = read(spark, d, "documents").agg(F.countDistinct("source").alias("shards"))
    return a.join(b).join(c).join(s).select((F.col("a") + F.col("b")).alias("records"), F.greatest("c", F.lit(1)).alias("nodes"), "shards")


@query(ctes("records") + " SELECT count(*) AS leaves, coalesce(max(version), 0) AS top, CAST(sum(octet_length(encode(content_hash))) AS BIGINT) AS bytes FROM records")
def tree_stats(spark, d):
    return fx.records(spark, d).agg(F.count("*").alias("leaves"), F.coalesce(F.max("version"), F.lit(0)).alias("top"), F.sum(F.octet_length("content_hash")).alias("bytes"))


@query(ctes("records", "records_v2") + " SELECT record_id, a.content_hash <> b.content_hash AS conflict FROM records a JOIN (SELECT record_id, shard_id, content_hash FROM records_v2 WHERE version = 2) b USING (record_id, shard_id)")
def identity_conflict(spark, d):
    new = fx.records_v2(spark, d).filter("version = 2").select("record_id", "shard_id", F.col("content_hash").alias("other"))
    return fx.records(spark, d).join(new, ["record_id", "shard_id"]).select("record_id", (F.col("content_hash") != F.col("other")).alias("conflict"))


@query("SELECT count(*) FILTER (WHERE h = s) AS valid, count(*) FILTER (WHERE h <> s) AS invalid, count(*) FILTER (WHERE s IS NULL) AS unverified, count(*) AS total FROM (SELECT sha256(text) AS h, CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS s FROM documents)")
def integrity_tally(spark, d):
    k, h = F.col("doc_id"), F.sha2("text", 256)
    stated = F.when(k % 23 == 0, None).when(k % 19 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(h)
    rows = read(spark, d, "documents").select(h.alias("h"), stated.alias("s"))
    return rows.agg(F.count_if(F.col("h") == F.col("s")).alias("valid"), F.count_if(F.col("h") != F.col("s")).alias("invalid"), F.count_if(F.col("s").isNull()).alias("unverified"), F.count("*").alias("total"))


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r FROM conversations) WHERE r = 1")
def replay_dedup(spark, d):
    """First use of each nonce (conversation and role); the stream form has a time to live."""
    return read(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("turn")).select("conv_id", "turn")


# --- dataset versions -------------------------------------------------------------------------------------------


_DIFF = ctes("records", "records_v2") + """, x AS (SELECT 0 AS kind, * FROM records a WHERE NOT EXISTS (SELECT 1 FROM records_v2 b WHERE (a.shard_id, a.record_id, a.version) = (b.shard_id, b.record_id, b.version))
    UNION ALL SELECT 1, * FROM records_v2 b WHERE NOT EXISTS (SELECT 1 FROM records a WHERE (a.shard_id, a.record_id, a.version) = (b.shard_id, b.record_id, b.version)))"""
_LP = "lpad(hex(octet_length(encode({0}))), 8, '0') || hex(encode({0}))"


@query(_DIFF + " SELECT kind, shard_id, record_id, version, content_hash FROM x")
def version_diff(spark, d):
    return diff.diff(fx.records(spark, d), fx.records_v2(spark, d))


@query(_DIFF + f", e AS (SELECT kind, shard_id, record_id, version, content_hash, lpad(hex(kind), 2, '0') || {_LP.format('shard_id')} || {_LP.format('record_id')} || lpad(hex(version), 16, '0') || upper(content_hash) AS h FROM x) SELECT count(*) FILTER (WHERE kind = 1) AS added, count(*) FILTER (WHERE kind = 0) AS removed, sha256(unhex(hex(encode('OLY:MANIFEST:DIFF:V1')) || lpad(hex(count(*)), 8, '0') || string_agg(h, '' ORDER BY kind, shard_id, record_id, version, content_hash))) AS diff_root FROM e")
def diff_root_sha256(spark, d):
    return diff.diff_root(diff.diff(fx.records(spark, d), fx.records_v2(spark, d)), "sha256")


@query()
def diff_root_blake3(spark, d):
    return diff.diff_root(diff.diff(fx.records(spark, d), fx.records_v2(spark, d)))


@query(ctes("records") + " SELECT shard_id, record_id, version, content_hash AS old_hash, sha256('x' || content_hash) AS new_hash FROM records WHERE CAST(record_id AS BIGINT) % 10 = 0")
def changed_under_identity(spark, d):
    old = fx.records(spark, d)
    new = old.withColumn("content_hash", F.when(F.col("record_id").cast("long") % 10 == 0, F.sha2(F.concat(F.lit("x"), "content_hash"), 256)).otherwise(F.col("content_hash")))
    return diff.changed(old, new)


@query("SELECT id, CASE WHEN c IS NULL THEN 'no-parent' WHEN c <> p THEN 'parent-mismatch' WHEN s IS NULL THEN 'no-diff' WHEN s <> r THEN 'diff-mismatch' ELSE 'valid' END AS verdict FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 > 0 THEN 'r' || CAST(c_custkey % 3 AS VARCHAR) END AS c, 'r1' AS p, CASE WHEN c_custkey % 4 > 0 THEN 'd' || CAST(c_custkey % 2 AS VARCHAR) END AS s, 'd1' AS r FROM customer)")
def link_verdicts(spark, d):
    k = F.col("c_custkey")
    rows = read(spark, d, "customer").select(k.alias("id"), F.when(k % 5 > 0, F.concat(F.lit("r"), (k % 3).cast("string"))).alias("child_parent_root"), F.lit("r1").alias("parent_root"), F.when(k % 4 > 0, F.concat(F.lit("d"), (k % 2).cast("string"))).alias("stated_diff_root"), F.lit("d1").alias("diff_root"))
    return diff.verify_link(rows).select("id", "verdict")


# --- segments ---------------------------------------------------------------------------------------------------

_SEGMENTS = """WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i] || CASE WHEN i < len(string_split(text, chr(10))) THEN chr(10) ELSE '' END AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
    s AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS segment_id, line, CAST(octet_length(encode(line)) AS BIGINT) AS byte_length FROM l WHERE line <> ''),
    o AS (SELECT *, CAST(coalesce(sum(byte_length) OVER (PARTITION BY doc_id ORDER BY segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset, segment_id % 5 = 0 AS redacted FROM s),
    e AS (SELECT *, CASE WHEN redacted THEN '[REDACTED]' || chr(10) ELSE line END AS emitted FROM o),
    a AS (SELECT *, CAST(coalesce(sum(octet_length(encode(emitted))) OVER (PARTITION BY doc_id ORDER BY segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS artifact_offset, CAST(octet_length(encode(emitted)) AS BIGINT) AS artifact_length FROM e)"""


@query(_SEGMENTS + " SELECT doc_id, segment_id, byte_offset, byte_length, sha256(line) AS digest FROM a")
def text_segments(spark, d):
    return segments.segments(read(spark, d, "documents")).select("doc_id", "segment_id", "byte_offset", "byte_length", F.sha2("content", 256).alias("digest"))


def _emitted(spark, d):
    return segments.reemit(segments.segments(read(spark, d, "documents")), F.col("segment_id") % 5 == 0)


@query(_SEGMENTS + " SELECT doc_id, segment_id, artifact_offset, artifact_length, redacted FROM a")
def text_redaction(spark, d):
    return _emitted(spark, d).select("doc_id", "segment_id", "artifact_offset", "artifact_length", "redacted")


@query(_SEGMENTS + f", t AS (SELECT doc_id, segment_id, lpad(hex(segment_id), 8, '0') || CASE WHEN redacted THEN '01' ELSE '00' END || lpad(hex(artifact_offset), 16, '0') || lpad(hex(artifact_length), 16, '0') || {_LP.format(chr(40) + chr(39) + 'line ' + chr(39) + ' || CAST(segment_id + 1 AS VARCHAR))')} || {_LP.format('sha256(line)')} AS h FROM a) SELECT doc_id, sha256(unhex(hex(encode('OLY:REDACTION:TABLE:V3')) || string_agg(h, '' ORDER BY segment_id))) AS table_hash FROM t GROUP BY 1")
def redaction_table_sha256(spark, d):
    return segments.table_hash(_emitted(spark, d), F.sha2("content", 256), alg="sha256")


@query("SELECT doc_id, CASE WHEN text LIKE '%PDF-%' AND left(text, 5) = '%PDF-' THEN 'pdf' WHEN text <> '' THEN 'text' END AS format FROM documents")
def format_detection(spark, d):
    return read(spark, d, "documents").select("doc_id", segments.detect_format(F.col("text")).alias("format"))


# --- trees ------------------------------------------------------------------------------------------------------


@query()
def seal_documents(spark, d):
    """The flagship: documents sealed under one BLAKE3 root, with each shard's root, count and bytes."""
    return smt.seal(fx.records(spark, d))


_H = "hex(encode('{0}'))"
_NODE = "sha256(unhex(" + _H.format("OLY:NODE:V1|") + " || {0} || '7C' || {1}))"


def _lp_text(value: str) -> str:
    return _LP.format(value)


def _leaves_sql(source: str) -> str:
    """Leaves of a relation of records: shard_id, byte_size, key (hex), leaf (hex)."""
    key = f"left(sha256(unhex({_H.format('OLY:SHARD-PREFIX:V1')} || hex(encode(shard_id)))), 16) || left(sha256(unhex({_H.format('OLY:KEY:V1')} || {_lp_text(chr(39) + 'dataset-record' + chr(39))} || {_lp_text('record_id')} || lpad(hex(version), 16, '0'))), 48)"
    parser = " || ".join(_lp_text(f"'{x}'") for x in ("manifest@v1", "v1", "none"))
    return f"keys AS (SELECT *, {key} AS key FROM {source}), leaves AS (SELECT *, sha256(unhex('014F4C590101' || {_lp_text('shard_id')} || '05' || '00000020' || key || content_hash || {parser})) AS leaf FROM keys)"


def _seal_sql(source: str, *needs: str) -> str:
    """The tree level by level: 256 groupings by one bit less of the key."""
    empty = [e.tobytes().hex() for e in smt.empties("sha256")]
    levels = ["l256 AS (SELECT CAST(CAST(unhex(key) AS BIT) AS VARCHAR) AS b, leaf AS h FROM leaves)"]
    for d in range(256, 0, -1):
        side = [f"coalesce(max(h) FILTER (WHERE substr(b, {d}, 1) = '{x}'), '{empty[256 - d]}')" for x in "01"]
        levels.append(f"l{d - 1} AS (SELECT left(b, {d - 1}) AS b, {_NODE.format(*side)} AS h FROM l{d} GROUP BY 1)")
    out = f"SELECT s.shard_id, l64.h AS shard_root, s.record_count, s.byte_size, l0.h AS manifest_root FROM (SELECT shard_id, left(CAST(CAST(unhex(min(key)) AS BIT) AS VARCHAR), 64) AS b, count(*) AS record_count, CAST(sum(byte_size) AS BIGINT) AS byte_size FROM leaves GROUP BY 1) s JOIN l64 USING (b), l0"
    return ctes(*needs) + f", {_leaves_sql(source)}, {', '.join(levels)} {out}"


@query(_seal_sql("records", "records"))
def seal_documents_sha256(spark, d):
    return smt.seal(fx.records(spark, d), "sha256")


@query(_seal_sql("merged", "records", "records_v2").replace(", keys AS", ", merged AS (SELECT * FROM records UNION SELECT * FROM records_v2), keys AS"))
def incremental_seal(spark, d):
    """The tree of one version, extended by the records of the next: only buckets that get new leaves are folded again."""
    return smt.extend(smt.build(fx.records(spark, d), "sha256"), fx.records_v2(spark, d)).seal()


def _queries(spark, d):
    r = fx.records(spark, d)
    own = r.select("shard_id", "record_id", "version")
    return r, own.unionByName(own.withColumn("record_id", F.concat("record_id", F.lit("-absent"))))


@query()
def prove_records(spark, d):
    """Inclusion proofs for every record and exclusion proofs for as many absent ones."""
    r, asked = _queries(spark, d)
    return smt.prove(r, asked)


_TAMPERED = """CASE WHEN doc_id % 7 = 0 THEN 'root-mismatch' WHEN doc_id % 11 = 1 THEN 'kind-mismatch' WHEN doc_id % 13 = 2 THEN 'key-mismatch' WHEN doc_id % 17 = 3 AND kind = 'inclusion' THEN 'content-mismatch' WHEN doc_id % 19 = 4 THEN 'proof-invalid' ELSE 'valid' END"""


@query(f"SELECT CASE WHEN doc_id % 11 = 1 THEN '?' ELSE kind END AS kind, {_TAMPERED} AS verdict, count(*) AS n FROM documents, unnest(['inclusion', 'exclusion']) AS u(kind) GROUP BY 1, 2")
def verify_records(spark, d):
    """Proofs of every record and as many absent ones, many of them tampered with in one way or other."""
    r, asked = _queries(spark, d)
    tree = smt.build(r)
    k = F.regexp_extract("record_id", "^[0-9]+", 0).cast("long")
    bad = smt.prove(tree, asked).withColumn("k", k).withColumn("committed_hash", F.col("content_hash"))
    bad = bad.withColumn("manifest_root", F.when(F.col("k") % 7 == 0, F.lit("00" * 32)).otherwise(F.col("manifest_root"))).withColumn("content_hash", F.when((F.col("k") % 17 == 3) & (F.col("kind") == "inclusion"), F.lit("11" * 32)).otherwise(F.col("content_hash")))
    bad = bad.withColumn("version", F.when(F.col("k") % 13 == 2, F.col("version") + 1).otherwise(F.col("version"))).withColumn("siblings", F.when(F.col("k") % 19 == 4, F.concat(F.lit(bytes(32)), F.substring("siblings", 33, 8192))).otherwise(F.col("siblings")))
    bad = bad.withColumn("kind", F.when(F.col("k") % 11 == 1, "?").otherwise(F.col("kind")))
    return smt.verify(bad, tree.root()).groupBy("kind", "verdict").agg(F.count("*").alias("n"))


@query("SELECT kind, 'valid' AS verdict, count(*) AS n FROM documents, unnest(['inclusion', 'exclusion']) AS u(kind) GROUP BY 1")
def verify_all_records(spark, d):
    """Every record and as many absent ones, untouched."""
    r, asked = _queries(spark, d)
    tree = smt.build(r)
    return smt.verify(smt.prove(tree, asked), tree.root()).groupBy("kind", "verdict").agg(F.count("*").alias("n"))


@query("SELECT source AS shard_id, kind, CASE WHEN source = 'src3' THEN 'root-mismatch' WHEN doc_id % 7 = 0 AND kind = 'inclusion' THEN 'proof-invalid' ELSE 'valid' END AS verdict, count(*) AS n FROM documents, unnest(['inclusion', 'exclusion']) AS u(kind) GROUP BY 1, 2, 3")
def verify_in_shards(spark, d):
    """Each proof against the root of its shard alone; one shard's root is another's, and some hashes are not those sealed."""
    r, asked = _queries(spark, d)
    tree = smt.build(r)
    known = tree.seal().select("shard_id", F.when(F.col("shard_id") == "src3", F.lit("22" * 32)).otherwise(F.col("shard_root")).alias("shard_root"))
    bad = smt.prove(tree, asked).withColumn("content_hash", F.when(F.regexp_extract("record_id", "^[0-9]+", 0).cast("long") % 7 == 0, F.sha2("content_hash", 256)).otherwise(F.col("content_hash")))
    return smt.verify_in_shard(bad, known).groupBy("shard_id", "kind", "verdict").agg(F.count("*").alias("n"))


@query(_DIFF + " SELECT kind, shard_id, record_id, version, CASE WHEN CAST(record_id AS BIGINT) % 5 = 0 THEN 'content-mismatch' WHEN CAST(record_id AS BIGINT) % 7 = 1 THEN 'wrong-sides' ELSE 'valid' END AS verdict FROM x")
def verify_version_changes(spark, d):
    """Added and removed records by two proofs each; some state another hash, some the other kind of change."""
    old, new = fx.records(spark, d), fx.records_v2(spark, d)
    a, b = smt.build(old), smt.build(new)
    changes = table(diff.diff(old, new), "changes")
    asked = changes.select("shard_id", "record_id", "version")
    k = F.col("record_id").cast("long")
    stated = changes.withColumn("content_hash", F.when(k % 5 == 0, F.sha2("content_hash", 256)).otherwise(F.col("content_hash"))).withColumn("own", F.col("kind")).withColumn("kind", F.when((k % 7 == 1) & (k % 5 != 0), 1 - F.col("kind")).otherwise(F.col("kind")))
    checked = smt.verify_changes(stated, smt.prove(a, asked), smt.prove(b, asked), a.root(), b.root())
    return checked.select(F.col("own").alias("kind"), "shard_id", "record_id", "version", "verdict")


@query(ctes("records") + f", {_leaves_sql('records')} SELECT left(key, 18) AS canopy, count(*) AS leaves, count(*) > 1024 AS kept FROM leaves GROUP BY 1")
def canopies_of_keys(spark, d):
    """Leaves by the first nine bytes of their keys, and whether the nodes below are kept."""
    return smt.canopies(smt.leaves(fx.records(spark, d), "sha256"))


@query(ctes("records") + f", {_leaves_sql('records')} SELECT record_id, left(key, 16) = left(sha256(unhex({_H.format('OLY:SHARD-PREFIX:V1')} || hex(encode(CASE WHEN CAST(record_id AS BIGINT) % 3 = 0 THEN 'src1' ELSE shard_id END)))), 16) AS matches FROM leaves")
def shard_of_key(spark, d):
    """Whether a key is of the shard stated for it."""
    rows = smt.leaves(fx.records(spark, d), "sha256")
    stated = F.when(F.col("record_id").cast("long") % 3 == 0, F.lit("src1")).otherwise(F.col("shard_id"))
    return rows.select("record_id", smt.shard_matches_key(stated, F.col("key"), "sha256").alias("matches"))


@query(ctes("records") + f" SELECT shard_id, record_id, sha256(unhex(hex(encode('OLY:KEY:V1')) || {_LP.format(chr(39) + 'dataset-record' + chr(39))} || {_LP.format('record_id')} || lpad(hex(version), 16, '0'))) AS record_key FROM records")
def record_keys_sha256(spark, d):
    return fx.records(spark, d).select("shard_id", "record_id", F.lower(F.hex(framing.record_key(F.lit("dataset-record"), F.col("record_id"), F.col("version"), "sha256"))).alias("record_key"))


@query()
def record_keys_blake3(spark, d):
    return fx.records(spark, d).select("shard_id", "record_id", F.lower(F.hex(framing.record_key(F.lit("dataset-record"), F.col("record_id"), F.col("version"), "blake3"))).alias("record_key"))


@query()
def canonical_json_payloads(spark, d):
    from sealstone.functions.canonical import canonical_json

    return read(spark, d, "events").select("event_id", canonical_json("props").alias("canonical"))


@query()
def legacy_merkle_root(spark, d):
    """Root of each shard's documents in doc_id order, odd nodes passed on."""
    rows = fx.records(spark, d).select("shard_id", F.col("record_id").cast("long").alias("position"), F.unhex("content_hash").alias("data"))
    return merkle.binary_roots(rows, by="shard_id").select("shard_id", F.lower(F.hex("root")).alias("root"), "n")


def _levels_sql(depth: int, empties: list[str] | None) -> str:
    """Levels of an ordered tree over l0(shard_id, i, h): a missing right node is an empty subtree or, without these, the left one passes up."""
    out = []
    for k in range(depth):
        left, right = ("max(h) FILTER (WHERE i % 2 = {})".format(x) for x in (0, 1))
        node = _NODE.format(left, f"coalesce({right}, '{empties[k]}')") if empties else f"CASE WHEN count(*) = 2 THEN {_NODE.format(left, right)} ELSE max(h) END"
        out.append(f"l{k + 1} AS (SELECT shard_id, i // 2 AS i, {node} AS h FROM l{k} GROUP BY 1, 2)")
    return ", ".join(out)


@query(ctes("records") + f", l0 AS (SELECT shard_id, row_number() OVER (PARTITION BY shard_id ORDER BY CAST(record_id AS BIGINT)) - 1 AS i, sha256(unhex({_H.format('OLY:LEAF:V1|')} || content_hash)) AS h FROM records), {_levels_sql(24, None)} SELECT l24.shard_id, h AS root, n FROM l24 JOIN (SELECT shard_id, count(*) AS n FROM records GROUP BY 1) USING (shard_id)")
def legacy_merkle_root_sha256(spark, d):
    rows = fx.records(spark, d).select("shard_id", F.col("record_id").cast("long").alias("position"), F.unhex("content_hash").alias("data"))
    return merkle.binary_roots(rows, by="shard_id", alg="sha256").select("shard_id", F.lower(F.hex("root")).alias("root"), "n")


#: Depth of the snapshot trees.
SNAPSHOT_DEPTH = 20


def _snapshots(spark, d):
    """Leaves of the shards' snapshot trees (see ``merkle.in_trees``)."""
    rows = fx.ingest_records(spark, d).select("shard_id", F.col("snapshot_index").alias("position"), F.unhex(F.sha2(F.col("proof_id").cast("string"), 256)).alias("data"))
    return merkle.in_trees(rows, by="shard_id", depth=SNAPSHOT_DEPTH)


@query(ctes("ingest_records") + f", l0 AS (SELECT shard_id, snapshot_index AS i, sha256(CAST(proof_id AS VARCHAR)) AS h FROM ingest_records), {_levels_sql(20, [e.hex() for e in merkle.zeros('sha256', 20)])} SELECT l20.shard_id, h AS root, n FROM l20 JOIN (SELECT shard_id, count(*) AS n FROM ingest_records GROUP BY 1) USING (shard_id)")
def snapshot_append_roots(spark, d):
    """Roots of each shard's snapshot trees of a fixed depth over its records in order, and the number of all these. Where a tree is full, the next one begins."""
    roots = merkle.fixed_depth_roots(_snapshots(spark, d), by="tree", depth=SNAPSHOT_DEPTH, alg="sha256")
    n = F.sum("n").over(Window.partitionBy("tree.shard_id"))
    return roots.select("tree.shard_id", F.lower(F.hex("root")).alias("root"), n.alias("n"))


def _where(shard: str, column: str, value):
    return F.when(F.col("shard_id") == shard, value).otherwise(F.col(column))


def _of_shards(checked):
    """Verdicts of trees (tree, shard_id, verdict) as those of their shards: the first that is not valid."""
    fault = F.min(F.when(F.col("verdict") != "valid", F.struct("tree.number", "verdict")))
    return checked.groupBy("shard_id").agg(fault.alias("fault")).select("shard_id", F.coalesce("fault.verdict", F.lit("valid")).alias("verdict"))


@query("SELECT shard_id, CASE shard_id WHEN 'click' THEN 'not-an-append' WHEN 'view' THEN 'root-mismatch' ELSE 'valid' END AS verdict FROM (SELECT DISTINCT event_type AS shard_id FROM events)")
def snapshot_append_transition(spark, d):
    """The last append of each tree of each shard: one path leads from the root before to the root after. One shard states another root before, one another after."""
    rows = _snapshots(spark, d)
    n = F.max("position").over(Window.partitionBy("tree"))
    before = merkle.fixed_depth_roots(rows.withColumn("top", n).filter("position < top").drop("top"), by="tree", depth=SNAPSHOT_DEPTH, alg="sha256").select("tree", F.col("root").alias("prev_root"))
    none = F.lit(merkle.zeros("sha256", SNAPSHOT_DEPTH)[-1])  # a tree's first leaf has no root before it
    now = merkle.snapshot_paths(rows, by="tree", depth=SNAPSHOT_DEPTH, alg="sha256").withColumnRenamed("n", "size").join(before, "tree", "left").withColumn("prev_root", F.coalesce("prev_root", none)).withColumn("shard_id", F.col("tree.shard_id"))
    now = now.withColumn("prev_root", _where("click", "prev_root", F.lit(bytes(32)))).withColumn("root", _where("view", "root", F.lit(bytes(32))))
    return _of_shards(merkle.append_transition(now, "sha256"))


@query("SELECT shard_id, CASE shard_id WHEN 'click' THEN 'size-mismatch' WHEN 'signup' THEN 'not-contiguous' WHEN 'view' THEN 'leaf-mismatch' WHEN 'error' THEN 'root-mismatch' ELSE 'valid' END AS verdict FROM (SELECT DISTINCT event_type AS shard_id FROM events)")
def snapshot_validation(spark, d):
    """Stated snapshots against their records, tree by tree: four shards break a rule each."""
    rows = _snapshots(spark, d)
    stated = merkle.snapshot_paths(rows, by="tree", depth=SNAPSHOT_DEPTH, alg="sha256").select("tree", F.col("tree.shard_id").alias("shard_id"), F.col("n").alias("size"), "leaf", "root")
    stated = stated.withColumn("size", _where("click", "size", F.col("size") + 1)).withColumn("leaf", _where("view", "leaf", F.lit(bytes(32)))).withColumn("root", _where("error", "root", F.lit(bytes(32))))
    gap = rows.withColumn("position", F.when((F.col("tree.shard_id") == "signup") & (F.col("position") > 0), F.col("position") + 1).otherwise(F.col("position")))
    return _of_shards(merkle.snapshot_faults(gap, stated, by="tree", depth=SNAPSHOT_DEPTH, alg="sha256"))


def _appends_sql(depth: int) -> str:
    """Every append's root and path over l0(shard_id, i, h): level by level the node beside it, if it is a right one, else an empty subtree."""
    empty, out = [e.hex() for e in merkle.zeros("sha256", depth)], []
    for k in range(depth):
        out.append(f"l{k + 1} AS (SELECT shard_id, i // 2 AS i, {_NODE.format('max(h) FILTER (WHERE i % 2 = 0)', 'max(h) FILTER (WHERE i % 2 = 1)')} AS h FROM l{k} GROUP BY 1, 2 HAVING count(*) = 2)")
    out.append("a0 AS (SELECT shard_id, i, h AS r, '' AS path FROM l0)")
    for k in range(depth):
        beside = f"CASE WHEN (a.i >> {k}) % 2 = 1 THEN l.h ELSE '{empty[k]}' END"
        node = f"CASE WHEN (a.i >> {k}) % 2 = 1 THEN {_NODE.format('l.h', 'a.r')} ELSE {_NODE.format('a.r', chr(39) + empty[k] + chr(39))} END"
        out.append(f"a{k + 1} AS (SELECT a.shard_id, a.i, {node} AS r, a.path || {beside} AS path FROM a{k} a LEFT JOIN l{k} l ON l.shard_id = a.shard_id AND (a.i >> {k}) % 2 = 1 AND l.i = (a.i >> {k}) - 1)")
    return ", ".join(out)


@query(ctes("ingest_records") + f", l0 AS (SELECT shard_id, snapshot_index AS i, sha256(CAST(proof_id AS VARCHAR)) AS h FROM ingest_records), {_appends_sql(20)} SELECT shard_id, i, r AS root, sha256(unhex(path)) AS path FROM a20")
def append_paths_sha256(spark, d):
    """The root after every append of every shard, and the digest of the path that proves it."""
    out = merkle.append_paths(_snapshots(spark, d), by="tree", depth=SNAPSHOT_DEPTH, alg="sha256")
    return out.select("tree.shard_id", (F.shiftleft("tree.number", SNAPSHOT_DEPTH) + F.col("i")).alias("i"), F.lower(F.hex("root")).alias("root"), F.sha2(F.unhex(F.array_join(F.transform("siblings", lambda x: F.hex(x)), "")), 256).alias("path"))


@query("SELECT event_type AS shard_id, CASE event_type WHEN 'click' THEN 'not-an-append' WHEN 'view' THEN 'root-mismatch' ELSE 'valid' END AS verdict, count(*) AS n FROM events GROUP BY 1, 2")
def append_transitions(spark, d):
    """Every append's path leads from the root before to the root after; one shard states other roots before, one others after."""
    paths = merkle.append_paths(_snapshots(spark, d), by="tree", depth=SNAPSHOT_DEPTH, alg="sha256").select("tree", (F.col("i") + 1).alias("size"), "leaf", "siblings", "root")
    made = table(merkle.transition_roots(paths, "sha256"), "append-roots")  # a path is verified where it is made; what is joined is three hashes a row
    before = made.select("tree", (F.col("size") + 1).alias("size"), F.col("root").alias("prev_root"))
    none = F.lit(merkle.zeros("sha256", SNAPSHOT_DEPTH)[-1])
    rows = made.join(before, ["tree", "size"], "left").withColumn("prev_root", F.coalesce("prev_root", none)).withColumn("shard_id", F.col("tree.shard_id"))
    rows = rows.withColumn("prev_root", _where("click", "prev_root", F.lit(bytes(32)))).withColumn("root", _where("view", "root", F.lit(bytes(32))))
    verdict = merkle.transition_verdict(F.col("before_"), F.col("after_"))
    return rows.withColumn("verdict", verdict).groupBy("shard_id", "verdict").agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha256(unhex(hex(encode('OLY:NODE:V1|')) || sha256('b' || CAST(doc_id AS VARCHAR)) || '7C' || sha256(unhex(hex(encode('OLY:NODE:V1|')) || sha256(CAST(doc_id AS VARCHAR)) || '7C' || sha256('a' || CAST(doc_id AS VARCHAR)))))) AS root FROM documents")
def legacy_proof_fold(spark, d):
    k = F.col("doc_id").cast("string")
    h = lambda p: F.unhex(F.sha2(F.concat(F.lit(p), k), 256))
    path = F.array(F.struct(h("a").alias("hash"), F.lit("right").alias("side")), F.struct(h("b").alias("hash"), F.lit("left").alias("side")))
    return read(spark, d, "documents").select("doc_id", F.lower(F.hex(merkle.path_with_sides(h(""), path))).alias("root"))


@query()
def poseidon_snapshot_roots(spark, d):
    """Snapshot trees over the field, of each shard's checkpoints."""
    place = (F.col("tree_size") / 10).cast("long") - 1  # every tenth row of a shard is one
    rows = fx.own_checkpoints(spark, d).select("shard_id", place.alias("position"), F.unhex(F.lpad(F.hex("id"), 64, "0")).alias("data"))
    roots = merkle.fixed_depth_roots(merkle.in_trees(rows, by="shard_id", depth=SNAPSHOT_DEPTH), by="tree", depth=SNAPSHOT_DEPTH, alg="poseidon")
    return roots.select("tree.shard_id", F.lower(F.hex("root")).alias("root"), F.sum("n").over(Window.partitionBy("tree.shard_id")).alias("n"))


@query(ctes("records", "records_v2") + " SELECT shard_id, record_id, version FROM records_v2 EXCEPT SELECT shard_id, record_id, version FROM records")
def incremental_leaves(spark, d):
    """Leaves that a next version adds to a write-once tree."""
    from sealstone.sources.files import write_once

    old, new = (smt.leaves(r, "sha256").select("shard_id", "record_id", "version", "key", "value_hash") for r in (fx.records(spark, d), fx.records_v2(spark, d)))
    return write_once(old, new).select("shard_id", "record_id", "version")


@query("SELECT substr(h, 1, 3) AS canopy, count(*) AS leaves, count(*) > 4 AS kept FROM (SELECT sha256(text) AS h FROM documents) GROUP BY 1")
def canopy_pruning(spark, d):
    """Which canopies hold enough leaves for their deep nodes to be kept."""
    return read(spark, d, "documents").groupBy(F.substring(F.sha2("text", 256), 1, 3).alias("canopy")).agg(F.count("*").alias("leaves")).withColumn("kept", F.col("leaves") > 4)


@query("""WITH r AS (SELECT doc_id, octet_length(encode(text)) AS n, [doc_id % 50, doc_id % 300 + 100] AS s, [doc_id % 50 + 10, doc_id % 300 + 140] AS e, greatest(CAST(ceil(octet_length(encode(text)) / 16.0) AS BIGINT), 1) AS c FROM documents),
    m AS (SELECT doc_id, n, c, i, e[1] <= n AND e[2] <= n AS good, NOT (i * c < n AND ((s[1] < least((i + 1) * c, n) AND i * c < e[1]) OR (s[2] < least((i + 1) * c, n) AND i * c < e[2]))) AS open FROM r, unnest(range(16)) AS u(i))
    SELECT doc_id, CASE WHEN bool_and(good) AND bool_or(open AND i * c < n) THEN string_agg(CASE WHEN open THEN '1' ELSE '0' END, '' ORDER BY i) END AS mask FROM m GROUP BY doc_id""")
def chunk_reveal_masks(spark, d):
    from sealstone.operators.chunks import reveal_mask

    k = F.col("doc_id")
    ranges = F.array(F.struct((k % 50).alias("s"), (k % 50 + 10).alias("e")), F.struct((k % 300 + 100).alias("s"), (k % 300 + 140).alias("e")))
    return read(spark, d, "documents").select("doc_id", F.array_join(reveal_mask(F.octet_length("text").cast("long"), ranges).cast("array<string>"), "").alias("mask"))


@query("""WITH t AS (SELECT doc_id, hex(encode(text)) AS h, CAST(2 * greatest(ceil(octet_length(encode(text)) / 16.0), 1) AS INTEGER) AS c FROM documents)
    SELECT doc_id, string_agg(sha256(unhex(rpad(substr(h, i * c + 1, c), c, '0'))), ',' ORDER BY i) AS chunks FROM t, unnest(range(16)) AS u(i) GROUP BY 1""")
def chunk_hashes_sha256(spark, d):
    """The hashes of the sixteen chunks of every text, in one row."""
    from sealstone.operators.chunks import CHUNKS, chunk_hash

    hashes = F.array(*(F.lower(F.hex(chunk_hash(F.col("text"), F.lit(i), "sha256"))) for i in range(CHUNKS)))
    return read(spark, d, "documents").filter("text is not null").select("doc_id", F.array_join(hashes, ",").alias("chunks"))


@query("""WITH t AS (SELECT doc_id, hex(encode(text)) AS h, CAST(2 * greatest(ceil(octet_length(encode(text)) / 16.0), 1) AS INTEGER) AS c FROM documents)
    SELECT doc_id, i AS chunk, sha256(unhex(rpad(substr(h, i * c + 1, c), c, '0'))) AS hash FROM t, unnest(range(16)) AS u(i)""")
def all_chunk_hashes_sha256(spark, d):
    """All sixteen chunks of every text."""
    from sealstone.operators.chunks import CHUNKS, chunk_hash

    hashes = F.array(*(F.lower(F.hex(chunk_hash(F.col("text"), F.lit(i), "sha256"))) for i in range(CHUNKS)))
    return read(spark, d, "documents").select("doc_id", F.posexplode(hashes).alias("chunk", "hash")).withColumn("chunk", F.col("chunk").cast("long"))


def _chunk_hashes(spark, d):
    """(doc_id, hashes) of each text's sixteen chunks, dealt out by number: small rows, and much work for each."""
    from sealstone.operators.chunks import CHUNKS, chunk_hash

    rows = read(spark, d, "documents").select("doc_id", F.array(*(chunk_hash(F.col("text"), F.lit(i)) for i in range(CHUNKS))).alias("hashes"))
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")


@query()
def chunk_roots(spark, d):
    """Root of each text's sixteen chunks."""
    from sealstone.operators.chunks import chunk_root

    return _chunk_hashes(spark, d).select("doc_id", chunk_root("hashes").alias("root"))


@query()
def chunk_commitments(spark, d):
    """Commitments to the chunks that a redaction leaves and to its mask, of every text."""
    from sealstone.operators import chunks

    k, i = F.col("doc_id"), F.sequence(F.lit(0), F.lit(15))
    mask = F.transform(i, lambda x: ((k + x) % 3 > 0).cast("int"))
    made = _chunk_hashes(spark, d).select("doc_id", chunks.commitment_columns(F.col("hashes"), mask).alias("c"))
    return made.select("doc_id", "c.leaves", "c.mask")


def _lists(spark, d):
    c = F.col("c_custkey")
    at = F.lit(AS_OF)
    lists = read(spark, d, "customer").select((c % 40).alias("list_id")).distinct().select("list_id", (F.col("list_id") % 4).alias("sequence"), F.when(F.col("list_id") % 3 > 0, "p").alias("previous"), at.alias("issued_at"), (at + 100).alias("activation_at"), (at + 1000).alias("expires_at"), F.array(F.lit("witness")).alias("active_roles"))
    entries = read(spark, d, "customer").filter("c_custkey % 40 < 38").select((c % 40).alias("list_id"), F.concat(F.lit("k"), (F.floor(c / 40) % 2).cast("string")).alias("pubkey"), F.when(c % 40 % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("witness"))).alias("roles"), (at + c % 40 % 5).alias("valid_from"), (at + 900 + F.when(c % 40 == 9, F.floor(c / 80) % 2).otherwise(0)).alias("valid_until"))
    policies = lists.filter("list_id % 6 <> 1").select("list_id", F.lit("witness").alias("role"), F.array(F.lit("a"), F.lit("b")).alias("signers"), F.when(F.col("list_id") % 10 == 7, "a").otherwise("z").alias("recovery"))
    return lists, entries, policies


@query("""WITH l AS (SELECT DISTINCT c_custkey % 40 AS id FROM customer)
    SELECT id AS list_id, CASE WHEN id % 4 = 0 THEN 'zero-sequence' WHEN id % 4 = 1 AND id % 3 > 0 THEN 'genesis-has-predecessor' WHEN id % 4 > 1 AND id % 3 = 0 THEN 'missing-predecessor'
        WHEN id < 38 AND id % 11 = 0 THEN 'issuer-without-roles' WHEN id = 9 THEN 'ambiguous-duplicate' WHEN id >= 38 THEN 'role-not-covered' WHEN id % 6 = 1 THEN 'role-without-policy' WHEN id % 10 = 7 THEN 'recovery-key-in-quorum' ELSE 'valid' END AS verdict FROM l""")
def trust_list_validation(spark, d):
    from sealstone.operators.trust import list_faults

    return list_faults(*_lists(spark, d), max_lifetime=5000).select("list_id", "verdict")


@query("SELECT DISTINCT c_custkey % 40 AS list_id, c_custkey % 40 % 2 = 0 OR c_custkey % 40 % 11 = 0 AS same FROM customer WHERE c_custkey % 40 < 38")
def role_projection(spark, d):
    from sealstone.operators.trust import same_projection

    _, entries, _ = _lists(spark, d)
    later = entries.withColumn("valid_from", F.when(F.col("list_id") % 2 == 1, F.col("valid_from") + 1).otherwise(F.col("valid_from")))
    return same_projection(entries, later, "witness")


_LINKS = """WITH c AS (SELECT c_custkey AS k, c_nationkey AS chain_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer), l AS (SELECT *, n + CASE WHEN chain_id % 6 = 1 AND n >= 5 THEN 1 ELSE 0 END AS sequence FROM c)"""


@query(_LINKS + """ SELECT k, CASE WHEN n = 3 AND chain_id % 6 = 0 THEN 'digest-disagrees' WHEN n = 4 AND chain_id % 6 = 4 THEN 'sequence-disagrees' WHEN n = 1 AND chain_id % 6 = 5 THEN 'missing-genesis' WHEN n = 5 AND chain_id % 6 = 1 THEN 'sequence-gap' WHEN n = 4 AND chain_id % 6 = 2 THEN 'linkage-broken'
    WHEN n = 6 AND chain_id % 6 = 2 THEN 'activation-order' WHEN n = 6 AND chain_id % 6 = 3 THEN 'activation-gap' ELSE 'valid' END AS verdict FROM l""")
def accepted_chain(spark, d):
    """Chains of trust transitions, one a nation; each breaks one of the rules."""
    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).cast("long")
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("chain_id"), n.alias("n")).withColumn("broken", F.col("chain_id") % 6)
    is_ = lambda kind, at: (F.col("broken") == kind) & (F.col("n") == at)
    sequence = F.col("n") + F.when((F.col("broken") == 1) & (F.col("n") >= 5), 1).otherwise(0)
    digest = lambda at: F.sha2(F.concat_ws(":", F.col("chain_id").cast("string"), at.cast("string")), 256)
    links = rows.select("k", "chain_id", sequence.alias("sequence"), F.when((F.col("n") == 1) & (F.col("broken") != 5), "genesis").otherwise("rotation").alias("kind"), digest(F.col("n")).alias("digest"), F.when(is_(2, 4), "none").otherwise(digest(F.col("n") - 1)).alias("previous_digest"), F.when(is_(0, 3), "other").otherwise(digest(F.col("n"))).alias("snapshot_digest"), (sequence + F.when(is_(4, 4), 9).otherwise(0)).alias("snapshot_sequence"), (F.col("n") * 100 - F.when(is_(2, 6), 150).otherwise(0)).alias("activation_at"), ((F.col("n") < 4) | is_(3, 6)).alias("activated"))
    return ledger.chain_faults(links).select("k", "verdict")


@query(f"SELECT doc_id, lower({_H.format('OLY:REDACTION_BUNDLE:V3')} || {_LP.format('sha256(text)')} || {_LP.format(chr(39) + 'text' + chr(39))} || lpad(hex(len(string_split(text, chr(10)))), 8, '0') || {_LP.format('CAST(doc_id AS VARCHAR)')} || sha256('t' || text)) AS message, sha256(unhex({_H.format('OLY:REDACTION:NULLIFIER:V1')} || sha256(text) || sha256('t' || text) || {_LP.format('CAST(doc_id AS VARCHAR)')})) AS nullifier FROM documents")
def redaction_bundles(spark, d):
    """What is signed of a redacted bundle, and its nullifier."""
    root, table_hash, to = F.sha2("text", 256), F.sha2(F.concat(F.lit("t"), "text"), 256), F.col("doc_id").cast("string")
    message = segments.signing_message(root, F.lit("text"), F.size(F.split("text", "\n")), to, table_hash)
    return read(spark, d, "documents").select("doc_id", F.lower(F.hex(message)).alias("message"), segments.nullifier(root, table_hash, to, "sha256").alias("nullifier"))
