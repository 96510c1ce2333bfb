"""Ledger relations derived from the driver's tables, by integer arithmetic on keys alone, so that two runs agree."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealstone.functions.batches import pieces

#: A fixed moment for all predicates on time: 2024-01-31, in seconds.
AS_OF = 1706659200


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a document: shard_id, record_id, version, content_hash (hex), byte_size."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("shard_id"), F.col("doc_id").cast("string").alias("record_id"), F.lit(1).cast("long").alias("version"), F.sha2(F.col("text"), 256).alias("content_hash"), F.octet_length("text").cast("long").alias("byte_size"))


def records_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A next version of the dataset: every 17th record gone, a second version of every 13th added."""
    base = records(spark, sf_dir)
    number = F.col("record_id").cast("long")
    again = base.filter(number % 13 == 0).withColumn("version", F.lit(2).cast("long")).withColumn("content_hash", F.sha2(F.concat(F.lit("v2:"), "content_hash"), 256))
    return base.filter(number % 17 != 0).unionByName(again)


def ingest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of a shard in order of time. Rows are numbered within days, and days by running totals, so a large shard is not one task."""
    e = read(spark, sf_dir, "events").withColumn("day_", F.date_trunc("day", "ts"))
    before = Window.partitionBy("event_type").orderBy("day_").rowsBetween(Window.unboundedPreceding, -1)
    starts = e.groupBy("event_type", "day_").agg(F.count("*").alias("n_")).select("event_type", "day_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    own = F.row_number().over(Window.partitionBy("event_type", "day_").orderBy("ts", "event_id"))
    size = (F.col("own_") + F.col("before_")).cast("long")
    numbered = e.withColumn("own_", own).join(starts, ["event_type", "day_"])
    return numbered.select(F.col("event_id").alias("proof_id"), F.col("event_type").alias("shard_id"), F.col("user_id").cast("string").alias("record_id"), F.col("ts").alias("at"), F.unix_timestamp("ts").alias("ts"), (size - 1).alias("snapshot_index"), size.alias("snapshot_size"))


def own_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth row of a shard as a checkpoint, published up to a day later."""
    r = ingest_records(spark, sf_dir).filter("snapshot_size % 10 = 0")
    return r.select(F.col("proof_id").alias("id"), "shard_id", F.col("snapshot_size").alias("tree_size"), (F.col("ts") + (F.col("proof_id") % 5) * 21600).alias("checkpoint_timestamp"))


def peer_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    root = F.sha2(F.round(F.col("value") * 100).cast("bigint").cast("string"), 256)
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("signer"), F.lit("shard").alias("scope"), F.col("event_type").alias("shard_id"), root.alias("ledger_root"), (F.col("event_id") % 50).alias("tree_size"), F.floor(F.unix_timestamp("ts") / 3600).cast("long").alias("checkpoint_timestamp"), (F.col("event_id") % 11 != 0).alias("verified"))


def cosignatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """checkpoint_id, signer, set_id, valid; signers repeat."""
    o = read(spark, sf_dir, "orders")
    return o.select((F.col("o_orderkey") % 97).alias("checkpoint_id"), (F.col("o_custkey") % 8).alias("signer"), (F.col("o_orderkey") % 7 != 0).alias("valid"))


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signers of each set: those of customers of nations below six."""
    return read(spark, sf_dir, "customer").filter("c_nationkey < 3 and c_custkey % 8 <> 5").select((F.col("c_custkey") % 8).alias("signer")).distinct()


def trust_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signer, role, valid_from, valid_until (null: open); some windows touch."""
    c = F.col("c_custkey")
    start = F.lit(1704067200) + (c % 30) * 86400
    return read(spark, sf_dir, "customer").select(c.alias("signer"), F.element_at(F.array(F.lit("publisher"), F.lit("witness"), F.lit("auditor")), (c % 3 + 1).cast("int")).alias("role"), start.alias("valid_from"), F.when(c % 10 != 0, start + (c % 4 + 1) * 86400).alias("valid_until"))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue of receipts: each supersedes the customer's previous one."""
    o = read(spark, sf_dir, "orders")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    k = F.col("o_orderkey")
    return o.select(k.alias("id"), (k % 3).alias("kind"), F.unix_timestamp("o_orderdate").alias("submitted_at"), F.when(k % 4 == 0, before).alias("supersedes_id"), F.to_json(F.struct(F.col("o_orderstatus").alias("phase"))).alias("metadata"), F.when(k % 5 != 0, F.lit(AS_OF) + (k % 11 - 5) * 3600).alias("next_attempt_at"), F.when(k % 6 == 0, F.lit(AS_OF) + (k % 7 - 3) * 60).alias("lease_until"))


#: The same relations as DuckDB common table expressions.
SQL = {
    "records": "records AS (SELECT source AS shard_id, CAST(doc_id AS VARCHAR) AS record_id, CAST(1 AS BIGINT) AS version, sha256(text) AS content_hash, CAST(octet_length(encode(text)) AS BIGINT) AS byte_size FROM documents)",
    "records_v2": "records_v2 AS (SELECT * FROM records WHERE CAST(record_id AS BIGINT) % 17 <> 0 UNION ALL SELECT shard_id, record_id, CAST(2 AS BIGINT), sha256('v2:' || content_hash), byte_size FROM records WHERE CAST(record_id AS BIGINT) % 13 = 0)",
    "ingest_records": "ingest_records AS (SELECT event_id AS proof_id, event_type AS shard_id, CAST(user_id AS VARCHAR) AS record_id, ts AS at, CAST(floor(epoch(ts)) AS BIGINT) AS ts, CAST(row_number() OVER (PARTITION BY event_type ORDER BY events.ts, event_id) - 1 AS BIGINT) AS snapshot_index, CAST(row_number() OVER (PARTITION BY event_type ORDER BY events.ts, event_id) AS BIGINT) AS snapshot_size FROM events)",
    "own_checkpoints": "own_checkpoints AS (SELECT proof_id AS id, shard_id, snapshot_size AS tree_size, CAST(ts + (proof_id % 5) * 21600 AS BIGINT) AS checkpoint_timestamp FROM ingest_records WHERE snapshot_size % 10 = 0)",
    "peer_checkpoints": "peer_checkpoints AS (SELECT event_id AS id, user_id AS signer, 'shard' AS scope, event_type AS shard_id, sha256(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)) AS ledger_root, event_id % 50 AS tree_size, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS checkpoint_timestamp, event_id % 11 <> 0 AS verified FROM events)",
    "cosignatures": "cosignatures AS (SELECT o_orderkey % 97 AS checkpoint_id, o_custkey % 8 AS signer, o_orderkey % 7 <> 0 AS valid FROM orders)",
    "eligible": "eligible AS (SELECT DISTINCT c_custkey % 8 AS signer FROM customer WHERE c_nationkey < 3 AND c_custkey % 8 <> 5)",
    "trust_windows": "trust_windows AS (SELECT c_custkey AS signer, (['publisher', 'witness', 'auditor'])[c_custkey % 3 + 1] AS role, 1704067200 + (c_custkey % 30) * 86400 AS valid_from, CASE WHEN c_custkey % 10 <> 0 THEN 1704067200 + (c_custkey % 30) * 86400 + (c_custkey % 4 + 1) * 86400 END AS valid_until FROM customer)",
    "receipts": f"receipts AS (SELECT o_orderkey AS id, o_orderkey % 3 AS kind, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS submitted_at, CASE WHEN o_orderkey % 4 = 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END AS supersedes_id, '{{\"phase\":\"' || o_orderstatus || '\"}}' AS metadata, CASE WHEN o_orderkey % 5 <> 0 THEN {AS_OF} + (o_orderkey % 11 - 5) * 3600 END AS next_attempt_at, CASE WHEN o_orderkey % 6 = 0 THEN {AS_OF} + (o_orderkey % 7 - 3) * 60 END AS lease_until FROM orders)",
}
_NEEDS = {"records_v2": ("records",), "own_checkpoints": ("ingest_records",)}


def ctes(*names: str) -> str:
    """``WITH`` clause of the relations named, and of those they need."""
    out: list[str] = []
    for n in names:
        for x in (*_NEEDS.get(n, ()), n):
            if x not in out:
                out.append(x)
    return "WITH " + ", ".join(SQL[n] for n in out)


#: Parts of the office packages that documents are put into, in order of names; `{}` stands for the number.
RELATIONS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
OFFICE = (("[Content_Types].xml", "<Types/>"), ("_rels/.rels", RELATIONS), ("word/document.xml", "<w:document>{}</w:document>"))


def office_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as an office package: path (long), content (binary). The text is a media part; entries come in various orders, packed or not. Some files are damaged by a rule of their number."""
    import io
    import warnings
    import zipfile

    import pyarrow as pa

    def run(batches):
        for batch in pieces(batches):
            out = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = [(n, p.format(k)) for n, p in OFFICE] + [("word/media/text.bin", text or "")]
                if k % 13 == 7:
                    parts.append((parts[0][0], "again"))
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w") as z, warnings.catch_warnings():
                    warnings.simplefilter("ignore")  # of repeated names, which are meant
                    for i in sorted(range(len(parts)), key=lambda i: (k * 7 + i * 3) % 5):
                        z.writestr(zipfile.ZipInfo(parts[i][0]), parts[i][1], zipfile.ZIP_DEFLATED if (k + i) % 2 else zipfile.ZIP_STORED)
                raw = raw.getvalue()
                out.append(raw[: len(raw) // 2] if k % 11 == 5 else raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["path", "content"])

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(run, "path long, content binary")


#: Objects 1 to 3 and 5 of the PDF files that documents are put into; 4 holds the text.
PDF_OBJECTS = (
    "<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", "<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /XObject << /Im 5 0 R >> >> >>",
    "<< /Type /XObject /Subtype /Image /Length 8 /Filter /DCTDecode >>\nstream\n\\xff\\xd8ab\\xff\\xd9..\nendstream",
)


def pdf_file(k: int, text: str) -> bytes:
    """A file of one page that shows the text: by a table of cross-references where ``k`` is even; else its text packed, objects 1 to 3 in an object stream, and the cross-references in a stream with a predictor."""
    import zlib

    shown = re.sub(rb"[\\()]", rb"\\\g<0>", text.encode())
    content = b"BT /F1 12 Tf 72 720 Td (" + shown + b") Tj ET"
    bodies = [x.encode().replace(b"\\xff\\xd8ab\\xff\\xd9..", b"\xff\xd8ab\xff\xd9..") for x in PDF_OBJECTS]
    out, at = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}

    def add(number: int, body: bytes) -> None:
        at[number] = len(out)
        out.extend(b"%d 0 obj\n" % number + body + b"\nendobj\n")

    if k % 2 == 0:
        for i, b in enumerate([*bodies[:3], b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content), bodies[3]], 1):
            add(i, b)
        start = len(out)
        out += b"xref\n0 6\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % at[i] for i in range(1, 6))
        out += b"trailer\n<< /Size 6 /Root 1 0 R%s >>\n" % (b" /Encrypt 9 0 R" if k % 13 == 7 else b"")
    else:
        packed = zlib.compress(content)
        add(4, b"<< /Length 8 0 R /Filter /FlateDecode >>\nstream\n%s\nendstream" % packed)
        add(5, bodies[3])
        add(8, b"%d" % len(packed))
        starts = [sum(len(b) + 1 for b in bodies[:i]) for i in range(3)]
        head = b" ".join(b"%d %d" % (i + 1, s) for i, s in enumerate(starts)) + b"\n"
        inside = zlib.compress(head + b"\n".join(bodies[:3]))
        add(6, b"<< /Type /ObjStm /N 3 /First %d /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(head), len(inside), inside))
        start = len(out)
        rows = [(0, 0, 65535 & 255), (2, 6, 0), (2, 6, 1), (2, 6, 2), (1, at[4], 0), (1, at[5], 0), (1, at[6], 0), (1, start, 0), (1, at[8], 0)]
        rows = [bytes([a]) + b.to_bytes(4, "big") + bytes([c]) for a, b, c in rows]
        above = [bytes(6), *rows]
        table = zlib.compress(b"".join(b"\2" + bytes((x - y) & 255 for x, y in zip(row, up, strict=True)) for row, up in zip(rows, above)))
        out += b"7 0 obj\n<< /Type /XRef /Size 9 /W [1 4 1] /Root 1 0 R%s /DecodeParms << /Predictor 12 /Columns 6 >> /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream\nendobj\n" % (b" /Encrypt 9 0 R" if k % 13 == 7 else b"", len(table), table)
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)


def pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a PDF file: path (long), content (binary). Some are cut off or locked by a rule of their number."""
    import pyarrow as pa

    def run(batches):
        for batch in pieces(batches):
            made = [pdf_file(k, t or "") for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            out = [x[: len(x) // 2] if k % 11 == 5 else x for k, x in zip(batch.column(0).to_pylist(), made, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["path", "content"])

    return read(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "path long, content binary")
