"""Difference of two dataset versions by identity, its digest, and the link from parent to child."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealstone.functions.blake3 import Blake3, hash_many
from sealstone.functions.framing import DIFF, joined, lp, u64
from sealstone.operators.streams import blake3_of_parts
from sealstone.sources.tables import table

IDENTITY = ("shard_id", "record_id", "version")
REMOVE, ADD = 0, 1


def diff(parent: DataFrame, child: DataFrame) -> DataFrame:
    """(kind, shard_id, record_id, version, content_hash): removed records with the parent's hash, added ones with the child's. A changed hash under one identity is no difference."""
    by = list(IDENTITY)
    gone = parent.join(child.select(*by), by, "left_anti").select(F.lit(REMOVE).alias("kind"), *by, "content_hash")
    new = child.join(parent.select(*by), by, "left_anti").select(F.lit(ADD).alias("kind"), *by, "content_hash")
    return gone.unionByName(new)


def changed(parent: DataFrame, child: DataFrame) -> DataFrame:
    """Identities that both hold, with different hashes; not part of the digest."""
    old = parent.select(*IDENTITY, F.col("content_hash").alias("old_hash"))
    return child.join(old, list(IDENTITY)).filter(F.col("content_hash") != F.col("old_hash")).select(*IDENTITY, "old_hash", F.col("content_hash").alias("new_hash"))


def entry(alias: str = "entry"):
    """Preimage of one difference."""
    kind = F.unhex(F.lpad(F.hex(F.col("kind").cast("long")), 2, "0"))
    return joined(kind, lp(F.col("shard_id")), lp(F.col("record_id")), u64(F.col("version")), F.unhex("content_hash")).alias(alias)


#: Bytes of the entries of a partition, about.
PIECE = 32 << 20


def diff_root(differences: DataFrame, alg: str = "blake3") -> DataFrame:
    """One row: added, removed, diff_root (hex). Entries as a set, in order of kind, shard, id, version, hash.

    BLAKE3 is a tree over chunks of 1,024 bytes: entries of more than PIECE bytes are sorted by ranges, each range knows where its bytes begin, and chunks are hashed where they lie; fewer run through one task.
    SHA-256 is one stream by nature: the sorted entries run through one task, a batch at a time."""
    order = ["kind", *IDENTITY, "content_hash"]
    once = table(differences.select(*order).distinct().withColumn("entry", entry()), "diff-entries")
    n, added, removed, size = once.agg(F.count("*"), F.count_if(F.col("kind") == ADD), F.count_if(F.col("kind") == REMOVE), F.coalesce(F.sum(F.octet_length("entry")), F.lit(0))).first()
    head = DIFF + int(n).to_bytes(4, "big")
    if alg == "blake3" and size > PIECE:
        ranged = once.repartitionByRange(-(-size // PIECE), *order)
        root = blake3_of_parts(table(ranged.withColumn("part", F.spark_partition_id()), "diff-ranges"), order, "entry", head)
    elif n:
        # Few entries, or a digest that is one stream by nature: they run through one task in order, a batch at a time.
        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = Blake3() if alg == "blake3" else hashlib.sha256()
            state.update(head)
            for batch in batches:
                state.update(b"".join(batch.column("entry").to_pylist()))
            yield pa.RecordBatch.from_pydict({"root": [state.digest()]})

        root = bytes(once.repartition(1).sortWithinPartitions(*order).select("entry").mapInArrow(stream, "root binary").first()["root"])
    else:
        root = hash_many([head])[0] if alg == "blake3" else hashlib.sha256(head).digest()
    return differences.sparkSession.createDataFrame([(added, removed, root.hex())], "added long, removed long, diff_root string")


def verify_link(link: DataFrame) -> DataFrame:
    """``link(child_parent_root, parent_root, stated_diff_root, diff_root)``, one row a child, with ``verdict``; the order of checks is fixed."""
    c = F.col
    return link.withColumn("verdict", F.when(c("child_parent_root").isNull(), "no-parent").when(c("child_parent_root") != c("parent_root"), "parent-mismatch").when(c("stated_diff_root").isNull(), "no-diff").when(c("stated_diff_root") != c("diff_root"), "diff-mismatch").otherwise("valid"))
