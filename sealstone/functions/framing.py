"""Byte layouts of digests, built from native expressions. The hash is a parameter: ``blake3`` is the protocol's own,
``sha256`` is this engine's extension, native in the JVM and in SQL, and not compatible with the protocol."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Domain prefixes of the protocol.
KEY, SHARD_PREFIX, NODE, EMPTY_LEAF, LEAF = b"OLY:KEY:V1", b"OLY:SHARD-PREFIX:V1", b"OLY:NODE:V1", b"OLY:EMPTY-LEAF:V1", b"\x01OLY\x01\x01"
DIFF, GLOBAL_ROOT, PERSIST, SMT_ROOT = b"OLY:MANIFEST:DIFF:V1", b"OLY:GLOBAL_ROOT:V1", b"OLY:SNAPSHOT:PERSIST:V1", b"OLY:SMT:ROOT:V1"
REDACTION_BUNDLE, REDACTION_NULLIFIER = b"OLY:REDACTION_BUNDLE:V3", b"OLY:REDACTION:NULLIFIER:V1"
REDACTION_TABLE, REDACTION_OBJECT, LEGACY_LEAF = b"OLY:REDACTION:TABLE:V3", b"OLY:REDACTION:OBJ:V1", b"OLY:LEAF:V1"
SEPARATOR = b"|"


def joined(*parts: Column | bytes) -> Column:
    """Binary concatenation; null if a part is null."""
    return reduce(lambda a, b: F.concat(a, b), [F.lit(p) if isinstance(p, bytes) else p.cast("binary") for p in parts])


def u32(x: Column) -> Column:
    return F.unhex(F.lpad(F.hex(x.cast("long")), 8, "0"))


def u64(x: Column) -> Column:
    return F.unhex(F.lpad(F.hex(x.cast("long")), 16, "0"))


def lp(x: Column) -> Column:
    """A field with its length before it, four bytes, big-endian."""
    b = x.cast("binary")
    return F.concat(u32(F.octet_length(b)), b)


def digest(message: Column, alg: str) -> Column:
    if alg == "sha256":
        return F.unhex(F.sha2(message, 256))
    if alg == "blake3":
        from sealstone.functions.blake3 import blake3

        return blake3(message)
    raise ValueError(alg)


def record_key(record_type: Column, record_id: Column, version: Column, alg: str) -> Column:
    return digest(joined(KEY, lp(record_type), lp(record_id), u64(version)), alg)


def tree_key(shard_id: Column, record_type: Column, record_id: Column, version: Column, alg: str) -> Column:
    """First 8 bytes by shard, then the first 24 of the record's key."""
    prefix = digest(joined(SHARD_PREFIX, shard_id), alg)
    return F.concat(F.substring(prefix, 1, 8), F.substring(record_key(record_type, record_id, version, alg), 1, 24))


def leaf_hash(shard_id: Column, key: Column, value_hash: Column, parser_id: Column, parser_version: Column, model_hash: Column, alg: str) -> Column:
    return digest(joined(LEAF, lp(shard_id), b"\x05", lp(key), value_hash, lp(parser_id), lp(parser_version), lp(model_hash)), alg)
