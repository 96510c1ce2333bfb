"""The sparse Merkle tree over a dataset: seal, prove, verify, extend, in bulk.

Leaf rows are made once and written. The tree is then climbed in four steps, each a shuffle by the node at its upper end: leaves to buckets (nodes told apart by bits below
the shard's, so a hot shard is many buckets), buckets to shards, shards to the 65,536 nodes of two bytes at most, and these to the root. Within a step nodes are
folded a level of all of them at a time, and what is asked for is given its siblings on the way. Nothing depends on the order of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from sealstone.functions import framing
from sealstone.functions.batches import give_back
from sealstone.functions.blake3 import hash_equal, hash_many
from sealstone.functions.framing import leaf_hash, tree_key
from sealstone.sources.files import write_once
from sealstone.sources.tables import table

DEPTH, SHARD_BITS = 256, 64
#: Leaves of a bucket, about, and of a task where there are so many.
BUCKET, TASK = 1024, 32_768
#: Proofs that are folded at once.
FOLDED = 2048
DEFAULTS = {"record_type": "dataset-record", "parser_id": "manifest@v1", "parser_version": "v1", "model_hash": "none"}


def many(messages: list[bytes], alg: str) -> list[bytes]:
    return hash_many(messages) if alg == "blake3" else [hashlib.sha256(m).digest() for m in messages]


def nodes(left: np.ndarray, right: np.ndarray, alg: str) -> np.ndarray:
    """Inner nodes over ``uint8[n, 32]`` children."""
    n = len(left)
    block = np.empty((n, 77), np.uint8)
    block[:, :12] = np.frombuffer(framing.NODE + framing.SEPARATOR, np.uint8)
    block[:, 12:44], block[:, 44], block[:, 45:] = left, 0x7C, right
    if alg == "blake3":
        return hash_equal(block)
    raw = block.tobytes()
    return np.frombuffer(b"".join(many([raw[i : i + 77] for i in range(0, 77 * n, 77)], alg)), np.uint8).reshape(n, 32) if n else np.zeros((0, 32), np.uint8)


@cache
def empties(alg: str) -> np.ndarray:
    """Root of an empty subtree of each height, ``uint8[257, 32]``."""
    out = np.empty((DEPTH + 1, 32), np.uint8)
    out[0] = np.frombuffer(many([framing.EMPTY_LEAF], alg)[0], np.uint8)
    for h in range(1, DEPTH + 1):
        out[h] = nodes(out[h - 1 : h], out[h - 1 : h], alg)[0]
    return out


def bits_of(keys: np.ndarray) -> np.ndarray:
    return np.unpackbits(keys, axis=1)


def fold(keys: np.ndarray, hashes: np.ndarray, low: int, high: int, alg: str, visit: Callable[[int, np.ndarray, np.ndarray], None] | None = None, split: Callable[[int, np.ndarray, np.ndarray, np.ndarray], None] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """From nodes at depth ``low`` (distinct prefixes in key order) to those at depth ``high``: first row of each, and hash.

    ``visit(depth, first, hash)`` sees each level, the lowest included; ``split(depth, first, left, right)`` the nodes with leaves on both sides, with their children's hashes."""
    bits, first, none = bits_of(keys), np.arange(len(keys)), empties(alg)
    for depth in range(low, high, -1):
        if visit:
            visit(depth, first, hashes)
        side = bits[first, depth - 1]
        same = np.zeros(len(first), bool)  # the next node is this one's right sibling
        same[:-1] = (side[:-1] == 0) & (side[1:] == 1)
        i = np.flatnonzero(same)
        if len(i):
            same[i] = (bits[first[i], : depth - 1] == bits[first[i + 1], : depth - 1]).all(axis=1)
        right_of = np.zeros(len(first), bool)
        right_of[1:] = same[:-1]
        keep = np.flatnonzero(~right_of)
        left, right = hashes[keep].copy(), np.repeat(none[DEPTH - depth][None], len(keep), axis=0)
        pair = same[keep]
        right[pair] = hashes[keep[pair] + 1]
        if split and pair.any():
            split(depth - 1, first[keep[pair]], left[pair], right[pair])
        alone = ~pair & (side[keep] == 1)
        right[alone], left[alone] = left[alone], none[DEPTH - depth]
        first, hashes = first[keep], nodes(left, right, alg)
    if visit:
        visit(high, first, hashes)
    return first, hashes


def _matrix(column, width: int = 32) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x) for x in column), np.uint8).reshape(-1, width)


def leaves(records: DataFrame, alg: str, **names: str) -> DataFrame:
    """Records (shard_id, record_id, version, content_hash hex) with ``key``, ``value_hash``, ``leaf``."""
    n = DEFAULTS | names
    key = tree_key(F.col("shard_id"), F.lit(n["record_type"]), F.col("record_id"), F.col("version"), alg)
    keyed = records.withColumn("value_hash", F.unhex("content_hash")).withColumn("key", key)
    return keyed.withColumn("leaf", leaf_hash(F.col("shard_id"), F.col("key"), F.col("value_hash"), F.lit(n["parser_id"]), F.lit(n["parser_version"]), F.lit(n["model_hash"]), alg))


def layout(most: int, size: int | None = None) -> int:
    """Bits below the shard's that buckets are told apart by, for so many leaves in the largest shard."""
    size = size or BUCKET
    return min(128, max(0, int(most - 1).bit_length() - int(size).bit_length() + 1)) if most > size else 0


def prefix(key: str, depth: int) -> Column:
    """The first ``depth`` bits of a key, as whole bytes with zeros behind."""
    whole, rest = divmod(depth, 8)
    if not rest:
        return F.substring(key, 1, whole) if whole else F.lit(b"")
    last = F.conv(F.hex(F.substring(key, whole + 1, 1)), 16, 10).cast("int")
    return F.concat(F.substring(key, 1, whole), F.unhex(F.lpad(F.hex(last.bitwiseAND(256 - (1 << (8 - rest))).cast("long")), 2, "0")))


def _cut(key: bytes, depth: int) -> bytes:
    mask = (1 << (DEPTH - depth)) - 1
    return (int.from_bytes(key, "big") & ~mask).to_bytes(32, "big")


def pack_bits(bits: Sequence[int]) -> bytes:
    """A partial path as bytes, first bit highest, zeros behind; its length is kept apart."""
    if any(b not in (0, 1) for b in bits):
        raise ValueError("a path holds bits alone")
    return np.packbits(np.asarray(bits, np.uint8)).tobytes()


def unpack_bits(raw: bytes, n: int) -> list[int]:
    """The first ``n`` bits of a packed path; what is behind them is not looked at."""
    return np.unpackbits(np.frombuffer(raw, np.uint8))[:n].tolist()


def shard_prefix(shard_id: Column, alg: str) -> Column:
    """The first 8 bytes of all keys of a shard."""
    return F.substring(framing.digest(framing.joined(framing.SHARD_PREFIX, shard_id), alg), 1, 8)


def shard_matches_key(shard_id: Column, key: Column, alg: str) -> Column:
    """Whether a key is of that shard."""
    return F.substring(key, 1, 8) == shard_prefix(shard_id, alg)


CLIMBED = "key binary, hash binary, depth int, left binary, right binary, siblings binary"


def _fixed(rows: np.ndarray) -> pa.Array:
    """``uint8[n, width]`` as a binary column."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int64) * width), pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _flat(column: pa.ChunkedArray, width: int = 32) -> np.ndarray:
    """A binary column of one width as ``uint8[n, width]``."""
    column = column.combine_chunks()
    _, off, data = column.buffers()
    if not len(column):
        return np.zeros((0, width), np.uint8)
    begin = int(np.frombuffer(off, np.int32)[column.offset])
    out = np.frombuffer(data, np.uint8)[begin : begin + width * len(column)]
    return out.reshape(-1, width)


def _as_text(keys: np.ndarray) -> np.ndarray:
    """Keys as fixed byte strings, in whose order they can be looked up."""
    return np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").ravel()


def cut(keys: np.ndarray, depth: np.ndarray | int) -> np.ndarray:
    """The first ``depth`` bits of each key, zeros behind."""
    if isinstance(depth, int):
        out = keys.copy()
        out[:, -(-depth // 8) :] = 0
        if depth % 8:
            out[:, depth // 8] &= 256 - (1 << (8 - depth % 8))
        return out
    return np.packbits(np.where(np.arange(DEPTH) < depth[:, None], bits_of(keys), 0), axis=1)


def climb(nodes_: DataFrame, asked: DataFrame | None, low: int, high: int, alg: str, tasks: int, splits: bool = False) -> DataFrame:
    """From nodes (key, hash) at depth ``low`` to those at ``high``: rows (key, hash) of nodes, keys cut at ``high``; for each asked key (cut at ``low``) a row
    with its ``siblings`` from ``low`` up to ``high``; and with ``splits`` a row (key cut at ``depth``, depth, left, right) for each node between that has leaves on both sides."""

    def run(own: pa.Table, queries: pa.Table | None = None) -> pa.Table:
        keys, hashes, none = _flat(own.column("key")), _flat(own.column("hash")), empties(alg)
        order = np.argsort(_as_text(keys), kind="stable")
        keys, hashes = keys[order], hashes[order]
        text = _as_text(keys)
        if (text[1:] == text[:-1]).any():
            raise ValueError("two records have one key")
        asked_keys = np.unique(_as_text(_flat(queries.column("key")))) if queries is not None else np.zeros(0, "S32")
        wanted = np.ascontiguousarray(asked_keys).view(np.uint8).reshape(-1, 32)
        siblings = np.repeat(none[None, DEPTH - low : DEPTH - high], len(asked_keys), axis=0).copy()
        side = bits_of(wanted)
        held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []

        def visit(depth: int, first: np.ndarray, level: np.ndarray) -> None:
            """Where the other child of an asked key's node at the depth above is there, its hash is the sibling."""
            if depth == high or not len(wanted):
                return
            there = _as_text(cut(keys[first], depth))
            other = cut(wanted, depth)
            other[:, (depth - 1) // 8] ^= np.uint8(128 >> (depth - 1) % 8)
            other = _as_text(other)
            at = np.minimum(np.searchsorted(there, other), len(there) - 1)
            found = np.flatnonzero(there[at] == other)
            siblings[found, low - depth] = level[at[found]]

        out_keys, out_hashes = np.zeros((0, 32), np.uint8), np.zeros((0, 32), np.uint8)
        if len(keys):
            first, out_hashes = fold(keys, hashes, low, high, alg, visit, (lambda depth, first, left, right: held.append((depth, cut(keys[first], depth), left, right))) if splits else None)
            out_keys = cut(keys[first], high)
        n, m, k = len(out_keys), len(wanted), sum(len(x[1]) for x in held)
        gap = lambda n: pa.nulls(n, pa.binary())
        stack = lambda i: np.concatenate([x[i] for x in held]) if held else np.zeros((0, 32), np.uint8)
        column = lambda *parts: pa.chunked_array(list(parts))
        depths = np.repeat([x[0] for x in held], [len(x[1]) for x in held]) if held else np.zeros(0)
        return pa.table({
            "key": column(_fixed(out_keys), _fixed(wanted), _fixed(stack(1))), "hash": column(_fixed(out_hashes), gap(m), gap(k)), "depth": column(pa.nulls(n + m, pa.int32()), pa.array(depths.astype(np.int32))),
            "left": column(gap(n + m), _fixed(stack(2))), "right": column(gap(n + m), _fixed(stack(3))), "siblings": column(gap(n), _fixed(siblings.reshape(m, 32 * (low - high))), gap(k)),
        })

    task = F.pmod(F.xxhash64(prefix("key", high)), F.lit(tasks)).alias("task")
    # By number, for the work is far more than the bytes by which Spark would put small partitions together.
    dealt = lambda t: t.repartition(tasks, "task").groupBy("task")
    placed = dealt(nodes_.select("key", "hash", task))
    if asked is None:
        return placed.applyInArrow(lambda own: run(own), CLIMBED)
    return placed.cogroup(dealt(asked.select("key", task))).applyInArrow(lambda own, queries: run(own, queries), CLIMBED)


#: Depth below which a stored tree keeps branches only where there are many.
CANOPY = 72
#: Depths at which the tree is cut above the buckets: shards, two bytes, root.
STEPS = (SHARD_BITS, 16, 0)


@dataclass
class Tree:
    """A sealed dataset as tables: leaves (shard_id, record_id, version, key, value_hash, leaf, byte_size), bucket roots (key, hash) at depth 64 + bits, and
    below these the nodes with leaves on both sides (key cut at depth, depth, left, right): the tree with its lone paths left out, one row less than leaves in each bucket."""

    leaves: DataFrame
    buckets: DataFrame
    branches: DataFrame
    bits: int
    alg: str
    #: Of a stored tree: leaves and branches lie in folders by ``part_of`` their keys; and the canopies whose deep branches were kept.
    kept: DataFrame | None = None

    @property
    def low(self) -> int:
        return SHARD_BITS + self.bits

    def near(self, rows: DataFrame, keys: DataFrame) -> DataFrame:
        """Rows of the leaves or branches that may be in a bucket with some of ``keys``: of a stored tree those of the folders that these fall into, of which there are 4,096 at most."""
        if self.kept is None:
            return rows
        return rows.filter(F.col("part").isin([x[0] for x in keys.select(part_of("key", self.bits)).distinct().collect()]))

    def branches_for(self, keys: DataFrame) -> DataFrame:
        """Branches (key, depth, left, right) of all buckets that ``keys`` fall into. Those that were left out of a stored tree are made again from the leaves of their canopies."""
        own = self.near(self.branches, keys).select("key", "depth", "left", "right")
        if self.kept is None:
            return own
        high = max(CANOPY, self.low)
        canopy = F.substring("key", 1, CANOPY // 8).alias("canopy")
        gone = table(keys.select(canopy).distinct().join(self.kept, "canopy", "left_anti"), "left-out")
        rows = self.near(self.leaves, keys).withColumn("canopy", canopy).join(gone, "canopy", "left_semi").select("key", F.col("leaf").alias("hash"))
        again = climb(rows, None, DEPTH, high, self.alg, self._tasks(rows.count()), True)
        return own.union(again.filter("depth is not null").select("key", "depth", "left", "right"))

    def store(self, path: str, most: int = 1024) -> None:
        """Write the tree into a folder, for ``load``. Branches deeper than a canopy (the nine first bytes of a key) stay only where it has more than ``most`` leaves: the others are made again when they are asked for."""
        part = part_of("key", self.bits).alias("part")
        canopy = F.substring("key", 1, CANOPY // 8).alias("canopy")
        kept = table(self.leaves.groupBy(canopy).agg(F.count("*").alias("leaves")).filter(F.col("leaves") > most).select("canopy"), "canopies")
        shallow = self.branches.filter(F.col("depth") < CANOPY)
        deep = self.branches.filter(F.col("depth") >= CANOPY).withColumn("canopy", canopy).join(kept, "canopy", "left_semi").select("key", "depth", "left", "right")
        branches = shallow.select("key", "depth", "left", "right").union(deep)
        for rows, name in ((self.leaves.drop("part"), "leaves"), (branches, "branches")):
            rows.withColumn("part", part).repartition("part", F.pmod(F.xxhash64("key"), F.lit(8))).write.partitionBy("part").parquet(f"{path}/{name}")
        self.buckets.write.parquet(f"{path}/buckets")
        kept.write.parquet(f"{path}/canopies")
        self.leaves.sparkSession.createDataFrame([(self.bits, self.alg)], "bits int, alg string").write.parquet(f"{path}/facts")

    def _tasks(self, rows: int, each: int = TASK) -> int:
        wide = int(self.leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return max(1, min(4 * wide, -(-rows // 512)), -(-rows // each))

    def up(self, asked: DataFrame | None = None) -> list[DataFrame]:
        """What each step above the buckets gives, shards first; ``asked``: keys."""
        out, nodes_, low = [], self.buckets, SHARD_BITS + self.bits
        wide = int(self.leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        for high in STEPS:
            wanted = asked.select(_padded("key", low).alias("key")).distinct() if asked is not None else None
            step = climb(nodes_, wanted, low, high, self.alg, 1 if high == 0 else wide)
            step = table(step, f"tree-{high}") if asked is not None else step
            out.append(step)
            nodes_, low = step.filter("hash is not null").select("key", "hash"), high
        return out

    def seal(self) -> DataFrame:
        """A row for each shard: shard_id, shard_root, record_count, byte_size, manifest_root (hex). An empty dataset has no rows; its root is ``empties(alg)[256]``."""
        shards = table(self.up()[0], "shard-roots")
        named = self.leaves.groupBy("shard_id").agg(F.count("*").alias("record_count"), F.sum("byte_size").alias("byte_size")).withColumn("key", F.rpad(shard_prefix(F.col("shard_id"), self.alg), 32, b"\0"))
        low, nodes_ = SHARD_BITS, shards
        for high in STEPS[1:]:
            nodes_ = climb(nodes_, None, low, high, self.alg, 1 if high == 0 else int(self.leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")))
            low = high
        whole = nodes_.select(F.lower(F.hex("hash")).alias("manifest_root"))  # one row
        return named.join(shards.select("key", "hash"), "key").select("shard_id", F.lower(F.hex("hash")).alias("shard_root"), "record_count", "byte_size").join(F.broadcast(whole))

    def root(self) -> str:
        """The root, hex."""
        got = self.up()[-1].first()
        return bytes(got["hash"] if got else empties(self.alg)[DEPTH]).hex()


LEAVES = "shard_id string, record_id string, version long, key binary, value_hash binary, leaf binary, byte_size long, part string"


def load(spark: SparkSession, path: str) -> Tree:
    """A stored tree. What is asked of it reads the folders that the keys fall into alone."""
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
    bits, alg = read("facts", "bits int, alg string").first()
    return Tree(read("leaves", LEAVES), read("buckets", "key binary, hash binary"), read("branches", "key binary, depth int, left binary, right binary, part string"), bits, alg, read("canopies", "canopy binary"))


def part_of(key: str, bits: int) -> Column:
    """Folder of a key: its first byte, and up to four bits behind the shard's, so that a hot shard is several and no bucket is in two."""
    behind = F.hex(F.substring(prefix(key, SHARD_BITS + min(bits, 4)), 9, 1)) if bits else F.lit("")
    return F.concat(F.hex(F.substring(key, 1, 1)), F.lit("-"), behind)


def _padded(key: str, depth: int) -> Column:
    """A key cut at a depth, 32 bytes."""
    return F.rpad(prefix(key, depth), 32, b"\0") if depth < DEPTH else F.col(key)


def build(records: DataFrame, alg: str = "blake3", **names: str) -> Tree:
    """The tree of a dataset. Fails on a repeated identity when it is first read."""
    has = "byte_size" in records.columns
    rows = table(leaves(records, alg, **names).select("shard_id", "record_id", "version", "key", "value_hash", "leaf", (F.col("byte_size") if has else F.lit(None)).cast("long").alias("byte_size")), "leaves")
    most, total = rows.groupBy("shard_id").count().agg(F.max("count"), F.sum("count")).first()
    bits = layout(most or 0)
    tree = Tree(rows, rows, rows, bits, alg)
    tree.buckets, tree.branches = _below(rows.select("key", F.col("leaf").alias("hash")), bits, alg, tree._tasks(total or 0))
    return tree


def _below(leaf_nodes: DataFrame, bits: int, alg: str, tasks: int) -> tuple[DataFrame, DataFrame]:
    """Bucket roots and branches over leaves (key, hash)."""
    climbed = table(climb(leaf_nodes, None, DEPTH, SHARD_BITS + bits, alg, tasks, True).drop("siblings"), "buckets")
    return climbed.filter("hash is not null").select("key", "hash"), climbed.filter("depth is not null").select("key", "depth", "left", "right")


def extend(tree: Tree, records: DataFrame, **names: str) -> Tree:
    """The tree with more records. Write-once: a key that holds another value stops the job, one that holds the same is left alone. Only buckets that new leaves fall into are folded again."""
    fresh = leaves(records, tree.alg, **names).select("shard_id", "record_id", "version", "key", "value_hash", "leaf", (F.col("byte_size") if "byte_size" in records.columns else F.lit(None)).cast("long").alias("byte_size"))
    stored, low = tree.kept is not None, tree.low
    fresh = table(fresh.withColumn("part", part_of("key", tree.bits)) if stored else fresh, "fresh-leaves")
    old = tree.near(tree.leaves, fresh)
    new = table(write_once(old.select("key", "value_hash"), fresh), "new-leaves")
    touched = table(new.select(_padded("key", low).alias("bucket")).distinct(), "touched")
    inside = tree.near(tree.leaves, new).withColumn("bucket", _padded("key", low)).join(touched, "bucket", "left_semi").select("key", F.col("leaf").alias("hash"))
    again = inside.union(new.select("key", F.col("leaf").alias("hash")))
    buckets, branches = _below(again, tree.bits, tree.alg, tree._tasks(again.count()))
    kept = tree.buckets.join(touched, tree.buckets["key"] == touched["bucket"], "left_anti")
    if stored:
        branches = branches.withColumn("part", part_of("key", tree.bits))
    apart = tree.branches.withColumn("bucket", _padded("key", low)).join(touched, "bucket", "left_anti").drop("bucket")
    return Tree(tree.leaves.unionByName(new), table(kept.union(buckets), "buckets"), apart.unionByName(branches) if stored else table(apart.unionByName(branches), "branches"), tree.bits, tree.alg, tree.kept)


def seal(records: DataFrame, alg: str = "blake3", **names: str) -> DataFrame:
    """``Tree.seal`` of the records. Fails on a repeated identity."""
    return build(records, alg, **names).seal()


def prove(records: DataFrame | Tree, wanted: DataFrame, alg: str = "blake3", **names: str) -> DataFrame:
    """For each wanted (shard_id, record_id, version) a proof, whether its record is there or not.

    Adds ``key``, ``kind`` (inclusion or exclusion), ``content_hash`` (null if not there), ``siblings`` (256 * 32 bytes from the leaf up), ``shard_root``, ``manifest_root``."""
    n = DEFAULTS | names
    tree = records if isinstance(records, Tree) else build(records, alg, **names)
    alg, low = tree.alg, tree.low
    asked = table(wanted.withColumn("key", tree_key(F.col("shard_id"), F.lit(n["record_type"]), F.col("record_id"), F.col("version"), alg)), "asked")
    # Above the buckets: the siblings of every bucket that is asked for, and its shard's root.
    shards, two, top = tree.up(asked)
    above = shards.filter("siblings is not null").select("key", F.col("siblings").alias("s1"))
    for i, (step, depth) in enumerate(((two, SHARD_BITS), (top, 16)), 2):
        more = step.filter("siblings is not null").select(F.col("key").alias("cut"), F.col("siblings").alias(f"s{i}"))
        above = above.withColumn("cut", _padded("key", depth)).join(more, "cut").drop("cut")
    shard_roots = shards.filter("hash is not null").select(F.col("key").alias("cut"), F.col("hash").alias("shard_root"))
    above = above.withColumn("cut", _padded("key", SHARD_BITS)).join(shard_roots, "cut", "left")
    own = F.coalesce("shard_root", F.lit(empties(alg)[DEPTH - SHARD_BITS].tobytes()))
    root = top.filter("hash is not null").agg(F.max("hash").alias("root")).select(F.lower(F.hex(F.coalesce("root", F.lit(empties(alg)[DEPTH].tobytes())))).alias("manifest_root"))
    none = F.lit(None).cast("binary")
    leaf_rows = tree.near(tree.leaves, asked)
    rows = leaf_rows.select("key", F.lit(DEPTH).alias("depth"), F.col("leaf").alias("left"), F.col("value_hash").alias("right"))
    rows = rows.union(tree.branches_for(asked)).union(above.select("key", F.lit(-1), F.concat("s1", "s2", "s3"), own))
    # A proof is some 8 kB, so asked keys bound the tasks as leaves do.
    tasks = max(tree._tasks(leaf_rows.count()), -(-asked.count() // 2048))
    task = F.pmod(F.xxhash64(prefix("key", low)), F.lit(tasks)).alias("task")
    dealt = lambda t: t.withColumn("task", task).repartition(tasks, "task").groupBy("task")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema)
    proofs = dealt(rows).cogroup(dealt(asked)).applyInArrow(_prover(low, alg, asked.columns), f"{fields}, value binary, siblings binary, shard_root binary")
    kind = F.when(F.col("value").isNull(), "exclusion").otherwise("inclusion")
    return proofs.join(F.broadcast(root)).select(*wanted.columns, "key", kind.alias("kind"), F.lower(F.hex("value")).alias("content_hash"), "siblings", F.lower(F.hex("shard_root")).alias("shard_root"), "manifest_root")


def lone(keys: np.ndarray, hashes: np.ndarray, low: np.ndarray, high: np.ndarray, alg: str) -> np.ndarray:
    """Nodes at depths ``high`` over single nodes at depths ``low`` of these keys, beside which all is empty."""
    out, bits, none = hashes.copy(), bits_of(keys), empties(alg)
    for depth in range(int(low.max(initial=0)), int(high.min(initial=DEPTH)), -1):
        on = np.flatnonzero((depth <= low) & (depth > high))
        if len(on):
            right = (bits[on, depth - 1] == 1)[:, None]
            out[on] = nodes(np.where(right, none[DEPTH - depth], out[on]), np.where(right, out[on], none[DEPTH - depth]), alg)
    return out


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that two keys have in common at their beginning."""
    apart = bits_of(a ^ b)
    return np.where(apart.any(axis=1), apart.argmax(axis=1), DEPTH)


def _prover(low: int, alg: str, columns: list[str]):
    """For ``applyInArrow`` on the rows of some buckets (leaves at depth 256, branches, and at -1 what lies above a bucket) and the asked rows there.

    Siblings are read off the branches. Only beside a key that is not there, and branches off within a lone path, a node is made anew: that path is folded from its lower end."""

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        none, m = empties(alg), asked.num_rows
        depth = own.column("depth").to_numpy()
        part = lambda which: own.filter(pa.array(which))
        leaf_rows, above = part(depth == DEPTH), part(depth < 0)
        keys, leaf, value = (_flat(leaf_rows.column(c)) for c in ("key", "left", "right"))
        order = np.argsort(_as_text(keys), kind="stable")
        keys, leaf, value = keys[order], leaf[order], value[order]
        text, query = _as_text(keys), _flat(asked.column("key"))
        query_text, side = _as_text(query), bits_of(query)
        siblings = np.repeat(none[None, :DEPTH], m, axis=0).copy()
        top = {bytes(k): i for i, k in enumerate(above.column("key").to_pylist())}
        place = np.array([top[x.tobytes()] for x in cut(query, low)], np.int64)
        upper, roots = _flat(above.column("left"), 32 * low), _flat(above.column("right"))
        if m:
            siblings[:, DEPTH - low :] = upper[place].reshape(m, low, 32)
        held = {}
        for d in np.unique(depth[(depth >= 0) & (depth < DEPTH)]).tolist():
            rows = part(depth == d)
            k, left, right = (_flat(rows.column(c)) for c in ("key", "left", "right"))
            order = np.argsort(_as_text(k), kind="stable")
            held[d] = k, left, right = _as_text(k[order]), left[order], right[order]
            own_cut = _as_text(cut(query, d))
            at = np.minimum(np.searchsorted(k, own_cut), len(k) - 1)
            on = np.flatnonzero(k[at] == own_cut)
            siblings[on, DEPTH - 1 - d] = np.where((side[on, d] == 0)[:, None], right[at[on]], left[at[on]])
        found = np.zeros(m, bool)
        values = np.zeros((m, 32), np.uint8)
        if len(keys) and m:
            at = np.minimum(np.searchsorted(text, query_text), len(text) - 1)
            found = text[at] == query_text
            values = value[at]
            # The leaf that has most in common with a key that is not there is one of its neighbours.
            off = np.flatnonzero(~found)
            after, before = at[off], np.maximum(at[off] - 1, 0)
            a, b = _alike(query[off], keys[after]), _alike(query[off], keys[before])
            near, common = np.where(a >= b, after, before), np.maximum(a, b)
            off, near, common = (x[common >= low] for x in (off, near, common))
            if len(off):
                # The node beside it, at the depth where they part: over one leaf, or from the first branch below on.
                begin = cut(keys[near], common + 1)
                last = begin | np.packbits(np.arange(DEPTH) >= (common + 1)[:, None], axis=1)
                lo, hi = np.searchsorted(text, _as_text(begin)), np.searchsorted(text, _as_text(last), side="right") - 1
                bottom = _alike(keys[lo], keys[hi])
                start = leaf[lo].copy()
                for d in np.unique(bottom[bottom < DEPTH]).tolist():
                    on = np.flatnonzero(bottom == d)
                    k, left, right = held[d]
                    i = np.searchsorted(k, _as_text(cut(keys[lo[on]], d)))
                    start[on] = nodes(left[i], right[i], alg)
                siblings[off, DEPTH - 1 - common] = lone(keys[lo], start, bottom, common + 1, alg)
        out = {c: asked.column(c) for c in columns}
        return pa.table(out | {"value": pa.array([v.tobytes() if f else None for v, f in zip(values, found, strict=True)], pa.binary()), "siblings": _fixed(siblings.reshape(m, DEPTH * 32)), "shard_root": _fixed(roots[place] if m else np.zeros((0, 32), np.uint8))})

    return run


def folded(key: Column, start: Column, siblings: Column, levels: int, alg: str) -> Column:
    """The node ``levels`` above a leaf (null: an empty one) that its siblings from the leaf up lead to; null if there are not so many siblings."""

    def some(keys: list, start: list, siblings: list) -> pa.Array:
        none, n = empties(alg), len(keys)
        good = [len(s or b"") == 32 * levels for s in siblings]
        state = np.frombuffer(b"".join(none[0].tobytes() if x is None else x for x in start), np.uint8).reshape(n, 32)
        path = np.frombuffer(b"".join(s if g else bytes(32 * levels) for s, g in zip(siblings, good, strict=True)), np.uint8).reshape(n, levels, 32)
        bits = bits_of(_matrix(keys))
        for level in range(levels):
            right = (bits[:, DEPTH - 1 - level] == 1)[:, None]
            state = nodes(np.where(right, path[:, level], state), np.where(right, state, path[:, level]), alg)
        return pa.array([s.tobytes() if g else None for s, g in zip(state, good, strict=True)], pa.binary())

    @F.arrow_udf(BinaryType())
    def run(keys: pa.Array, start: pa.Array, siblings: pa.Array) -> pa.Array:
        """Siblings of a row are some 8 kB: few rows are copied at a time."""
        out = [some(*(x.slice(at, FOLDED).to_pylist() for x in (keys, start, siblings))) for at in range(0, len(keys), FOLDED)]
        give_back()
        return pa.concat_arrays(out) if out else pa.array([], pa.binary())

    return run(key, start, siblings)


def _verified(proofs: DataFrame, expected: Column, stated: Column, siblings: Column, levels: int, alg: str, **names: str) -> DataFrame:
    n = DEFAULTS | names
    key = tree_key(F.col("shard_id"), F.lit(n["record_type"]), F.col("record_id"), F.col("version"), alg)
    committed = F.col("committed_hash") if "committed_hash" in proofs.columns else F.col("content_hash")
    leaf = leaf_hash(F.col("shard_id"), F.col("key"), F.unhex(committed), F.lit(n["parser_id"]), F.lit(n["parser_version"]), F.lit(n["model_hash"]), alg)
    there = F.col("kind") == "inclusion"
    checked = proofs.withColumn("expected_key_", key).withColumn("start_", F.when(there, leaf))
    checked = checked.withColumn("folded_", folded(F.col("key"), F.col("start_"), siblings, levels, alg))
    verdict = (
        F.when(~stated.eqNullSafe(expected), "root-mismatch")
        .when(~F.col("kind").isin("inclusion", "exclusion"), "kind-mismatch")
        .when(F.col("key") != F.col("expected_key_"), "key-mismatch")
        .when(there & ~committed.eqNullSafe(F.col("content_hash")), "content-mismatch")
        .when(F.lower(F.hex("folded_")).eqNullSafe(expected), "valid")
        .otherwise("proof-invalid")
    )
    return checked.withColumn("verdict", verdict).drop("expected_key_", "start_", "folded_")


def verify(proofs: DataFrame, expected_root: str, alg: str = "blake3", **names: str) -> DataFrame:
    """Adds ``verdict``: the first check that fails, in the order root, kind, key, content, fold; or valid.

    ``committed_hash`` (hex), if there, is the value that the proof's leaf holds; else it is the content hash stated."""
    return _verified(proofs, F.lit(expected_root), F.col("manifest_root"), F.col("siblings"), DEPTH, alg, **names)


def verify_in_shard(proofs: DataFrame, shards: DataFrame, alg: str = "blake3", **names: str) -> DataFrame:
    """``verify`` against the root of the record's shard alone: ``shards(shard_id, shard_root)``, hex, a row a shard. Only the lower siblings are folded; a shard that is not known has no root to match."""
    known = shards.select("shard_id", F.col("shard_root").alias("expected_"))
    own = proofs.join(known, "shard_id", "left")
    return _verified(own, F.coalesce("expected_", F.lit("")), F.col("shard_root"), F.substring("siblings", 1, 32 * (DEPTH - SHARD_BITS)), DEPTH - SHARD_BITS, alg, **names).drop("expected_").select(*proofs.columns, "verdict")


def verify_changes(changes: DataFrame, before: DataFrame, after: DataFrame, parent_root: str, child_root: str, alg: str = "blake3", **names: str) -> DataFrame:
    """``changes(kind 0 removed or 1 added, shard_id, record_id, version, content_hash)`` with ``verdict``, by two proofs of the same record, under the parent's and the child's root.

    A removed record is included before, with the hash stated, and excluded after; an added one the other way round. The first that fails: no-proof, the parent's proof, the child's, wrong-sides, content-mismatch; or valid."""
    by = ["shard_id", "record_id", "version"]
    sides = [verify(p, root, alg, **names).select(*by, F.col("kind").alias(f"kind_{s}"), F.col("content_hash").alias(f"hash_{s}"), F.col("verdict").alias(f"verdict_{s}")) for s, p, root in (("a", before, parent_root), ("b", after, child_root))]
    rows = changes.join(sides[0], by, "left").join(sides[1], by, "left")
    removed = F.col("kind") == 0
    held = F.when(removed, F.col("hash_a")).otherwise(F.col("hash_b"))
    right = F.when(removed, (F.col("kind_a") == "inclusion") & (F.col("kind_b") == "exclusion")).otherwise((F.col("kind_a") == "exclusion") & (F.col("kind_b") == "inclusion"))
    verdict = (
        F.when(F.col("verdict_a").isNull() | F.col("verdict_b").isNull(), "no-proof")
        .when(F.col("verdict_a") != "valid", F.concat(F.lit("parent-"), "verdict_a"))
        .when(F.col("verdict_b") != "valid", F.concat(F.lit("child-"), "verdict_b"))
        .when(~right, "wrong-sides")
        .when(~held.eqNullSafe(F.col("content_hash")), "content-mismatch")
        .otherwise("valid")
    )
    return rows.select(*changes.columns, verdict.alias("verdict"))


def reference_root(pairs: dict[bytes, bytes], alg: str = "blake3", depth: int = 0) -> bytes:
    """Root over key to leaf hash by recursion, for tests and for few leaves."""
    if not pairs:
        return empties(alg)[DEPTH - depth].tobytes()
    if depth == DEPTH:
        return next(iter(pairs.values()))
    bit = lambda k: k[depth // 8] >> (7 - depth % 8) & 1
    left, right = ({k: v for k, v in pairs.items() if bit(k) == side} for side in (0, 1))
    return many([framing.NODE + b"|" + reference_root(left, alg, depth + 1) + b"|" + reference_root(right, alg, depth + 1)], alg)[0]


def canopies(leaf_rows: DataFrame, most: int = 1024, width: int = 9) -> DataFrame:
    """(canopy hex, leaves, kept): leaves by the first ``width`` bytes of their ``key``, and whether there are so many that the nodes below are kept."""
    return leaf_rows.groupBy(F.lower(F.hex(F.substring("key", 1, width))).alias("canopy")).agg(F.count("*").alias("leaves")).withColumn("kept", F.col("leaves") > most)
