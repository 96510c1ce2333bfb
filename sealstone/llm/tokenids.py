"""Token-id shards with a minimal perfect hash index.

A shard is two files. ``*.ids``: the ids of its documents end to end, little-endian, in ascending
key order. ``*.idx``: the keys, and a minimal perfect hash from key to slot; each slot holds a
32-bit fingerprint of its key, the offset of its document and its number of ids. A look-up reads the
head of the index once, then for a key a few words of bits, one slot and the ids, however many documents there are.
``Store`` finds the shard of a key by the key ranges in the manifest; ``look_up`` does so for a table of keys.

Null keys come first, a null text has the end id alone, rows that repeat a key are told apart by
their ordinal, an empty table makes no shard, other columns are left alone.
"""

from __future__ import annotations

import io
import json
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealstone.llm.common import fresh_path, mixed, slices, table
from sealstone.llm.encoding import Encoder

MAGIC = b"SSTOKID1"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def key_hash(key: np.ndarray, is_null: np.ndarray, ordinal: np.ndarray) -> np.ndarray:
    x = mixed(key.astype(np.int64).view(np.uint64) + is_null.astype(np.uint64) * np.uint64(0xA5A5A5A5))
    return mixed(x + (ordinal.astype(np.uint64) * np.uint64(2) + is_null.astype(np.uint64)) * _STEP)


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (mixed(h ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


@dataclass
class PerfectHash:
    """Levels of bit arrays: a key sits in the first level in which no other key shares its place. Its slot is the rank of its bit."""

    sizes: list[int] = field(default_factory=list)
    bits: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    rank: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    LEVELS = 64
    SPACE = 1.5  #: bits of a level for each key that reaches it

    @staticmethod
    def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(h + np.uint64((level + 1) * int(_STEP) % 2**64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        """``h``: distinct 64-bit key digests."""
        sizes, words, left = [], [], h
        while len(left):
            if len(sizes) == cls.LEVELS:
                raise ValueError("keys are not distinct")
            size = -(-max(64, int(cls.SPACE * len(left))) // 64) * 64
            at = cls._place(left, len(sizes), size)
            once = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(once, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~once[at]]
        bits = np.concatenate(words).astype(np.uint64) if words else np.zeros(0, np.uint64)
        return cls(sizes, bits, np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)]))

    def slot(self, h: np.ndarray) -> np.ndarray:
        """Slot of each key; for a key that is not there some slot or -1, which the fingerprint tells."""
        out = np.full(len(h), -1, np.int64)
        open_, base = np.arange(len(h)), 0
        for level, size in enumerate(self.sizes):
            at = base + self._place(h[open_], level, size)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[open_[hit]] = self.rank[word[hit]] + below
            open_, base = open_[~hit], base + size
        return out


def _pack(arrays: dict[str, np.ndarray], meta: dict) -> bytes:
    head = json.dumps({"meta": meta, "arrays": [[k, v.dtype.str, len(v)] for k, v in arrays.items()]}).encode()
    out = io.BytesIO()
    out.write(MAGIC + len(head).to_bytes(4, "little") + head)
    for v in arrays.values():
        out.write(v.tobytes())
    return out.getvalue()


def _layout(read) -> tuple[dict[str, tuple[np.dtype, int, int]], dict]:
    """Type, number and first byte of each array of an index, and its other facts. ``read(at, n)`` gives bytes of the file."""
    head = read(0, 12)
    if head[:8] != MAGIC:
        raise ValueError("not an index file")
    n = int.from_bytes(head[8:12], "little")
    facts, at, arrays = json.loads(read(12, n)), 12 + n, {}
    for name, kind, size in facts["arrays"]:
        arrays[name] = (np.dtype(kind), size, at)
        at += size * np.dtype(kind).itemsize
    return arrays, facts["meta"]


def ordinals(key: np.ndarray, is_null: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... within each run of one key (keys are in order)."""
    if not len(key):
        return np.zeros(0, np.int64)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (is_null[1:] != is_null[:-1])
    begin = np.flatnonzero(new)
    return np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))


class Shard:
    """One shard, open for look-ups. Its head is read at once, other parts of the index as they are needed."""

    def __init__(self, path: str) -> None:
        """``path``: URI without ``.ids`` or ``.idx``."""
        self.fs, self.path = pafs.FileSystem.from_uri(path)
        self._index = self.fs.open_input_file(f"{self.path}.idx")
        self._at, self.meta = _layout(lambda at, n: self._index.read_at(n, at))
        self._arrays: dict[str, np.ndarray] | None = None

    @property
    def arrays(self) -> dict[str, np.ndarray]:
        """The whole index, for work on all keys."""
        if self._arrays is None:
            self._arrays = {k: np.frombuffer(self._index.read_at(n * kind.itemsize, at), kind) for k, (kind, n, at) in self._at.items()}
        return self._arrays

    def _one(self, name: str, i: int):
        """One value of an array, read where it lies."""
        kind, n, at = self._at[name]
        if not 0 <= i < n:
            raise IndexError(i)
        return np.frombuffer(self._index.read_at(kind.itemsize, at + i * kind.itemsize), kind)[0]

    def find(self, key: np.ndarray, is_null: np.ndarray, ordinal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset and number of ids of each key's document; -1 for keys that are not there."""
        h = key_hash(key, is_null, ordinal)
        slot = PerfectHash(self.meta["sizes"], self.arrays["bits"], self.arrays["rank"]).slot(h)
        n = len(self.arrays["offset"])
        good = (slot >= 0) & (slot < n)
        good[good] = self.arrays["fingerprint"][slot[good]] == fingerprint(h[good])
        offset, size = np.full(len(h), -1, np.int64), np.full(len(h), -1, np.int64)
        offset[good], size[good] = self.arrays["offset"][slot[good]], self.arrays["size"][slot[good]]
        return offset, size

    def _slot(self, h: np.ndarray) -> int:
        base = 0
        for level, size in enumerate(self.meta["sizes"]):
            at = base + int(PerfectHash._place(h, level, size)[0])
            word, bit = int(self._one("bits", at >> 6)), at & 63
            if word >> bit & 1:
                return int(self._one("rank", at >> 6)) + (word & ((1 << bit) - 1)).bit_count()
            base += size
        return -1

    def get(self, key: int | None, ordinal: int = 0) -> np.ndarray | None:
        """The ids of one document; None if its fingerprint is not there."""
        h = key_hash(np.array([key or 0]), np.array([key is None]), np.array([ordinal]))
        slot = self._slot(h)
        if slot < 0 or self._one("fingerprint", slot) != fingerprint(h)[0]:
            return None
        kind, at, size = np.dtype(self.meta["dtype"]), int(self._one("offset", slot)), int(self._one("size", slot))
        with self.fs.open_input_file(f"{self.path}.ids") as f:
            return np.frombuffer(f.read_at(size * kind.itemsize, at * kind.itemsize), kind)


class Store:
    """Keyed access to all shards of a manifest (a row for each shard). Null keys lie in the shards that begin with one."""

    def __init__(self, manifest: DataFrame) -> None:
        rows = sorted(manifest.select("shard", "path", "first_key", "last_key", "n_null").collect())
        self.nulls = [r[1] for r in rows if r[4]]
        self.keyed = [(r[2], r[3], r[1]) for r in rows if r[2] is not None]
        self._open: dict[str, Shard] = {}

    def _shard(self, path: str) -> Shard:
        if path not in self._open:
            self._open[path] = Shard(path)
        return self._open[path]

    def get(self, key: int | None, ordinal: int = 0) -> np.ndarray | None:
        """The ids of one document: that of the key, and of rows that repeat it the one of that ordinal in its first shard."""
        if key is None:
            paths = self.nulls
        else:
            at = bisect_left(self.keyed, key, key=lambda x: x[1])
            paths = [p for first, _, p in self.keyed[at : at + 1] if first <= key]
        for path in paths[:1]:
            return self._shard(path).get(key, ordinal)
        return None


def look_up(manifest: DataFrame, keys: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, ids binary): the ids of each wanted key, null if it is not there; each key once. A task opens the shards that its keys lie in."""
    ranges = sorted(tuple(r) for r in manifest.filter("first_key is not null").select("first_key", "last_key", "path").collect())  # a row a shard

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, Shard] = {}
        for batch in batches:
            out = []
            for k in batch.column("key").to_pylist():
                at = bisect_left(ranges, k, key=lambda x: x[1])
                ids = None
                if at < len(ranges) and ranges[at][0] <= k:
                    path = ranges[at][2]
                    if path not in shards:
                        shards.clear()  # keys come in order
                        shards[path] = Shard(path)
                    ids = shards[path].get(k)
                out.append(None if ids is None else ids.tobytes())
            yield pa.RecordBatch.from_pydict({key: batch.column("key"), "ids": pa.array(out, pa.binary())})

    wanted = keys.select(F.col(key).cast("long").alias("key")).filter("key is not null").distinct()
    return wanted.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(read, f"{key} long, ids binary")


MANIFEST = "shard int, path string, n_docs long, n_ids long, first_key long, last_key long, n_null long"


def write_shards(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", end_id: int | None = 0, dtype: str = "<u2", out: str | None = None) -> DataFrame:
    """Encode ``text`` and write the shards; returns the manifest, one row a shard.

    Documents are range-partitioned by key, so that shard after shard is in key order; rows of one key may go to several shards.
    A task streams its documents to a file of its own name, so a second attempt never touches the first one's file; only files in the manifest count."""
    spark = docs.sparkSession
    out = out or fresh_path(spark, "token-shards")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, kind = Encoder.of(tokenizer), np.dtype(dtype)
        fs, base = pafs.FileSystem.from_uri(out)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        keys, nulls, sizes, stream = [], [], [], None
        for batch in batches:
            for part in slices(batch, "text"):
                if stream is None:
                    fs.create_dir(base, recursive=True)
                    stream = fs.open_output_stream(f"{base}/{name}.ids")
                ids, off = encoder.encode(part.column("text"))
                n = np.diff(off)
                if end_id is not None:
                    ids, n = np.insert(ids, off[1:], end_id), n + 1
                if len(ids) and int(ids.max()) > np.iinfo(kind).max:
                    raise ValueError(f"an id does not fit {dtype}")
                stream.write(ids.astype(kind).tobytes())
                k = part.column("key")
                keys.append(k.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                nulls.append(k.is_null().to_numpy(zero_copy_only=False))
                sizes.append(n)
        if stream is None:
            return
        stream.close()
        key_, null_, size_ = np.concatenate(keys), np.concatenate(nulls), np.concatenate(sizes).astype(np.int64)
        own = key_[~null_]
        h = key_hash(key_, null_, ordinals(key_, null_))
        index = PerfectHash.build(h)
        slot = index.slot(h)
        arrays = {"key": key_, "null": null_.astype(np.uint8), "bits": index.bits, "rank": index.rank}
        for what, values in (("fingerprint", fingerprint(h)), ("offset", np.cumsum(size_) - size_), ("size", size_)):
            arrays[what] = np.empty_like(values)
            arrays[what][slot] = values
        with fs.open_output_stream(f"{base}/{name}.idx") as f:
            f.write(_pack(arrays, {"sizes": index.sizes, "dtype": dtype}))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{out}/{name}"], "n_docs": pa.array([len(key_)], pa.int64()), "n_ids": pa.array([int(size_.sum())], pa.int64()), "first_key": pa.array([int(own[0]) if len(own) else None], pa.int64()), "last_key": pa.array([int(own[-1]) if len(own) else None], pa.int64()), "n_null": pa.array([int(null_.sum())], pa.int64())})

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    parts = max(docs.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    placed = rows.repartitionByRange(parts, F.col("key").asc_nulls_first(), F.col("row")).sortWithinPartitions(F.col("key").asc_nulls_first(), F.col("row"))
    return table(placed.select("key", "text").mapInArrow(write, MANIFEST), "token-manifest")


def read_shards(manifest: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Per document, from the files: key, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian uint32)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard = Shard(path)
                keys, nulls = shard.arrays["key"], shard.arrays["null"].astype(bool)
                offset, size = shard.find(keys, nulls, ordinals(keys, nulls))
                if (offset < 0).any():
                    raise ValueError(f"{path}: a key is not in its index")
                kind = np.dtype(shard.meta["dtype"])
                crc = np.empty(len(keys), np.int64)
                with shard.fs.open_input_stream(f"{shard.path}.ids", buffer_size=4 << 20) as f:
                    at = 0
                    for i in range(len(keys)):
                        if offset[i] != at:
                            raise ValueError(f"{path}: documents are not end to end")
                        crc[i] = zlib.crc32(np.frombuffer(f.read(int(size[i]) * kind.itemsize), kind).astype("<u4"))
                        at += int(size[i])
                    if f.read(1):
                        raise ValueError(f"{path}: ids beyond the last document")
                yield pa.RecordBatch.from_pydict({key: pa.array(keys, pa.int64(), mask=nulls), "start": pa.array(base + offset), "n_tokens": pa.array(size), "ids_crc32": pa.array(crc)})

    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row a shard
    placed = manifest.withColumn("base", F.coalesce(before, F.lit(0)))
    return placed.repartition(max(1, manifest.count()), "shard").select("path", "base").mapInArrow(read, f"{key} long, start long, n_tokens long, ids_crc32 long")
