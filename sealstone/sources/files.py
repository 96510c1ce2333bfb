"""Directory scans, and the sinks of a ledger: CSV, canonical JSON, insert-or-ignore, upsert."""

from __future__ import annotations

import hashlib
import os
import posixpath
from collections.abc import Iterator
from itertools import islice
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealstone.functions.blake3 import hash_many
from sealstone.operators.ledger import csv_safe, latest
from sealstone.operators.streams import hash_stream
from sealstone.sources.tables import table


#: Files from this size on are read as streams of their own; smaller ones are hashed TOGETHER bytes at a time.
STREAMED, TOGETHER = 64 << 20, 32 << 20


def _local(root: str) -> str | None:
    """The path of a folder of the local file system; None if it is of another store."""
    return os.path.abspath(unquote(urlparse(root).path) if root.startswith("file:") else root) if root.startswith("file:") or "://" not in root else None


def _listed(root: str, inside: str) -> Iterator[tuple[str, bool, int]]:
    """What lies in one folder: (path below the root, whether it is a folder, size). Links and what is neither folder nor file are passed over; a name that is no UTF-8 stops the job."""
    at = _local(root)
    if at is not None:
        with os.scandir(os.path.join(at, inside)) as entries:
            for e in entries:
                folder = e.is_dir(follow_symlinks=False)
                if folder or e.is_file(follow_symlinks=False):
                    try:
                        e.name.encode()
                    except UnicodeEncodeError as error:
                        raise ValueError(f"a name that is no UTF-8 in {inside or root}") from error
                    yield posixpath.join(inside, e.name), folder, 0 if folder else e.stat(follow_symlinks=False).st_size
        return
    fs, base = pafs.FileSystem.from_uri(root)
    for x in fs.get_file_info(pafs.FileSelector(posixpath.join(base, inside))):
        if x.type in (pafs.FileType.Directory, pafs.FileType.File):
            yield posixpath.join(inside, x.base_name), x.type == pafs.FileType.Directory, x.size or 0


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of all regular files below a folder, hidden ones too. A walk in rounds, each a job over the folders of one depth, so no list of files is ever in one place."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for inside in batch.column("path").to_pylist():
                found = _listed(root, inside)
                while some := list(islice(found, 4096)):
                    path, folder, size = zip(*some, strict=True)
                    yield pa.RecordBatch.from_pydict({"path": path, "folder": folder, "size": pa.array(size, pa.int64())})

    folders, files = spark.createDataFrame([("",)], "path string"), None
    while True:
        found = table(folders.mapInArrow(entries, "path string, folder boolean, size long"), "listing")
        own = found.filter("not folder").select("path", "size")
        files = own if files is None else files.union(own)
        folders = found.filter("folder").select("path").repartition("path")
        if not folders.take(1):
            return files


def scan_directory(spark: SparkSession, root: str, *, alg: str = "blake3", shard: str | None = None, streamed: int = STREAMED) -> DataFrame:
    """All regular files below ``root`` as records, empty and hidden ones too; links are not followed and have none. The shard is the first folder of the path (``root`` for files on top), or the one given; the id is the rest of the path.

    Folders are listed and files read by the tasks, in a file system that all of them see or a store that pyarrow opens. Files from ``streamed`` bytes on are hashed a block at a time."""

    def opened(path: str):
        at = _local(root)
        if at is not None:
            return open(os.path.join(at, path), "rb")  # noqa: SIM115
        fs, base = pafs.FileSystem.from_uri(root)
        return fs.open_input_stream(posixpath.join(base, path))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, bytes]] = []

        def out(paths: list[str], digests: list[bytes], sizes: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"path": paths, "content_hash": [d.hex() for d in digests], "byte_size": pa.array(sizes, pa.int64())})

        def together() -> pa.RecordBatch:
            paths, contents = zip(*held, strict=True)
            held.clear()
            return out(list(paths), hash_many(contents) if alg == "blake3" else [hashlib.sha256(c).digest() for c in contents], [len(c) for c in contents])

        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), strict=True):
                with opened(path) as f:
                    if size < streamed:
                        held.append((path, f.read()))
                        if sum(len(c) for _, c in held) < TOGETHER:
                            continue
                        yield together()
                    elif alg == "blake3":
                        got, n = hash_stream(f)
                        yield out([path], [got], [n])
                    else:
                        state, n = hashlib.sha256(), 0
                        while data := f.read(16 << 20):
                            state.update(data)
                            n += len(data)
                        yield out([path], [state.digest()], [n])
        if held:
            yield together()

    every = walk(spark, root).repartition("path").mapInArrow(hashed, "path string, content_hash string, byte_size long")
    deep = F.instr("path", "/") > 0
    first = F.when(deep, F.substring_index("path", "/", 1)).otherwise("root")
    name = F.when(deep, F.regexp_replace("path", "^[^/]*/", "")).otherwise(F.col("path"))
    return every.select((F.lit(shard) if shard else first).alias("shard_id"), (F.col("path") if shard else name).alias("record_id"), F.lit(1).cast("long").alias("version"), "content_hash", "byte_size")


def write_csv(df: DataFrame, path: str, most: int = 50_000) -> None:
    """At most ``most`` rows, cells made safe for spreadsheets, quotes doubled."""
    texts = [c for c, t in df.dtypes if t == "string"]
    df.limit(most).withColumns({c: csv_safe(F.col(c)) for c in texts}).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_canonical_json(df: DataFrame, column: str, path: str) -> None:
    """One canonical document a line; a document without a canonical form stops the job."""
    from sealstone.functions.canonical import canonical_json

    c = canonical_json(F.col(column))
    df.select(F.when(c.isNull(), F.raise_error(F.lit("a document has no canonical form"))).otherwise(c).alias("value")).write.mode("overwrite").text(path)


def insert_or_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``new`` to append: of each key not there yet, the first by ``order``."""
    first = Window.partitionBy(*keys).orderBy(*order)
    fresh = new.join(existing.select(*keys), keys, "left_anti")
    return fresh.withColumn("rank_", F.row_number().over(first)).filter("rank_ = 1").select(*new.columns)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The whole table after an upsert: the latest row of each key by ``order``, a new one before an old one that ties."""
    both = existing.withColumn("is_new_", F.lit(0)).unionByName(new.withColumn("is_new_", F.lit(1)))
    return latest(both, tuple(keys), (*order, "is_new_")).select(*existing.columns)


def write_once(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Leaves to add to a sealed dataset (key, value_hash, ...): those not there. A key that holds another value stops the job, as the tree is write-once."""
    old = existing.select("key", F.col("value_hash").alias("held_"))
    joined = new.dropDuplicates(["key", "value_hash"]).join(old, "key", "left")
    clash = F.col("held_").isNotNull() & (F.col("held_") != F.col("value_hash"))
    guarded = joined.withColumn("value_hash", F.when(clash, F.raise_error(F.lit("a key holds another value"))).otherwise(F.col("value_hash")).cast("binary"))
    return guarded.filter("held_ is null or held_ <> value_hash").select(*new.columns)
