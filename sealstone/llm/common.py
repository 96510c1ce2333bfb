"""What the operators share: tables in the shared folder, and text columns as numpy arrays."""

from __future__ import annotations

import ctypes
import posixpath
import sys
import tempfile
import uuid
from contextvars import ContextVar
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are what lies between bytes 0x20 and 0x09 to 0x0D; as a Java regular expression:
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a fresh one in a local session; on a cluster that is an error."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="sealstone-")
        sc.setCheckpointDir(at)
    return at


#: Paths made while a ``Scratch`` is open go to the innermost one of the same thread.
_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def fresh_path(spark: SparkSession, name: str) -> str:
    path = posixpath.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    if open_ := _scratch.get():
        open_[-1].append(path)
    return path


class Scratch:
    """Collects the tables and files that operators write inside its ``with`` block; ``drop`` deletes them, once nothing that reads them is left."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        _scratch.set((*_scratch.get(), self.paths))
        return self

    def __exit__(self, *_) -> None:
        _scratch.set(_scratch.get()[:-1])

    def drop(self, spark: SparkSession) -> None:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.paths.clear()


def table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back. A lost executor loses none of it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text column, 0 for null, inside the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the offset of each text (nulls are empty): ``(uint8[n], int64[rows + 1])``."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.fill_null("") if texts.null_count else texts
    _, off, data = texts.buffers()
    width = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    o = np.frombuffer(off, dtype=width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if off is not None and len(texts) else np.zeros(1, np.int64)
    d = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


@dataclass
class Words:
    """Words of a batch of texts, without the space between them."""

    data: np.ndarray  #: bytes of all words end to end
    off: np.ndarray  #: where each word starts there, int64[n + 1]
    start: np.ndarray  #: where each word starts among the bytes of the texts
    doc: np.ndarray  #: where each text's words start, int64[rows + 1]

    def __len__(self) -> int:
        return len(self.off) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.doc)

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """For each word the number of its distinct word, and the distinct words. Exact: compares bytes, not digests."""
        arr = pa.LargeStringArray.from_buffers(len(self), pa.py_buffer(self.off), pa.py_buffer(self.data)) if len(self) else pa.array([], pa.large_utf8())
        enc = arr.dictionary_encode()
        return enc.indices.to_numpy(zero_copy_only=False), enc.dictionary


def is_space(data: np.ndarray) -> np.ndarray:
    """Which bytes are 0x20 or 0x09 to 0x0D; they never occur inside a multi-byte character."""
    gap = data == 32
    gap |= (data - np.uint8(9)) < 5
    return gap


def split_words(data: np.ndarray, off: np.ndarray, gap: np.ndarray | None = None) -> Words:
    """Words of texts given as by ``buffers``. ``gap``: which bytes part words (space, if not given)."""
    n = len(data)
    gap = is_space(data) if gap is None else gap
    ink = ~gap
    first, last = ink.copy(), ink.copy()
    if n:
        first[1:] &= gap[:-1]
        last[:-1] &= gap[1:]
        edge = off[:-1][np.diff(off) > 0]
        first[edge] = ink[edge]
        edge = off[1:][np.diff(off) > 0] - 1
        last[edge] = ink[edge]
    start = np.flatnonzero(first)
    word_off = np.zeros(len(start) + 1, np.int64)
    np.cumsum(np.flatnonzero(last) + 1 - start, out=word_off[1:])
    return Words(data[ink], word_off, start, np.searchsorted(start, off))


def hashes(distinct: pa.Array, secret: bytes) -> np.ndarray:
    """A 64-bit digest of each distinct word, the same in every task that has the ``secret``: BLAKE2b of its bytes, keyed, so words that clash cannot be made by one who writes texts."""
    data, off = buffers(distinct)
    raw, edge = data.tobytes(), off.tolist()
    keyed = blake2b(digest_size=8, key=secret)

    def one(word: bytes) -> bytes:
        h = keyed.copy()
        h.update(word)
        return h.digest()

    return np.frombuffer(b"".join([one(raw[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]), np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64 (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(word_hash: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit digests of all runs of ``k`` words in each text, in order; a text of fewer words (but some) has its whole sequence as one.

    Returns ``(digest, off)`` with ``off[i]:off[i + 1]`` the runs of text i."""
    counts = np.diff(doc)
    runs = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    off = np.concatenate([[0], np.cumsum(runs)])
    at = np.arange(off[-1]) - np.repeat(off[:-1], runs) + np.repeat(doc[:-1], runs)
    have = np.repeat(np.minimum(counts, k), runs)
    out = have.astype(np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    padded = np.concatenate([word_hash, np.zeros(k, np.uint64)])
    for j in range(k):
        w = padded[at + j]
        out = mixed(out * step + (w if (have > j).all() else np.where(have > j, w, np.uint64(0))))
    return out, off


def give_back() -> None:
    """Memory that a worker has freed goes back to the machine: workers stay, and those of a stage long done must not keep what the next one needs."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


#: glibc's; other systems have their own ways and no such function.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Parts of a batch whose texts hold about ``most`` bytes at most (one very long text makes a part of its own). Behind the last one, freed memory is given back."""
    col = batch.column(column)
    size = np.asarray(_byte_lengths(col), np.int64)
    at = 0
    while at < len(size):
        upto = max(1, int(np.searchsorted(np.cumsum(size[at:]), most, side="right")))
        yield batch.slice(at, upto)
        at += upto
    give_back()


def _byte_lengths(col: pa.Array) -> np.ndarray:
    return np.diff(buffers(col)[1])
