"""Packing of documents into sequences of a fixed length: first-fit decreasing in randomised groups.

A document's ids, with an end id, are cut into full sequences and one rest. The rests are dealt at
random into groups of a bounded number of rows, and each group is packed on its own: longest rest
first, each into the first sequence that has room, found in a tournament tree of free capacities in
logarithmic time. No id is dropped or repeated, and nothing but lengths is shuffled.

A null or empty text makes one piece that holds the end id alone. Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealstone.llm.common import mixed, slices, table
from sealstone.llm.encoding import Encoder

LENGTH = 2048
GROUP = 8192
#: Bytes of text that a worker encodes at once.
SLICE = 1 << 20


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each piece, and where it begins there. Ties: the piece that comes first."""
    n = len(sizes)
    order = np.argsort(-sizes, kind="stable").tolist()
    leaves = 1 << max(0, (max(1, n) - 1).bit_length())
    tree = [capacity] * (2 * leaves)  # each node: the largest free capacity below it
    bin_of, offset, size = np.empty(n, np.int64), np.empty(n, np.int64), sizes.tolist()
    for piece in order:
        need, node = size[piece], 1
        if need > capacity:
            raise ValueError("a piece is longer than a sequence")
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bin_of[piece], offset[piece] = node - leaves, capacity - tree[node]
        tree[node] -= need
        node //= 2
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return bin_of, offset


def cut_pieces(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", end_id: int = 1, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """A row for each piece: key, start, length, ids_crc32, doc_tokens, a random 63-bit ``deal``; with_ids adds the ids, little-endian uint32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        seen = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, off = encoder.encode(part.column("text"))
                ids = np.insert(ids, off[1:], end_id).astype("<u4")
                size = np.diff(off) + 1
                begin = np.cumsum(size) - size
                n = -(-size // length)
                doc = np.repeat(np.arange(len(size)), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * length
                held = np.minimum(length, size[doc] - start)
                raw, at = memoryview(ids.tobytes()), (begin[doc] + start) * 4
                views = [raw[a : a + b] for a, b in zip(at.tolist(), (held * 4).tolist(), strict=True)]
                deal = mixed(np.arange(seen, seen + len(doc)).astype(np.uint64)) >> np.uint64(1)
                seen += len(doc)
                out = {
                    key: part.column("key").take(pa.array(doc)),
                    "start": pa.array(start),
                    "length": pa.array(held),
                    "ids_crc32": pa.array([zlib.crc32(v) for v in views], pa.int64()),
                    "doc_tokens": pa.array(size[doc]),
                    "deal": pa.array(deal.astype(np.int64)),
                }
                yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array([bytes(v) for v in views], pa.binary())} if with_ids else {}))

    schema = f"{key} long, start long, length long, ids_crc32 long, doc_tokens long, deal long" + ", ids binary" * with_ids
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(cut, schema)


def pack(pieces: DataFrame, *, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to the rows of ``cut_pieces``. ``group``: rows of a group, about."""
    pieces = table(pieces, "pieces")  # the texts are encoded once, and a second attempt sees the same deal
    groups = max(1, -(-pieces.count() // group))
    schema = pieces.drop("deal").schema.add("sequence_id", "long").add("offset", "long")

    def packed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("deal", "ascending")])
        own = rows.column("grp")[0].as_py() if rows.num_rows else 0
        bin_of, offset = first_fit_decreasing(rows.column("length").to_numpy(), length)
        out = rows.drop_columns(["deal", "grp"])
        return out.append_column("sequence_id", pa.array((own << 32) + bin_of)).append_column("offset", pa.array(offset))

    return pieces.withColumn("grp", F.col("deal") % groups).groupBy("grp").applyInArrow(packed, schema)
