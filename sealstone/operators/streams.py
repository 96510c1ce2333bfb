"""BLAKE3 of one long stream of sorted rows, chunk by chunk in tasks, and of files too large for a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealstone.functions.blake3 import CHUNK, Blake3, chaining_values, hash_many, merged
from sealstone.sources.tables import table

#: Levels of the tree that a task folds.
STEP = 14


def blake3_of_parts(rows: DataFrame, order: list[str], column: str, head: bytes) -> bytes:
    """Digest of ``head`` and then ``column`` of all rows. ``rows`` is a written table with ``part``, parts being ranges of ``order`` in turn.

    Parts are cut into chunks where they lie; chunks on a border are put together from their pieces; then each task folds 2 ** STEP neighbours."""
    spark = rows.sparkSession
    sizes = {r[0]: r[1] for r in rows.groupBy("part").agg(F.sum(F.octet_length(column))).collect()}  # a row a part
    begin, total = {}, len(head)
    for part in sorted(sizes):
        begin[part] = total
        total += sizes[part]
    if total <= CHUNK or not sizes:
        body = b"".join(bytes(r[0]) for r in rows.orderBy(*order).select(column).collect())  # a chunk at most
        return hash_many([head + body])[0]
    n_chunks = -(-total // CHUNK)

    def cut(own: pa.Table) -> pa.Table:
        own = own.sort_by([(c, "ascending") for c in order])
        at = begin[own.column("part")[0].as_py()]
        return pieces(b"".join(own.column(column).to_pylist()), at)

    def pieces(data: bytes, at: int) -> pa.Table:
        """Whole chunks as their nodes, what lies on a border as it is."""
        first = -(-at // CHUNK)
        upto = n_chunks if at + len(data) == total else (at + len(data)) // CHUNK
        if first >= upto:  # within a chunk, or over one border
            whole, edges = np.zeros((0, 32), np.uint8), [(at + i, data[i : i + CHUNK - (at + i) % CHUNK]) for i in range_from(at, len(data))]
        else:
            a, b = first * CHUNK - at, min(len(data), upto * CHUNK - at)
            whole = chaining_values(data[a:b], first)
            edges = [(x, d) for x, d in ((at, data[:a]), (at + b, data[b:])) if d]
        chunk = np.concatenate([np.arange(first, first + len(whole)), np.array([x // CHUNK for x, _ in edges], np.int64)]).astype(np.int64)
        return pa.table({"chunk": chunk, "at": pa.array([0] * len(whole) + [x % CHUNK for x, _ in edges], pa.int64()), "node": pa.array([w.tobytes() for w in whole] + [None] * len(edges), pa.binary()), "piece": pa.array([None] * len(whole) + [d for _, d in edges], pa.binary())})

    def range_from(at: int, n: int) -> Iterator[int]:
        i = 0
        while i < n:
            yield i
            i += CHUNK - (at + i) % CHUNK

    nodes = rows.select("part", *order, column).groupBy("part").applyInArrow(cut, "chunk long, at long, node binary, piece binary")
    start = spark.createDataFrame(pieces(head, 0).to_pylist(), "chunk long, at long, node binary, piece binary") if head else nodes.limit(0)
    nodes = table(nodes.union(start), "chunks")

    def together(own: pa.Table) -> pa.Table:
        own = own.sort_by([("chunk", "ascending"), ("at", "ascending")])
        held: dict[int, bytes] = {}
        for c, p in zip(own.column("chunk").to_pylist(), own.column("piece").to_pylist(), strict=True):
            held[c] = held.get(c, b"") + p
        return pa.table({"chunk": pa.array(list(held), pa.int64()), "node": pa.array([chaining_values(d, c)[0].tobytes() for c, d in held.items()], pa.binary())})

    borders = nodes.filter("node is null").withColumn("task", F.shiftright("chunk", STEP)).groupBy("task").applyInArrow(together, "chunk long, node binary")
    level = nodes.filter("node is not null").select("chunk", "node").union(borders)
    n = n_chunks
    while n > 1:
        last = n <= 1 << STEP

        def fold(own: pa.Table) -> pa.Table:
            own = own.sort_by("chunk")
            cv = np.frombuffer(b"".join(own.column("node").to_pylist()), np.uint8).reshape(-1, 32)
            return pa.table({"chunk": pa.array([own.column("chunk")[0].as_py() >> STEP], pa.int64()), "node": pa.array([merged(cv, last).tobytes()], pa.binary())})  # noqa: B023

        level = table(level.withColumn("task", F.shiftright("chunk", STEP)).groupBy("task").applyInArrow(fold, "chunk long, node binary"), "chunk-nodes")
        n = -(-n >> STEP)
    return bytes(level.first()["node"])


def hash_stream(source, size: int = 16 << 20) -> tuple[bytes, int]:
    """Digest and length of an open binary stream, ``size`` bytes at a time (a power of two of chunks)."""
    state, n = Blake3(size), 0
    while data := source.read(size):
        state.update(data)
        n += len(data)
    return state.digest(), n
