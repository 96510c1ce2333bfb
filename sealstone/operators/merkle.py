"""Ordered binary trees, folded level by level with native grouping: a level halves the rows, the shuffle key is the parent.

Three paddings, never mixed: a lone node passes up unhashed (``binary_roots``), or meets an empty subtree of its height (``fixed_depth_roots``), or
leaves are padded with zeros to a power of two (``zero_padded_roots``)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from sealstone.functions.batches import give_back
from sealstone.functions.blake3 import hash_many
from sealstone.functions.framing import LEGACY_LEAF, NODE, SEPARATOR, digest, joined
from sealstone.sources.tables import table

#: Levels folded inside a task, over runs of neighbours, for each shuffle.
STEP = 10
#: Runs whose nodes are held as Python's objects at once.
GROUPS = 128


def parents(pairs: list[tuple[bytes, bytes]], alg: str) -> list[bytes]:
    """Nodes over pairs of children. ``poseidon``: children and nodes are field elements, 32 bytes, big-endian."""
    if alg == "poseidon":
        from sealstone.functions.poseidon import nodes

        return [x.to_bytes(32, "big") for x in nodes([(int.from_bytes(a, "big"), int.from_bytes(b, "big")) for a, b in pairs])]
    messages = [NODE + SEPARATOR + a + SEPARATOR + b for a, b in pairs]
    return hash_many(messages) if alg == "blake3" else [hashlib.sha256(m).digest() for m in messages]


def neighbours(nodes: list[bytes], alg: str) -> list[bytes]:
    """Nodes over children of 32 bytes that lie side by side."""
    if alg == "poseidon":
        return parents(list(zip(nodes[::2], nodes[1::2], strict=True)), alg)
    head, raw = NODE + SEPARATOR, SEPARATOR.join(nodes)
    messages = [head + raw[i : i + 65] for i in range(0, len(raw), 66)]
    return hash_many(messages) if alg == "blake3" else [hashlib.sha256(m).digest() for m in messages]


@cache
def zeros(alg: str, depth: int) -> list[bytes]:
    """Roots of empty subtrees over leaves of 32 zero bytes, by height."""
    out = [bytes(32)]
    for _ in range(depth):
        out += parents([(out[-1], out[-1])], alg)
    return out


def padded_roots(groups: list[list[bytes]], alg: str) -> list[bytes | None]:
    """``zero_padded_roots`` of leaves that lie in one place: a level of all groups goes through the hash together."""
    empties, height, level = zeros(alg, 16), 0, groups
    while max(map(len, level), default=0) > 1:
        level = [[*g, empties[height]] if len(g) % 2 and len(g) > 1 else g for g in level]
        fresh = neighbours([x for g in level if len(g) > 1 for x in g], alg)
        sizes = [len(g) // 2 for g in level]
        ends = np.cumsum(sizes).tolist()
        level = [fresh[end - n : end] if n else g for g, n, end in zip(level, sizes, ends, strict=True)]
        height += 1
    return [top[0] if len(leaves) > 1 else None for leaves, top in zip(groups, level, strict=True)]


def _level_udf(alg: str, height: int, empties: list[bytes] | None):
    """Root of up to 2 ** STEP neighbouring nodes that start at a multiple of it."""
    def fold(nodes: list, levels: pd.Series) -> list[bytes]:
        rows = [[bytes(x) for x in r] for r in nodes]
        for level in range(int(levels.max()) if len(levels) else 0):
            pairs, where = [], []
            for i, r in enumerate(rows):
                if level >= levels.iloc[i]:
                    continue
                if len(r) % 2 and empties is not None:
                    r.append(empties[height + level])
                for j in range(0, len(r) - 1, 2):
                    pairs.append((r[j], r[j + 1]))
                    where.append(i)
                rows[i] = r[-1:] if len(r) % 2 else []
            carry = {i: r for i, r in enumerate(rows)}
            fresh: dict[int, list[bytes]] = {}
            for i, h in zip(where, parents(pairs, alg), strict=True):
                fresh.setdefault(i, []).append(h)
            rows = [fresh.get(i, []) + carry[i] if level < levels.iloc[i] else carry[i] for i in range(len(rows))]
        return [r[0] for r in rows]

    @F.arrow_udf(BinaryType())
    def run(nodes: pa.Array, levels: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(nodes), GROUPS):  # as many nodes are Python's at a time as these have
            out.append(pa.array(fold(nodes.slice(at, GROUPS).to_pylist(), levels.slice(at, GROUPS).to_pandas()), pa.binary()))
        give_back()
        return pa.concat_arrays(out) if out else pa.array([], pa.binary())

    return run


def _fold(leaves: DataFrame, by: str, depth: Column, alg: str, empties: list[bytes] | None, most: int) -> DataFrame:
    """``leaves(by, i, node, n)`` to one node of each group, STEP levels at a time."""
    rows, height = leaves, 0
    while height < most:
        levels = F.greatest(F.lit(0), F.least(F.lit(STEP), depth - height))
        grouped = rows.groupBy(by, "n", F.shiftright("i", STEP).alias("i")).agg(F.sort_array(F.collect_list(F.struct("i", "node"))).alias("all"))
        rows = grouped.select(by, "n", "i", _level_udf(alg, height, empties)(F.transform("all", lambda x: x["node"]), levels.cast("int")).alias("node"))
        height += STEP
    return rows


def _numbered(rows: DataFrame, by: str, most: int | None = None) -> DataFrame:
    """Rows with their number ``i`` in their group's order of position, and the group's number of rows ``n``; a written table.

    Rows are sorted by ranges of (group, position), so a large group is many tasks; what lies before a range is a running total over the ranges, of which there are few.
    A group of more than ``most`` rows is an error."""
    ranged = table(rows.repartitionByRange(F.col(by), F.col("position")).withColumn("part_", F.spark_partition_id()), "ranges")
    each = ranged.groupBy(by, "part_").agg(F.count("*").alias("rows_"))  # rows here are ranges and groups
    before = Window.partitionBy(by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.withColumn("before_", F.coalesce(F.sum("rows_").over(before), F.lit(0))).withColumn("n", F.sum("rows_").over(Window.partitionBy(by))).select(F.col(by).alias("by_"), F.col("part_").alias("of_"), "before_", "n")
    inside = F.row_number().over(Window.partitionBy(by, "part_").orderBy("position")).cast("long") - 1
    told = ranged.withColumn("inside_", inside).join(starts, F.col(by).eqNullSafe(F.col("by_")) & (F.col("part_") == F.col("of_")))
    n = F.col("n") if most is None else F.when(F.col("n") > most, F.raise_error(F.lit("a group has more rows than its tree holds"))).otherwise(F.col("n")).cast("long")
    return table(told.select(*rows.columns, (F.col("before_") + F.col("inside_")).alias("i"), n.alias("n")), "numbered")


def binary_roots(rows: DataFrame, *, by: str, alg: str = "blake3") -> DataFrame:
    """``rows(by, position, data)``: (by, n, root); leaves are prefixed and hashed, a lone node passes up as it is. A group without rows has no root."""
    leaves = _numbered(rows, by).withColumn("node", digest(joined(LEGACY_LEAF, SEPARATOR, F.col("data")), alg))
    most = leaves.agg(F.max("n")).first()[0] or 0
    return _fold(leaves, by, F.lit(64), alg, None, max(1, int(most - 1).bit_length())).select(by, "n", F.col("node").alias("root"))


def in_trees(rows: DataFrame, *, by: str, depth: int) -> DataFrame:
    """``rows(by, position, data)``, positions from 0 without gaps, as the leaves of trees of a fixed depth, one after another: (tree, position in it, data). ``tree`` is a struct of the group and its tree's number, to be grouped by.

    A log of any length is so many trees: where one is full, the next begins, and what holds within a tree does not depend on those before."""
    position = F.col("position").cast("long")
    return rows.select(F.struct(by, F.shiftright(position, depth).alias("number")).alias("tree"), position.bitwiseAND((1 << depth) - 1).alias("position"), "data")


def fixed_depth_roots(rows: DataFrame, *, by: str, depth: int, alg: str = "blake3") -> DataFrame:
    """(by, n, root) of trees of a fixed depth; missing leaves are empty subtrees of 32 zero bytes. More leaves than the tree holds are an error."""
    empties = zeros(alg, depth)
    return _fold(_numbered(rows, by, 1 << depth).withColumnRenamed("data", "node"), by, F.lit(depth), alg, empties, depth).select(by, "n", F.col("node").alias("root"))


def zero_padded_roots(rows: DataFrame, *, by: str, alg: str = "blake3") -> DataFrame:
    """(by, n, root): leaves padded with zeros to a power of two. Groups of fewer than two leaves have none; more than 65536 are an error."""
    empties = zeros(alg, 16)
    leaves = _numbered(rows, by, 65536).withColumnRenamed("data", "node").filter("n >= 2")
    return _fold(leaves, by, F.length(F.bin(F.col("n") - 1)), alg, empties, 17).select(by, "n", F.col("node").alias("root"))


def snapshot_paths(rows: DataFrame, *, by: str, depth: int, alg: str = "blake3") -> DataFrame:
    """For the last leaf of each group its siblings from the leaf up: (by, n, leaf, siblings, root). Right of the last leaf all is empty, so the siblings
    to its left are the roots of the full subtrees that make up the n - 1 leaves before it."""
    numbered = _numbered(rows, by, 1 << depth).withColumnRenamed("data", "node")
    last = numbered.filter(F.col("i") == F.col("n") - 1).select(by, "n", F.col("node").alias("leaf"))
    # Leaf i lies in the full subtree of height h where i and n - 1 first differ; that is the sibling at level h.
    apart = F.length(F.bin(F.col("i").bitwiseXOR(F.col("n") - 1))) - 1
    before = numbered.filter(F.col("i") < F.col("n") - 1).withColumn("level", apart)
    empties = zeros(alg, depth)

    @F.pandas_udf(BinaryType())
    def full(nodes: pd.Series) -> pd.Series:
        """Root of a full subtree over all its nodes."""
        out = []
        for r in nodes:
            level = [bytes(x) for x in r]
            while len(level) > 1:
                level = parents([(level[i], level[i + 1]) for i in range(0, len(level), 2)], alg)
            out.append(level[0])
        return pd.Series(out)

    part = before.groupBy(by, "level", F.shiftright("i", STEP).alias("run")).agg(F.sort_array(F.collect_list(F.struct("i", "node"))).alias("all")).withColumn("node", full(F.transform("all", lambda x: x["node"])))
    sibling = part.groupBy(by, "level").agg(F.sort_array(F.collect_list(F.struct("run", "node"))).alias("all")).withColumn("node", full(F.transform("all", lambda x: x["node"])))
    found = sibling.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("level", "node"))).alias("held"))
    empty = F.array(*(F.lit(e) for e in empties[:depth]))
    siblings = F.transform(empty, lambda e, i: F.coalesce(F.try_element_at("held", i), e))
    out = last.join(found, by, "left").withColumn("siblings", siblings)
    return out.select(by, "n", "leaf", "siblings", fold_path(F.col("leaf"), F.col("siblings"), F.col("n") - 1, alg).alias("root"))


def _nodes(left: np.ndarray, right: np.ndarray, alg: str) -> np.ndarray:
    """Nodes over ``uint8[n, 32]`` children."""
    if alg == "poseidon":
        out = parents([(a.tobytes(), b.tobytes()) for a, b in zip(left, right, strict=True)], alg)
        return np.frombuffer(b"".join(out), np.uint8).reshape(-1, 32)
    from sealstone.operators.smt import nodes

    return nodes(left, right, alg)


def _binary(rows: np.ndarray) -> pa.Array:
    """``uint8[n, 32]`` as a column."""
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * 32), pa.py_buffer(np.ascontiguousarray(rows))])


def _plain(column: pa.Array | pa.ChunkedArray) -> np.ndarray | None:
    """A column as ``uint8[n, 32]``; none if a value is null or not of 32 bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros((0, 32), np.uint8)
    at = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    if column.null_count or (np.diff(at) != 32).any():
        return None
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].reshape(-1, 32)


def _levels(nodes: np.ndarray, full: int, levels: int, alg: str) -> Iterator[np.ndarray]:
    """Whole nodes of each height over neighbours of which the first ``full`` are whole."""
    for _ in range(levels + 1):
        yield nodes
        full //= 2
        nodes = _nodes(nodes[0 : 2 * full : 2], nodes[1 : 2 * full : 2], alg)


def _beside(rows: DataFrame, by: str, height: int, depth: int, alg: str, most: int) -> DataFrame:
    """For nodes (by, i, node) at a height, numbered from 0, what lies to the left of each on its way up: (by, i, node, siblings), an array from ``height`` to ``depth``.

    Runs of 2 ** STEP neighbours lie in one task each. They are folded first, and the full runs' roots are the nodes of the next round, in which there are so many times fewer; then each run is given what
    lies beside it, a row, and tells its nodes' paths: these are as long as the tree is high, and are neither written nor shuffled. A run that is not full has no node, and is its group's last."""
    empties, levels = zeros(alg, depth), min(STEP, depth - height)
    name, above = rows.schema[by].dataType.simpleString(), height + levels
    rest = np.frombuffer(b"".join(empties[above:depth]), np.uint8).reshape(-1, 32)

    def whole(own: pa.Table) -> tuple[pa.Table, np.ndarray, int]:
        """A run in order, its nodes and how many of them are whole: all, or all but the last."""
        own = own.sort_by("i")
        n, last = own.num_rows, own.column("node")[own.num_rows - 1].is_valid
        if last:
            return own, _plain(own.column("node")), n
        return own, np.concatenate([_plain(own.column("node").slice(0, n - 1)), np.zeros((1, 32), np.uint8)]), n - 1

    def root(own: pa.Table) -> pa.Table:
        own, nodes, full = whole(own)
        *_, top = _levels(nodes, full, levels, alg)
        place = int(own.column("i")[0].as_py()) >> levels
        return pa.table({by: own.column(by).slice(0, 1), "i": pa.array([place], pa.int64()), "node": pa.array([top[0].tobytes() if full == 1 << levels else None], pa.binary())})

    def run(own: pa.Table, up: np.ndarray) -> pa.Table:
        own, nodes, full = whole(own)
        n = own.num_rows
        place, siblings = own.column("i").to_numpy() % (1 << levels), np.empty((n, depth - height, 32), np.uint8)
        siblings[:, levels:] = up
        for h, level in zip(range(levels), _levels(nodes, full, levels, alg)):  # noqa: B905
            at = place >> h
            right = (at & 1) == 1
            siblings[right, h] = level[at[right] - 1]
            siblings[~right, h] = np.frombuffer(empties[height + h], np.uint8)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (depth - height)), _binary(siblings.reshape(-1, 32)))
        return pa.table({by: own.column(by), "i": own.column("i").cast(pa.int64()), "node": own.column("node").cast(pa.binary()), "siblings": flat})

    schema, nodes = f"`{by}` {name}, i long, node binary", rows.select(by, "i", "node")
    runs = nodes.groupBy(by, F.shiftright("i", levels).alias("run_"))
    if above >= depth or most <= 1 << levels:  # one run a group: nothing lies to the left of it
        return runs.applyInArrow(lambda own: run(own, rest), schema + ", siblings array<binary>")
    up = _beside(table(runs.applyInArrow(root, schema), "runs"), by, above, depth, alg, -(-most >> levels))
    beside = lambda own, up: run(own, _plain(up.column("siblings")[0].values))
    return runs.cogroup(up.groupBy(by, F.col("i").alias("run_"))).applyInArrow(beside, schema + ", siblings array<binary>")


def append_paths(rows: DataFrame, *, by: str, depth: int, alg: str = "blake3") -> DataFrame:
    """``rows(by, position, data)``, data 32 bytes: for each row the tree of a fixed depth as it was when it was the last: (by, i, leaf, siblings from the leaf up, root).

    To the right of it all was empty, so its siblings are the roots of the full subtrees to its left, which every later row shares; each is made once. More leaves than the tree holds are an error."""
    leaves = _numbered(rows, by, 1 << depth).withColumnRenamed("data", "node")
    most = leaves.agg(F.max("n")).first()[0] or 0
    paths = _beside(leaves, by, 0, depth, alg, most)
    return paths.select(by, "i", F.col("node").alias("leaf"), "siblings", fold_path(F.col("node"), F.col("siblings"), F.col("i"), alg).alias("root"))


#: Paths that are folded at once.
PATHS = 4096


def _folded(leaves: pa.Array, paths: pa.Array, places: pa.Array, alg: str) -> pa.Array:
    """``fold_path`` of a few rows."""
    good = np.array([x.is_valid and y.is_valid and z.is_valid for x, y, z in zip(leaves, paths, places, strict=True)], bool) if leaves.null_count or paths.null_count or places.null_count else np.ones(len(leaves), bool)
    on = pa.array(np.flatnonzero(good))
    own, kept = (leaves.take(on), paths.take(on)) if not good.all() else (leaves, paths)
    index = places.take(on).cast(pa.int64()).to_numpy(zero_copy_only=False)
    state, siblings, length = _plain(own), _plain(kept.flatten()), np.diff(kept.offsets.to_numpy())
    first = np.cumsum(length) - length
    if state is None or siblings is None:  # hashes of another length
        rows = [bytes(x) for x in own.to_pylist()]
        for level in range(length.max(initial=0)):
            which = np.flatnonzero(length > level).tolist()
            other = [bytes(kept[r][level].as_py()) for r in which]
            pairs = [(x, rows[r]) if index[r] >> level & 1 else (rows[r], x) for r, x in zip(which, other, strict=True)]
            for r, h in zip(which, parents(pairs, alg), strict=True):
                rows[r] = h
    else:
        state = state.copy()
        for level in range(length.max(initial=0)):
            which = np.flatnonzero(length > level)
            other, mine, right = siblings[first[which] + level], state[which], (index[which] >> level & 1 == 1)[:, None]
            state[which] = _nodes(np.where(right, other, mine), np.where(right, mine, other), alg)
        if good.all():
            return _binary(state)
        rows = [x.tobytes() for x in state]
    made = iter(rows)
    return pa.array([next(made) if g else None for g in good.tolist()], pa.binary())


def fold_path(leaf: Column, siblings: Column, index: Column, alg: str = "blake3") -> Column:
    """Root that a leaf (binary), its siblings from the leaf up (array of binary) and its index lead to; null if any is."""

    @F.arrow_udf(BinaryType())
    def run(leaves: pa.Array, paths: pa.Array, places: pa.Array) -> pa.Array:
        out = [_folded(leaves.slice(at, PATHS), paths.slice(at, PATHS), places.slice(at, PATHS), alg) for at in range(0, len(leaves), PATHS)]
        return pa.concat_arrays(out) if out else pa.array([], pa.binary())

    return run(leaf, siblings, index)


def transition_roots(snapshots: DataFrame, alg: str = "blake3") -> DataFrame:
    """``snapshots(leaf, siblings, size)`` with the roots that the path leads to: ``before_``, with an empty leaf, and ``after_``, with the leaf. Leaf and siblings are left out: two hashes are all that a verdict needs."""
    place = F.col("size") - 1
    before, after = fold_path(F.lit(bytes(32)), F.col("siblings"), place, alg), fold_path(F.col("leaf"), F.col("siblings"), place, alg)
    return snapshots.withColumn("before_", before).withColumn("after_", after).drop("leaf", "siblings")


def transition_verdict(before: Column, after: Column) -> Column:
    """Whether the roots that a path leads to are those stated, ``prev_root`` and ``root``."""
    return F.when(~before.eqNullSafe(F.col("prev_root")), "not-an-append").when(~after.eqNullSafe(F.col("root")), "root-mismatch").otherwise("valid")


def append_transition(snapshots: DataFrame, alg: str = "blake3") -> DataFrame:
    """``snapshots(prev_root, root, leaf, siblings, size)`` with ``verdict``: one path, with an empty leaf, gives the root before, and with the leaf the root after."""
    kept = snapshots.withColumns({"leaf_": F.col("leaf"), "siblings_": F.col("siblings")})
    checked = transition_roots(kept, alg).withColumn("verdict", transition_verdict(F.col("before_"), F.col("after_")))
    return checked.withColumnsRenamed({"leaf_": "leaf", "siblings_": "siblings"}).select(*snapshots.columns, "verdict")


def snapshot_faults(records: DataFrame, snapshots: DataFrame, *, by: str, depth: int, alg: str = "blake3") -> DataFrame:
    """Stated snapshots (by, size, leaf, root) against their records (by, position, data): the first rule broken, or valid.

    Rules in order: as many records as the size says; positions from 0 without gaps; the last leaf; the rebuilt root."""
    facts = records.groupBy(by).agg(F.count("*").alias("n_"), F.min("position").alias("lo_"), F.max("position").alias("hi_"), F.countDistinct("position").alias("k_"))
    built = snapshot_paths(records, by=by, depth=depth, alg=alg).select(by, F.col("leaf").alias("leaf_"), F.col("root").alias("root_"))
    rows = snapshots.join(facts, by, "left").join(built, by, "left")
    gaps = (F.col("lo_") != 0) | (F.col("hi_") != F.col("n_") - 1) | (F.col("k_") != F.col("n_"))
    verdict = F.when(~F.col("n_").eqNullSafe(F.col("size")), "size-mismatch").when(gaps, "not-contiguous").when(~F.col("leaf_").eqNullSafe(F.col("leaf")), "leaf-mismatch").when(~F.col("root_").eqNullSafe(F.col("root")), "root-mismatch").otherwise("valid")
    return rows.withColumn("verdict", verdict).select(*snapshots.columns, "verdict")


def path_with_sides(leaf: Column, path: Column, alg: str = "sha256") -> Column:
    """Legacy proof: ``path`` is an array of (hash binary, side 'left' or 'right' of the sibling). ``sha256`` folds inside the JVM."""
    if alg != "sha256":
        index = F.aggregate(F.transform(path, lambda x, i: F.when(x["side"] == "left", F.shiftleft(F.lit(1), i)).otherwise(0)), F.lit(0), lambda a, b: a + b)
        return fold_path(leaf, F.transform(path, lambda x: x["hash"]), index, alg)
    prefix, bar = F.lit(NODE + SEPARATOR), F.lit(SEPARATOR)
    step = lambda a, x: F.unhex(F.sha2(F.when(x["side"] == "left", F.concat(prefix, x["hash"], bar, a)).otherwise(F.concat(prefix, a, bar, x["hash"])), 256))
    return F.aggregate(path, leaf, step)
