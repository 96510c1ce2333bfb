"""How sources differ in their words: exact distances between the term distributions of groups, and the terms that stand out in each.

Texts are counted where they lie, by (part, source, term), and summed by key. A part keeps the terms in at least LEAST of its documents. Kept terms are dealt to blocks
of the part; in a block a dense int64 tile holds the probabilities of all its sources by its terms, zeros included, and all pairs of sources are made by broadcasting one row
against the tile. A block gives for each source the vector of its partial sums against the others, and a heap of its outstanding terms; the vectors of all blocks are summed and the heaps merged
for each source. No task holds more than a tile (CELLS numbers, TERMS_LEAST terms at least) or the vectors of one source; the result itself has a row for each pair of sources of a part.

Terms are maximal runs of ASCII letters and characters beyond ASCII, A to Z lower-cased. A null text has no terms, a null part or source is the empty string. A group is every (part, source) that occurs.
With V kept terms in the part and N their occurrences in the group, a term's p is 1 + floor(10**9 * (count + 5) / (N + 5 * V)), in whole numbers however large. Rows that repeat a key are
documents of their own. An empty table has no groups and no rows; a part of one source has no pairs."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealstone.llm.common import buffers, slices, split_words, table

LEAST = 30
EXTRA, SCALE = 5, 1_000_000_000
TOP = 50
#: Numbers of a tile, and terms of a block at least and at most.
CELLS, TERMS_LEAST, TERMS = 1 << 22, 16, 512
#: Counted rows that a task holds before it gives them out.
HELD = 1 << 19


def probabilities(count: np.ndarray, total: np.ndarray, n_terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + EXTRA) / (total + EXTRA * n_terms)) in int64, by long division three digits at a time (totals up to 10**15)."""
    below = total + EXTRA * n_terms
    rest, out = np.broadcast_arrays(count + EXTRA, below)[0].astype(np.int64), np.int64(0)
    for _ in range(3):  # SCALE is 1000 ** 3
        rest = rest * 1000
        out = out * 1000 + rest // below
        rest = rest % below
    return 1 + out


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, source, text) to (part, source, term, n, docs), summed as far as HELD rows of a task."""
    held, n_held = [], 0

    def summed(tables: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(tables).combine_chunks().group_by(["part", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return t.rename_columns(["part", "source", "term", "n", "docs"])

    for batch in batches:
        for rows in slices(batch, "text"):
            data, off = buffers(rows.column("text"))
            letter = (data | 32) - np.uint8(97) < 26
            data = data + (((data - np.uint8(65)) < 26).astype(np.uint8) << np.uint8(5))
            split = split_words(data, off, ~(letter | (data >= 128)))
            codes, distinct = split.codes()
            if not len(codes):
                continue
            group = pa.StructArray.from_arrays([rows.column("part"), rows.column("source")], ["part", "source"])
            names: dict[tuple, int] = {}
            of_row = np.array([names.setdefault((g["part"], g["source"]), len(names)) for g in group.to_pylist()], np.int64)
            doc = np.repeat(np.arange(len(of_row)), split.counts)
            width = np.int64(len(distinct))
            in_doc, n = np.unique(doc * width + codes, return_counts=True)  # each term of each document once
            pair, at = np.unique(of_row[in_doc // width] * width + in_doc % width, return_inverse=True)
            many = np.bincount(at, weights=n, minlength=len(pair)).astype(np.int64)
            parts, sources = (pa.array([k[i] for k in names], pa.string()) for i in (0, 1))
            g = pa.array(pair // width)
            held.append(pa.table({"part": parts.take(g), "source": sources.take(g), "term": distinct.take(pa.array(pair % width)).cast(pa.string()), "n": many, "docs": np.bincount(at, minlength=len(pair)).astype(np.int64)}))
            n_held += len(pair)
            if n_held >= HELD:
                held = [summed(held)]
                n_held = held[0].num_rows
                if n_held >= HELD // 2:
                    yield from held[0].to_batches(max_chunksize=1 << 16)
                    held, n_held = [], 0
    if held:
        yield from summed(held).to_batches(max_chunksize=1 << 16)


def outstanding(terms: list[str], excess: np.ndarray, top: int) -> list[tuple[int, str]]:
    """The ``top`` terms of largest positive excess, then smallest by code points (the order of their UTF-8 bytes)."""
    some = np.flatnonzero(excess > 0)
    if len(some) > top:  # all that tie with the last one stay
        some = some[excess[some] >= -np.partition(-excess[some], top - 1)[top - 1]]
    return heapq.nsmallest(top, ((-int(excess[i]), terms[i]) for i in some.tolist()))


BLOCK = "part string, source string, block int, sums array<long>, others array<string>, terms array<string>, excess array<long>"


def tile(top: int):
    """For one block: its terms (term, all, sources, counts) and the part's sources (source, total, part_total, n_terms) to a row for each source. The first block has the sources' names."""

    def run(key: tuple, terms: pa.Table, groups: pa.Table) -> pa.Table:
        part, block = (x.as_py() for x in key)
        groups = groups.sort_by("source")
        sources = groups.column("source").to_pylist()
        total, part_total, n_terms = groups.column("total").to_numpy(), int(groups.column("part_total")[0].as_py()), int(groups.column("n_terms")[0].as_py())
        names = terms.column("term").to_pylist()
        count = np.zeros((len(sources), len(names)), np.int64)
        if names:
            place = {s: i for i, s in enumerate(sources)}
            lists = terms.column("sources").combine_chunks()
            column = np.repeat(np.arange(len(names)), np.diff(lists.offsets.to_numpy()))
            row = np.fromiter((place[s] for s in lists.flatten().to_pylist()), np.int64, len(column))
            count[row, column] = terms.column("counts").combine_chunks().flatten().to_numpy()
        p = probabilities(count, total[:, None], n_terms) if names else count
        q = probabilities(terms.column("all").to_numpy(), np.int64(part_total), n_terms) if names else count[0]
        sums, heaps = [], []
        for i in range(len(sources)):
            sums.append(np.abs(p - p[i]).sum(axis=1))
            heaps.append(outstanding(names, np.where(count[i] > 0, p[i] - q, 0), top))
        return pa.table({
            "part": [part] * len(sources), "source": sources, "block": pa.array([block] * len(sources), pa.int32()), "sums": pa.array(sums, pa.list_(pa.int64())),
            "others": pa.array([sources if block == 0 else None] * len(sources), pa.list_(pa.string())),
            "terms": pa.array([[t for _, t in h] for h in heaps], pa.list_(pa.string())), "excess": pa.array([[-v for v, _ in h] for h in heaps], pa.list_(pa.int64())),
        })

    return run


RANKED = "part string, source string, kind string, item string, value long, rank int"


def merged(top: int):
    """All blocks' rows of one source to its ranked rows: the others by summed distance, and the merged heaps' first ``top``."""

    def run(rows: pa.Table) -> pa.Table:
        part, source = rows.column("part")[0].as_py(), rows.column("source")[0].as_py()
        others = next(x for x in rows.column("others").to_pylist() if x is not None)
        sums = rows.column("sums").combine_chunks().flatten().to_numpy().reshape(-1, len(others)).sum(axis=0).tolist()
        far = sorted((-v, s) for v, s in zip(sums, others, strict=True) if s != source)
        heaps = (sorted(zip((-v for v in e), t, strict=True)) for t, e in zip(rows.column("terms").to_pylist(), rows.column("excess").to_pylist(), strict=True))
        most = [x for _, x in zip(range(top), heapq.merge(*heaps), strict=False)]
        out = [("pair", s, -v, r + 1) for r, (v, s) in enumerate(far)] + [("term", t, -v, r + 1) for r, (v, t) in enumerate(most)]
        kind, item, value, rank = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table({"part": pa.array([part] * len(out), pa.string()), "source": pa.array([source] * len(out), pa.string()), "kind": pa.array(kind, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64()), "rank": pa.array(rank, pa.int32())})

    return run


def divergence(docs: DataFrame, *, text: str = "text", part: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """``(part, source, kind, item, value, rank)``: for each group its distance to every other source of the part (kind ``pair``), and its ``top`` outstanding terms (kind ``term``)."""
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((part, "part"), (source, "source"), (text, "text"))))
    partial = own.mapInArrow(term_counts, "part string, source string, term string, n long, docs long")
    counts = table(partial.groupBy("part", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    # Of each term one row, with an entry for each source that has it.
    by_term = counts.groupBy("part", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"), F.collect_list(F.struct("source", "n")).alias("of"))
    kept = table(by_term.filter(F.col("docs") >= least).drop("docs"), "kept-terms")
    parts = kept.groupBy("part").agg(F.count("*").alias("n_terms"), F.sum("all").alias("part_total"))
    totals = kept.select("part", F.explode("of").alias("x")).groupBy("part", "x.source").agg(F.sum("x.n").alias("total"))
    groups = own.select("part", "source").distinct().join(totals, ["part", "source"], "left").join(parts, "part", "left").na.fill(0, ["total", "n_terms", "part_total"])
    size = groups.groupBy("part").agg(F.count("*").alias("n_sources"))
    groups = groups.join(size, "part")
    in_block = F.least(F.lit(TERMS), F.greatest(F.lit(TERMS_LEAST), F.floor(F.lit(CELLS) / F.col("n_sources"))))
    groups = table(groups.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("n_terms") / in_block)).cast("int")), "groups")
    blocks = groups.groupBy("part").agg(F.first("blocks").alias("blocks"))
    left = kept.join(blocks, "part").select("part", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "term", "all", F.col("of.source").alias("sources"), F.col("of.n").alias("counts"))
    right = groups.select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "total", "part_total", "n_terms")
    tiles = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(tile(top), BLOCK)
    return table(tiles, "tiles").groupBy("part", "source").applyInArrow(merged(top), RANKED)
