"""How filters overlap: which documents each one removes in every order of application, by part of a corpus.

Five conditions make one mask of five bits a document. Four look at the text alone. The fifth, whether a smaller key has the same text, is found by
sorting: rows are dealt to ranges of (text fingerprint, key), sorted there by fingerprint, whole text and key, and compared with their predecessors. A text
that runs over the bounds of ranges has its first rows there undecided; the smallest key of such a text over all ranges decides them. Every other
row is decided where it lies, so copies of one text, however many, never meet in one task. Masks are added up to counters by part, mask and label, 32 masks
a part; all orders and steps are read off these.

A document fails if

- A: it has under 200 words (maximal runs without space and bytes 0x09 to 0x0D);
- B: 100 * distinct words < 50 * words, case-sensitive;
- C: 100 * letters A to Z > 3 * code points;
- D: it holds any of # $ % & * |;
- E: its text is that of a smaller key, in the whole table, removed or not.

A null text is empty, a null part the empty string. A row with a null key fails E by no other row and makes none fail; rows that repeat a key are rows of their
own, which do not make each other fail. Several labels of one key count as 1 if any is 1. An empty table has no parts and no rows."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealstone.llm.common import buffers, slices, split_words, table

FILTERS = "ABCDE"
WORDS_LEAST, DISTINCT_PERCENT, UPPER_PERCENT, MARKS = 200, 50, 3, b"#$%&*|"
E_BIT = 1 << FILTERS.index("E")


def text_masks(texts: pa.Array) -> np.ndarray:
    """Bits A to D of each text."""
    data, off = buffers(texts)
    split = split_words(data, off)
    codes, distinct = split.codes()
    doc = np.repeat(np.arange(len(off) - 1), split.counts)
    pairs = np.unique(doc * np.int64(max(1, len(distinct))) + codes) if len(codes) else np.zeros(0, np.int64)
    n_distinct = np.bincount(pairs // max(1, len(distinct)), minlength=len(off) - 1)

    def per_text(which: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(which), off))

    upper, points = per_text((data - np.uint8(65)) < 26), per_text((data & 0xC0) != 0x80)
    marks = per_text(np.isin(data, np.frombuffer(MARKS, np.uint8)))
    fails = (split.counts < WORDS_LEAST, 100 * n_distinct < DISTINCT_PERCENT * split.counts, 100 * upper > UPPER_PERCENT * points, marks > 0)
    return sum(f.astype(np.int64) << i for i, f in enumerate(fails))


OUT = "key long, part string, mask int, text binary, run boolean, n long"
#: Rows that are given out together, and rows of one fingerprint that wait at most.
TOGETHER = 8192


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one range (print, text, key, part) to counted rows. ``text`` is the digest of a text whose fingerprint is the range's first or last, for such a text
    may run on in another range: its rows of its smallest key here are undecided in E, and one of them has ``run``. All other rows are decided and have no ``text``."""
    ready: list[tuple] = []
    waiting: dict[tuple, int] = {}  # rows of the present fingerprint: (key, part, mask, text if the key is the text's smallest here) to their number
    first = last = same = least = None

    def settle(tell: bool) -> None:
        told: set[str] = set()
        for (key, part, mask, text), n in waiting.items():
            digest = sha256(text.encode()).digest() if tell and text is not None else None
            ready.append((key, part, mask, digest, digest is not None and text not in told, n))
            told.add(text)
        waiting.clear()

    def out() -> pa.RecordBatch:
        columns = dict(zip(("key", "part", "mask", "text", "run", "n"), zip(*ready, strict=True), strict=True))
        types = {"key": pa.int64(), "part": pa.string(), "mask": pa.int32(), "text": pa.binary(), "run": pa.bool_(), "n": pa.int64()}
        ready.clear()
        return pa.RecordBatch.from_pydict({c: pa.array(v, types[c]) for c, v in columns.items()})

    for batch in batches:
        for rows in slices(batch, "text"):
            found = text_masks(rows.column("text")).tolist()
            for print_, text, key, part, mask in zip(*(rows.column(c).to_pylist() for c in ("print", "text", "key", "part")), found, strict=True):
                if print_ != last:
                    settle(last == first)
                    first, last, same = print_ if first is None else first, print_, None
                if text != same:
                    same, least = text, key
                again = key is not None and key > least
                row = (key, part, mask | E_BIT, None) if again else (key, part, mask, text if key is not None else None)
                waiting[row] = waiting.get(row, 0) + 1
                if again and len(waiting) >= TOGETHER:  # decided rows need not wait
                    ready += [(*r[:3], None, False, waiting.pop(r)) for r in [r for r in waiting if r[3] is None]]
                if len(ready) >= TOGETHER:
                    yield out()
    settle(True)
    if ready:
        yield out()


def masks(docs: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``(key, part, mask, n)``: the conditions that documents fail, bit i the i-th of FILTERS; ``n`` rows alike."""
    own = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sorted_ = own.withColumn("print", F.xxhash64("text")).repartitionByRange("print", F.col("key").asc_nulls_last()).sortWithinPartitions("print", "text", F.col("key").asc_nulls_last())
    rows = table(sorted_.select("print", "text", "key", "part").mapInArrow(compared, OUT).groupBy("key", "part", "mask", "text").agg(F.max("run").alias("run"), F.sum("n").alias("n")), "masks")
    # The smallest key of a text over the ranges it lies in: two rows for each range, and the copies of a fingerprint's other texts.
    least = rows.filter("run").groupBy("text").agg(F.min("key").alias("least"))
    open_ = rows.filter("text is not null").join(least, "text")
    late = F.when(F.col("key") > F.col("least"), F.col("mask").bitwiseOR(F.lit(E_BIT))).otherwise(F.col("mask"))
    return rows.filter("text is null").select("key", "part", "mask", "n").union(open_.select("key", "part", late.alias("mask"), "n"))


def counters(masked: DataFrame, labels: DataFrame, *, key: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents of each mask, and those of them that the labels call good and toxic."""
    said = labels.groupBy(F.col(key).cast("long").alias("key")).agg(F.max((F.col(quality) == 1).cast("int")).alias("good"), F.max((F.col(toxic) == 1).cast("int")).alias("toxic"))
    each = masked.groupBy("key", "part", "mask").agg(F.sum("n").alias("n"))
    known = each.join(said, "key", "left")
    flagged = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c)
    return known.groupBy("part", "mask").agg(F.sum("n").alias("n"), flagged("good"), flagged("toxic"))


def interactions(counted: DataFrame) -> DataFrame:
    """Counters to a row for each part, order of the filters and step, with what that step's filter does there."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    steps = [(order, k + 1, bit[f], sum(bit[g] for g in order[:k])) for order in map("".join, permutations(FILTERS)) for k, f in enumerate(order)]
    each = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(f).alias("own"), F.lit(b).alias("before")) for o, k, f, b in steps))
    of_part = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("rows"))  # 32 at most

    def total(which, value=lambda x: x["n"]) -> Column:
        return F.aggregate(F.col("rows"), F.lit(0).cast("long"), lambda a, x: a + F.when(which(x["mask"]), value(x)).otherwise(F.lit(0).cast("long")))

    own, before = F.col("at.own"), F.col("at.before")
    fails = lambda m: m.bitwiseAND(own) != 0
    stays = lambda m: m.bitwiseAND(before) == 0
    removed = lambda m: fails(m) & stays(m)
    # Of the orders, in so many a filter comes first among the k that a document fails.
    firsts = F.array(*(F.lit(len(steps) // len(FILTERS) // max(k, 1)) for k in range(len(FILTERS) + 1)))
    share = lambda x: x["n"] * F.get(firsts, F.bit_count(x["mask"]))
    out = {
        "kept": total(lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0), "removed": total(removed), "redundant": total(lambda m: fails(m) & ~stays(m)), "unique_fails": total(lambda m: m == own),
        "good_lost": total(removed, lambda x: x["good"]), "toxic_lost": total(removed, lambda x: x["toxic"]), "shapley": total(fails, share),
    }
    return of_part.withColumn("at", F.explode(each)).select("part", "at.filter_order", "at.step", *(v.alias(k) for k, v in out.items()))


def audit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """A row for each part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return interactions(counters(masks(docs, key=key, text=text, part=part), labels, key=key))
