"""Fingerprints of documents after SpotSigs: chains of content words that follow common words. Native: no Python on any path.

Words are maximal runs of ASCII letters and digits and of characters beyond ASCII, in lower case. Common words (``ANCHORS``) begin signatures: a content word
right after a common word, with the CHAIN - 1 content words that follow it (common words between them are passed over; fewer at the end of the text). A text
in which no common word stands before a content word has a chain from each content word; one of common words alone has its whole sequence. The
fingerprint is the set of the chains' 64-bit digests, ascending, as 16 hexadecimal digits each. Null and empty texts, and texts without words, have the empty fingerprint.

The likeness of two fingerprints is the Jaccard similarity of the sets, 1 for two empty ones and 0 for an empty and another one. Sets whose sizes differ too
much for the threshold are told apart by size alone: sizes fall into partitions whose bounds grow by 1 / threshold, so sets that can be alike are in one partition
or in neighbouring ones; ``similar`` joins there by the rarest chains, passes over pairs that size or place rule out, and intersects the rest."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealstone.llm.common import table

#: Common words of English, German, French, Spanish, Italian, Portuguese and Dutch (fixed values, the usual stop words).
ANCHORS = (
    "a an and are as at be but by for from had has have he her his if in is it its not of on or she so that the their there they this to was we were which will with would you "
    "aber als auch auf aus bei das dem den der des die ein eine einem einen einer es für hat ich im ist mit nach nicht noch sich sie sind über um und von war wie wird zu zum zur "
    "au aux avec ce cette dans de du elle en est et il la le les leur mais ne ou par pas plus pour que qui sa se ses son sont sur un une "
    "al como con del el ella entre era esta este fue ha hay las lo los más muy no para pero por sin sobre su sus una y ya "
    "che da della di gli nel non per è da do dos em foi mais na não os seu um uma aan dat een het niet ook van voor"
).split()
CHAIN = 3
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a range that are kept in order together, and ranges at most.
ROWS, RANGES = 2048, 65_536


def with_signatures(df: DataFrame, text: Column, name: str, anchors: list[str] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """``df`` with column ``name``: the digests of the text's chains, distinct and ascending."""
    ws, tag, at, sig = (f"{name}_{x}" for x in ("words", "tags", "at", "chains"))
    # A column at a time, each read more than once, so that none is evaluated twice.
    df = df.withColumn(ws, F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)))
    df = df.withColumn(tag, F.transform(ws, lambda w, i: F.when(~w.isin(anchors), i)))
    df = df.withColumn(at, F.array_compact(tag))
    followers = lambda p, j: [F.get(ws, p), *(F.get(ws, F.get(at, j + k)) for k in range(1, chain))]
    df = df.withColumn(sig, F.array_compact(F.transform(at, lambda p, j: F.when((p > 0) & F.get(tag, p - 1).isNull(), F.xxhash64(F.get(ws, p - 1), *followers(p, j))))))
    plain = F.transform(at, lambda p, j: F.xxhash64(*followers(p, j)))
    whole = F.array(F.xxhash64(F.concat_ws(" ", ws)))
    none = F.array().cast("array<bigint>")
    df = df.withColumn(name, F.array_sort(F.array_distinct(F.when(F.size(sig) > 0, F.col(sig)).when(F.size(at) > 0, plain).when(F.size(ws) > 0, whole).otherwise(none))))
    return df.drop(ws, tag, at, sig)


def as_text(signatures: Column) -> Column:
    return F.array_join(F.transform(signatures, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of digests; sizes alone decide where one is empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", anchors: list[str] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """A row for each document: key, signatures (digests, ascending), fingerprint (text)."""
    own = docs.select(F.col(key), F.col(text).cast("string").alias("sealstone_text"))
    return with_signatures(own, F.col("sealstone_text"), "signatures", anchors, chain).select(key, "signatures", as_text(F.col("signatures")).alias("fingerprint"))


def ranges(keys: DataFrame, order: Column, n: int) -> DataFrame:
    """One row: array ``least`` of the smallest ``order`` of each of up to ``n`` ranges of like size, and ``most`` of the largest."""
    in_range = keys.select(order.alias("o")).repartitionByRange(n, "o").groupBy(F.spark_partition_id().alias("p")).agg(F.min("o").alias("least"), F.max("o").alias("most"))
    return in_range.agg(F.array_sort(F.collect_list("least")).alias("least"), F.array_sort(F.collect_list("most")).alias("most"))


def range_of(order: Column, least: Column) -> Column:
    """Number of the range a row falls into: the last whose least is not beyond it, by binary search."""
    steps = F.array(*(F.lit(1 << k) for k in range(RANGES.bit_length(), -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(least, at + step) <= order, at + step).otherwise(at))


def with_next(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rows: int = ROWS) -> DataFrame:
    """``(key, text, next, within)``: each document with the text of the next one in descending key order, after the last the first's. Rows that repeat a key follow by their text's digest, a null key
    comes after all others. ``b`` and ``place`` are the range and the order there, by which the rows lie; the rows with ``copy`` are the first ones of the range after, not to be counted.

    Keys are dealt to ranges of like size. The last of a range is next to the first of the one below, which is dealt to both: so texts are shuffled once and no window is over all rows. Rows alike in key and text are in one range."""
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = F.struct(F.col("key").alias("key"), F.xxhash64("text").alias("digest"))
    n = max(1, min(RANGES, -(-docs.count() // rows)))
    bounds = table(ranges(own, order, n), "ranges")
    dealt = own.withColumn("o", order).crossJoin(F.broadcast(bounds))  # of one row
    dealt = dealt.withColumn("b", range_of(F.col("o"), F.col("least"))).withColumn("is_first", F.col("o") == F.get("most", F.col("b")))
    here, there = F.struct(F.col("b").alias("b"), F.lit(False).alias("copy")), F.struct(((F.col("b") + 1) % F.size("most")).alias("b"), F.lit(True).alias("copy"))
    return dealt.withColumn("at", F.explode(F.when(F.col("is_first"), F.array(here, there)).otherwise(F.array(here)))).select("key", "text", "o", "at.b", "at.copy")


def edits(docs: DataFrame, *, key: str = "doc_id", text: str = "text", anchors: list[str] = ANCHORS, chain: int = CHAIN, rows: int = ROWS) -> DataFrame:
    """How far a fingerprint follows an edit: a row for each document with key, n_chars, edited (the text, its last half replaced by as much of the next document's beginning), signatures, edited_signatures, next_signatures."""
    w = Window.partitionBy("b").orderBy("copy", F.desc("o"))
    out = with_next(docs, key=key, text=text, rows=rows)
    out = out.withColumn("next", F.lead("text").over(w))
    out = with_signatures(out, F.col("text"), "signatures", anchors, chain).withColumn("next_signatures", F.lead("signatures").over(w))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    out = out.filter(~F.col("copy")).select(F.col("key").alias(key), n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half)).alias("edited"), "signatures", "next_signatures")
    return with_signatures(out, F.col("edited"), "edited_signatures", anchors, chain)


def similar(queries: DataFrame, corpus: DataFrame, *, key: str = "doc_id", percent: int = 80) -> DataFrame:
    """Pairs of a query and a corpus fingerprint (tables of ``fingerprints``) with likeness of ``percent`` or more: ``(query, found, likeness)``; a query's own key is no hit. Empty sets find nothing.

    A set of n shares one of its n - ceil(percent n / 100) + 1 rarest chains with any that is so like it; chains are ordered by the number of corpus sets they are in, which is counted. The join is by size partition and chain."""
    step = math.log(100 / percent) if percent < 100 else math.inf
    size_part = lambda n: F.floor(F.log(n.cast("double")) / F.lit(step)).cast("int") if step != math.inf else F.lit(0)
    both = [t.filter(F.size("signatures") > 0).select(F.col(key).alias("key"), "signatures").withColumn("n", F.size("signatures")) for t in (queries, corpus)]
    held = both[1].select(F.explode("signatures").alias("s")).groupBy("s").count()
    mark = F.monotonically_increasing_id()

    def listed(t: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        t = table(t.withColumn("row", mark), name)
        each = t.select("row", "n", F.explode("signatures").alias("s")).join(held, "s", "left")
        rank = F.row_number().over(Window.partitionBy("row").orderBy(F.coalesce("count", F.lit(0)), "s"))
        most = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
        return t, each.withColumn("rank", rank).filter(F.col("rank") <= most).select("row", "n", "s", "rank", size_part(F.col("n")).alias("part"))

    (q, q_list), (c, c_list) = listed(both[0], "spot-queries"), listed(both[1], "spot-corpus")
    q_list = q_list.select(F.col("row").alias("q"), F.col("n").alias("qn"), "s", F.col("rank").alias("q_rank"), F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"))
    # What follows the shared chain in either order must still hold the overlap that the threshold asks for.
    need = F.ceil(percent * (F.col("qn") + F.col("n")) / F.lit(100 + percent))
    fits = (100 * F.least("qn", "n") >= percent * F.greatest("qn", "n")) & (F.least(F.col("qn") - F.col("q_rank"), F.col("n") - F.col("rank")) + F.least("q_rank", "rank") >= need)
    pairs = q_list.join(c_list, ["part", "s"]).filter(fits).select("q", F.col("row").alias("c")).distinct()
    found = pairs.join(q.select(F.col("row").alias("q"), F.col("key").alias("query"), F.col("signatures").alias("a")), "q").join(c.select(F.col("row").alias("c"), F.col("key").alias("found"), F.col("signatures").alias("b")), "c")
    return found.filter(~F.col("query").eqNullSafe(F.col("found"))).withColumn("likeness", likeness(F.col("a"), F.col("b"))).filter(F.col("likeness") * 100 >= percent).select("query", "found", "likeness")
