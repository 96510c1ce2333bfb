"""Mixing sources to target weights.

Each source has a target in words. Its documents get hash-random keys and are taken in that order,
over and over, until the target is met; the last one is cut to the exact number of words left.

The order is that of a range sort: hash keys are uniform, so their leading bits give ranges of like
size without sampling. The number of bits follows each source's number of documents, so a range
holds about RANGE documents even of a source with a third of all rows. Running totals are taken over documents in a
range, ranges in a block, and blocks in a source: each window is small.

A null text has 0 words; documents without words are never taken, unless with the whole source.
A null source is a source of its own, the last. Rows that repeat a doc_id count each by itself, side by side in the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealstone.llm.common import n_words, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
EPOCHS = 2
RANGE = 64


def targets(sizes: DataFrame, *, source: str = "source", size: str = "size", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """A row for each source: its number, documents, words (``source_size``), and target.

    Sources in code-point order, null last, have the weights in turn. Targets are in proportion to the weights
    and stop at ``epochs`` times the source's words; what that leaves over goes to the others by weight.
    With sources in the order of words per weight, those that stop are a beginning of the list, so one running total finds them."""
    each = sizes.groupBy(source).agg(F.sum(size).alias("source_size"), F.count("*").alias("n_docs"))
    number = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1  # rows here are sources
    cap = F.col("source_size") * F.lit(float(epochs))
    order = Window.orderBy(cap / F.col("weight"), F.col("n"))
    weighted = each.withColumn("n", number).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int"))).withColumn("cap", cap)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = weighted.withColumn("level", left / rest)  # words a unit of weight, if all sources before stop
    stops = F.col("cap") <= F.col("level") * F.col("weight")
    first_open = F.min(F.when(~stops, F.struct("ratio", "n", "level"))).over(everything)
    held = levels.withColumn("ratio", cap / F.col("weight")).withColumn("open", first_open)
    target = F.when(F.col("open").isNull() | (F.struct("ratio", "n") < F.struct(F.col("open.ratio"), F.col("open.n"))), F.col("cap")).otherwise(F.col("open.level") * F.col("weight"))
    return held.select(source, F.col("n").cast("long").alias("n"), "n_docs", F.col("source_size").cast("long").alias("source_size"), target.cast("double").alias("target"))


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: key, size, source_size, target, taken, and the columns ``keep``.

    ``taken`` = full rounds of the whole source times its size, and what falls below the source's remaining words in hash order."""
    sized = table(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), *(F.col(c).alias(f"kept_{c}") for c in keep), F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long").alias("k"), F.monotonically_increasing_id().alias("row")), "sizes")
    per_source = table(targets(sized, weights=weights, share=share, epochs=epochs), "targets")
    # One row a source: joined by its name, null safe.
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("n_docs") / RANGE, F.lit(1.0))))).cast("int")
    named = per_source.withColumn("bits", bits).withColumnRenamed("source", "named")
    rows = sized.join(named, sized["source"].eqNullSafe(named["named"])).drop("named", "source")
    spot = F.expr("shiftright(k, 60 - bits)")  # of 60 random bits
    rows = rows.withColumn("spot", F.when(F.col("bits") > 0, spot).otherwise(F.lit(0).cast("long"))).withColumn("block", F.expr("shiftright(spot, cast(ceil(bits / 2) as int))"))
    range_ = Window.partitionBy("n", "block", "spot")
    in_range = F.coalesce(F.sum("size").over(range_.orderBy("k", "key", "row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("in_range", in_range)
    spots = sized_spots = rows.groupBy("n", "block", "spot").agg(F.sum("size").alias("words"))
    blocks = sized_spots.groupBy("n", "block").agg(F.sum("words").alias("words"))
    upto = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    spots = spots.select("n", "block", "spot", F.coalesce(F.sum("words").over(upto("n", "block", "spot")), F.lit(0)).alias("in_block"))
    blocks = blocks.select("n", "block", F.coalesce(F.sum("words").over(upto("n", "block")), F.lit(0)).alias("in_source"))
    starts = spots.join(blocks, ["n", "block"]).withColumn("before_range", F.col("in_block") + F.col("in_source")).select("n", "block", "spot", "before_range")
    rows = rows.join(starts, ["n", "block", "spot"]).withColumn("before", F.col("before_range") + F.col("in_range"))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    rounds = F.least(F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(F.lit(0)), F.lit(epochs)).cast("long")
    over = budget - rounds * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), over - F.col("before")))
    taken = F.least(rounds * F.col("size") + part, F.col("size") * epochs).cast("long")
    return rows.select(F.col("key").alias(key), "size", "source_size", "target", taken.alias("taken"), *(F.col(f"kept_{c}").alias(c) for c in keep))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: a row for each time one is taken, the last cut after its last word taken; columns of ``docs``."""
    text = options.get("text", "text")
    numbered = table(docs.withColumn("sealstone_row", F.monotonically_increasing_id()), "mix-input")
    counts = mix(numbered, keep=("sealstone_row",), **options).select(F.col("sealstone_row").alias("sealstone_of"), F.col("size").alias("sealstone_size"), F.col("taken").alias("sealstone_taken")).filter("sealstone_taken > 0")
    rows = numbered.join(counts, F.col("sealstone_row") == F.col("sealstone_of"))
    whole, part = F.floor(F.col("sealstone_taken") / F.col("sealstone_size")).cast("int"), (F.col("sealstone_taken") % F.col("sealstone_size")).cast("int")
    turns = F.sequence(F.lit(1), whole + F.when(part > 0, 1).otherwise(0))
    rows = rows.withColumn("sealstone_turn", F.explode(turns))
    # A piece is a word with the space before it.
    words = F.slice(F.split(F.col(text), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1), 1, part)
    cut = F.when(F.col("sealstone_turn") > whole, F.array_join(words, "")).otherwise(F.col(text))
    out = rows.withColumn(text, cut)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast("long"))
    return out.select(*docs.columns)
