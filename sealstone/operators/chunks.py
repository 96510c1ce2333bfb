"""Sixteen equal chunks of a file: hashes, tree, redaction in place, commitments to what is revealed."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sealstone.functions import lanes
from sealstone.functions import poseidon as field
from sealstone.functions.framing import digest

CHUNKS = 16


def chunk_size(content: Column) -> Column:
    return F.greatest(F.ceil(F.octet_length(content) / CHUNKS), F.lit(1)).cast("int")


def chunk_hash(content: Column, i: Column, alg: str = "blake3") -> Column:
    """Digest of chunk ``i``, filled up with zeros to the common size; chunks beyond a short file are all zeros."""
    size = chunk_size(content)
    part = F.substring(content.cast("binary"), i.cast("int") * size + 1, size)
    return digest(F.unhex(F.rpad(F.hex(part), size * 2, "0")), alg)


def reveal_mask(length: Column, ranges: Column) -> Column:
    """Sixteen ones and zeros: 0 for a chunk that a range (struct s, e: bytes from s to before e) touches. Null where the redaction is refused:
    an empty file, no range, an inverted range or one beyond the end, or nothing left to reveal."""
    size = F.greatest(F.ceil(length / CHUNKS), F.lit(1)).cast("long")
    start = lambda i: F.least(i * size, length)
    touched = lambda i: (start(i) < start(i + 1)) & F.exists(ranges, lambda r: (r["s"] < start(i + 1)) & (start(i) < r["e"]))
    mask = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(CHUNKS - 1).cast("long")), lambda i: F.when(touched(i), 0).otherwise(1))
    good = (length > 0) & (F.size(ranges) > 0) & F.forall(ranges, lambda r: (r["s"] >= 0) & (r["s"] < r["e"]) & (r["e"] <= length))
    held = F.slice(mask, 1, F.ceil(length / size).cast("int"))
    return F.when(good & F.exists(held, lambda m: m == 1), mask)


def redact_ranges(content: Column, ranges: Column, fill: int = 0) -> Column:
    """The bytes with each range overwritten; the length stays."""
    byte = f"{fill:02x}"
    step = lambda a, r: F.concat(F.substring(a, 1, (2 * r["s"]).cast("int")), F.repeat(F.lit(byte), (r["e"] - r["s"]).cast("int")), F.substring(a, (2 * r["e"] + 1).cast("int"), F.length(a)))
    return F.unhex(F.aggregate(ranges, F.hex(content.cast("binary")), step))


def _leaves(rows: list[list[bytes] | None]) -> list[list[int] | None]:
    """The leaves of all rows' chunk hashes, hashed together; a null hash is no leaf but 0."""
    flat = iter(field.leaves([bytes(x) for row in rows if row is not None for x in row if x is not None]))
    return [None if row is None else [0 if x is None else next(flat) for x in row] for row in rows]


def _numbers(rows: list[list[int]]) -> np.ndarray:
    """Field elements of rows of sixteen, ``[limbs, rows, sixteen]``."""
    return lanes.elements([x for row in rows for x in row]).reshape(lanes.LIMBS, -1, CHUNKS)


#: Rows that are hashed together, about: their last level still fills the lanes.
ROWS = 1024


def _together(rows: list[int]) -> list[list[int]]:
    """Rows in parts of about one size."""
    return [x.tolist() for x in np.array_split(np.array(rows, int), round(len(rows) / ROWS) or 1)] if rows else []


@F.pandas_udf(StringType())
def chunk_root(hashes: pd.Series) -> pd.Series:
    """Root over sixteen chunk hashes (array of binary) as field elements, in decimal; null without sixteen of them."""
    whole = [None if row is None or len(row) != CHUNKS or any(x is None for x in row) else list(row) for row in hashes]
    good, out = [i for i, row in enumerate(whole) if row is not None], pd.Series([None] * len(whole), dtype=object)
    for own in _together(good):
        level = _numbers(_leaves([whole[i] for i in own])).reshape(lanes.LIMBS, -1)
        while level.shape[1] > len(own):
            level = lanes.tagged(field.LEAF, level[:, ::2], level[:, 1::2])
        out.iloc[own] = list(map(str, lanes.numbers(level)))
    return out


@lru_cache(maxsize=1 << CHUNKS + 1)
def mask_commitment(mask: tuple[int, ...]) -> int:
    """Commitment to a mask. Masks of sixteen bits have fewer than 131,072 beginnings, and each is made once."""
    return field.tagged(field.MASK, mask_commitment(mask[:-1]), mask[-1]) if mask else 0


def commitments(leaves: list[int], mask: list[int], revealed: int) -> tuple[int, int]:
    """Commitments to the revealed leaves (others as 0), seeded with their number, and to the mask."""
    a = revealed
    for leaf, bit in zip(leaves, mask, strict=True):
        a = field.tagged(field.COMMITMENT, a, bit * leaf % field.P)
    return a, mask_commitment(tuple(mask))


@F.pandas_udf(StructType([StructField("leaves", StringType()), StructField("mask", StringType())]))
def commitment_columns(hashes: pd.Series, masks: pd.Series) -> pd.DataFrame:
    """``commitments`` of sixteen chunk hashes (array of binary) and a reveal mask (array of 0 and 1), in decimal; null if either is, or has not sixteen entries."""
    good = [row is not None and mask is not None and len(row) == len(mask) == CHUNKS and all(x is not None for x in (*row, *mask)) and {int(x) for x in mask} <= {0, 1} for row, mask in zip(hashes, masks, strict=True)]
    bits = [[int(x) for x in mask] if g else None for g, mask in zip(good, masks, strict=True)]
    rest, out = [i for i, own in enumerate(bits) if own is not None], pd.DataFrame(None, range(len(bits)), ["leaves", "mask"], dtype=object)
    for own in _together(rest):
        leaves = _numbers(_leaves([[x if b else None for x, b in zip(hashes.iloc[i], bits[i], strict=True)] for i in own]))
        state = lanes.elements([sum(bits[i]) for i in own])
        for i in range(CHUNKS):
            state = lanes.tagged(field.COMMITMENT, state, leaves[:, :, i])
        out.iloc[own, 0] = list(map(str, lanes.numbers(state)))
        out.iloc[own, 1] = [str(mask_commitment(tuple(bits[i]))) for i in own]
    return out.where(out.notna(), None)
