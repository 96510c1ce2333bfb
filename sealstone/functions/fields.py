"""Field elements as text: checks that never convert to a number that could not hold them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the order of the BN254 scalar field.
BN254 = "21888242871839275222246405745257275088548364400416034343698204186575808495617"


def canonical_below(text: Column, bound: str = BN254) -> Column:
    """Whether a text is a decimal without leading zeros, below ``bound``."""
    return text.rlike("^(0|[1-9][0-9]*)$") & ((F.length(text) < len(bound)) | ((F.length(text) == len(bound)) & (text < F.lit(bound))))


def canonical_hex(text: Column) -> Column:
    """Whether a text is 64 lower-case hex digits below the field's order."""
    return text.rlike("^[0-9a-f]{64}$") & (text < F.lit(f"{int(BN254):064x}"))
