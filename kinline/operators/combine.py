"""Union of passes with provenance: an integer mask, or the passes' names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinline.operators.keyed_pass import CAND, S1


def combine(found: DataFrame) -> DataFrame:
    """(s1, candidate, pass_mask) of rows (s1, candidate, bit): each pair once, with the bits of the passes that found it.

    Shuffled by the anchor, which what follows mostly joins or groups by.
    """
    return found.repartition(S1).groupBy(S1, CAND).agg(F.bit_or("bit").cast("int").alias("pass_mask"))


def mask_names(mask: Column, bits: dict[str, int]) -> Column:
    """Names of the bits that are set, rising, joined by ``|``."""
    return F.concat_ws("|", *[F.when(mask.bitwiseAND(F.lit(b)) != 0, F.lit(n)) for n, b in sorted(bits.items(), key=lambda x: x[1])])
