"""Bitmaps of hashed things, small enough to broadcast whatever they hold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: Bits of the largest bitmap (16 MB).
BITMAP = 1 << 27


class Bitmap:
    """A set of hashed things that may hold too much, never too little; at most ``BITMAP`` bits."""

    def __init__(self, rows: DataFrame, key: str, most: int = BITMAP):
        count = max(1, rows.count())
        self.mask = min(most, max(1 << 16, 1 << (16 * count - 1).bit_length())) - 1
        bit = F.expr(f"({key}) & {self.mask}L")
        found = (rows.select(bit.alias("bit")).groupBy(F.expr("shiftright(bit, 6)").alias("at"))
                 .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("bits")).toArrow())
        self.bits = np.zeros((self.mask + 1) // 64, np.uint64)
        self.bits[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        bit = keys & np.uint64(self.mask)
        return (self.bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
