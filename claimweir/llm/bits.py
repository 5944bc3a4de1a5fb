"""Sets of places as bit arrays of a fixed size, built on the executors and broadcast: what is not in them is certainly absent."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits built by one group; 8 KB.
BLOCK = 1 << 16


def bit_array(places: DataFrame, size: int) -> np.ndarray:
    """A packed array of `size` bits (a multiple of BLOCK), set at the places (column place, 0 <= place < size).

    Equal places are merged before and after the shuffle; the driver gets size / 8 bytes at most, whatever the input.
    """

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(BLOCK, bool)
        bits[part["at"].to_numpy()] = True
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    blocks = places.select((F.col("place") / BLOCK).cast("int").alias("block"), (F.col("place") % BLOCK).cast("int").alias("at")).distinct()
    out = np.zeros(size // 8, np.uint8)
    for row in blocks.groupBy("block").applyInPandas(pack, "block int, bits binary").collect():
        out[row["block"] * (BLOCK // 8) : (row["block"] + 1) * (BLOCK // 8)] = np.frombuffer(row["bits"], np.uint8)
    return out


def has_bit(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
