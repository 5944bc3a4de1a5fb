"""Size-partitioned MinHash containment search: short test items inside long documents, verified by exact shingle containment."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweir.llm.shingles import joined, shingle_sets, slices, word_hashes

#: Shingles of the items of one index; it bounds what is broadcast (16 bytes each). More items make more indexes.
INDEX_SHINGLES = 2_000_000


@dataclass(frozen=True)
class LeakIndex:
    """Items of one block: whole sets, and the minima by which a document finds them.

    An item of n shingles is contained when least = ceil(num n / den) of them are in the document. Items are partitioned by
    size, up to 8, 16, 32, ... shingles, and every item of a partition is sketched by the same number of minima: one more
    than the largest item of the partition may miss. So any document that contains an item holds one of its minima, and
    none is lost.
    """

    ids: np.ndarray
    sizes: np.ndarray
    bounds: np.ndarray
    shingles: np.ndarray
    minima: np.ndarray
    owners: np.ndarray
    lengths: tuple[int, ...]
    num: int
    den: int

    def leaks(self, found: np.ndarray) -> list[tuple[int, int, int]]:
        """(item id, shingles found, shingles of the item) of all items that a document's sorted shingles contain."""
        if not len(found) or not len(self.minima):
            return []
        hits = _among(self.minima, found)
        out = []
        for item in np.unique(self.owners[hits]):
            own = self.shingles[self.bounds[item] : self.bounds[item + 1]]
            n = int(_among(own, found).sum())
            if self.den * n >= self.num * len(own):
                out.append((int(self.ids[item]), n, len(own)))
        return sorted(out)


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ordered, values)
    return ordered[np.minimum(at, len(ordered) - 1)] == values


def index_items(ids: list[int], texts: list[str | None], k: int, num: int, den: int) -> LeakIndex:
    """An index of items; items without words are in no document. An item of fewer than k words is one shingle, all its words."""
    with np.errstate(over="ignore"):
        sets = shingle_sets(texts, k, True)
        words, at = word_hashes(texts)
    counts = np.diff(at)
    sizes = np.array([len(s) for s in sets], np.int64)
    minima, owners = [], []
    for item, own in enumerate(sets):
        if len(own):
            upper = max(8, 1 << (len(own) - 1).bit_length())
            sketch = own[: upper - -(-num * upper // den) + 1]
            minima.append(sketch)
            owners.append(np.full(len(sketch), item))
    none = np.empty(0, np.uint64)
    return LeakIndex(
        np.array(ids, np.int64), sizes, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.concatenate([none, *sets]),
        np.concatenate([none, *minima]), np.concatenate([np.empty(0, np.int64), *owners]), tuple(sorted({int(c) for c in counts if 0 < c < k} | {k})), num, den,
    )


def leak_indexes(items: DataFrame, k: int = 5, num: int = 8, den: int = 10, id_column: str = "item_id", text_column: str = "text") -> list[LeakIndex]:
    """Indexes over all items, each of about INDEX_SHINGLES words at most; items come to the driver a block at a time."""
    rows = items.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).filter("id IS NOT NULL")
    words = rows.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")))).first()[0] or 0
    blocks = max(1, -(-words // (INDEX_SHINGLES // 2)))
    out = []
    for block in range(blocks):
        own = sorted(rows.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect(), key=lambda r: (r["id"], r["text"] or ""))
        out.append(index_items([r["id"] for r in own], [r["text"] for r in own], k, num, den))
    return out


def leaks(index: LeakIndex, text: str | Column) -> Column:
    """Array of (item_id, matched, item_shingles) that a whole text contains; empty for null and empty texts."""

    @F.pandas_udf("array<struct<item_id: long, matched: int, item_shingles: int>>")
    def found(texts: pd.Series) -> pd.Series:
        out = []
        texts = texts.tolist()
        with np.errstate(over="ignore"):
            for low, high in slices(texts):
                words, at = word_hashes(texts[low:high])
                for a, b in zip(at[:-1], at[1:], strict=True):
                    shingles = np.unique(np.concatenate([joined(words[a:b], n) for n in index.lengths]))
                    out.append([{"item_id": i, "matched": n, "item_shingles": size} for i, n, size in index.leaks(shingles)])
        return pd.Series(out)

    return found(text)


def find_leaks(docs: DataFrame, indexes: list[LeakIndex], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, item_id, matched, item_shingles, containment) for every document and every item it contains.

    Documents are read once for each index and not shuffled. Null ids and repeated rows are searched like others; copies of an
    item are found under each of their ids. Without items or documents the result is empty.
    """
    parts = [docs.select(id_column, F.explode(leaks(index, text_column)).alias("leak")).select(id_column, "leak.*") for index in indexes]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.withColumn("containment", F.col("matched") / F.col("item_shingles"))


def without_leaks(docs: DataFrame, indexes: list[LeakIndex], text_column: str = "text") -> DataFrame:
    """The documents that contain no item, with all their columns."""
    for index in indexes:
        docs = docs.filter(F.size(leaks(index, text_column)) == 0)
    return docs
