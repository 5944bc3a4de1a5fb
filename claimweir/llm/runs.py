"""Periodic runs of words: a run-length grammar by recompression answers how far two places of a text agree."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweir.llm.shingles import mixed, small_batches

#: Bytes of text whose grammar is built at a time (a longer text has one of its own).
BATCH_BYTES = 2 << 20
#: Candidates that are extended at a time.
CANDIDATES = 1 << 20
#: Texts are compressed until none has more symbols than this; the rest is compared one by one.
SHORT = 8

RUN = "struct<start: long, length: long, period: long>"


class Grammar:
    """A run-length grammar of symbols, found by compressing blocks and pairs in turn.

    A block step makes one symbol of each maximal block of equal symbols. A pair step divides the symbols into left and right ones
    by a hash and makes one symbol of each left one with the right one behind it. Either way equal stretches are cut alike but
    for their ends, and each step names what it joins by sorting, so equal names mean equal stretches without exception.
    Negative symbols stand between texts; each must differ from all others, and none is ever joined.

    symbols[t] are those of level t; up[t][x] is the symbol of level t + 1 that holds symbol x of level t, whose symbols
    first[t][X], ..., first[t][X + 1] - 1 form symbol X. blocks[t] tells whether level t + 1 was made by a block step.
    """

    def __init__(self, symbols: np.ndarray):
        self.symbols = [symbols.astype(np.int32)]
        self.up: list[np.ndarray] = []
        self.first: list[np.ndarray] = []
        self.blocks: list[bool] = []
        names, steps = int(symbols.max(initial=0)) + 1, 0
        while np.diff(np.flatnonzero(self.symbols[-1] < 0)).max(initial=0) > SHORT + 1:
            names = self._join_blocks(names)
            names = self._join_pairs(names, steps)
            steps += 1

    def _add(self, head: np.ndarray, block: bool) -> np.ndarray:
        first = np.flatnonzero(head).astype(np.int32)
        self.up.append((np.cumsum(head, dtype=np.int32) - 1).astype(np.int32))
        self.first.append(np.append(first, np.int32(len(head))))
        self.blocks.append(block)
        return first

    def _named(self, joined: np.ndarray, keys: np.ndarray, kept: np.ndarray, names: int) -> int:
        distinct, which = np.unique(keys, return_inverse=True)
        kept[joined] = names + which
        self.symbols.append(kept)
        return names + len(distinct)

    def _join_blocks(self, names: int) -> int:
        s = self.symbols[-1]
        same = s[1:] == s[:-1]
        if not same.any():
            return names
        first = self._add(np.concatenate([[True], ~same]), True)
        lengths = np.diff(self.first[-1])
        joined = np.flatnonzero(lengths > 1)
        keys = s[first[joined]].astype(np.int64) * (int(lengths.max()) + 1) + lengths[joined]
        return self._named(joined, keys, s[first], names)

    def _join_pairs(self, names: int, step: int) -> int:
        s = self.symbols[-1]
        right = (mixed(s.astype(np.uint64) + (np.uint64(step + 1) << np.uint64(32))) & np.uint64(1)).astype(bool)
        second = np.concatenate([[False], ~right[:-1] & right[1:] & (s[:-1] >= 0) & (s[1:] >= 0)])
        if not second.any():
            return names
        first = self._add(~second, False)
        joined = np.flatnonzero(np.diff(self.first[-1]) > 1)
        at = first[joined]
        return self._named(joined, s[at].astype(np.int64) * names + s[at + 1], s[first], names)

    def extension(self, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
        """How many symbols agree from the places x and y on, to the right (step 1) or to the left (-1); x and y differ.

        All queries climb together. On each level a query first passes symbols one by one until both places begin a symbol of
        the next level: at most what is left of one block or pair, as equal symbols on both sides are then cut alike. It
        climbs while the symbols of the next level agree, and where they do not it goes down again by their parts.
        """
        out = np.zeros(len(x), np.int64)
        s = self.symbols[0]
        query = np.flatnonzero(s[x] == s[y])
        begun = x
        x, y = x[query], y[query]
        stopped: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in self.symbols]
        for t, (up, first) in enumerate(zip(self.up, self.first, strict=True)):
            if not len(query):
                break
            s, above = self.symbols[t], self.symbols[t + 1]
            over, under = up[x], up[y]
            if step > 0:
                left_x, left_y = first[over + 1] - x, first[under + 1] - y
            else:
                left_x, left_y = x - first[over] + 1, y - first[under] + 1
            whole = (left_x == first[over + 1] - first[over]) & (left_y == first[under + 1] - first[under])
            equal = s[x] == s[y]
            passed = np.where(equal & ~whole, np.minimum(left_x, left_y), 0) * step
            x, y = x + passed, y + passed
            ends = ~whole & (~equal | (left_x != left_y))
            if ends.any():
                stopped[t].append((query[ends], x[ends], y[ends]))
                on = ~ends
                query, x, y = query[on], x[on], y[on]
            x, y = up[x], up[y]
            differ = above[x] != above[y]
            if differ.any():
                stopped[t + 1].append((query[differ], x[differ], y[differ]))
                on = ~differ
                query, x, y = query[on], x[on], y[on]
        top = self.symbols[-1]
        while len(query):  # at most SHORT times
            differ = top[x] != top[y]
            stopped[-1].append((query[differ], x[differ], y[differ]))
            on = ~differ
            query, x, y = query[on], x[on] + step, y[on] + step

        query, x, y = (np.empty(0, np.int64) for _ in range(3))
        for t in reversed(range(len(self.symbols))):
            if stopped[t]:
                query, x, y = (np.concatenate([old, *new]) for old, new in zip((query, x, y), zip(*stopped[t], strict=True), strict=True))
            if not t or not len(query):
                continue
            s, first = self.symbols[t - 1], self.first[t - 1]
            parts = np.minimum(first[x + 1] - first[x], first[y + 1] - first[y]) if self.blocks[t - 1] else 1
            x, y = (first[x], first[y]) if step > 0 else (first[x + 1] - 1, first[y + 1] - 1)
            passed = np.where(s[x] == s[y], parts, 0) * step
            x, y = x + passed, y + passed
        out[query] = (x - begun[query]) * step
        return out


def grid(n: int, min_length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods such that each run of n words holds one of its own with the word a period on; about n ln n in all.

    A run of period q holds a multiple of max(q, min_length - q) whose successor by q it holds too, since it has no fewer places that
    have a successor.
    """
    periods = np.arange(1, n // 2 + 1)
    steps = np.maximum(periods, min_length - periods)
    counts = (n - 1 - periods) // steps + 1
    ends = np.cumsum(counts)
    low = 0
    while low < len(periods):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + CANDIDATES, side="right")))
        here = counts[low:high]
        number = np.arange(here.sum()) - np.repeat(np.cumsum(here) - here, here)
        yield number * np.repeat(steps[low:high], here), np.repeat(periods[low:high], here)
        low = high


def find_runs(texts: list[np.ndarray], min_length: int = 12) -> tuple[np.ndarray, ...]:
    """Runs of texts given as arrays of word numbers: (text, start, length, period), by text, start and period.

    A run is a stretch whose smallest period is q, of at least max(min_length, 2 q) words, that no neighbouring word extends.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    at = np.cumsum(sizes + 1) - sizes  # one separator before each text, one at the end
    symbols = np.empty(int(sizes.sum()) + len(texts) + 1, np.int64)
    symbols[np.append(at - 1, len(symbols) - 1)] = -1 - np.arange(len(texts) + 1)
    for begin, own in zip(at, texts, strict=True):
        symbols[begin : begin + len(own)] = own
    grammar = Grammar(symbols)
    found = []
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def settle() -> None:
        x, q = (np.concatenate(c) for c in zip(*waiting, strict=True))
        waiting.clear()
        start = x - grammar.extension(x - 1, x - 1 + q, -1)
        end = x + q + grammar.extension(x, x + q, 1)
        runs = end - start >= np.maximum(min_length, 2 * q)
        # the same stretch at several multiples of its period, or met at several places: the smallest period stays
        start, end, q = start[runs], end[runs], q[runs]
        order = np.lexsort((q, end, start))
        start, end, q = start[order], end[order], q[order]
        new = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])[: len(q)]
        found.append((start[new], end[new], q[new]))

    held = 0
    for begin, size in zip(at, sizes, strict=True):
        if size < min_length:
            continue
        for x, q in grid(int(size), min_length):
            x = x + begin
            equal = np.flatnonzero(symbols[x] == symbols[x + q])
            waiting.append((x[equal], q[equal]))
            held += len(equal)
            if held > CANDIDATES:
                settle()
                held = 0
    if waiting:
        settle()
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    start, end, q = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    new = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])[: len(q)]
    start, end, q = start[new], end[new], q[new]
    order = np.lexsort((q, start))
    start, end, q = start[order], end[order], q[order]
    text = np.searchsorted(at, start, side="right") - 1
    return text, start - at[text], end - start, q


def periodic_runs(docs: DataFrame, min_length: int = 12, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The periodic runs of the words `[^\\x20\\x09-\\x0D]+` of each whole text, and the text without their repeats.

    Returns one row per row: id, n_words, runs (array of start, length, period, numbered from 0, by start, then period) and
    collapsed: the words joined by one space, without those that a run contains behind its first period. A run is a stretch of at least
    max(min_length, 2 * period) words that has this smallest period and that no neighbouring word extends keeping it.

    Null and empty texts have no words and no runs and collapse to the empty string. Rows that repeat are answered each, null ids
    are passed on, other columns are ignored, an empty table gives an empty result. Each text is worked on within its task,
    without a shuffle: time grows as n log n of its words, memory with the longest text.
    """

    def work(batches):
        for batch in small_batches(batches, 1, BATCH_BYTES):
            words = [(t or b"").split() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            numbers: defaultdict[bytes, int] = defaultdict()
            numbers.default_factory = numbers.__len__
            texts = [np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)) for own in words]
            with np.errstate(over="ignore"):
                text, start, length, period = find_runs(texts, min_length)
            bounds = np.searchsorted(text, np.arange(len(words) + 1))
            collapsed = []
            for i, own in enumerate(words):
                here = slice(bounds[i], bounds[i + 1])
                if here.start < here.stop:
                    change = np.bincount(start[here] + period[here], minlength=len(own) + 1) - np.bincount(start[here] + length[here], minlength=len(own) + 1)
                    own = [own[k] for k in np.flatnonzero(np.cumsum(change[: len(own)]) == 0)]
                collapsed.append(b" ".join(own))
            runs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, period)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs), pa.array(collapsed, pa.binary()).view(pa.string())],
                names=["id", "n_words", "runs", "collapsed"],
            )

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, n_words long, runs array<{RUN}>, collapsed string").withColumnRenamed("id", id_column)
