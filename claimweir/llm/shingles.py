"""Sets of word shingles as 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at a time; it bounds the memory of a task. A longer word is hashed piece by piece.
WINDOW = 1 << 19
_FACTOR = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    if size not in _powers:
        inverse = pow(_FACTOR, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers[size] = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, f, np.uint64))]) for f in (_FACTOR, inverse))
    return _powers[size]


def _window_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = _SPACE[data]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _power_table(WINDOW)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])])
    return starts, mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def _long_word(data: np.ndarray, start: int) -> tuple[int, int]:
    """Hash of a word that fills the window from `start` on, as _window_words would give it, and its end."""
    power, _ = _power_table(WINDOW)
    end, total = start, 0
    while end < len(data):
        piece = data[end : end + WINDOW]
        space = np.flatnonzero(_SPACE[piece])
        piece = piece[: space[0]] if len(space) else piece
        part = ((piece.astype(np.uint64) + np.uint64(1)) * power[: len(piece)]).sum()
        total += int(part) * pow(_FACTOR, end - start, 1 << 64)
        end += len(piece)
        if len(space):
            break
    return int(mixed(np.array([(total + end - start) % (1 << 64)], np.uint64))[0]), end


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` of all texts, A-Z in lower case, and where each text's words begin and end.

    Words of text i are hashes[bounds[i]:bounds[i + 1]]. Null texts have no words.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b" ".join(parts), np.uint8)
    text_at = np.cumsum([0] + [len(p) + 1 for p in parts])
    all_starts, hashes, at = [], [], 0
    while at < len(data):
        window = data[at : at + WINDOW]
        if at + WINDOW < len(data):
            last = np.flatnonzero(_SPACE[window])
            if not len(last):
                word, end = _long_word(data, at)
                all_starts.append(np.array([at]))
                hashes.append(np.array([word], np.uint64))
                at = end
                continue
            window = window[: last[-1] + 1]
        starts, words = _window_words(window)
        all_starts.append(starts + at)
        hashes.append(words)
        at += len(window)
    starts = np.concatenate(all_starts) if all_starts else np.empty(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), np.searchsorted(starts, text_at)


def joined(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k neighbouring words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n]
    for j in range(1, k):
        out = mixed(out * np.uint64(_FACTOR) + words[j : j + n])
    return out


def slices(texts: Sequence[str | None], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about `size` characters together."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= size:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def cut_batches(batches: Iterator[pa.RecordBatch], sizes: Callable[[pa.RecordBatch], pa.Array], most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the sizes of their rows (null: 0) are `most` together at most, or they have one row."""
    for batch in batches:
        total = np.cumsum(pc.fill_null(sizes(batch), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            done = total[first - 1] if first else 0
            end = max(first + 1, int(np.searchsorted(total, done + most, side="right")))
            yield batch.slice(first, end - first)
            first = end


def small_batches(batches: Iterator[pa.RecordBatch], column: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of a column have about `size` bytes together."""
    return cut_batches(batches, lambda batch: pc.binary_length(batch.column(column)), size)


def shingle_sets(texts: Sequence[str | None], k: int, short: bool) -> list[np.ndarray]:
    """The sorted distinct shingles of k words of each text. Of fewer words (`short`) all together are one, else there is none."""
    out = []
    for low, high in slices(texts):
        words, bounds = word_hashes(texts[low:high])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= k:
                out.append(np.unique(joined(words[a:b], k)))
            elif short and b > a:
                out.append(joined(words[a:b], int(b - a)))
            else:
                out.append(np.empty(0, np.uint64))
    return out
