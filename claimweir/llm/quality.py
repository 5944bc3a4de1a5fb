"""Bradley-Terry pairwise ranking: document scores from preference pairs, cut at a quantile of the scores."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweir.llm.shared import Scratch

#: Classes of bytes whose shares are features: lower case, upper case, digits, white space, sentence marks, other ASCII, non-ASCII.
_classes = np.full(256, 6)
_classes[:128] = 5
_classes[[9, 10, 11, 12, 13, 32]] = 3
_classes[[ord(c) for c in ".,;:?!'\"-()"]] = 4
_classes[ord("0") : ord("9") + 1] = 2
_classes[ord("A") : ord("Z") + 1] = 1
_classes[ord("a") : ord("z") + 1] = 0
_CLASS = _classes.tolist()
FEATURES = 23
#: The score of a text at the quantile that parts kept from rejected documents.
AT_QUANTILE = 0.7


def text_features(text: str | None) -> np.ndarray:
    """Shape of a whole text: shares of characters, repetition of words and lines, lengths. Null counts as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    x = np.zeros(FEATURES)
    words = data.split()
    n = len(words)
    if not n:
        return x
    size = len(data)
    shares = np.bincount(_classes[np.frombuffer(data, np.uint8)], minlength=7) / size
    x[:7] = shares
    letters = shares[0] + shares[1] + shares[6]
    x[7] = shares[1] / letters if letters else 0.0
    counts = Counter(words)
    x[8] = math.log(len(counts) / n)
    x[9] = math.log(len(counts)) / math.log(n + 1)
    x[10] = max(counts.values()) / n
    x[11] = sum(map(bytes.__eq__, words, words[1:])) / n
    x[12] = (size - n) / n / 10
    lines = [line for line in data.splitlines() if line.strip()]
    x[13] = 1 - len(set(lines)) / len(lines)
    x[14] = math.log1p(n / len(lines))
    x[15] = math.log1p(n)
    for w, c in counts.items():
        end = _CLASS[w[-1]]
        if end == 5:
            x[16] += c
        elif end == 4:
            x[17] += c
        if end in (4, 5):
            if len(w) == 1:
                x[18] += c
            elif w[-1] == w[-2]:
                x[19] += c
        if w.isupper():
            x[20] += c
        if len(w) > 25:
            x[21] += c
    x[16:22] /= n
    x[22] = data.count(b".") / n
    return x


@dataclass(frozen=True)
class Ranking:
    """Weights on standardised features; `cut` is the score at the quantile, `slope` the steepness there."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def worth(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, rising with the worth, and AT_QUANTILE at the cut."""
        at = self.slope * (self.worth(x) - self.cut) + math.log(AT_QUANTILE / (1 - AT_QUANTILE))
        return 1 / (1 + np.exp(-np.clip(at, -500, 500)))


#: Cells of the grid of worths: fine ones for the gradient, wide ones for the curvature.
FINE, WIDE = 1024, 256

#: Applies a function of (features, labels) to all blocks of rows and combines what it returns.
Blocks = Callable[..., np.ndarray]


def _sigmoid(at: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(at, -500, 500)))


def _moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.concatenate([[(y == 1).sum(), (y == 0).sum()], x.sum(0), (x * x).sum(0)])


def _spread(at: np.ndarray, values: np.ndarray, cells: int) -> np.ndarray:
    """Sums of the rows of `values` by cell."""
    return np.stack([np.bincount(at, v, cells) for v in values.T], 1)


def _by_worth(z: np.ndarray, y: np.ndarray, w: np.ndarray, reach: float) -> np.ndarray:
    """Of both kinds of rows, counts and sums of features by worth, a row shared by the two points of the fine grid it lies between;
    and counts, sums and products of features in wide cells."""
    upper = np.triu_indices(z.shape[1])
    out = []
    for kind in (1, 0):
        own = z[y == kind]
        at = (own @ w + reach) / (2 * reach)
        one = np.c_[np.ones(len(own)), own]
        place = np.clip(at * (FINE - 1), 0, FINE - 1)
        low = np.minimum(place.astype(np.int64), FINE - 2)
        part = (place - low)[:, None]
        fine = _spread(low, one * (1 - part), FINE) + _spread(low + 1, one * part, FINE)
        cell = np.clip((at * WIDE).astype(np.int64), 0, WIDE - 1)
        order = np.argsort(cell, kind="stable")
        cells, first = np.unique(cell[order], return_index=True)
        products = np.zeros((WIDE, len(upper[0])))
        for c, rows in zip(cells, np.split(own[order], first[1:]) if len(own) else [], strict=True):
            products[c] = (rows.T @ rows)[upper]
        out += [fine.ravel(), _spread(cell, one, WIDE).ravel(), products.ravel()]
    return np.concatenate(out)


def _newton(sums: np.ndarray, w: np.ndarray, reach: float, ridge: float) -> np.ndarray:
    """The Newton step of the loss over all pairs of a better and a worse row, from the sums of `_by_worth`."""
    width = len(w)
    upper = np.triu_indices(width)
    sizes = [FINE * (width + 1), WIDE * (width + 1), WIDE * len(upper[0])] * 2
    good, good_wide, good_products, bad, bad_wide, bad_products = (
        part.reshape(-1, n) for part, n in zip(np.split(sums, np.cumsum(sizes)[:-1]), [width + 1, width + 1, len(upper[0])] * 2, strict=True)
    )
    pairs = good[:, 0].sum() * bad[:, 0].sum()
    grid = np.linspace(-reach, reach, FINE)
    p = _sigmoid(grid[None, :] - grid[:, None])  # of a better row at the first place, a worse one at the second
    gradient = ridge * w - ((p @ bad[:, 0]) @ good[:, 1:] - (good[:, 0] @ p) @ bad[:, 1:]) / pairs
    middle = (np.arange(WIDE) + 0.5) * (2 * reach / WIDE) - reach
    p = _sigmoid(middle[None, :] - middle[:, None])
    q = p * (1 - p)
    square = np.zeros((width, width))
    square[upper] = (q @ bad_wide[:, 0]) @ good_products + (good_wide[:, 0] @ q) @ bad_products
    square = square + np.triu(square, 1).T
    cross = good_wide[:, 1:].T @ q @ bad_wide[:, 1:]
    return np.linalg.solve((square - cross - cross.T) / pairs + ridge * np.eye(width), gradient)


def _edge_above(counted: Callable[[float, float], np.ndarray], reach: float, rank: int, cells: int = 1 << 14) -> float:
    """A value that `rank` worths lie below; of equal worths around that rank, their least. `counted(low, high)` gives how many lie below
    `low`, and how many in each of `cells` equal cells from there to `high`."""
    low, high = -reach, reach
    while True:
        below, *inside = counted(low, high).astype(np.int64)
        edges = np.linspace(low, high, cells + 1)
        until = below + np.concatenate([[0], np.cumsum(inside)])
        at = int(np.searchsorted(until, rank, side="right")) - 1
        if until[at] == rank or at >= cells or (edges[at + 1] - edges[at]) < 1e-12 * reach:
            return float(edges[at])
        low, high = float(edges[at]), float(edges[at + 1])


def _fit(over: Blocks, width: int, ridge: float, steps: int) -> Ranking:
    """The ranking of all rows that `over` goes through. Every pass adds up sums of a fixed size, whatever the number of rows."""
    sums = over(_moments)
    n_good, n_bad = (int(n) for n in sums[:2]) if len(sums) else (0, 0)
    n = n_good + n_bad
    if not n_good or not n_bad:
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0)
    mean = sums[2 : 2 + width] / n
    scale = np.sqrt(np.maximum(sums[2 + width :] / n - mean * mean, 0)) + 1e-6
    w = np.zeros(width)
    for _ in range(steps):
        reach = 6 * float(np.abs(w).sum()) + 1e-3
        step = _newton(over(lambda x, y, w=w, reach=reach: _by_worth(np.clip((x - mean) / scale, -6, 6), y, w, reach)), w, reach, ridge)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    model = Ranking(mean, scale, w, 0.0, 1.0)
    reach = 6 * float(np.abs(w).sum()) * 1.001 + 1e-3
    cells = 1 << 14

    def counted(low: float, high: float) -> np.ndarray:
        edges = np.linspace(low, high, cells + 1)

        def part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            at = np.searchsorted(edges, model.worth(x), side="right")  # 0 below the first edge
            return np.bincount(at, minlength=cells + 2)[: cells + 1].astype(float)

        return over(part)

    edge = _edge_above(counted, reach, min(max(n_bad, 1), n - 1), cells)

    def nearest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        worth = model.worth(x)
        return np.array([np.max(worth, initial=-np.inf, where=worth < edge), np.max(-worth, initial=-np.inf, where=worth >= edge)])

    ends = over(nearest, np.maximum)
    below, above = (float(v) if np.isfinite(v) else None for v in (ends[0], -ends[1]))
    cut = (below + above) / 2 if below is not None and above is not None else above if below is None else below
    total = over(lambda x, y: np.array([model.worth(x).sum(), (model.worth(x) ** 2).sum()]))
    spread = math.sqrt(max(total[1] / n - (total[0] / n) ** 2, 0.0))
    return Ranking(mean, scale, w, cut, 4.0 / max(spread, 1e-6))


def fit_ranking(better: np.ndarray, worse: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> Ranking:
    """Weights that make the worth of `better` rows exceed that of `worse` rows: mean logistic loss over all pairs of the two.

    What a row adds to the gradient depends on the worths of the other kind alone, so worths are counted on a grid instead of going
    through the pairs. The cut is the quantile of all worths at the share of worse rows. Without rows of both kinds no preference is
    known: every document gets worth 0 and is kept.
    """
    x, y = np.vstack([better, worse]), np.repeat([1, 0], [len(better), len(worse)])
    return _fit(lambda part, combine=np.add: part(x, y), x.shape[1], ridge, steps)


def labelled_texts(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """Texts and labels of at most `bound` labelled documents, chosen by a hash of the id.

    The chosen ids, of a bounded number, are broadcast, so the documents are read without a shuffle. `labels` has doc_id and
    label columns; rows without an id or with a null label should be filtered out by the caller.
    """
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def train_ranking(docs: DataFrame, labels: DataFrame, ridge: float = 1e-3, steps: int = 30) -> Ranking:
    """Fit on all rows of labels (doc_id, quality 0/1) joined with docs (doc_id, text), as `fit_ranking` does.

    Texts become FEATURES numbers where they lie; these meet the labels and are written once. Each step is a pass over them, of which the
    driver gets sums of a fixed size a task. Labels other than 0 and 1 are not used.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))

    @F.pandas_udf("array<double>")
    def shape(texts: pd.Series) -> pd.Series:
        return pd.Series([text_features(t) for t in texts])

    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.write(docs.select("doc_id", shape("text").alias("x")).join(known, "doc_id").select("x", "quality"))

    def over(part: Callable[[np.ndarray, np.ndarray], np.ndarray], combine: np.ufunc = np.add) -> np.ndarray:
        def run(batches):
            total = None
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
                own = part(x, batch.column(1).to_numpy(zero_copy_only=False)) if len(x) else None
                total = own if total is None else total if own is None else combine(total, own)
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        found = [np.frombuffer(r["sums"]) for r in rows.mapInArrow(run, "sums binary").collect()]
        return combine.reduce(found) if found else np.zeros(0)

    try:
        return _fit(over, FEATURES, ridge, steps)
    finally:
        scratch.clear()


def quality_score(model: Ranking, text: str | Column) -> Column:
    """Score of a text from 0 to 1; null and empty texts have the features of an empty text."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.probability(np.array([text_features(t) for t in texts]).reshape(-1, FEATURES)))

    return score(text)
