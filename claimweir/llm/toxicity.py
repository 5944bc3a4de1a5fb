"""Cumulative-link ordinal regression: severity grades from sparse text features, one weight vector, ordered thresholds."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweir.llm.quality import labelled_texts
from claimweir.llm.shared import Scratch

_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)


def features_of(text: str | None) -> dict[str, int]:
    """Words of a whole text in lower case and their beginnings of 4 to 6 letters (marked by *), with their counts."""
    counts: dict[str, int] = {}
    words: dict[str, int] = {}
    for w in _WORD.findall((text or "").lower()):
        words[w] = words.get(w, 0) + 1
    for w, c in words.items():
        counts[w] = c
        for k in PREFIXES:
            if len(w) > k:
                counts[p] = counts.get(p := w[:k] + "*", 0) + c
    return counts


@dataclass(frozen=True)
class Severity:
    """P(grade > k) = sigmoid(w x - thresholds[k]), x being log(1 + count) of each known feature.

    `cut` is the P(grade > 0) from which on a document counts as toxic.
    """

    weights: dict[str, float]
    thresholds: np.ndarray
    cut: float = 0.5

    def above(self, text: str | None) -> np.ndarray:
        """P(grade > k) for each threshold k; rises with w x and falls with k."""
        found = features_of(text)
        if len(found) > len(self.weights):
            at = sum(w * np.log1p(found[k]) for k, w in self.weights.items() if k in found)
        else:
            at = sum(self.weights[k] * np.log1p(c) for k, c in found.items() if k in self.weights)
        return 1 / (1 + np.exp(-np.clip(at - self.thresholds, -500, 500)))


def fit_severity(
    x: np.ndarray, grades: np.ndarray, weight: np.ndarray, levels: int, ridge: float = 1e-4, steps: int = 300, rate: float = 0.05
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and `levels - 1` ordered thresholds with the greatest likelihood of the weighted rows, found by Adam from zero.

    Thresholds are a first one and positive gaps (exponentials), so they stay in order. Grades that no row has keep thresholds
    that the penalty holds near the others. Without rows the weights are 0 and the thresholds high: everything is grade 0.
    """
    if not len(x):
        return np.zeros(x.shape[1]), 4.0 + np.arange(levels - 1)
    weight = weight / weight.sum()
    share = np.clip(np.array([weight[grades > k].sum() for k in range(levels - 1)]), 1e-3, 1 - 1e-3)
    start = np.log((1 - share) / share)
    p = np.concatenate([np.zeros(x.shape[1]), start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    width, rows = x.shape[1], np.arange(len(x))
    for t in range(1, steps + 1):
        gaps = np.exp(p[width + 1 :])
        theta = p[width] + np.concatenate([[0.0], np.cumsum(gaps)])
        above = 1 / (1 + np.exp(np.clip(theta[None, :] - (x @ p[:width])[:, None], -500, 500)))
        edge = np.hstack([np.ones((len(x), 1)), above, np.zeros((len(x), 1))])
        slope = np.hstack([np.zeros((len(x), 1)), above * (1 - above), np.zeros((len(x), 1))])
        chance = np.maximum(edge[rows, grades] - edge[rows, grades + 1], 1e-12)
        d_at = (slope[rows, grades] - slope[rows, grades + 1]) / chance
        d_theta = np.zeros((len(x), levels + 1))
        d_theta[rows, grades] -= slope[rows, grades] / chance
        d_theta[rows, grades + 1] += slope[rows, grades + 1] / chance
        by = weight @ d_theta[:, 1:levels]
        gradient = -np.concatenate([x.T @ (d_at * weight), [by.sum()], [by[k + 1 :].sum() * gaps[k] for k in range(levels - 2)]])
        gradient[:width] += ridge * p[:width]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return p[:width], p[width] + np.concatenate([[0.0], np.cumsum(np.exp(p[width + 1 :]))])


def train_severity(docs: DataFrame, labels: DataFrame, grades: int = 3, bound: int = 20_000, features: int = 2_048) -> Severity:
    """Fit on at most `bound` rows of labels (doc_id, toxic 0/1) joined with docs (doc_id, text).

    Labels only tell toxic from clean, so grades above 0 are derived: a toxic document's grade is 1 plus the number of the
    quantile its count of telling words falls into, among toxic documents (ties share the lower grade). Telling features are
    those that toxic documents hold so much more often than chance allows that not one of all features is expected to do so by
    luck (the likelihood ratio exceeds the number of features); at most `features` of them are kept, the strongest first, ties
    by name. Feature counts are summed on the executors; the driver gets the kept features, and of each chosen document the
    counts of kept features only.
    Other label values than 0 and 1 are not used. Without toxic rows everything is clean.
    """
    known = labels.select("doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    texts = labelled_texts(docs, known, bound).select("text", F.col("toxic").cast("int").alias("toxic"))

    def occurrences(batches):
        sums: dict[str, list[int]] = {}
        for part in batches:
            for text, toxic in zip(part["text"], part["toxic"], strict=True):
                for k in features_of(text):
                    sums.setdefault(k, [0, 0])[toxic] += 1
        yield pd.DataFrame({"feature": pd.Series(list(sums), dtype=object), "clean": [c for c, _ in sums.values()], "toxic": [t for _, t in sums.values()]}).astype({"clean": "int64", "toxic": "int64"})

    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    counted = texts.mapInPandas(occurrences, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = Scratch(docs.sparkSession, "toxicity").write(counted)
    chance = min(max(n_toxic / max(n_toxic + n_clean, 1), 1e-6), 1 - 1e-6)
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    evidence = F.col("toxic") * F.log(share / chance) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - chance))).otherwise(0.0)
    strong = counted.filter((F.col("toxic") > 0) & (share > chance)).withColumn("evidence", evidence).filter(F.col("evidence") > math.log(max(counted.count(), 1)))
    telling = [r["feature"] for r in strong.orderBy(F.col("evidence").desc(), "feature").limit(features).collect()]
    place = {k: i for i, k in enumerate(telling)}

    def sparse(batches):
        for part in batches:
            found = [{place[k]: c for k, c in features_of(t).items() if k in place} for t in part["text"]]
            yield pd.DataFrame({"toxic": part["toxic"], "at": [list(f) for f in found], "count": [list(f.values()) for f in found]})

    rows = texts.mapInPandas(sparse, "toxic int, at array<int>, count array<int>").collect()
    rows.sort(key=lambda r: (r["toxic"], sorted(zip(r["at"], r["count"], strict=True))))
    plain = {t: sum(not r["at"] and r["toxic"] == t for r in rows) for t in (0, 1)}  # rows without features are alike
    rows = [r for r in rows if r["at"]]
    weight = np.array([1.0] * len(rows) + [n for n in plain.values() if n])
    rows += [{"toxic": t, "at": [], "count": []} for t, n in plain.items() if n]
    x = np.zeros((len(rows), len(telling)))
    for i, r in enumerate(rows):
        x[i, r["at"]] = np.log1p(r["count"])
    toxic = np.array([r["toxic"] for r in rows], int)
    told = np.array([sum(c for a, c in zip(r["at"], r["count"], strict=True) if not telling[a].endswith("*")) for r in rows])
    grade = np.zeros(len(rows), int)
    if toxic.any() and grades > 2:
        edges = np.quantile(told[toxic == 1], np.arange(1, grades - 1) / (grades - 1))
        grade = np.where(toxic == 1, 1 + np.searchsorted(edges, told, side="left"), 0)
    elif toxic.any():
        grade = toxic
    weights, thresholds = fit_severity(x, grade, weight, grades)
    at = np.clip(x @ weights - thresholds[0], -500, 500)
    return Severity(dict(zip(telling, weights.tolist(), strict=True)), thresholds, _best_cut(1 / (1 + np.exp(-at)), toxic, weight))


def _best_cut(chance: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The chance at which the missed share of toxic rows plus the caught share of clean rows is least: the middle of a gap."""
    if not toxic.any() or toxic.all():
        return 0.5
    order = np.argsort(chance, kind="stable")
    chance, toxic, weight = chance[order], toxic[order], weight[order]
    missed = np.cumsum(weight * toxic) / (weight * toxic).sum()
    caught = 1 - np.cumsum(weight * (1 - toxic)) / (weight * (1 - toxic)).sum()
    between = np.append(chance[1:] > chance[:-1], False)
    if not between.any():
        return 0.5
    at = int(np.argmin(np.where(between, missed + caught, np.inf)))
    return float((chance[at] + chance[at + 1]) / 2)


def severity(model: Severity, text: str | Column) -> Column:
    """struct(expected, grade, chance, toxic): the expected grade (sum of P(grade > k)), the likeliest grade, P(grade > 0), and
    whether that reaches the cut.

    Null and empty texts have no features and so get what the thresholds alone say.
    """

    @F.pandas_udf("expected double, grade int, chance double, toxic boolean")
    def of(texts: pd.Series) -> pd.DataFrame:
        above = np.array([model.above(t) for t in texts]).reshape(-1, len(model.thresholds))
        edge = np.hstack([np.ones((len(above), 1)), above, np.zeros((len(above), 1))])
        return pd.DataFrame({"expected": above.sum(1), "grade": (edge[:, :-1] - edge[:, 1:]).argmax(1).astype("int32"), "chance": above[:, 0], "toxic": above[:, 0] >= model.cut})

    return of(text)
