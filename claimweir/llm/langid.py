"""Hyperdimensional language profiles: permuted random letter vectors bound into n-grams, bundled, compared by cosine."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(k).isalpha() for k in range(0x110000)])


def letter_vectors(codes: np.ndarray, dimension: int, seed: int = 11) -> np.ndarray:
    """A +-1 vector for each code point, the same wherever it is computed: signs of a hash of (code, component, seed)."""
    with np.errstate(over="ignore"):
        x = (codes.astype(np.uint64)[:, None] << np.uint64(20)) + np.arange(dimension, dtype=np.uint64)[None, :] + np.uint64(seed << 42)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return ((x >> np.uint64(40)) & np.uint64(1)).astype(np.float32) * 2 - 1


def gram_vectors(grams: np.ndarray, n: int, dimension: int) -> np.ndarray:
    """Bind the letters of n-grams (21 bits a letter): the product of the letters' vectors, each rotated by its place."""
    letters = (grams[:, None] >> (np.uint64(21) * np.arange(n - 1, -1, -1, dtype=np.uint64))[None, :]) & np.uint64((1 << 21) - 1)
    known, at = np.unique(letters, return_inverse=True)
    vectors, at = letter_vectors(known, dimension), at.reshape(letters.shape)
    out = np.ones((len(grams), dimension), np.float32)
    for place in range(n):
        out *= np.roll(vectors, n - 1 - place, axis=1)[at[:, place]]
    return out


def count_grams(text: str | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the letters of a text in lower case, other characters being one space, and how often each occurs."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    first = np.concatenate([[True], letter[:-1]])  # of several other characters the first stays, as a space
    codes = np.where(letter, codes, 32)[letter | first]
    space = np.array([32])
    codes = np.concatenate([space[: int(codes[0] != 32)], codes, space[: int(codes[-1] != 32)], space.repeat(max(0, n - 2 - len(codes)))]).astype(np.uint64)
    grams = np.zeros(len(codes) - n + 1, np.uint64)
    for place in range(n):
        grams = (grams << np.uint64(21)) | codes[place : place + len(grams)]
    return np.unique(grams, return_counts=True)


@dataclass(frozen=True)
class Profiles:
    names: tuple[str, ...]
    vectors: np.ndarray  # unit rows
    n: int


def learn_profiles(docs: DataFrame, n: int = 3, dimension: int = 512) -> Profiles:
    """Bundle the n-gram vectors of all rows with text and lang (columns text, lang), every document at equal weight.

    Each task sums its documents' n-grams by language and sends one vector a language; the sums of a language's vectors come to
    the driver, one row a language. Rows without lang, text or letters are not used. The mean profile is taken off each
    profile, as what all languages share tells none apart.
    """

    def bundle(batches):
        sums: dict[str, dict[int, float]] = {}
        for part in batches:
            for lang, text in zip(part["lang"], part["text"], strict=True):
                grams, counts = count_grams(text, n)
                own = sums.setdefault(lang, {})
                for gram, share in zip(grams.tolist(), (counts / max(counts.sum(), 1)).tolist(), strict=True):
                    own[gram] = own.get(gram, 0.0) + share
        for lang, own in sums.items():
            total = np.zeros(dimension)
            grams, weights = np.fromiter(own, np.uint64, len(own)), np.fromiter(own.values(), np.float64, len(own))
            for k in range(0, len(grams), 4096):
                total += weights[k : k + 4096] @ gram_vectors(grams[k : k + 4096], n, dimension)
            yield pd.DataFrame({"lang": pd.Series([lang] * dimension, dtype=object), "at": np.arange(dimension, dtype=np.int32), "value": total})

    known = docs.select("lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    parts = known.mapInPandas(bundle, "lang string, at int, value double")
    rows = parts.groupBy("lang", "at").agg(F.sum("value").alias("value")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("vector")).orderBy("lang").collect()
    vectors = np.array([[v["value"] for v in r["vector"]] for r in rows]).reshape(len(rows), dimension)
    names = tuple(r["lang"] for r in rows)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    if len(names) > 1:
        vectors = vectors - vectors.mean(0)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return Profiles(names, vectors, n)


def detect_language(model: Profiles, text: str | Column) -> Column:
    """struct(lang, score): the profile nearest by cosine, the score being (1 + cosine) / 2. `und` and 0 without letters.

    Ties go to the name that sorts first. A model without languages answers `und`.
    """
    dimension = model.vectors.shape[1]

    @F.pandas_udf("lang string, score double")
    def nearest(texts: pd.Series) -> pd.DataFrame:
        names, scores = [], []
        for k in range(0, len(texts), 1024):
            counted = [count_grams(t, model.n) for t in texts.iloc[k : k + 1024]]
            grams = np.unique(np.concatenate([g for g, _ in counted]))
            bundles = np.zeros((len(counted), dimension), np.float32)
            for j in range(0, len(grams), 16384):  # so many n-gram vectors at a time
                slice_ = grams[j : j + 16384]
                vectors = gram_vectors(slice_, model.n, dimension)
                for bundle, (own, counts) in zip(bundles, counted, strict=True):
                    low, high = np.searchsorted(own, (slice_[0], slice_[-1]), side="left")
                    high += high < len(own) and own[high] == slice_[-1]
                    bundle += counts[low:high].astype(np.float32) @ vectors[np.searchsorted(slice_, own[low:high])]
            norms = np.linalg.norm(bundles, axis=1)
            for row, norm, (own, _) in zip(bundles, norms, counted, strict=True):
                if not len(own) or not len(model.names):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cosines = model.vectors @ row / max(float(norm), 1e-12)
                best = int(np.argmax(cosines))
                names.append(model.names[best])
                scores.append(float(np.clip((1 + cosines[best]) / 2, 0, 1)))
        return pd.DataFrame({"lang": pd.Series(names, dtype=object), "score": scores})

    return nearest(text)
