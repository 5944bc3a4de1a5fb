"""Weighted backoff automaton: smoothed n-grams as states with failure arcs, walked once from left to right.

States are the empty history, every word seen in training, and the start of a text. A state's arcs lead over all words seen
after it; any other word takes the failure arc, whose weight is the mass that smoothing leaves, to the empty history, which
knows every word. The walk carries the state and adds log-probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweir.llm.shingles import mixed, slices, small_batches, word_hashes

#: Bytes of text that a task scores at a time, and for which it holds its part of the automaton.
CHUNK_BYTES = 12_000_000
#: Bytes of text, training and scored together, for each range of hashes in which counts are added up and asked for.
RANGE_BYTES = 8_000_000
#: Keys that a task counts before it hands them on.
HELD_KEYS = 2_000_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
START, END, OTHER = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def arc_key(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(state * _FACTOR + word)


def token_stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of texts (words, then one end each), the words before them (START first), and the tokens per text."""
    words, bounds = word_hashes(texts)
    counts = np.diff(bounds)
    ends = np.cumsum(counts + 1) - 1
    tokens = np.empty(len(words) + len(texts), np.uint64)
    at_word = np.ones(len(tokens), bool)
    at_word[ends] = False
    tokens[at_word] = words
    tokens[ends] = END
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.concatenate([[0], ends[:-1] + 1])[: len(texts)]] = START
    return tokens, before, counts + 1


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values at the wanted keys, 0 where a key is not known. Keys are sorted."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    order = np.argsort(wanted)  # neighbours in order are found in the same part of the memory
    at = np.empty(len(wanted), np.int64)
    at[order] = np.minimum(np.searchsorted(keys, wanted[order]), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def _distinct(keys: np.ndarray) -> np.ndarray:
    """np.unique by sorting: newer versions of it hash, which took 40 times as long as a sort of 3.4 million keys here."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]]


def _squeezed(numbers: np.ndarray) -> bytes:
    """8-byte numbers as all first bytes, then all second bytes, ..., each of them compressed apart: counts and the upper bytes of
    differences are far from evenly spread, which the compression of a shuffle cannot use."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T)
    parts = [pa.compress(plane.tobytes(), codec="zstd", asbytes=True) for plane in planes]
    return np.array([len(numbers), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def _restored(data: bytes) -> np.ndarray:
    count, *sizes = np.frombuffer(data, np.int64, 9).tolist()
    ends = np.cumsum([72, *sizes]).tolist()
    planes = b"".join(pa.decompress(data[a:b], decompressed_size=count, codec="zstd", asbytes=True) for a, b in zip(ends[:-1], ends[1:], strict=True))
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    steps = keys.copy()
    steps[1:] -= keys[:-1]
    return _squeezed(steps)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(_restored(data), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    return _squeezed(counts.astype(np.int64))


def unpacked_counts(data: bytes) -> np.ndarray:
    return _restored(data).view(np.int64)


def range_bounds(ranges: int) -> np.ndarray:
    """The first hash of every range but the first."""
    return np.array([-(-(i << 64) // ranges) for i in range(1, ranges)], np.uint64)


def cut(keys: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """(range, begin, end) of the ranges that sorted keys fall into."""
    at = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
    return [(int(i), int(at[i]), int(at[i + 1])) for i in np.flatnonzero(np.diff(at))]


def added_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else np.empty(0, np.int64)


@dataclass(frozen=True)
class Automaton:
    """What all tasks share: numbers of training tokens, distinct tokens and texts; histories only where a share is asked for."""

    tokens: int
    distinct: int
    texts: int
    strength: float
    states: np.ndarray | None = None

    def is_state(self, words: np.ndarray) -> np.ndarray:
        """Which words are histories. Without a share all are; those that training never saw have a count of 0."""
        return np.ones(len(words), bool) if self.states is None else np.isin(words, self.states)

    def arcs(self, before: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which tokens follow a history, which have an arc of their own, and the keys of the arcs; the others share OTHER."""
        history = self.is_state(before) | (before == START)
        own = self.is_state(token) | (token == END)
        return history, own, np.where(own, arc_key(before, token), arc_key(before, np.broadcast_to(OTHER, token.shape)))

    def learned(self, texts: list[str | None]) -> np.ndarray:
        """Keys of all tokens and arcs of training texts, as often as they occur."""
        token, before, _ = token_stream(texts)
        history, _, key = self.arcs(before, token)
        return np.concatenate([token, key[history]])

    def asked(self, texts: list[str | None]) -> np.ndarray:
        """All keys whose counts a walk over texts needs, sorted."""
        token, before, _ = token_stream(texts)
        history, _, key = self.arcs(before, token)
        pruned = np.empty(0, np.uint64) if self.states is None else arc_key(np.unique(before[history]), OTHER)
        return _distinct(np.concatenate([token, key[history], pruned]))

    def walk(self, texts: list[str | None], keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Per text: tokens, known tokens, base score, score. `keys` are sorted and hold all that is asked for."""
        token, before, sizes = token_stream(texts)
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        c = _find(keys, counts, token)
        base = np.log10((c + 1) / (self.tokens + self.distinct + 1))
        state, own, key = self.arcs(before, token)
        history = np.concatenate([[0], c[:-1]])[: len(c)]  # a word is as often a history as it is a token
        history[at] = self.texts
        history = np.where(state, history, 0)
        seen = np.where(own, _find(keys, counts, key), 0)
        pruned = 0 if self.states is None else _find(keys, counts, arc_key(before, np.broadcast_to(OTHER, token.shape)))
        total = history + self.strength
        chance = seen / total + (self.strength + pruned) / total * 10.0**base
        score = np.where(history > 0, np.log10(chance), base)
        return np.column_stack([sizes, *(np.add.reduceat(x, at) if len(at) else [] for x in ((c > 0).astype(float), base, score))])


def score_texts(
    docs: DataFrame, training: DataFrame, share: float = 0.0, strength: float = 100.0, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """log10 probability of every text under a bigram automaton learned from all training texts.

    Returns id, the columns in `keep`, n_tokens, n_known (seen in training), train_tokens, base_score (unigrams with add-one
    smoothing) and score. p(w | h) = c(h w) / (c(h) + s) + s / (c(h) + s) * p(w). Every word seen is a history and every pair
    of words seen is an arc, whatever the size of the corpus.

    Only a caller who gives `share` prunes: then histories are the words that make up this share of the training tokens or
    more, at most 1 / share, which are broadcast. Arcs to other words share the count c(h, other), which goes with the failure
    arc: p(w | h) = c(h w) / (c(h) + s) + (s + c(h, other)) / (c(h) + s) * p(w). Chances add up to 1 either way.

    Counts of words and arcs are added up by ranges of their hashes, so many that a range stays of one size as texts grow.
    Documents are dealt to chunks of about 12 MB; a chunk asks every range for the counts of its own words and arcs, and a task
    walks its texts over that part of the automaton. Null texts count as empty (one end token), in training too. Without
    training texts scores are those of the empty model. Null ids and repeated rows are scored like others; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    learn = training.select(F.col(text_column).alias("text"))
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), *keep)
    sizes = [x.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count("*").alias("rows")).first() for x in (learn, rows)]
    bounds = range_bounds(max(1, -(-sum(s["bytes"] or 0 for s in sizes) // RANGE_BYTES)))

    def counted(keys_of) -> DataFrame:
        """Rows (range, keys, counts): what tasks have counted in training, packed, a key once for some megabytes of text."""

        def handed_on(keys, counts):
            keys, counts = added_up(keys, counts)
            parts = cut(keys, bounds)
            values = [[i for i, _, _ in parts], [packed(keys[a:b]) for _, a, b in parts], [packed_counts(counts[a:b]) for _, a, b in parts]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(values, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["range", "keys", "counts"])

        def count(batches):
            keys, counts = [], []
            with np.errstate(over="ignore"):
                for batch in small_batches(batches, 0):
                    own = np.unique(keys_of(batch.column(0).to_pylist()), return_counts=True)
                    keys.append(own[0])
                    counts.append(own[1])
                    if sum(map(len, keys)) >= HELD_KEYS:
                        yield handed_on(keys, counts)
                        keys, counts = [], []
                if keys:
                    yield handed_on(keys, counts)

        return learn.mapInArrow(count, "range long, keys binary, counts binary")

    def merged(part) -> tuple[np.ndarray, np.ndarray]:
        return added_up([unpacked(x) for x in part.column("keys").to_pylist()], [unpacked_counts(x) for x in part.column("counts").to_pylist()])

    words = counted(lambda texts: token_stream(texts)[0])

    def word_sums(part):
        keys, counts = merged(part)
        return pa.table({"tokens": pa.array([counts.sum()], pa.int64()), "distinct": pa.array([len(keys)], pa.int64())})

    sums = words.groupBy("range").applyInArrow(word_sums, "tokens long, distinct long").agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct")).first()
    tokens, states = sums["tokens"] or 0, None
    if share > 0:

        def frequent(part):
            keys, counts = merged(part)
            return pa.table({"key": pa.array(keys[(counts >= tokens * share) & (keys != END)].view(np.int64))})

        often = words.groupBy("range").applyInArrow(frequent, "key long").collect()  # at most 1 / share rows
        states = np.sort(np.array([r["key"] for r in often], np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast(Automaton(tokens, sums["distinct"] or 0, sizes[0]["rows"], strength, states))

    chunks = max(1, -(-(sizes[1]["bytes"] or 0) // CHUNK_BYTES))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("long")).repartition(chunks, "chunk")

    def asked_by(texts: list[str | None]) -> np.ndarray:
        parts = [shared.value.asked(texts[low:high]) for low, high in slices(texts, 4 << 20)]
        return _distinct(np.concatenate([np.empty(0, np.uint64), *parts]))

    def ask(key, part):
        with np.errstate(over="ignore"):
            keys = asked_by(part.column("text").to_pylist())
        parts = cut(keys, bounds)
        return pa.table(
            {
                "chunk": pa.array([key[0].as_py()] * len(parts), pa.int64()),
                "range": pa.array([i for i, _, _ in parts], pa.int64()),
                "keys": pa.array([packed(keys[a:b]) for _, a, b in parts], pa.binary()),
            }
        )

    def answer(_, known, asking):
        keys, counts = merged(known)
        found = [packed_counts(_find(keys, counts, unpacked(x))) for x in asking.column("keys").to_pylist()]
        return pa.table({"chunk": asking.column("chunk"), "range": asking.column("range"), "counts": pa.array(found, pa.binary())})

    asked = dealt.groupBy("chunk").applyInArrow(ask, "chunk long, range long, keys binary")
    known = counted(lambda texts: shared.value.learned(texts))
    answers = known.groupBy("range").cogroup(asked.groupBy("range")).applyInArrow(answer, "chunk long, range long, counts binary")
    kinds = dict(rows.dtypes)
    kept = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    schema = f"id {kinds['id']}, {kept + ', ' if kept else ''}n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def walk(key, part, answer):
        model = shared.value
        texts = part.column("text").to_pylist()
        order = np.argsort(answer.column("range").to_numpy())
        told = answer.column("counts").to_pylist()
        counts = np.concatenate([np.empty(0, np.int64), *(unpacked_counts(told[i]) for i in order)]).astype(np.float64)
        with np.errstate(over="ignore"):
            keys = asked_by(texts)
            if len(keys) != len(counts):
                raise ValueError(f"chunk {key[0]}: {len(keys)} counts asked for, {len(counts)} told")
            out = np.concatenate([np.empty((0, 4)), *(model.walk(texts[low:high], keys, counts) for low, high in slices(texts, 4 << 20))])
        columns = {"id": part.column("id")} | {c: part.column(c) for c in keep}
        columns |= {"n_tokens": pa.array(out[:, 0].astype(np.int64)), "n_known": pa.array(out[:, 1].astype(np.int64)), "train_tokens": pa.array(np.full(len(out), model.tokens, np.int64))}
        return pa.table(columns | {"base_score": pa.array(out[:, 2]), "score": pa.array(out[:, 3])})

    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(walk, schema).withColumnRenamed("id", id_column)
