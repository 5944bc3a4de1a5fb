"""Alignment of two tokenizers over a corpus: which ids lie on the same bytes, and how often anywhere."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweir.llm.perfect_hash import PerfectHash
from claimweir.llm.shared import Scratch
from claimweir.llm.shingles import mixed, small_batches

#: Bytes of text that form a chunk, whose distinct pairs are counted together and asked for together.
CHUNK_BYTES = 6 << 20
#: Distinct pairs that one hash function holds, about.
RANGE_PAIRS = 1 << 17
#: Count vectors of a hash function that are added up in one group.
FAN = 64
#: A pair is a number: the first tokenizer's id, then the second one's in so many bits.
B_BITS = 24
_SPACE = "▁"
#: White space beside white space: there a text is not cut.
_WIDE = re.compile(r"\s\s")
#: How a byte-level BPE file cuts texts before it joins bytes (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Units that are encoded in one call.
TOGETHER = 200


def units(text: str) -> list[str]:
    """A text cut at single spaces between other characters, where both tokenizers always begin a token with the space.

    Each unit stands for itself with a space in front. Longer white space stays within a unit.
    """
    if not text:
        return []
    parts = text.split(" ")
    if not (text[0].isspace() or text[-1].isspace() or _WIDE.search(text)):
        return parts
    out = [parts[0]]
    for part in parts[1:]:
        if part and out[-1] and not out[-1][-1].isspace() and not part[0].isspace():
            out.append(part)
        else:
            out[-1] += " " + part
    return out


@dataclass(frozen=True)
class Aligned:
    """Units with their tokens and links; those of unit i are links[bounds[i] : bounds[i + 1]]."""

    right: np.ndarray  # whether both tokenizers give the unit's bytes back; if not it has no tokens
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    links: np.ndarray
    bounds: np.ndarray
    groups: list[str]  # empty unless asked for


class Aligner:
    """A byte-level BPE (A) and a sentencepiece BPE (B) side by side.

    The ids of A's file are the order of its merges, so its tokens are those of tiktoken with these ranks, which encodes many times
    faster; a file that is not of this form is refused.
    """

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding

        with open(path_a, encoding="utf-8") as file:
            told = json.load(file)
        vocabulary, merges = told["model"]["vocab"], told["model"]["merges"]
        joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
        kept = told["normalizer"] is None and told["pre_tokenizer"]["type"] == "ByteLevel" and not told["pre_tokenizer"]["add_prefix_space"]
        if not kept or not told["pre_tokenizer"]["use_regex"] or any(vocabulary.get(t) != 256 + i for i, t in enumerate(joined)):
            raise ValueError(f"{path_a} is no byte-level BPE whose ids follow its merges")
        # printable bytes stand for themselves, the others, in their order, for the characters from 256 on
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if i < 256 + len(merges)}
        self.a = Encoding("A", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.b = SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(_SPACE in p.lstrip(_SPACE) for p in pieces):
            raise ValueError("a piece goes on behind a space, so texts cannot be cut at spaces")
        self.bytes_a = [t for t, _ in sorted(ranks.items(), key=lambda item: item[1])]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(t) for t in own]) for own in (self.bytes_a, self.bytes_b))
        numbers = [str(i) for own in (self.bytes_a, self.bytes_b) for i in range(len(own))]
        self.named = np.array([[n + sign for n in numbers] for sign in (",", "|", ";", "")], object)

    def _encode(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units one after the other. Units with white space at an end are encoded alone, others together."""
        alone = [i for i, u in enumerate(found) if u.strip() != u or not u]
        cuts = sorted({0, len(found), *range(0, len(found), TOGETHER), *alone, *(i + 1 for i in alone)})
        texts = [" ".join(found[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        all_a, all_b = [self.a.encode_ordinary(" " + t) for t in texts], self.b.encode(texts, num_threads=1)
        return tuple(np.concatenate([np.array(i, np.int64) for i in ids]) if texts else np.empty(0, np.int64) for ids in (all_a, all_b))

    def _gives_back(self, unit: str) -> bool:
        a, b = self._encode([unit])
        return b"".join([self.bytes_a[i] for i in a]) == b"".join([self.bytes_b[i] for i in b]) == b" " + unit.encode()

    def align(self, found: list[str], with_groups: bool = False) -> Aligned:
        """Tokens, links and, if asked for, groups of units."""
        right = np.ones(len(found), bool)
        a, b = self._encode(found)
        whole = [b" " + u.encode() for u in found]
        if not b"".join([self.bytes_a[i] for i in a]) == b"".join([self.bytes_b[i] for i in b]) == b"".join(whole):
            right = np.array([self._gives_back(u) for u in found])
            a, b = self._encode([u for u, r in zip(found, right, strict=True) if r])
        # cuts are the byte offsets where a token of either ends: from one to the next lies the overlap of one token of each
        ends_a, ends_b = self.size_a[a].cumsum(), self.size_b[b].cumsum()
        both = np.append(ends_b, -1)[np.searchsorted(ends_b, ends_a)] == ends_a
        common = ends_a[both]
        cuts = np.sort(np.concatenate([ends_a[~both], ends_b]), kind="stable")
        links = a[np.searchsorted(ends_a, cuts)] << B_BITS | b[np.searchsorted(ends_b, cuts)]
        ends = np.cumsum(np.where(right, [len(w) for w in whole], 0)) if found else np.empty(0, np.int64)
        if not np.isin(ends[right], common).all():
            raise ValueError("tokens go on behind a cut")
        upto = [np.concatenate([[0], np.searchsorted(where, ends, side="right")]) for where in (ends_a, ends_b, common, cuts)]
        n_a, n_b, n_groups = (np.diff(u) for u in upto[:3])
        groups: list[str] = []
        if with_groups:
            in_a, in_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
            last_a, last_b = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (in_a, in_b))
            sign = np.concatenate([last_a.astype(int), np.where(last_b, 2 + np.isin(ends_b, ends), 0)])
            order = np.argsort(np.concatenate([2 * in_a, 2 * in_b + 1]), kind="stable")
            flat = self.named[sign, np.concatenate([a, b + len(self.bytes_a)])][order].tolist()
            at = upto[0] + upto[1]
            groups = ["".join(flat[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
        return Aligned(right, n_a, n_b, n_groups, links, upto[3], groups)


#: Tokenizers of this worker process; nothing of a text is kept with them.
_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


class Chunk:
    """Texts as arrays of numbers of their distinct units, which are aligned once."""

    def __init__(self, texts: list[str | None], tokenizers: Aligner, with_groups: bool = False):
        numbers: defaultdict[str, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        own = [np.fromiter(map(numbers.__getitem__, u), np.int64, len(u)) for u in map(units, (t or "" for t in texts))]
        self.found = tokenizers.align(list(numbers), with_groups)
        right = self.found.right
        #: The units of each text; none where a tokenizer does not give the text's bytes back.
        self.units = own if right.all() else [u if right[u].all() else u[:0] for u in own]
        self.at = np.cumsum([0, *map(len, self.units)])
        self.flat = np.concatenate(self.units) if self.units else np.empty(0, np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs linked in the chunk, sorted, and how many links hold each."""
        times = np.bincount(self.flat, minlength=len(self.found.right))
        keys, which = np.unique(self.found.links, return_inverse=True)
        each = np.repeat(times, np.diff(self.found.bounds))
        counts = np.bincount(which, weights=each, minlength=len(keys)).astype(np.int64)  # whole numbers below 2 ** 53
        return keys[counts > 0], counts[counts > 0]

    def per_text(self, of_unit: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(of_unit[self.flat])])
        return sums[self.at[1:]] - sums[self.at[:-1]]

    def per_unit(self, of_link: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(of_link)])
        return sums[self.found.bounds[1:]] - sums[self.found.bounds[:-1]]


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The hash function that a pair belongs to: all pairs of an id of B are in the same one."""
    with np.errstate(over="ignore"):
        mark = mixed((keys & ((1 << B_BITS) - 1)).astype(np.uint64) + np.uint64(1))
    return (mark % np.uint64(ranges)).astype(np.int64)


def _lists(column) -> list[np.ndarray]:
    """The arrays of a list column, without a copy of each number into Python."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, bounds = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
    return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _list_column(arrays: list[np.ndarray]) -> pa.ListArray:
    bounds = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64), pa.int64()))


_FUNCTION = "range long, sizes binary, words binary, members binary"


def _function(part: pa.Table) -> PerfectHash:
    return PerfectHash.from_bytes(*(part.column(c)[0].as_py() for c in ("sizes", "words", "members")))


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Tokens of each whole text by two tokenizers, aligned by bytes, with how often their pairs of ids are linked in the corpus.

    A (a byte-level BPE file) encodes the text with a space in front, B (a sentencepiece BPE model) the text, to which it adds
    the space itself. Two tokens are linked when their bytes overlap; byte offsets where tokens of both end cut them into groups.
    Returns one row per row: id, n_a, n_b, n_groups, n_links, n_best (links whose pair is linked as often as any pair of the same B
    id), count_sum (the corpus-wide links of each link's pair, added up) and groups (`a1,a2|b1;a3|b2,b3`).

    A first pass counts the distinct pairs of each chunk of texts. A minimal perfect hash function is made of the distinct pairs
    of each range (all pairs of a B id are in one range, so its best pair is known there). Chunks' counts become dense vectors indexed
    by hash, which are added up in a tree of groups of FAN. A second pass aligns the texts again and looks their pairs up: each chunk
    asks the ranges for its own pairs, and verified keys answer. Nothing is broadcast or collected. The number of pairs is
    bounded by the vocabularies, ranges follow from it, and chunks are of bounded size, however often a text or an id repeats.

    Texts that are null, empty, or that one of the tokenizers does not give back have no tokens: zeros and no groups. Repeated rows
    are answered each and counted each, null ids are passed on, other columns are ignored, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "align")
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["chunk", "id", "text", "keys", "counts"]

    def count(batches):
        number = TaskContext.get().partitionId() << 32
        tokenizers = aligner(path_a, path_b)
        for batch in small_batches(batches, 1, CHUNK_BYTES):
            keys, counts = Chunk(batch.column(1).to_pylist(), tokenizers).pairs()
            n, lists = batch.num_rows, pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), batch.column(0), batch.column(1), pa.nulls(n, lists), pa.nulls(n, lists)], names=names)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.nulls(1, batch.column(0).type), pa.nulls(1, batch.column(1).type), _list_column([keys]), _list_column([counts])], names=names)
            number += 1

    passed = scratch.write(rows.mapInArrow(count, f"chunk long, id {kind}, text string, keys array<long>, counts array<long>"))
    texts = passed.filter("keys IS NULL").select("chunk", "id", "text")
    pairs = passed.filter("keys IS NOT NULL").select("chunk", "keys", "counts")
    chunks = pairs.count()
    distinct = pairs.select(F.explode("keys").alias("key")).agg(F.approx_count_distinct("key")).first()[0]
    ranges, slices = max(1, -(-distinct // RANGE_PAIRS)), max(1, -(-chunks // FAN))

    def ask(batches):
        for batch in batches:
            for number, keys, counts in zip(batch.column(0).to_pylist(), _lists(batch.column(1)), _lists(batch.column(2)), strict=True):
                where = _range_of(keys, ranges)
                order = np.argsort(where, kind="stable")
                found, first = np.unique(where[order], return_index=True)
                cuts = [np.split(c[order], first[1:]) if len(found) else [] for c in (keys, counts)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(np.full(len(found), number)), *map(_list_column, cuts)], names=["range", "chunk", "keys", "counts"])

    asked = pairs.mapInArrow(ask, "range long, chunk long, keys array<long>, counts array<long>")
    asked = asked.withColumn("slice", F.pmod(F.xxhash64("chunk"), F.lit(slices)).cast("long"))

    def hashed(key, part):
        found = PerfectHash.of(part.column("key").to_numpy())
        return pa.table([pa.array([key[0].as_py()]), *(pa.array([b], pa.binary()) for b in found.to_bytes())], names=["range", "sizes", "words", "members"])

    keys = asked.select("range", F.explode("keys").alias("key")).distinct()
    functions = scratch.write(keys.groupBy("range").applyInArrow(hashed, _FUNCTION))
    every_slice = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice")

    def tally(key, part, function):
        function = _function(function)
        vector = np.zeros(len(function.members), np.int64)
        for own, counts in zip(_lists(part.column("keys")), _lists(part.column("counts")), strict=True):
            vector[function.slots(own)] += counts  # a chunk names each pair once
        return pa.table([*(pa.array([k.as_py()]) for k in key), pa.array([vector.tobytes()], pa.binary())], names=["range", "slice", "vector"])

    def add(key, part):
        total = 0
        for vector in part.column("vector"):
            total = total + np.frombuffer(vector.as_buffer(), np.int64)
        return pa.table([*(pa.array([k.as_py()]) for k in key), pa.array([total.tobytes()], pa.binary())], names=["range", "slice", "vector"])

    vector = "range long, slice long, vector binary"
    vectors = asked.groupBy("range", "slice").cogroup(functions.select("*", every_slice).groupBy("range", "slice")).applyInArrow(tally, vector)
    left = slices
    while left > 1:
        left = -(-left // FAN)
        vectors = vectors.withColumn("slice", F.col("slice") % left).groupBy("range", "slice").applyInArrow(add, vector)

    def with_best(batches):
        for batch in batches:
            out = []
            for members, vector in zip(batch.column(3), batch.column(4), strict=True):
                b = np.frombuffer(members.as_buffer(), np.int64) & ((1 << B_BITS) - 1)
                n = np.frombuffer(vector.as_buffer(), np.int64)
                most = np.zeros(int(b.max(initial=0)) + 1, np.int64)
                np.maximum.at(most, b, n)
                out.append((2 * n + (n == most[b])).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary())], names=["range", "sizes", "words", "members", "figures"])

    table = functions.join(vectors.select("range", "vector"), "range").select("range", "sizes", "words", "members", "vector")
    table = scratch.write(table.mapInArrow(with_best, f"{_FUNCTION}, figures binary"))

    def answer(key, part, function):
        hashes, figures = _function(function), np.frombuffer(function.column("figures")[0].as_py(), np.int64)
        own = _lists(part.column("keys"))
        slots = hashes.slots(np.concatenate(own) if own else np.empty(0, np.int64))
        if (slots < 0).any():
            raise ValueError("a pair of the first pass is missing")
        found = np.split(figures[slots], np.cumsum([len(k) for k in own])[:-1]) if own else []
        return pa.table([part.column("chunk"), _list_column(own), _list_column(found)], names=["chunk", "keys", "figures"])

    replies = asked.drop("counts").groupBy("range", "slice").cogroup(table.select("*", every_slice).groupBy("range", "slice")).applyInArrow(answer, "chunk long, keys array<long>, figures array<long>")

    def finish(key, part, reply):
        keys = np.concatenate([*_lists(reply.column("keys")), np.empty(0, np.int64)]).astype(np.int64)
        figures = np.concatenate([*_lists(reply.column("figures")), np.empty(0, np.int64)]).astype(np.int64)
        order = np.argsort(keys)
        keys, figures = keys[order], figures[order]
        chunk = Chunk(part.column("text").to_pylist(), aligner(path_a, path_b), with_groups=True)
        found = chunk.found
        # pairs that only texts without tokens hold are not among the keys
        at = np.minimum(np.searchsorted(keys, found.links), max(len(keys) - 1, 0))
        figure = np.where(keys[at] == found.links, figures[at], 0) if len(keys) else np.zeros(len(found.links), np.int64)
        columns = [found.n_a, found.n_b, found.n_groups, np.diff(found.bounds), chunk.per_unit(figure & 1), chunk.per_unit(figure >> 1)]
        groups = [";".join([found.groups[u] for u in own]) for own in chunk.units]
        return pa.table([part.column("id"), *(pa.array(chunk.per_text(c), pa.int64()) for c in columns), pa.array(groups, pa.string())], names=result)

    result = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    schema = f"id {kind}, " + ", ".join(f"{c} long" for c in result[1:-1]) + ", groups string"
    return texts.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(finish, schema).withColumnRenamed("id", id_column)
