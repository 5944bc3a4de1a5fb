"""Mixture-controlled packing: deficit round-robin over the token streams of sources, in closed form."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimweir.llm.shingles import small_batches

#: Bytes of text that one task packs at a time.
BUCKET_BYTES = 16_000_000
#: White space as the tokenizer's normaliser knows it (Unicode White_Space).
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Words of letters up to U+024F and ASCII signs: normal forms already, in lower case letter by letter.
_PLAIN = re.compile(r"[!-~\xa1-\u012f\u0131-\u024f]+")
#: How the word-level files cut words (fixed value), and what is put behind each part, and between words as a part of its own.
WORD_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PART_END, _WORD_END = "\x01", "\n"


def _words(text: str) -> list[str]:
    """The words of a text; Python's own split knows four more separators, which texts hardly ever hold."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return _SPACE.split(text)
    return text.split()


class PlainWords:
    """Ids of plain words by tiktoken, for a BPE file of the word-level form; many times faster than one call for each word.

    Such a file marks the last sign of a word part. Here a mark of one byte follows the part, and joining it to the sign before
    comes ahead of all merges, which then follow in the file's order: the ids are the file's.
    """

    def __init__(self, told: dict):
        from tiktoken import Encoding

        vocabulary, merges = told["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in told["model"]["merges"]]
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
        mark = _PART_END.encode()

        def plain(token: str) -> bytes:
            ends = token.endswith("</w>") and len(token) > 4
            return bytes(byte_of[c] for c in (token[:-4] if ends else token)) + mark * ends

        # bytes first, as tiktoken wants them; then each byte with the mark, then the merges
        order = [bytes([b]) for b in range(256)] + [bytes([b]) + mark for b in range(256)] + [plain("".join(m)) for m in merges]
        sign = {b: c for c, b in byte_of.items()}
        names = [sign[b] for b in range(256)] + [sign[b] + "</w>" for b in range(256)] + ["".join(m) for m in merges]
        ranks = {t: i for i, t in enumerate(order)}
        if len(ranks) != len(order) or any(n not in vocabulary for n in names):
            raise ValueError("two merges give the same token")
        self.ids = np.array([vocabulary[n] for n in names])
        self.end = ranks[(_WORD_END + _PART_END).encode()]
        self.encoding = Encoding("words", pat_str=f"[^{_PART_END}]+{_PART_END}", mergeable_ranks=ranks, special_tokens={})
        self.parts = regex.compile(f"{WORD_PARTS}|{_WORD_END}")

    @classmethod
    def of(cls, path: str) -> PlainWords | None:
        """None for files of another form."""
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        normalizers = [n["type"] for n in (told["normalizer"] or {}).get("normalizers", [])]
        cut = (told["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        same = normalizers == ["NFC", "Replace", "Lowercase"] and cut.get("pattern") == {"Regex": WORD_PARTS} and told["model"].get("end_of_word_suffix") == "</w>"
        return cls(told) if same else None

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each has."""
        found, sizes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for low in range(0, len(words), 10_000):
            text = _WORD_END.join([*words[low : low + 10_000], ""]).lower()
            marked = _PART_END.join([*self.parts.findall(text), ""])
            ranks = np.array(self.encoding.encode_ordinary(marked), np.int64)
            ends = np.flatnonzero(ranks == self.end)
            sizes.append(np.diff(ends, prepend=-1) - 1)
            found.append(self.ids[np.delete(ranks, ends)])
        return np.concatenate(found), np.concatenate(sizes)


class WordTokens:
    """Token ids of texts; each distinct word of a call is encoded once.

    Right for tokenizers that drop white space and never join what it parts, as the word-level files do. Plain words go the fast way
    if the file allows it, all others to the tokenizer itself, which is loaded when it is needed. Nothing of a text is kept.
    """

    def __init__(self, path: str):
        self.path = path
        self._tokenizer = None
        self.plain = PlainWords.of(path)
        #: Ids of a vocabulary that is not larger take two bytes each.
        size = int(self.plain.ids.max()) + 3 if self.plain else self.tokenizer.get_vocab_size()
        self.kind = "<u2" if size <= 1 << 16 else "<u4"

    @property
    def tokenizer(self):
        if self._tokenizer is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks of a machine side by side
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
        return self._tokenizer

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in some order, and where those of each word begin and end."""
        fast = [self.plain is not None and _PLAIN.fullmatch(w) is not None and "<|" not in w for w in words]
        rest = [w for w, f in zip(words, fast, strict=True) if not f]
        ids, sizes = self.plain.encode([w for w, f in zip(words, fast, strict=True) if f]) if any(fast) else (np.empty(0, np.int64),) * 2
        slow = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)] if rest else []
        lengths = np.zeros(len(words), np.int64)
        is_fast = np.array(fast, bool)
        lengths[is_fast], lengths[~is_fast] = sizes, [len(i) for i in slow]
        first = np.zeros(len(words), np.int64)
        first[is_fast] = np.cumsum(sizes) - sizes
        first[~is_fast] = len(ids) + np.cumsum([0, *[len(i) for i in slow]])[:-1]
        return np.concatenate([ids, *[np.array(i, np.int64) for i in slow]]), np.stack([first, first + lengths])

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian numbers of self.kind."""
        numbers: defaultdict[str, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        own = [np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in map(_words, (t or "" for t in texts))]
        ids, (first, end) = self.encode_words(list(numbers))
        words = np.concatenate([*own, np.empty(0, np.int64)])
        sizes = (end - first)[words]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        places = np.arange(upto[-1]) + np.repeat(first[words] - upto[:-1], sizes)
        data, width = ids[places].astype(self.kind).tobytes(), np.dtype(self.kind).itemsize
        cuts = (width * upto[np.cumsum([0, *map(len, own)])]).tolist()
        return [data[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


#: Tokenizers of this worker process.
_encoders: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    if path not in _encoders:
        _encoders[path] = WordTokens(path)
    return _encoders[path]


def phases(amounts: list[int], targets: list[float | int]) -> list[tuple[list[int], list[int]]]:
    """How the mixture develops until all queues are empty: (tokens taken from each source, tokens taken before) per phase.

    In a phase every source that still has tokens gives tokens in the ratio of its target; the phase ends when the first of
    them runs dry. Sources with target 0 wait until all others are empty, and then share by what they have.
    """
    left = list(amounts)
    done = [0] * len(left)
    out = []
    while any(left):
        weights = [Fraction(t) if n else Fraction(0) for t, n in zip(targets, left, strict=True)]
        if not any(weights):
            weights = [Fraction(n) for n in left]
        length = min(n / w for n, w in zip(left, weights, strict=True) if w)
        taken = [n if w and n == length * w else min(n, int(length * w)) for n, w in zip(left, weights, strict=True)]
        out.append((taken, list(done)))
        left = [n - t for n, t in zip(left, taken, strict=True)]
        done = [n + t for n, t in zip(done, taken, strict=True)]
    return out


#: Edges of windows that a schedule remembers.
EDGES = 100_000


class Schedule:
    """Where each token of each source's stream goes.

    After x tokens of output the sources have given x tokens together, shared out by halving the list of sources: of x tokens
    of a part, floor(x L / (L + R)) come from its left half, L and R being the amounts of the halves. What a source has given
    never falls as x grows, differs from its exact share by less than the number of halvings, and is right at the end. So in
    every window each source gives its share, and the deficit is carried to the next window: the quotas of deficit
    round-robin, known for any window without the ones before it.
    """

    def __init__(self, amounts: list[int], targets: list[float | int], window: int):
        self.window = window
        self.phases = []
        self.edges: dict[tuple[int, int, int], tuple[int, int]] = {}
        self.reached: dict[tuple[int, int], int] = {}
        at = 0
        for taken, before in phases(amounts, targets):
            ends = [0]
            for n in taken:
                ends.append(ends[-1] + n)
            self.phases.append((at, ends, before))
            at += ends[-1]
        self.total = at

    @staticmethod
    def given(ends: list[int], source: int, x: int) -> tuple[int, int]:
        """Of the first x tokens of a phase, those of the sources before this one, and its own."""
        low, high, ahead = 0, len(ends) - 1, 0
        while high - low > 1:
            middle = (low + high) // 2
            whole = ends[high] - ends[low]
            left = x * (ends[middle] - ends[low]) // whole if whole else 0
            if source < middle:
                high, x = middle, left
            else:
                low, x, ahead = middle, x - left, ahead + left
        return ahead, x

    def at_edge(self, number: int, source: int, window: int) -> tuple[int, int]:
        """What `given` says at the start of a window of a phase. Neighbouring documents ask for the same edges."""
        key = (number, source, window)
        if key not in self.edges:
            if len(self.edges) > EDGES:
                self.edges.clear()
            first, ends, _ = self.phases[number]
            self.edges[key] = self.given(ends, source, min(max(window * self.window - first, 0), ends[-1]))
        return self.edges[key]

    def pieces(self, source: int, start: int, end: int) -> list[tuple[int, int, int, int]]:
        """(stream position, length, sequence, offset) of the pieces that hold positions start..end of a source's stream."""
        out = []
        for number, (first, ends, before) in enumerate(self.phases):
            low = before[source]
            a, b = max(start, low), min(end, low + ends[source + 1] - ends[source])
            if a >= b:
                continue
            window = self.reached.get((number, source), 0)
            if not self.at_edge(number, source, window)[1] <= a - low < self.at_edge(number, source, window + 1)[1]:
                window, last = first // self.window, (first + ends[-1] - 1) // self.window
                while window < last:  # the first window after which the source has given more than a - low tokens
                    middle = (window + last) // 2
                    if self.at_edge(number, source, middle + 1)[1] > a - low:
                        last = middle
                    else:
                        window = middle + 1
            ahead0, own0 = self.at_edge(number, source, window)
            while True:
                ahead1, own1 = self.at_edge(number, source, window + 1)
                until = min(b, low + own1)
                if until > a:
                    offset = max(first - window * self.window, 0) + ahead1 - ahead0 + a - low - own0
                    out.append((a, until - a, window, offset))
                    a = until
                if a >= b:
                    break
                window, ahead0, own0 = window + 1, ahead1, own1
            self.reached[number, source] = window
        return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = 2048,
    end_id: int = 1,
    targets: Mapping[str, float] | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """Pack all documents into sequences of `window` tokens whose sources are mixed as `targets` say.

    Returns one row per piece: id, source, start (ids of the document before it), length, ids_crc32 (of its ids as
    little-endian unsigned 32-bit numbers), doc_tokens (with the end id that follows every document), sequence_id, offset.
    Only the last sequence may be shorter than the window, so padding is less than one window.

    A source is a queue of its documents by (hash bucket, id, hash of the text). Without targets a source's share is its share of all
    tokens, so every window has the mixture of the corpus. With targets, sources that they do not name come last, when the
    named ones are empty; as one source runs dry the others keep their ratio. The totals of sources reach every task as one
    row a source; nothing of a document passes the driver. They are tokenized once; their ids are
    dealt out to tasks by hash, and measured and cut from that one shuffle.

    Null text counts as empty: such documents are one end id. A null source is a queue of its own. Repeated rows are packed
    each, in buckets by their place in the input, so that no bucket grows with them. An empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(source_column).cast("string").alias("source"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    # rows that repeat an id and a text are dealt out by their place in the input, which any number of them may share
    bucket = F.pmod(F.xxhash64("id", "text", F.monotonically_increasing_id()), F.lit(buckets)).cast("long").alias("bucket")
    rows = rows.select("id", "source", bucket, F.xxhash64("text").alias("mark"), "text")
    width = np.dtype(word_tokens(tokenizer).kind).itemsize

    def tokenize(batches):
        encoder = word_tokens(tokenizer)
        for batch in small_batches(batches, 4):
            ids = encoder.encode_all(batch.column(4).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.binary())], names=["id", "source", "bucket", "mark", "ids"])

    kind = dict(rows.dtypes)["id"]
    dealt = rows.mapInArrow(tokenize, f"id {kind}, source string, bucket long, mark long, ids binary").repartition(buckets, "bucket")

    def measure(key, part):
        sums: dict[str | None, int] = {}
        for source, data in zip(part.column("source").to_pylist(), part.column("ids"), strict=True):
            sums[source] = sums.get(source, 0) + len(data.as_buffer()) // width + 1
        return pa.table({"bucket": pa.array([key[0].as_py()] * len(sums), pa.int64()), "source": pa.array(list(sums), pa.string()), "tokens": pa.array(list(sums.values()), pa.int64())})

    # Both readers of `dealt`, and both of `started`, need the same columns, so that Spark shuffles once and reuses it.
    measured = dealt.groupBy("bucket").applyInArrow(measure, "bucket long, source string, tokens long")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    started = measured.withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    # one row a bucket holds all its sources; totals have one row a source
    starts = started.groupBy(F.col("bucket").alias("part")).agg(F.collect_list(F.struct("source", "first")).alias("starts"))
    totals = started.groupBy("source").agg(F.max(F.col("first") + F.col("tokens")).alias("tokens"))
    totals = totals.agg(F.sort_array(F.collect_list(F.struct("source", "tokens"))).alias("totals"))
    plan = starts.join(F.broadcast(totals))

    def cut(key, part, plan):
        totals = plan.column("totals")[0].as_py()
        sources = [t["source"] for t in totals]
        amounts = [t["tokens"] for t in totals]
        shares = amounts if targets is None else [targets.get(s, 0) if s is not None else 0 for s in sources]
        schedule = Schedule(amounts, shares, window)
        place = {s: k for k, s in enumerate(sources)}
        at = {s["source"]: s["first"] for s in plan.column("starts")[0].as_py()}
        out: list[list] = [[] for _ in range(8)]
        end = np.array([end_id], "<u4")
        part = part.sort_by([("source", "ascending"), ("id", "ascending"), ("mark", "ascending")])
        for source, doc, data in zip(part.column("source"), part.column("id"), part.column("ids"), strict=True):
            source, doc = source.as_py(), doc.as_py()
            ids = np.concatenate([np.frombuffer(data.as_buffer(), f"<u{width}"), end]).astype("<u4")
            n, first = len(ids), at[source]
            for position, length, sequence, offset in schedule.pieces(place[source], first, first + n):
                start = position - first
                for column, value in zip(out, (doc, source, start, length, zlib.crc32(ids[start : start + length]), n, sequence, offset), strict=True):
                    column.append(value)
            at[source] = first + n
        kinds = [part.schema.field("id").type, pa.string(), *[pa.int64()] * 6]
        names = ["id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, out, kinds, strict=True)})

    schema = f"id {kind}, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    pieces = dealt.groupBy("bucket").cogroup(plan.groupBy("part")).applyInArrow(cut, schema)
    return pieces.withColumnRenamed("id", id_column)
