"""Size-aware heavy-light n-gram Jaccard join.

Sets up to a boundary size, chosen by cost, enumerate the subsets that a similar set must share; larger sets meet in
inverted lists. Either way a set sends tokens, and similar sets share a token:

- light: sets of sizes s and s' that are similar share c = ceil(num (s + s') / (num + den)) shingles, so both hold a common
  subset of c; a token is (s, s', subset);
- heavy: in any order of shingles, two similar sets share one of the first |A| - ceil(num |A| / den) + 1 of each, and behind the
  places of the first one they share either set has as many shingles as they have to have in common. Frequent shingles come last in
  the order, so that a passage of many documents does not make a list of them.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweir.llm.bits import bit_array, has_bit
from claimweir.llm.components import components
from claimweir.llm.shared import Scratch, arrow_rows
from claimweir.llm.shingles import mixed, shingle_sets, small_batches

#: Shingles whose hash lies in the lowest quarter come first and are counted in all sets. The others are counted only in sets that have
#: too few unfrequent ones there: no other set has them in its prefix.
LOW_BITS = 62
LOW = np.uint64(1 << LOW_BITS)
#: Least and most bits of an array of places, and bits for each place that is set.
PLACES = (1 << 20, 1 << 28)
ROOM = 16
#: Bits for each frequent place; there are few, and another shingle that falls on one of their bits only comes later in the order.
FREQUENT_ROOM = 64
#: Rows of a batch that goes to Python.
ROWS = 1_000
#: A shingle of more documents counts as frequent and comes last in the order.
FREQUENT = 16
ID_BITS = 1 << 24
#: Least and most bits of a parity sketch, whose bit h holds whether a set has an odd number of shingles with hash h.
PARITY_BITS = (1 << 10, 1 << 17)
#: Words of 64 bits of the short sketch that stands in lists, the first bits of which the join on a token looks at.
FOLDED = [f"fold{i}" for i in range(4)]
#: Rounds in which each list is compared with one of its sets, before what is still apart is compared pair by pair.
ROUNDS = 3


def least_common(a: int, b: int, num: int, den: int) -> int:
    """The least overlap of sets of sizes a and b with den * |A & B| >= num * |A | B|."""
    return -(-num * (a + b) // (num + den))


def subset_sizes(size: int, boundary: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """For a light set: (least size, greatest size, c) for each size up to the boundary that a similar set may have."""
    out = []
    for other in range(max(1, -(-num * size // den)), min(boundary, den * size // num) + 1):
        c = least_common(size, other, num, den)
        if c <= min(size, other):
            out.append((min(size, other), max(size, other), c))
    return out


def choose_boundary(num: int, den: int, list_length: float, most: int = 64) -> int:
    """The greatest size whose subsets cost no more than scanning the lists of its prefix, up to `most`."""
    boundary = 0
    for size in range(1, most + 1):
        subsets = sum(comb(size, c) for _, _, c in subset_sizes(size, most, num, den))
        prefix = size - -(-num * size // den) + 1
        if subsets > prefix * list_length:
            break
        boundary = size
    return boundary


def place_bits(count: int, room: int = ROOM) -> int:
    """log2 of the bits of an array that `count` places go into."""
    least, most = PLACES
    return (min(max(room * count, least), most) - 1).bit_length()


class Places:
    """Shingles of some property as bits by their hash, low ones and others apart. A few others fall on the same bits, the same ones
    for every set, so orders stay the same for all and nothing that is shared counts as alone."""

    def __init__(self, low: np.ndarray, high: np.ndarray | None = None):
        self.low, self.high = low, high

    @staticmethod
    def column(low: bool, bits: int) -> Column:
        """The place of column shingle, a 64-bit number as Spark's signed long."""
        return F.shiftrightunsigned("shingle", LOW_BITS - bits if low else 64 - bits).alias("place")

    def has(self, shingles: np.ndarray) -> np.ndarray:
        """For sorted shingles, the low ones of which are the first."""
        cut = np.searchsorted(shingles, LOW)
        parts = [has_bit(self.low, (shingles[:cut] >> np.uint64(LOW_BITS + 1 - (8 * len(self.low)).bit_length())).astype(np.int64))]
        if cut < len(shingles):
            parts.append(has_bit(self.high, (shingles[cut:] >> np.uint64(65 - (8 * len(self.high)).bit_length())).astype(np.int64)))
        return np.concatenate(parts)


def prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def wants_more(shingles: np.ndarray, boundary: int, num: int, den: int, frequent: Places) -> bool:
    """Whether a set that may meet a heavy one has too few unfrequent shingles among the low ones to fill its prefix."""
    n = len(shingles)
    if n <= num * boundary // den:
        return False
    low = shingles[: np.searchsorted(shingles, LOW)]
    size = prefix_size(n, num, den)
    return len(low) < size or int((~frequent.has(low)).sum()) < size


def tokens_of(shingles: np.ndarray, boundary: int, num: int, den: int, shared: Places, frequent: Places) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of one set (sorted shingles), and at which place of its order each stands (0 for subsets).

    The order is: low shingles that are not frequent, others that are not, frequent ones, each by hash. Tokens of shingles known to
    be in one set only are left out.
    """
    n = len(shingles)
    out, at = [], []
    if n > num * boundary // den:  # may be similar to a heavy set
        last = frequent.has(shingles)
        first = np.concatenate([np.flatnonzero(~last), np.flatnonzero(last)])[: prefix_size(n, num, den)]
        kept = np.flatnonzero(shared.has(shingles)[first])
        out.append(shingles[first[kept]])
        at.append(kept)
    if n <= boundary:
        for least, most, c in subset_sizes(n, boundary, num, den):
            subsets = np.array(list(combinations(range(n), c)))
            keys = np.full(len(subsets), least * 1000 + most, np.uint64)
            for j in range(c):
                keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + shingles[subsets[:, j]])
            out.append(keys)
            at.append(np.zeros(len(keys), np.int64))
    return (np.concatenate(out), np.concatenate(at)) if out else (np.empty(0, np.uint64), np.empty(0, np.int64))


def parity_of(shingles: np.ndarray) -> bytes:
    """A sketch in which two sets differ in at most as many bits as there are shingles in just one of them.

    It has a bit for each shingle, rounded up to a power of two. One half folded onto the other is the sketch of half the bits.
    """
    least, most = PARITY_BITS
    bits = min(max(least, 1 << max(len(shingles) - 1, 0).bit_length()), most)
    counts = np.bincount((mixed(shingles) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(bool), bitorder="little").tobytes()


def folded(sketch: bytes) -> np.ndarray:
    """A parity sketch folded to as many bits as FOLDED holds."""
    bits = np.frombuffer(sketch, np.int64)
    return np.bitwise_xor.reduce(bits.reshape(-1, len(FOLDED)), axis=0)


def bits_apart(mine: list[bytes], theirs: list[bytes]) -> np.ndarray:
    """Bits in which parity sketches differ, pair by pair, at the lesser of the two sizes."""
    apart = np.empty(len(mine), np.int64)
    sizes = np.array([(len(x), len(y)) for x, y in zip(mine, theirs, strict=True)], np.int64).reshape(-1, 2)
    for pair in np.unique(sizes, axis=0):
        rows = np.flatnonzero((sizes == pair).all(1))
        x, y = (np.frombuffer(b"".join([side[k] for k in rows]), np.uint8).reshape(len(rows), -1) for side in (mine, theirs))
        while x.shape[1] != y.shape[1]:
            half = max(x.shape[1], y.shape[1]) // 2
            x, y = (v[:, :half] ^ v[:, half:] if v.shape[1] > half else v for v in (x, y))
        apart[rows] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    return apart


def jaccard_join(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Link texts whose sets of k-word shingles have a Jaccard similarity of num / den or more, compared in whole numbers.

    Returns one row per row: id, n_shingles, component_id (the smallest id reachable by links, itself included). A text of
    fewer than k words has one shingle, all its words. Null and empty texts have none and link with nothing. Rows with a null
    id link with nothing either and have a null component. Rows that repeat an id link what any of them links. An empty table
    gives an empty result; other columns are ignored.

    Texts with equal sets become one before anything is compared. Each token's list is then compared with one of its sets in
    each of three rounds, and linked sets are merged into components, which settles a list of copies by as many comparisons as it has sets;
    what still lies in different components of a list is compared pair by pair. No list is cut. Pairs whose parity sketches
    already differ in more bits than similar sets may have shingles of one side are dropped; the whole sets of the others are
    made again from the texts and compared. Components are all that is returned, so a pair known to be connected need not be
    compared.
    """
    with arrow_rows(docs.sparkSession, ROWS):
        return _join(docs, k, num, den, id_column, text_column)


def _join(docs: DataFrame, k: int, num: int, den: int, id_column: str, text_column: str) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    context = spark.sparkContext
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))

    def counted(choose, low: bool) -> DataFrame:
        """The shingles that `choose` takes from the sets and that occur in more than one of them, with how many."""

        def run(batches):
            for batch in small_batches(batches, 1):
                chosen = [choose(s) for s in shingle_sets(batch.column(1).to_pylist(), k, True)]
                found, n = np.unique(np.concatenate(chosen), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["shingle", "n"])

        rows = texts.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter("n > 1")
        return scratch.write(rows)

    def arrays(repeated: DataFrame, low: bool) -> list[np.ndarray]:
        often = repeated.filter(F.col("n") > FREQUENT)
        sizes = [place_bits(repeated.count()), place_bits(often.count(), FREQUENT_ROOM)]
        return [bit_array(rows.select(Places.column(low, bits)), 1 << bits) for rows, bits in zip((repeated, often), sizes, strict=True)]

    repeated = counted(lambda s: s[: np.searchsorted(s, LOW)], True)
    mean = repeated.agg(F.avg(F.least("n", F.lit(FREQUENT)))).first()[0] or 2.0
    boundary = choose_boundary(num, den, mean)
    shared_low, frequent_low = arrays(repeated, True)
    scratch.drop(repeated)
    first = context.broadcast(Places(frequent_low))
    repeated = counted(lambda s: s[np.searchsorted(s, LOW) :] if wants_more(s, boundary, num, den, first.value) else s[:0], False)
    shared_high, frequent_high = arrays(repeated, False)
    scratch.drop(repeated)
    first.unpersist()
    shared = context.broadcast(Places(shared_low, shared_high))
    frequent = context.broadcast(Places(frequent_low, frequent_high))

    def signatures(batches):
        with np.errstate(over="ignore"):
            for batch in small_batches(batches, 1):
                sets = shingle_sets(batch.column(1).to_pylist(), k, True)
                prints = [(int(mixed(s + np.uint64(1)).sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mixed(s ^ np.uint64(0x5851F42D4C957F2D))))) if len(s) else (0, 0) for s in sets]
                prints = np.array(prints, np.uint64).reshape(-1, 2).view(np.int64)
                tokens = [tokens_of(s, boundary, num, den, shared.value, frequent.value) for s in sets]
                sketches = [parity_of(s) for s in sets]
                folds = np.array([folded(s) for s in sketches], np.int64).reshape(-1, len(FOLDED))
                offsets = pa.array(np.cumsum([0] + [len(t) for t, _ in tokens]).astype(np.int32))
                empty = np.empty(0, np.int64)
                own, at = (np.concatenate([empty, *[t[i].view(np.int64) for t in tokens]]) for i in (0, 1))
                lists = pa.StructArray.from_arrays([pa.array(own), pa.array(at)], names=["token", "at"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.ListArray.from_arrays(offsets, lists), pa.array(sketches, pa.binary()), *(pa.array(folds[:, i]) for i in range(len(FOLDED)))],
                    names=["id", "n", "f1", "f2", "tokens", "parity", *FOLDED],
                )

    signed = scratch.write(texts.mapInArrow(signatures, "id long, n long, f1 long, f2 long, tokens array<struct<token: long, at: long>>, parity binary, " + ", ".join(f"{f} long" for f in FOLDED)))
    known = signed.filter("id IS NOT NULL AND n > 0")
    classes = scratch.write(known.groupBy("n", "f1", "f2").agg(F.min_by(F.struct("id", "tokens", "parity", *FOLDED), "id").alias("first")).select("n", "f1", "f2", F.col("first.id").alias("rep"), "first.*"))

    lists = classes.select(F.explode("tokens").alias("t"), "rep", "n", *FOLDED).select("t.*", "rep", "n", *FOLDED)
    several = lists.groupBy("token").agg(F.count("*").alias("members")).filter("members > 1").select("token")
    lists = scratch.write(lists.join(several, "token"))
    parity = classes.select(F.col("rep").alias("id"), "n", "parity")

    def reaches(n: str, at: str, m: str) -> Column:
        """Whether a set has as many shingles from the place of a token on as it and another have in common."""
        return (F.col(n) - F.col(at)) * (num + den) >= num * (F.col(n) + F.col(m))

    linked = None
    at = None
    for round_number in range(ROUNDS + 1):
        here = lists if at is None else lists.join(at.select(F.col("id").alias("rep"), "component"), "rep", "left")
        here = here.withColumn("component", F.col("rep") if at is None else F.coalesce("component", "rep"))
        # the head of a list has least before the token, so it is likeliest similar to the others; later on, that of some component
        turn = F.lit(0) if at is None else F.xxhash64("component", F.lit(round_number))
        head = F.struct(turn.alias("turn"), "at", F.xxhash64("rep").alias("hash"), "rep", "n", "component", *FOLDED)
        heads = here.groupBy("token").agg(F.min(head).alias("head"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
        if round_number < ROUNDS:
            pairs = here.join(heads.select("token", F.col("head.rep").alias("other"), F.col("head.n").alias("m"), F.col("head.at").alias("its"), F.col("head.component").alias("theirs"), *[F.col(f"head.{f}").alias(f"{f}_") for f in FOLDED]), "token")
        else:
            here = scratch.write(here.join(heads.select("token"), "token"))
            pairs = here.join(here.select("token", F.col("rep").alias("other"), F.col("n").alias("m"), F.col("at").alias("its"), F.col("component").alias("theirs"), *[F.col(f).alias(f"{f}_") for f in FOLDED]), "token").filter("rep < other")
        apart = sum((F.bit_count(F.col(f).bitwiseXOR(F.col(f"{f}_"))) for f in FOLDED), F.lit(0))
        pairs = pairs.filter(apart * (num + den) <= (den - num) * (F.col("n") + F.col("m")))
        pairs = pairs.filter((F.col("component") != F.col("theirs")) & reaches("n", "at", "m") & reaches("m", "its", "n"))
        pairs = pairs.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()
        close = scratch.write(_close(pairs, parity, num, den))
        found = scratch.write(_similar(close, _sets(texts, close, k), num, den))
        linked = found if linked is None else linked.unionByName(found)
        work, before = Scratch(spark, "jaccard-components"), at
        at = scratch.write(components(linked, work))
        work.clear()
        scratch.drop(close, before)
    scratch.drop(lists)
    for sent in (shared, frequent):
        sent.unpersist()

    whole = signed.select("id", "n", "f1", "f2").join(classes.select("n", "f1", "f2", "rep"), ["n", "f1", "f2"], "left")
    whole = whole.join(at.select(F.col("id").alias("rep"), "component"), "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component", "rep", "id")).otherwise(F.col("id")))
    return whole.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _close(pairs: DataFrame, parity: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose parity sketches allow them to be similar."""

    def compare(batches):
        for batch in batches:
            n, m = (batch.column(i).to_numpy() for i in (2, 3))
            apart = bits_apart(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            keep = pa.array(apart * (num + den) <= (den - num) * (n + m))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    first = parity.select(F.col("id").alias("a"), "n", F.col("parity").alias("mine"))
    second = parity.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("parity").alias("theirs"))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "n", "m", "mine", "theirs")
    return both.mapInArrow(compare, "a long, b long").distinct()


def _sets(texts: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Whole sets (id, shingles as bytes) of the documents in pairs, and of few others: ids are looked up in a bit array."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).select(F.pmod("id", F.lit(ID_BITS)).alias("place"))
    named = texts.sparkSession.sparkContext.broadcast(bit_array(wanted, ID_BITS))

    def sets(batches):
        wanted = (batch.filter(pa.array(has_bit(named.value, batch.column(0).to_numpy() % ID_BITS))) for batch in batches)
        for batch in small_batches(wanted, 1):
            found = shingle_sets(batch.column(1).to_pylist(), k, True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in found], pa.binary())], names=["id", "shingles"])

    return texts.filter("id IS NOT NULL").mapInArrow(sets, "id long, shingles binary")


def _similar(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def compare(batches):
        for batch in batches:
            a, b, mine, theirs = (batch.column(i) for i in range(4))
            keep = []
            for x, y in zip(mine, theirs, strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    with_sets = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("mine")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("theirs")), "b")
    return with_sets.select("a", "b", "mine", "theirs").mapInArrow(compare, "a long, b long").distinct()
