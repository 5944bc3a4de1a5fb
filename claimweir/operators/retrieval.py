"""Nearest chunks for a query, by term weights of the text or by vectors supplied as a column."""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweir import fixed
from claimweir.functions.text import strip
from claimweir.operators.lookup import is_small
from claimweir.sources.staging import stage

#: Queries that may go to every task at once.
QUERY_BLOCK = 1_000
#: Bytes of vectors that a block holds, as double precision numbers; cells of a product of two blocks worked out at a time.
BLOCK_BYTES = 32 << 20
PRODUCT_CELLS = 4 << 20
_WEIGHT = "decimal(16,6)"
#: Words of a corpus whose rarity may go to every task; some 30 bytes each.
SMALL_WORDS = 1_000_000
#: Most telling tokens of a query by which its first chunks are found, and so many times k chunks.
SEEDS = 3
#: A query of more distinct tokens is scored against all chunks that share one with it: with so many, bounds leave few chunks out.
LONG_QUERY = 12


@dataclass(frozen=True)
class Query:
    name: str
    text: str
    section: int | None = None


@dataclass(frozen=True)
class VectorQuery:
    name: str
    vector: Sequence[float]
    section: int | None = None


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda token: token != "")


def similarity(distance: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.lit(1.0) - distance), 4)


def _best(scored: DataFrame, identifier: str, top_k: int) -> DataFrame:
    """Ranks 1..k per query. Each task trims its share to k before anything is shuffled."""
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), F.asc(identifier))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


# --- term weights ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TermIndex:
    """Chunks with their term weights. Weights are decimals, so sums of them do not depend on the order of rows.

    `terms` are the postings: weights by token, and their impact, the weight over the chunk's length. They are stored by token,
    greatest impact first. `words` has each token's rarity and greatest impact, `bags` the tokens of each chunk side by side.
    """

    chunks: DataFrame
    terms: DataFrame
    words: DataFrame
    norms: DataFrame
    bags: DataFrame


def term_counts(chunks: DataFrame) -> DataFrame:
    words = chunks.select(
        "chunk_id",
        F.col("metadata.section_number").alias("section_number"),
        F.explode_outer(tokens(F.col("text"))).alias("token"),
    ).filter(F.col("token").isNotNull())
    return words.groupBy("chunk_id", "section_number", "token").agg(
        F.count(F.lit(1)).alias("times")
    )


def term_rarity(counts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Smoothed inverse document frequency: ln((1 + chunks) / (1 + chunks with the token)) + 1."""
    all_chunks = chunks.select(F.count(F.lit(1))).scalar()
    with_token = F.count(F.lit(1)).alias("chunks_with_token")
    value = F.log((all_chunks + 1).cast("double") / (F.col("chunks_with_token") + 1)) + 1
    return (
        counts.groupBy("token")
        .agg(with_token)
        .select("token", F.round(value, 6).cast("decimal(12,6)").alias("rarity"), "chunks_with_token")
    )


def term_bags(chunks: DataFrame) -> DataFrame:
    """Chunks with the tokens of each and how often it has them, counted inside the row: a sorted array has equal tokens side by side."""
    named = chunks.select("chunk_id", F.col("metadata.section_number").alias("section_number"), "text")
    if not named.groupBy("chunk_id", "section_number").count().filter("count > 1").isEmpty():
        texts = F.array_join(F.array_sort(F.collect_list("text")), " ")
        named = named.groupBy("chunk_id", "section_number").agg(texts.alias("text"))
    # no filter on the words, which would split every text twice
    words = named.select("chunk_id", "section_number", F.sort_array(F.coalesce(tokens(F.col("text")), F.array().cast("array<string>"))).alias("words"))
    places = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1)).otherwise(F.array().cast("array<int>"))
    first = F.filter(places, lambda i: (i == 0) | (F.get("words", i) != F.get("words", i - 1)))
    counted = words.withColumn("first", first)
    one = lambda i, at: F.struct(
        F.get("words", i).alias("token"), (F.coalesce(F.get("first", at + 1), F.size("words")) - i).cast("long").alias("times")
    )
    return counted.select("chunk_id", "section_number", F.transform("first", one).alias("bag"))


def _common_words(rarity: DataFrame, postings: int, small_rows: int) -> tuple[DataFrame, DataFrame]:
    """Words in so many chunks that they all may go to every task, and the others: each of these has few postings."""
    if not small_rows:
        return rarity.filter("false"), rarity
    least = 1
    while not is_small(rarity.filter(F.col("chunks_with_token") >= least), small_rows):
        # no more words than postings / least are in `least` chunks
        least = 2 if least == 1 else min(2 * least, postings + 1)
    common = F.col("chunks_with_token") >= least
    return rarity.filter(common), rarity.filter(~common)


@dataclass(frozen=True)
class _Weighed:
    """What the weights of a corpus follow from: bags of tokens, rarity of all words, that of common ones, postings of the others, lengths."""

    bags: DataFrame
    rarity: DataFrame
    common: DataFrame
    rare: DataFrame
    norms: DataFrame


def _terms_of(bags: DataFrame, *columns: str) -> DataFrame:
    return bags.select("chunk_id", "section_number", *columns, F.explode("bag").alias("term")).select("chunk_id", "section_number", *columns, "term.*")


def _weight() -> Column:
    return (F.col("times") * F.col("rarity")).cast(_WEIGHT)


def _weighed(chunks: DataFrame, small_rows: int) -> _Weighed:
    bags = stage(term_bags(chunks), "term_bags")
    counts = _terms_of(bags)
    rarity = stage(term_rarity(counts, chunks), "term_rarity")
    postings = rarity.agg(F.sum("chunks_with_token")).first()[0] or 0
    common, others = (stage(words, "common_words") for words in _common_words(rarity, postings, small_rows))
    frequent = counts.join(F.broadcast(common), "token").withColumn("weight", _weight())
    rare = counts.join(F.broadcast(common.select("token")), "token", "left_anti").join(others, "token")
    rare = rare.withColumn("weight", _weight()).select("chunk_id", "section_number", "token", "weight", "chunks_with_token")
    rare = stage(rare, "rare_terms")
    squares = F.sum(F.col("weight") * F.col("weight")).cast("decimal(38,12)")
    all_weights = frequent.select("chunk_id", "weight").unionAll(rare.select("chunk_id", "weight"))
    norms = stage(all_weights.groupBy("chunk_id").agg(squares.alias("square")), "chunk_lengths")
    return _Weighed(bags, rarity, common, rare, norms)


def build_index(chunks: DataFrame, small_rows: int = SMALL_WORDS, file_rows: int = 1_000_000) -> TermIndex:
    """Weights and lengths of all chunks, written once so that searches only read them.

    Tokens are counted inside their chunk. The rarity of words that are in many chunks goes to every task, so only postings of rare
    words are shuffled to find theirs, and a chunk's other squares are added up where it lies. Lengths are joined to whole chunks.
    What is shuffled as postings is the result, dealt out by token, those of a frequent token over as many tasks as it has file_rows.
    """
    made = _weighed(chunks, small_rows)
    measured = _terms_of(made.bags.join(made.norms, "chunk_id"), "square")
    measured = measured.join(F.broadcast(made.common), "token").withColumn("weight", _weight())
    columns = ["chunk_id", "section_number", "token", "weight", "square", "chunks_with_token"]
    impact = F.col("weight").cast("double") / F.sqrt(F.col("square").cast("double"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("chunks_with_token") / file_rows))
    terms = measured.select(columns).unionAll(made.rare.join(made.norms, "chunk_id").select(columns)).select(
        "chunk_id", "section_number", "token", "weight", impact.alias("impact"), F.pmod(F.xxhash64("chunk_id"), parts).alias("part")
    )
    terms = terms.repartition("token", "part").sortWithinPartitions("token", F.desc("impact")).drop("part")
    terms = stage(terms, "term_weights")
    most = terms.groupBy("token").agg(F.max("impact").alias("most"))
    words = stage(made.rarity.join(most, "token").select("token", "rarity", "most"), "words")
    return TermIndex(chunks, terms, words, made.norms, made.bags)


# Bounds are compared with this much to spare, so that rounding never drops a chunk that ties.
_SPARE = 1e-9


def _asked(queries: DataFrame, words: DataFrame) -> DataFrame:
    """Tokens of queries that the corpus has, with all columns of `words`: weight, and the square of the query's length."""
    asked = queries.select("query", F.col("section").alias("wanted"), F.explode(tokens(F.col("text"))).alias("token"))
    counted = asked.groupBy("query", "wanted", "token").agg(F.count(F.lit(1)).alias("times"))
    known = words.join(stage(counted, "query_tokens"), "token").withColumn("query_weight", _weight()).drop("times")
    square = F.sum(F.col("query_weight") * F.col("query_weight")).over(Window.partitionBy("query")).cast("double")
    return known.withColumn("query_square", square)


def _query_weights(queries: DataFrame, words: DataFrame) -> DataFrame:
    """Tokens of queries: weight, share of the query's length, and the most that a chunk can gain by the token (`most`).

    `below` is what a chunk can gain by the token and all less telling ones together, `all` by all tokens.
    """
    own = Window.partitionBy("query")
    telling = own.orderBy("most", "token")
    share = F.col("query_weight").cast("double") / F.sqrt("query_square")
    known = _asked(queries, words).withColumn("share", share).withColumn("most", F.col("share") * F.col("most"))
    return known.withColumns(
        {
            "below": F.sum("most").over(telling.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "all": F.sum("most").over(own),
            "asked": F.count(F.lit(1)).over(own),
            "place": F.row_number().over(own.orderBy(F.desc("most"), F.desc("token"))),
        }
    )


def _cosines(pairs: DataFrame, weights: DataFrame, index: TermIndex) -> DataFrame:
    """The exact cosine of pairs (query, chunk_id), from the postings of the queries' tokens.

    Few pairs go to every task with their tokens, so that no posting is shuffled.
    """
    asked = stage(pairs, "pairs").join(weights.select("query", "token", "query_weight", "query_square"), "query")
    small = F.broadcast(asked) if is_small(asked) else asked
    return _products(index.terms.select("chunk_id", "token", "weight").join(small, ["chunk_id", "token"]), index.norms)


def _products(postings: DataFrame, norms: DataFrame) -> DataFrame:
    return (
        postings.groupBy("query", "chunk_id", "query_square")
        .agg(F.sum(F.col("weight") * F.col("query_weight")).cast("double").alias("product"))
        .join(norms, "chunk_id")
        .select("query", "chunk_id", (F.col("product") / F.sqrt(F.col("query_square") * F.col("square").cast("double"))).alias("cosine"))
    )


def _scored(index: TermIndex, weights: DataFrame, top_k: int) -> DataFrame:
    """Cosines of all chunks that can be among the k nearest: of few candidates for short queries, in one pass for long ones."""
    short, long = weights.filter(F.col("asked") <= LONG_QUERY), weights.filter(F.col("asked") > LONG_QUERY)
    if long.isEmpty():
        return _cosines(candidates(index, weights, top_k), weights, index)
    if is_small(long) and long.select("query").distinct().count() <= QUERY_BLOCK:
        scored = _cosines(nearest_bags(index, long, top_k), long, index)
    else:
        scored = _products(_postings(index, long), index.norms)
    return scored if short.isEmpty() else scored.unionByName(_cosines(candidates(index, short, top_k), short, index))


def nearest_bags(index: TermIndex, weights: DataFrame, top_k: int) -> DataFrame:
    """Pairs (query, chunk_id) among which the k nearest chunks of every query are, and few others, of queries that fit into a task.

    Every chunk is scored against every query where its tokens lie, in double precision, so that neither postings nor scores are
    shuffled: of each batch of chunks only those leave the task that reach its k-th score with some to spare.
    """
    rows = weights.select("query", "wanted", "token", "query_weight", "query_square", "rarity").collect()
    names = sorted({r["query"] for r in rows})
    words = sorted({r["token"] for r in rows})
    query_at, word_at = ({name: at for at, name in enumerate(of)} for of in (names, words))
    wanted = {r["query"]: r["wanted"] for r in rows}
    sections = [wanted[name] for name in names]
    # a word's rarity and a query's length go into the matrix, so that a product needs only counts and lengths of chunks
    matrix = np.zeros((len(words), len(names)))
    for r in rows:
        matrix[word_at[r["token"]], query_at[r["query"]]] = float(r["query_weight"]) * float(r["rarity"]) / np.sqrt(r["query_square"])

    def best_of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, section, bags, squares = batch.columns
        section = section.to_pandas().to_numpy()
        terms = bags.flatten()
        code = pc.index_in(terms.field(0), value_set=pa.array(words, pa.string()))
        row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(bags), 0).to_numpy(zero_copy_only=False))
        known = code.is_valid().to_numpy(zero_copy_only=False)
        row, code = row[known], code.drop_null().to_numpy().astype("int64")
        times = terms.field(1).to_numpy(zero_copy_only=False)[known].astype("float64")
        counts = np.zeros((batch.num_rows, len(words)))
        counts[row, code] = times  # a bag names a token once
        scores = counts @ matrix
        scores /= np.sqrt(squares.to_numpy(zero_copy_only=False))[:, None]
        found = []
        for at, only in enumerate(sections):
            score = scores[:, at] if only is None else np.where(section == only, scores[:, at], 0.0)
            hit = np.flatnonzero(score > 0)
            if len(hit) > top_k:
                hit = hit[score[hit] >= np.partition(score[hit], -top_k)[-top_k] - _SPARE]
            found.append((np.full(len(hit), at), hit, score[hit]))
        query, hit, score = (np.concatenate(x) for x in zip(*found, strict=True))
        asked = pa.array(names, pa.string()).take(pa.array(query))
        return pa.RecordBatch.from_arrays([asked, ids.take(pa.array(hit)), pa.array(score)], names=["query", "chunk_id", "score"])

    step = max(1, PRODUCT_CELLS // max(1, len(words), len(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                yield best_of_batch(batch.slice(low, step))

    measured = index.bags.join(index.norms, "chunk_id").select("chunk_id", "section_number", "bag", F.col("square").cast("double").alias("square"))
    found = stage(measured.mapInArrow(run, "query string, chunk_id string, score double"), "near_chunks")
    order = Window.partitionBy("query").orderBy(F.desc("score"))
    floor = found.withColumn("at", F.row_number().over(order)).filter(F.col("at") == top_k).select("query", (F.col("score") - _SPARE).alias("floor"))
    reached = found.join(F.broadcast(floor), "query", "left")
    return reached.filter(F.col("score") >= F.coalesce("floor", F.lit(0.0))).select("query", "chunk_id").distinct()


def _postings(index: TermIndex, weights: DataFrame) -> DataFrame:
    """Postings of the queries' tokens in the section that the query wants."""
    wanted = F.col("wanted").isNull() | (F.col("wanted") == F.col("section_number"))
    return index.terms.join(weights, "token").filter(wanted).withColumn("gain", F.col("share") * F.col("impact"))


def candidates(index: TermIndex, weights: DataFrame, top_k: int) -> DataFrame:
    """Pairs (query, chunk_id) among which the k nearest chunks of every query are, and few others.

    First the chunks where the query's most telling tokens weigh most are scored; the k-th of them is a floor that the k nearest
    reach. Tokens by which a chunk cannot reach it, all of them together, are not read: they are the frequent ones. A posting
    of another token is dropped when all other tokens at their greatest impact could not lift its chunk to the floor, and a chunk is
    when what it gains by the tokens read and could gain by the others does not reach it.
    """
    seeds = _postings(index, weights.filter(F.col("place") <= SEEDS))
    order = Window.partitionBy("query").orderBy(F.desc("gain"), "chunk_id")
    seeds = seeds.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= SEEDS * top_k)
    scored = _cosines(seeds.select("query", "chunk_id").distinct(), weights, index)
    order = Window.partitionBy("query").orderBy(F.desc("cosine"))
    floor = scored.withColumn("at", F.row_number().over(order)).filter(F.col("at") == top_k)
    floor = stage(floor.select("query", (F.col("cosine") - _SPARE).alias("floor")), "floors")
    bounded = weights.join(floor, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    essential = F.col("below") >= F.col("floor")
    unread = F.sum(F.when(~essential, F.col("most")).otherwise(0.0)).over(Window.partitionBy("query"))
    read = bounded.withColumn("unread", unread).filter(essential)
    postings = _postings(index, read).filter(F.col("gain") + F.col("all") - F.col("most") >= F.col("floor"))
    gained = postings.groupBy("query", "chunk_id", "floor", "unread").agg(F.sum("gain").alias("gained"))
    return gained.filter(F.col("gained") + F.col("unread") >= F.col("floor")).select("query", "chunk_id")


def search(
    index: TermIndex, queries: DataFrame | Sequence[Query], top_k: int = 3, cutoff: float | None = None
) -> DataFrame:
    """The k nearest chunks of every query among those that share a term with it.

    Queries are a table (query, text, section), one row per query, or a list. All of them are answered in one go; which side of a
    join is sent to all tasks follows from the sizes of the written tables.
    """
    queries = _table(queries, index.chunks)
    weights = stage(_query_weights(queries, index.words), "query_weights")
    return _hits(index.chunks, _scored(index, weights, top_k), top_k, cutoff)


def search_once(chunks: DataFrame, queries: DataFrame | Sequence[Query], top_k: int = 3, cutoff: float | None = None, small_rows: int = SMALL_WORDS) -> DataFrame:
    """What `search` gives, for few queries on chunks that are not searched again.

    Every chunk is scored where its tokens lie, so that no postings are shuffled or written: what is shuffled is one number for a
    query and a chunk that share a term, and what the lengths of chunks take. The work is queries times chunks; for many queries build an index.
    """
    made = _weighed(chunks, small_rows)
    weights = stage(_asked(_table(queries, chunks), made.rarity.select("token", "rarity")), "query_weights")
    wanted = F.col("wanted").isNull() | (F.col("wanted") == F.col("section_number"))
    postings = _terms_of(made.bags).join(F.broadcast(weights), "token").filter(wanted).withColumn("weight", _weight())
    return _hits(chunks, _products(postings, made.norms), top_k, cutoff)


def _table(queries: DataFrame | Sequence[Query], chunks: DataFrame) -> DataFrame:
    if isinstance(queries, DataFrame):
        return queries
    rows = [(q.name, q.text, q.section) for q in queries]
    return chunks.sparkSession.createDataFrame(rows, "query string, text string, section long")


def _hits(chunks: DataFrame, scored: DataFrame, top_k: int, cutoff: float | None) -> DataFrame:
    best = stage(_best(scored, "chunk_id", top_k), "hits")
    distance = F.lit(1.0) - F.col("cosine")
    hits = chunks.join(best, "chunk_id").select(
        "query",
        "rank",
        "chunk_id",
        "text",
        "metadata",
        distance.alias("distance"),
        similarity(distance).alias("similarity_score"),
    )
    return hits if cutoff is None else hits.filter(F.col("similarity_score") >= cutoff)


# --- vectors --------------------------------------------------------------------------------------------------------


def cosine_scores(
    vectors: DataFrame, queries: Sequence[VectorQuery], top_k: int, identifier: str
) -> DataFrame:
    """Candidates (query, identifier, cosine): the k best of every batch, one matrix product per batch.

    Cosines are rounded to ten places so that the last bits of a sum cannot decide between equal vectors.
    """
    size = len(queries[0].vector)
    names = [q.name for q in queries]
    sections = [q.section for q in queries]
    matrix = np.array([q.vector for q in queries], dtype="float64")
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    kind = vectors.schema[identifier].dataType.simpleString()

    def best_of_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, section, stacked = batch.columns
        rows = stacked.flatten().to_numpy(zero_copy_only=False).astype("float64")
        rows = rows.reshape(-1, size)
        lengths = np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
        cosines = np.round((rows / lengths) @ matrix.T, 10)
        # A vector with a component that is no finite number is no hit; NaN would spoil the order of all others.
        cosines[~np.isfinite(rows).all(axis=1)] = -np.inf
        section = section.to_numpy(zero_copy_only=False)
        for at, name in enumerate(names):
            inside = np.flatnonzero(section == sections[at]) if sections[at] is not None else None
            column = cosines[:, at] if inside is None else cosines[inside, at]
            if len(column) == 0:
                continue
            if len(column) > top_k:
                near = np.flatnonzero(column >= np.partition(column, -top_k)[-top_k])
            else:
                near = np.arange(len(column))
            near = near[np.isfinite(column[near])]
            chosen = pa.table(
                {
                    identifier: ids.take(pa.array(near if inside is None else inside[near])),
                    "cosine": pa.array(column[near]),
                }
            )
            first = pc.sort_indices(
                chosen, sort_keys=[("cosine", "descending"), (identifier, "ascending")]
            )[:top_k]
            chosen = chosen.take(first).combine_chunks()
            if chosen.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * chosen.num_rows),
                        chosen[identifier].combine_chunks(),
                        chosen["cosine"].combine_chunks(),
                    ],
                    names=["query", identifier, "cosine"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from best_of_batch(batch)

    usable = vectors.filter(F.size("embedding") == size).select(
        identifier, "section_number", "embedding"
    )
    return usable.mapInArrow(run, f"query string, {identifier} {kind}, cosine double")


def unusable_vectors(vectors: DataFrame, size: int, identifier: str = "chunk_id") -> DataFrame:
    """Vectors that no query of this length can find, and why."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    reason = (
        F.when(F.col("embedding").isNull(), "no vector")
        .when(F.size("embedding") != size, F.concat(F.size("embedding").cast("string"), F.lit(f" components, not {size}")))
        .when(odd, "a component is no finite number")
    )
    return vectors.select(identifier, reason.alias("reason")).filter(F.col("reason").isNotNull())


def _ranked(order: np.ndarray, cosines: np.ndarray, top_k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k greatest finite cosines of each row; of equal ones those whose column comes first in `order`."""
    k = min(top_k, cosines.shape[1])
    least = np.partition(cosines, -k, axis=1)[:, -k] if k else np.empty(0)
    row, column = np.nonzero((cosines >= least[:, None]) & np.isfinite(cosines)) if k else (np.empty(0, int),) * 2
    first = np.lexsort((order[column], -cosines[row, column], row))
    row, column = row[first], column[first]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < top_k], column[place < top_k]


def block_scores(vectors: DataFrame, queries: DataFrame, top_k: int, identifier: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Candidates (query, identifier, cosine) of a table of queries (query, vector, section): the k best of every block of vectors.

    Vectors and queries are cut into blocks of about block_bytes by hashes of their names. Each block of queries meets each block
    of vectors of its length in one task, as rows of a cogroup, so neither side passes the driver or has to fit into one task. What is
    shuffled is either table once for each block of the other, which is why blocks are as large as a task holds easily.
    """
    size = F.size("vector").cast("long")
    asked = queries.select("query", "section", "vector").withColumn("_size", size).filter("_size > 0")
    known = vectors.select(identifier, "section_number", F.col("embedding").alias("vector")).withColumn("_size", size).filter("_size > 0")
    amounts = [frame.agg(F.sum(F.col("_size") * 8)).first()[0] or 0 for frame in (asked, known)]
    query_blocks, vector_blocks = (max(1, -(-amount // block_bytes)) for amount in amounts)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    number = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    asked = asked.withColumn("_q", number("query", query_blocks)).withColumn("_v", every(vector_blocks))
    known = known.withColumn("_v", number(identifier, vector_blocks)).withColumn("_q", every(query_blocks))
    kinds = [vectors.schema[identifier].dataType.simpleString(), queries.schema["query"].dataType.simpleString()]

    def nearest(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        parts = []
        if mine.num_rows and theirs.num_rows:
            wanted, rows = (_unit_rows(t.column("vector"), key[0].as_py()) for t in (mine, theirs))
            ids, sections = theirs.column(identifier), theirs.column("section_number").to_numpy()
            order = np.empty(len(rows), np.int64)
            order[pc.sort_indices(ids).to_numpy()] = np.arange(len(rows))
            asked_sections = mine.column("section").to_pandas().to_numpy()
            odd = ~np.isfinite(rows).all(axis=1)
            step = max(1, PRODUCT_CELLS // len(rows))
            for low in range(0, len(wanted), step):
                cosines = np.round(wanted[low : low + step] @ rows.T, 10)
                cosines[:, odd] = -np.inf
                section = asked_sections[low : low + step]
                limited = ~pd.isna(section)
                cosines[limited] = np.where(section[limited][:, None] == sections[None, :], cosines[limited], -np.inf)
                row, column = _ranked(order, cosines, top_k)
                parts.append(pa.table([mine.column("query").take(pa.array(row + low)), ids.take(pa.array(column)), pa.array(cosines[row, column])], names=["query", identifier, "cosine"]))
        return pa.concat_tables(parts) if parts else pa.table([mine.column("query").slice(0, 0), theirs.column(identifier).slice(0, 0), pa.array([], pa.float64())], names=["query", identifier, "cosine"])

    place = ["_size", "_q", "_v"]
    schema = f"query {kinds[1]}, {identifier} {kinds[0]}, cosine double"
    return asked.groupBy(*place).cogroup(known.groupBy(*place)).applyInArrow(nearest, schema)


def _unit_rows(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """Vectors of one length as rows of length 1; those with a component that is no finite number keep one that is none."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("float64")
    rows = flat.reshape(-1, size)
    with np.errstate(invalid="ignore"):
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def search_vectors(
    vectors: DataFrame,
    queries: DataFrame | Sequence[VectorQuery],
    top_k: int = 3,
    identifier: str = "chunk_id",
    cutoff: float | None = None,
    few: int = QUERY_BLOCK,
) -> DataFrame:
    """The k nearest of vectors (identifier, section_number, embedding) for every query.

    Queries are a table (query, vector, section) or a list; their number is not limited. Up to `few` of them, counted before, go to
    every task as one matrix; beyond that blocks of them meet blocks of vectors, see block_scores. A query finds vectors of its
    own length only. What cannot be found at all is in unusable_vectors.
    """
    if not isinstance(queries, DataFrame):
        if 0 < len(queries) <= few and len({len(q.vector) for q in queries}) == 1:
            scored = cosine_scores(vectors, list(queries), top_k, identifier)
        else:
            rows = [(q.name, [float(x) for x in q.vector], q.section) for q in queries]
            table = vectors.sparkSession.createDataFrame(rows, "query string, vector array<double>, section long")
            scored = block_scores(vectors, table, top_k, identifier)
    else:
        asked = queries.select("query", "vector", "section").filter(F.size("vector") > 0)
        rows = asked.limit(few + 1).collect() if few else []
        lengths = {len(row["vector"]) for row in rows}
        if 0 < len(rows) <= few and len(lengths) == 1:
            scored = cosine_scores(vectors, [VectorQuery(*row) for row in sorted(rows, key=lambda row: str(row["query"]))], top_k, identifier)
        else:
            scored = block_scores(vectors, asked, top_k, identifier)
    distance = F.lit(1.0) - F.col("cosine")
    hits = _best(scored, identifier, top_k).select(
        "query",
        "rank",
        identifier,
        distance.alias("distance"),
        similarity(distance).alias("similarity_score"),
    )
    return hits if cutoff is None else hits.filter(F.col("similarity_score") >= cutoff)


# --- citations ------------------------------------------------------------------------------------------------------


def area_queries() -> list[Query]:
    return [Query(area, text, section) for area, section, text, *_ in fixed.AUDIT_AREAS]


def citations(hits: DataFrame) -> DataFrame:
    """One row per audit area: heading, excerpt and similarity of its best hit, or the fixed wording without one."""
    spark = hits.sparkSession
    areas = spark.createDataFrame(
        [(area, heading, excerpt) for area, _, _, heading, excerpt, _ in fixed.AUDIT_AREAS],
        "area string, heading string, fallback string",
    )
    excerpt = strip(F.replace(F.substring("text", 1, 220), F.lit("\n"), F.lit(" ")))
    found = hits.filter(F.col("rank") == 1).select(
        F.col("query").alias("area"),
        F.col("metadata.section").alias("section"),
        excerpt.alias("excerpt"),
        "similarity_score",
    )
    # Four areas, one hit each.
    return areas.join(F.broadcast(found), "area", "left").select(
        "area",
        F.coalesce("section", "heading").alias("regulatory_section"),
        F.coalesce("excerpt", "fallback").alias("excerpt"),
        F.coalesce("similarity_score", F.lit(0.0)).alias("similarity_score"),
    )
