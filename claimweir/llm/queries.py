"""The operators over whole tables of a folder, as registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweir.llm.align import align_tokens
from claimweir.llm.decontaminate import find_leaks, leak_indexes
from claimweir.llm.jaccard_join import jaccard_join
from claimweir.llm.kd_shards import kd_shards
from claimweir.llm.langid import detect_language, learn_profiles
from claimweir.llm.lm import score_texts
from claimweir.llm.neardup import near_duplicates
from claimweir.llm.packing import pack
from claimweir.llm.pages import page_text
from claimweir.llm.pii import KINDS, find_personal_data, train_recogniser
from claimweir.llm.quality import AT_QUANTILE, quality_score, train_ranking
from claimweir.llm.runs import periodic_runs
from claimweir.llm.shared import fold, table
from claimweir.llm.toxicity import severity, train_severity


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with their links of cosine 0.98 or more to vectors of the same label."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels are learned from documents whose fold of 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    model = train_ranking(docs, table(spark, sf_dir, "labels").filter(fold("doc_id", 4) != 2))
    scored = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), quality_score(model, "text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= AT_QUANTILE).cast("int"))


#: The tokenizer file of op3_packing and of the pipeline.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 tokens, every sequence with the sources' mixture of the corpus."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), window=2048, end_id=1)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity (0 to 2), likeliest grade and verdict of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = train_severity(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", severity(model, "text").alias("s")).select(
        "doc_id", F.col("s.expected").alias("expected_severity"), F.col("s.grade").alias("grade"), F.col("s.chance").alias("toxic_chance"), F.col("s.toxic").alias("toxic")
    )


def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return page_text(table(spark, sf_dir, "pages"))


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of nearly equal bytes."""
    sharded = kd_shards(table(spark, sf_dir, "documents"), shards=8)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of all documents, learned from documents whose fold of 7 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 7) == 2).alias("held_out"))
    return score_texts(docs, docs.filter("NOT held_out"), keep=("held_out",))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents; profiles are learned from documents whose fold of 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    model = learn_profiles(docs.filter(fold("doc_id", 3) != 1))
    found = docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), detect_language(model, "text").alias("f"))
    return found.select("doc_id", "held_out", F.col("f.lang").alias("lang_pred"), F.col("f.score").alias("score"))


def op9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item of which it holds 80 % of the 5-word shingles or more."""
    return find_leaks(table(spark, sf_dir, "documents"), leak_indexes(table(spark, sf_dir, "benchmark")))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the class of texts linked by 4-word shingles at a similarity of 0.85 or more."""
    return jaccard_join(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by two tokenizers, with how often the corpus links their pairs of ids."""
    import public_tokenizers

    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    found = align_tokens(table(spark, sf_dir, "documents"), *paths)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def _repeating(doc_id: Column, text: Column) -> Column:
    """The text of op12: of a tenth of the documents, all words from one on are replaced by a repetition of the first few of them."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = F.floor((n - a) / (F.lit(3) + g % 8)) + 1
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    # an array of one element binds the words, so that they are split once
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.transform(F.array(words), repeated)[0]).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of all documents, a tenth of which are made to repeat."""
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", _repeating(F.col("doc_id"), F.col("text")).alias("text")))
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("less"))))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.before")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.less")).alias("period"),
        F.expr("best.length * 1000 div -best.less").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of all documents, by a model learned from their plain forms."""
    docs = table(spark, sf_dir, "documents")
    found = find_personal_data(docs, train_recogniser(docs))
    base = F.filter("spans", lambda s: s["chance"].isNull())
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    counts = [(F.size(base) - F.size(F.array_remove(F.transform(base, lambda s: s["kind"]), k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_page_text": op5_page_text,
    "op6_kd_shards": op6_kd_shards,
    "op7_backoff_lm": op7_backoff_lm,
    "op8_language": op8_language,
    "op9_leaks": op9_leaks,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_token_alignment": op11_token_alignment,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_personal_data": op13_personal_data,
}
ORACLES: dict[str, str] = {}
