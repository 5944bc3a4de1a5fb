"""A corpus from raw documents: quality, toxicity, near duplicates, leaked benchmark items, packing.

In every stage null and empty texts are texts without words, repeated rows are decided each (of near duplicates one stays), an empty
table gives an empty result, and further columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweir.llm.decontaminate import leak_indexes, without_leaks
from claimweir.llm.jaccard_join import jaccard_join
from claimweir.llm.packing import pack
from claimweir.llm.quality import AT_QUANTILE, quality_score, train_ranking
from claimweir.llm.queries import tokenizer_path
from claimweir.llm.shared import Scratch, table
from claimweir.llm.toxicity import severity, train_severity


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the quantile cut learned from all quality labels."""
    model = train_ranking(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality_score(model, "text") >= AT_QUANTILE)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not found toxic by the model learned from the labels of the documents that came here."""
    model = train_severity(docs, table(spark, sf_dir, "labels"))
    return docs.filter(~severity(model, "text")["toxic"])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at 0.8 or more, the first in the order of the input, whatever their ids: rows that
    repeat an id, and rows without one, are documents of their own. Documents without words are linked with nothing and stay."""
    row = next(name for n in range(len(docs.columns) + 1) if (name := f"row_{n}") not in docs.columns)
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    repeats = jaccard_join(numbered, k=5, num=8, den=10, id_column=row).filter(F.col(row) != F.col("component_id")).select(row)
    return numbered.join(repeats, row, "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, leak_indexes(table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2,048 tokens with the sources' mixture."""
    return pack(docs, tokenizer_path(), window=2048, end_id=1)


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: Models are trained and tokens counted on the way, which SQL does not express; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written before the next one reads it."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
