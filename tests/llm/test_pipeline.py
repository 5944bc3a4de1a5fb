"""The stages of corpus_pipeline.py, each against a plain version of its decision, and all of them in a row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimweir.llm.packing import word_tokens
from claimweir.llm.quality import AT_QUANTILE, quality_score, train_ranking
from claimweir.llm.queries import tokenizer_path
from claimweir.llm.shared import table
from claimweir.llm.toxicity import severity, train_severity
from tests.llm.helpers import EDGES, documents, jaccard_groups, shingles

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls, empty and long texts, repeated rows, columns with clashing names."""
    rows = [*EDGES, (None, "one two three four five six", None, None), (None, None, None, None), (9, "one two three four five six seven " * 40, "en", "a"), (9, "one two three four five six seven " * 40, "en", "a")]
    clashes = {c: F.lit("x") for c in ("_row", "row", "id", "score", "toxic", "component_id", "token", "bucket", "rep")}
    return documents(spark, rows).withColumns(clashes)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def without_near_copies(rows):
    """Of (doc_id, text, ...) rows in their order, the first of each class."""
    groups = jaccard_groups([(i, r[1]) for i, r in enumerate(rows)], 5, 8, 10)
    return [r for i, r in enumerate(rows) if groups[i][1] == i]


def without_items(rows, items):
    sets = [shingles(t, 5) for t in items if t]
    return [r for r in rows if not any(s and 10 * len(s & shingles(r[1], 5)) >= 8 * len(s) for s in sets)]


def check_packed(pieces, rows):
    """Every token of every row lies in one piece, and sequences are filled from 0 on without a gap."""
    tokens = word_tokens(tokenizer_path())
    width = np.dtype(tokens.kind).itemsize
    sizes = sorted(((str(r[0]), len(d) // width + 1) for r, d in zip(rows, tokens.encode_all([r[1] for r in rows]), strict=True)))
    assert sorted((str(p.doc_id), p.doc_tokens) for p in pieces if p.start == 0) == sizes
    assert sum(p.length for p in pieces) == sum(n for _, n in sizes)
    for number in {p.sequence_id for p in pieces}:
        at = 0
        for p in sorted((p for p in pieces if p.sequence_id == number), key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048


def test_quality_and_toxicity_keep_what_the_models_say(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = train_ranking(docs, labels)
    good = docs.filter(quality_score(model, "text") >= AT_QUANTILE)
    kept = STAGES["quality"](spark, docs, sf)
    assert kept.columns == docs.columns and rows_of(kept) == rows_of(good) and 0 < kept.count() < docs.count()
    harmless = good.filter(~severity(train_severity(good, labels), "text")["toxic"])
    assert rows_of(STAGES["toxicity"](spark, good, sf)) == rows_of(harmless)


def test_near_duplicates_and_decontamination_equal_brute_force(spark, sf, edges):
    items = [r.text for r in table(spark, sf, "benchmark").collect()]
    for docs in (table(spark, sf, "documents").coalesce(1), edges.coalesce(1)):
        rows = [tuple(r) for r in docs.collect()]
        kept = STAGES["near_duplicates"](spark, docs, sf)
        assert kept.columns == docs.columns and rows_of(kept) == sorted(without_near_copies(rows), key=str)
        clean = STAGES["decontamination"](spark, docs, sf)
        assert clean.columns == docs.columns and rows_of(clean) == sorted(without_items(rows, items), key=str)


def test_packing_loses_no_token(spark, sf, edges):
    for docs in (table(spark, sf, "documents"), edges):
        check_packed(STAGES["packing"](spark, docs, sf).collect(), [tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_bear_edges_and_empty_tables(spark, sf, edges, name):
    found = STAGES[name](spark, edges, sf)
    if name != "packing":
        assert found.columns == edges.columns
        assert set(map(str, rows_of(found))) <= set(map(str, rows_of(edges)))
    assert found.count() <= edges.count() + 200
    assert STAGES[name](spark, edges.filter("false"), sf).collect() == []


def test_run_equals_the_stages_by_brute_force(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    good = docs.filter(quality_score(train_ranking(docs, labels), "text") >= AT_QUANTILE)
    harmless = good.filter(~severity(train_severity(good, labels), "text")["toxic"])
    rows = sorted(tuple(r) for r in harmless.select("doc_id", "text").collect())
    left = without_items(without_near_copies(rows), [r.text for r in table(spark, sf, "benchmark").collect()])
    check_packed(corpus_pipeline.run(spark, sf).collect(), left)
