import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweir.llm import lm
from claimweir.llm.langid import UNKNOWN, count_grams, detect_language, gram_vectors, learn_profiles
from claimweir.llm.quality import AT_QUANTILE, fit_ranking, quality_score, text_features, train_ranking
from claimweir.llm.queries import op2_quality, op4_toxicity, op8_language
from claimweir.llm.shared import table
from claimweir.llm.toxicity import features_of, fit_severity, severity, train_severity
from tests.llm.helpers import EDGES, documents


@pytest.fixture(scope="module")
def small():
    return "/root/testdata/sf0.01"


def test_quality_of_held_out_documents(spark, small):
    found = op2_quality(spark, small).join(table(spark, small, "labels"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in found]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)


def test_quality_of_edges(spark, small):
    docs = documents(spark, EDGES)
    model = train_ranking(table(spark, small, "documents"), table(spark, small, "labels"))
    found = docs.select("doc_id", "text", quality_score(model, "text").alias("score")).collect()
    assert all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if not (r.text or "").strip()}) == 1
    assert not text_features(None).any()
    labels = spark.createDataFrame([(4, 1), (5, None), (None, 0), (99, 0)], "doc_id long, quality int")
    unknown = train_ranking(docs, labels)
    assert all(r[0] == pytest.approx(AT_QUANTILE) for r in docs.select(quality_score(unknown, "text")).collect())
    assert docs.filter("false").select(quality_score(unknown, "text")).collect() == []


def test_ranking_orders_pairs_and_keeps_its_quantile():
    draw = np.random.default_rng(1)
    good, bad = draw.normal(1, 1, (900, 3)), draw.normal(-3, 1, (100, 3))
    model = fit_ranking(good, bad)
    scores = model.probability(np.vstack([good, bad]))
    assert (scores < AT_QUANTILE).sum() == 100
    assert (scores[:900] >= AT_QUANTILE).mean() > 0.99
    assert (fit_ranking(good, bad).weights == model.weights).all()


def test_ranking_learns_from_all_pairs():
    draw = np.random.default_rng(2)
    good, bad = draw.normal(0.5, 1, (400, 3)), draw.normal(-0.5, 1, (300, 3))
    model = fit_ranking(good, bad)
    a, b = (np.clip((x - model.mean) / model.scale, -6, 6) for x in (good, bad))
    d = (a[:, None, :] - b[None, :, :]).reshape(-1, 3)
    gradient = 1e-3 * model.weights - d.T @ (1 / (1 + np.exp(d @ model.weights))) / len(d)
    assert np.abs(gradient).max() < 1e-4


def test_every_labelled_document_counts_for_the_ranking(spark):
    ids = spark.range(20_400).withColumnRenamed("id", "doc_id")
    late = [r.doc_id for r in ids.orderBy(F.xxhash64("doc_id")).collect()[20_000:]]  # only these are bad
    docs = ids.withColumn("text", F.when(F.col("doc_id").isin(late), "GET $$ ## NOW !! ##").otherwise("Some quiet words of a text."))
    labels = docs.select("doc_id", (~F.col("doc_id").isin(late)).cast("int").alias("quality"))
    below = docs.filter(quality_score(train_ranking(docs, labels), "text") < AT_QUANTILE)
    assert {r.doc_id for r in below.collect()} == set(late)


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    model = train_severity(docs, labels.filter(~held))
    found = docs.select("doc_id", severity(model, "text").alias("s")).join(labels.filter(held), "doc_id").collect()
    assert np.mean([r.s.toxic for r in found if r.toxic]) > 0.9
    assert np.mean([r.s.toxic for r in found if not r.toxic]) < 0.02


def test_toxicity_of_edges(spark, small):
    assert op4_toxicity(spark, small).count() == table(spark, small, "documents").count()
    docs = documents(spark, EDGES)
    for labels in ([], [(4, 0), (5, None), (None, 1)], [(4, 1)]):
        model = train_severity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        found = docs.select(severity(model, "text").alias("s")).collect()
        assert len(found) == len(EDGES) and all(0 <= r.s.expected <= 2 for r in found)
    assert features_of("Ab ab Abcdef") == {"ab": 2, "abcdef": 1, "abcd*": 1, "abcde*": 1}
    assert features_of(None) == {}


def test_ordinal_fit_shares_weights_over_ordered_thresholds():
    draw = np.random.default_rng(3)
    x = draw.standard_normal((1500, 4))
    grade = np.digitize(x @ [2.0, -1.0, 0.0, 0.5] + draw.logistic(size=1500), [-0.5, 1.5])
    weights, thresholds = fit_severity(x, grade, np.ones(1500), 3)
    assert np.allclose(weights, [2.0, -1.0, 0.0, 0.5], atol=0.3) and np.allclose(thresholds, [-0.5, 1.5], atol=0.3)
    assert thresholds[0] < thresholds[1]


def test_language_of_held_out_documents(spark, small):
    found = op8_language(spark, small).join(table(spark, small, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) > 0.95
    assert all(0 <= r.score <= 1 for r in found)


def test_language_of_edges(spark, small):
    docs = documents(spark, EDGES)
    model = learn_profiles(table(spark, small, "documents"))
    found = {(r.doc_id, r.f.lang) for r in docs.select("doc_id", detect_language(model, "text").alias("f")).collect()}
    assert {i for i, lang in found if lang == UNKNOWN} == {1, 2, 6, 8}
    nothing = learn_profiles(docs.filter("false"))
    assert {r.f.lang for r in docs.select(detect_language(nothing, "text").alias("f")).collect()} == {UNKNOWN}
    assert learn_profiles(docs).names == ("de", "en", "fr")


def test_grams_are_bound_letters():
    grams, counts = count_grams("Ab, ab!", 3)
    assert counts.sum() == 5 and len(grams) == 3  # " ab" and "ab " twice, "b a" once
    a, b = gram_vectors(grams, 3, 64), gram_vectors(grams[::-1].copy(), 3, 64)
    assert (a == b[::-1]).all() and set(np.unique(a)) == {-1.0, 1.0}
    assert len(count_grams("7", 3)[0]) == 0 and len(count_grams("x", 3)[0]) == 1


def test_packed_keys_and_counts_come_back_in_less_room_than_their_planes():
    draw = np.random.default_rng(5)
    keys = np.unique(draw.integers(0, 1 << 64, 20_000, np.uint64) >> np.uint64(6))
    counts = draw.geometric(0.6, len(keys))
    for n in (0, 1, 2, len(keys)):
        assert (lm.unpacked(lm.packed(keys[:n])) == keys[:n]).all() and (lm.unpacked_counts(lm.packed_counts(counts[:n])) == counts[:n]).all()
        assert len(lm.unpacked(lm.packed(keys[:n]))) == len(lm.unpacked_counts(lm.packed_counts(counts[:n]))) == n
    # one byte a count is what whole bytes take; keys differ in some 6 bytes
    assert len(lm.packed_counts(counts)) < 0.5 * len(counts) and len(lm.packed(keys)) < 6.2 * len(keys)
