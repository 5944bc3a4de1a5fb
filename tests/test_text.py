import math
import re
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweir.operators import chunking, extract, retrieval
from verification import bindings as b

DOSSIER = """STATUS: FLAGGED ANOMALY
Claim Reference: CLM-IE-2026-0007
Policy Number: [MISSING / NOT PROVIDED]
Filing Date: 2026-02-10
Notice Latency: 12 days (Compliant SLA)
Claimant Name: Ms. Ann Lee
Loss Location: 1 Main Street, Co. Cork
[T12 AB34]
Incident Type: Fire
INCIDENT SYNOPSIS & REGULATORY CLASSIFICATION
First line.
Second line.
ITEMIZED FINANCIAL LOSS ASSESSMENT (EUR)
Category Gross Deductible Net Claim
1 Repairs 1,000.00 100.00 900.00
2 Hire
-50.25 0.00 -50.25
TOTALS Aggregated Claim Liquidation Value 949.75 100.00 849.75
STATUTORY DECLARATION: I certify
this. Claimant / Authorized Representative"""


def extracted(spark, *texts):
    rows = [(f"claim_{i}.v1.txt", t) for i, t in enumerate(texts)]
    return [r.asDict(True) for r in extract.extract_claims(spark.createDataFrame(rows, "file_name string, text string")).collect()]


def test_fields_of_a_dossier(spark):
    claim, empty = extracted(spark, DOSSIER, "nothing here")
    assert claim["claim_id"] == "CLM-IE-2026-0007"
    assert claim["policy_number"] is None and claim["status_banner"] == "FLAGGED ANOMALY"
    assert (claim["filing_date"], claim["incident_date"], claim["days_to_notify"]) == ("2026-02-10", "2026-02-10", 12)
    assert claim["loss_location"] == "1 Main Street, Co. Cork [T12 AB34]" and claim["eircode"] == "T12 AB34"
    assert claim["incident_description"] == "First line.\nSecond line."
    assert (claim["total_loss_amount"], claim["total_deductible"], claim["total_net_claimed"]) == (949.75, 100.0, 849.75)
    assert [(i["category"], i["amount"], i["net_claimed"]) for i in claim["line_items"]] == [
        ("Operational Loss Item 1", 1000.0, 900.0),
        ("Operational Loss Item 2", -50.25, -50.25),
    ]
    assert claim["line_items"][0]["description"] == "Incurred expense during event mitigation for Fire."
    assert claim["statutory_attestation"] == "I certify\nthis."
    assert empty["claim_id"] == "CLM-UNKNOWN-claim_1.v1"
    assert (empty["filing_date"], empty["days_to_notify"], empty["total_net_claimed"]) == ("2026-02-01", 0, 0.0)
    assert empty["dora_classification"] == "Standard Operational Claim (Non-ICT)"
    assert empty["incident_description"] is None and empty["line_items"] == []


def packed(header, body, size):
    """Chunks of a section, worked out one paragraph at a time."""
    groups = [[]]
    used = len(header)
    for paragraph in (p.strip() for p in body.split("\n\n")):
        if not paragraph or paragraph == header:
            continue
        if groups[-1] and used + len(paragraph) > size:
            groups.append([])
            used = len(header)
        groups[-1].append(paragraph)
        used += len(paragraph)
    return ["\n\n".join([header, *group]) for group in groups]


@pytest.mark.parametrize("size", [40, 1000])
def test_packing_against_brute_force(spark, sf, size):
    documents = spark.read.parquet(f"{sf}/documents.parquet").select(F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("body"))
    rows = documents.select("body", chunking.pack_paragraphs(F.lit("SECTION 1: x"), F.col("body"), size).alias("c")).collect()
    for row in rows:
        assert row["c"] == packed("SECTION 1: x", row["body"], size)


def test_sections_of_a_text(spark):
    texts = {
        "a.b.txt": "intro\n\nSECTION 1: One\nbody one\n\nsection  2 :two\nbody two",
        "plain.txt": " no header \n\n at all ",
        "start.txt": "SECTION 3: Three\nx",
    }
    frame = spark.createDataFrame(list(texts.items()), "file_name string, text string")
    got = {r["chunk_id"]: (r["text"], r["metadata"]["section"], r["metadata"]["section_number"]) for r in chunking.chunk_documents(frame).collect()}
    assert got == {
        "a.b_preamble_0": ("intro", "PREAMBLE & JURISDICTION", 0),
        "a.b_sec1_part0": ("SECTION 1: One\n\nbody one", "SECTION 1: One", 1),
        "a.b_sec2_part0": ("section  2 :two\n\nbody two", "section  2 :two", 2),
        "plain_full_0": ("no header \n\n at all", "GENERAL GUIDELINES", 1),
        "start_sec3_part0": ("SECTION 3: Three\n\nx", "SECTION 3: Three", 3),
    }


def test_text_search_against_brute_force(spark, sf):
    chunks = b.chunks(spark, sf)
    rows = chunks.collect()
    words = {r["chunk_id"]: Counter(t for t in re.split(r"[\W_]+", r["text"].lower()) if t) for r in rows}
    section = {r["chunk_id"]: r["metadata"]["section_number"] for r in rows}
    spread = Counter(t for counted in words.values() for t in counted)

    def rarity(token):
        value = math.log((1 + len(words)) / (1 + spread[token])) + 1
        return Decimal(value).quantize(Decimal("0.000001"), ROUND_HALF_UP)

    queries = [retrieval.Query("q1", "what is the for and"), retrieval.Query("q2", "der und die", 3), retrieval.Query("q3", "zzzz")]
    index = retrieval.build_index(chunks)
    index_large = retrieval.build_index(chunks, small_rows=0)
    got = {}
    for at, built in enumerate((index, index_large)):
        hits = retrieval.search(built, queries, top_k=4).collect()
        got[at] = {(h["query"], h["rank"]): (h["chunk_id"], h["similarity_score"]) for h in hits}
    assert got[0] == got[1]
    want = {}
    for query in queries:
        asked = {t: n * rarity(t) for t, n in Counter(query.text.split()).items() if t in spread}
        scores = []
        for chunk, counted in words.items():
            product = sum(weight * counted[t] * rarity(t) for t, weight in asked.items())
            if product and query.section in (None, section[chunk]):
                square = sum((n * rarity(t)) ** 2 for t, n in counted.items())
                length = sum(w * w for w in asked.values())
                scores.append((-float(product) / math.sqrt(float(length) * float(square)), chunk))
        for rank, (score, chunk) in enumerate(sorted(scores)[:4], 1):
            want[query.name, rank] = (chunk, round(-score, 4))
    assert got[0] == want


def test_vector_search_against_brute_force(spark, sf):
    vectors = b.vectors(spark, sf)
    rows = vectors.collect()
    matrix = np.array([r["embedding"] for r in rows], dtype="float64")
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    queries = [retrieval.VectorQuery(f"v{i}", rows[i]["embedding"], rows[i]["section_number"] if i % 2 else None) for i in range(6)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        hits = retrieval.search_vectors(vectors, queries, 7, "vec_id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {(h["query"], h["rank"]): h["vec_id"] for h in hits}
    want = {}
    for query in queries:
        vector = np.array(query.vector, dtype="float64")
        cosines = np.round(matrix @ (vector / np.linalg.norm(vector)), 10)
        order = sorted(
            (-c, r["vec_id"]) for c, r in zip(cosines, rows) if query.section in (None, r["section_number"])
        )
        want.update({(query.name, rank): vec for rank, (_, vec) in enumerate(order[:7], 1)})
    assert got == want


def test_index_equals_plain_counts_with_and_without_small_words(spark):
    """Chunks of one id and section count as one; words that go to every task and others get the same weights."""
    meta = "struct<source_file: string, section: string, section_number: bigint, regulatory_body: string, framework: string>"
    texts = [("a", "Lex lex, rule 7 of rule", 1), ("b", "rule", 1), ("b", "rule Zed", 1), ("b", "of of", 2), ("c", "", 1), ("d", None, 1), ("e", "one Éa rule of", 3)]
    rows = spark.createDataFrame([(i, t, ("f", "s", n, "r", "w")) for i, t, n in texts], f"chunk_id string, text string, metadata {meta}")
    counts = retrieval.term_counts(rows)
    bags = retrieval.term_bags(rows)
    told = bags.select("chunk_id", "section_number", F.explode("bag").alias("t")).select("chunk_id", "section_number", "t.*")
    assert sorted(told.collect()) == sorted(counts.collect())
    expected = {(r.chunk_id, r.section_number, r.token): r.times * r.rarity for r in counts.join(retrieval.term_rarity(counts, rows), "token").collect()}
    for small_rows in (100, 3, 0):
        index = retrieval.build_index(rows, small_rows=small_rows)
        assert {(r.chunk_id, r.section_number, r.token): r.weight for r in index.terms.collect()} == expected
        assert {r.chunk_id for r in index.norms.collect()} == {"a", "b", "e"}
    common, others = retrieval._common_words(retrieval.term_rarity(counts, rows), len(expected), 3)
    assert 0 < common.count() <= 3 and common.count() + others.count() == 7


def test_long_queries_are_scored_in_one_pass_with_the_hits_of_bounded_search(spark, monkeypatch):
    chunks = b.chunks(spark, "/root/testdata/sf0.001").limit(300).localCheckpoint()
    index = retrieval.build_index(chunks)
    texts = [r.text for r in chunks.orderBy("chunk_id").limit(6).collect()]
    asked = [retrieval.Query(f"q{i}", t if i % 2 else " ".join(t.split()[:3]), 2 if i == 3 else None) for i, t in enumerate(texts)]
    read = retrieval.candidates
    sent = []
    monkeypatch.setattr(retrieval, "candidates", lambda index, weights, k: sent.append(weights.agg(F.max("asked")).first()[0]) or read(index, weights, k))
    found = {}
    for limit in (retrieval.LONG_QUERY, 10_000):
        monkeypatch.setattr(retrieval, "LONG_QUERY", limit)
        found[limit] = sorted((r.query, r["rank"], r.chunk_id, r.similarity_score) for r in retrieval.search(index, asked, 3).collect())
    assert len(found[10_000]) > 6 and found[12] == found[10_000] and sent[0] <= 12 < sent[1]


def test_search_of_few_queries_writes_no_postings_and_has_the_hits_of_the_index(spark, sf, monkeypatch):
    chunks = b.chunks(spark, sf).cache()
    queries = [*b.preset_queries(), *b.area_queries()]
    rows = lambda found: sorted(tuple(r) for r in found.select("query", "rank", "chunk_id", "distance", "similarity_score").collect())
    want = rows(retrieval.search(retrieval.build_index(chunks), queries, top_k=3))
    written, stage = [], retrieval.stage
    monkeypatch.setattr(retrieval, "stage", lambda table, name, *a, **k: written.append(name) or stage(table, name, *a, **k))
    for small_rows in (0, 1_000_000):
        assert rows(retrieval.search_once(chunks, queries, 3, small_rows=small_rows)) == want
    b.citations(spark, sf).collect()
    assert written and "term_weights" not in written
    chunks.unpersist()


def test_headings_and_items_with_odd_white_space_are_found_as_by_a_pattern_without_trying_it_at_each_character(spark):
    begin, end = "INCIDENT SYNOPSIS & REGULATORY CLASSIFICATION", "ITEMIZED FINANCIAL LOSS ASSESSMENT"
    texts = [None, "", begin, f"{end} {begin} x", f"é{begin}\n \x1c a\n\nb \x85 {end} {end}", f"{begin}{begin} c{end}", f"{begin} \n{end}", f"{begin}{end}"]
    items = f"{end}\nNet Claim\n1 1,000.00\n100.00\t 900.00  x 5.00 1.00 4.00\nSUBTOTALS 7.00 8.00 9.00 TOTALS"
    frame = spark.createDataFrame([(t,) for t in [*texts, items]], "text string")
    found = frame.select(extract.between(F.col("text"), "incident_description").alias("b"), extract.line_items(F.col("text"), F.lit("x")).alias("i"))
    rows = found.collect()
    assert [r.b for r in rows] == [None, None, None, None, "a\n\nb", f"{begin} c", "", "", None]
    assert [(i.amount, i.deductible, i.net_claimed) for i in rows[-1].i] == [(1000.0, 100.0, 900.0), (5.0, 1.0, 4.0), (7.0, 8.0, 9.0)]
    plan = found.drop("i")._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and r"\s*(.*?)\s*" not in plan
    policy = frame.select(extract.clean_policy(extract.policy_number(F.col("text"))).alias("p"))
    assert policy._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 1


def test_long_queries_score_chunks_without_joining_postings_and_beyond_a_block_by_postings(spark, monkeypatch):
    chunks = b.chunks(spark, "/root/testdata/sf0.001").limit(300).localCheckpoint()
    chunks = chunks.unionAll(chunks.withColumn("chunk_id", F.concat("chunk_id", F.lit("_copy"))))  # every chunk ties with its copy
    index = retrieval.build_index(chunks)
    many = F.size(F.array_distinct(retrieval.tokens(F.col("text")))) > retrieval.LONG_QUERY
    texts = [r.text for r in chunks.filter(many).orderBy("chunk_id").limit(8).collect()]
    asked = [retrieval.Query(f"q{i}", t, 2 if i == 3 else 99 if i == 5 else None) for i, t in enumerate([*texts, "of " * 20])]
    read, joined, found = retrieval._postings, [], {}
    monkeypatch.setattr(retrieval, "_postings", lambda index, weights: joined.append(weights.agg(F.max("asked")).first()[0]) or read(index, weights))
    for block, cells in ((1_000, 4 << 20), (1_000, 5_000), (2, 4 << 20)):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        monkeypatch.setattr(retrieval, "PRODUCT_CELLS", cells)
        joined.clear()
        found[block, cells] = sorted(tuple(r) for r in retrieval.search(index, asked, 3).select("query", "rank", "chunk_id", "distance").collect())
        assert any(most > retrieval.LONG_QUERY for most in joined) == (block == 2)
    assert len(found[2, 4 << 20]) > 15 and len({str(f) for f in found.values()}) == 1
    assert not [r for r in found[2, 4 << 20] if r[0] == "q5"]
