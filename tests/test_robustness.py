"""Batches that follow each other, and single bad values: no claim is lost, no job ends."""

import pytest
from pyspark.sql import functions as F

from claimweir import fixed
from claimweir.operators import audit, chunking, quality, star
from claimweir.operators.extract import create_envelopes, extract_claims
from claimweir.operators.govern import govern, payload_columns
from claimweir.operators.latest import upsert
from claimweir.operators.retrieval import VectorQuery, search_vectors, unusable_vectors
from claimweir.sources import lake
from tests.test_cycle import dossier


def envelopes(spark, texts):
    rows = [(name, f"/in/{name}", text.encode(), text) for name, text in texts.items()]
    return create_envelopes(extract_claims(spark.createDataFrame(rows, "file_name string, file_path string, content binary, text string")))


def stored(spark, path):
    good, bad = lake.read_bronze(spark, path)
    return {r["claim_id"]: r["source_filename"] for r in good.select("extracted_payload.claim_id", "source_filename").collect()}, bad.count()


def test_bronze_keeps_what_a_batch_does_not_name(spark, tmp_path):
    path = str(tmp_path / "bronze")
    lake.write_bronze(envelopes(spark, {}), path)
    assert stored(spark, path) == ({}, 0)
    lake.write_bronze(envelopes(spark, {"a.txt": dossier(1)}), path)
    lake.write_bronze(envelopes(spark, {"b.txt": dossier(2), "c.txt": "no dossier at all"}), path)
    lake.write_bronze(envelopes(spark, {"a_fixed.txt": dossier(1, days=13), "A.txt": dossier(1)}), path)
    lake.write_bronze(envelopes(spark, {}), path)
    names, bad = stored(spark, path)
    assert {k: v for k, v in names.items() if "UNKNOWN" not in k} == {"CLM-IE-2026-0001": "a_fixed.txt", "CLM-IE-2026-0002": "b.txt"}
    assert len(names) + bad == 3


def test_bronze_keeps_lines_it_cannot_read(spark, tmp_path):
    path = tmp_path / "bronze"
    lake.write_bronze(envelopes(spark, {f"{i}.txt": dossier(i) for i in range(1, 5)}), str(path))
    for bucket in path.glob("bucket=*"):
        (bucket / "part-broken.txt").write_text("{not json\n", encoding="utf-8")
    broken = len(list(path.glob("bucket=*")))
    lake.write_bronze(envelopes(spark, {f"{i}_.txt": dossier(i) for i in range(1, 5)}), str(path))
    names, bad = stored(spark, str(path))
    assert len(names) == 4 and all(v.endswith("_.txt") for v in names.values()) and bad == broken


def test_folders_that_do_not_exist_are_empty(spark, tmp_path):
    for read in (lake.read_documents, lake.read_corpus, lake.scan_inbound):
        assert read(spark, str(tmp_path / "nowhere")).count() == 0


def evaluated(spark, texts):
    return quality.evaluate(govern(payload_columns(envelopes(spark, texts)), "salt"))


def test_an_amount_too_large_costs_one_row(spark):
    huge = dossier(2).replace("1,050.25 100.00 950.25", "99,999,999,999,999,999.00 100.00 99,999,999,999,999,999.00")
    longest = dossier(3).replace("50.25 0.00 50.25", f"{'9' * 400}.00 0.00 50.25")
    rows = {r["claim_id"]: r for r in evaluated(spark, {"a.txt": dossier(1), "b.txt": huge, "c.txt": longest}).collect()}
    assert rows["CLM-IE-2026-0001"]["governance_error"] is None and rows["CLM-IE-2026-0001"]["is_valid"]
    assert {rows[f"CLM-IE-2026-000{i}"]["governance_error"] for i in (2, 3)} == {"an amount is too large"}


@pytest.mark.parametrize("field", ["total_net_claimed", "total_loss_amount"])
def test_nan_is_not_a_positive_amount(spark, field):
    claims = payload_columns(envelopes(spark, {"a.txt": dossier(1)})).withColumn(field, F.lit(float("nan")))
    row = quality.evaluate(govern(claims, "salt")).first()
    assert row["governance_error"] is None and not row[_amounts_flag()] and not row["is_valid"]


def _amounts_flag():
    return next(r.flag for r in quality.rules() if r.name == fixed.RULE_AMOUNTS)


def test_nan_items_are_not_positive(spark):
    claims = payload_columns(envelopes(spark, {"a.txt": dossier(1)}))
    items = F.transform("line_items", lambda item: item.withField("amount", F.lit(float("nan"))))
    assert not quality.evaluate(govern(claims.withColumn("line_items", items), "salt")).first()[_amounts_flag()]


def test_every_failed_rule_has_a_reason(spark):
    claims = payload_columns(envelopes(spark, {"a.txt": dossier(1, policy="N/A", days=300, ppsn="x")}))
    nothing = claims.withColumn("currency", F.lit(None).cast("string"))
    rows = quality.to_quarantine(quality.evaluate(govern(nothing, "salt"))).collect()
    assert len(rows) == 1 and len(rows[0]["failed_rules"]) == len(rows[0]["failure_reasons"]) >= 3
    assert any("Document currency: 'None'" in r for r in rows[0]["failure_reasons"])


def test_declared_rules_without_critical_ones_have_none():
    declared = [{"id": fixed.RULE_TIMELY, "severity": "HIGH", "max_latency_days": 5}]
    settings = quality.RuleSettings.from_declarations(declared)
    assert settings.critical == () and settings.max_notification_days == 5


def test_chunk_ids_are_unique_and_long_numbers_are_text(spark):
    text = "Intro\n\nSECTION 3: A\none\n\nSECTION 99999999999999999999: far\nSECTION ٣: other digits\n\nSECTION 3: B\ntwo"
    documents = [("a.txt", "/x/a.txt", text), ("a.txt", "/y/a.txt", text)]
    chunks = chunking.chunk_documents(spark.createDataFrame(documents, "file_name string, file_path string, text string")).collect()
    ids = [r["chunk_id"] for r in chunks]
    assert len(ids) == len(set(ids)) == 6 and {i for i in ids if "_sec" in i} == {f"a_sec3_part{k}" for k in range(4)}
    assert any("99999999999999999999" in r["text"] for r in chunks)


def test_upsert_takes_the_greatest_of_equal_keys(spark):
    table = spark.createDataFrame([(1, "z", 0)], "k int, v string, n int")
    incoming = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 0)], "k int, v string, n int")
    assert sorted(tuple(r) for r in upsert(table, incoming, "k", ["n"]).collect()) == [(1, "b", 2), (2, "c", 0)]


def test_vectors_that_are_no_numbers_are_no_hits(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1, [1.0, 0.0]), (2, 1, [nan, 1.0]), (3, 1, [0.0, 1.0]), (4, 1, [1.0, 0.0, 0.0]), (5, 1, None), (6, 1, [inf, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, section_number long, embedding array<double>").coalesce(1)
    queries = spark.createDataFrame([(f"q{i}", [1.0, 0.1], None) for i in range(3)], "query string, vector array<double>, section long")
    for asked in (queries, [VectorQuery(f"q{i}", [1.0, 0.1]) for i in range(3)]):
        found = search_vectors(vectors, asked, 1, "vec_id").collect()
        assert sorted((r["query"], r["vec_id"]) for r in found) == [(f"q{i}", 1) for i in range(3)]
    assert {r["vec_id"] for r in unusable_vectors(vectors, 2, "vec_id").collect()} == {2, 4, 5, 6}
    assert search_vectors(vectors, queries, 5, "vec_id").filter("query = 'q0'").count() == 2


def test_citations_of_one_area_do_not_push_out_another(spark):
    areas = [area for area, *_ in fixed.AUDIT_AREAS]
    rows = [(areas[0], f"s{i}", "x", 0.5) for i in range(9)] + [(a, "s", "x", 0.1) for a in areas[1:]] + [("other", "s", "x", 1.0)]
    cited = audit.resolve_citations(spark.createDataFrame(rows, "area string, regulatory_section string, excerpt string, similarity_score double"))
    assert set(cited) == set(areas) and cited[areas[0]].section == "s0"


def test_fact_and_rejected_are_all_promoted_claims(spark):
    silver = quality.to_silver(evaluated(spark, {f"{i}.txt": dossier(i, policy=f"POL-IE-{i:06}") for i in range(1, 6)}))
    silver = silver.withColumn("incident_date", F.when(F.col("claim_id").endswith("2"), "2026-02-31").otherwise(F.col("incident_date")))
    rejected = {r["claim_id"]: r["reason"] for r in star.rejected_claims(silver).collect()}
    assert rejected == {"CLM-IE-2026-0002": "incident_date is no date"}
    held = {r["claim_id"] for r in star.build_star(silver).fact_claims.collect()}
    assert held | set(rejected) == {r["claim_id"] for r in silver.collect()} and not held & set(rejected)
