import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from claimweir import fixed, schemas
from claimweir.operators import audit as auditing
from claimweir.operators import review
from claimweir.plans import cycle
from claimweir.plans.cycle import CycleSettings, Lake, ingest_inbound, release_overrides, run_cycle, tier_status, to_release
from claimweir.sources import lake
from tests.test_text import DOSSIER

SETTINGS = CycleSettings("a salt for tests")
CORPUS = """Guidelines

SECTION 3: TIMELINES
Claims reach the insurer within 90 days; the notification latency is the statutory SLA.

SECTION 4: POLICIES
Every claim bears a policy number.

SECTION 5: VALUATION
Negative liquidation is prohibited.
"""


def dossier(number, policy="POL-IE-000001", days=12, ppsn="1234567T"):
    text = DOSSIER.replace("CLM-IE-2026-0007", f"CLM-IE-2026-{number:04}").replace("-50.25 0.00 -50.25", "50.25 0.00 50.25")
    text = text.replace("[MISSING / NOT PROVIDED]", policy).replace("949.75 100.00 849.75", "1,050.25 100.00 950.25")
    return text.replace("12 days", f"{days} days").replace("Ms. Ann Lee", f"Ms. Ann Lee\nClaimant PPSN: {ppsn}\nContact Email: ann.lee@example.ie")


@pytest.fixture(scope="module")
def target(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("lake")
    (root / "inbound").mkdir()
    (root / "corpus").mkdir()
    (root / "corpus" / "guide.txt").write_text(CORPUS, encoding="utf-8")
    texts = {
        "claim_1.txt": dossier(1),
        "claim_2.txt": dossier(2, policy="N/A"),
        "claim_3.txt": dossier(3, days=320),
        "claim_4.txt": dossier(4, ppsn="none at all"),
        "claim_4_again.txt": dossier(4, ppsn="7654321W"),
    }
    for name, text in texts.items():
        (root / "inbound" / name).write_text(text, encoding="utf-8")
    made = Lake(str(root))
    run_cycle(spark, made, SETTINGS)
    return made


def test_tiers(spark, target):
    counts = {r["tier"]: r["records"] for r in tier_status(spark, target).collect()}
    assert counts == {"raw": 5, "bronze": 4, "silver": 2, "quarantine": 2, "gold": 2}
    nowhere = {r["records"] for r in tier_status(spark, Lake("/tmp/no-such-lake")).collect()}
    assert nowhere == {0}


def test_last_file_of_a_claim_wins(spark, target):
    good, rejected = lake.read_bronze(spark, target.bronze)
    names = {r[0]: r[1] for r in good.select("extracted_payload.claim_id", "source_filename").collect()}
    assert names["CLM-IE-2026-0004"] == "claim_4_again.txt" and rejected.count() == 0


def test_no_raw_identifier_beyond_bronze(spark, target):
    silver = lake.read_silver(spark, target.silver)
    mart = spark.read.parquet(target.gold("claims_analytical_mart"))
    for table in (silver, mart, lake.read_quarantine(spark, target.quarantine)):
        printed = " ".join(json.dumps(r.asDict(True), default=str) for r in table.collect())
        for raw in ("1234567T", "7654321W", "ann.lee@", "Ann Lee", "Main Street"):
            assert raw not in printed


def test_audit_cites_the_corpus(spark, target):
    reports = {r["claim_id"]: r.asDict(True) for r in lake.read_audit(spark, target.audit_reports).collect()}
    verdicts = {k: v["overall_verdict"] for k, v in reports.items()}
    assert verdicts == {
        "CLM-IE-2026-0001": "COMPLIANT",
        "CLM-IE-2026-0002": "REGULATORY_BREACH",
        "CLM-IE-2026-0003": "REGULATORY_BREACH",
        "CLM-IE-2026-0004": "COMPLIANT",
    }
    late = reports["CLM-IE-2026-0003"]
    assert late["regulatory_citations_cited"] == ["CBI-DORA Section 3.2 (90-Day SLA Limit)"]
    first, *_, last = late["findings"]
    assert first["verdict"] == "BREACH" and first["regulatory_section"] == "SECTION 3: TIMELINES"
    assert first["statutory_citation"].startswith("SECTION 3: TIMELINES (Similarity: ") and first["similarity_score"] > 0
    assert last["regulatory_section"] == "SECTION 6: DATA GOVERNANCE AND GDPR" and last["similarity_score"] == 0.0
    ledger = spark.read.parquet(target.audit_ledger)
    assert len(ledger.columns) == 11 and ledger.count() == 4


def test_feeds_and_documents(spark, target):
    manifest = {r["table_name"]: r["rows"] for r in spark.read.json(target.manifest).collect()}
    assert manifest["fact_claims"] == 2 and manifest["claims_analytical_mart"] == 2 and len(manifest) == 7
    feed = spark.read.option("header", True).csv(target.feed("fact_claims"))
    assert feed.count() == 2 and feed.columns[0] == "claim_key"
    summary = spark.read.json(target.kpi_summary).first().asDict()
    assert summary["Total Claims"] == 2 and summary["Total Net Claim Amount"] == "EUR 1,900.50"
    assert len(summary) == 12


def test_overrides_reach_silver(spark, target):
    decisions = [
        ("CLM-IE-2026-0002", fixed.OVERRIDE_ACTION, "first", "2026-01-01T00:00:00", "e"),
        ("CLM-IE-2026-0002", fixed.REJECT_ACTION, "second thoughts", "2026-01-02T00:00:00", "e"),
        ("CLM-IE-2026-0003", fixed.REJECT_ACTION, "no", "2026-01-01T00:00:00", "e"),
    ]
    lake.append_adjudications(spark.createDataFrame(decisions, schemas.ADJUDICATION), target.adjudications)
    later = [("CLM-IE-2026-0003", fixed.OVERRIDE_ACTION, "storm", "2026-01-03T00:00:00", "e")]
    lake.append_adjudications(spark.createDataFrame(later, schemas.ADJUDICATION), target.adjudications)
    released = {r["claim_id"]: r["governance_status"] for r in release_overrides(spark, target).collect()}
    assert set(released) == {"CLM-IE-2026-0001", "CLM-IE-2026-0003", "CLM-IE-2026-0004"}
    assert set(released.values()) == {"VALID_PROMOTED"}


def test_broken_envelopes_are_kept_with_a_reason(spark, tmp_path):
    folder = tmp_path / "bronze"
    folder.mkdir()
    good = {
        "ingestion_id": "i", "source_filename": "f", "source_file_sha256": "s", "source_file_size_bytes": 1,
        "extracted_payload": {
            "claim_id": " C1 ", "filing_date": "2026-01-01", "incident_date": "2026-01-01", "total_net_claimed": 5.0,
            "policy_number": " None ", "unknown": 1,
        },
    }
    lacking = {**good, "extracted_payload": {"claim_id": "C2"}}
    lines = [json.dumps(good), json.dumps(lacking), "{not json"]
    (folder / "bronze.json").write_text("\n".join(lines), encoding="utf-8")
    valid, rejected = lake.read_bronze(spark, str(folder))
    claim = valid.select("extracted_payload.*").first()
    assert (claim["claim_id"], claim["policy_number"], claim["currency"], claim["line_items"]) == ("C1", None, "EUR", [])
    reasons = sorted(r["reason"] for r in rejected.select("reason").collect())
    assert len(reasons) == 2 and "missing filing_date" in reasons[0] and "not a JSON envelope" in " ".join(reasons)


@pytest.mark.parametrize(
    "policy, net, days, ppsn, verdict",
    [
        ("POL-1", 1.0, 90, "PPSN_1", "COMPLIANT"),
        ("POL-1", 0.0, 90, "PPSN_1", "COMPLIANT"),
        ("POL-1", -0.01, 90, "PPSN_1", "REGULATORY_BREACH"),
        ("POL-1", 1.0, 91, "PPSN_1", "REGULATORY_BREACH"),
        (" null ", 1.0, 1, "PPSN_1", "REGULATORY_BREACH"),
        ("N/A", 1.0, 1, "PPSN_1", "COMPLIANT"),
        ("POL-1", 1.0, 1, None, "REQUIRES_REVIEW"),
        ("POL-1", None, None, "plain", "REQUIRES_REVIEW"),
    ],
)
def test_verdicts(spark, policy, net, days, ppsn, verdict):
    schema = "claim_id string, policy_number string, total_net_claimed double, days_to_notify long, claimant_ppsn_hash string, dora_classification string"
    claim = spark.createDataFrame([("C", policy, net, days, ppsn, None)], schema)
    wording = {area: auditing.Citation(h, e, 0.0) for area, _, _, h, e, _ in fixed.AUDIT_AREAS}
    report = auditing.audit(claim, wording).first()
    assert report["overall_verdict"] == verdict and len(report["findings"]) == 4


def test_register_and_lookup(spark, target):
    quarantine = lake.read_quarantine(spark, target.quarantine)
    rows = {r["claim_id"]: r for r in review.quarantine_register(quarantine).collect()}
    assert rows["CLM-IE-2026-0002"]["policy"] == "[MISSING / NOT PROVIDED]"
    assert rows["CLM-IE-2026-0003"]["latency"] == "320 days"
    assert review.dossier(quarantine, "CLM-IE-2026-0003").select(F.col("total_net_claimed")).first()[0] == 950.25


@pytest.fixture
def small_lake(spark, tmp_path):
    for folder in ("inbound/a", "corpus"):
        (tmp_path / folder).mkdir(parents=True)
    (tmp_path / "corpus" / "guide.txt").write_text(CORPUS, encoding="utf-8")
    for number, more in enumerate(({}, {"policy": "N/A"}, {"days": 320}), 1):
        (tmp_path / "inbound" / "a" / f"claim_{number}.txt").write_text(dossier(number, **more), encoding="utf-8")
    return Lake(str(tmp_path))


def tiers(spark, target):
    read = {"silver": lake.read_silver(spark, target.silver), "quarantine": lake.read_quarantine(spark, target.quarantine)}
    return {name: sorted(r.claim_id[-1] for r in rows.select("claim_id").collect()) for name, rows in read.items()}


def test_each_inbound_file_is_read_once(spark, small_lake, monkeypatch):
    counts = ingest_inbound(spark, small_lake, SETTINGS, files_at_a_time=2).first()
    assert (counts.total_processed, counts.successful) == (3, 3)
    before = lake.bronze_table(spark, small_lake.bronze).state()
    with monkeypatch.context() as unused:
        unused.setattr("claimweir.plans.cycle.to_bronze", lambda *_: pytest.fail("a file was read again"))
        assert ingest_inbound(spark, small_lake, SETTINGS).first().total_processed == 0
    assert lake.bronze_table(spark, small_lake.bronze).state() == before
    with open(f"{small_lake.inbound}/claim_4.txt", "w", encoding="utf-8") as file:
        file.write(dossier(4))
    assert ingest_inbound(spark, small_lake, SETTINGS).first().total_processed == 1
    assert lake.read_lines(spark, small_lake.bronze).count() == 4
    assert ingest_inbound(spark, Lake("/tmp/no-such-lake"), SETTINGS).first().total_processed == 0


def test_a_file_whose_batch_failed_is_handed_over_again(spark, small_lake, monkeypatch):
    with monkeypatch.context() as broken:
        broken.setattr("claimweir.plans.cycle.to_bronze", lambda *_: 1 / 0)
        with pytest.raises(Exception, match="division"):
            ingest_inbound(spark, small_lake, SETTINGS)
    assert ingest_inbound(spark, small_lake, SETTINGS).first().total_processed == 3


def test_released_claims_reach_silver_and_the_mart_once(spark, small_lake, monkeypatch):
    run_cycle(spark, small_lake, SETTINGS)
    assert tiers(spark, small_lake) == {"silver": ["1"], "quarantine": ["2", "3"]}
    assert to_release(spark, small_lake, SETTINGS) is False

    def decide(claim, action, at):
        row = [(f"CLM-IE-2026-000{claim}", action, "why", f"2026-01-0{at}T00:00:00", "e")]
        lake.append_adjudications(spark.createDataFrame(row, schemas.ADJUDICATION), small_lake.adjudications)

    decide(3, fixed.OVERRIDE_ACTION, 1)
    decide(2, fixed.REJECT_ACTION, 1)
    assert to_release(spark, small_lake, SETTINGS) is True
    assert tiers(spark, small_lake) == {"silver": ["1", "3"], "quarantine": ["2"]}
    monkeypatch.setattr("claimweir.plans.cycle._settle", lambda *_: pytest.fail("an applied log was applied again"))
    assert to_release(spark, small_lake, SETTINGS) is False
    monkeypatch.undo()
    for _ in range(2):  # a whole cycle again, twice: the same lake
        run_cycle(spark, small_lake, SETTINGS)
        assert tiers(spark, small_lake) == {"silver": ["1", "3"], "quarantine": ["2"]}
        mart = spark.read.parquet(small_lake.gold("claims_analytical_mart"))
        assert sorted(r.claim_id[-1] for r in mart.collect()) == ["1", "3"]
        assert to_release(spark, small_lake, SETTINGS) is False
    status = {r.claim_id[-1]: r.governance_status for r in lake.read_silver(spark, small_lake.silver).collect()}
    assert status == {"1": fixed.PROMOTED, "3": fixed.PROMOTED}
    decide(3, fixed.REJECT_ACTION, 2)  # second thoughts
    decide(2, fixed.OVERRIDE_ACTION, 3)
    assert to_release(spark, small_lake, SETTINGS) is True
    assert tiers(spark, small_lake) == {"silver": ["1", "2"], "quarantine": ["3"]}
    back = lake.read_quarantine(spark, small_lake.quarantine).first()
    assert back.governance_status == fixed.QUARANTINED and back.failed_rules == ["RULE_TIMELY_NOTIFICATION"]


@pytest.mark.parametrize("write", ["write_quarantine", "write_silver"])
def test_a_release_that_broke_off_is_done_again(spark, small_lake, monkeypatch, write):
    run_cycle(spark, small_lake, SETTINGS)
    row = [("CLM-IE-2026-0003", fixed.OVERRIDE_ACTION, "storm", "2026-01-03T00:00:00", "e")]
    lake.append_adjudications(spark.createDataFrame(row, schemas.ADJUDICATION), small_lake.adjudications)
    known, calls = getattr(lake, write), []

    def once(*arguments):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("gone")
        return known(*arguments)

    with monkeypatch.context() as broken:
        broken.setattr(lake, write, once)
        with pytest.raises(OSError):
            to_release(spark, small_lake, SETTINGS)
    assert to_release(spark, small_lake, SETTINGS) is True
    assert tiers(spark, small_lake) == {"silver": ["1", "3"], "quarantine": ["2"]}


def test_json_tables_are_compressed_and_silver_is_written_at_once(spark, target, tmp_path, monkeypatch):
    for folder in (target.quarantine, target.audit_reports):
        names = [p.name for p in Path(folder).glob("part-*")]
        assert names and all(n.endswith(".json.gz") for n in names)
    assert all(p.name.endswith(".json") for p in Path(target.kpi_summary).glob("part-*"))
    staged, before = [], cycle.stage
    monkeypatch.setattr(cycle, "stage", lambda table, name, *a, **k: staged.append(name) or before(table, name, *a, **k))
    made = Lake(str(tmp_path))
    cycle.to_bronze(lake.read_documents(spark, target.inbound), made, SETTINGS)
    cycle.to_silver(spark, made, SETTINGS)
    assert lake.read_silver(spark, made.silver).count() == 2 and lake.read_quarantine(spark, made.quarantine).count() == 2
    assert "silver" not in staged
