import hashlib
import hmac
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweir import fixed, schemas
from claimweir.functions import pii
from claimweir.operators.govern import govern
from claimweir.operators.quality import (
    RuleSettings,
    evaluate,
    failed_rules,
    failure_reasons,
    promotion_summary,
    to_quarantine,
    to_silver,
)

SALT = "test_secret_salt_12345"


def one(spark, value, column, kind="string"):
    frame = spark.createDataFrame([(value,)], f"v {kind}")
    return frame.select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("salt", [SALT, "k" * 64, "long key " * 20, "ключ"])
@pytest.mark.parametrize("ppsn", ["1234567T", " 7654321wa ", "INVALID", "é"])
def test_hash_is_keyed_digest(spark, salt, ppsn):
    want = hmac.new(salt.encode(), ppsn.strip().upper().encode(), hashlib.sha256).hexdigest()
    got = one(spark, ppsn, lambda c: pii.hash_ppsn(c, salt))
    assert got == "PPSN_" + want[:32] and len(got) == 37


def test_no_ppsn_no_hash(spark):
    assert one(spark, None, lambda c: pii.hash_ppsn(c, SALT)) is None
    assert one(spark, "", lambda c: pii.hash_ppsn(c, SALT)) is None


@pytest.mark.parametrize(
    "ppsn, valid",
    [("1234567T", True), ("1234567wa", True), ("INVALID_PPSN_123", False), ("12345678T", False),
     ("1234567ABC", False), (None, False), ("", False), (" 1234567T\n", True)],
)
def test_ppsn_format(spark, ppsn, valid):
    assert one(spark, ppsn, pii.ppsn_valid) is valid


@pytest.mark.parametrize(
    "name, masked",
    [
        ("Mr. Alister Kinnear", "Mr. A****** K******"),
        ("MR. O Ó Al", "MR. O* Ó* A*"),
        ("  Dr.\tAnn Lee ", "Dr. A** L**"),
        ("", "[NAME_REDACTED]"),
        (" \n", "[NAME_REDACTED]"),
        (None, "[NAME_REDACTED]"),
    ],
)
def test_mask_name(spark, name, masked):
    assert one(spark, name, pii.mask_name) == masked


@pytest.mark.parametrize(
    "email, masked",
    [
        ("marcodwane@davis.org", "m********e@davis.org"),
        ("ab@x.ie", "a*@x.ie"),
        ("a@x.ie", "a*@x.ie"),
        ("abc@x@y.ie", "a*c@x@y.ie"),
        ("plain", "[EMAIL_REDACTED]"),
        ("", "[EMAIL_REDACTED]"),
        (None, "[EMAIL_REDACTED]"),
        ("@x.ie", None),
    ],
)
def test_mask_email(spark, email, masked):
    assert one(spark, email, pii.mask_email) == masked


@pytest.mark.parametrize(
    "phone, masked",
    [
        ("+353 83 125 5506", "+353 83 *** **06"),
        ("123456", "******"),
        ("1234567", "1234567 *** **67"),
        (" ", "[PHONE_REDACTED]"),
        (None, "[PHONE_REDACTED]"),
    ],
)
def test_mask_phone(spark, phone, masked):
    assert one(spark, phone, pii.mask_phone) == masked


@pytest.mark.parametrize(
    "address, county",
    [
        ("01 Hession Street, Seanna Ville, Co. Wexford [D14 PKX2]", "Co. Wexford"),
        ("1 Street, Co. Cork, Ireland", "Co. Cork"),
        ("1 Street, Co. Dún Laoghaire", "Unknown County"),
        ("1 Street, Co. Kerry Incident Type: Fire", "Unknown County"),
        ("no county", "Unknown County"),
        (None, "Unknown County"),
    ],
)
def test_county(spark, address, county):
    assert one(spark, address, pii.county) == county


@pytest.mark.parametrize("code, key", [("d14 PKX2", "D14"), (" D6", "UNK"), ("D6W", "D6W"), (None, "UNK")])
def test_routing_key(spark, code, key):
    assert one(spark, code, pii.routing_key) == key


def test_narratives_agree_with_plain_regular_expressions(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select(
        "text", pii.sanitize_narrative(F.col("text")).alias("clean")
    ).collect()
    steps = [
        (fixed.PPSN_IN_TEXT, fixed.PPSN_REDACTED),
        (fixed.EMAIL_IN_TEXT, fixed.EMAIL_REDACTED),
        (fixed.PHONE_IN_TEXT, fixed.PHONE_REDACTED),
    ]
    for row in rows:
        want = row["text"]
        for pattern, replacement in steps:
            want = re.sub(pattern, replacement, want)
        assert row["clean"] == want
    assert one(spark, None, pii.sanitize_narrative) == ""
    assert one(spark, "PPSN 1234567T, a@b.ie", pii.sanitize_narrative) == "PPSN [PPSN_REDACTED], [EMAIL_REDACTED]"


ITEMS = [("c", "d", 1000.0, 100.0, 900.0), ("c", "d", 2000.0, 200.0, 1800.0)]
CLEAN = {
    "claim_id": "CLM-TEST-0001",
    "policy_number": "POL-IE-123456",
    "status_banner": "CLEAN INGESTION",
    "filing_date": "2026-02-15",
    "incident_date": "2026-02-01",
    "days_to_notify": 14,
    "dora_classification": "Major ICT Incident (DORA Article 18)",
    "claimant_name": "Mr. Test Claimant",
    "claimant_ppsn": "1234567T",
    "claimant_email": "test@domain.ie",
    "claimant_phone": "+353 87 123 4567",
    "loss_location": "1 Street, Co. Dublin",
    "eircode": "D02 X285",
    "incident_type": "ICT Operational System Outage",
    "incident_description": "Clean incident description.",
    "currency": "EUR",
    "line_items": ITEMS,
    "total_loss_amount": 3000.0,
    "total_deductible": 300.0,
    "total_net_claimed": 2700.0,
    "statutory_attestation": "Attestation statement.",
}


def judged(spark, *changes, settings=RuleSettings()):
    rows = []
    for number, change in enumerate(changes):
        claim = {**CLEAN, **change}
        rows.append((*[claim[n] for n in schemas.RAW_CLAIM.names], "test.pdf", "sha", f"id-{number}"))
    provenance = ["source_filename", "source_file_sha256", "ingestion_id"]
    added = [T.StructField(name, T.StringType()) for name in provenance]
    schema = T.StructType([*schemas.RAW_CLAIM.fields, *added])
    return evaluate(govern(spark.createDataFrame(rows, schema), SALT), settings)


@pytest.mark.parametrize(
    "change, valid, score, failed",
    [
        ({}, True, 1.0, []),
        (
            {"line_items": [("c", "d", -5000.0, 0.0, -5000.0)], "total_loss_amount": -5000.0, "total_net_claimed": -5000.0},
            False, 0.8571, ["RULE_POSITIVE_AMOUNTS"],
        ),
        ({"policy_number": None}, False, 0.8571, ["RULE_POLICY_NUMBER_PRESENT"]),
        ({"policy_number": " \t"}, False, 0.8571, ["RULE_POLICY_NUMBER_PRESENT"]),
        ({"days_to_notify": 320}, False, 0.8571, ["RULE_TIMELY_NOTIFICATION"]),
        ({"days_to_notify": 90}, True, 1.0, []),
        ({"days_to_notify": 91}, False, 0.8571, ["RULE_TIMELY_NOTIFICATION"]),
        ({"days_to_notify": None}, True, 1.0, []),
        ({"currency": "SEK"}, True, 0.8571, ["RULE_ALLOWED_CURRENCY"]),
        ({"currency": "SEK", "claimant_ppsn": None}, False, 0.7143, ["RULE_ALLOWED_CURRENCY", "RULE_VALID_PPSN_FORMAT"]),
        ({"total_net_claimed": 2700.04}, True, 1.0, []),
        ({"total_net_claimed": 2700.05}, True, 0.8571, ["RULE_LEDGER_RECONCILED"]),
        ({"total_net_claimed": 2699.94}, True, 0.8571, ["RULE_LEDGER_RECONCILED"]),
        ({"line_items": []}, True, 0.8571, ["RULE_LEDGER_RECONCILED"]),
        ({"total_net_claimed": 0.0}, False, 0.7143, ["RULE_POSITIVE_AMOUNTS", "RULE_LEDGER_RECONCILED"]),
        ({"loss_location": None}, True, 0.8571, ["RULE_METADATA_COMPLETENESS"]),
        ({"incident_type": ""}, True, 1.0, []),
    ],
)
def test_gate(spark, change, valid, score, failed):
    row = judged(spark, change).select("is_valid", "quality_score", failed_rules().alias("failed")).first()
    assert (row["is_valid"], row["quality_score"], row["failed"]) == (valid, score, failed)


def test_reasons_read_like_the_record(spark):
    row = judged(spark, {"policy_number": None, "days_to_notify": 320}).select(failure_reasons().alias("r")).first()
    assert row["r"] == [
        "RULE_POLICY_NUMBER_PRESENT: Policy number: 'None'",
        "RULE_TIMELY_NOTIFICATION: Elapsed days to notice: 320 (Max allowed: 90)",
    ]


def test_every_record_goes_one_way(spark):
    evaluated = judged(
        spark, {}, {"days_to_notify": 320}, {"claimant_email": "@x.ie"}, {"filing_date": None}, {"currency": "SEK"}
    )
    summary = promotion_summary(evaluated).first().asDict()
    assert summary == {"total_processed": 5, "promoted_to_silver": 2, "quarantined_anomalies": 1, "errors": 2}
    silver, quarantine = to_silver(evaluated), to_quarantine(evaluated)
    assert silver.count() == 2 and quarantine.count() == 1
    assert silver.schema.names == schemas.SILVER.names and quarantine.schema.names == schemas.QUARANTINE.names
    raw = {CLEAN[n] for n in ("claimant_ppsn", "claimant_email", "claimant_phone", "claimant_name", "loss_location")}
    for row in silver.collect():
        assert not raw & set(row.asDict().values())


def test_declared_settings():
    settings = RuleSettings.from_declarations(
        [
            {"id": "RULE_TIMELY_NOTIFICATION", "severity": "CRITICAL", "max_latency_days": 30},
            {"id": "RULE_ALLOWED_CURRENCY", "severity": "HIGH", "allowed_currencies": ["EUR"]},
            {"id": "RULE_LEDGER_RECONCILED", "severity": "HIGH", "rounding_tolerance_eur": 0.01},
        ],
        min_score=0.5,
    )
    assert settings.critical == ("RULE_TIMELY_NOTIFICATION",)
    assert (settings.max_notification_days, settings.allowed_currencies) == (30, ("EUR",))
    assert (settings.tolerance, settings.min_score) == ("0.01", 0.5)
