"""Declared schemas of every tier. Nothing is inferred at read time."""

from pyspark.sql import types as T


def _struct(**fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()

LINE_ITEM = _struct(category=_S, description=_S, amount=_D, deductible=_D, net_claimed=_D)

RAW_CLAIM = _struct(
    claim_id=_S,
    policy_number=_S,
    status_banner=_S,
    filing_date=_S,
    incident_date=_S,
    days_to_notify=_L,
    dora_classification=_S,
    claimant_name=_S,
    claimant_ppsn=_S,
    claimant_email=_S,
    claimant_phone=_S,
    loss_location=_S,
    eircode=_S,
    incident_type=_S,
    incident_description=_S,
    currency=_S,
    line_items=T.ArrayType(LINE_ITEM),
    total_loss_amount=_D,
    total_deductible=_D,
    total_net_claimed=_D,
    statutory_attestation=_S,
)

ENVELOPE = _struct(
    ingestion_id=_S,
    source_filename=_S,
    source_file_path=_S,
    source_file_size_bytes=_L,
    source_file_sha256=_S,
    ingestion_timestamp=_S,
    extraction_method=_S,
    model_version=_S,
    extracted_payload=RAW_CLAIM,
    raw_text_length=_L,
    lakehouse_layer=_S,
)

SILVER = _struct(
    claim_id=_S,
    policy_number=_S,
    filing_date=_S,
    incident_date=_S,
    days_to_notify=_L,
    dora_classification=_S,
    incident_type=_S,
    claimant_ppsn_hash=_S,
    claimant_name_masked=_S,
    claimant_email_masked=_S,
    claimant_phone_masked=_S,
    loss_county=_S,
    eircode_routing_key=_S,
    currency=_S,
    total_loss_amount=_D,
    total_deductible=_D,
    total_net_claimed=_D,
    num_line_items=_L,
    incident_description_clean=_S,
    statutory_attestation=_S,
    quality_score=_D,
    source_filename=_S,
    source_file_sha256=_S,
    ingestion_id=_S,
    lakehouse_promotion_timestamp=_S,
    governance_status=_S,
)

QUARANTINE = T.StructType(
    SILVER.fields
    + [
        T.StructField("failed_rules", T.ArrayType(_S)),
        T.StructField("failure_reasons", T.ArrayType(_S)),
    ]
)

FINDING = _struct(
    area=_S,
    verdict=_S,
    regulatory_section=_S,
    statutory_citation=_S,
    observation=_S,
    similarity_score=_D,
)

AUDIT_REPORT = _struct(
    claim_id=_S,
    overall_verdict=_S,
    policy_number=_S,
    total_net_claimed=_D,
    days_to_notify=_L,
    dora_classification=_S,
    findings=T.ArrayType(FINDING),
    regulatory_citations_cited=T.ArrayType(_S),
    audit_timestamp=_S,
    supervisory_summary=_S,
)

CHUNK = _struct(
    chunk_id=_S,
    text=_S,
    metadata=_struct(
        source_file=_S, section=_S, section_number=_L, regulatory_body=_S, framework=_S
    ),
)

ADJUDICATION = _struct(
    claim_id=_S, action=_S, examiner_notes=_S, adjudication_timestamp=_S, examiner=_S
)
