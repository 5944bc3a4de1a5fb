"""Dossier text to claim fields: one projection per document, no row leaves the JVM."""

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweir import fixed, schemas
from claimweir.functions.text import filled, find, strip, utc_text

_P = fixed.DOSSIER_PATTERNS
_TRIPLE = rf"{fixed.MONEY}\s+{fixed.MONEY}\s+{fixed.MONEY}"


def _amount(printed: Column) -> Column:
    return F.replace(printed, F.lit(","), F.lit("")).try_cast("double")


def claim_id(text: Column, file_name: Column) -> Column:
    stem = F.regexp_replace(file_name, r"(?<=[^.])\.[^.]*$", "")
    return F.coalesce(
        find(text, _P["claim_id"]), F.concat(F.lit("CLM-UNKNOWN-"), stem)
    )


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that it names several times, worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def policy_number(text: Column) -> Column:
    absent = "|".join(fixed.POLICY_ABSENT_WORDS)
    return _once(find(text, _P["policy_number"]), lambda printed: F.when(~F.upper(printed).rlike(absent), printed))


def clean_policy(policy: Column) -> Column:
    """Placeholders for a missing policy become null."""
    return _once(strip(policy), lambda stripped: F.when(~stripped.isin(fixed.POLICY_PLACEHOLDERS), stripped))


def filing_date(text: Column) -> Column:
    return F.coalesce(find(text, _P["filing_date"]), F.lit(fixed.DEFAULT_FILING_DATE))


def incident_date(text: Column) -> Column:
    return F.coalesce(find(text, _P["incident_date"]), filing_date(text))


def days_to_notify(text: Column) -> Column:
    return F.coalesce(find(text, _P["days_to_notify"]).try_cast("long"), F.lit(0))


def tier(text: Column) -> Column:
    return F.coalesce(find(text, _P["dora_classification"]), F.lit(fixed.DEFAULT_TIER))


def loss_location(text: Column) -> Column:
    both_lines = filled(F.regexp_extract(text, f"(?U){_P['loss_location']}", 1))
    return strip(F.replace(both_lines, F.lit("\n"), F.lit(" ")))


def between(text: Column, field: str) -> Column:
    """Text between two headings over any number of lines; empty text between them is kept, not null.

    The headings are fixed wordings. They are found by one search that takes white space for text, and cut off with it afterwards.
    """
    begin, end = re.split(r"\\s\*\(\.\*\?\)\\s\*", _P[field])
    whole = F.regexp_extract(text, f"(?s){begin}.*?{end}", 0)
    inner = F.substring(whole, F.lit(len(begin) + 1), F.char_length(whole) - len(begin) - len(end))
    return F.when(text.isNotNull() & (whole != ""), strip(inner))


def totals(text: Column) -> list[Column]:
    """Gross, deductible and net of the totals line."""
    pattern = rf"(?U){fixed.TOTALS_LABEL}\s+{_TRIPLE}"
    return [
        F.coalesce(_amount(filled(F.regexp_extract(text, pattern, group))), F.lit(0.0))
        for group in (1, 2, 3)
    ]


def line_items(text: Column, incident: Column) -> Column:
    section = F.regexp_extract(text, f"(?Us){_P['items_section']}", 1)
    # White space between amounts becomes one space, at which a plain split cuts; a pattern would be compiled for every item.
    flat = F.regexp_replace(section, r"(?U)\s+", " ")
    triples = F.regexp_extract_all(flat, F.lit(f"(?U){_TRIPLE}"), F.lit(0))
    description = F.concat(
        F.lit(fixed.ITEM_DESCRIPTION), F.coalesce(incident, F.lit("claim")), F.lit(".")
    )
    # The description rides along as an array: a lambda would work it out again for every item.
    described = F.arrays_zip(
        F.transform(triples, lambda triple: F.split(triple, " ")).alias("amounts"),
        F.array_repeat(description, F.size(triples)).alias("description"),
    )

    def item(part, index):
        return F.struct(
            F.concat(F.lit(fixed.ITEM_CATEGORY), (index + 1).cast("string")).alias("category"),
            part["description"].alias("description"),
            _amount(part["amounts"][0]).alias("amount"),
            _amount(part["amounts"][1]).alias("deductible"),
            _amount(part["amounts"][2]).alias("net_claimed"),
        )

    return F.transform(described, item)


def extract_claims(documents: DataFrame) -> DataFrame:
    """Claim fields of documents (file_name, text, ...); the incoming columns are kept."""
    text = F.col("text")
    one_line = [
        "status_banner",
        "claimant_name",
        "claimant_ppsn",
        "claimant_email",
        "claimant_phone",
        "eircode",
        "incident_type",
    ]
    gross, deductible, net = totals(text)
    fields = {
        "claim_id": claim_id(text, F.col("file_name")),
        "policy_number": clean_policy(policy_number(text)),
        "filing_date": filing_date(text),
        "incident_date": incident_date(text),
        "days_to_notify": days_to_notify(text),
        "dora_classification": tier(text),
        "loss_location": loss_location(text),
        "incident_description": between(text, "incident_description"),
        "currency": F.lit(fixed.DEFAULT_CURRENCY),
        "total_loss_amount": gross,
        "total_deductible": deductible,
        "total_net_claimed": net,
        "statutory_attestation": between(text, "statutory_attestation"),
    }
    fields.update({name: find(text, _P[name]) for name in one_line})
    return documents.withColumns(fields).withColumn(
        "line_items", line_items(text, F.col("incident_type"))
    )


def create_envelopes(claims: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """Bronze envelopes of extracted claims that carry file_name, file_path, content and text.

    uuid() gives every envelope its own identifier, so write the result before using it twice.
    """
    stamp = F.current_timestamp() if ingested_at is None else ingested_at
    payload = F.struct(*[F.col(name) for name in schemas.RAW_CLAIM.names])
    return claims.select(
        F.uuid().alias("ingestion_id"),
        F.col("file_name").alias("source_filename"),
        F.col("file_path").alias("source_file_path"),
        F.octet_length("content").cast("long").alias("source_file_size_bytes"),
        F.sha2("content", 256).alias("source_file_sha256"),
        utc_text(stamp).alias("ingestion_timestamp"),
        F.lit(fixed.EXTRACTION_METHOD).alias("extraction_method"),
        F.lit(fixed.EXTRACTION_VERSION).alias("model_version"),
        payload.alias("extracted_payload"),
        F.char_length("text").cast("long").alias("raw_text_length"),
        F.lit("bronze").alias("lakehouse_layer"),
    )


def ingestion_statistics(documents: DataFrame) -> DataFrame:
    """Counts over documents with claim_id and status_banner; a document without claim_id has failed."""
    done = F.col("claim_id").isNotNull()
    anomaly = done & F.coalesce(F.col("status_banner") == fixed.ANOMALY_BANNER, F.lit(False))
    return documents.agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.count_if(done).alias("successful"),
        F.count_if(~done).alias("failed"),
        F.count_if(anomaly).alias("anomalies_detected"),
        F.count_if(done & ~anomaly).alias("clean_detected"),
    )
