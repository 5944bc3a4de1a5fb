"""Reads behind the review screens, and the decisions taken there."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweir import fixed, schemas
from claimweir.functions.text import filled
from claimweir.operators.latest import latest_by_key
from claimweir.operators.star import date_of

SILVER_DISPLAY = [
    "claim_id",
    "policy_number",
    "filing_date",
    "days_to_notify",
    "dora_classification",
    "total_net_claimed",
    "loss_county",
    "claimant_name_masked",
    "claimant_ppsn_hash",
    "quality_score",
]


def quarantine_register(quarantine: DataFrame) -> DataFrame:
    return quarantine.select(
        "claim_id",
        F.coalesce(filled(F.col("policy_number")), F.lit(fixed.REGISTER_NO_POLICY)).alias("policy"),
        F.coalesce("total_net_claimed", F.lit(0.0)).alias("net_amount"),
        F.concat(F.coalesce("days_to_notify", F.lit(0)), F.lit(" days")).alias("latency"),
        "dora_classification",
        F.array_join("failed_rules", ", ").alias("triggered_rules"),
    )


def dossier(records: DataFrame, claim_id: str) -> DataFrame:
    """One record of a claim; the identifier is pushed down to the scan."""
    return records.filter(F.col("claim_id") == claim_id).limit(1)


def silver_display(silver: DataFrame) -> DataFrame:
    return silver.select(*SILVER_DISPLAY)


def reports_by_verdict(reports: DataFrame, verdict: str | None = None, shown: int = 6) -> DataFrame:
    """First reports of a verdict, or of all, by claim."""
    chosen = reports if verdict is None else reports.filter(F.col("overall_verdict") == verdict)
    return chosen.orderBy("claim_id").limit(shown)


def head_counts(reports: DataFrame) -> DataFrame:
    verdict = F.col("overall_verdict")
    return reports.agg(
        F.count_if(verdict == "COMPLIANT").alias("compliant"),
        F.count_if(verdict == "REGULATORY_BREACH").alias("breaches"),
    )


def apply_adjudications(
    quarantine: DataFrame, decisions: DataFrame, override: str = fixed.OVERRIDE_ACTION
) -> tuple[DataFrame, DataFrame]:
    """Rows an override moves to silver, and rows that stay. Only the latest decision on a claim counts."""
    last = latest_by_key(
        decisions, ["claim_id"], ["adjudication_timestamp", "action", "examiner_notes"]
    )
    released = last.filter(F.col("action") == override).select("claim_id")
    moved = quarantine.join(released, "claim_id", "left_semi").withColumn(
        "governance_status", F.lit(fixed.PROMOTED)
    )
    stays = quarantine.join(released, "claim_id", "left_anti")
    return moved.select(*schemas.SILVER.names), stays


def latency_check(claims: DataFrame) -> DataFrame:
    """Days between the two dates against the number printed on the dossier."""
    days = F.datediff(date_of(F.col("filing_date")), date_of(F.col("incident_date")))
    return claims.select(
        "claim_id",
        "days_to_notify",
        days.cast("long").alias("days_between"),
        (~days.eqNullSafe(F.col("days_to_notify"))).alias("mismatch"),
    )
